"""Scalar column functions (all JVM-side Spark SQL expressions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
EARTH_RADIUS_KM = 6371.0
LCG_MULTIPLIER = 1103515245
LCG_INCREMENT = 12345
LCG_MODULUS = 2000000
ENRICH_NIGHT_HOURS = [0, 1, 2, 3, 4, 5, 23]
RULE_NIGHT_HOURS = [0, 1, 2, 3, 4, 5]
RULE_HIGH_AMOUNT = 900.0
RULE_VELOCITY_1H = 6
RULE_VELOCITY_24H = 20
RISKY_IP_COUNTRIES = ["NG", "GH", "PK", "BD", "RU", "UA"]
VERSION_UNKNOWN_WORDS = ["legacy-unknown", "unknown", "n/a", "none"]
ISO_TS_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"
VERSION_UNSAFE_PATTERN = r"[^a-zA-Z0-9._\-]+"
# ---------------------------------------------------------------------------


def strip_space(c: Column | str) -> Column:
    """``c`` without white space (of any kind) at its ends."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_km(lat1, lon1, lat2, lon2, digits: int | None = 1) -> Column:
    la1, lo1, la2, lo2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((la2 - la1) / 2), 2) + F.cos(la1) * F.cos(la2) * F.pow(F.sin((lo2 - lo1) / 2), 2)
    d = F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))
    return F.bround(d, digits) if digits is not None else d


def device_id_lcg(t) -> Column:
    """``dev_`` + ((t * 1103515245 + 12345) mod 2,000,000) on int64 seconds."""
    v = F.pmod(_c(t).cast("long") * F.lit(LCG_MULTIPLIER) + F.lit(LCG_INCREMENT), F.lit(LCG_MODULUS))
    return F.concat(F.lit("dev_"), v.cast("string"))


def epoch_anchor(offset_s, anchor: str = "2013-09-01 00:00:00") -> Column:
    """Seconds offset + anchor -> UTC timestamp."""
    base = F.unix_timestamp(F.lit(anchor))
    return F.timestamp_seconds(base + _c(offset_s))


def night_flag(ts, hours: Sequence[int] = ENRICH_NIGHT_HOURS) -> Column:
    return F.hour(_c(ts)).isin(list(hours))


def weekend_flag(ts) -> Column:
    return F.weekday(_c(ts)).isin(5, 6)


def country_mismatch(a, b, null_safe: bool = False) -> Column:
    """Plain ``a != b``; the rule variant fires only when both are present."""
    if null_safe:
        return F.coalesce((_c(a) != _c(b)) & _c(a).isNotNull() & _c(b).isNotNull(), F.lit(False))
    return _c(a) != _c(b)


def rule_reason_codes(country="country", ip_country="ip_country", currency="currency",
                      card_currency="card_currency", hour="hour", amount="amount",
                      velocity_1h="velocity_1h", velocity_24h="velocity_24h",
                      is_proxy_vpn="is_proxy_vpn", is_new_device="is_new_device",
                      risky: Sequence[str] = RISKY_IP_COUNTRIES,
                      amount_high: float = RULE_HIGH_AMOUNT) -> Column:
    """Ordered list of rule reason codes; unparsable numbers are ignored."""
    def present(x):
        return _c(x).isNotNull() & (_c(x).cast("string") != "")
    hr = _c(hour).try_cast("int") if hasattr(Column, "try_cast") else _c(hour).cast("int")
    amt = _c(amount).try_cast("double") if hasattr(Column, "try_cast") else _c(amount).cast("double")
    v1 = F.coalesce(_c(velocity_1h).try_cast("int"), F.lit(0))
    v24 = F.coalesce(_c(velocity_24h).try_cast("int"), F.lit(0))
    codes = [
        F.when(present(country) & present(ip_country)
               & (_c(country).cast("string") != _c(ip_country).cast("string")), F.lit("geo_mismatch")),
        F.when(present(currency) & present(card_currency)
               & (_c(currency).cast("string") != _c(card_currency).cast("string")),
               F.lit("currency_mismatch")),
        F.when(hr.isin(*RULE_NIGHT_HOURS), F.lit("night_txn")),
        F.when(amt >= F.lit(amount_high), F.lit("high_amount")),
        F.when(v1 >= RULE_VELOCITY_1H, F.lit("high_velocity_1h")),
        F.when(v24 >= RULE_VELOCITY_24H, F.lit("high_velocity_24h")),
        F.when(_c(is_proxy_vpn) == F.lit(True), F.lit("proxy_vpn")),
        F.when(_c(is_new_device) == F.lit(True), F.lit("new_device")),
        F.when(present(ip_country) & _c(ip_country).cast("string").isin(list(risky)),
               F.lit("risky_ip_country")),
    ]
    return F.array_compact(F.array(*codes))


# Rule weights (unknown codes weigh 1) and cut-offs.
RULE_WEIGHTS = {"geo_mismatch": 2, "currency_mismatch": 1, "night_txn": 1, "high_amount": 1,
                "high_velocity_1h": 2, "high_velocity_24h": 2, "proxy_vpn": 2, "new_device": 1,
                "risky_ip_country": 2}
RULE_BLOCK_SCORE = 6
RULE_REVIEW_SCORE = 3


def rule_score(codes) -> Column:
    weights = F.create_map(*[x for k, v in RULE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    return F.aggregate(_c(codes), F.lit(0),
                       lambda acc, c: acc + F.coalesce(F.element_at(weights, c), F.lit(1)))


# Checkout heuristics.
CHECKOUT_NEW_ACCOUNT_DAYS = 30
CHECKOUT_HIGH_VALUE = 300.0
CHECKOUT_EXPRESS_VALUE = 250.0
CHECKOUT_ODD_HOUR_BEFORE = 5
CHECKOUT_MAX_ATTEMPTS = 3
CHECKOUT_HOME_COUNTRY = "GB"
CHECKOUT_FAST_SHIPPING = ["Express", "Next-Day"]


def checkout_flags(account_age_days="account_age_days", amount="amount",
                   shipping_country="shipping_country", avs_result="avs_result",
                   cvv_result="cvv_result", hour="hour", attempts_today="attempts_today",
                   is_guest="is_guest", is_new_device="is_new_device",
                   shipping_method="shipping_method", card_country="card_country",
                   home_country: str = CHECKOUT_HOME_COUNTRY) -> list[Column]:
    """Nine checkout heuristics as boolean columns."""
    return [
        ((_c(account_age_days) < CHECKOUT_NEW_ACCOUNT_DAYS) & (_c(amount) > CHECKOUT_HIGH_VALUE))
        .alias("flag_new_high_value_acc"),
        (_c(shipping_country) != F.lit(home_country)).alias("flag_address_mismatch"),
        F.coalesce(_c(avs_result) == "N", F.lit(False)).alias("flag_avs_failed"),
        F.coalesce(_c(cvv_result) == "N", F.lit(False)).alias("flag_cvv_failed"),
        (_c(hour) < CHECKOUT_ODD_HOUR_BEFORE).alias("flag_odd_hour"),
        (_c(attempts_today) > CHECKOUT_MAX_ATTEMPTS).alias("flag_rapid_retries"),
        (_c(is_guest) & _c(is_new_device)).alias("flag_guest_new_device"),
        ((_c(amount) > CHECKOUT_EXPRESS_VALUE) & _c(shipping_method).isin(CHECKOUT_FAST_SHIPPING))
        .alias("flag_express_high_value"),
        (_c(card_country) != F.lit(home_country)).alias("flag_geo_mismatch"),
    ]


def payload_hash(m) -> Column:
    """SHA-256 over the key-sorted ``key=value`` entries of a map column.

    Key order of the input never matters; values enter with all their digits
    (pass decimals or strings where engines must print them alike).
    """
    entries = F.array_sort(F.map_entries(_c(m)))
    txt = F.transform(entries, lambda e: F.concat(
        e["key"], F.lit("="), F.coalesce(e["value"].cast("string"), F.lit("null"))))
    return F.sha2(F.array_join(txt, "|"), 256)


def review_id(h) -> Column:
    return F.concat(F.lit("rev_"), F.substring(_c(h), 1, 16))


def normalize_model_version(v) -> Column:
    s = strip_space(F.coalesce(_c(v).cast("string"), F.lit("")))
    cleaned = F.regexp_replace(F.regexp_replace(s, VERSION_UNSAFE_PATTERN, "-"), r"^-+|-+$", "")
    return (F.when(s == "", F.lit("v1"))
            .when(F.lower(s).isin(VERSION_UNKNOWN_WORDS), F.lit("v1"))
            .when(s.rlike(ISO_TS_PATTERN), F.lit("v1"))
            .when(cleaned == "", F.lit("v1"))
            .otherwise(cleaned))


def valid_model_version(v) -> Column:
    return (_c(v) == "v1") | _c(v).startswith("xgb-")


# Category sets and keywords of the demo-payload evaluation.
CATEGORY_APPROVE = ["approve", "safe"]
CATEGORY_BLOCK = ["block_fraud", "risky"]
CATEGORY_REVIEW = ["gray", "review_legit", "review"]


def canonical_decision(category) -> Column:
    c = F.lower(F.coalesce(_c(category).cast("string"), F.lit("none")))
    return (F.when(c.isin(CATEGORY_APPROVE), "APPROVE")
            .when(c.isin(CATEGORY_BLOCK), "BLOCK")
            .when(c.isin(CATEGORY_REVIEW), "REVIEW")
            .when(c.contains("block") | c.contains("fraud"), "BLOCK")
            .when(c.contains("approve") | c.contains("safe"), "APPROVE")
            .otherwise("REVIEW"))


def outcome_label(x) -> Column:
    u = F.upper(strip_space(_c(x)))
    return F.when(u == "BLOCK", 1).when(u == "APPROVE", 0)


CHECKOUT_KEYS = ["amount", "country", "ip_country", "currency", "card_currency"]


def payload_kind(m) -> Column:
    """``processed`` when some key is ``num__*``/``cat__*`` and no checkout
    key is present, else ``checkout``."""
    keys = F.map_keys(_c(m))
    has_proc = F.exists(keys, lambda k: k.startswith("num__") | k.startswith("cat__"))
    has_checkout = F.exists(keys, lambda k: k.isin(CHECKOUT_KEYS))
    return F.when(has_proc & ~has_checkout, "processed").otherwise("checkout")


def active_flags(m, limit: int = 25) -> Column:
    """``cat__*`` keys whose value is true/1, in map order, first 25."""
    on = F.map_filter(_c(m), lambda k, v: k.startswith("cat__") & (v == F.lit(1.0)))
    return F.slice(F.map_keys(on), 1, limit)


def null_display_defaults(score="score_xgb", bucket="ae_bucket", pct="ae_percentile_vs_legit") -> list[Column]:
    return [F.coalesce(_c(score), F.lit(0.5)).alias(score if isinstance(score, str) else "score"),
            F.coalesce(_c(bucket), F.lit("unknown")).alias(bucket if isinstance(bucket, str) else "bucket"),
            F.coalesce(_c(pct), F.lit(0.0)).alias(pct if isinstance(pct, str) else "pct")]


def onehot_override(m, prefix: str, chosen: str) -> Column:
    return F.transform_values(_c(m), lambda k, v: F.when(
        k.startswith(prefix), F.when(k == F.lit(chosen), F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(v))


def clip_boost(base, boost, flag, digits: int = 3) -> Column:
    v = _c(base) + _c(boost) * _c(flag).cast("double")
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), digits)


def minmax_scale(x, lo, hi, constant_value: float = 0.0) -> Column:
    return F.when(_c(hi) > _c(lo), (_c(x) - _c(lo)) / (_c(hi) - _c(lo))).otherwise(F.lit(constant_value))


def numeric_coerce(x, default: float | None = 0.0) -> Column:
    v = _c(x).cast("string").try_cast("double")
    return F.coalesce(v, F.lit(default)) if default is not None else v


def coalesce_truthy(*cols) -> Column:
    """First non-blank of several text aliases (python ``a or b or c``)."""
    return F.coalesce(*[F.nullif(strip_space(_c(c).cast("string")), F.lit("")) for c in cols])


# Display names of model features and label prefixes.
FRIENDLY_NAMES = {
    "num__txn_count_5m": "Txn count (5 min)",
    "num__txn_count_30m": "Txn count (30 min)",
    "num__txn_count_60m": "Txn count (60 min)",
    "num__Amount": "Transaction amount",
    "num__amount_zscore": "Amount z-score",
    "num__avg_amount_7d": "Avg amount (7 day)",
    "num__avg_spend_user_30d": "Avg spend (30 day)",
    "num__geo_distance_km": "Geo distance (km)",
    "num__ip_reputation": "IP reputation score",
    "num__account_age_days": "Account age (days)",
    "num__token_age_days": "Token age (days)",
    "cat__is_proxy_vpn_True": "VPN / Proxy = True",
    "cat__is_proxy_vpn_False": "VPN / Proxy = False",
    "cat__is_new_device_True": "New device = True",
    "cat__is_new_device_False": "New device = False",
    "cat__country_mismatch_True": "Country mismatch",
    "cat__night_txn_True": "Night transaction",
    "cat__weekend_txn_True": "Weekend transaction",
}
FRIENDLY_PREFIXES = [("cat__device_os_", "Device: "), ("cat__browser_", "Browser: "),
                     ("cat__ip_country_", "IP country: "), ("cat__billing_country_", "Billing: "),
                     ("cat__shipping_country_", "Shipping: ")]


def friendly_feature_name(name) -> Column:
    """Feature id -> display label: dictionary, ``num__V*`` upper-cased
    without prefix, known one-hot prefixes, else unchanged."""
    n = _c(name)
    names = F.create_map(*[F.lit(x) for kv in FRIENDLY_NAMES.items() for x in kv])
    out = F.when(F.element_at(names, n).isNotNull(), F.element_at(names, n)) \
        .when(n.startswith("num__V"), F.upper(F.regexp_replace(n, "^num__", "")))
    for prefix, label in FRIENDLY_PREFIXES:
        out = out.when(n.startswith(prefix), F.concat(F.lit(label), F.substring(n, len(prefix) + 1, 1 << 20)))
    return out.otherwise(n)
