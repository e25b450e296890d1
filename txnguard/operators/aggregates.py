"""Aggregations over transaction / decision / request tables.

Every aggregate is a ``groupBy`` with partial (map-side) aggregation; wide
column sets are unpivoted with ``stack`` so many features share one
shuffle.  Exact quantiles go through ``txnguard.plans.scale`` (distributed
ranks) instead of one-task percentile buffers.  Shares of a grand total
use ``sum() over ()`` only on already-aggregated results whose size is
bounded by the grouping domain (classes, decisions, bins).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnguard.plans.scale import between, exact_quantiles, quantile_bounds


def r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def _total():
    return Window.partitionBy()


def unpivot(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), name: str = "feature",
            value: str = "value", cast: str = "double") -> DataFrame:
    """Wide -> long with ``stack`` (one row per column per input row)."""
    parts = ", ".join(f"'{c}', CAST(`{c}` AS {cast})" for c in cols)
    return df.selectExpr(*[f"`{k}`" for k in keep], f"stack({len(cols)}, {parts}) AS (`{name}`, `{value}`)")


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    agg = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return agg.withColumn("share", r6(F.col("n") / F.sum("n").over(_total())))


def label_stats(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(label) == 0).alias("legit"),
                  F.count_if(F.col(label) == 1).alias("fraud"),
                  r6(F.avg(F.col(label).cast("double"))).alias("fraud_rate"))


def signal_by_class(df: DataFrame, label: str, signals: Sequence[str]) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"),
                                 *[r6(F.avg(F.col(s).cast("double"))).alias(f"mean_{s}") for s in signals])


def flag_rates_by_class(df: DataFrame, label: str, flags: Sequence[str]) -> DataFrame:
    long = unpivot(df, flags, keep=[label], name="flag", value="v")
    return long.groupBy("flag", label).agg(r6(F.avg("v")).alias("rate"))


def fraud_rate_by_hour(df: DataFrame, time_s: str, label: str) -> DataFrame:
    hour = (F.pmod(F.col(time_s), F.lit(86400)) - F.pmod(F.col(time_s), F.lit(3600))) / 3600
    return df.groupBy(hour.cast("long").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(F.col(label).cast("double")) * 100).alias("fraud_rate_pct"))


def volume_by_day(df: DataFrame, time_s: str) -> DataFrame:
    day = ((F.col(time_s) - F.pmod(F.col(time_s), F.lit(86400))) / 86400).cast("long")
    return df.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count/mean/std(sample)/min/quartiles/max per numeric column (long form),
    all from one shuffle of counts per distinct value."""
    long = unpivot(df, cols, name="feature", value="v").where(F.col("v").isNotNull())
    counts = long.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("c")).persist(StorageLevel.DISK_ONLY)
    v, c = F.col("v").cast("double"), F.col("c")
    base = counts.groupBy("feature").agg(F.sum("c").alias("count"), (F.sum(v * c) / F.sum("c")).alias("__mu"), F.min("v").alias("min"), F.max("v").alias("max"))
    d = v - F.col("__mu")
    spread = counts.join(base, "feature").groupBy("feature").agg(F.sum(d * d * c).alias("__ss"))
    q = quantile_bounds(counts, ["feature"], "v", "c", [0.25, 0.5, 0.75])
    q = q.withColumn("q", between(F.col("lo"), F.col("hi"), F.col("frac"))).groupBy("feature").agg(
        *[r6(F.max(F.when(F.col("p") == p, F.col("q")))).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    std = F.when(F.col("count") > 1, F.sqrt(F.col("__ss") / (F.col("count") - 1)))
    out = base.join(spread, "feature").join(q, "feature", "left").select(
        "feature", "count", r6(F.col("__mu")).alias("mean"), r6(std).alias("std"), r6(F.col("min")).alias("min"), r6(F.col("max")).alias("max"), "q25", "q50", "q75")
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")  # columns without a value have count 0
    return names.join(out, "feature", "left").fillna(0, ["count"])


def error_summary(df: DataFrame, err: str, group: str) -> DataFrame:
    base = df.groupBy(group).agg(
        F.count(err).alias("count"), r6(F.avg(err)).alias("mean"), r6(F.stddev_pop(err)).alias("std"),
        r6(F.min(err)).alias("min"), r6(F.max(err)).alias("max"))
    probs = ((0.5, "median"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"))
    q = exact_quantiles(df, err, [p for p, _ in probs], [group]).groupBy(group).agg(
        *[r6(F.max(F.when(F.col("p") == p, F.col("q")))).alias(n) for p, n in probs])
    return base.join(q, group, "left")


def histogram(df: DataFrame, col: Column | str, bins: int = 10, group: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between min and max (last bin closed); with ``group``
    the edges are shared by all groups."""
    x = F.col(col) if isinstance(col, str) else col
    vals = df.select(*group, x.alias("__x")).where(F.col("__x").isNotNull())
    mm = vals.agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    w = (F.col("__hi") - F.col("__lo")) / bins
    b = F.when(F.col("__hi") == F.col("__lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("__x") - F.col("__lo")) / w), F.lit(bins - 1))).cast("int")
    binned = vals.crossJoin(F.broadcast(mm)).select(*group, b.alias("bin"), "__lo", "__hi")
    return binned.groupBy(*group, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.first("__lo") + F.col("bin") * (F.first("__hi") - F.first("__lo")) / bins).alias("edge_lo"))


def top_categories(df: DataFrame, cols: Sequence[str], k: int = 10) -> DataFrame:
    long = unpivot(df, cols, name="column", value="value", cast="string")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    from txnguard.plans.scale import top_k_per_group
    return top_k_per_group(counts, ["column"], [F.col("n").desc(), F.col("value")], k, tie_col="value")


def label_correlation(df: DataFrame, cols: Sequence[str], label: str, k: int = 10) -> DataFrame:
    agg = df.agg(*[F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in cols])
    long = unpivot(agg, cols, name="feature", value="corr")
    w = Window.orderBy(F.col("abs_corr").desc_nulls_last(), F.col("feature"))
    return (long.select("feature", F.round(F.abs("corr"), 4).alias("abs_corr"))
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, one aggregate pass (long form)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    agg = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    long = unpivot(agg, [f"{a}|{b}" for a, b in pairs], name="pair", value="corr")
    parts = F.split("pair", r"\|")
    half = long.select(parts[0].alias("a"), parts[1].alias("b"), r6(F.col("corr")).alias("corr"))
    return half.unionByName(half.where(F.col("a") != F.col("b")).select(
        F.col("b").alias("a"), F.col("a").alias("b"), "corr"))


def active_flag_prevalence(df: DataFrame, flags: Sequence[str], k: int = 30) -> DataFrame:
    agg = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in flags])
    long = unpivot(agg, flags, name="flag", value="prevalence")
    w = Window.orderBy(F.col("prevalence").desc(), F.col("flag"))
    return (long.select("flag", r6(F.col("prevalence")).alias("prevalence"))
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))


def corr_top_flags(df: DataFrame, numeric: Sequence[str], flags: Sequence[str], label: str,
                   n_flags: int = 200, k: int = 25) -> DataFrame:
    """|corr| with the label over numerics + the most frequent flags, top k.
    Step 1 ranks flags by mean (one aggregate), step 2 correlates."""
    prev = active_flag_prevalence(df, flags, n_flags)
    chosen = [r["flag"] for r in prev.select("flag").collect()]  # bounded by n_flags (schema list)
    return label_correlation(df, list(numeric) + chosen, label, k)


def triage_rates(df: DataFrame, decision: str = "decision") -> DataFrame:
    agg = df.groupBy(decision).agg(F.count(F.lit(1)).alias("n"))
    return agg.withColumn("rate", r6(F.col("n") / F.sum("n").over(_total())))


def triage_fraud_capture(df: DataFrame, decision: str = "decision", label: str = "label") -> DataFrame:
    y = F.col(label) == 1
    d = F.col(decision)
    a = df.agg(F.count_if(y).alias("n_fraud"),
               F.count_if(y & (d == "APPROVE")).alias("fraud_approve"),
               F.count_if(y & (d == "REVIEW")).alias("fraud_review"),
               F.count_if(y & (d == "BLOCK")).alias("fraud_block"))
    return a.select("*",
                    r6(F.when(F.col("n_fraud") > 0, (F.col("fraud_review") + F.col("fraud_block"))
                              / F.col("n_fraud")).otherwise(0.0)).alias("capture_flagged"),
                    r6(F.when(F.col("n_fraud") > 0, F.col("fraud_block") / F.col("n_fraud"))
                       .otherwise(0.0)).alias("capture_block"))


def decision_crosstab(df: DataFrame, decision: str = "decision", label: str = "label") -> DataFrame:
    """Decision x label counts with the row share (percent, 2 digits)."""
    c = df.groupBy(decision, label).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("row_pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(decision)), 2)
                        + F.lit(0.0))


def decision_flow(df: DataFrame, p: str, t_low: float, t_high: float) -> DataFrame:
    pc = F.col(p)
    return df.agg(r6(F.avg((pc < t_low).cast("double"))).alias("approve_share"),
                  r6(F.avg(((pc >= t_low) & (pc < t_high)).cast("double"))).alias("review_share"),
                  r6(F.avg((pc >= t_high).cast("double"))).alias("block_share"))


def model_health(df: DataFrame, p: str = "score_xgb", bucket: str = "ae_bucket",
                 decision: str = "decision", final: str = "analyst_decision",
                 t_low: float = 0.05, t_high: float = 0.80) -> DataFrame:
    pc = F.col(p)

    def share(cond):
        return r6(F.avg(F.coalesce(cond, F.lit(False)).cast("double")))
    return df.agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(pc)).alias("mean_p"),
        share((pc >= t_low) & (pc < t_high)).alias("gray_zone_share"),
        share(pc >= t_high).alias("high_risk_share"),
        share(F.col(bucket) == "normal").alias("bucket_normal"),
        share(F.col(bucket) == "elevated").alias("bucket_elevated"),
        share(F.col(bucket) == "extreme").alias("bucket_extreme"),
        share(F.col(decision) != "REVIEW").alias("automation_rate"),
        share(F.col(final) == "APPROVE").alias("analyst_approve_rate"),
        share(F.col(final) == "BLOCK").alias("analyst_block_rate"))


def zone_counts(df: DataFrame, err: str, review: Column, block: Column) -> DataFrame:
    e = F.col(err)
    a = df.agg(F.count(e).alias("n"), F.count_if(e < review).alias("below_review"),
               F.count_if((e >= review) & (e < block)).alias("between"),
               F.count_if(e >= block).alias("over_block"))
    return a.select("*", *[r6(F.when(F.col("n") > 0, F.col(c) * 100.0 / F.col("n")).otherwise(0.0)).alias(f"pct_{c}")
                          for c in ("below_review", "between", "over_block")])


def latency_percentiles(df: DataFrame, latency: str, ok: str) -> DataFrame:
    """min/p50/p90/p99/max/mean for all requests and for OK ones; zeros if empty."""
    probs = ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))
    both = df.select(F.lit("all").alias("scope"), latency).unionByName(
        df.where(F.col(ok)).select(F.lit("ok").alias("scope"), latency))
    base = both.groupBy("scope").agg(F.count(latency).alias("n"), r6(F.min(latency)).alias("min"),
                                     r6(F.max(latency)).alias("max"), r6(F.avg(latency)).alias("mean"))
    q = exact_quantiles(both, latency, [p for p, _ in probs], ["scope"]).groupBy("scope").agg(
        *[r6(F.max(F.when(F.col("p") == p, F.col("q")))).alias(n) for p, n in probs])
    scopes = df.sparkSession.createDataFrame([("all",), ("ok",)], "scope string")
    out = scopes.join(base, "scope", "left").join(q, "scope", "left")
    return out.fillna(0, ["n"]).fillna(0.0, ["min", "max", "mean", "p50", "p90", "p99"])


def status_buckets(df: DataFrame, status: str, ts: str) -> DataFrame:
    s = F.col(status)
    a = df.agg(F.count(F.lit(1)).alias("n"),
               F.count_if(s.between(200, 299)).alias("n_2xx"), F.count_if(s.between(400, 499)).alias("n_4xx"),
               F.count_if(s.between(500, 599)).alias("n_5xx"),
               F.count_if(s.isNotNull() & ~s.between(200, 299) & ~s.between(400, 599)).alias("n_other"),
               F.count_if(s.isNull()).alias("n_exceptions"),
               F.min(F.unix_micros(F.col(ts).cast("timestamp"))).alias("__t0"),
               F.max(F.unix_micros(F.col(ts).cast("timestamp"))).alias("__t1"))
    errs = F.col("n") - F.col("n_2xx")
    secs = (F.col("__t1") - F.col("__t0")) / 1e6
    return a.select("n", "n_2xx", "n_4xx", "n_5xx", "n_other", "n_exceptions",
                    r6(F.when(F.col("n") > 0, errs / F.col("n")).otherwise(0.0)).alias("error_rate"),
                    r6(F.when(secs > 0, F.col("n") / secs).otherwise(0.0)).alias("throughput_rps"))


def quantile_exclusive(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """99 cut points of ``statistics.quantiles(n=100)`` (exclusive method)."""
    return exact_quantiles(df, value, [i / 100 for i in range(1, 100)], group, method="exclusive")


def run_health(df: DataFrame, run: str, fail_rate: Column, p95: Column, failures: DataFrame | None = None,
               max_fail: float = 0.01, max_p95: float = 2000.0) -> DataFrame:
    degraded = (fail_rate > max_fail) | (p95 > max_p95)
    notes = F.array_compact(F.array(
        F.when(fail_rate > max_fail, F.lit("failure_rate_above_1pct")),
        F.when(p95 > max_p95, F.lit(f"p95_above_{max_p95:g}ms"))))
    return df.select(run, F.when(degraded, "degraded").otherwise("healthy").alias("status"),
                     F.array_join(notes, ";").alias("notes"))


def model_version_outcomes(df: DataFrame, version: str = "model_version", decision: str = "decision") -> DataFrame:
    return df.groupBy(version, decision).agg(F.count(F.lit(1)).alias("n"))


def segment_metrics(df: DataFrame, segment: str, label: str, pred: str) -> DataFrame:
    """Confusion counts and P/R/F1 per segment plus a grand total (rollup)."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    a = df.rollup(segment).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                               F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    return a.select(F.coalesce(F.col(segment).cast("string"), F.lit("ALL")).alias(segment),
                    "tp", "fp", "fn", "tn", *prf_cols())


def prf_cols(tp="tp", fp="fp", fn="fn") -> list[Column]:
    tp_, fp_, fn_ = F.col(tp), F.col(fp), F.col(fn)
    prec = F.when(tp_ + fp_ > 0, tp_ / (tp_ + fp_)).otherwise(0.0)
    rec = F.when(tp_ + fn_ > 0, tp_ / (tp_ + fn_)).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    return [r6(prec).alias("precision"), r6(rec).alias("recall"), r6(f1).alias("f1")]


def confusion_multiclass(df: DataFrame, true: str, pred: str) -> DataFrame:
    """true x predicted counts plus exact-match accuracy on every row."""
    c = df.groupBy(true, pred).agg(F.count(F.lit(1)).alias("n"))
    acc = F.sum(F.when(F.col(true) == F.col(pred), F.col("n")).otherwise(0)).over(_total()) / \
        F.sum("n").over(_total())
    return c.withColumn("accuracy", r6(acc))


def distinct_count(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    f = F.approx_count_distinct(col) if approx else F.count_distinct(col)
    return df.agg(f.alias(f"n_distinct_{col}"))


def quartiles_by_class(df: DataFrame, value: str, label: str) -> DataFrame:
    probs = ((0.0, "min"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "max"))
    q = exact_quantiles(df, value, [p for p, _ in probs], [label]).groupBy(label).agg(
        *[r6(F.max(F.when(F.col("p") == p, F.col("q")))).alias(n) for p, n in probs])
    m = df.groupBy(label).agg(r6(F.avg(value)).alias("mean"), F.count(value).alias("n"))
    return q.join(m, label)


def histogram_by_class(df: DataFrame, label: str, signals: Sequence[str], bins: int = 20) -> DataFrame:
    """Per-class histograms of several signals with edges shared per signal."""
    long = unpivot(df, signals, keep=[label], name="feature", value="v").where(F.col("v").isNotNull())
    mm = long.groupBy("feature").agg(F.min("v").alias("__lo"), F.max("v").alias("__hi"))
    w = (F.col("__hi") - F.col("__lo")) / bins
    b = F.when(F.col("__hi") == F.col("__lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("v") - F.col("__lo")) / w), F.lit(bins - 1))).cast("int")
    # one row per signal -> broadcast (bounded by the signal list)
    return (long.join(F.broadcast(mm), "feature").select("feature", label, b.alias("bin"))
            .groupBy("feature", label, "bin").agg(F.count(F.lit(1)).alias("n")))


def throughput_over_time(df: DataFrame, run: str, ts: str, latency: str, window: str = "1 minute") -> DataFrame:
    """Per run and time window: seconds since run start, requests/s, p95 latency."""
    tsc = F.col(ts).cast("timestamp")
    wdf = df.select(run, F.window(tsc, window).alias("w"), F.col(latency).alias("lat"))
    wdf = wdf.select(run, F.col("w.start").alias("window_start"), "lat")
    base = wdf.groupBy(run, "window_start").agg(F.count(F.lit(1)).alias("n"))
    start = df.groupBy(run).agg(F.min(tsc).alias("__s"))
    secs = F.unix_seconds(F.col("window_start")) - F.unix_seconds(F.col("__s"))
    q = exact_quantiles(wdf.withColumn("__k", F.concat_ws("|", F.col(run).cast("string"),
                                                          F.col("window_start").cast("string"))),
                        "lat", [0.95], ["__k"])
    out = base.join(start, run).withColumn("__k", F.concat_ws("|", F.col(run).cast("string"),
                                                            F.col("window_start").cast("string")))
    return (out.join(q, "__k", "left")
            .select(run, "window_start", F.greatest(secs, F.lit(0)).alias("seconds_since_start"), "n",
                    r6(F.col("n") / F.lit(_window_seconds(window))).alias("rps"), r6(F.col("q")).alias("p95")))


def _window_seconds(window: str) -> float:
    n, unit = window.split()
    mult = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600}[unit]
    return float(n) * mult
