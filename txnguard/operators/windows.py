"""Per-device window features (velocity, rolling means, z-scores, splits).

All device windows share ``PARTITION BY device ORDER BY t, txn_id``; build
the columns in one ``select`` so Spark needs a single shuffle on the device
key and a single sort.  A device holding a third of all rows still lands in
one task for an ordered window (the semantics need its full history); the
frames here are bounded (rows/range), so that task streams the sorted rows
through a fixed-size buffer and spills instead of materialising the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnguard.plans.prefix import prefix_sums, previous, range_sums
from txnguard.plans.scale import global_row_number

# Velocity window lengths in (compressed) seconds.
VELOCITY_WINDOWS = {"txn_count_5m": 5 * 60, "txn_count_30m": 30 * 60, "txn_count_60m": 60 * 60}


def _w(device: str, t: str, tie: str):
    return Window.partitionBy(device).orderBy(F.col(t), F.col(tie))


def velocity_inclusive_cols(device: str = "device_id", t: str = "t", tie: str = "txn_id",
                            windows: dict | None = None) -> list[Column]:
    """Rows of the device with ``t' >= t - s`` up to and including this row in
    (t, tie) order.  ``row_number - count(t' <= t - s - 1)``: a plain RANGE
    frame would also count later rows with the same time."""
    windows = windows or VELOCITY_WINDOWS
    rn = F.row_number().over(_w(device, t, tie))
    out = []
    for name, s in windows.items():
        older = F.count(F.lit(1)).over(Window.partitionBy(device).orderBy(F.col(t))
                                       .rangeBetween(Window.unboundedPreceding, -(s + 1)))
        out.append((rn - older).cast("long").alias(name))
    return out


def velocity_prior_cols(device: str = "device_id", t: str = "t",
                        windows: dict | None = None) -> list[Column]:
    """Strictly earlier rows within ``[t - s, t)`` (older notebook variant)."""
    windows = windows or VELOCITY_WINDOWS
    return [F.count(F.lit(1)).over(Window.partitionBy(device).orderBy(F.col(t))
                                   .rangeBetween(-s, -1)).cast("long").alias(name + "_prior")
            for name, s in windows.items()]


def half_even_ratio(num: Column, den: Column) -> Column:
    """Integer ``num / den`` rounded half-to-even, exactly (longs only)."""
    q = ((num - F.pmod(num, den)) / den).cast("long")
    r = num - q * den
    up = (F.lit(2) * r > den) | ((F.lit(2) * r == den) & (F.pmod(q, F.lit(2)) == 1))
    return q + F.when(up, 1).otherwise(0)


def cents(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c * 100).cast("long")


def rolling_mean_rows(col: str = "amount", n: int = 50, device: str = "device_id", t: str = "t",
                      tie: str = "txn_id", out: str = "avg_amount_50") -> Column:
    """Mean over the last ``n`` rows incl. the current one, rounded to cents.

    The mean of a money column is formed exactly from integer cents and
    rounded half-to-even, so every engine and every partitioning agrees."""
    w = _w(device, t, tie).rowsBetween(-(n - 1), Window.currentRow)
    return (half_even_ratio(F.sum(cents(col)).over(w), F.count(col).over(w)) / 100.0).alias(out)


def rolling_mean_range(col: str = "amount", seconds: int = 7 * 86400, device: str = "device_id",
                       t: str = "t", out: str = "avg_amount_7d") -> Column:
    w = Window.partitionBy(device).orderBy(F.col(t)).rangeBetween(-seconds, Window.currentRow)
    return (half_even_ratio(F.sum(cents(col)).over(w), F.count(col).over(w)) / 100.0).alias(out)


def zscore_device(col: str = "amount", device: str = "device_id", out: str = "amount_zscore") -> Column:
    """Whole-history z-score per device, population std, rounded to 3."""
    w = Window.partitionBy(device)
    z = (F.col(col) - F.avg(col).over(w)) / (F.stddev_pop(col).over(w) + F.lit(1e-9))
    return (F.bround(z, 3) + F.lit(0.0)).alias(out)


def zscore_pit(col: str = "amount", device: str = "device_id", t: str = "t", tie: str = "txn_id",
               out: str = "amount_zscore_pit") -> Column:
    """Point-in-time z-score against strictly earlier rows (null for the first)."""
    w = _w(device, t, tie).rowsBetween(Window.unboundedPreceding, -1)
    z = (F.col(col) - F.avg(col).over(w)) / (F.stddev_pop(col).over(w) + F.lit(1e-9))
    return (F.bround(z, 3) + F.lit(0.0)).alias(out)


def enrich(df: DataFrame, wanted: Sequence[str] | None = None, device: str = "device_id", t: str = "t", tie: str = "txn_id") -> DataFrame:
    """``df (device, t, unique tie, amount)`` with its device features: velocities,
    ``is_new_device``, ``amount_zscore`` and ``avg_amount_50``; all of them, or
    those that ``wanted`` names.  Each is built from the keys alone, so what is
    not wanted is neither planned nor read (hot-device safe)."""
    def need(*names: str) -> bool:
        return wanted is None or bool(set(names) & set(wanted))
    keys = df.select(device, t, tie, "amount")
    out = velocity_chunked(df, device, t, tie) if need(*VELOCITY_WINDOWS) else df
    if need("is_new_device", "amount_zscore"):
        stats = keys.groupBy(F.col(device).alias("__device")).agg(
            F.avg("amount").alias("__mu"), F.stddev_pop("amount").alias("__sd"),
            F.min(F.struct(F.col(t).alias("a"), F.col(tie).alias("b"))).alias("__first"))
        z = (F.col("amount") - F.col("__mu")) / (F.col("__sd") + F.lit(1e-9))
        new = (F.col(t) == F.col("__first.a")) & (F.col(tie) == F.col("__first.b"))
        out = out.join(stats, F.col(device).eqNullSafe(F.col("__device")), "left")
        out = out.withColumns({"amount_zscore": F.bround(z, 3) + F.lit(0.0), "is_new_device": new}).drop("__device", "__mu", "__sd", "__first")
    if need("avg_amount_50"):
        mean = rolling_mean_chunked(keys, device=device, t=t, tie=tie).select(F.col(tie).alias("__tie"), "avg_amount_50")
        out = out.join(mean, F.col(tie) == F.col("__tie"), "left").drop("__tie")
    return out


def time_order_violations(df: DataFrame, device: str, t: str, ingest: Sequence[str]) -> DataFrame:
    """Rows per device whose time is earlier than that of the row before it in
    ingest order, ``(whole number, unique tie)``; a hot device is split."""
    prev = previous(df.select(device, t, *ingest), [device], *ingest, t, "__prev", bucket=1)
    return prev.select(device, (F.col(t) < F.col("__prev")).alias("__v")).groupBy(device).agg(
        F.count_if("__v").alias("violations"))


def first_txn_flags(df: DataFrame, device: str = "device_id", t: str = "t", tie: str = "txn_id",
                    out: str = "is_first_txn") -> DataFrame:
    return new_device_flag(df, device, t, tie, out)


def global_monotonic(df: DataFrame, t: str, ingest: str) -> DataFrame:
    """Is ``t`` non-decreasing in ingest order?  Uses the distributed global
    row number, then compares each row with its successor through an
    equi-join on position (no single-partition lag)."""
    rn = global_row_number(df.select(ingest, t), [ingest], "__rn")
    nxt = rn.select((F.col("__rn") - 1).alias("__rn"), F.col(t).alias("__t_next"))
    j = rn.join(nxt, "__rn")
    return j.agg(F.coalesce(F.bool_and(F.col(t) <= F.col("__t_next")), F.lit(True))
                 .alias("is_monotonic"), F.count_if(F.col(t) > F.col("__t_next")).alias("n_decreases"))


def time_split(df: DataFrame, order_cols: Sequence[str], fractions=(0.70, 0.85),
               out: str = "split") -> DataFrame:
    """Rows ``[0, floor(.70 n))`` train, ``[.., floor(.85 n))`` val, rest test
    in the total order ``order_cols`` (end with a unique key)."""
    rn = global_row_number(df, order_cols, "__rn")
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    a, b = fractions
    pos = F.col("__rn") - 1
    split = (F.when(pos < F.floor(F.col("__n") * a), "train")
             .when(pos < F.floor(F.col("__n") * b), "val").otherwise("test"))
    return rn.crossJoin(F.broadcast(n)).withColumn(out, split).drop("__n")


def latest_per_key(df: DataFrame, key: str, order_desc: Sequence[str]) -> DataFrame:
    """Latest row per key (largest ``order_desc`` tuple), skew-safe max_by."""
    from txnguard.plans.scale import first_per_key
    return first_per_key(df, [key], order_desc, latest=True)


def new_device_flag(df: DataFrame, token: str, t: str, tie: str, out: str = "is_new_device") -> DataFrame:
    """First sighting of a token: the (t, tie) minimum per token, found by a
    partial aggregate and joined back (no per-token window task)."""
    first = df.groupBy(token).agg(F.min(F.struct(F.col(t).alias("a"), F.col(tie).alias("b"))).alias("__first"))
    j = df.join(first, token)
    return j.withColumn(out, (F.col(t) == F.col("__first.a")) & (F.col(tie) == F.col("__first.b"))).drop("__first")


def attempts_today(df: DataFrame, account: str, ts: str, tie: str, threshold: int = 3) -> DataFrame:
    """Trailing attempts of the account on the same UTC day, rapid retry if > 3."""
    x = df.withColumns({"__day": F.to_date(ts), "__us": F.unix_micros(F.col(ts).cast("timestamp"))})
    x = prefix_sums(x, [account, "__day"], "__us", tie, {"attempts_today": F.lit(1).cast("long")}, bucket=3_600_000_000)
    cnt = F.col("attempts_today") + 1
    return x.drop("__day", "__us").withColumn("attempts_today", cnt).withColumn("rapid_retry", F.col("attempts_today") > threshold)


# ---------------------------------------------------------------- hot-device safe variants
def _with_halo(df: DataFrame, chunk: Column, in_halo: Column, need: Sequence[str]) -> DataFrame:
    """Rows with their chunk, plus copies of the columns ``need`` of ``in_halo``
    rows assigned to the next chunk (flagged ``__halo``) so every chunk sees
    what its frames need."""
    base = df.withColumn("__chunk", chunk).withColumn("__halo", F.lit(False))
    halo = df.select(*need).where(in_halo).withColumn("__chunk", chunk + 1).withColumn("__halo", F.lit(True))
    return base.unionByName(halo, allowMissingColumns=True)


def velocity_chunked(df: DataFrame, device: str = "device_id", t: str = "t", tie: str = "txn_id",
                     windows: dict | None = None, chunk_len: int | None = None) -> DataFrame:
    """Inclusive trailing counts, exact, with each device's timeline cut into
    chunks of ``chunk_len`` time units (>= longest window + 1).  A chunk also
    receives the previous chunk's last ``s_max`` units as halo rows, so its
    RANGE frames are complete; a device holding a third of all rows is
    spread over as many tasks as it has chunks.

    count = rows in [t - s, t] minus the later peers of the row at time t."""
    windows = windows or VELOCITY_WINDOWS
    smax = max(windows.values())
    c_len = max(chunk_len or 4 * smax, smax + 1)
    tc = F.col(t)
    chunk = ((tc - F.pmod(tc, F.lit(c_len))) / c_len).cast("long")
    in_halo = F.pmod(tc, F.lit(c_len)) >= c_len - smax
    x = _with_halo(df, chunk, in_halo, [device, t, tie])
    part = [device, "__chunk"]
    peers = F.count(F.lit(1)).over(Window.partitionBy(*part).orderBy(tc).rangeBetween(0, 0))
    pos_in_peers = (F.row_number().over(Window.partitionBy(*part).orderBy(tc, F.col(tie)))
                    - F.rank().over(Window.partitionBy(*part).orderBy(tc)) + 1)
    later_peers = peers - pos_in_peers
    cols = [(F.count(F.lit(1)).over(Window.partitionBy(*part).orderBy(tc).rangeBetween(-s, 0)) - later_peers)
            .cast("long").alias(name) for name, s in windows.items()]
    return x.select("*", *cols).where(~F.col("__halo")).drop("__chunk", "__halo")


def rolling_mean_chunked(df: DataFrame, col: str = "amount", n: int = 50, device: str = "device_id",
                         t: str = "t", tie: str = "txn_id", out: str = "avg_amount_50",
                         chunk_rows: int = 100_000) -> DataFrame:
    """Mean of the last ``n`` rows per device (exact cents, half-even) with
    each device cut into chunks of ``chunk_rows`` positions; a chunk also
    gets the previous chunk's last n - 1 rows as halo.  A row's position is the
    count of the device's earlier rows, so a hot device never sorts in one task."""
    c_rows = max(chunk_rows, n)
    p0 = F.col("__pos")
    pos = prefix_sums(df, [device], t, tie, {"__pos": F.lit(1).cast("long")})
    chunk = ((p0 - F.pmod(p0, F.lit(c_rows))) / c_rows).cast("long")
    in_halo = F.pmod(p0, F.lit(c_rows)) >= c_rows - (n - 1)
    x = _with_halo(pos, chunk, in_halo, [device, "__pos", col])
    w = Window.partitionBy(device, "__chunk").orderBy("__pos").rowsBetween(-(n - 1), Window.currentRow)
    m = (half_even_ratio(F.sum(cents(col)).over(w), F.count(col).over(w)) / 100.0).alias(out)
    return x.select("*", m).where(~F.col("__halo")).drop("__chunk", "__halo", "__pos")


def velocity_prior(df: DataFrame, device: str = "device_id", t: str = "t", windows: dict | None = None) -> DataFrame:
    """Strictly earlier rows within ``[t - s, t)``; a hot device is split."""
    one = F.lit(1).cast("long")
    return range_sums(df, [device], t, {name + "_prior": (one, -s, -1) for name, s in (windows or VELOCITY_WINDOWS).items()})


def rolling_mean_7d(df: DataFrame, col: str = "amount", seconds: int = 7 * 86_400, device: str = "device_id",
                    t: str = "epoch_s", out: str = "avg_amount_7d", bucket: int = 86_400) -> DataFrame:
    """Mean of the trailing ``seconds`` up to and including the row's time, exact
    cents rounded half-to-even; a hot device is split, no row is copied."""
    frames = {"__sum": (cents(col), -seconds, 0), "__n": (F.col(col).isNotNull().cast("long"), -seconds, 0)}
    x = range_sums(df, [device], t, frames, bucket)
    mean = F.when(F.col("__n") > 0, half_even_ratio(F.col("__sum"), F.greatest("__n", F.lit(1))) / 100.0)
    return x.withColumn(out, mean).drop("__sum", "__n")


def zscore_point_in_time(df: DataFrame, col: str = "amount", device: str = "device_id", t: str = "t", tie: str = "txn_id",
                         out: str = "amount_zscore_pit", bucket: int = 86_400) -> DataFrame:
    """z-score of a money column against the device's strictly earlier rows
    (null for the first), population std, rounded to 3.  Count, sum and sum of
    squares of whole cents run up exactly, so the spread of equal amounts is 0."""
    x, c = F.col(col), cents(col)
    wide = c.cast("decimal(19,0)")
    x_n = F.col(col).isNotNull().cast("long")
    d = prefix_sums(df, [device], t, tie, {"__n": x_n, "__s": c, "__q": (wide * wide).cast("decimal(38,0)")}, bucket)
    n, s, q = F.col("__n"), F.col("__s"), F.col("__q")
    exact = [v.cast("decimal(38,0)") for v in (n, s)]
    spread = F.try_subtract(F.try_multiply(exact[0], q), F.try_multiply(exact[1], exact[1])).cast("double")
    spread = F.coalesce(spread, n.cast("double") * q.cast("double") - s.cast("double") * s.cast("double"))
    sd = F.sqrt(F.greatest(spread, F.lit(0.0))) / (n * 100.0)
    z = F.when(n > 0, (x - s / (n * 100.0)) / (sd + F.lit(1e-9)))
    return d.withColumn(out, F.bround(z, 3) + F.lit(0.0)).drop("__n", "__s", "__q")


def zscore_device_agg(df: DataFrame, col: str = "amount", device: str = "device_id",
                      out: str = "amount_zscore") -> DataFrame:
    """Whole-history device z-score from a partial aggregate joined back (a
    hot device is one aggregate row per task; AQE splits the skewed join)."""
    stats = df.groupBy(device).agg(F.avg(col).alias("__mu"), F.stddev_pop(col).alias("__sd"))
    z = (F.col(col) - F.col("__mu")) / (F.col("__sd") + F.lit(1e-9))
    return df.join(stats, device).withColumn(out, F.bround(z, 3) + F.lit(0.0)).drop("__mu", "__sd")
