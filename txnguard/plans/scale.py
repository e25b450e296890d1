"""Order-dependent aggregates without a single-partition window.

A window with ORDER BY but no PARTITION BY puts every row in one task.  Here the
order is cut into cells by the digits of the leading sort key, coarse and fine
(``_digits``, a function of the value alone, non-decreasing in it), and by
blocks of whole-number keys behind it.  What comes before a row is the sum of
the coarse cells before its own, the fine cells before its own in the coarse
one, and the rows before it in the fine cell.  Each part is a window over the
cells of one coarser cell; sums of a coarser level stand in the finer window as
a row before all others.  No job runs while a plan is built, nothing is written,
and the result doesn't depend on how rows are dealt to tasks.

``global_cumsum`` expects unique sort keys; callers first ``groupBy`` the key
(map-side combine), so a value repeated a billion times is one row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, TimestampNTZType, TimestampType

#: cells per factor of two of the leading key: 2**COARSE, each cut into 2**(FINE - COARSE)
COARSE, FINE = 8, 20
#: digit levels of a selection
LEVELS = (8, 24)
#: whole-number keys behind the leading one are cut into blocks of 2**BLOCK
BLOCK = 16
_LAST = 1 << 60  # beyond the cells of all finite numbers


def _number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    return (F.unix_date(name) if isinstance(kind, DateType) else F.col(name)).cast("double")


def _digits(x: Column, depth: int = FINE) -> Column:
    """Cell of a number, 2**depth to a factor of two.  ``e + |x| / 2**e - 1`` with ``e`` the whole part of
    ``log2 |x|`` is a continuous, increasing stand-in for the logarithm, so a
    cell never stands out of order, also where ``e`` is rounded wrongly."""
    size = F.abs(x)
    e = F.floor(F.log2(size)).cast("double")
    cell = F.floor((e + size / F.pow(F.lit(2.0), e) + 1100.0) * float(1 << depth)).cast("long")
    cell = F.when(x == 0, 0).when(x > 0, cell).otherwise(-cell)
    return (F.when(x.isNull(), -_LAST - 1).when(F.isnan(x) | (x == float("inf")), _LAST).when(x == float("-inf"), -_LAST)
            .otherwise(cell))


def global_cumsum(df: DataFrame, order_cols: Sequence[str], sum_cols: Sequence[str],
                  group_col: str | None = None, prefix: str = "cum_") -> DataFrame:
    """Running sums of ``sum_cols`` in the total order ``order_cols``, whose first
    column (behind ``group_col``) is a number, date or timestamp; nulls come first.

    With ``group_col`` (which must be ``order_cols[0]``) the running sums
    restart for every group.
    """
    if group_col is not None and order_cols[0] != group_col:
        raise ValueError("group_col must lead order_cols")
    group = [] if group_col is None else [group_col]
    order = list(order_cols)[len(group):]
    fine = _digits(_number(df, order[0]))
    cells = {"__c0": F.shiftright(fine, FINE - COARSE), "__c1": fine}
    for i, c in enumerate(order[1:], 2):
        if isinstance(df.schema[c].dataType, IntegralType):
            cells[f"__c{i}"] = F.coalesce(F.shiftright(F.col(c).cast("long"), BLOCK), F.lit(-_LAST))
    names = list(cells)
    rows = df.withColumns(cells)
    sums = [F.sum(c).alias(c) for c in sum_cols]
    levels = [rows.groupBy(*group, *names).agg(*sums)]  # finest first
    for k in range(len(names) - 1, 0, -1):
        levels.append(levels[-1].groupBy(*group, *names[:k]).agg(*sums))
    heads = None  # what comes before each cell of the level above, as its first row
    for k, level in enumerate(reversed(levels)):
        level = level.withColumn("__row", F.lit(1))
        if heads is not None:
            level = level.unionByName(heads, allowMissingColumns=True)
        w = Window.partitionBy(*group, *names[:k]).orderBy("__row", names[k]).rowsBetween(Window.unboundedPreceding, -1)
        heads = level.select(*group, *names[: k + 1], "__row", *[F.sum(c).over(w).alias(c) for c in sum_cols]).where("__row = 1")
        heads = heads.withColumn("__row", F.lit(0))
    rows = rows.withColumn("__row", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    w = Window.partitionBy(*group, *names).orderBy("__row", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (rows.select(*df.columns, "__row", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{prefix}{c}") for c in sum_cols])
            .where("__row = 1").drop("__row"))


def global_row_number(df: DataFrame, order_cols: Sequence[str], out: str = "row_num") -> DataFrame:
    """1-based position of each row in the total order ``order_cols`` (end it
    with a unique key; ties are otherwise broken arbitrarily, as in any sort)."""
    one = global_cumsum(df.withColumn("__one", F.lit(1).cast("long")), order_cols, ["__one"])
    return one.withColumnRenamed("cum___one", out).drop("__one")


def order_statistics(values: DataFrame, group: Sequence[str], value: str, count: str,
                     ranks: Callable[[Column], Column]) -> DataFrame:
    """The values that stand at given ranks, ``(*group, r, value)``: ``ranks``
    makes of a group's number of rows an array of structs ``r`` with a ``rank``
    from 1.  ``values`` has one row per (group, value), ``count`` rows each.

    Selection by refinement: counts per coarse cell name the one cell that
    holds a rank, counts of its fine cells the next, and only the values of those
    are put in order, so the whole is never sorted.  A group may be null."""
    group = list(group)
    digits = _digits(_number(values, value), LEVELS[-1])
    path = [f"__c{i}" for i in range(len(LEVELS))]
    rows = values.select(*group, value, count, *[F.shiftright(digits, LEVELS[-1] - d).alias(c) for c, d in zip(path, LEVELS, strict=True)])
    found = None
    for k, level in enumerate([*path, value]):
        keys = [*group, *path[:k]]
        if found is None:
            cells = rows.groupBy(*group, level).agg(F.sum(count).alias("__n"))
            cells = cells.withColumn("__total", F.sum("__n").over(Window.partitionBy(*group))).withColumn("__ranks", ranks(F.col("__total")))
        else:
            few = found.withColumnsRenamed({c: f"__f_{c}" for c in keys})  # a few rows per group
            on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__f_{c}")) for c in keys])
            cells = rows.join(few, on).groupBy(*keys, level).agg(F.sum(count).alias("__n"), F.first("__ranks").alias("__ranks"))
        w = Window.partitionBy(*keys).orderBy(level).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cells = cells.withColumn("__upto", F.sum("__n").over(w))
        before = F.col("__upto") - F.col("__n")
        here = F.filter("__ranks", lambda r: (r["rank"] > before) & (r["rank"] <= F.col("__upto")))
        cells = cells.withColumn("__ranks", here).where(F.size("__ranks") > 0)
        found = cells.select(*keys, level, F.transform("__ranks", lambda r: r.withField("rank", r["rank"] - before)).alias("__ranks"))
    return found.select(*group, F.explode("__ranks").alias("r"), F.col(value).alias("value"))


def quantile_bounds(values: DataFrame, group: Sequence[str], value: str, count: str, probs: Sequence[float],
                    method: str = "linear") -> DataFrame:
    """``(*group, p, lo, hi, frac)``: the two values that quantile p lies between
    and the share (hundredths for ``exclusive``) of the way."""
    if method not in ("linear", "exclusive"):
        raise ValueError(method)

    def ranks(n: Column) -> Column:
        def of(p: Column) -> Column:
            if method == "linear":
                pos = p * (n - 1)
                lo, hi, frac = F.floor(pos) + 1, F.ceil(pos) + 1, pos - F.floor(pos)
            else:
                i = F.round(p * 100).cast("long") * (n + 1)
                lo = F.when(n >= 2, F.least(F.greatest(((i - F.pmod(i, F.lit(100))) / 100).cast("long"), F.lit(1)), n - 1))
                hi, frac = lo + 1, (i - lo * 100).cast("double")
            return F.array(*[F.struct(p.alias("p"), frac.alias("frac"), F.lit(side).alias("side"), rank.cast("long").alias("rank"))
                             for side, rank in enumerate((lo, hi))])
        return F.flatten(F.transform(F.array(*[F.lit(float(x)) for x in probs]), of))
    hit = order_statistics(values, group, value, count, ranks)
    side = F.col("r.side")
    return hit.groupBy(*group, F.col("r.p").alias("p"), F.col("r.frac").alias("frac")).agg(
        F.max(F.when(side == 0, F.col("value"))).alias("lo"), F.max(F.when(side == 1, F.col("value"))).alias("hi"))


def between(lo: Column, hi: Column, frac: Column, method: str = "linear") -> Column:
    """The quantile between its bounds; ``exclusive`` keeps the operation order of
    Python's ``statistics.quantiles``."""
    return lo + (hi - lo) * frac if method == "linear" else (lo * (F.lit(100.0) - frac) + hi * frac) / F.lit(100.0)


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float],
                    group_cols: Sequence[str] = (), method: str = "linear") -> DataFrame:
    """Exact quantiles per group, long form ``(*group_cols, p, q)``.

    ``linear``: position p*(n-1) with linear interpolation (numpy default,
    SQL ``percentile`` / ``quantile_cont``).  ``exclusive``: Python's
    ``statistics.quantiles(method='exclusive')`` cut points, i.e. position
    p*(n+1) clamped to [1, n-1]; ``probs`` must then be multiples of 1/100.
    Nulls are ignored.
    """
    g = list(group_cols)
    # one row per distinct (group, value), however often it stands
    vals = df.where(F.col(value_col).isNotNull()).groupBy(*g, value_col).agg(F.count(F.lit(1)).alias("__c"))
    bounds = quantile_bounds(vals, g, value_col, "__c", probs, method)
    return bounds.select(*g, "p", between(F.col("lo"), F.col("hi"), F.col("frac"), method).alias("q"))


def quantile_row(df: DataFrame, value_col: str, probs: Sequence[float], names: Sequence[str],
                 group_cols: Sequence[str] = (), method: str = "linear") -> DataFrame:
    """Wide form of :func:`exact_quantiles`: one column per name."""
    long = exact_quantiles(df, value_col, probs, group_cols, method)
    aggs = [F.max(F.when(F.abs(F.col("p") - F.lit(float(p))) < 1e-12, F.col("q"))).alias(nm)
            for p, nm in zip(probs, names)]
    if group_cols:
        return long.groupBy(*group_cols).agg(*aggs)
    return long.agg(*aggs)


def percentile_rank(values: DataFrame, value_col: str, baseline: DataFrame, base_col: str,
                    out: str = "pct_rank") -> DataFrame:
    """``100 * #(baseline <= v) / n`` for every row of ``values`` (null if the
    baseline is empty) -- a range lookup done as one union + running count,
    never a theta join."""
    b = baseline.where(F.col(base_col).isNotNull()).groupBy(F.col(base_col).alias("__x")).agg(
        F.count(F.lit(1)).alias("__b"))
    q = values.select(F.col(value_col).alias("__x")).where(F.col("__x").isNotNull()).distinct() \
        .withColumn("__b", F.lit(0).cast("long"))
    # baseline entries of a value sort before queries of the same value so the
    # running count includes them (searchsorted side='right').
    u = (b.withColumn("__kind", F.lit(0)).unionByName(q.withColumn("__kind", F.lit(1)))
         .groupBy("__x").agg(F.sum("__b").alias("__b"), F.max("__kind").alias("__isq")))
    cum = global_cumsum(u, ["__x"], ["__b"])
    n = b.agg(F.sum("__b").alias("__n"))
    ranks = cum.where(F.col("__isq") == 1).crossJoin(F.broadcast(n)).select(
        F.col("__x"), F.when(F.col("__n") > 0, F.lit(100.0) * F.col("cum___b") / F.col("__n"))
        .alias(out))
    return values.join(ranks, values[value_col] == ranks["__x"], "left").drop("__x")


def first_per_key(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], latest: bool = False) -> DataFrame:
    """The first (or, with ``latest``, the last) row per key in the order of
    ``order_cols`` (make it total with a unique key).

    A ``min_by`` / ``max_by`` aggregate over the whole row: partial
    aggregation keeps one row per key per task before the shuffle, so a key
    holding a third of the table costs one row per task, not one task."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    order = F.struct(*[F.col(c) for c in order_cols])
    pick = F.max_by(row, order) if latest else F.min_by(row, order)
    return df.groupBy(*keys).agg(pick.alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def top_k_per_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence, k: int,
                    tie_col: str, buckets: int = 64, rank_col: str = "rank") -> DataFrame:
    """Top k rows per group in two stages: first per (group, hash bucket of
    ``tie_col``), then per group over at most ``buckets * k`` survivors, so a
    hot group is ranked by many tasks instead of one."""
    g = list(group_cols)
    b = F.pmod(F.xxhash64(F.col(tie_col)), F.lit(buckets))
    w1 = Window.partitionBy(*g, b).orderBy(*order_cols)
    stage1 = df.withColumn("__r1", F.row_number().over(w1)).where(F.col("__r1") <= k).drop("__r1")
    w2 = Window.partitionBy(*g).orderBy(*order_cols)
    return stage1.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)
