"""Population stability (PSI) drift report, all features in one pass.

Baseline and current tables are unpivoted and collapsed in one shuffle to
``(feature, text, number, count per side)``; the type test, the quantile edges
(one selection for the clipping bounds and all edges: clipping keeps the order,
so a quantile of clipped values lies between the clipped values beside it), the
bins and the categories are all read from these counts.  Bins are found with
``size(filter(edges, e -> e <= v))`` against the per-feature edge array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnguard.plans.scale import between, quantile_bounds

# Fixed values of the PSI definition.
MIN_ROWS = 50
CLIP_Q = (0.001, 0.999)
N_BINS = 10
EPS = 1e-6
NUMERIC_SHARE = 0.98
STABLE_BELOW = 0.10
MODERATE_BELOW = 0.25


def to_long(df: DataFrame, features: Sequence[str], side: str) -> DataFrame:
    """(side, feature, text value, numeric value); missing text is 'nan'.
    NaN counts as missing."""
    real = {c for c, t in df.dtypes if t in ("double", "float")}
    parts = ", ".join(f"'{c}', CAST({f'nanvl(`{c}`, NULL)' if c in real else f'`{c}`'} AS STRING)" for c in features)
    long = df.selectExpr(f"stack({len(features)}, {parts}) AS (feature, s)")
    x = F.nanvl(F.col("s").try_cast("double"), F.lit(None).cast("double"))
    return long.select(F.lit(side).alias("side"), "feature",
                       F.coalesce(F.col("s"), F.lit("nan")).alias("s"), x.alias("x"))


def collapse(long: DataFrame) -> DataFrame:
    """``(feature, s, x, e, a)``: rows of either side per distinct value.  Kept on
    disk, as all parts of a report read it (a lost part is computed again)."""
    return long.groupBy("feature", "s", "x").agg(F.count_if(F.col("side") == "baseline").alias("e"),
                                                 F.count_if(F.col("side") == "current").alias("a")).persist(StorageLevel.DISK_ONLY)


def feature_types(long: DataFrame) -> DataFrame:
    """numeric when more than 98 % of baseline values parse as numbers."""
    return _types(collapse(long))


def _types(c: DataFrame) -> DataFrame:
    return c.where("e > 0").groupBy("feature").agg(
        (F.sum(F.when(F.col("x").isNotNull(), F.col("e")).otherwise(0)) / F.sum("e") > NUMERIC_SHARE).alias("is_numeric"))


def _psi_terms(e_cnt: Column, a_cnt: Column, e_tot: Column, a_tot: Column, k: Column) -> Column:
    e = F.when(e_tot > 0, e_cnt / e_tot).otherwise(F.lit(1.0) / F.greatest(k, F.lit(1)))
    a = F.when(a_tot > 0, a_cnt / a_tot).otherwise(F.lit(1.0) / F.greatest(k, F.lit(1)))
    e = F.greatest(e, F.lit(EPS))
    a = F.greatest(a, F.lit(EPS))
    return (a - e) * F.log(a / e)


def psi_numeric(long: DataFrame, n_bins: int = N_BINS) -> DataFrame:
    """PSI per numeric feature; null ("unknown") with < 50 values a side,
    0 when fewer than 3 distinct edges remain."""
    return _psi_numeric(collapse(long), n_bins)


def _psi_numeric(c: DataFrame, n_bins: int) -> DataFrame:
    num = c.where(F.col("x").isNotNull())
    edges = quantile_edges(num.where("e > 0"), n_bins)
    bins = num.join(edges, "feature", "left")
    x = F.least(F.greatest(F.col("x"), F.col("lo")), F.col("hi"))
    bins = bins.withColumn("bin", F.least(F.size(F.filter("edges", lambda v: v <= x)), F.size("edges") - 1))
    per = bins.groupBy("feature").agg(F.sum("e").alias("n_e"), F.sum("a").alias("n_a"), F.max(F.size("edges") - 1).alias("k"),
                                      *[F.coalesce(F.sum(F.when(F.col("bin") == i, F.col(s))), F.lit(0)).alias(f"{s}{i}")
                                        for i in range(1, n_bins + 1) for s in "ea"])
    k = F.col("k")
    terms = [F.when(k >= i, _psi_terms(F.col(f"e{i}"), F.col(f"a{i}"), F.col("n_e"), F.col("n_a"), k)).otherwise(0.0) for i in range(1, n_bins + 1)]
    psi = F.when((F.col("n_e") >= MIN_ROWS) & (F.col("n_a") >= MIN_ROWS), F.when(k < 2, 0.0).otherwise(sum(terms[1:], terms[0])))
    return per.select("feature", psi.alias("psi"))


def quantile_edges(counts: DataFrame, n_bins: int = N_BINS, count: str = "e") -> DataFrame:
    """``(feature, lo, hi, edges)`` of ``counts (feature, x, <count>)``: the
    clipping bounds and the distinct edges of ``n_bins`` quantile bins between them."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    q = quantile_bounds(counts, ["feature"], "x", count, [*CLIP_Q, *probs])
    own = between(F.col("lo"), F.col("hi"), F.col("frac"))
    at = F.struct("lo", "hi", "frac")
    per = q.groupBy("feature").agg(F.max(F.when(F.col("p") == CLIP_Q[0], own)).alias("lo"), F.max(F.when(F.col("p") == CLIP_Q[1], own)).alias("hi"),
                                   F.collect_list(F.when(F.col("p").isin(probs), at)).alias("at"))

    def clip(v: Column) -> Column:
        return F.least(F.greatest(v, F.col("lo")), F.col("hi"))
    edges = F.transform("at", lambda r: between(clip(r["lo"]), clip(r["hi"]), r["frac"]))
    return per.select("feature", "lo", "hi", F.array_sort(F.array_distinct(edges)).alias("edges"))


def psi_categorical(long: DataFrame) -> DataFrame:
    """PSI over the union of categories (text values); <= 1 category -> 0."""
    return _psi_categorical(collapse(long))


def _psi_categorical(c: DataFrame) -> DataFrame:
    cats = c.groupBy("feature", "s").agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    total = cats.groupBy("feature").agg(F.sum("e").alias("n_e"), F.sum("a").alias("n_a"), F.count("*").alias("k"))
    term = _psi_terms(F.col("e"), F.col("a"), F.col("n_e"), F.col("n_a"), F.col("k"))
    return cats.join(total, "feature").groupBy("feature").agg(F.sum(F.when(F.col("k") > 1, term).otherwise(0.0)).alias("psi"))


def status(psi: Column) -> Column:
    return (F.when(psi.isNull() | F.isnan(psi), "unknown").when(psi < STABLE_BELOW, "stable")
            .when(psi < MODERATE_BELOW, "moderate").otherwise("significant"))


def psi_report(baseline: DataFrame, current: DataFrame, features: Sequence[str] | None = None,
               n_bins: int = N_BINS) -> DataFrame:
    """Per feature: type, PSI, status (common columns, optional allow-list)."""
    common = sorted(set(baseline.columns) & set(current.columns))
    if features is not None:
        common = [c for c in common if c in set(features)]
    long = to_long(baseline, common, "baseline").unionByName(to_long(current, common, "current"))
    c = collapse(long)
    types = _types(c)
    num = c.join(types.where("is_numeric"), "feature", "left_semi")
    cat = c.join(types.where("NOT is_numeric"), "feature", "left_semi")
    psi = _psi_numeric(num, n_bins).unionByName(_psi_categorical(cat))
    return psi.join(types, "feature").withColumn("status", status(F.col("psi")))


def status_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("n_features"))


def top_drifting(report: DataFrame, k: int = 20) -> DataFrame:
    """PSI descending, unknown (null) last; ties by feature name."""
    w = Window.orderBy(F.col("psi").desc_nulls_last(), F.col("feature"))
    return report.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ---------------------------------------------------------------- a kept baseline
def fit_baseline(baseline: DataFrame, features: Sequence[str], n_bins: int = N_BINS) -> DataFrame:
    """What later tables are compared with, one row per (feature, cell):
    ``(feature, is_numeric, lo, hi, edges, cell, e)``; a cell is a bin's number
    or a category.  To be written once; the baseline's rows aren't read again."""
    c = collapse(to_long(baseline, features, "baseline"))
    types = _types(c)
    shape = types.join(quantile_edges(c.where("x is not null"), n_bins), "feature", "left")
    return _cells(c.select("feature", "s", "x", F.col("e").alias("n")), shape).withColumnRenamed("n", "e")


def _cells(counts: DataFrame, shape: DataFrame) -> DataFrame:
    """``shape`` with the number of rows in each of its cells; a numeric
    feature's texts that are no numbers count nowhere."""
    x = F.least(F.greatest(F.col("x"), F.col("lo")), F.col("hi"))
    number = F.least(F.size(F.filter("edges", lambda v: v <= x)), F.size("edges") - 1)
    cell = F.when(F.col("is_numeric"), F.when(F.col("x").isNotNull(), number.cast("string"))).otherwise(F.col("s"))
    return (counts.join(shape, "feature").withColumn("cell", cell).where("cell is not null")
            .groupBy("feature", "is_numeric", "lo", "hi", "edges", "cell").agg(F.sum("n").alias("n")))


def count_cells(model: DataFrame, table: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(feature, cell, a)`` of a table by the cells of a kept baseline.  Counts
    of several tables may be added up."""
    shape = model.select("feature", "is_numeric", "lo", "hi", "edges").distinct()
    counts = to_long(table, features, "current").groupBy("feature", "s", "x").agg(F.count("*").alias("n"))
    return _cells(counts, shape).select("feature", "cell", F.col("n").alias("a"))


def psi_of_counts(model: DataFrame, counts: DataFrame) -> DataFrame:
    """``(feature, psi, is_numeric, status)`` of added-up counts against the
    baseline; the same numbers as :func:`psi_report` on the rows themselves."""
    kinds = model.groupBy("feature").agg(F.first("is_numeric").alias("is_numeric"), F.first(F.size("edges") - 1).alias("bins"))
    both = model.select("feature", "cell", "e").join(counts, ["feature", "cell"], "full").fillna(0, ["e", "a"])
    total = both.groupBy("feature").agg(F.sum("e").alias("n_e"), F.sum("a").alias("n_a"), F.count("*").alias("k")).join(kinds, "feature")
    total = total.withColumn("k", F.when(F.col("is_numeric"), F.col("bins")).otherwise(F.col("k")))
    term = _psi_terms(F.col("e"), F.col("a"), F.col("n_e"), F.col("n_a"), F.col("k"))
    psi = both.join(total, "feature").groupBy("feature", "is_numeric", "k", "n_e", "n_a").agg(F.sum(term).alias("psi"))
    psi = psi.withColumn("psi", F.when(F.col("is_numeric") & (F.least("n_e", "n_a") < MIN_ROWS), None).when(F.col("k") < 2, 0.0).otherwise(F.col("psi")))
    return psi.select("feature", "psi", "is_numeric", status(F.col("psi")).alias("status"))
