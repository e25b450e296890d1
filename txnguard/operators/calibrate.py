"""Threshold calibration: percentile gates and cut-off sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnguard.plans.scale import quantile_row


def percentile_thresholds(df: DataFrame, err: str = "ae_err", label: str = "label",
                          q_review: float = 0.95, q_block: float = 0.995) -> DataFrame:
    """One-row ``(review, block, n_legit)`` from the legit rows' error
    distribution (exact, linear interpolation)."""
    legit = df.where(F.col(label) == 0)
    q = quantile_row(legit, err, [q_review, q_block], ["review", "block"])
    n = legit.agg(F.count(err).alias("n_legit"))
    return q.crossJoin(n)


def fpr_thresholds(df: DataFrame, err: str = "ae_err", label: str = "label",
                   fpr_review: float = 0.01, fpr_block: float = 0.001) -> DataFrame:
    """Thresholds at a target false-positive rate on legit rows; block >= review."""
    legit = df.where(F.col(label) == 0)
    q = quantile_row(legit, err, [1 - fpr_review, 1 - fpr_block], ["review", "__b"])
    return q.select("review", F.greatest("__b", "review").alias("block"))


def _score_table(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.groupBy(F.col(score).alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def threshold_sweep(df: DataFrame, score: str, label: str, thresholds: Sequence[float],
                    beta: float = 1.0) -> DataFrame:
    """Precision / recall / F-beta at every cut-off (``score >= t`` flags).

    Each row is binned by the number of cut-offs it passes (``Bucketizer``
    binary search over the sorted grid); counts per bin (at most
    len(grid)+1 rows, a fixed bound) are summed from the top, so the rows
    are read once and never multiplied by the grid size.
    """
    grid = [float(t) for t in thresholds]
    uniq = sorted(set(grid))
    # Bucketizer: JVM binary search over the sorted cut-offs; bucket b holds
    # scores passing exactly b cut-offs.
    from pyspark.ml.feature import Bucketizer
    bz = Bucketizer(splits=[float("-inf")] + uniq + [float("inf")], inputCol="__s", outputCol="__b",
                    handleInvalid="skip")
    rows = df.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("__s"),
                                                      F.col(label).alias("y"))
    binned = (bz.transform(rows).groupBy(F.col("__b").cast("int").alias("b"))
              .agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")))
    spark = df.sparkSession
    rank = {t: r + 1 for r, t in enumerate(uniq)}
    idx = spark.createDataFrame([(rank[t], t, i) for i, t in enumerate(grid)], "b int, t double, grid_pos int")
    from pyspark.sql import Window
    w = Window.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = (idx.select("b").distinct().unionByName(binned.select("b")).distinct()
            .join(binned, "b", "left").fillna(0, ["pos", "neg"])
            .select("b", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp")))
    totals = binned.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("P"),
                        F.coalesce(F.sum("neg"), F.lit(0)).alias("N"))
    res = idx.join(full, "b").crossJoin(totals).select("grid_pos", "t", "tp", "fp", "P", "N")
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec = F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(0.0)
    b2 = beta * beta
    fb = F.when(prec + rec > 0, (1 + b2) * prec * rec / (b2 * prec + rec)).otherwise(0.0)
    return res.select("grid_pos", "t", "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"),
                      prec.alias("precision"), rec.alias("recall"), fb.alias("fscore"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """First strict maximum of the F-score (ties -> smallest cut-off)."""
    return sweep.orderBy(F.col("fscore").desc(), F.col("t").asc()).limit(1)


def sweep_grid(start: float, stop: float, num: int) -> list[float]:
    """``numpy.linspace(start, stop, num)`` as Python floats."""
    if num == 1:
        return [float(start)]
    step = (stop - start) / (num - 1)
    return [start + i * step for i in range(num - 1)] + [float(stop)]
