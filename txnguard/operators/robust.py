"""Robustness probes: perturbation, extreme values, missing features,
boundary sweeps.  Every random draw is a function of (row key, trial,
feature, seed) through ``xxhash64``, so results do not depend on
partitioning or on task retries after a lost executor."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_uniform(*cols: Column) -> Column:
    """Deterministic U[0, 1) from the columns' 64-bit hash."""
    h = F.xxhash64(*cols)
    return F.pmod(h, F.lit(1 << 31)).cast("double") / float(1 << 31)


def perturb(df: DataFrame, key: str, numeric: Sequence[str], trials: int = 5, scale: float = 0.2,
            seed: int = 42) -> DataFrame:
    """Each row x ``trials``; every numeric feature times (1 +- U(scale))."""
    t = df.sparkSession.range(trials).withColumnRenamed("id", "trial")
    x = df.crossJoin(F.broadcast(t))  # fixed, small trial table
    for c in numeric:
        u = hash_uniform(F.col(key), F.col("trial"), F.lit(c), F.lit(seed))
        x = x.withColumn(c, F.col(c) * (F.lit(1.0) + F.lit(scale) * (u * 2 - 1)))
    return x


def flip_rate(before: DataFrame, after: DataFrame, key: str, decision: str = "decision") -> DataFrame:
    b = before.select(key, F.col(decision).alias("__d0"))
    j = after.join(b, key)
    return j.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(decision) != F.col("__d0")).cast("double")).alias("flip_rate"))


EXTREME_CASES = [("x100", 100.0), ("x_minus100", -100.0), ("zeros", 0.0), ("nan", float("nan"))]


def extreme_values(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Rows x 4 cases: every numeric feature scaled by 100, by -100, set to
    0 or to NaN."""
    cases = df.sparkSession.createDataFrame(EXTREME_CASES, "case string, factor double")
    x = df.crossJoin(F.broadcast(cases))
    for c in numeric:
        x = x.withColumn(c, F.when(F.col("case") == "nan", F.lit(float("nan")))
                         .when(F.col("case") == "zeros", F.lit(0.0)).otherwise(F.col(c) * F.col("factor")))
    return x


def missing_features(df: DataFrame, key: str, features: Sequence[str], fractions=(0.10, 0.25, 0.50, 0.75),
                     seed: int = 42) -> DataFrame:
    """Rows x fractions: zero the first round(f * n) features in a per-row
    hash order."""
    fr = df.sparkSession.createDataFrame([(float(f),) for f in fractions], "fraction double")
    x = df.crossJoin(F.broadcast(fr))
    n = len(features)
    ranks = F.array(*[F.struct(F.xxhash64(F.col(key), F.lit(c), F.lit(seed)).alias("h"), F.lit(c).alias("f"))
                      for c in features])
    order = F.transform(F.array_sort(ranks), lambda s: s["f"])
    x = x.withColumn("__order", order).withColumn("__k", F.round(F.col("fraction") * n).cast("int"))
    for c in features:
        zeroed = F.array_position(F.slice(F.col("__order"), 1, F.greatest(F.col("__k"), F.lit(1))), c) > 0
        x = x.withColumn(c, F.when(zeroed & (F.col("__k") > 0), F.lit(0.0)).otherwise(F.col(c)))
    return x.drop("__order", "__k")


def boundary(df: DataFrame, key: str, score: str, lo: float = 0.02, hi: float = 0.12,
             eps: Sequence[float] = (0.01, 0.02, 0.05, 0.10, 0.20, 0.30), trials: int = 10, seed: int = 42) -> DataFrame:
    """Rows with lo < score < hi x epsilon x trials; score moved by +-eps*U."""
    near = df.where((F.col(score) > lo) & (F.col(score) < hi))
    grid = df.sparkSession.createDataFrame([(float(e), t) for e in eps for t in range(trials)], "eps double, trial int")
    x = near.crossJoin(F.broadcast(grid))
    u = hash_uniform(F.col(key), F.col("trial"), F.col("eps"), F.lit(seed))
    return x.withColumn(score, F.col(score) + F.col("eps") * (u * 2 - 1))


def rescore_flip(df: DataFrame, key: str, perturbed: DataFrame, decide: Callable[[DataFrame], DataFrame],
                 group: Sequence[str] = ()) -> DataFrame:
    base = decide(df).select(key, F.col("decision").alias("__d0"))
    after = decide(perturbed).join(base, key)
    g = after.groupBy(*group) if group else after.groupBy()
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("decision") != F.col("__d0")).cast("double")).alias("flip_rate"))
