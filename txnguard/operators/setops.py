"""Set operations and top-k helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def union_dedupe(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Base rows plus new rows, exact duplicates dropped."""
    return base.unionByName(extra).dropDuplicates()


def split_overlap(df: DataFrame, split: str, keys: Sequence[str]) -> DataFrame:
    """|a ∩ b| on key columns for every pair of splits (distinct keys)."""
    names = ["train", "val", "test"]
    k = df.select(split, *keys).distinct()
    rows = None
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            inter = (k.where(F.col(split) == a).drop(split)
                     .intersect(k.where(F.col(split) == b).drop(split)))
            part = inter.agg(F.count(F.lit(1)).alias("n_overlap")).select(
                F.lit(a).alias("split_a"), F.lit(b).alias("split_b"), "n_overlap")
            rows = part if rows is None else rows.unionByName(part)
    return rows


def column_diff(spark: SparkSession, before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns added / missing / common between two tables (schema only)."""
    a, b = before.columns, after.columns
    rows = [(c, "added") for c in b if c not in a] + [(c, "missing") for c in a if c not in b] + \
           [(c, "common") for c in a if c in b]
    return spark.createDataFrame(rows, "column string, change string")


def common_features(baseline: DataFrame, current: DataFrame, allow: Sequence[str] | None = None) -> list[str]:
    common = sorted(set(baseline.columns) & set(current.columns))
    return [c for c in common if allow is None or c in allow]


def dedupe_by_canonical_row(df: DataFrame, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row (by ``order``) of every distinct feature tuple."""
    from txnguard.plans.scale import first_per_key
    return first_per_key(df, cols, order).select(*df.columns)


def top_abs(arr: Column, k: int, names: Column | None = None) -> Column:
    """Per row: the k entries of an array with the largest |value|, as
    ``struct(idx, value)`` sorted by |value| desc then index."""
    idx = F.transform(arr, lambda v, i: F.struct((i + 1).alias("idx"), v.cast("double").alias("value")))
    srt = F.array_sort(idx, lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1)
                       .when(F.abs(a["value"]) < F.abs(b["value"]), 1)
                       .when(a["idx"] < b["idx"], -1).when(a["idx"] > b["idx"], 1).otherwise(0))
    return F.slice(srt, 1, k)


def closest_to(df: DataFrame, col: str, target: float, key: str, k: int) -> DataFrame:
    return df.orderBy(F.abs(F.col(col) - F.lit(target)), F.col(key)).limit(k)


def extremes_in_band(df: DataFrame, col: str, lo: float, hi: float, key: str, k: int, highest: bool) -> DataFrame:
    o = F.col(col).desc() if highest else F.col(col).asc()
    return df.where((F.col(col) >= lo) & (F.col(col) < hi)).orderBy(o, F.col(key)).limit(k)
