"""Running and trailing aggregates per key that split a hot key.

A window ``PARTITION BY key ORDER BY t`` sorts all rows of a key in one task.
Here the rows of a key are cut into cells (key, t, block of the tie key), the
cells into buckets of ``bucket`` time units.  What comes before a row is the sum
of three parts: the buckets before its bucket, the cells before its cell in the
bucket, and the rows before it in the cell.  Each part is a window of its own:

* over one row per bucket, partitioned by key (the length of a key's timeline
  over ``bucket``, whatever its number of rows),
* over one row per cell, partitioned by (key, bucket),
* over the rows, partitioned by (key, cell): 2**TIE_BITS at most, for a unique
  whole-number tie key.

The rows are dealt by cell once, before anything else: what made them ends there
and isn't done again per level, and no task holds all levels of a key, as it
would if rows dealt by key came in and were taken as dealt well enough.
Sums of a coarser level join a finer window as a row that stands before all
others, so no join and no null key is involved.  Everything is lazy and depends
on the rows alone, not on how they are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: rows with one time are split into runs of 2**TIE_BITS tie keys
TIE_BITS = 16

_BEFORE = (Window.unboundedPreceding, -1)


def _block(df: DataFrame, tie: str) -> Column:
    whole = isinstance(df.schema[tie].dataType, IntegralType)
    return F.shiftright(F.col(tie).cast("long"), TIE_BITS) if whole else F.lit(0).cast("long")


def _bucket(t: Column, length: int) -> Column:
    return ((t - F.pmod(t, F.lit(length))) / length).cast("long")


def prefix_sums(df: DataFrame, key: Sequence[str], t: str, tie: str, sums: dict[str, Column], bucket: int = 86_400) -> DataFrame:
    """``df`` with, per name, the sum of its column over the strictly earlier
    rows of the key in ``(t, tie)`` order (0 before the first; nulls don't add).
    ``t`` is a whole number."""
    key, names = list(key), list(sums)
    rows = df.withColumn("__block", _block(df, tie)).withColumns({f"__m_{n}": c for n, c in sums.items()})
    rows = rows.repartition(*key, t, "__block")
    cells = rows.groupBy(*key, t, "__block").agg(*[F.sum(f"__m_{n}").alias(f"__m_{n}") for n in names])
    cells = cells.withColumn("__bucket", _bucket(F.col(t), bucket))
    buckets = cells.groupBy(*key, "__bucket").agg(*[F.sum(f"__m_{n}").alias(f"__m_{n}") for n in names])

    def before(x: DataFrame, part: Sequence[str], order: Sequence[Column]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(*order).rowsBetween(*_BEFORE)
        return x.withColumns({f"__b_{n}": F.sum(f"__m_{n}").over(w) for n in names})

    def head(x: DataFrame, cols: Sequence[str]) -> DataFrame:
        """What comes before, as a row that stands first in the finer window."""
        return x.select(*cols, *[F.col(f"__b_{n}").alias(f"__m_{n}") for n in names], F.lit(0).alias("__row"))
    heads = head(before(buckets, key, [F.col("__bucket")]), [*key, "__bucket"])
    cells = cells.withColumn("__row", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    cells = before(cells, [*key, "__bucket"], [F.col("__row"), F.col(t), F.col("__block")]).where("__row = 1")
    rows = rows.withColumn("__row", F.lit(1)).unionByName(head(cells, [*key, t, "__block"]), allowMissingColumns=True)
    rows = before(rows, [*key, t, "__block"], [F.col("__row"), F.col(tie)]).where("__row = 1")
    return rows.select(*df.columns, *[F.coalesce(f"__b_{n}", F.lit(0)).alias(n) for n in names])


def previous(df: DataFrame, key: Sequence[str], t: str, tie: str, value: str, out: str, bucket: int = 86_400) -> DataFrame:
    """``df`` with ``value`` of the row before it in the key's ``(t, tie)`` order
    (null for the first).  ``t`` is a whole number."""
    key = list(key)
    rows = df.select("*", _block(df, tie).alias("__block"), F.struct(F.col(value).alias("v")).alias("__last"), F.lit(1).alias("__row"))
    cells = rows.groupBy(*key, t, "__block").agg(F.max_by("__last", tie).alias("__last")).withColumn("__bucket", _bucket(F.col(t), bucket))
    order = [F.col(t), F.col("__block")]
    buckets = cells.groupBy(*key, "__bucket").agg(F.max_by("__last", F.struct(*order)).alias("__last"))

    def lag(x: DataFrame, part: Sequence[str], *by: Column) -> DataFrame:
        return x.withColumn("__prev", F.lag("__last").over(Window.partitionBy(*part).orderBy(*by)))

    def head(x: DataFrame, cols: Sequence[str]) -> DataFrame:
        return x.select(*cols, F.col("__prev").alias("__last"), F.lit(0).alias("__row"))
    heads = head(lag(buckets, key, F.col("__bucket")), [*key, "__bucket"])
    cells = cells.withColumn("__row", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    cells = lag(cells, [*key, "__bucket"], F.col("__row"), *order).where("__row = 1")
    rows = rows.unionByName(head(cells, [*key, t, "__block"]), allowMissingColumns=True)
    rows = lag(rows, [*key, t, "__block"], F.col("__row"), F.col(tie)).where("__row = 1")
    return rows.select(*df.columns, F.col("__prev.v").alias(out))


def range_sums(df: DataFrame, key: Sequence[str], t: str, frames: dict[str, tuple[Column, int, int]],
               bucket: int = 86_400) -> DataFrame:
    """``df`` with, per name, the sum of its column over the key's rows whose time
    lies in ``[t + lo, t + hi]`` (0 if there are none).  ``t`` is a whole number.

    A frame is the difference of two running sums, up to ``t + hi`` and up to
    ``t + lo - 1``.  Rows are first added up per (key, t); the ends of the frames
    are points among these sums, with no weight of their own.  So no row is
    copied into another chunk, however long the frame, and a task holds the
    distinct times of one key and bucket."""
    key = list(key)
    measures = {f"__m_{n}": c for n, (c, _, _) in frames.items()}
    at = df.groupBy(*key, t).agg(*[F.sum(c).alias(m) for m, c in measures.items()])
    ends = sorted({e for _, lo, hi in frames.values() for e in (hi, lo - 1)})
    point = F.struct(F.col(t).alias("x"), F.lit(None).cast("long").alias("end"))
    points = at.select(*key, t, *measures, F.explode(F.array(point, *[F.struct((F.col(t) + e).alias("x"), F.lit(e).cast("long").alias("end"))
                                                                      for e in ends])).alias("p"))
    points = points.select(*key, t, "p.x", "p.end", *[F.when(F.col("p.end").isNull(), F.col(m)).alias(m) for m in measures],
                           _bucket(F.col("p.x"), bucket).alias("__bucket"))
    buckets = points.groupBy(*key, "__bucket").agg(*[F.sum(m).alias(m) for m in measures])
    w = Window.partitionBy(*key).orderBy("__bucket").rowsBetween(*_BEFORE)
    heads = buckets.select(*key, "__bucket", *[F.sum(m).over(w).alias(m) for m in measures], F.lit(0).alias("__row"))
    # at equal x a row's own sum comes before the ends that look for it
    points = points.withColumn("__row", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    w = Window.partitionBy(*key, "__bucket").orderBy("__row", "x", F.col("end").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    sums = points.select(*key, t, "end", *[F.coalesce(F.sum(m).over(w), F.lit(0)).alias(m) for m in measures]).where("end is not null")

    def upto(m: str, e: int) -> Column:
        return F.max(F.when(F.col("end") == e, F.col(m)))
    values = sums.groupBy(*key, t).agg(*[(upto(f"__m_{n}", hi) - upto(f"__m_{n}", lo - 1)).alias(f"__v_{n}")
                                         for n, (_, lo, hi) in frames.items()])
    rows = df.withColumn("__row", F.lit(1)).unionByName(values.withColumn("__row", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*key, t).orderBy("__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", *[F.first(f"__v_{n}", ignorenulls=True).over(w).alias(f"__o_{n}") for n in frames]).where("__row = 1")
    return rows.select(*df.columns, *[F.coalesce(f"__o_{n}", F.lit(0)).alias(n) for n in frames])
