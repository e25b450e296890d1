"""Exact k nearest rows of every row of a table, without a matrix in the driver.

A metric index over pivots:

1. ``pivots`` rows (fewer in a small table), those with the smallest hashes, are
   the only vectors that the driver sees.  Every row joins the cell of its nearest pivot and keeps its
   distance ``r`` from it.
2. Cells are cut into rings by ``r`` and rings that are still too large (equal
   rows, a third of the table perhaps) by a hash of the key, so that a block has
   about ``block_rows`` rows.  Its entry in the index is (pivot, least r, largest
   r): bounded by ``MAX_BLOCKS``, blocks grow beyond it.
3. Each row finds its k nearest in its own block; the k-th distance bounds what
   it still needs.  By the triangle inequality no row of a block is nearer than
   ``max(d(q, p) - r_max, r_min - d(q, p))``, so the row visits only blocks whose
   bound is within its own.  Queries of a block are dealt in slices.
4. The answers of all visited blocks are merged to the k best.

A block's distances are estimated by one matrix product, and all rows that the
estimate's error leaves possible are computed exactly, so ties go to the smaller
key and the result depends neither on blocks nor on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnguard.session import ensure_checkpoint_dir

MAX_BLOCKS = 1 << 16
#: rows to a pivot at least, queries to a block's visit, rows that a routing task gives out at once
PIVOT_ROWS, VISITS, ROUTED = 2048, 1 << 14, 1 << 13
_ANSWER = "array<struct<d: double, id: long>>"


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def nearest(queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int,
            rows_at_once: int = 1 << 20) -> list[list[tuple[float, int]]]:
    """The k nearest ``(distance, id)`` among ``rows`` of each query, itself
    (by id) left out."""
    size, most = (rows ** 2).sum(axis=1), 0.0
    if len(rows):
        most = float(size.max())
    out = []
    step = max(1, rows_at_once // max(1, len(rows)))
    for lo in range(0, len(queries), step):
        part = queries[lo: lo + step]
        own = (part ** 2).sum(axis=1)
        rough = own[:, None] + size[None, :] - 2.0 * (part @ rows.T)
        for i, (q, me) in enumerate(zip(part, ids[lo: lo + step], strict=True)):
            at = np.arange(len(rows))
            if len(rows) > k + 1:  # one more than k, as the query may be among them
                slack = 1e-12 * len(q) * (own[i] + most)
                at = np.flatnonzero(rough[i] <= np.partition(rough[i], k)[k] + slack)
            at = at[row_ids[at] != me]
            d = np.sqrt(((rows[at] - q) ** 2).sum(axis=1))
            best = np.lexsort((row_ids[at], d))[:k]
            out.append(list(zip(d[best].tolist(), row_ids[at][best].tolist(), strict=True)))
    return out


def _answers(found: list[list[tuple[float, int]]]) -> list[list[dict]]:
    return [[{"d": d, "id": i} for d, i in row] for row in found]


def visits(b: pd.DataFrame, pivots: np.ndarray, names: np.ndarray, cell: np.ndarray, ends: np.ndarray) -> Iterator[pd.DataFrame]:
    """``(block, id, x)`` for each other block that a row has to visit, at most
    ``ROUTED`` at once, as each carries the vector.  Blocks have a name, a cell
    and the least and largest ``r``."""
    out_i, out_b = [], []
    for i, (q, mine, within) in enumerate(zip(b["x"], b["block"], b["within"], strict=True)):
        d = np.sqrt(((pivots - np.asarray(q)) ** 2).sum(axis=1))[cell]
        bound = np.maximum(d - ends[:, 1], ends[:, 0] - d)
        visit = names[(bound <= within + 1e-9 * (d + ends[:, 1])) & (names != mine)]
        out_i += [i] * len(visit)
        out_b += visit.tolist()
        while len(out_i) >= ROUTED or (out_i and i == len(b) - 1):
            now, out_i, block, out_b = out_i[:ROUTED], out_i[ROUTED:], out_b[:ROUTED], out_b[ROUTED:]
            yield pd.DataFrame({"block": block, "id": b["id"].to_numpy()[now], "x": b["x"].to_numpy()[now]})


def knn(points: DataFrame, key: str, x: str, k: int, pivots: int = 256, block_rows: int = 16_384, seed: int = 42) -> DataFrame:
    """``(id, neighbours)``, the k nearest other rows of each row, nearest first,
    ties to the smaller key; all others where there are fewer.  ``key`` is a
    unique whole number, ``x`` an array of finite doubles."""
    spark = points.sparkSession
    ensure_checkpoint_dir(spark)
    points = points.select(F.col(key).cast("long").alias("id"), F.col(x).alias("x"))
    n = points.count()
    pivots = min(pivots, max(1, -(-n // PIVOT_ROWS)))  # a row may have to visit every cell
    draw = F.xxhash64("id", F.lit(seed))
    chosen = points.select("x", draw.alias("h"), "id").orderBy("h", "id").limit(pivots).collect()  # at most ``pivots``
    if not chosen:
        return spark.createDataFrame([], f"id long, neighbours {_ANSWER}")
    centre = np.array([r["x"] for r in chosen], dtype=np.float64)
    at = spark.sparkContext.broadcast(centre)  # ``pivots`` vectors

    def assign(batches):
        p = at.value
        for b in batches:
            if not len(b):
                continue
            m = _matrix(b["x"])
            cell = np.argmin((m ** 2).sum(axis=1)[:, None] + (p ** 2).sum(axis=1)[None, :] - 2.0 * m @ p.T, axis=1)
            yield pd.DataFrame({"id": b["id"], "x": b["x"], "cell": cell, "r": np.sqrt(((m - p[cell]) ** 2).sum(axis=1))})
    dealt = points.mapInPandas(assign, "id long, x array<double>, cell long, r double").checkpoint()
    rows = max(block_rows, -(-2 * n // MAX_BLOCKS))
    cells = dealt.groupBy("cell").agg(F.ceil(F.count("*") / rows).alias("rings"), F.max("r").alias("far"))
    ring = F.when(F.col("far") > 0, F.least(F.floor(F.col("r") / F.col("far") * F.col("rings")), F.col("rings") - 1)).otherwise(0)
    dealt = dealt.join(F.broadcast(cells), "cell").withColumn("ring", ring).drop("rings", "far")  # one row per pivot
    rings = dealt.groupBy("cell", "ring").agg(F.ceil(F.count("*") / rows).alias("parts"))
    part = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.col("parts"))
    code = F.shiftleft("cell", 40).bitwiseOR(F.shiftleft(F.col("ring").cast("long"), 20)).bitwiseOR(part)
    dealt = dealt.join(F.broadcast(rings), ["cell", "ring"]).select("id", "x", "cell", "r", code.alias("block"))  # at most MAX_BLOCKS

    index = np.array(sorted(tuple(r) for r in dealt.groupBy("block").agg(F.min("r"), F.max("r")).collect()))  # at most MAX_BLOCKS
    blocks = index[:, 0].astype(np.int64) if len(index) else np.empty(0, np.int64)
    held = spark.sparkContext.broadcast((blocks, blocks >> 40, index[:, 1:]))

    def own(b: pd.DataFrame) -> pd.DataFrame:
        ids, m = b["id"].to_numpy(), _matrix(b["x"])
        found = nearest(m, ids, m, ids, k)
        return pd.DataFrame({"id": ids, "x": b["x"], "block": b["block"], "neighbours": _answers(found),
                             "within": [f[k - 1][0] if len(f) == k else np.inf for f in found]})
    first = dealt.select("id", "x", "block").groupBy("block").applyInPandas(
        own, f"id long, x array<double>, block long, neighbours {_ANSWER}, within double").checkpoint()

    def route(batches):
        for b in batches:
            yield from visits(b, at.value, *held.value)
    slices = max(1, -(-n // VISITS))
    asked = first.select("id", "x", "block", "within").mapInPandas(route, "block long, id long, x array<double>")
    asked = asked.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)))
    there = dealt.select("block", "id", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"))

    def visit(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if q.empty or b.empty:
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "neighbours": pd.Series([], dtype=object)})
        found = nearest(_matrix(q["x"]), q["id"].to_numpy(), _matrix(b["x"]), b["id"].to_numpy(), k)
        return pd.DataFrame({"id": q["id"], "neighbours": _answers(found)})
    further = (asked.groupBy("block", "slice").cogroup(there.groupBy("block", "slice"))
               .applyInPandas(visit, f"id long, neighbours {_ANSWER}"))
    return (first.select("id", "neighbours").unionByName(further).groupBy("id")
            .agg(F.slice(F.array_sort(F.flatten(F.collect_list("neighbours"))), 1, k).alias("neighbours")))
