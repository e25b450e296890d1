"""Approximate nearest neighbours by an inverted multi-index.

The two halves of the vectors are quantised separately (k-means on a bounded
sample), a cell is a pair of centroids, and every valid row is indexed by its
cell.  A query walks the cells by the summed distance of its halves to the
centroids, taken from a heap, until the cells hold ``share`` of all rows, and
the rows of these cells are reranked by exact distance on the whole vectors.

``share`` is the least that reaches ``recall`` on queries out of the sample
against brute force; it is small where vectors cluster and large where they
don't.  Cells are gathered into blocks of about ``block`` rows; a cell beyond
that is split over several by id, and so is a block's query side.  A task holds
one block and one slice of queries; it returns the ``k`` best of each.

Defined cases: vectors that are null, zero, hold null or non-finite components
or have another length than most take no part; equal distances are ordered by
id; fewer than ``k`` candidates give fewer rows; repeated ids are rows of their
own, never candidates for themselves; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnguard.llm.common import stash


def valid(col: str) -> Column:
    """True where the vector takes part."""
    finite = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(col).isNotNull() & finite & F.exists(col, lambda x: x != 0), F.lit(False))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, at, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([squares(x[i: i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])


class MultiIndex:
    """Centroids of both halves and the rows in each cell."""

    def __init__(self, sample: np.ndarray, k: int):
        self.cut = sample.shape[1] // 2
        self.c = [kmeans(h, k) for h in self.halves(sample)]
        self.counts = np.zeros(0, np.int64)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.cut], x[:, self.cut:]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (nearest(h, c) for h, c in zip(self.halves(x), self.c, strict=True))
        return a * len(self.c[1]) + b

    def walk(self, q: np.ndarray, rows: float) -> list[int]:
        """Cells by summed half distance until they hold ``rows`` rows."""
        d = [squares(h, c)[0] for h, c in zip(self.halves(q[None]), self.c, strict=True)]
        o = [np.argsort(x, kind="stable") for x in d]
        heap, seen, out, have = [(d[0][o[0][0]] + d[1][o[1][0]], 0, 0)], {(0, 0)}, [], 0
        while heap and have < rows:
            _, i, j = heapq.heappop(heap)
            cell = int(o[0][i]) * len(self.c[1]) + int(o[1][j])
            if self.counts[cell]:
                out.append(cell)
                have += self.counts[cell]
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < len(o[0]) and b < len(o[1]) and (a, b) not in seen:
                    seen.add((a, b))
                    heapq.heappush(heap, (d[0][o[0][a]] + d[1][o[1][b]], a, b))
        return out

    def least_share(self, sample: np.ndarray, k: int, recall: float, queries: int = 200) -> float:
        """Share of the rows to walk so that ``recall`` of the true ``k``
        nearest of queries from the sample are met."""
        cells = self.cells(sample)
        self.counts = np.bincount(cells, minlength=len(self.c[0]) * len(self.c[1]))
        need = []
        for i in range(0, len(sample), max(1, len(sample) // queries)):
            d = ((sample - sample[i]) ** 2).sum(1)
            d[i] = np.inf
            order = self.walk(sample[i], np.inf)
            met = dict(zip(order, np.cumsum(self.counts[order]), strict=True))
            need += [met[c] for c in cells[np.argsort(d, kind="stable")[: min(k, len(d) - 1)]]]
        return min(1.0, float(np.quantile(need, recall)) / len(sample)) if need else 1.0


def _stack(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), np.float64)


def search(rows: DataFrame, is_query: Column, k: int = 10, recall: float = 0.95, sample: int = 12_000,
           block: int = 8192, slice_: int = 8192) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows of ``rows (vec_id,
    embedding)`` that are queries; ``sample`` bounds the rows fitted on."""
    spark = rows.sparkSession
    rows = rows.filter(F.col("vec_id").isNotNull() & valid("embedding")).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("q"))
    lens = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not lens:
        return empty
    dim, total = lens[0]["n"], lens[0]["count"]
    rows = rows.filter(F.size("v") == dim)
    if dim < 2:
        rows = rows.withColumn("v", F.concat("v", F.array(F.lit(0.0))))
    fit = _stack(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()["v"])
    index = MultiIndex(fit, max(2, min(128, round(2 * total ** 0.25), len(fit))))
    share = index.least_share(fit, k, recall)

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                yield p.assign(cell=index.cells(_stack(p["v"])))
    placed = stash(rows.mapInPandas(assign, "vec_id long, v array<double>, q boolean, cell long"), "op8-cells")
    index.counts = np.zeros(len(index.c[0]) * len(index.c[1]), np.int64)
    for r in placed.groupBy("cell").count().collect():  # at most 128 * 128 cells
        index.counts[r["cell"]] = r["count"]
    # cells to blocks: the first block and the number of blocks of each
    first, parts, b, room = {}, {}, 0, block
    for cell in np.flatnonzero(index.counts):
        n = int(index.counts[cell])
        if n > room and room < block:
            b, room = b + 1, block
        first[int(cell)], parts[int(cell)] = b, max(1, -(-n // block))
        if n > block:
            b, room = b + parts[int(cell)], block
        else:
            room -= n

    def visits(parts_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts_:
            out = []
            for i, v in zip(p["vec_id"], p["v"], strict=True):
                to: dict[int, list[int]] = {}
                for c in index.walk(np.asarray(v), max(share * total, 3 * k)):
                    for x in range(first[c], first[c] + parts[c]):
                        to.setdefault(x, []).append(c)
                out += [(i, v, x, cs) for x, cs in to.items()]
            yield pd.DataFrame(out, columns=["query_id", "v", "block", "cells"])
    asked = placed.filter("q").select("vec_id", "v").dropDuplicates(["vec_id", "v"]).mapInPandas(visits, "query_id long, v array<double>, block int, cells array<long>")
    asked = stash(asked.withColumn("query", F.xxhash64("query_id", "v")), "op8-visits")
    load = asked.groupBy("block").agg(F.ceil(F.count("*") / slice_).cast("int").alias("slices"))
    table = spark.createDataFrame([(c, first[c], parts[c]) for c in first], "cell long, first int, parts int")
    at = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    have = (placed.select("vec_id", "v", "cell").join(table, "cell").withColumn("block", at).join(load, "block")
            .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select("block", "slice", "cell", "vec_id", "v"))
    asked = asked.join(load, "block").withColumn("slice", F.pmod(F.col("query"), F.col("slices")).cast("int"))

    def rerank(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(x):
            x = x.sort_values("vec_id")
            ids, cells, m = x["vec_id"].to_numpy(), x["cell"].to_numpy(), _stack(x["v"])
            for i, key, v, cs in zip(q["query_id"], q["query"], q["v"], q["cells"], strict=True):
                at = np.flatnonzero(np.isin(cells, cs) & (ids != i))
                if len(at):
                    d = np.sqrt(((m[at] - np.asarray(v)) ** 2).sum(1))
                    best = np.lexsort((ids[at], d))[:k]
                    out += list(zip([i] * len(best), [key] * len(best), ids[at][best], d[best], strict=True))
        return pd.DataFrame(out, columns=["query_id", "query", "vec_id", "score"]).astype({"query_id": "int64", "query": "int64", "vec_id": "int64", "score": "float64"})
    best = (asked.select("block", "slice", "query_id", "query", "v", "cells").groupBy("block", "slice")
            .cogroup(have.groupBy("block", "slice")).applyInPandas(rerank, "query_id long, query long, vec_id long, score double"))
    # at most k rows per query and block
    ranked = F.slice(F.sort_array(F.collect_list(F.struct("score", "vec_id"))), 1, k)
    best = best.groupBy("query_id", "query").agg(ranked.alias("found")).select("query_id", F.posexplode("found").alias("rank", "f"))
    return best.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "f.vec_id", "f.score")
