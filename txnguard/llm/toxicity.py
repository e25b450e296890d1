"""Toxicity by the nearest labelled examples.

Texts are bags of lower-case words and of the first three to eight letters of
longer words (inflected and compounded forms share them).  The vocabulary is
what the chi-squared statistic ties to the label most, of the terms that mostly
stand in toxic examples; it is chosen on two thirds of the examples.  Each of the labelled
examples (a bounded sample) is a TF-IDF vector of unit length.  A text's ``k``
nearest examples by exact cosine come from an inverted index with block
maxima: the bound of a block of examples is the sum of the query weights times
the block's largest weight per term; blocks are read in descending order of
their bounds until the next bound is below the k-th best cosine, so no skipped
example could enter.  The neighbours vote by 1 / (distance + eps); isotonic
regression on leave-one-out votes of the other third turns votes into calibrated
scores.  The nearest examples are returned as evidence.

Bounds: ``examples`` labelled rows (smallest id hashes first), ``terms`` words.
Words are counted over all of that sample by Spark; every text is scored whole.

Defined cases: null and empty texts and texts without a known term have no
neighbour and get the calibrated rate of such examples; without labelled rows
every score is 0; labels that are null are ignored; where a doc_id is labelled
twice the greater label holds; repeated rows are each scored; an empty table
gives an empty result.  Extra columns stay, but for those named as the results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnguard.llm.common import map_arrow, stash, unstash

_WORD = re.compile(r"[^\W\d_]+")
EPS = 0.05
BLOCK = 64
BEGINNINGS = range(3, 9)
#: Words whose terms a task remembers.
REMEMBERED = 100_000
RESULT = "score double, votes double, evidence array<struct<doc_id:bigint,toxic:int,cosine:double>>"


def words_of(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def parts_of(word: str) -> list[str]:
    """A word and its beginnings (marked by a trailing ``*``)."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


def terms_of(text: str | None) -> Counter:
    out: Counter = Counter()
    for w, n in words_of(text).items():
        for t in parts_of(w):
            out[t] += n
    return out


class BlockMaxIndex:
    """Inverted index of unit vectors with the largest weight of each term in
    each block of ``BLOCK`` examples."""

    def __init__(self, ids: list[int], toxic: list[int], bags: list[dict[int, int]], idf: np.ndarray):
        # similar examples side by side, so that blocks differ in their maxima
        order = sorted(range(len(ids)), key=lambda i: (toxic[i], max(bags[i], key=lambda t: (bags[i][t], t)), ids[i]))
        self.ids, self.toxic, self.idf = np.array(ids)[order], np.array(toxic)[order], idf
        blocks = -(-len(order) // BLOCK)
        rows: list[list[tuple[int, float]]] = [[] for _ in idf]
        for row, i in enumerate(order):
            for t, w in zip(*self.vector(bags[i]), strict=True):
                rows[t].append((row, w))
        self.top = np.zeros((len(idf), blocks), np.float64)
        self.at = np.zeros((len(idf), blocks + 1), np.int64)
        n, docs, weights = 0, [], []
        for t, r in enumerate(rows):
            d = np.array([x[0] for x in r], np.int64)
            w = np.array([x[1] for x in r], np.float64)
            np.maximum.at(self.top[t], d // BLOCK, w)
            self.at[t] = n + np.searchsorted(d, np.arange(blocks + 1) * BLOCK)
            docs.append(d)
            weights.append(w)
            n += len(r)
        self.docs, self.weights = np.concatenate(docs), np.concatenate(weights)

    def vector(self, bag: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        t = np.array(sorted(bag), np.int64)
        w = (1 + np.log(np.array([bag[i] for i in t], float))) * self.idf[t]
        return t, w / np.sqrt((w * w).sum())

    def search(self, bag: dict[int, int], k: int, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the ``k`` nearest with a cosine above 0, exactly;
        equal cosines by row."""
        t, w = self.vector(bag)
        bound = w @ self.top[t]
        best = np.empty((2, 0))
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or best.shape[1] == k and bound[b] < best[0, -1] - 1e-12:
                break
            s = np.zeros(BLOCK)
            for term, q in zip(t, w, strict=True):
                lo, hi = self.at[term, b], self.at[term, b + 1]
                if lo < hi:
                    s[self.docs[lo:hi] - b * BLOCK] += q * self.weights[lo:hi]
            hit = np.flatnonzero(s > 0)
            if skip is not None:
                hit = hit[self.ids[hit + b * BLOCK] != skip]
            both = np.concatenate([best, np.stack([s[hit], hit + b * BLOCK])], axis=1)
            best = both[:, np.lexsort((both[1], -both[0]))[:k]]
        return best[1].astype(np.int64), best[0]


class Scorer:
    """Index, vocabulary and calibration; small enough to send to every task
    by the bounds on examples and terms."""

    def __init__(self, vocabulary: list[str], index: BlockMaxIndex | None, k: int):
        self.place, self.index, self.k = {w: i for i, w in enumerate(vocabulary)}, index, k
        self.seen: dict[str, tuple[int, ...]] = {}
        self.edges, self.rates, self.alone = np.array([0.0]), np.array([0.0]), 0.0

    def neighbours(self, text: str | None, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        bag: dict[int, int] = {}
        if len(self.seen) > REMEMBERED:
            self.seen = {}
        for w, n in words_of(text).items():
            terms = self.seen.get(w)
            if terms is None:
                terms = self.seen[w] = tuple(self.place[t] for t in parts_of(w) if t in self.place)
            for t in terms:
                bag[t] = bag.get(t, 0) + n
        if not bag or self.index is None:
            return np.empty(0, np.int64), np.empty(0)
        return self.index.search(bag, self.k, skip)

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float | None:
        """Share of toxic among the neighbours, by 1 / (distance + EPS)."""
        if not len(rows):
            return None
        w = 1 / (np.maximum(1 - cosines, 0) + EPS)
        return float((w * self.index.toxic[rows]).sum() / w.sum())

    def calibrate(self, votes: list[tuple[float | None, int, int]]) -> None:
        """Isotonic regression (pool adjacent violators) on (vote, label,
        count); one more example of either label is added to each pool's ends."""
        none = [(y, n) for v, y, n in votes if v is None]
        self.alone = (sum(y * n for y, n in none) + 0.5) / (sum(n for _, n in none) + 10)
        pools: list[list[float]] = []
        for v in sorted({v for v, _, _ in votes if v is not None}):
            n = sum(c for u, _, c in votes if u == v)
            pools.append([v, sum(y * c for u, y, c in votes if u == v), n, v])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                last = pools.pop()
                pools[-1] = [pools[-1][0], pools[-1][1] + last[1], pools[-1][2] + last[2], last[3]]
        if pools:
            self.edges = np.array([x for p in pools for x in (p[0], p[3])])
            self.rates = np.array([(p[1] + 0.25) / (p[2] + 0.5) for p in pools for _ in (0, 1)])

    def score(self, vote: float | None) -> float:
        return self.alone if vote is None else float(np.interp(vote, self.edges, self.rates))


def fit(docs: DataFrame, labels: DataFrame, examples: int = 12_000, terms: int = 2_000, k: int = 15, least_chi2: float = 45.0, least_rate: float = 0.75) -> Scorer:
    """Builds the index from ``docs (doc_id, text)`` and ``labels (doc_id,
    toxic)``; only rows that may be learned from are to be passed."""
    lab = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    ids = docs.select("doc_id").join(lab, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)

    def bags(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            c = [terms_of(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["toxic"], pa.array([[*x.items()] for x in c], pa.map_(pa.string(), pa.int64()))],
                                             names=["doc_id", "toxic", "bag"])
    # the ids are at most `examples`: sent to the texts instead of shuffling all texts
    d = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "text").dropDuplicates(["doc_id"])
    d = stash(map_arrow(d, bags, "doc_id long, toxic int, bag map<string,bigint>")
              .withColumn("aside", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(3)) == 0), "op1-bags")
    choose = d.filter("not aside")
    sizes = {r["toxic"]: r["count"] for r in choose.groupBy("toxic").count().collect()}
    n1, n = sizes.get(1, 0), sum(sizes.values())
    if not n1 or n1 == n:
        s = Scorer([], None, k)
        s.alone = float(n1 > 0)
        return s
    df = choose.select("toxic", F.explode(F.map_keys("bag")).alias("t")).groupBy("t").agg(F.sum("toxic").alias("a"), F.count("*").alias("m")).filter("m >= 3")
    a, m = F.col("a").cast("double"), F.col("m").cast("double")
    chi2 = (a * n - m * n1) ** 2 * n / (m * (n - m + 0.5) * n1 * (n - n1))
    chosen = df.withColumn("chi2", chi2).filter((F.col("chi2") > least_chi2) & (F.col("a") >= least_rate * F.col("m"))).orderBy(F.desc("chi2"), "t").limit(terms).collect()
    vocabulary = [r["t"] for r in chosen]
    keep = F.map_filter("bag", lambda t, c: t.isin(vocabulary)) if vocabulary else F.map_filter("bag", lambda t, c: F.lit(False))
    rows = d.select("doc_id", "toxic", keep.alias("bag")).filter(F.size("bag") > 0).orderBy("doc_id").collect()
    place = {w: i for i, w in enumerate(vocabulary)}
    idf = np.log(1 + n / np.array([r["m"] for r in chosen], float)) if chosen else np.empty(0)
    index = BlockMaxIndex([r["doc_id"] for r in rows], [r["toxic"] for r in rows],
                          [{place[t]: c for t, c in r["bag"].items()} for r in rows], idf) if rows else None  # all examples
    model = Scorer(vocabulary, index, k)

    def left_out(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            votes = []
            for i, bag in zip(p["doc_id"].to_pylist(), p["bag"].to_pylist(), strict=True):
                known = {model.place[t]: c for t, c in dict(bag).items() if t in model.place}
                v = model.vote(*model.index.search(known, model.k, int(i))) if known and model.index is not None else None
                votes.append(None if v is None else round(v, 2))
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), p["toxic"]], names=["vote", "toxic"])
    votes = map_arrow(d.filter("aside").select("doc_id", "toxic", "bag"), left_out, "vote double, toxic int").groupBy("vote", "toxic").count().collect()
    model.calibrate([(r["vote"], r["toxic"], r["count"]) for r in votes])
    unstash(d)
    return model


def keep_below(docs: DataFrame, model: Scorer, limit: float) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, all columns as they are,
    as a written table: the model is then taken from the workers again."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rest = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("rest") if len(docs.columns) > 1 else F.struct(F.lit(0)).alias("rest")
    scored = score(docs.select("text", rest), model, sent=sent).filter(F.col("score") < limit)
    out = stash(scored.select(*[F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns]), "op1-kept")
    sent.destroy()
    return out


def score(docs: DataFrame, model: Scorer, evidence: int = 3, sent: Broadcast | None = None) -> DataFrame:
    """``docs`` plus ``score``, ``votes`` and ``evidence`` for every text;
    ``sent`` is the model's broadcast, if the caller made it."""
    docs = docs.drop("score", "votes", "evidence")
    added = T._parse_datatype_string(RESULT)
    sent = sent or docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        m.seen = {}
        for b in parts:
            votes, scores, seen = [], [], []
            for t in b["text"].to_pylist():
                rows, cos = m.neighbours(t)
                votes.append(m.vote(rows, cos))
                scores.append(m.score(votes[-1]))
                seen.append([{"doc_id": int(m.index.ids[r]), "toxic": int(m.index.toxic[r]), "cosine": float(c)}
                             for r, c in zip(rows[:evidence], cos[:evidence], strict=True)])
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array(votes, pa.float64()), pa.array(seen, kind)],
                                             names=[*b.schema.names, "score", "votes", "evidence"])
        m.seen = {}  # the worker keeps what was broadcast, not the task's words
    return map_arrow(docs, run, T.StructType([*docs.schema.fields, *added.fields]))
