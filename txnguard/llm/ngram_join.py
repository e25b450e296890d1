"""Near-duplicate join on word n-grams: MinHash banding, exact verification.

Words are runs of ``[^\\x20\\x09-\\x0D]``; a document is the set of its five-word
shingles (a shorter one: its whole word sequence as the only shingle).  Two
documents are linked when the Jaccard similarity of their sets is >= 0.8.

1. Equal texts form classes; only the smallest id of a class goes on.
2. Each representative gets ``bands * rows`` MinHash values.  The shape is the
   one with the fewest values whose recall ``1-(1-t**rows)**bands`` at the
   threshold reaches the target; the shuffle is on the band hashes.
3. Within a bucket a spanning forest is built of members whose MinHash values
   agree well enough, so a bucket gives at most one row per member, never its
   pairs.  Buckets beyond ``BLOCK`` rows are met block by block, block pairs
   in separate tasks.
4. Components of these forests are bounded candidate clusters.  All pairs
   within one are verified on the full shingle sets by matrix products inside
   tasks (again block by block) which give link counts and forests of the
   verified links.

Defined cases: null, empty and blank texts have no shingles and no link (class
= own id); rows with a null doc_id give no row, as in its SQL; every other row is
a document of its own, also where rows repeat an id with one text or several (class ids
are the ids of rows, so classes may share one then); an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from txnguard.llm.common import U64, batch, components, map_arrow, mix, rolling, stash, text_blocks, words_of

#: Rows of a bucket that one task compares with each other.
BLOCK = 4096
#: Shingles of a cluster that one task verifies on one side.
VERIFY = 1_000_000


def shape(threshold: float, recall: float, rows: int = 5) -> tuple[int, int]:
    """Bands for ``rows`` values a band so that a pair at the threshold shares
    a band with probability ``recall`` at least."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows)), rows


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of one document's word hashes."""
    if not len(hashes):
        return np.empty(0, U64)
    return np.unique(rolling(hashes, min(n, len(hashes))))


def _content_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = pa.schema([("doc_id", pa.int64()), ("ck", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n_words", pa.int64())])
    for b, data, offsets in text_blocks(batches):
        _, _, h, first = words_of(data, offsets)
        k = np.zeros((2, b.num_rows), U64)
        for i in range(b.num_rows):
            if first[i + 1] > first[i]:
                w = h[first[i]: first[i + 1]]
                k[0, i], k[1, i] = rolling(w, len(w))[0], rolling(w, len(w), 1)[0]
        yield batch(out, [b["doc_id"], b["ck"], k[0].view(np.int64), k[1].view(np.int64), np.diff(first)])


def _minhash(n: int, bands: int, rows: int, seed: int):
    mult = mix(np.arange(1, bands * rows + 1, dtype=U64) + U64(seed << 20)) | U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), ("ck", pa.int64()), ("sig", pa.binary()), ("keys", pa.list_(pa.int64()))])
        for b, data, offsets in text_blocks(batches, most=1 << 20):
            _, _, h, first = words_of(data, offsets)
            sets = [shingles(h[first[i]: first[i + 1]], n) for i in range(b.num_rows)]
            full = [i for i, s in enumerate(sets) if len(s)]
            if not full:
                continue
            flat = np.concatenate([sets[i] for i in full])
            at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
            sig = np.empty((len(full), bands * rows), np.uint32)
            tmp = np.empty(len(flat), U64)
            for j, m in enumerate(mult):
                np.multiply(flat, m, out=tmp)
                sig[:, j] = np.minimum.reduceat(tmp, at) >> U64(32)
            keys = np.empty((len(full), bands), U64)
            for band in range(bands):
                k = np.full(len(full), band + 1, U64)
                for j in range(band * rows, band * rows + rows):
                    k = mix(k * U64(31) + sig[:, j].astype(U64))
                keys[:, band] = k
            short = (sig & 0xFFFF).astype(np.uint16)
            ids, ck = (b[c].to_numpy(zero_copy_only=False)[full] for c in ("doc_id", "ck"))
            yield batch(out, [ids, ck, [r.tobytes() for r in short], pa.ListArray.from_arrays(
                pa.array(np.arange(len(full) + 1, dtype=np.int32) * bands), pa.array(keys.ravel().view(np.int64)))])
    return run


def _forest_of(ids: np.ndarray, alike) -> list[tuple[int, int]]:
    """Spanning forest of ``ids`` by breadth-first search; ``alike(i, rest)``
    marks those of ``rest`` that are linked to ``i``."""
    left, out = np.arange(len(ids)), []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = alike(i, left)
            out += [(int(ids[i]), int(ids[k])) for k in left[hit]]
            todo += left[hit].tolist()
            left = left[~hit]
    return out


def _bucket_forest(least: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        sig = np.stack([np.frombuffer(s, np.uint16) for s in pdf["sig"]])
        most = math.floor((1 - least) * sig.shape[1])

        def alike(i, rest):
            return np.count_nonzero(sig[rest] != sig[i], axis=1) <= most
        edges = _forest_of(pdf["doc_id"].to_numpy(), alike)
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")
    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], step: int = 1 << 22) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the
    shingles that occur on both sides, some columns at a time."""
    a, b = np.concatenate(left), np.concatenate(right)
    ra = np.repeat(np.arange(len(left)), [len(x) for x in left])
    rb = np.repeat(np.arange(len(right)), [len(x) for x in right])
    common = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(common):
        return out
    ca, cb = np.searchsorted(common, a), np.searchsorted(common, b)
    ca[ca == len(common)] = 0
    cb[cb == len(common)] = 0
    ka, kb = common[ca] == a, common[cb] == b
    ca, ra, cb, rb = ca[ka], ra[ka], cb[kb], rb[kb]
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ca, ra, cb, rb = ca[oa], ra[oa], cb[ob], rb[ob]
    width = max(64, step // (len(left) + len(right)))
    for lo in range(0, len(common), width):
        hi = min(lo + width, len(common))
        m = []
        for c, r, n in ((ca, ra, len(left)), (cb, rb, len(right))):
            s, e = np.searchsorted(c, (lo, hi))
            x = np.zeros((n, hi - lo), np.float32)
            x[r[s:e], c[s:e] - lo] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


def _verify(n: int, threshold: float, tile: int = 512):
    """All links within a cluster, or between two blocks of one: link counts
    (weighted by the copies of the other side) and a forest of the links."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
        pdf = pdf.sort_values(["side", "doc_id"])
        ids, copies = pdf["doc_id"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64)
        buf, offsets = _join_texts(pdf["text"].tolist())
        _, _, h, first = words_of(buf, offsets)
        sets = [shingles(h[first[i]: first[i + 1]], n) for i in range(len(ids))]
        size = np.array([len(s) for s in sets], np.float32)
        cut = int((pdf["side"].to_numpy() == x).sum()) if x != y else len(ids)
        links = np.zeros(len(ids), np.int64)
        rows, cols = [], []
        lefts = range(0, cut, tile)
        for i in lefts:
            ii = np.arange(i, min(i + tile, cut))
            for j in (range(i, cut, tile) if x == y else range(cut, len(ids), tile)):
                jj = np.arange(j, min(j + tile, cut if x == y else len(ids)))
                both = _overlaps([sets[k] for k in ii], [sets[k] for k in jj])
                hit = both >= np.float32(threshold) * (size[ii][:, None] + size[jj][None, :] - both) - 1e-3
                if x == y and i == j:
                    np.fill_diagonal(hit, False)
                links[ii] += hit @ copies[jj]
                if not (x == y and i == j):
                    links[jj] += hit.T @ copies[ii]
                r, c = _tile_forest(hit, ii, jj)
                rows += r
                cols += c
        a, b = np.minimum(ids[rows], ids[cols]), np.maximum(ids[rows], ids[cols])
        return pd.concat([pd.DataFrame({"kind": "n", "a": ids, "b": links}),
                          pd.DataFrame({"kind": "e", "a": a.astype(np.int64), "b": b.astype(np.int64)})])
    return run


def _tile_forest(hit: np.ndarray, ii: np.ndarray, jj: np.ndarray) -> tuple[list[int], list[int]]:
    """Spanning forest of a bipartite tile of links."""
    todo_r, seen_c, rows, cols = np.flatnonzero(hit.any(1)).tolist(), np.zeros(len(jj), bool), [], []
    seen_r = np.zeros(len(ii), bool)
    for r0 in todo_r:
        if seen_r[r0]:
            continue
        seen_r[r0] = True
        stack = [(0, r0)]
        while stack:
            kind, k = stack.pop()
            if kind == 0:
                new = np.flatnonzero(hit[k] & ~seen_c)
                seen_c[new] = True
                rows += [int(ii[k])] * len(new)
                cols += jj[new].tolist()
                stack += [(1, int(v)) for v in new]
            else:
                new = np.flatnonzero(hit[:, k] & ~seen_r)
                seen_r[new] = True
                rows += ii[new].tolist()
                cols += [int(jj[k])] * len(new)
                stack += [(0, int(v)) for v in new]
    return rows, cols


def _join_texts(texts: list) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def ngram_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, seed: int = 7) -> DataFrame:
    """``(doc_id, class_id, copy_of, n_links)`` for each row: the smallest
    id of its component of links, the smallest id with equal words, and the
    number of documents it is linked to (equal texts included)."""
    bands, rows = shape(threshold, recall)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    docs = docs.withColumn("ck", F.xxhash64("text"))
    keys = stash(map_arrow(docs, _content_keys, "doc_id long, ck long, k1 long, k2 long, n_words long"), "op2-keys")
    # a class of equal words goes on as ``node``, with the text of its smallest (id, hash)
    classes = (keys.filter("n_words > 0").groupBy("k1", "k2")
               .agg(F.min(F.struct("doc_id", "ck", "n_words")).alias("rep"), F.count("*").alias("copies")))
    classes = stash(classes.select("k1", "k2", F.xxhash64("k1", "k2").alias("node"), F.col("rep.doc_id").alias("copy_of"),
                                   F.col("rep.ck").alias("ck"), F.col("rep.n_words").alias("n_words"), "copies"), "op2-classes")

    # MinHash of every text (copies give equal rows, dropped by the join on representatives)
    sigs = map_arrow(docs, _minhash(n, bands, rows, seed), "doc_id long, ck long, sig binary, keys array<long>")
    reps = classes.select(F.col("copy_of").alias("doc_id"), "ck", "node", "copies", "n_words")
    sigs = sigs.join(reps.select("doc_id", "ck", "node"), ["doc_id", "ck"]).dropDuplicates(["node"])
    sigs = stash(sigs.select(F.col("node").alias("doc_id"), "sig", "keys"), "op2-sigs")
    flat = sigs.select("doc_id", F.explode("keys").alias("key"))
    # buckets with the same members give the same forest: one of them goes on
    members = [F.bit_xor(F.xxhash64(F.lit(k), "doc_id")).alias(f"x{k}") for k in (1, 2)]
    shared = flat.groupBy("key").agg(F.count("*").alias("m"), *members).filter("m > 1")
    shared = shared.groupBy("m", "x1", "x2").agg(F.min("key").alias("key")).select("key", "m")
    near = stash(flat.join(shared, "key"), "op2-near")
    hit = near.select("doc_id").distinct()
    rows_ = near.join(sigs.select("doc_id", "sig").join(hit, "doc_id", "left_semi"), "doc_id")
    rows_ = _block_pairs(rows_, "m", BLOCK, "key")
    forest = rows_.groupBy("key", "x", "y").applyInPandas(_bucket_forest(threshold - 0.2), "a long, b long")
    clusters = components(forest.distinct())

    # verify every pair of a cluster on full shingle sets
    sized = clusters.join(reps, "node")
    total = sized.groupBy("root").agg(F.sum("n_words").alias("m"))
    sized = sized.join(total, "root").drop("n_words").join(docs, ["doc_id", "ck"]).dropDuplicates(["node"])
    sized = sized.withColumn("doc_id", F.col("node"))
    sized = _block_pairs(sized, "m", VERIFY, "root")
    found = stash(sized.select("root", "x", "y", "side", "doc_id", "copies", "text")
                  .groupBy("root", "x", "y").applyInPandas(_verify(n, threshold), "kind string, a long, b long"), "op2-links")
    links = found.filter("kind = 'n'").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("near"))
    verified = components(found.filter("kind = 'e'").select("a", "b"))
    names = verified.join(classes.select("node", "copy_of"), "node").groupBy("root").agg(F.min("copy_of").alias("class_id"))
    verified = verified.join(names, "root").select("node", "class_id")
    per = classes.join(links, "node", "left").join(verified, "node", "left").select(
        "k1", "k2", "copy_of", F.coalesce("class_id", "copy_of").alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    full = keys.filter("n_words > 0").join(per, ["k1", "k2"]).select("doc_id", "class_id", "copy_of", "n_links")
    none = keys.filter("n_words = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"),
                                             F.lit(0).cast("long").alias("n_links"))
    return full.unionByName(none)


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies: of each class the row with the smallest
    (doc_id, hash of text) stays, null ids last.  Rows are told apart by a hash of id
    and text, so rows without an id and different texts under one id are each
    judged.  Rows that repeat id and text are one document; of those that differ in
    other columns the one with the smallest hash of all columns stays.  All columns
    travel in one struct, so no name can clash."""
    plain = [f.name for f in docs.schema if not isinstance(f.dataType, MapType)]
    d = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"),
                    F.xxhash64(*[docs[f"`{c}`"] for c in plain]).alias("whole"))
    d = d.withColumn("row_key", F.xxhash64("doc_id", "text_key"))
    classes = ngram_join(d.select(F.col("row_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("row_key"), "class_id").distinct()
    d = d.drop("text")
    # the document that was judged under a key: rows that share the key by chance are kept
    judged = d.groupBy("row_key").agg(F.min(F.struct("text_key", "doc_id")).alias("judged")).join(classes, "row_key")
    order = F.struct(F.col("judged.doc_id").isNull(), F.col("judged.doc_id"), F.col("judged.text_key"), F.col("row_key"))
    kept = judged.groupBy("class_id").agg(F.min_by("row_key", order).alias("row_key")).select("row_key", F.lit(True).alias("kept"))
    judged = judged.join(kept, "row_key", "left").select("row_key", "judged", "kept")
    other = ~(F.col("text_key") == F.col("judged.text_key")) | ~F.col("doc_id").eqNullSafe(F.col("judged.doc_id"))
    d = d.join(judged, "row_key").filter(F.col("kept").isNotNull() | other)
    return d.groupBy("row_key", "doc_id", "text_key").agg(F.min_by("row", "whole").alias("row")).select("row.*")


def _block_pairs(df: DataFrame, size: str, most: int, key: str) -> DataFrame:
    """Deal each group's rows to ``ceil(size/most)`` blocks by a hash of the id
    and send a block once to each pair of blocks it is part of: ``x <= y`` name
    the pair, ``side`` the row's block."""
    nb = F.ceil(F.col(size) / F.lit(most)).cast("int")
    df = df.withColumn("side", F.pmod(F.xxhash64("doc_id"), nb).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), nb - 1)))
    return df.withColumn("x", F.least("side", "other")).withColumn("y", F.greatest("side", "other")).drop("other")
