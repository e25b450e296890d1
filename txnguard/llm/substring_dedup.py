"""Substring dedup by relative Lempel-Ziv parsing over words.

Every document is parsed against all documents with smaller ids.  The index
is made of reference blocks: the anchor (smallest ten-word hash) of each run
of windows deals a document into segments, and a block holds all segments with
the same anchor, from every document.  Two equal ``size``-word windows have the
same anchor at the same place, so each window meets in one block every text it
could equal.

1. A segment whose whole content stands in an earlier document is one factor,
   found by ``min(doc_id)`` over its 128-bit content hash.
2. Segments that share their anchor, not their content, hold factor
   boundaries.  For the first document of each such content every window is
   looked up on its own (128-bit hash, ``min(doc_id)``), so no window that
   lies across a boundary of two factors is missed.
3. Per document the covered windows are merged greedily from the left into
   factors of at least ``size`` words; their words are removed.

Everything grows linearly: no pair of documents is ever emitted, and hot
passages are minima combined before the shuffle.

Defined cases: null, empty or shorter texts than ``size`` words lose nothing;
rows that repeat a doc_id are each parsed against smaller ids only; rows with a
null doc_id stay whole and are no source, as in its SQL (null is never smaller); an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnguard.llm.common import _ROLL, U64, batch, map_arrow, mix, rolling, spans, stash, text_blocks, unstash, words_of

ANCHOR_WORDS = 10


def anchors(keys: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest key in each run of ``width`` keys."""
    value, place, have = keys, np.arange(len(keys)), 1
    while have < width:
        step = min(have, width - have)
        a, b = value[:-step], value[step:]
        later = b < a
        value = np.where(later, b, a)
        place = np.where(later, place[step:], place[:-step])
        have += step
    return place


def _segments(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), ("ck", pa.int64()), ("anchor", pa.int64()), ("c1", pa.int64()),
                         ("c2", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
        for b, data, offsets in text_blocks(batches):
            _, _, h, bounds = words_of(data, offsets)
            n = np.diff(bounds)
            if not (n >= size).any():
                continue
            keys = rolling(h, ANCHOR_WORDS)
            place = anchors(keys, size - ANCHOR_WORDS + 1)  # of the window that starts at each word
            windows = np.maximum(n - size + 1, 0)
            at = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
            row = np.repeat(np.arange(b.num_rows), windows)
            p = place[at]
            new = np.concatenate([[True], (p[1:] != p[:-1]) | (row[1:] != row[:-1])])
            s = np.flatnonzero(new)
            first, last, row, p = at[s], at[np.concatenate([s[1:] - 1, [len(at) - 1]])], row[s], p[s]
            h2 = mix(h + U64(0x632BE59BD9B4E019))
            shape = mix((p - first).astype(U64) << U64(32) | (last - first).astype(U64))
            content = [mix(spans(v, first, last + size, w) ^ shape).view(np.int64) for v, w in zip((h, h2), _ROLL, strict=True)]
            ids, ck = (b[c].to_numpy(zero_copy_only=False)[row] for c in ("doc_id", "ck"))
            base = bounds[:-1][row]
            yield batch(out, [ids, ck, keys[p].view(np.int64), *content, first - base, last - base])
    return run


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), ("ck", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64()), ("at", pa.int64())])
        for b, data, offsets in text_blocks(batches):
            _, _, h, bounds = words_of(data, offsets)
            w = [rolling(h, size, k).view(np.int64) for k in (0, 1)]
            row, at = _unpack(b["parts"])
            abs_at = at + bounds[row]
            ids, ck = (b[c].to_numpy(zero_copy_only=False)[row] for c in ("doc_id", "ck"))
            yield batch(out, [ids, ck, w[0][abs_at], w[1][abs_at], at])
    return run


def _unpack(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of each window in a column of lists of (first, last)."""
    lens = np.asarray([0 if v is None else v for v in pa.compute.list_value_length(col).to_pylist()], np.int64)
    flat = col.flatten()
    first, last = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    n = last - first + 1
    row = np.repeat(np.repeat(np.arange(len(col)), lens), n)
    at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else first, n) + np.arange(n.sum())
    return row, at


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
                         ("factors", pa.list_(pa.list_(pa.int64())))])
        for b, data, offsets in text_blocks(batches):
            starts, ends, _, bounds = words_of(data, offsets)
            drop = np.zeros(len(starts) + 1, np.int32)
            row, at = _unpack(b["parts"])
            np.add.at(drop, at + bounds[row], 1)
            np.add.at(drop, np.minimum(at + bounds[row] + size, len(starts)), -1)
            gone = np.cumsum(drop[:-1]) > 0
            buf = np.concatenate([data, np.zeros(1, np.uint8)])
            kept, factors = [], []
            for i in range(b.num_rows):
                a, z = bounds[i], bounds[i + 1]
                g = gone[a:z]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
                factors.append(edge.reshape(-1, 2).tolist())
                s, e = starts[a:z][~g], ends[a:z][~g]
                if not len(s):
                    kept.append("")
                    continue
                lo, hi = s[0], e[-1]
                mark = np.zeros(hi - lo + 2, np.int8)
                np.add.at(mark, s - lo, 1)
                np.add.at(mark, e + 1 - lo, -1)
                text = buf[lo: hi + 1].copy()
                text[e - lo] = 32
                kept.append(text[np.cumsum(mark[:-1]) > 0][:-1].tobytes().decode())
            n = np.diff(bounds)
            lost = np.array([int(gone[bounds[i]: bounds[i + 1]].sum()) for i in range(b.num_rows)], np.int64)
            yield batch(out, [b["doc_id"], n, lost, kept, factors])
    return run


def substring_dedup(docs: DataFrame, size: int = 50) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept, factors)`` per row of ``docs``:
    ``kept`` the words that stay, joined by one blank; ``factors`` the removed
    runs as ``[first word, end word)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("ck", F.xxhash64("text"))
    every, docs = docs, docs.filter("doc_id is not null")
    segs = stash(map_arrow(docs, _segments(size), "doc_id long, ck long, anchor long, c1 long, c2 long, first long, last long"), "op6-segments")
    content = segs.groupBy("anchor", "c1", "c2").agg(F.min("doc_id").alias("source"), F.count("*").alias("times"))
    content = stash(content, "op6-contents")
    block = content.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("times").alias("n")).filter("n > 1")
    some = content.join(block.select("anchor", "kinds"), "anchor").select("anchor", "c1", "c2", "source", "kinds")
    state = segs.join(some, ["anchor", "c1", "c2"]).filter("source < doc_id or source = doc_id and kinds > 1")
    state = stash(state.select("doc_id", "ck", "first", "last", "source", "kinds"), "op6-state")
    unstash(segs, content)
    whole = state.filter("source < doc_id")
    edge = state.filter("source = doc_id and kinds > 1")
    parts = edge.groupBy("doc_id", "ck").agg(F.collect_list(F.struct("first", "last")).alias("parts"))
    w = stash(map_arrow(docs.join(parts, ["doc_id", "ck"]).dropDuplicates(["doc_id", "ck"]), _windows(size),
                        "doc_id long, ck long, w1 long, w2 long, at long"), "op6-windows")
    seen = w.groupBy("w1", "w2").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("newest")).filter("source < newest")
    found = w.join(seen, ["w1", "w2"]).filter("source < doc_id").select("doc_id", "ck", F.col("at").alias("first"), F.col("at").alias("last"))
    cover = (whole.select("doc_id", "ck", "first", "last").union(found)
             .groupBy("doc_id", "ck").agg(F.collect_set(F.struct("first", "last")).alias("parts")))
    cover = stash(cover, "op6-cover")
    unstash(state, w)
    return map_arrow(every.join(cover, ["doc_id", "ck"], "left").select("doc_id", "text", "parts"), _cut(size),
                     "doc_id long, n_words long, n_removed long, kept string, factors array<array<long>>")
