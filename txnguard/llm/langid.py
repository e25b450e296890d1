"""Language identification by a bidirectional gated recurrent network over
bytes.

A minimal gated unit runs over the bytes in both directions:
``z = gate(Wz[x] + Uz h)``, ``c = squash(Wc[x] + Uc h)``, ``h += z (c - h)``
with ``squash(a) = a / (1 + |a|)`` and ``gate = (1 + squash) / 2``, which cost
no exponentials.  Every byte position is labelled by a softmax over both
states; a document's probabilities are the mean over its positions.  Texts of
any length are read whole, in segments of ``SEGMENT`` bytes.

Training: backpropagation through time in numpy on the driver, on at most
``per_lang`` documents of every language (smallest id hashes first) and one
segment-wide stretch of ``EXCERPT`` characters of each, a bound that grows with
the number of languages only.  Every distinct non-null lang of the learned rows
is a class; beyond ``CLASSES`` of them the column holds no languages, and
``train`` refuses.  Beyond 32 classes states and steps grow with the classes.

Defined cases: null texts and texts without a letter give ``und`` with score 0;
rows with null lang are never learned from; with no labelled row at all every
text is ``und``; repeated rows are each predicted; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnguard.llm.common import batch, map_arrow, text_blocks

SEGMENT = 96
EXCERPT = 400
HIDDEN = 8
#: Labels beyond this number are refused.
CLASSES = 1000


def squash(a: np.ndarray) -> np.ndarray:
    return a / (1 + np.abs(a))


class ByteNet:
    """The network.  ``w`` holds, per direction, the byte table (2H x 256) and
    the recurrent matrix (2H x H; rows: gate, candidate), and the output
    matrices (classes x H) and bias."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.h, self.k = hidden, classes
        self.w = {}
        for d in "fb":
            self.w["E" + d] = rng.normal(0, 0.5, (2 * hidden, 256)).astype(np.float32)
            self.w["U" + d] = rng.normal(0, 0.3, (2 * hidden, hidden)).astype(np.float32)
            self.w["V" + d] = rng.normal(0, 0.3, (classes, hidden)).astype(np.float32)
        self.w["b"] = np.zeros((classes, 1), np.float32)

    def states(self, x: np.ndarray, d: str, keep: bool = False):
        """States (T, H, B) of byte columns ``x`` (T, B) in direction ``d``."""
        h, (t_max, n) = self.h, x.shape
        e, u = self.w["E" + d], self.w["U" + d]
        out = np.empty((t_max + 1, h, n), np.float32)
        out[0] = 0
        pre, tmp, rec = (np.empty((2 * h, n), np.float32) for _ in range(3))
        acts = np.empty((t_max, 2 * h, n), np.float32) if keep else None
        for i in range(t_max):
            np.take(e, x[i if d == "f" else t_max - 1 - i], axis=1, out=pre, mode="clip")
            np.matmul(u, out[i], out=rec)
            pre += rec
            if keep:
                acts[i] = pre
            np.abs(pre, out=tmp)
            tmp += 1
            pre /= tmp
            z, c, new = pre[:h], pre[h:], out[i + 1]
            z += 1
            z *= 0.5
            np.subtract(c, out[i], out=new)
            new *= z
            new += out[i]
        return (out, acts) if keep else out

    def pooled(self, x: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Sum of the label probabilities of each column's first ``lens``
        positions: (classes, B)."""
        hf, hb = self.states(x, "f"), self.states(x, "b")
        t_max, n = x.shape
        total, p, q = (np.zeros((self.k, n), np.float32) for _ in range(3))
        for t in range(t_max):
            np.matmul(self.w["Vf"], hf[t + 1], out=p)
            np.matmul(self.w["Vb"], hb[t_max - t], out=q)
            p += q
            p += self.w["b"]
            np.exp(p, out=p)  # states are within (-1, 1): no overflow
            p /= p.sum(0)
            if t >= 1 and (lens <= t).any():
                p *= lens > t
            total += p
        return total

    def gradients(self, x: np.ndarray, y: np.ndarray, lens: np.ndarray) -> tuple[float, dict]:
        """Loss (mean cross-entropy of the positions) and its gradients, by
        backpropagation through time."""
        t_max, n = x.shape
        h = self.h
        live = (np.arange(t_max)[:, None] < lens).astype(np.float32)
        scale = 1 / live.sum()
        st = {d: self.states(x, d, keep=True) for d in "fb"}
        pos = {"f": [t + 1 for t in range(t_max)], "b": [t_max - t for t in range(t_max)]}
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        dh = {d: np.zeros((t_max + 1, h, n), np.float32) for d in "fb"}
        loss, cols = 0.0, np.arange(n)
        for t in range(t_max):
            o = self.w["b"] + sum(self.w["V" + d] @ st[d][0][pos[d][t]] for d in "fb")
            o = np.exp(o - o.max(0))
            o /= o.sum(0)
            loss -= float((np.log(o[y, cols] + 1e-9) * live[t]).sum()) * scale
            o[y, cols] -= 1
            o *= live[t] * scale
            g["b"] += o.sum(1, keepdims=True)
            for d in "fb":
                g["V" + d] += o @ st[d][0][pos[d][t]].T
                dh[d][pos[d][t]] += self.w["V" + d].T @ o
        for d in "fb":
            out, acts = st[d]
            u, back = self.w["U" + d], np.zeros((h, n), np.float32)
            gt = np.zeros((256, 2 * h), np.float32)
            for i in range(t_max - 1, -1, -1):
                a = acts[i]
                s = squash(a)
                z, c, old = (s[:h] + 1) / 2, s[h:], out[i]
                new = dh[d][i + 1] + back
                da = np.concatenate([new * (c - old) / 2, new * z]) / (1 + np.abs(a)) ** 2
                g["U" + d] += da @ old.T
                np.add.at(gt, x[i if d == "f" else t_max - 1 - i], da.T)
                back = new * (1 - z) + u.T @ da
            g["E" + d] = gt.T
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, lens: np.ndarray, steps: int = 240, size: int = 256, rate: float = 0.02, seed: int = 2) -> list[float]:
        """Adam on random batches of segment columns; returns the losses."""
        rng = np.random.default_rng(seed)
        m, v, losses = ({k: np.zeros_like(a) for k, a in self.w.items()} for _ in range(2)), None, []
        m, v = m
        for step in range(1, steps + 1):
            at = rng.integers(0, x.shape[1], size)
            loss, g = self.gradients(x[:, at], y[at], lens[at])
            losses.append(loss)
            r = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, a in self.w.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                a -= (r * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
        return losses


def columns(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of concatenated texts as byte columns (T, B), their lengths and
    the text each is from."""
    n = np.diff(offsets)
    parts = -(-n // SEGMENT)
    doc = np.repeat(np.arange(len(n)), parts)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = offsets[:-1][doc] + k * SEGMENT
    lens = np.minimum(SEGMENT, offsets[1:][doc] - start)
    padded = np.concatenate([data, np.full(SEGMENT, 32, np.uint8)])
    x = np.lib.stride_tricks.sliding_window_view(padded, SEGMENT)[start].T.copy() if len(start) else np.empty((SEGMENT, 0), np.uint8)
    x[np.arange(SEGMENT)[:, None] >= lens] = 32
    return x, lens, doc


def _predict(net: ByteNet, langs: list[str], width: int = 2048):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
        for b, data, offsets in text_blocks(batches, most=1 << 21):
            x, lens, doc = columns(data, offsets)
            order = np.argsort(-lens, kind="stable")
            total = np.zeros((b.num_rows, net.k))
            for i in range(0, len(order), width):
                at = order[i: i + width]
                np.add.at(total, doc[at], net.pooled(np.ascontiguousarray(x[: lens[at[0]], at]), lens[at]).T)
            total /= np.maximum(np.diff(offsets), 1)[:, None]
            best = total.argmax(1)
            letter = [any(map(str.isalpha, t or "")) for t in b["text"].to_pylist()]
            yield batch(out, [b["doc_id"], b["held_out"], [langs[k] if ok else "und" for k, ok in zip(best, letter, strict=True)],
                              [float(min(1.0, total[i, k])) if letter[i] else 0.0 for i, k in enumerate(best)]])
    return run


def train(labelled: DataFrame, per_lang: int = 300) -> tuple[ByteNet | None, list[str]]:
    """Fits on ``labelled (doc_id, text, lang)``; at most ``per_lang`` rows of
    each language come to the driver, an excerpt of each."""
    rows = labelled.filter("text is not null and lang is not null and length(text) > 0")
    counts = rows.groupBy("lang").count()
    langs = {r["lang"]: r["count"] for r in counts.orderBy(F.desc("count"), "lang").limit(CLASSES + 1).collect()}
    if not langs:
        return None, []
    if len(langs) > CLASSES:
        raise ValueError(f"lang has more than {CLASSES} distinct values")
    # by a hash of the id: about 1.5 * per_lang rows of each language, of which the smallest hashes stay
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    bounds = F.create_map(*(x for k, n in langs.items() for x in (F.lit(k), F.lit(int(min(1.0, 1.5 * per_lang / n) * (1 << 40))))))
    below = F.coalesce(bounds[F.col("lang")], F.lit(0))
    at = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - EXCERPT)).cast("int") + 1
    found = (rows.filter(u < below).select("lang", u.alias("u"), F.substring("text", at, F.lit(EXCERPT)).alias("text"))
             .orderBy("lang", "u", "text").collect())
    sample, langs, have = [], list(langs), Counter()
    for r in found:
        have[r["lang"]] += 1
        if have[r["lang"]] <= per_lang:
            sample.append(r)
    raw = [r["text"].encode() for r in sample]
    x, lens, doc = columns(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    place = {k: i for i, k in enumerate(langs)}
    y = np.array([place[r["lang"]] for r in sample])[doc]
    net = ByteNet(len(langs), max(HIDDEN, len(langs) // 4))
    net.fit(x, y, lens, steps=240 * -(-len(langs) // 32))
    return net, langs


def identify(docs: DataFrame, held_out: Column, **how) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``; learns from the rows of
    ``docs (doc_id, text, lang)`` that are not ``held_out``."""
    docs = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out)
    net, langs = train(docs.filter("not held_out"), **how)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out")
    if net is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return map_arrow(rows, _predict(net, langs), "doc_id long, held_out boolean, lang_pred string, score double")
