"""Secret scan: fixed patterns plus a battery of randomness tests.

Base kinds (leftmost, non-overlapping, per kind): ``assign`` (a keyword, a
separator and a value of 12+ characters), ``access`` (AKIA..., 18+) and ``hex``
(16+ characters).  They always stay.

The method adds ``random`` spans.  Tokens are cut at base spans; each piece of 16+
characters that these leave is a token of its own.  It is held against every
encoding whose alphabet holds it (hex, base32 and plain letters in either case,
base64 and its URL form).  The battery tests it against a random string of that
encoding: chi-squared uniformity over the alphabet (in bins, five expected each),
a runs test about the median symbol and lag-one serial correlation, together
(Bonferroni) one p-value.  A second p-value is against ordinary text: the
likelihood ratio of a text model to the uniform encoding, which bounds the chance
that text looks so random (Markov's inequality) and so shrinks with the token's
length.  The token's p-value is the latter over the former (as a share of ``SOUND``,
above which it counts no more), so what the tests find patterned needs the more
evidence, times the number of encodings tried; an encoding whose battery value is
below ``BROKEN`` is out.  Benjamini-Hochberg over a
document's tokens keeps the false-discovery rate; a document's result doesn't
depend on the other documents but through the text model.

The text model is a chain of characters: counts of neighbours within the short
runs (below 16) of all texts, added up by Spark, mixed with a fixed prior that
keeps letters with letters.

Defined cases: null and empty texts give no span; each input row gives one
output row, repeated rows included; positions are code points; where spans of
several kinds start at one place they stand in the order of the kinds; extra
columns stay, but for one named as the result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnguard.llm.common import map_arrow

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
KINDS = ("assign", "access", "hex", "random")
SPANS = "secret_spans array<struct<kind:string,start:bigint,end:bigint>>"
_HINT = re.compile(r"[:=]")
LEAST = 16
#: Battery p-values from here on speak for randomness no more; below the other the token is not random.
SOUND, BROKEN = 0.05, 1e-4
#: Share of the texts' own counts in the text model.
SEEN = 0.8

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {
    "hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "letters": _LOWER, "LETTERS": _UPPER,
    "base32": _LOWER + "234567", "BASE32": _UPPER + "234567",
    "base64": _UPPER + _LOWER + _DIGITS + "+/", "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
SYMBOLS = _UPPER + _LOWER + _DIGITS + "+/-_"
_AT = np.full(128, -1)
_AT[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))
_BYTES = np.concatenate([_AT, np.full(128, -1)])
_PLACES = {}
for _name, _a in ALPHABETS.items():
    _p = np.full(len(SYMBOLS), -1)
    _p[[SYMBOLS.index(c) for c in _a]] = np.arange(len(_a))
    _PLACES[_name] = _p


def prior() -> np.ndarray:
    """Weights of neighbours before any text: lower case goes on in lower case,
    upper case and digits mostly with their like."""
    kind = np.array([0 if c in _UPPER else 1 if c in _LOWER else 2 if c in _DIGITS else 3 for c in SYMBOLS])
    move = np.array([[0.5, 0.4, 0.05, 0.05], [0.03, 0.9, 0.03, 0.04], [0.05, 0.05, 0.85, 0.05], [0.2, 0.5, 0.2, 0.1]])
    size = np.bincount(kind)
    return move[kind][:, kind] / size[kind][None, :]


class TextModel:
    """Logarithms of the chance of a first character and of each next one."""

    def __init__(self, pairs: np.ndarray | None = None):
        known = prior()
        known /= known.sum(1, keepdims=True)
        pairs = np.zeros(known.shape) if pairs is None else pairs
        seen = pairs.sum(1, keepdims=True)
        share = SEEN * seen / (seen + 1)  # the rest is for neighbours that the texts haven't
        self.next = np.log(share * pairs / np.maximum(seen, 1) + (1 - share) * known)
        first = seen[:, 0] + 1
        self.first = np.log(first / first.sum())

    def loglik(self, v: np.ndarray) -> float:
        return float(self.first[v[0]] + self.next[v[:-1], v[1:]].sum())


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch, the number of each pair of neighbours (by place in ``SYMBOLS``)
    within runs below ``LEAST`` characters."""
    size = len(SYMBOLS)
    for b in batches:
        n = np.zeros(size * size, np.int64)
        for t in b["text"].to_pylist():
            at = _BYTES[np.frombuffer((t or "").encode(), np.uint8)]
            ends = np.flatnonzero(np.diff(at >= 0, prepend=False, append=False))  # start and end of each run, by turns
            length = ends[1::2] - ends[::2]
            inner = np.zeros(len(at) + 1, np.int8)  # 1 at places of short runs but the last of each
            short = (length > 1) & (length < LEAST)
            inner[ends[::2][short]] = 1
            inner[ends[1::2][short] - 1] = -1
            first = np.flatnonzero(np.cumsum(inner))
            n += np.bincount(at[first] * size + at[first + 1], minlength=size * size)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(n[seen], pa.int64())], names=["pair", "n"])


def fit(docs: DataFrame) -> TextModel:
    """The text model of all texts."""
    rows = map_arrow(docs.select("text"), _pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # pairs of symbols
    counts = np.zeros(len(SYMBOLS) ** 2)
    for r in rows:
        counts[r["pair"]] = r["n"]
    return TextModel(counts.reshape(len(SYMBOLS), len(SYMBOLS)))


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared (cube-root normal approximation)."""
    if df < 1:
        return 1.0
    z = ((max(x, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(v: np.ndarray, size: int) -> float:
    """p-value of the randomness tests of symbols 0 .. size-1 (small: not random)."""
    n = len(v)
    bins = max(2, min(size, n // 5))
    seen = np.bincount(v * bins // size, minlength=bins)
    want = n * np.bincount(np.arange(size) * bins // size, minlength=bins) / size
    uniform = chi2_tail(float(((seen - want) ** 2 / want).sum()), bins - 1)
    high = 2 * v >= size
    n1 = int(high.sum())
    n0 = n - n1
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * n1 * n0 / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    by_runs = math.erfc(abs(runs - mean) / math.sqrt(2 * var)) if var > 0 else 0.0
    d = v - (size - 1) / 2
    r = float((d[1:] * d[:-1]).sum()) / ((size * size - 1) / 12) / math.sqrt(n - 1)
    serial = math.erfc(abs(r) / math.sqrt(2))
    return min(1.0, 3 * min(uniform, by_runs, serial))


def judge(token: str, model: TextModel) -> float:
    """p-value of a token against text, over all encodings that hold it."""
    at = _AT[np.frombuffer(token.rstrip("=").encode(), np.uint8)]
    text, best, tried = model.loglik(at), 1.0, 0
    for name, a in ALPHABETS.items():
        v = _PLACES[name][at]
        if v.min() < 0:
            continue
        tried += 1
        by_text = math.exp(min(0.0, text + len(at) * math.log(len(a))))
        if by_text < best:
            sound = battery(v, len(a))
            if sound >= BROKEN:
                best = min(best, by_text / min(sound / SOUND, 1.0))
    return min(1.0, best * max(tried, 1))


def _uncovered(start: int, end: int, base: list[tuple[int, int, int]], least: int = LEAST) -> list[tuple[int, int]]:
    """Pieces of ``least`` or more characters of a token that base spans leave."""
    out, at = [], start
    for s, _, e in sorted(x for x in base if x[0] < end and start < x[2]):
        out.append((at, s))
        at = max(at, e)
    return [(a, b) for a, b in [*out, (at, end)] if b - a >= least]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    base = []
    if _HINT.search(text):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return base + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def scan(text: str, model: TextModel | None = None, rate: float = 0.001) -> list[tuple[int, int, int]]:
    """Spans ``(start, kind index, end)`` of one text, sorted."""
    base, tokens, model = base_spans(text), [], model or TextModel()
    for m in TOKEN.finditer(text):
        for s, e in _uncovered(m.start(), m.end(), base):
            if len(text[s:e].rstrip("=")) >= LEAST:
                tokens.append((judge(text[s:e], model), s, e))
    tokens.sort()
    keep = max((i + 1 for i, t in enumerate(tokens) if t[0] <= rate * (i + 1) / len(tokens)), default=0)
    return sorted(base + [(s, 3, e) for _, s, e in tokens[:keep]])


def secret_scan(docs: DataFrame, model: TextModel | None = None) -> DataFrame:
    """``docs`` plus ``secret_spans``, an array of (kind, start, end) in code
    points, by start and then kind.  (A column of that name is replaced.)  The
    text model is fitted on ``docs`` unless one is given."""
    docs = docs.drop("secret_spans")
    model = model or fit(docs)
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(SPANS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan(t or "", model) for t in b["text"].to_pylist()]
            spans = pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in f] for f in found],
                             pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*b.columns, spans], names=[*b.schema.names, "secret_spans"])
    return map_arrow(docs, run, schema)


def redact(docs: DataFrame, mark: str = "[SECRET]", model: TextModel | None = None) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``; spans
    that overlap are replaced as one."""
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b["text"].to_pylist():
                spans = scan(t, model) if t else []
                parts, at = [], 0
                for s, _, e in spans:
                    if s >= at:
                        parts += [t[at:s], mark]
                    at = max(at, e)
                out.append(t if not spans else "".join([*parts, t[at:]]))
            i = b.schema.get_field_index("text")
            yield b.set_column(i, b.schema.field(i), pa.array(out, b.schema.field(i).type))
    return map_arrow(docs, run, docs.schema)


def digest(spans: str = "secret_spans") -> list:
    """Columns n_assign, n_access, n_hex, base_sha256 and spans."""
    def joined(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    def count(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"] != "random")
    return [*map(count, KINDS[:3]),
            F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans")]
