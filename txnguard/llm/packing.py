"""Best-fit packing of tokenised documents with Martello-Toth reduction.

All documents are tokenised where they lie and cut into pieces of at most
``capacity`` tokens.  Packing needs the lengths only, and there are at most
``capacity`` of them: the instance is one count per length, so the reduction
and the best-fit run over that bounded histogram and give placements
``(length, how many, sequence, offset)``, never one entry per document.

Reduction, longest length first; a set is fixed for as many copies as there
are:  alone, if not even the shortest fits beside it; with the length that
fills the sequence exactly; with the longest that fits, if no two others fit
together or no two that fit weigh more.  Each such set dominates every other
way to fill that sequence.  The rest is packed best-fit decreasing.

Then each piece gets its rank among equal lengths (ranks within buckets plus
the buckets' offsets, so a frequent length is never one task) and looks up its
placement.

Defined cases: null texts count as empty (the end token only); rows that repeat
a doc_id, or have none, are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnguard.llm.common import batch, kept_in_stage, map_arrow, stash

_ODD = re.compile("[\x1c-\x1f]")  # white space for Arrow, not for the tokenizer
_TAIL = ".,;:!?&#$%*"  # marks that may stand behind a word's letters; no part of a special token or contraction


class _Table:
    """Ids of words, all in one array; a word's slot tells which are its own."""

    def __init__(self):
        self.slots: dict[str, int] = {}
        self.sizes, self.ids, self.uses = np.empty(0, np.int64), np.empty(0, "<u4"), np.empty(0, np.int64)

    def add(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Distinct words that it doesn't have yet."""
        n = len(self.sizes)
        self.slots.update(zip(words, range(n, n + len(words)), strict=True))
        self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])

    def take(self, words: list[str], which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all the words in turn (or of those that ``which`` names),
        and where each word's begin and end."""
        slots = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        slots = slots if which is None else slots[which]
        self.uses += np.bincount(slots, minlength=len(self.uses))
        begins, n = np.cumsum(self.sizes) - self.sizes, self.sizes[slots]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.ids[np.repeat(begins[slots] - ends[:-1], n) + np.arange(ends[-1])], ends

    def repeated(self) -> _Table:
        """The words that were taken more than once."""
        out, words = _Table(), [w for w, n in zip(self.slots, self.uses.tolist(), strict=True) if n > 1]
        ids, ends = self.take(words)
        out.add(words, np.diff(ends), ids)
        return out


class WordIds:
    """Token ids of whole texts from a cache of blank-separated words.

    The tokenizer drops white space and never joins across it, so a text's ids
    are its lowered words' ids in order.  Texts whose lowering is not sure (final
    sigma, other normal forms, special tokens) go to the tokenizer whole.  The
    cache holds two generations, the younger of about ``most`` words, the older
    of those of its words that came again; words in use move on to the younger."""

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer, pre_tokenizers
        self.bare = Tokenizer.from_file(path)  # for words of letters in lower case: no more than blanks to split at
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(
            add_prefix_space=False, trim_offsets=True, use_regex=False)])
        self.tok, self.most, self.young, self.old = Tokenizer.from_file(path), most, _Table(), _Table()
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)  # tokens that end a word
        self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True

    @staticmethod
    def lower(text: str) -> str | None:
        """The text as the tokenizer lowers it, or None where that, or where it
        splits, is not sure."""
        if "Σ" not in text and "<|" not in text and not _ODD.search(text) and unicodedata.is_normalized("NFC", text):
            low = text.lower()
            if unicodedata.is_normalized("NFC", low):
                return low
        return None

    def learn(self, words: set[str]) -> None:
        """Puts the ids of words into the younger generation, which has none of them."""
        kept = [w for w in words if w in self.old.slots]
        if kept:
            ids, ends = self.old.take(kept)
            self.young.add(kept, np.diff(ends), ids)
            words = words.difference(kept)
        plain, rest, tailed = [], [], {}
        for w in words:
            if w.isalpha():
                plain.append(w)
            elif (stem := w.rstrip(_TAIL)).isalpha():
                tailed[w] = stem
            else:
                rest.append(w)
        for i in range(0, len(plain), 512):  # letters only: one run of tokens up to an end of word each
            some = plain[i: i + 512]
            ids = np.array(self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(some):
                self.young.add(some, np.diff(cut, prepend=0), ids)
            else:
                rest += some
        if rest:
            each = [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(rest, add_special_tokens=False)]
            self.young.add(rest, np.array([len(e) for e in each]), np.concatenate(each))
        if tailed:  # marks behind letters are a run of tokens of their own
            parts = [p for w, stem in tailed.items() for p in (stem, w[len(stem):])]
            self.learn({p for p in parts if p not in self.young.slots})
            ids, ends = self.young.take(parts)
            self.young.add(list(tailed), np.diff(ends[::2]), ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.young.slots) > self.most:
            self.young, self.old = _Table(), self.young.repeated()
        lowered = [self.lower(t) for t in texts]
        odd = [i for i, t in enumerate(lowered) if t is None]
        split = pc.utf8_split_whitespace(pa.array([t or "" for t in lowered], pa.large_string()))
        coded = split.flatten().dictionary_encode()  # each word is looked up once for all texts
        words, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        new = set(words).difference(self.young.slots)
        if new:
            self.learn(new)
        ids, ends = self.young.take(words, which)
        ends = ends[split.offsets.to_numpy()]
        out = [ids[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
        for i in odd:
            out[i] = np.array(self.tok.encode_batch_fast([texts[i]], add_special_tokens=False)[0].ids, "<u4").tobytes()
        return out


def word_ids(path: str) -> WordIds:
    """The worker's cache for a tokenizer; later tasks of the stage go on with it."""
    return kept_in_stage(f"word ids {path}", lambda: WordIds(path))


def _blocks(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[tuple[list, list[str]]]:
    """Document ids and whole texts, by blocks of about ``most`` characters;
    the more texts share a block, the fewer words are looked up."""
    docs, texts, chars = [], [], 0
    for b in batches:
        for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
            docs.append(doc)
            texts.append(text or "")
            chars += len(texts[-1])
            if chars >= most:
                yield docs, texts
                docs, texts, chars = [], [], 0
    if docs:
        yield docs, texts


def _pieces(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        ids, step, stop = word_ids(path), 4 * capacity, np.array([end], "<u4").tobytes()
        for docs, texts in _blocks(batches):
            rows = []
            for doc, raw in zip(docs, ids.encode(texts), strict=True):
                raw += stop
                rows += [(doc, k, k * capacity, len(p) // 4, zlib.crc32(p)) for k, i in enumerate(range(0, len(raw), step))
                         for p in [raw[i: i + step]]]
            yield batch(out, [list(c) for c in zip(*rows, strict=True)])
    return run


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Placements ``(length, copies, sequence, copies per sequence, offset)``:
    the next ``copies`` pieces of ``length`` go to sequences from ``sequence``
    on, so many to each, from ``offset`` on."""
    left, out, sequence = dict(counts), [], 0
    sizes = sorted(left)

    def take(size: int, n: int) -> None:
        left[size] -= n
        if not left[size]:
            sizes.pop(bisect.bisect_left(sizes, size))

    def fix(items: list[tuple[int, int]], n: int) -> None:
        """``n`` sequences with ``k`` copies of each (length, k)."""
        nonlocal sequence
        at = 0
        for size, k in items:
            out.append((size, n * k, sequence, k, at))
            at += size * k
        sequence += n

    def fitting(room: int) -> int:
        """The longest length left that is at most ``room``, or 0."""
        i = bisect.bisect_right(sizes, room)
        return sizes[i - 1] if i else 0

    def pair(room: int) -> int:
        """The most that two of the pieces left weigh within ``room``."""
        best, i, j = 0, 0, bisect.bisect_right(sizes, room) - 1
        while i <= j:
            s = sizes[i] + sizes[j]
            if s > room:
                j -= 1
            elif i == j and left[sizes[i]] < 2:
                break
            else:
                best, i = max(best, s), i + 1
        return best

    # reduction
    for big in sorted(left, reverse=True):
        while left.get(big):
            room, n = capacity - big, left[big]
            take(big, 1)  # the others are what may stand beside it
            mate = fitting(room)
            two = pair(room) if mate and mate != room else 0
            left[big] += 1
            if left[big] == 1:
                bisect.insort(sizes, big)
            if not mate:
                fix([(big, 1)], n)
                take(big, n)
            elif mate == room or two <= mate:
                # fewer pieces make no better pair, so the set goes on to dominate until one of its lengths is used up
                n = n // 2 if mate == big else min(n, left[mate])
                fix([(big, 2)] if mate == big else [(big, 1), (mate, 1)], n)
                take(big, 2 * n if mate == big else n)
                if mate != big:
                    take(mate, n)
            else:
                break
    # best fit, longest first; open: sequences by the room they have left
    open_: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []

    def put(room: int, n: int, items: tuple) -> None:
        if room not in open_:
            bisect.insort(rooms, room)
        open_.setdefault(room, []).append((n, items))

    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            i = bisect.bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                have, items = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
                k = min(room // size, n)
                used = min(have, n // k)
                put(room - k * size, used, (*items, (size, k)))
                if have > used:
                    put(room, have - used, items)
                n -= used * k
            else:
                k = min(capacity // size, n)
                used = n // k
                put(capacity - k * size, used, ((size, k),))
                n -= used * k
    for _, groups in sorted(open_.items()):
        for n, items in groups:
            fix(list(items), n)
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = stash(map_arrow(docs, _pieces(tokenizer_path, capacity, end),
                             "doc_id long, piece int, start long, length long, ids_crc32 long"), "op9-pieces")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = stash(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "op9-counts")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("r", rank).join(offsets, ["length", "bucket"]).withColumn("r", F.col("r") + F.col("before"))
    seen: dict[int, int] = {}
    slots = []
    for size, n, sequence, k, at in plan(counts, capacity):
        slots.append((size, seen.get(size, 0), seen.get(size, 0) + n, sequence, k, at))
        seen[size] = slots[-1][2]
    table = spark.createDataFrame(slots, "length long, lo long, hi long, seq long, k long, at long")
    # a few placements per distinct length, of which there are at most `capacity`, whatever the number of pieces
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (ranked["r"] >= table["lo"]) & (ranked["r"] < table["hi"]))
    i = F.col("r") - F.col("lo")
    return placed.select("doc_id", "piece", "start", ranked["length"], "ids_crc32",
                         (F.col("seq") + F.floor(i / F.col("k"))).cast("long").alias("sequence_id"),
                         (F.col("at") + F.pmod(i, F.col("k")) * ranked["length"]).cast("long").alias("offset"))
