"""Spelling variants: words one edit apart, and the frequent word that each rarer
one is a form of.

The vocabulary is a minimised acyclic acceptor A.  Composed with the transducer
E that copies all symbols but one, which it inserts, deletes or replaces, and
with A again, it accepts the pairs of words that are one edit apart.  A state of
A.E.A is (p, edits so far, q).  While no edit has been made both words have read
the same prefix, so p = q; after it both must read the same rest x, so x lies in
the languages of both states.  All edits at p are therefore composed at once:
the states behind p's arcs, and p itself for "no symbol here", walk together as
long as two of them can, and each x that two or more accept is a class of words
``prefix + symbol + x`` that differ in that one place.  Classes are found once
per state of A, whatever the number of prefixes that lead there.  A pair is
taken where its words first differ, so it is met once.

Partitions of the composition, by the state in which they start:

* ``(w, not edited)``: the words that start with w; edits behind w.  w is the
  shortest prefix of at most ``most`` words.
* ``(w, edited)`` for each prefix w of more than ``most`` words: edits right
  behind w, dealt by a hash of the rest x, so that however many words share w,
  they split.  A class has one word per symbol at most.

So no task holds more than about ``most`` words, and a word is in one partition
of the first kind and two for each of its hot prefixes.  Texts are counted inside the scan.

Defined cases: null texts have no words; a null doc_id reads as ''; a row that
repeats counts again; an empty table gives an empty result; extra columns are
ignored; words of any length take part whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnguard.llm.common import batch, map_arrow, stash, unstash

#: counted words that a task holds before it hands them on
HELD = 500_000
_WORDS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_NEAR = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _count(least: int, every: int):
    """Occurrences per word, of each part of a task's rows."""
    run_of = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                start = crc32(f"{'' if doc is None else doc}:".encode())
                # only A-Z are ASCII capitals, so lower-casing the bytes leaves all other letters
                for w, n in Counter(run_of.findall((text or "").encode().lower().decode())).items():
                    h = crc32(w.encode(), start)
                    if h % every == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1:]
                        if len(w) < least:
                            continue
                    held[w] += n
            if len(held) > HELD:
                yield batch(_WORDS, [list(held), list(held.values())])
                held.clear()
        yield batch(_WORDS, [list(held), list(held.values())])
    return run


def vocabulary(docs: DataFrame, least: int = 7, occurrences: int = 2, every: int = 31) -> DataFrame:
    """``(word, n)``: runs of letters, one in ``every`` (document, run) with a
    letter deleted, of at least ``least`` letters and ``occurrences`` in all."""
    part = map_arrow(docs.select("doc_id", "text"), _count(least, every), "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


class Acceptor:
    """Minimal acyclic acceptors that share their states."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.final: list[bool] = []
        self.arcs: list[tuple[tuple[str, int], ...]] = []

    def _state(self, final: bool, arcs: list) -> int:
        key = (final, *arcs)
        state = self.known.get(key)
        if state is None:
            state = self.known[key] = len(self.final)
            self.final.append(final)
            self.arcs.append(tuple(arcs))
        return state

    def add(self, words: list[str]) -> int:
        """The start state that accepts the sorted distinct ``words``."""
        path: list[list] = [[False, []]]
        last = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                state = self._state(*path.pop())
                path[-1][1].append((last[len(path) - 1], state))
        for w in words:
            same, n = 0, min(len(w), len(last))
            while same < n and w[same] == last[same]:
                same += 1
            close(same)
            path.extend([False, []] for _ in range(len(w) - same))
            path[-1][0] = True
            last = w
        close(0)
        return self._state(*path[0])

    def classes(self, members: list[tuple[str, int]]) -> list[tuple[str, list[str]]]:
        """``(x, symbols)`` for each rest that the states of two or more members
        accept.  ``('', p)`` reads no symbol; with the symbol c and a rest that
        starts with c the words first differ further on."""
        out = []
        todo = [("", members)]
        while todo:
            x, alive = todo.pop()
            ended = [c for c, s in alive if self.final[s]]
            if len(ended) > 1:
                out.append((x, ended))
            step: dict[str, list] = {}
            for c, s in alive:
                for symbol, to in self.arcs[s]:
                    step.setdefault(symbol, []).append((c, to))
            for symbol, then in step.items():
                if len(then) > 1 and (x or len(then) > 2 or {"", symbol} != {c for c, _ in then}):
                    todo.append((x + symbol, then))
        return out

    def compose(self, start: int) -> Iterator[tuple[str, str, list[str]]]:
        """All classes ``(prefix, x, symbols)`` of the words accepted from ``start``."""
        found = [self.classes([*arcs, ("", p)]) if len(arcs) > 1 or final else [] for p, (arcs, final) in
                 enumerate(zip(self.arcs, self.final, strict=True))]
        leads: list[bool] = []  # arcs lead to states that were closed before
        for p, arcs in enumerate(self.arcs):
            leads.append(bool(found[p]) or any(leads[to] for _, to in arcs))
        todo = [("", start)] if leads[start] else []
        while todo:
            prefix, p = todo.pop()
            for x, symbols in found[p]:
                yield prefix, x, symbols
            todo += [(prefix + symbol, to) for symbol, to in self.arcs[p] if leads[to]]


def _near(key: tuple, t: pa.Table) -> pa.Table:
    """Number of near words and the most frequent of them, of a partition."""
    start, edited = key[0].as_py(), key[1].as_py()
    words, plain = t.column("word").to_pylist(), t.column("plain").to_pylist()
    count = dict(zip(words, t.column("n").to_pylist(), strict=True))
    a, cut = Acceptor(), len(start)
    root = a.add(sorted(w[cut:] for w, s in zip(words, plain, strict=True) if not s))
    if edited:
        rest = a.add(sorted(w[cut:] for w, s in zip(words, plain, strict=True) if s))
        found = (("", x, symbols) for x, symbols in a.classes([*a.arcs[root], ("", rest)]))
    else:
        found = a.compose(root)
    near: dict[str, list] = {}
    for prefix, x, symbols in found:
        group = [(c, start + prefix + c + x) for c in symbols]
        for c, w in group:
            skip = "" if x and c == x[0] else x[:1] if not c else None
            for c2, other in group:
                if c2 != c and c2 != skip:
                    n = count[other]
                    best = near.setdefault(w, [0, 0, ""])
                    best[0] += 1
                    if n > best[1] or n == best[1] and other < best[2]:
                        best[1], best[2] = n, other
    return pa.table({"word": list(near), "near": [v[0] for v in near.values()], "best_n": [v[1] for v in near.values()],
                     "best": [v[2] for v in near.values()]}, schema=_NEAR)


def hot_prefixes(words: DataFrame, most: int, step: int = 4) -> tuple[DataFrame, int]:
    """``(prefix, held)`` of all prefixes of more than ``most`` words, and the
    length of the longest (-1 if none)."""
    longest, tables = -1, []
    while True:
        depth = F.explode(F.sequence(F.lit(longest + 1), F.least(F.length("word"), F.lit(longest + step))))
        cut = words.filter(F.length("word") > longest).select("word", depth.alias("depth"))
        hot = stash(cut.groupBy(F.expr("left(word, depth)").alias("prefix"), "depth").agg(F.count("*").alias("held"))
                    .filter(F.col("held") > most), "spelling-hot")
        tables.append(hot)
        deepest = hot.agg(F.max("depth")).first()[0]
        if deepest is None or deepest < longest + step:
            longest = longest if deepest is None else deepest
            break
        longest = deepest
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.select("prefix", "held"), longest


def partitions(words: DataFrame, most: int) -> DataFrame:
    """``(word, n, plain, start, edited, part)``: each word in all partitions of
    the composition that can accept it."""
    hot, longest = hot_prefixes(words, most)
    cut = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.least(F.length("word"), F.lit(longest + 1)))).alias("depth"))
    cut = cut.withColumn("start", F.expr("left(word, depth)")).join(hot.withColumnRenamed("prefix", "start"), "start", "left")
    above = hot.select(F.col("prefix").alias("above"), F.lit(True).alias("split"))
    whole = (cut.filter("held is null").withColumn("above", F.expr("left(word, greatest(depth - 1, 0))")).join(above, "above", "left")
             .filter("depth = 0 or split"))
    whole = whole.select("word", "n", F.lit(False).alias("plain"), "start", F.lit(False).alias("edited"), F.lit(0).cast("long").alias("part"))
    split = cut.filter("held is not null")

    def edited(rows: DataFrame, rest: str, plain: bool) -> DataFrame:
        part = F.pmod(F.xxhash64(F.expr(rest)), F.ceil(2 * F.col("held") / most))
        return rows.select("word", "n", F.lit(plain).alias("plain"), "start", F.lit(True).alias("edited"), part.alias("part"))
    return (whole.unionByName(edited(split.filter("depth < length(word)"), "substring(word, depth + 2)", False))
            .unionByName(edited(split, "substring(word, depth + 1)", True)))


def near_words(words: DataFrame, most: int = 50_000) -> DataFrame:
    """``(word, n_near, best)`` of the words that have a near word; ``best`` is
    ``(-n, word)`` of the most frequent."""
    found = (partitions(words, most).groupBy("start", "edited", "part")
             .applyInArrow(_near, "word string, near long, best_n long, best string"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of all words with a form, by pointer doubling; a form is
    at least ten times as frequent, so chains are short."""
    at = stash(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = stash(at.join(up, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
                    "spelling-roots")
        unstash(at)
        moved = new.filter("moved").limit(1).count()
        at = new.select("word", "root")
        if not moved:
            return at


def group_variants(docs: DataFrame, least: int = 7, occurrences: int = 2, ratio: int = 10, most: int = 50_000) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for each word of the vocabulary."""
    words = stash(vocabulary(docs, least, occurrences), "spelling-words")
    near = near_words(words, most)
    best = F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best"))
    out = stash(words.join(near, "word", "left")
                .select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), best["word"].alias("form"), (-best["n"]).alias("form_n")), "spelling-near")
    root = roots(out.filter("form is not null"))
    return out.join(root, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
