"""Spelling variants against all pairs of a small vocabulary."""

from __future__ import annotations

import random
import re
from collections import Counter
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from txnguard.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, least=7, occurrences=2):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return forms({w: k for w, k in n.items() if len(w) >= least and k >= occurrences})


def forms(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root(w)) for w in n)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def near_of(words, edited_at=None):
    import pyarrow as pa
    t = pa.table({"word": list(words), "n": list(words.values()), "plain": [False] * len(words)})
    out = spelling._near((pa.scalar(""), pa.scalar(False)), t).to_pylist()
    return {r["word"]: (r["near"], r["best_n"], r["best"]) for r in out}


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("abé", min_size=0, max_size=6), st.integers(1, 4), max_size=40))
def test_composition_accepts_exactly_the_pairs(words):
    want = {}
    for w in words:
        near = [v for v in words if one_edit(w, v)]
        if near:
            b = min(near, key=lambda x: (-words[x], x))
            want[w] = (len(near), words[b], b)
    assert near_of(words) == want


def test_acceptor_is_minimal():
    a = spelling.Acceptor()
    start = a.add(sorted({p + m + s for p in ("un", "re", "") for m in ("do", "load", "pack") for s in ("ing", "s", "er")}))
    right = []  # right languages, children first
    for p, arcs in enumerate(a.arcs):
        right.append(frozenset({""} if a.final[p] else set()) | {c + x for c, to in arcs for x in right[to]})
    assert len(right[start]) == 27 and len(set(right)) == len(right)


@pytest.mark.parametrize("most", [1, 3, 40, 10**6])
def test_partitions_lose_and_repeat_no_pair(spark, most):
    """Any bound on a partition gives the pairs of all words; a hot prefix holds
    most of them and is a word itself."""
    rng = random.Random(most)
    words = {"hotstem": 500, "hotstemm": 7, "": 3, "h": 2}
    while len(words) < 260:
        words["hotstem" * (rng.random() < 0.7) + "".join(rng.choice("abeé") for _ in range(rng.randrange(1, 6)))] = rng.randrange(1, 60)
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: (r.n_near, -r.best.n, r.best.word) for r in spelling.near_words(table, most).collect()}
    assert got == {w: (k, m, b) for w, (k, m, b) in near_of(words).items()}
    assert got == {w: (len(v), words[b], b) for w, v in ((w, [v for v in words if one_edit(w, v)]) for w in words) if v
                   for b in [min(v, key=lambda x: (-words[x], x))]}
    held = spelling.partitions(table, most).groupBy("start", "edited", "part").count().agg({"count": "max"}).first()[0]
    assert held <= 3 * most + 12  # a class has at most one word per symbol


def _texts():
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdeioü") for _ in range(rng.randrange(7, 11))) for _ in range(40)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(60):
            w = rng.choice(base)
            if rng.random() < 0.2:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + "x" + w[k:], w[:k] + "x" + w[k + 1:]])
            text.append(rng.choice([w, w.capitalize(), w.upper()]))
        rows.append((i, rng.choice([" ", "-", "1", "ā"]).join(text)))
    return [*rows, (None, rows[0][1]), (None, None), (7, ""), (8, rows[8][1]), (-1, "ÉTÉABCDE ÉTÉABCDE étéabcde " + "A" * 90_000 + " " + "a" * 90_000 + " " + "a" * 89_999 + " " + "a" * 89_999)]


def test_variants_equal_brute_force(spark):
    rows = _texts()
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n long").repartition(3)
    want = brute(rows)
    assert sum(r[3] is not None for r in want) > 20
    assert rows_of(spelling.group_variants(docs)) == want
    assert rows_of(spelling.group_variants(docs, most=15)) == want


def test_roots_follow_long_chains(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(13)] + [("v", "w9")], "word string, form string")
    assert dict(spelling.roots(chain).collect()) == {**{f"w{i}": "w13" for i in range(13)}, "v": "w13"}


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None), (2, "abc")], "doc_id long, text string")
    assert spelling.group_variants(docs).count() == 0
    assert spelling.group_variants(docs.limit(0)).columns == ["word", "n", "n_near", "form", "form_n", "root"]
