"""Distances between sources against plain Python integers."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from txnguard.llm import source_audit


def brute(rows, min_docs, top=50):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        t = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        n[lang, source].update(t)
        docs[lang].update(set(t))
    kept = {lang: sorted(t for t, d in docs[lang].items() if d >= min_docs) for lang, _ in groups}

    def p(count, lang):
        total, v = sum(count[t] for t in kept[lang]), len(kept[lang])
        return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * v) for t in kept[lang]}
    shares = {g: p(n[g], g[0]) for g in groups}
    out = []
    for g in groups:
        whole = p(sum((n[x] for x in groups if x[0] == g[0]), Counter()), g[0])
        pair = [(x[1], sum(abs(shares[g][t] - shares[x][t]) for t in kept[g[0]])) for x in groups if x[0] == g[0] and x != g]
        term = [(t, shares[g][t] - whole[t]) for t in kept[g[0]] if n[g][t] and shares[g][t] > whole[t]]
        for part, items, most in (("pair", pair, None), ("term", term, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(*g, part, i, v, k + 1) for k, (i, v) in enumerate(items[:most])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def _corpus():
    rng = random.Random(2)
    words = [f"w{i}x".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(60)] + ["Ärger", "ärger", "ÉTÉ", "l'été", "x1y", "日本"]
    rows = []
    for i in range(300):  # s0 holds a third of a language, s9 one document
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["s0"] * 5 + [f"s{k}" for k in range(1, 9)] + [None])
        rows.append((" ".join(rng.choice(words[: rng.randrange(5, len(words))]) for _ in range(rng.randrange(40))), lang, source))
    rows += [("Wax only here", "en", "s9"), ("", "en", "empty"), (None, "en", "none"), ("rare", "fr", "a"), ("rare rare", "fr", "b"), (None, "zz", "")]
    return rows + rows[:40] + [("waa " * 70_000 + "wab", "de", "s1")]


def test_audit_equals_brute_force(spark, monkeypatch):
    rows = _corpus()
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "text string, lang string, source string, p int, value double").repartition(3)
    got = rows_of(source_audit.audit(docs, min_docs=10, top=7))
    assert got == brute(rows, 10, 7)
    assert {r[0] for r in got if r[2] == "pair" and r[4] == 0} >= {"fr"}  # no kept term: distance 0
    # many blocks, many sets of groups, and counts handed on early give the same
    monkeypatch.setattr(source_audit, "GROUPS_AT_ONCE", 2)
    groups, postings = source_audit.shares(docs, 10)
    a = rows_of(source_audit.distances(groups, postings, per_block=20))
    assert a == sorted((r[0], r[1], r[3], r[4]) for r in got if r[2] == "pair")


def test_task_hands_on_counts_in_parts():
    import pyarrow as pa
    b = pa.record_batch({"lang": ["en"] * 3, "source": ["a", "a", None], "text": ["x y x", "y z", "x"]})
    held, source_audit.HELD = source_audit.HELD, 1
    try:
        rows = [r for p in source_audit._count(iter([b])) for r in p.to_pylist()]
    finally:
        source_audit.HELD = held
    total = Counter()
    for r in rows:
        total[r["source"], r["term"]] += r["n"]
    assert total == {("a", None): 0, ("a", "x"): 2, ("a", "y"): 2, ("a", "z"): 1, ("", None): 0, ("", "x"): 1}
    assert len(rows) > 5


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, v = 92_233_720_368_547, 10**15 + 7, 12_345
    got = spark.range(1).select(source_audit.share(F.lit(n), F.lit(total), F.lit(v)).alias("p"),
                                source_audit.share(F.lit(0), F.lit(0), F.lit(0)).alias("z")).first()
    assert (got.p, got.z) == (1 + 10**9 * (n + 5) // (total + 5 * v), 0)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    out = source_audit.audit(docs)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and out.count() == 0
