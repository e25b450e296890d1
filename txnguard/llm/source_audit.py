"""How far the sources of each language lie from one another and from their
language, by smoothed term frequencies in exact integers.

A group is a (lang, source).  A term's share in a group is
``p = 1 + floor(SCALE * (n + ALPHA) / (N + ALPHA * V))``, over the ``V`` terms
that stand in at least ``min_docs`` documents of the language.  The distance of
two groups is the sum over all kept terms of ``abs(p - q)``.

The group-by-group distances are one sparse product by rows (Gustavson): the
postings are dealt by term into blocks, each block is a term-major index, and
each group scatters the terms that it has there through the index into a dense
accumulator with one cell per peer of the block.  Pairs of postings are never
emitted, only one sum per pair of groups and block.  A term that a group lacks
still has its zero share ``z``, so the product sums corrections of that
baseline: with ``A(a, z) = sum over a's terms of abs(p_a - z)``

    D(a, b) = A(a, z_b) + A(b, z_a) + (V - |a| - |b|) * abs(z_a - z_b)
            + sum over common terms of (abs(p_a - p_b) - abs(p_a - z_b) - abs(z_a - p_b) + abs(z_a - z_b))

``A`` is read off the sorted distinct shares of a group for all peers at once.

Hot sources: terms are counted per group inside the scan before the shuffle; a
block holds at most about ``postings`` postings however they are distributed
over the groups, and no step gathers a group's documents.

Defined cases: null text, lang and source read as ''; a group without kept
terms takes part with its zero shares; V = 0 gives distance 0; a repeated row
counts again; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnguard.llm.common import batch, map_arrow, stash, unstash

SCALE, ALPHA = 1_000_000_000, 5
#: counted terms that a task holds before it hands them on
HELD = 300_000
#: groups whose baselines one task computes together
GROUPS_AT_ONCE = 8

#: ASCII letters lower-cased, other ASCII a separator, all else part of a term
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(text: str) -> list[bytes]:
    """Matches of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased, as UTF-8."""
    return text.encode().translate(_TERM_BYTES).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents per (group, term), and one row without a term
    per group, of each part of a task's rows."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out():
        for (lang, source), (n, docs) in held.items():
            words = list(n)
            yield batch(_COUNTED, [[lang] * (len(n) + 1), [source] * (len(n) + 1), [None, *(w.decode() for w in words)],
                                   [0, *(n[w] for w in words)], [0, *(docs[w] for w in words)]])
        held.clear()

    size = 0
    for b in batches:
        for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            n, docs = held.setdefault((lang or "", source or ""), (Counter(), Counter()))
            size -= len(n)
            words = terms_of(text or "")
            n.update(words)
            docs.update(set(words))
            size += len(n)
            if size > HELD:
                yield from out()
                size = 0
    yield from out()


def count_terms(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``; each group also has a row of null term."""
    part = map_arrow(docs.select("lang", "source", "text"), _count, "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, v: Column) -> Column:
    """``1 + floor(SCALE * (n + ALPHA) / (total + ALPHA * v))``, exactly; 0 if v = 0."""
    wide = [c.cast("decimal(20,0)") for c in (F.lit(SCALE), n + ALPHA, total + ALPHA * v)]
    quotient = F.call_function("div", wide[0].cast("decimal(10,0)") * wide[1], wide[2])
    return F.when(v > 0, 1 + quotient).otherwise(0).cast("long")


def _corrections(key: tuple, t: pa.Table) -> pa.Table:
    """Each group of a block scatters its terms into its accumulator."""
    term = t.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    names = t.column("source").combine_chunks().dictionary_encode()
    group, names = names.indices.to_numpy(), names.dictionary
    p, z = t.column("p").to_numpy(), t.column("z").to_numpy()
    order = np.argsort(term, kind="stable")  # the term-major index
    first = np.searchsorted(term[order], np.arange(term.max() + 2))
    peer, p_of, z_of = group[order], p[order], z[order]
    out: tuple[list, list, list] = ([], [], [])
    by_row = np.argsort(group, kind="stable")
    rows = np.split(by_row, np.flatnonzero(np.diff(group[by_row])) + 1)
    for mine in rows:
        a, z_a = group[mine[0]], z[mine[0]]
        lo, n = first[term[mine]], first[term[mine] + 1] - first[term[mine]]
        at = np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)  # the index rows of its terms
        p_a, p_b, z_b = np.repeat(p[mine], n), p_of[at], z_of[at]
        acc = np.zeros(len(names), np.int64)
        np.add.at(acc, peer[at], abs(p_a - p_b) - abs(p_a - z_b) - abs(z_a - p_b) + abs(z_a - z_b))
        acc[a] = 0
        near = np.flatnonzero(acc)
        out[0].append(np.full(len(near), a))
        out[1].append(near)
        out[2].append(acc[near])
    a, b, value = (np.concatenate(x) for x in out)
    return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "source": names.take(pa.array(a)),
                     "peer": names.take(pa.array(b)), "value": pa.array(value, pa.int64())}, schema=_SUMS)


_SUMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("peer", pa.string()), ("value", pa.int64())])


def _baselines(key: tuple, shares: pa.Table, peers: pa.Table) -> pa.Table:
    """``A(a, z_b) - |a| * abs(z_a - z_b)`` of the block's groups for all their
    peers, and the same mirrored; ``V * abs(z_a - z_b)`` once."""
    names, z, v = peers.column("source").to_pylist(), peers.column("z").to_numpy(), peers.column("v").to_numpy()
    of = shares.column("source").to_pylist()
    p_all, n_all = shares.column("p").to_numpy(), shares.column("n").to_numpy()
    rows: dict[str, list[int]] = {}
    for i, s in enumerate(of):
        rows.setdefault(s, []).append(i)
    a, b, value = [], [], []
    for i in np.flatnonzero(peers.column("own").to_numpy(zero_copy_only=False)):
        mine = np.array(rows.get(names[i], []), np.int64)
        mine = mine[np.argsort(p_all[mine])]
        p, n = p_all[mine], n_all[mine]
        cn, cp = (np.concatenate([np.zeros(1, np.int64), np.cumsum(x)]) for x in (n, n * p))
        k = np.searchsorted(p, z)
        base = 2 * (z * cn[k] - cp[k]) + cp[-1] - z * cn[-1]
        base -= cn[-1] * abs(z[i] - z)
        other = np.flatnonzero(np.arange(len(z)) != i)
        here = np.full(len(other), i)
        a += [here, other]
        b += [other, here]
        value += [base[other] + v[i] * abs(z[i] - z[other]), base[other]]
    if not a:
        return _SUMS.empty_table()
    text = pa.array(names, pa.string())
    a, b, value = (np.concatenate(x) for x in (a, b, value))
    return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "source": text.take(pa.array(a)),
                     "peer": text.take(pa.array(b)), "value": pa.array(value, pa.int64())}, schema=_SUMS)


def shares(docs: DataFrame, min_docs: int = 30) -> tuple[DataFrame, DataFrame]:
    """``groups (lang, source, v, z)`` and ``postings (lang, source, term, p, q, z, v)``;
    q is the term's share in its language.  Both are written tables."""
    counts = stash(count_terms(docs), "audit-counts")
    seen = counts.filter("term is not null")
    kept = stash(seen.groupBy("lang", "term").agg(F.sum("docs").alias("d"), F.sum("n").alias("lang_n"))
                 .filter(F.col("d") >= min_docs).drop("d"), "audit-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    held = stash(seen.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "audit-held")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (counts.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
              .fillna(0, ["total", "v", "lang_total"]))
    groups = stash(groups.withColumn("z", share(F.lit(0), F.col("total"), F.col("v"))), "audit-groups")
    postings = held.join(groups, ["lang", "source"])
    postings = stash(postings.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
                                     share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"), "z"), "audit-postings")
    unstash(counts, kept, held)
    return groups.select("lang", "source", "v", "z"), postings


def distances(groups: DataFrame, postings: DataFrame, per_block: int = 100_000) -> DataFrame:
    """``(lang, source, peer, value)`` for all ordered pairs of groups of a language."""
    blocks = postings.groupBy("lang").agg(F.ceil(F.count("*") / per_block).alias("blocks"))
    dealt = postings.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    common = (dealt.select("lang", "block", "source", "term", "p", "z").groupBy("lang", "block")
              .applyInArrow(_corrections, "lang string, source string, peer string, value long"))
    sets = groups.groupBy("lang").agg(F.ceil(F.count("*") / GROUPS_AT_ONCE).alias("sets"))
    own = F.pmod(F.xxhash64("source"), F.col("sets"))
    left = (postings.groupBy("lang", "source", "p").agg(F.count("*").alias("n")).join(sets, "lang").withColumn("set", own)
            .select("lang", "set", "source", "p", "n"))
    right = (groups.join(sets, "lang").withColumn("set", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sets") - 1)))
             .select("lang", "set", "source", "z", "v", (own == F.col("set")).alias("own")))
    base = (left.groupBy("lang", "set").cogroup(right.groupBy("lang", "set"))
            .applyInArrow(_baselines, "lang string, source string, peer string, value long"))
    return common.unionByName(base).groupBy("lang", "source", "peer").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: ``pair`` lists a group's
    distance to every other source of its language, ``term`` the ``top`` terms
    whose share in the group most exceeds the language's."""
    groups, postings = shares(docs, min_docs)
    pair = distances(groups, postings).select("lang", "source", F.lit("pair").alias("part"), F.col("peer").alias("item"), "value")
    term = postings.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                           (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pair.withColumn("rank", rank).unionByName(term.withColumn("rank", rank).filter(F.col("rank") <= top))
