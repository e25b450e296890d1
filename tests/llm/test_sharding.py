"""Shards: every record once, counts at most one apart, a uniform order, and the
whole order against a plain Python twin."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from txnguard.llm import sharding
from txnguard.llm.common import U64, mix


def docs(spark, n=1000, parts=5):
    out = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") * 7).alias("text"),
                                F.when(F.col("id") % 3 == 0, F.lit("x")).alias("shard"), F.col("id").alias("slot"), F.lit(1).alias("row"))
    return out.repartition(parts)


def rows_of(out):
    return sorted(tuple(r) for r in out.select("shard", "slot", "row.doc_id", "row.text", "row.slot").collect())


def test_order_equals_a_plain_twin(spark):
    d = docs(spark)
    keys = dict(d.select("doc_id", F.xxhash64(*d.columns)).collect())
    got = rows_of(sharding.shard(d, 7, seed=3, bucket_bytes=5000))
    total = sum(len(f"text {7 * i}") + (i % 3 == 0) + 40 for i in range(1000))
    buckets = -(-total // 5000)
    dealt: dict[int, list] = {}
    for i, k in sorted(keys.items(), key=lambda x: x[1]):
        b = int(mix(mix(np.array([k]).astype(U64) + U64(3)))[0] % U64(buckets))
        dealt.setdefault(b, []).append(i)
    flat = []
    for b in sorted(dealt):
        permuted = np.random.Generator(np.random.Philox(key=[3, b])).permutation(len(dealt[b]))
        flat += [dealt[b][j] for j in permuted]
    sizes = [len([p for p in range(1000) if p * 7 // 1000 == s]) for s in range(7)]
    want, at = [], 0
    for s, n in enumerate(sizes):
        want += [(s, k, flat[at + k], f"text {7 * flat[at + k]}", flat[at + k]) for k in range(n)]
        at += n
    assert len(dealt) > 5 and got == sorted(want)
    # neither the order of the rows nor the number of partitions matters
    assert rows_of(sharding.shard(d.orderBy(F.desc("text")).repartition(2), 7, seed=3, bucket_bytes=5000)) == got
    assert rows_of(sharding.shard(d, 7, seed=4, bucket_bytes=5000)) != got


def test_counts_slots_and_repeated_records(spark):
    """Half of all rows repeat one record; buckets and shards stay even."""
    d = spark.createDataFrame([(i, f"t{i}") for i in range(300)] + [(None, None)] * 350 + [(5, "")] * 3, "doc_id long, text string").repartition(3)
    out = sharding.shard(d, 24, bucket_bytes=400).cache()
    got = [(r.shard, r.slot, r.row.doc_id, r.row.text) for r in out.collect()]
    assert Counter((i, t) for _, _, i, t in got) == Counter(tuple(r) for r in d.collect())
    sizes = Counter(s for s, *_ in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(slot for s, slot, *_ in got if s == k) == list(range(sizes[k])) for k in sizes)
    copies = Counter(s for s, _, i, _ in got if i is None)
    assert len(copies) == 24 and max(copies.values()) < 26
    scattered = sharding.scatter(d, 0, 20).groupBy("bucket").count().collect()
    assert max(r["count"] for r in scattered) < 3 * 653 / 20


def test_order_is_uniform():
    """First places over many seeds: chi-squared of 40 records, and neighbours part."""
    n, draws = 40, 4000
    keys = np.arange(n)
    first = Counter(int(sharding.order(keys, s, 1)[0]) for s in range(draws))
    chi2 = sum((first[i] - draws / n) ** 2 / (draws / n) for i in range(n))
    assert chi2 < 85  # 39 degrees of freedom, p about 2e-5
    together = sum(int(np.any(np.diff(sharding.order(keys, s, 2)) == 1)) for s in range(200))
    assert together < 180


def test_few_no_and_long_records(spark):
    few = spark.createDataFrame([(1, "a"), (2, "b" * 3_000_000), (None, None)], "doc_id long, text string")
    out = sharding.shard(few, 24, bucket_bytes=1000)
    assert sorted((r.slot, len(r.row.text or "")) for r in out.collect()) == [(0, 0), (0, 1), (0, 3_000_000)]
    assert out.select("shard").distinct().count() == 3
    none = sharding.shard(few.limit(0), 24)
    assert none.columns == ["slot", "row", "shard"] and none.count() == 0


def test_positions_over_several_runs_of_buckets(spark):
    t = spark.range(9000).select((F.col("id") % 3001).alias("bucket"))
    before, total = sharding.positions(t)
    got = dict(before.collect())
    assert total == 9000 and got == {b: 3 * b - max(0, b - 2998) for b in range(3001)}
