"""Shards in uniformly random order by a two-pass external shuffle.

1. Scatter: every record goes to a memory-sized bucket drawn by a seeded hash
   of its content, with no regard to where it stood.
2. Each bucket is read whole, put in the order of its hashes and shuffled
   (Fisher-Yates, from a generator seeded by seed and bucket), and written.

The buckets one after another are a uniformly random order of all records.  A
shard is a run of that order, so the counts of two shards differ by one at
most; a record's place needs only the number of records of each bucket, which
is counted from the written buckets.  The shards are written as one folder each,
in order.

Nothing but one bucket is ever held: ``bucket_bytes`` bounds it, beside a
single longer record.  Repeated records (one may be a third of all) are told
apart by their number within the task that scatters them, so copies spread over
the buckets as other records do.  The order is a function of the seed and the
records; only that of fully repeated records also depends on how the input is
dealt to tasks, and a copy may take another's place without a trace.  Each pass
is a written table in the shared folder, so a lost executor repeats single tasks.

Defined cases: null columns are hashed as nulls; null and empty texts are
records like others; an empty table gives no shard; with fewer records than
shards some shards are empty; all columns stay inside ``row``, so none can
clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType

from txnguard.llm.common import U64, map_arrow, mix, stash, unstash

#: Tables of buckets of at most this many rows (16 bytes each) are broadcast.
BROADCAST_BUCKETS = 1 << 22
_COPY = U64(0x9E3779B97F4A7C15)


def _bucket(seed: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies: dict[int, int] = {}
        for b in batches:
            keys = b.column(0).to_numpy()
            number = np.zeros(len(keys), U64)
            for i, k in enumerate(keys.tolist()):
                number[i] = copies[k] = copies.get(k, -1) + 1
            drawn = mix(mix(keys.astype(U64) + U64(seed)) + number * _COPY)
            yield pa.RecordBatch.from_arrays([pa.array((drawn % U64(buckets)).astype(np.int64)), *b.columns], names=["bucket", "key", "row"])
    return run


def order(keys: np.ndarray, seed: int, bucket: int) -> np.ndarray:
    """Places of a bucket's records: by key, then Fisher-Yates (which is what
    ``Generator.permutation`` does)."""
    draw = np.random.Generator(np.random.Philox(key=[seed, bucket]))
    return np.argsort(keys, kind="stable")[draw.permutation(len(keys))]


def _shuffle(seed: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        n, bucket = t.num_rows, key[0].as_py()
        t = t.take(order(t.column("key").to_numpy(), seed, bucket))
        return pa.table([t.column("bucket"), pa.array(np.arange(n)), t.column("row")], names=["bucket", "place", "row"])
    return run


def scatter(docs: DataFrame, seed: int, buckets: int) -> DataFrame:
    """``(bucket, key, row)``."""
    plain = [c.name for c in docs.schema if not isinstance(c.dataType, MapType)]
    kept = docs.select(F.xxhash64(*[docs[f"`{c}`"] for c in plain]).alias("key"), F.struct("*").alias("row"))
    schema = StructType([StructField("bucket", LongType()), *kept.schema])
    return map_arrow(kept, _bucket(seed, buckets), schema)


def shuffle(docs: DataFrame, seed: int = 0, bucket_bytes: int = 32 << 20) -> DataFrame:
    """``(bucket, place, row)``: all records, written bucket by bucket."""
    texts = [F.coalesce(F.octet_length(docs[f"`{c.name}`"]), F.lit(0)) for c in docs.schema if isinstance(c.dataType, StringType)]
    total = docs.agg(F.sum(sum(texts, F.lit(8 * len(docs.columns)).cast("long")))).first()[0] or 0
    dealt = scatter(docs, seed, max(1, -(-total // bucket_bytes)))
    schema = StructType([dealt.schema["bucket"], StructField("place", LongType()), dealt.schema["row"]])
    return stash(dealt.groupBy("bucket").applyInArrow(_shuffle(seed), schema), "shuffled")


def positions(shuffled: DataFrame) -> tuple[DataFrame, int]:
    """``(bucket, before)``, the number of records in smaller buckets, and the
    number of all.  Summed in runs of 1024 buckets, so that no window holds more
    than these or one row of each run."""
    counts = stash(shuffled.groupBy("bucket").count().withColumn("run", F.col("bucket").bitwiseAND(F.lit(-1024))), "buckets")
    runs = counts.groupBy("run").agg(F.sum("count").alias("n"))
    earlier = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    before = counts.withColumn("within", F.coalesce(F.sum("count").over(inside), F.lit(0))).join(runs, "run")
    total = counts.agg(F.sum("count"), F.count("*")).first()
    before = before.select("bucket", (F.col("base") + F.col("within")).alias("before"))
    return (F.broadcast(before) if total[1] <= BROADCAST_BUCKETS else before), total[0] or 0


def shard(docs: DataFrame, shards: int, seed: int = 0, bucket_bytes: int = 32 << 20) -> DataFrame:
    """``(slot, row, shard)``, read from the written shards; ``row`` holds the
    columns of ``docs``, ``slot`` counts a shard's records from 0."""
    shuffled = shuffle(docs, seed, bucket_bytes)
    before, total = positions(shuffled)
    at, n = F.col("before") + F.col("place"), F.lit(shards).cast("long")
    which = F.call_function("div", at * n, F.greatest(F.lit(total), F.lit(1)))
    first = F.call_function("div", F.col("shard") * F.lit(total) + n - 1, n)
    placed = (shuffled.join(before, "bucket").select(at.alias("at"), "row", which.cast("int").alias("shard"))
              .select((F.col("at") - first).alias("slot"), "row", "shard").sortWithinPartitions("shard", "slot"))
    out = stash(placed, "shards", by="shard")
    unstash(shuffled)
    return out
