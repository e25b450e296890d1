"""Structured Streaming versions of the scoring path and its monitors.

Sources are file streams (a landing folder of Parquet files, one file per
trigger); sinks are either the exactly-once file sink or ``foreachBatch``
writes keyed by ``batch_id`` (a replayed batch overwrites its own folder,
so retries after a lost executor never duplicate rows).  Everything lives
under the cluster checkpoint folder (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnguard.operators import drift
from txnguard.session import ensure_checkpoint_dir


def work_dir(spark: SparkSession, *parts: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, "txnguard-stream", *parts])


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def landing(spark: SparkSession, src: DataFrame, name: str, order_col: str | None, n_files: int = 4,
            split_col: str | None = None) -> str:
    """Write ``src`` as ``n_files`` Parquet files appended one after the
    other (increasing modification time = stream order).  With
    ``order_col`` file i holds the i-th time range; with ``split_col`` file
    i holds rows with ``split_col % n == i`` (each file spans all times, so
    later files carry late rows)."""
    path = work_dir(spark, "landing", f"{name}-{uuid.uuid4().hex[:8]}")
    if order_col is not None:
        ranged = src.repartitionByRange(n_files, order_col).withColumn("__part", F.spark_partition_id())
    else:
        ranged = src.withColumn("__part", F.pmod(F.col(split_col), F.lit(n_files)))
    ranged = ranged.checkpoint(eager=True)  # reliable: the n writes below see one fixed split
    for i in range(n_files):
        ranged.where(F.col("__part") == i).drop("__part").coalesce(1).write.mode("append").parquet(path)
    return path


def read_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def deal(stream: DataFrame, keys: Sequence[str], rows: int, rows_per_task: int = 200_000) -> DataFrame:
    """``stream`` dealt by ``keys`` before rows are multiplied: a batch is one
    file, so what follows its scan would run in one task.  ``rows`` is the largest
    number of rows in a batch."""
    n = int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stream.repartition(max(n, -(-rows // rows_per_task)), *keys)


def run_available(writer) -> None:
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def foreach_batch_to(path: str, fn: Callable[[DataFrame, int], DataFrame]):
    """foreachBatch body: ``fn(batch, id)`` written to ``path/batch_id=id``
    with overwrite, so a replayed batch id replaces its own output."""
    def body(batch: DataFrame, batch_id: int) -> None:
        fn(batch, batch_id).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return body


# ---------------------------------------------------------------- stateful velocity
VELOCITY_OUT = T.StructType([T.StructField("txn_id", T.LongType()), T.StructField("device_id", T.LongType()),
                             T.StructField("txn_count_5m", T.LongType()), T.StructField("txn_count_30m", T.LongType()),
                             T.StructField("txn_count_60m", T.LongType())])
VELOCITY_STATE = T.StructType([T.StructField(c, T.ArrayType(T.LongType())) for c in ("ts", "ids", "devices")])
WINDOWS_S = (300, 1800, 3600)


def velocity_state_fn(seconds_per_unit: int):
    """Exact trailing counts per device within (device or bucket of devices, time
    chunk) across micro-batches.  A null key is the null device.

    The state keeps the rows that a row not older than the watermark can still
    count, so it doesn't grow with a device's history; once the watermark has
    passed the last row by the longest window, a timer removes it.  A late row
    (behind others, not behind the watermark) counts what has come before it."""
    import numpy as np
    hold = max(WINDOWS_S) * seconds_per_unit * 1000  # event time, ms

    def run(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        t0, i0, d0 = (np.asarray(x, dtype=np.int64) for x in (state.get if state.exists else ((), (), ())))
        batch = pd.concat(list(pdfs), ignore_index=True)
        timeless = pd.isna(key[1])
        t1, i1, d1 = (batch[c].to_numpy(np.int64) for c in ("t", "txn_id", "device"))
        if timeless:
            t1 = np.zeros(len(batch), np.int64)
        t, ids, devices = np.concatenate([t0, t1]), np.concatenate([i0, i1]), np.concatenate([d0, d1])
        order = np.lexsort((ids, t, devices))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        t_sorted, d_sorted = t[order], devices[order]
        # device (by rank) and time as one number; the times of a chunk lie close together
        rank = np.cumsum(np.diff(d_sorted, prepend=d_sorted[0]) != 0)
        low = int(t.min())
        span = int(t.max()) - low + 1
        at = rank * span + (t_sorted - low)
        own = batch["own"].to_numpy(bool)
        mine, t_own = place[len(t0):][own], t1[own]
        device = pd.array([None] * len(mine), "Int64") if pd.isna(key[0]) else d1[own]
        out = {"txn_id": i1[own], "device_id": device}
        for name, s in zip(("txn_count_5m", "txn_count_30m", "txn_count_60m"), WINDOWS_S, strict=True):
            first = rank[mine] * span + (span if timeless else np.maximum(t_own - s - low, 0))
            out[name] = mine - np.searchsorted(at, first, side="left") + 1
        unit = seconds_per_unit * 1000
        seen = state.getCurrentWatermarkMs()
        keep = t_sorted * unit + unit > seen - hold
        state.update((t_sorted[keep].tolist(), ids[order][keep].tolist(), d_sorted[keep].tolist()))
        state.setTimeoutTimestamp(max(int(t.max()) * unit + unit + hold, seen + 1))
        yield pd.DataFrame(out)
    return run


def stateful_velocity(stream: DataFrame, et: str = "et", delay: str = "10 minutes", seconds_per_unit: int = 1,
                      chunk_units: int = 4 * max(WINDOWS_S), buckets: int | None = None) -> DataFrame:
    """``stream (device_id, txn_id, t, et)``; ``t`` counts units of
    ``seconds_per_unit`` seconds of the event time ``et``.  The state's key is
    (device, chunk of ``chunk_units``): the last hour of a chunk's rows also goes
    to the next one, uncounted, so a hot device is many groups, each bounded in time.

    With ``buckets`` the key is (bucket of devices, chunk): a group costs far more
    than a row, so that many devices of a few rows each should share one."""
    from pyspark.sql.streaming.state import GroupStateTimeout
    t, longest = F.col("t"), max(WINDOWS_S)
    if chunk_units <= longest:
        raise ValueError("chunk_units must exceed the longest window")
    chunk = ((t - F.pmod(t, F.lit(chunk_units))) / chunk_units).cast("long")
    here, after = F.struct(chunk.alias("chunk"), F.lit(True).alias("own")), F.struct((chunk + 1).alias("chunk"), F.lit(False).alias("own"))
    to = F.when(F.pmod(t, F.lit(chunk_units)) >= chunk_units - longest, F.array(here, after)).otherwise(F.array(here))
    key = "device_id"
    if buckets is not None:
        key = "bucket"
        stream = stream.withColumn(key, F.when(F.col("device_id").isNotNull(), F.pmod(F.xxhash64("device_id"), F.lit(buckets))))
    rows = stream.withWatermark(et, delay).select(key, F.coalesce("device_id", F.lit(0).cast("long")).alias("device"), "txn_id", "t", et, F.explode(to).alias("c"))
    rows = rows.select(key, F.col("c.chunk").alias("chunk"), "device", "txn_id", "t", F.col("c.own").alias("own"), et)
    return rows.groupBy(key, "chunk").applyInPandasWithState(
        velocity_state_fn(seconds_per_unit), VELOCITY_OUT, VELOCITY_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def device_buckets(spark: SparkSession, rows: int, rows_per_bucket: int = 100_000) -> int:
    """Buckets of devices for ``rows`` rows in all: some for every task, and so many
    that a bucket's rows stay bounded as the table grows."""
    return max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_bucket))


# ---------------------------------------------------------------- state in buckets
class BucketedState:
    """A keyed state that is a fold of an event log, kept in hash buckets.

    Every batch appends its events by bucket, folds the logs of the buckets that
    it touches and writes only those buckets' states.  A manifest per batch says
    which version of each bucket holds, so old versions are never changed: a
    replayed batch starts from the manifest before it and gives the same state,
    and a reader of an older manifest still finds its files."""

    def __init__(self, spark: SparkSession, path: str, key: str, fold: Callable[[DataFrame], DataFrame], buckets: int = 64):
        self.spark, self.path, self.key, self.fold, self.buckets = spark, path, key, fold, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def manifest(self, batch_id: int) -> dict[int, int]:
        """Version of each bucket after a batch; empty before the first."""
        if batch_id < 0:
            return {}
        return dict(self.spark.read.parquet(f"{self.path}/manifest/batch_id={batch_id}").select("bucket", "version").collect())  # ``buckets`` rows

    def apply(self, batch: DataFrame, batch_id: int) -> list[int]:
        """Takes in a batch (a ``foreachBatch`` body); returns the touched buckets."""
        batch = batch.withColumn("bucket", self._bucket())
        log = f"{self.path}/events"
        batch.write.mode("overwrite").partitionBy("bucket").parquet(f"{log}/batch_id={batch_id}")
        touched = sorted(r[0] for r in batch.select("bucket").distinct().collect())  # at most ``buckets``
        if touched:
            events = self.spark.read.option("basePath", log).schema(batch.schema.add("batch_id", T.IntegerType())).parquet(log)
            events = events.where(F.col("bucket").isin(touched) & (F.col("batch_id") <= batch_id)).drop("batch_id", "bucket")
            state = self.fold(events).withColumn("bucket", self._bucket())
            state.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/state/version={batch_id}")
        now = self.manifest(batch_id - 1) | dict.fromkeys(touched, batch_id)
        rows = self.spark.createDataFrame(sorted(now.items()), "bucket int, version int")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch_id={batch_id}")  # ``buckets`` rows
        return touched

    def read(self, batch_id: int) -> DataFrame:
        """The state after a batch."""
        files = [f"{self.path}/state/version={v}" for v in sorted(set(self.manifest(batch_id).values()))]
        holds = reduce(lambda a, b: a | b, [(F.col("bucket") == b) & (F.col("version") == v) for b, v in self.manifest(batch_id).items()], F.lit(False))
        return self.spark.read.option("basePath", f"{self.path}/state").parquet(*files).where(holds).drop("bucket", "version")


# ---------------------------------------------------------------- drift monitor
class DriftMonitor:
    """PSI of each micro-batch, and of all batches so far, against a baseline
    whose edges and counts are written once.  A batch leaves only its counts per
    cell; counts of batches add up, and a replayed batch replaces its own."""

    def __init__(self, spark: SparkSession, path: str, features: Sequence[str]):
        self.spark, self.path, self.features = spark, path, list(features)

    def fit(self, baseline: DataFrame) -> None:
        drift.fit_baseline(baseline.select(*self.features), self.features).write.mode("overwrite").parquet(f"{self.path}/baseline")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        model = self.spark.read.parquet(f"{self.path}/baseline")
        counts = drift.count_cells(model, batch.select(*self.features), self.features)
        counts.write.mode("overwrite").parquet(f"{self.path}/counts/batch_id={batch_id}")

    def report(self, batch_id: int | None = None, total: bool = False) -> DataFrame:
        """Of one batch, of each batch, or of all together (``total``)."""
        model = self.spark.read.parquet(f"{self.path}/baseline")
        counts = self.spark.read.parquet(f"{self.path}/counts")
        if total:
            return drift.psi_of_counts(model, counts.groupBy("feature", "cell").agg(F.sum("a").alias("a")))
        ids = [batch_id] if batch_id is not None else sorted(r[0] for r in counts.select("batch_id").distinct().collect())
        parts = [drift.psi_of_counts(model, counts.where(F.col("batch_id") == i).drop("batch_id")).withColumn("batch_id", F.lit(i)) for i in ids]
        return reduce(DataFrame.unionByName, parts)
