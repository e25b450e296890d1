"""Helpers shared by the operators: scratch tables, Arrow mapping, word
hashing over UTF-8 buffers, and connected components."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from txnguard.session import ensure_checkpoint_dir

U64 = np.uint64
#: Bytes that end a word: blank, tab, newline, vertical tab, form feed, return.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
_BLOCK = 1 << 18  # bytes hashed at a time
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, with a
    folder for each value of its last column if ``by`` names it.  Cuts the
    lineage, so that a lost executor never repeats what stands before it; the
    write's shuffle files are of no more use and go with it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, partitionBy=by)
    finally:
        spark.conf.set(_CLEANUP, before)
    where, files = _path(spark, path)
    files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def unstash(*tables: DataFrame) -> None:
    """Remove stashed tables that no later step reads."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            where, files = _path(t.sparkSession, path)
            files.delete(where, True)


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str | StructType, rows: int = 256) -> DataFrame:
    """``mapInArrow`` with small batches, so that long texts fit a worker.  A
    worker that comes from another stage first drops what it kept there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _enter_stage()
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df.mapInArrow(run, schema)


_KEPT: dict = {}  # of a worker, for the tasks of one stage


def _enter_stage() -> None:
    stage = TaskContext.get().stageId()
    if _KEPT.get("stage") != stage:
        had = len(_KEPT) > 1
        _KEPT.clear()
        _KEPT["stage"] = stage
        if had:
            gc.collect()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # give freed pages back where libc can
            if trim:
                trim(0)


def kept_in_stage(name: str, make: Callable):
    """What ``make`` gives, kept by a worker for later tasks of the same stage."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def batch(schema: pa.Schema, cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)],
        schema=schema)


# ------------------------------------------------------------------ hashing
def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift, multiply) that spreads every input bit."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = U64(base), U64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> Powers:
        if len(self.up) < n:
            self.up, self.down = (np.multiply.accumulate(
                np.concatenate([np.ones(1, U64), np.full(n - 1, b, U64)])) for b in (self.base, self.inverse))
        return self


_BYTES = Powers(0x9E3779B97F4A7C15)
_ROLL = (Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F))


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Polynomial hash modulo 2**64 of ``values[s:e]`` for each span; a span's
    hash doesn't depend on where it stands."""
    powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers.up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * powers.down[starts]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of concatenated UTF-8 texts.

    ``offsets`` bounds the texts in ``data``.  Returns start, end (bytes),
    64-bit hash of each word, and for each text the index of its first word
    (one more entry at the end).
    """
    sep = _IS_SEP[data]
    head = np.empty(len(data), bool)
    if len(data):
        head[0] = True
        head[1:] = sep[:-1]
        inner = offsets[:-1][offsets[:-1] < len(data)]
        head[inner] = True
    starts = np.flatnonzero(head & ~sep)
    stop = np.empty(len(data), bool)
    if len(data):
        stop[-1] = True
        stop[:-1] = sep[1:]
        inner = offsets[1:][(offsets[1:] > 0)] - 1
        stop[inner] = True
    ends = np.flatnonzero(stop & ~sep) + 1
    hashes = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        if j == i + 1 and b - a > _BLOCK:
            hashes[i] = int.from_bytes(hashlib.blake2b(data[a:b].tobytes(), digest_size=8).digest(), "little")
        else:
            hashes[i:j] = spans(data[a:b].astype(U64) + U64(1), starts[i:j] - a, ends[i:j] - a, _BYTES)
        i = j
    first = np.searchsorted(starts, offsets)
    return starts, ends, mix(hashes ^ (ends - starts).astype(U64)), first


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and bounds of a string column (null: empty)."""
    col = col.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset: col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0]: offsets[-1]] if len(col) else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def text_blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 22):
    """Yield ``(slice of the batch, bytes, bounds)`` of at most about ``most``
    bytes of text each (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        data, offsets = text_buffer(b.column(b.schema.get_field_index(text)))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            yield b.slice(i, j - i), data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]
            i = j


def rolling(hashes: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` words (also of runs over text bounds)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    s = np.arange(n)
    h = hashes if which == 0 else mix(hashes + U64(0x632BE59BD9B4E019))
    return mix(spans(h, s, s + size, _ROLL[which]))


# ------------------------------------------------------------------ components
def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges (a, b)``: ``(node, root)``, root the
    smallest node of the component.

    Min-label propagation with pointer jumping; each round is written to the
    shared folder.  Hot nodes are safe: labels are minima, combined before the
    shuffle.
    """
    spark = edges.sparkSession
    both = stash(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = stash(both.groupBy("a").agg(F.min("b").alias("m"))
                   .select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "cc")
    while True:
        hop = (both.join(labels.select(F.col("node").alias("b"), "root"), "b")
               .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near")))
        new = labels.join(hop, "node").select("node", "root", F.least("root", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        new = new.join(jump, "low").select("node", F.least("low", "far").alias("to"), "root")
        new = stash(new, "cc")
        moved = new.filter("to < root").limit(1).count()
        labels = new.select("node", F.col("to").alias("root"))
        if not moved:
            return labels
