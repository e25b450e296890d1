"""Scans and sinks.

Paths are Hadoop paths (local, HDFS, object stores); existence checks go
through the Hadoop FileSystem of the session, never the driver's local
disk.  Writes that must survive retries are keyed (partition folders,
overwrite per batch) so a re-run replaces rather than duplicates.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnguard.session import ensure_checkpoint_dir

# Fixed value: multiplier of the exact-n sample order (Knuth's multiplicative hash).
SAMPLE_MULTIPLIER = 2654435761


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster checkpoint location."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/txnguard-io/{name}-{uuid.uuid4().hex[:8]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def scan_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, sample_n: int | None = None,
               key: str | None = None) -> DataFrame:
    """Read a table; with ``sample_n`` return exactly n rows chosen by a
    deterministic hash order of ``key`` (top-n by hash: the sample size is
    the feature)."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", True)
    df = r.load(path)
    if sample_n is None:
        return df
    h = F.pmod(F.col(key).cast("long") * F.lit(SAMPLE_MULTIPLIER), F.lit(1 << 32))
    return df.orderBy(h, F.col(key)).limit(sample_n)


def feature_label_split(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    return df.drop(label), df.select(label)


def fallback_chain(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet") -> tuple[str, DataFrame]:
    """First existing source among ``paths``."""
    for p in paths:
        if path_exists(spark, p):
            return p, spark.read.format(fmt).load(p)
    raise FileNotFoundError(f"none of {list(paths)} exists")


def json_payloads(spark: SparkSession, path: str, features: Sequence[str], key: str = "txn_id") -> DataFrame:
    """Recursive JSON documents ``{key, features: {...}}`` -> one column per
    model feature, missing -> 0.0."""
    raw = spark.read.option("recursiveFileLookup", True).text(path)
    doc = F.from_json("value", f"struct<{key}:long, features:map<string,double>>")
    d = raw.select(doc.alias("d"))
    m = F.col("d.features")
    return d.select(F.col(f"d.{key}").alias(key),
                    *[F.coalesce(F.element_at(m, f), F.lit(0.0)).alias(f) for f in features])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "overwrite") -> str:
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)
    return path


def write_with_fallback(df: DataFrame, path: str, formats: Sequence[str] = ("parquet", "csv")) -> tuple[str, str]:
    """Write with the first format that succeeds (CSV as the fallback)."""
    last = None
    for fmt in formats:
        try:
            write_table(df, f"{path}/{fmt}", fmt)
            return fmt, f"{path}/{fmt}"
        except Exception as e:  # noqa: BLE001 -- a missing writer falls through to the next format
            last = e
    raise RuntimeError(f"no format worked: {last}")


def write_json_records(df: DataFrame, path: str, key: str, partition_by: Sequence[str] = ()) -> str:
    """One JSON document per row (``to_json(struct(*))``), keyed folders."""
    out = df.select(*partition_by, F.to_json(F.struct(*[c for c in df.columns if c not in partition_by])).alias("value"))
    w = out.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.text(path)
    return path


def reproducibility_signature(df: DataFrame, order: Sequence[str], n: int = 200) -> DataFrame:
    """Order-sensitive signature of the first ``n`` rows: the position is
    hashed together with each row, then summed exactly as DECIMAL(38,0)."""
    from pyspark.sql import Window
    head = df.orderBy(*order).limit(n)
    w = Window.orderBy(*order)
    h = F.xxhash64(F.row_number().over(w), *[F.col(c) for c in df.columns])
    return head.select(h.cast("decimal(38,0)").alias("h")).agg(
        F.sum("h").cast("string").alias("signature"), F.count(F.lit(1)).alias("n_rows"))


def whole_signature(df: DataFrame) -> DataFrame:
    """Signature of all rows, whatever their order: each row is hashed with the
    places of its nulls, and the hashes are summed exactly as DECIMAL(38,0)."""
    h = F.xxhash64(*[F.col(c) for c in df.columns], *[F.col(c).isNull() for c in df.columns])
    return df.select(h.cast("decimal(38,0)").alias("h")).agg(
        F.sum("h").cast("string").alias("signature"), F.count(F.lit(1)).alias("n_rows"))
