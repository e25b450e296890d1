"""Data-quality checks, projections and filters (one pass over the data each).

Checks that look only at the schema (required columns, dtypes, split schema
equality) never touch the rows; row checks are single aggregates with
conditional counts, so they run as one map-side partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Logical dtypes of a schema table -> accepted Spark types ("int" also
# accepts floating point, as the reference tolerates float64 for int64).
LOGICAL_TYPES = {
    "float": (T.DoubleType, T.FloatType, T.DecimalType),
    "int": (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType),
    "string": (T.StringType,),
    "bool": (T.BooleanType,),
    "timestamp": (T.TimestampType, T.TimestampNTZType),
}


def required_columns(spark: SparkSession, df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Missing required columns, one row each (schema only, no scan)."""
    missing = [c for c in required if c not in df.columns]
    return spark.createDataFrame([(c,) for c in missing], "missing_column string")


def dtype_mismatches(spark: SparkSession, df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Columns whose Spark type does not fit the logical dtype."""
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = []
    for col, logical in schema.items():
        if col not in types:
            rows.append((col, logical, None, "missing"))
        elif not isinstance(types[col], LOGICAL_TYPES[logical]):
            rows.append((col, logical, types[col].simpleString(), "mismatch"))
    return spark.createDataFrame(rows, "column string, expected string, actual string, problem string")


def _is_missing(c: str, dtype) -> Column:
    col = F.col(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def missing_key_columns(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null/NaN count per key column and a pass flag (one aggregate, long form)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    agg = df.agg(*[F.count_if(_is_missing(c, types[c])).alias(c) for c in keys])
    stack = ", ".join(f"'{c}', `{c}`" for c in keys)
    return agg.selectExpr(f"stack({len(keys)}, {stack}) as (`column`, n_missing)").withColumn(
        "passed", F.col("n_missing") == 0)


def value_ranges(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Each named predicate: rows violating it (nulls ignored) and pass flag."""
    agg = df.agg(*[F.count_if(~F.coalesce(pred, F.lit(True))).alias(name) for name, pred in checks.items()])
    stack = ", ".join(f"'{n}', `{n}`" for n in checks)
    return agg.selectExpr(f"stack({len(checks)}, {stack}) as (`check`, n_violations)").withColumn(
        "passed", F.col("n_violations") == 0)


def missingness_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing count and percentage per column."""
    cols = list(columns or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    agg = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(_is_missing(c, types[c])).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return agg.selectExpr("__n", f"stack({len(cols)}, {stack}) as (`column`, n_missing)").select(
        "column", "n_missing",
        F.round(F.when(F.col("__n") > 0, F.col("n_missing") * 100.0 / F.col("__n")).otherwise(0.0), 6)
        .alias("pct_missing"))


def no_nulls_gate(df: DataFrame) -> list[str]:
    """Columns with any null/NaN (one aggregate); the caller raises on non-empty."""
    types = {f.name: f.dataType for f in df.schema.fields}
    row = df.agg(*[F.max(_is_missing(c, types[c]).cast("int")).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c]]


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fully duplicated rows beyond the first (nulls compare equal)."""
    cols = list(columns or df.columns)
    return df.groupBy(*cols).count().agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("n_duplicates"))


def missing_feature_split(df: DataFrame, features: str, required: Sequence[str]) -> DataFrame:
    """Adds ``missing_features`` (required keys absent from the map) and
    ``accepted`` (none missing; extra keys are allowed)."""
    req = F.array(*[F.lit(k) for k in required])
    miss = F.array_except(req, F.map_keys(F.col(features)))
    return df.withColumn("missing_features", miss).withColumn("accepted", F.size(miss) == 0)


CHECKOUT_REQUIRED = ["txn_id", "timestamp", "amount", "country", "ip_country", "currency",
                     "card_currency", "hour", "velocity_1h", "velocity_24h", "is_new_device",
                     "is_proxy_vpn"]


def required_fields_struct(df: DataFrame, payload: str, required: Sequence[str] = CHECKOUT_REQUIRED) -> DataFrame:
    """Required checkout fields missing (null) in a struct payload."""
    miss = F.array_compact(F.array(*[F.when(F.col(f"{payload}.{k}").isNull(), F.lit(k)) for k in required]))
    return df.withColumn("missing_fields", miss).withColumn("accepted", F.size(miss) == 0)


def split_schema_equal(dfs: dict[str, DataFrame]) -> bool:
    cols = [d.columns for d in dfs.values()]
    return all(c == cols[0] for c in cols)


def schema_align(df: DataFrame, schema_cols: Sequence[str]) -> DataFrame:
    missing = [c for c in schema_cols if c not in df.columns]
    if missing:
        raise ValueError(f"Output missing schema fields: {missing}")
    return df.select(*schema_cols)


def identify_columns(df: DataFrame, exclude: Sequence[str] = ("Class", "Time", "device_id")) -> tuple[list, list]:
    """(numeric, categorical) column names; booleans count as categorical."""
    num, cat = [], []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if isinstance(f.dataType, (T.StringType, T.BooleanType)):
            cat.append(f.name)
        elif isinstance(f.dataType, T.NumericType):
            num.append(f.name)
    return num, cat


def strip_prefix(df: DataFrame) -> DataFrame:
    import re
    return df.withColumnsRenamed({c: re.sub(r"^(num|cat)__", "", c) for c in df.columns
                                  if re.match(r"^(num|cat)__", c)})


def detect_label(df: DataFrame, candidates: Sequence[str] = ("Class", "class", "label", "is_fraud",
                                                             "y", "target")) -> str | None:
    for c in candidates:
        if c in df.columns:
            return c
    return None


def map_features_with_default(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Each target: exact column -> column named by the suffix after ``__`` -> 0.0."""
    cols = set(df.columns)
    out = []
    for t in targets:
        src = t if t in cols else (t.split("__", 1)[1] if "__" in t and t.split("__", 1)[1] in cols else None)
        if src is None:
            out.append(F.lit(0.0).alias(t))
        else:
            out.append(F.coalesce(F.col(f"`{src}`").cast("double"), F.lit(0.0)).alias(t))
    return df.select(*out)
