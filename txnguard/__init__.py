"""txnguard: fraud-analytics operators on Spark DataFrames.

Every public operator is a plain function ``op(df, ...) -> DataFrame`` usable
with ``df.transform(op, ...)``.  Work is expressed with the DataFrame API and
Spark SQL functions so Catalyst can prune, push down and codegen it; Python
runs only inside Arrow-batched ``mapInPandas`` where no built-in exists.
"""

__all__ = ["session"]
