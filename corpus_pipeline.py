"""Corpus pipeline over ``documents``: toxicity, near duplicates, secrets,
mixing, packing.  Each stage takes what its predecessor kept and, but for the
last, returns the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnguard.llm import mixing, ngram_join, packing, secrets, toxicity
from txnguard.llm.common import fold, read_table, stash


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; learns as ``op1`` does, from the labels
    that it may see."""
    labels = read_table(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1)
    return toxicity.keep_below(docs, toxicity.fit(docs.select("doc_id", "text"), labels), 0.7)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate class, null
    ids last."""
    return ngram_join.one_of_each_class(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark, ``n_chars`` (if there is one)
    counted anew."""
    out = secrets.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token shares meet flattened source, language and topic
    marginals."""
    rest = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    mixed = mixing.probabilities(docs.select("doc_id", "text", "source", "lang", rest), mixing.by_source_language_topic())
    return mixed.filter("mix_kept").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens."""
    import public_tokenizers
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_copies), ("secrets", hide_secrets),
          ("mixing", mix), ("packing", pack)]

#: Learned scores, randomness tests and the tokenizer can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
