"""From raw documents to packed training sequences, in five stages.

Each stage works on all rows that the one before kept.  All but the last return
the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordflow.llm import jaccard, packing, secretscan, store, substring, toxicity
from recordflow.llm.queries import learned_labels, vocabulary


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity index rejects go; a null text stays."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, learned_labels(spark, sf_dir)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one with the smallest doc_id stays."""
    return jaccard.keep_one(docs, k=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more that also stand earlier are cut out of the text."""
    return _counted(substring.without_repeats(docs, size=20))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced in the text."""
    return _counted(secretscan.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their sequences and offsets."""
    return packing.pack_documents(docs, vocabulary(), capacity=2048, separator=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeated_passages", cut_repeats),
    ("secrets", hide_secrets),
    ("packing", pack),
]

#: No stage here can be said in SQL as a whole; tests compare each with a direct version.
ORACLE_SQL = None


@store.tidy
def _written(spark: SparkSession, docs: DataFrame, sf_dir: str, name: str, stage) -> DataFrame:
    return store.cut(stage(spark, docs, sf_dir), f"stage-{name}")


@store.tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = _written(spark, docs, sf_dir, name, stage)
    return STAGES[-1][1](spark, docs, sf_dir)
