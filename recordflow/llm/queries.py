"""The queries of the training-data operators and, where SQL can say it, their oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, oracles, toxicity
from .bpe import encode_documents
from .jaccard import jaccard_components
from .lines import drop_repeated_lines
from .materialize import materialize
from .ogg import media_features
from .packing import pack_documents
from .resample import resample
from .secretscan import secret_spans
from .spelling import spelling_variants
from .substring import dedup_substrings
from .winnow import compare_fingerprints


#: Vocabulary file of the queries that need token ids; the operators take its path as a parameter.
VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_documents(spark, sf_dir), size=20)


def op5_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_documents(spark, sf_dir), k=5, percent=80)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_documents(spark, sf_dir), vocabulary())


def op7_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(_documents(spark, sf_dir))


def op8_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), vocabulary(), capacity=2048, separator=0)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(_documents(spark, sf_dir))


def crc(column: str) -> Column:
    """crc32 of an id as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def learned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled rows that may be learned from; the rest measure accuracy."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc("doc_id") % 5 != 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity.fit(docs, learned_labels(spark, sf_dir)))
    return scored.select("doc_id", (crc("doc_id") % 5 == 0).alias("held_out"), "score", "predicted", "evidence", "cosines")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = langid.label(docs, langid.learn(docs.where(crc("doc_id") % 4 != 2)))
    return found.select("doc_id", (crc("doc_id") % 4 == 2).alias("held_out"), "lang_pred", "score")


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(_documents(spark, sf_dir), vocabulary(), length=512, shard_rows=8192, key=1)


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_fingerprints(_documents(spark, sf_dir), k=5, w=16)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_documents(spark, sf_dir), least_chars=5, least_count=3, ratio=2, every=97)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=25, longest=2, buckets=10_000, least_words=20, seed=7)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(_documents(spark, sf_dir), least_chars=40, least_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if re.match(r"op\d", name)} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
