"""A corpus pipeline of five of the operators, each stage written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import decontamination, language_id, near_dedup, packing, pii
from trackloom.llm.registry import vocabulary
from trackloom.llm.shared import work_dir

#: A document stays where one language has at least this share of the likelihood.
LEAST_SCORE = 0.5


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a determined language go; ``lang`` becomes the predicted one.

    Null and empty texts, texts without a letter and those where no language has ``LEAST_SCORE``
    go; texts of any length are read whole; repeated rows are judged each for itself; without a
    labelled row, and for an empty table, nothing stays.
    """
    model = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.identify(docs, model, keep=docs.columns)
    kept = found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    names = {"doc_id": "of_doc_id", "lang": "lang_pred", "score": "of_score", "lang_pred": "of_lang_pred"}
    return kept.select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each class the document with the least doc_id stays.

    Null texts count as empty, and equal texts without words are one class; of rows that repeat
    doc_id and text one stays; rows without doc_id stay where their whole class has none.
    """
    return near_dedup.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: contaminated documents go, the others lose the stretches they share with test items.

    Null and empty texts have no words and stay as they are; repeated rows are judged each for
    itself; without test items everything stays.  ``n_chars`` is measured anew.
    """
    return _measured(decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: every span becomes the name of its kind; no document goes.

    Null and empty texts stay as they are; spans that overlap become one; repeated rows are
    redacted each for itself.  ``n_chars`` is measured anew.
    """
    return _measured(pii.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of sequences of 1024 ids; a null or empty text is the end id alone, an empty table gives no piece."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), 1024, 0)


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


STAGES = [("language_id", keep_language), ("near_dedup", drop_near_copies), ("decontamination", drop_benchmark), ("pii", redact_pii), ("packing", pack_sequences)]

#: Tokenisers, signatures and trained models have no SQL form: tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
