"""The ``opN_*`` queries: each applies its operator to the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, conversation_repair, decontamination, language_id, lm_score, media, near_dedup, packing, pii, source_audit, token_files, toxicity, url_filter


def vocabulary(name: str) -> str:
    """Where the public vocabulary files lie; only the path is passed on."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("byte_bpe_50k.json"), 1024, 0)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_score.score(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    return url_filter.judge_urls(_table(spark, sf_dir, "pages", "page_id", "url", "html"), rules)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, folder = token_files.write_tokens(_table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("word_bpe_49k.json"), 1)
    return token_files.read_tokens(manifest, folder)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_repair.damage(_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return conversation_repair.repair_digests(turns, F.col("lost"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    labels = _table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.train(toxicity.labelled_sample(docs, labels.where(~toxicity.held_out())))
    found = toxicity.score(docs, model)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergences(_table(spark, sf_dir, "documents", "text", "lang", "source"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_media_columns, op3_language_id, op4_lm_score, op5_pii, op6_url_filter, op7_decontamination, op8_near_dedup, op9_token_files, op10_chat_format, op11_conversation_repair, op12_toxicity, op13_source_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op4_lm_score": lm_score.SCORE_SQL, "op6_url_filter": url_filter.JUDGE_SQL, "op7_decontamination": decontamination.CONTAMINATION_SQL, "op10_chat_format": chat.FORMAT_SQL, "op11_conversation_repair": conversation_repair.REPAIR_SQL, "op13_source_audit": source_audit.DIVERGENCE_SQL}
