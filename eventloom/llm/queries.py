"""The registered queries ``opN_<name>``: thin selections over the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_quotes, decontaminate, lm, near_dedup, quality_gam, quality_rules, substring_dedup, token_counts, warc
from .common import table, vocabulary


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_gam.scored(docs, quality_gam.trained(docs, table(spark, sf_dir, "labels")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules.judged(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_warc_converter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = warc.converted_pages(table(spark, sf_dir, "pages"))
    return d.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digested(bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = substring_dedup.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_quotes.reply_ordered(table(spark, sf_dir, "conversations"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"), quality_gam.fold(F.col("doc_id")) != 1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_quality_rules": op2_quality_rules,
    "op3_warc_converter": op3_warc_converter,
    "op4_bpe_encode_decode": op4_bpe_encode_decode,
    "op5_decontamination": op5_decontamination,
    "op6_near_dedup": op6_near_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quotation_linking": op8_quotation_linking,
    "op9_token_counts": op9_token_counts,
    "op10_lm_scoring": op10_lm_scoring,
}
