"""A training corpus from ``documents``: rules, near and substring dedup, decontamination, token ids.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of
``docs``. Rows are told apart by id and text, so that rows that share an id or
have none are judged one by one.

Defined results: null and blank texts fail the quality rules; a stage by itself
leaves them alone. Rows that repeat are one group of copies. A very long text is
a row like any other; an empty table gives an empty result; other columns are
carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import bpe, decontaminate, near_dedup, quality_rules, substring_dedup
from eventloom.llm.common import WORD, stored, table, vocabulary


#: Words of a shingle and similarity of near copies in the pipeline; those of op6 bind only that query.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    return quality_rules.judged(rows, id_col="row").filter("kept").select("row.*")


#: A list of rows to remove is broadcast up to so many (about 60 bytes each).
BROADCAST_ROWS = 200_000


def keyed(docs: DataFrame) -> DataFrame:
    """The rows as ``row`` with ``key``: whether the id lacks, the id, and two hashes of the text."""
    parts = [F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("t"), F.hash("text").alias("u")]
    return docs.select(F.struct(*parts).alias("key"), F.struct("*").alias("row"), "text")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    gone = stored(gone, "gone")
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "key", "left_anti")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest id; rows without an id come last."""
    d = keyed(docs)
    gone = near_dedup.near_duplicates(d.select(F.col("key").alias("doc_id"), "text"), size=NEAR_SHINGLE, percent=NEAR_PERCENT).filter("not kept")
    left = without(d, gone.select(F.col("doc_id").alias("key")).distinct())
    # Rows that repeat have one key. Texts without words are copies of nothing.
    solid = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    return left.filter(solid).dropDuplicates(["key"]).select("row.*").union(left.filter(~solid).select("row.*"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated stretches; a text that loses nothing stays as it is."""
    found = substring_dedup.substring_dedup(docs.select(F.struct("*").alias("row"), "text"))
    lost = F.col("n_removed") > 0
    changed = {"text": F.when(lost, F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(lost, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    d = keyed(docs)
    gone = decontaminate.contaminated(d.select("key", "text"), table(spark, sf_dir, "benchmark"), id_col="key").select("key").distinct()
    return without(d, gone).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.digested(bpe.encode_decode(docs, vocabulary("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_dedup", near_copies),
    ("substring_dedup", repeats),
    ("decontamination", decontamination),
    ("bpe", tokens),
]

#: Near-duplicate groups and token ids are beyond SQL over whole tables; tests hold the result against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
