"""A training corpus from raw documents: language, exact and near copies, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All stages but the last return the columns of documents. An empty table passes through all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import bpe, decontaminate, exact_dedup, language_id, near_dedup
from matchloom.llm._util import shipped, table, text_key, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told, and puts the one that was found in place of a null lang.

    Null and empty texts and those without a letter go; any other text stays, also if no label covers its language or
    none is given. Very long texts are read whole; repeated rows, ties and null ids don't matter.
    """
    return language_id.keep_identified(docs, language_id.learn_from_kept_in(docs), lang_col="lang")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased; null is empty) the row with the smallest doc_id stays.

    Of rows that repeat that id and text, and of a group without ids, one stays. A text isn't dropped because another
    one has its id. Very long texts are compared whole; other columns don't matter.
    """
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, similarity 0.75) the smallest doc_id stays.

    Rows without an id and texts without words stay. Where several texts share an id, they are told apart by a running
    number in the order of ids, so that each is judged by itself; rows that repeat id and text stay or go together.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    if rows.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        keyed = rows.select("*", *text_key(F.col("body")))
        order = keyed.where("id IS NOT NULL").select("id", "k1", "k2").distinct().orderBy("id", "k1", "k2")
        numbers = written(order.withColumn("number", F.monotonically_increasing_id()), "numbered-rows")
        rows = written(keyed.join(numbers, ["id", "k1", "k2"], "left").select("row", F.col("number").alias("id"), "body"), "rows-by-number")
    copies = near_dedup.near_dedup(rows, id_col="id", text_col="body").where("id IS NOT NULL AND NOT kept")
    gone = written(copies.select("id").distinct(), "dropped-near-copies")
    return rows.join(shipped(gone, 8), "id", "left_anti").select("row.*")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain three quarters of the shingles of a benchmark item; texts without words stay."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens, the ids (little-endian 32-bit integers) and whether they decode to the text; null counts as empty."""
    coded = bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.withColumn("round_trip", F.col("decoded") == F.coalesce("text", F.lit(""))).drop("decoded")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode),
]

#: Language profiles, near-copy components and merges aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
