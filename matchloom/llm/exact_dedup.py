"""Exact deduplication with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import ascii_lower, discard, shipped, written


def _hashes(docs: DataFrame, id_col: str, text_col: str, *others: Column) -> DataFrame:
    norm = docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"), *others)
    return norm.select("*", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, keep: str) -> DataFrame:
    """Per row id, h1, h2, sha, keep_id, group_size."""
    pick = {"min": F.min, "max": F.max}[keep]
    hashed = _hashes(docs, id_col, text_col)
    groups = written(
        hashed.groupBy("h1", "h2", "norm")
        .agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h1", "h2", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size")
        .groupBy("h1", "h2", "sha")
        .agg(F.count(F.lit(1)).alias("texts"), pick("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
        .withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share both hashes")))),
        "text-groups",
    )
    return hashed.select("id", "h1", "h2", F.sha2("norm", 256).alias("sha")).join(groups, ["h1", "h2", "sha"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """Group equal texts by a 128-bit content hash and say which row of each group stays.

    Texts are equal when identical after lower-casing A-Z. `keep` names the id that stays: "min" (the smallest
    stable id) or "max". Returns per row: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    The groups come from one aggregation whose key is the hash and the text itself, so Spark's key comparison
    compares the bytes inside each hash group; copies collapse on the map side before the shuffle. Rows then find
    their group through hash and SHA-256, by a join with the written group table whose hot keys adaptive execution
    splits; two different texts that share both raise an error.

    Null and empty texts count as one text, "". Very long texts are keys like others, shuffled once per map task. A null id never stays unless all ids of its group are null.
    Rows repeated with the same id and text each give a row. Other columns are not read, so their names cannot
    clash. An empty table gives an empty result.
    """
    return _grouped(docs, id_col, text_col, keep).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row of each group of equal texts, with all columns of `docs`: that with the id that exact_dedup() keeps.

    Rows are decided one by one, by id and text: two texts under one id don't drop each other, of rows that repeat the
    id and text that stay one stays, and so does one of a group in which no row has an id.
    """
    decided = written(_grouped(docs, id_col, text_col, keep).select("id", "h1", "h2", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept")), "copies")
    gone = written(decided.where("NOT kept").select("id", "h1", "h2").distinct(), "dropped-copies")
    again = written(decided.where("kept").groupBy("id", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated-rows")
    discard(decided)

    def matches(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
        same = rows["id"].eqNullSafe(other["id"]) & (rows["h1"] == other["h1"]) & (rows["h2"] == other["h2"])
        return rows.join(shipped(other, 24), same, how)

    left = matches(_hashes(docs, id_col, text_col, F.struct("*").alias("row")).drop("norm"), gone, "left_anti")
    if again.limit(1).count():
        left = matches(left, again, "left_anti").unionByName(matches(left, again, "left_semi").dropDuplicates(["id", "h1", "h2"]))
    return left.select("row.*")
