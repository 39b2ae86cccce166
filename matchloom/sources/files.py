"""File catalogs, event-stream text, supplied descriptions and ragged token tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.storage import shipped, written


def catalog(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """Documents <family>/pdf/<name>.pdf below a folder: version, label, path, modified (newest first), and their SHA-256 if asked."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(folder)
    parts = F.split("path", "/")
    family, stem = F.element_at(parts, -3), F.regexp_replace(F.element_at(parts, -1), r"\.pdf$", "")
    found = files.where(F.element_at(parts, -2) == "pdf").select(
        F.concat(family, F.lit("/"), stem).alias("version"),
        F.concat(F.initcap(F.replace(family, F.lit("-"), F.lit(" "))), F.lit(" | "), stem).alias("label"),
        "path",
        F.col("modificationTime").alias("modified"),
        *([F.sha2("content", 256).alias("content_sha256")] if content else []),
    )
    return found.orderBy(F.desc("modified"), "version")


def events_of(lines: DataFrame) -> DataFrame:
    """(stream, pos, event, data) of event-stream lines (stream, pos, line): each data line has the last event before it."""
    kind = F.when(F.col("line").startswith("event:"), F.trim(F.expr("substring(line, 7)")))
    last = F.last(kind, ignorenulls=True).over(Window.partitionBy("stream").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("event", last).where(F.col("line").startswith("data:")).select("stream", "pos", "event", F.trim(F.expr("substring(line, 6)")).alias("data"))


def completed(lines: DataFrame) -> DataFrame:
    """(stream, outcome, data): the first complete or error event of each stream, or "unfinished"."""
    ends = events_of(lines).where(F.col("event").isin("complete", "error"))
    first = ends.groupBy("stream").agg(F.min(F.struct("pos", "event", "data")).alias("e")).select("stream", "e.event", "e.data")
    return lines.select("stream").distinct().join(first, "stream", "left").select("stream", F.coalesce("event", F.lit("unfinished")).alias("outcome"), "data")


def supplied(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON object of descriptions by application key."""
    kind = "MAP<STRING, STRUCT<job_description: STRING, provenance: STRING, captured_at: STRING, extraction_quality: STRING, resume_content_hash: STRING>>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", kind)).alias("application_key", "d")).select("application_key", "d.*")


def offsets(counts: DataFrame) -> DataFrame:
    """(document_hash, offset, token_count) of token matrices laid end to end, longest first, equal lengths by hash.

    Three sums make an offset: of longer documents (a row for each length), of the buckets of hashes before a document's in
    its length (4,096 rows for each length at most), and its place within its bucket. No window sees all documents of a length.
    """
    bucket = F.left("document_hash", F.lit(3)).alias("bucket")
    cells = counts.groupBy("token_count", bucket).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("token_count").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    within = cells.select("token_count", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    longer = Window.orderBy(F.desc("token_count")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = cells.groupBy("token_count").agg(F.sum("n").alias("n"))
    before = sizes.select("token_count", F.coalesce(F.sum(F.col("n") * F.col("token_count")).over(longer), F.lit(0)).alias("before"))
    starts = written(within.join(before, "token_count"), "offset-cells")
    place = F.row_number().over(Window.partitionBy("token_count", "bucket").orderBy("document_hash")) - 1
    placed = counts.select("document_hash", "token_count", bucket).withColumn("place", place).join(shipped(starts, 32), ["token_count", "bucket"])
    return placed.select("document_hash", (F.col("before") + (F.col("ahead") + F.col("place")) * F.col("token_count")).cast("long").alias("offset"), "token_count")


def offset_errors(index: DataFrame, rows: int, cells: int = 4096) -> DataFrame:
    """What is wrong with a token index: repeated hashes, bad ranges, gaps or overlaps, and what lies beyond the matrix.

    Rows follow each other within cells of offsets; only the cells' first offsets are put in one order.
    """
    cell = F.floor(F.col("offset") / max(1, -(-rows // cells)))
    placed = index.withColumn("cell", F.greatest(F.lit(-1), F.least(F.lit(cells + 1), cell)))
    firsts = placed.groupBy("cell").agg(F.min("offset").alias("first"))
    after = firsts.select("cell", F.lead("first").over(Window.orderBy("cell")).alias("after"))
    local = placed.withColumn("next", F.lead("offset").over(Window.partitionBy("cell").orderBy("offset", "document_hash")))
    checked = local.join(F.broadcast(after), "cell").withColumn("next", F.coalesce("next", "after"))
    end = F.col("offset") + F.col("token_count")
    return checked.agg(
        (F.count(F.lit(1)) - F.count_distinct("document_hash")).alias("repeated"),
        F.count_if((F.col("offset") < 0) | (F.col("token_count") <= 0)).alias("bad_ranges"),
        F.count_if(F.col("next") != end).alias("gaps"),
        F.count_if(end > rows).alias("beyond"),
    )


def cleaned(col: Column) -> Column:
    """An extracted text without blanks at the ends of lines and without empty lines; a text of nothing else is an error."""
    lines = F.transform(F.split(col, "\n"), lambda x: F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    out = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    return F.when(out != "", out).otherwise(F.raise_error(F.lit("the file has no text")).cast("string"))


def extracted(catalog_rows: DataFrame, extractor: Callable[[bytes], str], content: str = "content") -> DataFrame:
    """Adds text: what an extractor makes of a file's content, cleaned. The extractor is a function that workers call."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda data: extractor(bytes(data)))

    return catalog_rows.withColumn("text", cleaned(run(content)))
