"""Removal of lines that many documents share, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import ascii_lower, discard, shipped, written

#: What a key loses at both ends: U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"


def _keys(norm: Column) -> Column:
    """Per line a 128-bit key, (0, 0) for a line whose key is empty."""

    def key(line: Column) -> Column:
        k = F.btrim(line, F.lit(BLANKS))
        empty = k == F.lit("")
        return F.struct(F.when(empty, F.lit(0)).otherwise(F.xxhash64(k)).alias("h1"), F.when(empty, F.lit(0)).otherwise(F.xxhash64(F.lit(1), k)).alias("h2"))

    return F.transform(F.split(norm, "\n"), key)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10) -> DataFrame:
    """Drop every line whose key is found in at least `min_docs` documents; other lines stay in place.

    A key is the line stripped of blanks at both ends with A-Z lower-cased; keys of no code point are never dropped.
    Returns per row: id, kept_text, n_lines (before), n_dropped.

    Lines are exploded to 128-bit hashes, once per document and hash, and counted with map-side sums. The keys over
    the threshold are written to the shared folder; they are broadcast if there are at most `broadcast_rows` of them
    and else joined by shuffle, where adaptive execution splits the hot keys. Only hashes and positions take part in
    that join. Each document then gets its dropped positions, at most one per line, and is put together again by
    position.

    Null and empty texts are one empty line. A very long text is one row of hashes, 16 bytes a line. Each row counts as a document, also when rows repeat or ids are null or
    equal: rows are matched by a 128-bit hash of id and text. Other columns are not read. An empty table gives an
    empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("body")).select(
        "id", "body", F.xxhash64("id", "body").alias("r1"), F.xxhash64(F.lit(1), "id", "body").alias("r2")
    )
    lines = written(rows.select("r1", "r2", _keys(ascii_lower(F.col("body"))).alias("line_keys")), "line-keys")
    empty = (F.col("h1") == 0) & (F.col("h2") == 0)
    hot = written(
        lines.select(F.inline(F.array_distinct("line_keys"))).where(~empty).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("in_docs")).where(F.col("in_docs") >= min_docs).select("h1", "h2"),
        "hot-lines",
    )
    exploded = lines.select("r1", "r2", F.posexplode("line_keys").alias("pos", "k")).select("r1", "r2", "pos", "k.h1", "k.h2").where(~empty)
    gone = written(
        exploded.join(shipped(hot, 16), ["h1", "h2"]).groupBy("r1", "r2").agg(F.collect_set("pos").alias("gone")),
        "dropped-lines",
    )
    discard(lines)
    joined = rows.join(gone.hint("shuffle_hash"), ["r1", "r2"], "left")
    parts = joined.select("id", "body", "gone", F.split("body", "\n").alias("parts"))
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    return parts.select(
        F.col("id").alias(id_col),
        F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join(F.transform(left, lambda i: F.get("parts", i)), "\n")).alias("kept_text"),
        F.size("parts").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
