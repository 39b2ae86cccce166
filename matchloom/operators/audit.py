"""Audit of labelled pairs: counts, repeats, conflicts, lengths, damage, leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import digest, issues, squeeze

SIDES = ("resume", "jd")


def prepared(pairs: DataFrame) -> DataFrame:
    """Adds normalised texts, their hashes, and whether a row is usable (all three fields non-empty)."""
    out = pairs.withColumns({"resume_norm": squeeze(F.col("resume")), "jd_norm": squeeze(F.col("jd")), "label_norm": squeeze(F.col("label"))})
    usable = (F.col("resume_norm") != "") & (F.col("jd_norm") != "") & (F.col("label_norm") != "")
    return out.withColumns({"resume_hash": F.sha2("resume_norm", 256), "jd_hash": F.sha2("jd_norm", 256), "usable": usable})


def summary(rows: DataFrame) -> DataFrame:
    """One row: totals, exact repeats, repeated pairs, distinct documents and pairs, conflicting pairs.

    Texts are normalised and hashed once; all figures come from the counts of pairs, of which unusable rows are one.
    """
    usable = F.col("usable")
    per_pair = rows.groupBy("usable", F.when(usable, F.col("resume_hash")).alias("r"), F.when(usable, F.col("jd_hash")).alias("j")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label_norm").alias("labels"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per_pair.agg(
        total(F.col("n")).alias("total_rows"),
        total(F.when(usable, F.col("n"))).alias("usable_rows"),
        total(F.when(usable, F.col("n") - 1)).alias("repeated_pair_rows"),
        total(F.when(usable, F.col("n") - F.col("labels"))).alias("exact_duplicate_rows"),
        F.count_if("usable").alias("unique_pairs"),
        F.count_if(usable & (F.col("labels") > 1)).alias("conflicting_pairs"),
        F.count_distinct("r").alias("unique_resumes"),
        F.count_distinct("j").alias("unique_jds"),
    )


def missing(rows: DataFrame) -> DataFrame:
    counts = rows.agg(*(F.count_if(F.col(f"{f}_norm") == "").alias(f) for f in (*SIDES, "label")))
    return counts.unpivot([], [*SIDES, "label"], "field", "missing_rows")


def labels(rows: DataFrame) -> DataFrame:
    """Counts of all rows by label, those without one under <missing>, and their share of all rows."""
    counts = rows.groupBy(F.when(F.col("label_norm") == "", "<missing>").otherwise(F.col("label_norm")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(counts.agg(F.sum("n").alias("total"))).select("label", "n", (100 * F.col("n") / F.col("total")).alias("percent"))


def conflicts(rows: DataFrame) -> DataFrame:
    found = rows.where("usable").groupBy("resume_hash", "jd_hash").agg(F.array_sort(F.collect_set("label_norm")).alias("labels"))
    return found.where("size(labels) > 1").select("resume_hash", "jd_hash", F.array_join("labels", "|").alias("labels"))


def documents(rows: DataFrame, side: str) -> DataFrame:
    """Distinct usable documents of a side: hash, text, uses, and the ordinal of the first use."""
    return rows.where("usable").groupBy(F.col(f"{side}_hash").alias("hash")).agg(
        F.first(f"{side}_norm").alias("text"), F.count(F.lit(1)).alias("uses"), F.min("ordinal").alias("first_ordinal")
    )


def lengths(rows: DataFrame) -> DataFrame:
    """Count, smallest, median, nearest-rank p95 and largest length of the distinct documents of each side."""
    n = F.length("text")
    out = [
        documents(rows, s).agg(
            F.lit(s).alias("side"),
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.min(n), F.lit(0)).alias("smallest"),
            F.coalesce(F.median(n), F.lit(0.0)).alias("median_length"),
            F.coalesce(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY length(text))"), F.lit(0)).cast("long").alias("p95"),
            F.coalesce(F.max(n), F.lit(0)).alias("largest"),
        )
        for s in SIDES
    ]
    return out[0].unionByName(out[1])


def reused(rows: DataFrame, side: str, top: int = 20) -> DataFrame:
    """The documents used most, ties by first use, with a preview."""
    return documents(rows, side).orderBy(F.desc("uses"), "first_ordinal").limit(top).select(F.lit(side).alias("side"), "hash", "uses", F.left("text", F.lit(160)).alias("preview"))


def text_issues(rows: DataFrame) -> DataFrame:
    """Rows and distinct normalised documents with each problem, on raw texts of all rows."""
    parts = [
        rows.select(F.lit(s).alias("side"), F.col(f"{s}_hash").alias("hash"), F.explode(issues(F.col(s), s == "resume")).alias("issue")) for s in SIDES
    ]
    return parts[0].union(parts[1]).groupBy("side", "issue").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("hash").alias("n_documents"))


def key_of(kind: str) -> Column:
    return digest(F.col("resume_hash"), F.col("jd_hash"), sep=":") if kind == "pair" else F.col(f"{kind}_hash")


def leakage(rows: DataFrame, split: str, reference: str = "train") -> DataFrame:
    """By split other than the reference: distinct documents and pairs, and those also in the reference split."""
    kinds = rows.where("usable").select(F.col(split).alias("split"), F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), key_of(k).alias("hash")) for k in ("resume", "jd", "pair")))).alias("d"))
    flat = kinds.select("split", "d.kind", "d.hash").distinct()
    known = flat.where(F.col("split") == reference).select("kind", "hash", F.lit(1).alias("known"))
    return (
        flat.where(F.col("split") != reference)
        .join(known, ["kind", "hash"], "left")
        .groupBy("split", "kind")
        .agg(F.count(F.lit(1)).alias("n_unique"), F.count("known").alias("n_shared"))
    )


def hash_split(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Usable rows in an order by hash of seed and ordinal, cut at 80 and 90 per cent: sizes are exact, no global sort.

    Rows are ranked within the 65,536 buckets of the hash's first four digits, and buckets are numbered by a running sum of their
    sizes, so no task gets more than a bucket.
    """
    from pyspark.sql import Window

    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("ordinal").cast("string")), 256)
    usable = rows.where("usable").withColumn("h", h).withColumn("bucket", F.left("h", F.lit(4)))
    sizes = usable.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))
    ranked = usable.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("h", "ordinal"))).join(F.broadcast(before), "bucket")
    place, a = F.col("before") + F.col("rank"), F.floor(F.col("total") * 0.8)
    b = a + F.floor(F.col("total") * 0.1)
    return ranked.withColumn("split_hash", F.when(place <= a, "train").when(place <= b, "validation").otherwise("test")).drop("h", "bucket", "before", "total", "rank")
