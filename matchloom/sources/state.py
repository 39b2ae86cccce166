"""Tables of the scoring service, derived from the tables at hand by fixed rules."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import text
from matchloom.sources import bindings as b

AS_OF = datetime.datetime(1998, 7, 15)
VERSION, MODEL, REVISION = "v2", "e1", ""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of application pages, repeated as applications repeat."""
    return b.applications(spark, sf_dir).select("application_key")


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring inputs of two thirds of the applications, one for each key (its smallest order), with fingerprint and cache key."""
    apps = b.applications(spark, sf_dir)
    first = apps.groupBy("application_key").agg(F.min(F.struct("o_orderkey", "company", "title", "created")).alias("a"))
    whole = F.length(F.regexp_replace("text", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    # a text is measured and hashed once, not for each application, and isn't moved
    docs = b.table(spark, sf_dir, "documents").select("doc_id", whole.alias("description_chars"), F.sha2("text", 256).alias("job_description_hash"))
    k = F.col("a.o_orderkey")
    rows = first.where(k % 3 != 0).withColumn("doc_id", k % docs.count()).join(docs, "doc_id")
    out = rows.select(
        k.alias("k"),
        "application_key",
        "description_chars",
        "job_description_hash",
        F.when(k % 23 == 0, "partial").when(k % 41 == 0, "unavailable").otherwise("complete").alias("extraction_quality"),
        F.sha2(F.concat(F.lit("resume"), (k % 5).cast("string")), 256).alias("resume_content_hash"),
        text.role_company_key(F.col("a.company"), F.col("a.title")).alias("role_company_key"),
        F.col("a.created").alias("captured_at"),
        (k % 29 != 0).alias("snapshot_valid"),
    )
    scorer = [F.lit(x) for x in (VERSION, MODEL, REVISION)]
    return out.withColumns(
        {
            "input_fingerprint": text.input_fingerprint(F.col("application_key"), F.col("resume_content_hash"), F.col("job_description_hash"), *scorer),
            "cache_key": text.cache_key(F.col("role_company_key"), F.col("resume_content_hash"), *scorer),
        }
    )


def jobs(spark: SparkSession, sf_dir: str, own: DataFrame | None = None) -> DataFrame:
    """A job for three quarters of the inputs, in all states; `own` are inputs() if they are there already."""
    k, at = F.col("k"), F.col("captured_at")
    state = k % 7
    status = F.when(state == 0, "waiting_application").when(state == 1, "queued").when(state < 5, "running").when(state == 5, "completed").otherwise("failed")
    runs = state.between(2, 4)
    later = lambda n: at + F.make_dt_interval(secs=k % n)
    return (inputs(spark, sf_dir) if own is None else own).where(k % 4 != 0).select(
        k.alias("id"),
        "application_key",
        "input_fingerprint",
        status.alias("status"),
        (k % 6).alias("attempt_count"),
        at.alias("next_run_at"),
        F.when(runs, F.concat(F.lit("w"), (k % 3).cast("string"))).alias("lease_owner"),
        F.when(runs, later(900)).alias("lease_until"),
        (state == 4).alias("publishing"),
        F.when(k % 5 == 0, F.lit("1998-07-14 23:50:00").cast("timestamp")).otherwise(later(1800)).alias("updated_at"),
    )


def runs(spark: SparkSession, sf_dir: str, captured: DataFrame | None = None) -> DataFrame:
    """Score runs with what made them; their fingerprints are those of the inputs, but for some. `captured` are inputs() if they are there already."""
    own = b.score_runs(spark, sf_dir).join(b.applications(spark, sf_dir).select(F.col("o_orderkey").alias("run_id"), "application_key"), "run_id")
    r = F.col("run_id")
    made = own.withColumns({"version": F.when(r % 11 == 0, "v1").otherwise(VERSION), "model": F.when(r % 13 == 0, "e0").otherwise(MODEL), "revision": F.when(r % 17 == 0, "r1").when(r % 2 == 0, REVISION)})
    known = (inputs(spark, sf_dir) if captured is None else captured).select("application_key", "resume_content_hash", "job_description_hash", "input_fingerprint")
    expected = text.input_fingerprint(F.col("application_key"), F.col("resume_content_hash"), F.col("job_description_hash"), F.col("version"), F.col("model"), F.coalesce("revision", F.lit("")))
    stated = F.when(r % 19 == 0, F.sha2(F.lit("unknown"), 256)).otherwise(F.col("input_fingerprint"))
    return made.join(known, "application_key", "left").withColumns({"expected_fingerprint": expected, "input_fingerprint": stated})


def score_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of score pages: those of most runs, and orphans."""
    own = b.score_runs(spark, sf_dir).where("run_id % 7 <> 0").join(b.applications(spark, sf_dir).select(F.col("o_orderkey").alias("run_id"), "application_key"), "run_id")
    orphans = b.table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(F.sha2(F.concat(F.lit("orphan"), F.col("o_orderkey").cast("string")), 256).alias("application_key"))
    return own.select("application_key").union(orphans)


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached scores of some inputs, in part expired."""
    return inputs(spark, sf_dir).where("k % 5 = 0").select("cache_key", (F.col("captured_at") + F.expr("INTERVAL 1000 DAYS")).alias("expires_at"))


def remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache keys of scores in the remote table."""
    return inputs(spark, sf_dir).where("k % 4 = 1").select("cache_key")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for a score of each input; some ask for a new one."""
    return inputs(spark, sf_dir).select(F.col("k").alias("id"), "cache_key", "description_chars", "extraction_quality", (F.col("k") % 10 == 0).alias("force"))
