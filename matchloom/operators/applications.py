"""Dashboards, search, insights, backfill and reconciliation over applications."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("Applied", "In Progress", "Rejected", "Cancelled")


def dashboard(applications: DataFrame, on: datetime.date) -> DataFrame:
    """Applications of the day, the week (from Monday) and the month of `on`, none after it."""
    week = on - datetime.timedelta(days=on.weekday())
    month = on.replace(day=1)
    a = F.col("applied")
    return applications.where(a.between(min(week, month), on)).agg(
        F.count_if(a == on).alias("current_day"), F.count_if(a >= week).alias("current_week"), F.count_if(a >= month).alias("current_month")
    )


def monthly(applications: DataFrame, start: datetime.date, end: datetime.date) -> DataFrame:
    """Applications between two dates by known status, with zeros, and their total including unknown ones."""
    counts = applications.where(F.col("applied").between(start, end)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    known = applications.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return known.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n")).crossJoin(total)


def search(applications: DataFrame, query: str, status: str | None = None, limit: int = 8) -> DataFrame:
    """Applications whose company, title and source hold every term, newest first; all of them if a status is chosen."""
    text = F.lower(F.concat_ws(" ", "company", "title", "source"))
    found = applications
    for term in query.lower().split():
        found = found.where(F.contains(text, F.lit(term)))
    if status:
        found = found.where(F.col("status") == status)
    found = found.select("o_orderkey", "application_key", "company", "title", "status", "applied", "source", "created")
    found = found.orderBy(F.desc("applied"), F.desc("created"), "o_orderkey")
    return (found if status else found.limit(limit)).drop("created")


def matched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Each left row with how its key is found on the right: missing, unique or ambiguous."""
    n = right.groupBy(key).agg(F.count(F.lit(1)).alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("found") == 1, "unique").otherwise("ambiguous")
    return left.join(n, key, "left").withColumn("state", state)


def insights(applications: DataFrame, scores: DataFrame) -> DataFrame:
    """Applications with a unique key and the score logged under it, and its band."""
    unique = matched(applications, applications.select("application_key"), "application_key").where("state = 'unique'")
    from matchloom.functions.text import band

    per = scores.groupBy("application_key").agg(F.count(F.lit(1)).alias("n_scores"), F.max("score").alias("score"))
    joined = unique.join(per, "application_key", "left")
    score = F.when(F.col("n_scores") == 1, F.col("score"))
    return joined.select("application_key", "company", score.alias("score"), F.when(score.isNotNull(), band(score)).alias("band"))


def backfill(rows: DataFrame, as_of: datetime.datetime, least: int = 100, keep_days: int = 365) -> DataFrame:
    """Rows by the first rule that rules them out, or "eligible"; age is in whole elapsed days.

    Reads application_key, description, provenance, quality, captured, resume_matches, historical_hash, resume_hash,
    existing_description_hash.
    """
    elapsed = F.unix_micros(F.lit(as_of.isoformat(sep=" ")).cast("timestamp")) - F.unix_micros(F.col("captured").cast("timestamp"))
    age = F.floor(elapsed / 86_400_000_000)
    reason = (
        F.when(F.coalesce("application_key", F.lit("")) == "", "missing_application_key")
        .when(F.coalesce("description", F.lit("")) == "", "missing_description")
        .when(~F.col("provenance").isin("original_saved", "manual_supplied", "recaptured_current_page"), "invalid_provenance")
        .when((F.col("quality") != "complete") | (F.length("description") < least), "low_quality_description")
        .when(F.col("captured").isNull(), "invalid_capture_time")
        .when(age > keep_days, "expired_description")
        .when(F.col("resume_matches") == 0, "missing_resume_snapshot")
        .when(F.col("resume_matches") > 1, "ambiguous_resume_snapshot")
        .when(F.coalesce("historical_hash", F.lit("")) == "", "missing_historical_resume_hash")
        .when(F.col("historical_hash") != F.col("resume_hash"), "resume_snapshot_changed")
        .when(F.col("existing_description_hash") != F.sha2("description", 256), "immutable_input_conflict")
        .otherwise("eligible")
    )
    return rows.withColumn("reason", reason)


def first_runs(runs: DataFrame) -> DataFrame:
    """Score runs with a flag for the first of each application."""
    return runs.withColumn("is_first", F.col("run_id") == F.min("run_id").over(Window.partitionBy("application_key")))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Upsert: of each key the row that is last in the order."""
    whole = F.struct(*order, *[c for c in rows.columns if c not in order])
    return rows.groupBy(key).agg(F.max(whole).alias("row")).select("row.*").select(rows.columns)
