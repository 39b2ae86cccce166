"""Nested pages of a remote database, as JSON text, made flat; and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import application_key, band, day

#: Names of the properties of an outside schema, here and below.
_TEXT = "title: ARRAY<STRUCT<plain_text: STRING, text: STRUCT<content: STRING>>>, rich_text: ARRAY<STRUCT<plain_text: STRING, text: STRUCT<content: STRING>>>"
_CHOICE = "status: STRUCT<name: STRING>, select: STRUCT<name: STRING>"
#: One shape for all kinds of property.
PROPERTY = f"STRUCT<{_TEXT}, {_CHOICE}, url: STRING, checkbox: BOOLEAN, number: DOUBLE, date: STRUCT<start: STRING>>"
PAGE = f"id STRING, created_time STRING, last_edited_time STRING, properties MAP<STRING, {PROPERTY}>"

STATUSES = ("Applied", "In Progress", "Rejected", "Cancelled")


def parsed(pages: DataFrame, column: str = "json") -> DataFrame:
    return pages.select(F.from_json(column, PAGE).alias("page"))


def _property(name: str) -> Column:
    return F.try_element_at(F.col("page.properties"), F.lit(name))


def text_value(name: str) -> Column:
    """The joined runs of a title or text property; empty if it has none."""
    p = _property(name)
    runs = F.coalesce(F.when(F.size(p["title"]) > 0, p["title"]), p["rich_text"], F.array())
    return F.array_join(F.transform(runs, lambda r: F.coalesce(F.nullif(r["plain_text"], F.lit("")), r["text"]["content"], F.lit(""))), "")


def choice_value(name: str) -> Column:
    p = _property(name)
    return F.coalesce(p["status"]["name"], p["select"]["name"], F.lit(""))


def applications(pages: DataFrame) -> DataFrame:
    """Thirteen flat columns of an application page."""
    return parsed(pages).select(
        text_value("Application key").alias("application_key"),
        text_value("Company").alias("company"),
        text_value("Job title").alias("job_title"),
        F.coalesce(_property("Job URL")["url"], F.lit("")).alias("job_url"),
        choice_value("Job source").alias("job_source"),
        F.left(F.coalesce(_property("Application date")["date"]["start"], F.lit("")), F.lit(10)).alias("application_date"),
        choice_value("Resume version").alias("resume_version"),
        choice_value("Status").alias("status"),
        F.coalesce(_property("Requested for sponsorship")["checkbox"], F.lit(False)).alias("requested_for_sponsorship"),
        F.coalesce(_property("Referral")["checkbox"], F.lit(False)).alias("referral"),
        text_value("Job description").alias("job_description"),
        F.coalesce("page.created_time", F.lit("")).alias("created_at"),
        F.coalesce("page.last_edited_time", F.lit("")).alias("updated_at"),
    )


def scores(pages: DataFrame) -> DataFrame:
    """Flat columns of a score page; JSON fields that can't be read are empty, absent ones null."""
    filled = lambda c: F.nullif(c, F.lit(""))
    return parsed(pages).select(
        _property("Score")["number"].alias("score"),
        choice_value("Band").alias("band"),
        F.coalesce(F.from_json(text_value("Matched terms"), "ARRAY<STRING>"), F.array()).alias("matched_terms"),
        F.coalesce(F.from_json(text_value("Category breakdown"), "MAP<STRING, DOUBLE>"), F.from_json(F.lit("{}"), "MAP<STRING, DOUBLE>")).alias("category_breakdown"),
        filled(text_value("Fit label")).alias("fit_label"),
        _property("Fit probability")["number"].alias("fit_probability"),
        _property("Decision threshold")["number"].alias("decision_threshold"),
    )


def update_errors(rows: DataFrame) -> DataFrame:
    """Updated applications with trimmed fields, their new key, and an array of what is wrong with them.

    Reads seven texts; and, where the columns are there, `unknown` (names of fields that an update may not have) and the
    flags referral and requested_for_sponsorship, which must be booleans or texts "true" or "false".
    """
    names = ("company", "job_title", "job_url", "job_source", "application_date", "status", "job_description")
    out = rows.withColumns({n: F.trim(F.coalesce(F.col(n), F.lit(""))) for n in names})
    wrong = []
    if "unknown" in rows.columns:
        extra = F.array_sort("unknown")
        wrong.append(F.when(F.size(extra) > 0, F.concat(F.lit("unknown fields: "), F.array_join(extra, ", "))))
    wrong += [F.when(F.col(n) == "", F.lit(f"{n} is required")) for n in names[:4]]
    wrong.append(F.when(day(F.col("application_date")).isNull() | (F.length("application_date") != 10), "application_date must be YYYY-MM-DD"))
    wrong.append(F.when(~F.col("status").isin(*STATUSES), "status is unknown"))
    for flag in ("requested_for_sponsorship", "referral"):
        if flag in rows.columns:
            known = F.coalesce(F.col(flag).cast("string").isin("true", "false"), F.lit(False))
            wrong.append(F.when(~known, F.lit(f"{flag} must be a boolean")))
    return out.withColumns({"errors": F.array_compact(F.array(*wrong)), "application_key": application_key(F.col("company"), F.col("job_title"), F.col("job_source"))})


def score_errors(rows: DataFrame) -> DataFrame:
    """Score results with trimmed, distinct terms in order without regard to case, trimmed categories, and what is wrong.

    Reads application_key, input_fingerprint, scorer_version, embedding_model, score, band, matched_terms and
    category_breakdown.
    """
    needed = ("application_key", "input_fingerprint", "scorer_version", "embedding_model")
    terms = F.array_distinct(F.filter(F.transform("matched_terms", lambda t: F.trim(t)), lambda t: t != ""))
    ordered = F.array_sort(terms, lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    names = F.transform(F.map_keys("category_breakdown"), lambda n: F.trim(n))
    values = F.map_values("category_breakdown")
    score = F.col("score")
    in_range = lambda v: v.isNotNull() & ~F.isnan(v) & v.between(0, 100)
    wrong = [F.when(F.trim(F.coalesce(F.col(n), F.lit(""))) == "", F.lit(f"{n} is required")) for n in needed]
    wrong += [
        F.when(score.isNull(), "score must be a number").when(~in_range(score), "score must be between 0 and 100"),
        F.when(in_range(score) & ~F.col("band").eqNullSafe(band(score)), "band doesn't fit the score"),
        F.when(F.col("matched_terms").isNull(), "matched_terms must be an array"),
        F.when(F.col("category_breakdown").isNull(), "category_breakdown must be an object"),
        F.when(F.exists(names, lambda n: n == ""), "a category has no name"),
        F.when(F.size(F.array_distinct(names)) < F.size(names), "category names must differ"),
        F.when(F.exists(values, lambda v: ~in_range(v)), "a category must be between 0 and 100"),
    ]
    return rows.withColumns({"errors": F.array_compact(F.array(*wrong)), "matched_terms": ordered})
