"""Queries on the scoring service's state, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import presentation, text
from matchloom.operators import applications as ap
from matchloom.operators import state as st
from matchloom.plans.features import rounded
from matchloom.plans.service import APPS, scored_sql
from matchloom.sources import bindings as b
from matchloom.sources import state as src
from matchloom.storage import written

AT = src.AS_OF
#: Scoring needs descriptions of so many characters here, so that some have too few.
LEAST = 200
_TABLES = ("inputs", "jobs", "runs")


def _tables(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"inputs": src.inputs(s, d).select("application_key"), "jobs": src.jobs(s, d).select("application_key"), "runs": src.runs(s, d).select("application_key")}


def _sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, keys and a sum over the keys' digits of each table."""
    out = None
    for name, t in tables.items():
        digits = F.conv(F.substring("application_key", 1, 8), 16, 10).cast("long")
        part = t.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("application_key").alias("n_keys"), F.coalesce(F.sum(digits), F.lit(0)).alias("digits"))
        out = part if out is None else out.union(part)
    return out


def _renames(s: SparkSession, d: str) -> DataFrame:
    """New keys for some inputs: fresh ones, and some that an input has already."""
    rows = src.inputs(s, d).where("k % 5 = 0").select("k", F.col("application_key").alias("old_key"))
    taken = src.inputs(s, d).agg(F.min("application_key").alias("taken"))
    fresh = F.sha2(F.concat(F.lit("new"), F.col("old_key")), 256)
    return rows.crossJoin(taken).select("old_key", F.when(F.col("k") % 10 == 0, fresh).otherwise(F.col("taken")).alias("new_key"))


def _immutable(s: SparkSession, d: str) -> DataFrame:
    """Inputs with captures of the same and of new applications, of which only new keys get in."""
    known = src.inputs(s, d).select("application_key", F.col("k").alias("order_key"), F.lit("known").alias("origin"))
    new = b.applications(s, d).select("application_key", F.col("o_orderkey").alias("order_key"), F.lit("new").alias("origin"))
    return st.insert_new(known, new, "application_key", "order_key").groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum("order_key").alias("orders"))


def _health(s: SparkSession, d: str) -> DataFrame:
    e = b.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = e.agg(F.max("ts")).first()[0]
    if last is None:
        return st.health(st.heartbeats(e, "user_id", "ts"), AT)
    return rounded(st.health(st.heartbeats(e, "user_id", "ts"), last.replace(microsecond=0), 600), "age_seconds", digits=3)


def _changes(s: SparkSession, d: str) -> DataFrame:
    e = b.table(s, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return st.changes(e, "user_id", "ts", "event_id", F.col("event_type"), 3600).select("user_id", "event_id", "payload")


def _updates(s: SparkSession, d: str) -> DataFrame:
    """Edits of applications, some of them wrong, with what is wrong."""
    from matchloom.sources import pages

    k = F.col("o_orderkey")
    rows = b.applications(s, d).select(
        k,
        F.when(k % 7 == 0, "  ").otherwise(F.col("company")).alias("company"),
        F.col("title").alias("job_title"),
        F.when(k % 5 != 0, F.lit("http://x/")).alias("job_url"),
        F.col("source").alias("job_source"),
        F.when(k % 11 == 0, "1998-2-3").otherwise(F.col("applied").cast("string")).alias("application_date"),
        F.when(k % 13 == 0, "Odd").otherwise(F.col("status")).alias("status"),
        F.lit(None).cast("string").alias("job_description"),
        F.when(k % 17 == 0, "yes").otherwise("true").alias("referral"),
        F.lit("false").alias("requested_for_sponsorship"),
        F.when(k % 19 == 0, F.array(F.lit("salary"))).otherwise(F.array().cast("array<string>")).alias("unknown"),
    )
    found = pages.update_errors(rows)
    return found.groupBy(F.array_join("errors", "|").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


def _duplicates(s: SparkSession, d: str) -> DataFrame:
    key = F.col("application_key")
    known = ap.latest(b.applications(s, d).select("application_key", "status", "created", "o_orderkey"), "application_key", "created", "o_orderkey")
    asked = b.table(s, d, "customer").select("c_custkey", text.application_key(F.col("c_name"), F.lit("1-URGENT"), F.col("c_mktsegment")).alias("application_key"))
    shown, kind = presentation.duplicate_status(F.col("status").isNotNull(), F.col("status"))
    return asked.join(known.select(key, "status"), "application_key", "left").select("c_custkey", shown.alias("text"), kind.alias("class"))


def _shown(s: SparkSession, d: str) -> DataFrame:
    r = F.col("run_id")
    score = F.round("score", 1)
    rows = b.score_runs(s, d).select("run_id", score.alias("score"), text.band(score).alias("band"), F.when(r % 3 == 0, F.when(r % 2 == 0, "Good Fit").otherwise(" no fit ")).alias("fit"))
    shown, kind = presentation.score_text(F.col("score"), F.col("band"), F.col("fit"))
    return rows.select("run_id", shown.alias("text"), kind.alias("class"))


def _breakdown(s: SparkSession, d: str) -> DataFrame:
    r = F.col("run_id")
    values = F.map_from_arrays(F.array(*(F.lit(x) for x in ("bonus", "core", "other", "required"))), F.array(r % 100 + 0.25, F.col("score"), F.lit(1.0), F.when(r % 3 != 0, (r % 1000) / 10.0)))
    rows = b.score_runs(s, d).select("run_id", F.inline(presentation.breakdown(values)))
    return rows.select("run_id", "label", F.col("value").cast("double").alias("value"), "class").groupBy("label", "class").agg(F.count(F.lit(1)).alias("n"))


def _decisions(s: SparkSession, d: str) -> DataFrame:
    own = written(src.inputs(s, d).select("application_key", "resume_content_hash", "job_description_hash", "input_fingerprint"), "scoring-inputs")
    return st.publication_decisions(src.runs(s, d, own), own, src.pages(s, d), src.score_pages(s, d))


def _reconciled(s: SparkSession, d: str) -> DataFrame:
    own = written(src.inputs(s, d).drop("role_company_key", "cache_key"), "scoring-inputs")
    return st.reconciliation(src.jobs(s, d, own), own, own, src.pages(s, d), src.score_pages(s, d), src.runs(s, d, own), AT, src.VERSION, src.MODEL, src.REVISION, LEAST)


def _keys(s: SparkSession, d: str) -> DataFrame:
    i = src.inputs(s, d)
    return i.select("k", "input_fingerprint", "cache_key")


def _preview(s: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    empty = F.lit("")
    return b.table(s, d, "customer").select(
        "c_custkey",
        text.preview_application_key(
            F.when(c % 2 == 0, F.col("c_name")).otherwise(empty), F.when(c % 3 == 0, F.concat(F.lit("https://a/"), c.cast("string"))), F.concat(F.lit("https://b/"), c.cast("string")), F.when(c % 5 == 0, F.lit("T")), F.when(c % 7 == 0, c.cast("string")), F.when(c % 11 == 0, F.col("c_mktsegment"))
        ).alias("key"),
    )


def _prepared(s: SparkSession, d: str) -> DataFrame:
    body, quality = text.capped(F.col("text"), F.when(F.col("doc_id") % 4 == 0, "unavailable"), 1000)
    return b.table(s, d, "documents").select("doc_id", body.alias("body"), quality.alias("quality")).groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("body")).alias("longest"), F.sum(F.length("body")).alias("chars"))


def _months(s: SparkSession, d: str) -> DataFrame:
    month = F.when(F.col("o_orderkey") % 9 == 0, "1998-13").when(F.col("o_orderkey") % 10 == 0, "98-1").otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    start, end = text.month_bounds(month)
    return b.table(s, d, "orders").select(month.alias("month")).distinct().select("month", *(x.cast("string").alias(n) for x, n in zip(text.month_bounds(F.col("month")), ("start", "last"), strict=True)))


def _retries(s: SparkSession, d: str) -> DataFrame:
    return src.jobs(s, d).select("id", text.retry_delay(F.col("attempt_count")).alias("delay"))


QUERIES = {
    "job_inputs": lambda s, d: st.with_inputs(src.jobs(s, d), src.inputs(s, d).drop("input_fingerprint")).select("id", "application_key", "status", "extraction_quality"),
    "input_keys": _keys,
    "preview_keys": _preview,
    "prepared_inputs": _prepared,
    "month_bounds": _months,
    "next_runnable_job": lambda s, d: st.next_runnable(src.jobs(s, d), AT).select("id", "application_key", "status"),
    "eligible_inputs": lambda s, d: src.inputs(s, d).groupBy(st.usable_input(F.col("description_chars"), F.col("extraction_quality"), LEAST).alias("worker_takes"), st.usable_input(F.col("description_chars"), F.col("extraction_quality"), LEAST, ("complete",)).alias("service_takes")).agg(F.count(F.lit(1)).alias("n")),
    "immutable_inputs": _immutable,
    "activate_jobs": lambda s, d: st.activated(src.jobs(s, d), src.pages(s, d), AT).where("activated").select("id", "status"),
    "recover_leases": lambda s, d: st.leases_recovered(src.jobs(s, d), AT).groupBy("status", "publishing", "recovered").agg(F.count(F.lit(1)).alias("n"), F.count("lease_owner").alias("owned")),
    "publication_recovery": lambda s, d: st.publications_settled(src.jobs(s, d), src.score_pages(s, d), AT).where("outcome IS NOT NULL").select("id", "outcome", "status", "publishing"),
    "missing_score_jobs": lambda s, d: st.missing_jobs(src.inputs(s, d), src.jobs(s, d), src.pages(s, d), LEAST),
    "worker_health": _health,
    "rename_applications": lambda s, d: _sizes(st.renamed(_tables(s, d), _renames(s, d))),
    "delete_applications": lambda s, d: _sizes(st.deleted(_tables(s, d), src.inputs(s, d).where("k % 5 = 0"))),
    "worker_steps": lambda s, d: st.worker_steps(src.jobs(s, d), src.inputs(s, d), src.runs(s, d).where("input_fingerprint IS NOT NULL AND run_id % 2 = 0"), src.cache(s, d), AT, LEAST),
    "publication_decisions": _decisions,
    "score_tiers": lambda s, d: st.score_tiers(src.requests(s, d), src.cache(s, d), src.remote(s, d), AT, LEAST),
    "metadata_changes": _changes,
    "reconcile_report": _reconciled,
    "application_updates": _updates,
    "application_total": lambda s, d: b.applications(s, d).agg(F.count(F.lit(1)).alias("total")),
    "duplicate_status": _duplicates,
    "score_presentation": _shown,
    "score_breakdown": _breakdown,
    "retry_delays": _retries,
    "state_violations": lambda s, d: st.violations(src.inputs(s, d), src.jobs(s, d), src.runs(s, d)),
    "application_dates": lambda s, d: b.applications(s, d).select("o_orderkey", text.day(F.when(F.col("o_orderkey") % 3 == 0, "1998-2-3").when(F.col("o_orderkey") % 5 == 0, "1998-02-30T1").otherwise(F.concat(F.col("applied").cast("string"), F.lit("T10:00Z")))).cast("string").alias("day")),
}

_INPUTS = f"""{APPS}, first AS (SELECT application_key, min(o_orderkey) AS k FROM apps GROUP BY 1),
inputs AS (SELECT k, f.application_key, length(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS description_chars, sha256(text) AS description_hash,
  CASE WHEN k % 23 = 0 THEN 'partial' WHEN k % 41 = 0 THEN 'unavailable' ELSE 'complete' END AS extraction_quality, sha256('resume' || (k % 5)) AS resume_hash,
  sha256(lower(company) || '|' || lower(title)) AS role_key, created AS captured_at, k % 29 <> 0 AS snapshot_valid
  FROM first f JOIN apps ON o_orderkey = k JOIN documents ON doc_id = k % (SELECT count(*) FROM documents) WHERE k % 3 <> 0),
i AS (SELECT *, sha256(application_key || '|' || resume_hash || '|' || description_hash || '|v2|e1|') AS input_fingerprint, sha256(role_key || '|' || resume_hash || '|v2|e1|') AS cache_key FROM inputs),
jobs AS (SELECT k AS id, application_key, input_fingerprint, CASE k % 7 WHEN 0 THEN 'waiting_application' WHEN 1 THEN 'queued' WHEN 5 THEN 'completed' WHEN 6 THEN 'failed' ELSE 'running' END AS status,
  k % 6 AS attempt_count, captured_at AS next_run_at, CASE WHEN k % 7 BETWEEN 2 AND 4 THEN 'w' || (k % 3) END AS lease_owner, CASE WHEN k % 7 BETWEEN 2 AND 4 THEN captured_at + to_seconds(k % 900) END AS lease_until,
  k % 7 = 4 AS publishing, CASE WHEN k % 5 = 0 THEN TIMESTAMP '1998-07-14 23:50:00' ELSE captured_at + to_seconds(k % 1800) END AS updated_at FROM i WHERE k % 4 <> 0),
r0 AS (SELECT l_orderkey AS run_id, a.application_key, CASE WHEN l_orderkey % 11 = 0 THEN 'v1' ELSE 'v2' END AS version, CASE WHEN l_orderkey % 13 = 0 THEN 'e0' ELSE 'e1' END AS model, CASE WHEN l_orderkey % 17 = 0 THEN 'r1' ELSE '' END AS revision
  FROM (SELECT DISTINCT l_orderkey FROM lineitem) JOIN apps a ON o_orderkey = l_orderkey),
runs AS (SELECT r0.*, sha256(r0.application_key || '|' || resume_hash || '|' || description_hash || '|' || version || '|' || model || '|' || revision) AS expected_fingerprint,
  CASE WHEN run_id % 19 = 0 THEN sha256('unknown') ELSE input_fingerprint END AS input_fingerprint FROM r0 LEFT JOIN i ON i.application_key = r0.application_key),
score_pages AS (SELECT application_key FROM r0 WHERE run_id % 7 <> 0 UNION ALL SELECT sha256('orphan' || o_orderkey) FROM orders WHERE o_orderkey % 50 = 0),
pc AS (SELECT application_key, count(*) AS n FROM apps GROUP BY 1), sc AS (SELECT application_key, count(*) AS n FROM score_pages GROUP BY 1),
cache AS (SELECT DISTINCT cache_key FROM i WHERE k % 5 = 0 AND captured_at + INTERVAL 1000 DAY > TIMESTAMP '1998-07-15'),
remote AS (SELECT cache_key, count(*) AS n FROM i WHERE k % 4 = 1 GROUP BY 1),
settled AS (SELECT id, CASE WHEN coalesce(n, 0) = 1 THEN 'recovered' WHEN n > 1 THEN 'ambiguous' WHEN date_diff('microsecond', updated_at, TIMESTAMP '1998-07-15') >= 900000000 THEN 'retried' ELSE 'uncertain' END AS outcome
  FROM jobs LEFT JOIN sc ON sc.application_key = jobs.application_key WHERE status = 'running' AND publishing AND lease_until <= TIMESTAMP '1998-07-15'),
needed AS (SELECT i.application_key, i.input_fingerprint, CASE WHEN NOT (description_chars >= {LEAST} AND extraction_quality IN ('complete', 'partial') AND snapshot_valid) THEN 'unavailable'
  WHEN i.input_fingerprint NOT IN (SELECT input_fingerprint FROM jobs) THEN 'enqueue' ELSE 'nothing' END AS action FROM i JOIN pc ON pc.application_key = i.application_key AND pc.n = 1)"""
_DUE = "((status = 'queued' AND next_run_at <= TIMESTAMP '1998-07-15') OR (status = 'running' AND NOT publishing AND lease_until <= TIMESTAMP '1998-07-15'))"
_LOST = "(status = 'running' AND NOT publishing AND lease_until <= TIMESTAMP '1998-07-15')"


def _size_sql(table: str, name: str, key: str = "application_key") -> str:
    return f"SELECT '{name}' AS name, count(*) AS n_rows, count(DISTINCT {key}) AS n_keys, CAST(coalesce(sum(CAST('0x' || substr({key}, 1, 8) AS BIGINT)), 0) AS BIGINT) AS digits FROM {table}"


_FROM = {"inputs": "i", "jobs": "jobs", "runs": "runs"}
_SHOWN = "CASE WHEN score = floor(score) THEN CAST(CAST(score AS BIGINT) AS VARCHAR) ELSE CAST(score AS VARCHAR) END"
ORACLES = {
    "job_inputs": f"WITH {_INPUTS} SELECT id, jobs.application_key, status, extraction_quality FROM jobs JOIN i ON i.application_key = jobs.application_key",
    "input_keys": f"WITH {_INPUTS} SELECT k, input_fingerprint, cache_key FROM i",
    "preview_keys": """SELECT c_custkey, sha256(lower(CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 3 = 0 THEN 'https://a/' || c_custkey ELSE 'https://b/' || c_custkey END) || '|' ||
        lower(CASE WHEN c_custkey % 5 = 0 THEN 't' WHEN c_custkey % 7 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'job' END) || '|' || lower(CASE WHEN c_custkey % 11 = 0 THEN c_mktsegment ELSE 'preview' END)) AS key FROM customer""",
    "prepared_inputs": f"""WITH {scored_sql("text")}, c AS (SELECT doc_id, CASE WHEN length(body) > 1000 THEN rtrim(left(body, 1000), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE body END AS body,
        CASE WHEN length(body) > 1000 THEN 'partial' WHEN doc_id % 4 = 0 THEN 'unavailable' ELSE 'complete' END AS quality FROM b)
        SELECT quality, count(*) AS n, CAST(max(length(body)) AS INTEGER) AS longest, CAST(sum(length(body)) AS BIGINT) AS chars FROM c GROUP BY 1""",
    "month_bounds": """WITH m AS (SELECT DISTINCT CASE WHEN o_orderkey % 9 = 0 THEN '1998-13' WHEN o_orderkey % 10 = 0 THEN '98-1' ELSE strftime(o_orderdate, '%Y-%m') END AS month FROM orders),
        t AS (SELECT month, CASE WHEN regexp_full_match(month, '\\d{4}-\\d{2}') THEN TRY_CAST(month || '-01' AS DATE) END AS d FROM m) SELECT month, CAST(d AS VARCHAR) AS start, CAST(last_day(d) AS VARCHAR) AS last FROM t""",
    "next_runnable_job": f"""WITH {_INPUTS}, earliest AS (SELECT min({{'next': next_run_at, 'id': id, 'application_key': application_key, 'status': status}}) AS j FROM jobs WHERE {_DUE})
        SELECT j.id AS id, j.application_key AS application_key, j.status AS status FROM earliest WHERE j IS NOT NULL""",
    "eligible_inputs": f"WITH {_INPUTS} SELECT description_chars >= {LEAST} AND extraction_quality IN ('complete', 'partial') AS worker_takes, description_chars >= {LEAST} AND extraction_quality = 'complete' AS service_takes, count(*) AS n FROM i GROUP BY 1, 2",
    "immutable_inputs": f"""WITH {_INPUTS}, u AS (SELECT 'known' AS origin, k AS order_key FROM i UNION ALL SELECT 'new', k FROM first WHERE application_key NOT IN (SELECT application_key FROM i))
        SELECT origin, count(*) AS n, CAST(sum(order_key) AS BIGINT) AS orders FROM u GROUP BY 1""",
    "activate_jobs": f"WITH {_INPUTS} SELECT id, 'queued' AS status FROM jobs JOIN pc ON pc.application_key = jobs.application_key AND n = 1 WHERE status = 'waiting_application'",
    "recover_leases": f"""WITH {_INPUTS} SELECT CASE WHEN {_LOST} THEN 'queued' ELSE jobs.status END AS status, publishing, coalesce({_LOST}, false) AS recovered, count(*) AS n, count(CASE WHEN NOT coalesce({_LOST}, false) THEN lease_owner END) AS owned
        FROM jobs GROUP BY 1, 2, 3""",
    "publication_recovery": f"WITH {_INPUTS} SELECT id, outcome, CASE outcome WHEN 'recovered' THEN 'completed' WHEN 'retried' THEN 'queued' ELSE 'running' END AS status, outcome NOT IN ('recovered', 'retried') AS publishing FROM settled",
    "missing_score_jobs": f"WITH {_INPUTS} SELECT * FROM needed",
    "worker_health": """WITH b AS (SELECT user_id, max(ts) AS t FROM events GROUP BY 1), a AS (SELECT min(date_diff('microsecond', t, (SELECT date_trunc('second', max(ts)) FROM events))) / 1e6 AS age FROM b)
        SELECT (SELECT count(*) FROM b) AS workers, round(age, 3) + 0e0 AS age_seconds, age <= 600 AS healthy FROM a""",
    "rename_applications": f"""WITH {_INPUTS}, m AS (SELECT application_key AS o, sha256('new' || application_key) AS n FROM i WHERE k % 10 = 0), """
    + ", ".join(f"{n}_t AS (SELECT coalesce(m.n, t.application_key) AS application_key FROM {_FROM[n]} t LEFT JOIN m ON m.o = t.application_key)" for n in _TABLES)
    + " "
    + " UNION ALL ".join(_size_sql(f"{n}_t", n) for n in _TABLES),
    "delete_applications": f"WITH {_INPUTS}, g AS (SELECT application_key FROM i WHERE k % 5 = 0) " + " UNION ALL ".join(_size_sql(f"{_FROM[n]} WHERE application_key NOT IN (SELECT application_key FROM g)", n) for n in _TABLES),
    "worker_steps": f"""WITH {_INPUTS} SELECT id, CASE WHEN i.input_fingerprint IS NULL THEN 'missing_input' WHEN NOT (description_chars >= {LEAST} AND extraction_quality IN ('complete', 'partial')) THEN 'low_quality'
        WHEN jobs.input_fingerprint IN (SELECT input_fingerprint FROM runs WHERE input_fingerprint IS NOT NULL AND run_id % 2 = 0) THEN 'stored' WHEN cache_key IN (SELECT cache_key FROM cache) THEN 'cached' ELSE 'compute' END AS step
        FROM jobs LEFT JOIN i ON i.input_fingerprint = jobs.input_fingerprint WHERE {_DUE}""",
    "publication_decisions": f"""WITH {_INPUTS}, j AS (SELECT r.*, coalesce(sc.n, 0) AS scores, CASE WHEN coalesce(pc.n, 0) = 0 THEN 'unknown_application' WHEN pc.n > 1 THEN 'ambiguous_application' WHEN i.application_key IS DISTINCT FROM r.application_key THEN 'unknown_snapshot'
          WHEN expected_fingerprint IS DISTINCT FROM r.input_fingerprint THEN 'metadata_differs' WHEN sc.n > 1 THEN 'ambiguous_score' END AS wrong
          FROM runs r LEFT JOIN pc ON pc.application_key = r.application_key LEFT JOIN sc ON sc.application_key = r.application_key LEFT JOIN i ON i.input_fingerprint = r.input_fingerprint)
        SELECT run_id, coalesce(wrong, CASE WHEN row_number() OVER (PARTITION BY application_key, wrong ORDER BY run_id) > 1 THEN 'stored_locally' WHEN scores = 1 THEN 'updated' ELSE 'created' END) AS decision FROM j""",
    "score_tiers": f"""WITH {_INPUTS} SELECT k AS id, CASE WHEN NOT (description_chars >= {LEAST} AND extraction_quality = 'complete') THEN 'rejected' WHEN k % 10 <> 0 AND i.cache_key IN (SELECT cache_key FROM cache) THEN 'cached'
        WHEN k % 10 <> 0 AND n = 1 THEN 'fetched' WHEN k % 10 <> 0 AND n > 1 THEN 'ambiguous' ELSE 'computed' END AS tier FROM i LEFT JOIN remote ON remote.cache_key = i.cache_key""",
    "metadata_changes": """WITH n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM events), s AS (SELECT * FROM n WHERE next_ts IS NULL OR date_diff('microsecond', ts, next_ts) >= 3600000000),
        b AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM s) SELECT user_id, event_id, event_type AS payload FROM b WHERE before IS NULL OR before <> event_type""",
    "reconcile_report": f"""WITH {_INPUTS} SELECT (SELECT count(*) FROM jobs JOIN pc ON pc.application_key = jobs.application_key AND n = 1 WHERE status = 'waiting_application') AS activated,
        (SELECT count(*) FROM needed WHERE action = 'enqueue') AS requeued, (SELECT count(*) FROM needed WHERE action = 'unavailable') AS unavailable_inputs, (SELECT count(*) FROM jobs WHERE {_LOST}) AS recovered_leases,
        (SELECT count(*) FROM settled WHERE outcome = 'recovered') AS recovered_publications, (SELECT count(*) FROM settled WHERE outcome = 'retried') AS retried_publications, (SELECT count(*) FROM settled WHERE outcome = 'uncertain') AS uncertain_publications,
        (SELECT count(*) FROM pc WHERE n > 1) AS duplicate_application_keys, (SELECT count(*) FROM sc WHERE n > 1) AS duplicate_score_keys, (SELECT count(*) FROM sc WHERE application_key NOT IN (SELECT application_key FROM pc)) AS orphan_score_keys,
        (SELECT count(*) FROM pc WHERE application_key NOT IN (SELECT application_key FROM i)) AS missing_local_inputs, (SELECT count(*) FROM runs WHERE version <> 'v2' OR model <> 'e1' OR revision <> '') AS stale_score_runs""",
    "application_updates": """WITH e AS (SELECT concat_ws('|', CASE WHEN k % 19 = 0 THEN 'unknown fields: salary' END, CASE WHEN k % 7 = 0 THEN 'company is required' END, CASE WHEN k % 5 = 0 THEN 'job_url is required' END, CASE WHEN k % 11 = 0 THEN 'application_date must be YYYY-MM-DD' END,
        CASE WHEN k % 13 = 0 THEN 'status is unknown' END, CASE WHEN k % 17 = 0 THEN 'referral must be a boolean' END) AS errors FROM (SELECT o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey)) SELECT errors, count(*) AS n FROM e GROUP BY 1""",
    "application_total": f"WITH {APPS} SELECT count(*) AS total FROM apps",
    "duplicate_status": f"""WITH {APPS}, l AS (SELECT application_key, arg_max(status, (created, o_orderkey)) AS status FROM apps GROUP BY 1), q AS (SELECT c_custkey, sha256(lower(c_name) || '|1-urgent|' || lower(c_mktsegment)) AS key FROM customer)
        SELECT c_custkey, CASE WHEN status IS NULL THEN 'Not applied yet' WHEN status = 'Rejected' THEN 'Rejected' ELSE 'Already applied' END AS text, CASE WHEN status IS NULL THEN 'clear' WHEN status = 'Rejected' THEN 'rejected' ELSE 'exists' END AS class
        FROM q LEFT JOIN l ON application_key = key""",
    "score_presentation": f"""WITH r AS (SELECT l_orderkey AS run_id, round(2 * avg(l_quantity), 1) AS score FROM lineitem GROUP BY 1),
        t AS (SELECT run_id, score, CASE WHEN run_id % 6 = 0 THEN 'Good Fit' WHEN run_id % 3 = 0 THEN 'No Fit' WHEN score >= 75 THEN 'High' WHEN score >= 55 THEN 'Moderate' ELSE 'Low' END AS label FROM r)
        SELECT run_id, {_SHOWN} || '/100 (' || label || ')' AS text, CASE label WHEN 'Good Fit' THEN 'score-high' WHEN 'High' THEN 'score-high' WHEN 'Moderate' THEN 'score-moderate' ELSE 'score-low' END AS class FROM t""",
    "score_breakdown": """WITH r AS (SELECT l_orderkey AS run_id, 2 * avg(l_quantity) AS score FROM lineitem GROUP BY 1),
        v AS (SELECT run_id, 'Bonus' AS label, run_id % 100 + 0.25e0 AS x FROM r UNION ALL SELECT run_id, 'Core', score FROM r UNION ALL SELECT run_id, 'Required', (run_id % 1000) / 10.0e0 FROM r WHERE run_id % 3 <> 0),
        t AS (SELECT label, floor(x * 10 + 0.5) / 10 AS value FROM v) SELECT label, CASE WHEN value >= 75 THEN 'score-high' WHEN value >= 55 THEN 'score-moderate' ELSE 'score-low' END AS class, count(*) AS n FROM t GROUP BY 1, 2""",
    "state_violations": f"""WITH {_INPUTS}, sr AS (SELECT runs.*, (SELECT 2 * avg(l_quantity) FROM lineitem WHERE l_orderkey = run_id) AS score FROM runs)
        SELECT 'inputs_key_unique' AS rule, count(*) - count(DISTINCT application_key) AS n FROM i UNION ALL SELECT 'inputs_quality_known', count(*) FILTER (WHERE extraction_quality NOT IN ('complete', 'partial', 'unavailable')) FROM i
        UNION ALL SELECT 'jobs_fingerprint_unique', count(*) - count(DISTINCT input_fingerprint) FROM jobs UNION ALL SELECT 'jobs_status_known', count(*) FILTER (WHERE status NOT IN ('waiting_application', 'queued', 'running', 'completed', 'failed', 'cancelled')) FROM jobs
        UNION ALL SELECT 'jobs_input_known', count(*) FROM jobs WHERE application_key NOT IN (SELECT application_key FROM i) UNION ALL SELECT 'jobs_lease_only_if_running', count(*) FILTER (WHERE (status = 'running') <> (lease_until IS NOT NULL)) FROM jobs
        UNION ALL SELECT 'runs_fingerprint_unique', count(input_fingerprint) - count(DISTINCT input_fingerprint) FROM runs UNION ALL SELECT 'runs_score_in_range', count(*) FILTER (WHERE NOT score BETWEEN 0 AND 100) FROM sr
        UNION ALL SELECT 'runs_input_known', count(*) FROM runs WHERE application_key NOT IN (SELECT application_key FROM i)""",
    "application_dates": f"WITH {APPS} SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN CAST(applied AS VARCHAR) END AS day FROM apps",
    "retry_delays": f"WITH {_INPUTS} SELECT id, 5e0 * power(2e0, greatest(0, attempt_count - 1)) AS delay FROM jobs",
}
