"""Keyed state of the scoring service as tables: inserts, leases, recovery, publication, cache tiers and reconciliation.

Every operator takes the time as a parameter. What a statement would do to rows one after another is done to all rows at
once, so conflicts are settled by keys and not by the order of rows.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds that a publication without a trace stays uncertain before it is tried again.
UNCERTAIN_S = 900
#: Columns of the service's tables.
SCHEMAS = {
    "scoring_inputs": "application_key string, canonical_url string, source_job_id string, job_description string, job_description_hash string, description_provenance string, captured_at timestamp, extraction_quality string, resume_version string, resume_path string, resume_content_hash string, role_company_key string",
    "score_runs": "id long, application_key string, input_fingerprint string, score double, band string, matched_terms array<string>, category_breakdown map<string,double>, scorer_version string, embedding_model string, deployment_revision string, fit_label string, fit_probability double, decision_threshold double, is_application_time boolean",
    "score_jobs": "id long, application_key string, idempotency_key string, input_fingerprint string, status string, attempt_count long, next_run_at timestamp, lease_owner string, lease_until timestamp, publishing boolean, last_error string, updated_at timestamp",
    "score_cache": "cache_key string, result_json string, expires_at timestamp",
    "worker_heartbeats": "worker_id string, updated_at timestamp",
}
JOB_STATES = ("waiting_application", "queued", "running", "completed", "failed", "cancelled")
QUALITIES = ("complete", "partial", "unavailable")
#: Qualities of a description that a worker takes.
SCORABLE = ("complete", "partial")


def migrated(rows: DataFrame, table: str, **defaults: object) -> DataFrame:
    """Rows in the columns of a table of SCHEMAS: absent ones are added with a default or null, others dropped."""
    fields = T.StructType.fromDDL(SCHEMAS[table]).fields
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in fields))


def violations(inputs: DataFrame, jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """(rule, n): how many rows break each rule that a database would enforce."""
    repeated = lambda rows, key: rows.groupBy(key).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n"))
    count = lambda rows, wrong: rows.agg(F.count_if(F.coalesce(wrong, F.lit(True))).alias("n"))
    found = {
        "inputs_key_unique": repeated(inputs, "application_key"),
        "inputs_quality_known": count(inputs, ~F.col("extraction_quality").isin(*QUALITIES)),
        "jobs_fingerprint_unique": repeated(jobs, "input_fingerprint"),
        "jobs_status_known": count(jobs, ~F.col("status").isin(*JOB_STATES)),
        "jobs_input_known": jobs.join(inputs, "application_key", "left_anti").agg(F.count(F.lit(1)).alias("n")),
        "jobs_lease_only_if_running": count(jobs, (F.col("status") == "running") != F.col("lease_until").isNotNull()),
        "runs_fingerprint_unique": repeated(runs.where("input_fingerprint IS NOT NULL"), "input_fingerprint"),
        "runs_score_in_range": count(runs, ~F.col("score").between(0, 100)),
        "runs_input_known": runs.join(inputs, "application_key", "left_anti").agg(F.count(F.lit(1)).alias("n")),
    }
    out = None
    for rule, rows in found.items():
        part = rows.select(F.lit(rule).alias("rule"), F.col("n").cast("long").alias("n"))
        out = part if out is None else out.union(part)
    return out


def moment(at: datetime.datetime) -> Column:
    return F.lit(at.isoformat(sep=" ")).cast("timestamp")


def seconds_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def key_counts(rows: DataFrame, key: str = "application_key") -> DataFrame:
    """(key, n) of non-empty keys."""
    return rows.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def insert_new(existing: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """`existing` and those of `rows` whose key it hasn't; of rows that share a key the first in the order, and what is there stays as it is."""
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("row")).select("row.*")
    return existing.unionByName(first.join(existing.select(key), key, "left_anti").select(existing.columns))


def usable_input(description_chars: Column, quality: Column, least: int = 1, qualities: tuple[str, ...] = SCORABLE) -> Column:
    """Whether an input may be scored; null counts as no."""
    return F.coalesce((description_chars >= least) & quality.isin(*qualities), F.lit(False))


def runnable(at: datetime.datetime) -> Column:
    """Queued and due, or running with a lease that has ended and nothing being published."""
    now = moment(at)
    return ((F.col("status") == "queued") & (F.col("next_run_at") <= now)) | ((F.col("status") == "running") & ~F.col("publishing") & (F.col("lease_until") <= now))


def next_runnable(jobs: DataFrame, at: datetime.datetime, limit: int = 1) -> DataFrame:
    """The jobs that workers would claim next."""
    return jobs.where(runnable(at)).orderBy("next_run_at", "id").limit(limit)


def with_inputs(jobs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Jobs with the input that their application has; jobs without one are left out."""
    return jobs.join(inputs.drop("k"), "application_key")


def activated(jobs: DataFrame, pages: DataFrame, at: datetime.datetime) -> DataFrame:
    """Jobs that wait for their application are queued if it has exactly one page; `activated` says which."""
    hit = F.coalesce((F.col("status") == "waiting_application") & (F.col("n") == 1), F.lit(False))
    found = jobs.join(key_counts(pages), "application_key", "left").withColumn("activated", hit).drop("n")
    return found.withColumns({"status": F.when(F.col("activated"), "queued").otherwise(F.col("status")), "next_run_at": F.when(F.col("activated"), moment(at)).otherwise(F.col("next_run_at"))})


def leases_recovered(jobs: DataFrame, at: datetime.datetime) -> DataFrame:
    """Running jobs whose lease has ended before publication are queued again; `recovered` says which."""
    now = moment(at)
    hit = F.coalesce((F.col("status") == "running") & ~F.col("publishing") & (F.col("lease_until") <= now), F.lit(False))
    found = jobs.withColumn("recovered", hit)
    back = F.col("recovered")
    return found.withColumns(
        {
            "status": F.when(back, "queued").otherwise(F.col("status")),
            "next_run_at": F.when(back, now).otherwise(F.col("next_run_at")),
            "lease_owner": F.when(~back, F.col("lease_owner")),
            "lease_until": F.when(~back, F.col("lease_until")),
        }
    )


def publications_settled(jobs: DataFrame, score_pages: DataFrame, at: datetime.datetime, uncertain_s: int = UNCERTAIN_S) -> DataFrame:
    """Publications whose lease has ended, by whether their score has a page.

    `outcome` is recovered (one page: completed), retried (none, and nothing happened for `uncertain_s`: queued again),
    uncertain (none, but too early), ambiguous (several pages: left alone), or null for other jobs.
    """
    now = moment(at)
    expired = (F.col("status") == "running") & F.col("publishing") & (F.col("lease_until") <= now)
    n = F.coalesce("n", F.lit(0))
    old = seconds_between(F.col("updated_at"), now) >= uncertain_s
    outcome = F.when(expired, F.when(n == 1, "recovered").when(n > 1, "ambiguous").when(old, "retried").otherwise("uncertain"))
    found = jobs.join(key_counts(score_pages), "application_key", "left").withColumn("outcome", outcome).drop("n")
    done = F.coalesce(F.col("outcome").isin("recovered", "retried"), F.lit(False))
    return found.withColumns(
        {
            "status": F.when(F.col("outcome") == "recovered", "completed").when(F.col("outcome") == "retried", "queued").otherwise(F.col("status")),
            "next_run_at": F.when(F.col("outcome") == "retried", now).otherwise(F.col("next_run_at")),
            "publishing": F.col("publishing") & ~done,
            "lease_owner": F.when(~done, F.col("lease_owner")),
            "lease_until": F.when(~done, F.col("lease_until")),
        }
    )


def missing_jobs(inputs: DataFrame, jobs: DataFrame, pages: DataFrame, least: int = 1) -> DataFrame:
    """Inputs (with input_fingerprint, description_chars, extraction_quality, snapshot_valid) of applications with one page, with an action.

    `action` is unavailable (the input can't be scored or its resume has changed), enqueue (no job has its fingerprint)
    or nothing. A fingerprint is one row.
    """
    ok = usable_input(F.col("description_chars"), F.col("extraction_quality"), least) & F.coalesce("snapshot_valid", F.lit(False))
    named = inputs.join(key_counts(pages).where("n = 1"), "application_key", "left_semi").dropDuplicates(["input_fingerprint"])
    known = jobs.select("input_fingerprint").distinct().withColumn("known", F.lit(True))
    action = F.when(~ok, "unavailable").when(F.col("known").isNull(), "enqueue").otherwise("nothing")
    return named.join(known, "input_fingerprint", "left").select("application_key", "input_fingerprint", action.alias("action"))


def heartbeats(events: DataFrame, worker: str, at: str) -> DataFrame:
    """(worker_id, updated_at): the last sign of each worker."""
    return events.groupBy(F.col(worker).alias("worker_id")).agg(F.max(at).alias("updated_at"))


def health(beats: DataFrame, at: datetime.datetime, most_s: int = 600) -> DataFrame:
    """One row: the age of the youngest sign, and whether that is young enough; one lively worker suffices, none is unhealthy."""
    age = F.min(seconds_between(F.col("updated_at"), moment(at)))
    return beats.agg(F.count(F.lit(1)).alias("workers"), age.alias("age_seconds"), F.coalesce(age <= most_s, F.lit(False)).alias("healthy"))


def renamed(tables: dict[str, DataFrame], renames: DataFrame, owner: str = "inputs", key: str = "application_key") -> dict[str, DataFrame]:
    """Tables after applications get new keys (old_key, new_key) in all of them.

    A rename is done only if `owner` has the old key and not the new one. Of several to one new key, or from one old key,
    the first in order is done.
    """
    once = renames.where("old_key <> new_key").groupBy("new_key").agg(F.min("old_key").alias("old_key")).groupBy("old_key").agg(F.min("new_key").alias("new_key"))
    have = tables[owner].select(key).distinct()
    valid = once.join(have.withColumnRenamed(key, "old_key"), "old_key", "left_semi").join(have.withColumnRenamed(key, "new_key"), "new_key", "left_anti")
    moves = valid.select(F.col("old_key").alias(key), "new_key")
    return {name: t.join(moves, key, "left").withColumn(key, F.coalesce("new_key", key)).select(t.columns) for name, t in tables.items()}


def deleted(tables: dict[str, DataFrame], keys: DataFrame, key: str = "application_key") -> dict[str, DataFrame]:
    """Tables without the rows of deleted applications: what depends on an input goes with it."""
    return {name: t.join(keys.select(key), key, "left_anti").select(t.columns) for name, t in tables.items()}


def live(cache: DataFrame, at: datetime.datetime) -> DataFrame:
    """(cache_key) of unexpired entries."""
    return cache.where(F.col("expires_at") > moment(at)).select("cache_key").distinct()


def worker_steps(jobs: DataFrame, snapshots: DataFrame, runs: DataFrame, cache: DataFrame, at: datetime.datetime, least: int = 1) -> DataFrame:
    """(id, step) of runnable jobs: where a worker takes the result from, or why the job fails.

    missing_input, low_quality, stored (a run has the fingerprint), cached (an unexpired entry has the cache key) or compute.
    """
    own = snapshots.select("input_fingerprint", "cache_key", "description_chars", "extraction_quality", F.lit(True).alias("found"))
    stored = runs.select("input_fingerprint").distinct().withColumn("stored", F.lit(True))
    hit = live(cache, at).withColumn("hit", F.lit(True))
    joined = jobs.where(runnable(at)).select("id", "input_fingerprint").join(own, "input_fingerprint", "left").join(stored, "input_fingerprint", "left").join(hit, "cache_key", "left")
    ok = usable_input(F.col("description_chars"), F.col("extraction_quality"), least)
    return joined.select("id", F.when(F.col("found").isNull(), "missing_input").when(~ok, "low_quality").when(F.col("stored"), "stored").when(F.col("hit"), "cached").otherwise("compute").alias("step"))


def publication_decisions(results: DataFrame, snapshots: DataFrame, pages: DataFrame, score_pages: DataFrame) -> DataFrame:
    """(run_id, decision) of score results (run_id, application_key, input_fingerprint, expected_fingerprint).

    The first rule that rejects a result is its decision. Of the results of an application that pass, the first is
    created, or updated if its score has a page already, and the others are stored locally.
    """
    known = snapshots.select("input_fingerprint", F.col("application_key").alias("snapshot_key"))
    counted = results.join(key_counts(pages).withColumnRenamed("n", "pages"), "application_key", "left").join(key_counts(score_pages).withColumnRenamed("n", "scores"), "application_key", "left").join(known, "input_fingerprint", "left")
    pages_n, scores_n = F.coalesce("pages", F.lit(0)), F.coalesce("scores", F.lit(0))
    wrong = (
        F.when(pages_n == 0, "unknown_application")
        .when(pages_n > 1, "ambiguous_application")
        .when(~F.col("snapshot_key").eqNullSafe(F.col("application_key")), "unknown_snapshot")
        .when(~F.col("expected_fingerprint").eqNullSafe(F.col("input_fingerprint")), "metadata_differs")
        .when(scores_n > 1, "ambiguous_score")
    )
    judged = counted.select("run_id", "application_key", wrong.alias("wrong"), scores_n.alias("scores"))
    first = judged.where("wrong IS NULL").groupBy("application_key").agg(F.min("run_id").alias("first_run"))
    passed = F.when(F.col("run_id") != F.col("first_run"), "stored_locally").when(F.col("scores") == 1, "updated").otherwise("created")
    return judged.join(first, "application_key", "left").select("run_id", F.coalesce("wrong", passed).alias("decision"))


def score_tiers(requests: DataFrame, cache: DataFrame, remote: DataFrame, at: datetime.datetime, least: int = 200) -> DataFrame:
    """(id, tier) of requests (id, cache_key, description_chars, extraction_quality, force): where a score comes from.

    rejected without a whole description; cached, fetched from the remote table, or computed; `force` skips both. A key
    that the remote table has more than once is ambiguous.
    """
    ok = F.coalesce(F.col("description_chars") >= least, F.lit(False)) & F.coalesce("extraction_quality", F.lit("")).isin("", "complete")
    joined = requests.join(live(cache, at).withColumn("hit", F.lit(True)), "cache_key", "left").join(key_counts(remote, "cache_key"), "cache_key", "left")
    again = F.coalesce("force", F.lit(False))
    return joined.select("id", F.when(~ok, "rejected").when(~again & F.col("hit"), "cached").when(~again & (F.col("n") == 1), "fetched").when(~again & (F.col("n") > 1), "ambiguous").otherwise("computed").alias("tier"))


def changes(events: DataFrame, key: str, at: str, tie: str, payload: Column, quiet_s: float) -> DataFrame:
    """The events that tell of a change: those that no other of the key follows within `quiet_s`, and whose payload isn't that of the last told one."""
    order = Window.partitionBy(key).orderBy(at, tie)
    settled = events.withColumns({"payload": payload, "next_at": F.lead(at).over(order)}).where(F.col("next_at").isNull() | (seconds_between(F.col(at), F.col("next_at")) >= quiet_s))
    before = settled.withColumn("before", F.lag("payload").over(order))
    return before.where(~F.col("payload").eqNullSafe(F.col("before"))).drop("next_at", "before")


def stale(runs: DataFrame, version: str, model: str, revision: str) -> Column:
    """Whether a run was made by another scorer than the given one."""
    same = (F.col("version") == version) & (F.col("model") == model) & (F.coalesce("revision", F.lit("")) == revision)
    return ~F.coalesce(same, F.lit(False))


#: What a table adds to the row of its keys.
FLAGS = ("page", "score", "local", "usable", "unusable", "job", "waiting", "lease", "old_publication", "new_publication", "stale_run")


def _keyed(rows: DataFrame, fingerprint: str | None = None, **flags: Column) -> DataFrame:
    """Rows as (application_key, fingerprint, flags); those that aren't named are 0. An empty key is none."""
    own = F.col("application_key") if "application_key" in rows.columns else F.lit(None).cast("string")
    at = [F.nullif(own, F.lit("")).alias("application_key"), (F.col(fingerprint) if fingerprint else F.lit(None).cast("string")).alias("fingerprint")]
    return rows.select(*at, *((F.coalesce(flags[f].cast("long"), F.lit(0)) if f in flags else F.lit(0).cast("long")).alias(f) for f in FLAGS))


def reconciliation(jobs: DataFrame, inputs: DataFrame, snapshots: DataFrame, pages: DataFrame, score_pages: DataFrame, runs: DataFrame, at: datetime.datetime, version: str, model: str, revision: str = "", least: int = 1) -> DataFrame:
    """One row of twelve counters: what a reconciliation does to jobs, and what it finds in the keys of all tables.

    Each table gives rows of flags, once; these are summed by application and fingerprint, then by application, and all
    counters are read from that. A fingerprint names one application, as its key goes into it; it is usable if any snapshot of it is. Sums
    combine on the map side, so an application with very many rows isn't hot.
    """
    now = moment(at)
    running = F.col("status") == "running"
    expired = running & (F.col("lease_until") <= now)
    old = seconds_between(F.col("updated_at"), now) >= UNCERTAIN_S
    usable = usable_input(F.col("description_chars"), F.col("extraction_quality"), least) & F.coalesce("snapshot_valid", F.lit(False))
    one = F.lit(1)
    job = _keyed(
        jobs, "input_fingerprint", job=one, waiting=F.col("status") == "waiting_application", lease=expired & ~F.col("publishing"), old_publication=expired & F.col("publishing") & old, new_publication=expired & F.col("publishing") & ~F.coalesce(old, F.lit(False))
    )
    rest = [
        _keyed(pages, page=one),
        _keyed(score_pages, score=one),
        _keyed(inputs, local=one),
        _keyed(snapshots, "input_fingerprint", usable=usable, unusable=~usable),
        _keyed(runs.select("version", "model", "revision"), stale_run=stale(runs, version, model, revision)),
    ]
    for part in rest:
        job = job.unionAll(part)
    prints = job.groupBy("application_key", "fingerprint").agg(*(F.sum(f).alias(f) for f in FLAGS))
    asked = F.col("fingerprint").isNotNull() & (F.col("usable") + F.col("unusable") > 0)
    judged = prints.withColumns({"enqueue": (asked & (F.col("usable") > 0) & (F.col("job") == 0)).cast("long"), "unavailable": (asked & (F.col("usable") == 0)).cast("long")})
    named = F.col("application_key").isNotNull()
    keys = judged.groupBy("application_key").agg(*(F.sum(f).alias(f) for f in (*FLAGS, "enqueue", "unavailable")))
    keys = keys.withColumns({f: F.when(named, F.col(f)).otherwise(0) for f in ("page", "score", "local")})
    total = lambda c, when=F.lit(True): F.coalesce(F.sum(F.when(when, c)), F.lit(0))
    one_page, no_score = F.col("page") == 1, F.col("score") == 0
    publications = F.col("old_publication") + F.col("new_publication")
    return keys.agg(
        total(F.col("waiting"), one_page).alias("activated"),
        total(F.col("enqueue"), one_page).alias("requeued"),
        total(F.col("unavailable"), one_page).alias("unavailable_inputs"),
        total(F.col("lease")).alias("recovered_leases"),
        total(publications, F.col("score") == 1).alias("recovered_publications"),
        total(F.col("old_publication"), no_score).alias("retried_publications"),
        total(F.col("new_publication"), no_score).alias("uncertain_publications"),
        F.count_if(F.col("page") > 1).alias("duplicate_application_keys"),
        F.count_if(F.col("score") > 1).alias("duplicate_score_keys"),
        F.count_if((F.col("score") > 0) & (F.col("page") == 0)).alias("orphan_score_keys"),
        F.count_if((F.col("page") > 0) & (F.col("local") == 0)).alias("missing_local_inputs"),
        total(F.col("stale_run")).alias("stale_score_runs"),
    )
