"""Queries on postings, applications and operational state, with their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import postings, text
from matchloom.operators import applications as ap
from matchloom.operators.model import Scorer
from matchloom.plans.corpus import squeezed
from matchloom.plans.features import rounded
from matchloom.sources import bindings as b
from matchloom.sources import paged
from matchloom.storage import fresh_path, written
from matchloom.streaming import jobs, worker

AS_OF = datetime.date(1998, 7, 15)
#: A time of day, so that elapsed days differ from calendar days.
AS_OF_TIME = datetime.datetime(1998, 7, 15, 9, 30)


def _signal(s: SparkSession, d: str) -> DataFrame:
    probe = F.concat("text", F.lit(" "), F.element_at(F.array(*(F.lit(x) for x in PROBES)), (F.col("doc_id") % len(PROBES) + 1).cast("int")))
    message, kind = postings.sponsorship(probe)
    return b.table(s, d, "documents").select("doc_id", message.alias("message"), kind.alias("kind"))


#: Sentences put after documents, so that each rule is met.
PROBES = ("We will not sponsor visas.", "Visa sponsorship is available.", "U.S. citizens or permanent residents only", "US citizenship needed", "a green card helps", "U.S. persons", "plain words")


def _runs(s: SparkSession, d: str) -> DataFrame:
    runs = b.score_runs(s, d).join(b.applications(s, d).select(F.col("o_orderkey").alias("run_id"), "application_key"), "run_id")
    return runs.withColumn("version", F.when(F.col("run_id") % 11 == 0, "v1").otherwise("v2"))


def _backfill(s: SparkSession, d: str) -> DataFrame:
    a = b.applications(s, d)
    k, docs = F.col("o_orderkey"), b.table(s, d, "documents")
    rows = a.withColumn("doc_id", k % docs.count()).join(docs.select("doc_id", "text"), "doc_id").select(
        F.when(k % 37 != 0, F.col("application_key")).alias("application_key"),
        F.when(k % 31 != 0, F.col("text")).alias("description"),
        F.when(k % 29 == 0, "elsewhere").otherwise("original_saved").alias("provenance"),
        F.when(k % 23 == 0, "partial").otherwise("complete").alias("quality"),
        F.when(k % 19 != 0, F.col("created")).alias("captured"),
        F.when(k % 17 == 0, 0).when(k % 13 == 0, 2).otherwise(1).alias("resume_matches"),
        F.when(k % 11 != 0, F.when(k % 7 == 0, "old").otherwise("new")).alias("historical_hash"),
        F.lit("new").alias("resume_hash"),
        F.when(k % 5 == 0, F.sha2(F.lit("other"), 256)).alias("existing_description_hash"),
    )
    return ap.backfill(rows, AS_OF_TIME).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _cache(s: SparkSession, d: str) -> DataFrame:
    """Cached values of each key that are unexpired at a fixed time, the latest write of each."""
    events = b.table(s, d, "events").select("user_id", "event_id", "value", "ts", (F.col("ts").cast("timestamp") + F.expr("INTERVAL 300 SECONDS")).alias("expires_at"))
    last = ap.latest(events.where("ts <= TIMESTAMP '2024-01-15 12:00:00'"), "user_id", "ts", "event_id")
    return last.where("expires_at > TIMESTAMP '2024-01-15 11:00:00'").select("user_id", "event_id", "value")


#: Addresses at the known sites that eight of nine pages are given instead of their own; % stands for the page's id.
URLS = (
    "https://www.linkedin.com/jobs/view/engineer-at-x-%?ref=1",
    "https://de.linkedin.com/jobs/search/?a=b&currentJobId=%#top",
    "https://boards.greenhouse.io/acme/jobs/%?gh_src=1",
    "https://jobs.lever.co/acme/%/",
    "https://www.indeed.com/viewjob?jk=%&from=x",
    "https://indeed.com/jobs?vjk=%",
    "https://acme.wd1.myworkdayjobs.com/en-US/careers/job/x/Engineer_R%",
    "https://jobs.lever.co",
)
_URLS_SQL = " ".join(f"WHEN {i} THEN '{u}'".replace("%", "' || page_id || '") for i, u in enumerate(URLS))


#: Days and status that are asked of the store.
ASKED = (datetime.date(1997, 1, 1), datetime.date(1997, 6, 30), "Rejected")


def _pushed(s: SparkSession, d: str) -> DataFrame:
    """Applications of some days with one status, by a source that is asked for these only, counted by month.

    All applications are first written as pages; the answer is written while filters are pushed.
    """
    day = F.col("applied").cast("string")
    page = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("edited"), day.alias("application_date"), "status"))
    path = fresh_path(s, "pages")
    b.applications(s, d).select(F.col("o_orderkey").cast("string").alias("id"), F.col("applied").alias("application_date"), "status", F.col("o_orderkey").alias("edited"), page.alias("json")).write.parquet(path)
    s.dataSource.register(paged.PagedSource)
    key = "spark.sql.python.filterPushdown.enabled"
    before = s.conf.get(key, "false")
    s.conf.set(key, "true")
    try:
        rows = s.read.format("paged").option("client", "matchloom.sources.paged:TableClient").option("folder", path).load()
        asked = rows.where(F.col("application_date").between(F.lit(ASKED[0]), F.lit(ASKED[1])) & (F.col("status") == ASKED[2]))
        return written(asked.groupBy(F.date_format("application_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("id").cast("long")).alias("orders")), "pushed-pages")
    finally:
        s.conf.set(key, before)


def _requests(s: SparkSession, d: str) -> DataFrame:
    """Each event as a request for a score, of vectors that are there."""
    e = b.table(s, d, "events")
    vectors = b.vectors(s, d).select(F.col("vec_id").alias("of"), F.slice("vec", 1, 2).alias("vec"))
    rows = e.withColumn("of", F.col("event_id") % b.table(s, d, "embeddings").count()).join(vectors, "of")
    chars = F.when(F.col("event_id") % 7 == 0, 100).otherwise(300)
    return rows.select(F.col("event_id").alias("id"), F.concat(F.lit("k"), (F.col("user_id") % 40).cast("string")).alias("cache_key"), "ts", chars.alias("description_chars"), F.when(F.col("event_id") % 11 == 0, "unavailable").otherwise("partial").alias("extraction_quality"), "vec")


#: Seconds that a score stays in the cache, and a scorer of two features.
TTL_S = 7200
SCORER = Scorer((0.0, 0.1), (1.0, 2.0), ((0.1, 0.2), (0.5, -0.3)), (0.0, 0.1), 1.5, 0.2, 0.5)


def _addresses(s: SparkSession, d: str) -> DataFrame:
    at = F.col("url")
    for i, u in enumerate(URLS):
        at = F.when(F.col("page_id") % 9 == i, F.replace(F.lit(u), F.lit("%"), F.col("page_id").cast("string"))).otherwise(at)
    return b.table(s, d, "pages").withColumn("url", at)


QUERIES = {
    "worker_answers": lambda s, d: rounded(worker.answers(_requests(s, d), SCORER, TTL_S, 200).select("id", "step", "score", "made_by"), "score"),
    "pushed_applications": _pushed,
    "posting_identity": lambda s, d: _addresses(s, d).select("page_id", postings.canonical_url(F.col("url")).alias("canonical_url"), F.coalesce(postings.site(F.col("url")), F.lit("")).alias("site"), postings.job_id(F.col("url")).alias("job_id")),
    "posting_extract": lambda s, d: postings.posting(b.table(s, d, "pages").select("page_id", "url", "html")).drop("url", "html"),
    "sponsorship_signal": _signal,
    "scoring_description": lambda s, d: b.table(s, d, "documents").select("doc_id", text.scored_part(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\r\n\n  Pay   Range: 10\nrest"))).otherwise(F.col("text"))).alias("t")).select("doc_id", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("sha")),
    "application_keys": lambda s, d: b.applications(s, d).select("o_orderkey", "application_key"),
    "role_company_keys": lambda s, d: b.table(s, d, "documents").select("doc_id", text.role_company_key(F.col("text"), F.col("source")).alias("role_company_key")),
    "score_bands": lambda s, d: b.score_runs(s, d).groupBy(text.band(F.col("score")).alias("band")).agg(F.count(F.lit(1)).alias("n")),
    "dashboard_counts": lambda s, d: ap.dashboard(b.applications(s, d), AS_OF),
    "monthly_status_summary": lambda s, d: ap.monthly(b.applications(s, d), datetime.date(1998, 7, 1), AS_OF),
    "application_search": lambda s, d: ap.search(b.applications(s, d), "1-urgent BUILD"),
    "application_search_status": lambda s, d: ap.search(b.applications(s, d), "machinery", "Rejected"),
    "application_insights": lambda s, d: rounded(ap.insights(b.applications(s, d), _runs(s, d)), "score"),
    "backfill_reasons": _backfill,
    "application_time_runs": lambda s, d: ap.first_runs(_runs(s, d)).select("run_id", "application_key", "is_first"),
    "score_cache_lookup": _cache,
    "latency_percentiles": lambda s, d: rounded(b.table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.95).alias("p95"), F.floor(F.lit(300.0) / F.median("value")).alias("capacity")), "p50", "p95"),
    "job_queue_replay": lambda s, d: jobs.replay(jobs.job_events(b.table(s, d, "events"))),
}

APPS = f"""apps AS (SELECT o_orderkey, c_name AS company, o_orderpriority AS title, c_mktsegment AS source, CAST(o_orderdate AS DATE) AS applied, CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400) AS created,
    CASE o_orderstatus WHEN 'F' THEN 'Rejected' WHEN 'O' THEN 'Applied' ELSE 'In Progress' END AS status,
    sha256({squeezed("lower(c_name)")} || '|' || {squeezed("lower(o_orderpriority)")} || '|' || {squeezed("lower(c_mktsegment)")}) AS application_key FROM orders JOIN customer ON o_custkey = c_custkey)"""
RUNS = f"{APPS}, runs AS (SELECT l_orderkey AS run_id, application_key, 2 * avg(l_quantity) AS score, CASE WHEN l_orderkey % 11 = 0 THEN 'v1' ELSE 'v2' END AS version FROM lineitem JOIN apps ON o_orderkey = l_orderkey GROUP BY 1, 2)"
_BAND = "CASE WHEN score >= 75 THEN 'Strong' WHEN score >= 55 THEN 'Moderate' ELSE 'Weak' END"
_PROBE = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PROBES)) + " END"
_RULES = lambda at: " ".join(f"WHEN regexp_matches(t, '(?i){r[0]}') THEN '{r[at]}'" for r in postings.SPONSORSHIP)
_HOST = "coalesce(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '')"

def scored_sql(col: str) -> str:
    """The scored part of a description, as b (doc_id, body)."""
    return f"""t AS (SELECT doc_id, replace(replace({col}, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents),
        l AS (SELECT doc_id, list_transform(string_split(t, chr(10)), lambda x: {squeezed("x")}) AS lines FROM t),
        s AS (SELECT doc_id, string_split(trim(regexp_replace(array_to_string(lines, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)), chr(10)) AS lines FROM l),
        k AS (SELECT doc_id, lines, list_position(list_transform(lines, lambda x: regexp_matches(trim(regexp_replace(regexp_replace(lower(x), '[^a-z0-9&/ ]+', '', 'g'), ' +', ' ', 'g')), '^({"|".join(text.EXCLUDED_HEADINGS)})( |$)')), true) AS cut FROM s),
        b AS (SELECT doc_id, trim(array_to_string(CASE WHEN cut > 0 THEN lines[1:cut - 1] ELSE lines END, chr(10)), chr(10)) AS body FROM k)"""


def _plain(col: str) -> str:
    """Character references that pages have, read."""
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&middot;", "·"), ("&copy;", "©"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        col = f"replace({col}, '{name}', '{value}')"
    return col


def _folded(col: str) -> str:
    """Case-folded and squeezed; of the letters at hand only the sharp s folds to more than its small form."""
    return f"replace({squeezed(f'lower({col})')}, 'ß', 'ss')"


_ASKED = lambda *keys: "coalesce(" + ", ".join(f"nullif(regexp_extract(url, '[?&]{k}=([^&#]*)', 1), '')" for k in keys) + ", '')"
#: The job queue's rules once more, as a recursion over the numbered events of each job: who holds it, for how long, and what was refused.
_REPLAY = """WITH RECURSIVE e AS (SELECT user_id AS job, event_type AS kind, epoch_us(ts) / 1e6 AS tm, CAST(floor(value) AS BIGINT) AS v, CASE WHEN event_id % 5 = 0 THEN 1 END AS attempt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    s AS (SELECT CAST(0 AS BIGINT) AS n, job, '' AS status, CAST(0 AS BIGINT) AS attempts, 0e0 AS next_run_at, CAST(-1 AS BIGINT) AS owner, 0e0 AS lease_until, false AS publishing, CAST(0 AS BIGINT) AS applied, CAST(0 AS BIGINT) AS refused, CAST(0 AS BIGINT) AS recovered FROM (SELECT DISTINCT job FROM e)
      UNION ALL
      SELECT n, job, CASE WHEN NOT ok THEN status WHEN kind = 'signup' THEN 'queued' WHEN kind IN ('click', 'view') THEN 'running' WHEN kind = 'purchase' THEN 'completed' WHEN attempts >= 5 THEN 'failed' ELSE 'queued' END,
        attempts + CASE WHEN ok AND kind = 'click' THEN 1 ELSE 0 END,
        CASE WHEN ok AND kind = 'signup' THEN tm WHEN ok AND kind = 'error' THEN tm + 5 * power(2e0, greatest(0, attempts - 1)) ELSE next_run_at END,
        CASE WHEN ok AND kind = 'click' THEN worker WHEN ok AND kind IN ('purchase', 'error') THEN -1 ELSE owner END,
        CASE WHEN ok AND kind IN ('click', 'view') THEN tm + 21600 WHEN ok AND kind IN ('purchase', 'error') THEN 0e0 ELSE lease_until END,
        CASE WHEN ok AND kind = 'view' THEN true WHEN ok AND kind IN ('click', 'purchase', 'error') THEN false ELSE publishing END,
        applied + CASE WHEN ok THEN 1 ELSE 0 END, refused + CASE WHEN ok THEN 0 ELSE 1 END, recovered
      FROM (SELECT *, coalesce(CASE kind WHEN 'signup' THEN status = '' WHEN 'click' THEN status = 'queued' AND next_run_at <= tm WHEN 'view' THEN own AND NOT publishing AND lease_until > tm WHEN 'purchase' THEN own WHEN 'error' THEN own END, false) AS ok
        FROM (SELECT *, status = 'running' AND owner = worker AND (attempt IS NULL OR attempt = attempts) AS own
          FROM (SELECT e.n, e.job, kind, tm, ((v % 3) + 3) % 3 AS worker, attempt, attempts, publishing, applied, refused, CASE WHEN lost THEN 'queued' ELSE status END AS status, CASE WHEN lost THEN lease_until ELSE next_run_at END AS next_run_at,
              CASE WHEN lost THEN -1 ELSE owner END AS owner, CASE WHEN lost THEN 0e0 ELSE lease_until END AS lease_until, recovered + CASE WHEN lost THEN 1 ELSE 0 END AS recovered
            FROM (SELECT s.*, s.n + 1 AS next_n, e.tm AS now_tm, s.status = 'running' AND NOT s.publishing AND s.lease_until <= e.tm AS lost FROM s JOIN e ON e.job = s.job AND e.n = s.n + 1) x JOIN e ON e.job = x.job AND e.n = x.next_n))))
    SELECT job, status, attempts, next_run_at, owner, lease_until, publishing, applied, refused, recovered FROM s JOIN (SELECT job, max(n) AS n FROM e GROUP BY 1) l USING (job, n)"""

ORACLES = {
    "worker_answers": f"""WITH RECURSIVE q AS (SELECT event_id AS id, user_id % 40 AS k, epoch_us(ts) AS tm, event_id % 7 <> 0 AND event_id % 11 <> 0 AS usable, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b
          FROM events JOIN embeddings ON vec_id = event_id % (SELECT count(*) FROM embeddings)),
        u AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tm, id) AS n FROM q WHERE usable),
        r AS (SELECT k, n, id, tm + {TTL_S * 1_000_000} AS expires, id AS made_by, 'computed' AS step FROM u WHERE n = 1
          UNION ALL SELECT u.k, u.n, u.id, CASE WHEN u.tm >= r.expires THEN u.tm + {TTL_S * 1_000_000} ELSE r.expires END, CASE WHEN u.tm >= r.expires THEN u.id ELSE r.made_by END, CASE WHEN u.tm >= r.expires THEN 'computed' ELSE 'cached' END
          FROM r JOIN u ON u.k = r.k AND u.n = r.n + 1)
        SELECT q.id, coalesce(r.step, 'low_quality') AS step, round(100 / (1 + exp(-(1.5e0 * (0.4e0 * m.a - 0.5e0 * (m.b - 0.1e0) / 2 + 0.1e0) + 0.2e0))), 6) + 0e0 AS score, r.made_by
        FROM q LEFT JOIN r ON r.id = q.id LEFT JOIN q m ON m.id = r.made_by""",
    "job_queue_replay": _REPLAY,
    "pushed_applications": f"""WITH {APPS} SELECT strftime(applied, '%Y-%m') AS month, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS orders FROM apps
        WHERE applied BETWEEN DATE '{ASKED[0]}' AND DATE '{ASKED[1]}' AND status = '{ASKED[2]}' GROUP BY 1""",
    "posting_identity": f"""WITH a AS (SELECT page_id, CASE page_id % 9 {_URLS_SQL} ELSE url END AS url FROM pages), u AS (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS bare, {_HOST} AS host FROM a),
        h AS (SELECT *, regexp_extract(bare, '^([a-zA-Z]+://[^/]+)', 1) AS root, CASE {" ".join(f"WHEN regexp_matches(host, '{p}') THEN '{n}'" for n, p in postings.SITES)} ELSE '' END AS site FROM u),
        q AS (SELECT *, list_filter(string_split(substr(bare, length(root) + 1), '/'), lambda x: x <> '') AS parts FROM h),
        j AS (SELECT *, CASE site WHEN 'LinkedIn' THEN coalesce(nullif(regexp_extract(url, '{postings.LINKEDIN_PATH}', 1), ''), {_ASKED(*postings.LINKEDIN_KEYS)}) WHEN 'Indeed' THEN {_ASKED(*postings.INDEED_KEYS)}
          WHEN 'Greenhouse' THEN regexp_extract(bare, '{postings.GREENHOUSE_PATH}', 1) WHEN 'Lever' THEN coalesce(parts[-1], '') WHEN 'Workday' THEN coalesce(parts[-1], '') ELSE '' END AS job_id,
          CASE WHEN bare = root THEN bare || '/' ELSE bare END AS plain FROM q)
        SELECT page_id, site, job_id, CASE WHEN site = 'LinkedIn' AND job_id <> '' THEN root || '/jobs/view/' || job_id WHEN site = 'Indeed' AND job_id <> '' THEN plain || '?jk=' || job_id ELSE plain END AS canonical_url FROM j""",
    "posting_extract": f"""WITH p AS (SELECT page_id, url, {_HOST} AS host, trim(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) AS h1, regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1) AS art FROM pages),
        t AS (SELECT *, regexp_replace(regexp_replace(art, '(?i)</?(?:p|div|li|br|h1|h2|h3|h4|section|article|main|tr|ul|ol|title)(?:\\s[^>]*)?/?>', chr(10), 'g'), '(?s)<!--.*?-->|<[^>]*>', '', 'g') AS body FROM p),
        c AS (SELECT *, {_plain('h1')} AS title, array_to_string(list_filter(list_transform(string_split({_plain('body')}, chr(10)), lambda x: {squeezed("x")}), lambda x: x <> ''), chr(10)) AS description FROM t)
        SELECT page_id, host AS job_source, CASE WHEN regexp_replace(url, '[?#].*$', '') = regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) THEN regexp_replace(url, '[?#].*$', '') || '/' ELSE regexp_replace(url, '[?#].*$', '') END AS canonical_url, '' AS source_job_id, title, '' AS company, description,
          CASE WHEN description <> '' THEN 'original_saved' ELSE '' END AS provenance, CASE WHEN description <> '' THEN 'complete' ELSE 'unavailable' END AS quality FROM c""",
    "sponsorship_signal": f"WITH x AS (SELECT doc_id, text || ' ' || {_PROBE} AS t FROM documents) SELECT doc_id, CASE {_RULES(1)} ELSE 'No information' END AS message, CASE {_RULES(2)} ELSE 'warning' END AS kind FROM x",
    "role_company_keys": f"SELECT doc_id, sha256({_folded('text')} || '|' || {_folded('source')}) AS role_company_key FROM documents",
    "scoring_description": f"""WITH {scored_sql("CASE WHEN doc_id % 3 = 0 THEN text || chr(13) || chr(10) || chr(10) || '  Pay   Range: 10' || chr(10) || 'rest' ELSE text END")} SELECT doc_id, CAST(length(body) AS INTEGER) AS n_chars, sha256(body) AS sha FROM b""",
    "application_keys": f"WITH {APPS} SELECT o_orderkey, application_key FROM apps",
    "score_bands": f"WITH r AS (SELECT 2 * avg(l_quantity) AS score FROM lineitem GROUP BY l_orderkey) SELECT {_BAND} AS band, count(*) AS n FROM r GROUP BY 1",
    "dashboard_counts": f"""WITH {APPS} SELECT count(*) FILTER (WHERE applied = DATE '1998-07-15') AS current_day, count(*) FILTER (WHERE applied BETWEEN date_trunc('week', DATE '1998-07-15') AND DATE '1998-07-15') AS current_week,
        count(*) FILTER (WHERE applied BETWEEN DATE '1998-07-01' AND DATE '1998-07-15') AS current_month FROM apps""",
    "monthly_status_summary": f"""WITH {APPS}, m AS (SELECT * FROM apps WHERE applied BETWEEN DATE '1998-07-01' AND DATE '1998-07-15'), k(status) AS (VALUES ('Applied'), ('In Progress'), ('Rejected'), ('Cancelled'))
        SELECT k.status, count(m.status) AS n, (SELECT count(*) FROM m) AS total FROM k LEFT JOIN m ON m.status = k.status GROUP BY 1""",
    "application_search": f"""WITH {APPS}, f AS (SELECT * FROM apps WHERE contains(lower(company || ' ' || title || ' ' || source), '1-urgent') AND contains(lower(company || ' ' || title || ' ' || source), 'build'))
        SELECT o_orderkey, application_key, company, title, status, applied, source FROM f ORDER BY f.applied DESC, f.created DESC, o_orderkey LIMIT 8""",
    "application_search_status": f"WITH {APPS} SELECT o_orderkey, application_key, company, title, status, applied, source FROM apps WHERE contains(lower(company || ' ' || title || ' ' || source), 'machinery') AND status = 'Rejected'",
    "application_insights": f"""WITH {RUNS}, u AS (SELECT application_key, any_value(company) AS company FROM apps GROUP BY 1 HAVING count(*) = 1), p AS (SELECT application_key, max(score) AS score FROM runs GROUP BY 1 HAVING count(*) = 1)
        SELECT u.application_key, company, round(score, 6) + 0e0 AS score, CASE WHEN score IS NOT NULL THEN {_BAND} END AS band FROM u LEFT JOIN p ON u.application_key = p.application_key""",
    "backfill_reasons": f"""WITH {APPS}, j AS (SELECT apps.*, text AS body FROM apps JOIN documents ON doc_id = o_orderkey % (SELECT count(*) FROM documents)),
        r AS (SELECT CASE WHEN o_orderkey % 37 = 0 THEN 'missing_application_key' WHEN o_orderkey % 31 = 0 OR body = '' THEN 'missing_description' WHEN o_orderkey % 29 = 0 THEN 'invalid_provenance'
            WHEN o_orderkey % 23 = 0 OR length(body) < 100 THEN 'low_quality_description' WHEN o_orderkey % 19 = 0 THEN 'invalid_capture_time' WHEN floor(date_diff('second', created, TIMESTAMP '1998-07-15 09:30:00') / 86400.0) > 365 THEN 'expired_description'
            WHEN o_orderkey % 17 = 0 THEN 'missing_resume_snapshot' WHEN o_orderkey % 13 = 0 THEN 'ambiguous_resume_snapshot' WHEN o_orderkey % 11 = 0 THEN 'missing_historical_resume_hash' WHEN o_orderkey % 7 = 0 THEN 'resume_snapshot_changed'
            WHEN o_orderkey % 5 = 0 THEN 'immutable_input_conflict' ELSE 'eligible' END AS reason FROM j) SELECT reason, count(*) AS n FROM r GROUP BY 1""",
    "application_time_runs": f"WITH {RUNS} SELECT run_id, application_key, row_number() OVER (PARTITION BY application_key ORDER BY run_id) = 1 AS is_first FROM runs",
    "score_cache_lookup": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00')
        SELECT user_id, event_id, value FROM l WHERE place = 1 AND ts + INTERVAL 300 SECOND > TIMESTAMP '2024-01-15 11:00:00'""",
    "latency_percentiles": "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) + 0e0 AS p50, round(quantile_cont(value, 0.95), 6) + 0e0 AS p95, CAST(floor(300.0 / median(value)) AS BIGINT) AS capacity FROM events GROUP BY 1",
}
