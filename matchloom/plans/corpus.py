"""Queries on the corpus of labelled pairs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchloom.operators import audit, graph
from matchloom.sources import bindings


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.prepared(bindings.pairs(spark, sf_dir))


QUERIES = {
    "audit_rows": lambda s, d: audit.summary(rows(s, d)),
    "audit_missing": lambda s, d: audit.missing(rows(s, d)),
    "label_distribution": lambda s, d: audit.labels(rows(s, d)),
    "conflicting_pairs": lambda s, d: audit.conflicts(rows(s, d)),
    "length_distribution": lambda s, d: audit.lengths(rows(s, d)),
    "top_reused_docs": lambda s, d: audit.reused(rows(s, d), "resume").union(audit.reused(rows(s, d), "jd")),
    "text_issues": lambda s, d: audit.text_issues(rows(s, d)),
    "split_leakage_published": lambda s, d: audit.leakage(rows(s, d), "split"),
    "split_leakage_hash": lambda s, d: audit.leakage(audit.hash_split(rows(s, d)), "split_hash"),
    "bipartite_components": lambda s, d: graph.bipartite(rows(s, d)).drop("component").groupBy("n_resumes", "n_jds", "n_pairs").count().withColumnRenamed("count", "n_components"),
}

#: White space that \\s leaves out in RE2: vertical tab, separators, next line, no-break and other Unicode blanks.
BLANK = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def squeezed(col: str) -> str:
    return f"trim(regexp_replace(coalesce({col}, ''), '{BLANK}', ' ', 'g'))"


_N = "(SELECT count(*) FROM documents)"
PAIRS = f"""
base AS (
  SELECT l.doc_id, k, l.doc_id * 3 + k AS ordinal, l.quality, l.toxic, (l.doc_id * 31 + 7 * k + 1) % {_N} AS jd_id FROM labels l, range(3) t(k)),
r0 AS (
  SELECT b.*, r.text AS t0, r.source AS resume_domain, j.lang AS jd_domain, CASE WHEN b.ordinal % 97 <> 0 THEN j.text END AS jd
  FROM base b JOIN documents r ON r.doc_id = b.doc_id JOIN documents j ON j.doc_id = b.jd_id),
r1 AS (SELECT *, t0 || CASE WHEN ordinal % 41 = 0 THEN chr(65533) ELSE '' END || CASE WHEN ordinal % 43 = 0 THEN chr(7) ELSE '' END
  || CASE WHEN ordinal % 47 = 0 THEN 'â€' ELSE '' END || CASE WHEN ordinal % 53 = 0 THEN chr(10) || 'Summary' || chr(10) || 'Professional Profile' ELSE '' END AS t1 FROM r0),
r2 AS (SELECT doc_id, k, ordinal, CASE WHEN ordinal % 59 = 0 AND strpos(t1, ' ') > 0 THEN substr(t1, 1, strpos(t1, ' ') - 1) || chr(160) || substr(t1, strpos(t1, ' ') + 1) ELSE t1 END AS resume, jd,
  CASE WHEN toxic = 1 OR k = 2 THEN 'No Fit' WHEN quality = 1 THEN 'Good Fit' ELSE 'Potential Fit' END AS label, resume_domain, jd_domain,
  CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split FROM r1),
pairs AS (
  SELECT * FROM r2
  UNION ALL SELECT doc_id, k, ordinal + 1000000000, '  ' || resume || '  ', jd, label, 'alt', jd_domain, split FROM r2 WHERE k = 0 AND doc_id % 20 = 0
  UNION ALL SELECT doc_id, k, ordinal + 2000000000, resume, jd, 'No Fit', resume_domain, jd_domain, split FROM r2 WHERE k = 0 AND doc_id % 30 = 0),
n0 AS (SELECT *, {squeezed("resume")} AS resume_norm, {squeezed("jd")} AS jd_norm, {squeezed("label")} AS label_norm FROM pairs),
rows_ AS (SELECT *, sha256(resume_norm) AS resume_hash, sha256(jd_norm) AS jd_hash, resume_norm <> '' AND jd_norm <> '' AND label_norm <> '' AS usable FROM n0),
used AS (SELECT * FROM rows_ WHERE usable)"""


def _side_docs(side: str) -> str:
    return f"SELECT '{side}' AS side, {side}_hash AS hash, any_value({side}_norm) AS text, count(*) AS uses, min(ordinal) AS first_ordinal FROM used GROUP BY {side}_hash"


def _leakage(source: str) -> str:
    return f"""
k AS (SELECT split, 'resume' AS kind, resume_hash AS hash FROM {source} UNION SELECT split, 'jd', jd_hash FROM {source} UNION SELECT split, 'pair', sha256(resume_hash || ':' || jd_hash) FROM {source})
SELECT a.split, a.kind, count(*) AS n_unique, count(b.hash) AS n_shared FROM k a LEFT JOIN k b ON a.kind = b.kind AND a.hash = b.hash AND b.split = 'train'
WHERE a.split <> 'train' GROUP BY 1, 2"""


def _issues(side: str) -> str:
    codes = [
        ("replacement_character", f"contains({side}, chr(65533))"),
        ("control_character", f"regexp_matches({side}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]|[\\x{{80}}-\\x{{9f}}]')"),
        ("possible_mojibake", f"regexp_matches({side}, 'â€|ðŸ|Ã[^\\n]|Â[^\\n]')"),
    ]
    if side == "resume":
        codes.append(("possible_concatenation", f"len(regexp_extract_all({side}, '(?i)(?:^|\\n)\\s*(?:summary|professional profile|professional summary|career profile)')) > 1"))
    return " UNION ALL ".join(f"SELECT '{side}' AS side, '{c}' AS issue, {side}_hash AS hash FROM rows_ WHERE {e}" for c, e in codes)


ORACLES = {
    "audit_rows": f"""WITH {PAIRS},
        p AS (SELECT count(*) AS n, count(DISTINCT label_norm) AS labels FROM used GROUP BY resume_hash, jd_hash)
        SELECT (SELECT count(*) FROM rows_) AS total_rows, (SELECT count(*) FROM used) AS usable_rows, sum(n - 1) AS repeated_pair_rows, sum(n - labels) AS exact_duplicate_rows,
               count(*) AS unique_pairs, count(*) FILTER (WHERE labels > 1) AS conflicting_pairs,
               (SELECT count(DISTINCT resume_hash) FROM used) AS unique_resumes, (SELECT count(DISTINCT jd_hash) FROM used) AS unique_jds FROM p""",
    "audit_missing": f"""WITH {PAIRS} SELECT 'resume' AS field, count(*) FILTER (WHERE resume_norm = '') AS missing_rows FROM rows_
        UNION ALL SELECT 'jd', count(*) FILTER (WHERE jd_norm = '') FROM rows_ UNION ALL SELECT 'label', count(*) FILTER (WHERE label_norm = '') FROM rows_""",
    "label_distribution": f"""WITH {PAIRS} SELECT CASE WHEN label_norm = '' THEN '<missing>' ELSE label_norm END AS label, count(*) AS n,
        CAST(100 * count(*) AS DOUBLE) / (SELECT count(*) FROM rows_) AS percent FROM rows_ GROUP BY 1""",
    "conflicting_pairs": f"""WITH {PAIRS} SELECT resume_hash, jd_hash, string_agg(DISTINCT label_norm, '|' ORDER BY label_norm) AS labels
        FROM used GROUP BY 1, 2 HAVING count(DISTINCT label_norm) > 1""",
    "length_distribution": f"""WITH {PAIRS}, d AS ({_side_docs("resume")} UNION ALL {_side_docs("jd")})
        SELECT side, count(*) AS n, min(length(text)) AS smallest, median(length(text)) AS median_length, quantile_disc(length(text), 0.95) AS p95, max(length(text)) AS largest FROM d GROUP BY side""",
    "top_reused_docs": f"""WITH {PAIRS}, d AS ({_side_docs("resume")} UNION ALL {_side_docs("jd")}),
        o AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY uses DESC, first_ordinal) AS place FROM d)
        SELECT side, hash, uses, left(text, 160) AS preview FROM o WHERE place <= 20""",
    "text_issues": f"""WITH {PAIRS}, i AS ({_issues("resume")} UNION ALL {_issues("jd")}) SELECT side, issue, count(*) AS n_rows, count(DISTINCT hash) AS n_documents FROM i GROUP BY 1, 2""",
    "split_leakage_published": f"WITH {PAIRS}, {_leakage('used')}",
    "split_leakage_hash": f"""WITH {PAIRS},
        o AS (SELECT * EXCLUDE (split), row_number() OVER (ORDER BY sha256('42:' || CAST(ordinal AS VARCHAR)), ordinal) AS place, count(*) OVER () AS total FROM used),
        h AS (SELECT *, CASE WHEN place <= floor(total * 0.8) THEN 'train' WHEN place <= floor(total * 0.8) + floor(total * 0.1) THEN 'validation' ELSE 'test' END AS split FROM o), {_leakage("h")}""",
}
