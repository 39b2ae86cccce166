"""Queries on reports, lengths, features, packed models and sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import postings, presentation, text
from matchloom.operators import graph, learn, model, reports
from matchloom.operators import metrics as m
from matchloom.operators import vectors as v
from matchloom.plans.corpus import BLANK, PAIRS, rows, squeezed
from matchloom.plans.features import rounded
from matchloom.plans.service import APPS
from matchloom.sources import bindings as b
from matchloom.sources import files, pages

CONTEXT = 300


def _odd_labels(s: SparkSession, d: str) -> DataFrame:
    return rows(s, d).withColumn("label_norm", F.when(F.col("ordinal") % 101 == 0, "Maybe").otherwise(F.col("label_norm")))


def _tokens(s: SparkSession, d: str) -> DataFrame:
    return b.token_counts(s, d).select(F.col("document_hash").alias("hash"), "text", F.col("token_count").alias("tokens"))


def _index(s: SparkSession, d: str) -> DataFrame:
    return files.offsets(b.token_counts(s, d).select("document_hash", "token_count"))


def _index_errors(s: SparkSession, d: str) -> DataFrame:
    """Errors of an index in which every hundredth offset or so was moved or cut."""
    i = _index(s, d)
    total = i.agg(F.sum("token_count")).first()[0] or 0
    code = F.conv(F.substring("document_hash", 1, 6), 16, 10).cast("long")
    hurt = i.select("document_hash", F.when(code % 97 == 0, F.col("offset") + 1).when(code % 89 == 0, F.lit(-1)).otherwise(F.col("offset")).cast("long").alias("offset"), F.when(code % 83 == 0, 0).otherwise(F.col("token_count")).cast("long").alias("token_count"))
    return files.offset_errors(hurt, total)


def _counted_pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs with the token counts of both documents, by label."""
    c = b.token_counts(s, d).select("document_hash", "token_count")
    docs = b.table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    pair = docs.select("doc_id", F.col("h").alias("l")).join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("h").alias("r")), "doc_id")
    out = pair.join(c.select(F.col("document_hash").alias("l"), F.col("token_count").alias("l_tokens")), "l", "left").join(c.select(F.col("document_hash").alias("r"), F.col("token_count").alias("r_tokens")), "r", "left")
    return out.select("doc_id", "l_tokens", "r_tokens")


def _numbers(s: SparkSession, d: str) -> model.Scorer:
    n = 64
    return model.Scorer(tuple(i / 1000 for i in range(n)), tuple(1 + i / 100 for i in range(n)), (tuple(i % 7 / 3 for i in range(n)), tuple(i % 5 / 2 for i in range(n))), (0.25, -0.5), 1.5, 0.125, 0.45)


def _payloads(s: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    r = b.table(s, d, "documents").select(
        k,
        F.when(k % 5 == 0, "/tmp/x").alias("resume_path"),
        F.when(k % 7 == 0, " ").otherwise(F.col("text")).alias("resume_text"),
        F.when(k % 11 == 0, "").otherwise(F.col("text")).alias("job_description"),
        F.when(k % 13 == 0, "no").otherwise(F.sha2("text", 256)).alias("job_description_hash"),
        F.lit("a").alias("input_fingerprint"),
        F.when(k % 3 == 0, "b").otherwise("a").alias("expected_fingerprint"),
    )
    return r.select(F.array_join(model.payload_errors(r), "|").alias("errors")).groupBy("errors").agg(F.count(F.lit(1)).alias("n"))


def _fold_f1(s: SparkSession, d: str) -> DataFrame:
    """Macro-F1 at 0.5 by fold of the probabilities."""
    p = b.probabilities(s, d).select((F.col("doc_id") % 5).cast("int").alias("fold"), "y", (F.col("p") >= 0.5).cast("int").alias("h"))
    c = p.groupBy("fold").agg(F.count_if((F.col("y") == 1) & (F.col("h") == 1)).alias("tp"), F.count_if((F.col("y") == 0) & (F.col("h") == 1)).alias("fp"), F.count_if((F.col("y") == 1) & (F.col("h") == 0)).alias("fn"), F.count_if((F.col("y") == 0) & (F.col("h") == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("fold", ((m.f1(tp, fp, fn) + m.f1(tn, fn, fp)) / 2).alias("macro_f1"))


def _page_json(s: SparkSession, d: str) -> DataFrame:
    """Applications as nested JSON pages and flat again."""
    none = F.lit(None).cast("string")
    run = lambda c: F.array(F.struct(F.left(c, F.lit(3)).alias("plain_text"), F.struct(none.alias("content")).alias("text")), F.struct(none.alias("plain_text"), F.struct(F.expr(f"substring({c}, 4)").alias("content")).alias("text")))
    a = b.applications(s, d)
    properties = F.create_map(
        F.lit("Company"), F.to_json(F.struct(run("company").alias("title"))),
        F.lit("Job title"), F.to_json(F.struct(run("title").alias("rich_text"))),
        F.lit("Job source"), F.to_json(F.struct(F.struct(F.col("source").alias("name")).alias("select"))),
        F.lit("Status"), F.to_json(F.struct(F.struct(F.col("status").alias("name")).alias("status"))),
        F.lit("Application date"), F.to_json(F.struct(F.struct(F.concat(F.col("applied").cast("string"), F.lit("T10:00")).alias("start")).alias("date"))),
        F.lit("Application key"), F.to_json(F.struct(run("application_key").alias("rich_text"))),
        F.lit("Referral"), F.concat(F.lit('{"checkbox":'), (F.col("o_orderkey") % 2 == 0).cast("string"), F.lit("}")),
    )
    inner = F.array_join(F.transform(F.map_entries(properties), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ",")
    flat = pages.applications(a.select(F.concat(F.lit('{"properties":{'), inner, F.lit("}}")).alias("json")))
    return flat.select("application_key", "company", "job_title", "job_source", "status", "application_date", "referral")


def _score_json(s: SparkSession, d: str) -> DataFrame:
    """Scores as nested JSON pages and flat again; some of their JSON can't be read."""
    r = F.col("run_id")
    words = lambda c: F.concat(F.lit('{"rich_text":[{"plain_text":'), F.to_json(F.struct(c.alias("t"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("t")))) - 6), F.lit("}]}"))
    terms = F.when(r % 3 == 0, "not json").otherwise(F.concat(F.lit('["a","b'), r.cast("string"), F.lit('"]')))
    page = F.concat(F.lit('{"properties":{"Score":{"number":'), F.col("score").cast("string"), F.lit('},"Band":{"select":{"name":"'), text.band(F.col("score")), F.lit('"}},"Matched terms":'), words(terms), F.lit("}}"))
    flat = pages.scores(b.score_runs(s, d).select(page.alias("json")))
    return flat.groupBy("band", F.size("matched_terms").alias("n_terms"), F.size("category_breakdown").alias("n_categories")).agg(F.count(F.lit(1)).alias("n"), F.count("fit_label").alias("n_labels"))


def _results(s: SparkSession, d: str) -> DataFrame:
    """Score results, some of them wrong, with what is wrong and their terms in order."""
    r = F.col("run_id")
    rows_ = b.score_runs(s, d).select(
        F.when(r % 17 != 0, "k").alias("application_key"), F.lit("f").alias("input_fingerprint"), F.lit("v").alias("scorer_version"), F.lit("m").alias("embedding_model"),
        F.when(r % 13 != 0, F.col("score")).alias("score"),
        F.when(r % 11 == 0, "Weak").otherwise(text.band(F.col("score"))).alias("band"),
        F.when(r % 7 != 0, F.array(F.lit(" b"), F.lit("B"), F.lit("a"), F.lit(""), F.lit("a"))).alias("matched_terms"),
        F.when(r % 5 == 0, F.create_map(F.lit("x"), F.lit(101.0))).otherwise(F.create_map(F.lit("x"), F.lit(1.0))).alias("category_breakdown"),
    )
    found = pages.score_errors(rows_)
    return found.groupBy(F.array_join("errors", "|").alias("errors"), F.array_join("matched_terms", ",").alias("terms")).agg(F.count(F.lit(1)).alias("n"))


def _streams(s: SparkSession, d: str) -> DataFrame:
    """Event lines of each user, and how the stream ends."""
    e = b.table(s, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "event: complete").when(F.col("event_type") == "error", "event: error").when(F.col("event_type") == "view", "event: progress")
    lines = e.select(F.col("user_id").alias("stream"), F.col("event_id").alias("pos"), F.coalesce(kind, F.concat(F.lit("data: "), F.col("event_id").cast("string"))).alias("line"))
    return files.completed(lines)


def _urls(s: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    raw = F.when(k % 4 == 0, F.concat(F.lit("  https://www.linkedin.com/in/"), k.cast("string"), F.lit(" "))).when(k % 4 == 1, "").when(k % 4 == 2, "http://github.com.example.org/").otherwise("https://gist.github.com/x")
    rows_ = b.table(s, d, "pages").select("page_id", presentation.normal_url(raw).alias("url"))
    return rows_.select("page_id", "url", presentation.is_on(F.col("url"), "linkedin.com").alias("linkedin"), presentation.is_on(F.col("url"), "github.com").alias("github"))


def _residuals(s: SparkSession, d: str) -> DataFrame:
    docs = b.table(s, d, "documents").select("doc_id", F.length("text").alias("n"))
    lens = docs.select(F.col("doc_id").alias("id"), F.col("n").alias("len_l")).join(docs.select((F.col("doc_id") - 1).alias("id"), F.col("n").alias("len_r")), "id")
    long = v.long(b.vectors(s, d)).select(F.col("vec_id").alias("id"), "dim", "x").join(lens, "id")
    return rounded(v.residuals(long, F.col("id") % 5 != 0), "z", digits=4)


def _decisions(s: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    shown = presentation.decision(F.when(k % 9 != 0, F.col("p")), F.lit(0.45), F.when(F.col("p") >= 0.45, "Good Fit").otherwise("No Fit"))
    return b.probabilities(s, d).select("doc_id", F.array_join(F.transform(shown, lambda r: F.concat(r["label"], F.lit("="), r["value"])), "|").alias("shown"))


def _summary_json(s: SparkSession, d: str) -> DataFrame:
    from matchloom.operators import audit

    return reports.as_json(audit.summary(rows(s, d)))


def _with_copies(vectors: DataFrame) -> DataFrame:
    """Vectors with three more features: one that nearly repeats the first, one that is another's opposite, and one of two."""
    x = lambda i: F.col("vec")[i - 1]
    return vectors.withColumn("vec", F.concat("vec", F.array(0.99 * x(1) + 0.1 * x(2), -x(3), x(4) + x(5))))


QUERIES = {
    "majority_baseline": lambda s, d: reports.majority_baseline(rows(s, d)),
    "unexpected_labels": lambda s, d: reports.unexpected_labels(_odd_labels(s, d)),
    "label_counts": lambda s, d: reports.label_counts(rows(s, d).where("label_norm <> 'Potential Fit'")),
    "encoded_labels": lambda s, d: rows(s, d).where("usable").groupBy(text.encoded_label(F.col("label_norm")).alias("three"), text.encoded_label(F.col("label_norm"), True).alias("two")).agg(F.count(F.lit(1)).alias("n")),
    "largest_components": lambda s, d: reports.largest_components(graph.bipartite(rows(s, d))),
    "token_length_summary": lambda s, d: rounded(reports.length_summary(_tokens(s, d), CONTEXT), "median_length", "over_share", "removed_median"),
    "longest_documents": lambda s, d: reports.longest(_tokens(s, d), CONTEXT),
    "token_index": _index,
    "token_index_errors": _index_errors,
    "token_cache_bytes": lambda s, d: reports.cache_bytes(_index(s, d), 64),
    "pair_token_counts": _counted_pairs,
    "chunk_histogram": lambda s, d: reports.chunk_histogram(v.chunk_spans(b.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("n")), 500, 50)),
    "class_feature_statistics": lambda s, d: rounded(reports.class_statistics(v.long(b.vectors(s, d))), "mean", "std", "q25", "median", "q75"),
    "redundant_features": lambda s, d: reports.redundant(rounded(v.moments(_with_copies(b.vectors(s, d))), "r")),
    "separating_features": lambda s, d: reports.separating(rounded(v.eta_squared(b.vectors(s, d)), "eta2")),
    "expected_purity": lambda s, d: rounded(reports.expected_purity(b.vectors(s, d), F.col("vec_id") % 5 != 0), "expected_purity"),
    "binned_mutual_information": lambda s, d: rounded(reports.mutual_information(v.long(b.vectors(s, d))), "information"),
    "best_fold": lambda s, d: rounded(reports.best_fold(_fold_f1(s, d)), "macro_f1", digits=9),
    "packed_scores": lambda s, d: rounded(model.scored(b.vectors(s, d), _numbers(s, d)).select("vec_id", "margin", "probability", "label", "score", "band"), "margin", "probability", "score"),
    "payload_errors": _payloads,
    "early_stopped_scores": lambda s, d: rounded(learn.adam_scores(b.vectors(s, d).select(F.col("vec_id").alias("id"), "vec", (F.col("label") % 2).alias("y"), (F.col("vec_id") % 3).alias("fold"))), "probability"),
    "length_residuals_full": _residuals,
    "audit_json": _summary_json,
    "flattened_pages": _page_json,
    "flattened_scores": _score_json,
    "score_result_errors": _results,
    "event_stream_outcomes": _streams,
    "text_chunks": lambda s, d: b.table(s, d, "documents").select("doc_id", text.utf16_chunks("text").alias("c")).select("doc_id", F.size("c").alias("n_chunks"), F.sha2(F.array_join("c", ""), 256).alias("sha")),
    "cleaned_lines": lambda s, d: b.table(s, d, "documents").select("doc_id", files.cleaned(F.concat(F.lit("x\n  \n"), F.coalesce("text", F.lit("")))).alias("t")).select("doc_id", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("sha")),
    "normal_titles": lambda s, d: b.table(s, d, "pages").select("page_id", postings.normal_title(F.concat(F.lit("Engineer "), F.col("page_id").cast("string"), F.lit(" | Acme | x")), F.when(F.col("page_id") % 2 == 0, "LinkedIn").otherwise("Lever")).alias("title")),
    "settings_urls": _urls,
    "decision_texts": _decisions,
    "config_fingerprint": lambda s, d: s.createDataFrame([(model.fingerprint({"b": [1, 2], "a": {"y": None, "x": "ü"}}),)], "fingerprint string"),
    "filler_texts": lambda s, d: b.table(s, d, "labels").select("doc_id", text.filler("Python and SQL. ", (F.col("doc_id") % 100).cast("int")).alias("t")),
    "run_capacity": lambda s, d: b.table(s, d, "events").select("event_id", text.capacity(F.lit(300.0), F.when(F.col("event_id") % 10 == 0, 0.0).otherwise(F.col("value"))).alias("runs")),
}

_LABELS = "f(label) AS (VALUES ('No Fit'), ('Potential Fit'), ('Good Fit'))"
_V = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings), e AS (SELECT vec_id, label, unnest(vec) AS x, unnest(range(len(vec))) AS dim FROM v)"
_T = "t AS (SELECT sha256(text) AS hash, any_value(text) AS text, CAST(len(string_split(any_value(text), ' ')) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL GROUP BY 1)"
_I = f"{_T}, i AS (SELECT hash AS document_hash, CAST(coalesce(sum(tokens) OVER (ORDER BY tokens DESC, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", tokens AS token_count FROM t)"
_ETA = "g AS (SELECT *, avg(x) OVER (PARTITION BY dim) AS gm, avg(x) OVER (PARTITION BY dim, label) AS cm FROM e), eta AS (SELECT CAST(dim AS INTEGER) AS dim, round(sum((cm - gm) * (cm - gm)) / sum((x - gm) * (x - gm)), 6) + 0e0 AS eta2 FROM g GROUP BY 1)"
#: Components by the smallest label among neighbours until nothing changes.
_COMPONENTS = f"""WITH RECURSIVE {PAIRS}, ed AS (SELECT DISTINCT 'resume:' || resume_hash AS a, 'jd:' || jd_hash AS b FROM used), arc AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed),
    cc(id, comp) USING KEY (id) AS (SELECT DISTINCT a, a FROM arc UNION SELECT u.id, min(c.comp) FROM arc JOIN cc c ON c.id = arc.b JOIN recurring.cc u ON u.id = arc.a WHERE c.comp < u.comp GROUP BY u.id),
    k AS (SELECT comp, count(*) FILTER (WHERE id LIKE 'resume:%') AS n_resumes, count(*) FILTER (WHERE id LIKE 'jd:%') AS n_jds FROM cc GROUP BY 1),
    n AS (SELECT comp, count(*) AS n_pairs FROM ed JOIN cc ON id = a GROUP BY 1)"""
_PERCENT = lambda c: f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END || '%'"
ORACLES = {
    "majority_baseline": f"WITH {PAIRS} SELECT label_norm AS label, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM rows_) AS share FROM rows_ WHERE label_norm <> '' GROUP BY 1 ORDER BY n DESC, label LIMIT 1",
    "unexpected_labels": f"WITH {PAIRS} SELECT 'Maybe' AS label, count(*) AS n FROM rows_ WHERE ordinal % 101 = 0",
    "label_counts": f"WITH {PAIRS}, {_LABELS} SELECT f.label, count(label_norm) AS n FROM f LEFT JOIN (SELECT * FROM rows_ WHERE label_norm <> 'Potential Fit') r ON r.label_norm = f.label GROUP BY 1",
    "encoded_labels": f"WITH {PAIRS} SELECT CAST(CASE label_norm WHEN 'No Fit' THEN 0 WHEN 'Potential Fit' THEN 1 ELSE 2 END AS INTEGER) AS three, CAST(CASE label_norm WHEN 'No Fit' THEN 0 ELSE 1 END AS INTEGER) AS two, count(*) AS n FROM used GROUP BY 1, 2",
    "bipartite_components": f"{_COMPONENTS} SELECT n_resumes, n_jds, n_pairs, count(*) AS n_components FROM k JOIN n ON n.comp = k.comp GROUP BY 1, 2, 3",
    "largest_components": f"{_COMPONENTS} SELECT n_resumes + n_jds AS documents, n_resumes, n_jds FROM k ORDER BY 1 DESC, 2 DESC LIMIT 5",
    "token_length_summary": f"""WITH {_T}, b AS (SELECT tokens, CASE WHEN tokens > {CONTEXT} THEN tokens - {CONTEXT} END AS beyond FROM t) SELECT count(*) AS documents, min(tokens) AS least, median(tokens) AS median_length, quantile_disc(tokens, 0.9) AS p90,
        quantile_disc(tokens, 0.95) AS p95, quantile_disc(tokens, 0.99) AS p99, max(tokens) AS most, count(beyond) AS over_context, round(CAST(count(beyond) AS DOUBLE) / count(*), 6) + 0e0 AS over_share, coalesce(median(beyond), 0) AS removed_median,
        coalesce(quantile_disc(beyond, 0.95), 0) AS removed_p95, coalesce(max(beyond), 0) AS removed_most FROM b""",
    "longest_documents": f"WITH {_T} SELECT hash, tokens, greatest(0, tokens - {CONTEXT}) AS tokens_over, CAST(length(text) AS INTEGER) AS characters, left(text, 240) AS head, right(text, 240) AS tail FROM t ORDER BY tokens DESC, hash LIMIT 10",
    "token_index": f"WITH {_I} SELECT * FROM i",
    "token_index_errors": f"""WITH {_I}, c AS (SELECT *, CAST('0x' || substr(document_hash, 1, 6) AS BIGINT) AS code FROM i),
        h AS (SELECT document_hash, CASE WHEN code % 97 = 0 THEN "offset" + 1 WHEN code % 89 = 0 THEN -1 ELSE "offset" END AS o, CASE WHEN code % 83 = 0 THEN 0 ELSE token_count END AS n FROM c),
        l AS (SELECT *, lead(o) OVER (ORDER BY o, document_hash) AS next FROM h)
        SELECT count(*) - count(DISTINCT document_hash) AS repeated, count(*) FILTER (WHERE o < 0 OR n <= 0) AS bad_ranges, count(*) FILTER (WHERE next <> o + n) AS gaps, count(*) FILTER (WHERE o + n > (SELECT sum(token_count) FROM i)) AS beyond FROM l""",
    "token_cache_bytes": f"WITH {_I} SELECT count(*) AS documents, CAST(sum(token_count) AS BIGINT) AS tokens, CAST(sum(token_count) * 128 AS BIGINT) AS bytes FROM i",
    "pair_token_counts": "SELECT a.doc_id, CAST(len(string_split(a.text, ' ')) AS BIGINT) AS l_tokens, CAST(len(string_split(b.text, ' ')) AS BIGINT) AS r_tokens FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1",
    "chunk_histogram": "WITH c AS (SELECT CAST(greatest(0, ceil((length(text) - 500) / 450.0)) AS BIGINT) + 1 AS n_chunks FROM documents WHERE length(text) > 0) SELECT n_chunks, count(*) AS n_documents FROM c GROUP BY 1",
    "class_feature_statistics": f"WITH {_V} SELECT CAST(dim AS INTEGER) AS dim, label, " + ", ".join(f"round({e}, 6) + 0e0 AS {n}" for n, e in (("mean", "avg(x)"), ("std", "stddev_pop(x)"), ("q25", "quantile_cont(x, 0.25)"), ("median", "median(x)"), ("q75", "quantile_cont(x, 0.75)"))) + " FROM e GROUP BY 1, 2",
    "redundant_features": f"""WITH {_V}, w AS (SELECT vec_id, list_concat(vec, [0.99e0 * vec[1] + 0.1e0 * vec[2], -vec[3], vec[4] + vec[5]]) AS vec FROM v), e2 AS (SELECT vec_id, unnest(vec) AS x, unnest(range(len(vec))) AS dim FROM w),
        r AS (SELECT CAST(a.dim AS INTEGER) AS i, CAST(b.dim AS INTEGER) AS j, round(corr(a.x, b.x), 6) + 0e0 AS r FROM e2 a JOIN e2 b ON a.vec_id = b.vec_id AND a.dim < b.dim GROUP BY 1, 2) SELECT * FROM r WHERE abs(r) >= 0.95""",
    "separating_features": f"WITH {_V}, {_ETA} SELECT * FROM eta ORDER BY eta2 DESC, dim LIMIT 12",
    "expected_purity": """WITH c AS (SELECT label, count(*) FILTER (WHERE vec_id % 5 <> 0) AS a, count(*) FILTER (WHERE vec_id % 5 = 0) AS b FROM embeddings GROUP BY 1)
        SELECT round(sum(CAST(a AS DOUBLE) * b) / ((SELECT sum(a) FROM c) * (SELECT sum(b) FROM c)), 6) + 0e0 AS expected_purity FROM c""",
    "binned_mutual_information": f"""WITH {_V}, w AS (SELECT *, min(x) OVER (PARTITION BY dim) AS lo, max(x) OVER (PARTITION BY dim) AS hi FROM e), d AS (SELECT dim, label, least(9, floor((x - lo) / (hi - lo) * 10)) AS bin FROM w),
        c AS (SELECT dim, bin, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY dim, bin) AS nb, sum(count(*)) OVER (PARTITION BY dim, label) AS nl, sum(count(*)) OVER (PARTITION BY dim) AS nd FROM d GROUP BY 1, 2, 3)
        SELECT CAST(dim AS INTEGER) AS dim, round(sum(CAST(n AS DOUBLE) / nd * ln(CAST(n AS DOUBLE) * nd / (nb * nl))), 6) + 0e0 AS information FROM c GROUP BY 1""",
    "best_fold": """WITH p AS (SELECT CAST(doc_id % 5 AS INTEGER) AS fold, quality AS y, 0.3e0 * quality + 0.7e0 * ((doc_id * 7919) % 1000) / 1000e0 >= 0.5 AS h FROM labels),
        c AS (SELECT fold, CAST(count(*) FILTER (WHERE y = 1 AND h) AS DOUBLE) AS tp, count(*) FILTER (WHERE y = 0 AND h) AS fp, count(*) FILTER (WHERE y = 1 AND NOT h) AS fn, CAST(count(*) FILTER (WHERE y = 0 AND NOT h) AS DOUBLE) AS tn FROM p GROUP BY 1)
        SELECT fold, round((CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END + CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END) / 2, 9) AS macro_f1 FROM c ORDER BY 2 DESC, 1 LIMIT 1""",
    "packed_scores": f"""WITH {_V}, l AS (SELECT vec_id, sum((x - dim / 1000e0) / (1 + dim / 100e0) * (dim % 5 / 2e0)) - 0.5e0 - sum((x - dim / 1000e0) / (1 + dim / 100e0) * (dim % 7 / 3e0)) - 0.25e0 AS m FROM e GROUP BY 1), p AS (SELECT *, 1 / (1 + exp(-(1.5e0 * m + 0.125e0))) AS p FROM l)
        SELECT vec_id, round(m, 6) + 0e0 AS margin, round(p, 6) + 0e0 AS probability, CASE WHEN p >= 0.45 THEN 'Good Fit' ELSE 'No Fit' END AS label, round(100 * p, 6) + 0e0 AS score, CASE WHEN 100 * p >= 75 THEN 'Strong' WHEN 100 * p >= 55 THEN 'Moderate' ELSE 'Weak' END AS band FROM p""",
    "payload_errors": """WITH e AS (SELECT concat_ws('|', CASE WHEN doc_id % 5 = 0 THEN 'a local path isn''t allowed' END, CASE WHEN doc_id % 7 = 0 OR trim(coalesce(text, '')) = '' THEN 'resume_text is required' END,
        CASE WHEN doc_id % 11 = 0 OR trim(coalesce(text, '')) = '' THEN 'job_description is required' END, CASE WHEN doc_id % 13 = 0 OR (doc_id % 11 = 0 AND text <> '') OR text IS NULL THEN 'job_description_hash differs' END,
        CASE WHEN doc_id % 3 = 0 THEN 'input_fingerprint differs' END) AS errors FROM documents) SELECT errors, count(*) AS n FROM e GROUP BY 1""",
    "audit_json": f"""WITH {PAIRS}, p AS (SELECT count(*) AS n, count(DISTINCT label_norm) AS labels FROM used GROUP BY resume_hash, jd_hash)
        SELECT CAST(json_object('conflicting_pairs', count(*) FILTER (WHERE labels > 1), 'exact_duplicate_rows', CAST(sum(n - labels) AS BIGINT), 'repeated_pair_rows', CAST(sum(n - 1) AS BIGINT), 'total_rows', (SELECT count(*) FROM rows_), 'unique_jds', (SELECT count(DISTINCT jd_hash) FROM used),
          'unique_pairs', count(*), 'unique_resumes', (SELECT count(DISTINCT resume_hash) FROM used), 'usable_rows', (SELECT count(*) FROM used)) AS VARCHAR) AS report FROM p""",
    "flattened_pages": f"WITH {APPS} SELECT application_key, company, title AS job_title, source AS job_source, status, CAST(applied AS VARCHAR) AS application_date, o_orderkey % 2 = 0 AS referral FROM apps",
    "flattened_scores": """WITH r AS (SELECT l_orderkey AS run_id, 2 * avg(l_quantity) AS score FROM lineitem GROUP BY 1) SELECT CASE WHEN score >= 75 THEN 'Strong' WHEN score >= 55 THEN 'Moderate' ELSE 'Weak' END AS band,
        CAST(CASE WHEN run_id % 3 = 0 THEN 0 ELSE 2 END AS INTEGER) AS n_terms, CAST(0 AS INTEGER) AS n_categories, count(*) AS n, CAST(0 AS BIGINT) AS n_labels FROM r GROUP BY 1, 2""",
    "score_result_errors": """WITH r AS (SELECT l_orderkey AS k, 2 * avg(l_quantity) AS score FROM lineitem GROUP BY 1), e AS (SELECT concat_ws('|', CASE WHEN k % 17 = 0 THEN 'application_key is required' END, CASE WHEN k % 13 = 0 THEN 'score must be a number' END,
        CASE WHEN k % 13 <> 0 AND k % 11 = 0 AND score >= 55 THEN 'band doesn''t fit the score' END, CASE WHEN k % 7 = 0 THEN 'matched_terms must be an array' END, CASE WHEN k % 5 = 0 THEN 'a category must be between 0 and 100' END) AS errors, CASE WHEN k % 7 <> 0 THEN 'a,B,b' END AS terms FROM r)
        SELECT errors, terms, count(*) AS n FROM e GROUP BY 1, 2""",
    "event_stream_outcomes": """WITH l AS (SELECT user_id AS stream, event_id AS pos, CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' WHEN 'view' THEN 'progress' END AS kind FROM events),
        k AS (SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY stream ORDER BY pos) AS event FROM l), f AS (SELECT stream, arg_min(event, pos) AS event, arg_min(CAST(pos AS VARCHAR), pos) AS data FROM k WHERE kind IS NULL AND event IN ('complete', 'error') GROUP BY 1)
        SELECT s.stream, coalesce(f.event, 'unfinished') AS outcome, f.data FROM (SELECT DISTINCT stream FROM l) s LEFT JOIN f ON f.stream = s.stream""",
    "text_chunks": "SELECT doc_id, CAST(ceil(coalesce(length(text), 0) / 2000.0) AS INTEGER) AS n_chunks, sha256(coalesce(text, '')) AS sha FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[\\x{10000}-\\x{10FFFF}]')",
    "cleaned_lines": f"""WITH l AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split('x' || chr(10) || '  ' || chr(10) || coalesce(text, ''), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^{BLANK}', ''), '{BLANK}$', '')), lambda x: x <> ''), chr(10)) AS t FROM documents)
        SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, sha256(t) AS sha FROM l""",
    "normal_titles": "SELECT page_id, 'Engineer ' || page_id || CASE WHEN page_id % 2 = 0 THEN '' ELSE ' | Acme | x' END AS title FROM pages",
    "settings_urls": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://www.linkedin.com/in/' || page_id WHEN 1 THEN '' WHEN 2 THEN 'http://github.com.example.org/' ELSE 'https://gist.github.com/x' END AS url, page_id % 4 < 2 AS linkedin, page_id % 2 = 1 AS github FROM pages",
    "decision_texts": f"""WITH s AS (SELECT doc_id, 0.3e0 * quality + 0.7e0 * ((doc_id * 7919) % 1000) / 1000e0 AS p FROM labels), t AS (SELECT *, floor(100 * p * 10 + 0.5) / 10 AS r FROM s)
        SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'Decision=' || CASE WHEN p >= 0.45 THEN 'Good Fit' ELSE 'No Fit' END || '|Good Fit probability=' || {_PERCENT("r")} || '|Decision threshold=45%' END AS shown FROM t""",
    "config_fingerprint": """SELECT sha256('{"a":{"x":"\\u00fc","y":null},"b":[1,2]}') AS fingerprint""",
    "filler_texts": "SELECT doc_id, left(repeat('Python and SQL. ', 7), CAST(doc_id % 100 AS INTEGER)) AS t FROM labels",
    "run_capacity": "SELECT event_id, CASE WHEN event_id % 10 = 0 OR value <= 0 THEN 0 ELSE CAST(floor(300.0e0 / value) AS BIGINT) END AS runs FROM events",
}
