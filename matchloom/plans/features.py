"""Queries on vectors, scores and metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators import information, projection
from matchloom.operators import metrics as m
from matchloom.operators import vectors as v
from matchloom.sources import bindings as b
from matchloom.sources import ragged
from matchloom.storage import fresh_path


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums of floats depend on their order; results are compared at fixed digits."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def _probs(spark: SparkSession, sf_dir: str, ties: bool = False) -> DataFrame:
    rows = b.probabilities(spark, sf_dir)
    return rows.withColumn("p", F.col("p2")) if ties else rows


def _rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities that are low for the few positives, so that predicting nobody positive is best."""
    hit = F.col("doc_id") % 50 == 0
    return _probs(spark, sf_dir).select("doc_id", hit.cast("int").alias("y"), F.when(hit, 0.5 * F.col("p")).otherwise(F.col("p")).alias("p"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = b.token_rows(spark, sf_dir)
    return b.token_pairs(spark, sf_dir), rows.where("grp % 2 = 0"), rows.where("grp % 2 = 1")


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.length("text").cast("double").alias("len"))
    return v.long(b.vectors(spark, sf_dir)).join(docs, "vec_id")


def _queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = b.vectors(spark, sf_dir)
    return rows.where("vec_id % 20 = 0"), rows


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors that have an id, as queries and as what they are compared with."""
    return b.vectors(spark, sf_dir).where("vec_id IS NOT NULL")


def _composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _identified(spark, sf_dir)
    return v.composition(v.neighbours(rows, rows, 10))


def _platt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.probabilities(spark, sf_dir)
    return rounded(m.calibrated(rows, *m.platt(rows)).select("doc_id", "probability"), "probability")


def _ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All token matrices, written to a ragged store and fetched again by the ranges of its index."""
    rows = b.token_rows(spark, sf_dir).select(F.sha2(F.col("grp").cast("string"), 256).alias("document_hash"), "pos", "vec")
    width = rows.agg(F.max(F.size("vec"))).first()[0] or 1
    path = fresh_path(spark, "token-store")
    index = ragged.write_store(rows, path, width, "<f4", block_rows=128)
    total = index.agg(F.sum("token_count")).first()[0] or 0
    found = ragged.fetch(path, ragged.checked(index, total), width, "<f4", block_rows=128)
    return found.select("document_hash", "pos", F.posexplode(F.col("vec").cast("array<double>")).alias("dim", "value"))


#: Leading coordinates that are judged as a projection, and neighbours that are looked at.
LEADING, NEAR = 16, 5


def _leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, rows = _queries(spark, sf_dir)
    cut = lambda t: t.withColumn("vec", F.slice("vec", 1, LEADING))
    return rounded(projection.trustworthiness(queries, rows, cut(queries), cut(rows), NEAR), "trustworthiness")


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the strongest components show the neighbours of the vectors, and how much of their variance they have."""
    rows = _identified(spark, sf_dir)
    fit = projection.principal(rows, LEADING)
    shown = projection.projected(rows, fit)
    found = projection.trustworthiness(rows, rows, shown, shown, NEAR)
    return rounded(found.withColumn("share", F.lit(float(fit.shares.sum()))), "trustworthiness", "share")


QUERIES = {
    "chunk_spans": lambda s, d: v.chunk_spans(b.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("n")), 500, 50),
    "mean_pool_embeddings": lambda s, d: rounded(v.mean_pool(b.vectors(s, d).select(F.floor(F.col("vec_id") / 4).alias("id"), "vec")), "value"),
    "pair_delta": lambda s, d: rounded(v.pair_delta(b.vector_pairs(s, d), b.vectors(s, d)).select(F.col("l").alias("vec_id"), F.posexplode("vec").alias("dim", "delta")), "delta"),
    "embedding_checks": lambda s, d: b.vectors(s, d).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("vec_id").alias("n_ids"), F.min(F.size("vec")).alias("least_size"), F.max(F.size("vec")).alias("most_size"), F.count_if(F.abs(v.norm(F.col("vec")) - 1) > 1e-5).alias("not_unit"), F.count_if(F.exists("vec", lambda x: F.isnan(x) | F.abs(x).eqNullSafe(F.lit(float("inf"))) | x.isNull())).alias("not_finite")
    ),
    "knrm_features": lambda s, d: rounded(v.knrm(*_sides(s, d)), "value"),
    "knrm_row_distribution": lambda s, d: rounded(v.row_distribution(*_sides(s, d)), "value"),
    "class_weights": lambda s, d: m.class_weights(b.vectors(s, d), "label"),
    "standardised_features": lambda s, d: rounded(v.standardised(b.vectors(s, d), F.col("vec_id") % 5 != 0), "z"),
    "eta_squared": lambda s, d: rounded(v.eta_squared(b.vectors(s, d)), "eta2"),
    "feature_correlation": lambda s, d: rounded(v.moments(b.vectors(s, d)), "r"),
    "effective_dimension": lambda s, d: rounded(v.effective_dimension(b.vectors(s, d)), "effective_dimension"),
    "spearman_length": lambda s, d: rounded(v.spearman(b.vectors(s, d).join(b.table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), F.length("text").alias("len")), "vec_id"), F.col("len")), "rho"),
    "length_residuals": lambda s, d: rounded(v.length_residuals(_lengths(s, d)), "residual"),
    "roc_auc": lambda s, d: rounded(m.roc_auc(_probs(s, d)), "roc_auc", digits=9),
    "roc_auc_ties": lambda s, d: rounded(m.roc_auc(_probs(s, d, True)), "roc_auc", digits=9),
    "average_precision": lambda s, d: rounded(m.average_precision(_probs(s, d, True)), "average_precision", digits=9),
    "brier_logloss": lambda s, d: rounded(m.brier_logloss(_probs(s, d)), "brier", "log_loss", digits=9),
    "calibration_bins": lambda s, d: rounded(m.calibration_bins(_probs(s, d)), "mean_p", "share", digits=9),
    "ece": lambda s, d: rounded(m.expected_calibration_error(_probs(s, d)), "ece", digits=9),
    "threshold_selection": lambda s, d: rounded(m.threshold(_probs(s, d)), "threshold", "macro_f1", digits=9),
    "threshold_nobody": lambda s, d: rounded(m.threshold(_rare(s, d)), "threshold", "macro_f1", digits=9),
    "classification_report": lambda s, d: rounded(m.report(_probs(s, d), 0.5), "precision", "recall", "f1", "accuracy", "macro_f1", digits=9),
    "platt_scores": _platt,
    "knn_purity": lambda s, d: m_round(v.purity(v.neighbours(*_queries(s, d), 11).where("rank BETWEEN 2 AND 11"))),
    "neighbor_composition": _composition,
    "cosine_separation": lambda s, d: rounded(v.cosine_separation(b.vectors(s, d)), "intra", "inter", "separation"),
    "neighbour_mutual_information": lambda s, d: rounded(information.neighbour_information(v.long(b.vectors(s, d))), "information"),
    "ragged_store": _ragged,
    "trustworthiness_leading": _leading,
    "trustworthiness_components": _components,
    "silhouette": lambda s, d: rounded(v.silhouette(*_queries(s, d)), "silhouette"),
}


def m_round(df: DataFrame) -> DataFrame:
    return rounded(df, "purity")


_V = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings), e AS (SELECT vec_id, label, unnest(vec) AS x, unnest(range(len(vec))) AS dim FROM v)"
_P = "s AS (SELECT doc_id, quality AS y, 0.3e0 * quality + 0.7e0 * ((doc_id * 7919) % 1000) / 1000e0 AS p0 FROM labels)"
_PLAIN = f"WITH {_P}, p AS (SELECT doc_id, y, p0 AS p FROM s)"
_TIES = f"WITH {_P}, p AS (SELECT doc_id, y, floor(p0 * 100 + 0.5) / 100 AS p FROM s)"
_AUC = " SELECT round(sum(CASE WHEN a.p > b.p THEN 1e0 WHEN a.p = b.p THEN 0.5e0 ELSE 0e0 END) / count(*), 9) AS roc_auc FROM p a, p b WHERE a.y = 1 AND b.y = 0"
_EDGES = ", ".join(repr(x) + "e0" for x in m.EDGES)
_BINS = f", q AS (SELECT *, len(list_filter([{_EDGES}], lambda e: e <= p)) AS bin FROM p)"
_KERNELS = "k(kernel, mu, w) AS (VALUES " + ", ".join(f"({i}, {mu!r}e0, {w!r}e0)" for i, (mu, w) in enumerate(v.kernels())) + ")"
_TOKENS = f"""WITH {_V}, {_KERNELS}, t AS (SELECT vec_id // 16 * 4 + CASE WHEN vec_id % 16 >= 15 THEN 3 WHEN vec_id % 16 >= 8 THEN 2 WHEN vec_id % 16 >= 5 THEN 1 ELSE 0 END AS grp,
      vec_id % 16 - CASE WHEN vec_id % 16 >= 15 THEN 15 WHEN vec_id % 16 >= 8 THEN 8 WHEN vec_id % 16 >= 5 THEN 5 ELSE 0 END AS pos, vec FROM v),
    d AS (SELECT a.grp AS l, b.grp AS r, b.pos, list_dot_product(a.vec, b.vec) AS sim FROM t a JOIN t b ON b.grp IN (a.grp + 1, a.grp + 3) WHERE a.grp % 2 = 0),
    c AS (SELECT l, r, pos, kernel, sum(exp(-((sim - mu) * (sim - mu)) / (2 * w * w))) AS soft, count(*) AS n FROM d, k GROUP BY ALL)"""
_KNN = f"""WITH {_V}, d AS (SELECT a.vec_id AS q, a.label AS q_label, b.vec_id, b.label, list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, vec_id) AS rank FROM d)"""
_KNN_ALL = _KNN.replace(" WHERE a.vec_id % 20 = 0", "")

_THRESHOLD = """{probs}, t AS (SELECT DISTINCT p AS threshold FROM p UNION SELECT nextafter(max(p), CAST('inf' AS DOUBLE)) FROM p),
        c AS (SELECT threshold, sum(CASE WHEN p >= threshold AND y = 1 THEN 1e0 ELSE 0 END) AS tp, sum(CASE WHEN p >= threshold AND y = 0 THEN 1e0 ELSE 0 END) AS fp,
          sum(CASE WHEN p < threshold AND y = 1 THEN 1e0 ELSE 0 END) AS fn, sum(CASE WHEN p < threshold AND y = 0 THEN 1e0 ELSE 0 END) AS tn FROM t, p GROUP BY 1),
        f AS (SELECT threshold, (2 * tp / (2 * tp + fp + fn) + CASE WHEN tn + fn + fp > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END) / 2 AS macro_f1 FROM c)
        SELECT round(threshold, 9) AS threshold, round(macro_f1, 9) AS macro_f1 FROM f ORDER BY f.macro_f1 DESC, f.threshold LIMIT 1"""

ORACLES = {
    "chunk_spans": """WITH n AS (SELECT doc_id AS id, length(text) AS n FROM documents WHERE length(text) > 0), c AS (SELECT id, n, unnest(range(CAST(greatest(0, ceil((n - 500) / 450.0)) AS BIGINT) + 1)) AS chunk FROM n)
        SELECT id, CAST(chunk AS INTEGER) AS chunk, CAST(chunk * 450 AS INTEGER) AS start, CAST(least(chunk * 450 + 500, n) AS INTEGER) AS stop FROM c""",
    "mean_pool_embeddings": f"""WITH {_V}, a AS (SELECT vec_id // 4 AS id, dim, avg(x) AS m FROM e GROUP BY 1, 2)
        SELECT id, CAST(dim AS INTEGER) AS dim, round(m / sqrt(sum(m * m) OVER (PARTITION BY id)), 6) + 0e0 AS value FROM a""",
    "pair_delta": f"WITH {_V} SELECT a.vec_id, CAST(a.dim AS INTEGER) AS dim, round(a.x - b.x, 6) + 0e0 AS delta FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 AND a.dim = b.dim",
    "embedding_checks": f"""WITH {_V} SELECT count(*) AS n, count(DISTINCT vec_id) AS n_ids, CAST(min(len(vec)) AS INTEGER) AS least_size, CAST(max(len(vec)) AS INTEGER) AS most_size,
        count(*) FILTER (WHERE abs(sqrt(list_dot_product(vec, vec)) - 1) > 1e-5) AS not_unit, count(*) FILTER (WHERE len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) > 0) AS not_finite FROM v""",
    "knrm_features": f"{_TOKENS} SELECT l, r, CAST(kernel AS INTEGER) AS kernel, round(sum(ln(greatest(soft, 1e-10))) * 0.01e0, 6) + 0e0 AS value FROM c GROUP BY 1, 2, 3",
    "knrm_row_distribution": f"""{_TOKENS}, x AS (SELECT l, r, kernel, ln(greatest(soft / n, 1e-10)) * 0.01e0 AS x FROM c),
        g AS (SELECT l, r, kernel, [avg(x), stddev_pop(x), min(x), quantile_cont(x, 0.25), quantile_cont(x, 0.5), quantile_cont(x, 0.75), max(x)] AS q FROM x GROUP BY 1, 2, 3)
        SELECT l, r, CAST(kernel * 7 + unnest(range(7)) AS INTEGER) AS feature, round(unnest(q), 6) + 0e0 AS value FROM g""",
    "class_weights": "WITH c AS (SELECT label AS class, count(*) AS n FROM embeddings GROUP BY 1) SELECT class, n, CAST((SELECT sum(n) FROM c) AS DOUBLE) / ((SELECT count(*) FROM c) * n) AS weight FROM c",
    "standardised_features": f"""WITH {_V}, t AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM e WHERE vec_id % 5 <> 0 GROUP BY 1)
        SELECT vec_id, CAST(e.dim AS INTEGER) AS dim, round((x - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) + 0e0 AS z FROM e JOIN t ON e.dim = t.dim""",
    "eta_squared": f"""WITH {_V}, g AS (SELECT *, avg(x) OVER (PARTITION BY dim) AS gm, avg(x) OVER (PARTITION BY dim, label) AS cm FROM e)
        SELECT CAST(dim AS INTEGER) AS dim, round(sum((cm - gm) * (cm - gm)) / sum((x - gm) * (x - gm)), 6) + 0e0 AS eta2 FROM g GROUP BY 1""",
    "feature_correlation": f"WITH {_V} SELECT CAST(a.dim AS INTEGER) AS i, CAST(b.dim AS INTEGER) AS j, round(corr(a.x, b.x), 6) + 0e0 AS r FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.dim <= b.dim GROUP BY 1, 2",
    "effective_dimension": f"""WITH {_V}, r AS (SELECT a.dim AS i, b.dim AS j, corr(a.x, b.x) AS r FROM e a JOIN e b ON a.vec_id = b.vec_id GROUP BY 1, 2)
        SELECT round(power(count(DISTINCT i), 2) / sum(r * r), 6) + 0e0 AS effective_dimension FROM r""",
    "spearman_length": f"""WITH {_V}, j AS (SELECT dim, x, length(text) AS o FROM e JOIN documents ON doc_id = vec_id),
        k AS (SELECT dim, rank() OVER (PARTITION BY dim ORDER BY x) + (count(*) OVER (PARTITION BY dim, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY dim ORDER BY o) + (count(*) OVER (PARTITION BY dim, o) - 1) / 2.0 AS ro FROM j)
        SELECT CAST(dim AS INTEGER) AS dim, round(corr(rx, ro), 6) + 0e0 AS rho FROM k GROUP BY 1""",
    "length_residuals": f"""WITH {_V}, j AS (SELECT vec_id, dim, x, CAST(length(text) AS DOUBLE) AS n FROM e JOIN documents ON doc_id = vec_id),
        f AS (SELECT dim, regr_slope(x, n) AS s, regr_intercept(x, n) AS c FROM j GROUP BY 1)
        SELECT vec_id, CAST(j.dim AS INTEGER) AS dim, round(x - (s * n + c), 6) + 0e0 AS residual FROM j JOIN f ON j.dim = f.dim""",
    "roc_auc": _PLAIN + _AUC,
    "roc_auc_ties": _TIES + _AUC,
    "average_precision": _TIES + """, u AS (SELECT p, sum(y) AS pos FROM p GROUP BY 1), c AS (SELECT u.pos, (SELECT sum(y) FROM p WHERE p.p >= u.p) AS tp, (SELECT count(*) FROM p WHERE p.p >= u.p) AS n FROM u)
        SELECT round(sum(pos * CAST(tp AS DOUBLE) / n) / (SELECT sum(y) FROM p), 9) AS average_precision FROM c""",
    "brier_logloss": _PLAIN + """ SELECT round(avg((p - y) * (p - y)), 9) AS brier, round(avg(-CASE WHEN y = 1 THEN ln(greatest(1e-15, least(1 - 1e-15, p))) ELSE ln(1 - greatest(1e-15, least(1 - 1e-15, p))) END), 9) AS log_loss FROM p""",
    "calibration_bins": _PLAIN + _BINS + " SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(y), 9) AS share FROM q GROUP BY 1",
    "ece": _PLAIN + _BINS + ", c AS (SELECT count(*) AS n, avg(p) AS mp, avg(y) AS s FROM q GROUP BY bin) SELECT round(sum(n * abs(mp - s)) / sum(n), 9) AS ece FROM c",
    "threshold_selection": _THRESHOLD.format(probs=_PLAIN),
    "threshold_nobody": _THRESHOLD.format(probs=f"WITH {_P}, p AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 1 ELSE 0 END AS y, CASE WHEN doc_id % 50 = 0 THEN 0.5e0 * p0 ELSE p0 END AS p FROM s)"),
    "platt_scores": f"""WITH RECURSIVE {_P}, p AS (SELECT doc_id, y, greatest(1e-6, least(1 - 1e-6, p0)) AS c FROM s), m AS (SELECT doc_id, CAST(y AS DOUBLE) AS y, ln(c / (1 - c)) AS m FROM p),
        it(n, a, b) AS (SELECT 0, 0e0, 0e0 UNION ALL SELECT n + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
          SELECT n, a, b, sum((q - y) * m) + 1e-6 * a AS ga, sum(q - y) AS gb, sum(q * (1 - q) * m * m) + 1e-6 AS haa, sum(q * (1 - q) * m) AS hab, sum(q * (1 - q)) AS hbb
          FROM (SELECT it.n, it.a, it.b, y, m, 1 / (1 + exp(-(it.a * m + it.b))) AS q FROM it, m WHERE it.n < 25) GROUP BY n, a, b))
        SELECT doc_id, round(1 / (1 + exp(-(a * m + b))), 6) + 0e0 AS probability FROM m, it WHERE n = 25""",
    "classification_report": _PLAIN + """, h AS (SELECT y, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS h FROM p), k AS (SELECT unnest([0, 1]) AS class),
        c AS (SELECT class, sum(CASE WHEN y = class AND h = class THEN 1e0 ELSE 0 END) AS tp, sum(CASE WHEN y <> class AND h = class THEN 1e0 ELSE 0 END) AS fp, sum(CASE WHEN y = class AND h <> class THEN 1e0 ELSE 0 END) AS fn,
              sum(CASE WHEN y = h THEN 1e0 ELSE 0 END) / count(*) AS accuracy FROM k, h GROUP BY class)
        SELECT class, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, CAST(tp + fn AS BIGINT) AS support, round(accuracy, 9) AS accuracy,
               round(avg(2 * tp / (2 * tp + fp + fn)) OVER (), 9) AS macro_f1 FROM c""",
    "knn_purity": f"{_KNN}, s AS (SELECT q, q_label, avg(CASE WHEN label = q_label THEN 1e0 ELSE 0 END) AS share FROM n WHERE rank BETWEEN 2 AND 11 GROUP BY 1, 2) SELECT q_label, count(*) AS n_queries, round(avg(share), 6) + 0e0 AS purity FROM s GROUP BY 1",
    "neighbor_composition": f"{_KNN_ALL} SELECT q_label, label, count(*) AS n FROM n WHERE rank <= 10 GROUP BY 1, 2",
    "cosine_separation": f"""WITH {_V}, d AS (SELECT a.label = b.label AS same, list_dot_product(a.vec, b.vec) AS c FROM v a JOIN v b ON a.vec_id < b.vec_id)
        SELECT round(avg(c) FILTER (WHERE same), 6) + 0e0 AS intra, round(avg(c) FILTER (WHERE NOT same), 6) + 0e0 AS inter, round(avg(c) FILTER (WHERE same) - avg(c) FILTER (WHERE NOT same), 6) + 0e0 AS separation FROM d""",
    "silhouette": f"""{_KNN}, g AS (SELECT q, q_label, label, avg(sqrt(d2)) AS m FROM d GROUP BY ALL), s AS (SELECT q, max(m) FILTER (WHERE label = q_label) AS a, min(m) FILTER (WHERE label <> q_label) AS b FROM g GROUP BY q)
        SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) + 0e0 AS silhouette FROM s""",
    "neighbour_mutual_information": f"""WITH {_V}, d AS (SELECT a.dim, a.vec_id, a.x, abs(b.x - a.x) AS gap, row_number() OVER (PARTITION BY a.dim, a.vec_id ORDER BY abs(b.x - a.x)) AS place, count(*) OVER (PARTITION BY a.dim, a.vec_id) AS others
          FROM e a JOIN e b ON a.dim = b.dim AND a.label = b.label AND a.vec_id <> b.vec_id),
        r AS (SELECT dim, vec_id, x, gap AS radius, least(3, others) AS near, others + 1 AS size FROM d WHERE place = least(3, others)),
        c AS (SELECT r.dim, r.vec_id, r.near, r.size, count(*) AS m FROM r JOIN r o ON o.dim = r.dim AND (abs(o.x - r.x) < r.radius OR o.x = r.x) GROUP BY ALL),
        p AS (SELECT i + 1 AS n, -0.5772156649015329e0 + sum(CASE WHEN i > 0 THEN 1e0 / i ELSE 0e0 END) OVER (ORDER BY i) AS psi FROM range((SELECT count(*) FROM embeddings)) t(i)),
        g AS (SELECT dim, count(*) AS rows_of, avg(a.psi) - avg(b.psi) - avg(q.psi) AS s FROM c JOIN p a ON a.n = near JOIN p b ON b.n = size JOIN p q ON q.n = m GROUP BY dim)
        SELECT CAST(dim AS INTEGER) AS dim, round(greatest(0e0, s + psi), 6) + 0e0 AS information FROM g JOIN p ON n = rows_of""",
    "ragged_store": _TOKENS.split(", t AS")[0] + ", t AS" + _TOKENS.split(", t AS")[1].split(",\n    d AS")[0] + """
        SELECT sha256(CAST(grp AS VARCHAR)) AS document_hash, pos, CAST(unnest(range(len(vec))) AS INTEGER) AS dim, unnest(vec) AS value FROM t""",
    "trustworthiness_leading": f"""{_KNN}, s AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY near, vec_id) AS place FROM (
          SELECT n.*, list_sum(list_transform(range(1, {LEADING + 1}), lambda i: (a.vec[i] - b.vec[i]) * (a.vec[i] - b.vec[i]))) AS near FROM n JOIN v a ON a.vec_id = n.q JOIN v b ON b.vec_id = n.vec_id))
        SELECT count(DISTINCT q) AS n_queries, round(1 - 2e0 * sum(greatest(0, rank - {NEAR})) / (count(DISTINCT q) * {NEAR} * (2 * (SELECT count(*) FROM embeddings) - 3 * {NEAR} - 1)), 6) + 0e0 AS trustworthiness FROM s WHERE place <= {NEAR}""",
}
