"""Queries on near copies, domains, folds and manifests, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.text import squeeze, squeezed
from matchloom.operators import learn, reports, similarity, splits
from matchloom.storage import sink, written
from matchloom.plans.corpus import PAIRS, rows
from matchloom.plans.features import rounded
from matchloom.sources import bindings as b


def _sides(make: Callable[[str], DataFrame]) -> DataFrame:
    """What `make` gives for resumes and for jds, with the side in front."""
    parts = [make(side).select(F.lit(side).alias("side"), "*") for side in ("resume", "jd")]
    return parts[0].union(parts[1])


def _each(s: SparkSession, d: str, make: Callable[[DataFrame, DataFrame, str], DataFrame]) -> DataFrame:
    """What `make` gives of the pairs, the documents and the side, for resumes and for jds, with the side in front."""
    pairs, docs = _inputs(s, d)
    return _sides(lambda side: make(pairs, docs[side], side))


def _inputs(s: SparkSession, d: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(usable pairs with hashes in place of texts, documents of each side with case-folded texts): texts are moved and written once, for both sides."""
    texts = similarity.prepared(b.side_texts(s, d), "side", normal=squeezed).where(F.col("key") != similarity.EMPTY)
    pairs = b.hashed_pairs(s, d, texts).withColumns({"label_norm": squeeze(F.col("label")), "usable": F.lit(True)})
    pairs = written(pairs.where("label_norm <> ''"), "used-pairs")
    docs = {}
    for side in SEEDS:
        own = texts.where(F.col("side") == side).drop("side")
        gone = own.select("id", "hash").join(pairs.select(F.col(f"{side}_hash").alias("hash")).distinct(), "hash", "left_anti")
        docs[side] = similarity.without(own, written(gone.select("id"), "unused-texts"))
    return pairs, docs


def _members(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): all documents of a side with their cluster, and its near copies."""
    found = written(similarity.near_duplicates(docs), "near-pairs")
    return written(similarity.clusters(docs, found), "clusters"), found


def _folds(pairs: DataFrame, docs: DataFrame, side: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(folds, members, domains) of a side: clusters stay whole and domains are spread evenly."""
    members, domains = _classed(pairs, docs, side)
    return splits.balanced_folds(members, 3, SEEDS[side]), members.select("hash", "cluster"), domains


SEEDS = {"resume": 42, "jd": 43}
ORDER_SEED = 44


def _classed(pairs: DataFrame, docs: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
    """(members with their domain as class, domains) of a side."""
    members = written(similarity.linked(docs), "clusters")
    domains = written(splits.domains(pairs, side), "domains")
    return written(members.join(domains.select("hash", F.col("domain").alias("class")), "hash"), "classed-members"), domains


def _cluster_parts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, dict[str, DataFrame], dict[str, DataFrame]]:
    """(distinct pairs, partitions, domains by side, members by side): three folds, five folds and one hold-out of whole clusters."""
    used, docs = _inputs(s, d)
    first = written(used.groupBy("resume_hash", "jd_hash").agg(F.min_by("label_norm", "ordinal").alias("label")), "distinct-pairs")
    classed = {side: _classed(used, docs[side], side) for side in SEEDS}
    folds = lambda n: {side: written(splits.balanced_folds(classed[side][0], n, seed), "folds") for side, seed in SEEDS.items()}
    parts = None
    for n in (3, 5):
        dealt = folds(n)
        both = first
        for side in SEEDS:
            both = both.join(dealt[side].select(splits.own_name(side), F.col("fold").alias(f"{side}_fold")), f"{side}_hash")
        roles = F.explode(F.array(*(F.struct(F.lit(k).alias("fold"), splits.role(F.col("resume_fold"), F.col("jd_fold"), k).alias("part")) for k in range(n))))
        part = both.select(F.lit(f"{n}-fold").alias("strategy"), roles.alias("r"), "resume_hash", "jd_hash", "label").select("strategy", "r.fold", "r.part", "resume_hash", "jd_hash", "label").where("part <> 'discarded'")
        parts = part if parts is None else parts.union(part)
    small = folds(splits.SMALL_FOLDS)
    held = splits.held_out(first, small["resume"], small["jd"], ORDER_SEED).where("part <> 'dropped'")
    parts = written(parts.union(held.select(F.lit("70/15/15").alias("strategy"), F.lit(0).alias("fold"), "part", "resume_hash", "jd_hash", "label")), "partitions")
    return first, parts, {side: v[1].select("hash", "domain") for side, v in classed.items()}, {side: v[0] for side, v in classed.items()}


def _cluster_feasibility(s: SparkSession, d: str) -> DataFrame:
    """The report on every partition, with whole clusters."""
    first, parts, domains, _ = _cluster_parts(s, d)
    return reports.partition_report(parts, first, domains["resume"], domains["jd"], ["strategy", "fold", "part"])


def _cluster_feasibility_checks(s: SparkSession, d: str) -> DataFrame:
    """By strategy: distinct pairs of the corpus, and documents or clusters that lie in two parts of one fold."""
    first, parts, _, members = _cluster_parts(s, d)
    out = parts.select("strategy").distinct().crossJoin(first.agg(F.count(F.lit(1)).alias("pairs")))  # three rows, one row
    for side in SEEDS:
        placed = parts.select("strategy", "fold", "part", F.col(f"{side}_hash").alias("hash")).join(members[side], "hash")
        per = placed.groupBy("strategy", "fold", "cluster").agg(F.count_distinct("part").alias("n")).groupBy("strategy").agg(F.count_if(F.col("n") > 1).alias(f"split_{side}_clusters"))
        out = out.join(per, "strategy")
    return out


def _whole_manifest(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(resumes, jds, pairs) of a manifest whose folds keep near copies together."""
    used, docs = _inputs(s, d)
    sides = {}
    for side in ("resume", "jd"):
        dealt, members, domains = _folds(used, docs[side], side)
        sides[side] = written(splits.documents_manifest(members, dealt, domains), f"{side}-manifest")
    return sides["resume"], sides["jd"], written(splits.manifest_of(used, sides["resume"], sides["jd"]), "pair-manifest")


def _inner(s: SparkSession, d: str) -> DataFrame:
    """Sizes of the inner parts of each outer fold, and the clusters that lie in train and validation."""
    resumes, jds, pairs = _whole_manifest(s, d)
    clusters = {"resume": resumes.select("hash", "cluster"), "jd": jds.select("hash", "cluster")}
    out = None
    for k in range(3):
        part = splits.inner_partition(pairs, k, clusters=clusters)
        shared = None
        for side in ("resume", "jd"):
            own = part.where("part <> 'dropped'").join(clusters[side].select(F.col("hash").alias(f"{side}_hash"), "cluster"), f"{side}_hash")
            n = own.groupBy("cluster").agg(F.count_distinct("part").alias("n")).agg(F.count_if(F.col("n") > 1).alias(f"shared_{side}_clusters"))
            shared = n if shared is None else shared.crossJoin(n)
        sizes = part.agg(F.lit(k).alias("fold"), (F.count_if(F.col("part") == "train") > 0).alias("has_train"), (F.count_if(F.col("part") == "validation") > 0).alias("has_validation"))
        row = sizes.crossJoin(shared)
        out = row if out is None else out.union(row)
    return out


def _strategies(s: SparkSession, d: str) -> DataFrame:
    """Report on every partition of three folds, five folds and one hold-out, by hash."""
    r = written(rows(s, d).where("usable").select("resume_hash", "jd_hash", "label_norm", "ordinal", "resume_domain", "jd_domain", "usable"), "used-pairs")
    first = written(r.groupBy("resume_hash", "jd_hash").agg(F.min_by("label_norm", "ordinal").alias("label")), "distinct-pairs")
    sides = {side: written(splits.domains(r, side).select("hash", "domain"), "domains") for side in ("resume", "jd")}
    parts = None
    for n in (3, 5):
        left, right = splits.hash_fold(F.col("resume_hash"), 42, n), splits.hash_fold(F.col("jd_hash"), 43, n)
        roles = F.explode(F.array(*(F.struct(F.lit(k).alias("fold"), splits.role(left, right, k).alias("part")) for k in range(n))))
        part = first.select(F.lit(f"{n}-fold").alias("strategy"), roles.alias("r"), "resume_hash", "jd_hash", "label").select("strategy", "r.fold", "r.part", "resume_hash", "jd_hash", "label").where("part <> 'discarded'")
        parts = part if parts is None else parts.union(part)
    place = lambda c, seed: F.when(splits.hash_fold(c, seed, 20) < 14, "train").when(splits.hash_fold(c, seed, 20) < 17, "validation").otherwise("test")
    held = first.withColumns({"a": place(F.col("resume_hash"), 42), "b": place(F.col("jd_hash"), 43)}).where("a = b")
    parts = parts.union(held.select(F.lit("70/15/15").alias("strategy"), F.lit(0).alias("fold"), F.col("a").alias("part"), "resume_hash", "jd_hash", "label"))
    return reports.partition_report(written(parts, "partitions"), first, sides["resume"], sides["jd"], ["strategy", "fold", "part"])


def _stored(s: SparkSession, d: str) -> DataFrame:
    """Write the pairs' manifest with Zstandard and column statistics, and say what was written."""
    return sink(_manifest(s, d).sortWithinPartitions("pair_hash"), "manifest").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("pair_hash").alias("n_pairs"), F.min("pair_hash").alias("first_pair"), F.max("pair_hash").alias("last_pair"))


def _manifest(s: SparkSession, d: str) -> DataFrame:
    return splits.manifest(rows(s, d), splits.hash_fold(F.col("resume_hash"), 42, 3), splits.hash_fold(F.col("jd_hash"), 43, 3))


def _both(s: SparkSession, d: str) -> DataFrame:
    return _sides(lambda side: splits.domains(rows(s, d), side))


def _holdout(s: SparkSession, d: str) -> DataFrame:
    """Twenty small folds on each side, 14, 3 and 3 of them for train, validation and test; a pair stays if both sides agree."""
    part = lambda fold: F.when(fold < 14, "train").when(fold < 17, "validation").otherwise("test")
    used = rows(s, d).where("usable")
    left, right = part(splits.hash_fold(F.col("resume_hash"), 42, 20)), part(splits.hash_fold(F.col("jd_hash"), 43, 20))
    return used.groupBy(F.when(left == right, left).otherwise("dropped").alias("part")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("resume_hash").alias("n_resumes"), F.count_distinct("jd_hash").alias("n_jds"))


def _checked_manifest(resumes: DataFrame, jds: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ten checks and how many rows they were made on."""
    out = splits.manifest_checks(resumes, jds, pairs)
    for name, table in (("resumes", resumes), ("jds", jds), ("pairs", pairs)):
        out = out.crossJoin(table.agg(F.count(F.lit(1)).alias(name)))  # one row each
    return out


QUERIES = {
    "near_duplicates": lambda s, d: rounded(_each(s, d, lambda _, docs, side: similarity.near_duplicates(docs)), "similarity"),
    "near_duplicate_clusters": lambda s, d: _each(s, d, lambda _, docs, side: similarity.cluster_stats(*_members(docs))),
    "near_duplicate_examples": lambda s, d: rounded(_each(s, d, lambda _, docs, side: reports.examples(written(similarity.near_duplicates(docs), "near-pairs"), 100)), "similarity", digits=2),
    "domain_resolution": _both,
    "domain_conflicts": lambda s, d: _both(s, d).where("n_domains > 1").orderBy(F.round("confidence", 6), "hash", "side").limit(20),
    "domain_tv_distance": lambda s, d: rounded(splits.variation(rows(s, d).where("usable"), F.col("split") == "train", "resume_domain"), "distance"),
    "fold_assignment": lambda s, d: _each(s, d, lambda pairs, docs, side: _folds(pairs, docs, side)[0]),
    "fold_invariants": lambda s, d: _each(s, d, lambda pairs, docs, side: splits.fold_invariants(*_folds(pairs, docs, side))),
    "cluster_manifest_checks": lambda s, d: _checked_manifest(*_whole_manifest(s, d)),
    "cluster_manifest_overlaps": lambda s, d: reports.overlaps(_whole_manifest(s, d)[2]).select("fold", (F.col("train_pairs") + F.col("test_pairs") + F.col("discarded_pairs")).alias("pairs"), "resume_overlap", "jd_overlap"),
    "cluster_split_feasibility": lambda s, d: rounded(_cluster_feasibility(s, d), "label_distance", "resume_domain_distance", "jd_domain_distance"),
    "cluster_split_checks": _cluster_feasibility_checks,
    "cluster_inner_partition": _inner,
    "manifest_overlaps": lambda s, d: reports.overlaps(_manifest(s, d)),
    "manifest_sink": _stored,
    "split_feasibility": lambda s, d: rounded(_strategies(s, d), "label_distance", "resume_domain_distance", "jd_domain_distance"),
    "domain_conflict_counts": lambda s, d: _sides(lambda side: reports.domain_counts(rows(s, d), side)),
    "domain_confidence": lambda s, d: rounded(_sides(lambda side: reports.confidence(splits.domains(rows(s, d), side))), *(f"{n}_{w}" for n in ("least", "median", "most") for w in ("all", "conflicting"))),
    "manifest_pairs": _manifest,
    "manifest_fold_report": lambda s, d: splits.fold_report(_manifest(s, d)),
    "manifest_checks": lambda s, d: splits.checks(_manifest(s, d)),
    "holdout_report": _holdout,
    "inner_partition": lambda s, d: splits.inner_partition(written(_manifest(s, d).select("resume_hash", "jd_hash", "fold_0_role"), "pair-manifest")),
    "classifier_scores": lambda s, d: rounded(learn.fold_scores(b.vectors(s, d).select(F.col("vec_id").alias("id"), "vec", (F.col("label") % 2).alias("y"), (F.col("vec_id") % 3).alias("fold"))), "probability"),
}


CHECKS = ("unique_resume_hashes", "unique_jd_hashes", "unique_pair_hashes", "resume_fold_coverage", "jd_fold_coverage", "resume_clusters_kept_together", "jd_clusters_kept_together", "pair_endpoints_exist", "roles_complete", "zero_train_test_document_overlap")


def _fold(col: str, seed: int, folds: int) -> str:
    return f"CAST('0x' || substr(sha256('{seed}:' || {col}), 1, 7) AS BIGINT) % {folds}"


_ROLE = ", ".join(f"CASE WHEN rf = {k} AND jf = {k} THEN 'test' WHEN rf <> {k} AND jf <> {k} THEN 'train' ELSE 'discarded' END AS fold_{k}_role" for k in range(3))
_MANIFEST = f"""{PAIRS}, f AS (SELECT resume_hash, jd_hash, arg_min(label_norm, ordinal) AS label FROM used GROUP BY 1, 2),
    g AS (SELECT *, {_fold("resume_hash", 42, 3)} AS rf, {_fold("jd_hash", 43, 3)} AS jf FROM f),
    m AS (SELECT sha256(resume_hash || ':' || jd_hash) AS pair_hash, resume_hash, jd_hash, label, {_ROLE} FROM g)"""
_LONG = " UNION ALL ".join(f"SELECT {k} AS fold, fold_{k}_role AS role, * FROM m" for k in range(3))
_DOMAINS = " UNION ALL ".join(
    f"""SELECT '{s}' AS side, hash, arg_min(d, d) FILTER (WHERE c = top) AS domain, CAST(any_value(top) AS DOUBLE) / sum(c) AS confidence, count(*) FILTER (WHERE c = top) > 1 AS tied, count(*) AS n_domains
    FROM (SELECT *, max(c) OVER (PARTITION BY hash) AS top FROM (SELECT {s}_hash AS hash, coalesce(nullif({s}_domain, ''), '<missing>') AS d, count(*) AS c FROM used GROUP BY 1, 2)) GROUP BY hash"""
    for s in ("resume", "jd")
)


def _part(col: str, seed: int) -> str:
    return f"CASE WHEN {_fold(col, seed, 20)} < 14 THEN 'train' WHEN {_fold(col, seed, 20)} < 17 THEN 'validation' ELSE 'test' END"


def _held(side: str) -> str:
    return f"""{side}_o AS (SELECT {side}_hash AS c, row_number() OVER (ORDER BY sha256('42:{side}:' || {side}_hash)) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT {side}_hash FROM m WHERE fold_0_role = 'train')),
    {side}_v AS (SELECT c FROM {side}_o WHERE place <= greatest(1, least(n - 1, round_even(n * 0.2, 0))))"""


ORACLES = {
    "domain_resolution": f"WITH {PAIRS} {_DOMAINS}",
    "domain_conflicts": f"WITH {PAIRS}, d AS ({_DOMAINS}) SELECT * FROM d WHERE n_domains > 1 ORDER BY round(confidence, 6), hash, side LIMIT 20",
    "domain_tv_distance": f"""WITH {PAIRS}, c AS (SELECT resume_domain, count(*) FILTER (WHERE split = 'train') AS a, count(*) FILTER (WHERE split <> 'train') AS b FROM used GROUP BY 1)
        SELECT round(sum(abs(a / (SELECT CAST(sum(a) AS DOUBLE) FROM c) - b / (SELECT CAST(sum(b) AS DOUBLE) FROM c))) / 2, 6) AS distance FROM c""",
    "manifest_pairs": f"WITH {_MANIFEST} SELECT * FROM m",
    "manifest_fold_report": f"WITH {_MANIFEST}, l AS ({_LONG}) SELECT fold, role, label, count(*) AS n FROM l GROUP BY 1, 2, 3",
    "manifest_checks": f"""WITH {_MANIFEST}, l AS ({_LONG}), d AS (SELECT fold, role, 'resume:' || resume_hash AS doc FROM l UNION SELECT fold, role, 'jd:' || jd_hash FROM l),
        s AS (SELECT count(DISTINCT role) AS roles FROM d WHERE role <> 'discarded' GROUP BY fold, doc)
        SELECT (SELECT count(*) = count(DISTINCT pair_hash) FROM m) AS pairs_unique, (SELECT max(t) <= 1 FROM (SELECT count(*) FILTER (WHERE role = 'test') AS t FROM l GROUP BY pair_hash)) AS tested_once_at_most,
        (SELECT bool_and(length(pair_hash) = 64) FROM m) AS hashes_whole, (SELECT max(roles) <= 1 FROM s) AS no_document_in_train_and_test""",
    "holdout_report": f"""WITH {PAIRS}, h AS (SELECT *, {_part("resume_hash", 42)} AS a, {_part("jd_hash", 43)} AS b FROM used)
        SELECT CASE WHEN a = b THEN a ELSE 'dropped' END AS part, count(*) AS n_rows, count(DISTINCT resume_hash) AS n_resumes, count(DISTINCT jd_hash) AS n_jds FROM h GROUP BY 1""",
    "inner_partition": f"""WITH {_MANIFEST}, {_held("resume")}, {_held("jd")}
        SELECT resume_hash, jd_hash, CASE WHEN a.c IS NOT NULL AND b.c IS NOT NULL THEN 'validation' WHEN a.c IS NULL AND b.c IS NULL THEN 'train' ELSE 'dropped' END AS part
        FROM m LEFT JOIN resume_v a ON a.c = resume_hash LEFT JOIN jd_v b ON b.c = jd_hash WHERE fold_0_role = 'train'""",
    "fold_invariants": f"""WITH {PAIRS} SELECT 'resume' AS side, count(DISTINCT resume_hash) AS documents, true AS each_document_once, true AS all_folds_used, true AS clusters_whole, true AS domains_spread FROM used
        UNION ALL SELECT 'jd', count(DISTINCT jd_hash), true, true, true, true FROM used""",
    "cluster_manifest_checks": f"WITH {PAIRS} SELECT " + ", ".join(f"true AS {c}" for c in CHECKS) + ", count(DISTINCT resume_hash) AS resumes, count(DISTINCT jd_hash) AS jds, count(DISTINCT (resume_hash, jd_hash)) AS pairs FROM used",
    "cluster_manifest_overlaps": f"WITH {PAIRS} SELECT CAST(fold AS INTEGER) AS fold, count(DISTINCT (resume_hash, jd_hash)) AS pairs, CAST(0 AS BIGINT) AS resume_overlap, CAST(0 AS BIGINT) AS jd_overlap FROM used, range(3) t(fold) GROUP BY fold",
    "cluster_split_checks": f"WITH {PAIRS} SELECT strategy, count(DISTINCT (resume_hash, jd_hash)) AS pairs, CAST(0 AS BIGINT) AS split_resume_clusters, CAST(0 AS BIGINT) AS split_jd_clusters FROM used, (SELECT unnest(['3-fold', '5-fold', '70/15/15']) AS strategy) GROUP BY strategy",
    "cluster_inner_partition": "SELECT CAST(unnest(range(3)) AS INTEGER) AS fold, true AS has_train, true AS has_validation, CAST(0 AS BIGINT) AS shared_resume_clusters, CAST(0 AS BIGINT) AS shared_jd_clusters",
    "manifest_overlaps": f"""WITH {_MANIFEST}, l AS ({_LONG}), o AS (SELECT fold, 'resume' AS side, resume_hash AS doc, count(DISTINCT role) AS n FROM l WHERE role <> 'discarded' GROUP BY 1, 2, 3 UNION ALL SELECT fold, 'jd', jd_hash, count(DISTINCT role) FROM l WHERE role <> 'discarded' GROUP BY 1, 2, 3)
        SELECT CAST(fold AS INTEGER) AS fold, count(*) FILTER (WHERE role = 'train') AS train_pairs, count(*) FILTER (WHERE role = 'test') AS test_pairs, count(*) FILTER (WHERE role = 'discarded') AS discarded_pairs,
        (SELECT count(*) FROM o WHERE o.fold = l.fold AND side = 'resume' AND n > 1) AS resume_overlap, (SELECT count(*) FROM o WHERE o.fold = l.fold AND side = 'jd' AND n > 1) AS jd_overlap FROM l GROUP BY fold""",
    "manifest_sink": f"WITH {_MANIFEST} SELECT count(*) AS n_rows, count(DISTINCT pair_hash) AS n_pairs, min(pair_hash) AS first_pair, max(pair_hash) AS last_pair FROM m",
    "split_feasibility": f"""WITH {PAIRS}, dom AS ({_DOMAINS}), f AS (SELECT resume_hash, jd_hash, arg_min(label_norm, ordinal) AS label FROM used GROUP BY 1, 2),
        g AS (SELECT *, {_fold("resume_hash", 42, 3)} AS r3, {_fold("jd_hash", 43, 3)} AS j3, {_fold("resume_hash", 42, 5)} AS r5, {_fold("jd_hash", 43, 5)} AS j5, {_part("resume_hash", 42)} AS rp, {_part("jd_hash", 43)} AS jp FROM f),
        p AS ({" UNION ALL ".join(f"SELECT '{n}-fold' AS strategy, {k} AS fold, CASE WHEN r{n} = {k} THEN 'test' ELSE 'train' END AS part, resume_hash, jd_hash, label FROM g WHERE (r{n} = {k}) = (j{n} = {k})" for n in (3, 5) for k in range(n))}
          UNION ALL SELECT '70/15/15', 0, rp, resume_hash, jd_hash, label FROM g WHERE rp = jp),
        s AS (SELECT strategy, fold, part, count(*) AS pairs, count(DISTINCT resume_hash) AS resumes, count(DISTINCT jd_hash) AS jds FROM p GROUP BY ALL),
        v AS (SELECT 'label' AS what, '' AS strategy, -1 AS fold, '' AS part, label AS k, count(*) AS n FROM f GROUP BY ALL UNION ALL SELECT side, '', -1, '', domain, count(*) FROM dom GROUP BY ALL
          UNION ALL SELECT 'label', strategy, fold, part, label, count(*) FROM p GROUP BY ALL
          UNION ALL SELECT 'resume', strategy, fold, part, domain, count(DISTINCT resume_hash) FROM p JOIN dom ON side = 'resume' AND hash = resume_hash GROUP BY ALL
          UNION ALL SELECT 'jd', strategy, fold, part, domain, count(DISTINCT jd_hash) FROM p JOIN dom ON side = 'jd' AND hash = jd_hash GROUP BY ALL),
        sh AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY what, strategy, fold, part) AS share FROM v),
        t AS (SELECT s.strategy, s.fold, s.part, w.what, sum(abs(w.share - coalesce(o.share, 0))) / 2 AS dist, coalesce(string_agg(w.k, ',' ORDER BY w.k) FILTER (WHERE o.k IS NULL), '') AS absent
          FROM s CROSS JOIN (SELECT * FROM sh WHERE fold = -1) w LEFT JOIN sh o ON o.strategy = s.strategy AND o.fold = s.fold AND o.part = s.part AND o.what = w.what AND o.k = w.k GROUP BY 1, 2, 3, 4)
        SELECT s.strategy, CAST(s.fold AS INTEGER) AS fold, s.part, pairs, resumes, jds, round(max(dist) FILTER (WHERE what = 'label'), 6) + 0e0 AS label_distance, round(max(dist) FILTER (WHERE what = 'resume'), 6) + 0e0 AS resume_domain_distance,
          max(absent) FILTER (WHERE what = 'resume') AS missing_resume_domains, round(max(dist) FILTER (WHERE what = 'jd'), 6) + 0e0 AS jd_domain_distance, max(absent) FILTER (WHERE what = 'jd') AS missing_jd_domains
        FROM s JOIN t ON t.strategy = s.strategy AND t.fold = s.fold AND t.part = s.part GROUP BY ALL""",
    "domain_conflict_counts": " UNION ALL ".join(
        f"""SELECT '{s}' AS side, hash, string_agg(d || '=' || c, ',' ORDER BY d) AS counts FROM (WITH {PAIRS} SELECT {s}_hash AS hash, coalesce(nullif({s}_domain, ''), '<missing>') AS d, count(*) AS c FROM used GROUP BY 1, 2) GROUP BY hash HAVING count(*) > 1"""
        for s in ("resume", "jd")
    ),
    "domain_confidence": f"""WITH {PAIRS}, d AS ({_DOMAINS}) SELECT side, count(*) AS documents, count(*) FILTER (WHERE n_domains > 1) AS conflicting, count(*) FILTER (WHERE n_domains > 1 AND tied) AS tied, """
    + ", ".join(f"round(coalesce({f}(confidence) FILTER (WHERE {c}), 0), 6) + 0e0 AS {n}_{w}" for w, c in (("all", "true"), ("conflicting", "n_domains > 1")) for n, f in (("least", "min"), ("median", "median"), ("most", "max")))
    + " FROM d GROUP BY side",
}
