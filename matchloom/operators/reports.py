"""Reports on corpora, splits, lengths and features, as tidy tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.text import CLASSES
from matchloom.operators import splits


def majority_baseline(rows: DataFrame) -> DataFrame:
    """The commonest label, and its share of all rows: what always guessing it would reach; ties to the first in order."""
    counts = rows.where("label_norm <> ''").groupBy("label_norm").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    best = counts.agg(F.max(F.struct("n")).alias("n"), F.min_by("label_norm", F.struct(-F.col("n"), F.col("label_norm"))).alias("label"))
    return best.crossJoin(total).select("label", F.col("n.n").alias("n"), F.try_divide(F.col("n.n"), F.col("total")).alias("share"))


def unexpected_labels(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("label_norm") != "") & ~F.col("label_norm").isin(*CLASSES)).groupBy(F.col("label_norm").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def label_counts(rows: DataFrame) -> DataFrame:
    """Rows of each known label, with zeros."""
    known = rows.sparkSession.createDataFrame([(k,) for k in CLASSES], "label string")
    counts = rows.groupBy(F.col("label_norm").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return known.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def domain_counts(rows: DataFrame, side: str) -> DataFrame:
    """(hash, counts) of documents with more than one domain, as "domain=n" in the order of domains."""
    name = F.coalesce(F.nullif(F.col(f"{side}_domain"), F.lit("")), F.lit(splits.MISSING))
    c = rows.where("usable").groupBy(F.col(f"{side}_hash").alias("hash"), name.alias("d")).agg(F.count(F.lit(1)).alias("c"))
    listed = c.groupBy("hash").agg(F.array_sort(F.collect_list(F.struct("d", "c"))).alias("all")).where("size(all) > 1")
    return listed.select("hash", F.array_join(F.transform("all", lambda x: F.concat(x["d"], F.lit("="), x["c"].cast("string"))), ",").alias("counts"))


def confidence(domains: DataFrame) -> DataFrame:
    """Documents, conflicts and ties, and the spread of confidence over all and over conflicting documents; zeros where there are none."""
    c, odd = F.col("confidence"), F.col("n_domains") > 1
    own = F.when(odd, c)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return domains.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(odd).alias("conflicting"),
        F.count_if(odd & F.col("tied")).alias("tied"),
        *(zero(f(x)).alias(f"{n}_{w}") for w, x in (("all", c), ("conflicting", own)) for n, f in (("least", F.min), ("median", F.median), ("most", F.max))),
    )


def _variation(parts: DataFrame, full: DataFrame, keys: list[str]) -> DataFrame:
    """Total variation of each part's counts (keys, k, n) from the whole's (k, n); 1 for an empty part."""
    sizes = parts.groupBy(*keys).agg(F.sum("n").alias("size"))
    whole = full.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).select("k", "share")
    grid = sizes.crossJoin(F.broadcast(whole))  # parts times values of a report, both few
    both = grid.join(parts.select(*keys, "k", "n"), [*keys, "k"], "left")
    return both.groupBy(*keys).agg((F.sum(F.abs(F.col("share") - F.coalesce(F.col("n") / F.col("size"), F.lit(0.0)))) / 2).alias("distance"), F.array_sort(F.collect_list(F.when(F.col("n").isNull(), F.col("k")))).alias("absent"))


def partition_report(pairs: DataFrame, whole_pairs: DataFrame, resumes: DataFrame, jds: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each partition (keys) of pairs (resume_hash, jd_hash, label): sizes, how far labels and domains are from the whole, and the domains that it lacks.

    `pairs` holds a row for each partition that a pair is in; `whole_pairs` are all pairs, `resumes` and `jds` (hash,
    domain) all documents.
    """
    out = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("resume_hash").alias("resumes"), F.count_distinct("jd_hash").alias("jds"))
    whole = whole_pairs.groupBy(F.col("label").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    labels = pairs.groupBy(*keys, F.col("label").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    out = out.join(_variation(labels, whole, keys).select(*keys, F.col("distance").alias("label_distance")), keys)
    for side, docs in (("resume", resumes), ("jd", jds)):
        all_docs = docs.groupBy(F.col("domain").alias("k")).agg(F.count(F.lit(1)).alias("n"))
        own = pairs.select(*keys, F.col(f"{side}_hash").alias("hash")).distinct().join(docs, "hash").groupBy(*keys, F.col("domain").alias("k")).agg(F.count(F.lit(1)).alias("n"))
        found = _variation(own, all_docs, keys).select(*keys, F.col("distance").alias(f"{side}_domain_distance"), F.array_join("absent", ",").alias(f"missing_{side}_domains"))
        out = out.join(found, keys)
    return out


def overlaps(manifest: DataFrame, folds: int = 3) -> DataFrame:
    """(fold, train_pairs, test_pairs, discarded_pairs, resume_overlap, jd_overlap): documents both trained on and tested."""
    roles = F.explode(F.array(*(F.struct(F.lit(k).alias("fold"), F.col(f"fold_{k}_role").alias("role")) for k in range(folds))))
    long = manifest.select("resume_hash", "jd_hash", roles.alias("r")).select("r.*", "resume_hash", "jd_hash")
    out = long.groupBy("fold").agg(*(F.count_if(F.col("role") == r).alias(f"{r}_pairs") for r in ("train", "test", "discarded")))
    for side in ("resume", "jd"):
        per = long.where("role <> 'discarded'").groupBy("fold", f"{side}_hash").agg(F.count_distinct("role").alias("roles"))
        out = out.join(per.groupBy("fold").agg(F.count_if(F.col("roles") > 1).alias(f"{side}_overlap")), "fold", "left")
    return out.select("fold", "train_pairs", "test_pairs", "discarded_pairs", *(F.coalesce(f"{s}_overlap", F.lit(0)).alias(f"{s}_overlap") for s in ("resume", "jd")))


def length_summary(lengths: DataFrame, context: int, column: str = "tokens") -> DataFrame:
    """Documents, nearest-rank percentiles of their lengths, and what lies beyond a context."""
    n = F.col(column)
    beyond = F.when(n > context, n - context)
    rank = lambda q, x: F.coalesce(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {x})"), F.lit(0)).cast("long")
    over = F.count(beyond)
    return lengths.withColumn("beyond", beyond).agg(
        F.count(n).alias("documents"),
        F.coalesce(F.min(n), F.lit(0)).cast("long").alias("least"),
        F.coalesce(F.median(n), F.lit(0.0)).alias("median_length"),
        *(rank(q / 100, column).alias(f"p{q}") for q in (90, 95, 99)),
        F.coalesce(F.max(n), F.lit(0)).cast("long").alias("most"),
        over.alias("over_context"),
        F.coalesce(F.try_divide(over, F.count(n)), F.lit(0.0)).alias("over_share"),
        F.coalesce(F.median("beyond"), F.lit(0.0)).alias("removed_median"),
        rank(0.95, "beyond").alias("removed_p95"),
        F.coalesce(F.max("beyond"), F.lit(0)).cast("long").alias("removed_most"),
    )


def longest(docs: DataFrame, context: int, top: int = 10, shown: int = 240) -> DataFrame:
    """The longest documents (hash, text, tokens), with how they begin and end."""
    rows = docs.orderBy(F.desc("tokens"), "hash").limit(top)
    return rows.select("hash", "tokens", F.greatest(F.lit(0), F.col("tokens") - context).alias("tokens_over"), F.length("text").alias("characters"), F.left("text", F.lit(shown)).alias("head"), F.right("text", F.lit(shown)).alias("tail"))


def examples(pairs: DataFrame, most: int = 100) -> DataFrame:
    """The first `most` pairs in the order of their hashes, shown by falling similarity, with the number of all pairs."""
    total = pairs.agg(F.count(F.lit(1)).alias("total"))
    first = pairs.orderBy("left_hash", "right_hash").limit(most)
    return first.crossJoin(total).orderBy(F.desc("similarity"), "left_hash")


def largest_components(found: DataFrame, top: int = 5) -> DataFrame:
    """Documents per side of the largest components; sizes only, as equal ones have no order."""
    sized = found.withColumn("documents", F.col("n_resumes") + F.col("n_jds"))
    return sized.orderBy(F.desc("documents"), F.desc("n_resumes")).limit(top).select("documents", "n_resumes", "n_jds")


def chunk_histogram(spans: DataFrame) -> DataFrame:
    """(n_chunks, n_documents)."""
    return spans.groupBy("id").agg(F.count(F.lit(1)).alias("n_chunks")).groupBy("n_chunks").agg(F.count(F.lit(1)).alias("n_documents"))


def class_statistics(long: DataFrame) -> DataFrame:
    """(dim, label, mean, std, q25, median, q75) of features (dim, label, x)."""
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = long.groupBy("dim", "label").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), q.alias("q"))
    return g.select("dim", "label", "mean", "std", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))


def redundant(correlations: DataFrame, least: float = 0.95) -> DataFrame:
    """Pairs of different features whose correlation is `least` or more in size."""
    return correlations.where((F.col("i") < F.col("j")) & (F.abs("r") >= least))


def separating(eta: DataFrame, top: int = 12) -> DataFrame:
    """The features that separate the classes most, ties by their number."""
    return eta.orderBy(F.desc("eta2"), "dim").limit(top)


def expected_purity(rows: DataFrame, train: Column) -> DataFrame:
    """Share of neighbours of the same class that chance would give: the sum over classes of train share times test share."""
    c = rows.groupBy("label").agg(F.count_if(train).alias("a"), F.count_if(~train).alias("b"))
    t = c.crossJoin(c.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb")))
    return t.agg(F.sum(F.try_divide("a", "ta") * F.try_divide("b", "tb")).alias("expected_purity"))


def mutual_information(long: DataFrame, bins: int = 10) -> DataFrame:
    """(dim, information) in nats between a feature cut into equal-width bins and the label; constants give 0.

    The customary estimate is by neighbours and randomised; this one is not the same but is exact and one pass over counts.
    """
    spread = long.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = F.col("hi") - F.col("lo")
    place = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / width * bins))).otherwise(0)
    joint = long.join(F.broadcast(spread), "dim").groupBy("dim", place.alias("bin"), "label").agg(F.count(F.lit(1)).alias("n"))
    by_bin, by_label, by_dim = (joint.groupBy(*k).agg(F.sum("n").alias(f"n_{k[-1]}")) for k in (["dim", "bin"], ["dim", "label"], ["dim"]))
    all_counts = joint.join(by_bin, ["dim", "bin"]).join(by_label, ["dim", "label"]).join(by_dim, "dim")
    n = F.col("n_dim")
    return all_counts.groupBy("dim").agg(F.sum(F.col("n") / n * F.ln(F.col("n") * n / (F.col("n_bin") * F.col("n_label")))).alias("information"))


def best_fold(scores: DataFrame) -> DataFrame:
    """The fold with the largest macro-F1 (fold, macro_f1); the first of equal ones."""
    return scores.orderBy(F.desc("macro_f1"), "fold").limit(1)


def cache_bytes(index: DataFrame, dimension: int, value_bytes: int = 2) -> DataFrame:
    """Documents, tokens and bytes of a token cache with `dimension` values a token."""
    n = F.coalesce(F.sum("token_count"), F.lit(0))
    return index.agg(F.count(F.lit(1)).alias("documents"), n.alias("tokens"), (n * dimension * value_bytes).alias("bytes"))


def as_json(report: DataFrame) -> DataFrame:
    """Rows as JSON objects with their keys in order."""
    return report.select(F.to_json(F.struct(*(F.col(c) for c in sorted(report.columns)))).alias("report"))
