"""Domains of documents, folds that keep clusters whole, and split manifests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.storage import shipped, written

MISSING = "<missing>"


def domains(rows: DataFrame, side: str) -> DataFrame:
    """(hash, domain, confidence, tied, n_domains): the commonest domain of each document, ties to the first in order."""
    name = F.when(F.coalesce(F.col(f"{side}_domain"), F.lit("")) == "", MISSING).otherwise(F.col(f"{side}_domain"))
    counts = rows.where("usable").groupBy(F.col(f"{side}_hash").alias("hash"), name.alias("d")).agg(F.count(F.lit(1)).alias("c"))
    best = counts.groupBy("hash").agg(F.max("c").alias("top"), F.sum("c").alias("total"), F.count(F.lit(1)).alias("n_domains"), F.collect_list(F.struct("c", "d")).alias("all"))
    at_top = F.transform(F.filter("all", lambda x: x["c"] == F.col("top")), lambda x: x["d"])
    return best.select("hash", F.array_min(at_top).alias("domain"), (F.col("top") / F.col("total")).alias("confidence"), (F.size(at_top) > 1).alias("tied"), "n_domains")


def variation(rows: DataFrame, part: Column, column: str) -> DataFrame:
    """Total variation distance of a column's distribution between rows where `part` holds and the others."""
    c = rows.groupBy(F.col(column).alias("k")).agg(F.count_if(part).alias("a"), F.count_if(~part).alias("b"))
    t = c.crossJoin(c.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb")))
    share = F.sum(F.abs(F.try_divide("a", "ta") - F.try_divide("b", "tb"))) / 2
    return t.agg(F.coalesce(F.when((F.max("ta") > 0) & (F.max("tb") > 0), share), F.lit(1.0)).alias("distance"))


def hash_fold(col: Column, seed: int, folds: int) -> Column:
    """A fold by the hash of seed and key, with no shuffle."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), col), 256), 1, 7), 16, 10).cast("long") % folds


def filled(loads: dict[str, list[int]], make_up: dict[str, int], n: int, folds: int) -> list[int]:
    """How many of `n` clusters of one make-up (documents by class) each fold gets; `loads`, documents by class and fold, goes along.

    The fold with the fewest documents of these classes, weighted by the make-up, comes next (then the fewest of all, then
    the first). Clusters are poured in shares that shrink with what is left, so the levels end within one cluster of each other
    where the earlier loads allow it, in a number of steps that grows with the log of n.
    """
    out = [0] * folds
    while n:
        share = max(1, n // (4 * folds))
        weigh = [sum(loads[c][k] * m for c, m in make_up.items()) for k in range(folds)]
        best = min(range(folds), key=lambda k: (weigh[k], sum(v[k] for v in loads.values()), k))
        for c, m in make_up.items():
            loads[c][best] += m * share
        out[best] += share
        n -= share
    return out


def _pour(before: dict[str, list[int]], folds: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Deals the make-ups of a wave; `ends` are the places at which the next fold begins, and a last row has the loads."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "make_up"], ascending=[False, True])
        held, ends = {c: list(v) for c, v in before.items()}, []
        for make_up, n in zip(rows["make_up"], rows["n"], strict=True):
            classes = {e["class"]: e["n"] for e in json.loads(make_up)}
            for c in classes:
                held.setdefault(c, [0] * folds)
            ends.append(np.cumsum(filled(held, classes, int(n), folds)).tolist())
        return pd.DataFrame({"make_up": [*rows["make_up"], None], "ends": [*ends, []], "loads": [*[None] * len(rows), json.dumps(held)]})

    return run


def balanced_folds(members: DataFrame, folds: int, seed: int) -> DataFrame:
    """(hash, fold) of documents (hash, cluster, class): clusters stay whole and classes are spread evenly.

    Clusters of one make-up (the same number of documents of each class) can stand for each other, so what is dealt are
    make-ups with the number of their clusters. This goes in waves, from the largest clusters to single documents, a wave
    for each power of two of their size; documents by class and fold are kept as a table over all waves, and each wave fills up
    what those before it left uneven (see filled()). A task sees the make-ups of a wave, not its clusters. A cluster's fold then
    comes from its place among those of its make-up, in the order of a seeded hash, found through counts of the hash's first digits.
    """
    counts = members.groupBy("cluster", F.coalesce("class", F.lit(MISSING)).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    entry = F.array_sort(F.collect_list(F.struct("class", "n")))
    keyed = counts.groupBy("cluster").agg(F.to_json(entry).alias("make_up"), F.sum("n").alias("size")).withColumn("key", F.sha2(F.concat(F.lit(f"{seed}:"), "cluster"), 256))
    groups = written(keyed.select("*", F.left("key", F.lit(3)).alias("digit"), F.floor(F.log2("size")).cast("int").alias("wave")), "fold-clusters")
    makes = written(groups.groupBy("wave", "size", "make_up").agg(F.count(F.lit(1)).alias("n")), "make-ups")
    loads: dict[str, list[int]] = {}
    dealt = []
    for wave in sorted((r.wave for r in makes.select("wave").distinct().collect()), reverse=True):

        poured = written(makes.where(F.col("wave") == wave).groupBy("wave").applyInPandas(_pour(loads, folds), "make_up string, ends array<long>, loads string"), "poured-wave")
        loads = json.loads(poured.where("make_up IS NULL").first().loads)  # a number for each class and fold
        dealt.append(poured.where("make_up IS NOT NULL").select("make_up", "ends"))
    if not dealt:
        return members.select("hash", F.lit(0).alias("fold"))
    ends = dealt[0]
    for more in dealt[1:]:
        ends = ends.unionAll(more)
    earlier = Window.partitionBy("make_up").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    digits = groups.groupBy("make_up", "digit").agg(F.count(F.lit(1)).alias("n")).select("make_up", "digit", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    starts = written(digits.join(ends, "make_up"), "fold-starts")
    place = F.row_number().over(Window.partitionBy("make_up", "digit").orderBy("key", "cluster")) - 1
    placed = groups.select("cluster", "make_up", "digit", place.alias("place")).join(shipped(starts, 128 + 8 * folds), ["make_up", "digit"])
    fold = F.size(F.filter("ends", lambda e: e <= F.col("ahead") + F.col("place")))
    return members.select("hash", "cluster").distinct().join(placed.select("cluster", fold.alias("fold")), "cluster").select("hash", "fold")


#: Small folds of a hold-out, and how many of them are for training and for validation; the rest are for tests.
SMALL_FOLDS, TRAIN_FOLDS, VALIDATION_FOLDS = 20, 14, 3


def holdout_part(fold: Column, seed: int) -> Column:
    """train, validation or test for one of SMALL_FOLDS folds, which are taken in the order of a seeded hash."""
    order = sorted(range(SMALL_FOLDS), key=lambda k: hashlib.sha256(f"{seed}:fold:{k}".encode()).hexdigest())
    names = ["train"] * TRAIN_FOLDS + ["validation"] * VALIDATION_FOLDS + ["test"] * (SMALL_FOLDS - TRAIN_FOLDS - VALIDATION_FOLDS)
    by_fold = [name for _, name in sorted(zip(order, names, strict=True))]
    return F.element_at(F.array(*map(F.lit, by_fold)), fold + 1)


def held_out(pairs: DataFrame, resumes: DataFrame, jds: DataFrame, seed: int) -> DataFrame:
    """`pairs` (resume_hash, jd_hash) with `part`: that of both documents if they agree, else dropped.

    `resumes` and `jds` have (hash, fold), the small folds of a side, in which clusters are whole.
    """
    out = pairs
    for side, docs in (("resume", resumes), ("jd", jds)):
        out = out.join(docs.select(own_name(side), holdout_part(F.col("fold"), seed).alias(f"{side}_part")), f"{side}_hash", "left")
    same = F.col("resume_part") == F.col("jd_part")
    return out.withColumn("part", F.when(same, F.col("resume_part")).otherwise("dropped")).drop("resume_part", "jd_part")


def role(left: Column, right: Column, fold: int) -> Column:
    """A pair is tested where both documents are held out, trained on where neither is, else left out."""
    return F.when((left == fold) & (right == fold), "test").when((left != fold) & (right != fold), "train").otherwise("discarded")


def manifest(rows: DataFrame, left_fold: Column, right_fold: Column, folds: int = 3) -> DataFrame:
    """One row for each usable pair (its first label) with its role in each fold."""
    first = rows.where("usable").groupBy("resume_hash", "jd_hash").agg(F.min_by("label_norm", "ordinal").alias("label"))
    roles = [role(left_fold, right_fold, k).alias(f"fold_{k}_role") for k in range(folds)]
    return first.select(F.sha2(F.concat("resume_hash", F.lit(":"), "jd_hash"), 256).alias("pair_hash"), "resume_hash", "jd_hash", "label", *roles)


def fold_report(pairs: DataFrame, folds: int = 3) -> DataFrame:
    """(fold, role, label, n)."""
    roles = F.explode(F.array(*(F.struct(F.lit(k).alias("fold"), F.col(f"fold_{k}_role").alias("role")) for k in range(folds))))
    return pairs.select("label", roles.alias("r")).groupBy("r.fold", "r.role", "label").agg(F.count(F.lit(1)).alias("n"))


def checks(pairs: DataFrame, folds: int = 3) -> DataFrame:
    """What must hold of the pairs of a manifest, as one row of booleans."""
    long = F.explode(F.array(*(F.struct(F.lit(k).alias("fold"), F.col(f"fold_{k}_role").alias("role")) for k in range(folds))))
    docs = pairs.select(long.alias("r"), F.explode(F.array(F.concat(F.lit("resume:"), "resume_hash"), F.concat(F.lit("jd:"), "jd_hash"))).alias("doc")).select("r.*", "doc")
    shared = docs.where("role <> 'discarded'").groupBy("fold", "doc").agg(F.count_distinct("role").alias("roles")).agg((F.coalesce(F.max("roles"), F.lit(0)) <= 1).alias("no_document_in_train_and_test"))
    once = sum((F.col(f"fold_{k}_role") == "test").cast("int") for k in range(folds))
    own = pairs.agg((F.count(F.lit(1)) == F.count_distinct("pair_hash")).alias("pairs_unique"), F.bool_and(once <= 1).alias("tested_once_at_most"), F.bool_and(F.length("pair_hash") == 64).alias("hashes_whole"))
    return own.crossJoin(shared)


def documents_manifest(members: DataFrame, dealt: DataFrame, domains_of: DataFrame) -> DataFrame:
    """(hash, cluster, fold, domain, confidence) of a side's documents."""
    return members.join(dealt, "hash").join(domains_of.select("hash", "domain", "confidence"), "hash").select("hash", "cluster", "fold", "domain", "confidence")


def manifest_of(rows: DataFrame, resumes: DataFrame, jds: DataFrame, folds: int = 3) -> DataFrame:
    """The pairs' manifest from the folds of both sides' documents."""
    first = rows.where("usable").groupBy("resume_hash", "jd_hash").agg(F.min_by("label_norm", "ordinal").alias("label"))
    joined = first.join(resumes.select(F.col("hash").alias("resume_hash"), F.col("fold").alias("rf")), "resume_hash", "left").join(jds.select(F.col("hash").alias("jd_hash"), F.col("fold").alias("jf")), "jd_hash", "left")
    roles = [role(F.col("rf"), F.col("jf"), k).alias(f"fold_{k}_role") for k in range(folds)]
    return joined.select(F.sha2(F.concat("resume_hash", F.lit(":"), "jd_hash"), 256).alias("pair_hash"), "resume_hash", "jd_hash", "label", *roles)


def manifest_checks(resumes: DataFrame, jds: DataFrame, pairs: DataFrame, folds: int = 3) -> DataFrame:
    """The ten things that must hold of a whole manifest, as one row of booleans."""
    out = None
    for side, docs in (("resume", resumes), ("jd", jds)):
        own = docs.agg((F.count(F.lit(1)) == F.count_distinct("hash")).alias(f"unique_{side}_hashes"), (F.sort_array(F.collect_set("fold")) == F.array(*map(F.lit, range(folds)))).alias(f"{side}_fold_coverage"))
        whole = docs.groupBy("cluster").agg(F.count_distinct("fold").alias("n")).agg((F.coalesce(F.max("n"), F.lit(1)) == 1).alias(f"{side}_clusters_kept_together"))
        part = own.crossJoin(whole)
        out = part if out is None else out.crossJoin(part)
    lone = pairs.join(resumes.select(F.col("hash").alias("resume_hash")), "resume_hash", "left_anti").select("pair_hash").union(pairs.join(jds.select(F.col("hash").alias("jd_hash")), "jd_hash", "left_anti").select("pair_hash"))
    roles = [F.coalesce(F.col(f"fold_{k}_role").isin("train", "test", "discarded"), F.lit(False)) for k in range(folds)]
    known = roles[0]
    for r in roles[1:]:
        known = known & r
    own = pairs.agg((F.count(F.lit(1)) == F.count_distinct("pair_hash")).alias("unique_pair_hashes"), F.coalesce(F.bool_and(known), F.lit(True)).alias("roles_complete"))
    return out.crossJoin(own).crossJoin(lone.agg((F.count(F.lit(1)) == 0).alias("pair_endpoints_exist"))).crossJoin(checks(pairs, folds).select(F.col("no_document_in_train_and_test").alias("zero_train_test_document_overlap")))


def fold_invariants(dealt: DataFrame, members: DataFrame, domains_of: DataFrame, folds: int = 3) -> DataFrame:
    """What must hold of folds (hash, fold): each document once, clusters whole, all folds used, and domains spread evenly.

    A domain's largest and smallest fold may differ by its documents in the largest clusters, one for each fold, and one more, as a cluster of
    several domains can't suit all of them. `documents` is their number.
    """
    joined = members.join(dealt, "hash", "left").join(domains_of.select("hash", "domain"), "hash")
    whole = joined.agg(F.count(F.lit(1)).alias("documents"), (F.count("fold") == F.count_distinct("hash")).alias("each_document_once"), (F.count_distinct("fold") == folds).alias("all_folds_used"))
    kept = joined.groupBy("cluster").agg(F.count_distinct("fold").alias("n")).agg((F.max("n") == 1).alias("clusters_whole"))
    largest = joined.groupBy("domain", "cluster").agg(F.count(F.lit(1)).alias("n")).groupBy("domain").agg(F.max("n").alias("largest"))
    counts = joined.groupBy("domain").agg(*(F.count_if(F.col("fold") == k).alias(f"f{k}") for k in range(folds)))
    names = [f"f{k}" for k in range(folds)]
    gap = F.greatest(*names) - F.least(*names)
    even = counts.join(largest, "domain").agg(F.bool_and(gap <= folds * F.col("largest") + 1).alias("domains_spread"))
    return whole.crossJoin(kept).crossJoin(even)


def validation_clusters(clusters: DataFrame, seed: int, namespace: str, share: float) -> DataFrame:
    """The clusters held out for validation: first in order of a seeded hash, max(1, min(n - 1, round(n share))) of them.

    The order's cut is found from counts of the hash's first four digits and an exact rank within the digits where it falls,
    so nothing is sorted as a whole.
    """
    keyed = clusters.select("cluster", F.sha2(F.concat(F.lit(f"{seed}:{namespace}:"), "cluster"), 256).alias("key")).withColumn("digit", F.left("key", F.lit(4)))
    sizes = keyed.groupBy("digit").agg(F.count(F.lit(1)).alias("n"))
    places = sizes.select("digit", (F.sum("n").over(Window.orderBy("digit")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))
    ranked = keyed.withColumn("r", F.row_number().over(Window.partitionBy("digit").orderBy("key"))).join(F.broadcast(places), "digit")
    take = F.greatest(F.lit(1), F.least(F.col("total") - 1, F.bround(F.col("total") * share).cast("long")))
    return ranked.where(F.col("before") + F.col("r") <= take).select("cluster")


def inner_partition(pairs: DataFrame, outer_fold: int = 0, seed: int = 42, share: float = 0.2, clusters: dict[str, DataFrame] | None = None) -> DataFrame:
    """The training pairs of an outer fold as train, validation or dropped, no cluster on both sides.

    `clusters` has (hash, cluster) for "resume" and "jd"; without it each document is a cluster of its own.
    """
    out = pairs.where(F.col(f"fold_{outer_fold}_role") == "train")
    for side in ("resume", "jd"):
        own = F.col(f"{side}_hash")
        if clusters:
            out = out.join(clusters[side].select(own_name(side), F.col("cluster").alias(f"{side}_cluster")), f"{side}_hash")
        else:
            out = out.withColumn(f"{side}_cluster", own)
        held = validation_clusters(out.select(F.col(f"{side}_cluster").alias("cluster")).distinct(), seed + outer_fold, side, share)
        out = out.join(held.select(F.col("cluster").alias(f"{side}_cluster"), F.lit(True).alias(f"{side}_held")), f"{side}_cluster", "left")
    a, b = F.coalesce("resume_held", F.lit(False)), F.coalesce("jd_held", F.lit(False))
    return out.select("resume_hash", "jd_hash", F.when(a & b, "validation").when(~a & ~b, "train").otherwise("dropped").alias("part"))


def own_name(side: str) -> Column:
    return F.col("hash").alias(f"{side}_hash")
