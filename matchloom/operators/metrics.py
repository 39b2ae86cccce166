"""Ranking, calibration and classification metrics as aggregations over (y, p)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.operators.order import running

#: Left edges of ten equal bins, as a float grid has them.
EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9)


def by_score(rows: DataFrame) -> DataFrame:
    """Positives and negatives at each distinct probability, with running counts from the highest down."""
    counts = rows.groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).withColumn("down", -F.col("p"))
    s = running(counts, [], "down", ["pos", "neg"])
    return s.select("p", "pos", "neg", F.col("pos_upto").alias("tp"), F.col("neg_upto").alias("fp"), F.col("pos_all").alias("all_pos"), F.col("neg_all").alias("all_neg"))


def roc_auc(rows: DataFrame) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties counting half."""
    s = by_score(rows)
    right = F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + F.col("neg") * F.col("pos") / 2)
    return s.agg(F.try_divide(right, F.max(F.col("all_pos") * F.col("all_neg"))).alias("roc_auc"))


def average_precision(rows: DataFrame) -> DataFrame:
    s = by_score(rows)
    step = F.try_divide("pos", "all_pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return s.agg(F.sum(step).alias("average_precision"))


def brier_logloss(rows: DataFrame) -> DataFrame:
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("p")))
    return rows.agg(
        F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"),
        F.avg(-F.when(F.col("y") == 1, F.ln(p)).otherwise(F.ln(1 - p))).alias("log_loss"),
    )


def calibration_bins(rows: DataFrame) -> DataFrame:
    b = sum((F.col("p") >= e).cast("int") for e in EDGES)
    return rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("share"))


def expected_calibration_error(rows: DataFrame) -> DataFrame:
    return calibration_bins(rows).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("share"))) / F.sum("n")).alias("ece"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)


def threshold(rows: DataFrame) -> DataFrame:
    """The smallest threshold (p >= it is positive) that attains the largest macro-F1: a probability, or just above the largest.

    The last one, the next double after the largest probability, predicts nobody positive.
    """
    s = by_score(rows)
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("all_pos") - tp, F.col("all_neg") - fp
    macro = (f1(tp, fp, fn) + f1(tn, fn, fp)) / 2
    each = s.select(F.col("p").alias("threshold"), macro.alias("macro_f1"))
    zero = F.lit(0)
    whole = rows.agg(F.max("p").alias("p"), F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).where("p IS NOT NULL")
    none = whole.select(next_double(F.col("p")).alias("threshold"), ((f1(zero, zero, F.col("pos")) + f1(F.col("neg"), F.col("pos"), zero)) / 2).alias("macro_f1"))
    return each.union(none).orderBy(F.desc("macro_f1"), "threshold").limit(1)


def next_double(x: Column) -> Column:
    """The next larger double of a number from 0 to 1: half the spacing of doubles at x is added, and rounding does the rest."""
    spacing = F.when(x >= 2.0**-1022, F.pow(F.lit(2.0), F.floor(F.log2(x)) - 52)).otherwise(F.lit(5e-324))
    up, more = x + spacing / 2, x + spacing
    return F.when(up > x, up).otherwise(more)


def report(rows: DataFrame, at: float) -> DataFrame:
    """Precision, recall, F1 and support of each class of (y, p >= at), with accuracy and macro-F1 over classes present."""
    hit = (F.col("p") >= at).cast("int")
    c = rows.agg(*(F.count_if((F.col("y") == a) & (hit == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)))
    out = None
    for k in (0, 1):
        tp, fn, fp = F.col(f"c{k}{k}"), F.col(f"c{k}{1 - k}"), F.col(f"c{1 - k}{k}")
        part = c.select(
            F.lit(k).alias("class"),
            F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0).alias("precision"),
            F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0).alias("recall"),
            f1(tp, fp, fn).alias("f1"),
            (tp + fn).alias("support"),
            (tp + fn + fp > 0).alias("present"),
            ((F.col("c00") + F.col("c11")) / (F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11"))).alias("accuracy"),
        )
        out = part if out is None else out.union(part)
    both = out.where("present").agg(F.avg("f1").alias("macro_f1"))
    return out.drop("present").crossJoin(both)


def class_weights(labels: DataFrame, column: str) -> DataFrame:
    """n / (classes * n of the class)."""
    counts = labels.groupBy(F.col(column).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))).select("class", "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def platt(rows: DataFrame, penalty: float = 1e-6, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic fit on one margin: Newton steps, each one aggregation over the rows."""
    a = b = 0.0
    for _ in range(rounds):
        s = 1 / (1 + F.exp(-(a * F.col("margin") + b)))
        w = s * (1 - s)
        r = rows.agg(
            F.sum((s - F.col("y")) * F.col("margin")).alias("ga"),
            F.sum(s - F.col("y")).alias("gb"),
            F.sum(w * F.col("margin") ** 2).alias("haa"),
            F.sum(w * F.col("margin")).alias("hab"),
            F.sum(w).alias("hbb"),
        ).first()
        ga, haa = r.ga + penalty * a, r.haa + penalty
        det = haa * r.hbb - r.hab * r.hab
        da, db = (r.hbb * ga - r.hab * r.gb) / det, (haa * r.gb - r.hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-10:
            break
    return a, b


def calibrated(rows: DataFrame, a: float, b: float) -> DataFrame:
    return rows.withColumn("probability", 1 / (1 + F.exp(-(a * F.col("margin") + b))))
