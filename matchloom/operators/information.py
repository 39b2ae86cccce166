"""Mutual information of features and labels by nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.order import running
from matchloom.storage import discard, written

#: Ranks of a class's values that are one run; neighbours beyond its ends are sent along.
RUN_ROWS = 4096


def digamma(n: Column) -> Column:
    """Of a whole number of 1 or more: stepped up by eight, then its asymptotic series; right to about 1e-12."""
    m = n + 8
    series = F.ln(m) - 0.5 / m - 1 / (12 * m * m) + 1 / (120 * F.pow(m, F.lit(4))) - 1 / (252 * F.pow(m, F.lit(6))) + 1 / (240 * F.pow(m, F.lit(8)))
    steps = sum((1 / (n + i) for i in range(1, 8)), 1 / n)
    return series - steps


def radii(values: DataFrame, k: int, run_rows: int = RUN_ROWS) -> DataFrame:
    """(dim, label, x, n, size, near, radius) of distinct values (dim, label, x, n, size): how far the `near`-th neighbour is.

    `near` is k, or less in a class of fewer other rows. A value counts k + 1 times at most, as more copies of it don't
    change the distance of a k-th neighbour; so no class or value is hot. Copies get their rank within the class by
    running counts over cells; runs of `run_rows` ranks are sorted by themselves, with the k ranks on either side sent along.
    """
    capped = values.withColumn("copies", F.least("n", F.lit(k + 1)))
    ranked = running(capped, ["dim", "label"], "x", ["copies"]).withColumn("first", F.col("copies_upto") - F.col("copies"))
    rows = ranked.select("dim", "label", "x", "n", "size", F.posexplode(F.sequence(F.col("first"), F.col("copies_upto") - 1)).alias("copy", "rank"))
    run_of = lambda r: F.floor(r / run_rows)
    spread = rows.select("*", F.explode(F.array_distinct(F.array(*(run_of(F.col("rank") + d) for d in (-k, 0, k))))).alias("run"))
    order = Window.partitionBy("dim", "label", "run").orderBy("rank")
    near = [F.abs(at(F.col("x"), j).over(order) - F.col("x")) for j in range(1, k + 1) for at in (F.lag, F.lead)]
    met = spread.withColumn("distances", F.array_sort(F.array_compact(F.array(*near)))).where((F.col("run") == run_of(F.col("rank"))) & (F.col("copy") == 0))
    asked = F.least(F.lit(k).cast("long"), F.col("size") - 1)
    return met.select("dim", "label", "x", "n", "size", asked.alias("near"), F.element_at("distances", asked.cast("int")).alias("radius"))


def neighbour_information(features: DataFrame, k: int = 3, run_rows: int = RUN_ROWS) -> DataFrame:
    """(dim, information) in nats between a continuous feature (dim, label, x) and the label, by k nearest neighbours.

    For each row, r is the distance of its k-th neighbour within its class and m the rows of all classes that are closer
    than r (or equal, if r is 0), itself included. The information is psi(N) + mean psi(k) - mean psi(class size) - mean psi(m),
    0 at least. Classes of one row are left out. Unlike the customary estimate no noise is added, so the result is
    exact; distances are those of 32-bit values, in doubles. Null and NaN values are left out.

    Rows of a class with one value are one row here. Radii come from sorted runs (see radii()); m from running counts over
    the order of each feature's values and the ends of all intervals, in cells. Nothing goes through one task but a row a feature.
    """
    x = F.col("x").cast("float").cast("double")
    clean = features.select("dim", "label", (x + F.lit(0.0)).alias("x")).where("label IS NOT NULL AND x IS NOT NULL AND NOT isnan(x)")
    counts = clean.groupBy("dim", "label", "x").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("dim", "label").agg(F.sum("n").alias("size")).where("size > 1")
    values = written(counts.join(sizes, ["dim", "label"]), "class-values")
    found = written(radii(values, k, run_rows).withColumns({"lo": F.col("x") - F.col("radius"), "hi": F.col("x") + F.col("radius")}), "class-radii")
    none = F.lit(0).cast("long").alias("c")
    marks = values.select("dim", "x", F.col("n").alias("c")).unionAll(found.select("dim", "lo", none)).unionAll(found.select("dim", "hi", none))
    upto = written(running(marks.groupBy("dim", "x").agg(F.sum("c").alias("c")), ["dim"], "x", ["c"]).select("dim", "x", "c", "c_upto"), "value-counts")
    at = lambda name: upto.select("dim", F.col("x").alias(name), (F.col("c_upto") - F.col("c")).alias(f"{name}_below"), F.col("c_upto").alias(f"{name}_upto"))
    met = found.join(at("lo"), ["dim", "lo"]).join(at("hi"), ["dim", "hi"])
    inside = F.when(F.col("radius") > 0, F.col("hi_below") - F.col("lo_upto")).otherwise(F.col("hi_upto") - F.col("hi_below"))
    n = F.sum("n")
    mean = lambda c: F.sum(F.col("n") * digamma(c)) / n
    told = met.withColumn("m", inside).groupBy("dim").agg(F.greatest(F.lit(0.0), digamma(n) + mean(F.col("near")) - mean(F.col("size")) - mean(F.col("m"))).alias("information"))
    result = written(told, "neighbour-information")
    discard(values, found, upto)
    return result
