"""Orders over whole tables without a global sort: running sums within cells of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.storage import written

CELLS = 256
#: Cuts that are looked through at once: first every STEP-th, then those up to the next.
STEP = 16


def running(rows: DataFrame, keys: list[str], value: str, sums: list[str]) -> DataFrame:
    """Adds for each of `sums` its running sum <sum>_upto within `keys` in the order of `value`, and its whole <sum>_all.

    Each key's values are cut at about CELLS quantiles, so crowded values are spread over cells too; sums run within a
    cell, and over the cells' own sums, of which a key has CELLS + 1. A value is expected once a key. Approximate quantiles
    depend on the order in which rows arrive, so they are written once: rows and cells' sums go by the same ones.
    """
    marks = F.array(*(F.lit(i / CELLS) for i in range(1, CELLS)))
    keyed = rows.withColumn("_key", F.struct(*keys) if keys else F.lit(0))
    found = keyed.groupBy("_key").agg(F.array_distinct(F.percentile_approx(value, marks, 10_000)).alias("_cuts"))
    cuts = written(found.withColumn("_heads", F.filter("_cuts", lambda c, i: i % STEP == 0)), "value-cuts")
    upto = lambda c: c <= F.col(value)
    ahead = F.greatest(F.size(F.filter("_heads", upto)) - 1, F.lit(0)) * STEP
    met = keyed.join(F.broadcast(cuts) if not keys else cuts, "_key").withColumn("_ahead", ahead)
    placed = met.withColumn("_cell", F.col("_ahead") + F.size(F.filter(F.slice("_cuts", F.col("_ahead") + 1, STEP), upto))).drop("_cuts", "_heads", "_ahead")
    cells = placed.groupBy("_key", "_cell").agg(*(F.sum(s).alias(f"_{s}") for s in sums))
    earlier = Window.partitionBy("_key").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_key")
    starts = cells.select("_key", "_cell", *(F.coalesce(F.sum(f"_{s}").over(earlier), F.lit(0)).alias(f"_{s}_before") for s in sums), *(F.sum(f"_{s}").over(whole).alias(f"{s}_all") for s in sums))
    local = Window.partitionBy("_key", "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.select("*", *(F.sum(s).over(local).alias(f"_{s}_local") for s in sums))
    joined = inside.join(starts, ["_key", "_cell"])
    return joined.select(*rows.columns, *((F.col(f"_{s}_before") + F.col(f"_{s}_local")).alias(f"{s}_upto") for s in sums), *(f"{s}_all" for s in sums))
