"""Shards of nearly equal bytes that keep equal texts together, by differencing of partial partitions."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import discard, fresh_path, shipped, written

#: Items that one task differences at once. Of a block that isn't the last a 32nd, the heaviest, stay alone; the others are
#: differenced in a 256th as many parts into PART_BINS each, so that a sixteenth as many items come out.
BLOCK_ITEMS, PART_BINS = 8192, 8


def difference(weights: list[int], n_bins: int) -> list[int]:
    """The bin of each weight, by Karmarkar-Karp differencing.

    Each weight starts as a partial partition with all but one bin empty. The two with the largest spread (largest bin
    less smallest) are combined, the fullest bin of one with the emptiest of the other and so on, until one is left.
    Among equal spreads the earlier partition comes first. Bins are kept in ascending order and less their smallest.
    """
    if n_bins == 1 or not weights:
        return [0] * len(weights)
    n = len(weights)
    sums: list = [(0,) * (n_bins - 1) + (w,) for w in weights]
    heap = [(-w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, list[int]]] = []
    last = n_bins - 1
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        x, y = sums[a], sums[b]
        both = sorted((x[j] + y[last - j], j) for j in range(n_bins))
        least = both[0][0]
        sums[a] = sums[b] = None
        sums.append(tuple(s - least for s, _ in both))
        merges.append((a, b, [j for _, j in both]))
        heapq.heappush(heap, (least - both[-1][0], n + len(merges) - 1))
    label: list = [None] * len(sums)
    label[-1] = list(range(n_bins))
    for k in range(len(merges) - 1, -1, -1):
        a, b, order = merges[k]
        own, of_a, of_b = label[n + k], [0] * n_bins, [0] * n_bins
        for place, j in enumerate(order):
            of_a[j], of_b[last - j] = own[place], own[place]
        label[a], label[b], label[n + k] = of_a, of_b, None
    return [label[i][last] for i in range(n)]


def _last_block(n_bins: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["weight", "item"], ascending=[False, True])
        return pd.DataFrame({"item": block["item"].array, "up": np.array(difference(block["weight"].tolist(), n_bins), np.int64).astype(str), "weight": block["weight"].array})

    return run


def _inner_block(kept: int, parts: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Binds the light items of a block into parts * PART_BINS larger ones; a heavy item is never bound to others."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["weight", "item"], ascending=[False, True])
        items, weights, name = block["item"].tolist(), block["weight"].tolist(), str(int(block["block"].iloc[0]))
        up = [f"{name}.{i}" for i in range(len(items))]
        for part in range(parts):
            mine = range(kept + part, len(items), parts)
            for i, found in zip(mine, difference([weights[i] for i in mine], PART_BINS), strict=True):
                up[i] = f"{name}.{part}.{found}"
        return pd.DataFrame({"item": items, "up": up, "weight": weights})

    return run


def assign(groups: DataFrame, n_shards: int, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item, shard) of a table of groups (item string, weight long), each item once.

    Differencing wants all groups in one heap. Here a tree of blocks stands for it: groups are dealt to blocks of about
    `block_items` by hash, in each block the heaviest stay as they are and the others are differenced into a few dozen
    parts, and what comes out are the items of the next level, sixteen times fewer, until one block is left, which is
    differenced into the shards. So heavy groups always reach the last heap by themselves, where bound light ones fill
    the shards up around them. Up to `block_items` groups (256 at least) the result is that of plain differencing. No task holds more
    than about a block; the way back from the shards goes through joins, level by level.
    """
    levels, items = [], groups.select("item", "weight")
    made = []
    while True:
        n = items.count()
        blocks = -(-n // block_items)
        run = _last_block(n_shards) if blocks <= 1 else _inner_block(block_items // 32, block_items // 256)
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item", F.lit(len(levels))), F.lit(max(blocks, 1))))
        level = written(dealt.groupBy("block").applyInPandas(run, "item string, up string, weight long"), "shard-levels")
        levels.append(level)
        if blocks <= 1:
            break
        items = written(level.groupBy("up").agg(F.sum("weight").alias("weight")).select(F.col("up").alias("item"), "weight"), "shard-items")
        made.append(items)
    found = levels[-1].select("item", F.col("up").cast("int").alias("shard"))
    for level in reversed(levels[:-1]):
        found = level.select("item", "up").join(found.withColumnRenamed("item", "up"), "up").select("item", "shard")
    if len(levels) > 1:
        found = written(found, "group-shards")
        discard(*levels, *made)
    return found


def write_shards(docs: DataFrame, n_shards: int = 8, path: str | None = None, text_col: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Write `docs` into folders shard=0 .. n_shards - 1 below `path`, and return what was written.

    Equal texts (same bytes; null counts as empty) are one group, which is never divided. A group weighs its rows times
    (UTF-8 bytes + 1), and groups are dealt to shards by Karmarkar-Karp differencing (see assign()), so that shards have
    nearly the same bytes. A group heavier than a shard's share fills one by itself, as well as can be. Shards should be
    much fewer than a 32nd of `block_items`.

    Files hold all columns of `docs` as a struct `row`, and (part, pos): the task that wrote a row and its place there.
    Returns row, shard (int), part, pos; slots() numbers the rows of each shard. Group keys are SHA-256 of the whole text;
    groups collapse on the map side, so a text with a third of all rows is one row of the group table, and its rows are
    spread by adaptive execution in the join. Texts cross one shuffle.

    Null and empty texts form one group of weight 1 a row; very long texts are keys by their hash; repeated rows each
    take a slot of their own; null or repeated ids and other columns don't matter, whatever their names. An empty table
    gives an empty result and no shard folders.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.struct("*").alias("row"), F.sha2(body, 256).alias("item"), (F.octet_length(body) + 1).cast("long").alias("bytes"))
    groups = written(keyed.groupBy("item").agg(F.sum("bytes").alias("weight")), "shard-groups")
    shards = assign(groups, n_shards, block_items)
    where = path or fresh_path(spark, "shards")
    placed = keyed.join(shards.hint("merge"), "item").select("row", "shard").sortWithinPartitions("shard")
    placed = placed.withColumns({"part": F.spark_partition_id(), "pos": F.monotonically_increasing_id()})
    placed.write.partitionBy("shard").parquet(where)
    discard(groups, shards)
    return spark.read.schema(placed.schema).parquet(where)


def slots(stored: DataFrame, *columns: Column) -> DataFrame:
    """`columns` of what write_shards() returned, with shard and slot: a shard's rows are numbered from 0 without gaps.

    Numbers follow (part, pos). A task's rows of one shard stand one after another, so a row's slot is the count of all
    earlier parts and its distance from the first row of its own; no window goes over rows, only over the counts.
    """
    counts = stored.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.select("shard", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift")), "shard-starts")
    rows = stored.select(*columns, "shard", "part", "pos").join(shipped(starts, 24), ["shard", "part"])
    return rows.select(*(c for c in rows.columns if c not in ("shard", "part", "pos", "shift")), "shard", (F.col("pos") + F.col("shift")).alias("slot"))
