"""Shards: equal texts together, bytes near equal, slots without gaps, and the differencing itself."""

import itertools
import random

import pytest

from matchloom.llm import sharding
from tests.llm.common import empty_docs, hard_docs


def spread(weights, bins, n):
    sums = [0] * n
    for w, b in zip(weights, bins, strict=True):
        sums[b] += w
    return max(sums) - min(sums)


def test_differencing_by_hand():
    # 8 and 7 differ by 1, 6 and 5 by 1, these and 4 by 4, 1 and 4 by 2: {8, 6} and {7, 5, 4}
    bins = sharding.difference([8, 7, 6, 5, 4], 2)
    assert sorted([sum(w for w, b in zip([8, 7, 6, 5, 4], bins, strict=True) if b == k) for k in (0, 1)]) == [14, 16]
    assert sharding.difference([], 8) == [] and len(set(sharding.difference([5] * 8, 8))) == 8


@pytest.mark.parametrize("n", [2, 3, 8])
def test_differencing_beats_largest_first(n):
    rng, better = random.Random(n), 0
    for _ in range(30):
        weights = [rng.randrange(1, 10**6) for _ in range(120)]
        sums = [0] * n
        for w in sorted(weights, reverse=True):
            sums[sums.index(min(sums))] += w
        mine = spread(weights, sharding.difference(weights, n), n)
        better += mine <= max(sums) - min(sums)
        assert mine <= max(weights)
    assert better >= 24


def test_differencing_is_near_the_best(n=2):
    rng = random.Random(7)
    for _ in range(20):
        weights = [rng.randrange(1, 50) for _ in range(9)]
        best = min(spread(weights, bins, n) for bins in itertools.product(range(n), repeat=9))
        assert spread(weights, sharding.difference(weights, n), n) <= best + 10


def placed(docs, n=8):
    stored = sharding.write_shards(docs, n)
    return stored, sharding.slots(stored, *[stored["row"][c].alias(f"row_{c}") for c in docs.columns])


def check(rows, n):
    by_text, slots, sums = {}, {}, [0] * n
    for r in rows:
        text = r["row_text"] or ""
        by_text.setdefault(text, set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
        sums[r["shard"]] += len(text.encode()) + 1
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sums


def test_hard_rows(spark):
    docs = hard_docs(spark)
    stored, got = placed(docs)
    rows = got.collect()
    check(rows, 8)
    assert sorted(map(str, (tuple(r[f"row_{c}"] for c in docs.columns) for r in rows))) == sorted(map(str, map(tuple, docs.collect())))
    assert stored.schema["row"].dataType == docs.select("*").schema
    assert placed(empty_docs(spark))[1].collect() == []


@pytest.mark.parametrize("block", [256, 8192])
def test_levels_of_blocks_and_a_hot_group(spark, block):
    rng = random.Random(3)
    texts = ["x" * int(rng.paretovariate(1.2) * 20) + str(i) for i in range(900)]
    texts += ["hot text that is repeated" * 20] * 150
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    stored = sharding.write_shards(docs, 8, block_items=block)
    sums = check(sharding.slots(stored, stored["row"]["text"].alias("row_text")).collect(), 8)
    heaviest = 150 * len(texts[-1])
    assert heaviest > sum(sums) / 8 and max(sums) == heaviest + 150
    rest = sorted(sums)[:-1]
    assert max(rest) - min(rest) <= sum(sums) * 0.01
