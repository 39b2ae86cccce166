import random

import numpy as np
import pytest

from matchloom.llm import near_dedup as near
from matchloom.llm import setsketch as ss
from matchloom.llm.queries import QUERIES

from .common import empty_docs, hard_docs, near_components


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_registers_estimate_and_merge():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for shared in (0.2, 0.6, 0.75, 0.9):
        n = int(2000 * shared)
        a, b = np.unique(base[:2000]), np.unique(np.concatenate([base[:n], base[2000 : 4000 - n]]))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = ss.sketches([a, b])
        ok, likeliest = ss.may_reach([len(a)], [len(b)], np.array([(x > y).sum()]), np.array([(x < y).sum()]), 0.75)
        assert abs(likeliest[0] - j) < 0.2
        assert ok[0] or j < 0.75
        assert (ss.sketches([np.union1d(a, b)])[0] == np.maximum(x, y)).all()


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf_dir, scale):
    where = sf_dir.replace("sf0.001", scale)
    docs = spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()
    assert got(QUERIES["op7_near_dedup"](spark, where)) == near_components([(r.doc_id, r.text) for r in docs])


@pytest.mark.parametrize("rows", [4, 512])
def test_group_around_one_text(spark, monkeypatch, rows):
    """Copies that are close to one text, which hasn't the smallest id, but mostly not to each other."""
    monkeypatch.setattr(near, "BLOCK_ROWS", rows)
    monkeypatch.setattr(near, "RUN_ROWS", rows)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    docs = [(500, " ".join(base))]
    for i in range(60):
        t = list(base)
        for k in rng.sample(range(len(t)), 5):
            t[k] = f"x{i}y{k}"
        docs.append((i, " ".join(t)))
    far = list(base)
    for k in range(0, 200, 12):
        far[k] = f"far{k}"
    docs.append((600, " ".join(far)))
    want = near_components(docs)
    assert len({c for _, c in want.values()}) < 60
    assert got(near.near_dedup(spark.createDataFrame(docs, "doc_id long, text string"))) == want


def test_chain_and_large_group(spark, monkeypatch):
    """Chains whose ends aren't alike, and a group over several blocks, keep all their links."""
    monkeypatch.setattr(near, "BLOCK_ROWS", 8)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 60])) for i in range(40)]
    base = [rng.choice(words) for _ in range(80)]
    for i in range(100, 180):
        t = list(base)
        for _ in range(rng.randrange(1, 4)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near.near_dedup(df)) == near_components(rows)


def test_hard_rows(spark):
    rows = near.near_dedup(hard_docs(spark)).collect()
    assert len(rows) == 15
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == 1 and by[1].n_shingles == 0 and by[3].n_shingles == 0
    assert by[5].component_id == 4 and by[6].component_id == 4 and not by[5].kept
    assert by[8].component_id == 7 and by[8].n_shingles == 1 and by[9].n_shingles == 1
    assert by[None].component_id is None and by[None].kept
    assert near.near_dedup(empty_docs(spark)).collect() == []


def test_long_chain_of_documents(spark):
    """300 sliding passages in random order of ids are one component."""
    words = [f"w{i}" for i in range(800)]
    ids = random.Random(2).sample(range(300), 300)
    df = spark.createDataFrame([(i, " ".join(words[2 * k : 2 * k + 60])) for k, i in enumerate(ids)], "doc_id long, text string")
    assert {c for _, c in got(near.near_dedup(df)).values()} == {0}


def test_text_ids_are_refused(spark):
    with pytest.raises(TypeError):
        near.near_dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
