import random

import numpy as np
import pytest

from matchloom.llm import decontaminate as dec
from matchloom.llm.queries import QUERIES

from .common import empty_docs, hard_docs


def brute(docs, items, threshold=0.75, width=5):
    out = set()
    for d, text in docs:
        words = (text or "").encode().lower().split()
        grams = {k: {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} for k in range(1, width + 1)}
        for i, t in items:
            own = (t or "").encode().lower().split()
            if not own:
                continue
            k = min(width, len(own))
            s = {tuple(own[j : j + k]) for j in range(len(own) - k + 1)}
            shared = len(s & grams[k])
            if shared >= threshold * len(s) - 1e-9:
                out.add((d, i, len(s), shared))
    return out


def found(df):
    return {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in df.collect()}


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf_dir, scale):
    where = sf_dir.replace("sf0.001", scale)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{where}/benchmark.parquet").collect()]
    want = brute(docs, items)
    got = QUERIES["op8_decontamination"](spark, where).collect()
    assert want and {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in got} == want
    assert all(r.containment == r.n_shared / r.n_item_shingles for r in got)
    whole = [r.sketch_containment for r in got if r.containment == 1]
    assert 0.7 < np.mean(whole) <= 1


def test_registers_follow_the_threshold():
    for part in (1, 3, 8):
        for t in (0.5, 0.75, 0.9):
            n = dec.registers_of(part, t)
            share = t / (1 + dec.WINDOW)
            assert (1 - share) ** n <= dec.MISS < (1 - share) ** (n - 1)
    assert dec.registers_of(3, 0.5) > dec.registers_of(3, 0.75) > dec.registers_of(3, 0.9)
    assert dec.registers_of(0, 0.75) == dec.window_of(0) == 1


def test_window_minima_equal_their_definition():
    rng = np.random.default_rng(3)
    lengths = np.array([1, 7, 8, 9, 100, 3])
    shingles = rng.integers(0, 2**63, lengths.sum(), dtype=np.uint64)
    signer = dec.Signer(0.75)
    bounds = np.cumsum(lengths) - lengths
    parts = [1, 2, 4]
    for part, (keys, owner) in zip(parts, signer.windows(5, parts, shingles, lengths), strict=True):
        want = []
        size = dec.window_of(part)
        for d, (lo, n) in enumerate(zip(bounds, lengths, strict=True)):
            for at in range(0, n, size):
                factors, salts = signer.of(5, part)
                window = shingles[lo + at : lo + min(n, at + size)]
                want.append((d, [int((window * f).min() ^ s) for f, s in zip(factors, salts, strict=True)]))
        assert [(int(o), keys[:, k].tolist()) for k, o in enumerate(owner)] == want


@pytest.mark.parametrize("threshold", [0.5, 0.75, 0.8, 0.9])
def test_edits_sizes_and_thresholds(spark, threshold):
    """Items of 1 to 300 words, whole, edited, in two places far apart, in very long texts, with text ids."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(2000)]
    items = [(f"i{i}", " ".join(words[40 * i : 40 * i + n])) for i, n in enumerate([1, 2, 4, 5, 6, 9, 17, 19, 30, 40, 300])] + [("a", None), ("b", " "), ("c", "W0"), ("again", "W0")]
    docs = []
    for i, (_, t) in enumerate(items):
        own = (t or "").split()
        for cut in (0, 1, 2, 3, 5, 8):
            hurt = list(own)
            if cut and len(hurt) > cut:
                hurt[len(hurt) // cut - 1] = "changed"
            docs.append((f"{i}-{cut}", "before it " + " ".join(hurt) + " and after it"))
        filler = " ".join(rng.choice(words[1000:]) for _ in range(3000))
        docs.append((f"{i}-apart", f"{' '.join(own[: len(own) // 2])} {filler} {' '.join(own[len(own) // 2 :])}"))
        docs.append((f"{i}-part", f"{filler} {' '.join(own[: len(own) * 4 // 5])} {filler}"))
    docs += [("null", None), ("blank", " "), (None, "w0"), ("long", "zz " * 50_000 + (items[8][1] or "")), ("long", "zz " * 50_000 + (items[8][1] or ""))]
    d = spark.createDataFrame(docs, "doc_id string, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    want = brute(docs, items, threshold)
    assert found(dec.leaks(d, b, threshold=threshold)) == want
    kept = sorted(str(r.doc_id) for r in dec.without_leaks(d, b, threshold=threshold).collect())
    assert kept == sorted(str(i) for i, _ in docs if i not in {w[0] for w in want})


def test_hard_rows(spark):
    b = spark.createDataFrame([(1, "one TWO"), (2, None), (None, "fox jumps over the lazy dog")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dec.leaks(hard_docs(spark), b).collect()}
    assert got == {(7, 1), (8, 1), (4, None), (5, None), (6, None)}
    assert dec.leaks(empty_docs(spark), b).collect() == []
    assert dec.leaks(hard_docs(spark), b.limit(0)).collect() == []
    clash = hard_docs(spark).withColumnsRenamed({"id": "k1", "kept": "k2"})
    left = dec.without_leaks(clash, b)
    assert left.columns == clash.columns and left.count() == 10
    assert dec.without_leaks(empty_docs(spark), b).columns == empty_docs(spark).columns


def test_a_shared_template_makes_no_pairs(spark, monkeypatch):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    header = " ".join(word() for _ in range(24))
    items = [(i, header + " " + " ".join(word() for _ in range(24))) for i in range(120)]
    docs = [(i, header + " " + " ".join(word() for _ in range(24))) for i in range(120)]
    docs += [(1000 + i, f"{word()} {t} {word()}") for i, t in items[:10]]  # these do contain one
    docs += [(2000 + i, t.rsplit(" ", 3)[0] + " other end") for i, t in items[:10]]
    seen = []
    original = dec.candidates
    monkeypatch.setattr(dec, "candidates", lambda *a: seen.append(original(*a)) or seen[-1])
    monkeypatch.setattr(dec, "discard", lambda *a: None)
    got = found(dec.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute(docs, items) and len(got) == 20
    assert seen[0].count() <= 240  # of 16,800 pairs that share register values


def test_bitmap_passes_its_values_and_few_others(spark):
    rng = np.random.default_rng(5)
    own, other = (rng.integers(0, 2**64, 4000, dtype=np.uint64) for _ in range(2))
    known = dec.value_filter(spark.createDataFrame([(int(v),) for v in own.view(np.int64)], "key long"), len(own))
    assert dec.passing(known, own).all() and dec.passing(known, other).mean() < 0.01
