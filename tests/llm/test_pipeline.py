import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from .common import ascii_lower, empty_docs, hard_docs, near_components
from .test_decontaminate import brute


def test_pipeline_equals_brute_force(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = {r.doc_id: r.text for r in docs if any(c.isalpha() for c in r.text or "")}
    first = {}
    for i in sorted(left):
        first.setdefault(ascii_lower(left[i]), i)
    left = {i: left[i] for i in first.values()}
    left = {i: left[i] for i, (_, c) in near_components(left.items()).items() if i == c}
    leaked = {d for d, *_ in brute(left.items(), items)}
    left = {i: t for i, t in left.items() if i not in leaked}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert leaked and got.keys() == left.keys()
    for i, r in got.items():
        ids = library.encode(left[i], add_special_tokens=False).ids
        assert r.text == left[i] and r.round_trip and r.n_tokens == len(ids)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids


def test_stages_keep_columns_and_take_empty_tables(spark, sf_dir):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty_docs(spark), sf_dir)
        assert out.columns == empty_docs(spark).columns and out.collect() == []


def test_stages_take_hard_rows(spark, sf_dir):
    """Repeated rows, null ids, two texts under one id, very long texts and clashing columns: decided row by row."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    hard = hard_docs(spark)
    left = {name: stages[name](spark, hard, sf_dir) for name in ("language_id", "exact_dedup", "near_dedup", "decontamination")}
    assert all(x.columns == hard.columns for x in left.values())
    ids = {name: sorted((r.doc_id for r in x.collect()), key=str) for name, x in left.items()}
    assert ids["language_id"] == sorted([4, 5, 6, 7, 8, 9, 10, 11, 12, 12, None], key=str)
    assert ids["exact_dedup"] == sorted([1, 3, 4, 6, 7, 9, 10, 11, 12, None, 13], key=str)
    assert ids["near_dedup"] == sorted([1, 2, 3, 4, 7, 9, 10, 11, 12, 12, None, 13], key=str)
    assert len(ids["decontamination"]) == 15
    other = "entirely other words stand here under an id that a copy has as well"
    base = "the quick brown fox jumps over the lazy dog and runs far away from here again"
    rows = [(1, base), (2, base), (2, other), (None, other), (None, "no id"), (None, "no id"), (3, base + " today"), (3, "third text of its own, with enough words for one shingle")]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, k1 string, row int")
    got = {n: sorted(((r.doc_id, r.text) for r in stages[n](spark, docs, sf_dir).collect()), key=str) for n in ("exact_dedup", "near_dedup")}
    assert got["exact_dedup"] == sorted([(1, base), (2, other), (None, "no id"), rows[6], rows[7]], key=str)
    assert got["near_dedup"] == sorted([(1, base), (2, other), *rows[3:6], rows[7]], key=str)
