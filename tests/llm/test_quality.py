import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from matchloom.llm import quality as q
from matchloom.llm._util import text_key
from matchloom.llm.queries import QUERIES

from .common import empty_docs, hard_docs


def test_em_recovers_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.8
    accuracy = [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.9, 0.8]
    votes = np.stack([np.where(rng.random(len(truth)) < 0.3, q.NOTHING, np.where(truth == (rng.random(len(truth)) < a), q.GOOD, q.BAD)) for a in accuracy], axis=1)
    packed, counts = np.unique([q.pack(v) for v in votes], return_counts=True)
    model = q.fit_labels(q.unpack(packed), counts)
    assert abs(model.prior - truth.mean()) < 0.03
    assert all(abs(x - a) < 0.04 for x, a in zip(model.accuracy().values(), accuracy, strict=True))
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.95


def test_shapes_see_whole_words():
    shapes = q.Shapes()
    clean, junk = "字" * 5000, "字" * 4000 + "##7|" * 250
    assert shapes[clean] >> 4 != shapes[junk] >> 4
    assert shapes["a" * 39 + "b-c"] >> 4 == shapes["x-y"] >> 4
    assert max(map(len, shapes)) <= q.KEPT_LENGTH


def shape(word):
    for pattern, mark in (("[A-ZÀ-ÖØ-Þ]+", "X"), (r"[^\W\dX_]+", "x"), (r"\d+", "0")):
        word = re.sub(pattern, mark, word)
    return re.sub(r"([^\w])\1+", r"\1\1", word)


def looked(text):
    """Votes by name (1 good, -1 bad) and features by bucket, word by word."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return {"length": -1}, {}
    has = lambda rule: sum(map(rule, words)) / n
    symbols, capitals = has(lambda w: re.search(r"[#$%&*|<>{}\[\]\\^~=@_+]", w) is not None), has(lambda w: len(w) > 1 and w.isupper())
    shouts, bars = has(lambda w: "!!" in w), has(lambda w: w == "|")
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    distinct = len(set(words)) / n
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    ends = sum(x[-1] in ".!?…\"'" for x in lines) / len(lines)
    windows = [words[i : i + 100] for i in range(0, n, 100)]
    variety = sum(len(set(w)) / len(w) for w in windows) / len(windows)
    votes = {}
    for name, hit in (("symbols", symbols > 0.15), ("capitals", capitals > 0.4 and n >= 5), ("repeats", same > 0.15 and n >= 5), ("variety", n >= 20 and distinct < 0.3 and variety < 0.3), ("sentences", n >= 20 and ends < 0.1), ("shouting", shouts > 0.15), ("tables", bars > 0.15)):
        if hit:
            votes[name] = -1
    if ends > 0.5 and symbols < 0.15 and capitals < 0.2 and same < 0.05:
        votes["sentences"] = 1
    if n >= 20 and symbols + bars + shouts < 0.05:
        votes["length"] = 1
    features = Counter(2 + xxhash.xxh3_64_intdigest(shape(w)) % (q.BUCKETS - 2) for w in words)
    return votes, {k: c / n for k, c in features.items()} | {0: same, 1: 1 - distinct}


def test_query_equals_brute_force(spark, sf_dir):
    """EM document by document, then the scorer in double precision on all of them (the sample takes them all)."""
    rows = {r.doc_id: looked(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(rows)
    votes = np.array([[rows[i][0].get(name, 0) for name in q.LABELLERS] for i in ids])
    p = 1 / (1 + np.exp(-(1 + (votes == 1).sum(1) - 3.0 * (votes == -1).sum(1))))
    for _ in range(100):
        prior = (p.sum() + 1) / (len(p) + 2)
        log_bad, log_good = np.full(len(p), np.log(1 - prior)), np.full(len(p), np.log(prior))
        for k in range(len(q.LABELLERS)):
            good = np.array([p[votes[:, k] == v].sum() + 1 for v in (-1, 0, 1)])
            bad = np.array([(1 - p)[votes[:, k] == v].sum() + 1 for v in (-1, 0, 1)])
            log_good += np.log(good / good.sum())[votes[:, k] + 1]
            log_bad += np.log(bad / bad.sum())[votes[:, k] + 1]
        p, old = 1 / (1 + np.exp(np.clip(log_bad - log_good, -50, 50))), p
        if abs(p - old).max() < 1e-9:
            break
    x = np.zeros((len(ids), q.BUCKETS + 1))
    for r, i in enumerate(ids):
        for k, share in rows[i][1].items():
            x[r, k] = share**0.5
    x[:, -1] = 1
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    weight = np.where(p > 0.5, 0.5 / p.mean(), 0.5 / (1 - p.mean()))
    for t in range(1, 301):
        g = ((1 / (1 + np.exp(-x @ w)) - p) * weight) @ x / len(p) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    score = 1 / (1 + np.exp(-x @ w))
    got = {r.doc_id: r for r in QUERIES["op2_quality"](spark, sf_dir).collect()}
    assert sorted(got) == ids
    for i, s, weak, vote in zip(ids, score, p, votes, strict=True):
        s = s if rows[i][1] else 0
        assert got[i].votes == vote.tolist() and abs(got[i].weak_label - weak) < 1e-6
        assert abs(got[i].score - s) < 5e-3 and (got[i].kept == (s >= 0.5) or abs(s - 0.5) < 5e-3)


def test_query_accuracy(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES["op2_quality"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1]
    bad = [r.kept for r in rows if labels.get(r.doc_id) == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.2
    assert all(0 <= r.score <= 1 for r in rows)


def test_hard_rows(spark):
    featured = q.featurise(hard_docs(spark))
    rows = q.assess(featured, q.train(featured)).collect()
    assert len(rows) == 15
    by = {r.doc_id: r for r in rows}
    assert not any(by[i].kept or by[i].score for i in (1, 2, 3))
    assert not by[9].kept
    assert q.train(q.featurise(empty_docs(spark))) is None
    assert q.assess(q.featurise(empty_docs(spark)), None).collect() == []
    assert not any(r.kept for r in q.assess(featured, None).collect())
    named = q.featurise(spark.createDataFrame([("a", "some words"), ("b", None)], "doc_id string, text string"))
    assert {r.doc_id for r in q.assess(named, q.train(named)).collect()} == {"a", "b"}


def test_rows_without_ids_are_told_apart(spark):
    rng = np.random.default_rng(2)
    words = "the of and to in is that for it was with as his on be at by had are but from".split()
    clean = [" ".join(rng.choice(words, 30)).capitalize() + "." for _ in range(3000)]
    junk = ["".join(rng.choice(list("#@$%^&*{}[]<>|~"), 40)) + " " + "x" * 3 for _ in range(3000)]
    rows = [(None, t) for t in [*clean, *junk]] + [(None, clean[0])] * 3000
    featured = q.featurise(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).cache()
    model = q.train(featured, 500)
    scored = q.assess(featured.withColumn("id", F.concat("k1", F.lit(":"), "k2")), model).collect()
    keys = {f"{r.k1}:{r.k2}": r.body for r in spark.createDataFrame(rows, "doc_id long, body string").select("body", *text_key(F.col("body"))).distinct().collect()}
    bad = set(junk)
    wrong = sum(r.kept == (keys[r.doc_id] in bad) for r in scored)
    assert len(scored) == 9000 and wrong / 9000 < 0.01
    featured.unpersist()


def test_one_class_alone_falls_back_to_the_labellers(spark):
    rows = [(i, "The house is on the hill and it was there for years.") for i in range(5)]
    featured = q.featurise(spark.createDataFrame(rows, "doc_id long, text string"))
    model = q.train(featured)
    assert model.weights is None and all(r.score == r.weak_label for r in q.assess(featured, model).collect())
