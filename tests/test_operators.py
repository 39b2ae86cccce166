import datetime
import random
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom import storage
from matchloom.operators import applications, audit, graph, information, learn, metrics, model, order, projection, reports, similarity, splits, state, vectors
from matchloom.plans import features, splitting
from matchloom.streaming import jobs


def test_audit_golden(spark):
    rows = [("A b", "J", "Good Fit"), (" A  b ", "J", "Good Fit"), ("A b", "J", "No Fit"), ("C", "K", "No Fit"), (None, "K", "No Fit")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "resume string, jd string, label string, ordinal long")
    got = audit.summary(audit.prepared(df)).first().asDict()
    assert got == {"total_rows": 5, "usable_rows": 4, "repeated_pair_rows": 2, "exact_duplicate_rows": 1, "unique_pairs": 2, "conflicting_pairs": 1, "unique_resumes": 2, "unique_jds": 2}


def test_metrics_goldens(spark):
    four = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.45), (1, 0.8)], "y int, p double")
    assert tuple(metrics.threshold(four).first()) == (0.45, 1.0)
    perfect = spark.createDataFrame([(0, 0.0), (1, 1.0)], "y int, p double")
    assert metrics.roc_auc(perfect).first()[0] == metrics.average_precision(perfect).first()[0] == 1
    assert metrics.brier_logloss(perfect).first().brier == metrics.expected_calibration_error(perfect).first()[0] == 0
    weights = spark.createDataFrame([(0,)] * 3 + [(1,)] * 2 + [(2,)], "c int")
    assert {r["class"]: r.weight for r in metrics.class_weights(weights, "c").collect()} == {0: pytest.approx(2 / 3), 1: 1.0, 2: 2.0}


def test_platt_recovers_a_logistic(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(1.5 * m - 0.5)))).astype(int)
    a, b = metrics.platt(spark.createDataFrame(list(zip(m.tolist(), y.tolist(), strict=True)), "margin double, y int"))
    assert abs(a - 1.5) < 0.15 and abs(b + 0.5) < 0.15


def test_chunk_spans(spark):
    got = vectors.chunk_spans(spark.createDataFrame([(1, 9), (2, 5), (3, 0), (4, 6)], "id int, n int"), 5, 2).orderBy("id", "chunk").collect()
    assert [(r.id, r.start, r.stop) for r in got] == [(1, 0, 5), (1, 3, 8), (1, 6, 9), (2, 0, 5), (4, 0, 5), (4, 3, 6)]


def test_kernel_pooling_against_numpy(spark):
    rng = np.random.default_rng(1)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 6)))
    left, right = unit(5), unit(4)
    frame = lambda x, g: spark.createDataFrame([(g, i, v.tolist()) for i, v in enumerate(x)], "grp long, pos long, vec array<double>")
    k = np.array(vectors.kernels())
    soft = np.exp(-((left @ right.T)[:, :, None] - k[:, 0]) ** 2 / (2 * k[:, 1] ** 2)).sum(axis=0)
    want = np.log(np.maximum(soft, 1e-10)).sum(axis=0) * 0.01
    pair = spark.createDataFrame([(0, 1)], "l long, r long")
    got = {r.kernel: r.value for r in vectors.knrm(pair, frame(left, 0), frame(right, 1)).collect()}
    assert np.allclose([got[i] for i in range(11)], want)
    x = np.log(np.maximum(soft / 5, 1e-10)) * 0.01
    stats = np.stack([x.mean(0), x.std(0), x.min(0), *np.quantile(x, [0.25, 0.5, 0.75], axis=0), x.max(0)], axis=1).ravel()
    once = {r.feature: r.value for r in vectors.row_distribution(pair, frame(left, 0), frame(right, 1)).collect()}
    twice = {r.feature: r.value for r in vectors.row_distribution(pair, frame(np.vstack([left, left]), 0), frame(right, 1)).collect()}
    assert np.allclose([once[i] for i in range(77)], stats) and np.allclose([twice[i] for i in range(77)], stats)
    with pytest.raises(Exception, match="a document has no vectors"):
        vectors.knrm(spark.createDataFrame([(0, 2)], "l long, r long"), frame(left, 0), frame(right, 1)).collect()


def test_token_rows_have_no_bound(spark, tmp_path):
    rows = [(i, [1.0, float(i)], i % 3) for i in range(496, 528)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("knrm_features", "knrm_row_distribution"):
        got = features.QUERIES[name](spark, str(tmp_path)).select("l", "r").distinct().collect()
        assert {(r.l, r.r) for r in got} == {(124, 125), (124, 127), (126, 127), (126, 129), (128, 129), (128, 131), (130, 131)}


def test_similarity_golden_and_brute_force(spark):
    assert round(similarity.ratio("x" * 60 + "a", "x" * 60 + "b"), 2) == 98.36
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefg ") for _ in range(rng.randrange(60, 90))) for _ in range(12)]
    for t in list(texts):
        for _ in range(3):
            x = list(t)
            for _ in range(rng.randrange(4)):
                x[rng.randrange(len(x))] = rng.choice(["", "Q", "zz"])
            texts.append("".join(x))
    texts = sorted(set(texts))
    df = spark.createDataFrame([(f"{i:03d}", t) for i, t in enumerate(texts)], "hash string, text string")
    all_pairs = {(i, j): indel_ratio(texts[i].casefold(), texts[j].casefold()) for j in range(len(texts)) for i in range(j)}
    for threshold in (97.0, 90.0, 75.0):
        want = {(f"{i:03d}", f"{j:03d}"): round(s, 6) for (i, j), s in all_pairs.items() if s >= threshold}
        assert {(r.left_hash, r.right_hash): round(r.similarity, 6) for r in similarity.near_duplicates(df, threshold).collect()} == want and want
    with pytest.raises(ValueError, match="two thirds"):
        similarity.near_duplicates(df, 60.0)


def indel_ratio(a, b):
    """By the table of all prefixes, unlike the operator's bits."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 200 * row[-1] / (len(a) + len(b))


def test_seeds_of_short_and_plain_texts(spark):
    rng = random.Random(5)
    texts = {"a" * n for n in (1, 2, 7, 8, 9, 16, 17, 33, 34, 200, 203, 206)} | {"ab" * 40, "ab" * 40 + "a", "ab" * 38, "", "Straße", "STRASSE"}
    for n in (12, 20, 40, 64, 100):
        base = "".join(rng.choice("abcd") for _ in range(n))
        texts |= {base, base.upper() + "x", base[1:], base[:-1] + "y", base[: n // 2] + base[n // 2 + 1 :]}
    texts = sorted(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "n long, text string").selectExpr("lpad(cast(n as string), 3, '0') AS hash", "text")
    want = {(f"{i:03d}", f"{j:03d}") for j, b in enumerate(texts) for i, a in enumerate(texts[:j]) if a and b and indel_ratio(a.casefold(), b.casefold()) >= 97}
    assert {(r.left_hash, r.right_hash) for r in similarity.near_duplicates(df).collect()} == want and len(want) > 20


def test_shared_passages_make_no_candidates(spark):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(300))
    rows = [(i, passage[:150] + "".join(rng.choice("abcdefghij ") for _ in range(900)) + passage[150:]) for i in range(150)]
    rows += [(1000 + i, t[:-1] + "#") for i, t in rows[:10]]
    found = {(r.l, r.r) for r in similarity.candidates(spark.createDataFrame(rows, "id long, folded string"), 97.0).collect()}
    assert {(i, 1000 + i) for i in range(10)} <= found and len(found) < 40  # of 12,720 pairs in one band of lengths


def test_few_grams_are_chosen_and_even_edits_are_found(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(12)]
    levels = np.zeros(1 << similarity.CELL_BITS, np.uint8)
    for t in texts:  # the index has a row for each chosen gram
        assert len(similarity.chosen(similarity.gram_codes(t, 8), levels, similarity.window_of(len(t), 97.0))) < 0.35 * len(t)
    copies = []
    for t in texts:
        x = list(t)
        edits = int(0.0591 * len(x))
        for k in range(edits):  # insertions or deletions, as far from each other as they can be
            at = int((k + 0.5) * len(t) / edits)
            x[at] = x[at] + "Z" if k % 2 else ""
        copies.append("".join(x))
    rows = [(f"a{i:02d}", t) for i, t in enumerate(texts)] + [(f"b{i:02d}", t) for i, t in enumerate(copies)]
    found = {(r.left_hash, r.right_hash) for r in similarity.near_duplicates(spark.createDataFrame(rows, "hash string, text string")).collect()}
    assert found == {(f"a{i:02d}", f"b{i:02d}") for i in range(12)}


def test_near_copies_of_both_sides(spark, sf_dir):
    rows = {side: splitting.rows(spark, sf_dir).where("usable").select(f"{side}_hash").distinct() for side in ("resume", "jd")}
    want = {(side, r[0]) for side, found in rows.items() for r in found.collect()}
    folds = {(r.side, r.hash): r.fold for r in splitting.QUERIES["fold_assignment"](spark, sf_dir).collect()}
    assert folds.keys() == want
    links = splitting.QUERIES["near_duplicates"](spark, sf_dir).collect()
    assert {r.side for r in links} == {"resume", "jd"}
    assert all(folds[r.side, r.left_hash] == folds[r.side, r.right_hash] for r in links)
    stats = {r.side: r.n_clusters for r in splitting.QUERIES["near_duplicate_clusters"](spark, sf_dir).collect()}
    assert stats.keys() == {"resume", "jd"}
    for side, n in stats.items():
        assert 0 < n <= sum(k == side for k, _ in want)


def test_ratio_from_threshold():
    rng = random.Random(5)
    for _ in range(400):
        a = "".join(rng.choice("abcd") for _ in range(rng.choice((0, 1, 30, 700, 1500))))
        b = list(a)
        for _ in range(rng.choice((0, 1, 5, 40))):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(("", "a", "xy"))
        b = "".join(b)
        for threshold in (97.0, 85.0):
            whole, bounded = similarity.ratio(a, b), similarity.ratio_from(a, b, threshold)
            assert bounded == whole if whole >= threshold else bounded < threshold


def test_blocks_and_squares_lose_no_pair(spark, monkeypatch):
    rng = random.Random(21)
    texts = set()
    for n in (90, 100, 106, 300, 5000):  # neighbouring bands, and a family of many copies
        base = "".join(rng.choice("abcdefgh ") for _ in range(n))
        texts |= {base} | {base[:at] + "x" * rng.randrange(3) + base[at:] for at in range(0, n, n // 9)}
    texts = sorted(texts)
    df = spark.createDataFrame([(f"{i:03d}", t) for i, t in enumerate(texts)], "hash string, text string").repartition(3)
    want = {(f"{i:03d}", f"{j:03d}") for j, b in enumerate(texts) for i, a in enumerate(texts[:j]) if similarity.ratio(a, b) >= 97}
    monkeypatch.setattr(similarity, "BLOCK_TEXTS", 3)  # many blocks of a band
    monkeypatch.setattr(similarity, "COST_OF_GROUP", 900)  # many groups of a family
    found = similarity.near_duplicates(df).select("left_hash", "right_hash").collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want and len(want) > 100


def test_pairs_by_hash_are_those_with_texts(spark, sf_dir):
    """Texts are moved once, for both sides, and pairs go on with hashes."""
    pairs, docs = splitting._inputs(spark, sf_dir)
    names = ["resume_hash", "jd_hash", "label_norm", "resume_domain", "jd_domain", "split", "ordinal", "usable"]
    whole = splitting.rows(spark, sf_dir).where("usable")
    count = lambda t: sorted(map(str, t.select(*names).collect()))
    assert count(pairs) == count(whole)
    for side in ("resume", "jd"):
        want = {(r.hash, r.text.casefold()) for r in audit.documents(whole, side).collect()}
        assert {(r["hash"], r.folded) for r in docs[side].collect()} == want
    assert "regexp_replace(" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_linked_without_all_pairs(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(6)]
    for t in texts[:3]:  # chains of copies that drift apart: ends are linked only through the middle
        for _ in range(25):
            at = rng.randrange(len(t) - 8)
            t = t[:at] + "".join(rng.choice("xyz") for _ in range(6)) + t[at + 6 :]
            texts.append(t)
    docs = spark.createDataFrame([(f"h{i:03}", t) for i, t in enumerate([*texts, texts[0].upper(), "", ""])], "hash string, text string")
    want = {(r.hash, r.cluster) for r in similarity.clusters(docs, similarity.near_duplicates(docs)).collect()}
    compared = []
    plain, quotas = similarity._compared, similarity.LINK_ROUNDS
    try:
        similarity._compared = lambda folded, pairs, threshold: compared.append(pairs.count()) or plain(folded, pairs, threshold)
        similarity.LINK_ROUNDS = (1, 2)
        assert {(r.hash, r.cluster) for r in similarity.linked(docs).collect()} == want and len({c for _, c in want}) < 12
    finally:
        similarity._compared, similarity.LINK_ROUNDS = plain, quotas
    assert sum(compared) < similarity._searched(docs, 97.0)[2].count()  # what lies within a component is left out



def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (300, 300), (150, 200)]
    got = {r.vertex: r.component for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[200] == got[150] == 100 and got[300] == 300
    named = graph.components(spark.createDataFrame([("b", "a"), ("c", "b"), ("z", "y"), (None, "q")], "src string, dst string")).collect()
    assert {r.vertex: r.component for r in named} == {"a": "a", "b": "a", "c": "a", "y": "y", "z": "y"}
    assert graph.components(spark.createDataFrame([], "src long, dst long")).collect() == []


def zigzag(n):
    return [*range(0, n, 2), *range(n - 1 - n % 2, 0, -2)]


def test_components_in_few_rounds(spark, monkeypatch):
    """A zigzag of 140 and a random path of 3,000 vertices settle in under 25 rounds."""
    tables = []
    monkeypatch.setattr(graph, "written", lambda df, name: tables.append(name) or storage.written(df, name))
    path = random.Random(7).sample(range(1000, 4000), 3000)
    edges = [(a, b) for chain in (zigzag(140), path) for a, b in zip(chain, chain[1:], strict=False)]
    got = {r.vertex: r.component for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert len(got) == 3140 and all(c == (0 if v < 1000 else 1000) for v, c in got.items())
    assert len(tables) - 2 < 25


def test_shared_folder_off_local(monkeypatch):
    """Without spark.checkpoint.dir a cluster gets an error and not a machine-local folder."""
    nothing = SimpleNamespace(get=lambda *_: None)
    jvm = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))
    context = SimpleNamespace(getConf=lambda: nothing, _jsc=jvm, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        storage.shared_dir(SimpleNamespace(conf=nothing, sparkContext=context))


def test_components_of_a_long_chain(spark):
    ids = random.Random(1).sample(range(500), 500)
    got = graph.components(spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "src long, dst long")).collect()
    assert len(got) == 500 and {r.component for r in got} == {0}


def test_running_sums_of_crowded_values(spark):
    rng = np.random.default_rng(11)
    rows = [(k, float(x), int(n)) for k in ("a", "b") for x, n in {**dict(zip(rng.random(500) * 1e-9, rng.integers(1, 9, 500), strict=True)), 1.0: 3, 2.0: 4}.items()]
    got = order.running(spark.createDataFrame(rows, "k string, x double, n long"), ["k"], "x", ["n"]).collect()
    for k in ("a", "b"):
        own = sorted((x, n) for key, x, n in rows if key == k)
        want = dict(zip([x for x, _ in own], np.cumsum([n for _, n in own]).tolist(), strict=True))
        assert {r.x: r.n_upto for r in got if r.k == k} == want and {r.n_all for r in got if r.k == k} == {sum(n for _, n in own)}


def test_running_sums_go_by_one_set_of_cuts(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([("a", float(x), 1) for x in rng.permutation(3000)] + [("b", -1.0, 2)], "k string, x double, n long")
    got = order.running(rows, ["k"], "x", ["n"])
    assert "percentile_approx" not in got._jdf.queryExecution().toString().lower().replace("approx_percentile", "percentile_approx")
    assert sorted((r.k, r.x, r.n_upto, r.n_all) for r in got.collect()) == [("a", float(i), i + 1, 3000) for i in range(3000)] + [("b", -1.0, 2, 2)]


def test_blocks_of_neighbours(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_ROWS", 7)
    monkeypatch.setattr(vectors, "REFERENCE_ROWS", 20)
    x = np.random.default_rng(12).normal(size=(90, 4))
    rows = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, vec array<double>, label int")
    got = {(r.q, r["rank"]): r.vec_id for r in vectors.neighbours(rows.where("vec_id % 4 = 0"), rows, 5).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    assert got == {(q, k + 1): int(j) for q in range(0, 90, 4) for k, j in enumerate(np.argsort(d[q])[:5])}


def test_residuals_against_numpy(spark):
    rng = np.random.default_rng(13)
    lens = rng.integers(1, 5000, size=(200, 2))
    x = rng.normal(size=200) + lens @ [0.01, -0.002]
    rows = spark.createDataFrame([(i, 0, float(x[i]), int(a), int(b)) for i, (a, b) in enumerate(lens)], "id long, dim int, x double, len_l long, len_r long")
    got = {r.id: r.z for r in vectors.residuals(rows, F.col("id") < 150).collect()}
    design = np.column_stack([np.ones(200), lens, np.log1p(lens)])
    e = x - design @ np.linalg.lstsq(design[:150], x[:150], rcond=None)[0]
    assert np.allclose([got[i] for i in range(200)], (e - e[:150].mean()) / e[:150].std(), atol=1e-6)


def test_encoder_and_spans(spark):
    docs = spark.createDataFrame([(1, "ab", ["x"] * 9), (2, None, ["x", "long", "x"]), (3, "", [])], "id long, text string, tokens array<string>")
    out = vectors.encoded(docs.select("id", "text"), lambda: lambda texts: np.array([[len(t), 1.0] for t in texts])).collect()
    assert {r.id: r.vec for r in out} == {1: [2.0, 1.0], 2: [0.0, 1.0], 3: [0.0, 1.0]}
    spans = vectors.fitted_spans(docs.where("id <> 2"), lambda ts: sum(map(len, ts)), 5, 2).orderBy("id", "chunk").collect()
    assert [(r.start, r.stop) for r in spans if r.id == 1] == [(0, 5), (3, 8), (6, 9)]
    assert not [r for r in spans if r.id == 3]
    short = vectors.fitted_spans(docs.where("id = 2"), lambda ts: sum(map(len, ts)), 5, 0).collect()
    assert [(r.start, r.stop) for r in short] == [(0, 2), (2, 3)]


def test_early_stopping_and_packed_scorer(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(600, 3))
    y = (x @ [2.0, -1.0, 0.0] + 0.3 * rng.normal(size=600) > 0).astype(int)
    w, epoch = learn.adam_fit(x, y, np.arange(600) % 5 == 0, rate=0.05)
    assert ((x @ w[:3] + w[3] > 0) == y).mean() > 0.9 and 1 <= epoch <= 50
    rows = spark.createDataFrame([(i, v.tolist(), int(c), i % 3) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id long, vec array<double>, y int, fold int")
    got = learn.adam_scores(rows).collect()
    assert len(got) == 600 and {r.fold for r in got} == {0, 1, 2}
    assert np.mean([(r.probability > 0.5) == y[r.id] for r in got]) > 0.8
    good = model.Scorer((0.0,), (1.0,), ((0.0,), (1.0,)), (0.0, 0.0), 1.0, 0.0, 0.5)
    assert good.problems(good.fingerprint()) == [] and good.problems("x") == ["the fingerprint differs"]
    assert len(model.Scorer((0.0,), (0.0,), ((0.0,), (1.0, 2.0)), (0.0, float("nan")), 1.0, 0.0, 2.0, ("a", "a")).problems()) == 5
    one = spark.createDataFrame([([0.0],), ([3.0],)], "vec array<double>")
    assert [r.label for r in model.scored(one, good).orderBy("probability").collect()] == ["Good Fit", "Good Fit"]
    with pytest.raises(Exception, match="features are needed"):
        model.scored(spark.createDataFrame([([1.0, 2.0],)], "vec array<double>"), good).collect()


def test_best_threshold_may_be_above_all(spark):
    rows = spark.createDataFrame([(1, 0.1), (0, 0.2), (0, 0.3), (0, 0.9)], "y int, p double")
    at, value = metrics.threshold(rows).first()
    assert at == np.nextafter(0.9, np.inf) and value == pytest.approx((0 + 6 / 7) / 2)


def test_rename_and_insert(spark):
    t = {"inputs": spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "application_key string, v int"), "runs": spark.createDataFrame([("a", 9), ("a", 8), ("z", 7)], "application_key string, v int")}
    moves = spark.createDataFrame([("a", "x"), ("b", "c"), ("n", "y"), ("c", "c")], "old_key string, new_key string")
    got = {n: sorted(map(tuple, d.collect())) for n, d in state.renamed(t, moves).items()}
    assert got == {"inputs": [("b", 2), ("c", 3), ("x", 1)], "runs": [("x", 8), ("x", 9), ("z", 7)]}
    new = spark.createDataFrame([("a", 5), ("d", 7), ("d", 6)], "application_key string, v int")
    assert sorted(map(tuple, state.insert_new(t["inputs"], new, "application_key", "v").collect())) == [("a", 1), ("b", 2), ("c", 3), ("d", 6)]
    assert sorted(map(tuple, state.deleted(t, spark.createDataFrame([("a",)], "application_key string"))["runs"].collect())) == [("z", 7)]


@pytest.mark.parametrize("shape", ["mixed", "pure", "giant"])
def test_balanced_folds(spark, tmp_path, shape):
    rng = random.Random(2)
    cluster = {"mixed": lambda i: rng.randrange(120), "pure": lambda i: i if i % 3 else i // 30, "giant": lambda i: 0 if i < 150 else i}[shape]
    rows = [(f"d{i}", f"c{cluster(i)}", rng.choice("xyyzz") if shape == "mixed" else "xyyzz"[cluster(i) % 5]) for i in range(600)]
    df = spark.createDataFrame(rows, "hash string, cluster string, class string")
    dealt = splits.balanced_folds(df, 3, 42)
    got = {r.hash: r.fold for r in dealt.collect()}
    assert got == {r.hash: r.fold for r in splits.balanced_folds(df.repartition(7), 3, 42).collect()}
    assert len(got) == 600 and all(len({got[h] for h, c, _ in rows if c == k}) == 1 for k in {c for _, c, _ in rows})
    # the counts again, from the written folds, by other means
    dealt.write.parquet(str(tmp_path / "folds"))
    df.write.parquet(str(tmp_path / "members"))
    gaps = duckdb.sql(f"""WITH m AS (SELECT * FROM '{tmp_path}/members/*.parquet' JOIN '{tmp_path}/folds/*.parquet' USING (hash)),
        l AS (SELECT class, max(n) AS n FROM (SELECT class, cluster, count(*) AS n FROM m GROUP BY ALL) GROUP BY 1)
        SELECT class, max(g.n) - min(g.n), any_value(l.n) FROM (SELECT class, fold, count(*) AS n FROM m GROUP BY ALL) g JOIN l USING (class) GROUP BY class""").fetchall()
    assert len(gaps) == 3
    for kind, gap, largest in gaps:
        assert gap <= (largest if shape == "mixed" else 1), (kind, gap, largest)


def test_held_out_pairs(spark):
    folds = spark.createDataFrame([(f"h{k}", k) for k in range(20)], "hash string, fold int")
    pairs = spark.createDataFrame([(f"h{i}", f"h{j}") for i in range(20) for j in range(20)], "resume_hash string, jd_hash string")
    parts = {r.part: r["count"] for r in splits.held_out(pairs, folds, folds, 44).groupBy("part").count().collect()}
    assert parts == {"train": 196, "validation": 9, "test": 9, "dropped": 400 - 214}
    other = splits.held_out(pairs.where("resume_hash = jd_hash"), folds, folds, 45).where("part = 'test'").collect()
    assert {r.resume_hash for r in other} != {r.resume_hash for r in splits.held_out(pairs.where("resume_hash = jd_hash"), folds, folds, 44).where("part = 'test'").collect()}


def test_manifest_roles(spark):
    rows = [(f"r{i}", f"j{j}", "x", True, i * 6 + j) for i in range(6) for j in range(6)]
    df = spark.createDataFrame(rows, "resume_hash string, jd_hash string, label_norm string, usable boolean, ordinal long")
    fold = lambda c: (F.substring(c, 2, 1).cast("int") / 2).cast("int")
    pairs = splits.manifest(df, fold("resume_hash"), fold("jd_hash"))
    counts = {(r.fold, r.role): r.n for r in splits.fold_report(pairs).collect()}
    assert all(counts[f, "test"] == 4 and counts[f, "train"] == 16 and counts[f, "discarded"] == 16 for f in range(3))
    assert all(splits.checks(pairs).first())
    inner = splits.inner_partition(pairs).groupBy("part").count().collect()
    assert sum(r["count"] for r in inner) == 16 and {r.part for r in inner} == {"train", "validation", "dropped"}


def test_domains_and_variation(spark):
    rows = [("h", "b"), ("h", "a"), ("k", "a"), ("k", "a"), ("k", None)]
    df = spark.createDataFrame([(h, d, True) for h, d in rows], "resume_hash string, resume_domain string, usable boolean")
    got = {r.hash: (r.domain, r.tied, r.n_domains) for r in splits.domains(df, "resume").collect()}
    assert got == {"h": ("a", True, 2), "k": ("a", False, 2)}
    assert splits.variation(df, F.lit(True), "resume_domain").first()[0] == 1


def test_upsert_and_matches(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 2, None), (1, 3, "a")], "k int, at int, v string")
    assert {(r.k, r.at, r.v) for r in applications.latest(df, "k", "at").collect()} == {(1, 3, "b"), (2, 2, None)}
    states = applications.matched(spark.createDataFrame([(1,), (2,), (9,)], "k int"), df, "k").collect()
    assert {r.k: r.state for r in states} == {1: "ambiguous", 2: "unique", 9: "missing"}


def test_job_rules():
    j = jobs.Job(1)
    lease = jobs.LEASE_S
    for kind, at, worker in (("claim", 0, 0), ("enqueue", 1, 0), ("enqueue", 2, 0), ("claim", 3, 0), ("claim", 4, 1), ("complete", 5, 1), ("claim", 3 + lease, 1), ("publish", 4 + lease, 1), ("claim", 9e9, 2), ("complete", 9e9, 1)):
        jobs.step(j, kind, at, worker)
    assert (j.status, j.attempts, j.applied, j.refused, j.recovered) == ("completed", 2, 5, 5, 1)


def test_job_attempts_fence_and_back_off():
    j = jobs.Job(1)
    for kind, at, attempt in (("enqueue", 0, None), ("claim", 1, None), ("fail", 2, 1), ("claim", 8, None), ("complete", 9, 1)):
        jobs.step(j, kind, at, 0, attempt)
    assert (j.status, j.attempts, j.refused) == ("running", 2, 1)  # the late event of the first attempt is refused
    jobs.step(j, "fail", 10, 0, 2)
    assert (j.status, j.next_run_at) == ("queued", 20)
    jobs.step(j, "claim", 30, 0)
    jobs.step(j, "complete", 31 + jobs.LEASE_S, 0, 3)  # its lease has ended
    assert (j.status, j.owner, j.recovered) == ("queued", -1, 1)


def test_stream_gives_what_replay_gives(spark, sf_dir, tmp_path):
    events = jobs.job_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    ordered = sorted((r.asDict() for r in events.collect()), key=lambda r: (r["at"], r["event_id"]))
    kinds = events.schema
    half = len(ordered) // 2
    for part in (ordered[:half], ordered[half:]):
        spark.createDataFrame([tuple(r.values()) for r in part], kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = {}

    def keep(batch, _):
        seen.update({r.job: r for r in batch.collect()})

    jobs.stream(source).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    last = ordered[-1]["at"]
    want = {r.job: r for r in jobs.replay(events, until=int(last * 1000) / 1000).collect()}
    assert seen == want and sum(r.recovered for r in want.values()) > 0
    assert any(r.status == "queued" and r.recovered for r in want.values())


def test_telemetry_writes_each_batch_once(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    for _ in range(2):
        jobs.telemetry(source, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(10))


def test_token_batches():
    cut = lambda sizes, budget: [sizes[b] for b in vectors.token_batches(sizes, budget)]
    assert cut([3, 4, 5, 9, 1, 1], 7) == [[3, 4], [5], [9], [1, 1]]
    assert cut([], 7) == [] and cut([8, 8], 7) == [[8], [8]]


def test_block_products_equal_single_ones(spark):
    rng = np.random.default_rng(4)
    sizes = {g: int(rng.integers(1, 9)) for g in range(30)}
    rows = [(g, p, rng.normal(size=6).tolist()) for g, n in sizes.items() for p in range(n)]
    matrix = {g: np.array([v for h, _, v in rows if h == g], np.float32).astype(float) for g in sizes}
    tokens = spark.createDataFrame(rows, "grp long, pos long, vec array<double>")
    wanted = [(int(l), int(r)) for l in range(0, 30, 2) for r in range(1, 30, 2) if l == 4 or r == 7 or (l + r) % 7 == 0]
    pairs = spark.createDataFrame(wanted, "l long, r long")
    pool = lambda soft, n: np.append(soft.sum(axis=0), n)
    found = {}
    for r in vectors.pooled(pairs, tokens.where("grp % 2 = 0"), tokens.where("grp % 2 = 1"), pool, "k", block_tokens=12, budget=9).collect():
        found[r.l, r.r, r.k] = r.value
    assert len(found) == len(wanted) * 12
    bank = np.array(vectors.kernels())
    for l, r in wanted:
        sims = matrix[l] @ matrix[r].T
        for j, (mean, width) in enumerate(bank):
            assert found[l, r, j] == pytest.approx(np.exp(-((sims - mean) ** 2) / (2 * width**2)).sum(), abs=1e-9)
        assert found[l, r, 11] == sizes[l]
    sent = vectors.dealt(pairs, vectors.documents(tokens.where("grp % 2 = 0")), vectors.documents(tokens.where("grp % 2 = 1")), 12).where("part < 2")
    assert sent.count() == sent.select("l_block", "r_block", "part", "l", "r").distinct().count() < 2 * len(wanted)


@pytest.mark.parametrize("parts", [1, 3])
def test_comoments(spark, parts):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 5)) * [1, 10, 0.1, 1, 0] + [1e6, 0, -3, 0, 7]
    x[:, 3] = x[:, 1] * -2
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, vec array<double>, label int")
    got = {r.i: r for r in vectors.comoments(df.repartition(7), parts).collect()}
    assert np.allclose([got[i].row for i in range(5)], np.cov(x.T, ddof=0) * 200, rtol=1e-9, atol=1e-6) and all(r.n == 200 for r in got.values())
    r = {(m.i, m.j): m.r for m in vectors.moments(df).collect()}
    assert len(r) == 15 and r[1, 3] == pytest.approx(-1) and r[4, 4] == r[0, 4] == 0 and r[0, 0] == pytest.approx(1)
    assert vectors.moments(df.limit(0)).collect() == []


def digamma(n):
    return -0.57721566490153286 + sum(1 / i for i in range(1, n))


@pytest.mark.parametrize("run_rows", [4, 4096])
def test_neighbour_information_counts_rows(spark, run_rows):
    rng = np.random.default_rng(6)
    rows = [(0, int(c), float(np.float32(rng.normal() + c))) for c in rng.integers(0, 3, 120)] + [(0, 9, 5.0)]  # a class of one
    rows += [(1, int(c), float(rng.integers(0, 6))) for c in rng.integers(0, 2, 90)] + [(1, 4, 1.0), (1, 4, 7.0)]  # ties; a class of two
    rows += [(2, c % 2, 1.5) for c in range(40)] + [(2, 0, None), (2, 1, float("nan"))]  # constant
    df = spark.createDataFrame(rows, "dim int, label int, x double")
    got = {r.dim: r.information for r in information.neighbour_information(df, 3, run_rows).collect()}
    for dim in range(3):
        own = [(c, x) for d, c, x in rows if d == dim and x is not None and x == x]
        own = [(c, x) for c, x in own if sum(o == c for o, _ in own) > 1]
        total = 0
        for i, (c, x) in enumerate(own):
            near = sorted(abs(y - x) for j, (o, y) in enumerate(own) if o == c and j != i)
            k = min(3, len(near))
            m = sum(abs(y - x) < near[k - 1] or y == x for _, y in own)
            total += digamma(k) - digamma(len(near) + 1) - digamma(m)
        assert got[dim] == pytest.approx(max(0, digamma(len(own)) + total / len(own)), abs=1e-9)
    assert got[0] > 0.1 and information.neighbour_information(df.limit(0)).collect() == []


def test_principal_components_and_trust(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(160, 8)) @ np.diag([9, 5, 3, 1, 0.5, 0.2, 0.1, 0.1]) + 4
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, vec array<double>, label int").repartition(5)
    fit = projection.principal(df, 3)
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(fit.variances, s[:3] ** 2 / 159) and np.allclose(np.abs(fit.directions @ vt[:3].T), np.eye(3), atol=1e-8) and fit.shares.sum() == pytest.approx((s[:3] ** 2).sum() / (s**2).sum())
    shown = projection.projected(df, fit)
    y = np.array([r.vec for r in shown.orderBy("vec_id").collect()])
    assert np.allclose(y, (x - x.mean(axis=0)) @ fit.directions.T)
    k, wrong = 4, 0
    for i in range(0, 160, 20):
        order = lambda z: [j for _, j in sorted((((z[j] - z[i]) ** 2).sum(), j) for j in range(160) if j != i)]  # noqa: B023, E731
        true = order(x)
        wrong += sum(max(0, true.index(j) + 1 - k) for j in order(y)[:k])
    got = projection.trustworthiness(df.where("vec_id % 20 = 0"), df, shown.where("vec_id % 20 = 0"), shown, k).first()
    assert got.n_queries == 8 and got.trustworthiness == pytest.approx(1 - 2 * wrong / (8 * k * (320 - 3 * k - 1)))
    assert projection.trustworthiness(df.where("vec_id % 20 = 0"), df, df.where("vec_id % 20 = 0"), df, k).first().trustworthiness == 1


def test_all_vectors_are_queries(spark, sf_dir, tmp_path):
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert sum(r.n for r in features.QUERIES["neighbor_composition"](spark, sf_dir).collect()) == 10 * n
    assert features.QUERIES["trustworthiness_components"](spark, sf_dir).first().n_queries == n
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 30")
    rows.union(rows.limit(3).withColumn("vec_id", F.lit(None).cast(rows.schema["vec_id"].dataType))).write.parquet(str(tmp_path / "embeddings.parquet"))  # vectors without an id have no place
    assert sum(r.n for r in features.QUERIES["neighbor_composition"](spark, str(tmp_path)).collect()) == 300
    assert features.QUERIES["trustworthiness_components"](spark, str(tmp_path)).first().n_queries == 30


def test_fold_scores_are_those_of_a_newton_fit(spark):
    rng = np.random.default_rng(31)
    x = rng.normal(size=(240, 3)) * [1, 4, 0.5]
    y = (x @ [1.0, -0.3, 0.8] + rng.normal(size=240) > 0.4).astype(int)
    fold = np.arange(240) % 3
    rows = [(i, x[i].tolist(), int(y[i]), int(fold[i])) for i in range(240)]
    got = {r.id: r for r in learn.fold_scores(spark.createDataFrame(rows, "id long, vec array<double>, y int, fold int"), 3, 1e-3).collect()}
    assert got.keys() == set(range(240)) and all(got[i].fold == fold[i] for i in got)
    for k in range(3):
        train = fold != k
        scale = x[train].std(axis=0, ddof=1)
        z = np.hstack([x / scale, np.ones((240, 1))])
        weight = train.sum() / (2 * np.bincount(y[train]))[y]
        weight = np.where(train, weight, 0) / weight[train].sum()
        penalty, w = np.diag([1e-3] * 3 + [0]), np.zeros(4)
        for _ in range(30):
            p = 1 / (1 + np.exp(-z @ w))
            w -= np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + penalty, z.T @ (weight * (p - y)) + penalty @ w)
        for i in np.flatnonzero(fold == k):
            assert got[i].probability == pytest.approx(1 / (1 + np.exp(-z[i] @ w)), abs=2e-4)


def test_examples_are_the_first_pairs(spark):
    pairs = spark.createDataFrame([("b", "c", 98.0), ("a", "z", 97.5), ("a", "b", 99.0), ("c", "d", 100.0), ("a", "c", 99.0)], "left_hash string, right_hash string, similarity double")
    got = [tuple(r) for r in reports.examples(pairs, 3).collect()]
    assert [r[:3] for r in got] == [("a", "b", 99.0), ("a", "c", 99.0), ("a", "z", 97.5)] and {r[3] for r in got} == {5}


def test_reconciliation_of_odd_keys(spark):
    at = datetime.datetime(2024, 1, 2)
    ago = lambda s: at - datetime.timedelta(seconds=s)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    jobs_of = frame(
        [
            ("a", "f1", "waiting_application", False, None, ago(5)),
            ("b", "f2", "waiting_application", False, None, ago(5)),  # two pages
            (None, None, "running", False, ago(1), ago(5)),  # a lease without a key
            ("s1", "f3", "running", True, ago(1), ago(5000)),  # has its score
            ("a", "f4", "running", True, ago(1), ago(5000)),
            ("a", "f5", "running", True, ago(1), ago(5)),
            ("a", "f6", "running", True, ago(-5), ago(5000)),  # not expired
        ],
        "application_key string, input_fingerprint string, status string, publishing boolean, lease_until timestamp, updated_at timestamp",
    )
    snapshots = frame([("a", "f1", 300, "complete", True), ("a", "f7", 300, "partial", True), ("a", "f7", 1, "partial", True), ("a", "f8", 300, "unavailable", True), ("b", "f9", 300, "complete", True), ("c", "fa", 300, "complete", None)], "application_key string, input_fingerprint string, description_chars int, extraction_quality string, snapshot_valid boolean")
    pages = frame([("a",), ("b",), ("b",), ("",), (None,), ("c",)], "application_key string")
    scores = frame([("s1",), ("s2",), ("s2",), ("c",), ("",)], "application_key string")
    runs = frame([("v2", "e1", None), ("v1", "e1", ""), (None, "e1", "")], "version string, model string, revision string")
    got = state.reconciliation(jobs_of, frame([("a",)], "application_key string"), snapshots, pages, scores, runs, at, "v2", "e1", "", 200)
    assert got.first().asDict() == {
        "activated": 1, "requeued": 1, "unavailable_inputs": 2, "recovered_leases": 1, "recovered_publications": 1, "retried_publications": 1, "uncertain_publications": 1,
        "duplicate_application_keys": 1, "duplicate_score_keys": 1, "orphan_score_keys": 2, "missing_local_inputs": 2, "stale_score_runs": 2,
    }
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("odd", [None, np.nan, 1e200])
def test_distances_by_products_are_exact_where_it_counts(odd):
    rng = np.random.default_rng(4)
    y = np.concatenate([rng.normal(size=(300, 8)), np.repeat(rng.normal(size=(1, 8)), 40, axis=0) + 1000])  # many copies, far from zero
    y[310] += 1e-9
    if odd is not None:
        y[7, 2] = odd
    ids = np.arange(len(y)) * 3
    with np.errstate(over="ignore"):
        for i, met in zip((0, 7, 305, 310), vectors.distances(y[[0, 7, 305, 310]], y, ids[[0, 7, 305, 310]], ids), strict=True):
            d2 = ((y - y[i]) ** 2).sum(axis=1)
            keep = np.delete(np.arange(len(y)), i)
            want = keep[np.lexsort((keep, d2[keep]))[:10]]
            at = met.nearest(10)
            assert (at[np.lexsort((at, met.exact(at)))[:10]] == want).all() and met.about[i] == np.inf
            fine = np.isfinite(d2[keep])
            assert (np.abs(met.about - d2)[keep][fine] <= met.slack).all()


def test_pair_components_go_by_numbers(spark, monkeypatch):
    """The rounds of components move numbers and not names; a component is named by its smallest document."""
    kinds, whole = [], graph.components
    monkeypatch.setattr(graph, "components", lambda edges: kinds.append(dict(edges.dtypes)) or whole(edges))
    rows = [("r1", "j1", True), ("r1", "j2", True), ("r2", "j2", True), ("r3", "j3", True), ("r3", "j3", True), ("r4", "j1", False)]
    got = graph.bipartite(spark.createDataFrame(rows, "resume_hash string, jd_hash string, usable boolean")).collect()
    assert sorted((r.component, r.n_resumes, r.n_jds, r.n_pairs) for r in got) == [("jd:j1", 2, 2, 3), ("jd:j3", 1, 1, 1)]
    assert kinds == [{"src": "bigint", "dst": "bigint"}]
