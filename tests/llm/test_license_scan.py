import random
import re

import numpy as np

from matchloom.llm import license_scan as ls
from matchloom.llm.queries import QUERIES

from .common import empty_docs, hard_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    words = WORD.findall((text or "").encode().lower().decode())
    places, labels = [], set()
    for n in ls.BASE:
        own = n.text.split()
        found = [i for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
        places += found
        labels |= {n.label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def fewest_edits(text):
    """For each fuzzy notice the fewest edits to a run of whole words of `text`, by dynamic programming over its letters."""
    words = [w for w in WORD.findall((text or "").encode().lower().decode(errors="replace"))]
    joined = " ".join(words)
    size = max(len(n.text) for n in ls.FUZZY)
    notices = np.zeros((len(ls.FUZZY), size), np.int64)
    for i, n in enumerate(ls.FUZZY):
        notices[i, : len(n.text)] = [ord(c) for c in n.text]
    place = np.arange(size + 1)
    row = np.tile(place, (len(ls.FUZZY), 1))
    best = np.full(len(ls.FUZZY), 10**6)
    last = [len(n.text) for n in ls.FUZZY]
    for j, c in enumerate(joined):
        new = np.empty_like(row)
        new[:, 0] = 0 if c == " " else 10**6  # a run begins behind a blank
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (notices != ord(c)))
        row = np.minimum.accumulate(new - place, axis=1) + place
        if j + 1 == len(joined) or joined[j + 1] == " ":
            best = np.minimum(best, row[np.arange(len(last)), last])
    return best.tolist()


def test_labels_equal_brute_force(spark, sf_dir):
    """Labels and scores of the whole query; texts with no word near a notice show that nothing is found by mistake."""
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labelled = 0
    for r in QUERIES["op10_license_scan"](spark, sf_dir).collect():
        edits = fewest_edits(rows[r.doc_id])
        hit = [(n, e) for n, e in zip(ls.FUZZY, edits, strict=True) if e <= n.edits]
        exact = set(filter(None, base(rows[r.doc_id])[4].split(",")))
        assert set(filter(None, r.labels.split(","))) == exact | {n.label for n, _ in hit}
        assert r.score == (1.0 if exact else max((1 - e / len(n.text) for n, e in hit), default=0.0))
        labelled += bool(hit)
    assert labelled


def test_query_equals_brute_force(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op10_license_scan"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(rows[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score == 1) >= bool(r.n_base)
    assert any("apache" in r.labels for r in got)


def test_edited_notices_are_found():
    rng, scanner = random.Random(8), ls.Scanner()
    for _ in range(300):
        at = rng.randrange(scanner.n_base, len(scanner.notices))
        notice = scanner.notices[at]
        text = list(notice.text)
        for _ in range(rng.randrange(notice.edits + 1)):
            i = rng.randrange(1, len(text) - 1)
            text[i : i + rng.randrange(2)] = rng.choice(["", "q", "x"])
        hurt = "".join(text)
        before = [rng.choice(["filler", "müde", "license", "all", "general"]) for _ in range(rng.randrange(6))]
        words = ls.words_of(" ".join([*before, hurt, "after that"]).encode())
        if distance(notice.text, " ".join(hurt.split())) <= notice.edits:
            found = [m for m in scanner.scan(words) if m[0] == at]
            assert found, hurt
            joined = b" ".join(words).decode()
            for m in found:
                assert distance(notice.text, joined[m[3] : m[4]]) <= m[5] <= notice.edits
                assert joined[: m[3]].count(" ") == m[1] and joined[m[3] : m[4]].count(" ") == m[2] - 1


def test_hard_rows(spark):
    rows = ls.license_scan(hard_docs(spark)).collect()
    assert len(rows) == 15 and all(r.n_base == 0 and r.labels == "" and r.score == 0 for r in rows)
    assert ls.license_scan(empty_docs(spark)).collect() == []
    texts = ["CC BY CC-BY cc by", "ccby", "All rights\nreserved. all  rights reserved", "GNU Generel Public Licence v3", "x" * 10, "cc by " * 20_000]
    got = ls.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(r.text)
    assert [r.labels for r in got] == ["cc-by", "", "reserved", "gpl", "", "cc-by"]
    assert got[3].score == 1 - 2 / 22 and got[3].matches[0].first_word == 1
