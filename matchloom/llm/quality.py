"""Text quality without labels.

Several heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation over the counts of
their vote patterns estimates how often each votes so on good and on bad documents, and so what each pattern says. The
posterior labels train a linear scorer on hashed word shapes, which then scores every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import sliced, text_key, texts

BUCKETS = 1 << 11
#: Characters of the longest word that a worker remembers; longer ones are looked at anew.
KEPT_LENGTH = 256
GOOD, NOTHING, BAD = 2, 1, 0
LABELLERS = ("symbols", "capitals", "repeats", "variety", "sentences", "shouting", "tables", "length")
_RUNS = ((re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "X"), (re.compile(r"[^\W\dX_]+"), "x"), (re.compile(r"\d+"), "0"), (re.compile(r"([^\w])\1+"), r"\1\1"))
_SYMBOL = re.compile(r"[#$%&*|<>{}\[\]\\^~=@_+]")


class Shapes(dict):
    """Word to its shape's bucket and marks: bit 0 has a symbol, 1 all capitals, 2 shouts, 3 is a bar; bounded, without long words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        shape = word
        for run, mark in _RUNS:
            shape = run.sub(mark, shape)
        marks = bool(_SYMBOL.search(word)) | (len(word) > 1 and word.isupper()) << 1 | ("!!" in word) << 2 | (word == "|") << 3
        value = (2 + xxhash.xxh3_64_intdigest(shape) % (BUCKETS - 2)) << 4 | marks
        if len(word) <= KEPT_LENGTH:
            self[word] = value
        return value


def window_variety(words: list[str], size: int = 100) -> float:
    """Share of distinct words, averaged over runs of `size` words, so that long texts aren't held to be monotonous."""
    return float(np.mean([len(set(words[i : i + size])) / len(words[i : i + size]) for i in range(0, len(words), size)]))


def look(text: str, shapes: Shapes) -> tuple[int, np.ndarray, np.ndarray]:
    """The packed votes of the labellers on a text, and its hashed features: buckets and their shares of the words.

    Buckets 0 and 1 are repeats of the word before and of any word. Most labellers only ever find fault, so votes for
    good come from texts that read as sentences throughout.
    """
    words = text.split()
    n = len(words)
    if not n:
        votes = [NOTHING] * len(LABELLERS)
        votes[LABELLERS.index("length")] = BAD
        return pack(np.array(votes)), np.empty(0, np.int64), np.empty(0)
    codes, counts = np.unique(np.fromiter(map(shapes.__getitem__, words), np.int64, n), return_counts=True)
    same = sum(map(str.__eq__, words, words[1:])) / n
    distinct = len(set(words)) / n
    symbols, capitals, shouts, bars = (float(counts[codes >> b & 1 == 1].sum()) / n for b in range(4))
    lines = [x for x in text.split("\n") if x.strip()]
    ends = sum(x.rstrip()[-1] in ".!?…\"'" for x in lines) / len(lines)
    faults = {
        "symbols": symbols > 0.15,
        "capitals": capitals > 0.4 and n >= 5,
        "repeats": same > 0.15 and n >= 5,
        "variety": n >= 20 and distinct < 0.3 and window_variety(words) < 0.3,
        "sentences": n >= 20 and ends < 0.1,
        "shouting": shouts > 0.15,
        "tables": bars > 0.15,
        "length": False,
    }
    votes = [BAD if faults[k] else NOTHING for k in LABELLERS]
    if ends > 0.5 and symbols < 0.15 and capitals < 0.2 and same < 0.05:
        votes[LABELLERS.index("sentences")] = GOOD
    if n >= 20 and symbols + bars + shouts < 0.05:
        votes[LABELLERS.index("length")] = GOOD
    buckets, where = np.unique(codes >> 4, return_inverse=True)
    shares = np.bincount(where, counts) / n
    return pack(np.array(votes)), np.concatenate([[0, 1], buckets]), np.concatenate([[same, 1 - distinct], shares])


@dataclass
class LabelModel:
    """Share of good documents, and P(vote | class) as labellers x votes x (bad, good)."""

    prior: float
    votes: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        logs = np.log([1 - self.prior, self.prior]) + sum(np.log(self.votes[k, patterns[:, k]]) for k in range(patterns.shape[1]))
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))

    def accuracy(self) -> dict[str, float]:
        """Of each labeller's votes that aren't nothing, the share expected to be right."""
        share = np.array([1 - self.prior, self.prior])
        right = self.votes[:, BAD, 0] * share[0] + self.votes[:, GOOD, 1] * share[1]
        cast = (self.votes[:, [BAD, GOOD]] * share).sum(axis=(1, 2))
        return dict(zip(LABELLERS, (right / cast).tolist(), strict=True))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """EM from documents without a fault as good; a pseudo-count for each vote keeps all probabilities above 0."""
    lean = 1.0 + (patterns == GOOD).sum(axis=1) - 3.0 * (patterns == BAD).sum(axis=1)
    p = 1 / (1 + np.exp(-lean))
    model = LabelModel(0.5, np.full((patterns.shape[1], 3, 2), 1 / 3))
    for _ in range(rounds):
        weights = np.stack([counts * (1 - p), counts * p], axis=1)
        prior = float((weights[:, 1].sum() + 1) / (weights.sum() + 2))
        votes = np.stack([np.stack([weights[patterns[:, k] == v].sum(axis=0) for v in range(3)]) for k in range(patterns.shape[1])]) + 1
        model = LabelModel(prior, votes / votes.sum(axis=1, keepdims=True))
        new = model.posterior(patterns)
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return model


def pack(votes: np.ndarray) -> int:
    return int((votes * 3 ** np.arange(len(votes))).sum())


def unpack(packed: np.ndarray) -> np.ndarray:
    return np.asarray(packed)[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


FEATURES = "k1 long, k2 long, pattern long, buckets array<int>, shares array<float>"


def featurise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed votes and sparse hashed features of each whole text: id (of any type), its 128-bit hash, pattern, buckets, shares.

    Null and blank texts have the vote "bad" for their length and no features. Very long texts have more words, but at
    most BUCKETS features. Other columns, whatever their names, are not read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in sliced(batches, "body", 2 << 20):
            seen = [look(t, shapes) for t in texts(batch, "body")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "k1", "k2")), pa.array([p for p, _, _ in seen], pa.int64()), pa.array([b for _, b, _ in seen], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, _, v in seen], pa.list_(pa.float32()))],
                names=["id", "k1", "k2", "pattern", "buckets", "shares"],
            )

    return docs.select(F.col(id_col).alias("id"), *text_key(F.col(text_col)), F.col(text_col).alias("body")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, {FEATURES}")


def dense(batch: pa.RecordBatch) -> np.ndarray:
    out = np.zeros((batch.num_rows, BUCKETS), np.float32)
    buckets, shares = batch.column("buckets"), batch.column("shares")
    sizes = np.diff(buckets.offsets.to_numpy())
    out[np.repeat(np.arange(batch.num_rows), sizes), buckets.flatten().to_numpy()] = shares.flatten().to_numpy()
    return out


def fit_scorer(features: np.ndarray, target: np.ndarray, rounds: int = 300, rate: float = 1.0, decay: float = 1e-5) -> np.ndarray:
    """Weights (and the bias, last) of a logistic scorer for soft labels, by gradient descent with Adam steps."""
    x = np.hstack([np.sqrt(features), np.ones((len(features), 1), np.float32)]).astype(np.float32)
    w, m, v = (np.zeros(x.shape[1], np.float64) for _ in range(3))
    share = target.mean()
    weight = np.where(target > 0.5, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3))
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        g = ((p - target) * weight).astype(np.float32) @ x / len(x) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


@dataclass
class QualityModel:
    """`weights` is None where the sample held no text of one of the classes; scores are then the labellers' posteriors."""

    labels: LabelModel
    weights: np.ndarray | None

    def score(self, votes: np.ndarray, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return self.labels.posterior(votes)
        return 1 / (1 + np.exp(-np.clip(np.sqrt(features) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def train(featured: DataFrame, sample_rows: int = 8192) -> QualityModel | None:
    """Fit the labellers on the vote patterns of all documents, then the scorer on about `sample_rows` of them.

    `featured` is what featurise() gives, best as a written table. There are at most 3^labellers patterns. The sample is
    chosen by a hash of id and text, so it is the same however rows are dealt, and null ids don't matter; rows that
    repeat id and text are one row of it, put together on the map side, so no text can fill it. One task fits the scorer, on
    twice `sample_rows` at most. If the sample lacks good or bad texts there is nothing to tell them by: see QualityModel.
    None for an empty table.
    """
    rows = sorted(featured.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r.pattern)
    if not rows:
        return None
    counts = np.array([r.n for r in rows], float)
    labels = fit_labels(unpack(np.array([r.pattern for r in rows])), counts)
    limit = int(min(1.0, sample_rows / counts.sum()) * (1 << 30)) + 1
    hit = featured.where(F.pmod(F.xxhash64(F.lit("sample"), "id", "k1", "k2"), F.lit(1 << 30)) < limit)
    sample = hit.groupBy("id", "k1", "k2").agg(*(F.first(c).alias(c) for c in ("pattern", "buckets", "shares")))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, features, n = [], [], 0
        for batch in batches:
            batch = batch.slice(0, max(0, 2 * sample_rows - n))
            if batch.num_rows:
                n += batch.num_rows
                patterns.append(batch.column("pattern").to_numpy())
                features.append(dense(batch))
        target = labels.posterior(unpack(np.concatenate(patterns))) if n else np.empty(0)
        if (target > 0.5).any() and (target < 0.5).any():
            yield pa.RecordBatch.from_pydict({"w": [fit_scorer(np.concatenate(features), target).tolist()]})

    got = sample.repartition(1).sortWithinPartitions("k1", "k2", "id").mapInArrow(fit, "w array<double>").collect()
    return QualityModel(labels, np.array(got[0].w) if got else None)


def assess(featured: DataFrame, model: QualityModel | None, id_col: str = "doc_id", least: float = 0.5) -> DataFrame:
    """Score what featurise() gives: id, score (0 to 1), weak_label (posterior of the votes), votes and kept (score >= `least`).

    A null text or one without words scores 0 and is not kept, and so does all text without a model. Each row is treated
    alone, so ties and repeated rows don't matter. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                n = batch.num_rows
                votes, features = unpack(batch.column("pattern").to_numpy()), dense(batch)
                some = features[:, 2:].any(axis=1)
                score = np.where(some, model.score(votes, features), 0) if model else np.zeros(n)
                weak = model.labels.posterior(votes) if model else np.zeros(n)
                new = [pa.array(score.astype(float)), pa.array(weak), pa.array((votes - 1).tolist(), pa.list_(pa.int32())), pa.array((score >= least) & some)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *new], names=["id", "score", "weak_label", "votes", "kept"])

    return featured.mapInArrow(run, f"id {featured.schema['id'].dataType.simpleString()}, score double, weak_label double, votes array<int>, kept boolean").withColumnRenamed("id", id_col)
