"""Linear classifiers by fold: a distributed one, and one by small steps with early stopping on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.metrics import class_weights


def fold_scores(rows: DataFrame, folds: int = 3, penalty: float = 1e-4) -> DataFrame:
    """(id, fold, probability): each row (id, vec, y, fold) scored by a weighted linear classifier fitted on the other folds.

    Features are standardised with the training folds' figures; classes weigh alike. The fit is a quasi-Newton one to
    its optimum, on all rows and all executors, without early stopping; adam_scores() has that.
    """
    data = rows.withColumn("features", array_to_vector("vec"))
    out = None
    for k in range(folds):
        train = data.where(F.col("fold") != k)
        weights = class_weights(train, "y").select(F.col("class").alias("y"), "weight")
        model = LogisticRegression(labelCol="y", weightCol="weight", standardization=True, regParam=penalty, maxIter=50).fit(train.join(F.broadcast(weights), "y"))
        part = model.transform(data.where(F.col("fold") == k)).select("id", "fold", F.element_at(vector_to_array("probability"), 2).alias("probability"))
        out = part if out is None else out.union(part)
    return out


def adam_fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, rate: float = 1e-3, decay: float = 1e-4, batch: int = 512, epochs: int = 50, patience: int = 5, least: float = 1e-4, seed: int = 42) -> tuple[np.ndarray, int]:
    """Weights (bias last) of a class-weighted logistic fit by decoupled-decay Adam steps, and the epoch that they are from.

    Training ends when the loss on the held rows hasn't fallen by `least` for `patience` epochs; the best weights count.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    train = np.flatnonzero(~held)
    counts = np.maximum(np.bincount(y[train], minlength=2), 1)
    weight = (len(train) / (2 * counts))[y]
    rng = np.random.default_rng(seed)
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    best, best_loss, best_epoch, t = w.copy(), np.inf, 0, 0
    for epoch in range(1, epochs + 1):
        order = rng.permutation(train)
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            p = 1 / (1 + np.exp(-np.clip(x[own] @ w, -30, 30)))
            g = ((p - y[own]) * weight[own]) @ x[own] / weight[own].sum()
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w * (1 - rate * decay) - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        p = np.clip(1 / (1 + np.exp(-np.clip(x[held] @ w, -30, 30))), 1e-12, 1 - 1e-12)
        loss = float(-np.where(y[held] == 1, np.log(p), np.log(1 - p)).mean()) if held.any() else 0.0
        if loss < best_loss - least:
            best, best_loss, best_epoch = w.copy(), loss, epoch
        elif epoch - best_epoch >= patience:
            break
    return best, best_epoch


def adam_scores(rows: DataFrame, folds: int = 3, sample_rows: int = 100_000, share: float = 0.2) -> DataFrame:
    """(id, fold, probability): rows (id, vec, y, fold) scored by a classifier fitted with early stopping on the other folds.

    Each fold is fitted by one task, on about `sample_rows` of its training rows (twice as many at most), chosen by a
    hash of their id, of which a `share` is held out to stop; all rows are scored. Folds are fitted side by side.
    """
    counts = {r.fold: r.n for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    place = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30))
    others = F.explode(F.array(*(F.struct(F.lit(k).alias("out"), F.lit(int(min(1.0, sample_rows / max(1, total - counts.get(k, 0))) * (1 << 30)) + 1).alias("most")) for k in range(folds))))
    chosen = rows.select("id", "vec", F.col("y").cast("int").alias("y"), "fold", others.alias("o")).where((F.col("fold") != F.col("o.out")) & (place < F.col("o.most")))
    held = F.pmod(F.xxhash64(F.lit("held"), "id"), F.lit(1000)) < int(1000 * share)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[pa.RecordBatch]] = {}
        for b in batches:
            for k in set(b.column("out").to_pylist()):
                parts.setdefault(k, []).append(b.filter(pa.array([x == k for x in b.column("out").to_pylist()])))
        for k, found in parts.items():
            t = pa.Table.from_batches(found).slice(0, 2 * sample_rows)
            x = np.stack([np.asarray(r) for r in t["vec"].to_pylist()])
            h = t["held"].to_numpy()
            mean, scale = x[~h].mean(axis=0), x[~h].std(axis=0)
            scale[scale == 0] = 1
            w, epoch = adam_fit((x - mean) / scale, t["y"].to_numpy(), h)
            yield pa.RecordBatch.from_pydict({"out": pa.array([k], pa.int32()), "w": [(w[:-1] / scale).tolist()], "b": [float(w[-1] - (w[:-1] * mean / scale).sum())], "epoch": pa.array([epoch], pa.int32())})

    dealt = chosen.select(F.col("o.out").alias("out"), "id", "vec", "y", held.alias("held")).repartition(folds, "out").sortWithinPartitions("out", "id")
    fitted = dealt.mapInArrow(fit, "out int, w array<double>, b double, epoch int")
    model = F.broadcast(fitted.withColumnRenamed("out", "fold"))  # a row for each fold
    margin = F.aggregate(F.zip_with("vec", "w", lambda x, y: x * y), F.col("b"), lambda s, x: s + x)
    return rows.join(model, "fold").select("id", "fold", (1 / (1 + F.exp(-margin))).alias("probability"))
