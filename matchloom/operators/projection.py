"""Principal components of all vectors, and how well a projection keeps neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.vectors import Distances, comoments, met_in_cells, neighbours
from matchloom.storage import discard, written


@dataclass
class Components:
    """Means of the features, directions (a row each, the strongest first), their variances and shares of the whole variance."""

    mean: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    shares: np.ndarray


def principal(vectors: DataFrame, most: int = 50) -> Components:
    """The strongest `most` components of vectors (vec), or as many as there are features.

    The covariance matrix is summed by tasks (see comoments()); the driver gets its rows, as many as features, and
    decomposes it. The largest weight of a direction is positive. Variances divide by n - 1.
    """
    rows = sorted(comoments(vectors).collect(), key=lambda r: r.i)  # a row for each feature
    if not rows or rows[0].n < 2:
        raise ValueError("components need two vectors at least")
    values, found = np.linalg.eigh(np.array([r.row for r in rows]) / (rows[0].n - 1))
    order = np.argsort(-values, kind="stable")[:most]
    directions, variances = found[:, order].T, np.maximum(values[order], 0)
    directions = directions * np.where(directions[np.arange(len(order)), np.abs(directions).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    return Components(np.array(rows[0].mean), directions, variances, variances / max(np.maximum(values, 0).sum(), 1e-300))


def projected(vectors: DataFrame, fit: Components) -> DataFrame:
    """The rows of (vec_id, vec, label) with the vector's coordinates along the components in place of vec, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                out = (x - fit.mean) @ fit.directions.T
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out.tolist(), pa.list_(pa.float64())), batch.column("label")], names=["vec_id", "vec", "label"])

    rows = vectors.select("vec_id", F.col("vec").cast("array<double>").alias("vec"), "label")
    return written(rows.mapInArrow(run, f"vec_id long, vec array<double>, label {vectors.schema['label'].dataType.simpleString()}"), "projected-vectors")


def true_ranks(queries: DataFrame, reference: DataFrame, near: DataFrame) -> DataFrame:
    """(q, vec_id, true_rank) of pairs (q, vec_id): the place of vec_id among all reference rows by distance from q, ties by id.

    Distances of the pairs asked for travel with their query, which then meets every part of the reference once and
    counts what is closer; counts of the parts are added up.
    """
    ends = near.join(queries.select(F.col("vec_id").alias("q"), F.col("vec").alias("x")), "q").join(reference.select("vec_id", F.col("vec").alias("y")), "vec_id")

    @F.pandas_udf("double")
    def apart(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([((b[None, :] - a) ** 2).sum(axis=1)[0] for a, b in zip(x, y, strict=True)])

    asked = ends.select("q", F.struct(apart("x", "y").alias("d2"), "vec_id").alias("t")).groupBy("q").agg(F.collect_list("t").alias("asked"))
    rows = written(queries.join(asked.withColumnRenamed("q", "vec_id"), "vec_id").select("vec_id", "vec", "label", F.transform("asked", lambda t: t["d2"]).alias("at"), F.transform("asked", lambda t: t["vec_id"]).alias("ids")), "asked-ranks")

    def closer(others: pd.DataFrame, met: Distances, at: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
        own, n = others["vec_id"].to_numpy(), []
        for d, i in zip(at, ids, strict=True):
            open_ = np.flatnonzero(np.abs(met.about - d) <= met.slack)  # what matrix products can't tell
            d2 = met.exact(open_)
            n.append(int((met.about < d - met.slack).sum() + (d2 < d).sum() + ((d2 == d) & (own[open_] < i)).sum()))
        return {"vec_id": np.asarray(ids), "closer": np.array(n)}

    counts = met_in_cells(rows, reference, closer, "q long, vec_id long, closer long", extra=("at", "ids"))
    return counts.groupBy("q", "vec_id").agg((F.sum("closer") + 1).alias("true_rank"))


def trustworthiness(queries: DataFrame, reference: DataFrame, shown_queries: DataFrame, shown: DataFrame, k: int) -> DataFrame:
    """(n_queries, trustworthiness) of a projection of `reference`, judged by the k neighbours that `queries` have in it.

    Each neighbour in the projection that is none by the vectors themselves counts by how far its true rank lies beyond k.
    1 means that no wrong neighbour is shown. Queries are a stated set against all rows, in blocks.
    """
    near = written(neighbours(shown_queries, shown, k).select("q", "vec_id"), "shown-neighbours")
    n = reference.count()
    ranks = true_ranks(queries, reference, near)
    beyond = F.sum(F.greatest(F.lit(0), F.col("true_rank") - k))
    asked = F.count_distinct("q")
    result = written(ranks.agg(asked.alias("n_queries"), (1 - 2 * beyond / (asked * k * (2 * n - 3 * k - 1))).alias("trustworthiness")), "trustworthiness")
    discard(near)
    return result
