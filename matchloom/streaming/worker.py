"""A scoring worker: requests are answered from a cache whose entries live for a while, or computed and put into it.

One rule serves tables and streams. In a stream the cache is state by key with a time to live: an entry that has expired is
purged before a new one is written, and by a timer if nothing is asked of its key any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from matchloom.operators.model import Scorer
from matchloom.operators.state import usable_input

#: Settings of the session that runs the stream.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
ANSWERS = "id long, cache_key string, at long, step string, score double, made_by long"
REQUESTS = ("cache_key", "at", "id", "usable", "vec")


def score_of(model: Scorer, vec: np.ndarray) -> float:
    """The score (0 to 100) of one request, by the formula of model.scored()."""
    x = (np.asarray(vec, float) - model.mean) / model.scale
    margin = (np.array(model.weights[1]) - model.weights[0]) @ x + model.bias[1] - model.bias[0]
    return float(100 / (1 + np.exp(-(model.slope * margin + model.offset))))


class Cache:
    """One key's entry (score, expires, made_by) and the rule by which requests, in the order of time and id, are answered."""

    def __init__(self, model: Scorer, ttl_us: int, entry: tuple[float, int, int] | None = None):
        self.model, self.ttl, self.entry = model, ttl_us, entry

    def purge(self, now: int) -> None:
        if self.entry and self.entry[1] <= now:
            self.entry = None

    def answer(self, at: int, request: int, usable: bool, vec) -> tuple[str, float | None, int | None]:
        """(step, score, made_by): low_quality, cached or computed."""
        if not usable:
            return "low_quality", None, None
        self.purge(at)
        step = "cached" if self.entry else "computed"
        if not self.entry:
            self.entry = (score_of(self.model, vec), at + self.ttl, request)
        return step, self.entry[0], self.entry[2]


def prepared(requests: DataFrame, least: int = 1) -> DataFrame:
    """Requests (id, cache_key, ts, description_chars, extraction_quality, vec) in the columns that the worker reads."""
    usable = usable_input(F.col("description_chars"), F.col("extraction_quality"), least)
    return requests.select("cache_key", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("id").cast("long").alias("id"), usable.alias("usable"), F.col("vec").cast("array<double>").alias("vec"))


def answers(requests: DataFrame, model: Scorer, ttl_s: float, least: int = 1) -> DataFrame:
    """(id, cache_key, at, step, score, made_by) of all requests of a table, as the stream gives them.

    The requests of a key are read in order by one task, one at a time; only the key's entry is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cache = None, None
        for batch in batches:
            out = []
            for k, at, i, usable, vec in zip(*(batch.column(c).to_pylist() for c in REQUESTS), strict=True):
                if cache is None or k != key:
                    key, cache = k, Cache(model, int(ttl_s * 1e6))
                out.append((i, k, at, *cache.answer(at, i, usable, vec)))
            if out:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in ANSWERS.split(", ")])

    return prepared(requests, least).repartition("cache_key").sortWithinPartitions("cache_key", "at", "id").mapInArrow(run, ANSWERS)


class Worker(StatefulProcessor):
    def __init__(self, model: Scorer, ttl_us: int):
        self.model, self.ttl = model, ttl_us

    def init(self, handle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "score double, expires long, made_by long")

    def _cache(self) -> Cache:
        held = self.entry.get() if self.entry.exists() else None
        return Cache(self.model, self.ttl, (float(held[0]), int(held[1]), int(held[2])) if held else None)

    def _keep(self, before: tuple | None, cache: Cache) -> None:
        if cache.entry is None:
            self.entry.clear()
        elif cache.entry != before:
            self.entry.update(cache.entry)
            self.handle.registerTimer(-(-cache.entry[1] // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cache = self._cache()
        before = cache.entry
        found = pd.concat([part[["at", "id", "usable", "vec"]] for part in rows]).sort_values(["at", "id"])
        out = [(i, key[0], at, *cache.answer(int(at), int(i), bool(usable), vec)) for at, i, usable, vec in found.itertuples(index=False)]
        self._keep(before, cache)
        answered = pd.DataFrame(out, columns=["id", "cache_key", "at", "step", "score", "made_by"])
        yield answered.astype({"score": "float64", "made_by": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cache = self._cache()
        before = cache.entry
        cache.purge(timerValues.getCurrentWatermarkInMs() * 1000)
        self._keep(before, cache)
        return iter(())

    def close(self) -> None:
        pass


def answer_stream(requests: DataFrame, model: Scorer, ttl_s: float, late: str, least: int = 1) -> DataFrame:
    """The answers to a stream of requests, by event time: a key's requests of a batch in their order, batches as they come.

    Where requests come in the order of time over batches the answers are those of answers(). Needs the settings STORE.
    What comes out is persisted with jobs.telemetry() or another sink; a batch that runs again gives the same answers.
    """
    problems = model.problems()
    if problems:
        raise ValueError("; ".join(problems))
    usable = usable_input(F.col("description_chars"), F.col("extraction_quality"), least)
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = timed.select("ts", "cache_key", F.unix_micros("ts").alias("at"), F.col("id").cast("long").alias("id"), usable.alias("usable"), F.col("vec").cast("array<double>").alias("vec"))
    return rows.groupBy("cache_key").transformWithStateInPandas(Worker(model, int(ttl_s * 1e6)), ANSWERS, "Append", "EventTime")
