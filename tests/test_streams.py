"""Streams against the tables that they should agree with."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import model, state
from matchloom.streaming import changes, jobs, worker


@pytest.fixture
def rocks(spark):
    before = {k: spark.conf.get(k, None) for k in changes.STORE}
    for k, v in changes.STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


SCORER = model.Scorer((0.0, 1.0), (1.0, 2.0), ((0.1, 0.2), (0.5, -0.3)), (0.0, 0.1), 1.5, 0.2, 0.5)


def by_hand(rows, ttl):
    """Each request's step and the request whose score it gets, one after another."""
    entries, out = {}, {}
    for i, key, ts, chars, _, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if chars < 200:
            out[i] = ("low_quality", None)
            continue
        if key not in entries or ts >= entries[key][0]:
            entries[key] = (ts + datetime.timedelta(seconds=ttl), i)
            out[i] = ("computed", i)
        else:
            out[i] = ("cached", entries[key][1])
    return out


def test_worker_answers_from_a_cache_that_expires(spark, tmp_path, rocks):
    rng, base, ttl = random.Random(4), datetime.datetime(2024, 1, 1), 600
    rows = [(i, f"k{rng.randrange(5)}", base + datetime.timedelta(seconds=60 * i), 100 if i % 7 == 0 else 300, "complete", [rng.random(), rng.random()]) for i in range(120)]
    schema = "id long, cache_key string, ts timestamp, description_chars int, extraction_quality string, vec array<double>"
    table = spark.createDataFrame(rows, schema).repartition(6)
    expected = by_hand(rows, ttl)
    scores = {r.vec_id: r.score for r in model.scored(table.select(F.col("id").alias("vec_id"), "vec"), SCORER).collect()}
    got = {r.id: r for r in worker.answers(table, SCORER, ttl, 200).collect()}
    assert {i: (r.step, r.made_by) for i, r in got.items()} == expected and {s for s, _ in expected.values()} == {"low_quality", "computed", "cached"}
    assert all(r.score is None if r.made_by is None else abs(r.score - scores[r.made_by]) < 1e-9 for r in got.values())

    late = [(999, "k9", base + datetime.timedelta(days=1), 300, "complete", [0.0, 0.0])]
    for part in (rows[:50], rows[50:], late, [(1000, *late[0][1:])]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        requests = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = worker.answer_stream(requests, SCORER, ttl, "1 second", 200)
        query = jobs.telemetry(out, str(tmp_path / "runs"), str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "runs")).where("id < 900").collect()
    assert sorted((r.id, r.step, r.made_by) for r in kept) == sorted((i, *v) for i, v in expected.items())
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # what k9 has: the entries of all others are purged
    with pytest.raises(ValueError, match="threshold"):
        worker.answer_stream(requests, model.Scorer((0.0,), (1.0,), ((1.0,), (1.0,)), (0.0, 0.0), 1.0, 0.0, 7.0), ttl, "1 second")


def test_debounced_stream_equals_the_table(spark, tmp_path, rocks):
    rng, base = random.Random(11), datetime.datetime(2024, 1, 1)
    rows = [(f"u{rng.randrange(6)}", i, base + datetime.timedelta(seconds=40 * i + rng.randrange(90)), rng.choice(["a", "a", "b", None])) for i in range(150)]
    last = base + datetime.timedelta(days=2)
    schema = "user string, event_id long, ts timestamp, kind string"
    quiet = 120.0
    table = spark.createDataFrame(rows, schema)
    expected = {(r.user, r.event_id, r.payload) for r in state.changes(table, "user", "ts", "event_id", F.col("kind"), quiet).collect()}

    def run(part):
        rng.shuffle(part)  # out of order within a batch, and by up to 90 s over batches
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = changes.debounced(events, "user", "ts", "event_id", F.col("kind"), quiet, "120 seconds")
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    for part in (rows[:70], rows[70:], [("other", 999, last, "z")], [("other", 1000, last, "z")]):
        run(list(part))  # each start goes on from the checkpoint
    got = [(r.key, r.tie, r.payload) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) and set(got) - {("other", 999, "z")} == expected and len(expected) > 20
