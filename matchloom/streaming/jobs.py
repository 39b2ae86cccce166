"""The job queue as a state machine: one transition function for batch replay and for streams.

Leases end by themselves: a job whose lease has run out before publication goes back to the queue at that time, by a timer
in streams and before the next event in both. Events may carry the attempt that they speak of; those of earlier
attempts are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEASE_S, MOST_ATTEMPTS, RETRY_S = 6 * 3600, 5, 5
STATE = "job long, status string, attempts long, next_run_at double, owner long, lease_until double, publishing boolean, applied long, refused long, recovered long"


@dataclass
class Job:
    job: int
    status: str = ""
    attempts: int = 0
    next_run_at: float = 0.0
    owner: int = -1
    lease_until: float = 0.0
    publishing: bool = False
    applied: int = 0
    refused: int = 0
    recovered: int = 0

    def row(self) -> tuple:
        return tuple(vars(self).values())


def expire(j: Job, now: float) -> None:
    """Put a job whose lease ended by `now` back into the queue; a publication is left alone, as its outcome isn't known."""
    if j.status == "running" and not j.publishing and j.lease_until <= now:
        j.status, j.owner, j.next_run_at, j.lease_until, j.recovered = "queued", -1, j.lease_until, 0.0, j.recovered + 1


def step(j: Job, kind: str, at: float, worker: int, attempt: int | None = None) -> None:
    """Apply one event: enqueue, claim, publish, complete or fail; an event that isn't allowed is counted as refused."""
    expire(j, at)
    own = j.status == "running" and j.owner == worker and attempt in (None, j.attempts)
    ok = False
    if kind == "enqueue":
        ok = not j.status
        if ok:
            j.status, j.next_run_at = "queued", at
    elif kind == "claim":
        ok = j.status == "queued" and j.next_run_at <= at
        if ok:
            j.status, j.owner, j.attempts, j.lease_until, j.publishing = "running", worker, j.attempts + 1, at + LEASE_S, False
    elif kind == "publish":
        ok = own and not j.publishing and j.lease_until > at
        if ok:
            j.publishing, j.lease_until = True, at + LEASE_S
    elif kind == "complete":
        ok = own
        if ok:
            j.status, j.publishing, j.owner, j.lease_until = "completed", False, -1, 0.0
    elif kind == "fail":
        ok = own
        if ok:
            j.status = "failed" if j.attempts >= MOST_ATTEMPTS else "queued"
            j.publishing, j.owner, j.lease_until, j.next_run_at = False, -1, 0.0, at + RETRY_S * 2 ** max(0, j.attempts - 1)
    j.applied, j.refused = j.applied + ok, j.refused + (not ok)


#: Event types as job events.
KINDS = {"signup": "enqueue", "click": "claim", "view": "publish", "purchase": "complete", "error": "fail"}


def job_events(events: DataFrame) -> DataFrame:
    """(job, kind, at, ts, event_id, worker, attempt) of an event table; a fifth of the events speak of the first attempt."""
    kind = None
    for source, name in KINDS.items():
        hit = F.col("event_type") == source
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    ts = F.col("ts").cast("timestamp")
    attempt = F.when(F.col("event_id") % 5 == 0, F.lit(1)).cast("long")
    worker = F.pmod(F.floor("value"), F.lit(3)).cast("long")
    return events.select(F.col("user_id").cast("long").alias("job"), kind.alias("kind"), (F.unix_micros(ts) / 1e6).alias("at"), ts.alias("ts"), "event_id", worker.alias("worker"), attempt.alias("attempt"))


def _apply(j: Job, rows: pd.DataFrame) -> None:
    rows = rows.sort_values(["at", "event_id"])
    for kind, at, worker, attempt in zip(rows["kind"], rows["at"], rows["worker"], rows["attempt"], strict=True):
        step(j, kind, float(at), int(worker), None if pd.isna(attempt) else int(attempt))


def replay(events: DataFrame, until: float | None = None) -> DataFrame:
    """The state of each job after all its events, in order of time and id, and at the time `until` if that is given.

    The events of one job are held by one task; a job has as many as its attempts allow, and refused ones.
    """

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        j = Job(int(batch["job"].iloc[0]))
        _apply(j, batch)
        if until is not None:
            expire(j, until)
        return pd.DataFrame([j.row()], columns=list(vars(j)))

    return events.drop("ts").groupBy("job").applyInPandas(run, STATE)


def stream(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """The same over a stream of job events: an updated state row of a job for each batch that has events of it, and when its lease ends.

    `late` is how far behind the latest event others may come. Events of a batch are taken in order.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        j = Job(*state.get) if state.exists else Job(int(key[0]))
        if not state.hasTimedOut:
            _apply(j, pd.concat(list(batches)))
        now = state.getCurrentWatermarkMs() / 1000
        expire(j, now)
        state.update(j.row())
        if j.status == "running" and not j.publishing:
            state.setTimeoutTimestamp(int(j.lease_until * 1000) + 1)
        yield pd.DataFrame([j.row()], columns=list(vars(j)))

    return events.withWatermark("ts", late).groupBy("job").applyInPandasWithState(run, STATE, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def telemetry(events: DataFrame, folder: str, checkpoint: str):
    """Write a stream of events (any columns) to a folder, each batch once: a batch that runs again replaces its own files."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id:012d}")

    return events.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
