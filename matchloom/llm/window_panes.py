"""Hourly panes that are revised as late rows come, kept by a stateful streaming query under in-band punctuation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ._util import discard, fresh_path, written

BATCHES = 12
#: Shards of the state; each gets one control row for each batch.
SHARDS = 16
HOUR, DAY = 3_600_000_000, 86_400_000_000
#: Microseconds after a pane's hour ends at which it is due, and at which it is closed.
DUE, CLOSED = 2 * HOUR, 3 * DAY
#: The watermark before any row was seen.
NEVER = -(1 << 62)

#: What a row on its way to the state is.
CONTROL, SUMS, LATE = 0, 1, 2
FEED = "click_id long, kind string, hour long, cents long, w long, last boolean, control boolean, shard int"
PARTIAL = "shard int, what int, kind string, hour long, click_id long, n_rows long, cents long, w long, last boolean"
RECORDS = "batch long, hour long, click_id long, n_rows long, cents long, record string, kind string"
#: Map state needs RocksDB; with a log of changes a commit doesn't upload whole files. There are many small stores, so files aren't preallocated.
#: Each start of the query takes one batch with stores of its own, which would stay open after it, so a store is closed once its task has committed.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def _micros(ts: Column) -> Column:
    """Microseconds since 1970 of a wall clock's reading, whatever the session's time zone."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    return F.unix_date(F.to_date(ts)).cast("long") * DAY + seconds.cast("long") * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def click_batches(clicks: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(batch, event, click_id, kind, hour, cents): clicks dealt to batches by the day they arrived, some of them later.

    Rows without ts are left out; of rows with one click_id the first in the order of (ts, arrived_at, kind, value) counts, and
    so does one of all rows without click_id. D is the day of arrived_at (of ts, where it is null) since 1970 and
    q = D mod `batches`; a row comes in batch q, or up to six batches later by a hash of its click_id, the last taking what
    would come after it. `event` is ts less D - q days in microseconds, `hour` its hour since 1970, `kind` is `none` where null,
    `cents` is floor(100 * value + 0.5), 0 for no value and values that don't fit.
    """
    day = F.unix_date(F.to_date("arrived_at"))
    first = clicks.where("ts IS NOT NULL").groupBy("click_id").agg(F.min(F.struct("ts", F.coalesce("arrived_at", "ts").alias("arrived_at"), "kind", "value")).alias("r")).select("click_id", "r.*")
    fold = F.crc32(F.encode(F.coalesce(F.col("click_id").cast("string"), F.lit("")), "UTF-8")) % 30 - 23
    rows = first.withColumns({"day": day, "q": F.pmod(day, F.lit(batches)), "later": F.greatest(F.lit(0), F.when(F.col("click_id").isNull(), 0).otherwise(fold))})
    event = _micros(F.col("ts")) - (F.col("day") - F.col("q")).cast("long") * DAY
    cents = F.coalesce(F.floor(F.when(F.abs("value") < 9e16, 100 * F.col("value") + 0.5)).cast("long"), F.lit(0))
    return rows.select(
        F.least(F.lit(batches - 1), F.col("q") + F.col("later")).cast("int").alias("batch"),
        event.alias("event"),
        "click_id",
        F.coalesce("kind", F.lit("none")).alias("kind"),
        ((event - F.pmod(event, F.lit(HOUR))) / F.lit(HOUR)).cast("long").alias("hour"),
        cents.alias("cents"),
    )


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums rows of one pane within an Arrow batch; late rows have their click_id and so stay apart."""
    for batch in batches:
        if batch.num_rows:
            found = pa.Table.from_batches([batch]).group_by(["shard", "what", "kind", "hour", "click_id", "w", "last"], use_threads=False).aggregate([("n_rows", "sum"), ("cents", "sum")])
            found = found.rename_columns([c.removesuffix("_sum") for c in found.column_names]).select([c.split()[0] for c in PARTIAL.split(", ")])
            yield from found.to_batches()


class Panes(StatefulProcessor):
    """A shard's panes by (kind, hour), each with the sums so far and whether they were emitted.

    Rows update the panes; the control row, which every shard gets in every batch, then settles what is due, was
    revised, is closed or, in the last batch, is left. What one call holds are the panes of a shard that aren't closed.
    """

    def init(self, handle) -> None:
        self.panes = handle.getMapState("panes", "kind string, hour long", "n long, cents long, emitted boolean")
        self.count = handle.getValueState("batches", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        number = self.count.get()[0] if self.count.exists() else 0
        new: dict[tuple[str, int], list[int]] = {}
        w = last = None
        for part in rows:
            control, late = part[part["what"] == CONTROL], part[part["what"] == LATE]
            if len(control):
                w, last = int(control["w"].iloc[0]), bool(control["last"].iloc[0])
            if len(late):
                yield self._records(number, "late", late["hour"], late["click_id"], late["n_rows"], late["cents"], late["kind"])
            for kind, hour, n, cents in part.loc[part["what"] == SUMS, ["kind", "hour", "n_rows", "cents"]].itertuples(index=False):
                sums = new.setdefault((kind, int(hour)), [0, 0])
                sums[0] += int(n)
                sums[1] += int(cents)
        yield from self._settled(number, new, w, last)
        self.count.update((number + 1,))

    def _settled(self, number: int, new: dict, w: int, last: bool) -> Iterator[pd.DataFrame]:
        held = {(k[0], int(k[1])): (int(v[0]), int(v[1]), bool(v[2])) for k, v in self.panes.iterator()}
        out: list[tuple] = []
        for pane in sorted(set(held) | set(new)):
            n, cents, emitted = held.get(pane, (0, 0, False))
            more, more_cents = new.get(pane, (0, 0))
            sums, end = (n + more, cents + more_cents), (pane[1] + 1) * HOUR
            due, closed = w >= end + DUE, w >= end + CLOSED
            if emitted and pane in new:
                out += [(pane[1], n, cents, "retract", pane[0]), (pane[1], *sums, "replace", pane[0])]
            elif not emitted and (due or last):
                out.append((pane[1], *sums, "emit" if due else "final", pane[0]))
            if closed:
                if pane in held:
                    self.panes.removeKey(pane)
            elif pane in new or (due and not emitted):
                self.panes.updateValue(pane, (*sums, emitted or due))
        if out:
            hours, ns, cents, records, kinds = zip(*out, strict=True)
            yield self._records(number, records, hours, -1, ns, cents, kinds)

    @staticmethod
    def _records(number: int, record, hour, click_id, n_rows, cents, kind) -> pd.DataFrame:
        sizes = {"hour": hour, "click_id": click_id, "n_rows": n_rows, "cents": cents}
        numbers = pd.DataFrame({name: v if np.isscalar(v) else np.asarray(v, np.int64) for name, v in sizes.items()}).astype("int64")
        numbers.insert(0, "batch", number)
        return numbers.assign(record=record if isinstance(record, str) else list(record), kind=list(kind))

    def close(self) -> None:
        pass


def _started(spark: SparkSession, feed: str, records: str, checkpoint: str) -> None:
    """Start the query anew on its checkpoint, let it take what the feed has got since, and stop."""
    rows = spark.readStream.schema(FEED).parquet(feed)
    late = F.col("w") >= (F.col("hour") + 1) * HOUR + CLOSED
    what = F.when(F.col("control"), CONTROL).when(late, LATE).otherwise(SUMS)
    apart = F.when(what == LATE, F.coalesce("click_id", F.lit(-1))).otherwise(-1)
    n_rows = F.when(F.col("control"), 0).otherwise(1).cast("long")
    marked = rows.select("shard", what.alias("what"), "kind", "hour", apart.alias("click_id"), n_rows.alias("n_rows"), "cents", "w", "last")
    out = marked.mapInArrow(_combined, PARTIAL).groupBy("shard").transformWithStateInPandas(Panes(), RECORDS, "Append", "None")
    query = out.writeStream.format("parquet").option("path", records).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def revised_panes(rows: DataFrame, batches: int = BATCHES, shards: int = SHARDS) -> DataFrame:
    """The records of all panes of (batch, event, click_id, kind, hour, cents), batch by batch: see RECORDS.

    Batches are fed to one stateful query in order; it is started anew for each on the same checkpoint. W is the largest
    event of all earlier batches. A pane (kind, hour) is due when W >= the hour's end + 2 hours and closed when
    W >= the end + 3 days. Rows of closed panes are written as `late` (with their click_id; n_rows 1, own cents); other
    rows are added to their pane. Due panes are written once as `emit`; panes emitted by an earlier batch that got rows as
    `retract` (old sums) and `replace` (new ones); closed ones are forgotten; the last batch writes what is left as `final`.

    Punctuation travels in the data: every row carries W and whether its batch is the last, so rows of closed panes are
    told apart before the shuffle, and every shard gets a control row in every batch, also where no row came, upon which it
    settles its panes. Rows of one pane are summed within Arrow batches first and late rows are dealt to shards by
    click_id, so a pane or kind with a third of the rows isn't hot; a shard holds sums of panes, never rows. One number for each
    batch, its largest event, goes to the driver. Feed, checkpoint and records lie in new folders below
    spark.checkpoint.dir at each call. The session's state store provider is set while the query runs.

    Null click ids of late rows are written as -1. Batches without rows and empty tables give control rows only. Other
    columns aren't read. Ties of event times don't matter: sums don't depend on the order.
    """
    spark = rows.sparkSession
    stored = written(rows, "panes-input", "batch")
    largest = {r["batch"]: r["w"] for r in stored.groupBy("batch").agg(F.max("event").alias("w")).collect()}
    feed, records, checkpoint = (fresh_path(spark, f"panes-{name}") for name in ("feed", "records", "checkpoint"))
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        w = NEVER
        for b in range(batches):
            late = F.lit(w) >= (F.col("hour") + 1) * HOUR + CLOSED
            place = F.when(late, F.xxhash64("click_id")).otherwise(F.xxhash64("kind", "hour"))
            rest = [F.lit(w).alias("w"), F.lit(b == batches - 1).alias("last")]
            data = stored.where(F.col("batch") == b).select("click_id", "kind", "hour", "cents", *rest, F.lit(False).alias("control"), F.pmod(place, F.lit(shards)).cast("int").alias("shard"))
            marks = spark.range(0, shards, 1, 1)
            controls = marks.select(F.lit(-1).cast("long"), F.lit(""), F.lit(0).cast("long"), F.lit(0).cast("long"), *rest, F.lit(True), F.col("id").cast("int"))
            data.unionAll(controls).write.mode("append").parquet(feed)
            _started(spark, feed, records, checkpoint)
            w = max(w, largest.get(b, NEVER))
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    discard(stored)
    return spark.read.schema(RECORDS).parquet(records)
