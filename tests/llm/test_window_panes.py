"""Panes of clicks against a row-by-row version, with hard rows, empty batches and closed panes."""

import math
from datetime import datetime, timedelta
from zlib import crc32

import pytest

from matchloom.llm import window_panes as panes

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, batch string, hour string, cents string, event string"
START = datetime(1970, 1, 1)
HOUR, DAY = 3_600_000_000, 86_400_000_000


def micros(t):
    return (t - START) // timedelta(microseconds=1)


def brute(rows, n=12):
    """What the contract says, one row and one pane at a time."""
    seen = {}
    for r in rows:
        if r[1] is not None:
            key = (r[1], r[2] or r[1], r[4] is not None, r[4] or "", r[5] is not None, r[5] if r[5] is not None else 0)
            if r[0] not in seen or key < seen[r[0]][0]:
                seen[r[0]] = (key, r)
    dealt = [[] for _ in range(n)]
    for click, (_, r) in seen.items():
        day = micros(r[2] or r[1]) // DAY
        q = day % n
        fold = 0 if click is None else max(0, crc32(str(click).encode()) % 30 - 23)
        event = micros(r[1]) - (day - q) * DAY
        v = r[5]
        cents = 0 if v is None or math.isnan(v) or abs(v) >= 9e16 else math.floor(100 * v + 0.5)
        dealt[min(n - 1, q + fold)].append((event, -1 if click is None else click, "none" if r[4] is None else r[4], event // HOUR, cents))
    out, held, w = [], {}, -math.inf
    for b, batch in enumerate(dealt):
        fresh = {}
        for _, click, kind, hour, cents in batch:
            if w >= (hour + 1) * HOUR + 3 * DAY:
                out.append((b, hour, click, 1, cents, "late", kind))
            else:
                had = fresh.get((kind, hour), (0, 0))
                fresh[kind, hour] = (had[0] + 1, had[1] + cents)
        for p in set(fresh) | set(held):
            count, cents, emitted = held.get(p, (0, 0, False))
            new = (count + fresh.get(p, (0, 0))[0], cents + fresh.get(p, (0, 0))[1])
            if emitted and p in fresh:
                out += [(b, p[1], -1, count, cents, "retract", p[0]), (b, p[1], -1, *new, "replace", p[0])]
            if not emitted and w >= (p[1] + 1) * HOUR + 2 * HOUR:
                out.append((b, p[1], -1, *new, "emit", p[0]))
                emitted = True
            held[p] = (*new, emitted)
        held = {p: v for p, v in held.items() if w < (p[1] + 1) * HOUR + 3 * DAY}
        w = max([w, *(r[0] for r in batch)])
    return sorted(out + [(n - 1, p[1], -1, c, s, "final", p[0]) for p, (c, s, e) in held.items() if not e])


def clicks():
    rows, base = [], datetime(2024, 1, 1)
    for i in range(900):
        ts = base + timedelta(minutes=37 * i + i % 7, microseconds=i)
        arrived = ts + timedelta(hours=(i * i) % 190 if i % 5 == 0 else 0)
        rows.append((i, ts, arrived, 1, [None, "view", "click"][i % 3], [None, 1.005, -2.345, 1e300, float("nan")][i % 5], "{}"))
    rows += rows[:40]  # repeats
    rows += [(i, base, base, 1, "zzz", 1.0, None) for i in range(3)]  # ids again, with other values
    rows += [(5000, None, base, 1, "view", 1.0, None), (None, base, base, 1, "view", 3.0, None), (None, base, base, 1, "view", 4.0, None), (5001, base, None, 1, "", 2.0, None)]
    rows += [(6000 + i, datetime(1969, 12, 1) + timedelta(hours=i), base + timedelta(days=i % 12), 1, "old", 1.5, None) for i in range(60)]
    return rows


def records(spark, rows, n=12):
    table = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)
    got = panes.revised_panes(panes.click_batches(table, n), n, shards=3)
    assert got.columns == ["batch", "hour", "click_id", "n_rows", "cents", "record", "kind"]
    return sorted(map(tuple, got.collect()))


def test_records_equal_those_of_single_rows(spark):
    rows = clicks()
    expected = brute(rows)
    assert {r[5] for r in expected} == {"late", "emit", "retract", "replace", "final"}
    assert records(spark, rows) == expected


@pytest.mark.parametrize("days", [(), (0, 0, 2)])
def test_empty_batches(spark, days):
    rows = [(i, datetime(2024, 1, 1) + timedelta(days=d, hours=5 * i), datetime(2024, 1, 1) + timedelta(days=d), 1, "view", 1.0, "") for i, d in enumerate(days)]
    assert records(spark, rows, 3) == brute(rows, 3)


def test_wall_clock_is_read_without_a_zone(spark):
    rows = clicks()[:50]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = panes.click_batches(spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA))
        first = {r["click_id"]: r["event"] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    for r in rows:
        day = micros(r[2]) // DAY
        assert first[r[0]] == micros(r[1]) - (day - day % 12) * DAY


def test_stores_are_closed_after_their_batch(spark):
    """No store of a batch stays open on an executor: there are as many as partitions for each start of the query."""
    rows = spark.createDataFrame([(i, START + timedelta(hours=i), START + timedelta(hours=i), None, "a", 1.0, None, None, None, None, None) for i in range(40)], SCHEMA)
    panes.revised_panes(panes.click_batches(rows)).collect()
    stores = getattr(getattr(spark.sparkContext._jvm.org.apache.spark.sql.execution.streaming.state, "StateStore$"), "MODULE$")
    field = stores.getClass().getDeclaredField("loadedProviders")
    field.setAccessible(True)
    assert field.get(stores).size() == 0
