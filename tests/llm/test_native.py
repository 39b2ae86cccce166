import hashlib
import io
import os
import random
import time
import tracemalloc
import zlib

import pytest

from matchloom import storage
from matchloom.llm import exact_dedup, line_dedup, warc
from matchloom.llm._util import fresh_path

from .common import ascii_lower, empty_docs, hard_docs

BLANKS = " \t\n\x0b\f\r"


def test_exact_dedup_hard_rows(spark):
    rows = exact_dedup.exact_dedup(hard_docs(spark), keep="max").collect()
    assert len(rows) == 15
    source = [(r.doc_id, ascii_lower(r.text)) for r in hard_docs(spark).collect()]
    for r in rows:
        own = {t for i, t in source if i == r.doc_id}.pop()
        same = [i for i, t in source if t == own]
        assert r.group_size == len(same) and r.keep_id == max((i for i in same if i is not None), default=None)
        assert r.kept == (r.doc_id == r.keep_id) and r.text_sha256 == hashlib.sha256(own.encode()).hexdigest()
    assert {r.doc_id for r in exact_dedup.exact_dedup(hard_docs(spark)).collect() if r.kept} == {1, 3, 4, 6, 7, 9, 10, 11, 12, 13, None}
    assert exact_dedup.exact_dedup(empty_docs(spark)).collect() == []


def brute_lines(rows, least):
    key = lambda line: ascii_lower(line).strip(BLANKS)
    seen = {}
    for _, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or seen[key(x)] < least]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_bytes", [storage.BROADCAST_BYTES, -1])
def test_line_dedup_equals_brute_force(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(storage, "BROADCAST_BYTES", broadcast_bytes)
    rows = [(i, "\n".join(["Common\t", f"own {i}", " common", "", "ÄB", f"half {i // 2}"] * (1 + i % 3))) for i in range(12)]
    rows += [(50, None), (51, ""), (52, "common\ncommon"), (53, "common"), (53, "common"), (None, "x\ncommon"), (54, "\n" * 30_000 + "common"), (55, "äb"), (56, " common")]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, pos string, h1 long")
    for least in (2, 3, 10):
        got = line_dedup.line_dedup(df, min_docs=least).collect()
        assert sorted(map(tuple, got), key=str) == brute_lines(rows, least)
    assert line_dedup.line_dedup(empty_docs(spark)).collect() == []


def pages(spark, rows):
    return spark.createDataFrame([(*r, "digest", "x") for r in rows], "page_id long, url string, html string, digest string, path string")


def test_warc_round_trip_in_small_ranges(spark):
    long = "<p>ü" * 300_000
    rows = [(i, f"http://h/{i % 3} x\r\ny", f"page {i} " * (i * 37 % 500)) for i in range(60)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", "same " * 30), (103, "u", "same " * 30), (104, "u", "short"), (105, "u", "short"), (None, "u", "no id " * 40), (106, "u", long), (107, "u", long), (108, "u", "\x1f\x8b\x08 fake \r\n\r\nWARC/1.1\r\n" * 20)]
    manifest = warc.write_warc(warc.with_record_types(pages(spark, rows)), fresh_path(spark, "test-warc"))
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows)
    want = {}
    for i, _, html in rows:
        body = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and len(body) >= 100 and j is not None]
        first = min(same, default=i)
        want[i] = (len(body), hashlib.sha256(body).hexdigest(), "response" if i == first else "revisit", None if i == first else first)
    for split in (1000, 64 << 10, 32 << 20):
        got = warc.read_warc(manifest, split_bytes=split).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == want[r.page_id]
            if r.record_type == "response":
                assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest
    assert warc.archive_pages(spark, pages(spark, rows[:1]).limit(0)).collect() == []


def test_warc_repeats_of_the_smallest_id(spark):
    rows = [(7, "u", "same " * 30), (7, "u", "same " * 30), (9, "u", "same " * 30)]
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.archive_pages(spark, pages(spark, rows)).collect())
    assert got == [(7, "response", None), (7, "response", None), (9, "revisit", 7)]


def nested_archive():
    """An archive whose second record holds archives, one cut short, in bytes that are stored as they are."""
    rng = random.Random(9)
    plain = lambda i, payload: warc.record(i, "http://h/", payload, hashlib.sha256(payload).hexdigest(), None, "2024-01-01T00:00:00Z")
    inner = b"".join(warc._member(plain(900 + i, b"inner %d " % i * 40), 6) for i in range(30))
    payloads = [b"first " * 50, rng.randbytes(40_000) + inner + rng.randbytes(50_000) + inner[:-7] + rng.randbytes(9000), b"third", inner, rng.randbytes(70_000), b"last"]
    return payloads, [warc._member(plain(i, p), 0) for i, p in enumerate(payloads)]


def test_warc_archives_within_archives(spark, tmp_path):
    payloads, members = nested_archive()
    whole, hurt = tmp_path / "whole.warc.gz", tmp_path / "hurt.warc.gz"
    whole.write_bytes(b"".join(members))
    hurt.write_bytes(b"".join([members[0][:-9], *members[1:3], b"noise", *members[3:]]))
    want = sorted((i, hashlib.sha256(p).hexdigest()) for i, p in enumerate(payloads))
    for split in (1000, 30_000, 32 << 20):
        for path, first in ((whole, 0), (hurt, 1)):
            manifest = spark.createDataFrame([(str(path), path.stat().st_size)], "path string, bytes long")
            got = sorted((r.page_id, hashlib.sha256(r.payload).hexdigest()) for r in warc.read_warc(manifest, split_bytes=split).collect())
            assert got == want[first:]
    assert warc.record_size(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n") is None
    assert warc.record_size(b"WARC/1.1\r\nWARC-Type: x\r\nWARC-Record-ID: <y>\r\nContent-Length: -3\r\n\r\n") is None


def test_long_records_are_scanned_in_linear_time_and_small_steps():
    noise = warc._member(warc.record(1, "http://a", os.urandom(1 << 20) * 192, "0", None, "2024-01-01T00:00:00Z"), 0)
    began = time.time()
    assert list(warc.chains_in(io.BytesIO(noise), 0, len(noise))) == [(0, len(noise))]
    assert time.time() - began < 12  # twenty and more where each read copies what was read before
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    zeros = 300 << 20
    head = warc._headers([("WARC-Type", "response"), ("WARC-Record-ID", "<a>"), ("Content-Length", str(zeros))])
    packed = b"".join([packer.compress(head), *(packer.compress(bytes(1 << 20)) for _ in range(300)), packer.compress(b"\r\n\r\n"), packer.flush()])
    tracemalloc.start()
    try:
        assert list(warc.chains_in(io.BytesIO(packed), 0, len(packed))) == [(0, len(packed))]
        assert tracemalloc.get_traced_memory()[1] < 30 << 20
    finally:
        tracemalloc.stop()
