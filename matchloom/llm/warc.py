"""WARC archives: a writer for page tables and a splittable reader.

Readers take byte ranges. A range is scanned for the gzip magic; a place is a member if it decodes to WARC headers (version,
type, record id, length) and the member's size agrees with them. Members that follow each other form a chain. Which chains
are the file's own, and not parts of an archive that some payload holds, is settled from the chains' first and last
offsets, in the order of the file; each range's own chain is then read by one task.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import discard, fresh_path, remove, shipped, sliced, written

MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
#: Bytes of a member that its WARC headers take at most.
HEAD_BYTES = 64 << 10
ID_FORM = "<urn:matchloom:page:%s>"

MANIFEST = "path string, records long, bytes long"
RECORDS = (
    "path string, offset long, record_type string, page_id long, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"
)


def with_record_types(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", min_bytes: int = 100) -> DataFrame:
    """Say for each page whether its record is a response or revisits the smallest id with an equal payload.

    Only payloads of `min_bytes` or more are shared. Digests found once don't take part in the join; those found more
    often are written, and broadcast if their size allows it.
    """
    body = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), body.alias("html"), F.sha2(body, 256).alias("digest"))
    shared = written(
        pages.select(F.col(id_col).alias("page_id"), body.alias("html"))
        .where(F.octet_length("html") >= min_bytes)
        .select("page_id", F.sha2("html", 256).alias("digest"))
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
        .select("digest", "first_id"),
        "shared-payloads",
    )
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(shipped(shared, 80), "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(again, F.col("first_id")).alias("refers_to")
    )


def _headers(lines: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record, not compressed. A revisit keeps the HTTP header and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", ID_FORM % ("" if page_id is None else page_id)), ("WARC-Date", date)]
    if url is not None:
        lines.append(("WARC-Target-URI", quote(url, safe="%:/?#[]@!$&'()*+,;=~-._")))
    if refers_to is not None:
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", ID_FORM % refers_to)]
    lines += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return _headers(lines) + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else re.sub(r"^(\w+):/", r"\1:///", uri))


def write_warc(typed: DataFrame, folder: str, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write rows of with_record_types() as .warc.gz files, a gzip member per record and a file per task.

    Returns the manifest (path, records, bytes), written to the shared folder. A task that runs again writes another
    file; only files of tasks that succeeded are in the manifest. `folder` is a URI that pyarrow.fs can write to.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, records = None, 0
        for batch in sliced(batches, "html", 8 * BLOCK):
            if out is None:
                out = fs.open_output_stream(_open(name)[1], compression=None)
            for page_id, url, html, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                out.write(_member(record(page_id, url, html.encode(), digest, refers_to, date), level))
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [records], "bytes": [fs.get_file_info(_open(name)[1]).size]})

    return written(typed.mapInArrow(write, MANIFEST), "warc-manifest")


class _Range:
    """Reads a file forwards from an offset; keeps what was read until it is dropped. Appending and dropping take time by their own size alone."""

    def __init__(self, source, start: int):
        self.source, self.base, self.held, self.ended = source, start, bytearray(), False
        source.seek(start)

    def fill(self, upto: int) -> bool:
        """Hold bytes up to the absolute offset `upto`, as far as the file has them."""
        while not self.ended and self.base + len(self.held) < upto:
            more = self.source.read(BLOCK)
            self.ended = not more
            self.held += more
        return self.base + len(self.held) >= upto

    def drop(self, upto: int) -> None:
        """What lies before `upto` isn't needed; it is given up once it is a block or more."""
        if upto - self.base >= BLOCK:
            del self.held[: upto - self.base]
            self.base = upto

    def at(self, lo: int, hi: int) -> bytes:
        self.fill(hi)
        with memoryview(self.held) as view:
            return bytes(view[lo - self.base : hi - self.base])


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.strip().lower().decode(errors="replace"): v.strip().decode(errors="replace") for k, _, v in pairs}


def record_size(data: bytes) -> int | None:
    """The size of the record that begins with `data`, as its headers have it; None if these aren't whole WARC headers."""
    end = data.find(b"\r\n\r\n", 0, HEAD_BYTES)
    if end < 0 or not re.match(rb"WARC/1\.\d\r\n", data):
        return None
    fields = _fields(data[:end])
    length = fields.get("content-length", "")
    if not (fields.get("warc-type") and fields.get("warc-record-id") and length.isdecimal()):
        return None
    return end + 4 + int(length) + 4


def record_end(r: _Range, offset: int, parts: list[bytes] | None = None) -> int | None:
    """Where the member at `offset` ends if it holds one whole record, else None; `parts` takes what it inflates to.

    It is inflated BLOCK bytes at most at a time, however well it is packed.
    """
    if r.at(offset, offset + len(MAGIC)) != MAGIC:
        return None
    z, at, step, head, size, want = zlib.decompressobj(31), offset, 8 << 10, b"", 0, None
    try:
        while not z.eof:
            chunk = r.at(at, at + step)
            if not chunk:
                return None
            at += len(chunk)
            while chunk and not z.eof:
                data = z.decompress(chunk, BLOCK)
                chunk = z.unconsumed_tail
                size += len(data)
                if parts is not None:
                    parts.append(data)
                if want is None:
                    head += data
                    want = record_size(head)
                    if want is None and (z.eof or len(head) >= HEAD_BYTES or not b"WARC/1.".startswith(head[:7])):
                        return None
                if want is not None and size > want:
                    return None
            at -= len(z.unused_data)
            step = min(2 * step, BLOCK)
    except zlib.error:
        return None
    return at if size == want else None


def chains_in(source, start: int, end: int) -> Iterator[tuple[int, int]]:
    """(first, last) offsets of runs of records that follow each other without a gap and begin in [start, end).

    A run goes on until the first record that begins at `end` or later, or until no record follows. Places behind a run
    or a broken member are looked at one after another.
    """
    r, at, first = _Range(source, start), start, None
    while at < end:
        r.drop(at)
        stop = record_end(r, at)
        if stop is not None:
            first, at = at if first is None else first, stop
            continue
        if first is not None:
            yield first, at
            first = None
        at += 1
        while at < end and r.fill(at + len(MAGIC)):
            found = r.held.find(MAGIC, at - r.base)
            if found >= 0:
                at = r.base + found
                break
            at = r.base + len(r.held) - len(MAGIC) + 1
            r.drop(at)
        else:
            return
    if first is not None:
        yield first, at


def own_chains(chains: pd.DataFrame) -> pd.DataFrame:
    """Of the chains (first, last) of a file those that don't begin within an earlier one."""
    chains = chains.sort_values("first")
    kept, upto = [], 0
    for first, last in zip(chains["first"], chains["last"], strict=True):
        kept.append(first >= upto)
        upto = last if kept[-1] else upto
    return chains[kept]


def records_in(source, first: int, last: int) -> Iterator[tuple[int, bytes]]:
    """The records of a chain, each with its offset."""
    r, at = _Range(source, first), first
    while at < last:
        r.drop(at)
        parts: list[bytes] = []
        stop = record_end(r, at, parts)
        if stop is None:
            raise ValueError(f"the file changed while it was read: no record at {at}")
        yield at, b"".join(parts)
        at = stop


def _page(urn: str | None) -> int | None:
    found = re.search(r":page:(-?\d+)>$", urn or "")
    return int(found[1]) if found else None


def parse(data: bytes) -> dict:
    """The fields of one response or revisit record; a revisit's payload figures come from its headers."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _fields(head)
    block = rest[: int(warc.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = warc.get("warc-type")
    response = kind == "response"
    return {
        "record_type": kind,
        "page_id": _page(warc.get("warc-record-id")),
        "refers_to": _page(warc.get("warc-refers-to")),
        "url": warc.get("warc-target-uri"),
        "payload_bytes": len(payload) if response else int(_fields(http).get("content-length", 0)),
        "payload_digest": hashlib.sha256(payload).hexdigest() if response else warc.get("warc-payload-digest", "").rpartition(":")[2].lower(),
        "payload": payload if response else None,
    }


def read_warc(manifest: DataFrame, split_bytes: int = 32 << 20, tasks: int | None = None, with_payload: bool = True) -> DataFrame:
    """Read .warc.gz files, given as rows (path, bytes), in byte ranges of `split_bytes`.

    Each range is read by one task, which owns the records that start inside; so a file of any size is shared out and
    each record is read once, whatever `split_bytes` is, also if payloads hold archives themselves. For that the ranges
    are inflated twice: once to find their chains, and once to read those that are the file's own. Broken members are
    passed over; of what follows one, all whole records are taken.

    Returns path, offset, record_type, page_id (null unless the record id names one), refers_to, url (as the archive has
    it, percent-quoted), payload_bytes, payload_digest and payload (null for revisits, or if not `with_payload`). Only
    response and revisit records are returned. Digests of responses are computed from the payload that was read. A
    record is held in memory as a whole. Repeated rows of the manifest give an error.
    """
    spark = manifest.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = manifest.where("bytes > 0").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"))
    size = F.when(F.col("n") == 1, F.col("bytes")).otherwise(F.raise_error(F.lit("a path is in the manifest more than once")).cast("long"))
    splits = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), size - 1, F.lit(split_bytes).cast("long"))).alias("start")).repartition(tasks)
    names = [f.split()[0] for f in RECORDS.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, name = _open(path)
                with fs.open_input_file(name) as source:
                    found = list(chains_in(source, start, start + split_bytes))
                if found:
                    first, last = zip(*found, strict=True)
                    yield pa.RecordBatch.from_pydict({"path": [path] * len(found), "first": first, "last": last})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for path, first, last in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "last")), strict=True):
                fs, name = _open(path)
                with fs.open_input_file(name) as source:
                    rows, held = [], 0
                    for offset, data in records_in(source, first, last):
                        row = parse(data)
                        if row["record_type"] not in ("response", "revisit"):
                            continue
                        if not with_payload:
                            row["payload"] = None
                        held += len(row["payload"] or b"")
                        rows.append({"path": path, "offset": offset} | row)
                        if held > 4 * BLOCK or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    shape = "path string, first long, last long"
    own = splits.mapInArrow(scan, shape).groupBy("path").applyInPandas(own_chains, shape)
    return own.repartition(tasks).mapInArrow(read, RECORDS).select(*names)


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None, min_bytes: int = 100, split_bytes: int = 32 << 20) -> DataFrame:
    """Write a WARC record per row of `pages` (page_id, url, html) and read the archives back, without payloads.

    The archives stay if `folder` is given, and else are removed from the shared folder once they were read. Null html is
    an empty payload; a null url leaves its header out, others are percent-quoted in it; a null page_id is read back as
    null. Rows that repeat the smallest id of a shared payload are all responses. A payload of any length is one record,
    held whole by one task. An empty table gives an empty result; other columns, whatever their names, are not read.
    """
    where = folder or fresh_path(spark, "warc")
    manifest = write_warc(with_record_types(pages, min_bytes=min_bytes), where)
    found = written(read_warc(manifest, split_bytes=split_bytes, with_payload=False), "warc-records")
    discard(manifest)
    if not folder:
        remove(spark, where)
    return found
