"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.storage import discard, fresh_path, remove, shared_dir, shipped, written

__all__ = ["ascii_lower", "discard", "fresh_path", "kept_by_worker", "let_go", "raw_texts", "remove", "shared_dir", "shipped", "sliced", "table", "text_key", "texts", "written"]

#: What this worker process keeps for its next tasks.
_KEPT: dict[tuple, object] = {}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else; lower() is the faster way where all is ASCII."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def text_key(col: Column) -> tuple[Column, Column]:
    """A 128-bit hash of a text, as columns k1 and k2; null counts as empty."""
    body = F.coalesce(col, F.lit(""))
    return F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2")


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int, most_rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice holds about `limit` bytes of text and `most_rows` rows (one row at least).

    When all are through, the worker gives back what Arrow no longer uses: it lives on for other tasks.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > limit or i - start >= most_rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let_go() -> None:
    """Give back what the worker process kept for another operator's tasks."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()


def kept_by_worker(make: Callable, *args: object):  # noqa: ANN201
    """make(*args), once for each worker process and only until another operator's tasks run in it."""
    key = (make.__module__, make.__qualname__, *args)
    if key not in _KEPT:
        let_go()
        _KEPT[key] = make(*args)
    return _KEPT[key]
