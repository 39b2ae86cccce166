"""A store of token matrices of different lengths, laid end to end and addressed by ranges of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.sources.files import offset_errors, offsets

#: Rows of a block, which is one binary value.
BLOCK_ROWS = 4096
BLOCKS = "block long, first long, n_rows int, data binary"


def _packed(dimension: int, kind: str, block_rows: int):
    """Sorted rows (place, vec) to blocks of their bytes; a place that is missing or taken twice is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        first = expected = None

        def block() -> pa.RecordBatch:
            data = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array([first // block_rows]), pa.array([first]), pa.array([len(data)], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["block", "first", "n_rows", "data"])

        for batch in batches:
            places = batch.column("place").to_numpy()
            sizes = np.diff(batch.column("vec").offsets.to_numpy())
            if len(places) and not (sizes == dimension).all():
                raise ValueError("a vector has another length than the store")
            rows = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(kind)
            start = 0
            while start < len(places):
                if expected is not None and places[start] // block_rows != first // block_rows:
                    yield block()
                    held, expected = [], None
                if expected is None:
                    first = expected = int(places[start])
                    if first % block_rows:
                        raise ValueError(f"rows before {first} are missing or given twice")
                end = start + int(np.searchsorted(places[start:], (first // block_rows + 1) * block_rows))
                if not np.array_equal(places[start:end], np.arange(expected, expected + end - start)):
                    raise ValueError(f"rows after {expected} are missing or given twice")
                held.append(rows[start:end])
                expected, start = expected + end - start, end
        if expected is not None:
            yield block()

    return run


def write_store(tokens: DataFrame, path: str, dimension: int, kind: str = "<f2", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Write token rows (document_hash, pos, vec) below `path`; returns the index (document_hash, offset, token_count).

    Documents lie end to end, longest first (see files.offsets()). Row offset + pos of the whole matrix has a fixed width,
    `dimension` numbers of `kind` (16-bit floats unless told otherwise), and blocks of `block_rows` rows are one binary
    value each, by number. Tasks take blocks, not documents, so a long document is cut and short ones are put together;
    a task holds one block. Positions of a document must be 0, 1, ... without gaps or repeats: anything else is an error.
    """
    index = offsets(tokens.groupBy("document_hash").agg(F.count(F.lit(1)).alias("token_count")))
    index.write.parquet(f"{path}/index")
    stored = tokens.sparkSession.read.schema(index.schema).parquet(f"{path}/index")
    place = (F.col("offset") + F.col("pos")).alias("place")
    outside = F.assert_true((F.col("pos") >= 0) & (F.col("pos") < F.col("token_count")), F.lit("a position lies outside of its document"))
    rows = tokens.join(stored, "document_hash").where(outside.isNull()).select(place, "vec", F.floor((F.col("offset") + F.col("pos")) / block_rows).alias("block"))
    blocks = rows.repartition("block").sortWithinPartitions("place").select("place", "vec").mapInArrow(_packed(dimension, kind, block_rows), BLOCKS)
    blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")
    return stored


def checked(index: DataFrame, rows: int) -> DataFrame:
    """The index, if its ranges are those of a store of `rows` rows: no hash twice, no bad range, gap, overlap or end beyond."""
    found = offset_errors(index, rows).first().asDict()
    wrong = {k: v for k, v in found.items() if v}
    if wrong:
        raise ValueError(f"the index doesn't fit the store: {wrong}")
    return index


def fetch(path: str, index: DataFrame, dimension: int, kind: str = "<f2", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(document_hash, pos, vec) of the ranges of `index` (document_hash, offset, token_count), read from the store at `path`.

    The index may be a part of the store's own, so that only some documents are read; ranges may not overlap. A block is read once
    and sent once, however many documents lie in it, and blocks that no range touches are left out. A block that is
    missing, has fewer bytes than rows, or ends before a range does is an error.
    """
    blocks = index.sparkSession.read.schema(BLOCKS).parquet(f"{path}/blocks")
    last = F.col("offset") + F.col("token_count") - 1
    pieces = index.select("document_hash", "offset", "token_count", F.explode(F.sequence(F.floor(F.col("offset") / block_rows), F.floor(last / block_rows))).alias("block"))
    wanted = blocks.join(pieces.select("block").distinct(), "block", "left_semi")
    schema = f"document_hash {index.schema['document_hash'].dataType.simpleString()}, pos long, vec array<float>"

    def cut(mine: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        if mine.empty:
            return pd.DataFrame({"document_hash": [], "pos": [], "vec": []})
        number = int(mine["block"].iloc[0])
        if len(stored) != 1:
            raise ValueError(f"block {number} is missing or there twice")
        first, n, data = int(stored["first"].iloc[0]), int(stored["n_rows"].iloc[0]), stored["data"].iloc[0]
        if len(data) != n * dimension * np.dtype(kind).itemsize:
            raise ValueError(f"block {number} is cut short")
        matrix = np.frombuffer(data, kind).reshape(n, dimension).astype(np.float32)
        out = []
        for name, offset, count in zip(mine["document_hash"], mine["offset"], mine["token_count"], strict=True):
            lo, hi = max(offset, number * block_rows), min(offset + count, (number + 1) * block_rows)
            if lo < first or hi > first + n:
                raise ValueError(f"the store ends before the rows of {name}")
            out.append(pd.DataFrame({"document_hash": name, "pos": np.arange(lo - offset, hi - offset), "vec": list(matrix[lo - first : hi - first])}))
        return pd.concat(out)

    return pieces.groupBy("block").cogroup(wanted.groupBy("block")).applyInPandas(cut, schema)
