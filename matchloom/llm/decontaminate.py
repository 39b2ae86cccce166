"""Benchmark items inside long documents: size-partitioned MinHash containment search, verified on exact shingles.

Items are partitioned by the size of their shingle set, [2^p, 2^(p+1)). For each partition documents are cut into windows
of WINDOW * 2^p shingles, so that a contained item makes up a fair share of the windows that it lies in, however long
the document is. Items and windows get MinHash signatures, one value a band. If a document contains a share t of an
item of n shingles, in one place or in several, a register of the item equals that of some window with a probability of
t n / (n + window) at least; so the threshold on containment gives the number of registers that a partition needs for a
miss to be as rare as MISS. Candidates are verified on their whole shingle sets.

Items of one form (a common header, say) share register values, and so do all documents with that form. A value of more
than FEW_ITEMS items therefore makes a candidate only if the document also has one of the item's rarest shingles: of
n shingles at least ceil(t n) are in a document that contains the item, so one of any n - ceil(t n) + 1 is, and these are chosen by
how few items have them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import discard, raw_texts, shipped, sliced, text_key, written
from .shingles import SHINGLE_WORDS, WordHashes, combine, shingle_set

#: Shingles of a window for each shingle of the partition's smallest item.
WINDOW = 4
#: Probability of missing an item that is contained to just the threshold.
MISS = 1e-6
#: The filter that documents' register values pass has this many bits for each of the items' values, and MOST_BITS at most.
BITS_PER_VALUE, MOST_BITS = 64, 1 << 27
SLICE_BYTES = 384 << 10
#: Items up to which a register value by itself makes candidates.
FEW_ITEMS = 2


def partition_of(size: int) -> int:
    return size.bit_length() - 1


def window_of(part: int) -> int:
    return 1 if part == 0 else WINDOW << part


def registers_of(part: int, threshold: float) -> int:
    """Registers that a partition needs; a single shingle is its own signature."""
    if part == 0:
        return 1
    share = max(threshold, 1e-3) * 2**part / (2**part + window_of(part))
    return math.ceil(math.log(MISS) / math.log1p(-share))


def _constants(name: str, n: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"{name} {i}") | 1 for i in range(n)], dtype=np.uint64)


class Signer:
    """Register values of sets or windows as 64-bit keys that also tell width, partition and register."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.factors = np.empty(0, np.uint64)
        self.salts: dict[tuple[int, int], np.ndarray] = {}

    def of(self, width: int, part: int) -> tuple[np.ndarray, np.ndarray]:
        n = registers_of(part, self.threshold)
        if len(self.factors) < n:
            self.factors = _constants("containment", n)
            self.factors[0] = 1
        if (width, part) not in self.salts:
            self.salts[width, part] = _constants(f"salt {width} {part}", n)
        return self.factors[:n], self.salts[width, part]

    def item(self, width: int, shingles: np.ndarray) -> np.ndarray:
        factors, salts = self.of(width, partition_of(len(shingles)))
        return np.array([(shingles * f).min() for f in factors], dtype=np.uint64) ^ salts

    def windows(self, width: int, parts: list[int], shingles: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys, documents) of the windows of several documents whose shingles are laid end to end; a row a register."""
        ends = np.cumsum(lengths)
        finest = window_of(parts[0])
        starts, owner = _cuts(lengths, finest, ends)
        coarse = {}
        for part in parts[1:]:
            blocks = -(-lengths // finest)
            coarse[part] = _cuts(blocks, window_of(part) // finest, np.cumsum(blocks))
        found: dict[int, list[np.ndarray]] = {p: [] for p in parts}
        buffer = np.empty(len(shingles), np.uint64)
        most = max(registers_of(p, self.threshold) for p in parts)
        self.of(width, max(parts, key=lambda p: registers_of(p, self.threshold)))
        for i in range(most):
            np.multiply(shingles, self.factors[i], out=buffer)
            low = np.minimum.reduceat(buffer, starts)
            for part in parts:
                if i < registers_of(part, self.threshold):
                    own = low if part == parts[0] else np.minimum.reduceat(low, coarse[part][0])
                    found[part].append(own ^ self.of(width, part)[1][i])
        for part in parts:
            yield np.stack(found[part]), owner if part == parts[0] else coarse[part][1]


def _cuts(lengths: np.ndarray, size: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of pieces of `size`, none over two documents, and the document of each."""
    pieces = -(-lengths // size)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return (ends - lengths)[owner] + place * size, owner


ITEMS = "i1 long, i2 long, width int, part int, elements binary, keys array<long>"


def item_table(benchmark: DataFrame, text_col: str, width: int, threshold: float) -> DataFrame:
    """The distinct items that have words: their hash, shingle width, size partition, shingles and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, signer = WordHashes(), Signer(threshold)
        for batch in sliced(batches, "body", SLICE_BYTES):
            rows = []
            for i1, i2, text in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), raw_texts(batch, "body"), strict=True):
                codes = words.codes(text)
                if len(codes):
                    own, shingles = min(width, len(codes)), shingle_set(codes, width)
                    rows.append((i1, i2, own, partition_of(len(shingles)), shingles.tobytes(), signer.item(own, shingles).view(np.int64).tolist()))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["i1", "i2", "width", "part", "elements", "keys"])

    body = F.coalesce(F.col(text_col), F.lit(""))
    return benchmark.select(*text_key(F.col(text_col)), body.alias("body")).dropDuplicates(["k1", "k2"]).mapInArrow(run, ITEMS)


def value_filter(values: DataFrame, n_values: int) -> np.ndarray:
    """A bitmap in which two bits are set for each of `values` (key), from its leading and its last bits; MOST_BITS at most.

    It is made by a native aggregation. With BITS_PER_VALUE one other value in 1,000 passes, with a quarter of it one in 70.
    """
    bits = min(MOST_BITS, max(1 << 15, 1 << (n_values * BITS_PER_VALUE).bit_length()))
    places = F.array(F.shiftrightunsigned("key", 65 - bits.bit_length()), F.col("key").bitwiseAND(F.lit(bits - 1)))
    place = F.col("place") + 1
    parts = values.select(F.explode(places).alias("place")).groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in parts:
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def passing(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values pass the bitmap."""
    bits = len(known) * 8
    first, last = (values >> np.uint64(65 - bits.bit_length())).astype(np.int64), (values & np.uint64(bits - 1)).astype(np.int64)
    return ((known[first >> 3] >> (first & 7).astype(np.uint8)) & (known[last >> 3] >> (last & 7).astype(np.uint8)) & 1).astype(bool)


def document_values(docs: DataFrame, text_col: str, classes: dict[int, list[int]], known: np.ndarray, threshold: float) -> DataFrame:
    """(k1, k2, key): the windows' register values that pass the filter, once for each text hash and value of a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, signer = WordHashes(), Signer(threshold)
        for batch in sliced(batches, "body", SLICE_BYTES):
            found = [words.codes(t) for t in raw_texts(batch, "body")]
            codes, sizes = np.concatenate(found), np.array([len(c) for c in found])
            doc = np.repeat(np.arange(len(found)), sizes)
            rows, keys = [], []
            for width, parts in classes.items():
                if len(codes) < width:
                    continue
                whole = doc[: len(doc) - width + 1] == doc[width - 1 :]
                lengths = np.maximum(sizes - width + 1, 0)
                shingles = combine(codes, width)[whole]
                if not len(shingles):
                    continue
                present = np.flatnonzero(lengths)
                for values, owner in signer.windows(width, parts, shingles, lengths[present]):
                    hit = np.nonzero(passing(known, values))
                    rows.append(present[owner[hit[1]]])
                    keys.append(values[hit])
            if rows:
                pairs = np.unique(np.rec.fromarrays([np.concatenate(rows), np.concatenate(keys).view(np.int64)], names="row,key"))
                if len(pairs):
                    own = pa.array(pairs["row"])
                    yield pa.RecordBatch.from_arrays([batch.column("k1").take(own), batch.column("k2").take(own), pa.array(pairs["key"])], names=["k1", "k2", "key"])

    return docs.select(*text_key(F.col(text_col)), F.col(text_col).alias("body")).mapInArrow(run, "k1 long, k2 long, key long")


def rarest(items: DataFrame, threshold: float) -> DataFrame:
    """(key, i1, i2): of each item's n shingles the n - ceil(threshold n) + 1 that the fewest of `items` have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i1, i2, elements in zip(*(batch.column(c).to_pylist() for c in ("i1", "i2", "elements")), strict=True):
                keys = np.frombuffer(elements, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i1)), pa.array(np.full(len(keys), i2)), pa.array(keys)], names=["i1", "i2", "key"])

    rows = written(items.select("i1", "i2", "elements").mapInArrow(run, "i1 long, i2 long, key long"), "item-shingles")
    counted = rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_items")), "key")
    own = Window.partitionBy("i1", "i2")
    ranked = counted.select("key", "i1", "i2", F.row_number().over(own.orderBy("n_items", "key")).alias("place"), F.count(F.lit(1)).over(own).alias("n"))
    first = written(ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("key", "i1", "i2"), "rarest-shingles")
    discard(rows)
    return first


def shingles_in(bodies: DataFrame, widths: list[int], known: np.ndarray) -> DataFrame:
    """(k1, k2, key): the distinct shingles of texts (k1, k2, body) that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in sliced(batches, "body", SLICE_BYTES):
            for k1, k2, text in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), raw_texts(batch, "body"), strict=True):
                codes = words.codes(text)
                found = np.concatenate([np.empty(0, np.uint64), *(np.unique(combine(codes, w)) for w in widths if len(codes) >= w)])
                keys = found[passing(known, found)]
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k1)), pa.array(np.full(len(keys), k2)), pa.array(keys.view(np.int64))], names=["k1", "k2", "key"])

    return bodies.mapInArrow(run, "k1 long, k2 long, key long")


def candidates(docs: DataFrame, text_col: str, items: DataFrame, hits: DataFrame, values: DataFrame, widths: list[int], threshold: float) -> DataFrame:
    """(k1, k2, i1, i2, matches) of texts and items that share register values; see the module about values of many items."""
    sizes = written(values.groupBy("key").agg((F.count(F.lit(1)) > FEW_ITEMS).alias("many")), "value-sizes")
    sized = values.join(sizes, "key")
    found = hits.join(sized.where("NOT many"), "key").select("k1", "k2", "i1", "i2").distinct()
    common = sizes.where("many").select("key")
    if common.limit(1).count():
        first = rarest(items.join(sized.where("many").select("i1", "i2").distinct(), ["i1", "i2"], "left_semi"), threshold)
        texts = written(hits.join(common, "key", "left_semi").select("k1", "k2").distinct(), "common-texts")
        present = written(shingles_in(bodies_of(docs, text_col, texts), widths, value_filter(first, first.count())), "common-shingles")
        met = present.join(first, "key").select("k1", "k2", "i1", "i2").distinct()
        found = found.unionAll(met).distinct()
    pairs = written(found, "candidate-pairs")
    shared = pairs.join(hits, ["k1", "k2"]).join(values, ["i1", "i2", "key"])
    return written(shared.groupBy("k1", "k2", "i1", "i2").agg(F.count_distinct("key").alias("matches")), "candidates")


def bodies_of(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(k1, k2, body): the texts with the wanted hashes, each once."""
    keyed = docs.select(*text_key(F.col(text_col)), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    return keyed.join(shipped(wanted, 16), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("body").alias("body"))


def contained(docs: DataFrame, benchmark: DataFrame, text_col: str, item_text_col: str, threshold: float, width: int) -> DataFrame | None:
    """Links (k1, k2, i1, i2, part, matches, n_item_shingles, n_shared) between text hashes of documents and items, written; None without items."""
    items = written(item_table(benchmark, item_text_col, width, threshold), "benchmark-items")
    values = items.select(F.explode("keys").alias("key"), "i1", "i2")
    classes: dict[int, list[int]] = {}
    for r in sorted(items.select("width", "part").distinct().collect()):  # a few widths times the log of the largest item
        classes.setdefault(r.width, []).append(r.part)
    if not classes:
        discard(items)
        return None
    known = value_filter(values, values.count())
    hits = written(document_values(docs, text_col, classes, known, threshold), "window-values")
    pairs = candidates(docs, text_col, items, hits, values, sorted(classes), threshold)
    wanted = written(pairs.select("k1", "k2").distinct(), "candidate-texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        codes, sets = np.empty(0, np.uint64), {}
        names = ["k1", "k2", "i1", "i2", "part", "matches"]
        for batch in sliced(batches, "body", 1 << 20):
            at, sizes, shared = [], [], []
            for i, (own, elements, text) in enumerate(zip(batch.column("width").to_pylist(), batch.column("elements").to_pylist(), batch.column("body").cast(pa.binary()).to_pylist(), strict=True)):
                if text is not None:  # the text comes before its items
                    codes, sets = words.codes(text), {}
                    continue
                if own not in sets:
                    sets[own] = np.unique(combine(codes, own)) if len(codes) >= own else np.empty(0, np.uint64)
                at.append(i)
                sizes.append(len(elements) // 8)
                shared.append(len(np.intersect1d(sets[own], np.frombuffer(elements, np.uint64), assume_unique=True)))
            kept = batch.select(names).take(pa.array(at, pa.int64()))
            out = pa.RecordBatch.from_arrays([*kept.columns, pa.array(sizes, pa.int64()), pa.array(shared, pa.int64())], names=[*names, "n_item_shingles", "n_shared"])
            yield out.filter(pa.array(np.array(shared) >= threshold * np.array(sizes) - 1e-9, pa.bool_()))

    none = lambda kind: F.lit(None).cast(kind)
    asked = pairs.join(items.drop("keys"), ["i1", "i2"]).select("k1", "k2", "i1", "i2", "width", "part", "elements", "matches", none("string").alias("body"))
    whole = bodies_of(docs, text_col, wanted).select("k1", "k2", none("long"), none("long"), none("int"), none("int"), none("binary"), none("long"), "body")
    full = asked.unionAll(whole).repartition("k1", "k2").sortWithinPartitions("k1", "k2", F.asc_nulls_first("i1"), "i2")
    links = written(full.mapInArrow(run, "k1 long, k2 long, i1 long, i2 long, part int, matches long, n_item_shingles long, n_shared long"), "benchmark-links")
    discard(items, hits, pairs, wanted)
    return links


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.75, width: int = SHINGLE_WORDS) -> DataFrame:
    """Pairs (document id, item id) where the document contains `threshold` or more of the item's word shingles.

    Returns the ids, in their own types, n_item_shingles, n_shared, containment and sketch_containment (the estimate
    from the registers). A-Z are lower-cased and words split at ASCII blanks; an item of fewer words than `width` is one
    shingle of all its words. An item contained to just the threshold is missed with a probability of MISS; what is
    returned is exact but for 64-bit hashes of shingles.

    Documents are signed in one scan with no shuffle; only register values that pass a bitmap of the items' values are
    joined with these. Texts are known by a 128-bit hash, so equal texts are verified once. Very long texts only have
    more windows. Null or blank texts and items are in no pair; null ids are returned as they are. Repeated rows give
    repeated pairs. Other columns are not read; if either table is empty the result is.
    """
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, item_id {benchmark.schema[item_id_col].dataType.simpleString()}, n_item_shingles long, n_shared long, containment double, sketch_containment double"
    links = contained(docs, benchmark, text_col, item_text_col, threshold, width)
    if links is None:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    i1, i2 = text_key(F.col(item_text_col))
    names = benchmark.select(i1.alias("i1"), i2.alias("i2"), F.col(item_id_col).alias("item_id"))
    rows = docs.select(*text_key(F.col(text_col)), F.col(id_col).alias("id"))
    by_part = lambda of: F.element_at(F.array(*(F.lit(of(p)).cast("long") for p in range(40))), F.col("part") + 1)
    registers = by_part(lambda p: registers_of(p, threshold))
    windows = by_part(lambda p: window_of(p) if p else 0)
    n = F.col("n_item_shingles")
    estimate = F.least(F.lit(1.0), F.col("matches") / registers * (n + windows) / n)
    return rows.join(shipped(links.join(names, ["i1", "i2"]), 72), ["k1", "k2"]).select(
        F.col("id").alias(id_col), "item_id", "n_item_shingles", "n_shared", (F.col("n_shared") / n).alias("containment"), estimate.alias("sketch_containment")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", threshold: float = 0.75, width: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of `docs`, all columns, whose text contains no item: the search of leaks() and an anti-join by text hash.

    Ids are not looked at. Null and blank texts stay, and so does everything if there is no item.
    """
    links = contained(docs, benchmark, text_col, item_text_col, threshold, width)
    if links is None:
        return docs
    gone = written(links.select("k1", "k2").distinct(), "leaked-texts")
    discard(links)
    k1, k2 = text_key(F.col(text_col))
    rows = docs.select(F.struct("*").alias("row"), k1, k2)
    return rows.join(shipped(gone, 16), ["k1", "k2"], "left_anti").select("row.*")
