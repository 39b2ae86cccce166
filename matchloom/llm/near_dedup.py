"""Near-duplicate documents by SetSketch registers, banding, joint estimation and exact verification.

Documents with equal shingle sets are one vertex; vertices that share a band of registers are in one bucket. Members are
compared with their bucket's smallest id, and components are formed. Buckets that then still hold several components are
settled band by band: each block of members by itself, then all members with the member that got most links, and only
what is left open by pairs of blocks, members outside the largest component with all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.operators.graph import components

from . import setsketch as ss
from ._util import discard, raw_texts, shipped, sliced, written
from .shingles import SHINGLE_WORDS, WordHashes, shingle_set

SKETCHES = "id long, n_shingles long, f1 long, f2 long, regs array<long>"
#: Rows and shingles of a bucket that one block holds; buckets beyond them are compared block by block.
BLOCK_ROWS = 512
BLOCK_SHINGLES = 1 << 19
#: Members that are compared with one copy of their lead's set.
RUN_ROWS = 512
#: Bands whose open buckets are settled together; what one round joins, the next needn't compare.
ROUNDS = ((0, 4), (4, ss.REGISTERS // ss.BAND_ROWS))


def sketch_table(docs: DataFrame, id_col: str, text_col: str, width: int = SHINGLE_WORDS) -> DataFrame:
    """Per document the size of its shingle set, a 128-bit fingerprint of the set and its registers, as band values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in sliced(batches, "body", 2 << 20):
            sets = [shingle_set(words.codes(t), width) for t in raw_texts(batch, "body")]
            full = [i for i, s in enumerate(sets) if len(s)]
            prints = {i: xxhash.xxh3_128_digest(sets[i].tobytes()) for i in full}
            regs = dict(zip(full, ss.bands(ss.sketches([sets[i] for i in full])).tolist(), strict=True)) if full else {}
            pair = [np.frombuffer(prints[i], np.int64) if i in prints else (None, None) for i in range(len(sets))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([p[0] for p in pair], pa.int64()),
                    pa.array([p[1] for p in pair], pa.int64()),
                    pa.array([regs.get(i) for i in range(len(sets))], pa.list_(pa.int64())),
                ],
                names=["id", "n_shingles", "f1", "f2", "regs"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body")).mapInArrow(run, SKETCHES)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Registers (rows x REGISTERS) of a column of band values."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return ss.unbands(whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1))


def likely(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of `pairs` (a, b) whose registers and sizes leave the threshold possible."""
    left = sets.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("regs").alias("ra"))
    right = sets.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("regs").alias("rb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _matrix(batch.column("ra")), _matrix(batch.column("rb"))
            ok, _ = ss.may_reach(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), (x > y).sum(axis=1), (x < y).sum(axis=1), threshold)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows that agree in `keys`; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            key = tuple(c[lo] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def shingle_sets(bodies: DataFrame, width: int) -> DataFrame:
    """Rows (id, elements): the sorted shingles of each text as bytes of 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in sliced(batches, "body", 1 << 20):
            found = [shingle_set(words.codes(t), width).tobytes() for t in raw_texts(batch, "body")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], names=["id", "elements"])

    return bodies.mapInArrow(run, "id long, elements binary")


def texts_of(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, body) of the documents with these ids."""
    body = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    return body.join(shipped(ids, 8), "id", "left_semi")


def verified(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """Those of `pairs` (a, b) whose full shingle sets reach the threshold, written.

    The members b of a lead a are dealt into runs of about RUN_ROWS; a run gets the lead's set once and then its members.
    """
    pairs = written(pairs, "candidate-pairs")
    if not pairs.limit(1).count():
        return pairs
    wanted = written(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "candidate-ids")
    elements = written(sets_of(wanted), "candidate-sets")
    runs = F.ceil(F.col("n") / RUN_ROWS)
    salted = written(pairs.join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a").select("a", "b", F.pmod(F.xxhash64("b"), runs).cast("int").alias("salt")), "candidate-runs")
    members = salted.join(elements.select(F.col("id").alias("b"), "elements"), "b").select("a", "salt", "b", "elements")
    leads = salted.select("a", "salt").distinct().join(elements.select(F.col("id").alias("a"), "elements"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "elements")
    percent = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = np.empty(0, np.uint64)
        for batch in batches:
            out = []
            for a, b, data in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("elements"), strict=True):
                own = np.frombuffer(data.as_buffer(), np.uint64)
                if b is None:
                    lead = own.copy()
                    continue
                shared = int((lead[np.minimum(np.searchsorted(lead, own), len(lead) - 1)] == own).sum())
                if 100 * shared >= percent * (len(lead) + len(own) - shared):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    dealt = leads.union(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    found = written(dealt.mapInArrow(run, "a long, b long"), "links")
    discard(pairs, wanted, elements, salted)
    return found


def relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (id, label) after `links` (a, b) join more of them; ids without a label are their own, and links between labels are settled alone."""
    if labels is None:
        found = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        out = found.select(F.col("vertex").alias("id"), F.col("component").alias("label"))
        out._matchloom_path = found._matchloom_path
        return out
    ends = written(links.select("a", "b").distinct(), "more-links")
    if not ends.limit(1).count():
        discard(ends)
        return labels
    left, right = (labels.select(F.col("id").alias(e), F.col("label").alias(f"l{e}")) for e in "ab")
    coarse = ends.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("la", "a").alias("src"), F.coalesce("lb", "b").alias("dst"))
    joined = components(coarse)
    alone = ends.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(labels, "id", "left_anti").select("id", F.col("id").alias("label"))
    moved = joined.select(F.col("vertex").alias("label"), "component")
    new = written(labels.unionByName(alone).join(moved, "label", "left").select("id", F.coalesce("component", "label").alias("label")), "labels")
    discard(ends, joined, labels)
    return new


def open_rows(rows: DataFrame, labels: DataFrame) -> DataFrame | None:
    """Bucket rows whose bucket holds several components, each with its label and whether that isn't the bucket's commonest; None without any."""
    labelled = written(rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "labelled-rows")
    per = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    top = per.groupBy("key").agg(F.max(F.struct("n", "s", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    open_keys = written(top.select("key", F.col("top.label").alias("major"), F.col("top.n").alias("major_rows"), F.col("top.s").alias("major_shingles")), "open-buckets")
    if not open_keys.limit(1).count():
        discard(labelled, open_keys)
        return None
    found = written(labelled.join(shipped(open_keys, 48), "key").withColumn("minor", F.col("label") != F.col("major")), "open-rows")
    discard(labelled, open_keys)
    return found


def _blocks(rows: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _single_blocks(rows: DataFrame) -> DataFrame:
    """Each block of a bucket as a cell of its own; each row once."""
    block = F.pmod(F.xxhash64("id"), _blocks(F.col("members"), F.col("shingles"))).cast("int")
    return rows.withColumns({"i": block, "j": block, "block": block})


def _pairs_of_blocks(rows: DataFrame) -> DataFrame:
    """Cells of two blocks: rows outside a bucket's commonest component meet all rows, rows inside it only these."""
    minor_blocks = _blocks(F.col("members") - F.col("major_rows"), F.col("shingles") - F.col("major_shingles"))
    major_blocks = _blocks(F.col("major_rows"), F.col("major_shingles"))
    h = F.xxhash64("id")
    block = F.when(F.col("minor"), F.pmod(h, minor_blocks)).otherwise(minor_blocks + F.pmod(h, major_blocks)).cast("int")
    last = F.when(F.col("minor"), minor_blocks + major_blocks).otherwise(minor_blocks) - 1
    met = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return met.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})


def cell_links(dealt: DataFrame, threshold: float) -> DataFrame:
    """Links between the rows of a cell (key, i, j) that lie in different components, with NumPy.

    A pair is looked at in the first band that it shares, if its bucket's smallest id isn't one of the two; pairs that
    pass the estimate are compared on their full sets. Members that are linked within a cell are joined there, so it
    gives at most as many links as it has members, never all pairs.
    """
    dealt = dealt.select("key", "i", "j", "block", "band", "id", "label", "lead", "regs", "elements")
    percent = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, ["key", "i", "j"]):
            i, j = group["i"][0].as_py(), group["j"][0].as_py()
            block, ids, lead = (group[c].to_numpy() for c in ("block", "id", "lead"))
            band = group["band"][0].as_py()  # a key has one band
            joined = np.unique(group["label"].to_numpy(), return_inverse=True)[1]
            regs = _matrix(group["regs"])
            earlier = ss.bands(regs)[:, :band]
            sets = [np.frombuffer(e, np.uint64) for e in group["elements"].to_pylist()]
            size = np.array([len(x) for x in sets])
            usable = ids != lead
            right = np.flatnonzero((block == j) & usable)
            links = []
            for p in np.flatnonzero((block == i) & usable).tolist():
                q = right[right > p] if i == j else right
                q = q[(joined[q] != joined[p]) & (100 * np.minimum(size[p], size[q]) >= percent * np.maximum(size[p], size[q]))]
                if len(q):
                    q = q[~(earlier[q] == earlier[p]).any(axis=1)]
                if len(q):
                    more, fewer = (regs[p] > regs[q]).sum(axis=1), (regs[p] < regs[q]).sum(axis=1)
                    q = q[ss.may_reach(np.full(len(q), size[p]), size[q], more, fewer, threshold)[0]]
                if not len(q):
                    continue
                mine = sets[p]
                others = np.concatenate([sets[k] for k in q])
                hit = mine[np.minimum(np.searchsorted(mine, others), len(mine) - 1)] == others
                shared = np.add.reduceat(hit, np.cumsum(size[q]) - size[q], dtype=np.int64)
                for k in q[100 * shared >= percent * (size[p] + size[q] - shared)].tolist():
                    if joined[k] != joined[p]:
                        links.append((ids[p], ids[k]))
                        joined[joined == joined[k]] = joined[p]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").distinct()


def settled(rows: DataFrame, labels: DataFrame, sets: DataFrame, sets_of: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """Labels after all pairs within the buckets of `rows` were compared or found to be in one component."""
    regs = sets.select("id", "regs")
    left = open_rows(rows, labels)
    if left is None:
        return labels
    ids = written(left.select("id").distinct(), "open-ids")
    elements = written(sets_of(ids), "open-sets")
    links = written(cell_links(_single_blocks(left).join(regs, "id").join(elements, "id"), threshold), "block-links")
    labels = relabel(labels, links)
    large = rows.where(_blocks(F.col("members"), F.col("shingles")) > 1)
    still = open_rows(large, labels)
    if still is not None:
        degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
        hubs = still.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", "id", "label")).alias("hub")).select("key", F.col("hub.id").alias("a"), F.col("hub.label").alias("hub_label"))
        hubs = written(hubs, "hubs")
        star = still.join(shipped(hubs, 24), "key").where("label <> hub_label").select("a", F.col("id").alias("b")).distinct()
        found = verified(likely(star, sets, threshold), sets_of, threshold)
        labels = relabel(labels, found)
        discard(still, hubs, found)
        still = open_rows(large, labels)
    if still is not None:
        found = written(cell_links(_pairs_of_blocks(still).join(regs, "id").join(elements, "id"), threshold), "block-links")
        labels = relabel(labels, found)
        discard(still, found)
    discard(left, ids, elements, links)
    return labels


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75, width: int = SHINGLE_WORDS) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of `threshold` or more of their word shingles.

    Returns per row: id, n_shingles, component_id (smallest id reachable), kept (id = component_id).

    Vertices that share a band of registers are candidates; the likelihood of the registers' order counts rules most
    out, and each link is confirmed on the full shingle sets of the whole texts. No bucket, group or set is cut. A table
    is broadcast only if its counted rows times their width stay within storage.BROADCAST_BYTES.

    A pair of similarity 0.75 shares no band, and so may be missed, with probability 5e-6, and fails the estimate with
    about 3e-7. Shingles are compared as 64-bit hashes: two texts of 20,000 shingles each have an equal hash of
    different shingles with probability 2e-11, and sets are held to be equal by 128-bit hashes.

    Null or blank texts have no shingles and are linked with nothing; a row without an id is linked with nothing and
    kept. Ids must be integers, else a TypeError is raised; they are taken to be unique, and rows repeated with equal id
    and text are returned each. Ties don't arise: the smallest id stands for a component. Very long texts are sketched
    in parts whose registers merge. An empty table gives an empty result; other columns are not read.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer, not {docs.schema[id_col].dataType.simpleString()}")

    def sets_of(ids: DataFrame) -> DataFrame:
        return shingle_sets(texts_of(ids, docs, id_col, text_col), width)

    sketched = written(sketch_table(docs, id_col, text_col, width), "sketches")
    sets = written(
        sketched.where("f1 IS NOT NULL AND id IS NOT NULL")
        .groupBy("f1", "f2")
        .agg(F.min(F.struct("id", "n_shingles", "regs")).alias("s"))
        .select("f1", "f2", "s.id", "s.n_shingles", "s.regs"),
        "sets",
    )
    banded = sets.select("id", "n_shingles", F.posexplode("regs").alias("band", "value")).select("id", "n_shingles", "band", F.xxhash64("band", "value").alias("key"))
    leads = written(banded.groupBy("key").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("shingles")).where("members > 1"), "buckets")
    rows = written(banded.join(shipped(leads, 40), "key"), "bucket-rows")
    discard(leads)
    links = verified(likely(rows.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), sets, threshold), sets_of, threshold)
    labels = relabel(None, links)
    discard(links)
    for lo, hi in ROUNDS:
        labels = settled(rows.where((F.col("members") > 2) & (F.col("band") >= lo) & (F.col("band") < hi)), labels, sets, sets_of, threshold)
    discard(rows)

    found = (
        sketched.select("id", "n_shingles", "f1", "f2")
        .join(sets.select("f1", "f2", F.col("id").alias("set_id")), ["f1", "f2"], "left")
        .join(labels.select(F.col("id").alias("set_id"), "label"), "set_id", "left")
    )
    component = F.when(F.col("id").isNotNull(), F.coalesce("label", "set_id", "id"))
    out = written(found.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")), "near-copies")
    discard(sketched, sets, labels)
    return out
