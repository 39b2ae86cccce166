"""Pairs of texts that are nearly the same, by the share of their longest common subsequence."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.graph import components
from matchloom.storage import discard, shipped, written

#: The key of an empty text.
EMPTY = hashlib.sha256(b"").hexdigest()
#: Classes of letters, those of them that are looked at first, and texts that are looked at together.
BUCKETS, FIRST_BUCKETS, TEXTS_AT_ONCE = 64, 16, 16
#: Classes of grams in a profile, at least and at most, and bytes of such profiles that are looked at together.
LEAST_CLASSES, MOST_CLASSES, PROFILE_BYTES = 256, 16_384, 1 << 22
#: Texts of a block and bytes of their profiles, at most; bytes of texts' profiles that are sent on at once; texts for which there is another task, if there are blocks for it.
BLOCK_TEXTS, BLOCK_BYTES, SENT_BYTES, TEXTS_OF_TASK = 16_384, 1 << 25, 1 << 22, 64
#: Letters of a gram at most, and the log of the number of cells in which grams are counted.
MOST_LETTERS, CELL_BITS = 32, 18
#: Grams of a window at most, and letters of pairs (of long ones more) that are compared in full together, about, and tasks for them at most.
WINDOW, COST_OF_GROUP, MOST_PARTS = 7, 4_000_000, 256
#: Letters for which a band of letters of the other text is kept, and how many candidates of a text are compared in the rounds of linked() before its last.
BAND_STEP, LINK_ROUNDS = 256, (1, 4, 16)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: equal ends, and between them a bit for each character of `a`."""
    ahead = len(os.path.commonprefix((a, b)))
    a, b = a[ahead:], b[ahead:]
    behind = len(os.path.commonprefix((a[::-1], b[::-1])))
    return ahead + behind + _common_bits(a[: len(a) - behind], b[: len(b) - behind])


def _common_bits(a: str, b: str) -> int:
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * common_length(a, b) / (len(a) + len(b))


def common_within(a: str, b: str, edits: int) -> int:
    """As common_length() if the texts differ by `edits` insertions and deletions at most, else some smaller number.

    Of b's letters up to any place no more may be left out than edits allow, so only a band of a's letters around that place is
    kept; a run of BAND_STEP letters of b is done with one band, and nothing more is done once too many are left out.
    """
    ahead = len(os.path.commonprefix((a, b)))
    a, b = a[ahead:], b[ahead:]
    behind = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - behind], b[: len(b) - behind]
    only_a, only_b = (edits + len(a) - len(b)) // 2, (edits + len(b) - len(a)) // 2  # letters of one text alone, at most
    if only_a < 0 or only_b < 0:
        return 0
    low = high = passed = 0
    s = 0
    at: dict[str, int] = {}  # where the band has a letter
    for start in range(0, len(b), BAND_STEP):
        piece = b[start : start + BAND_STEP]
        new_low, new_high = min(len(a), max(0, start - only_b)), min(len(a), start + len(piece) + only_a)
        s |= (1 << new_high - low) - (1 << high - low)
        gone = new_low - low
        passed += gone - (s & (1 << gone) - 1).bit_count()
        s >>= gone
        at = {c: m >> gone for c, m in at.items()}
        new = a[high:new_high]
        for c in set(new):
            m, i = 0, new.find(c)
            while i >= 0:
                m |= 1 << i
                i = new.find(c, i + 1)
            at[c] = at.get(c, 0) | m << high - new_low
        low, high = new_low, new_high
        for c in piece:
            u = s & at.get(c, 0)
            s = (s + u) | (s - u)  # bits beyond the band never come back into it
        s &= (1 << high - low) - 1
        if start + len(piece) - passed - (high - low - s.bit_count()) > only_b:
            return 0
    return ahead + behind + passed + high - low - s.bit_count()


def ratio_from(a: str, b: str, threshold: float) -> float:
    """As ratio() if that is the threshold at least, else some smaller number."""
    return 100.0 if not a and not b else 200.0 * common_within(a, b, int((100 - threshold) / 100 * (len(a) + len(b)) + 1e-6)) / (len(a) + len(b))


def most_edits(n: int, threshold: float) -> int:
    """Insertions and deletions by which a text of n letters and any partner at the threshold differ at most."""
    return int(2 * (100 - threshold) / threshold * n + 1e-9)


def gram_letters(threshold: float) -> int:
    """Letters of a gram, so few that every text has room for one more of them, side by side, than it may have edits."""
    if threshold <= 200 / 3:
        raise ValueError("a threshold over two thirds is needed")
    if threshold >= 100:
        return MOST_LETTERS
    return max(1, min(MOST_LETTERS, int(threshold / (4 * (100 - threshold)) + 1e-9)))


def gram_codes(text: str, letters: int) -> np.ndarray:
    """A 64-bit code for each run of `letters` letters; a shorter text is one gram."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    own = min(letters, len(points))
    code = np.full(max(0, len(points) - own + 1), own, np.uint64)
    for j in range(own):
        code = (code ^ points[j : len(points) - own + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return code


def _cells(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def sure_run(n: int, threshold: float) -> int:
    """Letters of the longest run that a text of n letters shares unchanged with any other partner at the threshold, at least; 0 if it has none.

    d edits leave d + 1 runs at most, which together have half the letters of both texts less d. As d edits need
    100 d / (100 - threshold) letters in both texts, the mean run is shortest for the smallest d that lengths allow.
    """
    if not most_edits(n, threshold):
        return 0
    least = max(1, int((100 - threshold) * 2 * n / (200 - threshold) - 1e-9))
    return int(np.ceil(threshold * least / (2 * (100 - threshold) * (least + 1)) - 1e-9))


def window_of(n: int, threshold: float) -> int:
    """Grams of a window of a text of n letters; 0 if it has no partners. WINDOW at most, so that partners share many (see least_shared())."""
    return max(0, min(WINDOW, sure_run(n, threshold) - gram_letters(threshold) + 1)) if threshold < 100 else 0


def chosen(codes: np.ndarray, levels: np.ndarray, window: int) -> np.ndarray:
    """Places of the grams that come first in some run of `window` grams, by how common they are, then by code.

    All that come equally early are taken, so that what is chosen in a run depends on its grams alone. A narrower window
    chooses the same grams and more.
    """
    order = levels[_cells(codes)].astype(np.uint64) << np.uint64(56) | codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(8)
    window = min(window, len(order))
    least = order[: len(order) - window + 1].copy()
    for j in range(1, window):
        np.minimum(least, order[j : len(order) - window + 1 + j], out=least)
    keep = np.zeros(len(order), bool)
    for j in range(window):
        keep[j : j + len(least)] |= order[j : j + len(least)] == least
    return np.flatnonzero(keep)


def partner_ratio(threshold: float) -> float:
    """How many times as long as a text a partner at the threshold is, at most."""
    return (200 - threshold) / threshold


def band_width(threshold: float) -> float:
    """Lengths of a band lie within this ratio; partners are in one band or in neighbouring ones."""
    return max(1.1, partner_ratio(threshold) ** 2)


def band_of(n: np.ndarray, width: float) -> np.ndarray:
    return np.floor(np.log(n) / np.log(width)).astype(np.int64)


def gram_classes(band: int, width: float) -> tuple[int, int]:
    """(letters of a gram, classes of grams) for the texts of a band and those that are compared with them."""
    low = max(1.0, width**band)
    bits = int(np.log2(low)) - (low < 4096)
    return 4 + (low >= 8192) + (low >= 32768), min(MOST_CLASSES, max(LEAST_CLASSES, 1 << max(0, bits)))


@dataclass
class Texts:
    """Texts of rising length: ids, lengths, counts of letters (a row each), counts of classes of grams (a byte each, 255 stands for more)."""

    ids: np.ndarray
    n: np.ndarray
    letters: np.ndarray
    grams: np.ndarray

    def joined(self, other: Texts) -> Texts:
        both = [np.concatenate([getattr(self, c), getattr(other, c)]) for c in ("ids", "n", "letters", "grams")]
        order = np.argsort(both[1], kind="stable")
        return Texts(*(x[order] for x in both))


def letter_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.minimum(np.bincount(points % BUCKETS, minlength=BUCKETS), 0xFFFF).astype(np.uint16)


def gram_counts(text: str, letters: int, classes: int) -> np.ndarray:
    at = gram_codes(text, letters) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(65 - classes.bit_length())
    return np.minimum(np.bincount(at.astype(np.int64), minlength=classes), 255).astype(np.uint8)


def _least_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of the lesser of two bytes, by row; four sums run within a 64-bit number, of 128 numbers at most, so that none overflows."""
    words, mask = np.minimum(a, b).view(np.uint64), np.uint64(0x00FF00FF00FF00FF)
    twos = (words & mask) + (words >> np.uint64(8) & mask)
    sums = np.add.reduceat(twos, np.arange(0, twos.shape[1], 128), axis=1)
    return sums.view(np.uint16).sum(axis=1, dtype=np.int64)


def near(a: Texts, b: Texts, letters: int, threshold: float, own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, ids, likeness, letters of one of them) of texts of a and b (or of a alone, if these are the same) that the bounds allow to reach the threshold.

    An edit changes the length and the counts of letters by 1, those of grams of q letters by 2 q - 1 at most.
    """
    share, ratio = (100 - threshold) / 100, partner_ratio(threshold)
    kind = np.int16 if max(a.n[-1], b.n[-1]) < 16_000 else np.int32  # a sum of differences is at most both texts' letters
    first = np.argsort(-a.letters.sum(axis=0, dtype=np.int64), kind="stable")[:FIRST_BUCKETS]
    x, y = a.letters[:, first].astype(kind), np.ascontiguousarray(b.letters[:, first].T.astype(kind))
    total_a, total_b = (t.grams.sum(axis=1, dtype=np.int64) for t in (a, b))
    step = max(1, PROFILE_BYTES // a.grams.shape[1])
    for start in range(0, len(a.ids), TEXTS_AT_ONCE):
        at = slice(start, start + TEXTS_AT_ONCE)
        n = a.n[at]
        low, high = np.searchsorted(b.n, n[0] / ratio - 1), np.searchsorted(b.n, n[-1] * ratio + 1, side="right")
        low = max(low, start + 1) if own else low
        if high <= low:
            continue
        edits = np.floor(share * (n[:, None] + b.n[None, low:high]) + 1e-6).astype(kind)
        apart = np.zeros(edits.shape, kind)
        for d in range(len(first)):
            apart += np.abs(y[d, None, low:high] - x[at, d, None])
        i, j = np.nonzero((apart <= edits) & (np.abs(n[:, None] - b.n[None, low:high]) <= edits))
        most = edits[i, j].astype(np.int64)
        i, j = i + start, j + low
        keep = j > i if own else np.ones(len(i), bool)
        keep[keep] = np.abs(a.letters[i[keep]].astype(np.int32) - b.letters[j[keep]]).sum(axis=1) <= most[keep]
        i, j, most = i[keep], j[keep], most[keep]
        for k in range(0, len(i), step):
            l, r = i[k : k + step], j[k : k + step]
            both = total_a[l] + total_b[r]
            differ = both - 2 * _least_sums(a.grams[l], b.grams[r])
            found = differ <= (2 * letters - 1) * most[k : k + step]
            yield a.ids[l[found]], b.ids[r[found]], 1 - differ[found] / np.maximum(1, both[found]), a.n[l[found]]


def _sent_texts(threshold: float, plan: dict[int, tuple[int, int]]):
    """Rows (key, upper, id, n, letters, grams): each text to its block, and as `upper` to the blocks with which its own is compared.

    plan: a band's first key and its number of blocks.
    """
    width, ratio = band_width(threshold), partner_ratio(threshold)
    names = ["key", "upper", "id", "n", "letters", "grams"]
    kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("folded").to_pylist()
            bands = band_of(np.array([len(t) for t in texts], np.float64), width).tolist()
            for i, text, band in zip(ids, texts, bands, strict=True):
                n, letters = len(text), letter_counts(text).tobytes()
                key, blocks = plan[band]
                mine = i % blocks
                targets = [(band, [(key + mine, False), *((key + j, True) for j in range(mine))])]
                if band - 1 in plan and n <= width**band * ratio * (1 + 1e-6) + 1:
                    below, blocks = plan[band - 1]
                    targets.append((band - 1, [(below + j, True) for j in range(blocks)]))
                made: dict[tuple[int, int], bytes] = {}
                for of, keys in targets:
                    how = gram_classes(of, width)
                    if how not in made:
                        made[how] = gram_counts(text, *how).tobytes()
                    rows += [(k, upper, i, n, letters, made[how]) for k, upper in keys]
                    held += len(keys) * (len(letters) + len(made[how]))
                if held > SENT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def _met(threshold: float, plan: dict[int, tuple[int, int]]):
    """Compares the texts of each key's block among themselves and with its `upper` ones, which come in batches after them."""
    width = band_width(threshold)
    letters_of = {key + j: gram_classes(band, width)[0] for band, (key, blocks) in plan.items() for j in range(blocks)}

    def pairs(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for a, b, *more in found:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *map(pa.array, more)], names=["l", "r", "alike", "letters"])

    def texts(batch: pa.RecordBatch) -> Texts:
        rows = lambda c, kind: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(batch.num_rows, -1)
        return Texts(batch.column("id").to_numpy(), batch.column("n").to_numpy().astype(np.int64), rows("letters", np.uint16), rows("grams", np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, open_ = None, None, False
        for batch in batches:
            where = np.stack([batch.column("key").to_numpy(), batch.column("upper").to_numpy(zero_copy_only=False)])
            starts = np.append(0, np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1) if batch.num_rows else []
            for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                k, upper = int(where[0, start]), bool(where[1, start])
                part = texts(batch.slice(start, end - start))
                if open_ and (k != key or upper):
                    yield from pairs(near(block, block, letters_of[key], threshold, own=True))
                    open_ = False
                if k != key:
                    key, block = k, None
                if not upper:
                    block, open_ = block.joined(part) if block else part, True
                elif block:
                    yield from pairs(near(block, part, letters_of[key], threshold))
        if open_:
            yield from pairs(near(block, block, letters_of[key], threshold, own=True))

    return run


def candidates(folded: DataFrame, threshold: float) -> DataFrame:
    """(l, r, alike, letters) of texts (id, folded; distinct, none empty) that may reach the threshold, with the share of grams that they have in common and their length, about; none that does is left out.

    Partners' lengths lie in one band or in neighbouring ones. A band's texts are dealt to blocks of bounded size; a block meets itself, the
    blocks after it and those of the next band, whose texts come to it in batches. What is shuffled are counts of letters and of classes
    of grams; of each pair it is told from these whether edits enough for the threshold can make one of the other.
    """
    gram_letters(threshold)  # refuses thresholds that are too low
    width = band_width(threshold)
    sized = folded.select("id", "folded", F.floor(F.log(F.length("folded").cast("double")) / F.lit(float(np.log(width)))).cast("int").alias("about"))
    counts: dict[int, int] = {}
    for r in sized.groupBy("about").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each band
        counts[r.about] = r.n
    plan, key = {}, 0
    for band in sorted({c + d for c in counts for d in (-1, 0, 1)}):  # roundings may differ by one band from those of a task
        rows = max(1, min(BLOCK_TEXTS, BLOCK_BYTES // (gram_classes(band, width)[1] + 2 * BUCKETS)))
        plan[band] = (key, max(1, -(-counts.get(band, 0) // rows)))
        key += plan[band][1]
    sent = folded.select("id", "folded").mapInArrow(_sent_texts(threshold, plan), "key int, upper boolean, id long, n int, letters binary, grams binary")
    dealt = sent.repartition(min(2 * key, 1 + sum(counts.values()) // TEXTS_OF_TASK), "key").sortWithinPartitions("key", "upper", "n")
    return dealt.mapInArrow(_met(threshold, plan), "l long, r long, alike double, letters long")


def prepared(docs: DataFrame, *folders: str, normal: Callable[[str], str] = str) -> DataFrame:
    """The rows of documents (text and others) with case-folded texts in place of texts, written: adds id, key (of the folded text) and hash, if they have none.

    Texts are brought to their `normal` form first.
    """
    others = [f for f in docs.schema.fields if f.name != "text"]
    new = ["key string", "folded string"] + ([] if "hash" in docs.columns else ["hash string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda texts: pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])
        for batch in batches:
            texts = [normal(t or "") for t in batch.column("text").to_pylist()]
            low = [t.casefold() for t in texts]
            made = {"key": sha(low), "folded": pa.array(low, pa.string())} | ({} if "hash" in batch.schema.names else {"hash": sha(texts)})
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), *made.values()], names=[f.name for f in others] + list(made))

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in others] + new)
    found = docs.select(*(f.name for f in others), "text").mapInArrow(run, schema)
    return written(found.withColumn("id", F.monotonically_increasing_id()), "folded-texts", *folders)


def without(texts: DataFrame, gone: DataFrame) -> DataFrame:
    """Texts but those with an id of `gone`; texts stay where they are if these are few."""
    return texts.join(shipped(gone, 8), "id", "left_anti")


def _searched(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(hash, key) of documents, (id, key) of distinct case-folded texts that aren't empty, their candidates, and (id, folded) of those that are in one.

    Of equal texts the first by id is searched, which is told by ids and keys alone.
    """
    if "folded" not in docs.columns:
        docs = prepared(docs.select("hash", "text"))
    members = written(docs.select("hash", "key").distinct(), "member-keys")
    once = docs.groupBy("key").agg(F.min("id").alias("id"))
    folded = without(docs.select("id", "key", "folded"), written(docs.select("id").join(once, "id", "left_anti"), "repeated-texts")).where("folded <> ''")
    close = written(candidates(folded, threshold), "close-pairs")
    met = written(close.select(F.col("l").alias("id")).union(close.select("r")).distinct(), "close-texts")
    texts = written(folded.select("id", "folded").join(shipped(met, 8), "id", "left_semi"), "candidate-texts")
    return members, written(folded.select("id", "key"), "text-keys"), close, texts


def _compared(texts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(l, r, similarity) of those of the written pairs (l, r) that reach the threshold.

    Pairs are dealt by the first partner of their first text, which copies of one text share; those with much work are cut into a square of
    groups. A text is sent once to each group that needs it. (l, r, letters) are enough.
    """
    cost = F.col("letters") * (1 + F.col("letters") / 8192)
    pairs = pairs.select("l", "r", cost.alias("cost"))
    groups = int((pairs.agg(F.sum("cost")).first()[0] or 0) // COST_OF_GROUP) + 1
    first = pairs.groupBy(F.col("r").alias("l")).agg(F.min("l").alias("first"))
    named = written(pairs.join(first, "l", "left").select("l", "r", "cost", F.coalesce("first", "l").alias("family")), "families")
    sides = named.groupBy("family").agg(F.ceil(F.sqrt(F.sum("cost") / COST_OF_GROUP)).alias("sides")).where("sides > 1")
    side = lambda c: F.pmod(F.xxhash64(c), F.coalesce("sides", F.lit(1)))
    dealt = named.join(sides, "family", "left").select("l", "r", F.pmod(F.xxhash64("family", side("l"), side("r")), F.lit(groups)).cast("int").alias("group"))
    dealt = written(dealt, "dealt-pairs")
    ends = dealt.select("group", F.col("l").alias("id")).union(dealt.select("group", "r")).distinct()
    texts = texts.join(ends, "id").select(F.col("group").alias("group"), "id", "folded")  # a new column, as both sides come from one table

    def run(mine: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        text = dict(zip(held["id"], held["folded"], strict=True))
        s = [ratio_from(text[a], text[b], threshold) for a, b in zip(mine["l"], mine["r"], strict=True)]
        out = mine[["l", "r"]].assign(similarity=np.array(s, np.float64))
        return out[out["similarity"] >= threshold]

    parts = min(groups, MOST_PARTS)
    both = dealt.repartition(parts, "group").groupBy("group").cogroup(texts.repartition(parts, "group").groupBy("group"))
    return both.applyInPandas(run, "l long, r long, similarity double")


def linked(docs: DataFrame, threshold: float = 97.0) -> DataFrame:
    """(hash, cluster) of all documents (hash, text), as clusters() of near_duplicates(), without listing all pairs.

    Candidates are compared in rounds, those that are most alike first: in each round a text takes its first few, and what lies within one
    component of the links so far is left out, as it can't change the result. The last round compares all that is
    still open, so no link between different components is lost.
    """
    members, folded, close, texts = _searched(docs, threshold)
    found = written(folded.select(F.col("id").alias("vertex"), F.col("id").alias("component")), "linked-texts")
    for quota in (*LINK_ROUNDS, None):
        own = found.select("vertex", "component")
        apart = close.join(own.toDF("l", "lc"), "l").join(own.toDF("r", "rc"), "r").where("lc <> rc").select("l", "r", "alike", "letters")
        left = written(apart, "open-pairs")
        discard(close)
        close = left
        if quota:
            by = lambda c, other: F.row_number().over(Window.partitionBy(c).orderBy(F.desc("alike"), other)) <= quota
            marked = written(left.withColumns({"a": by("l", "r"), "b": by("r", "l")}).select("l", "r", "alike", "letters", (F.col("a") | F.col("b")).alias("now")), "ranked-pairs")
            discard(left)
            now, close = marked.where("now"), marked.where("NOT now").drop("now")
            close._matchloom_path = marked._matchloom_path
        else:
            now = left
        if not now.limit(1).count():
            break
        links = _compared(texts, now, threshold).select(F.col("l").alias("src"), F.col("r").alias("dst"))
        known = own.where("vertex <> component").toDF("src", "dst")
        joined = components(links.union(known))
        new = written(own.join(joined.toDF("vertex", "joined"), "vertex", "left").select("vertex", F.coalesce("joined", "component").alias("component")), "linked-texts")
        discard(found, joined)
        found = new
    docs = members.select("hash").distinct()
    of_key = folded.select("id", "key").join(found.select(F.col("vertex").alias("id"), "component"), "id").select("key", "component")
    placed = written(members.join(of_key, "key").select("hash", "component"), "linked-members")
    first = placed.groupBy("component").agg(F.min("hash").alias("cluster"))
    return docs.select("hash").join(placed.join(first, "component").select("hash", "cluster"), "hash", "left").select("hash", F.coalesce("cluster", "hash").alias("cluster"))


def near_duplicates(docs: DataFrame, threshold: float = 97.0) -> DataFrame:
    """(left_hash, right_hash, similarity) of distinct documents (hash, text) at or over the threshold (more than 200 / 3).

    Texts are case-folded, and those that become equal are searched once. Candidates come from counts of letters and grams
    (see candidates()), and texts are joined to these pairs only. Empty texts are in no pair. Rows of prepared() will do as well.
    """
    members, folded, close, texts = _searched(docs, threshold)
    members = members.where(F.col("key") != EMPTY)
    linked = _compared(texts, close, threshold)
    keys = folded.select("id", "key")
    linked = linked.join(keys.toDF("l", "lk"), "l").join(keys.toDF("r", "rk"), "r").select("lk", "rk", "similarity")
    named = members.select("hash", "key")
    left, right = named.toDF("a", "lk"), named.toDF("b", "rk")
    far = linked.join(left, "lk").join(right, "rk").select("a", "b", "similarity")
    same = left.join(right, left.lk == right.rk).where("a < b").select("a", "b", F.lit(100.0).alias("similarity"))
    return far.unionAll(same).select(F.least("a", "b").alias("left_hash"), F.greatest("a", "b").alias("right_hash"), "similarity")


def clusters(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(hash, cluster) of all documents: the smallest hash of its component, its own if it is alone."""
    found = components(pairs.select(F.col("left_hash").alias("src"), F.col("right_hash").alias("dst")))
    return docs.select("hash").distinct().join(found.withColumnRenamed("vertex", "hash"), "hash", "left").select("hash", F.coalesce("component", "hash").alias("cluster"))


def cluster_stats(members: DataFrame, pairs: DataFrame) -> DataFrame:
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_clusters"), F.count_if(F.col("n") > 1).alias("n_larger"), F.max("n").alias("largest")).crossJoin(pairs.agg(F.count(F.lit(1)).alias("n_pairs")))
