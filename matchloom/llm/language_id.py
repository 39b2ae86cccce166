"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram's vector binds (multiplies) its letters' vectors, each
permuted (rolled) by its place; a text's vector bundles (sums) those of its trigrams; a language's prototype bundles
its labelled texts. A text is of the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import let_go, sliced, texts

DIMENSIONS = 1024
#: Trigram vectors that a worker keeps, and that are multiplied at once.
KEPT, AT_ONCE = 16_384, 4096
SLICE_BYTES, SLICE_ROWS = 160 << 10, 4096
#: Texts times trigrams are laid out in full up to so many cells for each letter; else only those that occur are added up.
CELLS_PER_LETTER = 4
BLOCK = 256
UNKNOWN = "und"


@functools.cache
def letter_table() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])


def has_letter(text: str) -> bool:
    return bool(len(text)) and bool(letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())


class Trigrams:
    """Makes trigram vectors and keeps those met first, a byte for each number of +1 or -1."""

    def __init__(self) -> None:
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.matrix = np.empty((KEPT, DIMENSIONS), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            bits = np.random.Generator(np.random.Philox(key=code)).integers(0, 2, DIMENSIONS, dtype=np.int8)
            self.letters[code] = (2 * bits - 1).astype(np.float32)
        return self.letters[code]

    def make(self, key: int) -> np.ndarray:
        a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def vectors(self, keys: list[int]) -> np.ndarray:
        where = []
        for k in keys:
            row = self.rows.get(k)
            if row is None and len(self.rows) < KEPT:
                row = self.rows[k] = len(self.rows)
                self.matrix[row] = self.make(k)
            where.append(-1 if row is None else row)
        out = self.matrix[where].astype(np.float32)
        for i, row in enumerate(where):
            if row < 0:
                out[i] = self.make(keys[i])
        return out

    def bundle(self, batch: list[str], groups: np.ndarray, n: int, damped: bool = False) -> np.ndarray:
        """Sums (n x DIMENSIONS) of the trigram vectors of texts, by the group that each text is in.

        With `damped` a text's vectors are divided by the root of their number, so that long texts don't drown others.
        """
        chars = np.frombuffer("\n".join([*(t.lower() for t in batch), ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        text = np.repeat(np.arange(len(batch)), [len(t.lower()) + 1 for t in batch])
        chars = np.where(letter_table()[chars], chars, 0)
        keep = np.ones(len(chars), bool)
        keep[1:] = (chars[1:] != 0) | (chars[:-1] != 0)
        chars, text = np.concatenate([[0], chars[keep], [0]]), text[keep]
        middle = np.flatnonzero(chars[1:-1])
        text = text[middle]
        keys, which = np.unique(chars[middle] << 42 | chars[middle + 1] << 21 | chars[middle + 2], return_inverse=True)
        weights = 1 / np.sqrt(np.bincount(text, minlength=1))[text] if damped else None
        cells = groups[text] * len(keys) + which
        total = np.zeros((n, DIMENSIONS), np.float32)
        if n * len(keys) <= CELLS_PER_LETTER * len(middle):
            counts = np.bincount(cells, weights, n * len(keys)).reshape(n, len(keys)).astype(np.float32)
            for lo in range(0, len(keys), AT_ONCE):
                total += counts[:, lo : lo + AT_ONCE] @ self.vectors(keys[lo : lo + AT_ONCE].tolist())
            return total
        cells, where = np.unique(cells, return_inverse=True)
        sums = np.bincount(where, weights).astype(np.float32)
        row, column = np.divmod(cells, max(len(keys), 1))
        for lo in range(0, len(keys), AT_ONCE):
            vectors = self.vectors(keys[lo : lo + AT_ONCE].tolist())
            own = np.flatnonzero((column >= lo) & (column < lo + AT_ONCE))
            for at in range(0, len(own), AT_ONCE // 2):
                part = own[at : at + AT_ONCE // 2]
                starts = np.flatnonzero(np.diff(row[part], prepend=-1))
                total[row[part[starts]]] += np.add.reduceat(vectors[column[part] - lo] * sums[part, None], starts, axis=0)
        return total


@dataclass
class Profiles:
    """Learned languages, sorted, and their prototypes of length one."""

    languages: list[str] = field(default_factory=list)
    prototypes: np.ndarray = field(default_factory=lambda: np.empty((0, DIMENSIONS), np.float32))

    def predict(self, trigrams: Trigrams, batch: list[str]) -> tuple[list[str], list[float]]:
        found = trigrams.bundle(batch, np.arange(len(batch)), len(batch))
        norms = np.linalg.norm(found, axis=1)
        lettered = [has_letter(t) for t in batch]
        if not self.languages:
            return [UNKNOWN] * len(batch), [0.0] * len(batch)
        cosines = found @ self.prototypes.T / np.maximum(norms, 1e-9)[:, None]
        best = cosines.argmax(axis=1)
        langs = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered, strict=True)]
        scores = np.where(lettered, np.clip(cosines[np.arange(len(batch)), best], 0, 1), 0)
        return langs, scores.astype(float).tolist()


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Prototypes of the languages of all rows with a non-null language and text.

    Each task bundles its own texts; the vectors are then added in blocks of their dimensions, first in parts and then
    together, so no group grows beyond the number of parts or tasks per part. What the driver gets is one vector for
    each language.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("body"))
    schema = "lang string, block int, part int, vec array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        let_go()
        trigrams, sums = Trigrams(), {}
        for batch in sliced(batches, "body", SLICE_BYTES, SLICE_ROWS):
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            index = {n: i for i, n in enumerate(names)}
            got = trigrams.bundle(texts(batch, "body"), np.array([index[x] for x in langs]), len(names), damped=True)
            for n, v in zip(names, got.astype(np.float64), strict=True):
                sums[n] = sums[n] + v if n in sums else v
        part = TaskContext.get().partitionId() % 64
        out = [(n, b, part, v[b * BLOCK : (b + 1) * BLOCK].tolist()) for n, v in sorted(sums.items()) for b in range(DIMENSIONS // BLOCK)]
        if out:
            types = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["lang", "block", "part", "vec"])

    def add(table: pa.Table) -> pa.Table:
        total = np.add.reduce([np.array(v) for v in table["vec"].to_pylist()])
        first = table.slice(0, 1)
        return pa.table({"lang": first["lang"], "block": first["block"], "part": first["part"], "vec": pa.array([total.tolist()], pa.list_(pa.float64()))})

    parts = rows.mapInArrow(run, schema).groupBy("lang", "block", "part").applyInArrow(add, schema)
    found: dict[str, dict[int, list[float]]] = {}
    for r in parts.groupBy("lang", "block").applyInArrow(add, schema).collect():
        found.setdefault(r.lang, {})[r.block] = r.vec
    languages = sorted(found)
    whole = np.array([np.concatenate([found[n][b] for b in sorted(found[n])]) for n in languages]).reshape(-1, DIMENSIONS)
    return Profiles(languages, (whole / np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-9)).astype(np.float32))


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """Append lang_pred and score, the cosine cut to 0..1, to each row; only the text is looked at.

    A null text, one without a letter, and any text if no language was learned give ("und", 0). Ties go to the language
    that sorts first. Each row is treated alone, so repeated rows and other columns don't matter; columns named
    lang_pred or score are replaced. An empty table gives an empty result. A worker keeps at most KEPT trigram vectors and
    makes others anew, and sums up SLICE_ROWS texts at once, so its memory grows only with the longest text.
    """
    rest = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    schema = T.StructType([*rest, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        trigrams = Trigrams()
        for batch in sliced(batches, text_col, SLICE_BYTES, SLICE_ROWS):
            langs, scores = profiles.predict(trigrams, texts(batch, text_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.select([F.col(f"`{f.name}`") for f in rest]).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is 2 modulo 4; such rows, and those without an id, are not learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_from_kept_in(docs: DataFrame, id_col: str = "doc_id") -> Profiles:
    return learn(docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)))


def keep_identified(docs: DataFrame, profiles: Profiles, text_col: str = "text", lang_col: str | None = None, languages: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of `docs`, with its columns, whose text has a letter and whose language is one of `languages`.

    By default all languages stay, also where none was learned. Rows with null in `lang_col`, if that is given, get the
    language that was found; stated languages aren't changed. Null and empty texts and those without a letter go.
    """
    fill = docs.schema.names.index(lang_col) if lang_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        trigrams = Trigrams()
        for batch in sliced(batches, text_col, SLICE_BYTES, SLICE_ROWS):
            bodies = texts(batch, text_col)
            langs, _ = profiles.predict(trigrams, bodies)
            keep = [has_letter(t) and (languages is None or x in languages) for t, x in zip(bodies, langs, strict=True)]
            if fill is not None:
                known = pa.array([None if x == UNKNOWN else x for x in langs], batch.column(fill).type)
                batch = batch.set_column(fill, batch.schema.field(fill), pc.coalesce(batch.column(fill), known))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
