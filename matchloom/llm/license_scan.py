"""Fuzzy search for short licence notices.

A notice that may differ by k edits is split into k+1 seeds, one of which must stand in the text unchanged. An automaton
finds all seeds of all notices in one pass; around each place the regex library matches the notice with its error bound,
which verifies the edits and gives the span. Phrases that must stand as they are have one seed and no edits.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import raw_texts, sliced


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    edits: int


#: Exact phrases, whose places are counted.
BASE = (
    Notice("cc by", "cc-by", 0),
    Notice("general public license", "gpl", 0),
    Notice("all rights reserved", "reserved", 0),
)
#: Notices found with edits; text as words in lower case.
FUZZY = (
    Notice("general public license", "gpl", 2),
    Notice("lesser general public license", "lgpl", 2),
    Notice("all rights reserved", "reserved", 2),
    Notice("creative commons attribution", "cc-by", 3),
    Notice("under the apache license", "apache", 2),
    Notice("under the mit license", "mit", 1),
    Notice("permission is hereby granted free of charge", "mit", 4),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("mozilla public license", "mpl", 2),
    Notice("dedicated to the public domain", "public-domain", 2),
)

#: Bytes that end a word become blanks and A-Z become a-z: words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class Scanner:
    def __init__(self, base: tuple[Notice, ...] = BASE, fuzzy: tuple[Notice, ...] = FUZZY):
        self.notices = [*base, *fuzzy]
        self.n_base = len(base)
        seeds: dict[str, list[tuple[int, int]]] = {}
        self.patterns = []
        for i, notice in enumerate(self.notices):
            if notice.edits:
                pieces, n = notice.edits + 1, len(notice.text)
                cuts = [k * n // pieces for k in range(pieces + 1)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    seeds.setdefault(notice.text[lo:hi], []).append((i, lo))
            else:
                seeds.setdefault(f" {notice.text} ", []).append((i, -1))  # its place is that of the first letter
            self.patterns.append(regex.compile(f"(?b)(?<= )(?:{regex.escape(notice.text, literal_spaces=True)}){{e<={notice.edits}}}(?= )"))
        self.automaton = ahocorasick.Automaton()
        for seed, owners in seeds.items():
            self.automaton.add_word(seed, (len(seed), owners))
        self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> list[tuple[int, int, int, int, int, int]]:
        """(notice, first word, words, start, end, edits) of each match; start and end are places in the joined words."""
        text = " " + b" ".join(words).decode(errors="replace") + " "
        places: dict[int, set[int]] = {}
        for end, (size, owners) in self.automaton.iter(text):
            for notice, offset in owners:
                places.setdefault(notice, set()).add(end + 1 - size - offset)
        if not places:
            return []
        blanks = None
        out = []
        for notice in sorted(places):
            want, beyond = self.notices[notice], -1_000_000
            k, n = want.edits, len(want.text)
            for at in sorted(places[notice]):
                if not k:
                    found, start, end, edits = True, at, at + n, 0
                else:
                    if at <= beyond:  # the last match covers this place
                        continue
                    got = self.patterns[notice].search(text, max(0, at - k), min(len(text), at + n + k + 1))
                    found = got is not None
                    if found:
                        (start, end), edits = got.span(), sum(got.fuzzy_counts)
                        beyond = end - n // 2
                if found:
                    if blanks is None:
                        blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32).tolist()
                    first, last = bisect_left(blanks, start) - 1, bisect_left(blanks, end) - 1
                    out.append((notice, first, last - first + 1, start - 1, end - 1, edits))
        return out


MATCH = T.StructType(
    [T.StructField(n, t) for n, t in (("label", T.StringType()), ("notice", T.StringType()), ("first_word", T.LongType()), ("words", T.LongType()), ("start", T.LongType()), ("end", T.LongType()), ("edits", T.LongType()))]
)
ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("matches", T.ArrayType(MATCH)),
    ]
)


@functools.cache
def _scanner(base: tuple[Notice, ...], fuzzy: tuple[Notice, ...]) -> Scanner:
    return Scanner(base, fuzzy)


def license_scan(docs: DataFrame, text_col: str = "text", base: tuple[Notice, ...] = BASE, fuzzy: tuple[Notice, ...] = FUZZY) -> DataFrame:
    """Append to each row the licence notices in its whole text.

    Adds n_words; n_base, first_word and last_word (places of exact phrases: all of them, smallest and largest first
    word); base_labels and labels (exact ones, and all; distinct, sorted, comma-joined); score (1 less the share of
    edits of the best match, 0 without one); and matches with label, notice, first_word, words, start, end (in the
    lower-case words joined by blanks) and edits. Matches with edits begin and end at words; of matches of one notice with
    edits that overlap, the first is listed, so `matches` names each place but not each way to read it.

    Null and empty texts have no words and no match. Very long texts are scanned as a whole by one task. Each row is treated alone, so ties, repeated rows and other columns
    don't matter; columns with an added name are replaced. An empty table gives an empty result.
    """
    rest = [f for f in docs.schema.fields if f.name not in ADDED.fieldNames()]
    kept = docs.select([F.col(f"`{f.name}`") for f in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(base, fuzzy)
        match = pa.struct([(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for f in MATCH])
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(match)]
        for batch in sliced(batches, text_col, 2 << 20):
            rows = []
            for text in raw_texts(batch, text_col):
                words = words_of(text)
                found = scanner.scan(words)
                exact = [m for m in found if m[0] < scanner.n_base]
                labels = [scanner.notices[m[0]].label for m in found]
                rows.append(
                    (
                        len(words),
                        len(exact),
                        min((m[1] for m in exact), default=None),
                        max((m[1] for m in exact), default=None),
                        ",".join(sorted({scanner.notices[m[0]].label for m in exact})),
                        ",".join(sorted(set(labels))),
                        max((1 - m[5] / len(scanner.notices[m[0]].text) for m in found), default=0.0),
                        [dict(zip(MATCH.fieldNames(), (x, scanner.notices[m[0]].text, *m[1:]), strict=True)) for x, m in zip(labels, found, strict=True)],
                    )
                )
            new = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *ADDED.fieldNames()])

    return kept.mapInArrow(run, T.StructType([*rest, *ADDED.fields]))
