"""Exact token counts at every prefix of a text, for sentencepiece BPE vocabularies.

Dynamic programming over prefixes: the last token of a prefix's encoding is the one piece that ends there and stands
next to the last token of what is left before it. Each prefix keeps that token and a count, so any prefix's exact
token count is a lookup, and the longest prefix within a budget is a search, with nothing encoded again.

Pieces hold the blank mark only at their beginning, and runs of marks are pieces of a lower score than all others
(both are checked when a vocabulary is loaded, and that its normaliser leaves texts as they are). So a text falls into segments, each a run of marks and what follows up
to the next mark, that are counted alone.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import sliced, texts

MARK = "▁"
#: Characters that normalisers change: blanks in a row and at the ends, ligatures, wide and composed forms, controls.
PROBE = " a  b\ufb01 \uff76\uff9e\u01fa\u212b\u2460A\u0301\t\nx\u00a0\u3000\u200b\u0007Z "


class PrefixCounter:
    def __init__(self, path: str, cached: int = 1_000_000):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(PROBE) != MARK + PROBE.replace(" ", MARK):
            raise ValueError("the vocabulary's normaliser changes texts")
        self.rank: dict[str, int] = {}
        self.single = set()
        runs, lowest = [], 0.0
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
                continue
            score = model.get_score(i)
            body = piece.lstrip(MARK)
            if MARK in body or (body and len(piece) - len(body) > 1):
                raise ValueError(f"piece {piece!r} has a mark inside")
            if len(piece) == 1:
                self.single.add(piece)
            if len(piece) > 1 and not body:
                runs.append((score, len(piece)))
                continue
            if len(piece) > 1:
                lowest = min(lowest, score)
                self.rank[piece] = score
        if any(score >= lowest for score, _ in runs):
            raise ValueError("a run of marks scores higher than another piece")
        if len(model.encode("\u0007")) != 2:
            raise ValueError("a vocabulary with a leading mark and byte fallback is needed")
        self.longest_run = max((n for _, n in runs), default=1)
        few = [self._merge_run(n, {n: score for score, n in runs}) for n in range(4 * self.longest_run + 1)]
        if any(few[n + self.longest_run] != few[n] + 1 for n in range(3 * self.longest_run + 1)):
            raise ValueError("runs of marks don't repeat after the longest")
        self.few_marks = few[: self.longest_run]
        order = {s: i for i, s in enumerate(sorted(set(self.rank.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in self.rank.items()}
        self.root: dict = {}  # whole pieces by their characters from the last to the first; 0: (piece, size, what it may follow)
        self.leaves = []
        for piece in self.rank:
            if self._merge(piece) == [piece]:
                node = self.root
                for c in reversed(piece):
                    node = node.setdefault(c, {})
                node[0] = (piece, len(piece), {})
                self.leaves.append(node[0][2])
        self.checked = 0
        self.cached = cached
        self.known: dict[str, bytes] = {}  # counts after each character of short segments, a byte each

    def _merge(self, text: str) -> list[str]:
        """Exact merging of a few characters: the best score first, the leftmost of equals."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _cost(self, token: str) -> int:
        """Ids of a token: one, or one for each byte of a character that isn't in the vocabulary."""
        return 1 if len(token) > 1 or token in self.single else len(token.encode())

    def _extend(self, text: str, last: list[str], total: list[int]) -> None:
        """Go on with the last tokens and counts of a segment's prefixes, from those that the lists hold already.

        The segment has one mark at most, at its beginning.
        """
        root = self.root
        for i in range(len(last), len(text) + 1):
            node, k, ends = root, i, []
            while k:
                node = node.get(text[k - 1])
                if node is None:
                    break
                k -= 1
                if 0 in node:
                    ends.append(node[0])
            for piece, size, follows in reversed(ends):
                if size == i:
                    break
                before = last[i - size]
                stands = follows.get(before)
                if stands is None:
                    stands = follows[before] = self._merge(before + piece) == [before, piece]
                    self.checked += 1
                if stands:
                    break
            else:
                piece = text[i - 1]
            last.append(piece)
            total.append(total[i - len(piece)] + self._cost(piece))
        if self.checked > 1_000_000:
            self.checked = 0
            for follows in self.leaves:
                follows.clear()

    def learn(self, segments: set[str]) -> None:
        """Put the counts of these segments into the cache. In sorted order each goes on from the prefix that it shares."""
        if len(self.known) + len(segments) > self.cached:
            self.known.clear()
        before, last, total = "", [""], [0]
        for segment in sorted(s for s in segments if len(s) <= 64 and s not in self.known):
            n = 0
            for x, y in zip(before, segment, strict=False):
                if x != y:
                    break
                n += 1
            del last[n + 1 :], total[n + 1 :]
            self._extend(segment, last, total)
            before = segment
            if total[-1] < 256 and max(total) < 256:
                self.known[segment] = bytes(total[1:])

    def run(self, n: int) -> int:
        """Tokens of a run of n marks alone; beyond the longest piece the counts repeat."""
        return n // self.longest_run + self.few_marks[n % self.longest_run]

    @staticmethod
    def _merge_run(n: int, score: dict[int, float]) -> int:
        """Merge a run of n marks: the best score first, the leftmost of equals."""
        parts = [1] * n
        while True:
            best = max(((score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in score), default=None)
            if best is None:
                return len(parts)
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _counts(self, segment: str) -> np.ndarray:
        """Counts after each character of a segment."""
        got = self.known.get(segment)
        if got is not None:
            return np.frombuffer(got, np.uint8).astype(np.int64)
        last, total = [""], [0]
        self._extend(segment, last, total)
        return np.array(total[1:], np.int64)

    @staticmethod
    def segments(text: str) -> list[tuple[int, str]] | list[str]:
        """Segments of a text: bodies that one mark comes before, or (marks, body) where it has runs of marks."""
        parts = text.replace(" ", MARK).split(MARK)
        if all(parts):
            return parts
        out, marks = [], 0
        for body in parts:
            marks += 1
            if body:
                out.append((marks, body))
                marks = 0
        return [*out, (marks, "")] if marks else out

    def _after(self, marks: int, body: str) -> np.ndarray:
        """Counts after each character of a segment, its added mark left out: further marks, then the body."""
        runs = np.array([self.run(k) for k in range(1, marks + 1)], np.int64)
        if not body:
            return runs
        return np.concatenate([runs, self._joined(marks, body, self._counts(MARK + body))])

    def _total(self, marks: int, body: str) -> int:
        if marks == 1 and body:
            got = self.known.get(MARK + body)
            return got[-1] if got is not None else int(self._counts(MARK + body)[-1])
        return int(self._after(marks, body)[-1])

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of text[:0], text[:1], ... and of the whole text."""
        out, base = [np.zeros(1, np.int64)], 0
        for k, s in enumerate(self.segments(text) if text else ()):
            marks, body = (1, s) if isinstance(s, str) else s
            after = base + self._after(marks, body)
            out.append(after[1:] if not k else after)
            base = int(after[-1])
        return np.concatenate(out)

    def count(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of a text, and the characters of its longest prefix within the budget."""
        if not text:
            return 0, 0
        segments = self.segments(text)
        plain = isinstance(segments[0], str)
        if plain:
            known = self.known
            totals = [got[-1] if (got := known.get(MARK + s)) is not None else self._total(1, s) for s in segments]
        else:
            totals = [self._total(*s) for s in segments]
        whole = sum(totals)
        if whole <= budget:
            return whole, len(text)
        best, base, at = 0, 0, -1  # the added mark is no character of the text
        for s, n in zip(segments, totals, strict=True):
            marks, body = (1, s) if plain else s
            # counts may fall when a token grows, so a segment that ends above the budget may hold a prefix within it
            if base + n <= budget:
                best = at + marks + len(body)
            elif base <= budget:
                within = np.flatnonzero(base + self._after(marks, body) <= budget)
                if len(within):
                    best = max(best, at + 1 + int(within[-1]))
            base, at = base + n, at + marks + len(body)
            if base > budget + len(body) * 4:
                break
        return whole, best

    def _joined(self, marks: int, body: str, counts: np.ndarray) -> np.ndarray:
        """Counts after each character of a body that `marks` marks come before."""
        if marks == 1:
            return counts[1:]
        # the first token may take the last mark or leave it, as each prefix has it
        alone = self._alone(body)
        return np.where(alone, self.run(marks) + counts[1:] - 1, self.run(marks - 1) + counts[1:])

    def _alone(self, body: str) -> np.ndarray:
        """For each prefix of a body, whether the mark before it stays a token of its own."""
        last, first = [""], [False]
        self._extend(MARK + body, last, [0])
        for i, token in enumerate(last[1:], 1):
            first.append(token == MARK if len(token) == i else first[i - len(token)])
        return np.array(first[2:])


@functools.cache
def counter_of(path: str) -> PrefixCounter:
    """One for each worker process, so that later tasks find its segments known."""
    return PrefixCounter(path)


ADDED = ["n_bytes", "n_tokens", "over_limit", "cut_chars"]


def token_counts(docs: DataFrame, model_path: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Append to each row n_bytes (UTF-8), n_tokens, over_limit and cut_chars of its whole text.

    cut_chars is the length of the longest prefix, in code points, of `limit` tokens or fewer: the text cut there needs
    no second encoding. Special strings in a text are ordinary text.

    Null and empty texts have no bytes and no tokens. Each row is treated alone, so ties, repeated rows and other columns
    don't matter; columns with an added name are replaced. An empty table gives an empty result. Memory is that of about
    2 MB of text or the longest text, and the cache of segments is bounded.
    """
    rest = [f for f in docs.schema.fields if f.name not in ADDED]
    kept = docs.select([F.col(f"`{f.name}`") for f in rest])
    schema = T.StructType([*rest, *[T.StructField(n, T.BooleanType() if n == "over_limit" else T.LongType()) for n in ADDED]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(model_path)
        for batch in sliced(batches, text_col, 2 << 20):
            whole = texts(batch, text_col)
            counter.learn({MARK + s for t in whole for s in t.replace(" ", MARK).split(MARK)})
            totals, cuts = zip(*(counter.count(t, limit) for t in whole), strict=True)
            new = [pa.array([len(t.encode()) for t in whole], pa.int64()), pa.array(totals, pa.int64()), pa.array([t > limit for t in totals]), pa.array(cuts, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *ADDED])

    return kept.mapInArrow(run, schema)
