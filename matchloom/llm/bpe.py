"""Byte-pair encoding by speculation and verification.

A word's greedy longest-match tokens are its encoding if each pair of neighbours is: a sequence of tokens is what
merging gives exactly when merging gives back each token alone and each two neighbours together. So an automaton
proposes tokens for all new words at once, a table of pairs checks all neighbours at once, and only words with a pair
that fails are merged step by step.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import kept_by_worker, sliced, texts

#: How byte-level vocabularies cut text into words.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A single space before a character that isn't blank always begins a word, so texts may be cut there.
CUT = re.compile(r" (?=\S)")
ODD_BLANK = re.compile(r" (?:\s|$)")
SEPARATOR = "Ā"
#: Bytes of text that are encoded at once; more take more memory and no less time.
SLICE_BYTES = 512 << 10
NEVER = 1 << 40


def _byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write the 256 bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """A byte-level BPE vocabulary in the JSON form of the tokenizers library."""

    def __init__(self, path: str, cached: int = 300_000, cached_bytes: int = 64 << 20):
        model = json.load(open(path, encoding="utf-8"))
        alphabet = _byte_alphabet()
        spell = lambda token: bytes(alphabet[c] for c in token)
        vocab = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.ids = {spell(t): i for t, i in vocab.items() if t not in self.special}
        self.bytes = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        self.rank_of: dict[int, int] = {}  # of a pair, first << 20 | second
        self.made: list[int] = []  # by rank
        for rank, (a, b) in enumerate(pairs):
            self.rank_of[vocab[a] << 20 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.single_ids, self.made_ids = np.array(self.single), np.array(self.made)
        keys = np.array(list(self.rank_of), np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(self.rank_of.values()), np.int64)[order]
        self.sizes = np.ones(max(self.bytes) + 2, np.int64)  # bytes of each token; the separator's id is -1
        self.greedy = ahocorasick.Automaton()
        merged = self.merge_all(list(self.ids))
        for (token, i), got in zip(self.ids.items(), merged, strict=True):
            if got == np.uint32(i).tobytes():  # a token that merging doesn't give is never proposed
                self.greedy.add_word(token.decode("latin-1"), i)
                self.sizes[i] = len(token)
        self.greedy.add_word(SEPARATOR, -1)
        self.greedy.make_automaton()
        self.good = np.empty(0, np.int64)  # checked pairs, sorted, and whether they stand
        self.stands = np.empty(0, bool)
        self.known: dict[str, bytes] = {}  # encodings of words and of chunks
        self.cached, self.cached_bytes, self.held = cached, cached_bytes, 0
        self.proposed = self.failed = 0

    def _merge_long(self, word: bytes) -> list[int]:
        """Exact merging with a heap: the pair of lowest rank first, the leftmost of equals."""
        tokens: list[int | None] = [self.single[b] for b in word]
        after = list(range(1, len(tokens) + 1))
        before = list(range(-1, len(tokens) - 1))
        rank, made = self.rank_of, self.made
        heap = [(r, i, tokens[i], tokens[i + 1]) for i in range(len(tokens) - 1) if (r := rank.get(tokens[i] << 20 | tokens[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j >= len(tokens) or tokens[j] != b:
                continue
            tokens[i], tokens[j] = made[r], None
            after[i] = after[j]
            if after[j] < len(tokens):
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(tokens) and (r := rank.get(tokens[k] << 20 | tokens[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, tokens[k], tokens[after[k]]))
        return [t for t in tokens if t is not None]

    def _check(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair (first << 32 | second) stands as neighbours; new pairs enter the table."""
        unique, where = np.unique(pairs, return_inverse=True)
        at = np.minimum(np.searchsorted(self.good, unique), max(len(self.good) - 1, 0))
        new = unique[self.good[at] != unique] if len(self.good) else unique
        if len(new):
            merged = self.merge_all([self.bytes[p >> 32] + self.bytes[p & 0xFFFFFFFF] for p in new.tolist()])
            ok = [m == p for m, p in zip(merged, map(bytes, np.stack([new >> 32, new & 0xFFFFFFFF], axis=1).astype("<u4")), strict=True)]
            if len(self.good) > 4_000_000:
                self.good, self.stands = np.empty(0, np.int64), np.empty(0, bool)
                return self._check(pairs)
            joined, stands = np.concatenate([self.good, new]), np.concatenate([self.stands, ok])
            order = np.argsort(joined)
            self.good, self.stands = joined[order], stands[order].astype(bool)
        return self.stands[np.searchsorted(self.good, unique)][where]

    def _rank(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        keys = first << 20 | second
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (second >= 0), self.pair_ranks[at], NEVER)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Exact merging of many words at once: each round merges the best pair of every word that has one."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words])
        for i in np.flatnonzero(sizes > 64).tolist():
            out[i] = np.array(self._merge_long(words[i]), "<u4").tobytes()
        for least, most in ((0, 8), (8, 14), (14, 24), (24, 64)):
            rows = np.flatnonzero((sizes > least) & (sizes <= most))
            for lo in range(0, len(rows), 8192):
                self._merge_rows(words, rows[lo : lo + 8192], sizes, out)
        return out

    def _merge_rows(self, words: list[bytes], rows: np.ndarray, sizes: np.ndarray, out: list[bytes]) -> None:
        width = int(sizes[rows].max()) + 1
        raw = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in rows.tolist()]), np.uint8).reshape(len(rows), width)
        tokens = np.where(np.arange(width) < sizes[rows][:, None], self.single_ids[raw], -1)
        ranks = self._rank(tokens[:, :-1], tokens[:, 1:])
        while len(rows):
            at = ranks.argmin(axis=1)
            row = np.arange(len(rows))
            best = ranks[row, at]
            done = best == NEVER
            if done.any():
                ids, counts = tokens[done].astype("<u4").tobytes(), (tokens[done] >= 0).sum(axis=1)
                stride = 4 * tokens.shape[1]
                for k, (i, n) in enumerate(zip(rows[done].tolist(), counts.tolist(), strict=True)):
                    out[i] = ids[k * stride : k * stride + 4 * n]
                tokens, ranks, rows, at, best = tokens[~done], ranks[~done], rows[~done], at[~done], best[~done]
                row = np.arange(len(rows))
                if not len(rows):
                    return
            tokens[row, at] = self.made_ids[best]
            columns = np.arange(tokens.shape[1] - 1)
            tokens = np.take_along_axis(tokens, columns + (columns > at[:, None]), axis=1)
            if tokens.shape[1] < 2:  # all are one token: a last round finds nothing to merge
                tokens, ranks = np.pad(tokens, ((0, 0), (0, 1)), constant_values=-1), np.full((len(rows), 1), NEVER)
                continue
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), axis=1)
            inside = at < ranks.shape[1]
            k, c = row[inside], at[inside]
            ranks[k, c] = self._rank(tokens[k, c], tokens[k, c + 1])
            k, c = row[at > 0], at[at > 0] - 1
            ranks[k, c] = self._rank(tokens[k, c], tokens[k, c + 1])

    def _encode_words(self, words: list[str]) -> None:
        """Put the encodings of new words (as little-endian 32-bit ids) into the cache."""
        spelled = [w.encode() for w in words]
        run = SEPARATOR.join([s.decode("latin-1") for s in spelled]) + SEPARATOR
        end, tokens = np.fromiter(chain.from_iterable(self.greedy.iter_long(run)), np.int64).reshape(-1, 2).T
        size = self.sizes[tokens]
        cuts = np.flatnonzero(tokens < 0)
        starts = np.concatenate([[0], cuts[:-1] + 1])
        bad = np.empty(len(end), bool)  # the automaton left something out
        bad[0], bad[1:] = end[0] - size[0] != -1, end[1:] - size[1:] != end[:-1]
        inner = np.flatnonzero((tokens[:-1] >= 0) & (tokens[1:] >= 0))
        bad[inner] |= ~self._check((tokens[inner] << 32) | tokens[inner + 1])
        fails = np.logical_or.reduceat(bad, starts)
        ids = tokens.astype("<u4").tobytes()
        self.proposed += len(words)
        self.failed += int(fails.sum())
        known = self.known
        for word, lo, hi in zip(words, (4 * starts).tolist(), (4 * cuts).tolist(), strict=True):
            known[word] = ids[lo:hi]
        failed = np.flatnonzero(fails).tolist()
        for i, merged in zip(failed, self.merge_all([spelled[i] for i in failed]), strict=True):
            known[words[i]] = merged
        self.held += 4 * len(run) + len(ids)

    def _encode_chunks(self, chunks: set[str]) -> None:
        """Put the encodings of all these chunks into the cache, which forgets all when it is full by entries or by bytes."""
        if len(self.known) + len(chunks) > self.cached or self.held > self.cached_bytes:
            self.known.clear()
            self.held = 0
        new = [c for c in chunks if c not in self.known]
        for lo in range(0, len(new), 20_000):
            part = [PATTERN.findall(c) for c in new[lo : lo + 20_000]]
            if words := list({w for p in part for w in p if w not in self.known}):
                self._encode_words(words)
            for chunk, p in zip(new[lo : lo + 20_000], part, strict=True):
                if len(p) != 1:
                    self.known[chunk] = joined = b"".join([self.known[w] for w in p])
                    self.held += 4 * len(chunk) + len(joined)

    @staticmethod
    def _cut(text: str) -> list[str]:
        if not text:
            return []
        if ODD_BLANK.search(text):
            first, *rest = CUT.split(text)
        else:
            first, *rest = text.split(" ")
        return [first, *[" " + c for c in rest]]

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers. Special strings in a text become their ids."""
        plans: list[list] = []
        for text in batch:
            parts = self.cut_special.split(text) if self.cut_special and any(s in text for s in self.special) else [text]
            plans.append([np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._cut(p) for p in parts])
        self._encode_chunks({c for plan in plans for p in plan if isinstance(p, list) for c in p})
        known = self.known
        return [b"".join([p if isinstance(p, bytes) else b"".join([known[c] for c in p]) for p in plan]) for plan in plans]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for, special tokens included."""
        spelling = self.bytes
        return b"".join([spelling[i] for i in np.frombuffer(ids, "<u4").tolist()])


def vocabulary(path: str) -> ByteBPE:
    """One for each worker process, so that later tasks find its words and pairs known."""
    return kept_by_worker(ByteBPE, path)


ENCODED = [("n_tokens", "long"), ("ids", "binary"), ("decoded", "string")]
DIGESTS = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, text_col: str = "text", digests: bool = False) -> DataFrame:
    """Append to each row the encoding of its whole text and the text decoded from it.

    Adds n_tokens, ids (32-bit little-endian integers) and decoded; with `digests` n_tokens, ids_sha256 and
    decoded_sha256 instead. Bytes that aren't UTF-8 are decoded to U+FFFD, as the tokenizers library does.

    Null and empty texts have no tokens. Each row is treated alone, so ties, repeated rows and other columns don't
    matter; columns with an added name are replaced. An empty table gives an empty result. The cache of words
    and chunks is bounded by entries and bytes (64 MB and what one slice adds), that of pairs by entries (36 MB); besides them, memory is that of about
    512 KB of text, or the longest text.
    """
    added = DIGESTS if digests else ENCODED
    rest = [f for f in docs.schema.fields if f.name not in dict(added)]
    kept = docs.select([F.col(f"`{f.name}`") for f in rest])
    schema = T.StructType([*rest, *[T.StructField(n, {"long": T.LongType(), "binary": T.BinaryType(), "string": T.StringType()}[t]) for n, t in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(tokenizer_path)
        for batch in sliced(batches, text_col, SLICE_BYTES):
            ids = bpe.encode(texts(batch, text_col))
            back = [bpe.decode(i).decode(errors="replace") for i in ids]
            counts = pa.array([len(i) // 4 for i in ids], pa.int64())
            if digests:
                new = [counts, pa.array([hashlib.sha256(i).hexdigest() for i in ids]), pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back])]
            else:
                new = [counts, pa.array(ids, pa.binary()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *dict(added)])

    return kept.mapInArrow(run, schema)
