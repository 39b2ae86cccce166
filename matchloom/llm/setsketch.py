"""SetSketch registers: exponentially spaced truncated minima of sets of 64-bit hashes.

Register i of a set holds K = floor(1 - log_b(min h_i / RATE)) cut to 0..65535, where h_i gives each element an
independent exponential variate. Registers of a union are the larger registers of its parts. With b near 1 two sets
share a register with a probability close to their Jaccard similarity, so runs of registers serve as LSH bands; three
counts (smaller, equal, larger) and the set sizes give the similarity by maximum likelihood.
"""

from __future__ import annotations

import numpy as np
import xxhash

REGISTERS = 128
BAND_ROWS = 4
BASE = 1.001
RATE = 20.0
#: Elements that are sketched at once, so that the buffers stay in the cache.
CHUNK = 1 << 16
_FACTORS = np.array([xxhash.xxh3_64_intdigest(f"register {i}") | 1 for i in range(REGISTERS)], dtype=np.uint64)


def registers(minima: np.ndarray) -> np.ndarray:
    """Registers of the minima of uniform 64-bit values."""
    uniform = (minima.astype(np.float64) + 0.5) / 2.0**64
    spaced = np.floor(1 - np.log(-np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE) / np.log(BASE))
    return np.clip(spaced, 0, 65535).astype(np.uint16)


def sketch(elements: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers (sets x REGISTERS) of the sets that begin at `starts` in `elements`; no set is empty."""
    out = np.empty((REGISTERS, len(starts)), dtype=np.uint64)
    buffer = np.empty(len(elements), dtype=np.uint64)
    for i in range(REGISTERS):
        np.multiply(elements, _FACTORS[i], out=buffer)
        out[i] = np.minimum.reduceat(buffer, starts)
    return registers(out.T)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of sets, one row each; sets larger than CHUNK are merged from parts."""
    rows, held, size = [], [], 0

    def flush() -> None:
        nonlocal held, size
        if held:
            rows.append(sketch(np.concatenate(held), np.cumsum([0] + [len(s) for s in held[:-1]])))
            held, size = [], 0

    for s in sets:
        if size + len(s) > CHUNK:
            flush()
        if len(s) > CHUNK:
            parts = [sketch(s[i : i + CHUNK], np.array([0])) for i in range(0, len(s), CHUNK)]
            rows.append(np.maximum.reduce(parts))
        else:
            held.append(s)
            size += len(s)
    flush()
    return np.concatenate(rows) if rows else np.empty((0, REGISTERS), np.uint16)


def bands(regs: np.ndarray) -> np.ndarray:
    """BAND_ROWS registers as one 64-bit value (sets x bands)."""
    return np.ascontiguousarray(regs).view(np.int64)


def unbands(longs: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(longs, dtype=np.int64).view(np.uint16)


def _larger(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def _log_likelihood(j, u, v, more, fewer, same):
    up = np.clip(_larger(u - v * j), 1e-12, 1)
    down = np.clip(_larger(v - u * j), 1e-12, 1)
    return more * np.log(up) + fewer * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))


def may_reach(n_u, n_v, more, fewer, threshold: float, slack: float = 12.5, steps: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Joint estimate for pairs: which may have the threshold similarity, and the likeliest similarity.

    A pair may reach it if its likeliest similarity does, or if the threshold's log-likelihood is less than `slack`
    (five standard deviations) below the best one, and the sizes allow it.
    """
    n_u, n_v = np.asarray(n_u, float), np.asarray(n_v, float)
    u, v = n_u / (n_u + n_v), n_v / (n_u + n_v)
    same = REGISTERS - more - fewer
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, steps)[:, None] * most[None, :]
    scores = _log_likelihood(grid, u, v, more, fewer, same)
    best = np.argmax(scores, axis=0)
    likeliest = grid[best, np.arange(len(u))]
    at = _log_likelihood(np.minimum(threshold, most), u, v, more, fewer, same)
    return (most >= threshold - 1e-12) & ((likeliest >= threshold) | (scores.max(axis=0) - at <= slack)), likeliest
