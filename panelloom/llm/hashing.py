"""Vectorised 64-bit hashes of words and word runs."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(n, 1 << 16), base, U)
        steps[0] = 1
        held = _powers[base] = np.cumprod(steps, dtype=U)
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """H with ``span_hash(H, i, j)`` the polynomial hash of ``values[i:j]``."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum((values.astype(U) + U(1)) * powers(_BASE, len(values)), dtype=U, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end); equal contents give equal hashes wherever they stand."""
    size = (end - start).astype(U) * U(0xD6E8FEB86659FD93)
    return mix((prefix[end] - prefix[start]) * powers(_INVERSE, len(prefix))[start] + size)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lowered, split at ASCII white space), and where each text's words begin."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if not len(data):
        return np.empty(0, U), np.zeros(len(texts) + 1, np.int64)
    space = np.concatenate([[True], _SPACE[data], [True]])
    change = np.flatnonzero(space[1:] != space[:-1])
    start, end = change[::2], change[1::2]
    words = span_hash(prefix_hash(_LOWER[data]), start, end)
    return words, np.searchsorted(start, begins)


def runs_of(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words, by position of its first word."""
    if len(words) < n:
        return np.empty(0, U)
    out = words[: len(words) - n + 1]
    for k in range(1, n):
        out = mix(out * U(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    return out
