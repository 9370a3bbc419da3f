"""64-bit hashes of words, by array operations over a whole text."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []
_spaces = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
    return x ^ x >> U(31)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE modulo 2**64 and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        inverse = pow(BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.r_[U(1), np.full(size - 1, b, "u8")], dtype="u8") for b in (BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each lower-cased word (A-Z) of a text, from the prefix sums of one polynomial over the whole."""
    b = np.frombuffer(raw.lower(), "u1")
    if not len(b):
        return np.zeros(0, "u8")
    inside = np.r_[False, ~_spaces[b], False]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(b) + 1)
    sums = np.r_[U(0), np.cumsum((b.astype("u8") + U(1)) * up[: len(b)], dtype="u8")]
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype("u8"))
