"""Rolling hashes over characters and words, whole arrays at a time.

All sums wrap modulo 2**64.  The hash of a span is a difference of two prefix sums, brought to
a common origin by a power of the base's inverse, so spans of any length cost the same.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
WORD_BASE, WORD_INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
_SPACE = np.zeros(33, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = np.zeros(0, bool)


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 22:  # a very long text doesn't leave its powers behind
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x.astype(U, copy=True)
    x += U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def codes(text: str) -> np.ndarray:
    """The text's code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def is_space(c: np.ndarray) -> np.ndarray:
    return _SPACE[np.minimum(c, 31 + 1)] & (c <= 32)


def is_alnum(c: np.ndarray) -> np.ndarray:
    """Letters and numbers, as ``str.isalnum`` has them."""
    global _ALNUM
    if not len(_ALNUM):
        _ALNUM = np.array([chr(i).isalnum() for i in range(0x10000)])
    if len(c) and c.max() >= 0x10000:
        out = _ALNUM[np.minimum(c, 0xFFFF)]
        far = np.flatnonzero(c >= 0x10000)
        out[far] = [chr(i).isalnum() for i in c[far]]
        return out
    return _ALNUM[c]


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of characters that depends on nothing but its characters."""
    n = len(c)
    if not len(starts):
        return np.zeros(0, U)
    sums = np.zeros(n + 1, U)
    np.cumsum(mix(c, 1) * powers(BASE, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, n)[starts], 2)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` consecutive words from each position on; empty with fewer words."""
    k = len(words) - n + 1
    if k <= 0:
        return np.zeros(0, U)
    sums = np.zeros(len(words) + 1, U)
    np.cumsum(words * powers(WORD_BASE, len(words)), out=sums[1:])
    return mix((sums[n:] - sums[:k]) * powers(WORD_INVERSE, k), 2 + n)
