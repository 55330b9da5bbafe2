"""Words and five-word shingles of whole texts as 64-bit hashes, in NumPy.

Words are runs of bytes other than space and \\x09-\\x0D, with A-Z lower-cased. A text of fewer words than a shingle has
one shingle, its whole sequence; a text without words has none.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5
_STEP, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_PLACE = _rng.integers(1, 1 << 63, WIDTH + 1, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_of(n: int) -> list[np.ndarray]:
    """Powers of the step and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_STEP, _INVERSE)]
    return _powers


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and each text's first word (one more at the end)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=np.int8(1)))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _powers_of(len(data) + 1)
    upto = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=upto[1:])
    hashes = mixed((upto[ends] - upto[starts]) * inverse[starts])
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    return hashes, first


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted."""
    w, first = word_hashes(texts)
    n = max(0, len(w) - WIDTH + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        rolled += w[k : k + n] * _PLACE[k]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            out.append(np.unique(rolled[a : b - WIDTH + 1]))
        elif b > a:
            k = b - a
            out.append(mixed((w[a:b] * _PLACE[:k]).sum(keepdims=True, dtype=np.uint64) + np.uint64(k * int(_PLACE[WIDTH]) % (1 << 64))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
