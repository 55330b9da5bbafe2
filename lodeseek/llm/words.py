"""Texts as coded words, for the operators that learn weights of hashed words."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A word of its own at each line break.
BREAK = "\x1e"
BATCH_BYTES = 1_500_000
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


class Coded:
    """Words of some texts, each coded by its place in ``distinct``; ``offsets`` has the first word of each text."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        clean = pc.replace_substring(pa.array(texts, pa.large_string()), BREAK, " ")
        split = pc.split_pattern(pc.replace_substring(clean, "\n", f" {BREAK} "), " ")
        words = pc.list_flatten(split)
        coded = words.dictionary_encode()
        self.distinct: list[str] = coded.dictionary.to_pylist()
        self.index = coded.indices.to_numpy()
        self.offsets = split.offsets.to_numpy().astype(np.int64)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.offsets))
        self.chars = pc.utf8_length(words).to_numpy().astype(np.int64)

    def where(self) -> np.ndarray:
        """Each word's first code point in its text."""
        step = self.chars + 1
        brk = np.array([w == BREAK for w in self.distinct], bool)[self.index]
        step = np.where(brk, 0, step)  # the mark and its two spaces stand for one line break, the space before for it
        end = np.cumsum(step)
        start = end - step
        first = np.zeros(len(self.texts), np.int64)
        some = np.diff(self.offsets) > 0
        first[some] = start[self.offsets[:-1][some]]
        return start - first[self.doc]


def bare(word: str) -> str:
    return _EDGE.sub("", word.lower())


def hashed(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % size


def batches_of(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches of ``most`` characters (a single text may be longer), with column ``text`` as strings, null as empty."""
    for batch in batches:
        sizes = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
        at = 0
        while at < len(sizes):
            to, room = at, most
            while to < len(sizes) and (to == at or room >= sizes[to]):
                room -= sizes[to]
                to += 1
            own = batch.slice(at, to - at)
            yield own, [t or "" for t in own.column("text").to_pylist()]
            at = to
        pa.default_memory_pool().release_unused()  # Python workers live on, also idle


def summed(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(group, values, n)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, name: str, value: np.ndarray, grad: np.ndarray) -> np.ndarray:
        m = self.m[name] = 0.9 * self.m.get(name, 0) + 0.1 * grad
        v = self.v[name] = 0.99 * self.v.get(name, 0) + 0.01 * grad * grad
        t = self.t + 1
        return value - self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)

    def tick(self) -> None:
        self.t += 1
