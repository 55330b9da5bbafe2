"""Encoding of whole texts to token ids with the ``tokenizers`` library, on executors.

Words recur, so a batch is split at ASCII white space (where the word-level pre-tokenizer always breaks), distinct
words are encoded once, and the ids are gathered back in order. Tokenizers of another shape encode whole texts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that form a run of their own after a word made of letters.
TAIL = ".,!?*#$&%|;:"
#: Words that a worker remembers between batches, and bytes of text in one batch.
REMEMBERED, BATCH_BYTES = 200_000, 2_000_000

_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The worker's encoder for the tokenizer file at ``path``."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _breaks_at_space(spec: dict) -> bool:
    """Whether white space always ends a token, so that words can be encoded one by one."""
    kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = pre[0] if pre else {}
    return (
        kinds == ["NFC", "Replace", "Lowercase"]
        and split.get("type") == "Split"
        and split.get("behavior") == "Removed"
        and bool(split.get("invert"))
        and split.get("pattern", {}).get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        and spec["model"].get("end_of_word_suffix") == "</w>"
        and all(not x["lstrip"] and not x["rstrip"] and not any(c.isspace() for c in x["content"]) for x in spec["added_tokens"])
    )


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        with open(path, encoding="utf-8") as f:
            self.by_word = _breaks_at_space(json.load(f))
        self.known: dict[str, bytes] = {}
        if self.by_word:
            self.ends = np.zeros(self.size, bool)
            for token, i in self.tok.get_vocab().items():
                self.ends[i] = token.endswith("</w>")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and each text's number of ids."""
        flats, counts, at = [], [], 0
        while at < len(texts):
            to, room = at, BATCH_BYTES
            while to < len(texts) and (to == at or room >= len(texts[to])):
                room -= len(texts[to])
                to += 1
            flat, n = self._by_word(texts[at:to]) if self.by_word else self._whole(texts[at:to])
            flats.append(flat)
            counts.append(n)
            at = to
        return np.concatenate(flats or [np.zeros(0, self.dtype)]), np.concatenate(counts or [np.zeros(0, np.int64)])

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.tok.encode(t, add_special_tokens=False).ids for t in texts]
        return np.fromiter((x for y in ids for x in y), self.dtype), np.array([len(x) for x in ids], np.int64)

    def _by_word(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        words = pc.list_flatten(split)
        offsets = split.offsets.to_numpy()
        keep = pc.not_equal(words, "")
        kept = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
        coded = words.filter(keep).dictionary_encode()
        flat, starts = self._distinct(coded.dictionary)
        index = coded.indices.to_numpy()
        n = np.diff(starts)[index]
        out = _gather(flat, starts[index], n)
        total = np.concatenate([[0], np.cumsum(n)])
        return out, np.diff(total[kept[offsets]])

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each of the distinct words: flat, with starts. A word of letters and a tail is two lookups."""
        if not len(words):
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        core = pc.ascii_rtrim(words, TAIL)
        plain = pc.and_(pc.utf8_is_alpha(core), pc.invert(pc.match_substring(core, "\u0130")))  # whose lower case is no letter alone
        heads = pc.if_else(plain, pc.ascii_lower(core), words).dictionary_encode()
        tails = pc.if_else(plain, pc.replace_substring_regex(words, r"^\p{L}+", ""), "").dictionary_encode()
        is_plain = np.zeros(len(heads.dictionary), bool)
        is_plain[heads.indices.to_numpy()[plain.to_numpy(zero_copy_only=False)]] = True
        parts = self._remembered(heads.dictionary.to_pylist(), is_plain)
        first_tail = len(parts)
        parts += [self._one(t) for t in tails.dictionary.to_pylist()]
        flat = np.frombuffer(b"".join(parts), self.dtype)
        n = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize
        starts = np.cumsum(n) - n
        pick = np.empty(2 * len(words), np.int64)
        pick[::2], pick[1::2] = heads.indices.to_numpy(), tails.indices.to_numpy() + first_tail
        out = _gather(flat, starts[pick], n[pick])
        return out, np.concatenate([[0], np.cumsum(n[pick].reshape(-1, 2).sum(axis=1))])

    def _one(self, word: str) -> bytes:
        return np.array(self.tok.encode(word, add_special_tokens=False).ids, self.dtype).tobytes() if word else b""

    def _remembered(self, words: list[str], plain: np.ndarray) -> list[bytes]:
        got = [self.known.get(w) for w in words]
        new = [i for i, x in enumerate(got) if x is None]
        runs = [i for i in new if plain[i]]
        for i in (i for i in new if not plain[i]):
            got[i] = self._one(words[i])
        if runs:
            ids = np.array(self.tok.encode(" ".join(words[i] for i in runs), add_special_tokens=False).ids, self.dtype)
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(runs):
                raw, k = ids.tobytes(), self.dtype.itemsize
                for i, a, b in zip(runs, [0, *last.tolist()], last.tolist(), strict=False):
                    got[i] = raw[a * k : b * k]
            else:
                for i in runs:
                    got[i] = self._one(words[i])
        for i in new[: REMEMBERED - len(self.known)]:
            self.known[words[i]] = got[i]
        return got


def _gather(flat: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[s : s + k] for each start and count, one after the other."""
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(starts - (ends - n), n) + np.arange(ends[-1])]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Of (doc_id, text) batches: the doc_ids, their ids with ``end_id`` after each document, and each one's count."""
    enc = encoder(path)
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        at = 0
        while at < len(texts):
            to, room = at, BATCH_BYTES
            while to < len(texts) and (to == at or room >= len(texts[to])):
                room -= len(texts[to])
                to += 1
            flat, n = enc.encode(texts[at:to])
            where = np.cumsum(n)
            yield ids[at:to], np.insert(flat, where, end_id), n + 1
            at = to
