"""Token ids of many plain words at once.

The library takes some twenty microseconds for a word alone. Here the merges of a
byte-pair vocabulary are applied to arrays of words of one length: in every round each word makes its own
next merge (the lowest rank, leftmost first), until none has any left. Only chunks of plain letters, followed by
plain symbols, go this way; all others are left to the library, which also
serves as the measure in the tests."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np

#: Letters (below U+0300, where composing and lower-casing act on single characters), then ASCII symbols other than ' < _
PLAIN = re.compile(r"([^\W\d_]*)([!-&(-/:;=>?@\[-^`{-~]*)")
NONE = np.int32(1 << 30)


def shown_bytes() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones themselves, the others from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordMerger:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        if model["type"] != "BPE" or model.get("dropout") or len(vocab) >= 1 << 16:
            raise ValueError("not a byte-pair vocabulary")
        shown = shown_bytes()
        self.inner = np.array([vocab[c] for c in shown], np.int32)
        self.last = np.array([vocab[c + suffix] for c in shown], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # Ranks of two bytes side by side, within a word and at its end
        self.first = [self.ranks(np.repeat(self.inner, 256), np.tile(x, 256)) for x in (self.inner, self.last)]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a.astype(np.int64) << 16 | b
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where(self.key[at] == k, self.rank[at], NONE)

    def merged(self, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of words of one length, as rows of bytes: (row numbers, their ids as rows) of those with equally many ids, until all are given."""
        sym = self.inner[raw]
        sym[:, -1] = self.last[raw[:, -1]]
        who = np.arange(len(raw))
        pair = raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]
        rank = self.first[0][pair]
        if raw.shape[1] > 1:
            rank[:, -1] = self.first[1][pair[:, -1]]
        while len(who):
            n = sym.shape[1]
            rows = np.arange(len(who))
            at = rank.argmin(axis=1) if n > 1 else np.zeros(len(who), np.int64)
            go = rank[rows, at] < NONE if n > 1 else np.zeros(len(who), bool)
            yield who[~go], sym[~go]
            who, sym, rank, at = who[go], sym[go], rank[go], at[go]
            if not len(who):
                break
            rows = np.arange(len(who))
            new = self.made[rank[rows, at]]
            left = np.arange(n - 1)
            sym = np.take_along_axis(sym, left + (left > at[:, None]), axis=1)  # the pair's right half closes up
            sym[rows, at] = new
            left = np.arange(n - 2)
            rank = np.take_along_axis(rank, left + (left >= at[:, None]), axis=1)
            has = at > 0
            rank[rows[has], at[has] - 1] = self.ranks(sym[rows[has], at[has] - 1], new[has])
            has = at < n - 2
            rank[rows[has], at[has]] = self.ranks(new[has], sym[rows[has], at[has] + 1])

    def same_length(self, words: list[bytes]) -> list[bytes]:
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
        out: list[bytes] = [b""] * len(words)
        for who, sym in self.merged(raw):
            for w, ids in zip(who.tolist(), sym.astype("<u4").view(f"V{4 * sym.shape[1]}").ravel().tolist()):
                out[w] = ids
        return out

    def ids(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Little-endian 32-bit ids of words (normalised as the vocabulary wants them), each taken as one unit of the vocabulary."""
        by_length: dict[int, list[bytes]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        out = {b"": b""}
        by_length.pop(0, None)
        for n, group in by_length.items():
            for at in range(0, len(group), 1 << 16):
                part = group[at:at + (1 << 16)]
                out.update(zip(part, self.same_length(part)))
        return out

    def spans(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words as rows of bytes, filled up with zeros: ids of all words in one array, and where in it each word's begin and how many they are."""
        size = np.count_nonzero(words, axis=1)
        begin, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        flat, at = [np.zeros(0, np.int32)], 0
        for n in np.unique(size).tolist():
            group = np.flatnonzero(size == n)
            for part in np.split(group, range(1 << 16, len(group), 1 << 16)):
                for who, sym in self.merged(words[part, :n]):
                    begin[part[who]] = at + np.arange(len(who)) * sym.shape[1]
                    count[part[who]] = sym.shape[1]
                    flat.append(sym.ravel())
                    at += sym.size
        return np.concatenate(flat), begin, count
