"""Words and word shingles as 64-bit hashes, for whole Arrow batches at once."""

from __future__ import annotations

import numpy as np
import xxhash

from quiver.llm.common import first_part

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
FOLD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of the table of words, and what an entry takes besides its word (dictionary slot, object headers, the hash).
TABLE_BYTES, ENTRY_BYTES = 40_000_000, 180


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of the words of lower-cased texts. ``bytes.lower`` changes A-Z only, and
    ``bytes.split`` splits at exactly 0x20 and 0x09-0x0D. Each word is hashed once as long as the bounded table holds it."""

    def __init__(self):
        self.table: dict[bytes, int] = {}
        self.size = 0

    def hashes(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if self.size > TABLE_BYTES:
            self.table = first_part(self.table)
            self.size = sum(map(len, self.table)) + ENTRY_BYTES * len(self.table)
        table = self.table
        for w in set(words):
            if w not in table:
                table[w] = xxhash.xxh3_64_intdigest(w)
                self.size += ENTRY_BYTES + len(w)
        return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingles of ``width`` words, sorted; with fewer words, the whole sequence as one; none without words."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        h = np.full(n, width, np.uint64)
        for k in range(width):
            h = h * FOLD + words[k:k + n]
        return np.unique(mix(h))


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        return int(mix(s).sum(dtype=np.uint64).astype(np.int64)), int(mix(s ^ FOLD).sum(dtype=np.uint64).astype(np.int64))
