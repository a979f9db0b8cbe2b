"""How two tokenizers cut the same text, each distinct text worked on once.

Rows are shuffled by their full text, so each distinct text is tokenised and aligned by
one task, however many documents share it; its pair counts are weighted by
the number of copies, and its measures are joined back to the ids of all of them.

Both vocabularies end a token before a single space that stands between two other
characters which are no white space, so a text falls into chunks there. Where a chunk holds nothing but letters up to
U+023F, ASCII digits, ASCII symbols other than ' and single line feeds, both end a token at every change between these kinds
as well. The units between such places are found on the bytes of many texts at once, and each distinct one is tokenised and
aligned once and kept in a table bounded in bytes. Tokens A and B of a unit are laid
over its bytes: places where both end cut it into groups, and two tokens whose byte ranges overlap are a link.

A pair's corpus-wide count meets the texts in two ways. At most ``HEAVY`` pairs can hold more
than 1/HEAVY of all links each; these are broadcast. The rest are joined by
shuffle on the pair, where no key then has more than that share."""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.llm.bytepair import WordMerger, shown_bytes
from quiver.llm.common import first_part, saved, small_batches, tidy, vocabulary

HEAVY, HOT_TEXTS = 1 << 18, 1000
TABLE_BYTES, LONG_CHUNK, ENTRY_BYTES, SLICE_CHARS = 72_000_000, 64, 350, 4_000_000
MARK, FOLLOWS = "▁", ",|;\n"
SHIFT, PAIR_BITS = 20, 36  # a pair is one number: A's id (16 bits) above, B's id in the lower bits
KEY_BYTES = 24
#: Kinds of bytes: a chunk with any other one goes to the libraries whole.
LETTER, DIGIT, SYMBOL, FEED, SPACE, OTHER = range(6)


def kind_of(c: str) -> int:
    if c in " \n":
        return SPACE if c == " " else FEED
    if c < "\u0240" and c.isalpha() and (c.isascii() or c >= "\u00c0"):
        return LETTER
    return OTHER if not "!" <= c <= "~" or c == "'" else DIGIT if c.isdigit() else SYMBOL


KIND = bytes(kind_of(chr(b)) if b < 128 else OTHER for b in range(256))
#: First bytes of U+00C0 to U+023F, all letters but two, and the second bytes of these two (with the first lead).
LEADS, NO_LETTERS = (0xC3, 0xC8), (0x97, 0xB7)
#: The first two bytes of white space beyond ASCII. All of it lies below U+3001.
WIDE_SPACE = np.array(sorted({int.from_bytes(chr(c).encode()[:2]) for c in range(128, 0x3001) if chr(c).isspace()}))


def units(joined: bytes, fronts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where units begin and end, and whether they are plain and fit a key. ``joined``: texts with a space before each and one at the
    end; ``fronts``: where the texts' spaces are. A chunk starts there and at every space between a byte that is no space and a
    character that is no white space."""
    byte = np.frombuffer(joined, np.uint8)
    kind = np.frombuffer(bytearray(joined.translate(KIND)), np.uint8)
    n = len(byte) - 1
    lead = np.flatnonzero((byte >= LEADS[0]) & (byte <= LEADS[1]))
    lead = lead[(byte[lead] != LEADS[0]) | ~np.isin(byte[lead + 1], NO_LETTERS)]
    kind[lead] = kind[lead + 1] = LETTER

    space = np.flatnonzero(byte[:n] == 32)
    after = byte[space + 1]
    solid = (after > 32) & (byte[space - 1] != 32)
    wide = np.flatnonzero(after >= 128)
    solid[wide] &= ~np.isin(after[wide].astype(np.int64) << 8 | byte[space[wide] + 2], WIDE_SPACE)
    start = np.zeros(n + 1, bool)
    start[space[solid]] = start[fronts] = start[n] = True
    kind[space[~start[space] | (kind[space + 1] > SYMBOL)]] = OTHER
    feed = np.flatnonzero(kind[:n] == FEED)
    alone = (kind[feed - 1] <= SYMBOL) & ((kind[feed + 1] <= SYMBOL) | start[feed + 1])
    kind[feed[~alone]] = OTHER

    start, kind = start[:n], kind[:n]
    chunk = np.flatnonzero(start)
    whole = np.zeros(len(chunk), bool)
    whole[np.searchsorted(chunk, np.flatnonzero(kind == OTHER), "right") - 1] = True
    kind[np.repeat(whole, np.diff(chunk, append=n))] = OTHER
    start[1:] |= (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE)
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    return starts, ends, (kind[ends - 1] != OTHER) & (ends - starts <= KEY_BYTES)


def keys(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> pa.FixedSizeBinaryArray:
    """The bytes of each unit, filled up with zeros (which no plain unit holds)."""
    byte = np.frombuffer(joined + bytes(KEY_BYTES), np.uint8)
    eight = np.ndarray(len(byte) - 7, "<u8", byte, strides=(1,))
    upto = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    size = ends - starts
    held = np.stack([eight[starts + at] & upto[np.clip(size - at, 0, 8)] for at in range(0, KEY_BYTES, 8)], axis=1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(KEY_BYTES), len(starts), [None, pa.py_buffer(held)])


def gather(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each ``begin`` on, ``n`` of them, one run behind the other."""
    return np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)


class Aligner:
    """Texts from a table of aligned units: tokens A, tokens B, groups, links, and whether the bytes of B differ from the unit's;
    groups as text; links as numbers. (The bytes of A never differ: its vocabulary holds every byte.)"""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        shown = set(shown_bytes())
        vocab = self.a.get_vocab(with_added_tokens=False)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if self.a.normalizer or not shown <= set(vocab):
            raise ValueError("tokens A need not spell the text")
        if len(pieces) >= 1 << SHIFT or any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError("this model's pieces can cross whitespace markers or line feeds")
        merged = [p.lstrip(MARK) for i, p in enumerate(pieces) if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i))]
        if any(len({kind_of(c) for c in p}) > 1 and len({kind_of(x), kind_of(y), OTHER}) == 3 for p in merged for x, y in zip(p, p[1:])):
            raise ValueError("this model's pieces can cross from letters, digits or symbols to another of these kinds")
        self.merger = WordMerger(path_a)
        self.size_a = np.zeros(max(vocab.values()) + 1, np.int64)
        for t, i in vocab.items():
            self.size_a[i] = len(t)  # one shown character a byte
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.lead = len(self.b.encode("\n"))
        self.shown = [f"{i}{f}" for i in range(max(len(self.size_a), len(pieces))) for f in FOLLOWS]
        self.table: dict[bytes | str, int] = {}
        self.strings: list[str] = []
        self.measures, self.begin, self.links = np.zeros((0, 5), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.size = 0

    @staticmethod
    @functools.cache
    def here(path_a: str, path_b: str) -> "Aligner":
        """This worker's aligner. Between tasks it keeps the vocabularies and the part of the table that came first."""
        return Aligner(path_a, path_b)

    def forget(self, share: int) -> None:
        self.table = first_part(self.table, share)
        self.cut(len(self.table))
        self.size = ENTRY_BYTES * len(self.table) + sum(map(len, self.table)) + sum(map(len, self.strings)) + self.links.nbytes

    def cut(self, n: int) -> None:
        """Keeps the first ``n`` rows."""
        self.links = self.links[:int(self.measures[:n, 3].sum())].copy()
        self.strings, self.measures, self.begin = self.strings[:n], self.measures[:n].copy(), self.begin[:n].copy()

    def tokens_a(self, words: np.ndarray, other: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A, and how many each unit has. A plain unit is one unit of the vocabulary too; such
        units are merged many at a time. Others are left to the library."""
        flat, begin, n = self.merger.spans(words)
        ids = [e.ids for e in self.a.encode_batch(other, add_special_tokens=False)]
        n_other = np.array([len(x) for x in ids], np.int64)
        return np.concatenate([flat[gather(begin, n)], np.fromiter(chain.from_iterable(ids), np.int64, n_other.sum())]), np.concatenate([n, n_other])

    def learn(self, words: list[bytes], other: list[str]) -> None:
        """New rows: plain units, as keys, and others. All are laid one behind the other over their bytes, so that both sides' token ends are two ascending lists."""
        a, n_a = self.tokens_a(np.frombuffer(b"".join(words), np.uint8).reshape(-1, KEY_BYTES), other)
        units = [w.rstrip(b"\0").decode() for w in words] + other
        b = [x[self.lead:] for x in self.b.encode(["\n" + u for u in units], num_threads=1)]  # a line feed keeps B's own dummy marker off the unit
        same = np.array([b"".join(map(self.bytes_b.__getitem__, x)) == u.encode() for x, u in zip(b, units)], bool)
        n_b = np.array([len(x) for x in b], np.int64)
        b = np.fromiter(chain.from_iterable(b), np.int64, n_b.sum())
        a, b, n_a, n_b = a[np.repeat(same, n_a)], b[np.repeat(same, n_b)], n_a * same, n_b * same
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        first, last = np.searchsorted(end_b, end_a - self.size_a[a], "right"), np.searchsorted(end_b, end_a)
        n = last - first + 1  # tokens of B that a token of A overlaps
        links = np.repeat(a, n) << SHIFT | b[gather(first, n)]
        cut_a, cut_b = end_b[last] == end_a, end_a[np.searchsorted(end_a, end_b)] == end_b
        unit_a = np.repeat(np.arange(len(units)), n_a)
        n_groups, n_links = np.bincount(unit_a[cut_a], minlength=len(units)), np.bincount(unit_a, weights=n, minlength=len(units)).astype(np.int64)
        # groups as text: the tokens of A, then those of B, of one group after another, each with what follows it
        after_b = np.where(cut_b, 2, 0)
        after_b[(np.cumsum(n_b) - 1)[same]] = 3
        order = np.argsort(np.concatenate([2 * (np.cumsum(cut_a) - cut_a), 2 * (np.cumsum(cut_b) - cut_b) + 1]), kind="stable")
        token = (len(FOLLOWS) * np.concatenate([a, b]) + np.concatenate([np.where(cut_a, 1, 0), after_b]))[order]
        text = iter("".join(map(self.shown.__getitem__, token.tolist())).split("\n"))
        self.strings += [next(text) if ok else "" for ok in same.tolist()]
        self.measures = np.concatenate([self.measures, np.stack([n_a, n_b, n_groups, n_links, ~same], axis=1)])
        self.begin = np.concatenate([self.begin, len(self.links) + np.cumsum(n_links) - n_links])
        self.links = np.concatenate([self.links, links])

    def rows(self, names: list[bytes | str]) -> np.ndarray:
        """Rows of the table, new ones learnt together. Those of long units come last and are not in ``table``."""
        at = np.array([self.table.get(x, -1) for x in names], np.int64)
        new = np.flatnonzero(at < 0).tolist()
        words = [i for i in new if isinstance(names[i], bytes)]
        short = [i for i in new[len(words):] if len(names[i]) <= LONG_CHUNK]
        long = [i for i in new[len(words):] if len(names[i]) > LONG_CHUNK]
        before = len(self.strings)
        self.learn([names[i] for i in words], [names[i] for i in short + long])
        at[words + short + long] = np.arange(before, before + len(new))
        self.table.update((names[i], k) for k, i in enumerate(words + short, before))
        kept = slice(before, len(self.table))
        self.size += ENTRY_BYTES * (len(self.table) - before) + sum(len(names[i]) for i in words + short)
        self.size += sum(map(len, self.strings[kept])) + 8 * int(self.measures[kept, 3].sum())
        return at

    def texts(self, texts: list[str]) -> list[tuple | None]:
        """Per text: tokens A and B, groups, links, digest of the groups, distinct links and their counts; None where
        bytes differ. New units of all texts are learnt together; long ones are not kept."""
        if not texts:
            return []
        if self.size > TABLE_BYTES:
            self.forget(4)
        raw = [t.encode() for t in texts]
        joined = b" ".join([b"", *raw, b""])
        fronts = np.cumsum([0, *(len(r) + 1 for r in raw[:-1])])
        starts, ends, plain = units(joined, fronts)
        seen = keys(joined, starts[plain], ends[plain]).dictionary_encode()
        words = seen.dictionary.to_pylist()
        rest = [joined[s:e].decode() for s, e in zip(starts[~plain].tolist(), ends[~plain].tolist())]
        place = {c: i for i, c in enumerate(dict.fromkeys(rest), len(words))}
        at = self.rows(words + list(place))
        row = np.empty(len(starts), np.int64)
        row[plain] = at[seen.indices.to_numpy()]
        row[~plain] = at[[place[c] for c in rest]] if rest else 0

        cuts = np.searchsorted(starts, fronts)
        sums = np.stack([np.add.reduceat(self.measures[:, k][row], cuts) for k in range(5)], axis=1)
        pairs = self.links[gather(self.begin[row], self.measures[:, 3][row])]
        pairs |= np.repeat(np.arange(len(texts)) << PAIR_BITS, sums[:, 3])
        pairs.sort()
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        counts, pairs = np.diff(first, append=len(pairs)).astype(np.int32), pairs[first]
        upto = np.searchsorted(pairs, np.arange(len(texts) + 1) << PAIR_BITS)
        pairs &= (1 << PAIR_BITS) - 1
        strings = list(map(self.strings.__getitem__, row.tolist()))
        self.cut(len(self.table))
        out: list[tuple | None] = []
        for (*n, bad), s, e, u, v in zip(sums.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(row)], upto[:-1].tolist(), upto[1:].tolist()):
            out.append(None if bad else (*n, hashlib.sha256(";".join(strings[s:e]).encode()).hexdigest(), pairs[u:v], counts[u:v]))
        return out


def slices(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of ``SLICE_CHARS`` together, or one that is longer."""
    held: list[str] = []
    size = 0
    for t in texts:
        if held and size + len(t) > SLICE_CHARS:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


ALIGNED = "digest binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, counts array<int>"
MEASURES = ["n_a", "n_b", "n_groups", "n_links"]


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def aligned_texts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per distinct text with tokens on both sides (columns of ``ALIGNED``)."""
    texts = docs.select(docs["text"].alias("text")).filter("text != ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.here(path_a, path_b)
        aligner.forget(4)
        for b in batches:
            at = 0
            for texts in slices(b.column(2).to_pylist()):
                part = b.slice(at, len(texts))
                at += len(texts)
                rows = aligner.texts(texts)
                ok = [r is not None for r in rows]
                rows = [r for r in rows if r]
                ends = pa.array(np.cumsum([0, *(len(r[5]) for r in rows)]), pa.int32())
                flat = [np.concatenate([r[k] for r in rows]) if rows else np.empty(0, kind) for k, kind in ((5, np.int64), (6, np.int32))]
                kept = part.filter(pa.array(ok, pa.bool_()))
                yield pa.RecordBatch.from_arrays(
                    [kept.column(0), kept.column(1), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4)),
                     pa.array([r[4] for r in rows], pa.string()), *(pa.ListArray.from_arrays(ends, pa.array(f)) for f in flat)],
                    [c.split()[0] for c in ALIGNED.split(", ")])

    return texts.select(digest(F.col("text")).alias("digest"), "copies", "text").mapInArrow(tidy(run), ALIGNED)


def pair_counts(texts: DataFrame) -> DataFrame:
    """pair, count (links of all documents that hold it), best (no pair with the same B id has more). B's vocabulary bounds the broadcast side."""
    links = texts.select("copies", F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    counts = saved(links.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum(F.col("x.counts") * F.col("copies")).alias("count")), "pair-counts")
    b = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    top = counts.groupBy(b.alias("b")).agg(F.max("count").alias("top"))
    return counts.withColumn("b", b).join(F.broadcast(top), "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    Null and empty texts, and texts whose tokens do not spell space + text on either side, have no tokens: zeros and ''.
    Rows that repeat an id or have none are rows like all others. Other columns are ignored."""
    path_a, path_b = path_a or vocabulary("byte_bpe_50k.json"), path_b or vocabulary("piece_bpe_32k.model")
    small_batches(docs.sparkSession)
    texts = saved(aligned_texts(docs, path_a, path_b).withColumn("uid", F.monotonically_increasing_id()), "aligned-texts")
    counts = saved(pair_counts(texts), "pair-ranks")
    total = counts.agg(F.sum("count")).first()[0] or 0
    is_heavy = F.col("count") > F.lit(total // heavy)
    often = F.broadcast(counts.filter(is_heavy))  # fewer than ``heavy`` rows, since each has more than 1 / heavy of the links
    links = texts.select("uid", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(
        "uid", F.col("x.pairs").alias("pair"), F.col("x.counts").cast("long").alias("n"))
    sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")]
    seldom = links.join(often.select("pair"), "pair", "left_anti").join(counts.filter(~is_heavy), "pair")
    both = links.join(often, "pair").groupBy("uid").agg(*sums).unionByName(seldom.groupBy("uid").agg(*sums))
    both = both.groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    measures = saved(texts.drop("pairs", "counts").join(both, "uid").drop("uid"), "text-measures")

    text = docs["text"]
    alone = F.concat(F.lit("-"), F.monotonically_increasing_id()).cast("binary")  # rows without text stay dealt out
    keyed = saved(docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.when(text != "", digest(text)).otherwise(alone).alias("digest")), "text-digests")
    rows = keyed.count()
    hot = F.broadcast(measures.filter(F.col("copies") > F.lit(rows // HOT_TEXTS)))  # fewer than HOT_TEXTS rows
    rest = keyed.join(hot.select("digest"), "digest", "left_anti").join(measures, "digest", "left")
    out = keyed.join(hot, "digest").unionByName(rest)
    return out.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*MEASURES, "n_best", "count_sum")],
                      F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
