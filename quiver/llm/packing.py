"""Packing documents into sequences by non-negative least squares.

A document is cut into whole windows and a remainder. The remainders' lengths form a
histogram of at most ``window - 1`` bars. All shallow combinations (two or three
lengths that fill a window exactly) are enumerated, and non-negative least squares
says how often to repeat each, so that together they use up the histogram. Repeat
counts are rounded to what the histogram still holds. What is left over is packed
greedily: laid end to end in order of length and cut where a window is full, so that only
the very last sequence can hold padding.

The plan is of bounded size. Ranks of remainders within a length come from counts
per (chunk, length), so no pass holds all documents of a length in one task."""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiver.llm.bytepair import PLAIN, WordMerger
from quiver.llm.common import first_part, saved, small_batches, spread_out, tidy, vocabulary

WINDOW, END_ID = 2048, 1
TABLE_BYTES, ENTRY_BYTES, LONG_CHUNK, BATCH_BYTES = 60_000_000, 190, 64, 1 << 22
FILTER_SLOTS = 1 << 18
#: Kinds of bytes: white space, (part of) a letter, a symbol of ``PLAIN``; a chunk with any other byte goes to ``learn`` whole.
SPACE, LETTER, SYMBOL, OTHER = range(4)
KIND = bytes(SPACE if b in b" \t\n\r\v\f" else LETTER if chr(b).isalpha() else SYMBOL if PLAIN.fullmatch(chr(b)) else OTHER
             for b in range(128)) + bytes([OTHER] * 128)
LOWER = bytes(range(256)).lower()
#: The lead byte of U+00C0 to U+00FF, all letters but two, and the bytes a unit's key has room for.
LATIN, NO_LETTERS, KEY_BYTES = 0xC3, (0x97, 0xB7), 16


def units(kind: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where units of the text begin and end, and whether they are plain and fit a key. Units are runs of letters or of
    symbols, or whole chunks with other bytes. Marks U+00C0 to U+00FF in ``kind`` as letters and lowers them in ``low``."""
    lead = np.flatnonzero(low[:len(kind)] == LATIN)
    lead = lead[(low[lead + 1] & 0xC0 == 0x80) & ~np.isin(low[lead + 1], NO_LETTERS)]
    kind[lead] = kind[lead + 1] = LETTER
    low[lead[low[lead + 1] < 0x9F] + 1] |= 0x20
    other = np.flatnonzero(kind == OTHER)
    if len(other):
        space = np.flatnonzero(kind == SPACE)  # the last byte is one
        after = np.unique(np.searchsorted(space, other))
        inside = np.zeros(len(kind), np.int8)
        inside[np.where(after > 0, space[after - 1] + 1, 0)] = 1
        inside[space[after]] -= 1
        kind[np.cumsum(inside, dtype=np.int8) > 0] = OTHER
    cuts = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(kind)]])
    of = kind[cuts[:-1]]
    starts, ends, of = cuts[:-1][of != SPACE], cuts[1:][of != SPACE], of[of != SPACE]
    return starts, ends, (of != OTHER) & (ends - starts <= KEY_BYTES)


def keys(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of each unit, filled up with zeros (which no plain unit holds)."""
    eight = np.ndarray(len(low) - 7, "<u8", low, strides=(1,))
    upto = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    size = ends - starts
    return np.stack([eight[starts + at] & upto[np.clip(size - at, 0, 8)] for at in (0, 8)], axis=1)


class Encoder:
    """Token ids as little-endian bytes. White space (ASCII) always ends a token of this vocabulary, and so does the change
    between plain letters and symbols. Other chunks are kept in a table bounded in bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.merger = WordMerger(path)
        self.table: dict[bytes, bytes] = {}
        self.size = 0

    def forget(self, share: int) -> None:
        self.table = first_part(self.table, share)
        self.size = sum(ENTRY_BYTES + len(c) + len(x) for c, x in self.table.items())

    def batch(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, of some texts at a time."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH_BYTES):
                size += len(texts[end])
                end += 1
            out += self.together(texts[at:end])
            at = end
        return out

    def together(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text. The texts' units, runs of letters or of symbols, are encoded once each, all new ones together."""
        joined = b"\n".join([*texts, b""])
        low = np.frombuffer(bytearray(joined.translate(LOWER) + bytes(KEY_BYTES)), np.uint8)
        starts, ends, plain = units(np.frombuffer(bytearray(joined.translate(KIND)), np.uint8), low)
        seen = pa.FixedSizeBinaryArray.from_buffers(
            pa.binary(KEY_BYTES), int(plain.sum()), [None, pa.py_buffer(keys(low, starts[plain], ends[plain]))]).dictionary_encode()
        words = np.frombuffer(b"".join(seen.dictionary.to_pylist()), np.uint8).reshape(-1, KEY_BYTES)
        flat, begin, count = self.merger.spans(words)
        chunks = [joined[s:e] for s, e in zip(starts[~plain].tolist(), ends[~plain].tolist())]
        if self.size > TABLE_BYTES:
            self.forget(4)
        names = {c: i for i, c in enumerate(dict.fromkeys(chunks), len(words))}
        long = self.learn([c for c in names if c not in self.table])
        rest = [np.frombuffer(long[c] if c in long else self.table[c], "<u4") for c in names]
        sizes = np.array([len(x) for x in rest], np.int64)
        begin = np.concatenate([begin, len(flat) + np.cumsum(sizes) - sizes])
        count = np.concatenate([count, sizes])
        flat = np.concatenate([flat, *rest]).astype("<u4")

        code = np.empty(len(starts), np.int64)
        code[plain] = seen.indices.to_numpy()
        code[~plain] = [names[c] for c in chunks]
        n = count[code]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.arange(upto[-1]) + np.repeat(begin[code] - upto[:-1], n)].tobytes()
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        cuts = [0, *(4 * upto[np.searchsorted(starts, text_ends)]).tolist()]
        return [ids[s:e] for s, e in zip(cuts[:-1], cuts[1:])]

    def learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new chunks: plain ones from their letters and the symbols behind these, others from the library.
        Those of long chunks are returned instead of kept."""
        short = [c for c in new if len(c) <= LONG_CHUNK]
        words = [c for c in short if c.isalpha()]  # ASCII letters
        ended = [c for c in short if c[-1:] in b".,!" and c[:-1].isalpha()]
        mixed, other, long = [], [], {}
        for c in set(new).difference(words, ended):
            s = c.decode().lower()
            m = PLAIN.fullmatch(s)
            if m and len(c) <= LONG_CHUNK and (s.isascii() or max(s) < "\u0300"):
                mixed.append((c, m.group(1).encode(), m.group(2).encode()))
            else:
                other.append(c)
        low, stems, ends = [c.lower() for c in words], [c[:-1].lower() for c in ended], [c[-1:] for c in ended]
        parts = self.merger.ids(list({*low, *stems, *ends, *(x[1] for x in mixed), *(x[2] for x in mixed)}))
        found = [parts[w] for w in low] + [parts[w] + parts[x] for w, x in zip(stems, ends)] + [parts[w] + parts[x] for _, w, x in mixed]
        learnt = words + ended + [x[0] for x in mixed]
        self.table.update(zip(learnt, found))
        self.size += ENTRY_BYTES * len(learnt) + sum(map(len, learnt)) + sum(map(len, found))
        for c, e in zip(other, self.tok.encode_batch([c.decode() for c in other], add_special_tokens=False)):
            x = np.array(e.ids, "<u4").tobytes()
            if len(c) <= LONG_CHUNK:
                self.table[c] = x
                self.size += ENTRY_BYTES + len(c) + len(x)
            else:
                long[c] = x
        return long

    @staticmethod
    @functools.cache
    def here(path: str) -> "Encoder":
        """This worker's encoder. Between tasks it keeps the vocabulary and the part of the table that came first."""
        return Encoder(path)


def encoded(docs: DataFrame, path: str, window: int, end_id: int) -> DataFrame:
    """doc_id, n (ids with the end), crcs of the whole windows and of the remainder,
    and the remainder's ids (16 bits each where the vocabulary allows)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = Encoder.here(path), np.array([end_id], "<u4").tobytes()
        enc.forget(4)
        wide = enc.tok.get_vocab_size() > 1 << 16
        for b in batches:
            n, crcs, rest, left = [], [], [], []
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for ids in (x + end for x in enc.batch(texts)):
                size = len(ids) // 4
                whole = size // window
                n.append(size)
                crcs.append([zlib.crc32(ids[4 * window * i:4 * window * (i + 1)]) for i in range(whole)])
                tail = ids[4 * window * whole:]
                rest.append(zlib.crc32(tail))
                left.append(tail if wide else np.frombuffer(tail, "<u4").astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rest, pa.int64()),
                 pa.array(left, pa.binary())], ["doc_id", "n", "crcs", "rest_crc", "rest"])

    src = spread_out(docs).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return src.mapInArrow(tidy(run), "doc_id long, n long, crcs array<long>, rest_crc long, rest binary")


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Pairs and triples of the given lengths, in ascending order, that fill a window; 0 stands for no third one."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    out = [np.array([(0, a, window - a) for a in lengths if a <= window - a and have[window - a]], int).reshape(-1, 3)]
    for a in lengths[lengths * 3 <= window]:
        b = lengths[(lengths >= a) & (2 * lengths <= window - a)]
        c = window - a - b
        ok = have[c]
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(out)


def nnls(combos: np.ndarray, hist: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative x that minimises the squared difference between the lengths that the
    repeated combinations use and the histogram: accelerated projected gradient steps on the sparse system."""
    x = y = np.zeros(len(combos))
    if not len(combos):
        return x
    used = np.bincount(combos.ravel(), minlength=len(hist)).astype(float)
    used[0] = 0
    step = 1.0 / (3.0 * max(1.0, used.max()))
    t = 1.0
    mask = (combos > 0).astype(float)
    for _ in range(rounds):
        made = np.bincount(combos.ravel(), weights=(y[:, None] * mask).ravel(), minlength=len(hist))
        off = made - hist
        off[0] = 0
        new = np.maximum(0.0, y - step * off[combos].sum(axis=1))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def plan(hist: np.ndarray, window: int) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """Combinations as (repeats, ...) in sequence order, and how many remainders of each length they use."""
    lengths = np.nonzero(hist[:window])[0]
    lengths = lengths[lengths > 0]
    combos = combinations(lengths, window)
    x = nnls(combos, hist.astype(float))
    left = hist.astype(np.int64).copy()
    out = []
    for i in np.argsort(-x, kind="stable"):
        n = int(round(x[i]))
        if not n:
            break
        parts = [int(p) for p in combos[i] if p]
        n = min([n, *(left[p] // parts.count(p) for p in parts)])
        if n > 0:
            for p in parts:
                left[p] -= n
            out.append((int(n), parts))
    return out, hist - left


class Places:
    """Where the remainder with a given rank among those of its length goes: bounded arrays, looked up per row."""

    def __init__(self, hist: np.ndarray, window: int):
        self.window = window
        combos, self.used = plan(hist, window)
        uses: dict[int, list[tuple[int, int, int]]] = {}
        filled = np.zeros(len(hist), np.int64)
        base = 0
        for n, parts in combos:
            at = 0
            for p in parts:
                uses.setdefault(p, []).append((int(filled[p]), base, at))
                filled[p] += n
                at += p
            base += n
        self.uses = {p: np.array(u, np.int64) for p, u in uses.items()}
        left = (hist - self.used) * np.arange(len(hist))
        self.first_left = base
        self.offset = np.concatenate([[0], np.cumsum(left)[:-1]]).astype(np.int64)
        self.sequences = base + -(-int(left.sum()) // window)

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the remainder, length, sequence, offset) of each piece."""
        if rank < self.used[length]:
            u = self.uses[length]
            first, base, at = u[np.searchsorted(u[:, 0], rank, side="right") - 1]
            return [(0, length, int(base + rank - first), int(at))]
        pos = int(self.offset[length] + (rank - self.used[length]) * length)
        out, done = [], 0
        while done < length:
            seq, at = divmod(pos + done, self.window)
            n = min(length - done, self.window - at)
            out.append((done, n, self.first_left + seq, at))
            done += n
        return out


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, chunks: int = 512) -> DataFrame:
    """One row per piece of a document (columns of ``PIECE``). Null and empty texts
    give the end id alone; rows that repeat an id are documents of their own; an empty table gives no rows."""
    spark = docs.sparkSession
    path = path or vocabulary("word_bpe_49k.json")
    small_batches(spark)
    rows = saved(encoded(docs, path, window, end_id).withColumn("uid", F.monotonically_increasing_id()), "pack-ids")
    small = rows.select("uid", "doc_id", "n", "rest_crc", (F.col("n") % window).cast("int").alias("len"),
                        F.floor(F.col("n") / window).cast("long").alias("whole"), F.pmod(F.xxhash64("uid"), F.lit(chunks)).cast("int").alias("chunk"))
    small = saved(small, "pack-lengths")
    counts = small.groupBy("len", "chunk").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("len").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = saved(counts.withColumn("first", F.coalesce(F.sum("c").over(before), F.lit(0))), "pack-counts")
    hist = np.zeros(window, np.int64)
    for r in counts.groupBy("len").agg(F.sum("c").alias("c")).collect():  # at most one row a length
        hist[r.len] = r.c
    hist[0] = 0
    places = spark.sparkContext.broadcast(Places(hist, window))
    whole_base = {r.chunk: r.w for r in small.groupBy("chunk").agg(F.sum("whole").alias("w")).collect()}
    at, first_whole = places.value.sequences, []
    for c in range(chunks):
        first_whole.append(at)
        at += whole_base.get(c) or 0

    in_len, in_chunk = Window.partitionBy("chunk", "len").orderBy("uid"), Window.partitionBy("chunk").orderBy("len", "uid")
    ranked = (small.withColumn("nth", F.row_number().over(in_len) - 1)
              .withColumn("whole_before", F.sum("whole").over(in_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("whole"))
              .join(counts.select("len", "chunk", "first"), ["len", "chunk"]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = b.to_pydict()
            out: list[list] = [[] for _ in range(6)]
            for uid, length, rank in zip(r["uid"], r["len"], r["rank"]):
                for start, n, seq, off in places.value.pieces(length, rank) if length else ():
                    for col, v in zip(out, (uid, start, n, seq, off, n < length)):
                        col.append(v)
            kinds = [pa.int64()] * 5 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)],
                                             ["uid", "start", "length", "sequence_id", "offset", "cut"])

    ranked = saved(ranked.select("uid", "doc_id", "n", "rest_crc", "len", "whole", "chunk", "whole_before",
                                 (F.col("first") + F.col("nth")).alias("rank")), "pack-ranks")
    placed = saved(ranked.select("uid", "len", "rank").mapInArrow(
        place, "uid long, start long, length long, sequence_id long, offset long, cut boolean"), "pack-places")

    # Remainders that are cut need their ids for the checksum; a fixed number of slots keeps most others out of that join.
    slot = F.pmod(F.xxhash64("uid"), F.lit(FILTER_SLOTS))
    cut = placed.filter("cut")
    slots = F.broadcast(cut.select(slot.alias("slot")).distinct())
    ids = rows.select("uid", "rest", (F.col("n") % window).cast("int").alias("len"), slot.alias("slot")).join(
        slots, "slot", "left_semi").drop("slot")

    def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = b.to_pydict()
            crc = [zlib.crc32(np.frombuffer(x, f"<u{len(x) // m}")[s:s + n].astype("<u4").tobytes())
                   for x, m, s, n in zip(r["rest"], r["len"], r["start"], r["length"])]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(crc, pa.int64())],
                                             ["uid", "start", "length", "sequence_id", "offset", "piece_crc"])

    piece = ["uid", "start", "length", "sequence_id", "offset"]
    cut = cut.join(ids, "uid").select(*piece, "rest", "len").mapInArrow(
        checksums, "uid long, start long, length long, sequence_id long, offset long, piece_crc long")
    whole_rest = placed.filter("not cut").select(*piece, F.lit(None).cast("long").alias("piece_crc"))
    rest = whole_rest.unionByName(cut).join(ranked.select("uid", "doc_id", "n", "rest_crc", "whole"), "uid").select(
        "doc_id", (F.col("whole") * window + F.col("start")).alias("start"), "length",
        F.coalesce("piece_crc", "rest_crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")
    full = ranked.filter("whole > 0").join(rows.filter(F.size("crcs") > 0).select("uid", "crcs"), "uid")
    bases = F.broadcast(spark.createDataFrame(list(enumerate(first_whole)), "chunk int, base long"))
    full = full.join(bases, "chunk").select(
        "doc_id", "n", "whole_before", "base", F.posexplode("crcs").alias("i", "ids_crc32")).select(
        "doc_id", (F.col("i").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32",
        F.col("n").alias("doc_tokens"), (F.col("base") + F.col("whole_before") + F.col("i")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    return rest.unionByName(full)
