"""Katz backoff language model, counted and evaluated in partitioned tables.

Order two: P(w|v) is the Good-Turing discounted share of c(v, w) in c(v) where the pair
was seen, else alpha(v) P(w); P(w) is the discounted share of c(w), and the mass that the discounts free
goes to one class of unknown words. alpha(v) is the mass that v's own discounts free over the mass of the words
not seen behind v, so each context's probabilities add up to exactly 1. Counts up to ``K`` are
discounted by Good-Turing; larger ones give up ``SPARE`` of one occurrence, so that every context has something to give.

Words and pairs are 64-bit hashes in packed, compressed arrays; one row of a table holds one bucket's part.
Fitting stores three tables, each dealt over buckets:
* ``unigrams``, by word: its count (summed per chunk before the shuffle).
* ``pairs``, by the pair's second word: (word, word before it) and its count. Words that make up more than 1/``HEAVY`` of the
  tokens are dealt to all buckets by the word before them. The bucket also knows c(w), so it adds up what each context needs.
* ``contexts``, by context: its count and backoff weight alpha.

Scoring reads nothing but these tables, so any texts can be scored, counted or not. Each distinct (word, word before it, document) goes once,
with its count, to the pair's bucket and looks the pair up. Found, it has its discounted count; else it falls back on the word's own
probability from ``unigrams``, and goes on to the bucket of its context for alpha. A word's own count is also c(v) of the token behind it, so
that factor is added where the word is looked up; tokens that fell back take it out again. Each pass adds up parts per (chunk,
document), which meet in the end. No pass gathers a word, context or document beyond its bucket or chunk."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.llm.common import new_path, saved, small_batches, tidy
from quiver.llm.shingles import Words, mix

K, SPARE, HEAVY, CHUNK_TOKENS, SLICE_ROWS, KEY_BITS = 5, 0.01, 1024, 3_000_000, 400_000, 63
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
ROW = "kind string, bucket int, chunk long, data binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in their narrowest type, compressed; those that mostly ascend as differences (modulo their type), wide ones a byte's place at a time."""
    out = []
    for a in arrays:
        if a.dtype.kind in "iu" and a.dtype != np.uint64:
            a = a.astype(np.min_scalar_type(int(a.max()))) if len(a) else a.astype(np.uint8)
        wide = a.dtype.kind == "u" and a.dtype.itemsize > 1 and len(a) > 1
        step = wide and 2 * np.count_nonzero(a[1:] >= a[:-1]) > len(a)
        if step:
            a = np.diff(a, prepend=a.dtype.type(0))
        raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T if wide else a
        out.append((a.dtype.str, wide, bool(step), zstandard.compress(raw.tobytes(), 1)))
    return pickle.dumps(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out = []
    for kind, wide, step, raw in pickle.loads(data):
        raw = zstandard.decompress(raw)
        if wide:
            raw = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.tobytes()
        a = np.frombuffer(raw, kind)
        out.append(np.cumsum(a, dtype=a.dtype) if step else a)
    return out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys ^ np.uint64(0xA5A5A5A5)) % np.uint64(buckets)).astype(np.int32)


def sums(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of the weights of each."""
    if not len(keys):
        return (keys, *weights)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.nonzero(np.concatenate([[True], k[1:] != k[:-1]]))[0]
    return (k[first], *(np.add.reduceat(w[order], first) for w in weights))


def split(order_key: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """Slices of equal keys of an ascending key array."""
    ends = np.searchsorted(order_key, np.arange(parts + 1))
    return ((b, slice(ends[b], ends[b + 1])) for b in range(parts) if ends[b + 1] > ends[b])


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def chunks(batches: Iterator[pa.RecordBatch]):
    """(ids, tokens per document) of every chunk: tokens are word hashes and one end."""
    words, ids, docs, held = Words(), [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            ids.append(i)
            docs.append(np.append(words.hashes(t or b""), END))
            held += len(docs[-1])
            if held >= CHUNK_TOKENS:
                yield ids, docs
                ids, docs, held = [], [], 0
    if ids:
        yield ids, docs


def batch(rows: list[tuple[str, int, int, bytes]]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["kind", "bucket", "chunk", "data"])


def frame(rows: list[tuple[str, int, int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "bucket", "chunk", "data"])


def discounts(n: list[int]) -> list[float]:
    """d_1..d_K from the counts of counts n[1..K+1]. Where these are too few for Good-Turing (a factor leaves (0, 1)),
    half an occurrence is taken from each count up to K instead."""
    plain = [1 - 0.5 / r for r in range(1, K + 1)]
    if any(x <= 0 for x in n[1:K + 2]):
        return plain
    share = (K + 1) * n[K + 1] / n[1]
    if share >= 1:
        return plain
    out = [((r + 1) * n[r + 1] / (r * n[r]) - share) / (1 - share) for r in range(1, K + 1)]
    return out if all(0 < d < 1 for d in out) else plain


class Unigrams:
    """Discounted word probabilities by count: bounded numbers that every task gets."""

    def __init__(self, tokens: int, words: int, texts: int, of_counts: list[int], heavy: dict[int, int]):
        self.tokens, self.words, self.texts = tokens, words, texts
        self.d = discounts(of_counts)
        self.heavy = np.array(sorted(heavy), np.uint64)
        self.heavy_count = np.array([heavy[h] for h in sorted(heavy)], np.int64)
        small = sum(of_counts[1:K + 1])
        kept = tokens - sum(r * of_counts[r] * (1 - self.d[r - 1]) for r in range(1, K + 1)) - SPARE * (words - small)
        self.unknown = 1 - kept / tokens if tokens else 1.0

    def share(self, c: np.ndarray) -> np.ndarray:
        """P(w) of words with training count c; count 0: the unknown class."""
        kept = np.where(c > K, c - SPARE, c * np.array([0.0, *self.d])[np.minimum(c, K)])
        return np.where(c > 0, kept / max(1, self.tokens), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.words + 1)))

    def is_heavy(self, w: np.ndarray) -> np.ndarray:
        return find(self.heavy, w) >= 0

    def count_heavy(self, w: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Counts ``c`` of words, those of heavy ones, which no bucket holds whole, replaced by the counts that every task has."""
        at = find(self.heavy, w)
        return np.where(at >= 0, np.append(self.heavy_count, 0)[at], c)


def count_words(docs: DataFrame, buckets: int) -> DataFrame:
    """Pass A: per bucket, ascending word hashes and their counts in training texts, and one row with the number of these texts per chunk."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            train = [t for i, t in zip(ids, texts) if not held_out(i)]
            if not train:
                continue
            keys, n = np.unique(np.concatenate(train), return_counts=True)
            b = bucket_of(keys, buckets)
            order = np.argsort(b, kind="stable")
            keys, n, b = keys[order], n[order], b[order]
            yield batch([("u", k, len(train) if j == 0 else 0, pack(keys[s], n[s])) for j, (k, s) in enumerate(split(b, buckets))])

    def merge(key, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(d) for d in rows["data"]]
        keys, n = sums(np.concatenate([p[0] for p in parts]), np.concatenate([p[1].astype(np.int64) for p in parts]))
        big = n * 4 * HEAVY > n.sum()
        facts = {"texts": int(rows["chunk"].sum()), "tokens": int(n.sum()), "words": len(n), "heavy": dict(zip(keys[big].tolist(), n[big].tolist())),
                 "of_counts": np.bincount(n[n <= K + 1], minlength=K + 2).tolist()}
        return frame([("u", key[0], 0, pack(keys, n)), ("facts", key[0], 0, pickle.dumps(facts))])

    return docs.mapInArrow(read, ROW).groupBy("bucket").applyInPandas(merge, ROW)


def totals(table: DataFrame) -> Unigrams:
    """Few numbers a bucket: sums, counts of counts, and the words that may be heavy (at most 4 * HEAVY a bucket)."""
    facts = [pickle.loads(bytes(r.data)) for r in table.filter("kind = 'facts'").select("data").collect()]
    add = lambda k: sum(f[k] for f in facts)
    tokens = add("tokens")
    heavy = {w: c for f in facts for w, c in f["heavy"].items() if c * HEAVY > tokens}
    return Unigrams(tokens, add("words"), add("texts"), [sum(f["of_counts"][r] for f in facts) for r in range(K + 2)], heavy)


def occurrences(texts: list[np.ndarray], u: Unigrams, buckets: int, by_text: bool) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Per bucket the distinct (word, word before it), or (word, word before it, text), ascending, and how often each occurs: words and the
    number of rows of each, the words before them and a place among these per row, the text if asked for, and the count."""
    size = np.array([len(t) for t in texts])
    names, at = np.unique(np.append(np.concatenate(texts), START), return_inverse=True)
    w, v = at[:-1], np.concatenate([at[-1:], at[:-2]])
    v[np.cumsum(size)[:-1]] = at[-1]
    doc = np.repeat(np.arange(len(texts)), size) if by_text else np.zeros(len(w), np.int64)
    wide, low = len(names).bit_length(), (len(texts) if by_text else 0).bit_length()
    if 2 * wide + low <= KEY_BITS:  # one number each: the cheapest to sort
        key = np.sort((w << (wide + low)) | (v << low) | doc)
        first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
        n, key = np.diff(np.append(first, len(key))), key[first]
        w, v, doc = key >> (wide + low), key >> low & ((1 << wide) - 1), key & ((1 << low) - 1)
    else:
        order = np.lexsort((doc, v, w))
        w, v, doc = w[order], v[order], doc[order]
        first = np.nonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (v[1:] != v[:-1]) | (doc[1:] != doc[:-1])]))[0]
        n = np.diff(np.append(first, len(w)))
        w, v, doc = w[first], v[first], doc[first]
    b = bucket_of(names, buckets)[w]
    spread = np.nonzero(u.is_heavy(names)[w])[0]
    with np.errstate(over="ignore"):
        b[spread] = bucket_of(names[w[spread]] ^ mix(names[v[spread]]), buckets)
    order = np.argsort(b.astype(np.uint16 if buckets < 1 << 16 else np.uint32), kind="stable")
    w, v, doc, n, b = w[order], v[order], doc[order], n[order], b[order]
    for k, s in split(b, buckets):
        run = np.nonzero(np.concatenate([[True], w[s][1:] != w[s][:-1]]))[0]
        uv, code = np.unique(v[s], return_inverse=True)
        yield int(k), [names[w[s][run]], np.diff(np.append(run, s.stop - s.start)), names[uv], code, *([doc[s]] if by_text else []), n[s]]


def send_pairs(docs: DataFrame, uni, buckets: int) -> DataFrame:
    """Fitting, first half of ``pairs``: each chunk's distinct (word, word before it) of training texts and their counts, to the pair's bucket."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            train = [t for i, t in zip(ids, texts) if not held_out(i)]
            if train:
                for k, data in occurrences(train, uni.value, buckets, False):
                    yield batch([("pairs", k, 0, pack(*data))])

    return docs.mapInArrow(read, ROW)


def send_tokens(docs: DataFrame, uni, buckets: int) -> DataFrame:
    """Scoring: each chunk's distinct (word, word before it, document) and their counts, to the pair's bucket, and the chunk's documents."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for nth, (ids, texts) in enumerate(chunks(batches)):
            chunk = (part << 24) + nth
            yield batch([("docs", -1 - chunk % buckets, chunk, pickle.dumps((ids, pack(np.array([len(t) for t in texts])))))])
            for k, data in occurrences(texts, uni.value, buckets, True):
                yield batch([("tokens", k, chunk, pack(*data))])

    return docs.mapInArrow(read, ROW)


def by_chunk(kind: str, names: np.ndarray, place: np.ndarray, *columns: np.ndarray) -> list[tuple[str, int, int, bytes]]:
    """One row a chunk with sums per document; ``place`` is (index into ``names``) << 32 | document."""
    got = sums(place, *columns)
    return [(kind, 0, int(names[c]), pack(got[0][s] & 0xFFFFFFFF, *(x[s] for x in got[1:]))) for c, s in split(got[0] >> 32, len(names))]


def by_bucket(buckets: int, keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Keys and their columns, to the keys' buckets."""
    b = bucket_of(keys, buckets)
    order = np.argsort(b, kind="stable")
    for k, s in split(b[order], buckets):
        yield int(k), [x[order[s]] for x in (keys, *columns)]


def count_pairs(key, rows: pd.DataFrame, u: Unigrams, buckets: int) -> pd.DataFrame:
    """Fitting, second half of ``pairs``: a bucket's pairs and their counts, sums for the buckets of their contexts, and counts of counts.
    The bucket's words are taken a range at a time, so that only ``SLICE_ROWS`` rows or so are spread out at once."""
    blobs = [unpack(d) for d in rows["data"]]
    size = sum(len(b[3]) for b in blobs)
    bounds = np.array([i * (1 << 64) // (1 + size // SLICE_ROWS) for i in range(1 + size // SLICE_ROWS)], np.uint64)
    cuts = [np.append(np.searchsorted(b[0], bounds), len(b[0])) for b in blobs]
    starts = [np.concatenate([[0], np.cumsum(b[1], dtype=np.int64)]) for b in blobs]
    counts, contexts, of_counts = [], [], np.zeros(K + 2, np.int64)
    for k in range(len(bounds)):
        w, v, n = [], [], []
        for i, (uw, run, uv, code, *_, m) in enumerate(blobs):
            x, y = cuts[i][k], cuts[i][k + 1]
            s = slice(starts[i][x], starts[i][y])
            w.append(np.repeat(uw[x:y], run[x:y]))
            v.append(uv[code[s]])
            n.append(m[s].astype(np.int64))
        got = count_slice(*(np.concatenate(z) for z in (w, v, n)), u)
        counts.append(got[0])
        contexts.append(got[1])
        of_counts += got[2]
    join = lambda xs: [np.concatenate(z) for z in zip(*xs)]
    words, run, v, n = join(counts)
    uv, code = np.unique(v, return_inverse=True)
    out = [("counts", int(key[0]), 0, pack(words, run, uv, code, n)), ("facts", 0, 0, pickle.dumps(of_counts.tolist()))]
    out += [("ctx", k, 0, pack(*data)) for k, data in by_bucket(buckets, *sums(*join(contexts)))]
    return frame(out)


def count_slice(w: np.ndarray, v: np.ndarray, n: np.ndarray, u: Unigrams):
    """Of all counts of some words: distinct words, the number of pairs of each, the words before and the pairs' counts; sums per context;
    and the number of pairs of each count up to K + 1."""
    order = np.lexsort((v, w))
    w, v, n = w[order], v[order], n[order]
    first = np.ones(min(1, len(w)), bool)
    new_w = np.concatenate([first, w[1:] != w[:-1]])
    at = np.nonzero(new_w | np.concatenate([first, v[1:] != v[:-1]]))[0]
    n = np.add.reduceat(n, at) if len(at) else n
    v, new_w = v[at], new_w[at]
    word, words = np.cumsum(new_w) - 1, w[at][new_w]
    c_word = u.count_heavy(words, np.bincount(word, n, len(words)).astype(np.int64))
    contexts = sums(v, np.where(n > K, n - SPARE, 0.0), u.share(c_word)[word], *((n == k).astype(np.int32) for k in range(1, K + 1)))
    return (words, np.bincount(word, minlength=len(words)), v, n), contexts, np.bincount(n[n <= K + 1], minlength=K + 2)


def weigh_contexts(key, rows: pd.DataFrame, u: Unigrams, d: list[float]) -> pd.DataFrame:
    """Fitting, table ``contexts``: count and alpha of each."""
    ctx = [unpack(x) for x in rows["data"][rows["kind"] == "ctx"]]
    if not ctx:
        return frame([])
    v, large, share, *small = sums(*(np.concatenate([c[i] for c in ctx]) for i in range(K + 3)))
    kept = large + sum(k * d[k - 1] * small[k - 1] for k in range(1, K + 1))
    count = np.where(v == START, u.texts, 0)
    for x in rows["data"][rows["kind"] == "u"]:
        words, n = unpack(x)
        at = find(words, v)
        count = np.where(at >= 0, n[at].astype(np.int64), count)
    return frame([("context", int(key[0]), 0, pack(v, count, (1 - kept / count) / (1 - share)))])


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys among ascending ones, -1 where there is none."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


class PairTable:
    """One bucket of ``pairs`` and ``unigrams``, for look-ups."""

    def __init__(self, u: Unigrams, d: list[float]):
        self.u, self.log_kept = u, np.log10(np.array([1.0, *((k + 1) * x for k, x in enumerate(d))]))
        self.known, self.known_count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.words = self.before = np.zeros(0, np.uint64)
        self.keys = self.counts = np.zeros(0, np.int64)

    def add(self, kind: str, data: bytes) -> None:
        if kind == "u":
            self.known, self.known_count = unpack(data)
        else:
            self.words, run, self.before, code, self.counts = unpack(data)
            self.keys = np.repeat(np.arange(len(self.words)) * len(self.before), run) + code  # ascending

    def log_p(self, data: bytes):
        """Of one chunk's tokens: sums per document, (document, tokens known, base, log10 of what is known here); and what fell back to the
        word's own probability and needs its context's alpha, (word before, document, count)."""
        uw, run, uv, code, doc, n = unpack(data)
        n, doc = n.astype(np.int64), doc.astype(np.int64)
        c_word = self.u.count_heavy(uw, np.append(self.known_count, 0)[find(self.known, uw)].astype(np.int64))
        w, v = find(self.words, uw), find(self.before, uv)
        word = np.repeat(np.arange(len(uw)), run)
        key = np.where((w[word] < 0) | (v[code] < 0), -1, w[word] * len(self.before) + v[code])
        r = np.append(self.counts, 0)[find(self.keys, key)].astype(np.int64)
        seen = np.where(r > K, np.log10(np.maximum(1, r) - SPARE), self.log_kept[np.minimum(r, K)])
        as_context = np.where((uw != END) & (c_word > 0), -np.log10(np.maximum(1, c_word)), 0.0)
        score = as_context[word] + np.where(r > 0, seen, np.log10(self.u.share(c_word))[word])
        there = np.nonzero(np.bincount(doc))[0]
        part = [np.bincount(doc, x)[there] for x in (n * (c_word > 0)[word], n * self.u.base(c_word)[word], n * score)]
        fell = r == 0
        return [there, part[0].astype(np.int64), *part[1:]], (uv[code[fell]], doc[fell], n[fell])


def look_up(batches: Iterator[pa.RecordBatch], u: Unigrams, d: list[float], buckets: int) -> Iterator[pa.RecordBatch]:
    """Scoring: of rows in order of bucket, a bucket's tables before its tokens, each chunk's parts and what goes on to the contexts."""
    table, at, fell, chunk_of, held = PairTable(u, d), None, [], [], 0

    def go_on() -> Iterator[pa.RecordBatch]:
        if held:
            names, code = np.unique(np.concatenate(chunk_of), return_inverse=True)
            for k, (v, doc, n, c) in by_bucket(buckets, *(np.concatenate(x) for x in zip(*fell)), code):
                used, c = np.unique(c, return_inverse=True)
                yield batch([("miss", k, 0, pack(v, doc, n, c, names[used]))])

    for b in batches:
        for kind, bucket, chunk, data in zip(*(c.to_pylist() for c in b.columns)):
            if bucket != at:
                table, at = PairTable(u, d), bucket
            if kind == "docs":
                yield batch([(kind, bucket, chunk, data)])
            elif kind != "tokens":
                table.add(kind, data)
            else:
                part, missed = table.log_p(data)
                yield batch([("part", 0, chunk, pack(*part))])
                if len(missed[0]):
                    fell.append(missed)
                    chunk_of.append(np.full(len(missed[0]), chunk, np.int64))
                    held += len(missed[0])
            if held > SLICE_ROWS:
                yield from go_on()
                fell, chunk_of, held = [], [], 0
    yield from go_on()


def back_off(key, rows: pd.DataFrame) -> pd.DataFrame:
    """Scoring: alpha of the tokens whose pair was never seen, less the c(v) that their context's own look-up put in."""
    parts = [unpack(x) for x in rows["data"][rows["kind"] == "miss"]]
    contexts = [unpack(x) for x in rows["data"][rows["kind"] == "context"]]
    if not parts or not contexts:  # a context never seen in training passes everything on
        return frame([])
    (v, count, alpha), = contexts
    add = np.append(np.log10(alpha) + np.log10(count.astype(float)), 0.0)
    names = np.unique(np.concatenate([p[4] for p in parts]))
    mv, md, mn = (np.concatenate([p[i] for p in parts]) for i in range(3))
    chunk = np.concatenate([np.searchsorted(names, p[4])[p[3]] for p in parts])
    return frame(by_chunk("back", names, chunk.astype(np.int64) << 32 | md.astype(np.int64), mn * add[find(v, mv)]))


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def gather(key, rows: pd.DataFrame, u: Unigrams) -> pd.DataFrame:
    """Scoring, last: a chunk's documents and all parts of their scores."""
    ids, size = pickle.loads(bytes(rows["data"][rows["kind"] == "docs"].iloc[0]))
    known, base, score = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.full(len(ids), -np.log10(max(1, u.texts)))
    for kind, data in zip(rows["kind"], rows["data"]):
        if kind == "docs":
            continue
        at, *cols = unpack(data)
        if kind == "back":
            score[at] += cols[0]
        else:
            known[at] += cols[0]
            base[at] += cols[1]
            score[at] += cols[2]
    return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "held_out": [held_out(i) for i in ids], "n_tokens": unpack(size)[0].astype(np.int64), "n_known": known,
                         "train_tokens": np.full(len(ids), u.tokens), "base_score": base, "score": score})


def stored(df: DataFrame, name: str) -> DataFrame:
    """A working table of packed rows, a folder a kind."""
    path = new_path(df.sparkSession, name)
    df.write.partitionBy("kind").parquet(path)
    return df.sparkSession.read.schema(ROW).parquet(path)


def narrow(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))


class Model:
    """The stored tables and the few global numbers."""

    def __init__(self, unigrams: DataFrame, pairs: DataFrame, contexts: DataFrame, uni: Unigrams, d: list[float], buckets: int):
        self.unigrams, self.pairs, self.contexts, self.uni, self.d, self.buckets = unigrams, pairs, contexts, uni, d, buckets

    def score(self, docs: DataFrame) -> DataFrame:
        """Columns of ``RESULT`` for every document, which the model may have learnt from or not: look-ups in the stored tables."""
        spark, d, buckets = docs.sparkSession, self.d, self.buckets
        small_batches(spark)
        held = spark.sparkContext.broadcast(self.uni)
        rows = send_tokens(narrow(docs), held, buckets).unionByName(self.unigrams).unionByName(self.pairs)
        rows = rows.repartition("bucket").sortWithinPartitions("bucket", F.col("kind") == "tokens")
        parts = stored(rows.mapInArrow(tidy(lambda b: look_up(b, held.value, d, buckets)), ROW), "katz-parts")
        back = parts.filter("kind = 'miss'").unionByName(self.contexts).groupBy("bucket").applyInPandas(back_off, ROW)
        return parts.filter(F.col("kind").isin("part", "docs")).unionByName(back).groupBy("chunk").applyInPandas(lambda k, r: gather(k, r, held.value), RESULT)


def fit(docs: DataFrame, buckets: int | None = None) -> Model:
    """The model of the documents that are not held out. A document without an id is a training text; null texts are empty: one end token."""
    spark: SparkSession = docs.sparkSession
    buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = saved(count_words(narrow(docs), buckets), "katz-unigrams")
    uni = totals(words)
    held = spark.sparkContext.broadcast(uni)
    pairs = stored(send_pairs(narrow(docs), held, buckets).groupBy("bucket").applyInPandas(lambda k, r: count_pairs(k, r, held.value, buckets), ROW), "katz-pairs")
    facts = [pickle.loads(bytes(r.data)) for r in pairs.filter("kind = 'facts'").select("data").collect()]
    d = discounts([sum(f[r] for f in facts) for r in range(K + 2)])
    unigrams = words.filter("kind = 'u'")
    context = pairs.filter("kind = 'ctx'").unionByName(unigrams).groupBy("bucket").applyInPandas(lambda k, r: weigh_contexts(k, r, held.value, d), ROW)
    return Model(unigrams, pairs.filter("kind = 'counts'"), saved(context, "katz-contexts"), uni, d, buckets)


def score(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    return fit_and_score(docs, buckets)[1]


def fit_and_score(docs: DataFrame, buckets: int | None = None) -> tuple[Model, DataFrame]:
    """The model of the documents that are not held out, and columns of ``RESULT`` for every document.

    Rows that repeat an id are documents of their own. An empty table gives no rows; without training texts every token is unknown."""
    model = fit(docs, buckets)
    return model, model.score(docs)
