import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.llm import katz as Z

PAT = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Plain:
    """The same model by dictionaries, evaluated token by token."""

    def __init__(self, rows):
        self.rows = [(r.doc_id, PAT.findall((r.text or "").translate(LOWER)) + ["\n"]) for r in rows]
        train = [t for i, t in self.rows if not (i is not None and zlib.crc32(str(i).encode()) % 10 == 0)]
        self.c1 = Counter(w for t in train for w in t)
        self.c2 = Counter(p for t in train for p in zip([" "] + t, t))
        self.ctx = Counter(v for t in train for v in [" "] + t[:-1])
        self.n = sum(self.c1.values())
        self.d1, self.d2 = (Z.discounts([sum(x == r for x in c.values()) for r in range(Z.K + 2)]) for c in (self.c1, self.c2))
        self.unknown = 1 - sum(self.kept(c, self.d1) for c in self.c1.values()) / self.n if self.n else 1.0
        self.followers = defaultdict(list)
        for (v, w) in self.c2:
            self.followers[v].append(w)

    @staticmethod
    def kept(c, d):
        return c - Z.SPARE if c > Z.K else c * d[c - 1]

    def p1(self, w):
        return self.kept(self.c1[w], self.d1) / self.n if self.c1[w] else self.unknown

    def p2(self, v, w):
        if not self.ctx[v]:
            return self.p1(w)
        if self.c2[v, w]:
            return self.kept(self.c2[v, w], self.d2) / self.ctx[v]
        free = 1 - sum(self.kept(self.c2[v, x], self.d2) for x in self.followers[v]) / self.ctx[v]
        return free / (1 - sum(self.p1(x) for x in self.followers[v])) * self.p1(w)

    def result(self):
        out = []
        for i, t in self.rows:
            base = sum(math.log10((self.c1[w] + 0.1) / (self.n + 0.1 * (len(self.c1) + 1))) for w in t)
            s = sum(math.log10(self.p2(v, w)) for v, w in zip([" "] + t, t))
            out.append((repr(i), i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(t), sum(self.c1[w] > 0 for w in t), self.n, base, s))
        return sorted(out)


def compare(df, rows, **how):
    got = sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in Z.score(df, **how).collect())
    want = Plain(rows).result()
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words[:3 if rng.random() < 0.4 else 300]) for _ in range(rng.randrange(0, 60)))) for i in range(250)]
    rows += [(1000 + i, "a passage that comes again and again word for word") for i in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).persist()


def test_scores_against_dictionaries(texts):
    compare(texts, texts.collect())


def test_many_buckets_chunks_and_heavy_words(texts, monkeypatch):
    monkeypatch.setattr(Z, "HEAVY", 20)
    compare(texts, texts.collect(), buckets=37)


def test_slices_and_chunks():
    """The same sums from a bucket whatever its slices: in one process, where the constants can be changed."""
    rng = np.random.default_rng(1)
    w, v = rng.integers(0, 1 << 63, 30).astype(np.uint64)[rng.integers(0, 30, 900)], rng.integers(0, 1 << 63, 9).astype(np.uint64)[rng.integers(0, 9, 900)]
    order = np.lexsort((v, w))
    w, v = w[order], v[order]
    doc, n = rng.integers(0, 40, 900), rng.integers(1, 3, 900)
    run = np.nonzero(np.concatenate([[True], w[1:] != w[:-1]]))[0]
    uv, code = np.unique(v, return_inverse=True)
    data = Z.pack(w[run], np.diff(np.append(run, 900)), uv, code, doc, n)
    rows = Z.frame([("pairs", 3, 7, data), ("pairs", 3, 9, data)])
    u = Z.Unigrams(10_000, 30, 20, [0] * (Z.K + 2), {int(w[0]): 500})
    seen = []
    for size in (10**6, 70):
        Z.SLICE_ROWS, keep = size, Z.SLICE_ROWS
        out = Z.count_pairs((3,), rows, u, 4)
        Z.SLICE_ROWS = keep
        seen.append({(r.kind, r.bucket, r.chunk): r.data for r in out.itertuples()})
    assert seen[0].keys() == seen[1].keys()
    for k, d in seen[0].items():
        if k[0] == "facts":
            assert d == seen[1][k]
        elif k[0] != "miss":
            assert all(np.allclose(a, b, rtol=1e-12) for a, b in zip(Z.unpack(d), Z.unpack(seen[1][k])))


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    compare(docs, docs.collect())
    got = Z.score(docs).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_odd_rows_and_empty_tables(odd_docs, no_docs):
    docs = odd_docs.coalesce(1).persist()
    compare(docs, docs.collect())
    assert Z.score(no_docs).count() == 0


def test_every_context_adds_up_to_one(texts):
    model, _ = Z.fit_and_score(texts, 5)
    plain = Plain(texts.collect())
    hashes = {int(x): w for w, x in zip(list(plain.c1), [int(Z.END) if w == "\n" else int(Z.Words().hashes(w.encode())[0]) for w in plain.c1])}
    alphas = {}
    for r in model.contexts.collect():
        v, count, alpha = Z.unpack(bytes(r.data))
        alphas |= {int(a): (int(c), float(b)) for a, c, b in zip(v, count, alpha)}
    assert len(alphas) == len(plain.followers)
    for h, (count, alpha) in alphas.items():
        v = " " if h == int(Z.START) else hashes[h]
        assert count == plain.ctx[v]
        seen = plain.followers[v]
        total = sum(plain.p2(v, w) for w in seen) + alpha * (sum(plain.p1(w) for w in plain.c1 if (v, w) not in plain.c2) + plain.unknown)
        assert abs(total - 1) < 1e-9
    assert abs(sum(plain.p1(w) for w in plain.c1) + plain.unknown - 1) < 1e-9


def test_arrays_survive_packing():
    a, b, c = np.array([5, 9, 2**63 + 1], np.uint64), np.array([3, 70000, 0]), np.array([0.1, -1e9, 0.0])
    got = Z.unpack(Z.pack(a, b, c, np.array([9, 1], np.uint64), np.zeros(0, np.int64)))
    assert all((x == y).all() for x, y in zip(got, (a, b, c, [9, 1]))) and len(got[4]) == 0


def test_discounts_of_few_counts():
    assert Z.discounts([0, 3, 0, 0, 0, 0, 0]) == [1 - 0.5 / r for r in range(1, Z.K + 1)]
    d = Z.discounts([0, 1000, 400, 200, 120, 80, 55])
    assert all(0 < x < 1 for x in d)


def test_stored_tables_score_texts_they_never_counted(texts, spark):
    """Pairs and their counts are stored, and other texts are scored by look-ups in the stored tables alone."""
    plain = Plain(texts.collect())
    model = Z.fit(texts, 5)
    name = {int(Z.START): " ", int(Z.END): "\n"} | {int(Z.Words().hashes(w.encode())[0]): w for w in plain.c1 if w != "\n"}
    found = {}
    for r in model.pairs.collect():
        words, run, before, code, n = Z.unpack(bytes(r.data))
        for w, v, c in zip(np.repeat(words, run), before[code], n):
            assert (name[int(v)], name[int(w)]) not in found
            found[name[int(v)], name[int(w)]] = int(c)
    assert found == dict(plain.c2)
    new = [(7, "w1 w2 never w1 a passage that comes w299"), (10, "w5 w5 w5 unheard of"), (11, None), (12, "")]
    got = {r.doc_id: r for r in model.score(spark.createDataFrame(new, "doc_id long, text string")).collect()}
    assert len(got) == len(new)
    for i, text in new:
        t = PAT.findall(text or "") + ["\n"]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(t), sum(plain.c1[w] > 0 for w in t), plain.n)
        assert abs(got[i].score - sum(math.log10(plain.p2(v, w)) for v, w in zip([" "] + t, t))) < 1e-9


def test_rows_of_the_buckets_are_the_distinct_pairs_and_texts(monkeypatch):
    """Distinct pairs and texts come out alike whether they fit one number or not."""
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    texts = [np.append(words[rng.integers(0, 40, k)], Z.END) for k in (50, 0, 90, 3)]
    u = Z.Unigrams(200, 40, 4, [0] * (Z.K + 2), {int(words[0]): 50})
    for by_text, bits in ((False, Z.KEY_BITS), (True, Z.KEY_BITS), (False, 9), (True, 9)):
        monkeypatch.setattr(Z, "KEY_BITS", bits)
        want = Counter()
        for i, t in enumerate(texts):
            want.update((int(w), int(v), i if by_text else 0) for v, w in zip([Z.START, *t], t))
        got = {}
        for k, (uw, run, uv, code, *doc, n) in Z.occurrences(texts, u, 3, by_text):
            for w, v, i, c in zip(np.repeat(uw, run), uv[code], doc[0] if doc else np.zeros(len(n), int), n):
                got[int(w), int(v), int(i)] = int(c)
        assert got == dict(want)


def test_mostly_ascending_arrays_survive_packing():
    rng = np.random.default_rng(5)
    for a in (np.array([1, 700, 3, 900, 5, 66000, 70001]), np.sort(rng.integers(0, 1 << 63, 99).astype(np.uint64)), rng.integers(0, 1 << 63, 99).astype(np.uint64),
              np.array([2**64 - 1, 0, 5, 9], np.uint64), rng.integers(0, 60000, 500), np.array([300])):
        assert (Z.unpack(Z.pack(a))[0] == a).all()
