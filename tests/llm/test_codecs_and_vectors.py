import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.llm import nearest as N
from quiver.llm import packing as P
from quiver.llm import piece_codec as C
from quiver.llm.common import vocabulary


def test_pieces_equal_the_library(spark, odd_docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = odd_docs.select("doc_id", "text").unionByName(real.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    extra = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(
        [" ", "  a", "a  ", "\n", " \n x", "\n\n東", "▁", "a▁▁ b", "<s> </s> <unk> <0x0A>", "\t\r\n", "é" * 70 + " x"])], "doc_id long, text string")
    docs = docs.unionByName(extra)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in C.op7(docs).collect()}
    want = set()
    for r in docs.collect():
        ids = sp.encode(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                  hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got == want


def test_piece_table_is_emptied_at_its_bound(monkeypatch):
    monkeypatch.setattr(C, "TABLE_CHARS", 5)
    codec = C.Codec(vocabulary("piece_bpe_32k.model"))
    texts = ["the cat sat", "on the mat", "the cat " + "z" * 100]
    assert [codec.encode(t)[0] for t in texts] == [len(codec.sp.encode(t)) for t in texts]
    assert codec.encode(texts[2])[2] == texts[2]


def reference_ids(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    return [(r.doc_id, tok.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in rows]


@pytest.mark.parametrize("window", [2048, 64])
def test_packing_places_every_id_once(spark, odd_docs, window):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = odd_docs.select("doc_id", "text").filter("doc_id is null or doc_id != 9").unionByName(
        real.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    want = dict(reference_ids(docs.collect()))
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in P.pack(docs, window=window).collect():
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == want.keys()
    for d, ps in pieces.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want[d])
            assert p.ids_crc32 == zlib.crc32(np.array(want[d][at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(want[d])
    totals = []
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        totals.append(at)
    assert max(totals) <= window and sum(t < window for t in totals) <= 1
    assert sorted(seqs) == list(range(len(seqs)))


def test_least_squares_uses_up_a_histogram_made_of_combinations():
    hist = np.zeros(65, np.int64)
    for parts, n in (((10, 54), 50), ((20, 20, 24), 30), ((1, 63), 20)):
        for p in parts:
            hist[p] += n
    combos, used = P.plan(hist, 64)
    assert (used <= hist).all() and used.sum() >= 0.95 * hist.sum()
    assert all(sum(parts) == 64 for _, parts in combos)


def test_empty_tables(spark, no_docs):
    assert P.pack(no_docs).count() == 0 and C.op7(no_docs).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert N.nearest(none, F.col("vec_id") % 20 == 0).count() == 0


def brute(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for qi, q in ok:
        if qi % every == 0:
            near = sorted(((-float(N.exact(q[None], v[None])[0]), i) for i, v in ok if i != qi))[:k]
            out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(1024, 8192), (7, 13)])
def test_nearest_against_brute_force(spark, blocks):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=16) * 10.0 ** (i % 3)]) for i in range(300)]
    rows += [(300 + i, rows[4][1]) for i in range(12)]  # ties
    rows += [(400, None), (420, [0.0] * 16), (440, [None] + [1.0] * 15), (460, [float("nan")] * 16), (480, [float("inf")] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit("clash")).repartition(6)
    got = N.nearest(df, F.col("vec_id") % 20 == 0, k=5, query_block=blocks[0], candidate_block=blocks[1]).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, 5, 20)


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.1]), (2, [0.1, 3.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in N.nearest(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1), (0, 2, 2)]


@pytest.mark.parametrize("few, most, part", [(1, 1 << 36, 1), (1, 500, 1), (1 << 40, 1 << 60, 1)])
def test_groups_of_queries_and_parts_of_candidates(spark, monkeypatch, few, most, part):
    """Repeated ids among queries and candidates, ties across parts, vectors of mixed sizes."""
    for name, value in (("FEWEST_PAIRS", few), ("MOST_PAIRS", most), ("LEAST_PART", part)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8) * 10.0 ** (i % 5 - 2)]) for i in range(0, 900, 3)]
    rows += [(20 * i, rows[7][1]) for i in range(30)] + [(1000 + i, rows[9][1]) for i in range(12)]
    pairs = sorted((qi, -float(N.exact(np.array([q]), np.array([v]))[0]), i) for qi, q in rows for i, v in rows if qi % 20 == 0 and qi != i)
    want, seen = [], defaultdict(int)
    for qi, s, i in pairs:
        seen[qi] += 1
        if seen[qi] <= 5:
            want.append((qi, seen[qi], i, -s))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got = N.nearest(df, F.col("vec_id") % 20 == 0, k=5, query_block=4, candidate_block=9).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want


def test_no_shuffle_holds_the_candidates(spark, monkeypatch):
    """A copy of each query block for each candidate block fills the disks of a large table."""
    monkeypatch.setattr(N, "FEWEST_PAIRS", 1)
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(200)], "vec_id long, embedding array<float>")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        out = N.nearest(df, F.col("vec_id") % 20 == 0, query_block=4, candidate_block=9)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    dealt = [line for line in plan.splitlines() if "Exchange" in line]
    assert "CartesianProduct" in plan and "Join" not in plan
    assert len(dealt) == 2 and "hashpartitioning(query_id" in dealt[0] and "rangepartitioning(block" in dealt[1]


@pytest.mark.parametrize("dims, multiply", [(3, N.product), (64, N.product), (64, lambda _: N.float_product), (1200, lambda _: N.float_product)])
def test_lists_against_all_pairs(monkeypatch, dims, multiply):
    """Blocks one after another, with more ties and near copies than a merge takes at once."""
    monkeypatch.setattr(N, "product", multiply)
    monkeypatch.setattr(N, "MERGED", 3)
    monkeypatch.setattr(N, "MANY", 4)
    monkeypatch.setattr(N, "TILE", 50)
    rng = np.random.default_rng(dims)
    x = (rng.normal(size=(700, dims)) * 10.0 ** rng.integers(-12, 13, (700, 1))).astype(np.float32)
    x[300:500] = x[300] * (1 + rng.normal(size=(200, dims)) * 1e-6)
    x[500:600] = x[1]
    ids = rng.permutation(700)
    found = N.Nearest(ids[:90], x[:90], 7, query_block=40)
    for at in range(0, 700, 130):
        c = slice(at, at + 130)
        order = np.argsort(np.abs(x[c]).max(axis=1))
        found.meet(ids[c][order], x[c][order])
    for q in range(90):
        score = N.exact(np.repeat(x[q:q + 1], 700, axis=0), x)
        best = [j for j in np.lexsort((ids, -score)) if j != q][:7]
        assert found.found[q].tolist() == ids[best].tolist() and found.score[q].tolist() == score[best].tolist()
    assert found.rows().num_rows == 630


def test_what_overflows_is_kept():
    x = np.array([[1e200, 1.0], [2.0, 1e-200], [1e-320, 3.0], [5e-324, 1e-310], [1e-200, 0.0], [-1e160, 2.0]])
    ids = np.arange(6)
    order = np.argsort(np.abs(x).max(axis=1))
    found = N.Nearest(ids, x, 2)
    found.meet(ids[order], x[order])
    for q in range(6):
        score = N.exact(np.repeat(x[q:q + 1], 6, axis=0), x)
        assert found.found[q].tolist() == [j for j in np.lexsort((ids, -score)) if j != q][:2]


def test_codes_are_multiplied_exactly(monkeypatch):
    rng = np.random.default_rng(1)
    for dims in (1, 7, 64, 1039, 1041):
        a, b = (rng.choice(np.array([-127, 127], np.int8), s) for s in ((130, dims), (dims, 70)))
        a[0] = b[:, 0] = 127
        want = a.astype(np.int64) @ b.astype(np.int64)
        assert (N.product(dims)(a, b) == want).all() and (N.float_product(a, b) == want).all()
    monkeypatch.setitem(__import__("sys").modules, "onnxruntime", None)
    N.product.cache_clear()
    assert N.product(64) is N.float_product
    N.product.cache_clear()


def test_few_blocks_make_a_row_group(spark):
    """Whatever the blocks' vectors take compressed, a reader holds the blocks of one row group as they are."""
    import pyarrow.parquet as pq

    df = spark.range(900).selectExpr("id", "array(1F, 2F) AS v").coalesce(1)
    files = [f.removeprefix("file:") for f in N.packed(df, 10, "blocks").inputFiles()]
    sizes = [m.row_group(i).num_rows for f in files for m in [pq.read_metadata(f)] for i in range(m.num_row_groups)]
    assert sum(sizes) == 90 and max(sizes) <= N.ROW_GROUP


def test_a_tile_holds_no_matrix_of_doubles():
    """A block of queries and one of candidates, each of the usual size, in the memory of a small worker."""
    import tracemalloc

    rng = np.random.default_rng(2)
    q, c = rng.normal(size=(1024, 64)).astype(np.float32), rng.normal(size=(8192, 64)).astype(np.float32)
    c = c[np.argsort(np.abs(c).max(axis=1))]
    tracemalloc.start()
    N.Nearest(np.arange(1024), q, 20).meet(np.arange(5000, 13192), c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6


def test_plain_words_equal_the_library(spark):
    """Every distinct chunk of the documents, and odd ones, against the library."""
    enc = P.Encoder(vocabulary("word_bpe_49k.json"))
    real = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").selectExpr("explode(split(text, '[ \\n\\t]+')) as w").distinct().collect()
    odd = ["İstanbul", "I'm", "don't", "a_b", "x<|endoftext|>y", "<|startoftext|>", "ǅ", "ªº", "...", "!!!", "Ünïcödé,", "é", "Å", "ß", "foo'", "K", "a1b2",
           "aaaa", "the,.", "(x)", "x)", "''", "–", "µ", "\x00", "a\x1cb", "ŉ", "ŀ", "ſ", "x" * 64, "x" * 65, "é" * 40, "東京", "👍🏽"]
    words = sorted({r.w for r in real if r.w} | set(odd))
    got = enc.batch([w.encode() for w in words])
    want = enc.tok.encode_batch(words, add_special_tokens=False)
    assert [w for w, g, e in zip(words, got, want) if g != np.array(e.ids, "<u4").tobytes()] == []


def test_units_of_whole_texts_equal_the_library(monkeypatch):
    """Runs of letters and symbols in any order, Latin letters of two bytes, odd chunks between plain ones, and texts without any."""
    rng = np.random.default_rng(5)
    parts = ["the", "Inlyin", "ÀÉÎß", "ÿ", "×", "÷", "é", "e\u0301", "x" * 15, "É" * 8, "y" * 17, "z" * 90, ".", ",.!", "(", ")", "?" * 20, "'s", "'", "_", "<",
             "7", "12", "<|endoftext|>", "東京", "\x00", "\x1c", "\xa0", "\u2028", "Ā", "µ", " ", " ", " ", "\n", "\t", "\r\n", "\x0b", "\x0c"]
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(0, 30))) for _ in range(3000)]
    texts += ["", " ", "\n\n", *parts, "a" * 5000]
    for size in (P.BATCH_BYTES, 100):
        monkeypatch.setattr(P, "BATCH_BYTES", size)
        enc = P.Encoder(vocabulary("word_bpe_49k.json"))
        for some in (texts, [""], [" ", ""], [], ["東京"]):
            want = [np.array(e.ids, "<u4").tobytes() for e in enc.tok.encode_batch(some, add_special_tokens=False)]
            assert enc.batch([t.encode() for t in some]) == want


def test_plain_texts_leave_no_chunk_in_the_table():
    """They cost array steps alone, however many of their words are new."""
    enc = P.Encoder(vocabulary("word_bpe_49k.json"))
    enc.batch([b"Thonst inlyer, rethnd.\n(Is) " + "Ärger".encode()])
    assert not enc.table and not enc.size


def test_packing_loads_no_vocabulary_in_the_driver(spark, odd_docs, monkeypatch):
    def fails(*_):
        raise AssertionError("loaded in the driver")

    monkeypatch.setattr(P.Encoder, "__init__", fails)
    assert P.pack(odd_docs.select("doc_id", "text"), window=64).count() > 0
