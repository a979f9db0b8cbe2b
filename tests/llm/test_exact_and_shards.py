import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from quiver.llm import exact_dedup as X
from quiver.llm import sharding as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups(rows):
    out = defaultdict(list)
    for r in rows:
        out[(r.text or "").translate(LOWER)].append(r.doc_id)
    return out


def expect(rows):
    want = []
    for norm, ids in groups(rows).items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want.append((i, keep, len(ids), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(want, key=repr)


def test_dedup_against_brute_force(odd_docs):
    got = X.dedup(odd_docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == expect(odd_docs.collect())
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups(odd_docs.collect())) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_colliding_digests_are_told_apart_by_their_bytes(odd_docs):
    weak = lambda c: F.substring(X.sha256(c), 1, 1)
    got = X.dedup(odd_docs, digest=weak).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == expect(odd_docs.collect())
    assert sum(r.kept for r in got) == len(groups(odd_docs.collect()))


def test_state_goes_on_from_an_earlier_run(spark, odd_docs, tmp_path):
    ledger = odd_docs.select("doc_id", F.coalesce("text", F.lit("")).alias("digest"), F.monotonically_increasing_id().alias("row"),
                             F.lit("f").alias("file"))
    path, ckpt = str(tmp_path / "ledger"), str(tmp_path / "state")
    ledger.filter("doc_id < 100").write.parquet(path)
    X.absorb(spark, path, ckpt, ledger.schema)
    ledger.filter("doc_id >= 100").write.mode("append").parquet(path)
    state = {r.digest: (r.keeper.doc_id, r.n) for r in X.absorb(spark, path, ckpt, ledger.schema).collect()}
    assert state["copied many times over"] == (229, 30)
    assert sum(n for _, n in state.values()) == ledger.filter("doc_id is not null").count()


def test_stage_keeps_all_columns_and_one_of_repeated_rows(odd_docs):
    out = X.keep_first(odd_docs)
    assert out.columns == odd_docs.columns
    assert out.count() == len(groups(odd_docs.collect()))
    assert out.filter("doc_id = 9").count() == 1


def test_empty_tables(no_docs):
    assert X.dedup(no_docs).count() == 0 and X.keep_first(no_docs).count() == 0
    assert S.shard(no_docs).count() == 0


def test_shards_are_even_gapless_and_keep_equal_texts_together(odd_docs):
    rows = [r for r in odd_docs.collect()]
    got = S.shard(odd_docs, shards=4).collect()
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (repr(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    homes = defaultdict(set)
    for r in got:
        if r.doc_id is not None and r.doc_id >= 200:
            homes["copies"].add(r.shard)
    assert len(homes["copies"]) == 1


def test_shard_sizes_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = [r.b for r in S.shard(docs).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 0.01 * sum(sizes) / 16


def test_a_text_heavier_than_a_shard_is_split(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("t"), F.col("id") % 89)).alias("text"))
    sizes = [r.b for r in S.shard(docs, shards=8).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 8


def test_rebalancing_edits_the_map():
    weights = {v: 100 + v % 7 for v in range(400)}
    first = S.place(weights, 8)
    grown = S.rebalance(first, weights, 9)
    moved = [v for v in weights if grown[v] != first[v]]
    assert sum(grown[v] == 8 for v in moved) >= 400 // 9 - 2 and len(moved) <= 400 / 9 + 8
    held = [sum(w for v, w in weights.items() if grown[v] == s) for s in range(9)]
    assert max(held) - min(held) <= 110
    assert S.rebalance(first, weights, 8) == first
    heavier = S.rebalance(first, weights | {0: 900}, 8)
    assert sum(heavier[v] != first[v] for v in weights) < 20


def test_versions_of_the_map(spark, tmp_path):
    store = S.SlotMap(spark, str(tmp_path / "map"))
    store.write(1, {0: 1, 5: 0}, {0: 10, 5: 20})
    store.write(2, {0: 2, 5: 0}, {0: 10, 5: 20})
    assert store.mapping(1) == {0: 1, 5: 0} and store.mapping(2) == {0: 2, 5: 0}
