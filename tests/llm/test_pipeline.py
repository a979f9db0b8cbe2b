import random
from math import comb

import __spark_entry__ as E
import corpus_pipeline as C
from quiver.llm import exact_dedup, near_dedup, quality, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_in_order_with_the_columns_of_documents(spark):
    assert [n for n, _ in C.STAGES] == ["quality", "toxicity", "exact_dedup", "near_dedup", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    now = docs
    expected = [
        lambda d: {r.doc_id for r in quality.classify(d, labels).collect() if r.predicted == 1},
        lambda d: {r.doc_id for r in toxicity.classify(d, labels).collect() if r.predicted == 0},
        lambda d: {r.keep_id for r in exact_dedup.dedup(d).collect()},
        lambda d: {r.component_id for r in near_dedup.near_duplicates(d, words=C.NEAR_WORDS, share=C.NEAR_SHARE, match=C.NEAR_MATCH).collect()}]
    for (name, stage), want in zip(C.STAGES, expected):
        out = C.saved(stage(spark, now, SF), f"test-{name}")
        assert out.columns == docs.columns
        got = out.collect()
        assert {r.doc_id for r in got} == want(now) and all(r == rows[r.doc_id] for r in got) and len(got) == len({r.doc_id for r in got})
        now = out
    packed = C.STAGES[-1][1](spark, now, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in now.select("doc_id").collect()}


def test_registered():
    q = E.queries()
    assert "pipeline" in q and all(any(k.startswith(f"op{n}_") for k in q) for n in range(1, 14))


def test_odd_and_empty_documents(spark, odd_docs, no_docs):
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, odd_docs, SF).columns == odd_docs.columns
        assert stage(spark, no_docs, SF).count() == 0
    assert stage(spark, odd_docs, SF).count() > 0


def test_near_stage_keeps_one_of_texts_between_80_and_85_percent(spark):
    """Against all pairs: each edit of a word in 300 takes up to five of 296 shingles away."""
    rng = random.Random(11)
    rows, sets = [], []
    for f in range(30):
        base = [f"w{f}x{rng.randrange(10**6)}" for _ in range(300)]
        copy = list(base)
        for at in range(10, 10 + 10 * (4 + f % 5), 10):
            copy[at] = f"edit{rng.randrange(10**6)}"
        for words in (base, copy):
            sets.append({tuple(words[i:i + 5]) for i in range(296)})
            rows.append((len(rows), " ".join(words)))
    share = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(rows)) for j in range(i)}
    assert sum(0.8 <= s < 0.85 for s in share.values()) >= 6 and sum(0.7 < s < 0.8 for s in share.values()) >= 6
    want = {i for i in range(len(rows)) if not any(share[i, j] >= 0.8 for j in range(i))}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in C.near_stage(spark, docs, SF).collect()} == want


def test_chance_that_the_near_stage_misses_a_pair():
    s, coords = C.NEAR_SHARE[0] / C.NEAR_SHARE[1], near_dedup.COORDS
    assert sum(comb(coords, k) * s**k * (1 - s)**(coords - k) for k in range(C.NEAR_MATCH)) < 1e-7
