import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.llm import near_dedup as D
from quiver.llm import similar_sets
from quiver.llm.components import components
from quiver.llm.shingles import shingle_set

PAT = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = PAT.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        f = find(i)
        least[f] = min((x for x in (least.get(f), r.doc_id) if x is not None), default=None)
    return sorted(((r.doc_id, len(s), least[find(i)], r.doc_id == least[find(i)]) for i, (r, s) in enumerate(zip(rows, sets))), key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


def edited(words, rng, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def families(spark):
    """Families of near copies at all distances, chains, a large group, and passages that many texts share."""
    rng = random.Random(5)
    rows = []
    passage = [f"p{i}" for i in range(60)]
    for f in range(12):
        base = [f"w{f}x{rng.randrange(400)}" for _ in range(rng.choice([12, 40, 150, 400]))]
        chain = base
        for k in range(rng.choice([2, 5, 12])):
            rows.append(edited(base, rng, rng.randrange(0, 6)))
            chain = edited(chain, rng, 1).split()
            rows.append(" ".join(chain))
    big = [f"big{rng.randrange(900)}" for _ in range(200)]
    rows += [edited(big, rng, rng.randrange(0, 5)) for _ in range(150)]
    rows += [" ".join([f"own{i}y{j}" for j in range(40)] + passage) for i in range(40)]
    rows += [rows[3]] * 5 + [rows[3].upper()]
    rng.shuffle(rows)
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(7)


@pytest.mark.parametrize("tile", [512, 8])
def test_components_against_brute_force(families, monkeypatch, tile):
    monkeypatch.setattr(similar_sets, "BLOCK_SETS", tile)
    assert result(D.near_duplicates(families)) == brute(families.collect())


def test_odd_rows_and_one_of_each_group_stays(odd_docs):
    assert [r[:3] for r in result(D.near_duplicates(odd_docs))] == [r[:3] for r in brute(odd_docs.collect())]
    out = D.keep_one(odd_docs)
    assert out.columns == odd_docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert kept >= {2, 3, 4, 7} and len(kept & set(range(200, 230))) == 1


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(D.near_duplicates(docs)) == brute(docs.collect())


def test_empty_table(no_docs):
    assert D.near_duplicates(no_docs).count() == 0


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 120)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = dict((r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect())
    assert all(got[i] == 0 for i in range(31)) and all(got[i] == 100 for i in range(100, 120)) and got[202] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefixes_lose_no_pair_above_the_threshold():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 63, 700).astype(np.uint64)
    for _ in range(50):
        other = words.copy()
        other[rng.integers(0, 700, 9)] = rng.integers(0, 1 << 63, 9).astype(np.uint64)
        a, b = shingle_set(words, 5), shingle_set(other, 5)
        if similar_sets.linked(a, b, D.SHARE):
            sa, sb = D.signatures([a, b], D.COORDS)
            assert (sa == sb).sum() >= D.MATCH
