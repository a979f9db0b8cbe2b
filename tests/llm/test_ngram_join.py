import random
import re

import numpy as np
import pytest

from quiver.llm import near_dedup, ngram_join as J, similar_sets

PAT = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = PAT.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width=4, share=(85, 100)):
    sets = [shingles(r.text, width) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and share[1] * both >= share[0] * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        f = find(i)
        least[f] = min((x for x in (least.get(f), r.doc_id) if x is not None), default=None)
    return sorted(((r.doc_id, len(s), least[find(i)]) for i, (r, s) in enumerate(zip(rows, sets))), key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def edited(words, rng, n):
    w = list(words)
    for _ in range(n):
        at = rng.randrange(len(w))
        w[at:at + 1] = rng.choice([[f"edit{rng.randrange(10**6)}"], [], [w[at], f"more{rng.randrange(10**6)}"]])
    return " ".join(w)


@pytest.fixture(scope="module")
def families(spark):
    """Near copies of all sizes and distances, chains, a large group, one of texts that are alike but not linked, and shared passages."""
    rng = random.Random(8)
    rows = []
    passage = [f"p{i}" for i in range(60)]
    for n in [*range(1, 40), 50, 60, 80, 150, 151, 152, 400, 1500]:
        base = [f"w{n}x{rng.randrange(4000)}" for _ in range(n)]
        chain = base
        for k in range(4):
            rows.append(edited(base, rng, rng.randrange(0, 2 + n // 40)))
            chain = (edited(chain, rng, 1).split() or ["x"])
            rows.append(" ".join(chain))
    big = [f"big{rng.randrange(900)}" for _ in range(200)]
    rows += [edited(big, rng, rng.randrange(0, 5)) for _ in range(120)]
    alike = [f"alike{i}" for i in range(160)]
    rows += [" ".join(w if i % 16 else f"slot{k}n{i}" for i, w in enumerate(alike)) for k in range(90)]
    rows += [" ".join([f"own{i}y{j}" for j in range(40)] + passage) for i in range(40)]
    rows += [rows[3]] * 5 + [rows[3].upper()]
    rng.shuffle(rows)
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(6)


def test_against_all_pairs(families):
    assert result(J.join_similar(families)) == brute(families.collect())


@pytest.mark.parametrize("kind", ["one deletion", "mixed", "spare", "exact"])
def test_every_allocation_gives_the_same_rows(families, kind):
    """Whatever the costs say: a band may allow one difference in all, some or no segments, or have segments to spare."""
    out = []
    for hi in J.bands(J.SHARE)[:30]:
        most = J.budget(int(hi), J.SHARE)
        ones = {"one deletion": (most + 1) // 2, "mixed": (most + 1) // 3}.get(kind, 0)
        spare = 3 if kind == "spare" else 0
        out.append(J.Allocation(most + 1 + spare - ones, ones, spare) if most else None)
    assert result(J.join_similar(families, allocations=out)) == brute(families.collect())


def test_other_width_and_share_in_small_blocks(families, monkeypatch):
    monkeypatch.setattr(similar_sets, "BLOCK_SETS", 16)
    assert result(J.join_similar(families, words=2, share=(60, 100))) == brute(families.collect(), 2, (60, 100))
    assert result(J.join_similar(families)) == brute(families.collect())


def test_near_dedup_in_small_blocks(families, monkeypatch):
    monkeypatch.setattr(similar_sets, "BLOCK_SETS", 16)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(families).collect()), key=repr)
    assert got == brute(families.collect(), 5)


def test_odd_and_no_rows(odd_docs, no_docs):
    assert result(J.join_similar(odd_docs)) == brute(odd_docs.collect())
    assert J.join_similar(no_docs).collect() == []


def test_pigeonhole_on_random_pairs():
    """Two sets within the budget share a key of each allocation, in the band of the smaller one."""
    rng = np.random.default_rng(3)
    ends = J.bands(J.SHARE)
    for n in (6, 9, 13, 30, 200, 1000):
        k = int(np.searchsorted(ends, n))
        most = J.budget(int(ends[k]), J.SHARE)
        for a in (J.Allocation(most + 1, 0, 0), J.Allocation(most + 1 - (most + 1) // 2, (most + 1) // 2, 0)):
            seg = J.Segments(k, a)
            for _ in range(30):
                x = np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False))
                gone = rng.integers(0, most + 1)
                y = np.unique(np.concatenate([np.delete(x, rng.choice(len(x), gone, replace=False)), rng.integers(0, 1 << 64, most - gone, np.uint64)]))
                (kx, own_x), (ky, own_y) = (seg.keys(s, np.concatenate([np.zeros(1, np.uint64), np.cumsum(J.mix(s ^ J.SALT), dtype=np.uint64)])) for s in (x, y))
                assert set(kx[:own_x]) & set(ky) or set(kx) & set(ky[:own_y])


def test_costs_choose():
    """Hardly anything falls into a segment of a small set, so many small sets take one-deletion neighbours; others spare segments."""
    assert J.allocate(0, 10, 5) is None
    assert J.allocate(1, 10**8, 8).ones == 1
    assert J.allocate(1, 100, 8).ones == 0
    assert J.allocate(60, 10**6, 340).ones == 0
    for most in (1, 2, 3, 10, 1000, 10**6):
        a = J.allocate(most, 10**6, most * 6.0)
        assert a.segments + a.ones - a.spare == most + 1
