import re
from collections import Counter
from itertools import permutations

import pytest

from quiver.llm import filter_audit as A

PAT = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    """Every order applied to every row."""
    good = {r.doc_id for r in labels if r.quality == 1}
    toxic = {r.doc_id for r in labels if r.toxic == 1}
    ids: dict = {}
    for r in docs:
        if r.doc_id is not None:
            ids.setdefault(r.text or "", []).append(r.doc_id)
    rows = []
    for r in docs:
        t = r.text or ""
        w = PAT.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": r.doc_id is not None and any(x < r.doc_id for x in ids[t])}
        rows.append((r.source or "", fails, r.doc_id in good and r.doc_id is not None, r.doc_id in toxic and r.doc_id is not None))
    n, shapley = Counter(), Counter()
    for order in map("".join, permutations("ABCDE")):
        for part, fails, g, t in rows:
            gone = False
            for step, f in enumerate(order, 1):
                key = part, order, step
                n[key, "removed"] += fails[f] and not gone
                n[key, "redundant"] += fails[f] and gone
                n[key, "unique_fails"] += fails[f] and sum(fails.values()) == 1
                n[key, "good_lost"] += fails[f] and not gone and g
                n[key, "toxic_lost"] += fails[f] and not gone and t
                shapley[part, f] += fails[f] and not gone
                gone = gone or fails[f]
                n[key, "kept"] += not gone
    return sorted((p, o, s, *(n[(p, o, s), c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), shapley[p, o[s - 1]])
                  for p, o, s in {k for k, _ in n})


def test_odd_rows_against_brute_force(spark, odd_docs, no_docs):
    long = " ".join(f"word{i}" for i in range(250))
    more = [(300, long, "en", "a"), (301, long, "en", "b"), (301, long, "en", "b"), (302, long.upper(), "en", "a"), (303, long + " #", None, None),
            (None, long, "en", "a"), (304, "same " * 400, "en", "a"), (305, "same " * 400 + "$ X" * 99, "en", "b")]
    docs = odd_docs.select("doc_id", "text", "lang", "source", "slot").unionByName(
        spark.createDataFrame([(*r, 1) for r in more], "doc_id long, text string, lang string, source string, slot int"))
    labels = spark.createDataFrame([(300, 1, 0), (301, 1, 1), (301, 0, 0), (303, None, 1), (None, 1, 1), (5, 1, None), (205, 1, 1), (999, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    got = A.audit(docs, labels)
    assert got.columns == [c.split()[0] for c in A.REPORT.split(", ")]
    assert sorted(map(tuple, got.collect())) == brute(docs.collect(), labels.collect())
    assert A.audit(no_docs, labels).collect() == []
    assert sorted(map(tuple, A.audit(docs, labels.filter("1 = 0")).collect())) == brute(docs.collect(), [])


def test_many_parts_and_small_tables_of_sums(spark, monkeypatch):
    monkeypatch.setattr(A, "HELD_PARTS", 2)
    docs = spark.createDataFrame([(i, "A#" * (i % 4) + " x" * (i % 300), f"part{i % 40}") for i in range(400)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(0, 400, 3)], "doc_id long, quality int, toxic boolean").withColumn("toxic", A.F.col("toxic").cast("int"))
    assert sorted(map(tuple, A.audit(docs.repartition(5), labels).collect())) == brute(docs.collect(), labels.collect())


def test_packed_counters():
    """Fields far beyond 32 bits stay apart, and the count of documents that no longer fits is an error."""
    many = (1 << 60) + 12345
    n, removed = A.unpack(many * A.packed(0b10101) + 3 * A.packed(0))
    assert n == many + 3
    for order, gone in zip(A.ORDERS, removed):
        step = min(order.index(f) for f in "ACE")
        assert gone == [many if s == step else 0 for s in range(5)]
    with pytest.raises(OverflowError):
        A.unpack((1 << 64) * A.packed(1))
