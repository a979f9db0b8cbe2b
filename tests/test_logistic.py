"""Fits against a plain Newton iteration in numpy, from any start, with few slots and with more than a matrix holds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.plans import logistic as G
from quiver.session import ensure_checkpoint_dir


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        a, b, c = rng.randrange(4), rng.choice([0, 1, 2, None]), rng.randrange(2)
        z = 0.7 * a - 1.1 * (b or 0) + 0.4 * c - 0.5
        rows.append((a, b, c, float(rng.random() < 1 / (1 + np.exp(-z))) if i % 50 else None))
    return spark.createDataFrame(rows, "a int, b int, c int, y double").repartition(4), rows


def plain(rows, pos_weight, l2):
    """Newton on the dense one-hot matrix."""
    use = [r for r in rows if r[3] is not None]
    x = np.zeros((len(use), 10))
    for k, (a, b, c, _) in enumerate(use):
        x[k, a] = x[k, 7 + c] = x[k, 9] = 1
        if b is not None:
            x[k, 4 + b] = 1
    y = np.array([r[3] for r in use])
    w, beta, ridge = np.where(y > 0, pos_weight, 1.0), np.zeros(10), np.diag([l2] * 9 + [0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.pinv(x.T @ (x * (w * p * (1 - p))[:, None]) + ridge) @ (x.T @ (w * (p - y)) + ridge @ beta)
    return 1 / (1 + np.exp(-x @ beta)), use


@pytest.mark.parametrize("newton", [512, 0])
@pytest.mark.parametrize("l2", [0.0, 5.0])
def test_fit_and_warm_start(spark, data, monkeypatch, newton, l2):
    monkeypatch.setattr(G, "NEWTON_SLOTS", newton)
    df, rows = data
    slots = G.slots_of(df, ["a", "b", "c"])
    assert slots.sizes == (4, 3, 2)
    merged = G.merged_rows(df, slots, "y", 2.0)
    cold = G.fit(merged, slots, l2=l2, tolerance=1e-9)
    want, use = plain(rows, 2.0, l2)
    by_row = {r[:3]: p for r, p in zip(use, want)}
    got = G.predict(df, {"t": cold}, ["a", "b", "c"]).collect()
    assert len(got) == len(rows) and all(abs(r.score_t - by_row[r.a, r.b, r.c]) < 1e-6 for r in got)

    path = f"{ensure_checkpoint_dir(spark)}/models/test-{random.randrange(10**12)}"
    G.save(spark, {"t": cold, "u": G.Model(slots, np.arange(10.0))}, path)
    back = G.load(spark, path)
    assert set(back) == {"t", "u"} and np.array_equal(back["t"].coefficients, cold.coefficients) and back["t"].slots == slots
    again = G.fit(merged, slots, back["t"], l2=l2, tolerance=1e-9)
    assert again.steps == 0 and np.array_equal(again.coefficients, cold.coefficients)
    later = G.merged_rows(df.filter("a < 3 or y is null or rand(5) < 0.9"), slots, "y", 2.0)
    warm, fresh = G.fit(later, slots, back["t"], l2=l2, tolerance=1e-8), G.fit(later, slots, l2=l2, tolerance=1e-8)
    assert warm.steps <= fresh.steps
    a, b = ([r.score_t for r in G.predict(df.orderBy("a", "b", "c"), {"t": m}).collect()] for m in (warm, fresh))
    assert np.allclose(a, b, atol=1e-5)
    far = G.fit(merged, slots, back["u"], l2=l2, tolerance=1e-9)
    assert np.allclose([r.score_t for r in G.predict(df, {"t": far}).collect()], [r.score_t for r in got], atol=1e-6)


def test_new_slots_begin_at_zero_and_unknown_buckets_have_none(spark, data):
    df, _ = data
    small = G.fit(G.merged_rows(df, G.Slots(("a",), (4,)), "y"), G.Slots(("a",), (4,)))
    wide = G.Slots(("b", "a"), (3, 6))
    grown = G.fit(G.merged_rows(df.limit(0), wide, "y"), wide, small)
    assert grown.coefficients.tolist() == [0, 0, 0, *small.coefficients[:4], 0, 0, small.coefficients[-1]]
    odd = spark.createDataFrame([(None,), (7,), (-1,)], "a int")
    p = {r.score_t for r in G.predict(odd, {"t": small}).collect()}
    assert len(p) == 1 and abs(p.pop() - 1 / (1 + np.exp(-small.coefficients[-1]))) < 1e-12


def test_sums_of_many_partitions(spark, data, monkeypatch):
    monkeypatch.setattr(G, "FAN_IN", 3)
    df, _ = data
    slots = G.slots_of(df, ["a", "c"])
    rows = G.merged_rows(df, slots, "y")
    a, b = (G._sums(x, np.full(7, 0.3), 1.0, True) for x in (rows.repartition(20), rows.coalesce(1)))
    assert all(np.allclose(x, y) for x, y in zip(a, b))
