"""X4 by selection against numpy: small brackets so that several rounds run, heavy ties, NULL, NaN, empty groups; and its plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.plans import quantiles as Q

PROBS = (0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0)


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(7)
    parts = {"normal": rng.normal(size=20_000), "ties": rng.integers(0, 5, 15_000).astype(float), "one": np.full(9_000, 3.5),
             "hot": np.where(rng.random(12_000) < 0.4, 0.0, rng.random(12_000)), "skew": np.exp(rng.normal(size=18_000) * 4), "few": np.array([4.0, 1.0, 2.5]),
             "inf": np.concatenate([rng.random(5_000), np.full(100, np.inf)]), None: rng.random(4_000)}
    rows = [(g, float(v)) for g, vs in parts.items() for v in vs] + [("few", None), ("none", None)]
    return spark.createDataFrame(rows, "g string, v double").repartition(6), parts


@pytest.mark.parametrize("keep", [Q.KEEP, 300, 20])
def test_groups_against_numpy(groups, keep):
    df, parts = groups
    got = {(r.g, r.prob): r.value for r in Q.exact_quantiles_by(df, "g", "v", PROBS, keep).collect()}
    assert set(got) == {(g, p) for g in parts for p in PROBS}
    for g, v in parts.items():
        with np.errstate(invalid="ignore"):
            want = np.quantile(v, PROBS)
        for p, w in zip(PROBS, want):
            x = got[g, p]
            assert x == w or abs(x - w) <= 1e-9 * max(1.0, abs(w)) or (np.isnan(w) and x == np.inf), (g, p, x, w)


def test_nan_is_largest_and_nothing_gives_nothing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "v double")
    got = {r.prob: r.value for r in Q.exact_quantiles(df, "v", (0.0, 0.5, 1.0)).collect()}
    assert got[0.0] == 1.0 and got[0.5] == 2.0 and np.isnan(got[1.0])
    assert Q.exact_quantiles(df.filter("v > 5 and not isnan(v)"), "v", (0.5,)).collect() == []


def test_bad_sketches_are_not_taken(groups, monkeypatch):
    """Sketches that are off by far: the counts reject their brackets, and the result stays exact."""
    df, parts = groups
    monkeypatch.setattr(Q, "_cuts", lambda x: F.transform(F.percentile_approx(x, [k / Q.GRID for k in range(1, Q.GRID)], 100), lambda c: c + 0.3))
    got = {(r.g, r.prob): r.value for r in Q.exact_quantiles_by(df, "g", "v", (0.25, 0.5), 300).collect()}
    for g in ("normal", "ties", "hot"):
        assert np.allclose([got[g, p] for p in (0.25, 0.5)], np.quantile(parts[g], (0.25, 0.5)))


def test_rows_outside_the_brackets_are_not_exchanged(spark):
    """What is ordered in the end are the brackets' rows, some thousandths of the column."""
    df = spark.range(0, 200_000, 1, 4).select(F.xxhash64("id").cast("double").alias("v"))
    out = Q.exact_quantiles(df, "v", (0.5,))
    counted = []
    real = Q._rows_inside
    try:
        Q._rows_inside = lambda *a: counted.append(real(*a)) or counted[-1]
        Q.exact_quantiles(df, "v", (0.5,))
    finally:
        Q._rows_inside = real
    assert counted[-1].count() <= Q.KEEP and out.count() == 1


def test_later_rounds_read_the_stored_rows_alone(spark, monkeypatch):
    """After the first round only rows that brackets hold are counted: exact all the same, with ties, -0.0 and NaN."""
    import numpy as np

    from quiver.plans import quantiles
    stored = []
    keep = quantiles._stored
    monkeypatch.setattr(quantiles, "_stored", lambda rows: stored.append(keep(rows)) or stored[-1])
    rng = np.random.default_rng(5)
    a = np.where(rng.random(20_000) < 0.3, 0.25, rng.random(20_000))
    b = np.where(rng.random(20_000) < 0.6, -0.0, rng.random(20_000))
    df = spark.createDataFrame([(g, float(x)) for g, xs in (("a", a), ("b", b)) for x in xs] + [(None, float("nan"))] * 50, "g string, x double").repartition(3)
    probs = (0.1, 0.5, 0.9)
    got = {(r.g, r.prob): r.value for r in quantiles.exact_quantiles_by(df, "g", "x", probs, keep=50).collect()}
    for g, xs in (("a", a), ("b", b)):
        assert np.allclose([got[g, p] for p in probs], np.quantile(xs, probs), atol=1e-12)
    assert all(np.isnan(got[None, p]) for p in probs)
    sizes = [s.count() for s in stored]
    assert len(sizes) > 1 and sizes[0] < 20_000 and sizes[-1] <= sizes[0]
