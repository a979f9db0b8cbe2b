"""X1 against a loop over all events, in buckets and in panes, and the shape of its plan."""

import math
import random
from datetime import datetime, timedelta

import pytest

from quiver.operators.horizons import multi_horizon

HS = (1, 3, 24)


def events(spark, n, seed=4):
    """Two keys (one with most events) and none, ties, missing times, NULL, NaN and infinite values, columns with the operator's own names."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = None if rng.random() < 0.03 else datetime(2024, 1, 1) + timedelta(minutes=rng.choice([rng.randrange(4000), rng.randrange(60) * 60]), seconds=rng.choice([0, 0, 17]))
        v = rng.choice([float(rng.randrange(100)), rng.random(), None, 1e9 * rng.random()])
        if i % 211 == 0:
            v = [math.nan, math.inf, -math.inf][i // 211 % 3]
        rows.append((i, rng.choice(["a", "a", "a", "b", None]), t, v, i * 2, "x"))
    return spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, v double, n long, _uid string").repartition(3), rows


def brute(rows):
    out = {}
    for i, k, t, v, *_ in rows:
        for h in HS:
            if t is None:
                out[i, h] = (None, None)
                continue
            own = [w for _, q, u, w, *_ in rows if q == k and u is not None and t - timedelta(hours=h) <= u <= t]
            out[i, h] = len(own), sum(w for w in own if w is not None)
    return out


def same(a, b):
    return a == b or (a is not None and b is not None and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-4)))


@pytest.mark.parametrize("how", [{}, {"bucket_hours": 5}, {"hot_rows": 40}, {"hot_rows": 1, "bucket_hours": 50}])
def test_counters_against_a_loop(spark, how):
    df, rows = events(spark, 700)
    got = multi_horizon(df, "k", "ts", HS, ["v"], **how)
    assert got.columns == [*df.columns, *(c for h in HS for c in (f"cnt_{h}h", f"v_sum_{h}h"))]
    want = brute(rows)
    seen = got.collect()
    assert len(seen) == len(rows) and {r.id for r in seen} == set(range(len(rows)))
    for r in seen:
        assert r.n == 2 * r.id and r["_uid"] == "x"
        for h in HS:
            assert r[f"cnt_{h}h"] == want[r.id, h][0] and same(r[f"v_sum_{h}h"], want[r.id, h][1]), (r, h, want[r.id, h])


def test_no_events_and_no_values(spark):
    df, rows = events(spark, 60)
    assert multi_horizon(df.filter("id < 0"), "k", "ts", HS, ["v"]).collect() == []
    assert {r.id: r.cnt_3h for r in multi_horizon(df, "k", "ts", HS).collect()} == {i: brute(rows)[i, 3][0] for i in range(60)}


@pytest.mark.parametrize("how", [{}, {"hot_rows": 40}])
def test_no_frame_slides(spark, how):
    """Every frame of the plan starts at the front, so a row costs the same however many events its window holds."""
    df, _ = events(spark, 300)
    plan = multi_horizon(df, "k", "ts", HS, ["v"], **how)._jdf.queryExecution().executedPlan().toString()
    frames = [x.split(")")[0] for x in plan.split("specifiedwindowframe(")[1:]]
    assert frames and all("unboundedpreceding" in f for f in frames)


def test_tasks_follow_the_events(spark, monkeypatch):
    """A task gets a bounded number of events, whatever the planner would merge."""
    from quiver.operators import horizons
    monkeypatch.setattr(horizons, "TASK_EVENTS", 10)
    df, rows = events(spark, 300)
    out = multi_horizon(df, "k", "ts", HS, ["v"])
    assert out.rdd.getNumPartitions() >= 30
    assert {r.id: r.cnt_3h for r in out.collect()} == {i: w[0] for (i, h), w in brute(rows).items() if h == 3}
