"""X1 as a stream: batches in no order of time, late rows, rows without time or key, and what stays in the state."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from quiver.operators.horizons import multi_horizon
from quiver.session import ensure_checkpoint_dir
from quiver.streaming.horizon_counters import Counting, multi_horizon_stream
from quiver.streaming.running_stats import run_to_table

HS = (1, 5, 12)
T0 = datetime(2024, 3, 1)
SCHEMA = "id long, k string, ts timestamp_ntz, v double, n long"


def land(spark, base, batches):
    for rows in batches:    # a file each, later ones written later
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")


def run(spark, base, delay):
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    run_to_table(multi_horizon_stream(src, "k", "ts", HS, ["v"], delay), f"{base}/out", f"{base}/chk")
    return spark.read.parquet(f"{base}/out")


def counters(r):
    return tuple(r[f"{m}_{h}h"] for h in HS for m in ("cnt", "v_sum"))


def same(a, b):
    return len(a) == len(b) and all(x == y or (x is not None and y is not None and (math.isnan(x) and math.isnan(y) or math.isclose(x, y, abs_tol=1e-6)))
                                    for x, y in zip(a, b))


def test_equals_the_batch_counters_over_several_runs(spark, tmp_path):
    """Events come up to ten hours late, in batches, and the query stops and starts again in between."""
    base = f"{ensure_checkpoint_dir(spark)}/test-horizons-{random.randrange(10**12)}"
    rng = random.Random(2)
    rows = []
    for i in range(400):
        t = None if i % 57 == 0 else T0 + timedelta(minutes=rng.randrange(60 * 60)) if i % 3 else T0 + timedelta(hours=rng.randrange(60))
        v = {0: None, 1: math.nan, 2: math.inf}.get(i % 97, rng.random() * 10)
        rows.append((i, rng.choice(["a", "a", "b", None]), t, v, i))
    rows.sort(key=lambda r: (r[2] or T0) + timedelta(hours=rng.randrange(10)))
    parts = [rows[i:i + 100] for i in range(0, 400, 100)]
    land(spark, base, parts[:2])
    first = run(spark, base, "11 hours").count()
    assert 0 < first < 400                       # some are final before the end
    land(spark, base, [*parts[2:], [(None, None, T0 + timedelta(days=90), None, None)]])
    got = {r.id: r for r in run(spark, base, "11 hours").collect()}
    want = {r.id: r for r in multi_horizon(spark.createDataFrame(rows, SCHEMA), "k", "ts", HS, ["v"]).collect()}
    assert set(got) == set(want)
    for i, r in want.items():
        assert not got[i].late and got[i].n == r.n and same(counters(got[i]), counters(r)), (got[i], r)


def test_late_rows_are_put_out_and_count_nowhere(spark):
    base = f"{ensure_checkpoint_dir(spark)}/test-horizons-{random.randrange(10**12)}"
    at = lambda h: T0 + timedelta(hours=h)
    land(spark, base, [[(1, "a", at(0), 1.0, 1), (2, "a", at(1), 1.0, 2)], [(3, "a", at(50), 1.0, 3)], [(9, "a", at(50.5), 1.0, 9)],
                       [(4, "a", at(1), 1.0, 4), (5, "a", at(49), 1.0, 5)], [(6, "a", at(100), 1.0, 6), (7, "b", at(51), 1.0, 7)], [(8, "c", at(5000), 1.0, 8)]])
    got = {r.id: r for r in run(spark, base, "3 hours").collect()}
    assert got[4].late and got[4].cnt_1h is None and got[4].v_sum_12h is None
    assert (got[2].cnt_1h, got[2].cnt_12h) == (2, 2)
    assert not got[5].late and (got[3].cnt_1h, got[3].cnt_12h, got[5].cnt_12h) == (2, 2, 1)
    assert got[6].cnt_12h == 1 and {k for k, r in got.items() if r.late} <= {4, 7} and 8 not in got


def test_keys_of_a_group_are_counted_together_and_apart(spark):
    """Many keys share a group of the state; each counts its own events alone, whatever the number of groups, and calls of the
    state follow groups and stretches instead of keys."""
    rng = random.Random(9)
    rows = [(i, rng.choice([None, *(f"k{j}" for j in range(60))]), T0 + timedelta(minutes=rng.randrange(40 * 60)), rng.random() * 1e6, i) for i in range(600)]
    want = {r.id: counters(r) for r in multi_horizon(spark.createDataFrame(rows, SCHEMA), "k", "ts", HS, ["v"]).collect()}
    for groups in (1, 7):
        base = f"{ensure_checkpoint_dir(spark)}/test-horizons-{random.randrange(10**12)}"
        land(spark, base, [rows[:300], rows[300:], [(None, None, T0 + timedelta(days=90), None, None)]])
        src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        run_to_table(multi_horizon_stream(src, "k", "ts", HS, ["v"], "100 hours", groups=groups), f"{base}/out", f"{base}/chk")
        got = {r.id: r for r in spark.read.parquet(f"{base}/out").collect()}
        assert set(got) == set(want) and not any(r.late for r in got.values())
        assert all(same(counters(got[i]), want[i]) for i in want)
    calls = []
    state = Counting([h for h in HS], 0, [f"c{i}" for i in range(len(HS))])
    hour = 3_600_000_000
    events = [f"={i}" for i in range(50)], np.arange(50) * hour // 100, np.zeros((50, 0)), [str(i) for i in range(50)]
    state.events, state.keep = lambda k: events, lambda k, found: calls.append(k)
    assert [len(f) for f in state.put_out({0: 0}, hour)] == [50] and calls == [0]
