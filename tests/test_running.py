"""A17 for every block size, T1 on rows that A17 sees too, and P23's lengths."""

import random

import pytest
from pyspark.sql import functions as F

from quiver.operators.features import assemble_df
from quiver.plans.running import running_stats
from quiver.session import ensure_checkpoint_dir
from quiver.streaming.running_stats import running_stats_stream, run_to_table


def recurrence(values, d):
    e, total, out = 0.0, 0.0, []
    for n, v in enumerate(values, 1):
        e, total = d * e + (1 - d) * (v or 0.0), total + (v or 0.0)
        out.append((total / n, e))
    return out


@pytest.mark.parametrize("decay,block", [(0.9, 1), (0.9, 3), (0.9, 50), (0.999, 2), (0.999, 17), (0.3, 1), (0.3, 10**9), (0.9999, 1)])
def test_any_block_size_gives_the_recurrence(spark, decay, block):
    rng = random.Random(1)
    values = [None if i % 13 == 5 else rng.random() * 10 - 3 for i in range(900)]
    df = spark.createDataFrame(list(enumerate(values)), "step long, v double").repartition(3)
    got = running_stats(df, "step", ["v"], decay=decay, block=block, n_buckets=4).orderBy("step").collect()
    for r, (mean, ema) in zip(got, recurrence(values, decay)):
        assert abs(r.v_mean - mean) < 1e-9 and abs(r.v_ema - ema) < 1e-9


def test_no_window_holds_the_block_table(spark):
    df = spark.range(100).select(F.col("id").alias("step"), F.col("id").cast("double").alias("v"))
    plan = running_stats(df, "step", ["v"], decay=0.3, block=2)._jdf.queryExecution().executedPlan().toString()
    assert "_blk" in plan and "SinglePartition" not in plan


def test_stream_on_missing_steps_and_values(spark):
    """NULL values add nothing and NULL steps are put out apart; the rest equals A17."""
    base = f"{ensure_checkpoint_dir(spark)}/test-running-{random.randrange(10**12)}"
    rng = random.Random(2)
    rows = [("m", i, None if i % 7 == 3 else rng.random()) for i in range(1, 200)]
    extra = [("m", None, 1.0), ("m", None, None), ("m", 5, 9.0)]
    first, second = [r for r in rows if r[1] % 3], [r for r in rows if not r[1] % 3] + extra
    for part in (first, second):
        spark.createDataFrame(part, "metric string, step long, value double").coalesce(1).write.mode("append").parquet(f"{base}/in")
    src = spark.readStream.schema("metric string, step long, value double").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    run_to_table(running_stats_stream(src, decay=0.9), f"{base}/out", f"{base}/chk")
    got = spark.read.parquet(f"{base}/out").collect()
    assert sorted(((r.step, r.value) for r in got if r.late), key=repr) == sorted([(None, 1.0), (None, None), (5, 9.0)], key=repr)
    want = running_stats(spark.createDataFrame([r[1:] for r in rows], "step long, value double"), "step", ["value"], decay=0.9)
    want = {r.step: r for r in want.collect()}
    seen = [r for r in got if not r.late]
    assert len(seen) == len(rows) and {r.step for r in seen} == set(want)
    for r in seen:
        assert r.value == want[r.step].value and abs(r.mean - want[r.step].value_mean) < 1e-12 and abs(r.ema - want[r.step].value_ema) < 1e-12


def test_assembled_arrays_have_their_length(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "x long, a array<double>")
    out = assemble_df(df, ["a", "x"], lengths={"a": 2})
    assert [r.features for r in out.orderBy("x").collect()] == [[1.0, 2.0, 1.0], [3.0, 4.0, 2.0]]
    for bad in ([1.0], None, [1.0, 2.0, 3.0]):
        with pytest.raises(Exception, match="a: 2 slots expected"):
            assemble_df(spark.createDataFrame([(1, bad)], df.schema), ["a", "x"], lengths={"a": 2}).collect()
    with pytest.raises(ValueError):
        assemble_df(df, ["a", "x"], lengths={"x": 1})
