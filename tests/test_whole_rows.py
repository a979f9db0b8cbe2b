"""Rows with missing keys, late steps and second writes don't vanish, and results don't depend on bucket counts."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.functions.arrays import self_attention_pool
from quiver.operators.sequence import consecutive
from quiver.operators.horizons import entities_in_windows, entity_sketches
from quiver.plans.metrics import concordance, distributions, evaluation_report, pairwise_auc, pairwise_auc_in_batches, vector_sum
from quiver.plans.prefix import running_totals, running_totals_by
from quiver.session import ensure_checkpoint_dir
from quiver.sources.sink import write_scored
from quiver.streaming.running_stats import running_stats_stream, run_to_table


@pytest.mark.parametrize("n", [8, 200])
def test_ranks_with_a_null_key_at_any_number_of_buckets(spark, n):
    df = spark.createDataFrame([(float(i),) for i in range(300)] + [(None,)], "k double").repartition(5)
    got = {r.k: r["rank"] for r in running_totals(df, "k", [], n_buckets=n, with_count="rank").collect()}
    assert got == {None: 1} | {float(i): i + 2 for i in range(300)}


@pytest.mark.parametrize("n", [3, 150])
def test_grouped_totals_with_null_groups_and_many_buckets(spark, n):
    rows = [(g, k, 1.0) for g in ("a", None) for k in range(400)] + [("a", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, k int, v double")
    got = {(r.g, r.k): r.cum_v for r in running_totals_by(df, "g", "k", ["v"], n_buckets=n).collect()}
    assert got == {("a", None): 1.0} | {("a", k): k + 2.0 for k in range(400)} | {(None, k): k + 1.0 for k in range(400)}


def test_concordance_against_all_pairs():
    rng = np.random.default_rng(0)
    for levels in (2, 5, 60):
        p, l, w = rng.integers(0, 15, 80) / 7, rng.integers(0, levels, 80) * 1.5, rng.integers(1, 4, 80) * 1.0
        want = sum(w[i] * w[j] * ((p[i] > p[j]) + 0.5 * (p[i] == p[j])) for i in range(80) for j in range(80) if l[i] > l[j])
        assert abs(concordance(p, l, w) - want) < 1e-9


@pytest.mark.parametrize("n", [1, 4, 70])
def test_auc_of_continuous_labels(spark, n):
    rng = random.Random(4)
    rows = [(rng.randrange(30) / 30, rng.random() if i % 3 else rng.randrange(4) / 4) for i in range(200)] + [(None, 1.0), (0.5, None)]
    ok = [r for r in rows if None not in r]
    pairs = [(a, b) for a in ok for b in ok if a[1] > b[1]]
    want = sum((a[0] > b[0]) + 0.5 * (a[0] == b[0]) for a, b in pairs) / len(pairs)
    df = spark.createDataFrame(rows, "p double, y double").repartition(3)
    assert abs(pairwise_auc(df, "p", "y", n_buckets=n).first().auc - want) < 1e-12


def test_no_task_of_a_graded_auc_holds_all_scores_of_a_label(spark, monkeypatch):
    def bounded(p, l, w):
        assert len(p) <= 1200, f"{len(p)} rows in one group"
        return concordance(p, l, w)

    monkeypatch.setattr("quiver.plans.metrics.concordance", bounded)
    rng = np.random.default_rng(5)
    p, y = rng.random(6000), rng.choice([0.0, 0.0, 0.0, 1.0, 2.0], 6000)
    higher = y[:, None] > y
    want = (higher & (p[:, None] > p)).sum() / higher.sum()
    df = spark.createDataFrame(list(zip(p.tolist(), y.tolist())), "p double, y double").repartition(3)
    assert abs(pairwise_auc(df, "p", "y", n_buckets=8).first().auc - want) < 1e-12


def test_rows_without_a_score_take_no_part(spark):
    rows = [(0.9, 1.0), (0.2, 0.0), (0.7, 0.0)]
    a = evaluation_report(spark.createDataFrame(rows, "p double, y double"), {"convert": ("y", "p")}).collect()
    b = evaluation_report(spark.createDataFrame(rows + [(None, 1.0)], "p double, y double"), {"convert": ("y", "p")}).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def run_steps(spark, tmp_path, files, **how):
    for i, steps in enumerate(files):
        spark.createDataFrame([("m", s, float(s)) for s in steps], "metric string, step long, value double").coalesce(1).write.parquet(
            str(tmp_path / "in" / f"f{i}"))
    src = spark.readStream.schema("metric string, step long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    run_to_table(running_stats_stream(src, decay=0.9, **how), str(tmp_path / "out"), str(tmp_path / "chk"))
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_steps_out_of_order_over_files_equal_the_batch_result(spark, tmp_path):
    out = run_steps(spark, tmp_path, [(1, 2), (5, 6), (3, 4), (6, 7)])
    got = {r.step: r for r in out if not r.late}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7]
    ema = 0.0
    for s in range(1, 8):
        ema = 0.9 * ema + 0.1 * s
        assert abs(got[s].ema - ema) < 1e-12 and abs(got[s].mean - (s + 1) / 2) < 1e-12
    assert [(r.step, r.mean) for r in out if r.late] == [(6, None)]


def test_a_gap_that_stays_open_is_given_up_and_its_steps_come_out_late(spark, tmp_path):
    out = run_steps(spark, tmp_path, [(1,), (3, 4, 5, 6), (2,)], max_waiting=3)
    assert sorted(r.step for r in out if not r.late) in ([1, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6])   # by the order of the files
    assert sorted(r.step for r in out) == [1, 2, 3, 4, 5, 6]


def test_more_than_a_hundred_thousand_steps_wait(spark, tmp_path):
    n = 240_000
    for i in (2, 1, 0):    # dealt over the files, so that two of three steps are missing after the first
        spark.range(1 + i, n + 1, 3, numPartitions=1).selectExpr("if(id > 200000, null, 'm') as metric", "if(id > 200000, id - 200000, id) as step",
                                                               "cast(id % 7 as double) as value").write.parquet(str(tmp_path / "in" / f"f{i}"))
    src = spark.readStream.schema("metric string, step long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    run_to_table(running_stats_stream(src, decay=0.9), str(tmp_path / "out"), str(tmp_path / "chk"))
    out = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert len(out) == n and not out["late"].any()
    for m, first, last in (("m", 1, 200_000), (None, 200_001, n)):
        got = out[out["metric"].isna() if m is None else out["metric"] == m].sort_values("step")
        v = np.arange(first, last + 1) % 7 * 1.0
        ema = np.zeros(len(v) + 1)
        for k, x in enumerate(v):
            ema[k + 1] = 0.9 * ema[k] + 0.1 * x
        assert got["step"].tolist() == list(range(1, len(v) + 1))
        assert np.allclose(got["mean"], np.cumsum(v) / np.arange(1, len(v) + 1)) and np.allclose(got["ema"], ema[1:])


def test_train_and_eval_written_one_after_the_other(spark, tmp_path):
    path = str(tmp_path / "scored")
    for split, n in (("train", 3), ("eval", 2), ("eval", 4)):
        write_scored(spark.range(n).withColumn("dataset", F.lit(split)), path)
    assert {r.dataset: r["count"] for r in spark.read.parquet(path).groupBy("dataset").count().collect()} == {"train": 3, "eval": 4}


def test_sequences_use_every_row(spark):
    df = spark.createDataFrame([(k, i, float(i)) for k, n in ((1, 45), (2, 3), (None, 21)) for i in range(n)], "k int, i int, v double")
    got = {(r.k, r.chunk): (r.v_seq, r.n_valid) for r in consecutive(df, "k", "i", ["v"], 20).collect()}
    assert sorted(got, key=repr) == sorted([(1, 0), (1, 1), (1, 2), (2, 0), (None, 0), (None, 1)], key=repr)
    assert got[1, 2] == ([40.0, 41.0, 42.0, 43.0, 44.0] + [0.0] * 15, 5)


def test_attention_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id int, s array<array<double>>, m array<boolean>")
    assert self_attention_pool(df, "s", "m", keep=["id"]).count() == 0


def test_no_scratch_folder_on_a_cluster():
    class Conf:
        def get(self, k, d=None):
            return d

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())


def test_no_task_holds_all_labels_of_a_score(spark, monkeypatch):
    """A third of the rows share one score and differ in their labels: ties are counted without bringing them together."""
    def bounded(p, l, w, group=None):
        assert len(p) <= 1800, f"{len(p)} rows in one group"
        return concordance(p, l, w, group)

    monkeypatch.setattr("quiver.plans.metrics.concordance", bounded)
    rng = np.random.default_rng(6)
    p = np.where(rng.random(6000) < 0.4, 0.25, rng.random(6000))
    y = rng.random(6000)
    higher = y[:, None] > y
    want = (higher * ((p[:, None] > p) + 0.5 * (p[:, None] == p))).sum() / higher.sum()
    df = spark.createDataFrame(list(zip(p.tolist(), y.tolist())), "p double, y double").repartition(3)
    assert abs(pairwise_auc(df, "p", "y", n_buckets=8).first().auc - want) < 1e-12


@pytest.mark.parametrize("batch_rows", [200_000, 90, 1])
def test_batches_with_any_number_of_levels(spark, batch_rows):
    """Continuous labels, a batch that holds most rows, ties, batches without pairs, a NULL batch; counted in tasks or in ranges."""
    rng = random.Random(9)
    rows = []
    for i in range(900):
        b = rng.choice(["hot", "hot", "hot", "a", "b", None])
        rows.append((b, rng.choice([0.5, rng.random()]), rng.choice([0.0, rng.random()]), 1.0 if i % 11 else 0.0))
    rows += [("single", 0.1, 0.3, 1.0), ("level", 0.1, 2.0, 1.0), ("level", 0.2, 2.0, 1.0), ("none", None, 1.0, 1.0), ("b", 0.4, None, 1.0)]
    df = spark.createDataFrame(rows, "k string, p double, y double, m double").repartition(3)
    got = {r.k: r.auc for r in pairwise_auc_in_batches(df, "p", "y", "k", mask="m", batch_rows=batch_rows).collect()}
    assert set(got) == {r[0] for r in rows}
    for k, auc in got.items():
        own = [r for r in rows if r[0] == k and r[3] > 0 and None not in r[1:3]]
        pairs = [(a, b) for a in own for b in own if a[2] > b[2]]
        want = sum((a[1] > b[1]) + 0.5 * (a[1] == b[1]) for a, b in pairs) / len(pairs) if pairs else 1.0
        assert abs(auc - want) < 1e-12, k


def test_concordance_by_groups():
    rng = np.random.default_rng(3)
    p, l, w, g = rng.integers(0, 9, 500) / 9, rng.integers(0, 40, 500) / 7, rng.integers(1, 4, 500).astype(float), rng.integers(0, 6, 500)
    assert np.allclose(concordance(p, l, w, g), [concordance(p[g == k], l[g == k], w[g == k]) for k in range(6)])


def test_distributions_hold_every_row(spark):
    rows = [(0.0, [1.0, None]), (0.999, [2.0]), (1.0, []), (-0.1, None), (None, [0.5]), (float("nan"), [9.0])]
    df = spark.createDataFrame(rows, "x double, v array<double>")
    got = {(r.name, r.bin): r.n for r in distributions(df, {"x": (F.col("x"), 0, 1), "s": (vector_sum("v"), 0, 4)}, bins=4).collect()}
    assert got == {("x", 0): 1, ("x", 3): 1, ("x", 4): 2, ("x", -1): 1, ("x", None): 1, ("s", 1): 1, ("s", 2): 1, ("s", 0): 2, ("s", None): 1, ("s", 4): 1}


def test_sketches_of_hours_make_windows(spark):
    rows = [(datetime(2024, 1, 1, h), u) for h in range(30) if h < 24 for u in range(h * 10, h * 10 + 40)] + [(None, 5), (datetime(2024, 1, 1, 3), None)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, u long")
    stored = entity_sketches(df, "ts", "u")
    first = datetime(2024, 1, 1)
    base = int((first - datetime(1970, 1, 1)).total_seconds() // 3600)
    got = {r.hour_id - base: r.n_entities for r in entities_in_windows(stored, 5).collect()}
    assert set(got) == set(range(24))
    for h, n in got.items():
        exact = len({u for t, u in rows if t is not None and u is not None and h - 4 <= t.hour <= h})
        assert abs(n - exact) <= max(1, 0.07 * exact)


def test_large_batches_share_tasks(spark):
    """Many batches above the limit: a task takes many ranges, a batch gets as many ranges as its rows ask for, and a score that many rows share is right."""
    rng = random.Random(12)
    rows = [(i // 40, rng.choice([0.5, 0.5, rng.random()]), rng.random()) for i in range(4000)]
    df = spark.createDataFrame(rows, "k long, p double, y double").repartition(3)
    out = pairwise_auc_in_batches(df, "p", "y", "k", batch_rows=20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    calls = [x.split("]")[0] for x in plan.split("FlatMapGroupsInPandas [")[1:]]
    assert calls and all(c.startswith("_task") for c in calls)
    for r in out.collect():
        own = [x for x in rows if x[0] == r.k]
        pairs = [(a, b) for a in own for b in own if a[2] > b[2]]
        assert abs(r.auc - sum((a[1] > b[1]) + 0.5 * (a[1] == b[1]) for a, b in pairs) / len(pairs)) < 1e-12
