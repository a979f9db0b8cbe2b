"""Invariants and brute-force checks for the operators whose SQL twin is
missing or whose distributed plan differs from the textbook one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.functions import transforms as T
from quiver.plans import metrics as M
from quiver.plans.prefix import running_totals
from quiver.plans.quantiles import exact_quantiles
from quiver.plans.running import running_stats
from quiver.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def brute_auc(p, y):
    pos = [a for a, b in zip(p, y) if b > 0.5]
    neg = [a for a, b in zip(p, y) if b <= 0.5]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def test_running_totals_many_buckets(spark):
    rng = np.random.default_rng(1)
    vals = rng.normal(size=500)
    keys = rng.permutation(500).astype(float)
    df = spark.createDataFrame([(float(k), float(v)) for k, v in zip(keys, vals)], "k double, v double")
    got = running_totals(df, "k", ["v"], n_buckets=13, with_count="rank").orderBy("k").collect()
    order = np.argsort(keys)
    assert [r.rank for r in got] == list(range(1, 501))
    assert np.allclose([r.cum_v for r in got], np.cumsum(vals[order]))


def test_running_totals_binary_search_buckets(spark):
    rng = np.random.default_rng(6)
    vals = rng.normal(size=3000)
    keys = rng.permutation(3000).astype(float)
    df = spark.createDataFrame([(float(k), float(v)) for k, v in zip(keys, vals)], "k double, v double")
    got = running_totals(df, "k", ["v"], n_buckets=300).orderBy("k").collect()     # > 64 cuts
    order = np.argsort(keys)
    assert np.allclose([r.cum_v for r in got], np.cumsum(vals[order]))


def test_pairwise_auc_matches_brute_force_and_symmetry(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.random(400), 2)           # many ties
    y = (rng.random(400) < 0.4).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, y)], "p double, y double")
    auc = M.pairwise_auc(df, "p", "y", n_buckets=7).first().auc
    assert auc == pytest.approx(brute_auc(p, y), abs=1e-12)
    neg = M.pairwise_auc(df.withColumn("p", -F.col("p")), "p", "y", n_buckets=7).first().auc
    assert auc + neg == pytest.approx(1.0, abs=1e-12)
    assert M.pairwise_auc(df.filter("y > 0.5"), "p", "y").first().auc == 1.0   # no pairs


def test_binned_auc_counts_and_confusion_total(spark):
    s = X.samples(spark, SF)
    n = s.count()
    y = F.when(F.col("roi1") >= 1, 1.0).otherwise(0.0)
    c = s.select("p", y.alias("y")).agg(*M.confusion("p", "y")).first()
    assert c.TP + c.FP + c.TN + c.FN == n
    rep = {(r.task, r.metric): r.value for r in M.evaluation_report(s, {"roi1": ("roi1", "p")}).collect()}
    assert rep[("roi1", "TP")] == c.TP and rep[("roi1", "FN")] == c.FN
    assert 0.0 <= rep[("roi1", "auc")] <= 1.0


def test_bucket_counts_sum_to_rows(spark):
    from quiver.catalog.metrics_q import _long_bucketed
    hist = _long_bucketed(spark, SF).groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert all(r.n == n for r in hist)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.exponential(size=1001), 3)
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.prob: r.value for r in exact_quantiles(df, "x", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(v, p)), abs=1e-12)


def test_ema_blocks_equal_loop(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=300)
    df = spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(v)], "step long, v double")
    d = 0.3                                   # 120-step blocks: the carry crosses 2 boundaries
    got = running_stats(df, "step", ["v"], decay=d, block=120, n_buckets=5).orderBy("step").collect()
    e, ema = 0.0, []
    for x in v:
        e = d * e + (1 - d) * x
        ema.append(e)
    assert np.allclose([r.v_ema for r in got], ema, atol=1e-12)
    assert np.allclose([r.v_mean for r in got], np.cumsum(v) / np.arange(1, 301))


def test_stream_equals_batch(spark):
    from quiver.catalog.model_q import t1
    from quiver.catalog.horizons_q import a17
    s = {r.step: (r.mean, r.ema) for r in t1(spark, SF).collect()}
    b = {r.step: (r.v_mean, r.v_ema) for r in a17(spark, SF).collect()}
    assert s.keys() == b.keys()
    for k in s:
        assert s[k][0] == pytest.approx(b[k][0], abs=1e-5) and s[k][1] == pytest.approx(b[k][1], abs=1e-5)


def test_self_attention_pool_brute_force(spark):
    from quiver.functions.arrays import self_attention_pool
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4, 3))
    mask = [True, True, False, True]
    df = spark.createDataFrame([(1, x.tolist(), mask)], "id int, s array<array<double>>, m array<boolean>")
    got = np.array(self_attention_pool(df, "s", "m", keep=["id"]).first().pooled)
    acc = np.zeros(3)
    for i in range(4):
        if not mask[i]:
            continue
        logits = [float(x[i] @ x[j]) / math.sqrt(3) for j in range(4)]
        mx = max(logits)
        ex = [math.exp(l - mx) if mask[j] else 0.0 for j, l in enumerate(logits)]
        tot = sum(ex) + 1e-6
        acc += sum(ex[j] / tot * x[j] for j in range(4))
    assert np.allclose(got, acc / 3)


def test_horizon_bucket_width_does_not_change_counts(spark):
    from quiver.operators.horizons import multi_horizon
    ev = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "ts", "value")
    a = multi_horizon(ev, "user_id", "ts", [1, 24, 72], ["value"])
    b = multi_horizon(ev, "user_id", "ts", [1, 24, 72], ["value"], bucket_hours=5)
    cols = ["event_id", "cnt_1h", "cnt_24h", "cnt_72h"]
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_previous_value_split_by_day(spark):
    from quiver.operators.horizons import previous_value
    ev = spark.read.parquet(f"{SF}/events.parquet")
    a = previous_value(ev, "user_id", "event_id", ["value"]).select("event_id", "value_last")
    b = previous_value(ev, "user_id", "event_id", ["value"], ts="ts").select("event_id", "value_last")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_read_samples_pipe_and_glob(spark):
    from quiver.sources.reader import read_samples
    one = read_samples(spark, f"{SF}/lineitem.parquet").count()
    two = read_samples(spark, f"{SF}/lineitem.parquet|{SF}/line{{item,xx}}.parquet").count()
    assert two == 2 * one


def test_holdout_paths():
    from quiver.operators.dataset import holdout_paths
    tr, ev = holdout_paths("/d/{20250917,20250918}/part-*|/e/20250918/*")
    assert tr == "/d/{20250917}/part-*|/e/{20250917}/*"
    assert ev == "/d/{20250918}/part-*|/e/{20250918}/*"


def test_check_schema_reports_bad_lengths(spark):
    from quiver.sources.reader import Field, check_schema
    df = spark.createDataFrame([([1, 2],), ([0] * 20,)], "a array<bigint>")
    rep = {r.field: r for r in check_schema(df, [Field("a", "bigint", 0, 20), Field("b", "bigint")]).collect()}
    assert rep["a"].n_bad_length == 1 and rep["a"].type_ok and not rep["b"].present


def test_sink_writes_partitioned(spark, tmp_path):
    from quiver.sources.sink import sample_by_hash, scored_rows, write_scored
    s = X.samples(spark, SF)
    out = scored_rows(s, {"roi1": ("roi1", "p")}, "eval", ["l_orderkey"], ["gmv"])
    write_scored(out, str(tmp_path / "scored"))
    back = spark.read.parquet(str(tmp_path / "scored"))
    assert back.count() == s.count() and back.select("dataset").distinct().first()[0] == "eval"
    k = sample_by_hash(s, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 0.1).count()
    assert 0 < k < s.count()


def test_serve_rejects_contract_violation(spark):
    from quiver.catalog.model_q import BUCKETS, LABELS, _features
    from quiver.plans import jobs
    from quiver.sources.reader import Field
    f = _features(spark, SF)
    model = jobs.train(f, BUCKETS, LABELS)
    ok = jobs.serve(model, f, [Field("b_price", "int"), Field("b_qty", "int")], list(LABELS))
    assert ok.count() == f.count()
    with pytest.raises(ValueError):
        jobs.serve(model, f, [Field("b_price", "bigint")], list(LABELS))


def test_running_totals_by_group_with_a_hot_group(spark):
    from quiver.plans.prefix import running_totals_by
    rng = np.random.default_rng(7)
    groups = np.where(rng.random(2000) < 0.7, "hot", rng.choice(["a", "b", "c"], 2000))
    keys = rng.permutation(2000).astype(float)
    vals = rng.normal(size=2000)
    df = spark.createDataFrame([(str(g), float(k), float(v)) for g, k, v in zip(groups, keys, vals)],
                               "g string, k double, v double")
    got = {(r.g, r.k): r.cum_v for r in running_totals_by(df, "g", "k", ["v"], n_buckets=9).collect()}
    for g in set(groups):
        idx = np.where(groups == g)[0]
        order = idx[np.argsort(keys[idx])]
        expect = np.cumsum(vals[order])
        assert np.allclose([got[(g, keys[i])] for i in order], expect)


def test_running_stats_log_every_keeps_full_statistics(spark):
    df = spark.createDataFrame([(i + 1, float(i % 7)) for i in range(100)], "step long, v double")
    full = {r.step: r.v_ema for r in running_stats(df, "step", ["v"], decay=0.9).collect()}
    logged = {r.step: r.v_ema for r in running_stats(df, "step", ["v"], decay=0.9, log_every=10).collect()}
    assert sorted(logged) == list(range(10, 101, 10))
    assert all(abs(logged[k] - full[k]) < 1e-12 for k in logged)


def test_assign_batch_by_rank(spark):
    from quiver.operators.dataset import assign_batch
    df = spark.createDataFrame([(k,) for k in [5, 9, 40, 41, 100, 101, 300]], "k long")
    got = {r.k: r.batch_id for r in assign_batch(df, 3, order_key="k").collect()}
    assert got == {5: 0, 9: 0, 40: 0, 41: 1, 100: 1, 101: 1, 300: 2}


def test_date_partitions_are_pruned(spark, tmp_path):
    from quiver.operators.dataset import date_holdout
    from quiver.sources.reader import read_samples
    s = X.samples(spark, SF).withColumn("p_date", F.date_format("l_shipdate", "yyyyMMdd"))
    s.filter("l_shipdate >= '2001-10-01'").write.partitionBy("p_date").parquet(str(tmp_path / "daily"))
    df = read_samples(spark, str(tmp_path / "daily"))
    picked = df.filter(F.col("p_date") == "20011015")
    plan = picked._sc._jvm.PythonSQLUtils.explainString(picked._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(p_date" in plan and "20011015" in plan
    held = date_holdout(df, "l_shipdate")
    last = s.filter("l_shipdate >= '2001-10-01'").agg(F.max(F.to_date("l_shipdate"))).first()[0]
    assert held.filter("split = 'eval'").count() == df.filter(F.to_date("l_shipdate") == F.lit(last)).count()


def test_fit_on_aggregated_rows_matches_row_level_fit(spark):
    from quiver.catalog.model_q import BUCKETS, LABELS, _features
    from quiver.plans.model import fit_two_tasks
    f = _features(spark, SF)
    agg = fit_two_tasks(f, BUCKETS, LABELS, max_iter=200)
    row = fit_two_tasks(f, BUCKETS, LABELS, max_iter=200, aggregate=False)
    for a, b in zip(agg.stages[2:], row.stages[2:]):
        assert np.allclose(a.coefficients.toArray(), b.coefficients.toArray(), atol=2e-3)
        assert abs(a.intercept - b.intercept) < 2e-3


def test_soft_buckets_are_computed_once(spark):
    """The weights' exponentials are taken once a row: named inside a lambda, they were taken again for every center and every element of a vector."""
    centers = np.linspace(0.0, 70.0, 120)
    df = spark.range(40).select((F.col("id") * 1.7).alias("x"))
    table = F.array(*[F.array(F.lit(float(c)), F.lit(1.0)) for c in centers])
    out = df.select("x", F.explode(F.array(T.soft_bucket_vector("x", T.bounds_literal(centers), table, 2))).alias("v"))
    assert out._jdf.queryExecution().analyzed().toString().lower().count("exp(") == 1
    for r in out.collect():
        w = np.exp(-np.abs(r.x - centers) / 0.8)
        assert np.allclose(r.v, [(w * centers).sum() / w.sum(), 1.0], rtol=1e-9)


def test_windows_from_sketches_need_no_row_a_window(spark, tmp_path):
    """Exact users of the last 24 and 72 hours against a loop, for a user with gaps, events without a user and without a time."""
    from datetime import datetime, timedelta

    from quiver.catalog.checks_q import x3_windows
    rows = [(i % 7 if i % 11 else None, datetime(2024, 1, 1) + timedelta(hours=i * i % 400) if i % 13 else None) for i in range(120)]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    out = x3_windows(spark, str(tmp_path))
    hours = {t for _, t in rows if t is not None}
    got = out.collect()
    assert len(got) == 2 * len(hours) and all(r.within for r in got)
    assert out._jdf.queryExecution().analyzed().toString().count("explode(sequence(") == 2    # the stored sketches' own, a few hours each
