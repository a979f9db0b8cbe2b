"""Edge rows from FIXTURES.md: NULL, NaN, -1, 0, boundary values, values above
the last bound, empty classes and segments, fully masked sequences, arrays
shorter or longer than 20; and reference-mode vs corrected pairs."""

import math

import pytest
from pyspark.sql import functions as F

from quiver.functions import arrays as A
from quiver.functions import labels as L
from quiver.functions import losses as E
from quiver.functions import segments as G
from quiver.functions import transforms as T
from quiver.plans import metrics as M


def one(spark, expr, schema="x double", rows=((1.0,),)):
    df = spark.createDataFrame(list(rows), schema)
    return [r[0] for r in df.select(expr.alias("o")).collect()]


def test_bucketize_edges(spark):
    bounds = [0.0, 1.0, 2.0]
    rows = [(None,), (float("nan"),), (-1.0,), (0.0,), (1.0,), (1.5,), (2.0,), (99.0,)]
    got = one(spark, T.bucketize("x", bounds), rows=rows)
    assert got == [0, 3, 0, 1, 2, 2, 3, 3]


def test_compress_clamps_and_defaults(spark):
    got = one(spark, T.compress("x"), rows=[(None,), (-5.0,), (0.0,), (math.e - 1,)])
    assert got[:3] == [0.0, 0.0, 0.0] and abs(got[3] - 1.0) < 1e-12
    assert one(spark, T.compress("x", log=False), rows=[(-2.0,), (3.0,)]) == [0.0, 3.0]


def test_signed_delta_modes(spark):
    df = spark.createDataFrame([(1.0, 3.0), (3.0, 1.0), (2.0, 2.0)], "a double, b double")
    ref = [r[0] for r in df.select(T.signed_delta("a", "b")).collect()]
    sym = [r[0] for r in df.select(T.signed_delta("a", "b", "symmetric")).collect()]
    assert ref[0] == pytest.approx(-math.log1p(2.0)) and ref[1] == 0.0 and ref[2] == 0.0
    assert math.copysign(1.0, ref[2]) == 1.0          # no -0.0
    assert sym[0] == pytest.approx(math.log1p(2.0)) and sym[1] == pytest.approx(-math.log1p(2.0))


def test_log_ratio_sentinel(spark):
    df = spark.createDataFrame([(-1.0, 5.0), (5.0, -1.0), (3.0, 1.0)], "a double, b double")
    got = [r[0] for r in df.select(T.log_ratio("a", "b")).collect()]
    assert got[0] == -1.0 and got[1] == -1.0 and got[2] == pytest.approx(math.log(4) - math.log(2))


def test_labels(spark):
    rows = [(-3.0,), (0.0,), (0.5,), (1.0,), (100.0,), (400.0,)]
    assert one(spark, L.clip("x"), rows=rows) == [0.0, 0.0, 0.5, 1.0, 100.0, 300.0]
    assert one(spark, L.binarize("convert", "x"), rows=rows) == [0, 0, 1, 1, 1, 1]
    assert one(spark, L.binarize("roi1", "x"), rows=rows) == [0, 0, 0, 1, 1, 1]
    lt = one(spark, L.log_tail("x"), rows=rows)
    assert lt[4] == 100.0 and lt[5] == pytest.approx(100 + math.log(301.0))
    assert one(spark, L.label_weight("x"), rows=rows) == [1.0, 1.0, 1.0, 1.0, 100.0, 400.0]


def test_reward_v2_reference_slip(spark):
    keys = {"high_and_control": 4, "high_and_treat": 5, "medium_and_control": 2, "medium_and_treat": 3}
    df = spark.createDataFrame([(10.0, 4, 0.0), (10.0, 2, 0.0), (10.0, 5, 2.0)], "r double, lv int, ratio double")
    fixed = [r[0] for r in df.select(L.shape_reward_v2("r", "lv", "ratio", keys)).collect()]
    ref = [r[0] for r in df.select(L.shape_reward_v2("r", "lv", "ratio", keys, mode="reference")).collect()]
    assert fixed == pytest.approx([1.0, 1.0, 8.0])
    assert ref == pytest.approx([10.0, 0.1, 8.0])     # high empty run untouched, medium scaled twice


def test_binarize_reward_rejects_unsorted():
    with pytest.raises(ValueError):
        L.binarize_reward("r", "l", {"high": 0, "medium": 1}, thresholds=(20.0, 10.0))


def test_positive_weight_unknown_task():
    with pytest.raises(ValueError):
        L.positive_weight("clicks", "a")


def test_segments(spark):
    df = spark.createDataFrame([(1,), (3,), (4,), (7,)], "x int")
    part, thr = G.partition_by_list("x", [(1, 2), 3, (3, 4)], [1.0, 1.1, 1.2, 1.3])
    got = df.select(part, thr).collect()
    assert [r[0] for r in got] == [1, 3, 3, 0] and [r[1] for r in got] == [1.1, 1.3, 1.3, 1.0]
    lv, _ = G.partition_by_level("x", [25.0, 13.0], [1.0, 1.2, 1.5])
    df2 = spark.createDataFrame([(5.0,), (20.0,), (30.0,)], "x double")
    assert [r[0] for r in df2.select(lv).collect()] == [2, 1, 0]
    with pytest.raises(ValueError):
        G.partition_by_level("x", [25, 13], [1.0, 1.2, 1.5])


def test_level_treatment_modes(spark):
    df = spark.createDataFrame([(5.0, 0), (5.0, 1), (20.0, 0), (50.0, 1), (5.0, 7)], "x double, t int")
    fixed = df.select(G.partition_level_treatment("x", [10.0, 30.0], "t", [0, 1])).collect()
    ref = df.select(G.partition_level_treatment("x", [10.0, 30.0], "t", [0, 1], mode="reference")).collect()
    assert [r[0] for r in fixed] == [0, 1, 2, 5, 0]
    assert [r[0] for r in ref] == [2, 3, 2, 5, 0]       # first level lost to the second cut


def test_losses_clamp(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (1.0, 0.5)], "y double, p double")
    ce = [r[0] for r in df.select(E.cross_entropy("y", "p")).collect()]
    assert all(v is not None and math.isfinite(v) for v in ce)
    assert ce[2] == pytest.approx(math.log(2))
    assert E.parse_loss_names("weighted_cross_entropy, focal_loss") == ["weighted_cross_entropy", "focal_loss"]
    with pytest.raises(ValueError):
        E.parse_loss_names("zlin")


def test_huber_and_logits(spark):
    df = spark.createDataFrame([(0.0, 0.5), (0.0, 3.0)], "y double, p double")
    h = [r[0] for r in df.select(E.huber("y", "p")).collect()]
    assert h == pytest.approx([0.125, 2.5])
    z = spark.createDataFrame([(0.0, 0.0), (2.0, 0.0)], "y double, z double")
    w = [r[0] for r in z.select(E.weighted_ce_logits("y", "z")).collect()]
    assert w == pytest.approx([math.log(2), 3 * math.log(2)])


def test_fixed_length(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,), ([float(i) for i in range(25)],)], "a array<double>")
    got = [r[0] for r in df.select(A.fixed_length("a", 20, 0.0)).collect()]
    assert got[0] == [1.0, 2.0] + [0.0] * 18 and got[1] == [0.0] * 20 and got[2] == [float(i) for i in range(20)]


def test_masked_ops_fully_masked(spark):
    df = spark.createDataFrame([([1.0, 2.0], [False, False])], "l array<double>, m array<boolean>")
    assert df.select(A.masked_softmax("l", "m")).first()[0] == [0.0, 0.0]
    seqs = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [False, False]), ([[1.0, 2.0], [3.0, 4.0]], [True, False])],
                                 "s array<array<double>>, m array<boolean>")
    pooled = [r[0] for r in seqs.select(A.masked_mean_pool_one("s", "m", 2)).collect()]
    assert pooled == [[0.0, 0.0], [1.0, 2.0]]


def test_softmax_sums_to_one(spark):
    df = spark.createDataFrame([([0.5, 2.0, -1.0], [True, True, True])], "l array<double>, m array<boolean>")
    w = df.select(A.masked_softmax("l", "m")).first()[0]
    assert sum(w) == pytest.approx(1.0, abs=1e-5)


def test_small_metric_edges(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0), (0.0, 0.0, 0.0)], "pred double, label double, mask double")
    r = df.agg(M.accuracy("pred", "label", "mask").alias("a"), M.recall("pred", "label").alias("r"),
               M.precision(F.lit(0.0), "label").alias("p")).first()
    assert (r.a, r.r, r.p) == (1.0, 1.0, 1.0)


def test_time_delta_ratio_reference_slip(spark):
    from quiver.operators.derive import time_delta_ratio
    df = spark.createDataFrame([(3.0, 6.0, 14.0)], "a double, b double, c double")
    ref, _ = time_delta_ratio(df, ["a", "b", "c"], [1.0, 3.0, 7.0], "n", mode="reference")
    fix, _ = time_delta_ratio(df, ["a", "b", "c"], [1.0, 3.0, 7.0], "n")
    r, f = ref.first(), fix.first()
    assert r.ratio_n_1 == pytest.approx(math.log1p(3.0) - math.log1p(1.0))   # reuses a
    assert f.ratio_n_1 == pytest.approx(math.log1p(3.0) - math.log1p(2.0))


def test_horizon_deltas_skip_without_advance(spark):
    from quiver.operators.derive import horizon_deltas
    df = spark.createDataFrame([(1.0, 6.0, 12.0, -1.0)], "m_1h_k_all double, m_3h_k_all double, m_6h_k_all double, m_12h_k_all double")
    specs = {"m_1_6h_k_all": [0.0], "m_6_12h_k_all": [0.0]}       # no bounds for 1->3
    out, made = horizon_deltas(df, {"m": [1, 3, 6, 12]}, "k", specs)
    assert made == ["m_1_6h_k_all", "m_6_12h_k_all"]
    row = out.first()
    assert row.m_1_6h_k_all == pytest.approx(-math.log1p(1.0)) and row.m_6_12h_k_all == -1.0
