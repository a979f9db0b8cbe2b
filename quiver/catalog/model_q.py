"""Model jobs (M1-M3, S12) and the streaming running stats."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from quiver.catalog import sqlbits as Q
from quiver.catalog.registry import query
from quiver.functions import labels as L
from quiver.functions.transforms import bucketize, compress
from quiver.plans import model as MD
from quiver.session import ensure_checkpoint_dir, round6
from quiver.sources import fixtures as X
from quiver.streaming.running_stats import running_stats_stream, run_to_table

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KS = ", ".join(KEYS)
W1 = np.array([[0.3], [-0.5], [1.2]])
B1 = np.array([-0.4])


def _features(spark, d, extra=()):
    s = X.samples(spark, d)
    return s.select(*KEYS, *extra, (compress("gmv") / 10.0).alias("x1"), (F.col("l_discount") * 10.0).alias("x2"),
                    F.col("p").alias("x3"), "convert_label", "roi1",
                    bucketize(compress("l_extendedprice"), (5.0, 8.0, 10.0, 10.5, 11.0)).alias("b_price"),
                    bucketize(F.col("l_quantity"), (5.0, 10.0, 20.0, 30.0, 40.0)).alias("b_qty"),
                    bucketize(F.col("l_discount"), (0.02, 0.05, 0.08)).alias("b_disc"),
                    L.binarize("roi1", L.clip("roi1")).alias("roi1_bin"))


@query("M1_score_dense_1layer", X.with_ctes(X.SAMPLES_SQL) + f"""
SELECT {KS}, {Q.r6(f"1.0 / (1.0 + exp(-({Q.compress('gmv')} / 10.0 * 0.3 + l_discount * 10.0 * -0.5 + p * 1.2 + -0.4)))")} AS score
FROM samples""")
def m1_linear(spark, d):
    f = _features(spark, d)
    out = MD.score_dense(f, ["x1", "x2", "x3"], [(W1, B1)], keep=KEYS)
    return out.select(*KEYS, round6(F.col("score")).alias("score"))


W2A = np.array([[0.5, -0.3], [-0.8, 0.6], [1.1, 0.4]])
B2A = np.array([0.1, -0.2])
W2B = np.array([[0.7], [-1.3]])
B2B = np.array([0.05])


def _m1_two_layer_sql() -> str:
    xs = [f"({Q.compress('gmv')} / 10.0)", "(l_discount * 10.0)", "p"]
    hid = []
    for k in range(2):
        z = " + ".join(f"{x} * {float(W2A[i, k])!r}" for i, x in enumerate(xs)) + f" + {float(B2A[k])!r}"
        hid.append(f"CASE WHEN ({z}) > 0 THEN ({z}) ELSE 0.2 * ({z}) END")
    out = " + ".join(f"({h}) * {float(W2B[k, 0])!r}" for k, h in enumerate(hid)) + f" + {float(B2B[0])!r}"
    return X.with_ctes(X.SAMPLES_SQL) + f"SELECT {KS}, {Q.r6(f'1.0 / (1.0 + exp(-({out})))')} AS score FROM samples"


@query("M1_score_dense_2layer", _m1_two_layer_sql())
def m1_two(spark, d):
    """M1 with one leaky-ReLU hidden layer (slope 0.2) and a sigmoid output."""
    f = _features(spark, d)
    out = MD.score_dense(f, ["x1", "x2", "x3"], [(W2A, B2A), (W2B, B2B)], keep=KEYS)
    return out.select(*KEYS, round6(F.col("score")).alias("score"))


@query("M1_score_dense_tower")
def m1_tower(spark, d):
    f = _features(spark, d)
    layers = MD.init_weights(3, MD.TOWER, seed=9431)
    out = MD.score_dense(f, ["x1", "x2", "x3"], layers, keep=KEYS)
    return out.select(*KEYS, round6(F.col("score")).alias("score"))


BUCKETS = ["b_price", "b_qty", "b_disc"]
LABELS = {"convert": "convert_label", "roi1": "roi1_bin"}


@query("M2_fit_two_tasks")
def m2(spark, d):
    """Fitted coefficients per task (one row per task and one-hot slot)."""
    f = _features(spark, d)
    model = MD.fit_two_tasks(f, BUCKETS, LABELS)
    rows = []
    for st in model.stages[2:]:
        task = st.getPredictionCol().removeprefix("pred_")
        rows += [(task, i, float(c)) for i, c in enumerate(st.coefficients.toArray())]
        rows.append((task, -1, float(st.intercept)))
    return spark.createDataFrame(rows, "task string, slot int, coefficient double")


@query("M3_predict")
def m3(spark, d):
    f = _features(spark, d)
    model = MD.fit_two_tasks(f, BUCKETS, LABELS)
    return MD.predict(model, f, list(LABELS), keep=KEYS)


@query("S12_save_load_model")
def s12(spark, d):
    f = _features(spark, d)
    model = MD.fit_two_tasks(f, BUCKETS, LABELS)
    path = f"{ensure_checkpoint_dir(spark)}/models/two-tasks-{uuid.uuid4().hex}"
    MD.save_model(model, path)
    return MD.predict(MD.load_model(path), f, list(LABELS), keep=KEYS)


T1_SQL = X.with_ctes(X.EVENTS_HOURLY_SQL) + f"""
SELECT 'v' AS metric, step, {Q.r6('v')} AS value,
       {Q.r6('avg(v) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS mean,
       {Q.r6('(1 - 0.99) * pow(0.99, step) * sum(v * pow(0.99, -step)) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS ema
FROM events_hourly"""


@query("T1_running_stats_stream", T1_SQL)
def t1(spark, d):
    """A17 as a stream: hourly metrics land as Parquet files in the shared
    folder, with the steps dealt over the files, a file stream feeds the
    stateful operator one file a batch, results append to a Parquet table that
    is read back."""
    base = f"{ensure_checkpoint_dir(spark)}/streams/running-{uuid.uuid4().hex}"
    hourly = X.events_hourly(spark, d).select(F.lit("v").alias("metric"), "step", F.col("v").alias("value"))
    hourly.repartition(4, "step").write.mode("overwrite").parquet(f"{base}/in")
    src = (spark.readStream.schema("metric string, step long, value double")
           .option("maxFilesPerTrigger", 1).parquet(f"{base}/in"))
    run_to_table(running_stats_stream(src, decay=0.99), f"{base}/out", f"{base}/chk")
    out = spark.read.parquet(f"{base}/out")
    return out.select("metric", "step", round6(F.col("value")).alias("value"), round6(F.col("mean")).alias("mean"),
                      round6(F.col("ema")).alias("ema"))


@query("J1_train_evaluate")
def j1(spark, d):
    """Train on all years but the last, evaluate on the last (S8 by year):
    the evaluation report (46 values) of the fitted per-task models."""
    from quiver.operators.dataset import date_holdout
    from quiver.plans import jobs
    f = date_holdout(_features(spark, d, extra=["l_shipdate"]), "l_shipdate", unit="year")
    tr, ev = f.filter(F.col("split") == "train"), f.filter(F.col("split") == "eval")
    model = jobs.train(tr, BUCKETS, LABELS)
    _, report = jobs.evaluate(model, ev, LABELS, {"convert": "convert_label", "roi1": "roi1"},
                              KEYS, ["convert_label", "roi1"])
    return report.select("task", "metric", round6(F.col("value")).alias("value"))
