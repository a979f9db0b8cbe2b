"""Operators whose values SQL can't compute, through properties that it can:
bounds, counts, label-side metrics, the equations a fitted model solves, and
hash slots by a hash that both engines have."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quiver.catalog import sqlbits as Q
from quiver.catalog.metrics_q import _a16_sql
from quiver.catalog.model_q import BUCKETS, KEYS, LABELS, _features, j1
from quiver.catalog.registry import query
from quiver.operators import features as FT
from quiver.operators import horizons as H
from quiver.plans import model as MD
from quiver.plans.prefix import running_totals
from quiver.session import cut_lineage, ensure_checkpoint_dir, table
from quiver.sources import fixtures as X
from quiver.sources.sink import sample_by_hash

#: Five standard errors of the sketch (hundreds of hours are compared), and two for rounding of small counts.
APPROX_SHARE, APPROX_LEAST = 0.25, 2


@query("X3_approx_within_bound", """
SELECT DISTINCT epoch_us(ts) // 3600000000 AS hour_id, true AS within FROM events""")
def x3(spark, d):
    ev = table(spark, d, "events")
    approx = H.entities_per_hour(ev, "ts", "user_id", approx=True).withColumnRenamed("n_entities", "approx")
    both = H.entities_per_hour(ev, "ts", "user_id").join(approx, "hour_id")
    return both.select("hour_id", (F.abs(F.col("approx") - F.col("n_entities")) <= F.greatest(
        F.lit(float(APPROX_LEAST)), F.col("n_entities") * APPROX_SHARE)).alias("within"))


WINDOWS = (24, 72)   # hours


@query("X3_windows_from_stored_sketches", """
SELECT DISTINCT epoch_us(ts) // 3600000000 AS hour_id, w.h AS hours, true AS within FROM events, (VALUES (24), (72)) w(h)""")
def x3_windows(spark, d):
    """Distinct users of the last 24 and 72 hours from a stored table of hourly sketches, within five standard errors of exact counts."""
    ev = table(spark, d, "events").select("ts", "user_id")
    path = f"{ensure_checkpoint_dir(spark)}/sketches-{uuid.uuid4().hex}"
    H.entity_sketches(ev, "ts", "user_id").write.parquet(path)
    stored = spark.read.parquet(path)
    hour = F.floor(H.epoch_micros("ts") / F.lit(H.HOUR_US)).cast("bigint")
    own = ev.select(hour.alias("hour_id"), "user_id").filter("hour_id is not null").distinct()
    # a user is in the windows that end from an hour of theirs to h - 1 hours on, or to the hour before their next one: a step up and a step down
    following = F.lead("hour_id").over(Window.partitionBy("user_id").orderBy("hour_id"))
    step = lambda at, **by: F.struct(at.alias("hour_id"), *[F.lit(by.get(f"d{h}", 0)).cast("long").alias(f"d{h}") for h in WINDOWS])
    ends = [step(F.least(F.col("hour_id") + h, F.col("next")), **{f"d{h}": -1}) for h in WINDOWS]
    steps = F.when(F.col("user_id").isNull(), F.array(step(F.col("hour_id")))).otherwise(F.array(step(F.col("hour_id"), **{f"d{h}": 1 for h in WINDOWS}), *ends))
    changes = own.withColumn("next", following).select(F.explode(steps).alias("s")).select("s.*").groupBy("hour_id").agg(
        *[F.sum(f"d{h}").alias(f"d{h}") for h in WINDOWS])
    exact = running_totals(cut_lineage(changes), "hour_id", [f"d{h}" for h in WINDOWS])
    out = []
    for h in WINDOWS:
        both = H.entities_in_windows(stored, h).join(exact.select("hour_id", F.col(f"cum_d{h}").alias("exact")), "hour_id")
        out.append(both.select("hour_id", F.lit(h).alias("hours"), (F.abs(F.col("n_entities") - F.col("exact")) <= F.greatest(
            F.lit(1.0), F.col("exact") * 5 * 0.83 / 64)).alias("within")))
    return out[0].unionByName(out[1])


@query("S10_sampled_by_md5", """
SELECT c_custkey, c_name FROM customer
WHERE ('0x' || substr(md5(concat_ws('|', c_custkey, c_name)), 1, 8))::BIGINT % 1000 < 100""")
def s10(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return sample_by_hash(c, ["c_custkey", "c_name"], 0.1, portable=True)


@query("P20_hash_slot_md5", """
SELECT ('0x' || substr(md5(c_name), 1, 8))::BIGINT % 97 AS slot, count(*) AS n FROM customer GROUP BY 1""")
def p20(spark, d):
    c = table(spark, d, "customer")
    return c.select(FT.hash_slot("c_name", 97, portable=True).alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))


BUCKET_SQL = {"b_price": Q.bucket(Q.compress("l_extendedprice"), (5.0, 8.0, 10.0, 10.5, 11.0)),
              "b_qty": Q.bucket("l_quantity", (5.0, 10.0, 20.0, 30.0, 40.0)), "b_disc": Q.bucket("l_discount", (0.02, 0.05, 0.08))}


@query("M2_score_equations", f"""
SELECT name, task, bucket, true AS solved FROM (VALUES ('convert'), ('roi1')) t(task), (
  {' UNION '.join(f"SELECT '{b}' AS name, {BUCKET_SQL[b]} AS bucket FROM lineitem" for b in BUCKETS)})""")
def m2(spark, d):
    """At the optimum of an unpenalised logistic model the weighted sum of
    labels equals that of predictions in every bucket of every feature."""
    f = _features(spark, d)
    model = MD.fit_two_tasks(f, BUCKETS, LABELS, max_iter=200)
    scored = MD.predict(model, f, list(LABELS), keep=[*BUCKETS, *LABELS.values()])
    rows = F.array(*[F.struct(F.lit(b).alias("name"), F.lit(t).alias("task"), F.col(b).cast("int").alias("bucket"),
                              F.when(F.col(y) > 0, 2.0).otherwise(1.0).alias("w"),
                              F.col(y).cast("double").alias("y"), F.col(f"score_{t}").alias("p"))
                     for b in BUCKETS for t, y in LABELS.items()])
    per = scored.select(F.explode(rows).alias("r")).select("r.*").groupBy("name", "task", "bucket").agg(
        F.sum(F.col("w") * (F.col("y") - F.col("p"))).alias("off"), F.sum("w").alias("all"))
    return per.select("name", "task", "bucket", (F.abs("off") <= F.col("all") * 1e-3).alias("solved"))


@query("M3_prediction_bounds", "SELECT " + ", ".join(KEYS) + ", true AS valid FROM lineitem")
def m3(spark, d):
    f = _features(spark, d)
    p = MD.predict(MD.fit_two_tasks(f, BUCKETS, LABELS), f, list(LABELS), keep=KEYS)
    ok = [F.col(f"score_{t}").between(0.0, 1.0) for t in LABELS]
    return p.select(*KEYS, (ok[0] & ok[1]).alias("valid"))


@query("S12_reload_changes_nothing", "SELECT count(*) AS n, 0::BIGINT AS changed FROM lineitem")
def s12(spark, d):
    f = _features(spark, d).withColumn("_row", F.monotonically_increasing_id())
    model = MD.fit_two_tasks(f, BUCKETS, LABELS)
    path = f"{ensure_checkpoint_dir(spark)}/models/two-tasks-{uuid.uuid4().hex}"
    MD.save_model(model, path)
    scores = [F.col(f"score_{t}") for t in LABELS]
    one, two = (MD.predict(m, f, list(LABELS), keep=BUCKETS).select(*BUCKETS, *scores).distinct() for m in (model, MD.load_model(path)))
    changed = one.exceptAll(two).count() + two.exceptAll(one).count()
    return f.agg(F.count(F.lit(1)).alias("n")).withColumn("changed", F.lit(changed).cast("long"))


LABEL_SIDE = ("reg_label_mean", "binary_label_mean", "label_mean")


@query("J1_label_side_metrics", "SELECT * FROM (" + _a16_sql().replace(X.SAMPLES_SQL, X.SAMPLES_SQL.replace(
    "samples AS (", "all_samples AS (", 1) + """,
samples AS (SELECT * FROM all_samples WHERE year(l_shipdate) = (SELECT max(year(l_shipdate)) FROM all_samples))""")
       + f") WHERE metric IN {LABEL_SIDE}")
def j1_labels(spark, d):
    return j1(spark, d).filter(F.col("metric").isin(*LABEL_SIDE))
