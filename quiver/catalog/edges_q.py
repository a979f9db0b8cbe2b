"""Operators on rows with missing keys, times, scores and labels, with ties, and
with labels of many levels: what they do with such rows is part of the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiver.catalog import sqlbits as Q
from quiver.catalog.metrics_q import PAIR_SQL, SD, TASKS, _a16_sql
from quiver.catalog.registry import query
from quiver.operators import horizons as H
from quiver.plans import metrics as M
from quiver.plans.prefix import running_totals
from quiver.session import round6, table
from quiver.sources import fixtures as X
from quiver.sources.reader import Field, conform

HOUR = 3_600_000_000

ODD_SQL = f"""WITH odd AS (SELECT event_id, value, event_type,
    CASE WHEN event_id % 19 = 0 THEN NULL ELSE user_id END AS user_id,
    CASE WHEN event_id % 23 = 0 THEN NULL ELSE epoch_us(ts) // {HOUR} * {HOUR} END AS us FROM events)
"""


def odd_events(spark, d):
    """Events with times cut to the hour (ties), some without a user, some without a time."""
    ev = table(spark, d, "events").withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return ev.select("event_id", "value", "event_type",
                     F.when(F.col("event_id") % 19 != 0, F.col("user_id")).alias("user_id"),
                     F.when(F.col("event_id") % 23 != 0, F.col("ts")).alias("ts"))


def _x1_sql() -> str:
    out = []
    for h in X.HORIZONS:
        frame = f"OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {h * HOUR} PRECEDING AND CURRENT ROW)"
        out += [f"CASE WHEN us IS NULL THEN NULL ELSE count(*) {frame} END AS cnt_{h}h",
                f"CASE WHEN us IS NULL THEN NULL ELSE {Q.r6(f'sum(value) {frame}')} END AS value_sum_{h}h"]
    return ODD_SQL + "SELECT event_id, user_id, " + ", ".join(out) + " FROM odd"


@query("X1_multi_horizon_odd_rows", _x1_sql())
def x1(spark, d):
    h = H.multi_horizon(odd_events(spark, d), "user_id", "ts", X.HORIZONS, value_cols=["value"])
    out = [F.col("event_id"), F.col("user_id")]
    for hh in X.HORIZONS:
        out += [F.col(f"cnt_{hh}h"), round6(F.col(f"value_sum_{hh}h")).alias(f"value_sum_{hh}h")]
    return h.select(*out)


@query("X2_cumulative_in_day_odd_rows", ODD_SQL + f"""
SELECT event_id, CASE WHEN us IS NULL THEN NULL ELSE count(*) OVER w END AS cum_cnt_day,
       CASE WHEN us IS NULL THEN NULL ELSE {Q.r6('sum(value) OVER w')} END AS cum_value_day
FROM odd WINDOW w AS (PARTITION BY user_id, us // 86400000000 ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def x2(spark, d):
    out = H.cumulative_in_day(odd_events(spark, d), "user_id", "ts", ["value"])
    return out.select("event_id", "cum_cnt_day", round6(F.col("cum_value_day")).alias("cum_value_day"))


@query("X5_previous_value_odd_rows", ODD_SQL + """
SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY us NULLS FIRST, event_id) AS value_last FROM odd""")
def x5(spark, d):
    out = H.previous_value(odd_events(spark, d), "user_id", "event_id", ["value"], ts="ts", slice_minutes=360)
    return out.select("event_id", "value_last")


@query("S7_rank_with_null_keys", """
SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_id % 9973 = 0 THEN NULL ELSE event_id END NULLS FIRST) AS rank FROM events""")
def s7(spark, d):
    """Ranks over more range buckets than compiled comparisons go to, with a key that is NULL."""
    ev = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 9973 != 0, F.col("event_id")).alias("k"))
    return running_totals(ev, "k", [], n_buckets=200, with_count="rank").select("event_id", "rank")


@query("A7_pairwise_auc_continuous", f"""
WITH s AS (SELECT (event_id * 7919 % 1009) / 1009.0::DOUBLE AS p, value AS label FROM events WHERE value IS NOT NULL)
SELECT {Q.r6(f"sum({PAIR_SQL}) / count(*)")} AS auc FROM s a JOIN s b ON a.label > b.label""")
def a7(spark, d):
    """A label with (nearly) as many levels as rows."""
    s = table(spark, d, "events").select((F.col("event_id") * 7919 % 1009 / F.lit(1009.0)).alias("p"), F.col("value").alias("label"))
    return M.pairwise_auc(s, "p", "label").select(round6(F.col("auc")).alias("auc"))


@query("A7_pairwise_auc_hot_score", f"""
WITH s AS (SELECT CASE WHEN event_id % 5 < 2 THEN 0.25 ELSE (event_id * 7919 % 1009) / 1009.0 END::DOUBLE AS p, value AS label FROM events WHERE value IS NOT NULL)
SELECT {Q.r6(f"sum({PAIR_SQL}) / count(*)")} AS auc FROM s a JOIN s b ON a.label > b.label""")
def a7hot(spark, d):
    """Two fifths of the rows share a score and have labels of nearly as many levels."""
    p = F.when(F.col("event_id") % 5 < 2, F.lit(0.25)).otherwise(F.col("event_id") * 7919 % 1009 / F.lit(1009.0))
    s = table(spark, d, "events").select(p.alias("p"), F.col("value").alias("label"))
    return M.pairwise_auc(s, "p", "label").select(round6(F.col("auc")).alias("auc"))


BATCH_SQL = f"""
WITH s AS (SELECT event_id // 512 AS batch_id, (event_id * 7919 % 1009) / 1009.0::DOUBLE AS p, value AS label FROM events),
bs AS (SELECT DISTINCT batch_id FROM s),
pr AS (SELECT a.batch_id, sum({PAIR_SQL}) AS conc, count(*) AS pairs FROM s a JOIN s b ON a.batch_id = b.batch_id AND a.label > b.label GROUP BY 1)
SELECT bs.batch_id, {Q.r6('coalesce(conc / pairs, 1.0)')} AS auc FROM bs LEFT JOIN pr ON bs.batch_id = pr.batch_id"""


def _event_batches(spark, d):
    p = F.col("event_id") * 7919 % 1009 / F.lit(1009.0)
    return table(spark, d, "events").select(F.floor(F.col("event_id") / 512).cast("bigint").alias("batch_id"), p.alias("p"), F.col("value").alias("label"))


@query("A7_pairwise_auc_in_batches_continuous", BATCH_SQL)
def a7bc(spark, d):
    """Batches of 512 rows whose labels have nearly as many levels as rows."""
    out = M.pairwise_auc_in_batches(_event_batches(spark, d), "p", "label", "batch_id")
    return out.select("batch_id", round6(F.col("auc")).alias("auc"))


@query("A7_pairwise_auc_in_large_batches", BATCH_SQL)
def a7bl(spark, d):
    """The same batches counted in ranges of scores and labels, as those too large for a task are."""
    out = M.pairwise_auc_in_batches(_event_batches(spark, d), "p", "label", "batch_id", batch_rows=100)
    return out.select("batch_id", round6(F.col("auc")).alias("auc"))


@query("A7_pairwise_auc_null_batch", SD + f"""
, s AS (SELECT CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id // 64 END AS batch_id, p, label FROM scored_docs),
bs AS (SELECT DISTINCT batch_id FROM s),
pr AS (SELECT a.batch_id, sum({PAIR_SQL}) AS conc, count(*) AS pairs
       FROM s a JOIN s b ON a.batch_id IS NOT DISTINCT FROM b.batch_id AND a.label > b.label GROUP BY 1)
SELECT bs.batch_id, {Q.r6('coalesce(conc / pairs, 1.0)')} AS auc
FROM bs LEFT JOIN pr ON bs.batch_id IS NOT DISTINCT FROM pr.batch_id""")
def a7n(spark, d):
    s = X.scored_docs(spark, d).withColumn(
        "batch_id", F.when(F.col("doc_id") % 5 != 0, F.floor(F.col("doc_id") / 64).cast("bigint")))
    out = M.pairwise_auc_in_batches(s, "p", "label", "batch_id")
    return out.select("batch_id", round6(F.col("auc")).alias("auc"))


@query("A16_evaluation_report_null_scores", _a16_sql().replace(X.SAMPLES_SQL, X.SAMPLES_SQL.replace(
    "samples AS (", "all_samples AS (", 1) + ",\nsamples AS (SELECT * FROM all_samples WHERE l_orderkey % 17 <> 0)"))
def a16(spark, d):
    """Rows without a score take no part: the report equals that of the others."""
    s = X.samples(spark, d).withColumn("p", F.when(F.col("l_orderkey") % 17 != 0, F.col("p")))
    rep = M.evaluation_report(s, TASKS)
    return rep.select("task", "metric", round6(F.col("value")).alias("value"))


@query("S2_conform_element_types", X.with_ctes(X.SEQ_VAR_SQL) + """
SELECT user_id, list_resize(value_raw, 20, 0.5::DOUBLE) AS doubles,
       list_resize(list_transform(value_raw, lambda v: v::FLOAT), 20, 0::FLOAT) AS floats,
       list_resize(list_transform(value_raw, lambda v: floor(v)::BIGINT::VARCHAR), 20, 'none') AS strings FROM seq_var""")
def s2(spark, d):
    s = X.seq_var(spark, d).select(
        "user_id", F.col("value_raw").alias("doubles"), F.col("value_raw").alias("floats"),
        F.transform("value_raw", lambda v: F.floor(v).cast("bigint").cast("string")).alias("strings"))
    spec = [Field("doubles", "double", 0.5, 20), Field("floats", "float", 0, 20), Field("strings", "string", "none", 20)]
    return conform(s, spec, keep=["user_id"])
