"""Multi-horizon counters (X1-X5) and running statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quiver.catalog import sqlbits as Q
from quiver.catalog.registry import query
from quiver.functions.transforms import compress
from quiver.operators import horizons as H
from quiver.plans.quantiles import exact_quantiles, exact_quantiles_by
from quiver.plans.running import running_stats
from quiver.session import ensure_checkpoint_dir, round6, table
from quiver.sources import fixtures as X
from quiver.streaming.horizon_counters import multi_horizon_stream
from quiver.streaming.running_stats import run_to_table

HS = X.HORIZONS


def _x1_sql() -> str:
    cols = []
    for h in HS:
        frame = (f"OVER (PARTITION BY user_id ORDER BY epoch_us(ts) "
                 f"RANGE BETWEEN {h * 3_600_000_000} PRECEDING AND CURRENT ROW)")
        cols.append(f"count(*) {frame} AS cnt_{h}h")
        cols.append(f"{Q.r6(f'sum(value) {frame}')} AS value_sum_{h}h")
    return "SELECT event_id, user_id, " + ", ".join(cols) + " FROM events"


@query("X1_multi_horizon", _x1_sql())
def x1(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    h = H.multi_horizon(ev, "user_id", "ts", HS, value_cols=["value"])
    out = [F.col("event_id"), F.col("user_id")]
    for hh in HS:
        out += [F.col(f"cnt_{hh}h"), round6(F.col(f"value_sum_{hh}h")).alias(f"value_sum_{hh}h")]
    return h.select(*out)


@query("X1_multi_horizon_6h_buckets", _x1_sql())
def x1_fine(spark, d):
    """Same counters with 6-hour partitions (a hot user split 4x finer)."""
    ev = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    h = H.multi_horizon(ev, "user_id", "ts", HS, value_cols=["value"], bucket_hours=6)
    out = [F.col("event_id"), F.col("user_id")]
    for hh in HS:
        out += [F.col(f"cnt_{hh}h"), round6(F.col(f"value_sum_{hh}h")).alias(f"value_sum_{hh}h")]
    return h.select(*out)


@query("X1_multi_horizon_stream", _x1_sql())
def x1_stream(spark, d):
    """X1 as a stream: the events land in files in no order of time, a file a batch, then an event far
    ahead moves the watermark past all others. The finished counters are appended to a table that is read back."""
    base = f"{ensure_checkpoint_dir(spark)}/streams/horizons-{uuid.uuid4().hex}"
    ev = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    ev.repartition(3, F.xxhash64("event_id")).write.mode("overwrite").parquet(f"{base}/in")
    ahead = ev.agg((F.max("ts") + F.expr("interval 4000 days")).alias("ts")).select(*[F.col(c) if c == "ts" else F.lit(None).cast(ev.schema[c].dataType).alias(c) for c in ev.columns])
    ahead.coalesce(1).write.mode("append").parquet(f"{base}/in")
    src = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    run_to_table(multi_horizon_stream(src, "user_id", "ts", HS, ["value"], delay="2000 days"), f"{base}/out", f"{base}/chk")
    h = spark.read.parquet(f"{base}/out").filter("not late")
    out = [F.col("event_id"), F.col("user_id")]
    for hh in HS:
        out += [F.col(f"cnt_{hh}h"), round6(F.col(f"value_sum_{hh}h")).alias(f"value_sum_{hh}h")]
    return h.select(*out)


@query("X2_cumulative_in_day", f"""
SELECT event_id, count(*) OVER w AS cum_cnt_day, {Q.r6('sum(value) OVER w')} AS cum_value_day
FROM events WINDOW w AS (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY epoch_us(ts)
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def x2(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    out = H.cumulative_in_day(ev, "user_id", "ts", ["value"])
    return out.select("event_id", "cum_cnt_day", round6(F.col("cum_value_day")).alias("cum_value_day"))


@query("X2_cumulative_in_day_5min_slices", f"""
SELECT event_id, count(*) OVER w AS cum_cnt_day, {Q.r6('sum(value) OVER w')} AS cum_value_day
FROM events WINDOW w AS (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY epoch_us(ts)
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def x2_fine(spark, d):
    """X2 with a hot key-day cut into 5-minute slices (same result)."""
    ev = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    out = H.cumulative_in_day(ev, "user_id", "ts", ["value"], slice_minutes=5)
    return out.select("event_id", "cum_cnt_day", round6(F.col("cum_value_day")).alias("cum_value_day"))


@query("X3_entities_per_hour", """
SELECT epoch_us(ts) // 3600000000 AS hour_id, count(DISTINCT user_id) AS n_entities FROM events GROUP BY 1""")
def x3(spark, d):
    return H.entities_per_hour(table(spark, d, "events"), "ts", "user_id")


X4_PROBS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


@query("X4_fit_bounds", X.with_ctes(X.SAMPLES_SQL) + f"""
SELECT unnest([{', '.join(repr(p) for p in X4_PROBS)}]::DOUBLE[]) AS prob,
       unnest(list_transform(quantile_cont({Q.compress('l_extendedprice')}, [{', '.join(repr(p) for p in X4_PROBS)}]::DOUBLE[]),
                             lambda v: {Q.r6('v')})) AS value
FROM samples""")
def x4(spark, d):
    s = X.samples(spark, d).select(compress("l_extendedprice").alias("x"))
    q = exact_quantiles(s, "x", X4_PROBS)
    return q.select("prob", round6(F.col("value")).alias("value"))


@query("X5_previous_value_hour_slices", """
SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS value_last FROM events""")
def x5_fine(spark, d):
    """X5 with a hot key cut into one-hour slices (same result)."""
    ev = table(spark, d, "events")
    out = H.previous_value(ev, "user_id", "event_id", ["value"], ts="ts", slice_minutes=60)
    return out.select("event_id", "value_last")


@query("X5_previous_value", """
SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS value_last,
       lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS event_type_last FROM events""")
def x5(spark, d):
    ev = table(spark, d, "events")
    out = H.previous_value(ev, "user_id", "event_id", ["value", "event_type"], ts="ts")
    return out.select("event_id", "value_last", "event_type_last")


DECAY = 0.99


@query("A17_running_stats", X.with_ctes(X.EVENTS_HOURLY_SQL) + f"""
SELECT step, {Q.r6('v')} AS v, {Q.r6('avg(v) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS v_mean,
       {Q.r6(f'(1 - {DECAY}) * pow({DECAY}, step) * sum(v * pow({DECAY}, -step)) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS v_ema
FROM events_hourly""")
def a17(spark, d):
    h = X.events_hourly(spark, d).select("step", "v")
    r = running_stats(h, "step", ["v"], decay=DECAY)
    return r.select("step", round6(F.col("v")).alias("v"), round6(F.col("v_mean")).alias("v_mean"),
                    round6(F.col("v_ema")).alias("v_ema"))


FAST_DECAY = 0.3


@query("A17_running_stats_multi_block", (X.with_ctes(X.EVENTS_HOURLY_SQL) + f"""
, rec(step, e) AS (
    SELECT step, (1 - {FAST_DECAY}) * v FROM events_hourly WHERE step = 1
    UNION ALL
    SELECT h.step, {FAST_DECAY} * rec.e + (1 - {FAST_DECAY}) * h.v FROM rec JOIN events_hourly h ON h.step = rec.step + 1)
SELECT step, {Q.r6('e')} AS v_ema FROM rec""").replace("WITH events_hourly", "WITH RECURSIVE events_hourly"))
def a17_multi(spark, d):
    """A17 with a fast decay (0.3): blocks of 498 steps, so the EMA carry
    crosses block boundaries; checked against the plain recurrence."""
    h = X.events_hourly(spark, d).select("step", "v")
    r = running_stats(h, "step", ["v"], decay=FAST_DECAY)
    return r.select("step", round6(F.col("v_ema")).alias("v_ema"))


@query("X3_entities_per_hour_approx")
def x3_approx(spark, d):
    """X3 with HyperLogLog++ (bounded memory per hour, about 5% error)."""
    return H.entities_per_hour(table(spark, d, "events"), "ts", "user_id", approx=True)


@query("A17_batch_metric_stream", f"""
WITH b AS (SELECT event_id // 512 AS batch_id, avg(value) AS value_mean,
                  avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) AS purchase_rate
           FROM events GROUP BY 1)
SELECT batch_id,
       {Q.r6('avg(value_mean) OVER w')} AS value_mean_mean,
       {Q.r6(f'(1 - {DECAY}) * pow({DECAY}, batch_id + 1) * sum(value_mean * pow({DECAY}, -(batch_id + 1))) OVER w')} AS value_mean_ema,
       {Q.r6('avg(purchase_rate) OVER w')} AS purchase_rate_mean,
       {Q.r6(f'(1 - {DECAY}) * pow({DECAY}, batch_id + 1) * sum(purchase_rate * pow({DECAY}, -(batch_id + 1))) OVER w')} AS purchase_rate_ema
FROM b WINDOW w AS (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def a17_batches(spark, d):
    """The reference's metric hook: per-batch means (S7 batches of 512 over
    the dense event id, A8 means) logged as running mean and EMA (A17)."""
    from quiver.operators.dataset import assign_batch
    ev = assign_batch(table(spark, d, "events"), 512, dense_key="event_id")
    per_batch = ev.groupBy("batch_id").agg(
        F.avg("value").alias("value_mean"),
        F.avg(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)).alias("purchase_rate"))
    r = running_stats(per_batch, "batch_id", ["value_mean", "purchase_rate"], decay=DECAY)
    return r.select("batch_id", *[round6(F.col(c)).alias(c) for c in
                                  ("value_mean_mean", "value_mean_ema", "purchase_rate_mean", "purchase_rate_ema")])


X4_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _x4_by_sql() -> str:
    probs = ", ".join(repr(p) for p in X4_PROBS)
    parts = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::DOUBLE AS value FROM lineitem" for f in X4_FEATURES)
    return (f"WITH lg AS ({parts}),\nq AS (SELECT feature, quantile_cont(value, [{probs}]::DOUBLE[]) AS qs "
            f"FROM lg GROUP BY feature)\n"
            f"SELECT feature, unnest([{probs}]::DOUBLE[]) AS prob, unnest(list_transform(qs, lambda v: {Q.r6('v')})) "
            f"AS value FROM q")


@query("X4_fit_bounds_per_feature", _x4_by_sql())
def x4_by(spark, d):
    """X4 for several features in one job, on the long-form table (the way
    bounds for a wide feature set are fitted)."""
    from quiver.operators.features import to_long
    long = to_long(table(spark, d, "lineitem"), [], list(X4_FEATURES))
    q = exact_quantiles_by(long, "feature", "value", X4_PROBS)
    return q.select("feature", "prob", round6(F.col("value")).alias("value"))
