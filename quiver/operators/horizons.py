"""Multi-horizon counters (X1-X5): the producer side of the ratio and delta
features, over an event table keyed by entity and time.

Skew: one entity may own a large share of all events. Windows are
therefore partitioned by (entity, time bucket), never by entity alone. Each
event is also copied, as a read-only "halo" row, into the following buckets
its longest horizon reaches (and no others), so every bucket holds the
complete history its own rows need. With the bucket as wide as the longest
horizon the copy factor is at most 2; narrower buckets cut a hot entity
finer at a larger copy factor, wider ones copy less. An entity with very many
events within one bucket is cut by minutes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.session import cut_lineage, epoch_micros

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


#: Events of one key within one longest horizon above which the key is worked off in panes of a minute.
HOT_ROWS = 4_000_000
#: Events that a task gets at most on the average; it sorts some nine marks of each, and as many again of halo copies.
TASK_EVENTS = 100_000
PANE_US = 60_000_000


def multi_horizon(df: DataFrame, key: str, ts: str, horizons_hours: Sequence[int],
                  value_cols: Sequence[str] = (), bucket_hours: int | None = None,
                  name: str = "{m}_{h}h", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per event, count (and sum of each value column) of the same key's
    events in ``[t - h, t]``, like a SQL ``RANGE BETWEEN h PRECEDING AND
    CURRENT ROW`` frame. Rows without a key are a key of their own; rows
    without a time are kept and have NULL counters. NULL values add nothing;
    NaN and infinities count in the windows that hold them and in no others.

    No frame slides: every event marks its own time and, per horizon, the time
    t - h. Running totals over the marks in time order, then a counter is the
    total at t less the total before t - h, so the work is that of one sort
    whatever a window holds. Totals start anew in each bucket, which
    keeps them small. A key with more than ``hot_rows`` events in a bucket (one
    count per key and bucket decides) is dealt out by minutes instead: totals
    inside a minute, totals over its minutes, and a join of both.

    Output: the input columns plus ``cnt_<h>h`` and ``<v>_sum_<h>h`` (names via
    ``name`` with m in {cnt, <v>_sum})."""
    hs = sorted(int(h) for h in horizons_hours)
    b_us = (bucket_hours or hs[-1]) * HOUR_US
    base = df.select(F.struct(*df.columns).alias("_row"), F.col(key).alias("_key"), epoch_micros(ts).alias("_us"),
                     *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(value_cols)])
    base = base.withColumn("_b", F.floor(F.col("_us") / F.lit(b_us)))
    if hot_rows < 1:
        raise ValueError("hot_rows must be positive")
    sizes = base.groupBy("_key", "_b").agg(F.count(F.lit(1)).alias("_n"))
    is_full = (F.col("_n") > hot_rows) & F.col("_b").isNotNull()
    events, n_full = sizes.agg(F.sum("_n"), F.count_if(is_full)).first()
    tasks = max(1, -(-(events or 0) // TASK_EVENTS))
    if not n_full:
        out = _in_buckets(base, hs, len(value_cols), b_us, tasks)
    else:   # fewer keys than rows / hot_rows; the planner broadcasts them by their measured size
        full = sizes.filter(is_full).select(F.col("_key").alias("_hot")).distinct()
        is_hot = F.col("_key").eqNullSafe(F.col("_hot")) & F.col("_us").isNotNull()
        out = _in_buckets(base.join(full, is_hot, "left_anti"), hs, len(value_cols), b_us, tasks).unionByName(
            _in_panes(base.join(full, is_hot, "left_semi"), hs, len(value_cols)))
    cols = []
    for i, h in enumerate(hs):
        cols.append(F.col(f"_c{i}").alias(name.format(m="cnt", h=h)))
        cols += [F.col(f"_s{k}_{i}").alias(name.format(m=f"{v}_sum", h=h)) for k, v in enumerate(value_cols)]
    return out.select("_row.*", *cols)


def _parallel(df: DataFrame) -> int:
    try:
        return df.sparkSession.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 -- a Spark Connect session
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _marks(rows: DataFrame, hs: Sequence[int], own: Column) -> DataFrame:
    """A row per mark: the event's (_i = -1) and, for own events, one at t - h for each horizon, ahead of the events of that time."""
    mark = lambda i, t: F.struct(F.lit(i).alias("_i"), t.alias("_t"))
    event = mark(-1, F.col("_us"))
    probes = [mark(i, F.col("_us") - F.lit(h * HOUR_US)) for i, h in enumerate(hs)]
    return rows.withColumn("_m", F.explode(F.when(own, F.array(event, *probes)).otherwise(F.array(event)))).select(
        *rows.columns, "_m.*").withColumn("_at", (F.col("_i") < 0).cast("int"))


def _parts(n_values: int) -> dict[str, Column]:
    """What is totalled over the marks: events, finite values, and how many add +inf and -inf (NaN: both)."""
    event, inf = F.col("_i") < 0, F.lit(float("inf"))
    out = {"n": F.when(event, 1).otherwise(0).cast("long")}
    for k in range(n_values):
        v = F.col(f"_v{k}")
        odd = F.isnan(v) | (v == inf) | (v == -inf)
        out[f"v{k}"] = F.when(event & ~odd, v).otherwise(0.0)
        for tag, is_it in (("pos", v == inf), ("neg", v == -inf)):
            out[f"{tag}{k}"] = F.when(event & (is_it | F.isnan(v)), 1).otherwise(0).cast("long")
    return out


def _counters(hs: Sequence[int], n_values: int, upto: Callable[[str, int], Column]) -> list[Column]:
    """The counters, from ``upto(part, i)``: a part's total in the window of horizon i."""
    timed = F.col("_row_us").isNotNull()
    out = []
    for i in range(len(hs)):
        out.append(F.when(timed, upto("n", i)).alias(f"_c{i}"))
        for k in range(n_values):
            pos, neg = upto(f"pos{k}", i) > 0, upto(f"neg{k}", i) > 0
            total = F.when(pos & neg, F.lit(float("nan"))).when(pos, F.lit(float("inf"))).when(neg, F.lit(float("-inf"))).otherwise(upto(f"v{k}", i))
            out.append(F.when(timed, total).alias(f"_s{k}_{i}"))
    return out


def _in_buckets(base: DataFrame, hs: Sequence[int], n_values: int, b_us: int, tasks: int) -> DataFrame:
    """One shuffle: events dealt by key and bucket with their halo copies; all marks are made and totalled where they then are.
    There are as many tasks as the counted events ask for: the planner, which merges partitions by their size before the marks are made, has no say in it."""
    parts = _parts(n_values)
    # an event at t in bucket b is history for bucket b+k while that bucket
    # starts no later than t + H: k <= floor((t + H) / B) - b
    last_k = F.floor((F.col("_us") + F.lit(hs[-1] * HOUR_US)) / F.lit(b_us)) - F.col("_b")
    copies = base.withColumn("_uid", F.monotonically_increasing_id()).withColumn(
        "_k", F.explode_outer(F.sequence(F.lit(0).cast("bigint"), last_k)))
    # rows without a time are alone in a bucket each
    copies = copies.withColumn("_pb", F.coalesce(F.col("_b") + F.col("_k"), -1 - F.col("_uid"))).withColumn(
        "_row", F.when(F.coalesce("_k", F.lit(0)) == 0, F.col("_row"))).repartition(max(tasks, _parallel(base)), "_key", "_pb")
    own = F.coalesce("_k", F.lit(0)) == 0
    w = Window.partitionBy("_key", "_pb").orderBy("_t", "_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # only the mark of the event itself carries the row
    run = _marks(copies, hs, own).withColumn("_row", F.when(F.col("_i") < 0, F.col("_row"))).select("_key", "_pb", "_uid", "_us", "_i", "_row", own.alias("_own"), *[F.sum(c).over(w).alias(p) for p, c in parts.items()])
    at = lambda p, i: F.max(F.when(F.col("_i") == i, F.col(p)))
    per = run.filter("_own").groupBy("_key", "_pb", "_uid").agg(
        F.first(F.when(F.col("_i") < 0, F.col("_row")), ignorenulls=True).alias("_row"), F.max("_us").alias("_row_us"),
        *[at(p, i).alias(f"{p}@{i}") for p in parts for i in range(-1, len(hs))])
    return per.select("_row", *_counters(hs, n_values, lambda p, i: F.col(f"`{p}@-1`") - F.col(f"`{p}@{i}`")))


def _in_panes(base: DataFrame, hs: Sequence[int], n_values: int) -> DataFrame:
    """Marks dealt by key and minute. A total is that of the minutes before it in its bucket plus that
    inside its minute; a window that reaches into the bucket before takes that one's rest."""
    parts = _parts(n_values)
    b_us = hs[-1] * HOUR_US
    base = cut_lineage(base.drop("_b").withColumn("_uid", F.monotonically_increasing_id()))  # ids that a repeated task can't change
    marks = _marks(base, hs, F.lit(True)).withColumn("_pane", F.floor(F.col("_t") / F.lit(PANE_US)))
    inside = Window.partitionBy("_key", "_pane").orderBy("_t", "_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = marks.select("_key", "_pane", "_uid", "_i", *[F.sum(c).over(inside).alias(p) for p, c in parts.items()])
    panes = marks.groupBy("_key", "_pane").agg(*[F.sum(c).alias(p) for p, c in parts.items()]).withColumn(
        "_b", F.floor(F.col("_pane") * F.lit(PANE_US) / F.lit(b_us)))
    before = Window.partitionBy("_key", "_b").orderBy("_pane").rowsBetween(Window.unboundedPreceding, -1)  # at most the minutes of a bucket
    panes = panes.select(F.col("_key").alias("_pk"), F.col("_pane").alias("_pp"), "_b",
                         *[F.coalesce(F.sum(p).over(before), F.lit(0)).alias(f"{p}<") for p in parts],
                         *[F.sum(p).over(Window.partitionBy("_key", "_b")).alias(f"{p}=") for p in parts])
    placed = run.join(panes, F.col("_key").eqNullSafe(F.col("_pk")) & (F.col("_pane") == F.col("_pp"))).select(
        "_uid", "_i", F.struct("_b", *[F.struct((F.col(f"`{p}<`") + F.col(p)).alias("upto"), F.col(f"`{p}=`").alias("all")).alias(p) for p in parts]).alias("_x"))
    per = placed.groupBy("_uid").agg(*[F.first(F.when(F.col("_i") == i, F.col("_x")), ignorenulls=True).alias(f"@{i}") for i in range(-1, len(hs))])

    def upto(p: str, i: int) -> Column:
        own, then = F.col("`@-1`"), F.col(f"`@{i}`")
        return own[p]["upto"] - then[p]["upto"] + F.when(own["_b"] == then["_b"], F.lit(0)).otherwise(then[p]["all"])

    return base.select("_uid", "_row", F.col("_us").alias("_row_us")).join(per, "_uid").select("_row", *_counters(hs, n_values, upto))


def cumulative_in_day(df: DataFrame, key: str, ts: str, value_cols: Sequence[str] = (),
                      slice_minutes: int = 60) -> DataFrame:
    """Running count (and sums) of the key's events since the start of the
    event's day (UTC), current row included, and with it all events of the
    same time, whose order nothing tells. Rows without a key are a key of
    their own; rows without a time are kept and have NULL totals.

    A hot (key, day) is split into time slices (``slice_minutes``, default one
    hour): the running total inside each slice is a window on (key, day,
    slice); earlier slices of the same day come from a table with one row per
    (key, day, slice), run over at most 1440 / slice_minutes rows per key-day."""
    if DAY_US % (slice_minutes * 60_000_000) != 0:
        raise ValueError("slice_minutes must divide a day")
    slice_us = slice_minutes * 60_000_000
    cols = df.columns
    base = (df.withColumn("_us", epoch_micros(ts))
              .withColumn("_day", F.floor(F.col("_us") / F.lit(DAY_US)))
              .withColumn("_sl", F.floor((F.col("_us") % F.lit(DAY_US)) / F.lit(slice_us))))
    sums = ["_one"] + list(value_cols)
    base = base.withColumn("_one", F.lit(1).cast("long"))
    w = Window.partitionBy(key, "_day", "_sl").orderBy("_us").rangeBetween(Window.unboundedPreceding, 0)
    local = base.select(*cols, "_day", "_sl", *[F.sum(c).over(w).alias(f"_l_{c}") for c in sums])
    tot = base.groupBy(key, "_day", "_sl").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    wo = Window.partitionBy(key, "_day").orderBy("_sl").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(key, "_day", "_sl", *[F.coalesce(F.sum(f"_t_{c}").over(wo), F.lit(0)).alias(f"_o_{c}")
                                           for c in sums])
    off = off.withColumnsRenamed({key: "_ok", "_day": "_od", "_sl": "_os"})
    j = local.join(off, F.col(key).eqNullSafe(F.col("_ok")) & F.col("_day").eqNullSafe(F.col("_od"))
                   & F.col("_sl").eqNullSafe(F.col("_os")))
    names = {"_one": "cum_cnt_day"}
    names.update({v: f"cum_{v}_day" for v in value_cols})
    return j.select(*cols, *[F.when(F.col("_day").isNotNull(), F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(names[c])
                             for c in sums])


def entities_per_hour(df: DataFrame, ts: str, entity: str, approx: bool = False) -> DataFrame:
    """Distinct entities per hour (exact: a two-phase distinct aggregate,
    deduplicated before the shuffle; ``approx``: HyperLogLog++)."""
    hour = F.floor(epoch_micros(ts) / F.lit(HOUR_US)).cast("bigint").alias("hour_id")
    agg = F.approx_count_distinct(entity) if approx else F.countDistinct(entity)
    return df.select(hour, entity).groupBy("hour_id").agg(agg.alias("n_entities"))


def entity_sketches(df: DataFrame, ts: str, entity: str, lg_k: int = 12) -> DataFrame:
    """X3 to be stored: (hour_id, sketch), a mergeable distinct sketch of each hour's entities. It takes at most 2^lg_k bytes and
    a standard error of about 0.83 / sqrt(2^lg_k), 1.3% by default. NULL entities are not counted; rows without a time have no hour and are left out."""
    hour = F.floor(epoch_micros(ts) / F.lit(HOUR_US)).cast("bigint").alias("hour_id")
    rows = df.select(hour, F.col(entity).cast("string").alias("_e")).filter("hour_id is not null")
    return rows.groupBy("hour_id").agg(F.hll_sketch_agg("_e", lg_k).alias("sketch"))


def entities_in_windows(sketches: DataFrame, hours: int, ends: DataFrame | None = None) -> DataFrame:
    """(hour_id, n_entities): distinct entities of the ``hours`` hours up to each hour that has a sketch (or is in ``ends``), from
    stored sketches alone: each is sent to the hours whose windows hold it and merged there, so events are not read again."""
    lag = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(hours - 1).cast("bigint")))
    sent = sketches.withColumn("_lag", lag).select((F.col("hour_id") + F.col("_lag")).alias("hour_id"), "sketch")
    per = sent.groupBy("hour_id").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_entities"))
    return per.join((sketches if ends is None else ends).select("hour_id").distinct(), "hour_id", "left_semi")


def previous_value(df: DataFrame, key: str, order: str, cols: Sequence[str],
                   suffix: str = "_last", ts: str | None = None, slice_minutes: int = 1440) -> DataFrame:
    """The key's previous value of each column (``lag``), NULL for the
    key's first event.

    With ``ts`` events follow each other by (ts, order), and the window runs
    per (key, time slice) -- a day by default -- so a hot key is split; the
    first event of a slice takes the last event of the key's previous
    non-empty slice from a table with one row per (key, slice). Events without
    a time come before all others of their key; NULL keys are a key."""
    if ts is None:
        w = Window.partitionBy(key).orderBy(order)
        return df.select("*", *[F.lag(c).over(w).alias(f"{c}{suffix}") for c in cols])
    base = df.withColumn("_sl", F.floor(epoch_micros(ts) / F.lit(slice_minutes * 60_000_000)))
    w = Window.partitionBy(key, "_sl").orderBy(ts, order)
    local = base.select("*", F.row_number().over(w).alias("_rn"),
                        *[F.lag(c).over(w).alias(f"_lag_{c}") for c in cols])
    tail = base.groupBy(key, "_sl").agg(F.max_by(F.struct(*cols), F.struct(ts, order)).alias("_tail"))
    wd = Window.partitionBy(key).orderBy("_sl")
    prev = tail.select(F.col(key).alias("_pk"), F.col("_sl").alias("_ps"), F.lag("_tail").over(wd).alias("_prev"))
    j = local.join(prev, F.col(key).eqNullSafe(F.col("_pk")) & F.col("_sl").eqNullSafe(F.col("_ps")))
    return j.select(*df.columns, *[
        F.when(F.col("_rn") == 1, F.col(f"_prev.{c}")).otherwise(F.col(f"_lag_{c}")).alias(f"{c}{suffix}")
        for c in cols])
