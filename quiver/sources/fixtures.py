"""Views over the test tables that stand in for the reference's samples
(FIXTURES.md), each as a Spark builder and as the equivalent SQL common
table expression for the DuckDB oracle. Both sides compute in double.

Every view reads the given tables and grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.operators.horizons import multi_horizon
from quiver.operators.sequence import consecutive
from quiver.plans.prefix import running_totals, running_totals_by
from quiver.session import epoch_micros, table

HORIZONS = (1, 3, 6, 12, 24, 48, 72)
SENTINEL_MOD = 17
SEQ_LEN = 20


def hcol(metric: str, h: int) -> str:
    return f"fc_evt_{metric}_{h}h_user_all"


# --- samples ------------------------------------------------------------------
def samples(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    net = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    cost = F.col("l_quantity") * F.lit(1500.0)
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag",
        "l_linestatus", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
        F.when(F.col("l_returnflag") == "R", F.lit(1.0)).otherwise(F.lit(0.0)).alias("convert_label"),
        net.alias("gmv"), cost.alias("cost"), (net / cost).alias("roi1"),
        (F.col("l_extendedprice") / F.lit(500.0)).alias("big_label"),
        (F.lit(0.01) + F.lit(0.98) * ((F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729) % 1000)
         / F.lit(1000.0)).alias("p"))


SAMPLES_SQL = """samples AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag, l_linestatus,
         l_extendedprice, l_quantity, l_discount, l_tax,
         CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS convert_label,
         l_extendedprice * (1.0::DOUBLE - l_discount) AS gmv,
         l_quantity * 1500.0::DOUBLE AS cost,
         l_extendedprice * (1.0::DOUBLE - l_discount) / (l_quantity * 1500.0::DOUBLE) AS roi1,
         l_extendedprice / 500.0::DOUBLE AS big_label,
         0.01::DOUBLE + 0.98::DOUBLE * ((l_partkey * 7919 + l_suppkey * 104729) % 1000) / 1000.0::DOUBLE AS p
  FROM lineitem)"""


# --- scored documents -----------------------------------------------------------
def scored_docs(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels")
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return lab.join(docs, "doc_id").select(
        "doc_id", F.col("quality").cast("double").alias("label"), F.col("toxic").cast("double").alias("toxic"),
        ((F.col("n_chars") % 97).cast("double") / F.lit(97.0)).alias("p"))


SCORED_DOCS_SQL = """scored_docs AS (
  SELECT l.doc_id, l.quality::DOUBLE AS label, l.toxic::DOUBLE AS toxic,
         (d.n_chars % 97)::DOUBLE / 97.0::DOUBLE AS p
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


# --- events per hour ------------------------------------------------------------
def events_hourly(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    g = (ev.select(F.floor(epoch_micros("ts") / F.lit(3_600_000_000)).cast("bigint").alias("hour_id"), "value")
           .groupBy("hour_id").agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("n")))
    return running_totals(g, "hour_id", [], with_count="step")


EVENTS_HOURLY_SQL = """events_hourly AS (
  SELECT hour_id, v, n, row_number() OVER (ORDER BY hour_id) AS step
  FROM (SELECT epoch_us(ts) // 3600000000 AS hour_id, avg(value) AS v, count(*) AS n
        FROM events GROUP BY 1))"""


# --- multi-horizon counters with the -1 sentinel ----------------------------------
def horizons(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    h = multi_horizon(ev, "user_id", "ts", HORIZONS, value_cols=["value"])
    bad = (F.col("event_id") % SENTINEL_MOD) == 0
    out = [F.col("event_id"), F.col("user_id"), F.col("ts"), F.col("value")]
    for hh in HORIZONS:
        out.append(F.when(bad, F.lit(-1).cast("bigint")).otherwise(F.col(f"cnt_{hh}h")).alias(hcol("cnt", hh)))
        out.append(F.when(bad, F.lit(-1.0)).otherwise(F.col(f"value_sum_{hh}h")).alias(hcol("val", hh)))
    return h.select(*out)


def _horizons_sql() -> str:
    cols = []
    for hh in HORIZONS:
        frame = (f"OVER (PARTITION BY user_id ORDER BY epoch_us(ts) "
                 f"RANGE BETWEEN {hh * 3_600_000_000} PRECEDING AND CURRENT ROW)")
        cols.append(f"CASE WHEN event_id % {SENTINEL_MOD} = 0 THEN -1 ELSE count(*) {frame} END "
                    f"AS {hcol('cnt', hh)}")
        cols.append(f"CASE WHEN event_id % {SENTINEL_MOD} = 0 THEN -1.0::DOUBLE ELSE sum(value) {frame} END "
                    f"AS {hcol('val', hh)}")
    return "horizons AS (\n  SELECT event_id, user_id, ts, value,\n    " + ",\n    ".join(cols) + \
        "\n  FROM events)"


HORIZONS_SQL = _horizons_sql()


# --- all values per user, in consecutive sequences of 20 -------------------------------------------------------
def seq20(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    return consecutive(ev, "user_id", "event_id", ["value"], SEQ_LEN)


SEQ20_SQL = f"""seq20 AS (
  SELECT user_id, chunk, list_resize(vals, {SEQ_LEN}, 0.0::DOUBLE) AS value_seq,
         list_transform(range({SEQ_LEN}), lambda i: i < len(vals)) AS mask, len(vals)::INTEGER AS n_valid
  FROM (SELECT user_id, (rn - 1) // {SEQ_LEN} AS chunk, list(value ORDER BY event_id) AS vals
        FROM (SELECT user_id, event_id, value,
                     row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)
        GROUP BY 1, 2))"""


# --- variable-length raw sequences: consecutive runs of 5..34 values, by user ---------------------------
def seq_var(spark: SparkSession, d: str) -> DataFrame:
    """Every value of every user, cut into runs of user_id % 30 + 5 values."""
    ev = table(spark, d, "events").withColumn("_one", F.lit(1).cast("long"))
    ranked = running_totals_by(ev.select("user_id", "event_id", "value", "_one"), "user_id", "event_id", ["_one"])
    run = F.floor((F.col("cum__one") - 1) / (F.col("user_id") % 30 + 5)).cast("long")
    g = ranked.groupBy("user_id", run.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("_s"))
    return g.select("user_id", F.transform("_s", lambda s: s["value"]).alias("value_raw"))


SEQ_VAR_SQL = """seq_var AS (
  SELECT user_id, list(value ORDER BY event_id) AS value_raw
  FROM (SELECT user_id, event_id, value,
               row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)
  GROUP BY user_id, (rn - 1) // (user_id % 30 + 5))"""


# --- feature names that follow the reference's name grammar ------------------------
# The suffixes of the name grammar, plus one that matches no rule.
NAME_SUFFIXES = ("_vmid_all", "_campaign_id_vmid_all", "_campaign_id_all", "_camp", "_camp_vmid", "_total")


def feature_names(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    suf = F.element_at(F.array(*[F.lit(s) for s in NAME_SUFFIXES]),
                       (F.col("event_id") % len(NAME_SUFFIXES) + 1).cast("int"))
    return ev.select(F.concat(F.lit("fc_"), F.col("event_type"), F.lit("_cnt"), suf).alias("name")).distinct()


FEATURE_NAMES_SQL = "feature_names AS (\n  SELECT DISTINCT 'fc_' || event_type || '_cnt' || " \
    "(" + "[" + ", ".join(f"'{s}'" for s in NAME_SUFFIXES) + "])" + \
    f"[event_id % {len(NAME_SUFFIXES)} + 1] AS name FROM events)"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
