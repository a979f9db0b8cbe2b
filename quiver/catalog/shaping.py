"""Sources, sinks and dataset shaping: S1-S11 (S12 lives with the model)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quiver.catalog.registry import query
from quiver.operators import dataset as D
from quiver.sources import fixtures as X
from quiver.sources.reader import Field, check_schema, conform, read_samples, split_label
from quiver.sources.sink import scored_rows, write_scored
from quiver.session import ensure_checkpoint_dir, table

LI_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("S1_read_samples", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem""")
def s1(spark, d):
    schema = "l_orderkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string"
    return read_samples(spark, f"{d}/lineite*.parquet", schema)


CONFORM_SPEC = [Field("user_id", "bigint", 0), Field("value_raw", "double", 0.0, 20),
                Field("fc_absent", "bigint", 0), Field("absent_seq", "bigint", 0, 20)]


@query("S2_conform", X.with_ctes(X.SEQ_VAR_SQL) + """
SELECT user_id, list_resize(value_raw, 20, 0.0::DOUBLE) AS value_raw, 0::BIGINT AS fc_absent,
       list_resize([]::BIGINT[], 20, 0::BIGINT) AS absent_seq
FROM seq_var""")
def s2(spark, d):
    return conform(X.seq_var(spark, d), CONFORM_SPEC)


def _label_vector():
    pdate = (F.year("l_shipdate") * 10000 + F.month("l_shipdate") * 100 + F.dayofmonth("l_shipdate"))
    return F.array(F.col("convert_label"), F.col("gmv"), F.col("roi1"), F.col("cost"), F.col("l_discount"),
                   F.col("l_tax"), pdate.cast("double")).cast("array<float>").alias("label")


@query("S3_split_label", X.with_ctes(X.SAMPLES_SQL) + """
SELECT l_orderkey, l_linenumber,
       convert_label::FLOAT::DOUBLE AS convert_label, gmv::FLOAT::DOUBLE AS gmv_label,
       roi1::FLOAT::DOUBLE AS roi1_label, cost::FLOAT::DOUBLE AS cost_label,
       l_discount::FLOAT::DOUBLE AS ctr_label, l_tax::FLOAT::DOUBLE AS cvr_label,
       (year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate))::FLOAT::DOUBLE AS p_date_label
FROM samples""")
def s3(spark, d):
    s = X.samples(spark, d).select("l_orderkey", "l_linenumber", _label_vector())
    return split_label(s, "label")


@query("S4_filter_equal", X.with_ctes(X.SAMPLES_SQL) + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p FROM samples WHERE l_linenumber = 3""")
def s4(spark, d):
    return D.filter_equal(X.samples(spark, d), "l_linenumber", 3).select(*LI_KEYS, "p")


@query("S5_shuffle", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem")
def s5(spark, d):
    return D.shuffle_rows(table(spark, d, "lineitem").select(*LI_KEYS), LI_KEYS, seed=7)


@query("S5_shuffle_approximate", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem")
def s5_approx(spark, d):
    """S5 like a shuffle buffer: random partitions, random order inside each;
    the row multiset is unchanged."""
    return D.shuffle_partitions(table(spark, d, "lineitem").select(*LI_KEYS), 8, seed=7)


@query("S6_repeat", """
SELECT l_orderkey, l_linenumber, l_quantity, e.range AS epoch FROM lineitem CROSS JOIN range(2) e""")
def s6(spark, d):
    return D.repeat(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), 2) \
        .withColumn("epoch", F.col("epoch").cast("bigint"))


@query("S7_assign_batch", "SELECT event_id, event_id // 512 AS batch_id FROM events")
def s7(spark, d):
    return D.assign_batch(table(spark, d, "events").select("event_id"), 512, dense_key="event_id")


@query("S7_assign_batch_by_rank", """
SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch_id FROM labels""")
def s7_rank(spark, d):
    """S7 on a unique but sparse key (labelled documents): consecutive
    batches of 64 by rank, ranks from distributed running counts."""
    return D.assign_batch(table(spark, d, "labels").select("doc_id"), 64, order_key="doc_id")


@query("S8_date_holdout", """
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN l_shipdate::DATE = (SELECT max(l_shipdate::DATE) FROM lineitem) THEN 'eval' ELSE 'train' END AS split
FROM lineitem""")
def s8(spark, d):
    return D.date_holdout(table(spark, d, "lineitem"), "l_shipdate").select(
        "l_orderkey", "l_linenumber", "l_partkey", "split")


@query("S9_path_prefix", """
SELECT page_id, substr(url, 1, instr(url, '.example.') - 1) AS prefix FROM pages""")
def s9(spark, d):
    return table(spark, d, "pages").select("page_id", D.path_prefix_before("url", ".example.").alias("prefix"))


TASKS = {"convert": ("convert_label", "p"), "roi1": ("roi1", "p")}


@query("S10_scored_rows", X.with_ctes(X.SAMPLES_SQL) + """
SELECT 'eval' AS dataset, 0::BIGINT AS user_id_mock,
       p AS score_convert, convert_label AS label_convert, p AS score_convert_cap,
       least(greatest(convert_label, 0.0::DOUBLE), 300.0::DOUBLE) AS label_convert_cap,
       p AS score_roi1, roi1 AS label_roi1, p AS score_roi1_cap,
       least(greatest(roi1, 0.0::DOUBLE), 300.0::DOUBLE) AS label_roi1_cap,
       l_orderkey, l_linenumber, gmv, cost
FROM samples""")
def s10(spark, d):
    return scored_rows(X.samples(spark, d), TASKS, "eval", ["l_orderkey", "l_linenumber"],
                       ["gmv", "cost"], with_clock=False)


@query("S10_scored_rows_sampled")
def s10_sampled(spark, d):
    """S10 with the service's 10% deterministic hash sample of rows."""
    from quiver.sources.sink import sample_by_hash
    rows = scored_rows(X.samples(spark, d), TASKS, "eval", ["l_orderkey", "l_linenumber"],
                       ["gmv", "cost"], with_clock=False)
    return sample_by_hash(rows, ["l_orderkey", "l_linenumber", "gmv", "cost"], 0.1)


@query("S10_train_then_eval_files", X.with_ctes(X.SAMPLES_SQL) + """
SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'train' ELSE 'eval' END AS dataset, l_orderkey, l_linenumber,
       p AS score_roi1, roi1 AS label_roi1, least(greatest(roi1, 0.0::DOUBLE), 300.0::DOUBLE) AS label_roi1_cap, gmv FROM samples""")
def s10_files(spark, d):
    """The train run's rows and then the eval run's rows, written to one folder and read back."""
    path = f"{ensure_checkpoint_dir(spark)}/scored/{uuid.uuid4().hex}"
    for split, half in (("train", 0), ("eval", 1)):
        part = X.samples(spark, d).filter(F.col("l_orderkey") % 2 == half)
        write_scored(scored_rows(part, TASKS, split, ["l_orderkey", "l_linenumber"], ["gmv"]), path)
    return spark.read.parquet(path).select("dataset", "l_orderkey", "l_linenumber", "score_roi1", "label_roi1", "label_roi1_cap", "gmv")


CONTRACT = [Field("user_id", "bigint"), Field("value_raw", "double", 0.0, 20), Field("missing_seq", "bigint", 0, 20)]


@query("S11_check_schema", X.with_ctes(X.SEQ_VAR_SQL) + """
SELECT 'user_id' AS field, true AS present, true AS type_ok, 0::BIGINT AS n_bad_length
UNION ALL
SELECT 'value_raw', true, true, count(*) FILTER (WHERE coalesce(len(value_raw), -1) <> 20) FROM seq_var
UNION ALL
SELECT 'missing_seq', false, false, 0::BIGINT""")
def s11(spark, d):
    return check_schema(X.seq_var(spark, d), CONTRACT)


# The minimum slice of the build plan: scan -> compress -> bucketize -> count.
P2_BOUNDS = (0.001, 5.0, 8.0, 10.0, 10.5, 11.0)


@query("P2_bucket_histogram", """
SELECT len(list_filter([0.001, 5.0, 8.0, 10.0, 10.5, 11.0]::DOUBLE[],
                       lambda b: ln(1 + greatest(l_extendedprice, 0.0::DOUBLE)) >= b))::INTEGER AS bucket,
       count(*) AS n
FROM lineitem GROUP BY 1""")
def p2_hist(spark, d):
    from quiver.functions.transforms import bucketize, compress
    li = table(spark, d, "lineitem")
    return li.select(bucketize(compress("l_extendedprice"), P2_BOUNDS).alias("bucket")) \
        .groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))

