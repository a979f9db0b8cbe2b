"""Projections and scalar feature transforms: P1, P3-P23."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiver.catalog import sqlbits as Q
from quiver.catalog.registry import query
from quiver.functions import transforms as T
from quiver.operators import derive as DV
from quiver.operators import features as FT
from quiver.operators.horizons import previous_value
from quiver.session import round6, table
from quiver.sources import fixtures as X

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS_SQL = ", ".join(KEYS)
PRICE_BOUNDS = (0.001, 5.0, 8.0, 10.0, 10.5, 11.0)          # log space
QTY_BOUNDS = (1.0, 5.0, 10.0, 20.0, 30.0, 40.0, 50.0)
DISC_BOUNDS = (0.0, 0.02, 0.05, 0.08, 0.1)
TAX_BOUNDS = (0.0, 0.04, 0.08)


@query("P1_compress", X.with_ctes(X.SAMPLES_SQL) + f"""
SELECT {KEYS_SQL}, {Q.r6(Q.compress('gmv'))} AS gmv_log, {Q.r6(Q.compress('l_discount - 0.05::DOUBLE'))} AS disc_log,
       {Q.r6(Q.compress('l_discount - 0.05::DOUBLE', log=False))} AS disc_clamped
FROM samples""")
def p1(spark, d):
    s = X.samples(spark, d)
    return s.select(*KEYS, round6(T.compress("gmv")).alias("gmv_log"),
                    round6(T.compress(F.col("l_discount") - 0.05)).alias("disc_log"),
                    round6(T.compress(F.col("l_discount") - 0.05, log=False)).alias("disc_clamped"))


def _price_bucket():
    return T.bucketize(T.compress("l_extendedprice"), PRICE_BOUNDS).alias("bucket")


PRICE_BUCKET_SQL = Q.bucket(Q.compress("l_extendedprice"), PRICE_BOUNDS)

P4_SQL_CTE = f"""g AS (SELECT {PRICE_BUCKET_SQL} AS bucket, sum(convert_label) AS s, count(*) AS n
       FROM samples GROUP BY 1),
w AS (SELECT 'price' AS feature, bucket, n,
             (s + 10.0::DOUBLE * (sum(s) OVER () / sum(n) OVER ())) / (n + 10.0::DOUBLE) AS weight FROM g)"""


def _p4(spark, d):
    s = X.samples(spark, d).select(_price_bucket(), "convert_label")
    return FT.bucket_target_mean(s, "price", "bucket", "convert_label", smoothing=10.0)


@query("P4_bucket_target_mean", X.with_ctes(X.SAMPLES_SQL, P4_SQL_CTE) + f"""
SELECT feature, bucket, n, {Q.r6('weight')} AS weight FROM w""")
def p4(spark, d):
    return _p4(spark, d).select("feature", "bucket", "n", round6(F.col("weight")).alias("weight"))


@query("P3_bucket_encode", X.with_ctes(X.SAMPLES_SQL, P4_SQL_CTE) + f"""
SELECT {KEYS_SQL}, b.bucket, {Q.r6('w.weight')} AS encoded
FROM (SELECT {KEYS_SQL}, {PRICE_BUCKET_SQL} AS bucket FROM samples) b LEFT JOIN w ON b.bucket = w.bucket""")
def p3(spark, d):
    s = X.samples(spark, d).select(*KEYS, _price_bucket())
    enc = FT.bucket_encode(s, "price", "bucket", _p4(spark, d))
    return enc.select(*KEYS, "bucket", round6(F.col("encoded")).alias("encoded"))


SPECS_1D = {"l_quantity": QTY_BOUNDS, "l_extendedprice": (1000.0, 10000.0, 50000.0),
            "l_discount": DISC_BOUNDS, "fc_tax_shadow": TAX_BOUNDS}
LOG_1D = {"l_extendedprice": PRICE_BOUNDS}


@query("P5_bucket_features_1d", f"""
SELECT {KEYS_SQL},
       {Q.bucket('l_discount::FLOAT::DOUBLE', DISC_BOUNDS)} AS b_l_discount,
       {Q.bucket(Q.compress('l_extendedprice'), PRICE_BOUNDS)} AS b_l_extendedprice,
       {Q.bucket('l_quantity::FLOAT::DOUBLE', QTY_BOUNDS)} AS b_l_quantity
FROM lineitem""")
def p5(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_tax", "fc_tax_shadow")
    out, kept, _skipped = FT.bucket_features_1d(li, SPECS_1D, LOG_1D, skip_shadow=True)
    return out.select(*KEYS, *[f"{FT.BUCKET_PREFIX}{k}" for k in kept])


def _seq2d(spark, d):
    """2-D features per user: values and counts of all events, 20 a sequence."""
    from quiver.operators.sequence import consecutive
    h = X.horizons(spark, d)
    return consecutive(h, "user_id", "event_id", ["value", X.hcol("cnt", 24), X.hcol("cnt", 1), X.hcol("cnt", 3)], 20)


SEQ2D_SQL = f"""seq2d AS (
  SELECT user_id,
         list_resize(list(value ORDER BY event_id), 20, 0.0::DOUBLE) AS value_seq,
         list_resize(list({X.hcol('cnt', 24)} ORDER BY event_id), 20, 0::BIGINT) AS c24,
         list_resize(list({X.hcol('cnt', 1)} ORDER BY event_id), 20, 0::BIGINT) AS c1,
         list_resize(list({X.hcol('cnt', 3)} ORDER BY event_id), 20, 0::BIGINT) AS c3
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM horizons)
  GROUP BY user_id, (rn - 1) // 20)"""
VALUE_BOUNDS = (1.0, 10.0, 25.0, 50.0, 75.0, 100.0)
CNT_LOG_BOUNDS = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0)
RATIO_BOUNDS = (-3.0, -1.0, -0.5, 0.0, 0.5, 1.0)
DELTA_BOUNDS = (-2.0, -1.0, -0.5, -0.0001, 0.0001, 0.5)


@query("P6_bucket_features_2d", X.with_ctes(X.HORIZONS_SQL, SEQ2D_SQL) + f"""
, r AS (SELECT user_id, value_seq, c24,
        list_transform(list_zip(c1, c3), lambda t: {Q.log_ratio('t[1]', 't[2]')}) AS ratio_1_3,
        list_transform(list_zip(c1, c3), lambda t: CASE WHEN t[1] <= -1 OR t[2] <= -1 THEN -1.0::DOUBLE
             ELSE {Q.signed_delta('t[1]::DOUBLE / 1.0', 't[2]::DOUBLE / 3.0')} END) AS delta_1_3
      FROM seq2d)
SELECT user_id,
       {Q.bucket(Q.compress('list_max(c24)'), CNT_LOG_BOUNDS)} AS b_c24,
       {Q.bucket('list_max(delta_1_3)::FLOAT::DOUBLE', DELTA_BOUNDS)} AS b_delta_1_3,
       {Q.bucket('list_max(ratio_1_3)::FLOAT::DOUBLE', RATIO_BOUNDS)} AS b_ratio_1_3,
       {Q.bucket('(list_sum(value_seq) / 20.0)::FLOAT::DOUBLE', VALUE_BOUNDS)} AS mean_b_value_seq,
       {Q.bucket('list_max(value_seq)::FLOAT::DOUBLE', VALUE_BOUNDS)} AS b_value_seq
FROM r""")
def p6(spark, d):
    s = _seq2d(spark, d).select("user_id", "value_seq", F.col(f"{X.hcol('cnt', 24)}_seq").alias("c24"),
                                F.col(f"{X.hcol('cnt', 1)}_seq").alias("c_1h_user_all"),
                                F.col(f"{X.hcol('cnt', 3)}_seq").alias("c_3h_user_all"))
    delta = "c_1_3h_user_all"
    specs = {"value_seq": VALUE_BOUNDS, "c24": (0.0,), "ratio_1_3": RATIO_BOUNDS, delta: DELTA_BOUNDS}
    out, kept = DV.features_2d(s, specs, {"c24": CNT_LOG_BOUNDS}, ratios=[("c_1h_user_all", "c_3h_user_all", "ratio_1_3")],
                               ladders={"c": (1, 3)}, key="user")
    out, _ = FT.bucket_features_2d(out, {"value_seq": VALUE_BOUNDS}, reduce="mean", prefix="mean_b_")
    return out.select("user_id", *[F.col(f"b_{k}").alias("b_delta_1_3" if k == delta else f"b_{k}") for k in kept], "mean_b_value_seq")


@query("P7_array_reduce", X.with_ctes(X.SEQ20_SQL) + f"""
SELECT user_id, list_max(value_seq) AS seq_max, {Q.r6('list_sum(value_seq) / 20.0')} AS seq_mean FROM seq20""")
def p7(spark, d):
    s = X.seq20(spark, d)
    return s.select("user_id", T.array_reduce("value_seq", "max").alias("seq_max"),
                    round6(T.array_reduce("value_seq", "mean")).alias("seq_mean"))


@query("P8_bucket_ids", f"""
SELECT {KEYS_SQL}, {Q.bucket('l_discount::FLOAT::DOUBLE', DISC_BOUNDS)} AS b_l_discount,
       {Q.bucket('l_quantity::FLOAT::DOUBLE', QTY_BOUNDS)} AS b_l_quantity FROM lineitem""")
def p8(spark, d):
    li = table(spark, d, "lineitem").select(*KEYS, "l_discount", "l_quantity")
    return FT.bucket_ids(li, {"l_discount": DISC_BOUNDS, "l_quantity": QTY_BOUNDS}).select(
        *KEYS, "b_l_discount", "b_l_quantity")


@query("P9_bucket_float_features", X.with_ctes(X.SAMPLES_SQL) + f"""
SELECT {KEYS_SQL}, {Q.bucket('p::FLOAT::DOUBLE', (0.1, 0.25, 0.5, 0.75, 0.9))} AS b_p FROM samples""")
def p9(spark, d):
    s = X.samples(spark, d).withColumn("p_shadow", F.col("p"))
    out, kept, _ = FT.bucket_float_features(s, ["p", "p_shadow"], {"p": (0.1, 0.25, 0.5, 0.75, 0.9),
                                                                  "p_shadow": (0.5,)}, skip_shadow=True)
    return out.select(*KEYS, *[f"b_{k}" for k in kept])


RATIO_DEFS = [(X.hcol("val", h), X.hcol("cnt", h), X.hcol("val", h)) for h in (1, 24)]


@query("P10_log_ratio", X.with_ctes(X.HORIZONS_SQL) + f"""
SELECT event_id, {Q.r6(Q.log_ratio(X.hcol('val', 1), X.hcol('cnt', 1)))} AS {X.hcol('val', 1)},
       {Q.r6(Q.log_ratio(X.hcol('val', 24), X.hcol('cnt', 24)))} AS {X.hcol('val', 24)}
FROM horizons""")
def p10(spark, d):
    h = X.horizons(spark, d)
    out, made = DV.apply_log_ratios(h, RATIO_DEFS)
    return out.select("event_id", *[round6(F.col(m)).alias(m) for m in made])


@query("P11_signed_delta", X.with_ctes(X.HORIZONS_SQL) + f"""
SELECT event_id, {Q.r6(Q.signed_delta(X.hcol('cnt', 1), X.hcol('cnt', 3)))} AS delta_ref,
       {Q.r6(Q.signed_delta(X.hcol('cnt', 1), X.hcol('cnt', 3), 'symmetric'))} AS delta_sym,
       {Q.r6(Q.signed_delta(X.hcol('cnt', 3), X.hcol('cnt', 1)))} AS delta_ref_down
FROM horizons""")
def p11(spark, d):
    h = X.horizons(spark, d)
    a, b = X.hcol("cnt", 1), X.hcol("cnt", 3)
    return h.select("event_id", round6(T.signed_delta(a, b)).alias("delta_ref"),
                    round6(T.signed_delta(a, b, "symmetric")).alias("delta_sym"),
                    round6(T.signed_delta(b, a)).alias("delta_ref_down"))


LADDER = (1, 3, 6, 12, 24, 48, 72)
# bounds exist for every step except cnt 3->6: that step is skipped without
# advancing, so the next output compares 3h with 12h
DELTA_SPECS = {f"fc_evt_{m}_{a}_{b}h_user_all": DELTA_BOUNDS
               for m in ("cnt", "val") for a in LADDER for b in LADDER if a < b}
DELTA_SPECS.pop("fc_evt_cnt_3_6h_user_all")


def _p12_outputs():
    outs = []
    for m in ("cnt", "val"):
        prev = LADDER[0]
        for cur in LADDER[1:]:
            name = f"fc_evt_{m}_{prev}_{cur}h_user_all"
            if name not in DELTA_SPECS:
                continue
            outs.append((m, prev, cur, name))
            prev = cur
    return outs


def _p12_sql():
    cols = []
    for m, a, b, name in _p12_outputs():
        ca, cb = f"fc_evt_{m}_{a}h_user_all", f"fc_evt_{m}_{b}h_user_all"
        e = (f"CASE WHEN {ca} <= -1 OR {cb} <= -1 THEN -1.0::DOUBLE "
             f"ELSE {Q.signed_delta(f'{ca}::DOUBLE / {float(a)}', f'{cb}::DOUBLE / {float(b)}')} END")
        cols.append(f"{Q.r6(e)} AS {name}")
    return X.with_ctes(X.HORIZONS_SQL) + "SELECT event_id, " + ",\n  ".join(cols) + " FROM horizons"


@query("P12_horizon_deltas", _p12_sql())
def p12(spark, d):
    h = X.horizons(spark, d)
    out, made = DV.horizon_deltas(h, {"fc_evt_cnt": LADDER, "fc_evt_val": LADDER}, "user", DELTA_SPECS)
    return out.select("event_id", *[round6(F.col(m)).alias(m) for m in made])


TD_NAMES = [X.hcol("cnt", 24), X.hcol("cnt", 48), X.hcol("cnt", 72)]
TD_SCALES = [1.0, 2.0, 3.0]


def _p13_sql(mode):
    cols = []
    for i in range(2):
        fi = f"({TD_NAMES[i]}::DOUBLE / {TD_SCALES[i]})"
        fj = f"({TD_NAMES[i + 1]}::DOUBLE / {TD_SCALES[i + 1]})"
        second = TD_NAMES[i] if mode == "reference" else TD_NAMES[i + 1]
        dm = "reference" if mode == "reference" else "symmetric"
        cols.append(f"{Q.r6(Q.signed_delta(fi, fj, dm))} AS delta_day_{i + 1}")
        cols.append(f"{Q.r6(Q.log1p(fi) + ' - ' + Q.log1p(f'{second}::DOUBLE / {TD_SCALES[i + 1]}'))} "
                    f"AS ratio_day_{i + 1}")
    return X.with_ctes(X.HORIZONS_SQL) + "SELECT event_id, " + ", ".join(cols) + " FROM horizons"


def _p13(spark, d, mode):
    h = X.horizons(spark, d)
    out, made = DV.time_delta_ratio(h, TD_NAMES, TD_SCALES, "day", mode)
    return out.select("event_id", *[round6(F.col(m)).alias(m) for m in made])


@query("P13_time_delta_ratio", _p13_sql("corrected"))
def p13(spark, d):
    return _p13(spark, d, "corrected")


@query("P13_time_delta_ratio_reference", _p13_sql("reference"))
def p13_ref(spark, d):
    return _p13(spark, d, "reference")


TD_SPECS = {"delta_day_1": DELTA_BOUNDS, "ratio_day_1": RATIO_BOUNDS, "delta_day_2": DELTA_BOUNDS,
            "ratio_day_2": RATIO_BOUNDS}


def _p14_sql():
    raw = []
    for i in range(2):
        fi = f"({TD_NAMES[i]}::DOUBLE / {TD_SCALES[i]})"
        fj = f"({TD_NAMES[i + 1]}::DOUBLE / {TD_SCALES[i + 1]})"
        raw.append(f"{Q.signed_delta(fi, fj, 'symmetric')} AS delta_day_{i + 1}")
        raw.append(f"{Q.log1p(fi)} - {Q.log1p(fj)} AS ratio_day_{i + 1}")
    cols = ", ".join(f"{Q.bucket(f'{n}::FLOAT::DOUBLE', b)} AS b_{n}" for n, b in TD_SPECS.items())
    return (X.with_ctes(X.HORIZONS_SQL) + "SELECT event_id, " + cols +
            " FROM (SELECT event_id, " + ", ".join(raw) + " FROM horizons)")


@query("P14_bucket_time_deltas", _p14_sql())
def p14(spark, d):
    h = X.horizons(spark, d)
    out, kept, _ = DV.bucket_time_deltas(h, TD_NAMES, ["day"], TD_SPECS, scales=TD_SCALES, mode="corrected")
    return out.select("event_id", *[f"b_{k}" for k in kept])


@query("P15_column_or_default", X.with_ctes(X.SAMPLES_SQL) + f"""
SELECT {KEYS_SQL}, gmv, 0 AS fc_missing FROM samples""")
def p15(spark, d):
    s = X.samples(spark, d)
    return s.select(*KEYS, T.column_or_default(s, "gmv").alias("gmv"),
                    T.column_or_default(s, "fc_missing", 0).alias("fc_missing"))


@query("P16_classify_feature", X.with_ctes(X.FEATURE_NAMES_SQL) + """
SELECT name, CASE WHEN suffix(name, '_vmid_all') THEN
                    CASE WHEN suffix(name, '_campaign_id_vmid_all') THEN 'camp_x_vmid' ELSE 'vmid' END
                  WHEN suffix(name, '_campaign_id_all') THEN 'camp'
                  WHEN suffix(name, '_camp') THEN 'camp'
                  WHEN suffix(name, '_camp_vmid') THEN 'camp_x_vmid'
                  ELSE 'other' END AS kind
FROM feature_names""")
def p16(spark, d):
    return X.feature_names(spark, d).select("name", FT.classify_feature("name").alias("kind"))


@query("P17_skip_shadow_columns", X.with_ctes(X.SAMPLES_SQL) + f"""
SELECT {KEYS_SQL}, gmv, roi1 FROM samples""")
def p17(spark, d):
    s = X.samples(spark, d).select(*KEYS, "gmv", F.col("cost").alias("fc_cost_shadow"), "roi1")
    kept, _skipped = FT.skip_columns_containing(s.columns, "shadow")
    return s.select(*kept)


@query("P18_step_pair_mean", f"""
SELECT event_id, {Q.r6('(value + value_last) / 2.0')} AS pair_mean, {Q.r6('(value + value_last) / 0.2')} AS pair_mean_ref
FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS value_last FROM events)""")
def p18(spark, d):
    ev = previous_value(table(spark, d, "events"), "user_id", "event_id", ["value"], ts="ts")
    return ev.select("event_id", round6(T.step_pair_mean("value", "value_last")).alias("pair_mean"),
                     round6(T.step_pair_mean("value", "value_last", 0.2)).alias("pair_mean_ref"))


@query("P19_cast_int", X.with_ctes(X.SEQ20_SQL) + """
SELECT user_id, trunc(value_seq[1])::INTEGER AS first_int, trunc(value_seq[20])::INTEGER AS last_int FROM seq20""")
def p19(spark, d):
    s = X.seq20(spark, d)
    return s.select("user_id", T.cast_int("value_seq", first_slot=True).alias("first_int"),
                    T.cast_int(F.element_at("value_seq", 20)).alias("last_int"))


@query("P20_hash_slot", "SELECT c_custkey % 97 AS slot, count(*) AS n FROM customer GROUP BY 1")
def p20(spark, d):
    c = table(spark, d, "customer")
    return c.select(FT.hash_slot("c_custkey", 97, identity=True).alias("slot")).groupBy("slot") \
        .agg(F.count(F.lit(1)).alias("n"))


@query("P20_hash_slot_xxhash")
def p20_hash(spark, d):
    c = table(spark, d, "customer")
    return c.select(FT.hash_slot("c_mktsegment", 10).alias("segment_slot"),
                    FT.hash_slot("c_name", 10000).alias("name_slot")) \
        .groupBy("segment_slot").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name_slot").alias("name_slots"))


CENTERS = T.bucket_centers(PRICE_BOUNDS, 0.0, 12.0)


@query("P21_bucket_centers", X.with_ctes(X.SAMPLES_SQL) + f"""
SELECT {KEYS_SQL}, {Q.r6(f"({Q.arr(CENTERS)})[{PRICE_BUCKET_SQL} + 1]")} AS center FROM samples""")
def p21(spark, d):
    s = X.samples(spark, d)
    centers = T.bucket_centers_col(T.bounds_literal(PRICE_BOUNDS), 0.0, 12.0)
    return s.select(*KEYS, round6(F.element_at(centers, _price_bucket() + 1)).alias("center"))


@query("P22_soft_bucket", X.with_ctes(X.SAMPLES_SQL) + f"""
, a AS (SELECT {KEYS_SQL}, list_transform({Q.arr(CENTERS)}, lambda c: -abs({Q.compress('l_extendedprice')} - c) / 0.8) AS lg
        FROM samples),
e AS (SELECT {KEYS_SQL}, list_transform(lg, lambda z: exp(z - list_max(lg))) AS ex FROM a)
SELECT {KEYS_SQL}, {Q.r6(f"list_sum(list_transform(list_zip(ex, {Q.arr(CENTERS)}), lambda t: t[1] / list_sum(ex) * t[2]))")} AS soft_value,
       {Q.r6("list_max(ex) / list_sum(ex)")} AS top_weight
FROM e""")
def p22(spark, d):
    s = X.samples(spark, d)
    c = T.bounds_literal(CENTERS)
    w = F.col("w")
    s = s.select(*KEYS, F.explode(F.array(T.soft_bucket_weights(T.compress("l_extendedprice"), c, 0.8))).alias("w"))  # computed once for both
    return s.select(*KEYS, round6(T.dot(w, c)).alias("soft_value"), round6(F.array_max(w)).alias("top_weight"))


VECTORS = [[c, c * c, 1.0] for c in CENTERS]


@query("P22_soft_bucket_vector", X.with_ctes(X.SAMPLES_SQL) + f"""
, a AS (SELECT {KEYS_SQL}, list_transform({Q.arr(CENTERS)}, lambda c: -abs({Q.compress('l_extendedprice')} - c) / 0.8) AS lg
        FROM samples),
e AS (SELECT {KEYS_SQL}, list_transform(lg, lambda z: exp(z - list_max(lg))) AS ex FROM a)
SELECT {KEYS_SQL}, {Q.r6(f"list_sum(list_transform(list_zip(ex, {Q.arr(CENTERS)}), lambda t: t[1] / list_sum(ex) * t[2]))")} AS v1,
       {Q.r6(f"list_sum(list_transform(list_zip(ex, {Q.arr(CENTERS)}), lambda t: t[1] / list_sum(ex) * t[2] * t[2]))")} AS v2,
       1.0::DOUBLE AS v3 FROM e""")
def p22_vector(spark, d):
    s = X.samples(spark, d)
    table = F.array(*[T.bounds_literal(v) for v in VECTORS])
    v = T.soft_bucket_vector(T.compress("l_extendedprice"), T.bounds_literal(CENTERS), table, 3, 0.8)
    return s.select(*KEYS, F.explode(F.array(v)).alias("v")).select(  # computed once for its three elements
        *KEYS, *[round6(F.element_at("v", i + 1)).alias(f"v{i + 1}") for i in range(3)])


@query("P3_vector_encode", X.with_ctes(X.SAMPLES_SQL) + f"""
, b AS (SELECT {KEYS_SQL}, convert_label, big_label, {PRICE_BUCKET_SQL} AS bucket FROM samples),
t AS (SELECT bucket, (sum(convert_label) + 10.0 * (SELECT avg(convert_label) FROM b)) / (count(*) + 10.0) AS x,
             (sum(big_label) + 10.0 * (SELECT avg(big_label) FROM b)) / (count(*) + 10.0) AS y FROM b GROUP BY bucket)
SELECT {KEYS_SQL}, {Q.r6('x')} AS x, {Q.r6('y')} AS y FROM b JOIN t ON b.bucket = t.bucket""")
def p3_vector(spark, d):
    """Two label means per bucket as a two wide table, looked up per row."""
    s = X.samples(spark, d).select(*KEYS, "convert_label", "big_label", _price_bucket())
    table = FT.bucket_target_vectors(s, "price", "bucket", ["convert_label", "big_label"])
    out = FT.vector_encode(s, "price", "bucket", table, 2, size=len(PRICE_BOUNDS) + 1)
    return out.select(*KEYS, round6(F.element_at("vector", 1)).alias("x"), round6(F.element_at("vector", 2)).alias("y"))


@query("P20_slot_vectors", """
WITH c AS (SELECT c_custkey, c_acctbal, ('0x' || substr(md5(c_mktsegment), 1, 8))::BIGINT % 97 AS slot FROM customer),
t AS (SELECT slot, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM c WHERE slot % 2 = 0 GROUP BY slot)
SELECT c_custkey, coalesce(lo, 0.0) AS lo, coalesce(hi, 0.0) AS hi FROM c LEFT JOIN t ON c.slot = t.slot""")
def p20_vectors(spark, d):
    """Hash slots looked up in a two wide table that lacks every other slot."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", FT.hash_slot("c_mktsegment", 97, portable=True).alias("slot"))
    t = c.filter("slot % 2 = 0").groupBy(F.lit("segment").alias("feature"), F.col("slot").alias("bucket")).agg(
        F.array(F.min("c_acctbal"), F.max("c_acctbal")).alias("vector"))
    out = FT.vector_encode(c, "segment", "slot", t, 2, size=97)
    return out.select("c_custkey", F.element_at("vector", 1).alias("lo"), F.element_at("vector", 2).alias("hi"))


@query("P23_assemble", X.with_ctes(X.SEQ20_SQL) + """
SELECT user_id, list_concat([n_valid::DOUBLE], value_seq) AS features FROM seq20""")
def p23(spark, d):
    return FT.assemble_df(X.seq20(spark, d), ["n_valid", "value_seq"], lengths={"value_seq": 20}).select("user_id", "features")



LONG_SPECS = {"l_quantity": QTY_BOUNDS, "l_extendedprice": PRICE_BOUNDS, "l_discount": DISC_BOUNDS,
              "l_tax": TAX_BOUNDS, "o_totalprice": (8.0, 10.0, 11.0, 12.0, 13.0)}
LONG_LOG = ("l_extendedprice", "o_totalprice")


def _p5_long_sql() -> str:
    sel = []
    for f, b in LONG_SPECS.items():
        x = Q.compress(f) if f in LONG_LOG else f"{f}::FLOAT::DOUBLE"
        sel.append(f"SELECT l_orderkey, l_linenumber, '{f}' AS feature, {Q.bucket(x, b)} AS bucket FROM w")
    return ("WITH w AS (SELECT l.l_orderkey, l.l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
            "o_totalprice FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)\n" + " UNION ALL ".join(sel))


@query("P5_bucket_features_long", _p5_long_sql())
def p5_long(spark, d):
    """P5 in long form, the layout for very wide feature sets: features of
    lineitem and its order unpivoted to (keys, feature, value), bounds joined
    from the broadcast spec, one bucketize expression for all features."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                           "l_discount", "l_tax")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    wide = li.join(o, "l_orderkey")
    long = FT.to_long(wide, ["l_orderkey", "l_linenumber"], list(LONG_SPECS))
    spec = FT.spec_table(spark, LONG_SPECS, log_names=LONG_LOG)
    return FT.bucketize_long(long, spec).select("l_orderkey", "l_linenumber", "feature", "bucket")
