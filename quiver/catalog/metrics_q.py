"""Aggregations and metrics: A1-A16, A18 (A17 lives with the running stats)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiver.catalog import sqlbits as Q
from quiver.catalog.registry import query
from quiver.functions import labels as L
from quiver.operators import features as FT
from quiver.plans import metrics as M
from quiver.session import round6, table
from quiver.sources import fixtures as X

S = X.with_ctes(X.SAMPLES_SQL)
SD = X.with_ctes(X.SCORED_DOCS_SQL)
TASKS = {"convert": ("convert_label", "p"), "roi1": ("roi1", "p")}


def _lt(x: str) -> str:
    return f"(CASE WHEN ({x}) <= 100.0 THEN ({x}) ELSE 100.0 + ln(({x}) - 100.0 + 1.0) END)"


CLIP = "least(greatest({x}, 0.0::DOUBLE), 300.0::DOUBLE)"
BIN_SQL = {"convert": f"CASE WHEN {CLIP.format(x='convert_label')} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
           "roi1": f"CASE WHEN {CLIP.format(x='roi1')} >= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"}
LABEL_SQL = {"convert": "convert_label", "roi1": "roi1"}


@query("A1_masked_mean", S + f"""
SELECT {Q.r6("avg(CASE WHEN l_returnflag = 'R' THEN gmv END)")} AS gmv_returned,
       {Q.r6("avg(CASE WHEN l_linestatus = 'O' THEN roi1 END)")} AS roi1_open FROM samples""")
def a1(spark, d):
    s = X.samples(spark, d)
    return s.agg(round6(M.masked_mean("gmv", F.col("l_returnflag") == "R")).alias("gmv_returned"),
                 round6(M.masked_mean("roi1", F.col("l_linestatus") == "O")).alias("roi1_open"))


PRICE_BOUNDS = (0.001, 5.0, 8.0, 10.0, 10.5, 11.0)
A2_IDS = list(range(0, 8))


def _a2_frame(spark, d):
    s = X.samples(spark, d)
    reg_label, reg_pred = L.log_tail("roi1"), L.log_tail(F.greatest(F.col("p"), F.lit(0.0)))
    return s.select("l_extendedprice", "p", ((reg_label - reg_pred) * (reg_label - reg_pred)).alias("reg_loss"),
                    F.abs(reg_label - reg_pred).alias("ideal_loss"), (F.col("big_label") / 5.0).alias("reward"),
                    (F.col("p") - F.col("convert_label")).alias("bias"), "l_linenumber")


A2_CTE = f"""x AS (SELECT l_extendedprice, p, l_linenumber,
            ({_lt('roi1')} - {_lt('greatest(p, 0.0::DOUBLE)')}) * ({_lt('roi1')} - {_lt('greatest(p, 0.0::DOUBLE)')}) AS reg_loss,
            abs({_lt('roi1')} - {_lt('greatest(p, 0.0::DOUBLE)')}) AS ideal_loss,
            big_label / 5.0::DOUBLE AS reward, p - convert_label AS bias FROM samples)"""


@query("A2_stats_by_bucket", X.with_ctes(X.SAMPLES_SQL, A2_CTE) + f"""
, g AS (SELECT {Q.bucket(Q.compress('l_extendedprice'), PRICE_BOUNDS)} AS bucket, count(*) AS n, avg(p) AS pred_mean,
               avg(reg_loss) AS reg_loss_mean, avg(ideal_loss) AS ideal_loss_mean, avg(reward) AS reward_mean,
               avg(bias) AS bias_mean FROM x GROUP BY 1),
ids AS (SELECT range::INTEGER AS bucket FROM range(0, 8))
SELECT 'l_extendedprice' AS feature, ids.bucket, {Q.r6('pred_mean')} AS pred_mean, {Q.r6('reg_loss_mean')} AS reg_loss_mean,
       {Q.r6('ideal_loss_mean')} AS ideal_loss_mean, {Q.r6('coalesce(n::DOUBLE / (SELECT sum(n) FROM g), 0.0)')} AS share,
       {Q.r6('reward_mean')} AS reward_mean, {Q.r6('bias_mean')} AS bias_mean
FROM ids LEFT JOIN g ON ids.bucket = g.bucket""")
def a2(spark, d):
    x = _a2_frame(spark, d)
    out = M.stats_by_bucket(x, "l_extendedprice", PRICE_BOUNDS, A2_IDS, "p", "reg_loss", "ideal_loss", "reward", "bias")
    return out.select("feature", "bucket", *[round6(F.col(c)).alias(c) for c in out.columns[2:]])


A2_MANY = {"l_extendedprice": (PRICE_BOUNDS, A2_IDS, True), "big_label": ((10.0, 50.0, 100.0), [0, 1, 3, 5], False),
           "l_linenumber": ((2.0, 4.0, 6.0), [1, 2], False)}


def _a2_many_sql() -> str:
    parts = []
    for f, (bounds, ids, log) in A2_MANY.items():
        src = {"big_label": "reward * 5.0"}.get(f, f)
        b = Q.bucket(Q.compress(src) if log else f"({src})::DOUBLE", bounds)
        parts.append(f"""SELECT '{f}' AS feature, ids.bucket, {Q.r6('pred_mean')} AS pred_mean, {Q.r6('reg_loss_mean')} AS reg_loss_mean,
       {Q.r6('ideal_loss_mean')} AS ideal_loss_mean, {Q.r6('coalesce(n::DOUBLE / (SELECT count(*) FROM x), 0.0)')} AS share,
       {Q.r6('reward_mean')} AS reward_mean, {Q.r6('bias_mean')} AS bias_mean
FROM (SELECT unnest({ids})::INTEGER AS bucket) ids LEFT JOIN (
  SELECT {b} AS bucket, count(*) AS n, avg(p) AS pred_mean, avg(reg_loss) AS reg_loss_mean, avg(ideal_loss) AS ideal_loss_mean,
         avg(reward) AS reward_mean, avg(bias) AS bias_mean FROM x GROUP BY 1) g ON ids.bucket = g.bucket""")
    return X.with_ctes(X.SAMPLES_SQL, A2_CTE) + " UNION ALL ".join(parts)


@query("A2_stats_by_buckets_of_many_features", _a2_many_sql())
def a2_many(spark, d):
    x = _a2_frame(spark, d).withColumn("big_label", F.col("reward") * 5.0)
    out = M.stats_by_buckets(x, A2_MANY, "p", "reg_loss", "ideal_loss", "reward", "bias")
    return out.select("feature", "bucket", *[round6(F.col(c)).alias(c) for c in out.columns[2:]])


@query("A3_stats_by_segment", X.with_ctes(X.SAMPLES_SQL, A2_CTE) + f"""
, g AS (SELECT l_linenumber::BIGINT AS segment, count(*) AS n, avg(p) AS pred_mean, avg(reg_loss) AS reg_loss_mean,
               avg(ideal_loss) AS ideal_loss_mean, avg(reward) AS reward_mean FROM x GROUP BY 1),
ids AS (SELECT unnest([1, 2, 3, 9])::BIGINT AS segment)
SELECT ids.segment, {Q.r6('pred_mean')} AS pred_mean, {Q.r6('reg_loss_mean')} AS reg_loss_mean,
       {Q.r6('ideal_loss_mean')} AS ideal_loss_mean, {Q.r6('coalesce(n::DOUBLE / (SELECT sum(n) FROM g), 0.0)')} AS share,
       {Q.r6('reward_mean')} AS reward_mean
FROM ids LEFT JOIN g ON ids.segment = g.segment""")
def a3(spark, d):
    x = _a2_frame(spark, d)
    out = M.stats_by_segment(x, "l_linenumber", [1, 2, 3, 9], "p", "reg_loss", "ideal_loss", "reward")
    return out.select("segment", *[round6(F.col(c)).alias(c) for c in out.columns[1:]])


PRED_SQL = "CASE WHEN p >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


@query("A4_accuracy", SD + f"""
SELECT {Q.r6(f"CASE WHEN sum(1.0 - toxic) > 0 THEN sum(CASE WHEN {PRED_SQL} = label THEN 1.0 ELSE 0.0 END * (1.0 - toxic)) / greatest(sum(1.0 - toxic), 1e-5) ELSE 1.0 END")} AS accuracy,
       {Q.r6(f"CASE WHEN sum(0.0 * toxic) > 0 THEN 0.0 ELSE 1.0 END")} AS accuracy_empty_mask
FROM scored_docs""")
def a4(spark, d):
    s = X.scored_docs(spark, d).withColumn("pred", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0))
    return s.agg(round6(M.accuracy("pred", "label", 1.0 - F.col("toxic"))).alias("accuracy"),
                 round6(M.accuracy("pred", "label", F.col("toxic") * 0.0)).alias("accuracy_empty_mask"))


@query("A5_precision", SD + f"""
SELECT {Q.r6(f"CASE WHEN sum({PRED_SQL}) > 0 THEN sum({PRED_SQL} * label) / greatest(sum({PRED_SQL}), 1e-5) ELSE 1.0 END")} AS precision
FROM scored_docs""")
def a5(spark, d):
    s = X.scored_docs(spark, d).withColumn("pred", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0))
    return s.agg(round6(M.precision("pred", "label")).alias("precision"))


@query("A6_recall", SD + f"""
SELECT {Q.r6(f"CASE WHEN sum(label) > 0 THEN sum({PRED_SQL} * label) / greatest(sum(label), 1e-5) ELSE 1.0 END")} AS recall
FROM scored_docs""")
def a6(spark, d):
    s = X.scored_docs(spark, d).withColumn("pred", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0))
    return s.agg(round6(M.recall("pred", "label")).alias("recall"))


PAIR_SQL = "CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END"


@query("A7_pairwise_auc", SD + f"""
SELECT {Q.r6(f"CASE WHEN count(*) > 0 THEN sum({PAIR_SQL}) / count(*) ELSE 1.0 END")} AS auc
FROM scored_docs a JOIN scored_docs b ON a.label > b.label""")
def a7(spark, d):
    return M.pairwise_auc(X.scored_docs(spark, d), "p", "label").select(round6(F.col("auc")).alias("auc"))


@query("A7_pairwise_auc_graded", SD + f"""
SELECT {Q.r6(f"CASE WHEN count(*) > 0 THEN sum({PAIR_SQL}) / count(*) ELSE 1.0 END")} AS auc
FROM (SELECT p, label + toxic AS g FROM scored_docs) a JOIN (SELECT p, label + toxic AS g FROM scored_docs) b
  ON a.g > b.g""")
def a7g(spark, d):
    s = X.scored_docs(spark, d).withColumn("graded", F.col("label") + F.col("toxic"))
    return M.pairwise_auc(s, "p", "graded").select(round6(F.col("auc")).alias("auc"))


@query("A7_pairwise_auc_in_batches", SD + f"""
, bs AS (SELECT DISTINCT doc_id // 64 AS batch_id FROM scored_docs),
pr AS (SELECT a.doc_id // 64 AS batch_id, sum({PAIR_SQL}) AS conc, count(*) AS pairs
       FROM scored_docs a JOIN scored_docs b ON a.doc_id // 64 = b.doc_id // 64 AND a.label > b.label GROUP BY 1)
SELECT bs.batch_id, {Q.r6('coalesce(conc / pairs, 1.0)')} AS auc FROM bs LEFT JOIN pr ON bs.batch_id = pr.batch_id""")
def a7b(spark, d):
    s = X.scored_docs(spark, d).withColumn("batch_id", F.floor(F.col("doc_id") / 64).cast("bigint"))
    out = M.pairwise_auc_in_batches(s, "p", "label", "batch_id")
    return out.select("batch_id", round6(F.col("auc")).alias("auc"))


@query("A7_pairwise_auc_in_batches_graded", SD + f"""
, g AS (SELECT doc_id // 64 AS batch_id, p, 2.0 * label + toxic AS gr, p > 0.05 AS m FROM scored_docs),
bs AS (SELECT DISTINCT batch_id FROM g),
pr AS (SELECT a.batch_id, sum({PAIR_SQL}) AS conc, count(*) AS pairs
       FROM g a JOIN g b ON a.batch_id = b.batch_id AND a.gr > b.gr WHERE a.m AND b.m GROUP BY 1)
SELECT bs.batch_id, {Q.r6('coalesce(conc / pairs, 1.0)')} AS auc FROM bs LEFT JOIN pr ON bs.batch_id = pr.batch_id""")
def a7bg(spark, d):
    """A7 in batches of 64 documents with graded labels (2 * quality + toxic)
    and a mask (score above 0.05) -- the reference's in-batch form."""
    s = X.scored_docs(spark, d).select(F.floor(F.col("doc_id") / 64).cast("bigint").alias("batch_id"), "p",
                                      (F.col("label") * 2.0 + F.col("toxic")).alias("graded"),
                                      F.when(F.col("p") > 0.05, 1.0).otherwise(0.0).alias("mask"))
    out = M.pairwise_auc_in_batches(s, "p", "graded", "batch_id", mask="mask")
    return out.select("batch_id", round6(F.col("auc")).alias("auc"))


@query("A8_mean_metrics", S + f"""
SELECT {Q.r6('avg(gmv)')} AS mean_gmv, {Q.r6('avg(cost)')} AS mean_cost, {Q.r6('avg(roi1)')} AS mean_roi1,
       {Q.r6('avg(p)')} AS mean_p FROM samples""")
def a8(spark, d):
    out = M.mean_metrics(X.samples(spark, d), ["gmv", "cost", "roi1", "p"])
    return out.select(*[round6(F.col(c)).alias(c) for c in out.columns])


def _roi_frame(spark, d):
    s = X.samples(spark, d)
    return s.select("p", L.binarize("roi1", L.clip("roi1")).alias("y"),
                    L.log_tail("roi1").alias("reg_label"), L.log_tail(F.greatest(F.col("p"), F.lit(0.0))).alias("reg_pred"))


def _acc_sql(t: str, y: str) -> str:
    return Q.r6(f"avg(CASE WHEN (CASE WHEN p >= {t} THEN 1.0 ELSE 0.0 END) = ({y}) THEN 1.0 ELSE 0.0 END)")


@query("A9_accuracy_sweep", S + "SELECT " + ", ".join(
    f'{_acc_sql(t, BIN_SQL["roi1"])} AS "acc_threshold_{t}"' for t in M.SWEEP_THRESHOLDS) + " FROM samples")
def a9(spark, d):
    r = _roi_frame(spark, d)
    out = r.agg(*M.accuracy_sweep("p", "y"))
    return out.select(*[round6(F.col(f"`{c}`")).alias(c) for c in out.columns])


@query("A10_confusion", S + f"""
SELECT count(*) FILTER (WHERE p >= 0.5 AND ({BIN_SQL['convert']}) > 0.5) AS TP,
       count(*) FILTER (WHERE p >= 0.5 AND NOT ({BIN_SQL['convert']}) > 0.5) AS FP,
       count(*) FILTER (WHERE NOT p >= 0.5 AND NOT ({BIN_SQL['convert']}) > 0.5) AS TN,
       count(*) FILTER (WHERE NOT p >= 0.5 AND ({BIN_SQL['convert']}) > 0.5) AS FN FROM samples""")
def a10(spark, d):
    s = X.samples(spark, d).select("p", L.binarize("convert", L.clip("convert_label")).alias("y"))
    return s.agg(*M.confusion("p", "y"))


@query("A11_mse", S + f"""
SELECT {Q.r6(f"avg(({_lt('roi1')} - {_lt('greatest(p, 0.0::DOUBLE)')}) * ({_lt('roi1')} - {_lt('greatest(p, 0.0::DOUBLE)')}))")} AS mse
FROM samples""")
def a11(spark, d):
    r = _roi_frame(spark, d)
    return r.agg(round6(M.mse("reg_label", "reg_pred")).alias("mse"))


def _auc_sql(bin_expr: str, y: str) -> str:
    return S + f""", b AS (SELECT {bin_expr} AS bin, CASE WHEN ({y}) > 0.5 THEN 1.0 ELSE 0.0 END AS pos,
                 CASE WHEN ({y}) > 0.5 THEN 0.0 ELSE 1.0 END AS neg FROM samples),
g AS (SELECT bin, sum(pos) AS pos, sum(neg) AS neg FROM b GROUP BY bin),
c AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS nb FROM g)
SELECT {Q.r6('sum(pos * (nb + neg / 2.0)) / (sum(pos) * sum(neg))')} AS auc FROM c"""


def roc_bin_sql(p: str) -> str:
    return f"least(greatest(ceil({p} * 199.0), 0), 200)::INTEGER"


def grid4_bin_sql(p: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {p} > {t} THEN 1 ELSE 0 END" for t in M.GRID4) + ")"


ROC_BIN_SQL, GRID4_BIN_SQL = roc_bin_sql("p"), grid4_bin_sql("p")


@query("A12_binned_auc", _auc_sql(ROC_BIN_SQL, BIN_SQL["roi1"]))
def a12(spark, d):
    r = _roi_frame(spark, d)
    return M.binned_auc(r, "p", "y").select(round6(F.col("auc")).alias("auc"))


@query("A13_auc_grid4", _auc_sql(GRID4_BIN_SQL, BIN_SQL["roi1"]))
def a13(spark, d):
    r = _roi_frame(spark, d)
    return M.binned_auc(r, "p", "y", grid=M.GRID4).select(round6(F.col("auc")).alias("auc"))


@query("A14_recall_at", S + f"""
SELECT {Q.r6(f"count(*) FILTER (WHERE p >= 0.5 AND ({BIN_SQL['roi1']}) > 0.5)::DOUBLE / nullif(count(*) FILTER (WHERE ({BIN_SQL['roi1']}) > 0.5), 0)")} AS recall
FROM samples""")
def a14(spark, d):
    r = _roi_frame(spark, d)
    return r.agg(round6(M.recall_at("p", "y")).alias("recall"))


@query("A15_prediction_label_means", S + f"""
SELECT {Q.r6(f"avg({_lt('greatest(p, 0.0::DOUBLE)')})")} AS reg_pred_mean, {Q.r6('avg(p)')} AS binary_pred_mean,
       {Q.r6(f"avg({_lt('roi1')})")} AS reg_label_mean, {Q.r6(f"avg({BIN_SQL['roi1']})")} AS binary_label_mean FROM samples""")
def a15(spark, d):
    r = _roi_frame(spark, d)
    return r.agg(round6(F.avg("reg_pred")).alias("reg_pred_mean"), round6(F.avg("p")).alias("binary_pred_mean"),
                 round6(F.avg("reg_label")).alias("reg_label_mean"), round6(F.avg("y")).alias("binary_label_mean"))


def _a16_sql(samples: str = S, score: str = "p") -> str:
    """The report over a ``samples`` table; ``score`` is each task's score column, with ``{}`` for the task."""
    parts = []
    for task in ("convert", "roi1"):
        lab, p = LABEL_SQL[task], score.format(task)
        parts.append(f"SELECT '{task}' AS task, {p} AS score, {CLIP.format(x=lab)} AS task_label, "
                     f"{BIN_SQL[task]} AS binary_label, {_lt(lab)} AS reg_label, {_lt(f'greatest({p}, 0.0::DOUBLE)')} AS reg_pred "
                     f"FROM samples")
    t = "t AS (" + " UNION ALL ".join(parts) + ")"
    accs = ", ".join(f"avg(CASE WHEN (CASE WHEN score >= {v} THEN 1.0 ELSE 0.0 END) = binary_label THEN 1.0 ELSE 0.0 END)"
                     f" AS \"acc_threshold_{v}\"" for v in M.SWEEP_THRESHOLDS)
    m = f"""m AS (SELECT task, {accs},
        sum(CASE WHEN score >= 0.5 AND binary_label > 0.5 THEN 1.0 ELSE 0.0 END) AS "TP",
        sum(CASE WHEN score >= 0.5 AND NOT binary_label > 0.5 THEN 1.0 ELSE 0.0 END) AS "FP",
        sum(CASE WHEN NOT score >= 0.5 AND NOT binary_label > 0.5 THEN 1.0 ELSE 0.0 END) AS "TN",
        sum(CASE WHEN NOT score >= 0.5 AND binary_label > 0.5 THEN 1.0 ELSE 0.0 END) AS "FN",
        avg((reg_label - reg_pred) * (reg_label - reg_pred)) AS mse,
        avg(reg_pred) AS reg_pred_mean, avg(score) AS binary_pred_mean, avg(reg_label) AS reg_label_mean,
        avg(binary_label) AS binary_label_mean, avg(task_label) AS label_mean, avg(score) AS score_mean
        FROM t GROUP BY task)"""

    def auc_cte(name, bin_expr):
        return f"""{name}_b AS (SELECT task, {bin_expr} AS bin, sum(CASE WHEN binary_label > 0.5 THEN 1.0 ELSE 0.0 END) AS pos,
                 sum(CASE WHEN binary_label > 0.5 THEN 0.0 ELSE 1.0 END) AS neg FROM t GROUP BY task, bin),
{name}_c AS (SELECT task, pos, neg, coalesce(sum(neg) OVER (PARTITION BY task ORDER BY bin
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS nb FROM {name}_b),
{name} AS (SELECT task, sum(pos * (nb + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0.0) AS v FROM {name}_c GROUP BY task)"""
    w = """w AS (SELECT m.*, roc.v AS auc, grid4.v AS auc_grid4, "TP" / nullif("TP" + "FN", 0.0) AS recall
         FROM m JOIN roc ON m.task = roc.task JOIN grid4 ON m.task = grid4.task)"""
    sel = " UNION ALL ".join(f"SELECT task, '{k}' AS metric, {Q.r6(chr(34) + k + chr(34))} AS value FROM w"
                             for k in M.REPORT_METRICS)
    return (samples + ", " + t + ",\n" + m + ",\n" + auc_cte("roc", roc_bin_sql("score")) + ",\n" +
            auc_cte("grid4", grid4_bin_sql("score")) + ",\n" + w + "\n" + sel)


@query("A16_evaluation_report", _a16_sql())
def a16(spark, d):
    rep = M.evaluation_report(X.samples(spark, d), TASKS)
    return rep.select("task", "metric", round6(F.col("value")).alias("value"))


SPECS_A18 = {"l_quantity": (1.0, 5.0, 10.0, 20.0, 30.0, 40.0, 50.0), "l_extendedprice": PRICE_BOUNDS,
             "l_discount": (0.0, 0.02, 0.05, 0.08, 0.1), "l_tax": (0.0, 0.04, 0.08)}


def _long_bucketed(spark, d):
    li = table(spark, d, "lineitem")
    long = FT.to_long(li, [], list(SPECS_A18))
    return FT.bucketize_long(long, FT.spec_table(spark, SPECS_A18, log_names=["l_extendedprice"]))


def _a18_long_sql() -> str:
    sel = []
    for f, b in SPECS_A18.items():
        x = Q.compress(f) if f == "l_extendedprice" else f"{f}::FLOAT::DOUBLE"
        sel.append(f"SELECT '{f}' AS feature, {x} AS x, {Q.bucket(x, b)} AS bucket FROM lineitem")
    return "lg AS (" + " UNION ALL ".join(sel) + ")"


@query("A18_feature_summary", X.with_ctes(_a18_long_sql()) + f"""
SELECT feature, {Q.r6('avg(x)')} AS value_mean, {Q.r6('avg(bucket::DOUBLE)')} AS bucket_mean, count(*) AS n
FROM lg GROUP BY feature""")
def a18(spark, d):
    out = FT.feature_summary(_long_bucketed(spark, d))
    return out.select("feature", round6(F.col("value_mean")).alias("value_mean"),
                      round6(F.col("bucket_mean")).alias("bucket_mean"), "n")


@query("A18_bucket_histogram", X.with_ctes(_a18_long_sql()) + """
SELECT feature, bucket, count(*) AS n FROM lg GROUP BY feature, bucket""")
def a18h(spark, d):
    return FT.bucket_histogram(_long_bucketed(spark, d))


@query("A18_feature_summary_sqrt", X.with_ctes(_a18_long_sql()) + f"""
SELECT feature, {Q.r6('CASE WHEN avg(x) >= 0 THEN sqrt(avg(x)) END')} AS value_mean,
       {Q.r6('avg(bucket::DOUBLE)')} AS bucket_mean, count(*) AS n
FROM lg GROUP BY feature""")
def a18s(spark, d):
    """A18 as the reference logs 1-D features: square root of the mean."""
    out = FT.feature_summary(_long_bucketed(spark, d), sqrt_mean=True)
    return out.select("feature", round6(F.col("value_mean")).alias("value_mean"),
                      round6(F.col("bucket_mean")).alias("bucket_mean"), "n")


DIST = {"roi1": ("roi1", 0.0, 8.0), "score": ("p", 0.0, 1.0), "vector_sum": ("l_quantity + l_discount + l_tax", 3.0, 40.0)}


def _dist_sql() -> str:
    parts = []
    for name, (x, lo, hi) in DIST.items():
        at = (f"CASE WHEN ({x}) < {lo} THEN -1 WHEN ({x}) >= {hi} THEN 25 WHEN ({x}) IS NOT NULL THEN "
              f"least(floor((({x}) - {lo}::DOUBLE) / ({(hi - lo) / 25!r}::DOUBLE)), 24) END::INTEGER")
        parts.append(f"SELECT '{name}' AS name, {at} AS bin FROM samples")
    return S + "SELECT name, bin, count(*) AS n FROM (" + " UNION ALL ".join(parts) + ") GROUP BY ALL"


@query("A18_distributions", _dist_sql())
def a18d(spark, d):
    """Histograms of a label, the score and the sum of a vector of each row."""
    s = X.samples(spark, d).withColumn("v", F.array("l_quantity", "l_discount", "l_tax"))
    cols = {"roi1": F.col("roi1"), "score": F.col("p"), "vector_sum": M.vector_sum("v")}
    return M.distributions(s, {k: (cols[k], lo, hi) for k, (_, lo, hi) in DIST.items()}, bins=25)
