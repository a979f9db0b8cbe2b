"""Models that start from saved coefficients (M2, M3, S12, J1), checked through what SQL
knows about their optimum: with one feature the fitted probability of a bucket
is the weighted mean of its labels, and with several the weighted labels and
predictions of every bucket add up to the same."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quiver.catalog import sqlbits as Q
from quiver.catalog.checks_q import BUCKET_SQL
from quiver.catalog.metrics_q import BIN_SQL, _a16_sql
from quiver.catalog.model_q import BUCKETS, KEYS, KS, LABELS, _features
from quiver.catalog.registry import query
from quiver.plans import logistic as G
from quiver.plans.metrics import evaluation_report
from quiver.session import ensure_checkpoint_dir, round6
from quiver.sources import fixtures as X

POS_WEIGHT = 2.0


def fit_tasks(df, buckets, start=None):
    slots = G.slots_of(df, buckets)
    return {t: G.fit(G.merged_rows(df, slots, y, POS_WEIGHT), slots, start and start[t]) for t, y in LABELS.items()}


def _mean_sql(task: str, group: str) -> str:
    y, w = f"({BIN_SQL[task]})", f"(1 + {BIN_SQL[task]})"    # weight 2 of a positive row
    return f"sum({w} * {y}) {group} / sum({w}) {group}"


OVER = f"OVER (PARTITION BY {BUCKET_SQL['b_qty']})"


@query("M3_predict_bucket_means", X.with_ctes(X.SAMPLES_SQL) + f"""
SELECT {KS}, {Q.r6(_mean_sql('convert', OVER))} AS score_convert, {Q.r6(_mean_sql('roi1', OVER))} AS score_roi1 FROM samples""")
def m3(spark, d):
    """Scores of models of one feature."""
    f = _features(spark, d)
    p = G.predict(f, fit_tasks(f, ["b_qty"]), KEYS)
    return p.select(*KEYS, *[round6(F.col(f"score_{t}")).alias(f"score_{t}") for t in LABELS])


_WARM = " UNION ALL ".join(f"SELECT '{t}' AS task, '{b}' AS feature, {BUCKET_SQL[b]}::BIGINT AS bucket, count(*) AS n, "
                           f"0.0::DOUBLE AS residual, 0::BIGINT AS warm_steps FROM lineitem GROUP BY 3" for t in LABELS for b in BUCKETS)


@query("S12_warm_start_score_equations", _WARM)
def s12(spark, d):
    """Models fitted on the rows of even orders, saved, loaded, fitted on all rows from there, saved and loaded again: a fit from the
    optimum takes no step, and in every bucket of every feature labels and predictions weigh the same."""
    f = _features(spark, d)
    path = f"{ensure_checkpoint_dir(spark)}/models/warm-{uuid.uuid4().hex}"
    G.save(spark, fit_tasks(f.filter(F.col("l_orderkey") % 2 == 0), BUCKETS), f"{path}/half")
    G.save(spark, fit_tasks(f, BUCKETS, G.load(spark, f"{path}/half")), f"{path}/all")
    models = fit_tasks(f, BUCKETS, G.load(spark, f"{path}/all"))
    rows = F.array(*[F.struct(F.lit(t).alias("task"), F.lit(b).alias("feature"), F.col(b).cast("bigint").alias("bucket"),
                              F.when(F.col(y) > 0, POS_WEIGHT).otherwise(1.0).alias("w"), F.col(y).cast("double").alias("y"),
                              F.col(f"score_{t}").alias("p")) for t, y in LABELS.items() for b in BUCKETS])
    steps = F.when(F.col("task") == "convert", models["convert"].steps).otherwise(models["roi1"].steps)
    per = G.predict(f, models, [*BUCKETS, *LABELS.values()]).select(F.explode(rows).alias("r")).select("r.*").groupBy("task", "feature", "bucket").agg(
        F.count(F.lit(1)).alias("n"), round6(F.sum(F.col("w") * (F.col("y") - F.col("p"))) / F.sum("w")).alias("residual"))
    return per.withColumn("warm_steps", steps.cast("bigint"))


_TRAIN = "year(l_shipdate) < (SELECT max(year(l_shipdate)) FROM lineitem)"
_EVAL_SAMPLES = "WITH " + X.SAMPLES_SQL.replace("samples AS (", "all_samples AS (", 1) + f""",
bucketed AS (SELECT *, {BUCKET_SQL['b_qty']} AS b FROM all_samples),
fitted AS (SELECT b, {_mean_sql('convert', '')} AS p_convert, {_mean_sql('roi1', '')} AS p_roi1 FROM bucketed WHERE {_TRAIN} GROUP BY b),
samples AS (SELECT bucketed.* EXCLUDE (b, p), p_convert, p_roi1 FROM bucketed JOIN fitted ON bucketed.b = fitted.b WHERE NOT ({_TRAIN}))
"""


@query("J1_train_evaluate_bucket_means", _a16_sql(_EVAL_SAMPLES, "p_{}"))
def j1(spark, d):
    """Train on all years but the last, evaluate on the last: all 46 values of the report, from models of one feature."""
    from quiver.operators.dataset import date_holdout
    f = date_holdout(_features(spark, d, extra=["l_shipdate"]), "l_shipdate", unit="year")
    models = fit_tasks(f.filter("split = 'train'"), ["b_qty"])
    scored = G.predict(f.filter("split = 'eval'"), models, ["convert_label", "roi1"])
    report = evaluation_report(scored, {"convert": ("convert_label", "score_convert"), "roi1": ("roi1", "score_roi1")})
    return report.select("task", "metric", round6(F.col("value")).alias("value"))
