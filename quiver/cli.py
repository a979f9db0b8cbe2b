"""Command-line job runner: the reference's train / evaluate run, on Spark.

    python -m quiver --train-paths 'data/{20250917,20250918}/part-*' \\
                     --test-paths 'data/20250919/part-*' --spec spec.json \\
                     --model-path out/model --is-eval 1 \\
                     --loss-type 'weighted_cross_entropy,focal_loss'

Inputs are Parquet samples with a 7-slot ``label`` array (S3 positions) and
the features named in the spec, which is JSON with any of: ``bounds`` and ``log_bounds``
(1-D feature -> bounds; the latter compress with log1p first), ``sparse`` (categorical -> slots),
``arrays`` and ``array_log_bounds`` (2-D feature, ratio or delta -> bounds), ``ratios``
([numerator, denominator, output], ...), ``ladders`` (metric -> windows), ``key``, ``reduce`` (max or mean).
Absent columns and NULLs take their defaults. ``--warm-start`` begins from a model saved by an
earlier run. Outputs go under ``--out``: ``model``, ``report`` (task, metric, value), ``losses`` and
``scored`` rows partitioned by ``dataset`` (with ``--score-train`` those of the
training rows too, with fewer ids). Paths may be globs joined by ``|``.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.functions import labels as L
from quiver.functions import losses as E
from quiver.operators.dataset import filter_equal, holdout_paths
from quiver.plans import jobs
from quiver.plans import logistic as G
from quiver.plans.metrics import total_loss
from quiver.plans.wide import FeatureSet
from quiver.session import ensure_checkpoint_dir
from quiver.sources.reader import read_samples, split_label
from quiver.sources.sink import write_scored

# Fixed values of the reference: two tasks, convert (label slot 0) and roi1
# (label slot 2); ids of scored rows, of which the training variant carries the first two.
TASK_SLOTS = {"convert": "convert_label", "roi1": "roi1_label"}
LABELS = {"convert": "convert_bin", "roi1": "roi1_bin"}
ID_COLS = ("req_id", "customer_id", "advertiser_id", "ad_id")
TRAIN_ID_COLS = ID_COLS[:2]


def parse_args(argv=None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quiver")
    p.add_argument("--train-paths", default="")
    p.add_argument("--test-paths", default="")
    p.add_argument("--spec", required=True)
    p.add_argument("--model-path", default="")
    p.add_argument("--out", default="")
    p.add_argument("--is-train", type=int, default=1)
    p.add_argument("--is-eval", type=int, default=0)
    p.add_argument("--is-offline", type=int, default=0,
                   help="split the train paths' dates: last date evaluates, earlier dates train")
    p.add_argument("--loss-type", default="weighted_cross_entropy,focal_loss")
    p.add_argument("--cross-entropy-weight", type=float, default=2.0)
    p.add_argument("--auto-type-field", default="", help="column that --auto-type-to-keep filters on")
    p.add_argument("--auto-type-to-keep", type=int, default=-1)
    p.add_argument("--warm-start", default="", help="folder of a saved model to begin from")
    p.add_argument("--score-train", type=int, default=0)
    p.add_argument("--l2", type=float, default=1.0)
    p.add_argument("--label-col", default="label")
    return p.parse_args(argv)


def feature_set(spec: dict) -> FeatureSet:
    return FeatureSet(sparse=spec.get("sparse", {}), dense=spec.get("bounds", {}), dense_log=spec.get("log_bounds", {}), arrays=spec.get("arrays", {}),
                      arrays_log=spec.get("array_log_bounds", {}), ratios=[tuple(r) for r in spec.get("ratios", [])], ladders=spec.get("ladders", {}),
                      key=spec.get("key", ""), reduce=spec.get("reduce", "max"))


def _load(spark: SparkSession, paths: str, args, features: FeatureSet) -> tuple[DataFrame, list[str], list[str]]:
    """Assembled rows with ids and labels."""
    df = read_samples(spark, paths)
    if args.auto_type_field:
        df = filter_equal(df, args.auto_type_field, args.auto_type_to_keep)
    df = split_label(df, args.label_col)
    df = df.withColumn("roi1_bin", L.binarize("roi1", L.clip("roi1_label")))
    df = df.withColumn("convert_bin", L.binarize("convert", L.clip("convert_label")))
    ids, labels = [c for c in ID_COLS if c in df.columns], [c for c in df.columns if c.endswith("_label")]
    return jobs.assembled(df, features, [*ids, *labels, *LABELS.values()]), ids, labels


def run(spark: SparkSession, argv=None) -> dict:
    args = parse_args(argv)
    with open(args.spec) as fh:
        features = feature_set(json.load(fh))
    train_paths, test_paths = args.train_paths, args.test_paths
    if args.is_offline:
        train_paths, test_paths = holdout_paths(train_paths)
    out = args.out or f"{ensure_checkpoint_dir(spark)}/quiver-run"
    model_path = args.model_path or f"{out}/model"
    result = {}
    if args.is_train:
        rows, ids, labels = _load(spark, train_paths, args, features)
        start = G.load(spark, args.warm_start) if args.warm_start else None
        models = jobs.train_slots(rows, features, LABELS, start, args.cross_entropy_weight, args.l2)
        G.save(spark, models, model_path)
        result.update(model=model_path, steps={t: m.steps for t, m in models.items()})
        if args.score_train:
            scored, _ = jobs.evaluate_slots(models, rows, TASK_SLOTS, [c for c in ids if c in TRAIN_ID_COLS], labels, split="train")
            write_scored(scored, f"{out}/scored")
            result["scored"] = f"{out}/scored"
    if args.is_eval:
        models = {t: G.aligned(m, features.slots()) for t, m in G.load(spark, model_path).items()}
        rows, ids, labels = _load(spark, test_paths, args, features)
        scored, report = jobs.evaluate_slots(models, rows, TASK_SLOTS, ids, labels)
        report.write.mode("overwrite").parquet(f"{out}/report")
        write_scored(scored, f"{out}/scored")
        names = E.parse_loss_names(args.loss_type)
        fns = {"mae": None, "huber": None,
               "weighted_cross_entropy": lambda y, p: E.weighted_ce(y, p, args.cross_entropy_weight),
               "focal_loss": E.focal, "cross_entropy": E.cross_entropy}
        scored = spark.read.parquet(f"{out}/scored").filter("dataset = 'eval'")
        per_task = {}
        for t in LABELS:
            y = L.binarize(t, L.clip(f"label_{t}"))
            reg_y, reg_p = L.log_tail(f"label_{t}"), L.log_tail(F.greatest(F.col(f"score_{t}"), F.lit(0.0)))
            per_task[t] = {n: (E.mae(reg_y, reg_p) if n == "mae" else E.huber(reg_y, reg_p) if n == "huber"
                               else fns[n](y, f"score_{t}")) for n in names}
        total_loss(scored, per_task).write.mode("overwrite").parquet(f"{out}/losses")
        result.update(report=f"{out}/report", scored=f"{out}/scored", losses=f"{out}/losses")
    return result


def main(argv=None) -> None:
    spark = SparkSession.builder.appName("quiver").config("spark.ui.enabled", "false").getOrCreate()
    print(json.dumps(run(spark, argv)))


if __name__ == "__main__":
    main()
