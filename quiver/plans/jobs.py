"""The reference's job lifecycle composed from the operators: prepare
features, train, evaluate, serve (survey section 3).

train:    read -> conform -> bucketize -> fit (M2) -> save (S12)
evaluate: bucketize -> predict (M3) -> scored rows (S10) -> metric report (A16)
serve:    schema check (S11) -> predict

``assembled``, ``train_slots`` and ``evaluate_slots`` run the whole feature path (hash slots, 1-D and
2-D buckets, ratios, deltas) at any width, and can start from a saved model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.operators.features import BUCKET_PREFIX, bucket_features_1d
from quiver.plans import logistic as G
from quiver.plans import model as MD
from quiver.plans.metrics import evaluation_report
from quiver.plans.wide import FeatureSet, assemble
from quiver.sources.reader import Field, check_schema
from quiver.session import cut_lineage
from quiver.sources.sink import scored_rows


def prepare(df: DataFrame, specs: Mapping[str, Sequence[float]],
            log_specs: Mapping[str, Sequence[float]] | None = None, skip_shadow: bool = True
            ) -> tuple[DataFrame, list[str]]:
    """Bucket ids for every listed feature (P5); returns the bucket columns."""
    out, kept, _ = bucket_features_1d(df, specs, log_specs, skip_shadow=skip_shadow)
    return out, [f"{BUCKET_PREFIX}{k}" for k in kept]


def train(df: DataFrame, bucket_cols: Sequence[str], labels: Mapping[str, str],
          model_path: str | None = None) -> PipelineModel:
    """Fit one model per task; optionally save it (export by the driver)."""
    model = MD.fit_two_tasks(df, bucket_cols, labels)
    if model_path:
        MD.save_model(model, model_path)
    return model


def evaluate(model: PipelineModel, df: DataFrame, labels: Mapping[str, str], raw_labels: Mapping[str, str],
             id_cols: Sequence[str], label_cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Scores, the scored-row sink frame and the evaluation report.

    ``labels``: task -> binary label column used in training; ``raw_labels``:
    task -> raw label column for the report (it clips and binarizes itself)."""
    keep = list(dict.fromkeys([*id_cols, *label_cols, *raw_labels.values()]))
    scored = MD.predict(model, df, list(labels), keep=keep)
    tasks = {t: (raw_labels[t], f"score_{t}") for t in labels}
    rows = scored_rows(scored, tasks, "eval", id_cols, label_cols, with_clock=True)
    return rows, evaluation_report(scored, tasks)


def serve(model: PipelineModel, df: DataFrame, contract: Sequence[Field], tasks: Sequence[str],
          keep: Sequence[str] = ()) -> DataFrame:
    """Reject inputs that break the serving contract, then score."""
    bad = check_schema(df, contract).filter(~F.col("present") | ~F.col("type_ok") | (F.col("n_bad_length") > 0))
    problems = bad.collect()          # one row per contract field at most
    if problems:
        raise ValueError(f"serving contract violated: {[r.asDict() for r in problems]}")
    return MD.predict(model, df, tasks, keep=keep)


POS_WEIGHT = 2.0    # fixed value of the reference: weight of a positive row in the cross entropy


def assembled(df: DataFrame, features: FeatureSet, keep: Sequence[str]) -> DataFrame:
    """``keep`` and the slots of all features (P20, P5, P6 with P10 and P12, P23), written once: fitting reads them at every step."""
    return cut_lineage(assemble(df, features, keep))


def train_slots(rows: DataFrame, features: FeatureSet, labels: Mapping[str, str], start: Mapping[str, G.Model] | None = None,
                pos_weight: float = POS_WEIGHT, l2: float = 1.0, tolerance: float = 1e-6) -> dict[str, G.Model]:
    """M2: a model per task on assembled rows, from ``start`` where it has the task."""
    slots = features.slots()
    return {t: G.fit(G.merged_rows(rows, slots, y, pos_weight, idx="idx"), slots, (start or {}).get(t), l2=l2, tolerance=tolerance) for t, y in labels.items()}


def evaluate_slots(models: Mapping[str, G.Model], rows: DataFrame, raw_labels: Mapping[str, str], id_cols: Sequence[str],
                   label_cols: Sequence[str], split: str = "eval") -> tuple[DataFrame, DataFrame]:
    """Scored rows (S10) of a split and the evaluation report."""
    keep = list(dict.fromkeys([*id_cols, *label_cols, *raw_labels.values()]))
    scored = G.predict(rows, models, keep, idx="idx")
    tasks = {t: (raw_labels[t], f"score_{t}") for t in models}
    return scored_rows(scored, tasks, split, id_cols, label_cols, with_clock=True), evaluation_report(scored, tasks)
