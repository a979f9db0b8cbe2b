"""Model jobs re-aimed at the user level.

M1 scores a dense tower with supplied weights (numpy, Arrow batches). M2 fits
one logistic model per task on one-hot bucket ids with Spark ML: it is the
training step of the reference re-expressed as a Spark ML pipeline, and does
not reach the same optimum as the reference's network. M3 applies a fitted
model; S12 saves and loads it."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quiver.session import spread

# Fixed value of the reference: hidden layers 512, 256, 64 and one output per task.
TOWER = (512, 256, 64, 1)


def init_weights(n_in: int, dims: Sequence[int] = TOWER, seed: int = 0, std: float = 0.1
                 ) -> list[tuple[np.ndarray, np.ndarray]]:
    """Truncated-normal-like weights (clipped at 2 std) and zero biases."""
    rng = np.random.default_rng(seed)
    out, prev = [], n_in
    for dmn in dims:
        w = np.clip(rng.normal(0.0, std, size=(prev, dmn)), -2 * std, 2 * std)
        out.append((w, np.zeros(dmn)))
        prev = dmn
    return out


def forward_np(x: np.ndarray, layers: Sequence[tuple[np.ndarray, np.ndarray]], slope: float = 0.2) -> np.ndarray:
    """Leaky-ReLU hidden layers, sigmoid output."""
    h = x
    for i, (w, b) in enumerate(layers):
        z = h @ w + b
        h = np.where(z > 0, z, slope * z) if i < len(layers) - 1 else 1.0 / (1.0 + np.exp(-z))
    return h[:, 0]


def score_dense(df: DataFrame, features: Sequence[str], layers: Sequence[tuple[np.ndarray, np.ndarray]],
                out: str = "score", keep: Sequence[str] = (), slope: float = 0.2) -> DataFrame:
    """M1: forward pass per Arrow batch. The weights are shipped once per
    task through a broadcast variable (their size is fixed by the tower)."""
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast([(w.astype(np.float64), b.astype(np.float64)) for w, b in layers])
    keep = list(keep)
    schema = StructType([df.schema[k] for k in keep] + [StructField(out, DoubleType())])
    feats = list(features)

    def run(batches):
        ws = bc.value
        for pdf in batches:
            x = pdf[feats].to_numpy(dtype=np.float64)
            o = pdf[keep].copy()
            o[out] = forward_np(x, ws, slope)
            yield o

    src = spread(df.select(*keep, *[F.col(f).cast("double").alias(f) for f in feats]))
    return src.mapInPandas(run, schema)


def fit_two_tasks(df: DataFrame, bucket_cols: Sequence[str], labels: Mapping[str, str],
                  pos_weight: float = 2.0, max_iter: int = 50, reg: float = 0.0,
                  aggregate: bool = True) -> PipelineModel:
    """M2: one-hot bucket ids -> one vector -> a logistic model per task, with
    positive rows weighted ``pos_weight`` (the reference's cross-entropy
    weight). ``labels`` maps task -> binary label column.

    This is the reference's training step re-aimed at Spark ML: a linear
    model on one-hot buckets, not the reference's 512-256-64 network, so it
    does not reach the same optimum.

    ``aggregate``: rows with the same bucket ids and labels are the same
    input to the model, so they are merged into one row whose weight is
    their summed weight -- the weighted log-likelihood, hence the optimum, is
    unchanged. The fit then reads one row per distinct (buckets, labels)
    combination, bounded by the bucket counts, instead of every sample on
    every optimizer iteration."""
    label_cols = list(dict.fromkeys(labels.values()))
    data = df.select(*bucket_cols, *label_cols)
    if aggregate:
        data = data.groupBy(*bucket_cols, *label_cols).agg(F.count(F.lit(1)).cast("double").alias("_rows"))
    else:
        data = data.withColumn("_rows", F.lit(1.0))
    stages = [OneHotEncoder(inputCols=list(bucket_cols), outputCols=[f"{c}_oh" for c in bucket_cols],
                            handleInvalid="keep"),
              VectorAssembler(inputCols=[f"{c}_oh" for c in bucket_cols], outputCol="features")]
    for task, lab in labels.items():
        data = data.withColumn(f"_w_{task}", F.col("_rows") * F.when(F.col(lab) > 0, F.lit(pos_weight))
                               .otherwise(F.lit(1.0)))
        stages.append(LogisticRegression(featuresCol="features", labelCol=lab, weightCol=f"_w_{task}",
                                         predictionCol=f"pred_{task}", probabilityCol=f"prob_{task}",
                                         rawPredictionCol=f"raw_{task}", maxIter=max_iter, regParam=reg))
    # the encoder and both models read the same narrow frame: compute it once
    # (memory, spilling to disk; lost blocks are recomputed from the lineage)
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fit_input = data
        if aggregate:
            # every optimizer iteration is a job over this table: size its
            # partitions by its measured row count (~1M rows each), one task
            # when the combinations are few, many when nearly every row is
            # distinct (e.g. with hundreds of features)
            want = max(1, math.ceil(data.count() / 1_000_000))
            fit_input = data.coalesce(want)
        return Pipeline(stages=stages).fit(fit_input)
    finally:
        data.unpersist()


def predict(model: PipelineModel, df: DataFrame, tasks: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """M3: scores only, one column per task (positive-class probability)."""
    data = df
    for t in tasks:   # weight columns are read by fit only; transform ignores them
        if f"_w_{t}" not in data.columns:
            data = data.withColumn(f"_w_{t}", F.lit(1.0))
    p = model.transform(data)
    return p.select(*keep, *[F.element_at(vector_to_array(f"prob_{t}"), 2).alias(f"score_{t}") for t in tasks])


def save_model(model: PipelineModel, path: str) -> None:
    """Write the fitted pipeline (overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """Warm start from a saved pipeline."""
    return PipelineModel.load(path)
