"""Logistic models on bucket slots that start from saved coefficients.

A row is a list of slot numbers, one per feature that has a bucket, so a thousand features
are as many numbers. Equal rows are merged, with their weights added. Every step
is one job: each task sums loss and gradient (for few slots also the curvature) of its rows, the sums are added up in a
tree, and the driver, which holds a handful of vectors as long as there are
slots, takes a Newton step, or an L-BFGS step where the slots are too many for a matrix.

Where a fit begins does not change where it ends, since the loss is convex: a warm
start from a model fitted on yesterday's rows needs fewer steps, and at the optimum none. Slots that the
saved model does not know begin at zero."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.session import cut_lineage

NEWTON_SLOTS = 512      # a matrix of at most 2 MB
BLOCK_ROWS = 2048
FAN_IN = 32             # sums that are added up at once
HISTORY = 12
MODEL = "feature string, bucket long, coefficient double"


@dataclass(frozen=True)
class Slots:
    """Numbers of the buckets: those of a feature are consecutive."""

    features: tuple[str, ...]
    sizes: tuple[int, ...]

    @property
    def total(self) -> int:
        return sum(self.sizes)

    def column(self) -> Column:
        """The slots of a row in the order of the features. A feature whose bucket is NULL or outside its size has none."""
        parts, at = [], 0
        for f, n in zip(self.features, self.sizes):
            b = F.col(f).cast("int")
            parts.append(F.when((b >= 0) & (b < n), b + at))
            at += n
        return F.filter(F.array(*parts), lambda x: x.isNotNull())

    def names(self) -> list[tuple[str, int]]:
        return [(f, b) for f, n in zip(self.features, self.sizes) for b in range(n)]


def slots_of(df: DataFrame, bucket_cols: Sequence[str]) -> Slots:
    """Slots up to the largest bucket of each column, in one aggregation (a column without buckets has none)."""
    top = df.agg(*[F.coalesce(F.max(F.col(c).cast("int")), F.lit(-1)).alias(f"m{i}") for i, c in enumerate(bucket_cols)]).first()
    return Slots(tuple(bucket_cols), tuple(max(0, top[i] + 1) for i in range(len(bucket_cols))))


@dataclass(frozen=True)
class Model:
    """A coefficient per slot, and the intercept last."""

    slots: Slots
    coefficients: np.ndarray
    steps: int = 0
    gradient: float = float("nan")

    def rows(self) -> list[tuple[str, int, float]]:
        out = [(f, b, float(c)) for (f, b), c in zip(self.slots.names(), self.coefficients)]
        return [*out, ("", -1, float(self.coefficients[-1]))]


def _margins(idx: pa.Array, coef: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Margin of each row, all slots one after another, and the row of each."""
    flat = idx.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = idx.offsets.to_numpy()
    row = np.repeat(np.arange(len(idx)), np.diff(ends))
    return np.bincount(row, weights=coef[flat], minlength=len(idx)) + coef[-1], flat, row


def _sums(rows: DataFrame, coef: np.ndarray, l2: float, curved: bool) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature (a matrix if ``curved``, else empty) over all rows (idx, y, w), added up in a tree of tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(coef)
    d = len(coef)
    names, schema = ["loss", "grad", "curve"], "loss double, grad binary, curve binary"

    def batch(loss: float, grad: np.ndarray, curve: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([grad.tobytes()], pa.binary()), pa.array([curve.tobytes()], pa.binary())], names)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        loss, grad, curve = 0.0, np.zeros(d), np.zeros((d, d) if curved else 0)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                b = whole.slice(at, BLOCK_ROWS)
                idx = pa.concat_arrays([b.column(0)])   # offsets from 0
                m, flat, row = _margins(idx, c)
                y, w = b.column(1).to_numpy(), b.column(2).to_numpy()
                p = 1 / (1 + np.exp(-np.clip(m, -700, 700)))
                loss += float((w * np.logaddexp(0, np.where(y > 0, -m, m))).sum())
                r = w * (p - y)
                grad[:-1] += np.bincount(flat, weights=r[row], minlength=d - 1)
                grad[-1] += r.sum()
                if curved:
                    x = np.zeros((len(m), d))
                    x[row, flat] = 1
                    x[:, -1] = 1
                    curve += x.T @ (x * (w * p * (1 - p))[:, None])
        yield batch(loss, grad, curve)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, grad, curve = 0.0, np.zeros(d), np.zeros(d * d if curved else 0)
        for b in batches:
            for x, g, h in zip(*(c.to_pylist() for c in b.columns)):
                loss, grad, curve = loss + x, grad + np.frombuffer(g), curve + np.frombuffer(h)
        yield batch(loss, grad, curve)

    sums, parts = rows.mapInArrow(own, schema), rows.rdd.getNumPartitions()
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        sums = sums.repartition(parts).mapInArrow(add, schema)
    got = sums.collect()    # at most FAN_IN rows
    loss, grad = sum(r.loss for r in got), sum(np.frombuffer(bytes(r.grad)) for r in got)
    curve = sum(np.frombuffer(bytes(r.curve)) for r in got)
    ridge = np.full(d, l2)
    ridge[-1] = 0
    curve = curve.reshape(d, d) + np.diag(ridge) if curved else curve
    return loss + float((ridge * coef * coef).sum()) / 2, grad + ridge * coef, curve


def merged_rows(df: DataFrame, slots: Slots, label: str, pos_weight: float = 1.0, idx: str | None = None) -> DataFrame:
    """(idx, y, w): rows with the same slots and label as one, their weights added. Rows without a label take no part.
    The slots are those of the bucket columns named like the features, or the column ``idx`` of assembled ones."""
    own = F.col(idx) if idx else slots.column()
    src = df.filter(F.col(label).isNotNull()).select(own.alias("idx"), (F.col(label) > 0).cast("double").alias("y"))
    n = F.count(F.lit(1)).cast("double")
    return cut_lineage(src.groupBy("idx", "y").agg((n * F.when(F.col("y") > 0, F.lit(float(pos_weight))).otherwise(1.0)).alias("w")))


def fit(rows: DataFrame, slots: Slots, start: Model | None = None, l2: float = 0.0, tolerance: float = 1e-10, max_steps: int = 200) -> Model:
    """The model of least loss on ``merged_rows``, from the coefficients of ``start`` where it knows a slot. Ends when no entry of the
    gradient exceeds ``tolerance`` of the total weight."""
    coef = aligned(start, slots).coefficients if start else np.zeros(slots.total + 1)
    weight = rows.agg(F.sum("w")).first()[0] or 0.0
    if not weight:
        return Model(slots, coef, 0, 0.0)
    curved = len(coef) <= NEWTON_SLOTS
    loss, grad, curve = _sums(rows, coef, l2, curved)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    steps, damping = 0, 0.0
    while steps < max_steps and np.abs(grad).max() > tolerance * weight:
        if curved:   # far from the optimum the curvature says little, so it is damped until the loss falls
            way = -np.linalg.lstsq(curve + damping * np.eye(len(coef)), grad, rcond=1e-12)[0]
        else:
            way = _lbfgs(grad, past, weight)
        for size in (1.0, 0.5, 0.25, 0.125) if curved else [0.5**k for k in range(40)]:
            new = coef + size * way
            loss2, grad2, curve2 = _sums(rows, new, l2, curved)
            if loss2 <= loss + 1e-4 * size * float(grad @ way) + 1e-12 * abs(loss):
                break
        else:
            if not curved or damping > 1e6 * weight:
                break   # nothing lower in reach of double precision
            damping = max(10 * damping, 1e-6 * weight)
            continue
        past = [*past, (new - coef, grad2 - grad)][-HISTORY:]
        coef, loss, grad, curve, damping = new, loss2, grad2, curve2, damping / 10 if damping > 1e-9 * weight else 0.0
        steps += 1
    return Model(slots, coef, steps, float(np.abs(grad).max()) / weight)


def _lbfgs(grad: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]], weight: float) -> np.ndarray:
    """The descent direction from the last steps and changes of the gradient."""
    q, back = grad.copy(), []
    for s, y in reversed(past):
        a = (s @ q) / (s @ y)
        back.append((a, s, y))
        q -= a * y
    q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 4.0 / weight
    for a, s, y in reversed(back):
        q += s * (a - (y @ q) / (s @ y))
    return -q


def predict(df: DataFrame, models: Mapping[str, Model], keep: Sequence[str] = (), idx: str | None = None) -> DataFrame:
    """M3: ``keep`` and ``score_<task>`` per model, from bucket columns or from assembled slots in ``idx``. Only the slot numbers go to Python."""
    def scorer(model: Model):
        shared = df.sparkSession.sparkContext.broadcast(model.coefficients)

        @F.arrow_udf("double")
        def score(idx: pa.Array) -> pa.Array:
            return pa.array(1 / (1 + np.exp(-np.clip(_margins(pa.concat_arrays([idx]), shared.value)[0], -700, 700))))

        return score(F.col(idx) if idx else model.slots.column())

    return df.select(*keep, *[scorer(m).alias(f"score_{t}") for t, m in models.items()])


def aligned(model: Model, slots: Slots) -> Model:
    """The model over other slots: its coefficients where it knows them, else 0."""
    known = {(f, b): c for f, b, c in model.rows()}
    return Model(slots, np.array([*(known.get(s, 0.0) for s in slots.names()), known.get(("", -1), 0.0)]))


def save(spark: SparkSession, models: Mapping[str, Model], path: str) -> None:
    """A table of (task, feature, bucket, coefficient); the intercept has no feature and bucket -1."""
    rows = [(t, *r) for t, m in models.items() for r in m.rows()]
    spark.createDataFrame(rows, f"task string, {MODEL}").coalesce(1).write.mode("overwrite").partitionBy("task").parquet(path)


def load(spark: SparkSession, path: str) -> dict[str, Model]:
    """The saved models by task; a row per slot comes to the driver, as the models themselves did."""
    out: dict[str, dict] = {}
    for r in spark.read.schema(f"{MODEL}, task string").parquet(path).collect():
        out.setdefault(r.task, {})[r.feature, r.bucket] = r.coefficient
    models = {}
    for t, found in out.items():
        features = sorted({f for f, b in found if b >= 0})
        slots = Slots(tuple(features), tuple(1 + max(b for f, b in found if f == x) for x in features))
        models[t] = Model(slots, np.array([*(found.get(s, 0.0) for s in slots.names()), found.get(("", -1), 0.0)]))
    return models
