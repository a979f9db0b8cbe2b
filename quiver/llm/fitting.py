"""What the text classifiers share: the bounded, balanced sample of labelled rows
they learn from, and fitting in one task that returns one small model."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import small_batches, spread_out, tidy

SLICE = 512


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int) -> DataFrame:
    """(text, y, order) of at most ``rows`` labelled documents outside the held-out fold, half of them
    of either class where there are as many: those whose hashed id comes first. Only the ids are sorted and broadcast; ``rows`` bounds them.
    An id labelled both ways is left out; of an id with several texts the smallest is taken."""
    own = labels.select(labels["doc_id"].cast("long").alias("id"), labels[label].cast("int").alias("y")).filter("id is not null and y in (0, 1)").filter(
        fold(F.col("id"), folds) != held).groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other").select(
        "id", "y", F.xxhash64("id", F.lit(label)).alias("order"))
    part = lambda y: own.filter(F.col("y") == y).orderBy("order", "id").limit(rows // 2)
    ids = part(0).unionByName(part(1))
    return docs.select(docs["doc_id"].alias("id"), docs["text"].alias("text")).join(F.broadcast(ids), "id").groupBy("id").agg(
        F.min("text").alias("text"), F.first("y").alias("y"), F.first("order").alias("order")).select("text", "y", "order")


def fit_in_one_task(sample: DataFrame, fit: Callable[[list[bytes], list[int]], dict]) -> dict | None:
    """Run ``fit(texts, labels)`` on the bounded sample inside an executor's task; None if the sample is empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, bytes, int]] = []
        for b in batches:
            rows += zip(b.column(2).to_pylist(), b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist())
        if rows:
            rows.sort(key=lambda r: (r[0], r[1] or b""))
            model = fit([r[1] or b"" for r in rows], [r[2] for r in rows])  # None where there is nothing to learn
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(found[0].model)) if found else None


def scored(docs: DataFrame, scorer: Callable, model: dict | None, threshold: float, folds: int, held: int) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; a row without an id is not held out."""
    model_everywhere = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model_everywhere.value)
        for b in batches:
            s = score([t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype("int32"), pa.int32())],
                                             ["doc_id", "score", "predicted"])

    src = spread_out(docs).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    out = src.mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", "predicted")


def passing(docs: DataFrame, scorer: Callable, model: dict | None, keep: Callable) -> DataFrame:
    """The rows of ``docs`` whose score passes, with all their columns, in one scan. Only the texts go to Python, a
    slice at a time, and only verdicts come back; the rows wait in the JVM."""
    model_everywhere = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    @F.arrow_udf("boolean")
    def verdicts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            score = scorer(model_everywhere.value)
            for b in texts:
                parts = [b.slice(at, SLICE) for at in range(0, len(b), SLICE)]
                ok = [keep(score([t or b"" for t in p.cast(pa.binary()).to_pylist()])) for p in parts]
                yield pa.array(np.concatenate(ok) if ok else [], pa.bool_())

        yield from tidy(run)(batches)

    return spread_out(docs).filter(verdicts("text"))
