"""Sequence building: the last k events per key as fixed-length arrays with a
validity mask (the ``[batch, pad_len]`` sequences of the reference).

``row_number() <= k`` over a window lets Spark insert a partial
``WindowGroupLimit`` before the shuffle, so each map task forwards at most k
rows per key: a hot key cannot flood one task. The per-key collect is then
bounded by k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiver.functions.arrays import fixed_length


def last_k(df: DataFrame, key: str, order: str, value_cols: Sequence[str], k: int,
           pad: int | None = None, pad_value=0.0) -> DataFrame:
    """Per key: the last ``k`` rows by ``order``, in ascending order, as
    ``<v>_seq`` arrays, right-padded to ``pad`` slots (default k) with
    ``pad_value``, and ``mask`` (true on real slots) and ``n_valid``."""
    n = pad or k
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    top = df.select(key, order, *value_cols, F.row_number().over(w).alias("_rn")).filter(F.col("_rn") <= k)
    g = top.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *value_cols))).alias("_s"))
    out = [F.col(key)]
    for v in value_cols:
        raw = F.transform("_s", lambda s: s[v])
        out.append(fixed_length(raw, n, pad_value).alias(f"{v}_seq"))
    out.append(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i < F.size("_s")).alias("mask"))
    out.append(F.size("_s").cast("int").alias("n_valid"))
    return g.select(*out)


def consecutive(df: DataFrame, key: str, order: str, value_cols: Sequence[str], k: int,
                pad_value=0.0, raw: bool = False) -> DataFrame:
    """All rows of each key as consecutive sequences of ``k``: the first k by
    ``order``, the next k, and so on; the last one is right-padded. Columns:
    key, ``chunk`` (from 0), ``<v>_seq``, ``mask``, ``n_valid``; with ``raw``
    the arrays stay as long as they are.

    ``order`` must be unique within a key. Ranks come from ``running_totals_by``,
    so the rows of a hot key are spread over range buckets, and each collect
    is bounded by k."""
    from quiver.plans.prefix import running_totals_by

    rows = df.select(key, order, *value_cols).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_totals_by(rows, key, order, ["_one"]).withColumn(
        "chunk", F.floor((F.col("cum__one") - 1) / F.lit(k)).cast("long"))
    g = ranked.groupBy(key, "chunk").agg(F.sort_array(F.collect_list(F.struct(order, *value_cols))).alias("_s"))
    out = [F.col(key), F.col("chunk")]
    for v in value_cols:
        values = F.transform("_s", lambda s: s[v])
        out.append((values if raw else fixed_length(values, k, pad_value)).alias(f"{v}_seq"))
    out.append(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: i < F.size("_s")).alias("mask"))
    out.append(F.size("_s").cast("int").alias("n_valid"))
    return g.select(*out)
