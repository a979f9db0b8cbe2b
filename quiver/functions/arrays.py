"""Fixed-length array and sequence operators (S2 array normalisation, Q1-Q3).

S2, Q1 and Q2 are Spark higher-order functions: they run inside the JVM, per
row, with no Python worker. Q3 (attention pooling: a slots x slots matrix
product per row) runs as an Arrow-batched ``mapInPandas`` with numpy.
Sequences are ``array<array<double>>`` with an ``array<boolean>`` validity
mask of the same length."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiver.functions.transforms import ColumnOrName, _c

# Fixed value of the reference: the masked softmax adds 1e-6 to its sum.
SOFTMAX_EPS = 1e-6


def fixed_length(a: ColumnOrName, n: int, pad=0, dtype: str | None = None) -> Column:
    """Truncate or right-pad an array to exactly n slots (NULL -> all pad).
    ``dtype`` is the element type; without it, the pad value's."""
    t = dtype or _sql_type(pad)
    arr = _c(a).cast(f"array<{t}>")
    filler = F.array_repeat(F.lit(pad).cast(t), n)
    return F.slice(F.concat(F.coalesce(arr, F.array().cast(f"array<{t}>")), filler), 1, n)


def _sql_type(v) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "bigint"
    if isinstance(v, float):
        return "double"
    return "string"


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def masked_softmax(logits: ColumnOrName, mask: ColumnOrName, eps: float = SOFTMAX_EPS) -> Column:
    """Q1: exp(l - max l), zeroed where the mask is false, divided by
    (sum + eps). The max runs over all slots, masked ones included."""
    lg = F.transform(_c(logits), lambda v: v.cast("double"))
    m = F.array_max(lg)
    ex = F.zip_with(lg, _c(mask), lambda v, k: F.when(k, F.exp(v - m)).otherwise(F.lit(0.0)))
    tot = _sum(ex)
    return F.transform(ex, lambda e: e / (tot + F.lit(float(eps))))


def valid_count(masks: Sequence[ColumnOrName]) -> Column:
    """Number of slots valid in any of the given masks."""
    cols = [_c(m) for m in masks]
    anyv = cols[0]
    for m in cols[1:]:
        anyv = F.zip_with(anyv, m, lambda a, b: a | b)
    return F.size(F.filter(anyv, lambda v: v)).cast("int")


def masked_mean_pool_one(seq: ColumnOrName, mask: ColumnOrName, dim: int) -> Column:
    """Q2 for one feature: per dimension sum(mask * v) / sum(mask); 0 when no
    slot is valid. ``seq`` is array<array<double>> [slots][dim]."""
    s, mk = _c(seq), _c(mask)
    n_valid = F.size(F.filter(mk, lambda v: v))
    pairs = F.arrays_zip(s.alias("v"), mk.alias("m"))
    out = F.transform(
        F.sequence(F.lit(1), F.lit(dim)),
        lambda j: _sum(F.transform(pairs, lambda p: F.when(p["m"], F.element_at(p["v"], j).cast("double"))
                                   .otherwise(F.lit(0.0)))))
    return F.when(n_valid > 0, F.transform(out, lambda v: v / n_valid)).otherwise(
        F.array_repeat(F.lit(0.0), dim))


def masked_mean_pool(seqs: Sequence[ColumnOrName], masks: Sequence[ColumnOrName],
                     dims: Sequence[int]) -> tuple[Column, Column]:
    """Q2: pooled vectors of all features concatenated, and the number of
    slots valid in any feature."""
    pooled = [masked_mean_pool_one(s, m, d) for s, m, d in zip(seqs, masks, dims)]
    return F.concat(*pooled), valid_count(masks)


def self_attention_pool_np(x, mask, eps: float = SOFTMAX_EPS):
    """Q3 for a batch with numpy: x [rows, slots, dim], mask [rows, slots].

    logits = x x^T / sqrt(dim); row weights = Q1 (max over all slots,
    masked slots zeroed, / (sum + eps)); out = weights @ x; rows of invalid
    slots are zeroed; the sum over slots is divided by the valid count
    (0 vector if none is valid)."""
    import numpy as np
    logits = x @ x.transpose(0, 2, 1) / math.sqrt(x.shape[2])
    ex = np.exp(logits - logits.max(axis=2, keepdims=True)) * mask[:, None, :]
    w = ex / (ex.sum(axis=2, keepdims=True) + eps)
    out = (w @ x) * mask[:, :, None]
    return out.sum(axis=1) / np.maximum(mask.sum(axis=1), 1)[:, None]


def self_attention_pool(df, seq: str, mask: str, out: str = "pooled", keep: Sequence[str] = ()):
    """Q3 over a DataFrame of fixed-length sequences: ``mapInArrow``, the
    lists' own buffers as one [rows, slots, dim] array, batched matrix
    products. The slots x slots product has no built-in column expression."""
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    keep = list(keep)
    schema = StructType([df.schema[k] for k in keep] + [StructField(out, ArrayType(DoubleType()))])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            if not b.num_rows:
                continue
            rows = b.num_rows
            m = b.column(len(keep) + 1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
            flat = b.column(len(keep)).flatten().flatten().to_numpy(zero_copy_only=False)
            x = flat.astype(np.float64).reshape(rows, m.shape[1], -1)
            parts = [self_attention_pool_np(x[i:i + 512], m[i:i + 512]) for i in range(0, rows, 512)]
            res = np.concatenate(parts)
            pooled = pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * res.shape[1], res.ravel())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pooled], schema.names)

    double = F.transform(F.col(seq), lambda v: v.cast("array<double>"))
    return df.select(*keep, double.alias("_seq"), F.col(mask).alias("_mask")).mapInArrow(run, schema)
