"""Scalar feature transforms as Column -> Column builders (P1, P2, P7, P11,
P15, P18, P19, P21, P22).

All arithmetic is in double. Every builder stays inside Catalyst, so a
projection of many of them is one stage; scalar builders are compiled by
whole-stage codegen, array builders use higher-order functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Fixed values of the reference: soft buckets use temperature 0.8 and bucket
# centers between 0.0 and 70.1; the hourly-rate "mean" divides by 0.2.
SOFT_TEMP = 0.8
CENTER_RANGE = (0.0, 70.1)
PAIR_MEAN_DIVISOR_REFERENCE = 0.2


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _dbl(x: ColumnOrName) -> Column:
    return _c(x).cast("double")


def bounds_literal(bounds: Sequence[float]) -> Column:
    """An ``array<double>`` literal for a sorted boundary list."""
    return F.array(*[F.lit(float(b)) for b in bounds])


# --- P1 -------------------------------------------------------------------
def compress(x: ColumnOrName, log: bool = True) -> Column:
    """``log1p(max(x, 0))`` (or only the clamp). NULL counts as 0, like an
    absent feature that takes its default."""
    clamped = F.greatest(F.coalesce(_dbl(x), F.lit(0.0)), F.lit(0.0))
    return F.log1p(clamped) if log else clamped


# --- P2 -------------------------------------------------------------------
def bucketize(x: ColumnOrName, bounds: Sequence[float] | Column, max_len: int | None = None) -> Column:
    """Bucket id in 0..len(bounds) = number of bounds <= x (left-closed).

    NULL -> 0, NaN -> len(bounds) (NaN sorts above every number in Spark), a
    value equal to a bound goes to the upper bucket.

    With a literal list this is a sum of comparisons, which whole-stage
    codegen compiles (a lambda ``filter`` would run interpreted). With an
    ``array<double>`` column (long form, bounds joined from a broadcast spec)
    pass ``max_len``, the longest bounds list, for the same compiled form;
    without it a ``filter`` lambda is used."""
    xv = _dbl(x)
    if isinstance(bounds, Column):
        if max_len is None:
            return F.size(F.filter(bounds, lambda b: xv >= b)).cast("int")
        terms = [F.when(xv >= F.try_element_at(bounds, F.lit(i)), 1).otherwise(0) for i in range(1, max_len + 1)]
    else:
        terms = [F.when(xv >= F.lit(float(b)), 1).otherwise(0) for b in bounds]
    if not terms:
        return F.lit(0)
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out.cast("int")


# --- P7 -------------------------------------------------------------------
def array_reduce(a: ColumnOrName, how: str = "max") -> Column:
    """Reduce an array over its last axis, padding included."""
    arr = F.transform(_c(a), lambda v: v.cast("double"))
    if how == "max":
        return F.array_max(arr)
    if how == "mean":
        return F.aggregate(arr, F.lit(0.0), lambda s, v: s + v) / F.size(arr)
    raise ValueError(f"unknown reduce: {how}")


# --- P11 ------------------------------------------------------------------
def signed_delta(v1: ColumnOrName, v2: ColumnOrName, mode: str = "reference") -> Column:
    """Log-scaled change from v1 to v2.

    ``reference``: ``-log1p(relu(v2 - v1))`` when v1 <= v2, else
    ``log1p(relu(v2 - v1))`` (which is 0) -- never positive.
    ``symmetric``: ``signum(d) * log1p(|d|)`` with d = v2 - v1.
    ``+ 0.0`` folds -0.0 into 0.0."""
    a, b = _dbl(v1), _dbl(v2)
    d = b - a
    if mode == "reference":
        relu = F.greatest(d, F.lit(0.0))
        out = F.when(a <= b, -F.log1p(relu)).otherwise(F.log1p(relu))
    elif mode == "symmetric":
        out = F.signum(d) * F.log1p(F.abs(d))
    else:
        raise ValueError(f"unknown mode: {mode}")
    return out + F.lit(0.0)


# --- P10 (scalar form; the column walk lives in operators.derive) ----------
def log_ratio(a: ColumnOrName, b: ColumnOrName) -> Column:
    """P10: -1 if either side <= -1 (invalid), else compress(a) - compress(b)."""
    av, bv = _dbl(a), _dbl(b)
    return F.when((av <= -1) | (bv <= -1), F.lit(-1.0)).otherwise(compress(av) - compress(bv))


def log_ratio_arrays(a: ColumnOrName, b: ColumnOrName) -> Column:
    """P10 elementwise over two equally long arrays."""
    return F.zip_with(_c(a), _c(b), lambda x, y: log_ratio(x, y))


# --- P15 ------------------------------------------------------------------
def column_or_default(df: DataFrame, name: str, default: float | int = 0) -> Column:
    """The column if the frame has it, else a literal default."""
    return F.col(name) if name in df.columns else F.lit(default)


# --- P18 ------------------------------------------------------------------
def step_pair_mean(cur: ColumnOrName, last: ColumnOrName, divisor: float = 2.0) -> Column:
    """``(cur + last) / divisor``. The reference divides by 0.2; pass
    ``divisor=PAIR_MEAN_DIVISOR_REFERENCE`` for parity."""
    return (_dbl(cur) + _dbl(last)) / F.lit(float(divisor))


# --- P19 ------------------------------------------------------------------
def cast_int(x: ColumnOrName, first_slot: bool = False) -> Column:
    """Integer view of a value (or of the first slot of an array)."""
    c = _c(x)
    return (F.element_at(c, 1) if first_slot else c).cast("int")


# --- P21 ------------------------------------------------------------------
def bucket_centers(bounds: Sequence[float], lo: float = CENTER_RANGE[0], hi: float = CENTER_RANGE[1]) -> list[float]:
    """P21 on a literal list: midpoints of [lo] + bounds + [hi]."""
    pts = [float(lo)] + [float(b) for b in bounds] + [float(hi)]
    return [(pts[i] + pts[i + 1]) / 2.0 for i in range(len(pts) - 1)]


def bucket_centers_col(bounds: Column, lo: float = CENTER_RANGE[0], hi: float = CENTER_RANGE[1]) -> Column:
    """P21 on an ``array<double>`` column (bounds fitted per feature)."""
    pts = F.concat(F.array(F.lit(float(lo))), bounds, F.array(F.lit(float(hi))))
    return F.transform(F.sequence(F.lit(1), F.size(pts) - 1),
                       lambda i: (F.element_at(pts, i) + F.element_at(pts, i + 1)) / 2.0)


# --- P22 ------------------------------------------------------------------
def _once(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with x computed a single time per row: a lambda that names x repeats it for every element."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def soft_bucket_weights(x: ColumnOrName, centers: Column, temp: float = SOFT_TEMP) -> Column:
    """softmax(-|x - center| / temp) over the centers (max-subtracted)."""
    def shares(ex: Column) -> Column:
        return _once(F.aggregate(ex, F.lit(0.0), lambda s, v: s + v), lambda tot: F.transform(ex, lambda e: e / tot))

    def softmax(logits: Column) -> Column:
        return _once(F.array_max(logits), lambda m: _once(F.transform(logits, lambda z: F.exp(z - m)), shares))

    return _once(_dbl(x), lambda xv: _once(F.transform(centers, lambda c: -F.abs(xv - c) / F.lit(float(temp))), softmax))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two equally long numeric arrays."""
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def soft_bucket(x: ColumnOrName, centers: Column, table: Column, temp: float = SOFT_TEMP) -> Column:
    """Soft-bucket weights dotted with a per-bucket value table."""
    return dot(soft_bucket_weights(x, centers, temp), table)


def soft_bucket_vector(x: ColumnOrName, centers: Column, table: Column, dim: int, temp: float = SOFT_TEMP) -> Column:
    """P22 with a ``dim`` wide table (array of one vector per bucket): the
    vectors' mean under the soft-bucket weights."""
    return _once(soft_bucket_weights(x, centers, temp), lambda w: F.transform(
        F.sequence(F.lit(1), F.lit(dim)), lambda j: dot(w, F.transform(table, lambda v: F.element_at(v, j)))))
