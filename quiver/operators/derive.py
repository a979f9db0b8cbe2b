"""Derived features (P10, P12-P14): log ratios and multi-horizon deltas.

The column lists are built in Python from ``df.columns`` at plan time; the
result is one projection, evaluated row by row inside one codegen stage.
Scalar and array (fixed-length 2-D) features are both handled; arrays go
elementwise through ``zip_with``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from quiver.functions.transforms import bucketize, log_ratio, signed_delta
from quiver.operators.features import BUCKET_PREFIX, bucket_features_2d


def _is_array(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, ArrayType)


def _pairwise(df: DataFrame, a: str, b: str, fn) -> Column:
    if _is_array(df, a) or _is_array(df, b):
        return F.zip_with(F.col(a), F.col(b), fn)
    return fn(F.col(a), F.col(b))


def apply_log_ratios(df: DataFrame, defs: Sequence[tuple[str, str, str]]) -> tuple[DataFrame, list[str]]:
    """P10: for each (numerator, denominator, output) with both inputs present,
    output = -1 if either <= -1 else compress(num) - compress(den). The output
    may overwrite the numerator, as in the reference's definitions."""
    exprs: dict[str, Column] = {}
    made = []
    for num, den, out in defs:
        if num not in df.columns or den not in df.columns:
            continue
        exprs[out] = _pairwise(df, num, den, log_ratio).alias(out)
        made.append(out)
    keep = [F.col(c) for c in df.columns if c not in exprs]
    return df.select(*keep, *exprs.values()), made


def _delta_fn(prev_h: float, cur_h: float, mode: str):
    def fn(p: Column, c: Column) -> Column:
        pv, cv = p.cast("double"), c.cast("double")
        return F.when((pv <= -1) | (cv <= -1), F.lit(-1.0)).otherwise(
            signed_delta(pv / F.lit(float(prev_h)), cv / F.lit(float(cur_h)), mode))
    return fn


def horizon_deltas(df: DataFrame, ladders: Mapping[str, Sequence[int]], key: str,
                   specs: Mapping[str, Sequence[float]], mode: str = "reference"
                   ) -> tuple[DataFrame, list[str]]:
    """Per metric, walk its window ladder [w0, w1, ...]. For each next
    window, if either input column or the output's bounds is missing, skip it
    *without* advancing the previous window; otherwise emit
    ``<m>_<prev>_<cur>h_<key>_all`` = -1 if either input <= -1, else
    P11(prev / prev_h, cur / cur_h) -- an hourly-rate comparison -- and
    advance. Returns the frame and the emitted names."""
    exprs, made = [], []
    for m, ladder in ladders.items():
        prev = ladder[0]
        for cur in ladder[1:]:
            a, b = f"{m}_{prev}h_{key}_all", f"{m}_{cur}h_{key}_all"
            out = f"{m}_{prev}_{cur}h_{key}_all"
            if a not in df.columns or b not in df.columns or out not in specs:
                continue
            exprs.append(_pairwise(df, a, b, _delta_fn(prev, cur, mode)).alias(out))
            made.append(out)
            prev = cur
    return df.select("*", *exprs), made


def features_2d(df: DataFrame, specs: Mapping[str, Sequence[float]],
                log_specs: Mapping[str, Sequence[float]] | None = None,
                ratios: Sequence[tuple[str, str, str]] = (), ladders: Mapping[str, Sequence[int]] | None = None,
                key: str = "", reduce: str = "max", need_log1p: bool = False, mode: str = "reference",
                prefix: str = BUCKET_PREFIX) -> tuple[DataFrame, list[str]]:
    """P6 whole: ratio features (P10) and horizon deltas (P12) of the array
    columns, elementwise, then bucket ids of these and of all listed features
    (``bucket_features_2d``). Ratios and deltas are exempt from the first
    compression. Returns the frame and the bucketized names."""
    out, made = apply_log_ratios(df, ratios)
    more: list[str] = []
    if ladders:
        out, more = horizon_deltas(out, ladders, key, specs, mode)
    return bucket_features_2d(out, specs, log_specs, reduce=reduce, need_log1p=need_log1p, exempt=[*made, *more], prefix=prefix)


def time_delta_ratio(df: DataFrame, names: Sequence[str], scales: Sequence[float], name: str,
                     mode: str = "corrected") -> tuple[DataFrame, list[str]]:
    """For adjacent pairs i, i+1:
    ``delta_<name>_<i+1>`` = P11(f_i / s_i, f_{i+1} / s_{i+1}) and
    ``ratio_<name>_<i+1>`` = log1p(f_i / s_i) - log1p(f_{i+1} / s_{i+1}).
    ``mode='reference'`` reuses f_i in the second term (as the reference does)
    and uses the reference's delta; the default uses the symmetric delta."""
    if len(names) != len(scales):
        raise ValueError("names and scales differ in length")
    delta_mode = "reference" if mode == "reference" else "symmetric"
    exprs, made = [], []
    for i in range(len(names) - 1):
        fi = F.col(names[i]).cast("double") / F.lit(float(scales[i]))
        fj = F.col(names[i + 1]).cast("double") / F.lit(float(scales[i + 1]))
        second = F.col(names[i]).cast("double") if mode == "reference" else F.col(names[i + 1]).cast("double")
        d, r = f"delta_{name}_{i + 1}", f"ratio_{name}_{i + 1}"
        exprs.append(signed_delta(fi, fj, delta_mode).alias(d))
        exprs.append((F.log1p(fi) - F.log1p(second / F.lit(float(scales[i + 1])))).alias(r))
        made += [d, r]
    return df.select("*", *exprs), made


def bucket_time_deltas(df: DataFrame, triples: Sequence[str], names: Sequence[str],
                       specs: Mapping[str, Sequence[float]], skip_shadow: bool = False,
                       scales: Sequence[float] = (1.0, 3.0, 7.0),
                       mode: str = "corrected") -> tuple[DataFrame, list[str], list[str]]:
    """Consecutive triples of 1/3/7-unit columns through P13 with
    ``scales`` (1, 3, 7 in the reference), then bucketized with ``specs``. Returns (frame with ``b_<name>``
    bucket columns, kept names, names skipped for containing 'shadow')."""
    if len(triples) % 3 != 0 or len(triples) // 3 != len(names):
        raise ValueError("need 3 columns per name")
    cur = df
    made: list[str] = []
    for k, nm in enumerate(names):
        cur, m = time_delta_ratio(cur, triples[3 * k:3 * k + 3], list(scales), nm, mode)
        made += m
    kept = [n for n in made if not (skip_shadow and "shadow" in n)]
    skipped = [n for n in made if n not in kept]
    out = cur.select(*df.columns, *[bucketize(F.col(n).cast("float"), specs[n]).alias(f"b_{n}") for n in kept])
    return out, kept, skipped
