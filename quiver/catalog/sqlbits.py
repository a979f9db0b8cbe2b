"""Small SQL builders for the DuckDB oracle strings (same formulas as the
Spark column builders)."""

from __future__ import annotations

from collections.abc import Sequence


def arr(bounds: Sequence[float]) -> str:
    return "[" + ", ".join(repr(float(b)) for b in bounds) + "]::DOUBLE[]"


def compress(x: str, log: bool = True) -> str:
    c = f"greatest(coalesce(({x})::DOUBLE, 0.0::DOUBLE), 0.0::DOUBLE)"
    return f"ln(1 + {c})" if log else c


def log1p(x: str) -> str:
    """Spark's log1p: NULL at or below -1."""
    return f"(CASE WHEN ({x}) <= -1 THEN NULL ELSE ln(1 + ({x})) END)"


def bucket(x: str, bounds: Sequence[float]) -> str:
    return f"len(list_filter({arr(bounds)}, lambda b: ({x}) >= b))::INTEGER"


def r6(x: str) -> str:
    return f"(round(({x})::DOUBLE * 1048576.0, 0) / 1048576.0 + 0.0::DOUBLE)"


def signed_delta(v1: str, v2: str, mode: str = "reference") -> str:
    d = f"(({v2})::DOUBLE - ({v1})::DOUBLE)"
    if mode == "reference":
        relu = f"greatest({d}, 0.0::DOUBLE)"
        return f"(CASE WHEN ({v1}) <= ({v2}) THEN -ln(1 + {relu}) ELSE ln(1 + {relu}) END + 0.0::DOUBLE)"
    return f"(sign({d}) * ln(1 + abs({d})) + 0.0::DOUBLE)"


def log_ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({a}) <= -1 OR ({b}) <= -1 THEN -1.0::DOUBLE ELSE {compress(a)} - {compress(b)} END)"
