"""Segmentation (G1-G4) as column builders.

The reference assigns segments by a sequence of overwriting ``where`` steps
(the last matching step wins). ``_last_wins`` expresses exactly that as one
CASE WHEN with the steps in reverse order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiver.functions.transforms import ColumnOrName, _c


def _last_wins(steps: list[tuple[Column, Column]], default: Column) -> Column:
    if not steps:
        return default
    rev = list(reversed(steps))
    out = F.when(rev[0][0], rev[0][1])
    for cond, val in rev[1:]:
        out = out.when(cond, val)
    return out.otherwise(default)


def in_list(x: ColumnOrName, values: Sequence) -> Column:
    """G1: x equals any listed value."""
    return _c(x).isin(list(values))


def partition_by_list(x: ColumnOrName, groups: Sequence, thresholds: Sequence[float]
                      ) -> tuple[Column, Column]:
    """Group i (an int or a tuple of ints) -> partition i+1 with threshold
    t[i+1]; unlisted values -> 0 / t[0]; a later group wins."""
    if len(thresholds) != len(groups) + 1:
        raise ValueError("need len(thresholds) == len(groups) + 1")
    xv = _c(x)
    part_steps, thr_steps = [], []
    for i, g in enumerate(groups):
        if isinstance(g, tuple):
            vals = list(g)
        elif isinstance(g, int):
            vals = [g]
        else:
            raise ValueError(f"group must be int or tuple: {g!r}")
        cond = xv.isin(vals)
        part_steps.append((cond, F.lit(i + 1)))
        thr_steps.append((cond, F.lit(float(thresholds[i + 1]))))
    return (_last_wins(part_steps, F.lit(0)),
            _last_wins(thr_steps, F.lit(float(thresholds[0]))))


def partition_by_level(x: ColumnOrName, cuts: Sequence[float], thresholds: Sequence[float]
                       ) -> tuple[Column, Column]:
    """For each cut in the given order, x <= cut -> level i+1 with
    threshold t[i+1]; a later cut wins (so cuts are meant to be descending);
    no cut matched -> 0 / t[0]."""
    if len(thresholds) != len(cuts) + 1:
        raise ValueError("need len(thresholds) == len(cuts) + 1")
    for c in cuts:
        if not isinstance(c, float):
            raise ValueError(f"cuts must be floats: {c!r}")
    xv = _c(x).cast("double")
    lv = [(xv <= F.lit(c), F.lit(i + 1)) for i, c in enumerate(cuts)]
    th = [(xv <= F.lit(c), F.lit(float(thresholds[i + 1]))) for i, c in enumerate(cuts)]
    return _last_wins(lv, F.lit(0)), _last_wins(th, F.lit(float(thresholds[0])))


def partition_level_treatment(x: ColumnOrName, cuts: Sequence[float], treatment: ColumnOrName,
                              treatments: Sequence[int], mode: str = "corrected") -> Column:
    """Segment id = level * T + j for treatment j of T.

    ``corrected``: level = index of the first ascending cut with x <= cut, or
    len(cuts) above the last cut. ``reference``: the reference's overwrite
    order (each (cut, treatment) step, then x > cuts[-1]), in which the first
    level never survives with two or more cuts. Unlisted treatment -> 0."""
    xv, tv = _c(x).cast("double"), _c(treatment)
    n_t = len(treatments)
    if mode == "reference":
        steps = []
        for i, c in enumerate(cuts):
            for j, t in enumerate(treatments):
                steps.append(((xv <= F.lit(float(c))) & (tv == F.lit(t)), F.lit(i * n_t + j)))
        for j, t in enumerate(treatments):
            steps.append(((xv > F.lit(float(cuts[-1]))) & (tv == F.lit(t)),
                          F.lit(len(cuts) * n_t + j)))
        return _last_wins(steps, F.lit(0))
    if mode != "corrected":
        raise ValueError(f"unknown mode: {mode}")
    asc = sorted(float(c) for c in cuts)
    level = F.lit(len(asc))
    for i in reversed(range(len(asc))):
        level = F.when(xv <= F.lit(asc[i]), F.lit(i)).otherwise(level)
    tidx = F.lit(None).cast("int")
    for j in reversed(range(n_t)):
        tidx = F.when(tv == F.lit(treatments[j]), F.lit(j)).otherwise(tidx)
    return F.when(tidx.isNull() | xv.isNull(), F.lit(0)).otherwise(level * n_t + tidx)
