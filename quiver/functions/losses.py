"""Per-row losses (E1-E6) as column builders; the task value is their mean
(see ``quiver.plans.metrics.total_loss``, E7).

Log losses clamp the probability to [1e-7, 1 - 1e-7]: without it Spark gives
NULL for ln(0) where other engines give -inf."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiver.functions.transforms import ColumnOrName, _dbl

EPS = 1e-7
# Fixed values of the reference: focal alpha 0.25, gamma 2; cross-entropy
# positive weight 2.0; huber delta 1.0.
FOCAL_ALPHA = 0.25
FOCAL_GAMMA = 2.0
CE_WEIGHT = 2.0
HUBER_DELTA = 1.0


def _clamp_p(p: ColumnOrName) -> Column:
    return F.least(F.greatest(_dbl(p), F.lit(EPS)), F.lit(1.0 - EPS))


def _pos(y: ColumnOrName) -> Column:
    return F.when(_dbl(y) > 0, F.lit(1.0)).otherwise(F.lit(0.0))


def mae(label: ColumnOrName, pred: ColumnOrName) -> Column:
    """|label - pred|."""
    return F.abs(_dbl(label) - _dbl(pred))


def huber(label: ColumnOrName, pred: ColumnOrName, delta: float = HUBER_DELTA) -> Column:
    """r^2/2 for r < delta, else delta*r - delta^2/2."""
    r = F.abs(_dbl(pred) - _dbl(label))
    d = float(delta)
    return F.when(r < d, 0.5 * r * r).otherwise(d * r - 0.5 * d * d)


def weighted_ce(y: ColumnOrName, p: ColumnOrName, weight: float = CE_WEIGHT) -> Column:
    """-w*y*ln p - (1-y)*ln(1-p) with y := y > 0."""
    yb, pc = _pos(y), _clamp_p(p)
    return -F.lit(float(weight)) * yb * F.log(pc) - (1.0 - yb) * F.log(1.0 - pc)


def softplus(z: Column) -> Column:
    """Numerically stable ln(1 + e^z)."""
    return F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0))


def weighted_ce_logits(y: ColumnOrName, z: ColumnOrName) -> Column:
    """Weighted cross-entropy on a logit; label t := y > 0, positive
    weight q = 1 + y: (1-t)*z + (1 + (q-1)*t) * softplus(-z)."""
    t, zv, q = _pos(y), _dbl(z), 1.0 + _dbl(y)
    return (1.0 - t) * zv + (1.0 + (q - 1.0) * t) * softplus(-zv)


def focal(y: ColumnOrName, p: ColumnOrName, alpha: float = FOCAL_ALPHA,
          gamma: float = FOCAL_GAMMA) -> Column:
    """E5: -a*y*ln p*(1-p)^g - (1-a)*(1-y)*ln(1-p)*p^g."""
    yv, pc = _dbl(y), _clamp_p(p)
    a, g = float(alpha), float(gamma)
    return (-a * yv * F.log(pc) * F.pow(1.0 - pc, g)
            - (1.0 - a) * (1.0 - yv) * F.log(1.0 - pc) * F.pow(pc, g))


def cross_entropy(y: ColumnOrName, p: ColumnOrName) -> Column:
    """-y ln p - (1-y) ln(1-p)."""
    yv, pc = _dbl(y), _clamp_p(p)
    return -yv * F.log(pc) - (1.0 - yv) * F.log(1.0 - pc)


LOSSES = ("mae", "huber", "weighted_cross_entropy", "focal_loss", "cross_entropy")


def parse_loss_names(spec: str) -> list[str]:
    """Comma list of loss names, trimmed; unknown names are rejected (the
    reference drops a name silently when it carries a space)."""
    names = [s.strip() for s in spec.split(",") if s.strip()]
    bad = [n for n in names if n not in LOSSES]
    if bad:
        raise ValueError(f"unknown loss: {bad}")
    return names
