"""Label shaping and reward rules (L1-L8) as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiver.functions.transforms import ColumnOrName, _dbl

# Fixed values that must equal the reference for the same results:
# label cap 0..300; log tail knee 100; reward thresholds medium 11.2, high 16.5;
# reward factors: empty run (bill ratio 0) x0.1, over-billing (ratio > 1.3) x0.8;
# positive weights per task, (transfer, auto type 0, other auto type):
#   convert 12.4 / 6.2 / 17, active 3.2 / 2.4 / 3.2, cost 4.3 / 1.8 / 3.4.
LABEL_CAP = (0.0, 300.0)
LOG_TAIL_KNEE = 100.0
REWARD_THRESHOLDS = (11.2, 16.5)
EMPTY_RUN_FACTOR = 0.1
HIGH_BILL_RATIO = 1.3
HIGH_BILL_FACTOR = 0.8
POSITIVE_WEIGHTS = {
    "convert": (12.4, 6.2, 17.0),
    "active": (3.2, 2.4, 3.2),
    "cost": (4.3, 1.8, 3.4),
}


def clip(x: ColumnOrName, lb: float = LABEL_CAP[0], ub: float = LABEL_CAP[1]) -> Column:
    """L1: clamp to [lb, ub]."""
    return F.least(F.greatest(_dbl(x), F.lit(float(lb))), F.lit(float(ub)))


def binarize(task: str, x: ColumnOrName) -> Column:
    """L2: convert -> x > 0, any other task -> x >= 1 (on the clipped label)."""
    v = _dbl(x)
    cond = v > 0 if task == "convert" else v >= 1
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def log_tail(x: ColumnOrName, knee: float = LOG_TAIL_KNEE) -> Column:
    """L3: identity up to the knee, then knee + ln(x - knee + 1)."""
    v = _dbl(x)
    k = F.lit(float(knee))
    return F.when(v <= k, v).otherwise(k + F.log(v - k + F.lit(1.0)))


def label_weight(y: ColumnOrName) -> Column:
    """L4: 1 if y <= 1 else y."""
    v = _dbl(y)
    return F.when(v <= 1, F.lit(1.0)).otherwise(v)


def binarize_reward(reward: ColumnOrName, level: ColumnOrName, keys: dict,
                    thresholds: tuple[float, float] = REWARD_THRESHOLDS) -> Column:
    """1 if (medium and r >= t0) or (high and r >= t1) else 0."""
    t0, t1 = thresholds
    if t0 > t1:
        raise ValueError(f"thresholds must be ascending: {thresholds}")
    r, lv = _dbl(reward), F.col(level) if isinstance(level, str) else level
    hit = ((lv == F.lit(keys["medium"])) & (r >= t0)) | ((lv == F.lit(keys["high"])) & (r >= t1))
    return F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0))


def _shape(r: Column, in_high: Column, in_medium: Column, ratio: Column,
           high_empty: Column | None = None) -> Column:
    empty = ratio == 0.0
    over = ratio > HIGH_BILL_RATIO
    he = high_empty if high_empty is not None else (in_high & empty)
    f = (F.when(he, EMPTY_RUN_FACTOR).otherwise(1.0)
         * F.when(in_medium & empty, EMPTY_RUN_FACTOR).otherwise(1.0)
         * F.when(in_high & over, HIGH_BILL_FACTOR).otherwise(1.0)
         * F.when(in_medium & over, HIGH_BILL_FACTOR).otherwise(1.0))
    return r * f


def shape_reward(reward: ColumnOrName, level: ColumnOrName, bill_ratio: ColumnOrName,
                 keys: dict) -> Column:
    """For high and medium levels, x0.1 on an empty run (ratio = 0) and
    x0.8 on over-billing (ratio > 1.3). Other levels unchanged."""
    lv = F.col(level) if isinstance(level, str) else level
    return _shape(_dbl(reward), lv == F.lit(keys["high"]), lv == F.lit(keys["medium"]),
                  _dbl(bill_ratio))


def shape_reward_v2(reward: ColumnOrName, level: ColumnOrName, bill_ratio: ColumnOrName,
                    keys: dict, mode: str = "corrected") -> Column:
    """L6 over level x {control, treat} keys.

    ``keys`` holds high_and_control, high_and_treat, medium_and_control,
    medium_and_treat. ``mode='reference'`` reproduces the reference's mask for
    the high empty run, which tests the *medium* keys: a medium empty run is
    scaled twice (0.01) and a high empty run not at all."""
    lv = F.col(level) if isinstance(level, str) else level
    in_high = lv.isin(keys["high_and_control"], keys["high_and_treat"])
    in_med = lv.isin(keys["medium_and_control"], keys["medium_and_treat"])
    ratio = _dbl(bill_ratio)
    if mode == "reference":
        return _shape(_dbl(reward), in_high, in_med, ratio, high_empty=in_med & (ratio == 0.0))
    if mode != "corrected":
        raise ValueError(f"unknown mode: {mode}")
    return _shape(_dbl(reward), in_high, in_med, ratio)


def positive_weight(task: str, auto_type: ColumnOrName, transfer: bool = False) -> Column:
    """Positive-class weight per task; unknown tasks raise."""
    if task not in POSITIVE_WEIGHTS:
        raise ValueError(f"unknown task: {task}")
    w_transfer, w_auto0, w_other = POSITIVE_WEIGHTS[task]
    if transfer:
        return F.lit(w_transfer)
    a = F.col(auto_type) if isinstance(auto_type, str) else auto_type
    return F.when(a == 0, F.lit(w_auto0)).otherwise(F.lit(w_other))
