"""Running statistics over steps.

Per step, the value, the mean of all values so far, and the EMA
``e_n = d * e_(n-1) + (1 - d) * v_n`` from e_0 = 0 (no bias correction).

The EMA is computed in closed form, block by block, with no sequential loop:
inside a block of B consecutive positions, ``e_n = d^o * carry + (1-d) * d^o *
sum_{i<=n} v_i d^(-o_i)`` with o the offset in the block. B is chosen so that
``d^(-B)`` stays finite in double precision, and the carry into a block comes
from the last few blocks only: older blocks are scaled by less than 1e-300.
Positions and running sums come from ``plans.prefix.running_totals`` (range
buckets), so no window ever spans the whole table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiver.plans.prefix import running_totals
from quiver.session import cut_lineage

# Fixed values of the reference: EMA decay 0.999 by default, 0.99 from its flag.
EMA_DECAY_DEFAULT = 0.999
EMA_DECAY_FLAG = 0.99


def ema_block_size(decay: float, max_block: int = 1_000_000) -> int:
    """Largest B with d^(-B) <= e^600 (finite double), capped."""
    if not 0.0 < decay < 1.0:
        raise ValueError("decay must lie in (0, 1)")
    return max(1, min(max_block, int(600.0 / -math.log(decay))))


def running_stats(df: DataFrame, step: str, values: Sequence[str], decay: float = EMA_DECAY_DEFAULT,
                  n_buckets: int | None = None, block: int | None = None, log_every: int = 1) -> DataFrame:
    """For each value column v adds ``<v>_mean`` (running mean) and
    ``<v>_ema``. ``step`` orders the rows and must be unique. ``log_every``
    keeps every k-th step only (the hook's logging interval); the statistics
    still run over all steps."""
    d = float(decay)
    B = min(block or ema_block_size(d), ema_block_size(d))
    # positions 1..N and running sums, distributed over range buckets
    filled = df.select("*", *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(f"_z_{v}") for v in values])
    r = running_totals(filled, step, [f"_z_{v}" for v in values], n_buckets=n_buckets, with_count="_pos")
    r = r.withColumn("_blk", F.floor((F.col("_pos") - 1) / F.lit(B))) \
         .withColumn("_o", F.col("_pos") - F.col("_blk") * F.lit(B))
    # the positioned steps feed both the per-block windows and the block
    # totals: write them once to the shared checkpoint folder (cuts the
    # lineage; survives the loss of executors)
    r = cut_lineage(r)
    w = Window.partitionBy("_blk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    local = r.select("*", *[F.sum(F.col(f"_z_{v}") * F.pow(F.lit(d), -F.col("_o"))).over(w).alias(f"_loc_{v}")
                            for v in values])
    # per block: its contribution to the EMA at the block's last position
    # (full blocks have length B), then the carry from the previous blocks
    tot = r.groupBy("_blk").agg(*[F.sum(F.col(f"_z_{v}") * F.pow(F.lit(d), F.lit(B) - F.col("_o"))).alias(f"_t_{v}")
                                  for v in values])
    carry = _carry(tot, values, d, B)
    # one row per block: AQE broadcasts it when its measured size is small
    j = local.join(carry, "_blk")
    out = [F.col(c) for c in df.columns]
    for v in values:
        do = F.pow(F.lit(d), F.col("_o"))
        out.append((F.col(f"cum__z_{v}") / F.col("_pos")).alias(f"{v}_mean"))
        out.append((do * F.col(f"_c_{v}") + F.lit(1.0 - d) * do * F.col(f"_loc_{v}")).alias(f"{v}_ema"))
    if log_every > 1:
        j = j.filter(F.col("_pos") % F.lit(log_every) == 0)
    return j.select(*out)


def _carry(tot: DataFrame, values: Sequence[str], d: float, B: int) -> DataFrame:
    """EMA value before each block. A block maps the EMA e to d^B * e + t (an affine map); maps compose, so blocks are to
    the EMA what steps are, with the decay D = d^B. They are grouped into
    super-blocks: inside one a window composes the maps before a block in closed form, and a super-block takes the totals
    of the few before it (older ones underflow) by a join, so no window holds the whole block table, whatever the block size."""
    x = -math.log(d) * B                                  # -ln D
    size = max(1, int(600.0 / x))                         # D^-size stays finite
    reach = max(1, math.ceil(700.0 / (size * x)))
    D = lambda n: F.exp(F.lit(-x) * n)
    j = F.col("_blk") - F.col("_sup") * F.lit(size)       # place in the super-block
    blocks = tot.withColumn("_sup", F.floor(F.col("_blk") / F.lit(size)))
    before = Window.partitionBy("_sup").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    t = {v: F.lit(1.0 - d) * F.col(f"_t_{v}") for v in values}
    inside = blocks.select("_blk", "_sup", *[(D(j - 1) * F.coalesce(F.sum(t[v] * D(-j)).over(before), F.lit(0.0))).alias(f"_in_{v}") for v in values])
    whole = blocks.groupBy("_sup").agg(*[F.sum(t[v] * D(F.lit(size - 1) - j)).alias(f"_T_{v}") for v in values])
    lag = F.explode(F.array(*[F.lit(k) for k in range(1, reach + 1)]))
    later = whole.withColumn("_lag", lag).groupBy((F.col("_sup") + F.col("_lag")).alias("_to")).agg(
        *[F.sum(F.col(f"_T_{v}") * D(F.lit(size) * (F.col("_lag") - 1))).alias(f"_C_{v}") for v in values])
    return inside.join(later, F.col("_sup") == F.col("_to"), "left").select(
        "_blk", *[(F.col(f"_in_{v}") + D(j) * F.coalesce(f"_C_{v}", F.lit(0.0))).alias(f"_c_{v}") for v in values])
