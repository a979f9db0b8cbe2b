"""Labels and reward rules (L1-L8), per-row losses (E1-E7), segmentation
(G1-G4), over the samples view."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiver.catalog import sqlbits as Q
from quiver.catalog.registry import query
from quiver.functions import labels as L
from quiver.functions import losses as E
from quiver.functions import segments as G
from quiver.plans.metrics import total_loss
from quiver.session import round6
from quiver.sources import fixtures as X

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KS = ", ".join(KEYS)
S = X.with_ctes(X.SAMPLES_SQL)

# sample-derived inputs for the reward rules
LEVEL_CUTS = [45000.0, 15000.0]            # descending: later (smaller) cut wins
LEVEL_THRESHOLDS = [1.0, 1.2, 1.5]
LEVEL_KEYS = {"high": 0, "medium": 1}
ASC_CUTS = [15000.0, 45000.0]
TREATMENTS = [0, 1]
V2_KEYS = {"high_and_control": 4, "high_and_treat": 5, "medium_and_control": 2, "medium_and_treat": 3}


def _reward_frame(spark, d):
    s = X.samples(spark, d)
    level, thr = G.partition_by_level("cost", LEVEL_CUTS, LEVEL_THRESHOLDS)
    seg = G.partition_level_treatment("cost", ASC_CUTS, F.col("l_linenumber") % 2, TREATMENTS)
    return s.select(*KEYS, (F.col("big_label") / 5.0).alias("reward"), (F.col("l_discount") * 20.0).alias("ratio"),
                    level.alias("level"), thr.alias("level_threshold"), seg.alias("seg"))


LEVEL_SQL = "CASE WHEN cost <= 15000.0 THEN 2 WHEN cost <= 45000.0 THEN 1 ELSE 0 END"
SEG_SQL = ("CASE WHEN l_linenumber % 2 NOT IN (0, 1) THEN 0 ELSE "
           "(CASE WHEN cost <= 15000.0 THEN 0 WHEN cost <= 45000.0 THEN 1 ELSE 2 END) * 2 + l_linenumber % 2 END")
REWARD_CTE = f"""r AS (SELECT {KS}, big_label / 5.0::DOUBLE AS reward, l_discount * 20.0::DOUBLE AS ratio,
                 {LEVEL_SQL} AS level, {SEG_SQL} AS seg FROM samples)"""
SR = X.with_ctes(X.SAMPLES_SQL, REWARD_CTE)


@query("L1_clip", S + f"""
SELECT {KS}, least(greatest(big_label * 2.0::DOUBLE, 0.0::DOUBLE), 300.0::DOUBLE) AS label_cap,
       least(greatest(l_discount - 0.05::DOUBLE, 0.0::DOUBLE), 300.0::DOUBLE) AS disc_cap FROM samples""")
def l1(spark, d):
    s = X.samples(spark, d)
    return s.select(*KEYS, L.clip(F.col("big_label") * 2.0).alias("label_cap"),
                    L.clip(F.col("l_discount") - 0.05).alias("disc_cap"))


@query("L2_binarize", S + f"""
SELECT {KS}, CASE WHEN least(greatest(convert_label, 0.0::DOUBLE), 300.0::DOUBLE) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS convert_bin,
       CASE WHEN least(greatest(roi1, 0.0::DOUBLE), 300.0::DOUBLE) >= 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS roi1_bin FROM samples""")
def l2(spark, d):
    s = X.samples(spark, d)
    return s.select(*KEYS, L.binarize("convert", L.clip("convert_label")).alias("convert_bin"),
                    L.binarize("roi1", L.clip("roi1")).alias("roi1_bin"))


@query("L3_log_tail", S + f"""
SELECT {KS}, {Q.r6("CASE WHEN big_label <= 100.0 THEN big_label ELSE 100.0 + ln(big_label - 100.0 + 1.0) END")} AS reg_label
FROM samples""")
def l3(spark, d):
    return X.samples(spark, d).select(*KEYS, round6(L.log_tail("big_label")).alias("reg_label"))


@query("L4_label_weight", S + f"""
SELECT {KS}, CASE WHEN roi1 <= 1 THEN 1.0::DOUBLE ELSE roi1 END AS weight FROM samples""")
def l4(spark, d):
    return X.samples(spark, d).select(*KEYS, L.label_weight("roi1").alias("weight"))


@query("L5_binarize_reward", SR + f"""
SELECT {KS}, CASE WHEN (level = 1 AND reward >= 11.2) OR (level = 0 AND reward >= 16.5) THEN 1.0 ELSE 0.0 END::DOUBLE
       AS reward_bin FROM r""")
def l5(spark, d):
    r = _reward_frame(spark, d)
    return r.select(*KEYS, L.binarize_reward("reward", "level", LEVEL_KEYS).alias("reward_bin"))


def _factors(high_empty: str, hi: str, med: str) -> str:
    return (f"(CASE WHEN {high_empty} THEN 0.1 ELSE 1.0 END * CASE WHEN {med} AND ratio = 0 THEN 0.1 ELSE 1.0 END"
            f" * CASE WHEN {hi} AND ratio > 1.3 THEN 0.8 ELSE 1.0 END * CASE WHEN {med} AND ratio > 1.3 THEN 0.8 ELSE 1.0 END)")


@query("L6_shape_reward", SR + f"""
SELECT {KS}, {Q.r6('reward * ' + _factors('level = 0 AND ratio = 0', 'level = 0', 'level = 1'))} AS shaped FROM r""")
def l6(spark, d):
    r = _reward_frame(spark, d)
    return r.select(*KEYS, round6(L.shape_reward("reward", "level", "ratio", LEVEL_KEYS)).alias("shaped"))


_HI2, _MED2 = "seg IN (4, 5)", "seg IN (2, 3)"


@query("L7_shape_reward_v2", SR + f"""
SELECT {KS}, {Q.r6('reward * ' + _factors(f'{_HI2} AND ratio = 0', _HI2, _MED2))} AS shaped,
       {Q.r6('reward * ' + _factors(f'{_MED2} AND ratio = 0', _HI2, _MED2))} AS shaped_ref FROM r""")
def l7(spark, d):
    r = _reward_frame(spark, d)
    return r.select(*KEYS, round6(L.shape_reward_v2("reward", "seg", "ratio", V2_KEYS)).alias("shaped"),
                    round6(L.shape_reward_v2("reward", "seg", "ratio", V2_KEYS, mode="reference")).alias("shaped_ref"))


@query("L8_positive_weight", S + f"""
SELECT {KS}, CASE WHEN l_linenumber % 2 = 0 THEN 6.2 ELSE 17.0 END::DOUBLE AS w_convert,
       CASE WHEN l_linenumber % 2 = 0 THEN 2.4 ELSE 3.2 END::DOUBLE AS w_active,
       CASE WHEN l_linenumber % 2 = 0 THEN 1.8 ELSE 3.4 END::DOUBLE AS w_cost, 12.4::DOUBLE AS w_convert_transfer
FROM samples""")
def l8(spark, d):
    s = X.samples(spark, d)
    a = F.col("l_linenumber") % 2
    return s.select(*KEYS, L.positive_weight("convert", a).alias("w_convert"),
                    L.positive_weight("active", a).alias("w_active"), L.positive_weight("cost", a).alias("w_cost"),
                    L.positive_weight("convert", a, transfer=True).alias("w_convert_transfer"))


# --- losses -------------------------------------------------------------------------
def _lt(x: str) -> str:
    return f"(CASE WHEN ({x}) <= 100.0 THEN ({x}) ELSE 100.0 + ln(({x}) - 100.0 + 1.0) END)"


PC = "least(greatest(p, 1e-7::DOUBLE), 1.0::DOUBLE - 1e-7::DOUBLE)"
ROI_BIN = "CASE WHEN least(greatest(roi1, 0.0::DOUBLE), 300.0::DOUBLE) >= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
REG_LABEL, REG_PRED = _lt("roi1"), _lt("greatest(p, 0.0::DOUBLE)")


def _reg(s):
    return L.log_tail("roi1"), L.log_tail(F.greatest(F.col("p"), F.lit(0.0)))


@query("E1_mae", S + f"SELECT {KS}, {Q.r6(f'abs({REG_LABEL} - {REG_PRED})')} AS mae FROM samples")
def e1(spark, d):
    s = X.samples(spark, d)
    y, p = _reg(s)
    return s.select(*KEYS, round6(E.mae(y, p)).alias("mae"))


@query("E2_huber", S + f"""
SELECT {KS}, {Q.r6(f"CASE WHEN abs({REG_PRED} - {REG_LABEL}) < 1.0 THEN 0.5 * abs({REG_PRED} - {REG_LABEL}) * abs({REG_PRED} - {REG_LABEL}) ELSE 1.0 * abs({REG_PRED} - {REG_LABEL}) - 0.5 * 1.0 * 1.0 END")} AS huber
FROM samples""")
def e2(spark, d):
    s = X.samples(spark, d)
    y, p = _reg(s)
    return s.select(*KEYS, round6(E.huber(y, p)).alias("huber"))


WCE_SQL = (f"-2.0 * (CASE WHEN convert_label > 0 THEN 1.0 ELSE 0.0 END) * ln({PC}) "
           f"- (1.0 - CASE WHEN convert_label > 0 THEN 1.0 ELSE 0.0 END) * ln(1.0 - {PC})")
FOCAL_SQL = (f"-0.25 * ({ROI_BIN}) * ln({PC}) * pow(1.0 - {PC}, 2.0) "
             f"- (1.0 - 0.25) * (1.0 - ({ROI_BIN})) * ln(1.0 - {PC}) * pow({PC}, 2.0)")


@query("E3_weighted_ce", S + f"SELECT {KS}, {Q.r6(WCE_SQL)} AS wce FROM samples")
def e3(spark, d):
    s = X.samples(spark, d)
    return s.select(*KEYS, round6(E.weighted_ce("convert_label", "p", 2.0)).alias("wce"))


Z_SQL = "ln(p / (1.0 - p))"


@query("E4_weighted_ce_logits", S + f"""
SELECT {KS}, {Q.r6(f"(1.0 - CASE WHEN roi1 > 0 THEN 1.0 ELSE 0.0 END) * {Z_SQL} + (1.0 + ((1.0 + roi1) - 1.0) * CASE WHEN roi1 > 0 THEN 1.0 ELSE 0.0 END) * (ln(1 + exp(-abs(-{Z_SQL}))) + greatest(-{Z_SQL}, 0.0::DOUBLE))")} AS wce_logit
FROM samples""")
def e4(spark, d):
    s = X.samples(spark, d)
    z = F.log(F.col("p") / (1.0 - F.col("p")))
    return s.select(*KEYS, round6(E.weighted_ce_logits("roi1", z)).alias("wce_logit"))


@query("E5_focal", S + f"SELECT {KS}, {Q.r6(FOCAL_SQL)} AS focal FROM samples")
def e5(spark, d):
    s = X.samples(spark, d)
    yb = L.binarize("roi1", L.clip("roi1"))
    return s.select(*KEYS, round6(E.focal(yb, "p")).alias("focal"))


@query("E6_cross_entropy", S + f"""
SELECT {KS}, {Q.r6(f"-convert_label * ln({PC}) - (1.0 - convert_label) * ln(1.0 - {PC})")} AS ce FROM samples""")
def e6(spark, d):
    return X.samples(spark, d).select(*KEYS, round6(E.cross_entropy("convert_label", "p")).alias("ce"))


LOSS_SPEC = "weighted_cross_entropy, focal_loss"   # the reference's default flag, trimmed here
CONV_BIN = "CASE WHEN least(greatest(convert_label, 0.0::DOUBLE), 300.0::DOUBLE) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def _task_losses(task: str, ybin: str) -> str:
    wce = f"-2.0 * ({ybin}) * ln({PC}) - (1.0 - ({ybin})) * ln(1.0 - {PC})"
    foc = (f"-0.25 * ({ybin}) * ln({PC}) * pow(1.0 - {PC}, 2.0) "
           f"- (1.0 - 0.25) * (1.0 - ({ybin})) * ln(1.0 - {PC}) * pow({PC}, 2.0)")
    return f"avg({wce}) AS {task}_weighted_cross_entropy, avg({foc}) AS {task}_focal_loss"


@query("E7_total_loss", S + f"""
SELECT {Q.r6('convert_weighted_cross_entropy')} AS convert_weighted_cross_entropy,
       {Q.r6('convert_focal_loss')} AS convert_focal_loss,
       {Q.r6('roi1_weighted_cross_entropy')} AS roi1_weighted_cross_entropy,
       {Q.r6('roi1_focal_loss')} AS roi1_focal_loss,
       {Q.r6('convert_weighted_cross_entropy + convert_focal_loss')} AS convert_loss,
       {Q.r6('roi1_weighted_cross_entropy + roi1_focal_loss')} AS roi1_loss,
       {Q.r6('convert_weighted_cross_entropy + convert_focal_loss + roi1_weighted_cross_entropy + roi1_focal_loss')} AS total_loss
FROM (SELECT {_task_losses('convert', CONV_BIN)}, {_task_losses('roi1', ROI_BIN)} FROM samples)""")
def e7(spark, d):
    s = X.samples(spark, d)
    names = E.parse_loss_names(LOSS_SPEC)
    fns = {"weighted_cross_entropy": lambda y: E.weighted_ce(y, "p", E.CE_WEIGHT),
           "focal_loss": lambda y: E.focal(y, "p")}
    per_task = {}
    for task, lab in (("convert", "convert_label"), ("roi1", "roi1")):
        yb = L.binarize(task, L.clip(lab))
        per_task[task] = {n: fns[n](yb) for n in names}
    out = total_loss(s, per_task)
    return out.select(*[round6(F.col(c)).alias(c) for c in out.columns])


# --- segmentation -------------------------------------------------------------------
@query("G1_in_list", f"SELECT {KS}, l_linenumber IN (1, 3, 5) AS in_list FROM lineitem")
def g1(spark, d):
    from quiver.session import table
    li = table(spark, d, "lineitem")
    return li.select(*KEYS, G.in_list("l_linenumber", [1, 3, 5]).alias("in_list"))


@query("G2_partition_by_list", f"""
SELECT {KS}, CASE WHEN l_linenumber IN (3, 4) THEN 3 WHEN l_linenumber IN (3) THEN 2
                  WHEN l_linenumber IN (1, 2) THEN 1 ELSE 0 END AS part,
       CASE WHEN l_linenumber IN (3, 4) THEN 1.3 WHEN l_linenumber IN (3) THEN 1.2
            WHEN l_linenumber IN (1, 2) THEN 1.1 ELSE 1.0 END::DOUBLE AS threshold FROM lineitem""")
def g2(spark, d):
    from quiver.session import table
    li = table(spark, d, "lineitem")
    part, thr = G.partition_by_list("l_linenumber", [(1, 2), 3, (3, 4)], [1.0, 1.1, 1.2, 1.3])
    return li.select(*KEYS, part.alias("part"), thr.alias("threshold"))


@query("G3_partition_by_level", S + f"""
SELECT {KS}, {LEVEL_SQL} AS level,
       CASE WHEN cost <= 15000.0 THEN 1.5 WHEN cost <= 45000.0 THEN 1.2 ELSE 1.0 END::DOUBLE AS level_threshold
FROM samples""")
def g3(spark, d):
    r = _reward_frame(spark, d)
    return r.select(*KEYS, "level", "level_threshold")


def _g4_ref_sql() -> str:
    steps = []
    for i, c in enumerate(ASC_CUTS):
        for j, t in enumerate(TREATMENTS):
            steps.append((f"cost <= {c} AND l_linenumber % 2 = {t}", i * 2 + j))
    for j, t in enumerate(TREATMENTS):
        steps.append((f"cost > {ASC_CUTS[-1]} AND l_linenumber % 2 = {t}", len(ASC_CUTS) * 2 + j))
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in reversed(steps)) + " ELSE 0 END"


@query("G4_partition_level_treatment", S + f"""
SELECT {KS}, {SEG_SQL} AS seg, {_g4_ref_sql()} AS seg_ref FROM samples""")
def g4(spark, d):
    s = X.samples(spark, d)
    t = F.col("l_linenumber") % 2
    return s.select(*KEYS, G.partition_level_treatment("cost", ASC_CUTS, t, TREATMENTS).alias("seg"),
                    G.partition_level_treatment("cost", ASC_CUTS, t, TREATMENTS, mode="reference").alias("seg_ref"))
