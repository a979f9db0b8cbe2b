"""Aggregations and metrics.

Scalar metrics are aggregate Column expressions so several of them share one
scan. AUCs never pair rows: they group by score (or score bin) and add up
negatives ranked below each positive (Mann-Whitney with half ties); the
exact form runs that sum with ``plans.prefix.running_totals``.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.functions import labels as L
from quiver.functions.transforms import ColumnOrName, _c, _dbl, bucketize, compress
from quiver.plans.prefix import cuts_and_totals, default_buckets, range_bucket, running_totals
from quiver.session import spread

# Fixed values of the reference's evaluation: accuracy thresholds 0.1 .. 0.9,
# decision threshold 0.5, a 200-point ROC grid and the 4-point grid
# 0.08, 0.1, 0.2, 0.5; accuracy/precision/recall denominators floored at 1e-5.
SWEEP_THRESHOLDS = ("0.1", "0.2", "0.3", "0.4", "0.5", "0.6", "0.7", "0.8", "0.9")
DECISION_THRESHOLD = 0.5
ROC_POINTS = 200
GRID4 = (0.08, 0.1, 0.2, 0.5)


# --- A1, A4-A6, A8, A11 as aggregate expressions ---------------------------
def masked_mean(x: ColumnOrName, mask: ColumnOrName) -> Column:
    """A1: mean of x over rows where mask is true."""
    return F.avg(F.when(_c(mask), _dbl(x)))


def accuracy(pred: ColumnOrName, label: ColumnOrName, mask: ColumnOrName | None = None,
             eps: float = 1e-5) -> Column:
    """A4: sum([pred = label] * mask) / max(sum(mask), eps); 1.0 if sum(mask) = 0."""
    m = _dbl(mask) if mask is not None else F.lit(1.0)
    hit = F.when(_dbl(pred) == _dbl(label), F.lit(1.0)).otherwise(F.lit(0.0))
    sm = F.coalesce(F.sum(m), F.lit(0.0))
    return F.when(sm > 0, F.sum(hit * m) / F.greatest(sm, F.lit(eps))).otherwise(F.lit(1.0))


def precision(pred: ColumnOrName, label: ColumnOrName, eps: float = 1e-5) -> Column:
    """A5: sum(pred * label) / sum(pred); 1.0 when sum(pred) = 0."""
    sp = F.coalesce(F.sum(_dbl(pred)), F.lit(0.0))
    return F.when(sp > 0, F.sum(_dbl(pred) * _dbl(label)) / F.greatest(sp, F.lit(eps))).otherwise(F.lit(1.0))


def recall(pred: ColumnOrName, label: ColumnOrName, eps: float = 1e-5) -> Column:
    """sum(pred * label) / sum(label); 1.0 when sum(label) = 0."""
    sl = F.coalesce(F.sum(_dbl(label)), F.lit(0.0))
    return F.when(sl > 0, F.sum(_dbl(pred) * _dbl(label)) / F.greatest(sl, F.lit(eps))).otherwise(F.lit(1.0))


def mean_metrics(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean of each column, one row."""
    return df.agg(*[F.avg(_dbl(c)).alias(f"mean_{c}") for c in cols])


def mse(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Mean squared difference."""
    d = _dbl(a) - _dbl(b)
    return F.avg(d * d)


def accuracy_sweep(pred: ColumnOrName, binary_label: ColumnOrName,
                   thresholds: Sequence[str] = SWEEP_THRESHOLDS) -> list[Column]:
    """Accuracy of (pred >= t) against the binary label, per threshold.
    Thresholds are decimal strings so 0.3 is the literal 0.3."""
    p, y = _dbl(pred), _dbl(binary_label)
    return [F.avg(F.when((F.when(p >= F.lit(float(t)), 1.0).otherwise(0.0)) == y, 1.0).otherwise(0.0))
            .alias(f"acc_threshold_{t}") for t in thresholds]


def confusion(pred: ColumnOrName, binary_label: ColumnOrName, t: float = DECISION_THRESHOLD) -> list[Column]:
    """A10: TP, FP, TN, FN of (pred >= t)."""
    pos, y = _dbl(pred) >= F.lit(t), _dbl(binary_label) > 0.5
    return [F.count_if(pos & y).alias("TP"), F.count_if(pos & ~y).alias("FP"),
            F.count_if(~pos & ~y).alias("TN"), F.count_if(~pos & y).alias("FN")]


def recall_at(pred: ColumnOrName, binary_label: ColumnOrName, t: float = DECISION_THRESHOLD) -> Column:
    """TP / (TP + FN) of (pred >= t); NULL without positives."""
    pos, y = _dbl(pred) >= F.lit(t), _dbl(binary_label) > 0.5
    return F.count_if(pos & y) / F.nullif(F.count_if(y), F.lit(0))


# --- AUC --------------------------------------------------------------------
def roc_bin(pred: ColumnOrName, n: int = ROC_POINTS) -> Column:
    """Bin on the grid t_i = i/(n-1): number of grid points strictly below p."""
    b = F.ceil(_dbl(pred) * F.lit(float(n - 1)))
    return F.least(F.greatest(b, F.lit(0)), F.lit(n)).cast("int")


def grid_bin(pred: ColumnOrName, grid: Sequence[float] = GRID4) -> Column:
    """Bin on an explicit threshold grid: number of thresholds strictly below p."""
    p = _dbl(pred)
    out = F.lit(0)
    for t in grid:
        out = out + F.when(p > F.lit(float(t)), 1).otherwise(0)
    return out.cast("int")


def _auc_from_bins(binned: DataFrame, by: Sequence[str], bin_col: str = "bin") -> DataFrame:
    """Trapezoid ROC area from per-bin positive/negative counts.

    Input columns: *by, bin, pos, neg (one row per bin). The number of bins
    per group is bounded by the grid, so the window is small."""
    w = Window.partitionBy(*by).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
    below = binned.withColumn("neg_below", F.coalesce(F.sum("neg").over(w), F.lit(0.0)))
    return below.groupBy(*by).agg(
        (F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
         / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc"))


def binned_auc(df: DataFrame, pred: str, binary_label: str, n: int = ROC_POINTS,
               grid: Sequence[float] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """ROC area on a fixed threshold grid (trapezoid), end points
    (0,0) and (1,1); NULL without both classes."""
    b = grid_bin(pred, grid) if grid is not None else roc_bin(pred, n)
    y = _dbl(binary_label) > 0.5
    g = (df.select(*by, b.alias("bin"), y.alias("_y"))
         .groupBy(*by, "bin")
         .agg(F.count_if("_y").cast("double").alias("pos"), F.count_if(~F.col("_y")).cast("double").alias("neg")))
    return _auc_from_bins(g, by)


def pairwise_auc(df: DataFrame, pred: str, label: str, mask: str | None = None,
                 n_buckets: int | None = None) -> DataFrame:
    """Over ordered pairs with label_i > label_j, (#pred_i > pred_j + half
    the ties) / #pairs; 1.0 without pairs. Labels may be graded, with any
    number of levels. Rows without a score or label take no part.

    Exact and pair-free. Equal (score, label) rows are first counted. With two
    levels, running counts over score order (``running_totals``) suffice.
    With more, ``_graded_counts`` is used; both give the same value."""
    src = df if mask is None else df.filter(_dbl(mask) > 0)
    src = src.select(_dbl(pred).alias("_p"), _dbl(label).alias("_l"))
    valid = src.filter(F.col("_p").isNotNull() & F.col("_l").isNotNull())
    n = n_buckets or default_buckets(valid)
    # cut points from a sketch over the raw scores (no shuffle), so the grouped
    # table below is shuffled only once; the extremes of the labels tell two levels from more
    lo, hi = F.min("_l"), F.max("_l")
    cuts, (lo, hi) = cuts_and_totals(valid, "_p", n, [lo, hi])
    if lo is None or lo == hi:
        return df.sparkSession.range(1).select(F.lit(1.0).alias("auc"))
    if not valid.filter((F.col("_l") != lo) & (F.col("_l") != hi)).isEmpty():
        tot = _graded_counts(valid.groupBy("_p", "_l").agg(F.count(F.lit(1)).cast("double").alias("_n")), cuts, n)
    else:
        g = valid.groupBy("_p").agg(F.count_if(F.col("_l") == lo).cast("double").alias("c0"),
                                    F.count_if(F.col("_l") == hi).cast("double").alias("c1"))
        r = running_totals(g, "_p", ["c0"], cuts=cuts)
        tot = r.agg(F.sum(F.col("c1") * (F.col("cum_c0") - F.col("c0") / 2.0)).alias("conc"),
                    (F.sum("c0") * F.sum("c1")).alias("pairs"))
    return tot.select(F.when(F.col("pairs") > 0.5, F.col("conc") / F.col("pairs")).otherwise(F.lit(1.0)).alias("auc"))


def concordance(p, l, w, group=None):
    """Sum of w_i w_j over l_i > l_j, whole where p_i > p_j and half where they
    are equal. One cumulative sum per bit of the labels' ranks: two rows with
    different labels first differ in exactly one bit. With ``group`` (0, 1, ...)
    only pairs within a group count, and the result is an array of a sum each."""
    import numpy as np
    gid = np.zeros(len(p), np.int64) if group is None else np.asarray(group, np.int64)
    total = np.zeros(int(gid.max()) + 1 if len(p) else 1)
    if len(p):
        rank = np.unique(l, return_inverse=True)[1]
        order = np.argsort(p, kind="stable")
        p, rank, w, gid = p[order], rank[order], w[order], gid[order]
        for bit in range(int(rank.max()).bit_length()):
            high = (rank >> bit) & 1
            part = gid * (int(rank.max()) + 2) + (rank >> (bit + 1))
            o = np.argsort(part, kind="stable")          # rows stay in score order within a part
            g, q, h, v = part[o], p[o], high[o], w[o]
            below = np.concatenate([[0.0], np.cumsum(np.where(h == 0, v, 0.0))])
            new_part = np.concatenate([[True], g[1:] != g[:-1]])
            new_score = new_part | np.concatenate([[True], q[1:] != q[:-1]])
            first = np.nonzero(new_score)[0]
            run = np.cumsum(new_score) - 1
            start = np.nonzero(new_part)[0][np.cumsum(new_part) - 1]
            lower = below[first][run] - below[start]
            tie = below[np.append(first[1:], len(g))][run] - below[first][run]
            total += np.bincount(gid[o], weights=np.where(h == 1, v, 0.0) * (lower + tie / 2), minlength=len(total))
    return float(total[0]) if group is None else total


def _graded_counts(g: DataFrame, cuts: Sequence[float], n: int, by: Sequence[str] = ()) -> DataFrame:
    """(*by, conc, pairs) of rows (*by, _p, _l, _n) for any number of label levels, per ``by``.

    Scores and labels are cut into ranges. A pair in different score ranges and
    different label ranges is counted on the bounded table of range pairs; a
    pair within one score range in that range, by ``concordance``; a pair
    within one label range but not one score range in the label range, on the
    sums per (score range, label). A range with a single score has ties alone,
    half of (S^2 - the sum of squares per label) / 2, and a range with a single
    label has no such pair, so neither goes to a task whole, however many rows
    share a score or a label. Equal rows count once."""
    by = list(by)
    l_cuts, _ = cuts_and_totals(g, "_l", n)
    rows = range_bucket(range_bucket(g, "_p", cuts, "_pb"), "_l", l_cuts, "_lb")
    one = concordance
    schema = ", ".join([*(f"{c.name} {c.dataType.simpleString()}" for c in g.schema if c.name in by), "conc double"])

    def keyed(key, conc):
        import pandas as pd
        return pd.DataFrame([[*key[:len(by)], conc]], columns=[*by, "conc"])

    def within_scores(key, pdf):
        return keyed(key, one(pdf["_p"].to_numpy(), pdf["_l"].to_numpy(), pdf["_n"].to_numpy()))

    def within_labels(key, pdf):
        p, l, w = pdf["_pb"].to_numpy(), pdf["_l"].to_numpy(), pdf["_n"].to_numpy()
        same = sum(one(x["_pb"].to_numpy(), x["_l"].to_numpy(), x["_n"].to_numpy()) for _, x in pdf.groupby("_pb"))
        return keyed(key, one(p, l, w) - same)    # pairs of one score range are not counted here

    ends = rows.groupBy(*by, "_pb").agg(F.min("_p").alias("_first"), F.max("_p").alias("_last"))
    ends = ends.filter("_first < _last").select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_pb").alias("_of"))
    alike = lambda own: [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by] + [F.col(own) == F.col("_of")]
    every = lambda own: functools.reduce(operator.and_, alike(own))
    many = rows.join(ends, every("_pb"), "left_semi").groupBy(*by, "_pb").applyInPandas(within_scores, schema)
    ties = rows.join(ends, every("_pb"), "left_anti").groupBy(*by, "_pb", "_l").agg(F.sum("_n").alias("_n")).groupBy(*by, "_pb").agg(
        ((F.pow(F.sum("_n"), 2) - F.sum(F.col("_n") * F.col("_n"))) / 4).alias("conc")).select(*by, "conc")
    sums = rows.groupBy(*by, "_pb", "_lb", "_l").agg(F.sum("_n").alias("_n"))
    several = sums.groupBy(*by, "_lb").agg(F.min("_l").alias("_lo"), F.max("_l").alias("_hi")).filter("_lo < _hi").select(
        *[F.col(c).alias(f"_of_{c}") for c in by], F.col("_lb").alias("_of"))
    labels = sums.join(several, every("_lb"), "left_semi").groupBy(*by, "_lb").applyInPandas(within_labels, schema)
    cells = sums.groupBy(*by, "_pb", "_lb").agg(F.sum("_n").alias("_n"))     # at most ranges x ranges
    every_label = F.explode(F.array(*[F.lit(i) for i in range(len(l_cuts) + 1)]))
    none = cells.select(*by, "_pb").distinct().select(*by, "_pb", every_label.alias("_lb"), F.lit(0.0).alias("_n"))
    full = cells.unionByName(none).groupBy(*by, "_pb", "_lb").agg(F.sum("_n").alias("_n"))
    by_label = Window.partitionBy(*by, "_lb").orderBy("_pb").rowsBetween(Window.unboundedPreceding, -1)
    left = full.withColumn("_left", F.coalesce(F.sum("_n").over(by_label), F.lit(0.0)))
    under = Window.partitionBy(*by, "_pb").orderBy("_lb").rowsBetween(Window.unboundedPreceding, -1)
    outer = left.withColumn("_below", F.coalesce(F.sum("_left").over(under), F.lit(0.0))).select(*by, (F.col("_n") * F.col("_below")).alias("conc"))
    per_level = g.groupBy(*by, "_l").agg(F.sum("_n").alias("_n"))
    pairs = per_level.groupBy(*by).agg(((F.pow(F.sum("_n"), 2) - F.sum(F.col("_n") * F.col("_n"))) / 2).alias("pairs"))
    nothing = lambda c: F.lit(0.0).alias(c)
    both = functools.reduce(DataFrame.unionByName, (x.select(*by, "conc", nothing("pairs")) for x in (many, ties, labels, outer))).unionByName(
        pairs.select(*by, nothing("conc"), "pairs"))
    return both.groupBy(*by).agg(F.sum("conc").alias("conc"), F.sum("pairs").alias("pairs"))


def _graded_in_batches(g: DataFrame, sizes: DataFrame, rows: int, batch_rows: int) -> DataFrame:
    """(_batch, conc, pairs) of rows (_batch, _p, _l, _n) of large batches, counted as in ``_graded_counts``, but each
    batch has cuts of its own, as many as its rows ask for (``sizes``: _batch, _rows; ``rows`` in all), and a task works off many ranges at once."""
    most = default_buckets(g)
    tasks = max(1, -(-rows // TASK_ROWS))
    kind = g.schema["_batch"].dataType.simpleString()
    grid = [i / most for i in range(1, most)] or [0.5]
    every = F.ceil(F.lit(float(most)) / F.least(F.lit(float(most)), F.ceil(F.col("_rows") / F.lit(float(batch_rows)))))
    ends = lambda x: F.percentile_approx(x, grid, max(10_000, 10 * most))
    some = lambda q: F.array_sort(F.array_distinct(F.filter(q, lambda _, i: (i + 1) % F.col("_every") == 0)))
    cuts = g.groupBy("_batch").agg(ends("_p").alias("_pq"), ends("_l").alias("_lq")).withColumnRenamed("_batch", "_of")
    cuts = cuts.join(sizes.select("_batch", every.cast("int").alias("_every")), F.col("_of").eqNullSafe(F.col("_batch"))).select(
        "_of", some(F.col("_pq")).alias("_pc"), some(F.col("_lq")).alias("_lc"))
    # a cut is a range of its own, so a score that many rows share is alone in its range
    below = lambda cs, x: F.size(F.filter(cs, lambda c: c <= F.col(x))) + F.size(F.filter(cs, lambda c: c < F.col(x)))
    rows = g.join(cuts, F.col("_batch").eqNullSafe(F.col("_of"))).select(
        "_batch", "_p", "_l", "_n", below("_pc", "_p").alias("_pb"), below("_lc", "_l").alias("_lb"), (F.size("_lc") * 2).alias("_last_lb"))

    def groups(*cols):
        import numpy as np
        return functools.reduce(lambda a, b: np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1], cols)

    def summed(names, where, gid, conc):
        import numpy as np
        import pandas as pd
        owner = np.zeros(len(conc), np.int64)
        owner[gid] = where
        return pd.DataFrame({"_batch": names, "conc": np.bincount(owner, weights=conc, minlength=len(names))})

    def within_scores(pdf):
        import pandas as pd
        where, names = pd.factorize(pdf["_batch"], use_na_sentinel=False)
        gid = groups(where, pdf["_pb"].to_numpy())
        return summed(names, where, gid, concordance(pdf["_p"].to_numpy(), pdf["_l"].to_numpy(), pdf["_n"].to_numpy(), gid))

    def within_labels(pdf):
        import pandas as pd
        where, names = pd.factorize(pdf["_batch"], use_na_sentinel=False)
        p, l, w = pdf["_pb"].to_numpy(), pdf["_l"].to_numpy(), pdf["_n"].to_numpy()
        gid = groups(where, pdf["_lb"].to_numpy())
        cell = groups(gid, p)
        all_pairs = summed(names, where, gid, concordance(p, l, w, gid))
        all_pairs["conc"] -= summed(names, where, cell, concordance(p, l, w, cell))["conc"]    # pairs of one score range are not counted here
        return all_pairs

    def in_tasks(part, key, run):
        deal = F.pmod(F.xxhash64("_batch", key), F.lit(tasks)).alias("_task")
        return part.groupBy(deal).applyInPandas(lambda pdf: run(pdf), f"_batch {kind}, conc double")

    ranged = rows.groupBy("_batch", "_pb").agg(F.min("_p").alias("_first"), F.max("_p").alias("_end")).select(
        F.col("_batch").alias("_of"), F.col("_pb").alias("_opb"), (F.col("_first") < F.col("_end")).alias("_many"))
    rows = rows.join(ranged, F.col("_batch").eqNullSafe(F.col("_of")) & (F.col("_pb") == F.col("_opb"))).drop("_of", "_opb")
    many = in_tasks(rows.filter("_many").select("_batch", "_pb", "_p", "_l", "_n"), "_pb", within_scores)
    ties = rows.filter("not _many").groupBy("_batch", "_pb", "_l").agg(F.sum("_n").alias("_n")).groupBy("_batch", "_pb").agg(
        ((F.pow(F.sum("_n"), 2) - F.sum(F.col("_n") * F.col("_n"))) / 4).alias("conc")).select("_batch", "conc")
    sums = rows.groupBy("_batch", "_pb", "_lb", "_l").agg(F.sum("_n").alias("_n"))
    several = sums.groupBy("_batch", "_lb").agg(F.min("_l").alias("_lo"), F.max("_l").alias("_hi")).filter("_lo < _hi").select(
        F.col("_batch").alias("_of"), F.col("_lb").alias("_olb"))
    labels = in_tasks(sums.join(several, F.col("_batch").eqNullSafe(F.col("_of")) & (F.col("_lb") == F.col("_olb")), "left_semi").select(
        "_batch", "_pb", "_lb", "_l", "_n"), "_lb", within_labels)
    cells = rows.groupBy("_batch", "_pb", "_lb").agg(F.sum("_n").alias("_n"))
    none = rows.select("_batch", "_pb", "_last_lb").distinct().select(
        "_batch", "_pb", F.explode(F.sequence(F.lit(0), F.col("_last_lb"))).alias("_lb"), F.lit(0.0).alias("_n"))
    full = cells.unionByName(none).groupBy("_batch", "_pb", "_lb").agg(F.sum("_n").alias("_n"))
    by_label = Window.partitionBy("_batch", "_lb").orderBy("_pb").rowsBetween(Window.unboundedPreceding, -1)
    left = full.withColumn("_left", F.coalesce(F.sum("_n").over(by_label), F.lit(0.0)))
    under = Window.partitionBy("_batch", "_pb").orderBy("_lb").rowsBetween(Window.unboundedPreceding, -1)
    outer = left.withColumn("_below", F.coalesce(F.sum("_left").over(under), F.lit(0.0))).select("_batch", (F.col("_n") * F.col("_below")).alias("conc"))
    per_level = g.groupBy("_batch", "_l").agg(F.sum("_n").alias("_n"))
    pairs = per_level.groupBy("_batch").agg(((F.pow(F.sum("_n"), 2) - F.sum(F.col("_n") * F.col("_n"))) / 2).alias("pairs"))
    both = functools.reduce(DataFrame.unionByName, (x.select("_batch", "conc", F.lit(0.0).alias("pairs")) for x in (many, ties, labels, outer))).unionByName(
        pairs.select("_batch", F.lit(0.0).alias("conc"), "pairs"))
    return both.groupBy("_batch").agg(F.sum("conc").alias("conc"), F.sum("pairs").alias("pairs"))


#: Rows of batches that a task works off together, and rows of one batch beyond which its scores are cut into ranges.
TASK_ROWS, BATCH_ROWS = 500_000, 200_000


def pairwise_auc_in_batches(df: DataFrame, pred: str, label: str, batch: str, mask: str | None = None,
                            batch_rows: int = BATCH_ROWS) -> DataFrame:
    """A7 per batch, as the reference computes it: within each batch, over
    ordered pairs with label_i > label_j (graded labels of any number of levels),
    the share with pred_i > pred_j plus half the ties; 1.0 for a batch without
    pairs; rows with mask <= 0, without a score or without a label take no part.

    Batches are dealt to tasks by hash, as many tasks as the counted rows ask
    for, and a task works off all its batches at once. A batch with more than ``batch_rows``
    different rows is counted in ranges of scores and labels instead."""
    src = df if mask is None else df.filter(_dbl(mask) > 0)
    src = src.select(F.col(batch).alias("_batch"), _dbl(pred).alias("_p"), _dbl(label).alias("_l"))
    src = src.filter(F.col("_p").isNotNull() & F.col("_l").isNotNull())
    g = src.groupBy("_batch", "_p", "_l").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    batches = df.select(F.col(batch).alias("_batch")).distinct()
    sizes = g.groupBy("_batch").agg(F.count(F.lit(1)).alias("_rows"))
    total, most = sizes.agg(F.sum("_rows"), F.max("_rows")).first()
    tasks = max(1, -(-(total or 0) // TASK_ROWS))
    kind = g.schema["_batch"].dataType.simpleString()

    def counted(pdf):
        import numpy as np
        import pandas as pd
        where, names = pd.factorize(pdf["_batch"], use_na_sentinel=False)
        l, w = pdf["_l"].to_numpy(), pdf["_n"].to_numpy()
        conc = concordance(pdf["_p"].to_numpy(), l, w, where)
        n = np.bincount(where, weights=w)
        level = where * (np.unique(l).size + 1) + np.unique(l, return_inverse=True)[1]
        per_level = np.bincount(np.unique(level, return_inverse=True)[1], weights=w)
        owner = np.unique(level) // (np.unique(l).size + 1)
        squares = np.bincount(owner, weights=per_level**2, minlength=len(n))
        return pd.DataFrame({"_batch": names, "conc": conc, "pairs": (n * n - squares) / 2})

    def in_tasks(rows):
        deal = F.pmod(F.xxhash64("_batch"), F.lit(tasks)).alias("_task")
        return rows.groupBy(deal).applyInPandas(lambda pdf: counted(pdf), f"_batch {kind}, conc double, pairs double")

    if (most or 0) <= batch_rows:
        res = in_tasks(g)
    else:
        big = sizes.filter(F.col("_rows") > batch_rows).select(F.col("_batch").alias("_of"))
        own = F.col("_batch").eqNullSafe(F.col("_of"))
        large = g.join(big, own, "left_semi")
        counted_large = _graded_in_batches(large, sizes, total, batch_rows)
        res = in_tasks(g.join(big, own, "left_anti")).unionByName(counted_large)
    res = res.select(F.col("_batch").alias("_of"), F.when(F.col("pairs") > 0.5, F.col("conc") / F.col("pairs")).alias("auc"))
    return batches.join(res, F.col("_batch").eqNullSafe(F.col("_of")), "left").select(
        F.col("_batch").alias(batch), F.coalesce("auc", F.lit(1.0)).alias("auc"))


# --- A16 --------------------------------------------------------------------
def scored_tasks(df: DataFrame, tasks: Mapping[str, tuple[str, str]],
                 cap: tuple[float, float] = L.LABEL_CAP) -> DataFrame:
    """Per-task label shaping for evaluation, stacked to long form.

    ``tasks`` maps task -> (label column, score column). Output columns: task,
    score, task_label (clipped), binary_label, reg_label, reg_pred. The score
    goes through relu before the log tail, in training and evaluation alike,
    and every task uses its own label and rule."""
    parts = []
    for task, (lab, score) in tasks.items():
        task_label = L.clip(lab, *cap)
        parts.append(F.struct(
            F.lit(task).alias("task"), _dbl(score).alias("score"), task_label.alias("task_label"),
            L.binarize(task, task_label).alias("binary_label"),
            L.log_tail(lab).alias("reg_label"),
            L.log_tail(F.greatest(_dbl(score), F.lit(0.0))).alias("reg_pred")))
    return df.select(F.explode(F.array(*parts)).alias("t")).select("t.*")


def evaluation_report(df: DataFrame, tasks: Mapping[str, tuple[str, str]], n: int = ROC_POINTS,
                      grid: Sequence[float] = GRID4) -> DataFrame:
    """The reference's evaluation metric set, per task, as rows of
    (task, metric, value): accuracy at 0.1..0.9, TP/FP/TN/FN at 0.5, mse on
    log-tail values, 200-point ROC AUC, 4-point-grid AUC, recall at 0.5,
    means of reg_pred, binary_pred, reg_label, binary_label, and the clipped
    label and raw score means (46 values for two tasks). A row without a score
    or label takes no part in any metric of its task.

    One scan and one aggregation of rows: each row is stacked per task, every
    metric is a sum, and the partial aggregation before the shuffle leaves one
    row per (task, ROC bin, grid bin). Both areas come from these cells, whose
    number the grids bound."""
    cols = sorted({c for lab_score in tasks.values() for c in lab_score})
    st = scored_tasks(spread(df.select(*cols)), tasks).filter(F.col("score").isNotNull() & F.col("task_label").isNotNull())
    p, y = F.col("score"), F.col("binary_label")
    pos_pred = p >= F.lit(DECISION_THRESHOLD)
    ypos = y > 0.5
    sums = {
        "n": F.lit(1.0),
        "tp": F.when(pos_pred & ypos, 1.0).otherwise(0.0),
        "fp": F.when(pos_pred & ~ypos, 1.0).otherwise(0.0),
        "tn": F.when(~pos_pred & ~ypos, 1.0).otherwise(0.0),
        "fn": F.when(~pos_pred & ypos, 1.0).otherwise(0.0),
        "sq": (F.col("reg_label") - F.col("reg_pred")) * (F.col("reg_label") - F.col("reg_pred")),
        "reg_pred": F.col("reg_pred"), "binary_pred": p, "reg_label": F.col("reg_label"),
        "binary_label": y, "task_label": F.col("task_label"),
        "pos": F.when(ypos, 1.0).otherwise(0.0), "neg": F.when(ypos, 0.0).otherwise(1.0),
    }
    for t in SWEEP_THRESHOLDS:
        sums[f"acc_{t.replace('.', '_')}"] = F.when(F.when(p >= F.lit(float(t)), 1.0).otherwise(0.0) == y, 1.0).otherwise(0.0)
    stacked = st.select("task", roc_bin(p, n).alias("roc"), grid_bin(p, grid).alias("grid4"), *[c.alias(k) for k, c in sums.items()])
    per_bin = stacked.groupBy("task", "roc", "grid4").agg(*[F.sum(k).alias(k) for k in sums])
    tot = per_bin.groupBy("task").agg(*[F.sum(k).alias(k) for k in sums], F.collect_list(F.struct("roc", "grid4", "pos", "neg")).alias("cells"))

    def area(bin_col: str) -> Column:
        """Trapezoid ROC area over the cells in order of a bin: negatives of lower bins, and half of those of the own one."""
        cells = F.array_sort(F.transform("cells", lambda c: F.struct(c[bin_col].alias("b"), c["pos"].alias("pos"), c["neg"].alias("neg"))))
        zero = F.struct(F.lit(-1).alias("b"), *[F.lit(0.0).alias(c) for c in ("below", "own", "pos", "conc")])

        def step(s, c):
            same = s["b"] == c["b"]
            below = F.when(same, s["below"]).otherwise(s["below"] + s["own"])
            own, pos = F.when(same, s["own"]).otherwise(0.0), F.when(same, s["pos"]).otherwise(0.0)
            # the cell's pairs with the negatives below its bin, and ties with those of its bin seen so far, on either side
            more = c["pos"] * (below + own / 2 + c["neg"] / 2) + pos * c["neg"] / 2
            return F.struct(c["b"].alias("b"), below.alias("below"), (own + c["neg"]).alias("own"), (pos + c["pos"]).alias("pos"), (s["conc"] + more).alias("conc"))

        return F.aggregate(cells, zero, step, lambda s: s["conc"]) / F.nullif(F.col("pos") * F.col("neg"), F.lit(0.0))

    wide = tot.select(
        "task",
        *[(F.col(f"acc_{t.replace('.', '_')}") / F.col("n")).alias(f"acc_threshold_{t}") for t in SWEEP_THRESHOLDS],
        F.col("tp").alias("TP"), F.col("fp").alias("FP"), F.col("tn").alias("TN"), F.col("fn").alias("FN"),
        (F.col("sq") / F.col("n")).alias("mse"),
        area("roc").alias("auc"), area("grid4").alias("auc_grid4"),
        (F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0.0))).alias("recall"),
        (F.col("reg_pred") / F.col("n")).alias("reg_pred_mean"),
        (F.col("binary_pred") / F.col("n")).alias("binary_pred_mean"),
        (F.col("reg_label") / F.col("n")).alias("reg_label_mean"),
        (F.col("binary_label") / F.col("n")).alias("binary_label_mean"),
        (F.col("task_label") / F.col("n")).alias("label_mean"),
        (F.col("binary_pred") / F.col("n")).alias("score_mean"))
    metrics = [c for c in wide.columns if c != "task"]
    return wide.unpivot("task", [F.col(f"`{c}`") for c in metrics], "metric", "value")


REPORT_METRICS = ([f"acc_threshold_{t}" for t in SWEEP_THRESHOLDS]
                  + ["TP", "FP", "TN", "FN", "mse", "auc", "auc_grid4", "recall", "reg_pred_mean",
                     "binary_pred_mean", "reg_label_mean", "binary_label_mean", "label_mean", "score_mean"])


# --- A18: distributions ------------------------------------------------------
def distributions(df: DataFrame, specs: Mapping[str, tuple[Column, float, float]], bins: int = 50) -> DataFrame:
    """A18 for labels, scores and sums of per-row vectors: (name, bin, n) of equal-width
    bins 0 .. bins - 1 over [lo, hi) per name of ``specs`` (column, lo, hi); bin -1 holds what lies
    below, ``bins`` what lies at or above hi (NaN too), NULL the rows without a value, so the
    counts of a name add up to the rows. One scan; tables of counts from several days add up by ``sum``."""
    parts = []
    for name, (x, lo, hi) in specs.items():
        if not hi > lo:
            raise ValueError(f"{name}: empty range")
        v = _dbl(x)
        inside = F.floor((v - F.lit(float(lo))) / F.lit((float(hi) - float(lo)) / bins)).cast("int")
        at = F.when(v < lo, -1).when((v >= hi) | F.isnan(v), bins).when(v.isNotNull(), F.least(inside, F.lit(bins - 1)))
        parts.append(F.struct(F.lit(name).alias("name"), at.cast("int").alias("bin")))
    return df.select(F.explode(F.array(*parts)).alias("d")).select("d.*").groupBy("name", "bin").agg(F.count(F.lit(1)).alias("n"))


def vector_sum(a: ColumnOrName) -> Column:
    """The sum of a row's array; NULL slots add nothing, a NULL array has no sum."""
    return F.aggregate(_c(a), F.lit(0.0), lambda s, v: s + F.coalesce(v.cast("double"), F.lit(0.0)))


# --- A2, A3 -----------------------------------------------------------------
def _listed_stats(rows: DataFrame, keys: Sequence[str], listed: DataFrame, is_listed: Column, means: Sequence[str]) -> DataFrame:
    """Means and row share per listed group in one aggregation. Rows of other
    groups are merged before it, so it makes one row per listed group and
    feature, plus one: their share's total is a window over these few rows."""
    *outer, last = keys
    kept = rows.withColumn(last, F.when(is_listed, F.col(last)))
    agg = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in means])
    share = agg.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*outer)))
    return listed.join(share, list(keys), "left").withColumn("share", F.coalesce("share", F.lit(0.0)))


def stats_by_buckets(df: DataFrame, specs: Mapping[str, tuple[Sequence[float], Sequence[int], bool]],
                     pred: str, reg_loss: str, ideal_loss: str, reward: str, bias: str) -> DataFrame:
    """A2 over many features in one pass: ``specs`` maps a feature to (bounds,
    listed buckets, compress first). Per feature and listed bucket: mean
    prediction, mean regression loss, mean ideal loss, row share, mean reward,
    mean bias output. Listed buckets without rows keep NULL means and a 0 share."""
    spark = df.sparkSession
    parts = [F.struct(F.lit(f).alias("feature"), bucketize(compress(f) if log else _dbl(f), bounds).alias("bucket"),
                      bucketize(compress(f) if log else _dbl(f), bounds).isin(*[int(i) for i in ids]).alias("listed"))
             for f, (bounds, ids, log) in specs.items()]
    values = [F.col(c).alias(n) for c, n in ((pred, "pred"), (reg_loss, "reg_loss"), (ideal_loss, "ideal_loss"),
                                             (reward, "reward"), (bias, "bias"))]
    rows = df.select(F.explode(F.array(*parts)).alias("_f"), *values).select("_f.*", *[v for v in (
        "pred", "reg_loss", "ideal_loss", "reward", "bias")])
    listed = spark.createDataFrame([(f, int(i)) for f, (_, ids, _log) in specs.items() for i in ids], "feature string, bucket int")
    out = _listed_stats(rows, ["feature", "bucket"], listed, F.col("listed"), ["pred", "reg_loss", "ideal_loss", "reward", "bias"])
    return out.select("feature", "bucket", "pred_mean", "reg_loss_mean", "ideal_loss_mean", "share", "reward_mean", "bias_mean")


def stats_by_bucket(df: DataFrame, feature: str, bounds: Sequence[float], bucket_ids: Sequence[int],
                    pred: str, reg_loss: str, ideal_loss: str, reward: str, bias: str,
                    need_log1p: bool = True) -> DataFrame:
    """A2 of one feature (see ``stats_by_buckets``)."""
    return stats_by_buckets(df, {feature: (bounds, bucket_ids, need_log1p)}, pred, reg_loss, ideal_loss, reward, bias)


def stats_by_segment(df: DataFrame, segment: str, segments: Sequence[int], pred: str, reg_loss: str,
                     ideal_loss: str, reward: str) -> DataFrame:
    """A3: A2 per listed category of ``segment`` (no bias output)."""
    rows = df.select(F.col(segment).cast("bigint").alias("segment"), F.col(pred).alias("pred"), F.col(reg_loss).alias("reg_loss"),
                     F.col(ideal_loss).alias("ideal_loss"), F.col(reward).alias("reward"))
    listed = df.sparkSession.createDataFrame([(int(v),) for v in segments], "segment bigint")
    out = _listed_stats(rows, ["segment"], listed, F.col("segment").isin(*[int(v) for v in segments]),
                        ["pred", "reg_loss", "ideal_loss", "reward"])
    return out.select("segment", "pred_mean", "reg_loss_mean", "ideal_loss_mean", "share", "reward_mean")


# --- E7 ---------------------------------------------------------------------
def total_loss(df: DataFrame, per_task: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """Mean of each enabled loss per task, their sum per task, and the
    sum over tasks -- one row, one scan. ``per_task`` maps task -> {loss name:
    per-row loss column}."""
    cols, task_tot = [], []
    for task, losses in per_task.items():
        for name, c in losses.items():
            cols.append(F.avg(c).alias(f"{task}_{name}"))
        task_tot.append((task, list(losses)))
    agg = df.agg(*cols)
    out = [F.col(c) for c in agg.columns]
    total = F.lit(0.0)
    for task, names in task_tot:
        t = F.lit(0.0)
        for n in names:
            t = t + F.col(f"{task}_{n}")
        out.append(t.alias(f"{task}_loss"))
        total = total + t
    return agg.select(*out, total.alias("total_loss"))
