"""Exact quantiles by selection.

A column is never sorted, and its values never change hands. A sketch brackets every
wanted rank; one aggregation counts exactly what lies below and inside each
bracket; then the brackets' rows alone are stored and bracketed again, until a bracket holds
at most ``KEEP`` rows or one value, so the column itself is read three times whatever its length. Only those rows are counted by value
and ordered. A round leaves about two hundredths of a bracket's rows, so three rounds take
10^12 rows to some millions. What a sketch says is checked by the counts: a bracket that misses
its rank is not taken."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.session import cut_lineage, ensure_checkpoint_dir

KEEP = 16_384            # rows of a bracket that are ordered
GRID, ACCURACY = 200, 2000   # points of a sketch, and its rank error as 1 / ACCURACY
BROADCAST_GROUPS = 10_000    # some hundred bytes for each quantile of a group


def _cuts(x: str) -> Column:
    return F.percentile_approx(x, [k / GRID for k in range(1, GRID)], ACCURACY)


def _inside(x: Column, b: Column) -> Column:
    """Whether x lies in a bracket; an end that is NULL is open."""
    return F.coalesce(x >= b["lo"], F.lit(True)) & F.coalesce(x <= b["hi"], F.lit(True))


def _by_group(brackets: DataFrame, few: bool) -> DataFrame:
    """A row per group with its brackets in an array."""
    out = brackets.groupBy(F.col("_g").alias("_bg")).agg(F.sort_array(F.collect_list(F.struct("i", "lo", "hi"))).alias("_b"))
    return F.broadcast(out) if few else out


def _narrowed(x: DataFrame, brackets: DataFrame, cuts: DataFrame, n_probs: int, few: bool, held: DataFrame | None) -> DataFrame:
    """The brackets with new ends from the sketches (_g, i, cuts), where these hold the wanted ranks; exact counts in
    either case, of all rows or, after the first round, of those that the open brackets hold."""
    point = lambda rank: (rank - F.col("below")) / F.col("inside") * GRID
    lo_at = (F.floor(point(F.col("first"))) - 1).cast("int")
    hi_at = (F.ceil(point(F.col("last") + 1)) + 1).cast("int")
    cuts = cuts.select(F.col("_g").alias("_cg"), F.col("i").alias("_ci"), "cuts")
    tried = brackets.join(cuts, F.col("_g").eqNullSafe(F.col("_cg")) & (F.col("i") == F.col("_ci")), "left").select(
        *brackets.columns, F.when(lo_at >= 1, F.get("cuts", lo_at - 1)).alias("lo2"), F.when(hi_at < GRID, F.get("cuts", hi_at - 1)).alias("hi2"))
    tried = tried.withColumn("lo2", F.coalesce("lo2", "lo")).withColumn("hi2", F.coalesce("hi2", "hi"))
    ends = _by_group(tried.select("_g", "i", F.col("lo2").alias("lo"), F.col("hi2").alias("hi")), few)
    if held is None:
        rows = x.join(ends, F.col("_g").eqNullSafe(F.col("_bg")))
        v, agg = F.col("_x"), []
        for i in range(n_probs):
            b = F.col("_b")[i]
            agg += [F.count_if(v < b["lo"]).alias(f"u{i}"), F.count_if(_inside(v, b)).alias(f"n{i}")]
        counts = rows.groupBy("_g").agg(*agg).select(F.col("_g").alias("_ng"), F.posexplode(F.array(
            *[F.struct(F.col(f"u{i}").alias("u"), F.col(f"n{i}").alias("n")) for i in range(n_probs)])).alias("_i", "c"))
    else:   # of a bracket's own rows; what lies below the bracket is counted already
        rows = held.join(ends, F.col("_g").eqNullSafe(F.col("_bg"))).withColumn("_e", F.get("_b", F.col("i")))
        counts = rows.groupBy("_g", "i").agg(F.struct(F.count_if(F.col("_x") < F.col("_e.lo")).alias("u"), F.count_if(_inside(F.col("_x"), F.col("_e"))).alias("n")).alias("c"))
        counts = counts.select(F.col("_g").alias("_ng"), F.col("i").alias("_i"), F.col("c"))
    checked = tried.join(counts, F.col("_g").eqNullSafe(F.col("_ng")) & (F.col("i") == F.col("_i")), "inner" if held is None else "left")
    under = F.col("c.u") if held is None else F.col("below") + F.col("c.u")
    ok = F.coalesce((F.col("first") >= under) & (F.col("last") < under + F.col("c.n")), F.lit(False))
    take = lambda old, new: F.when(ok, new).otherwise(F.col(old)).alias(old)
    return cut_lineage(checked.select("_g", "i", "p", "frac", "first", "last", take("lo", F.col("lo2")), take("hi", F.col("hi2")), take("below", under), take("inside", F.col("c.n"))))


def exact_quantiles_by(df: DataFrame, group: str, col: str, probs: Sequence[float], keep: int = KEEP) -> DataFrame:
    """X4 per group (e.g. per feature of a long-form table): exact quantiles with linear interpolation at
    position p * (n - 1), as ``percentile`` gives them. NULL values take no part, NaN is the largest value, a NULL
    group is a group. Output: (group, prob, value), a row per group that has values."""
    x = df.select(F.col(group).alias("_g"), F.col(col).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    seen = x.groupBy("_g").agg(F.count(F.lit(1)).alias("inside"), _cuts("_x").alias("cuts"))
    pos = F.col("p") * (F.col("inside") - 1)
    start = cut_lineage(seen.select("_g", "inside", "cuts", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("i", "p")).withColumn(
        "first", F.floor(pos)).withColumn("last", F.ceil(pos)).withColumn("frac", pos - F.floor(pos)))
    cuts = start.select("_g", "i", "cuts")
    brackets = start.select("_g", "i", "p", "frac", "first", "last", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
                            F.lit(0).cast("long").alias("below"), "inside")
    single = F.coalesce(F.col("lo") == F.col("hi"), F.lit(False))
    open_rows = F.when(~single, F.col("inside"))
    size = lambda b: b.agg(F.max(open_rows), F.sum(open_rows), F.count_if(F.col("i") == 0)).first()
    now = size(brackets)
    few = now[2] <= BROADCAST_GROUPS
    held = None
    while (now[0] or 0) > keep:
        brackets = _narrowed(x, brackets, cuts, len(probs), few, held)
        before, now = now, size(brackets)
        held = _stored(_rows_inside(x, brackets.filter(~single), few) if held is None else _still_inside(held, brackets.filter(~single), few))
        if (now[0] or 0) <= keep or now == before:
            break
        wide = brackets.filter(~single & (F.col("inside") > keep)).select(F.col("_g").alias("_wg"), F.col("i").alias("_wi"))
        cuts = held.join(F.broadcast(wide) if few else wide, F.col("_g").eqNullSafe(F.col("_wg")) & (F.col("i") == F.col("_wi")), "left_semi")
        cuts = cut_lineage(cuts.groupBy("_g", "i").agg(_cuts("_x").alias("cuts")))
    found = (_rows_inside(x, brackets, few) if held is None else held).groupBy("_g", "i", "_x").agg(F.count(F.lit(1)).alias("n"))
    if held is not None:   # a bracket of one value needs no rows
        found = found.unionByName(brackets.filter(single).select("_g", "i", (F.col("lo") + F.lit(0.0)).alias("_x"), F.col("inside").alias("n")))
    w = Window.partitionBy("_g", "i").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = found.withColumn("upto", F.sum("n").over(w)).withColumnsRenamed({"_g": "_fg", "i": "_fi"}).join(
        brackets, F.col("_fg").eqNullSafe(F.col("_g")) & (F.col("_fi") == F.col("i")))
    end, begin = F.col("below") + F.col("upto"), F.col("below") + F.col("upto") - F.col("n")
    at = lambda rank: F.max(F.when((F.col(rank) >= begin) & (F.col(rank) < end), F.col("_x")))
    per = placed.groupBy("_g", "i", "p", "frac").agg(at("first").alias("a"), at("last").alias("b"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + F.col("frac") * (F.col("b") - F.col("a")))
    return per.select(F.col("_g").alias(group), F.col("p").alias("prob"), value.alias("value"))


def _rows_inside(x: DataFrame, brackets: DataFrame, few: bool) -> DataFrame:
    """(_g, i, _x): each row once for every bracket that holds it."""
    rows = x.join(_by_group(brackets, few), F.col("_g").eqNullSafe(F.col("_bg")))
    return rows.select("_g", "_x", F.explode(F.filter("_b", lambda b: _inside(F.col("_x"), b))).alias("b")).select("_g", "b.i", "_x")


def _still_inside(held: DataFrame, brackets: DataFrame, few: bool) -> DataFrame:
    """Of stored rows (_g, i, _x), those that their bracket holds now."""
    ends = brackets.select(F.col("_g").alias("_bg"), F.col("i").alias("_bi"), F.struct("lo", "hi").alias("_e"))
    rows = held.join(F.broadcast(ends) if few else ends, F.col("_g").eqNullSafe(F.col("_bg")) & (F.col("i") == F.col("_bi")))
    return rows.filter(_inside(F.col("_x"), F.col("_e"))).select("_g", "i", "_x")


def _stored(rows: DataFrame) -> DataFrame:
    path = f"{ensure_checkpoint_dir(rows.sparkSession)}/quantiles-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], keep: int = KEEP) -> DataFrame:
    """X4 of a whole column: (prob, value); no rows without values."""
    return exact_quantiles_by(df.select(F.lit(0).alias("_one"), F.col(col).alias("_v")), "_one", "_v", probs, keep).drop("_one")


def fit_bounds_by(df: DataFrame, group: str, col: str, probs: Sequence[float]) -> DataFrame:
    """X4 for many features at once: (group, bounds) with the sorted distinct
    exact quantiles of each group -- a spec table for ``bucketize_long``."""
    q = exact_quantiles_by(df, group, col, probs)
    return q.groupBy(group).agg(F.array_sort(F.collect_set("value")).alias("bounds"))


def fit_bounds(df: DataFrame, col: str, probs: Sequence[float]) -> DataFrame:
    """Bucket bounds as the sorted distinct exact quantiles (one row)."""
    q = exact_quantiles(df, col, probs)
    return q.agg(F.array_sort(F.collect_set("value")).alias("bounds"))
