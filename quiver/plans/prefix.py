"""Distributed running totals over a totally ordered numeric key.

A window ``ORDER BY key`` without ``PARTITION BY`` moves every row to one task.
Instead the key range is cut into ``n`` buckets at approximate quantiles
(``approxQuantile``: a bounded list of n-1 numbers on the driver), each bucket
runs its own window, and each row adds the totals of all earlier buckets,
taken from a table of at most n rows that is broadcast (its size is bounded
by n, not by the data).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiver.functions.transforms import bucketize


def range_cuts(df: DataFrame, key: str, n: int, rel_err: float = 1e-3) -> list[float]:
    """Sorted, distinct cut points splitting ``key`` into about n ranges."""
    n = min(n, MAX_BUCKETS)
    if n <= 1:
        return []
    qs = [i / n for i in range(1, n)]
    cuts = df.approxQuantile(key, qs, rel_err)
    return sorted({float(c) for c in cuts if c is not None})


MAX_BUCKETS = 8192      # bounds the cut list on the driver and the offsets table
COMPARE_LIMIT = 64      # up to this many cuts: compiled comparisons; above: binary search


def default_buckets(df: DataFrame) -> int:
    return max(1, min(MAX_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def range_bucket(df: DataFrame, key: str, cuts: Sequence[float], out: str = "_rb") -> DataFrame:
    """Add the range bucket of ``key``: the number of cuts <= key. Few cuts:
    a compiled sum of comparisons; many: Spark ML's ``Bucketizer`` (a binary
    search in the JVM). Both forms put a NULL key into the first bucket and NaN
    into the last, where an ascending sort has them, so results do not depend
    on the number of cuts."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    if len(cuts) <= COMPARE_LIMIT:
        return df.withColumn(out, F.coalesce(bucketize(F.col(key), cuts), F.lit(0)))
    from pyspark.ml.feature import Bucketizer
    tmp = f"{out}_x"
    b = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol=tmp, outputCol=f"{out}_d",
                   handleInvalid="keep")
    res = b.transform(df.withColumn(tmp, F.coalesce(F.col(key).cast("double"), F.lit(float("-inf")))))
    return res.withColumn(out, F.col(f"{out}_d").cast("int")).drop(tmp, f"{out}_d")


def cuts_and_totals(df: DataFrame, key: str, n: int, totals: Sequence = (), accuracy: int = 10000
                    ) -> tuple[list[float], list]:
    """One aggregation job: approximate n-quantile cut points of ``key``
    (``percentile_approx``, bounded memory) and any extra aggregates. A value that
    is several of the quantiles gets a range of its own: the next number is a cut too."""
    n = min(n, MAX_BUCKETS)
    qs = [i / n for i in range(1, n)] if n > 1 else [0.5]
    acc = max(accuracy, 10 * n)
    row = df.agg(F.percentile_approx(F.col(key).cast("double"), qs, acc).alias("_q"), *totals).first()
    seen = Counter(float(c) for c in (row[0] or []) if c is not None)
    hot = [math.nextafter(c, math.inf) for c, k in seen.items() if k > 1 and math.isfinite(c)]
    return sorted({*seen, *hot}) if n > 1 else [], list(row[1:])


def running_totals(df: DataFrame, key: str, sum_cols: Sequence[str], n_buckets: int | None = None,
                   prefix: str = "cum_", with_count: str | None = None,
                   cuts: Sequence[float] | None = None) -> DataFrame:
    """Add ``cum_<c>`` = sum of ``c`` over all rows whose key is <= this row's
    key (inclusive running sum). Keys must be unique (aggregate first).

    ``with_count`` additionally adds the running row count (a 1-based rank)."""
    n = n_buckets or default_buckets(df)
    if cuts is None:
        cuts = range_cuts(df, key, n)
    cols = list(sum_cols)
    base = range_bucket(df, key, cuts)
    if with_count:
        base = base.withColumn("_one", F.lit(1).cast("long"))
        cols = cols + ["_one"]
    w = Window.partitionBy("_rb").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = base.select(*base.columns, *[F.sum(c).over(w).alias(f"_loc_{c}") for c in cols])
    totals = base.groupBy("_rb").agg(*[F.sum(c).alias(f"_tot_{c}") for c in cols])
    # at most n + 1 rows: a single-task window here is bounded by n, not data
    wo = Window.orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_rb", *[F.coalesce(F.sum(f"_tot_{c}").over(wo), F.lit(0)).alias(f"_off_{c}")
                                     for c in cols])
    out = local.join(F.broadcast(offsets), "_rb")
    names = {c: f"{prefix}{c}" for c in sum_cols}
    if with_count:
        names["_one"] = with_count
    sel = [F.col(c) for c in df.columns] + [
        (F.col(f"_loc_{c}") + F.col(f"_off_{c}")).alias(names[c]) for c in cols]
    return out.select(*sel)


def running_totals_by(df: DataFrame, group: str, key: str, sum_cols: Sequence[str], n_buckets: int = 16,
                      prefix: str = "cum_", accuracy: int = 10000) -> DataFrame:
    """``running_totals`` restarted per ``group`` (e.g. per feature).

    Each group gets its own range cut points (``percentile_approx`` grouped
    by ``group``: one pass, bounded memory per group), so a large group is
    spread over up to ``n_buckets`` windows; the offsets of earlier buckets
    come from a table with one row per (group, bucket). ``key`` must be
    unique within a group (aggregate first). NULL groups are a group like any
    other; NULL keys come first."""
    n = max(1, min(n_buckets, MAX_BUCKETS))
    cols = list(sum_cols)
    if n > 1:
        qs = [i / n for i in range(1, n)]
        cuts = df.groupBy(group).agg(
            F.array_sort(F.array_distinct(F.percentile_approx(F.col(key).cast("double"), qs, accuracy)))
            .alias("_cuts"))
        cuts = cuts.withColumnRenamed(group, "_cg")
        below = F.size(F.filter("_cuts", lambda c: c <= F.col(key)))
        base = df.join(cuts, F.col(group).eqNullSafe(F.col("_cg"))).drop("_cg").withColumn(
            "_rb", F.when(F.col(key).isNull(), 0).otherwise(below)).drop("_cuts")
    else:
        base = df.withColumn("_rb", F.lit(0))
    w = Window.partitionBy(group, "_rb").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = base.select(*base.columns, *[F.sum(c).over(w).alias(f"_loc_{c}") for c in cols])
    totals = base.groupBy(group, "_rb").agg(*[F.sum(c).alias(f"_tot_{c}") for c in cols])
    wo = Window.partitionBy(group).orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, "_rb", *[F.coalesce(F.sum(f"_tot_{c}").over(wo), F.lit(0)).alias(f"_off_{c}")
                                            for c in cols])
    offsets = offsets.withColumnsRenamed({group: "_og", "_rb": "_orb"})
    out = local.join(offsets, F.col(group).eqNullSafe(F.col("_og")) & (F.col("_rb") == F.col("_orb")))
    return out.select(*[F.col(c) for c in df.columns],
                      *[(F.col(f"_loc_{c}") + F.col(f"_off_{c}")).alias(f"{prefix}{c}") for c in cols])
