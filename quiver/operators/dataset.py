"""Dataset shaping (S4-S9): filter, shuffle, repeat, batch ids, date holdout,
path prefixes. All narrow or single-shuffle DataFrame operations."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_equal(df: DataFrame, field: str, value: int) -> DataFrame:
    """Keep rows with ``field == value`` when value >= 0, else all rows.
    A missing field is an error (the reference names a field no table has).
    The predicate reaches the Parquet scan as a pushed filter."""
    if value is None or value < 0:
        return df
    if field not in df.columns:
        raise ValueError(f"filter field not in frame: {field}")
    return df.filter(F.col(field) == F.lit(value))


def shuffle_rows(df: DataFrame, key_cols: list[str], seed: int = 0) -> DataFrame:
    """S5, deterministic: order by a seeded 64-bit hash of the row key (a
    full range exchange; spills, never collects). Same seed -> same order."""
    return df.orderBy(F.xxhash64(*[F.col(c) for c in key_cols], F.lit(seed)))


def shuffle_partitions(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """S5, approximate (like a shuffle buffer): random repartition, then a
    random order inside each partition. Cheaper than a total order."""
    return df.repartition(n).sortWithinPartitions(F.rand(seed))


def repeat(df: DataFrame, n: int | None) -> DataFrame:
    """N epochs of the frame with an ``epoch`` column; unchanged when n is
    None or <= 0. Each row is emitted n times in place (no join)."""
    if n is None or n <= 0:
        return df
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("epoch"))


def assign_batch(df: DataFrame, size: int, dense_key: str | None = None, hash_key: list[str] | None = None,
                 n_batches: int | None = None, order_key: str | None = None) -> DataFrame:
    """Batch ids. With a dense 0-based key: floor(key / size), i.e.
    consecutive groups of ``size`` with a short last one. With a unique
    (not necessarily dense) numeric ``order_key``: the same on its rank, which
    comes from distributed running counts over range buckets. Otherwise a hash
    of the key into ``n_batches``. Never a global row_number."""
    if dense_key is not None:
        return df.withColumn("batch_id", F.floor(F.col(dense_key) / F.lit(size)).cast("bigint"))
    if order_key is not None:
        from quiver.plans.prefix import running_totals
        ranked = running_totals(df, order_key, [], with_count="_rank")
        return ranked.withColumn("batch_id", F.floor((F.col("_rank") - 1) / F.lit(size)).cast("bigint")) \
                     .drop("_rank")
    if not hash_key or not n_batches:
        raise ValueError("need dense_key, or hash_key and n_batches")
    return df.withColumn("batch_id", F.pmod(F.xxhash64(*[F.col(c) for c in hash_key]), F.lit(n_batches)))


def date_holdout(df: DataFrame, date_col: str, unit: str = "day") -> DataFrame:
    """S8 on a table: the last date (or year, ``unit='year'``) is the eval
    split, earlier ones train. With a single date, train is the day before it
    (no rows of that day are present in the table, so all rows are eval). The
    max is a scalar subquery (partition-pruned when the table is partitioned
    by date)."""
    if unit == "day":
        d = F.to_date(F.col(date_col))
    elif unit == "year":
        d = F.year(F.col(date_col))
    else:
        raise ValueError(f"unknown unit: {unit}")
    last = df.select(F.max(d)).scalar()
    return df.withColumn("split", F.when(d == last, F.lit("eval")).otherwise(F.lit("train")))


def holdout_paths(paths: str) -> tuple[str, str]:
    """S8 on path lists: per ``|``-separated entry ``base/{d1,d2,..}/part-*``
    (or ``/*``), the last date becomes the eval glob and earlier dates (or the
    day before, with one date) the train glob.

    The file pattern is kept as given; the reference rewrites every pattern
    other than ``/*`` to ``part-*`` and strips it with a character-set
    ``rstrip`` that mis-parses patterns such as ``part-0000*``."""
    train, evals = [], []
    for p in paths.split("|"):
        parts = p.rstrip("/").split("/")
        tail = "/" + parts[-1]
        date_part = parts[-2]
        base = "/".join(parts[:-2]) + "/"
        dates = date_part.strip("{}").split(",")
        last = dates[-1]
        prev = dates[:-1] or [(datetime.strptime(last, "%Y%m%d") - timedelta(days=1)).strftime("%Y%m%d")]
        train.append(base + "{" + ",".join(prev) + "}" + tail)
        evals.append(base + "{" + last + "}" + tail)
    return "|".join(train), "|".join(evals)


def path_prefix_before(path: Column | str, flag: str) -> Column:
    """Text before the first occurrence of ``flag``; fails the query if a
    value lacks it."""
    p = F.col(path) if isinstance(path, str) else path
    pos = F.instr(p, flag)
    return F.when(F.assert_true(pos > 0, F.lit(f"flag not found: {flag}")).isNull(),
                  p.substr(F.lit(1), pos - 1))
