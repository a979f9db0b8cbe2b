"""Wide-feature bucketizing and encoding (P3-P6, P8, P9, P16, P17, P20, P23,
A18).

Two layouts (survey §7.3): up to ~100 features, one ``select`` of bucket
expressions; wider tables go to long form ``(row, feature, value)`` with the
bounds joined from a broadcast spec table. The spec has one row per feature,
so its size is fixed by the feature list, not by the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from quiver.functions.transforms import array_reduce, bucketize, compress

BUCKET_PREFIX = "b_"


def skip_columns_containing(names: Sequence[str], token: str = "shadow") -> tuple[list[str], list[str]]:
    """(kept, skipped) names; skipped contain ``token``."""
    kept = [n for n in names if token not in n]
    return kept, [n for n in names if token in n]


def classify_feature(name: Column | str) -> Column:
    """Suffix rules, in order: ``_vmid_all`` (camp_x_vmid when it ends in
    ``_campaign_id_vmid_all``, else vmid), ``_campaign_id_all`` -> camp,
    ``_camp`` -> camp, ``_camp_vmid`` -> camp_x_vmid, else other."""
    n = F.col(name) if isinstance(name, str) else name
    return (F.when(n.endswith("_vmid_all"),
                   F.when(n.endswith("_campaign_id_vmid_all"), F.lit("camp_x_vmid")).otherwise(F.lit("vmid")))
            .when(n.endswith("_campaign_id_all"), F.lit("camp"))
            .when(n.endswith("_camp"), F.lit("camp"))
            .when(n.endswith("_camp_vmid"), F.lit("camp_x_vmid"))
            .otherwise(F.lit("other")))


def bucket_ids(df: DataFrame, specs: Mapping[str, Sequence[float]]) -> DataFrame:
    """One bucket id per listed feature, the value cast to float32 first."""
    return df.select("*", *[bucketize(F.col(f).cast("float"), b).alias(f"{BUCKET_PREFIX}{f}")
                            for f, b in sorted(specs.items())])


def bucket_float_features(df: DataFrame, names: Sequence[str], specs: Mapping[str, Sequence[float]],
                          skip_shadow: bool = False) -> tuple[DataFrame, list[str], list[str]]:
    """Bucketize float features without compression."""
    kept, skipped = skip_columns_containing(names) if skip_shadow else (list(names), [])
    out = df.select("*", *[bucketize(F.col(f).cast("float"), specs[f]).alias(f"{BUCKET_PREFIX}{f}")
                           for f in kept])
    return out, kept, skipped


def bucket_features_1d(df: DataFrame, specs: Mapping[str, Sequence[float]],
                       log_specs: Mapping[str, Sequence[float]] | None = None,
                       array_names: Sequence[str] = (), skip_shadow: bool = False,
                       need_log1p: bool = False) -> tuple[DataFrame, list[str], list[str]]:
    """P5: in name order, optionally skip names containing 'shadow'; reduce
    listed array features by max; compress (log1p) or cast; a feature in the
    log table is compressed and uses the log table's bounds. One select."""
    log_specs = log_specs or {}
    kept, skipped, exprs = [], [], []
    for f, bounds in sorted(specs.items()):
        if skip_shadow and "shadow" in f:
            skipped.append(f)
            continue
        x = array_reduce(f, "max") if (f in array_names or isinstance(df.schema[f].dataType, ArrayType)) \
            else F.col(f).cast("double")
        if f in log_specs:
            x, bounds = compress(x), log_specs[f]
        elif need_log1p:
            x = compress(x)
        else:
            x = x.cast("float")
        exprs.append(bucketize(x, bounds).alias(f"{BUCKET_PREFIX}{f}"))
        kept.append(f)
    return df.select("*", *exprs), kept, skipped


def bucket_features_2d(df: DataFrame, specs: Mapping[str, Sequence[float]],
                       log_specs: Mapping[str, Sequence[float]] | None = None,
                       reduce: str = "max", need_log1p: bool = False,
                       exempt: Sequence[str] = (), prefix: str = BUCKET_PREFIX) -> tuple[DataFrame, list[str]]:
    """Per 2-D feature in name order: cast (compress first when
    ``need_log1p`` and the feature is not a ratio/delta output listed in
    ``exempt``), reduce the 20 slots by max or mean, compress if in the log
    table (and use its bounds), bucketize. Run P10/P12 before to add the
    ratio and delta features and their bounds to ``specs``."""
    if reduce not in ("max", "mean"):
        raise ValueError(f"unknown reduce: {reduce}")
    log_specs = log_specs or {}
    exprs, kept = [], []
    for f, bounds in sorted(specs.items()):
        if f not in df.columns:
            continue
        is_arr = isinstance(df.schema[f].dataType, ArrayType)
        x = F.col(f)
        if need_log1p and f not in exempt:
            x = F.transform(x, lambda v: compress(v)) if is_arr else compress(x)
        x = array_reduce(x, reduce) if is_arr else x.cast("double")
        if f in log_specs:
            x, bounds = compress(x), log_specs[f]
        exprs.append(bucketize(x.cast("float"), bounds).alias(f"{prefix}{f}"))
        kept.append(f)
    return df.select("*", *exprs), kept


# --- long form ----------------------------------------------------------------
def spec_table(spark: SparkSession, specs: Mapping[str, Sequence[float]],
               log_names: Sequence[str] = ()) -> DataFrame:
    """Spec as data: (feature, bounds array<double>, use_log boolean)."""
    rows = [(f, [float(b) for b in bounds], f in log_names) for f, bounds in sorted(specs.items())]
    return spark.createDataFrame(rows, "feature string, bounds array<double>, use_log boolean")


def to_long(df: DataFrame, id_cols: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Wide -> (ids..., feature, value double) with one ``unpivot``."""
    sel = df.select(*id_cols, *[F.col(f).cast("double").alias(f) for f in features])
    return sel.unpivot(list(id_cols), list(features), "feature", "value")


def bucketize_long(long_df: DataFrame, spec: DataFrame) -> DataFrame:
    """P5 in long form: join the spec (broadcast; one row per feature), then
    one compress + bucketize expression for every feature."""
    j = long_df.join(F.broadcast(spec), "feature")
    x = F.when(F.col("use_log"), compress("value")).otherwise(F.col("value").cast("float").cast("double"))
    longest = spec.agg(F.max(F.size("bounds"))).first()[0] or 0     # spec rows: one per feature
    return j.select(*[c for c in long_df.columns], x.alias("x"),
                    bucketize(x, F.col("bounds"), max_len=longest).alias("bucket"))


def feature_summary(bucketed_long: DataFrame, sqrt_mean: bool = False) -> DataFrame:
    """Per feature the mean value (or its square root: NULL for a
    negative mean), the mean bucket id and the row count."""
    m = F.avg("x")
    val = F.when(m >= 0, F.sqrt(m)) if sqrt_mean else m
    return bucketed_long.groupBy("feature").agg(
        val.alias("value_mean"), F.avg(F.col("bucket").cast("double")).alias("bucket_mean"),
        F.count(F.lit(1)).alias("n"))


def bucket_histogram(bucketed_long: DataFrame) -> DataFrame:
    """Rows per (feature, bucket)."""
    return bucketed_long.groupBy("feature", "bucket").agg(F.count(F.lit(1)).alias("n"))


# --- P3, P4 -------------------------------------------------------------------
def bucket_target_mean(df: DataFrame, feature: str, bucket_col: str, label: str,
                       smoothing: float = 10.0) -> DataFrame:
    """P4 (re-aim of learned bucket vectors): per bucket, the label mean
    shrunk toward the overall mean: (sum + a * prior) / (n + a). One row per
    bucket; usable as P3 weights."""
    g = df.groupBy(bucket_col).agg(F.sum(F.col(label).cast("double")).alias("s"),
                                   F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()  # one row per bucket: bounded by the bounds list
    prior = F.sum("s").over(whole) / F.sum("n").over(whole)
    a = F.lit(float(smoothing))
    return g.select(F.lit(feature).alias("feature"), F.col(bucket_col).alias("bucket"), "n",
                    ((F.col("s") + a * prior) / (F.col("n") + a)).alias("weight"))


def bucket_encode(df: DataFrame, feature: str, bucket_col: str, weights: DataFrame,
                  out: str = "encoded") -> DataFrame:
    """Look up the per-bucket weight of ``feature`` in ``weights`` (feature,
    bucket, weight). Up to ``BROADCAST_ROWS`` buckets, counted first, it is
    broadcast; a larger table is joined by shuffle, where the planner splits hot
    buckets. Buckets without a weight get NULL."""
    w = weights.filter(F.col("feature") == feature).select(
        F.col("bucket").alias(bucket_col), F.col("weight").alias(out))
    small = w.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(w) if small else w, bucket_col, "left")


#: Rows up to which a lookup table is broadcast: at 16 values of 8 bytes each, some 16 MB.
BROADCAST_ROWS = 100_000


def bucket_target_vectors(df: DataFrame, feature: str, bucket_col: str, labels: Sequence[str],
                          smoothing: float = 10.0) -> DataFrame:
    """P4 with one value per label: (feature, bucket, vector), usable as the
    ``dim`` = len(labels) wide table of ``vector_encode``."""
    a = F.lit(float(smoothing))
    g = df.groupBy(bucket_col).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(y).cast("double")).alias(f"s{i}") for i, y in enumerate(labels)])
    whole = Window.partitionBy()  # one row per bucket: bounded by the bounds list
    values = [(F.col(f"s{i}") + a * F.sum(f"s{i}").over(whole) / F.sum("n").over(whole)) / (F.col("n") + a) for i in range(len(labels))]
    return g.select(F.lit(feature).alias("feature"), F.col(bucket_col).alias("bucket"), F.array(*values).alias("vector"))


def vector_encode(df: DataFrame, feature: str, slot_col: str, table: DataFrame, dim: int, out: str = "vector",
                  size: int | None = None) -> DataFrame:
    """Look up the ``dim`` wide vector of a bucket or hash slot in
    ``table`` (feature, bucket, vector). Slots without a vector, and NULL slots,
    get zeros. ``size`` is the number of slots the table can have; up to
    ``BROADCAST_ROWS`` it is broadcast, else (or unsized) the join is left to the planner."""
    t = table.filter(F.col("feature") == feature).select(F.col("bucket").alias(slot_col), F.col("vector").alias(out))
    t = F.broadcast(t) if size is not None and size <= BROADCAST_ROWS else t
    zeros = F.array_repeat(F.lit(0.0), dim)
    return df.join(t, slot_col, "left").withColumn(out, F.coalesce(out, zeros))


# --- P20, P23 -----------------------------------------------------------------
def hash_slot(x: Column | str, size: int, identity: bool = False, portable: bool = False) -> Column:
    """P20: categorical value -> slot in [0, size). ``identity`` keeps integer
    ids (x mod size); otherwise a 64-bit xxhash, or with ``portable`` the first
    32 bits of the MD5 of the value's text, which other engines can compute too. The reference's hash is not
    available, so slot ids differ from it; collision statistics do not."""
    c = F.col(x) if isinstance(x, str) else x
    if portable:
        first = F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 8), 16, 10)
        return F.pmod(first.cast("bigint"), F.lit(size)).cast("bigint")
    return (F.pmod(c.cast("bigint"), F.lit(size)) if identity else F.pmod(F.xxhash64(c), F.lit(size))).cast("bigint")


def assemble_df(df: DataFrame, cols: Sequence[str], out: str = "features", lengths: Mapping[str, int] | None = None) -> DataFrame:
    """One vector from scalars (a slot each) and arrays, in the order of
    ``cols``. An array listed in ``lengths`` must have that many slots in every
    row: another length, or no array, ends the job with the column's name, since
    all slots behind it would mean other features."""
    lengths = lengths or {}
    if unknown := set(lengths) - {c for c in cols if isinstance(df.schema[c].dataType, ArrayType)}:
        raise ValueError(f"lengths of columns that are no assembled arrays: {sorted(unknown)}")
    parts = []
    for c in cols:
        if isinstance(df.schema[c].dataType, ArrayType):
            x = F.transform(F.col(c), lambda v: v.cast("double"))
            if c in lengths:
                found = F.coalesce(F.size(c).cast("string"), F.lit("no"))
                x = F.when(F.size(c) == lengths[c], x).otherwise(F.raise_error(F.concat(F.lit(f"{c}: {lengths[c]} slots expected, found "), found)))
            parts.append(x)
        else:
            parts.append(F.array(F.col(c).cast("double")))
    return df.withColumn(out, F.concat(*parts))
