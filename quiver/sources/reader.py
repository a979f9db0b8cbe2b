"""Reading and conforming samples."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quiver.functions.arrays import fixed_length

# Fixed value of the reference: the 7 label positions.
LABEL_NAMES = ("convert", "gmv", "roi1", "cost", "ctr", "cvr", "p_date")


def read_samples(spark: SparkSession, paths: str, schema: StructType | str | None = None,
                 fmt: str = "parquet") -> DataFrame:
    """Read every file matched by ``paths``: entries joined by ``|``, each a
    Hadoop glob (``*``, ``{d1,d2}``). A declared schema skips inference and
    prunes the scan to the declared columns."""
    entries = [p for p in paths.split("|") if p]
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    return r.load(entries)


@dataclass(frozen=True)
class Field:
    """A declared field: name, Spark SQL type, default, fixed length for
    arrays (None for scalars)."""
    name: str
    dtype: str
    default: object = 0
    length: int | None = None


def conform(df: DataFrame, spec: Sequence[Field], keep: Sequence[str] = ()) -> DataFrame:
    """Select the declared fields in order; absent columns and NULLs take
    the typed default; arrays are truncated or right-padded to their length
    (NULL slots take the default too)."""
    out = [F.col(k) for k in keep]
    for f in spec:
        if f.length is None:
            c = F.col(f.name).cast(f.dtype) if f.name in df.columns else F.lit(None).cast(f.dtype)
            out.append(F.coalesce(c, F.lit(f.default).cast(f.dtype)).alias(f.name))
        else:
            et = f.dtype
            if f.name in df.columns:
                arr = F.transform(F.col(f.name).cast(f"array<{et}>"),
                                  lambda v: F.coalesce(v, F.lit(f.default).cast(et)))
            else:
                arr = F.lit(None).cast(f"array<{et}>")
            out.append(fixed_length(arr, f.length, f.default, et).alias(f.name))
    return df.select(*out)


def split_label(df: DataFrame, label: str = "label", names: Sequence[str] = LABEL_NAMES,
                suffix: str = "_label") -> DataFrame:
    """S3: pop the label vector and address it by position."""
    rest = [F.col(c) for c in df.columns if c != label]
    return df.select(*rest, *[F.element_at(F.col(label), i + 1).cast("double").alias(f"{n}{suffix}")
                             for i, n in enumerate(names)])


def check_schema(df: DataFrame, contract: Sequence[Field]) -> DataFrame:
    """One row per contract field: present, type_ok (from the schema,
    no data read) and the number of rows whose array length differs from the
    contract (one aggregation pass for all array fields)."""
    spark = df.sparkSession
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    arrays = [f for f in contract if f.length is not None and f.name in types]
    if arrays:
        row = df.agg(*[F.count_if(F.coalesce(F.size(F.col(f.name)), F.lit(-1)) != f.length).alias(f.name)
                       for f in arrays])
        counts_df = row.unpivot([], [f.name for f in arrays], "field", "n_bad_length")
    else:
        counts_df = spark.createDataFrame([], "field string, n_bad_length bigint")
    rows = []
    for f in contract:
        want = f"array<{f.dtype}>" if f.length is not None else f.dtype
        rows.append((f.name, f.name in types, types.get(f.name) == want))
    meta = spark.createDataFrame(rows, "field string, present boolean, type_ok boolean")
    return meta.join(counts_df, "field", "left").select(
        "field", "present", "type_ok", F.coalesce("n_bad_length", F.lit(0)).cast("bigint").alias("n_bad_length"))
