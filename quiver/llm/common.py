"""Shared helpers: working tables in the cluster's shared folder, the driver-side
handle to remove them, and the vocabulary files' place."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where it is unset, a
    local session gets a scratch folder; on a cluster that is an error, since
    executors could not see a folder of the driver's machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quiver-work-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/quiver-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, path: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: the
    lineage ends there, and a lost executor only repeats tasks that read it."""
    path = path or new_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a working table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only, null as empty. ASCII texts take the byte-wise path of
    ``lower``; in other texts only A-Z may change, so they go through ``translate``."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file (installed beside the library, not in this repository)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Rows go to Python in Arrow batches of at most ``size``, unless the session asks for smaller ones: texts
    are long, and a batch is held several times, as Arrow on both sides and as Python objects."""
    key, units = "spark.sql.execution.arrow.maxBytesPerBatch", {"k": 10, "m": 20, "g": 30}
    in_bytes = lambda x: int(x.rstrip("bkmg")) << units.get(x.rstrip("b")[-1:], 0)
    now = spark.conf.get(key, "64m").lower()
    if not 0 < in_bytes(now) <= in_bytes(size):
        spark.conf.set(key, size)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function after which its worker, which serves other tasks too, gives freed memory back to the system."""
    def and_release(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return and_release


def first_part(table: dict, share: int = 4) -> dict:
    """The entries that came first, to go on with when a table of words is full: what is frequent turns up early."""
    return dict(islice(table.items(), len(table) // share))


def spread_out(df: DataFrame) -> DataFrame:
    """Deal rows out evenly before a CPU-heavy stage when a small input sits in
    fewer files than there are cores. The plan's own partition count says so without running it."""
    spark = df.sparkSession
    files = len(df.inputFiles())
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < files < cores // 2 else df


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows in sequence that agree in the first ``keys`` columns (never null), as one table each.
    Of rows sorted by these it holds one group at a time, so a task's memory is that of its largest group."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows - 1, bool)
        for k in range(keys):
            c = b.column(k)
            new |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.nonzero(new)[0] + 1).tolist(), b.num_rows]
        if held and last != [b.column(k)[0].as_py() for k in range(keys)]:
            yield pa.Table.from_batches(held)
            held = []
        for s, e in zip(cuts[:-1], cuts[1:]):
            if s:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
        last = [b.column(k)[-1].as_py() for k in range(keys)]
    if held:
        yield pa.Table.from_batches(held)


def in_runs(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt and sorted by its key columns, as ``runs`` wants it."""
    return df.repartition(*keys).sortWithinPartitions(*keys)
