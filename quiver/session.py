"""Session helpers: building a local session for tests and benches, and the
shared checkpoint folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tuned for scans of wide parquet at scale: 128 MiB splits, AQE on so that
# shuffle partition counts and skewed joins are re-planned at run time.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def cluster_conf(input_tb: float = 100.0, executors: int = 1000, cores_per_executor: int = 8) -> dict:
    """Settings for a large cluster (defaults: ~100 TB input, 1,000
    executors). Shuffle partitions start high and AQE coalesces them to
    ~256 MiB each, so a stage never holds more than that per task; skewed
    join partitions above 1 GiB (and 5x the median) are split; scan splits of
    256 MiB keep ~400k scan tasks for 100 TB."""
    slots = executors * cores_per_executor
    initial = max(slots * 3, int(input_tb * 1024 * 1024 / 512))   # ~512 MiB of input per shuffle partition
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(initial),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1024 * 1024 * 1024),
        "spark.sql.shuffle.partitions": str(initial),
        "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        "spark.sql.session.timeZone": "UTC",
    }


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "quiver", extra: dict | None = None) -> SparkSession:
    """A local[N] session with the defaults above (tests, bench)."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("QUIVER_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    Where it is unset, ``fallback`` is used, and a local session gets a scratch
    folder. On a cluster without either this raises: a folder of the driver's
    machine would be invisible to the executors.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 -- a Spark Connect session has no SparkContext
        if not (conf_dir or fallback):
            raise ValueError("set spark.checkpoint.dir to shared storage") from None
        return conf_dir or fallback
    d = sc.getCheckpointDir() or conf_dir or fallback
    if not d:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to shared storage")
        import tempfile
        d = tempfile.mkdtemp(prefix="quiver-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives the
    loss of executors, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition when the input has fewer files than the cluster
    has cores (the test tables are one file with one row group each). Used
    before CPU-heavy stages only; on inputs of many files it does nothing. The
    files are known from the plan; no stage runs to count partitions."""
    try:
        want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 -- a Spark Connect session: leave the plan as is
        return df
    return df.repartition(want) if 0 < len(df.inputFiles()) < want else df


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 for TIMESTAMP_NTZ (and TIMESTAMP) columns.

    Independent of the session time zone, unlike ``date_trunc`` on NTZ values.
    """
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                           c.cast("timestamp_ntz"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


GRID = 1048576.0  # 2^20


def round6(c: Column) -> Column:
    """Round to a 2^-20 grid (about 6 decimals) and fold -0.0 into 0.0, for
    value hashes that agree across engines. A binary grid is used because
    decimal data often sits exactly on a decimal half-way point, where engines
    round differently; it never sits on an odd multiple of 2^-21."""
    return F.round(c * F.lit(GRID), 0) / F.lit(GRID) + F.lit(0.0)
