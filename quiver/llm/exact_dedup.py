"""Exact deduplication as a stateful stream.

The stream's state holds, for every digest ever seen, the number of its rows and
the row that stays: its stable identifier and the locator of its content (file and
row number in the ledger). The state lives in RocksDB on the executors' disks,
with its snapshots in the shared folder, and has no expiry; a later run over the
same checkpoint continues from it. A hit, that is a digest with more than one row,
is believed only after the full bytes were compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.llm.common import lower_az, new_path, saved

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of the filter that keeps texts without a hit out of the shuffle: a fixed bound for the broadcast.
FILTER_SLOTS = 1 << 18
HEAVY = 1000


def sha256(normalised: Column) -> Column:
    return F.sha2(normalised.cast("binary"), 256)


def absorb(spark: SparkSession, ledger_path: str, checkpoint: str, schema, bytes_per_batch: int = 1 << 33) -> DataFrame:
    """Run the stream over what is new in the ledger and return its whole state:
    digest, keeper (doc_id, row, file), n. Partial counts are merged before the
    shuffle, so a digest held by a third of all rows costs one row a task."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # many small stores: no space set aside
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))  # a new session has the default
    rows = own.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(ledger_path)
    state = rows.groupBy("digest").agg(
        F.max(F.struct("doc_id", "row", "file")).alias("keeper"), F.count(F.lit(1)).alias("n"))
    (state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    kept = own.read.format("statestore").load(checkpoint)
    return kept.select("key.digest", F.col("value.*")).toDF("digest", "keeper", "n")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, row.

    Equal: the same bytes after lower-casing A-Z; a null text is empty. The row with
    the largest id stays; of rows that repeat both id and text, exactly one is
    ``kept``. A null id sorts before all others. Empty input gives an empty result."""
    spark = docs.sparkSession
    norm = lower_az(F.col(text_col))
    ledger_path = new_path(spark, "ledger")
    ledger = saved(docs.select(F.col(id_col).alias("doc_id"), digest(norm).alias("digest"), sha256(norm).alias("text_sha256"),
                               F.monotonically_increasing_id().alias("row"), F.input_file_name().alias("file")),
                   "ledger", ledger_path)
    state = saved(absorb(spark, ledger_path, new_path(spark, "dedup-state"), ledger.schema), "dedup-groups")
    # Digests with more than 1/HEAVY of all rows are fewer than HEAVY: their rows meet them where they are, without a shuffle.
    large = F.col("n") > ledger.count() / HEAVY
    heavy = F.broadcast(state.filter(large))
    member = ledger.join(heavy.select("digest"), "digest", "left_anti").join(state.filter(~large), "digest").unionByName(
        ledger.join(heavy, "digest"))
    hits = member.filter(F.col("n") > 1).select("digest", "doc_id").distinct()

    # Full bytes of the hits only. Ids go through a fixed number of slots first, so that most texts without a hit stay put.
    slot = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(FILTER_SLOTS))
    slots = F.broadcast(hits.select(slot.alias("slot")).distinct())
    texts = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).withColumn("slot", slot).join(slots, "slot", "left_semi")
    seen = texts.select("doc_id", "norm", digest(F.col("norm")).alias("digest")).join(
        hits.select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest")),
        F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("digest") == F.col("hit_digest")), "left_semi")
    variant = seen.groupBy("digest", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    # A digest with two texts is a collision: its rows are grouped by their bytes instead.
    clash = variant.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") > 1).select("digest")
    clash = saved(clash, "dedup-collisions")
    mended = saved(
        variant.join(clash, "digest").join(
            seen.select("doc_id", "digest", "norm").distinct(), ["digest", "norm"]).select(
            "digest", "doc_id", sha256(F.col("norm")).alias("text_sha256"), "keep_id", "n"), "dedup-mended") \
        if not clash.isEmpty() else None

    out = member.select("digest", "doc_id", "text_sha256", "row", F.col("keeper.doc_id").alias("keep_id"),
                        F.col("keeper.row").alias("keep_row"), "n")
    if mended is not None:
        fixed = mended.select("digest", F.col("doc_id").alias("fixed_id"), "text_sha256", F.col("keep_id").alias("fixed_keep"),
                              F.col("n").alias("fixed_n"))
        again = out.join(clash, "digest", "left_semi").join(
            fixed, (out.digest == fixed.digest) & out.doc_id.eqNullSafe(fixed.fixed_id) & (out.text_sha256 == fixed.text_sha256)
        ).select(out.digest, "doc_id", out.text_sha256, "row", F.col("fixed_keep").alias("keep_id"), F.col("fixed_n").alias("n"))
        first = again.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "text_sha256").agg(
            F.max("row").alias("keep_row"))
        again = again.join(first, ["digest", "text_sha256"]).select(out.columns)
        out = out.join(clash, "digest", "left_anti").unionByName(again)
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"),
                      "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns. Rows that repeat both id
    and text are one document, of which one row stays."""
    member = saved(dedup(docs), "dedup-members")
    keys = [F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__key")]
    rows = docs.withColumn("__sha", sha256(lower_az(docs["text"])))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__key"))
    stay = rows.join(member.filter("kept").select(*keys), same, "left_semi")
    repeated = member.filter(~F.col("kept") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(*keys).distinct()
    if not repeated.isEmpty():
        stay = stay.join(repeated, same, "left_anti").unionByName(
            stay.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "__sha"]))
    return stay.select(docs.columns)
