"""Sharding by fixed virtual slots.

Records are hashed by their text into thousands of slots, bytes are summed per
slot, and a versioned map says which shard holds a slot. Rebalancing edits the
map: only the slots that must move change their shard. Equal texts share a slot, so
they share a shard. A slot heavier than a whole shard's share (a text whose copies
hold that much) can't be balanced whole; its records are dealt to sub-slots by
their id. The slots number a few thousand at any input size, so their sums and the
map are small enough for the driver."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiver.llm.common import new_path, saved

SLOTS, SUB_SLOTS, CELLS = 4096, 64, 16


def digests(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (bytes and one), text_crc32, home slot, sub-slot and cell of each
    record. A null text has no bytes and shares the empty text's slot; a null id is a value like any other."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(slots)).cast("int").alias("home"),
        F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sub")), F.lit(SUB_SLOTS)).cast("int").alias("sub"),
        F.pmod(F.xxhash64(F.col("doc_id"), F.lit("cell")), F.lit(CELLS)).cast("int").alias("cell"))


def with_slots(rows: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Adds ``vslot``. Slots above one shard's share of the bytes are split; there are fewer of them than shards."""
    sums = {r.home: r.b for r in rows.groupBy("home").agg(F.sum("size").alias("b")).collect()}
    share = sum(sums.values()) / shards
    heavy = sorted(h for h, b in sums.items() if b > share)
    vslot = F.col("home")
    for i, h in enumerate(heavy):
        vslot = F.when(F.col("home") == h, F.lit(slots + i * SUB_SLOTS) + F.col("sub")).otherwise(vslot)
    return rows.withColumn("vslot", vslot.cast("int"))


def place(weights: dict[int, int], shards: int) -> dict[int, int]:
    """A first map: heaviest slot first, each to the shard that holds least (ties: smaller numbers)."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for v in sorted(weights, key=lambda v: (-weights[v], v)):
        held, s = heapq.heappop(heap)
        out[v] = s
        heapq.heappush(heap, (held + weights[v], s))
    return out


def rebalance(old: dict[int, int], weights: dict[int, int], shards: int, slack: float = 0.001) -> dict[int, int]:
    """Edit a map for new sums or another number of shards. Slots of shards that no
    longer exist and new slots are placed; then the heaviest shard gives the
    lightest one the slot that best evens the two out, until they are within
    ``slack`` of a share or no move helps. All other slots stay where they are."""
    out = {v: s for v, s in old.items() if s < shards and v in weights}
    held = [0] * shards
    for v, s in out.items():
        held[s] += weights[v]
    for v in sorted((v for v in weights if v not in out), key=lambda v: (-weights[v], v)):
        s = min(range(shards), key=lambda s: (held[s], s))
        out[v], held[s] = s, held[s] + weights[v]
    share = max(1.0, sum(held) / shards)
    while True:
        top, low = max(range(shards), key=lambda s: (held[s], -s)), min(range(shards), key=lambda s: (held[s], s))
        gap = held[top] - held[low]
        fits = [v for v, s in out.items() if s == top and 0 < weights[v] < gap]
        if gap <= slack * share or not fits:
            return out
        v = min(fits, key=lambda v: (abs(gap / 2 - weights[v]), v))
        out[v] = low
        held[top] -= weights[v]
        held[low] += weights[v]


class SlotMap:
    """The versioned map, one small table a version under ``path`` in shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, version: int, mapping: dict[int, int], weights: dict[int, int]) -> DataFrame:
        rows = [(v, s, int(weights.get(v, 0))) for v, s in sorted(mapping.items())]
        self.spark.createDataFrame(rows, "vslot int, shard int, bytes long").coalesce(1).write.parquet(f"{self.path}/version={version}")
        return self.read(version)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema("vslot int, shard int, bytes long").parquet(f"{self.path}/version={version}")

    def mapping(self, version: int) -> dict[int, int]:
        return {r.vslot: r.shard for r in self.read(version).collect()}


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, old: dict[int, int] | None = None,
          store: str | None = None, version: int = 1) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (the record's place in its shard,
    gapless from 0) per record, by the law of near-equal bytes. With ``old`` the given map is edited instead of made anew.

    Places need no pass over a shard: counts per (slot, cell) give each cell its
    first place, and rows are numbered within their cell by id, checksum and size."""
    spark = docs.sparkSession
    rows = saved(with_slots(saved(digests(docs, slots), "shard-digests"), shards, slots), "shard-rows")
    cells = rows.groupBy("vslot", "cell").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    weights: dict[int, int] = {}
    for c in cells:
        weights[c.vslot] = weights.get(c.vslot, 0) + c.bytes
    mapping = rebalance(old if old is not None else place(weights, shards), weights, shards)
    SlotMap(spark, store or new_path(spark, "slot-map")).write(version, mapping, weights)
    nth, start = dict.fromkeys(range(shards), 0), []
    for c in sorted(cells, key=lambda c: (c.vslot, c.cell)):
        s = mapping[c.vslot]
        start.append((c.vslot, c.cell, s, nth[s]))
        nth[s] += c.n
    start_df = spark.createDataFrame(start, "vslot int, cell int, shard int, first long")
    place_in = Window.partitionBy("vslot", "cell").orderBy("doc_id", "text_crc32", "size")
    return (rows.withColumn("nth", F.row_number().over(place_in) - 1).join(F.broadcast(start_df), ["vslot", "cell"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("first") + F.col("nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                    "vslot"))
