"""How filters interact: what each removes at each place of every order.

Which filters a document fails is a mask of five bits. A mask maps to one wide
integer with a field for each (order, step) of all 120 orders: 1 where that step
removes the document, else 0. One more field counts the document. Integers of
documents add up field by field, and a field of ``WIDTH`` bits can't run over
into the next one as long as there are fewer than 2^WIDTH documents, which ``unpack`` checks. Each task adds up
the integers of its rows (equal masks times their number), one sum per part and
kind of label; the sums, not the rows, are merged per part and unpacked.

Everything else follows from the fields: a filter's failures are what it removes
when it comes first, its failures alone what it removes when it comes last.

A document fails E if its text is also that of a smaller doc_id. That is settled on counts per (text digest,
part, mask, labels), so a text that a third of all rows share is a few rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiver.llm.common import in_runs, runs, saved

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
WIDTH = 64
FIELDS = len(ORDERS) * STEPS
BYTES = (FIELDS + 1) * WIDTH // 8
HELD_PARTS, SALTS = 256, 64
KINDS = ("everything", "good", "toxic")


def packed(mask: int) -> int:
    """The wide integer of a document that fails the filters in ``mask`` (bit 0: A)."""
    out = 1 << WIDTH * FIELDS
    for i, order in enumerate(ORDERS):
        for step, name in enumerate(order):
            if mask >> FILTERS.index(name) & 1:
                out += 1 << WIDTH * (STEPS * i + step)
                break
    return out


def unpack(total: int) -> tuple[int, list[list[int]]]:
    """Documents, and the removed ones per order and step."""
    raw = total.to_bytes(BYTES, "little")  # raises if the last field has run over
    fields = [int.from_bytes(raw[k * WIDTH // 8:(k + 1) * WIDTH // 8], "little") for k in range(FIELDS + 1)]
    if max(fields) > fields[-1]:
        raise OverflowError("a field of the packed counters holds more than there are documents")
    return fields[-1], [fields[STEPS * i:STEPS * (i + 1)] for i in range(len(ORDERS))]


def flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest (of the text), abcd (bits of the first four filters)."""
    text = F.coalesce(docs["text"], F.lit(""))
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = src.withColumn("words", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    n = F.size("words")
    fails = [n < 200, F.lit(100) * F.size(F.array_distinct("words")) < F.lit(50) * n,
             F.lit(100) * F.char_length(F.regexp_replace("text", "[^A-Z]+", "")) > F.lit(2) * F.char_length("text"),
             F.col("text").rlike("[#$%&*|]")]
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return words.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.cast("int").alias("abcd"))


def cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: rows counted, E settled."""
    own = labels.select(labels["doc_id"].cast("long").alias("l_id"), (labels["quality"] == 1).alias("q"), (labels["toxic"] == 1).alias("t"))
    own = own.filter("l_id is not null").groupBy("l_id").agg(F.max("q").alias("q"), F.max("t").alias("t")).withColumn("l_salt", F.lit(0).cast("long"))
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("digest", "part")).otherwise(F.lit(0))  # rows without an id stay dealt out
    marked = rows.withColumn("salt", salt).join(own, (F.col("doc_id") == F.col("l_id")) & (F.col("salt") == F.col("l_salt")), "left").select(
        "doc_id", "part", "digest", "abcd", F.coalesce("q", F.lit(False)).alias("good"), F.coalesce("t", F.lit(False)).alias("toxic"))
    alike = ["digest", "part", "abcd", "good", "toxic"]
    by_id = marked.groupBy(*alike, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    alone = F.col("doc_id").isNull()
    per_text = by_id.groupBy(*alike).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).alias("no_id"),
                                         F.min(F.when(~alone, F.struct("doc_id", "n"))).alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))  # a row per part and labels, however many copies
    stays = F.col("no_id") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    both = per_text.withColumn("stays", stays).select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("abcd").alias("mask"), F.col("stays").alias("n")),
        F.struct((F.col("abcd") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - F.col("stays")).alias("n")))).alias("c"))
    return both.select("part", "c.mask", "good", "toxic", "c.n").filter("n > 0")


SUMS = "part string, salt int, " + ", ".join(f"{k} binary" for k in KINDS)


def packed_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part the sums of the wide integers of a task's rows: of all, of the good, of the toxic."""
    wide = [packed(m) for m in range(1 << STEPS)]
    held: dict[str, list[int]] = {}
    for b in batches:
        same = pa.Table.from_batches([b]).group_by(["part", "mask", "good", "toxic"]).aggregate([("n", "sum")]).to_pydict()
        for part, mask, good, toxic, n in zip(same["part"], same["mask"], same["good"], same["toxic"], same["n_sum"]):
            sums = held.setdefault(part, [0, 0, 0])
            for k, counts in enumerate((True, good, toxic)):
                if counts:
                    sums[k] += n * wide[mask]
        if len(held) > HELD_PARTS:
            yield sums_batch(held)
            held = {}
    yield sums_batch(held)


def sums_batch(held: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(held, pa.string()), pa.array([0] * len(held), pa.int32()),
         *(pa.array([s[k].to_bytes(BYTES, "little") for s in held.values()], pa.binary()) for k in range(len(KINDS)))], ["part", "salt", *KINDS])


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[int]]]:
    """Each part with its three sums, from rows sorted by part; one part is held at a time."""
    for run in runs(batches, 2):
        part = run.column(0)[0].as_py()
        yield part, [sum(int.from_bytes(x, "little") for chunk in run.column(2 + k).chunks for x in chunk.to_pylist()) for k in range(len(KINDS))]


def merge_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, sums in merged(batches):
        yield sums_batch({part: sums})


REPORT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 600 rows of each part."""
    for part, sums in merged(batches):
        (n, removed), (_, good), (_, toxic) = map(unpack, sums)
        fails = {order[0]: gone[0] for order, gone in zip(ORDERS, removed)}
        alone = {order[-1]: gone[-1] for order, gone in zip(ORDERS, removed)}
        shapley = {f: sum(gone[order.index(f)] for order, gone in zip(ORDERS, removed)) for f in FILTERS}
        out = []
        for i, order in enumerate(ORDERS):
            kept = n
            for step, f in enumerate(order):
                kept -= removed[i][step]
                out.append((part, order, step + 1, kept, removed[i][step], fails[f] - removed[i][step], alone[f], good[i][step], toxic[i][step], shapley[f]))
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [c.split()[0] for c in REPORT.split(", ")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (source; null: empty string), filter order and step, with the columns of ``REPORT``.

    Null texts are empty. A row without an id never fails E and makes no other row fail it; rows that
    repeat an id and text count each, and neither is smaller than the other. A document is good (toxic) if any
    of its rows in ``labels`` says 1. No documents: no rows. Other columns are ignored."""
    found = cells(saved(flags(docs), "audit-flags"), labels)
    sums = found.mapInArrow(packed_sums, SUMS).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)).cast("int"))
    some = in_runs(sums, "part", "salt").mapInArrow(merge_sums, SUMS)  # a part that all tasks hold is added up in parts first
    return in_runs(some, "part", "salt").mapInArrow(report, REPORT)
