"""Near-duplicates by an inverted join over MinHash coordinates.

1. Each text becomes its set of word shingles and a signature of ``coords`` minima.
   Texts with the same set are one class; only classes go on.
2. A class is posted under each of its (coordinate, value) pairs; a minimum carries
   its coordinate, since every coordinate permutes the hashes in its own way. Values held by
   one class alone can't collide and go. Classes that agree in at least ``match`` coordinates must
   agree in one of the rarest ``shared - match + 1`` values of each, its prefix, so only the prefixes are kept.
3. Every class first meets one other only: of the heads (smallest classes) of its
   lists, the one with most collisions. The pairs that reach ``match`` coordinates are confirmed on the full sets.
4. What is linked by now need not be compared again: lists whose classes are all in
   one component are skipped, and so are pairs within a component. The rest of each list is merged in tiles of
   two blocks bounded in bytes (``similar_sets.links_in_lists``), which count equal coordinates, skipping a pair once it can't reach the threshold,
   and confirm the rest on the full sets they hold, skipping pairs that became connected meanwhile. Only links leave a tile,
   fewer than it has classes, so no group is ever written out as its pairs, and no list or partner is capped.

A pair with similarity s misses with the chance that a binomial(coords, s) variable stays
below ``match``: for 64, 36 and 0.85 under 1e-7; all other steps are exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import saved, small_batches, spread_out, tidy
from quiver.llm.components import components
from quiver.llm.shingles import Words, set_digest, shingle_set
from quiver.llm.similar_sets import confirmed, full_sets, links_in_lists

WORDS, SHARE, COORDS, MATCH = 5, (85, 100), 64, 36
STRIDE = 1 << 15


def permutations(coords: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and masks, one of each a coordinate, from a fixed seed."""
    rng = np.random.default_rng(20_240_501)
    draw = lambda: rng.integers(0, 1 << 64, coords, np.uint64, endpoint=False)
    return draw() | np.uint64(1), draw()


def signatures(sets: list[np.ndarray], coords: int) -> np.ndarray:
    """Minima per coordinate of each (non-empty) set, as signed 64-bit numbers."""
    odd, mask = permutations(coords)
    out = np.empty((len(sets), coords), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(sets):
            end, size = at, 0
            while end < len(sets) and (end == at or size + len(sets[end]) <= STRIDE):
                size += len(sets[end])
                end += 1
            flat = np.concatenate(sets[at:end])
            starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at:end - 1]])]).astype(np.intp)
            for k in range(coords):
                out[at:end, k] = np.minimum.reduceat((flat ^ mask[k]) * odd[k], starts)
            at = end
    return out.view(np.int64)


def read(docs: DataFrame, words: int, coords: int) -> DataFrame:
    """doc_id, n_shingles, the 128 bits that name the set, and its signature (null without words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Words()
        for b in batches:
            sets = [shingle_set(table.hashes(t or b""), words) for t in b.column(1).cast(pa.binary()).to_pylist()]
            some = [s for s in sets if len(s)]
            sig = iter(signatures(some, coords).tolist() if some else [])
            names = [set_digest(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in names], pa.int64()),
                 pa.array([x[1] for x in names], pa.int64()), pa.array([next(sig) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                ["doc_id", "n", "lo", "hi", "sig"])

    src = spread_out(docs).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return src.mapInArrow(tidy(run), "doc_id long, n long, lo long, hi long, sig array<long>")


def confirm(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, match: int, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that agree in ``match`` coordinates and whose full sets are similar enough."""
    left = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
    right = sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    near = saved(pairs.join(right, "b").join(left, "a").filter(agree >= match).select("a", "b"), "near-pairs")
    return confirmed(near, sets, share)


def residual(posted: DataFrame, comp: DataFrame, sigs: DataFrame, sets: DataFrame, match: int, share: tuple[int, int]) -> DataFrame:
    """Links (a, b) between different components: at least one between any two that have one. Lists with
    the same head are merged as one, since the same classes mostly meet in several of them."""
    rows = posted.select(F.col("head").alias("key"), "node").unionByName(
        posted.select(F.col("head").alias("key"), F.col("head").alias("node"))).distinct()
    small = sigs.select("node", F.transform("sig", lambda x: F.shiftrightunsigned(x, 33).cast("int")).alias("sig"))
    return links_in_lists(rows, comp, sets.join(small, "node"), share, match)


def near_duplicates(docs: DataFrame, words: int = WORDS, share: tuple[int, int] = SHARE, coords: int = COORDS,
                    match: int = MATCH) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links), kept
    (doc_id = component_id), lead (the row that stands for its component; one in each).

    Null and empty texts and texts without words have no shingles and no links: each row is its own
    component. A null id is never the smallest while its component has another."""
    small_batches(docs.sparkSession)
    seen = saved(read(docs, words, coords).withColumn("uid", F.monotonically_increasing_id()), "signatures")
    classes = saved(seen.filter("n > 0").groupBy("lo", "hi", "n").agg(
        F.min("uid").alias("node"), F.min("doc_id").alias("least_id"), F.min_by("doc_id", "uid").alias("text_id"),
        F.min_by("sig", "uid").alias("sig")), "classes")

    keys = classes.select("node", F.explode(F.array_distinct("sig")).alias("key"))
    freq = saved(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "shared-values")
    shared = keys.join(freq, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "key"))).alias("shared"))
    length = F.size("shared") - match + 1
    active = saved(shared.filter(F.size("shared") >= match).select("node", F.slice("shared", 1, length).getField("key").alias("prefix")), "prefixes")
    posted = active.select("node", F.explode("prefix").alias("key"))
    lists = posted.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    posted = saved(posted.join(lists, "key"), "postings")
    hits = posted.filter("node != head").groupBy("node", "head").agg(F.count(F.lit(1)).alias("c"))
    first = hits.groupBy("node").agg(F.max(F.struct("c", (-F.col("head")).alias("h"))).alias("best")).select(
        F.col("node").alias("b"), (-F.col("best.h")).alias("a"))

    mine = saved(classes.join(posted.select("node").distinct(), "node"), "active-classes")
    sets = saved(full_sets(docs, mine, words), "full-sets")
    sigs = mine.select("node", "sig")
    links = saved(confirm(first, sigs, sets, match, share), "links")
    comp = saved(mine.select("node").join(components(links), "node", "left").select(
        "node", F.coalesce("root", "node").alias("comp")), "components")
    more = saved(residual(posted, comp, sigs, sets, match, share), "more-links")
    if not more.isEmpty():
        of = lambda side: comp.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))
        joined = components(more.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        comp = saved(comp.join(joined.select(F.col("node").alias("comp"), "root"), "comp", "left").select(
            "node", F.coalesce("root", "comp").alias("comp")), "components")

    named = classes.select("lo", "hi", "n", "node", "least_id").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = saved(named, "class-components")
    least = named.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "comp").select("lo", "hi", F.col("n").alias("cn"), "component_id", "comp")
    rows = seen.select("uid", "doc_id", "n", "lo", "hi").join(named.withColumnsRenamed({"lo": "clo", "hi": "chi"}), (F.col("lo") == F.col("clo"))
                       & (F.col("hi") == F.col("chi")) & (F.col("n") == F.col("cn")), "left")
    alone = F.col("comp").isNull()
    return rows.select("doc_id", F.col("n").alias("n_shingles"),
                       F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                       "uid", F.when(alone, F.col("uid")).otherwise(F.col("comp")).alias("comp")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The documents that stay, with all their columns: one of each component. An id goes if none of its rows stays."""
    found = saved(near_duplicates(docs, **how).select("doc_id", "kept"), "near-members")
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("stays")).filter(~F.col("stays")).select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__gone")), "left_anti")
