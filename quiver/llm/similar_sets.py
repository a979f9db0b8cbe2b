"""What the similarity joins share: full sets of hashed shingles, exact confirmation,
and the search for links inside posting lists that does not write out the pairs of a list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import in_runs, runs, saved, tidy
from quiver.llm.shingles import Words, set_digest, shingle_set

#: A block of a list holds at most so many bytes of shingles (more only if one set has more) and so many sets.
BLOCK_BYTES, BLOCK_SETS = 8 << 20, 4096
FILTER_SLOTS = 1 << 18
FEW = 8


def full_sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(node, n, shingles) of the given classes (node, text_id, lo, hi), from the text of the document that stands for each."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_SLOTS))
    wanted = classes.select(F.col("text_id").alias("doc_id"), "node", "lo", "hi")
    slots = F.broadcast(wanted.select(slot.alias("slot")).distinct())
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    src = src.withColumn("slot", slot).join(slots, "slot", "left_semi").drop("slot")
    src = src.join(wanted.withColumnRenamed("doc_id", "text_id"), F.col("doc_id").eqNullSafe(F.col("text_id"))).select("node", "lo", "hi", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Words()
        for b in batches:
            out = []
            for node, lo, hi, t in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3).cast(pa.binary()).to_pylist()):
                s = shingle_set(table.hashes(t or b""), words)
                if len(s) and set_digest(s) == (lo, hi):  # rows that repeat an id may hold other texts
                    out.append((node, len(s), s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                                              pa.array([o[2] for o in out], pa.binary())], ["node", "n", "shingles"])

    return src.mapInArrow(tidy(run), "node long, n long, shingles binary").dropDuplicates(["node"])


def linked(a: np.ndarray, b: np.ndarray, share: tuple[int, int]) -> bool:
    """share[1] * intersection >= share[0] * union, on sorted distinct sets."""
    if min(len(a), len(b)) * share[1] < max(len(a), len(b)) * share[0]:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return share[1] * both >= share[0] * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), share)
                  for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


class Holders:
    """Sizes of a set's intersections with all sets of a block, from the block's inverted lists."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.values, self.starts, self.counts = np.unique(flat[order], return_index=True, return_counts=True)
        self.holders = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])[order]
        self.n = len(sets)

    def shared(self, s: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.values, s), len(self.values) - 1)
        at = at[self.values[at] == s]
        n = self.counts[at]
        ends = np.cumsum(n)
        index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - ends + n, n)
        return np.bincount(self.holders[index], minlength=self.n)


def tile_links(nodes: np.ndarray, comps: np.ndarray, side: np.ndarray, sets: list[np.ndarray], share: tuple[int, int],
               sig: np.ndarray | None = None, match: int = 0) -> list[tuple[int, int]]:
    """Links between sets of a tile's two sides (0, 1; 2: one block against itself) that are in different components.
    What a found link joins counts as one component from then on, so there are fewer links than sets. With
    signatures, only pairs that agree in ``match`` coordinates are compared."""
    left, right = np.nonzero(side != 1)[0], np.nonzero(side != 0)[0]
    if not len(left) or not len(right):
        return []
    own = bool((side == 2).all())
    names, group = np.unique(comps, return_inverse=True)
    size = np.array([len(s) for s in sets])
    by_coord = None if sig is None else np.ascontiguousarray(sig[right].T)
    held: Holders | None = None
    out = []
    for i in left:
        cand = np.nonzero((group[right] != group[i]) & (share[1] * np.minimum(size[right], size[i]) >= share[0] * np.maximum(size[right], size[i])))[0]
        if own:
            cand = cand[right[cand] > i]
        if by_coord is not None:
            count = np.zeros(len(cand), np.int32)
            for k in range(len(by_coord)):
                count += by_coord[k][cand] == sig[i, k]
                if k % 16 == 15:
                    go = count + (len(by_coord) - 1 - k) >= match
                    cand, count = cand[go], count[go]
                if not len(cand):
                    break
        if not len(cand):
            continue
        if len(cand) < FEW and held is None:
            found = [j for j in right[cand] if linked(sets[i], sets[j], share)]
        else:
            held = held or Holders([sets[j] for j in right])
            both = held.shared(sets[i])[cand]
            found = right[cand[share[1] * both >= share[0] * (size[i] + size[right[cand]] - both)]]
        for j in found:
            if group[i] != group[j]:
                group[group == group[j]] = group[i]
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def links_in_lists(rows: DataFrame, comp: DataFrame, sets: DataFrame, share: tuple[int, int], match: int = 0) -> DataFrame:
    """Links (a, b) between classes of a list (key, node) that are in different components (node, comp): at least one between any two
    components that have one. A list is cut into blocks by bytes and every two blocks meet in
    a tile, which compares the sets it holds itself: rows grow with classes times blocks, never with pairs.
    ``sets`` is (node, n, shingles), with a column ``sig`` if signatures are to be compared first."""
    placed = rows.join(comp, "node").join(sets.select("node", "n"), "node")
    lists = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")).filter(
        "lo != hi").select("key", F.greatest(F.ceil(F.col("c") / BLOCK_SETS), F.ceil(F.col("n") * 8 / BLOCK_BYTES)).cast("int").alias("nb"))
    lists = saved(lists, "open-lists")
    some = "sig" in sets.columns
    rows = placed.drop("n").join(lists, "key").withColumn("i", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "key", F.least("i", "j").alias("ti"), F.greatest("i", "j").alias("tj"), "node", "comp",
        F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1).alias("side"))
    rows = rows.join(sets.select("node", "shingles", *(["sig"] if some else [])), "node").select(
        "key", "ti", "tj", "node", "comp", "side", "shingles", *(["sig"] if some else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs(batches, 3):
            nodes, comps, side = (tile.column(k).to_numpy() for k in (3, 4, 5))
            if (comps == comps[0]).all():
                continue
            held = [np.frombuffer(s, np.uint64) for s in tile.column(6).to_pylist()]
            sig = np.array(tile.column(7).to_pylist()) if some else None
            found = tile_links(nodes, comps, side, held, share, sig, match)
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return in_runs(rows, "key", "ti", "tj").mapInArrow(tidy(run), "a long, b long")
