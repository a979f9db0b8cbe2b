"""Similarity join of sets of word n-grams by partitioning the universe of n-grams.

1. Each text becomes its set of shingles, as 64-bit hashes. Texts with the same set are one class.
2. Sizes fall into bands. Two linked sets, the smaller one in a band that ends at size ``hi``, differ in
   at most ``budget(hi)`` shingles. The band cuts the universe (the range of the hashes) into segments;
   a set's shingles in a segment are a subset, named by one hash. Differences have to
   fall somewhere: if a pair differs by more than allowed in every segment, it differs by more than the budget (pigeonhole).
   A segment allows no difference (its subset is a key) or one (the subset and all its
   one-deletion neighbours are keys), or it is skipped.
3. What a segment allows is a matter of cost: per band, from the number and the mean size of its sets, the allocation is taken
   whose keys and chance meetings (sets with hardly anything in a segment agree there) are fewest. Without one-deletion segments a band has
   some more segments than the budget needs, and each set skips as many, those with its most frequent keys.
4. Sets that share a key meet: first each with one head, then lists that still hold several components block by block
   (``similar_sets.links_in_lists``). All is confirmed on the full sets, so the result is exact.

A set is posted in its own band and in lower ones that may hold a partner."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import saved, small_batches, spread_out, tidy
from quiver.llm.components import components
from quiver.llm.shingles import Words, mix, set_digest, shingle_set
from quiver.llm.similar_sets import confirmed, full_sets, links_in_lists

WORDS, SHARE = 4, (85, 100)
BAND_RATIO, MOST_BANDS = 1.35, 200
SALT = np.uint64(0xA0761D6478BD642F)
PAIR_COST = 4.0  # a chance meeting of two sets in units of a key


def budget(size: int, share: tuple[int, int]) -> int:
    """The most shingles in which a linked pair differs whose smaller set has ``size``: a share of the union, which is at most size / share."""
    return (share[1] - share[0]) * size // share[0]


def bands(share: tuple[int, int]) -> np.ndarray:
    """The last size of each band: as far as the budget stays the same, at least a ratio. They grow beyond any text's length."""
    out, lo = [], 1
    while len(out) < MOST_BANDS and lo < 1 << 31:
        hi = max(lo, int(lo * BAND_RATIO))
        while budget(hi + 1, share) == budget(lo, share):
            hi += 1
        out.append(hi)
        lo = hi + 1
    return np.array(out)


@dataclass(frozen=True)
class Allocation:
    """A band's segments: the first ``ones`` of them allow one difference, the others none, and a set skips ``spare`` of its keys."""

    segments: int
    ones: int
    spare: int


def cost(a: Allocation, sets: float, size: float) -> float:
    """Keys of all sets, and pairs of unlike sets that agree in a segment because hardly anything of them falls into it."""
    m = a.segments
    none = (1 - 1 / m) ** size
    one = size / m * (1 - 1 / m) ** (size - 1)
    if a.spare:  # more empty segments than are skipped, by the Poisson distribution
        term = few = exp(-m * none)
        for k in range(1, a.spare + 1):
            term *= m * none / k
            few += term
        meet = max(0.0, 1 - few) ** 2
    else:
        meet = a.ones * (none**2 + 2 * none * one) + (m - a.ones) * none**2
    return sets * (m + a.ones * size / m) + PAIR_COST * sets * sets / 2 * meet


def allocate(most: int, sets: float, size: float) -> Allocation | None:
    """The cheapest allocation that no pair with at most ``most`` differences escapes; none if equal sets alone can be linked."""
    if most == 0:
        return None
    spare = max(1, (most + 1) // 8)
    half = (most + 1) // 2
    ones = sorted({0, half, *(1 << k for k in range(half.bit_length()))})
    options = [Allocation(most + 1 + spare, 0, spare)] + [Allocation(most + 1 - n, n, 0) for n in ones]
    return min(options, key=lambda a: cost(a, sets, size))


def plan(docs: DataFrame, words: int, share: tuple[int, int]) -> list[Allocation | None]:
    """An allocation per band, up to that of the longest text. All texts are counted, by their words, which bound the size of a set."""
    ends = bands(share)
    size = F.greatest(F.regexp_count(docs["text"], F.lit(r"[^\x20\x09-\x0D]+")) - (words - 1), F.lit(1)).cast("long")
    band = sum((F.when(F.col("size") > int(e), 1).otherwise(0) for e in ends), F.lit(0))
    seen = docs.select(size.alias("size")).filter("size is not null").groupBy("size").agg(F.count(F.lit(1)).alias("c")).groupBy(band.alias("band")).agg(
        F.sum("c").alias("sets"), F.sum(F.col("c") * F.col("size")).alias("sizes")).collect()  # at most a row a band
    by_band = {r.band: r for r in seen}
    out = []
    for k, hi in enumerate(ends[:max(by_band, default=-1) + 1]):
        r = by_band.get(k)
        out.append(allocate(budget(int(hi), share), r.sets if r else 1, r.sizes / r.sets if r else hi))
    return out


class Segments:
    """The keys of sets in a band."""

    def __init__(self, band: int, a: Allocation):
        m = a.segments
        self.ones = a.ones
        self.edges = np.array([(i << 64) // m for i in range(1, m)], np.uint64)
        self.tag = mix(np.arange(m, dtype=np.uint64) + (np.uint64(band + 1) << np.uint64(40)))

    def keys(self, s: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, int]:
        """One per segment, then the one-deletion neighbours, and how many are of the first kind. ``s`` is sorted and ``sums`` are running
        sums of its mixed hashes, so a subset's name is a difference of two, and an element less is a subtraction."""
        cut = np.concatenate([[0], np.searchsorted(s, self.edges), [len(s)]])
        name = sums[cut[1:]] - sums[cut[:-1]]
        whole = mix(name ^ self.tag)
        if not self.ones:
            return whole, len(whole)
        seg = np.repeat(np.arange(self.ones), np.diff(cut[:self.ones + 1]))
        less = name[seg] - np.diff(sums[:cut[self.ones] + 1])
        return np.concatenate([whole, mix(less ^ self.tag[seg])]), len(whole)


READ = "doc_id long, n long, lo long, hi long, posts array<struct<band:int,neighbour:boolean,key:long>>"


def read(docs: DataFrame, words: int, share: tuple[int, int], allocations: list[Allocation | None]) -> DataFrame:
    """doc_id, n_shingles, the 128 bits that name the set (null without words), and its keys in its own band and lower ones."""
    ends = bands(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Words()
        segments = [a and Segments(k, a) for k, a in enumerate(allocations)]
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                out, counts, parts = [], [0], []
                for t in b.column(1).cast(pa.binary()):
                    s = shingle_set(table.hashes(t.as_py() or b""), words)
                    out.append((len(s), *(set_digest(s) if len(s) else (None, None))))
                    n = 0
                    if len(s):
                        with np.errstate(over="ignore"):
                            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s ^ SALT), dtype=np.uint64)])
                        k = int(np.searchsorted(ends, len(s)))
                        while k >= 0 and ends[k] * share[1] >= len(s) * share[0]:  # a partner may be as small as this band's largest
                            if segments[k]:
                                keys, own = segments[k].keys(s, sums)
                                parts.append((k, own, keys))
                                n += len(keys)
                            k -= 1
                    counts.append(n)
                sizes = [len(p[2]) for p in parts]
                band = np.repeat(np.array([p[0] for p in parts], np.int32), sizes)
                extra = np.concatenate([np.arange(len(p[2])) >= p[1] for p in parts]) if parts else np.empty(0, bool)
                keys = np.concatenate([p[2] for p in parts]).view(np.int64) if parts else np.empty(0, np.int64)
                flat = pa.StructArray.from_arrays([pa.array(band), pa.array(extra), pa.array(keys)], ["band", "neighbour", "key"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *(pa.array(c, pa.int64()) for c in zip(*out)), pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), flat)],
                    ["doc_id", "n", "lo", "hi", "posts"])

    src = spread_out(docs).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return src.mapInArrow(tidy(run), READ)


def postings(posts: DataFrame, allocations: list[Allocation | None]) -> DataFrame:
    """(node, key) of keys that at least two sets share, one of them by its whole subset. Where sets skip ``spare`` keys, a linked pair agrees in more than
    ``spare`` of them, hence also in one that is not among the ``spare`` most frequent of either; a set with no more shared keys than that has no partner."""
    freq = saved(posts.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("neighbour").alias("far")).filter("c > 1 and not far").select("key", "c"),
                 "shared-keys")
    spare = F.element_at(F.array(*[F.lit(a.spare if a else 0) for a in allocations] or [F.lit(0)]), F.col("band") + 1)
    shared = posts.join(freq, "key").groupBy("node", "band").agg(F.array_sort(F.collect_list(F.struct("c", "key"))).alias("shared"))  # one text's keys
    kept = shared.withColumn("left", F.size("shared") - spare).filter("left > 0")
    return kept.select("node", F.explode(F.slice("shared", F.lit(1), F.col("left")).getField("key")).alias("key")).distinct()


def meeting(posted: DataFrame, classes: DataFrame, docs: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """(node, comp): the component of every class that has postings, from links confirmed on the full sets."""
    lists = posted.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    posted = saved(posted.join(lists, "key"), "postings")
    hits = posted.filter("node != head").groupBy("node", "head").agg(F.count(F.lit(1)).alias("c"))
    first = hits.groupBy("node").agg(F.max(F.struct("c", (-F.col("head")).alias("h"))).alias("best")).select(
        F.col("node").alias("b"), (-F.col("best.h")).alias("a"))
    mine = saved(classes.join(posted.select("node").distinct(), "node"), "active-classes")
    sets = saved(full_sets(docs, mine, words), "full-sets")
    links = saved(confirmed(first, sets, share), "links")
    comp = saved(mine.select("node").join(components(links), "node", "left").select("node", F.coalesce("root", "node").alias("comp")), "components")
    # lists with one head are worked off as one, since the same sets mostly meet in several of them
    rows = posted.select(F.col("head").alias("key"), "node").unionByName(posted.select(F.col("head").alias("key"), F.col("head").alias("node"))).distinct()
    more = saved(links_in_lists(rows, comp, sets, share), "more-links")
    if more.isEmpty():
        return comp
    of = lambda side: comp.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))
    joined = components(more.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    return saved(comp.join(joined.select(F.col("node").alias("comp"), "root"), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "components")


def join_similar(docs: DataFrame, words: int = WORDS, share: tuple[int, int] = SHARE, allocations: list[Allocation | None] | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links) of every row.

    Null and empty texts and texts without words have no shingles and no links: each row is its own component. A null id is never the
    smallest while its component has another. Rows that repeat an id are sets of their own. Other columns are ignored."""
    small_batches(docs.sparkSession)
    allocations = plan(docs, words, share) if allocations is None else allocations
    seen = saved(read(docs, words, share, allocations).withColumn("uid", F.monotonically_increasing_id()), "ngram-keys")
    classes = saved(seen.filter("n > 0").groupBy("lo", "hi", "n").agg(
        F.min("uid").alias("node"), F.min("doc_id").alias("least_id"), F.min_by("doc_id", "uid").alias("text_id")), "classes")
    posts = seen.join(classes.select(F.col("node").alias("uid")), "uid", "left_semi").select(F.col("uid").alias("node"), F.explode("posts").alias("p"))
    posts = saved(posts.select("node", "p.band", "p.neighbour", "p.key"), "posts")
    comp = meeting(postings(posts, allocations), classes, docs, words, share)

    named = classes.select("lo", "hi", "n", "node", "least_id").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = saved(named, "class-components")
    least = named.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "comp").select(F.col("lo").alias("clo"), F.col("hi").alias("chi"), F.col("n").alias("cn"), "component_id", "comp")
    rows = seen.select("doc_id", "n", "lo", "hi").join(named, (F.col("lo") == F.col("clo")) & (F.col("hi") == F.col("chi")) & (F.col("n") == F.col("cn")), "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
