"""Nearest neighbours by a block matrix join.

Queries and candidates are packed into blocks, and up to ``GROUP`` query blocks make a group.
A task holds one group, and the blocks of a part of the candidates are read past it, so no
shuffle copies either side. Every query block meets every candidate block in tiles; a tile
multiplies int8 codes, adds the quantisation error bound, and keeps the pairs that
can still be among the k best of what the task has seen. Only these are computed again
in double precision and enter the queries' lists of k, and the lists of all parts are merged
per query. The bound is the exact norm of what quantisation took away, so no
true neighbour is lost."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from quiver.llm.common import saved, small_batches, tidy

QUERY_BLOCK, CANDIDATE_BLOCK, TILE = 1024, 8192, 512
#: Query blocks of a group; bytes of a packed block's vectors; packed blocks of a Parquet row group (a reader holds a whole one).
GROUP, BLOCK_BYTES, ROW_GROUP = 16, 1 << 23, 8
#: Hits of a query that wait to be computed again, hits computed at once, hits of a query merged at once, and hits of
#: a query in a tile from which on all of that tile's are looked at more closely.
WAITING, HITS, MERGED, MANY = 4, 512, 64, 16
#: Pairs of a task: fewer are not worth a task, and more are not left to one. Blocks of a part of the candidates at
#: least, as each part fills lists of its own.
FEWEST_PAIRS, MOST_PAIRS, LEAST_PART = 1 << 24, 1 << 36, 32
NO_ID = np.iinfo(np.int64).max


def quantise(x: np.ndarray, scale: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (whole numbers up to 127), scale (each vector's own, unless it is given), norm of the residue, norm."""
    if scale is None:
        scale = np.abs(x).max(axis=1) / 127.0
        scale[scale == 0] = 1.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    left = x - codes * scale[:, None]
    with np.errstate(over="ignore"):
        return codes, scale, np.sqrt((left * left).sum(axis=1)), np.sqrt((x * x).sum(axis=1))


def single_product() -> bytes:
    """An ONNX model whose only node multiplies two matrices of int8."""
    def number(n: int) -> bytes:
        return bytes([n & 127 | 128]) + number(n >> 7) if n > 127 else bytes([n])

    def field(key: int, value: int | str | bytes) -> bytes:
        if isinstance(value, int):
            return number(key << 3) + number(value)
        value = value.encode() if isinstance(value, str) else value
        return number(key << 3 | 2) + number(len(value)) + value

    def matrix(name: str, kind: int, *dims: str) -> bytes:
        return field(1, name) + field(2, field(1, field(1, kind) + field(2, b"".join(field(1, field(2, d)) for d in dims))))

    int8, int32 = 3, 6
    node = field(1, "a") + field(1, "b") + field(2, "y") + field(4, "MatMulInteger")
    graph = field(1, node) + field(2, "product") + field(11, matrix("a", int8, "m", "d")) + field(11, matrix("b", int8, "d", "n")) + field(
        12, matrix("y", int32, "m", "n"))
    return field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13))


def float_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64   # either holds every sum exactly
    return a.astype(kind) @ b.astype(kind)


@lru_cache
def product(dims: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Multiplies codes (m, dims) by codes (dims, n), exactly: on whole numbers by onnxruntime, where it is installed and a trial
    with the largest codes comes out right (some processors cut sums off at 16 bits), else by numpy on floating-point numbers."""
    try:
        import onnxruntime
    except ImportError:
        return float_product
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    options.log_severity_level = 3
    try:
        session = onnxruntime.InferenceSession(single_product(), options, providers=["CPUExecutionProvider"])
        whole = lambda a, b: session.run(None, {"a": a, "b": b})[0]
        trial = np.random.default_rng(0).choice(np.array([-127, -128, 127, 126], np.int8), (2 * TILE, dims))
        trial[::5], trial[::7] = 127, -128
        a, b = trial[:TILE], np.ascontiguousarray(trial[TILE:].T)
        return whole if dims < 1 << 16 and np.array_equal(whole(a, b), a.astype(np.float64) @ b.astype(np.float64)) else float_product
    except Exception:   # a build without this node
        return float_product


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of row pairs, added up in the order of the components, so that equal vectors get equal scores."""
    total = np.zeros(len(q))
    for at in np.ascontiguousarray(np.multiply(q, c, dtype=np.float64).T):
        total += at
    return total


def most(kind: np.dtype) -> float:
    """No product of codes is larger."""
    return 2.0 ** 31 - 1 if kind == np.int32 else 2.0 ** 60


class Nearest:
    """The ``k`` nearest, of all candidates met so far, to each query of a group."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, query_block: int = QUERY_BLOCK):
        self.ids, self.x, self.k, self.query_block = ids, x, k, query_block
        parts = [quantise(x[at:at + query_block].astype(np.float64)) for at in range(0, len(x), query_block)]
        self.codes, self.scale, self.left, self.norm = (np.concatenate(p) for p in zip(*parts))
        self.score, self.found = np.full((len(ids), k), -np.inf), np.full((len(ids), k), NO_ID)
        self.floor = np.full(len(ids), -np.inf)   # the k-th best score is no lower
        self.multiply = product(x.shape[1])
        self.hair = 1e-12 + 4e-16 * x.shape[1]   # of two norms' product: more than rounding takes or adds

    def meet(self, cid: np.ndarray, c: np.ndarray) -> None:
        """``c``: candidates in order of their largest component, so that those of a tile can share a scale."""
        tiles, sizes = [], []
        for at in range(0, len(c), TILE):
            x = c[at:at + TILE].astype(np.float64)
            codes, scale, left, norm = quantise(x, np.full(len(x), np.abs(x).max() / 127.0 or 1.0))
            tiles.append(np.ascontiguousarray(codes.T))
            sizes.append((scale[0], left.max(), norm.max()))
        for at in range(0, len(self.ids), self.query_block):
            rows = slice(at, at + self.query_block)
            unit, bound = self.sizes(rows, np.array(sizes))
            if np.isneginf(self.score[rows, -1]).any():
                self.begin(rows, cid, tiles[0], unit[0], bound[0])
            need, hits, n = None, [], 0
            for t, codes in enumerate(tiles):
                near = self.multiply(self.codes[rows], codes)
                need = self.needs(rows, unit, bound, near.dtype) if need is None else need
                some = np.flatnonzero(near.max(axis=1) >= need[t])
                if len(some):
                    can = near[some] >= need[t][some][:, None]
                    if np.count_nonzero(can) > MANY * len(some):
                        can &= self.closer(some + at, c[t * TILE:(t + 1) * TILE])
                    q, i = np.divmod(np.flatnonzero(can), codes.shape[1])
                    hits.append((some[q] + at, i + t * TILE))
                    n += len(q)
                if n > WAITING * self.query_block or n and t == len(tiles) - 1:
                    self.settle(*(np.concatenate(h) for h in zip(*hits)), cid, c)
                    need, hits, n = None, [], 0

    def sizes(self, rows: slice, tiles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each tile (scale, largest residue, largest norm) and query: what a product of codes counts, and by how much the products are off."""
        qe, qn, (scale, left, norm) = self.left[rows], self.norm[rows], tiles.T[:, :, None]
        with np.errstate(all="ignore"):
            # |q.c - q'.c'| <= |q-q'||c| + |q'||c-c'|, and |q'| <= |q| + |q-q'|; a hair more covers rounding
            return self.scale[rows] * scale, (qe * norm + (qn + qe) * left) * (1 + 1e-9) + self.hair * (qn * norm) + 1e-300

    def begin(self, rows: slice, cid: np.ndarray, codes: np.ndarray, unit: np.ndarray, bound: np.ndarray) -> None:
        """A first floor from the first tile, where lists aren't full."""
        n = codes.shape[1]
        if n > self.k:
            near = self.multiply(self.codes[rows], codes)
            near = np.where(self.ids[rows][:, None] == cid[:n], -most(near.dtype), near)
            with np.errstate(all="ignore"):
                self.floor[rows] = np.fmax(self.floor[rows], np.partition(near, n - self.k, axis=1)[:, n - self.k] * unit - bound)

    def needs(self, rows: slice, unit: np.ndarray, bound: np.ndarray, kind: np.dtype) -> np.ndarray:
        """The product of codes from which on a pair can be among the k best; what overflows is kept."""
        with np.errstate(all="ignore"):
            need = np.ceil((np.maximum(self.score[rows, -1], self.floor[rows]) - bound) / unit)
        return np.clip(np.where(np.isnan(need), -np.inf, need), -most(kind), most(kind)).astype(kind)

    def closer(self, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The same on the vectors themselves, for queries that see many candidates closer together than codes can tell."""
        a, b = self.x[q].astype(np.float64), c.astype(np.float64)
        with np.errstate(all="ignore"):
            hair = 2 * self.hair * self.norm[q][:, None] * np.sqrt((b * b).sum(axis=1)) + 1e-300
            return ~(a @ b.T < np.maximum(self.score[q, -1], self.floor[q])[:, None] - hair)

    def settle(self, q: np.ndarray, c: np.ndarray, cid: np.ndarray, x: np.ndarray) -> None:
        """Compute hits again, and merge those that are among the k best into the lists."""
        other = self.ids[q] != cid[c]
        q, c = q[other], c[other]
        i, score = cid[c], np.empty(len(q))
        for at in range(0, len(q), HITS):
            s = slice(at, at + HITS)
            score[s] = exact(self.x.take(q[s], axis=0), x.take(c[s], axis=0))
        by = np.argsort(q, kind="stable")
        q, i, score = q[by], i[by], score[by]
        while len(q):
            kth = self.score[q, -1]
            better = (score > kth) | ((score == kth) & (i < self.found[q, -1]))
            q, i, score = self.merge(q[better], i[better], score[better])

    def merge(self, q: np.ndarray, i: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Put hits into the lists, ``MERGED`` of each query (``q`` is sorted); returns the others."""
        rows, first, n = np.unique(q, return_index=True, return_counts=True)
        place = np.arange(len(q)) - np.repeat(first, n)
        now, to = place < MERGED, (np.repeat(np.arange(len(rows)), n), self.k + place)
        to, shape = tuple(x[now] for x in to), (len(rows), self.k + min(MERGED, n.max(initial=0)))
        all_scores, all_ids = np.full(shape, -np.inf), np.full(shape, NO_ID)
        all_scores[:, :self.k], all_ids[:, :self.k] = self.score[rows], self.found[rows]
        all_scores[to], all_ids[to] = score[now], i[now]
        order = np.argsort(-all_scores, axis=1)
        all_scores, all_ids = np.take_along_axis(all_scores, order, axis=1), np.take_along_axis(all_ids, order, axis=1)
        tied = (all_scores[:, 1:] == all_scores[:, :-1]).any(axis=1)
        order = np.lexsort((all_ids[tied], -all_scores[tied]))
        all_ids[tied] = np.take_along_axis(all_ids[tied], order, axis=1)   # the scores stay as they are
        self.score[rows], self.found[rows] = all_scores[:, :self.k], all_ids[:, :self.k]
        return q[~now], i[~now], score[~now]

    def rows(self) -> pa.RecordBatch:
        r, at = np.nonzero(~(np.isneginf(self.score) & (self.found == NO_ID)))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[r]), pa.array(self.found[r, at]), pa.array(self.score[r, at])],
                                          ["query_id", "vec_id", "score"])


def usable(vector: Column) -> Column:
    """Not null, with finite components none of which is null, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def packed(rows: DataFrame, per_block: int, name: str) -> DataFrame:
    """Rows of (block, ids, vectors) of at most ``per_block`` vectors and ``BLOCK_BYTES`` each, in order of the largest component,
    cut from the partitions that ``rows`` has: no shuffle."""
    kind = np.dtype(number_type(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, held, most = [], [], 0, per_block

        def cut(n: int):
            i, v = np.concatenate(ids), np.concatenate(vectors)
            ids[:], vectors[:] = ([i[n:]], [v[n:]]) if len(i) > n else ([], [])
            i, v = i[:n], v[:n]
            order = np.argsort(np.abs(v).max(axis=1), kind="stable")
            return pa.RecordBatch.from_arrays([pa.array([i[order].tobytes()], pa.binary()), pa.array([v[order].tobytes()], pa.binary())],
                                              ["ids", "vectors"])

        for b in batches:
            if b.num_rows:
                ids.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
                vectors.append(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(b.num_rows, -1))
                held += b.num_rows
                most = max(1, min(per_block, BLOCK_BYTES // vectors[-1][0].nbytes))
            while held >= most:
                yield cut(most)
                held -= most
        if held:
            yield cut(held)

    blocks = rows.mapInArrow(tidy(run), "ids binary, vectors binary")
    return saved(blocks.withColumn("block", F.monotonically_increasing_id()), name, **{"parquet.block.row.count.limit": str(ROW_GROUP)})


def number_type(rows: DataFrame) -> str:
    """Of the vectors in blocks: what holds the components as they are."""
    return "<f4" if isinstance(rows.schema["v"].dataType.elementType, FloatType) else "<f8"


def shares(asked: int, candidates: int, cores: int, query_block: int, candidate_block: int) -> tuple[int, int]:
    """Groups of queries and parts of the candidates; each group meets each part in a task. Large groups read
    the candidates less often, and few parts give few lists to merge."""
    up = lambda a, b: -(-a // b)
    pairs = max(1, asked) * max(1, candidates)
    tasks = min(up(pairs, FEWEST_PAIRS), max(4 * cores, up(pairs, MOST_PAIRS)))
    groups = max(1, up(asked, GROUP * query_block))
    parts = max(1, min(up(tasks, groups), up(candidates, LEAST_PART * candidate_block)))
    return max(groups, min(up(tasks, parts), up(asked, query_block))), parts


def nearest(rows: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by inner product, ties
    to the smaller id. Vectors null, zero or with null or non-finite components take
    no part; neither do null ids. All vectors must have one length; an empty table gives no rows. Rows that repeat an id are candidates each."""
    spark = rows.sparkSession
    small_batches(spark)
    named, used = F.col(id_col).isNotNull(), usable(F.col(vector_col))
    found = lambda which: rows.filter(which).filter(used).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    cand, asked = packed(found(named), candidate_block, "vector-blocks"), found(named & queries)
    candidates = cand.agg(F.sum(F.octet_length("ids")) / 8).first()[0]
    if not candidates:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    groups, parts = shares(asked.count(), int(candidates), spark.sparkContext.defaultParallelism, query_block, candidate_block)
    ask = packed(asked.repartition(groups), 2 * GROUP * query_block, "query-blocks")   # repartition deals almost evenly
    ask = ask.repartitionByRange(groups, "block").select(F.col("block").alias("g"), F.col("ids").alias("qi"), F.col("vectors").alias("qv"))
    # A task's first block of candidates brings the group's queries along; they stay in the task.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    cand = cand.coalesce(parts).select("ids", "vectors", first.alias("first"))
    tiles = cand.crossJoin(ask.hint("shuffle_replicate_nl")).select("g", F.when(F.col("first"), F.col("qi")), F.when(F.col("first"), F.col("qv")), "ids", "vectors")
    kind = np.dtype(number_type(asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, Nearest] = {}
        for b in batches:
            for g, qi, qv, ids, vectors in zip(*b.columns):
                plain = lambda x, t: np.frombuffer(x.as_buffer(), t)
                if qi.is_valid:
                    qid = plain(qi, np.int64).copy()
                    lists[g.as_py()] = Nearest(qid, plain(qv, kind).reshape(len(qid), -1).copy(), k, query_block)
                cid = plain(ids, np.int64)
                lists[g.as_py()].meet(cid, plain(vectors, kind).reshape(len(cid), -1))
        for found in lists.values():
            yield found.rows()

    best = tiles.mapInArrow(tidy(run), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
