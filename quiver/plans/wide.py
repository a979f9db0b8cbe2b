"""The whole feature path of a train or evaluation run at its real width: categorical
hash slots (P20), 1-D buckets (P5), 2-D buckets with ratios and deltas (P6, P10, P12),
and their assembly (P23) into one list of slot numbers a row, one per feature.

A thousand features are a thousand numbers in one array, not a thousand columns.
For tables in long form, ``vectors_from_long`` assembles vectors by the features' ordinals."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from quiver.operators.features import hash_slot, skip_columns_containing
from quiver.plans.logistic import Slots

SLOTS_2D = 20   # fixed value of the reference: slots of a 2-D feature
PIECE_ROWS = 1024   # rows that are spread out at once: a row of arrays takes some 50 KB
Bounds = Mapping[str, Sequence[float]]


@dataclass(frozen=True)
class FeatureSet:
    """What a run computes per row. ``dense`` and ``arrays`` map features to their bounds; a feature in a log
    table is compressed and takes the bounds there. ``ratios`` are (numerator, denominator, output), ``ladders`` map a
    metric to its windows; their outputs are bucketized if ``arrays`` has bounds for them."""

    sparse: Mapping[str, int] = field(default_factory=dict)
    dense: Bounds = field(default_factory=dict)
    dense_log: Bounds = field(default_factory=dict)
    arrays: Bounds = field(default_factory=dict)
    arrays_log: Bounds = field(default_factory=dict)
    ratios: Sequence[tuple[str, str, str]] = ()
    ladders: Mapping[str, Sequence[int]] = field(default_factory=dict)
    key: str = ""
    reduce: str = "max"
    skip_shadow: bool = True
    portable: bool = False

    def made(self) -> list[str]:
        """Outputs of ratios and deltas, as a walk over declared columns gives them."""
        out = [o for n, d, o in self.ratios if n in self.arrays and d in self.arrays]
        for m, ladder in self.ladders.items():
            prev = ladder[0]
            for cur in ladder[1:]:
                name = f"{m}_{prev}_{cur}h_{self.key}_all"
                if f"{m}_{prev}h_{self.key}_all" in self.arrays and f"{m}_{cur}h_{self.key}_all" in self.arrays and name in self.arrays:
                    out.append(name)
                    prev = cur
        return out

    def inputs_2d(self) -> list[str]:
        made = set(self.made()) - {n for n, _, _ in self.ratios}
        return [f for f in sorted(self.arrays) if f not in made]

    def kept_dense(self) -> list[str]:
        names = sorted(self.dense)
        return skip_columns_containing(names)[0] if self.skip_shadow else names

    def slots(self) -> Slots:
        names = [*((f, self.sparse[f]) for f in sorted(self.sparse)),
                 *((f, len(self.dense_log.get(f, self.dense[f])) + 1) for f in self.kept_dense()),
                 *((f, len(self.arrays_log.get(f, self.arrays[f])) + 1) for f in sorted(self.arrays))]
        if len({n for n, _ in names}) < len(names):
            raise ValueError("a feature is declared twice")
        return Slots(tuple(n for n, _ in names), tuple(s for _, s in names))


@dataclass(frozen=True)
class InTask:
    """Integer and array columns that ``run`` makes from a few others, a piece of a batch at a time: rows of a thousand columns need not
    be planned as expressions nor cross between the JVM and Python. ``run`` maps names to arrays; each is asked for once."""

    needs: Sequence[str]
    makes: Sequence[str]
    run: Callable[[Mapping[str, pa.Array]], Mapping[str, pa.Array]]


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of exactly ``SLOTS_2D`` values: longer arrays are cut, shorter and missing ones filled with the default 0."""
    n = len(col)
    if not n:
        return np.zeros((0, SLOTS_2D))
    if not col.null_count and (np.diff(col.offsets.to_numpy()) == SLOTS_2D).all():  # conforming rows are taken as they lie
        return pc.fill_null(col.flatten(), 0).to_numpy().reshape(n, SLOTS_2D)
    size = np.minimum(pc.fill_null(pc.list_value_length(col), 0).to_numpy(), SLOTS_2D)
    row = np.repeat(np.arange(n), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    first = col.offsets.to_numpy()[:n].astype(np.int64)
    out = np.zeros((n, SLOTS_2D))
    if len(row):
        out[row, place] = pc.fill_null(col.values, 0).to_numpy()[first[row] + place]
    return out


def _largest(x: np.ndarray) -> np.ndarray:
    """Of each row: a column at a time, which is cheaper than along rows this short."""
    out = x[:, 0].copy()
    for j in range(1, x.shape[1]):
        np.maximum(out, x[:, j], out=out)
    return out.astype(float)


def _log(x: np.ndarray) -> np.ndarray:
    return np.log1p(np.maximum(x, 0.0))


def _delta(prev: np.ndarray, cur: np.ndarray, prev_h: float, cur_h: float) -> np.ndarray:
    """P12 with the reference's signed delta: of hourly rates, -1 where either input is invalid."""
    a, b = prev / prev_h, cur / cur_h
    return np.where((prev <= -1) | (cur <= -1), -1.0, np.where(a <= b, -_log(b - a), _log(b - a)) + 0.0)


def _bucket(x: np.ndarray, bounds: Sequence[float]) -> np.ndarray:
    """The number of bounds at or below x."""
    return np.searchsorted(np.asarray(bounds, float), x, side="right")


def assemble(df: DataFrame, features: FeatureSet, keep: Sequence[str] = (), out: str = "idx", in_task: InTask | None = None) -> DataFrame:
    """``keep`` and ``out``: a slot number per feature in the order of ``features.slots()``. Absent columns and
    NULLs take their defaults and arrays their length first (S2), so every row has exactly one slot a feature.
    The 1-D and 2-D columns that ``in_task`` makes are not looked for in ``df``.

    Hash slots are made in the JVM. The rest goes through Arrow a batch at a time: as expressions, a thousand features
    with a dozen comparisons each take Catalyst minutes to plan and no method holds them."""
    keep, slots = list(keep), features.slots()
    dense, inputs, arrays = features.kept_dense(), features.inputs_2d(), sorted(features.arrays)
    have, made_here, needs = set(df.columns), set(in_task.makes if in_task else ()), list(in_task.needs if in_task else ())
    missing = [f for f in arrays if f not in set(inputs) | set(features.made())]
    if missing:
        raise ValueError(f"no column and no definition makes {missing}")
    cols = [F.col(k) for k in keep]
    for f in sorted(features.sparse):
        x = F.coalesce(F.col(f).cast("string"), F.lit("")) if f in have else F.lit("")
        cols.append(hash_slot(x, features.sparse[f], portable=features.portable).alias(f"s:{f}"))
    cols += [(F.col(f).cast("bigint") if f in have else F.lit(None).cast("bigint")).alias(f"d:{f}") for f in dense if f not in made_here]
    cols += [(F.col(f).cast("array<bigint>") if f in have else F.lit(None).cast("array<bigint>")).alias(f"a:{f}") for f in inputs if f not in made_here]
    cols += [F.col(c).alias(f"n:{c}") for c in needs]
    place = {name: len(keep) + i for i, name in enumerate([*(f"s:{f}" for f in sorted(features.sparse)), *(f"d:{f}" for f in dense if f not in made_here),
                                                           *(f"a:{f}" for f in inputs if f not in made_here), *(f"n:{c}" for c in needs)])}
    outputs = set(features.made())
    parts = {x for n, d, _ in features.ratios for x in (n, d)} | {f"{m}_{h}h_{features.key}_all" for m, hs in features.ladders.items() for h in hs}
    shorten = _largest if features.reduce == "max" else lambda x: x.astype(float).mean(axis=1)
    starts = np.concatenate([[0], np.cumsum(slots.sizes)[:-1]]).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, PIECE_ROWS) for whole in batches for i in range(0, whole.num_rows, PIECE_ROWS)):
            made = in_task.run({c: b.column(place[f"n:{c}"]) for c in needs}) if in_task else {}
            found = [b.column(place[f"s:{f}"]).to_numpy() for f in sorted(features.sparse)]
            for f in dense:
                x = pc.fill_null(made[f] if f in made_here else b.column(place[f"d:{f}"]), 0).to_numpy().astype(float)
                found.append(_bucket(_log(x), features.dense_log[f]) if f in features.dense_log else _bucket(x.astype(np.float32), features.dense[f]))
            value, reduced = {}, {}
            for f in inputs:
                x = _matrix(made[f] if f in made_here else b.column(place[f"a:{f}"]))
                reduced[f] = shorten(x)
                if f in parts:
                    value[f] = x
            for n, d, o in features.ratios:
                if n in value and d in value:
                    value[o] = np.where((value[n] <= -1) | (value[d] <= -1), -1.0, _log(value[n]) - _log(value[d]))
            for m, ladder in features.ladders.items():
                prev = ladder[0]
                for cur in ladder[1:]:
                    name, x, y = f"{m}_{prev}_{cur}h_{features.key}_all", *(f"{m}_{h}h_{features.key}_all" for h in (prev, cur))
                    if x in value and y in value and name in features.arrays:
                        value[name], prev = _delta(value[x], value[y], prev, cur), cur
            for f in arrays:
                x = shorten(value[f]) if f in outputs else reduced[f]
                x, ends = (_log(x), features.arrays_log[f]) if f in features.arrays_log else (x, features.arrays[f])
                found.append(_bucket(x.astype(np.float32).astype(float), ends))
            idx = np.stack(found, axis=1).astype(np.int32) + starts if found else np.zeros((b.num_rows, 0), np.int32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * idx.shape[1]), pa.array(idx.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), flat], [*keep, out])

    if features.reduce not in ("max", "mean"):
        raise ValueError(f"unknown reduce: {features.reduce}")
    schema = StructType([*(df.schema[k] for k in keep), StructField(out, ArrayType(IntegerType()))])
    return df.select(*cols).mapInArrow(run, schema)


def count_slots(assembled: DataFrame, total: int, idx: str = "idx") -> DataFrame:
    """(slot, n): how many rows have each of ``total`` slots. A task counts its own rows first, so at most ``total`` rows a task are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(total, np.int64)
        for b in batches:
            n += np.bincount(b.column(0).flatten().to_numpy(), minlength=total)
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["slot", "n"])

    return assembled.select(idx).mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))


def vectors_from_long(long_df: DataFrame, ids: Sequence[str], features: Sequence[str], dense: bool = False) -> DataFrame:
    """P23 from rows (ids..., feature, value): per id ``positions`` and ``values`` of the features it has, by their place in
    ``features``, or with ``dense`` one ``vector`` of all of them, 0.0 where it has none. NULL values count as absent. A
    feature that is not listed, or comes twice for an id, ends the job with its name."""
    place = {f: i for i, f in enumerate(features)}
    if len(place) < len(features):
        raise ValueError("a feature is listed twice")
    spark = long_df.sparkSession
    order = F.broadcast(spark.createDataFrame(list(place.items()), "_f string, _at int"))   # a row a feature
    named = long_df.filter(F.col("value").isNotNull()).join(order, F.col("feature") == F.col("_f"), "left")
    at = F.when(F.col("_at").isNull(), F.raise_error(F.concat(F.lit("unknown feature: "), F.coalesce("feature", F.lit("NULL")))).cast("int")).otherwise(F.col("_at"))
    rows = named.select(*ids, F.struct(at.alias("at"), F.col("value").cast("double").alias("v")).alias("x"))
    per = rows.groupBy(*ids).agg(F.sort_array(F.collect_list("x")).alias("x"))   # at most a row a feature, or it ends below
    twice = F.size(F.array_distinct(F.transform("x", lambda e: e["at"]))) < F.size("x")
    checked = per.withColumn("x", F.when(twice, F.raise_error(F.lit("a feature comes twice for an id"))).otherwise(F.col("x")))
    positions, values = F.transform("x", lambda e: e["at"]), F.transform("x", lambda e: e["v"])
    if not dense:
        return checked.select(*ids, positions.alias("positions"), values.alias("values"))
    filled = F.map_from_arrays(positions, values)
    vector = F.transform(F.sequence(F.lit(0), F.lit(len(features) - 1)), lambda i: F.coalesce(F.try_element_at(filled, i), F.lit(0.0)))
    return checked.select(*ids, vector.alias("vector"))
