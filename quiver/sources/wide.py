"""A generated feature set of the real width and its rows, for tests, queries and timing: 13 categorical, 744 1-D and
273 2-D features and 44 deltas, with names of the grammar and bounds from a rule, and values that any
engine can compute from an event's ids."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from quiver.plans.wide import PIECE_ROWS, SLOTS_2D, FeatureSet, InTask

# Fixed values of the reference's grammar: windows in hours.
HOURS = (1, 3, 6, 12, 24, 48, 72)
METRICS_1D, METRICS_2D, LADDERS = 93, 39, 8
KEY = "vmid"


def numbers(i: int) -> tuple[int, int, int]:
    """Multipliers and modulus of the i-th feature's values, which run from -1 upwards."""
    return 7919 + 2 * i, 104_729 + 31 * i, 5 + i % 90


def bounds(i: int) -> list[float]:
    n = 3 + i % 8
    top = numbers(i)[2]
    return [round(top * (k + 1) / (n + 1) - 0.5, 3) for k in range(n)]


def log_bounds(i: int) -> list[float]:
    return [0.25 + 0.5 * k for k in range(3 + i % 6)]


DENSE = [f"fc_m{m}_count_{h}h" for m in range(METRICS_1D) for h in (*HOURS, 168)]
ARRAYS = [f"fc_m{m}_count_{h}h_{KEY}_all" for m in range(METRICS_2D) for h in HOURS]
#: Seven metrics with all their windows and one with the first three: 44 deltas.
LADDER_OF = {f"fc_m{m}_count": list(HOURS if m < 7 else HOURS[:3]) for m in range(LADDERS)}
DELTAS = [f"{m}_{a}_{b}h_{KEY}_all" for m, hs in LADDER_OF.items() for a, b in zip(hs, hs[1:])]

WIDE = FeatureSet(
    sparse={f"fc_id{i}": 3 + 37 * i for i in range(13)},
    dense={f: bounds(i) for i, f in enumerate(DENSE)}, dense_log={f: log_bounds(i) for i, f in enumerate(DENSE) if i % 3 == 0},
    arrays={f: bounds(i) for i, f in enumerate(ARRAYS)} | {f: [-3.5 + 0.375 * k for k in range(7 + i % 5)] for i, f in enumerate(DELTAS)},
    arrays_log={f: log_bounds(i) for i, f in enumerate(ARRAYS) if i % 8 < 5},
    ladders=LADDER_OF, key=KEY, portable=True)


class _Numbers(Mapping):
    """The 1-D and 2-D columns of some events, each made when asked for: (event * a + user * b) % n - 1, in arrays with j * step added
    before the modulus."""

    def __init__(self, ids: Mapping[str, pa.Array]):
        self.null = ids["event_id"].is_null().to_numpy(zero_copy_only=False)
        self.e, self.u = (ids[c].fill_null(0).to_numpy().astype(np.int64) for c in ("event_id", "user_id"))
        top = max(len(DENSE), len(ARRAYS))
        largest = max(abs(int(x)) for c in (self.e, self.u) for x in (c.min(initial=0), c.max(initial=0)))
        if largest * sum(numbers(top)[:2]) + SLOTS_2D * (top + 3) >= 1 << 63:
            raise OverflowError(f"ids of {largest} are too large for these features")
        self.signed = min(self.e.min(initial=0), self.u.min(initial=0)) < 0
        self.offsets = pa.array(np.arange(len(self.e) + 1, dtype=np.int32) * SLOTS_2D)

    def __getitem__(self, f: str) -> pa.Array:
        i, is_array = PLACE[f]
        a, b, n = numbers(i)
        x = self.e * a + self.u * b
        if not is_array:   # the remainder has the sign of the dividend, as in SQL
            return pa.array((np.fmod(x, n) if self.signed else x % n) - 1, mask=self.null)
        j = np.arange(SLOTS_2D) * (i + 3)
        if self.signed:
            x = np.fmod(x[:, None] + j, n) - 1
        else:   # the same from small numbers: two remainders are less than twice n
            x = (x % n).astype(np.int16)[:, None] + (j % n).astype(np.int16)
            x -= (x >= n) * np.int16(n) + np.int16(1)
        mask = np.repeat(self.null, SLOTS_2D) if self.null.any() else None
        return pa.ListArray.from_arrays(self.offsets, pa.array(x.astype(np.int64).ravel(), mask=mask))

    def __iter__(self) -> Iterator[str]:
        return iter(PLACE)

    def __len__(self) -> int:
        return len(PLACE)


PLACE = {f: (i, False) for i, f in enumerate(DENSE)} | {f: (i, True) for i, f in enumerate(ARRAYS)}
NUMBERS = InTask(("event_id", "user_id"), tuple(PLACE), _Numbers)


def categories(events: DataFrame, keep: Sequence[str] = ("event_id",)) -> DataFrame:
    """``keep`` and the categorical columns; ``NUMBERS`` makes the others from event_id and user_id."""
    u = F.coalesce("user_id", F.lit(0))
    return events.select(*keep, *(F.concat_ws(":", F.lit(str(i)), (u % (5 + i)).cast("string")).alias(f) for i, f in enumerate(sorted(WIDE.sparse))))


def wide_rows(events: DataFrame, keep: Sequence[str] = ("event_id",)) -> DataFrame:
    """``keep`` and all input columns of ``WIDE``."""
    narrow = categories(events, keep)
    names = narrow.columns
    src = categories(events, [*keep, F.col("event_id").alias("_e"), F.col("user_id").alias("_u")])
    at = src.columns.index("_e")
    own = [i for i in range(len(names) + 2) if i not in (at, at + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, PIECE_ROWS) for whole in batches for i in range(0, whole.num_rows, PIECE_ROWS)):
            made = _Numbers({"event_id": b.column(at), "user_id": b.column(at + 1)})
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in own), *made.values()], [*names, *made])

    fields = [*(StructField(f, LongType()) for f in DENSE), *(StructField(f, ArrayType(LongType())) for f in ARRAYS)]
    return src.mapInArrow(run, StructType([*narrow.schema.fields, *fields]))
