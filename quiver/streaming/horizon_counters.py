"""Multi-horizon counters over a stream of events (X1 as a stream).

An event's counters are final once no earlier event of its key can come any
more: when the watermark (the latest time seen less ``delay``) has passed
its time. Until then it waits in the state, so files may come in any
order, and results equal the batch version (``operators.horizons.multi_horizon``)
as long as nothing comes later than ``delay``.

Keys are dealt to ``groups`` by their hash, and a group is one key of the state: its events are counted together,
since a call of the state costs much more than an event. More groups spread a larger stream further;
a stream that goes on from a checkpoint needs the number it began with.

Late rows: an event at or before the time up to which its group's counters are
out is put out with ``late`` true and NULL counters, and counts in no window,
so what is out stays right and nothing vanishes. Events without a time
can't be counted; they are put out at once with NULL counters.

State per group: the events of the longest horizon before the watermark and those that
wait, in RocksDB, an entry for each stretch of a quarter of that horizon; they go when no window reaches them, and
only the time up to which a group is done is kept for good. Spark itself
would drop late rows before the operator sees them, so the watermark is
taken from copies of the rows that hold nothing but the time."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quiver.operators.horizons import HOUR_US
from quiver.session import epoch_micros

TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
NEVER, FAR = -(1 << 62), 1 << 62
STRETCHES = 4  # parts of the longest horizon, an entry of the state each
GROUPS = 256


Events = tuple[list[str], np.ndarray, np.ndarray, list[str | None]]   # keys, times, values, rows (None once they are out)


def window_totals(history: Sequence[Events], keys: list[str], at: np.ndarray, h_us: Sequence[int]) -> Iterator[np.ndarray]:
    """For each horizon the number of events and the sums of their values over a key's events in [t - h, t], for each key and t."""
    codes: dict[str, int] = {}
    code = np.array([codes.setdefault(k, len(codes)) for found in history for k in found[0]], np.int64)
    us, values = np.concatenate([found[1] for found in history]), np.concatenate([found[2] for found in history])
    order = np.lexsort((us, code))
    code, us, values = code[order], us[order], values[order]
    first = int(us.min())
    width = int(us.max()) - first + h_us[-1] + 1   # no window reaches into the key before
    if (len(codes) + 1) * width >= 1 << 63:
        raise OverflowError(f"{len(codes)} keys in a group: more groups are needed")
    place = code * width + (us - first)
    starts = np.searchsorted(code, np.arange(len(codes) + 1))
    sums = np.zeros((len(us) + len(codes), 1 + values.shape[1]))   # each key's sums begin with a row of zeros
    parts = np.concatenate([np.ones((len(us), 1)), values], axis=1)
    for k, (i, j) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        np.cumsum(parts[i:j], axis=0, out=sums[i + k + 1:j + k + 1])
    own = np.array([codes[k] for k in keys], np.int64)
    t = own * width + (at - first)
    upper = np.searchsorted(place, t, side="right") + own
    for h in h_us:
        yield sums[upper] - sums[np.searchsorted(place, t - h, side="left") + own]


class Counting(StatefulProcessor):
    def __init__(self, horizons: Sequence[int], n_values: int, columns: Sequence[str]):
        self.h_us = [h * HOUR_US for h in horizons]
        self.stretch_us = -(-self.h_us[-1] // STRETCHES)
        self.n_values, self.columns = n_values, list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # up to when counters are out, the last event, and of each stretch of time with events the first that waits
        self.place = handle.getValueState("place", "done long, last long, stretches array<long>, waiting array<long>")
        self.held = handle.getMapState("held", "stretch long", "events binary")

    def load(self) -> tuple[int, int, dict[int, int]]:
        if not self.place.exists():
            return NEVER, NEVER, {}
        done, last, stretches, waiting = self.place.get()
        return done, last, dict(zip(stretches, waiting))

    def events(self, stretch: int) -> Events:
        """The group's events of a stretch."""
        return pickle.loads(bytes(self.held.getValue((stretch,))[0]))

    def keep(self, stretch: int, found: Events) -> None:
        self.held.updateValue((stretch,), (pickle.dumps(found),))

    def result(self, rows: list, counters: list | None, late: bool) -> pd.DataFrame:
        out = {"row": rows, "late": [late] * len(rows)}
        for i, c in enumerate(self.columns):
            out[c] = counters[i] if counters else pd.array([None] * len(rows), "Float64" if c.startswith("s") else "Int64")
        return pd.DataFrame(out)

    def put_out(self, waiting: dict[int, int], upto: int) -> Iterator[pd.DataFrame]:
        """The counters of waiting events up to a time, one stretch after another, each with those its longest window reaches."""
        near: dict[int, Events] = {}
        for stretch in sorted(k for k, first in waiting.items() if first <= upto):
            near = {k: near[k] if k in near else self.events(k) for k in waiting if stretch - STRETCHES <= k <= stretch}
            keys, us, values, rows = near[stretch]
            ready = [i for i, (t, r) in enumerate(zip(us.tolist(), rows)) if r is not None and t <= upto]
            counters = []
            for total in window_totals(list(near.values()), [keys[i] for i in ready], us[ready], self.h_us):
                counters.append(total[:, 0].astype(np.int64))
                for k in range(self.n_values):
                    finite, pos, neg = total[:, 1 + 3 * k:4 + 3 * k].T
                    counters += [finite, (pos > 0) + 2 * (neg > 0)]
            yield self.result([rows[i] for i in ready], counters, False)
            for i in ready:
                rows[i] = None
            self.keep(stretch, near[stretch])
            waiting[stretch] = min((t for t, r in zip(us.tolist(), rows) if r is not None), default=FAR)

    def settle(self, done: int, last: int, waiting: dict[int, int], upto: int) -> None:
        """What no window reaches any more goes; a timer for the next waiting event, or else for the end of the group's last window."""
        done = max(done, upto)
        for stretch in [k for k in waiting if (k + 1) * self.stretch_us < done - self.h_us[-1]]:
            self.held.removeKey((stretch,))
            del waiting[stretch]
        self.place.update((done, last, list(waiting), list(waiting.values())))
        first = min(waiting.values(), default=FAR)
        if waiting:
            self.handle.registerTimer((first if first < FAR else last + self.h_us[-1] + 2 * self.stretch_us) // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, last, waiting = self.load()
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        for pdf in rows:
            keys, text = pdf["key"].tolist(), pdf["row"].tolist()
            values = pdf[[f"{x}{k}" for k in range(self.n_values) for x in ("v", "pos", "neg")]].to_numpy(float).reshape(len(pdf), -1)
            timeless = pdf["us"].isna().to_numpy()
            us = pdf["us"].fillna(0).to_numpy().astype(np.int64)
            late = ~timeless & (us <= done)
            new = np.nonzero(~timeless & ~late)[0]
            new = new[np.argsort(us[new] // self.stretch_us, kind="stable")]
            stretches, first = np.unique(us[new] // self.stretch_us, return_index=True)
            for k, at in zip(stretches.tolist(), np.split(new, first[1:])):
                found = [keys[i] for i in at], us[at], values[at], [text[i] for i in at]
                if k in waiting:
                    held = self.events(k)
                    found = held[0] + found[0], np.concatenate([held[1], found[1]]), np.concatenate([held[2], found[2]]), held[3] + found[3]
                self.keep(k, found)
                waiting[k] = min(waiting.get(k, FAR), int(us[at].min()))
                last = max(last, int(us[at].max()))
            for out, is_late in ((timeless, False), (late, True)):
                if out.any():
                    yield self.result([text[i] for i in np.nonzero(out)[0]], None, is_late)
        yield from self.put_out(waiting, upto)
        self.settle(done, last, waiting, upto)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done, last, waiting = self.load()
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        yield from self.put_out(waiting, upto)
        self.settle(done, last, waiting, upto)

    def close(self) -> None:
        pass


def multi_horizon_stream(stream: DataFrame, key: str, ts: str, horizons_hours: Sequence[int], value_cols: Sequence[str] = (),
                         delay: str = "1 day", name: str = "{m}_{h}h", groups: int = GROUPS) -> DataFrame:
    """X1 over a stream: the input columns, ``late``, and per horizon ``cnt_<h>h`` and ``<v>_sum_<h>h``, in append
    mode. Start the query that writes it under ``running_stats.STORE_CONF``, as ``running_stats.run_to_table`` does."""
    hs = sorted(int(h) for h in horizons_hours)
    names = [c for i in range(len(hs)) for c in (f"c{i}", *(x for k in range(len(value_cols)) for x in (f"s{k}_{i}", f"odd{k}_{i}")))]
    us, inf = epoch_micros(ts), F.lit(float("inf"))
    parts = []
    for k, v in enumerate(value_cols):
        x = F.col(v).cast("double")
        parts += [F.when(~(F.isnan(x) | (x == inf) | (x == -inf)), x).otherwise(0.0).alias(f"v{k}"),
                  *(F.when(F.isnan(x) | (x == edge), 1).otherwise(0).alias(f"{n}{k}") for n, edge in (("pos", inf), ("neg", -inf)))]
    # The row goes through Python as text, and so does the key, "-" where there is none: Python's frames mix up missing values and NaN.
    named = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("-"))
    src = stream.select(F.to_json(F.struct(*stream.columns), TEXT).alias("row"), named.alias("key"), F.pmod(F.xxhash64(named), F.lit(groups)).alias("group"),
                        us.alias("us"), *parts)
    clocked = src.withColumn("clock", F.explode(F.array(F.timestamp_micros("us"), F.lit(None).cast("timestamp")))).withWatermark(
        "clock", delay).filter("clock is null").drop("clock")
    schema = "row string, late boolean, " + ", ".join(f"{c} {'double' if c.startswith('s') else 'long'}" for c in names)
    out = clocked.groupBy("group").transformWithStateInPandas(Counting(hs, len(value_cols), names), schema, "append", "eventTime")
    cols = []
    for i, h in enumerate(hs):
        cols.append(F.col(f"c{i}").alias(name.format(m="cnt", h=h)))
        for k, v in enumerate(value_cols):
            odd = F.col(f"odd{k}_{i}")  # which infinities the window holds; NaN counts as both
            total = F.when(odd == 1, inf).when(odd == 2, -inf).when(odd == 3, F.lit(float("nan"))).otherwise(F.col(f"s{k}_{i}"))
            cols.append(total.alias(name.format(m=f"{v}_sum", h=h)))
    return out.select(F.from_json("row", stream.schema, TEXT).alias("_row"), "late", *cols).select("_row.*", "late", *[F.col(c) for c in _names(hs, value_cols, name)])


def _names(hs: Sequence[int], value_cols: Sequence[str], name: str) -> list[str]:
    return [n for h in hs for n in (name.format(m="cnt", h=h), *(name.format(m=f"{v}_sum", h=h) for v in value_cols))]
