"""Running statistics over a stream of step metrics.

The reference's hook keeps every value of every metric in a growing list to
print a running mean. Here the state per metric is the count, sum and EMA up
to the last step in order, held by ``transformWithState``, and the steps
that came early: files need not arrive in step order, so a step waits in the
state until all before it are there, and results equal the batch version
(``plans.running.running_stats``) whatever the batches. Waiting steps lie in a
map state in RocksDB, an entry for each ``CHUNK`` steps of a metric, so any number can
wait and no task holds them all. Steps count up from ``first_step`` by one.
A gap is never given up, unless ``max_waiting`` says to do so while more steps
than that wait; a step that arrives after its place was passed, and
a step that comes again, is put out with ``late`` true and no statistics, and so is a row without a step, so
nothing vanishes. A NULL value adds nothing, as in the batch version: its step counts, and the EMA decays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quiver.plans.running import EMA_DECAY_DEFAULT

OUTPUT_SCHEMA = "metric string, step long, value double, mean double, ema double, late boolean"
PLACE_SCHEMA = "n long, total double, ema double, next_step long, waiting long"
CHUNK = 4096
# map state needs RocksDB; many small stores: no space set aside
STORE_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
              "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
              "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def _rows(metric, step, value, mean, ema, late) -> pd.DataFrame:
    return pd.DataFrame({"metric": metric, "step": pd.array(step, "Int64"), "value": pd.array(value, "object"),
                         "mean": mean, "ema": ema, "late": late})


class Running(StatefulProcessor):
    def __init__(self, decay: float, first_step: int, max_waiting: int | None):
        self.decay, self.first_step, self.max_waiting = decay, first_step, max_waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", PLACE_SCHEMA)
        self.chunks = handle.getMapState("waiting", "chunk long", "steps array<long>, vals array<double>")

    def chunk(self, seen: dict[int, dict[int, float]], c: int) -> dict[int, float]:
        """The waiting steps of chunk ``c``, read from the state once for each batch of rows."""
        if c not in seen:
            held = self.chunks.getValue((c,)) if self.chunks.containsKey((c,)) else None
            seen[c] = dict(zip(held[0], held[1])) if held else {}
        return seen[c]

    def put(self, seen: dict[int, dict[int, float]], c: int) -> None:
        if steps := seen.pop(c):
            self.chunks.updateValue((c,), (list(steps), list(steps.values())))
        elif self.chunks.containsKey((c,)):
            self.chunks.removeKey((c,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (metric,) = key
        n, total, ema, nxt, waiting = self.place.get() if self.place.exists() else (0, 0.0, 0.0, self.first_step, 0)
        for pdf in rows:
            seen: dict[int, dict[int, float]] = {}
            late: list[tuple[int | None, float | None]] = []
            values = pdf["value"].astype(object).where(~pdf["missing"], None)
            for step, value in zip(pdf["step"].tolist(), values.tolist()):
                if pd.isna(step):
                    late.append((None, value))
                    continue
                step = int(step)
                if step < nxt or step in (at := self.chunk(seen, step // CHUNK)):
                    late.append((step, value))
                else:
                    at[step] = value
                    waiting += 1
            moved = False
            while waiting:
                c = nxt // CHUNK
                at = self.chunk(seen, c)
                if nxt not in at:
                    if moved or self.max_waiting is None or waiting <= self.max_waiting:
                        break
                    for k in list(seen):
                        self.put(seen, k)
                    c = min(k for (k,) in self.chunks.keys())
                    nxt = min(self.chunk(seen, c))        # the gap is given up
                    continue
                start, ready = nxt, []
                while nxt // CHUNK == c and nxt in at:
                    ready.append(at.pop(nxt))
                    nxt += 1
                if not at:
                    self.put(seen, c)
                moved, waiting = True, waiting - len(ready)
                v = np.array([0.0 if x is None else x for x in ready])
                sums = total + np.cumsum(v)
                counts = n + np.arange(1, len(v) + 1)
                # the recursion e = decay * e + (1 - decay) * v, from the last value on
                emas = pd.Series(np.concatenate([[ema], v])).ewm(alpha=1 - self.decay, adjust=False).mean().to_numpy()[1:]
                n, total, ema = int(counts[-1]), float(sums[-1]), float(emas[-1])
                yield _rows(metric, start + np.arange(len(v)), ready, sums / counts, emas, False)
            for k in list(seen):
                self.put(seen, k)
            if late:
                yield _rows(metric, [s for s, _ in late], [v for _, v in late], None, None, True).astype(
                    {"mean": float, "ema": float})
        self.place.update((n, total, ema, nxt, waiting))

    def close(self) -> None:
        pass


def running_stats_stream(stream: DataFrame, decay: float = EMA_DECAY_DEFAULT, first_step: int = 1,
                         max_waiting: int | None = None) -> DataFrame:
    """``stream`` has columns (metric, step, value); returns a stream of
    (metric, step, value, mean, ema, late) in append mode. The query that
    writes it must start under ``STORE_CONF``, as ``run_to_table`` does."""
    missing = F.col("value").isNull()  # Python's frames can't tell a missing value from NaN
    return stream.select("metric", "step", F.coalesce("value", F.lit(0.0)).alias("value"), missing.alias("missing")).groupBy("metric").transformWithStateInPandas(
        Running(decay, first_step, max_waiting), OUTPUT_SCHEMA, "append", "none")


def run_to_table(stream_out: DataFrame, out_path: str, checkpoint: str) -> None:
    """Run until all available input is processed, appending to Parquet
    (exactly once through the checkpoint)."""
    conf = stream_out.sparkSession.conf
    before = {k: conf.get(k, None) for k in STORE_CONF}
    for k, v in STORE_CONF.items():
        conf.set(k, v)
    try:    # a query keeps the settings it starts with
        q = (stream_out.writeStream.format("parquet").option("path", out_path)
             .option("checkpointLocation", checkpoint).outputMode("append")
             .trigger(availableNow=True).start())
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    q.awaitTermination()
