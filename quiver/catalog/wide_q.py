"""The composed feature path at its real width: 13 categorical, 744 1-D, 273 2-D features and 44 deltas of every event."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiver.catalog import sqlbits as Q
from quiver.catalog.registry import query
from quiver.plans.wide import assemble, count_slots
from quiver.session import spread, table
from quiver.sources import wide as W


def _slot_sql() -> str:
    """The bucket of every feature, written out in SQL: a column each, then a row each."""
    fs, cols = W.WIDE, []
    u = "coalesce(user_id, 0)"
    for i, f in enumerate(sorted(fs.sparse)):
        cols.append(f"('0x' || substr(md5('{i}:' || ({u} % {5 + i})), 1, 8))::BIGINT % {fs.sparse[f]} AS {f}")
    for i, f in enumerate(W.DENSE):
        a, b, n = W.numbers(i)
        v = f"((event_id * {a} + {u} * {b}) % {n} - 1)"
        cols.append(f"{Q.bucket(Q.compress(v), fs.dense_log[f]) if f in fs.dense_log else Q.bucket(f'{v}::FLOAT', fs.dense[f])} AS {f}")

    def element(i: int) -> str:
        a, b, n = W.numbers(i)
        return f"((event_id * {a} + {u} * {b} + j * {i + 3}) % {n} - 1)"

    def largest(x: str) -> str:
        return f"list_max(list_transform(range({W.SLOTS_2D}), lambda j: {x}))"

    for i, f in enumerate(W.ARRAYS):
        x = largest(element(i))
        cols.append(f"{Q.bucket(Q.compress(x), fs.arrays_log[f]) if f in fs.arrays_log else Q.bucket(f'{x}::FLOAT', fs.arrays[f])} AS {f}")
    place = {f: i for i, f in enumerate(W.ARRAYS)}
    for m, hs in W.LADDER_OF.items():
        for h, k in zip(hs, hs[1:]):
            p, c = (element(place[f"{m}_{x}h_{W.KEY}_all"]) for x in (h, k))
            d = f"CASE WHEN {p} <= -1 OR {c} <= -1 THEN -1.0::DOUBLE ELSE {Q.signed_delta(f'{p} / {h}.0::DOUBLE', f'{c} / {k}.0::DOUBLE')} END"
            name = f"{m}_{h}_{k}h_{W.KEY}_all"
            cols.append(f"{Q.bucket(f'{largest(d)}::FLOAT', fs.arrays[name])} AS {name}")
    wide = ", ".join(f"({c.rsplit(' AS ', 1)[0]})::BIGINT AS {c.rsplit(' AS ', 1)[1]}" for c in cols)
    return f"SELECT feature, bucket, count(*) AS n FROM (UNPIVOT (SELECT {wide} FROM events) ON COLUMNS(*) INTO NAME feature VALUE bucket) GROUP BY ALL"


def _events(spark, d):
    return W.categories(spread(table(spark, d, "events").select("event_id", "user_id")), W.NUMBERS.needs)


@query("P23_wide_slots", _slot_sql())
def slots(spark, d):
    """Events per feature and bucket."""
    names = spark.createDataFrame([(i, f, b) for i, (f, b) in enumerate(W.WIDE.slots().names())], "slot int, feature string, bucket long")
    counts = count_slots(assemble(_events(spark, d), W.WIDE, in_task=W.NUMBERS), W.WIDE.slots().total)
    return counts.join(F.broadcast(names), "slot").select("feature", "bucket", "n")    # a row a slot
