"""The feature path at real width against plain Python, and assembly from long form."""

import bisect
import math
import random

import pytest

from quiver.plans import logistic as G
from quiver.plans.wide import FeatureSet, assemble, vectors_from_long
from quiver.sources.wide import ARRAYS, DENSE, NUMBERS, WIDE, categories, numbers, wide_rows


def plain(row, fs):
    """One row's slots, feature by feature."""
    get = lambda f, d: d if row.get(f) is None else row[f]
    arrays = {f: ([0 if v is None else v for v in (row.get(f) or [])] + [0] * 20)[:20] for f in fs.inputs_2d()}
    lg = lambda v: math.log1p(max(v, 0.0))
    for n, d, o in fs.ratios:
        arrays[o] = [-1.0 if a <= -1 or b <= -1 else lg(a) - lg(b) for a, b in zip(arrays[n], arrays[d])]
    for m, ladder in fs.ladders.items():
        prev = ladder[0]
        for cur in ladder[1:]:
            name = f"{m}_{prev}_{cur}h_{fs.key}_all"
            if name in fs.arrays:
                pairs = zip(arrays[f"{m}_{prev}h_{fs.key}_all"], arrays[f"{m}_{cur}h_{fs.key}_all"])
                arrays[name] = [-1.0 if a <= -1 or b <= -1 else -lg(b / cur - a / prev) + 0.0 for a, b in pairs]
                prev = cur
    out = []
    for f in fs.kept_dense():
        x = get(f, 0)
        x, b = (lg(x), fs.dense_log[f]) if f in fs.dense_log else (x, fs.dense[f])
        out.append((f, bisect.bisect_right(b, x)))
    for f in sorted(fs.arrays):
        x = max(arrays[f])
        x, b = (lg(x), fs.arrays_log[f]) if f in fs.arrays_log else (x, fs.arrays[f])
        out.append((f, bisect.bisect_right(b, x)))
    return out


SMALL = FeatureSet(
    sparse={"s": 7}, dense={"d1": [0, 5, 10], "d2": [1], "d_shadow": [1]}, dense_log={"d2": [0.5, 1.5, 2.5]},
    arrays={"m_1h_vmid_all": [1, 2], "m_3h_vmid_all": [3], "m_6h_vmid_all": [0, 4], "m_1_3h_vmid_all": [-2.5, -1.5, -0.5, 0], "m_3_6h_vmid_all": [-0.75, 0],
            "n_1h_vmid_all": [-0.5, 0.25]},
    arrays_log={"m_6h_vmid_all": [1.0, 2.0]}, ratios=[("n_1h_vmid_all", "m_1h_vmid_all", "n_1h_vmid_all")], ladders={"m": [1, 3, 6]}, key="vmid")


def test_small_set_against_plain_python(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        row = {"id": i, "s": rng.choice(["a", "b", None]), "d1": rng.choice([None, -1, 0, 5, 11]), "d2": rng.randrange(0, 20)}
        for f in ("m_1h_vmid_all", "m_3h_vmid_all", "m_6h_vmid_all", "n_1h_vmid_all"):
            row[f] = None if rng.random() < 0.1 else [rng.choice([None, -1, 0, 1, 2, 5, 9]) for _ in range(rng.randrange(1, 25))]
        rows.append(row)
    schema = "id long, s string, d1 long, d2 long, " + ", ".join(f"{f} array<long>" for f in ("m_1h_vmid_all", "m_3h_vmid_all", "m_6h_vmid_all", "n_1h_vmid_all"))
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    slots = SMALL.slots()
    names = slots.names()
    got = {r.id: r.idx for r in assemble(df, SMALL, ["id"]).collect()}
    for row in rows:
        seen = [names[i] for i in got[row["id"]]]
        assert [f for f, _ in seen] == list(slots.features) and seen[1:] == plain(row, SMALL)
    without = assemble(df.drop("d2", "m_3h_vmid_all"), SMALL, ["id"]).filter("id = 5").first().idx
    assert [names[i] for i in without][1:] == plain({**rows[5], "d2": None, "m_3h_vmid_all": None}, SMALL)


def test_real_width(spark):
    assert (len(WIDE.dense), len(WIDE.inputs_2d()), len(WIDE.made()), len(WIDE.sparse)) == (744, 273, 44, 13)
    ev = spark.createDataFrame([(i, i % 7) for i in range(40)], "event_id long, user_id long")
    wide = wide_rows(ev)
    rows = {r.event_id: r.asDict() for r in wide.collect()}
    names = WIDE.slots().names()
    got = assemble(wide, WIDE, ["event_id"]).collect()
    for r in got:
        assert len(r.idx) == 1074 and [names[i] for i in r.idx][13:] == plain(rows[r.event_id], WIDE)
    slots = WIDE.slots()
    merged = G.merged_rows(assemble(wide, WIDE, ["event_id"]).selectExpr("idx", "cast(event_id % 2 as double) y"), slots, "y", idx="idx")
    model = G.fit(merged, slots, l2=10.0, tolerance=1e-4)
    assert model.gradient <= 1e-4 and len(model.coefficients) == slots.total + 1


def test_long_form_to_vectors(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (1, "a", 1.0), (2, "c", 5.0), (3, "a", None), (3, "b", 0.5)], "id long, feature string, value double")
    sparse = {r.id: (r.positions, r["values"]) for r in vectors_from_long(df, ["id"], ["a", "b", "c"]).collect()}
    assert sparse == {1: ([0, 1], [1.0, 2.0]), 2: ([2], [5.0]), 3: ([1], [0.5])}
    dense = {r.id: r.vector for r in vectors_from_long(df, ["id"], ["a", "b", "c"], dense=True).collect()}
    assert dense == {1: [1.0, 2.0, 0.0], 2: [0.0, 0.0, 5.0], 3: [0.0, 0.5, 0.0]}
    with pytest.raises(Exception, match="unknown feature: c"):
        vectors_from_long(df, ["id"], ["a", "b"]).collect()
    with pytest.raises(Exception, match="comes twice"):
        vectors_from_long(df.union(df), ["id"], ["a", "b", "c"]).collect()


def test_columns_made_in_the_task_are_those_of_the_wide_rows(spark):
    """The 1,017 numbers of a row by the rule in plain Python, whole-number signs and missing ids included, and slots that
    do not depend on where the columns are made; planning a thousand columns of expressions is no part of it."""
    ids = [(1, 3), (123_456_789, 77), (5, None), (None, 2), (None, None), (-40, 9), (7, -3)]
    ev = spark.createDataFrame(ids, "event_id long, user_id long").coalesce(1)
    rest = lambda x, n: x - int(math.trunc(x / n)) * n
    for r, (e, u) in zip(wide_rows(ev, ["event_id", "user_id"]).collect(), ids):
        u = u or 0
        assert (r.event_id, r.fc_id0) == (e, f"0:{rest(u, 5)}")
        for i, f in enumerate(DENSE):
            a, b, n = numbers(i)
            assert r[f] == (None if e is None else rest(e * a + u * b, n) - 1)
        for i, f in enumerate(ARRAYS):
            a, b, n = numbers(i)
            assert r[f] == [None if e is None else rest(e * a + u * b + j * (i + 3), n) - 1 for j in range(20)]
    plan = assemble(categories(ev, NUMBERS.needs), WIDE, ["event_id"], in_task=NUMBERS)
    assert len(plan._jdf.queryExecution().analyzed().toString()) < 100_000
    key = lambda r: (str(r.event_id), r.idx)
    assert sorted(map(key, plan.collect())) == sorted(map(key, assemble(wide_rows(ev), WIDE, ["event_id"]).collect()))
