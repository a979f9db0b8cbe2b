"""Sequence operators: Q1-Q3."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiver.catalog import sqlbits as Q
from quiver.catalog.registry import query
from quiver.functions import arrays as A
from quiver.operators.sequence import consecutive
from quiver.session import round6, table
from quiver.sources import fixtures as X

EMB_DIM = 64
SEQ = 20


@query("Q1_masked_softmax", X.with_ctes(X.SEQ20_SQL) + f"""
SELECT user_id, list_transform(ex, lambda e: {Q.r6('e / (list_sum(ex) + 1e-6)')}) AS weights
FROM (SELECT user_id, list_transform(list_zip(value_seq, mask), lambda t: CASE WHEN t[2]
             THEN exp(t[1] / 10.0 - list_max(value_seq) / 10.0) ELSE 0.0::DOUBLE END) AS ex FROM seq20)""")
def q1(spark, d):
    s = X.seq20(spark, d)
    w = A.masked_softmax(F.transform("value_seq", lambda v: v / 10.0), "mask")
    return s.select("user_id", F.transform(w, lambda e: round6(e)).alias("weights"))


def emb_sequences(spark, d):
    """Per label: all embeddings by vec_id, in consecutive sequences of 20, as
    zero-padded array<array<double>> with masks."""
    e = table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    g = consecutive(e, "label", "vec_id", ["v"], SEQ, raw=True)
    zero = F.array_repeat(F.lit(0.0), EMB_DIM)
    padded = F.slice(F.concat("v_seq", F.array_repeat(zero, SEQ)), 1, SEQ)
    return g.select("label", "chunk", padded.alias("seq"), "mask")


EMB_SQL = f"""t AS (SELECT label, vec_id, embedding, (rn - 1) // {SEQ} AS chunk, (rn - 1) % {SEQ} + 1 AS i
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings))"""


Q2_SQL = f"""
WITH {EMB_SQL},
u AS (SELECT label, chunk, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM t),
n AS (SELECT label, chunk, count(*)::INTEGER AS n_valid FROM t GROUP BY ALL)
SELECT u.label, u.chunk, dim::INTEGER AS dim, {Q.r6('avg(x)')} AS pooled, n.n_valid
FROM u JOIN n ON u.label = n.label AND u.chunk = n.chunk GROUP BY u.label, u.chunk, dim, n.n_valid"""


def _pooled_rows(s, pooled, nv):
    return s.select("label", "chunk", F.posexplode(pooled).alias("dim", "pooled"), nv.alias("n_valid")).select(
        "label", "chunk", F.col("dim").cast("int").alias("dim"), round6(F.col("pooled")).alias("pooled"), "n_valid")


@query("Q2_masked_mean_pool", Q2_SQL)
def q2(spark, d):
    s = emb_sequences(spark, d)
    return _pooled_rows(s, *A.masked_mean_pool(["seq"], ["mask"], [EMB_DIM]))


@query("Q2_masked_mean_pool_two_features", Q2_SQL)
def q2_two(spark, d):
    """Q2 over two features, the halves of the vectors: their pooled vectors
    side by side are the whole vectors' pooled vector."""
    half = EMB_DIM // 2
    s = emb_sequences(spark, d).select(
        "label", "chunk", "mask", F.transform("seq", lambda v: F.slice(v, 1, half)).alias("a"),
        F.transform("seq", lambda v: F.slice(v, half + 1, half)).alias("b"))
    return _pooled_rows(s, *A.masked_mean_pool(["a", "b"], ["mask", "mask"], [half, half]))


@query("Q2_masked_mean_pool_seq20", X.with_ctes(X.SEQ20_SQL) + f"""
SELECT user_id, {Q.r6('CASE WHEN n_valid > 0 THEN list_sum(list_transform(list_zip(value_seq, mask), lambda t: CASE WHEN t[2] THEN t[1] ELSE 0.0 END)) / n_valid ELSE 0.0 END')} AS pooled
FROM seq20""")
def q2s(spark, d):
    s = X.seq20(spark, d)
    seqs = F.transform("value_seq", lambda v: F.array(v))
    return s.select("user_id", round6(F.element_at(A.masked_mean_pool_one(seqs, "mask", 1), 1)).alias("pooled"))


Q3_SQL = f"""
WITH {EMB_SQL},
nv AS (SELECT label, chunk, count(*) AS n FROM t GROUP BY ALL),
e AS (SELECT label, chunk, i, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM t),
lg AS (SELECT a.label, a.chunk, a.i, b.i AS j, sum(a.x * b.x) / sqrt({EMB_DIM}.0) AS l
       FROM e a JOIN e b ON a.label = b.label AND a.chunk = b.chunk AND a.d = b.d GROUP BY ALL),
mx AS (SELECT lg.label, lg.chunk, i, CASE WHEN max(nv.n) < {SEQ} THEN greatest(max(l), 0.0) ELSE max(l) END AS m
       FROM lg JOIN nv ON lg.label = nv.label AND lg.chunk = nv.chunk GROUP BY lg.label, lg.chunk, i),
ex AS (SELECT lg.label, lg.chunk, lg.i, j, exp(l - m) AS v
       FROM lg JOIN mx ON lg.label = mx.label AND lg.chunk = mx.chunk AND lg.i = mx.i),
w AS (SELECT label, chunk, i, j, v / (sum(v) OVER (PARTITION BY label, chunk, i) + 1e-6) AS w FROM ex),
o AS (SELECT w.label, w.chunk, w.i, e.d, sum(w.w * e.x) AS y
      FROM w JOIN e ON w.label = e.label AND w.chunk = e.chunk AND w.j = e.i GROUP BY w.label, w.chunk, w.i, e.d)
SELECT o.label, o.chunk, (o.d - 1)::INTEGER AS dim, {Q.r6('sum(y) / max(nv.n)')} AS pooled
FROM o JOIN nv ON o.label = nv.label AND o.chunk = nv.chunk GROUP BY o.label, o.chunk, o.d"""


@query("Q3_self_attention_pool", Q3_SQL)
def q3(spark, d):
    s = emb_sequences(spark, d)
    out = A.self_attention_pool(s, "seq", "mask", keep=["label", "chunk"])
    return out.select("label", "chunk", F.posexplode("pooled").alias("dim", "pooled")).select(
        "label", "chunk", F.col("dim").cast("int").alias("dim"), round6(F.col("pooled")).alias("pooled"))
