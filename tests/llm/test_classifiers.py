import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.llm import fitting, quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held_out(df, labels, name):
    return df.filter("held_out").join(labels, "doc_id").select("score", "predicted", F.col(name).alias("y")).collect()


def auc(rows):
    pos, neg = [r.score for r in rows if r.y == 1], [r.score for r in rows if r.y == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


@pytest.mark.parametrize("module,name,folds,held,sf", [(quality, "quality", 4, 2, "sf0.01"), (toxicity, "toxic", 5, 0, "sf0.1")])
def test_held_out_accuracy(spark, module, name, folds, held, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = module.classify(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in rows)
    seen = held_out(got, labels, name)
    assert auc(seen) >= 0.95
    assert np.mean([r.predicted == r.y for r in seen]) >= 0.9


def test_labels_of_the_held_out_fold_are_never_used(tables):
    docs, labels = tables
    flipped = labels.withColumn("quality", F.when(fitting.fold(F.col("doc_id"), 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.classify(docs, flipped).collect()}
    assert a == b


@pytest.mark.parametrize("module,name", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, odd_docs, no_docs, module, name):
    labels = spark.createDataFrame([(100 + i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (101, None, None), (5, 7, 7)],
                                   "doc_id long, quality int, toxic int")
    rows = module.classify(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.score == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert module.classify(no_docs, labels).count() == 0
    assert len(module.classify(odd_docs, labels.filter("1 = 0")).collect()) == odd_docs.count()


def test_network_gradients_against_differences():
    """The backward pass of the recurrent network, attention and all, against finite differences."""
    rng = np.random.default_rng(0)
    m = toxicity.start([[b"a", b"b"]] * 3, np.array([1.0, 0, 1]))
    net = {k: np.asarray(rng.normal(size=np.shape(v)) * 0.5) for k, v in m["net"].items()}
    x = rng.normal(size=(3, 5, toxicity.WORD_DIM + toxicity.CHAR_DIM))
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0.0]])
    y, w = np.array([1.0, 0, 1]), np.array([0.5, 1, 2])

    def loss(p, x):
        logit, _ = toxicity.forward(p, x @ p["wx"] + p["bx"], mask)
        return float((w * np.logaddexp(0, np.where(y == 1, -logit, logit))).sum())

    grad, dx, _ = toxicity.gradients(net, x, mask, y, w)
    for k, v in net.items():
        for at in list(np.ndindex(np.shape(v)))[::max(1, np.size(v) // 5)]:
            up, down = {**net, k: np.array(v)}, {**net, k: np.array(v)}
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert abs((loss(up, x) - loss(down, x)) / 2e-5 - grad[k][at]) < 1e-5
    for at in [(0, 0, 0), (1, 2, 3), (2, 0, 5), (1, 4, 1)]:
        up, down = x.copy(), x.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        assert abs((loss(net, up) - loss(net, down)) / 2e-5 - dx[at] * (mask[at[:2]] > 0)) < 1e-5


def test_every_word_is_in_a_window():
    for n in (1, 15, 16, 17, 32, 33, 48, 49, 500):
        s = toxicity.windows(n)
        assert s[0] == 0 and s[-1] + toxicity.WINDOW >= n and (np.diff(s) <= toxicity.STRIDE).all() and s[-1] < n


def test_word_tables_are_emptied_at_their_bound(tables, monkeypatch):
    texts = [r.text.encode() for r in tables[0].limit(30).collect()]
    model = quality.fit(texts, [i % 2 for i in range(30)])
    whole = [quality.Pooler(model["vectors"]).features(t) for t in texts]
    monkeypatch.setattr(quality, "TABLE_BYTES", 50 * quality.ENTRY_BYTES)
    monkeypatch.setattr(quality, "BLOCK_WORDS", quality.SEGMENT * 2)
    one = quality.Pooler(model["vectors"])
    assert np.allclose(whole, [one.features(t) for t in texts], atol=1e-4)
    tox = toxicity.fit(texts, [i % 2 for i in range(30)], epochs=1)
    whole = toxicity.Reader(tox).score(texts)
    monkeypatch.setattr(toxicity, "TABLE_BYTES", 50 * toxicity.ENTRY_BYTES)
    assert np.allclose(whole, toxicity.Reader(tox).score(texts), atol=1e-4)


def plain_quality(model, text):
    """The forward pass word by word: pooled vectors of the text and of its segments, then the two layers and the temperature."""
    words = text.split()
    if not words:
        return 0.0
    total, segments = [0.0] * (quality.DIM + 1), []
    for at, w in enumerate(words):
        if at % quality.SEGMENT == 0:
            segments.append([0.0] * (quality.DIM + 1))
        for t in quality.tokens(w) + ([quality.REPEATED] if at and words[at - 1] == w else []):
            for k in range(quality.DIM):
                segments[-1][k] += float(model["vectors"][t][k])
            segments[-1][-1] += 1
    for seg in segments:
        total = [a + b for a, b in zip(total, seg)]
    means = [[v / (quality.PRIOR + seg[-1]) for v in seg[:-1]] for seg in segments]
    x = [v / (quality.PRIOR + total[-1]) for v in total[:-1]] + [max(c) for c in zip(*means)] + [min(c) for c in zip(*means)] + [math.log1p(len(words)) / 10]
    net = model["net"]
    z = [(v - m) / s for v, m, s in zip(x, net["mean"], net["scale"])]
    hidden = [math.tanh(sum(v * net["w1"][i][j] for i, v in enumerate(z)) + net["b1"][j]) for j in range(quality.HIDDEN)]
    logit = (sum(h * w for h, w in zip(hidden, net["w2"])) + float(net["b2"])) / net["temperature"]
    return 1 / (1 + math.exp(-logit))


def plain_toxicity(model, text):
    """Every window on its own: gates of one word after the other in both directions, attention, and the highest logit."""
    words = text.split()
    if not words:
        return 0.0
    net, n = model["net"], toxicity.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))

    def direction(inputs, u):
        h, out = np.zeros(n), []
        for x in inputs:
            z, r = sig(x[:n] + h @ u[:, :n]), sig(x[n:2 * n] + h @ u[:, n:2 * n])
            h = z * h + (1 - z) * np.tanh(x[2 * n:] + r * (h @ u[:, 2 * n:]))
            out.append(h)
        return out

    best = -math.inf
    for start in range(0, max(1, len(words) - (toxicity.WINDOW - toxicity.STRIDE)), toxicity.STRIDE):
        xs = []
        for w in map(toxicity.normal, words[start:start + toxicity.WINDOW]):
            marked = b"<" + w + b">" if w else b"<>>"
            codes = [((marked[i] << 16 | marked[i + 1] << 8 | marked[i + 2]) * 2654435761 % (1 << 32)) >> 20 for i in range(len(marked) - 2)]
            chars = sum(model["char"][c] for c in codes) / len(codes)
            xs.append(np.concatenate([model["word"][model["vocabulary"].get(w, 0)], chars]) @ net["wx"] + net["bx"])
        front, back = direction([x[:3 * n] for x in xs], net["uf"]), direction([x[3 * n:] for x in xs[::-1]], net["ub"])[::-1]
        h = [np.concatenate(p) for p in zip(front, back)]
        e = np.exp([np.tanh(v @ net["wa"] + net["ba"]) @ net["va"] for v in h])
        best = max(best, float(sum(a * v for a, v in zip(e / e.sum(), h)) @ net["w"] + net["b"]))
    return float(sig(best))


@pytest.mark.parametrize("module,plain", [(quality, plain_quality), (toxicity, plain_toxicity)])
def test_scores_against_a_plain_forward_pass(spark, tables, odd_docs, module, plain):
    texts = [r.text.encode() for r in tables[0].filter("n_chars < 3000").limit(40).collect()]
    model = module.fit(texts, [i % 2 for i in range(40)])
    odd = [(r.text or "").encode() for r in odd_docs.filter("n_chars < 3100 or text is null").collect()]
    got = module.Scorer(model)(texts + odd)
    assert np.allclose(got, [plain(model, t) for t in texts + odd], atol=1e-3)


def test_toxicity_has_nothing_to_learn_from_one_class(spark, odd_docs):
    for y in (0, 1):
        labels = spark.createDataFrame([(100 + i, y) for i in range(40)], "doc_id long, toxic int")
        assert {r.score for r in toxicity.classify(odd_docs, labels).collect()} == {0.0}


def test_contradicting_labels_and_repeated_ids(spark):
    """An id labelled both ways says nothing; of several texts of an id the smallest is learnt from."""
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, "d"), (4, None)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (4, 1)], "doc_id long, quality int")
    got = fitting.labelled_sample(docs, labels, "quality", 10**9, -1, 100)
    assert sorted((r.text, r.y) for r in got.collect() if r.text) == [("a", 1), ("d", 0)] and got.count() == 3
