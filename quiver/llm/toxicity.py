"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A word enters as its own vector (words frequent enough in the sample) next to the mean of
the vectors of its character trigrams, so that words never seen count by their spelling. Forward and
backward gated units read a window of words; attention pools their outputs into one logit. A
text is read in all its overlapping windows and scores as its most toxic one. Only texts are labelled,
so in training each text is represented by its highest window of that epoch. Word and trigram vectors start from how much
likelier they are in toxic texts. All training is numpy, in one task, on a bounded sample."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from quiver.llm.fitting import fit_in_one_task, labelled_sample, passing, scored

WINDOW, STRIDE, HIDDEN, ATTENTION = 32, 16, 8, 8
WORD_DIM, CHAR_DIM, GRAMS, VOCABULARY, LEAST_TEXTS = 6, 6, 1 << 12, 20_000, 10
STEPS, STEP_TEXTS, LEAST_EPOCHS, MOST_EPOCHS = 300, 64, 7, 50
FIT_ROWS, BATCH_WINDOWS = 4000, 2048
#: Bytes of the table of words, and what an entry takes besides its word (dictionary slot, gate inputs and room for growth).
TABLE_BYTES, ENTRY_BYTES = 56_000_000, 450
EDGES = re.compile(rb"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$")


def normal(word: bytes) -> bytes:
    """Lower case (A-Z), without symbols at either end."""
    return EDGES.sub(b"", word.lower())


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character trigrams (of UTF-8) of words between end marks, one after another, and their number per word."""
    marked = [b"<" + w + b">" if w else b"<>>" for w in words]
    size = np.array([len(w) for w in marked], np.int64)
    c = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (c[:-2] << 16 | c[1:-1] << 8 | c[2:]) * np.uint32(2654435761)
    inside = np.ones(len(c), bool)
    ends = np.cumsum(size)
    inside[ends - 1] = inside[ends - 2] = False
    return (code >> np.uint32(20)).astype(np.int64)[inside[:-2]], size - 2


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def windows(n: int) -> np.ndarray:
    """First words of all windows of a text of n words: every stride, until the last word is in one."""
    return np.arange(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


class Unit:
    """One direction of gated units over inputs that are already projected to the three gates."""

    @staticmethod
    def forward(px: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool = False):
        b, t, _ = px.shape
        h, out, cache = np.zeros((b, HIDDEN), px.dtype), np.empty((t, b, HIDDEN), px.dtype), []
        for k in range(t):
            hu = h @ u
            gates = sigmoid(px[:, k, :2 * HIDDEN] + hu[:, :2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = np.tanh(px[:, k, 2 * HIDDEN:] + r * hu[:, 2 * HIDDEN:])
            z = 1 - (1 - z) * mask[:, k, None]  # a pad leaves the state as it is
            new = z * h + (1 - z) * n
            if keep:
                cache.append((h, hu, gates[:, :HIDDEN], r, n))
            out[k] = h = new
        return out, cache

    @staticmethod
    def backward(dout: np.ndarray, cache: list, mask: np.ndarray, u: np.ndarray):
        t, b, _ = dout.shape
        dpx, du, dh = np.zeros((b, t, 3 * HIDDEN)), np.zeros_like(u), np.zeros((b, HIDDEN))
        for k in range(t - 1, -1, -1):
            h, hu, z, r, n = cache[k]
            m = mask[:, k, None]
            dh = dh + dout[k]
            dz, dn = dh * (h - n) * m, dh * (1 - z) * m
            da = dn * (1 - n * n)
            dhu = np.concatenate([dz * z * (1 - z), da * hu[:, 2 * HIDDEN:] * r * (1 - r), da * r], axis=1)
            dpx[:, k] = np.concatenate([dhu[:, :2 * HIDDEN], da], axis=1)
            du += h.T @ dhu
            dh = dh * (1 - (1 - z) * m) + dhu @ u.T
        return dpx, du


def forward(p: dict, px: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows whose gate inputs (both directions side by side) are ``px``."""
    g = 3 * HIDDEN
    hf, cf = Unit.forward(px[:, :, :g], mask, p["uf"], keep)
    hb, cb = Unit.forward(px[:, ::-1, g:], mask[:, ::-1], p["ub"], keep)
    h = np.concatenate([hf, hb[::-1]], axis=2)
    a = np.tanh(h @ p["wa"] + p["ba"])
    e = np.where(mask.T > 0, a @ p["va"], -1e9)
    e = np.exp(e - e.max(axis=0)) * mask.T
    alpha = e / np.maximum(1e-9, e.sum(axis=0))
    pooled = (alpha[:, :, None] * h).sum(axis=0)
    return pooled @ p["w"] + p["b"], (h, a, alpha, pooled, cf, cb)


def gradients(p: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Gradients of the weighted cross entropy, and of the inputs x (window, step, input)."""
    px = x @ p["wx"] + p["bx"]
    logit, (h, a, alpha, pooled, cf, cb) = forward(p, px, mask, keep=True)
    d = (sigmoid(logit) - y) * weight
    g = {"w": pooled.T @ d, "b": d.sum()}
    dpool = d[:, None] * p["w"]
    dalpha = (h * dpool).sum(axis=2)
    de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
    g["va"] = (a * de[:, :, None]).sum(axis=(0, 1))
    da = de[:, :, None] * p["va"] * (1 - a * a)
    g["wa"], g["ba"] = np.tensordot(h, da, ((0, 1), (0, 1))), da.sum(axis=(0, 1))
    dh = alpha[:, :, None] * dpool + da @ p["wa"].T
    dpf, g["uf"] = Unit.backward(dh[:, :, :HIDDEN], cf, mask, p["uf"])
    dpb, g["ub"] = Unit.backward(dh[::-1, :, HIDDEN:], cb, mask[:, ::-1], p["ub"])
    dpx = np.concatenate([dpf, dpb[:, ::-1]], axis=2)
    g["wx"], g["bx"] = np.tensordot(x, dpx, ((0, 1), (0, 1))), dpx.sum(axis=(0, 1))
    return g, dpx @ p["wx"].T, logit


class Reader:
    """Numbers the distinct words of a task and holds their gate inputs; emptied at a bound between texts."""

    def __init__(self, model: dict):
        self.m = model
        self.reset()

    def reset(self) -> None:
        self.number: dict[bytes, int] = {}
        self.size = 0
        self.px = np.zeros((1024, 6 * HIDDEN), np.float32)

    def encode(self, text: bytes) -> np.ndarray:
        words = text.split()
        new = [w for w in set(words) if w not in self.number]
        if new:
            first = len(self.number)
            x = inputs(self.m, [normal(w) for w in new])
            px = (x @ self.m["net"]["wx"] + self.m["net"]["bx"]).astype(np.float32)
            need = first + len(new)
            if need > len(self.px):
                self.px = np.concatenate([self.px, np.zeros((max(need, 2 * len(self.px)) - len(self.px), 6 * HIDDEN), np.float32)])
            self.px[first:need] = px
            for i, w in enumerate(new):
                self.number[w] = first + i
                self.size += ENTRY_BYTES + len(w)
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The highest window's logit of each text; -inf without words."""
        out = np.full(len(texts), -np.inf)
        pend, owner, held = [], [], 0
        net = {k: np.asarray(v, np.float32) for k, v in self.m["net"].items()}

        def flush():
            nonlocal pend, owner, held
            if pend:
                idx, own = np.concatenate(pend), np.concatenate(owner)
                for at in range(0, len(idx), BATCH_WINDOWS):
                    part = idx[at:at + BATCH_WINDOWS]
                    mask = (part >= 0).astype(np.float32)
                    logit, _ = forward(net, self.px[np.maximum(part, 0)], mask)
                    np.maximum.at(out, own[at:at + BATCH_WINDOWS], logit)
            pend, owner, held = [], [], 0

        for i, t in enumerate(texts):
            if self.size > TABLE_BYTES:
                flush()
                self.reset()
            w = self.encode(t)
            if len(w):
                starts = windows(len(w))
                padded = np.concatenate([w, np.full(WINDOW, -1)])
                pend.append(padded[starts[:, None] + np.arange(WINDOW)])
                owner.append(np.full(len(starts), i))
                held += len(starts)
            if held >= BATCH_WINDOWS:
                flush()
        flush()
        return out


def inputs(m: dict, words: list[bytes]) -> np.ndarray:
    """Word vector next to the mean of the trigram vectors."""
    x = np.zeros((len(words), WORD_DIM + CHAR_DIM))
    x[:, :WORD_DIM] = m["word"][[m["vocabulary"].get(w, 0) for w in words]]
    flat, count = grams(words)
    x[:, WORD_DIM:] = np.add.reduceat(m["char"][flat], np.cumsum(count) - count, axis=0) / count[:, None]
    return x


def odds(pos: Counter, neg: Counter, keys: list, n_pos: int, n_neg: int, prior: float) -> np.ndarray:
    """How much likelier a key is in a toxic text, as a logarithm; rare keys are drawn to 0 by ``prior`` texts of either kind."""
    a, b = np.array([pos[k] for k in keys]) / n_pos, np.array([neg[k] for k in keys]) / n_neg
    return np.log(a + prior / n_pos) - np.log(b + prior / n_pos)


def start(texts: list[list[bytes]], y: np.ndarray) -> dict:
    rng = np.random.default_rng(9)
    seen = {0: Counter(), 1: Counter()}
    gram_seen = {0: Counter(), 1: Counter()}
    for words, label in zip(texts, y):
        own = set(words)
        seen[int(label)].update(own)
    total = seen[0] + seen[1]
    least = min(LEAST_TEXTS, max(2, len(texts) // 150))  # a small sample has to make do with rarer words
    vocab = [w for w, n in sorted(total.items(), key=lambda x: (-x[1], x[0])) if n >= least and w][:VOCABULARY]
    flat, count = grams(vocab)
    for w, own in zip(vocab, np.split(flat, np.cumsum(count)[:-1])):
        for g in set(own.tolist()):
            gram_seen[0][g] += seen[0][w]
            gram_seen[1][g] += seen[1][w]
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    word = rng.normal(size=(len(vocab) + 1, WORD_DIM)) * 0.05
    word[1:, 0] = np.clip(odds(seen[1], seen[0], vocab, n1, n0, 5.0), -4, 4) / 2
    word[0] = 0
    char = rng.normal(size=(GRAMS, CHAR_DIM)) * 0.05
    char[:, 0] = np.clip(odds(gram_seen[1], gram_seen[0], list(range(GRAMS)), sum(gram_seen[1].values()) or 1, sum(gram_seen[0].values()) or 1, 50.0), -3, 3) / 3
    d = WORD_DIM + CHAR_DIM
    net = {"wx": rng.normal(size=(d, 6 * HIDDEN)) / np.sqrt(d), "bx": np.zeros(6 * HIDDEN),
           "uf": rng.normal(size=(HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN), "ub": rng.normal(size=(HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN),
           "wa": rng.normal(size=(2 * HIDDEN, ATTENTION)) / np.sqrt(2 * HIDDEN), "ba": np.zeros(ATTENTION),
           "va": rng.normal(size=ATTENTION), "w": rng.normal(size=2 * HIDDEN) / np.sqrt(HIDDEN), "b": np.zeros(())}
    return {"vocabulary": {w: i + 1 for i, w in enumerate(vocab)}, "word": word, "char": char, "net": net}


def fit(texts: list[bytes], labels: list[int], epochs: int | None = None, rate: float = 0.01) -> dict | None:
    if len(set(labels)) < 2 or not any(t.split() for t in texts):
        return None
    y = np.array(labels, float)
    epochs = epochs or int(np.clip(STEPS * STEP_TEXTS // max(1, len(texts)), LEAST_EPOCHS, MOST_EPOCHS))
    words = [[normal(w) for w in t.split()] for t in texts]
    m = start(words, y)
    # Distinct words of the sample, their number in the vocabulary and their trigrams, once.
    number: dict[bytes, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in ws], np.int64) for ws in words]
    distinct = list(number)
    del words, number
    vocab = np.array([m["vocabulary"].get(w, 0) for w in distinct], np.int64)
    flat, count = grams(distinct)
    first = np.cumsum(count) - count
    has = [i for i, w in enumerate(ids) if len(w)]
    wins, owner = [], []
    for i in has:
        s = windows(len(ids[i]))
        wins.append(np.concatenate([ids[i], np.full(WINDOW, -1)])[s[:, None] + np.arange(WINDOW)])
        owner.append(np.full(len(s), i))
    wins, owner = np.concatenate(wins).astype(np.int32), np.concatenate(owner)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
    word0 = m["word"].copy()
    params = m["net"] | {"word": m["word"], "char": m["char"]}
    mom, var, t = {k: np.zeros_like(v) for k, v in params.items()}, {k: np.zeros_like(v) for k, v in params.items()}, 0
    rng = np.random.default_rng(2)

    def all_inputs() -> np.ndarray:
        return np.concatenate([m["word"][vocab], np.add.reduceat(m["char"][flat], first, axis=0) / count[:, None]], axis=1)

    for epoch in range(epochs):
        px = (all_inputs() @ m["net"]["wx"] + m["net"]["bx"]).astype(np.float32)
        net32 = {k: np.asarray(v, np.float32) for k, v in m["net"].items()}
        logit = np.concatenate([forward(net32, px[np.maximum(part, 0)], (part >= 0).astype(np.float32))[0]
                                for part in np.array_split(wins, max(1, len(wins) // BATCH_WINDOWS))])
        order = np.lexsort((-logit, owner))
        top = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
        hard = np.nonzero((y[owner] == 0) & (logit > 0))[0]  # clean windows that look toxic
        pick = np.concatenate([top, rng.choice(hard, min(len(hard), len(top)), replace=False)]) if len(hard) else top
        rng.shuffle(pick)
        step = rate * (0.5 if epoch < epochs // 2 else 0.2)
        for at in range(0, len(pick), STEP_TEXTS):
            w = wins[pick[at:at + STEP_TEXTS]]
            own = owner[pick[at:at + STEP_TEXTS]]
            used, place = np.unique(np.maximum(w, 0), return_inverse=True)
            place = place.reshape(w.shape)
            ub = [flat[first[i]:first[i] + count[i]] for i in used]
            uc = count[used]
            uf = np.concatenate(ub)
            us = np.cumsum(uc) - uc
            xu = np.concatenate([m["word"][vocab[used]], np.add.reduceat(m["char"][uf], us, axis=0) / uc[:, None]], axis=1)
            mask = (w >= 0).astype(float)
            grad, dx, _ = gradients(m["net"], xu[place], mask, y[own], weight[own] / len(own))
            du = np.zeros_like(xu)
            np.add.at(du, place.ravel(), (dx * mask[:, :, None]).reshape(-1, dx.shape[2]))
            gw, gc = np.zeros_like(m["word"]), np.zeros_like(m["char"])
            np.add.at(gw, vocab[used], du[:, :WORD_DIM])
            gw[0] = 0  # words outside the vocabulary count by their spelling alone
            np.add.at(gc, uf, np.repeat(du[:, WORD_DIM:] / uc[:, None], uc, axis=0))
            grad |= {"word": gw + 1e-3 * (m["word"] - word0) / len(own), "char": gc + 1e-4 * m["char"]}
            t += 1
            for k, g in grad.items():
                mom[k] = 0.9 * mom[k] + 0.1 * g
                var[k] = 0.99 * var[k] + 0.01 * g * g
                new = params[k] - step * (mom[k] / (1 - 0.9**t)) / (np.sqrt(var[k] / (1 - 0.99**t)) + 1e-7)
                params[k] = new
                if k in m:
                    m[k] = new
                else:
                    m["net"][k] = new
    return m


class Scorer:
    """Scores of texts under a model. Null texts and texts without words score 0, and so does every text where the labels are missing or of
    one class only: there is no difference to learn from them."""

    def __init__(self, model: dict | None):
        self.reader = Reader(model) if model else None

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        logit = self.reader.score(texts) if self.reader else np.full(len(texts), -np.inf)
        return np.where(np.isneginf(logit), 0.0, sigmoid(logit))


THRESHOLD = 0.5


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int, folds: int, held: int) -> dict | None:
    return fit_in_one_task(labelled_sample(docs, labels, "toxic", folds, held, fit_rows), fit)


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    return scored(docs, Scorer, learn(docs, labels, fit_rows, folds, held), THRESHOLD, folds, held)


def accepted(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, folds: int = 5, held: int = 0) -> DataFrame:
    """The rows that are not toxic, with all their columns."""
    return passing(docs, Scorer, learn(docs, labels, fit_rows, folds, held), lambda s: s < THRESHOLD)
