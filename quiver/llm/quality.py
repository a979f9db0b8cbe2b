"""Quality classifier: random-indexing word vectors pooled per document, and a
two-layer network with calibrated probabilities.

Every token has a sparse random index vector drawn from its hash. A token's word
vector is the sum of the index vectors around it, over the fitting sample, so tokens used alike
get vectors alike. Tokens are lower-cased words and marks of how a word is
written (capitals, runs of symbols, digits, the same word again), the latter so
that a word never seen before still says something. A document is pooled as the mean of its
vectors and the elementwise extremes of the means of its segments. The network is trained in
numpy on three quarters of the sample; the rest sets the temperature."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from quiver.llm.fitting import fit_in_one_task, labelled_sample, passing, scored

BUCKETS, DIM, NONZERO, REACH, SEGMENT, HIDDEN = 1 << 14, 40, 4, 2, 64, 24
FIT_ROWS, BLOCK_WORDS = 4000, 1 << 18
#: Bytes of the table of words, and what an entry takes besides its word (dictionary slot, tokens, summed vector).
TABLE_BYTES, ENTRY_BYTES = 56_000_000, 450
SYMBOLS = re.compile(rb"([!-/:-@\[-`{-~])\1*")
REPEATED, DIGIT, CAPITALS, MARKS = 1, 2, 3, 4
#: Tokens of a segment or text that count as neutral, so that a few tokens alone don't make an extreme.
PRIOR = 24


def bucket(token: bytes) -> int:
    return MARKS + xxhash.xxh3_64_intdigest(token) % (BUCKETS - MARKS)


def tokens(word: bytes) -> list[int]:
    """Buckets of a white-space delimited word: its letters in lower case, and marks of its writing."""
    if word.isalpha():  # ASCII letters alone
        return [bucket(b"w" + word.lower()), CAPITALS] if len(word) > 1 and word.isupper() else [bucket(b"w" + word.lower())]
    out = [bucket(b"s" + m.group(1) + b"%d" % min(3, len(m.group()))) for m in SYMBOLS.finditer(word)]
    core = SYMBOLS.sub(b"", word)
    if not core:
        return out
    if any(48 <= c <= 57 for c in core):
        out.append(DIGIT)
    text = core.decode("utf-8", "replace")
    if len(text) > 1 and text.isupper():
        out.append(CAPITALS)
    return [bucket(b"w" + text.lower().encode()), *out]


class Lexicon:
    """Numbers the distinct words of a task; ``rows`` of each number's tokens. Emptied at a bound between documents."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.tokens: list[list[int]] = []
        self.size = 0

    def encode(self, text: bytes) -> np.ndarray:
        words = text.split()
        number = self.number
        for w in set(words):
            if w not in number:
                number[w] = len(number)
                self.tokens.append(tokens(w))
                self.size += ENTRY_BYTES + len(w)
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """A few dimensions per bucket, and +1 or -1 for each, from a fixed seed."""
    rng = np.random.default_rng(71)
    return rng.integers(0, DIM, (BUCKETS, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


def token_stream(lex: Lexicon, words: np.ndarray) -> np.ndarray:
    out: list[int] = []
    last = -1
    for w in words.tolist():
        out += lex.tokens[w]
        if w == last:
            out.append(REPEATED)
        last = w
    return np.array(out, np.int64)


def word_vectors(streams: list[np.ndarray]) -> np.ndarray:
    dims, signs = index_vectors()

    def summed(at: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Sums, per token ``at``, of the index vectors of the tokens ``near``."""
        return np.bincount((at[:, None] * DIM + dims[near]).ravel(), weights=signs[near].ravel(), minlength=BUCKETS * DIM)

    out, seen = np.zeros(BUCKETS * DIM), np.zeros(BUCKETS, bool)
    for s in streams:
        seen[s] = True
    flat = np.concatenate([np.concatenate([s, np.full(REACH, -1)]) for s in streams])  # -1 keeps documents apart
    for at in range(0, len(flat), BLOCK_WORDS):
        here = flat[at:at + BLOCK_WORDS + REACH]
        for d in range(1, REACH + 1):
            a, b = here[:BLOCK_WORDS][:len(here) - d], here[d:d + BLOCK_WORDS]
            both = (a >= 0) & (b >= 0)
            out += summed(b[both], a[both]) + summed(a[both], b[both])
    out = out.reshape(BUCKETS, DIM)
    own = np.zeros_like(out)
    np.add.at(own, (np.arange(BUCKETS)[:, None], dims), signs)
    # A token's own index vector keeps tokens apart that stand in like places.
    out = out / np.maximum(1e-6, np.linalg.norm(out, axis=1, keepdims=True)) + own / 2
    out[~seen] = 0
    return out.astype(np.float32)


class Pooler:
    """Pooled features of texts, with each distinct word's summed vector computed once as long as the table holds it."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.reset()

    def reset(self) -> None:
        self.lex, self.sums = Lexicon(), np.zeros((1024, DIM + 1), np.float32)
        self.done = 0

    def grow(self) -> None:
        n = len(self.lex.tokens)
        if n > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros((max(n, 2 * len(self.sums)) - len(self.sums), DIM + 1), np.float32)])
        new = self.lex.tokens[self.done:]
        count = np.array([len(t) for t in new])
        flat = np.array([x for t in new for x in t], np.int64)
        if len(flat):
            some = np.nonzero(count)[0]
            starts = np.cumsum(count)[some] - count[some]
            self.sums[self.done + some, :DIM] = np.add.reduceat(self.vectors[flat], starts, axis=0)
            self.sums[self.done + some, DIM] = count[some]
        self.done = n

    def features(self, text: bytes) -> np.ndarray:
        if self.lex.size > TABLE_BYTES:
            self.reset()
        words = self.lex.encode(text)
        if not len(words):
            return np.zeros(3 * DIM + 1, np.float32)
        self.grow()
        parts = []
        for at in range(0, len(words), BLOCK_WORDS):  # a very long text goes in blocks of whole segments
            w = words[at:at + BLOCK_WORDS]
            part = np.add.reduceat(self.sums[w], np.arange(0, len(w), SEGMENT), axis=0)
            again = w == np.concatenate([words[at - 1:at] if at else [-1], w[:-1]])
            reps = np.add.reduceat(again.astype(np.float32), np.arange(0, len(w), SEGMENT))
            part[:, :DIM] += reps[:, None] * self.vectors[REPEATED]
            part[:, DIM] += reps
            parts.append(part)
        segs = np.concatenate(parts)
        means = segs[:, :DIM] / (PRIOR + segs[:, DIM:])
        total = segs.sum(axis=0)
        return np.concatenate([total[:DIM] / (PRIOR + total[DIM]), means.max(axis=0), means.min(axis=0), [np.log1p(len(words)) / 10]]).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def network(p: dict, x: np.ndarray) -> np.ndarray:
    h = np.tanh(((x - p["mean"]) / p["scale"]) @ p["w1"] + p["b1"])
    return h @ p["w2"] + p["b2"]


def train(x: np.ndarray, y: np.ndarray, epochs: int = 120, rate: float = 0.01, decay: float = 1e-3) -> dict:
    """Two layers, Adam, cross entropy with both classes weighing the same."""
    rng = np.random.default_rng(5)
    p = {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 1e-3}
    net = {"w1": rng.normal(size=(x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), "b1": np.zeros(HIDDEN),
           "w2": rng.normal(size=HIDDEN) / np.sqrt(HIDDEN), "b2": np.zeros(())}
    z = (x - p["mean"]) / p["scale"]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    m, v, t = {k: np.zeros_like(a) for k, a in net.items()}, {k: np.zeros_like(a) for k, a in net.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 128):
            i = order[at:at + 128]
            h = np.tanh(z[i] @ net["w1"] + net["b1"])
            off = (sigmoid(h @ net["w2"] + net["b2"]) - y[i]) * weight[i] / len(i)
            back = off[:, None] * net["w2"] * (1 - h * h)
            grad = {"w1": z[i].T @ back + decay * net["w1"], "b1": back.sum(axis=0), "w2": h.T @ off + decay * net["w2"], "b2": off.sum()}
            t += 1
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net[k] = net[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return p | net


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits under which held-back labels are likeliest."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [float(np.mean(np.logaddexp(0, np.where(y == 1, -1, 1) * logits / t))) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(texts: list[bytes], y: list[int]) -> dict:
    lex = Lexicon()
    vectors = word_vectors([token_stream(lex, lex.encode(t)) for t in texts])
    pooler = Pooler(vectors)
    x, labels = np.stack([pooler.features(t) for t in texts]).astype(np.float64), np.array(y)
    back = np.arange(len(labels)) % 4 == 3  # the sample is in hash order
    if len(set(labels[~back])) < 2:
        back[:] = False
    p = train(x[~back], labels[~back])
    p["temperature"] = temperature(network(p, x[back]), labels[back])
    return {"vectors": vectors, "net": p}


class Scorer:
    """Scores of texts under a model. Null and empty texts, and texts of white space, score 0: there is
    nothing of quality in them. Without any labels to learn from, every other text scores 0.5."""

    def __init__(self, model: dict | None):
        self.model, self.pooler = model, Pooler(model["vectors"]) if model else None

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        some = np.array([bool(t.strip()) for t in texts], bool)
        if not self.model or not len(texts):
            return np.where(some, 0.5, 0.0)
        x = np.stack([self.pooler.features(t) for t in texts]).astype(np.float64)
        return np.where(some, sigmoid(network(self.model["net"], x) / self.model["net"]["temperature"]), 0.0)


THRESHOLD = 0.7


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int, folds: int, held: int) -> dict | None:
    return fit_in_one_task(labelled_sample(docs, labels, "quality", folds, held, fit_rows), fit)


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    return scored(docs, Scorer, learn(docs, labels, fit_rows, folds, held), THRESHOLD, folds, held)


def accepted(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, folds: int = 4, held: int = 2) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns."""
    return passing(docs, Scorer, learn(docs, labels, fit_rows, folds, held), lambda s: s >= THRESHOLD)
