"""A quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text train a small network on features of whole texts: shape (lengths, kinds of characters, repetition) and words, as
the log-odds of a text's words between trusted and all texts. Its risk is the non-negative unbiased one: with a class prior p,
p R+(1) + max(0, Ru(0) - p R+(0)) under the logistic loss, so a score estimates the probability of label 1.

The prior is estimated from positives and unlabelled text alone, as the best bin does: a classifier of positives against unlabelled text is fitted on half of the
positives; over its cuts, the share of unlabelled texts above one over the share of the other half of the positives above it is at least the prior, and the least of these
ratios (with a margin for few rows) is the estimate. Labels of 0 are never read.

The unlabelled text is all documents outside the held-out fold: their word counts, their scores in the estimate of the prior, and
a pass of gradient steps over each partition, whose parameters are averaged. Only the trusted rows are bounded (POSITIVES); the pass
starts from a fit on START unlabelled documents.

Defined results: a null or empty text has the features of no words, all 0, and the score of those. Without trusted positives or without
unlabelled text every score is 1 or 0: whether there are positives. Repeated rows each count and get a row. Very long texts are whole. Ties
of the score with the cut are predicted as 1. Other columns aren't read.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, added, arrow_batches, encoded, map_texts, slices
from .labelled import remainder, training_labels

POSITIVES, START = 3000, 5000
HIDDEN, EPOCHS, BATCH, RATE = 24, 150, 256, 0.01
#: The share of RATE in the pass over all rows.
LAST = 0.1
CUT = 0.3
N_FEATURES = 25
#: Buckets of word hashes, and of scores in the estimate of the prior.
BUCKETS, BINS = 1 << 15, 1000

#: Classes of bytes that are counted: upper case, lower case, digits, line ends, other white space, sentence marks,
#: other punctuation, lead bytes of characters that are not ASCII, and their other bytes.
_CLASS = np.full(256, 6)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[10] = 0, 1, 2, 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[[33, 44, 46, 58, 59, 63]] = 5
_CLASS[192:], _CLASS[128:192] = 7, 8


def buckets(words: Words) -> np.ndarray:
    return (words.hash >> U64(20)).astype(np.int64) % BUCKETS


def presence(texts: list[bytes]) -> np.ndarray:
    """In how many of the texts each bucket of words occurs."""
    words = Words(texts)
    each = np.unique(words.text * BUCKETS + buckets(words))
    return np.bincount(each % BUCKETS, minlength=BUCKETS)


def features(texts: list[bytes], odds: np.ndarray) -> np.ndarray:
    """A row of features for each text; odds has the log-odds of each bucket of words."""
    n = len(texts)
    words = Words(texts)
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    kind = _CLASS[raw]
    at = words.offsets
    counts = np.stack([np.diff(np.concatenate(([0], np.cumsum(kind == k)))[at]) for k in range(9)], 1).astype(float)
    counts[:, 4] -= 1  # the space between texts
    chars = np.maximum(1.0, counts[:, :8].sum(1))
    n_words = words.counts(n).astype(float)
    some = np.maximum(1.0, n_words)
    size = (words.end - words.start).astype(float)
    mean = np.bincount(words.text, size, n) / some
    spread = np.sqrt(np.maximum(0, np.bincount(words.text, size**2, n) / some - mean**2))
    lone = np.bincount(words.text, size == 1, n) / some
    again = np.zeros(n)
    if len(size) > 1:
        same = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
        again = np.bincount(words.text[1:], same, n) / some
    keys, key_counts = np.unique((words.text.astype(U64) << U64(40)) | (words.hash >> U64(24)), return_counts=True)
    of = (keys >> U64(40)).astype(np.int64)
    distinct = np.bincount(of, minlength=n)
    top, sumsq = np.zeros(n), np.bincount(of, key_counts.astype(float) ** 2, n)
    np.maximum.at(top, of, key_counts)
    ends = _CLASS[raw[np.maximum(words.end - 1, 0)]] if len(size) else np.zeros(0, int)
    symbol_end = np.bincount(words.text, ends == 6, n) / some
    symbol_word = np.bincount(words.text, (size <= 3) & (ends == 6), n) / some
    upper_start = np.bincount(words.text, _CLASS[raw[words.start]] == 0, n) / some if len(size) else np.zeros(n)
    lines = counts[:, 3] + 1
    own = odds[buckets(words)]
    told = [np.bincount(words.text, v, n) / some for v in (own, own < -1, np.minimum(own, 0) ** 2)]
    x = np.column_stack([
        np.log1p(n_words), np.log1p(chars), counts[:, :8] / chars[:, None], mean / 10, spread / 10, lone, again,
        distinct / some, top / some, np.sqrt(sumsq) / some, symbol_end, symbol_word, upper_start, np.log1p(n_words / lines), np.log1p(n_words / (counts[:, 5] + 1)), *told,
    ])
    x[n_words == 0] = 0
    return x


class PUNet:
    """One hidden layer on standardised features."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, seed: int = 5):
        both = np.concatenate((positive, unlabelled))
        self.mean, self.scale = both.mean(0), both.std(0) + 1e-6
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, 0.4, (positive.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        self.shift = 0.0

    def step(self, p: np.ndarray, u: np.ndarray, prior: float | None, rate: float) -> None:
        """A step of Adam on standardised rows: of the non-negative risk under a prior, or without one of the plain loss of positives against unlabelled rows."""
        x = np.concatenate((p, u))
        k = len(p)
        h = np.tanh(x @ self.w[0] + self.w[1])
        f = np.clip(h @ self.w[2] + self.w[3], -30, 30)
        up = 1 / (1 + np.exp(-f))
        d = np.zeros(len(f))
        if prior is None:
            d[:k], d[k:] = (up[:k] - 1) / (2 * k), up[k:] / (2 * len(u))
        else:
            loss_0 = np.logaddexp(0, f)  # the logistic loss of label 0
            rest = loss_0[k:].mean() - prior * loss_0[:k].mean()
            # gradients of prior R+(1), and of the rest, which is turned round where it is negative
            sign = 1.0 if rest >= 0 else -1.0
            if sign > 0:
                d[:k] = prior * (up[:k] - 1) / k
            d[:k] -= sign * prior * up[:k] / k
            d[k:] += sign * up[k:] / len(u)
        d_h = np.outer(d, self.w[2]) * (1 - h * h)
        grads = [x.T @ d_h + 1e-4 * self.w[0], d_h.sum(0), h.T @ d + 1e-4 * self.w[2], np.array([d.sum()])]
        self.t += 1
        for w, g, m_, v_ in zip(self.w, grads, self.m, self.v, strict=True):
            m_ += 0.1 * (g - m_)
            v_ += 0.001 * (g * g - v_)
            w -= rate * (m_ / (1 - 0.9**self.t)) / (np.sqrt(v_ / (1 - 0.999**self.t)) + 1e-8)

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, epochs: int = EPOCHS, seed: int = 6) -> PUNet:
        rng = np.random.default_rng(seed)
        p, u = self.ready(positive), self.ready(unlabelled)
        steps = max(1, len(u) // BATCH)
        for epoch in range(epochs):
            p_order, u_order = np.array_split(rng.permutation(len(p)), steps), np.array_split(rng.permutation(len(u)), steps)
            for a, b in zip(p_order, u_order, strict=True):
                self.step(p[a] if len(a) else p[rng.integers(0, len(p), BATCH // 4)], u[b], prior, RATE * (1 - epoch / epochs))
        return self

    def ready(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(self.ready(x) @ self.w[0] + self.w[1])
        return 1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3] + self.shift, -30, 30)))


def all_features(texts: list[bytes], odds: np.ndarray) -> np.ndarray:
    parts = [features(texts[a:b], odds) for a, b in slices(texts, 1 << 19)]
    return np.concatenate(parts) if parts else np.zeros((0, N_FEATURES))


def best_bin(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The prior from counts of scores by bin, lowest first, of positives and unlabelled rows."""
    n_p, n_u = max(1, positive.sum()), max(1, unlabelled.sum())
    above_p, above_u = positive[::-1].cumsum()[::-1] / n_p, unlabelled[::-1].cumsum()[::-1] / n_u
    some = above_p > 0
    ratio = above_u[some] / above_p[some]
    margin = (1 + gamma) / above_p[some] * (np.sqrt(np.log(4 / delta) / (2 * n_u)) + np.sqrt(np.log(4 / delta) / (2 * n_p)))
    return float(np.clip(ratio[np.argmin(ratio + margin)], 0.01, 0.99)) if some.any() else 0.5


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


class Model:
    """The network, the log-odds of words and the prior that it is calibrated for."""

    def __init__(self, net: PUNet, odds: np.ndarray, prior: float):
        self.net, self.odds, self.prior = net, odds, prior

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return self.net.scores(all_features(texts, self.odds))


def _word_counts(own: DataFrame) -> np.ndarray | None:
    """The number of documents, and those with each bucket of words, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS), 0
        for batch in batches:
            texts = encoded(batch.column("text"))
            n += len(texts)
            for a, b in slices(texts):
                total += presence(texts[a:b])
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(([n], total))], pa.list_(pa.float64()))], names=["sums"])

    return added(own.select("text").mapInArrow(run, "sums array<double>"))


def _averaged(own: DataFrame, start: Model, positive: np.ndarray, teller: PUNet) -> tuple[PUNet, np.ndarray]:
    """The mean, by rows, of what a pass over each partition makes of the network, and the counts of the teller's scores over all rows."""
    shared = own.sparkSession.sparkContext.broadcast((start, positive, teller))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, positive, teller = shared.value
        net, rng = copy.deepcopy(start.net), np.random.default_rng(7)
        p, n, bins = net.ready(positive), 0, np.zeros(BINS)
        waiting = np.zeros((0, N_FEATURES))
        for batch in batches:
            x = all_features(encoded(batch.column("text")), start.odds)
            n += len(x)
            bins += np.bincount(np.minimum((teller.scores(x) * BINS).astype(int), BINS - 1), minlength=BINS)
            waiting = np.concatenate((waiting, x))
            while len(waiting) >= BATCH:
                net.step(p[rng.integers(0, len(p), BATCH)], net.ready(waiting[:BATCH]), start.prior, RATE * LAST)
                waiting = waiting[BATCH:]
        if n:
            if len(waiting):
                net.step(p[rng.integers(0, len(p), BATCH)], net.ready(waiting), start.prior, RATE * LAST * len(waiting) / BATCH)
            flat = np.concatenate([w.ravel() for w in net.w]) * n
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(([n], bins, flat))], pa.list_(pa.float64()))], names=["sums"])

    total = added(own.select("text").mapInArrow(run, "sums array<double>"))
    net, at = copy.deepcopy(start.net), 1 + BINS
    for w in net.w:
        w[:] = (total[at : at + w.size] / total[0]).reshape(w.shape)
        at += w.size
    return net, total[1 : 1 + BINS]


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", positives: int = POSITIVES, start: int = START) -> Model | None:
    """The model, or none without positives or unlabelled text."""
    arrow_batches(documents.sparkSession)
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    trusted = training_labels(labels, label).where("y = 1").orderBy(*order).limit(positives)
    own = documents.select("doc_id", "text").where(remainder() != 0)
    # at most `positives` and `start` ids are broadcast
    web = own.select("doc_id").orderBy(*order).limit(start).distinct()
    rows = [own.join(F.broadcast(ids.select("doc_id")), "doc_id").limit(2 * most).collect() for ids, most in ((trusted, positives), (web, start))]
    if not rows[0] or not rows[1]:
        return None
    texts = [[(r["text"] or "").encode() for r in sorted(part, key=lambda r: (r["doc_id"], r["text"] or ""))] for part in rows]
    counts = _word_counts(own)
    # thirds of the positives: for the odds of words, for the teller, and for the prior; so no text is told by its own words
    third = np.arange(len(texts[0])) % 3 if len(texts[0]) >= 6 else None
    of = lambda *k: [t for i, t in enumerate(texts[0]) if third is None or third[i] in k]
    told = of(0)
    among = sum((presence(told[a:b]) for a, b in slices(told)), np.zeros(BUCKETS))
    odds = np.log((among + 1) / (len(told) + 2)) - np.log((counts[1:] + 1) / (counts[0] + 2))
    x_fit, x_prior, x_own, x_web = (all_features(t, odds) for t in (of(1), of(2), of(1, 2), texts[1]))
    teller = PUNet(x_fit, x_web).fit(x_fit, x_web, None, EPOCHS // 3)
    tell = lambda rows: np.bincount(np.minimum((teller.scores(rows) * BINS).astype(int), BINS - 1), minlength=BINS)
    other = tell(x_prior)
    guess = best_bin(other, tell(x_web))
    first = Model(PUNet(x_own, x_web).fit(x_own, x_web, guess), odds, guess)
    net, bins = _averaged(own, first, x_own, teller)
    prior = best_bin(other, bins)
    net.shift = _logit(prior) - _logit(guess)
    return Model(net, odds, prior)


def quality(documents: DataFrame, labels: DataFrame, cut: float = CUT, positives: int = POSITIVES, start: int = START) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    model = train(documents, labels, positives=positives, start=start)
    known = float(not training_labels(labels, "quality").where("y = 1").isEmpty()) if model is None else 0.0
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(texts: list[bytes], _rows: pa.RecordBatch) -> dict:
            return {"score": np.full(len(texts), known) if shared.value is None else shared.value.scores(texts)}

        return work

    found = map_texts(documents, make, "score double", ["doc_id"])
    return found.select("doc_id", (remainder() == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
