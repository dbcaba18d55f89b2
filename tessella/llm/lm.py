"""Scores of texts under a log-bilinear language model trained by noise-contrastive estimation.

Tokens: the words of a text (split at ASCII white space, A-Z lower-cased), then one end. Each token has a class: the SHORT most
frequent tokens are classes of their own, and any other word is in one of SUFFIXES classes by a hash of its last two bytes.
The network predicts the class from the last CONTEXT classes: the context's vectors, each through a
matrix of its place, add up to a prediction, and its products with the class vectors, plus biases, are the
logits. It is fitted in numpy against noise from the classes' corpus frequencies; scoring normalises over all classes, once for each
context. Within a class a word has (c + 1) / (n + v + 1), with c its count, n and v the class's tokens and
distinct tokens in the training rows; the 1 in the divisor is for words that aren't there.

Counts are exact and cover all rows. The TOP most frequent tokens are broadcast (16 bytes each). All others go through a join by
token, in which no token is frequent. The network starts from a fit on SAMPLE training documents, those of the lowest hashes. From there each
partition makes one pass over all its training rows, and the parameters are averaged; so they depend on the partitions a little.

Defined results: a null or empty text is the end alone. Rows without doc_id are for training. Repeated rows count
as often as they occur and each get a row. Very long texts are whole. Other columns aren't read. Without training rows the base score is 0 a token.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, added, arrow_batches, encoded, mix, slices, written

FOLDS, HELD_OUT = 7, 2
SHORT, SUFFIXES, TOP, SAMPLE = 256, 64, 1 << 18, 1500
CLASSES = SHORT + SUFFIXES
CONTEXT, DIM, NOISE, EPOCHS, BATCH, RATE = 3, 32, 128, 4, 1024, 0.05
#: The share of RATE in the pass over all rows.
LAST = 0.2
#: The hash of the end token; words have it with probability 2^-64.
END = U64(0x51ED270B7F4A7C15)
#: Local counts that a task of the counting pass holds before it passes them on.
HELD_COUNTS = 1_000_000


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, suffix classes and texts of all tokens, an end after each text."""
    words = Words(texts)
    n = len(texts)
    last = words.data[words.end - 1].astype(U64) if len(words.end) else np.zeros(0, U64)
    before = np.where(words.end - words.start > 1, words.data[np.maximum(words.end - 2, 0)], 0).astype(U64) if len(words.end) else last
    suffix = (mix(last << U64(8) | before) % U64(SUFFIXES)).astype(np.int16)
    place = np.arange(len(words.hash)) + words.text  # an end for each earlier text
    h, s = np.full(len(words.hash) + n, END), np.zeros(len(words.hash) + n, np.int16)
    of = np.zeros(len(h), np.int64)
    h[place], s[place], of[place] = words.hash, suffix, words.text
    ends = np.cumsum(words.counts(n) + 1) - 1
    of[ends] = np.arange(n)
    return h, s, of


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS, F.lit(0)) == HELD_OUT


def counts(documents: DataFrame) -> DataFrame:
    """token (hash), suffix, n (all rows) and c (training rows) of each distinct token."""
    arrow_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def merged() -> tuple:
            h = np.concatenate([x[0] for x in held])
            u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            return u, np.concatenate([x[1] for x in held])[first], *(np.bincount(inverse, np.concatenate([x[k] for x in held]), len(u)).astype(np.int64) for k in (2, 3))

        def flush() -> pa.RecordBatch:
            u, s, n, c = merged()
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(s), pa.array(n), pa.array(c)], names=["token", "suffix", "n", "c"])

        for batch in batches:
            train = ~batch.column("out").to_numpy(zero_copy_only=False)
            texts = encoded(batch.column("text"))
            for a, b in slices(texts):
                h, s, of = tokens(texts[a:b])
                u, first, inverse, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                held.append((u, s[first], n, np.bincount(inverse, train[a:b][of], len(u))))
                if len(held) > 1 and sum(len(x[0]) for x in held) > HELD_COUNTS:
                    held = [merged()]
                    if len(held[0][0]) > HELD_COUNTS // 2:
                        yield flush()
                        held = []
        if held:
            yield flush()

    local = documents.select("text", held_out().alias("out")).mapInArrow(run, "token long, suffix short, n long, c long")
    return local.groupBy("token").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("c").alias("c"))


class Corpus:
    """Totals, the most frequent tokens and class counts."""

    def __init__(self, table: DataFrame):
        total = table.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("N"), F.count(F.when(F.col("c") > 0, 1)).alias("V")).first()
        self.n, self.v = total["N"], total["V"]
        # the least count whose tokens are at most TOP, from the numbers of tokens by count
        by_count = sorted(((r["n"], r["k"]) for r in table.groupBy("n").agg(F.count(F.lit(1)).alias("k")).where(f"k <= {TOP}").collect()), reverse=True)
        least, room = 1 << 62, TOP
        for n, k in by_count:
            if k > room:
                break
            least, room = n, room - k
        top = table.where(F.col("n") >= least).select("token", "suffix", "n", "c").toArrow()
        column = lambda name: top.column(name).to_numpy().astype(np.int64)
        h, n = column("token").view(np.uint64), column("n")
        short = np.lexsort((h, -n))[:SHORT]
        order = np.argsort(h)
        self.hash, self.count = h[order], column("c")[order]
        own = np.full(len(h), -1, np.int16)
        own[short] = np.arange(len(short))
        self.own = own[order]
        rest = np.zeros((2, SUFFIXES))
        for r in table.where("c > 0").groupBy("suffix").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("k")).collect():
            rest[:, r["suffix"]] = r["c"], r["k"]
        c, s = column("c")[short], column("suffix")[short]
        np.subtract.at(rest[0], s, c)
        np.subtract.at(rest[1], s, c > 0)
        self.divisor = rest.sum(0) + 1  # n + v + 1 of the suffix classes
        freq = np.concatenate((np.zeros(SHORT), rest[0])) + 1
        freq[: len(short)] += c
        self.frequency = freq / freq.sum()

    def classes(self, h: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes of tokens, and their places among the most frequent ones, -1 for others."""
        if not len(self.hash):
            return SHORT + suffix.astype(np.int64), np.full(len(h), -1)
        at = self.places(h)
        at = np.where(self.hash[at] == h, at, -1)
        own = np.where(at >= 0, self.own[at], -1)
        return np.where(own >= 0, own, SHORT + suffix.astype(np.int64)), at

    def places(self, h: np.ndarray) -> np.ndarray:
        """Where each hash is or would be in the sorted ones, at most at the last: a step to the first with its upper bits, and on from there."""
        if self._first is None:
            bits = min(len(self.hash).bit_length() + 2, 24)
            self._shift = U64(64 - bits)
            upper = np.bincount((self.hash >> self._shift).astype(np.int64), minlength=1 << bits)
            self._first = np.minimum(np.cumsum(upper) - upper, len(self.hash) - 1).astype(np.int32)
        at = self._first[(h >> self._shift).view(np.int64)]
        late = np.flatnonzero(self.hash[at] < h)
        while len(late):
            late = late[at[late] < len(self.hash) - 1]
            at[late] += 1
            late = late[self.hash[at[late]] < h[late]]
        return at

    _first = _shift = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_first", "_shift")}


def contexts(ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The CONTEXT classes before each token, nearest first; CLASSES stands for what is before a text."""
    out = np.full((len(ids), CONTEXT), CLASSES, np.int64)
    for k in range(1, CONTEXT + 1):
        inside = of[k:] == of[:-k]
        out[k:, k - 1][inside] = ids[:-k][inside]
    return out


def summed(of: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows, of an even width, of each of n classes. Numbers are added in pairs, as complex ones, which takes half the steps."""
    out = np.zeros((n, rows.shape[1] // 2), np.complex64)
    places = np.take(np.arange(out.size).reshape(out.shape), of, axis=0)
    np.add.at(out.reshape(-1), places.reshape(-1), np.ascontiguousarray(rows, np.float32).reshape(-1).view(np.complex64))
    return out.view(np.float32)


class LogBilinear:
    """The network; its parameters are one array, `flat`: r (context vectors), q (class vectors, each with its bias behind it) and a matrix for each place."""

    def __init__(self, frequency: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        r, q = rng.normal(0, 0.1, (CLASSES + 1, DIM)), rng.normal(0, 0.1, (CLASSES, DIM))
        m = [np.eye(DIM) * 0.5 + rng.normal(0, 0.02, (DIM, DIM)) for _ in range(CONTEXT)]
        self.noise = frequency
        self.flat = np.concatenate([x.ravel() for x in (r, np.column_stack((q, np.log(frequency))), *m)]).astype(np.float32)
        self.squares = np.full_like(self.flat, 1e-3)

    @staticmethod
    def parts(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """r, q and the matrices as views of an array of all parameters."""
        a, b = (CLASSES + 1) * DIM, (CLASSES + 1) * DIM + CLASSES * (DIM + 1)
        return flat[:a].reshape(CLASSES + 1, DIM), flat[a:b].reshape(CLASSES, DIM + 1), flat[b:].reshape(CONTEXT, DIM, DIM)

    def predictions(self, context: np.ndarray) -> np.ndarray:
        """The context's sum, from tables of each place's products, and 1 behind it, for the bias."""
        r, _, m = self.parts(self.flat)
        out = np.ones((len(context), DIM + 1), np.float32)
        total = np.take(r @ m[0], context[:, 0], axis=0)
        for k in range(1, CONTEXT):
            total += np.take(r @ m[k], context[:, k], axis=0)
        out[:, :DIM] = total
        return out

    def fit(self, ids: np.ndarray, context: np.ndarray, seed: int = 4) -> LogBilinear:
        """EPOCHS passes over a sample."""
        rng = np.random.default_rng(seed)
        for epoch in range(EPOCHS):
            self.step_through(ids, context, RATE * (1 - 0.8 * epoch / EPOCHS), rng)
        return self

    def step_through(self, ids: np.ndarray, context: np.ndarray, rate: float, rng: np.random.Generator) -> None:
        """One pass of noise-contrastive estimation with noise that a batch shares, by Adagrad."""
        r, q, m = self.parts(self.flat)
        gradient = np.empty_like(self.flat)
        g_r, g_q, g_m = self.parts(gradient)
        log_noise = np.log(self.noise * NOISE).astype(np.float32)
        cumulated = np.cumsum(self.noise)
        order = rng.permutation(len(ids))
        for s in range(0, len(ids), BATCH):
            pick = order[s : s + BATCH]
            y, x = ids[pick], np.take(context, pick, axis=0)
            noise = np.minimum(np.searchsorted(cumulated, rng.random(NOISE), side="right"), CLASSES - 1)
            p = self.predictions(x)
            q_y, q_noise = np.take(q, y, axis=0), q[noise]
            good = np.einsum("ij,ij->i", p, q_y) - log_noise[y]
            q_noise[:, DIM] -= log_noise[noise]
            # the logistic function, from products with the opposite sign; beyond the range of exp it is 0
            bad = p @ -q_noise.T
            with np.errstate(over="ignore"):
                np.exp(bad, out=bad)
                d_good = (1 / (1 + np.exp(-good)) - 1)[:, None]
            bad += 1
            d_bad = np.reciprocal(bad, out=bad)
            d_p = d_bad @ q_noise[:, :DIM]
            d_p += d_good * q_y[:, :DIM]
            d_noise = d_bad.T @ p
            g_q[:, :DIM] = summed(np.append(y, noise), np.concatenate((d_good * p[:, :DIM], d_noise[:, :DIM])), CLASSES)
            g_q[:, DIM] = np.bincount(y, d_good[:, 0], CLASSES) + np.bincount(noise, d_noise[:, DIM], CLASSES)
            g_r.fill(0)
            for k in range(CONTEXT):
                by_class = summed(x[:, k], d_p, CLASSES + 1)
                g_r += by_class @ m[k].T
                np.matmul(r.T, by_class, out=g_m[k])
            gradient /= np.float32(len(y))
            self.squares += gradient * gradient
            gradient *= np.float32(rate)
            gradient /= np.sqrt(self.squares)
            self.flat -= gradient

    def log10(self, ids: np.ndarray, context: np.ndarray, batch: int = 512) -> np.ndarray:
        """Normalised log10 probabilities of classes after their contexts.

        A logit is a sum over the places, so its exponential is a product of three tables' numbers. The norm is worked out once for each context.
        """
        r, q, m = self.parts(self.flat)
        tables = [r @ m[k] @ q[:, :DIM].T for k in range(CONTEXT)]
        tables[0] += q[:, DIM]
        own = sum(t[context[:, k], ids] for k, t in enumerate(tables))
        top = [t.max(1) for t in tables]
        powers = [np.exp(t - most[:, None]) for t, most in zip(tables, top, strict=True)]
        place = (CLASSES + 1) ** np.arange(CONTEXT)[::-1]
        codes, of = np.unique(context @ place, return_inverse=True)
        contexts = codes[:, None] // place % (CLASSES + 1)
        norm = np.empty(len(codes), np.float32)
        for s in range(0, len(codes), batch):
            x = contexts[s : s + batch]
            product = np.take(powers[0], x[:, 0], axis=0)
            for k in range(1, CONTEXT - 1):
                product *= np.take(powers[k], x[:, k], axis=0)
            total = np.einsum("ij,ij->i", product, np.take(powers[-1], x[:, -1], axis=0))
            most = sum(t[x[:, k]] for k, t in enumerate(top))
            small = np.flatnonzero(total < 1e-20)  # the places' largest logits are far apart
            if len(small):
                logits = sum(t[x[small, k]] for k, t in enumerate(tables))
                most[small] = logits.max(1)
                total[small] = np.exp(logits - most[small, None]).sum(1)
            norm[s : s + batch] = most + np.log(total)
        return (own - norm[of]) / np.float32(np.log(10))


def train(documents: DataFrame, corpus: Corpus, most: int = SAMPLE) -> LogBilinear:
    """Fits the network: first on at most `most` training documents, those whose ids have the lowest hashes, and from there on all of them."""
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    own = documents.select("doc_id", "text").where(~held_out())
    ids = own.select("doc_id").orderBy(*order).limit(most).distinct()
    rows = sorted((r["doc_id"], r["text"] or "") for r in own.join(F.broadcast(ids), "doc_id").limit(2 * most).collect())
    model = LogBilinear(corpus.frequency)
    if rows:
        h, s, of = tokens([t.encode() for _, t in rows])
        classes, _ = corpus.classes(h, s)
        model.fit(classes, contexts(classes, of))
    return averaged(own, corpus, model)


def averaged(documents: DataFrame, corpus: Corpus, start: LogBilinear) -> LogBilinear:
    """The mean, by tokens, of what one pass over each partition makes of the model; every document has its part in it."""
    arrow_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast((corpus, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, start = shared.value
        model, rng, n = copy.deepcopy(start), np.random.default_rng(5), 0
        for batch in batches:
            texts = encoded(batch.column("text"))
            for a, b in slices(texts, 1 << 20):
                h, s, of = tokens(texts[a:b])
                classes, _ = corpus.classes(h, s)
                model.step_through(classes, contexts(classes, of), RATE * LAST, rng)
                n += len(classes)
        if n:
            flat = np.append(1.0, model.flat) * n
            yield pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.float64()))], names=["sums"])

    total = added(documents.select("text").mapInArrow(run, "sums array<double>"))
    if total is None:
        return start
    model = copy.deepcopy(start)
    model.flat[:] = total[1:] / total[0]
    return model


def score(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_once (tokens that occur once in the training rows) and mean_score (by token) of each document."""
    spark = documents.sparkSession
    arrow_batches(spark)
    table = written(counts(documents))
    corpus = Corpus(table)
    shared = spark.sparkContext.broadcast((corpus, train(documents, corpus)))
    key = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, model = shared.value
        logs, divisors = np.log10(corpus.count + 1.0), np.log10(corpus.divisor)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = encoded(batch.column("text"))
            for a, b in slices(texts, 1 << 20):
                n = b - a
                h, s, of = tokens(texts[a:b])
                ids, at = corpus.classes(h, s)
                some = at >= 0
                base = np.bincount(of[some], logs[at[some]], n)
                known, once = (np.bincount(of[some], x, n) for x in (corpus.count[at[some]] > 0, corpus.count[at[some]] == 1))
                model_logs = model.log10(ids, contexts(ids, of)).astype(float)
                words = ids >= SHORT
                model_logs[words] -= divisors[ids[words] - SHORT]
                inside = words & some
                model_logs[inside] += logs[at[inside]]
                rare = pa.array(h[~some].view(np.int64))
                offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of[~some], minlength=n)))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, n), pa.array(np.arange(row, row + n)), pa.array(np.bincount(of, minlength=n)), pa.array(known.astype(np.int64)), pa.array(once.astype(np.int64)),
                    pa.array(base), pa.array(np.bincount(of, model_logs, n)), pa.ListArray.from_arrays(offsets, rare),
                ], names=["doc_id", "row", "n_tokens", "known", "once", "base", "model", "rare"])
                row += n

    scored = written(documents.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, row long, n_tokens long, known long, once long, base double, model double, rare array<long>"))
    rare = scored.select("row", F.explode("rare").alias("token")).join(table.select("token", "c"), "token")
    sums = rare.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("logs"), F.count(F.when(F.col("c") > 0, 1)).alias("more"), F.count(F.when(F.col("c") == 1, 1)).alias("more_once"))
    logs = F.coalesce("logs", F.lit(0.0))
    whole = F.col("model") + logs
    return scored.drop("rare").join(sums, "row", "left").select(
        "doc_id", held_out().alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(corpus.n).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * float(np.log10(corpus.n + corpus.v + 1))).alias("base_score"), whole.alias("score"),
        (F.col("once") + F.coalesce("more_once", F.lit(0))).alias("n_once"), (whole / F.col("n_tokens")).alias("mean_score"),
    )


def brute_force_base(documents: list[tuple]) -> list[tuple]:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) over a list of (doc_id, text), for tests."""
    import math
    import zlib
    from collections import Counter

    split = [(i, zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT, [*(t or "").encode().lower().split(), None]) for i, t in documents]
    c = Counter(w for _, out, words in split if not out for w in words)
    n, v = sum(c.values()), len(c)
    return [(i, out, len(words), sum(c[w] > 0 for w in words), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words)) for i, out, words in split]
