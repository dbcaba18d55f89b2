"""A convolutional text classifier for toxicity, trained in numpy.

Words (runs of ASCII digits, letters and characters that are not ASCII; A-Z lower-cased) get the sum of hashed embeddings of the word and of its first
4, 5 and 6 bytes, so that forms of one stem are alike. Filters over 1, 2 and 3 words are max-pooled over the whole text and a
logistic unit gives the score. The first coordinate of an embedding starts at its feature's log-odds of
presence in toxic documents. The fit takes a bounded sample of labelled rows: PER_CLASS documents of each label.
Thresholds by language turn scores into decisions; the language isn't an input of a score. They come from counts over all labelled rows
that the fit didn't use, with those of all languages as a prior.

Defined results: a text without words, null or empty has the score of the bias alone. Without labels of both
classes every score is the share of toxic labels, or 0 without any. A language without labelled rows has the
threshold of all together; so has a null language, and so have all rows where there is no column lang. Repeated rows each get a row, and count as often as
they occur; a score at the threshold is rejected. Very long texts are whole. An empty table gives none. Other columns are passed by, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, U64, Words, give_back, hash_spans, map_texts, mix, slices
from .labelled import remainder, sample, training_labels

PER_CLASS = 2500
BUCKETS, DIM, FILTERS, WIDTHS, PREFIXES = 1 << 18, 8, 8, (1, 2, 3), (4, 5, 6)
EPOCHS, BATCH, RATE = 6, 64, 0.08
#: Steps at least, within 60 passes, where there are few rows.
STEPS = 400
#: Thresholds to choose from, and the rows that all languages together count as in a language's choice.
CUTS, PRIOR = np.linspace(0.05, 0.95, 91), 40


def features(words: Words) -> np.ndarray:
    """Rows of the embedding table for each word, PREFIXES and the word itself; a short word's prefix is its own."""
    size = words.end - words.start
    out = np.empty((len(size), 1 + len(PREFIXES)), np.int32)
    out[:, 0] = mix(words.hash) & U64(BUCKETS - 1)
    for i, k in enumerate(PREFIXES, 1):
        h = hash_spans(words.sums, words.start, words.start + np.minimum(size, k))
        out[:, i] = mix(h + U64(k)) & U64(BUCKETS - 1)
    return out


class TextCNN:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.e = np.zeros((BUCKETS, DIM), np.float32)
        self.e[:, 1:] = rng.normal(0, 0.01, (BUCKETS, DIM - 1))
        self.w = [rng.normal(0, 0.3, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        for w, k in zip(self.w, WIDTHS, strict=True):
            w[:, 0, :] = np.abs(w[:, 0, :]) + 0.3 / k
        self.b = [np.full(FILTERS, -0.5, np.float32) for _ in WIDTHS]
        self.v = np.full(FILTERS * len(WIDTHS), 0.1, np.float32)
        self.c = np.float32(0)
        self.shift = 0.0

    def start_at_log_odds(self, texts: list[tuple[np.ndarray, float]]) -> None:
        """Sets the first coordinate from the documents' presence counts."""
        count = np.zeros((2, BUCKETS), np.float32)
        for rows, y in texts:
            count[int(y), np.unique(rows)] += 1
        n = [max(1.0, sum(int(y) == k for _, y in texts)) for k in (0, 1)]
        odds = np.log((count[1] + 1) / (n[1] + 2)) - np.log((count[0] + 1) / (n[0] + 2))
        odds[count.sum(0) == 0] = 0
        self.e[:, 0] = odds / (1 + len(PREFIXES))

    def forward(self, rows: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, list]:
        """Pooled filters of n texts, and what the gradient needs."""
        x = self.e[rows[:, 0]]
        for i in range(1, rows.shape[1]):
            x = x + self.e[rows[:, i]]
        pooled, kept = np.zeros((n, FILTERS * len(WIDTHS)), np.float32), []
        for f, k in enumerate(WIDTHS):
            m = len(x) - k + 1
            if m <= 0:
                kept.append(None)
                continue
            z = x[:m] @ self.w[f][0]
            for j in range(1, k):
                z += x[j : m + j] @ self.w[f][j]
            z += self.b[f]
            if k > 1:
                z[text[:m] != text[k - 1 :]] = 0  # not over the end of a text
            np.maximum(z, 0, out=z)
            present, first = np.unique(text[:m], return_index=True)
            pooled[present, f * FILTERS : (f + 1) * FILTERS] = np.maximum.reduceat(z, first, axis=0)
            kept.append((z, present, first))
        return pooled, [x, kept]

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.v + self.c

    def fit(self, texts: list[bytes], y: np.ndarray, share: float, seed: int = 11) -> TextCNN:
        """Adagrad on the logistic loss over texts of both classes; `share` is that of label 1 among all labelled rows."""
        prepared = []
        for a, b in slices(texts):
            words = Words(texts[a:b], ALNUM)
            rows, at = features(words), np.searchsorted(words.text, np.arange(b - a + 1))
            prepared += [rows[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]
        self.start_at_log_odds(list(zip(prepared, y, strict=True)))
        rng = np.random.default_rng(seed)
        g_e = np.full(BUCKETS, 1e-4, np.float32)
        squares = [np.full_like(p, 1e-4) for p in (*self.w, *self.b, self.v)]
        g_c = 1e-4
        order = np.arange(len(texts))
        for _ in range(max(EPOCHS, min(60, STEPS * BATCH // max(1, len(texts))))):
            rng.shuffle(order)
            for s in range(0, len(order), BATCH):
                pick = order[s : s + BATCH]
                rows = np.concatenate([prepared[i] for i in pick])
                if not len(rows):
                    continue
                text = np.repeat(np.arange(len(pick)), [len(prepared[i]) for i in pick])
                pooled, (x, kept) = self.forward(rows, text, len(pick))
                p = 1 / (1 + np.exp(-np.clip(self.logits(pooled), -30, 30)))
                d = ((p - y[pick]) / len(pick)).astype(np.float32)
                d_pooled = d[:, None] * self.v
                grads_w, grads_b = [], []
                d_x = {}
                for f, k in enumerate(WIDTHS):
                    g_w, g_b = np.zeros_like(self.w[f]), np.zeros_like(self.b[f])
                    if kept[f] is not None:
                        z, present, first = kept[f]
                        last = np.append(first[1:], len(z))
                        for t, a, e in zip(present, first, last, strict=True):
                            top = a + np.argmax(z[a:e], axis=0)
                            g = d_pooled[t, f * FILTERS : (f + 1) * FILTERS] * (z[top, np.arange(FILTERS)] > 0)
                            g_b += g
                            for q in np.flatnonzero(g):
                                i = int(top[q])
                                g_w[:, :, q] += g[q] * x[i : i + k]
                                for j in range(k):
                                    d_x[i + j] = d_x.get(i + j, 0) + g[q] * self.w[f][j][:, q]
                    grads_w.append(g_w)
                    grads_b.append(g_b)
                for p_, g, sq in zip((*self.w, *self.b, self.v), (*grads_w, *grads_b, d @ pooled), squares, strict=True):
                    sq += g * g
                    p_ -= RATE * g / np.sqrt(sq)
                g_c += float(d.sum()) ** 2
                self.c -= np.float32(RATE * d.sum() / np.sqrt(g_c))
                if d_x:
                    at = np.fromiter(d_x, np.int64, len(d_x))
                    g = np.stack([d_x[i] for i in at.tolist()])
                    for column in rows[at].T:
                        np.add.at(g_e, column, (g * g).mean(1))
                        np.add.at(self.e, column, -RATE * g / np.sqrt(g_e[column])[:, None])
        seen = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        share = float(np.clip(share, 1e-3, 1 - 1e-3))
        self.shift = np.log(share / (1 - share)) - np.log(seen / (1 - seen))
        return self

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        for a, b in slices(texts, 1 << 18):
            words = Words(texts[a:b], ALNUM)
            pooled, _ = self.forward(features(words), words.text, b - a) if len(words.start) else (np.zeros((b - a, len(self.v)), np.float32), None)
            out[a:b] = 1 / (1 + np.exp(-np.clip(self.logits(pooled) + self.shift, -30, 30)))
        return out


class Constant:
    """Where labels of one class are missing."""

    def __init__(self, value: float):
        self.value = value

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.value)


def _with_lang(documents: DataFrame) -> DataFrame:
    """The documents, with a null language if they have no such column."""
    return documents if "lang" in documents.columns else documents.withColumn("lang", F.lit(None).cast("string"))


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> tuple[object, dict]:
    """The model, and decision thresholds by language ("" is for all others)."""
    labelled = training_labels(labels, label)
    total = labelled.agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("s")).first()
    share = total["s"] / total["n"] if total["n"] else 0.0
    rows = sample(documents, labelled, per_class, ("text", "doc_id"))
    if len({r[0] for r in rows}) < 2:
        return Constant(share), {"": 0.5}
    y = np.array([r[0] for r in rows], np.float32)
    texts = [(r[1] or "").encode() for r in rows]
    fold = np.arange(len(rows)) % 5 == 4  # left to the thresholds
    if len(set(y[~fold])) < 2 or len(set(y[fold])) < 2:
        fold[:] = False
    model = TextCNN().fit([t for t, f in zip(texts, fold, strict=True) if not f], y[~fold], share)
    fitted = [r[-1] for r, f in zip(rows, fold, strict=True) if not f]
    del rows, texts
    give_back()
    return model, thresholds_by_language(calibration(documents, labelled, fitted, model), share)


def calibration(documents: DataFrame, labelled: DataFrame, fitted: list, model: TextCNN) -> dict[str, np.ndarray]:
    """By language, the documents of each label (rows) and number of CUTS that the score reaches (columns), over all labelled documents that the fit didn't use."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def make():
        return lambda texts, _rows: {"bin": pa.array(np.searchsorted(CUTS, shared.value.scores(texts), side="right").astype(np.int32), pa.int32())}

    used = F.broadcast(spark.createDataFrame([(i,) for i in set(fitted)], labelled.select("doc_id").schema))
    rest = _with_lang(documents).where(remainder() != 0).select("doc_id", "text", "lang").join(used, "doc_id", "left_anti")
    bins = map_texts(rest, make, "bin int", ["doc_id", "lang"])
    out: dict[str, np.ndarray] = {}
    for r in bins.join(labelled, "doc_id").groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "bin", "y").agg(F.count(F.lit(1)).alias("n")).collect():
        out.setdefault(r["lang"], np.zeros((2, len(CUTS) + 1)))[r["y"], r["bin"]] += r["n"]
    return out


def thresholds_by_language(counts: dict[str, np.ndarray], share: float) -> dict[str, float]:
    """The threshold of each language with labelled rows, and "" for all others.

    A label's rows weigh as much as its share of all labelled rows, since the fit took more of one label. Each language's counts
    have those of all languages added, as PRIOR rows: they decide where a language has few rows, and hardly count where it has many.
    """
    total = sum(counts.values(), np.zeros((2, len(CUTS) + 1)))
    of_label = total.sum(1)
    if not of_label.all():
        return {"": 0.5}
    weight = np.array([1 - share, share]) / (of_label / of_label.sum())
    total = total * weight[:, None]
    prior = total * (PRIOR / total.sum())
    return {lang: threshold(own * weight[:, None] + prior) for lang, own in counts.items() if lang} | {"": threshold(total)}


def threshold(counts: np.ndarray) -> float:
    """The cut of the best F1; of equal ones the middle."""
    reached = counts[:, ::-1].cumsum(1)[:, ::-1][:, 1:]
    f1 = 2 * reached[1] / np.maximum(1e-9, reached.sum(0) + counts[1].sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    return float(CUTS[best[len(best) // 2]])


def score_documents(documents: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang"), per_class: int = PER_CLASS, source: DataFrame | None = None) -> DataFrame:
    """`keep` (with lang), score, and rejected: whether the score reaches the threshold of the row's language.

    `source` has the documents to learn from; by default they are those to score.
    """
    model, thresholds = train(documents if source is None else source, labels, per_class=per_class)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts, _rows: {"score": pa.array(shared.value.scores(texts), pa.float64())}

    cut = F.coalesce(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])[F.coalesce(F.col("lang"), F.lit(""))], F.lit(thresholds[""])) if "lang" in keep else F.lit(thresholds[""])
    return map_texts(documents, make, "score double", list(keep)).withColumn("rejected", F.col("score") >= cut)


def toxicity(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted, and rejected by language."""
    found = score_documents(_with_lang(documents), labels, per_class=per_class)
    return found.select("doc_id", (remainder() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "rejected")


def drop_toxic(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The documents that aren't rejected, with all their columns."""
    lang = F.col("lang") if "lang" in documents.columns else F.lit(None).cast("string")
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_document"), "text", lang.alias("lang"))
    found = score_documents(packed, labels, ("_document", "lang"), per_class, source=documents)
    return found.where(~F.col("rejected")).select("_document.*")
