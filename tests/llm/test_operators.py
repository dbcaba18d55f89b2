"""The training-data operators against brute force, on a fixture with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import decontaminate, fingerprint, linededup, lm, neardup, packing, quality, substrings, tokens, toxicity
from tessella.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, items string, drops string, score double, row long"


def rows():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    base = [rng.choice(words) for _ in range(300)]
    texts = [" ".join(base)]
    for i in range(12):
        w = list(base)
        for _ in range(i * 2):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [" ".join(base[:50]) + "\n" + " ".join(rng.choice(words) for _ in range(60)) for _ in range(4)]
    texts += ["The CAT sat on mat 1\nalone here is a line", "the cat sat on MAT 22\n\nother words in this line", "the cat sat on rug 3"]
    texts += [None, "", "  \n\t ", "one", "One", "two words", "é", "a" * 1000, "ab " * 400, "x\x85y\x1cz", "\U0001f600 <|endoftext|> it's", "long " * 20000]
    texts += [" ".join(rng.choice(words) for _ in range(200)) for _ in range(20)]
    out = [(i, t, rng.choice(["en", "fr", None]), f"s{i % 3}", None if t is None else len(t), 1, "x", "y", 0.5, 7) for i, t in enumerate(texts)]
    return [*out, out[0], out[3], (out[5][0], *out[5][1:2], *out[5][2:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def pairs():
    return [r[:2] for r in rows()]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def same(a, b):
    return sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)


ITEMS = [(1, None), (2, ""), (3, "Two words"), (4, "?!"), (5, None)]


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_decontamination(spark, docs, pairs, none, block):
    long = next(t for _, t in pairs if t and len(t) > 500)
    items = [*ITEMS, (6, long[:200]), (6, long[100:300]), (None, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.report(docs, bench, block_bytes=block)
    digest = found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("sha"), (F.col("n_hit") > 0).alias("c"))
    assert same(got(digest), decontaminate.brute_force(pairs, items))
    assert decontaminate.digest(none, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench).columns == docs.columns
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == docs.count()
    clean = decontaminate.decontaminate(docs, bench, remove="spans", block_bytes=block)
    assert clean.count() == docs.count()
    assert clean.columns == docs.columns
    again = decontaminate.brute_force([tuple(r) for r in clean.select("doc_id", "text").collect()], [(3, "Two words")])
    assert not any(r[2] for r in again)
    assert same(got(clean), got(decontaminate.decontaminate(docs, bench, remove="spans")))


def test_language_model(docs, pairs, none, monkeypatch):
    want = lm.brute_force_base(pairs)
    for top in (lm.TOP, 40):
        monkeypatch.setattr(lm, "TOP", top)
        found = got(lm.score(docs))
        assert [r[:5] for r in found] == [r[:5] for r in sorted(want, key=str)]
        assert np.allclose([r[5] for r in found], [r[5] for r in sorted(want, key=str)])
    assert sum(r[6] for r in found) > sum(r[5] for r in found)
    trained = [w for i, t in pairs if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*(t or "").encode().lower().split(), None]]
    own = {i: (t or "").encode().lower().split() for i, t in pairs}
    assert all(r[7] == sum(trained.count(w) == 1 for w in [*own[r[0]], None]) and np.isclose(r[8], r[6] / r[2]) for r in found if r[2] < 500)
    assert lm.score(none).count() == 0


def test_network_learns_from_all_rows(spark):
    ids = spark.range(4000).where(~F.expr("crc32(cast(id as string)) % 7 = 2")).orderBy(F.xxhash64(F.col("id").cast("string")), "id")
    order = [r["id"] for r in ids.collect()]
    rows = [(d, "aa bb cc dd " * 15 if i < 5 else "pp qq " * 30) for i, d in enumerate(order)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    corpus = lm.Corpus(lm.counts(docs))
    model = lm.train(docs, corpus, most=5)
    h, s, of = lm.tokens([rows[-1][1].encode()])
    classes, _ = corpus.classes(h, s)
    assert model.log10(classes, lm.contexts(classes, of))[3:-1].mean() > np.log10(0.8)


def test_network_is_normalised():
    rng = np.random.default_rng(0)
    model = lm.LogBilinear(np.full(lm.CLASSES, 1 / lm.CLASSES))
    context = rng.integers(0, lm.CLASSES + 1, (5, lm.CONTEXT))
    total = sum(10 ** model.log10(np.full(5, k), context) for k in range(lm.CLASSES))
    assert np.allclose(total, 1, atol=1e-3)


@pytest.mark.parametrize("scale", [1, 400])
def test_network_norm_once_for_each_context(scale, monkeypatch):
    rng = np.random.default_rng(1)
    model = lm.LogBilinear(np.full(lm.CLASSES, 1 / lm.CLASSES))
    model.flat *= np.float32(scale)  # 400: logits so far apart that products of exponentials vanish
    context = rng.integers(0, lm.CLASSES + 1, (7, lm.CONTEXT))[rng.integers(0, 7, 3000)]
    ids = rng.integers(0, lm.CLASSES, 3000)
    r, q, m = (x.astype(float) for x in model.parts(model.flat))
    logits = sum(r[context[:, k]] @ m[k] for k in range(lm.CONTEXT)) @ q[:, :-1].T + q[:, -1]
    logits -= logits.max(1, keepdims=True)
    want = (logits - np.log(np.exp(logits).sum(1, keepdims=True)))[np.arange(3000), ids] / np.log(10)
    plain, norms = np.log, []
    monkeypatch.setattr(lm.np, "log", lambda x: norms.append(np.size(x) if np.ndim(x) else 0) or plain(x))
    found = model.log10(ids, context)
    assert sum(norms) == 7
    assert np.allclose(found, want, rtol=1e-4, atol=1e-4)


def test_places_of_frequent_tokens():
    rng = np.random.default_rng(2)
    corpus = lm.Corpus.__new__(lm.Corpus)
    for hashes in (rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2), np.arange(300, dtype=np.uint64), np.array([7], np.uint64)):
        corpus._first, corpus.hash = None, np.unique(hashes)
        h = np.concatenate((corpus.hash, hashes + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)))
        assert (corpus.places(h) == np.minimum(np.searchsorted(corpus.hash, h), len(corpus.hash) - 1)).all()


def test_fingerprints(docs, none):
    found = {}
    ordered = sorted(((r[0], r[1] or "") for r in rows()))
    table = fingerprint.fingerprint_pairs(docs).collect()
    assert len(table) == len(ordered)
    for r in table:
        found.setdefault(r["doc_id"], []).append(r)
    for i, (doc_id, text) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        k = len(text) // 4
        edited = text[: len(text) - k] + following[:k] if k else text
        digest = hashlib.sha256(edited.encode()).hexdigest()
        assert (len(text), digest) in [(r["n_chars"], r["edited_sha256"]) for r in found[doc_id]]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in table)
    assert len({r["fingerprint"] for r in found[0]}) == 1
    assert fingerprint.fingerprint_pairs(none).count() == 0
    assert same(got(fingerprint.fingerprint_documents(docs)), [(r["doc_id"], r["fingerprint"]) for r in table])


def test_fingerprint_likeness():
    rng = random.Random(1)
    words = [str(rng.random()) for _ in range(3000)]
    a = " ".join(words[:2000])
    b = " ".join(words[500:2500])
    bits, some = fingerprint.fingerprints([a.encode(), b.encode(), b""])
    want = 1496 / 2496
    assert abs(fingerprint.likeness(bits[:1], some[:1], bits[1:2], some[1:2])[0] - want) < 0.08
    assert fingerprint.likeness(bits[:1], some[:1], bits[2:], some[2:])[0] == 0


def test_fingerprints_against_brute_force():
    rng = random.Random(8)
    words = list({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(150)})
    texts = ["", "one", "a b c d e f g h", " ".join(words), *(" ".join(rng.sample(words, k)) for k in (1, 4, 5, 6, 30))]
    bits, some = fingerprint.fingerprints([t.encode() for t in texts])
    assert [b.tolist() if s else [] for b, s in zip(bits, some, strict=True)] == [fingerprint.brute_force(t) for t in texts]
    # unrelated short texts, whose bins are all copies of one value
    bits, some = fingerprint.fingerprints([w.encode() for w in words])
    n = len(words)
    assert max(fingerprint.likeness(np.repeat(bits[i : i + 1], n - 1 - i, 0), some[i + 1 :], bits[i + 1 :], some[i + 1 :]).max() for i in range(n - 1)) < 0.1
    errors = []
    for size in (1, 3, 6, 12, 100, 800):
        for share in (0.3, 0.6, 0.9, 1):
            a = [str(rng.random()) for _ in range(size)]
            b = a[: int(size * share)] + [str(rng.random()) for _ in range(size - int(size * share))]
            one, two = ({tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} for x in (a, b))
            bits, some = fingerprint.fingerprints([" ".join(a).encode(), " ".join(b).encode()])
            errors.append(abs(fingerprint.likeness(bits[:1], some[:1], bits[1:], some[1:])[0] - len(one & two) / len(one | two)))
    assert max(errors) < 0.1
    assert np.mean(errors) < 0.02


def held_out_accuracy(found, label):
    y = {r["doc_id"]: r[label] for r in found["labels"]}
    own = [(r["predicted"], y[r["doc_id"]]) for r in found["rows"] if r["held_out"] and r["doc_id"] in y]
    return sum(a == b for a, b in own) / len(own)


@pytest.mark.parametrize(("query", "label", "least"), [("op4_toxicity", "toxic", 0.95), ("op9_quality", "quality", 0.95)])
def test_classifiers_on_held_out_rows(spark, query, label, least):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    table = QUERIES[query](spark, sf).collect()
    assert len(table) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 for r in table)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in table)
    assert held_out_accuracy({"labels": labels, "rows": table}, label) >= least


def test_prior_is_estimated_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(4)
    for prior in (0.2, 0.5, 0.9):
        p = np.bincount(np.clip(rng.normal(700, 100, 3000), 0, 999).astype(int), minlength=1000)
        n = 20000
        u = np.concatenate((rng.normal(700, 100, int(n * prior)), rng.normal(300, 100, n - int(n * prior))))
        assert abs(quality.best_bin(p, np.bincount(np.clip(u, 0, 999).astype(int), minlength=1000)) - prior) < 0.05


def test_risk_is_non_negative_and_unbiased():
    """The gradient against finite differences of the risk, where it is positive and where it is turned round."""
    rng = np.random.default_rng(9)
    p, u = rng.normal(1, 1, (40, 3)), rng.normal(0, 1, (60, 3))
    for prior in (0.3, 0.99):
        net = quality.PUNet(p, u)
        net.w[2][:] = 4 if prior > 0.9 else net.w[2]
        x_p, x_u = net.ready(p), net.ready(u)

        def risk(w):
            f = lambda x: np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]
            rest = np.logaddexp(0, f(x_u)).mean() - prior * np.logaddexp(0, f(x_p)).mean()
            return prior * np.logaddexp(0, -f(x_p)).mean() + rest if rest >= 0 else -rest

        want = []
        for i in range(len(net.w)):
            g = np.zeros(net.w[i].size)
            for k in range(net.w[i].size):
                for sign in (1, -1):
                    w = [v.copy() for v in net.w]
                    w[i].ravel()[k] += sign * 1e-5
                    g[k] += sign * risk(w) / 2e-5
            want.append(g.reshape(net.w[i].shape))
        net.step(x_p, x_u, prior, 0.0)
        for i, decay in enumerate((1e-4 * net.w[0], 0, 1e-4 * net.w[2], 0)):
            assert np.allclose(net.m[i] * 10, want[i] + decay, atol=1e-6)


def test_quality_reads_words_and_all_rows(spark):
    """Texts of one shape that differ in their words only, and no label of 0 is read."""
    rng = random.Random(3)
    good, bad = (["".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(300)] for _ in range(2))
    rows = [(i, " ".join(rng.choice(bad if i % 4 == 0 else good) for _ in range(40))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(1, 3000, 3) if i % 4], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert abs(model.prior - 0.75) < 0.08
    scores = model.scores([t.encode() for _, t in rows])
    assert sum((s >= 0.5) == (i % 4 > 0) for (i, _), s in zip(rows, scores, strict=True)) > 2900
    zeros = spark.createDataFrame([(i, 0) for i in range(0, 3000, 4)], "doc_id long, quality int")
    assert quality.train(docs, zeros) is None
    again = quality.train(docs, labels.union(zeros))
    assert again.prior == model.prior


def test_thresholds_cover_all_labelled_rows(spark):
    rng = random.Random(6)
    rows = [(i, ("vile rotten " if i % 2 else "fine sunny ") + " ".join(rng.choice("abcdefgh") for _ in range(6)), "xx" if i % 50 < 2 else "en", i % 2) for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    labels = table.select("doc_id", "toxic")
    model, thresholds = toxicity.train(table, labels, per_class=300)
    assert set(thresholds) == {"", "en", "xx"}  # 4 % of the rows: fewer than 40 of them in a fifth of the sample
    fitted = [1, 2]
    counts = toxicity.calibration(table, toxicity.training_labels(labels, "toxic"), fitted, model)
    used = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 and r[0] not in fitted]
    assert {k: v.sum(1).tolist() for k, v in counts.items()} == {k: [sum(r[2] == k and r[3] == y for r in used) for y in (0, 1)] for k in ("en", "xx")}


def test_classifiers_on_odd_rows(spark, docs, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(0, 1, 1), (1, 0, 0), (2, 1, None), (None, 1, 1), (3, 1, 0), (3, 1, 1), (4, 0, 0), (6, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (empty, some):
        for found in (toxicity.toxicity(docs, labels), quality.quality(docs, labels)):
            table = found.collect()
            assert len(table) == docs.count()
            assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in table)
        assert toxicity.toxicity(none, labels).count() == quality.quality(none, labels).count() == 0
    assert toxicity.drop_toxic(docs, empty).columns == docs.columns
    assert toxicity.drop_toxic(docs, empty).count() == docs.count()


@pytest.mark.parametrize("many", [False, True])
def test_repeated_substrings(docs, pairs, none, monkeypatch, many):
    if many:
        monkeypatch.setattr(substrings, "HOT", 2)
        monkeypatch.setattr(substrings, "BROADCAST_KEYS", 3)
        monkeypatch.setattr(substrings, "SEEN", 5)
    want = substrings.brute_force(pairs)
    assert same(got(substrings.removed(docs)), want)
    kept = substrings.remove_repeats(docs).collect()
    assert sorted(hashlib.sha256(r["kept"]).hexdigest() for r in kept) == sorted(r[4] for r in want)
    assert substrings.removed(none).count() == 0


def passages():
    """Texts that share passages of 100 to 900 bytes at different places, some of them with one byte changed."""
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [text(n) for n in (100, 255, 256, 257, 300, 399, 400, 401, 500, 900)]
    out = []
    for i in range(40):
        own = list(rng.choice(shared))
        if i % 3 == 0:
            own[rng.randrange(len(own))] = "z"
        out.append((i, text(rng.randint(0, 300)) + "".join(own) + text(rng.randint(0, 300)) + (rng.choice(shared) if i % 4 == 0 else "")))
    return out


@pytest.mark.parametrize("hot", [500, 3, 1])
def test_repeats_of_all_lengths(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    table = spark.createDataFrame(passages(), "doc_id long, text string").repartition(2)
    assert same(got(substrings.removed(table)), substrings.brute_force(passages()))


def test_repeats_come_from_the_suffix_array(monkeypatch):
    texts = [t.encode() for _, t in passages()]
    found = substrings.Anchors(texts)
    order = np.argsort(found.key, kind="stable")
    pieces, anchors, counts, keys = [], [], [], []
    for k in order.tolist():
        s = int(found.start[k])
        pieces.append(texts[int(found.text[k])][s : s + int(found.count[k]) + substrings.LENGTH - 1])
        anchors.append(int(found.anchor[k]) - s)
        counts.append(int(found.count[k]))
        keys.append(int(found.key[k]))
    build = lambda: substrings.Strings(pieces, [1] * len(pieces), anchors, counts, keys)
    for length in (substrings.SHORT, substrings.LENGTH):
        whole = [t[i : i + length] for t in texts for i in range(len(t) - length + 1)]
        strings = [p[i : i + length] for p, n in zip(pieces, counts, strict=True) for i in range(n)]
        want = [len(s) == length and whole.count(s) > 1 for s in strings]
        assert any(want)
        assert build().repeated(length).tolist() == want
    # without the array's order or common prefixes the result is another
    with monkeypatch.context() as m:
        m.setattr(substrings, "suffix_array", lambda text: np.arange(len(text)))
        assert not build().repeated(substrings.SHORT).any()
    with monkeypatch.context() as m:
        m.setattr(substrings, "common_prefixes", lambda text, sa: np.zeros(len(text), np.int64))
        assert not build().repeated(substrings.SHORT).any()


def test_substrings_over_segments(monkeypatch):
    monkeypatch.setattr(substrings, "SEGMENT", 700)
    text = bytes(random.Random(2).randrange(97, 101) for _ in range(5000))
    found = substrings.Anchors([text])
    assert sum(found.count) == len(text) - substrings.SHORT + 1


def test_token_counts(docs, pairs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_path())
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in pairs]
    assert same(got(tokens.count_tokens(docs)), want)
    assert tokens.count_tokens(none).count() == 0
    counter = tokens.counter_for(tokens.default_path())
    rng = random.Random(3)
    pieces = ["'", "r", "e", "ll", " ", "  ", "\n", "a", "the", "é", "日", "\U0001f600", "<|endoftext|>", "<|", "9", "!", "\x85", "१"]
    for _ in range(150):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        counts = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert counter.prefixes(text).tolist() == counts
        assert counter.count(text) == counts[-1]
        assert counter.truncate(text, 4) == max(k for k, c in enumerate(counts) if c <= 4)
    short = {r["doc_id"]: r["prefix"] for r in tokens.truncate(docs, 3).collect()}
    assert all(len(library.encode(p, add_special_tokens=False).ids) <= 3 for p in short.values())


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates(docs, pairs, none, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_CLASSES", block)
    want = neardup.brute_force(pairs)
    assert same(got(neardup.near_duplicates(docs)), want)
    assert neardup.near_duplicates(none).count() == 0
    five = neardup.brute_force(pairs, 5, 80, 100)
    assert same(got(neardup.near_duplicates(docs, 5, 80, 100)), five)
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    wordy = [p for p in pairs if (p[1] or "").encode().split()]
    assert same([tuple(r) for r in kept.select("doc_id", "text").collect()], [*neardup.brute_force_kept(wordy), *(p for p in pairs if p not in wordy)])


def test_near_duplicates_are_dropped_by_row(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcde") for _ in range(4)) for _ in range(300)]
    a, b = " ".join(words[:80]), " ".join(words[100:180])
    pairs = [(1, a), (5, a), (5, b), (7, b + " more"), (8, a + " x"), (3, None), (3, ""), (3, ""), (9, "unique words here"), (1, a), (2, a[:40])]
    table = spark.createDataFrame([(i, t, "s", 1, 2, 3) for i, t in pairs], "doc_id long, text string, h string, node int, row int, stays int")
    kept = neardup.drop_near_duplicates(table)
    assert kept.columns == table.columns
    want = neardup.brute_force_kept([p for p in pairs if p[1]])
    assert same([tuple(r) for r in kept.select("doc_id", "text").collect()], [*want, *(p for p in pairs if not p[1])])
    assert (5, b) in want
    none = spark.createDataFrame([(None, a), (None, b), (4, a), (None, b)], "doc_id long, text string")
    assert same([tuple(r) for r in neardup.drop_near_duplicates(none).collect()], [(4, a), (None, b)])


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    b = np.concatenate((a[:1900], rng.integers(0, 1 << 63, 100, dtype=np.uint64)))
    both = neardup.odd_sketches(neardup.minhashes(np.concatenate((a, b)), np.array([0, 2000, 4000])))
    assert abs(neardup.similarity(both[0], both[1:])[0] - 1900 / 2100) < 0.06


def test_line_dedup(spark, docs, none):
    connection = duckdb.connect()
    frame = docs.select("doc_id", "text").toPandas()
    frame["doc_id"] = frame["doc_id"].astype("int64")
    connection.register("documents", frame)
    assert same(got(linededup.report(docs)), connection.sql(linededup.ORACLE_SQL).fetchall())
    kept = linededup.dedup_lines(docs)
    assert kept.columns == docs.columns
    assert kept.dtypes == docs.dtypes
    by_id = {r["doc_id"]: r["text"] for r in kept.collect()}
    first = next(r[0] for r in rows() if r[1] and r[1].startswith("The CAT"))
    assert by_id[first] == "The CAT sat on mat 1\nalone here is a line"
    assert by_id[first + 1] == "\nother words in this line"
    assert linededup.report(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (1, "a b c d e\n")], "doc_id long, text string")
    assert sorted(str(r["text"]) for r in linededup.dedup_lines(odd).collect()) == ["", "", "a b c d e\n"]


def test_line_templates(spark):
    rng = random.Random(13)
    name = lambda: "".join(rng.choice("bcdfghklm") for _ in range(6))
    rows, want = [], {}
    # families of one leaf: ten words that begin with the same three
    families = ["we are happy to send {} your very own card", "we are happy that {} came to see us here", "we are happy if all {} people like blue cheese"]
    for i in range(30):
        lines = [families[i % 3].format(name()), "i would like " + name(), f"own {name()} line {name()} of {name()} some {name()} kind {name()}"]
        rows.append((i, "\n".join(lines)))
        want[i] = "\n".join(lines if i < 3 else lines[1:])
    found = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == want
    connection = duckdb.connect()
    connection.register("documents", spark.createDataFrame(rows, "doc_id long, text string").toPandas())
    assert same(got(linededup.report(spark.createDataFrame(rows, "doc_id long, text string"))), connection.sql(linededup.ORACLE_SQL).fetchall())
    # random lines over few words: many levels of the tree
    rows = [(i, "\n".join(" ".join(rng.choice("abc") for _ in range(rng.choice((4, 5, 8, 9, 12)))) for _ in range(6))) for i in range(40)]
    connection.register("documents", spark.createDataFrame(rows, "doc_id long, text string").toPandas())
    assert same(got(linededup.report(spark.createDataFrame(rows, "doc_id long, text string"))), connection.sql(linededup.ORACLE_SQL).fetchall())


def test_line_dedup_by_shuffles(docs, monkeypatch):
    want = got(linededup.report(docs))
    monkeypatch.setattr(linededup, "BROADCAST_BYTES", -1)
    assert got(linededup.report(docs)) == want


def test_line_templates_of_large_leaves(spark, docs, monkeypatch):
    rng = random.Random(17)
    rows = [(i, "\n".join("a b c " + " ".join(rng.choice("xyz") for _ in range(rng.choice((2, 5, 9)))) for _ in range(5))) for i in range(30)]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    want = got(linededup.report(frame))
    for most in (0, 20):
        monkeypatch.setattr(linededup, "LEAF_LINES", most)
        assert got(linededup.report(frame)) == want


def test_line_templates_shuffle_lines_only(spark):
    lines = [(i % 5, i, 1, 2, [f"w{i % 3}", f"v{i}", "u"], i % 5) for i in range(60)]
    open_ = spark.createDataFrame(lines, "leaf long, key long, d1 long, d2 long, rest array<string>, node long")
    plan = linededup._judged(open_.repartition("node"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_COL") == 2


def test_line_dedup_is_native(docs):
    plan = linededup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan


@pytest.mark.parametrize("shard", [packing.SHARD_TOKENS, 3000])
def test_packing(docs, pairs, none, shard):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_path())
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in pairs}
    table = packing.pack_documents(docs, shard_tokens=shard, with_ids=True).collect()
    sequences = {}
    for r in table:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert own == r["ids"]
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        assert at & (at - 1) == 0
    assert sum(r["length"] for r in table) == sum(len(ids[i]) for i, _ in pairs)
    assert packing.pack_documents(none).count() == 0


def test_retrieval_prefers_neighbours():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 500, 600).astype(np.uint32), rng.integers(1000, 1500, 600).astype(np.uint32)
    index = packing.Index([a, b, a[::-1].copy(), b[::-1].copy()], common=1)
    assert index.neighbours(0, np.array([False, True, True, True])).tolist() == [2]
    assert index.neighbours(1, np.array([True, False, True, True])).tolist() == [3]


def test_retrieval_of_common_terms_and_copies():
    rng = np.random.default_rng(2)
    ids = [rng.integers(i * 50, i * 50 + 60, 700).astype(np.uint32) for i in range(60)]
    copy = rng.integers(5000, 5200, 700).astype(np.uint32)
    for i in range(0, 60, 3):
        ids[i] = copy.copy()
    index = packing.Index(ids)
    unused = np.ones(60, bool)
    unused[0] = False
    assert index.neighbours(0, unused).tolist() == list(range(3, 60, 3))
    assert index.neighbours(0, unused, 4).tolist() == list(range(3, 60, 3))
    windows = [{d % 3 == 0 for d, _, _ in sequence} for sequence in packing.pack(ids) if len(sequence) > 1]
    assert sum(len(w) == 1 for w in windows) >= len(windows) - 2
    # terms of all documents count, too
    shared = [np.concatenate((np.full(5 + 20 * (i % 2), 7), np.arange(100 + i * 40, 140 + i * 40))).astype(np.uint32) for i in range(30)]
    index = packing.Index(shared)
    assert len(index.neighbours(0, np.arange(30) > 0)) == 29


def test_packing_brings_together_what_lies_apart(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("bcdfghklmnprstaeiou") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    groups = [[rng.choice(words) for _ in range(250)] for _ in range(40)]
    pairs = [(i * 40 + g, " ".join(w)) for g, w in enumerate(groups) for i in range(3)]
    found = []
    for order in (pairs, sorted(pairs, reverse=True)):
        table = packing.pack_documents(spark.createDataFrame(order, "doc_id long, text string").repartitionByRange(6, "doc_id"), shard_tokens=20_000)
        found.append(got(table))
    assert found[0] == found[1]
    windows = {}
    for r in found[0]:
        windows.setdefault(r[0] % 40, []).append((r[0], r[5]))
    together = sum(len({s for d, s in w if d // 40 == 0} & {s for d, s in w if d // 40 == 1}) > 0 for w in windows.values())
    assert together >= 30


def test_index_without_used_documents(monkeypatch):
    rng = np.random.default_rng(3)
    ids = [rng.integers(i % 7 * 20, i % 7 * 20 + 400, rng.integers(1, 900)).astype(np.uint16) for i in range(300)]
    ids += ids[::5]
    index, whole = packing.Index(ids), packing.Index(ids)
    unused = rng.random(len(ids)) < 0.4
    index.compact(unused)
    assert len(index.documents) == unused.sum() and index.dense.shape[1] < whole.dense.shape[1]
    assert all(index.neighbours(s, unused, 20).tolist() == whole.neighbours(s, unused, 20).tolist() for s in range(0, len(ids), 11))
    found = packing.pack(ids)
    monkeypatch.setattr(packing, "UNUSED", 0)
    assert found == packing.pack(ids)


def test_ids_of_texts_cut_at_white_space():
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(tokens.default_path()), random.Random(5)
    vocabulary = tokens.vocabulary_for(tokens.default_path())
    assert vocabulary.cut("a  b\n\n\tc d  ") == ["a ", " b\n\n", "\tc d  "]
    assert vocabulary.cut("a  <|endoftext|>") is None and vocabulary.cut("a \u2003b") is None
    letters = [" ", " ", "\n", "\t", "\r", "\x0b", "\x1c", "a", "\u00e9", "1", "'s", "!", "\u4e2d", "\U0001f600"]
    for i in range(4000):
        text = "".join(rng.choices(letters + ["\x85", "\xa0", "\u3000", "<|endoftext|>"] * (i % 2), k=rng.randint(0, 12)))
        assert vocabulary.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_stored_ids():
    for ids in ([], [1], [0, 65535, 1], [65536], [7, 49_999, 70_000, 1]):
        assert packing.restored(packing.stored(np.array(ids, np.uint32))).tolist() == ids


def test_packing_bounds_the_documents_of_a_shard(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 400, raising=False)
    rows = [(i, "") for i in range(4000)] + [(4000 + i, f"{i} some words") for i in range(800)]
    packed = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    by_shard, by_task = {}, {}
    for r in packed.withColumn("task", F.spark_partition_id()).collect():
        by_shard.setdefault(r["sequence_id"] >> 32, set()).add(r["doc_id"])
        by_task.setdefault(r["task"], set()).add(r["sequence_id"] >> 32)
    assert sum(map(len, by_shard.values())) == len(rows)
    assert max(map(len, by_shard.values())) <= 600
    # no two shards meet in a task
    assert max(map(len, by_task.values())) == 1


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    connection = duckdb.connect()
    for t in ("documents", "benchmark"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = connection.sql(ORACLES[name])
    found = QUERIES[name](spark, sf).select(*want.columns)
    assert same(got(found), want.fetchall())
