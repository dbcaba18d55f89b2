import zlib

import duckdb
import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tessella.llm import components, decontaminate, linededup, neardup, tokens, toxicity
from tessella.llm.components import connected_components
from tessella.llm.suffix_array import common_prefixes, suffix_array


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.dtypes == docs.dtypes, name
        n = after.count()
        assert 0.5 * before < n <= before, name
    packed = corpus_pipeline.run(spark, sf)
    assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kept = {r["doc_id"] for r in packed.select("doc_id").distinct().collect()}
    assert len(kept) > 0.5 * before


def test_each_stage_against_brute_force(spark, sf):
    """Each stage over its predecessor's rows: scores row by row, DuckDB, all pairs, word by word, and the library's tokens."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    benchmark = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)

    model, cuts = toxicity.train(docs, labels)
    kept = [r for r in docs.select("doc_id", "text", "lang").collect() if model.scores([(r["text"] or "").encode()])[0] < cuts.get(r["lang"], cuts[""])]
    clean = stages["toxicity"](spark, docs, sf).cache()
    assert rows(clean) == sorted(((r["doc_id"], r["text"]) for r in kept), key=str)
    assert clean.count() < docs.count()

    connection = duckdb.connect()
    connection.register("docs", clean.select("doc_id", "text").toPandas())
    want = connection.sql("WITH RECURSIVE " + linededup.ORACLE_BODY.strip() + " SELECT docs.doc_id, kept_text FROM docs LEFT JOIN kept ON kept.d = docs.doc_id AND kept.text = docs.text").fetchall()
    lines = stages["line_dedup"](spark, clean, sf).cache()
    assert rows(lines) == sorted(want, key=str)

    pairs = rows(lines)
    wordy = [p for p in pairs if (p[1] or "").encode().split()]
    unique = stages["near_dedup"](spark, lines, sf).cache()
    assert rows(unique) == sorted([*neardup.brute_force_kept(wordy, 5, 80, 100), *(p for p in pairs if p not in wordy)], key=str)

    pairs = rows(unique)
    hit = {r[0] for r in decontaminate.brute_force(pairs, benchmark) if r[2]}
    free = stages["decontamination"](spark, unique, sf).cache()
    assert rows(free) == [p for p in pairs if p[0] not in hit]

    library = Tokenizer.from_file(tokens.default_path())
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows(free)}
    found = {}
    for r in stages["packing"](spark, free, sf).collect():
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        found.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    assert {i: sum(n for _, n in x) for i, x in found.items()} == {i: len(x) for i, x in ids.items()}


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_components(spark):
    edges = [(1, 2), (3, 2), (3, 4), (10, 11), (7, 7), (20, 4), (11, 12), (12, 13), (13, 14)]
    found = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 20: 1, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_small_and_large_graphs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    path = rng.permutation(300).tolist()
    edges = [*zip(path[:-1], path[1:]), *((int(a), int(b)) for a, b in rng.integers(1000, 1400, (150, 2)))]
    least = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in edges:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    frame, rounds = spark.createDataFrame(edges, "a long, b long"), []
    monkeypatch.setattr(components, "checkpointed", lambda df, f=components.checkpointed: rounds.append(1) or f(df))
    for most in (components.TASK_EDGES, 60, 0):
        monkeypatch.setattr(components, "TASK_EDGES", most)
        assert dict(tuple(r) for r in connected_components(frame).collect()) == least
        if most > 1000:  # the driver keeps something of each job
            assert len(rounds) <= 2


def test_suffix_arrays():
    rng = np.random.default_rng(3)
    for n in [0, 1, 2, 3, *rng.integers(4, 120, 300)]:
        text = np.tile(rng.integers(0, rng.integers(1, 5), rng.integers(1, 20)), 120)[:n]
        if n > 3:
            text[rng.integers(0, n, 2)] = rng.integers(0, 5, 2)
        t = text.tolist()
        sa = suffix_array(text)
        assert sa.tolist() == sorted(range(n), key=lambda i: t[i:])
        shared = common_prefixes(text, sa)
        for r in range(1, n):
            a, b = t[sa[r] :], t[sa[r - 1] :]
            assert shared[r] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
