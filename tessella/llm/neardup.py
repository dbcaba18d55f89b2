"""MinHash near-duplicates with odd sketches.

A document's set: its distinct runs of n words (split at ASCII white space, A-Z lower-cased); with fewer words the whole
sequence as one. Documents with equal sets are one class from the start. Bands of MinHash values give the
buckets; classes that share one are in one candidate group. All SAMPLES values of a set are folded into
a parity bitmap of SKETCH_BITS bits (an odd sketch): the XOR of two bitmaps has the parity of the samples in which they differ,
so its population count estimates a high similarity precisely. Within a group, pairs whose estimate isn't well
below the threshold are confirmed on the full sets, unless they are connected already.

The bands have the most rows with which a link at the threshold t shares no bucket with probability (1 - t^rows)^bands of
at most MISS; at 0.85 that is 32 bands of 6 rows and 3e-7. The margin of the estimate is over five of its standard deviations.

Work is bounded: groups are cut into blocks by a hash of the class, and each pair of blocks is a task's unit of its own, so
no task has more than two blocks. It returns at most a spanning forest of its links, never all pairs.

Defined results: a text without words, null or empty has an empty set and is linked with nothing; its component is its own
doc_id. Repeated rows and equal sets are linked. A component's number is its least doc_id; a null doc_id counts after all
others and a component of such rows alone has the number null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, arrow_batches, checkpointed, distinct_by_text, encoded, map_texts, mix, shingles, slices
from .components import connected_components

SHINGLE, NUMERATOR, DENOMINATOR = 3, 85, 100
SAMPLES, MISS, SKETCH_BITS = 192, 1e-6, 512
#: Classes and shingles of a block.
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 1_000_000
#: How far below the threshold an estimate may be.
MARGIN = 0.18
#: Ids that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_C = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)


def band_rows(threshold: float) -> int:
    """Rows of a band for links of at least this similarity."""
    fit = [r for r in range(1, 25) if (1 - threshold**r) ** (SAMPLES // r) <= MISS]
    if not fit:
        raise ValueError(f"{SAMPLES} MinHash values don't find links of similarity {threshold}")
    return max(fit)


def minhashes(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values of non-empty sets, a row for each."""
    x = (h >> U64(32)).astype(np.uint32)
    out = np.empty((len(offsets) - 1, SAMPLES), np.uint32)
    step = 200_000
    begin = 0
    while begin < len(offsets) - 1:  # pieces that stay in the cache
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + step)) - 1)
        part, starts = x[offsets[begin] : offsets[end]], offsets[begin:end] - offsets[begin]
        for i in range(SAMPLES):
            out[begin:end, i] = np.minimum.reduceat(part * _A[i] + _C[i], starts)
        begin = end
    return out


def band_keys(m: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each band and its number."""
    bands = SAMPLES // rows
    v = m[:, : bands * rows].reshape(len(m), bands, rows).astype(U64)
    h = np.broadcast_to(np.arange(bands, dtype=U64), (len(m), bands))
    for r in range(rows):
        h = mix(h * U64(0xC2B2AE3D27D4EB4F) + v[:, :, r])
    return h.view(np.int64)


def odd_sketches(m: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, as words of 64 bits."""
    where = mix(m.astype(U64) + (np.arange(m.shape[1], dtype=U64) << U64(32))) % U64(SKETCH_BITS)
    bits = np.zeros((len(m), SKETCH_BITS), np.uint8)
    rows = np.arange(len(m))
    for i in range(m.shape[1]):
        bits[rows, where[:, i].astype(np.int64)] ^= 1
    return np.packbits(bits, axis=1).view(U64)


def similarity(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated similarities of one sketch and others."""
    z = np.bitwise_count(one ^ others).sum(1)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(np.maximum(1e-9, 1 - 2 * z / SKETCH_BITS))


def set_columns(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    return distinct_by_text(*shingles(Words(texts), len(texts), n), len(texts))


def nodes(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each whole set; 0 for an empty one."""
    size = np.diff(offsets)
    some, out = np.flatnonzero(size), np.zeros(len(size), np.int64)
    if len(some):
        starts = offsets[:-1][some]
        sums, xors = np.add.reduceat(mix(h ^ U64(0x8EBC6AF09C88C6E3)), starts), np.bitwise_xor.reduceat(h, starts)
        out[some] = mix(sums + mix(xors) * U64(3) + size[some].astype(U64)).view(np.int64)
    return out


def signatures(documents: DataFrame, n: int, rows: int) -> DataFrame:
    """The columns but the text, n_shingles, node (a hash of the set, null if empty) and the bands' keys."""

    def make():
        def work(texts: list[bytes], _rows: pa.RecordBatch) -> dict:
            h, offsets = set_columns(texts, n)
            size = np.diff(offsets)
            some = np.flatnonzero(size)
            keys = [None] * len(texts)
            node = nodes(h, offsets)
            if len(some):
                bands = band_keys(minhashes(h, np.append(offsets[:-1][some], offsets[-1])), rows)
                for i, b in zip(some, bands, strict=True):
                    keys[i] = b
            return {"n_shingles": size.astype(np.int64), "node": pa.array(node, pa.int64(), mask=size == 0), "bands": pa.array(keys, pa.list_(pa.int64()))}

        return work

    return map_texts(documents, make, "n_shingles long, node long, bands array<long>", [c for c in documents.columns if c != "text"])


class Forest:
    """Union-find over numbers."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up


def link_blocks(sets: list[np.ndarray], blocks: np.ndarray, numerator: int, denominator: int) -> list[tuple[int, int]]:
    """Links that span what is linked among the sets: between the two blocks, or within one."""
    n = len(sets)
    if n < 2:
        return []
    size = np.array([len(s) for s in sets])
    offsets = np.concatenate(([0], np.cumsum(size)))
    flat = np.concatenate(sets)
    sketch = odd_sketches(minhashes(flat, offsets))
    _, flat = np.unique(flat, return_inverse=True)
    mark = np.zeros(flat.max() + 1, np.int64)
    forest, links = Forest(n), []
    two = len(set(blocks.tolist())) > 1
    order = np.argsort(-size, kind="stable")
    least = numerator / denominator - MARGIN
    for i in order.tolist():
        roots = forest.roots()
        may = (roots != roots[i]) & (np.minimum(size, size[i]) * denominator >= np.maximum(size, size[i]) * numerator)
        if two:
            may &= blocks != blocks[i]
        may = np.flatnonzero(may)
        may = may[similarity(sketch[i], sketch[may]) >= least]
        if not len(may):
            continue
        mark[flat[offsets[i] : offsets[i + 1]]] = 1
        both = np.array([mark[flat[offsets[j] : offsets[j + 1]]].sum() for j in may]) if len(may) < n // 8 else np.add.reduceat(mark[flat], offsets[:-1])[may]
        mark[flat[offsets[i] : offsets[i + 1]]] = 0
        for j in may[denominator * both >= numerator * (size[i] + size[may] - both)].tolist():
            if forest.join(i, j):
                links.append((i, j))
    return links


def links(documents: DataFrame, classes: DataFrame, groups: DataFrame, n: int, numerator: int, denominator: int) -> DataFrame:
    """Confirmed links (a, b) between classes of one candidate group, enough to connect all that are linked.

    classes: node, doc_id (of one member), n_shingles; groups: node, component.
    """
    spark = documents.sparkSession
    arrow_batches(spark)
    sizes = groups.join(classes, "node").select("node", "component", "doc_id", "n_shingles")
    blocks = sizes.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("n_blocks"))
    wanted = sizes.join(blocks, "component").select("doc_id", "node", "component", "n_blocks")
    wanted = checkpointed(wanted)
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = documents.select(F.col("doc_id").alias("_id"), "text").join(wanted, F.col("_id").eqNullSafe(F.col("doc_id")))

    def make():
        def work(texts: list[bytes], rows: pa.RecordBatch) -> dict:
            h, offsets = set_columns(texts, n)
            own = nodes(h, offsets) == rows.column("node").to_numpy()  # another text of that doc_id is not the class's
            return {"hashes": pa.array([h[a:b].tobytes() if k else None for a, b, k in zip(offsets[:-1], offsets[1:], own, strict=True)], pa.binary())}

        return work

    sets = map_texts(texts, make, "hashes binary", ["node", "component", "n_blocks"]).where("hashes is not null")
    block = F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")
    units = sets.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    units = units.select(F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, members = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            nodes = list(members)
            found = link_blocks([np.frombuffer(members[k][1], U64) for k in nodes], np.array([members[k][0] for k in nodes]), numerator, denominator)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for component, i, j, block, node, hashes in zip(*(batch.column(c).to_pylist() for c in ("component", "i", "j", "block", "node", "hashes")), strict=True):
                if (component, i, j) != name:
                    yield from done()
                    name, members = (component, i, j), {}
                members[node] = (block, hashes)
        yield from done()

    return units.repartition("unit").sortWithinPartitions("component", "i", "j").mapInArrow(run, "a long, b long")


def _components(documents: DataFrame, n: int, numerator: int, denominator: int) -> tuple[DataFrame, DataFrame]:
    """The documents' signatures, without bands, and (node, component) of the classes that are linked with another."""
    signed = checkpointed(signatures(documents, n, band_rows(numerator / denominator)))
    some = signed.where("node is not null")
    classes = some.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"))
    members = some.select("node", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot <> last").select("bucket", "pivot")
    edges = members.join(buckets, "bucket").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    groups = connected_components(edges)
    return signed.drop("bands"), connected_components(links(documents, classes, groups, n, numerator, denominator))


def near_duplicates(documents: DataFrame, n: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) of each document."""
    signed, found = _components(documents.select("doc_id", "text"), n, numerator, denominator)
    classes = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    named = classes.join(found, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = named.join(least, "component").select("node", "component_id")
    out = signed.join(ids, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def drop_near_duplicates(documents: DataFrame, n: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """One row of each component, with all its columns; rows without words all stay.

    Rows are told apart by doc_id and text, so a doc_id may stand for several texts, of which each stays or goes by its own component. The row of the
    least doc_id stays (a null one counts after all others), of equal ids that of the least hash of its text, and one of repeated rows of it.
    """
    text = documents.select("doc_id", "text", F.xxhash64("text").alias("h"))
    signed, found = _components(text, n, numerator, denominator)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")
    some = signed.where("node is not null").join(found, "node", "left").select(F.coalesce("component", "node").alias("component"), rank.alias("row"))
    first = some.groupBy("component").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    # of each component of several rows: how often each of them occurs, and whether it stays
    counted = some.join(first, "component").groupBy("row").agg(F.count(F.lit(1)).alias("times"), F.min(F.col("row") == F.col("first")).alias("stays"))
    others = checkpointed(counted.where("not stays or times > 1").select(F.col("row.doc_id").alias("_id"), F.col("row.h").alias("_h"), "stays"))
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_document"), F.col("doc_id").alias("_own"), F.xxhash64("text").alias("_text"))
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_h"))
    sized = lambda df: F.broadcast(df) if df.count() <= BROADCAST_IDS else df
    out = whole.join(sized(others), same, "left_anti")
    twice = others.where("stays")
    if not twice.isEmpty():
        out = out.unionByName(whole.join(sized(twice), same, "left_semi").dropDuplicates(["_own", "_text"]))
    return out.select("_document.*")


def brute_force(documents: list[tuple], n: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> list[tuple]:
    """The result over a list of (doc_id, text), all pairs; for tests."""
    sets = []
    for _, text in documents:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    forest = Forest(len(sets))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and denominator * both >= numerator * (len(a) + len(sets[j]) - both):
                forest.join(i, j)
    roots = forest.roots()
    least: dict = {}
    for (doc_id, _), r in zip(documents, roots.tolist(), strict=True):
        least[r] = min(least.get(r, doc_id), doc_id)
    return [(doc_id, len(s), least[r], doc_id == least[r]) for (doc_id, _), s, r in zip(documents, sets, roots.tolist(), strict=True)]


def brute_force_kept(documents: list[tuple], n: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> list[tuple]:
    """The (doc_id, text) that stay of a list without null ids, where one text of a component has its least doc_id; for tests."""
    numbered = [(i, text) for i, (_, text) in enumerate(documents)]
    found = brute_force(numbered, n, numerator, denominator)
    best: dict = {}
    for (doc_id, _), (i, _, component, _) in zip(documents, found, strict=True):
        best[component] = min(best.get(component, (doc_id, i)), (doc_id, i))
    return [documents[i] for _, i in best.values()]
