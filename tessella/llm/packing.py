"""Lexical retrieval packing: documents share a sequence with their nearest neighbours under BM25.

Documents are dealt to shards of at most SHARD_TOKENS tokens (or one longer document) and SHARD_ROWS documents by their content, wherever they are
stored: by a weighted MinHash that prefers rare terms. A shard is a task; its work grows as its sequences times its documents, so both are bounded. Frequencies of terms and the mean length are those of all documents. Each document is cut into whole windows, which are sequences of their own, and a rest. The documents of a shard that have a rest are put into
an inverted index, with all their terms. The longest unused rest is the seed of a sequence; the index returns its unused neighbours in
order of their BM25 score, and they fill the window greedily. All terms count; copies are one text of the index. Documents without a word in common with the seed follow,
longest first. What doesn't fit is cut off and begins a next sequence as its seed. So all sequences but the last of a shard are full; the last is
split at powers of two, which take no padding.

Defined results: a null or empty text is the end token alone. Repeated rows are packed as often as they occur.
No text is dropped, and no two sequences share an id. A very long text is cut into windows; its ids are in memory as a whole, alone in its shard
if there are more of them than a shard takes. Ties go to the lower doc_id. An empty table gives no pieces. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, encoded, written
from .tokens import default_path, vocabulary_for

WINDOW = 2048
END = 1
SHARD_TOKENS = 6_000_000
#: Documents of a shard: a shorter one counts as this part of its tokens.
SHARD_ROWS = 60_000
#: BM25's parameters.
K1, B = 1.2, 0.75
#: Terms in more than this share of a shard's texts have a row of weights over all of them in place of postings.
COMMON = 0.1
#: The index is made anew without the used documents when less than this share of its documents is unused.
UNUSED = 0.75
#: Neighbours that are put in order at once; more follow until the window is full.
NEAREST = 64
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Statistics:
    """Documents, tokens and documents with each term of a corpus."""

    def __init__(self, n: int, tokens: int, df: np.ndarray):
        self.n, self.tokens = n, tokens
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)


def counted_terms(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a text in order, and how often each occurs. A stable sort of two-byte ids is one by digits, which is the fastest."""
    ordered = np.sort(ids, kind="stable")
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ids) else np.zeros(0, np.int64)
    return ordered[first], np.diff(np.append(first, len(ids)))


class Index:
    """An inverted index over the documents of one shard, with weights of BM25.

    Every term counts. Those in more than `common` of the texts have a row of weights over all texts, the others postings.
    Copies are one text with several members, all of the same score.
    `compact` leaves used documents out; what is left has the same scores as before.
    """

    def __init__(self, ids: list[np.ndarray], k1: float = K1, b: float = B, common: float = COMMON, corpus: Statistics | None = None):
        n = len(ids)
        first: dict[bytes, int] = {}
        self.text = np.array([first.setdefault(x.tobytes(), len(first)) for x in ids], np.int64)
        members = np.bincount(self.text, minlength=len(first))
        some = np.unique(self.text, return_index=True)[1]
        self.terms, counts = [], []
        for i in some:
            t, c = counted_terms(ids[i])
            self.terms.append(t)
            counts.append(c)
        length = np.array([len(ids[i]) for i in some], np.float32)
        sizes = np.array([len(t) for t in self.terms], np.int64)
        term = np.concatenate(self.terms).astype(np.int64) if n else np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(some), dtype=np.int32), sizes)
        tf = (np.concatenate(counts) if n else np.zeros(0)).astype(np.float32)
        if corpus is None:
            corpus = Statistics(n, int((length * members).sum()), np.bincount(term, weights=members[text], minlength=1))
        norm = k1 * (1 - b + b * length / max(corpus.tokens / max(corpus.n, 1), 1.0))
        weight = (corpus.idf[term] * tf * (k1 + 1) / (tf + norm[text])).astype(np.float32)
        posted = np.bincount(term, minlength=1)
        dense = np.flatnonzero(posted > max(8, common * len(some)))
        self.row = np.full(len(posted), -1, np.int64)
        self.row[dense] = np.arange(len(dense))
        self.dense = np.zeros((len(dense), len(some)), np.float32)
        rare = self.row[term] < 0
        self.dense[self.row[term[~rare]], text[~rare]] = weight[~rare]
        order = np.argsort(term[rare], kind="stable")
        self.posting, self.weight = text[rare][order], weight[rare][order]
        self.at = np.concatenate(([0], np.cumsum(np.where(self.row < 0, posted, 0))))
        self.documents, self.column = np.arange(n), self.text

    def compact(self, unused: np.ndarray) -> None:
        """Leaves out used documents, and texts without unused ones. They can still be seeds."""
        left = unused[self.documents]
        self.documents, column = self.documents[left], self.column[left]
        kept = np.unique(column)
        to = np.full(self.dense.shape[1], -1, np.int32)
        to[kept] = np.arange(len(kept))
        self.column = to[column]
        self.dense = np.ascontiguousarray(self.dense[:, kept])
        inside = to[self.posting] >= 0
        before = np.concatenate(([0], np.cumsum(inside)))
        self.posting, self.weight, self.at = to[self.posting[inside]], self.weight[inside], before[self.at]

    def scores(self, seed: int) -> np.ndarray:
        """Scores of the texts that are left under the terms of the seed's."""
        t = self.terms[self.text[seed]]
        row = self.row[t]
        out = np.zeros(self.dense.shape[1], np.float32)
        for r in row[row >= 0]:
            out += self.dense[r]
        t = t[row < 0]
        if len(t):
            a, size = self.at[t], self.at[t + 1] - self.at[t]
            place = np.repeat(a - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            out += np.bincount(self.posting[place], weights=self.weight[place], minlength=len(out)).astype(np.float32)
        return out

    def neighbours(self, seed: int, unused: np.ndarray, most: int | None = None) -> np.ndarray:
        """Unused documents that share a term with the seed, best first; ties go to the lower number. `most` and those equal to the last of them, or all."""
        score = self.scores(seed)[self.column]
        score[~unused[self.documents]] = 0
        found = np.flatnonzero(score)
        if most is not None and len(found) > most:
            found = found[score[found] >= -np.partition(-score[found], most - 1)[most - 1]]
        return self.documents[found[np.argsort(-score[found], kind="stable")]]


def pack(ids: list[np.ndarray], window: int = WINDOW, corpus: Statistics | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold each token of ids once."""
    out: list[list[tuple[int, int, int]]] = []
    rests, starts = [], []
    for d, x in enumerate(ids):
        whole = len(x) // window * window
        out += [[(d, s, window)] for s in range(0, whole, window)]
        if whole < len(x):
            rests.append(d)
            starts.append(whole)
    index = Index([ids[d] for d in rests], corpus=corpus)
    unused = np.ones(len(rests), bool)
    begin = np.array(starts, np.int64)
    size = np.array([len(ids[d]) for d in rests], np.int64) - begin
    queue, at = np.argsort(-size, kind="stable"), 0
    sequence: list[tuple[int, int, int]] = []
    free, carried = window, -1

    def put(r: int) -> bool:
        """Puts a rest, or what fits of it, at the end of the sequence; whether the sequence is full."""
        nonlocal free, sequence, carried
        take = min(free, int(size[r]))
        sequence.append((rests[r], int(begin[r]), take))
        begin[r] += take
        size[r] -= take
        free -= take
        unused[r] = False
        carried = r if size[r] else -1
        return free == 0

    while True:
        if carried >= 0:
            seed = carried
        else:
            while at < len(queue) and not unused[queue[at]]:
                at += 1
            if at == len(queue):
                break
            seed = queue[at]
        full = put(seed)
        if np.count_nonzero(unused) < UNUSED * len(index.documents):
            index.compact(unused)
        while not full:
            near = index.neighbours(seed, unused, NEAREST)
            if not len(near):
                break
            for r in near:
                full = put(r)
                if full:
                    break
        while not full:
            while at < len(queue) and not unused[queue[at]]:
                at += 1
            if at == len(queue):
                break
            full = put(queue[at])
        if full:
            out.append(sequence)
            sequence, free = [], window
    return out + powers_of_two(sequence)


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces cut into sequences whose lengths are the powers of two of their sum, largest first."""
    out, rest = [], sum(p[2] for p in pieces)
    pieces = list(pieces)[::-1]
    while rest:
        left = 1 << (rest.bit_length() - 1)
        rest -= left
        sequence = []
        while left:
            d, s, n = pieces.pop()
            take = min(n, left)
            sequence.append((d, s, take))
            left -= take
            if take < n:
                pieces.append((d, s + take, n - take))
        out.append(sequence)
    return out


def ranks(corpus: Statistics, seed: int) -> np.ndarray:
    """An order of all terms in which rare ones tend to be early: exponential variates with rates of idf^2.

    Two documents have the same first term with a probability of their common share of these weights (a weighted MinHash).
    """
    u = np.random.default_rng(seed).random(len(corpus.idf))
    return -np.log1p(-u) / np.maximum(corpus.idf.astype(float), 1e-6) ** 2


def stored(ids: np.ndarray) -> bytes:
    """Ids in two bytes each, or, if one needs more, in four bytes each and a last byte that makes the length odd."""
    return ids.astype("<u2").tobytes() if ids.max(initial=0) < 1 << 16 else ids.astype("<u4").tobytes() + b"\0"


def restored(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4", len(raw) // 4) if len(raw) % 2 else np.frombuffer(raw, "<u2")


def tokenised(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (as `stored`), n and content (a hash of the ids) of each document; df, the documents with each term, in a row of its own for each task."""
    key = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_for(path)
        df, type_of = np.zeros(1, np.int64), None
        last, place = np.zeros(1, np.int32), np.zeros(0, np.int32)
        names = ["doc_id", "ids", "n", "content", "df"]
        for batch in batches:
            type_of = batch.column("doc_id").type
            raw, n, content = [], [], []
            for text in encoded(batch.column("text")):
                x = np.append(vocabulary.ids(text.decode()), np.uint32(END))
                if (top := int(x.max())) >= len(df):
                    df, last = np.append(df, np.zeros(top + 1 - len(df), np.int64)), np.zeros(top + 1, np.int32)
                if len(x) > len(place):
                    place = np.arange(2 * len(x), dtype=np.int32)
                last[x] = place[: len(x)]
                df[x[last[x] == place[: len(x)]]] += 1  # each term at its last place in the text
                raw.append(stored(x))
                n.append(len(x))
                content.append(int.from_bytes(hashlib.blake2b(raw[-1], digest_size=8).digest(), "little", signed=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary()), pa.array(n, pa.int64()), pa.array(content, pa.int64()), pa.nulls(len(n), pa.list_(pa.int64()))], names=names)
        if type_of is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, type_of), *(pa.nulls(1, t) for t in (pa.binary(), pa.int64(), pa.int64())), pa.array([df], pa.list_(pa.int64()))], names=names)

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, ids binary, n long, content long, df array<long>")


def statistics(table: DataFrame) -> Statistics:
    """Of a table of tokenised documents; an array over the vocabulary is all that reaches the driver."""
    total = table.where("ids IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    found = table.where("df IS NOT NULL").select(F.posexplode("df").alias("term", "c")).where("c > 0").groupBy("term").agg(F.sum("c").alias("c")).toArrow()
    term, c = found.column("term").to_numpy(), found.column("c").to_numpy()
    df = np.zeros(int(term.max()) + 1 if len(term) else 1)
    df[term] = c
    return Statistics(total["n"], total["tokens"], df)


def counted(shard_tokens: int) -> int:
    """The tokens that a document counts at least where shards are filled."""
    return shard_tokens // SHARD_ROWS


def dealt(table: DataFrame, corpus: Statistics, shard_tokens: int) -> tuple[DataFrame, int]:
    """The documents with their shard, and the number of shards.

    Documents go by their first term in an order of `ranks`, and neighbours in this order fill a shard. A term with more tokens than a shard
    takes several, by the content of the documents; a content of more tokens than a shard is dealt by doc_id, too. A document counts `counted` tokens.
    """
    size = F.sum(F.greatest("n", F.lit(counted(shard_tokens)))).alias("n")
    rank = table.sparkSession.sparkContext.broadcast(ranks(corpus, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("ids").to_pylist()
            if not raw:
                continue
            parts = [restored(r) for r in raw]
            x = np.concatenate(parts)
            begin = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))
            r = rank.value[x]
            least = np.minimum.reduceat(r, begin)
            at = np.flatnonzero(r == np.repeat(least, np.diff(np.append(begin, len(x)))))
            first = x[at[np.searchsorted(at, begin)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first.astype(np.int64))], names=[*batch.schema.names, "term"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.drop("df").schema)
    documents = table.where("ids IS NOT NULL").drop("df").mapInArrow(run, f"{kept}, term long")
    sizes = {r["term"]: r["n"] for r in documents.groupBy("term").agg(size).collect()}
    shard, shards, room = {}, 0, 0
    for term in sorted(sizes, key=lambda t: rank.value[t]):
        if sizes[term] > shard_tokens:
            pieces = -(-sizes[term] // shard_tokens)
            shard[term] = shards, pieces
            shards, room = shards + pieces, 0
            continue
        if sizes[term] > room:
            shards, room = shards + 1, shard_tokens
        shard[term] = shards - 1, 1
        room -= sizes[term]
    spark = table.sparkSession
    places = spark.createDataFrame([(t, s, p) for t, (s, p) in shard.items()], "term long, first long, pieces long")
    # at most one content for each shard_tokens of the corpus
    heavy = [r["content"] for r in table.where("ids IS NOT NULL").groupBy("content").agg(size).where(F.col("n") > shard_tokens).collect()] if any(p > 1 for _, p in shard.values()) else []
    alone = spark.createDataFrame([(c,) for c in heavy], "content long").withColumn("heavy", F.lit(True))
    out = documents.join(F.broadcast(places), "term").join(F.broadcast(alone), "content", "left")
    salt = F.when(F.col("heavy"), F.xxhash64("doc_id")).otherwise(F.col("content"))
    return out.select("doc_id", "ids", (F.col("first") + F.pmod(F.xxhash64(salt), F.col("pieces"))).alias("shard")), shards


def pack_documents(documents: DataFrame, tokenizer: str | None = None, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, with_ids: bool = False) -> DataFrame:
    """For each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, its ids.

    The rows and sequence_id, which has the shard in its upper bits, don't depend on the partitions of the documents.
    """
    arrow_batches(documents.sparkSession)
    key = documents.schema["doc_id"].dataType.simpleString()
    table = written(tokenised(documents, tokenizer or default_path()))
    shared = statistics(table)
    shards, n = dealt(table, shared, shard_tokens)
    shared = documents.sparkSession.sparkContext.broadcast(shared)
    least = counted(shard_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids, total, current, sequence_id = [], [], 0, None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence_id, names, ids, total
            doc, rows = [], []
            pieces = []
            for sequence in pack(ids, window, shared.value):
                offset = 0
                for d, start, length in sequence:
                    part = ids[d][start : start + length]
                    doc.append(names[d])
                    rows.append((start, length, zlib.crc32(part.astype("<u4").tobytes()), len(ids[d]), sequence_id, offset))
                    if with_ids:
                        pieces.append(part.astype(np.int32))
                    offset += length
                sequence_id += 1
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc, type_of), *columns, *([pa.array(pieces, pa.list_(pa.int32()))] if with_ids else [])], names=["doc_id", *(c.split()[0] for c in SCHEMA.split(", ")), *["ids"] * with_ids])
            names, ids, total = [], [], 0

        for batch in batches:
            type_of = batch.column("doc_id").type
            for name, raw, shard in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "shard")), strict=True):
                x = restored(raw)
                size = max(len(x), least)
                if ids and (shard != current or total + size > shard_tokens):
                    yield from flush()
                if shard != current:
                    current, sequence_id = shard, shard << 32
                names.append(name)
                ids.append(x)
                total += size
        if ids:
            yield from flush()

    together = shards.repartitionById(max(1, n), F.col("shard").cast("int")).sortWithinPartitions("shard", "doc_id", "ids")
    return together.mapInArrow(run, f"doc_id {key}, {SCHEMA}" + ", ids array<int>" * with_ids)
