"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

A document's shingles (five words split at ASCII white space, A-Z lower-cased; fewer words are one shingle)
are hashed once. The upper bits of a hash name its bin, and a bin keeps its least hash. An empty bin
copies that of a bin which a universal hash of its own number picks, again and again until one has a value. Each bin's value
is hashed with the bin's number, so copies of one value keep bits of their own, and BITS low-order bits are kept. Two bins
of different values agree by chance with probability 2^-BITS, so the share of agreeing bins is corrected to (share - 2^-BITS) / (1 - 2^-BITS), at least 0.

Defined results: a text without words, null or empty has the empty fingerprint, which is like another empty one (1)
and unlike all others (0). Order is by doc_id, null ids first, ties by text; the next document of the last is the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, arrow_batches, checkpointed, distinct_by_text, encoded, map_texts, mix, parts_for, shingles, slices, total_bytes

BINS, BITS, SHINGLE = 512, 4, 5
#: Bytes of a range of documents, and ranges at most: a number for each of them reaches the driver.
PART_BYTES, MOST_PARTS = 24 << 20, 100_000
_SHIFT = U64(64 - (BINS - 1).bit_length())


def densify(values: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Fills the empty bins of each row from full ones; rows without any stay as they are."""
    values = values.copy()
    open_ = ~full & full.any(1, keepdims=True)
    row, column = np.nonzero(open_)
    attempt = 0
    while len(row):
        attempt += 1
        salt = U64(attempt * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
        pick = (mix(column.astype(U64) * U64(0x9E3779B97F4A7C15) + salt) % U64(values.shape[1])).astype(np.int64)
        found = full[row, pick]
        values[row[found], column[found]] = values[row[found], pick[found]]
        row, column = row[~found], column[~found]
    return values


def kept_bits(values: np.ndarray) -> np.ndarray:
    """The low-order bits of each bin's value, hashed with the bin's number."""
    number = mix(np.arange(values.shape[1], dtype=U64) + U64(0x632BE59BD9B4E019))
    return (mix(values ^ number) & U64((1 << BITS) - 1)).astype(np.uint8)


def fingerprints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The kept bits of each bin, a row for each text, and whether the text has shingles."""
    n = len(texts)
    out, some = np.zeros((n, BINS), np.uint8), np.zeros(n, bool)
    for a, b in slices(texts):
        h, offsets = distinct_by_text(*shingles(Words(texts[a:b]), b - a, SHINGLE), b - a)
        values, full = np.zeros((b - a, BINS), U64), np.zeros((b - a, BINS), bool)
        row = np.repeat(np.arange(b - a), np.diff(offsets))
        bins = (h >> _SHIFT).astype(np.int64)
        first = np.ones(len(h), bool)  # hashes are sorted within a text, so the first of a bin is its least
        first[1:] = (bins[1:] != bins[:-1]) | (row[1:] != row[:-1])
        values[row[first], bins[first]] = h[first]
        full[row[first], bins[first]] = True
        out[a:b] = kept_bits(densify(values, full))
        some[a:b] = np.diff(offsets) > 0
    return out, some


def packed(bits: np.ndarray, some: np.ndarray) -> list[bytes]:
    """The packed bits; none for no shingles."""
    flat = np.unpackbits(bits[:, :, None], axis=2)[:, :, 8 - BITS :].reshape(len(bits), -1)
    return [row.tobytes() if s else b"" for row, s in zip(np.packbits(flat, axis=1), some, strict=True)]


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of fingerprints, row by row."""
    chance = 2.0**-BITS
    found = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)
    return np.where(some_a & some_b, found, (some_a == some_b).astype(float))


def edited(text: str, following: str) -> str:
    """The text whose last quarter is replaced by the first as many characters of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k] if k else text


def compare(texts: list[bytes], following: list[bytes]) -> dict:
    """Columns for documents and the documents that follow them, of which all but the last are in texts, too."""
    changed, chars = [], []
    for t, f in zip(texts, following, strict=True):
        s = t.decode()
        chars.append(len(s))
        changed.append(edited(s, f[: 4 * (len(s) // 4)].decode(errors="ignore")).encode())
    own = fingerprints([*texts, following[-1]]) if texts else fingerprints([])
    new = fingerprints(changed)
    one = own[0][: len(texts)], own[1][: len(texts)]
    return {
        "n_chars": np.array(chars, np.int64), "edited_sha256": pa.array([hashlib.sha256(c).digest() for c in changed], pa.binary()),
        "fingerprint": pa.array(packed(*one), pa.binary()), "edited_fingerprint": pa.array(packed(*new), pa.binary()),
        "near_edited": likeness(*one, *new), "near_next": likeness(*one, own[0][1:], own[1][1:]),
    }


COLUMNS = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each document, without a shuffle."""

    def make():
        return lambda texts, _rows: {"fingerprint": pa.array(packed(*fingerprints(texts)), pa.binary())}

    return map_texts(documents, make, "fingerprint binary", ["doc_id"]).withColumn("fingerprint", F.lower(F.hex("fingerprint")))


def fingerprint_pairs(documents: DataFrame) -> DataFrame:
    """Each document with its fingerprint, that of its edited text, and their likeness to it and to the next document's.

    The documents are dealt out by ranges of doc_id and sorted within them, one shuffle. Only the last document of a
    range has its next one elsewhere; the first and last documents of the ranges, two for each range, meet in a join.
    """
    spark = documents.sparkSession
    arrow_batches(spark)
    _, size = total_bytes(documents, "text")
    parts = min(MOST_PARTS, parts_for(size, PART_BYTES, 2))
    key = documents.schema["doc_id"].dataType.simpleString()
    ranged = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids, texts = None, []

        def rows(kind: str, ids: pa.Array, made: dict | None, text: list[bytes] | None) -> pa.RecordBatch:
            n = len(ids)
            columns = [made[c] if isinstance(made[c], pa.Array) else pa.array(made[c]) for c in names] if made else [pa.nulls(n, t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), pa.array([part] * n, pa.int32()), pa.array([t.decode() for t in text], pa.string()) if text else pa.nulls(n, pa.string()), ids, *columns], names=["kind", "part", "text", "doc_id", *names])

        for batch in batches:
            if not batch.num_rows:
                continue
            own_ids, own = batch.column("doc_id"), encoded(batch.column("text"))
            if ids is None:
                yield rows("head", own_ids.slice(0, 1), None, own[:1])
            else:
                own_ids, own = pa.concat_arrays([ids, own_ids]), texts + own
            for a, b in slices(own[:-1]):
                yield rows("row", own_ids.slice(a, b - a), compare(own[a:b], own[a + 1 : b + 1]), None)
            ids, texts = own_ids.slice(len(own_ids) - 1, 1), own[-1:]
        if ids is not None:
            yield rows("tail", ids, None, texts)

    made = checkpointed(ranged.mapInArrow(run, f"kind string, part int, text string, doc_id {key}, {COLUMNS}"))
    found = sorted(r["part"] for r in made.where("kind = 'head'").select("part").collect())  # numbers of ranges, MOST_PARTS at most
    following = spark.createDataFrame(list(zip(found, found[1:] + found[:1], strict=True)), "part int, next_part int")
    heads = made.where("kind = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    tails = made.where("kind = 'tail'").select("doc_id", "text", "part").join(following, "part").join(heads, "next_part")

    def make():
        def work(texts: list[bytes], rows: pa.RecordBatch) -> dict:
            each = [compare([t], [f]) for t, f in zip(texts, encoded(rows.column("next_text")), strict=True)]
            return {c: pa.concat_arrays([x[c] if isinstance(x[c], pa.Array) else pa.array(x[c]) for x in each]) for c in names}

        return work

    last = map_texts(tails, make, COLUMNS, ["doc_id", "next_text"]).drop("next_text")
    out = made.where("kind = 'row'").select("doc_id", *names).unionByName(last)
    return out.select("doc_id", *[F.lower(F.hex(c)).alias(c) if kind == "binary" else F.col(c) for c, kind in out.dtypes[1:]])


def brute_force(text: str | None) -> list[int]:
    """The kept bits of one text, bin by bin with plain loops; for tests."""
    words = Words([(text or "").encode()])
    h, _ = shingles(words, 1, SHINGLE)
    bins: dict[int, int] = {}
    for x in h.tolist():
        k = x >> int(_SHIFT)
        bins[k] = min(x, bins.get(k, x))
    if not bins:
        return []
    one = lambda x: int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], U64))[0])
    out = []
    for k in range(BINS):
        source, attempt = k, 0
        while source not in bins:
            attempt += 1
            source = one(k * 0x9E3779B97F4A7C15 + attempt * 0xD1B54A32D192ED03) % BINS
        out.append(one(bins[source] ^ one(k + 0x632BE59BD9B4E019)) & (1 << BITS) - 1)
    return out
