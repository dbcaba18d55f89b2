"""Benchmark decontamination by a broadcast hash set of normalised n-grams of the benchmark.

Words: runs of ASCII digits, letters (A-Z lower-cased) and characters that are not ASCII. A window is n
consecutive words of an item; an item of fewer words, but not none, is one window.

Defined results: a null or empty text has no words and no hits. A null item text has no windows. Repeated
items with one id count once in n_items; a null item_id is left out of the list of items, but its words are
hit. Repeated document rows each get a row. Very long texts are whole; an Arrow batch has one of them at a time. Without items or documents
nothing is hit. Other columns are passed by, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, U64, Words, map_texts, mix, total_bytes

WINDOW = 10
#: Bytes of item texts in one broadcast; more are scanned in blocks of that size.
BLOCK_BYTES = 8 << 20
_STEP = U64(0xC2B2AE3D27D4EB4F)


class Windows:
    """The windows of one block of items, in arrays: hashes by length, with the words for the check of a hit and the items of each window.

    Memory: about 8 + 4 * n + 8 bytes a word of the items.
    """

    def __init__(self, items: list[tuple[object, str | None]], n: int):
        words = Words([(t or "").encode() for _, t in items], ALNUM)
        self.names = [None if i is None else str(i) for i, _ in items]
        self.vocabulary, ids = np.unique(words.hash, return_inverse=True)
        ids = ids.astype(np.int32) + 1
        at = np.searchsorted(words.text, np.arange(len(items) + 1))
        lengths = np.minimum(n, np.diff(at))
        self.by_length = {}
        for length in np.unique(lengths[lengths > 0]).tolist():
            own = np.flatnonzero(lengths == length)
            count = np.diff(at)[own] - length + 1
            first = np.repeat(at[own] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            item = np.repeat(own, count).astype(np.int32)
            hashes = rolled(ids, length)[first]
            order = np.lexsort((item, hashes))
            self.by_length[length] = (hashes[order], np.stack([ids[first[order] + k] for k in range(length)], 1), item[order])

    def hits(self, words: Words, n_texts: int) -> tuple[np.ndarray, list[set]]:
        """A mask of the hit words, and each text's items. The words decide, a window's hash only finds them."""
        hit = np.zeros(len(words.start), bool)
        items: list[set] = [set() for _ in range(n_texts)]
        if not (len(self.vocabulary) and len(hit)):
            return hit, items
        at = np.minimum(np.searchsorted(self.vocabulary, words.hash), len(self.vocabulary) - 1)
        ids = np.where(self.vocabulary[at] == words.hash, at + 1, 0).astype(np.int32)
        known = np.concatenate(([0], np.cumsum(ids == 0)))
        for length, (hashes, rows, item) in self.by_length.items():
            m = len(ids) - length + 1
            if m <= 0:
                continue
            may = np.flatnonzero((known[length:] == known[:m]) & (words.text[:m] == words.text[length - 1 :]))
            if not len(may):
                continue
            h = rolled(ids, length)[may]
            low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
            place = np.repeat(may, high - low)
            slot = np.repeat(low - np.concatenate(([0], np.cumsum(high - low)[:-1])), high - low) + np.arange(len(place))
            true = np.ones(len(place), bool)
            for k in range(length):
                true &= rows[slot, k] == ids[place + k]
            place, slot = place[true], slot[true]
            for k in range(length):
                hit[place + k] = True
            for text, owner in np.unique(np.stack([words.text[place], item[slot]], 1), axis=0).tolist():
                if self.names[owner] is not None:
                    items[text].add(self.names[owner])
        return hit, items


def rolled(ids: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` ids."""
    m = len(ids) - length + 1
    h = np.zeros(max(m, 0), U64)
    x = ids.astype(U64)
    for i in range(length):
        h = h * _STEP + x[i : m + i]
    return mix(h)


def without(text: bytes, start: np.ndarray, end: np.ndarray, hit: np.ndarray) -> bytes:
    """The text without its runs of hit words; what is between two hit words goes too."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    out, at = [], 0
    for a, b in zip(edge[0::2], edge[1::2], strict=True):
        out.append(text[at : start[a]])
        at = end[b - 1]
    return b"".join([*out, text[at:]])


def _blocks(benchmark: DataFrame, n: int, block_bytes: int) -> list:
    """The broadcast windows of the items, in blocks of about block_bytes of text."""
    spark = benchmark.sparkSession
    _, size = total_bytes(benchmark, "text")
    blocks = max(1, -(-size // block_bytes))
    own = benchmark.select("item_id", "text")
    parts = [own] if blocks == 1 else [own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) for k in range(blocks)]
    return [spark.sparkContext.broadcast(Windows([tuple(r) for r in part.collect()], n)) for part in parts]


_KEY = ["_h1", "_h2"]


def _text_key(df: DataFrame) -> DataFrame:
    """df with two hashes of its text, by which what the blocks find is united: a hit is a matter of the text alone, so equal rows need no id."""
    return df.withColumn("_h1", F.xxhash64("text")).withColumn("_h2", F.xxhash64(F.lit(1), "text"))


def _united(documents: DataFrame, blocks: list) -> DataFrame:
    """_h1, _h2, positions (of hit words) and items of each text that any block hits."""

    def make_for(shared):
        def make():
            def work(texts: list[bytes], _rows: pa.RecordBatch) -> dict:
                words = Words(texts, ALNUM)
                hit, items = shared.value.hits(words, len(texts))
                at = np.searchsorted(words.text, np.arange(len(texts) + 1))
                return {"positions": pa.array([np.flatnonzero(hit[a:b]).astype(np.int32) for a, b in zip(at[:-1], at[1:], strict=True)], pa.list_(pa.int32())), "items": pa.array([sorted(s) for s in items], pa.list_(pa.string()))}

            return work

        return make

    own = _text_key(documents.select("text"))
    each = [map_texts(own, make_for(shared), "positions array<int>, items array<string>", _KEY).where(F.size("positions") > 0).dropDuplicates(_KEY) for shared in blocks]
    union = each[0]
    for other in each[1:]:
        union = union.unionByName(other)
    return union.groupBy(*_KEY).agg(F.array_distinct(F.flatten(F.collect_list("positions"))).alias("positions"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def report(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each document: `keep`, n_words, n_hit, items (sorted strings of item ids) and, if asked, clean_text.

    A benchmark of up to block_bytes of text is one broadcast and one pass over the documents, without a shuffle. A larger one is broadcast in
    blocks, a pass for each, so it takes more time but no more memory; what they hit is united by hashes of the texts
    and joined to the documents. Only hits are shuffled, and rows are told apart by nothing but their text.
    """
    blocks = _blocks(benchmark, n, block_bytes)
    several = len(blocks) > 1

    def make():
        def work(texts: list[bytes], rows: pa.RecordBatch) -> dict:
            words = Words(texts, ALNUM)
            n_words = words.counts(len(texts))
            at = np.searchsorted(words.text, np.arange(len(texts) + 1))
            if several:
                hit, items = np.zeros(len(words.start), bool), [set(x or ()) for x in rows.column("_found_items").to_pylist()]
                for k, places in enumerate(rows.column("_found_positions").to_pylist()):
                    if places:
                        hit[at[k] + np.array(places)] = True
            else:
                hit, items = blocks[0].value.hits(words, len(texts))
            n_hit = np.bincount(words.text[hit], minlength=len(texts))
            out = {"n_words": n_words.astype(np.int64), "n_hit": n_hit.astype(np.int64), "items": pa.array([sorted(s) for s in items], pa.list_(pa.string()))}
            if with_text:
                out["clean_text"] = pa.array([without(t, words.start[a:b] - o, words.end[a:b] - o, hit[a:b]).decode() if k else t.decode() for t, a, b, o, k in zip(texts, at[:-1], at[1:], words.offsets, n_hit, strict=False)], pa.string())
            return out

        return work

    schema = "n_words long, n_hit long, items array<string>" + ", clean_text string" * with_text
    if not several:
        return map_texts(documents, make, schema, list(keep))
    united = _united(documents, blocks).select(*_KEY, F.col("positions").alias("_found_positions"), F.col("items").alias("_found_items"))
    joined = _text_key(documents.select(*keep, "text")).join(united, _KEY, "left")
    return map_texts(joined, make, schema, [*keep, "_found_positions", "_found_items"]).drop("_found_positions", "_found_items")


def digest(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """The report as doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    return report(documents, benchmark, n).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, remove: str = "documents", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents without those that hold a window (remove="documents") or without the hit spans (remove="spans").

    All columns of the documents are kept.
    """
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_document"), F.col("text").alias("text"))
    found = report(packed, benchmark, n, ("_document",), with_text=remove == "spans", block_bytes=block_bytes)
    if remove == "documents":
        return found.where(F.col("n_hit") == 0).select("_document.*")
    return found.select(*[F.col("clean_text").alias("text") if c == "text" else F.col("_document")[c].alias(c) for c in documents.columns])


def brute_force(documents: list[tuple], benchmark: list[tuple], n: int = WINDOW) -> list[tuple]:
    """The digest over lists of (id, text), word by word; for tests."""
    import re

    def split(text):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    out = []
    for doc_id, text in documents:
        words, hit, items = split(text), set(), set()
        for item, passage in benchmark:
            w = split(passage)
            k = min(n, len(w))
            grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
            for i in range(len(words) - k + 1 if k else 0):
                if tuple(words[i : i + k]) in grams:
                    hit.update(range(i, i + k))
                    items.add(item)
        names = sorted(map(str, items - {None}))
        out.append((doc_id, len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out
