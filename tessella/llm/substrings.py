"""Exact removal of repeated substrings with a suffix array by linear grouping.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. Repeats of SHORT bytes, about 50 words, are reported, too. Candidates
come first: in each string of SHORT bytes the k-gram of the least hash is its anchor, so equal strings have equal anchors at equal places. Anchors whose k-gram
occurs once are left out. A region is the run of strings that have one anchor, with LENGTH bytes from each of their starts. Equal regions are one with a
count, so only different ones of an anchor meet. Their blocks of BLOCK bytes, counted from the anchor, are the symbols of a sequence, each
with its place and content as they are. The common prefixes of its suffix array decide: two strings are equal if their whole blocks
are a common prefix and the bytes before and behind these blocks are the same. No string is compared by a hash.

All regions of an anchor meet in one task, unless there are more than HOT different ones. Then the strings are dealt by halves of their places
before the anchor; the strings of a half have more bytes in common, which are their longer anchor. That goes on until an anchor has few
regions, or a region is one string, so no task has more than HOT different regions of an anchor.

Defined results: a null or empty text has no bytes and keeps none; a text of fewer than LENGTH bytes is kept whole.
Repeated rows are occurrences of their own, so repeated rows of LENGTH bytes or more are removed whole. Rows are told
apart by doc_id and text. Very long texts are whole; they are looked at in overlapping segments. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, arrow_batches, encoded, mix, powers, prefix_sums, written
from .suffix_array import common_prefixes, suffix_array

LENGTH, SHORT, GRAM, BLOCK = 400, 256, 64, 32
#: Bytes of text that are looked at together; longer texts are cut with an overlap.
SEGMENT = 1 << 19
#: Different regions of one anchor that meet in a task.
HOT = 3000
#: Keys that are broadcast at most (8 bytes each).
BROADCAST_KEYS = 4_000_000
#: Bytes of regions in one suffix array, if they aren't of one anchor.
ARRAY_BYTES = 3 << 20
#: Region hashes that a task remembers at most, so that it sends the bytes of equal regions once.
SEEN = 200_000


def string_hashes(sums: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[start + length] - sums[start]) * down[start])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values."""
    n = len(x)
    pad = -n % width
    full = np.append(x, np.full(pad, np.iinfo(np.uint64).max, U64)).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


class Anchors:
    """Anchors of some texts: key, text, first string, number of strings and the anchor's own place, in bytes of the text."""

    def __init__(self, texts: list[bytes], length: int = SHORT, gram: int = GRAM):
        parts = []
        batch: list[tuple[int, int, bytes]] = []
        size = 0
        for i, t in enumerate(texts):
            for s in range(0, len(t) - length + 1, SEGMENT):
                piece = t[s : s + SEGMENT + length - 1]
                if size + len(piece) > SEGMENT and batch:
                    parts.append(self._find(batch, length, gram))
                    batch, size = [], 0
                batch.append((i, s, piece))
                size += len(piece)
        if batch:
            parts.append(self._find(batch, length, gram))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 5
        self.key, self.text, self.start, self.count, self.anchor = columns

    @staticmethod
    def _find(batch: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple:
        data = np.frombuffer(b"".join(p for _, _, p in batch), np.uint8)
        sizes = np.array([len(p) for _, _, p in batch])
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        h = string_hashes(prefix_sums(data), np.arange(len(data) - gram + 1), gram)
        place_bits = U64((1 << 22) - 1)
        least = sliding_least((h & ~place_bits) | np.arange(len(h), dtype=U64), length - gram + 1)
        at = (least & place_bits).astype(np.int64)  # the anchor of the string at each place
        n_strings = sizes - length + 1
        p = np.arange(n_strings.sum()) + np.repeat(begins - np.concatenate(([0], np.cumsum(n_strings)[:-1])), n_strings)
        of = np.repeat(np.arange(len(batch)), n_strings)
        a = at[p]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (of[1:] != of[:-1]))))
        count = np.diff(np.append(first, len(p)))
        of = of[first]
        text, shift = np.array([i for i, _, _ in batch]), np.array([s for _, s, _ in batch]) - begins
        return h[a[first]].view(np.int64), text[of], p[first] + shift[of], count, a[first] + shift[of]


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))


def repeated_keys(documents: DataFrame) -> DataFrame:
    """Anchor keys that occur more than once."""
    arrow_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, c = np.unique(Anchors(encoded(batch.column("text"))).key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c)], names=["key", "n"])

    return documents.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")


REGION = "key long, region_hash long, start long, n_strings int, anchor int, region binary"


def _digest(piece: bytes, anchor: int, n_strings: int) -> int:
    """A name of 64 bits for a region; equal regions have equal ones."""
    return int.from_bytes(hashlib.blake2b(piece + anchor.to_bytes(4, "little") + n_strings.to_bytes(4, "little"), digest_size=8).digest(), "little", signed=True)


def regions(documents: DataFrame) -> DataFrame:
    """doc_id, h and the regions of anchors that occur more than once; `anchor` counts from the region's start. Of equal regions of a task some have no bytes."""
    spark = documents.sparkSession
    arrow_batches(spark)
    keyed = _keyed(documents)
    keys = written(repeated_keys(keyed))
    id_type = documents.schema["doc_id"].dataType.simpleString()
    small = keys.count() <= BROADCAST_KEYS
    if small:
        shared = spark.sparkContext.broadcast(np.sort(keys.toArrow().column("key").to_numpy()))

    def rows(batch: pa.RecordBatch, texts: list[bytes], found: Anchors, keep: np.ndarray, seen: set[int]) -> pa.RecordBatch:
        of, start, count = found.text[keep], found.start[keep], found.count[keep]
        anchor = found.anchor[keep] - start
        pieces, hashes = [], []
        for i, s, c, a in zip(of.tolist(), start.tolist(), count.tolist(), anchor.tolist(), strict=True):
            piece = texts[i][s : s + c + LENGTH - 1]
            h = _digest(piece, a, c)
            hashes.append(h)
            pieces.append(None if h in seen else piece)
            if len(seen) < SEEN:
                seen.add(h)
        pick = pa.array(of)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pick), batch.column("h").take(pick), pa.array(found.key[keep]), pa.array(hashes, pa.int64()), pa.array(start), pa.array(count.astype(np.int32)), pa.array(anchor.astype(np.int32)), pa.array(pieces, pa.binary())], names=["doc_id", "h", *(c.split()[0] for c in REGION.split(", "))])

    def broadcasted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shared.value, set()
        for batch in batches:
            texts = encoded(batch.column("text"))
            found = Anchors(texts)
            if len(known) and len(found.key):
                at = np.minimum(np.searchsorted(known, found.key), len(known) - 1)
                yield rows(batch, texts, found, known[at] == found.key, seen)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts, own = encoded(batch.column("text")), batch.column("keys").to_pylist()
            found = Anchors(texts)
            wanted = [set(k) for k in own]
            keep = np.fromiter((k in wanted[i] for k, i in zip(found.key.tolist(), found.text.tolist(), strict=True)), bool, len(found.key))
            yield rows(batch, texts, found, keep, seen)

    schema = f"doc_id {id_type}, h long, {REGION}"
    if small:
        return keyed.mapInArrow(broadcasted, schema)

    # too many keys for a broadcast: each document gets a list of its own ones by joins
    def of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Anchors(encoded(batch.column("text")))
            pick = pa.array(found.text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pick), batch.column("h").take(pick), pa.array(found.key)], names=["doc_id", "h", "key"])

    pairs = keyed.mapInArrow(of_documents, f"doc_id {id_type}, h long, key long").distinct().join(keys, "key")
    lists = pairs.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_list("key").alias("keys"))
    joined = keyed.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("doc_id", "h", "text", "keys")
    return joined.mapInArrow(listed, schema)


class Strings:
    """The strings of some regions: the suffix array over their blocks, and for a length which strings occur more than once."""

    def __init__(self, pieces: list[bytes], counts: list[int], anchors: list[int], n_strings: list[int], keys: list[int], block: int = BLOCK):
        self.block = block
        self.size = np.array([len(p) for p in pieces], np.int64)
        data = b"".join(pieces)
        self.begin = np.concatenate(([0], np.cumsum(self.size)))[:-1]
        self.lead = np.array(anchors, np.int64) % block
        # symbols: a number for each different (key, place from the anchor, content)
        symbols: list[int] = []
        self.first = np.empty(len(pieces), np.int64)
        names: dict = {}
        key, used = None, len(pieces)
        for i, (piece, lead, anchor) in enumerate(zip(pieces, self.lead.tolist(), anchors, strict=True)):
            if keys[i] != key:
                key, names = keys[i], {}
            self.first[i] = len(symbols)
            place = -(anchor // block)
            for at in range(lead, len(piece) - block + 1, block):
                name = (place, piece[at : at + block])
                symbol = names.get(name)
                if symbol is None:
                    names[name] = symbol = used
                    used += 1
                symbols.append(symbol)
                place += 1
            symbols.append(i)  # an end of its own keeps common prefixes within the region
        text = np.array(symbols, np.int64)
        sa = suffix_array(text)
        self.shared = common_prefixes(text, sa)
        self.rank = np.empty(len(text), np.int64)
        self.rank[sa] = np.arange(len(text))
        self.longest = np.maximum(self.shared, np.append(self.shared[1:], 0))[self.rank]
        padded = np.frombuffer(data + bytes(block + 8), np.uint8)
        self.words = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))  # eight bytes from each place on
        self.counts = np.array(counts, float)
        n = np.array(n_strings, np.int64)
        self.of = np.repeat(np.arange(len(pieces)), n)
        self.place = np.arange(n.sum()) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)

    def _bytes(self, at: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        """Up to a block of n bytes from each place, in columns of eight."""
        out = []
        for k in range(0, self.block, 8):
            some = np.clip(n - k, 0, 8).astype(np.uint64)
            mask = np.where(some == 8, U64(0xFFFFFFFFFFFFFFFF), (U64(1) << (some * U64(8))) - U64(1))
            out.append(self.words[at + k] & mask)
        return out

    def repeated(self, length: int) -> np.ndarray:
        """For each string whether its first `length` bytes are whole in its region and occur more than once."""
        out = np.zeros(len(self.of), bool)
        before = (self.lead[self.of] - self.place) % self.block  # bytes before the first whole block
        whole = (length - before) // self.block
        at = self.first[self.of] + (self.place + before - self.lead[self.of]) // self.block
        at = np.minimum(at, len(self.rank) - 1)
        inside = self.place + length <= self.size[self.of]
        out[inside] = self.counts[self.of[inside]] > 1
        may = np.flatnonzero(inside & (self.longest[at] >= whole))
        for w in np.unique(whole[may]).tolist():
            own = may[whole[may] == w]
            group = np.cumsum(self.shared < w)[self.rank[at[own]]]  # suffixes with a common prefix of w blocks
            code = group * self.block + before[own]
            start = self.begin[self.of[own]] + self.place[own]
            rest = length - before[own] - w * self.block
            columns = self._bytes(start, before[own]) + self._bytes(start + length - rest, rest)
            todo = np.arange(len(own))
            while len(todo):  # the first string of each group, and those equal to it; then the others
                _, first, inverse = np.unique(code[todo], return_index=True, return_inverse=True)
                model = todo[first[inverse]]
                same = np.ones(len(todo), bool)
                for c in columns:
                    same &= c[todo] == c[model]
                total = np.bincount(inverse[same], self.counts[self.of[own[todo[same]]]])
                out[own[todo[same]]] |= total[inverse[same]] > 1
                todo = todo[~same]
        return out

    def masks(self, length: int) -> list[np.ndarray]:
        """The same, region by region."""
        return np.split(self.repeated(length), np.flatnonzero(np.diff(self.of)) + 1) if len(self.of) else []


def spans_of(mask: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the bytes that marked strings cover, one for each run of strings."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edge[0::2], edge[1::2] + length - 1


SPANS = "a array<long>, b array<long>, c array<long>, d array<long>"


def region_spans(several: DataFrame) -> DataFrame:
    """key, region_hash and the spans of repeated strings of LENGTH (a to b) and SHORT bytes (c to d) of regions that have any; a key's regions meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            key, region_hash, n, n_strings, anchor, region = zip(*rows, strict=True)
            strings = Strings(region, n, anchor, n_strings, key)
            out = [(k, g, *spans_of(x, LENGTH), *spans_of(y, SHORT)) for k, g, x, y in zip(key, region_hash, strings.masks(LENGTH), strings.masks(SHORT), strict=True) if y.any()]
            if out:
                k, g, *spans = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(g, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in spans)], names=["key", "region_hash", "a", "b", "c", "d"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "region_hash", "n", "n_strings", "anchor", "region")), strict=True):
                if size > ARRAY_BYTES and row[0] != held[-1][0]:
                    yield from flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield from flush(held)

    columns = several.select("key", "region_hash", "n", "n_strings", "anchor", "region")
    return columns.repartition("key").sortWithinPartitions("key", "region_hash").mapInArrow(run, f"key long, region_hash long, {SPANS}")


def _equal_spans(alone: DataFrame) -> DataFrame:
    """The spans of regions that are the only one of their key: if they occur more than once, all their whole strings do."""
    one, none = lambda x: F.array(x.cast("long")), F.array().cast("array<long>")
    size = F.col("size")

    def last(length: int) -> Column:  # the end of the last whole string of the region, less than `length` without one
        return F.least(F.col("n_strings") + length - 1, size)

    span = lambda length, x: F.when(last(length) >= length, one(x)).otherwise(none)
    repeated = alone.where((F.col("n") > 1) & (size >= SHORT))
    return repeated.select("key", "region_hash", span(LENGTH, F.lit(0)).alias("a"), span(LENGTH, last(LENGTH)).alias("b"), span(SHORT, F.lit(0)).alias("c"), span(SHORT, last(SHORT)).alias("d"))


def _halves(hot: DataFrame) -> DataFrame:
    """The regions of hot keys as two each, by halves of the strings' places before the anchor (low to high): their own key, region_hash, shift and low, high; of, of_hash name the region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["of", "of_hash", "key", "region_hash", "n", "n_strings", "anchor", "region", "low", "high", "shift"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
        for batch in batches:
            out = []
            for key, region_hash, n, n_strings, anchor, region, low, high in zip(*(batch.column(c).to_pylist() for c in ("key", "region_hash", "n", "n_strings", "anchor", "region", "low", "high")), strict=True):
                middle = (low + high) // 2
                for l, h in ((low, middle), (middle + 1, high)):
                    first, last = max(0, anchor - h), min(n_strings - 1, anchor - l)
                    if first > last:
                        continue
                    common = region[anchor - l : anchor - h + SHORT]  # what all strings of this half hold
                    sub = int.from_bytes(hashlib.blake2b(common + l.to_bytes(4, "little") + h.to_bytes(4, "little"), digest_size=8).digest(), "little", signed=True)
                    piece = region[first : last + LENGTH]
                    out.append((key, region_hash, sub, _digest(piece, anchor - first, last - first + 1), n, last - first + 1, anchor - first, piece, l, h, first))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(names), types, strict=True)], names=names)

    return hot.mapInArrow(run, "of long, of_hash long, key long, region_hash long, n long, n_strings int, anchor int, region binary, low int, high int, shift long")


def _merged(rows: DataFrame) -> DataFrame:
    """Different regions with their counts, a row each."""
    return rows.groupBy("key", "region_hash").agg(*[F.max(c).alias(c) for c in ("n_strings", "anchor", "low", "high")], F.sum("n").alias("n"), F.first("region", ignorenulls=True).alias("region"))


def _single_spans(single: DataFrame) -> DataFrame:
    """Spans of regions of one string each that share its first SHORT bytes with others; equal strings of LENGTH bytes are equal regions."""
    whole = (F.col("n") > 1) & (F.octet_length("region") >= LENGTH)
    one, none = lambda x: F.array(F.lit(x).cast("long")), F.array().cast("array<long>")
    return single.select("key", "region_hash", F.when(whole, one(0)).otherwise(none).alias("a"), F.when(whole, one(LENGTH)).otherwise(none).alias("b"), one(0).alias("c"), one(SHORT).alias("d"))


def _by_regions(regions_: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Spans of the regions of keys with one and with several different ones, and the keys of more than HOT (None without any)."""
    counts = written(regions_.groupBy("key").agg(F.count(F.lit(1)).alias("regions")))
    kind = lambda condition: counts.where(condition).select("key")
    sized = lambda df: F.broadcast(df) if df.count() <= BROADCAST_KEYS else df
    hot = sized(kind(F.col("regions") > HOT))
    # only the bytes of regions that meet others are shuffled
    alone = regions_.select("key", "region_hash", "n", "n_strings", F.octet_length("region").alias("size")).join(kind("regions = 1"), "key")
    several = regions_.join(sized(kind((F.col("regions") > 1) & (F.col("regions") <= HOT))), "key")
    return _equal_spans(alone), region_spans(several), None if hot.isEmpty() else hot


def all_region_spans(different: DataFrame) -> DataFrame:
    """The spans of all different regions, those of hot keys by halves of their strings, again and again."""
    equal, several, hot = _by_regions(different)
    spans = equal.unionByName(several)
    parts, current = None, different
    while hot is not None:
        chosen = current.join(hot, "key", "left_semi")
        split = written(_halves(chosen.where("low < high")))
        names = split.select("of", "of_hash", "key", "region_hash", "shift")
        if parts is None:
            parts = names.select(F.col("of").alias("key0"), F.col("of_hash").alias("hash0"), "key", "region_hash", "shift")
        else:
            ended = parts.join(_single_spans(chosen.where("low = high")), ["key", "region_hash"])
            spans = spans.unionByName(_shifted(ended, "key0", "hash0"))
            parts = written(parts.join(names.select(F.col("of").alias("key"), F.col("of_hash").alias("region_hash"), F.col("key").alias("key1"), F.col("region_hash").alias("hash1"), F.col("shift").alias("more")), ["key", "region_hash"]).select("key0", "hash0", F.col("key1").alias("key"), F.col("hash1").alias("region_hash"), (F.col("shift") + F.col("more")).alias("shift")))
        current = written(_merged(split))
        equal, several, hot = _by_regions(current)
        spans = spans.unionByName(_shifted(parts.join(equal.unionByName(several), ["key", "region_hash"]), "key0", "hash0"))
    return spans


def _shifted(rows: DataFrame, key: str, region_hash: str, by: str = "shift") -> DataFrame:
    """Spans moved by a number of bytes, under other names of key and region."""
    return rows.select(F.col(key).alias("key"), F.col(region_hash).alias("region_hash"), *[F.transform(c, lambda x: x + F.col(by)).alias(c) for c in "abcd"])


def repeated_spans(documents: DataFrame) -> DataFrame:
    """doc_id, h, and starts and ends of the removed bytes (a, b) and of the repeats of SHORT bytes (c, d) of each document that has any; they may overlap."""
    found = written(regions(documents))
    named = found.withColumn("n", F.lit(1).cast("long")).withColumn("low", F.lit(0)).withColumn("high", F.lit(SHORT - GRAM))
    different = written(_merged(named))
    spans = all_region_spans(different)
    members = found.select("doc_id", "h", "key", "region_hash", "start")
    placed = members.join(spans, ["key", "region_hash"]).select("doc_id", "h", *[F.transform(c, lambda x: x + F.col("start")).alias(c) for c in "abcd"])
    return placed.groupBy("doc_id", "h").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in "abcd"])


def removed(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_repeated (bytes of repeats of SHORT bytes or more) of each document."""
    return _with_spans(documents, False)


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id and kept (the remaining bytes, which may begin or end within a character) of each document."""
    return _with_spans(documents, True)


def united(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans."""
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(a, kind="stable")
    start, end = np.array(a)[order], np.maximum.accumulate(np.array(b)[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def _with_spans(documents: DataFrame, texts_too: bool) -> DataFrame:
    spans = repeated_spans(documents)
    own = _keyed(documents)
    renamed = spans.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), *"abcd")
    joined = own.join(renamed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left").select("doc_id", "text", *"abcd")
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, a, b, c, d in zip(encoded(batch.column("text")), *(batch.column(x).to_pylist() for x in "abcd"), strict=True):
                first, last = united(a, b)
                kept, at = [], 0
                for s, e in zip(first.tolist(), last.tolist(), strict=True):
                    kept.append(text[at:s])
                    at = e
                kept = b"".join([*kept, text[at:]])
                short = united(c, d)
                rows.append((len(text), int((last - first).sum()), len(first), hashlib.sha256(kept).hexdigest(), int((short[1] - short[0]).sum()), kept))
            size, gone, n, digest, repeated, kept = zip(*rows, strict=True) if rows else ([],) * 6
            if texts_too:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary())], names=["doc_id", "kept"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(repeated, pa.int64())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated"])

    return joined.mapInArrow(run, f"doc_id {id_type}, " + ("kept binary" if texts_too else "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long"))


def brute_force(documents: list[tuple], length: int = LENGTH, short: int = SHORT) -> list[tuple]:
    """The result over a list of (doc_id, text) with every string in one dictionary; for tests."""
    from collections import Counter

    texts = [(t or "").encode() for _, t in documents]

    def covered(size: int) -> list[bytearray]:
        count = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
        out = []
        for t in texts:
            gone = bytearray(len(t))
            for i in range(len(t) - size + 1):
                if count[t[i : i + size]] > 1:
                    gone[i : i + size] = b"\1" * size
            out.append(gone)
        return out

    out = []
    for (doc_id, _), t, gone, short_gone in zip(documents, texts, covered(length), covered(short), strict=True):
        n = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(t)))
        out.append((doc_id, len(t), sum(gone), n, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest(), sum(short_gone)))
    return out
