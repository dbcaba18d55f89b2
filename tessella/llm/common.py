"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import math
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package

U64 = np.uint64
#: Odd base of the polynomial hash and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Sub-batches of this many bytes of text bound the temporary arrays of a Python worker.
SLICE_BYTES = 1 << 19
#: Bytes and rows of an Arrow batch. Texts may be long, so the bytes are what bounds a worker's memory; one longer text is a batch of its own.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1000


def arrow_batches(spark: SparkSession) -> None:
    """Readies a session for work on texts in Python: ships the package, and bounds Arrow batches so that long texts fit in a worker.

    Plans read these settings when they run, after this function, so they stay lowered in the session; values that are lower already are kept.
    """
    ship_package(spark)
    for key, default, most in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "2147483647", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name, default).lower().rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Only in a session of one process, as in tests, an unset one is a new temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="shared-")
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder that the session names."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder that the session names: smaller than a checkpoint, and read by columns."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64); x is uint64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS = {"n": 0, "up": np.ones(1, U64), "down": np.ones(1, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i up to n at least, kept between calls."""
    if _POWERS["n"] < n:
        n = max(n, 1 << 16)
        up, down = np.full(n + 1, U64(BASE)), np.full(n + 1, U64(BASE_INVERSE))
        up[0] = down[0] = U64(1)
        _POWERS.update(n=n, up=np.cumprod(up), down=np.cumprod(down))
    return _POWERS["up"], _POWERS["down"]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of the polynomial hash over the prefixes of some bytes, from which `hash_spans` works."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    terms = data.astype(U64)
    terms += U64(1)
    terms *= up[: len(data)]
    np.cumsum(terms, out=sums[1:])
    return sums


def hash_spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans at once, from the data's prefix sums. Equal contents and lengths give equal hashes."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words of ASCII digits and letters, and all that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
NOT_SPACE = ~_SPACE


class Words:
    """Words of some texts: hashes, byte spans and the text that each belongs to."""

    __slots__ = ("data", "end", "hash", "offsets", "start", "sums", "text")

    def __init__(self, texts: list[bytes], kind: np.ndarray = NOT_SPACE):
        joined = b" ".join(texts) + b" "
        self.data = _LOWER[np.frombuffer(joined, np.uint8)]
        inside = kind[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        self.text = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.sums = prefix_sums(self.data)
        self.hash = hash_spans(self.sums, self.start, self.end)

    def counts(self, n_texts: int) -> np.ndarray:
        return np.bincount(self.text, minlength=n_texts)


def shingles(words: Words, n_texts: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words and their texts; a text of fewer words, but not none, has its whole sequence as one."""
    h, text = words.hash, words.text
    with np.errstate(over="ignore"):
        if len(h) >= n:
            m = len(h) - n + 1
            out = np.zeros(m, U64)
            for i in range(n):
                out = (out + h[i : m + i]) * U64(0xC2B2AE3D27D4EB4F)
                out ^= out >> U64(29)
            whole = text[: m] == text[n - 1 :]
            out, of = mix(out[whole]), text[:m][whole]
        else:
            out, of = np.zeros(0, U64), np.zeros(0, np.int64)
        count = words.counts(n_texts)
        few = np.flatnonzero((count > 0) & (count < n))
        if len(few):
            first = np.searchsorted(text, few)
            extra = []
            for t, s in zip(few, first, strict=True):
                v = U64(count[t])
                for x in h[s : s + count[t]]:
                    v = (v + x) * U64(0xC2B2AE3D27D4EB4F)
                    v ^= v >> U64(29)
                extra.append(v)
            out, of = np.concatenate((out, mix(np.array(extra, U64)))), np.concatenate((of, few))
            order = np.argsort(of, kind="stable")
            out, of = out[order], of[order]
    return out, of


def distinct_by_text(h: np.ndarray, of: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, concatenated, and the offsets of the texts."""
    ends = np.searchsorted(of, np.arange(n_texts + 1))
    parts = [np.unique(h[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), offsets


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together; a longer text is alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[bytes], pa.RecordBatch], dict]], schema: str, keep: list[str], text: str = "text") -> DataFrame:
    """Runs make()(texts, rows), which gives columns, over slices of df; `keep` are input columns that it returns first.

    `make` is called once for a task. Only `keep` and the text column are read.
    """
    arrow_batches(df.sparkSession)
    names = list(dict.fromkeys([*keep, text]))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[F.col(f"`{c}`") for c in keep]).schema]
    out = ", ".join([*kept, schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = encoded(batch.column(text))
            for a, b in slices(texts):
                part = batch.slice(a, b - a)
                made = work(texts[a:b], part)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for v in made.values())], names=[*keep, *made])

    return df.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, out)


def total_bytes(df: DataFrame, *columns: str) -> tuple[int, int]:
    """Rows of df and bytes of some of its string columns: one small aggregate."""
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)).cast("long") for c in columns), F.lit(0).cast("long"))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


#: Tasks that add up arrays; each sends one to the driver.
ADDERS = 32


def added(arrays: DataFrame) -> np.ndarray | None:
    """The sum of arrays of one length, one in each row (sums array<double>), or None without any. They are added in ADDERS tasks, and one array of each reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("sums"):
                x = x.values.to_numpy(zero_copy_only=False)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])

    found = arrays.select("sums").repartition(ADDERS).mapInArrow(run, "sums array<double>").toArrow().column("sums")
    total = None
    for x in found.combine_chunks() if len(found) else []:
        x = x.values.to_numpy(zero_copy_only=False)
        total = x.copy() if total is None else total + x
    return total


def give_back() -> None:
    """Gives freed memory of this process back to the system, where the C library has a call for it; else a driver keeps what a fit took for good."""
    with contextlib.suppress(OSError, AttributeError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def parts_for(size: int, each: int, least: int = 1) -> int:
    """Partitions that hold about `each` bytes."""
    return max(least, math.ceil(size / each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
