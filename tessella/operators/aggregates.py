"""Aggregates over samples: histograms, checksums and constancy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The modulus of Adler-32.
ADLER = 65521


def histogram(samples: DataFrame, value: str, shift: int = 3) -> DataFrame:
    """Counts of the values' upper bits; partial counts come first, so at most 2^bits rows of a partition are shuffled."""
    return samples.groupBy(F.shiftright(F.col(value), shift).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def most_popular(bins: DataFrame) -> DataFrame:
    """The bin of the highest count, of equal ones the lowest."""
    return bins.orderBy(F.desc("n"), "bin").limit(1)


def adler32(values: Column) -> Column:
    """The checksum of an array of bytes, in whole sums that a long holds for arrays up to 2^27."""
    n = F.size(values).cast("long")
    total = F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)
    weighted = F.aggregate(F.zip_with(values, F.sequence(F.lit(0).cast("long"), n - 1), lambda v, i: v * (n - i)), F.lit(0).cast("long"), lambda s, x: s + x)
    a, b = F.pmod(total + 1, F.lit(ADLER)), F.pmod(n + weighted, F.lit(ADLER))
    return b * 65536 + a


def spread_within(values: Column, most: int) -> Column:
    """Whether an array's values differ by at most `most`."""
    return F.array_max(values) - F.array_min(values) <= most


def stream_size(chunks: DataFrame, keys: list[str], size: str, trimmed: int = 4, head: int = 2) -> DataFrame:
    """Bytes of a stream that joins chunks, each without its first and last marks, after a head: keys and total."""
    return chunks.groupBy(*keys).agg((F.sum(F.greatest(F.col(size) - trimmed, F.lit(0))) + head).alias("total"))
