"""Predictors over sample tables: differences and running sums modulo 2^bits along a row.

A sample table has one row for each sample: keys of the image row, a column number and a value. The array forms take a
whole image row as one array and need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def difference_array(values: Column, bits: int = 8, stride: int = 1) -> Column:
    """Each value less the one `stride` before it, modulo 2^bits; the first `stride` values stay."""
    before = F.concat(F.array_repeat(F.lit(0).cast("long"), stride), values)
    pairs = F.zip_with(values, F.slice(before, F.lit(1), F.size(values)), lambda a, b: F.pmod(a - b, F.lit(1 << bits)))
    return pairs


#: Samples that are summed up in one array before the next one is begun, times the stride.
_STEP = 64


def running_sum_array(values: Column, bits: int = 8, stride: int = 1) -> Column:
    """The inverse of `difference_array`: sums from the start modulo 2^bits, without a shuffle.

    A row is taken in pieces, each of which goes on from the last sums of the one before it, so the work grows with the row's length.
    """
    size, zeros = _STEP * stride, F.array_repeat(F.lit(0).cast("long"), stride)
    whole = F.transform(values, lambda x: x.cast("long"))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / size).cast("int") - 1, F.lit(0))), lambda k: F.slice(whole, k * size + 1, F.lit(size)))
    summed = lambda carry, piece: F.aggregate(piece, carry, lambda a, x: F.concat(a, F.array(F.pmod(x + F.coalesce(F.get(a, F.size(a) - stride), F.lit(0).cast("long")), F.lit(1 << bits)))))
    carried = lambda s: F.struct(F.slice(s, F.size(s) - stride + 1, F.lit(stride)).alias("carry"), F.slice(s, F.lit(stride + 1), F.greatest(F.size(s) - stride, F.lit(0))).alias("out"))
    start = F.struct(zeros.alias("carry"), F.array().cast("array<array<bigint>>").alias("out"))

    def merge(done: Column, piece: Column) -> Column:
        one = F.transform(F.array(summed(done["carry"], piece)), carried)[0]
        return F.transform(F.array(one), lambda o: F.struct(o["carry"].alias("carry"), F.concat(done["out"], F.array(o["out"])).alias("out")))[0]

    return F.flatten(F.aggregate(pieces, start, merge, lambda done: done["out"]))


def difference(samples: DataFrame, keys: list[str], column: str, value: str, bits: int = 8, stride: int = 1, out: str = "d") -> DataFrame:
    """The same over a sample table, by one window over the image row."""
    w = Window.partitionBy(*keys).orderBy(column)
    return samples.withColumn(out, F.pmod(F.col(value) - F.coalesce(F.lag(value, stride).over(w), F.lit(0)), F.lit(1 << bits)))


def running_sum(samples: DataFrame, keys: list[str], column: str, value: str, bits: int = 8, stride: int = 1, out: str = "q") -> DataFrame:
    """The inverse of `difference`: sums from the row's start modulo 2^bits, for each of the `stride` samples of a pixel."""
    phase = [F.pmod(F.col(column), F.lit(stride))] if stride > 1 else []
    w = Window.partitionBy(*keys, *phase).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn(out, F.pmod(F.sum(value).over(w), F.lit(1 << bits)))


def previous_row_difference(rows: DataFrame, keys: list[str], row: str, values: str, out: str = "d") -> DataFrame:
    """Each value less the one above it, for image rows that are arrays; a row without one above it stays.

    Each row meets the one before it in a join by row number, so the work of one image spreads over all tasks.
    """
    above = rows.select(*keys, (F.col(row) + 1).alias(row), F.col(values).alias("_above"))
    joined = rows.join(above, [*keys, row], "left")
    difference = F.when(F.col("_above").isNull(), F.col(values)).otherwise(F.zip_with(values, "_above", lambda a, b: a - F.coalesce(b, F.lit(0))))
    return joined.withColumn(out, difference).drop("_above")


def runs(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Maximal runs of equal values in order: keys, run (from 0), value and length."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = rows.select(*keys, F.col(value).alias("value"), *order, changed.alias("changed"))
    numbered = marked.withColumn("run", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.groupBy(*keys, "run", "value").agg(F.count(F.lit(1)).alias("length"))
