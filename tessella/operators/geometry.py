"""Geometry of strips and tiles as column expressions over whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import running_total


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if isinstance(x, (int, float)) else F.col(x)


def div(a, b) -> Column:
    """Whole-number division of numbers that aren't negative."""
    return F.call_function("div", _c(a).cast("long"), _c(b).cast("long"))


def ceil_div(a, b) -> Column:
    return div(_c(a) + _c(b) - 1, b)


def round_up(a, b) -> Column:
    return ceil_div(a, b) * _c(b)


def strip_of(row, rows_per_strip, plane=0, strips_per_plane=0) -> Column:
    return div(row, rows_per_strip) + _c(plane) * _c(strips_per_plane)


def tile_of(x, y, width, height, tile_width, tile_height, z=0, depth=1, tile_depth=1, plane=0) -> Column:
    """The tile that holds (x, y, z) of a plane."""
    across, down, deep = ceil_div(width, tile_width), ceil_div(height, tile_height), ceil_div(depth, tile_depth)
    return across * down * deep * _c(plane) + across * down * div(z, tile_depth) + across * div(y, tile_height) + div(x, tile_width)


def tile_in_bounds(x, y, width, height, z=0, depth=1, plane=0, planes=1) -> Column:
    return (_c(x) < _c(width)) & (_c(y) < _c(height)) & (_c(z) < _c(depth)) & (_c(plane) < _c(planes)) & (_c(x) >= 0) & (_c(y) >= 0) & (_c(z) >= 0) & (_c(plane) >= 0)


def scanline_bytes(width, samples, bits, contiguous: bool = True) -> Column:
    return ceil_div(_c(width) * (_c(samples) if contiguous else F.lit(1)) * _c(bits), 8)


def subsampled_strip_bytes(width, rows, bits, horizontal, vertical) -> Column:
    """Bytes of a strip of YCbCr with chroma shared by horizontal x vertical pixels."""
    luma = ceil_div(round_up(width, horizontal) * round_up(rows, vertical) * _c(bits), 8)
    return luma + 2 * div(luma, _c(horizontal) * _c(vertical))


def chop_strips(strips: DataFrame, size: str, target: int = 8192) -> DataFrame:
    """Splits long strips into pieces of `target` bytes: piece, piece_offset and piece_bytes."""
    pieces = strips.where(F.col(size) > 0).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), div(F.col(size) - 1, target))))
    return pieces.withColumn("piece_offset", F.col("piece") * target).withColumn("piece_bytes", F.least(F.lit(target).cast("long"), F.col(size) - F.col("piece_offset")))


def chunk_offsets(chunks: DataFrame, keys: list[str], order: str, size: str, first: int = 8) -> DataFrame:
    """Offsets of chunks that lie one after another, each at an even place; a file may have any number of chunks."""
    even = chunks.withColumn("_even", F.col(size) + F.pmod(F.col(size), F.lit(2)))
    return running_total(even, keys, order, "_even", "chunk_offset").withColumn("chunk_offset", F.col("chunk_offset") + first).drop("_even")


def bytecount_looks_bad(first, offset, file_size, second=None, expected=None) -> Column:
    """Whether a byte count is 0 without reason, or beyond the file, or (raw data in one strip) too small for the geometry."""
    bad = (_c(first) == 0) & (_c(offset) != 0)
    if second is not None:
        bad = bad | ((_c(second) == 0) & (_c(first) != 0))
    bad = bad | (_c(first) > _c(file_size) - _c(offset))
    return bad if expected is None else bad | (_c(first) < _c(expected))


def checked_product(a, b) -> Column:
    """A product of whole numbers of 32 bits, or 0 where it doesn't fit in 32 bits."""
    product = _c(a).cast("long") * _c(b).cast("long")
    return F.when(product.between(-(1 << 31), (1 << 31) - 1), product).otherwise(F.lit(0).cast("long"))


def packed_scanline_bytes(width, samples, bits, horizontal, vertical) -> Column:
    """The older rule's and the newer rule's bytes of a row, as a struct (old, new).

    The old one counts all samples of a row. The new one is the bytes of a pack of chroma-sharing rows over their number. Overflows are 0.
    """
    old = ceil_div(checked_product(checked_product(bits, width), samples), 8)
    pack = ceil_div(ceil_div(width, horizontal) * (_c(horizontal) * _c(vertical) + 2) * _c(bits), 8)
    return F.struct(old.alias("old"), div(pack, vertical).alias("new"))


def tile_edges(tile, width, height, tile_width: int, tile_height: int) -> Column:
    """Whether a tile of one plane lies over the right and the bottom edge, and its width and height within the image: a struct (right, bottom, w, h)."""
    across = ceil_div(width, tile_width)
    x, y = F.pmod(_c(tile), across), div(tile, across)
    w, h = F.least(F.lit(tile_width).cast("long"), _c(width) - x * tile_width), F.least(F.lit(tile_height).cast("long"), _c(height) - y * tile_height)
    return F.struct((w < tile_width).alias("right"), (h < tile_height).alias("bottom"), w.alias("w"), h.alias("h"))
