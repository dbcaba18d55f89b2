"""Images made from expressions: sample tables for `sink.from_samples`, and pages for `sink.write_bytes`."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import image
from .sink import Page


def samples(spark: SparkSession, path: str, width: int, height: int, values: list[Column], page: int = 0) -> DataFrame:
    """path, ifd, row and samples of an image whose samples are expressions over the columns x and y. Rows are made in parallel."""
    pixel = F.array(*[v.cast("double") for v in values])
    grid = spark.range(height).select(F.col("id").cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    cells = grid.select("y", "x", pixel.alias("s"))
    rows = cells.groupBy("y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "s"))), lambda c: c["s"]).alias("samples"))
    return rows.select(F.lit(path).alias("path"), F.lit(page).alias("ifd"), F.col("y").alias("row"), "samples")


def gradient(width: int, height: int, bits: int = 8) -> Page:
    """Grey from black at the left to white at the right."""
    top = (1 << bits) - 1
    line = (np.arange(width) * top) // max(1, width - 1)
    return Page(np.repeat(line[None, :, None], height, 0), image.MINISBLACK, bits)


def ramp_palette(width: int, height: int) -> Page:
    """Rows of a palette of 256 colours."""
    i = np.arange(256)
    return Page(np.repeat((np.arange(height) % 256)[:, None, None], width, 1), image.PALETTE, 8, colormap=[(i * 257).tolist(), ((255 - i) * 257).tolist(), ((i * 2 % 256) * 257).tolist()])


def stripes(width: int, height: int, period: int = 8) -> Page:
    """One-bit stripes."""
    return Page(np.repeat(((np.arange(width) // period) % 2)[None, :, None], height, 0), image.MINISWHITE, 1)


def bitonal(page: Page, threshold: int = 500) -> Page:
    """White where red, green and blue add up to more than the threshold."""
    m = image.Meta(page.array.shape[1], page.array.shape[0], page.bits, page.array.shape[2], page.sample_format, page.photometric, extra_samples=page.extra_samples, colormap=page.colormap)
    total = image.to_rgba(page.array, m)[..., :3].astype(int).sum(2)
    return Page((total > threshold).astype(int)[:, :, None], image.MINISBLACK, 1, resolution=page.resolution)


def to_8_bits(page: Page) -> Page:
    """16-bit samples rounded to 8 bits."""
    if page.bits != 16:
        return page
    return Page((page.array.astype(np.int64) * 2 + 257) // 514, page.photometric, 8, 1, page.orientation, page.extra_samples, resolution=page.resolution, tags=page.tags)


def multiplied(page: Page, factor: int) -> Page:
    """Samples times a factor, modulo their width."""
    return Page((page.array.astype(np.int64) * factor) % (1 << page.bits), page.photometric, page.bits, 1, page.orientation, page.extra_samples, resolution=page.resolution, tags=page.tags)


def to_bitmap(page: Page, channels: int = 3) -> bytes:
    """Rows of blue, green, red (and alpha), each filled up to 4 bytes, as bitmaps hold them."""
    m = image.Meta(page.array.shape[1], page.array.shape[0], page.bits, page.array.shape[2], page.sample_format, page.photometric, extra_samples=page.extra_samples, colormap=page.colormap)
    rgba = image.to_rgba(page.array, m)
    out = rgba[..., [2, 1, 0, 3][:channels]].reshape(rgba.shape[0], -1)
    return np.pad(out, ((0, 0), (0, -out.shape[1] % 4))).tobytes()
