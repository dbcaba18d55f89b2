"""Colour quantisation and dithering.

The histogram of colours is an ordinary aggregate; the median cut works on its at most 2^15 rows. Ordered dithering and thresholds are column
expressions. Error diffusion carries its error from pixel to pixel, so an image is one group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package

BITS = 5


def color_histogram(pixels: DataFrame, r: str = "r", g: str = "g", b: str = "b") -> DataFrame:
    """Counts of the colours with 5 bits a component: at most 32,768 rows."""
    cell = lambda c: F.shiftright(F.col(c), 8 - BITS)
    return pixels.groupBy(cell(r).alias("r"), cell(g).alias("g"), cell(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def median_cut(colors: np.ndarray, counts: np.ndarray, wanted: int) -> np.ndarray:
    """Up to `wanted` mean colours of boxes: the first half of the cuts goes to the fullest box, the others to the widest one."""
    scale = np.array([2, 3, 1])  # green counts most, blue least
    boxes = [np.arange(len(colors))] if len(colors) else []
    while len(boxes) < wanted:
        spans = [(np.ptp(colors[b], axis=0) * scale).max() for b in boxes]
        open_ = [i for i, s in enumerate(spans) if s > 0]
        if not open_:
            break
        by_count = 2 * len(boxes) <= wanted
        i = max(open_, key=lambda k: counts[boxes[k]].sum() if by_count else spans[k])
        b = boxes.pop(i)
        axis = int(np.argmax(np.ptp(colors[b], axis=0) * scale))
        values = colors[b][:, axis]
        middle = (values.min() + values.max()) // 2
        boxes += [b[values <= middle], b[values > middle]]
    return np.array([np.rint(np.average(colors[b] * 8 + 4, axis=0, weights=counts[b])) for b in boxes]).astype(int)


def palette(pixels: DataFrame, wanted: int = 256) -> list[tuple[int, int, int]]:
    """The colours of a palette for the pixels; the histogram, of at most 32,768 rows, is what reaches the driver."""
    rows = color_histogram(pixels).orderBy("r", "g", "b").toPandas()
    return [tuple(map(int, c)) for c in median_cut(rows[["r", "g", "b"]].to_numpy(int), rows["n"].to_numpy(float), wanted)]


def component_levels(most: int, components: int = 3, order: tuple[int, ...] = (1, 0, 2)) -> list[int]:
    """Levels of each component of a colour grid of at most `most` colours.

    All begin with the same number, the largest that fits. Then each in `order` (green, red, blue) gets one more while that fits, pass after pass.
    """
    base = 1
    while (base + 1) ** components <= most:
        base += 1
    if base < 2:
        raise ValueError(f"a grid of {components} components needs {2**components} colours")
    levels = [base] * components
    grown = True
    while grown:
        grown = False
        for k in order[:components]:
            more = int(np.prod(levels)) // levels[k] * (levels[k] + 1)
            if more > most:
                break
            levels[k], grown = levels[k] + 1, True
    return levels


def grid_color(value: Column, levels: int) -> Column:
    """The nearest of `levels` evenly spread steps from 0 to 255, as the step's number."""
    return F.floor((value * (levels - 1) * 2 + 255) / 510).cast("int")


def nearest(r: Column, g: Column, b: Column, colors: list[tuple[int, int, int]]) -> Column:
    """The number of the nearest colour of a palette, of equally near ones the lowest."""
    distance = lambda c: (r - c[0]) * (r - c[0]) + (g - c[1]) * (g - c[1]) + (b - c[2]) * (b - c[2])
    return F.array_min(F.array(*[F.struct(distance(c).cast("long").alias("d"), F.lit(i).alias("i")) for i, c in enumerate(colors)]))["i"]


def bayer(size: int = 16) -> np.ndarray:
    """The matrix of an ordered dither, built from itself by doubling."""
    m = np.zeros((1, 1), int)
    while len(m) < size:
        m = np.block([[4 * m, 4 * m + 2], [4 * m + 3, 4 * m + 1]])
    return m


def ordered_dither(value: Column, row: Column, col: Column, levels: int = 2, size: int = 16) -> Column:
    """A sample of 0 to 255 as one of `levels` steps, by a threshold of its place."""
    table = F.array(*[F.lit(int(x)) for x in bayer(size).ravel()])
    threshold = F.get(table, (F.pmod(row, F.lit(size)) * size + F.pmod(col, F.lit(size))).cast("int"))
    return F.floor((value * (levels - 1) * size * size + threshold * 255 + 127) / (255 * size * size)).cast("int")


def diffuse(image: np.ndarray, levels: int = 2) -> np.ndarray:
    """Floyd-Steinberg error diffusion of (height, width) samples to `levels` steps, rows in alternating directions."""
    h, w = image.shape
    out = np.zeros((h, w), int)
    below = [0.0] * (w + 2)
    step = 255 / (levels - 1)
    for y in range(h):
        here, below = below, [0.0] * (w + 2)
        forward = y % 2 == 0
        d = 1 if forward else -1
        carry = 0.0
        for x in range(w) if forward else range(w - 1, -1, -1):
            v = float(image[y, x]) + here[x + 1] + carry
            k = min(levels - 1, max(0, int(v / step + 0.5)))
            out[y, x] = k
            e = (v - k * step) / 16
            carry = 7 * e
            below[x + 1 - d] += 3 * e
            below[x + 1] += 5 * e
            below[x + 1 + d] += e
    return out


def error_diffusion(samples: DataFrame, keys: list[str], levels: int = 2) -> DataFrame:
    """keys, row, col and level of the samples (row, col, q) of each image; an image is one group and must fit in a task."""
    ship_package(samples.sparkSession)
    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in samples.select(*keys).schema)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        h, w = int(frame["row"].max()) + 1, int(frame["col"].max()) + 1
        image = np.zeros((h, w))
        image[frame["row"], frame["col"]] = frame["q"]
        out = frame[[*keys, "row", "col"]].copy()
        out["level"] = diffuse(image, levels)[frame["row"], frame["col"]]
        return out

    return samples.select(*keys, F.col("row").cast("long"), F.col("col").cast("long"), "q").groupBy(*keys).applyInPandas(run, f"{key_types}, row long, col long, level long")


def symbol_counts(symbols: DataFrame, symbol: str) -> DataFrame:
    """How often each symbol occurs, for a Huffman code."""
    return symbols.groupBy(symbol).agg(F.count(F.lit(1)).alias("n"))


def huffman_lengths(symbols: DataFrame, symbol: str) -> DataFrame:
    """The code length of each of at most 256 symbols."""
    from ..functions.jpeg import code_lengths

    counts = {int(r[symbol]): int(r["n"]) for r in symbol_counts(symbols, symbol).where(F.col(symbol).between(0, 255)).collect()}
    spark = symbols.sparkSession
    return spark.createDataFrame(sorted(code_lengths(counts).items()), f"{symbol} int, length int")
