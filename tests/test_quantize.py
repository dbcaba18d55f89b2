import numpy as np
from pyspark.sql import functions as F

from tessella.functions import jpeg
from tessella.operators import quantize


def test_palette(spark):
    rows = [(200, 10, 10)] * 50 + [(10, 200, 10)] * 30 + [(10, 10, 200)] * 20
    pixels = spark.createDataFrame(rows, "r long, g long, b long")
    assert quantize.color_histogram(pixels).count() == 3
    colors = quantize.palette(pixels, 3)
    assert sorted(colors) == [(12, 12, 204), (12, 204, 12), (204, 12, 12)]
    named = pixels.select(quantize.nearest(F.col("r"), F.col("g"), F.col("b"), colors).alias("i")).groupBy("i").count().collect()
    assert sorted(r["count"] for r in named) == [20, 30, 50]
    assert len(quantize.palette(pixels, 2)) == 2


def test_dithers(spark):
    assert sorted(quantize.bayer(8).ravel()) == list(range(64))
    grey = spark.createDataFrame([(1, y, x, 64) for y in range(32) for x in range(32)], "image long, row long, col long, q long")
    share = grey.select(quantize.ordered_dither(F.col("q"), F.col("row"), F.col("col")).alias("v")).agg(F.avg("v")).first()[0]
    assert abs(share - 64 / 255) < 0.01
    found = quantize.error_diffusion(grey, ["image"])
    assert abs(found.agg(F.avg("level")).first()[0] - 64 / 255) < 0.02
    assert quantize.diffuse(np.full((3, 3), 255)).tolist() == [[1] * 3] * 3


def test_huffman(spark):
    symbols = spark.createDataFrame([(s,) for s in [1] * 8 + [2] * 4 + [3] * 2 + [4]], "s int")
    lengths = dict(tuple(r) for r in quantize.huffman_lengths(symbols, "s").collect())
    assert lengths == jpeg.code_lengths({1: 8, 2: 4, 3: 2, 4: 1})
    assert lengths[1] <= lengths[2] <= lengths[3] <= lengths[4]


def test_huffman_bounded_lengths_follow_counts():
    """Where codes are cut to 16 bits, no symbol has a longer code than a rarer one."""
    counts = {q: n for q in range(256) if (n := round(1e6 * np.exp(-(((q - 128) / 10) ** 2) / 2)))}
    lengths = jpeg.code_lengths(counts)
    by_length = {k: [counts[s] for s in lengths if lengths[s] == k] for k in set(lengths.values())}
    assert max(by_length) == 16
    assert all(min(by_length[a]) >= max(by_length[b]) for a in by_length for b in by_length if a < b)
    assert sum(2.0**-k for k in lengths.values()) + 2.0**-16 == 1
