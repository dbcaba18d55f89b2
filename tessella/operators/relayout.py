"""Re-layout of sample tables: planes, tiles, rotation, flips, crops, resampling and bias subtraction.

Coordinates are computed, so rotation, flips, crops and tile numbers need no shuffle; only what gathers samples of a
chunk or joins two images does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import div, tile_of


def rotate(samples: DataFrame, degrees: int, width: Column, height: Column) -> DataFrame:
    """Turns clockwise by 90, 180 or 270 degrees: new row and col."""
    row, col = F.col("row"), F.col("col")
    to = {90: (col, height - 1 - row), 180: (height - 1 - row, width - 1 - col), 270: (width - 1 - col, row)}[degrees]
    return samples.withColumns({"row": to[0], "col": to[1]})


def flip(samples: DataFrame, horizontal: bool, size: Column) -> DataFrame:
    name = "col" if horizontal else "row"
    return samples.withColumn(name, size - 1 - F.col(name))


#: Orientation tags: whether rows run upwards, columns run leftwards, and rows and columns change places.
ORIENTATIONS = {1: (False, False, False), 2: (False, True, False), 3: (True, True, False), 4: (True, False, False), 5: (False, False, True), 6: (False, True, True), 7: (True, True, True), 8: (True, False, True)}


def orient(samples: DataFrame, orientation: int, width: Column, height: Column, swap: bool = False) -> DataFrame:
    """Moves samples of an image with this orientation tag to the top-left origin; rows and columns change places only if asked."""
    up, left, swapped = ORIENTATIONS[orientation]
    out = samples
    if up:
        out = flip(out, False, height)
    if left:
        out = flip(out, True, width)
    return out.withColumns({"row": F.col("col"), "col": F.col("row")}) if swapped and swap else out


def crop(samples: DataFrame, row: int, col: int, height: int, width: int) -> DataFrame:
    """The samples of a rectangle, counted from its corner."""
    inside = samples.where(F.col("row").between(row, row + height - 1) & F.col("col").between(col, col + width - 1))
    return inside.withColumns({"row": F.col("row") - row, "col": F.col("col") - col})


def to_planes(pixels: DataFrame, samples: Column, keys: list[str]) -> DataFrame:
    """A row for each sample of the pixels' arrays: keys, plane, value."""
    return pixels.select(*keys, F.posexplode(samples).alias("plane", "value"))


def to_pixels(planes: DataFrame, keys: list[str], n_planes: int) -> DataFrame:
    """The samples of n planes side by side: keys, s0, s1, ... One shuffle, with the planes combined before it."""
    return planes.groupBy(*keys).agg(*[F.max(F.when(F.col("plane") == i, F.col("value"))).alias(f"s{i}") for i in range(n_planes)])


def to_tiles(samples: DataFrame, value: str, width, height, tile_width: int, tile_height: int, keys: list[str] | None = None) -> DataFrame:
    """Gathers the samples of each tile in order: tile, values and places (the values' places in the tile, which an edge tile doesn't fill). A tile's size bounds its arrays."""
    keys = keys or []
    placed = samples.withColumn("tile", tile_of("col", "row", width, height, tile_width, tile_height))
    place = F.pmod(F.col("row"), F.lit(tile_height)) * tile_width + F.pmod(F.col("col"), F.lit(tile_width))
    gathered = placed.groupBy(*keys, "tile").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), F.col(value).alias("value")))).alias("cells"))
    return gathered.select(*keys, "tile", F.transform("cells", lambda c: c["value"]).alias("values"), F.transform("cells", lambda c: c["place"]).alias("places"))


def from_tiles(tiles: DataFrame, width: Column, tile_width: int, tile_height: int, keys: list[str] | None = None) -> DataFrame:
    """The samples of tiles with their rows and columns; without places the tiles are full."""
    across = div(width + tile_width - 1, tile_width)
    cells = tiles.select(*(keys or []), "tile", across.alias("across"), *([F.col("places")] if "places" in tiles.columns else []), F.posexplode("values").alias("place", "value"))
    if "places" in tiles.columns:
        cells = cells.withColumn("place", F.get("places", F.col("place")))
    row = div("tile", F.col("across")) * tile_height + div("place", tile_width)
    col = F.pmod(F.col("tile"), F.col("across")) * tile_width + F.pmod(F.col("place"), F.lit(tile_width))
    return cells.select(*(keys or []), row.alias("row"), col.alias("col"), "value").where(F.col("col") < width)


def subtract_bias(image: DataFrame, bias: DataFrame, bits: int, keys: list[str], value: str = "q", keep: list[str] | None = None) -> DataFrame:
    """The image less the bias image, modulo 2^bits, with `keep` (by default the keys). Spark picks the join; a bias below its broadcast threshold isn't shuffled."""
    return image.join(bias.select(*keys, F.col(value).alias("bias")), keys).select(*(keep or keys), F.pmod(F.col(value) - F.col("bias"), F.lit(1 << bits)).alias(value))


def downsample(samples: DataFrame, keys: list[str], value: str = "q", vertical: int = 2, horizontal: int = 2) -> DataFrame:
    """The rounded mean of each box."""
    boxes = samples.groupBy(*keys, div("row", vertical).alias("row"), div("col", horizontal).alias("col")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    return boxes.select(*keys, "row", "col", div(F.col("total") + div("n", 2), "n").alias(value))


def upsample(samples: DataFrame, vertical: int = 1, horizontal: int = 2) -> DataFrame:
    """Repeats each sample over a box."""
    wide = samples.withColumn("_v", F.explode(F.sequence(F.lit(0), F.lit(vertical - 1)))).withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(horizontal - 1))))
    return wide.withColumns({"row": F.col("row") * vertical + F.col("_v"), "col": F.col("col") * horizontal + F.col("_h")}).drop("_v", "_h")
