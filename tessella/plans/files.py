"""Queries over real TIFF bytes, each with the same result in DuckDB SQL.

Ordinary tables are written as files with the library's writer, and read back with its parser, codecs and converters. The pixel raster is that of `twins`:
embeddings as an image of 64 columns, cut into files of ROWS image rows. Tags come from `part` and `orders`, pages from `conversations`.
"""

from __future__ import annotations

import struct
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tools
from ..functions import codecs, color
from ..operators import checks
from ..sources import datasource, generate, pdf, sink, tiff
from ..sources.tiff import Tiff
from ..streaming import ingest
from .twins import _PX, WIDTH, raster, table

ROWS = 48
QUERIES: dict = {}
ORACLES: dict = {}


def _query(sql: str, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        ORACLES[key] = _PX + sql
        return f

    return register


# Pixels through each codec, layout and sample type


def _grouped(q: Column, n: int, value) -> Column:
    """An array of n samples for each pixel of a row's samples."""
    if n == 1:
        return F.transform(q, lambda x: F.array(value(x).cast("double")))
    pixels = F.sequence(F.lit(0), F.lit(WIDTH // n - 1))
    return F.transform(pixels, lambda i: F.transform(F.slice(q, i * n + 1, n), lambda x: value(x).cast("double")))


def pixel_files(spark: SparkSession, sf: str, options: sink.WriteOptions, photometric: int = 1, bits: int = 8, n: int = 1, value=lambda x: x, sample_format: int = 1, rows: DataFrame | None = None, **page) -> DataFrame:
    """path and content of the raster's files; `value` makes a sample of a byte."""
    own = raster(spark, sf) if rows is None else rows
    lines = own.select(F.concat(F.lit("f"), F.floor(F.col("row") / ROWS).cast("string"), F.lit(".tif")).alias("path"), F.lit(0).alias("ifd"), F.pmod(F.col("row"), F.lit(ROWS)).alias("row"), _grouped(F.col("q"), n, value).alias("samples"))
    return sink.from_samples(lines, options, photometric, bits, sample_format, **page)


def _whole_row(row: Column) -> Column:
    """The raster's row of a file's row."""
    return F.regexp_extract("path", r"f(\d+)\.tif", 1).cast("long") * ROWS + row


def pixels(found: Tiff, names: tuple[str, ...] = ("q",), kind: str = "long") -> DataFrame:
    """row, col and the samples of the raster's files."""
    return found.pixels().select(_whole_row(F.col("row")).alias("row"), F.col("col").cast("long").alias("col"), *[F.col("samples")[i].cast(kind).alias(c) for i, c in enumerate(names)])


def colours(found: Tiff, orient: bool = False) -> DataFrame:
    """row, col and 8-bit r, g, b, a of the raster's files."""
    cells = found.rgba(orient).select("path", "row", "x0", F.posexplode("rgba").alias("k", "word"))
    return cells.select(_whole_row(F.col("row")).alias("row"), (F.col("x0") + F.col("k")).cast("long").alias("col"), *[c.cast("long").alias(n) for c, n in zip(color.unpack_rgba(F.col("word").cast("long")), "rgba", strict=True)])


W = sink.WriteOptions


def _round_trip(name: str, options: sink.WriteOptions, bits: int = 8, value=lambda x: x, sql: str = "q", kind: str = "long", sql_kind: str = "BIGINT", **more) -> None:
    @_query(f"SELECT row, col, CAST({sql} AS {sql_kind}) AS q FROM px", f"tiff_{name}")
    def query(spark, sf):
        return pixels(Tiff(pixel_files(spark, sf, options, bits=bits, value=value, **more)), kind=kind)


def _bit(x: Column) -> Column:
    return (x > 127).cast("int")


_BIT = "CASE WHEN q > 127 THEN 1 ELSE 0 END"
LZW, ZIP, PACK = codecs.LZW, codecs.ADOBE_DEFLATE, codecs.PACKBITS

_round_trip("none", W(rows_per_strip=7))
_round_trip("default_strips", W())
_round_trip("packbits", W(PACK, rows_per_strip=5))
_round_trip("lzw", W(LZW, rows_per_strip=9))
_round_trip("lzw_predictor", W(LZW, 2, rows_per_strip=9))
_round_trip("deflate", W(ZIP, level=9))
_round_trip("deflate_old", W(codecs.DEFLATE, 2))
_round_trip("tiles", W(ZIP, tile_width=16, tile_length=32))
_round_trip("edge_tiles", W(LZW, 2, tile_width=48, tile_length=32))
_round_trip("big", W(LZW, big=True, rows_per_strip=4))
_round_trip("big_endian", W(PACK, order=">"))
_round_trip("lsb2msb", W(LZW, fill_order=2))
_round_trip("16_bits", W(ZIP, 2, order=">"), 16, lambda x: x * 257, "q * 257")
_round_trip("16_bits_signed", W(LZW), 16, lambda x: x * 100 - 12000, "q * 100 - 12000", sample_format=2)
_round_trip("24_bits", W(PACK), 24, lambda x: x * 65793, "q * 65793")
_round_trip("32_bits", W(ZIP, 2), 32, lambda x: x * 16843009, "q * 16843009")
_round_trip("2_bits", W(PACK), 2, lambda x: F.shiftright(x, 6), "q >> 6")
_round_trip("3_bits", W(LZW), 3, lambda x: F.shiftright(x, 5), "q >> 5")
_round_trip("4_bits", W(ZIP, fill_order=2), 4, lambda x: F.shiftright(x, 4), "q >> 4")
_round_trip("1_bit", W(tile_width=16, tile_length=16), 1, _bit, _BIT)
_round_trip("float", W(ZIP, 3), 32, lambda x: x * 0.25, "q * 0.25", "double", "DOUBLE", sample_format=3)
_round_trip("float_big_endian", W(LZW, 3, order=">"), 32, lambda x: x * 0.25, "q * 0.25", "double", "DOUBLE", sample_format=3)
_round_trip("double", W(ZIP, 3), 64, lambda x: x / 16 - 3, "CAST(q AS DOUBLE) / 16 - 3", "double", "DOUBLE", sample_format=3)
for _name, _scheme, _options in (("ccitt_rle", codecs.CCITT_RLE, 0), ("ccitt_rlew", codecs.CCITT_RLEW, 0), ("g3", codecs.CCITT_FAX3, 0), ("g3_2d", codecs.CCITT_FAX3, 1), ("g3_fill", codecs.CCITT_FAX3, 4), ("g4", codecs.CCITT_FAX4, 0)):
    _round_trip(_name, W(_scheme, rows_per_strip=11, group3_options=_options), 1, _bit, _BIT, photometric=0)
_round_trip("g4_lsb2msb", W(codecs.CCITT_FAX4, fill_order=2), 1, _bit, _BIT, photometric=0)


def _samples(name: str, options: sink.WriteOptions, **more) -> None:
    @_query("SELECT row, p AS col, r, g, b FROM rgb", f"tiff_{name}")
    def query(spark, sf):
        return pixels(Tiff(pixel_files(spark, sf, options, 2, 8, 3, **more)), ("r", "g", "b"))


_samples("rgb", W(LZW, 2))
_samples("planes", W(PACK, planar=2, rows_per_strip=6))
_samples("planar_tiles", W(ZIP, 2, planar=2, tile_width=16, tile_length=16))


def _invert(data: bytes, *_rest) -> bytes:
    return bytes(255 - x for x in data)


@_query("SELECT row, col, q FROM px")
def tiff_user_codec(spark, sf):
    """A user's codec, which is looked up before the built-in ones."""
    codecs.register_codec(60001, lambda data, _size, _p: _invert(data), lambda data, _p: _invert(data))
    try:
        found = Tiff(pixel_files(spark, sf, W(60001, rows_per_strip=8)))
        return pixels(found)
    finally:
        codecs.unregister_codec(60001)


@_query("SELECT a.row, a.col, b.q FROM px a JOIN px b ON b.row = a.row // 8 * 8 AND b.col = a.col // 8 * 8")
def tiff_jpeg(spark, sf):
    """Blocks of one value, which JPEG at quality 100 keeps exactly."""
    rows = raster(spark, sf)
    first = rows.where(F.pmod(F.col("row"), F.lit(8)) == 0).select(F.col("row").alias("of"), "q")
    blocks = rows.select("row", (F.floor(F.col("row") / 8) * 8).alias("of")).join(first, "of").select("row", F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.get(F.col("q"), (i - F.pmod(i, F.lit(8))).cast("int"))).alias("q"))
    return pixels(Tiff(pixel_files(spark, sf, W(codecs.JPEG, rows_per_strip=16, quality=100), rows=blocks)))


# Conversion to RGBA


def _to_rgba(name: str, sql: str, options: sink.WriteOptions | None = None, orient: bool = False, **files) -> None:
    @_query(sql, f"tiff_rgba_{name}")
    def query(spark, sf):
        return colours(Tiff(pixel_files(spark, sf, options or W(LZW), **files)), orient)


def _grey(v: str) -> str:
    return f"SELECT row, col, CAST(v AS BIGINT) AS r, CAST(v AS BIGINT) AS g, CAST(v AS BIGINT) AS b, CAST(255 AS BIGINT) AS a FROM (SELECT row, col, {v} AS v FROM px)"


_to_rgba("grey", _grey("q"))
_to_rgba("grey4", _grey("((q >> 4) * 255) // 15"), bits=4, value=lambda x: F.shiftright(x, 4))
_to_rgba("grey2", _grey("((q >> 6) * 255) // 3"), bits=2, value=lambda x: F.shiftright(x, 6))
_to_rgba("grey16", _grey("(q * 200) >> 8"), bits=16, value=lambda x: x * 200)
_to_rgba("white_is_zero", _grey("255 - q"), photometric=0)
_to_rgba("bits", _grey("CASE WHEN q > 127 THEN 0 ELSE 255 END"), W(codecs.CCITT_FAX4), photometric=0, bits=1, value=_bit)
_RAMP = np.arange(256)
_to_rgba("palette", "SELECT row, col, q AS r, 255 - q AS g, q * 2 % 256 AS b, CAST(255 AS BIGINT) AS a FROM px", photometric=3, colormap=[(_RAMP * 257).tolist(), ((255 - _RAMP) * 257).tolist(), ((_RAMP * 2 % 256) * 257).tolist()])
_to_rgba("palette8", "SELECT row, col, q AS r, 255 - q AS g, q // 2 AS b, CAST(255 AS BIGINT) AS a FROM px", photometric=3, colormap=[_RAMP.tolist(), (255 - _RAMP).tolist(), (_RAMP // 2).tolist()])
_RGB = "SELECT row, p AS col, r, g, b, CAST(255 AS BIGINT) AS a FROM rgb"
_to_rgba("rgb", _RGB, photometric=2, n=3)
_to_rgba("planes", _RGB, W(PACK, planar=2), photometric=2, n=3)
_to_rgba("rgb16", _RGB, W(ZIP, 2), photometric=2, n=3, bits=16, value=lambda x: x * 257)
_to_rgba("planes16", _RGB, W(ZIP, planar=2, order=">"), photometric=2, n=3, bits=16, value=lambda x: x * 256)
_to_rgba("alpha", "SELECT row, p AS col, (c * k + 127) // 255 AS r, (m * k + 127) // 255 AS g, (y * k + 127) // 255 AS b, k AS a FROM quad", photometric=2, n=4, extra_samples=[2])
_to_rgba("associated_alpha", "SELECT row, p AS col, c AS r, m AS g, y AS b, k AS a FROM quad", photometric=2, n=4, extra_samples=[1])
_to_rgba("cmyk", "SELECT row, p AS col, (255 - k) * (255 - c) // 255 AS r, (255 - k) * (255 - m) // 255 AS g, (255 - k) * (255 - y) // 255 AS b, CAST(255 AS BIGINT) AS a FROM quad", photometric=5, n=4)
_D = [color.fixed(2 - 2 * 0.299), -color.fixed(0.299 * (2 - 2 * 0.299) / 0.587), color.fixed(2 - 2 * 0.114), -color.fixed(0.114 * (2 - 2 * 0.114) / 0.587)]


def _ycbcr(y: str, cb: str, cr: str) -> str:
    return f"""greatest(0, least(255, {y} + ((({cr} - 128) * {_D[0]} + 32768) >> 16))) AS r,
greatest(0, least(255, {y} + ((({cb} - 128) * {_D[3]} + 32768 + ({cr} - 128) * {_D[1]}) >> 16))) AS g, greatest(0, least(255, {y} + ((({cb} - 128) * {_D[2]} + 32768) >> 16))) AS b, CAST(255 AS BIGINT) AS a"""


_to_rgba("ycbcr", f"SELECT row, p AS col, {_ycbcr('r', 'g', 'b')} FROM rgb", photometric=6, n=3)
# chroma of 2 x 2 pixels is the rounded mean of the block
_to_rgba("ycbcr_subsampled", f", chroma AS (SELECT row // 2 AS y, p // 2 AS x, CAST((sum(g) * (4 // count(*)) + 2) // 4 AS BIGINT) AS cb, CAST((sum(b) * (4 // count(*)) + 2) // 4 AS BIGINT) AS cr FROM rgb GROUP BY 1, 2), px3 AS (SELECT row, p, r AS lum, cb, cr FROM rgb JOIN chroma ON y = row // 2 AND x = p // 2) SELECT row, p AS col, {_ycbcr('lum', 'cb', 'cr')} FROM px3", photometric=6, n=3, subsampling=(2, 2))
_to_rgba(
    "lab",
    """, c AS (SELECT row, p, r * 100.0::DOUBLE / 255 AS l, (CASE WHEN g > 127 THEN g - 256 ELSE g END)::DOUBLE AS a, (CASE WHEN b > 127 THEN b - 256 ELSE b END)::DOUBLE AS b FROM rgb),
f AS (SELECT row, p, a, b, CASE WHEN l < 8.856 THEN l * 100.0 / 903.292 ELSE 100.0 * pow((l + 16) / 116, 3) END AS y, CASE WHEN l < 8.856 THEN 7.787::DOUBLE * ((l * 100.0 / 903.292) / 100.0) + 16.0::DOUBLE / 116 ELSE (l + 16) / 116 END AS k FROM c),
xyz AS (SELECT row, p, y, CASE WHEN k + a / 500 < 0.2069 THEN 96.425::DOUBLE * (k + a / 500 - 0.13793) / 7.787 ELSE 96.425::DOUBLE * pow(k + a / 500, 3) END AS x, CASE WHEN k - b / 200 < 0.2069 THEN 82.468::DOUBLE * (k - b / 200 - 0.13793) / 7.787 ELSE 82.468::DOUBLE * pow(k - b / 200, 3) END AS z FROM f),
lin AS (SELECT row, p, 3.2410::DOUBLE * x - 1.5374::DOUBLE * y - 0.4986::DOUBLE * z AS r, -0.9692::DOUBLE * x + 1.8760::DOUBLE * y + 0.0416::DOUBLE * z AS g, 0.0556::DOUBLE * x - 0.2040::DOUBLE * y + 1.0570::DOUBLE * z AS b FROM xyz)
SELECT row, p AS col, """
    + ", ".join(f"CAST(greatest(0, least(255, floor(255 * pow(floor((greatest(1.0, least(100.0, {c})) - 1) * 1500 / 99) / 1500, 1 / 2.4::DOUBLE) + 0.5))) AS BIGINT) AS {c}" for c in "rgb")
    + ", CAST(255 AS BIGINT) AS a FROM lin",
    photometric=8,
    n=3,
)
_HEIGHT = ", h AS (SELECT row // 48 AS f, count(*) // 64 AS h FROM px GROUP BY 1), o AS (SELECT row // 48 * 48 AS first, row % 48 AS y, h, col, q FROM px JOIN h ON f = row // 48)"
for _o, _y, _x in ((2, "y", "63 - col"), (3, "h - 1 - y", "63 - col"), (4, "h - 1 - y", "col"), (6, "y", "63 - col"), (8, "h - 1 - y", "col")):
    _to_rgba(f"orientation_{_o}", _HEIGHT + f" SELECT first + {_y} AS row, {_x} AS col, q AS r, q AS g, q AS b, CAST(255 AS BIGINT) AS a FROM o", W(PACK, rows_per_strip=10), True, orientation=_o)


# Tables of files, directories, chunks and rows


def _raw(spark, sf) -> Tiff:
    return Tiff(pixel_files(spark, sf, W(rows_per_strip=10)))


_FILES = ", fs AS (SELECT row // 48 AS f, count(*) // 64 AS h FROM px GROUP BY 1)"


@_query(_FILES + " SELECT 'f' || f || '.tif' AS path, 'MM' AS byte_order, CAST(43 AS BIGINT) AS version, true AS is_big, CAST(0 AS BIGINT) AS n_errors FROM fs")
def tiff_files(spark, sf):
    found = Tiff(pixel_files(spark, sf, W(PACK, big=True, order=">"))).files()
    return found.select("path", "byte_order", F.col("version").cast("long").alias("version"), "is_big", F.size("errors").cast("long").alias("n_errors"))


@_query(_FILES + " SELECT 'f' || f || '.tif' AS path, CAST(64 AS BIGINT) AS width, h AS height, 8 AS bits, 1 AS samples, 1 AS photometric, 1 AS compression, least(10, h) AS rows_per_strip, (h + 9) // 10 AS n_chunks, false AS is_tiled, true AS is_last FROM fs")
def tiff_dirs(spark, sf):
    long = lambda c, name: F.col(c).cast("long").alias(name)
    return _raw(spark, sf).dirs().select("path", long("width", "width"), long("height", "height"), long("bits_per_sample", "bits"), long("samples_per_pixel", "samples"), long("photometric", "photometric"), long("compression", "compression"), long("rows_per_strip", "rows_per_strip"), long("n_chunks", "n_chunks"), "is_tiled", (F.col("next_ifd") == 0).alias("is_last"))


@_query(_FILES + " SELECT 'f' || f || '.tif' AS path, ((64 + 15) // 16) * ((h + 31) // 32) AS n_chunks, 3 * ((64 // 3 + 15) // 16) * ((h + 15) // 16) AS n_planar FROM fs")
def tiff_chunk_counts(spark, sf):
    count = lambda t, name: t.dirs().select("path", F.col("n_chunks").cast("long").alias(name))
    tiled = Tiff(pixel_files(spark, sf, W(tile_width=16, tile_length=32)))
    planar = Tiff(pixel_files(spark, sf, W(planar=2, tile_width=16, tile_length=16), 2, 8, 3))
    return count(tiled, "n_chunks").join(count(planar, "n_planar"), "path")


_STRIPS = _FILES + ", st AS (SELECT f, h, CAST(unnest(range((h + 9) // 10)) AS BIGINT) AS chunk FROM fs)"


@_query(_STRIPS + " SELECT 'f' || f || '.tif' AS path, chunk, chunk * 10 AS y0, least(10, h - chunk * 10) AS h, 8 + chunk * 640 AS \"offset\", 64 * least(10, h - chunk * 10) AS bytecount FROM st")
def tiff_chunks(spark, sf):
    return _raw(spark, sf).chunks().select("path", *[F.col(c).cast("long").alias(c) for c in ("chunk", "y0", "h", "offset", "bytecount")])


_HEX = " SELECT 'f' || row // 48 || '.tif' AS path, row % 48 // 10 AS chunk, string_agg(printf('%02X', q), '' ORDER BY row, col) AS data FROM px GROUP BY 1, 2"


@_query(_HEX)
def tiff_raw_chunks(spark, sf):
    """Chunks as they are in the file."""
    return _raw(spark, sf).chunks(raw=True).select("path", F.col("chunk").cast("long").alias("chunk"), F.hex("raw").alias("data"))


@_query(_HEX)
def tiff_decoded(spark, sf):
    """Decoded chunks, the last strip short."""
    found = Tiff(pixel_files(spark, sf, W(LZW, 2, rows_per_strip=10))).decoded()
    return found.select("path", F.col("chunk").cast("long").alias("chunk"), F.hex("data").alias("data"))


@_query(" SELECT row, col, q FROM px WHERE row % 48 BETWEEN 16 AND 31 AND col BETWEEN 32 AND 47")
def tiff_tile_at(spark, sf):
    """The tile that holds x = 40, y = 20: no other is decoded."""
    found = Tiff(pixel_files(spark, sf, W(ZIP, tile_width=16, tile_length=16))).prune(rows=(20, 20), columns=(40, 40))
    cells = found.rows().select("path", "row", "x0", F.posexplode("samples").alias("k", "s"))
    return cells.select(_whole_row(F.col("row")).alias("row"), (F.col("x0") + F.col("k")).cast("long").alias("col"), F.col("s")[0].cast("long").alias("q"))


@_query(" SELECT row, col, q FROM px WHERE row % 48 BETWEEN 17 AND 22")
def tiff_scanlines(spark, sf):
    """Some rows: strips that hold none of them aren't decoded."""
    return pixels(Tiff(pixel_files(spark, sf, W(PACK, rows_per_strip=5))).prune(rows=(17, 22)))


@_query(_FILES + ", st AS (SELECT f, h, CAST(unnest(range((h + 3) // 4)) AS BIGINT) AS chunk FROM fs) SELECT 'f' || f || '.tif' AS path, chunk, chunk * 4 AS y0, least(4, h - chunk * 4) AS h, 8 + chunk * 256 AS \"offset\" FROM st")
def tiff_chop(spark, sf):
    """One raw strip read as strips of 256 bytes."""
    found = Tiff(pixel_files(spark, sf, W(rows_per_strip=ROWS)), tiff.Options(chop=256))
    return found.chunks().select("path", *[F.col(c).cast("long").alias(c) for c in ("chunk", "y0", "h", "offset")])


def _patched(files: DataFrame, change) -> DataFrame:
    """Files whose bytes a function changes."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "content": [change(bytes(c)) for c in frame["content"]]})

    return files.mapInPandas(run, "path string, content binary")


def _entry(data: bytes, tag: int) -> int:
    """The place of a tag's entry in the first directory of a little-endian file."""
    at = struct.unpack_from("<I", data, 4)[0]
    n = struct.unpack_from("<H", data, at)[0]
    return next(at + 2 + 12 * i for i in range(n) if struct.unpack_from("<H", data, at + 2 + 12 * i)[0] == tag)


def _without_counts(data: bytes) -> bytes:
    """The byte count of a file of one strip set to 0."""
    out = bytearray(data)
    struct.pack_into("<I", out, _entry(data, 279) + 8, 0)
    return bytes(out)


@_query(" SELECT row, col, q FROM px")
def tiff_estimated_counts(spark, sf):
    return pixels(Tiff(_patched(pixel_files(spark, sf, W(LZW, rows_per_strip=ROWS)), _without_counts)))


def _looped(data: bytes) -> bytes:
    """The last directory's link points to the first one."""
    at = struct.unpack_from("<I", data, 4)[0]
    n = struct.unpack_from("<H", data, at)[0]
    out = bytearray(data)
    struct.pack_into("<I", out, at + 2 + 12 * n, at)
    return bytes(out)


@_query(_FILES + " SELECT 'f' || f || '.tif' AS path, 'loop' AS code, CAST(1 AS BIGINT) AS n_dirs FROM fs")
def tiff_loop(spark, sf):
    found = Tiff(_patched(pixel_files(spark, sf, W()), _looped))
    errors = found.files().select("path", F.explode("errors.code").alias("code"))
    return errors.join(found.dirs().groupBy("path").agg(F.count(F.lit(1)).alias("n_dirs")), "path")


@_query(" SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'not a TIFF file' ELSE 'unknown version 99' END AS error FROM part WHERE p_partkey % 3 < 2")
def tiff_corrupt(spark, sf):
    """Files with a bad mark or version; the others have no error."""
    keyed = tag_files(spark, sf)

    def run(frames):
        for frame in frames:
            content = []
            for path, c in zip(frame["path"], frame["content"], strict=True):
                kind = int(path) % 3
                content.append((b"XX" + bytes(c[2:])) if kind == 0 else (bytes(c[:2]) + struct.pack("<H", 99) + bytes(c[4:])) if kind == 1 else bytes(c))
            yield pd.DataFrame({"path": frame["path"], "content": content})

    found = Tiff(keyed.mapInPandas(run, "path string, content binary")).corrupt()
    return found.select(F.col("path").cast("long").alias("p_partkey"), "error")


# Tags


def _part_pages(r: dict) -> list[sink.Page]:
    size, key = int(r["p_size"]), int(r["p_partkey"])
    types = [
        (65001, 1, [size]), (65002, 2, r["p_type"]), (65003, 3, [size * 1000]), (65004, 4, [key * 1000]), (65005, 5, [(size, 7)]), (65006, 6, [-size]), (65007, 7, bytes(range(size % 9 + 1))), (65008, 8, [-size * 100]),
        (65009, 9, [-key]), (65010, 10, [(-size, 8)]), (65011, 11, [size * 0.5]), (65012, 12, [float(r["p_retailprice"])]),
    ]
    tags = [(270, 2, r["p_name"]), (305, 2, r["p_brand"]), (282, 5, [(size, 4)]), (283, 5, [(size, 0)]), (297, 3, [size % 5, 5]), (321, 3, [size, size + 1]), *types]
    exif = [(33434, 5, [(1, size)]), (36867, 2, f"2001:02:{size % 28 + 1:02d} 03:04:05"), (34855, 3, [size * 10])]
    return [sink.Page(np.zeros((2, 3, 1)), tags=tags, linked={34665: exif})]


def tag_files(spark: SparkSession, sf: str, options: sink.WriteOptions | None = None) -> DataFrame:
    """A file for each part, with tags of all types and an Exif directory; the path is the part's key."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_partkey", "p_name", "p_brand", "p_type", F.col("p_size").cast("long").alias("p_size"), F.col("p_retailprice").cast("double").alias("p_retailprice"))
    return sink.from_records(parts, _part_pages, options)


def _key(df: DataFrame, *columns) -> DataFrame:
    return df.select(F.col("path").cast("long").alias("p_partkey"), *columns)


_NUMBERS = """ SELECT p_partkey, t.tag, CAST(CASE t.tag WHEN 65001 THEN p_size WHEN 65003 THEN p_size * 1000 WHEN 65004 THEN p_partkey * 1000 WHEN 65005 THEN CAST(CAST(p_size AS DOUBLE) / 7 AS FLOAT) WHEN 65006 THEN -p_size WHEN 65008 THEN -p_size * 100
WHEN 65009 THEN -p_partkey WHEN 65010 THEN CAST(CAST(-p_size AS DOUBLE) / 8 AS FLOAT) WHEN 65011 THEN p_size * 0.5 ELSE p_retailprice END AS DOUBLE) AS value
FROM part, (VALUES (65001), (65003), (65004), (65005), (65006), (65008), (65009), (65010), (65011), (65012)) t(tag)"""


def _numbers(options):
    def query(spark, sf):
        found = Tiff(tag_files(spark, sf, options)).tags(list(range(65001, 65013)), ("nums",)).where("nums is not null")
        return _key(found, F.col("tag").cast("long").alias("tag"), F.col("nums")[0].alias("value"))

    return query


_query(_NUMBERS, "tiff_tag_types")(_numbers(None))
_query(_NUMBERS, "tiff_tag_types_big_endian")(_numbers(W(order=">")))
_query(_NUMBERS, "tiff_tag_types_bigtiff")(_numbers(W(big=True)))


def _picked(tag: int, value, kind: str = "main") -> Column:
    """A value of a tag in the array of a file's tags, or null."""
    return F.array_max(F.transform(F.filter("tags", lambda x: (x["tag"] == tag) & (x["kind"] == kind)), value))


@_query(" SELECT p_partkey, p_name AS description, p_brand AS software, p_type AS own FROM part")
def tiff_ascii(spark, sf):
    found = Tiff(tag_files(spark, sf)).gathered([270, 305, 65002], ("str",))
    return _key(found, *[_picked(t, lambda x: x["str"]).alias(n) for t, n in ((270, "description"), (305, "software"), (65002, "own"))])


@_query(" SELECT p_partkey, CAST(p_size AS BIGINT) AS x_num, CAST(4 AS BIGINT) AS x_den, CAST(CAST(p_size AS FLOAT) / 4 AS DOUBLE) AS x, CAST(1 AS DOUBLE) AS y FROM part")
def tiff_rationals(spark, sf):
    """Rationals; one with a denominator of 0 is 1."""
    found = Tiff(tag_files(spark, sf)).gathered([282, 283], ("nums", "rationals"))
    first = lambda x: x["nums"][0]
    return _key(found, _picked(282, lambda x: x["rationals"][0]["num"]).alias("x_num"), _picked(282, lambda x: x["rationals"][0]["den"]).alias("x_den"), _picked(282, first).alias("x"), _picked(283, first).alias("y"))


@_query(" SELECT p_partkey, CAST(p_size % 5 AS BIGINT) AS page, CAST(5 AS BIGINT) AS total, CAST(p_size AS BIGINT) AS h0, CAST(p_size + 1 AS BIGINT) AS h1 FROM part")
def tiff_pairs(spark, sf):
    """Tags of two values."""
    found = Tiff(tag_files(spark, sf)).gathered([297, 321], ("nums",))
    pick = lambda t, i: _picked(t, lambda x: F.get(x["nums"], F.lit(i))).cast("long")
    return _key(found, pick(297, 0).alias("page"), pick(297, 1).alias("total"), pick(321, 0).alias("h0"), pick(321, 1).alias("h1"))


@_query(" SELECT p_partkey, CAST(CAST(1 AS FLOAT) / CAST(p_size AS FLOAT) AS DOUBLE) AS exposure, '2001:02:' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') || ' 03:04:05' AS taken, CAST(p_size * 10 AS BIGINT) AS iso FROM part")
def tiff_exif(spark, sf):
    found = Tiff(tag_files(spark, sf, W(order=">"))).gathered([33434, 36867, 34855], ("nums", "str"))
    first = lambda x: x["nums"][0]
    return _key(found, _picked(33434, first, "exif").alias("exposure"), _picked(36867, lambda x: x["str"], "exif").alias("taken"), _picked(34855, first, "exif").cast("long").alias("iso"))


@_query(" SELECT p_partkey, string_agg(CAST(t.tag AS VARCHAR), ',' ORDER BY t.tag) AS custom FROM part, (SELECT 65000 + unnest(range(1, 13)) AS tag) t GROUP BY 1")
def tiff_custom_tags(spark, sf):
    """Custom tags in the order of the directory."""
    found = Tiff(tag_files(spark, sf)).gathered(None, ("is_custom",))
    own = F.array_sort(F.transform(F.filter("tags", lambda x: (x["kind"] == "main") & x["is_custom"] & (x["tag"] > 65000)), lambda x: F.struct(x["pos"].alias("pos"), x["tag"].alias("tag"))))
    return _key(found.where(F.size(own) > 0), F.array_join(F.transform(own, lambda x: x["tag"].cast("string")), ",").alias("custom"))


@_query(" SELECT p_partkey, CAST(d.tag AS BIGINT) AS tag, CAST(d.value AS DOUBLE) AS value, d.own AS is_set FROM part, (VALUES (258, 8, true), (274, 1, true), (296, 2, false), (254, 0, false), (266, 1, false), (336, 0, false), (281, 255, false), (529, 0.299, false), (318, 0.3457, false)) d(tag, value, own)")
def tiff_defaults(spark, sf):
    """Tags that aren't set have the format's defaults, some of which follow from others."""
    found = Tiff(tag_files(spark, sf)).values([258, 274, 296, 254, 266, 336, 281, 529, 318])
    return _key(found, F.col("tag").cast("long").alias("tag"), F.col("values")[0].alias("value"), "is_set")


@_query(" SELECT p_partkey, true AS width, true AS named, true AS ends FROM part")
def tiff_report(spark, sf):
    """Readable directories: lines ended by CR LF, with values and names."""
    text = F.col("report")
    whole = Tiff(tag_files(spark, sf)).report().where("ifd = 0").join(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_name"), "path")
    return _key(whole, text.contains("  ImageWidth: 3\r\n").alias("width"), text.contains(F.concat(F.lit("  ImageDescription: "), "p_name", F.lit("\r\n"))).alias("named"), text.endswith("\r\n").alias("ends"))


@_query(" SELECT p_partkey, p_name AS description, CAST(p_size % 5 AS BIGINT) AS page, CAST(0 AS BIGINT) AS n_own, CAST(3 AS BIGINT) AS n_exif FROM part")
def tiff_copied_tags(spark, sf):
    """A copy takes whitelisted tags and the Exif directory along, not a user's own tags."""
    made = sink.convert(tag_files(spark, sf), W.parse("zip:2"))
    found = Tiff(made).gathered(None, ("nums", "str"))
    number = lambda which: F.size(F.filter("tags", which)).cast("long")
    return _key(
        found, _picked(270, lambda x: x["str"]).alias("description"), _picked(297, lambda x: x["nums"][0]).cast("long").alias("page"), number(lambda x: x["tag"] > 65000).alias("n_own"), number(lambda x: x["kind"] == "exif").alias("n_exif")
    )


# Pages


def _turn_pages(r: dict) -> list[sink.Page]:
    return [sink.Page(np.full((2, 2, 1), len(role) % 256), tags=[(270, 2, role), (254, 4, 2), (297, 3, [i, len(r["roles"])])], resolution=(36.0, 72.0)) for i, role in enumerate(r["roles"])]


def page_files(spark: SparkSession, sf: str, options: sink.WriteOptions | None = None) -> DataFrame:
    """A file for each conversation, with a page for each turn."""
    turns = table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"]).alias("roles"))
    return sink.from_records(turns, _turn_pages, options)


def _roles(contents: DataFrame) -> DataFrame:
    """conv_id, page and role of the pages of files."""
    found = Tiff(contents).tags([270], ("str",)).where("kind = 'main'")
    return found.select(F.col("path").cast("long").alias("conv_id"), F.col("ifd").cast("long").alias("page"), F.col("str").alias("role"))


_TURNS = ", t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS page, role FROM conversations)"


@_query(_TURNS + " SELECT conv_id, page, role FROM t")
def tiff_pages(spark, sf):
    return _roles(page_files(spark, sf))


@_query(_TURNS + " SELECT conv_id, count(*) AS n_pages, CAST(max(page) AS BIGINT) AS last FROM t GROUP BY 1")
def tiff_page_counts(spark, sf):
    """Pages of a file, and the number of the one without a next one."""
    dirs = Tiff(page_files(spark, sf, W(big=True))).dirs()
    return dirs.groupBy(F.col("path").cast("long").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_pages"), F.max(F.when(F.col("next_ifd") == 0, F.col("ifd"))).cast("long").alias("last"))


@_query(_TURNS + " SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY page) - 1 AS page, role FROM t WHERE page IN (0, 2)")
def tiff_select_pages(spark, sf):
    return _roles(sink.convert(page_files(spark, sf), W(LZW), [0, 2]))


@_query(_TURNS + " SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY page) - 1 AS page, role FROM t WHERE page <> 1")
def tiff_unlink(spark, sf):
    return _roles(sink.unlink(page_files(spark, sf), 1))


@_query(_TURNS + ", b AS (SELECT conv_id // 10 AS f, row_number() OVER (PARTITION BY conv_id // 10 ORDER BY conv_id, page) - 1 AS page, role FROM t) SELECT f AS conv_id, page, role, page AS number FROM b")
def tiff_concat(spark, sf):
    """Pages of ten files in one, in order and numbered anew."""
    files = page_files(spark, sf).select(F.floor(F.col("path").cast("long") / 10).cast("string").alias("path"), F.col("path").cast("long").alias("position"), "content")
    found = Tiff(sink.assemble(files, W(PACK), renumber=True)).gathered([270, 297], ("nums", "str"), by_directory=True).where("kind = 'main'")
    return found.select(F.col("path").cast("long").alias("conv_id"), F.col("ifd").cast("long").alias("page"), _picked(270, lambda x: x["str"]).alias("role"), _picked(297, lambda x: x["nums"][0]).cast("long").alias("number"))


@_query(_TURNS + " SELECT conv_id, page, role FROM t WHERE page = 1")
def tiff_directory_at(spark, sf):
    """The directory at the offset that the first one's link names."""
    found = Tiff(page_files(spark, sf))
    dirs = found.dirs()
    second = dirs.where("ifd = 0 and next_ifd <> 0").select("path", F.col("next_ifd").alias("ifd_offset"))
    at = dirs.join(second, ["path", "ifd_offset"]).select("path", "ifd")
    return found.tags().where("tag = 270").join(at, ["path", "ifd"]).select(F.col("path").cast("long").alias("conv_id"), F.col("ifd").cast("long").alias("page"), F.col("str").alias("role"))


# Copies with another layout


def _copied(name: str, first: sink.WriteOptions, then: sink.WriteOptions) -> None:
    @_query("SELECT row, p AS col, r, g, b FROM rgb", f"tiff_copy_{name}")
    def query(spark, sf):
        return pixels(Tiff(sink.convert(pixel_files(spark, sf, first, 2, 8, 3), then)), ("r", "g", "b"))


_copied("strips", W(LZW, 2, rows_per_strip=4), W(ZIP, 2, rows_per_strip=9))
_copied("to_tiles", W(PACK, rows_per_strip=7), W(LZW, tile_width=16, tile_length=16))
_copied("to_strips", W(ZIP, tile_width=16, tile_length=32), W(PACK, rows_per_strip=6))
_copied("tiles", W(LZW, tile_width=16, tile_length=16), W(ZIP, 2, tile_width=32, tile_length=32))
_copied("to_planes", W(LZW, rows_per_strip=5), W(LZW, 2, planar=2, rows_per_strip=8))
_copied("from_planes", W(ZIP, planar=2, tile_width=16, tile_length=16), W(PACK, big=True))
_copied("chunks", W(LZW, 2, tile_width=16, tile_length=16), W(ZIP, order=">", fill_order=2, keep_layout=True))
_copied("planar_chunks", W(PACK, planar=2, rows_per_strip=7), W(LZW, 2, keep_layout=True))


@_query(_STRIPS + " SELECT 'f' || f || '.tif' AS path, chunk, true AS same FROM st")
def tiff_copy_raw(spark, sf):
    """Encoded chunks are stored as they are where the codec stays, in a container of another kind."""
    files = pixel_files(spark, sf, W(LZW, 2, rows_per_strip=10))
    raw = lambda t, name: Tiff(t).chunks(raw=True).select("path", F.col("chunk").cast("long").alias("chunk"), F.col("raw").alias(name))
    copied = sink.convert(files, W(LZW, 2, order=">", big=True, keep_layout=True))
    return raw(files, "a").join(raw(copied, "b"), ["path", "chunk"]).select("path", "chunk", (F.col("a") == F.col("b")).alias("same"))


def _changed(spark, sf, **change) -> Tiff:
    options = W(LZW)
    return Tiff(sink.convert(pixel_files(spark, sf, W(PACK)), options, None, tools.Changed(options, **change)))


@_query(_HEIGHT + " SELECT first + col AS row, h - 1 - y AS col, q FROM o WHERE col < 48")
def tiff_rotate(spark, sf):
    """Files turned by 90 degrees; rows beyond the height of a file are left out, as they would have the numbers of the next one."""
    found = _changed(spark, sf, rotate=90).pixels().where(F.col("row") < ROWS)
    return found.select(_whole_row(F.col("row")).alias("row"), F.col("col").cast("long").alias("col"), F.col("samples")[0].cast("long").alias("q"))


@_query(" SELECT row // 48 * 48 + row % 48 - 2 AS row, col - 8 AS col, q FROM px WHERE row % 48 BETWEEN 2 AND 9 AND col BETWEEN 8 AND 39")
def tiff_crop(spark, sf):
    return pixels(_changed(spark, sf, crop=(2, 8, 8, 32)))


@_query(" SELECT row, col, ((q - (row % 48 * 64 + col) % 251) % 256 + 256) % 256 AS q FROM px WHERE row < (SELECT max(row) + 1 FROM px) // 48 * 48")
def tiff_bias(spark, sf):
    """Files less a bias frame of their size, modulo 256; files of another size have an error."""
    frame = (np.arange(ROWS * WIDTH) % 251).reshape(ROWS, WIDTH, 1)
    return pixels(_changed(spark, sf, bias=frame))


@_query(_grey("255 - q"))
def tiff_to_rgba(spark, sf):
    """Files converted to RGBA files, read as samples."""
    options = W(PACK)
    made = sink.convert(pixel_files(spark, sf, W(LZW), photometric=0), options, None, tools.Changed(options, rgba=True))
    return pixels(Tiff(made), ("r", "g", "b", "a"))


@_query("SELECT row, p AS col, (c * k + 127) // 255 AS r, (m * k + 127) // 255 AS g, (y * k + 127) // 255 AS b FROM quad")
def tiff_to_rgb(spark, sf):
    options = W(ZIP, 2)
    made = sink.convert(pixel_files(spark, sf, W(LZW), 2, 8, 4, extra_samples=[2]), options, None, tools.Changed(options, no_alpha=True, rgba=True))
    return pixels(Tiff(made), ("r", "g", "b"))


@_query("SELECT row, p AS col, CASE WHEN r + g + b > 500 THEN 1 ELSE 0 END AS q FROM rgb")
def tiff_bitonal(spark, sf):
    made = sink.convert(pixel_files(spark, sf, W(LZW), 2, 8, 3), W(codecs.CCITT_FAX4), None, generate.bitonal)
    return pixels(Tiff(made))


@_query("SELECT row, col, (q * 200 * 2 + 257) // 514 AS q FROM px")
def tiff_to_8_bits(spark, sf):
    made = sink.convert(pixel_files(spark, sf, W(LZW), bits=16, value=lambda x: x * 200), W(PACK), None, generate.to_8_bits)
    return pixels(Tiff(made))


@_query("SELECT row, col, CAST(CASE WHEN row % 48 < 16 THEN 0 ELSE q END AS BIGINT) AS q FROM px")
def tiff_copy_ignoring(spark, sf):
    """A copy that goes on after a strip that can't be read; its samples are 0."""
    broken = _patched(pixel_files(spark, sf, W(ZIP, rows_per_strip=16)), lambda data: data[:8] + bytes(24) + data[32:])
    return pixels(Tiff(sink.convert(broken, W(LZW), ignore=True)))


# PDF


@_query(_TURNS + " SELECT conv_id, count(*) AS n_pages, '[0 0 4.0000 2.0000]' AS box, '/FlateDecode' AS filter FROM t GROUP BY 1")
def tiff_pdf(spark, sf):
    made = pdf.to_pdf(page_files(spark, sf))
    text = F.decode("content", "ISO-8859-1")
    return made.select(F.col("path").cast("long").alias("conv_id"), F.regexp_extract(text, r"/Count (\d+)", 1).cast("long").alias("n_pages"), F.regexp_extract(text, r"/MediaBox (\[[^]]*\])", 1).alias("box"), F.regexp_extract(text, r"/Filter (/\w+)", 1).alias("filter"))


@_query(" SELECT p_partkey, p_name AS subject, p_brand AS creator, 'D:20010203040506' AS created, CASE p_size % 3 WHEN 0 THEN '[0 0 595.0000 842.0000]' ELSE '[0 0 595.0000 842.0000]' END AS box FROM part")
def tiff_pdf_info(spark, sf):
    made = pdf.to_pdf(tag_files(spark, sf), pdf.PdfOptions(paper="a4", fit=True, created="D:20010203040506"))
    text = F.decode("content", "ISO-8859-1")
    said = lambda name: F.regexp_extract(text, rf"/{name} \(((?:[^\\)]|\\.)*)\)", 1).alias(name.lower())
    return _key(made, said("Subject"), said("Creator"), F.regexp_extract(text, r"/CreationDate \(([^)]*)\)", 1).alias("created"), F.regexp_extract(text, r"/MediaBox (\[[^]]*\])", 1).alias("box"))


# Files in a folder


def _folder(spark: SparkSession) -> str:
    """The address of a new folder below the one that all executors share; a session of one process without it takes a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="files-")
    return f"{shared if '://' in shared else f'file://{shared}'}/{uuid.uuid4()}"


def _saved(spark: SparkSession, files: DataFrame) -> str:
    folder = _folder(spark)
    sink.save(files, folder).count()
    return folder


@_query("SELECT row, col, q FROM px")
def tiff_read(spark, sf):
    """Files that are written to a folder and opened by its name."""
    folder = _saved(spark, pixel_files(spark, sf, W(LZW)))
    return pixels(tiff.read_tiff(spark, folder))


@_query(_FILES + " SELECT 'f' || f || '.tif' AS path, h AS height, (h + 9) // 10 AS n_chunks, h * 64 AS bytes FROM fs")
def tiff_source(spark, sf):
    """The data source: directories and chunks."""
    folder = _saved(spark, pixel_files(spark, sf, W(rows_per_strip=10)))
    datasource.register(spark)
    read = lambda t: spark.read.format("tiff").option("table", t).load(folder).withColumn("path", F.substring_index("path", "/", -1))
    bytes_of = read("chunks").groupBy("path").agg(F.sum("bytecount").alias("bytes"))
    return read("dirs").join(bytes_of, "path").select("path", F.col("height").cast("long").alias("height"), F.col("n_chunks").cast("long").alias("n_chunks"), "bytes")


@_query("SELECT row, col, q FROM px")
def tiff_source_rows(spark, sf):
    """The data source: image rows."""
    folder = _saved(spark, pixel_files(spark, sf, W(ZIP, 2, tile_width=16, tile_length=16)))
    datasource.register(spark)
    cells = spark.read.format("tiff").option("table", "rows").load(folder).select("path", "row", "x0", F.posexplode("samples").alias("k", "s"))
    return cells.select(_whole_row(F.col("row")).alias("row"), (F.col("x0") + F.col("k")).cast("long").alias("col"), F.col("s")[0].cast("long").alias("q"))


@_query(_FILES + " SELECT 'f' || f || '.tif' AS path, CAST(64 AS BIGINT) AS width, h AS height FROM fs")
def tiff_stream(spark, sf):
    """Files that arrive in two lots, read as a stream that goes on where it stopped."""
    files = pixel_files(spark, sf, W(PACK))
    folder, state = _folder(spark), _folder(spark)
    for lot in (files.where("path like '%0.tif'"), files.where("path not like '%0.tif'")):
        sink.save(lot, folder).count()
        ingest.write_available(ingest.read_stream(spark, folder).dirs(), f"{state}/out", f"{state}/checkpoint").awaitTermination()
    found = spark.read.parquet(f"{state}/out")
    return found.select(F.substring_index("path", "/", -1).alias("path"), F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))


@_query(" SELECT CAST(s.scheme AS BIGINT) AS scheme, s.usable AS configured FROM (VALUES (1, true), (2, true), (3, true), (4, true), (5, true), (6, true), (7, true), (8, true), (32771, true), (32773, true), (32946, true), (34661, false), (34676, false)) s(scheme, usable)")
def tiff_codecs(spark, sf):
    return checks.codec_table(spark).where(F.col("scheme").isin(1, 2, 3, 4, 5, 6, 7, 8, 32771, 32773, 32946, 34661, 34676)).select(F.col("scheme").cast("long").alias("scheme"), "configured")


@_query(_FILES + " SELECT 'f' || f || '.tif' AS path, 'the bits of a sample aren''t 1, 2, 4, 8 or 16' AS error FROM fs UNION ALL SELECT 'g' || f || '.tif', NULL FROM fs")
def tiff_convertible(spark, sf):
    """Whether images can be converted to RGBA."""
    odd = pixel_files(spark, sf, W(LZW), bits=32, value=lambda x: x)
    good = pixel_files(spark, sf, W(LZW)).withColumn("path", F.concat(F.lit("g"), F.substring("path", 2, 100)))
    dirs = Tiff(odd.unionByName(good)).dirs()
    return dirs.select("path", checks.rgba_error(dirs).alias("error"))
