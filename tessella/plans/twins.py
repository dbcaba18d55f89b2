"""Raster operators as queries over ordinary tables, each with the same query in DuckDB SQL.

The pixel raster: embeddings as an image of 64 columns, a row for each vec_id, values scaled to bytes. Files and pages: conv_id and
turn of conversations. Byte counts: n_chars of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce, color
from ..operators import aggregates, checks, geometry, pages, predictor, quantize, relayout, tags
from ..sources.pdf import PAPERS

WIDTH = 64
QUERIES: dict = {}
ORACLES: dict = {}


def _query(sql: str):
    def register(f):
        name = f.__name__.strip("_")
        QUERIES[name] = f
        ORACLES[name] = _PX + sql
        return f

    return register


_PX = """WITH base AS (SELECT vec_id AS row, embedding FROM embeddings),
cells AS (SELECT row, embedding, unnest(range(len(embedding))) AS col FROM base),
px AS (SELECT row, col, CAST(greatest(0, least(255, floor((CAST(embedding[col + 1] AS DOUBLE) + 1) * 127.5))) AS BIGINT) AS q FROM cells),
size AS (SELECT max(row) + 1 AS h FROM base),
rgb AS (SELECT row, col // 3 AS p, max(q) FILTER (col % 3 = 0) AS r, max(q) FILTER (col % 3 = 1) AS g, max(q) FILTER (col % 3 = 2) AS b FROM px WHERE col < 63 GROUP BY 1, 2),
quad AS (SELECT row, col // 4 AS p, max(q) FILTER (col % 4 = 0) AS c, max(q) FILTER (col % 4 = 1) AS m, max(q) FILTER (col % 4 = 2) AS y, max(q) FILTER (col % 4 = 3) AS k FROM px GROUP BY 1, 2)
"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bytes_of(embedding: Column) -> Column:
    return F.transform(embedding, lambda v: color.clamp(F.floor((v.cast("double") + 1) * 127.5)))


def raster(spark: SparkSession, sf: str) -> DataFrame:
    """row and the array q of its samples: whole image rows, from which most queries need no shuffle."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row"), bytes_of(F.col("embedding")).alias("q"))


def px(spark: SparkSession, sf: str) -> DataFrame:
    return raster(spark, sf).select("row", F.posexplode("q").alias("col", "q")).withColumn("col", F.col("col").cast("long"))


def groups(spark: SparkSession, sf: str, n: int, names: str) -> DataFrame:
    """Pixels of n samples: row, p and a column for each sample."""
    cut = raster(spark, sf).select("row", F.posexplode(F.transform(F.sequence(F.lit(0), geometry.div(F.size("q"), n).cast("int") - 1), lambda i: F.slice("q", i * n + 1, n))).alias("p", "s"))
    return cut.select("row", F.col("p").cast("long").alias("p"), *[F.col("s")[i].alias(c) for i, c in enumerate(names)])


def height(spark: SparkSession, sf: str) -> Column:
    """Rows of the raster, as a scalar subquery: nothing runs while a query is built."""
    return table(spark, sf, "embeddings").agg(F.coalesce(F.max("vec_id") + 1, F.lit(0)).alias("height")).scalar()


# Predictors and runs


@_query("SELECT row, col, ((q - coalesce(lag(q) OVER w, 0)) % 256 + 256) % 256 AS d FROM px WINDOW w AS (PARTITION BY row ORDER BY col)")
def hordiff(spark, sf):
    return raster(spark, sf).select("row", F.posexplode(predictor.difference_array(F.col("q"))).alias("col", "d")).withColumn("col", F.col("col").cast("long"))


@_query("SELECT row, col, ((q - coalesce(lag(q, 3) OVER w, 0)) % 256 + 256) % 256 AS d FROM px WINDOW w AS (PARTITION BY row ORDER BY col)")
def hordiff_stride3(spark, sf):
    return raster(spark, sf).select("row", F.posexplode(predictor.difference_array(F.col("q"), stride=3)).alias("col", "d")).withColumn("col", F.col("col").cast("long"))


@_query("SELECT row, col, CAST(sum(q) OVER (PARTITION BY row ORDER BY col ROWS UNBOUNDED PRECEDING) % 256 AS BIGINT) AS s FROM px")
def horacc(spark, sf):
    return raster(spark, sf).select("row", F.posexplode(predictor.running_sum_array(F.col("q"))).alias("col", "s")).withColumn("col", F.col("col").cast("long"))


@_query("SELECT row, col, CAST(sum(q) OVER (PARTITION BY row, col % 3 ORDER BY col ROWS UNBOUNDED PRECEDING) % 256 AS BIGINT) AS s FROM px")
def horacc_stride3(spark, sf):
    return raster(spark, sf).select("row", F.posexplode(predictor.running_sum_array(F.col("q"), stride=3)).alias("col", "s")).withColumn("col", F.col("col").cast("long"))


@_query("SELECT row, col, CAST(sum(q) OVER (PARTITION BY row ORDER BY col ROWS UNBOUNDED PRECEDING) % 256 AS BIGINT) AS s FROM px")
def horacc_table(spark, sf):
    """The same over a table of samples, by a window."""
    return predictor.running_sum(px(spark, sf), ["row"], "col", "q", out="s").select("row", "col", "s")


@_query("SELECT row, col, q FROM px")
def hordiff_roundtrip(spark, sf):
    both = raster(spark, sf).select("row", predictor.running_sum_array(predictor.difference_array(F.col("q"))).alias("q"))
    return both.select("row", F.posexplode("q").alias("col", "q")).withColumn("col", F.col("col").cast("long"))


@_query("SELECT row, col, q - coalesce(lag(q) OVER (PARTITION BY col ORDER BY row), 0) AS d FROM px")
def prev_row_diff(spark, sf):
    found = predictor.previous_row_difference(raster(spark, sf), [], "row", "q")
    return found.select("row", F.posexplode("d").alias("col", "d")).withColumn("col", F.col("col").cast("long"))


@_query(""", e AS (SELECT user_id, event_type, ts, event_id, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT user_id, event_type, sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS run FROM e)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type AS value, count(*) AS length FROM n GROUP BY 1, 2, 3""")
def packbits_runs(spark, sf):
    return predictor.runs(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type")


# Geometry


@_query("SELECT row // 8 AS strip, CAST(sum(q) AS BIGINT) AS total, count(*) AS n FROM px GROUP BY 1")
def strip_of_row(spark, sf):
    whole = raster(spark, sf).select(geometry.strip_of("row", 8).alias("strip"), F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("t"), F.size("q").alias("k"))
    return whole.groupBy("strip").agg(F.sum("t").alias("total"), F.sum("k").cast("long").alias("n"))


@_query("SELECT (row // 16) * 4 + col // 16 AS tile, CAST(sum(q) AS BIGINT) AS total FROM px GROUP BY 1")
def tile_sum(spark, sf):
    placed = px(spark, sf).select(geometry.tile_of("col", "row", WIDTH, 1, 16, 16).alias("tile"), "q")
    return placed.groupBy("tile").agg(F.sum("q").alias("total"))


@_query("SELECT row, col, row >= 0 AND row < 400 AND col < 50 AS inside FROM px")
def check_tile(spark, sf):
    return px(spark, sf).select("row", "col", geometry.tile_in_bounds("col", "row", 50, 400).alias("inside"))


@_query(", s AS (SELECT doc_id, n_chars, unnest(range((n_chars + 1023) // 1024)) AS piece FROM documents WHERE n_chars > 0) SELECT doc_id, piece, piece * 1024 AS piece_offset, least(1024, n_chars - piece * 1024) AS piece_bytes FROM s")
def strip_chop(spark, sf):
    return geometry.chop_strips(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", 1024).select("doc_id", "piece", "piece_offset", "piece_bytes")


@_query("SELECT source, doc_id, CAST(8 + coalesce(sum(n_chars + n_chars % 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chunk_offset FROM documents")
def strip_offsets(spark, sf):
    return geometry.chunk_offsets(table(spark, sf, "documents"), ["source"], "doc_id", "n_chars").select("source", "doc_id", "chunk_offset")


@_query("SELECT doc_id, n_chars FROM documents WHERE (n_chars = 0) OR n_chars > 20000 - 8 OR n_chars < 600")
def bytecount_bad(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars").where(geometry.bytecount_looks_bad("n_chars", 8, 20000, expected=600))


@_query("SELECT row, (64 * 3 * (row % 16 + 1) + 7) // 8 AS scanline, (64 * (row % 16 + 1) + 7) // 8 AS plane_scanline, (row % 100 + 15) // 16 * 16 AS rounded FROM base")
def scanline_sizes(spark, sf):
    bits = F.pmod(F.col("row"), F.lit(16)) + 1
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row")).select("row", geometry.scanline_bytes(64, 3, bits).alias("scanline"), geometry.scanline_bytes(64, 3, bits, False).alias("plane_scanline"), geometry.round_up(F.pmod(F.col("row"), F.lit(100)), 16).alias("rounded"))


@_query(", s AS (SELECT row, row % 100 + 1 AS w, row % 7 + 1 AS n FROM base), l AS (SELECT row, ((w + 1) // 2 * 2 * ((n + 1) // 2 * 2) * 8 + 7) // 8 AS luma FROM s) SELECT row, luma + 2 * (luma // 4) AS strip_bytes FROM l")
def subsampled_size(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row")).select("row", geometry.subsampled_strip_bytes(F.pmod(F.col("row"), F.lit(100)) + 1, F.pmod(F.col("row"), F.lit(7)) + 1, 8, 2, 2).alias("strip_bytes"))


# Aggregates


@_query("SELECT q >> 3 AS bin, count(*) AS n FROM px GROUP BY 1")
def histogram(spark, sf):
    return aggregates.histogram(px(spark, sf), "q")


@_query("SELECT q >> 3 AS bin, count(*) AS n FROM px GROUP BY 1 ORDER BY n DESC, bin LIMIT 1")
def popular_bin(spark, sf):
    return aggregates.most_popular(aggregates.histogram(px(spark, sf), "q"))


@_query("SELECT row FROM px GROUP BY row HAVING max(q) - min(q) <= 60")
def per_sample_equal(spark, sf):
    return raster(spark, sf).where(aggregates.spread_within(F.col("q"), 60)).select("row")


@_query("SELECT row, CAST((64 + sum((64 - col) * q)) % 65521 * 65536 + (1 + sum(q)) % 65521 AS BIGINT) AS adler FROM px GROUP BY row")
def adler_like(spark, sf):
    return raster(spark, sf).select("row", aggregates.adler32(F.col("q")).alias("adler"))


@_query("SELECT source, CAST(sum(greatest(n_chars - 4, 0)) + 2 AS BIGINT) AS total FROM documents GROUP BY source")
def jpeg_stream_size(spark, sf):
    return aggregates.stream_size(table(spark, sf, "documents"), ["source"], "n_chars")


# Planes, tiles and movement


@_query("SELECT row, CAST(i AS BIGINT) AS plane, p, CASE i WHEN 0 THEN r WHEN 1 THEN g ELSE b END AS value FROM rgb, range(3) t(i)")
def planar_separate(spark, sf):
    pixels = groups(spark, sf, 3, "rgb")
    return relayout.to_planes(pixels, F.array("r", "g", "b"), ["row", "p"]).withColumn("plane", F.col("plane").cast("long"))


@_query("SELECT row, p, r AS s0, g AS s1, b AS s2 FROM rgb")
def planar_contig(spark, sf):
    return relayout.to_pixels(planar_separate(spark, sf), ["row", "p"], 3)


@_query(", t AS (SELECT (row // 16) * 4 + col // 16 AS tile, (row % 16) * 16 + col % 16 AS place, q FROM px) SELECT tile, string_agg(CAST(q AS VARCHAR), ',' ORDER BY place) AS cells FROM t GROUP BY tile")
def strips_to_tiles(spark, sf):
    return relayout.to_tiles(px(spark, sf), "q", WIDTH, 1, 16, 16).select("tile", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("cells"))


@_query("SELECT row, col, q AS value FROM px")
def tiles_to_strips(spark, sf):
    """All rows, those of tiles that the image doesn't fill as well."""
    tiled = relayout.to_tiles(px(spark, sf), "q", WIDTH, 1, 16, 16)
    return relayout.from_tiles(tiled, F.lit(WIDTH), 16, 16)


@_query("SELECT a.row, a.col, ((a.q - b.q) % 256 + 256) % 256 AS q FROM px a JOIN px b ON a.col = b.col AND b.row = 0")
def bias_subtract(spark, sf):
    image = px(spark, sf)
    frame = image.where("row = 0").select("col", F.col("q"))  # one image row
    return relayout.subtract_bias(image, F.broadcast(frame), 8, ["col"], keep=["row", "col"])


@_query(", b AS (SELECT row + 1 AS row, col, q FROM px) SELECT a.row, a.col, ((a.q - b.q) % 256 + 256) % 256 AS q FROM px a JOIN b ON a.row = b.row AND a.col = b.col")
def bias_subtract_image(spark, sf):
    image = px(spark, sf)
    return relayout.subtract_bias(image, image.withColumn("row", F.col("row") + 1), 8, ["row", "col"])


def _moved(df):
    return df.select("row", "col", "q")


@_query("SELECT col AS row, h - 1 - row AS col, q FROM px, size")
def rotate90(spark, sf):
    return _moved(relayout.rotate(px(spark, sf), 90, F.lit(WIDTH), height(spark, sf)))


@_query("SELECT h - 1 - row AS row, 63 - col AS col, q FROM px, size")
def rotate180(spark, sf):
    return _moved(relayout.rotate(px(spark, sf), 180, F.lit(WIDTH), height(spark, sf)))


@_query("SELECT 63 - col AS row, row AS col, q FROM px, size")
def rotate270(spark, sf):
    return _moved(relayout.rotate(px(spark, sf), 270, F.lit(WIDTH), height(spark, sf)))


@_query("SELECT row, 63 - col AS col, q FROM px")
def flip_h(spark, sf):
    return _moved(relayout.flip(px(spark, sf), True, F.lit(WIDTH)))


@_query("SELECT h - 1 - row AS row, col, q FROM px, size")
def flip_v(spark, sf):
    return _moved(relayout.flip(px(spark, sf), False, height(spark, sf)))


@_query(", o AS (SELECT row % 8 + 1 AS o, row, col, q FROM px) SELECT row, CASE WHEN o IN (2, 3, 6, 7) THEN 63 - col ELSE col END AS col, q FROM o")
def orientation_flip(spark, sf):
    own = px(spark, sf).withColumn("first", F.col("row")).withColumn("row", F.lit(0).cast("long"))  # each row is an image of its own
    out = None
    for o in relayout.ORIENTATIONS:
        part = relayout.orient(own.where(F.pmod(F.col("first"), F.lit(8)) + 1 == o), o, F.lit(WIDTH), F.lit(1))
        out = part if out is None else out.unionByName(part)
    return out.select((F.col("first") + F.col("row")).alias("row"), "col", "q")


@_query("SELECT row - 10 AS row, col - 8 AS col, q FROM px WHERE row BETWEEN 10 AND 109 AND col BETWEEN 8 AND 39")
def crop(spark, sf):
    return _moved(relayout.crop(px(spark, sf), 10, 8, 100, 32))


@_query("SELECT row // 2 AS row, col // 2 AS col, CAST((sum(q) + count(*) // 2) // count(*) AS BIGINT) AS q FROM px GROUP BY 1, 2")
def box_downsample(spark, sf):
    return relayout.downsample(px(spark, sf), [])


@_query("SELECT row, col * 2 + CAST(k AS BIGINT) AS col, q FROM px, range(2) t(k)")
def upsample(spark, sf):
    return _moved(relayout.upsample(px(spark, sf), 1, 2))


# Colour


@_query("SELECT row, col, CAST((i * 3) % 256 AS BIGINT) AS r, CAST((i * 5 + 1) % 256 AS BIGINT) AS g, CAST(255 - i AS BIGINT) AS b FROM px JOIN (SELECT i FROM range(256) t(i)) ON q = i")
def palette_lookup(spark, sf):
    palette = spark.range(256).select(F.col("id").alias("i"), F.pmod(F.col("id") * 3, F.lit(256)).alias("r"), F.pmod(F.col("id") * 5 + 1, F.lit(256)).alias("g"), (255 - F.col("id")).alias("b"))
    return px(spark, sf).join(F.broadcast(palette), F.col("q") == F.col("i")).select("row", "col", "r", "g", "b")  # 2^bits rows


@_query("SELECT row, col, ((q >> 4) * 255) // 15 AS v FROM px")
def grey_map(spark, sf):
    return px(spark, sf).select("row", "col", color.grey(F.shiftright("q", 4), 4).alias("v"))


@_query("SELECT row, col, ((15 - (q >> 4)) * 255) // 15 AS v FROM px")
def minwhite(spark, sf):
    return px(spark, sf).select("row", "col", color.grey(F.shiftright("q", 4), 4, white_is_zero=True).alias("v"))


@_query("SELECT row, p, (255 - k) * (255 - c) // 255 AS r, (255 - k) * (255 - m) // 255 AS g, (255 - k) * (255 - y) // 255 AS b FROM quad")
def cmyk_to_rgb(spark, sf):
    r, g, b = color.cmyk_to_rgb(*map(F.col, "cmyk"))
    return groups(spark, sf, 4, "cmyk").select("row", "p", r.alias("r"), g.alias("g"), b.alias("b"))


_D = [color.fixed(2 - 2 * 0.299), -color.fixed(0.299 * (2 - 2 * 0.299) / 0.587), color.fixed(2 - 2 * 0.114), -color.fixed(0.114 * (2 - 2 * 0.114) / 0.587)]


@_query(f"""SELECT row, p, greatest(0, least(255, r + (((b - 128) * {_D[0]} + 32768) >> 16))) AS red,
greatest(0, least(255, r + (((g - 128) * {_D[3]} + 32768 + (b - 128) * {_D[1]}) >> 16))) AS green, greatest(0, least(255, r + (((g - 128) * {_D[2]} + 32768) >> 16))) AS blue FROM rgb""")
def ycbcr_to_rgb(spark, sf):
    red, green, blue = color.ycbcr_to_rgb(F.col("r"), F.col("g"), F.col("b"))
    return groups(spark, sf, 3, "rgb").select("row", "p", red.alias("red"), green.alias("green"), blue.alias("blue"))


@_query("SELECT row, p, (c * k + 127) // 255 AS r, (m * k + 127) // 255 AS g, (y * k + 127) // 255 AS b, k AS a FROM quad")
def alpha_premultiply(spark, sf):
    a = F.col("k")
    return groups(spark, sf, 4, "cmyk").select("row", "p", *[color.premultiply(F.col(c), a).alias(n) for c, n in zip("cmy", "rgb", strict=True)], a.alias("a"))


@_query("SELECT row, p, k * 16777216 + y * 65536 + m * 256 + c AS rgba FROM quad")
def pack_rgba(spark, sf):
    return groups(spark, sf, 4, "cmyk").select("row", "p", color.pack_rgba(*map(F.col, "cmyk")).alias("rgba"))


@_query("SELECT row, p, c AS r, m AS g, y AS b, k AS a FROM quad")
def unpack_rgba(spark, sf):
    return pack_rgba(spark, sf).select("row", "p", *[x.alias(n) for x, n in zip(color.unpack_rgba(F.col("rgba")), "rgba", strict=True)])


@_query("SELECT row, col, (q * 200) >> 8 AS high, (q * 200 * 2 + 257) // 514 AS scaled FROM px")
def to8bit(spark, sf):
    v = F.col("q") * 200
    return px(spark, sf).select("row", "col", color.high_byte(v).alias("high"), color.scaled_to_8(v).alias("scaled"))


@_query("SELECT row, col, (q * 257 * 16) % 65536 AS v FROM px")
def mul16_wrap(spark, sf):
    return px(spark, sf).select("row", "col", color.multiply_wrapped(F.col("q") * 257, 16).alias("v"))


@_query("SELECT row, p, CASE WHEN r + g + b > 500 THEN 1 ELSE 0 END AS bit FROM rgb")
def bitonal(spark, sf):
    return groups(spark, sf, 3, "rgb").select("row", "p", color.bitonal(F.col("r"), F.col("g"), F.col("b")).alias("bit"))


@_query("SELECT row, col, ((q & 1) << 7) | ((q & 2) << 5) | ((q & 4) << 3) | ((q & 8) << 1) | ((q & 16) >> 1) | ((q & 32) >> 3) | ((q & 64) >> 5) | ((q & 128) >> 7) AS v FROM px")
def bit_reverse(spark, sf):
    return px(spark, sf).select("row", "col", color.reverse_bits(F.col("q")).alias("v"))


@_query("SELECT row, col, ((q * 200) & 255) * 256 + ((q * 200) >> 8) AS v FROM px")
def byteswap16(spark, sf):
    return px(spark, sf).select("row", "col", color.byteswap(F.col("q") * 200, 2).alias("v"))


_E = {k: color.fixed(v) for k, v in {"r": 0.299, "g": 0.587, "b": 0.114, "rb": -0.299 / 1.772, "gb": -0.587 / 1.772, "gr": -0.587 / 1.402, "br": -0.114 / 1.402}.items()}


@_query(f"""SELECT row, p, (r * {_E["r"]} + g * {_E["g"]} + b * {_E["b"]} + 32768) >> 16 AS y, least(255, (r * {_E["rb"]} + g * {_E["gb"]} + b * 32768 + 8388608 + 32767) >> 16) AS cb,
least(255, (r * 32768 + g * {_E["gr"]} + b * {_E["br"]} + 8388608 + 32767) >> 16) AS cr FROM rgb""")
def rgb_to_ycbcr(spark, sf):
    y, cb, cr = color.rgb_to_ycbcr(F.col("r"), F.col("g"), F.col("b"))
    return groups(spark, sf, 3, "rgb").select("row", "p", y.alias("y"), cb.alias("cb"), cr.alias("cr"))


@_query("SELECT row, p, least(255, c + 255 - k) AS r, least(255, m + 255 - k) AS g, least(255, y + 255 - k) AS b FROM quad")
def rgba_over_white(spark, sf):
    return groups(spark, sf, 4, "cmyk").select("row", "p", *[color.rgba_to_rgb(F.col(c), F.col("k")).alias(n) for c, n in zip("cmy", "rgb", strict=True)])


@_query("SELECT row, col, chr(92) || (q // 64) || (q // 8 % 8) || (q % 8) AS v FROM px")
def octal_escape(spark, sf):
    return px(spark, sf).select("row", "col", color.octal(F.col("q")).alias("v"))


# Pages


@_query("SELECT conv_id, count(*) AS n_pages FROM conversations GROUP BY conv_id")
def ifd_count(spark, sf):
    return pages.count_pages(table(spark, sf, "conversations"), ["conv_id"])


@_query("SELECT conv_id, turn, role FROM conversations WHERE turn IN (0, 2)")
def page_select(spark, sf):
    return pages.select_pages(table(spark, sf, "conversations"), "turn", [0, 2]).select("conv_id", "turn", "role")


@_query("SELECT conv_id, turn, role FROM conversations WHERE turn >= 1")
def page_after(spark, sf):
    return pages.select_pages(table(spark, sf, "conversations"), "turn", first=1).select("conv_id", "turn", "role")


@_query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS new_page FROM conversations WHERE NOT turn = conv_id % 4")
def page_unlink(spark, sf):
    own = table(spark, sf, "conversations").select("conv_id", "turn")
    return pages.unlink_page(own, own.where(F.col("turn") == F.pmod(F.col("conv_id"), F.lit(4))), ["conv_id"], "turn")


@_query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) % 10, turn) - 1 AS position FROM conversations")
def page_sort(spark, sf):
    own = table(spark, sf, "conversations").select("conv_id", "turn", F.pmod(F.length("text"), F.lit(10)).alias("number"))
    return pages.sort_pages(own, ["conv_id"], "number", "turn").select("conv_id", "turn", "position")


@_query("SELECT conv_id, turn, CAST(0 AS BIGINT) AS input_pos FROM conversations WHERE turn = 0 UNION ALL SELECT conv_id, turn, CAST(1 AS BIGINT) FROM conversations WHERE turn > 0")
def page_concat(spark, sf):
    own = table(spark, sf, "conversations").select("conv_id", "turn")
    return pages.concat_pages([own.where("turn = 0"), own.where("turn > 0")])


# Tags


@_query("SELECT p_partkey, CAST(t.tag AS BIGINT) AS tag, CASE t.tag WHEN 256 THEN p_size WHEN 257 THEN p_size * 2 ELSE length(p_name) END AS value FROM part, (VALUES (256), (257), (270)) t(tag)")
def tag_eav(spark, sf):
    parts = table(spark, sf, "part")
    return tags.to_tags(parts, ["p_partkey"], {256: F.col("p_size").cast("long"), 257: F.col("p_size").cast("long") * 2, 270: F.length("p_name").cast("long")})


@_query("SELECT p_partkey, CAST(t.tag AS BIGINT) AS tag, CASE WHEN t.tag = 256 AND p_size > 10 THEN p_size ELSE t.d END AS value FROM part, (VALUES (256, 1), (258, 8)) t(tag, d)")
def tag_defaults(spark, sf):
    found = tag_eav(spark, sf).where("tag = 256 AND value > 10")
    defaults = spark.createDataFrame([(256, 1), (258, 8)], "tag long, default_value long")
    wanted = table(spark, sf, "part").select("p_partkey", F.explode(F.array(F.lit(256).cast("long"), F.lit(258).cast("long"))).alias("tag"))
    return tags.with_defaults(found, wanted, defaults, ["p_partkey"])


@_query("SELECT event_id, user_id % 65536 AS tag FROM events WHERE user_id % 65536 NOT IN (SELECT c_custkey % 65536 FROM customer WHERE c_custkey % 2 = 0)")
def tag_unknown(spark, sf):
    """Tags have 16 bits, so the registry has at most 65,536 of them."""
    short = lambda c: F.pmod(F.col(c), F.lit(65536)).alias("tag")
    registry = table(spark, sf, "customer").where(F.pmod(F.col("c_custkey"), F.lit(2)) == 0).select(short("c_custkey"))
    return tags.unknown(table(spark, sf, "events").select("event_id", short("user_id")), registry).select("event_id", "tag")


@_query("SELECT p_partkey, CAST(270 AS BIGINT) AS tag, length(p_name) AS value FROM part")
def tag_whitelist(spark, sf):
    return tags.whitelisted(tag_eav(spark, sf), spark.createDataFrame([(270,), (305,)], "tag long")).select("p_partkey", "tag", "value")


@_query(", r AS (SELECT CAST(p_size AS BIGINT) AS tag, p_type AS type FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), m AS (SELECT CAST(p_size AS BIGINT) AS tag, p_type AS type FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL), u AS (SELECT * FROM r UNION ALL SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.tag = m.tag AND r.type = m.type)) SELECT tag, type, row_number() OVER (ORDER BY tag, type DESC) - 1 AS position FROM u")
def registry_merge(spark, sf):
    fields = lambda k: table(spark, sf, "part").where(F.pmod(F.col("p_partkey"), F.lit(k)) == 0).select(F.col("p_size").cast("long").alias("tag"), F.col("p_type").alias("type")).distinct()
    return tags.sorted_registry(tags.merge_registry(fields(2), fields(3)))


@_query(""", t AS (SELECT p_partkey, t.tag, CASE t.tag WHEN 256 THEN p_size WHEN 257 THEN p_size * 2 ELSE length(p_name) END AS value FROM part, (VALUES (256), (257), (270)) t(tag))
SELECT p_partkey, string_agg('  ' || CASE tag WHEN 256 THEN 'ImageWidth' WHEN 257 THEN 'ImageLength' ELSE 'ImageDescription' END || ': ' || value, chr(13) || chr(10) ORDER BY tag) || chr(13) || chr(10) AS report FROM t GROUP BY p_partkey""")
def print_directory(spark, sf):
    name = F.when(F.col("tag") == 256, "ImageWidth").when(F.col("tag") == 257, "ImageLength").otherwise("ImageDescription")
    return tags.print_directory(tag_eav(spark, sf), ["p_partkey"], name)


@_query("SELECT o_orderkey, 'D:' || strftime(o_orderdate, '%Y%m%d%H%M%S') AS pdf_date FROM orders")
def date_convert(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", tags.pdf_date(F.col("o_orderdate")).alias("pdf_date"))


@_query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber <> 3 THEN CAST(l_quantity AS FLOAT) / CAST(l_linenumber - 3 AS FLOAT) ELSE 1 END AS FLOAT) AS value FROM lineitem")
def rational(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", tags.rational(F.col("l_quantity"), F.col("l_linenumber") - 3).alias("value"))


@_query("SELECT p_partkey, w.width, w.height FROM part JOIN (VALUES ('A4', 595, 842), ('LETTER', 612, 792), ('LEGAL', 612, 1008), ('JISB5', 516, 729), ('RA2', 1219, 1729), ('A10', 74, 105), ('QUARTO', 609, 780)) w(name, width, height) ON upper(CASE p_size % 8 WHEN 0 THEN 'a4' WHEN 1 THEN 'Letter' WHEN 2 THEN 'legal' WHEN 3 THEN 'jisb5' WHEN 4 THEN 'Ra2' WHEN 5 THEN 'a10' WHEN 6 THEN 'QUARTO' ELSE 'none' END) = w.name")
def paper_size(spark, sf):
    sizes = spark.createDataFrame([(name, w, h) for name, (w, h) in PAPERS.items()], "name string, width int, height int")
    asked = F.get(F.array(*[F.lit(x) for x in ("a4", "Letter", "legal", "jisb5", "Ra2", "a10", "QUARTO", "none")]), F.pmod(F.col("p_size"), F.lit(8)).cast("int"))
    return table(spark, sf, "part").select("p_partkey", F.upper(asked).alias("name")).join(F.broadcast(sizes), "name").select("p_partkey", "width", "height")


@_query("SELECT event_id, event_type FROM events WHERE value < 2 OR value IS NULL OR props IS NULL OR length(props) < 3")
def corrupt_rows(spark, sf):
    bad = (F.col("value") < 2) | F.col("value").isNull() | F.col("props").isNull() | (F.length("props") < 3)
    return table(spark, sf, "events").where(bad).select("event_id", "event_type")


@_query("SELECT row, col, CASE WHEN q > 127 THEN q - 256 ELSE q END AS signed, (q * 300) % 65536 AS wide, CASE WHEN q <= 100 THEN q END AS small FROM px")
def coercions(spark, sf):
    q = F.col("q")
    return px(spark, sf).select("row", "col", coerce.signed(q, "byte").alias("signed"), coerce.unsigned(coerce.signed(q * 300, "short"), "short").alias("wide"), coerce.checked(q + 27, "byte").alias("small")).withColumn("small", F.col("small") - 27)


@_query("""SELECT p_partkey, CAST(t.tag AS BIGINT) AS tag, CASE WHEN t.tag = 274 AND p_size NOT BETWEEN 1 AND 8 THEN 'an orientation is 1 to 8' WHEN t.tag = 266 AND p_size NOT IN (1, 2) THEN 'a fill order is 1 or 2'
WHEN t.tag = 284 AND p_size NOT IN (1, 2) THEN 'a planar configuration is 1 or 2' WHEN t.tag IN (322, 323) AND p_size % 16 <> 0 THEN 'the sides of a tile are multiples of 16' WHEN t.tag IN (277, 278) AND p_size = 0 THEN 'the value can''t be 0'
WHEN t.tag = 296 AND p_size NOT BETWEEN 1 AND 3 THEN 'a resolution unit is 1 to 3' WHEN t.tag = 339 AND p_size NOT BETWEEN 1 AND 6 THEN 'a sample format is 1 to 6' WHEN t.tag = 317 AND p_size NOT BETWEEN 1 AND 3 THEN 'a predictor is 1 to 3' END AS error
FROM (SELECT p_partkey, p_size % 33 AS p_size FROM part), (VALUES (274), (266), (284), (322), (323), (277), (278), (296), (339), (317), (256)) t(tag)""")
def field_check(spark, sf):
    """All rules, for sizes from 0 to 32."""
    values = F.array(*[F.lit(t).cast("long") for t in (274, 266, 284, 322, 323, 277, 278, 296, 339, 317, 256)])
    own = table(spark, sf, "part").select("p_partkey", F.pmod(F.col("p_size"), F.lit(33)).alias("value"), F.explode(values).alias("tag"))
    return own.select("p_partkey", "tag", checks.field_error(F.col("tag"), F.col("value")).alias("error"))


@_query("SELECT p_partkey, CASE WHEN p_size % 3 + 1 <= p_size % 4 THEN '2' || repeat(',1', CAST(p_size % 3 AS INTEGER)) END AS extra FROM part")
def extra_samples(spark, sf):
    """The faulty 999 counts as unassociated alpha; more extra samples than samples are none."""
    extra = F.concat(F.array(F.lit(999)), F.array_repeat(F.lit(1), F.pmod(F.col("p_size"), F.lit(3)).cast("int")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(checks.valid_extra_samples(extra, F.pmod(F.col("p_size"), F.lit(4))), lambda x: x.cast("string")), ",").alias("extra"))


@_query("SELECT p_partkey, len(string_split(p_name, ' ')) = p_size % 6 AS valid FROM part")
def ink_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", checks.valid_ink_names(F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("\0")), F.lit("\0")), F.pmod(F.col("p_size"), F.lit(6))).alias("valid"))


@_query("SELECT p_partkey, p_partkey * 1000 >= 65536 AS pseudo, p_size % 2 = 0 AND p_size % 3 = 0 AS old_jpeg FROM part")
def tag_kinds(spark, sf):
    """Pseudo tags, and JPEG data of the old style by its tags."""
    size = F.col("p_size")
    scheme = F.when(F.pmod(size, F.lit(2)) == 0, 7).otherwise(6)
    own = F.when(F.pmod(size, F.lit(3)) == 0, F.array(F.lit(256), F.lit(519))).otherwise(F.array(F.lit(256), F.lit(347)))
    return table(spark, sf, "part").select("p_partkey", checks.is_pseudo(F.col("p_partkey") * 1000).alias("pseudo"), checks.is_old_jpeg(scheme, own).alias("old_jpeg"))


@_query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN CAST(p_size AS BIGINT) WHEN 1 THEN CAST(p_size * 8 + 4 AS BIGINT) ELSE 0 END AS numerator, CAST(CASE p_size % 3 WHEN 1 THEN 8 ELSE 1 END AS BIGINT) AS denominator FROM part")
def to_rational(spark, sf):
    """Whole numbers, halves and negative numbers as rationals."""
    kind, size = F.pmod(F.col("p_size"), F.lit(3)), F.col("p_size").cast("double")
    found = tags.to_rational(F.when(kind == 0, size).when(kind == 1, size + 0.5).otherwise(-size))
    return table(spark, sf, "part").select("p_partkey", found["numerator"].alias("numerator"), found["denominator"].alias("denominator"))


@_query("SELECT p_partkey, p_name || chr(92) || '011' || p_brand || chr(92) || '012' AS shown FROM part")
def printable_text(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tags.printable(F.concat("p_name", F.lit("\t"), "p_brand", F.lit("\n"))).alias("shown"))


@_query("SELECT p_partkey, CAST(p_size AS BIGINT) + 256 * (p_size + 1) AS little, CAST(p_size AS BIGINT) * 256 + p_size + 1 AS big, CAST(NULL AS BIGINT) AS odd FROM part")
def regrouped_bytes(spark, sf):
    """Bytes as whole numbers of two bytes; a length that isn't a multiple gives none."""
    raw = F.unhex(F.concat(F.lpad(F.hex("p_size"), 2, "0"), F.lpad(F.hex(F.col("p_size") + 1), 2, "0")))
    three = F.concat(raw, F.unhex(F.lit("00")))
    return table(spark, sf, "part").select("p_partkey", coerce.regroup(raw, 2)[0].alias("little"), coerce.regroup(raw, 2, True)[0].alias("big"), coerce.regroup(three, 2)[0].alias("odd"))


@_query("SELECT p_partkey, CAST(p_size AS BIGINT) AS first, CASE WHEN p_size * 10 <= 127 THEN CAST(p_size * 10 AS BIGINT) END AS second FROM part")
def array_coercion(spark, sf):
    """Arrays cast element by element; what doesn't fit is null."""
    found = coerce.array_to(F.array(F.col("p_size").cast("long"), F.col("p_size").cast("long") * 10), "tinyint")
    return table(spark, sf, "part").select("p_partkey", found[0].cast("long").alias("first"), found[1].cast("long").alias("second"))


@_query("SELECT p_partkey, CASE WHEN CAST(p_partkey AS BIGINT) * p_size * 1000000 <= 2147483647 THEN CAST(p_partkey AS BIGINT) * p_size * 1000000 ELSE 0 END AS product FROM part")
def checked_product(spark, sf):
    return table(spark, sf, "part").select("p_partkey", geometry.checked_product(F.col("p_partkey") * F.col("p_size"), F.lit(1000000)).alias("product"))


@_query("SELECT p_partkey, (p_size * 3 * 8 + 7) // 8 AS old, (((p_size + 1) // 2 * 6 * 8 + 7) // 8) // 2 AS new FROM part")
def packed_scanlines(spark, sf):
    found = geometry.packed_scanline_bytes("p_size", 3, 8, 2, 2)
    return table(spark, sf, "part").select("p_partkey", found["old"].alias("old"), found["new"].alias("new"))


@_query(", t AS (SELECT p_partkey, p_partkey % 12 AS tile, 50 AS w, 40 AS h FROM part) SELECT p_partkey, (tile % 4 = 3) AS right, (tile // 4 = 2) AS bottom, least(16, w - tile % 4 * 16) AS w, least(16, h - tile // 4 * 16) AS h FROM t")
def edge_tiles(spark, sf):
    found = geometry.tile_edges(F.pmod(F.col("p_partkey"), F.lit(12)), 50, 40, 16, 16)
    return table(spark, sf, "part").select("p_partkey", *[found[c].alias(c) for c in ("right", "bottom", "w", "h")])


@_query("""SELECT p_partkey, n.r, n.g, n.b FROM (SELECT p_partkey, p_size + 8 AS m FROM part) o JOIN (WITH RECURSIVE k AS (SELECT CAST(m AS BIGINT) AS m, CAST(floor(pow(m, 1.0 / 3) + 0.000001) AS BIGINT) AS k FROM range(8, 60) t(m)),
l AS (SELECT m, k AS r, k AS g, k AS b FROM k UNION SELECT m, CASE WHEN up >= 2 THEN r + 1 ELSE r END, CASE WHEN up >= 1 THEN g + 1 ELSE g END, CASE WHEN up = 3 THEN b + 1 ELSE b END
FROM (SELECT *, CASE WHEN r * (g + 1) * b > m THEN 0 WHEN (r + 1) * (g + 1) * b > m THEN 1 WHEN (r + 1) * (g + 1) * (b + 1) > m THEN 2 ELSE 3 END AS up FROM l))
SELECT m, max_by(r, r * g * b) AS r, max_by(g, r * g * b) AS g, max_by(b, r * g * b) AS b FROM l GROUP BY m) n ON n.m = o.m""")
def component_levels(spark, sf):
    """Levels of red, green and blue in a grid of p_size + 8 colours."""
    grids = spark.createDataFrame([(m, *quantize.component_levels(m)) for m in range(8, 60)], "m long, r long, g long, b long")  # sizes are 1 to 50
    return table(spark, sf, "part").select("p_partkey", (F.col("p_size") + 8).cast("long").alias("m")).join(F.broadcast(grids), "m").select("p_partkey", "r", "g", "b")


@_query(", d AS (SELECT row, col, q, (VALUES_[(row % 2) * 2 + col % 2 + 1]) AS t FROM (SELECT row, col, q, [0, 2, 3, 1] AS VALUES_ FROM px)) SELECT row, col, CAST((q * 3 * 4 + t * 255 + 127) // (255 * 4) AS BIGINT) AS level FROM d")
def ordered_dither(spark, sf):
    return px(spark, sf).select("row", "col", quantize.ordered_dither(F.col("q"), F.col("row"), F.col("col"), 4, 2).cast("long").alias("level"))


@_query("SELECT row, col, CAST((q * 5 * 2 + 255) // 510 AS BIGINT) AS level FROM px")
def grid_levels(spark, sf):
    return px(spark, sf).select("row", "col", quantize.grid_color(F.col("q"), 6).cast("long").alias("level"))


@_query(", p3 AS (SELECT row, p, r, g, b FROM rgb), d AS (SELECT row, p, i, (r - c1) * (r - c1) + (g - c2) * (g - c2) + (b - c3) * (b - c3) AS d FROM p3, (VALUES (0, 0, 0, 0), (1, 255, 255, 255), (2, 128, 128, 128), (3, 150, 110, 128), (4, 110, 150, 128)) c(i, c1, c2, c3)) SELECT row, p, CAST(arg_min(i, d * 8 + i) AS BIGINT) AS color FROM d GROUP BY row, p")
def nearest_color(spark, sf):
    colors = [(0, 0, 0), (255, 255, 255), (128, 128, 128), (150, 110, 128), (110, 150, 128)]
    return groups(spark, sf, 3, "rgb").select("row", "p", quantize.nearest(F.col("r"), F.col("g"), F.col("b"), colors).cast("long").alias("color"))


@_query("SELECT r >> 3 AS r, g >> 3 AS g, b >> 3 AS b, count(*) AS n FROM rgb GROUP BY 1, 2, 3")
def color_histogram(spark, sf):
    return quantize.color_histogram(groups(spark, sf, 3, "rgb"))


@_query("SELECT q AS symbol, count(*) AS n FROM px GROUP BY 1")
def symbol_counts(spark, sf):
    return quantize.symbol_counts(px(spark, sf).select(F.col("q").alias("symbol")), "symbol")


@_query("SELECT true AS complete, true AS ordered FROM (SELECT count(*) AS n FROM px)")
def huffman_code(spark, sf):
    """A code of lengths whose shares add up to 1 less the one reserved word, and no more frequent symbol has a longer word."""
    own = px(spark, sf).select(F.col("q").alias("symbol"))
    both = quantize.huffman_lengths(own, "symbol").join(quantize.symbol_counts(own, "symbol"), "symbol")
    by_length = both.groupBy("length").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    shares = both.agg((F.sum(F.pow(F.lit(2.0), -F.col("length"))) + F.pow(F.lit(2.0), -F.max("length")) == 1).alias("complete"), F.lit(1).alias("k"))
    lengths = by_length.agg(F.array_sort(F.collect_list(F.struct("length", "least", "most"))).alias("l"), F.lit(1).alias("k"))  # at most 16 lengths
    steps = F.zip_with(F.slice("l", F.lit(1), F.size("l") - 1), F.slice("l", F.lit(2), F.size("l") - 1), lambda a, b: a["least"] >= b["most"])
    return shares.join(lengths, "k").select("complete", F.forall(steps, lambda x: x).alias("ordered"))


@_query("SELECT event_id, event_type FROM events WHERE value < 2 OR value IS NULL OR props IS NULL OR length(props) < 3")
def corrupt_rows(spark, sf):
    bad = (F.col("value") < 2) | F.col("value").isNull() | F.col("props").isNull() | (F.length("props") < 3)
    return table(spark, sf, "events").where(bad).select("event_id", "event_type")


@_query("SELECT row, col, CASE WHEN q > 127 THEN q - 256 ELSE q END AS signed, (q * 300) % 65536 AS wide, CASE WHEN q <= 100 THEN q END AS small FROM px")
def coercions(spark, sf):
    q = F.col("q")
    return px(spark, sf).select("row", "col", coerce.signed(q, "byte").alias("signed"), coerce.unsigned(coerce.signed(q * 300, "short"), "short").alias("wide"), coerce.checked(q + 27, "byte").alias("small")).withColumn("small", F.col("small") - 27)


@_query("""SELECT p_partkey, CAST(t.tag AS BIGINT) AS tag, CASE WHEN t.tag = 274 AND p_size NOT BETWEEN 1 AND 8 THEN 'an orientation is 1 to 8' WHEN t.tag = 266 AND p_size NOT IN (1, 2) THEN 'a fill order is 1 or 2'
WHEN t.tag = 284 AND p_size NOT IN (1, 2) THEN 'a planar configuration is 1 or 2' WHEN t.tag IN (322, 323) AND p_size % 16 <> 0 THEN 'the sides of a tile are multiples of 16' WHEN t.tag IN (277, 278) AND p_size = 0 THEN 'the value can''t be 0'
WHEN t.tag = 296 AND p_size NOT BETWEEN 1 AND 3 THEN 'a resolution unit is 1 to 3' WHEN t.tag = 339 AND p_size NOT BETWEEN 1 AND 6 THEN 'a sample format is 1 to 6' WHEN t.tag = 317 AND p_size NOT BETWEEN 1 AND 3 THEN 'a predictor is 1 to 3' END AS error
FROM (SELECT p_partkey, p_size % 33 AS p_size FROM part), (VALUES (274), (266), (284), (322), (323), (277), (278), (296), (339), (317), (256)) t(tag)""")
def field_check(spark, sf):
    """All rules, for sizes from 0 to 32."""
    values = F.array(*[F.lit(t).cast("long") for t in (274, 266, 284, 322, 323, 277, 278, 296, 339, 317, 256)])
    own = table(spark, sf, "part").select("p_partkey", F.pmod(F.col("p_size"), F.lit(33)).alias("value"), F.explode(values).alias("tag"))
    return own.select("p_partkey", "tag", checks.field_error(F.col("tag"), F.col("value")).alias("error"))


@_query("SELECT p_partkey, CASE WHEN p_size % 3 + 1 <= p_size % 4 THEN '2' || repeat(',1', CAST(p_size % 3 AS INTEGER)) END AS extra FROM part")
def extra_samples(spark, sf):
    """The faulty 999 counts as unassociated alpha; more extra samples than samples are none."""
    extra = F.concat(F.array(F.lit(999)), F.array_repeat(F.lit(1), F.pmod(F.col("p_size"), F.lit(3)).cast("int")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(checks.valid_extra_samples(extra, F.pmod(F.col("p_size"), F.lit(4))), lambda x: x.cast("string")), ",").alias("extra"))


@_query("SELECT p_partkey, len(string_split(p_name, ' ')) = p_size % 6 AS valid FROM part")
def ink_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", checks.valid_ink_names(F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("\0")), F.lit("\0")), F.pmod(F.col("p_size"), F.lit(6))).alias("valid"))


@_query("SELECT p_partkey, p_partkey * 1000 >= 65536 AS pseudo, p_size % 2 = 0 AND p_size % 3 = 0 AS old_jpeg FROM part")
def tag_kinds(spark, sf):
    """Pseudo tags, and JPEG data of the old style by its tags."""
    size = F.col("p_size")
    scheme = F.when(F.pmod(size, F.lit(2)) == 0, 7).otherwise(6)
    own = F.when(F.pmod(size, F.lit(3)) == 0, F.array(F.lit(256), F.lit(519))).otherwise(F.array(F.lit(256), F.lit(347)))
    return table(spark, sf, "part").select("p_partkey", checks.is_pseudo(F.col("p_partkey") * 1000).alias("pseudo"), checks.is_old_jpeg(scheme, own).alias("old_jpeg"))


@_query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN CAST(p_size AS BIGINT) WHEN 1 THEN CAST(p_size * 8 + 4 AS BIGINT) ELSE 0 END AS numerator, CAST(CASE p_size % 3 WHEN 1 THEN 8 ELSE 1 END AS BIGINT) AS denominator FROM part")
def to_rational(spark, sf):
    """Whole numbers, halves and negative numbers as rationals."""
    kind, size = F.pmod(F.col("p_size"), F.lit(3)), F.col("p_size").cast("double")
    found = tags.to_rational(F.when(kind == 0, size).when(kind == 1, size + 0.5).otherwise(-size))
    return table(spark, sf, "part").select("p_partkey", found["numerator"].alias("numerator"), found["denominator"].alias("denominator"))


@_query("SELECT p_partkey, p_name || chr(92) || '011' || p_brand || chr(92) || '012' AS shown FROM part")
def printable_text(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tags.printable(F.concat("p_name", F.lit("\t"), "p_brand", F.lit("\n"))).alias("shown"))


@_query("SELECT p_partkey, CAST(p_size AS BIGINT) + 256 * (p_size + 1) AS little, CAST(p_size AS BIGINT) * 256 + p_size + 1 AS big, CAST(NULL AS BIGINT) AS odd FROM part")
def regrouped_bytes(spark, sf):
    """Bytes as whole numbers of two bytes; a length that isn't a multiple gives none."""
    raw = F.unhex(F.concat(F.lpad(F.hex("p_size"), 2, "0"), F.lpad(F.hex(F.col("p_size") + 1), 2, "0")))
    three = F.concat(raw, F.unhex(F.lit("00")))
    return table(spark, sf, "part").select("p_partkey", coerce.regroup(raw, 2)[0].alias("little"), coerce.regroup(raw, 2, True)[0].alias("big"), coerce.regroup(three, 2)[0].alias("odd"))


@_query("SELECT p_partkey, CAST(p_size AS BIGINT) AS first, CASE WHEN p_size * 10 <= 127 THEN CAST(p_size * 10 AS BIGINT) END AS second FROM part")
def array_coercion(spark, sf):
    """Arrays cast element by element; what doesn't fit is null."""
    found = coerce.array_to(F.array(F.col("p_size").cast("long"), F.col("p_size").cast("long") * 10), "tinyint")
    return table(spark, sf, "part").select("p_partkey", found[0].cast("long").alias("first"), found[1].cast("long").alias("second"))


@_query("SELECT p_partkey, CASE WHEN CAST(p_partkey AS BIGINT) * p_size * 1000000 <= 2147483647 THEN CAST(p_partkey AS BIGINT) * p_size * 1000000 ELSE 0 END AS product FROM part")
def checked_product(spark, sf):
    return table(spark, sf, "part").select("p_partkey", geometry.checked_product(F.col("p_partkey") * F.col("p_size"), F.lit(1000000)).alias("product"))


@_query("SELECT p_partkey, (p_size * 3 * 8 + 7) // 8 AS old, (((p_size + 1) // 2 * 6 * 8 + 7) // 8) // 2 AS new FROM part")
def packed_scanlines(spark, sf):
    found = geometry.packed_scanline_bytes("p_size", 3, 8, 2, 2)
    return table(spark, sf, "part").select("p_partkey", found["old"].alias("old"), found["new"].alias("new"))


@_query(", t AS (SELECT p_partkey, p_partkey % 12 AS tile, 50 AS w, 40 AS h FROM part) SELECT p_partkey, (tile % 4 = 3) AS right, (tile // 4 = 2) AS bottom, least(16, w - tile % 4 * 16) AS w, least(16, h - tile // 4 * 16) AS h FROM t")
def edge_tiles(spark, sf):
    found = geometry.tile_edges(F.pmod(F.col("p_partkey"), F.lit(12)), 50, 40, 16, 16)
    return table(spark, sf, "part").select("p_partkey", *[found[c].alias(c) for c in ("right", "bottom", "w", "h")])


@_query("""SELECT p_partkey, n.r, n.g, n.b FROM (SELECT p_partkey, p_size + 8 AS m FROM part) o JOIN (WITH RECURSIVE k AS (SELECT CAST(m AS BIGINT) AS m, CAST(floor(pow(m, 1.0 / 3) + 0.000001) AS BIGINT) AS k FROM range(8, 60) t(m)),
l AS (SELECT m, k AS r, k AS g, k AS b FROM k UNION SELECT m, CASE WHEN up >= 2 THEN r + 1 ELSE r END, CASE WHEN up >= 1 THEN g + 1 ELSE g END, CASE WHEN up = 3 THEN b + 1 ELSE b END
FROM (SELECT *, CASE WHEN r * (g + 1) * b > m THEN 0 WHEN (r + 1) * (g + 1) * b > m THEN 1 WHEN (r + 1) * (g + 1) * (b + 1) > m THEN 2 ELSE 3 END AS up FROM l))
SELECT m, max_by(r, r * g * b) AS r, max_by(g, r * g * b) AS g, max_by(b, r * g * b) AS b FROM l GROUP BY m) n ON n.m = o.m""")
def component_levels(spark, sf):
    """Levels of red, green and blue in a grid of p_size + 8 colours."""
    grids = spark.createDataFrame([(m, *quantize.component_levels(m)) for m in range(8, 60)], "m long, r long, g long, b long")  # sizes are 1 to 50
    return table(spark, sf, "part").select("p_partkey", (F.col("p_size") + 8).cast("long").alias("m")).join(F.broadcast(grids), "m").select("p_partkey", "r", "g", "b")


@_query(", d AS (SELECT row, col, q, (VALUES_[(row % 2) * 2 + col % 2 + 1]) AS t FROM (SELECT row, col, q, [0, 2, 3, 1] AS VALUES_ FROM px)) SELECT row, col, CAST((q * 3 * 4 + t * 255 + 127) // (255 * 4) AS BIGINT) AS level FROM d")
def ordered_dither(spark, sf):
    return px(spark, sf).select("row", "col", quantize.ordered_dither(F.col("q"), F.col("row"), F.col("col"), 4, 2).cast("long").alias("level"))


@_query("SELECT row, col, CAST((q * 5 * 2 + 255) // 510 AS BIGINT) AS level FROM px")
def grid_levels(spark, sf):
    return px(spark, sf).select("row", "col", quantize.grid_color(F.col("q"), 6).cast("long").alias("level"))


@_query(", p3 AS (SELECT row, p, r, g, b FROM rgb), d AS (SELECT row, p, i, (r - c1) * (r - c1) + (g - c2) * (g - c2) + (b - c3) * (b - c3) AS d FROM p3, (VALUES (0, 0, 0, 0), (1, 255, 255, 255), (2, 128, 128, 128), (3, 150, 110, 128), (4, 110, 150, 128)) c(i, c1, c2, c3)) SELECT row, p, CAST(arg_min(i, d * 8 + i) AS BIGINT) AS color FROM d GROUP BY row, p")
def nearest_color(spark, sf):
    colors = [(0, 0, 0), (255, 255, 255), (128, 128, 128), (150, 110, 128), (110, 150, 128)]
    return groups(spark, sf, 3, "rgb").select("row", "p", quantize.nearest(F.col("r"), F.col("g"), F.col("b"), colors).cast("long").alias("color"))


@_query("SELECT r >> 3 AS r, g >> 3 AS g, b >> 3 AS b, count(*) AS n FROM rgb GROUP BY 1, 2, 3")
def color_histogram(spark, sf):
    return quantize.color_histogram(groups(spark, sf, 3, "rgb"))


@_query("SELECT q AS symbol, count(*) AS n FROM px GROUP BY 1")
def symbol_counts(spark, sf):
    return quantize.symbol_counts(px(spark, sf).select(F.col("q").alias("symbol")), "symbol")


@_query("SELECT true AS complete, true AS ordered FROM (SELECT count(*) AS n FROM px)")
def huffman_code(spark, sf):
    """A code of lengths whose shares add up to 1 less the one reserved word, and no more frequent symbol has a longer word."""
    own = px(spark, sf).select(F.col("q").alias("symbol"))
    both = quantize.huffman_lengths(own, "symbol").join(quantize.symbol_counts(own, "symbol"), "symbol")
    by_length = both.groupBy("length").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.sum(F.pow(F.lit(2.0), -F.col("length"))).alias("share"))
    longer = by_length.select(F.col("length").alias("other"), F.col("most").alias("other_most"))
    ordered = by_length.join(longer, F.col("other") > F.col("length"), "left").agg(F.coalesce(F.min(F.col("least") >= F.coalesce("other_most", F.lit(0))), F.lit(True)).alias("ordered"))
    share = by_length.agg((F.sum("share") + F.pow(F.lit(2.0), -F.max("length")) == 1).alias("complete"))
    return share.join(ordered, F.lit(True))


@_query("SELECT row, CAST(min(q) AS BIGINT) AS low, CAST(max(q) AS BIGINT) AS high, CAST(max(q) FILTER (col < 40) AS BIGINT) AS cut FROM px GROUP BY row")
def trimmed_values(spark, sf):
    cut = checks.trimmed_count(F.col("q"), F.lit(40))
    return raster(spark, sf).select("row", F.array_min("q").alias("low"), F.array_max("q").alias("high"), F.array_max(cut).alias("cut"))


@_query("SELECT o_orderkey, make_timestamp(year(o_orderdate), month(o_orderdate), day(o_orderdate), hour(o_orderdate), minute(o_orderdate), second(o_orderdate)) AS parsed FROM orders")
def date_parse(spark, sf):
    text = F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")
    return table(spark, sf, "orders").select("o_orderkey", tags.parse_date(text).cast("timestamp_ntz").alias("parsed"))


@_query("SELECT p_partkey, p_name || ' ' || chr(92) || '(' || p_size || chr(92) || ')' AS literal FROM part")
def pdf_literal(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tags.pdf_literal(F.concat("p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit(")"))).alias("literal"))
