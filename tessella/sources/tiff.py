"""TIFF files as DataFrames: files, directories, tags, chunks, rows of samples and RGBA pixels.

Files are the unit of parallel work; a file is parsed in the task that reads it, and nothing is shuffled. Only columns that a query asks for
leave the parser: each table has its own pass, and chunk filters are applied before any chunk is decoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions import codecs, image
from ..shipping import bound_batches
from . import parse as P
from .registry import DEFAULTS, STRUCTURAL, VALUE_NAMES, extra_names

FILES = "path string, length long, byte_order string, version int, is_big boolean, first_ifd long, errors array<struct<code: string, msg: string>>"
DIRS = (
    "path string, ifd int, kind string, ifd_offset long, next_ifd long, width int, height int, depth int, bits_per_sample int, samples_per_pixel int, sample_format int, photometric int, compression int, planar int, "
    "predictor int, fill_order int, orientation int, rows_per_strip long, tile_width int, tile_length int, tile_depth int, extra_samples array<int>, ycbcr_subsampling array<int>, colormap array<array<int>>, x_res float, y_res float, "
    "res_unit int, n_chunks int, chunks_per_plane int, is_tiled boolean, errors array<struct<code: string, msg: string>>"
)
TAGS = "path string, ifd int, kind string, pos int, tag int, name string, type int, count long, is_custom boolean, raw binary, nums array<double>, str string, rationals array<struct<num: long, den: long>>"
CHUNKS = "path string, ifd int, chunk int, plane int, x0 int, y0 int, z0 int, w int, h int, offset long, bytecount long"
ROWS = "path string, ifd int, y0 int, row int, x0 int, samples array<array<double>>, error string"
PIXELS = "path string, ifd int, row int, x0 int, rgba array<int>, error string"
#: Bytes of files whose rows may share a batch.
SHARED = 1 << 18
#: Columns of TAGS that say which tag it is; the others have its values.
PLACE = ("ifd", "kind", "pos", "tag")
BYTES = "path string, ifd int, chunk int, plane int, x0 int, y0 int, w int, h int, data binary, error string"


def schema(text: str) -> StructType:
    return _parse_datatype_string(text)


def meta_of(d: P.Directory, g: P.Geometry, order: str, data: bytes = b"") -> image.Meta:
    """What decoding needs of a directory; old-style JPEG tables are in the file's data."""
    cmap = [int(x) for x in d.all(320)]
    third = len(cmap) // 3
    luma = tuple(d.all(529)[:3]) if len(d.all(529)) >= 3 else (0.299, 0.587, 0.114)
    tables = d.tags.get(347)
    return image.Meta(
        g.width, g.height, g.bits, g.samples, g.sample_format, g.photometric, g.compression, g.planar, g.predictor, g.fill_order, g.orientation, order, g.subsampling if g.photometric == 6 else (1, 1),
        [int(x) for x in d.all(338)], [cmap[:third], cmap[third : 2 * third], cmap[2 * third :]] if third else [], luma, [float(x) for x in d.all(532)], int(d.get(292, 0)), tables.raw if tables else P.old_jpeg_tables(d, data) if g.compression == codecs.OLD_JPEG else b"",
    )


@dataclass
class Options:
    """fail_fast raises on the first error; chop cuts single raw strips; user holds codecs that go before the built-in ones.

    directories has a caller's own schemas: by the tag that points to such a directory, its kind and the names of its tags. hook(tag, context) is called with each
    parsed tag (parse.Tag) and gives it, another one, or None to leave it out, before anything is made of it; context is whatever the caller likes.
    """

    header_only: bool = False
    fail_fast: bool = False
    chop: int = 0
    compat: bool = False
    user: dict = field(default_factory=dict)
    extra: dict[int, str] = field(default_factory=dict)
    directories: dict[int, tuple[str, dict[int, str]]] = field(default_factory=dict)
    hook: object = None
    context: object = None


def _file_row(path: str, data: bytes, f: P.TiffFile) -> dict:
    return {"path": path, "length": len(data), "byte_order": {"<": "II", ">": "MM"}.get(f.order), "version": f.version or None, "is_big": f.big, "first_ifd": f.first, "errors": [{"code": c, "msg": m} for c, m in f.errors]}


def _dir_row(path: str, d: P.Directory, f: P.TiffFile, size: int) -> dict:
    g = P.geometry(d) if d.kind in ("main", "sub") else None
    n = len(P.chunks(d, g, size)) if g else 0
    cmap = [int(x) for x in d.all(320)]
    third = len(cmap) // 3
    row = {"path": path, "ifd": d.ifd, "kind": d.kind, "ifd_offset": d.offset, "next_ifd": d.next}
    if g:
        row |= {
            "width": g.width, "height": g.height, "depth": g.depth, "bits_per_sample": g.bits, "samples_per_pixel": g.samples, "sample_format": g.sample_format, "photometric": g.photometric, "compression": g.compression,
            "planar": g.planar, "predictor": g.predictor, "fill_order": g.fill_order, "orientation": g.orientation, "rows_per_strip": None if g.tiled else g.rows_per_strip, "tile_width": g.tile_width if g.tiled else None,
            "tile_length": g.tile_length if g.tiled else None, "tile_depth": g.tile_depth if g.tiled else None, "extra_samples": [int(x) for x in d.all(338)], "ycbcr_subsampling": list(g.subsampling) if g.photometric == 6 else None,
            "colormap": [cmap[:third], cmap[third : 2 * third], cmap[2 * third :]] if third else None, "x_res": d.get(282), "y_res": d.get(283), "res_unit": int(d.get(296, 2)), "n_chunks": n, "chunks_per_plane": g.per_plane, "is_tiled": g.tiled,
        }
    return row | {"errors": [{"code": c, "msg": m} for c, m in dict.fromkeys(d.errors)]}


_TAG_TYPES = {text.split(" ")[0]: text for text in re.split(r", (?![^<]*>)", TAGS)}
_TAG_VALUES = {
    "name": lambda t: t.name, "type": lambda t: t.type, "count": lambda t: t.count, "is_custom": lambda t: t.tag not in STRUCTURAL, "raw": lambda t: t.raw, "nums": lambda t: [float(x) for x in t.nums] or None,
    "str": lambda t: t.text, "rationals": lambda t: [{"num": a, "den": b} for a, b in t.rationals] or None,
}


def _tag_rows(path: str, d: P.Directory, wanted: set[int] | None = None, columns: tuple[str, ...] | None = None) -> Iterator[dict]:
    for t in d.tags.values():
        if wanted is not None and t.tag not in wanted:
            continue
        if columns is not None:
            yield {"path": path, "ifd": d.ifd, "kind": d.kind, "pos": t.pos, "tag": t.tag} | {c: _TAG_VALUES[c](t) for c in columns}
            continue
        yield {
            "path": path, "ifd": d.ifd, "kind": d.kind, "pos": t.pos, "tag": t.tag, "name": t.name, "type": t.type, "count": t.count, "is_custom": t.tag not in STRUCTURAL, "raw": t.raw, "nums": [float(x) for x in t.nums] or None,
            "str": t.text, "rationals": [{"num": a, "den": b} for a, b in t.rationals] or None,
        }


def _batch(rows: list[dict], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(k.name) for r in rows], k.type) for k in arrow], schema=arrow)


def batch_of(arrow: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of arrays and of single values, which are repeated; columns are in the schema's order."""
    n = max(len(v) for v in columns.values() if isinstance(v, (pa.Array, np.ndarray)))
    arrays = [v if isinstance(v, pa.Array) else pa.array(v) if isinstance(v, np.ndarray) else pa.array([v] * n, arrow.field(k).type) for k, v in columns.items()]
    return pa.RecordBatch.from_arrays([a.cast(arrow.field(k).type) for k, a in zip(columns, arrays, strict=True)], schema=arrow)


@dataclass
class Scan:
    """What a task reads of a file: options, ranges of rows ("y") and columns ("x"), and directories."""

    options: Options
    ranges: dict[str, tuple[int, int]] = field(default_factory=dict)
    pages: list[int] | None = None

    def wanted(self, c: P.Chunk) -> bool:
        x, y = self.ranges.get("x"), self.ranges.get("y")
        return (not x or (c.x <= x[1] and c.x + c.w > x[0])) and (not y or (c.y <= y[1] and c.y + c.h > y[0]))

    def images(self, data: bytes, f: P.TiffFile) -> Iterator[tuple]:
        for d in f.directories:
            g = P.geometry(d) if d.kind in ("main", "sub") else None
            if g:
                yield d, g, P.chunks(d, g, len(data), self.options.chop)

    def arrays(self, data: bytes, f: P.TiffFile) -> Iterator[tuple]:
        """Directory, its needs, and for each place the samples within the image, or an error."""
        for d, g, found in self.images(data, f):
            m = meta_of(d, g, f.order, data)
            places: dict[int, list[P.Chunk]] = {}
            for c in found:
                places.setdefault(c.number - c.plane * g.per_plane, []).append(c)
            for own in places.values():
                c = own[0]
                if not self.wanted(c):
                    continue
                try:
                    a = image.decode_chunk([data[k.offset : k.offset + k.size] for k in own], m, c.w, c.h, self.options.user)
                    yield d, m, c, a[: g.height - c.y, : g.width - c.x], None
                except (ValueError, IndexError) as e:
                    yield d, m, c, None, str(e)


class Tiff:
    """Tables of the files of a DataFrame (path, content)."""

    def __init__(self, contents: DataFrame, options: Options | None = None):
        self.contents = contents.select(F.col("path").alias("path"), F.col("content").alias("content"))
        self.options = options or Options()
        self.options.user = codecs.registered() | self.options.user
        self.options.extra = extra_names() | self.options.extra
        self.scan = Scan(self.options)
        bound_batches(contents.sparkSession)

    def prune(self, rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None, pages: list[int] | None = None) -> Tiff:
        """Only chunks that touch these rows and columns (first, last) of these directories are read and decoded."""
        other = Tiff(self.contents, self.options)
        ranges = self.scan.ranges | ({"y": rows} if rows else {}) | ({"x": columns} if columns else {})
        other.scan = Scan(self.options, ranges, self.scan.pages if pages is None else pages)
        return other

    def _map(self, text: str, make, wanted: list[int] | None = None) -> DataFrame:
        """The rows that make(path, data, file) gives; small files share batches. With `wanted`, only these tags' values are read."""
        arrow = to_arrow_schema(schema(text))
        options, pages = self.options, self.scan.pages
        # a hook may give a tag another number, and errors count with fail_fast
        only = None if wanted is None or options.hook or options.fail_fast else set(wanted)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, seen = [], 0
                for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                    path, content = path.as_py(), content.as_py() or b""
                    f = P.parse(content, options.extra, options.header_only, options.directories, only)
                    if options.fail_fast and (f.errors or any(d.errors for d in f.directories)):
                        raise ValueError(f"{path}: {(f.errors + [e for d in f.directories for e in d.errors])[0]}")
                    if options.hook:
                        for d in f.directories:
                            d.tags = {t: new for t, tag in d.tags.items() if (new := options.hook(tag, options.context)) is not None}
                    if pages is not None:
                        f.directories = [d for d in f.directories if d.ifd in pages]
                    seen += len(content)
                    for row in make(path, content, f):
                        if isinstance(row, pa.RecordBatch):
                            yield row
                            continue
                        rows.append(row)
                        if len(rows) >= 256:
                            yield _batch(rows, arrow)
                            rows, seen = [], 0
                    if rows and seen >= SHARED:
                        yield _batch(rows, arrow)
                        rows, seen = [], 0
                if rows:
                    yield _batch(rows, arrow)

        return self.contents.mapInArrow(run, text)

    def files(self) -> DataFrame:
        return self._map(FILES, lambda path, data, f: [_file_row(path, data, f)])

    def dirs(self) -> DataFrame:
        return self._map(DIRS, lambda path, data, f: (_dir_row(path, d, f, len(data)) for d in f.directories))

    def tags(self, wanted: list[int] | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
        """A row for each tag. With `wanted`, only these tags are read; with `columns`, only these of their values leave the parser, beside path, ifd, kind, pos and tag."""
        text = TAGS if columns is None else ", ".join(["path string", *(_TAG_TYPES[c] for c in (*PLACE, *columns))])
        keep = None if wanted is None else set(wanted)
        return self._map(text, lambda path, data, f: (t for d in f.directories for t in _tag_rows(path, d, keep, columns)), wanted)

    def gathered(self, wanted: list[int] | None, columns: tuple[str, ...], by_directory: bool = False) -> DataFrame:
        """path (by_directory: and ifd and kind) and the array `tags` of the wanted tags of a file or directory, in the directories' order; ones without any give no row.

        What groups by file need of tags, without a shuffle: a file is parsed in one task.
        """
        keep, inner = None if wanted is None else set(wanted), ", ".join(_TAG_TYPES[c].replace(" ", ": ", 1) for c in (*PLACE, *columns))

        def make(path, data, f):
            for group in [[d] for d in f.directories] if by_directory else [f.directories]:
                if own := [t for d in group for t in _tag_rows(path, d, keep, columns)]:
                    yield {"path": path, "ifd": own[0]["ifd"], "kind": own[0]["kind"], "tags": own}

        return self._map(f"path string, {'ifd int, kind string, ' * by_directory}tags array<struct<{inner}>>", make, wanted)

    def chunks(self, raw: bool = False) -> DataFrame:
        """The chunks' places, and their compressed bytes if asked."""
        scan = self.scan

        def make(path, data, f):
            for d, _, found in scan.images(data, f):
                for c in filter(scan.wanted, found):
                    row = {"path": path, "ifd": d.ifd, "chunk": c.number, "plane": c.plane, "x0": c.x, "y0": c.y, "z0": c.z, "w": c.w, "h": c.h, "offset": c.offset, "bytecount": c.size}
                    yield row | ({"raw": data[c.offset : c.offset + c.size]} if raw else {})

        return self._map(CHUNKS + ", raw binary" * raw, make)

    def decoded(self) -> DataFrame:
        """The chunks' decoded bytes, or an error."""
        scan = self.scan

        def make(path, data, f):
            for d, g, found in scan.images(data, f):
                m = meta_of(d, g, f.order, data)
                for c in filter(scan.wanted, found):
                    out, error = None, None
                    try:
                        out = image.decode_bytes(data[c.offset : c.offset + c.size], m, c.w, c.h, scan.options.user)
                    except (ValueError, IndexError) as e:
                        error = str(e)
                    yield {"path": path, "ifd": d.ifd, "chunk": c.number, "plane": c.plane, "x0": c.x, "y0": c.y, "w": c.w, "h": c.h, "data": out, "error": error}

        return self._map(BYTES, make)

    def rows(self) -> DataFrame:
        """Image rows, cut at tiles, with an array of samples for each pixel; a chunk that can't be read is one row with an error."""
        scan, arrow = self.scan, to_arrow_schema(schema(ROWS))

        def make(path, data, f):
            for d, _, c, a, error in scan.arrays(data, f):
                if a is None:
                    yield {"path": path, "ifd": d.ifd, "y0": c.y, "row": None, "x0": c.x, "samples": None, "error": error}
                    continue
                h, w, n = a.shape
                pixels = pa.ListArray.from_arrays(pa.array(np.arange(0, h * w * n + 1, n, dtype=np.int32)), pa.array(np.ascontiguousarray(a, float).ravel()))
                lines = pa.ListArray.from_arrays(pa.array(np.arange(0, h * w + 1, w, dtype=np.int32)), pixels)
                yield batch_of(arrow, path=path, ifd=d.ifd, y0=c.y, row=np.arange(c.y, c.y + h, dtype=np.int32), x0=c.x, samples=lines, error=None)

        return self._map(ROWS, make)

    def pixels(self) -> DataFrame:
        """A row for each pixel: path, ifd, row, col, samples."""
        found = self.rows().where("error is null")
        out = found.select("path", "ifd", "row", "x0", F.posexplode("samples").alias("k", "samples"))
        out = out.select("path", "ifd", "row", (F.col("x0") + F.col("k")).alias("col"), "samples")
        for name, column in (("y", "row"), ("x", "col")):
            if name in self.scan.ranges:
                out = out.where(F.col(column).between(*self.scan.ranges[name]))
        return out

    def rgba(self, orient: bool = False) -> DataFrame:
        """Image rows of packed RGBA words, cut at tiles. orient moves them to the top-left origin; orientations that turn the image only flip it."""
        scan, arrow = self.scan, to_arrow_schema(schema(PIXELS))

        def make(path, data, f):
            from ..operators.relayout import ORIENTATIONS

            for d, m, c, a, error in scan.arrays(data, f):
                words = None
                if a is not None:
                    try:
                        words = image.pack_words(image.to_rgba(a, m, scan.options.compat))
                    except ValueError as e:
                        error = str(e)
                if words is None:
                    yield {"path": path, "ifd": d.ifd, "row": None, "x0": c.x, "rgba": None, "error": error}
                    continue
                up, left, _ = ORIENTATIONS.get(m.orientation, ORIENTATIONS[1]) if orient else (False, False, False)
                h, w = words.shape
                y = np.arange(c.y, c.y + h, dtype=np.int32)
                lines = pa.ListArray.from_arrays(pa.array(np.arange(0, h * w + 1, w, dtype=np.int32)), pa.array(np.ascontiguousarray(words[:, ::-1] if left else words).ravel()))
                yield batch_of(arrow, path=path, ifd=d.ifd, row=m.height - 1 - y if up else y, x0=m.width - c.x - w if left else c.x, rgba=lines, error=None)

        return self._map(PIXELS, make)

    def corrupt(self) -> DataFrame:
        """path, ifd and error of chunks that can't be decoded, and of files and directories with errors."""
        scan = self.scan

        def make(path, data, f):
            for d, g, found in scan.images(data, f):
                m = meta_of(d, g, f.order, data)
                for c in filter(scan.wanted, found):
                    try:
                        image.decode_bytes(data[c.offset : c.offset + c.size], m, c.w, c.h, scan.options.user)
                    except (ValueError, IndexError) as e:
                        yield {"path": path, "ifd": d.ifd, "error": str(e)}
            for d in f.directories:
                yield from ({"path": path, "ifd": d.ifd, "error": msg} for _, msg in dict.fromkeys(d.errors))
            yield from ({"path": path, "ifd": None, "error": msg} for _, msg in f.errors)

        return self._map("path string, ifd int, error string", make)

    def report(self) -> DataFrame:
        """A readable text of each directory."""
        from ..operators import tags as T

        named = F.create_map(*[F.lit(x) for t, values in VALUE_NAMES.items() for v, name in values.items() for x in (t << 16 | v, name)])

        def value(t):
            number = F.when((F.size(t["nums"]) == 1) & t["tag"].isin(list(VALUE_NAMES)), t["tag"] * 65536 + t["nums"][0].cast("int"))
            return F.coalesce(t["str"], named[number], F.array_join(F.transform(t["nums"], lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")), ", "), F.concat(F.lit("("), t["count"].cast("string"), F.lit(" bytes)")))

        found = self.gathered(None, ("name", "count", "nums", "str"), by_directory=True)
        return found.select("path", "ifd", T.directory_text(F.transform("tags", lambda t: F.struct(t["tag"].alias("tag"), T.directory_line(t["name"], value(t)).alias("line")))).alias("report"))

    def values(self, wanted: list[int]) -> DataFrame:
        """path, ifd, tag, values and is_set of the wanted tags of each image; a tag that isn't set has the format's default, which may depend on others."""

        def make(path, data, f):
            for d in f.directories:
                g = P.geometry(d) if d.kind in ("main", "sub") else None
                if not g:
                    continue
                top = float((1 << g.bits) - 1)
                derived = {
                    281: [top] * g.samples, 318: [0.3457, 0.3585], 336: [0.0, top], 338: [], 529: [0.299, 0.587, 0.114], 530: [2.0, 2.0],
                    532: [0.0, top, 0.0, top, 0.0, top] if g.photometric != 6 else [0.0, top, float(1 << (g.bits - 1)), top, float(1 << (g.bits - 1)), top],
                }
                for t in wanted:
                    own = [float(x) for x in d.all(t)]
                    default = derived.get(t, [float(DEFAULTS[t])] if t in DEFAULTS else None)
                    yield {"path": path, "ifd": d.ifd, "tag": t, "values": own or default, "is_set": t in d.tags}

        return self._map("path string, ifd int, tag int, values array<double>, is_set boolean", make)

    def with_defaults(self, wanted: list[int]) -> DataFrame:
        """path, ifd, tag and first value of the wanted tags of each directory, or the format's default."""
        spark = self.contents.sparkSession
        found = self.tags().select("path", "ifd", "tag", F.get("nums", F.lit(0)).alias("value"))
        keys = self.dirs().where("kind in ('main', 'sub')").select("path", "ifd", F.explode(F.array(*[F.lit(t) for t in wanted])).alias("tag"))
        defaults = spark.createDataFrame([(t, float(v)) for t, v in DEFAULTS.items()], "tag int, default_value double")
        from ..operators import tags as T

        return T.with_defaults(found, keys, defaults, ["path", "ifd"])


def read_tiff(spark: SparkSession, path: str | list[str], recursive: bool = False, glob: str = "*.tif*", **options) -> Tiff:
    """The files at a path that Spark can read; a file is at most 2 GiB, the size of Spark's binary values. Larger files, and headers alone, are read in ranges by `format("tiff")`."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return Tiff(reader.load(path), Options(**options))


def from_bytes(spark: SparkSession, files: list[tuple[str, bytes]], **options) -> Tiff:
    """Files that are in memory."""
    return Tiff(spark.createDataFrame(files, "path string, content binary"), Options(**options))


def meta_dict(m: image.Meta) -> dict:
    return asdict(m)


def arrays(data: bytes, page: int = 0, user: dict | None = None, ignore: bool = False, parsed: P.TiffFile | None = None) -> tuple[np.ndarray, image.Meta]:
    """One whole image of a file in memory, without Spark. With `ignore`, a chunk that can't be read is zeros. A file that is parsed already isn't parsed again."""
    f = parsed or P.parse(data)
    d = f.directories[page]
    g = P.geometry(d)
    if g is None:
        raise ValueError(str(d.errors))
    m = meta_of(d, g, f.order, data)
    return decoded_image(data, g, m, P.chunks(d, g, len(data)), user, ignore), m


def decoded_image(data: bytes, g: P.Geometry, m: image.Meta, found: list[P.Chunk], user: dict | None = None, ignore: bool = False) -> np.ndarray:
    """The image of one directory whose chunks are known."""
    out = None
    places: dict[int, list[P.Chunk]] = {}
    for c in found:
        places.setdefault(c.number - c.plane * g.per_plane, []).append(c)
    for own in places.values():
        c = own[0]
        try:
            a = image.decode_chunk([data[k.offset : k.offset + k.size] for k in own], m, c.w, c.h, user)[: g.height - c.y, : g.width - c.x]
        except (ValueError, IndexError):
            if not ignore:
                raise
            a = np.zeros((min(c.h, g.height - c.y), min(c.w, g.width - c.x), g.samples), np.int64)
        if out is None:
            out = np.zeros((g.height, g.width, a.shape[2]), a.dtype)
        out[c.y : c.y + a.shape[0], c.x : c.x + a.shape[1]] = a
    return out
