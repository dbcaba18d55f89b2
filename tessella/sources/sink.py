"""Writes TIFF and BigTIFF files: chunks are encoded where they are, and one task assembles each file."""

from __future__ import annotations

import dataclasses
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import codecs, image
from ..shipping import bound_batches, spread, task_number
from . import parse as P
from .registry import TYPE_SIZE

_LETTERS = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: Types of whole numbers; most tags have one value of these.
_WHOLE = {1, 3, 4, 6, 8, 9, 13, 16, 17, 18}
STRIP_BYTES, TILE = 8192, 256
# Tags that a copy takes along besides the image's layout.
COPIED = [
    254, 263, 269, 270, 271, 272, 280, 281, 282, 283, 285, 286, 287, 296, 297, 301, 305, 306, 315, 316, 318, 319, 321, 326, 327, 328, 332, 333, 334, 336, 337, 340, 341, 529, 531, 532, 34675, 34908, 34909, 34910, 37439,
]


@dataclass
class WriteOptions:
    """How an image is laid out and compressed. rows_per_strip 0 is about 8 KiB a strip."""

    compression: int = codecs.NONE
    predictor: int = 1
    rows_per_strip: int = 0
    tile_width: int = 0
    tile_length: int = 0
    planar: int = 1
    fill_order: int = 1
    order: str = "<"
    big: bool = False
    level: int = -1
    quality: int = 75
    group3_options: int = 0
    #: Strips, tiles and planes stay as they are in the source; chunks are copied one by one.
    keep_layout: bool = False

    @staticmethod
    def parse(text: str) -> WriteOptions:
        """From "none", "packbits", "lzw[:p]", "zip[:p]", "g3[:1d|2d][:fill]", "g4" or "jpeg[:r][:q]"."""
        name, *rest = text.lower().split(":")
        numbers = {"none": 1, "packbits": codecs.PACKBITS, "lzw": codecs.LZW, "zip": codecs.ADOBE_DEFLATE, "g3": codecs.CCITT_FAX3, "g4": codecs.CCITT_FAX4, "jpeg": codecs.JPEG}
        if name not in numbers:
            raise ValueError(f"unknown compression {text!r}")
        out = WriteOptions(compression=numbers[name])
        for part in rest:
            if name in ("lzw", "zip") and part.isdigit():
                out.predictor = int(part)
            elif name == "jpeg" and part.isdigit():
                out.quality = int(part)
            elif name == "g3" and part in ("1d", "2d", "fill"):
                out.group3_options |= {"1d": 0, "2d": 1, "fill": 4}[part]
            elif not (name == "jpeg" and part == "r"):
                raise ValueError(f"unknown option {part!r} of {name}")
        return out


@dataclass
class Page:
    """An image with what its directory says, and further tags (number, type, values or bytes)."""

    array: np.ndarray
    photometric: int = 1
    bits: int = 8
    sample_format: int = 1
    orientation: int = 1
    extra_samples: list[int] = field(default_factory=list)
    colormap: list[list[int]] = field(default_factory=list)
    subsampling: tuple[int, int] = (1, 1)
    resolution: tuple[float, float] | None = None
    tags: list[tuple[int, int, object]] = field(default_factory=list)
    #: Further directories by the tag that points to them, as Exif's 34665, each a list of tags.
    linked: dict[int, list[tuple[int, int, object]]] = field(default_factory=dict)


def directory_bytes(e: str, entries: dict[int, tuple[int, int, bytes]], at: int, big: bool) -> tuple[bytes, int]:
    """A directory that lies at `at`, with the values that don't fit in it behind it, and the place of its link to the next one."""
    inline, word = (8, "Q") if big else (4, "I")
    payload = at + (8 if big else 2) + (20 if big else 12) * len(entries) + inline
    table, tail = bytearray(struct.pack(e + ("Q" if big else "H"), len(entries))), bytearray()
    head, place = struct.Struct(e + ("HHQ" if big else "HHI")).pack, struct.Struct(e + word).pack
    for t in sorted(entries):
        kind, count, raw = entries[t]
        table += head(t, kind, count)
        if len(raw) <= inline:
            table += raw.ljust(inline, b"\0")
        else:
            table += place(payload + len(tail))
            tail += raw
            if len(raw) & 1:
                tail.append(0)
    return bytes(table + place(0) + tail), at + len(table)


def tag_bytes(order: str, kind: int, values) -> tuple[int, bytes]:
    """Count and payload of a tag's values; a text gets its NUL, once."""
    if type(values) is int and kind in _WHOLE:
        return 1, P.ONE[order, kind].pack(values)
    if kind == 2:
        raw = (values if isinstance(values, bytes) else str(values).encode("latin-1")).rstrip(b"\0") + b"\0"
        return len(raw), raw
    if kind == 7 or isinstance(values, bytes):
        return len(values) // TYPE_SIZE[kind], bytes(values)
    values = values if isinstance(values, (list, tuple, np.ndarray)) else (values,)
    n = len(values)
    if kind in (5, 10):
        pairs = [v if isinstance(v, (list, tuple)) else to_rational(float(v), kind == 10) for v in values]
        return n, struct.pack(order + ("I" if kind == 5 else "i") * 2 * n, *[int(x) for p in pairs for x in p])
    number = float if kind in (11, 12) else int
    if n == 1:
        return 1, struct.pack(order + _LETTERS[kind], number(values[0]))
    return n, struct.pack(f"{order}{n}{_LETTERS[kind]}", *map(number, values))


def to_rational(value: float, signed: bool = False) -> tuple[int, int]:
    """Scaled by 8 while it isn't whole and both parts stay below 2^28; a negative number without a sign is 0."""
    sign = -1 if value < 0 else 1
    if sign < 0 and not signed:
        return 0, 1
    value, den = abs(value), 1
    while value != int(value) and value < 1 << 25 and den < 1 << 25:
        value, den = value * 8, den * 8
    return sign * int(value + 0.5), den


def layout(page: Page, o: WriteOptions) -> tuple[image.Meta, list[tuple[int, int, int, int]]]:
    """What encoding needs, and the chunks' places (x, y, w, h)."""
    h, w, n = page.array.shape
    m = image.Meta(w, h, page.bits, n, page.sample_format, page.photometric, o.compression, o.planar if n > 1 else 1, o.predictor, o.fill_order, page.orientation, o.order, page.subsampling, page.extra_samples, group3_options=o.group3_options)
    if o.tile_width:
        if o.tile_width % 16 or o.tile_length % 16:
            raise ValueError("the sides of a tile are multiples of 16")
        return m, [(x, y, o.tile_width, o.tile_length) for y in range(0, h, o.tile_length) for x in range(0, w, o.tile_width)]
    row = max(1, -(-w * (1 if m.planar == 2 else n) * page.bits // 8))
    rows = o.rows_per_strip or max(1, STRIP_BYTES // row)
    unit = page.subsampling[1] if image.is_subsampled(m) else 1
    rows = -(-rows // unit) * unit
    return m, [(0, y, w, min(rows, h - y)) for y in range(0, h, rows)]


def encode_page(page: Page, o: WriteOptions, user: dict | None = None) -> tuple[image.Meta, list[bytes], int]:
    """The encoded chunks in file order and the rows of a strip (or 0 for tiles); tiles over the edge are filled with the last samples."""
    m, places = layout(page, o)
    planes: list[list[bytes]] = [[] for _ in range(page.array.shape[2] if m.planar == 2 else 1)]
    y_res = page.resolution[1] if page.resolution else 0.0
    for x, y, w, h in places:
        part = page.array[y : y + h, x : x + w]
        if o.tile_width:
            part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1]), (0, 0)), mode="edge")
        for plane, raw in zip(planes, image.encode_chunk(part, m, o.level, o.quality, y_res, user), strict=True):
            plane.append(raw)
    return m, [raw for plane in planes for raw in plane], 0 if o.tile_width else places[0][3]


def write_bytes(pages: list[Page], o: WriteOptions | None = None, user: dict | None = None) -> bytes:
    """A whole file. BigTIFF is chosen where offsets could pass 2^32. `user` holds codecs that go before the built-in ones."""
    o = o or WriteOptions()
    user = codecs.registered() if user is None else user
    return _write([(p, o, *encode_page(p, o, user)) for p in pages], o)


def _write(pages: list[tuple[Page, WriteOptions, image.Meta, list[bytes], int]], o: WriteOptions) -> bytes:
    """A file of pages with their encoded chunks and the rows of a strip; o has the container's form."""
    big = o.big or sum(len(raw) for _, _, _, chunks, _ in pages for raw in chunks) + 65536 * len(pages) >= 1 << 32
    e = o.order
    out = bytearray(struct.pack(e + "HHHQ", 43, 8, 0, 0) if big else struct.pack(e + "HI", 42, 0))
    out[:0] = b"II" if e == "<" else b"MM"
    link = 8 if big else 4
    word = "Q" if big else "I"
    for page, own, m, chunks, rows in pages:
        offsets = []
        for raw in chunks:
            out += b"\0" * (len(out) & 1)
            offsets.append(len(out))
            out += raw
        entries = {t: (k, *tag_bytes(e, k, v)) for t, k, v in _tags(page, own, m, offsets, [len(c) for c in chunks], rows, big)}
        for pointer, further in page.linked.items():
            out += b"\0" * (len(out) & 1)
            entries[pointer] = (16 if big else 4, *tag_bytes(e, 16 if big else 4, len(out)))
            out += directory_bytes(e, {t: (k, *tag_bytes(e, k, v)) for t, k, v in further}, len(out), big)[0]
        out += b"\0" * (len(out) & 1)
        at = len(out)
        struct.pack_into(e + word, out, link, at)
        body, link = directory_bytes(e, entries, at, big)
        out += body
    return bytes(out)


def _tags(page: Page, o: WriteOptions, m: image.Meta, offsets: list[int], sizes: list[int], rows: int, big: bool) -> Iterator[tuple[int, int, object]]:
    n = m.samples
    where = 16 if big else 4
    yield from [(256, 4, m.width), (257, 4, m.height), (258, 3, [m.bits] * n), (259, 3, o.compression), (262, 3, page.photometric), (274, 3, page.orientation), (277, 3, n), (284, 3, m.planar)]
    if rows:
        yield from [(273, where, offsets), (278, 4, rows), (279, where, sizes)]
    else:
        yield from [(322, 4, o.tile_width), (323, 4, o.tile_length), (324, where, offsets), (325, where, sizes)]
    if o.fill_order != 1:
        yield 266, 3, o.fill_order
    if o.predictor != 1 and o.compression in (codecs.LZW, codecs.DEFLATE, codecs.ADOBE_DEFLATE):
        yield 317, 3, o.predictor
    if page.sample_format != 1:
        yield 339, 3, [page.sample_format] * n
    if page.extra_samples:
        yield 338, 3, page.extra_samples
    if page.colormap:
        yield 320, 3, [v for c in page.colormap for v in c]
    if page.photometric == image.YCBCR:
        yield 530, 3, list(page.subsampling)
    if o.compression == codecs.CCITT_FAX3:
        yield 292, 4, o.group3_options
    if page.resolution:
        yield from [(282, 5, page.resolution[0]), (283, 5, page.resolution[1])]
    own = {256, 257, 258, 259, 262, 266, 273, 274, 277, 278, 279, 284, 292, 317, 320, 322, 323, 324, 325, 338, 339, 530} | ({282, 283} if page.resolution else set())
    yield from [t for t in page.tags if t[0] not in own]


def _value(t: P.Tag):
    return t.text if t.type == 2 else t.rationals if t.rationals else t.raw if t.type == 7 else t.nums


def _page(d: P.Directory, f: P.TiffFile, m: image.Meta, array: np.ndarray) -> Page:
    """A page with what a copy takes along of its directory."""
    tags = [(t.tag, t.type, _value(t)) for t in d.tags.values() if t.tag in COPIED]
    res = (d.get(282), d.get(283)) if d.get(282) is not None and d.get(283) is not None else None
    linked = {}
    for pointer, kind in P.LINKED.items():
        for child in f.directories:
            if kind != "sub" and child.kind == kind and child.offset in d.all(pointer):
                linked[pointer] = [(t.tag, t.type, _value(t)) for t in child.tags.values() if t.tag not in P.LINKED]
    return Page(array, m.photometric, m.bits, m.sample_format, m.orientation, m.extra_samples, m.colormap, m.subsampling, res, tags, linked)


@dataclass
class _AllBut:
    """All page numbers but one."""

    number: int

    def __contains__(self, i: int) -> bool:
        return i != self.number


def _chosen(f: P.TiffFile, numbers: list[int] | _AllBut | None) -> list[P.Directory]:
    return [d for i, d in enumerate(x for x in f.directories if x.kind == "main") if numbers is None or i in numbers]


def pages_of(data: bytes, numbers: list[int] | None = None, user: dict | None = None, ignore: bool = False) -> list[Page]:
    """The images of a file in memory, with the tags that a copy takes along. With `ignore`, chunks that can't be read are zeros."""
    from .tiff import arrays

    f = P.parse(data)
    out = []
    for d in _chosen(f, numbers):
        a, m = arrays(data, next(i for i, x in enumerate(f.directories) if x is d), user, ignore, f)
        page = _page(d, f, m, a)
        if m.photometric == image.YCBCR and m.compression in (codecs.JPEG, codecs.OLD_JPEG):
            page.array, page.photometric, page.subsampling = image.ycbcr_to_rgb(a, m.luma, m.black_white), image.RGB, (1, 1)
        out.append(page)
    return out


def rechunked(data: bytes, o: WriteOptions, numbers: list[int] | None = None, user: dict | None = None, ignore: bool = False) -> list[tuple]:
    """Pages for `_write` whose chunks keep their places. One chunk is decoded at a time, and none whose encoded bytes can be stored as they are."""
    from .tiff import meta_of

    f = P.parse(data)
    out = []
    for d in _chosen(f, numbers):
        g = P.geometry(d)
        if g is None:
            raise ValueError(str(d.errors))
        m = meta_of(d, g, f.order, data)
        predicted = (codecs.LZW, codecs.DEFLATE, codecs.ADOBE_DEFLATE)
        predictor = m.predictor if m.compression in predicted else 1
        wanted = o.predictor if o.compression in predicted else 1
        same = m.compression == o.compression and predictor == wanted and m.fill_order == o.fill_order and (m.order == o.order or m.bits <= 8 or m.compression == codecs.JPEG)
        if not same and (codecs.JPEG in (m.compression, o.compression) or m.compression == codecs.OLD_JPEG or image.is_subsampled(m)):
            raise ValueError("these chunks can't be encoded anew one by one")
        one = dataclasses.replace(m, samples=1, planar=1) if m.planar == 2 else m
        to = dataclasses.replace(one, compression=o.compression, predictor=wanted, fill_order=o.fill_order, order=o.order, group3_options=o.group3_options)
        y_res = float(d.get(283) or 0)
        chunks = []
        for c in P.chunks(d, g, len(data)):
            raw = data[c.offset : c.offset + c.size]
            if not same:
                try:
                    a = image.decode_chunk([raw], one, c.w, c.h, user)
                except (ValueError, IndexError):
                    if not ignore:
                        raise
                    a = np.zeros((c.h, c.w, one.samples), np.int64)
                raw = image.encode_chunk(a, to, o.level, o.quality, y_res, user)[0]
            chunks.append(raw)
        page = _page(d, f, m, np.zeros((0, 0, m.samples)))
        if same and m.jpeg_tables and m.compression == codecs.JPEG:
            page.tags.append((347, 7, m.jpeg_tables))
        own = dataclasses.replace(o, predictor=wanted, tile_width=g.tile_width if g.tiled else 0, tile_length=g.tile_length if g.tiled else 0, group3_options=m.group3_options if same else o.group3_options)
        out.append((page, own, dataclasses.replace(m, compression=o.compression), chunks, 0 if g.tiled else g.rows_per_strip))
    return out


def _encoded_pages(data: bytes, o: WriteOptions, numbers: list[int] | None, user: dict, ignore: bool, change=None) -> list[tuple]:
    """Pages for `_write`: chunk by chunk with keep_layout, where the codecs allow it, and else page by page."""
    if o.keep_layout and not change:
        try:
            return rechunked(data, o, numbers, user, ignore)
        except ValueError:
            pass
    pages = [change(p) if change else p for p in pages_of(data, numbers, user, ignore)]
    return [(p, o, *encode_page(p, o, user)) for p in pages]


def convert(contents: DataFrame, options: WriteOptions, pages: list[int] | None = None, change=None, ignore: bool = False) -> DataFrame:
    """path, content and error of the files (path, content) copied with another layout or compression, page by page.

    `change` takes a Page and gives another. With options.keep_layout and no change, chunks are copied one by one where their codecs allow it, so a page
    isn't in memory as a whole. Files are converted where they are read; there is no shuffle.
    """
    bound_batches(contents.sparkSession)
    user = codecs.registered()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows.append((path, _write(_encoded_pages(bytes(content), options, pages, user, ignore, change), options), None))
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((path, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "content", "error"])

    return contents.select("path", "content").mapInPandas(run, "path string, content binary, error string")


def unlink(contents: DataFrame, number: int, options: WriteOptions | None = None) -> DataFrame:
    """The files without one of their pages; the pages after it move up."""
    return convert(contents, options or WriteOptions(), _AllBut(number))


def assemble(pages: DataFrame, options: WriteOptions, renumber: bool = False) -> DataFrame:
    """path and content of files from (path, position, content), each content a file whose pages are joined in the order of position.

    `renumber` numbers all pages anew (PageNumber). One group is one output file, which must fit in memory as any file does.
    """
    bound_batches(pages.sparkSession)
    user = codecs.registered()

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("position")
        found = [p for content in frame["content"] for p in _encoded_pages(bytes(content), options, None, user, False)]
        if renumber:
            for i, (p, *_) in enumerate(found):
                p.tags = [t for t in p.tags if t[0] != 297] + [(297, 3, [i, len(found)])]
        return pd.DataFrame({"path": [frame["path"].iloc[0]], "content": [_write(found, options)]})

    return pages.select("path", "position", "content").repartition(task_number(pages.sparkSession), "path").groupBy("path").applyInPandas(build, "path string, content binary")


def from_samples(rows: DataFrame, options: WriteOptions, photometric: int = 1, bits: int = 8, sample_format: int = 1, **page) -> DataFrame:
    """path and content of files made of image rows (path, ifd, row, samples: an array for each pixel); `page` has further fields of each Page."""
    bound_batches(rows.sparkSession)
    user = codecs.registered()

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        pages = []
        for _, own in frame.sort_values(["ifd", "row"]).groupby("ifd"):
            a = np.array([np.stack(s) for s in own["samples"]])
            pages.append(Page(a, photometric, bits, sample_format, **page))
        return pd.DataFrame({"path": [frame["path"].iloc[0]], "content": [write_bytes(pages, options, user)]})

    return rows.select("path", "ifd", "row", "samples").groupBy("path").applyInPandas(build, "path string, content binary")


def from_records(rows: DataFrame, make, options: WriteOptions | None = None) -> DataFrame:
    """path and content of one file for each row: make(row as a dict, which has `path`) gives its Pages. Rows are dealt over tasks, as a file costs far more time than its row has bytes."""
    bound_batches(rows.sparkSession)
    options = options or WriteOptions()
    user = codecs.registered()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "content": [write_bytes(make(r), options, user) for r in frame.to_dict("records")]})

    return spread(rows).mapInPandas(run, "path string, content binary")


def save(contents: DataFrame, folder: str, suffix: str = "") -> DataFrame:
    """Writes each (path, content) under its base name into a folder; gives path and bytes. Rows must have different base names.

    The executors write, through a file system that pyarrow reaches (local or mounted, HDFS, S3, GCS). A task writes to
    a name of its own and then moves the file, so a task that runs twice leaves one whole file.
    """
    bound_batches(contents.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(base, recursive=True)
        for frame in frames:
            done = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                target = f"{base}/{path.rsplit('/', 1)[-1]}{suffix}"
                part = f"{base}/_{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as stream:
                    stream.write(bytes(content))
                system.move(part, target)
                done.append((target, len(content)))
            yield pd.DataFrame(done, columns=["path", "length"])

    return contents.where("content is not null").select("path", "content").mapInPandas(run, "path string, length long")
