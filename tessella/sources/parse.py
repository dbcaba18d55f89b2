"""Parses TIFF and BigTIFF files from bytes: header, directories, tags and chunks. Faults become errors of a directory, not exceptions."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from .registry import TYPE_SIZE, tag_name

#: Tag numbers of offsets to other directories, and what those hold.
LINKED = {330: "sub", 34665: "exif", 34853: "gps", 40965: "interop"}
_FORMATS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
ONE = {(order, kind): struct.Struct(order + form) for order in "<>" for kind, form in _FORMATS.items()}
#: What reads one number from the start of some bytes, by byte order and type.
_FIRST = {order: {kind: ONE[order, kind].unpack_from for kind in _FORMATS} for order in "<>"}


@dataclass(slots=True)
class Tag:
    tag: int
    type: int
    count: int
    raw: bytes
    nums: list
    text: str | None = None
    rationals: list = field(default_factory=list)
    pos: int = 0
    name: str = ""


@dataclass
class Directory:
    ifd: int
    kind: str
    offset: int
    next: int = 0
    tags: dict[int, Tag] = field(default_factory=dict)
    errors: list[tuple[str, str]] = field(default_factory=list)

    def get(self, tag: int, default=None):
        t = self.tags.get(tag)
        return t.nums[0] if t and t.nums else default

    def all(self, tag: int) -> list:
        t = self.tags.get(tag)
        return t.nums if t else []

    def same(self, tag: int, default):
        """A value that all samples share."""
        values = self.all(tag)
        if len(set(values)) > 1:
            self.errors.append(("per_sample", f"{tag_name(tag)} differs between samples"))
        return values[0] if values else default


@dataclass
class TiffFile:
    order: str = ""
    version: int = 0
    first: int = 0
    directories: list[Directory] = field(default_factory=list)
    errors: list[tuple[str, str]] = field(default_factory=list)

    @property
    def big(self) -> bool:
        return self.version == 43


def _at(form: str, data, place: int) -> tuple:
    """Numbers at a place of bytes, or of a file that gives slices."""
    return struct.unpack(form, data[place : place + struct.calcsize(form)])


def parse_header(data: bytes) -> TiffFile:
    out = TiffFile()
    mark = data[:2]
    if mark not in (b"II", b"MM", b"EP"):
        out.errors.append(("header", "not a TIFF file"))
        return out
    out.order = ">" if mark == b"MM" else "<"
    if len(data) < 8:
        out.errors.append(("header", "the header is cut off"))
        return out
    out.version = _at(out.order + "H", data, 2)[0]
    if out.version == 43:
        if len(data) < 16 or _at(out.order + "HH", data, 4) != (8, 0):
            out.errors.append(("header", "a bad BigTIFF header"))
            return out
        out.first = _at(out.order + "Q", data, 8)[0]
    elif out.version == 42:
        out.first = _at(out.order + "I", data, 4)[0]
    else:
        out.errors.append(("header", f"unknown version {out.version}"))
    return out


def _values(order: str, kind: int, raw: bytes) -> tuple[list, str | None, list]:
    if kind == 2:
        return [], raw.split(b"\0", 1)[0].decode("latin-1"), []
    if kind == 7:
        return [], None, []
    if kind in (5, 10):
        n = struct.unpack(order + ("I" if kind == 5 else "i") * (len(raw) // 4), raw[: len(raw) // 8 * 8])
        pairs = list(zip(n[0::2], n[1::2], strict=True))
        return [_single(a / b) if b else 1.0 for a, b in pairs], None, pairs
    one = ONE[order, kind]
    return [one.unpack(raw)[0]] if len(raw) == one.size else list(struct.unpack(f"{order}{len(raw) // one.size}{_FORMATS[kind]}", raw)), None, []


def _single(x: float) -> float:
    return struct.unpack("f", struct.pack("f", x))[0]


def parse_directory(data: bytes, f: TiffFile, offset: int, number: int, kind: str, extra: dict[int, str] | None = None, names: dict[int, str] | None = None, only: set[int] | None = None) -> Directory:
    """A directory; `names` are those of a caller's own schema, which go before all others. With `only`, the values of other tags aren't read."""
    out = Directory(number, kind, offset)
    count_form, entry_form, inline = ("Q", "HHQ8s", 8) if f.big else ("H", "HHI4s", 4)
    head = struct.calcsize("=" + count_form)
    if offset + head > len(data) or offset < 8:
        out.errors.append(("offset", f"directory offset {offset} is out of the file"))
        return out
    n = _at(f.order + count_form, data, offset)[0]
    size = 20 if f.big else 12
    at, end = offset + head, len(data)
    if at + n * size > end:
        out.errors.append(("count", f"{n} entries don't fit in the file"))
        n = max(0, (end - at) // size)
    last, own, names, first = -1, kind if kind == "exif" else "image", names or {}, _FIRST[f.order]
    for pos, (tag, type_, count, inner) in enumerate(struct.iter_unpack(f.order + entry_form, data[at : at + n * size])):
        if tag < last:
            out.errors.append(("order", f"tag {tag} isn't in order"))
        else:
            last = tag
        if type_ not in TYPE_SIZE:
            out.errors.append(("type", f"tag {tag} has unknown type {type_}"))
            continue
        length = count * TYPE_SIZE[type_]
        if count == 1 and length <= inline and type_ in first and tag not in out.tags and (only is None or tag in only):
            out.tags[tag] = Tag(tag, type_, 1, inner[:length], [first[type_](inner)[0]], None, [], pos, names.get(tag) or tag_name(tag, own, extra))
            continue
        if length <= inline:
            raw = inner[:length]
        else:
            place = struct.unpack(f.order + ("Q" if f.big else "I"), inner)[0]
            if place + length > end:
                out.errors.append(("value", f"the value of tag {tag} is out of the file"))
                continue
            raw = None
        if tag in out.tags:
            out.errors.append(("repeated", f"tag {tag} occurs again"))
            continue
        if only is not None and tag not in only:
            continue
        if raw is None:
            raw = data[place : place + length]
        out.tags[tag] = Tag(tag, type_, count, raw, *_values(f.order, type_, raw), pos, names.get(tag) or tag_name(tag, own, extra))
    at += n * size
    if at + (8 if f.big else 4) <= len(data):
        out.next = _at(f.order + ("Q" if f.big else "I"), data, at)[0]
    return out


def parse(data: bytes, extra: dict[int, str] | None = None, header_only: bool = False, own: dict[int, tuple[str, dict[int, str]]] | None = None, only: set[int] | None = None) -> TiffFile:
    """All directories along the chain, then those that they link to; a loop ends the chain with an error.

    `own` has a caller's directories: by the tag that points to them, their kind and the names of their tags. data may be a file that gives slices.
    `only` has the tags whose values are read, besides those that point to directories.
    """
    f = parse_header(data)
    if f.errors or header_only:
        return f
    links = LINKED | {t: k for t, (k, _) in (own or {}).items()}
    only = None if only is None else only | set(links)
    seen, offset, number = set(), f.first, 0
    while offset:
        if offset in seen:
            f.errors.append(("loop", f"the directory at {offset} occurs again"))
            break
        seen.add(offset)
        d = parse_directory(data, f, offset, number, "main", extra, None, only)
        f.directories.append(d)
        if any(code == "offset" for code, _ in d.errors):
            break
        offset, number = d.next, number + 1
    pending = list(f.directories)
    while pending:
        d = pending.pop(0)
        for tag, kind in links.items():
            for child in d.all(tag):
                child = int(child)
                if child and child not in seen:
                    seen.add(child)
                    linked = parse_directory(data, f, child, number, kind, extra, (own or {}).get(tag, (kind, None))[1], only)
                    f.directories.append(linked)
                    number += 1
                    if kind != "sub":  # a directory within a sub-directory isn't followed
                        pending.append(linked)
    return f


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


@dataclass
class Geometry:
    """What a directory says of its image."""

    width: int
    height: int
    depth: int
    bits: int
    samples: int
    sample_format: int
    photometric: int
    compression: int
    planar: int
    predictor: int
    fill_order: int
    orientation: int
    rows_per_strip: int
    tile_width: int
    tile_length: int
    tile_depth: int
    tiled: bool
    subsampling: tuple[int, int]
    planes: int = 1
    per_plane: int = 0

    @property
    def chunk_samples(self) -> int:
        return 1 if self.planar == 2 else self.samples

    def subsampled(self) -> bool:
        return self.photometric == 6 and self.planar == 1 and self.subsampling != (1, 1) and self.compression not in (6, 7)

    def chunk_bytes(self, w: int, h: int, d: int = 1) -> int:
        """Decoded bytes of a chunk."""
        if self.subsampled():
            hs, vs = self.subsampling
            return ceil_div(w, hs) * ceil_div(h, vs) * (hs * vs + 2) * d
        return ceil_div(w * self.chunk_samples * self.bits, 8) * h * d


def geometry(d: Directory) -> Geometry | None:
    width, height = d.get(256), d.get(257)
    if not width or not height:
        d.errors.append(("missing", "ImageWidth or ImageLength is missing"))
        return None
    compression = d.get(259, 1)
    if compression == 7 and any(t in d.tags for t in (512, 513, 514, 515, 519, 520, 521)):
        compression = 6
    samples = d.get(277, 1)
    photometric = d.get(262)
    if photometric is None:
        d.errors.append(("missing", "PhotometricInterpretation is missing"))
        photometric = 0 if compression in (2, 3, 4, 32771) else 2 if samples >= 3 else 1
    bits = d.same(258, 8 if compression == 6 else 1)
    if samples < 1 or bits < 1:
        d.errors.append(("value", "SamplesPerPixel and BitsPerSample must be positive"))
        return None
    tiled = 322 in d.tags and 323 in d.tags
    rows = d.get(278, 0xFFFFFFFF) or 0xFFFFFFFF
    sub = d.all(530)
    g = Geometry(
        int(width), int(height), int(d.get(32997, 1) or 1), int(bits), int(samples), int(d.same(339, 1)), int(photometric), int(compression), int(d.get(284, 1)), int(d.get(317, 1)),
        int(d.get(266, 1)), int(d.get(274, 1)), min(int(rows), int(height)), int(d.get(322, 0)), int(d.get(323, 0)), int(d.get(32998, 1) or 1), tiled, (int(sub[0]), int(sub[1])) if len(sub) >= 2 else (2, 2),
    )
    if tiled and (g.tile_width < 1 or g.tile_length < 1):
        d.errors.append(("value", "a tile has no size"))
        return None
    g.planes = g.samples if g.planar == 2 else 1
    g.per_plane = ceil_div(g.width, g.tile_width) * ceil_div(g.height, g.tile_length) * ceil_div(g.depth, g.tile_depth) if tiled else ceil_div(g.height, g.rows_per_strip) * g.depth
    return g


def old_jpeg_tables(d: Directory, data: bytes) -> bytes:
    """The tables that an old-style directory points to, one for each component, as a stream of tables."""
    out = bytearray(b"\xff\xd8")

    def segment(mark: int, body: bytes) -> None:
        out.extend(struct.pack(">BBH", 255, mark, len(body) + 2) + body)

    for tag, mark, kind in ((519, 0xDB, 0), (520, 0xC4, 0), (521, 0xC4, 0x10)):
        for i, at in enumerate(int(x) for x in d.all(tag)):
            size = 64 if mark == 0xDB else 16 + sum(data[at : at + 16])
            segment(mark, bytes((kind | i,)) + data[at : at + size])
    if d.get(515):
        segment(0xDD, struct.pack(">H", int(d.get(515))))
    return bytes(out + b"\xff\xd9") if len(out) > 2 else b""


@dataclass
class Chunk:
    number: int
    plane: int
    x: int
    y: int
    z: int
    w: int
    h: int
    offset: int
    size: int


def chunks(d: Directory, g: Geometry, file_size: int, chop: int = 0) -> list[Chunk]:
    """The chunks with their places in image and file; missing or impossible byte counts are estimated.

    `chop` cuts a raw image of one strip into strips of about so many bytes.
    """
    offsets = [int(x) for x in d.all(324 if g.tiled else 273) or d.all(273 if g.tiled else 324)]
    counts = [int(x) for x in d.all(325 if g.tiled else 279) or d.all(279 if g.tiled else 325)]
    n = g.per_plane * g.planes
    whole = d.get(513)
    if g.compression == 6 and whole and whole < file_size:
        # an old-style directory that points to one stream of the whole image
        size = int(d.get(514, 0)) or file_size - int(whole)
        g.per_plane = g.planes = 1
        return [Chunk(0, 0, 0, 0, 0, g.width, g.height, int(whole), min(size, file_size - int(whole)))]
    if not offsets:
        d.errors.append(("missing", "the chunks' offsets are missing"))
        return []
    if len(offsets) < n:
        d.errors.append(("count", f"{len(offsets)} offsets for {n} chunks"))
    out = []
    across, down = (ceil_div(g.width, g.tile_width), ceil_div(g.height, g.tile_length)) if g.tiled else (1, ceil_div(g.height, g.rows_per_strip))
    repaired = False
    following = sorted(set(offsets))
    for i, offset in enumerate(offsets[:n]):
        plane, k = divmod(i, g.per_plane)
        x, y, z = k % across, k // across % down, k // (across * down)
        if g.tiled:
            x, y, z, w, h, depth = x * g.tile_width, y * g.tile_length, z * g.tile_depth, g.tile_width, g.tile_length, g.tile_depth
        else:
            x, y, w, depth = 0, y * g.rows_per_strip, g.width, 1
            h = min(g.rows_per_strip, g.height - y)
        size = counts[i] if i < len(counts) else 0
        wanted = g.chunk_bytes(w, h, depth)
        bad = size > file_size - offset or (size == 0 and offset != 0) or (g.compression == 1 and n == 1 and size < wanted)
        if bad and offset < file_size:
            repaired = True
            later = [o for o in following if o > offset]
            size = min(wanted, file_size - offset) if g.compression == 1 else (later[0] if later else file_size) - offset
        if offset >= file_size and offset:
            d.errors.append(("offset", f"chunk {i} is out of the file"))
        out.append(Chunk(i, plane, x, y, z, w, h, offset, max(0, size)))
    if repaired:
        d.errors.append(("bytecount", "byte counts were estimated"))
    if chop and len(out) == 1 and not g.tiled and g.compression == 1 and g.predictor == 1 and not g.subsampled():
        row = g.chunk_bytes(g.width, 1)
        rows = max(1, chop // row)
        first = out[0]
        out = [Chunk(i, 0, 0, y, 0, g.width, min(rows, g.height - y), first.offset + y * row, min(rows, g.height - y) * row) for i, y in enumerate(range(0, g.height, rows))]
    return out
