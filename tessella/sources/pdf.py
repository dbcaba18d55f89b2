"""Writes the images of TIFF files as PDF documents, one document for each file.

G4 data in one strip, Deflate data in one strip and JPEG data are taken over as they are; all else is decoded and written with Deflate, G4 (one bit, one sample) or
without compression.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import codecs, image, jpeg
from ..shipping import bound_batches
from . import parse as P
from .tiff import decoded_image, meta_of

# Paper sizes, widths and heights in points (72 to an inch).
PAPER_TEXT = """
LETTER 612 792
A4 595 842
LEGAL 612 1008
EXECUTIVE 522 756
LEDGER 792 1224
TABLOID 792 1224
A 612 792
B 792 1224
C 1224 1584
D 1584 2448
E 2448 3168
F 2016 2880
G 792 6480
H 2016 10296
J 2448 12672
K 2880 10296
A10 74 105
A9 105 147
A8 147 210
A7 210 298
A6 298 420
A5 420 595
A3 842 1191
A2 1191 1684
A1 1684 2384
A0 2384 3370
2A0 3370 4768
4A0 4768 6741
2A 3370 4768
4A 4768 6741
B10 88 125
B9 125 176
B8 176 249
B7 249 354
B6 354 499
B5 499 709
B4 709 1001
B3 1001 1417
B2 1417 2004
B1 2004 2835
B0 2835 4008
JISB10 91 128
JISB9 128 181
JISB8 181 258
JISB7 258 363
JISB6 363 516
JISB5 516 729
JISB4 729 1032
JISB3 1032 1460
JISB2 1460 2064
JISB1 2064 2920
JISB0 2920 4127
C10 79 113
C9 113 162
C8 162 230
C7 230 323
C6 323 459
C5 459 649
C4 649 918
C3 918 1298
C2 1298 1837
C1 1298 1837
C0 2599 3677
RA2 1219 1729
RA1 1729 2438
RA0 2438 3458
SRA4 638 907
SRA3 907 1276
SRA2 1276 1814
SRA1 1814 2551
SRA0 2551 3628
A3EXTRA 914 1262
A4EXTRA 667 914
STATEMENT 396 612
FOLIO 612 936
QUARTO 609 780
"""
PAPERS = {name: (int(w), int(h)) for name, w, h in map(str.split, PAPER_TEXT.strip().splitlines())}


@dataclass
class PdfOptions:
    """compression is "auto", "none", "zip", "jpeg" or "g4", quality that of JPEG.

    resolution is that of images without one, or with override of all. paper names a page size, page (width, length) gives one in the unit; an image is centred on it.
    fit asks the viewer to fit its window to the page.
    """

    compression: str = "auto"
    passthrough: bool = True
    resolution: tuple[float, float] | None = None
    unit: str = "inch"
    paper: str | None = None
    fit: bool = False
    override: bool = True
    page: tuple[float, float] | None = None
    quality: int = 75
    invert: bool = False
    interpolate: bool = False
    title: str | None = None
    author: str | None = None
    subject: str | None = None
    keywords: str | None = None
    creator: str | None = None
    created: str | None = None


def literal(text: str) -> bytes:
    """A PDF string: brackets and backslashes escaped, other odd characters as octal."""
    out = bytearray(b"(")
    for c in text.encode("latin-1", "replace"):
        if c in b"()\\":
            out += b"\\" + bytes((c,))
        elif 32 <= c < 127:
            out.append(c)
        else:
            out += b"\\%03o" % c
    return bytes(out + b")")


def pdf_date(text: str | None) -> str | None:
    """D:YYYYMMDDHHMMSS from YYYY:MM:DD HH:MM:SS."""
    found = re.match(r"(\d{4}):(\d\d):(\d\d) (\d\d):(\d\d):(\d\d)", text or "")
    return "D:" + "".join(found.groups()) if found else None


def page_order(f: P.TiffFile) -> list[P.Directory]:
    """Directories that are pages, by page number, then place in the file."""
    found = []
    for d in f.directories:
        if d.kind != "main":
            continue
        number = d.all(297)
        kind = int(d.get(254, 0))
        if len(number) == 2:
            found.append((number[1] if number[1] and number[0] > number[1] else number[0], d.ifd, d))
        elif kind & 2 or kind == 0:
            found.append((0, d.ifd, d))
    return [d for _, _, d in sorted(found, key=lambda x: x[:2])]


def check(m: image.Meta) -> None:
    if m.bits not in (1, 2, 4, 8):
        raise ValueError(f"images of {m.bits} bits aren't written as PDF")
    if m.samples > 4 or m.sample_format not in (1, 4):
        raise ValueError("a PDF takes up to 4 samples of whole numbers")


def _space(m: image.Meta) -> bytes:
    if m.photometric == image.PALETTE:
        table = np.array(m.colormap)
        if (table >= 256).any():
            table = table >> 8
        return b"[/Indexed /DeviceRGB %d <%s>]" % (table.shape[1] - 1, table.T.astype(np.uint8).tobytes().hex().encode())
    return {1: b"/DeviceGray", 3: b"/DeviceRGB", 4: b"/DeviceCMYK"}[1 if m.photometric in (0, 1) else 4 if m.photometric == image.SEPARATED else 3]


def _image(data: bytes, f: P.TiffFile, d: P.Directory, o: PdfOptions) -> tuple[dict[bytes, bytes], bytes]:
    """The image's dictionary and stream."""
    g = P.geometry(d)
    if g is None:
        raise ValueError(str(d.errors))
    m = meta_of(d, g, f.order, data)
    check(m)
    found = P.chunks(d, g, len(data))
    head = {b"Type": b"/XObject", b"Subtype": b"/Image", b"Width": b"%d" % m.width, b"Height": b"%d" % m.height}
    if o.interpolate:
        head[b"Interpolate"] = b"true"
    plain = not m.extra_samples and m.photometric in (0, 1, 2, 3, 5) and m.planar == 1
    white_is_zero = m.photometric == image.MINISWHITE
    if o.passthrough and plain and len(found) == 1 and not g.tiled and o.compression == "auto":
        raw = data[found[0].offset : found[0].offset + found[0].size]
        raw = codecs.reverse_bits(raw) if m.fill_order == 2 else raw
        head |= {b"BitsPerComponent": b"%d" % m.bits, b"ColorSpace": _space(m)}
        if m.compression == codecs.CCITT_FAX4 and m.bits == 1 and m.samples == 1:
            head |= {b"Filter": b"/CCITTFaxDecode", b"DecodeParms": b"<< /K -1 /Columns %d /Rows %d /BlackIs1 %s >>" % (m.width, m.height, b"false" if white_is_zero != o.invert else b"true")}
            return head, raw
        if m.compression in (codecs.DEFLATE, codecs.ADOBE_DEFLATE) and m.predictor in (1, 2) and m.order == ">" or m.compression in (codecs.DEFLATE, codecs.ADOBE_DEFLATE) and m.predictor in (1, 2) and m.bits <= 8:
            head[b"Filter"] = b"/FlateDecode"
            if m.predictor == 2:
                head[b"DecodeParms"] = b"<< /Predictor 2 /Colors %d /BitsPerComponent %d /Columns %d >>" % (m.samples, m.bits, m.width)
            if white_is_zero != o.invert:
                head[b"Decode"] = b"[1 0]"
            return head, raw
        if m.compression == codecs.JPEG and not m.jpeg_tables:
            return head | {b"Filter": b"/DCTDecode"}, raw
    a = decoded_image(data, g, m, found)
    if m.photometric in (image.YCBCR, image.CIELAB) or m.extra_samples:
        rgba = image.to_rgba(a, m).astype(int)
        if m.extra_samples:  # over white
            rgba[..., :3] = np.minimum(255, rgba[..., :3] + 255 - rgba[..., 3:4])
        grey = m.photometric in (0, 1)
        a, m.bits, m.photometric, white_is_zero = rgba[..., :1] if grey else rgba[..., :3], 8, 1 if grey else 2, False
        m.samples, m.extra_samples = a.shape[2], []
    bits = image.pack(a, m.bits)
    head |= {b"BitsPerComponent": b"%d" % m.bits, b"ColorSpace": _space(m)}
    if white_is_zero != o.invert:
        head[b"Decode"] = b"[1 0]"
    method = o.compression
    if method == "auto":
        method = "g4" if m.bits == 1 and a.shape[2] == 1 and m.photometric in (0, 1) else "zip"
    if method == "g4":
        if m.bits != 1 or a.shape[2] != 1:
            raise ValueError("G4 takes one sample of one bit")
        head |= {b"Filter": b"/CCITTFaxDecode", b"DecodeParms": b"<< /K -1 /Columns %d /Rows %d /BlackIs1 true >>" % (m.width, m.height)}
        return head, codecs.encode(codecs.CCITT_FAX4, bits, codecs.Parameters(m.width, m.height, 1, 1))
    if method == "jpeg":
        if m.bits != 8 or m.photometric == image.PALETTE:
            raise ValueError("JPEG takes samples of 8 bits that aren't numbers of a palette")
        rgb = a.shape[2] == 3 and m.photometric == image.RGB
        return head | {b"Filter": b"/DCTDecode"}, jpeg.encode(image.rgb_to_ycbcr(a) if rgb else a, o.quality, chroma=rgb)
    if method == "zip":
        return head | {b"Filter": b"/FlateDecode"}, zlib.compress(bits)
    return head, bits


def _size(d: P.Directory, o: PdfOptions) -> tuple[float, float]:
    """The image's width and height in points."""
    given = o.resolution if o.override or not (d.get(282) or d.get(283)) else None
    unit = 72 / 2.54 if (o.unit == "cm" if given else d.get(296, 2) == 3) else 72
    x, y = given or (d.get(282) or 72.0, d.get(283) or d.get(282) or 72.0)
    return d.get(256) * unit / (x or 72.0), d.get(257) * unit / (y or 72.0)


def _turn(orientation: int, w: float, h: float) -> tuple[bytes, float, float]:
    """The matrix that puts the unit square upright on the page, and the page's size."""
    if orientation >= 5:
        w, h = h, w
    if orientation == 1:
        return b"%.4f 0.0000 0.0000 %.4f 0.0000 0.0000" % (w, h), w, h
    a = {2: (-w, 0, 0, h, w, 0), 3: (-w, 0, 0, -h, w, h), 4: (w, 0, 0, -h, 0, h), 5: (0, -h, -w, 0, w, h), 6: (0, -h, w, 0, 0, h), 7: (0, h, w, 0, 0, 0), 8: (0, h, -w, 0, w, 0)}[orientation]
    return b" ".join(b"%.4f" % v for v in a), w, h


def write_pdf(data: bytes, o: PdfOptions | None = None) -> bytes:
    """A document with a page for each page of a TIFF file."""
    o = o or PdfOptions()
    f = P.parse(data)
    if f.errors and not f.directories:
        raise ValueError(f.errors[0][1])
    pages = page_order(f)
    objects: list[bytes] = []

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    def dictionary(entries: dict[bytes, bytes]) -> bytes:
        return b"<< " + b" ".join(b"/" + k + b" " + v for k, v in entries.items()) + b" >>"

    def stream(entries: dict[bytes, bytes], body: bytes) -> bytes:
        return dictionary(entries | {b"Length": b"%d" % len(body)}) + b"\nstream\n" + body + b"\nendstream"

    catalog, tree = add(b""), add(b"")
    kids = []
    for d in pages:
        head, body = _image(data, f, d, o)
        picture = add(stream(head, body))
        orientation = int(d.get(274, 1))
        matrix, w, h = _turn(orientation if 1 <= orientation <= 8 else 1, *_size(d, o))
        place = b""
        if o.paper or o.page:
            if o.paper and o.paper.upper() not in PAPERS:
                raise ValueError(f"unknown paper size {o.paper}")
            points = 72 / 2.54 if o.unit == "cm" else 72
            pw, ph = PAPERS[o.paper.upper()] if o.paper else (o.page[0] * points, o.page[1] * points)
            place = b"1 0 0 1 %.4f %.4f cm " % ((pw - w) / 2, (ph - h) / 2)
            w, h = pw, ph
        content = add(stream({}, b"q " + place + matrix + b" cm /Im0 Do Q"))
        kids.append(add(dictionary({b"Type": b"/Page", b"Parent": b"%d 0 R" % tree, b"MediaBox": b"[0 0 %.4f %.4f]" % (w, h), b"Contents": b"%d 0 R" % content, b"Resources": b"<< /XObject << /Im0 %d 0 R >> /ProcSet [/PDF /ImageB /ImageC /ImageI] >>" % picture})))
    objects[catalog - 1] = dictionary({b"Type": b"/Catalog", b"Pages": b"%d 0 R" % tree} | ({b"ViewerPreferences": b"<< /FitWindow true >>"} if o.fit else {}))
    objects[tree - 1] = dictionary({b"Type": b"/Pages", b"Kids": b"[" + b" ".join(b"%d 0 R" % k for k in kids) + b"]", b"Count": b"%d" % len(kids)})
    first = pages[0] if pages else None
    said = lambda tag: first.tags[tag].text if first and tag in first.tags else None
    info = {"CreationDate": o.created or pdf_date(said(306)) or datetime.now().strftime("D:%Y%m%d%H%M%S"), "Creator": o.creator or said(305), "Author": o.author or said(315), "Title": o.title or said(269), "Subject": o.subject or said(270), "Keywords": o.keywords}
    about = add(dictionary({k.encode(): literal(v) for k, v in info.items() if v}))
    out = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n")
    offsets = []
    for i, body in enumerate(objects, 1):
        offsets.append(len(out))
        out += b"%d 0 obj\n" % i + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % x for x in offsets)
    out += b"trailer\n" + dictionary({b"Size": b"%d" % (len(objects) + 1), b"Root": b"%d 0 R" % catalog, b"Info": b"%d 0 R" % about}) + b"\nstartxref\n%d\n%%%%EOF\n" % start
    return bytes(out)


def to_pdf(contents: DataFrame, options: PdfOptions | None = None) -> DataFrame:
    """path, content (the document) and error of TIFF files (path, content), where they are read."""
    options = options or PdfOptions()
    bound_batches(contents.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows.append((path, write_pdf(bytes(content), options), None))
                except (ValueError, IndexError, KeyError) as e:
                    rows.append((path, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "content", "error"])

    return contents.select("path", "content").mapInPandas(run, "path string, content binary, error string")
