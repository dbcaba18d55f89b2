import re
import zlib

import numpy as np
import pytest

from tessella.functions import codecs
from tessella.sources import pdf, sink

RNG = np.random.default_rng(2)


def objects(document):
    """Objects of a document by number, found through its cross-reference table."""
    start = int(re.search(rb"startxref\n(\d+)\n%%EOF\n$", document)[1])
    table = document[start:].split(b"\n")
    n = int(table[1].split()[1])
    out = {}
    for i in range(1, n):
        at = int(table[2 + i].split()[0])
        assert document[at:].startswith(b"%d 0 obj\n" % i)
        out[i] = document[at : document.index(b"\nendobj\n", at)]
    return out


def picture(document):
    body = next(o for o in objects(document).values() if b"/Subtype /Image" in o)
    head, data = body.split(b"\nstream\n", 1)
    size = int(re.search(rb"/Length (\d+)", head)[1])
    return head, data[:size]


def test_pages_and_info():
    a = RNG.integers(0, 256, (10, 20, 1))
    pages = [sink.Page(a, resolution=(144.0, 72.0), tags=[(297, 3, [1, 2]), (306, 2, "2020:01:02 03:04:05"), (269, 2, "a (b)\\")]), sink.Page(a, tags=[(297, 3, [0, 2])]), sink.Page(a, tags=[(254, 4, 1)])]
    document = pdf.write_pdf(sink.write_bytes(pages))
    found = objects(document)
    assert b"/Count 2" in found[2]
    boxes = [re.search(rb"/MediaBox \[0 0 ([\d.]+) ([\d.]+)\]", o).groups() for o in found.values() if b"/Type /Page " in o]
    assert boxes == [(b"20.0000", b"10.0000"), (b"10.0000", b"10.0000")]
    other = pdf.write_pdf(sink.write_bytes(pages[:1]), pdf.PdfOptions(paper="a4", fit=True, title="T"))
    assert b"/MediaBox [0 0 595.0000 842.0000]" in other
    assert b"/CreationDate (D:20200102030405)" in other
    assert b"/Title (T)" in other
    assert pdf.literal("a (b)\\\x01") == b"(a \\(b\\)\\\\\\001)"
    with pytest.raises(ValueError, match="paper"):
        pdf.write_pdf(sink.write_bytes(pages[:1]), pdf.PdfOptions(paper="none"))


def test_images():
    grey, rgb = RNG.integers(0, 256, (10, 20, 1)), RNG.integers(0, 256, (10, 20, 3))
    head, data = picture(pdf.write_pdf(sink.write_bytes([sink.Page(rgb, 2)], sink.WriteOptions(codecs.LZW))))
    assert b"/DeviceRGB" in head
    assert zlib.decompress(data) == rgb.astype(np.uint8).tobytes()
    one = sink.WriteOptions(codecs.ADOBE_DEFLATE, 2, rows_per_strip=10)
    raw = sink.write_bytes([sink.Page(grey)], one)
    head, data = picture(pdf.write_pdf(raw))
    assert b"/Predictor 2" in head
    assert data in raw
    bits = (RNG.random((10, 20, 1)) < 0.5).astype(int)
    for photometric in (0, 1):
        raw = sink.write_bytes([sink.Page(bits, photometric, 1)], sink.WriteOptions(codecs.CCITT_FAX4, rows_per_strip=10))
        head, data = picture(pdf.write_pdf(raw))
        assert (b"/BlackIs1 false" in head) == (photometric == 0)
        assert data in raw
        head, data = picture(pdf.write_pdf(raw, pdf.PdfOptions(passthrough=False)))
        assert codecs.decode(codecs.CCITT_FAX4, data, 30, codecs.Parameters(20, 10, 1, 1)) == np.packbits(bits[..., 0], axis=1).tobytes()
    head, _ = picture(pdf.write_pdf(sink.write_bytes([sink.Page(grey // 128, 3, 1, colormap=[[0, 9], [1, 8], [2, 7]])])))
    assert b"[/Indexed /DeviceRGB 1 <000102090807>]" in head
    half = np.dstack((rgb, np.full((10, 20), 0)))
    _, data = picture(pdf.write_pdf(sink.write_bytes([sink.Page(half, 2, extra_samples=[2])])))
    assert zlib.decompress(data) == b"\xff" * 600
    _, data = picture(pdf.write_pdf(sink.write_bytes([sink.Page(grey)]), pdf.PdfOptions("none")))
    assert data == grey.astype(np.uint8).tobytes()
    with pytest.raises(ValueError, match="16 bits"):
        pdf.write_pdf(sink.write_bytes([sink.Page(grey, 1, 16)]))


def test_each_page_is_looked_at_once(monkeypatch):
    data = sink.write_bytes([sink.Page(RNG.integers(0, 256, (2, 3, 1)), tags=[(297, 3, [i, 30])]) for i in range(30)])
    plain, seen = pdf.P.geometry, []
    monkeypatch.setattr(pdf.P, "geometry", lambda d: seen.append(d.ifd) or plain(d))
    monkeypatch.setattr(pdf.P.Directory, "__eq__", lambda *_: pytest.fail("directories are compared"))
    document = pdf.write_pdf(data)
    assert seen == list(range(30))
    assert b"/Count 30" in objects(document)[2]


def test_table(spark):
    a = RNG.integers(0, 256, (10, 20, 1))
    frame = spark.createDataFrame([("a.tif", sink.write_bytes([sink.Page(a)])), ("b.tif", b"x")], "path string, content binary")
    found = {r["path"]: r for r in pdf.to_pdf(frame).collect()}
    assert bytes(found["a.tif"]["content"]).startswith(b"%PDF")
    assert found["b.tif"]["error"]
