import struct

import numpy as np
import pytest

from tessella.functions import codecs, image, jpeg
from tessella.sources import parse, sink, tiff

RNG = np.random.default_rng(4)


def smooth(h, w, n):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([(x * (i + 2) + y * (3 - i)) % 256 * 0.3 + 80 + 20 * np.sin(x / (5 + i)) for i in range(n)], -1).clip(0, 255).astype(np.uint8)


@pytest.mark.parametrize("n", [1, 3, 4])
@pytest.mark.parametrize("quality", [50, 95])
def test_round_trip(n, quality):
    for h, w in [(1, 1), (8, 8), (21, 37), (64, 40)]:
        a = smooth(h, w, n)
        back = jpeg.decode(jpeg.encode(a, quality))
        assert back.shape == a.shape
        assert np.abs(back.astype(int) - a).mean() < (12 if quality < 90 else 4)
    noise = RNG.integers(0, 256, (32, 32, n)).astype(np.uint8)
    assert np.abs(jpeg.decode(jpeg.encode(noise, 100)).astype(int) - noise).max() <= 3


def test_second_opinion(spark, tmp_path):
    """The JVM's JPEG reader sees the same grey pixels, and reads what is in a TIFF file."""
    grey = smooth(37, 50, 1)
    (tmp_path / "a.jpg").write_bytes(jpeg.encode(grey, 80))
    (tmp_path / "b.tif").write_bytes(sink.write_bytes([sink.Page(grey)], sink.WriteOptions(codecs.JPEG, rows_per_strip=16, quality=80)))
    found = {r.image.origin.rsplit("/", 1)[1]: r.image for r in spark.read.format("image").load(str(tmp_path)).collect()}
    for name, own in (("a.jpg", jpeg.decode(jpeg.encode(grey, 80))), ("b.tif", tiff.arrays((tmp_path / "b.tif").read_bytes())[0])):
        seen = np.frombuffer(found[name].data, np.uint8).reshape(37, 50, -1)[..., :1]
        assert np.abs(seen.astype(int) - own).max() <= 1


def test_subsampling_and_colour():
    a = smooth(33, 47, 3)
    y = image.Meta(47, 33, samples=3, photometric=6, compression=codecs.JPEG, subsampling=(2, 2))
    raws = image.encode_chunk(a, y, quality=95)
    back = image.decode_chunk(raws, y, 47, 33)
    assert np.abs(back[..., 0].astype(int) - a[..., 0]).mean() < 2
    data = sink.write_bytes([sink.Page(a, 6, subsampling=(2, 2))], sink.WriteOptions(codecs.JPEG, quality=95, rows_per_strip=16))
    pages = sink.pages_of(data)
    assert pages[0].photometric == image.RGB
    assert np.abs(pages[0].array - image.ycbcr_to_rgb(a, (0.299, 0.587, 0.114), [])).mean() < 8


def test_tables_apart_and_restarts():
    a = smooth(16, 16, 1)
    stream = jpeg.encode(a, 90)
    at, tables, rest = 2, b"", b""
    while stream[at + 1] != 0xDA:
        size = struct.unpack_from(">H", stream, at + 2)[0] + 2
        if stream[at + 1] in (0xDB, 0xC4):
            tables += stream[at : at + size]
        else:
            rest += stream[at : at + size]
        at += size
    apart = b"\xff\xd8" + rest + stream[at:]
    assert (jpeg.decode(apart, b"\xff\xd8" + tables + b"\xff\xd9") == jpeg.decode(stream)).all()
    with pytest.raises(codecs.CodecError):
        jpeg.decode(apart)
    with pytest.raises(codecs.CodecError):
        jpeg.decode(b"\xff\xd8\xff\xd9")


def test_code_lengths():
    lengths = jpeg.code_lengths({i: 2**i for i in range(30)})
    assert max(lengths.values()) <= 16
    assert sum(2.0**-k for k in lengths.values()) < 1
    assert jpeg.code_lengths({5: 3}) == {5: 1}
    _, codes = jpeg._table(lengths)
    words = [format(c, f"0{n}b") for c, n in codes.values()]
    assert not any(a != b and b.startswith(a) for a in words for b in words)
    assert all("0" in w for w in words)


def progressive(a, q):
    """A progressive stream: DC in two scans, AC in a first and a refining scan, written without a library."""
    blocks = (a[..., 0].astype(float) - 128).reshape(a.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    coefficients = np.rint(jpeg.forward(blocks) / q).astype(int).reshape(-1, 64)[:, jpeg.ZIGZAG]
    lengths = {s: 8 for s in [*range(12), *[r << 4 | n for r in range(16) for n in range(0, 11) if r << 4 | n > 11]]}
    lengths = {s: 8 if i < 200 else 12 for i, s in enumerate(lengths)}
    body, codes = jpeg._table(lengths)
    out = bytearray(b"\xff\xd8")

    def segment(mark, x):
        out.extend(struct.pack(">BBH", 255, mark, len(x) + 2) + x)

    def scan(start, end, high, low, bits):
        segment(0xDA, bytes((1, 1, 0, start, end, high << 4 | low)))
        s = "".join(bits)
        s += "1" * (-len(s) % 8)
        out.extend(bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\0"))

    code = lambda s: format(codes[s][0], f"0{codes[s][1]}b")

    def value(v):
        n = abs(v).bit_length()
        return format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    segment(0xDB, b"\0" + bytes([q] * 64))
    segment(0xC2, struct.pack(">BHHB", 8, a.shape[0], a.shape[1], 1) + b"\1\x11\0")
    segment(0xC4, b"\0" + body)
    segment(0xC4, b"\x10" + body)
    last, bits = 0, []
    for c in coefficients:
        d = (int(c[0]) >> 1) - last
        last = int(c[0]) >> 1
        bits += [code(abs(d).bit_length()), value(d)]
    scan(0, 0, 0, 1, bits)
    scan(0, 0, 1, 0, [str(int(c[0]) & 1) for c in coefficients])
    first, refine = [], []
    for c in coefficients:
        run = 0
        high = [int(np.sign(v)) * (abs(int(v)) >> 1) for v in c]
        for k in range(1, 64):
            if not high[k]:
                run += 1
                continue
            while run > 15:
                first.append(code(0xF0))
                run -= 16
            first += [code(run << 4 | abs(high[k]).bit_length()), value(high[k])]
            run = 0
        if run:
            first.append(code(0))
        # refinement: new coefficients of one, with correction bits of the old ones on the way
        run, pending = 0, []
        todo = []
        for k in range(1, 64):
            if high[k]:
                pending.append(str(abs(int(c[k])) & 1))
            elif abs(int(c[k])) == 1:
                todo += [code(run << 4 | 1), "1" if c[k] > 0 else "0", *pending]
                run, pending = 0, []
            else:
                if run == 15:
                    todo += [code(0xF0), *pending]
                    run, pending = 0, []
                else:
                    run += 1
        if run or pending:
            todo += [code(0), *pending]
        refine += todo
    scan(1, 63, 0, 1, first)
    scan(1, 63, 1, 0, refine)
    return bytes(out + b"\xff\xd9"), coefficients


def test_progressive():
    a = (smooth(24, 32, 1) // 2 + RNG.integers(0, 60, (24, 32, 1))).astype(np.uint8)
    data, want = progressive(a, 9)
    d = jpeg.Decoder()
    d.read(data)
    assert (np.array(d.components[0].blocks) == want).all()
    assert np.abs(d.samples().astype(int) - a).mean() < 4


def test_old_jpeg():
    a = smooth(16, 16, 1)
    data = sink.write_bytes([sink.Page(a)], sink.WriteOptions(codecs.JPEG))
    f = parse.parse(data)
    raw = bytearray(data)
    at = f.directories[0].offset + 2 + 12 * f.directories[0].tags[259].pos
    struct.pack_into("<H", raw, at + 8, codecs.OLD_JPEG)
    assert (tiff.arrays(bytes(raw))[0] == tiff.arrays(data)[0]).all()


def test_old_jpeg_with_tables_apart_and_whole_streams():
    a = smooth(16, 24, 1)
    stream = jpeg.encode(a, 90)
    at, quantisation, huffman = 2, b"", {}
    while stream[at + 1] != 0xDA:
        size = struct.unpack_from(">H", stream, at + 2)[0]
        body = stream[at + 4 : at + 2 + size]
        if stream[at + 1] == 0xDB:
            quantisation = body[1:]
        elif stream[at + 1] == 0xC4:
            huffman[body[0]] = body[1:]
        at += 2 + size
    scan = stream[at + 2 + struct.unpack_from(">H", stream, at + 2)[0] : -2]
    want = jpeg.decode(stream)
    for whole in (False, True):
        tags = [(513, 4, 0), (514, 4, len(stream))] if whole else [(519, 4, 0), (520, 4, 0), (521, 4, 0)]
        raw = bytearray(sink.write_bytes([sink.Page(a, tags=tags)], sink.WriteOptions(rows_per_strip=16)))
        d = parse.parse(bytes(raw)).directories[0]
        entry = lambda tag: d.offset + 2 + 12 * d.tags[tag].pos + 8
        struct.pack_into("<H", raw, entry(259), codecs.OLD_JPEG)
        for tag, block in ([(513, stream)] if whole else [(519, quantisation), (520, huffman[0]), (521, huffman[0x10]), (273, scan)]):
            struct.pack_into("<I", raw, entry(tag), len(raw))
            raw += block
        if not whole:
            struct.pack_into("<I", raw, entry(279), len(scan))
        assert (tiff.arrays(bytes(raw))[0] == want).all()


@pytest.mark.parametrize(("n", "sub"), [(1, (1, 1)), (3, (1, 1)), (3, (2, 2)), (3, (2, 1)), (4, (1, 1))])
def test_transcode(n, sub):
    rng = np.random.default_rng(n)
    a = np.cumsum(rng.integers(-9, 10, (37, 45, n)), axis=1).clip(-128, 127) + 128
    data = jpeg.encode(a, 60, sub)
    data = data[:2] + b"\xff\xfe\0\x07hello" + b"\xff\xe1\0\x04ab" + data[2:]
    assert jpeg.markers(data) == [(0xFE, b"hello"), (0xE1, b"ab")]
    again = jpeg.transcode(data)
    assert (jpeg.decode(again) == jpeg.decode(data)).all()
    assert jpeg.markers(again) == jpeg.markers(data)
    assert len(again) <= len(data)
