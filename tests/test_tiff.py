"""Native reading, decoding, conversion and writing of TIFF files; the JVM's own TIFF reader is a second opinion."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import codecs, image, predictors
from tessella.sources import datasource, parse, pdf, registry, sink, tiff
from tessella.streaming import ingest

RNG = np.random.default_rng(0)


def samples(bits, fmt, h=20, w=37, n=1):
    if fmt == 3:
        return RNG.normal(size=(h, w, n)).astype("f8" if bits == 64 else "f4")
    return RNG.integers(0, 1 << min(bits, 62), (h, w, n)) - (1 << (bits - 1) if fmt == 2 else 0)


@pytest.mark.parametrize("scheme", [codecs.NONE, codecs.PACKBITS, codecs.LZW, codecs.DEFLATE])
def test_byte_codecs(scheme):
    p = codecs.Parameters(width=97)
    for n in [0, 1, 2, 127, 128, 129, 5000, 70000]:
        for k in (1, 2, 256):
            data = RNG.integers(0, k, n).astype(np.uint8).tobytes()
            assert codecs.decode(scheme, codecs.encode(scheme, data, p), n, p) == data


@pytest.mark.parametrize("scheme", [codecs.CCITT_RLE, codecs.CCITT_RLEW, codecs.CCITT_FAX3, codecs.CCITT_FAX4])
@pytest.mark.parametrize("options", [0, 1, 4, 5])
def test_fax_codecs(scheme, options):
    for width in (1, 7, 8, 64, 3000):
        for share in (0, 0.03, 0.5, 1):
            bits = (RNG.random((6, width)) < share).astype(np.uint8)
            bits[3] = bits[2]
            data = np.packbits(bits, axis=1).tobytes()
            p = codecs.Parameters(width=width, height=6, bits=1, group3_options=options)
            assert codecs.decode(scheme, codecs.encode(scheme, data, p), len(data), p) == data


def test_fax_codes_are_prefix_free():
    for codes in codecs._RUNS:
        everything = [*codes, codecs.EOL]
        assert not [1 for a in everything for b in everything if a != b and b.startswith(a)]


def test_known_streams():
    assert codecs.packbits_decode(bytes([254, 170, 2, 128, 0, 42, 253, 170, 3, 128, 0, 42, 34, 247, 170]), 24)[:3] == b"\xaa" * 3
    assert codecs.packbits_encode_row(b"\xaa" * 3 + b"\x80\x00\x2a") == bytes([254, 170, 2, 128, 0, 42])
    assert codecs.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]))[:2] == bytes([128, 1])
    assert codecs.reverse_bits(b"\x01\x80\x0f") == b"\x80\x01\xf0"
    damaged = codecs.deflate_encode(bytes(5000))[:-6]
    assert len(codecs.deflate_decode(damaged, 5000)) == 5000
    with pytest.raises(codecs.CodecError):
        codecs.decode(codecs.JBIG, b"", 1, codecs.Parameters())


@pytest.mark.parametrize("order", "<>")
def test_predictors(order):
    for bits, predictor, fmt in [(8, 2, 1), (16, 2, 1), (32, 2, 1), (16, 3, 3), (24, 3, 3), (32, 3, 3), (64, 3, 3)]:
        for stride in (1, 3):
            data = RNG.integers(0, 256, 7 * 5 * stride * bits // 8, dtype=np.uint8).tobytes()
            coded = predictors.encode(data, predictor, 7, stride, bits, order, fmt)
            assert predictors.decode(coded, predictor, 7, stride, bits, order, fmt) == data
    with pytest.raises(ValueError, match="horizontal"):
        predictors.check(2, 4, 1)


@pytest.mark.parametrize(("bits", "fmt"), [(1, 1), (3, 1), (4, 1), (8, 1), (15, 1), (16, 1), (16, 2), (24, 1), (32, 1), (32, 3), (64, 3)])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("planar", [1, 2])
def test_files_round_trip(bits, fmt, tile, planar):
    for i, (scheme, predictor) in enumerate([(1, 1), (codecs.PACKBITS, 1), (codecs.LZW, 2 if bits in (8, 16, 32) else 1), (codecs.ADOBE_DEFLATE, 3 if fmt == 3 else 1)]):
        a = samples(bits, fmt, n=3)
        o = sink.WriteOptions(scheme, predictor, rows_per_strip=7, tile_width=tile, tile_length=tile, planar=planar, order="<>"[i % 2], big=i > 1, fill_order=1 + i % 2)
        back, m = tiff.arrays(sink.write_bytes([sink.Page(a, 2, bits, fmt)], o))
        assert (back == a).all()
        assert (m.planar, m.compression) == (planar, scheme)


@pytest.mark.parametrize("sub", [(1, 1), (2, 1), (1, 2), (2, 2), (4, 1), (4, 2), (4, 4)])
def test_chroma_layouts(sub):
    a = np.repeat(np.repeat(RNG.integers(0, 256, (5, 6, 3)), sub[1], 0), sub[0], 1)
    a[..., 0] = RNG.integers(0, 256, a.shape[:2])
    back, _ = tiff.arrays(sink.write_bytes([sink.Page(a, 6, 8, subsampling=sub)]))
    assert (back == a).all()


def test_second_opinion(spark, tmp_path):
    """The JVM's reader, through Spark's image source, sees the same pixels."""
    want = {}
    grey, rgb = samples(8, 1), samples(8, 1, n=3)
    for scheme in (codecs.NONE, codecs.PACKBITS, codecs.LZW, codecs.ADOBE_DEFLATE):
        for predictor in (1, 2) if scheme in (codecs.LZW, codecs.ADOBE_DEFLATE) else (1,):
            for name, a, photometric in (("grey", grey, 1), ("rgb", rgb, 2)):
                for tile in (0, 16):
                    data = sink.write_bytes([sink.Page(a, photometric)], sink.WriteOptions(scheme, predictor, tile_width=tile, tile_length=tile, rows_per_strip=9))
                    file = f"{name}-{scheme}-{predictor}-{tile}.tif"
                    (tmp_path / file).write_bytes(data)
                    want[file] = a
    bits = (RNG.random((20, 37, 1)) < 0.4).astype(int)
    for scheme in (codecs.CCITT_RLE, codecs.CCITT_FAX3, codecs.CCITT_FAX4):
        (tmp_path / f"fax-{scheme}.tif").write_bytes(sink.write_bytes([sink.Page(bits, 0, 1)], sink.WriteOptions(scheme)))
        want[f"fax-{scheme}.tif"] = (1 - bits) * 255
    found = {r.image.origin.rsplit("/", 1)[1]: r.image for r in spark.read.format("image").load(str(tmp_path)).collect()}
    for file, a in want.items():
        seen = np.frombuffer(found[file].data, np.uint8).reshape(found[file].height, found[file].width, found[file].nChannels)
        assert (seen == (a[:, :, ::-1] if a.shape[2] == 3 else a)).all(), file


def test_tables(spark, tmp_path):
    pages = [sink.Page(samples(8, 1, n=3), 2, resolution=(72.0, 36.5), tags=[(269, 2, "name"), (65000, 7, b"\1\2\3\4\5\6"), (65001, 12, [1.5, 2.5])]), sink.Page(samples(1, 1), 0, 1)]
    for name, big in (("a.tif", False), ("b.tiff", True)):
        (tmp_path / name).write_bytes(sink.write_bytes(pages, sink.WriteOptions(codecs.LZW, tile_width=16, tile_length=16, big=big)))
    (tmp_path / "c.tif").write_bytes(b"no")
    t = tiff.read_tiff(spark, str(tmp_path))
    files = {r["path"].rsplit("/", 1)[1]: r for r in t.files().collect()}
    assert (files["a.tif"]["version"], files["b.tiff"]["is_big"], files["c.tif"]["errors"][0]["code"]) == (42, True, "header")
    dirs = t.dirs().where("path like '%a.tif'").orderBy("ifd").collect()
    assert [(d["width"], d["height"], d["bits_per_sample"], d["is_tiled"], d["n_chunks"]) for d in dirs] == [(37, 20, 8, True, 6), (37, 20, 1, True, 6)]
    tags = {r["tag"]: r for r in t.tags().where("path like '%a.tif' and ifd = 0").collect()}
    assert tags[269]["str"] == "name"
    assert tags[65001]["nums"] == [1.5, 2.5]
    assert tags[65000]["name"] == "Tag 65000"
    assert bytes(tags[65000]["raw"]) == b"\1\2\3\4\5\6"
    assert (tags[282]["rationals"][0]["num"], tags[283]["nums"][0]) == (72, 36.5)
    assert t.chunks().count() == 24
    cut = t.prune(rows=(16, 17), columns=(0, 3), pages=[0])
    assert cut.chunks().count() == 2
    pixels = {(r["row"], r["col"]): r["samples"] for r in cut.pixels().where("path like '%a.tif'").collect()}
    assert pixels == {(y, x): pages[0].array[y, x].tolist() for y in (16, 17) for x in range(4)}
    text = t.report().where("path like '%a.tif' and ifd = 0").first()["report"]
    assert "  ImageWidth: 37\r\n" in text
    defaults = {r["tag"]: r["value"] for r in t.with_defaults([274, 296, 254]).where("path like '%a.tif' and ifd = 1").collect()}
    assert defaults == {274: 1.0, 296: 2.0, 254: 0.0}
    assert t.corrupt().where("path like '%c.tif'").count() == 1
    with pytest.raises(Exception, match="not a TIFF"):
        tiff.read_tiff(spark, str(tmp_path), fail_fast=True).dirs().collect()
    assert tiff.read_tiff(spark, str(tmp_path), header_only=True).files().count() == 3


def word(order, kind, *values):
    return struct.pack(order + kind, *values)


def test_faults():
    good = sink.write_bytes([sink.Page(samples(8, 1)), sink.Page(samples(8, 1))])
    f = parse.parse(good)
    loop = bytearray(good)
    second = f.directories[1]
    end = second.offset + 2 + 12 * len(second.tags)
    struct.pack_into("<I", loop, end, f.first)
    assert parse.parse(bytes(loop)).errors[0][0] == "loop"
    zero = bytearray(good)
    d = f.directories[0]
    entry = d.offset + 2 + 12 * d.tags[279].pos
    struct.pack_into("<I", zero, entry + 8, 0) if d.tags[279].count == 1 else None
    back, _ = tiff.arrays(bytes(zero))
    assert back.shape == (20, 37, 1)
    bad = bytearray(good)
    struct.pack_into("<H", bad, d.offset + 2 + 12 * d.tags[262].pos + 2, 99)
    assert ("type", "tag 262 has unknown type 99") in parse.parse(bytes(bad)).directories[0].errors
    cut = parse.parse(good[: second.offset + 20])
    assert any(code == "count" for code, _ in cut.directories[1].errors)
    assert parse.parse(b"").errors and parse.parse(b"II*\0").errors
    chopped = parse.chunks(d, parse.geometry(d), len(good), chop=100)
    assert [c.h for c in chopped][:3] == [2, 2, 2]


def test_custom_codec_and_tags(spark):
    codecs.register_codec(60000, lambda d, n, p: bytes(255 - x for x in d), lambda d, p: bytes(255 - x for x in d))
    registry.register_tags([(65100, "Mine", "SHORT", 2)])
    try:
        assert codecs.is_configured(60000)
        a = samples(8, 1)
        data = sink.write_bytes([sink.Page(a, tags=[(65100, 3, [4, 5])])], sink.WriteOptions(60000))
        t = tiff.from_bytes(spark, [("x.tif", data)])
        assert t.tags().where("name = 'Mine'").first()["nums"] == [4.0, 5.0]
        assert t.corrupt().count() == 0
        got = {(r["row"], r["col"]): r["samples"][0] for r in t.pixels().collect()}
        assert got == {(y, x): a[y, x, 0] for y in range(20) for x in range(37)}
    finally:
        codecs.unregister_codec(60000)
    assert not codecs.is_configured(60000)


def rgba(a, **meta):
    a = np.array(a).reshape(1, 1, -1)
    return image.to_rgba(a, image.Meta(1, 1, samples=a.shape[2], **meta))[0, 0].tolist()


def test_colours():
    assert rgba([1], bits=1, photometric=0) == [0, 0, 0, 255]
    assert rgba([5], bits=4, photometric=1) == [85, 85, 85, 255]
    assert rgba([0x1234], bits=16, photometric=1) == [0x12, 0x12, 0x12, 255]
    assert rgba([0x1234], bits=16, photometric=0) == [237, 237, 237, 255]
    assert rgba([1], bits=1, photometric=3, colormap=[[0, 0x1200], [0, 0x3400], [0, 0xFF00]]) == [0x12, 0x34, 0xFF, 255]
    assert rgba([1], bits=1, photometric=3, colormap=[[0, 12], [0, 34], [0, 56]]) == [12, 34, 56, 255]
    assert rgba([10, 20, 30, 128], photometric=2, extra_samples=[2]) == [5, 10, 15, 128]
    assert rgba([10, 20, 30, 128], photometric=2, extra_samples=[1]) == [10, 20, 30, 128]
    assert rgba([10, 20, 30, 128], photometric=2, extra_samples=[0]) == [10, 20, 30, 128]
    assert rgba([10, 20, 30, 128], photometric=2) == [10, 20, 30, 255]
    assert rgba([0, 255, 128, 55], photometric=5) == [200, 0, 99, 255]
    assert rgba([128, 128, 128], photometric=6) == [128, 128, 128, 255]
    assert rgba([76, 85, 255], photometric=6)[0] > 250
    r, g, b, _ = rgba([255, 0, 0], photometric=8)  # the D50 white is yellowish on the display
    assert r == 255 and 255 > g > b > 200
    assert image.to_rgba(np.full((1, 1, 2), 9), image.Meta(1, 1, samples=2, extra_samples=[1]), compat=True)[0, 0].tolist() == [0, 0, 0, 9]
    assert image.rgba_problem(image.Meta(bits=32)) and image.rgba_problem(image.Meta(photometric=3))


def test_rgba_table(spark):
    a = samples(8, 1, n=3)
    t = tiff.from_bytes(spark, [("x.tif", sink.write_bytes([sink.Page(a, 2, orientation=3)], sink.WriteOptions(tile_width=16, tile_length=16)))])
    out = np.zeros((20, 37), np.int64)
    for r in t.rgba(orient=True).collect():
        out[r["row"], r["x0"] : r["x0"] + len(r["rgba"])] = r["rgba"]
    want = image.pack_words(np.dstack((a, np.full((20, 37), 255))).astype(np.uint8))
    assert (out == want[::-1, ::-1]).all()


def test_convert_select_and_join(spark, tmp_path):
    pages = [sink.Page(samples(8, 1, n=3), 2, tags=[(270, 2, f"page {i}")]) for i in range(3)]
    frame = spark.createDataFrame([("dir/a.tif", sink.write_bytes(pages)), ("dir/b.tif", sink.write_bytes(pages[:1])), ("dir/c.tif", b"junk")], "path string, content binary")
    made = sink.convert(frame, sink.WriteOptions.parse("zip:2"), pages=[0, 2])
    by_name = {r["path"]: r for r in made.collect()}
    back = sink.pages_of(bytes(by_name["dir/a.tif"]["content"]))
    assert [dict((t, v) for t, _, v in p.tags)[270] for p in back] == ["page 0", "page 2"]
    assert (back[1].array == pages[2].array).all()
    turned = sink.convert(frame.where("path like '%b.tif'"), sink.WriteOptions(planar=2, tile_width=16, tile_length=16), change=lambda p: sink.Page(np.rot90(p.array, -1), p.photometric)).first()
    again, m = tiff.arrays(bytes(turned["content"]))
    assert m.planar == 2 and (again == np.rot90(pages[0].array, -1)).all()
    joined = sink.assemble(frame.where("path not like '%c.tif'").selectExpr("'all.tif' as path", "path as position", "content"), sink.WriteOptions.parse("lzw")).first()
    assert len(parse.parse(bytes(joined["content"])).directories) == 4
    saved = sink.save(made, str(tmp_path / "out")).collect()
    assert {r["path"].rsplit("/", 1)[1] for r in saved} == {"a.tif", "b.tif"} | ({"c.tif"} if by_name["dir/c.tif"]["content"] is not None else set())
    assert tiff.read_tiff(spark, str(tmp_path / "out"), glob="[ab].tif").dirs().count() == 3
    t = tiff.from_bytes(spark, [("p.tif", sink.write_bytes(pages[:1]))])
    rebuilt = sink.from_samples(t.rows(), sink.WriteOptions(), 2).first()
    assert (tiff.arrays(bytes(rebuilt["content"]))[0] == pages[0].array).all()
    for text in ("none", "g3:2d:fill", "jpeg:r:50", "packbits", "g4"):
        sink.WriteOptions.parse(text)
    with pytest.raises(ValueError, match="unknown"):
        sink.WriteOptions.parse("rar")


def test_data_source_and_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.tif").write_bytes(sink.write_bytes([sink.Page(samples(8, 1))] * (i + 1)))
    datasource.register(spark)
    read = lambda table: spark.read.format("tiff").option("table", table).load(str(folder))
    assert read("dirs").count() == 6
    assert read("files").where("version = 42").count() == 3
    assert read("tags").where("name = 'ImageWidth'").count() == 6
    assert read("chunks").agg({"bytecount": "sum"}).first()[0] == 6 * 740
    t = ingest.read_stream(spark, str(folder))
    for expected in (6, 7):
        ingest.write_available(t.dirs(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == expected
        (folder / "9.tif").write_bytes(sink.write_bytes([sink.Page(samples(8, 1))]))
    query = ingest.pages_by_arrival(spark, str(folder)).writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("arrivals").agg({"files": "sum"}).first()[0] == 4
    stream = spark.readStream.format("tiff").option("table", "dirs").load(str(folder))
    query = stream.writeStream.format("memory").queryName("arrived").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("arrived").count() == 7


def test_registry(spark):
    table = registry.registry(spark)
    assert table.where("kind = 'exif'").select("tag").distinct().count() == 56
    assert table.where("name = 'ImageWidth'").count() == 2
    assert registry.tag_name(36867, "exif") == "DateTimeOriginal"


def test_linked_directories(spark):
    exif = [(33434, 5, [(1, 250)]), (36864, 7, b"0230"), (37510, 7, bytes(range(100)))]
    for big in (False, True):
        data = sink.write_bytes([sink.Page(samples(8, 1), linked={34665: exif})] * 2, sink.WriteOptions(big=big))
        copied = sink.write_bytes(sink.pages_of(data), sink.WriteOptions(order=">"))
        for own in (data, copied):
            t = tiff.from_bytes(spark, [("x.tif", own)])
            assert t.tags().where("kind = 'exif'").count() == 6
            tags = {r["name"]: r for r in t.tags().where("kind = 'exif'").collect()}
            assert abs(tags["ExposureTime"]["nums"][0] - 1 / 250) < 1e-9
            assert bytes(tags["UserComment"]["raw"]) == bytes(range(100))
            assert not parse.parse(own).errors and all(not d.errors for d in parse.parse(own).directories)


def test_defaults_and_unlinking(spark):
    data = sink.write_bytes([sink.Page(samples(4, 1), 1, 4), sink.Page(samples(8, 1), 0)])
    found = {(r["ifd"], r["tag"]): (r["values"], r["is_set"]) for r in tiff.from_bytes(spark, [("x.tif", data)]).values([258, 281, 336, 529, 296, 254]).collect()}
    assert found[0, 258] == ([4.0], True)
    assert found[0, 281] == ([15.0], False)
    assert found[1, 336] == ([0.0, 255.0], False)
    assert found[0, 529] == ([0.299, 0.587, 0.114], False)
    frame = spark.createDataFrame([("x.tif", data)], "path string, content binary")
    left = parse.parse(bytes(sink.unlink(frame, 0).first()["content"]))
    assert [d.get(262) for d in left.directories] == [0]


def test_rationals():
    assert sink.to_rational(0.5) == (4, 8)
    assert sink.to_rational(-1.0) == (0, 1)
    assert sink.to_rational(-0.5, signed=True) == (-4, 8)
    assert sink.tag_bytes("<", 2, "ab\0\0") == (3, b"ab\0")


def test_ranged_reads(tmp_path):
    from pyarrow import fs

    from tessella.sources import ranged

    pages = [sink.Page(samples(8, 1, 600, 700), tags=[(270, 2, f"page {i}")]) for i in range(3)]
    data = sink.write_bytes(pages, sink.WriteOptions(rows_per_strip=100))
    (tmp_path / "a.tif").write_bytes(data)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "a.tif")) as file:
        found = ranged.RangedFile(file, file.size())
        assert [d.tags for d in parse.parse(found).directories] == [d.tags for d in parse.parse(data).directories]
        assert found.read < len(data) // 2
        for a, b in ((0, 4), (65530, 65540), (100, 300000), (len(data) - 3, len(data) + 9), (5, 5)):
            assert found[a:b] == data[a:b]
    rows = list(datasource.rows_of("a.tif", data, "rows"))
    assert len(rows) == 1800
    assert rows[700]["samples"] == [[float(v)] for v in pages[1].array[100, :, 0]]


def test_late_files(tmp_path):
    import os

    reader = datasource._StreamReader(datasource.StructType(), {"path": str(tmp_path), "late_seconds": "1000"})
    put = lambda name, time: ((tmp_path / name).write_bytes(b"II"), os.utime(tmp_path / name, (time, time)))
    names = lambda parts: sorted(n.rsplit("/", 1)[1] for p in parts for n in p.names)
    put("m.tif", 5000)
    put("old.tif", 10)
    offsets = [reader.initialOffset(), reader.latestOffset()]
    assert names(reader.partitions(*offsets)) == ["m.tif", "old.tif"]
    put("a.tif", 5000)  # a smaller name at the same time
    put("b.tif", 4500)  # an older time
    offsets.append(reader.latestOffset())
    assert names(reader.partitions(*offsets[1:])) == ["a.tif", "b.tif"]
    put("c.tif", 9000)
    offsets.append(reader.latestOffset())
    assert names(reader.partitions(*offsets[2:])) == ["c.tif"]
    assert names(reader.partitions(offsets[-1], reader.latestOffset())) == []
    assert names(reader.partitions(*offsets[1:3])) == ["a.tif", "b.tif"]  # a batch again


def test_own_directories(spark):
    linked = {65200: [(1, 3, [7]), (2, 2, "mine")]}
    data = sink.write_bytes([sink.Page(samples(8, 1), linked=linked)], sink.WriteOptions(order=">"))
    t = tiff.from_bytes(spark, [("x.tif", data)], directories={65200: ("lens", {1: "Focus", 2: "Maker"})})
    found = {r["name"]: r for r in t.tags().where("kind = 'lens'").collect()}
    assert (found["Focus"]["nums"], found["Maker"]["str"]) == ([7.0], "mine")
    assert tiff.from_bytes(spark, [("x.tif", data)]).tags().where("kind = 'lens'").count() == 0
    text = t.report().where("ifd = 0").first()["report"]
    assert "  Compression: none\r\n" in text and "  PhotometricInterpretation: black is zero\r\n" in text


def test_tag_hooks(spark):
    import dataclasses

    def hook(tag, context):
        return None if tag.tag == 305 else dataclasses.replace(tag, text=context + tag.text) if tag.tag == 270 else tag

    data = sink.write_bytes([sink.Page(samples(8, 1), tags=[(270, 2, "x"), (305, 2, "y")])])
    found = {r["tag"]: r["str"] for r in tiff.from_bytes(spark, [("x.tif", data)], hook=hook, context="my ").tags().collect()}
    assert found[270] == "my x"
    assert 305 not in found


def _parts(spark, n):
    """A table of one partition, as a small file is read."""
    return spark.range(n).coalesce(1).select(F.col("id").cast("string").alias("path"))


def _named():
    """Gives the function that makes a record's pages; one of this module wouldn't be found by the workers."""

    def make(r):
        tags = [(270, 2, f"file {r['path']}"), (297, 3, [int(r["path"]), 9]), (65001, 3, [7])]
        return [sink.Page(np.zeros((2, 3, 1)), tags=tags, linked={34665: [(33434, 5, [(1, 4)])]})]

    return make


def test_records_are_dealt_over_tasks(spark):
    """Files of one partition's rows, and of few bytes behind a shuffle by path, are made by many tasks."""
    for rows in (_parts(spark, 64), _parts(spark, 64).groupBy("path").agg(F.max("path").alias("other"))):
        made = sink.from_records(rows, _named()).select("path", F.spark_partition_id().alias("task")).collect()
        assert sorted(int(r["path"]) for r in made) == list(range(64))
        assert len({r["task"] for r in made}) > spark.sparkContext.defaultParallelism
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_joined_files_are_dealt_over_tasks(spark):
    pages = sink.from_records(_parts(spark, 64), _named()).select("path", F.lit(0).alias("position"), "content")
    assert len({r[0] for r in sink.assemble(pages, sink.WriteOptions()).select(F.spark_partition_id()).collect()}) > 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tags_of_a_file_need_no_shuffle(spark):
    files = sink.from_records(_parts(spark, 5), _named())
    at_rest = tiff.from_bytes(spark, [(r["path"], bytes(r["content"])) for r in files.collect()])
    for found in (at_rest.gathered([270, 33434], ("nums", "str")), at_rest.report(), at_rest.corrupt(), sink.unlink(at_rest.contents, 0)):
        assert "Exchange" not in _plan(found) and _plan(found).count("MapIn") == 1
    for r in at_rest.gathered([270, 33434], ("nums", "str")).collect():
        assert [(t["ifd"], t["kind"], t["tag"], t["nums"], t["str"]) for t in r["tags"]] == [(0, "main", 270, None, f"file {r['path']}"), (1, "exif", 33434, [0.25], None)]


def test_only_wanted_tags_are_read(spark):
    data = sink.write_bytes(_named()({"path": "3"}))
    f, some = parse.parse(data), parse.parse(data, only={270})
    assert [list(d.tags) for d in some.directories] == [[270, 34665], []]
    assert some.directories[0].tags[270] == f.directories[0].tags[270] and some.directories[0].next == f.directories[0].next
    t = tiff.from_bytes(spark, [("3", data)])
    assert t.tags([297, 33434], ("nums",)).collect() == t.tags().where("tag in (297, 33434)").select("path", "ifd", "kind", "pos", "tag", "nums").collect()


def test_a_file_is_parsed_once_for_all_its_pages(monkeypatch):
    """Copies and documents of a file of many pages don't parse it again for each page."""
    data, calls, whole = sink.write_bytes([sink.Page(np.full((2, 2, 1), i)) for i in range(9)]), [], parse.parse
    monkeypatch.setattr(parse, "parse", lambda *a, **k: calls.append(1) or whole(*a, **k))
    assert [int(p.array[0, 0, 0]) for p in sink.pages_of(data)] == list(range(9)) and len(calls) == 1
    assert pdf.write_pdf(data).count(b"/MediaBox") == 9 and len(calls) == 2
    assert [int(p.array[0, 0, 0]) for p in sink.pages_of(data, sink._AllBut(4))] == [0, 1, 2, 3, 5, 6, 7, 8]
