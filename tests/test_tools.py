import numpy as np
import pytest

from tessella import tools
from tessella.functions import codecs
from tessella.sources import parse, sink, tiff

RNG = np.random.default_rng(6)


@pytest.fixture
def files(tmp_path):
    pages = [sink.Page(RNG.integers(0, 256, (12, 20, 1)), tags=[(270, 2, f"page {i}")]) for i in range(3)]
    (tmp_path / "multi.tif").write_bytes(sink.write_bytes(pages))
    (tmp_path / "one.tif").write_bytes(sink.write_bytes(pages[1:2]))
    rgb = RNG.integers(0, 256, (12, 20, 4))
    (tmp_path / "rgba.tif").write_bytes(sink.write_bytes([sink.Page(rgb, 2, extra_samples=[2])]))
    return tmp_path, pages


def names(data):
    return [d.tags[270].text for d in parse.parse(data).directories]


def test_inputs():
    assert tools.parse_input("a.tif") == ("a.tif", None, None)
    assert tools.parse_input("a.tif,0,2") == ("a.tif", [0, 2], None)
    assert tools.parse_input("a.tif,1,") == ("a.tif", [], 1)
    assert tools.parse_input("a.tif=1", "=") == ("a.tif", [1], None)


@pytest.mark.parametrize(("pages", "want"), [(",0", [0]), (",0,2", [0, 2]), (",1,", [1, 2]), ("", [0, 1, 2])])
def test_page_selection(spark, files, pages, want):
    folder, _ = files
    made = tools.copy(spark, [f"{folder}/multi.tif{pages}"]).first()
    assert names(bytes(made["content"])) == [f"page {i}" for i in want]


def test_copy_command(spark, files):
    folder, pages = files
    out = folder / "out.tif"
    assert tools.main(["copy", "-c", "lzw:2", "-t", "-w", "16", "-l", "16", "-B", f"{folder}/multi.tif,2", f"{folder}/one.tif", str(out)]) == 0
    data = out.read_bytes()
    assert data[:2] == b"MM"
    assert names(data) == ["page 2", "page 1"]
    assert (tiff.arrays(data, 0)[0] == pages[2].array).all()
    assert tools.main(["copy", "-a", f"{folder}/multi.tif,0", str(out)]) == 0
    assert names(out.read_bytes()) == ["page 2", "page 1", "page 0"]


def test_bias_rotation_and_crop(spark, files):
    folder, pages = files
    made = tools.copy(spark, [f"{folder}/multi.tif,0"], bias=f"{folder}/one.tif").first()
    assert (tiff.arrays(bytes(made["content"]))[0] == (pages[0].array - pages[1].array) % 256).all()
    turned = tools.copy(spark, [f"{folder}/one.tif"], rotate=90, crop=(2, 3, 6, 7)).first()
    assert (tiff.arrays(bytes(turned["content"]))[0] == np.rot90(pages[1].array[2:8, 3:10], -1)).all()
    with pytest.raises(Exception, match="bias"):
        tools.copy(spark, [f"{folder}/rgba.tif"], bias=f"{folder}/one.tif").collect()


def test_rgba_and_pdf(spark, files):
    folder, pages = files
    made = {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in tools.to_rgba(spark, [f"{folder}/one.tif", f"{folder}/rgba.tif"]).collect()}
    a, m = tiff.arrays(made["one.tif"])
    assert m.compression == codecs.PACKBITS and a.shape == (12, 20, 4)
    assert (a[..., :3] == pages[1].array).all()
    assert tools.main(["rgba", "-n", "-c", "zip", f"{folder}/rgba.tif", f"{folder}/rgb"]) == 0
    assert tiff.arrays((folder / "rgb" / "rgba.tif").read_bytes())[0].shape == (12, 20, 3)
    assert tools.main(["pdf", "-p", "A4", "-t", "T", f"{folder}/multi.tif", f"{folder}/pdf"]) == 0
    assert (folder / "pdf" / "multi.tif.pdf").read_bytes().startswith(b"%PDF")
    (folder / "bad.tif").write_bytes(b"no")
    assert tools.main(["pdf", f"{folder}/bad.tif", f"{folder}/pdf"]) == 1
    assert tools.main(["info", f"{folder}/one.tif"]) == 0


def test_copy_options(spark, files):
    folder, pages = files
    out = folder / "kept.tif"
    (folder / "tiled.tif").write_bytes(sink.write_bytes(pages, sink.WriteOptions(codecs.LZW, tile_width=16, tile_length=16)))
    assert tools.main(["copy", "-c", "zip:2", "-x", f"{folder}/tiled.tif,1,", f"{folder}/one.tif", str(out)]) == 0
    found = parse.parse(out.read_bytes()).directories
    assert [d.all(297) for d in found] == [[0, 3], [1, 3], [2, 3]]
    assert [322 in d.tags for d in found] == [True, True, False]
    offset = parse.parse((folder / "multi.tif").read_bytes()).directories[1].offset
    assert tools.main(["copy", "-o", str(offset), f"{folder}/multi.tif", str(out)]) == 0
    assert names(out.read_bytes()) == ["page 1", "page 2"]
    assert tools.main(["copy", "-c", "lzw", f"{folder}/tiled.tif", str(out)]) == 0
    assert 322 in parse.parse(out.read_bytes()).directories[0].tags
    assert (tiff.arrays(out.read_bytes(), 2)[0] == pages[2].array).all()
    made = tools.copy(spark, [f"{folder}/multi.tif,0"], bias=f"{folder}/multi.tif,2").first()
    assert (tiff.arrays(bytes(made["content"]))[0] == (pages[0].array - pages[2].array) % 256).all()
    broken = bytearray(sink.write_bytes(pages[:1], sink.WriteOptions(codecs.ADOBE_DEFLATE, rows_per_strip=6)))
    broken[8:20] = bytes(12)
    (folder / "broken.tif").write_bytes(broken)
    assert tools.main(["copy", "-i", f"{folder}/broken.tif", str(out)]) == 0
    a = tiff.arrays(out.read_bytes())[0]
    assert (a[:6] == 0).all() and (a[6:] == pages[0].array[6:]).all()
    with pytest.raises(Exception, match="no directory"):
        tools.copy(spark, [f"{folder}/multi.tif"], offset=3)


def test_pdf_options(spark, files):
    folder, pages = files
    assert tools.main(["pdf", "-j", "-q", "90", "-w", "4", "-l", "3", "-x", "36", "-r", "o", "-f", "-o", f"{folder}/jpeg.pdf", f"{folder}/rgba.tif"]) == 0
    data = (folder / "jpeg.pdf").read_bytes()
    assert b"/DCTDecode" in data and b"/MediaBox [0 0 288.0000 216.0000]" in data and b"/FitWindow true" in data
    stream = data[data.index(b"\xff\xd8") : data.index(b"\xff\xd9") + 2]
    from tessella.functions import image, jpeg

    a = tiff.arrays((folder / "rgba.tif").read_bytes())[0].astype(int)
    want = np.minimum(255, (a[..., :3] * a[..., 3:] + 127) // 255 + 255 - a[..., 3:])
    back = image.ycbcr_to_rgb(jpeg.decode(stream), (0.299, 0.587, 0.114), [])
    assert np.abs(back - want).mean() < 12
    assert (np.abs(image.ycbcr_to_rgb(image.rgb_to_ycbcr(want), (0.299, 0.587, 0.114), []) - want) <= 2).all()
