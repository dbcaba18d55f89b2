import numpy as np
from pyspark.sql import functions as F

from tessella.functions import coerce, color
from tessella.operators import checks, geometry, pages, relayout, tags
from tessella.sources import sink, tiff

RNG = np.random.default_rng(8)


def test_checks(spark):
    one = spark.range(1)
    values = {
        "extra": checks.valid_extra_samples(F.array(F.lit(999)), F.lit(4)), "many": checks.valid_extra_samples(F.array(F.lit(1), F.lit(1)), F.lit(1)), "inks": checks.valid_ink_names(F.lit("a\0b\0"), F.lit(2)),
        "old": checks.is_old_jpeg(F.lit(7), F.array(F.lit(256), F.lit(513))), "few": checks.trimmed_count(F.array(F.lit(1)), F.lit(2)), "pseudo": checks.is_pseudo(F.lit(65537)), "tile": checks.field_error(F.lit(322), F.lit(24)),
        "regroup": coerce.regroup(F.lit(b"\1\2\3\4"), 2), "big": coerce.regroup(F.lit(b"\1\2\3\4"), 2, True), "odd": coerce.regroup(F.lit(b"\1"), 2), "cast": coerce.array_to(F.array(F.lit("1"), F.lit("x")), "int"),
    }
    row = one.select(*[v.alias(k) for k, v in values.items()]).first()
    assert row["extra"] == [2]
    assert row["many"] is None
    assert row["inks"] and row["old"] and row["pseudo"] and row["tile"]
    assert row["few"] is None and row["odd"] is None
    assert (row["regroup"], row["big"]) == ([0x0201, 0x0403], [0x0102, 0x0304])
    assert row["cast"] == [1, None]


def test_convertible_and_codecs(spark):
    files = [("a.tif", sink.write_bytes([sink.Page(RNG.integers(0, 256, (4, 4, 3)), 2)])), ("b.tif", sink.write_bytes([sink.Page(RNG.integers(0, 9, (4, 4, 1)), 1, 32)])), ("c.tif", sink.write_bytes([sink.Page(RNG.integers(0, 2, (4, 4, 1)), 3)]))]
    dirs = tiff.from_bytes(spark, files).dirs()
    found = {r["path"]: r["error"] for r in dirs.select("path", checks.rgba_error(dirs).alias("error")).collect()}
    assert found["a.tif"] is None
    assert "bits" in found["b.tif"] and "colour map" in found["c.tif"]
    table = checks.codec_table(spark)
    assert table.where("configured").count() == 11
    assert table.where("name = 'jbig' and not configured").count() == 1


def test_text(spark):
    row = spark.range(1).select(tags.ascii_text(F.lit(b"a\xe9\0b")).alias("a"), tags.printable(F.lit("a\tb")).alias("p"), tags.to_rational(F.lit(0.5)).alias("r"), tags.to_rational(F.lit(-1.0)).alias("n"), tags.to_rational(F.lit(3.0)).alias("w")).first()
    assert row["a"] == "aé"
    assert row["p"] == "a\\011b"
    assert [tuple(row[k]) for k in "rnw"] == [(4, 8), (0, 1), (3, 1)]


def test_curves_and_pages(spark):
    curve = color.transfer_curve(8)
    assert (curve[0], curve[255], len(curve)) == (0, 65535, 256)
    rows = [("a", 0, 1, 2, None), ("a", 1, 0, 2, None), ("a", 2, None, None, 1), ("a", 3, 9, 2, None)]
    found = pages.pdf_pages(spark.createDataFrame(rows, "path string, ifd int, page_number int, page_total int, subfile_type int"), ["path"])
    assert [r["ifd"] for r in found.orderBy("position").collect()] == [1, 0, 3]


def test_orientations(spark):
    a = np.arange(6).reshape(2, 3)
    samples = spark.createDataFrame([(y, x, int(a[y, x])) for y in range(2) for x in range(3)], "row long, col long, q long")
    want = {1: a, 2: a[:, ::-1], 3: a[::-1, ::-1], 4: a[::-1]}
    for o, b in want.items():
        found = relayout.orient(samples, o, F.lit(3), F.lit(2)).collect()
        assert all(b[r["row"], r["col"]] == r["q"] for r in found), o
    swapped = relayout.orient(samples, 5, F.lit(3), F.lit(2), swap=True).collect()
    assert all(a.T[r["row"], r["col"]] == r["q"] for r in swapped)
    big = spark.range(1).select(geometry.div(F.lit((1 << 62) + 1), F.lit(2)).alias("d")).first()["d"]
    assert big == 1 << 61
