import numpy as np
from pyspark.sql import functions as F

from tessella.sources import generate, sink, tiff


def test_generated_images(spark):
    made = generate.samples(spark, "g.tif", 7, 5, [F.col("x") * 10 + F.col("y"), F.lit(3), F.col("y")])
    built = sink.from_samples(made, sink.WriteOptions(), 2).first()
    a, _ = tiff.arrays(bytes(built["content"]))
    y, x = np.mgrid[0:5, 0:7]
    assert (a == np.dstack((x * 10 + y, np.full((5, 7), 3), y))).all()


def test_pages():
    g = generate.gradient(16, 2, 16)
    assert g.array[0, 0, 0] == 0 and g.array[1, 15, 0] == 65535
    assert generate.to_8_bits(g).array[0, 15, 0] == 255
    assert generate.multiplied(g, 16).array.max() < 65536
    for page in (g, generate.ramp_palette(4, 300), generate.stripes(20, 3)):
        back, _ = tiff.arrays(sink.write_bytes([page]))
        assert (back == page.array).all()
    assert generate.bitonal(generate.gradient(256, 1)).array[0, [166, 167], 0].tolist() == [0, 1]
    assert generate.to_bitmap(generate.ramp_palette(1, 2)) == bytes([0, 255, 0, 0, 2, 254, 1, 0])
    assert len(generate.to_bitmap(generate.gradient(3, 2), 4)) == 24
