"""Round trips over arbitrary data."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.functions import codecs, image, predictors
from tessella.sources import parse, pdf, sink, tiff

SCHEMES = [codecs.PACKBITS, codecs.LZW, codecs.DEFLATE, codecs.NONE]


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from(SCHEMES), st.integers(1, 300), st.sampled_from([1, 2]))
def test_codecs(data, scheme, width, order):
    p = codecs.Parameters(width=width, fill_order=order)
    assert codecs.decode(scheme, codecs.encode(scheme, data, p), len(data), p) == data


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 200), st.integers(1, 8), st.sampled_from([codecs.CCITT_RLE, codecs.CCITT_RLEW, codecs.CCITT_FAX3, codecs.CCITT_FAX4]), st.sampled_from([0, 1, 4, 5]), st.randoms(use_true_random=False))
def test_fax(width, height, scheme, options, random):
    share = random.random()
    rows = np.array([[random.random() < share for _ in range(width)] for _ in range(height)], np.uint8)
    data = np.packbits(rows, axis=1).tobytes()
    p = codecs.Parameters(width=width, height=height, bits=1, group3_options=options)
    assert codecs.decode(scheme, codecs.encode(scheme, data, p), len(data), p) == data


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=0, max_size=400), st.sampled_from(SCHEMES + [codecs.CCITT_FAX3, codecs.CCITT_FAX4, codecs.JPEG]))
def test_decoders_survive_junk(data, scheme):
    p = codecs.Parameters(width=17, height=5, samples=1, bits=1 if scheme in (3, 4) else 8)
    try:
        assert len(codecs.decode(scheme, data, 85, p)) == 85
    except (codecs.CodecError, IndexError, ValueError):
        pass


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=300), st.sampled_from([b"II*\0", b"MM\0*", b"II+\0\x08\0\0\0"]))
def test_parser_survives_junk(data, head):
    f = parse.parse(head + data)
    for d in f.directories:
        g = parse.geometry(d)
        if g and g.per_plane * g.planes < 10_000:
            parse.chunks(d, g, len(data))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(1, 4), st.sampled_from([1, 2, 4, 7, 8, 12, 16, 32]), st.sampled_from(SCHEMES), st.sampled_from([1, 2]), st.sampled_from([0, 16, 32]), st.sampled_from("<>"), st.booleans(), st.randoms(use_true_random=False))
def test_files(h, w, n, bits, scheme, planar, tile, order, big, random):
    a = np.random.default_rng(random.randrange(1 << 30)).integers(0, 1 << bits, (h, w, n))
    predictor = 2 if scheme == codecs.LZW and bits in (8, 16, 32) else 1
    back, _ = tiff.arrays(sink.write_bytes([sink.Page(a, 1, bits)], sink.WriteOptions(scheme, predictor, random.randint(1, 50), tile, tile, planar, 1, order, big)))
    assert (back == a).all()


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([(8, 2, 1), (16, 2, 1), (32, 2, 1), (16, 3, 3), (32, 3, 3), (64, 3, 3)]), st.integers(1, 20), st.integers(1, 4), st.sampled_from("<>"), st.randoms(use_true_random=False))
def test_predictors(kind, width, stride, order, random):
    bits, predictor, fmt = kind
    data = random.randbytes(width * stride * bits // 8 * 3)
    assert predictors.decode(predictors.encode(data, predictor, width, stride, bits, order, fmt), predictor, width, stride, bits, order, fmt) == data


@settings(max_examples=100, deadline=None)
@given(st.floats(0, 1 << 24, allow_nan=False), st.text(max_size=20))
def test_rationals_and_strings(x, text):
    n, d = sink.to_rational(x)
    assert abs(n / d - x) <= 1 / d
    assert max(n, d) <= 1 << 28
    out = pdf.literal(text)
    assert out[:1] == b"(" and out[-1:] == b")" and all(32 <= c < 127 for c in out)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 255), st.integers(0, 255), st.integers(0, 255), st.sampled_from([2, 5, 6, 8]))
def test_colours_stay_in_range(x, y, z, photometric):
    a = np.array([x, y, z, 0][: 4 if photometric == 5 else 3]).reshape(1, 1, -1)
    out = image.to_rgba(a, image.Meta(1, 1, samples=a.shape[2], photometric=photometric))
    assert out.shape == (1, 1, 4)
    if photometric == 2:
        assert out[0, 0].tolist() == [x, y, z, 255]
