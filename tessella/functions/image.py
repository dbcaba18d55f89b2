"""Decoded chunks as arrays: unpacking of samples, chroma, and conversion of every photometric interpretation to 8-bit RGBA."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from . import codecs, jpeg, predictors  # jpeg adds its codecs

# Fixed values of the format: photometric interpretations and kinds of extra samples.
MINISWHITE, MINISBLACK, RGB, PALETTE, MASK, SEPARATED, YCBCR, CIELAB = 0, 1, 2, 3, 4, 5, 6, 8
UNSPECIFIED, ASSOCIATED_ALPHA, UNASSOCIATED_ALPHA = 0, 1, 2
UINT, INT, FLOAT = 1, 2, 3


@dataclass
class Meta:
    """What decoding and colour conversion need of a directory."""

    width: int = 0
    height: int = 0
    bits: int = 8
    samples: int = 1
    sample_format: int = 1
    photometric: int = 1
    compression: int = 1
    planar: int = 1
    predictor: int = 1
    fill_order: int = 1
    orientation: int = 1
    order: str = "<"
    subsampling: tuple[int, int] = (1, 1)
    extra_samples: list[int] = field(default_factory=list)
    colormap: list[list[int]] = field(default_factory=list)
    luma: tuple[float, float, float] = (0.299, 0.587, 0.114)
    black_white: list[float] = field(default_factory=list)
    group3_options: int = 0
    jpeg_tables: bytes = b""

    def parameters(self, w: int, h: int, samples: int) -> codecs.Parameters:
        return codecs.Parameters(w, h, samples, self.bits, self.photometric, self.fill_order, self.group3_options, tables=self.jpeg_tables, subsampling=self.subsampling)


def unpack(data: bytes, w: int, h: int, samples: int, bits: int, order: str = "<", sample_format: int = UINT) -> np.ndarray:
    """An array (h, w, samples); rows begin at whole bytes. Samples of 24 bits and 16 or 24-bit floats are widened."""
    step = (w * samples * bits + 7) // 8
    data = codecs.sized(data, step * h)
    if bits in (8, 16, 32, 64):
        letter = "f" if sample_format == FLOAT and bits > 8 else "i" if sample_format == INT else "u"
        out = np.frombuffer(data, np.dtype(f"{letter}{bits // 8}").newbyteorder(order)).reshape(h, w, samples)
        return out.astype(out.dtype.newbyteorder("="))
    if bits == 24:
        raw = np.frombuffer(data, np.uint8).reshape(h, w, samples, 3).astype(np.int64)
        if order == "<":
            raw = raw[..., ::-1]
        value = raw[..., 0] << 16 | raw[..., 1] << 8 | raw[..., 2]
        if sample_format == FLOAT:
            sign, exponent, fraction = value >> 23, value >> 16 & 127, value & 65535
            normal = (1 + fraction / 65536) * 2.0 ** (exponent - 63)
            out = np.where(exponent == 0, fraction / 65536 * 2.0**-62, normal)
            out = np.where(exponent == 127, np.where(fraction == 0, np.inf, np.nan), out)
            return np.where(sign == 1, -out, out)
        return np.where(value >> 23 == 1, value - (1 << 24), value) if sample_format == INT else value
    bit = np.unpackbits(np.frombuffer(data, np.uint8).reshape(h, step), axis=1)[:, : w * samples * bits].reshape(h, w, samples, bits)
    value = (bit.astype(np.int64) << np.arange(bits - 1, -1, -1)).sum(-1)
    if sample_format == INT:
        value = np.where(value >> (bits - 1) == 1, value - (1 << bits), value)
    return value


def pack(array: np.ndarray, bits: int, order: str = "<", sample_format: int = UINT) -> bytes:
    """The inverse of `unpack`."""
    h, w, samples = array.shape
    if bits in (8, 16, 32, 64):
        letter = "f" if sample_format == FLOAT and bits > 8 else "i" if sample_format == INT else "u"
        return array.astype(np.dtype(f"{letter}{bits // 8}").newbyteorder(order)).tobytes()
    if bits == 24:
        value = array.astype(np.int64) & 0xFFFFFF
        raw = np.stack([value >> 16, value >> 8 & 255, value & 255], -1).astype(np.uint8)
        return (raw if order == ">" else raw[..., ::-1]).tobytes()
    value = array.astype(np.int64).reshape(h, w * samples)
    bit = (value[:, :, None] >> np.arange(bits - 1, -1, -1) & 1).astype(np.uint8).reshape(h, -1)
    return np.packbits(bit, axis=1).tobytes()


def unpack_ycbcr(data: bytes, w: int, h: int, horizontal: int, vertical: int) -> np.ndarray:
    """Blocks of horizontal x vertical luma samples with one Cb and Cr, as (h, w, 3) with chroma repeated."""
    across, down = -(-w // horizontal), -(-h // vertical)
    unit = horizontal * vertical + 2
    blocks = np.frombuffer(codecs.sized(data, across * down * unit), np.uint8).reshape(down, across, unit)
    luma = blocks[:, :, :-2].reshape(down, across, vertical, horizontal).transpose(0, 2, 1, 3).reshape(down * vertical, across * horizontal)
    chroma = np.repeat(np.repeat(blocks[:, :, -2:], vertical, axis=0), horizontal, axis=1)
    return np.concatenate((luma[:, :, None], chroma), axis=2)[:h, :w]


def pack_ycbcr(array: np.ndarray, horizontal: int, vertical: int) -> bytes:
    """The inverse: chroma of a block is its rounded mean."""
    h, w, _ = array.shape
    padded = np.pad(array, ((0, -h % vertical), (0, -w % horizontal), (0, 0)), mode="edge")
    down, across = padded.shape[0] // vertical, padded.shape[1] // horizontal
    cells = padded.reshape(down, vertical, across, horizontal, 3).transpose(0, 2, 1, 3, 4).reshape(down, across, -1, 3)
    n = horizontal * vertical
    chroma = (cells[..., 1:].astype(int).sum(2) + n // 2) // n
    return np.concatenate((cells[..., 0], chroma), axis=2).astype(np.uint8).tobytes()


def is_subsampled(m: Meta) -> bool:
    return m.photometric == YCBCR and m.planar == 1 and tuple(m.subsampling) != (1, 1) and m.compression not in (codecs.JPEG, codecs.OLD_JPEG)


def decode_bytes(raw: bytes, m: Meta, w: int, h: int, user: dict | None = None) -> bytes:
    """The decoded bytes of one chunk of one plane, in the file's byte order, with the predictor undone."""
    samples = 1 if m.planar == 2 else m.samples
    p = m.parameters(w, h, samples)
    if m.planar == 2 and m.compression == codecs.JPEG and m.photometric == YCBCR:
        p.photometric = MINISBLACK
    if is_subsampled(m):
        hs, vs = m.subsampling
        return codecs.decode(m.compression, raw, -(-w // hs) * -(-h // vs) * (hs * vs + 2), p, user)
    data = codecs.decode(m.compression, raw, codecs.row_bytes(p) * h, p, user)
    if m.predictor != 1 and m.compression in (codecs.LZW, codecs.DEFLATE, codecs.ADOBE_DEFLATE):
        data = predictors.decode(data, m.predictor, w, samples, m.bits, m.order, m.sample_format)
    return data


def decode_chunk(raws: list[bytes], m: Meta, w: int, h: int, user: dict | None = None) -> np.ndarray:
    """The samples (h, w, n) of a place in the image from its chunk, or from one chunk for each plane."""
    if m.planar == 2 and m.photometric == YCBCR and tuple(m.subsampling) != (1, 1) and len(raws) >= 3:
        hs, vs = m.subsampling
        planes = []
        for i, raw in enumerate(raws):
            small = i in (1, 2)
            pw, ph = (-(-w // hs), -(-h // vs)) if small else (w, h)
            plane = unpack(decode_bytes(raw, m, pw, ph, user), pw, ph, 1, m.bits, m.order, m.sample_format)
            planes.append(np.repeat(np.repeat(plane, vs, 0), hs, 1)[:h, :w] if small else plane)
        return np.concatenate(planes, axis=2)
    if is_subsampled(m):
        return unpack_ycbcr(decode_bytes(raws[0], m, w, h, user), w, h, *m.subsampling)
    samples = 1 if m.planar == 2 else m.samples
    planes = [unpack(decode_bytes(raw, m, w, h, user), w, h, samples, m.bits, m.order, m.sample_format) for raw in raws]
    return planes[0] if len(planes) == 1 else np.concatenate(planes, axis=2)


def encode_chunk(array: np.ndarray, m: Meta, level: int = -1, quality: int = 75, y_resolution: float = 0.0, user: dict | None = None) -> list[bytes]:
    """Compressed bytes of a chunk, one for each plane."""
    h, w, samples = array.shape
    out = []
    for plane in np.split(array, samples, axis=2) if m.planar == 2 else [array]:
        if is_subsampled(m):
            data = pack_ycbcr(plane, *m.subsampling)
        else:
            data = pack(plane, m.bits, m.order, m.sample_format)
            if m.predictor != 1 and m.compression in (codecs.LZW, codecs.DEFLATE, codecs.ADOBE_DEFLATE):
                data = predictors.encode(data, m.predictor, w, plane.shape[2], m.bits, m.order, m.sample_format)
        p = m.parameters(w, h, plane.shape[2])
        p.level, p.quality, p.y_resolution = level, quality, y_resolution
        out.append(codecs.encode(m.compression, data, p, user))
    return out


# Colour


def rgba_problem(m: Meta) -> str | None:
    """Why an image can't be converted to RGBA, or None."""
    if not codecs.is_configured(m.compression):
        return f"compression {m.compression} isn't configured"
    if m.bits not in (1, 2, 4, 8, 16):
        return f"images of {m.bits} bits aren't converted"
    colors = m.samples - len(m.extra_samples)
    if m.photometric in (MINISWHITE, MINISBLACK, PALETTE):
        if m.planar == 1 and m.samples != 1 and m.bits < 8:
            return "grey or palette images of several samples need 8 bits"
        return "the colour map is missing" if m.photometric == PALETTE and len(m.colormap) < 3 else None
    if m.photometric == RGB:
        return None if colors >= 3 else f"RGB needs 3 samples, not {colors}"
    if m.photometric == SEPARATED:
        return None if m.samples >= 4 and m.bits == 8 else "separated images need 4 samples of 8 bits"
    if m.photometric == YCBCR:
        return None if m.bits == 8 and m.samples >= 3 else "YCbCr needs 3 samples of 8 bits"
    if m.photometric == CIELAB:
        return None if m.bits == 8 and m.samples == 3 else "CIE L*a*b* needs 3 samples of 8 bits"
    return f"photometric interpretation {m.photometric} isn't converted"


def _fixed(x: float) -> int:
    return int(x * 65536 + (0.5 if x >= 0 else -0.5))


def _level(code: np.ndarray, black: float, white: float, scale: float) -> np.ndarray:
    span = white - black or 1.0
    return ((code.astype(np.float32) - np.float32(black)) * np.float32(scale) / np.float32(span)).astype(np.int64)


def ycbcr_to_rgb(a: np.ndarray, luma: tuple[float, float, float], black_white: list[float]) -> np.ndarray:
    lr, lg, lb = luma
    d1, d2, d3, d4 = _fixed(2 - 2 * lr), -_fixed(lr * (2 - 2 * lr) / lg), _fixed(2 - 2 * lb), -_fixed(lb * (2 - 2 * lb) / lg)
    ref = black_white if len(black_white) == 6 else [0, 255, 128, 255, 128, 255]
    y = _level(a[..., 0], ref[0], ref[1], 255)
    cb = _level(a[..., 1].astype(int), ref[2], ref[3], 127)
    cr = _level(a[..., 2].astype(int), ref[4], ref[5], 127)
    rgb = np.stack([y + (d1 * cr + 32768 >> 16), y + (d4 * cb + 32768 + d2 * cr >> 16), y + (d3 * cb + 32768 >> 16)], -1)
    return np.clip(rgb, 0, 255)


def rgb_to_ycbcr(a: np.ndarray, luma: tuple[float, float, float] = (0.299, 0.587, 0.114)) -> np.ndarray:
    """Full-range YCbCr of 8-bit RGB, rounded."""
    rgb = a[..., :3].astype(float)
    y = rgb @ np.array(luma)
    cb, cr = (rgb[..., 2] - y) / (2 - 2 * luma[2]) + 128, (rgb[..., 0] - y) / (2 - 2 * luma[0]) + 128
    return np.clip(np.rint(np.stack([y, cb, cr], -1)), 0, 255).astype(np.uint8)


# The display's matrix from XYZ, its white luminances, levels and gamma, and the D50 white point.
_TO_DISPLAY = np.array([[3.2410, -1.5374, -0.4986], [-0.9692, 1.8760, 0.0416], [0.0556, -0.2040, 1.0570]])
_WHITE_LUMINANCE, _BLACK_LUMINANCE, _GAMMA = 100.0, 1.0, 2.4
_D50 = (96.425, 100.0, 82.468)


def lab_to_rgb(a: np.ndarray, white: tuple[float, float, float] = _D50) -> np.ndarray:
    lightness = a[..., 0].astype(float) * 100 / 255
    x_, y_ = (a[..., i].astype(np.uint8).view(np.int8).astype(float) for i in (1, 2))
    low = lightness < 8.856
    y = np.where(low, lightness * white[1] / 903.292, white[1] * ((lightness + 16) / 116) ** 3)
    cube = np.where(low, 7.787 * (y / white[1]) + 16 / 116, (lightness + 16) / 116)

    def part(f: np.ndarray, w: float) -> np.ndarray:
        return np.where(f < 0.2069, w * (f - 0.13793) / 7.787, w * f**3)

    xyz = np.stack([part(cube + x_ / 500, white[0]), y, part(cube - y_ / 200, white[2])], -1)
    linear = np.clip(xyz @ _TO_DISPLAY.T, _BLACK_LUMINANCE, _WHITE_LUMINANCE)
    steps = ((linear - _BLACK_LUMINANCE) * 1500 / (_WHITE_LUMINANCE - _BLACK_LUMINANCE)).astype(int)
    return np.clip((255 * (steps / 1500) ** (1 / _GAMMA) + 0.5).astype(int), 0, 255)


def to_rgba(a: np.ndarray, m: Meta, compat: bool = False) -> np.ndarray:
    """8-bit RGBA (h, w, 4) of decoded samples; unassociated alpha is multiplied in. compat repeats a known fault: grey with alpha turns black."""
    problem = rgba_problem(m)
    if problem:
        raise ValueError(problem)
    h, w, n = a.shape
    out = np.full((h, w, 4), 255, np.int64)
    kinds = list(m.extra_samples)
    colors = max(1, n - len(kinds))
    alpha_kind = 0
    if kinds:
        alpha_kind = ASSOCIATED_ALPHA if kinds[0] == UNSPECIFIED and n > 3 else kinds[0] if kinds[0] in (1, 2) else 0
    top = (1 << m.bits) - 1

    def eight(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.int64)
        return x >> 8 if m.bits == 16 else x if m.bits == 8 else x * 255 // top

    if m.photometric in (MINISWHITE, MINISBLACK):
        v = eight(a[..., 0])
        if m.photometric == MINISWHITE:
            v = 255 - v if m.bits in (8, 16) else (top - a[..., 0].astype(np.int64)) * 255 // top
        out[..., :3] = v[..., None]
        if alpha_kind and n > colors:
            out[..., 3] = eight(a[..., colors])
            if compat:
                out[..., :3] = 0
                alpha_kind = ASSOCIATED_ALPHA
    elif m.photometric == PALETTE:
        table = np.array(m.colormap, np.int64)[:3]
        if (table >= 256).any():
            table = table >> 8
        out[..., :3] = table[:, np.minimum(a[..., 0].astype(np.int64), table.shape[1] - 1)].transpose(1, 2, 0)
    elif m.photometric == RGB:
        out[..., :3] = eight(a[..., :3])
        if alpha_kind and n > 3:
            out[..., 3] = eight(a[..., 3])
    elif m.photometric == SEPARATED:
        inverse = 255 - a[..., :4].astype(np.int64)
        out[..., :3] = inverse[..., 3:4] * inverse[..., :3] // 255
    elif m.photometric == YCBCR:
        out[..., :3] = ycbcr_to_rgb(a, m.luma, m.black_white)
    elif m.photometric == CIELAB:
        out[..., :3] = lab_to_rgb(a)
    if alpha_kind == UNASSOCIATED_ALPHA:
        out[..., :3] = (out[..., :3] * out[..., 3:4] + 127) // 255
    return out.astype(np.uint8)


def pack_words(rgba: np.ndarray) -> np.ndarray:
    """Signed 32-bit words with alpha in the highest byte, then blue, green and red."""
    return np.ascontiguousarray(rgba).view("<i4")[..., 0]
