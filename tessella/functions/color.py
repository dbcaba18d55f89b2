"""Colour conversions to 8-bit RGBA as column expressions; all arithmetic is on whole numbers, as results must be exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.geometry import div


def clamp(x: Column, low: int = 0, high: int = 255) -> Column:
    return F.greatest(F.lit(low).cast("long"), F.least(F.lit(high).cast("long"), x))


def grey(x: Column, bits: int = 8, white_is_zero: bool = False) -> Column:
    """A grey sample of 1, 2, 4, 8 or 16 bits on the scale to 255; of 16 bits the high byte counts."""
    if bits == 16:
        x, top = F.shiftright(x, 8), 255
    else:
        top = (1 << bits) - 1
    return div((F.lit(top) - x if white_is_zero else x) * 255, top)


def premultiply(c: Column, a: Column) -> Column:
    return div(c * a + 127, 255)


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> tuple[Column, Column, Column]:
    return tuple(div((F.lit(255) - k) * (F.lit(255) - x), 255) for x in (c, m, y))


def fixed(x: float) -> int:
    """A fixed-point number with 16 fractional bits."""
    return int(x * 65536 + (0.5 if x >= 0 else -0.5))


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column, luma: tuple[float, float, float] = (0.299, 0.587, 0.114)) -> tuple[Column, Column, Column]:
    """With reference levels 0 to 255 for Y and 128 +- 127 for Cb and Cr."""
    lr, lg, lb = luma
    d1, d2, d3, d4 = fixed(2 - 2 * lr), -fixed(lr * (2 - 2 * lr) / lg), fixed(2 - 2 * lb), -fixed(lb * (2 - 2 * lb) / lg)
    b, r = cb - 128, cr - 128
    return (
        clamp(y + F.shiftright(r * d1 + 32768, 16)),
        clamp(y + F.shiftright(b * d4 + 32768 + r * d2, 16)),
        clamp(y + F.shiftright(b * d3 + 32768, 16)),
    )


def pack_rgba(r: Column, g: Column, b: Column, a: Column | int = 255) -> Column:
    """Alpha in the highest byte, then blue, green and red, as a long that isn't negative."""
    a = F.lit(a) if isinstance(a, int) else a
    return a.cast("long") * (1 << 24) + b.cast("long") * (1 << 16) + g.cast("long") * (1 << 8) + r.cast("long")


def unpack_rgba(packed: Column) -> tuple[Column, Column, Column, Column]:
    return tuple(F.shiftright(packed, 8 * i).bitwiseAND(255) for i in range(4))


def high_byte(x: Column) -> Column:
    return F.shiftright(x, 8)


def scaled_to_8(x: Column) -> Column:
    """A 16-bit sample rounded to 8 bits, v / 257."""
    return div(x * 2 + 257, 514)


def multiply_wrapped(x: Column, factor: int, bits: int = 16) -> Column:
    return F.pmod(x * factor, F.lit(1 << bits))


def byteswap(x: Column, size: int) -> Column:
    """The bytes of a number that isn't negative in reverse order (2 or 4 of them)."""
    out = F.lit(0).cast("long")
    for i in range(size):
        out = out + F.shiftright(x, 8 * i).bitwiseAND(255) * (1 << (8 * (size - 1 - i)))
    return out


def bitonal(r: Column, g: Column, b: Column, threshold: int = 500) -> Column:
    return (r + g + b > threshold).cast("int")


def reverse_bits(x: Column) -> Column:
    """The bits of a byte in reverse order."""
    out = F.lit(0).cast("long")
    for i in range(8):
        out = out + F.shiftright(x, i).bitwiseAND(1) * (1 << (7 - i))
    return out


def rgb_to_ycbcr(r: Column, g: Column, b: Column, luma: tuple[float, float, float] = (0.299, 0.587, 0.114)) -> tuple[Column, Column, Column]:
    """Full-range YCbCr in fixed-point arithmetic, rounded."""
    lr, lg, lb = luma
    cb, cr = 2 - 2 * lb, 2 - 2 * lr
    y = F.shiftright(r * fixed(lr) + g * fixed(lg) + b * fixed(lb) + 32768, 16)
    blue = F.shiftright(r * fixed(-lr / cb) + g * fixed(-lg / cb) + b * 32768 + (128 << 16) + 32767, 16)
    red = F.shiftright(r * 32768 + g * fixed(-lg / cr) + b * fixed(-lb / cr) + (128 << 16) + 32767, 16)
    return clamp(y), clamp(blue), clamp(red)


def cmyk_to_ycck(c: Column, m: Column, y: Column, k: Column) -> tuple[Column, Column, Column, Column]:
    """YCbCr of the inverse of C, M and Y, with K as it is."""
    return (*rgb_to_ycbcr(255 - c, 255 - m, 255 - y), k)


def ycck_to_cmyk(y: Column, cb: Column, cr: Column, k: Column) -> tuple[Column, Column, Column, Column]:
    r, g, b = ycbcr_to_rgb(y, cb, cr)
    return 255 - r, 255 - g, 255 - b, k


def rgb_to_grey(r: Column, g: Column, b: Column) -> Column:
    return rgb_to_ycbcr(r, g, b)[0]


def transfer_curve(bits: int) -> list[int]:
    """The default transfer function, a gamma of 2.2 on the scale to 65,535."""
    top = (1 << bits) - 1
    return [int(65535 * (i / top) ** 2.2 + 0.5) for i in range(top + 1)]


def rgba_to_rgb(c: Column, a: Column) -> Column:
    """A colour multiplied by its alpha, over white."""
    return clamp(c + 255 - a)


def octal(x: Column) -> Column:
    """A byte as a backslash and three octal digits."""
    return F.concat(F.lit("\\"), F.lpad(F.conv(x.cast("string"), 10, 8), 3, "0"))
