"""Coercions of tag values between widths and signs: whole numbers keep their bits where the width is that of the target, and are checked elsewhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = {"byte": 8, "short": 16, "int": 32}


def unsigned(x: Column, kind: str) -> Column:
    """The bits of a signed number of this width as a number that isn't negative."""
    return F.pmod(x.cast("long"), F.lit(1 << _BITS[kind]))


def signed(x: Column, kind: str) -> Column:
    """The low bits of a number as a signed number of this width."""
    half = 1 << (_BITS[kind] - 1)
    return F.pmod(x.cast("long") + half, F.lit(2 * half)) - half


def checked(x: Column, kind: str, is_signed: bool = True) -> Column:
    """The number if it fits in the width, else null."""
    n = _BITS[kind]
    low, high = (-(1 << (n - 1)), (1 << (n - 1)) - 1) if is_signed else (0, (1 << n) - 1)
    return F.when(x.between(low, high), x.cast("long"))


def array_to(values: Column, kind: str) -> Column:
    """An array of numbers cast to another type, element by element; what can't be cast is null."""
    return F.transform(values, lambda v: v.try_cast(kind))


def regroup(raw: Column, size: int, big_endian: bool = False) -> Column:
    """Whole numbers of `size` bytes from a binary value; null if its length isn't a multiple."""
    n = F.octet_length(raw)
    digit = lambda i: F.conv(F.hex(F.substring(raw, i + 1, F.lit(1)) if isinstance(i, int) else F.substr(raw, i + 1, F.lit(1))), 16, 10).cast("long")
    order = range(size) if big_endian else range(size - 1, -1, -1)

    def number(k: Column) -> Column:
        out = F.lit(0).cast("long")
        for i in order:
            out = out * 256 + digit(k * size + i)
        return out

    return F.when((F.pmod(n, F.lit(size)) == 0) & (n > 0), F.transform(F.sequence(F.lit(0), (n / size).cast("int") - 1), number)).when(n == 0, F.array().cast("array<bigint>"))
