"""Chunk codecs, bytes to bytes: raw, PackBits, LZW, Deflate and CCITT, after their public specifications (TIFF 6.0, T.4, T.6).

A codec is looked up by the scheme's number. Decoders get the compressed bytes, the number of bytes wanted and the chunk's
parameters, and give exactly that number, padded with zeros where the data end early; encoders are their inverse.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the format: numbers of compression schemes.
NONE, CCITT_RLE, CCITT_FAX3, CCITT_FAX4, LZW, OLD_JPEG, JPEG, ADOBE_DEFLATE = 1, 2, 3, 4, 5, 6, 7, 8
NEXT, CCITT_RLEW, PACKBITS, THUNDERSCAN, PIXARLOG, DEFLATE, JBIG, SGILOG, SGILOG24 = 32766, 32771, 32773, 32809, 32909, 32946, 34661, 34676, 34677
NAMES = {
    NONE: "none", CCITT_RLE: "ccitt_rle", CCITT_FAX3: "g3", CCITT_FAX4: "g4", LZW: "lzw", OLD_JPEG: "old_jpeg", JPEG: "jpeg", ADOBE_DEFLATE: "zip",
    NEXT: "next", CCITT_RLEW: "ccitt_rlew", PACKBITS: "packbits", THUNDERSCAN: "thunderscan", PIXARLOG: "pixarlog", DEFLATE: "deflate", JBIG: "jbig", SGILOG: "sgilog", SGILOG24: "sgilog24",
}
#: Schemes that are known by name only.
WITHOUT_CODEC = {NEXT, THUNDERSCAN, PIXARLOG, JBIG, SGILOG, SGILOG24}


class CodecError(ValueError):
    """Data that a codec can't read, or a scheme without a codec."""


@dataclass
class Parameters:
    """What a codec needs to know of its chunk."""

    width: int = 0
    height: int = 0
    samples: int = 1
    bits: int = 8
    photometric: int = 1
    fill_order: int = 1
    group3_options: int = 0
    level: int = -1
    quality: int = 75
    tables: bytes = b""
    subsampling: tuple[int, int] = (1, 1)
    raw_color: bool = False
    old_jpeg: dict = field(default_factory=dict)
    y_resolution: float = 0.0


_REVERSED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little"), axis=1)[:, 0]


def reverse_bits(data: bytes) -> bytes:
    return _REVERSED[np.frombuffer(data, np.uint8)].tobytes()


def sized(data: bytes, size: int) -> bytes:
    return data[:size] + bytes(max(0, size - len(data)))


# PackBits


def packbits_decode(data: bytes, size: int, _p: Parameters | None = None) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        k = data[i]
        i += 1
        if k < 128:
            out += data[i : i + k + 1]
            i += k + 1
        elif k > 128 and i < n:
            out += data[i : i + 1] * (257 - k)
            i += 1
    return sized(bytes(out), size)


def packbits_encode_row(row: bytes) -> bytes:
    values = np.frombuffer(row, np.uint8)
    edge = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, int)
    length = np.diff(np.append(edge, len(values)))
    out, literal = bytearray(), bytearray()

    def flush() -> None:
        for s in range(0, len(literal), 128):
            part = literal[s : s + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    for v, k in zip(values[edge].tolist(), length.tolist(), strict=True):
        if k < 3:
            literal.extend([v] * k)
            continue
        flush()
        while k:
            take = min(k, 128)
            if take == 1:
                literal.append(v)
            else:
                out += bytes((257 - take, v))
            k -= take
    flush()
    return bytes(out)


def packbits_encode(data: bytes, p: Parameters) -> bytes:
    """Row by row, as runs don't go over the end of a row."""
    step = row_bytes(p) or len(data) or 1
    return b"".join(packbits_encode_row(data[s : s + step]) for s in range(0, len(data), step))


def row_bytes(p: Parameters) -> int:
    return (p.width * p.samples * p.bits + 7) // 8


# LZW


def lzw_decode(data: bytes, size: int, _p: Parameters | None = None) -> bytes:
    """Codes of 9 to 12 bits, the highest bit first; streams of the older order, the lowest bit first, are told by their first two bytes."""
    old = len(data) > 1 and data[0] == 0 and bool(data[1] & 1)
    out: list[bytes] = []
    total = bits = held = at = 0
    width, table, last = 9, [], None
    n = len(data)
    while total < size:
        while held < width:
            if at >= n:
                return sized(b"".join(out), size)
            bits = bits | data[at] << held if old else bits << 8 | data[at]
            at += 1
            held += 8
        if old:
            code = bits & ((1 << width) - 1)
            bits >>= width
        else:
            code = bits >> (held - width)
            bits &= (1 << (held - width)) - 1
        held -= width
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, None
            continue
        if not table:
            raise CodecError("an LZW stream without a clear code")
        if last is None:
            if code > 255:
                raise CodecError("an LZW stream with a bad first code")
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise CodecError(f"an LZW code {code} out of range")
            table.append(last + entry[:1])
        out.append(entry)
        total += len(entry)
        last = entry
        # the newer streams change width one code early
        if len(table) + (0 if old else 1) >= 1 << width and width < 12:
            width += 1
    return sized(b"".join(out), size)


def lzw_encode(data: bytes, _p: Parameters | None = None) -> bytes:
    out, bits, held = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal bits, held
        bits = bits << width | code
        held += width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
        bits &= (1 << held) - 1

    first = {bytes((i,)): i for i in range(256)}
    table, width, free = dict(first), 9, 258
    put(256, width)
    prefix = b""
    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if longer in table:
            prefix = longer
            continue
        put(table[prefix], width)
        table[longer] = free
        free += 1
        if free == 4095:  # room for this last code at 12 bits, then anew
            put(256, 12)
            table, width, free = dict(first), 9, 258
        elif free > (1 << width) - 1:
            width += 1
        prefix = data[i : i + 1]
    if prefix:
        put(table[prefix], width)
        free += 1
        if free > (1 << width) - 1 and width < 12:
            width += 1
    put(257, width)
    if held:
        out.append(bits << (8 - held) & 255)
    return bytes(out)


# Deflate


def deflate_decode(data: bytes, size: int, _p: Parameters | None = None) -> bytes:
    """What can be read of a damaged stream counts; nothing at all is an error."""
    stream = zlib.decompressobj()
    out = bytearray()
    try:
        out += stream.decompress(data, size) if size else stream.decompress(data)
    except zlib.error as e:
        stream = zlib.decompressobj()
        for i in range(0, len(data), 256):
            try:
                out += stream.decompress(data[i : i + 256])
            except zlib.error:
                break
        if not out:
            raise CodecError(str(e)) from e
    return sized(bytes(out), size)


def deflate_encode(data: bytes, p: Parameters | None = None) -> bytes:
    return zlib.compress(data, p.level if p else -1)


# CCITT

# Fixed values of T.4: codes of runs of 0 to 63 white pixels, of 0 to 63 black ones, of 64, 128, ... 1728 white and black
# ones, and of 1792, 1856, ... 2560 of either.
WHITE = """00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101
101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010
00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010
00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100""".split()
BLACK = """0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000
0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001
000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111
000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111""".split()
WHITE_LONG = """11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011
011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011""".split()
BLACK_LONG = """0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010
0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101""".split()
EXTRA_LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
# Fixed values of T.4 and T.6: modes of two-dimensional rows, and the end of a line.
PASS_MODE, HORIZONTAL_MODE = "0001", "001"
VERTICAL_MODES = {0: "1", 1: "011", 2: "000011", 3: "0000011", -1: "010", -2: "000010", -3: "0000010"}
EOL = "000000000001"

_RUNS = [[*WHITE, *WHITE_LONG, *EXTRA_LONG], [*BLACK, *BLACK_LONG, *EXTRA_LONG]]
_LENGTHS = [*range(64), *range(64, 2561, 64)]
_READ = [{c: n for c, n in zip(codes, _LENGTHS, strict=True)} for codes in _RUNS]
_MODES = {PASS_MODE: "pass", HORIZONTAL_MODE: "horizontal"} | {c: d for d, c in VERTICAL_MODES.items()}


class _Bits:
    """Reads codes from a string of bits."""

    def __init__(self, data: bytes):
        self.s = np.unpackbits(np.frombuffer(data, np.uint8)).tobytes().translate(bytes([48, 49]) + bytes(254)).decode()
        self.at = 0

    def code(self, table: dict, longest: int = 13):
        for k in range(1, longest + 1):
            found = table.get(self.s[self.at : self.at + k])
            if found is not None:
                self.at += k
                return found
        raise CodecError("an unknown fax code")

    def run(self, color: int) -> int:
        total = 0
        while True:
            n = self.code(_READ[color])
            total += n
            if n < 64:
                return total

    def skip_eol(self) -> bool:
        """Goes past an end of line with its filling zeros, if one is next."""
        one = self.s.find("1", self.at)
        if one - self.at >= 11:
            self.at = one + 1
            return True
        return False


def _row_1d(bits: _Bits, width: int) -> list[int]:
    """Places where the colour changes, from the first black pixel on."""
    x, color, changes = 0, 0, []
    while x < width:
        x += bits.run(color)
        changes.append(min(x, width))
        color ^= 1
    return changes


def _after(reference: list[int], a0: int, color: int, width: int) -> tuple[int, int]:
    """The first change in the reference row right of a0 to the other colour, and the next one."""
    i = color  # changes to black have even numbers
    while i < len(reference) and reference[i] <= a0:
        i += 2
    b1 = reference[i] if i < len(reference) else width
    return b1, reference[i + 1] if i + 1 < len(reference) else width


def _row_2d(bits: _Bits, reference: list[int], width: int) -> list[int]:
    a0, color, changes = -1, 0, []
    while a0 < width:
        b1, b2 = _after(reference, a0, color, width)
        mode = bits.code(_MODES, 7)
        if mode == "pass":
            a0 = b2
        elif mode == "horizontal":
            start = max(a0, 0)
            first = start + bits.run(color)
            second = first + bits.run(color ^ 1)
            changes += [min(first, width), min(second, width)]
            a0 = second
        else:
            a0 = b1 + mode
            changes.append(min(max(a0, 0), width))
            color ^= 1
    return changes


def _pixels(changes: list[int], width: int) -> np.ndarray:
    row = np.zeros(width + 1, np.int8)
    for x in changes:
        row[x:] ^= 1
    return row[:width].astype(np.uint8)


def _changes(row: np.ndarray) -> list[int]:
    return np.flatnonzero(np.diff(np.concatenate(([0], row.astype(np.int8))))).tolist()


def ccitt_decode(data: bytes, size: int, p: Parameters, scheme: int = CCITT_FAX3) -> bytes:
    """Rows of one-bit pixels; a row that can't be read is white (G3 goes on at the next end of line), the rest after a G4 error, too."""
    bits = _Bits(data)
    width = p.width
    step = (width + 7) // 8
    rows = size // step if step else 0
    out = np.zeros((rows, step * 8), np.uint8)
    reference: list[int] = []
    for r in range(rows):
        try:
            if scheme == CCITT_FAX4:
                reference = _row_2d(bits, reference, width)
            elif scheme == CCITT_FAX3:
                had_eol = bits.skip_eol()
                if p.group3_options & 1:
                    one_dimension = not had_eol or bits.s[bits.at : bits.at + 1] == "1"
                    bits.at += had_eol
                    reference = _row_1d(bits, width) if one_dimension else _row_2d(bits, reference, width)
                else:
                    reference = _row_1d(bits, width)
            else:
                reference = _row_1d(bits, width)
                unit = 16 if scheme == CCITT_RLEW else 8
                bits.at = -(-bits.at // unit) * unit
        except CodecError:
            if scheme == CCITT_FAX3:
                following = bits.s.find("0" * 11 + "1", bits.at)
                if following >= 0:
                    bits.at = following
                    continue
            break
        out[r, :width] = _pixels(reference, width)
    return sized(np.packbits(out, axis=1).tobytes(), size)


def _run_code(length: int, color: int) -> str:
    out = ""
    while length >= 2624:
        out += EXTRA_LONG[-1]
        length -= 2560
    if length >= 64:
        out += _RUNS[color][63 + length // 64]
        length %= 64
    return out + _RUNS[color][length]


def _encode_1d(row: np.ndarray) -> str:
    edges = [0, *_changes(row), len(row)]
    return "".join(_run_code(b - a, i & 1) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a or i == 0)


def _encode_2d(row: np.ndarray, above: np.ndarray) -> str:
    width = len(row)
    own, reference = _changes(row), _changes(above)
    a0, color, out = -1, 0, []
    while a0 < width:
        later = [x for x in own if x > a0 and (x > 0 or a0 < 0)]
        # of the own changes, the next one away from the current colour
        a1 = next((x for x in later if (row[x] if x < width else color) != color), width)
        b1, b2 = _after(reference, a0, color, width)
        if b2 < a1:
            out.append(PASS_MODE)
            a0 = b2
        elif abs(a1 - b1) <= 3:
            out.append(VERTICAL_MODES[a1 - b1])
            a0 = a1
            color ^= 1
        else:
            a2 = next((x for x in own if x > a1), width)
            out += [HORIZONTAL_MODE, _run_code(a1 - max(a0, 0), color), _run_code(a2 - a1, color ^ 1)]
            a0 = a2
    return "".join(out)


def ccitt_encode(data: bytes, p: Parameters, scheme: int = CCITT_FAX3) -> bytes:
    """G3 rows begin with an end of line; with option 1 every k-th row is one-dimensional (k is 4 above 150 lines an inch, else 2); option 4 aligns the ends of lines."""
    step = (p.width + 7) // 8
    rows = np.unpackbits(np.frombuffer(data, np.uint8)).reshape(-1, step * 8)[:, : p.width]
    above = np.zeros(p.width, np.uint8)
    parts: list[str] = []
    size = 0
    every = 4 if p.y_resolution > 150 else 2
    for i, row in enumerate(rows):
        if scheme == CCITT_FAX4:
            code = _encode_2d(row, above)
        elif scheme == CCITT_FAX3:
            fill = -(size + 12) % 8 if p.group3_options & 4 else 0
            code = "0" * fill + EOL
            if p.group3_options & 1:
                flat = i % every == 0
                code += ("1" if flat else "0") + (_encode_1d(row) if flat else _encode_2d(row, above))
            else:
                code += _encode_1d(row)
        else:
            code = _encode_1d(row)
            unit = 16 if scheme == CCITT_RLEW else 8
            code += "0" * (-len(code) % unit)
        parts.append(code)
        size += len(code)
        above = row
    if scheme == CCITT_FAX4:
        parts.append(EOL * 2)
    elif scheme == CCITT_FAX3:
        parts.append((EOL + ("1" if p.group3_options & 1 else "")) * 6)
    s = "".join(parts)
    s += "0" * (-len(s) % 8)
    return np.packbits(np.frombuffer(s.encode(), np.uint8) - 48).tobytes() if s else b""


Decoder = Callable[[bytes, int, Parameters], bytes]
Encoder = Callable[[bytes, Parameters], bytes]
_BUILT_IN: dict[int, tuple[Decoder, Encoder | None]] = {
    NONE: (lambda d, n, p: sized(d, n), lambda d, p: d),
    PACKBITS: (packbits_decode, packbits_encode),
    LZW: (lzw_decode, lzw_encode),
    DEFLATE: (deflate_decode, deflate_encode),
    ADOBE_DEFLATE: (deflate_decode, deflate_encode),
}
for _scheme in (CCITT_RLE, CCITT_RLEW, CCITT_FAX3, CCITT_FAX4):
    _BUILT_IN[_scheme] = (lambda d, n, p, s=_scheme: ccitt_decode(d, n, p, s), lambda d, p, s=_scheme: ccitt_encode(d, p, s))
_REGISTERED: dict[int, tuple[Decoder, Encoder | None]] = {}


def register_codec(scheme: int, decode: Decoder, encode: Encoder | None = None) -> None:
    """Adds a codec, which goes before a built-in one of that scheme."""
    _REGISTERED[scheme] = (decode, encode)


def unregister_codec(scheme: int) -> None:
    _REGISTERED.pop(scheme, None)


def registered() -> dict[int, tuple[Decoder, Encoder | None]]:
    return dict(_REGISTERED)


def is_configured(scheme: int) -> bool:
    return scheme in _REGISTERED or scheme in _BUILT_IN


def configured_schemes() -> list[int]:
    return sorted({*_BUILT_IN, *_REGISTERED})


def decode(scheme: int, data: bytes, size: int, p: Parameters, user: dict | None = None) -> bytes:
    codec = (user or {}).get(scheme) or _REGISTERED.get(scheme) or _BUILT_IN.get(scheme)
    if codec is None:
        raise CodecError(f"compression scheme {scheme} ({NAMES.get(scheme, 'unknown')}) isn't configured")
    return codec[0](reverse_bits(data) if p.fill_order == 2 and scheme not in (JPEG, OLD_JPEG) else data, size, p)


def encode(scheme: int, data: bytes, p: Parameters, user: dict | None = None) -> bytes:
    codec = (user or {}).get(scheme) or _REGISTERED.get(scheme) or _BUILT_IN.get(scheme)
    if codec is None or codec[1] is None:
        raise CodecError(f"compression scheme {scheme} ({NAMES.get(scheme, 'unknown')}) has no encoder")
    out = codec[1](data, p)
    return reverse_bits(out) if p.fill_order == 2 and scheme not in (JPEG, OLD_JPEG) else out
