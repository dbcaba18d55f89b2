"""JPEG (T.81): sequential and progressive Huffman decoding, and baseline encoding with Huffman tables made for the data.

Coefficients are decoded by plain code and transformed for a whole image at once by matrix products. Components come
out at full size, chroma repeated, in the stream's own colour space.
"""

from __future__ import annotations

import heapq
import struct
from collections import Counter

import numpy as np

from .codecs import JPEG, OLD_JPEG, CodecError, Parameters, _BUILT_IN, sized

# Fixed values of T.81: the order of coefficients, and the quantisation tables for luma and chroma at quality 50.
ZIGZAG = np.array("""0 1 8 16 9 2 3 10 17 24 32 25 18 11 4 5 12 19 26 33 40 48 41 34 27 20 13 6 7 14 21 28
35 42 49 56 57 50 43 36 29 22 15 23 30 37 44 51 58 59 52 45 38 31 39 46 53 60 61 54 47 55 62 63""".split(), int)
LUMA = np.array("""16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99""".split(), int)
CHROMA = np.array("""17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99""".split(), int)

_K, _N = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
_DCT = np.cos((2 * _N + 1) * _K * np.pi / 16) * np.where(_K == 0, np.sqrt(1 / 8), 0.5)


def quality_table(base: np.ndarray, quality: int) -> np.ndarray:
    quality = min(100, max(1, quality))
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((base * scale + 50) // 100, 1, 255)


def forward(blocks: np.ndarray) -> np.ndarray:
    return _DCT @ blocks @ _DCT.T


def inverse(blocks: np.ndarray) -> np.ndarray:
    return _DCT.T @ blocks @ _DCT


class _Component:
    def __init__(self, name: int, h: int, v: int, table: int):
        self.name, self.h, self.v, self.table = name, h, v, table
        self.dc = self.ac = self.last = 0
        self.across = self.down = 0
        self.blocks: list[list[int]] = []


class _Reader:
    """Bits of entropy-coded data between two markers."""

    def __init__(self, data: bytes):
        self.data, self.at, self.bits, self.n = data.replace(b"\xff\0", b"\xff"), 0, 0, 0

    def fill(self, k: int) -> None:
        part = self.data[self.at : self.at + 8]
        self.at += 8
        self.bits = self.bits << 64 | int.from_bytes(part + bytes(8 - len(part)), "big")
        self.n += 64
        if self.at > len(self.data) + 64 + k:
            raise CodecError("JPEG data end early")

    def take(self, k: int) -> int:
        if not k:
            return 0
        if self.n < k:
            self.fill(k)
        self.n -= k
        out = self.bits >> self.n
        self.bits &= (1 << self.n) - 1
        return out

    def symbol(self, table: list[int] | None) -> int:
        if table is None:
            raise CodecError("a JPEG Huffman table is missing")
        if self.n < 16:
            self.fill(16)
        found = table[self.bits >> (self.n - 16) & 0xFFFF]
        if not found:
            raise CodecError("a bad JPEG code")
        self.n -= found >> 8
        self.bits &= (1 << self.n) - 1
        return found & 255

    def extend(self, k: int) -> int:
        v = self.take(k)
        return v if not k or v >> (k - 1) else v - (1 << k) + 1


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """Length and symbol for each 16 bits that may follow."""
    out, code, i = [0] * 65536, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            first = code << (16 - length)
            n = 1 << (16 - length)
            out[first : first + n] = [length << 8 | symbols[i]] * n
            code += 1
            i += 1
        code <<= 1
    return out


class Decoder:
    def __init__(self):
        self.q: dict[int, np.ndarray] = {}
        self.dc: dict[int, list[int]] = {}
        self.ac: dict[int, list[int]] = {}
        self.components: list[_Component] = []
        self.restart = self.width = self.height = self.eob_run = 0
        self.adobe: int | None = None
        self.progressive = False
        #: Application and comment segments: (marker, body).
        self.saved: list[tuple[int, bytes]] = []

    def read(self, data: bytes) -> None:
        """Tables, frame and scans of a stream."""
        at = 2 if data[:2] == b"\xff\xd8" else 0
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            mark = data[at + 1]
            if mark in (0xFF, 0, 0xD8) or 0xD0 <= mark <= 0xD7:
                at += 1 if mark == 0xFF else 2
                continue
            if mark == 0xD9:
                return
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if mark == 0xDB:
                self._quantisation(body)
            elif mark == 0xC4:
                self._huffman(body)
            elif mark in (0xC0, 0xC1, 0xC2):
                self._frame(body, mark == 0xC2)
            elif 0xC3 <= mark <= 0xCF:
                raise CodecError(f"JPEG process {mark:#x} isn't supported")
            elif mark == 0xDD:
                self.restart = struct.unpack(">H", body[:2])[0]
            elif 0xE0 <= mark <= 0xEF or mark == 0xFE:
                self.saved.append((mark, body))
                if mark == 0xEE and body[:5] == b"Adobe":
                    self.adobe = body[11]
            elif mark == 0xDA:
                at = self._scan(body, data, at)

    def _quantisation(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, name = body[at] >> 4, body[at] & 15
            at += 1
            size = 128 if wide else 64
            table = np.zeros(64)
            table[ZIGZAG] = np.frombuffer(body[at : at + size], ">u2" if wide else np.uint8)
            self.q[name] = table
            at += size

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            kind, name = body[at] >> 4, body[at] & 15
            counts = body[at + 1 : at + 17]
            n = sum(counts)
            (self.ac if kind else self.dc)[name] = _lookup(counts, body[at + 17 : at + 17 + n])
            at += 17 + n

    def _frame(self, body: bytes, progressive: bool) -> None:
        bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if bits != 8:
            raise CodecError("JPEG samples of other than 8 bits aren't supported")
        self.progressive = progressive
        self.components = [_Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        self.hmax, self.vmax = max(c.h for c in self.components), max(c.v for c in self.components)
        self.mcus = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for c in self.components:
            c.across, c.down = self.mcus[0] * c.h, self.mcus[1] * c.v
            c.blocks = [[0] * 64 for _ in range(c.across * c.down)]

    def _scan(self, body: bytes, data: bytes, at: int) -> int:
        n = body[0]
        chosen = []
        for i in range(n):
            c = next((c for c in self.components if c.name == body[1 + 2 * i]), None)
            if c is None:
                raise CodecError("a JPEG scan of an unknown component")
            c.dc, c.ac, c.last = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15, 0
            chosen.append(c)
        start, end, shifts = body[1 + 2 * n : 4 + 2 * n]
        high, low = shifts >> 4, shifts & 15
        stop = at
        parts, begin = [], at
        while True:  # the data up to a marker, in the pieces between restarts
            stop = data.find(b"\xff", stop)
            if stop < 0 or stop + 1 >= len(data):
                stop = len(data)
                break
            following = data[stop + 1]
            if 0xD0 <= following <= 0xD7:
                parts.append(data[begin:stop])
                stop += 2
                begin = stop
            elif following == 0:
                stop += 2
            else:
                break
        parts.append(data[begin:stop])
        if n == 1:
            c = chosen[0]
            w, h = -(-(-(-self.width * c.h // self.hmax)) // 8), -(-(-(-self.height * c.v // self.vmax)) // 8)
            units = [[(c, y * c.across + x)] for y in range(h) for x in range(w)]
        else:
            units = [[(c, (my * c.v + v) * c.across + mx * c.h + h) for c in chosen for v in range(c.v) for h in range(c.h)] for my in range(self.mcus[1]) for mx in range(self.mcus[0])]
        step = self.restart or len(units) or 1
        for k, s in enumerate(range(0, len(units), step)):
            if k >= len(parts):
                break
            reader = _Reader(parts[k])
            self.eob_run = 0
            for c in chosen:
                c.last = 0
            for unit in units[s : s + step]:
                for c, place in unit:
                    block = c.blocks[place]
                    if not self.progressive:
                        self._sequential(reader, c, block)
                    elif start == 0:
                        self._dc(reader, c, block, high, low)
                    elif high == 0:
                        self._ac_first(reader, c, block, start, end, low)
                    else:
                        self._ac_refine(reader, c, block, start, end, low)
        return stop

    def _sequential(self, r: _Reader, c: _Component, block: list[int]) -> None:
        c.last += r.extend(r.symbol(self.dc.get(c.dc)))
        block[0] = c.last
        table, k = self.ac.get(c.ac), 1
        while k < 64:
            s = r.symbol(table)
            size = s & 15
            if not size:
                if s != 0xF0:
                    return
                k += 16
                continue
            k += s >> 4
            if k > 63:
                raise CodecError("JPEG coefficients beyond the block")
            block[k] = r.extend(size)
            k += 1

    def _dc(self, r: _Reader, c: _Component, block: list[int], high: int, low: int) -> None:
        if high:
            block[0] |= r.take(1) << low
            return
        c.last += r.extend(r.symbol(self.dc.get(c.dc)))
        block[0] = c.last << low

    def _ac_first(self, r: _Reader, c: _Component, block: list[int], start: int, end: int, low: int) -> None:
        if self.eob_run:
            self.eob_run -= 1
            return
        table, k = self.ac.get(c.ac), start
        while k <= end:
            s = r.symbol(table)
            run, size = s >> 4, s & 15
            if not size:
                if run < 15:
                    self.eob_run = (1 << run) + r.take(run) - 1
                    return
                k += 16
                continue
            k += run
            block[k] = r.extend(size) * (1 << low)
            k += 1

    def _ac_refine(self, r: _Reader, c: _Component, block: list[int], start: int, end: int, low: int) -> None:
        table, k, one = self.ac.get(c.ac), start, 1 << low

        def correct(i: int) -> None:
            if r.take(1) and not abs(block[i]) & one:
                block[i] += one if block[i] > 0 else -one

        if not self.eob_run:
            while k <= end:
                s = r.symbol(table)
                run, size = s >> 4, s & 15
                value = 0
                if size:
                    value = one if r.take(1) else -one
                elif run < 15:
                    self.eob_run = (1 << run) + r.take(run)
                    break
                while k <= end:
                    if block[k]:
                        correct(k)
                    elif run:
                        run -= 1
                    else:
                        break
                    k += 1
                if value and k <= end:
                    block[k] = value
                k += 1
        if self.eob_run:
            while k <= end:
                if block[k]:
                    correct(k)
                k += 1
            self.eob_run -= 1

    def samples(self) -> np.ndarray:
        """All components (height, width, n)."""
        if not self.components:
            raise CodecError("a JPEG stream without a frame")
        planes = []
        for c in self.components:
            if c.table not in self.q:
                raise CodecError("a JPEG quantisation table is missing")
            blocks = np.zeros((len(c.blocks), 64))
            blocks[:, ZIGZAG] = np.array(c.blocks, float)
            out = inverse((blocks * self.q[c.table]).reshape(-1, 8, 8))
            out = np.clip(np.floor(out + 128.5), 0, 255).astype(np.uint8).reshape(c.down, c.across, 8, 8).transpose(0, 2, 1, 3).reshape(c.down * 8, c.across * 8)
            out = np.repeat(np.repeat(out, self.vmax // c.v, 0), self.hmax // c.h, 1)
            planes.append(out[: self.height, : self.width])
        return np.stack(planes, -1)


def decode(data: bytes, tables: bytes = b"") -> np.ndarray:
    """Samples (height, width, components) of a stream, with tables that came apart from it."""
    d = Decoder()
    if tables:
        d.read(tables)
    d.read(data)
    return d.samples()


def transcode(data: bytes, tables: bytes = b"") -> bytes:
    """The same coefficients as a baseline stream with optimal codes, without loss: from a progressive stream, one with tables apart or poor codes. Saved segments go along."""
    d = Decoder()
    if tables:
        d.read(tables)
    d.read(data)
    if not d.components:
        raise CodecError("a JPEG stream without a frame")
    grids = [(np.array(c.blocks).reshape(c.down, c.across, 64), c.h, c.v) for c in d.components]
    if len(grids) == 1:  # a scan of one component has its own blocks only, one in a unit
        down, across = -(-d.height // 8), -(-d.width // 8)
        grids = [(grids[0][0][:down, :across], 1, 1)]
    return _stream(grids, {c.table: d.q[c.table] for c in d.components}, [c.table for c in d.components], d.height, d.width, d.saved)


def markers(data: bytes) -> list[tuple[int, bytes]]:
    """The application and comment segments of a stream: (marker, body)."""
    d = Decoder()
    d.read(data)
    return d.saved


def code_lengths(counts: dict[int, int], longest: int = 16) -> dict[int, int]:
    """Lengths of a Huffman code for counted symbols, none of over `longest` bits and none of ones only."""
    heap = [(n, s, (s,)) for s, n in sorted(counts.items()) if n] + [(0, 256, (256,))]  # 256 keeps the last code free
    heapq.heapify(heap)
    length = Counter()
    tie = 257
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        length.update(x + y)
        heapq.heappush(heap, (a + b, tie, x + y))
        tie += 1
    by_length = Counter(length.values())
    for k in range(max(by_length, default=1), longest, -1):  # two codes too long give one bit less and one code above a shorter one
        while by_length[k] > 0:
            j = k - 2
            while not by_length[j]:
                j -= 1
            by_length[k] -= 2
            by_length[k - 1] += 1
            by_length[j + 1] += 2
            by_length[j] -= 1
    order = sorted(length, key=lambda s: (s == 256, length[s], -counts.get(s, 0), s))  # the rarest of a length get the longer codes
    out, i = {}, 0
    for k in range(1, longest + 1):
        for _ in range(by_length[k]):
            out[order[i]] = k
            i += 1
    out.pop(256, None)
    return out


def _table(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The table as it stands in a stream, and code and length of each symbol."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(v == k for v in lengths.values()) for k in range(1, 17)]
    codes, code, last = {}, 0, 0
    for s in symbols:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = code, last
        code += 1
    return bytes(counts) + bytes(symbols), codes


def _symbols(block: list[int], before: int) -> list[tuple[int, int, int, int]]:
    """(class, symbol, bits, number of bits) of a quantised block in zigzag order."""
    def bits(v: int) -> tuple[int, int]:
        n = abs(v).bit_length()
        return n, v if v >= 0 else v + (1 << n) - 1

    n, b = bits(block[0] - before)
    out, run = [(0, n, b, n)], 0
    last = max((k for k in range(1, 64) if block[k]), default=0)
    for k in range(1, last + 1):
        if not block[k]:
            run += 1
            continue
        while run > 15:
            out.append((1, 0xF0, 0, 0))
            run -= 16
        n, b = bits(block[k])
        out.append((1, run << 4 | n, b, n))
        run = 0
    if last < 63:
        out.append((1, 0, 0, 0))
    return out


def encode(a: np.ndarray, quality: int = 75, subsampling: tuple[int, int] = (1, 1), chroma: bool | None = None) -> bytes:
    """A baseline stream of (height, width, components). With subsampling, components after the first are averaged over h x v samples."""
    h, w, n = a.shape
    chroma = n == 3 if chroma is None else chroma
    hs, vs = subsampling if n == 3 else (1, 1)
    tables = [quality_table(LUMA, quality)] + ([quality_table(CHROMA, quality)] if chroma else [])
    mx, my = -(-w // (8 * hs)), -(-h // (8 * vs))
    full = np.pad(a.astype(float), ((0, my * 8 * vs - h), (0, mx * 8 * hs - w), (0, 0)), mode="edge")
    grids = []
    for i in range(n):
        plane = full[..., i]
        ch, cv = (hs, vs) if i == 0 else (1, 1)
        if i and (hs, vs) != (1, 1):
            plane = np.floor(plane.reshape(my * 8, vs, mx * 8, hs).mean((1, 3)) + 0.5)
        blocks = plane.reshape(my * cv, 8, mx * ch, 8).transpose(0, 2, 1, 3) - 128
        q = tables[1 if i and chroma else 0].reshape(8, 8)
        grids.append((np.rint(forward(blocks) / q).astype(int).reshape(my * cv, mx * ch, 64)[..., ZIGZAG], ch, cv))
    return _stream(grids, {i: q for i, q in enumerate(tables)}, [1 if i and chroma else 0 for i in range(n)], h, w)


def _stream(grids: list[tuple[np.ndarray, int, int]], tables: dict[int, np.ndarray], table_of: list[int], h: int, w: int, saved: list[tuple[int, bytes]] | None = None) -> bytes:
    """A baseline stream, with optimal codes, of the components' quantised blocks (down, across, 64 in zigzag order) and their blocks across and down in a unit."""
    n = len(grids)
    coded = [min(k, 1) for k in range(n)] if len(tables) > 1 else [0] * n  # one pair of codes for the first component, one for the others
    my, mx = grids[0][0].shape[0] // grids[0][2], grids[0][0].shape[1] // grids[0][1]
    stream, counts, last = [], [[Counter(), Counter()] for _ in range(max(coded) + 1)], [0] * n
    for y in range(my):
        for x in range(mx):
            for i, (grid, ch, cv) in enumerate(grids):
                k = coded[i]
                for v in range(cv):
                    for u in range(ch):
                        block = grid[y * cv + v, x * ch + u].tolist()
                        for kind, s, b, size in _symbols(block, last[i]):
                            counts[k][kind][s] += 1
                            stream.append((k, kind, s, b, size))
                        last[i] = block[0]
    made = [[_table(code_lengths(c)) for c in pair] for pair in counts]
    out = bytearray(b"\xff\xd8")

    def segment(mark: int, body: bytes) -> None:
        out.extend(struct.pack(">BBH", 255, mark, len(body) + 2) + body)

    for mark, own in saved or []:
        segment(mark, own)
    for i, q in tables.items():
        wide = q.max() > 255
        segment(0xDB, bytes((wide << 4 | i,)) + (q[ZIGZAG].astype(">u2").tobytes() if wide else bytes(q[ZIGZAG].astype(int).tolist())))
    segment(0xC0, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes((i + 1, ch << 4 | cv, table_of[i])) for i, (_, ch, cv) in enumerate(grids)))
    for i, pair in enumerate(made):
        for kind, (body, _) in enumerate(pair):
            segment(0xC4, bytes((kind << 4 | i,)) + body)
    segment(0xDA, bytes((n,)) + b"".join(bytes((i + 1, 0x11 * coded[i])) for i in range(n)) + b"\0\x3f\0")
    bits, held, body = 0, 0, bytearray()
    for k, kind, s, b, size in stream:
        code, length = made[k][kind][1][s]
        bits = (bits << length | code) << size | b
        held += length + size
        while held >= 8:
            held -= 8
            body.append(bits >> held & 255)
        bits &= (1 << held) - 1
    if held:
        body.append((bits << (8 - held) | (1 << (8 - held)) - 1) & 255)
    return bytes(out + body.replace(b"\xff", b"\xff\0") + b"\xff\xd9")


def _decode_chunk(data: bytes, size: int, p: Parameters) -> bytes:
    a = decode(data, p.tables)
    out = np.zeros((p.height, p.width, p.samples), np.uint8)
    h, w, n = min(p.height, a.shape[0]), min(p.width, a.shape[1]), min(p.samples, a.shape[2])
    out[:h, :w, :n] = a[:h, :w, :n]
    return sized(out.tobytes(), size)


def _decode_old_chunk(data: bytes, size: int, p: Parameters) -> bytes:
    """A chunk that is a whole stream, or the bare data of a scan whose tables came apart from it and whose frame follows from the image."""
    if data[:2] != b"\xff\xd8":
        n = p.samples
        h, v = p.subsampling if n == 3 else (1, 1)
        frame = struct.pack(">BHHB", 8, p.height, p.width, n) + b"".join(bytes((i + 1, (h << 4 | v) if i == 0 else 0x11, i)) for i in range(n))
        scan = bytes((n,)) + b"".join(bytes((i + 1, i << 4 | i)) for i in range(n)) + b"\0\x3f\0"
        head = b"".join(struct.pack(">BBH", 255, mark, len(body) + 2) + body for mark, body in ((0xC0, frame), (0xDA, scan)))
        data = b"\xff\xd8" + head + data + b"\xff\xd9"
    return _decode_chunk(data, size, p)


def _encode_chunk(data: bytes, p: Parameters) -> bytes:
    if p.bits != 8:
        raise CodecError("JPEG takes samples of 8 bits")
    a = np.frombuffer(data, np.uint8).reshape(-1, p.width, p.samples)
    return encode(a, p.quality, tuple(p.subsampling) if p.photometric == 6 else (1, 1), p.photometric == 6)


_BUILT_IN[JPEG] = (_decode_chunk, _encode_chunk)
_BUILT_IN[OLD_JPEG] = (_decode_old_chunk, None)
