"""Files of any size as byte sequences of which only what is asked for is read."""

from __future__ import annotations

from collections import OrderedDict

#: Bytes of a block, and blocks that are kept.
BLOCK, KEPT = 1 << 16, 32


class RangedFile:
    """Slices of a file that can be read at any place (as pyarrow's input files); small ones come from blocks that are kept, long ones are read as they are."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.blocks: OrderedDict[int, bytes] = OrderedDict()
        self.read = 0

    def __len__(self) -> int:
        return self.size

    def _at(self, start: int, n: int) -> bytes:
        self.read += n
        return bytes(self.file.read_at(n, start)) if n else b""

    def __getitem__(self, place: slice) -> bytes:
        start, stop, step = place.indices(self.size)
        if step != 1:
            raise ValueError("a file is read in one direction")
        if stop - start > BLOCK:
            return self._at(start, stop - start)
        out = []
        while start < stop:
            k = start // BLOCK
            block = self.blocks.get(k)
            if block is None:
                block = self.blocks[k] = self._at(k * BLOCK, min(BLOCK, self.size - k * BLOCK))
                if len(self.blocks) > KEPT:
                    self.blocks.popitem(last=False)
            else:
                self.blocks.move_to_end(k)
            end = min(stop, (k + 1) * BLOCK)
            out.append(block[start - k * BLOCK : end - k * BLOCK])
            start = end
        return b"".join(out)
