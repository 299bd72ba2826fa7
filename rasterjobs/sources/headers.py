"""The bytes of a file that its header needs, read where and when they are needed."""

from __future__ import annotations

import re

from pyarrow import fs

#: Bytes read at once; segments that are passed over are not read.
BLOCK = 1 << 14


class Lazy:
    """A file as bytes that are read block by block when they are indexed; ``read`` counts them."""

    def __init__(self, path: str, block: int = BLOCK):
        system, name = fs.FileSystem.from_uri(re.sub(r"^(file:)?/+", "file:///", path))
        self.file, self.block = system.open_input_file(name), block
        self.size, self.read = self.file.size(), 0
        self.start, self.held = 0, b""

    def __len__(self) -> int:
        return self.size

    def _hold(self, lo: int, hi: int) -> None:
        if not self.start <= lo <= hi <= self.start + len(self.held):
            n = min(max(hi - lo, self.block), self.size - lo)
            self.start, self.held = lo, self.file.read_at(n, lo)
            self.read += len(self.held)

    def __getitem__(self, at: int | slice):
        if isinstance(at, slice):
            lo, hi, _ = at.indices(self.size)
            if lo >= hi:
                return b""
            self._hold(lo, hi)
            return self.held[lo - self.start : hi - self.start]
        self._hold(at, at + 1)
        return self.held[at - self.start]

    def close(self) -> None:
        self.file.close()
