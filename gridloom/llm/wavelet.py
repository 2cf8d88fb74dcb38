"""A wavelet matrix over token ids: one packed bit plane per id bit, with rank directories.

Plane by plane from the highest bit, the sequence is stably parted into zeros then ones. Every operation walks the planes
once: access(i) reads a token, count(c) and rank(c, i) count occurrences, select(c, k) and positions(c) find them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bits between two entries of a rank directory.
STEP = 2048


def _packed(a: np.ndarray) -> bytes:
    return pa.Codec("zstd", 1).compress(a.tobytes(), asbytes=True)


def _unpacked(data: bytes, size: int, kind: str = "u1") -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(data, size, asbytes=True), kind)


def build(ids: np.ndarray, bits: int) -> tuple[list[bytes], list[bytes], list[int]]:
    """Compressed planes, compressed rank directories and each plane's number of zeros."""
    planes, ranks, zeros = [], [], []
    for k in range(bits - 1, -1, -1):
        one = (ids >> ids.dtype.type(k)).astype(np.uint8) & 1
        packed = np.packbits(one)
        low = len(ids) - int(np.bitwise_count(packed).sum())
        parted = np.empty_like(ids)
        np.compress(one == 0, ids, out=parted[:low])
        np.compress(one.view(bool), ids, out=parted[low:])
        ids = parted
        per = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), STEP // 8), dtype=np.uint32) if len(packed) else np.zeros(0, np.uint32)
        directory = np.zeros(len(per) + 1, "<u4")
        np.cumsum(per, out=directory[1:])
        planes.append(_packed(packed))
        ranks.append(_packed(directory))
        zeros.append(low)
    return planes, ranks, zeros


def decode(n: int, planes: list[bytes], zeros: list[int]) -> np.ndarray:
    """All ids in order: the partings undone from the lowest plane up."""
    bits = len(planes)
    out = np.zeros(n, np.uint16 if bits <= 16 else np.uint32)
    for k, (plane, z) in enumerate(zip(reversed(planes), reversed(zeros), strict=True)):
        one = np.unpackbits(_unpacked(plane, (n + 7) // 8), count=n)
        before = np.empty_like(out)
        before[np.flatnonzero(one == 0)] = out[:z]
        before[np.flatnonzero(one)] = out[z:] | out.dtype.type(1 << k)
        out = before
    return out


class WaveletMatrix:
    """Queries over one shard's planes without decoding its tokens."""

    def __init__(self, n: int, planes: list[bytes], ranks: list[bytes], zeros: list[int]):
        self.n, self.zeros, self.bits = n, zeros, len(planes)
        self.planes = [_unpacked(p, (n + 7) // 8) for p in planes]
        self.ranks = [_unpacked(r, 4 * (-(-n // STEP) + 1), "<u4") for r in ranks]

    def _bit(self, plane: int, i: int) -> int:
        return int(self.planes[plane][i >> 3]) >> (7 - (i & 7)) & 1

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits."""
        block, rest = divmod(i, STEP)
        part = self.planes[plane][block * STEP // 8 : (i + 7) // 8]
        total = int(self.ranks[plane][block])
        if rest:
            total += int(np.bitwise_count(part[: rest // 8]).sum())
            if rest & 7:
                total += int(part[rest // 8] >> (8 - (rest & 7))).bit_count()
        return total

    def _find(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of that kind: a binary search of the directory, then of the block."""
        steps = np.arange(len(self.ranks[plane])) * STEP
        ones = self.ranks[plane].astype(np.int64)
        seen = ones if bit else np.minimum(steps, self.n) - ones
        block = int(np.searchsorted(seen, k, "right")) - 1
        bits = np.unpackbits(self.planes[plane][block * STEP // 8 : (block + 1) * STEP // 8])[: self.n - block * STEP]
        return block * STEP + int(np.flatnonzero(bits == bit)[k - int(seen[block])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k in range(self.bits):
            bit, ones = self._bit(k, i), self._ones(k, i)
            out, i = out << 1 | bit, self.zeros[k] + ones if bit else i - ones
        return out

    def _range(self, token: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        if token < 0 or token >> self.bits:
            return 0, 0
        for k in range(self.bits):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token among the first i tokens."""
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of token."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for plane in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - plane) & 1
            at = self._find(plane, bit, at - self.zeros[plane] if bit else at)
        return at

    def positions(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]
