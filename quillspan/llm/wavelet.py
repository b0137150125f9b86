"""Token ids as wavelet matrices: one succinct, compressed file a shard.

A shard holds the ids of a range of documents. Bit planes run from the highest bit to the lowest; each plane keeps the
ids stably partitioned by the bits before it. A plane is cut into blocks of ``BLOCK`` bits, each compressed by itself, and
its directory, which the file holds uncompressed, tells for each block where its bytes end and how many ones come before
it. Rank takes a directory entry and one block, select a binary search of the directory and one block, so ``access``,
``count`` and ``positions`` take a step a plane and inflate only the blocks they touch; ``ids`` alone reads all of them.
The header holds document lengths, so the file stands alone.

An empty shard has no blocks. Positions outside the shard raise IndexError; ids that the shard doesn't hold count 0.
"""

from __future__ import annotations

import struct
from collections import OrderedDict

import numpy as np
import zstandard

MAGIC = b"QSWM2\0"
BLOCK = 1 << 15
#: inflated blocks a plane keeps
KEPT = 8


class Plane:
    """A bit vector in compressed blocks, with a directory of ranks."""

    def __init__(self, n: int, ones: np.ndarray, ends: np.ndarray, data: bytes | memoryview):
        self.n, self.ones, self.ends, self.data = n, ones, ends, data
        self.zeros = n - int(ones[-1])
        self.inflated = 0
        self._kept: OrderedDict[int, np.ndarray] = OrderedDict()
        self._open = zstandard.ZstdDecompressor().decompress

    @classmethod
    def of(cls, bits: np.ndarray) -> "Plane":
        packed = np.packbits(bits)
        size, blocks, ends, pack = BLOCK // 8, [], [0], zstandard.ZstdCompressor(level=1).compress
        for at in range(0, len(packed), size):
            blocks.append(pack(packed[at : at + size]))
            ends.append(ends[-1] + len(blocks[-1]))
        starts = np.arange(0, len(packed), size)
        each = np.add.reduceat(np.bitwise_count(packed).astype(np.int64), starts) if len(packed) else np.empty(0, np.int64)
        return cls(len(bits), np.concatenate([[0], np.cumsum(each)]).astype("<i8"), np.array(ends, "<i8"), b"".join(blocks))

    def _raw(self, k: int) -> bytes:
        self.inflated += 1
        return self._open(self.data[int(self.ends[k]) : int(self.ends[k + 1])])

    def block(self, k: int) -> np.ndarray:
        """Packed bits of one block."""
        got = self._kept.pop(k, None)
        if got is None:
            got = np.frombuffer(self._raw(k), np.uint8)
            if len(self._kept) >= KEPT:
                self._kept.popitem(last=False)
        self._kept[k] = got
        return got

    def bits(self) -> np.ndarray:
        """The whole plane, for reading all ids."""
        raw = b"".join(self._raw(k) for k in range(len(self.ends) - 1))
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n).astype(bool)

    def bit(self, i: int) -> bool:
        k, j = divmod(i, BLOCK)
        return bool(self.block(k)[j >> 3] >> (7 - (j & 7)) & 1)

    def rank(self, i: int) -> int:
        """Ones before position i."""
        k, j = divmod(i, BLOCK)
        if not j:
            return int(self.ones[k])
        block = self.block(k)
        part = int(block[j >> 3]) >> (8 - (j & 7)) if j & 7 else 0
        return int(self.ones[k]) + int(np.bitwise_count(block[: j >> 3]).sum()) + part.bit_count()

    def select(self, at: np.ndarray, one: bool) -> np.ndarray:
        """Positions of the ones (or zeros) of the given numbers, which ascend."""
        before = self.ones if one else np.minimum(np.arange(len(self.ones)) * BLOCK, self.n) - self.ones
        of = np.searchsorted(before, at, "right") - 1
        out = np.empty(len(at), np.int64)
        for k in np.unique(of).tolist():
            lo, hi = np.searchsorted(of, [k, k + 1])
            bits = np.unpackbits(self.block(k), count=min(BLOCK, self.n - k * BLOCK))
            out[lo:hi] = np.flatnonzero(bits == one)[at[lo:hi] - before[k]] + k * BLOCK
        return out


class WaveletMatrix:
    def __init__(self, n: int, planes: list[Plane]):
        self.n, self.planes, self.bits = n, planes, len(planes)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> "WaveletMatrix":
        ids = np.asarray(ids, dtype=np.uint32)
        bits = bits or max(1, int(ids.max(initial=0)).bit_length())
        cur = ids.astype(np.uint16) if bits <= 16 else ids
        planes = []
        for b in range(bits - 1, -1, -1):
            bit = (cur & cur.dtype.type(1 << b)) != 0
            planes.append(Plane.of(bit))
            if b:
                # far quicker than indexing by booleans
                cur = np.concatenate([np.compress(~bit, cur), np.compress(bit, cur)])
        return cls(len(ids), planes)

    def ids(self) -> np.ndarray:
        """All ids, from the lowest plane up: each plane's partition undone."""
        cur = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            bit, z = self.planes[level].bits(), self.planes[level].zeros
            up = np.empty_like(cur)
            up[np.flatnonzero(~bit)] = cur[:z]
            up[np.flatnonzero(bit)] = cur[z:] | cur.dtype.type(1 << (self.bits - 1 - level))
            cur = up
        return cur.astype(np.uint32)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for p in self.planes:
            bit, ones = p.bit(i), p.rank(i)
            out = out << 1 | bit
            i = p.zeros + ones if bit else i - ones
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token < 0 or token >> self.bits:
            return 0, 0
        for level, p in enumerate(self.planes):
            a, b = p.rank(lo), p.rank(hi)
            if token >> (self.bits - 1 - level) & 1:
                lo, hi = p.zeros + a, p.zeros + b
            else:
                lo, hi = lo - a, hi - b
            if lo == hi:
                break
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of token in [lo, hi)."""
        hi = self.n if hi is None else hi
        if not 0 <= lo <= hi <= self.n:
            raise IndexError((lo, hi))
        lo, hi = self._range(token, lo, hi)
        return hi - lo

    def positions(self, token: int) -> np.ndarray:
        """All positions of token, ascending: select, plane by plane upwards."""
        lo, hi = self._range(token, 0, self.n)
        at = np.arange(lo, hi, dtype=np.int64)
        for level in range(self.bits - 1, -1, -1):
            p, one = self.planes[level], bool(token >> (self.bits - 1 - level) & 1)
            at = p.select(at - p.zeros if one else at, one)
        return at


def dumps(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file: magic, header, document lengths, directories, planes."""
    m = WaveletMatrix.build(ids)
    lens = zstandard.ZstdCompressor(level=1).compress(np.asarray(lengths, np.int64).tobytes())
    head = struct.pack("<QQII", m.n, len(lengths), m.bits, len(lens))
    return b"".join([MAGIC, head, lens, *(x.tobytes() for p in m.planes for x in (p.ones, p.ends)), *(p.data for p in m.planes)])


def loads(data: bytes) -> tuple[WaveletMatrix, np.ndarray]:
    """The matrix over the file's own bytes, nothing inflated but the document lengths."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a wavelet shard")
    view, at = memoryview(data), len(MAGIC)
    n, docs, bits, n_lens = struct.unpack_from("<QQII", data, at)
    at += struct.calcsize("<QQII")
    lengths = np.frombuffer(zstandard.ZstdDecompressor().decompress(view[at : at + n_lens]), np.int64)
    if len(lengths) != docs:
        raise ValueError("a wavelet shard whose lengths don't match its header")
    at += n_lens
    entries, found = -(-n // BLOCK) + 1, []
    for _ in range(bits):
        ones, ends = (np.frombuffer(view[at + i * 8 * entries : at + (i + 1) * 8 * entries], "<i8") for i in (0, 1))
        found.append((ones, ends))
        at += 16 * entries
    planes = []
    for ones, ends in found:
        planes.append(Plane(n, ones, ends, view[at : at + int(ends[-1])]))
        at += int(ends[-1])
    return WaveletMatrix(n, planes), lengths
