"""Wavelet matrix over integer codes: one bit-plane a level, with rank and select, in numpy."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC = b"PLWM0001"


class BitPlane:
    """Bits in 64-bit words with a rank directory of one count a word."""

    __slots__ = ("count", "n", "ones", "words", "zeros")

    def __init__(self, words: np.ndarray, n: int):
        self.words, self.n = words, n
        self.count = np.zeros(len(words) + 1, np.uint32)
        np.cumsum(np.bitwise_count(words), dtype=np.uint32, out=self.count[1:])
        self.ones = int(self.count[-1])
        self.zeros = n - self.ones

    @classmethod
    def of(cls, bits: np.ndarray) -> BitPlane:
        packed = np.packbits(bits, bitorder="little")
        whole = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        whole[: len(packed)] = packed
        return cls(whole.view("<u8"), len(bits))

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little").view(bool)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.count[w] + np.bitwise_count(self.words[w] & below).astype(np.int64)

    def select(self, bit: bool, k: np.ndarray) -> np.ndarray:
        """Position of the k-th (from 0) bit of this kind."""
        k = np.asarray(k, np.int64)
        lo, hi = np.zeros_like(k), np.full_like(k, self.n)
        while (wide := lo < hi).any():  # ranks are monotone: binary search
            mid = (lo + hi) >> 1
            ones = self.rank1(np.minimum(mid + 1, self.n))
            have = ones if bit else np.minimum(mid + 1, self.n) - ones
            up = have <= k
            lo, hi = np.where(wide & up, mid + 1, lo), np.where(wide & ~up, mid, hi)
        return lo


class WaveletMatrix:
    """Sequence of codes below 2**levels: access, rank, select and counting without unpacking the sequence."""

    def __init__(self, planes: list[BitPlane], n: int):
        self.planes, self.n, self.levels = planes, n, len(planes)

    @classmethod
    def build(cls, codes: np.ndarray, levels: int) -> WaveletMatrix:
        seq, planes = np.asarray(codes), []
        for level in range(levels - 1, -1, -1):
            bits = (seq & seq.dtype.type(1 << level)) != 0
            planes.append(BitPlane.of(bits))
            seq = np.concatenate((seq[np.flatnonzero(~bits)], seq[np.flatnonzero(bits)]))
        return cls(planes, len(codes))

    def decode(self) -> np.ndarray:
        """The whole sequence: the stable partitions, undone from the last plane to the first."""
        values = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level, plane in enumerate(reversed(self.planes)):
            bits, out = plane.bits(), np.empty_like(values)
            out[np.flatnonzero(~bits)] = values[: plane.zeros]
            out[np.flatnonzero(bits)] = values[plane.zeros :] | values.dtype.type(1 << level)
            values = out
        return values

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.array(i, np.int64)
        out = np.zeros(i.shape, np.int64)
        for plane in self.planes:
            bit, ones = plane.get(i), plane.rank1(i)
            out = out << 1 | bit
            i = np.where(bit, plane.zeros + ones, i - ones)
        return out

    def span(self, code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where positions lo and hi of each code's occurrences come to lie below the last plane."""
        code, lo, hi = np.asarray(code, np.int64), np.asarray(lo, np.int64), np.asarray(hi, np.int64)
        for level, plane in zip(range(self.levels - 1, -1, -1), self.planes, strict=True):
            bit = (code >> level & 1).astype(bool)
            a, b = plane.rank1(lo), plane.rank1(hi)
            lo, hi = np.where(bit, plane.zeros + a, lo - a), np.where(bit, plane.zeros + b, hi - b)
        return lo, hi

    def rank(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each code before each position."""
        lo, hi = self.span(code, np.zeros_like(np.asarray(i, np.int64)), i)
        return hi - lo

    def count(self, code: int) -> int:
        return int(self.rank(np.array([code]), np.array([self.n]))[0])

    def select(self, code: int, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th (from 0) occurrences of one code; each k must be below its count."""
        start, _ = self.span(np.array([code]), np.array([0]), np.array([self.n]))
        at = start[0] + np.asarray(k, np.int64)
        for level, plane in enumerate(reversed(self.planes)):
            bit = bool(code >> level & 1)
            at = plane.select(bit, at - plane.zeros if bit else at)
        return at


def packed(arrays: dict[str, np.ndarray], planes: WaveletMatrix, level: int = 1) -> bytes:
    """One file: magic, entry count, then name, dtype, length and zstd bytes of each entry; planes come last."""
    press = zstandard.ZstdCompressor(level=level)
    entries = [(k, v) for k, v in arrays.items()] + [(f"plane{i}", p.words) for i, p in enumerate(planes.planes)]
    out = [MAGIC, struct.pack("<qii", planes.n, planes.levels, len(entries))]
    for name, values in entries:
        data = press.compress(np.ascontiguousarray(values).tobytes())
        out.append(struct.pack("<16s8sqq", name.encode(), values.dtype.str.encode(), len(values), len(data)) + data)
    return b"".join(out)


def unpacked(data: bytes) -> tuple[dict[str, np.ndarray], WaveletMatrix]:
    if data[:8] != MAGIC:
        raise ValueError("not a wavelet shard file")
    n, levels, count = struct.unpack_from("<qii", data, 8)
    at, found = 24, {}
    for _ in range(count):
        name, kind, length, size = struct.unpack_from("<16s8sqq", data, at)
        at += struct.calcsize("<16s8sqq")
        raw = zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=max(1, length * 8))
        found[name.rstrip(b"\0").decode()] = np.frombuffer(raw, kind.rstrip(b"\0").decode())
        at += size
    planes = [BitPlane(found.pop(f"plane{i}"), n) for i in range(levels)]
    return found, WaveletMatrix(planes, n)
