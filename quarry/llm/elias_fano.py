"""Elias-Fano sequences over numpy arrays that can be memory-mapped."""

from __future__ import annotations

import json
import os

import numpy as np


#: The place of the n-th set bit of a byte.
NTH = np.zeros((256, 8), np.int64)
for _b in range(256):
    _set = [k for k in range(8) if _b >> k & 1]
    NTH[_b, : len(_set)] = _set


_1, _2, _3, _4, _5, _6 = (np.uint64(x) for x in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x0101010101010101, 0x8080808080808080, 0xFF))


def nth_bit(words: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The place of the set bit of each word that has so many set bits before it; 64 where there is none.

    Counts of the bytes are summed up, compared and looked up side by side within words.
    """
    u = np.uint64
    n = words - ((words >> u(1)) & _1)
    n = (n & _2) + ((n >> u(2)) & _2)
    n = ((n + (n >> u(4))) & _3) * _4  # in each byte, the set bits up to its end
    byte = np.bitwise_count(((left * _4) | _5) - n & _5).astype(np.uint64)
    none = byte > u(7)
    shift = np.minimum(byte, u(7)) << u(3)
    rest = left - (((n << u(8)) >> shift) & _6)
    at = NTH[((words >> shift) & _6).astype(np.int64), np.minimum(rest, u(7)).astype(np.int64)]
    return np.where(none, 64, shift.astype(np.int64) + at)


class Sequences:
    """Non-decreasing sequences end to end, each with its high parts in unary and its low parts packed to a fixed number of bits.

    The directories of set and unset bits run through all of them, so a search in many sequences takes one pass.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, low_at: np.ndarray, high_at: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> None:
        """low_at and high_at: where each begins, in bytes and in words; they end with where the last ends."""
        self.sizes, self.bits, self.low_at, self.high_at = (np.asarray(x, np.int64) for x in (sizes, bits, low_at, high_at))
        self.low, self.high, self.ones, self.zeros = map(np.asarray, (low, high, ones, zeros))  # plain views of mapped files
        self.rows = np.lib.stride_tricks.as_strided(self.low, (max(1, len(self.low) - 7), 8), (1, 1))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.masks = (1 << self.bits) - 1
        self.ones_at, self.zeros_at = (x[self.high_at[:-1]].astype(np.int64) for x in (self.ones, self.zeros))

    @classmethod
    def load(cls, path: str) -> Sequences:
        sizes, bits, low_at, high_at = np.load(f"{path}.of.npy")
        return cls(sizes[:-1], bits[:-1], low_at, high_at, *(np.load(f"{path}.{k}.npy", mmap_mode="r") for k in ("low", "high", "ones", "zeros")))

    def _lows(self, i: np.ndarray, bits: np.ndarray, first: np.ndarray, mask: np.ndarray) -> np.ndarray:
        at = i * bits + first
        word = np.ascontiguousarray(self.rows[at >> 3]).view(np.uint64).reshape(-1)
        return (word >> (at & 7).astype(np.uint64)).astype(np.int64) & mask

    def _select(self, k: np.ndarray, directory: np.ndarray, flip: bool) -> np.ndarray:
        w = np.searchsorted(directory, k.astype(directory.dtype), side="right") - 1
        words = self.high[np.minimum(w, len(self.high) - 1)]
        left = (k - directory[np.minimum(w, len(directory) - 1)].astype(np.int64)).astype(np.uint64)
        return w * 64 + nth_bit(~words if flip else words, left)

    def _zero(self, at: np.ndarray) -> np.ndarray:
        """The first unset bit from each place on; there is one."""
        w = at >> 6
        free = ~self.high[w] >> (at & 63).astype(np.uint64)
        out = at + np.bitwise_count((free & (~free + np.uint64(1))) - np.uint64(1))
        far = np.flatnonzero(free == 0)
        if len(far):
            out[far] = self._select(self.zeros[w[far] + 1].astype(np.int64), self.zeros, True)
        return out

    def access(self, i: np.ndarray, s: np.ndarray) -> np.ndarray:
        """The values at places i of sequences s."""
        part = self._select(i + self.ones_at[s], self.ones, False) - self.high_at[s] * 64 - i
        return (part << self.bits[s]) | self._lows(i, self.bits[s], self.low_at[s] * 8, self.masks[s])

    def find(self, x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where x would stand in sequences s: the first place whose value is x or more, and whether it is x."""
        bits, first, mask, size = self.bits[s], self.low_at[s] * 8, self.masks[s], self.sizes[s]
        part, low = x >> bits, x & mask
        begin = self.high_at[s] * 64
        most = self.high_at[s + 1] * 64 - begin - size  # zeros in all
        over = part >= most
        p = np.where(over, 0, part)
        later = p > 0
        at = np.where(later, self._select(p + self.zeros_at[s] - later, self.zeros, True) + 1, begin)  # behind the zero before, or the begin
        a = at - begin - p
        b = self._zero(at) - begin - p
        a, end = np.minimum(a, size), np.minimum(b, size)
        lo, hi = a.copy(), end.copy()
        live = np.flatnonzero(lo < hi)
        own = [v[live] for v in (bits, first, mask, low)]
        while len(live):
            at, till = lo[live], hi[live]
            mid = (at + till) >> 1
            less = self._lows(mid, *own[:3]) < own[3]
            lo[live] = at = np.where(less, mid + 1, at)
            hi[live] = till = np.where(less, till, mid)
            more = at < till
            live = live[more]
            own = [v[more] for v in own]
        hit = (lo < end) & ~over
        hit[hit] = self._lows(lo[hit], bits[hit], first[hit], mask[hit]) == low[hit]
        return np.where(over, size, lo), hit


class EliasFano(Sequences):
    """One sequence."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> None:
        self.n = n
        super().__init__([n], [bits], [0, len(low)], [0, len(high)], low, high, ones, zeros)

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = values.astype(np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        bits = min(48, max(0, (top // n).bit_length() - 1)) if n else 0
        parts = v >> np.uint64(bits)
        packed = []
        if bits:
            step = 1 << 15  # a multiple of 8: parts end at whole bytes
            for a in range(0, n, step):
                x = v[a : a + step].astype("<u8").view(np.uint8).reshape(-1, 8)
                packed.append(np.packbits(np.unpackbits(x, axis=1, count=bits, bitorder="little"), bitorder="little"))
        low = np.concatenate([*packed, np.zeros(8, np.uint8)])
        size = n + (int(parts[-1]) if n else 0) + 1
        marks = np.zeros((size + 63) // 64 * 64, np.uint8)
        marks[parts.astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(marks, bitorder="little").view(np.uint64)
        ones = np.r_[0, np.cumsum(np.bitwise_count(high), dtype=np.int64)].astype(np.uint32 if n < 1 << 31 else np.uint64)
        zeros = (np.arange(len(ones), dtype=np.int64) * 64 - ones.astype(np.int64)).astype(ones.dtype if size < 1 << 32 else np.uint64)
        return cls(n, bits, low, high, ones, zeros)

    def save(self, path: str) -> None:
        """Writes path.*; the last file is renamed into place, so that a repeated task leaves whole files."""
        for k in ("low", "high", "ones", "zeros"):
            save_array(f"{path}.{k}.npy", getattr(self, k))
        tmp = f"{path}.json.{os.getpid()}"
        with open(tmp, "w") as f:
            json.dump({"n": self.n, "bits": int(self.bits[0])}, f)
        os.replace(tmp, f"{path}.json")

    @classmethod
    def load(cls, path: str) -> EliasFano:
        with open(f"{path}.json") as f:
            meta = json.load(f)
        return cls(meta["n"], meta["bits"], *(np.load(f"{path}.{k}.npy", mmap_mode="r") for k in ("low", "high", "ones", "zeros")))

    def access(self, i: np.ndarray, s: np.ndarray | None = None) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return super().access(i, np.zeros(len(i), np.int64))

    def find(self, x: np.ndarray, s: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        x = np.asarray(x, np.int64)
        return super().find(x, np.zeros(len(x), np.int64))


def join_sequences(paths: list[str], path: str) -> None:
    """Puts saved sequences end to end; holds a part of one at a time."""
    metas = []
    for p in paths:
        with open(f"{p}.json") as f:
            metas.append(json.load(f))
    sizes = {k: join_arrays([f"{p}.{k}.npy" for p in paths], f"{path}.{k}.npy") for k in ("low", "high")}
    for k in ("ones", "zeros"):
        join_arrays([f"{p}.{k}.npy" for p in paths], f"{path}.{k}.npy", directory=True)
    low_at, high_at = (np.r_[0, np.cumsum(sizes[k])] for k in ("low", "high"))
    n, bits = (np.array([m[k] for m in metas] + [0]) for k in ("n", "bits"))
    save_array(f"{path}.of.npy", np.stack([n, bits, low_at, high_at]))


def join_arrays(paths: list[str], path: str, directory: bool = False) -> list[int]:
    """Puts saved arrays end to end and returns their lengths. Those of a directory of counts go on from one another."""
    parts = [np.load(p, mmap_mode="r") for p in paths]
    kind = parts[0].dtype
    if directory:
        ends = np.cumsum([int(p[-1]) for p in parts])
        kind = np.dtype(np.uint32 if ends[-1] < 1 << 32 else np.uint64)
    held = sum(map(len, parts)) - directory * (len(parts) - 1)
    tmp = f"{path}.{os.getpid()}"
    with open(tmp, "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": np.lib.format.dtype_to_descr(kind), "fortran_order": False, "shape": (held,)})
        for k, p in enumerate(parts):
            if directory:
                p = (p[: len(p) - (k < len(parts) - 1)].astype(np.uint64) + np.uint64(ends[k - 1] if k else 0)).astype(kind)
            f.write(memoryview(np.ascontiguousarray(p)).cast("B") if len(p) else b"")
    os.replace(tmp, path)
    return [len(p) for p in parts]


def save_array(path: str, a: np.ndarray) -> None:
    tmp = f"{path}.{os.getpid()}"
    with open(tmp, "wb") as f:
        np.save(f, a)
    os.replace(tmp, path)
