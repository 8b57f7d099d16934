"""Hashes of words, bytes and windows over Arrow string columns, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_STEP = 0xD1342543DE82EF95 | 1

_seed = np.random.Generator(np.random.PCG64(20240517))
BYTE_VALUES = _seed.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 1, base & _MASK, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Tables:
    """Powers of the base and of its inverse, built once in a process."""

    up: np.ndarray | None = None
    down: np.ndarray | None = None

    @classmethod
    def get(cls) -> tuple[np.ndarray, np.ndarray]:
        if cls.up is None:
            cls.up, cls.down = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
        return cls.up, cls.down


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 bits of the output."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its rows; a null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    bounds = np.frombuffer(buffers[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(bounds: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row stands alone."""
    first, rows = 0, len(bounds) - 1
    while first < rows:
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = max(last, first + 1)
        yield first, last
        first = last


def words_of(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word, and the number of words before each row (rows + 1 values)."""
    blank = np.ones(len(data) + 2, dtype=bool)
    blank[1:-1] = SPACE[data]
    begins = blank[:-1] & ~blank[1:]
    ends = ~blank[:-1] & blank[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    cut = inner[~blank[inner] & ~blank[inner + 1]]
    begins[cut], ends[cut] = True, True
    start, end = np.flatnonzero(begins[:-1] if len(data) else begins[:0]), np.flatnonzero(ends)
    source = LOWER[data] if lower else data
    return start, end, _span_hashes(source, start, end), np.searchsorted(start, bounds)


def _span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _Tables.get()
    out = np.empty(len(start), dtype=np.uint64)
    first = 0
    while first < len(start):
        origin = int(start[first])
        last = int(np.searchsorted(end, origin + BLOCK, side="right"))
        if last > first:
            part = BYTE_VALUES[data[origin : int(end[last - 1])]]
            part *= up[: len(part)]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(part, out=sums[1:])
            s = start[first:last] - origin
            out[first:last] = (sums[end[first:last] - origin] - sums[s]) * down[s]
            first = last
        else:  # one word longer than a block
            total, at, stop = 0, origin, int(end[first])
            while at < stop:
                part = BYTE_VALUES[data[at : min(at + BLOCK, stop)]]
                total += int((part * up[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, at - origin, 1 << 64)
                at += BLOCK
            out[first] = total & _MASK
            first += 1
    return mixed(out ^ (end - start).astype(np.uint64))


class Places:
    """A number for each 64-bit key, looked up for whole arrays (open addressing, at most half full)."""

    def __init__(self) -> None:
        self.count = 0
        self._make(10)

    def _make(self, bits: int) -> None:
        self.bits, self.keys, self.values = bits, np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Takes distinct keys that are not there yet, and numbers from 0 to 2^31 - 1."""
        self.count += len(keys)
        if 2 * self.count > len(self.keys):
            there = self.values >= 0
            keys, values = np.append(self.keys[there], keys), np.append(self.values[there], values)
            self._make((2 * self.count - 1).bit_length())
        slot, last = self._slots(keys), len(self.keys) - 1
        while len(slot):
            free = self.values[slot] < 0
            self.keys[slot[free]], self.values[slot[free]] = keys[free], values[free]
            left = (self.values[slot] != values) | (self.keys[slot] != keys)
            slot, keys, values = (slot[left] + 1) & last, keys[left], values[left]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for what is not there."""
        slot = self._slots(keys)
        out = self.values[slot]
        wrong = np.flatnonzero((self.keys[slot] != keys) & (out >= 0))
        slot = slot[wrong]
        while len(wrong):
            slot = (slot + 1) & (len(self.keys) - 1)
            out[wrong] = self.values[slot]
            left = (self.keys[slot] != keys[wrong]) & (out[wrong] >= 0)
            wrong, slot = wrong[left], slot[left]
        return out


def window_hashes(values: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the runs of ``n`` consecutive values (those that start ``at``, if given), by doubling: log n passes."""
    if len(values) < n:
        return np.zeros(0, dtype=np.uint64)
    out, done, power, length, rest = None, 0, values, 1, n
    while True:
        if rest & 1:
            part = power[done + at] if at is not None else power[done : done + len(values) - n + 1]
            out = part if out is None else out * np.uint64(pow(_STEP, length, 1 << 64)) + part
            done += length
        rest >>= 1
        if not rest:
            return mixed(out)
        power = power[: len(power) - length] * np.uint64(pow(_STEP, length, 1 << 64)) + power[length:]
        length *= 2


def split_bytes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, byte by byte: equal high bytes stand together for compression."""
    return values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def joined_bytes(data: bytes, width: int) -> np.ndarray:
    parts = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((parts.shape[1], 8), np.uint8)
    out[:, :width] = parts.T
    return out.view("<u8")[:, 0]


def packed_steps(values: np.ndarray) -> bytes:
    """Differences of neighbours, small ones as small numbers whatever their sign."""
    step = np.diff(values.astype(np.int64, copy=False), prepend=np.int64(0))
    return split_bytes(((step << 1) ^ (step >> 63)).view(np.uint64), 8)


def from_steps(data: bytes) -> np.ndarray:
    step = joined_bytes(data, 8)
    return np.cumsum((step >> np.uint64(1)).view(np.int64) ^ -(step & np.uint64(1)).view(np.int64))


def covered(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Mask of the places in a row of ``size`` that windows of ``width`` at ``starts`` cover."""
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, size), -1)
    return np.cumsum(edge)[:size] > 0
