"""Numpy helpers on Arrow text buffers, used inside tasks.

A batch of texts is one byte array plus offsets; words, hashes and copies are made for the whole
batch at once, so that no step runs per row.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of the word operators: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"

_P1 = np.uint64(0x9E3779B97F4A7C15)
_P2 = np.uint64(0xBF58476D1CE4E5B9)
_P3 = np.uint64(0x94D049BB133111EB)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts as one array, and where each begins and ends; null is empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if not pa.types.is_large_string(values.type):
        values = values.cast(pa.large_string())
    if values.null_count:
        values = pc.fill_null(values, "")
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    if not len(values):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    raw = values.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def portions(batches: Iterator[pa.RecordBatch], name: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows again, in runs whose column `name` holds about `most` bytes (a longer text is alone)."""
    for batch in batches:
        values = column(batch, name)
        sizes = np.asarray(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False), np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(values):
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            upto = max(upto, at + 1)
            yield batch.slice(at, upto - at)
            at = upto
        del batch, values
        give_back()


def table(*chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    for c in chars:
        out[np.frombuffer(c, np.uint8)] = True
    return out


IS_SPACE = table(SPACES)


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside `gap`, and the number of the first word of each
    text (one more entry than texts)."""
    inside = ~gap[data]
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.empty(len(data) + 1, bool)
    edge[1:-1] = inside[1:] & ~inside[:-1]
    edge[0] = inside[0]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    edge[begins] = inside[begins]
    starts = np.flatnonzero(edge[:-1])
    last = np.empty(len(data), bool)
    last[:-1] = inside[:-1] & ~inside[1:]
    last[-1] = inside[-1]
    last[begins[1:] - 1] = inside[begins[1:] - 1]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes at a time for all spans together."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    left = ends - starts
    h = left.astype(np.uint64) * _P3 + _P1
    at, rows = starts, None
    while len(at):
        x = eight[at] & _MASK[np.minimum(left, 8)]
        x *= _P1
        x ^= h if rows is None else h[rows]
        x ^= x >> np.uint64(29)
        x *= _P2
        x ^= x >> np.uint64(32)
        if rows is None:
            h = x
        else:
            h[rows] = x
        more = np.flatnonzero(left > 8)
        rows = more if rows is None else rows[more]
        at, left = at[more] + 8, left[more] - 8
    return mix(h)


def mix(x: np.ndarray) -> np.ndarray:
    x = x * _P3
    x ^= x >> np.uint64(31)
    x *= _P1
    x ^= x >> np.uint64(30)
    return x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of every span, one span after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    if total < 2**31 and (not len(starts) or int(starts.max(initial=0)) < 2**31 - total - 1):
        return np.repeat((starts - before).astype(np.int32), lengths) + np.arange(total, dtype=np.int32)
    return np.repeat(starts - before, lengths) + np.arange(total)


def bounds(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def distinct_spans(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one of each distinct span, and for every span which of them it equals (exactly)."""
    lengths = ends - begins
    h = hash_spans(data, begins, ends)
    for _ in range(8):
        order = np.argsort(h)
        new = np.empty(len(h), bool)
        if len(h):
            new[0] = True
            np.not_equal(h[order[1:]], h[order[:-1]], out=new[1:])
        first = order[new]
        which = np.empty(len(h), np.int32)
        which[order] = np.cumsum(new) - 1
        if np.array_equal(lengths[first][which], lengths) and np.array_equal(data[ragged(begins[first][which], lengths)], data[ragged(begins, lengths)]):
            return first, which
        h = mix(h ^ hash_spans(data[::-1].copy(), len(data) - ends, len(data) - begins))
    raise RuntimeError("no collision-free hash of the spans of this batch")


class Growing:
    """An array that is appended to."""

    def __init__(self, kind: type, width: int = 0) -> None:
        self.n, self._all = 0, np.empty((1024, width) if width else 1024, kind)

    def append(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self._all):
            wider = np.empty((max(2 * len(self._all), self.n + len(more)), *self._all.shape[1:]), self._all.dtype)
            wider[: self.n] = self._all[: self.n]
            self._all = wider
        self._all[self.n : self.n + len(more)] = more
        self.n += len(more)

    @property
    def now(self) -> np.ndarray:
        return self._all[: self.n]


class Seen:
    """Numbers for the distinct byte strings that a worker has met: an open-addressed table by hash,
    and every hit is compared byte by byte."""

    def __init__(self, bits: int = 22) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.hash, self.number = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self.bytes, self.ends = Growing(np.uint8), Growing(np.int64)

    def __len__(self) -> int:
        return self.ends.n

    def _probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number at each hash or -1, and the slot where it is or could be."""
        slot = (h & self.mask).astype(np.int64)
        number = self.number[slot]
        wrong = np.flatnonzero((number >= 0) & (self.hash[slot] != h))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & int(self.mask)
            number[wrong] = self.number[slot[wrong]]
            wrong = wrong[(number[wrong] >= 0) & (self.hash[slot[wrong]] != h[wrong])]
        return number, slot

    def find(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each span, -1 if it is new."""
        number, _ = self._probe(hash_spans(data, begins, ends))
        if not len(self):
            return number
        hit = np.flatnonzero(number >= 0)
        own = number[hit]
        upto = self.ends.now
        start = np.where(own > 0, upto[own - 1], 0)
        size = ends[hit] - begins[hit]
        same = upto[own] - start == size
        number[hit[~same]] = -1
        hit, start, size = hit[same], start[same], size[same]
        wrong = self.bytes.now[ragged(start, size)] != data[ragged(begins[hit], size)]
        if wrong.any():
            number[np.repeat(hit, size)[wrong]] = -1
        return number

    def add(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        """Distinct new spans get the next numbers."""
        size, first = ends - begins, len(self)
        h = hash_spans(data, begins, ends)
        base = self.bytes.n
        self.bytes.append(data[ragged(begins, size)])
        self.ends.append(base + np.cumsum(size))
        left = np.arange(len(h))
        while len(left):
            number, slot = self._probe(h[left])
            free = number < 0  # an equal hash of other bytes is left out, and so always new
            left, slot = left[free], slot[free]
            _, one = np.unique(slot, return_index=True)
            self.hash[slot[one]], self.number[slot[one]] = h[left[one]], first + left[one]
            left = np.delete(left, one)


_HELD: dict = {}
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018  other systems have none
except (OSError, AttributeError):
    _LIBC = None


def held(name: tuple, make):
    """What this Python worker keeps from task to task under a name: one thing at a time, so that the
    caches of one operator do not stay while another runs in the same worker."""
    if name not in _HELD:
        _HELD.clear()
        trim()
        _HELD[name] = make()
    return _HELD[name]


def alone(name: str) -> None:
    """Drops what other operators have kept in this Python worker."""
    held((name,), tuple)


def trim() -> None:
    gc.collect()
    give_back()


def give_back() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)
