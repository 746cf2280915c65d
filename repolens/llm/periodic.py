"""Runs: stretches of words that repeat with a period, found by internal pattern matching.

A run of period q has at least four periods. For the power of two b with q <= b < 2q, it covers a whole
dyadic block of b words with another occurrence of the block q words on or q words back; nearer
ones there are none, or the run had a smaller period. So at each level the nearest occurrences of every
dyadic block in the windows of b words on both sides give candidates (b/2 < q <= b): the occurrences of a
block within a run are a progression whose difference is the period.

Occurrences come from the suffix array of the words: those of a block are an interval of it, found while
it is built by doubling, and the next position before or after the block in that interval is a
range successor query to a wavelet tree over the array. All documents of a batch are one array, in
which those of one document are one interval, and all queries of a level are answered together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K

#: Words and periods of the shortest run; fewer than four periods are not guaranteed to hold a block.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of text that are worked on at once (a longer text is alone).
PORTION = 2 << 20


class WaveletTree:
    """A sequence of numbers below 2 ** bits, one bit vector per level (high bits first), with ranks."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.n, self.bits, self.levels = len(values), bits, []
        now = values.astype(np.int32 if bits < 31 else np.int64)
        for level in range(bits - 1, -1, -1):
            one = (now >> level & 1).astype(bool)
            packed = np.packbits(one, bitorder="little")
            words = np.zeros(len(packed) // 8 + 2, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), np.int32)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((words, before, int(self.n - one.sum())))
            now = np.concatenate([now[~one], now[one]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[at] + np.bitwise_count(words[at] & mask)

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of values[lo:hi] are less than x, for each query."""
        count = np.zeros(len(lo), np.int32)
        for k, (words, before, zeros) in enumerate(self.levels):
            a, b = self._ones(words, before, lo), self._ones(words, before, hi)
            one = (x >> (self.bits - 1 - k) & 1).astype(bool)
            count += np.where(one, (hi - lo) - (b - a), 0).astype(np.int32)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return count

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank k (from 0) in values[lo:hi], for each query."""
        out = np.zeros(len(lo), np.int32 if self.bits < 31 else np.int64)
        for words, before, zeros in self.levels:
            a, b = self._ones(words, before, lo), self._ones(words, before, hi)
            off = (hi - lo) - (b - a)
            one = k >= off
            out = out << 1 | one
            k = np.where(one, k - off, k)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return out

    def neighbours(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest values below and above x in values[lo:hi], which holds x; -1 where there is none."""
        rank, none = self.below(lo, hi, x), np.full(len(lo), -1, np.int64)
        under, over = none.copy(), none
        some = np.flatnonzero(rank > 0)
        under[some] = self.smallest(lo[some], hi[some], rank[some] - 1)
        some = np.flatnonzero(rank + 1 < hi - lo)
        over[some] = self.smallest(lo[some], hi[some], rank[some] + 1)
        return under, over


def occurrences(b: int, least_words: int, least_periods: int) -> int:
    """How often a dyadic block of b words occurs at least within a run that covers it, b/2 < period <= b."""
    q = np.arange(b // 2 + 1, b + 1)
    return int(((np.maximum(least_words, least_periods * q) - b - q + 1) // q).min()) + 1


def suffixes(ids: np.ndarray, first: np.ndarray, most: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The suffix array of each document, one after another, sorted by up to 2 * `most` words, and (b, at, lo, hi)
    for b = 1, 2, 4, ... `most`: dyadic blocks of b words at `at` that occur again in their document, and their
    interval [lo, hi) of the array."""
    n, size = len(ids), np.diff(first)
    upto = np.repeat(first[1:], size)
    key = np.repeat(np.arange(len(size)), size) * (int(ids.max(initial=0)) + 1) + ids
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    rank, blocks, b = np.empty(n, np.int64), [], 1
    begin = np.flatnonzero(new)
    rank[order] = np.repeat(begin, np.diff(begin, append=n))
    while True:
        end = np.zeros(n, np.int64)
        begin = np.flatnonzero(new)
        end[begin] = np.append(begin[1:], n)
        at = np.arange(0, n, b)
        at = at[at + b <= upto[at]]
        lo = rank[at]
        hi = end[lo]
        often = hi - lo >= 2
        blocks.append((b, at[often], lo[often], hi[often]))
        if not often.any() or 2 * b > most:
            return order, blocks
        open_ = np.repeat(end[begin] - begin > 1, end[begin] - begin)
        slot = np.flatnonzero(open_)
        pos = order[slot]
        ahead = np.where(pos + b < upto[pos], rank[np.minimum(pos + b, n - 1)] + 1, 0)
        key = rank[pos] * (n + 1) + ahead
        again = np.argsort(key, kind="stable")
        pos, key = pos[again], key[again]
        order[slot] = pos
        differs = np.ones(len(slot), bool)
        differs[1:] = key[1:] != key[:-1]
        new[slot] |= differs
        begin = np.flatnonzero(differs)
        rank[pos] = np.repeat(slot[begin], np.diff(begin, append=len(slot)))
        b *= 2


def _reach(ids: np.ndarray, at: np.ndarray, step: int, other: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many words from `at` on, going by `step`, equal those from `other` on, `room` at most."""
    out = room.copy()
    some = np.flatnonzero(room > 0)
    if len(some):
        size = room[some]
        k = K.ragged(np.zeros(len(some), np.int64), size)
        a, b = np.repeat(at[some], size) + step * k, np.repeat(other[some], size) + step * k
        equal = np.where(ids[a] == ids[b], np.repeat(size, size), k)
        out[some] = np.minimum.reduceat(equal, K.bounds(size)[:-1])
    return out


def runs_of(ids: np.ndarray, first: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (in the batch), length and period of every run of the documents ids[first[i]:first[i + 1]],
    ordered by start, then period."""
    longest = int(np.diff(first).max(initial=0))
    empty = np.empty(0, np.int64)
    if longest < least_words:
        return empty, empty, empty
    size = np.diff(first)
    base, upto = np.repeat(first[:-1], size), np.repeat(first[1:], size)
    order, blocks = suffixes(ids, first, longest // 2)
    tree = WaveletTree(order - base[order], max(1, int(longest - 1).bit_length()))
    found = []
    for b, at, lo, hi in blocks:
        often = np.flatnonzero(hi - lo >= occurrences(b, least_words, least_periods))
        at, lo, hi = at[often], lo[often], hi[often]
        under, over = tree.neighbours(lo, hi, at - base[at])
        under, over = np.where(under < 0, -1, under + base[at]), np.where(over < 0, -1, over + base[at])
        q = np.concatenate([np.where(under < 0, 0, at - under), np.where(over < 0, 0, over - at)])
        start = np.concatenate([under, at])
        near = (q > b // 2) & (q <= b)
        q, start = q[near], start[near]
        by = np.lexsort((start, q))
        q, start = q[by], start[by]
        end = start + q + b
        # stretches of one period that share a period of words are one
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (start[1:] + q[1:] > end[:-1])
        head = np.flatnonzero(new)
        q, start, end = q[head], start[head], end[np.append(head[1:], len(new)) - 1] if len(head) else end
        may = np.flatnonzero(end - start + 2 * b >= np.maximum(least_words, least_periods * q))
        q, start, end = q[may], start[may], end[may]
        left = np.minimum(b, start - base[start])
        start = start - _reach(ids, start - 1, -1, start - 1 + q, left)
        right = np.minimum(b, upto[start] - end)
        end = end + _reach(ids, end, 1, end - q, right)
        long = np.flatnonzero(end - start >= np.maximum(least_words, least_periods * q))
        found.append(np.stack([start[long], q[long], end[long] - start[long]]))
    start, q, length = np.unique(np.concatenate(found, axis=1), axis=1)
    return start, length, q


def _kept(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The words to keep of each text, joined by one space."""
    word = np.flatnonzero(keep)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[word]
    size = ends[word] - starts[word] + 1
    out = np.append(data, np.uint8(32))[K.ragged(starts[word], size)]
    upto = np.cumsum(size)
    out[upto - 1] = 32
    last = np.ones(len(word), bool)
    last[:-1] = text[1:] != text[:-1]
    stays = np.ones(len(out), bool)
    stays[upto[last] - 1] = False
    per_text = np.bincount(text, size, len(first) - 1).astype(np.int64) - np.bincount(text[last], minlength=len(first) - 1)
    return pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(K.bounds(per_text)), pa.py_buffer(np.ascontiguousarray(out[stays]))]).cast(pa.string())


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """(key, n_words, runs, kept) per row: all runs as structs of start (word number from 0), length and
    period, by start, then period; and the words left when each run keeps its first period alone,
    joined by one space.

    A run is a stretch of words `period` apart identical, of at least `least_words` words and `least_periods`
    (4 or more) of its smallest periods, that no neighbouring word extends. Words are runs of bytes other
    than the six white spaces. Null and empty texts have no words. Null and repeated keys and repeated rows
    pass row by row; other columns are not read. A row is worked on by itself, so an empty table gives no rows.
    """
    if least_periods < 4:
        raise ValueError("runs of fewer than four periods are not guaranteed to be found")
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("__text"))
    kind = "n_words long, runs array<struct<start: long, length: long, period: long>>, kept string"
    schema = T.StructType([T.StructField(key, source.schema["key"].dataType), *T.StructType.fromDDL(kind).fields])
    fields = [pa.field(c, pa.int64()) for c in ("start", "length", "period")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.alone("periodic")
        for batch in K.portions(batches, "__text", PORTION):
            data, offsets = K.texts(K.column(batch, "__text"))
            starts, ends, first = K.words(data, offsets)
            _, ids = K.distinct_spans(data, starts, ends)
            size = np.diff(first)
            begin, text_at, runs = [], [], []
            width = np.frexp(np.maximum(size - 1, 1))[1]  # texts of like lengths share a tree of as many levels
            for bits in np.unique(width[size >= least_words]):
                rows = np.flatnonzero((width == bits) & (size >= least_words))
                at = K.bounds(size[rows])
                start, length, period = runs_of(ids[K.ragged(first[rows], size[rows])].astype(np.int64), at, least_words, least_periods)
                own = np.searchsorted(at, start, side="right") - 1
                text_at.append(rows[own])
                begin.append(start - at[own])
                runs.append(np.stack([length, period]))
            row = np.concatenate([*text_at, np.empty(0, np.int64)]).astype(np.int64)
            start = np.concatenate([*begin, np.empty(0, np.int64)]).astype(np.int64)
            length, period = np.concatenate([*runs, np.empty((2, 0), np.int64)], axis=1).astype(np.int64)
            by = np.argsort(row, kind="stable")
            row, start, length, period = row[by], start[by], length[by], period[by]
            gone = np.zeros(len(starts) + 1, np.int64)
            np.add.at(gone, first[row] + start + period, 1)
            np.add.at(gone, first[row] + start + length, -1)
            keep = np.cumsum(gone[:-1]) == 0
            structs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=fields)
            lists = pa.ListArray.from_arrays(pa.array(K.bounds(np.bincount(row, minlength=len(batch))).astype(np.int32)), structs)
            yield pa.RecordBatch.from_arrays([K.column(batch, "key"), pa.array(size.astype(np.int64)), lists, _kept(data, starts, ends, first, keep)], names=schema.names)

    return source.mapInArrow(run, schema)
