"""Token ids packed into sequences of a fixed capacity: minimum bin slack over counts of lengths.

Documents longer than the capacity are cut, so a piece has one of `capacity` lengths. The plan of the bins
follows from how many pieces have each length, not from the pieces: the largest length left opens a
bin, subset sums of the lengths left over (a bitset, one bit per fill) find the fullest combination that
fits beside it, and the combination is taken out as often as its lengths are there. A step leaves
some length with fewer pieces than the combination takes, so the number of steps depends on the capacity alone.

Pieces then find their place by rank: the i-th piece of a length goes where the plan puts the i-th. Ranks
come from counts per (task, length), so a length that most pieces have is spread like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .bpe import encoded
from .shared import new_table, removed, written
from .token_files import library

CAPACITY = 1024
#: Pieces of one length are numbered up to 2 to this power.
_RANK = 44


def fullest(counts: list[int], lengths: list[int], room: int) -> dict[int, int]:
    """How many of each of `lengths` (descending) fill `room` as far as any combination of `counts` can.

    Of equally full combinations, one that the longest lengths reach: short ones fit in later as well.
    """
    everything, reach, steps = (1 << (room + 1)) - 1, 1, []
    for size in lengths:
        left = min(counts[size], room // size) if size <= room else 0
        portion = 1
        while left:  # 1, 2, 4, ... copies at once
            copies = min(portion, left)
            steps.append((size, copies, reach))
            reach |= reach << (size * copies) & everything
            left -= copies
            portion *= 2
        if reach >> room & 1:
            break
    fill, taken = reach.bit_length() - 1, {}
    for size, copies, before in reversed(steps):
        if not before >> fill & 1:
            taken[size] = taken.get(size, 0) + copies
            fill -= size * copies
    return taken


def plan(counts: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Combinations of lengths and how many bins each fills; `counts[i]` pieces have length i."""
    left, out = list(counts), []
    lengths = [i for i in range(capacity, 0, -1) if left[i]]
    while lengths:
        seed = lengths[0]
        left[seed] -= 1
        taken = fullest(left, lengths, capacity - seed)
        left[seed] += 1
        taken[seed] = taken.get(seed, 0) + 1
        bins = min(left[size] // n for size, n in taken.items())
        for size, n in taken.items():
            left[size] -= n * bins
        out.append((bins, taken))
        lengths = [i for i in lengths if left[i]]
    return out


def places(bins: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, ...]:
    """The plan by pieces: from which length and rank on (ascending), the first bin, the pieces of the length
    in each bin, and where the first of them begins."""
    rows, used, first = [], {}, 0
    for n, taken in bins:
        offset = 0
        for size in sorted(taken, reverse=True):
            begin = used.get(size, 0)
            rows.append((size << _RANK | begin, begin, first, taken[size], offset))
            used[size] = begin + taken[size] * n
            offset += size * taken[size]
        first += n
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 5).T)


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 2, with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32, part, number): the ids of each text and the end id, cut into
    pieces; number counts the pieces of one length in the task `part`. With `ids` if asked for."""
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("__text"))
    fields = "piece int, start long, length long, ids_crc32 long, part int, number long" + (", ids array<int>" if with_ids else "")
    schema = T.StructType([source.schema["key"], *T.StructType.fromDDL(fields).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch, ids, at in encoded(library(path), batches, "__text"):
            flat = np.insert(ids, at[1:], end).astype("<u4")
            at = at + np.arange(len(at))
            n = np.diff(at)
            cuts = -(-n // capacity)
            first = n - (cuts - 1) * capacity
            row = np.repeat(np.arange(len(n)), cuts)
            piece = K.ragged(np.zeros(len(n), np.int64), cuts).astype(np.int64)
            start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[row])
            order = np.argsort(length, kind="stable")
            new = np.flatnonzero(np.diff(length[order], prepend=-1))
            number = np.empty(len(length), np.int64)
            number[order] = np.arange(len(order)) - np.repeat(new, np.diff(new, append=len(order)))
            number += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            where = at[row] + start
            raw = memoryview(flat).cast("B")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * where).tolist(), (4 * (where + length)).tolist())]
            columns = [K.column(batch, "key").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(number)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(where, len(flat)).astype(np.int32)), pa.array(flat.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def placed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The written pieces with sequence_id (from 0 without gaps) and offset in place of part and number.

    What passes through the driver is one count for each length. The counts per (task, length) are
    summed up over the tasks before within each length, whose rows are as many as tasks, not pieces.
    """
    per_task = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = [0] * (capacity + 1)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[row["length"]] = row["n"]
    shared = cut.sparkSession.sparkContext.broadcast(places(plan(counts, capacity)))
    ranked = cut.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("number")).drop("part", "number", "base")
    names = [c for c in cut.columns if c not in ("part", "number")]
    schema = T.StructType([*(cut.schema[c] for c in names), *T.StructType.fromDDL("sequence_id long, offset long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, begin, first, per_bin, offset = shared.value
        for batch in batches:
            length, rank = (K.column(batch, c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(start, length << _RANK | rank, side="right") - 1
            bin_, slot = np.divmod(rank - begin[at], per_bin[at])
            columns = [K.column(batch, c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(first[at] + bin_), pa.array(offset[at] + slot * length)], names=schema.names)

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 2, with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every text, and its
    `ids` if asked for.

    Ids are the library's, then `end`. A text of more than `capacity` ids is cut into pieces of `capacity`, of
    which the first may be shorter; no other is cut. Null and empty texts are the end id alone. Null and
    repeated keys and repeated rows are packed row by row. Which of several pieces of one length goes where
    depends on the task that read it; the number of sequences does not. An empty table gives no rows.
    Other columns are not read.
    """
    cut = written(pieces(docs, path, key, text, capacity, end, with_ids), "pieces")
    return placed(cut, capacity).withColumnRenamed("key", key)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, lengths) of `pack(..., with_ids=True)`: the ids of each sequence, and of its pieces
    in order. A sequence has at most `capacity` ids, so a group is small."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    whole = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return whole.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.length").alias("lengths"))
