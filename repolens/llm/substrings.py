"""Removal of word runs that an earlier document has, by super-k-mer partitioning.

A window is `width` consecutive words. Neighbouring windows whose least-hashed group of `group` words
(the minimiser) is the same travel together as one string, packed, to the bucket of that minimiser:
equal windows always meet in one bucket. There all windows are sorted, equal ones stand side by side,
and those whose words also start in a document of a smaller key are found exactly.

Before anything travels, each task sorts the windows of its own batch: an occurrence with one in an
earlier document of the batch is settled at once, and of each distinct window only the first occurrence
is sent. A passage that a third of all documents share, or one that a document repeats, so reaches its
bucket once per batch. Documents that repeat a window within themselves are marked, and what the buckets
say of its first occurrence is applied to the others when the text is cut.

A minimiser that many windows share would fill its bucket. Those that are common in a bounded sample
are split further, by a second minimiser of groups twice as long; the sample decides only where windows
meet, never whether.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K

#: Bytes of text that one bucket should hold.
BUCKET_BYTES = 4 << 20
#: Bytes of text sampled to find common minimisers, and the share of its windows that makes one common.
SAMPLE_BYTES, COMMON = 16 << 20, 1 / 4096
_GROUPS = "bucket long, payload binary, doc long, at array<int>, n array<int>"
_END = np.uint64(0xFFFFFFFFFFFFFFFF)
#: In place of a run of windows: the document repeats windows within itself.
AGAIN = -1


def _windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the first word of every window, and a hash of each window's words."""
    h = K.hash_spans(data, starts, ends)
    sizes = np.maximum(np.diff(at) - width + 1, 0)
    first = K.ragged(at[:-1], sizes).astype(np.int64)
    w = np.zeros(len(first), np.uint64)
    for i in range(width):
        w = w * np.uint64(0x9E3779B97F4A7C15) + h[first + i]
        w ^= w >> np.uint64(29)
    return h, first, K.mix(w)


def _same(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Whether the words of window a[i] equal those of window b[i], byte by byte."""
    out = np.ones(len(a), bool)
    for k in range(width):
        live = np.flatnonzero(out)
        x, y = a[live] + k, b[live] + k
        size = ends[x] - starts[x]
        ok = size == ends[y] - starts[y]
        live, x, y, size = live[ok], x[ok], y[ok], size[ok]
        wrong = data[K.ragged(starts[x], size)] != data[K.ragged(starts[y], size)]
        bad = np.zeros(len(live), bool)
        if wrong.any():
            bad[np.repeat(np.arange(len(live)), size)[wrong]] = True
        out[:] = False
        out[live[~bad]] = True
    return out


def _heads(data, starts, ends, first, hashes, doc, width: int) -> np.ndarray:
    """For each window the place of the one of the same words that has the least doc, the first of its own."""
    out = np.arange(len(first))
    rest = np.arange(len(first))
    while len(rest):
        order = rest[np.lexsort((doc[first[rest]], hashes[rest]))]
        new = np.empty(len(order), bool)
        new[0] = True
        np.not_equal(hashes[order[1:]], hashes[order[:-1]], out=new[1:])
        head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        many = np.flatnonzero(order != head)
        ok = np.ones(len(order), bool)
        ok[many] = _same(data, starts, ends, first[order[many]], first[head[many]], width)
        out[order[ok]] = head[ok]
        rest = np.sort(order[~ok])  # other words of the same hash: once more among themselves
    return out


def _runs(flags: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of set flags; a run also ends before an index in `breaks`."""
    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    cut = np.zeros(len(flags) + 1, bool)
    cut[breaks] = True
    inner = np.flatnonzero(cut[:-1] & flags & np.concatenate([[False], flags[:-1]]))
    begin = np.union1d(np.flatnonzero(edge == 1), inner)
    end = np.union1d(np.flatnonzero(edge == -1), inner)
    return begin, end - begin


def _minimisers(h: np.ndarray, first: np.ndarray, width: int, group: int) -> np.ndarray:
    """The least mixed hash of `group` words in a row within each window."""
    g = np.zeros(len(h), np.uint64)
    for i in range(group):
        shifted = np.roll(h, -i)
        g = g * np.uint64(0xBF58476D1CE4E5B9) + shifted
    g = K.mix(g)
    least = np.full(len(first), _END)
    for i in range(width - group + 1):
        np.minimum(least, g[first + i], out=least)
    return least


def _split(least: np.ndarray, common: np.ndarray, h: np.ndarray, first: np.ndarray, width: int, group: int) -> np.ndarray:
    """`least` with a second minimiser mixed in where it is in `common` (sorted)."""
    if len(common) and 2 * group <= width:
        where = np.flatnonzero(common[np.minimum(np.searchsorted(common, least), len(common) - 1)] == least)
        least[where] = K.mix(least[where] ^ _minimisers(h, first[where], width, 2 * group))
    return least


def _common(source: DataFrame, size: int, width: int, group: int) -> np.ndarray:
    """Minimisers of over `COMMON` of the windows in a sample of about `SAMPLE_BYTES` of text, sorted."""
    some = source.where(F.xxhash64("doc").cast("double") / 2.0**64 + 0.5 <= min(1.0, SAMPLE_BYTES / max(1, size))).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.alone("substrings")
        for batch in K.portions(batches, "text"):
            data, offsets = K.texts(K.column(batch, "text"))
            starts, ends, at = K.words(data, offsets)
            h, first, hashes = _windows(data, starts, ends, at, width)
            _, once = np.unique(hashes, return_index=True)
            m, n = np.unique(_minimisers(h, first[once], width, group), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(n)], names=["m", "n"])

    counts = some.mapInArrow(run, "m long, n long").groupBy("m").agg(F.sum("n").alias("n"))
    least = (counts.agg(F.sum("n")).first()[0] or 0) * COMMON
    return np.sort(counts.where(F.col("n") > least).select("m").toArrow()["m"].to_numpy().view(np.uint64))


def _send(batches: Iterator[pa.RecordBatch], key: str, text: str, width: int, group: int, buckets: int, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    K.alone("substrings")
    pack = zstandard.ZstdCompressor(level=3)
    for batch in K.portions(batches, text):
        data, offsets = K.texts(K.column(batch, text))
        doc = K.column(batch, key).to_numpy(zero_copy_only=False).astype(np.int64)
        starts, ends, at = K.words(data, offsets)
        h, first, hashes = _windows(data, starts, ends, at, width)
        if not len(first):
            continue
        own = np.repeat(np.arange(len(doc)), np.diff(at))
        owner = doc[own]
        head = _heads(data, starts, ends, first, hashes, owner, width)
        settled = owner[first[head]] < owner[first]
        travels = head == np.arange(len(first))
        again = np.unique(owner[first[~settled & ~travels]])
        breaks = np.flatnonzero(np.diff(own[first]) != 0) + 1
        begin, size = _runs(settled, breaks)
        marks = np.full(len(again), AGAIN)
        rows = [_grouped(np.concatenate([owner[first[begin]], again]), np.concatenate([first[begin] - at[own[first[begin]]], marks]), np.concatenate([size, 0 * marks]))]
        least = _split(_minimisers(h, first, width, group), common, h, first, width, group)
        cuts = np.union1d(breaks, np.flatnonzero(least[1:] != least[:-1]) + 1)
        begin, size = _runs(travels, cuts)
        bucket = (least[begin] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        begin, size, bucket = begin[order], size[order], bucket[order]
        a, z = starts[first[begin]], ends[first[begin] + size + width - 2]
        strings = data[K.ragged(a, z - a)]
        string_at = K.bounds(z - a)
        head = np.stack([owner[first[begin]], first[begin] - at[own[first[begin]]], size, z - a], axis=1)
        edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)] if len(bucket) else [0]
        payloads = [
            pack.compress(np.int64(j - i).tobytes() + np.ascontiguousarray(head[i:j].T).tobytes() + strings[string_at[i] : string_at[j]].tobytes())
            for i, j in zip(edges, edges[1:])
        ]
        sent = pa.array(payloads, pa.binary())
        none = pa.nulls(len(payloads))
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[edges[:-1]] if len(payloads) else np.empty(0, np.int64)), sent, none.cast(pa.int64()), none.cast(pa.list_(pa.int32())), none.cast(pa.list_(pa.int32()))],
            names=["bucket", "payload", "doc", "at", "n"],
        )
        yield from rows


def _grouped(doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Settled runs of windows, a row for each doc in the batch."""
    order = np.argsort(doc, kind="stable")
    doc, at, n = doc[order], at[order], n[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]]) if len(doc) else np.zeros(1, np.int64)
    lists = [pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (at, n)]
    k = len(edges) - 1
    none = pa.nulls(k)
    return pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.binary()), pa.array(doc[edges[:-1]] if k else np.empty(0, np.int64)), *lists], names=["bucket", "payload", "doc", "at", "n"])


def _meet(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket: one bucket at a time."""
    K.alone("substrings")
    unpack = zstandard.ZstdDecompressor()
    held: list[bytes] = []
    now = None
    for batch in batches:
        buckets = K.column(batch, "bucket").to_numpy()
        payloads = K.column(batch, "payload")
        for i in range(len(batch)):
            if buckets[i] != now and held:
                yield _settle(held, unpack, width)
                held = []
            now = buckets[i]
            held.append(payloads[i].as_py())
    if held:
        yield _settle(held, unpack, width)


def _settle(payloads: list[bytes], unpack: zstandard.ZstdDecompressor, width: int) -> pa.RecordBatch:
    heads, strings = [], []
    for p in payloads:
        raw = unpack.decompress(p)
        k = int(np.frombuffer(raw, np.int64, 1)[0])
        heads.append(np.frombuffer(raw, np.int64, 4 * k, 8).reshape(4, k))
        strings.append(np.frombuffer(raw, np.uint8, offset=8 + 32 * k))
    doc, pos, size, length = np.concatenate(heads, axis=1)
    data = np.concatenate(strings)
    starts, ends, at = K.words(data, K.bounds(length))
    _, first, hashes = _windows(data, starts, ends, at, width)
    own = np.repeat(np.arange(len(doc)), np.diff(at))[first]
    owner = np.repeat(doc, np.diff(at))
    settled = owner[first[_heads(data, starts, ends, first, hashes, owner, width)]] < doc[own]
    begin, n = _runs(settled, np.flatnonzero(np.diff(own) != 0) + 1)
    return _grouped(doc[own[begin]], pos[own[begin]] + first[begin] - at[own[begin]], n)


def _repeated(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """All windows of one text that have the words of a window in the runs (at, n)."""
    _, first, hashes = _windows(data, starts, ends, np.array([0, len(starts)]), width)
    head = _heads(data, starts, ends, first, hashes, np.zeros(len(starts), np.int64), width)
    marked = np.zeros(len(first), bool)
    marked[head[K.ragged(at, n)]] = True
    return np.flatnonzero(marked[head])


def _cut(values: pa.Array, at: list, n: list, width: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    data, offsets = K.texts(values)
    starts, ends, word_at = K.words(data, offsets)
    change = np.zeros(len(starts) + 1, np.int64)
    for i, (a, b) in enumerate(zip(at, n, strict=True)):
        if a is not None and len(a):
            again, run = (a == AGAIN).any(), (a != AGAIN) & (a + b + width - 1 <= word_at[i + 1] - word_at[i])
            a, b = np.asarray(a[run], np.int64) + word_at[i], np.asarray(b[run], np.int64)
            np.add.at(change, a, 1)
            np.add.at(change, a + b + width - 1, -1)
            if again and len(a):
                more = _repeated(data, starts[word_at[i] : word_at[i + 1]], ends[word_at[i] : word_at[i + 1]], a - word_at[i], b, width) + word_at[i]
                np.add.at(change, more, 1)
                np.add.at(change, more + width, -1)
    gone = np.cumsum(change)[:-1] > 0
    n_words = np.diff(word_at)
    n_removed = np.diff(K.bounds(gone.astype(np.int64))[word_at])
    keep = np.flatnonzero(~gone)
    size = ends[keep] - starts[keep] + 1
    out = np.full(int(size.sum()), 32, np.uint8)
    where = K.bounds(size)
    out[K.ragged(where[:-1], size - 1)] = data[K.ragged(starts[keep], size - 1)]
    upto = where[np.searchsorted(keep, word_at)].tolist()
    raw = memoryview(out)
    return n_words, n_removed, [bytes(raw[a : max(a, b - 1)]) for a, b in zip(upto, upto[1:])]


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 13, group: int = 3) -> DataFrame:
    """(doc, at, n): runs of n windows from word `at` on whose words also start in a document of a
    smaller key. Several rows may hold the runs of one document. Where a document has a run at `AGAIN`,
    other windows of it may have the words of one in its runs, and count as well."""
    source = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, int(size // BUCKET_BYTES))
    common = _common(source, size, width, group)
    sent = source.mapInArrow(lambda b: _send(b, "doc", "text", width, group, buckets, common), _GROUPS)
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 8)
    # bucket travels as it is; settled runs need no bucket, and join those of their document later
    together = sent.repartition(partitions, F.coalesce("bucket", F.xxhash64("doc"))).sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def open_ones() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = np.asarray(K.column(batch, "bucket").is_null())
                if done.any():
                    yield None, batch.filter(pa.array(done)).select(["doc", "at", "n"])
                if not done.all():
                    yield batch.filter(pa.array(~done)), None

        waiting: list[pa.RecordBatch] = []

        def to_meet() -> Iterator[pa.RecordBatch]:
            for batch, settled in open_ones():
                if settled is not None:
                    waiting.append(settled)
                else:
                    yield batch

        for out in _meet(to_meet(), width):
            while waiting:
                yield waiting.pop()
            yield out.select(["doc", "at", "n"])
        yield from waiting

    return together.mapInArrow(run, "doc long, at array<int>, n array<int>")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 13, group: int = 3) -> DataFrame:
    """(key, n_words, n_removed, kept): `kept` is the bytes of the words left, joined by one space.

    Words are the runs of bytes between space, tab, line feed, vertical tab, form feed and carriage
    return. A word goes if a window that covers it also starts in a document with a smaller key;
    windows are judged on the input. Null and empty texts have no words and keep an empty text; texts
    of fewer than `width` words keep all. Rows that repeat a key are judged alike against smaller
    keys; rows with a null key are kept whole and make no other row lose words. Keys are integers.
    Other columns are not read.
    """
    found = repeats(docs, key, text, width, group).groupBy("doc").agg(F.flatten(F.collect_list("at")).alias("__at"), F.flatten(F.collect_list("n")).alias("__n"))
    kept = docs.select(F.col(key), F.col(text).alias("__text")).join(found.hint("shuffle_hash"), F.col(key).cast("long") == F.col("doc"), "left").select(key, "__text", "__at", "__n")
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL("n_words long, n_removed long, kept binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.portions(batches, "__text"):
            n_words, n_removed, left = _cut(K.column(batch, "__text"), _lists(K.column(batch, "__at")), _lists(K.column(batch, "__n")), width)
            yield pa.RecordBatch.from_arrays([K.column(batch, key), pa.array(n_words), pa.array(n_removed), pa.array(left, pa.binary())], names=[key, "n_words", "n_removed", "kept"])

    return kept.mapInArrow(run, schema)


def _lists(values: pa.Array) -> list:
    return [None if v.values is None else v.values.to_numpy() for v in values]
