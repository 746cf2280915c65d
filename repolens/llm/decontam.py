"""Benchmark passages in training texts, by spaced-seed hashing.

A leak is an alignment of `width` consecutive words of a benchmark item with as many of a document in
which at most `errors` words differ. The word positions of a window fall into `errors + 2` classes
(position modulo that number); each mask ignores `errors` of the classes. Substitutions touch at most
`errors` classes, so at least one mask sees only equal words: its hash of the training window equals
that of the test window, and no leak is missed. Every pair of windows that share a hash is verified word
by word. Items of fewer words than a window are one window of their own length, without errors.

Each distinct window is hashed and verified once, however often a text or the benchmark repeats it.
A benchmark of up to `BLOCK_BYTES` goes to every task, with its words numbered: words of a text are
looked up there byte by byte, and a window with more than `errors` unknown words is left out at once.
A larger benchmark is joined as a table of seeds; a bitmap of fixed size keeps text windows without any
seed of the benchmark out of that join.

Words are compared after lowering A-Z; everything but letters, digits and non-ASCII bytes separates.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .shared import new_table, removed, written

#: Bytes of benchmark text up to which its seeds go to every task.
BLOCK_BYTES = 4 << 20
#: Pairs of windows verified at once.
PAIRS = 1 << 18
#: The bitmap of a joined benchmark has 2 to this power bits.
BITS = 26

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
GAP = np.ones(256, bool)
GAP[0x80:] = False
for _a, _b in ("09", "AZ", "az"):
    GAP[ord(_a) : ord(_b) + 1] = False

_R = np.uint64(0x9E3779B97F4A7C15)
_SPANS = "array<struct<a:int,b:int>>"


def words_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z lowered, where the words begin and end, and the number of each text's first word."""
    data, offsets = K.texts(values)
    data = _LOWER[data]
    return (data, *K.words(data, offsets, GAP))


def masks(width: int, errors: int) -> list[np.ndarray]:
    """Word positions that each mask looks at."""
    classes = errors + 2
    where = np.arange(width)
    return [where[~np.isin(where % classes, gone)] for gone in combinations(range(classes), errors)]


def kinds(width: int, errors: int, short: list[int]) -> list[tuple[int, int, list[np.ndarray]]]:
    """(length, differing words allowed, masks) of full windows and of items shorter than one."""
    return [(width, errors, masks(width, errors)), *[(s, 0, [np.arange(s)]) for s in short]]


def seeds(windows: np.ndarray, looked: np.ndarray, number: int) -> np.ndarray:
    """The hash of the looked-at words of each window (a row of words)."""
    out = np.full(len(windows), np.uint64((number + 1) * 1000 + windows.shape[1]))
    for i in looked:
        out *= _R
        out += windows[:, i].astype(np.uint64)
    return K.mix(out)


def _rows(words: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    return words[first[:, None] + np.arange(length)]


def _classes(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one of each distinct window, and which of them each window equals."""
    raw = np.ascontiguousarray(windows)
    size = raw.itemsize * raw.shape[1]
    begins = np.arange(len(raw)) * size
    return K.distinct_spans(raw.view(np.uint8).reshape(-1), begins, begins + size)


def _unique(*columns: np.ndarray) -> np.ndarray:
    return np.unique(np.stack(columns), axis=1) if len(columns[0]) else np.empty((len(columns), 0), np.int64)


class Kind:
    """The distinct windows of one length, the items of each, and their seeds."""

    def __init__(self, words: np.ndarray, first: np.ndarray, item: np.ndarray, length: int, allowed: int, looked: list[np.ndarray]) -> None:
        self.length, self.allowed, self.masks = length, allowed, looked
        windows = _rows(words, first, length)
        one, which = _classes(windows)
        self.windows = windows[one]
        pairs = _unique(which, item)
        self.items, self.items_at = pairs[1], np.searchsorted(pairs[0], np.arange(len(one) + 1))
        self.seeds = []
        for k, positions in enumerate(looked):
            own = seeds(self.windows, positions, k)
            order = np.argsort(own)
            self.seeds.append((own[order], order))

    def near(self, windows: np.ndarray) -> np.ndarray:
        """(2, pairs): distinct windows of a text and of the benchmark that differ in few enough words."""
        found = [np.empty((2, 0), np.int64)]
        for k, (known, order) in enumerate(self.seeds):
            own = seeds(windows, self.masks[k], k)
            low = np.searchsorted(known, own)
            some = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == own)
            low = low[some]
            n = np.searchsorted(known, own[some], side="right") - low
            ends, begin = np.cumsum(n), 0
            while begin < len(some):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, side="right")))
                a = np.repeat(some[begin:end], n[begin:end])
                b = order[K.ragged(low[begin:end], n[begin:end])]
                wrong = np.zeros(len(a), np.int16)
                for i in range(self.length):
                    wrong += windows[a, i] != self.windows[b, i]
                ok = wrong <= self.allowed
                found.append(np.stack([a[ok], b[ok]]))
                begin = end
        every = np.concatenate(found, axis=1)
        return _unique(every[0], every[1])


class Tests:
    """The benchmark's words by number, and its windows by length."""

    def __init__(self, ids: np.ndarray, values: pa.Array, width: int, errors: int) -> None:
        data, starts, ends, at = words_of(values)
        first, words = K.distinct_spans(data, starts, ends)
        self.vocabulary = K.Seen(max(10, int(4 * len(first)).bit_length()))
        self.vocabulary.add(data, starts[first], ends[first])
        if (self.vocabulary.find(data, starts[first], ends[first]) != np.arange(len(first))).any():
            raise RuntimeError("two words of the benchmark have one hash")
        sizes = np.diff(at)
        self.kinds = []
        for length, allowed, looked in kinds(width, errors, sorted({int(s) for s in sizes if 0 < s < width})):
            n = np.maximum(sizes - width + 1, 0) if length == width else (sizes == length).astype(np.int64)
            begin = K.ragged(at[:-1], n).astype(np.int64)
            if len(begin):
                self.kinds.append(Kind(words, begin, np.repeat(ids, n), length, allowed, looked))

    def hits(self, values: pa.Array) -> tuple[np.ndarray, ...]:
        """Words before each text; of each occurrence of a leaked window its first word and length; and the
        distinct pairs of text and item."""
        data, starts, ends, at = words_of(values)
        words = self.vocabulary.find(data, starts, ends)
        unknown = K.bounds((words < 0).astype(np.int64))
        sizes, where, long, pairs = np.diff(at), [], [], [np.empty((2, 0), np.int64)]
        for kind in self.kinds:
            first = K.ragged(at[:-1], np.maximum(sizes - kind.length + 1, 0)).astype(np.int64)
            first = first[unknown[first + kind.length] - unknown[first] <= kind.allowed]
            if not len(first):
                continue
            windows = _rows(words, first, kind.length)
            one, which = _classes(windows)
            own, known = kind.near(windows[one])
            begin = np.searchsorted(own, np.arange(len(one) + 1))
            n = np.diff(begin)[which]
            first, which = first[n > 0], which[n > 0]
            where.append(first)
            long.append(np.full(len(first), kind.length))
            doc, which = _unique(np.searchsorted(at, first, side="right") - 1, which)
            n = np.diff(begin)[which]
            doc, known = _unique(np.repeat(doc, n), known[K.ragged(begin[which], n)])
            n = np.diff(kind.items_at)[known]
            pairs.append(np.stack([np.repeat(doc, n), kind.items[K.ragged(kind.items_at[known], n)]]))
        every = np.concatenate(pairs, axis=1)
        none = [np.empty(0, np.int64)]
        return at, np.concatenate(where or none), np.concatenate(long or none), *_unique(every[0], every[1])


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 13, errors: int = 2, extra: list[str] | None = None, n_leaked: str = "n_leaked", items: str = "items") -> DataFrame:
    """(key, n_leaked, items), or the columns `extra` in place of the key: per row of `docs` the number of words inside verified overlaps
    and the sorted ids of the benchmark items that leak (array<long>). `n_leaked` and `items` name these
    columns, which a column of `extra` must not.

    Null and empty texts and items without words leak nothing; an empty benchmark gives zero counts.
    Repeated rows are judged each by itself; a null key passes through. Items with a null id are not
    used. The columns of `docs` other than key and text are not read.
    """
    names = extra or [key]
    usable = benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    size = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    judge = _sent if size <= BLOCK_BYTES else _joined
    return judge(docs, usable, names, text, width, errors, n_leaked, items)


def _sent(docs: DataFrame, usable: DataFrame, names: list[str], text: str, width: int, errors: int, n_leaked: str, items: str) -> DataFrame:
    """A benchmark of bounded size, in every task."""
    schema = T.StructType([*[docs.schema[c] for c in names], *T.StructType.fromDDL(f"`{n_leaked}` long, `{items}` array<long>").fields])
    rows = usable.toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(Tests(rows["item"].to_numpy(), rows["text"], width, errors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.alone("decontam")
        tests = shared.value
        for batch in K.portions(batches, text, 4 << 20):
            at, where, size, doc, found = tests.hits(K.column(batch, text))
            change = np.zeros(at[-1] + 1, np.int64)
            np.add.at(change, where, 1)
            np.add.at(change, where + size, -1)
            inside = np.cumsum(change)[:-1] > 0
            counts = np.diff(K.bounds(inside.astype(np.int64))[at])
            upto = np.searchsorted(doc, np.arange(len(batch) + 1))
            lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(found))
            yield pa.RecordBatch.from_arrays([*[K.column(batch, c) for c in names], pa.array(counts), lists], names=schema.names)

    return docs.select(*names, *([] if text in names else [text])).mapInArrow(run, schema)


def _seed_table(windows: DataFrame, width: int, errors: int) -> DataFrame:
    """(words, n, seed) of `windows(words, n)`: the seeds of each window, over the bytes of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = K.column(batch, "n").to_numpy()
            data, starts, ends, at = words_of(K.column(batch, "words"))
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                hashes = _rows(K.hash_spans(data, starts, ends), at[:-1][rows], n)
                looked = masks(width, errors) if n == width else [np.arange(n)]
                for k, positions in enumerate(looked):
                    yield pa.RecordBatch.from_arrays([K.column(batch, "words").take(pa.array(rows)), pa.array(length[rows]), pa.array(seeds(hashes, positions, k).view(np.int64))], names=["words", "n", "seed"])

    return windows.select("words", "n").mapInArrow(run, "words string, n int, seed long")


def _windows(rows: DataFrame, key: str, lengths: list[int], width: int, errors: int, bits=None) -> DataFrame:
    """(key, at, n, words) for each window of `rows(key, text)` whose text is `n` words long or, for
    n = `width`, longer; with `bits`, any windows with a seed in that bitmap."""
    schema = T.StructType([rows.schema[key], *T.StructType.fromDDL("at int, n int, words string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.alone("decontam")
        for batch in K.portions(batches, "text", 1 << 20):
            data, starts, ends, at = words_of(K.column(batch, "text"))
            hashes, sizes = K.hash_spans(data, starts, ends), np.diff(at)
            for n in lengths:
                count = np.maximum(sizes - n + 1, 0) if bits is not None or n == width else (sizes == n).astype(np.int64)
                first = K.ragged(at[:-1], count).astype(np.int64)
                if bits is not None and len(first):
                    rows, some = _rows(hashes, first, n), np.zeros(len(first), bool)
                    for k, positions in enumerate(masks(width, errors) if n == width else [np.arange(n)]):
                        place = seeds(rows, positions, k) >> np.uint64(64 - BITS)
                        some |= (bits.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    first = first[some]
                if not len(first):
                    continue
                doc = np.searchsorted(at, first, side="right") - 1
                flat = K.ragged(first, np.full(len(first), n)).astype(np.int64)
                size = ends[flat] - starts[flat] + 1
                out = np.full(int(size.sum()), 32, np.uint8)
                put = K.bounds(size)
                out[K.ragged(put[:-1], size - 1)] = data[K.ragged(starts[flat], size - 1)]
                values = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(np.ascontiguousarray(put[::n])), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([K.column(batch, key).take(pa.array(doc)), pa.array((first - at[doc]).astype(np.int32)), pa.array(np.full(len(first), n, np.int32)), values.cast(pa.string())], names=schema.names)

    return rows.select(key, "text").mapInArrow(run, schema)


def _bitmap(hashes: DataFrame, column: str):
    """A bitmap of `BITS` bits with those of all hashes set."""
    places = hashes.select(F.shiftrightunsigned(column, 64 - BITS).alias("place")).distinct().select(F.shiftright("place", 16).cast("int").alias("part"), "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in zip(K.column(batch, "part").to_pylist(), K.column(batch, "own"), strict=True):
                out = np.zeros(1 << 16, bool)
                out[own.values.to_numpy() & 0xFFFF] = True
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    found = places.groupBy("part").agg(F.collect_list("place").alias("own")).mapInArrow(run, "part int, bits binary").toArrow()
    whole = np.zeros((1 << (BITS - 16), 1 << 13), np.uint8)
    for part, bits in zip(found["part"].to_pylist(), found["bits"], strict=True):
        whole[part] = np.frombuffer(bits.as_buffer(), np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(whole.reshape(-1))


def _joined(docs: DataFrame, usable: DataFrame, names: list[str], text: str, width: int, errors: int, n_leaked: str, items: str) -> DataFrame:
    """A benchmark of any size, by a join of distinct windows on their seeds. Equal texts are judged once,
    told apart by their SHA-256."""
    spark, path = docs.sparkSession, new_table(docs.sparkSession, "benchmark-windows")
    count = F.regexp_count(F.col("text"), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"))
    short = [r[0] for r in usable.select(count.alias("n")).where(f"n between 1 and {width - 1}").distinct().collect()]  # under `width` numbers
    lengths = [width, *sorted(short)]
    tests = written(_windows(usable, "item", lengths, width, errors).select("item", "n", "words").distinct(), "benchmark-windows", path)
    known = _seed_table(tests.select("words", "n").distinct(), width, errors)
    sign = F.sha2(F.col(text).cast("binary"), 256)
    texts = docs.where(F.col(text).isNotNull()).select(sign.alias("sign"), F.col(text).alias("text"))
    met = written(_windows(texts, "sign", lengths, width, errors, _bitmap(known, "seed")), "text-windows")
    own = _seed_table(met.select("words", "n").distinct(), width, errors)
    differ = F.size(F.filter(F.zip_with(F.split("a.words", " "), F.split("b.words", " "), lambda x, y: x != y), lambda x: x))
    same = (F.col("a.seed") == F.col("b.seed")) & (F.col("a.n") == F.col("b.n"))
    near = own.alias("a").join(known.alias("b"), same).where(differ <= F.when(F.col("a.n") == width, errors).otherwise(0)).select(F.col("a.words").alias("words"), F.col("a.n").alias("n"), F.col("b.words").alias("test")).distinct()
    near = written(near, "near-windows")
    hit = met.join(near.select("words", "n").distinct(), ["words", "n"], "left_semi").select("sign", "at", "n").distinct()
    covered = hit.select("sign", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("word")).distinct().groupBy("sign").agg(F.count("*").alias("n_covered"))
    leaked = met.select("sign", "words", "n").distinct().join(near, ["words", "n"]).join(tests.withColumnRenamed("words", "test"), ["test", "n"]).select("sign", "item").distinct()
    found = covered.join(leaked.groupBy("sign").agg(F.sort_array(F.collect_list("item")).alias("own_items")), "sign")
    found = written(found.withColumnRenamed("sign", "__sign"), "leaks").withColumnsRenamed({"n_covered": "__covered", "own_items": "__items"})
    removed(spark, path)
    rows = docs.select(*names, sign.alias("__sign")).join(found, "__sign", "left")
    return rows.select(*names, F.coalesce("__covered", F.lit(0).cast("long")).alias(n_leaked), F.coalesce("__items", F.array().cast("array<long>")).alias(items))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """`docs` without the rows that leak a benchmark item; one pass over `docs`, no shuffle, while the
    benchmark is of up to `BLOCK_BYTES`."""
    found = leaks(docs, benchmark, key, extra=docs.columns, n_leaked="__n_leaked", items="__leaked_items", **options)
    return found.where(F.size("__leaked_items") == 0).select(*docs.columns)
