"""Token ids in files: canonical, length-limited Huffman codes in independent blocks.

A table of segments is the output. A segment holds the ids of a run of documents, in ascending key
order, as one binary value with this layout (little-endian):

    magic b"TIDS", version u32, ids u64, block size u32, blocks u32, documents u32
    bit offset of every block u64[blocks]          checkpoints: a block is decoded by itself
    ids of every document u32[documents]
    bit stream, most significant bit first, padded by eight zero bytes

The code of all segments comes from the counts of all ids: `lengths` (one per id, 0: unused) is
stored once beside the segments, and codes follow from it canonically (by length, then id).
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .bpe import Memo, encoded, ends_a_word
from .shared import new_table, removed, written

#: Bits of the longest code, ids of a block, ids of a segment.
LIMIT, BLOCK, SEGMENT = 20, 1024, 1 << 20
_HEAD = struct.Struct("<4sIQIII")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The best code lengths of at most `limit` bits, by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    # a level holds the leaves and the pairs of the level below, by weight; True marks a leaf
    levels, below = [], np.empty(0)
    for _ in range(limit):
        every = np.concatenate([weight, below])
        rank = np.argsort(every, kind="stable")
        levels.append(rank < len(weight))
        merged = every[rank]
        below = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, depth = 2 * len(order) - 2, np.zeros(len(order), np.int64)
    for leaf in reversed(levels):
        own = int(leaf[:take].sum())
        depth[:own] += 1
        take = 2 * (take - own)
    out[order] = depth
    return out


def canonical_codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code of each id, and the ids by code."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(1 << (LIMIT - size))])[:-1]
    codes = np.zeros(len(lengths), np.uint32)
    codes[order] = upto >> (LIMIT - size)
    return codes, order


class Code:
    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = lengths
        self.codes, order = canonical_codes(lengths)
        self.table = np.zeros(1 << LIMIT, np.int32)  # id and length for each LIMIT bits ahead
        whole = np.repeat(order.astype(np.int32) << 5 | lengths[order], 1 << (LIMIT - lengths[order].astype(np.int64)))
        self.table[: len(whole)] = whole

    def write(self, ids: np.ndarray, per_doc: np.ndarray) -> bytes:
        size = self.lengths[ids].astype(np.int64)
        at = K.bounds(size)
        stream = np.zeros((int(at[-1]) + 7) // 8 + 8, np.uint8)
        shifted = self.codes[ids].astype(np.uint64) << (np.uint64(32) - size.astype(np.uint64) - (at[:-1] & 7).astype(np.uint64))
        byte = at[:-1] >> 3
        for k in range(4):  # codes share bytes but no bits: sums are ors
            part = (shifted >> np.uint64(24 - 8 * k)) & np.uint64(255)
            some = np.flatnonzero(part)
            where, first = byte[some] + k, None
            if len(where):
                first = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1])
                stream[where[first]] |= np.bitwise_or.reduceat(part[some], first).astype(np.uint8)
        blocks = at[:-1][::BLOCK]
        head = _HEAD.pack(b"TIDS", 1, len(ids), BLOCK, len(blocks), len(per_doc))
        return b"".join([head, blocks.astype("<u8").tobytes(), per_doc.astype("<u4").tobytes(), stream.tobytes()])

    def read(self, payload: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a segment, and how many each document has. Blocks are decoded side by side."""
        magic, version, n, block, blocks, docs = _HEAD.unpack_from(payload)
        if magic != b"TIDS" or version != 1:
            raise ValueError("not a segment of token ids")
        at = np.frombuffer(payload, "<u8", blocks, _HEAD.size).astype(np.int64)
        per_doc = np.frombuffer(payload, "<u4", docs, _HEAD.size + 8 * blocks).astype(np.int64)
        stream = np.frombuffer(payload, np.uint8, offset=_HEAD.size + 8 * blocks + 4 * docs)
        four = np.ndarray((len(stream) - 3,), ">u4", stream, 0, (1,))
        out = np.zeros((block, blocks), np.int32)
        last = n - block * (blocks - 1) if blocks else 0
        for i in range(block if blocks > 1 else last):
            live = blocks if i < last else blocks - 1
            own = at[:live]
            ahead = (four[own >> 3] >> (12 - (own & 7)).astype(np.uint32)) & ((1 << LIMIT) - 1)
            found = self.table[ahead]
            out[i, :live] = found >> 5
            own += found & 31
        return out.T.reshape(-1)[:n], per_doc


@functools.lru_cache(1)
def _code(lengths: bytes) -> Code:
    return Code(np.frombuffer(lengths, np.uint8))


class Library:
    """Encodes units with the tokenizers library as it is: the strings of its added tokens in a text are
    those tokens. Units are cut before white space, so an added token must not hold or strip any."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(len(t.content.split()) != 1 or t.content.strip() != t.content or t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("an added token holds, strips or depends on the white space around it")

        vocabulary, special = self.tokenizer.get_vocab(), {t.content: len(t.content.encode()) for t in added}
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # a character of a token is a byte
        for token, i in vocabulary.items():
            self.bytes[i] = special.get(token, len(token))

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, np.int32), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def __call__(self, unit: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units one after another, and how many each has."""
        return self._ids(unit)

    def spans(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of the units data[at[i]:at[i + 1]].

        Units that begin with white space and end without are encoded many at a time: no token spans two of
        them, and the bytes of the tokens tell where one ends. Where they do not, and all others, one by one.
        """
        size = np.diff(at)
        joined = K.IS_SPACE[data[at[:-1]]] & ends_a_word(data, at[1:]) & (size <= 4096)
        many, rest = np.flatnonzero(joined), np.flatnonzero(~joined)
        text, upto = data[K.ragged(at[:-1][many], size[many])].tobytes(), np.cumsum(size[many])
        cuts = np.append(np.flatnonzero(np.diff(upto // 1024)), len(many) - 1) if len(many) else many
        ends_at = upto[cuts].tolist()
        flat, _ = self._ids([text[a:b].decode() for a, b in zip([0, *ends_at], ends_at)])
        ends = np.cumsum(self.bytes[flat])
        last = np.searchsorted(ends, upto)
        if len(many) and not (ends[-1] == upto[-1] and np.array_equal(ends[last], upto)):
            many, rest = many[:0], np.arange(len(size))
            flat, last = flat[:0], last[:0]
        raw, where = data.tobytes(), at.tolist()
        more, made_rest = self._ids([raw[where[i] : where[i + 1]].decode() for i in rest.tolist()])
        made = np.zeros(len(size), np.int64)
        made[many], made[rest] = np.diff(last, prepend=-1), made_rest
        begin = np.zeros(len(size), np.int64)
        begin[many], begin[rest] = K.bounds(made[many])[:-1], len(flat) + K.bounds(made_rest)[:-1]
        return np.concatenate([flat, more])[K.ragged(begin, made)], made


def library(path: str) -> Memo:
    return K.held(("library", path), lambda: Memo(Library(path)))


def _kind(path: str) -> str:
    """Two bytes hold an id of a vocabulary of up to 65,536."""
    return "<u2" if Library(path).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    raw = values.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    return np.ascontiguousarray(data), offsets - offsets[0]


def ids_of(docs: DataFrame, path: str, key: str, text: str, end: int, kind: str) -> DataFrame:
    """(key, sign, ids): the ids of each text and the end id, packed; sign orders rows of one key."""
    source = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("sign"), F.col(text).alias("__text"))
    schema = T.StructType([source.schema["key"], *T.StructType.fromDDL("sign long, ids binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, at in encoded(library(path), batches, "__text"):
            out = np.insert(ids, at[1:], end).astype(kind)
            where = ((at + np.arange(len(at))) * out.itemsize).astype(np.int64)
            values = pa.Array.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(where), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([K.column(batch, "key"), K.column(batch, "sign"), values.cast(pa.binary())], names=["key", "sign", "ids"])

    return source.mapInArrow(run, schema)


def count_ids(coded: DataFrame, kind: str) -> DataFrame:
    """(id, n) over all rows; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            own = np.bincount(_bytes(K.column(batch, "ids"))[0].view(kind))
            if len(own) > len(total):
                own, total = total, own.astype(np.int64)
            total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return coded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = 0) -> tuple[DataFrame, bytes]:
    """The written segments (part, number, n_ids, keys, payload) in ascending key order, and the code
    lengths that `read` needs.

    Null and empty texts have the end id alone. Null keys come first, rows of one key in the order of
    a hash of their text. Each range of keys is one task's; a segment ends after the document that
    brings it to `SEGMENT` ids. An empty table gives no segments. Other columns are not read.
    """
    spark, kind = docs.sparkSession, _kind(path)
    of_ids = new_table(spark, "ids")
    coded = written(ids_of(docs, path, key, text, end, kind), "ids", of_ids, compression="zstd")
    counts = np.zeros(1, np.int64)
    for row in count_ids(coded, kind).collect():  # one row for each id of the vocabulary
        if row["id"] >= len(counts):
            counts = np.concatenate([counts, np.zeros(row["id"] + 1 - len(counts), np.int64)])
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts).tobytes()
    shared = spark.sparkContext.broadcast(lengths)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = coded.repartitionByRange(n, "key", "sign").sortWithinPartitions("key", "sign")
    schema = T.StructType([*T.StructType.fromDDL("part int, number int, n_ids long").fields, T.StructField("keys", T.ArrayType(coded.schema["key"].dataType)), T.StructField("payload", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, number = _code(shared.value), 0
        keys, ids, sizes, held = [], [], [], 0

        def segment() -> pa.RecordBatch:
            flat, per_doc = np.concatenate(ids), np.concatenate(sizes)
            own = pa.concat_arrays(keys)
            values = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            row = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([number], pa.int32()), pa.array([len(flat)]), values, pa.array([code.write(flat, per_doc)], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=schema.names)

        for batch in batches:
            data, offsets = _bytes(K.column(batch, "ids"))
            flat = data.view(kind).astype(np.int64)
            at = offsets // np.dtype(kind).itemsize
            begin = 0
            while begin < len(batch):
                upto = int(np.searchsorted(at, at[begin] + SEGMENT - held))
                upto = min(max(upto, begin + 1), len(batch))
                keys.append(K.column(batch, "key").slice(begin, upto - begin))
                ids.append(flat[at[begin] : at[upto]])
                sizes.append(np.diff(at[begin : upto + 1]))
                held += int(at[upto] - at[begin])
                begin = upto
                if held >= SEGMENT:
                    yield segment()
                    keys, ids, sizes, held, number = [], [], [], 0, number + 1
        if keys:
            yield segment()

    segments = written(ordered.mapInArrow(run, schema), "segments", compression="none")
    removed(spark, of_ids)
    return segments, lengths


def read(segments: DataFrame, lengths: bytes, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) per document, from the written segments."""
    shared = segments.sparkSession.sparkContext.broadcast(lengths)
    kind = segments.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField(key, kind), *T.StructType.fromDDL("part int, number int, before long, n_tokens long, ids_crc32 long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _code(shared.value)
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                ids, per_doc = code.read(K.column(row, "payload")[0].as_py())
                at = K.bounds(per_doc)
                raw = memoryview(ids.astype("<u4")).cast("B")
                where = (at * 4).tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(where, where[1:])]
                one = [np.full(len(per_doc), K.column(row, c)[0].as_py(), np.int32) for c in ("part", "number")]
                yield pa.RecordBatch.from_arrays([K.column(row, "keys").flatten(), *map(pa.array, one), pa.array(at[:-1]), pa.array(per_doc), pa.array(crc, pa.int64())], names=schema.names)

    found = segments.select("part", "number", "keys", "payload").mapInArrow(run, schema)
    own = segments.select("part", "number", "n_ids")
    parts = own.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each task that wrote
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("of_parts"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.withColumn("of_part", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    starts = starts.select("part", "number", (F.col("of_parts") + F.col("of_part")).alias("first"))
    return found.join(starts, ["part", "number"]).select(key, (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
