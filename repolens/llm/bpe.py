"""Byte-level BPE encoding and decoding by a hierarchical-bitmap rank queue.

Merges wait in buckets, one per merge rank, that hold positions of a linked list of tokens. A bitmap
of three levels of 64-bit words marks the buckets in use; find-first-set picks the lowest rank. An
entry whose pair has changed since it was queued is stale and skipped. Two forms share the design:

* `merge_long` walks one long pre-token entry by entry: a run of n bytes costs O(n) queue steps,
  where rescanning would cost O(n^2).
* `merge_many` puts all short pre-tokens of a batch in one list with breaks between them and takes a
  whole bucket at a time with numpy. The lowest rank of the batch is the lowest of every pre-token
  that has it; of several equal pairs in one pre-token only the leftmost merges, the others wait.

Each distinct unit of text (white space, then what follows up to the next white space) is encoded
once per batch. Such a cut never falls within a match of the split pattern.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K

#: No merge for this pair.
NONE = np.int32(2**31 - 1)
#: Pre-tokens of more bytes are merged alone.
LONG = 256

_SAFE = np.zeros(256, bool)
_SAFE[0x21:0x7F] = True


class RankBits:
    """The set of ranks whose buckets hold something: add, discard and find-first-set in three steps."""

    def __init__(self, size: int) -> None:
        self.low = [0] * (size // 64 + 1)
        self.mid = [0] * (size // 4096 + 1)
        self.top = [0] * (size // 262144 + 1)

    def add(self, r: int) -> None:
        self.low[r >> 6] |= 1 << (r & 63)
        self.mid[r >> 12] |= 1 << ((r >> 6) & 63)
        self.top[r >> 18] |= 1 << ((r >> 12) & 63)

    def discard(self, r: int) -> None:
        self.low[r >> 6] &= ~(1 << (r & 63))
        if not self.low[r >> 6]:
            self.mid[r >> 12] &= ~(1 << ((r >> 6) & 63))
            if not self.mid[r >> 12]:
                self.top[r >> 18] &= ~(1 << ((r >> 12) & 63))

    def first(self) -> int:
        """The lowest rank, -1 if there is none."""
        for t, word in enumerate(self.top):
            if word:
                m = (t << 6) + (word & -word).bit_length() - 1
                word = self.mid[m]
                low = (m << 6) + (word & -word).bit_length() - 1
                word = self.low[low]
                return (low << 6) + (word & -word).bit_length() - 1
        return -1


class Ranks:
    """A rank file: token bytes by id, and for each pair of ids the id of their joined bytes."""

    def __init__(self, path: str) -> None:
        self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
        self.size = max(self.ids.values()) + 1
        self.byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        keys, made = array("q"), array("i")
        for token, i in self.ids.items():
            for k in range(1, len(token)):
                left, right = self.ids.get(token[:k]), self.ids.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    made.append(i)
        order = np.argsort(np.frombuffer(keys, np.int64))
        self.keys = np.append(np.frombuffer(keys, np.int64)[order], 2**62)
        self.made = np.append(np.frombuffer(made, np.int32)[order], NONE)
        self.pair = dict(zip(keys, made, strict=True))
        of = [b""] * self.size
        for token, i in self.ids.items():
            of[i] = token
        self.token_bytes = np.frombuffer(b"".join(of), np.uint8)
        self.token_at = K.bounds(np.array([len(t) for t in of], np.int64))
        self.bits = 1
        while 1 << self.bits < 4 * len(keys):
            self.bits += 1
        self._slots()

    def _slots(self) -> None:
        """An open-addressed table of the pairs: most lookups take one probe."""
        size = 1 << self.bits
        self.slot_key = np.full(size, -1, np.int64)
        self.slot_made = np.full(size, NONE, np.int32)
        keys, made = self.keys[:-1], self.made[:-1]
        at = self._slot(keys)
        while len(keys):
            free = self.slot_key[at] == -1
            f = np.flatnonzero(free)
            self.slot_key[at[f]] = keys[f]
            put = self.slot_key[at] == keys
            self.slot_made[at[put]] = made[put]
            keys, made, at = keys[~put], made[~put], (at[~put] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each joined pair, NONE where the vocabulary has none."""
        keys = left.astype(np.int64) * self.size + right
        at = self._slot(keys)
        found = self.slot_key[at]
        out = np.where(found == keys, self.slot_made[at], NONE)
        more = np.flatnonzero((found != keys) & (found != -1))
        while len(more):
            at[more] = (at[more] + 1) & (len(self.slot_key) - 1)
            found = self.slot_key[at[more]]
            hit = found == keys[more]
            out[more[hit]] = self.slot_made[at[more[hit]]]
            more = more[~hit & (found != -1)]
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """One pre-token by the queue, entry by entry."""
        tok = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n, size, pair = len(tok), self.size, self.pair
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        if n:
            nxt[-1] = -1
        rank = [pair.get(tok[i] * size + tok[i + 1], -1) for i in range(n - 1)] + [-1]
        queue, bits = {}, RankBits(size)
        for i in range(n - 1, -1, -1):
            if rank[i] >= 0:
                queue.setdefault(rank[i], []).append(i)
                bits.add(rank[i])
        ordered = {r: True for r in queue}  # a bucket pops its leftmost from the end
        while (r := bits.first()) >= 0:
            bucket = queue[r]
            if not ordered[r]:
                bucket.sort(reverse=True)
                ordered[r] = True
            i = bucket.pop()
            if not bucket:
                bits.discard(r)
            if rank[i] != r:
                continue
            j = nxt[i]
            k = nxt[j]
            tok[i], nxt[i], rank[j], tok[j] = r, k, -1, -1
            if k >= 0:
                prev[k] = i
            for p in (prev[i], i):
                if p >= 0:
                    q = nxt[p]
                    new = pair.get(tok[p] * size + tok[q], -1) if q >= 0 else -1
                    rank[p] = new
                    if new >= 0:
                        bucket = queue.setdefault(new, [])
                        ordered[new] = ordered.get(new, True) and (not bucket or bucket[-1] > p)
                        bucket.append(p)
                        bits.add(new)
        return [t for t in tok if t >= 0]

    def merge_many(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces data[at[i]:at[i+1]] one after another, and how many each has."""
        n, lengths = len(data), np.diff(at)
        tok = self.byte[data]
        piece = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        nxt = np.arange(1, n + 1, dtype=np.int32)
        prev = np.arange(-1, n - 1, dtype=np.int32)
        full = lengths > 0
        nxt[at[1:][full] - 1] = -1
        prev[at[:-1][full]] = -1
        rank = np.full(n, NONE, np.int32)
        inner = np.flatnonzero(nxt >= 0)
        rank[inner] = self.join(tok[inner], tok[inner + 1])
        queue: dict[int, list[np.ndarray]] = {}
        bits = RankBits(self.size)

        def push(where: np.ndarray) -> None:
            r = rank[where]
            live = r != NONE
            where, r = where[live], r[live]
            if not len(where):
                return
            order = np.argsort(r, kind="stable")
            where, r = where[order], r[order]
            cuts = np.flatnonzero(np.diff(r)) + 1
            begin = 0
            for end, x in zip([*cuts.tolist(), len(r)], r[[0, *cuts.tolist()]].tolist(), strict=True):
                if x in queue:
                    queue[x].append(where[begin:end])
                else:
                    queue[x] = [where[begin:end]]
                    bits.add(x)
                begin = end

        push(inner)
        while (r := bits.first()) >= 0:
            bits.discard(r)
            entries = queue.pop(r)
            where = entries[0] if len(entries) == 1 else np.unique(np.concatenate(entries))
            where = where[rank[where] == r]
            if not len(where):
                continue
            if len(where) > 1:
                own = piece[where]
                wait = np.empty(len(where), bool)
                wait[0] = False
                np.equal(own[1:], own[:-1], out=wait[1:])
                if wait.any():
                    queue[r] = [where[wait]]
                    bits.add(r)
                    where = where[~wait]
            j = nxt[where]
            k = nxt[j]
            tok[where] = r
            tok[j] = -1
            rank[j] = NONE
            nxt[where] = k
            inside = k >= 0
            prev[k[inside]] = where[inside]
            rank[where] = NONE
            left = where[inside]
            rank[left] = self.join(tok[left], tok[k[inside]])
            p = prev[where]
            has = p >= 0
            p = p[has]
            rank[p] = self.join(tok[p], tok[where[has]])
            push(np.concatenate([left, p]))
        alive = tok >= 0
        counts = np.add.reduceat(alive, at[:-1][full], dtype=np.int64) if full.any() else np.empty(0, np.int64)
        out = np.zeros(len(lengths), np.int64)
        out[full] = counts
        return tok[alive], out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        starts = self.token_at[ids]
        return self.token_bytes[K.ragged(starts, self.token_at[ids + 1] - starts)]


@functools.lru_cache(2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def ends_a_word(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the byte before each place is known to end a character that is no white space."""
    one = data[at - 1]
    two = data[np.maximum(at - 2, 0)]
    three = data[np.maximum(at - 3, 0)]
    wide = (one >= 0x80) & (((two >= 0xC3) & (two < 0xE0)) | ((two >= 0x80) & (two < 0xC0) & (three >= 0xE4) & (three < 0xF0)))
    return _SAFE[one] | wide


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each unit starts (then the end), and the number of the first unit of each text.

    A unit ends before white space that follows a byte known to end a character which is no white
    space, and at the end of a text.
    """
    n = len(data)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    space = np.flatnonzero(K.IS_SPACE[data])
    space = space[space > 0]
    cut = np.zeros(n + 1, bool)
    cut[space[ends_a_word(data, space)]] = True
    cut[offsets] = True
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts, offsets)


class Encoder:
    """Encodes units by the rank queue; made once in each Python worker."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks, self.split = ranks(path), regex.compile(pattern)

    def pieces(self, unit: list[str]) -> tuple[list[bytes], np.ndarray]:
        """The matches of the pattern in each unit, and how many a unit has.

        Units without white space but for one leading space are split in one pass over all of them,
        with a line feed between two: it stands alone there, as a match of its own.
        """
        plain = [i for i, u in enumerate(unit) if len(u.split()) == 1 and not u[:1].isspace() or u[:1] == " " and u[1:2] > " " and len(u.split()) == 1]
        taken = self.split.findall("\n".join([unit[i] for i in plain])) if plain else []
        ends = [i for i, p in enumerate(taken) if p == "\n"]
        begins = [0, *[i + 1 for i in ends]]
        if len(begins) != len(plain) or "\x85" in taken or "\u2028" in taken:
            plain, begins, ends = [], [], []
        counts = np.zeros(len(unit), np.int64)
        parts: list[list[str]] = [[]] * len(unit)
        for i, a, b in zip(plain, begins, [*ends, len(taken)] if plain else [], strict=True):
            parts[i] = taken[a:b]
            counts[i] = b - a
        for i in set(range(len(unit))).difference(plain) if len(plain) < len(unit) else ():
            parts[i] = self.split.findall(unit[i])
            counts[i] = len(parts[i])
        return [p.encode() for own in parts for p in own], counts

    def __call__(self, unit: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units one after another, and how many each has."""
        found, counts = self.pieces(unit)
        number: dict[bytes, int] = {}
        which = np.fromiter((number.setdefault(p, len(number)) for p in found), np.int64, len(found))
        found = list(number)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        short = np.where(lengths > LONG, 0, lengths)
        ids, made = self.ranks.merge_many(np.frombuffer(b"".join(p for p in found if len(p) <= LONG), np.uint8), K.bounds(short))
        parts, at, begin = [], K.bounds(made), 0
        for i in np.flatnonzero(lengths > LONG).tolist():
            own = np.array(self.ranks.merge_long(found[i]), np.int32)
            parts += [ids[begin : at[i]], own]
            begin, made[i] = at[i], len(own)
        ids = np.concatenate([*parts, ids[begin:]])
        at = K.bounds(made)
        made = made[which]
        return ids[K.ragged(at[:-1][which], made)], np.diff(K.bounds(made)[K.bounds(counts)])


class Memo:
    """Ids of the units that this worker has met, at most about `most`; then it begins anew."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 400_000) -> None:
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.seen, self.ids, self.ends = K.Seen(20), K.Growing(np.int32), K.Growing(np.int64)

    def learn(self, data: np.ndarray, at: np.ndarray) -> None:
        """Encodes the new distinct units data[at[i]:at[i+1]]."""
        spans = getattr(self.encode, "spans", None)
        if spans:
            ids, made = spans(data, at)
        else:
            raw, where = data.tobytes(), at.tolist()
            ids, made = self.encode([raw[a:b].decode() for a, b in zip(where, where[1:])])
        self.seen.add(data, at[:-1], at[1:])
        base = self.ids.n
        self.ids.append(ids)
        self.ends.append(base + np.cumsum(made))

    def ids_of(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered units one after another, and where those of each begin."""
        ends = self.ends.now
        start = np.where(number > 0, ends[number - 1], 0) if len(ends) else np.zeros(len(number), np.int64)
        size = (ends[number] if len(ends) else start) - start
        return self.ids.now[K.ragged(start, size)], K.bounds(size)


def encoded(memo: Memo, batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with the ids of their texts one after another, and where those of each begin.

    Units new to the memo are encoded together for several runs at a time.
    """
    for group in K.portions(batches, text, 2 * most):
        if len(memo.seen) > memo.most:
            memo.clear()
        runs, fresh, sizes = [], [], []
        for run in K.portions(iter([group]), text, most):
            data, offsets = K.texts(K.column(run, text))
            starts, text_at = units(data, offsets)
            number = memo.seen.find(data, starts[:-1], starts[1:])
            new = np.flatnonzero(number < 0)
            first, which = K.distinct_spans(data, starts[:-1][new], starts[1:][new])
            first = new[first]
            size = starts[first + 1] - starts[first]
            fresh.append(data[K.ragged(starts[first], size)])
            sizes.append(size)
            runs.append((run, number, new, which, text_at))
        every, at = np.concatenate(fresh), K.bounds(np.concatenate(sizes))
        first, again = K.distinct_spans(every, at[:-1], at[1:])
        base, size = len(memo.seen), np.diff(at)[first]
        memo.learn(every[K.ragged(at[:-1][first], size)], K.bounds(size))
        begin = 0
        for (run, number, new, which, text_at), size in zip(runs, sizes, strict=True):
            number[new] = base + again[begin : begin + len(size)][which]
            begin += len(size)
            ids, ids_at = memo.ids_of(number)
            yield run, ids, ids_at[text_at]


def memo(path: str, pattern: str) -> Memo:
    return K.held(("bpe", path, pattern), lambda: Memo(Encoder(path, pattern)))


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`df` with a column of token ids (array<int>).

    Null and empty texts have no ids. Other columns, repeated rows and null keys pass as they are; a
    column of the input named like `ids` is replaced.
    """
    base = df.drop(ids)
    schema = T.StructType([*base.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, at in encoded(memo(path, pattern), batches, text):
            values = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, ids])

    return base.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """`df` with the decoded bytes of a column of ids as a binary column; null ids give null."""
    base = df.drop(text)
    schema = T.StructType([*base.schema.fields, T.StructField(text, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path)
        for batch in batches:
            out = [None if v is None else table.decode(np.array(v, np.int64)).tobytes() for v in K.column(batch, ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, text])

    return base.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: number of ids, SHA-256 of the decimal ids joined by a space, and of the bytes that
    decoding these ids gives. The same steps as `encode` and `decode`, without the ids in between
    leaving the task, unless `with_ids` adds them. Null text is empty text."""
    schema = T.StructType([df.schema[key], *T.StructType.fromDDL(DIGEST + ", ids array<int>" * with_ids).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = ranks(path)
        names = [str(i).encode() + b" " for i in range(vocabulary.size)]
        name_bytes = np.frombuffer(b"".join(names), np.uint8)
        name_at = K.bounds(np.array([len(x) for x in names], np.int64))
        for batch, flat, at in encoded(memo(path, pattern), batches, text):
            digests = []
            for table, table_at, cut in ((name_bytes, name_at, 1), (vocabulary.token_bytes, vocabulary.token_at, 0)):
                sizes = (table_at[1:] - table_at[:-1])[flat]
                out = memoryview(table[K.ragged(table_at[:-1][flat], sizes)])
                where = K.bounds(sizes)[at].tolist()
                digests.append([hashlib.sha256(out[a : max(a, b - cut)]).hexdigest() for a, b in zip(where, where[1:])])
            out = [K.column(batch, key), pa.array(np.diff(at)), *[pa.array(d, pa.string()) for d in digests]]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return df.select(key, F.col(text)).mapInArrow(run, schema)
