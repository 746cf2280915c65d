"""SimHash near-duplicate groups by bit-sliced comparison.

1. `fingerprints`: 64 bits per text from the XXH64 of its word shingles (numpy, one pass, no shuffle).
2. Candidates: 64 bits are cut into `radius + 4` blocks; two fingerprints within the radius agree on
   at least four whole blocks, so each choice of four blocks is a bucket key. No pair is missed.
3. `near_stars`: fingerprints of a bucket are stored as bit planes, 64 of them to a word. One
   fingerprint is compared with 64 others by XOR of planes; carry-save counters hold the distances,
   and a block whose lanes all exceed the radius is abandoned. A bucket gives each fingerprint's
   link to the least of its group in the bucket: as many rows as fingerprints, not pairs.
   A bucket of more than `TILE` fingerprints is dealt to tiles; every pair of tiles is a task of its
   own, so no comparison is lost and no task holds more than two tiles.
4. `connected_components` joins the links of all buckets.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .components import connected_components
from .shared import kept

#: Distinct fingerprints of one bucket that one task takes from each side.
TILE = 4096
#: (fingerprint, block) comparisons held at once.
AT_ONCE = 1 << 18

# eight 0/1 bytes for the eight bits of a byte, lowest bit in the lowest byte
_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def fold(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of counts[i] hashes: a bit is set if over half of them have it."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts > 0)
    if not len(full):
        return out
    size = counts[full]
    blocks = -(-size // 255)  # eight-bit counters hold 255
    block_at = K.bounds(blocks)
    at = np.repeat(K.bounds(size)[:-1], blocks) + 255 * (np.arange(block_at[-1]) - np.repeat(block_at[:-1], blocks))
    rows = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        lanes = np.add.reduceat(_SPREAD[rows[:, byte]], at).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes, block_at[:-1], axis=0, dtype=np.int64)
        bits = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little")[:, 0]
        out[full] |= bits.astype(np.uint64) << np.uint64(8 * byte)
    return out


def fingerprints_of(values: pa.Array, width: int, seed: int) -> np.ndarray:
    digest, hashes, counts = xxhash.xxh64_intdigest, array("Q"), np.zeros(len(values), np.int64)
    for i, text in enumerate(values.cast(pa.large_binary()).to_pylist()):
        own = text.lower().split() if text else []  # bytes: A-Z only, and the six white-space bytes
        if not own:
            continue
        joined = b" ".join(own)
        if len(own) <= width:
            hashes.append(digest(joined, seed))
            counts[i] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
        starts = [0, *ends[: len(own) - width].tolist()]
        hashes.extend([digest(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)])
        counts[i] = len(starts)
    return fold(np.frombuffer(hashes, np.uint64), counts)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp long): fp holds the 64 bits; null, empty and blank texts have fp 0."""
    schema = T.StructType([docs.schema[key], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.alone("simhash")
        for batch in K.portions(batches, text, 4 << 20):
            fp = fingerprints_of(K.column(batch, text), width, seed)
            yield pa.RecordBatch.from_arrays([K.column(batch, key), pa.array(fp.view(np.int64))], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(run, schema)


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64, blocks): bit b of the fingerprints, 64 fingerprints to a word."""
    blocks = -(-len(fps) // 64)
    padded = np.zeros(blocks * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(blocks, 64, 8), axis=2, bitorder="little")
    packed = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64)[:, :, 0]


def within(planes: np.ndarray, fps: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each comparison of fps[i] with the lanes of block[i]: which comparisons still have a lane
    within the radius, and the word of such lanes."""
    live = np.arange(len(fps))
    digits = max(2, (radius + 1).bit_length())
    counter = [np.zeros(len(fps), np.uint64) for _ in range(digits)]
    over = np.zeros(len(fps), np.uint64)

    def add(word: np.ndarray, digit: int) -> None:
        for d in range(digit, digits):
            counter[d], word = counter[d] ^ word, counter[d] & word
        np.bitwise_or(over, word, out=over)

    def beyond() -> np.ndarray:
        """Lanes whose count is over the radius."""
        more, equal = np.zeros_like(over), ~np.zeros_like(over)
        for d in reversed(range(digits)):
            if radius >> d & 1:
                equal = equal & counter[d]
            else:
                more, equal = more | equal & counter[d], equal & ~counter[d]
        return over | more

    def differs(bit: int) -> np.ndarray:
        own = np.uint64(0) - ((fps[live] >> np.uint64(bit)) & np.uint64(1))
        return planes[bit, block[live]] ^ own

    for bit in range(0, 63, 3):
        a, b, c = differs(bit), differs(bit + 1), differs(bit + 2)
        half = a ^ b
        add(half ^ c, 0)  # a carry-save adder: three planes become a sum and a carry
        add((a & b) | (half & c), 1)
        if bit % 9 == 6:
            keep = np.flatnonzero(~beyond())
            if len(keep) < 0.8 * len(live):
                live, over = live[keep], over[keep]
                counter = [x[keep] for x in counter]
            if not len(live):
                return live, over
    add(differs(63), 0)
    near = ~beyond()
    keep = np.flatnonzero(near)
    return live[keep], near[keep]


def stars(fps: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that join the near fingerprints of each bucket to the least of their group;
    bucket i holds sizes[i] distinct fingerprints."""
    blocks = -(-sizes // 64)
    block_at, at = K.bounds(blocks), K.bounds(sizes)
    lane = np.arange(len(fps)) - np.repeat(at[:-1], sizes)
    slot = 64 * np.repeat(block_at[:-1], sizes) + lane  # buckets begin at a block of their own
    padded = np.zeros(64 * block_at[-1], np.uint64)
    padded[slot] = fps
    used = np.zeros(64 * block_at[-1], bool)
    used[slot] = True
    planes, used = planes_of(padded), np.packbits(used, bitorder="little").view(np.uint64)
    member = np.full(64 * block_at[-1], -1, np.int64)
    member[slot] = np.arange(len(fps))
    who = np.repeat(np.arange(len(fps)), np.repeat(blocks, sizes))
    block = K.ragged(np.repeat(block_at[:-1], sizes), np.repeat(blocks, sizes)).astype(np.int64)
    root = np.arange(len(fps))
    for begin in range(0, len(who), AT_ONCE):
        own, at_block = who[begin : begin + AT_ONCE], block[begin : begin + AT_ONCE]
        live, near = within(planes, fps[own], at_block, radius)
        near = near & used[at_block[live]]
        bits = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, bit = np.nonzero(bits)
        a, b = own[live[row]], member[64 * at_block[live[row]] + bit]
        some = a < b
        a, b = a[some], b[some]
        while True:  # least label of the group, with pointer jumping
            low = np.minimum(root[a], root[b])
            was = root.copy()
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            root = root[root]
            if np.array_equal(root, was):
                break
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return fps[linked].view(np.int64), fps[root[linked]].view(np.int64)


def near_stars(distinct: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """Links u, v (long) that connect exactly the groups of `distinct(fp)` chained by distances of
    `radius` or less."""
    cuts = [round(64 * i / (radius + 4)) for i in range(radius + 5)]
    masks = [sum(((1 << cuts[b + 1]) - 1) ^ ((1 << cuts[b]) - 1) for b in four) for four in combinations(range(radius + 4), 4)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(signed)])).alias("k")).select("fp", "k.*")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    shared = keyed.groupBy("choice", "part").agg(F.count("*").alias("n")).where("n > 1").select("choice", "part", tiles.alias("tiles"))
    dealt = keyed.join(shared, ["choice", "part"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    buckets = dealt.groupBy("choice", "part", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).agg(F.collect_set("fp").alias("fps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.alone("simhash")
        for batch in batches:
            fps = batch.column(0)
            flat = fps.flatten().to_numpy().astype(np.int64).view(np.uint64)
            sizes = fps.value_lengths().to_numpy().astype(np.int64)
            ends = np.cumsum(sizes)
            begin = 0
            while begin < len(sizes):  # at most some tiles at a time
                done = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, done + 2 * tile, side="right")))
                u, v = stars(flat[done : ends[end - 1]], sizes[begin:end], radius)
                order = np.unique(np.stack([u, v]), axis=1) if len(u) else np.empty((2, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(order[0]), pa.array(order[1])], names=["u", "v"])
                begin = end

    return buckets.where(F.size("fps") > 1).select("fps").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(key, fingerprint, component_id): texts whose fingerprints are chained by distances of
    `radius` or less share the least key of their group.

    fingerprint is 16 lowercase hex digits. Null, empty and blank texts have the zero fingerprint,
    which links like any other. Repeated rows give repeated rows. A null key takes part through its
    text but is never a component_id, unless all keys of a group are null. Other columns are not read.
    """
    fps = kept(fingerprints(docs, key, text, width))
    classes = fps.groupBy("fp").agg(F.min(key).alias("least"))
    roots = connected_components(near_stars(classes.select("fp"), radius))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.select("fp", "root").join(whole, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with one row for each near-duplicate group: the row of the least key, and of rows that
    repeat it one. Rows with a null key are kept."""
    groups = near_duplicates(docs, key, text, **options)
    first = groups.where(F.col("component_id") == F.col(key)).select(key).distinct()
    return docs.join(first, key, "left_semi").dropDuplicates([key]).unionByName(docs.where(F.col(key).isNull()))
