"""Near copies: five-word shingles with a Jaccard similarity of 0.8 or more, all of them.

Equal texts are one class. Classes become candidate pairs in three ways:

1. SimHash: one fingerprint of the distinct words of each text, compared bit-sliced within the buckets
   of `simhash`; a bucket links each text to the least of its group.
2. Hubs: shingles have one order, rare ones first; of two sets with a Jaccard similarity of `least`, each
   has a common shingle among its first |s| - ceil(least |s|) + 1 (its prefix). Every text is paired with
   one text of each shingle of its prefix, one that has it early: few shingles of that text are its own.
3. Pivots: pairs of 1 and 2 are verified on the exact shingles and joined to groups. Where common shingles are
   still open, each text outside a shingle's largest group is paired with two texts of that group and one outside it,
   and what is near is joined; again while that halves the open pairs. Each such round has at most three pairs
   for each text of a shingle.
4. The rest: all pairs that share a shingle in their prefixes and are in two groups by then are verified. At
   least one text of such a pair is outside the largest group of the shingle, so a family of copies that is joined
   already costs nothing, however large.

So no near pair is lost: it is verified, or its ends are chained by verified pairs.

Most shingles of a prefix occur in one text only. They are sieved out before rows are made of them: each
batch sends 32 bits of each shingle to its range of a bitmap of fixed size, and only shingles whose bit is
set, since two batches or two texts of one batch have it, go on. The sieve lets some others pass, never
fewer; the exact grouping comes after it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .components import connected_components
from .shared import kept, new_table, removed, small_enough, written
from .simhash import fold, near_stars

RADIUS = 2
#: Shingles are ordered by how common they are by 2 to this power counters (4 MB); any order is exact.
SKETCH = 22
#: Texts of one shingle that a task takes from the one side, with all of the other.
PART = 1024
#: Open pairs for each text of an open shingle from which pivots are taken; below it the rest is as small.
OPEN = 4
#: The sieve has 2 to this power bits: 32 MB.
BITS = 28
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _words(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = K.texts(values)
    data = _LOWER[data]
    starts, ends, at = K.words(data, offsets)
    return K.hash_spans(data, starts, ends), at


def _distinct(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each run, sorted, and how many each run has."""
    own = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[new], np.bincount(own[new], minlength=len(at) - 1)


def _shingles(h: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of `width` words in a row, of all words if there are fewer; and how many each text has."""
    size = np.diff(at)
    n = np.where(size >= width, size - width + 1, np.minimum(size, 1))
    first = K.ragged(at[:-1], n).astype(np.int64)
    last = np.repeat(at[1:], n)
    s = np.zeros(len(first), np.uint64)
    for i in range(width):
        there = first + i < last
        s[there] = K.mix(s[there] ^ h[first[there] + i])
    return _distinct(s, K.bounds(n))


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(K.bounds(counts).astype(np.int32)), pa.array(flat.view(np.int64)))


def commonness(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """A count-min sketch of all shingles of all texts in one row of 2 ** SKETCH counters, as the logarithms of the
    counts: the counter of a shingle is that of the first SKETCH bits of its hash. Each task adds up its own
    counters, and ranges of them are added up over the tasks; what passes through the driver has a fixed size."""
    some, ranges = docs.select(F.col(text).alias("__text")), 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.alone("near")
        total = np.zeros(1 << SKETCH, np.uint32)
        for batch in K.portions(batches, "__text", 2 << 20):
            flat, _ = _shingles(*_words(K.column(batch, "__text")), width)
            place, n = np.unique((flat >> np.uint64(64 - SKETCH)).astype(np.int64), return_counts=True)
            total[place] += n.astype(np.uint32)
        pack = zstandard.ZstdCompressor(level=1)
        parts = [pack.compress(x.tobytes()) for x in total.reshape(ranges, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(ranges, dtype=np.int32)), pa.array(parts, pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, sums = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for part, own in zip(K.column(batch, "part").to_pylist(), K.column(batch, "counts"), strict=True):
                counts = np.frombuffer(unpack.decompress(own.as_buffer()), np.uint32)
                sums[part] = sums[part] + counts if part in sums else counts.astype(np.int64)
        for part, counts in sums.items():
            level = np.minimum(np.round(8 * np.log2(counts + 1.0)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["part", "levels"])

    sent = some.mapInArrow(count, "part int, counts binary").repartition(ranges, "part")
    whole = np.zeros((ranges, (1 << SKETCH) // ranges), np.uint8)
    for part, levels in sent.mapInArrow(add, "part int, levels binary").toLocalIterator():
        whole[part] = np.frombuffer(levels, np.uint8)
    return whole.reshape(-1)


def heads(docs: DataFrame, key: str, text: str, width: int, least: float, common: np.ndarray) -> DataFrame:
    """(key, copy, fp, size, prefix): copy is a hash of the text, fp its SimHash, size how many distinct
    shingles it has, and prefix those of its prefix in the order of `common`, the rarest first. Of equal texts
    that come together, one has the prefix."""
    source = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("copy"), F.col(text).alias("__text"))
    schema = T.StructType([source.schema["key"], *T.StructType.fromDDL("copy long, fp long, size int, prefix array<long>").fields])
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.alone("near")
        common = shared.value
        for batch in K.portions(batches, "__text", 2 << 20):
            _, one, which = np.unique(K.column(batch, "copy").to_numpy(), return_index=True, return_inverse=True)
            words, at = _words(K.column(batch, "__text").take(pa.array(one)))
            fp = fold(*_distinct(words, at))
            h, size = _shingles(words, at, width)
            order = common[h >> np.uint64(64 - SKETCH)]
            h = h[np.lexsort((h, order, np.repeat(np.arange(len(size)), size)))]
            n = np.where(size > 0, size - np.ceil(least * size - 1e-9).astype(np.int64) + 1, 0)
            own = np.zeros(len(batch), np.int64)
            own[one] = n
            start = np.zeros(len(batch), np.int64)
            start[one] = K.bounds(size)[:-1]
            prefix = _lists(h[K.ragged(start, own)], own)
            yield pa.RecordBatch.from_arrays(
                [K.column(batch, "key"), K.column(batch, "copy"), pa.array(fp.view(np.int64)[which]), pa.array(size[which].astype(np.int32)), prefix], names=["key", "copy", "fp", "size", "prefix"]
            )

    return source.mapInArrow(run, schema)


def sieve(tops: DataFrame, size: int) -> Broadcast:
    """A bitmap with the bit of every shingle that two texts of `tops(copy, prefix)` have in their prefixes;
    `size` is about how many shingles there are."""
    k = min(20, max(8, math.ceil(math.log2(max(1, size) / (1 << 20) + 1))))  # 2 ** k ranges of the bitmap

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.alone("near")
        for batch in batches:
            lists = K.column(batch, "prefix")
            s, n = np.unique(lists.flatten().to_numpy().view(np.uint64), return_counts=True)
            at = np.searchsorted(s >> np.uint64(64 - k), np.arange((1 << k) + 1, dtype=np.uint64))
            short = (s >> np.uint64(32 - k)).astype(np.uint32)
            some = np.flatnonzero(np.diff(at))
            parts = [(short[a:b], n[a:b] > 1) for a, b in zip(at[some], at[some + 1], strict=True)]
            columns = [pa.array(some.astype(np.int32)), pa.array([x[~m].tobytes() for x, m in parts], pa.binary()), pa.array([x[m].tobytes() for x, m in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "once", "more"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def bits() -> pa.RecordBatch:
            once, more = (np.frombuffer(b"".join(x[i] for x in held), np.uint32) for i in (0, 1))
            once = np.sort(once)
            places = np.concatenate([once[1:][once[1:] == once[:-1]], more, np.intersect1d(once, more)]) >> np.uint32(k + 32 - BITS)
            out = np.zeros(1 << (BITS - k), bool)
            out[places] = True
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

        for batch in batches:
            for part, once, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now and held:
                    yield bits()
                    held = []
                now = part
                held.append((once, more))
        if held:
            yield bits()

    session = tops.sparkSession
    sent = tops.select("prefix").mapInArrow(send, "part int, once binary, more binary")
    together = sent.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), (1 << k) >> 4), "part").sortWithinPartitions("part")
    found = together.mapInArrow(meet, "part int, bits binary").toArrow()
    whole = np.zeros((1 << k, 1 << (BITS - k - 3)), np.uint8)
    for part, bits in zip(found["part"].to_pylist(), found["bits"], strict=True):
        whole[part] = np.frombuffer(bits.as_buffer(), np.uint8)
    return session.sparkContext.broadcast(whole.reshape(-1))


def entries(tops: DataFrame, bitmap: Broadcast) -> DataFrame:
    """(s, copy, size, pos): the shingles that the sieve lets pass, and where they stand in their prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.alone("near")
        bits = bitmap.value
        for batch in batches:
            lists = K.column(batch, "prefix")
            n = lists.value_lengths().to_numpy().astype(np.int64)
            s = lists.flatten().to_numpy().view(np.uint64)
            place = s >> np.uint64(64 - BITS)
            hit = np.flatnonzero(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
            row = np.repeat(np.arange(len(n)), n)[hit]
            pos = hit - K.bounds(n)[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s[hit].view(np.int64)), K.column(batch, "copy").take(pa.array(row)), K.column(batch, "size").take(pa.array(row)), pa.array(pos.astype(np.int32))], names=["s", "copy", "size", "pos"]
            )

    return tops.select("copy", "size", "prefix").mapInArrow(run, "s long, copy long, size int, pos int")


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def simhash_pairs(tops: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs u < v of texts linked by near fingerprints."""
    classes = tops.where("size > 0").select("copy", "fp").distinct()
    firsts = classes.groupBy("fp").agg(F.min("copy").alias("first"))
    same = classes.join(firsts, "fp").where("copy <> first").select(*_pair(F.col("copy"), F.col("first")))
    links = near_stars(firsts.select("fp"), radius)
    for end in ("u", "v"):
        links = links.join(firsts.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_")), end)
    return same.unionByName(links.select(*_pair(F.col("u_"), F.col("v_"))))


def _may_be_near(a: str, b: str, least: float) -> Column:
    """For two texts with a shingle: whether sizes and places allow `least` if it is the first shingle
    that both prefixes hold, as one is of every near pair."""
    size, other = F.col(f"{a}.size"), F.col(f"{b}.size")
    most = F.least(size - F.col(f"{a}.pos"), other - F.col(f"{b}.pos"))
    return most >= (size + other) * (least / (1 + least)) - 1e-6


def met(live: DataFrame) -> DataFrame:
    """`live(s, copy, size, pos)` with hub: the text of the shingle that has it earliest; only shingles of two texts or more."""
    hubs = live.groupBy("s").agg(F.min(F.struct("pos", "copy", "size")).alias("hub"), F.min("copy").alias("first"), F.max("copy").alias("last"))
    return live.join(hubs.where("first < last").drop("first", "last"), "s")


def hub_pairs(shared: DataFrame, least: float) -> DataFrame:
    """Pairs u < v of each text of a shingle with the shingle's hub."""
    own = F.struct("copy", "size", "pos")
    both = shared.select(own.alias("own"), "hub").where((F.col("own.copy") != F.col("hub.copy")) & _may_be_near("own", "hub", least))
    return both.select(*_pair(F.col("own.copy"), F.col("hub.copy")))


def open_shingles(shared: DataFrame, edges: DataFrame, path: str) -> tuple[DataFrame, int, int]:
    """The texts of shingles that `edges` leave in two groups or more, written to `path`: (s, copy, size, pos, root, top,
    parts), top the largest group of the shingle; how many they are; and how many pairs at most are open."""
    roots = connected_components(edges).withColumnRenamed("node", "copy")
    named = shared.select("s", "copy", "size", "pos").join(roots, "copy", "left").withColumn("root", F.coalesce("root", "copy"))
    named = named.dropDuplicates(["s", "copy"])
    groups = named.groupBy("s", "root").agg(F.count("*").alias("n")).groupBy("s")
    several = groups.agg(F.max(F.struct("n", "root"))["root"].alias("top"), F.sum("n").alias("all"), F.count("*").alias("groups")).where("groups > 1")
    live = written(named.join(several.select("s", "top", F.ceil(F.col("all") / PART).cast("int").alias("parts"), "all"), "s"), "open-shingles", path)
    n, pairs = live.agg(F.count("*"), F.sum(F.when(F.col("root") != F.col("top"), F.col("all")))).first()
    return live.drop("all"), n, pairs or 0


def pivot_pairs(live: DataFrame, least: float) -> DataFrame:
    """Distinct pairs u < v of the texts outside the largest group of an open shingle with two texts of that group,
    the earliest and any, and with the earliest text outside it."""
    early, inside = F.struct("pos", "copy", "size", "root"), F.col("root") == F.col("top")
    any_one = F.struct(F.xxhash64("copy", "s").alias("h"), "pos", "copy", "size", "root")
    ends = live.groupBy("s").agg(F.min(F.when(inside, early)).alias("p0"), F.min(F.when(inside, any_one)).alias("p1"), F.min(F.when(~inside, early)).alias("p2"))
    others = [F.struct(*[F.col(f"{p}.{c}").alias(c) for c in ("copy", "size", "pos", "root")]) for p in ("p0", "p1", "p2")]
    outside = live.where(~inside).select("s", F.struct("copy", "size", "pos", "root").alias("own"))
    both = outside.join(ends.select("s", F.array(*others).alias("others")), "s").select("own", F.explode("others").alias("other"))
    near = (F.col("own.root") != F.col("other.root")) & _may_be_near("own", "other", least)
    return both.where(near).select(*_pair(F.col("own.copy"), F.col("other.copy"))).distinct()


def rest_pairs(live: DataFrame, least: float) -> DataFrame:
    """Distinct pairs u < v of texts of an open shingle in two groups; a common shingle is dealt to parts. One end of
    each pair is outside the largest group of the shingle."""
    a = live.where("root <> top").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    b = live.withColumn("part", F.pmod(F.xxhash64("copy"), F.col("parts")).cast("int"))
    once = (F.col("b.root") == F.col("b.top")) | (F.col("a.copy") < F.col("b.copy"))
    same = (F.col("a.s") == F.col("b.s")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.root") != F.col("b.root")) & once
    return a.alias("a").join(b.alias("b"), same & _may_be_near("a", "b", least)).select(*_pair(F.col("a.copy"), F.col("b.copy"))).distinct()


def _packed(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(node, packed): the texts of the classes `wanted`, compressed."""
    source = docs.select(F.xxhash64(text).alias("node"), F.col(text).alias("__text")).join(small_enough(wanted), "node", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.alone("near")
        pack = zstandard.ZstdCompressor(level=3)
        for batch in K.portions(batches, "__text"):
            node, one = np.unique(K.column(batch, "node").to_numpy(), return_index=True)
            raw = K.column(batch, "__text").take(pa.array(one)).cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([pack.compress(t.as_buffer()) for t in raw], pa.binary())], names=["node", "packed"])

    return source.mapInArrow(run, "node long, packed binary").dropDuplicates(["node"])


def _near(batches: Iterator[pa.RecordBatch], width: int, least: float) -> Iterator[pa.RecordBatch]:
    """The pairs (u, v) whose texts `a` and `b` are near."""
    K.alone("near")
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for part in K.portions(K.portions(iter([batch]), "a", 256 << 10), "b", 256 << 10):  # a few times as much when unpacked
            pairs = []
            for c in ("a", "b"):
                texts = pa.array([unpack.decompress(p.as_buffer()) for p in K.column(part, c)], pa.large_binary())
                pairs.append(_shingles(*_words(texts.cast(pa.large_string())), width))
            flat, counts = zip(*pairs, strict=True)
            row = np.concatenate([np.repeat(np.arange(len(part)), n) for n in counts])
            s = np.concatenate(flat)
            order = np.lexsort((s, row))
            s, row = s[order], row[order]
            common = np.bincount(row[1:][(s[1:] == s[:-1]) & (row[1:] == row[:-1])], minlength=len(part))
            near = np.flatnonzero(common >= least * (counts[0] + counts[1] - common) - 1e-9)
            yield part.select(["u", "v"]).take(pa.array(near))


def verified(pairs: DataFrame, docs: DataFrame, text: str, width: int, least: float) -> DataFrame:
    """The pairs whose texts have shingles of a Jaccard similarity of `least` or more."""
    spark, path = docs.sparkSession, new_table(docs.sparkSession, "packed-texts")
    wanted = kept(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct())
    texts = written(_packed(docs, text, wanted), "packed-texts", path)
    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("packed").alias("a")), "u").join(texts.select(F.col("node").alias("v"), F.col("packed").alias("b")), "v")
    edges = kept(both.mapInArrow(lambda batches: _near(batches, width, least), "u long, v long"))
    removed(spark, path)
    return edges


def near_edges(tops: DataFrame, docs: DataFrame, text: str, width: int, least: float, size: int) -> DataFrame:
    """Edges u, v of classes of `tops(copy, fp, size, prefix)` that connect exactly the groups chained by near pairs."""
    bitmap = sieve(tops, size)
    shared = kept(met(entries(tops, bitmap)))
    bitmap.destroy()
    tested = kept(simhash_pairs(tops).unionByName(hub_pairs(shared, least)).distinct())
    edges = verified(tested, docs, text, width, least)
    spark, before = docs.sparkSession, None
    while True:
        path = new_table(spark, "open-shingles")
        live, n, pairs = open_shingles(shared, edges, path)
        if pairs <= OPEN * n or before is not None and 2 * pairs > before:
            break
        more = kept(pivot_pairs(live, least).join(tested, ["u", "v"], "left_anti"))
        tested = kept(tested.unionByName(more))
        edges = kept(edges.unionByName(verified(more, docs, text, width, least)))
        removed(spark, path)
        before = pairs
    rest = kept(rest_pairs(live, least).join(tested, ["u", "v"], "left_anti"))
    removed(spark, path)
    return edges.unionByName(verified(rest, docs, text, width, least))


def near_copy_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """(key, component_id) per row: the least key of the documents joined by verified links.

    Equal texts (told by a 64-bit hash) are one class, without comparison; null is a text of its own
    class. Texts without words are never near another text. Words are split at the six white-space bytes
    and compared with A-Z in lower case. Keys are integers; rows with a null key have a null component_id,
    and stand for no class. Repeated rows give repeated rows. Other columns are not read.
    """
    spark, path = docs.sparkSession, new_table(docs.sparkSession, "near-heads")
    keyed = docs.where(F.col(key).isNotNull())
    tops = written(heads(keyed, key, text, width, least, commonness(keyed, text, width)), "near-heads", path)
    size = tops.agg(F.sum(F.size("prefix"))).first()[0] or 0
    roots = connected_components(near_edges(tops, keyed, text, width, least, size))
    classes = tops.groupBy("copy").agg(F.min(F.col("key").cast("long")).alias("first"))
    named = classes.join(roots.withColumnRenamed("node", "copy"), "copy", "left").withColumn("root", F.coalesce("root", "copy"))
    whole = named.groupBy("root").agg(F.min("first").alias("component_id"))
    out = kept(tops.select("key", "copy").join(named.select("copy", "root").join(whole, "root").drop("root"), "copy", "left"))
    removed(spark, path)
    without = docs.where(F.col(key).isNull()).select(F.col(key), F.lit(None).cast("long").alias("component_id"))
    return out.select(F.col("key").alias(key), "component_id").unionByName(without)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with one row for each group of near copies, that of the least key (of rows that repeat
    the key, one); rows with a null key stay. Only rows of keys that lose a row are looked up."""
    groups = near_copy_groups(docs, key, text, **options).where(F.col(key).isNotNull())
    by_key = groups.groupBy(key).agg(F.count("*").alias("__rows"), F.max(F.col("component_id") == F.col(key).cast("long")).alias("__stays"))
    judged = kept(by_key.where((F.col("__rows") > 1) | ~F.col("__stays")).select(key, "__stays"))
    lost = small_enough(judged.select(key))
    several = docs.join(small_enough(judged.where("__stays").select(key)), key, "left_semi").dropDuplicates([key])
    return docs.join(lost, key, "left_anti").unionByName(several)
