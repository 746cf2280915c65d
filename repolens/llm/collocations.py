"""Phrases whose words stand together more often than their parts would by chance.

Frequent phrases are found in levels (words, pairs of words, then three to five words), each in two steps:

1. Each task counts hashes of the phrases of its texts in runs of bounded size and sends every run to its
   hash partitions. A partition merges them in a Misra-Gries summary whose capacity exceeds the mass of
   the partition divided by the threshold: whatever is taken off a counter in all is below the
   threshold, so every phrase that reaches it survives, and what survives sets a bit in a bitmap of fixed
   size. The next level counts only phrases whose parts have their bits.
2. A last pass counts the survivors exactly, by their words: a collision of hashes or of bits, or an
   infrequent survivor, costs a row in a shuffle and changes no count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .shared import written

#: Words of the longest phrase, and how often a phrase must occur.
WORDS, LEAST = 5, 100
#: A bitmap of survivors has 2 to this power bits: 8 MB.
BITS = 26
#: Counters that a task holds before it sends them, and that a partition should hold.
RUN = 1 << 20
#: Bytes of text that are worked on at once.
PORTION = 2 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_STOP = K.table(b".,;:!?\n\x0b\x0c\r")
_GAP = _STOP | K.table(b" \t")


class Tokens:
    """The words of a batch, lower-cased: exact numbers of (language, word), hashes, and where pieces end."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        data, offsets = K.texts(K.column(batch, "__text"))
        self.data = _LOWER[data]
        self.starts, self.ends, first = K.words(self.data, offsets, _GAP)
        codes = K.column(batch, "__lang").dictionary_encode()
        self.langs = codes.dictionary
        own = codes.indices.to_numpy().astype(np.int64)
        self.lang = np.repeat(own, np.diff(first))
        self.per_lang = np.bincount(own, np.diff(first), len(self.langs)).astype(np.int64)
        names, at = K.texts(self.langs)
        salt = K.hash_spans(names, at[:-1], at[1:])
        self.hash = K.mix(K.hash_spans(self.data, self.starts, self.ends) ^ salt[self.lang])
        stops = np.cumsum(_STOP[self.data])
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        self.piece = text + (stops[self.starts] if len(self.starts) else 0)  # both only grow along the batch

    def whole(self, n: int) -> np.ndarray:
        """Whether the n words from each on are in one piece."""
        last = len(self.hash) - n + 1
        return self.piece[: max(last, 0)] == self.piece[n - 1 :]

    def phrases(self, n: int, shorter: np.ndarray) -> np.ndarray:
        """Hashes of the n words from each on, from those of n - 1 words."""
        last = max(len(self.hash) - n + 1, 0)
        return K.mix(shorter[:last] * np.uint64(3) ^ self.hash[n - 1 :][:last]) if n > 1 else self.hash

    def numbers(self) -> np.ndarray:
        """Equal for equal words of one language, and for no others."""
        _, which = K.distinct_spans(self.data, self.starts, self.ends)
        return which.astype(np.int64) * len(self.langs) + self.lang

    def named(self, first: np.ndarray, n: int) -> pa.Array:
        """The n words from each of `first` on, joined by one space."""
        word = (first[:, None] + np.arange(n)).reshape(-1)
        size = self.ends[word] - self.starts[word] + 1
        padded = np.append(self.data, np.uint8(32))
        out = padded[K.ragged(self.starts[word], size)]
        upto = np.cumsum(size)
        out[upto - 1] = 32
        last = np.zeros(len(out), bool)
        last[upto[n - 1 :: n] - 1] = True
        ends = upto[n - 1 :: n] - np.arange(1, len(first) + 1)
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(out[~last]))]).cast(pa.string())


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h >> np.uint64(64 - int(math.log2(len(bits) * 8)))
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _frequent(tokens: Tokens, levels: list[np.ndarray], words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, hashes of all phrases of n words, which of them may be frequent) as far as `levels`, the bitmaps
    of words, pairs and longer phrases, are known: the next level's candidates, too."""
    h, good = None, None
    for n in range(1, words + 1):
        h = tokens.phrases(n, h)
        last = len(h)
        good = tokens.whole(n) & (good[:last] & good[1:][:last] if n > 1 else True)
        level = min(n, 3) - 1
        if level < len(levels):
            good[good] = _has(levels[level], h[good])
        yield n, h, good


def added(h: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, and the sum of the counts of each."""
    every, counts = np.concatenate(h), np.concatenate(n)
    order = np.argsort(every)
    every, counts = every[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, np.int64)
    return every[new], np.add.reduceat(counts, new) if len(new) else counts


def _first_bytes(h: np.ndarray) -> bytes:
    """The first six of the eight bytes of each hash: enough to tell phrases apart but for a few, which count together."""
    return np.ascontiguousarray((h >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_bytes(packed: pa.Buffer) -> np.ndarray:
    out = np.zeros((packed.size // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


class Summary:
    """A Misra-Gries summary that merges others: at most `capacity` counters stay, and `off`, what has been
    taken off each of them, is at most the mass divided by `capacity` + 1."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.off = capacity, 0
        self.h, self.n = np.empty(0, np.uint64), np.empty(0, np.int64)

    def merge(self, h: list[np.ndarray], n: list[np.ndarray]) -> None:
        self.h, self.n = added([self.h, *h], [self.n, *n])
        over = len(self.n) - self.capacity
        if over > 0:
            cut = np.partition(self.n, over - 1)[over - 1]  # the largest count that does not fit
            stays = self.n > cut
            self.h, self.n = self.h[stays], self.n[stays] - cut
            self.off += int(cut)


def _source(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """Texts with their language; null is `und`, and an empty text."""
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("__lang"), F.col(text).alias("__text"))


def runs(source: DataFrame, levels: list[Broadcast], parts: int, lengths: list[int]) -> DataFrame:
    """(part, mass, h, n): counts of the candidates of `lengths` words, in runs of distinct hashes for each of
    the `parts` (a power of two) ranges of hashes, packed; and before them in order, a row with the mass of each."""
    shift, most = np.uint64(64 - int(math.log2(parts))), max(lengths)

    def packed(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        at = np.searchsorted(h >> shift if parts > 1 else h * np.uint64(0), np.arange(parts + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(at))
        cuts = list(zip(at[some].tolist(), at[some + 1].tolist(), strict=True))
        mass = np.add.reduceat(n, at[some]) if len(some) else n
        none = [None] * len(some)
        columns = [
            pa.array(np.tile(some.astype(np.int32), 2)), pa.array([*mass.tolist(), *none], pa.int64()),
            pa.array([*none, *(_first_bytes(h[a:b]) for a, b in cuts)], pa.binary()), pa.array([*none, *(n[a:b].astype("<i8").tobytes() for a, b in cuts)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["part", "mass", "h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.alone("collocations")
        bits = [b.value for b in levels]
        held_h, held_n, held = [], [], 0
        for batch in K.portions(batches, "__text", PORTION):
            tokens = Tokens(batch)
            for n, h, good in _frequent(tokens, bits, most):
                if n in lengths:
                    own = np.sort(h[good])
                    new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
                    held_h.append(own[new])
                    held_n.append(np.diff(new, append=len(own)))
                    held += len(new)
            if held > RUN:
                h, n = added(held_h, held_n)
                held_h, held_n, held = [h], [n], len(h)
                if held > RUN // 2:
                    yield packed(h, n)
                    held_h, held_n, held = [], [], 0
        if held:
            yield packed(*added(held_h, held_n))

    return source.mapInArrow(run, "part int, mass long, h binary, n binary")


def survivors(sent: DataFrame, parts: int, least: int, bits: int = BITS) -> Broadcast:
    """A bitmap with the bit of every hash that occurs `least` times in `runs`. The masses of a partition come
    before its counters, so its capacity is known when the first is merged."""
    session, shift = sent.sparkSession, int(math.log2(parts))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.alone("collocations")
        now, mass, summary, h, n, held = None, 0, None, [], [], 0

        def marked() -> pa.RecordBatch:
            summary.merge(h, n)
            often = summary.h[summary.n + summary.off >= least]
            out = np.zeros(1 << (bits - shift), bool)
            out[(often >> np.uint64(64 - bits)).astype(np.int64) & ((1 << (bits - shift)) - 1)] = True
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

        for batch in batches:
            for part, more, one, count in zip(*(K.column(batch, c) for c in ("part", "mass", "h", "n")), strict=True):
                if part.as_py() != now:
                    if now is not None:
                        yield marked()
                    now, mass, summary, h, n, held = part.as_py(), 0, None, [], [], 0
                if more.is_valid:
                    mass += more.as_py()
                    continue
                summary = summary or Summary(mass // least + 1)
                h.append(_from_bytes(one.as_buffer()))
                n.append(np.frombuffer(count.as_buffer(), np.int64))
                held += len(h[-1])
                if held > RUN:
                    summary.merge(h, n)
                    h, n, held = [], [], 0
        if now is not None:
            yield marked()

    together = sent.repartition(parts, "part").sortWithinPartitions("part", F.desc_nulls_last("mass"))
    found = together.mapInArrow(meet, "part int, bits binary").toArrow()  # 2 ** bits in all
    whole = np.zeros((parts, 1 << (bits - shift - 3)), np.uint8)
    for part, own in zip(found["part"].to_pylist(), found["bits"], strict=True):
        whole[part] = np.frombuffer(own.as_buffer(), np.uint8)
    return session.sparkContext.broadcast(whole.reshape(-1))


def _ids(tokens: Tokens, n: int, shorter: np.ndarray, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the phrases of n words at `at`: exact numbers by place, the first place of each, and its count."""
    key = words[at] if n == 1 else shorter[at] * (int(words.max(initial=0)) + 1) + words[at + n - 1]
    _, first, which, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    out = np.full(len(words), -1, np.int64)
    out[at] = which
    return out, at[first], count


def _summed(tables: list[pa.Table]) -> pa.Table:
    """One row for each phrase of the tables (h, lang, words, phrase, f)."""
    every = pa.concat_tables(tables).group_by(["h", "lang", "words", "phrase"]).aggregate([("f", "sum")])
    return every.rename_columns({"f_sum": "f"}).combine_chunks()


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def exact_counts(source: DataFrame, levels: list[Broadcast], parts: int, least: int, words: int = WORDS) -> DataFrame:
    """(lang, words, phrase, f) of the phrases that occur `least` times or more, and for each language how many
    words it has, as the count of the phrase of no words. A task adds up its own phrases and sends them, packed,
    to their hash partitions; these add up what comes in, by the words and not by the hash."""
    shift = np.uint64(64 - int(math.log2(parts)))

    def by_part(table: pa.Table) -> pa.RecordBatch:
        h = table["h"].combine_chunks().to_numpy()
        part = h >> shift if parts > 1 else np.zeros(len(h), np.uint64)
        order = np.argsort(part, kind="stable")
        at = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(at))
        ordered = table.take(pa.array(order))
        packed = [_packed(ordered.slice(at[i], at[i + 1] - at[i]).combine_chunks()) for i in some.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(packed, pa.binary())], names=["part", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.alone("collocations")
        bits, rows = [b.value for b in levels], []
        for batch in K.portions(batches, "__text", PORTION):
            tokens = Tokens(batch)
            number, ids = tokens.numbers(), None
            own = np.flatnonzero(tokens.per_lang)
            rows.append(_rows(np.zeros(len(own), np.uint64), tokens.langs.take(pa.array(own)), 0, pa.array([""] * len(own), pa.string()), tokens.per_lang[own]))
            for n, h, good in _frequent(tokens, bits, words):
                ids, first, f = _ids(tokens, n, ids, number, np.flatnonzero(good))
                if len(first):
                    rows.append(_rows(h[first], tokens.langs.take(pa.array(tokens.lang[first])), n, tokens.named(first, n), f))
            if sum(map(len, rows)) > RUN:
                rows = [_summed(rows)]
                if len(rows[0]) > RUN // 2:
                    yield by_part(rows.pop())
        if rows:
            yield by_part(_summed(rows))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tables = None, []

        def frequent() -> list[pa.RecordBatch]:
            table = _summed(tables)
            table = table.filter((pc.field("f") >= least) | (pc.field("words") == 0))
            return table.select(["lang", "words", "phrase", "f"]).to_batches()

        for batch in batches:
            for part, counts in zip(K.column(batch, "part").to_pylist(), K.column(batch, "counts"), strict=True):
                if part != now and tables:
                    yield from frequent()
                    tables = []
                now = part
                tables.append(pa.ipc.open_stream(counts.as_buffer()).read_all())
                if sum(map(len, tables[1:])) > max(RUN, len(tables[0])):
                    tables = [_summed(tables)]
        if tables:
            yield from frequent()

    sent = source.mapInArrow(count, "part int, counts binary")
    return sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(add, "lang string, words int, phrase string, f long")


def _rows(h: np.ndarray, langs: pa.Array, n: int, phrases: pa.Array, counts: np.ndarray) -> pa.Table:
    return pa.table({"h": h, "lang": langs.cast(pa.string()), "words": np.full(len(counts), n, np.int32), "phrase": phrases, "f": counts.astype(np.int64)})


def frequent_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """The written (lang, words, phrase, f) of all phrases of up to `words` words that occur `least` times or
    more in texts of their language, and of the phrase of no words, which is the language's number of words.

    A-Z are lower-cased; `[.,;:!?\\x0A-\\x0D]` end pieces, and words are parted by spaces and tabs. Overlapping
    occurrences count. Null languages are `und`, null texts empty. Other columns are not read; an empty
    table gives no rows. The number of hash partitions follows from the size of the texts, so that a
    summary has about `RUN` counters.
    """
    spark, source = docs.sparkSession, _source(docs, lang, text)
    # a word has a byte at least and another beside it: an upper bound of the words of all texts
    bound = source.agg(F.sum(F.expr("(octet_length(__text) + 1) div 2"))).first()[0] or 0
    at_once = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = 1 << min(bits - 3, max(math.ceil(math.log2(at_once)), math.ceil(math.log2(bound / (least * RUN) + 1))))
    levels: list[Broadcast] = []
    for lengths in ([1], [2], list(range(3, words + 1))):
        if lengths:
            levels.append(survivors(runs(source, levels, parts, lengths), parts, least, bits))
    found = written(exact_counts(source, levels, parts, least, words), "phrases")
    for level in levels:
        level.destroy()
    return found


def _first(k: Column) -> Column:
    """The first k words of `phrase`."""
    return F.array_join(F.slice(F.split("phrase", " "), 1, k), " ")


def _from(k: Column) -> Column:
    """The words of `phrase` after the first k."""
    parts = F.split("phrase", " ")
    return F.array_join(F.slice(parts, k + 1, F.size(parts)), " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, words, phrase, a, l, r, n, score) of all phrases of two words or more of `frequent_phrases`: the cut
    of the lowest floor(1000 a n / (l r)), of equal ones the first. Products are decimals of 38 digits."""
    phrases = counts.where("words > 1").withColumnRenamed("f", "a")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumn("left", _first(F.col("k"))).withColumn("right", _from(F.col("k")))
    part = counts.where("words > 0")
    halves = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(part.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    few = totals.limit(100_001).count() <= 100_000
    whole = halves.join(F.broadcast(totals) if few else totals, "lang")
    value = F.expr("cast(1000 * cast(a as decimal(19,0)) * cast(n as decimal(15,0)) as decimal(38,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = F.min(F.struct(value.alias("score"), "k", "l", "r", "n")).alias("best")
    return whole.groupBy("lang", "words", "phrase", "a").agg(best).select("lang", "words", "phrase", "a", "best.l", "best.r", "best.n", "best.score")


def maximal(phrases: DataFrame, percent: int = 100) -> DataFrame:
    """The rows of `phrases(lang, words, phrase, a, ...)` that stand in no longer one with 100 f(longer) >= percent a.

    It is enough to look at phrases of one word more: the part of a longer one with one word more than the
    phrase occurs as often as the longer one at least, and is a phrase of the table itself.
    """
    ends = F.array(_first(F.col("words") - 1), _from(F.lit(1)))
    inner = phrases.where("words > 2").select("lang", F.explode(F.array_distinct(ends)).alias("phrase"), "a")
    inside = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    joined = phrases.join(inside, ["lang", "phrase"], "left")
    return joined.where(F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True))).drop("longer")


def first_of_each(phrases: DataFrame, most: int, salts: int = 64) -> DataFrame:
    """The first `most` rows of each language by score, count and phrase, with rank from 1. Each of `salts` shares
    of a language is ranked first, so that a language that has most phrases is not one task's."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(salts))
    shares = phrases.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    ranked = shares.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= most)


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, words: int = WORDS, percent: int = 100, most: int | None = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `most` phrases of 2 to `words` words.

    See `frequent_phrases` for words and nulls, `scored` for l, r and score, `maximal` for phrases that go. With
    `most` None all phrases come, without a rank.
    """
    found = maximal(scored(frequent_phrases(docs, lang, text, least, words)), percent)
    names = ["lang", "phrase", "a", "l", "r", "n", "score"]
    if most is None:
        return found.select(*names)
    return first_of_each(found, most).select("lang", F.col("rank").cast("long").alias("rank"), *names[1:])
