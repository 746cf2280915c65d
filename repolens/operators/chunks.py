"""Symbol-aware chunks of files."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import newline_parts, trim_all
from .blocks import flat


@dataclass(frozen=True)
class Chunking:
    target_chars: int = 1600
    max_chars: int = 4000
    overlap_lines: int = 3
    min_chars: int = 40


#: Levels of nested symbols used as boundaries.
DEPTH = 2
KEY = ["run_id", "file_id"]


def split_many(lengths: np.ndarray, at: np.ndarray, config: Chunking) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line ranges (row, first line from 0, end exclusive) of all rows lengths[at[i]:at[i + 1]]: greedy up to the target,
    never over the maximum but for one long line, each beginning `overlap_lines` before the end of the last.

    Sums of the lines before tell where a range from any line ends, and so where the next one begins;
    jumps twice as far each time then find which lines ranges begin at.
    """
    n = len(lengths)
    before = np.concatenate([[0], np.cumsum(lengths.astype(np.int64) + 1)])
    own = np.repeat(np.arange(len(at) - 1), np.diff(at))
    line, last = np.arange(n), at[1:][own]
    full = np.searchsorted(before, before[:-1] + config.target_chars)
    over = np.searchsorted(before, before[:-1] + config.max_chars, side="right") - 1
    end = np.minimum(last, np.maximum(line + 1, np.minimum(full, over)))
    following = np.append(np.where(end >= last, n, np.maximum(end - config.overlap_lines, line + 1)), n)
    begins = at[:-1][at[:-1] < at[1:]]
    while True:
        more = np.union1d(begins, following[begins])
        if len(more) == len(begins):
            break
        begins, following = more, following[following]
    begins = begins[begins < n]
    return own[begins], begins - at[own[begins]], end[begins] - at[own[begins]]


def split_ranges(lengths: list[int], config: Chunking) -> list[tuple[int, int]]:
    """`split_many` of one row."""
    _, first, end = split_many(np.array(lengths, np.int64), np.array([0, len(lengths)]), config)
    return list(zip(first.tolist(), end.tolist(), strict=True))


def _lists(values: list[pa.Array], names: list[str] | None, at: np.ndarray) -> pa.Array:
    inner = pa.StructArray.from_arrays(values, names) if names else values[0]
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), inner)


def _sums(lengths: pa.Array) -> pa.Array:
    """For each row 0 and the running sums of its items, each counted with one more."""
    items, at = flat(lengths)
    before = np.concatenate([[0], np.cumsum(items.astype(np.int64) + 1)])
    upto = at + np.arange(len(at))
    place = np.arange(upto[-1]) - np.repeat(np.arange(len(at) - 1), np.diff(upto))
    return _lists([pa.array(before[place] - np.repeat(before[at[:-1]], np.diff(upto)))], None, upto)


def _kin(ids: pa.Array, parents: pa.Array) -> pa.Array:
    """For each row: its places ordered by parent (`order`), and for each place where its children begin there
    (`first`) and how many it has (`count`)."""
    at = flat(ids)[1]
    size = np.diff(at)
    both = pa.concat_arrays([x.flatten().cast(pa.string()) for x in (ids, parents)]).dictionary_encode()
    code = pc.fill_null(both.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    own = np.repeat(np.arange(len(size)), size)
    key, parent = own << 32 | code[: len(own)] + 1, own << 32 | code[len(own) :] + 1  # +1: null comes first
    order = np.argsort(parent, kind="stable")
    first, end = (np.searchsorted(parent[order], key, side) for side in ("left", "right"))
    lists = [_lists([pa.array(x.astype(np.int32))], None, at) for x in (order - at[own], first - at[own], end - first)]
    return pa.StructArray.from_arrays(lists, ["order", "first", "count"])


def _split(lengths: pa.Array, config: Chunking) -> pa.Array:
    items, at = flat(lengths)
    row, first, end = split_many(items, at, config)
    return _lists([pa.array(x.astype(np.int32)) for x in (first, end)], ["a", "b"], np.searchsorted(row, np.arange(len(at))))


def _region(start: Column, end: Column, symbol: Column, name: Column, place: Column) -> Column:
    return F.struct(start.alias("start_line"), end.alias("end_line"), symbol.alias("symbol_id"), name.alias("symbol_name"), place.alias("place"))


def _parts(places: Column, first: Column, last: Column, gap: Column) -> Column:
    """Regions between two lines: the symbols at `places` in order, a gap before each that begins after the end of
    the symbol before it (not of the furthest one), and the tail after the last. Gaps are like `gap`."""
    symbol = lambda i: F.get("symbols", i)

    def between(a: Column, b: Column) -> Column:
        return _region(a, b, gap["symbol_id"], gap["symbol_name"], gap["place"])

    def part(place: Column, i: Column) -> Column:
        c, before = symbol(place), symbol(F.get(places, i - 1))["end_line"] + 1
        cursor = F.when(i == 0, first).otherwise(before)
        lead = F.when(c["start_line"] > cursor, between(cursor, c["start_line"] - 1))
        return F.filter(F.array(lead, _region(c["start_line"], c["end_line"], c["symbol_id"], c["name"], place)), lambda r: r.isNotNull())

    cursor = F.when(F.size(places) == 0, first).otherwise(symbol(F.get(places, F.size(places) - 1))["end_line"] + 1)
    tail = F.filter(F.array(F.when(cursor <= last, between(cursor, last))), lambda r: r.isNotNull())
    return F.concat(F.flatten(F.transform(places, part)), tail)


def _text(lines: Column, r: Column) -> Column:
    """The lines of a region, as far as the file has them."""
    start = F.greatest(r["start_line"], F.lit(1))
    return F.array_join(F.slice(lines, start, F.greatest(r["end_line"] - start + 1, F.lit(0))), "\n")


def _chars(r: Column) -> Column:
    """The length of a region's text, from the sums of the lines before its ends."""
    start, end = F.greatest(r["start_line"], F.lit(1)), F.least(r["end_line"], F.size("sums") - 1)
    return F.when(end >= start, F.get("sums", end) - F.get("sums", start - 1) - 1).otherwise(0)


def _placed(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files with content and a language, with their lines, the sums of these, their symbols in start order, who is
    whose child, and the top-level regions. One join by file; all that follows is within a row."""
    named = files.where(F.col("language").isNotNull() & (trim_all(F.coalesce("content", F.lit(""))) != ""))
    whole = named.select(*KEY, "path", "language", newline_parts(F.col("content")).alias("lines"))
    item = F.struct("start_line", "ordinal", "symbol_id", "name", "end_line", "parent_id")
    of_files = symbols.groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias("symbols"))
    joined = whole.join(of_files, KEY, "left")
    joined = joined.withColumn("symbols", F.coalesce("symbols", F.array().cast(of_files.schema["symbols"].dataType)))
    part = lambda field: F.transform("symbols", lambda x: x[field])
    sums = F.arrow_udf(_sums, "array<long>")(F.transform("lines", F.length))
    kin = F.arrow_udf(_kin, "struct<order: array<int>, first: array<int>, count: array<int>>")(part("symbol_id"), part("parent_id"))
    known = joined.withColumns({"sums": sums, "kin": kin})
    none = _region(F.lit(0), F.lit(0), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("int"))
    top = F.filter(F.transform("symbols", lambda x, i: F.when(x["parent_id"].isNull(), i)), lambda i: i.isNotNull())
    return known.withColumn("top", top).withColumn("regions", _parts(F.col("top"), F.lit(1), F.size("lines"), none)).drop("top")


def regions(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(run_id, file_id, place, start_line, end_line, symbol_id, symbol_name): the top-level regions."""
    found = _placed(files, symbols).select(*KEY, F.posexplode("regions").alias("at", "r"))
    return found.select(*KEY, F.col("at").alias("place"), *[f"r.{c}" for c in ("start_line", "end_line", "symbol_id", "symbol_name")])


def _deeper(r: Column, config: Chunking) -> Column:
    """A region, or if it is oversized and its symbol has children, these and the gaps between. A gap
    keeps the symbol: an oversized gap so meets the children of its symbol again a level down."""
    count = F.coalesce(F.get("kin.count", r["place"]), F.lit(0))
    children = F.slice("kin.order", F.get("kin.first", r["place"]) + 1, count)
    return F.when((count > 0) & (_chars(r) > config.max_chars), _parts(children, r["start_line"], r["end_line"], r)).otherwise(F.array(r))


def _ranges(text: Column, config: Chunking) -> Column:
    """Line ranges of an oversized region, from the lengths of its lines; one range for any other."""
    ranges = F.arrow_udf(lambda lengths: _split(lengths, config), "array<struct<a:int,b:int>>")
    fits = F.length(text) <= config.max_chars
    lines = newline_parts(text)
    asked = F.when(fits, F.array().cast("array<int>")).otherwise(F.transform(lines, F.length))
    return F.when(fits, F.array(F.struct(F.lit(0).alias("a"), F.size(lines).alias("b")))).otherwise(ranges(asked))


def chunk_files(files: DataFrame, symbols: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """Chunks of `files(run_id, file_id, path, language, content)` along `symbols`, numbered per file in
    emission order: (run_id, file_id, chunk_index, file_path, language, start_line, end_line, symbol_id,
    symbol_name, content, content_hash, char_count).

    Files without a language or with blank content give none. Gaps of files that have symbols are
    dropped if they are shorter than `min_chars` after trimming.
    """
    placed = _placed(files, symbols)
    for _ in range(DEPTH):
        placed = placed.withColumn("regions", F.flatten(F.transform("regions", lambda r: _deeper(r, config))))
    with_text = F.transform("regions", lambda r: F.struct(r.alias("r"), _text(F.col("lines"), r).alias("text")))
    rows = placed.select(*KEY, "path", "language", (F.size("symbols") > 0).alias("has_symbols"), F.posexplode(with_text).alias("at", "x"))
    pieces = rows.select(*KEY, "path", "language", "has_symbols", "at", "x.r.*", "x.text").withColumn("ranges", _ranges(F.col("text"), config))
    # there is always a range; without `outer` the filter for it would run the helper a second time
    pieces = pieces.withColumn("parts", newline_parts(F.col("text"))).select("*", F.posexplode_outer("ranges").alias("part", "range"))
    content = F.array_join(F.slice("parts", F.col("range.a") + 1, F.col("range.b") - F.col("range.a")), "\n")
    # a region that fits keeps its own end, which may lie beyond the file
    end = F.when(F.length("text") <= config.max_chars, F.col("end_line")).otherwise(F.col("start_line") + F.col("range.b") - 1)
    cut = pieces.select(*KEY, F.col("path").alias("file_path"), "language", "has_symbols", "at", "part", "symbol_id", "symbol_name", (F.col("start_line") + F.col("range.a")).alias("start_line"), end.alias("end_line"), content.alias("content"))
    kept = cut.where(~(F.col("symbol_id").isNull() & F.col("has_symbols") & (F.length(trim_all(F.col("content"))) < config.min_chars)))
    index = F.row_number().over(Window.partitionBy(*KEY).orderBy("at", "part")) - 1
    numbered = kept.withColumn("chunk_index", index)
    digest = F.sha2(F.concat("file_path", F.lit("::"), F.col("chunk_index").cast("string"), F.lit("::"), "content").cast("binary"), 256)
    return numbered.select(*KEY, "chunk_index", "file_path", "language", "start_line", "end_line", "symbol_id", "symbol_name", "content", digest.alias("content_hash"), F.length("content").alias("char_count"))
