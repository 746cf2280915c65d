"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a file is addressed by the SHA-256 of its text. The ledger holds one row for each
blob and rule version that has been scanned, with its findings. A scan takes the blobs of its input,
leaves out pairs of blob and rule version that the ledger has, scans one copy of each blob left, and
joins the findings of all blobs back to every path that holds them. So a text that a thousand paths
share is scanned once, and a rule that did not change never reads a blob twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

FINDINGS = "array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A pattern of one kind. A match counts if `group` has `least` characters or more. `hint` is a
    cheaper test that every match passes; a new `version` makes the ledger scan all blobs again."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    hint: str = ""
    version: int = 1


#: What may stand between the lines of a key: white space; marks of quotes, comments, tables and lists; line ends
#: written as escapes, and the operators that join string literals.
GAP = r"""(?:[ \t\r\n>#*"',;|]|//[ \t]|\+[ \t\r\n]|\\+[nrt]?)*"""


def key_pattern(gap: str, lines: str = "*") -> str:
    """A private key: its header, the lines of 24 or more base64 characters after it, and the shorter last line
    with the footer. `gap` is what may stand between lines; `lines` repeats them."""
    begin, end = (f"-----{x} [A-Z ]*PRIVATE KEY-----" for x in ("BEGIN", "END"))
    locked = f"(?:{gap}Proc-Type: 4,ENCRYPTED{gap}DEK-Info: [A-Za-z0-9,-]+)?"
    return f"{begin}{locked}(?:{gap}[A-Za-z0-9+/=]{{24,}}){lines}(?:{gap}[A-Za-z0-9+/=]*{gap}{end})?"


#: Gaps and lines give nothing back, so a text of many marks is passed once.
_PEM = key_pattern(GAP + "+", "*+")

#: Base kinds first, in the order that their spans are listed, then what this method adds. A hex or access
#: match runs to the end of its characters, so one that is too short holds no other that is long enough:
#: those patterns ask for the length themselves.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
    Rule("pem", _PEM, 1, version=3),
)
BASE = 3
#: Code points of a block that `redacted` cuts pieces from.
BLOCK = 1024


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Each value of an array of integers combined with all before it, 0 first. In round k each takes
    in the one 2 ** k places before: n log n steps, where a fold that appends to its result takes n * n."""

    def rounds(v: Column) -> Column:
        numbers = F.when(F.size(v) > 1, F.sequence(F.lit(0), F.floor(F.log2(F.size(v) - 1)).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(numbers, v, lambda now, k: F.zip_with(F.slice(F.concat(F.array_repeat(F.lit(0), F.pow(F.lit(2), k).cast("int")), now), F.lit(1), F.size(now)), now, combine))

    return bound(values, rounds)


def spans(text: Column, rule: Rule) -> Column:
    """Leftmost matches that do not overlap, as 0-based code points, end exclusive.

    The pieces between the matches are as many as the matches and one more, so that lengths of pieces
    and matches add up to positions. A failing match still takes its place in the text.
    """

    def placed(found: Column) -> Column:
        counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
        sizes = F.zip_with(found, counted, lambda m, c: F.struct(F.length(m).alias("n"), (F.length(c) >= rule.least).alias("ok")))
        gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found))
        ends = running(F.zip_with(gaps, found, lambda gap, m: F.length(gap) + F.length(m)), lambda a, b: a + b)
        each = F.zip_with(ends, sizes, lambda end, m: F.struct((end - m["n"]).alias("start"), end.alias("end"), m["ok"].alias("ok")))
        return F.transform(F.filter(each, lambda m: m["ok"]), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))

    walked = bound(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), placed)
    return F.when(F.regexp_like(text, F.lit(rule.hint or rule.pattern)), walked).otherwise(F.array().cast(FINDINGS))


def blob_of(text: Column) -> Column:
    """The address of a text; null is the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan(versions: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, kind, version, found): pairs of blob and rule version not in `ledger`.

    Of the rows that hold a blob, the one of the least path is read; null paths count as one path.
    """
    named = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("__text")).withColumn("blob", F.sha2(F.col("__text").cast("binary"), 256))
    one = named.groupBy("blob").agg(F.min("path").alias("path"))
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is None:
        one = one.withColumn("todo", wanted)
    else:
        done = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("done"))
        one = one.join(done, "blob", "left").withColumn("todo", F.when(F.col("done").isNull(), wanted).otherwise(F.array_except(wanted, "done"))).drop("done").where(F.size("todo") > 0)
    unseen = named.alias("d").join(one.alias("o").hint("shuffle_hash"), F.col("d.path").eqNullSafe(F.col("o.path")) & (F.col("d.blob") == F.col("o.blob"))).select("o.blob", "o.todo", "__text")

    def result(r: Rule) -> Column:
        pair = F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))
        return F.struct(pair["kind"].alias("kind"), pair["version"].alias("version"), F.when(F.array_contains("todo", pair), spans(F.col("__text"), r)).alias("found"))

    results = F.array(*map(result, rules))
    scanned = unseen.select("blob", F.explode(F.filter(results, lambda x: x["found"].isNotNull())).alias("r")).select("blob", "r.*")
    return scanned.dropDuplicates(["blob", "kind"])


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found) of the blobs in which the present rules find something; found is
    array<struct<start, rank, kind, end>> by start, then rule order."""
    now = F.lit(False)
    for r in rules:
        now = now | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    rank = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind")).cast("int")
    each = ledger.where(now & (F.size("found") > 0)).withColumn("rank", rank)
    own = F.transform("found", lambda x: F.struct(x["start"].alias("start"), F.col("rank").alias("rank"), F.col("kind").alias("kind"), x["end"].alias("end")))
    return each.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list(own))).alias("found"))


def find_secrets(versions: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None, found: str = "found") -> DataFrame:
    """(path, found) of every row, or the columns `keep` in place of the path, from the ledger and a scan
    of what it lacks; `found` names the column of findings, which a column of `keep` must not.

    What is new in the ledger is written first, and the findings of each blob after it: paths then meet
    blobs in a plain join, which adaptive execution splits where many paths hold one blob. Null and empty
    texts have no findings; repeated rows repeat theirs; null paths pass through. Columns other than
    those named are not read.
    """
    new = written(scan(versions, ledger, path, text, rules), "ledger")
    whole = new if ledger is None else ledger.select("blob", "kind", "version", "found").unionByName(new)
    own = written(findings(whole, rules), "findings").select(F.col("blob").alias("__blob"), F.col("found").alias("__found"))
    names = keep or [path]
    rows = versions.select(*names, blob_of(F.col(text)).alias("__blob"))
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    if not keep:
        return rows.join(own, "__blob", "left").select(*names, F.coalesce("__found", empty).alias(found))
    maybe = rows.join(F.broadcast(_sieve(own)), how="cross").withColumn("__maybe", F.getbit(F.get("__bits", F.shiftright(_place(), 6)), _place().bitwiseAND(63).cast("int")) == 1)
    some = maybe.where("__maybe").drop("__bits", "__maybe").join(own, "__blob", "left").select(*names, F.coalesce("__found", empty).alias(found))
    return some.unionByName(maybe.where("not __maybe").select(*names, empty.alias(found)))


#: A sieve of blobs has 2 to this power bits: 512 KB.
SIEVE = 22


def _place() -> Column:
    return F.shiftrightunsigned(F.xxhash64("__blob"), 64 - SIEVE).cast("int")


def _sieve(own: DataFrame) -> DataFrame:
    """One row of a bitmap of fixed size with a bit for each blob of `own`: texts without it have no findings, and
    need not be shuffled to learn so. The bitmap lets some others pass, never fewer."""
    bit = F.expr("shiftleft(1L, place & 63)")
    words = own.select(_place().alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    every = own.sparkSession.range(1 << (SIEVE - 6)).select(F.col("id").cast("int").alias("word")).join(words, "word", "left")
    dense = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return every.agg(dense.alias("w")).select(F.col("w.bits").alias("__bits"))


def redacted(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """`text` with its findings, which come by their start, masked; overlapping findings are masked as one.

    Pieces between them are cut from blocks of `BLOCK` code points: in a whole text each would be
    counted off from its beginning.
    """

    def piece(blocks: Column, begin: Column, end: Column) -> Column:
        first = F.floor(begin / BLOCK).cast("int")
        near = F.slice(blocks, first + 1, F.floor(end / BLOCK).cast("int") - first + 1)
        return F.substring(F.array_join(near, ""), begin - first * BLOCK + 1, end - begin)

    def cut(blocks: Column, reach: Column) -> Column:
        before = F.slice(F.concat(F.array(F.lit(0)), reach), F.lit(1), F.size(reach))
        fresh = F.filter(F.zip_with(found, before, lambda f, b: F.struct(f["start"].alias("end"), b.alias("begin"))), lambda g: g["end"] >= g["begin"])
        last = piece(blocks, F.element_at(reach, -1), F.length(text))
        return F.array_join(F.concat(F.transform(fresh, lambda g: piece(blocks, g["begin"], g["end"])), F.array(last)), mask)

    reach = running(F.transform(found, lambda f: f["end"]), lambda a, b: F.greatest(a, b))
    whole = bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), lambda blocks: bound(reach, lambda r: cut(blocks, r)))
    return F.when(F.size(found) > 0, whole).otherwise(text)
