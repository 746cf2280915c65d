"""Lines, white space and POSIX paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "array<string>"


def trim_all(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lines_of(text: Column) -> Column:
    """Lines ended by CRLF, CR or LF; a last line end is followed by an empty line."""
    return F.split(text, r"\r\n|\r|\n", -1)


def newline_parts(text: Column) -> Column:
    """Lines ended by LF alone, as the chunker counts them."""
    return F.split(text, "\n", -1)


def folded(segments: Column, rooted: bool) -> Column:
    """Path segments without empty ones and dots; `..` takes the segment before it, and where none is
    left it stays (`rooted`: goes)."""

    def step(kept: Column, s: Column) -> Column:
        can_pop = (F.size(kept) > 0) & (F.coalesce(F.element_at(kept, -1), F.lit("")) != "..") if not rooted else F.lit(True)
        popped = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(s.isin("", "."), kept).when((s == "..") & can_pop, popped).otherwise(F.concat(kept, F.array(s)))

    return F.aggregate(segments, F.array().cast(EMPTY), step)


def normal_path(path: Column) -> Column:
    """A relative POSIX path in normal form; a slash at the end stays."""
    inner = F.array_join(folded(F.split(path, "/", -1), rooted=False), "/")
    inner = F.when(inner == "", F.lit(".")).otherwise(inner)
    return F.when(path.endswith("/"), F.concat(inner, F.lit("/"))).otherwise(inner)


def resolved(workspace: str, entry: Column) -> Column:
    """The absolute path that an entry names from a workspace."""
    whole = F.when(entry.startswith("/"), entry).otherwise(F.concat(F.lit(workspace + "/"), entry))
    return F.concat(F.lit("/"), F.array_join(folded(F.split(whole, "/", -1), rooted=True), "/"))


def parent_folder(path: Column) -> Column:
    """The folder of a path, `.` at the top."""
    found = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(found == "", F.lit(".")).otherwise(found)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def extension_of(name: Column) -> Column:
    """From the last dot on; null without a dot, or if the only dot leads the name."""
    return F.nullif(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1), F.lit(""))
