"""Numbered lines and line metrics of files."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines_of, trim_all

# Comment syntax by language (line token; whether /* */ blocks exist).
HASH = ["Python", "Ruby", "Shell"]
DASHES = ["SQL"]
SLASHES = ["TypeScript", "JavaScript", "Java", "C++", "C", "Go", "Rust", "C#", "Kotlin", "Swift"]

AST = ["TypeScript", "JavaScript"]
HEURISTIC = ["Python", "Java", "C++", "C", "Go"]


def line_token(language: Column) -> Column:
    pairs = [*[(x, "#") for x in HASH], *[(x, "--") for x in DASHES], *[(x, "//") for x in SLASHES]]
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs)]), language)


def parse_strategy(language: Column) -> Column:
    return F.when(language.isin(AST), "ast").when(language.isin(HEURISTIC), "heuristic").otherwise("none")


def numbered_lines(files: DataFrame, text: str = "content") -> DataFrame:
    """A row for each line, `line` from 1 and `text`, in place of the content."""
    others = [c for c in files.columns if c != text]
    exploded = files.select(*others, F.posexplode(lines_of(F.col(text))).alias("__at", "text"))
    return exploded.select(*others, (F.col("__at") + 1).alias("line"), "text")


def line_metrics(files: DataFrame, text: str = "content", language: str = "language") -> DataFrame:
    """`files` with line_count, code_line_count, comment_line_count and blank_line_count.

    One fold over a file's lines in place of an explode: no shuffle, and a long file is one row. Null
    content counts as empty (one blank line).
    """
    token, blocks = line_token(F.col(language)), F.coalesce(F.col(language).isin(SLASHES), F.lit(False))
    lines = F.transform(lines_of(F.coalesce(F.col(text), F.lit(""))), trim_all)  # once, before the fold names them often
    start = F.struct(F.lit(False).alias("open"), F.lit(0).alias("blank"), F.lit(0).alias("comment"))

    def step(s: Column, line: Column) -> Column:
        empty = line == ""
        opens = blocks & ~s["open"] & line.startswith("/*")
        comment = ~empty & (s["open"] | opens | F.coalesce(line.startswith(token), F.lit(False)))
        closed = F.when(s["open"], line.contains("*/")).otherwise(F.substr(line, F.lit(3)).contains("*/"))
        still = F.when(empty, s["open"]).when(s["open"] | opens, ~closed).otherwise(F.lit(False))
        return F.struct(still.alias("open"), (s["blank"] + empty.cast("int")).alias("blank"), (s["comment"] + comment.cast("int")).alias("comment"))

    counted = files.withColumn("__n", F.aggregate(lines, start, step)).withColumn("line_count", F.size(lines_of(F.coalesce(F.col(text), F.lit("")))))
    return counted.withColumns({
        "blank_line_count": F.col("__n.blank"),
        "comment_line_count": F.col("__n.comment"),
        "code_line_count": F.col("line_count") - F.col("__n.comment") - F.col("__n.blank"),
    }).drop("__n")


def file_metrics(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Metrics per (run_id, file_id): line counts of `files`, and counts over symbols and imports.

    complexity is the sum over functions and methods, null unless the language has a syntax tree.
    """
    key = ["run_id", "file_id"]
    callable_ = F.col("kind").isin("FUNCTION", "METHOD")
    of_symbols = symbols.groupBy(*key).agg(
        F.count_if(callable_).cast("int").alias("function_count"),
        F.count_if(F.col("kind").isin("CLASS", "INTERFACE")).cast("int").alias("class_count"),
        F.count_if("exported").cast("int").alias("export_count"),
        F.sum(F.when(callable_, F.coalesce("complexity", F.lit(0))).otherwise(0)).cast("int").alias("complexity"),
    )
    of_imports = imports.groupBy(*key).agg(F.count("*").cast("int").alias("import_count"))
    joined = line_metrics(files).join(of_symbols, key, "left").join(of_imports, key, "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("function_count", "class_count", "export_count", "import_count")}
    whole = joined.withColumns(counts).withColumn("complexity", F.when(parse_strategy(F.col("language")) == "ast", F.coalesce("complexity", F.lit(0))))
    return whole.select(*key, "path", "line_count", "code_line_count", "comment_line_count", "blank_line_count", "function_count", "class_count", "import_count", "export_count", "complexity")
