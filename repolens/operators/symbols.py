"""Imports and symbols from source lines of Python, Java, C, C++ and Go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines_of, trim_all
from .blocks import BLOCK, CALL, INTERFACE, SCOPE, SHUT, scopes
from .lines import HEURISTIC, numbered_lines

# Line patterns of imports and symbols, by language.
PYTHON_FROM = r"^\s*from\s+([\w.]+)\s+import\b"
PYTHON_IMPORT = r"^\s*import\s+(.+)$"
PYTHON_CLASS = r"^(\s*)class\s+([A-Za-z_]\w*)"
PYTHON_DEF = r"^(\s*)def\s+([A-Za-z_]\w*)\s*\(([^)]*)\)"
JAVA_IMPORT = r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;"
JAVA_CLASS = r"^\s*(?:public|private|protected|static|final|abstract|\s)*class\s+(\w+)"
JAVA_INTERFACE = r"^\s*(?:public|private|protected|\s)*interface\s+(\w+)"
JAVA_METHOD = r"^\s*(?:public|private|protected|static|final|synchronized|abstract|native|\s)*[\w<>[\],.]+\s+(\w+)\s*\(([^;{)]*)\)\s*(?:throws\s+[\w,\s]+)?\{"
CPP_INCLUDE = r"""^\s*#include\s*[<"]([^>"]+)[>"]"""
CPP_CLASS = r"^\s*class\s+(\w+)"
CPP_FUNCTION = r"^[\w:<>*&,\s]+[\s*&](\w+)\s*\(([^;{)]*)\)\s*(?:const\s*)?\{"
GO_IMPORT = r'^import\s+"([^"]+)"'
GO_BLOCK = r"^import\s*\("
GO_FUNC = r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(([^)]*)\)[^{]*\{"
GO_STRUCT = r"^type\s+(\w+)\s+struct\s*\{"
CONTROL = ["if", "else", "for", "while", "switch", "catch", "try", "do", "synchronized", "return", "new", "throw"]


def parameter_count(line: Column) -> Column:
    """Of the first `(...)` on a line: 0 if empty, else the parts that are not blank; null without one."""
    inner = trim_all(F.regexp_extract(line, r"\(([^)]*)\)", 1))
    parts = F.size(F.filter(F.split(inner, ",", -1), lambda p: trim_all(p) != ""))
    return F.when(line.rlike(r"\([^)]*\)"), F.when(inner == "", 0).otherwise(parts))


def extract_imports(files: DataFrame) -> DataFrame:
    """(run_id, file_id, source, kind, line) from line patterns, by built-in functions.

    Only files that could hold an import are exploded to lines. A Go line is inside an import block if
    the last marker before it opened one.
    """
    some = files.where(F.col("language").isin(HEURISTIC) & F.col("content").rlike("import|#include"))
    lines = numbered_lines(some.select("run_id", "file_id", "language", "content"))
    language, text = F.col("language"), F.col("text")
    plain = lines.where(language != "Go")
    first = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    from_ = first(PYTHON_FROM)
    items = F.transform(F.split(F.regexp_extract(text, PYTHON_IMPORT, 1), ",", -1), lambda p: trim_all(F.element_at(F.split(trim_all(p), r"\s+as\s+", -1), 1)))
    is_python = (language == "Python") & ~text.rlike(PYTHON_CLASS) & ~text.rlike(PYTHON_DEF)
    found = (
        F.when(is_python & from_.isNotNull(), F.array(from_))
        .when(is_python, F.filter(items, lambda m: m != ""))
        .when(language == "Java", F.array(first(JAVA_IMPORT)))
        .when(language.isin("C", "C++"), F.array(first(CPP_INCLUDE)))
    )
    kind = F.when(language.isin("C", "C++"), "INCLUDE").otherwise("IMPORT")
    of_lines = plain.where(text.rlike("import|#include")).select("run_id", "file_id", F.explode(found).alias("source"), kind.alias("kind"), "line")
    go = lines.where(language == "Go").withColumn("text", trim_all(text))
    marker = F.when(text.rlike(GO_BLOCK), True).when(text == ")", False)
    before = Window.partitionBy("run_id", "file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    go = go.withColumn("__inside", F.coalesce(F.last(marker, ignorenulls=True).over(before), F.lit(False)))
    source = F.when(F.col("__inside"), F.when(text != ")", first(r'"([^"]+)"'))).when(~text.rlike(GO_BLOCK), first(GO_IMPORT))
    of_go = go.select("run_id", "file_id", source.alias("source"), F.lit("IMPORT").alias("kind"), "line")
    return of_lines.unionByName(of_go).where("source is not null")


def _java(pattern: str) -> str:
    """A pattern of the list above for Java: no bracket opens a set within a set, and a run of modifiers and spaces
    repeats by modifier, so that a long indent is no deep recursion."""
    return pattern.replace("[\\w<>[\\],.]", "[\\w<>\\[\\],.]").replace(r"|\s)*", r")\s*)*").replace(r"^\s*(?:p", r"^\s*(?:(?:p")


def _head(i: Column, kind: int, text: Column, pattern: str, name: int = 1, args: int | None = None) -> Column:
    inner = F.lit(None).cast("string") if args is None else trim_all(F.regexp_extract(text, pattern, args))
    return F.struct(i.alias("line"), F.lit(kind).alias("kind"), F.regexp_extract(text, pattern, name).alias("name"), inner.alias("args"), text.alias("text"))


def _heads(language: str, x: Column, i: Column) -> Column:
    """The head that a line holds, or null."""
    if language == "Python":
        return F.when(x.rlike(PYTHON_CLASS), _head(i, SCOPE, x, PYTHON_CLASS, 2)).when(x.rlike(PYTHON_DEF), _head(i, CALL, x, PYTHON_DEF, 2, 3))
    if language == "Go":
        x = trim_all(x)
        plain = F.when(x.rlike(GO_BLOCK), _head(i, BLOCK, x, GO_BLOCK, 0)).when(x == ")", _head(i, SHUT, x, r"\)", 0))
        return plain.when(x.rlike(GO_STRUCT), _head(i, SCOPE, x, GO_STRUCT)).when(x.rlike(GO_FUNC), _head(i, CALL, x, GO_FUNC, 1, 2))
    if language == "Java":
        face, holder, call = (_java(p) for p in (JAVA_INTERFACE, JAVA_CLASS, JAVA_METHOD))
        named = F.when(x.rlike(face), _head(i, INTERFACE, x, face)).when(x.rlike(holder), _head(i, SCOPE, x, holder))
        return F.when(~x.rlike(JAVA_IMPORT), named.when(_no_control(x, call), _head(i, CALL, x, call, 1, 2)))
    return F.when(~x.rlike(CPP_INCLUDE), F.when(x.rlike(CPP_CLASS), _head(i, SCOPE, x, CPP_CLASS)).when(_no_control(x, CPP_FUNCTION), _head(i, CALL, x, CPP_FUNCTION, 1, 2)))


def _no_control(x: Column, pattern: str) -> Column:
    return x.rlike(pattern) & ~F.regexp_extract(x, pattern, 1).isin(CONTROL)


def _of_language(make) -> Column:
    """`make(language)` for the language of the row."""
    out = F.when(F.col("language") == "Python", make("Python")).when(F.col("language") == "Go", make("Go"))
    return out.when(F.col("language") == "Java", make("Java")).otherwise(make("C"))


#: What a line must hold at least to begin something: no pattern is tried on others.
_HINT = {"Python": "class|def", "Go": r"import|\)|type|func", "Java": r"class|interface|\{", "C": r"class|\{"}


def _marked(files: DataFrame) -> DataFrame:
    """Files with the heads of their lines, and what ends blocks: lines with braces (how many more open than close,
    and whether any opens) or, of Python, lines that are not blank (their indent)."""
    lines = files.select("run_id", "file_id", "language", lines_of(F.col("content")).alias("lines"))
    head = lambda language: F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(_HINT[language]), _heads(language, x, i))), lambda h: h.isNotNull())
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c)))
    mark = lambda i, value, opens: F.struct(i.alias("line"), value.cast("int").alias("value"), opens.alias("opens"))
    brace = lambda x, i: F.when(x.contains("{") | x.contains("}"), mark(i, count(x, "{") - count(x, "}"), x.contains("{")))
    indent = lambda x, i: F.when(trim_all(x) != "", mark(i, F.length(x) - F.length(F.regexp_replace(x, r"(?U)^\s+", "")), F.lit(False)))
    marks = F.when(F.col("language") == "Python", F.transform("lines", indent)).otherwise(F.transform("lines", brace))
    return lines.select("run_id", "file_id", "language", F.size("lines").alias("n_lines"), _of_language(head).alias("heads"), F.filter(marks, lambda m: m.isNotNull()).alias("marks"))


def extract_symbols(files: DataFrame) -> DataFrame:
    """Symbols of files in languages without a syntax tree; complexity is null. No shuffle, and no loop over
    lines: built-in functions find the lines that begin something, and `blocks.scopes` finds where all blocks of
    a batch of files end and what encloses them, from line numbers alone. Null content has none."""
    some = _marked(files.where(F.col("language").isin(HEURISTIC) & F.col("content").isNotNull()).select("run_id", "file_id", "language", "content"))
    part = lambda field: F.transform("heads", lambda h: h[field])
    own = lambda field: F.transform("marks", lambda m: m[field])
    found = scopes(F.col("language"), F.col("n_lines"), part("line"), part("kind"), own("line"), own("value"), own("opens"))
    with_ends = some.withColumn("found", found)  # a filter of heads here would be moved below what makes them, and make them twice
    named = with_ends.withColumn("of", F.transform("found", lambda x: F.get("heads", x["parent"])["name"]))
    rows = named.select("run_id", "file_id", "language", F.posexplode(F.filter(F.arrays_zip("heads", "found", "of"), lambda p: p["found"]["kept"])).alias("ordinal", "p"))
    rows = rows.select("run_id", "file_id", "language", "ordinal", "p.heads.*", F.col("p.of").alias("parent_name"), F.col("p.found.end").alias("end"))
    language, name, is_call = F.col("language"), F.col("name"), F.col("kind") == CALL
    method = (language == "Java") | ((language != "Go") & F.col("parent_name").isNotNull())
    kind = F.when(F.col("kind") == INTERFACE, "INTERFACE").when(~is_call, "CLASS").when(method, "METHOD").otherwise("FUNCTION")
    exported = (
        F.when(language == "Go", name.rlike("^[A-Z]")).when(~is_call | language.isin("C", "C++"), True)
        .when(language == "Java", ~F.col("text").contains("private")).otherwise(~name.startswith("_"))
    )
    word = F.when(language == "Go", "type ").when(F.col("kind") == INTERFACE, "interface ").otherwise("class ")
    holder = F.concat(word, name, F.when(language == "Go", " struct").otherwise(""))
    call = F.concat(F.when(language == "Python", "def ").when(language == "Go", "func ").otherwise(""), name, F.lit("("), "args", F.lit(")"))
    n = parameter_count(F.col("text"))
    given = F.when((language == "Python") & F.col("parent_name").isNotNull(), F.greatest(n - 1, F.lit(0))).otherwise(n)
    return rows.select(
        "run_id", "file_id", "ordinal", "name", kind.alias("kind"), (F.col("line") + 1).alias("start_line"), (F.col("end") + 1).alias("end_line"), exported.alias("exported"),
        "parent_name", F.when(is_call, call).otherwise(holder).alias("signature"), F.when(is_call, given).alias("parameter_count"),
    )


def with_parent_ids(symbols: DataFrame) -> DataFrame:
    """`symbols` with parent_id: the id of the last symbol of that name in the file, null if absent."""
    key = ["run_id", "file_id"]
    last = symbols.groupBy(*key, F.col("name").alias("parent_name")).agg(F.max_by("symbol_id", "ordinal").alias("parent_id"))
    return symbols.drop("parent_id").join(last, [*key, "parent_name"], "left")
