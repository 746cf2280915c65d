"""Every operator as a query over the given tables, and SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import archive, chunks, classify, evidence, graph, index, lines, reports, rules, runs, search, symbols
from ..schemas import AI_SEVERITIES, SEVERITIES
from ..sources import tables, tree
from ..sources.shared import shared_folder, stored
from ..streaming import jobs
from .views import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NOW = "2024-01-20 00:00:00"


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name, and its SQL with the views that it uses."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _repos(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "repositories")


# --- sources and sinks ---------------------------------------------------------------------------


@query("SELECT 'doc=' || doc_id AS folder, strlen(coalesce(text, '')) + 1 AS size, sha256(coalesce(text, '') || chr(10)) AS digest FROM documents")
def a1_read_tree(spark, d):
    """The texts as a tree of one file each, read back."""
    root = shared_folder(spark, "tree")
    texts = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("doc"), "text")
    tree.write_tree(texts, root, "doc", F.coalesce("text", F.lit("")))
    found = tree.read_tree(spark, root).where("name like 'part-%'")
    return found.select(X.parent_folder(F.col("path")).alias("folder"), "size", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))


@query("""
SELECT user_id, github_id, owner, name FROM (
  SELECT cast(c_nationkey AS VARCHAR) AS user_id, c_custkey AS github_id, lower(c_mktsegment) AS owner, c_name AS name,
         row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_custkey * 7919) % 100000 DESC, c_custkey) AS n FROM customer) WHERE n <= 500
""")
def a2_repository_metadata(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    made = F.to_json(F.struct(
        F.col("c_custkey").alias("id"), F.struct(F.lower("c_mktsegment").alias("login")).alias("owner"), F.col("c_name").alias("name"),
        F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("c_custkey") * 7919) % 100_000).alias("updated_at"), F.col("c_nationkey").cast("string").alias("user_id"),
    ))
    raw = c.select(F.from_json(made, tree.METADATA).alias("r")).select("r.*")
    return tree.normalise_metadata(raw).select("user_id", "github_id", "owner", "name")


@query("SELECT run_id, file_id, len(string_split_regex(content, '\\r\\n|\\r|\\n'))::INT AS line_count FROM files", "files")
def a3_write_runs(spark, d):
    path = shared_folder(spark, "metrics")
    rows = lines.line_metrics(view(spark, d, "files")).select("run_id", "file_id", "line_count")
    tables.write_runs(rows, path)
    return spark.read.schema("file_id string, line_count int, run_id string").parquet(path).select("run_id", "file_id", "line_count")


@query("""
SELECT run_id, file_id, name, 'old' AS attempt FROM symbols WHERE run_id NOT IN (SELECT run_id FROM symbols WHERE kind = 'CLASS' AND start_line > 10)
UNION ALL SELECT run_id, file_id, name, 'new' FROM symbols WHERE kind = 'CLASS' AND start_line > 10
""", "symbols")  # fmt: skip
def a4_replace_runs(spark, d):
    s = view(spark, d, "symbols")
    old = s.select("run_id", "file_id", "name", F.lit("old").alias("attempt"))
    new = s.where("kind = 'CLASS' AND start_line > 10").select("run_id", "file_id", "name", F.lit("new").alias("attempt"))
    return tables.replace_runs(old, new, new)


@query("""
, o AS (SELECT run_id, path, file_id FROM files WHERE id % 3 = 0), n AS (SELECT run_id, path, min(file_id) AS file_id FROM (SELECT run_id, path, file_id FROM files UNION ALL SELECT run_id, path, file_id || 'x' FROM files) GROUP BY run_id, path)
SELECT * FROM o UNION ALL SELECT * FROM n ANTI JOIN o USING (run_id, path)
""", "files")  # fmt: skip
def a5_insert_new(spark, d):
    f = view(spark, d, "files")
    old = f.where("id % 3 = 0").select("run_id", "path", "file_id")
    new = f.select("run_id", "path", "file_id").unionByName(f.select("run_id", "path", F.concat("file_id", F.lit("x")).alias("file_id")))
    return tables.insert_new(old, new, ["run_id", "path"])


_A6 = """
, o AS (SELECT user_id, github_id, repository_id, full_name FROM repositories WHERE github_id % 3 <> 0),
  n AS (SELECT user_id, github_id, 'new-' || repository_id AS repository_id, upper(full_name) AS full_name FROM repositories WHERE github_id % 2 = 0)
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.github_id, n.github_id) AS github_id, coalesce(o.repository_id, n.repository_id) AS repository_id, coalesce(n.full_name, o.full_name) AS full_name
FROM o FULL JOIN n ON o.user_id = n.user_id AND o.github_id = n.github_id
"""


@query(_A6, "repositories")
def a6_upsert_repositories(spark, d):
    r = _repos(spark, d)
    old = r.where("github_id % 3 <> 0").select("user_id", "github_id", "repository_id", "full_name")
    new = r.where("github_id % 2 = 0").select("user_id", "github_id", F.concat(F.lit("new-"), "repository_id").alias("repository_id"), F.upper("full_name").alias("full_name"))
    return tables.upsert(old, new, ["user_id", "github_id"], ["repository_id"])


_FRESH = "SELECT run_id, file_id, ordinal AS chunk_index, symbol_id, name AS content, concat(name, CASE WHEN ordinal = 1 AND start_line + length(file_id) = 8 THEN 'b' ELSE 'a' END) AS content_hash FROM symbols WHERE kind <> 'INTERFACE'"
_OLD = "SELECT run_id, file_id, ordinal AS chunk_index, concat('old', symbol_id) AS symbol_id, name AS content, concat(name, 'a') AS content_hash FROM symbols WHERE kind <> 'CLASS'"


def _fresh_old(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = view(spark, d, "symbols")
    changed = (F.col("ordinal") == 1) & (F.col("start_line") + F.length("file_id") == 8)
    key = ["run_id", "file_id", F.col("ordinal").alias("chunk_index")]
    fresh = s.where("kind <> 'INTERFACE'").select(*key, "symbol_id", F.col("name").alias("content"), F.concat("name", F.when(changed, "b").otherwise("a")).alias("content_hash"))
    old = s.where("kind <> 'CLASS'").select(*key, F.concat(F.lit("old"), "symbol_id").alias("symbol_id"), F.col("name").alias("content"), F.concat("name", F.lit("a")).alias("content_hash"))
    return fresh, old


@query(f"""
, f AS ({_FRESH}), o AS ({_OLD})
SELECT coalesce(f.run_id, o.run_id) AS run_id, coalesce(f.file_id, o.file_id) AS file_id, coalesce(f.chunk_index, o.chunk_index) AS chunk_index,
       coalesce(f.content_hash, o.content_hash) AS content_hash, coalesce('id' || o.file_id || o.chunk_index, f.symbol_id) AS id
FROM f FULL JOIN o ON f.run_id = o.run_id AND f.file_id = o.file_id AND f.chunk_index = o.chunk_index
""", "symbols")  # fmt: skip
def a7_upsert_chunks(spark, d):
    fresh, old = _fresh_old(spark, d)
    new = fresh.select("run_id", "file_id", "chunk_index", "content_hash", F.col("symbol_id").alias("id"))
    before = old.select("run_id", "file_id", "chunk_index", "content_hash", F.concat(F.lit("id"), "file_id", F.col("chunk_index").cast("string")).alias("id"))
    return tables.upsert(before, new, index.KEY, ["id"])


@query("""
, gone AS (SELECT repository_id FROM repositories WHERE user_id = '3'), i AS (SELECT * FROM ingestions ANTI JOIN gone USING (repository_id))
SELECT 'repository' AS kind, repository_id AS id FROM repositories WHERE user_id <> '3'
UNION ALL SELECT 'ingestion', id FROM i
UNION ALL SELECT 'analysis', a.id FROM analyses AS a WHERE a.ingestion_id NOT IN (SELECT id FROM ingestions SEMI JOIN gone USING (repository_id))
""", "repositories", "ingestions", "analyses")  # fmt: skip
def a8_cascade_delete(spark, d):
    r, i, a = (view(spark, d, v) for v in ("repositories", "ingestions", "analyses"))
    left = tables.cascade(r.where("user_id = '3'").select("repository_id"), [(r, "repository_id", "repository_id"), (i, "id", "repository_id"), (a, "id", "ingestion_id")])
    named = [t.select(F.lit(k).alias("kind"), F.col(c).alias("id")) for t, k, c in zip(left, ("repository", "ingestion", "analysis"), ("repository_id", "id", "id"), strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2])


# --- admission and classification ----------------------------------------------------------------

_SAFE = r"""starts_with(regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN starts_with(entry_path, '/') THEN entry_path ELSE '/workspace/' || entry_path END, '/\./', '/', 'g'), '/[^/.][^/]*/[^/.][^/]*/\.\./\.\./', '/'), '/[^/.][^/]*/\.\./', '/'), '^/[^/.][^/]*/\.\./', '/') || '/', '/workspace/')"""


@query(f"SELECT repository_id, ordinal, {_SAFE} AS safe FROM archive_entries", "archive_entries")
def b1_safe_paths(spark, d):
    return view(spark, d, "archive_entries").select("repository_id", "ordinal", archive.is_safe(F.col("entry_path")).alias("safe"))


LIMITS = archive.Limits(max_repository_bytes=60_000, max_file_bytes=10_000, max_files=20)

_ADMIT = f"""
, k AS (SELECT *, CASE WHEN entry_type IN ('SymbolicLink', 'Link') THEN 'link' WHEN NOT {_SAFE} THEN 'unsafe' WHEN entry_type = 'Directory' THEN 'directory' WHEN size > 10000 THEN 'oversized' ELSE 'file' END AS kind FROM archive_entries),
r AS (SELECT *, count(*) FILTER (kind = 'file') OVER w AS n, coalesce(sum(size) FILTER (kind = 'file') OVER w, 0) AS b FROM k WINDOW w AS (PARTITION BY repository_id ORDER BY ordinal)),
s AS (SELECT *, CASE WHEN kind = 'file' AND n > 20 THEN 'too_many_files' WHEN kind = 'file' AND b > 60000 THEN 'repository_too_large' END AS reason FROM r),
t AS (SELECT *, min(ordinal) FILTER (reason IS NOT NULL) OVER (PARTITION BY repository_id) AS stop FROM s),
a AS (SELECT repository_id, ordinal, CASE WHEN ordinal > stop THEN 'stopped' WHEN reason IS NOT NULL THEN reason WHEN kind = 'file' THEN 'accepted' ELSE kind END AS status FROM t)
"""


@query(_ADMIT + "SELECT * FROM a", "archive_entries")
def b2_admission(spark, d):
    return archive.admit(view(spark, d, "archive_entries"), LIMITS).select("repository_id", "ordinal", "status")


@query(_ADMIT + """
SELECT repository_id, CASE WHEN bool_or(status = 'unsafe') THEN 'unsafe_path' ELSE coalesce(max(status) FILTER (status IN ('too_many_files', 'repository_too_large')), 'accepted') END AS verdict,
       count(*) FILTER (status = 'accepted') AS accepted_count FROM a GROUP BY repository_id
""", "archive_entries")  # fmt: skip
def b3_repository_verdicts(spark, d):
    return archive.verdicts(archive.admit(view(spark, d, "archive_entries"), LIMITS))


@query("SELECT repository_id, ordinal, CASE WHEN strpos(entry_path, '/') > 0 THEN substr(entry_path, strpos(entry_path, '/') + 1) ELSE '' END AS path FROM archive_entries", "archive_entries")
def b4_strip_top_folder(spark, d):
    return view(spark, d, "archive_entries").select("repository_id", "ordinal", archive.stripped(F.col("entry_path")).alias("path"))


_IN = lambda values: ", ".join(f"'{v}'" for v in values)


@query(f"SELECT file_id FROM all_files WHERE NOT list_has_any(string_split(path, '/')[1:-2], [{_IN(classify.IGNORED_FOLDERS)}])", "all_files")
def b5_prune_folders(spark, d):
    return view(spark, d, "all_files").where(~classify.in_ignored_folder(F.col("path"))).select("file_id")


_NAMED = "SELECT *, string_split(path, '/')[-1] AS name, nullif(regexp_extract(string_split(path, '/')[-1], '^.+(\\.[^.]*)$', 1), '') AS extension FROM all_files"


@query(f"SELECT file_id, name, extension FROM ({_NAMED})", "all_files")
def b6_names(spark, d):
    name = X.file_name(F.col("path"))
    return view(spark, d, "all_files").select("file_id", name.alias("name"), X.extension_of(name).alias("extension"))


_LANG = "CASE " + " ".join(f"WHEN lower(extension) IN ({_IN(ends)}) THEN '{name}'" for name, ends in classify.LANGUAGES.items()) + " END"


@query(f"SELECT file_id, {_LANG} AS language FROM ({_NAMED})", "all_files")
def b7_languages(spark, d):
    ext = X.extension_of(X.file_name(F.col("path")))
    return view(spark, d, "all_files").select("file_id", classify.language_of(ext).alias("language"))


_CATEGORY = f"""CASE WHEN name IN ({_IN(classify.GENERATED_NAMES)}) OR name LIKE '%.min.js' OR name LIKE '%.min.css' OR name LIKE '%.map' THEN 'GENERATED'
  WHEN upper(name) IN ({_IN(classify.DOCUMENTATION_NAMES)}) THEN 'DOCUMENTATION' WHEN name IN ({_IN(classify.CONFIG_NAMES)}) THEN 'CONFIG' WHEN {_LANG} IS NOT NULL THEN 'SOURCE'
  WHEN lower(extension) IN ({_IN(classify.DOCUMENTATION_EXTENSIONS)}) THEN 'DOCUMENTATION' WHEN lower(extension) IN ({_IN(classify.CONFIG_EXTENSIONS)}) THEN 'CONFIG'
  WHEN lower(extension) IN ({_IN(classify.BINARY_EXTENSIONS)}) THEN 'BINARY' ELSE 'DATA' END"""
_CLASSIFIED = f"SELECT file_id, run_id, category, CASE WHEN category = 'SOURCE' THEN lang END AS language, category = 'SOURCE' AS is_source, false AS is_ignored FROM (SELECT *, {_CATEGORY} AS category, {_LANG} AS lang FROM ({_NAMED}) WHERE NOT list_has_any(string_split(path, '/')[1:-2], [{_IN(classify.IGNORED_FOLDERS)}]))"


@query(_CLASSIFIED, "all_files")
def b8_classify(spark, d):
    return classify.classify(view(spark, d, "all_files").drop("language")).select("file_id", "run_id", "category", "language", "is_source", "is_ignored")


@query(f"SELECT run_id, count(*) AS file_count, count(*) FILTER (is_source) AS source_file_count FROM ({_CLASSIFIED}) GROUP BY run_id", "all_files")
def b9_ingestion_summary(spark, d):
    return classify.ingestion_summary(classify.classify(view(spark, d, "all_files").drop("language")))


# --- lines and metrics ---------------------------------------------------------------------------

_LINES = r"SELECT run_id, file_id, language, path, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT *, string_split_regex(content, '\r\n|\r|\n') AS l FROM files)"


@query(f"SELECT run_id, file_id, line::INT AS line, md5(text) AS digest FROM ({_LINES})", "files")
def c1_lines(spark, d):
    return lines.numbered_lines(view(spark, d, "files").select("run_id", "file_id", "content")).select("run_id", "file_id", "line", F.md5(F.col("text").cast("binary")).alias("digest"))


_TOKEN = "CASE WHEN language IN ('Python', 'Ruby', 'Shell') THEN '#' WHEN language = 'SQL' THEN '--' WHEN language IN ('TypeScript', 'JavaScript', 'Java', 'C++', 'C', 'Go', 'Rust', 'C#', 'Kotlin', 'Swift') THEN '//' END"


@query(f"SELECT file_id, {_TOKEN} AS token FROM files", "files")
def c2_comment_syntax(spark, d):
    return view(spark, d, "files").select("file_id", lines.line_token(F.col("language")).alias("token"))


_METRICS = rf"""
, l AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, {_TOKEN} AS token FROM ({_LINES})),
m AS (SELECT *, CASE WHEN token = '//' AND starts_with(t, '/*') AND strpos(substr(t, 3), '*/') = 0 THEN 1 WHEN token = '//' AND strpos(t, '*/') > 0 THEN 0 END AS mark FROM l),
s AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY run_id, file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM m),
lm AS (SELECT run_id, file_id, any_value(path) AS path, any_value(language) AS language, count(*)::INT AS line_count, count(*) FILTER (t = '')::INT AS blank_line_count,
       count(*) FILTER (t <> '' AND (open = 1 OR (token = '//' AND starts_with(t, '/*')) OR starts_with(t, token)))::INT AS comment_line_count FROM s GROUP BY run_id, file_id)
"""


@query(_METRICS + "SELECT run_id, file_id, line_count, blank_line_count, comment_line_count, line_count - blank_line_count - comment_line_count AS code_line_count FROM lm", "files")
def c3_line_metrics(spark, d):
    return lines.line_metrics(view(spark, d, "files")).select("run_id", "file_id", "line_count", "blank_line_count", "comment_line_count", "code_line_count")


def _file_metrics(spark, d):
    return lines.file_metrics(view(spark, d, "files"), view(spark, d, "symbols"), view(spark, d, "imports"))


_FILE_METRICS = _METRICS + """
, sy AS (SELECT run_id, file_id, count(*) FILTER (kind IN ('FUNCTION', 'METHOD')) AS fn, count(*) FILTER (kind IN ('CLASS', 'INTERFACE')) AS cl, count(*) FILTER (exported) AS ex, sum(complexity) FILTER (kind IN ('FUNCTION', 'METHOD')) AS cx FROM symbols GROUP BY run_id, file_id),
im AS (SELECT run_id, file_id, count(*) AS n FROM imports GROUP BY run_id, file_id),
fm AS (SELECT lm.run_id, lm.file_id, path, line_count, line_count - blank_line_count - comment_line_count AS code_line_count, comment_line_count, blank_line_count,
       coalesce(fn, 0)::INT AS function_count, coalesce(cl, 0)::INT AS class_count, coalesce(n, 0)::INT AS import_count, coalesce(ex, 0)::INT AS export_count,
       CASE WHEN language IN ('TypeScript', 'JavaScript') THEN coalesce(cx, 0)::INT END AS complexity
       FROM lm LEFT JOIN sy ON lm.run_id = sy.run_id AND lm.file_id = sy.file_id LEFT JOIN im ON lm.run_id = im.run_id AND lm.file_id = im.file_id)
"""


@query(_FILE_METRICS + "SELECT * FROM fm", "files", "symbols", "imports")
def c4_file_metrics(spark, d):
    return _file_metrics(spark, d)


@query("SELECT file_id, CASE WHEN language IN ('TypeScript', 'JavaScript') THEN 'ast' WHEN language IN ('Python', 'Java', 'C++', 'C', 'Go') THEN 'heuristic' ELSE 'none' END AS strategy FROM files", "files")
def c5_parse_strategy(spark, d):
    return view(spark, d, "files").select("file_id", lines.parse_strategy(F.col("language")).alias("strategy"))


def _parsed(spark, d):
    """Symbols of all files: those given for languages with a syntax tree, extracted ones for others."""
    f = view(spark, d, "files")
    given = view(spark, d, "symbols").join(f.where(lines.parse_strategy(F.col("language")) == "ast").select("run_id", "file_id"), ["run_id", "file_id"], "left_semi")
    found = symbols.extract_symbols(f).withColumns({"symbol_id": F.concat_ws("-", "file_id", F.col("ordinal").cast("string")), "complexity": F.lit(None).cast("int")})
    cols = ["run_id", "file_id", "symbol_id", "ordinal", "name", "kind", "start_line", "end_line", "exported", "parent_name", "complexity", "parameter_count"]
    return symbols.with_parent_ids(given.select(*cols).unionByName(found.select(*cols)))


# --- symbols and imports -------------------------------------------------------------------------

_IMPORTS = r"""
, l AS (SELECT * FROM (SELECT run_id, file_id, language, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT *, string_split_regex(content, '\r\n|\r|\n') AS l FROM files)) WHERE language IN ('Python', 'Java', 'C', 'C++', 'Go')),
py AS (SELECT run_id, file_id, CASE WHEN regexp_matches(text, '^\s*from\s+([\w.]+)\s+import\b') THEN [regexp_extract(text, '^\s*from\s+([\w.]+)\s+import\b', 1)] ELSE string_split(regexp_extract(text, '^\s*import\s+(.+)$', 1), ',') END AS m, line FROM l WHERE language = 'Python'),
pm AS (SELECT run_id, file_id, trim(regexp_replace(trim(u), '\s+as\s+.*', '')) AS source, 'IMPORT' AS kind, line FROM (SELECT *, unnest(m) AS u FROM py)),
ja AS (SELECT run_id, file_id, regexp_extract(text, '^\s*import\s+(?:static\s+)?([\w.*]+)\s*;', 1) AS source, 'IMPORT' AS kind, line FROM l WHERE language = 'Java'),
cc AS (SELECT run_id, file_id, regexp_extract(text, '^\s*#include\s*[<"]([^>"]+)[>"]', 1) AS source, 'INCLUDE' AS kind, line FROM l WHERE language IN ('C', 'C++')),
g1 AS (SELECT run_id, file_id, line, trim(text) AS t, CASE WHEN regexp_matches(trim(text), '^import\s*\(') THEN 1 WHEN trim(text) = ')' THEN 0 END AS mark FROM l WHERE language = 'Go'),
g2 AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY run_id, file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM g1),
go AS (SELECT run_id, file_id, CASE WHEN inside = 1 THEN regexp_extract(t, '"([^"]+)"', 1) ELSE regexp_extract(t, '^import\s+"([^"]+)"', 1) END AS source, 'IMPORT' AS kind, line FROM g2)
SELECT run_id, file_id, source, kind, line::INT AS line FROM (SELECT * FROM pm UNION ALL SELECT * FROM ja UNION ALL SELECT * FROM cc UNION ALL SELECT * FROM go) WHERE source <> ''
"""


@query(_IMPORTS, "files")
def d1_d4_imports(spark, d):
    return symbols.extract_imports(view(spark, d, "files"))


_WORD = r"[\p{L}\p{N}_]"
_SP = r"[\s\p{Z}\x0B\x1C-\x1F\x85]"
_GROUP = lambda text, pattern, n: f"regexp_extract({text}, '{pattern}', {n})"
#: Per language: heads of classes and of functions, matched against the line.
_PY_CLASS, _PY_DEF = rf"^({_SP}*)class{_SP}+([A-Za-z_]{_WORD}*)", rf"^({_SP}*)def{_SP}+([A-Za-z_]{_WORD}*){_SP}*\(([^)]*)\)"
_JA_IMPORT, _JA_CLASS = rf"^{_SP}*import{_SP}+(?:static{_SP}+)?([\p{{L}}\p{{N}}_.*]+){_SP}*;", rf"^(?:{_SP}*)(?:public|private|protected|static|final|abstract|{_SP})*class{_SP}+({_WORD}+)"
_JA_FACE, _JA_METHOD = rf"^(?:{_SP}*)(?:public|private|protected|{_SP})*interface{_SP}+({_WORD}+)", rf"^(?:public|private|protected|static|final|synchronized|abstract|native|{_SP})*[\p{{L}}\p{{N}}_<>\[\],.]+{_SP}+({_WORD}+){_SP}*\(([^;{{)]*)\){_SP}*(?:throws{_SP}+[\p{{L}}\p{{N}}_,\s\p{{Z}}]+)?\{{"
_CC_CLASS, _CC_FUNC = rf"^{_SP}*class{_SP}+({_WORD}+)", rf"^[\p{{L}}\p{{N}}_:<>*&,\s\p{{Z}}]+[\s\p{{Z}}*&]({_WORD}+){_SP}*\(([^;{{)]*)\){_SP}*(?:const{_SP}*)?\{{"
_GO_STRUCT, _GO_FUNC = rf"^type{_SP}+({_WORD}+){_SP}+struct{_SP}*\{{", rf"^func{_SP}+(?:\([^)]*\){_SP}*)?({_WORD}+){_SP}*\(([^)]*)\)[^{{]*\{{"
_STRIP = lambda text: f"regexp_replace({text}, '^{_SP}+|{_SP}+$', '', 'g')"
_INNER = r"regexp_extract(text, '\(([^)]*)\)', 1)"
_SYMBOLS = rf"""
, l0 AS MATERIALIZED (SELECT run_id, file_id, language, line, CASE WHEN language = 'Go' THEN {_STRIP('text')} ELSE text END AS text FROM ({_LINES}) WHERE language IN ('Python', 'Java', 'C', 'C++', 'Go')),
l1 AS (SELECT *, CASE WHEN language = 'Go' AND regexp_matches(text, '^import{_SP}*\(') THEN 1 WHEN language = 'Go' AND text = ')' THEN 0 END AS mark, length(text) - length(replace(text, '{{', '')) AS opens, length(text) - length(replace(text, '}}', '')) AS shuts FROM l0),
l2 AS MATERIALIZED (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY run_id, file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 OR mark = 1 AS importing,
  sum(opens - shuts) OVER (PARTITION BY run_id, file_id ORDER BY line) AS depth, count(*) OVER (PARTITION BY run_id, file_id) AS total,
  CASE WHEN regexp_matches(text, '^{_SP}*$') THEN NULL ELSE length(text) - length(regexp_replace(text, '^{_SP}+', '')) END AS indent FROM l1),
h AS (SELECT *, CASE language WHEN 'Python' THEN {_GROUP('text', _PY_CLASS, 2)} WHEN 'Java' THEN CASE WHEN regexp_matches(text, '{_JA_IMPORT}') THEN '' WHEN regexp_matches(text, '{_JA_FACE}') THEN {_GROUP('text', _JA_FACE, 1)} ELSE {_GROUP('text', _JA_CLASS, 1)} END
    WHEN 'Go' THEN {_GROUP('text', _GO_STRUCT, 1)} ELSE {_GROUP('text', _CC_CLASS, 1)} END AS holder,
  CASE language WHEN 'Python' THEN {_GROUP('text', _PY_DEF, 2)} WHEN 'Java' THEN {_GROUP('text', _JA_METHOD, 1)} WHEN 'Go' THEN {_GROUP('text', _GO_FUNC, 1)} ELSE {_GROUP('text', _CC_FUNC, 1)} END AS call,
  CASE language WHEN 'Python' THEN {_GROUP('text', _PY_DEF, 3)} WHEN 'Java' THEN {_GROUP('text', _JA_METHOD, 2)} WHEN 'Go' THEN {_GROUP('text', _GO_FUNC, 2)} ELSE {_GROUP('text', _CC_FUNC, 2)} END AS args,
  language = 'Java' AND regexp_matches(text, '{_JA_FACE}') AS face
  FROM l2 WHERE NOT coalesce(importing, false) AND NOT (language IN ('C', 'C++') AND regexp_matches(text, '^{_SP}*#include{_SP}*[<"]([^>"]+)[>"]'))),
hd AS MATERIALIZED (SELECT *, depth - opens + shuts AS before FROM h WHERE holder <> '' OR (call <> '' AND (language IN ('Python', 'Go') OR call NOT IN ({_IN(symbols.CONTROL)})))),
op AS (SELECT hd.run_id, hd.file_id, hd.line, min(l.line) AS k FROM hd JOIN l2 AS l USING (run_id, file_id) WHERE hd.language <> 'Python' AND l.line >= hd.line AND l.opens > 0 GROUP BY ALL),
be AS (SELECT hd.run_id, hd.file_id, hd.line, coalesce(min(l.line), any_value(hd.total)) AS ending FROM hd LEFT JOIN op USING (run_id, file_id, line) LEFT JOIN l2 AS l ON l.run_id = hd.run_id AND l.file_id = hd.file_id AND l.line >= op.k AND l.depth <= hd.before WHERE hd.language <> 'Python' GROUP BY ALL),
sh AS (SELECT hd.run_id, hd.file_id, hd.line, min(l.line) AS k FROM hd LEFT JOIN l2 AS l ON l.run_id = hd.run_id AND l.file_id = hd.file_id AND l.line > hd.line AND l.indent <= hd.indent WHERE hd.language = 'Python' GROUP BY ALL),
pe AS (SELECT sh.run_id, sh.file_id, sh.line, coalesce(max(l.line), sh.line) AS ending FROM sh LEFT JOIN l2 AS l ON l.run_id = sh.run_id AND l.file_id = sh.file_id AND l.line > sh.line AND l.indent IS NOT NULL AND (sh.k IS NULL OR l.line < sh.k) GROUP BY sh.run_id, sh.file_id, sh.line),
e AS MATERIALIZED (SELECT hd.*, x.ending FROM hd JOIN (SELECT * FROM be UNION ALL SELECT * FROM pe) AS x USING (run_id, file_id, line)),
lo AS (SELECT c.run_id, c.file_id, c.line, j.line AS of, min(k.indent) AS least FROM e AS c JOIN e AS j ON j.run_id = c.run_id AND j.file_id = c.file_id AND j.line < c.line AND j.holder <> '' JOIN e AS k ON k.run_id = c.run_id AND k.file_id = c.file_id AND k.line > j.line AND k.line <= c.line WHERE c.language = 'Python' GROUP BY ALL),
pa AS (SELECT c.run_id, c.file_id, c.line, max_by(j.holder, j.line) AS parent FROM e AS c JOIN e AS j ON j.run_id = c.run_id AND j.file_id = c.file_id AND j.line < c.line AND j.holder <> ''
  LEFT JOIN lo ON lo.run_id = c.run_id AND lo.file_id = c.file_id AND lo.line = c.line AND lo.of = j.line WHERE CASE WHEN c.language = 'Python' THEN lo.least > j.indent ELSE j.ending >= c.line END GROUP BY ALL),
f AS (SELECT e.*, parent, len(list_filter(string_split({_INNER}, ','), lambda p: {_STRIP('p')} <> '')) AS n FROM e LEFT JOIN pa USING (run_id, file_id, line) WHERE holder <> '' OR language <> 'Java' OR parent IS NOT NULL),
sy2 AS (SELECT run_id, file_id, (row_number() OVER (PARTITION BY run_id, file_id ORDER BY line) - 1)::INT AS ordinal, CASE WHEN holder <> '' THEN holder ELSE call END AS name,
  CASE WHEN holder <> '' THEN CASE WHEN face THEN 'INTERFACE' ELSE 'CLASS' END WHEN language = 'Java' OR (language <> 'Go' AND parent IS NOT NULL) THEN 'METHOD' ELSE 'FUNCTION' END AS kind, line::INT AS start_line, ending::INT AS end_line,
  CASE WHEN language = 'Go' THEN regexp_matches(CASE WHEN holder <> '' THEN holder ELSE call END, '^[A-Z]') WHEN holder <> '' OR language IN ('C', 'C++') THEN true WHEN language = 'Java' THEN NOT contains(text, 'private') ELSE NOT starts_with(call, '_') END AS exported, parent AS parent_name,
  CASE WHEN holder <> '' THEN CASE language WHEN 'Go' THEN 'type ' || holder || ' struct' ELSE CASE WHEN face THEN 'interface ' ELSE 'class ' END || holder END
    ELSE CASE language WHEN 'Python' THEN 'def ' WHEN 'Go' THEN 'func ' ELSE '' END || call || '(' || {_STRIP('args')} || ')' END AS signature,
  CASE WHEN holder <> '' THEN NULL WHEN language = 'Python' AND parent IS NOT NULL THEN greatest(0, n - 1) ELSE n END::INT AS parameter_count FROM f)
"""


@query(_SYMBOLS + "SELECT * FROM sy2", "files")
def d5_d9_symbols(spark, d):
    return symbols.extract_symbols(view(spark, d, "files"))


@query(rf"SELECT run_id, file_id, line::INT AS line, len(list_filter(string_split(regexp_extract(text, '\(([^)]*)\)', 1), ','), lambda p: trim(p) <> ''))::INT AS n FROM ({_LINES}) WHERE regexp_matches(text, '\([^)]*\)')", "files")
def d10_parameter_counts(spark, d):
    rows = lines.numbered_lines(view(spark, d, "files").select("run_id", "file_id", "content"))
    counted = rows.select("run_id", "file_id", "line", symbols.parameter_count(F.col("text")).alias("n"))
    return counted.where("n is not null")


@query("""
SELECT s.run_id, s.file_id, s.symbol_id, p.symbol_id AS parent_id FROM symbols AS s
LEFT JOIN (SELECT run_id, file_id, name, max_by(symbol_id, ordinal) AS symbol_id FROM symbols GROUP BY run_id, file_id, name) AS p ON p.run_id = s.run_id AND p.file_id = s.file_id AND p.name = s.parent_name
""", "symbols")  # fmt: skip
def d12_parent_ids(spark, d):
    return symbols.with_parent_ids(view(spark, d, "symbols")).select("run_id", "file_id", "symbol_id", "parent_id")


# --- dependency graph ----------------------------------------------------------------------------

_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '/\./', '/', 'g'), '/\./', '/', 'g'), '//+', '/', 'g'), '[^/.][^/]*/\.\./', ''), '[^/.][^/]*/\.\./', ''), '^\./', '')"


@query(f"SELECT run_id, import_id, {_NORMAL} AS path FROM (SELECT i.run_id, import_id, regexp_replace(f.path, '/[^/]*$', '') || '/' || i.source AS p FROM imports AS i JOIN files AS f ON f.run_id = i.run_id AND f.file_id = i.file_id WHERE starts_with(i.source, '.'))", "imports", "files")
def g1_normal_paths(spark, d):
    joined = view(spark, d, "imports").where("source like '.%'").join(view(spark, d, "files").select("run_id", "file_id", "path"), ["run_id", "file_id"])
    return joined.select("run_id", "import_id", X.normal_path(F.concat_ws("/", X.parent_folder(F.col("path")), "source")).alias("path"))


_SUFFIX = ", ".join(f"({i}, '{s}')" for i, s in enumerate(graph.SUFFIXES))
_EDGES = f"""
, b AS (SELECT run_id, import_id, {_NORMAL} AS base FROM (SELECT i.run_id, import_id, regexp_replace(f.path, '/[^/]*$', '') || '/' || i.source AS p FROM imports AS i JOIN files AS f ON f.run_id = i.run_id AND f.file_id = i.file_id
      WHERE f.language IN ('TypeScript', 'JavaScript') AND (starts_with(i.source, './') OR starts_with(i.source, '../')))),
t AS (SELECT b.run_id, import_id, arg_min(f.file_id, k) AS target_file_id, arg_min(f.path, k) AS target_path FROM b, (VALUES {_SUFFIX}) AS s(k, suffix), files AS f WHERE f.run_id = b.run_id AND f.path = base || suffix GROUP BY b.run_id, import_id)
"""


@query(_EDGES + "SELECT i.run_id, i.import_id, file_id, target_file_id, target_path FROM imports AS i LEFT JOIN t ON t.run_id = i.run_id AND t.import_id = i.import_id", "imports", "files")
def g2_g4_resolved_imports(spark, d):
    return graph.resolve_imports(view(spark, d, "imports"), view(spark, d, "files")).select("run_id", "import_id", "file_id", "target_file_id", "target_path")


@query(_EDGES + "SELECT i.run_id, i.import_id, file_id AS source_file_id, target_file_id, target_file_id IS NULL AS external, kind, source AS specifier FROM imports AS i LEFT JOIN t ON t.run_id = i.run_id AND t.import_id = i.import_id", "imports", "files")
def g3_dependency_edges(spark, d):
    return graph.dependency_edges(view(spark, d, "imports"), view(spark, d, "files"))


# --- rules ---------------------------------------------------------------------------------------

_OUT = ["run_id", "file_id", "rule_id", "severity", "message", "line"]
_R1 = "SELECT run_id, file_id, 'COMPLEXITY_HIGH' AS rule_id, CASE WHEN complexity > 20 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, name || ' has a cyclomatic complexity of ' || complexity || ', above the configured threshold of 10' AS message, start_line AS line FROM symbols WHERE kind IN ('FUNCTION', 'METHOD') AND complexity > 10"
_R2 = "SELECT run_id, file_id, 'FILE_TOO_LARGE' AS rule_id, CASE WHEN line_count > 40 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, path || ' has ' || line_count || ' lines, above the configured threshold of 20' AS message, NULL::INT AS line FROM fm WHERE line_count > 20"
_R3 = "SELECT run_id, file_id, 'FUNCTION_TOO_LONG' AS rule_id, CASE WHEN end_line - start_line + 1 > 160 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, name || ' spans ' || (end_line - start_line + 1) || ' lines, above the configured threshold of 80' AS message, start_line AS line FROM symbols WHERE kind IN ('FUNCTION', 'METHOD') AND end_line - start_line + 1 > 80"
_R4 = "SELECT run_id, file_id, 'TOO_MANY_PARAMETERS' AS rule_id, 'LOW' AS severity, name || ' has ' || parameter_count || ' parameters, above the configured threshold of 5' AS message, start_line AS line FROM symbols WHERE kind IN ('FUNCTION', 'METHOD') AND parameter_count > 5"
_R5 = rf"SELECT run_id, file_id, 'TODO_COMMENT' AS rule_id, 'INFO' AS severity, substr(marker || ' comment: ' || CASE WHEN rest <> '' THEN rest ELSE trim(text) END, 1, 240) AS message, line::INT AS line FROM (SELECT *, regexp_extract(text, '\b(TODO|FIXME)\b', 1) AS marker, trim(regexp_extract(text, '\b(TODO|FIXME)\b:?\s*(.*)', 2)) AS rest FROM ({_LINES}) WHERE regexp_matches(text, '\b(TODO|FIXME)\b'))"

_C6_RULES = " UNION ALL ".join([
    *[r.replace("FROM symbols", "FROM cs") for r in (_R1, _R3, _R4)],
    _R2.replace("FROM fm", "FROM lm").replace("> 40", "> 1000").replace("of 20", "of 500").replace("> 20", "> 500"), _R5,
])


@query(_METRICS + _SYMBOLS + f"""
, cs AS (SELECT s.run_id, s.file_id, s.name, s.kind, s.start_line, s.end_line, s.complexity, s.parameter_count FROM symbols AS s JOIN files AS g ON g.run_id = s.run_id AND g.file_id = s.file_id WHERE g.language IN ('TypeScript', 'JavaScript')
  UNION ALL SELECT run_id, file_id, name, kind, start_line, end_line, NULL, parameter_count FROM sy2)
{_C6_RULES}
""", "files", "symbols")  # fmt: skip
def c6_analyze_files(spark, d):
    f, s = view(spark, d, "files"), stored(_parsed(spark, d), "symbols")
    found = symbols.extract_imports(f)
    metrics = lines.file_metrics(f, s, found)
    return rules.run_rules(rules.Context(f, s, metrics)).select("run_id", "file_id", "rule_id", "severity", "message", "line")


#: The derived files are short: a lower line limit lets the rule find some.
LIMITS_OF_RULES = rules.Thresholds(file_too_large_lines=20)


def _context(spark, d, metrics=None):
    return rules.Context(view(spark, d, "files"), view(spark, d, "symbols"), metrics or _file_metrics(spark, d), LIMITS_OF_RULES)


def _findings(spark, d, metrics=None):
    return rules.run_rules(_context(spark, d, metrics)).withColumn("created_at", F.lit(NOW).cast("timestamp_ntz"))


@query(_R1, "symbols")
def r1_complexity_high(spark, d):
    return rules.complexity_high(_context(spark, d)).select(*_OUT)


@query(_FILE_METRICS + _R2, "files", "symbols", "imports")
def r2_file_too_large(spark, d):
    return rules.file_too_large(_context(spark, d)).select(*_OUT)


@query(_R3, "symbols")
def r3_function_too_long(spark, d):
    return rules.function_too_long(_context(spark, d)).select(*_OUT)


@query(_R4, "symbols")
def r4_too_many_parameters(spark, d):
    return rules.too_many_parameters(_context(spark, d)).select(*_OUT)


@query(_R5, "files")
def r5_todo_comment(spark, d):
    return rules.todo_comment(_context(spark, d)).select(*_OUT)


_ALL = _FILE_METRICS + f", fi AS ({_R1} UNION ALL {_R2} UNION ALL {_R3} UNION ALL {_R4} UNION ALL {_R5})\n"
_NEED = ("files", "symbols", "imports")


@query(_ALL + "SELECT * FROM fi", *_NEED)
def r6_all_rules(spark, d):
    return _findings(spark, d).select(*_OUT)


@query(_ALL + """
SELECT f.run_id, count(*) AS files_analyzed, coalesce((SELECT count(*) FROM symbols AS s WHERE s.run_id = f.run_id), 0) AS symbols_found,
       coalesce((SELECT count(*) FROM imports AS i WHERE i.run_id = f.run_id), 0) AS imports_found, coalesce((SELECT count(*) FROM fi WHERE fi.run_id = f.run_id), 0) AS findings_count FROM files AS f GROUP BY f.run_id
""", *_NEED)  # fmt: skip
def r7_run_summary(spark, d):
    return rules.run_summary(view(spark, d, "files"), view(spark, d, "symbols"), view(spark, d, "imports"), _findings(spark, d))


# --- reports -------------------------------------------------------------------------------------


@query(_ALL + "SELECT run_id, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITIES) + " FROM fi GROUP BY run_id", *_NEED)
def p1_severity_counts(spark, d):
    return reports.severity_counts(_findings(spark, d))


_SEV = "CASE severity WHEN 'INFO' THEN 1 WHEN 'LOW' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'HIGH' THEN 4 ELSE 5 END"


@query(_ALL + f"SELECT fi.run_id, fi.file_id, rule_id, severity, message, line, path FROM fi LEFT JOIN files AS f ON f.run_id = fi.run_id AND f.file_id = fi.file_id ORDER BY {_SEV}, fi.run_id, path NULLS FIRST, line NULLS FIRST, rule_id, message LIMIT 50 OFFSET 50", *_NEED)
def p2_findings_page(spark, d):
    return reports.findings_page(_findings(spark, d), view(spark, d, "files"), page=2)[0].select(*_OUT, "path")


@query(_ALL + f"""
, o AS (SELECT fi.run_id, fi.file_id, rule_id, severity, message, line, path, row_number() OVER (ORDER BY {_SEV}, fi.run_id, path NULLS FIRST, line NULLS FIRST, rule_id, message) AS n, count(*) OVER () AS total
  FROM fi LEFT JOIN files AS f ON f.run_id = fi.run_id AND f.file_id = fi.file_id)
SELECT run_id, file_id, rule_id, severity, message, line, path FROM o WHERE (n - 1) // 50 = (total - 1) // 50
""", *_NEED)  # fmt: skip
def p2_last_page(spark, d):
    """The last page of all findings, from the ranges that hold it."""
    ordered = reports.ordered_findings(_findings(spark, d), view(spark, d, "files"))
    return ordered.page(max(1, -(-ordered.total // 50)), 50).select(*_OUT, "path")


@query(_ALL + f"SELECT fi.run_id, fi.file_id, rule_id, severity, message, line, path FROM fi LEFT JOIN files AS f ON f.run_id = fi.run_id AND f.file_id = fi.file_id WHERE fi.run_id = 'src3' AND rule_id = 'TOO_MANY_PARAMETERS' ORDER BY {_SEV}, path NULLS FIRST, line NULLS FIRST, message LIMIT 20", *_NEED)
def p2_findings_of_a_rule(spark, d):
    return reports.findings_page(_findings(spark, d), view(spark, d, "files"), run_id="src3", rule_id="TOO_MANY_PARAMETERS", page_size=20)[0].select(*_OUT, "path")


@query(_ALL + "SELECT count(*) AS total FROM fi WHERE severity = 'MEDIUM'", *_NEED)
def p2_findings_total(spark, d):
    return reports.findings_page(_findings(spark, d), view(spark, d, "files"), severity="MEDIUM")[1]


@query(_ALL + """
SELECT run_id, file_id, line_count, coalesce((SELECT count(*) FROM symbols AS s WHERE s.run_id = fm.run_id AND s.file_id = fm.file_id), 0) AS symbol_total,
       coalesce((SELECT count(*) FROM imports AS i WHERE i.run_id = fm.run_id AND i.file_id = fm.file_id), 0) AS import_total, coalesce((SELECT count(*) FROM fi WHERE fi.run_id = fm.run_id AND fi.file_id = fm.file_id), 0) AS finding_total FROM fm
""", *_NEED)  # fmt: skip
def p3_file_explorer(spark, d):
    metrics = stored(_file_metrics(spark, d), "metrics")
    found = reports.file_explorer(metrics, view(spark, d, "symbols"), view(spark, d, "imports"), _findings(spark, d, metrics))
    return found.select("run_id", "file_id", "line_count", "symbol_total", "import_total", "finding_total")


@query("SELECT s.run_id, s.symbol_id, p.name AS parent_symbol_name, s.start_line FROM symbols AS s LEFT JOIN symbols AS p ON p.run_id = s.run_id AND p.symbol_id = s.parent_id", "symbols")
def p4_file_symbols(spark, d):
    return reports.file_symbols(view(spark, d, "symbols")).select("run_id", "symbol_id", "parent_symbol_name", "start_line")


@query(_EDGES + "SELECT i.run_id, i.import_id, t.target_path AS resolved_path, i.line FROM imports AS i LEFT JOIN t ON t.run_id = i.run_id AND t.import_id = i.import_id", "imports", "files")
def p4_file_imports(spark, d):
    f = view(spark, d, "files")
    return reports.file_imports(graph.resolve_imports(view(spark, d, "imports"), f), f).select("run_id", "import_id", "resolved_path", "line")


_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY created_at DESC, id DESC) AS n FROM {0}) WHERE n <= {1})"


@query("SELECT repository_id, id, n::INT AS rank FROM " + _LATEST.format("ingestions", 100), "ingestions")
def p5_run_history(spark, d):
    return reports.run_history(view(spark, d, "ingestions")).select("repository_id", "id", "rank")


_HISTORY = "SELECT repository_id, id, n::INT AS rank FROM " + _LATEST


def _history(spark, d, runs_of: str):
    return reports.run_history(view(spark, d, runs_of)).select("repository_id", "id", "rank")


@query(_HISTORY.format("analyses", 100), "analyses")
def p5_analysis_history(spark, d):
    return _history(spark, d, "analyses")


@query(_HISTORY.format("embeddings_runs", 100), "embeddings_runs")
def p5_embedding_history(spark, d):
    return _history(spark, d, "embeddings_runs")


@query(_HISTORY.format("ai_runs", 100), "ai_runs")
def p5_ai_history(spark, d):
    return _history(spark, d, "ai_runs")


_P6 = f"SELECT r.repository_id, r.user_id, i.id AS ingestion_id, i.status AS ingestion_status, a.status AS analysis_status, a.findings_count FROM repositories AS r LEFT JOIN {_LATEST.format('ingestions', 1)} AS i ON i.repository_id = r.repository_id LEFT JOIN analyses AS a ON a.ingestion_id = i.id"


def _with_latest(spark, d):
    return reports.repositories_with_latest(_repos(spark, d), view(spark, d, "ingestions"), view(spark, d, "analyses"))


@query(_P6, "repositories", "ingestions", "analyses")
def p6_repositories_with_latest(spark, d):
    return _with_latest(spark, d).select("repository_id", "user_id", "ingestion_id", "ingestion_status", "analysis_status", "findings_count")


@query(f"SELECT user_id, count(*) AS repository_count, count(*) FILTER (ingestion_status = 'COMPLETED') AS ingested_count, count(*) FILTER (analysis_status = 'COMPLETED') AS analyzed_count, coalesce(sum(findings_count) FILTER (analysis_status = 'COMPLETED'), 0)::BIGINT AS total_findings FROM ({_P6}) GROUP BY user_id", "repositories", "ingestions", "analyses")
def p7_dashboard(spark, d):
    return reports.dashboard(_with_latest(spark, d))


@query("SELECT repository_id FROM repositories WHERE lower(full_name) LIKE '%machinery%' OR lower(description) LIKE '%machinery%'", "repositories")
def p8_text_filter(spark, d):
    return reports.text_filter(_repos(spark, d), "  Machinery ").select("repository_id")


@query("SELECT a.id FROM analyses AS a JOIN ingestions AS i ON i.id = a.ingestion_id JOIN repositories AS r ON r.repository_id = i.repository_id WHERE r.user_id = '5'", "repositories", "ingestions", "analyses")
def p9_owned_runs(spark, d):
    i = view(spark, d, "ingestions").withColumnRenamed("id", "ingestion_id")
    return reports.owned_by(view(spark, d, "analyses"), [(i, "ingestion_id")], _repos(spark, d), F.lit("5")).select("id")


# --- run bookkeeping -----------------------------------------------------------------------------

_ACTIVE = lambda kind, c="status": f"{c} IN ({_IN(runs.ACTIVE[kind])})"
_AGE = lambda c="updated_at": f"epoch_us(TIMESTAMP '{NOW}') - epoch_us({c}) > 1800000000"


@query(f"SELECT id FROM ingestions WHERE {_ACTIVE('ingestion')} AND {_AGE()}", "ingestions")
def k1_stale_runs(spark, d):
    i = view(spark, d, "ingestions")
    return i.where(runs.is_stale(F.col("status"), F.col("updated_at"), _now(), "ingestion")).select("id")


@query(f"""
, x AS (SELECT repository_id, commit_sha, max_by(id, id::INT) AS id FROM ingestions GROUP BY repository_id, commit_sha), e AS (SELECT i.* FROM ingestions AS i JOIN x ON x.id = i.id), q AS (SELECT repository_id, 'sha' || k AS commit_sha FROM repositories, (SELECT unnest(range(40)) AS k))
SELECT q.repository_id, q.commit_sha, e.id AS ingestion_id, CASE WHEN e.id IS NULL THEN 'create' WHEN {_ACTIVE('ingestion')} AND NOT {_AGE()} THEN 'in_progress' WHEN status = 'COMPLETED' THEN 'reuse' ELSE 'retry' END AS plan
FROM q LEFT JOIN e ON e.repository_id = q.repository_id AND e.commit_sha = q.commit_sha
""", "ingestions", "repositories")  # fmt: skip
def k2_plan_ingestions(spark, d):
    i = view(spark, d, "ingestions")
    one = i.groupBy("repository_id", "commit_sha").agg(F.max_by("id", F.col("id").cast("int")).alias("id"))
    asked = _repos(spark, d).select("repository_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("k")).select("repository_id", F.concat(F.lit("sha"), F.col("k").cast("string")).alias("commit_sha"))
    return runs.plan_ingestions(asked, i.join(one.select("id"), "id", "left_semi"), _now())


_PLAN = lambda ready, run, kind: f"CASE WHEN NOT coalesce({ready}, false) THEN 'blocked' WHEN {run}.id IS NULL THEN 'create' WHEN {_ACTIVE(kind, run + '.status')} AND NOT {_AGE(run + '.updated_at')} THEN 'in_progress' ELSE 'rerun' END AS plan"
_FROM = f"FROM repositories AS r LEFT JOIN {_LATEST.format('ingestions', 1)} AS i ON i.repository_id = r.repository_id LEFT JOIN analyses AS a ON a.ingestion_id = i.id"


@query("SELECT r.repository_id, " + _PLAN("i.status = 'COMPLETED'", "a", "analysis") + " " + _FROM, "repositories", "ingestions", "analyses")
def k3_plan_analyses(spark, d):
    return runs.plan_analyses(_repos(spark, d), view(spark, d, "ingestions"), view(spark, d, "analyses"), _now())


@query("SELECT r.repository_id, " + _PLAN("a.status = 'COMPLETED'", "e", "embedding") + " " + _FROM + " LEFT JOIN embeddings_runs AS e ON e.analysis_run_id = a.id", "repositories", "ingestions", "analyses", "embeddings_runs")
def k4_plan_embeddings(spark, d):
    return runs.plan_embeddings(_repos(spark, d), view(spark, d, "ingestions"), view(spark, d, "analyses"), view(spark, d, "embeddings_runs"), _now())


@query("SELECT r.repository_id, " + _PLAN("a.status = 'COMPLETED' AND e.status = 'COMPLETED'", "x", "ai") + " " + _FROM + " LEFT JOIN embeddings_runs AS e ON e.analysis_run_id = a.id LEFT JOIN ai_runs AS x ON x.analysis_run_id = a.id", "repositories", "ingestions", "analyses", "embeddings_runs", "ai_runs")
def k4_plan_ai(spark, d):
    v = [view(spark, d, n) for n in ("ingestions", "analyses", "embeddings_runs", "ai_runs")]
    return runs.plan_ai(_repos(spark, d), *v, _now())


@query("SELECT id, CASE WHEN discovered = 0 THEN 0 ELSE least(100, round((embedded + reused) / discovered * 100))::INT END AS percent FROM embeddings_runs", "embeddings_runs")
def k5_index_progress(spark, d):
    return view(spark, d, "embeddings_runs").select("id", runs.index_progress(F.col("discovered"), F.col("reused"), F.col("embedded")).alias("percent"))


# --- chunks --------------------------------------------------------------------------------------

_REGIONS = """
, t AS (SELECT *, len(string_split(content, chr(10))) AS total FROM files WHERE regexp_matches(content, '\\S')),
top AS (SELECT *, coalesce(lag(end_line) OVER w + 1, 1) AS cursor, row_number() OVER w AS n, lead(symbol_id) OVER w IS NULL AS last FROM symbols WHERE parent_id IS NULL WINDOW w AS (PARTITION BY run_id, file_id ORDER BY start_line, ordinal)),
g AS (SELECT t.run_id, t.file_id, n * 3 AS place, cursor AS a, start_line - 1 AS b, NULL AS symbol_id FROM t JOIN top USING (run_id, file_id) WHERE start_line > cursor
  UNION ALL SELECT t.run_id, t.file_id, n * 3 + 1, start_line, end_line, symbol_id FROM t JOIN top USING (run_id, file_id)
  UNION ALL SELECT t.run_id, t.file_id, n * 3 + 2, end_line + 1, total, NULL FROM t JOIN top USING (run_id, file_id) WHERE last AND end_line + 1 <= total
  UNION ALL SELECT t.run_id, t.file_id, 0, 1, total, NULL FROM t ANTI JOIN top USING (run_id, file_id))
"""


@query(_REGIONS + "SELECT run_id, file_id, (row_number() OVER (PARTITION BY run_id, file_id ORDER BY place) - 1)::INT AS place, a::INT AS start_line, b::INT AS end_line, symbol_id FROM g", "files", "symbols")
def e1_regions(spark, d):
    found = chunks.regions(view(spark, d, "files"), view(spark, d, "symbols"))
    return found.select("run_id", "file_id", "place", "start_line", "end_line", "symbol_id")


def _chunks(target: int, most: int, overlap: int) -> str:
    """Regions, two levels of children for oversized ones, then line ranges for those still too long."""
    text = "array_to_string(string_split(content, chr(10))[greatest(a, 1):b], chr(10))"
    out = _REGIONS + """,
r0 AS (SELECT g.run_id, g.file_id, row_number() OVER (PARTITION BY g.run_id, g.file_id ORDER BY place) AS place, a, b, g.symbol_id, s.name FROM g LEFT JOIN symbols AS s ON s.run_id = g.run_id AND s.file_id = g.file_id AND s.symbol_id = g.symbol_id)"""
    for i in range(chunks.DEPTH):
        out += f""",
o{i} AS (SELECT r.run_id, r.file_id, r.place, r.a, r.b, r.symbol_id, r.name, c.symbol_id AS cid, c.name AS cname, c.start_line AS cs, c.end_line AS ce, row_number() OVER w AS n, lag(c.end_line) OVER w + 1 AS after, lead(c.end_line) OVER w IS NULL AS last
  FROM r{i} AS r JOIN t USING (run_id, file_id) JOIN symbols AS c ON c.run_id = r.run_id AND c.file_id = r.file_id AND c.parent_id = r.symbol_id WHERE length({text}) > {most} WINDOW w AS (PARTITION BY r.run_id, r.file_id, r.place ORDER BY c.start_line, c.ordinal)),
n{i} AS (SELECT *, 0 AS sub FROM r{i} ANTI JOIN o{i} USING (run_id, file_id, place)
  UNION ALL SELECT run_id, file_id, place, coalesce(after, a), cs - 1, symbol_id, name, 3 * n FROM o{i} WHERE cs > coalesce(after, a)
  UNION ALL SELECT run_id, file_id, place, cs, ce, cid, cname, 3 * n + 1 FROM o{i}
  UNION ALL SELECT run_id, file_id, place, ce + 1, b, symbol_id, name, 3 * n + 2 FROM o{i} WHERE last AND ce + 1 <= b),
r{i + 1} AS (SELECT run_id, file_id, row_number() OVER (PARTITION BY run_id, file_id ORDER BY place, sub) AS place, a, b, symbol_id, name FROM n{i})"""
    upto = f"list_min(list_filter(range(a + 1, n + 1), lambda e: e = n OR p[e + 1] - p[a + 1] >= {target} OR p[e + 2] - p[a + 1] > {most}))"
    return out + f""",
tx AS MATERIALIZED (SELECT r.*, t.path, t.language, {text} AS text, EXISTS (SELECT 1 FROM symbols AS s WHERE s.run_id = r.run_id AND s.file_id = r.file_id) AS has FROM r{chunks.DEPTH} AS r JOIN t USING (run_id, file_id)),
ln AS (SELECT run_id, file_id, place, list_transform(string_split(text, chr(10)), lambda x: length(x) + 1) AS l FROM tx WHERE length(text) > {most}),
pr AS MATERIALIZED (SELECT run_id, file_id, place, len(l) AS n, list_transform(range(0, len(l) + 1), lambda i: coalesce(list_sum(l[1:i]), 0)) AS p FROM ln),
cut AS (SELECT run_id, file_id, place, 0 AS part, a, {upto} AS b, n FROM (SELECT *, 0::BIGINT AS a FROM pr)
  UNION ALL SELECT run_id, file_id, place, part, a, {upto} AS b, n FROM (SELECT pr.*, part + 1 AS part, greatest(b - {overlap}, a + 1) AS a FROM cut JOIN pr USING (run_id, file_id, place) WHERE b < cut.n)),
pc AS (SELECT tx.*, 0 AS part, a AS start_line, b AS end_line, text AS piece FROM tx WHERE length(text) <= {most}
  UNION ALL SELECT tx.*, part, tx.a + cut.a, tx.a + cut.b - 1, array_to_string(string_split(text, chr(10))[cut.a + 1:cut.b], chr(10)) FROM tx JOIN cut USING (run_id, file_id, place)),
ck AS (SELECT *, row_number() OVER (PARTITION BY run_id, file_id ORDER BY place, part) - 1 AS i FROM pc WHERE NOT (symbol_id IS NULL AND has AND length(regexp_replace(piece, '^\\s+|\\s+$', '', 'g')) < 40))
"""


@query(_chunks(300, 600, 1) + "SELECT run_id, file_id, i::INT AS chunk_index, path AS file_path, language, start_line::INT AS start_line, end_line::INT AS end_line, symbol_id, name AS symbol_name, sha256(path || '::' || i || '::' || piece) AS content_hash, length(piece)::INT AS char_count FROM ck", "files", "symbols")
def e2_e3_chunks(spark, d):
    return chunks.chunk_files(view(spark, d, "files"), view(spark, d, "symbols"), chunks.Chunking(target_chars=300, max_chars=600, overlap_lines=1)).drop("content")


@query(_REGIONS + """
, c AS (SELECT g.*, t.path, array_to_string(string_split(content, chr(10))[a:b], chr(10)) AS content, EXISTS (SELECT 1 FROM symbols AS s WHERE s.run_id = g.run_id AND s.file_id = g.file_id) AS has FROM g JOIN t USING (run_id, file_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id, file_id ORDER BY place) - 1 AS i FROM c WHERE NOT (symbol_id IS NULL AND has AND length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) < 40))
SELECT run_id, file_id, i::INT AS chunk_index, symbol_id, sha256(path || '::' || i || '::' || content) AS content_hash, length(content)::INT AS char_count FROM k
""", "files", "symbols")  # fmt: skip
def e4_e6_chunk_hashes(spark, d):
    whole = chunks.Chunking(target_chars=10**9, max_chars=10**9)
    return chunks.chunk_files(view(spark, d, "files"), view(spark, d, "symbols"), whole).select("run_id", "file_id", "chunk_index", "symbol_id", "content_hash", "char_count")


_DIFF = f"""
, f AS ({_FRESH}), o AS ({_OLD}),
x AS (SELECT coalesce(f.run_id, o.run_id) AS run_id, coalesce(f.file_id, o.file_id) AS file_id, coalesce(f.chunk_index, o.chunk_index) AS chunk_index,
      CASE WHEN f.content_hash IS NULL THEN 'delete' WHEN f.content_hash = o.content_hash THEN 'reuse' ELSE 'embed' END AS action
      FROM f FULL JOIN o ON f.run_id = o.run_id AND f.file_id = o.file_id AND f.chunk_index = o.chunk_index)
"""


@query(_DIFF + "SELECT * FROM x", "symbols")
def e7_chunk_diff(spark, d):
    return index.diff_chunks(*_fresh_old(spark, d))


@query(_DIFF + """
SELECT f.run_id, f.file_id, f.chunk_index, f.symbol_id, action = 'reuse' AS reused, CASE WHEN o.run_id IS NOT NULL THEN 'id' || o.file_id || o.chunk_index END AS old_id
FROM f JOIN x USING (run_id, file_id, chunk_index) LEFT JOIN o USING (run_id, file_id, chunk_index)
""", "symbols")  # fmt: skip
def e8_apply_diff(spark, d):
    fresh, old = _fresh_old(spark, d)
    existing = old.withColumns({"id": F.concat(F.lit("id"), "file_id", F.col("chunk_index").cast("string")), "created_at": F.lit(NOW).cast("timestamp"), "embedding": F.array(F.lit(9.0)).cast("array<float>")})
    after = index.apply_diff(fresh, existing, lambda rows: index.embed_pseudo(rows, 8))
    return after.select("run_id", "file_id", "chunk_index", "symbol_id", (F.size("embedding") == 1).alias("reused"), F.when(F.col("created_at").isNotNull(), F.col("id")).alias("old_id"))


@query(_DIFF + "SELECT run_id, count(*) FILTER (action <> 'delete') AS discovered, count(*) FILTER (action = 'reuse') AS reused, count(*) FILTER (action = 'embed') AS embedded, count(*) FILTER (action = 'delete') AS deleted FROM x GROUP BY run_id", "symbols")
def e9_diff_statistics(spark, d):
    return index.diff_statistics(index.diff_chunks(*_fresh_old(spark, d)))


@query("SELECT doc_id, 3::INT AS n, length(text)::FLOAT AS first FROM documents")
def e10_embed_batches(spark, d):
    def provider():
        return lambda texts: [[float(len(t)), 0.0, 1.0] for t in texts]

    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return index.embed_batches(docs, provider, "text").select("doc_id", F.size("embedding").alias("n"), F.get("embedding", F.lit(0)).alias("first"))


@query("SELECT doc_id, list_transform(range(40), lambda i: ('0x' || substr(sha256(text) || sha256(sha256(text)), (2 * i + 1)::INT, 2))::INT / 255 - 0.5) AS vector FROM documents")
def e11_pseudo_embedding(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", V.pseudo_embedding(F.col("text"), 40).alias("vector"))


@query("SELECT vec_id, coalesce(len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0, false) AS ok FROM embeddings")
def e12_vector_check(spark, d):
    good, bad = index.check_vectors(spark.read.parquet(f"{d}/embeddings.parquet"), 64)
    return good.select("vec_id", F.lit(True).alias("ok")).unionByName(bad.select("vec_id", F.lit(False).alias("ok")))


# --- search --------------------------------------------------------------------------------------

def _search(queries: str, limit: int) -> str:
    return f"""
, sc AS (SELECT q.query_id, q.query, c.chunk_id, c.content, c.symbol_name, c.file_path, c.start_line, c.end_line, list_cosine_similarity(c.embedding::DOUBLE[], q.vector::DOUBLE[]) AS sem FROM {queries} AS q JOIN chunks AS c ON c.repository_id = q.repository_id WHERE c.embedding IS NOT NULL),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sem DESC, chunk_id) AS n FROM sc) WHERE n <= {4 * limit}),
tk AS (SELECT *, list_filter(string_split_regex(lower(query), '[^a-zA-Z0-9_]+'), lambda t: length(t) >= 2) AS tokens FROM pool),
hi AS (SELECT *, len(list_filter(tokens, lambda t: contains(lower(content), t) OR contains(lower(coalesce(symbol_name, '')), t))) AS hits FROM tk),
lx AS (SELECT *, CASE WHEN len(tokens) = 0 THEN NULL WHEN hits = 0 THEN 0.0 WHEN list_contains(tokens, lower(coalesce(symbol_name, ''))) THEN greatest(hits / len(tokens), 0.95) ELSE hits / len(tokens) END AS lex FROM hi),
rk AS (SELECT *, CASE WHEN lex IS NULL THEN sem ELSE 0.75 * sem + 0.25 * lex END AS fin FROM lx),
top AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fin, 9) DESC, round(sem, 9) DESC, chunk_id) AS r FROM rk) WHERE r <= {limit})
"""


_POOL = _search("queries", 10)
_CITED = "CASE WHEN start_line IS NULL OR end_line IS NULL THEN file_path WHEN start_line = end_line THEN file_path || ':' || start_line ELSE file_path || ':' || start_line || '-' || end_line END"
#: The chunks of a context, one by one in rank order: each that fits is taken.
_BUDGET = f"""
, ri AS (SELECT query_id, r, length(content) AS size, {_CITED} AS citation, '### ' || {_CITED} || CASE WHEN coalesce(symbol_name, '') <> '' THEN ' — ' || symbol_name ELSE '' END || chr(10) || '```' || chr(10) || content || chr(10) || '```' AS body FROM top),
fold AS (SELECT DISTINCT query_id, 0::BIGINT AS r, 0::BIGINT AS n, 0::BIGINT AS total, 0::BIGINT AS cut, []::VARCHAR[] AS citations, ''::VARCHAR AS bodies FROM ri
  UNION ALL SELECT f.query_id, f.r + 1, f.n + fit, f.total + fit * size, f.cut + 1 - fit, CASE fit WHEN 1 THEN list_append(citations, citation) ELSE citations END, CASE fit WHEN 1 THEN bodies || chr(10) || chr(10) || body ELSE bodies END
  FROM (SELECT f.*, ri.size, ri.citation, ri.body, CASE WHEN f.n < 8 AND f.total + ri.size <= 6000 THEN 1 ELSE 0 END AS fit FROM fold AS f JOIN ri ON ri.query_id = f.query_id AND ri.r = f.r + 1) AS f),
context AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r DESC) AS last FROM fold) WHERE last = 1)
"""


def _ranked(spark, d):
    return search.search(view(spark, d, "queries"), view(spark, d, "chunks"))


@query(_POOL + "SELECT query_id, chunk_id, round(sem, 6) AS semantic_score FROM pool", "queries", "chunks")
def s1_s2_candidates(spark, d):
    return search.candidates(view(spark, d, "queries"), view(spark, d, "chunks")).select("query_id", "chunk_id", F.round("semantic_score", 6).alias("semantic_score"))


@query(_POOL + "SELECT query_id, chunk_id, round(lex::DOUBLE, 6) AS lexical_score FROM lx", "queries", "chunks")
def s3_lexical_scores(spark, d):
    pool = search.candidates(view(spark, d, "queries"), view(spark, d, "chunks"))
    return pool.select("query_id", "chunk_id", F.round(search.lexical_score(F.col("query"), F.col("content"), F.col("symbol_name")), 6).alias("lexical_score"))


@query(_POOL + "SELECT query_id, chunk_id, r::INT AS rank, round(fin::DOUBLE, 6) AS final_score FROM top", "queries", "chunks")
def s4_hybrid_rank(spark, d):
    return _ranked(spark, d).select("query_id", "chunk_id", "rank", F.round("final_score", 6).alias("final_score"))


def _agent_search(spark, d):
    """Each agent's query over each repository of the chunk table; a query's vector is that of the
    repository's least chunk, so that every table size has one."""
    c = view(spark, d, "chunks")
    first = c.where("embedding is not null").groupBy("repository_id").agg(F.min_by("embedding", F.col("chunk_id").cast("long")).alias("vector"))
    asked = search.agent_queries(first, evidence.agent_specs(spark)).join(first, "repository_id")
    return search.search(asked, c, evidence.SEARCH_LIMIT)


_AGENT_SEARCH = """
, ag AS (SELECT * FROM (VALUES """ + ", ".join(f"('{a}', '{q}')" for a, _, q, _ in evidence.AGENTS) + """) AS s(agent, query)),
fv AS (SELECT repository_id, arg_min(embedding, chunk_id::BIGINT) AS vector FROM chunks WHERE embedding IS NOT NULL GROUP BY repository_id),
aq AS (SELECT repository_id || '/' || agent AS query_id, repository_id, query, vector FROM fv, ag)
""" + _search("aq", evidence.SEARCH_LIMIT)  # fmt: skip


@query(_AGENT_SEARCH + "SELECT query_id, chunk_id, r::INT AS rank, round(fin::DOUBLE, 6) AS final_score FROM top", "chunks")
def s5_agent_queries(spark, d):
    return _agent_search(spark, d).select("query_id", "chunk_id", "rank", F.round("final_score", 6).alias("final_score"))


@query(_POOL + _BUDGET + "SELECT query_id, n::INT AS n, total::INT AS total_characters, cut::INT AS truncated, citations FROM context", "queries", "chunks")
def s6_contexts(spark, d):
    made = search.build_context(_ranked(spark, d), 8, 6000)
    return made.select("query_id", F.size("chunks").alias("n"), "total_characters", "truncated", F.transform("chunks", lambda c: c["citation"]).alias("citations"))


@query(f"SELECT chunk_id, {_CITED} AS citation FROM chunks", "chunks")
def s7_citations(spark, d):
    return view(spark, d, "chunks").select("chunk_id", search.citation(F.col("file_path"), F.col("start_line"), F.col("end_line")).alias("citation"))


@query(f"SELECT r.repository_id, CASE WHEN e.status IS NULL OR e.status = 'FAILED' THEN 'not_indexed' WHEN {_ACTIVE('embedding', 'e.status')} THEN 'indexing' ELSE 'ready' END AS readiness FROM repositories AS r LEFT JOIN {_LATEST.format('embeddings_runs', 1)} AS e ON e.repository_id = r.repository_id", "repositories", "embeddings_runs")
def s8_search_readiness(spark, d):
    return runs.search_readiness(_repos(spark, d), view(spark, d, "embeddings_runs"))


@query(_POOL + """
, ff AS (SELECT query_id, file_path, min(r) AS first FROM top GROUP BY query_id, file_path), pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, file_path) AS place FROM ff),
ex AS (SELECT q.query_id, c.file_path FROM queries AS q JOIN chunks AS c ON c.chunk_id = q.query_id)
SELECT round(avg(CASE WHEN place <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5, round(avg(CASE WHEN place <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_10 FROM ex LEFT JOIN pl USING (query_id, file_path)
""", "queries", "chunks")  # fmt: skip
def s9_retrieval_recall(spark, d):
    expected = view(spark, d, "queries").select("query_id").join(view(spark, d, "chunks").select(F.col("chunk_id").alias("query_id"), F.col("file_path").alias("expected_file")), "query_id")
    found = search.recall(_ranked(spark, d), expected)
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


# --- evidence and agents -------------------------------------------------------------------------


@query(_FILE_METRICS + "SELECT run_id, r::INT AS rank, path, line_count, complexity FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_count DESC, path) AS r FROM fm) WHERE r <= 8", *_NEED)
def x1_largest_files(spark, d):
    return evidence.largest_files(_file_metrics(spark, d))


_SPECS = "(VALUES " + ", ".join(f"('{a}', {'NULL' if r is None else '[' + _IN(r) + ']'})" for a, _, _, r in evidence.AGENTS) + ") AS s(agent, rules)"


@query(_ALL + f"""
SELECT run_id, agent, r::INT AS rank, rule_id, severity, message, path, line FROM (
  SELECT fi.*, agent, f.path, row_number() OVER (PARTITION BY fi.run_id, agent ORDER BY {_SEV}, f.path NULLS FIRST, line NULLS FIRST, rule_id, message) AS r
  FROM fi CROSS JOIN {_SPECS} LEFT JOIN files AS f ON f.run_id = fi.run_id AND f.file_id = fi.file_id WHERE rules IS NULL OR list_contains(rules, rule_id)) WHERE r <= 15
""", *_NEED)  # fmt: skip
def x2_relevant_findings(spark, d):
    return evidence.relevant_findings(_findings(spark, d), evidence.agent_specs(spark), view(spark, d, "files"))


def _records(spark, d):
    f, metrics = view(spark, d, "files"), stored(_file_metrics(spark, d), "metrics")
    found = stored(_findings(spark, d, metrics), "findings")
    summary = rules.run_summary(f, view(spark, d, "symbols"), view(spark, d, "imports"), found).withColumn("repository_id", F.regexp_extract("run_id", r"(\d+)", 1))
    made = search.build_context(_agent_search(spark, d), evidence.CONTEXT_RESULTS, evidence.CONTEXT_CHARACTERS)
    parts = F.split("query_id", "/")
    contexts = made.select(F.concat(F.lit("src"), F.get(parts, F.lit(0))).alias("run_id"), F.get(parts, F.lit(1)).alias("agent"), "chunks")
    return evidence.evidence_records(summary, _repos(spark, d), evidence.agent_specs(spark), found, metrics, f, contexts)


_RECORDS = _ALL + _AGENT_SEARCH + _BUDGET + f"""
, names AS (SELECT * FROM (VALUES {", ".join(f"('{a}', {'NULL' if r is None else '[' + _IN(r) + ']'})" for a, _, _, r in evidence.AGENTS)}) AS s(agent, wanted)),
su AS (SELECT run_id, count(*) AS files_analyzed, (SELECT count(*) FROM symbols AS s WHERE s.run_id = f.run_id) AS symbols_found, (SELECT count(*) FROM imports AS i WHERE i.run_id = f.run_id) AS imports_found, (SELECT count(*) FROM fi WHERE fi.run_id = f.run_id) AS findings_count FROM files AS f GROUP BY run_id),
lv AS (SELECT run_id, {", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITIES)} FROM fi GROUP BY run_id),
lf AS (SELECT run_id, count(*) AS n_largest, chr(10) || chr(10) || 'Largest/most complex files:' || string_agg(chr(10) || '- ' || path || ': ' || line_count || ' lines' || CASE WHEN complexity IS NULL THEN '' ELSE ', complexity ' || complexity END, '' ORDER BY r) AS largest
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_count DESC, path) AS r FROM fm) WHERE r <= 8 GROUP BY run_id),
rf AS (SELECT run_id, agent, count(*) AS n_relevant, string_agg(chr(10) || '- [' || severity || '] ' || rule_id || ': ' || message || CASE WHEN path IS NULL THEN '' ELSE ' (' || path || CASE WHEN line IS NULL THEN '' ELSE ':' || line END || ')' END, '' ORDER BY r) AS relevant
  FROM (SELECT fi.*, agent, f.path, row_number() OVER (PARTITION BY fi.run_id, agent ORDER BY {_SEV}, f.path NULLS FIRST, line NULLS FIRST, rule_id, message) AS r FROM fi CROSS JOIN names LEFT JOIN files AS f ON f.run_id = fi.run_id AND f.file_id = fi.file_id WHERE wanted IS NULL OR list_contains(wanted, rule_id)) WHERE r <= 15 GROUP BY run_id, agent),
rec AS (SELECT su.*, names.agent, rp.full_name, rp.description, rp.default_branch, {", ".join(f"coalesce({s}, 0) AS {s}" for s in SEVERITIES)}, coalesce(n_largest, 0) AS n_largest, largest, coalesce(n_relevant, 0) AS n_relevant, relevant, coalesce(cx.n, 0) AS n_chunks, cx.bodies
  FROM su JOIN repositories AS rp ON rp.repository_id = regexp_extract(su.run_id, '([0-9]+)', 1) CROSS JOIN names LEFT JOIN lv ON lv.run_id = su.run_id LEFT JOIN lf ON lf.run_id = su.run_id LEFT JOIN rf ON rf.run_id = su.run_id AND rf.agent = names.agent
  LEFT JOIN context AS cx ON 'src' || split_part(cx.query_id, '/', 1) = su.run_id AND split_part(cx.query_id, '/', 2) = names.agent)
"""
_RECORD_VIEWS = ("files", "symbols", "imports", "chunks", "repositories")


@query(_RECORDS + "SELECT run_id, agent, full_name, files_analyzed, findings_count, " + ", ".join(SEVERITIES) + ", n_largest::INT AS n_largest, n_relevant::INT AS n_relevant, n_chunks::INT AS n_chunks FROM rec", *_RECORD_VIEWS)
def x3_evidence_records(spark, d):
    return _records(spark, d).select("run_id", "agent", "full_name", "files_analyzed", "findings_count", "severity_counts.*", F.size("largest_files").alias("n_largest"), F.size("relevant_findings").alias("n_relevant"), F.size("chunks").alias("n_chunks"))


_LEVELS = " || ', ' || ".join(f"'{s} ' || {s}" for s in AI_SEVERITIES)


@query(_RECORDS + f"""
SELECT run_id, agent, 'Repository: ' || full_name || CASE WHEN coalesce(description, '') <> '' THEN ' — ' || description ELSE '' END || chr(10) || 'Default branch: ' || default_branch || chr(10) || chr(10)
  || '## Deterministic analysis summary (Phase 4 — real, measured data, not an estimate)' || chr(10) || 'Files analyzed: ' || files_analyzed || chr(10) || 'Symbols found: ' || symbols_found || chr(10) || 'Imports found: ' || imports_found || chr(10)
  || 'Total deterministic findings: ' || findings_count || ' (' || {_LEVELS} || ')' || coalesce(largest, '')
  || CASE WHEN n_relevant > 0 THEN chr(10) || chr(10) || 'Relevant deterministic findings:' || relevant ELSE chr(10) || chr(10) || 'No relevant deterministic findings for this agent''s focus area.' END
  || chr(10) || chr(10) || '## Retrieved source code evidence (semantic + lexical search, scoped to this agent''s focus area)' || CASE WHEN n_chunks = 0 THEN chr(10) || '(no relevant chunks were retrieved)' ELSE bodies END AS evidence FROM rec
""", *_RECORD_VIEWS)  # fmt: skip
def x4_evidence_text(spark, d):
    return evidence.evidence_text(_records(spark, d))


_REASON = "CASE WHEN (conv_id + turn) % 11 = 3 THEN 'json' WHEN (conv_id + turn) % 13 = 4 THEN 'summary' WHEN conv_id % 17 = 2 OR (conv_id % 5 = 4 AND turn = 1) THEN 'findings' WHEN turn % 7 <> 6 THEN NULL WHEN conv_id % 7 = 5 THEN 'health' WHEN conv_id % 9 = 4 THEN 'strengths' WHEN conv_id % 8 = 3 THEN 'next_steps' END"
_CONF = "((conv_id * 3 + turn) % 9 + 1) / 10"
_AISEV = "CASE conv_id % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'LOW' WHEN 3 THEN 'INFO' ELSE 'MEDIUM' END"
_VALID = f", v AS (SELECT *, {_REASON} AS reason, {_CONF} AS confidence, {_AISEV} AS severity, ai_run_id || '/' || agent AS agent_run_id, 't' || turn AS title, 's' || conv_id AS s FROM agent_results)\n"


def _validated(spark, d):
    return evidence.validate_outputs(view(spark, d, "agent_results"))


def _agent_runs(spark, d):
    return view(spark, d, "agent_results").select("ai_run_id", "agent", F.concat_ws("/", "ai_run_id", "agent").alias("agent_run_id"), "status")


@query(_VALID + "SELECT ai_run_id, agent, reason FROM v", "agent_results")
def x5_validated_outputs(spark, d):
    return _validated(spark, d).select("ai_run_id", "agent", "reason")


@query(_VALID + "SELECT agent_run_id, 0::INT AS position, title, severity, round(confidence, 6) AS confidence FROM v WHERE reason IS NULL", "agent_results")
def x6_finding_rows(spark, d):
    return evidence.finding_rows(_validated(spark, d)).select("agent_run_id", "position", "title", "severity", F.round("confidence", 6).alias("confidence"))


@query("SELECT DISTINCT ai_run_id, a AS agent, ai_run_id || '/' || a AS agent_run_id, 'PENDING' AS status FROM agent_results, (VALUES " + ", ".join(f"('{a}')" for a in [*[x[0] for x in evidence.AGENTS], evidence.SUMMARY_AGENT]) + ") AS s(a)", "agent_results")
def x7_seed_agent_runs(spark, d):
    return evidence.seed_agent_runs(view(spark, d, "agent_results").select("ai_run_id").distinct())


@query("""
, c AS (SELECT ai_run_id, count(*) FILTER (agent <> 'EXECUTIVE_SUMMARY' AND status = 'COMPLETED') AS done, count(*) FILTER (agent <> 'EXECUTIVE_SUMMARY' AND status <> 'COMPLETED') AS failed, max(status) FILTER (agent = 'EXECUTIVE_SUMMARY') AS s FROM agent_results GROUP BY ai_run_id)
SELECT ai_run_id, CASE WHEN done = 0 THEN 'FAILED' WHEN failed > 0 OR s IS DISTINCT FROM 'COMPLETED' THEN 'COMPLETED_WITH_WARNINGS' ELSE 'COMPLETED' END AS status, CASE WHEN done = 0 THEN 'SKIPPED' ELSE s END AS summary_status FROM c
""", "agent_results")  # fmt: skip
def x8_roll_up(spark, d):
    return evidence.roll_up(_agent_runs(spark, d))


_TITLES = "(VALUES " + ", ".join(f"({i}, '{a}', '{t}')" for i, (a, t, _, _) in enumerate(evidence.AGENTS)) + ") AS s(place, agent, agent_title)"


@query(_VALID + f"""
SELECT ai_run_id, string_agg('## ' || agent_title || chr(10) || s || chr(10) || 'Findings:' || chr(10) || '- [' || severity || ', confidence ' || printf('%.2f', confidence) || '] ' || title || ': u — citations: [{{"filePath":"a.ts","startLine":1,"endLine":2,"symbolName":null}}]' || chr(10), chr(10) ORDER BY place) AS digest
FROM v JOIN {_TITLES} USING (agent) WHERE reason IS NULL GROUP BY ai_run_id
""", "agent_results")  # fmt: skip
def x9_executive_digest(spark, d):
    return evidence.executive_digest(_validated(spark, d), evidence.agent_specs(spark))


@query(_VALID + "SELECT agent_run_id, severity, round(confidence, 6) AS confidence, title FROM v WHERE reason IS NULL AND confidence >= 0.35 ORDER BY CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 4 ELSE 5 END, confidence DESC, agent_run_id LIMIT 50", "agent_results")
def x10_ai_findings_page(spark, d):
    page, _ = reports.ai_findings_page(evidence.finding_rows(_validated(spark, d)).drop("agent"), _agent_runs(spark, d), min_confidence=0.35)
    return page.select("agent_run_id", "severity", F.round("confidence", 6).alias("confidence"), "title")


@query(_VALID + "SELECT ai_run_id, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in AI_SEVERITIES) + " FROM v WHERE reason IS NULL GROUP BY ai_run_id", "agent_results")
def x11_ai_severity_counts(spark, d):
    return reports.severity_counts(evidence.finding_rows(_validated(spark, d)), "ai_run_id", AI_SEVERITIES)


@query(_VALID + "SELECT agent_run_id, status, CASE WHEN reason IS NULL THEN 1 ELSE 0 END::INT AS n, CASE WHEN reason IS NULL THEN title END AS first FROM v", "agent_results")
def x12_agent_cards(spark, d):
    cards = evidence.agent_cards(_agent_runs(spark, d), evidence.finding_rows(_validated(spark, d)).drop("agent", "ai_run_id"))
    return cards.select("agent_run_id", "status", F.size("findings").alias("n"), F.get("findings", F.lit(0))["title"].alias("first"))


@query("SELECT ai_run_id, count(*) AS agents, count(*) FILTER (status = 'COMPLETED') AS completed FROM agent_results GROUP BY ai_run_id", "agent_results")
def x13_agent_progress(spark, d):
    return evidence.agent_progress(_agent_runs(spark, d))


# --- streams -------------------------------------------------------------------------------------


#: Arrivals of t1: two thirds of the files; then the others, and each fifth file changed; then each seventh file
#: deleted, and each second of the others again as it was.
_CHANGED = "concat('// changed', chr(10), content, chr(10), 'tail')"
_T1_VERSIONS = f"""
, files_of AS (SELECT * FROM files), symbols_of AS (SELECT * FROM symbols),
v AS (SELECT f.*, 1 AS rev FROM files_of AS f UNION ALL SELECT f.* REPLACE ({_CHANGED} AS content), 2 AS rev FROM files_of AS f WHERE id % 5 = 0 AND id % 3 <> 2),
"""


def _revised(sql: str) -> str:
    """The chunk SQL over both revisions of each file: the revision is part of the run."""
    sql = re.sub(r"\bfiles\b", "rev_files", sql)
    return re.sub(r"\bsymbols\b", "rev_symbols", sql).lstrip().removeprefix(",")


@query(_T1_VERSIONS + """
rev_files AS (SELECT rev || '|' || run_id AS run_id, file_id, path, language, content, id FROM v),
rev_symbols AS (SELECT s.* REPLACE (rev || '|' || s.run_id AS run_id) FROM symbols_of AS s JOIN v ON v.run_id = s.run_id AND v.file_id = s.file_id),
""" + _revised(_chunks(1600, 4000, 3)) + """
, c AS (SELECT split_part(run_id, '|', 2) AS run_id, split_part(run_id, '|', 1)::INT AS rev, file_id, file_id::BIGINT AS id, i, sha256(path || '::' || i || '::' || piece) AS h FROM ck),
old AS (SELECT * FROM c WHERE rev = 1), new AS (SELECT * FROM c WHERE rev = 2),
live AS (SELECT * FROM new UNION ALL SELECT * FROM old WHERE NOT (id % 5 = 0 AND id % 3 <> 2)),
d AS (SELECT 0 AS batch, run_id, 'embed' AS action FROM old WHERE id % 3 <> 2
  UNION ALL SELECT 1, run_id, 'embed' FROM old WHERE id % 3 = 2
  UNION ALL SELECT 1, coalesce(n.run_id, o.run_id), CASE WHEN n.h IS NULL THEN 'delete' WHEN n.h = o.h THEN 'reuse' ELSE 'embed' END
    FROM new AS n FULL JOIN (SELECT * FROM old WHERE id % 5 = 0 AND id % 3 <> 2) AS o ON n.run_id = o.run_id AND n.file_id = o.file_id AND n.i = o.i
  UNION ALL SELECT 2, run_id, CASE WHEN id % 7 = 0 THEN 'delete' ELSE 'reuse' END FROM live WHERE id % 7 = 0 OR id % 2 = 0),
n AS (SELECT run_id, count(*) AS chunks, count(DISTINCT file_id) AS files FROM live WHERE id % 7 <> 0 GROUP BY run_id)
SELECT batch::BIGINT AS batch, d.run_id, count(*) FILTER (action <> 'delete') AS discovered, count(*) FILTER (action = 'reuse') AS reused, count(*) FILTER (action = 'embed') AS embedded,
       count(*) FILTER (action = 'delete') AS deleted, coalesce(any_value(chunks), 0) AS chunks, coalesce(any_value(files), 0) AS files
FROM d LEFT JOIN n ON n.run_id = d.run_id GROUP BY batch, d.run_id
""", "files", "symbols")  # fmt: skip
def t1_incremental_index(spark, d):
    """Three arrivals, each a run of the stream: what each batch did per run, beside the table after all."""
    base = shared_folder(spark, "index")
    files = view(spark, d, "files").selectExpr("run_id", "file_id", "path", "language", "content", "id", "cast(null as string) AS action", "cast(null as bigint) AS version")
    changed = files.where("id % 5 = 0 AND id % 3 <> 2").withColumn("content", F.expr(_CHANGED))
    now = files.where("NOT (id % 5 = 0 AND id % 3 <> 2)").unionByName(changed)
    arrivals = [
        files.where("id % 3 <> 2"), files.where("id % 3 = 2").unionByName(changed),
        now.where("id % 7 = 0").withColumn("action", F.lit("delete")).unionByName(now.where("id % 7 <> 0 AND id % 2 = 0")),
    ]
    given = view(spark, d, "symbols")
    embed = lambda rows: index.embed_pseudo(rows, 8)
    own = lambda files: given.join(files, ["run_id", "file_id"], "left_semi")
    for arrival in arrivals:
        arrival.drop("id").write.mode("append").parquet(f"{base}/arrivals")
        jobs.index_incrementally(spark, f"{base}/arrivals", own, f"{base}/table", f"{base}/state", embed, layout=jobs.Layout(8, 4, 3)).awaitTermination()
    table = jobs.ChunkTable(spark, f"{base}/table")
    left = table.chunks().groupBy("run_id").agg(F.count("*").alias("chunks"), F.countDistinct("file_id").alias("files"))
    rows = table.statistics().withColumnRenamed("version", "batch").join(left, "run_id", "left")
    return rows.select(F.col("batch").cast("long").alias("batch"), "run_id", "discovered", "reused", "embedded", "deleted", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("files", F.lit(0)).alias("files"))


@query("""
WITH n AS (SELECT source AS run_id, doc_id % 4 AS batch, count(*) AS n FROM documents GROUP BY ALL)
SELECT run_id, batch::INT AS batch, sum(n) OVER (PARTITION BY run_id ORDER BY batch)::BIGINT AS chunks_embedded FROM n
""")
def t2_embedding_progress(spark, d):
    """Four arrivals, the stream stopped after each: the runs that each batch touched, with all embedded so far."""
    base = shared_folder(spark, "progress")
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("source").alias("run_id"), "doc_id")
    for i in range(4):
        docs.where(F.col("doc_id") % 4 == i).write.mode("append").parquet(f"{base}/chunks")
        chunks = spark.readStream.schema(docs.schema).parquet(f"{base}/chunks")
        jobs.report_progress(chunks, f"{base}/table", f"{base}/state").awaitTermination()
    return jobs.progress(spark, f"{base}/table")


# --- the flagship --------------------------------------------------------------------------------


def files_that_need_attention(spark: SparkSession, d: str) -> DataFrame:
    """Per file its size, its findings and the worst of them, worst files first."""
    metrics = stored(_file_metrics(spark, d), "metrics")
    found = _findings(spark, d, metrics)
    worst = found.groupBy("run_id", "file_id").agg(F.max(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))).alias("worst"), F.count("*").alias("findings"))
    return metrics.join(worst, ["run_id", "file_id"]).select("run_id", "path", "line_count", "findings", "worst").orderBy(F.desc("worst"), F.desc("findings"), "run_id", "path")
