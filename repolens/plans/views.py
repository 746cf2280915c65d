"""Repository tables derived from the given tables, as SQL that Spark and DuckDB both run.

The given documents hold prose, so paths, lines of code and run states are derived from their keys:
every row of the source table gives rows, and the work grows with it. `VIEWS` is in order: a view may
use those before it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

EXTENSIONS = [".ts", ".py", ".js", ".java", ".go", ".cpp", ".md", ".json", ".png", ".yml", ".min.js", "", ".tsx", ".c", ".sh", ".sql"]
FOLDERS = ["src", "src/lib/core", "node_modules/pkg", "docs", "src/build/gen", "test", "app/dist"]

_NL = "chr(10)"


def _pick(value: str, options: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(options[:-1]))
    return f"CASE {value} % {len(options)} {cases} ELSE '{options[-1]}' END"


def _lines(*lines: str) -> str:
    return "concat(" + f", {_NL}, ".join(lines) + f", {_NL})"


_CODE = {
    ".py": _lines("'import os, sys as s'", "'from typing.io import List'", "concat('class Greeter', id, ':')", "'    def greet(self, name):'", "'        return name'", "''", "concat('def _top', id, '(a, b):')", "'    return a'", "'# FIXME later'"),
    ".java": _lines("'import java.util.List;'", "'import static a.b.C.*;'", "concat('public class Box', id, ' {')", "'  private int size(int a, int b) {'", "'    if (a > b) {'", "'      return a;'", "'    } else if (b > a) {'", "'      return b;'", "'    }'", "'    return 0;'", "'  }'", "'}'", "'/* block'", "''", "'end */'"),
    ".go": _lines("'package main'", "'import \"fmt\"'", "'import ('", "'  \"os\"'", "'  \"strings\"'", "')'", "concat('type Config', id, ' struct {')", "'  A int'", "'}'", "'func Run(a int, b int) error {'", "'  return nil'", "'}'", "'func helper() {'", "'}'"),
    ".cpp": _lines("'#include <vector>'", "'#include \"local.h\"'", "concat('class Shape', id, ' {')", "'  int area(int w, int h) {'", "'    return w * h;'", "'  }'", "'};'", "'int add(int a, int b) {'", "'  return a + b;'", "'}'"),
    ".c": _lines("'#include <stdio.h>'", "'int main(void) {'", "'  return 0;'", "'}'"),
    ".ts": _lines("'/* one line */'", "'// TODO: tidy this up'", "'const x = 1; // trailing'", "'/* open'", "''", "'still */'"),
    ".js": _lines("'// FIXME'", "''", "'const TODO_LIST = 1;'"),
    ".sh": _lines("'# comment'", "'ls'"),
    ".sql": _lines("'-- comment'", "'select 1'"),
}


def _content() -> str:
    cases = " ".join(f"WHEN ext = '{ext}' THEN {code}" for ext, code in _CODE.items())
    return f"concat(CASE {cases} ELSE '' END, body)"


_LANGUAGE = "CASE ext WHEN '.ts' THEN 'TypeScript' WHEN '.tsx' THEN 'TypeScript' WHEN '.js' THEN 'JavaScript' WHEN '.py' THEN 'Python' WHEN '.java' THEN 'Java' WHEN '.go' THEN 'Go' WHEN '.cpp' THEN 'C++' WHEN '.c' THEN 'C' WHEN '.sh' THEN 'Shell' WHEN '.sql' THEN 'SQL' END"

VIEWS: dict[str, str] = {
    "all_files": f"""
        SELECT source AS run_id, cast(id AS varchar(20)) AS file_id, concat(folder, '/doc_', id, ext) AS path, ext, id, {_LANGUAGE} AS language, {_content()} AS content
        FROM (SELECT doc_id AS id, source, coalesce(text, '') AS body, {_pick('doc_id', EXTENSIONS)} AS ext, {_pick('doc_id', FOLDERS)} AS folder FROM documents) AS d""",
    "files": "SELECT run_id, file_id, path, language, content, id FROM all_files WHERE language IS NOT NULL",
    "archive_entries": f"""
        SELECT source AS repository_id, cast(doc_id AS int) AS ordinal,
               CASE WHEN doc_id % 97 = 13 THEN '../outside/file' WHEN doc_id % 31 = 0 THEN concat('top/a/../../b', doc_id, '/./c') WHEN doc_id % 53 = 3 THEN '/etc/passwd' ELSE concat('top/', {_pick('doc_id', FOLDERS)}, '/f', doc_id) END AS entry_path,
               CASE doc_id % 11 WHEN 1 THEN 'Directory' WHEN 5 THEN 'SymbolicLink' WHEN 7 THEN 'Link' ELSE 'File' END AS entry_type,
               n_chars AS size FROM documents""",
    "symbols": """
        SELECT run_id, file_id, concat(file_id, '-', k) AS symbol_id, cast(k AS int) AS ordinal, concat('sym', k % 3) AS name,
               CASE (id + k) % 4 WHEN 0 THEN 'CLASS' WHEN 1 THEN 'FUNCTION' WHEN 2 THEN 'METHOD' ELSE 'INTERFACE' END AS kind,
               cast(2 + 4 * k AS int) AS start_line, cast(CASE WHEN (id + k) % 5 = 0 THEN 100 + 40 * k WHEN k = 2 THEN 13 ELSE 4 + 4 * k END AS int) AS end_line,
               id % 2 = 0 AS exported, CASE WHEN k = 3 THEN 'sym0' END AS parent_name, CASE WHEN k = 3 THEN concat(file_id, '-0') END AS parent_id,
               cast(CASE WHEN language IN ('TypeScript', 'JavaScript') AND k <> 1 THEN (id * 7 + k) % 30 END AS int) AS complexity,
               cast(CASE WHEN k <> 2 THEN (id + 3 * k) % 9 END AS int) AS parameter_count
        FROM files, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) AS ks WHERE k <= id % 5""",
    "imports": """
        SELECT f.run_id, f.file_id, concat(f.file_id, '-', k) AS import_id,
               CASE k WHEN 0 THEN concat('./', coalesce(n.base, 'none')) WHEN 1 THEN 'fastify' WHEN 2 THEN concat('../', coalesce(n.path, 'x'), '/') ELSE concat('./../', f.folder, '//', coalesce(n.base, 'gone')) END AS source,
               CASE k WHEN 1 THEN 'REQUIRE' ELSE 'IMPORT' END AS kind, cast(k + 1 AS int) AS line
        FROM (SELECT run_id, file_id, id, replace(replace(path, concat('/doc_', id, ext), ''), 'src/lib/', '') AS folder FROM all_files WHERE language IS NOT NULL) AS f
        LEFT JOIN (SELECT run_id, id, path, concat('doc_', id) AS base FROM all_files WHERE language IS NOT NULL) AS n ON n.run_id = f.run_id AND n.id = f.id + 560,
        (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) AS ks""",
    "repositories": """
        SELECT cast(c_custkey AS varchar(20)) AS repository_id, cast(c_nationkey AS varchar(20)) AS user_id, c_custkey + 1000 AS github_id, lower(c_mktsegment) AS owner, c_name AS name,
               concat(lower(c_mktsegment), '/', c_name) AS full_name, 'main' AS default_branch, CASE WHEN c_custkey % 3 <> 0 THEN concat('Repository of ', c_mktsegment) END AS description
        FROM customer""",
    "ingestions": """
        SELECT cast(event_id AS varchar(20)) AS id, cast(user_id AS varchar(20)) AS repository_id, concat('sha', event_id % 40) AS commit_sha,
               CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'click' THEN 'COMPLETED' WHEN 'view' THEN 'SCANNING' WHEN 'error' THEN 'FAILED' ELSE 'QUEUED' END AS status, ts AS created_at, ts AS updated_at
        FROM events""",
    "analyses": """
        SELECT concat('a', event_id) AS id, cast(event_id + cast(floor(event_id / 3) AS bigint) AS varchar(20)) AS ingestion_id, cast(user_id AS varchar(20)) AS repository_id,
               CASE WHEN event_id % 7 < 4 THEN 'COMPLETED' WHEN event_id % 7 = 4 THEN 'PARSING' WHEN event_id % 7 = 5 THEN 'FAILED' ELSE 'PENDING' END AS status,
               cast(floor(CASE WHEN event_id % 5 <> 0 THEN value END) AS int) AS findings_count, ts AS created_at, ts AS updated_at
        FROM events""",
    "embeddings_runs": """
        SELECT concat('e', event_id) AS id, concat('a', event_id + cast(floor(event_id / 2) AS bigint)) AS analysis_run_id, cast(user_id AS varchar(20)) AS repository_id,
               CASE WHEN event_id % 9 < 6 THEN 'COMPLETED' WHEN event_id % 9 = 6 THEN 'EMBEDDING' ELSE 'FAILED' END AS status,
               cast(event_id % 13 AS int) AS discovered, cast(event_id % 5 AS int) AS reused, cast(event_id % 7 AS int) AS embedded, ts AS created_at, ts AS updated_at
        FROM events""",
    "ai_runs": """
        SELECT concat('x', event_id) AS id, concat('a', 2 * event_id) AS analysis_run_id, cast(user_id AS varchar(20)) AS repository_id, CASE WHEN event_id % 5 < 2 THEN 'RUNNING' ELSE 'COMPLETED' END AS status, ts AS created_at, ts AS updated_at
        FROM events""",
    "chunks": """
        SELECT cast(e.vec_id AS varchar(20)) AS chunk_id, cast(e.label AS varchar(20)) AS repository_id, concat('src/doc_', d.doc_id, '.ts') AS file_path,
               CASE WHEN e.vec_id % 4 = 0 THEN 'the' WHEN e.vec_id % 4 = 1 THEN concat('sym_', e.vec_id) END AS symbol_name,
               cast(CASE WHEN e.vec_id % 3 <> 0 THEN e.vec_id % 50 + 1 END AS int) AS start_line, cast(CASE WHEN e.vec_id % 3 <> 0 THEN e.vec_id % 50 + 1 + e.vec_id % 2 * 9 END AS int) AS end_line,
               d.text AS content, CASE WHEN e.vec_id % 29 <> 7 THEN e.embedding END AS embedding
        FROM (SELECT vec_id, embedding, label, vec_id % (SELECT count(*) FROM documents) AS place FROM embeddings) AS e JOIN documents AS d ON d.doc_id = e.place""",
    "queries": """
        SELECT cast(vec_id AS varchar(20)) AS query_id, cast(label AS varchar(20)) AS repository_id, CASE WHEN vec_id % 2 = 0 THEN 'the of_module request' ELSE '?? !' END AS query, embedding AS vector
        FROM embeddings WHERE vec_id % 20 = 3""",
    "agent_results": """
        SELECT concat(conv_id, '-', cast(floor(turn / 7) AS int)) AS ai_run_id, CASE turn % 7 WHEN 0 THEN 'ARCHITECTURE' WHEN 1 THEN 'CODE_QUALITY' WHEN 2 THEN 'SECURITY' WHEN 3 THEN 'PERFORMANCE' WHEN 4 THEN 'DEPENDENCY_RISK' WHEN 5 THEN 'DOCUMENTATION' ELSE 'EXECUTIVE_SUMMARY' END AS agent,
               conv_id, turn, length(text) AS n, CASE WHEN (conv_id + turn) % 6 = 5 OR conv_id % 10 = 9 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
               CASE WHEN (conv_id + turn) % 11 = 3 THEN 'not json'
                    ELSE concat('{"overallHealth": "', CASE WHEN conv_id % 7 = 5 THEN 'FINE' ELSE 'GOOD' END, '", "strengths": [', CASE conv_id % 9 WHEN 4 THEN repeat('"x", ', 10) WHEN 5 THEN '' ELSE '"tests", ' END, '"docs"], "recommendedNextSteps": [', CASE conv_id % 8 WHEN 3 THEN '"", ' ELSE '' END, '"refactor"], "summary": "', CASE WHEN (conv_id + turn) % 13 = 4 THEN '' ELSE concat('s', conv_id) END, '", "', CASE WHEN turn % 7 = 6 THEN 'topRisks' ELSE 'findings' END, '": [',
                         '{"category": "c", "title": "t', turn, '", "summary": "u", "severity": "', CASE conv_id % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'LOW' WHEN 3 THEN 'INFO' ELSE CASE WHEN turn = 1 THEN 'WRONG' ELSE 'MEDIUM' END END,
                         '", "confidence": 0.', (conv_id * 3 + turn) % 9 + 1, ', "evidence": "e", "recommendation": "r", "citations": [', CASE WHEN conv_id % 17 = 2 THEN '' ELSE '{"filePath": "a.ts", "startLine": 1, "endLine": 2, "symbolName": null}' END, ']}]}') END AS result
        FROM conversations""",
}


def needed(name: str) -> list[str]:
    """The view and those that it uses, in order."""
    wanted = {name}
    for view in reversed(VIEWS):
        if view in wanted:
            wanted |= {other for other in VIEWS if re.search(rf"\b{other}\b", VIEWS[view]) and other != view}
    if "embeddings" in wanted:
        wanted.discard("embeddings")
    return [v for v in VIEWS if v in wanted]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame over the Parquet tables of a folder."""
    made: dict[str, DataFrame] = {}
    for v in needed(name):
        sql, frames = VIEWS[v], {}
        for table in ["documents", "customer", "events", "embeddings", "conversations", *made]:
            if re.search(rf"\b(?:FROM|JOIN|,) {table}\b", sql):
                frames[table] = made[table] if table in made else spark.read.parquet(f"{sf_dir}/{table}.parquet")
        sql = sql.replace("{", "{{").replace("}", "}}")
        for table in frames:
            sql = re.sub(rf"(FROM|JOIN|,) {table}\b", rf"\1 {{{table}}} AS {table}" if not re.search(rf"(FROM|JOIN|,) {table} AS", sql) else rf"\1 {{{table}}}", sql)
        made[v] = spark.sql(sql, **frames)
    return made[name]


def with_views(sql: str, *names: str) -> str:
    """A query for DuckDB with the views that it uses before it."""
    wanted = {v for name in names for v in needed(name)}
    ctes = [f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in wanted]
    body = sql.strip()
    return "WITH RECURSIVE " + ",\n".join(ctes) + ("" if body[:1] == "," else "\n") + body
