from __future__ import annotations

import os
import posixpath
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from repolens.operators import chunks, graph, index, rules, symbols

FILES = "run_id string, file_id string, path string, language string, content string"


@pytest.fixture
def parse(spark):
    def go(content, language):
        rows = symbols.extract_symbols(spark.createDataFrame([("r", "f", "p", language, content)], FILES)).orderBy("ordinal").collect()
        assert [r.ordinal for r in rows] == list(range(len(rows)))
        return [(r.name, r.kind, r.start_line, r.end_line, r.exported, r.parent_name, r.signature) for r in rows], {r.name: r.parameter_count for r in rows}

    return go


def test_python_symbols(parse):
    src = "import os\nfrom typing import List\n\ndef top_level(a, b):\n    return a\n\nclass Greeter:\n    def greet(self):\n        return 1\n\n    def _hidden(self, x):\n        pass\n"
    found, counts = parse(src, "Python")
    assert [(x[0], x[1], x[2], x[3], x[4], x[5]) for x in found] == [
        ("top_level", "FUNCTION", 4, 5, True, None), ("Greeter", "CLASS", 7, 12, True, None),
        ("greet", "METHOD", 8, 9, True, "Greeter"), ("_hidden", "METHOD", 11, 12, False, "Greeter"),
    ]
    assert counts["top_level"] == 2 and counts["greet"] == 0


def test_java_control_words_are_no_methods(parse):
    src = "public class A {\n  public int f(int a, int b) {\n    if (a > b) {\n      return a;\n    } else if (b > a) {\n      return b;\n    }\n    return 0;\n  }\n  private void g() {\n  }\n}\nint loose() {\n}\n"
    found, counts = parse(src, "Java")
    assert [(x[0], x[1], x[2], x[3], x[4], x[5]) for x in found] == [("A", "CLASS", 1, 12, True, None), ("f", "METHOD", 2, 9, True, "A"), ("g", "METHOD", 10, 11, False, "A")]
    assert counts["f"] == 2


def test_cpp_and_go_symbols(parse):
    found, counts = parse('#include <vector>\nint add(int a, int b) {\n  return a;\n}\nclass S {\n  int area() {\n  }\n};\n', "C++")
    assert [(x[0], x[1], x[5]) for x in found] == [("add", "FUNCTION", None), ("S", "CLASS", None), ("area", "METHOD", "S")]
    assert counts["add"] == 2
    found, _ = parse('import (\n "os"\n)\ntype Config struct {\n  A int\n}\nfunc Run(a int) error {\n}\nfunc helper() {\n}\n', "Go")
    assert [(x[0], x[1], x[4]) for x in found] == [("Config", "CLASS", True), ("Run", "FUNCTION", True), ("helper", "FUNCTION", False)]


def test_unclosed_blocks_end_with_the_file(parse):
    found, _ = parse("class A {\n int f() {\n", "C++")
    assert [(x[2], x[3]) for x in found] == [(1, 3), (2, 3)]


def test_imports(spark):
    rows = [
        ("p", "Python", "import os, sys as s\nfrom a.b import c\nclass import_x:\n  import  json"),
        ("j", "Java", "import static a.b.*;\nimport java.util.List;"),
        ("c", "C", '#include <stdio.h>\n#include "x.h"'),
        ("g", "Go", 'import "fmt"\nimport (\n "os"\n import (\n s "strings"\n)\n"loose"'),
        ("t", "TypeScript", "import x from 'y'"),
    ]
    df = spark.createDataFrame([("r", i, i, lang, c) for i, lang, c in rows], FILES)
    got = {}
    for r in symbols.extract_imports(df).collect():
        got.setdefault(r["file_id"], []).append((r["line"], r["source"], r["kind"]))
    assert {k: [x[1] for x in sorted(v)] for k, v in got.items()} == {"p": ["os", "sys", "a.b", "json"], "j": ["a.b.*", "java.util.List"], "c": ["stdio.h", "x.h"], "g": ["fmt", "os", "strings"]}
    assert got["c"][0][2] == "INCLUDE"


def rule_rows(spark, rule, syms=(), content="x", metrics=(), **limits):
    files = spark.createDataFrame([("r", "f", "a.ts", "TypeScript", content)], FILES)
    s = spark.createDataFrame(list(syms), "run_id string, file_id string, name string, kind string, start_line int, end_line int, complexity int, parameter_count int")
    m = spark.createDataFrame(list(metrics), "run_id string, file_id string, path string, line_count int")
    return rule(rules.Context(files, s, m, rules.Thresholds(**limits))).collect()


@pytest.mark.parametrize(("rule", "value", "severity"), [("complexity_high", 11, "MEDIUM"), ("complexity_high", 21, "HIGH"), ("complexity_high", 10, None), ("too_many_parameters", 6, "LOW"), ("too_many_parameters", 5, None), ("function_too_long", 81, "MEDIUM"), ("function_too_long", 161, "HIGH"), ("function_too_long", 80, None)])
def test_symbol_rules(spark, rule, value, severity):
    sym = ("r", "f", "go", "METHOD", 1, value if rule == "function_too_long" else 1, value if rule == "complexity_high" else None, value if rule == "too_many_parameters" else None)
    got = rule_rows(spark, getattr(rules, rule), [sym, ("r", "f", "K", "CLASS", 1, 999, 99, 99)])
    assert [r["severity"] for r in got] == ([severity] if severity else [])


def test_file_and_todo_rules(spark):
    got = rule_rows(spark, rules.file_too_large, metrics=[("r", "f", "a.ts", 501), ("r", "g", "b.ts", 500), ("r", "h", "c.ts", 1001)])
    assert sorted((r["file_id"], r["severity"], r["line"]) for r in got) == [("f", "MEDIUM", None), ("h", "HIGH", None)]
    got = rule_rows(spark, rules.todo_comment, content="// TODO: fix this\nconst TODOS = 1;\n  // FIXME\nTODO " + "x" * 300)
    assert [(r["line"], r["message"]) for r in got][:2] == [(1, "TODO comment: fix this"), (3, "FIXME comment: // FIXME")]
    assert len(got) == 3 and len(got[2]["message"]) == 240 and got[0]["metadata"] == {"marker": "TODO"}


def test_a_broken_rule_is_left_out(spark):
    def broken(context):
        raise ValueError("boom")

    files = spark.createDataFrame([("r", "f", "a.ts", "TypeScript", "// TODO x")], FILES)
    none = spark.createDataFrame([], "run_id string, file_id string, name string, kind string, start_line int, end_line int, complexity int, parameter_count int, path string, line_count int")
    got = rules.run_rules(rules.Context(files, none, none), (*rules.DEFAULT_RULES, broken))
    assert [r["rule_id"] for r in got.collect()] == ["TODO_COMMENT"]


# --- chunks --------------------------------------------------------------------------------------

SYMBOLS = "run_id string, file_id string, symbol_id string, ordinal int, name string, start_line int, end_line int, parent_id string"


def plainly(content, syms, c):
    """Chunks by direct recursion over one file: (start, end, symbol, text)."""
    if not content.strip():
        return []
    rows = content.split("\n")
    order = sorted(syms, key=lambda s: (s[4], s[1]))
    out = []

    def emit(a, b, sid, depth):
        own = rows[max(a, 1) - 1 : b]
        kids = [s for s in order if sid is not None and s[6] == sid] if depth < 2 else []
        if len("\n".join(own)) <= c.max_chars:
            out.append((a, b, sid, "\n".join(own)))
        elif kids:
            cut(kids, a, b, sid, depth + 1)
        else:
            for x, y in chunks.split_ranges([len(x) for x in own], c):
                out.append((a + x, a + y - 1, sid, "\n".join(own[x:y])))

    def cut(kids, a, b, sid, depth):
        cursor = a
        for s in kids:
            if s[4] > cursor:
                emit(cursor, s[4] - 1, sid, depth)
            emit(s[4], s[5], s[0], depth)
            cursor = s[5] + 1
        if cursor <= b:
            emit(cursor, b, sid, depth)

    cut([s for s in order if s[6] is None], 1, len(rows), None, 0)
    return [o for o in out if not (o[2] is None and syms and len(o[3].strip()) < c.min_chars)]


def test_chunks_equal_plain_recursion(spark):
    rng = random.Random(3)
    files, syms, want = [], [], {}
    config = chunks.Chunking(target_chars=60, max_chars=120, overlap_lines=2, min_chars=12)
    for f in range(40):
        n = rng.randint(1, 60)
        content = "\n".join("x" * rng.choice([0, 3, 10, 30, 200 if rng.random() < 0.1 else 5]) for _ in range(n)) if f % 13 else "  \n "
        own = []
        for k in range(rng.randint(0, 6)):
            a = rng.randint(1, n)
            parent = f"{f}-{rng.randrange(k)}" if k and rng.random() < 0.6 else None
            own.append((f"{f}-{k}", k, None, f"s{k}", a, rng.randint(a, n + 2), parent))
        files.append(("r", str(f), f"p{f}.ts", "TypeScript" if f % 11 else None, content))
        syms += [("r", str(f), s[0], s[1], s[3], s[4], s[5], s[6]) for s in own]
        want[str(f)] = plainly(content, own, config) if f % 11 else []
    got = {str(f): [] for f in range(40)}
    for r in chunks.chunk_files(spark.createDataFrame(files, FILES), spark.createDataFrame(syms, SYMBOLS), config).orderBy("file_id", "chunk_index").collect():
        assert r["chunk_index"] == len(got[r["file_id"]])
        got[r["file_id"]].append((r["start_line"], r["end_line"], r["symbol_id"], r["content"]))
    assert got == want
    assert sum(map(len, want.values())) > 100


def slow_ranges(lengths, c):
    out, start, n = [], 0, len(lengths)
    while start < n:
        end, size = start + 1, lengths[start] + 1
        while end < n and size < c.target_chars and size + lengths[end] + 1 <= c.max_chars:
            size, end = size + lengths[end] + 1, end + 1
        out.append((start, end))
        if end >= n:
            break
        start = max(end - c.overlap_lines, start + 1)
    return out


def test_all_rows_are_split_as_one_by_one():
    rng = random.Random(3)
    for target, most, overlap in ((30, 60, 3), (10, 200, 0), (100, 150, 99), (1, 1, 1)):
        c = chunks.Chunking(target, most, overlap)
        rows = [[rng.randrange(40) for _ in range(rng.choice([0, 1, 5, 300]))] for _ in range(60)]
        at = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        row, a, b = chunks.split_many(np.array([x for r in rows for x in r], np.int64), at, c)
        assert [list(zip(a[row == i].tolist(), b[row == i].tolist())) for i in range(len(rows))] == [slow_ranges(x, c) for x in rows]


def test_a_file_of_many_symbols(spark):
    content = "\n".join(f"line {i} " + "x" * 30 for i in range(40_000))
    rows = [("r", "f", f"s{i}", i, f"n{i}", 1 + 8 * i, 8 + 8 * i if i % 2 else 16 + 8 * i, f"s{i - 1}" if i % 2 else None) for i in range(5_000)]
    given = spark.createDataFrame(rows, "run_id string, file_id string, symbol_id string, ordinal int, name string, start_line int, end_line int, parent_id string")
    file = spark.createDataFrame([("r", "f", "p", "Java", content)], FILES)
    begin = time.time()
    found = chunks.chunk_files(file, given, chunks.Chunking(100, 400, 1)).collect()
    assert time.time() - begin < 60 and {r.symbol_id for r in found} == {r[2] for r in rows}


def test_split_ranges_advance_and_cover():
    c = chunks.Chunking(target_chars=100, max_chars=150, overlap_lines=1)
    found = chunks.split_ranges([20] * 50, c)
    assert found[0][0] == 0 and found[-1][1] == 50
    assert all(a[0] < b[0] and b[0] <= a[1] for a, b in zip(found, found[1:]))
    assert chunks.split_ranges([9999], c) == [(0, 1)]
    assert chunks.split_ranges([], c) == []
    assert len(chunks.split_ranges([90] * 5, chunks.Chunking(100, 150, 99))) == 5


def test_an_oversized_gap_repeats_its_symbols_children(spark):
    content = "\n".join(["class A {", *["y" * 30] * 6, "m() {", "}", "}"])
    syms = [("r", "f", "A", 0, "A", 1, 10, None), ("r", "f", "m", 1, "m", 8, 9, "A")]
    got = chunks.chunk_files(spark.createDataFrame([("r", "f", "a.ts", "TypeScript", content)], FILES), spark.createDataFrame(syms, SYMBOLS), chunks.Chunking(100, 150, 0, 5)).collect()
    assert sum(r["symbol_id"] == "m" for r in got) == 2


def table(spark, hashes):
    return spark.createDataFrame([("r", f, 0, "s", "text " + h, h) for f, h in hashes.items()], "run_id string, file_id string, chunk_index int, symbol_id string, content string, content_hash string")


def test_incremental_runs(spark):
    first = {str(i): f"h{i}" for i in range(5)}
    stored = table(spark, {}).withColumns({"embedding": index.F.array(index.F.lit(0.0)).cast("array<float>"), "id": index.F.lit("x"), "created_at": index.F.lit("2024-01-01").cast("timestamp")})
    embed = lambda rows: index.embed_pseudo(rows, 4)

    def run(hashes, existing):
        fresh = table(spark, hashes)
        stats = index.diff_statistics(index.diff_chunks(fresh, existing)).first()
        return tuple(stats)[1:], index.apply_diff(fresh, existing, embed).cache()

    stats, after = run(first, stored)
    assert stats == (5, 0, 5, 0) and after.count() == 5
    stats, after = run(first, after)
    assert stats == (5, 5, 0, 0)
    before = {r["file_id"]: r for r in after.collect()}
    stats, after = run({**first, "2": "changed"}, after)
    assert stats == (5, 4, 1, 0)
    now = {r["file_id"]: r for r in after.collect()}
    assert now["2"]["id"] == before["2"]["id"] and now["2"]["embedding"] != before["2"]["embedding"] and now["1"]["embedding"] == before["1"]["embedding"]
    stats, after = run({k: v for k, v in {**first, "2": "changed"}.items() if k != "4"}, after)
    assert stats == (4, 4, 0, 1) and after.count() == 4


def test_vectors(spark):
    rows = [([1.0, 2.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([1.0],), (None,), ([None, 1.0],)]
    good, bad = index.check_vectors(spark.createDataFrame(rows, "embedding array<double>"), 2)
    assert good.count() == 1 and bad.count() == 5


def test_an_import_is_one_row_of_the_join(spark):
    files = [(f"r{i % 3}", str(i), f"src/{name}", "TypeScript", "") for i, name in enumerate(["a.ts", "a.tsx", "b/index.js", "c", "c.ts", "d.ts/index.ts", "d.ts.ts", ".ts", "e/.ts", "b.mjs"] * 3)]
    df = spark.createDataFrame(files, FILES)
    sources = ["./a", "./b", "./c", "./d.ts", "./", "./e/", "./e", "../src/a.tsx", "lib", "./none"]
    imports = spark.createDataFrame([(r, f, f"{f}-{k}", s, "IMPORT", k) for r, f, *_ in files for k, s in enumerate(sources)], "run_id string, file_id string, import_id string, source string, kind string, line int")
    paths = {(r, p): f for r, f, p, *_ in files}
    found = graph.resolve_imports(imports, df).collect()
    assert len(found) == len(files) * len(sources)
    for row in found:
        folder = row.source_path.rsplit("/", 1)[0]
        tried = [posixpath.normpath(f"{folder}/{row.source}") + ("/" if row.source.endswith("/") else "") + s for s in graph.SUFFIXES] if row.source.startswith((".")) else []
        best = next((t for t in tried if (row.run_id, t) in paths), None)
        assert row.target_path == best and row.target_file_id == (paths[row.run_id, best] if best else None)
    plan = graph.resolve_imports(imports, df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1  # of the files, not of the imports


def test_providers_get_full_batches(spark):
    sizes = spark.sparkContext.accumulator(0)
    calls = spark.sparkContext.accumulator(0)
    short = spark.sparkContext.accumulator(0)

    def provider():
        def embed(texts):
            sizes.add(len(texts))
            calls.add(1)
            short.add(len(texts) < 96)
            return [[float(len(t)), 1.0] for t in texts]

        return embed

    rows = spark.range(10_000).selectExpr("cast(id AS string) AS content").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        found = index.embed_batches(rows, provider).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.content for r in found] == [str(i) for i in range(10_000)] and all(r.embedding == [float(len(r.content)), 1.0] for r in found)
    assert (sizes.value, calls.value, short.value) == (10_000, 105, 1)
    with pytest.raises(Exception, match="the provider returned 1 vectors for"):
        index.embed_batches(rows, lambda: lambda texts: [[1.0]]).collect()


def test_a_retry_embeds_only_what_is_open(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)
    broken = str(tmp_path / "broken")

    def provider():
        def embed(texts):
            if os.path.exists(broken) and "7" in texts:
                raise RuntimeError("out of quota")
            asked.add(len(texts))
            return [[float(t)] for t in texts]

        return embed

    rows = spark.createDataFrame([(str(i % 40),) for i in range(100)] + [(None,)], "content string")
    open(broken, "w").close()
    with pytest.raises(Exception, match="out of quota"):
        index.embed_once(rows, provider, str(tmp_path / "known"), waves=6)
    before = asked.value
    os.remove(broken)
    found = index.embed_once(rows, provider, str(tmp_path / "known"), waves=6).collect()
    assert sorted(r.embedding[0] for r in found if r.content) == sorted(float(i % 40) for i in range(100)) and [r.embedding for r in found if r.content is None] == [None]
    done = spark.read.parquet(str(tmp_path / "known")).count()
    assert done == 40 and asked.value - before < 40
    again = asked.value
    index.embed_once(rows, provider, str(tmp_path / "known"), waves=6).collect()
    assert asked.value == again


def test_what_is_held_between_calls_is_as_small_as_a_call():
    """Rows that wait for the next call do not hold the batch that they came in."""
    given = (pa.record_batch([pa.array(["x" * 1000] * 1010)], names=["content"]) for _ in range(4))
    before, sizes, most = pa.total_allocated_bytes(), [], 0
    for part in index._in_batches(given, 96):
        sizes.append(len(part))
        most = max(most, pa.total_allocated_bytes() - before)
    assert sizes == [96] * 42 + [8] and most < 1.5 * 1010 * 1000
