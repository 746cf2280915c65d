from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from repolens.functions import text as X
from repolens.operators import archive, classify, graph, lines
from repolens.sources import tables, tree


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_safe_paths(spark):
    bad = ["../../etc/passwd", "../sibling-file", "/etc/passwd", "src/../../outside/file", "../workspace-evil/file"]
    good = ["src/index.ts", "a/b/c/d.txt", ".", "a/../b", "/workspace/x", ""]
    got = values(spark, [(p,) for p in bad + good], "p string", archive.is_safe(F.col("p")))
    assert got == [False] * len(bad) + [True] * len(good)


def admitted(spark, rows, **limits):
    df = spark.createDataFrame([("r", i, *r) for i, r in enumerate(rows)], "repository_id string, ordinal int, entry_path string, entry_type string, size long")
    got = archive.admit(df, archive.Limits(**limits))
    return [r["status"] for r in got.orderBy("ordinal").collect()], archive.verdicts(got).first()


def test_admission_links_and_sizes(spark):
    status, verdict = admitted(spark, [("a/f", "File", 10), ("a/l", "SymbolicLink", 0), ("a/big", "File", 99), ("a/d", "Directory", None)], max_file_bytes=50)
    assert status == ["accepted", "link", "oversized", "directory"]
    assert tuple(verdict)[1:] == ("accepted", 1)


def test_admission_stops_at_the_first_breach(spark):
    rows = [("f1", "File", 5), ("f2", "File", 5), ("f3", "File", 5), ("../x", "File", 1), ("d", "Directory", 0)]
    status, verdict = admitted(spark, rows, max_files=2)
    assert status == ["accepted", "accepted", "too_many_files", "stopped", "stopped"]
    assert tuple(verdict)[1:] == ("too_many_files", 2)  # the unsafe path is not seen any more
    status, verdict = admitted(spark, [("../x", "File", 1), *rows], max_repository_bytes=9)
    assert status[:3] == ["unsafe", "accepted", "repository_too_large"]
    assert verdict["verdict"] == "unsafe_path"


def test_count_is_tested_before_bytes(spark):
    status, _ = admitted(spark, [("a", "File", 5), ("b", "File", 50)], max_files=1, max_repository_bytes=10)
    assert status[1] == "too_many_files"


def test_classification(spark):
    names = ["index.ts", "README.md", "package.json", "pnpm-lock.yaml", "logo.png", "data.json", "bundle.min.js", "mystery.xyz123", ".gitignore", "x.PY", "Makefile", "readme"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    got = {r["path"]: r for r in classify.classify(df).collect()}
    want = ["SOURCE", "DOCUMENTATION", "CONFIG", "GENERATED", "BINARY", "DATA", "GENERATED", "DATA", "CONFIG", "SOURCE", "CONFIG", "DOCUMENTATION"]
    assert [got[n]["category"] for n in names] == want
    assert got["x.PY"]["language"] == "Python" and got["README.md"]["language"] is None
    assert got[".gitignore"]["extension"] is None and got["index.ts"]["is_source"]


def test_pruning_looks_at_folders_only(spark):
    df = spark.createDataFrame([("node_modules/p/i.js",), (".git/HEAD",), ("real.ts",), ("src/build",), ("a/dist/b/c.ts",)], "path string")
    assert {r["path"] for r in classify.classify(df).collect()} == {"real.ts", "src/build"}


def metrics(spark, content, language="TypeScript"):
    row = lines.line_metrics(spark.createDataFrame([(content, language)], "content string, language string")).first()
    return row["line_count"], row["code_line_count"], row["comment_line_count"], row["blank_line_count"]


def test_line_metrics(spark):
    assert metrics(spark, "// a\nconst x = 1;\n/* open\n still\n*/\n\nconst y;") == (7, 2, 4, 1)
    assert metrics(spark, "const x = 1; // trailing") == (1, 1, 0, 0)
    assert metrics(spark, "/* a\n\n b */\nx") == (4, 1, 2, 1)
    assert metrics(spark, "/* a */ x\r\ny\rz\n") == (4, 2, 1, 1)
    assert metrics(spark, "# a\n-- b", "Python") == (2, 1, 1, 0)
    assert metrics(spark, "# a\n// b", "Elvish") == (2, 2, 0, 0)
    assert metrics(spark, None, None) == (1, 0, 0, 1)


def test_normal_paths(spark):
    cases = {"a/./b": "a/b", "a/../b": "b", "../x": "../x", "a/../../x": "../x", "./lib/": "lib/", "a//b": "a/b", ".": "."}
    assert values(spark, [(p,) for p in cases], "p string", X.normal_path(F.col("p"))) == list(cases.values())


def test_import_resolution(spark):
    files = spark.createDataFrame([("r", p, p, lang) for p, lang in [("src/a.ts", "TypeScript"), ("src/b.ts", "TypeScript"), ("src/c.ts", "TypeScript"), ("src/lib/index.ts", "TypeScript"), ("m.py", "Python"), ("src/c.js", "JavaScript")]], "run_id string, file_id string, path string, language string")
    made = [("src/a.ts", "./b"), ("src/a.ts", "./c"), ("src/b.ts", "./c.js"), ("src/a.ts", "./lib"), ("src/a.ts", "./lib/"), ("src/a.ts", "fastify"), ("src/a.ts", "./gone"), ("m.py", "os"), ("src/a.ts", ".."), ("src/lib/index.ts", "../a")]
    imports = spark.createDataFrame([("r", f, str(i), s, "IMPORT", 1) for i, (f, s) in enumerate(made)], "run_id string, file_id string, import_id string, source string, kind string, line int")
    got = {int(r["import_id"]): (r["target_file_id"], r["external"]) for r in graph.dependency_edges(imports, files).collect()}
    want = ["src/b.ts", "src/c.ts", "src/c.js", "src/lib/index.ts", None, None, None, None, None, "src/a.ts"]
    assert [got[i] for i in range(len(made))] == [(t, t is None) for t in want]


def test_read_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("é\n", encoding="utf-8")
    got = tree.read_tree(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("src/a.py", "a.py", 3, "é\n")]


def test_metadata_keeps_the_latest(spark, tmp_path):
    (tmp_path / "r.json").write_text("\n".join(f'{{"id": {i}, "owner": {{"login": "o"}}, "name": "n{i}", "updated_at": "2024-01-0{i}T00:00:00Z", "user_id": "u"}}' for i in (1, 2, 3)))
    got = tree.read_metadata(spark, str(tmp_path), most=2).collect()
    assert sorted(r["github_id"] for r in got) == [2, 3] and got[0]["owner"] == "o" and got[0]["description"] is None


def test_written_runs_replace_theirs(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_runs(spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, v int"), path)
    tables.write_runs(spark.createDataFrame([("b", 3)], "run_id string, v int"), path)
    assert {(r["run_id"], r["v"]) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}


def test_upsert_keeps_ids(spark):
    old = spark.createDataFrame([("k1", "id1", "a"), ("k2", "id2", None)], "k string, id string, v string")
    new = spark.createDataFrame([("k2", "x", "b"), ("k3", "id3", None)], "k string, id string, v string")
    got = {tuple(r) for r in tables.upsert(old, new, ["k"], ["id"]).collect()}
    assert got == {("k1", "id1", "a"), ("k2", "id2", "b"), ("k3", "id3", None)}
    cleared = spark.createDataFrame([("k1", "y", None)], "k string, id string, v string")
    assert ("k1", "id1", None) in {tuple(r) for r in tables.upsert(old, cleared, ["k"], ["id"]).collect()}


def test_a_large_archive_is_spread_over_tasks(spark):
    """Stretches of any length give the status that one running total gives, null keys included."""
    n = 200_000
    entries = spark.range(n + 50).selectExpr(
        f"CASE WHEN id >= {n} THEN null WHEN id % 10 = 0 THEN 'small' ELSE 'hot' END AS repository_id", "cast(id AS int) AS ordinal",
        "concat('top/', CASE WHEN id % 1000 = 7 THEN '../../../x' ELSE 'f' END, id) AS entry_path", "CASE WHEN id % 7 = 0 THEN 'Directory' ELSE 'File' END AS entry_type", "CASE WHEN id % 3 <> 0 THEN id % 101 END AS size",
    )
    limits = archive.Limits(max_repository_bytes=3_000_000, max_file_bytes=98, max_files=120_000)
    found = [archive.admit(entries, limits, stretch).select("repository_id", "ordinal", "status") for stretch in (1 << 30, 5_000)]
    assert found[0].exceptAll(found[1]).count() == 0 and found[0].count() == n + 50
    counts = {(r[0], r[1]): r[2] for r in found[1].groupBy("repository_id", "status").count().collect()}
    assert counts["hot", "repository_too_large"] == 1 and counts["hot", "stopped"] > 50_000 and counts[None, "accepted"] > 0


@pytest.mark.parametrize("name", ["c++ (x).d", "a[b]{c}*?", "plain"])
def test_roots_are_names(spark, tmp_path, name):
    root = tmp_path / name
    (root / "sub").mkdir(parents=True)
    (tmp_path / "other").mkdir()
    (root / "one.txt").write_text("eins")
    (root / "sub" / "two (2).txt").write_text("zwei" * 100)
    (tmp_path / "other" / "secret.txt").write_text("outside")
    (root / "link.txt").symlink_to(root / "one.txt")
    (root / "linked").symlink_to(tmp_path / "other")
    found = {r.path: (r.name, r.size, r.content) for r in tree.read_tree(spark, str(root)).collect()}
    assert found == {"one.txt": ("one.txt", 4, "eins"), "sub/two (2).txt": ("two (2).txt", 400, "zwei" * 100)}
    assert [r.path for r in tree.read_tree(spark, f"{root}/", max_bytes=100).collect()] == ["one.txt"]


def test_a_tree_is_listed_and_read_by_tasks(spark, tmp_path):
    """The driver holds no listing of the tree, however many files it has; each row has a file of its own."""
    rows = spark.range(400).selectExpr("CASE WHEN id > 0 THEN id - id % 3 END AS doc", "CASE WHEN id % 5 > 0 THEN concat('é', id) ELSE '' END AS text")
    root = tmp_path / "tree"
    tree.write_tree(rows, str(root), "doc", F.col("text"))
    (root / "_hidden").mkdir()
    (root / "_hidden" / "a").write_text("no")
    (root / "_x=1" / "deep" / "er").mkdir(parents=True)
    (root / "_x=1" / "deep" / "er" / "f.txt").write_bytes(b"x" * (9 << 20))
    (root / ".git").write_text("no")
    (root / "empty").mkdir()
    found = tree.read_tree(spark, str(root))
    assert not any(str(root) in f for f in found.inputFiles())
    got = sorted((r.path.rsplit("/", 1)[0], r.size, r.content) for r in found.collect())
    want = [(f"doc={'__HIVE_DEFAULT_PARTITION__' if r.doc is None else r.doc}", len(r.text.encode()) + 1, r.text + "\n") for r in rows.collect()]
    assert got == sorted([*want, ("_x=1/deep/er", 9 << 20, "x" * (9 << 20))])
    (tmp_path / "none").mkdir()
    assert tree.read_tree(spark, str(tmp_path / "none")).count() == 0
