"""Symbols of random and of large files against a line-by-line brute force."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from repolens.operators import blocks, symbols

from .slow_symbols import symbols_of

FILES = "run_id string, file_id string, path string, language string, content string"

PIECES = {
    "Python": ["class A:", "class B(A):", "def f(a, b):", "def _g(self):", "x = 1", "", "   ", "import os", "async def h():", "classy = 2", "return 3"],
    "Java": ["public class A {", "interface I {", "private int f(int a, int b) {", "void g() throws E, F {", "if (a) {", "} else if (b) {", "}", "}}", "import a.b.C;", "int x = f();", "class B { void h() {", "List<String> k(A a) {", "new Foo() {", ""],
    "C++": ["class A {", "int f(int a) {", "void A::g(int a,", "while (x) {", "}", "};", "#include <class.h>", "static int* h() const {", "{", "}{", "struct S {", "class B;", ""],
    "C": ["int main(void) {", "if (x) {", "}", "return f(x);", "static void *g(int a, char b) {", "{ {", "} }", ""],
    "Go": ["type A struct {", "func F(a int) error {", "func (a *A) g() {", "import (", ")", '"os"', 'import "fmt"', "}", "type I interface {", "x := func() {", "func h() { return }", ""],
}


@pytest.mark.parametrize("language", sorted(PIECES))
def test_random_files_equal_brute_force(spark, language):
    rng = random.Random(language)
    files = []
    for i in range(300):
        ends = rng.choice(["\n", "\r\n", "\r"])
        lines = [" " * rng.choice([0, 0, 0, 2, 4, 4, 8]) + rng.choice(PIECES[language]) for _ in range(rng.randrange(0, 40))]
        files.append(("r", str(i), "p", language, ends.join(lines)))
    found = {}
    for r in symbols.extract_symbols(spark.createDataFrame(files, FILES).repartition(3)).collect():
        found.setdefault(r.file_id, []).append(tuple(r)[2:])
    for _, i, _, _, content in files:
        slow = [(k, *x[:6], x[6], x[7]) for k, x in enumerate(symbols_of(content, language))]
        assert sorted(found.get(i, [])) == [(k, n, kind, a, b, e, p, s, c) for k, n, kind, a, b, e, p, s, c in slow], content


def test_a_file_of_many_functions(spark):
    body = "\n".join(f"  public int f{i}(int a) {{\n    if (a > {i}) {{\n      a = 1;\n    }}\n    int b = a;\n    int c = b;\n    int d = c;\n    return d;\n  }}\n" for i in range(20_000))
    content = f"class A {{\n{body}\n}}"
    deep = "\n".join(" " * (i % 500) + f"class C{i}:" for i in range(20_000))
    df = spark.createDataFrame([("r", "wide", "p", "Java", content), ("r", "deep", "p", "Python", deep)], FILES)
    begin = time.time()
    rows = symbols.extract_symbols(df).collect()
    assert time.time() - begin < 60
    wide = [r for r in rows if r.file_id == "wide"]
    assert len(wide) == 20_001 and {r.end_line - r.start_line for r in wide if r.kind == "METHOD"} == {8} and {r.parent_name for r in wide if r.kind == "METHOD"} == {"A"}
    assert max(r.end_line for r in wide) == content.count("\n") + 1
    by_name = {r.name: r for r in rows if r.file_id == "deep"}
    assert by_name["C499"].parent_name == "C498" and by_name["C500"].parent_name is None and by_name["C0"].end_line == 500


def test_a_very_long_indent_and_null_content(spark):
    files = [("r", "a", "p", "Java", " " * 100_000 + "class A {\n" + " " * 100_000 + "void f() {\n}\n}"), ("r", "b", "p", "Java", None), ("r", "c", "p", "Ruby", "class A"), ("r", "d", "p", "Java", "")]
    assert [(r.name, r.parent_name) for r in symbols.extract_symbols(spark.createDataFrame(files, FILES)).orderBy("ordinal").collect()] == [("A", None), ("f", "A")]


def test_minima_find_the_first():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 17, 64, 200):
        values = np.append(rng.integers(-5, 20, n), -100)
        start, most = rng.integers(0, n + 1, 300), rng.integers(-8, 20, 300)
        slow = [next(i for i in range(a, n + 1) if values[i] <= m) for a, m in zip(start, most)]
        assert blocks.Minima(values).first(start, most).tolist() == slow
