"""Symbols of one file line by line: what the operator is tested against."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from repolens.operators.symbols import CONTROL, CPP_CLASS, CPP_FUNCTION, CPP_INCLUDE, GO_BLOCK, GO_FUNC, GO_STRUCT, JAVA_CLASS, JAVA_IMPORT, JAVA_INTERFACE, JAVA_METHOD, PYTHON_CLASS, PYTHON_DEF


class _Braces:
    """Where brace blocks end, from one scan of a file's lines."""

    def __init__(self, lines: list[str]) -> None:
        opened = np.array([x.count("{") for x in lines], np.int64)
        closed = np.array([x.count("}") for x in lines], np.int64)
        self.depth = np.concatenate([[0], np.cumsum(opened - closed)])
        self.open_lines = np.flatnonzero(opened)
        self.n = len(lines)

    def end(self, i: int) -> int:
        """The first line from i on with an opening brace before its end and no more open than at i."""
        at = np.searchsorted(self.open_lines, i)
        if at == len(self.open_lines):
            return self.n - 1
        k = int(self.open_lines[at])
        shut = np.flatnonzero(self.depth[k + 1 :] <= self.depth[i])
        return k + int(shut[0]) if len(shut) else self.n - 1


class _Indents:
    """Where indented blocks end."""

    def __init__(self, lines: list[str]) -> None:
        self.filled = np.array([i for i, x in enumerate(lines) if x.strip()], np.int64)
        self.indent = np.array([len(lines[i]) - len(lines[i].lstrip()) for i in self.filled], np.int64)

    def end(self, i: int, base: int) -> int:
        at = int(np.searchsorted(self.filled, i, side="right"))
        shut = np.flatnonzero(self.indent[at:] <= base)
        upto = at + int(shut[0]) if len(shut) else len(self.filled)
        return int(self.filled[upto - 1]) if upto > at else i


def _count(line: str) -> int | None:
    m = re.search(r"\(([^)]*)\)", line)
    return None if m is None else sum(1 for p in m[1].split(",") if p.strip())


def _python(lines: list[str]) -> Iterator[tuple]:
    blocks, open_classes = _Indents(lines), []
    for i, line in enumerate(lines):
        m = re.match(PYTHON_CLASS, line) or re.match(PYTHON_DEF, line)
        if not m:
            continue
        indent, name = len(m[1]), m[2]
        while open_classes and open_classes[-1][0] >= indent:
            open_classes.pop()
        parent = open_classes[-1][1] if open_classes else None
        end = blocks.end(i, indent) + 1
        if m.lastindex == 2:
            yield name, "CLASS", i + 1, end, True, parent, f"class {name}", None
            open_classes.append((indent, name))
            continue
        n = _count(line)
        n = max(0, n - 1) if parent and n is not None else n
        yield name, "METHOD" if parent else "FUNCTION", i + 1, end, not name.startswith("_"), parent, f"def {name}({m[3].strip()})", n


def _braced(lines: list[str], language: str) -> Iterator[tuple]:
    blocks, scopes, importing = _Braces(lines), [], False
    for i, raw in enumerate(lines):
        line = raw.strip() if language == "Go" else raw
        if language == "Go":
            if importing:
                importing = line != ")"
                continue
            if re.match(GO_BLOCK, line):
                importing = True
                continue
        while scopes and scopes[-1][1] < i:
            scopes.pop()
        parent = scopes[-1][0] if scopes else None
        if language == "Java":
            face = re.match(JAVA_INTERFACE, line)
            holder = None if re.match(JAVA_IMPORT, line) else face or re.match(JAVA_CLASS, line)
            word, kind = ("interface", "INTERFACE") if face else ("class", "CLASS")
            call, of_call = re.match(JAVA_METHOD, line) if parent else None, "METHOD"
            shown = "private" not in line
        elif language == "Go":
            holder, call, of_call, kind = re.match(GO_STRUCT, line), re.match(GO_FUNC, line), "FUNCTION", "CLASS"
        else:
            included = re.match(CPP_INCLUDE, line)
            holder = None if included else re.match(CPP_CLASS, line)
            call = None if included else re.match(CPP_FUNCTION, line)
            word, kind, of_call, shown = "class", "CLASS", "METHOD" if parent else "FUNCTION", True
        if holder:
            name, end = holder[1], blocks.end(i)
            head = f"type {name} struct" if language == "Go" else f"{word} {name}"
            yield name, kind, i + 1, end + 1, name[0].isascii() and name[0].isupper() if language == "Go" else True, parent, head, None
            scopes.append((name, end))
        elif call and (language == "Go" or call[1] not in CONTROL):
            name = call[1]
            head = f"{'func ' if language == 'Go' else ''}{name}({call[2].strip()})"
            yield name, of_call, i + 1, blocks.end(i) + 1, name[0].isascii() and name[0].isupper() if language == "Go" else shown, parent, head, _count(line)


def symbols_of(content: str, language: str) -> list[tuple]:
    lines = re.split(r"\r\n|\r|\n", content)
    return list(_python(lines) if language == "Python" else _braced(lines, language))
