"""Where blocks of source lines end and what encloses them, for all files of a batch at once.

Both are searches for the first value at most some bound: the end of a brace block is the first line that
leaves no more braces open than there were before it, the end of an indented block comes before the
first line that is indented no deeper, and what encloses a line is the last scope before it that ends
no earlier. A pyramid of minima over the values of all files answers all searches together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a line may begin: a scope, an interface, a function or method; of Go also an import block, and its end.
SCOPE, INTERFACE, CALL, BLOCK, SHUT = range(5)
#: Less than any value: stands between files, so that no search leaves its file.
_WALL = -(1 << 40)


class Minima:
    """Minima of blocks of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values.astype(np.int64)]
        while len(self.levels[-1]) > 1:
            now = self.levels[-1]
            if len(now) % 2:
                now = self.levels[-1] = np.append(now, 1 << 40)
            self.levels.append(np.minimum(now[::2], now[1::2]))

    def first(self, start: np.ndarray, most: np.ndarray) -> np.ndarray:
        """For each query the first place from `start` on whose value is `most` or less. There must be one."""
        at, level = start.astype(np.int64), np.zeros(len(start), np.int64)
        open_ = np.arange(len(start))
        for k, values in enumerate(self.levels):  # up, to a block that holds one: this one, or the other half
            hit = values[at[open_]] <= most[open_]
            level[open_[hit]] = k
            open_ = open_[~hit]
            left = open_[at[open_] % 2 == 0]
            right = open_[at[open_] % 2 == 1]
            at[left] += 1
            hit = values[at[left]] <= most[left]
            level[left[hit]] = k
            open_ = np.concatenate([left[~hit], right])
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) // 2
        for k in range(len(self.levels) - 1, 0, -1):  # and down, to the leftmost
            here = np.flatnonzero(level >= k)
            at[here] *= 2
            at[here] += self.levels[k - 1][at[here]] > most[here]
        return at


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The items of all lists, and where those of each list begin (then the end)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    items = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    return items.to_numpy(zero_copy_only=False), offsets - offsets[0]


def _walled(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values with a wall after those of each file, and how far each value has moved."""
    return np.insert(values.astype(np.int64), at[1:], _WALL), np.repeat(np.arange(len(at) - 1), np.diff(at))


def _before(at: np.ndarray, line: np.ndarray, row: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How many items (all files') come before line `wanted` of file `row`; `line` ascends in each file."""
    own = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return np.searchsorted(own << 32 | line, row << 32 | wanted)


def block_ends(python: np.ndarray, n_lines: np.ndarray, row: np.ndarray, line: np.ndarray, at: np.ndarray, mark: np.ndarray, value: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last line of the block that each head (file `row`, `line`) begins, and the indent or depth at it. The files' marks are
    at[i]:at[i + 1]: lines with braces and how many more open than close, or filled lines and their indents."""
    own = np.repeat(np.arange(len(at) - 1), np.diff(at))
    depth = np.cumsum(value)
    base = np.concatenate([[0], depth])[at[:-1]]
    tree_values = np.where(python[own], value, depth - base[own]) if len(own) else value
    tree = Minima(_walled(tree_values, at)[0])
    place = _before(at, mark, row, line)  # the first mark from the head's line on
    of_python = python[row]
    opening = np.flatnonzero(opens)
    opening = np.append(opening, len(opens))[np.searchsorted(opening, place)]
    none = ~of_python & (opening >= at[row + 1])  # no brace opens any more in the file
    held = np.where(place > at[row], np.append(depth, 0)[place - 1] - base[row], 0)
    most = np.where(of_python, np.append(value, 0)[np.minimum(place, len(value))], held)
    start = np.where(of_python, place + 1, np.where(none, at[row + 1], opening)) + row
    end = tree.first(start, most) - row  # without the walls of the files before
    over = end >= at[row + 1]
    line_of = np.append(mark, 0)
    braced = np.where(over, n_lines[row] - 1, line_of[np.minimum(end, len(mark))])
    return np.where(of_python, line_of[end - 1], braced), most


def enclosing(python: np.ndarray, row: np.ndarray, line: np.ndarray, end: np.ndarray, scope: np.ndarray, indent: np.ndarray) -> np.ndarray:
    """The head that encloses each head, -1 if none does. Heads are in order of file and line."""
    n = len(row)
    out = np.full(n, -1, np.int64)
    # braces: of the scopes before it the last that ends no earlier
    holder = np.flatnonzero(scope & ~python[row])
    if len(holder):
        asked = np.flatnonzero(~python[row])
        back = holder[::-1]
        values = np.append(-end[back], _WALL)
        start = len(holder) - np.searchsorted(holder, asked)  # the last scope before it, from the end
        found = Minima(values).first(start, -line[asked])
        hit = np.append(back, n)[found]
        same = hit < n
        same[same] = row[hit[same]] == row[asked[same]]
        # scopes of files before do not count, and none of this file can lie behind one of them
        out[asked[same]] = hit[same]
    # indents: the nearest head before it with a smaller indent; of those in turn the first that is a class
    asked = np.flatnonzero(python[row])
    if len(asked):
        own = row[asked]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        size = np.diff(first, append=len(asked))
        at = np.concatenate([[0], np.cumsum(size[::-1])])
        walled, moved = _walled(indent[asked][::-1], at)
        place = np.arange(len(asked)) + moved
        found = Minima(walled).first(place + 1, indent[asked][::-1] - 1) - moved
        wall = found >= at[1:][moved]
        parent = np.where(wall, -1, len(asked) - 1 - found)[::-1]
        jump = np.append(np.where(scope[asked], np.arange(len(asked)), parent), -1)
        while True:  # over functions, twice as far each time
            further = jump[jump]
            if np.array_equal(further, jump):
                break
            jump = further
        over = jump[parent]
        out[asked] = np.where(over >= 0, asked[over], -1)
    return out


def _scopes(language: pa.Array, n_lines: pa.Array, lines: pa.Array, kinds: pa.Array, mark: pa.Array, value: pa.Array, opens: pa.Array) -> pa.Array:
    (line, heads), kind, (marks, at) = flat(lines), flat(kinds)[0], flat(mark)
    python, java = (pc.equal(language, x).to_numpy(zero_copy_only=False) for x in ("Python", "Java"))
    row = np.repeat(np.arange(len(language)), np.diff(heads))
    # what the last marker before a head says: within an import block nothing begins
    event = np.flatnonzero(kind >= BLOCK)
    last = np.append(event, -1)[np.searchsorted(event, np.arange(len(kind))) - 1]
    inside = (last >= 0) & (last < np.arange(len(kind))) & (row[last] == row) & (kind[last] == BLOCK)
    plain = np.flatnonzero((kind < BLOCK) & ~inside)
    row_, line_, kind_ = row[plain], line[plain].astype(np.int64), kind[plain]
    end_, depth = block_ends(python, n_lines.to_numpy(), row_, line_, at, marks.astype(np.int64), flat(value)[0].astype(np.int64), flat(opens)[0].astype(bool))
    of = enclosing(python, row_, line_, end_, kind_ <= INTERFACE, depth)
    end, kept, parent = np.zeros(len(kind), np.int32), np.zeros(len(kind), bool), np.full(len(kind), -1)
    end[plain] = end_
    kept[plain] = ~(java[row_] & (kind_ == CALL) & (of < 0))  # a method of Java is within a scope
    parent[plain] = np.where(of >= 0, plain[of] - heads[row_], -1)
    fields = [pa.field("end", pa.int32()), pa.field("parent", pa.int32()), pa.field("kept", pa.bool_())]
    structs = pa.StructArray.from_arrays([pa.array(end), pa.array(parent.astype(np.int32), mask=parent < 0), pa.array(kept)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(heads.astype(np.int32)), structs)


def scopes(*columns: Column) -> Column:
    """For each head of a file (language, number of lines, lines and kinds of the heads, lines, values and openings
    of the marks): the last line of its block, the head that encloses it or null, and whether it is a symbol."""
    return F.arrow_udf(_scopes, "array<struct<end: int, parent: int, kept: boolean>>")(*columns)
