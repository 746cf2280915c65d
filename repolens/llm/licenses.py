"""Licence recognition by sentence rules.

A text becomes its words in lower case, with marks where a sentence ends (a stop, colon, semicolon,
exclamation or question mark before white space, or an empty line) and where a line ends. Comment marks
and line ends within a sentence so vanish. From every such mark on, the words are looked up in a tree of
the known licence sentences: the longest that ends at a mark gives its identifier. The identifiers of a
text, in order, are then matched against ordered rules, each a sequence of identifiers: a rule fits where
its sequence stands in consecutive known sentences. Rules are tried from the longest to the shortest, and
a sentence counts for one rule only. SPDX tags name their licences themselves, by identifiers of a list.

The tables below are fixed values: public licence texts and notices. In a sentence `(a|b)` is a choice,
`[a]` may be absent, `*` is one to twelve words of the licensor's, and `...` the rest of the sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K


@dataclass(frozen=True)
class Rule:
    licence: str
    sentences: tuple[str, ...]
    kind: str = "notice"


_THIS = "[(this|the) (work|software|project|program|file|library|code|document|text|package) is] "
_UNDER = _THIS + "[(released|licensed|distributed|available|published|provided)] under "
_CHANGE = "you can redistribute it and or modify it under the terms [and conditions] of the "
SENTENCES = {
    "by-mit": "[" + _UNDER + "] [the] mit license",
    "by-apache-2": "[" + _UNDER + "] [the] apache license [version] 2 0 [the license]",
    "by-bsd-2": _UNDER + "[(a|the)] (bsd 2 clause|2 clause bsd|simplified bsd) license",
    "by-bsd-3": _UNDER + "[(a|the)] (bsd 3 clause|3 clause bsd|new bsd|modified bsd) license",
    "by-gpl-3": _UNDER + "[the] (gnu general public license|gnu gpl|gpl) (version 3|v3|v 3|3) [0] [or later]",
    "by-gpl-2": _UNDER + "[the] (gnu general public license|gnu gpl|gpl) (version 2|v2|v 2|2) [0] [or later]",
    "by-lgpl-3": _UNDER + "[the] (gnu lesser general public license|gnu lgpl|lgpl) (version 3|v3|v 3|3) [0] [or later]",
    "by-lgpl-2.1": _UNDER + "[the] (gnu lesser general public license|gnu lgpl|lgpl) (version 2 1|v2 1|2 1) [or later]",
    "by-agpl-3": _UNDER + "[the] (gnu affero general public license|gnu agpl|agpl) (version 3|v3|v 3|3) [0] [or later]",
    "by-mpl-2": _UNDER + "[the] (mozilla public license|mpl) [(version|v)] 2 0",
    "by-epl-2": _UNDER + "[the] (eclipse public license|epl) [(version|v)] 2 0",
    "by-epl-1": _UNDER + "[the] (eclipse public license|epl) [(version|v)] (1 0|v1 0)",
    "by-ofl-1.1": "[this font software is licensed under] [" + _UNDER + "] [the] sil open font license [(version|v)] 1 1",
    "by-artistic-2": _UNDER + "[the] artistic license [(version|v)] 2 0",
    "by-perl": "[this (program|library|module|package|distribution) is free software] [you can redistribute it and or modify it] under the same terms as [the] perl [5] [programming language system] [itself] ...",
    "by-wtfpl": "[" + _UNDER + "] [the] (do what the fuck you want to public license|wtfpl) [(version|v) 2] ...",
    "by-cddl": "[the contents of this file are] [subject to] [(use|used|released|licensed|distributed|available) under] the [terms of the] common development and distribution license ...",
    "by-isc": _UNDER + "[the] isc license",
    "by-zlib": _UNDER + "[the] zlib license",
    "by-bsl-1": _UNDER + "[the] boost software license [version 1 0]",
    "by-unlicense": _UNDER + "[the] unlicense",
    "by-cc0": _UNDER + "[(a|the)] (cc0|cc0 1 0|creative commons zero|cc0 1 0 universal) [(license|public domain dedication)]",
    "by-cc-by-4": _UNDER + "[(a|the)] (cc by 4 0|creative commons attribution 4 0) [international] [(license|licence)]",
    "by-cc-by-sa-4": _UNDER + "[(a|the)] (cc by sa 4 0|creative commons attribution sharealike 4 0) [international] [(license|licence)]",
    "by-cc-by-nc-4": _UNDER + "[(a|the)] (cc by nc 4 0|creative commons attribution noncommercial 4 0) [international] [(license|licence)]",
    "by-cc-by-nd-4": _UNDER + "[(a|the)] (cc by nd 4 0|creative commons attribution noderivatives 4 0) [international] [(license|licence)]",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software ...",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "(the|this) software is provided as is ...",
    "as-is-by": "this software is provided by * as is ...",
    "no-liability": "in no event shall * be liable for any ...",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted ...",
    "isc-disclaim": "the software is provided as is and the author disclaims all warranties with regard to this software ...",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted ...",
    "bsd-source": "redistributions of source code must retain the above copyright notice ...",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice ...",
    "bsd-name": "neither the name of * may be used to endorse or promote products derived from this software ...",
    "bsd-ads": "all advertising materials mentioning features or use of this software must display the following acknowledgement ...",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis ...",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl-free": "this (program|software|library|file) is free software",
    "gpl-whole": "this (program|software|library|file) is free software " + _CHANGE + "gnu general public license ...",
    "gpl-change": _CHANGE + "gnu general public license ...",
    "gpl-only-2": _CHANGE + "gnu general public license [(version|v)] 2 as published by the free software foundation ...",
    "gpl-only-3": _CHANGE + "gnu general public license [(version|v)] 3 as published by the free software foundation ...",
    "lgpl-change": _CHANGE + "gnu (lesser|library) general public license ...",
    "agpl-change": _CHANGE + "gnu affero general public license ...",
    "either-2": "either version 2 of the license ...",
    "either-2.1": "either version 2 1 of the license ...",
    "either-3": "either version 3 of the license ...",
    "gpl-change-2": _CHANGE + "gnu general public license as published by the free software foundation either version 2 of the license ...",
    "gpl-change-3": _CHANGE + "gnu general public license as published by the free software foundation either version 3 of the license ...",
    "lgpl-change-2.1": _CHANGE + "gnu lesser general public license as published by the free software foundation either version 2 1 of the license ...",
    "lgpl-change-3": _CHANGE + "gnu lesser general public license as published by the free software foundation either version 3 of the license ...",
    "agpl-change-3": _CHANGE + "gnu affero general public license as published by the free software foundation either version 3 of the license ...",
    "gpl-hope": "this (program|software|library|file) is distributed in the hope that it will be useful but without any warranty",
    "gpl-implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu [(lesser|affero)] general public license for more details",
    "gpl-received": "you should have received a copy of the gnu [(lesser|affero)] general public license along with this (program|software|library|file) ...",
    "gpl-title-2": "gnu general public license version 2 june 1991",
    "gpl-title-3": "gnu general public license version 3 29 june 2007",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license (v|v 2 0|version 2 0)",
    "mpl-obtain": "if a copy of the mpl was not distributed with this file you can obtain one at ...",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented",
    "zlib-altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "zlib-notice": "this notice may not be removed or altered from any source distribution",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software ...",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license ...",
}

_BSD = ("bsd-grant", "bsd-source", "bsd-binary")
#: What follows "is free software": with a comma the version is in the same sentence, with a semicolon in the next.
_GNU = (
    ("GPL-2.0", ("gpl-change-2",)), ("GPL-2.0", ("gpl-change", "either-2")), ("GPL-2.0", ("gpl-only-2",)), ("GPL-3.0", ("gpl-change-3",)), ("GPL-3.0", ("gpl-change", "either-3")), ("GPL-3.0", ("gpl-only-3",)),
    ("LGPL-2.1", ("lgpl-change-2.1",)), ("LGPL-2.1", ("lgpl-change", "either-2.1")), ("LGPL-2.0", ("lgpl-change", "either-2")), ("LGPL-3.0", ("lgpl-change-3",)), ("LGPL-3.0", ("lgpl-change", "either-3")),
    ("AGPL-3.0", ("agpl-change-3",)), ("AGPL-3.0", ("agpl-change", "either-3")), ("GPL", ("gpl-change",)), ("LGPL", ("lgpl-change",)), ("AGPL", ("agpl-change",)),
)
RULES = (
    Rule("MIT", ("mit-grant", "mit-keep", "as-is", "no-liability"), "text"),
    Rule("MIT", ("mit-grant", "mit-keep", "as-is"), "text"),
    Rule("BSD-4-Clause", (*_BSD, "bsd-ads", "bsd-name", "as-is-by"), "text"),
    *[Rule("BSD-3-Clause", (*_BSD, "bsd-name", end, *more), "text") for end in ("as-is", "as-is-by") for more in (("no-liability",), ())],
    *[Rule("BSD-2-Clause", (*_BSD, end, *more), "text") for end in ("as-is", "as-is-by") for more in (("no-liability",), ())],
    Rule("ISC", ("isc-grant", "isc-disclaim", "no-liability"), "text"),
    Rule("ISC", ("isc-grant", "isc-disclaim"), "text"),
    Rule("Apache-2.0", ("by-apache-2", "apache-use", "apache-copy", "apache-unless", "apache-see"), "header"),
    Rule("Apache-2.0", ("by-apache-2", "apache-use", "apache-copy"), "header"),
    *[Rule(name, ("gpl-free", *change, *more), kind) for name, change in _GNU for kind, more in (
        ("header", ("gpl-hope", "gpl-implied", "gpl-details", "gpl-received")), ("header", ("gpl-hope", "gpl-implied", "gpl-details")), ("header", ("gpl-hope",)), ("part", ()))],
    Rule("GPL", ("gpl-whole", "gpl-hope"), "header"),
    Rule("GPL", ("gpl-whole",), "part"),
    Rule("GPL-2.0", ("gpl-title-2",), "text"),
    Rule("GPL-3.0", ("gpl-title-3",), "text"),
    Rule("MPL-2.0", ("mpl-subject", "mpl-obtain"), "header"),
    Rule("MPL-2.0", ("mpl-subject",), "part"),
    Rule("Zlib", ("zlib-as-is", "zlib-liability", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice"), "text"),
    Rule("Unlicense", ("unlicense-free", "unlicense-anyone"), "text"),
    Rule("Unlicense", ("unlicense-free",), "part"),
    Rule("BSL-1.0", ("bsl-grant", "as-is"), "text"),
    Rule("BSL-1.0", ("bsl-grant",), "part"),
    Rule("MIT", ("mit-grant",), "part"),
    *[Rule(licence, (name,)) for name, licence in (
        ("by-mit", "MIT"), ("by-apache-2", "Apache-2.0"), ("by-bsd-2", "BSD-2-Clause"), ("by-bsd-3", "BSD-3-Clause"), ("by-gpl-3", "GPL-3.0"), ("by-gpl-2", "GPL-2.0"),
        ("by-lgpl-3", "LGPL-3.0"), ("by-lgpl-2.1", "LGPL-2.1"), ("by-agpl-3", "AGPL-3.0"), ("by-mpl-2", "MPL-2.0"), ("by-epl-2", "EPL-2.0"), ("by-epl-1", "EPL-1.0"), ("by-ofl-1.1", "OFL-1.1"), ("by-artistic-2", "Artistic-2.0"), ("by-perl", "Artistic-1.0-Perl"), ("by-wtfpl", "WTFPL"), ("by-cddl", "CDDL-1.0"), ("by-isc", "ISC"), ("by-zlib", "Zlib"),
        ("by-bsl-1", "BSL-1.0"), ("by-unlicense", "Unlicense"), ("by-cc0", "CC0-1.0"), ("by-cc-by-4", "CC-BY-4.0"), ("by-cc-by-sa-4", "CC-BY-SA-4.0"), ("by-cc-by-nc-4", "CC-BY-NC-4.0"),
        ("by-cc-by-nd-4", "CC-BY-ND-4.0"))],
)

_TOKEN = re.compile(r"(?P<word>[^\W_]+)|[.!?;:](?=\s|\Z)|(?P<line>\n)")
_WORD = re.compile(r"[^\W_]+")
_SPDX = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]+)", re.I)
_SPDX_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*")
#: An exception to a licence, which is none itself.
_EXCEPTION = re.compile(r"\bwith[ \t]+[A-Za-z0-9.+-]+", re.I)
# Identifiers of licences that an SPDX tag may name, whatever the case and with `+`, `-only` or
# `-or-later` after them. Other words of a tag name none.
SPDX = """
0BSD AFL-3.0 AGPL-1.0 AGPL-3.0 Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-1.0-Perl Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause
BSD-3-Clause-Clear BSD-4-Clause BSD-4-Clause-UC BSL-1.0 bzip2-1.0.6 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1
CECILL-2.1 CPL-1.0 curl ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FSFAP FTL GFDL-1.1 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 HPND ICU IJG ISC JSON LGPL-2.0 LGPL-2.1 LGPL-3.0 Libpng libtiff LPPL-1.3c
MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA NTP ODbL-1.0 OFL-1.0 OFL-1.1 OLDAP-2.8 OpenSSL OSL-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SSPL-1.0 TCL Unicode-3.0 Unicode-DFS-2016
Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1
""".split()
_KNOWN = frozenset(x.upper() for x in SPDX)
#: Marks among the words: a sentence ends; a line ends.
STOP, LINE = "|", "~"
#: Words that a licensor's name may have.
SLOT = 12


def is_spdx(name: str) -> bool:
    return re.sub(r"(\+|-ONLY|-OR-LATER)$", "", name.upper()) in _KNOWN or name.upper().startswith("LICENSEREF-")


def tree_of(sentence: str) -> list:
    """A sentence pattern as a list of words, `*`, `...`, and lists of choices (each a list)."""
    tokens, at = re.findall(r"\.\.\.|[^\W_]+|[*()\[\]|]", sentence), 0

    def sequence() -> list:
        nonlocal at
        out: list = []
        while at < len(tokens) and tokens[at] not in ("|", ")", "]"):
            token = tokens[at]
            at += 1
            if token in "([":
                choices = [sequence()]
                while tokens[at] == "|":
                    at += 1
                    choices.append(sequence())
                at += 1
                out.append([*choices, []] if token == "[" else choices)
            else:
                out.append(token)
        return out

    return sequence()


def spelled_out(sentence: str) -> Iterator[tuple[str, ...]]:
    """Every sequence of words (and `*`, `...`) that a sentence pattern stands for."""

    def each(parts: list) -> Iterator[tuple[str, ...]]:
        options = [[x for choice in p for x in each(choice)] if isinstance(p, list) else [(p,)] for p in parts]
        for picked in product(*options):
            yield tuple(w for own in picked for w in own)

    return each(tree_of(sentence))


def states_of(parts: list, after: list[dict]) -> list[dict]:
    """The states in which a sentence pattern can begin, if `after` are those that follow it. A state has
    the states that come after each word; under "" the name of a sentence that ends in it."""
    for part in reversed(parts):
        after = [state for choice in part for state in states_of(choice, after)] if isinstance(part, list) else [{part: after}]
    return after


def hints_of(parts: list) -> list[tuple[str, ...]]:
    """Runs of words of which every sentence of a pattern holds one: a word of six letters or more that all
    of them have, or else one run for each choice."""
    runs, own = [], []
    for part in [*parts, "*"]:
        if isinstance(part, list) or part in ("*", "..."):
            runs += [own] if own else []
            own = []
        else:
            own.append(part)
    word = max((w for run in runs for w in run), key=len, default="")
    if len(word) >= 6:
        return [(word,)]
    choices = [part for part in parts if isinstance(part, list) and all(part)]
    if choices:
        return [hint for choice in max(choices, key=lambda c: min(sum(map(len, filter(lambda w: isinstance(w, str), x))) for x in c)) for hint in hints_of(choice)]
    return [tuple(max(runs, key=lambda r: sum(map(len, r))))]


class Recogniser:
    def __init__(self, sentences: dict[str, str] = SENTENCES, rules: tuple[Rule, ...] = RULES) -> None:
        self.begin: dict[str, list[dict]] = {}
        hints = {("spdx", "license")}
        for name, pattern in sentences.items():
            parts = tree_of(pattern)
            for state in states_of(parts, [{"": name}]):
                for word, after in state.items():
                    self.begin.setdefault(word, []).extend(after)
            hints.update(hints_of(parts))
        #: Of every known sentence a text holds the word, and if there is a pattern, that too.
        self.hints = [(max(h, key=len), re.compile(r"(?<![^\W_])" + r"[\W_]+".join(h) + r"(?![^\W_])") if len(h) > 1 else None) for h in sorted(hints)]
        self.rules = sorted(rules, key=lambda r: -len(r.sentences))

    def hinted(self, text: str) -> bool:
        low = text.lower()
        return any(word in low and (pattern is None or pattern.search(low)) for word, pattern in self.hints)

    def _match(self, words: list[str], i: int) -> tuple[int, str] | None:
        """Where the known sentence that begins with word i ends, and its name: that of most words of its
        own, which ends at a mark; of several the first known."""
        best: tuple[int, int, str] | None = None
        todo = [(state, i + 1, 1) for state in reversed(self.begin.get(words[i], ()))]
        while todo:
            state, at, own = todo.pop()
            marked = at >= len(words) or words[at] in (STOP, LINE)
            if marked and "" in state and (best is None or own > best[0]):
                best = (own, at, state[""])
            while at < len(words) and words[at] == LINE:
                at += 1
            if "..." in state and (best is None or own > best[0]):
                upto = at
                while upto < len(words) and words[upto] != STOP:
                    upto += 1
                best = (own, upto, state["..."][0][""])
            if at >= len(words) or words[at] == STOP:
                continue
            todo += [(after, at + 1, own + 1) for after in reversed(state.get(words[at], ()))]
            if "*" in state:
                n = 0
                while n < SLOT and at < len(words) and words[at] != STOP:
                    if words[at] != LINE:
                        n += 1
                        todo += [(after, at + 1, own) for after in state["*"]]
                    at += 1
        return best[1:] if best else None

    def __call__(self, text: str | None) -> tuple[list[str], list[tuple[str, str, int, int]]]:
        """Identifiers of the known sentences, and (licence, kind, start, end) of the rules that fit;
        positions are code points, end exclusive."""
        if not text or not self.hinted(text):
            return [], []
        words, places = [STOP], [(0, 0)]
        for m in _TOKEN.finditer(text):
            if m["word"]:
                words.append(m[0].lower())
                places.append(m.span())
            elif m["line"] and words[-1] == LINE:
                words[-1] = STOP  # an empty line
            elif words[-1] != STOP:
                words.append(LINE if m["line"] else STOP)
                places.append(m.span())
        found, i = [], 0
        while i < len(words):
            if words[i] not in (STOP, LINE) and words[i - 1] in (STOP, LINE) and (hit := self._match(words, i)):
                last = hit[0] - 1
                while words[last] in (STOP, LINE):
                    last -= 1
                found.append((hit[1], places[i][0], places[last][1]))
                i = hit[0]
            else:
                i += 1
        taken, out = np.zeros(len(found), bool), []
        for rule in self.rules:
            n = len(rule.sentences)
            for i in range(len(found) - n + 1):
                if not taken[i : i + n].any() and tuple(x[0] for x in found[i : i + n]) == rule.sentences:
                    taken[i : i + n] = True
                    out.append((rule.licence, rule.kind, found[i][1], found[i + n - 1][2]))
        for m in _SPDX.finditer(text):
            tag = _EXCEPTION.sub(lambda x: " " * len(x[0]), m[1])
            for part in _SPDX_ID.finditer(tag):
                name, at = part.group().rstrip("."), m.start(1) + part.start()
                if is_spdx(name):
                    out.append((name, "spdx", at, at + len(name)))
        return [x[0] for x in found], sorted(out, key=lambda m: (m[2], m[0]))


FOUND = "sentences array<string>, matches array<struct<licence:string,kind:string,start:int,end:int>>"


def find_licences(docs: DataFrame, key: str = "doc_id", text: str = "text", sentences: dict[str, str] = SENTENCES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, sentences, matches) per row: known sentences in order, and where licence rules fit.

    Null and empty texts have neither. Repeated rows repeat theirs; a null key passes through. Equal
    rules at one place are found once. Other columns are not read.
    """
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL(FOUND).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recognise = K.held(("licenses", tuple(sentences.items()), rules), lambda: Recogniser(sentences, rules))
        kind = pa.struct([("licence", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in K.portions(batches, text):
            found = [recognise(x) for x in K.column(batch, text).to_pylist()]
            matches = [[dict(zip(("licence", "kind", "start", "end"), m, strict=True)) for m in own] for _, own in found]
            yield pa.RecordBatch.from_arrays([K.column(batch, key), pa.array([s for s, _ in found], pa.list_(pa.string())), pa.array(matches, pa.list_(kind))], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def summarised(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_sentences, n_matches, licences): licences are the distinct names, sorted, comma-joined."""
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"]))), ",")
    return found.select(key, F.size("sentences").cast("long").alias("n_sentences"), F.size("matches").cast("long").alias("n_matches"), names.alias("licences"))
