from __future__ import annotations

import pytest

#: Names that the operators use inside.
CLASHES = ["fp", "key", "sign", "ids", "blob", "found", "doc", "bucket", "payload", "at", "n", "host", "label", "text_", "items", "component_id", "fingerprint", "score", "kept"]

LONG = "word " * 30_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf today", "en"),
    (2, None, None),
    (3, "", "en"),
    (4, " \t\n ", None),
    (5, LONG, "en"),
    (5, LONG, "en"),
    (None, "a row without a key", "en"),
    (7, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf today", None),
    (8, "1234 5678 !!", "de"),
    (9, "päß ñandú 漢字 😀 \u00a0 x", "de"),
]


@pytest.fixture(scope="session")
def messy(spark):
    extra = ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, "src", 1, *[c for c in CLASHES]) for r in ROWS], f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.where("doc_id = -1")
