from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from repolens.llm import kernels as K

TEXT = st.text(alphabet=st.sampled_from("ab é\n\t漢x"), max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=8))
def test_words_are_those_of_bytes_split(texts):
    data, offsets = K.texts(pa.array(texts, pa.string()))
    starts, ends, at = K.words(data, offsets)
    raw = data.tobytes()
    got = [[raw[a:b] for a, b in zip(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]])] for i in range(len(texts))]
    assert got == [(t or "").encode().split() for t in texts]


def test_texts_of_a_slice():
    values = pa.array(["aa", None, "b", "ccc"]).slice(1, 2)
    data, offsets = K.texts(values)
    assert data.tobytes() == b"b" and offsets.tolist() == [0, 0, 1]


def test_portions_keep_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 50, 1, 1, 0, 9)] + [None])], names=["t"])
    parts = list(K.portions(iter([batch]), "t", 10))
    assert sum((p.column(0).to_pylist() for p in parts), []) == batch.column(0).to_pylist()
    assert [len(p) for p in parts] == [1, 1, 4, 1] or all(len(p) for p in parts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=20), max_size=30))
def test_distinct_and_seen_spans(spans):
    data = np.frombuffer(b"".join(spans), np.uint8)
    at = K.bounds(np.array([len(s) for s in spans], np.int64))
    first, which = K.distinct_spans(data, at[:-1], at[1:])
    assert [spans[first[w]] for w in which] == spans
    seen = K.Seen(bits=6)
    assert (seen.find(data, at[:-1], at[1:]) == -1).all()
    if len(first) < 40:
        seen.add(data, at[:-1][first], at[1:][first])
        assert seen.find(data, at[:-1], at[1:]).tolist() == which.tolist()


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 100])
def test_hashes_depend_on_every_byte(n):
    a = np.zeros(n + 1, np.uint8)
    b = a.copy()
    b[n] = 1
    one = [K.hash_spans(x, np.array([0]), np.array([n + 1]))[0] for x in (a, b)]
    assert one[0] != one[1]
