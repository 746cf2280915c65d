from __future__ import annotations

import numpy as np
import xxhash
import pytest

from repolens.llm import simhash as S
from repolens.llm.components import connected_components


def fingerprint(text):
    own = (text or "").encode().lower().split()
    shingles = [b" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))] if own else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def chained(rng, n, flips):
    out = set()
    while len(out) < n:
        x = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        for _ in range(12):
            out.add(x)
            for _ in range(int(rng.integers(1, flips))):
                x ^= 1 << int(rng.integers(0, 64))
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_bit_sliced_links_equal_all_pairs(radius):
    fps = chained(np.random.default_rng(radius), 300, radius + 2)
    sizes = np.array([1, 130, len(fps) - 131])
    u, v = S.stars(fps, sizes, radius)
    link = dict(zip(u.view(np.uint64).tolist(), v.view(np.uint64).tolist(), strict=True))
    begin = 0
    for size in sizes:
        own = fps[begin : begin + size]
        assert [link.get(int(x), int(x)) for x in own] == [int(own[r]) for r in groups(own, radius)]
        begin += size


def test_tiles_lose_no_link(spark):
    fps = chained(np.random.default_rng(9), 250, 4)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    hot = df.unionByName(spark.createDataFrame([(i << 8,) for i in range(1, 200)], "fp long")).distinct()
    every = np.array([r[0] for r in hot.collect()], np.int64)
    want = groups(np.sort(every.view(np.uint64)), 2)
    for tile in (16, 4096):
        roots = {r["node"]: r["root"] for r in connected_components(S.near_stars(hot, 2, tile=tile)).collect()}
        got = {}
        for x, w in zip(np.sort(every.view(np.uint64)), want, strict=True):
            got.setdefault(w, set()).add(roots.get(int(np.int64(x.view(np.int64) if hasattr(x, "view") else x)), int(x.view(np.int64))))
        assert all(len(r) == 1 for r in got.values()) and len({next(iter(r)) for r in got.values()}) == len(got)


def test_messy_rows(spark, messy, nothing):
    got = S.near_duplicates(messy).collect()
    assert len(got) == messy.count()
    by = {r["doc_id"]: r for r in got}
    texts = {r["doc_id"]: r["text"] for r in messy.collect()}
    assert all(int(r["fingerprint"], 16) == fingerprint(texts[r["doc_id"]]) for r in got)
    assert by[2]["fingerprint"] == "0" * 16 and by[2]["component_id"] == by[3]["component_id"] == by[4]["component_id"] == 2
    assert by[7]["component_id"] == 1 and by[5]["component_id"] == 5 and by[None]["component_id"] is None
    assert S.near_duplicates(nothing).count() == 0
    kept = S.one_of_each(messy).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 2, 5, 8, 9]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100 and len(got) == 63
    assert connected_components(edges.where("u = -1")).count() == 0
