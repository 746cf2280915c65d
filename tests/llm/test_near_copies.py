from __future__ import annotations

import random
from collections import Counter

import numpy as np

from repolens.llm import near_copies as N


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(rows):
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {i: shingles(t) for i, t in rows}
    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_groups_of_planted_copies(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for base in range(25):
        words = [rng.choice(vocab) for _ in range(rng.randint(60, 300))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(6):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(own) // 60))):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(own).title()))
    got = {r[0]: r[1] for r in N.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = plain(rows)
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(rows) and len(set(want.values())) < 60
    assert all(want[got[i]] == want[i] for i in want)  # no unrelated texts together


def test_the_sieve_lets_every_shared_shingle_pass(spark):
    rng = np.random.default_rng(0)
    some = rng.integers(-(2**63), 2**63 - 1, 400)
    rows = [(i, 20, rng.choice(some, 12, replace=False).tolist() + rng.integers(-(2**63), 2**63 - 1, 8).tolist()) for i in range(90)]
    tops = spark.createDataFrame(rows, "copy long, size int, prefix array<long>").repartition(5)
    want = {}
    for copy, _, prefix in rows:
        for pos, s in enumerate(prefix):
            want.setdefault(s, set()).add((copy, pos))
    want = {(s, *x) for s, held in want.items() if len(held) > 1 for x in held}
    for size in (100, 1 << 34):
        passed = N.entries(tops, N.sieve(tops, size))
        got = {(r["s"], r["copy"], r["pos"]) for r in passed.collect()}
        assert got >= want and len(got) < len(want) + 10
        assert {(r["s"], r["copy"], r["pos"]) for r in N.met(passed).collect()} == want


def test_messy_rows(spark, messy, nothing):
    got = {r[0]: r[1] for r in N.near_copy_groups(messy).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, None: None, 7: 1, 8: 8, 9: 9}
    assert N.near_copy_groups(messy).count() == messy.count() and N.near_copy_groups(nothing).count() == 0
    assert sorted(r["doc_id"] or 0 for r in N.one_of_each(messy).collect()) == [0, 1, 2, 3, 4, 5, 8, 9]


def test_null_and_repeated_keys(spark):
    text = " ".join(f"word{i}" for i in range(60))
    near = text + " more"
    rows = [(None, text), (7, text), (3, near), (9, "another text"), (9, text), (None, None), (5, None), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r[0] or 0, r[1] or 0) for r in N.near_copy_groups(df).collect())
    assert got == [(0, 0), (0, 0), (3, 3), (5, 5), (6, 5), (7, 3), (9, 3), (9, 9)]
    assert sorted(r["doc_id"] or 0 for r in N.one_of_each(df).collect()) == [0, 0, 3, 5, 9]


def edited(rng, words, kind):
    n, own = len(words), list(words)
    if kind == "appended":
        return own + [rng.choice(words) + "x" for _ in range(n // 5)]
    if kind == "truncated":
        return own[: n - n // 6]
    if kind == "inserted":
        return own[: n // 2] + [w + "y" for w in own[: n // 6]] + own[n // 2 :]
    return own[: n // 2] + [w + "z" for w in own[n // 2 : n // 2 + n // 12]] + own[n // 2 + n // 12 :]


def test_every_kind_of_edit_is_found(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    rows, pairs = [], {}
    for kind in ("appended", "truncated", "inserted", "replaced"):
        for _ in range(30):
            words = [rng.choice(vocab) for _ in range(rng.choice([30, 100, 200, 600]))]
            pairs[len(rows)] = kind
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(edited(rng, words, kind)))]
    got = {r[0]: r[1] for r in N.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = plain(rows)
    near = {kind: [want[i] == want[i + 1] for i, k in pairs.items() if k == kind] for kind in pairs.values()}
    assert all(sum(found) >= 15 for found in near.values())
    assert got == want


def test_families_close_in_words_are_tested_whole(spark):
    """Many orders of the same passages: all prints are near, the hub's order is near to few."""
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(500)]
    words = [rng.choice(vocab) for _ in range(120)]
    rows = []
    for _ in range(40):
        own = rng.sample(words, len(words))
        rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join(own[:-4] + own[-4:][::-1]))]
    got = {r[0]: r[1] for r in N.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = plain(rows)
    assert len(set(want.values())) == 40 and got == want


def by_counting(rows):
    """The same groups as `plain`, by counting the shingles that two texts share."""
    sets, held, root = {i: shingles(t) for i, t in rows}, {}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, own in sets.items():
        common = Counter(j for s in own for j in held.get(s, ()))
        for j, n in common.items():
            if n >= 0.8 * (len(own) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for s in own:
            held.setdefault(s, []).append(i)
    return {i: find(i) for i in sets}


def test_groups_of_the_given_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = {r[0]: r[1] for r in N.near_copy_groups(docs.repartition(4)).collect()}
    assert got == by_counting(rows) and len(set(got.values())) < len(got)


def test_groups_of_a_skewed_table_equal_brute_force(spark):
    """A third of the rows are near copies of one text, a third hold one passage, some are copies."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(2000)]
    draw = lambda n: [rng.choice(vocab) for _ in range(n)]
    family, passage, rows = draw(150), draw(60), []
    for i in range(600):
        if i % 3 == 0:
            own = list(family)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
        elif i % 3 == 1:
            own = draw(rng.randint(3, 40)) + passage + draw(rng.randint(0, 20))
        else:
            own = rows[rng.randrange(len(rows))][1].split() if rng.random() < 0.3 else draw(rng.randint(1, 200))
        rows.append((i, " ".join(own)))
    got = {r[0]: r[1] for r in N.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    want = by_counting(rows)
    assert got == want and Counter(want.values()).most_common(1)[0][1] > 100


def test_pairs_of_a_large_family_grow_with_its_texts(spark, monkeypatch):
    """Copies with a few edits each, half of them too far from most others: groups are whole, and few pairs are verified."""
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(2000)]
    family = [rng.choice(vocab) for _ in range(140)]
    rows = []
    for i in range(500):
        own = list(family)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = f"own{rng.randrange(10**9)}"
        rows.append((i, " ".join(own)))
    counts, verified = [], N.verified
    monkeypatch.setattr(N, "verified", lambda pairs, *rest: counts.append(pairs.count()) or verified(pairs, *rest))
    got = {r[0]: r[1] for r in N.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = by_counting(rows)
    assert got == want and Counter(want.values()).most_common(1)[0][1] > 300
    assert sum(counts) < 20 * len(rows), counts
