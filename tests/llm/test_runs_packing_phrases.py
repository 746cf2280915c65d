"""Periodic runs, packing and phrases against brute force over given, random and messy tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from repolens.llm import collocations, packing, periodic, queries

JSON = public_tokenizers.path("byte_bpe_50k.json")


# periodic runs


def slow_runs(words, least=6, times=4):
    found, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            smaller = any(q % p == 0 and stretch[p:] == stretch[:-p] for p in range(1, q))
            if len(stretch) >= max(least, times * q) and not smaller:
                found.append((i, len(stretch), q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def planted(doc_id, text):
    words = split(text)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_of_random_words_equal_brute_force(letters):
    rng = np.random.default_rng(letters)
    texts = []
    for _ in range(300):
        words = rng.integers(0, letters, rng.integers(0, 60)).tolist()
        for _ in range(rng.integers(0, 3)):  # a stretch that repeats, cut anywhere
            period = rng.integers(0, letters, rng.integers(1, 14)).tolist()
            at, n = rng.integers(0, len(words) + 1), rng.integers(1, 90)
            words[at:at] = (period * n)[:n]
        texts.append(words)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    start, length, q = periodic.runs_of(np.array([w for t in texts for w in t], np.int64), first)
    own = np.searchsorted(first, start, side="right") - 1
    for i, words in enumerate(texts):
        mine = own == i
        assert list(zip((start[mine] - first[i]).tolist(), length[mine].tolist(), q[mine].tolist())) == slow_runs(words)


def test_wavelet_tree_finds_neighbours():
    rng = np.random.default_rng(5)
    values = rng.permutation(1000)
    tree = periodic.WaveletTree(values, 10)
    lo = rng.integers(0, 1000, 500)
    hi = np.minimum(lo + rng.integers(1, 400, 500), 1000)
    x = np.array([rng.choice(values[a:b]) for a, b in zip(lo, hi)])
    under, over = tree.neighbours(lo, hi, x)
    for a, b, v, u, o in zip(lo, hi, x, under, over):
        part = values[a:b]
        assert u == max(part[part < v], default=-1) and o == min(part[part > v], default=-1)


def test_op11_equals_brute_force(spark, sf):
    rows = {r.doc_id: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        words = planted(doc.doc_id, doc.text)
        if len(words) > 3000:
            continue
        runs, row = slow_runs(words), rows[doc.doc_id]
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()


def test_runs_of_messy_rows(messy, nothing):
    rows = periodic.find_runs(messy).collect()
    assert len(rows) == messy.count() and periodic.find_runs(nothing).count() == 0
    by_key = {r.doc_id: r for r in rows}
    assert by_key[2].runs == [] and by_key[2].kept == "" and by_key[4].n_words == 0
    assert [tuple(r) for r in by_key[5].runs] == [(0, 30_000, 1)] and by_key[5].kept == "word"
    assert by_key[None].kept == "a row without a key" and by_key[9].kept == "päß ñandú 漢字 😀   x"
    with pytest.raises(ValueError):
        periodic.find_runs(messy, least_periods=3)


def test_runs_of_one_very_long_text(spark):
    rng = np.random.default_rng(3)
    words = rng.integers(0, 50, 300_000)
    words[1000:150_000] = np.tile(words[1000:1000 + 37_000], 5)[:149_000]
    words[200_000:299_000] = np.tile(words[200_000:200_003], 33_000)
    text = " ".join(map(str, words))
    row = periodic.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    # neighbours may extend a run by chance, by a word or two
    assert any(r.period == 37_000 and r.length >= 149_000 and r.start <= 1000 for r in row.runs)
    assert any(r.period == 3 and r.length >= 99_000 and r.start <= 200_000 for r in row.runs)


# packing


def check_packing(rows, docs, capacity=1024, end=2):
    tokenizer = Tokenizer.from_file(JSON)
    ids = {k: [*x.ids, end] for k, x in zip(docs, tokenizer.encode_batch([t or "" for t in docs.values()], add_special_tokens=False))}
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for key, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(ids[key]) // capacity)))
        assert all(r.length == capacity for r in parts[1:])
        at = 0
        for r in parts:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[key][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[key])
    for parts in by_bin.values():
        parts.sort(key=lambda r: r.offset)
        upto = np.cumsum([r.length for r in parts])
        assert [r.offset for r in parts] == [0, *upto[:-1].tolist()] and upto[-1] <= capacity
    return len(by_bin), -(-sum(map(len, ids.values())) // capacity)


def test_op12_is_a_packing_near_the_lower_bound(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    used, least = check_packing(queries.op12_packing(spark, sf).collect(), docs)
    assert least <= used <= 1.02 * least + 1


def test_packed_sequences_hold_the_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    packed = packing.pack(docs, JSON, capacity=256, with_ids=True)
    rows = packing.sequences(packed).collect()
    assert all(len(r.ids) == sum(r.lengths) <= 256 for r in rows)
    tokenizer = Tokenizer.from_file(JSON)
    every = Counter(i for r in rows for i in r.ids)
    assert every == Counter(i for d in docs.collect() for i in [*tokenizer.encode(d.text, add_special_tokens=False).ids, 2])


def test_packing_of_messy_rows(messy, nothing):
    rows = packing.pack(messy, JSON).collect()
    assert packing.pack(nothing, JSON).count() == 0
    assert sorted(r.length for r in rows if r.doc_id == 2) == [1] == sorted(r.length for r in rows if r.doc_id == 3)
    assert sum(r.length for r in rows if r.doc_id is None) > 1
    long = [r for r in rows if r.doc_id == 5]
    assert len({(r.piece, r.sequence_id, r.offset) for r in long}) == len(long)  # repeated rows are packed twice
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_and_few_bins(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 65, [0, 5, 40, 400, 4_000, 40_000][seed])
    counts = np.bincount(sizes, minlength=65).tolist()
    bins = packing.plan(counts, 64)
    used = Counter()
    for n, taken in bins:
        assert sum(size * k for size, k in taken.items()) <= 64
        used.update({size: n * k for size, k in taken.items()})
    assert dict(used) == {size: n for size, n in enumerate(counts) if n}
    first_fit = []
    for size in sorted(sizes.tolist(), reverse=True):
        i = next((i for i, x in enumerate(first_fit[-2000:], max(0, len(first_fit) - 2000)) if x + size <= 64), None)
        if i is None:
            first_fit.append(size)
        else:
            first_fit[i] += size
    assert sum(n for n, _ in bins) <= len(first_fit)
    assert len(bins) <= 64 * 7  # steps depend on the capacity, not on the pieces


def test_fullest_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        counts = [0, *rng.integers(0, 3, 12).tolist()]
        room = int(rng.integers(0, 25))
        best = {0}
        for size, n in enumerate(counts):
            for _ in range(n):
                best |= {x + size for x in best if x + size <= room}
        taken = packing.fullest(counts, [i for i in range(12, 0, -1) if counts[i]], room)
        assert sum(size * n for size, n in taken.items()) == max(best)
        assert all(n <= counts[size] for size, n in taken.items())


# phrases


def slow_phrases(rows, least, words=5):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            own = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(own)
            f.update((lang, tuple(own[i : i + m])) for m in range(1, words + 1) for i in range(len(own) - m + 1))
    often = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    gone = {(lang, p[i:j]) for (lang, p), a in often.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= f[lang, p[i:j]]}
    out = []
    for (lang, p), a in often.items():
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        if (lang, p) not in gone:
            out.append((lang, " ".join(p), a, left, right, n[lang], score))
    return sorted(out)


@pytest.mark.parametrize("run", [1 << 20, 500])
def test_phrases_equal_brute_force(spark, sf, run, monkeypatch):
    monkeypatch.setattr(collocations, "RUN", run)  # summaries are cut when it is small
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
    found = collocations.collocations(docs, least=20, most=None)
    slow = slow_phrases([(r.lang, r.text) for r in docs.collect()], 20)
    assert sorted(map(tuple, found.collect())) == slow and len(slow) > 100


def test_op13_equals_its_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = queries.op13_collocations(spark, sf)
    rows = duckdb.sql(queries.oracle_sql()["op13_collocations"]).fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(rows)


def test_summary_keeps_what_is_frequent():
    rng = np.random.default_rng(2)
    stream = rng.zipf(1.3, 20_000) % 3_000
    summary, least = collocations.Summary(20_000 // 200 + 1), 200
    for part in np.array_split(stream, 23):
        h, n = np.unique(part, return_counts=True)
        summary.merge([h.astype(np.uint64)], [n.astype(np.int64)])
    assert len(summary.h) <= summary.capacity and summary.off < least
    kept = dict(zip(summary.h.tolist(), summary.n.tolist()))
    for value, n in Counter(stream.tolist()).items():
        if n >= least:
            assert n - summary.off <= kept[value] <= n


def test_products_beyond_64_bits(spark):
    big = 4 * 10**12
    rows = [("x", 0, "", 10**14), ("x", 1, "a", big), ("x", 1, "b", big), ("x", 2, "a b", big - 1)]
    row = collocations.scored(spark.createDataFrame(rows, "lang string, words int, phrase string, f long")).first()
    assert row.score == 1000 * (big - 1) * 10**14 // (big * big)


def test_phrases_of_messy_rows(spark, messy, nothing):
    assert collocations.collocations(nothing).count() == 0
    found = collocations.collocations(messy, least=2, most=None)
    slow = slow_phrases([(r.lang, r.text) for r in messy.collect()], 2)
    assert sorted(map(tuple, found.collect())) == slow and slow
    # within a piece, by any number of spaces and tabs; overlaps count
    docs = spark.createDataFrame([(1, "A a\t a  a, a\na! b  c"), (2, "b\tC. c")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    assert {r.phrase: r.f for r in collocations.frequent_phrases(docs, least=1).collect()}["a a"] == 3


def test_ranks_are_the_same_in_shares(spark):
    rows = [("en", 2, f"w{i} x", i % 50 + 100, 100, 100, 10_000, i % 13) for i in range(3000)]
    phrases = spark.createDataFrame(rows, "lang string, words int, phrase string, a long, l long, r long, n long, score long")
    found = [r.phrase for r in collocations.first_of_each(phrases, 500).orderBy("rank").collect()]
    assert found == [r[2] for r in sorted(rows, key=lambda r: (-r[7], -r[3], r[2].encode()))][:500]
