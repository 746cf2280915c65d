from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from repolens.llm import ann, bpe, token_files, urls

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(RANKS).ids, special_tokens={})


# --- byte-level BPE ------------------------------------------------------------------------------

ODD = ["a" * 1001, "abab" * 300, "hello  world\n\n  x's  don't  y\u3000z é\u00a0é\x1c a 12345 \t\t", "  ", "\n \n", "", " a", "x    y", "\x85a \x85 b", "tab\tx \x0b y", "it's we'll 'sx  's", "<|endoftext|> z", "漢字 漢字", "😀😀 😀", "\u2028 x\u2028"]


def encoded(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])
    out = []
    for run, ids, at in bpe.encoded(bpe.memo(RANKS, P.PATTERN), iter([batch]), "t"):
        out += [ids[at[i] : at[i + 1]].tolist() for i in range(len(run))]
    return out


def test_odd_texts_encode_as_the_library(plain):
    assert encoded([*ODD, None]) == [plain.encode_ordinary(t) for t in ODD] + [[]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aeinrst THE é漢'.,!0123\n\t \u00a0\u3000\x1d\x85"), max_size=60), max_size=5))
def test_any_texts_encode_as_the_library(texts):
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(RANKS).ids, special_tokens={})
    assert encoded(texts) == [lib.encode_ordinary(t) for t in texts]


def test_both_forms_of_the_queue_agree(plain):
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 50, 257, 5000):
        text = "".join(rng.choice(list("abething"), n))
        table = bpe.ranks(RANKS)
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, made = table.merge_many(raw, np.array([0, n]))
        assert table.merge_long(text.encode()) == ids.tolist() == plain.encode_ordinary(text) and made.tolist() == [len(ids)]


def test_a_memo_that_begins_anew(plain):
    small = bpe.Memo(bpe.Encoder(RANKS, P.PATTERN), most=3)
    for text in ("one two three four five", "four five six", "one"):
        batch = pa.RecordBatch.from_arrays([pa.array([text])], names=["t"])
        ((_, ids, _),) = bpe.encoded(small, iter([batch]), "t")
        assert ids.tolist() == plain.encode_ordinary(text)


def test_rank_bits():
    bits = bpe.RankBits(50_000)
    for r in (49_999, 64, 4096, 63):
        bits.add(r)
    assert [bits.first(), bits.discard(63), bits.first(), bits.discard(64), bits.first(), bits.discard(4096), bits.first(), bits.discard(49_999), bits.first()] == [63, None, 64, None, 4096, None, 49_999, None, -1]


def test_round_trip_of_messy_rows(spark, messy, nothing, plain):
    got = bpe.round_trip(messy, RANKS, P.PATTERN, with_ids=True).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in messy.collect()}
    assert len(got) == messy.count()
    for r in got:
        text = texts[r["doc_id"]]
        ids = plain.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(nothing, RANKS, P.PATTERN).count() == 0
    coded = bpe.encode(messy, RANKS, P.PATTERN)
    back = {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.decode(coded, RANKS, text="decoded").collect()}
    assert back == texts and coded.columns[-1] == "ids" and "blob" in coded.columns


# --- token files ---------------------------------------------------------------------------------


def test_files_give_back_the_library_ids(spark, messy, nothing):
    library = Tokenizer.from_file(JSON)
    special = ["hello <|endoftext|> x", "<|endoftext|>", "a<|endoftext|>b  <|endoftext|>\n<|endoftext|><|endoftext|> ", "<|endoftext|>  two", "x  <|endof text|> <|endoftext |>", "\u3000<|endoftext|>\u3000é<|endoftext|>é"]
    rows = [(i, t) for i, t in enumerate(ODD + special)] + [(999, None)]
    assert 50256 in library.encode(special[0], add_special_tokens=False).ids
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    segments, lengths = token_files.write(df, JSON)
    got = {r["doc_id"]: tuple(r)[1:] for r in token_files.read(segments, lengths).collect()}
    start = 0
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        assert got[d] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)
    segments, lengths = token_files.write(messy, JSON)
    again = token_files.read(segments, lengths).collect()
    assert len(again) == messy.count() and sorted(r["start"] for r in again)[0] == 0
    assert [r for r in again if r["doc_id"] is None][0]["start"] == 0
    segments, lengths = token_files.write(nothing, JSON)
    assert token_files.read(segments, lengths).count() == 0


def test_segments_of_many_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.zipf(1.3, 20_001), 9_999).astype(np.int64)
    lengths = token_files.code_lengths(np.bincount(ids, minlength=10_000))
    code = token_files.Code(lengths)
    used = lengths[lengths > 0].astype(float)
    assert used.max() <= token_files.LIMIT and abs((2.0**-used).sum() - 1) < 1e-12
    for n in (1, 1023, 1024, 1025, 20_001):
        got, per_doc = code.read(code.write(ids[:n], np.array([n])))
        assert got.tolist() == ids[:n].tolist() and per_doc.tolist() == [n]


def test_code_lengths_are_best():
    counts = np.array([0, 5, 9, 12, 13, 16, 45, 0])
    assert token_files.code_lengths(counts, 20).tolist() == [0, 4, 4, 3, 3, 3, 1, 0]
    limited = token_files.code_lengths(np.array([1, 1, 2, 4, 8, 16, 32]), 3)
    assert limited.max() == 3 and sum(2.0 ** -limited.astype(float)) <= 1
    assert token_files.code_lengths(np.array([0, 7])).tolist() == [0, 1]
    fib = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    assert token_files.code_lengths(fib, 4).max() == 4


# --- URL rules -----------------------------------------------------------------------------------

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("a.b.example.com", "/", "block"), ("example.com", "/", "allow"), ("b.example.com", "", "block"), ("example.com", "/EN/", "block")]


def plain_verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else None
    return host, path, best[3] if best else None, best[4] if best else default


def test_urls_equal_plain_matching(spark):
    hosts = ["com", "example.com", "WWW.Example.com", "x.www.example.com", "a.b.example.com", "b.example.com", "notexample.com", "example.com.net", "foo.net", "", "example", "com.", ".com", "EXAMPLE.com:80"]
    paths = ["", "/", "/en/", "/en", "/EN/x", "/es/1?q=/fr/", "/fr/#a", "?x", "#y/en/", "/a\nb"]
    made = [f"{s}{h}{p}" for s in ("http://", "x://") for h in hosts for p in paths] + [None, "", "no-scheme", "mailto:x@example.com", "http://a.com/http://net/es/", "://com/"]
    rows = list(enumerate(made)) + [(None, "http://com/")]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, host string, rule string").repartition(5)
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("com", None, "block"), ("", "/", "block")], "host string, path string, verdict string")
    got = urls.match_rules(pages, rules).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_verdict(r["url"], RULES), r["url"]
    assert urls.match_rules(pages, rules.where("host = 'none'")).where("rule is not null or verdict <> 'allow'").count() == 0
    assert urls.match_rules(pages.where("page_id = -1"), rules).count() == 0


def test_rules_cross_ranges(spark):
    """Rules opened long before, and ranges that hold no rule."""
    pages = spark.createDataFrame([(i, f"http://h{i:03}.example.com/p") for i in range(300)], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/", "block"), ("h150.example.com", "/p", "allow"), ("zzz", "/", "block")], "host string, path string, verdict string")
    got = {r["page_id"]: r["rule"] for r in urls.match_rules(pages, rules).collect()}
    assert got == {i: "h150.example.com/p" if i == 150 else "com/" for i in range(300)}


def test_a_host_of_many_path_rules(spark):
    rng = random.Random(3)
    made = [("site.org", "/" + "/".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) + rng.choice(["", "/"]), rng.choice(["allow", "block"])) for _ in range(600)]
    rules = list({r[:2]: r for r in [*made, ("x.site.org", "/a", "block"), ("org", "/b/b", "block"), ("site.org", "", "allow")]}.values())
    urls_ = [f"http://{rng.choice(['', 'x.', 'y.x.'])}site.org/" + "/".join(rng.choice("abcd") for _ in range(rng.randint(0, 8))) for _ in range(500)] + ["http://org/b/bb", "http://other.org/a"]
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string").repartition(5)
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.match_rules(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {i: plain_verdict(u, rules)[2:] for i, u in enumerate(urls_)}


# --- nearest neighbours --------------------------------------------------------------------------


def exact(rows, k, every):
    ids = [i for i, v in rows]
    m = np.array([v for _, v in rows], np.float64)
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    out = {}
    for i, q in zip(ids, unit, strict=True):
        if i % every == 0:
            score = unit @ q
            order = [j for j in np.lexsort((ids, -np.round(score, 12))) if ids[j] != i][:k]
            out[i] = [(ids[j], score[j]) for j in order]
    return out


@pytest.mark.parametrize("shard", [100, 100_000])
def test_recall_and_scores(spark, shard):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 32)) * 2
    rows = [(i, (centres[i % 20] + rng.standard_normal(32)).astype(np.float32).tolist()) for i in range(1500)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard=shard).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = exact(rows, 5, 50)
    assert got.keys() == want.keys() and all(sorted(x) == [1, 2, 3, 4, 5] for x in got.values())
    hits = sum(len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    truth = {(q, v): s for q in want for v, s in want[q]}
    assert all(abs(s - truth[q, v]) < 1e-12 for q in got for v, s in got[q].values() if (q, v) in truth)


def test_copies_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 200, 10)] + [(201, [0.9, 0.1]), (250, [0.0, 0.0]), (300, None), (350, [1.0, None]), (400, [float("nan"), 1.0]), (450, []), (500, [1.0]), (None, [1.0, 0.0]), (0, [1.0, 0.0]), (550, [float("inf"), 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {0: [10, 20, 30, 40, 50], 50: [0, 10, 20, 30, 40], 100: [0, 10, 20, 30, 40], 150: [0, 10, 20, 30, 40]}
    assert ann.nearest(df.where("vec_id = -1")).count() == 0
    few = ann.nearest(df.where("vec_id in (0, 201)")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(0, 1, 201)]


def test_lengths_are_spaces_of_their_own(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(3).tolist()) for i in range(100)] + [(1000, [1.0, 2.0, 3.0, 4.0]), (1050, [1.0, 0.0, 0.0, 1.0])]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert {q: len(v) for q, v in got.items()} == {0: 5, 50: 5, 1000: 1, 1050: 1} and got[1000] == [1050]


def test_blocks_of_queries_and_the_share_verified(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((200, 32)) * 3
    rows = [(i, (centres[i % 200] + 0.02 * rng.standard_normal(32)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, ann.nearest(df).collect()))
    monkeypatch.setattr(ann, "BLOCK_BYTES", 32 * 8 * 25)
    assert sorted(map(tuple, ann.nearest(df).collect())) == whole
    m, q = np.array([v for _, v in rows]), np.arange(0, 4000, 50)
    found, verified = ann.search(m, [[i] for i in range(4000)], m[q], q, 5, 8, 0.95, 7)
    assert len(found) == 5 * len(q) and verified < 0.5 * len(m) * len(q)  # in tight clusters the test stops early


def test_chi_square_points():
    assert abs(ann.chi_square_point(8, 0.95) - 15.507) < 0.01 and abs(ann.chi_square_point(2, 0.5) - 1.386) < 0.01
