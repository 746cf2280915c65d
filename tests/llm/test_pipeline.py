from __future__ import annotations

import random

import public_tokenizers as P
import tiktoken

import __spark_entry__
import corpus_pipeline
from repolens.llm import bpe, decontam, langid, near_copies, secret_scan


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(9001, "1234 5678", "en", "s", 9), (9002, None, "en", "s", 0)], docs.schema)
    given = docs.unionByName(extra)
    first = corpus_pipeline.language_id(spark, given, sf).cache()
    assert first.columns == docs.columns and first.where("doc_id > 9000").count() == 0 and first.count() == docs.count()
    second = corpus_pipeline.simhash_dedup(spark, first, sf).cache()
    groups = near_copies.near_copy_groups(first).collect()
    assert {r["doc_id"] for r in second.collect()} == {r["component_id"] for r in groups}
    third = corpus_pipeline.decontaminate(spark, second, sf).cache()
    leaked = {r["doc_id"] for r in decontam.leaks(second, spark.read.parquet(f"{sf}/benchmark.parquet")).collect() if r["items"]}
    assert {r["doc_id"] for r in third.collect()} == {r["doc_id"] for r in second.collect()} - leaked
    fourth = corpus_pipeline.secret_redaction(spark, third, sf).cache()
    assert fourth.columns == docs.columns and fourth.count() == third.count()
    assert all(not r["found"] for r in secret_scan.find_secrets(fourth).collect())
    before = {r["doc_id"]: r["text"] for r in third.collect()}
    found = {r["doc_id"] for r in secret_scan.find_secrets(third).collect() if r["found"]}
    assert all(r["text"] == before[r["doc_id"]] for r in fourth.collect() if r["doc_id"] not in found)
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(P.path("byte_bpe_50k.tiktoken")).ids, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in fourth.collect()}
    for r in corpus_pipeline.bpe_encode(spark, fourth, sf).collect():
        assert r["ids"] == plain.encode_ordinary(texts[r["doc_id"]])


def test_names():
    known = __spark_entry__.queries()
    assert "pipeline" in known and all(any(n.startswith(f"op{i}_") for n in known) for i in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontaminate", "secret_redaction", "bpe_encode"]
    assert langid.UNDETERMINED == "und"


def test_gibberish_goes_and_held_out_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs, rng = spark.read.parquet(f"{sf}/documents.parquet"), random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    kinds = ["abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz", "".join(map(chr, range(0x430, 0x450)))]
    junk = [(900_000 + i, " ".join(word(kinds[i % 3]) for _ in range(300)), None, "s", 1) for i in range(30)]
    got = corpus_pipeline.language_id(spark, docs.unionByName(spark.createDataFrame(junk, docs.schema)), sf).select("doc_id").collect()
    kept = {r["doc_id"] for r in got}
    assert not kept & {r[0] for r in junk}
    assert len(kept) >= 0.998 * docs.count()


def test_no_labels_keep_every_text_with_a_letter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(i, t, None, "s", 1) for i, t in enumerate(["a text", "漢字", "1234 !!", "", None, "ü"])]
    got = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, docs.schema), sf)
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 1, 5]
