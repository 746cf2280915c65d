"""The incremental index over many batches, and its table."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from repolens.operators.index import embed_pseudo
from repolens.plans import queries
from repolens.streaming import jobs

SYMBOLS = "run_id string, file_id string, symbol_id string, ordinal int, name string, start_line int, end_line int, parent_id string"


@pytest.fixture
def few_partitions(spark):
    names = {"spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.enabled": "true"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def index(spark, tmp_path, few_partitions):
    none = spark.createDataFrame([], SYMBOLS)
    asked: list[int] = []

    def embed(rows):
        asked.append(rows.count())
        return embed_pseudo(rows, 4)

    def go(table, number, rows):
        jobs.index_batch(table, spark.createDataFrame(rows, jobs.ARRIVALS), number, lambda files: none, embed)
        return asked[-1] if asked else 0

    return jobs.ChunkTable(spark, f"file://{tmp_path}/table", jobs.Layout(2, 2, 3)), go


def file(run, name, text, action=None, version=None):
    return (run, name, f"{name}.ts", "TypeScript", text, action, version)


def content(table):
    rows = table.chunks()
    return {} if rows is None else {(r.run_id, r.file_id): r.content for r in rows.collect()}


def paths(table):
    root = table.path.removeprefix("file://") + "/chunks"
    return sum("bucket=" in d for v in os.listdir(root) for d in os.listdir(f"{root}/{v}"))


def test_new_changed_unchanged_and_vanished_files(index):
    table, go = index
    assert go(table, 0, [file("r", n, f"text of {n}") for n in "abcde"]) == 5
    assert go(table, 1, [file("r", n, f"text of {n}") for n in "abcde"]) == 0  # nothing is embedded again
    assert go(table, 2, [file("r", n, "changed" if n == "c" else f"text of {n}") for n in "abcde"]) == 1
    before = {r.file_id: (r.id, r.embedding) for r in table.chunks().collect()}
    # a complete run without c: its chunks go; another run keeps its own
    go(table, 3, [file("other", "c", "text of other")])
    go(table, 4, [file("r", n, f"text of {n}") for n in "abde"] + [file("r", None, None, "complete")])
    assert set(content(table)) == {("r", n) for n in "abde"} | {("other", "c")}
    assert {r.file_id: (r.id, r.embedding) for r in table.chunks().where("run_id = 'r'").collect()} == {n: before[n] for n in "abde"}
    stats = {(r.version, r.run_id): (r.discovered, r.reused, r.embedded, r.deleted) for r in table.statistics().collect()}
    assert stats == {(0, "r"): (5, 0, 5, 0), (1, "r"): (5, 5, 0, 0), (2, "r"): (5, 4, 1, 0), (3, "other"): (1, 0, 1, 0), (4, "r"): (4, 4, 0, 1)}
    go(table, 5, [file("r", "a", None, "delete"), file("r", "never there", None, "delete")])
    assert set(content(table)) == {("r", n) for n in "bde"} | {("other", "c")}


def test_newest_of_several_arrivals_in_a_batch(index):
    table, go = index
    go(table, 0, [file("r", "a", "old", None, 1), file("r", "a", "new", None, 2), file("r", "b", "x", None, 1), file("r", "b", None, "delete", 2), file("r", "c", None, "delete", 1), file("r", "c", "back", None, 2)])
    assert content(table) == {("r", "a"): "new", ("r", "c"): "back"}


def test_a_batch_that_is_run_again(index):
    table, go = index
    go(table, 0, [file("r", n, "one") for n in "abcd"])
    go(table, 1, [file("r", "a", "two"), file("r", "b", None, "delete")])
    once = content(table)
    for _ in range(2):
        go(table, 1, [file("r", "a", "two"), file("r", "b", None, "delete")])
        assert content(table) == once
    go(table, 2, [])
    assert content(table) == once


def test_fifty_batches_keep_the_table_small(spark, tmp_path, few_partitions):
    """Whole files of one chunk, written to the table as `index_batch` writes them."""
    table = jobs.ChunkTable(spark, f"file://{tmp_path}/table", jobs.Layout(2, 2, 3))
    rng, truth = random.Random(7), {}
    names = [(r, f) for r in "pq" for f in "abcdef"]
    statistics = spark.createDataFrame([("p", 1, 0, 1, 0)], "run_id string, discovered long, reused long, embedded long, deleted long").coalesce(1)
    for number in range(50):
        manifest, rows, named = table.manifest(before=number), [], rng.sample(names, 3)
        for run, name in named:
            text = None if rng.random() < 0.25 else f"text {rng.randrange(5)}"
            truth.pop((run, name), None)
            if text:
                truth[run, name] = text
                rows.append((run, name, 0, text, False))
            rows.append((run, name, None, None, text is None))
        batch = spark.createDataFrame(rows, "run_id string, file_id string, chunk_index int, content string, gone boolean").coalesce(1)
        touched = [r[0] for r in batch.select(table.bucket()).distinct().collect()]
        rest = table.rows(manifest, table.full(manifest, touched))
        if rest is not None:
            batch = batch.unionByName(rest.where("not gone").drop("version", "bucket").join(batch.select("run_id", "file_id"), ["run_id", "file_id"], "left_anti"))
        table.commit(number, manifest, touched, batch, statistics)
        now = table.manifest()
        assert max(map(len, now.values()), default=0) <= 3 and len(now) <= 4
        assert paths(table) <= 4 * (3 + 3)  # a bucket's versions, and those that only the batch before needs
        if number % 10 == 9:
            assert content(table) == truth
    assert len(os.listdir(table.path.removeprefix("file://") + "/manifest")) <= 4


def test_a_run_is_spread_over_buckets(spark, index):
    table, _ = index
    wide = jobs.ChunkTable(spark, table.path, jobs.Layout(8, 4, 3))
    rows = spark.range(2000).select(F.lit("hot").alias("run_id"), F.col("id").cast("string").alias("file_id"))
    counts = [r["count"] for r in rows.groupBy(wide.bucket().alias("b")).count().collect()]
    assert len(counts) == 4 and max(counts) < 700
    held = set(rows.select(F.explode(wide.buckets_of_run())).distinct().toPandas().iloc[:, 0])
    assert held == set(rows.select(wide.bucket()).distinct().toPandas().iloc[:, 0])


def test_progress_goes_on_after_a_stop(spark, tmp_path, few_partitions):
    where = [f"file://{tmp_path}/{x}" for x in ("in", "table", "state")]
    for rows in (["a", "a", "b"], ["b"], ["c", "a"]):
        spark.createDataFrame([(r,) for r in rows], "run_id string").write.mode("append").parquet(where[0])
        jobs.report_progress(spark.readStream.schema("run_id string").parquet(where[0]), where[1], where[2]).awaitTermination()
    found = {(r.batch, r.run_id): r.chunks_embedded for r in jobs.progress(spark, where[1]).collect()}
    assert found == {(0, "a"): 2, (0, "b"): 1, (1, "b"): 2, (2, "c"): 1, (2, "a"): 3}


def test_arrivals_have_as_many_files_as_the_input_asks_for(spark, sf, tmp_path, monkeypatch):
    """t1 writes its arrivals in tasks of the size of a scan's, not in a fixed number that shares any input."""
    monkeypatch.setattr(queries, "shared_folder", lambda spark, label: str(tmp_path / label))
    spark.read.parquet(f"{sf}/documents.parquet").repartition(12).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        queries.t1_incremental_index(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(list((tmp_path / "index" / "arrivals").glob("part-*"))) > 3 * 8
