"""Incremental embedding: which chunks changed, and the chunk table after a run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import pseudo_embedding, valid_vector

KEY = ["run_id", "file_id", "chunk_index"]


def diff_chunks(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """(run_id, file_id, chunk_index, action): reuse, embed (new or changed) or delete. Only keys and
    hashes are shuffled."""
    a = fresh.select(*KEY, F.col("content_hash").alias("new_hash"))
    b = existing.select(*KEY, F.col("content_hash").alias("old_hash"))
    action = F.when(F.col("new_hash").isNull(), "delete").when(F.col("new_hash") == F.col("old_hash"), "reuse").otherwise("embed")
    return a.join(b, KEY, "full_outer").select(*KEY, action.alias("action"))


def diff_statistics(diff: DataFrame) -> DataFrame:
    """(run_id, discovered, reused, embedded, deleted)."""
    is_ = lambda a: F.count_if(F.col("action") == a)
    return diff.groupBy("run_id").agg(F.count_if(F.col("action") != "delete").alias("discovered"), is_("reuse").alias("reused"), is_("embed").alias("embedded"), is_("delete").alias("deleted"))


Provider = Callable[[list[str]], "np.ndarray | list[list[float]]"]


def _in_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of `size` rows; only the last may have fewer. Of a batch that came in, no more than
    the rows of the next call are kept once another is asked for."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            held.append(batch.slice(at, size - n))
            at += held[-1].num_rows
            n += held[-1].num_rows
            if n == size:
                yield _one(held)
                held, n = [], 0
        if held:
            held = [_one([held[0].slice(0, 0), *held])]
        del batch
    if n:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.concat_batches(held)


def embed_batches(rows: DataFrame, provider: Callable[[], Provider], text: str = "content", batch: int = 96) -> DataFrame:
    """`rows` with `embedding` (array<float>) from a provider, in order. `provider` is called once per task and
    returns a function of texts to vectors. Of the calls of a task all but the last get `batch` texts, however
    the rows come in. A provider that returns another number of vectors is an error."""
    schema = T.StructType([*rows.drop("embedding").schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    names = rows.drop("embedding").columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = provider()
        for part in _in_batches(batches, batch):
            vectors = [np.asarray(v, np.float32) for v in embed(part.column(names.index(text)).to_pylist())]
            if len(vectors) != len(part):
                raise ValueError(f"the provider returned {len(vectors)} vectors for {len(part)} texts")
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*names, "embedding"])

    return rows.drop("embedding").mapInArrow(run, schema)


def embed_once(rows: DataFrame, provider: Callable[[], Provider], known: str, text: str = "content", batch: int = 96, waves: int = 8) -> DataFrame:
    """`rows` with `embedding`, each distinct text embedded once, whatever run it comes in.

    `known` is a folder of Parquet with the vectors so far by SHA-256 of the text. What it lacks is embedded in
    `waves`, each written there when it is done: a job that fails or is stopped loses the wave it was in, and the
    next one embeds only what is open. Null texts have a null embedding.
    """
    spark = rows.sparkSession
    schema = "digest string, embedding array<float>"
    path = spark._jvm.org.apache.hadoop.fs.Path(known)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    keyed = rows.drop("embedding").withColumn("__digest", F.sha2(F.col(text).cast("binary"), 256))
    wanted = keyed.where(F.col(text).isNotNull()).select(F.col("__digest").alias("digest"), F.col(text).alias("__text"))
    for wave in range(waves):
        own = wanted.where(F.pmod(F.xxhash64("digest"), F.lit(waves)) == wave).dropDuplicates(["digest"])
        if there:
            own = own.join(spark.read.schema(schema).parquet(known).select("digest"), "digest", "left_anti")
        embed_batches(own, provider, "__text", batch).select("digest", "embedding").write.mode("append").parquet(known)
        there = True
    vectors = spark.read.schema(schema).parquet(known).dropDuplicates(["digest"])
    return keyed.join(vectors, keyed["__digest"] == vectors["digest"], "left").drop("__digest", "digest")


def embed_pseudo(rows: DataFrame, dimensions: int, text: str = "content") -> DataFrame:
    """`rows` with the repeatable pseudo-embedding of their text; no Python in the tasks."""
    return rows.withColumn("embedding", pseudo_embedding(F.col(text), dimensions).cast("array<float>"))


def check_vectors(rows: DataFrame, dimensions: int, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows with a vector of the wrong length or with a component that is not finite)."""
    marked = rows.withColumn("__ok", valid_vector(F.col(vector), dimensions))
    return marked.where("__ok").drop("__ok"), marked.where(~F.col("__ok")).drop("__ok")


def apply_diff(fresh: DataFrame, existing: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The chunk table after a run: reused chunks keep their row and take the fresh symbol_id; new and
    changed ones are embedded anew, and changed ones keep id and created_at; others are gone.

    `existing` has the columns of `fresh` and id, created_at and embedding.
    """
    old = existing.select(*KEY, F.col("content_hash").alias("__hash"), F.col("id").alias("__id"), F.col("created_at").alias("__created"))
    matched = fresh.join(old, KEY, "left")
    same = F.coalesce(F.col("content_hash") == F.col("__hash"), F.lit(False))
    new_id = F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in KEY]), 256)
    changed = matched.where(~same).withColumns({"id": F.coalesce("__id", new_id), "created_at": F.coalesce("__created", F.lit(None).cast("timestamp"))}).drop("__hash", "__id", "__created")
    embedded = embed(changed)
    refreshed = matched.where(same).select(*KEY, F.col("symbol_id").alias("__symbol"))
    reused = existing.join(refreshed, KEY).withColumn("symbol_id", F.col("__symbol")).drop("__symbol")
    return reused.select(*embedded.columns).unionByName(embedded)
