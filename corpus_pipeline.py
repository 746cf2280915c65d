"""A corpus pipeline of five stages over `documents`: each works on all rows that the last one kept.

language_id        documents in none of the learned languages go: no text, no letter, or letters that are noise to the network
simhash_dedup      one document of each group of near copies stays, that of the least doc_id
decontaminate      documents with a passage of `benchmark` go
secret_redaction   secrets are masked; every document stays
bpe_encode         texts become token ids, with digests of the ids and of the bytes they decode to
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.llm import bpe, decontam, langid, near_copies, secret_scan
from repolens.llm.shared import new_table, removed, written


#: Rows of a batch that goes to a Python worker: with texts of some kilobytes, a few megabytes.
BATCH_ROWS = 2_000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    network = langid.fit(docs.where(~langid.held_out("doc_id")))
    if not network:  # nothing to learn from
        return docs.where(langid.lettered("text"))
    names = {"pred": "__lang_pred", "noise": "__lang_noise"}
    judged = langid.predict(docs, network, extra=docs.columns, score="__lang_score", **names)
    return judged.where(langid.in_a_language(**names)).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return near_copies.one_of_each(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(docs, keep=docs.columns, found="__secrets")
    text = secret_scan.redacted(F.col("text"), F.col("__secrets"))
    masked = found.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("secret_redaction", secret_redaction),
    ("bpe_encode", bpe_encode),
]

#: No SQL runs a recurrent network, XXH64 or byte-pair merges: the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each but the last is written and read again, and removed once its successor is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_table(spark, name)
        docs = written(stage(spark, docs, sf_dir), name, path)
        if before:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
