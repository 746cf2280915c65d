"""Which runs are stale, and what a request for a run should do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ACTIVE
from .reports import latest

STALE_MINUTES = 30


def is_active(status: Column, kind: str) -> Column:
    return F.coalesce(status.isin(ACTIVE[kind]), F.lit(False))


def is_stale(status: Column, updated_at: Column, now: Column, kind: str, minutes: int = STALE_MINUTES) -> Column:
    """Active, and not updated for more than `minutes`."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(updated_at.cast("timestamp"))
    return is_active(status, kind) & (age > minutes * 60_000_000)


def _in_progress(kind: str, now: Column, minutes: int) -> Column:
    return is_active(F.col("status"), kind) & ~is_stale(F.col("status"), F.col("updated_at"), now, kind, minutes)


def plan_ingestions(requests: DataFrame, ingestions: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """`requests(repository_id, commit_sha)` with `plan`: in_progress, reuse, retry or create."""
    existing = ingestions.select("repository_id", "commit_sha", F.col("id").alias("ingestion_id"), "status", "updated_at")
    plan = (
        F.when(F.col("ingestion_id").isNull(), "create")
        .when(_in_progress("ingestion", now, minutes), "in_progress")
        .when(F.col("status") == "COMPLETED", "reuse")
        .otherwise("retry")
    )
    return requests.join(existing, ["repository_id", "commit_sha"], "left").withColumn("plan", plan).drop("status", "updated_at")


def _plan(ready: Column, kind: str, now: Column, minutes: int) -> Column:
    return F.when(~F.coalesce(ready, F.lit(False)), "blocked").when(F.col("run").isNull(), "create").when(_in_progress(kind, now, minutes), "in_progress").otherwise("rerun")


def _existing(runs: DataFrame, by: str) -> DataFrame:
    return runs.select(F.col(by).alias("__of"), F.col("id").alias("run"), "status", "updated_at")


def plan_analyses(repositories: DataFrame, ingestions: DataFrame, analyses: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """(repository_id, plan): blocked unless the latest ingestion is COMPLETED, else in_progress, rerun
    (a COMPLETED run too) or create."""
    newest = latest(ingestions, "repository_id").select("repository_id", F.col("id").alias("__of"), F.col("status").alias("ready"))
    joined = repositories.select("repository_id").join(newest, "repository_id", "left").join(_existing(analyses, "ingestion_id"), "__of", "left")
    return joined.select("repository_id", _plan(F.col("ready") == "COMPLETED", "analysis", now, minutes).alias("plan"))


def _latest_analysis(repositories: DataFrame, ingestions: DataFrame, analyses: DataFrame) -> DataFrame:
    newest = latest(ingestions, "repository_id").select("repository_id", F.col("id").alias("ingestion_id"))
    done = analyses.select("ingestion_id", F.col("id").alias("__of"), F.col("status").alias("ready"))
    return repositories.select("repository_id").join(newest, "repository_id", "left").join(done, "ingestion_id", "left")


def plan_embeddings(repositories: DataFrame, ingestions: DataFrame, analyses: DataFrame, embeddings: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """As plan_analyses: blocked unless the latest ingestion has a COMPLETED analysis."""
    joined = _latest_analysis(repositories, ingestions, analyses).join(_existing(embeddings, "analysis_run_id"), "__of", "left")
    return joined.select("repository_id", _plan(F.col("ready") == "COMPLETED", "embedding", now, minutes).alias("plan"))


def plan_ai(repositories: DataFrame, ingestions: DataFrame, analyses: DataFrame, embeddings: DataFrame, ai_runs: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """As plan_embeddings, and the analysis needs a COMPLETED embedding run."""
    indexed = embeddings.select(F.col("analysis_run_id").alias("__of"), F.col("status").alias("indexed"))
    joined = _latest_analysis(repositories, ingestions, analyses).join(indexed, "__of", "left").join(_existing(ai_runs, "analysis_run_id"), "__of", "left")
    ready = (F.col("ready") == "COMPLETED") & (F.col("indexed") == "COMPLETED")
    return joined.select("repository_id", _plan(ready, "ai", now, minutes).alias("plan"))


def index_progress(discovered: Column, reused: Column, embedded: Column) -> Column:
    """Whole percent of chunks that have a vector, at most 100; 0 if none were discovered."""
    share = F.round((F.coalesce(embedded, F.lit(0)) + F.coalesce(reused, F.lit(0))) / F.nullif(discovered, F.lit(0)) * 100)
    return F.when(share.isNull(), 0).otherwise(F.least(F.lit(100), share.cast("int")))


def search_readiness(repositories: DataFrame, embeddings: DataFrame, configured: bool = True) -> DataFrame:
    """(repository_id, readiness): not_configured, not_indexed, indexing or ready, by the latest run."""
    newest = latest(embeddings, "repository_id").select("repository_id", "status")
    state = F.when(F.col("status").isNull() | (F.col("status") == "FAILED"), "not_indexed").when(is_active(F.col("status"), "embedding"), "indexing").otherwise("ready")
    joined = repositories.select("repository_id").join(newest, "repository_id", "left")
    return joined.select("repository_id", (state if configured else F.lit("not_configured")).alias("readiness"))
