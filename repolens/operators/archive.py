"""Admission of archive entries under path and size limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import resolved


@dataclass(frozen=True)
class Limits:
    max_repository_bytes: int = 500 * 1024 * 1024
    max_file_bytes: int = 10 * 1024 * 1024
    max_files: int = 5000


def is_safe(entry_path: Column, workspace: str = "/workspace") -> Column:
    """Whether the place that an entry names at last is the workspace or below it."""
    place = resolved(workspace, entry_path)
    return (place == workspace) | place.startswith(workspace + "/")


def stripped(entry_path: Column) -> Column:
    """Without the archive's top folder."""
    parts = F.split(entry_path, "/", -1)
    return F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), "/")


#: Ordinals of a stretch: what one task sums up of an archive.
STRETCH = 1 << 16


def admit(entries: DataFrame, limits: Limits = Limits(), stretch: int = STRETCH) -> DataFrame:
    """`entries(repository_id, ordinal, entry_path, entry_type, size)` with `status`, in archive order:
    link, unsafe, directory, oversized, accepted, the limit that breaks (too_many_files or
    repository_too_large), and `stopped` for all that follow it in the repository.

    Links and unsafe, oversized and stopped entries do not count. A null or negative size is 0.

    Running totals have two levels: an archive is dealt to stretches of ordinals, the totals of the stretches
    before it are added up per archive, and the rest is summed up within the stretch. So an archive of very many
    entries is spread over tasks, and its entries are shuffled once.
    """
    size = F.greatest(F.coalesce(F.col("size"), F.lit(0)).cast("long"), F.lit(0))
    kind = (
        F.when(F.col("entry_type").isin("SymbolicLink", "Link"), "link")
        .when(~is_safe(F.col("entry_path")), "unsafe")
        .when(F.col("entry_type") == "Directory", "directory")
        .when(size > limits.max_file_bytes, "oversized")
        .otherwise("file")
    )
    is_file = F.col("__kind") == "file"
    # a struct as key: null fields of it are equal, as they are in a window
    key = F.struct("repository_id", F.floor(F.col("ordinal") / stretch).alias("stretch"))
    marked = entries.withColumns({"__kind": kind, "__key": key})
    totals = marked.groupBy("__key").agg(F.count_if(is_file).alias("__n"), F.sum(F.when(is_file, size).otherwise(0)).alias("__bytes"))
    before = Window.partitionBy("__key.repository_id").orderBy("__key.stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("__key", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("__n", "__bytes")])
    placed = marked.join(carried, "__key")
    upto = Window.partitionBy("__key").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.col("__n_before") + F.sum(is_file.cast("long")).over(upto)
    total = F.col("__bytes_before") + F.sum(F.when(is_file, size).otherwise(0)).over(upto)
    counted = placed.withColumns({"__n": n, "__bytes": total})
    reason = F.when(is_file & (F.col("__n") > limits.max_files), "too_many_files").when(is_file & (F.col("__bytes") > limits.max_repository_bytes), "repository_too_large")
    broken = counted.withColumn("__reason", reason)
    earlier = F.coalesce(F.sum(F.col("__reason").isNotNull().cast("long")).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # totals only grow: a limit broke in a stretch before if they pass it there
    over = (F.col("__n_before") > limits.max_files) | (F.col("__bytes_before") > limits.max_repository_bytes)
    status = F.when(over | (F.col("__before") > 0), "stopped").when(F.col("__reason").isNotNull(), F.col("__reason")).when(is_file, "accepted").otherwise(F.col("__kind"))
    return broken.withColumn("__before", earlier).withColumn("status", status).select(*entries.columns, "status")


def verdicts(admitted: DataFrame) -> DataFrame:
    """(repository_id, verdict, accepted_count) from `admit`: unsafe_path if an unsafe entry was seen
    before any limit broke, else the limit, else accepted."""
    reason = F.max(F.when(F.col("status").isin("too_many_files", "repository_too_large"), F.col("status")))
    verdict = F.when(F.bool_or(F.col("status") == "unsafe"), "unsafe_path").otherwise(F.coalesce(reason, F.lit("accepted")))
    return admitted.groupBy("repository_id").agg(verdict.alias("verdict"), F.count_if(F.col("status") == "accepted").alias("accepted_count"))
