"""Incremental indexing and progress as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.chunks import Chunking, chunk_files
from ..operators.index import KEY, apply_diff, diff_chunks, diff_statistics
from ..sources.shared import removed, stored
from .chunk_table import FILE, ChunkTable, Layout

FILES = "run_id string, file_id string, path string, language string, content string"
#: action: null for a file, `delete` for one that is gone, `complete` (without a file) for a run of which the
#: batch holds every file, so that its others are gone. version: of arrivals of one file in one batch the
#: greatest counts.
ARRIVALS = FILES + ", action string, version long"


def index_incrementally(
    spark: SparkSession, arrivals: str, symbols: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame],
    config: Chunking = Chunking(), schema: str | StructType = ARRIVALS, layout: Layout = Layout(), files_per_batch: int | None = None,
) -> StreamingQuery:
    """File versions that arrive as Parquet under `arrivals` are chunked and compared with the chunk table
    (`chunk_table`); only new and changed chunks are embedded, and chunks that a file no longer has, all
    of a deleted one included, go. Files that a batch does not name keep theirs. A batch that is run
    again writes the same again. `files_per_batch` counts arrived Parquet files.
    """
    stream = spark.readStream.schema(schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", str(files_per_batch))
    batch = lambda files, number: index_batch(ChunkTable(spark, table, layout), files, number, symbols, embed, config)
    return stream.parquet(arrivals).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_batch(table: ChunkTable, arrived: DataFrame, number: int, symbols: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame], config: Chunking = Chunking()) -> None:
    """One batch of `index_incrementally`: reads and writes the buckets of the files that it names."""
    if "action" not in arrived.columns:
        arrived = arrived.withColumns({"action": F.lit(None).cast("string"), "version": F.lit(None).cast("long")})
    manifest = table.manifest(before=number)
    named = stored(_named(table, manifest, arrived), "named-files")
    touched = [r[0] for r in named.select(table.bucket()).distinct().collect()]  # one for each bucket at most
    if not touched:
        return
    item = F.struct("version", F.xxhash64("content"), "path", "language", "content")
    files = arrived.where("file_id is not null").join(named.where("not gone"), FILE, "left_semi").where(F.coalesce("action", F.lit("")) != "delete")
    newest = files.groupBy(*FILE).agg(F.max(item).alias("f")).select(*FILE, "f.path", "f.language", "f.content")
    fresh = stored(chunk_files(newest, symbols(newest), config), "fresh-chunks")
    before, rest = table.rows(manifest, touched), None
    if before is None:
        before = _none_yet(fresh)
    else:
        rest = _untouched(table, manifest, touched, named)
    old = before.where("chunk_index is not null").join(named.select(*FILE), FILE, "left_semi").drop("gone", "version", "bucket")
    after = apply_diff(fresh, old, embed).withColumn("gone", F.lit(False))
    rows = after.unionByName(named, allowMissingColumns=True)
    if rest is not None:
        rows = rows.unionByName(rest, allowMissingColumns=True)
    table.commit(number, manifest, touched, rows, diff_statistics(diff_chunks(fresh, old)))
    for table_ in (fresh, named):
        removed(table_)


def _named(table: ChunkTable, manifest: dict[int, list[int]], arrived: DataFrame) -> DataFrame:
    """(run_id, file_id, gone) of the files that a batch names, those included that a complete run lacks."""
    action = F.coalesce("action", F.lit(""))
    last = F.max_by(action == "delete", F.struct("version", action != "delete")).alias("gone")
    named = arrived.where("file_id is not null").groupBy(*FILE).agg(last)
    whole = arrived.where(action == "complete").select("run_id").distinct()
    buckets = [r[0] for r in whole.select(F.explode(table.buckets_of_run())).distinct().collect()]
    known = table.rows(manifest, buckets, FILE) if buckets else None
    if known is None:
        return named
    lost = known.where("chunk_index is null and not gone").join(whole, "run_id", "left_semi").select(*FILE).join(named, FILE, "left_anti")
    return named.unionByName(lost.withColumn("gone", F.lit(True)))


def _untouched(table: ChunkTable, manifest: dict[int, list[int]], touched: list[int], named: DataFrame) -> DataFrame | None:
    """What stays of the buckets that are written whole: the rows of files that the batch does not name."""
    rows = table.rows(manifest, table.full(manifest, touched))
    return None if rows is None else rows.where("not gone").drop("version", "bucket").join(named.select(*FILE), FILE, "left_anti")


def _none_yet(fresh: DataFrame) -> DataFrame:
    missing = {"embedding": "array<float>", "id": "string", "created_at": "timestamp", "gone": "boolean", "version": "long", "bucket": "int"}
    return fresh.limit(0).withColumns({c: F.lit(None).cast(kind) for c, kind in missing.items()})


def latest_table(spark: SparkSession, table: str) -> DataFrame | None:
    """The chunks in force of all files; None before the first batch."""
    return ChunkTable(spark, table).chunks()


def embedded_so_far(chunks: DataFrame) -> DataFrame:
    """A running count of embedded chunks per run over a stream of chunks; one counter a run is kept."""
    return chunks.groupBy("run_id").agg(F.count("*").alias("chunks_embedded"))


def report_progress(chunks: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Writes, for each batch of a stream of embedded chunks, the runs that it touched with all chunks embedded
    so far, to a folder by the batch's number. The counters are state of the stream: they go on where a
    stopped stream left them, and a batch that is run again replaces its folder."""

    def keep(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return embedded_so_far(chunks).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()


def progress(spark: SparkSession, table: str) -> DataFrame:
    """(run_id, chunks_embedded, batch): what `report_progress` wrote."""
    return spark.read.schema("run_id string, chunks_embedded long, batch int").parquet(table)


__all__ = ["ARRIVALS", "FILES", "KEY", "ChunkTable", "Layout", "embedded_so_far", "index_batch", "index_incrementally", "latest_table", "progress", "report_progress"]
