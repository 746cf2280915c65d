"""Source files and repository metadata."""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import file_name
from .shared import stored

METADATA = "id long, owner struct<login:string>, name string, full_name string, default_branch string, private boolean, html_url string, description string, updated_at timestamp, user_id string"
#: Bytes of files that a task reads at most, if none is larger, and that an opened file counts for at least.
TASK_BYTES, OPEN_BYTES = 64 << 20, 32 << 10
#: Bytes of files in a batch; a larger file is a batch of its own.
BATCH_BYTES = 4 << 20


def _placed(spark: SparkSession, root: str) -> tuple[str, bool]:
    """The root with its file system, and whether that is the local one (or one mounted as such)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(folder).toString(), fs.getScheme() == "file"


def read_tree(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """(path, name, size, content) of every file under a folder; path is relative to it, content is
    decoded as UTF-8. Hidden temporary files and symbolic links are not read, nor are files of more than
    `max_bytes`: sizes are known from the listing. A root is a name, whatever characters it has.

    Local trees are listed by tasks, a level of folders at a time, and read by tasks that share the bytes; nothing
    of the listing passes through the driver. Other file systems are listed by Spark's reader of binary files.
    """
    whole, local = _placed(spark, root)
    if local:
        raw = _contents(_listed(spark, whole.removeprefix("file:")), whole.removeprefix("file:"), max_bytes)
        path = F.decode("path", "UTF-8")
    else:
        named = re.sub(r"([\\*?\[\]{}])", r"\\\1", whole)
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(named).withColumnRenamed("length", "size")
        raw = raw if max_bytes is None else raw.where(F.col("size") <= max_bytes)
        path = F.substring(F.col("path"), F.lit(len(whole.rstrip("/")) + 2), F.length("path"))
    return raw.select(path.alias("path"), "size", F.decode("content", "UTF-8").alias("content")).withColumn("name", file_name(F.col("path"))).select("path", "name", "size", "content")


def _hidden(name: bytes) -> bool:
    """Names that Spark's readers pass over."""
    if name.startswith((b"_metadata", b"_common_metadata")):
        return False
    return name.startswith(b".") or name.startswith(b"_") and b"=" not in name or name.endswith(b"._COPYING_")


def _level(folders: DataFrame, root: str) -> DataFrame:
    """(path, size) of what the folders `path` hold, relative to the root; folders have a null size."""
    top = os.fsencode(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, sizes = [], []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(paths, pa.binary()), pa.array(sizes, pa.int64())], names=["path", "size"])
            paths.clear()
            sizes.clear()
            return made

        for given in batches:
            for folder in given.column(0).to_pylist():
                with os.scandir(os.path.join(top, folder)) as entries:
                    for entry in entries:
                        is_folder = entry.is_dir(follow_symlinks=False)
                        if _hidden(entry.name) or not (is_folder or entry.is_file(follow_symlinks=False)):
                            continue
                        paths.append(os.path.join(folder, entry.name))
                        sizes.append(None if is_folder else entry.stat(follow_symlinks=False).st_size)
                        if len(paths) == 10_000:
                            yield batch()
        if paths:
            yield batch()

    return folders.select("path").mapInArrow(run, "path binary, size long")


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of all files of a local tree, from tables of its levels."""
    folders, levels = spark.range(1).select(F.lit(b"").alias("path")), []
    while True:
        levels.append(stored(_level(folders, root), "tree-level"))
        folders = levels[-1].where("size is null")
        if folders.isEmpty():
            break
        folders = folders.repartition(_tasks(spark, folders.count() * OPEN_BYTES))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found.where("size is not null")


def _tasks(spark: SparkSession, size: int) -> int:
    return max(1, spark.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES))


def _contents(files: DataFrame, root: str, max_bytes: int | None) -> DataFrame:
    """(path, size, content) of local files(path, size)."""
    spark, top = files.sparkSession, os.fsencode(root)
    if max_bytes is not None:
        files = files.where(F.col("size") <= max_bytes)
    size = files.agg(F.sum(F.greatest("size", F.lit(OPEN_BYTES)))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, contents, held = [], [], 0
        for given in batches:
            for path in given.column(0).to_pylist():
                with open(os.path.join(top, path), "rb") as f:
                    content = f.read()
                if paths and held + len(content) > BATCH_BYTES:
                    yield _batch(paths, contents)
                    paths, contents, held = [], [], 0
                paths.append(path)
                contents.append(content)
                held += len(content)
        if paths:
            yield _batch(paths, contents)

    return files.select("path").repartition(_tasks(spark, size)).mapInArrow(run, "path binary, size long, content binary")


def _batch(paths: list[bytes], contents: list[bytes]) -> pa.RecordBatch:
    shown = [p.decode("utf-8", "replace").encode() for p in paths]
    return pa.RecordBatch.from_arrays([pa.array(shown, pa.binary()), pa.array([len(c) for c in contents], pa.int64()), pa.array(contents, pa.binary())], names=["path", "size", "content"])


def write_tree(rows: DataFrame, root: str, folder: str, content: Column) -> None:
    """A file of its own for each row, with `content` and a line end, in the folder `<folder>=<value>` of its column
    `folder`. Local files are written by the tasks themselves, since Hadoop starts a process for each local file
    and folder whose permissions it sets; elsewhere Spark's writer does it. A task that is run again writes the same files again.
    """
    spark = rows.sparkSession
    whole, local = _placed(spark, root)
    texts = rows.select(F.col(folder), content.alias("__content"))
    if not local:
        texts.write.partitionBy(folder).option("maxRecordsPerFile", 1).text(whole)
        return
    top = whole.removeprefix("file:")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        for batch in batches:
            for own, text in zip(*batch.columns, strict=True):
                place, text = os.path.join(top, own.as_py()), text.as_py()
                os.makedirs(place, exist_ok=True)
                part = os.path.join(place, f".{task.taskAttemptId()}-{n}")
                with open(part, "wb") as f:
                    f.write(text + b"\n")
                os.replace(part, os.path.join(place, f"part-{task.partitionId():05d}-{n:09d}.txt"))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    os.makedirs(top, exist_ok=True)
    named = F.concat(F.lit(f"{folder}="), F.coalesce(F.col(folder).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
    texts.select(named.alias("folder"), F.col("__content").cast("binary")).mapInArrow(run, "n long").agg(F.sum("n")).first()


def normalise_metadata(raw: DataFrame, most: int = 500) -> DataFrame:
    """Repositories from listed metadata (schema METADATA); the `most` latest updated of each user."""
    order = Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "id")
    first = raw.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most)
    return first.select("user_id", F.col("id").alias("github_id"), F.col("owner.login").alias("owner"), "name", "full_name", "default_branch", "private", "html_url", "description", "updated_at")


def read_metadata(spark: SparkSession, path: str, most: int = 500) -> DataFrame:
    return normalise_metadata(spark.read.schema(METADATA).json(path), most)
