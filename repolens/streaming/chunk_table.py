"""The chunk table of an incremental index: versions of hash buckets, a manifest, and compaction.

    chunks/version=<n>/bucket=<b>/   what batch n wrote for a bucket: for each file it touched all chunks, and one
                                     row without a chunk index that names the file (`gone`: it has none any more)
    manifest/version=<n>.json        after batch n, the versions of every bucket, oldest first
    statistics/version=<n>/          what batch n discovered, reused, embedded and deleted, per run

A file's chunks are those of the newest version of its bucket that names it. Runs are dealt to `Layout.runs`
groups of buckets, and the files of a run to `Layout.files` buckets of its group: a batch reads and writes
the buckets of the files it names, a run that has most files is spread, and all a driver holds is a row
for each bucket. A bucket that would reach `Layout.versions` versions is written whole, which makes it one
version again, so a batch never meets more of them, however many there were before it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = ["run_id", "file_id"]


@dataclass(frozen=True)
class Layout:
    """Fixed when a table is first written: groups of buckets, buckets of a group, versions of a bucket."""

    runs: int = 64
    files: int = 16
    versions: int = 8


class ChunkTable:
    def __init__(self, spark: SparkSession, path: str, layout: Layout = Layout()) -> None:
        self.spark, self.path, self.layout = spark, path.rstrip("/"), layout

    # --- places ---

    def bucket(self) -> Column:
        """The bucket of a row with run_id and file_id."""
        group = F.pmod(F.xxhash64("run_id"), F.lit(self.layout.runs))
        return (group * self.layout.files + F.pmod(F.xxhash64("run_id", "file_id"), F.lit(self.layout.files))).cast("int")

    def buckets_of_run(self) -> Column:
        """All buckets that hold files of the row's run_id."""
        first = F.pmod(F.xxhash64("run_id"), F.lit(self.layout.runs)).cast("int") * self.layout.files
        return F.sequence(first, first + self.layout.files - 1)

    def _folder(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _system(self):
        return self._folder().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _committed(self) -> list[int]:
        """Batches whose manifest is there: two at most, and one that is being replaced."""
        fs, folder = self._system(), self._folder("manifest")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[8:-5]) for n in names if n.startswith("version=") and n.endswith(".json"))

    def manifest(self, before: int | None = None) -> dict[int, list[int]]:
        """The versions of each bucket after the newest batch, of those before `before`."""
        found = [v for v in self._committed() if before is None or v < before]
        return self._manifest(found[-1]) if found else {}

    def _manifest(self, version: int) -> dict[int, list[int]]:
        """One entry for each bucket of the layout."""
        stream = self._system().open(self._folder("manifest", f"version={version}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(b): v for b, v in json.loads(text).items()}

    def _list(self, version: int, manifest: dict[int, list[int]]) -> None:
        """Puts a manifest in place whole: readers see the old one or the new one."""
        fs, whole, part = self._system(), self._folder("manifest", f"version={version}.json"), self._folder("manifest", f"_version={version}")
        stream = fs.create(part, True)
        stream.write(bytearray(json.dumps({b: v for b, v in sorted(manifest.items()) if v}).encode()))
        stream.close()
        fs.delete(whole, False)
        fs.rename(part, whole)

    # --- reading ---

    def _read(self, parts: dict[int, list[int]], columns: list[str] | None) -> DataFrame | None:
        paths = [f"{self.path}/chunks/version={v}/bucket={b}" for b, versions in parts.items() for v in versions]
        if not paths:
            return None
        rows = self.spark.read.option("basePath", f"{self.path}/chunks").parquet(*paths)
        return rows if columns is None else rows.select(*columns, "chunk_index", "gone", "version", "bucket")

    def rows(self, manifest: dict[int, list[int]], buckets: list[int] | None = None, columns: list[str] | None = None) -> DataFrame | None:
        """The rows in force of `buckets` (all, if not given), those that name a file included, with version and
        bucket; None if there are none. Only buckets of several versions look for files named again, which is
        a join on the names alone."""
        own = {b: v for b, v in manifest.items() if buckets is None or b in buckets}
        one = self._read({b: v for b, v in own.items() if len(v) == 1}, columns)
        several = {b: v for b, v in own.items() if len(v) > 1}
        if not several:
            return one
        names = self._read(several, FILE).where("chunk_index is null")
        newest = names.groupBy(*FILE).agg(F.max("version").alias("newest"), F.count("*").alias("n")).where("n > 1")
        many = self._read(several, columns).join(newest.drop("n"), FILE, "left").where(F.col("newest").isNull() | (F.col("version") == F.col("newest")))
        many = many.drop("newest")
        return many if one is None else many.unionByName(one.select(*many.columns))

    def chunks(self) -> DataFrame | None:
        """All chunks in force; None if no batch was committed."""
        rows = self.rows(self.manifest())
        return None if rows is None else rows.where("chunk_index is not null").drop("gone", "version", "bucket")

    def statistics(self) -> DataFrame:
        """(run_id, discovered, reused, embedded, deleted, version) of all batches."""
        return self.spark.read.option("basePath", f"{self.path}/statistics").parquet(f"{self.path}/statistics/version=*")

    # --- writing ---

    def full(self, manifest: dict[int, list[int]], touched: list[int]) -> list[int]:
        """Buckets among `touched` that have as many versions as they may."""
        return [b for b in touched if len(manifest.get(b, [])) >= self.layout.versions - 1]

    def commit(self, number: int, manifest: dict[int, list[int]], touched: list[int], rows: DataFrame, statistics: DataFrame) -> None:
        """Writes the rows of batch `number`, of the buckets `touched` (those that are `full` whole), and then the
        manifest that brings them in force. A batch that is committed again replaces what it wrote. Adaptive
        execution splits a bucket of many rows and joins small ones before they are written."""
        rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/chunks/version={number}")
        statistics.write.mode("overwrite").parquet(f"{self.path}/statistics/version={number}")
        whole = set(self.full(manifest, touched))
        fs = self._system()
        there = {s.getPath().getName() for s in fs.listStatus(self._folder("chunks", f"version={number}"))}
        after = dict(manifest)
        for b in touched:
            kept = [] if b in whole else manifest.get(b, [])
            after[b] = [*kept, number] if f"bucket={b}" in there else kept
        self._list(number, after)
        self._clean(number, after)

    def _clean(self, number: int, after: dict[int, list[int]]) -> None:
        """Removes manifests but those of this batch and the one before it, which a retry of this batch reads, and
        the folders that only they named."""
        older = [v for v in self._committed() if v < number]
        fs, before = self._system(), self._manifest(older[-1]) if older else {}
        live = {(b, v) for m in (before, after) for b, versions in m.items() for v in versions}
        for version in older[:-1]:
            gone = {(b, v) for b, versions in self._manifest(version).items() for v in versions} - live
            for b, v in gone:
                fs.delete(self._folder("chunks", f"version={v}", f"bucket={b}"), True)
            for v in {v for _, v in gone} - {v for _, v in live}:
                fs.delete(self._folder("chunks", f"version={v}"), True)
            fs.delete(self._folder("manifest", f"version={version}.json"), False)
