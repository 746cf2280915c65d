"""The folder that all executors and the driver see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a local one in local mode, as in
    tests; on a cluster it must be set."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    named = named or "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, label: str) -> DataFrame:
    """The rows from a table written to the shared folder: what several jobs read is made once, and
    survives lost executors."""
    path = shared_folder(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def small_enough(rows: DataFrame, most: int = 200_000) -> DataFrame:
    """Narrow rows for a join: broadcast if they are counted to be `most` or fewer, else as they are."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def removed(rows: DataFrame) -> None:
    """Removes the table of `stored` rows that nothing reads any more."""
    spark = rows.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in rows.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
