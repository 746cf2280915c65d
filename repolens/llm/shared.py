"""Where jobs keep what must survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one integer column that are broadcast at most: 16 MB of keys.
FEW = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local one in local mode, as in tests;
    on a cluster it must be set."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named)
    return named


def kept(df: DataFrame) -> DataFrame:
    """The rows from a reliable checkpoint: computed once, with no lineage behind them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_table(spark: SparkSession, label: str) -> str:
    """A path for a table in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, path: str | None = None, **options: str) -> DataFrame:
    """The rows from a Parquet table written to the shared folder."""
    spark = df.sparkSession
    path = path or new_table(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_enough(keys: DataFrame, most: int = FEW) -> DataFrame:
    """`keys`, one integer column, for a join: broadcast if it is counted to be `most` rows or fewer,
    shuffled if more."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys.hint("shuffle_hash")
