"""Result tables: writing by run, and what a new snapshot holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_runs(rows: DataFrame, path: str, by: str = "run_id") -> None:
    """Writes rows in folders by run. Runs that are written again replace theirs; others stay."""
    rows.write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def replace_runs(existing: DataFrame, new: DataFrame, runs: DataFrame, by: str = "run_id") -> DataFrame:
    """`existing` without the rows of `runs`, and `new`: a run that now has no rows keeps none."""
    return existing.join(runs.select(by).distinct(), by, "left_anti").unionByName(new)


def insert_new(existing: DataFrame, new: DataFrame, key: list[str], order: list[Column | str] | None = None) -> DataFrame:
    """`existing` and the rows of `new` whose key it lacks; of those with one key the first by `order`."""
    item = F.struct(*(order or []), *[F.col(c).alias(f"v_{c}") for c in new.columns if c not in key])
    first = new.groupBy(*key).agg(F.min(item).alias("__row"))
    rows = first.select(*[c if c in key else F.col(f"__row.v_{c}").alias(c) for c in new.columns])
    return existing.unionByName(rows.join(existing.select(*key), key, "left_anti"))


def upsert(existing: DataFrame, new: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """The table after an upsert on `key`: rows of `new` replace those they meet but for the columns
    `keep` (an id, a creation time), which stay; the others are added."""
    old = existing.select(*[F.col(c) if c in key else F.col(c).alias(f"__old_{c}") for c in existing.columns], F.lit(True).alias("__old"))
    joined = old.join(new.withColumn("__new", F.lit(True)), key, "full_outer")
    took = lambda c: F.col(f"__old_{c}") if c not in new.columns else F.when(F.col("__new").isNull() | (F.col("__old") if c in keep else F.lit(False)), F.col(f"__old_{c}")).otherwise(F.col(c))
    return joined.select(*[F.col(c) if c in key else took(c).alias(c) for c in existing.columns])


def cascade(gone: DataFrame, tables: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """What stays of each table when the rows that `gone` names are removed with all beneath them.

    `gone` has one column, the key of the first table. tables: (rows, key, key of the table above);
    for the first table the last of these is its own key.
    """
    out, column = [], gone.columns[0]
    for rows, key, above in tables:
        lost = gone.select(F.col(column).alias(above)).distinct()
        out.append(rows.join(lost, above, "left_anti"))
        gone, column = rows.join(lost, above, "left_semi").select(key), key
    return out
