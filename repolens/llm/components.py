"""Connected components of an edge list as Spark joins, with a table written each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept, new_table, removed, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least of u and its neighbours."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges(u, v)`: root is the least node reachable.

    Large-star and small-star rounds until nothing changes; every star then points at its root.
    Edges with a null end and loops are ignored; no edges give no rows. A node of very many edges is
    only ever one side of an equi-join, which adaptive execution splits.
    """
    spark, label = edges.sparkSession, "components"
    before, path = None, new_table(spark, label)
    now = written(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), label, path)
    while True:
        next_path = new_table(spark, label)
        now = written(_small_star(_large_star(now)), label, next_path)
        removed(spark, path)
        path = next_path
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    found = kept(roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
    removed(spark, path)
    return found
