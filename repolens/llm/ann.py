"""Nearest neighbours by few stable projections and a kd-tree.

Vectors are brought to unit length and projected to `dims` Gaussian directions. Distances there,
squared, are those of the full space times a chi-square variable of `dims` degrees. A kd-tree on the
projections gives a query's projected neighbours in growing order; each is verified with its true
distance. When the next one is so far that a point nearer than the current k-th would show such a
projected distance with a chance under 1 - `sure` (chi-square test), the search ends.

Equal vectors are searched once: a class of them keeps its k + 1 smallest ids. Vectors of one length are a
space of their own. Queries go to all shards in blocks of bounded size; of several blocks each is searched
and its results are written before the next is sent.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .shared import written

#: Distinct vectors in one tree, bytes of queries in one block, points in a leaf.
SHARD, BLOCK_BYTES, LEAF = 8192, 16 << 20, 64


def chi_square_point(dims: int, sure: float) -> float:
    """Where the chi-square distribution of an even number of degrees reaches `sure`."""
    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < sure else (low, middle)
    return high


class Tree:
    """A kd-tree over projected points. `order` holds the points leaf by leaf; leaf i has those from
    at[i] to at[i + 1] and the box low[i] .. high[i]."""

    def __init__(self, points: np.ndarray) -> None:
        self.order, leaves = np.arange(len(points)), []
        parts = [(0, len(points))]
        while parts:
            a, b = parts.pop()
            own = points[self.order[a:b]]
            low, high = own.min(axis=0), own.max(axis=0)
            if b - a <= LEAF:
                leaves.append((a, low, high))
                continue
            middle = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, int(np.argmax(high - low))], middle)]
            parts += [(a + middle, b), (a, a + middle)]
        self.at = np.array([a for a, _, _ in leaves] + [len(points)])
        self.low, self.high = (np.array([x[i] for x in leaves]) for i in (1, 2))

    def nearest(self, query: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """Places in `order`, nearest leaves first in growing runs, with the squared distance below
        which every point has been given."""
        away = np.maximum(np.maximum(self.low - query, query - self.high), 0)
        gaps = np.einsum("ij,ij->i", away, away)
        rank = np.argsort(gaps, kind="stable")
        done, size = 0, 4
        while done < len(rank):
            own = rank[done : done + size]
            done, size = done + len(own), 2 * size
            yield K.ragged(self.at[own], self.at[own + 1] - self.at[own]), float(gaps[rank[done]]) if done < len(rank) else math.inf


def search(vectors: np.ndarray, ids: list, queries: np.ndarray, own: np.ndarray, k: int, dims: int, sure: float, seed: int) -> tuple[list[tuple[int, int, float]], int]:
    """(query row, id, cosine) of each query's k best in this shard, and how many vectors were verified for
    all queries together; ids[i] are the ids of vector i, own the id of each query."""
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    q_unit = queries / np.sqrt((queries * queries).sum(axis=1))[:, None]
    axes = np.random.default_rng(seed).standard_normal((vectors.shape[1], dims))
    tree, q_points, limit = Tree(unit @ axes), q_unit @ axes, chi_square_point(dims, sure)
    unit = unit[tree.order]
    ids = [ids[i] for i in tree.order.tolist()]
    out, verified = [], 0
    for i, (q, p) in enumerate(zip(q_unit, q_points, strict=True)):
        best: list[tuple[float, int]] = []
        for found, reach in tree.nearest(p):
            near = unit[found] @ q
            verified += len(found)
            worst = best[-1][0] if len(best) == k else -2.0
            if len(near) > k + 1:  # a class of copies counts as one, and one may be the query itself
                worst = max(worst, float(np.partition(near, len(near) - k - 1)[len(near) - k - 1]))
            some = found[near >= worst - 1e-9]
            exact = (unit[some] * q).sum(axis=1)  # equal vectors and pairs get equal sums, whatever the run
            best += [(c, x) for c, v in zip(exact.tolist(), some.tolist(), strict=True) for x in ids[v] if x != own[i]]
            best = sorted(best, key=lambda b: (-b[0], b[1]))[:k]
            if len(best) == k and reach >= limit * max(0.0, 2 - 2 * best[-1][0]):
                break
        out += [(i, x, c) for c, x in best]
    return out, verified


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding", dims: int = 8, sure: float = 0.95, seed: int = 7, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose key is divisible by `every` its k rows of
    largest cosine (double), itself not among them; nearest first, ties to the smaller key.

    Null keys, and vectors that are null, empty, zero, or hold null or non-finite components take no
    part; neighbours have the query's length. A key that repeats with the same vector is one row. Fewer
    candidates than k give all of them. Every vector is indexed.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    rows = rows.distinct()
    first = Window.partitionBy("v").orderBy("id")
    classes = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    count = rows.count()
    shards = max(1, -(-count // shard))
    dealt = classes.repartition(shards, F.xxhash64("v"))
    asked = rows.where(F.col("id") % every == 0)
    size = asked.agg(F.sum(8 * F.size("v"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    result = "query_id long, vec_id long, score double"
    parts = []
    for b in range(blocks):
        block = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).orderBy("id").toArrow()
        sent = spark.sparkContext.broadcast(_by_width(block["id"].combine_chunks(), block["v"].combine_chunks()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            K.alone("ann")
            own = [batch for batch in batches if len(batch)]
            if not own:
                return
            table = pa.Table.from_batches(own).combine_chunks()
            for width, (which, matrix) in _by_width(pa.array(np.arange(len(table))), table["v"].combine_chunks()).items():
                q_ids, queries = sent.value.get(width, ((), ()))
                if len(q_ids):
                    found, _ = search(matrix, table["ids"].take(pa.array(which)).to_pylist(), queries, q_ids, k, dims, sure, seed)
                    yield pa.RecordBatch.from_arrays([pa.array([int(q_ids[i]) for i, _, _ in found], pa.int64()), pa.array([int(x) for _, x, _ in found], pa.int64()), pa.array([c for _, _, c in found], pa.float64())], names=["query_id", "vec_id", "score"])

        found = dealt.select("v", "ids").mapInArrow(run, result)
        parts.append(found if blocks == 1 else written(found, "neighbours"))
        if blocks > 1:
            sent.destroy()
    out = functools.reduce(DataFrame.unionByName, parts)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_width(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The ids and vectors of each length, vectors as a matrix."""
    size = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat, at, own = vectors.flatten().to_numpy(zero_copy_only=False), K.bounds(size), ids.to_numpy(zero_copy_only=False)
    out = {}
    for width in np.unique(size).tolist():
        rows = np.flatnonzero(size == width)
        out[width] = (own[rows], flat[K.ragged(at[rows], size[rows])].reshape(len(rows), width).astype(np.float64))
    return out
