"""Hybrid retrieval, context budgets, citations and retrieval quality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import small_enough, stored

SEMANTIC, LEXICAL = 0.75, 0.25
POOL_FACTOR, POOL_MOST = 4, 100
#: Rows of a block of chunks and of a block of queries.
CHUNK_BLOCK, QUERY_BLOCK = 2_048, 512


def query_tokens(query: Column) -> Column:
    """Runs of ASCII letters, digits and underscores of two characters or more, repeats included."""
    return F.filter(F.split(query, r"[^a-zA-Z0-9_]+", -1), lambda t: F.length(t) >= 2)


def lexical_score(query: Column, content: Column, symbol: Column) -> Column:
    """The share of tokens found in content or symbol, whatever the case; at least 0.95 if one is the
    symbol; null without tokens."""
    tokens = F.transform(query_tokens(query), F.lower)
    text, name = F.lower(F.coalesce(content, F.lit(""))), F.lower(F.coalesce(symbol, F.lit("")))
    hits = F.size(F.filter(tokens, lambda t: text.contains(t) | name.contains(t)))
    exact = F.exists(tokens, lambda t: t == name)
    share = hits / F.size(tokens)
    return F.when(F.size(tokens) > 0, F.when(hits == 0, 0.0).when(exact, F.greatest(share, F.lit(0.95))).otherwise(share))


def _best(scored: DataFrame, pool: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("semantic_score"), "chunk_id")
    return scored.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= pool).drop("__n")


def _vectors(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of the vectors: rows with a vector without nulls, and these as a matrix."""
    lists = column.combine_chunks().cast(pa.list_(pa.float64()))
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    values = lists.flatten()
    hole = np.zeros(len(size) + 1, np.int64)
    np.add.at(hole, np.repeat(np.arange(len(size)), size), pc.is_null(values).to_numpy(zero_copy_only=False))
    flat, at = values.to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
    out = {}
    for width in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero((size == width) & (hole[:-1] == 0))
        out[width] = rows, flat[at[rows][:, None] + np.arange(width)].astype(np.float64)
    return out


def _block_scores(pool: int):
    """Of a block of chunks and a block of queries: each query's `pool` nearest chunks, and those that tie."""

    def run(chunks: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        left, right = _vectors(chunks["embedding"]), _vectors(asked["vector"])
        for width in left.keys() & right.keys():
            (rows, a), (wanted, b) = left[width], right[width]
            sizes = np.sqrt((b * b).sum(axis=1))[:, None] * np.sqrt((a * a).sum(axis=1))[None, :]
            with np.errstate(invalid="ignore", divide="ignore"):
                scores = np.where(sizes > 0, b @ a.T / sizes, np.nan)
            known = ~np.isnan(scores)
            low = np.where(known, scores, -np.inf)
            if len(rows) > pool:
                least = np.partition(low, len(rows) - pool, axis=1)[:, len(rows) - pool]
                known &= low >= least[:, None]
            i, j = np.nonzero(known)
            found.append((wanted[i], rows[j], scores[i, j]))
        i, j, score = (np.concatenate([x[k] for x in found]) if found else np.empty(0) for k in range(3))
        take = lambda table, c, at: table[c].combine_chunks().take(pa.array(at.astype(np.int64)))
        return pa.table({"query_id": take(asked, "query_id", i), "chunk_id": take(chunks, "chunk_id", j), "semantic_score": pa.array(score.astype(np.float64))})

    return run


def candidates(queries: DataFrame, chunks: DataFrame, limit: int = 10, chunk_block: int = CHUNK_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The pool of each query: its repository's chunks nearest by cosine, min(4 * limit, 100) of them,
    exactly; ties to the smaller chunk_id. What is ranked is ids and scores; the chunks of the pools,
    and the queries, are joined to them after it.

    queries(query_id, repository_id, query, vector); chunks(chunk_id, repository_id, content,
    symbol_name, embedding, ...), each with ids of its own. Chunks without a vector, and pairs without a
    cosine, take no part. A repository's chunks and queries are dealt to blocks of about `chunk_block` and
    `query_block` rows; each pair of blocks is one matrix product in a group of its own, so a repository that has
    most chunks is spread over tasks, and no task holds more than two blocks. Chunks of repositories without
    a query are not shuffled.
    """
    pool = min(POOL_FACTOR * limit, POOL_MOST)
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "repository_id", "query", "vector")
    there = chunks.where("embedding is not null")
    parts = there.groupBy("repository_id").agg(F.ceil(F.count("*") / chunk_block).cast("int").alias("parts"))
    blocks = asked.groupBy("repository_id").agg(F.ceil(F.count("*") / query_block).cast("int").alias("blocks"))
    dealt = small_enough(stored(parts.join(blocks, "repository_id"), "blocks"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one_of = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    # queries may come from the chunks themselves: the keys of the two sides have names of their own
    left = there.select("repository_id", "chunk_id", "embedding").join(dealt, "repository_id").withColumn("part", one_of("chunk_id", "parts")).withColumn("block", each("blocks")).drop("parts", "blocks")
    right = asked.select("repository_id", "query_id", "vector").join(dealt, "repository_id").withColumn("block", one_of("query_id", "blocks")).withColumn("part", each("parts")).drop("parts", "blocks")
    schema = T.StructType([T.StructField("query_id", T.StringType()), chunks.schema["chunk_id"], T.StructField("semantic_score", T.DoubleType())])
    key = ["repository_id", "part", "block"]
    own, their = (side.select(*[F.col(k).alias(f"{name}_{k}") for k in key], *rest) for side, name, rest in ((left, "chunks", ("chunk_id", "embedding")), (right, "asked", ("query_id", "vector"))))
    scored = own.groupBy(*own.columns[:3]).cogroup(their.groupBy(*their.columns[:3])).applyInArrow(_block_scores(pool), schema)
    return _best(scored, pool).join(asked.select("query_id", "query"), "query_id").join(there.drop("embedding"), "chunk_id")


def hybrid_rank(pool: DataFrame, limit: int = 10) -> DataFrame:
    """The best `limit` of each pool by 0.75 semantic + 0.25 lexical (semantic alone without tokens),
    then by semantic score, then by chunk_id; `rank` from 1."""
    lexical = lexical_score(F.col("query"), F.col("content"), F.col("symbol_name"))
    final = F.when(F.col("lexical_score").isNull(), F.col("semantic_score")).otherwise(SEMANTIC * F.col("semantic_score") + LEXICAL * F.col("lexical_score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), F.desc("semantic_score"), "chunk_id")
    ranked = pool.withColumn("lexical_score", lexical).withColumn("final_score", final).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= limit)


def search(queries: DataFrame, chunks: DataFrame, limit: int = 10) -> DataFrame:
    if not 1 <= limit <= 50:
        raise ValueError("limit is from 1 to 50")
    return hybrid_rank(candidates(queries, chunks, limit), limit)


def agent_queries(repositories: DataFrame, specs: DataFrame) -> DataFrame:
    """Every agent's query for every repository; `specs` is the fixed table of agents."""
    return repositories.select("repository_id").crossJoin(F.broadcast(specs.select("agent", F.col("retrieval_query").alias("query")))).withColumn("query_id", F.concat_ws("/", "repository_id", "agent"))


def citation(path: Column, start: Column, end: Column) -> Column:
    """path:a-b, path:a, or path where a line is null."""
    where = F.when(start == end, F.concat(path, F.lit(":"), start.cast("string"))).otherwise(F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")))
    return F.when(start.isNotNull() & end.isNotNull(), where).otherwise(path)


def build_context(results: DataFrame, max_results: int = 10, max_characters: int = 12_000) -> DataFrame:
    """Per query, in rank order, the chunks that fit the budget: one that does not fit is skipped and
    the next is tried. (query_id, chunks, total_characters, truncated).

    A query has at most 50 results, so its list is small.
    """
    item = F.struct("rank", "chunk_id", "file_path", "symbol_name", "start_line", "end_line", "content", F.col("final_score").alias("score"), citation(F.col("file_path"), F.col("start_line"), F.col("end_line")).alias("citation"))
    gathered = results.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = gathered.schema["items"].dataType.simpleString()
    start = F.struct(F.array().cast(kind).alias("chunks"), F.lit(0).alias("total"), F.lit(0).alias("cut"))

    def step(s: Column, x: Column) -> Column:
        n = F.length(x["content"])
        fits = (F.size(s["chunks"]) < max_results) & (s["total"] + n <= max_characters)
        return F.struct(F.when(fits, F.concat(s["chunks"], F.array(x))).otherwise(s["chunks"]).alias("chunks"), F.when(fits, s["total"] + n).otherwise(s["total"]).alias("total"), F.when(fits, s["cut"]).otherwise(s["cut"] + 1).alias("cut"))

    folded = gathered.withColumn("s", F.aggregate("items", start, step))
    return folded.select("query_id", F.col("s.chunks").alias("chunks"), F.col("s.total").alias("total_characters"), F.col("s.cut").alias("truncated"))


def recall(results: DataFrame, expected: DataFrame, at: tuple[int, ...] = (5, 10)) -> DataFrame:
    """One row: the share of `expected(query_id, expected_file)` whose file is among the first k files of
    its query's results, a file ranked by its first chunk."""
    files = results.groupBy("query_id", "file_path").agg(F.min("rank").alias("first"))
    placed = files.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "file_path")))
    hit = expected.join(placed, (placed["query_id"] == expected["query_id"]) & (F.col("file_path") == F.col("expected_file")), "left")
    return hit.agg(*[F.avg(F.coalesce((F.col("place") <= k).cast("double"), F.lit(0.0))).alias(f"recall_at_{k}") for k in at])
