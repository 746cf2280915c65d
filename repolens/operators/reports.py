"""Reports over the results of analysis runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import AI_SEVERITIES, SEVERITIES, rank
from ..sources.shared import removed, shared_folder


def severity_counts(findings: DataFrame, by: str = "run_id", levels: list[str] = SEVERITIES) -> DataFrame:
    """One row per run with a count for each level, 0 where it has none."""
    return findings.groupBy(by).agg(*[F.count_if(F.col("severity") == level).alias(level) for level in levels])


def latest(runs: DataFrame, by: str, n: int = 1, tie: str = "id") -> DataFrame:
    """The newest n runs of each group by created_at; of equal ones those with the larger id."""
    order = Window.partitionBy(by).orderBy(F.desc("created_at"), F.desc(tie))
    return runs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


#: The order of findings is total: severity rank, created_at, run, path, line, rule, message.
_ORDER = ["created_at", "run_id", "path", "line", "rule_id", "message"]
#: Rows up to the end of a page that one task may hold; of a page beyond that, only its own partitions are read.
SHALLOW = 10_000


def _finding_order() -> list[Column]:
    return [rank(F.col("severity"), SEVERITIES), *map(F.col, _ORDER)]


def _selected(findings: DataFrame, **wanted: str | None) -> DataFrame:
    for column, value in wanted.items():
        findings = findings if value is None else findings.where(F.col(column) == value)
    return findings


def _with_paths(findings: DataFrame, files: DataFrame) -> DataFrame:
    return findings.join(files.select("run_id", "file_id", "path"), ["run_id", "file_id"], "left")


class OrderedRows:
    """Rows in a total order, written once in ranges of it, from which any page is read.

    The ranges and how many rows each has are made by Spark's range partitioning; a page reads the ranges that it
    lies in, so page 10,000 costs what page 1 does. What the driver holds is a count for each range.
    """

    def __init__(self, rows: DataFrame, order: list[Column], ranges: int | None = None) -> None:
        self.order, spark = order, rows.sparkSession
        n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = shared_folder(spark, "ordered")
        rows.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()).write.partitionBy("__range").parquet(self.path)
        schema = T.StructType([*rows.schema.fields, T.StructField("__range", T.IntegerType())])
        self.rows = spark.read.schema(schema).parquet(self.path)
        counts = {r[0]: r[1] for r in self.rows.groupBy("__range").count().collect()}
        self.counts = [counts.get(i, 0) for i in range(max(counts, default=-1) + 1)]
        self.total = sum(self.counts)

    def page(self, number: int, size: int) -> DataFrame:
        """Rows (number - 1) * size + 1 and on, `size` at most, in order."""
        first, at, within = (number - 1) * size, 0, []
        skipped = 0
        for i, n in enumerate(self.counts):
            if at < first + size and at + n > first:
                skipped = skipped if within else first - at
                within.append(i)
            at += n
        own = self.rows.where(F.col("__range").isin(within)).drop("__range") if within else self.rows.drop("__range").limit(0)
        return own.orderBy(*self.order).offset(max(skipped, 0)).limit(size)

    def remove(self) -> None:
        removed(self.rows)


def ordered_findings(findings: DataFrame, files: DataFrame, run_id: str | None = None, severity: str | None = None, rule_id: str | None = None, file_id: str | None = None, ranges: int | None = None) -> OrderedRows:
    """All findings that a filter leaves, with file paths, for many pages or deep ones: see `findings_page`."""
    rows = _selected(findings, run_id=run_id, severity=severity, rule_id=rule_id, file_id=file_id)
    return OrderedRows(_with_paths(rows, files), _finding_order(), ranges)


def findings_page(findings: DataFrame, files: DataFrame, run_id: str | None = None, severity: str | None = None, rule_id: str | None = None, file_id: str | None = None, page: int = 1, page_size: int = 50) -> tuple[DataFrame, DataFrame]:
    """A page of findings with file paths, INFO first, and the total (one row, `total`).

    The order is total: severity rank, created_at, run, path, line, rule, message. A page that ends within
    the first `SHALLOW` rows is the least rows of each task, merged; one beyond is read from `ordered_findings`.
    """
    if not 1 <= page_size <= 200 or page < 1:
        raise ValueError("page is from 1, page_size from 1 to 200")
    rows = _selected(findings, run_id=run_id, severity=severity, rule_id=rule_id, file_id=file_id)
    named, total = _with_paths(rows, files), rows.agg(F.count("*").alias("total"))
    if page * page_size > SHALLOW:
        return OrderedRows(named, _finding_order()).page(page, page_size), total
    return named.orderBy(*_finding_order()).offset((page - 1) * page_size).limit(page_size), total


def file_explorer(metrics: DataFrame, symbols: DataFrame, imports: DataFrame, findings: DataFrame) -> DataFrame:
    """`metrics` with symbol_count, import_total and finding_count per file, 0 where there are none."""
    out, key = metrics, ["run_id", "file_id"]
    for table, name in ((symbols, "symbol_total"), (imports, "import_total"), (findings.where("file_id is not null"), "finding_total")):
        out = out.join(table.groupBy(*key).agg(F.count("*").alias(name)), key, "left")
    return out.fillna(0, ["symbol_total", "import_total", "finding_total"])


def file_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols with the name of their parent symbol."""
    parents = symbols.select("run_id", F.col("symbol_id").alias("parent_id"), F.col("name").alias("parent_symbol_name"))
    return symbols.join(parents, ["run_id", "parent_id"], "left")


def file_imports(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """Imports with the path of the file they resolve to."""
    targets = files.select("run_id", F.col("file_id").alias("target_file_id"), F.col("path").alias("resolved_path"))
    return resolved.join(targets, ["run_id", "target_file_id"], "left")


def run_history(runs: DataFrame, by: str = "repository_id", n: int = 100) -> DataFrame:
    return latest(runs, by, n)


def repositories_with_latest(repositories: DataFrame, ingestions: DataFrame, analyses: DataFrame) -> DataFrame:
    """`repositories` with the latest ingestion and its analysis (null where there is none)."""
    newest = latest(ingestions, "repository_id").select("repository_id", F.col("id").alias("ingestion_id"), F.col("status").alias("ingestion_status"))
    own = analyses.select("ingestion_id", F.col("id").alias("analysis_id"), F.col("status").alias("analysis_status"), "findings_count")
    return repositories.join(newest, "repository_id", "left").join(own, "ingestion_id", "left")


def dashboard(repositories: DataFrame) -> DataFrame:
    """Totals per user over `repositories_with_latest`."""
    analyzed = (F.col("ingestion_status").isNotNull()) & (F.col("analysis_status") == "COMPLETED")
    return repositories.groupBy("user_id").agg(
        F.count("*").alias("repository_count"),
        F.count_if(F.col("ingestion_status") == "COMPLETED").alias("ingested_count"),
        F.count_if(analyzed).alias("analyzed_count"),
        F.sum(F.when(analyzed, F.coalesce("findings_count", F.lit(0))).otherwise(0)).alias("total_findings"),
    )


def text_filter(repositories: DataFrame, query: str) -> DataFrame:
    """Rows whose full_name or description holds the query, whatever the case; all for a blank query."""
    wanted = query.strip().lower()
    if not wanted:
        return repositories
    holds = lambda c: F.coalesce(F.lower(c).contains(wanted), F.lit(False))
    return repositories.where(holds(F.col("full_name")) | holds(F.col("description")))


def owned_by(rows: DataFrame, via: list[tuple[DataFrame, str]], repositories: DataFrame, user: Column) -> DataFrame:
    """Rows reached from a user's repositories: `via` names (table, key) from the rows' side to the
    repository's, each table holding its key and the next one; the last holds repository_id."""
    mine = repositories.where(F.col("user_id") == user).select("repository_id")
    keys = [key for _, key in via]
    for (table, key), above in zip(reversed(via), ["repository_id", *reversed(keys[1:])], strict=True):
        mine = table.join(mine, above, "left_semi").select(key)
    return rows.join(mine, keys[0] if keys else "repository_id", "left_semi")


def ai_findings_page(findings: DataFrame, agent_runs: DataFrame, severity: str | None = None, agent: str | None = None, min_confidence: float | None = None, page: int = 1, page_size: int = 50) -> tuple[DataFrame, DataFrame]:
    """A page of agents' findings, CRITICAL first, then by confidence; and the total."""
    rows = findings.join(agent_runs.select("agent_run_id", "agent"), "agent_run_id")
    rows = rows if severity is None else rows.where(F.col("severity") == severity)
    rows = rows if agent is None else rows.where(F.col("agent") == agent)
    rows = rows if min_confidence is None else rows.where(F.col("confidence") >= min_confidence)
    ordered = rows.orderBy(rank(F.col("severity"), AI_SEVERITIES), F.desc("confidence"), "agent_run_id", "position")
    return ordered.offset((page - 1) * page_size).limit(page_size), rows.agg(F.count("*").alias("total"))
