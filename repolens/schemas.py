"""Orders and sets of status and severity values, and the columns of the result tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The declaration order of each enum is its sort order.
SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
AI_SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
HEALTH = ["EXCELLENT", "GOOD", "FAIR", "POOR", "CRITICAL"]

# Statuses in which a run counts as active.
ACTIVE = {
    "ingestion": ["PENDING", "QUEUED", "RETRIEVING", "EXTRACTING", "SCANNING"],
    "analysis": ["PENDING", "QUEUED", "PARSING", "INDEXING", "ANALYZING"],
    "embedding": ["PENDING", "QUEUED", "EMBEDDING"],
    "ai": ["PENDING", "QUEUED", "RUNNING"],
}

FINDING = ["run_id", "file_id", "rule_id", "severity", "message", "line", "column", "metadata"]
SYMBOL = "run_id string, file_id string, ordinal int, name string, kind string, start_line int, end_line int, exported boolean, parent_name string, signature string, parameter_count int"


def rank(value: Column, order: list[str]) -> Column:
    """The place of an enum value in its order, from 1."""
    return F.array_position(F.array(*[F.lit(x) for x in order]), value)
