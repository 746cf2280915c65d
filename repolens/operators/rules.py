"""Quality rules. A rule is a function of a Context to findings; a run joins the rules' findings."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_all
from ..schemas import FINDING
from .lines import numbered_lines


@dataclass(frozen=True)
class Thresholds:
    complexity_high: int = 10
    file_too_large_lines: int = 500
    function_too_long_lines: int = 80
    too_many_parameters: int = 5


@dataclass(frozen=True)
class Context:
    """files(run_id, file_id, path, content), symbols and metrics of the runs."""

    files: DataFrame
    symbols: DataFrame
    metrics: DataFrame
    thresholds: Thresholds = Thresholds()


Rule = Callable[[Context], DataFrame]


FOUND = "array<struct<rule_id:string,severity:string,message:string,line:int,column:int,metadata:map<string,string>>>"


def _finding(rule_id: str, severity: Column, message: Column, line: Column, **metadata: Column) -> Column:
    pairs = [x for name, value in metadata.items() for x in (F.lit(name), value.cast("string"))]
    return F.struct(
        F.lit(rule_id).alias("rule_id"), severity.alias("severity"), message.alias("message"),
        line.cast("int").alias("line"), F.lit(None).cast("int").alias("column"), F.create_map(*pairs).alias("metadata"),
    )


def _emitted(rows: DataFrame, *found: Column) -> DataFrame:
    """The findings that each row gives; null is none."""
    some = F.filter(F.array(*found), lambda f: f.isNotNull()).cast(FOUND)
    return rows.select("run_id", "file_id", F.inline(some))


def _above(value: Column, limit: int) -> Column:
    return F.when(value > 2 * limit, "HIGH").otherwise("MEDIUM")


def _callable(value: Column, limit: int) -> Column:
    return F.col("kind").isin("FUNCTION", "METHOD") & (value > limit)


def _complexity(t: Thresholds) -> Column:
    limit, value = t.complexity_high, F.col("complexity")
    message = F.format_string(f"%s has a cyclomatic complexity of %d, above the configured threshold of {limit}", "name", value)
    return F.when(_callable(value, limit), _finding("COMPLEXITY_HIGH", _above(value, limit), message, F.col("start_line"), symbol=F.col("name"), complexity=value, threshold=F.lit(limit)))


def _length(t: Thresholds) -> Column:
    limit, value = t.function_too_long_lines, F.col("end_line") - F.col("start_line") + 1
    message = F.format_string(f"%s spans %d lines, above the configured threshold of {limit}", "name", value)
    return F.when(_callable(value, limit), _finding("FUNCTION_TOO_LONG", _above(value, limit), message, F.col("start_line"), symbol=F.col("name"), length=value, threshold=F.lit(limit)))


def _parameters(t: Thresholds) -> Column:
    limit, value = t.too_many_parameters, F.col("parameter_count")
    message = F.format_string(f"%s has %d parameters, above the configured threshold of {limit}", "name", value)
    return F.when(_callable(value, limit), _finding("TOO_MANY_PARAMETERS", F.lit("LOW"), message, F.col("start_line"), symbol=F.col("name"), parameterCount=value, threshold=F.lit(limit)))


def complexity_high(c: Context) -> DataFrame:
    return _emitted(c.symbols, _complexity(c.thresholds))


def function_too_long(c: Context) -> DataFrame:
    return _emitted(c.symbols, _length(c.thresholds))


def too_many_parameters(c: Context) -> DataFrame:
    return _emitted(c.symbols, _parameters(c.thresholds))


def file_too_large(c: Context) -> DataFrame:
    limit, value = c.thresholds.file_too_large_lines, F.col("line_count")
    message = F.format_string(f"%s has %d lines, above the configured threshold of {limit}", "path", value)
    return _emitted(c.metrics.where(value > limit), _finding("FILE_TOO_LARGE", _above(value, limit), message, F.lit(None), lineCount=value, threshold=F.lit(limit)))


def todo_comment(c: Context) -> DataFrame:
    pattern = r"\b(TODO|FIXME)\b:?\s*(.*)"
    # a file without a marker is not exploded to lines
    some = c.files.where(F.col("content").rlike("TODO|FIXME")).select("run_id", "file_id", "content")
    rows = numbered_lines(some).where(F.col("text").rlike(pattern))
    rest = trim_all(F.regexp_extract("text", pattern, 2))
    marker = F.regexp_extract("text", pattern, 1)
    detail = F.when(rest != "", rest).otherwise(trim_all(F.col("text")))
    message = F.substring(F.concat(marker, F.lit(" comment: "), detail), 1, 240)
    return _emitted(rows, _finding("TODO_COMMENT", F.lit("INFO"), message, F.col("line"), marker=marker))


DEFAULT_RULES: tuple[Rule, ...] = (complexity_high, file_too_large, function_too_long, too_many_parameters, todo_comment)
#: Rules that look at one symbol: a run takes them together in one pass over the symbols.
OF_SYMBOLS: dict[Rule, Callable[[Thresholds], Column]] = {complexity_high: _complexity, function_too_long: _length, too_many_parameters: _parameters}


def run_rules(context: Context, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame | None:
    """Findings of all rules. A rule whose plan cannot be made is left out with a warning; one that
    fails while it runs fails the job. None if no rule is left."""
    together = [OF_SYMBOLS[rule] for rule in rules if rule in OF_SYMBOLS]
    out = _emitted(context.symbols, *[made(context.thresholds) for made in together]).select(*FINDING) if together else None
    for rule in rules:
        if rule in OF_SYMBOLS:
            continue
        try:
            found = rule(context).select(*FINDING)
        except Exception:  # noqa: BLE001  a user's rule may raise anything
            logging.getLogger(__name__).warning("rule %s was skipped", getattr(rule, "__name__", rule), exc_info=True)
            continue
        out = found if out is None else out.unionByName(found)
    return out


def run_summary(files: DataFrame, symbols: DataFrame, imports: DataFrame, findings: DataFrame) -> DataFrame:
    """(run_id, files_analyzed, symbols_found, imports_found, findings_count)."""
    counts = [
        t.groupBy("run_id").agg(F.count("*").alias(name))
        for t, name in ((files, "files_analyzed"), (symbols, "symbols_found"), (imports, "imports_found"), (findings, "findings_count"))
    ]
    out = counts[0]
    for own in counts[1:]:
        out = out.join(own, "run_id", "left")
    return out.fillna(0, ["symbols_found", "imports_found", "findings_count"])
