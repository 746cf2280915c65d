"""Evidence for agents, their validated outputs, and the reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import AI_SEVERITIES, HEALTH, SEVERITIES, rank
from .reports import severity_counts

LARGEST_FILES, RELEVANT_FINDINGS, CONTEXT_RESULTS, CONTEXT_CHARACTERS, SEARCH_LIMIT = 8, 15, 8, 6000, 12
DIGEST_FINDINGS = 5
SUMMARY_AGENT = "EXECUTIVE_SUMMARY"

# The primary agents, their titles, searches, and the rules that they look at (None: all).
AGENTS = [
    ("ARCHITECTURE", "Architecture Agent", "module boundaries application layers service architecture entry points routing controllers", None),
    ("CODE_QUALITY", "Code Quality Agent", "complex function long method large file duplicated logic", ["COMPLEXITY_HIGH", "FILE_TOO_LARGE", "FUNCTION_TOO_LONG", "TOO_MANY_PARAMETERS", "TODO_COMMENT"]),
    ("SECURITY", "Security Agent", "authentication password secret token encryption sql query exec eval deserialize crypto hash", None),
    ("PERFORMANCE", "Performance Agent", "loop query database fetch map filter synchronous await promise cache recompute", None),
    ("DEPENDENCY_RISK", "Dependency / Architecture Risk Agent", "import export module dependency require circular", None),
    ("DOCUMENTATION", "Documentation / Maintainability Agent", "public api exported function class interface documentation comment readme", ["TODO_COMMENT", "FILE_TOO_LARGE", "COMPLEXITY_HIGH"]),
]
SPECS = "agent string, title string, retrieval_query string, relevant_rule_ids array<string>"

CITATION = "struct<filePath:string,startLine:int,endLine:int,symbolName:string>"
FINDING = f"struct<category:string,title:string,summary:string,severity:string,confidence:double,evidence:string,recommendation:string,citations:array<{CITATION}>,affectedFiles:array<string>>"
PRIMARY = f"summary string, findings array<{FINDING}>"
EXECUTIVE = f"overallHealth string, summary string, strengths array<string>, topRisks array<{FINDING}>, recommendedNextSteps array<string>"


def agent_specs(spark) -> DataFrame:
    return spark.createDataFrame(AGENTS, SPECS)


def largest_files(metrics: DataFrame, n: int = LARGEST_FILES) -> DataFrame:
    """The n files of most lines of each run; ties by path."""
    order = Window.partitionBy("run_id").orderBy(F.desc("line_count"), "path")
    return metrics.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("run_id", "rank", "path", "line_count", "complexity")


def relevant_findings(findings: DataFrame, specs: DataFrame, files: DataFrame, n: int = RELEVANT_FINDINGS) -> DataFrame:
    """Up to n findings for each run and agent, INFO first, then by path, line, rule and message."""
    wanted = findings.crossJoin(F.broadcast(specs.select("agent", "relevant_rule_ids")))
    wanted = wanted.where(F.col("relevant_rule_ids").isNull() | F.array_contains("relevant_rule_ids", F.col("rule_id")))
    named = wanted.join(files.select("run_id", "file_id", "path"), ["run_id", "file_id"], "left")
    order = Window.partitionBy("run_id", "agent").orderBy(rank(F.col("severity"), SEVERITIES), "created_at", "path", "line", "rule_id", "message")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("run_id", "agent", "rank", "rule_id", "severity", "message", "path", "line")


def evidence_records(runs: DataFrame, repositories: DataFrame, specs: DataFrame, findings: DataFrame, metrics: DataFrame, files: DataFrame, contexts: DataFrame) -> DataFrame:
    """One nested row for each run and agent.

    runs(run_id, repository_id, four counts); contexts(run_id, agent, chunks) of budgeted results. Null
    counts read as 0; a run without findings has zero severity counts, one without chunks no chunks.
    """
    counts = ["files_analyzed", "symbols_found", "imports_found", "findings_count"]
    base = runs.join(repositories.select("repository_id", "full_name", "description", "default_branch"), "repository_id")
    base = base.fillna(0, counts).crossJoin(F.broadcast(specs.select("agent", "title")))
    levels = severity_counts(findings).select("run_id", F.struct(*SEVERITIES).alias("severity_counts"))
    top = largest_files(metrics).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "line_count", "complexity"))).alias("largest_files"))
    seen = relevant_findings(findings, specs, files).groupBy("run_id", "agent").agg(F.array_sort(F.collect_list(F.struct("rank", "rule_id", "severity", "message", "path", "line"))).alias("relevant_findings"))
    whole = base.join(levels, "run_id", "left").join(top, "run_id", "left").join(seen, ["run_id", "agent"], "left").join(contexts.select("run_id", "agent", "chunks"), ["run_id", "agent"], "left")
    none = F.struct(*[F.lit(0).cast("long").alias(s) for s in SEVERITIES])
    empty = {c: F.coalesce(c, F.array().cast(whole.schema[c].dataType)) for c in ("largest_files", "relevant_findings", "chunks")}
    return whole.withColumns(empty | {"severity_counts": F.coalesce("severity_counts", none)})


def evidence_text(record: DataFrame) -> DataFrame:
    """(run_id, agent, evidence): one deterministic text for each record."""
    # The wording of the lines below.
    text = lambda c: F.col(c).cast("string")
    level = lambda s: F.concat(F.lit(s + " "), F.col(f"severity_counts.{s}").cast("string"))
    head = F.array(
        F.concat(F.lit("Repository: "), F.col("full_name"), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" — "), F.col("description"))).otherwise("")),
        F.concat(F.lit("Default branch: "), F.col("default_branch")),
        F.lit(""),
        F.lit("## Deterministic analysis summary (Phase 4 — real, measured data, not an estimate)"),
        F.concat(F.lit("Files analyzed: "), text("files_analyzed")),
        F.concat(F.lit("Symbols found: "), text("symbols_found")),
        F.concat(F.lit("Imports found: "), text("imports_found")),
        F.concat(F.lit("Total deterministic findings: "), text("findings_count"), F.lit(" ("), F.concat_ws(", ", *[level(s) for s in AI_SEVERITIES]), F.lit(")")),
    )
    file_line = lambda f: F.concat(F.lit("- "), f["path"], F.lit(": "), f["line_count"].cast("string"), F.lit(" lines"), F.when(f["complexity"].isNotNull(), F.concat(F.lit(", complexity "), f["complexity"].cast("string"))).otherwise(""))
    files = F.when(F.size("largest_files") > 0, F.concat(F.array(F.lit(""), F.lit("Largest/most complex files:")), F.transform("largest_files", file_line))).otherwise(F.array().cast("array<string>"))
    place = lambda f: F.when(f["path"].isNotNull(), F.concat(F.lit(" ("), f["path"], F.when(f["line"].isNotNull(), F.concat(F.lit(":"), f["line"].cast("string"))).otherwise(""), F.lit(")"))).otherwise("")
    finding_line = lambda f: F.concat(F.lit("- ["), f["severity"], F.lit("] "), f["rule_id"], F.lit(": "), f["message"], place(f))
    seen = F.when(F.size("relevant_findings") > 0, F.concat(F.array(F.lit(""), F.lit("Relevant deterministic findings:")), F.transform("relevant_findings", finding_line))).otherwise(F.array(F.lit(""), F.lit("No relevant deterministic findings for this agent's focus area.")))
    chunk_lines = lambda c: F.array(F.lit(""), F.concat(F.lit("### "), c["citation"], F.when(F.coalesce(c["symbol_name"], F.lit("")) != "", F.concat(F.lit(" — "), c["symbol_name"])).otherwise("")), F.lit("```"), c["content"], F.lit("```"))
    tail = F.concat(
        F.array(F.lit(""), F.lit("## Retrieved source code evidence (semantic + lexical search, scoped to this agent's focus area)")),
        F.when(F.size("chunks") == 0, F.array(F.lit("(no relevant chunks were retrieved)"))).otherwise(F.flatten(F.transform("chunks", chunk_lines))),
    )
    return record.select("run_id", "agent", F.array_join(F.concat(head, files, seen, tail), "\n").alias("evidence"))


def _between(text: Column, most: int) -> Column:
    return F.coalesce(F.length(text).between(1, most), F.lit(False))


def _good_finding(f: Column) -> Column:
    cited = F.forall(f["citations"], lambda c: c.isNotNull() & (F.length(c["filePath"]) > 0) & (F.coalesce(c["startLine"], F.lit(1)) > 0) & (F.coalesce(c["endLine"], F.lit(1)) > 0))
    checks = [
        _between(f["category"], 60), _between(f["title"], 200), _between(f["summary"], 2000), f["severity"].isin(AI_SEVERITIES),
        f["confidence"].between(0, 1), _between(f["evidence"], 2000), _between(f["recommendation"], 1000),
        F.size(f["citations"]).between(1, 10), cited, f["affectedFiles"].isNull() | (F.size(f["affectedFiles"]) <= 20),
    ]
    ok = F.lit(True)
    for check in checks:
        ok = ok & F.coalesce(check, F.lit(False))
    return ok


def _listed(items: Column, most: int, good) -> Column:
    return F.coalesce((F.size(items) <= most) & F.forall(items, good), F.lit(False))


def validate_outputs(outputs: DataFrame) -> DataFrame:
    """`outputs(ai_run_id, agent, result)` with `parsed` fields and `reason`: null if the JSON has the
    agent's shape and bounds, else what is wrong first (json, summary, findings, health, strengths,
    next_steps).

    The summary agent's findings are its topRisks. A result that is null or no JSON object is `json`.
    """
    executive = F.col("agent") == SUMMARY_AGENT
    parsed = outputs.withColumn("__p", F.when(~executive, F.from_json("result", PRIMARY))).withColumn("__e", F.when(executive, F.from_json("result", EXECUTIVE)))
    summary, findings = F.coalesce("__p.summary", "__e.summary"), F.coalesce("__p.findings", "__e.topRisks")
    broken = F.col("result").isNull() | F.get_json_object("result", "$").isNull() | ~F.trim("result").startswith("{")
    reason = (
        F.when(broken, "json")
        .when(~F.when(executive, _between(summary, 3000)).otherwise(_between(summary, 2000)), "summary")
        .when(~F.when(executive, _listed(findings, 10, _good_finding)).otherwise(_listed(findings, 20, _good_finding)), "findings")
        .when(executive & ~F.coalesce(F.col("__e.overallHealth").isin(HEALTH), F.lit(False)), "health")
        .when(executive & ~_listed(F.col("__e.strengths"), 10, lambda s: _between(s, 300)), "strengths")
        .when(executive & ~_listed(F.col("__e.recommendedNextSteps"), 10, lambda s: _between(s, 300)), "next_steps")
    )
    return parsed.withColumns({"summary": summary, "findings": findings, "reason": reason}).drop("__p", "__e")


def finding_rows(validated: DataFrame) -> DataFrame:
    """A row for each finding of the valid outputs, `position` from 0."""
    rows = validated.where("reason is null").select("ai_run_id", "agent", F.posexplode("findings").alias("position", "f"))
    return rows.select("ai_run_id", "agent", F.concat_ws("/", "ai_run_id", "agent").alias("agent_run_id"), "position", "f.category", "f.title", "f.summary", "f.severity", "f.confidence", "f.evidence", "f.recommendation", "f.citations")


def seed_agent_runs(ai_runs: DataFrame) -> DataFrame:
    """Seven PENDING agent rows for each run."""
    names = [name for name, *_ in AGENTS] + [SUMMARY_AGENT]
    each = F.explode(F.array(*[F.lit(n) for n in names])).alias("agent")
    return ai_runs.select("ai_run_id", each).select("ai_run_id", "agent", F.concat_ws("/", "ai_run_id", "agent").alias("agent_run_id"), F.lit("PENDING").alias("status"))


def roll_up(agent_runs: DataFrame) -> DataFrame:
    """(ai_run_id, status, summary_status): FAILED with the summary SKIPPED if no primary agent is
    COMPLETED; with warnings if not all of them or not the summary; else COMPLETED."""
    primary, done = F.col("agent") != SUMMARY_AGENT, F.col("status") == "COMPLETED"
    counted = agent_runs.groupBy("ai_run_id").agg(F.count_if(primary & done).alias("done"), F.count_if(primary & F.coalesce(~done, F.lit(True))).alias("failed"), F.max(F.when(~primary, F.col("status"))).alias("summary"))
    none = F.col("done") == 0
    status = F.when(none, "FAILED").when((F.col("failed") > 0) | (F.coalesce("summary", F.lit("")) != "COMPLETED"), "COMPLETED_WITH_WARNINGS").otherwise("COMPLETED")
    return counted.select("ai_run_id", status.alias("status"), F.when(none, "SKIPPED").otherwise(F.col("summary")).alias("summary_status"))


def executive_digest(validated: DataFrame, specs: DataFrame) -> DataFrame:
    """(ai_run_id, digest): the primary agents' summaries and first findings as one text, in agent order."""
    order = F.array(*[F.lit(name) for name, *_ in AGENTS])
    rows = validated.where((F.col("reason").isNull()) & (F.col("agent") != SUMMARY_AGENT)).join(F.broadcast(specs.select("agent", "title")), "agent")
    line = lambda f: F.concat(F.format_string("- [%s, confidence %.2f] %s: %s — citations: ", f["severity"], f["confidence"], f["title"], f["summary"]), F.to_json(f["citations"], {"ignoreNullFields": "false"}))
    body = F.when(F.size("findings") == 0, F.array(F.lit("(no findings)"))).otherwise(F.concat(F.array(F.lit("Findings:")), F.transform(F.slice("findings", 1, DIGEST_FINDINGS), line)))
    part = F.array_join(F.concat(F.array(F.concat(F.lit("## "), F.col("title")), F.col("summary")), body, F.array(F.lit(""))), "\n")
    own = rows.select("ai_run_id", F.struct(F.array_position(order, F.col("agent")).alias("place"), part.alias("part")).alias("p"))
    return own.groupBy("ai_run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "\n").alias("digest"))


def agent_cards(agent_runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Each agent run with its findings nested in order."""
    item = F.struct("position", "title", "severity", "confidence")
    nested = findings.groupBy("agent_run_id").agg(F.array_sort(F.collect_list(item)).alias("findings"))
    joined = agent_runs.join(nested, "agent_run_id", "left")
    return joined.withColumn("findings", F.coalesce("findings", F.array().cast(nested.schema["findings"].dataType)))


def agent_progress(agent_runs: DataFrame) -> DataFrame:
    """(ai_run_id, agents, completed)."""
    return agent_runs.groupBy("ai_run_id").agg(F.count("*").alias("agents"), F.count_if(F.col("status") == "COMPLETED").alias("completed"))
