from __future__ import annotations

import json
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from repolens.operators import evidence, reports, runs, search
from repolens.schemas import SEVERITIES
from repolens.streaming import jobs


def test_lexical_scores(spark):
    rows = [("???", "x", None), ("PatientDashboard", "nothing", "PatientDashboard"), ("zzzznotfound", "text", "sym"), ("alpha beta", "has ALPHA", None), ("the the of", "the", None)]
    df = spark.createDataFrame(rows, "q string, c string, s string")
    got = [r[0] for r in df.select(search.lexical_score(F.col("q"), F.col("c"), F.col("s"))).collect()]
    assert got[0] is None and got[1] == 1.0 and got[2] == 0.0 and got[3] == 0.5 and abs(got[4] - 2 / 3) < 1e-9


def test_search_stays_in_its_repository(spark):
    chunks = spark.createDataFrame([("c1", "r1", "a.ts", "hashToken", 1, 2, "x", [1.0, 0.1]), ("c2", "r2", "b.ts", None, 1, 2, "x", [1.0, 0.0]), ("c3", "r1", "c.ts", None, None, None, "hash token", [1.0, 0.0]), ("c4", "r1", "d.ts", None, 1, 1, "x", None)], "chunk_id string, repository_id string, file_path string, symbol_name string, start_line int, end_line int, content string, embedding array<double>")
    asked = spark.createDataFrame([("q", "r1", "hashToken", [1.0, 0.0])], "query_id string, repository_id string, query string, vector array<double>")
    got = search.search(asked, chunks).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["c1", "c3"]
    assert abs(got[0]["final_score"] - (0.75 * got[0]["semantic_score"] + 0.25)) < 1e-9


def test_both_ways_of_scoring_agree(spark):
    import random

    rng = random.Random(2)
    vector = lambda n=4: [rng.choice([0.0, 1.0, -1.0, 0.5]) for _ in range(n)]
    rows = [(f"c{i:03}", f"r{i % 3}", "p", None, 1, 1, "x", vector(3 if i % 17 == 0 else 4) if i % 13 else None) for i in range(200)]
    chunks = spark.createDataFrame(rows, "chunk_id string, repository_id string, file_path string, symbol_name string, start_line int, end_line int, content string, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(f"q{i}", f"r{i % 4}", "x", vector() if i else None) for i in range(8)], "query_id string, repository_id string, query string, vector array<double>")
    pools = [{(r["query_id"], r["chunk_id"], round(r["semantic_score"], 9)) for r in search.candidates(asked, chunks, 5, *most).collect()} for most in ((100, 100), (7, 1), (1000, 3))]
    assert pools[0] == pools[1] == pools[2] and len(pools[0]) > 60


def results(spark, sizes):
    rows = [("q", i + 1, f"c{i}", "p.ts", None, 90 if i == 0 else 42, 121 if i == 0 else 42, "x" * n, 1.0) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "query_id string, rank int, chunk_id string, file_path string, symbol_name string, start_line int, end_line int, content string, final_score double")


def test_contexts_skip_and_go_on(spark):
    got = search.build_context(results(spark, [50, 50, 50]), 10, 100).first()
    assert [c["chunk_id"] for c in got["chunks"]] == ["c0", "c1"] and (got["total_characters"], got["truncated"]) == (100, 1)
    assert [c["citation"] for c in got["chunks"]] == ["p.ts:90-121", "p.ts:42"]
    got = search.build_context(results(spark, [90, 5]), 10, 50).first()
    assert [c["chunk_id"] for c in got["chunks"]] == ["c1"] and got["truncated"] == 1
    assert search.build_context(results(spark, [1, 1, 1]), 2, 50).first()["truncated"] == 1


def test_staleness_and_plans(spark):
    now = datetime(2024, 1, 1, 12)
    rows = [("r", f"c{i}", f"i{i}", s, now - timedelta(minutes=m)) for i, (s, m) in enumerate([("SCANNING", 1), ("SCANNING", 31), ("COMPLETED", 99), ("FAILED", 1), ("QUEUED", 30)])]
    runs_ = spark.createDataFrame(rows, "repository_id string, commit_sha string, id string, status string, updated_at timestamp")
    asked = spark.createDataFrame([("r", f"c{i}") for i in range(6)], "repository_id string, commit_sha string")
    got = {r["commit_sha"]: r["plan"] for r in runs.plan_ingestions(asked, runs_, F.lit(now)).collect()}
    assert got == {"c0": "in_progress", "c1": "retry", "c2": "reuse", "c3": "retry", "c4": "in_progress", "c5": "create"}


def finding(**over):
    return {"category": "c", "title": "t", "summary": "s", "severity": "HIGH", "confidence": 0.5, "evidence": "e", "recommendation": "r", "citations": [{"filePath": "a", "startLine": 1, "endLine": None, "symbolName": None}]} | over


def test_output_validation(spark):
    good = {"summary": "s", "findings": [finding()]}
    boss = {"overallHealth": "GOOD", "summary": "s", "strengths": ["x"], "topRisks": [], "recommendedNextSteps": []}
    cases = [
        ("SECURITY", json.dumps(good), None), ("SECURITY", "oops", "json"), ("SECURITY", None, "json"), ("SECURITY", "[]", "json"),
        ("SECURITY", json.dumps(good | {"summary": ""}), "summary"), ("SECURITY", json.dumps(good | {"findings": [finding(citations=[])]}), "findings"),
        ("SECURITY", json.dumps(good | {"findings": [finding(severity="BAD")]}), "findings"), ("SECURITY", json.dumps(good | {"findings": [finding(confidence=1.5)]}), "findings"),
        ("SECURITY", json.dumps(good | {"findings": [finding()] * 21}), "findings"), ("SECURITY", json.dumps({"summary": "s"}), "findings"),
        ("SECURITY", json.dumps(good | {"findings": [finding(affectedFiles=["f"] * 21)]}), "findings"), ("SECURITY", json.dumps(good | {"findings": [finding(title="x" * 201)]}), "findings"),
        ("EXECUTIVE_SUMMARY", json.dumps(boss), None), ("EXECUTIVE_SUMMARY", json.dumps(boss | {"overallHealth": "OK"}), "health"),
        ("EXECUTIVE_SUMMARY", json.dumps(boss | {"strengths": ["x"] * 11}), "strengths"), ("EXECUTIVE_SUMMARY", json.dumps(boss | {"recommendedNextSteps": [""]}), "next_steps"),
    ]
    df = spark.createDataFrame([(str(i), a, r) for i, (a, r, _) in enumerate(cases)], "ai_run_id string, agent string, result string")
    got = {int(r["ai_run_id"]): r["reason"] for r in evidence.validate_outputs(df).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_roll_up(spark):
    rows = []
    for run, failed, boss in [("fine", 0, "COMPLETED"), ("one", 1, "COMPLETED"), ("all", 6, "PENDING"), ("boss", 0, "FAILED")]:
        rows += [(run, a[0], "FAILED" if i < failed else "COMPLETED") for i, a in enumerate(evidence.AGENTS)] + [(run, evidence.SUMMARY_AGENT, boss)]
    got = {r[0]: (r[1], r[2]) for r in evidence.roll_up(spark.createDataFrame(rows, "ai_run_id string, agent string, status string")).collect()}
    assert got == {"fine": ("COMPLETED", "COMPLETED"), "one": ("COMPLETED_WITH_WARNINGS", "COMPLETED"), "all": ("FAILED", "SKIPPED"), "boss": ("COMPLETED_WITH_WARNINGS", "FAILED")}


def test_pages_and_orders(spark):
    rows = [("r", None, "A", s, f"m{i}", i, None, None, datetime(2024, 1, 1)) for i, s in enumerate(["CRITICAL", "INFO", "HIGH", "LOW", "MEDIUM"])]
    found = spark.createDataFrame(rows, "run_id string, file_id string, rule_id string, severity string, message string, line int, column int, metadata map<string,string>, created_at timestamp")
    files = spark.createDataFrame([("r", "f", "p")], "run_id string, file_id string, path string")
    page, total = reports.findings_page(found, files, page_size=2)
    assert [r["severity"] for r in page.collect()] == ["INFO", "LOW"] and total.first()[0] == 5
    counts = reports.severity_counts(found.where("severity in ('INFO', 'MEDIUM')")).first()
    assert (counts["INFO"], counts["MEDIUM"], counts["HIGH"]) == (1, 1, 0)


def test_deep_pages_read_their_ranges(spark):
    rows = [(f"r{i % 3}", str(i % 7), "A", SEVERITIES[i % 5], f"m{i:05}", i % 11, None, None, None) for i in range(5_000)]
    found = spark.createDataFrame(rows, "run_id string, file_id string, rule_id string, severity string, message string, line int, column int, metadata map<string,string>, created_at timestamp").repartition(5)
    files = spark.createDataFrame([(f"r{i}", str(f), f"p{f}") for i in range(3) for f in range(5)], "run_id string, file_id string, path string")
    ordered = reports.ordered_findings(found, files, ranges=20)
    path = lambda r: f"p{r[1]}" if int(r[1]) < 5 else ""
    want = [r[4] for r in sorted(rows, key=lambda r: (SEVERITIES.index(r[3]), r[0], path(r), r[5], r[2], r[4]))]
    assert ordered.total == 5_000
    for number in (1, 2, 37, 71, 72, 73):
        page = ordered.page(number, 70)
        assert [r.message for r in page.collect()] == want[(number - 1) * 70 : number * 70]
        plan = page._jdf.queryExecution().executedPlan().toString()
        pruned = re.search(r"PartitionFilters: \[([^]]*__range[^]]*)\]", plan)
        assert pruned and len(set(re.findall(r"\b\d+\b", pruned[1].split("__range", 1)[1].split(" ", 1)[1]))) <= 4 or "LocalTableScan" in plan  # of 20 ranges
    assert [r.message for r in reports.findings_page(found, files, severity="LOW", page=1, page_size=9)[0].collect()] == [m for m in want if rows[int(m[1:])][3] == "LOW"][:9]
    before, reports.SHALLOW = reports.SHALLOW, 100
    try:
        page, total = reports.findings_page(found, files, page=40, page_size=70)
        assert [r.message for r in page.collect()] == want[39 * 70 : 40 * 70] and total.first()[0] == 5_000
    finally:
        reports.SHALLOW = before
    assert [r.message for r in reports.findings_page(found, files, run_id="none")[0].collect()] == [] and reports.ordered_findings(found.limit(0), files).page(1, 5).count() == 0


def test_incremental_stream(spark, tmp_path):
    files = lambda rows: spark.createDataFrame([("r", f, f"{f}.ts", "TypeScript", c) for f, c in rows], jobs.FILES)
    none = spark.createDataFrame([], "run_id string, file_id string, symbol_id string, ordinal int, name string, start_line int, end_line int, parent_id string")
    from repolens.operators.index import embed_pseudo

    where = [str(tmp_path / x) for x in ("in", "table", "state")]
    go = lambda: jobs.index_incrementally(spark, where[0], lambda f: none, where[1], where[2], lambda rows: embed_pseudo(rows, 4)).awaitTermination()
    files([("a", "one"), ("b", "two")]).write.parquet(where[0])
    go()
    first = {r["file_id"]: r["content_hash"] for r in jobs.latest_table(spark, where[1]).collect()}
    files([("b", "three")]).write.mode("append").parquet(where[0])
    go()
    second = {r["file_id"]: r["content_hash"] for r in jobs.latest_table(spark, where[1]).collect()}
    assert set(first) == set(second) == {"a", "b"} and first["a"] == second["a"] and first["b"] != second["b"]
