"""Readers and writers, on small files."""

import json

from quarry.operators import findings, graph, knowledge, scan
from quarry.sources import files


def test_source_tree(spark, tmp_path):
    for path, text in (("a/sources/x.move", "module a::x {}"), ("a/old/y.move", "no"), ("b/z.move", "module b::z {}"), ("b/z.txt", "no")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    rows = scan.read_source_tree(spark, str(tmp_path)).collect()
    assert {r.content for r in rows} >= {"module a::x {}", "module b::z {}"}


def test_patterns_jsonl(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"pattern_id": "P1", "title": "t", "detection_cues": ["a"]}\n\nbroken {\n{"pattern_id": "P2"}\n')
    got = scan.read_patterns_jsonl(spark, str(tmp_path))
    assert sorted(r.pattern_id for r in got.collect()) == ["P1", "P2"]
    scan.write_patterns_jsonl(got, str(tmp_path / "out"))
    assert scan.read_patterns_jsonl(spark, str(tmp_path / "out")).count() == 2


def test_markdown_reports(spark, tmp_path):
    (tmp_path / "r.md").write_text("# R\n## H-1: First\n**Severity: High**\n### Description\nuses a::b\n## H-2: Second\n")
    (tmp_path / "n.txt").write_text("no")
    issues = knowledge.parse_issues(knowledge.split_issues(knowledge.read_markdown_reports(spark, str(tmp_path)))).orderBy("issue").collect()
    assert [(i.issue_id, i.title, i.severity, i.function) for i in issues] == [("H-1", "First", "high", "a::b"), ("H-2", "Second", None, None)]


def test_reports_with_broken_bytes(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("# R\r\nfee\ufffd ".encode() + b"\xff\xfe\xe9t\xc3" + "é".encode() + b"\xe2\x82")
    (tmp_path / "b.md").write_bytes(b"")
    got = {r.path[-4:]: r.content for r in knowledge.read_markdown_reports(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "# R\nfee\ufffd té"}  # Spark's reader leaves empty files out


def test_findings_json(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"finding_id": "f", "status": "false_positive", "original_finding": {"title": "T", "severity": "weird"}}) + "\nnot json\n")
    rows = files.read_findings_json(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.finding_id, r.status, r.severity, r.title) for r in rows] == [("f", "rejected", "MEDIUM", "T"), (None, "open", "MEDIUM", "")]


def test_manifest(spark):
    text = '[package]\nname = "vault"\n\n[dependencies]\nSui = { git = "https://x/y.git", rev = "main" }\nlib = { local = "../lib" }\n\n[addresses]\na = "0x0"\n'
    df = spark.createDataFrame([("p", "p/Move.toml", text), ("p", "p/a.move", "x")], "project string, path string, content string")
    assert sorted(map(tuple, files.read_manifest_deps(df).collect())) == [("p", "vault", "Sui", "https://x/y.git", "main", None), ("p", "vault", "lib", None, None, "../lib")]


def test_graph_and_reports_round_trip(spark, tmp_path):
    f = spark.createDataFrame([("m::a", "m"), ("m::b", "m")], "func_id string, module string")
    e = spark.createDataFrame([("m::a", "m::b")], "from_id string, to_id string")
    graph.save_graph(f, e, f.limit(0), str(tmp_path / "g"))
    assert [x.count() for x in graph.load_graph(spark, str(tmp_path / "g"))] == [2, 1, 0]
    rows = spark.createDataFrame([("p", "confirmed", "high", 80), ("q", "rejected", "low", 10)], "project string, status string, severity string, confidence int")
    findings.write_report_tables(rows, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/summary")).count() == 2
    assert spark.read.parquet(str(tmp_path / "r/findings")).where("project = 'p'").count() == 1


def test_entry_works_without_the_optional_part(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "quarry", tmp_path / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'scan_report' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
