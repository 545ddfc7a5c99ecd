"""Files written to the shared folder from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import findings as finding_op
from quarry.operators import graph, knowledge, scan
from quarry.plans.graph_queries import types
from quarry.plans.stand_ins import oracle, table, view
from quarry.sources import files, shared

MANIFEST = """
    SELECT concat('p', p_partkey) AS project, CASE WHEN p_size % 5 = 0 THEN 'notes.md' ELSE concat('p', p_partkey, '/Move.toml') END AS path,
           concat('[package]', chr(10), 'name = "n', p_size, '"', chr(10), chr(10), '[dependencies]', chr(10), CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('Sui = {{ git = "https://x/', p_size, '.git", rev = "r', p_partkey, '" }}', chr(10)) END,
                  'lib-a = {{ local = "../', p_size, '" }}', chr(10), CASE WHEN p_size % 2 = 0 THEN concat('[addresses]', chr(10), 'a = {{ local = "no" }}', chr(10)) ELSE '' END) AS content
    FROM {part}"""
NESTED = """
    SELECT to_json(named_struct('finding_id', finding_id, 'status', status, 'final_severity', CASE WHEN confidence > 50 THEN 'low' END,
                                'original_finding', named_struct('title', title, 'severity', severity, 'description', CASE WHEN confidence % 2 = 0 THEN description END, 'location', named_struct('module', module, 'function', function)))) AS value
    FROM {findings}"""


def patterns(s, d):
    path = shared.new_folder(s, "patterns")
    rows = table(s, d, "benchmark").select(F.concat(F.lit("B"), "item_id").alias("pattern_id"), F.col("text").alias("title"), F.array(F.lit("a\nb"), F.col("text")).alias("detection_cues"))
    scan.write_patterns_jsonl(rows, path)
    return scan.read_patterns_jsonl(s, path).select("pattern_id", "title", F.get("detection_cues", F.lit(0)).alias("first_cue"), F.size("detection_cues").alias("cues"))


def finding_files(s, d):
    path = shared.new_folder(s, "findings")
    s.sql(NESTED, findings=view(s, d, "findings")).write.text(path)
    return files.read_findings_json(s, path).select("finding_id", "status", "severity", "title", "description", "location")


def saved_graph(s, d):
    path = shared.new_folder(s, "graph")
    graph.save_graph(view(s, d, "functions"), view(s, d, "edges"), types(s, d), path)
    kept = [t.select(F.lit(n).alias("part"), F.concat_ws(">", *key).alias("row")) for t, n, key in zip(graph.load_graph(s, path), ("functions", "edges", "types"), (("func_id", "risk_score"), ("from_id", "to_id"), ("module", "type_id")))]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


def report_tables(s, d):
    path = shared.new_folder(s, "reports")
    finding_op.write_report_tables(view(s, d, "findings"), path)
    return s.read.parquet(f"{path}/findings").groupBy("project", "status").agg(F.count(F.lit(1)).alias("findings"), F.sum("confidence").alias("confidence"))


def source_files(s, d):
    """Parts as source lines, a file a brand, written and read back."""
    path = shared.new_folder(s, "sources")
    lines = table(s, d, "part").select(F.regexp_replace("p_brand", "[^A-Za-z0-9]+", "-").alias("brand"), "p_partkey", F.concat(F.lit("fun f"), "p_partkey", F.lit("() { // "), "p_name", F.lit(" }")).alias("value"))
    lines.repartition("brand").sortWithinPartitions("brand", "p_partkey").drop("p_partkey").write.partitionBy("brand").text(path)
    return path


def source_tree(s, d):
    rows = scan.read_source_tree(s, source_files(s, d), ".txt")
    return rows.select(F.regexp_replace("project", "^brand=", "").alias("brand"), F.rtrim("content", F.lit("\n")).alias("content"))


def markdown_files(s, d):
    rows = knowledge.read_markdown_reports(s, source_files(s, d), "*.txt")
    return rows.select(F.regexp_extract("path", "brand=([^/]+)/", 1).alias("brand"), F.rtrim("content", F.lit("\n")).alias("content"))


QUERIES = {
    "s1_source_tree": source_tree,
    "s6_markdown_reports": markdown_files,
    "s4_s5_patterns_jsonl": patterns,
    "s7_findings_json": finding_files,
    "s8_report_tables": report_tables,
    "s9_saved_graph": saved_graph,
    "s10_manifest_deps": lambda s, d: files.read_manifest_deps(s.sql(MANIFEST, part=table(s, d, "part"))),
    "l3_functions_by_risk": lambda s, d: finding_op.order_functions_by_risk(view(s, d, "functions")).select("module", "func_id", "place"),
}

FILES = "SELECT regexp_replace(p_brand, '[^A-Za-z0-9]+', '-', 'g') AS brand, string_agg(concat('fun f', p_partkey, '() { // ', p_name, ' }'), chr(10) ORDER BY p_partkey) AS content FROM part GROUP BY 1"

ORACLES = {
    "s1_source_tree": FILES,
    "s6_markdown_reports": FILES,
    "s4_s5_patterns_jsonl": "SELECT concat('B', item_id) AS pattern_id, text AS title, concat('a', chr(10), 'b') AS first_cue, CAST(2 AS INT) AS cues FROM benchmark",
    "s7_findings_json": oracle("""
        WITH x AS (SELECT *, upper(CASE WHEN confidence > 50 THEN 'low' ELSE severity END) AS level FROM findings)
        SELECT finding_id, CASE status WHEN 'confirmed' THEN 'confirmed' WHEN 'false_positive' THEN 'rejected' ELSE 'open' END AS status, CASE WHEN level IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'ADVISORY') THEN level ELSE 'MEDIUM' END AS severity,
               title, CASE WHEN confidence % 2 = 0 THEN description ELSE '' END AS description, concat(module, '::', function) AS location FROM x"""),
    "s8_report_tables": oracle("SELECT project, status, count(*) AS findings, CAST(sum(confidence) AS BIGINT) AS confidence FROM findings GROUP BY project, status"),
    "s9_saved_graph": oracle("SELECT 'functions' AS part, concat(func_id, '>', risk_score) AS row FROM functions UNION ALL SELECT 'edges', concat(from_id, '>', to_id) FROM edges UNION ALL SELECT 'types', concat(module, '>', type_id) FROM (SELECT DISTINCT concat('m', l_suppkey) AS module, l_linenumber AS type_id FROM lineitem)"),
    "s10_manifest_deps": """
        SELECT concat('p', p_partkey) AS project, concat('n', p_size) AS package, 'Sui' AS dep_name, concat('https://x/', p_size, '.git') AS git, concat('r', p_partkey) AS rev, CAST(NULL AS VARCHAR) AS local FROM part WHERE p_size % 5 <> 0 AND p_size % 3 <> 0
        UNION ALL SELECT concat('p', p_partkey), concat('n', p_size), 'lib-a', NULL, NULL, concat('../', p_size) FROM part WHERE p_size % 5 <> 0""",
    "l3_functions_by_risk": oracle("SELECT module, func_id, CAST(row_number() OVER (PARTITION BY module ORDER BY risk_score DESC, seq) AS INT) AS place FROM functions"),
}
