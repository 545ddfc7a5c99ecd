"""Joins with texts that are worked out of narrow rows: Spark takes such texts for small, and they must not be broadcast."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import code, context, graph, scan
from quarry.plans import catalogue
from quarry.plans.stand_ins import view

TEXT = "module m {\n fun f() {\n  g(amount);\n }\n #[test]\n fun t() {}\n}\n"


def files(spark):
    return spark.createDataFrame([(1, TEXT), (2, "fun open() { amount(1"), (3, "")], "id long, content string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("run", [lambda f: code.function_spans(f, ["id"]), lambda f: code.is_test_function(f, ["id"]), lambda f: code.extract_calls(f, ["id"])])
def test_functions_meet_texts_without_broadcast(spark, run):
    found = plan(run(files(spark)))
    assert "Broadcast" not in found and found.count("SortMergeJoin") == 1


def test_snippet_around_without_broadcast(spark):
    lines = scan.explode_lines(files(spark).withColumnRenamed("id", "path"))
    hits = spark.createDataFrame([(1, 3), (1, 99), (2, 1)], "path long, hit int")
    got = scan.snippet_around(lines, hits, 1)
    assert "Broadcast" not in plan(got)
    assert {(r.path, r.hit): r.snippet.count("\n") for r in got.collect()} == {(1, 3): 2, (1, 99): 1, (2, 1): 0}


def test_snippets_by_keyword_without_broadcast(spark):
    lines = scan.explode_lines(files(spark).withColumnRenamed("id", "path"))
    got = context.snippets_by_keyword(lines, "amount", 1)
    assert "Broadcast" not in plan(got)
    assert {r.path: (r.hits, r.snippet) for r in got.collect()} == {1: ([3], "     2 |  fun f() {\n→    3 |   g(amount);\n     4 |  }"), 2: ([1], "→    1 | fun open() { amount(1")}


def test_spans_tell_of_their_own_declaration(spark):
    """Two functions of one name: each with its own parameters."""
    rows = spark.createDataFrame([(1, "fun f(a: A) {}\nfun f(b: B): u8 {}")], "id long, content string")
    got = code.function_spans(rows, ["id"], "params", "return_type").collect()
    assert sorted((r.start_line, r.params, r.return_type) for r in got) == [(1, "a: A", ""), (2, "b: B", "u8")]


def test_type_definitions_before_tokens(spark):
    """Own before dependencies, then by id; the first definition of a name is found before tokens meet it."""
    tokens = spark.createDataFrame([("a", "f", "T"), ("a", "f", "T"), ("b", "f", "T"), ("a", "g", "U"), (None, "h", "T"), ("c", "f", "V")], "project string, func_id string, token string")
    types = spark.createDataFrame([("a", "T", "9", False), ("a", "T", "1", True), ("b", "T", "0", True), ("a", "U", "5", True), ("a", "V", "5", False)], "project string, name string, type_id string, is_dependency boolean")
    got = context.type_definitions(tokens, types)
    assert sorted(got.select(F.coalesce("project", F.lit("-")), "func_id", "token", "type_id").collect()) == [("-", "h", "T", "0"), ("a", "f", "T", "9"), ("a", "g", "U", "5"), ("b", "f", "T", "0")]
    assert "row_number" not in plan(got)


def test_equal_rules_meet_findings_once(spark):
    """A thousand rules that say the same are one for their owner and project, whatever the case of their words."""
    rules = spark.range(1000).selectExpr("id + 1 AS rule_id", "'o' AS owner_id", "IF(id % 2 = 0, 'p', NULL) AS rule_project", "true AS match_all", "array(IF(id % 3 = 0, 'X', 'x')) AS title_contains", "array() AS description_contains", "CAST(NULL AS STRING) AS function_pattern", "array('High') AS severity_in")
    rows = [("a", 1, "o", "p", "an x", "d", "f", "HIGH"), ("b", 2, "o", "q", "an X", None, None, "high"), ("c", 3, "o", "p", "an x", "d", "f", "low"), ("d", 4, "z", "p", "x", "d", "f", "high")]
    findings = spark.createDataFrame(rows, "finding_id string, seq long, owner_id string, project string, title string, description string, function string, severity string")
    got = context.apply_custom_exclusions(findings, rules)
    assert sorted((r.finding_id, r.excluded_by) for r in got.collect()) == [("a", 1), ("b", 2), ("c", None), ("d", None)]
    assert "min(rule_id" in plan(got)


def test_calls_stay_one_row_while_they_are_resolved(spark):
    """No try of a call is a row of its own, and the first kind of match wins: a self call does not fall to the next."""
    functions = [("0x1::m::f", "m", "f", 1), ("0x2::m::f", "m", "f", 2), ("0x1::m::g", "m", "g", 3), ("0x1::n::g", "n", "g", 4), ("0x1::n::h", "n", "h", 5), ("x|y", "q", "z", 6)]
    calls = [("0x1::m::g", c, i) for i, c in enumerate(["0x1::m::f", "m::f", "0x9::m::f", "f", "g", "h", "n::g", "x|y", "gone", None])] + [("0x1::m::g", "h", 1), (None, "h", 1), ("bare", "g", 1)]
    got = graph.resolve_edges(spark.createDataFrame(calls, "from_id string, raw_call string, call_line int"), spark.createDataFrame(functions, "func_id string, module string, name string, seq long"))
    assert sorted(map(tuple, got.collect())) == [("0x1::m::g", "0x1::m::f", 0), ("0x1::m::g", "0x1::n::g", 6), ("0x1::m::g", "0x1::n::h", 1), ("0x1::m::g", "0x2::m::f", 1)]
    assert "Generate" not in plan(got) and "row_number" not in plan(got)


@pytest.mark.parametrize("name", ["k6_priority_warnings", "o6_apply_exclusions", "o6_apply_exclusions_hard", "o7_language_gate"])
def test_ids_beyond_64_bits(spark, tmp_path, name):
    """Order keys of a table 360 times sf0.1: ids are the same numbers, as decimals; where they fit, 64-bit numbers."""
    shift = 54_000_000
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(300)
    lines.write.parquet(f"{tmp_path}/near/lineitem.parquet")
    near = spark.read.parquet(f"{tmp_path}/near/lineitem.parquet")
    near.withColumn("l_orderkey", F.col("l_orderkey") + shift).write.parquet(f"{tmp_path}/far/lineitem.parquet")
    query = catalogue.QUERIES[name]
    own, far = query(spark, f"{tmp_path}/near"), query(spark, f"{tmp_path}/far")
    key = "doc_id" if "doc_id" in own.columns else "seq"
    assert (dict(own.dtypes)[key], dict(far.dtypes)[key]) == ("bigint", "decimal(38,0)")
    rows = lambda df, less: sorted(repr([int(r[c]) - less if c == key else r[c] for c in df.columns]) for r in df.collect())
    assert rows(far, shift * 8 * 10**11) == rows(own, 0) != []


def test_findings_beyond_64_bits(spark, tmp_path):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(20)
    lines.withColumn("l_orderkey", F.col("l_orderkey") + 54_000_000).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = view(spark, str(tmp_path), "findings").select("seq", "finding_id").collect()
    for r in got:
        order, number, part, supplier = map(int, r.finding_id[1:].split("-"))
        assert int(r.seq) == ((order * 8 + number) * 10**6 + part) * 10**5 + supplier
    assert len(got) == 20


def test_split_calls_reads_calls_once(spark):
    """As the operator over edges and resolved calls, with every kind of match, calls that repeat, and one exchange fewer for each reading."""
    functions = spark.createDataFrame([("0x1::a::f", "a", "f", 1), ("0x2::a::f", "a", "f", 2), ("0x1::b::g", "b", "g", 3), ("0x1::b::h", "b", "h", 4)], "func_id string, module string, name string, seq long")
    told = [("0x1::b::g", c) for c in ("0x1::a::f", "a::f", "z::a::f", "h", "f", "q::r", "zz", "g", "0x1::b::g", "q::r", None)] + [("0x1::b::h", "h"), ("0x1::a::f", "nope"), ("0x1::a::f", "g")]
    calls = spark.createDataFrame([(f, c, i) for i, (f, c) in enumerate(told)], "from_id string, raw_call string, call_line int")
    got = graph.split_calls(calls, functions)
    rows = {r.from_id: (r.internal, r.external) for r in got.collect()}
    assert rows == {"0x1::b::g": (["0x1::a::f", "0x1::b::h", "0x2::a::f"], ["f", "q::r", "zz"]), "0x1::a::f": (["0x1::b::g"], ["nope"])}
    resolved = spark.createDataFrame([(f, c) for f, c in told if c not in ("f", "q::r", "zz", "nope", None)], "from_id string, raw_call string")
    old = graph.split_internal_external(calls.where("raw_call IS NOT NULL"), graph.resolve_edges(calls, functions), resolved)
    assert {r.from_id: (r.internal, r.external) for r in old.collect()} == rows
    assert plan(catalogue.QUERIES["j4_split_internal_external"](spark, "/root/testdata/sf0.001")).count("SortMergeJoin") <= 3
