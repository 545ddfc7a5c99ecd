"""Operators on rows that the given tables don't have."""

import datetime as dt

from quarry.operators import code, context, findings, graph, rules, scan, usage
from quarry.streaming import streams


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_week_labels(spark):
    days = [dt.datetime(2023, 12, 31), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 7), dt.datetime(2024, 1, 8), dt.datetime(2023, 1, 1)]
    df = spark.createDataFrame([(1, d, 1) for d in days], "user_id long, created_at timestamp, total_tokens long")
    assert {r.bucket for r in usage.usage_trend(df, "week").collect()} == {d.strftime("%Y-W%W") for d in days}


def test_balance_never_below_zero(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, 1, t, 5), (1, 2, t, -7), (1, 3, t, -5), (2, 4, t, -1)], "user_id long, seq long, created_at timestamp, delta long")
    assert rows(usage.running_balance(df), "seq", "balance", "rejected") == [(1, 5, False), (2, 5, True), (3, 0, False), (4, 0, True)]


def test_balance_of_nulls_and_of_none(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(None, 1, t, 5), (None, 2, t, None), (None, 3, t, -5), (1, 4, t, -1)], "user_id long, seq long, created_at timestamp, delta long")
    assert rows(usage.running_balance(df), "seq", "balance", "rejected") == [(1, 5, False), (2, 5, False), (3, 0, False), (4, 0, True)]
    assert usage.running_balance(df.limit(0)).count() == 0


def test_dedupe_is_idempotent(spark):
    df = spark.createDataFrame([(i, "m", "f", "3-5" if i % 2 else "3", "overflow", None, None, 50 + i % 3) for i in range(9)], "seq long, module string, function string, line string, title string, description string, category string, confidence int")
    once = findings.dedupe_findings(df)
    assert rows(once, "seq") == [(2,)] and rows(findings.dedupe_findings(once), "seq") == [(2,)]


def test_neighbors_and_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "from_id string, to_id string")
    s = spark.createDataFrame([("a",)], "seed string")
    assert rows(graph.neighbors(e, s, 3), "func_id", "distance") == [("b", 1), ("c", 1), ("d", 2)]
    hit = graph.propagate(spark.createDataFrame([("d",)], "func_id string"), e)
    assert rows(hit, "func_id", "layer", "exploitability", "confidence") == [("a", 3, 4, 60), ("b", 2, 5, 65), ("c", 1, 6, 75)]


def test_rules_split_their_input(spark):
    df = spark.createDataFrame([("emit event", None, "event::emit(x)", None, None, "high"), ("nothing", None, None, None, None, None), (None, None, None, None, None, None)], "title string, description string, code string, function string, visibility string, severity string")
    out = rules.apply_exclusions(df)
    assert out.where("excluded").count() + out.where("NOT excluded").count() == 3
    mine = [rules.Rule("mine", "n", "c", lambda f: f.says("nothing"), hard=True)]
    assert [r.rule_id for r in rules.apply_exclusions(df, mine).where("excluded").collect()] == ["mine"]


def test_code_tables_on_awkward_text(spark):
    text = 'module a::m;\npublic(friend) fun f<T>(x: T, c: &AdminCap): u64 {\n  let s = "}";\n  g(x);\n}\n#[test_only]\nfun g() { }\nstruct P { pool_id: ID }\n'
    df = spark.createDataFrame([("p", text), ("q", ""), ("r", None)], "id string, content string")
    assert rows(code.extract_functions(df, ["id"]), "name", "visibility", "return_type") == [("f", "public(friend)", "u64"), ("g", "private", "")]
    assert rows(code.function_spans(df, ["id"]), "function", "start_line", "end_line") == [("f", 2, 5), ("g", 6, 7)]  # attributes are part of a declaration
    assert rows(code.is_test_function(df, ["id"]), "function", "is_test") == [("f", False), ("g", True)]
    assert rows(code.extract_structs(df, ["id"]), "name", "is_hot_potato") == [("P", True)]


def test_scores_stay_in_range(spark):
    df = spark.createDataFrame([(i, "critical", 1.0) for i in (1, 1, 2)], "doc_id long, severity string, confidence double")
    assert {r.risk_score for r in scan.scan_risk_score(df).collect()} == {100}


def test_places_in_a_group_that_holds_most_rows(spark):
    df = spark.createDataFrame([(i, None if i % 50 == 0 else "m" if i % 7 else "n", i % 3) for i in range(2000)], "seq long, module string, risk_score int").repartition(7)
    got = findings.numbered(df, ["module"], [findings.F.desc_nulls_last("risk_score"), findings.F.asc("seq")], "place")
    want = []
    for module in (None, "m", "n"):
        own = sorted((-(i % 3), i) for i in range(2000) if (None if i % 50 == 0 else "m" if i % 7 else "n") == module)
        want += [(seq, module, place) for place, (_, seq) in enumerate(own, 1)]
    assert rows(got, "seq", "module", "place") == sorted(want, key=repr)
    assert findings.numbered(df.limit(0), ["module"], [findings.F.asc("seq")], "place").count() == 0


def test_layers_leave_short_plans(spark):
    e = spark.createDataFrame([(f"f{i}", f"f{i + 1}") for i in range(9)], "from_id string, to_id string")
    s = spark.createDataFrame([("f0",), ("f0",)], "seed string")
    deep = graph.neighbors(e, s, 6)
    assert rows(deep, "func_id", "distance") == [(f"f{i}", i) for i in range(1, 7)]
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert graph.neighbors(e, s.limit(0), 2).count() == 0


def test_custom_rules_of_owner_and_project(spark):
    f = spark.createDataFrame([("a", 1, "o", "p", "Overflow", "d", "f", "HIGH"), ("b", 2, "o", "q", "Overflow", None, None, None), ("c", 3, "x", "p", "Overflow", "d", "f", "LOW"), ("d", 4, None, "p", None, None, None, None)], "finding_id string, seq long, owner_id string, project string, title string, description string, function string, severity string")
    r = spark.createDataFrame(
        [(3, "o", None, False, ["overflow"], None, None, None), (2, "o", "p", True, ["over"], None, "^f$", ["high"]), (1, "o", "p", True, None, None, None, None), (0, "x", "q", False, ["over"], None, None, None)],
        "rule_id int, owner_id string, rule_project string, match_all boolean, title_contains array<string>, description_contains array<string>, function_pattern string, severity_in array<string>",
    )
    assert rows(context.apply_custom_exclusions(f, r), "finding_id", "excluded_by") == [("a", 2), ("b", 3), ("c", None), ("d", None)]
    assert rows(context.apply_custom_exclusions(f, r.limit(0)), "finding_id", "excluded_by") == [(x, None) for x in "abcd"]


def test_last_state_over_batches(spark, tmp_path):
    schema = "id string, status string, seq long"
    for batch in ([("a", "open", 1), ("b", "open", 2)], [("a", "closed", 5), ("c", "open", 4)], [("a", "late", 3), (None, "open", 6)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = streams.latest_state(spark, stream, f"{tmp_path}/out", ["id"], ["seq"])
    assert rows(got, "id", "status", "seq") == [("a", "closed", 5), ("b", "open", 2), ("c", "open", 4), (None, "open", 6)]


def test_places_of_matches(spark):
    m = spark.createDataFrame(
        [(1, "p", "Misuse of f()", None, None, ["x"]), (1, "q", "Other", "text", [7], ["x"]), (1, "r", "Other", None, [], ["VALUE", "none"]), (2, "p", None, None, None, None), (None, "p", "f", None, [3], ["x"])],
        "doc_id long, pattern_id string, title string, description string, line_hints array<int>, matched_cues array<string>",
    )
    f = spark.createDataFrame([(1, "f", 2, 4), (1, "g", 6, 9), (2, "f", 1, 2)], "doc_id long, function string, start_line int, end_line int")
    ls = spark.createDataFrame([(1, 1, "struct value", "struct"), (1, 3, "let Value = x", "function"), (1, 5, "value", "module"), (2, 1, None, "function")], "doc_id long, line_no int, line string, place string")
    got = rows(context.locate_match(m, f, ls), "doc_id", "pattern_id", "line", "function", "how")
    assert got == [(1, "p", 2, "f", "named function"), (1, "q", 7, "g", "line hint"), (1, "r", 3, "f", "cue"), (None, "p", 3, None, "line hint")]


def test_chunks_name_the_types_of_their_module(spark):
    f = spark.createDataFrame([("a", "m", "f", "public", "x: &Pool<T>", "Coin", 5, "b"), ("b", "n", "g", "private", "x: Pool", None, 0, None), (None, None, "h", None, None, None, None, None)], "func_id string, module string, name string, visibility string, params string, return_type string, risk_score int, body string")
    t = spark.createDataFrame([("m", "Pool"), ("m", "Coin"), ("m", None), ("m", "Pool"), ("n", "Vault")], "module string, type_name string")
    assert rows(context.make_chunks(f, t), "func_id", "related") == [("a", ["Coin", "Pool"]), ("b", []), (None, [])]
