"""What stands beside functions and groups of findings: missing names, and tables that are read once."""

from pyspark.sql import functions as F

from quarry.operators import context
from quarry.plans.stand_ins import table, view

SF = "/root/testdata/sf0.001"
EDGES = "from_id string, to_id string"


def executed(rows):
    rows.collect()
    return rows._jdf.queryExecution().executedPlan().toString()


def test_missing_names_take_no_place(spark):
    functions = spark.createDataFrame([("a", "A"), ("b", "B"), (None, "N")], "func_id string, body string")
    edges = spark.createDataFrame([(None, "a"), ("y", "a"), ("x", "a"), ("a", None), ("a", "b"), ("a", "gone")], EDGES)
    types = spark.createDataFrame([("a", None), ("a", "T2"), ("a", "T1"), ("a", "T3")], "func_id string, token string")
    got = {r.func_id: r for r in context.function_context(functions, edges, types, callers=1, callees=1, definitions=2).collect()}
    assert (got["a"].callers, [c.callee_body for c in got["a"].callees], got["a"].types) == (["x"], ["B"], ["T1", "T2"])
    assert set(got) == {"a", "b", None} and (got["b"].callers, got["b"].callees, got["b"].types) == (["a"], None, []) and got[None].callers == []


def test_callers_and_callees_share_one_reading_of_edges(spark):
    functions = view(spark, SF, "functions").withColumn("body", F.col("name"))
    types = functions.select("func_id", F.col("name").alias("token"))
    plan = executed(context.function_context(functions, view(spark, SF, "edges"), types)).split("Initial Plan")[0]
    assert len([x for x in plan.splitlines() if "FileScan" in x and "l_orderkey" in x]) == 2


def test_functions_are_told_apart_by_numbers(spark):
    rows = table(spark, SF, "lineitem").selectExpr("concat('0x1::m', l_suppkey, '::f', l_partkey) AS func_id").distinct()
    got = view(spark, SF, "functions")
    assert sorted(r.func_id for r in got.collect()) == sorted(r.func_id for r in rows.collect())
    shuffled = [x for x in executed(got).splitlines() if "Exchange" in x]
    assert shuffled and all("l_suppkey" in x and "func_id" not in x for x in shuffled)


def test_group_context_of_repeated_texts(spark):
    """Texts are weighed once for all findings that have them; odd names and missing functions stay as they are."""
    schema = "module string, group long, finding_id string, func_id string, title string, description string, category string, hint string"
    rows = [("m", 1, f'x"{i}', f, "Arithmetic overflow", None, None, h) for i, (f, h) in enumerate([("b", None), ("a", "by\nrule"), (None, None), ("a", None), ("gone", None)])]
    rows += [("n", 1, "y", "c", "Plain", "", "", None), ("m", 2, "z", None, None, None, None, None)]
    functions = spark.createDataFrame([("a", "fun a", ""), ("b", None, "B"), ("c", "fun c", None)], "func_id string, signature string, body string")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "gone"), ("b", "a"), ("c", "a"), (None, "a"), ("gone", "a"), ("b", "c")], EDGES)
    topics = spark.createDataFrame([("overflow", ["t2", "t1"]), ("arith", ["t1"])], "word string, topics array<string>")
    found = context.group_context(spark.createDataFrame(rows, schema), functions, edges, topics)
    got = {(r.module, r.group): r for r in found.collect()}
    g = got["m", 1]
    assert (g.functions, g.bodies, g.callees, g.callers, g.topics) == (["a", "b", "gone"], ["B"], ["a: b", "b: a, c"], ["a: fun c", "b: fun a", "gone: fun a"], ["t1", "t2"])
    assert 'x"1: by\nrule' in g.hints and len(g.hints) in (1, 5)
    assert (got["n", 1].functions, got["n", 1].bodies, got["n", 1].callees, got["n", 1].callers) == (["c"], [], ["c: a"], ["c: "]) and (got["m", 2].functions, got["m", 2].hints) == ([], [])
