"""Texts that repeat are worked on once, and all their rows get the result."""

import pytest

from quarry.operators import context, scan
from quarry.operators.scan import Pattern
from quarry.sources.shared import once_each

PATTERNS = [Pattern("A", "a", "high", ("x",), ("Fee", "pool", "fee"), "fee[0-9]", "swap"), Pattern("B", "b", "low", ("y",), ("pool",)), Pattern("C", "c", "low", (), ("", "zz"), "^$")]


@pytest.mark.parametrize("few_rows", [100, 1])
def test_work_is_done_once_for_equal_rows(spark, few_rows):
    rows = spark.createDataFrame([(i, [None, "a", "b", ""][i % 4], [None, "a"][i % 2]) for i in range(40)] + [(None, "c", "d")], "id long, one string, two string")
    seen = []

    def work(few):
        seen.append(few.count())
        return few.selectExpr("__key", "concat(coalesce(one, '-'), coalesce(two, '-')) AS got")

    found = once_each(rows, ["one", "two"], work, few_rows)
    assert seen == [5] and ("BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()) == (few_rows == 100)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(r.id, (r.one or "-" if r.one is None else r.one) + ("-" if r.two is None else r.two)) for r in rows.collect()], key=repr)


def test_repeated_texts_match_alike(spark):
    texts = ["the POOL has fee1", "fee", None, "", "zz fee7 pool"]
    docs = spark.createDataFrame([(i, texts[i % 5], [["x"], ["y", "z"], None][i % 3], [["swap"], None][i % 2]) for i in range(60)] + [(7, "fee", ["x"], None)], "doc_id long, text string, d array<string>, h array<string>")
    for domain, hints in ((None, None), ("d", None), ("d", "h")):
        one = sorted(map(repr, scan.match_patterns(docs, PATTERNS, domain, hints).collect()))
        assert one and sorted(map(repr, scan.match_repeated(docs, PATTERNS, domain, hints).collect())) == one


def test_cues_are_found_once_each(spark):
    """A cue of two patterns is looked for once, and a regex stands once in the plan."""
    docs = spark.createDataFrame([(1, "pool fee1")], "doc_id long, text string")
    plan = scan.match_patterns(docs, PATTERNS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(") == 4 and plan.count("fee[0-9]") == 1


def test_line_hints_of_repeated_texts(spark):
    docs = spark.createDataFrame([(i, "f()\ng() h()\nk()" if i % 2 else None) for i in range(10)] + [(11, "")], "doc_id long, text string")
    got = {r.doc_id: r.hints for r in context.line_hints(docs.select("doc_id"), docs, r"[a-z]\(", 3).collect()}
    assert set(got) == {*range(10), 11} and got[1] == [1, 2, 2] and got[11] == []
