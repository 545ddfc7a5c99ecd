"""The stored search index against a scan of all texts."""

import os
import re
import tempfile

import pytest

from quarry.operators import search

TEXTS = [f"word{i} pool{i % 7}::swap_{i}(x);\n{'fee' if i % 3 else 'FEE'} zz{i * i}" for i in range(300)] + [None, "", "ab", "Ünïcode ÜBER\nline", "a.b", "line\nbreak"]


@pytest.fixture(scope="module")
def index(spark):
    path = tempfile.mkdtemp(prefix="spark-search-")
    search.build_search_index(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), path, posting_parts=8, text_parts=32)
    return path


@pytest.mark.parametrize("query", ["swap_29", "fee", "FEE Z", "über", "ab", "", "nowhere at all", "a.b", "pool3::swap_3(x)", "line\nbreak"])
def test_same_as_a_scan(spark, index, query):
    got = sorted(r.key for r in search.search_index(spark, index, query).collect())
    assert got == [i for i, t in enumerate(TEXTS) if t is not None and query.lower() in t.lower()]


@pytest.mark.parametrize("query", [r"swap_\d9\(", r"(pool[35])+::sw", r"(?:fee|FEE) zz1", r"wo(rd)+2\d\d", r"\bab?$", "x*", r"(?i)fee zz4", r"ne.?b"])
def test_regex_same_as_a_scan(spark, index, query):
    got = sorted(r.key for r in search.search_index(spark, index, query, True).collect())
    assert got == [i for i, t in enumerate(TEXTS) if t is not None and re.search(query, t)]


def test_few_parts_are_read(spark, index):
    everything = len([x for x in os.listdir(f"{index}/texts") if x.startswith("part=")])
    assert len(search.text_parts(spark, index, search.runs_of(["swap_291"]))[1]) == 1 < everything
    assert search.text_parts(spark, index, search.runs_of(["nowhere"]))[1] == []
    plan = search.search_index(spark, index, "swap_291")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan


def test_total_and_first(spark, index):
    hits = search.first_hits(search.search_index(spark, index, "fee"), ["key"]).collect()
    assert len(hits) == 20 and [r.key for r in hits] == list(range(20)) and {r.total for r in hits} == {300}


def test_certain_literals():
    assert search.certain_literals(r"abc(def)+g?h") == ["abc", "def", "h"] and search.certain_literals("a|b") == [] and search.certain_literals("(") == []


FILES = [("a.move", "module x::pool_util {\n}\nmodule x::pool {\n  fun swap_all() {\n  }\n fun swap() { if (a) {\n }\n }\n"), ("b.move", "module pool;\nfun close(\n) {\n}"), ("c.move", "module a_b { fun one() { } }"), ("d.move", None)]


def test_locate(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    asked = [("pool", "swap"), ("pool", "close"), ("z::pool", None), ("a::b", "one"), ("pool", "gone"), ("nomodule", None), (None, None), ("pool", "swap")]
    got = [tuple(r) for r in search.locate(files.selectExpr("path", "replace(content, 'x::', '') AS content"), spark.createDataFrame(asked, "module string, function string")).collect()]
    want = [("pool", "swap", "a.move", 4, 5), ("pool", "swap", "a.move", 4, 5), ("pool", "close", "b.move", 2, 4), ("z::pool", None, "a.move", 1, 1), ("a::b", "one", "c.move", 1, 1), ("pool", "gone", None, None, None), ("nomodule", None, None, None, None), (None, None, None, None, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_runs_are_taken_out_of_a_text_once(spark):
    """Once for the texts and once for the postings, but not again for a sample of the postings."""
    from pyspark.sql import functions as F

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        read.add(1)
        return x

    texts = spark.createDataFrame([(i, f"text {i} of many") for i in range(50)], "doc_id long, text string").select("doc_id", seen("text").alias("text"))
    search.build_search_index(texts.where("doc_id >= 0"), tempfile.mkdtemp(prefix="spark-search-"), posting_parts=4, text_parts=4)
    assert read.value <= 4 * 50


def test_locate_names_that_begin_alike(spark):
    """Names are met by what follows the word, not by a run of letters that all of them share."""
    n = 3000
    files = spark.range(n).selectExpr("concat('f', id) AS path", "concat('use module ; module m', id, ' {\nfun swap', id % 7, '() {\n}\n}') AS content")
    asked = spark.range(n).selectExpr("concat('m', id) AS module", "CASE id % 3 WHEN 0 THEN concat('swap', id % 7) WHEN 1 THEN 'swap' END AS function")
    lines = [r for r in search.explode_lines(files).where("contains(line, 'module ')").collect()]
    got = {(r.module, r.function): (r.path, r.line_start, r.line_end) for r in search.locate(files, asked).collect()}
    assert len(got) == n
    for i in range(0, n, 97):
        f = {0: f"swap{i % 7}", 1: "swap"}.get(i % 3)
        fits = [r.path for r in lines if f"module m{i}" in r.line and f in (None, "swap", f"swap{int(r.path[1:]) % 7}")]
        assert got[f"m{i}", f] == (min(fits), 1 if f is None else 2, 1 if f is None else 3)
    met = search.named_lines(search.explode_lines(files), "module ", asked.selectExpr("module", "module AS name"))
    assert met.count() == sum(len({str(i)[: k + 1] for k in range(len(str(i)))}) for i in range(n))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "contains(line, name" not in plan
    assert search.named_lines(search.explode_lines(files), "fun ", spark.createDataFrame([("", "a b")], "name string, function string").where("name = 'x'")).count() == 0
