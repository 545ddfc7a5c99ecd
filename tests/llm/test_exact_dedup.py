import hashlib

import pytest

from quarry.llm import registry
from quarry.llm.exact_dedup import exact_dedup, keep_first_copies
from tests.llm.oracle import assert_same

SF = "/root/testdata/sf0.001"


def test_matches_sql(spark):
    assert_same(registry.QUERIES["op7_exact_dedup"](spark, SF), registry.ORACLES["op7_exact_dedup"], SF)


ROWS = [(1, "Aé B", "x"), (2, "aé b", None), (3, "AÉ b", "x"), (4, None, "x"), (5, "", "y"), (None, "solo", None), (6, "z" * 300_000, "q"), (7, "Z" * 300_000, "q"), (8, "z" * 299_999 + "y", "q"), (2, "aé b", None)]


def brute(rows):
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    out = []
    for i, t, _ in rows:
        same = [j for j, u, _ in rows if norm(u) == norm(t)]
        keep = max(same, key=lambda j: -1 if j is None else j)
        out.append((i, keep, len(same), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edge_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, keep_id string")
    got = sorted(map(tuple, exact_dedup(docs, digest_all=True).collect()), key=repr)
    assert got == brute(ROWS)
    lazy = exact_dedup(docs).collect()
    assert {r.doc_id for r in lazy if r.text_sha256 is None} <= {None, 3}


def test_kept_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, keep_id string")
    assert sorted((r.doc_id is None, r.doc_id) for r in keep_first_copies(docs).collect() if r.doc_id) == [(False, x) for x in (2, 3, 5, 7, 8)]
    assert keep_first_copies(docs).columns == docs.columns


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup(docs).count() == 0 and keep_first_copies(docs).count() == 0


@pytest.mark.parametrize("n", [1, 7])
def test_one_group(spark, n):
    docs = spark.range(n).selectExpr("id AS doc_id", "'same' AS text")
    assert {(r.keep_id, r.group_size) for r in exact_dedup(docs).collect()} == {(n - 1, n)}
