import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.llm import hard_negatives as hn
from quarry.llm import registry
from quarry.llm.gnat import Tree
from tests.llm.oracle import assert_same

SF = "/root/testdata/sf0.01"
SCHEMA = "id long, label long, vec array<long>, key string"


def brute(rows):
    rows = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and abs(x) <= hn.LARGEST for x in r[2])]
    width = max([len(r[2]) for r in rows], default=0)
    m = np.array([r[2] + [0] * (width - len(r[2])) for r in rows], dtype=object).reshape(len(rows), width)
    out = []
    for i, (aid, label, _, _) in enumerate(rows):
        if aid is None or aid % 10:
            continue
        scores = [int(x) for x in m @ m[i]]
        rank = lambda j: (-scores[j], rows[j][0] is None, rows[j][0] or 0)
        for p in sorted([j for j in range(len(rows)) if j != i and rows[j][1] == label], key=rank)[:5]:
            fits = [j for j in range(len(rows)) if rows[j][1] != label and 80 * scores[p] <= 100 * scores[j] <= 100 * scores[p]]
            out += [(aid, rows[p][0], k + 1, rows[j][0], scores[p], scores[j]) for k, j in enumerate(sorted(fits, key=rank)[:5])]
    return sorted(out, key=repr)


def run(spark, rows, **more):
    found = hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("id") % 10 == 0, **more)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()), key=repr)


def test_clusters(spark):
    """Many leaves and blocks, hot vectors, ties, nulls of every kind, repeated ids and rows, unequal lengths."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-300, 300, (12, 6))
    rows = [(i, int(rng.integers(0, 4)), (centres[rng.integers(0, 12)] + rng.integers(-20, 20, 6)).tolist(), "x") for i in range(700)]
    rows += [(1000 + i, i % 3, [50, 60, 70, 80, 90, 100], None) for i in range(300)]
    rows += [(0, 1, [1, 2, 3], ""), (0, 1, [1, 2, 3], ""), (None, 1, [300] * 6, ""), (None, 2, [300] * 6, ""), (10, None, [9] * 6, ""), (20, 1, None, ""), (30, 1, [None, 1], ""), (40, 2, [], ""), (50, 1, [hn.LARGEST + 1], ""), (60, 1, [0] * 6, ""), (70, 9, [5] * 6, "")]
    assert run(spark, rows, sample=256, leaf=40, block=32) == brute(rows)


def test_large_components(spark):
    rows = [(i, i % 2, [hn.LARGEST - i, -hn.LARGEST + 3 * i, i], "") for i in range(40)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(0, 1, [1], "")], [(0, 1, [1], ""), (1, 1, [2], "")]])
def test_few_rows(spark, rows):
    assert run(spark, rows) == []


def test_ranges_rule_out_leaves_and_lose_none():
    rng = np.random.default_rng(2)
    rows = (rng.integers(-3000, 3000, (40, 8))[rng.integers(0, 40, 6000)] + rng.integers(-60, 60, (6000, 8))).astype(np.int64)
    tree = Tree(rows[:1000], 64)
    leaf = tree.leaf_of(rows)
    for x in range(tree.leaves):
        if (leaf == x).any():
            tree.widen(x, *tree.ranges(rows[leaf == x], x))
    asked, scores = rows[:200], rows[:200] @ rows.T
    top = np.sort(scores, 1)[:, -5]
    reached = tree.reached(asked, top.astype(float), np.full(200, 1e18))
    assert all(reached[i, leaf[j]] for i in range(200) for j in np.flatnonzero(scores[i] >= top[i]))
    assert reached.mean() < 0.4  # of all pairs of anchor and leaf
    window = tree.reached(asked, 0.8 * top, 0.9 * top)
    assert all(window[i, leaf[j]] for i in range(200) for j in np.flatnonzero((scores[i] >= 0.8 * top[i]) & (scores[i] <= 0.9 * top[i])))


def test_quantised(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": range(6), "v": [[0.5, -0.001], [float("nan")], [float("inf")], None, [], [1e30]]}), "k int, v array<float>")
    got = {r.k: r.v for r in df.union(spark.createDataFrame([(9, [None])], df.schema)).select("k", hn.quantised(F.col("v")).alias("v")).collect()}
    assert got == {0: [128, -1], 1: None, 2: None, 3: None, 4: [], 5: [2**63 - 1], 9: None}


def test_matches_sql(spark):
    assert_same(registry.QUERIES["op11_hard_negatives"](spark, SF), registry.ORACLES["op11_hard_negatives"], SF)


def test_nothing_large_goes_through_the_driver(spark):
    """Visits are an anchor's vector for each block that it meets: they meet blocks by a shuffle, however small the
    anchors' file; and tasks don't each send a whole sample."""
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, rng.integers(-300, 300, 8).tolist(), "") for i in range(3000)]
    classes = hn.classes_of(spark.createDataFrame(rows, SCHEMA), 5)
    few = hn.first_keys(classes, 3000, 50)
    assert [r.key for r in few.collect()] == sorted(r.key for r in classes.collect())[:50]
    assert "substr" in few._jdf.queryExecution().optimizedPlan().toString()
    packed = classes.mapInPandas(hn.packer(8), "label long, ids array<long>, nulls int, key string, vector binary").select("key", "label", "vector", "ids", "nulls")
    index = hn.Index(packed, 8, 3000, 256, 40, 32)
    asked = packed.limit(40).select("key", "vector", "label", F.array(F.lit(-hn.ANY)).alias("least"), F.array(F.lit(hn.ANY)).alias("most"))
    found = index.search(hn.written(asked, "asked"), True, 3)
    assert found.count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
