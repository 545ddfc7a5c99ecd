"""The vector index against a plain loop."""

import numpy as np

from quarry.operators import vectors

SCHEMA = "vec_id long, embedding array<float>, distance string"


def brute(queries, base, k, farthest):
    out = []
    for q in {x[0]: x for x in queries if x[0] is not None and x[1] is not None}.values():
        near = sorted((round(float(np.sqrt(((np.float32(b[1]).astype(float) - np.float32(q[1]).astype(float)) ** 2).sum())), 6), b[0]) for b in base if b[0] is not None and b[1] is not None and None not in b[1] and len(b[1]) == len(q[1]) and b[0] != q[0])
        out += [(q[0], i, d, n + 1) for n, (d, i) in enumerate([x for x in near if x[0] <= farthest][:k])]
    return sorted(out)


def run(spark, queries, base, k, farthest, **more):
    found = vectors.knn(spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(base, SCHEMA), k, farthest, **more)
    return sorted((r.query_id, r.vec_id, r.distance, r.rank) for r in found.collect())


def clusters(n, width=6, seed=3):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(20, width))[rng.integers(0, 20, n)] + 0.03 * rng.normal(size=(n, width))).astype(np.float32)


def test_same_as_a_loop(spark):
    base = [(i, v.tolist(), "x") for i, v in enumerate(clusters(500))]
    base += [(1000 + i, [1.0] * 6, "") for i in range(200)] + [(None, [1.0] * 6, ""), (7, None, ""), (8, [1.0, None, 1.0, 1.0, 1.0, 1.0], ""), (9, [1.0], "")]
    queries = base[:40] + base[600:640] + [(None, [1.0] * 6, ""), (3000, None, ""), (3001, [9.0] * 6, "")]
    for k, farthest in ((5, 1.5), (3, 0.1)):
        assert run(spark, queries, base, k, farthest, sample=100, cell=30, block=16) == brute(queries, base, k, farthest)


def test_empty(spark):
    assert run(spark, [], [], 5, 1.5) == [] and run(spark, [(1, [1.0], "")], [], 5, 1.5) == [] and run(spark, [], [(1, [1.0], "")], 5, 1.5) == []


def test_most_pairs_are_passed_over(spark):
    rows = clusters(4000)
    base = vectors.classes_of(vectors.packed(spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(rows)], SCHEMA), 6), 6).cache()
    cells, blocks = vectors.indexed(base, 6, 1000, 50, 64)
    asked = base.selectExpr("key", "vector", "1.5D AS within").limit(200)
    left = vectors.pairs_compared(vectors.bounded(asked, cells, blocks, 6, 6), cells, blocks, 6).first()["compared"]
    assert left < 0.15 * 200 * 4000


def test_a_block_is_sent_once_to_a_batch(spark):
    base = vectors.classes_of(vectors.packed(spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(clusters(600))], SCHEMA), 6), 6).cache()
    cells, blocks = vectors.indexed(base, 6, 200, 50, 64)
    asked = base.selectExpr("key", "vector", "100D AS within").repartition(16)
    assert vectors.visits(vectors.batched(asked), cells, 6, False).count() == blocks.count()


def test_long_vectors_that_lie_near(spark):
    base = [(i, [1e6 + i * 0.5, 1e6, 1e6, 1e6, 1e6, 1e6], "x") for i in range(60)]
    assert run(spark, base[:20], base, 5, 1.5, sample=30, cell=10, block=8) == brute(base[:20], base, 5, 1.5)
