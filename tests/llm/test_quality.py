import math
import zlib

import numpy as np

from quarry.llm import quality, registry

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in registry.QUERIES["op9_quality"](spark, SF).collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    held = [(rows[x.doc_id], x.quality) for x in spark.read.parquet(f"{SF}/labels.parquet").collect() if rows[x.doc_id].held_out]
    assert sum(r.predicted == y for r, y in held) >= 0.95 * len(held)
    assert sum(r.predicted for r, y in held if y) >= 0.97 * sum(y for _, y in held)


def test_scores_do_not_depend_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{x}.parquet") for x in ("documents", "labels"))
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(labels.doc_id), 1 - labels.quality).otherwise(labels.quality).cast("int"))
    assert np.array_equal(quality.train(docs, labels), quality.train(docs, flipped))


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (None, "a b", 0.3), (3, "good words here", 0.4), (3, "good words here", 0.5), (4, "x " * 200_000, 0.6)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 0), (4, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classified(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.classified(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classified(docs.limit(0), labels).count() == 0
    assert quality.accepted(docs, labels).columns == docs.columns


def test_shapes():
    assert [quality.shape(x) for x in ("THE!!", "of%%%", "|", "Éa9")] == ["XX!!", "xx%%", "|", "Xx9"]


def plain_ftrl(examples, epochs):
    """Follow-the-regularised-leader, one coordinate at a time."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return (sign * quality.L1 - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(epochs):
        for places, values, label in examples:
            found = {}
            for i, v in zip(places, values):
                found[i] = found.get(i, 0.0) + v
            at, x = list(found), list(found.values())
            w = [weight(i) for i in at]
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(a * b for a, b in zip(w, x))))))
            for i, v, own in zip(at, x, w):
                g = (p - label) * v
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / quality.ALPHA * own
    return {i: weight(i) for i in z}


def test_weights_against_plain_updates(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(200).collect()]
    examples = [(*quality.features(t, 1 << 12), len(t or "") % 2) for t in docs]
    got = quality.fitted(examples, 1 << 12)
    want = plain_ftrl([(a.tolist(), x.tolist(), y) for a, x, y in examples], quality.EPOCHS)
    assert sum(v != 0 for v in want.values()) > 500
    assert all(abs(got[i] - want.get(i, 0.0)) < 1e-9 for i in range(len(got)))


def test_a_column_named_score_stays(spark):
    docs = spark.createDataFrame([(i, f"Some words of text {i}.", i) for i in range(20)], "doc_id long, text string, __score long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    left = quality.accepted(docs, labels, threshold=0.0)
    assert left.columns == docs.columns and sorted(map(tuple, left.collect())) == sorted(map(tuple, docs.collect()))
