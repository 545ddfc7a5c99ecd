import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import fingerprints as fp
from quarry.llm import registry

SF = "/root/testdata/sf0.001"


def words5(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, docs):
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    assert len(rows) == len(order)
    want = {}
    for d, nxt in zip(order, order[1:] + order[:1], strict=True):
        t, n = d[1] or "", nxt[1] or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        want.setdefault(d[0], []).append((len(t), hashlib.sha256(e.encode()).hexdigest(), jaccard(words5(t), words5(e)), jaccard(words5(t), words5(n))))
    for r in rows:
        match = [w for w in want[r.doc_id] if w[0] == r.n_chars and w[1] == r.edited_sha256]
        assert match
        assert min(abs(w[2] - r.near_edited) for w in match) < 0.2 and min(abs(w[3] - r.near_next) for w in match) < 0.2


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = registry.QUERIES["op2_fingerprints"](spark, SF).collect()
    check(rows, docs)
    true = {d[0]: words5(d[1]) for d in docs}
    size = {r.doc_id: fp.distinct(fp.unpacked(r.fingerprint)) for r in rows}
    assert np.mean([abs(size[i] - len(true[i])) / max(1, len(true[i])) for i in true]) < 0.1


def test_edge_rows(spark):
    docs = [(3, "a b c d e f g"), (None, None), (1, ""), (3, "a b c d e f g"), (7, "x"), (5, "word " * 60_000), (9, "é" * 5)]
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, fingerprint string")
    rows = fp.edited_fingerprints(df).collect()
    check(rows, docs)
    assert len({r.fingerprint for r in rows if r.doc_id == 3}) == 1
    assert fp.edited_fingerprints(df.limit(0)).count() == 0
    assert fp.edited_fingerprints(df.where("doc_id = 7")).first().near_next == 1.0


def test_parts_meet(spark):
    docs = [(i * 3, f"text {i} of the small table with words {i % 7}") for i in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    many = fp.with_successors(df, "doc_id", "text", chars_each=9000)
    assert many.select("part").distinct().count() > 10
    assert many.where("ahead").count() == many.select("part").distinct().count()


@pytest.mark.parametrize("k", [16, 128])
def test_merge_is_the_whole(spark, k):
    texts = ["one two three four five six seven", "eight nine ten eleven twelve thirteen", "one two three four five six nine " * 9]
    df = spark.createDataFrame([(1, t) for t in texts] + [(None, None)], "g long, text string")
    got = {r.g: r.fingerprint for r in fp.merge_fingerprints(fp.fingerprints(df, "g", "text", k), "g", k=k).collect()}
    union = np.unique(np.concatenate([fp.sketches([t], k)[0] for t in texts]))[:k]
    assert got == {1: fp.packed(union), None: ""}


def test_compared(spark):
    a, b = (fp.packed(fp.sketches([t])[0]) for t in ("a b c d e f", "a b c d e f g h"))
    r = spark.range(1).select(fp.compared(F.lit(a), F.lit(b)).alias("c")).first().c
    assert (r.resemblance, r.containment, r.distinct_a, r.distinct_b) == (0.5, 1.0, 2.0, 4.0)
