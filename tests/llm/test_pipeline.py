import hashlib

import pytest

from quarry.llm import packing
from tests.llm import test_ngram_join as tn
from tests.llm import test_packing as tp
from tests.llm import test_substring_dedup as ts

SF = "/root/testdata/sf0.001"
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    read = lambda df: [(r.doc_id, r.text) for r in df.collect()]

    def done(name, df):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    one = done("one", stages["quality classifier"](spark, docs, SF))
    left = {r.doc_id for r in one.collect()}
    known = labels.collect()
    assert sum(r.doc_id in left for r in known if r.quality) >= 0.95 * sum(r.quality for r in known)
    assert sum(r.doc_id in left for r in known if not r.quality) <= 0.5 * sum(not r.quality for r in known)  # 200 documents train little

    two = done("two", stages["exact dedup"](spark, one, SF))
    groups = {}
    for i, t in read(one):
        key = hashlib.sha256("".join(c.lower() if c.isascii() else c for c in t).encode()).digest()
        groups[key] = max(i, groups.get(key, i))
    assert sorted(i for i, _ in read(two)) == sorted(groups.values())

    three = done("three", stages["n-gram Jaccard join"](spark, two, SF))
    keep = sorted({eval(k)[1] for k in tn.brute(read(two))})
    assert sorted(i for i, _ in read(three)) == keep

    four = done("four", stages["substring dedup"](spark, three, SF))
    ts.check_left(read(three), dict(read(four)), 30)
    assert all(df.columns == columns for df in (one, two, three, four))
    assert all(r.n_chars == len(r.text) for r in four.collect())

    tp.check(stages["packing"](spark, four, SF).collect(), read(four), packing.LENGTH)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
