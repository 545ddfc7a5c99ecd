import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import ngram_join as nj
from quarry.llm import registry, setjoin
from quarry.llm.components import components

SF = "/root/testdata/sf0.001"


def words5(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs):
    sets = [words5(t) for _, t in docs]
    root, links, texts = list(range(len(docs))), [0] * len(docs), [set() for _ in docs]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                if sets[i] != sets[j]:
                    texts[i].add(sets[j])
                    texts[j].add(sets[i])
                root[max(find(i), find(j))] = min(find(i), find(j))
    classes = {}
    for i in range(len(docs)):
        classes.setdefault(find(i), []).append(docs[i][0])
    low = {r: min((x for x in c if x is not None), default=None) for r, c in classes.items()}
    return Counter(repr((docs[i][0], low[find(i)], len(classes[find(i)]), links[i], len(texts[i]))) for i in range(len(docs)))


def rows(df):
    return Counter(repr((r.doc_id, r.class_id, r.class_size, r.n_links, r.n_text_links)) for r in df.collect())


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows(registry.QUERIES["op6_ngram_join"](spark, SF)) == brute(docs)


def test_edge_rows(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    near = [" ".join(w if k != e else "new" for k, w in enumerate(base)) for e in (5, 60, 61, 119)]
    docs = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "A  B"), (None, "a b"), (7, "long " * 100_000), *[(10 + i, t) for i, t in enumerate(near)], (10, near[0]), (20, " ".join(rng.sample(base, 100)))]
    df = spark.createDataFrame([(*d, "n") for d in docs], "doc_id long, text string, node string")
    assert rows(nj.ngram_join(df)) == brute(docs)
    assert nj.ngram_join(df.limit(0)).count() == 0
    kept = nj.one_of_each_class(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 7, 10, 20]


def test_texts_that_share_an_id(spark):
    base = [f"w{i}" for i in range(100)]
    near = " ".join([*base[:50], "new", *base[51:]])
    rows = [(1, " ".join(base)), (2, near), (2, "a text of its own, kept"), (None, near), (None, "another of its own"), (2, near)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(map(tuple, nj.one_of_each_class(df).collect()), key=repr)
    assert left == sorted([rows[0], rows[2], rows[4]], key=repr)


def test_group_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    docs = [(i, " ".join("x" if k in {rng.randrange(150) for _ in range(2)} else w for k, w in enumerate(base))) for i in range(45)]
    assert rows(nj.ngram_join(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_bands_reach_the_recall():
    assert setjoin.bands_for(0.8, 0.999, 5) == 18
    rng = np.random.default_rng(1)
    hit = 0
    for _ in range(300):
        common, a, b = np.split(np.unique(rng.integers(0, 1 << 62, 100, np.uint64)), [80, 90])
        x, y = (setjoin.band_hashes([np.sort(np.concatenate([common, z]))], 18, 5)[0] for z in (a, b))
        hit += bool((x == y).any())
    assert hit >= 297


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]])
def test_components(spark, edges):
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: (0 if x <= 40 and len(edges) > 1 else 1 if x <= 40 else 90) for e in edges if e[0] != e[1] for x in e}
