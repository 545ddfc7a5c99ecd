import math
from collections import Counter

import pytest

from quarry.llm import lm_score, registry
from tests.llm.oracle import tables

SF = "/root/testdata/sf0.001"


def test_query_matches_sql(spark):
    want = {r[0]: r for r in tables(SF).execute(registry.ORACLES["op1_lm_score"]).fetchall()}
    got = registry.QUERIES["op1_lm_score"](spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_words, r.n_full_context) == w[1:3]
        assert r.log_score == pytest.approx(w[3], abs=2e-3) and (r.mean_log_score is None) == (w[4] is None)


def brute(docs, corpus, order, own):
    split = lambda t: (t or "").lower().split()
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum((grams(split(t)) for t in corpus), Counter())
    size, out = sum(len(split(t)) for t in corpus), []
    for i, t in docs:
        w, mine = split(t), grams(split(t)) if own else Counter()
        left, score = size - len(w) * own, 0
        for k in range(len(w)):
            for n in range(min(order, k + 1), 0, -1):
                g = tuple(w[k - n + 1 : k + 1])
                c = total[g] - mine[g]
                if n == 1:
                    score += math.log(max(c, 1) / max(left, 1))
                elif c > 0:
                    score += math.log(c / (total[g[:-1]] - mine[g[:-1]]))
                    break
                else:
                    score += math.log(0.4)
        out.append((i, len(w), score))
    return out


TEXTS = ["the cat sat on the mat", "The cat sat down", None, "", "x", "the cat sat on the mat", "a a a a", "word " * 90_000]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_brute_force(spark, order, monkeypatch):
    monkeypatch.setattr(lm_score, "BATCH_CHARS", 500)
    monkeypatch.setattr(lm_score, "RANGE_CHARS", 100_000)
    docs = [(None if i == 1 else i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0])]
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, log_score double")
    for corpus in (None, ["the cat sat", "a dog sat on the cat", None]):
        other = None if corpus is None else spark.createDataFrame([(i, t) for i, t in enumerate(corpus)], "doc_id long, text string")
        got = sorted((repr(r.doc_id), r.n_words, round(r.log_score, 5)) for r in lm_score.lm_scores(df, other, order=order).collect())
        assert got == sorted((repr(i), n, round(s + 0.0, 5)) for i, n, s in brute(docs, corpus or [t for _, t in docs], order, corpus is None))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.lm_scores(df).count() == 0
    assert lm_score.lm_scores(spark.createDataFrame([(1, "a b")], df.schema), df).first().n_words == 2
