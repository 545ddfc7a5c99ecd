import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import registry
from quarry.llm import suffix_dedup as sd
from quarry.llm.induced_sort import repeated_starts

SF = "/root/testdata/sf0.001"


def brute(docs, length):
    raw = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(x[k : k + length] for _, x in raw for k in range(len(x) - length + 1))
    out = []
    for i, x in raw:
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append(repr((i, len(x), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~gone])).hexdigest())))
    return sorted(out)


def rows(df):
    return sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())) for r in df.collect())


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = registry.QUERIES["op4_suffix_dedup"](spark, SF).collect()
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == brute(docs, 400)


@pytest.mark.parametrize("hot", [5_000, 3])
def test_edge_rows(spark, hot, monkeypatch):
    monkeypatch.setattr(sd, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(sd, "SHARD_BYTES", 3_000)
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    shared = [word(n) for n in (30, 45, 80)]
    docs = [(i, word(rng.randrange(40)) + rng.choice(shared) + word(rng.randrange(40)) + rng.choice(shared)) for i in range(60)]
    docs += [(100, None), (101, ""), (None, shared[2]), (102, "ab" * 3_000), (103, "x" * 40), (103, "x" * 40), (104, "short"), (105, shared[0][:20] + "\0" + shared[1])]
    df = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, spans string")
    assert rows(sd.suffix_dedup(df, length=25)) == brute(docs, 25)


def test_empty(spark):
    assert sd.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=50), st.integers(1, 12), st.sampled_from([64, 10**8]))
def test_induced_sort(values, cap, memory):
    text = np.array([*values, 0], np.uint16)
    grams = Counter(tuple(text[i : i + cap].tolist()) for i in range(len(text) - cap + 1))
    assert repeated_starts(text, cap, memory).tolist() == [i + cap <= len(text) and grams[tuple(text[i : i + cap].tolist())] > 1 for i in range(len(text))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=60), max_size=5), st.integers(4, 20))
def test_segments_cover_each_string_once(raw, length):
    found = sd.segments(raw, length)
    got = sorted((r.text, r.start + k) for r in found.itertuples() for k in range(r.strings))
    assert got == [(t, k) for t, x in enumerate(raw) for k in range(len(x) - length + 1)]
    names = {}
    for r in found.itertuples():
        for k in range(r.strings):
            part = raw[r.text][r.start + k : r.start + k + length]
            assert names.setdefault(part, r.minimizer) == r.minimizer
