import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import bpe, registry

SF = "/root/testdata/sf0.001"


def want(text):
    return bpe.encoding(bpe.VOCABULARY).encode_ordinary(text or "")


def test_query_against_library(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registry.QUERIES["op8_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = want(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


TEXTS = [None, "", "short", "don't   stop\n\n  we're here " * 9, "a" * 400, " " * 300 + "x" * 90, "\n \n" * 100 + "it's", "é日本語 ١٢٣ ½ '" * 30, "word " * 60, "they'll've 'll 're" * 20, "x'" * 100]


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 16), (33, 32), (64, 8)])
def test_small_chunks(spark, chunk, overlap):
    rows = [(i % 5 if i else None, t) for i, t in enumerate(TEXTS + TEXTS[3:5])]
    got = bpe.encode(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids long"), chunk_chars=chunk, overlap=overlap)
    found = sorted((repr(r.doc_id), bytes(r.ids)) for r in bpe.decode(got).collect() if [r.n_tokens] == [len(r.ids) // 4])
    assert found == sorted((repr(i), np.array(want(t), "<u4").tobytes()) for i, t in rows)
    assert sorted(bytes(r.decoded).decode() for r in bpe.decode(got).collect()) == sorted(t or "" for _, t in rows)


def test_empty(spark):
    assert bpe.decode(bpe.encode(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1 '\n\tre!é", min_size=1, max_size=80), st.integers(5, 30), st.integers(5, 30))
def test_cuts_change_nothing(text, chunk, overlap):
    """The seam rule without Spark: pieces cut at agreed boundaries give the library's ids."""
    n, cuts = -(-len(text) // chunk), [0]
    for c in range(n - 1):
        a, b = (text[k * chunk : (k + 1) * chunk + overlap] for k in (c, c + 1))
        sure = [k * chunk + len(x) - (0 if k == n - 1 else bpe.UNSURE) for k, x in ((c, a), (c + 1, b))]
        tail = bpe.boundaries(a, c * chunk, (c + 1) * chunk, sure[0])
        head = bpe.boundaries(b, (c + 1) * chunk, (c + 1) * chunk, min(sure[1], (c + 1) * chunk + overlap))
        if not (both := set(tail) & set(head)):
            return
        cuts.append(min(both))
    cuts.append(len(text))
    assert [x for i, j in zip(cuts, cuts[1:], strict=False) for x in want(text[i:j])] == want(text)
