import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import packing, registry

LIBRARY = Tokenizer.from_file(packing.TOKENIZER)
SF = "/root/testdata/sf0.001"


def want(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def check(pieces, docs, length):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for i, text in docs:
        ids, at = want(text), 0
        for p in sorted(by_doc.pop(i), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    assert not by_doc
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
    return len(by_seq)


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    pieces = registry.QUERIES["op10_packing"](spark, SF).collect()
    n = check(pieces, docs, 2048)
    assert n == -(-sum(p.length for p in pieces) // 2048)


def test_edge_rows(spark):
    docs = [(1, None), (None, "lost id"), (2, ""), (3, "long " * 40_000), (4, "a b"), (5, "<|endoftext|> \t x"), (6, "a <|endoftext|><|endoftext|> b<|endoftext|>"), (7, "<|endoftext|>"), (8, "<|endoftext <|end<|endoftext|>oftext|>")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, ids int")
    check(packing.pack(df, length=64, ids_each=5000).collect(), docs, 64)
    assert packing.pack(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab1 '\n\tr!é \x1c", max_size=60), st.lists(st.sampled_from(["<|endoftext|>", "<|", "|>", " ", "\n", "word", "'s", "é"]), max_size=9).map("".join)))
def test_ids_are_those_of_the_tokenizers_library(text):
    assert [*packing.token_ids(text), 1] == want(text)


@pytest.mark.parametrize("dims", [2, 3])
def test_curve_visits_every_cell_once_by_single_steps(dims):
    side = 8
    at = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims).astype(np.uint64)
    keys = packing.hilbert_keys(at, 3)
    assert sorted(keys.tolist()) == list(range(side**dims))
    steps = np.abs(np.diff(at[np.argsort(keys)].astype(int), axis=0)).sum(1)
    assert (steps == 1).all()


def test_neighbours_are_alike(spark):
    rows = [(i, " ".join(np.random.default_rng(i).choice(["red", "green", "blue", "grey"] if i % 2 else ["uno", "dos", "tres", "cuatro"], 60))) for i in range(60)]
    order = [r.doc_id % 2 for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("sequence_id", "offset").where("start = 0").collect()]
    assert sum(a != b for a, b in zip(order, order[1:], strict=False)) <= 6
