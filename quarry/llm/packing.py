"""Packing of tokenised documents into sequences along a space-filling curve.

Each document becomes a hashed vector of token counts, which a fixed random matrix projects to three
dimensions. Documents are range-sorted by the Hilbert key of that point, so that neighbours on the curve are
alike, and their ids are laid end to end along it and cut every `length` ids. Only the last sequence of each
range needs padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import partitions_for, written
from quarry.llm.words import mixed

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 1
LENGTH = 2048
#: Of the hashed vectors, of the space of the curve, and bits for each of its dimensions.
HASHED, DIMS, BITS = 4096, 3, 16
BATCH_ROWS = 256
#: Ids of finished pieces that a task holds before it hands them on.
HELD_IDS = 500_000
#: Sequence ids of a task start at its number times this.
SEQUENCES_A_TASK = 1 << 36


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves, the others for 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def encoding(path: str) -> tiktoken.Encoding:
    """Encoder over the vocabulary of a byte-level tokenizers file, whose ids are in the order of its merges.

    It gives the ids of the tokenizers library at some four times its speed.
    """
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    of, added = byte_alphabet(), {x["content"]: x["id"] for x in found.get("added_tokens", ())}
    ranks = {bytes(map(of.__getitem__, token)): i for token, i in found["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def token_ids(text: str, path: str = TOKENIZER) -> np.ndarray:
    """Ids of a text as the tokenizers library gives them without special tokens of its own: a token that the file adds to its vocabulary is one id wherever the text spells it."""
    return encoding(path).encode_to_numpy(text, allowed_special="all")


def id_type(size: int) -> np.dtype:
    return np.dtype("<u2" if size <= 65_536 else "<u4")


@lru_cache(1)
def projection(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each id in the hashed vector, and the matrix that projects it."""
    return (mixed(np.arange(size, dtype=np.uint64)) % np.uint64(HASHED)).astype(np.int64), np.random.default_rng(7).standard_normal((HASHED, DIMS))


def points(ids: list[np.ndarray], vocabulary: int) -> np.ndarray:
    """Integer coordinates of each document in the cube of the curve; the middle for a document without ids."""
    place, matrix = projection(vocabulary)
    out = np.zeros((len(ids), DIMS))
    for i, x in enumerate(ids):
        if len(x):
            counts = np.bincount(place[x], minlength=HASHED)
            out[i] = counts @ matrix / np.sqrt((counts * counts).sum())
    return np.clip((out + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint64)


def hilbert_keys(at: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places along the Hilbert curve of integer points (rows of `at`), by the transposed Gray-code form."""
    x = [at[:, d].astype(np.uint64) for d in range(at.shape[1])]
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        bit, low = one << np.uint64(b), (one << np.uint64(b)) - one
        for d in range(len(x)):
            high = (x[d] & bit) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
    for d in range(1, len(x)):
        x[d] = x[d] ^ x[d - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (one << np.uint64(b)) != 0, (one << np.uint64(b)) - one, np.uint64(0))
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(len(x)):
            key = (key << one) | (((x[d] ^ turn) >> np.uint64(b)) & one)
    return key.astype(np.int64)


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """`id, curve_key, n_ids, ids` of each row: ids with the end id, packed as the narrowest unsigned integers that hold the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = encoding(path).n_vocab
        dtype = id_type(size)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(start, BATCH_ROWS)
                ids = [np.append(token_ids(t, path), np.uint32(end_id)).astype(dtype) for t in batch.column(1).to_pylist()]
                keys = hilbert_keys(points([x[:-1] for x in ids], size))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], [id_col, "curve_key", "n_ids", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, curve_key long, n_ids long, ids binary")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER, end_id: int = END_ID, length: int = LENGTH, ids_each: int = 4_000_000) -> DataFrame:
    """A row for each piece of a document in a sequence.

    Returns `id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset, curve_key`: `ids` (array<int>)
    begin at `start` among the document's ids and lie at `offset` in their sequence; ids_crc32 is that of the
    ids as little-endian unsigned 32-bit integers. Each id lies in exactly one piece.
    A null or empty text is one piece, the end id. Rows that repeat are packed as often as they come.
    """
    spark = docs.sparkSession
    table = written(tokenised(docs, id_col, text_col, path, end_id), "tokenised")  # the range sort samples it: not to be encoded twice
    total = table.agg(F.coalesce(F.sum("n_ids"), F.lit(0))).first()[0]
    sorted_ranges = table.repartitionByRange(partitions_for(spark, total, ids_each), "curve_key", id_col).sortWithinPartitions("curve_key", id_col)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId() * SEQUENCES_A_TASK * length
        names, rows, held = [id_col, "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve_key"], [], 0
        for frame in frames:
            for doc, key, n, raw in zip(frame[id_col], frame["curve_key"], frame["n_ids"], frame["ids"], strict=True):
                ids, start = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<i4"), 0
                while start < n:
                    m = min(n - start, length - at % length)
                    part = ids[start : start + m]
                    rows.append((doc, start, m, part, zlib.crc32(part.tobytes()), n, at // length, at % length, key))
                    start, at = start + m, at + m
                held += n
                if held > HELD_IDS:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return sorted_ranges.mapInPandas(run, f"`{id_col}` {kind}, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve_key long")
