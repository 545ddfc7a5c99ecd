"""Byte-level BPE encoding and decoding.

A text of at most `chunk_chars` characters is one chunk. A longer one is cut into chunks that overlap, which
different tasks pre-tokenise. Where two neighbours share a pre-token boundary in their overlap, they agree
from there on, since a match depends only on what follows it; the text is cut at the first such place and
the pieces are encoded independently. Decoding concatenates the raw bytes of the tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: A boundary this close to the end of a cut slice may move once more text follows: contractions have up to 3 characters.
UNSURE = 4
BATCH_ROWS = 512


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(2)
def encoding(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(2)
def token_bytes(path: str) -> dict[int, bytes]:
    return {rank: raw for raw, rank in ranks(path).items()}


def packed_ids(text: str | None, path: str) -> bytes:
    return encoding(path).encode_to_numpy(text or "", allowed_special=set(), disallowed_special=()).astype("<u4").tobytes()


def boundaries(text: str, start: int, low: int, high: int) -> list[int]:
    """Ends of pre-tokens of a slice that begins at `start`, as places in the whole text, in [low, high].

    Only those after a character that is no white space: a cut there changes no match before it.
    """
    out = []
    for match in regex.finditer(public_tokenizers.PATTERN, text):
        at = match.end() + start
        if at > high:
            break
        if at >= low and not text[match.end() - 1].isspace():
            out.append(at)
    return out


def _encoded(df: DataFrame, text_col: str, path: str, others: list[str]) -> DataFrame:
    """`others`, n_tokens, ids: each text encoded in one go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                ids = [packed_ids(t, path) for t in batch.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], [*others, "n_tokens", "ids"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)
    return df.select(*others, text_col).mapInArrow(run, f"{schema}, n_tokens long, ids binary")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, chunk_chars: int = 16_384, overlap: int = 1_024) -> DataFrame:
    """`id, n_tokens, ids` of each row: ids are little-endian unsigned 32-bit integers, as the tiktoken library gives.

    A null text counts as empty and has no ids. Rows may repeat, ids may be null. A text whose chunks nowhere
    agree within an overlap (one pre-token longer than that) is encoded whole, in one task.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk_chars
    short = _encoded(rows.where(~is_long), "text", path, ["id"])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, text in zip(frame["key"], frame["text"], strict=True):
                n = -(-len(text) // chunk_chars)
                yield pd.DataFrame({"key": key, "chunk": range(n), "n": n, "text": [text[c * chunk_chars : (c + 1) * chunk_chars + overlap] for c in range(n)]})

    # equal texts are encoded once: their chunks meet in the one shuffle of texts, which also spreads a long text over tasks
    long = rows.where(is_long).withColumn("key", F.sha2("text", 256))
    uses = long.groupBy("key", "id").agg(F.count(F.lit(1)).alias("copies"))
    chunks = long.select("key", "text").mapInPandas(cut, "key string, chunk int, n int, text string").groupBy("key", "chunk").agg(F.first("n").alias("n"), F.first("text").alias("text"))

    def seams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            head, tail = [], []
            for c, n, text in zip(frame["chunk"], frame["n"], frame["text"], strict=True):
                start, end = c * chunk_chars, c * chunk_chars + len(text)
                found = boundaries(text, start, start, end if c == n - 1 else end - UNSURE)
                head.append([x for x in found if x <= start + overlap])
                tail.append([x for x in found if x >= start + chunk_chars])
            yield pd.DataFrame({"key": frame["key"], "chunk": frame["chunk"], "n": frame["n"], "head": head, "tail": tail})

    zones = chunks.mapInPandas(seams, "key string, chunk int, n int, head array<long>, tail array<long>")
    of_text = Window.partitionBy("key")
    spans = zones.withColumn("end", F.array_min(F.array_intersect("tail", F.lead("head").over(of_text.orderBy("chunk")))))
    spans = spans.select(
        "key", "chunk", "end", F.coalesce(F.lag("end").over(of_text.orderBy("chunk")), F.lit(0)).alias("start"),
        F.max(F.col("end").isNull() & (F.col("chunk") < F.col("n") - 1)).over(of_text).alias("unmet"),
    )
    placed = chunks.join(spans, ["key", "chunk"])
    first = F.col("start") - F.col("chunk") * chunk_chars
    pieces = placed.where("NOT unmet").select("key", "chunk", F.substring(F.col("text"), (first + 1).cast("int"), F.coalesce(F.col("end") - F.col("start"), F.length("text")).cast("int")).alias("text"))
    cores = placed.where("unmet").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk", F.substring("text", 1, chunk_chars).alias("text")))).alias("parts"))
    whole = cores.select("key", F.lit(0).alias("chunk"), F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("text"))
    # one exchange by text serves the stitching and the join with the rows that have the text
    parts = _encoded(pieces, "text", path, ["key", "chunk"]).unionByName(_encoded(whole, "text", path, ["key", "chunk"]))
    stitched = parts.groupBy("key").agg(F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    # Python would hide the partitioning by text from the join, so that it joins the parts afterwards
    each = uses.join(stitched, "key").select("id", "copies", "n_tokens", joined(F.transform("parts", lambda x: x["ids"])).alias("ids"))
    return short.unionByName(each.select("id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "n_tokens", "ids").drop("copy")).withColumnRenamed("id", id_col)


def joined(parts: Column) -> Column:
    """The byte strings of an array column as one."""

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else b"".join(x) for x in column.to_pylist()], pa.binary())

    return run(parts)


def decoded(ids: Column, path: str = VOCABULARY) -> Column:
    """The bytes that a column of packed ids stands for; null stays null."""

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        words = token_bytes(path)
        return pa.array([None if x is None else b"".join(map(words.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in column.to_pylist()], pa.binary())

    return run(ids)


def decode(encoded: DataFrame, ids_col: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """Adds `decoded`: the raw bytes of the tokens, concatenated."""
    return encoded.withColumn("decoded", decoded(F.col(ids_col), path))
