"""Removal of byte strings that repeat anywhere in a corpus, by suffix order within shards.

A string of `length` bytes is dealt by its minimizer, the least hash of its short substrings: equal strings
have the same one, wherever they lie. Neighbouring strings with the same minimizer travel together, as a
segment. A minimizer that occurs once in the corpus can't belong to a repeated string; a bitmap of fixed size
tells which may occur again, and only their segments leave their task. Equal segments are counted before they
are dealt. A shard's distinct segments form its text, whose suffixes induced_sort puts in order, with common
prefixes, on disk where they are large: neighbours that share `length` bytes repeat.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.induced_sort import repeated_starts
from quarry.llm.shared import BITMAP_ROW_BITS, partitions_for, written
from quarry.llm.words import BASE, mixed

LENGTH = 400
#: Bytes under a minimizer's hash (a power of two).
GRAM = 32
BATCH_BYTES, SHARD_BYTES = 1_000_000, 8_000_000
#: Distinct segments of one minimizer above which they are cut anew by another hash, and how often.
HOT_SEGMENTS, ROUNDS = 5_000, 3


def sliding(values: np.ndarray, width: int, smallest: bool) -> np.ndarray:
    """Least or largest value of each window of `width`."""
    n = len(values)
    if n < width:
        return values[:0]
    pick, fill = (np.minimum, np.uint64(2**64 - 1)) if smallest else (np.maximum, np.uint64(0))
    blocks = np.concatenate([values, np.full(-n % width, fill, np.uint64)]).reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - width + 1], ahead[width - 1 : n])


def segments(raw: list[bytes], length: int, seed: int = 0) -> pd.DataFrame:
    """Maximal runs of strings with one minimizer: `text, start, strings, minimizer, again`.

    Strings never cross texts. `again`: the minimizer occurs twice within the segment, which then may repeat itself.
    """
    sizes = np.array([len(x) for x in raw])
    flat = np.frombuffer(b"".join(raw), np.uint8)
    gram = min(GRAM, 1 << (length.bit_length() - 1))
    names = ["text", "start", "strings", "minimizer", "again"]
    if len(flat) < length:
        return pd.DataFrame({c: np.empty(0, np.int64) for c in names}).astype({"again": bool})
    h, factor, step = flat.astype(np.uint64) + np.uint64(1), BASE, 1
    while step < gram:
        h = h[:-step] * factor + h[step:]
        factor, step = np.uint64(int(factor) ** 2 % 2**64), step * 2
    h = mixed(h ^ mixed(np.uint64(seed)))
    width = length - gram + 1
    least = sliding(h, width, True)
    of = np.repeat(np.arange(len(raw)), sizes)
    inside = of[: len(least)] == of[length - 1 :]
    breaks = np.flatnonzero((least[1:] != least[:-1]) | (of[1 : len(least)] != of[: len(least) - 1]) | (inside[1:] != inside[:-1])) + 1
    start, end = np.append(0, breaks), np.append(breaks, len(least))
    start, end = start[inside[start]], end[inside[start]]
    # places whose hash is the minimizer of a string that holds them, and how many of them each segment holds
    padding = np.zeros(width - 1, np.uint64)
    most = sliding(np.concatenate([padding, np.where(inside, least, np.uint64(0)), padding]), width, False)
    places = np.flatnonzero(h == most)
    low, high = np.searchsorted(places, start), np.searchsorted(places, end + width - 1)
    many = high - low
    owner = np.repeat(np.arange(len(start)), many)
    place = places[np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)]
    times = np.bincount(owner, h[place] == least[start[owner]], len(start))
    text = of[start]
    return pd.DataFrame({"text": text, "start": start - (np.cumsum(sizes) - sizes)[text], "strings": end - start, "minimizer": least[start].view(np.int64), "again": times > 1})


def batches_of(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        held.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size > BATCH_BYTES:
            yield first, held
            held, size, first = [], 0, i + 1
    yield first, held


def runs_of(marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(marks.astype(np.int8), prepend=0, append=0))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


SEGMENT = "doc_hash long, start long, minimizer long, segment long, strings long, again boolean, bytes binary"


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, bitmap_rows: int = 2_048) -> DataFrame:
    """`id, doc_hash, spans` of each text with repeated strings: spans are the byte ranges (start, end) to remove.

    Every byte under a string of `length` bytes that also starts anywhere else in the corpus, the same text
    included, lies in a span. Spans are disjoint, apart and in order. doc_hash is xxhash64 of the text and
    tells rows with the same id apart; rows that repeat both count as two texts and share their spans.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("doc_hash"), F.col(text_col).alias("text")).where(F.octet_length("text") >= length)

    def minimizers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, raw in batches_of(frame["text"].tolist()):
                found = segments(raw, length)
                yield pd.DataFrame({"minimizer": found["minimizer"], "n": found["again"] + 1})

    slot = F.pmod(F.col("minimizer"), F.lit(bitmap_rows * BITMAP_ROW_BITS)) + 1
    again = rows.select("text").mapInPandas(minimizers, "minimizer long, n long").groupBy("minimizer").agg(F.sum("n").alias("n")).where("n > 1")
    bits = np.zeros(bitmap_rows * BITMAP_ROW_BITS // 8, np.uint8)
    for r in again.groupBy(F.bitmap_bucket_number(slot).alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).toLocalIterator():  # bitmap_rows x 4 KB
        bits[(r["row"] - 1) * BITMAP_ROW_BITS // 8 :][: len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first, raw in batches_of(frame["text"].tolist()):
                found = segments(raw, length)
                at = found["minimizer"].to_numpy().view(np.uint64) % np.uint64(bitmap_rows * BITMAP_ROW_BITS)
                found = found[(shared.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                parts = [raw[t][s : s + n + length - 1] for t, s, n in zip(found["text"], found["start"], found["strings"], strict=True)]
                own = frame.iloc[found["text"] + first]
                yield pd.DataFrame({"id": own["id"].array, "doc_hash": own["doc_hash"].array, "start": found["start"].array, "minimizer": found["minimizer"].array, "segment": np.array([xxhash.xxh64_intdigest(p) for p in parts], np.uint64).view(np.int64), "strings": found["strings"].array, "again": found["again"].array, "bytes": parts})

    table = written(rows.mapInPandas(cut, f"id {kind}, {SEGMENT}"), "segments")

    def recut(seed: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                parts = frame["bytes"].tolist()
                found = segments(parts, length, seed)
                own = frame.iloc[found["text"]]
                cuts = [parts[t][s : s + n + length - 1] for t, s, n in zip(found["text"], found["start"], found["strings"], strict=True)]
                key = mixed(own["minimizer"].to_numpy().view(np.uint64) * BASE + found["minimizer"].to_numpy().view(np.uint64)).view(np.int64)
                yield pd.DataFrame({"id": own["id"].array, "doc_hash": own["doc_hash"].array, "start": own["start"].to_numpy() + found["start"].to_numpy(), "minimizer": key, "segment": np.array([xxhash.xxh64_intdigest(p) for p in cuts], np.uint64).view(np.int64), "strings": found["strings"].array, "again": found["again"].array, "bytes": cuts})

        return run

    for seed in range(1, ROUNDS + 1):
        hot = table.select("minimizer", "segment").distinct().groupBy("minimizer").count().where(F.col("count") > HOT_SEGMENTS).select("minimizer")
        if hot.isEmpty():
            break
        hot = written(hot, "hot")
        again_cut = table.join(hot, "minimizer", "left_semi").select(table.columns).mapInPandas(recut(seed), f"id {kind}, {SEGMENT}")
        table = written(table.join(hot, "minimizer", "left_anti").select(table.columns).unionByName(again_cut), "segments")

    distinct = table.groupBy("minimizer", "segment").agg(F.first("bytes").alias("bytes"), F.first("strings").alias("strings"), F.max("again").alias("again"), F.count(F.lit(1)).alias("copies"))
    distinct = written(distinct, "distinct-segments")
    kinds = distinct.groupBy("minimizer").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.length("bytes")).alias("size"), F.max("again").alias("any_again")).where("kinds > 1 OR any_again")
    amount = kinds.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = partitions_for(spark, amount, SHARD_BYTES)

    def in_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, begins, at = [], [], 0
        with tempfile.TemporaryFile() as file:  # a shard's text: values from 1, and 0 after each segment
            for frame in frames:
                held.append((frame["minimizer"].array, frame["segment"].array, frame["strings"].to_numpy()))
                for part in frame["bytes"]:
                    file.write(np.append(np.frombuffer(part, np.uint8).astype(np.uint16) + np.uint16(1), np.uint16(0)).tobytes())
                    begins.append(at)
                    at += len(part) + 1
            if not held:
                return
            file.flush()
            marks = repeated_starts(np.memmap(file, np.uint16, "r", shape=(at,)), length)
        begin, i = np.array(begins), 0
        for minimizer, segment, strings in held:
            own = [runs_of(marks[b : b + n]) for b, n in zip(begin[i : i + len(strings)], strings, strict=True)]
            i += len(strings)
            yield pd.DataFrame({"minimizer": minimizer, "segment": segment, "runs": [[{"a": a, "b": b} for a, b in r] for r in own]})

    several = distinct.join(kinds.select("minimizer"), "minimizer").select("minimizer", "segment", "strings", "bytes")
    ordered = several.repartition(shards, "minimizer").mapInPandas(in_order, "minimizer long, segment long, runs array<struct<a:long,b:long>>")
    # all strings of a segment that came more than once repeat; of the others, those that the order shows
    found = distinct.select("minimizer", "segment", "strings", "copies").join(ordered, ["minimizer", "segment"], "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("strings").alias("b")))
    found = found.withColumn("runs", F.when(F.col("copies") > 1, whole).otherwise(F.col("runs"))).where(F.size("runs") > 0).select("minimizer", "segment", "runs")
    placed = table.select("id", "doc_hash", "start", "minimizer", "segment").join(found, ["minimizer", "segment"]).select("id", "doc_hash", F.transform("runs", lambda r: F.struct((F.col("start") + r["a"]).alias("start"), (F.col("start") + r["b"] + (length - 1)).alias("end"))).alias("spans"))
    return placed.groupBy("id", "doc_hash").agg(F.flatten(F.collect_set("spans")).alias("spans")).withColumn("spans", _merged(F.col("spans"))).withColumnRenamed("id", id_col)


def _merged(spans: Column) -> Column:
    """Overlapping and touching spans as one."""

    @F.pandas_udf("array<struct<start:long,end:long>>")
    def run(column: pd.Series) -> pd.Series:
        def merge(spans) -> list[dict]:
            out: list[dict] = []
            for a, b in sorted((s["start"], s["end"]) for s in spans):
                if out and a <= out[-1]["end"]:
                    out[-1]["end"] = max(out[-1]["end"], b)
                else:
                    out.append({"start": a, "end": b})
            return out

        return column.map(merge)

    return run(spans)


def without_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, n_bytes, n_removed, n_spans, kept` of each row: kept is what is left of the text's bytes. A null text is empty."""

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def run(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, own in zip(texts, spans, strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            own = [] if own is None else own
            edges = [0, *(x for s in own for x in (s["start"], s["end"])), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((len(raw), len(raw) - len(kept), len(own), kept))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    own = spans.select(F.col(id_col).alias("__id"), F.col("doc_hash").alias("__hash"), "spans")
    joined = rows.join(own, rows[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64("__text") == F.col("__hash")), "left")
    return joined.select(id_col, run("__text", "spans").alias("x")).select(id_col, "x.*")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """repeated_spans, cut out of the texts: a row for each row of `docs`."""
    return without_spans(docs, repeated_spans(docs, id_col, text_col, length), id_col, text_col)
