"""Bottom-k document fingerprints.

A fingerprint holds the k smallest hashes of a text's distinct word shingles, cut to 48 bits, as base64
text. Fingerprints of parts merge to that of the whole. Two of them estimate resemblance (Jaccard) and
containment, one the number of distinct shingles; with k shingles or fewer all three are exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import partitions_for, total_chars
from quarry.llm.words import shingles

K = 128
BITS = 48
BATCH = 256
#: Runs of ids at most, whose first ids the driver holds. A longer run takes longer and no more memory.
MAX_RUNS = 20_000


def sketches(texts: list[str | None], k: int = K, size: int = 5) -> list[np.ndarray]:
    return [np.unique(s[:k] >> np.uint64(64 - BITS)) for s in shingles(texts, size)[0]]


def packed(sketch: np.ndarray) -> str:
    raw = sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :]
    return base64.b64encode(raw.tobytes()).decode("ascii")


def unpacked(fingerprint: str | None) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint or ""), np.uint8).reshape(-1, BITS // 8)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - BITS // 8 :] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles behind a sketch."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**BITS / (float(a[-1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; 1 for two texts without words, 0 if only one has none."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merged(a, b, k)
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True)) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b also has; 1 if a has none."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merged(a, b, k), k) / distinct(a, k))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = 5) -> DataFrame:
    """`id, fingerprint` of each row; null texts count as empty, whose fingerprint is the empty string."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["__text"].tolist()
            yield pd.DataFrame({id_col: frame[id_col], "fingerprint": [packed(s) for i in range(0, len(texts), BATCH) for s in sketches(texts[i : i + BATCH], k, size)]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).alias("__text")).mapInPandas(run, f"`{id_col}` {kind}, fingerprint string")


def merge_fingerprints(df: DataFrame, group_col: str, fingerprint_col: str = "fingerprint", k: int = K) -> DataFrame:
    """One fingerprint for each group: merged within each task first, so that a huge group sends one row a task."""

    def fold(frame: pd.DataFrame) -> str:
        return packed(np.unique(np.concatenate([unpacked(x) for x in frame["fingerprint"]]))[:k])

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield from (pd.DataFrame({"group": part["group"].iloc[:1], "fingerprint": [fold(part)]}) for _, part in frame.groupby("group", dropna=False))

    kind = f"group {df.schema[group_col].dataType.simpleString()}, fingerprint string"
    rows = df.select(F.col(group_col).alias("group"), F.col(fingerprint_col).alias("fingerprint")).mapInPandas(partial, kind)
    return rows.groupBy("group").applyInPandas(lambda part: pd.DataFrame({"group": part["group"].iloc[:1], "fingerprint": [fold(part)]}), kind).withColumnRenamed("group", group_col)


def compared(a: Column, b: Column, k: int = K) -> Column:
    """struct(resemblance, containment, distinct_a, distinct_b) of two fingerprint columns."""

    @F.pandas_udf("resemblance double, containment double, distinct_a double, distinct_b double")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        pairs = [(unpacked(i), unpacked(j)) for i, j in zip(x, y, strict=True)]
        return pd.DataFrame([(resemblance(i, j, k), containment(i, j, k), distinct(i, k), distinct(j, k)) for i, j in pairs], columns=["resemblance", "containment", "distinct_a", "distinct_b"])

    return run(a, b)


def with_successors(docs: DataFrame, id_col: str, text_col: str, chars_each: int = 4_000_000) -> DataFrame:
    """Rows `part, key, id, text, ahead`, sorted by part, ahead, key and text: each part holds a run of ids and the row that follows it.

    Runs of ids are cut at quantiles, one number a run and MAX_RUNS at most; the first row of each run is sent to
    the run before it as well, marked `ahead` (the very first to the last). So each row's successor comes next
    in its partition. Null ids come first.
    """
    rows, chars = total_chars(docs, text_col)
    keyed = docs.select(F.coalesce(F.col(id_col), F.lit(-(2**63))).cast("long").alias("key"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = min(MAX_RUNS, partitions_for(docs.sparkSession, max(chars, rows * 400), chars_each))
    cuts = sorted(set(keyed.approxQuantile("key", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 and rows else []
    bounds = np.array(cuts, np.float64)

    @F.pandas_udf("int")
    def part(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), "right"))

    firsts = [(r["part"], r["first"]) for r in keyed.select("key").withColumn("part", part("key")).groupBy("part").agg(F.min("key").alias("first")).orderBy("part").collect()]  # a number a run
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}

    @F.pandas_udf("int")
    def ahead_of(key: pd.Series) -> pd.Series:
        return key.map(before).astype("Int32")

    places = F.filter(F.array(F.struct(F.col("__part").alias("part"), F.lit(False).alias("ahead")), F.struct(F.col("__ahead").alias("part"), F.lit(True).alias("ahead"))), lambda x: x["part"].isNotNull())
    spread = keyed.withColumn("__part", part("key")).withColumn("__ahead", ahead_of("key"))
    return spread.select("key", "id", "text", F.inline(places)).repartition(max(1, len(firsts)), "part").sortWithinPartitions("part", "ahead", "key", "text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = 5) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of the next
    row's text in ascending id; the first row follows the last. Null texts count as empty, null ids come
    first, rows with the same id are ordered by text. Returns a row for each input row: `id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`.
    """

    kind = docs.schema[id_col].dataType.simpleString()
    integral = kind in ("bigint", "int", "smallint", "tinyint")
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []  # the last row, whose successor is yet to come
        for frame in frames:
            for start in range(0, len(frame), BATCH):
                some = frame.iloc[start : start + BATCH]
                texts = some["text"].tolist()
                held += zip(some["part"].tolist(), some["ahead"].tolist(), some["id"].astype(object).where(some["id"].notna(), None), texts, sketches(texts, k, size), strict=True)
                pairs = [(a, b) for a, b in zip(held, held[1:], strict=False) if not a[1] and a[0] == b[0]]
                held = held[-1:]
                edited = [a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2] for a, b in pairs]
                rows = [
                    (a[2], len(a[3]), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), packed(a[4]), packed(e), resemblance(a[4], e, k), resemblance(a[4], b[4], k))
                    for (a, b), text, e in zip(pairs, edited, sketches(edited, k, size), strict=True)
                ]
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({"id": "Int64"}) if integral else out

    return with_successors(docs, id_col, text_col).mapInPandas(run, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)
