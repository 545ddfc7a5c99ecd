"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are its words and word pairs, and the same over word shapes (letters as X or x, digits as
9, runs cut to two, marks as they are); a pair of equal words is one feature whatever the word. Each of these
four kinds has values sqrt(count / total). A score is the logistic function of a sparse dot product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.words import BASE, mixed

DIM = 1 << 18
THRESHOLD = 0.7
#: Labelled rows that training reads at most, chosen by a hash of their id: bounds its one task.
MAX_LABELLED = 12_000
HELD_OUT = 2
EPOCHS = 2
#: Of the updates: learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.001
RUN = re.compile(r"(.)\1{2,}")


def shape(word: str) -> str:
    marks = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return RUN.sub(r"\1\1", marks)


class Pairs(dict):
    """word -> (hash, hash of its shape), emptied when full."""

    limit = 200_000

    def __missing__(self, word: str) -> tuple[int, int]:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word.lower()), xxhash.xxh64_intdigest(shape(word), 1)
        return found


_pairs = Pairs()


def features(text: str | None, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features; the last place of the vector is the bias."""
    words = (text or "").split()
    places, values = [np.array([dim])], [np.ones(1)]
    if words:
        both = np.array(list(map(_pairs.__getitem__, words)), np.uint64)
        for kind in (0, 1):
            w = both[:, kind]
            two = mixed(w[:-1] * BASE + w[1:])
            if not kind:
                two[w[:-1] == w[1:]] = 1
            for h in (w, two):
                if len(h):
                    at, counts = np.unique((mixed(h) % np.uint64(dim)).astype(np.int64), return_counts=True)
                    places.append(at)
                    values.append(np.sqrt(counts / len(h)))
    return np.concatenate(places), np.concatenate(values)


def fitted(examples: list[tuple[np.ndarray, np.ndarray, int]], dim: int = DIM, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after follow-the-regularised-leader updates over the examples in order. Values that share a place are added up first."""
    whole = []
    for at, x, label in examples:
        at, own = np.unique(at, return_inverse=True)
        whole.append((at, np.bincount(own, x), label))
    z, n = np.zeros(dim + 1), np.zeros(dim + 1)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, label in whole:
            w = weights(z[at], n[at])
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(z, n)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED, dim: int = DIM) -> np.ndarray:
    """Weights fitted on at most `max_labelled` labelled rows that are not held out.

    Rows are chosen and ordered by a hash of their id. Rows without id or label are left out; of labels that
    repeat an id the largest counts. Without labelled rows all weights are 0, and every score 0.5.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)  # so many rows of two numbers: may be broadcast
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [features(t, dim) for t in frame["__text"]]
            yield pd.DataFrame({"id": frame["__id"], "label": frame["__label"], "at": [a.astype("<i4").tobytes() for a, _ in found], "x": [x.astype("<f4").tobytes() for _, x in found]})

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["order", "id", "x"])
        examples = [(np.frombuffer(a, "<i4"), np.frombuffer(x, "<f4").astype(float), y) for a, x, y in zip(frame["at"], frame["x"], frame["label"], strict=True)]
        return pd.DataFrame({"weights": [fitted(examples, dim).astype("<f4").tobytes()]})

    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.mapInPandas(places, f"id {kind}, label int, at binary, x binary").withColumn("order", F.xxhash64("id")).withColumn("one", F.pmod("order", F.lit(1))).groupBy("one").applyInPandas(fit, "weights binary").first()
    return np.frombuffer(found["weights"], "<f4") if found else np.zeros(dim + 1, "<f4")


def score(text: Column, weights: np.ndarray) -> Column:
    """Score of a text column, 0 to 1. A null or empty text has the score of the bias alone."""
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast(weights)  # of the fixed size `dim`

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        w = shared.value
        found = (features(t, len(w) - 1) for t in texts)
        return pd.Series([1 / (1 + np.exp(-np.clip(w[at] @ x, -35, 35))) for at, x in found], dtype=float)

    return run(text)


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`id, held_out, score, predicted` of each row; a null id is not held out."""
    weights = train(docs, labels, id_col, text_col)
    scored = docs.select(id_col, held_out(F.col(id_col)).alias("held_out"), score(F.col(text_col), weights).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that the classifier accepts, with their columns."""
    weights = train(docs, labels, id_col, text_col)
    return docs.where(score(F.col(text_col), weights) >= threshold)
