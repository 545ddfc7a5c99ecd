"""Stupid-backoff scores of documents under the n-gram counts of a corpus.

Relationally: exploded n-grams, grouped by their hash, give the count table; the count table joins the n-grams
back; a sum over each document gives its score. Rows travel packed, since one for each n-gram would take some
eight times the space of the texts. A batch is a run of texts as they are read. It explodes its n-grams of
every order, combines equal ones, and deals the distinct ones to ranges of the hash as arrays of (hash, count):
a frequent n-gram travels once a batch, and a batch sends at most one message a range, never more than one an
n-gram. A range sums its part of the count table and joins it to what each batch asked for; a batch sums the
log scores of its documents. Hashes are of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import partitions_for
from quarry.llm.words import ngram_hashes, word_hashes

ORDER, BACKOFF = 3, 0.4
#: Characters of text in a batch, what a row counts besides, and characters whose n-grams share a range of hashes.
BATCH_CHARS, ROW_CHARS, RANGE_CHARS = 6_000_000, 400, 12_000_000


def squeezed(values: np.ndarray) -> bytes:
    """An integer array, byte plane by byte plane: the high ones are nearly all zero."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def restored(raw: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(dtype).ravel()


def packed_texts(ids: list[str | None], texts: list[str | None], side: int) -> pd.DataFrame:
    """A batch as one row: its texts are one compressed blob, its name is a hash of all that it holds."""
    raw = [None if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    blob = zstandard.ZstdCompressor(level=6).compress(b"".join(r or b"" for r in raw))
    name = xxhash.xxh64_intdigest(repr((ids, xxhash.xxh64_intdigest(blob)))) >> 2 << 1 | side
    return pd.DataFrame([{"batch": name, "ids": ids, "sizes": [-1 if r is None else len(r) for r in raw], "blob": blob}])


def unpacked_texts(frame: pd.DataFrame) -> list[str | None]:
    out: list[str | None] = []
    for sizes, blob in zip(frame["sizes"], frame["blob"], strict=True):
        raw, at = zstandard.ZstdDecompressor().decompress(blob), 0
        for n in sizes:
            out.append(None if n < 0 else raw[at : at + n].decode("utf-8", "surrogatepass"))
            at += max(0, n)
    return out


class Grams:
    """The n-grams of a batch of texts: `own[n]` places those of order n among the distinct hashes `keys`."""

    def __init__(self, texts: list[str | None], order: int):
        words, self.lengths = word_hashes(texts)
        self.doc = np.repeat(np.arange(len(texts)), self.lengths)
        self.starts, hashes = [], []
        for n in range(1, order + 1):
            at = np.arange(max(0, len(words) - n + 1))
            at = at[self.doc[at] == self.doc[at + n - 1]]
            self.starts.append(at)
            hashes.append(ngram_hashes(words, n)[at])
        self.keys, inverse, self.counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        self.own = np.split(inverse, np.cumsum([len(h) for h in hashes])[:-1])

    def scores(self, totals: np.ndarray, corpus_words: int, backoff: float, leave_out_own: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of each document: the sum of log scores, and how many words had their whole context counted."""
        order, size = len(self.own), len(self.doc)
        counts = np.zeros((order + 1, size + 1))  # of the n-gram that starts at each word
        words_left = np.full(size, float(corpus_words))
        for n in range(1, order + 1):
            c = totals[self.own[n - 1]].astype(float)
            if leave_out_own:
                c -= _times(self.doc[self.starts[n - 1]], self.own[n - 1])
            counts[n][self.starts[n - 1]] = c
        if leave_out_own:
            words_left -= self.lengths[self.doc]
        place = np.arange(size) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        # from the unigram up: a longer n-gram that was counted replaces what its suffix gives
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.log(np.maximum(counts[1][:size], 1) / np.maximum(words_left, 1))
            full = np.minimum(place, order - 1) == 0
            full &= counts[1][:size] > 0
            for n in range(2, order + 1):
                at = np.flatnonzero(place >= n - 1)
                top = counts[n][at - n + 1]
                seen = top > 0
                score[at] = np.where(seen, np.log(top / counts[n - 1][at - n + 1]), score[at] + np.log(backoff))
                whole = np.minimum(place[at], order - 1) == n - 1
                full[at] = np.where(whole, seen, full[at])
        return np.bincount(self.doc, score, len(self.lengths)), np.bincount(self.doc, full, len(self.lengths)).astype(np.int64)


def _times(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often each entry's key occurs in its document."""
    _, inverse, counts = np.unique(doc.astype(np.int64) * (int(key.max(initial=0)) + 1) + key, return_inverse=True, return_counts=True)
    return counts[inverse]


def lm_scores(docs: DataFrame, corpus: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, leave_out_own: bool | None = None) -> DataFrame:
    """`id, n_words, n_full_context, log_score, mean_log_score` of each row of `docs`.

    Words are lower-cased and split at blanks. The score of a word is count(n-gram) / count(its context) for
    the longest n-gram of at most `order` words, within the document, that the corpus has; each word of
    context given up costs a factor `backoff`. Without context it is count(word) / words of the corpus, an
    unseen word counts as one. n_full_context is the number of words that gave up none.

    `corpus` has the same columns; by default it is `docs`, and then each document is scored by the counts of
    the others (`leave_out_own`), or else no word would ever back off. All of the corpus is counted. Texts
    without words have log_score 0 and no mean. Rows that repeat are scored alike. `docs` should give its rows in
    the same order each time, as a scan or a written table does: a task that runs again after a loss must form
    the same batches, or the job stops.
    """
    counts_itself = corpus is None
    leave_out_own = counts_itself if leave_out_own is None else leave_out_own
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t or "" for t in frame["text"]]
            yield pd.DataFrame({"chars": [sum(map(len, texts)) + ROW_CHARS * len(texts)], "words": [sum(len(t.split()) for t in texts)]})

    def measured(df: DataFrame) -> tuple[int, int]:
        sums = df.select(F.col(text_col).alias("text")).mapInPandas(measure, "chars long, words long").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("chars", "words")])
        return tuple(sums.first())

    chars, corpus_words = measured(docs if corpus is None else corpus)
    ranges = partitions_for(spark, chars, RANGE_CHARS)
    own_chars = chars if corpus is None else measured(docs)[0]

    def batched(df: DataFrame, side: int, size: int) -> DataFrame:
        def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, texts, held = [], [], 0
            for frame in frames:
                for i, text in zip(frame["id"], frame["text"], strict=True):
                    ids.append(i)
                    texts.append(text)
                    held += len(text or "") + ROW_CHARS
                    if held >= BATCH_CHARS:
                        yield packed_texts(ids, texts, side)
                        ids, texts, held = [], [], 0
            if ids:
                yield packed_texts(ids, texts, side)

        rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
        return rows.mapInPandas(pack, "batch long, ids array<string>, sizes array<int>, blob binary").repartition(partitions_for(spark, size, BATCH_CHARS), "batch")

    asking = batched(docs, 0, own_chars)
    counted = asking if corpus is None else batched(corpus, 1, chars)

    def explode(weight: int):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            grams = Grams(unpacked_texts(frame), order)
            keys, counts = grams.keys, grams.counts.astype(np.uint32) * np.uint32(weight)
            part = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            names, first = np.unique(part, return_index=True)
            ends = [*first[1:], len(keys)][: len(first)]
            return pd.DataFrame({"range": names.astype(np.int64), "batch": frame["batch"].iloc[0], "keys": [squeezed(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in zip(first, ends, strict=True)], "counts": [squeezed(counts[a:b]) for a, b in zip(first, ends, strict=True)]})

        return run

    shape = "range long, batch long, keys binary, counts binary"
    asked = asking.groupBy("batch").applyInPandas(explode(int(corpus is None)), shape)
    asked = asked if corpus is None else asked.unionByName(counted.groupBy("batch").applyInPandas(explode(1), shape))

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(restored(x, np.uint64), dtype=np.uint64) for x in frame["keys"]]
        counts = np.concatenate([restored(x, np.uint32) for x in frame["counts"]])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        others = (np.bincount(inverse, counts)[inverse] - counts).astype(np.uint64)  # what a batch knows of itself need not travel
        parts = np.split(others, np.cumsum([len(k) for k in keys])[:-1])
        out = pd.DataFrame({"range": frame["range"], "batch": frame["batch"], "others": [squeezed(p) for p in parts]})
        return out[out["batch"] % 2 == 0]

    answers = asked.repartition(ranges, "range").groupBy("range").applyInPandas(count, "range long, batch long, others binary")

    def score(own: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame(columns=["id", "n_words", "n_full_context", "log_score", "mean_log_score"])
        grams = Grams(unpacked_texts(own), order)
        answer = answer.sort_values("range")
        totals = np.concatenate([np.zeros(0, np.uint64), *(restored(x, np.uint64) for x in answer["others"])])
        if len(totals) != len(grams.keys):
            raise RuntimeError("the rows to score came in another order when a task ran again: write them to a table first")
        totals = totals + grams.counts.astype(np.uint64) * np.uint64(counts_itself)
        log_score, full = grams.scores(totals, corpus_words, backoff, leave_out_own)
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(grams.lengths > 0, log_score / grams.lengths, None)
        return pd.DataFrame({"id": [i for ids in own["ids"] for i in ids], "n_words": grams.lengths, "n_full_context": full, "log_score": log_score, "mean_log_score": pd.Series(mean, dtype="Float64")})

    scored = asking.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(score, "id string, n_words long, n_full_context long, log_score double, mean_log_score double")
    return scored.select(F.col("id").cast(kind).alias(id_col), "n_words", "n_full_context", "log_score", "mean_log_score")
