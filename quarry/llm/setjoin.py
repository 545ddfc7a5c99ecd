"""Joins texts whose sets of word n-grams are similar: MinHash bands find candidates, whole sets decide.

Texts with equal sets are one node. Nodes that share a band are joined to the smallest node there, which
takes a row each; the components of those edges are the candidate groups. All pairs within a group are
compared on their whole sets, by products of blocks of the group's incidence matrix: a large group becomes
many tasks of two blocks each. Tasks return link counts and a spanning forest, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.shared import maybe_among, partitions_for, with_groups, written
from quarry.llm.words import mixed, shingles

SIZE, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Texts hashed at once, nodes in a block, and columns of the incidence matrix multiplied at once.
BATCH, BLOCK, COLUMNS = 256, 512, 4_096


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """How many bands of `rows` hashes find a pair at the threshold with the target probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """A row of band hashes for each set (none of them empty)."""
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    rng = np.random.default_rng(11)
    out = np.zeros((len(sets), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(sets), band, np.uint64)
        for _ in range(rows):
            factor, shift = rng.integers(0, 1 << 63, 2, np.uint64)
            low = np.minimum.reduceat(flat * (factor * np.uint64(2) + np.uint64(1)) + shift, starts)
            key = mixed(key * np.uint64(31) + low)
        out[:, band] = key
    return out.view(np.int64)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set (sorted, distinct)."""
    flat = np.concatenate(left + right)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    _, place, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[place]
    place, owner = number[place[keep]], owner[keep]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for low in range(0, int(shared.sum()), COLUMNS):
        at = slice(*np.searchsorted(place, [low, low + COLUMNS]))
        cells = np.zeros((len(left) + len(right), min(COLUMNS, int(shared.sum()) - low)), np.float32)
        cells[owner[at], place[at] - low] = 1
        out += cells[: len(left)] @ cells[len(left) :].T
    return out


def forest(links: np.ndarray) -> np.ndarray:
    """Of a symmetric matrix of links: the first member of each one's component."""
    root = np.arange(len(links))
    while True:
        least = np.where(links, root[None, :], len(links)).min(1, initial=len(links))
        after = np.minimum(root, least)
        after = after[after]
        if np.array_equal(after, root):
            return root
        root = after


def compared(nodes: list[int], copies: list[int], sets: list[np.ndarray], second: list[bool], threshold: float) -> list[tuple]:
    """Rows (node, links, linked copies, root) of one task: one block with itself, or two blocks with each other."""
    one = [i for i, s in enumerate(second) if not s]
    two = [i for i, s in enumerate(second) if s] or one
    size = np.array([len(s) for s in sets], float)
    both = overlaps([sets[i] for i in one], [sets[i] for i in two])
    linked = both >= threshold * (size[one][:, None] + size[two][None, :] - both) - 1e-9
    every = np.zeros((len(nodes), len(nodes)), bool)
    every[np.ix_(one, two)] = linked
    every |= every.T
    np.fill_diagonal(every, False)
    many, root = every.sum(1), forest(every)
    weight = every @ np.array(copies, float)
    return [(nodes[i], int(many[i]), int(weight[i]), nodes[root[i]]) for i in np.flatnonzero(many)]


def similar_sets(items: DataFrame, keys: list[str], text_col: str, rows: int, size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL, least_words: int = 1) -> DataFrame:
    """Links and classes of texts whose n-gram sets have a Jaccard similarity of at least `threshold`.

    Returns a row for each item of `least_words` words or more: `keys, node, copies, links, linked_copies, root`. `node` is
    a 64-bit hash of the item's set, `copies` the items that share it, `links` the number of other sets that
    are similar and `linked_copies` the number of their items; `root` names the component of links. A pair
    at the threshold is missed with a probability of 1 - recall at most; every pair that is counted is exact.
    A text of fewer than `size` words has one n-gram, of all its words.
    """
    spark = items.sparkSession
    bands = bands_for(threshold, recall, rows)
    keyed = items.select(*keys, F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    kinds = ", ".join(f"`{c}` {keyed.schema[c].dataType.simpleString()}" for c in keys)

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), BATCH):
                part = frame.iloc[start : start + BATCH]
                sets, counts = shingles(part["text"].tolist(), size)
                full = np.flatnonzero(counts >= max(1, least_words))
                if len(full):
                    sets, part = [sets[i] for i in full], part.iloc[full]
                    nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                    yield part[[*keys, "text_hash"]].assign(node=nodes, bands=list(band_hashes(sets, bands, rows)))

    signed = written(keyed.mapInPandas(sign, f"{kinds}, text_hash long, node long, bands array<long>"), "signed")
    in_bands = signed.select("node", F.explode("bands").alias("band"))
    met = in_bands.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select("band", "first")
    met = written(met, "met")
    # items that share a node count once here: a task drops its own copies before any travels
    edges = maybe_among(in_bands, met, "band").distinct().join(met, "band").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    groups = components(edges).withColumnRenamed("root", "group")

    # one text for each node of a group: the scan keeps what may be needed, then a text of each node is taken
    nodes = maybe_among(signed.select("node", "text_hash"), groups, "node").groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.count(F.lit(1)).alias("copies"))
    blocks = groups.groupBy("group").agg(F.count(F.lit(1)).alias("members")).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    wanted = written(nodes.join(groups, "node").join(blocks, "group"), "wanted")
    # copies of a text are made one within each task; an inner join: a semi join would be pushed below the bitmap, and all texts would be shuffled
    texts = maybe_among(keyed.select("text_hash", "text"), wanted, "text_hash").groupBy("text_hash").agg(F.first("text").alias("text")).join(wanted.select("text_hash").distinct(), "text_hash")
    bundles = partitions_for(spark, wanted.count(), 2 * BLOCK)
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    single = F.col("blocks") == 1
    placed = wanted.join(texts, "text_hash").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("node", "copies", "group", "text", F.when(single, F.pmod(F.xxhash64("group"), F.lit(bundles))).otherwise(F.col("group")).alias("task"), F.when(single, -1).otherwise(F.least("own", "other")).alias("low"), F.when(single, -1).otherwise(F.greatest("own", "other")).alias("high"), (F.col("own") > F.col("other")).alias("second"))

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        for _, part in frame.groupby("group", sort=False):
            found += compared(part["node"].tolist(), part["copies"].tolist(), shingles(part["text"].tolist(), size)[0], part["second"].tolist(), threshold)
        return pd.DataFrame(found, columns=["node", "links", "linked_copies", "root"])

    linked = written(placed.groupBy("task", "low", "high").applyInPandas(verify, "node long, links long, linked_copies long, root long"), "linked")
    classes = components(linked, "node", "root")
    counted = linked.groupBy("node").agg(F.sum("links").alias("links"), F.sum("linked_copies").alias("linked_copies")).join(classes, "node")
    copies = signed.groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    known = written(copies.join(counted, "node", "left").where("copies > 1 OR links > 0"), "known-sets")
    placed = with_groups(signed.select(*keys, "node"), known, ["node"], "copies", keys, "left")
    return placed.select(*keys, "node", F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("linked_copies", F.lit(0)).alias("linked_copies"), F.coalesce("root", "node").alias("root"))
