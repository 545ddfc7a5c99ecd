"""Nearest vectors by an index of cells, exact by triangle inequalities.

Equal vectors are one class, which keeps its first ids. Cells lie around centres fitted on a bounded sample; every
class is dealt to the cell of its nearest centre, and cells are stored as blocks with the distances from the
centre that they really hold. A query first looks into a block of each of the nearest cells; the k-th distance there bounds the
search, and a cell is passed over if no vector in it can lie as near. What is left is compared in full, as
products of blocks, so that results do not depend on the sample, which only decides how much is passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.shared import kept_table

#: Vectors that centres are fitted on at most, vectors that a cell is meant to hold, vectors of a block, queries of a batch, cells that a probe looks into.
SAMPLE, CELL, BLOCK, BATCH, PROBED = 4_096, 512, 1_024, 1_024, 8
#: Decimals of a distance, what rounding may take from one before the exact one is computed, and from a square as a share of the lengths.
DECIMALS, SLACK, ROUNDING = 6, 1e-5, 1e-13


class Cells(NamedTuple):
    """Centres, and for each the nearest and farthest distance of its vectors and how many blocks hold them."""

    centres: np.ndarray
    near: np.ndarray
    far: np.ndarray
    blocks: np.ndarray


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0))


def centres_of(sample: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Centres of a sample by a few rounds of means."""
    centres = sample[: max(1, min(cells, len(sample)))].copy()
    for _ in range(rounds):
        own = distances(sample, centres).argmin(1)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def reached(queries: np.ndarray, within: np.ndarray, cells: Cells) -> np.ndarray:
    """queries x cells: whether a cell may hold a vector within the distance, by its shell and by its border with the query's own cell."""
    away = distances(queries, cells.centres)
    shell = (away - cells.far[None] <= within[:, None] + SLACK) & (cells.near[None] - away <= within[:, None] + SLACK)
    home = away.argmin(1)
    between = distances(cells.centres[home], cells.centres)
    border = (away**2 - away.min(1)[:, None] ** 2) / np.maximum(2 * between, 1e-12)
    return shell & ((border <= within[:, None] + SLACK) | (np.arange(len(cells.centres))[None] == home[:, None]))


def unpacked(raw: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), width)


def packed(rows: DataFrame, width: int) -> DataFrame:
    """`vec_id, vector` of rows with a whole vector of that width."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"vec_id": frame["vec_id"], "vector": [(np.asarray(v, np.float64) + 0.0).tobytes() for v in frame["embedding"]]})

    sound = rows.select("vec_id", "embedding").where((F.size("embedding") == width) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)))
    return sound.mapInPandas(run, "vec_id long, vector binary")


def classes_of(rows: DataFrame, keep: int) -> DataFrame:
    """`key, vector, ids`: equal vectors as one row, with the first `keep` ids."""
    w = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.where("vec_id IS NOT NULL").withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("key", F.md5("vector"))


def indexed(classes: DataFrame, width: int, sample: int = SAMPLE, cell: int = CELL, block: int = BLOCK) -> tuple[Cells, DataFrame]:
    """Cells, and the blocks (`cell, part, vectors, ids, starts`) of all classes."""
    count = classes.count()
    fitted = unpacked(classes.orderBy("key").limit(sample).select("vector").toPandas()["vector"], width)
    centres = centres_of(fitted, 1 + count // cell) if count else np.zeros((1, width))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            away = distances(unpacked(frame["vector"], width), centres)
            yield frame.assign(cell=away.argmin(1).astype(np.int32), away=away.min(1))

    dealt = kept_table(classes.mapInPandas(deal, "vector binary, ids array<long>, key string, cell int, away double"), "cells")
    k = len(centres)
    near, far, blocks = np.full(k, np.inf), np.full(k, -np.inf), np.zeros(k, np.int64)
    for r in dealt.groupBy("cell").agg(F.min("away").alias("near"), F.max("away").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # a row a cell
        near[r["cell"]], far[r["cell"]], blocks[r["cell"]] = r["near"], r["far"], -(-r["n"] // block)
    parts = F.element_at(F.array(*[F.lit(int(max(1, b))) for b in blocks]), F.col("cell") + 1)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        starts = np.cumsum([0, *map(len, frame["ids"])]).astype(np.int64)
        return pd.DataFrame([{"cell": int(frame["cell"].iloc[0]), "part": int(frame["part"].iloc[0]), "vectors": b"".join(frame["vector"]), "ids": np.concatenate(list(frame["ids"])).astype(np.int64).tobytes(), "starts": starts.tobytes()}])

    stored = dealt.withColumn("part", F.pmod(F.xxhash64("key"), parts).cast("int")).groupBy("cell", "part").applyInPandas(pack, "cell int, part int, vectors binary, ids binary, starts binary")
    return Cells(centres, near, far, blocks), kept_table(stored, "vector-blocks")


def visits(queries: DataFrame, cells: Cells, width: int, probe: bool) -> DataFrame:
    """Batches of queries (`key, vector, within`), a row for each block that they must look at; a probe looks into a block of each of the nearest cells."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), BATCH):
                part = frame.iloc[at : at + BATCH].reset_index(drop=True)
                vectors = unpacked(part["vector"], width)
                if probe:
                    alive = np.zeros((len(part), len(cells.centres)), bool)
                    held = np.where(cells.blocks > 0, 0.0, np.inf)
                    nearest = np.argsort(distances(vectors, cells.centres) + held[None], axis=1, kind="stable")[:, :PROBED]
                    alive[np.arange(len(part))[:, None], nearest] = True
                else:
                    alive = reached(vectors, part["within"].to_numpy(float), cells)
                out = []
                for cell in np.flatnonzero(alive.any(0) & (cells.blocks > 0)).tolist():
                    own = np.flatnonzero(alive[:, cell])
                    for block in range(1 if probe else int(cells.blocks[cell])):
                        out.append({"cell": cell, "part": block, "keys": part["key"].iloc[own].tolist(), "asking": vectors[own].tobytes(), "within": part["within"].iloc[own].tolist()})
                        if len(out) == 16:
                            yield pd.DataFrame(out)
                            out = []
                if out:
                    yield pd.DataFrame(out)

    return queries.select("key", "vector", "within").mapInPandas(run, "cell int, part int, keys array<string>, asking binary, within array<double>")


def nearest_of(rows: np.ndarray, ids: np.ndarray, starts: np.ndarray, asking: np.ndarray, within: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of a query, distance and id of the first k ids within its distance, for all queries at once.

    Squares from one product of matrices leave few candidates, whose distances are then computed exactly.
    """
    a, b = (asking * asking).sum(1), (rows * rows).sum(1)
    rough = a[:, None] + b[None] - 2 * (asking @ rows.T)
    most = within + SLACK
    if len(rows) > k:
        most = np.minimum(most, np.sqrt(np.maximum(np.partition(rough, k - 1, axis=1)[:, k - 1], 0)) + SLACK)
    query, row = np.nonzero(rough <= (most**2 + ROUNDING * (a + b.max()))[:, None])
    exact = np.round(np.sqrt(((rows[row] - asking[query]) ** 2).sum(1)), DECIMALS)
    kept = exact <= within[query]
    query, row, exact = query[kept], row[kept], exact[kept]
    copies = starts[row + 1] - starts[row]
    before = np.repeat(np.cumsum(copies) - copies, copies)
    found = ids[np.repeat(starts[row], copies) + np.arange(len(before)) - before]
    query, exact = np.repeat(query, copies), np.repeat(exact, copies)
    order = np.lexsort((found, exact, query))
    query, exact, found = query[order], exact[order], found[order]
    first = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[first], exact[first], found[first]


def compared(width: int, k: int) -> Callable:
    """The first k rows of a block for each query that looks at it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                rows, asking = np.frombuffer(r.vectors, np.float64).reshape(-1, width), np.frombuffer(r.asking, np.float64).reshape(-1, width)
                query, away, ids = nearest_of(rows, np.frombuffer(r.ids, np.int64), np.frombuffer(r.starts, np.int64), asking, np.asarray(r.within, float), k)
                if len(query):
                    yield pd.DataFrame({"key": np.asarray(r.keys, object)[query], "distance": away, "vec_id": ids})

    return run


def looked_up(queries: DataFrame, cells: Cells, blocks: DataFrame, width: int, k: int, probe: bool) -> DataFrame:
    met = visits(queries, cells, width, probe).join(blocks.hint("shuffle_hash"), ["cell", "part"])
    found = met.mapInPandas(compared(width, k), "key string, distance double, vec_id long")
    w = Window.partitionBy("key").orderBy("distance", "vec_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def pairs_compared(queries: DataFrame, cells: Cells, blocks: DataFrame, width: int) -> DataFrame:
    """`compared`: pairs of a query and a vector that a search of `queries` compares."""
    met = visits(queries, cells, width, False).join(blocks.select("cell", "part", (F.length("starts") / 8 - 1).cast("long").alias("rows")), ["cell", "part"])
    return met.agg(F.coalesce(F.sum(F.size("keys") * F.col("rows")), F.lit(0)).alias("compared"))


def batched(queries: DataFrame) -> DataFrame:
    """Queries dealt out so that a partition is about a batch: a block is then sent once to many queries."""
    return queries.repartition(max(1, -(-queries.count() // BATCH)), "key")


def bounded(queries: DataFrame, cells: Cells, blocks: DataFrame, width: int, k: int) -> DataFrame:
    """`queries` with `within` lowered to the k-th distance that a look into a few blocks finds."""
    probed = looked_up(queries, cells, blocks, width, k, True)
    kth = probed.where(F.col("place") == k).select("key", F.col("distance").alias("kth"))
    return kept_table(queries.join(kth, "key", "left").withColumn("within", F.least("within", F.coalesce("kth", "within"))).drop("kth"), "bounded")


def knn(queries: DataFrame, base: DataFrame, k: int = 5, farthest: float = 1.5, sample: int = SAMPLE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """`query_id, vec_id, distance, rank, confidence`: the k nearest other base vectors of each query within a
    distance, ties by smaller id; confidence falls with the distance.

    Distances are rounded to 6 decimals. Rows without id, vector or with a component that is null or no number
    take no part, nor do base vectors of another width than the first query's. Rows that repeat id and vector are
    rows of their own in the base; a query is asked once.
    """
    head = queries.where("embedding IS NOT NULL").select(F.size("embedding").alias("n")).first()
    width = head["n"] if head else 0
    cells, blocks = indexed(kept_table(classes_of(packed(base, width), k + 1), "classes"), width, sample, cell, block)
    rows = packed(queries, width).where("vec_id IS NOT NULL").select("vec_id", "vector", F.md5("vector").alias("key")).distinct()
    asked = kept_table(rows.groupBy("key", "vector").agg(F.count(F.lit(1)).alias("n")).select("key", "vector", F.lit(float(farthest)).alias("within")), "asked")
    found = looked_up(batched(bounded(batched(asked), cells, blocks, width, k + 1)), cells, blocks, width, k + 1, False)
    lists = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("distance", F.col("vec_id").alias("id")))).alias("near"))
    own = rows.select(F.col("vec_id").alias("query_id"), "key").join(lists, "key")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    each = own.select("query_id", F.posexplode(others).alias("rank", "hit"))
    return each.select("query_id", F.col("hit.id").alias("vec_id"), F.col("hit.distance").alias("distance"), (F.col("rank") + 1).alias("rank"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("hit.distance") / 2)).alias("confidence"))
