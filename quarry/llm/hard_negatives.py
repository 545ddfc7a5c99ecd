"""Hard-negative mining: for anchors and their positives, the best rows of other labels whose score lies in a window.

Rows of one vector and label form a class, which keeps its first few ids: no more can ever be asked for, and a
vector that a third of all rows share is one row from then on. A multiway hyperplane tree (`gnat.py`) is fitted on
a bounded sample of classes; every class is dealt to its leaf, and a leaf is stored as blocks of some BLOCK
vectors, with the distance ranges of all that it really holds. A search sends batches of anchors to the leaves
that the ranges can't rule out, where all vectors are compared exactly: results are exact whatever the sample.

Searches come in pairs: each anchor first visits a block of its own leaf, whose k-th best score narrows the
window for the search of all leaves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.gnat import Tree
from quarry.llm.shared import with_groups, written

#: Classes that the tree is fitted on at most; classes that a leaf is meant to hold; vectors of a block; anchors of a batch.
SAMPLE, LEAF, BLOCK, BATCH = 16_384, 1_024, 1_024, 256
#: Bytes of vectors that the tree is fitted on at most.
SAMPLE_BYTES = 32_000_000
#: Components beyond this take no part: scores of 64 bits could not hold their products.
LARGEST = 1 << 26
ANY = 1 << 62
FOUND = "key string, window int, score long, id long"


def in_order(*by: Column) -> list[Column]:
    """Higher scores first, ties by smaller id, null last."""
    return [*by, F.col("score").desc(), F.col("id").asc_nulls_last()]


def vectors_of(raw: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.int32).reshape(len(raw), width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: by floating point where all sums stay below 2^53, else by integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def packer(width: int) -> Callable:
    """Adds `vector` (little-endian 32-bit components, padded to `width`) in place of the list `vec`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = [np.pad(np.asarray(v, np.int32), (0, width - len(v))).tobytes() for v in frame["vec"]]
            yield frame.drop(columns="vec").assign(vector=vectors)

    return run


def first_keys(classes: DataFrame, count: int, n: int) -> DataFrame:
    """The `n` rows with the smallest `key`, a hex digest. Rows beyond some twice as many are passed over first, as
    each task would send its own first `n` to the driver."""
    digits = 12
    if count > 2 * n:
        classes = classes.where(F.substring("key", 1, digits) < f"{2 * n * 16**digits // count:0{digits}x}")
    return classes.orderBy("key").limit(n)


class Index:
    """Blocks of all classes, and the tree with the ranges of what they hold."""

    def __init__(self, classes: DataFrame, width: int, count: int, sample: int = SAMPLE, leaf: int = LEAF, block: int = BLOCK):
        spark = classes.sparkSession
        fitted = first_keys(classes, count, max(1, min(sample, SAMPLE_BYTES // (4 * width)))).select("vector").toPandas()["vector"]
        distinct = list(dict.fromkeys(map(bytes, fitted)))
        tree = Tree(vectors_of(pd.Series(distinct, dtype=object), width), count / leaf)
        self.width = width
        plain = spark.sparkContext.broadcast(tree)

        def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield frame.assign(leaf=plain.value.leaf_of(vectors_of(frame["vector"], width)).astype(np.int32))

        dealt = written(classes.mapInPandas(deal, f"{classes.schema.simpleString()[7:-1]}, leaf int"), "dealt")
        # a row a leaf: as many as the sample allows, whatever the data
        self.blocks_of = {r["leaf"]: -(-r["n"] // block) for r in dealt.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
        blocks_of = F.create_map(*[F.lit(x) for pair in self.blocks_of.items() for x in pair]) if self.blocks_of else F.create_map(F.lit(0), F.lit(1))
        salted = dealt.withColumn("salt", F.pmod(F.xxhash64("key"), F.element_at(blocks_of, F.col("leaf"))).cast("int"))

        def pack(frame: pd.DataFrame) -> pd.DataFrame:
            leaf, vectors = int(frame["leaf"].iloc[0]), vectors_of(frame["vector"], width)
            low, high = plain.value.ranges(vectors, leaf)
            labels = frame["label"].to_numpy(np.int64)
            ids, starts = np.concatenate([np.asarray(x, np.int64) for x in frame["ids"]]), np.cumsum([0, *map(len, frame["ids"])])
            return pd.DataFrame([{"leaf": leaf, "salt": int(frame["salt"].iloc[0]), "labels": labels.tobytes(), "vectors": vectors.tobytes(), "ids": ids.tobytes(), "starts": starts.astype(np.int64).tobytes(), "nulls": list(map(int, frame["nulls"])), "low": low.tolist(), "high": high.tolist()}])

        self.blocks = written(salted.groupBy("leaf", "salt").applyInPandas(pack, "leaf int, salt int, labels binary, vectors binary, ids binary, starts binary, nulls array<int>, low array<double>, high array<double>"), "blocks")

        def bounds(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([{"leaf": int(frame["leaf"].iloc[0]), "low": np.min(np.stack(frame["low"]), 0).tolist(), "high": np.max(np.stack(frame["high"]), 0).tolist()}])

        for r in self.blocks.select("leaf", "low", "high").groupBy("leaf").applyInPandas(bounds, "leaf int, low array<double>, high array<double>").collect():
            tree.widen(r["leaf"], np.array(r["low"]), np.array(r["high"]))
        self.tree = spark.sparkContext.broadcast(tree)

    def search(self, asked: DataFrame, same: bool, k: int, probe: bool = False, batch: int = BATCH) -> DataFrame:
        """`key, window, score, id`: the first `k` rows in each window of each anchor.

        `asked` holds `key, vector, label, least, most` (arrays, a window each, both ends within). Rows of the
        anchor's label are looked at if `same`, else those of all others. `probe`: only in a block of its own leaf.
        """
        # anchors are few on disk, but a row for each block that they meet is not: neither side is sent through the driver
        asked = asked.repartition(max(1, min(-(-asked.count() // batch), int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
        found = self.visits(asked, probe, batch).hint("merge").join(self.blocks.drop("low", "high"), ["leaf", "salt"])
        return first(found.mapInPandas(compared(self.width, same, k), FOUND), k)

    def visits(self, asked: DataFrame, probe: bool, batch: int = BATCH) -> DataFrame:
        """Batches of anchors, a row for each block that they must look at, with those of them that must."""
        tree, width, blocks_of = self.tree, self.width, self.blocks_of

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), batch):
                    part = frame.iloc[at : at + batch].reset_index(drop=True)
                    vectors, out = vectors_of(part["vector"], width), []
                    if probe:
                        home = tree.value.leaf_of(vectors)
                        spots = [(leaf, s % blocks_of[leaf]) if leaf in blocks_of else None for s, leaf in enumerate(home.tolist())]
                        groups = {spot: [i for i, x in enumerate(spots) if x == spot] for spot in dict.fromkeys(spots) if spot}
                    else:
                        least, most = (np.array([f(x, default=d) for x in part[c]], float) for f, c, d in ((min, "least", ANY), (max, "most", -ANY)))
                        reached = tree.value.reached(vectors, least, most)
                        groups = {(leaf, salt): np.flatnonzero(reached[:, leaf]).tolist() for leaf in np.flatnonzero(reached.any(0)).tolist() for salt in range(blocks_of.get(leaf, 0))}
                    for (leaf, salt), which in groups.items():
                        own = part.iloc[which]
                        out.append({"leaf": leaf, "salt": salt, "keys": own["key"].tolist(), "asking": vectors[which].tobytes(), "of": own["label"].tolist(), "least": own["least"].tolist(), "most": own["most"].tolist()})
                        if len(out) == 64:
                            yield pd.DataFrame(out)
                            out = []
                    if out:
                        yield pd.DataFrame(out)

        return asked.select("key", "vector", "label", "least", "most").mapInPandas(run, "leaf int, salt int, keys array<string>, asking binary, of array<long>, least array<array<long>>, most array<array<long>>")


def compared(width: int, same: bool, k: int) -> Callable:
    """Compares the anchors of each row with the block of that row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                rows = np.frombuffer(r.vectors, np.int32).reshape(-1, width)
                labels, ids, starts = (np.frombuffer(x, np.int64) for x in (r.labels, r.ids, r.starts))
                scores, out = products(np.frombuffer(r.asking, np.int32).reshape(-1, width), rows), []
                for key, label, least, most, own in zip(r.keys, r.of, r.least, r.most, scores, strict=True):
                    allowed = (labels == label) if same else (labels != label)
                    for w, (low, high) in enumerate(zip(least, most, strict=True)):
                        fits = np.flatnonzero(allowed & (own >= low) & (own <= high))
                        if len(fits) > k:
                            fits = fits[own[fits] >= np.partition(own[fits], -k)[-k]]
                        some = [(-int(own[c]), x is None, x or 0, x) for c in fits.tolist() for x in [*ids[starts[c] : starts[c + 1]].tolist(), *[None] * r.nulls[c]]]
                        out += [(key, w, -s[0], s[3]) for s in sorted(some, key=lambda s: s[:3])[:k]]
                if out:
                    yield pd.DataFrame(out, columns=["key", "window", "score", "id"]).astype({"id": "Int64"})

    return run


def first(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("key", "window").orderBy(*in_order())
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def narrowed(asked: DataFrame, probed: DataFrame, k: int) -> DataFrame:
    """`asked` with each window's lower end raised to the k-th score that the probe found in it."""
    kth = probed.where(F.col("place") == k).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
    return asked.join(kth, "key", "left").withColumn("least", F.transform("least", lambda low, w: F.greatest(low, F.coalesce(F.col("kth")[w], low)))).drop("kth")


def searched(index: Index, asked: DataFrame, same: bool, k: int, name: str) -> DataFrame:
    """`key, window, found` (the first k of each window, in order), after a probe that narrows the windows."""
    probed = written(index.search(asked, same, k, probe=True), f"{name}-probed")
    whole = index.search(written(narrowed(asked, probed, k), f"{name}-asked"), same, k)
    return whole.groupBy("key", "window").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "score", "id"))), lambda x: F.struct(x["score"], x["id"])).alias("found"))


def classes_of(rows: DataFrame, keep: int) -> DataFrame:
    """`key, label, vec, ids, nulls`: a row a vector and label with the first `keep` ids of its rows; of those, null ids
    are counted apart."""
    w = Window.partitionBy("vec", "label").orderBy(F.col("id").asc_nulls_last())
    few = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= keep)
    ids = few.groupBy("vec", "label").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count_if(F.col("id").isNull()).cast("int").alias("nulls"))
    return ids.withColumn("key", key_of())


def key_of() -> Column:
    return F.md5(F.concat_ws(",", F.col("label").cast("string"), F.transform("vec", lambda x: x.cast("string"))).cast("binary"))


def hard_negatives(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, least_percent: int = 80, sample: int = SAMPLE, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """Negatives of anchors: `anchor_id, positive_id, rank, negative_id, positive_score, negative_score`.

    `rows` holds `id, label, vec` (array of integers); rows for which `is_anchor` is true are anchors. Scores
    are inner products. An anchor's positives are its first `n_positives` other rows of its label, by score, then
    smaller id, null last; for each, the first `n_negatives` rows of other labels whose score lies between
    `least_percent` percent of the positive's and the positive's itself, both ends within.

    Rows with a null label, a null vector or a null component take no part, nor do those with a component
    beyond LARGEST. Shorter vectors count as padded with zeros. Rows that repeat an id, or all they hold, are rows
    of their own; a null id may be an anchor's, a positive's or a negative's. Anchors without positives or
    negatives give no rows, an empty table none. Other columns of `rows` are not read.
    """
    valid = F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & x.between(-LARGEST, LARGEST))
    rows = rows.select("id", F.col("label").cast("long").alias("label"), "vec", is_anchor.alias("anchor"))
    rows = rows.where(F.coalesce(valid, F.lit(False))).withColumn("vec", F.col("vec").cast("array<bigint>"))
    classes = written(classes_of(rows, max(n_positives + 1, n_negatives)), "classes")
    count, width = classes.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    width = max(1, width or 1)
    packed = classes.mapInPandas(packer(width), "label long, ids array<long>, nulls int, key string, vector binary").select("key", "label", "vector", "ids", "nulls")
    index = Index(written(packed, "vectors"), width, count, sample, leaf, block)

    # anchors, a row a class
    norm = F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x * x)
    anchors = rows.where("anchor").select("id", "label", "vec", key_of().alias("key"), norm.alias("norm"))
    asking = anchors.groupBy("key", "label", "vec").agg(F.count(F.lit(1)).alias("size"))
    asking = written(asking.mapInPandas(packer(width), "key string, label long, size long, vector binary").select("key", "label", "size", "vector"), "asking")
    open_window = asking.withColumns({"least": F.array(F.lit(-ANY)), "most": F.array(F.lit(ANY))})
    positives = written(searched(index, open_window, True, n_positives + 1, "positives").select("key", F.col("found").alias("positives")), "positives")

    # a window for each different score of a positive
    windows = asking.join(positives, "key").withColumn("most", F.array_distinct(F.transform("positives", lambda x: x["score"])))
    lower_end = f"transform(most, p -> CASE WHEN p > 0 THEN ({least_percent} * p + 99) div 100 ELSE ({least_percent} * p) div 100 END)"
    windows = written(windows.withColumn("least", F.expr(lower_end)), "windows")
    negatives = searched(index, windows, False, n_negatives, "negatives").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("window", "found"))).alias("negatives"))
    groups = written(windows.join(negatives, "key").select("key", "size", "most", "positives", "negatives"), "results")

    # back to the rows: each without itself
    own = with_groups(anchors.select("id", "key", "norm"), groups, ["key"], "size", ["id"])
    at = F.array_position("positives", F.struct(F.col("norm").alias("score"), F.col("id")))
    others = F.when(at > 0, F.concat(F.slice("positives", F.lit(1), at.cast("int") - 1), F.slice("positives", at.cast("int") + 1, F.size("positives")))).otherwise(F.col("positives"))
    each = own.select("id", "most", "negatives", F.explode(F.slice(others, 1, n_positives)).alias("positive"))
    window = F.array_position("most", F.col("positive.score")).cast("int") - 1
    ranked = each.select("id", "positive", F.posexplode(F.try_element_at("negatives", window)).alias("rank", "negative"))
    return ranked.select(
        F.col("id").alias("anchor_id"), F.col("positive.id").alias("positive_id"), (F.col("rank") + 1).alias("rank"), F.col("negative.id").alias("negative_id"),
        F.col("positive.score").alias("positive_score"), F.col("negative.score").alias("negative_score"),
    )


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as double; null where the vector or a component is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(finite, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))
