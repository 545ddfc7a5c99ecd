"""A Merkle manifest of a dataset: content-addressed records that lead from one root to every row, and proofs.

Rows are leaves. Those of a group (a language, a shard) ascend by id; every FAN_OUT consecutive nodes become the
hash of their digests, level by level, up to the group's subroot; subroots, ordered by group, likewise become
the root. A record maps a digest to the digests of its children, so that equal subtrees share one.

A proof is found by descent. Requests that share a path travel as one row a node, so that level l handles a
request for each node there and not for each leaf: the record of the node's digest is joined, the rank's digit at
that level chooses a child, and the unselected children form a segment of the path. Segments are
collected from the root down and reversed at the end. All of it is Spark expressions, and no level is
collected: what meets in one task is a run of FAN_OUT digests.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.shared import new_path, written

#: Children of a node.
FAN_OUT = 8


def digest_of(parts: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the parts: `-` for null, else the count of UTF-8 bytes, a colon and the value."""
    said = []
    for part in parts:
        text = part.cast("string")
        said.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*said), 256)


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """`leaves` with `rank` in its `group` from 0, by `order` (nulls first), and the group's `size`.

    Groups of any size: rows are dealt by ranges of group and order, numbered where they lie, and each range
    learns how many rows of its group lie in earlier ones. Rows alike in group and order are told apart by nothing
    that matters here, and are dealt on by a hash of their place in the input, so that they fill no single range.
    """
    dealt = leaves.withColumn("__spread", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange("group", *order, "__spread")
    placed = dealt.sortWithinPartitions("group", *order, "__spread").drop("__spread").withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id()})
    placed = written(placed, "placed")
    spans = placed.groupBy("__part", "group").agg(F.count(F.lit(1)).alias("n"), F.min("__place").alias("first"))
    of_group = Window.partitionBy("group")
    before = F.coalesce(F.sum("n").over(of_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = spans.select(F.col("__part").alias("__p"), F.col("group").alias("__g"), (before - F.col("first")).alias("__shift"), F.sum("n").over(of_group).alias("size"))
    met = placed.join(shifts, (F.col("__part") == F.col("__p")) & F.col("group").eqNullSafe(F.col("__g")))
    return met.withColumn("rank", F.col("__place") + F.col("__shift")).drop("__part", "__place", "__p", "__g", "__shift")


def parent_rank(up: int = 1) -> Column:
    """The rank, `up` levels higher, of the node over `rank`."""
    return F.expr(f"rank div {FAN_OUT**up}")


def grown(nodes: DataFrame, path: str) -> tuple[DataFrame, int]:
    """Builds the trees over `nodes` (`group, rank, digest, size`), a tree a group.

    Writes the records of level l (`digest, children`, one a digest) to `path`/level=l and returns the tops
    (`group, digest, height`) and the height of the tallest tree.
    """
    spark, level = nodes.sparkSession, 0
    tops = nodes.where("size = 1").select("group", "digest", F.lit(0).alias("height"))
    tallest = nodes.agg(F.max("size")).first()[0] or 0
    below = nodes
    while tallest > 1:
        level, tallest = level + 1, -(-tallest // FAN_OUT)
        child = F.struct(F.pmod("rank", F.lit(FAN_OUT)).alias("digit"), "digest")
        runs = below.where("size > 1").groupBy("group", parent_rank().alias("rank")).agg(F.sort_array(F.collect_list(child)).getField("digest").alias("children"), F.ceil(F.first("size") / FAN_OUT).alias("size"))
        below = written(runs.withColumn("digest", F.sha2(F.concat_ws("", "children"), 256)), f"nodes-{level}")
        below.groupBy("digest").agg(F.first("children").alias("children")).write.option("compression", "zstd").parquet(f"{path}/level={level}")
        below = below.drop("children")
        tops = tops.unionByName(below.where("size = 1").select("group", "digest", F.lit(level).alias("height")))
    return tops, level


class Manifest(NamedTuple):
    """Where the records lie, the root (null: no rows) and what a descent starts from."""

    path: str
    root: str | None
    upper_height: int
    lower_height: int
    subroots: DataFrame  # group, rank, digest, height


def manifest(leaves: DataFrame, path: str | None = None) -> Manifest:
    """Builds and stores the manifest of `leaves` (`group, rank, digest, size`, as `ranked` numbers them).

    Records go to `path`, else to a new folder of the shared one. Null is a group of its own, the first. A group
    of one leaf has that leaf as subroot; a single subroot is the root; an empty table has no root.
    """
    path = path or new_path(leaves.sparkSession, "manifest")
    tops, lower = grown(leaves, f"{path}/lower")
    ordered = ranked(tops.select(F.lit("").alias("group"), F.col("group").alias("named"), "digest", "height"), ["named"])
    ordered = written(ordered, "subroots")
    roots, upper = grown(ordered, f"{path}/upper")
    root = roots.select("digest").first()
    return Manifest(path, root and root[0], upper, lower, ordered.select(F.col("named").alias("group"), "rank", "digest", "height"))


#: A segment of a path: the unselected children on either side of the selected one.
SEGMENT = "array<struct<before:string,after:string>>"


def step_down(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Each request (`rank, digest, segments`, and more) replaced by those for its node's children."""
    met = requests.join(records, "digest")
    children = met.select(*[c for c in requests.columns if c != "digest"], "children", F.posexplode("children").alias("digit", "digest"))
    before, after = F.concat_ws("", F.slice("children", F.lit(1), F.col("digit"))), F.concat_ws("", F.slice("children", F.col("digit") + 2, F.lit(FAN_OUT)))
    return children.withColumns({"segments": F.array_append("segments", F.struct(before.alias("before"), after.alias("after"))), "rank": F.col("rank") * FAN_OUT + F.col("digit")}).select(*requests.columns)


def stored(spark: SparkSession, path: str, level: int) -> DataFrame:
    return spark.read.schema("digest string, children array<string>").parquet(f"{path}/level={level}")


def paths(found: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """`group, rank, segments, height` for the parents of all leaves, or of those `wanted` (`group, rank`) asks for.

    `rank` numbers the nodes of level 1; a group of a single leaf has that leaf (height 0) in its place. Segments
    run from the root down, without the one of the leaf's own run.
    """
    spark = found.subroots.sparkSession
    start = spark.createDataFrame([(0, found.root)], "rank long, digest string").withColumn("segments", F.lit(None).cast(SEGMENT)).withColumn("segments", F.coalesce("segments", F.array().cast(SEGMENT)))
    requests = start
    for level in range(found.upper_height, 0, -1):
        requests = step_down(requests, stored(spark, f"{found.path}/upper", level))
    named = found.subroots.withColumnRenamed("rank", "at").drop("digest")
    starts = written(requests.join(named, F.col("rank") == F.col("at")).select("group", F.lit(0).cast("long").alias("rank"), "digest", "segments", "height"), "subroot-paths")
    done, going = starts.where("height <= 1"), None
    for level in range(found.lower_height, 1, -1):
        fresh = starts.where(F.col("height") == level)
        going = step_down(fresh if going is None else going.unionByName(fresh), stored(spark, f"{found.path}/lower", level))
        if wanted is not None:
            prefixes = wanted.select(F.col("group").alias("__g"), parent_rank(level - 1).alias("__r")).distinct()
            going = going.join(prefixes, F.col("group").eqNullSafe(F.col("__g")) & (F.col("rank") == F.col("__r")), "left_semi")
        going = written(going, f"paths-{level}")
    return (done if going is None else done.unionByName(going)).withColumnRenamed("digest", "parent")


def proofs(found: Manifest, leaves: DataFrame, whole: bool = True) -> DataFrame:
    """`leaves` (`group, rank, digest`, and more), all of the manifest's or a part of them, with `subroot`, `root` and
    `segments`, each leaf's path from its own run up to the root.

    Set `whole` to false where `leaves` is a part, so that the descent enters only nodes that lead to it.
    """
    if found.root is None:
        return leaves.withColumns({"subroot": F.lit(None).cast("string"), "root": F.lit(None).cast("string"), "segments": F.lit(None).cast(SEGMENT)})
    spark, more = leaves.sparkSession, [c for c in leaves.columns if c != "group"]
    down = paths(found, None if whole else leaves)
    if found.lower_height:
        down = down.join(stored(spark, f"{found.path}/lower", 1), F.col("parent") == F.col("digest"), "left").select("group", "rank", "segments", "children")
    else:
        down = down.select("group", "rank", "segments", F.lit(None).cast("array<string>").alias("children"))
    subroots = found.subroots.select(F.col("group").alias("__sg"), F.col("digest").alias("subroot"))
    down = down.join(subroots, F.col("group").eqNullSafe(F.col("__sg"))).select(F.col("group").alias("__g"), F.col("rank").alias("__r"), "segments", "children", "subroot")
    runs = leaves.groupBy("group", parent_rank().alias("__run")).agg(F.collect_list(F.struct(*more)).alias("__members"))
    met = runs.join(down, F.col("group").eqNullSafe(F.col("__g")) & (F.col("__run") == F.col("__r")))
    each = met.select("group", "segments", "children", "subroot", F.explode("__members").alias("__leaf"))
    digit = F.pmod(F.col("__leaf.rank"), F.lit(FAN_OUT)).cast("int")
    own = F.struct(F.concat_ws("", F.slice("children", F.lit(1), digit)).alias("before"), F.concat_ws("", F.slice("children", digit + 2, F.lit(FAN_OUT))).alias("after"))
    whole_path = F.reverse(F.when(F.col("children").isNull(), F.col("segments")).otherwise(F.array_append("segments", own)))
    return each.select("group", "__leaf.*", "subroot", F.lit(found.root).alias("root"), whole_path.alias("segments"))


def folded(leaf: Column, segments: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(segments, leaf, lambda digest, s: F.sha2(F.concat(s["before"], digest, s["after"]), 256))


def siblings(segments: Column) -> Column:
    """All siblings of a path in one text, level by level, left to right."""
    return F.concat_ws("", F.transform(segments, lambda s: F.concat(s["before"], s["after"])))


def tampered_proofs(docs: DataFrame) -> DataFrame:
    """Builds the manifest of `documents` by language, proves every row, and folds what tampering would have left.

    Returns `doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`, a row for each input row. Where 3
    divides the CRC-32 of the decimal id, the text's A-Z are lower-cased before folding; a null id is never tampered.
    Nulls in any column have a digest of their own; a null id comes first in its language; rows that repeat an id
    are ordered by leaf, and fully repeated rows take a place each. Other columns of `docs` are not read.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampers = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    digest = digest_of([*fields, text])
    leaves = docs.select(F.col("lang").cast("string").alias("group"), "doc_id", digest.alias("digest"), F.when(tampers, digest_of([*fields, lowered])).alias("altered"))
    leaves = written(ranked(leaves, ["doc_id", "digest"]), "leaves")
    found = manifest(leaves.select("group", "rank", "digest", "size"))
    proved = proofs(found, leaves.drop("size"))
    return proved.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root",
        F.sha2(siblings(F.col("segments")), 256).alias("proof_sha256"),
        folded(F.coalesce("altered", "digest"), F.col("segments")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
