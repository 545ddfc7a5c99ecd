"""Connected components of an edge table, by rounds of joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node, root` for each node of an edge; root is the smallest node of its component.

    Each round takes the smallest root among neighbours and then the root of that root, and writes the
    result to the shared folder. Edges may repeat and run either way; nulls and loops are left out.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")), "roots")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("seen"))
        nearer = labels.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "seen").alias("via"))
        jumped = nearer.join(labels.select(F.col("node").alias("via"), F.col("root").alias("further")), "via").select("node", F.least("via", "further").alias("root"), "old")
        after = written(jumped, "roots")
        labels = after.select("node", "root")
        if after.where("root <> old").isEmpty():
            return labels
