"""N-gram Jaccard join of documents with themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.setjoin import RECALL, SIZE, THRESHOLD, similar_sets
from quarry.llm.shared import rows_left, with_groups, written

#: Hashes in a band; with the threshold and the target recall this gives 18 bands.
ROWS = 5


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """`id, class_id, class_size, n_links, n_text_links` of each row.

    Two documents are linked when the Jaccard similarity of their sets of word n-grams (lower-cased, split at
    blanks) is at least `threshold`. A class is a component of links, `class_id` its smallest id;
    `n_links` counts the other documents linked to this one, copies included, `n_text_links` the other sets of
    n-grams. Texts without words (null, empty, blank) have no n-grams: each such row is a class of its own.
    A null id stays null and counts in no class_id but where all ids of the class are null. Rows that repeat
    are copies of each other.
    """
    found = written(similar_sets(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), ["id"], "text", ROWS, size, threshold, recall), "similar")
    classes = written(found.groupBy("root").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size")).where("class_size > 1"), "classes")
    rows = with_groups(found, classes, ["root"], "class_size", ["id", "node"], "left").select(
        F.col("id").alias(id_col), F.when(F.col("class_size").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"),
        (F.col("copies") - 1 + F.col("linked_copies")).alias("n_links"), F.col("links").alias("n_text_links"),
    )
    blank = docs.where(~F.coalesce(F.col(text_col), F.lit("")).rlike(r"(?U)[^\s\x1C-\x1F]")).select(F.col(id_col), F.col(id_col).alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_text_links"))
    return rows.unionByName(blank)


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of `docs` that are the first of their class, with their columns; rows without words stay.

    The first has the smallest id, null after all others, and of texts with that id the one with the smallest
    hash: texts that share an id are told apart. Of rows that repeat id and text one stays.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    items = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    found = written(similar_sets(items, ["id", "digest"], "text", ROWS, size, threshold, recall).where("copies > 1 OR links > 0").groupBy("root", "id", "digest").agg(F.count(F.lit(1)).alias("n")), "similar")
    place = F.struct(F.col("id").isNull().alias("nameless"), "id", "digest")
    firsts = written(found.groupBy("root").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("members")), "firsts")
    decided = with_groups(found, firsts, ["root"], "members", ["id", "digest"]).select("id", "digest", "n", (place == F.col("first")).alias("stays"))
    return rows_left(docs, written(decided.where("n > 1 OR NOT stays").drop("n"), "decided"), id_col, F.xxhash64(text))
