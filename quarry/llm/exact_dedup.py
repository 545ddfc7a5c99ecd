"""Exact deduplication by progressive refinement, in DataFrame operations only.

Texts are grouped by byte length; those whose length another text has are grouped by the hash of a prefix too;
those that still have company, by the hash of the whole text. What travels between tasks are lengths and
hashes, never texts. Which lengths and prefixes have company is told to the next scan by a bitmap of fixed
size, so that it needs neither a shuffle of texts nor a broadcast that grows with the data; a false positive
there costs one needless hash and changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import marked_among, rows_left, with_groups, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
def normalised(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty. An ASCII text takes the JVM's faster path."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 256,
    digest_all: bool = False,
) -> DataFrame:
    """Which row of each group of equal texts stays.

    Returns `id, keep_id, group_size, kept, text_sha256`, a row for each input row. Texts are equal when
    identical after lower-casing A-Z; null equals the empty text. The row with the largest id stays; a null
    id counts as smallest. Rows that repeat both id and text are one document and are marked alike.
    text_sha256 is null for texts that an earlier step proved unique, unless `digest_all` asks for all.
    An empty table gives an empty result; other columns of `docs` are not read.

    The broadcast bitmaps take 2 MB and 8 MB at most, at any size of the data.
    """
    digest = F.sha2(normalised(F.col("__text")), 256)
    sized = docs.select(F.col(id_col).alias("__id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("__len"), F.col(text_col).alias("__text"))

    # 1. length: rows without company are done
    shared_length = sized.groupBy("__len").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__len")
    shared_length = written(shared_length, "shared-lengths")
    marked = marked_among(sized, shared_length, "__len", "__long", 512)

    # 2. hash of a prefix, of the others
    prefix = F.xxhash64("__len", normalised(F.substring("__text", 1, prefix_chars)))
    marked = marked.withColumn("__prefix", F.when(F.col("__long"), prefix))
    shared_prefix = marked.where("__long").groupBy("__prefix").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__prefix")
    marked = marked_among(marked, written(shared_prefix, "shared-prefixes"), "__prefix", "__collides")

    # 3. hash of the whole text, of what is left
    collides = F.col("__long") & F.col("__collides")
    hashed = marked.select("__id", "__len", collides.alias("__collides"), (digest if digest_all else F.when(collides, digest)).alias("__sha"))
    groups = hashed.where("__collides").groupBy("__len", "__sha").agg(F.max("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return with_groups(hashed, written(groups, "groups"), ["__len", "__sha"], "group_size", ["__id"], "left").select(
        F.col("__id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("__id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("__id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay after exact_dedup, with all their columns; one of rows that repeat id and text."""
    found = exact_dedup(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text").where("group_size > 1")
    decided = found.groupBy("id", F.col("text_sha256").alias("digest")).agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n")).where("n > 1 OR NOT stays")
    return rows_left(docs, written(decided, "decided"), id_col, F.sha2(normalised(F.col(text_col)), 256))
