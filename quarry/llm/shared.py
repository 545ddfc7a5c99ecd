"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Where it is unset a temporary folder serves local sessions; on a cluster executors would not see it, so
    that it is an error there.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors, is computed once."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession, amount: float, each: float, least: int = 1) -> int:
    """How many tasks share `amount` of work when one takes `each`: grows with the data, without a top."""
    return max(least, int(-(-amount // each)))


def total_chars(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """Rows and characters of a table, in one pass."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("chars")).first()
    return int(row["n"]), int(row["chars"])


#: Bits in one row of Spark's bitmap functions.
BITMAP_ROW_BITS = 32_768


def marked_among(df: DataFrame, keys: DataFrame, column: str, mark: str, bitmap_rows: int = 2_048) -> DataFrame:
    """df with `mark`: whether its long `column` may occur among that of `keys`. True for all that do and a few more.

    Tells rows of a large table apart without shuffling it. The broadcast bitmap takes `bitmap_rows` x 4 KB at
    most, 8 MB by default, whatever the number of keys; where it fills up, more rows are marked.
    """

    def slot():
        return F.pmod(F.xxhash64(column), F.lit(bitmap_rows * BITMAP_ROW_BITS))

    bitmap = keys.groupBy(F.bitmap_bucket_number(slot()).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot())).alias("__bits"))
    place = F.bitmap_bit_position(slot()).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = df.withColumn("__bucket", F.bitmap_bucket_number(slot())).join(F.broadcast(bitmap), "__bucket", "left")
    return joined.withColumn(mark, F.coalesce(F.getbit(byte, place % 8) == 1, F.lit(False))).drop("__bucket", "__bits")


def maybe_among(df: DataFrame, keys: DataFrame, column: str, bitmap_rows: int = 2_048) -> DataFrame:
    """The rows that marked_among marks: narrows a large table before a join without shuffling it."""
    return marked_among(df, keys, column, "__among", bitmap_rows).where("__among").drop("__among")


#: Groups that are broadcast to their rows, the largest ones, a row each. Any other has a thousandth of the rows at most.
HOT_GROUPS = 1_000


def with_groups(rows: DataFrame, groups: DataFrame, key: list[str], size: str, spread: list[str], how: str = "inner") -> DataFrame:
    """`rows` with the columns of `groups`, a written table of one row a key, for groups of any size.

    The HOT_GROUPS largest groups by the column `size` are broadcast; their rows, dealt by the columns `spread`
    instead of the key, meet nothing in the join of the others, so that no task gets a large group.
    """
    values = [c for c in groups.columns if c not in key]
    packed = groups.select(*key, size, F.struct(*values).alias("__group"))
    hot = written(packed.orderBy(F.desc(size), *key).limit(HOT_GROUPS), "hot-groups")
    marked = rows.join(F.broadcast(hot.select(*key, F.col("__group").alias("__hot"))), key, "left")
    salted = marked.withColumn("__salt", F.when(F.col("__hot").isNotNull(), F.xxhash64(*spread).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long")))
    met = salted.join(packed.select(*key, "__group", F.lit(0).cast("long").alias("__salt")), [*key, "__salt"], "left").withColumn("__group", F.coalesce("__hot", "__group"))
    if how == "inner":
        met = met.where("__group IS NOT NULL")
    return met.select(*[F.col(c) for c in rows.columns], *[F.col(f"__group.{c}").alias(c) for c in values])


def rows_left(docs: DataFrame, decided: DataFrame, id_col: str, digest: Column) -> DataFrame:
    """`docs` without the rows that `decided` drops; of rows that repeat id and digest, one.

    `decided` (`id, digest, stays`) names what is dropped or comes more than once; nulls are equal ids. Rows
    whose id is surely not among them pass without a shuffle. All columns stay, whatever their names.
    """
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.xxhash64(F.col(id_col)).alias("__key"), F.col(id_col).alias("__id"), digest.alias("__digest"))
    decided = decided.select(F.xxhash64("id").alias("__key"), F.col("id").alias("__other"), F.col("digest").alias("__digest"), "stays")
    marked = marked_among(rows, decided, "__key", "__maybe")
    some = marked.where("__maybe").join(decided.drop("__key"), (F.col("__id").eqNullSafe(F.col("__other"))) & (marked["__digest"] == decided["__digest"]), "left").where("coalesce(stays, true)")
    once = some.select("__row", "__id", marked["__digest"]).dropDuplicates(["__id", "__digest"])
    return marked.where("NOT __maybe").select("__row.*").unionByName(once.select("__row.*"))
