"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most distinct rows that are sent to all tasks.
FEW_ROWS = 20_000


def new_folder(spark: SparkSession, name: str) -> str:
    """A path not used before in the folder that spark.checkpoint.dir names.

    Where it is unset a temporary folder serves local sessions; elsewhere that is an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = context.getCheckpointDir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back: what follows neither repeats its work nor carries its plan."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once_each(rows: DataFrame, columns: list[str], work: Callable[[DataFrame], DataFrame], few_rows: int = FEW_ROWS) -> DataFrame:
    """`work` done once for each distinct combination of `columns`, and joined to all rows that have it, in place of `columns`.

    `work` takes `__key` and the columns and gives `__key` and what it found, any number of rows. Keys are hashes of
    256 bits. What was found is sent to all tasks where it has few rows, else met by a sort-merge join.
    """
    # never null, and known to be so: else the join would work each key out once more, to filter nulls
    key = F.coalesce(F.unhex(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)), F.lit(b""))
    found = kept_table(work(rows.select(*columns).distinct().withColumn("__key", key)), "once")
    few = found.limit(few_rows + 1).count() <= few_rows
    others = [c for c in rows.columns if c not in columns]
    return rows.select(*others, key.alias("__key")).join(F.broadcast(found) if few else found.hint("merge"), "__key").drop("__key")
