"""Readers and writers of audit files beyond source text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.findings import parse_findings


def read_findings_json(spark: SparkSession, path: str) -> DataFrame:
    """Flat findings from a folder of JSON lines in the nested form; a line that is no JSON gives a row of defaults."""
    rows = spark.read.text(path).where(F.trim("value") != "").withColumn("seq", F.monotonically_increasing_id())
    return parse_findings(rows.withColumnRenamed("value", "raw"))


def read_manifest_deps(files: DataFrame) -> DataFrame:
    """Dependencies named in each project's manifest: `project, package, dep_name, git, rev, local`."""
    rows = files.where(F.col("path").endswith("Move.toml"))
    body = F.regexp_extract("content", r"(?s)\[dependencies\](.*?)(?:\n\[|\z)", 1)
    entries = F.regexp_extract_all(body, F.lit(r"(?m)^[ \t]*([A-Za-z0-9_-]+)[ \t]*=[ \t]*\{[^}]*\}"), 0)
    rows = rows.select("project", F.regexp_extract("content", r'(?m)^\s*name\s*=\s*"([^"]+)"', 1).alias("package"), F.explode(entries).alias("entry"))
    key = lambda k: F.nullif(F.regexp_extract("entry", rf'\b{k}\s*=\s*"([^"]*)"', 1), F.lit(""))
    return rows.select("project", "package", F.trim(F.split_part("entry", F.lit("="), F.lit(1))).alias("dep_name"), key("git").alias("git"), key("rev").alias("rev"), key("local").alias("local"))
