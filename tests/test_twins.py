"""Twins and streams on tables that come otherwise: rows in another order, folders of several files."""

import duckdb

from quarry.plans import stream_queries, usage_queries
from quarry.streaming import streams


def test_rollup_sums_decimals(spark):
    """Ten times 0.1 is 1; a sum of doubles lies below, and its floor would be 0."""
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT 5 * n AS event_id, 1 AS user_id, 0.1::DOUBLE AS value FROM range(10) r(n)")
    assert con.execute(usage_queries.ORACLES["a20_audit_token_rollup"]).fetchall() == [("a1", 1, 10, 11, 1)]
    rows = spark.range(10).selectExpr("5 * id AS event_id", "1 AS user_id", "CAST(0.1 AS DOUBLE) AS value").coalesce(1)
    got = spark.sql(usage_queries.AGENTS, events=rows).first()
    assert (got.prompt, got.completion, got.total) == (1, 10, 11)


def test_stream_reads_each_file_once(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(f"{tmp_path}/folder.parquet")
    spark.range(7).coalesce(1).write.parquet(f"{tmp_path}/x")
    next((tmp_path / "x").glob("part-*.parquet")).rename(tmp_path / "file.parquet")
    for name, n in (("folder", 10), ("file", 7)):
        assert streams.drained(stream_queries.stream(spark, str(tmp_path), name), name).count() == n
