"""Streams over several batches, restarts and repeated batches, against their batch forms."""

import datetime as dt
import os
import random
import tempfile

from pyspark.sql import functions as F

from quarry.operators import findings, scan, usage
from quarry.streaming import streams

START = dt.datetime(2024, 1, 1)
EVENTS = "user_id long, seq long, created_at timestamp, delta long"


def folder(name):
    return tempfile.mkdtemp(prefix=f"spark-{name}-")


def test_balances_of_shuffled_files(spark):
    rng, path = random.Random(1), folder("events")
    rows = [(rng.choice([1, 2, 3, None]), i, START + dt.timedelta(minutes=rng.randrange(5000)), rng.choice([None, 50, -20, -30, -7])) for i in range(600)]
    rng.shuffle(rows)
    for n in range(5):
        spark.createDataFrame(rows[n::5], EVENTS).coalesce(1).write.mode("append").parquet(path)
    events = spark.createDataFrame(rows, EVENTS)
    streams.closed(events, path)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)
    got = streams.drained(streams.balance_stream(stream, "10 days"), "balances").select("user_id", "seq", "balance", "rejected")
    want = usage.running_balance(events).select("user_id", "seq", "balance", "rejected")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_balances_of_late_events(spark):
    """Little lateness, many batches: events come a step late, one comes too late and is dropped."""
    path = folder("late")
    rows = [(1, i, START + dt.timedelta(hours=i if i % 2 else i - 3), [100, -60, -70, 30][i % 4]) for i in range(60)]
    for n in range(6):
        spark.createDataFrame(rows[n * 10 : n * 10 + 10], EVENTS).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([(1, 99, START, 1_000_000)], EVENTS).coalesce(1).write.mode("append").parquet(path)
    events = spark.createDataFrame(rows, EVENTS)
    streams.closed(events, path)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)
    got = streams.drained(streams.balance_stream(stream, "4 hours"), "balances").select("seq", "balance", "rejected")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, usage.running_balance(events).select("seq", "balance", "rejected").collect()))


def test_balances_are_kept_by_buckets_of_users(spark):
    """Many users meet few states; those of a bucket, the missing user and user 0 included, stay apart over batches."""
    rng, path = random.Random(7), folder("buckets")
    rows = [(rng.choice([None, *range(40)]), i, START + dt.timedelta(minutes=i // 2), rng.choice([None, 50, -20, -30])) for i in range(900)]
    for n in range(3):
        spark.createDataFrame(rows[n * 300 : n * 300 + 300], EVENTS).coalesce(1).write.mode("append").parquet(path)
    events = spark.createDataFrame(rows, EVENTS)
    streams.closed(events, path)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)
    got = streams.drained(streams.balance_stream(stream, "10 days", buckets=3), "balances").select("user_id", "seq", "delta", "balance", "rejected")
    want = usage.running_balance(events.fillna(0, ["delta"])).select("user_id", "seq", "delta", "balance", "rejected")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


ACTIONS = "finding_id string, action_type string, new_severity string, reason string, created_at timestamp, seq long"


def test_reviews_over_a_restart(spark):
    rng, path, state = random.Random(2), folder("actions"), folder("reviews")
    kinds = ["confirm", "reject", "upgrade", "downgrade", "add_note", "other"]
    rows = [(f"f{rng.randrange(5)}", rng.choice(kinds), rng.choice(["low", "high", None]), rng.choice([f"n{i}", None]), START + dt.timedelta(minutes=rng.randrange(50)), i) for i in range(200)]
    for part in (rows[:80], rows[80:81], rows[81:]):
        spark.createDataFrame(part, ACTIONS).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(ACTIONS).parquet(path)
        states = streams.kept_by_version(streams.review_stream(stream), state, ["finding_id"])
    known = spark.createDataFrame([(f"f{i}", "open", "medium") for i in range(7)], "finding_id string, status string, severity string")
    want = findings.apply_actions(known, spark.createDataFrame(rows, ACTIONS))
    columns = ["finding_id", "status", "severity", "notes"]
    assert sorted(map(repr, streams.reviewed(known, states).select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))


UPDATES = "audit_id string, seq long, phase int, percent double, message string"


def test_progress_keeps_the_last_messages(spark):
    path, state = folder("updates"), folder("progress")
    rows = [("a", i, -1 if i % 5 else i % 7, i / 10, f"m{i}") for i in range(900)] + [("b", 0, -1, 1.0, "only"), ("c", 1, 2, 3.0, "x"), ("d", 4, 9, 5.0, "odd"), ("d", None, None, None, None)]
    audits = spark.createDataFrame([("a", "running"), ("b", "running"), ("c", "failed"), ("d", "running"), (None, "running"), ("a", "running")], "id string, status string")
    for part in (rows[:620], rows[620:]):
        spark.createDataFrame(part, UPDATES).coalesce(1).write.mode("append").parquet(path)
        states = streams.kept_by_version(streams.progress_stream(spark.readStream.schema(UPDATES).parquet(path), audits), state, ["audit_id"])
    got = {r.audit_id: r for r in states.collect()}
    assert set(got) == {"a", "b", "d"}
    assert got["a"].messages == [f"m{i}" for i in range(400, 900)] and (got["a"].current_phase, got["a"].progress_percent) == (895 % 7, 89.5)
    assert (got["b"].current_phase, got["b"].phase_name, got["b"].progress_percent) == (0, "运行中", 0.0)
    assert (got["d"].current_phase, got["d"].phase_name, got["d"].messages) == (9, "odd", [None, "odd"])


PATTERNS = [scan.Pattern("P", "t", "high", (), ("price", "fee"), "fe+"), scan.Pattern("Q", "t", "low", (), ("price",), "pr[a-z]+"), scan.Pattern("N", "n", "low", (), ("pri", "fee"))]


def snapshot(spark, path):
    return {n: sorted(map(repr, streams.scanned(spark, path, n).collect())) for n in streams.SCAN_TABLES}


def test_repeated_scan_changes_nothing(spark):
    source, path = folder("texts"), folder("scan")
    first = [(1, "price\nfee fee\nfeee"), (2, "nothing"), (3, "price\nfee fee\nfeee"), (4, None)]
    second = [(5, "price\nfee fee\nfeee"), (6, "the price\n\nof fee")]
    for part in (first, second):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        streams.incremental_scan(spark.readStream.schema("doc_id long, text string").parquet(source), PATTERNS, path)
    kept = snapshot(spark, path)
    texts = streams.scanned(spark, path, "texts")
    assert texts.count() == 4 and texts.where("doc_id = 5").count() == 0
    # batch forms over the texts that were new
    found = scan.match_patterns(texts, PATTERNS)
    titles = scan.dedupe_by_title(found.withColumn("source_rank", F.lit(0)))
    assert kept["matches"] == sorted(map(repr, found.collect())) and kept["scores"] == sorted(map(repr, scan.scan_risk_score(titles).collect())) and kept["summaries"] == sorted(map(repr, scan.scan_summary(titles).collect()))
    lines = {(r.doc_id, r.pattern_id): r.hints for r in streams.scanned(spark, path, "line_hints").collect()}
    assert lines[(6, "P")] == [3] and lines[(6, "Q")] == [1] and lines[(6, "N")] == []
    assert next(v for k, v in lines.items() if k[0] in (1, 3) and k[1] == "P") == [2, 2, 3]
    # the last batch again, as after a crash between its writes and its commit
    commits = f"{path}/checkpoint/commits"
    last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    for f in (last, f".{last}.crc"):
        if os.path.exists(f"{commits}/{f}"):
            os.rename(f"{commits}/{f}", f"{path}/{f}.gone")
    streams.incremental_scan(spark.readStream.schema("doc_id long, text string").parquet(source), PATTERNS, path)
    assert snapshot(spark, path) == kept
