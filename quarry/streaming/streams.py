"""Metering and scanning as streams. Each has a batch twin in quarry.operators, which its result equals at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.columns import first_per_group
from quarry.operators import scan
from quarry.operators.context import pattern_line_hints
from quarry.sources.shared import new_folder
from quarry.streaming.states import AuditProgress, BalanceFold, ReviewState, stateful


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns its rows as a table in the shared folder."""
    spark = stream.sparkSession
    path = new_folder(spark, name)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    writer.format("parquet").option("path", f"{path}/rows").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def usage_trend_stream(usages: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tokens and records of each user by tumbling window; a window is emitted once the watermark has passed it."""
    rows = usages.withWatermark("created_at", late).groupBy("user_id", F.window("created_at", window).alias("w"))
    return rows.agg(F.sum("total_tokens").alias("tokens"), F.count(F.lit(1)).alias("records")).select("user_id", F.col("w.start").alias("window_start"), "tokens", "records")


def purchase_dedupe_stream(purchases: DataFrame, late: str = "1 day") -> DataFrame:
    """Each transaction digest once, if its repeats come within the watermark."""
    return purchases.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["transaction_digest"])


def balance_stream(events: DataFrame, late: str = "1 hour", buckets: int = 256) -> DataFrame:
    """Balances after each event of a user in the order of time, over all batches; usage beyond the balance is rejected.

    An event is folded once the watermark, `late` behind the latest, has passed it; `closed` ends a stream. Later
    ones are dropped. Events without a time or a sequence number are left out, a null delta counts 0. State is kept by
    `buckets` of users, whose waiting events a task holds in memory; their number stays the same over restarts.
    """
    stateful(events.sparkSession)
    user = F.col("user_id").cast("long")
    keys = [F.pmod(F.xxhash64(user), F.lit(buckets)).cast("int").alias("bucket"), user.isNull().alias("no_user"), F.coalesce(user, F.lit(0)).alias("user")]
    at = F.unix_micros(F.col("created_at").cast("timestamp")).alias("at")
    rows = events.where("created_at IS NOT NULL").select(*keys, at, F.col("seq").cast("long").alias("seq"), F.col("created_at").cast("timestamp").alias("created_at"), F.coalesce(F.col("delta").cast("long"), F.lit(0)).alias("delta"))
    return rows.withWatermark("created_at", late).groupBy("bucket").transformWithStateInPandas(BalanceFold(), "user_id long, seq long, delta long, balance long, rejected boolean", "append", "EventTime")


def closed(events: DataFrame, path: str, ahead: str = "interval 400 days") -> None:
    """Adds to a folder of events one without user, sequence and delta, far behind the last: it moves the watermark past all others."""
    last = events.agg((F.max(F.col("created_at").cast("timestamp")) + F.expr(ahead)).alias("created_at"))
    last.select(*[(F.col(f.name) if f.name == "created_at" else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema]).coalesce(1).write.mode("append").parquet(path)


def kept_by_version(rows: DataFrame, path: str, keys: list[str], checkpoint: str | None = None, order: tuple[str, ...] = ("version",)) -> DataFrame:
    """Runs a stream of rows that hold the whole state of their keys and returns the latest of each key.

    A batch writes the keys that it changed into a folder of its own, over what an earlier try left there: a batch
    that is repeated after a restart changes nothing. Readers take the highest `version` of each key, or the last by `order`; `compacted`
    folds the folders.
    """
    spark = rows.sparkSession
    spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{path}/changes/batch=-1")

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")

    rows.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint or f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return first_per_group(spark.read.schema(rows.schema).parquet(f"{path}/changes/batch=*"), keys, [F.desc(c) for c in order])


def latest_state(spark: SparkSession, stream: DataFrame, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, as `order` decides, over all batches; the state store holds a row a key."""
    others = [c for c in stream.columns if c not in keys]
    last = stream.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("last"))
    return kept_by_version(last.select(*[F.col(c) if c in keys else F.col(f"last.{c}") for c in stream.columns]), path, keys, order=tuple(order))


def review_stream(actions: DataFrame) -> DataFrame:
    """The state of each finding after each batch of review actions: status, severity, notes. Null fields were never set.

    `actions`: finding_id, action_type, new_severity, reason, created_at, seq. Actions without time or finding are left out.
    """
    stateful(actions.sparkSession)
    rows = actions.where("created_at IS NOT NULL AND finding_id IS NOT NULL").select("finding_id", "action_type", "new_severity", "reason", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), F.coalesce(F.col("seq").cast("long"), F.lit(-1)).alias("seq"))
    return rows.groupBy("finding_id").transformWithStateInPandas(ReviewState(), "finding_id string, status string, severity string, notes array<string>, version long", "update", "none")


def reviewed(findings: DataFrame, states: DataFrame) -> DataFrame:
    """Findings with what their reviews made of them, as `apply_actions` has it."""
    named = states.select("finding_id", F.col("status").alias("__status"), F.col("severity").alias("__severity"), F.col("notes").alias("__notes"))
    rows = findings.join(named, "finding_id", "left")
    return rows.withColumns({"status": F.coalesce("__status", "status"), "severity": F.coalesce("__severity", "severity"), "notes": F.coalesce("__notes", F.array().cast("array<string>"))}).drop("__status", "__severity", "__notes")


def progress_stream(updates: DataFrame, audits: DataFrame) -> DataFrame:
    """Progress of running audits: phase, percent and the last 500 messages; phase -1 only adds its message.

    `updates`: audit_id, seq, phase, percent, message; `audits`: id, status. Updates of audits that don't run are ignored.
    """
    stateful(updates.sparkSession)
    running = audits.where("status = 'running' AND id IS NOT NULL").select(F.col("id").alias("audit_id")).distinct()
    rows = updates.join(running, "audit_id").select("audit_id", F.coalesce(F.col("seq").cast("long"), F.lit(-1)).alias("seq"), F.coalesce(F.col("phase").cast("int"), F.lit(-1)).alias("phase"), F.coalesce(F.col("percent").cast("double"), F.lit(0.0)).alias("percent"), "message")
    return rows.groupBy("audit_id").transformWithStateInPandas(AuditProgress(), "audit_id string, current_phase int, phase_name string, progress_percent double, messages array<string>, version long", "update", "none")


#: The tables that a scan of new texts fills.
SCAN_TABLES = ("texts", "matches", "line_hints", "titles", "scores", "summaries")


def incremental_scan(texts: DataFrame, patterns: list[scan.Pattern], path: str, checkpoint: str | None = None) -> None:
    """Scans texts as they arrive (`doc_id, text`) into tables under `path`: matches, their line hints, one match a title, risk
    scores and summaries, and the content keys seen.

    A text whose content was seen before, under whatever id, is not scanned again: the state store holds a key a
    content. All tables of a batch are written from one scan, into folders named after the batch, over what an
    earlier try left there.
    """
    keyed = scan.content_keys(texts, content="text").dropDuplicates(["content_key"])

    def add(batch: DataFrame, number: int) -> None:
        def put(name: str, rows: DataFrame) -> DataFrame:
            where = f"{path}/{name}/batch={number}"
            rows.write.mode("overwrite").parquet(where)
            return batch.sparkSession.read.schema(rows.schema).parquet(where)

        fresh = put("texts", batch.select("doc_id", "text", "content_key"))
        found = put("matches", scan.match_patterns(fresh, patterns))
        put("line_hints", pattern_line_hints(found, fresh, {p.pattern_id: p.regex for p in patterns if p.regex}))
        titles = put("titles", scan.dedupe_by_title(found.withColumn("source_rank", F.lit(0))))
        put("scores", scan.scan_risk_score(titles))
        put("summaries", scan.scan_summary(titles))

    keyed.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint or f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def scanned(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table that `incremental_scan` filled."""
    return spark.read.parquet(f"{path}/{name}").drop("batch")
