"""Streams over the event and document tables, drained and compared with SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.plans.scan_queries import LINE, ONCE, PROSE, SCORE, SQL_HINTS, flat, sql_matches
from quarry.plans.stand_ins import table
from quarry.plans.usage_queries import ORACLES as USAGE
from quarry.sources.shared import new_folder
from quarry.streaming import streams
from quarry.streaming.states import PHASE_NAMES, UNNAMED_PHASE


def stream(s, d, name):
    kept = table(s, d, name)
    # a file that is given alone is a stream of one file, by a pattern; a folder is read as it is, so that each of its files comes once
    path = f"{d.rstrip('/')}/{name}.parquet"
    alone = any(f.endswith(f"/{name}.parquet") for f in kept.inputFiles())
    return s.readStream.schema(kept.schema).parquet(f"{d.rstrip('/')}/{{{name}.parquet}}" if alone else path)


def usage_windows(s, d):
    usages = stream(s, d, "events").select("user_id", F.floor("value").alias("total_tokens"), F.col("ts").cast("timestamp").alias("created_at"))
    return streams.drained(streams.usage_trend_stream(usages), "usage").select("user_id", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "tokens", "records")


def unique_purchases(s, d):
    rows = stream(s, d, "events").select(F.concat(F.lit("t"), F.col("event_id") - F.col("event_id") % 2).alias("transaction_digest"), F.col("ts").cast("timestamp").alias("created_at"))
    return streams.drained(streams.purchase_dedupe_stream(rows), "purchases").select("transaction_digest")


DELTAS = "SELECT user_id, event_id AS seq, ts AS created_at, CASE WHEN event_type = 'purchase' THEN CAST(floor(value * 5) AS BIGINT) ELSE -CAST(floor(value) AS BIGINT) END AS delta FROM {events}"
#: Of an event as a review action; Spark and DuckDB both run it.
ACTION_COLUMNS = [
    "CASE event_type WHEN 'click' THEN 'confirm' WHEN 'error' THEN 'reject' WHEN 'purchase' THEN 'upgrade' WHEN 'view' THEN 'downgrade' ELSE 'add_note' END AS action_type",
    "CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' WHEN 2 THEN 'high' END AS new_severity",
    "concat('n', event_id) AS reason",
    "ts AS created_at",
    "event_id AS seq",
]


def late_files(s, d):
    """Events in files that come one after another; every other event comes a file late. Also how late that is."""
    rows, path = s.sql(DELTAS, events=table(s, d, "events")), new_folder(s, "events")
    first, last = rows.agg(F.min("created_at").cast("timestamp").cast("long"), F.max("created_at").cast("timestamp").cast("long")).first()
    span = max(1, -(-(last - first + 1) // 4))
    file = F.floor((F.col("created_at").cast("timestamp").cast("long") - first) / span) + F.pmod("seq", F.lit(2))
    for n in range(5):
        rows.where(file == n).write.mode("append").parquet(path)
    streams.closed(rows, path)
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(path), f"{2 * span} seconds"


def balances(s, d):
    rows, late = late_files(s, d)
    return streams.drained(streams.balance_stream(rows, late), "balances")


def finding_states(s, d):
    actions = stream(s, d, "events").selectExpr("concat('f', user_id) AS finding_id", *ACTION_COLUMNS)
    states = streams.kept_by_version(streams.review_stream(actions), new_folder(s, "reviews"), ["finding_id"])
    findings = table(s, d, "events").selectExpr("concat('f', user_id) AS finding_id", "'open' AS status", "'medium' AS severity").distinct()
    return streams.reviewed(findings, states).select("finding_id", "status", "severity", F.array_join("notes", "|").alias("notes"))


def audit_progress(s, d):
    updates = stream(s, d, "conversations").selectExpr("concat('a', conv_id) AS audit_id", "turn AS seq", "CAST(CASE WHEN turn % 3 = 1 THEN -1 ELSE turn % 8 END AS INT) AS phase", "CAST(turn * 10 AS DOUBLE) AS percent", "text AS message")
    audits = table(s, d, "conversations").selectExpr("concat('a', conv_id) AS id", "CASE WHEN conv_id % 4 = 0 THEN 'failed' ELSE 'running' END AS status").distinct()
    states = streams.kept_by_version(streams.progress_stream(updates, audits), new_folder(s, "progress"), ["audit_id"])
    return states.select("audit_id", "current_phase", "phase_name", "progress_percent", F.size("messages").cast("long").alias("n"), F.sha2(F.array_join("messages", "|"), 256).alias("messages"))


def scan_stream(s, d):
    path = new_folder(s, "scanned")
    streams.incremental_scan(stream(s, d, "documents").select("doc_id", "text"), PROSE, path)
    titles, texts = (streams.scanned(s, path, n) for n in ("titles", "texts"))
    hints, scores, summaries = (streams.scanned(s, path, n) for n in ("line_hints", "scores", "summaries"))
    rows = flat(titles).join(texts.select("doc_id", "content_key"), "doc_id").join(hints.select("doc_id", "pattern_id", F.array_join("hints", ",").alias("hints")), ["doc_id", "pattern_id"])
    return rows.join(scores, "doc_id").join(summaries.select("doc_id", "summary"), "doc_id").drop("doc_id", "seq")


QUERIES = {
    "t1_usage_trend_stream": usage_windows,
    "t2_purchase_dedupe_stream": unique_purchases,
    "t3_balance_stream": balances,
    "t4_finding_state_stream": finding_states,
    "t5_incremental_scan_stream": scan_stream,
    "t6_audit_progress_stream": audit_progress,
}

#: A window is emitted when the watermark, an hour behind the latest event, has passed its end.
ORACLES = {
    "t1_usage_trend_stream": """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CAST(sum(floor(value)) AS BIGINT) AS tokens, count(*) AS records FROM events GROUP BY user_id, strftime(ts, '%Y-%m-%d'), date_trunc('day', ts)
        HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    "t2_purchase_dedupe_stream": "SELECT DISTINCT concat('t', event_id - event_id % 2) AS transaction_digest FROM events",
    "t3_balance_stream": USAGE["w1_running_balance"],
    "t4_finding_state_stream": f"""WITH a AS (SELECT concat('f', user_id) AS finding_id, {", ".join(ACTION_COLUMNS)} FROM events), o AS (SELECT *, row(created_at, seq) AS place FROM a)
        SELECT finding_id, coalesce(arg_max(CASE action_type WHEN 'confirm' THEN 'confirmed' ELSE 'rejected' END, place) FILTER (action_type IN ('confirm', 'reject')), 'open') AS status,
               coalesce(arg_max(new_severity, place) FILTER (action_type IN ('upgrade', 'downgrade') AND new_severity IS NOT NULL), 'medium') AS severity,
               coalesce(string_agg(reason, '|' ORDER BY created_at, seq) FILTER (action_type = 'add_note'), '') AS notes FROM o GROUP BY finding_id""",
    "t5_incremental_scan_stream": f"""WITH d AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text), m AS ({sql_matches(PROSE, "d")}), once AS ({ONCE}),
        {SQL_HINTS},
        r AS (SELECT doc_id, {SCORE} AS risk_score, {LINE} AS summary FROM once GROUP BY doc_id)
        SELECT 'code:' || sha256(text)[1:32] AS content_key, pattern_id, title, severity, cues, confidence, coalesce(hints, '') AS hints, risk_score, summary
        FROM once JOIN d USING (doc_id) JOIN r USING (doc_id) LEFT JOIN h USING (doc_id, pattern_id)""",
    "t6_audit_progress_stream": f"""WITH u AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN -1 ELSE turn % 8 END AS phase, text FROM conversations WHERE conv_id % 4 <> 0),
        l AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, turn FROM u),
        m AS (SELECT conv_id, count(*) AS n, sha256(string_agg(text, '|' ORDER BY turn)) AS messages FROM l WHERE back <= 500 GROUP BY conv_id)
        SELECT concat('a', m.conv_id) AS audit_id, CAST(coalesce(phase, 0) AS INT) AS current_phase, CASE phase {" ".join(f"WHEN {k} THEN '{v}'" for k, v in PHASE_NAMES.items())} ELSE coalesce(text, '{UNNAMED_PHASE}') END AS phase_name,
               CAST(coalesce(turn, 0) * 10 AS DOUBLE) AS progress_percent, n, messages
        FROM m LEFT JOIN (SELECT * FROM u WHERE phase <> -1 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1) p ON p.conv_id = m.conv_id""",
}
