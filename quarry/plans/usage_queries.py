"""Metering queries over `events` (usages and purchases) and `customer` (users)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import usage
from quarry.plans.stand_ins import oracle, table, view

USERS = """
    SELECT c_custkey AS user_id, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN 0 ELSE CAST(floor(abs(c_acctbal)) AS BIGINT) END AS token_quota,
           c_custkey * 13 % 4001 AS tokens_used, c_custkey % 9 <> 4 AS is_active, c_custkey % 2 = 0 AS has_api_key,
           CASE c_custkey % 3 WHEN 0 THEN 'own_key' WHEN 1 THEN 'platform' ELSE 'quota' END AS payment_mode, CAST(floor(c_acctbal) AS BIGINT) AS token_balance
    FROM {customer}"""
PURCHASES = """
    SELECT event_id AS id, user_id, CAST(floor(value * 10) AS BIGINT) * 1000000 AS sui_amount, CAST(floor(value * 100) AS BIGINT) AS usd_amount,
           event_id % 4 * 1000 AS token_amount, CASE event_id % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'pending' ELSE 'failed' END AS status
    FROM {events}"""
LEDGER = """
    SELECT user_id, event_id AS seq, ts AS created_at, CASE WHEN event_type = 'purchase' THEN CAST(floor(value * 5) AS BIGINT) ELSE -CAST(floor(value) AS BIGINT) END AS delta
    FROM {events}"""
#: Values have two decimals and are summed as such: a sum of doubles depends on the order of its rows, and its floor with it.
AGENTS = """
    SELECT concat('a', user_id) AS audit_id, concat('g', event_id % 5) AS agent, CAST(floor(sum(CAST(value AS DECIMAL(18, 2)))) AS BIGINT) AS prompt, CAST(count(*) AS BIGINT) AS completion,
           CAST(floor(sum(CAST(value AS DECIMAL(18, 2)))) + count(*) AS BIGINT) AS total, CAST(sum(event_id % 2) AS BIGINT) AS calls
    FROM {events} GROUP BY user_id, event_id % 5"""


def derived(sql, spark, sf_dir, name):
    return spark.sql(sql, **{name: table(spark, sf_dir, name)})


def named(name, sql):
    return f"{name} AS ({sql.replace('{', '').replace('}', '')})"


def trend(unit):
    return lambda spark, sf: usage.usage_trend(view(spark, sf, "usages"), unit)


def trend_sql(bucket):
    return oracle(f"SELECT user_id, {bucket} AS bucket, CAST(sum(total_tokens) AS BIGINT) AS tokens, count(*) AS records FROM usages GROUP BY ALL")


def by_agent(spark, sf):
    rows = table(spark, sf, "events").withColumn("agent_breakdown", F.create_map(F.col("event_type"), F.struct(F.when(F.col("event_id") % 5 != 0, F.floor("value")).alias("total")), F.concat(F.lit("x"), F.col("event_id") % 3), F.struct(F.lit(1).cast("long").alias("total"))))
    return usage.usage_by_agent(rows)



QUERIES = {
    "a1_usage_trend_day": trend("day"),
    "a1_usage_trend_week": trend("week"),
    "a1_usage_trend_month": trend("month"),
    "a1_usage_trend_since": lambda s, d: usage.usage_trend(view(s, d, "usages"), "day", F.lit("2024-01-20").cast("timestamp"), 2),
    "a2_usage_by_project": lambda s, d: usage.usage_by_project(view(s, d, "usages")),
    "a3_usage_by_agent": by_agent,
    "a4_usage_totals": lambda s, d: usage.usage_totals(derived(USERS, s, d, "customer"), view(s, d, "usages")),
    "a5_all_user_stats": lambda s, d: usage.all_user_stats(derived(USERS, s, d, "customer"), view(s, d, "usages")).select("user_id", "remaining", "records", "system_tokens"),
    "a6_quota_status": lambda s, d: usage.quota_status(derived(USERS, s, d, "customer")).select("user_id", "remaining", "percent_used", "unlimited"),
    "a18_purchase_totals": lambda s, d: usage.purchase_totals(derived(PURCHASES, s, d, "events")),
    "a20_audit_token_rollup": lambda s, d: usage.audit_token_rollup(derived(AGENTS, s, d, "events")).select("audit_id", "prompt", "completion", "total", F.size("by_agent").alias("agents")),
    "q2_purchase_prices": lambda s, d: usage.purchase_prices(derived(PURCHASES, s, d, "events")).select("id", F.round("coin_usd", 6).alias("coin_usd"), F.round("token_usd", 6).alias("token_usd")),
    "q3_audit_permission": lambda s, d: usage.audit_permission(derived(USERS, s, d, "customer"), 500).select("user_id", "allowed", "reason"),
    "w1_running_balance": lambda s, d: usage.running_balance(derived(LEDGER, s, d, "events")),
    "w1_unconstrained_balance": lambda s, d: usage.unconstrained_balance(derived(LEDGER, s, d, "events")).select("user_id", "seq", "balance"),
}

ORACLES = {
    "a1_usage_trend_day": trend_sql("strftime(created_at, '%Y-%m-%d')"),
    "a1_usage_trend_week": trend_sql("strftime(created_at, '%Y-W%W')"),
    "a1_usage_trend_month": trend_sql("strftime(created_at, '%Y-%m')"),
    "a1_usage_trend_since": oracle("SELECT user_id, strftime(created_at, '%Y-%m-%d') AS bucket, CAST(sum(total_tokens) AS BIGINT) AS tokens, count(*) AS records FROM usages WHERE created_at >= TIMESTAMP '2024-01-18' GROUP BY ALL"),
    "a2_usage_by_project": oracle("""
        WITH s AS (SELECT user_id, project_name, CAST(sum(total_tokens) AS BIGINT) AS tokens, count(*) AS records FROM usages WHERE project_name IS NOT NULL GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tokens DESC, project_name) AS rank FROM s QUALIFY rank <= 10"""),
    "a3_usage_by_agent": """
        SELECT user_id, agent, CAST(sum(t) AS BIGINT) AS tokens FROM (
            SELECT user_id, event_type AS agent, CASE WHEN event_id % 5 <> 0 THEN floor(value) ELSE 0 END AS t FROM events
            UNION ALL SELECT user_id, concat('x', event_id % 3), 1 FROM events) GROUP BY ALL""",
    "a4_usage_totals": f"""
        WITH {named('users', USERS)} SELECT user_id, count(event_id) AS records, CAST(coalesce(sum(floor(value)), 0) AS BIGINT) AS tokens FROM users LEFT JOIN events USING (user_id) GROUP BY user_id""",
    "a5_all_user_stats": f"""
        WITH {named('users', USERS)} SELECT u.user_id, CASE WHEN token_quota IS NOT NULL THEN greatest(0, token_quota - tokens_used) END AS remaining,
               (SELECT count(*) FROM events e WHERE e.user_id = u.user_id) AS records, CAST((SELECT sum(tokens_used) FROM users) AS BIGINT) AS system_tokens FROM users u""",
    "a6_quota_status": f"""
        WITH {named('users', USERS)} SELECT user_id, CASE WHEN token_quota IS NOT NULL THEN greatest(0, token_quota - tokens_used) END AS remaining,
               CASE WHEN token_quota IS NULL THEN NULL WHEN token_quota = 0 THEN 100.0::DOUBLE ELSE round(tokens_used * 100.0::DOUBLE / token_quota, 2) END AS percent_used, token_quota IS NULL AS unlimited FROM users""",
    "a18_purchase_totals": f"""
        WITH {named('p', PURCHASES)} SELECT user_id, count(*) AS purchases, CAST(coalesce(sum(token_amount) FILTER (status = 'confirmed'), 0) AS BIGINT) AS confirmed_tokens,
               count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'failed') AS failed FROM p GROUP BY user_id""",
    "a20_audit_token_rollup": f"""
        WITH {named('g', AGENTS)} SELECT audit_id, CAST(sum(prompt) AS BIGINT) AS prompt, CAST(sum(completion) AS BIGINT) AS completion, CAST(sum(total) AS BIGINT) AS total, CAST(count(*) AS INT) AS agents
        FROM g WHERE calls >= 1 GROUP BY audit_id HAVING sum(total) > 0""",
    "q2_purchase_prices": f"""
        WITH {named('p', PURCHASES)} SELECT id, round(CASE WHEN sui_amount = 0 THEN 0 ELSE (usd_amount / 100) / (sui_amount / 1e9) END, 6) AS coin_usd,
               round(CASE WHEN token_amount = 0 THEN 0 ELSE (usd_amount / 100) / token_amount END, 6) AS token_usd FROM p""",
    "q3_audit_permission": f"""
        WITH {named('users', USERS)}, r AS (SELECT user_id, CASE WHEN NOT is_active THEN 'inactive' WHEN payment_mode = 'own_key' THEN CASE WHEN has_api_key THEN 'ok' ELSE 'no key' END
               WHEN payment_mode = 'platform' THEN CASE WHEN token_balance <= 0 THEN 'no balance' ELSE 'ok' END WHEN token_quota IS NULL THEN 'ok'
               WHEN token_quota - tokens_used <= 0 THEN 'quota used up' WHEN token_quota - tokens_used < 500 THEN 'quota too small' ELSE 'ok' END AS reason FROM users)
        SELECT user_id, reason = 'ok' AS allowed, reason FROM r""",
    "w1_running_balance": f"""
        WITH RECURSIVE {named('ledger', LEDGER)}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, seq) AS k FROM ledger),
        f AS (SELECT user_id, seq, delta, k, CASE WHEN delta < 0 THEN 0 ELSE delta END AS balance, delta < 0 AS rejected FROM o WHERE k = 1
              UNION ALL SELECT o.user_id, o.seq, o.delta, o.k, CASE WHEN f.balance + o.delta < 0 THEN f.balance ELSE f.balance + o.delta END, f.balance + o.delta < 0 FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
        SELECT user_id, seq, delta, balance, rejected FROM f""",
    "w1_unconstrained_balance": f"""
        WITH {named('ledger', LEDGER)} SELECT user_id, seq, CAST(sum(delta) OVER (PARTITION BY user_id ORDER BY created_at, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM ledger""",
}
