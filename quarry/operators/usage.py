"""Metering: usage by time, project and agent, quotas, balances and purchases."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from quarry.functions.columns import choose, topk_per_group, week_label


def usage_trend(usages: DataFrame, unit: str, now: Column | None = None, limit: int | None = None) -> DataFrame:
    """Tokens and records of each user by day, week or month; with `now` only the last `limit` units (a month has 30 days)."""
    if now is not None and limit is not None:
        days = limit * {"day": 1, "week": 7, "month": 30}[unit]
        usages = usages.where(F.col("created_at") >= now - F.expr(f"INTERVAL {days} DAYS"))
    at = F.col("created_at")
    bucket = {"day": F.date_format(at, "yyyy-MM-dd"), "week": week_label(at), "month": F.date_format(at, "yyyy-MM")}[unit]
    return usages.groupBy("user_id", bucket.alias("bucket")).agg(F.sum("total_tokens").alias("tokens"), F.count(F.lit(1)).alias("records"))


def usage_by_project(usages: DataFrame, n: int = 10) -> DataFrame:
    """The n projects with most tokens of each user; records without a project are left out."""
    sums = usages.where(F.col("project_name").isNotNull()).groupBy("user_id", "project_name").agg(F.sum("total_tokens").alias("tokens"), F.count(F.lit(1)).alias("records"))
    return topk_per_group(sums, ["user_id"], [F.desc("tokens"), F.asc("project_name")], n, "rank")


def usage_by_agent(usages: DataFrame, breakdown: str = "agent_breakdown") -> DataFrame:
    """Tokens of each user and agent from a map column of structs; a missing total counts 0."""
    rows = usages.select("user_id", F.explode(breakdown).alias("agent", "part"))
    return rows.groupBy("user_id", "agent").agg(F.sum(F.coalesce("part.total", F.lit(0))).alias("tokens"))


def usage_totals(users: DataFrame, usages: DataFrame) -> DataFrame:
    """Records and tokens of each user, zeros for those without any."""
    sums = usages.groupBy("user_id").agg(F.count(F.lit(1)).alias("records"), F.sum("total_tokens").alias("tokens"))
    return users.select("user_id").join(sums, "user_id", "left").select("user_id", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def quota_status(users: DataFrame) -> DataFrame:
    """What is left of each quota; null is unlimited, a quota of 0 is wholly used."""
    quota, used = F.col("token_quota"), F.col("tokens_used")
    percent = choose([(quota.isNull(), None), (quota == 0, 100.0)], F.round(used * 100.0 / quota, 2))
    return users.withColumns({"remaining": F.when(quota.isNotNull(), F.greatest(F.lit(0), quota - used)), "percent_used": percent.cast("double"), "unlimited": quota.isNull()})


def all_user_stats(users: DataFrame, usages: DataFrame) -> DataFrame:
    """quota_status of all users with their records, and the tokens of the whole system in each row."""
    records = usages.groupBy("user_id").agg(F.count(F.lit(1)).alias("records"))
    total = users.agg(F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("system_tokens"))
    joined = quota_status(users).join(records, "user_id", "left").withColumn("records", F.coalesce("records", F.lit(0)))
    return joined.join(F.broadcast(total), F.lit(True))  # one row


def audit_permission(users: DataFrame, estimate: int = 0) -> DataFrame:
    """Whether each user may start an audit of `estimate` tokens, and why not."""
    left = F.col("token_quota") - F.col("tokens_used")
    reason = choose(
        [
            (~F.col("is_active"), "inactive"),
            ((F.col("payment_mode") == "own_key") & ~F.col("has_api_key"), "no key"),
            ((F.col("payment_mode") == "platform") & (F.col("token_balance") <= 0), "no balance"),
            (F.col("payment_mode").isin("own_key", "platform") | F.col("token_quota").isNull(), "ok"),
            (left <= 0, "quota used up"),
            (left < estimate, "quota too small"),
        ],
        "ok",
    )
    return users.withColumn("reason", reason).withColumn("allowed", F.col("reason") == "ok")


def audit_token_rollup(agent_stats: DataFrame) -> DataFrame:
    """Sums over the agents of an audit with at least one call; audits whose total is 0 are left out."""
    sums = agent_stats.where("calls >= 1").groupBy("audit_id").agg(*[F.sum(c).alias(c) for c in ("prompt", "completion", "total")], F.map_from_entries(F.array_sort(F.collect_list(F.struct("agent", "total")))).alias("by_agent"))
    return sums.where("total > 0")


def purchase_prices(purchases: DataFrame) -> DataFrame:
    """Prices in dollars of a coin (10^9 units) and of a token; 0 where the divisor is 0."""
    dollars = F.col("usd_amount") / 100
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return purchases.withColumns({"coin_usd": zero(F.try_divide(dollars, F.col("sui_amount") / 1e9)), "token_usd": zero(F.try_divide(dollars, F.col("token_amount")))})


def purchase_totals(purchases: DataFrame) -> DataFrame:
    """Of each user: purchases, tokens of confirmed ones, and purchases by status."""
    by = {s: F.count_if(F.col("status") == s).alias(s) for s in ("pending", "confirmed", "failed")}
    return purchases.groupBy("user_id").agg(F.count(F.lit(1)).alias("purchases"), F.coalesce(F.sum(F.when(F.col("status") == "confirmed", F.col("token_amount"))), F.lit(0)).alias("confirmed_tokens"), *by.values())


def running_balance(events: DataFrame) -> DataFrame:
    """Balance of each user after each event in time order; usage beyond the balance is rejected and not deducted.

    `events`: user_id, seq, created_at, delta (tokens bought, or minus those used; null counts 0). A rejection
    depends on all before it, so a user's events lie in one partition, sorted, and are folded as batches stream
    by: a task holds a batch and a balance, however many events a user has. Events without user are one user's.
    """
    ordered = events.select("user_id", F.col("seq").cast("long"), "created_at", F.col("delta").cast("long")).repartition("user_id").sortWithinPartitions("user_id", "created_at", "seq").drop("created_at")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, balance = object(), 0  # no id equals the first
        for batch in batches:
            balances, rejections = [], []
            for owner, delta in zip(batch.column("user_id").to_pylist(), batch.column("delta").to_pylist()):
                if owner != user:
                    user, balance = owner, 0
                rejected = balance + (delta or 0) < 0
                balance += 0 if rejected else delta or 0
                balances.append(balance)
                rejections.append(rejected)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(balances, pa.int64()), pa.array(rejections, pa.bool_())], [*batch.schema.names, "balance", "rejected"])

    return ordered.mapInArrow(fold, StructType([*ordered.schema.fields, StructField("balance", LongType()), StructField("rejected", BooleanType())]))


def unconstrained_balance(events: DataFrame) -> DataFrame:
    """Running sum of each user's events, without rejection."""
    return events.withColumn("balance", F.sum("delta").over(Window.partitionBy("user_id").orderBy("created_at", "seq").rowsBetween(Window.unboundedPreceding, 0)))
