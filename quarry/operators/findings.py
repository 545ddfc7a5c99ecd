"""Findings: normalise, deduplicate, group, decide, count and order.

Where the first row counts, `seq` gives the order of input rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.exploit_data import DEFAULT_GAIN, DEFAULT_HINT, DEFAULT_IMPACT, GAINS, HINTS, IMPACTS
from quarry.functions.columns import SEVERITIES, any_in, choose, first_per_group, line_start, severity_rank, text_of, topk_per_group, vuln_type
from quarry.sources.shared import kept_table

KEY = ["module", "function", "line_key", "vuln_type"]
#: Points of each severity in the two risk scores, and their caps in the first.
POINTS_10 = {"critical": (4.0, 10.0), "high": (2.0, 6.0), "medium": (1.0, 3.0), "low": (0.5, 1.0)}
POINTS_100 = {"critical": 40, "high": 25, "medium": 15, "low": 8, "advisory": 4}
BANDS_10 = [(8, "critical"), (6, "high"), (4, "medium"), (2, "low")]
#: How sure each word of an exploit check is.
SURENESS = {"high": 85, "medium": 60, "low": 35, "theoretical": 15}

RAW = "struct<finding_id:string,status:string,final_severity:string,original_finding:struct<title:string,description:string,severity:string,category:string,location:struct<module:string,function:string,line:string>,code_snippet:string>,code:string,notes:array<string>>"


def parse_findings(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Flat findings from nested JSON documents; a broken document gives a row of defaults."""
    f = F.from_json(column, RAW)
    rows = raw.withColumn("f", f)
    severity = F.upper(F.coalesce("f.final_severity", "f.original_finding.severity", F.lit("MEDIUM")))
    place = "f.original_finding.location"
    return rows.select(
        *[c for c in raw.columns if c != column],
        F.col("f.finding_id").alias("finding_id"),
        choose([(F.col("f.status") == "confirmed", "confirmed"), (F.col("f.status") == "false_positive", "rejected")], "open").alias("status"),
        F.when(severity.isin(SEVERITIES), severity).otherwise("MEDIUM").alias("severity"),
        F.coalesce("f.original_finding.title", F.lit("")).alias("title"),
        F.coalesce("f.original_finding.description", F.array_join("f.notes", "\n"), F.lit("")).alias("description"),
        F.concat_ws("::", f"{place}.module", f"{place}.function").alias("location"),
        F.coalesce("f.original_finding.code_snippet", "f.code").alias("code"),
    )


def with_vuln_type(findings: DataFrame) -> DataFrame:
    return findings.withColumns({"vuln_type": vuln_type("title", "description"), "line_key": line_start(F.col("line"))})


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """The surest finding of each place and type; the first among equals."""
    return first_per_group(with_vuln_type(findings), KEY, [F.desc("confidence"), F.asc("seq")])


def min_confidence(findings: DataFrame, least: int = 30) -> DataFrame:
    return dedupe_findings(findings).where(F.col("confidence") >= least)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """df with the place of each row in its group, from 1.

    A group may hold most rows. So rows are dealt by ranges of group and order, and written with their range;
    a row's place in its range comes after the rows of its group in the ranges before.
    """
    rank = [F.col(k).asc() for k in keys] + order
    ranges = kept_table(df.repartitionByRange(*rank).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__rows"))
    before = F.sum("__rows").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__in"), F.coalesce(before, F.lit(0)).alias("__before"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__range") == F.col("__in")]
    placed = ranges.withColumn("__place", F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(*order)))
    return placed.join(offsets, same).select(*df.columns, (F.col("__place") + F.col("__before")).cast("int").alias(name))


def order_functions_by_risk(functions: DataFrame) -> DataFrame:
    """Functions with their place in their module, riskiest first; equal ones and those without a score in input order."""
    return numbered(functions, ["module"], [F.desc_nulls_last("risk_score"), F.asc("seq")], "place")


def scan_batches(functions: DataFrame, size: int = 5) -> DataFrame:
    """Batches of a module's functions, riskiest first."""
    return order_functions_by_risk(functions).withColumn("batch", ((F.col("place") - 1) / size).cast("int") + 1).drop("place")


def group_findings(findings: DataFrame, size: int = 5) -> DataFrame:
    """Groups of at most `size` findings of a module, in input order."""
    places = numbered(findings, ["module"], [F.asc("seq")], "__at")
    return places.withColumn("group", ((F.col("__at") - 1) / size).cast("int") + 1).drop("__at")


def final_status(findings: DataFrame, verdicts: DataFrame, mode: str = "full") -> DataFrame:
    """Findings with their verdict's status, confidence and severity.

    Full mode promotes needs_review to confirmed with a confidence of 60 at least; an unknown word is
    needs_review. Quick mode takes a missing verdict as confirmed.
    """
    own = verdicts.select("finding_id", F.col("conclusion"), F.col("confidence").alias("verdict_confidence"), F.col("final_severity").alias("verdict_severity"))
    rows = findings.join(own, "finding_id", "left")
    word, sure = F.coalesce("conclusion", F.lit("needs_review" if mode == "full" else "confirmed")), F.coalesce("verdict_confidence", F.lit(50))
    if mode == "full":
        status = choose([(word.isin("needs_review", "confirmed"), "confirmed"), (word == "false_positive", "false_positive")], "needs_review")
        sure = F.when(word == "needs_review", F.greatest(sure, F.lit(60))).otherwise(sure)
    else:
        status = choose([(word.isin("confirmed", "false_positive"), word)], "needs_review")
    severity = F.when(status == "false_positive", "none").otherwise(F.lower(F.coalesce("verdict_severity", "severity", F.lit("medium"))))
    return rows.withColumns({"final_status": status, "final_confidence": sure, "final_severity": severity}).drop("conclusion", "verdict_confidence", "verdict_severity")


def union_early_filtered(verified: DataFrame, filtered: DataFrame) -> DataFrame:
    """Verified findings and those that rules removed, as false positives with a confidence of 95."""
    removed = filtered.withColumns({"final_status": F.lit("false_positive"), "final_confidence": F.lit(95), "final_severity": F.lower(F.coalesce("severity", F.lit("low")))})
    return verified.unionByName(removed, allowMissingColumns=True)


def exploit_candidates(verified: DataFrame) -> DataFrame:
    """Findings worth an exploit check, one for each place and type. A missing function is read from the title."""
    severity = F.lower("final_severity")
    wanted = verified.where(((F.col("final_status") == "confirmed") & severity.isin("critical", "high")) | ((F.col("final_status") == "needs_review") & severity.isin("critical", "high", "medium")))
    named = F.coalesce(F.nullif(F.col("function"), F.lit("")), F.nullif(F.regexp_extract("title", "`([A-Za-z_0-9]+)`", 1), F.lit("")), F.nullif(F.regexp_extract("title", r"([A-Za-z_0-9]+)\(", 1), F.lit("")), F.lit(""))
    return dedupe_findings(wanted.withColumn("function", named))


def exploit_status(rows: DataFrame) -> DataFrame:
    """Status of exploit checks from `exploitable`, `sureness` (a word) and `score`."""
    sure = choose([(F.lower("sureness") == w, n) for w, n in SURENESS.items()], 50)
    score, can = F.col("score"), F.col("exploitable")
    status = choose(
        [
            (can & (sure >= 80) & (score >= 7), "verified"),
            (can & (sure >= 60) & (score >= 5), "likely"),
            (can & (score >= 4), "needs_review"),
            (~can & (sure >= 80) & (score <= 2), "false_positive"),
            (~can & (sure >= 80), "theoretical"),
        ],
        "needs_review",
    )
    return rows.withColumns({"sureness_points": sure, "exploit_status": status})


def exploitability(rows: DataFrame) -> DataFrame:
    """Ten minus penalties for who may call, for the path, for conditions and for an unknown goal; 0 to 10."""
    caller = choose([(F.col("caller") == "unknown", 4.0), (F.col("caller") == "admin", 3.0), (F.col("caller") == "specific_address", 2.0)], 0.0)
    path = choose([(F.col("path_steps") == 0, 5.0), (F.col("path_steps") > 5, 1.0)], 0.0)
    score = 10.0 - caller - path - 0.5 * F.col("hard_conditions") - 2.0 * F.col("unrealistic_conditions") - F.when(F.col("goal") == "unknown", 2.0).otherwise(0.0)
    return rows.withColumn("exploitability", F.greatest(F.lit(0.0), F.least(F.lit(10.0), score)))


def is_real(rows: DataFrame) -> DataFrame:
    """Exploit rows that count as real: sure, of a score of 6 or more, with a path."""
    return rows.where(F.col("sureness").isin("verified", "high") & (F.col("score") >= 6) & (F.col("path_steps") > 0))


def looked_up(key: Column, table: dict[str, tuple[str, ...]], default: tuple[str, ...], names: list[str]) -> dict[str, Column]:
    """Columns of a small fixed table by key, as literal cases."""
    return {n: choose([(key == k, row[i]) for k, row in table.items()], default[i]) for i, n in enumerate(names)}


def impact_by_type(findings: DataFrame) -> DataFrame:
    """Who is hit, how much may be lost and what is gained, by the type in `category`."""
    kind = F.coalesce("category", F.lit(""))
    gains = {k: (v,) for k, v in GAINS.items()}
    return findings.withColumns(looked_up(kind, IMPACTS, DEFAULT_IMPACT, ["parties", "max_loss"]) | looked_up(kind, gains, (DEFAULT_GAIN,), ["gain"]))


def concat_phases(batch: DataFrame, cross: DataFrame) -> DataFrame:
    """Findings of two scan phases, tagged by phase."""
    return batch.withColumn("phase", F.lit("batch")).unionByName(cross.withColumn("phase", F.lit("cross_function")), allowMissingColumns=True)


def finding_function(findings: DataFrame) -> DataFrame:
    """The function a finding is about: its own, the last part of its path, or one that its title names; generic parts cut."""
    take = lambda c, p: F.nullif(F.regexp_extract(F.coalesce(F.col(c), F.lit("")), p, 1), F.lit(""))
    name = F.coalesce(F.nullif(F.col("function"), F.lit("")), take("path", r"::([^:]+)$"), take("title", "`([A-Za-z_0-9]+)`"), take("title", "([A-Za-z_0-9]+) 函数"), take("title", r"::([A-Za-z_0-9]+)"), F.lit(""))
    return findings.withColumn("function_name", F.regexp_replace(name, "<.*$", ""))


def format_location(findings: DataFrame) -> DataFrame:
    """`module::function:line` as far as known, else `file:line`."""
    line = F.nullif(line_start(F.col("line")), F.lit(""))
    return findings.withColumn("location", F.concat_ws(":", F.coalesce(F.nullif(F.concat_ws("::", "module", "function"), F.lit("")), F.col("file")), line))


def status_reasons(verified: DataFrame) -> DataFrame:
    """Why a finding is a false positive, or what keeps it in review."""
    why = F.coalesce("rule_reason", "verdict_reason", F.substring("recommendation", 1, 100), F.lit("judged a false positive"))
    open_points = F.filter(F.array(
        F.when(F.col("parse_error"), "verdict not readable"), F.when(F.col("final_confidence") < 50, "low confidence"),
        F.when(F.col("rounds_differ"), "verdicts differ"), F.when(any_in(text_of("verdict_reason"), ["external", "dependency"]), "depends on other code"),
    ), lambda x: x.isNotNull())
    return verified.withColumns({"false_positive_reason": F.when(F.col("final_status") == "false_positive", why), "review_reasons": F.when(F.col("final_status") == "needs_review", open_points)})


def exploit_hints(findings: DataFrame) -> DataFrame:
    """Hints for checking whether a finding can be used, by the type in `category`."""
    return findings.withColumns(looked_up(F.coalesce("category", F.lit("")), HINTS, DEFAULT_HINT, ["entry_hint", "attack_hint", "precondition_hint", "impact_hint"]))


def split_by_status(rows: DataFrame) -> DataFrame:
    """Exploit rows by outcome for each project, and the share that was verified."""
    outcome = choose([(F.col("sureness").isin("verified", "high") & (F.col("score") >= 6) & (F.col("path_steps") > 0), "verified"), (F.col("sureness") == "theoretical", "theoretical")], "needs_review")
    counts = rows.withColumn("o", outcome).groupBy("project").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("o") == o).alias(o) for o in ("verified", "theoretical", "needs_review")])
    return counts.withColumn("verification_rate", F.col("verified") / F.greatest(F.col("n"), F.lit(1)))


def audit_statistics(verified: DataFrame, key: str = "project") -> DataFrame:
    """Counts by status, share of false positives, mean confidence, and severities of confirmed findings."""
    status, n = F.col("status"), F.count(F.lit(1))
    by_severity = [F.count_if((status == "confirmed") & (F.lower("severity") == s)).alias(s) for s in POINTS_10]
    return verified.groupBy(key).agg(n.alias("total"), *[F.count_if(status == s).alias(s) for s in ("confirmed", "false_positive", "needs_review")], F.round(F.count_if(status == "false_positive") / n, 4).alias("fp_rate"), F.round(F.avg("confidence"), 4).alias("mean_confidence"), *by_severity)


def exploit_statistics(rows: DataFrame, key: str = "project") -> DataFrame:
    """Exploit checks by status (missing: theoretical), and chains of several findings."""
    status = F.coalesce("exploit_status", F.lit("theoretical"))
    return rows.groupBy(key).agg(*[F.count_if(status == s).alias(s) for s in ("verified", "likely", "theoretical", "needs_review", "false_positive")], F.count_if(F.col("chained")).alias("chains"))


def risk_score_10(stats: DataFrame) -> DataFrame:
    """Capped points of confirmed severities, 0 to 10, with the band of the score."""
    parts = [F.least(F.lit(points) * F.col(s), F.lit(most)) for s, (points, most) in POINTS_10.items()]
    score = F.least(F.lit(10.0), F.bround(sum(parts[1:], parts[0]), 1))
    return stats.withColumn("risk_score", score).withColumn("risk_level", choose([(F.col("risk_score") >= low, name) for low, name in BANDS_10], "minimal"))


def risk_score_100(stats: DataFrame) -> DataFrame:
    parts = [F.lit(points) * F.col(s) for s, points in POINTS_100.items()]
    return stats.withColumn("risk_score", F.least(F.lit(100), sum(parts[1:], parts[0])))


def severity_histogram(findings: DataFrame, key: str = "report_id", rejected: str = "rejected") -> DataFrame:
    """Findings of each report by severity, rejected ones left out, zeros filled in."""
    kept = findings.where(F.coalesce("status", F.lit("")) != rejected)
    return kept.groupBy(key).agg(*[F.count_if(F.upper("severity") == s).alias(s.lower()) for s in SEVERITIES])


def functions_with_findings(findings: DataFrame) -> DataFrame:
    return findings.groupBy("module").agg(F.count_distinct("function").alias("functions"), F.array_sort(F.collect_set("function")).alias("names"))


def finding_index(verified: DataFrame) -> DataFrame:
    """Numbered index of the confirmed findings of each project, worst first, with shortened texts."""
    short = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(F.col(c))
    place = F.concat_ws("::", F.element_at(F.split("module", "::"), -1), "function")
    places = numbered(verified.where("status = 'confirmed'"), ["project"], [severity_rank(F.col("severity")).asc(), F.asc("seq")], "number")
    return places.select("project", "number", F.upper("severity").alias("severity"), F.substring(F.coalesce("category", F.lit("")), 1, 15).alias("category"), place.alias("place"), short("title", 50).alias("title"))


def filter_findings(findings: DataFrame, severity: str | None = None, status: str | None = None) -> DataFrame:
    """Findings of a severity and status where given; without a status, rejected ones are dropped."""
    if severity:
        findings = findings.where(F.upper("severity") == severity.upper())
    return findings.where(F.col("status") == status) if status else findings.where(F.coalesce("status", F.lit("")) != "rejected")


def finding_quality(findings: DataFrame) -> DataFrame:
    """Names what is wrong with a finding, or null."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    none = lambda c: F.upper(F.coalesce(F.col(c), F.lit("N/A"))).isin("N/A", "")
    problem = choose(
        [
            (blank("module") & blank("function"), "no place"),
            (F.col("module").contains("{}") | F.col("function").contains("{}"), "unfilled name"),
            (none("module") & none("function") & none("title"), "all N/A"),
            (~F.upper("severity").isin(SEVERITIES), "unknown severity"),
            (~F.col("status").isin("confirmed", "rejected", "open", "needs_review", "false_positive"), "unknown status"),
        ]
    )
    return findings.withColumn("problem", problem)


def order_by_severity(findings: DataFrame) -> DataFrame:
    """Worst first, unknown severities last, input order within."""
    return findings.withColumn("severity_rank", severity_rank(F.col("severity"))).orderBy("severity_rank", "seq")


def apply_actions(findings: DataFrame, actions: DataFrame) -> DataFrame:
    """Replays review actions in order: the last confirm or reject, the last new severity, and all notes."""
    order = F.struct("created_at", "seq")
    verdict = F.when(F.col("action_type") == "confirm", "confirmed").when(F.col("action_type") == "reject", "rejected")
    graded = F.col("action_type").isin("upgrade", "downgrade") & F.col("new_severity").isNotNull()
    notes = F.array_sort(F.collect_list(F.when(F.col("action_type") == "add_note", F.struct("created_at", "seq", "reason"))))
    last = actions.groupBy("finding_id").agg(
        F.max_by(verdict, F.when(verdict.isNotNull(), order)).alias("__status"), F.max_by(F.col("new_severity"), F.when(graded, order)).alias("__severity"), notes.alias("__notes")
    )
    rows = findings.join(last, "finding_id", "left")
    return rows.withColumns({"status": F.coalesce("__status", "status"), "severity": F.coalesce("__severity", "severity"), "notes": F.coalesce(F.transform("__notes", lambda n: n["reason"]), F.array().cast("array<string>"))}).drop("__status", "__severity", "__notes")


def review_timeline(actions: DataFrame) -> DataFrame:
    """From and to of each review action of a finding: severities for up- and downgrades, else statuses."""
    before = Window.partitionBy("finding_id").orderBy("created_at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    graded = F.col("action_type").isin("upgrade", "downgrade")
    verdict = F.when(F.col("action_type") == "confirm", "confirmed").when(F.col("action_type") == "reject", "rejected")
    severity, status = F.last(F.when(graded, F.col("new_severity")), True).over(before), F.last(verdict, True).over(before)
    return actions.withColumns({"from_value": F.when(graded, severity).otherwise(status), "to_value": F.when(graded, F.col("new_severity")).otherwise(F.coalesce(verdict, status))})


def upsert_marks(marks: DataFrame, changes: DataFrame, allowed: tuple[str, ...] = ("issue", "not_issue", "legacy")) -> DataFrame:
    """The last mark of each finding of a report; changes of an unknown type are ignored."""
    every = marks.unionByName(changes.where(F.col("mark_type").isin(*allowed)))
    return first_per_group(every, ["report_id", "finding_id"], [F.desc("updated_at"), F.desc("seq")])


def findings_with_marks(findings: DataFrame, marks: DataFrame) -> DataFrame:
    return findings.join(marks.select("report_id", "finding_id", "mark_type"), ["report_id", "finding_id"], "left")


def mark_stats(findings: DataFrame, marks: DataFrame) -> DataFrame:
    """Marks of each report by type, and findings without a mark."""
    rows = findings_with_marks(findings, marks)
    return rows.groupBy("report_id").agg(*[F.count_if(F.col("mark_type") == t).alias(t) for t in ("issue", "not_issue", "legacy")], F.count_if(F.col("mark_type").isNull()).alias("unmarked"))


def add_findings(findings: DataFrame, manual: DataFrame) -> DataFrame:
    """Findings and those added by hand, which are confirmed."""
    return findings.withColumn("source", F.lit("scan")).unionByName(manual.withColumns({"status": F.lit("confirmed"), "source": F.lit("manual_review")}), allowMissingColumns=True)


def session_list(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with their number of messages, newest first within a report."""
    counts = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"))
    rows = sessions.join(counts, "session_id", "left").withColumn("messages", F.coalesce("messages", F.lit(0)))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("report_id").orderBy(F.desc("created_at"), F.desc("session_id"))))


def message_tail(messages: DataFrame, n: int = 20) -> DataFrame:
    """The last n messages of each session, in order."""
    last = topk_per_group(messages, ["session_id"], [F.desc("seq")], n)
    return last.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("history"))


def rule_trigger_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("rule_id").agg(F.count(F.lit(1)).alias("triggers"), F.max("created_at").alias("last_hit"))


def rule_stats(rules: DataFrame, triggers: DataFrame | None = None) -> DataFrame:
    """Rules by category: all, enabled, disabled, and the sum of their `triggers` (rule_id, triggers) where given."""
    counts = [F.count(F.lit(1)).alias("rules"), F.count_if("is_enabled").alias("enabled"), F.count_if(~F.col("is_enabled")).alias("disabled")]
    if triggers is None:
        return rules.groupBy("category").agg(*counts)
    met = rules.join(triggers.select("rule_id", "triggers"), "rule_id", "left")
    return met.groupBy("category").agg(*counts, F.coalesce(F.sum("triggers"), F.lit(0)).alias("triggers"))


def list_rules(rules: DataFrame, chain: str | None = None, category: str | None = None, enabled: bool | None = None) -> DataFrame:
    for column, value in (("blockchain", chain), ("category", category), ("is_enabled", enabled)):
        rules = rules if value is None else rules.where(F.col(column) == value)
    return rules.orderBy("priority", "rule_id")


def list_exclusions(rules: DataFrame, owner: str, project: str, chain: str) -> DataFrame:
    """Rules of an owner for a project and chain; those without a project or chain hold for all."""
    either = lambda c, v: F.col(c).isNull() | (F.col(c) == v)
    return rules.where((F.col("owner_id") == owner) & either("project_id", project) & either("blockchain", chain))


def matches_to_findings(matches: DataFrame) -> DataFrame:
    """Pattern matches as findings, named by their pattern: cues as the description, line hints kept, the first as the line."""
    hints = F.coalesce("line_hints", F.array().cast("array<int>")) if "line_hints" in matches.columns else F.array().cast("array<int>")
    return matches.select(F.col("pattern_id").alias("finding_id"), "doc_id", "title", F.upper("severity").alias("severity"), (F.col("confidence") * 100).cast("int").alias("confidence"), F.concat_ws(", ", "matched_cues").alias("description"), hints.alias("line_hints"), F.get(hints, F.lit(0)).cast("string").alias("line"))


def write_report_tables(findings: DataFrame, path: str) -> None:
    """Findings, statistics and severities of each project, as tables partitioned by project."""
    part = F.pmod(F.xxhash64(*findings.columns), F.lit(16))  # a project that holds most rows is written by 16 tasks
    findings.repartition("project", part).write.partitionBy("project").parquet(f"{path}/findings")
    audit_statistics(findings).write.parquet(f"{path}/summary")
    severity_histogram(findings, "project").write.parquet(f"{path}/severities")


