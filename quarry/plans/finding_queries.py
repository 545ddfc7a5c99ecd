"""Queries on findings (from `lineitem`), review actions (from `events`) and rules (from `part`)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.columns import VULN_WORDS, topk_per_group
from quarry.operators import findings as op
from quarry.operators import scan
from quarry.operators.context import pattern_line_hints
from quarry.plans.scan_queries import PROSE, SQL_HINTS, docs, sql_matches
from quarry.plans.stand_ins import oracle, table, view


def hinted(s, d):
    """Matches of the prose patterns with the lines of their hits."""
    matches = scan.match_patterns(docs(s, d), PROSE)
    hints = pattern_line_hints(matches, docs(s, d), {p.pattern_id: p.regex for p in PROSE})
    return matches.join(hints.withColumnRenamed("hints", "line_hints"), ["doc_id", "pattern_id"])


def found(spark, sf):
    return view(spark, sf, "findings")


def sql_type(text, category):
    cases = " ".join(f"WHEN {' OR '.join(f'contains({text}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in VULN_WORDS.items())
    return f"CASE {cases} WHEN coalesce({category}, '') <> '' THEN lower({category}) ELSE 'other' END"


TYPED = f"""
    SELECT *, trim(split_part(coalesce(line, ''), '-', 1)) AS line_key,
           {sql_type("lower(concat_ws(' ', title, description, coalesce(category, '')))", 'category')} AS vuln_type FROM findings"""
DEDUPED = "SELECT * FROM typed QUALIFY row_number() OVER (PARTITION BY module, function, line_key, vuln_type ORDER BY confidence DESC, seq) = 1"
VERDICT = """SELECT finding_id, CASE quantity % 5 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'false_positive' WHEN 2 THEN 'confirmed' ELSE 'unsure' END AS conclusion,
    confidence AS confidence, CASE WHEN quantity % 2 = 0 THEN 'Low' END AS final_severity, seq FROM findings WHERE quantity % 7 <> 3"""
EXPLOIT = """SELECT seq, project, quantity % 2 = 0 AS exploitable, CASE confidence % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN 'theoretical' ELSE 'verified' END AS sureness,
    CAST(seq % 11 AS INT) AS score, CAST(seq % 8 AS INT) AS path_steps, CASE seq % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'admin' WHEN 2 THEN 'specific_address' ELSE 'anyone' END AS caller,
    CAST(seq % 3 AS INT) AS hard_conditions, CAST(seq % 2 AS INT) AS unrealistic_conditions, CASE WHEN seq % 6 = 0 THEN 'unknown' ELSE 'drain' END AS goal, seq % 13 = 0 AS chained FROM findings"""
MARKS = """SELECT DISTINCT report_id, finding_id, CASE WHEN quantity % 4 = 0 THEN 'issue' WHEN quantity % 4 = 1 THEN 'not_issue' WHEN quantity % 4 = 2 THEN 'legacy' ELSE 'odd' END AS mark_type, created_at AS updated_at, seq FROM findings"""
RAW = """SELECT seq, CASE WHEN seq % 17 = 0 THEN 'broken {{' ELSE concat('{{"finding_id":"', finding_id, '","status":"', status, '"', CASE WHEN quantity % 3 = 0 THEN ',"final_severity":"low"' ELSE '' END,
    ',"original_finding":{{"title":"', title, '","severity":"', severity, '","location":{{"module":"', module, '","function":"', function, '"}}}},"code":"c","notes":["a","b"]}}') END AS raw FROM findings"""


def on_findings(sql):
    return lambda spark, sf: spark.sql(sql.replace("FROM findings", "FROM {findings}"), findings=found(spark, sf))


verdicts, exploits, marks, raws = (on_findings(x) for x in (VERDICT, EXPLOIT, MARKS, RAW))


def mark_changes(s, d):
    rows = marks(s, d)
    return rows.where("mark_type = 'issue'"), rows.where("mark_type <> 'issue'")


def latest_marks(s, d):
    return op.upsert_marks(*mark_changes(s, d))


def full(s, d, mode="full"):
    rows = verdicts(s, d).dropDuplicates(["finding_id"])
    return op.final_status(found(s, d), rows.drop("seq"), mode)


#: What the look-ups say of the types that findings get here by their number: parties, loss, first words of the gain, usual entry, impact.
LOOKED_UP = [
    ("overflow", "流动性提供者, 协议用户", "池子余额", "攻击者可以通过溢", "deposit, mint, swap, calculate, add_liquidity", "获得超额代币或份额"),
    ("access_control", "所有用户, 协议资金", "协议全部 TVL", "攻击者可以执行本", "withdraw_all, set_fee, pause, mint, burn", "执行管理员操作，提取资金"),
    ("capability_leak", "所有用户, 协议资金", "协议全部 TVL", "任何人都可以获取", "init 函数或任何 Capability 创建点", "任何人获得管理员权限"),
    ("oracle_manipulation", "流动性提供者, 协议用户", "池子余额", "攻击者可以操纵价", "swap, borrow, liquidate, get_price", "套利或恶意清算"),
    ("precision_loss", "后续存款用户", "后续存款的全部金额", "攻击者可以窃取其", "deposit, redeem, calculate_shares", "窃取后续存款"),
    ("slippage", "单次交易用户", "交易金额的滑点损失", "攻击者可以通过三", "swap, remove_liquidity", "提取交易滑点利润"),
    ("flash_loan", "待确定", "待评估", "攻击者可以利用此", "borrow, flash_loan, flashloan", "借款不还或用低价值代币偿还高价值借款"),
    ("type_confusion", "待确定", "待评估", "攻击者可以利用此", "repay, redeem, withdraw, swap", "用低价值资产换取高价值资产"),
    ("resource_leak", "待确定", "待评估", "用户资产可能被永", "process, handle, execute", "资产永久丢失"),
    ("unheard of", "待确定", "待评估", "攻击者可以利用此", "unknown", "需要评估具体影响"),
]


def typed_by_number(s, d):
    names = F.array(*[F.lit(x[0]) for x in LOOKED_UP])
    return found(s, d).withColumn("category", F.element_at(names, F.pmod("seq", F.lit(len(LOOKED_UP))).cast("int") + 1))


def looked_up_sql(*places):
    names = {0: "category", 1: "parties", 2: "max_loss", 3: "gain", 4: "entry_hint", 5: "impact_hint"}
    columns = ", ".join(f"CASE seq % {len(LOOKED_UP)} {' '.join(f'WHEN {i} THEN {chr(39)}{x[k]}{chr(39)}' for i, x in enumerate(LOOKED_UP))} END AS {names[k]}" for k in places)
    return oracle(f"SELECT {', '.join(names[k] for k in places)}, count(*) AS count FROM (SELECT {columns} FROM findings) GROUP BY ALL")


LATEST = "SELECT * FROM (SELECT * FROM marks WHERE mark_type <> 'odd') QUALIFY row_number() OVER (PARTITION BY report_id, finding_id ORDER BY updated_at DESC, seq DESC) = 1"
FINAL = """SELECT f.*, CASE WHEN coalesce(v.conclusion, 'needs_review') IN ('needs_review', 'confirmed') THEN 'confirmed' WHEN v.conclusion = 'false_positive' THEN 'false_positive' ELSE 'needs_review' END AS final_status,
    CASE WHEN coalesce(v.conclusion, 'needs_review') = 'needs_review' THEN greatest(coalesce(v.confidence, 50), 60) ELSE coalesce(v.confidence, 50) END AS final_confidence,
    CASE WHEN v.conclusion = 'false_positive' THEN 'none' ELSE lower(coalesce(v.final_severity, f.severity, 'medium')) END AS final_severity FROM findings f LEFT JOIN verdicts v USING (finding_id)"""


def withs(main, **parts):
    return oracle(f"WITH {', '.join(f'{n} AS ({q})' for n, q in parts.items())} {main}")


SEV = "CASE upper(severity) WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'ADVISORY' THEN 4 ELSE 99 END"
STATS = """SELECT project, count(*) AS total, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'false_positive') AS false_positive, count(*) FILTER (status = 'needs_review') AS needs_review,
    round(count(*) FILTER (status = 'false_positive') / count(*), 4) AS fp_rate, round(avg(confidence), 4) AS mean_confidence,
    """ + ", ".join(f"count(*) FILTER (status = 'confirmed' AND lower(severity) = '{s}') AS {s}" for s in ("critical", "high", "medium", "low")) + " FROM findings GROUP BY project"  # fmt: skip
MESSAGES = "SELECT conv_id AS session_id, turn AS seq, role, text AS content, conv_id % 7 AS report_id FROM {conversations}"


def messages(s, d):
    return s.sql(MESSAGES, conversations=table(s, d, "conversations"))


def sessions(s, d):
    return s.sql("SELECT c_custkey AS session_id, c_nationkey AS report_id, c_acctbal AS created_at FROM {customer}", customer=table(s, d, "customer"))


def history(s, d):
    rows = op.message_tail(messages(s, d).select("session_id", "seq", "role", "content"), 3)
    return rows.select("session_id", F.size("history").alias("n"), F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(":"), F.length(m["content"]).cast("string"))), "|").alias("digest"))


def replayed(s, d):
    base = table(s, d, "events").select(F.concat(F.lit("f"), F.col("user_id")).alias("finding_id")).distinct().withColumns({"status": F.lit("open"), "severity": F.lit("MEDIUM")})
    return op.apply_actions(base, view(s, d, "actions")).select("finding_id", "status", "severity", F.size("notes").alias("notes"))


QUERIES = {
    "o1_parse_findings": lambda s, d: op.parse_findings(raws(s, d)),
    "o2_vuln_type": lambda s, d: op.with_vuln_type(found(s, d)).groupBy("vuln_type").count(),
    "o3_line_start": lambda s, d: op.with_vuln_type(found(s, d)).groupBy("line_key").count(),
    "o4_dedupe_findings": lambda s, d: op.dedupe_findings(found(s, d)).select("finding_id", "line_key", "vuln_type", "confidence", "seq"),
    "o5_min_confidence": lambda s, d: op.min_confidence(found(s, d)).select("finding_id", "confidence", "seq"),
    "o9_rule_trigger_counts": lambda s, d: op.rule_trigger_counts(table(s, d, "events").selectExpr("event_id % 74 AS rule_id", "ts AS created_at")).withColumn("last_hit", F.date_format("last_hit", "yyyy-MM-dd HH:mm:ss")),
    "o10_rule_stats": lambda s, d: op.rule_stats(view(s, d, "rules"), op.rule_trigger_counts(table(s, d, "events").selectExpr("event_id % 74 AS rule_id", "ts AS created_at"))),
    "o27_matches_to_findings": lambda s, d: op.matches_to_findings(hinted(s, d)).withColumn("line_hints", F.array_join("line_hints", ",")),
    "o12_scan_batches": lambda s, d: op.scan_batches(view(s, d, "functions")).select("func_id", "batch"),
    "o13_group_findings": lambda s, d: op.group_findings(found(s, d)).select("finding_id", "seq", "group"),
    "o14_final_status": lambda s, d: full(s, d).select("finding_id", "seq", "final_status", "final_confidence", "final_severity"),
    "o14_final_status_quick": lambda s, d: full(s, d, "quick").select("finding_id", "seq", "final_status"),
    "o15_union_early_filtered": lambda s, d: op.union_early_filtered(full(s, d).where("quantity % 2 = 0"), found(s, d).where("quantity % 2 = 1")).select("finding_id", "seq", "final_status", "final_confidence", "final_severity"),
    "o16_exploit_candidates": lambda s, d: op.exploit_candidates(full(s, d)).select("finding_id", "seq", "vuln_type"),
    "o17_exploit_status": lambda s, d: op.exploit_status(exploits(s, d)).groupBy("exploit_status", "sureness_points").count(),
    "o18_exploitability": lambda s, d: op.exploitability(exploits(s, d)).select("seq", "exploitability"),
    "o19_is_real": lambda s, d: op.is_real(exploits(s, d)).select("seq", "project"),
    "o20_impact_by_type": lambda s, d: op.impact_by_type(typed_by_number(s, d)).groupBy("category", "parties", "max_loss", F.substring("gain", 1, 8).alias("gain")).count(),
    "o21_concat_phases": lambda s, d: op.concat_phases(found(s, d).where("flag = 'O'").select("finding_id", "project"), found(s, d).where("flag = 'F'").select("finding_id", "module")).groupBy("phase", "project", "module").count(),
    "o23_finding_function": lambda s, d: op.finding_function(found(s, d).withColumns({"path": F.when(F.col("seq") % 2 == 0, F.concat_ws("::", "module", "function")), "function": F.when(F.col("seq") % 3 == 0, F.concat("function", F.lit("<T>")))})).select("seq", "finding_id", "function_name"),
    "o24_format_location": lambda s, d: op.format_location(found(s, d).withColumn("file", F.lit("a.move"))).select("seq", "finding_id", "location"),
    "o25_status_reasons": lambda s, d: op.status_reasons(full(s, d).withColumns({"rule_reason": F.when(F.col("quantity") % 3 == 0, F.lit("rule")), "verdict_reason": F.when(F.col("quantity") % 2 == 0, F.lit("External call")), "recommendation": F.col("description"), "parse_error": F.col("quantity") % 5 == 3, "rounds_differ": F.col("quantity") % 4 == 0})).select("seq", "finding_id", "false_positive_reason", F.array_join("review_reasons", "; ").alias("review_reasons")),
    "o27_split_by_status": lambda s, d: op.split_by_status(exploits(s, d)).withColumn("verification_rate", F.round("verification_rate", 6)),
    "o28_exploit_hints": lambda s, d: op.exploit_hints(typed_by_number(s, d)).groupBy("category", "entry_hint", "impact_hint").count(),
    "a7_audit_statistics": lambda s, d: op.audit_statistics(found(s, d)),
    "a8_exploit_statistics": lambda s, d: op.exploit_statistics(op.exploit_status(exploits(s, d))),
    "a9_risk_score_10": lambda s, d: op.risk_score_10(op.audit_statistics(found(s, d), "report_id")).select("report_id", "risk_score", "risk_level"),
    "a10_risk_score_100": lambda s, d: op.risk_score_100(op.severity_histogram(found(s, d), "finding_id")).select("finding_id", "risk_score"),
    "a12_severity_histogram": lambda s, d: op.severity_histogram(found(s, d), rejected="false_positive"),
    "a13_mark_stats": lambda s, d: op.mark_stats(found(s, d), latest_marks(s, d)),
    "a21_functions_with_findings": lambda s, d: op.functions_with_findings(found(s, d)).select("module", "functions", F.array_join("names", ",").alias("names")),
    "a23_finding_index": lambda s, d: op.finding_index(found(s, d)),
    "p9_filter_findings": lambda s, d: op.filter_findings(found(s, d), "high").select("finding_id", "seq"),
    "p11_list_rules": lambda s, d: op.list_rules(view(s, d, "rules"), None, "SMALL", True).select("rule_id", "priority"),
    "p12_list_exclusions": lambda s, d: op.list_exclusions(view(s, d, "rules"), "o1", "u6", "Brand#2").select("rule_id"),
    "q4_finding_quality": lambda s, d: op.finding_quality(found(s, d).withColumn("module", F.when(F.col("quantity") % 5 == 0, F.lit("{}")).otherwise(F.col("module")))).groupBy("problem").count(),
    "l1_order_by_severity": lambda s, d: op.order_by_severity(found(s, d)).select("finding_id", "seq", "severity_rank"),
    "l2_topk_per_group": lambda s, d: topk_per_group(found(s, d), ["project"], [F.desc("confidence"), F.asc("seq")], 10, "rank").select("project", "finding_id", "rank"),
    "r1_apply_actions": replayed,
    "r2_upsert_marks": lambda s, d: latest_marks(s, d).select("report_id", "finding_id", "mark_type"),
    "r3_add_findings": lambda s, d: op.severity_histogram(op.add_findings(found(s, d).where("flag = 'O'"), found(s, d).where("flag = 'F'").drop("status")), "source"),
    "r4_session_list": lambda s, d: op.session_list(sessions(s, d), messages(s, d)).select("session_id", "messages", "position"),
    "r5_message_tail": history,
    "w2_review_timeline": lambda s, d: op.review_timeline(view(s, d, "actions")).select("seq", "from_value", "to_value"),
    "j20_findings_with_marks": lambda s, d: op.findings_with_marks(found(s, d), latest_marks(s, d)).select("finding_id", "seq", "mark_type"),
}

VERDICTS_ONE = f"SELECT * FROM ({VERDICT}) QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY seq) = 1"
EXP = "SELECT *, CASE sureness WHEN 'high' THEN 85 WHEN 'medium' THEN 60 WHEN 'low' THEN 35 WHEN 'theoretical' THEN 15 ELSE 50 END AS sureness_points FROM exploits"
EXP_STATUS = """CASE WHEN exploitable AND sureness_points >= 80 AND score >= 7 THEN 'verified' WHEN exploitable AND sureness_points >= 60 AND score >= 5 THEN 'likely' WHEN exploitable AND score >= 4 THEN 'needs_review'
    WHEN NOT exploitable AND sureness_points >= 80 AND score <= 2 THEN 'false_positive' WHEN NOT exploitable AND sureness_points >= 80 THEN 'theoretical' ELSE 'needs_review' END"""
REAL = "sureness IN ('verified', 'high') AND score >= 6 AND path_steps > 0"
HIST = ", ".join(f"count(*) FILTER (upper(severity) = '{s.upper()}') AS {s}" for s in ("critical", "high", "medium", "low", "advisory"))

ORACLES = {
    "o1_parse_findings": oracle("""SELECT seq, CASE WHEN seq % 17 <> 0 THEN finding_id END AS finding_id, CASE WHEN seq % 17 = 0 THEN 'open' WHEN status = 'confirmed' THEN 'confirmed' WHEN status = 'false_positive' THEN 'rejected' ELSE 'open' END AS status,
        CASE WHEN seq % 17 = 0 THEN 'MEDIUM' WHEN quantity % 3 = 0 THEN 'LOW' WHEN severity = 'bogus' THEN 'MEDIUM' ELSE upper(severity) END AS severity, CASE WHEN seq % 17 = 0 THEN '' ELSE title END AS title,
        CASE WHEN seq % 17 = 0 THEN '' ELSE concat('a', chr(10), 'b') END AS description, CASE WHEN seq % 17 = 0 THEN '' ELSE concat(module, '::', function) END AS location, CASE WHEN seq % 17 <> 0 THEN 'c' END AS code FROM findings"""),
    "o2_vuln_type": withs("SELECT vuln_type, count(*) AS count FROM typed GROUP BY ALL", typed=TYPED),
    "o3_line_start": withs("SELECT line_key, count(*) AS count FROM typed GROUP BY ALL", typed=TYPED),
    "o4_dedupe_findings": withs("SELECT finding_id, line_key, vuln_type, confidence, seq FROM d", typed=TYPED, d=DEDUPED),
    "o5_min_confidence": withs("SELECT finding_id, confidence, seq FROM d WHERE confidence >= 30", typed=TYPED, d=DEDUPED),
    "o9_rule_trigger_counts": "SELECT event_id % 74 AS rule_id, count(*) AS triggers, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_hit FROM events GROUP BY ALL",
    "o10_rule_stats": oracle("SELECT category, count(*) AS rules, count(*) FILTER (is_enabled) AS enabled, count(*) FILTER (NOT is_enabled) AS disabled, CAST(coalesce(sum(n), 0) AS BIGINT) AS triggers FROM rules LEFT JOIN (SELECT event_id % 74 AS r, count(*) AS n FROM events GROUP BY ALL) ON r = rule_id GROUP BY category"),
    "o27_matches_to_findings": f"""WITH m AS ({sql_matches(PROSE, "documents")}), {SQL_HINTS.replace("FROM d)", "FROM documents)")}
        SELECT pattern_id AS finding_id, doc_id, title, upper(severity) AS severity, CAST(floor(confidence * 100) AS INT) AS confidence, replace(cues, '|', ', ') AS description, coalesce(hints, '') AS line_hints, nullif(split_part(coalesce(hints, ''), ',', 1), '') AS line
        FROM m LEFT JOIN h USING (doc_id, pattern_id)""",
    "o12_scan_batches": oracle("SELECT func_id, CAST((row_number() OVER (PARTITION BY module ORDER BY risk_score DESC, seq) - 1) // 5 + 1 AS INT) AS batch FROM functions"),
    "o13_group_findings": oracle('SELECT finding_id, seq, CAST((row_number() OVER (PARTITION BY module ORDER BY seq) - 1) // 5 + 1 AS INT) AS "group" FROM findings'),
    "o14_final_status": withs("SELECT finding_id, seq, final_status, final_confidence, final_severity FROM final", verdicts=VERDICTS_ONE, final=FINAL),
    "o14_final_status_quick": withs("SELECT f.finding_id, f.seq, CASE WHEN v.conclusion IS NULL OR v.conclusion = 'confirmed' THEN 'confirmed' WHEN v.conclusion = 'false_positive' THEN 'false_positive' ELSE 'needs_review' END AS final_status FROM findings f LEFT JOIN verdicts v USING (finding_id)", verdicts=VERDICTS_ONE),
    "o15_union_early_filtered": withs("SELECT finding_id, seq, final_status, final_confidence, final_severity FROM final WHERE quantity % 2 = 0 UNION ALL SELECT finding_id, seq, 'false_positive', 95, lower(severity) FROM findings WHERE quantity % 2 = 1", verdicts=VERDICTS_ONE, final=FINAL),
    "o16_exploit_candidates": withs("SELECT finding_id, seq, vuln_type FROM d", verdicts=VERDICTS_ONE, final=FINAL, w="SELECT * FROM final WHERE final_status = 'confirmed' AND final_severity IN ('critical', 'high') OR final_status = 'needs_review' AND final_severity IN ('critical', 'high', 'medium')", typed=TYPED.replace("FROM findings", "FROM w"), d=DEDUPED),
    "o17_exploit_status": withs(f"SELECT {EXP_STATUS} AS exploit_status, sureness_points, count(*) AS count FROM e GROUP BY ALL", exploits=EXPLOIT, e=EXP),
    "o18_exploitability": withs("""SELECT seq, greatest(0.0, least(10.0, 10.0 - CASE caller WHEN 'unknown' THEN 4.0 WHEN 'admin' THEN 3.0 WHEN 'specific_address' THEN 2.0 ELSE 0.0 END - CASE WHEN path_steps = 0 THEN 5.0 WHEN path_steps > 5 THEN 1.0 ELSE 0.0 END
        - 0.5 * hard_conditions - 2.0 * unrealistic_conditions - CASE goal WHEN 'unknown' THEN 2.0 ELSE 0.0 END))::DOUBLE AS exploitability FROM exploits""", exploits=EXPLOIT),
    "o19_is_real": withs(f"SELECT seq, project FROM exploits WHERE {REAL}", exploits=EXPLOIT),
    "o20_impact_by_type": looked_up_sql(0, 1, 2, 3),
    "o21_concat_phases": oracle("SELECT 'batch' AS phase, project, NULL AS module, count(*) AS count FROM findings WHERE flag = 'O' GROUP BY ALL UNION ALL SELECT 'cross_function', NULL, module, count(*) FROM findings WHERE flag = 'F' GROUP BY ALL"),
    "o23_finding_function": oracle("SELECT seq, finding_id, CASE WHEN seq % 3 = 0 OR seq % 2 = 0 THEN function ELSE '' END AS function_name FROM findings"),
    "o24_format_location": oracle("SELECT seq, finding_id, concat_ws(':', concat_ws('::', module, function), split_part(line, '-', 1)) AS location FROM findings"),
    "o25_status_reasons": withs("""SELECT seq, finding_id, CASE WHEN final_status = 'false_positive' THEN CASE WHEN quantity % 3 = 0 THEN 'rule' WHEN quantity % 2 = 0 THEN 'External call' ELSE description[1:100] END END AS false_positive_reason,
        CASE WHEN final_status = 'needs_review' THEN concat_ws('; ', CASE WHEN quantity % 5 = 3 THEN 'verdict not readable' END, CASE WHEN final_confidence < 50 THEN 'low confidence' END, CASE WHEN quantity % 4 = 0 THEN 'verdicts differ' END, CASE WHEN quantity % 2 = 0 THEN 'depends on other code' END) END AS review_reasons FROM final""", verdicts=VERDICTS_ONE, final=FINAL),
    "o27_split_by_status": withs(f"SELECT project, count(*) AS n, count(*) FILTER ({REAL}) AS verified, count(*) FILTER (NOT ({REAL}) AND sureness = 'theoretical') AS theoretical, count(*) FILTER (NOT ({REAL}) AND sureness <> 'theoretical') AS needs_review, round(count(*) FILTER ({REAL}) / count(*), 6) AS verification_rate FROM exploits GROUP BY project", exploits=EXPLOIT),
    "o28_exploit_hints": looked_up_sql(0, 4, 5),
    "a7_audit_statistics": oracle(STATS),
    "a8_exploit_statistics": withs("SELECT project, " + ", ".join(f"count(*) FILTER (st = '{x}') AS {x}" for x in ("verified", "likely", "theoretical", "needs_review", "false_positive")) + f", count(*) FILTER (chained) AS chains FROM (SELECT *, {EXP_STATUS} AS st FROM e) GROUP BY project", exploits=EXPLOIT, e=EXP),
    "a9_risk_score_10": withs("""SELECT report_id, score AS risk_score, CASE WHEN score >= 8 THEN 'critical' WHEN score >= 6 THEN 'high' WHEN score >= 4 THEN 'medium' WHEN score >= 2 THEN 'low' ELSE 'minimal' END AS risk_level FROM
        (SELECT report_id, least(10.0, round_even(least(4.0 * critical, 10.0) + least(2.0 * high, 6.0) + least(1.0 * medium, 3.0) + least(0.5 * low, 1.0), 1))::DOUBLE AS score FROM stats)""", stats=STATS.replace("project", "report_id")),
    "a10_risk_score_100": withs("SELECT finding_id, CAST(least(100, 40 * critical + 25 * high + 15 * medium + 8 * low + 4 * advisory) AS BIGINT) AS risk_score FROM h", h=f"SELECT finding_id, {HIST} FROM findings GROUP BY finding_id"),
    "a12_severity_histogram": oracle(f"SELECT report_id, {HIST} FROM findings WHERE status <> 'false_positive' GROUP BY report_id"),
    "a13_mark_stats": withs("SELECT report_id, count(*) FILTER (mark_type = 'issue') AS issue, count(*) FILTER (mark_type = 'not_issue') AS not_issue, count(*) FILTER (mark_type = 'legacy') AS legacy, count(*) FILTER (mark_type IS NULL) AS unmarked FROM findings LEFT JOIN (SELECT report_id, finding_id, mark_type FROM latest) USING (report_id, finding_id) GROUP BY report_id", marks=MARKS, latest=LATEST),
    "a21_functions_with_findings": oracle("SELECT module, count(DISTINCT function) AS functions, array_to_string(list_sort(list(DISTINCT function)), ',') AS names FROM findings GROUP BY module"),
    "a23_finding_index": oracle(f"SELECT project, CAST(row_number() OVER (PARTITION BY project ORDER BY {SEV}, seq) AS INT) AS number, upper(severity) AS severity, coalesce(category, '')[1:15] AS category, concat(module, '::', function) AS place, title FROM findings WHERE status = 'confirmed'"),
    "p9_filter_findings": oracle("SELECT finding_id, seq FROM findings WHERE upper(severity) = 'HIGH'"),
    "p11_list_rules": oracle("SELECT rule_id, priority FROM rules WHERE category = 'SMALL' AND is_enabled"),
    "p12_list_exclusions": oracle("SELECT rule_id FROM rules WHERE owner_id = 'o1' AND coalesce(project_id, 'u6') = 'u6' AND coalesce(blockchain, 'Brand#2') = 'Brand#2'"),
    "q4_finding_quality": oracle("SELECT CASE WHEN quantity % 5 = 0 THEN 'unfilled name' WHEN severity = 'bogus' THEN 'unknown severity' END AS problem, count(*) AS count FROM findings GROUP BY ALL"),
    "l1_order_by_severity": oracle(f"SELECT finding_id, seq, {SEV} AS severity_rank FROM findings"),
    "l2_topk_per_group": oracle("SELECT project, finding_id, CAST(row_number() OVER (PARTITION BY project ORDER BY confidence DESC, seq) AS INT) AS rank FROM findings QUALIFY rank <= 10"),
    "r1_apply_actions": oracle("""SELECT finding_id, coalesce(max_by(CASE action_type WHEN 'confirm' THEN 'confirmed' ELSE 'rejected' END, seq) FILTER (action_type IN ('confirm', 'reject')), 'open') AS status,
        coalesce(max_by(new_severity, seq) FILTER (new_severity IS NOT NULL), 'MEDIUM') AS severity, CAST(count(*) FILTER (action_type = 'add_note') AS INT) AS notes FROM (SELECT * REPLACE (row_number() OVER (ORDER BY created_at, seq) AS seq) FROM actions) GROUP BY finding_id"""),
    "r2_upsert_marks": withs("SELECT report_id, finding_id, mark_type FROM latest", marks=MARKS, latest=LATEST),
    "r3_add_findings": oracle(f"SELECT CASE flag WHEN 'O' THEN 'scan' ELSE 'manual_review' END AS source, {HIST} FROM findings GROUP BY flag"),
    "r4_session_list": "SELECT c_custkey AS session_id, (SELECT count(*) FROM conversations WHERE conv_id = c_custkey) AS messages, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey DESC) AS INT) AS position FROM customer",
    "r5_message_tail": """SELECT conv_id AS session_id, CAST(count(*) AS INT) AS n, string_agg(concat(role, ':', length(text)), '|' ORDER BY turn) AS digest FROM
        (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) GROUP BY conv_id""",
    "w2_review_timeline": oracle("""SELECT seq, CASE WHEN graded THEN last_value(sev IGNORE NULLS) OVER b ELSE last_value(verdict IGNORE NULLS) OVER b END AS from_value,
        CASE WHEN graded THEN new_severity ELSE coalesce(verdict, last_value(verdict IGNORE NULLS) OVER b) END AS to_value FROM
        (SELECT *, action_type IN ('upgrade', 'downgrade') AS graded, new_severity AS sev, CASE action_type WHEN 'confirm' THEN 'confirmed' WHEN 'reject' THEN 'rejected' END AS verdict FROM actions)
        WINDOW b AS (PARTITION BY finding_id ORDER BY created_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
    "j20_findings_with_marks": withs("SELECT finding_id, seq, mark_type FROM findings LEFT JOIN (SELECT report_id, finding_id, mark_type FROM latest) USING (report_id, finding_id)", marks=MARKS, latest=LATEST),
}
