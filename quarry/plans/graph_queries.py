"""Queries on the call graph (functions are supplier and part of a line, calls go to the next line) and on audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.exploit_data import TYPICAL_ENTRIES
from quarry.operators import graph as op
from quarry.plans.stand_ins import VIEWS, by_keys, oracle, table, view


def of(*names):
    return lambda s, d: [view(s, d, n) for n in names]


F_E, F_ONLY, E_ONLY = of("functions", "edges"), of("functions"), of("edges")
TYPES = "SELECT DISTINCT concat('m', l_suppkey) AS module, l_linenumber AS type_id FROM lineitem"


def types(s, d):
    from quarry.plans.stand_ins import table

    return table(s, d, "lineitem").selectExpr("concat('m', l_suppkey) AS module", "l_linenumber AS type_id").distinct()


def seeds(s, d):
    return view(s, d, "functions").where("risk_score = 100").select(F.col("func_id").alias("seed"))


def pairs(s, d):
    return view(s, d, "edges").selectExpr("to_id AS target", "from_id AS neighbor").union(view(s, d, "edges").selectExpr("from_id", "from_id"))


def aliases(s, d):
    return view(s, d, "functions").where("risk_score < 30").selectExpr("concat('0x1::', module) AS from_module", "name AS local", "concat('0x9::lib::', name) AS full")


def resolved(s, d):
    calls, functions = view(s, d, "calls"), view(s, d, "functions")
    return op.resolve_edges(calls, functions)


def requests(s, d):
    return view(s, d, "calls").select(F.col("raw_call").alias("request")).distinct()


def reports(s, d):
    return view(s, d, "audits").where("status = 'completed'").selectExpr("concat('r', seq) AS report_id", "id AS audit_id", "seq", "seq % 3 AS critical", "seq % 5 AS high", "seq % 7 AS medium", "seq % 11 AS low")


def internal_external(s, d):
    # sets of calls come out: that the view's calls are distinct need not be seen to first
    calls = by_keys(s, VIEWS["calls"], "lineitem", table(s, d, "lineitem"), [], distinct=True).where("raw_call LIKE '0x1::%' OR raw_call LIKE 'm%'")
    out = op.split_calls(calls, view(s, d, "functions"))
    return out.select("from_id", F.array_join("internal", ",").alias("internal"), F.array_join("external", ",").alias("external"))


def text(df, *columns):
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


#: A finding for each function: its type and the source that it was found in.
ENTERED = """
    SELECT func_id, CASE seq % 4 WHEN 0 THEN 'overflow' WHEN 1 THEN 'flash_loan_non_repayment' WHEN 2 THEN 'slippage' ELSE 'unheard of' END AS category,
           CASE seq % 5 WHEN 0 THEN 'fun swap();' WHEN 1 THEN 'fun calculate(); mint();' WHEN 2 THEN 'fun flash_loan();' WHEN 3 THEN 'fun remove_liquidity(); swap();' END AS source
    FROM {functions}"""

QUERIES = {
    "j2_qualify_calls": lambda s, d: op.qualify_calls(view(s, d, "calls"), aliases(s, d)).select("from_id", "raw_call", "call_line", "call"),
    "j3_resolve_edges": resolved,
    "j4_split_internal_external": internal_external,
    "j5_called_by": lambda s, d: text(op.called_by(*F_E(s, d)), "callers"),
    "j6_graph_roots": lambda s, d: op.graph_roots(*F_E(s, d)).select("func_id"),
    "j6_graph_leaves": lambda s, d: op.graph_leaves(*F_E(s, d)).select("func_id"),
    "j7_cross_module_calls": lambda s, d: op.cross_module_calls(*E_ONLY(s, d)),
    "j8_neighbors": lambda s, d: op.neighbors(view(s, d, "edges"), seeds(s, d), 3),
    "j9_relation": lambda s, d: op.relation(pairs(s, d), view(s, d, "edges")),
    "j10_callers": lambda s, d: op.callers(view(s, d, "edges"), view(s, d, "functions"), 2).select("to_id", "from_id", "name", "visibility", "rank"),
    "j10_callees": lambda s, d: op.callees(view(s, d, "edges"), view(s, d, "functions"), 1).select("to_id", "from_id", "name", "visibility", "rank"),
    "j11_resolve_function_id": lambda s, d: text(op.resolve_function_id(requests(s, d), view(s, d, "functions")), "suggestions"),
    "j15_public_entry_for": lambda s, d: op.public_entry_for(s.sql(ENTERED, functions=view(s, d, "functions")), *F_E(s, d)).select("func_id", "entry_point", "via"),
    "j16_caller_requirement": lambda s, d: op.caller_requirement(view(s, d, "functions").withColumn("body", F.when(F.col("risk_score") % 4 == 0, "x: &AdminCap").when(F.col("risk_score") % 4 == 1, "tx_context::sender(c)").when(F.col("risk_score") % 4 == 2, "{ }"))).select("func_id", "caller"),
    "j17_propagate": lambda s, d: op.propagate(view(s, d, "functions").where("risk_score >= 95"), view(s, d, "edges")),
    "j19_report_listing": lambda s, d: op.report_listing(reports(s, d), view(s, d, "audits"), view(s, d, "projects")).select("report_id", "project_id", "project_name"),
    "j21_has_running_audit": lambda s, d: op.has_running_audit(view(s, d, "projects"), view(s, d, "audits")).select("id"),
    "j21_no_running_audit": lambda s, d: op.has_running_audit(view(s, d, "projects"), view(s, d, "audits"), False).select("id"),
    "j22_latest_audit": lambda s, d: op.latest_audit(view(s, d, "projects"), view(s, d, "audits")),
    "a14_graph_meta": lambda s, d: op.graph_meta(view(s, d, "functions"), types(s, d), view(s, d, "edges")),
    "a15_graph_summary": lambda s, d: text(op.graph_summary(view(s, d, "functions"), types(s, d), view(s, d, "edges")), "entries", "leaves", "risky", "cross_module"),
    "a16_module_call_digest": lambda s, d: text(op.module_call_digest(*F_E(s, d)), "first_calls"),
    "a17_dashboard": lambda s, d: op.dashboard(reports(s, d), view(s, d, "audits"), view(s, d, "projects")),
    "a22_module_summary": lambda s, d: text(op.module_summary(*F_ONLY(s, d)), "risky"),
    "p4_entry_points": lambda s, d: op.entry_points(*F_ONLY(s, d)).select("func_id"),
    "p4_entry_points_loose": lambda s, d: op.entry_points(*F_ONLY(s, d), loose=True).select("func_id"),
    "p5_public_functions": lambda s, d: op.public_functions(*F_ONLY(s, d)).select("func_id"),
    "p6_high_risk": lambda s, d: op.high_risk(*F_ONLY(s, d)).select("func_id", "risk_score"),
    "p8_module_structure": lambda s, d: op.module_structure(view(s, d, "functions"), types(s, d)),
    "p10_list_page": lambda s, d: op.list_page(view(s, d, "audits").where("status = 'completed'"), [F.desc("price"), F.desc("seq")], 20, 50).select("id", "total"),
}

PUBLIC = "(contains(visibility, 'public') OR visibility = 'entry')"
LAST = "(SELECT concat(module, '::', name) AS k, max_by(func_id, seq) AS id FROM functions GROUP BY 1)"
REPORTS = "(SELECT concat('r', seq) AS report_id, * FROM audits WHERE status = 'completed')"
BOTH = "(SELECT from_id AS a, to_id AS b FROM edges UNION SELECT to_id, from_id FROM edges)"

ORACLES = {
    "j2_qualify_calls": oracle("SELECT c.from_id, raw_call, call_line, CASE WHEN contains(raw_call, '::') THEN raw_call WHEN f.func_id IS NOT NULL THEN concat('0x9::lib::', raw_call) ELSE concat(regexp_extract(c.from_id, '^(.*)::[^:]+$', 1), '::', raw_call) END AS call FROM calls c LEFT JOIN functions f ON f.risk_score < 30 AND f.name = raw_call AND concat('0x1::', f.module) = regexp_extract(c.from_id, '^(.*)::[^:]+$', 1)"),
    "j3_resolve_edges": oracle(f"""
        WITH u AS (SELECT name, min(func_id) AS id FROM functions GROUP BY name HAVING count(*) = 1),
        r AS (SELECT c.from_id, call_line, CASE WHEN raw_call LIKE '0x1::%' THEN coalesce(f.func_id, l.id) WHEN contains(raw_call, '::') THEN l.id ELSE coalesce(o.func_id, u.id) END AS to_id FROM calls c
            LEFT JOIN functions f ON f.func_id = raw_call LEFT JOIN {LAST} l ON l.k = replace(raw_call, '0x1::', '')
            LEFT JOIN functions o ON o.func_id = concat(regexp_extract(c.from_id, '^(.*)::[^:]+$', 1), '::', raw_call) LEFT JOIN u ON u.name = raw_call)
        SELECT from_id, to_id, min(call_line) AS call_line FROM r WHERE to_id IS NOT NULL AND to_id <> from_id GROUP BY from_id, to_id"""),
    "j4_split_internal_external": oracle(f"""
        WITH r AS (SELECT c.from_id, raw_call, l.id AS to_id FROM calls c LEFT JOIN {LAST} l ON l.k = replace(raw_call, '0x1::', '') WHERE contains(raw_call, '::'))
        SELECT from_id, coalesce(array_to_string(list_sort(list(DISTINCT to_id) FILTER (to_id <> from_id)), ','), '') AS internal, coalesce(array_to_string(list_sort(list(DISTINCT raw_call) FILTER (to_id IS NULL)), ','), '') AS external
        FROM r WHERE to_id IS NULL OR to_id <> from_id GROUP BY from_id"""),
    "j5_called_by": oracle("SELECT func_id, coalesce(array_to_string(list_sort(list(DISTINCT from_id) FILTER (from_id IS NOT NULL)), ','), '') AS callers FROM functions LEFT JOIN edges ON to_id = func_id GROUP BY func_id"),
    "j6_graph_roots": oracle("SELECT func_id FROM functions WHERE func_id NOT IN (SELECT to_id FROM edges)"),
    "j6_graph_leaves": oracle("SELECT func_id FROM functions WHERE func_id NOT IN (SELECT from_id FROM edges)"),
    "j7_cross_module_calls": oracle("SELECT from_id, to_id FROM edges WHERE split_part(from_id, '::', 2) <> split_part(to_id, '::', 2)"),
    "j8_neighbors": oracle(f"""
        WITH g AS (SELECT * FROM {BOTH}), s AS (SELECT func_id AS seed FROM functions WHERE risk_score = 100),
        d1 AS (SELECT seed, b, 1 AS distance FROM s JOIN g ON a = seed), d2 AS (SELECT DISTINCT seed, g.b, 2 AS distance FROM d1 JOIN g ON g.a = d1.b), d3 AS (SELECT DISTINCT seed, g.b, 3 AS distance FROM d2 JOIN g ON g.a = d2.b)
        SELECT seed, b AS func_id, min(distance) AS distance FROM (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3) WHERE b <> seed GROUP BY ALL"""),
    "j9_relation": oracle("""SELECT target, neighbor, CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.from_id = target AND e.to_id = neighbor) THEN 'calls_target' WHEN EXISTS (SELECT 1 FROM edges e WHERE e.to_id = target AND e.from_id = neighbor) THEN 'called_by_target' ELSE 'indirect' END AS relation
        FROM (SELECT to_id AS target, from_id AS neighbor FROM edges UNION ALL SELECT from_id, from_id FROM edges)"""),
    "j10_callers": oracle("SELECT to_id, from_id, name, visibility, CAST(row_number() OVER (PARTITION BY to_id ORDER BY seq) AS INT) AS rank FROM edges JOIN functions ON func_id = from_id QUALIFY rank <= 2"),
    "j10_callees": oracle("SELECT to_id, from_id, name, visibility, CAST(row_number() OVER (PARTITION BY from_id ORDER BY seq) AS INT) AS rank FROM edges JOIN functions ON func_id = to_id QUALIFY rank <= 1"),
    "j11_resolve_function_id": oracle(f"""
        WITH q AS (SELECT DISTINCT raw_call AS request FROM calls), n AS (SELECT name, list(func_id) AS ids FROM (SELECT * FROM functions QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq) <= 3) GROUP BY name),
        r AS (SELECT request, coalesce(f.func_id, l.id) AS func_id FROM q LEFT JOIN functions f ON f.func_id = request LEFT JOIN {LAST} l ON l.k = request)
        SELECT request, r.func_id, CASE WHEN r.func_id IS NULL THEN array_to_string(list_sort(ids), ',') END AS suggestions FROM r LEFT JOIN n ON n.name = split_part(request, '::', -1)"""),
    "j15_public_entry_for": oracle(f"""WITH x AS ({ENTERED.replace('{functions}', 'functions')}), t AS (SELECT * FROM (VALUES {", ".join(f"('{kind}', {names})" for kind, names in TYPICAL_ENTRIES.items())}) t(category, names)),
        y AS (SELECT x.func_id, CASE WHEN {PUBLIC} THEN x.func_id ELSE (SELECT min_by(p.func_id, p.seq) FROM edges e JOIN (SELECT * FROM functions WHERE {PUBLIC}) p ON p.func_id = e.from_id WHERE e.to_id = x.func_id) END AS direct,
                     list_filter(names, lambda n: contains(source, n))[1] AS guessed FROM x JOIN functions f ON f.func_id = x.func_id LEFT JOIN t USING (category))
        SELECT func_id, coalesce(direct, guessed, 'UNKNOWN') AS entry_point, CASE WHEN direct IS NOT NULL THEN 'direct_call' WHEN guessed IS NOT NULL THEN 'inferred' ELSE 'unknown' END AS via FROM y"""),
    "j16_caller_requirement": oracle("SELECT func_id, CASE risk_score % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'specific_address' WHEN 2 THEN 'anyone' ELSE 'unknown' END AS caller FROM functions"),
    "j17_propagate": oracle("""
        WITH s0 AS (SELECT func_id AS f FROM functions WHERE risk_score >= 95),
        r1 AS (SELECT e.to_id AS p, e.from_id AS f FROM edges e WHERE e.to_id IN (SELECT f FROM s0) AND e.from_id NOT IN (SELECT f FROM s0) QUALIFY row_number() OVER (PARTITION BY e.to_id ORDER BY e.from_id) <= 5), l1 AS (SELECT f, min(p) AS p FROM r1 GROUP BY f),
        r2 AS (SELECT e.to_id AS p, e.from_id AS f FROM edges e WHERE e.to_id IN (SELECT f FROM l1) AND e.from_id NOT IN (SELECT f FROM s0 UNION SELECT f FROM l1) QUALIFY row_number() OVER (PARTITION BY e.to_id ORDER BY e.from_id) <= 5), l2 AS (SELECT f, min(p) AS p FROM r2 GROUP BY f),
        r3 AS (SELECT e.to_id AS p, e.from_id AS f FROM edges e WHERE e.to_id IN (SELECT f FROM l2) AND e.from_id NOT IN (SELECT f FROM s0 UNION SELECT f FROM l1 UNION SELECT f FROM l2) QUALIFY row_number() OVER (PARTITION BY e.to_id ORDER BY e.from_id) <= 5), l3 AS (SELECT f, min(p) AS p FROM r3 GROUP BY f)
        SELECT f AS func_id, p AS from_id, layer, 7 - layer AS exploitability, greatest(60, 85 - 10 * layer) AS confidence FROM (SELECT *, 1 AS layer FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3)"""),
    "j19_report_listing": oracle(f"SELECT report_id, project_id, coalesce(p.name, 'Unknown') AS project_name FROM {REPORTS} r LEFT JOIN projects p ON p.id = r.project_id"),
    "j21_has_running_audit": oracle("SELECT id FROM projects WHERE id IN (SELECT project_id FROM audits WHERE status IN ('pending', 'running'))"),
    "j21_no_running_audit": oracle("SELECT id FROM projects WHERE id NOT IN (SELECT project_id FROM audits WHERE status IN ('pending', 'running'))"),
    "j22_latest_audit": oracle("WITH a AS (SELECT * FROM audits QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, seq DESC) = 1) SELECT p.id, a.id AS audit_id, a.status FROM projects p LEFT JOIN a ON a.project_id = p.id"),
    "a14_graph_meta": oracle(f"SELECT (SELECT count(DISTINCT module) FROM functions) AS modules, (SELECT count(*) FROM functions) AS functions, (SELECT count(*) FROM ({TYPES})) AS types, (SELECT count(*) FROM edges) AS edges"),
    "a15_graph_summary": oracle(f"""SELECT (SELECT count(DISTINCT module) FROM functions) AS modules, (SELECT count(*) FROM functions) AS functions, (SELECT count(*) FROM ({TYPES})) AS types, (SELECT count(*) FROM edges) AS edges,
        (SELECT string_agg(func_id, ',' ORDER BY func_id) FROM (SELECT func_id FROM functions WHERE contains(visibility, 'public') OR contains(visibility, 'entry') ORDER BY func_id LIMIT 20)) AS entries,
        (SELECT coalesce(string_agg(func_id, ',' ORDER BY func_id), '') FROM (SELECT func_id FROM functions WHERE func_id NOT IN (SELECT from_id FROM edges) ORDER BY func_id LIMIT 20)) AS leaves,
        (SELECT string_agg(func_id, ',' ORDER BY func_id) FROM (SELECT func_id FROM functions WHERE risk_score >= 50 ORDER BY func_id LIMIT 20)) AS risky,
        (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT concat(from_id, ' -> ', to_id) AS c FROM edges WHERE split_part(from_id, '::', 2) <> split_part(to_id, '::', 2) ORDER BY c LIMIT 20)) AS cross_module"""),
    "a16_module_call_digest": oracle("SELECT module, func_id, coalesce(array_to_string(list_sort(list(to_id) FILTER (to_id IS NOT NULL))[1:3], ','), '') AS first_calls, CAST(greatest(count(to_id) - 3, 0) AS INT) AS more FROM functions LEFT JOIN edges ON from_id = func_id GROUP BY module, func_id"),
    "a17_dashboard": oracle(f"SELECT (SELECT count(*) FROM {REPORTS}) AS reports, " + ", ".join(f"(SELECT CAST(sum(seq % {k}) AS BIGINT) FROM {REPORTS}) AS {n}" for n, k in (("critical", 3), ("high", 5), ("medium", 7), ("low", 11))) + ", (SELECT count(*) FROM audits) AS audits, (SELECT count(*) FROM audits WHERE status IN ('pending', 'running')) AS running, (SELECT count(*) FROM projects) AS projects"),
    "a22_module_summary": oracle("SELECT module, count(*) AS functions, count(*) FILTER (contains(visibility, 'public')) AS public, count(*) FILTER (contains(visibility, 'entry')) AS entry, coalesce(string_agg(name, ',' ORDER BY name) FILTER (risk_score >= 50), '') AS risky FROM functions GROUP BY module"),
    "p4_entry_points": oracle("SELECT func_id FROM functions WHERE visibility IN ('public', 'entry')"),
    "p4_entry_points_loose": oracle("SELECT func_id FROM functions WHERE contains(visibility, 'public') OR contains(visibility, 'entry')"),
    "p5_public_functions": oracle("SELECT func_id FROM functions WHERE visibility IN ('public', 'public(friend)', 'entry')"),
    "p6_high_risk": oracle("SELECT func_id, risk_score FROM functions WHERE risk_score >= 50"),
    "p8_module_structure": oracle(f"SELECT coalesce(f.module, t.module) AS module, coalesce(f.n, 0) AS functions, coalesce(t.n, 0) AS structs FROM (SELECT module, count(*) AS n FROM functions GROUP BY module) f FULL JOIN (SELECT module, count(*) AS n FROM ({TYPES}) GROUP BY module) t ON f.module = t.module"),
    "p10_list_page": oracle("SELECT id, count(*) OVER () AS total FROM audits WHERE status = 'completed' ORDER BY price DESC, seq DESC LIMIT 50 OFFSET 20"),
}
