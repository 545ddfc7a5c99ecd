"""Queries that put code, types and similar issues beside functions and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import code, scan, search, vectors
from quarry.functions.exploit_data import LIBRARY_MODULES
from quarry.operators import context as op
from quarry.operators.knowledge import topic_words
from quarry.plans.knowledge_queries import TOPIC_LIST
from quarry.plans.scan_queries import SQL_SOURCES, SQL_SNIPPETS, functions_of, quoted, snippets, sources
from quarry.plans.stand_ins import FUNCTIONS, KEYS, by_keys, oracle, table, view
from quarry.sources import shared

TYPES = "SELECT DISTINCT CASE p_size % 2 WHEN 0 THEN 'a' ELSE 'b' END AS project, concat('T', p_size) AS name, concat(p_brand, '-', p_partkey) AS type_id, p_partkey % 3 = 0 AS is_dependency FROM {part}"
TOKENS = "SELECT DISTINCT CASE l_suppkey % 2 WHEN 0 THEN 'a' ELSE 'b' END AS project, concat('0x1::m', l_suppkey, '::f', l_partkey) AS func_id, concat('T', l_linenumber * 7) AS token FROM {lineitem}"
#: Bodies of repaying functions, and whether type, amount and pool are checked and types may be confused.
BODIES = [
    ("assert!(amount == due); contains_type(x)", False, True, False, True), ("type_name == type_name::get<A>(); assert!(coin::value(&c) >= due); pool_id == id", True, True, True, False),
    ("ok", False, False, False, False), ("ETYPEMISMATCH; epoolidmismatch; Repay_Amount", True, True, True, False), ("contains_type(x); type_name::get(t)", False, False, False, False),
    ("assert!(type_name != x && y == z)", True, False, False, False), ("type_name::get<A>() == r.type_name; object::id(pool) == p", True, False, True, False), ("// receipt", False, False, False, False),
]
FLASH = f"""SELECT concat(p_brand, '-', p_partkey % 40) AS project, p_partkey AS seq, CASE p_size % 5 WHEN 0 THEN 'LoanReceipt' WHEN 1 THEN 'Loan' ELSE 'Item' END AS name, CASE WHEN p_size % 2 = 0 THEN array('key', 'drop') ELSE array('key') END AS abilities,
    CASE p_size % 3 WHEN 0 THEN 'repay' WHEN 1 THEN 'return_loan_now' ELSE 'get' END AS fname, CASE p_size % {len(BODIES)} {' '.join(f"WHEN {i} THEN '{b[0]}'" for i, b in enumerate(BODIES))} END AS body, p_size % {len(BODIES)} AS body_no FROM {{part}}"""
RULES = "SELECT rule_id, owner_id, project_id AS rule_project, CASE WHEN priority % 2 = 0 THEN array('oracle') ELSE array() END AS title_contains, CASE WHEN priority % 5 = 1 THEN array('line 3') ELSE array() END AS description_contains, CASE WHEN priority % 7 = 0 THEN '^f1' END AS function_pattern, CASE WHEN priority % 3 = 0 THEN array('high') ELSE array() END AS severity_in, priority % 4 < 2 AS match_all FROM {rules} WHERE rule_id % 40 < 3"


def sql(s, d, text, **kw):
    names = {n: view(s, d, n) if n in ("rules", "findings", "functions") else table(s, d, n) for n in kw.pop("names")}
    return s.sql(text, **names)


def types(s, d):
    return sql(s, d, TYPES, names=["part"])


def tokens(s, d):
    return by_keys(s, TOKENS, "lineitem", table(s, d, "lineitem"), ["l_suppkey", "l_partkey", "l_linenumber"])


def bodies(s, d):
    return view(s, d, "functions").withColumns({"body": F.concat(F.lit("body of "), F.col("name")), "params": F.concat(F.lit("x: T"), F.col("risk_score")), "return_type": F.lit("u64")})


#: Names that functions of the chunk query take in turn, and what each tells.
CHUNK_NAMES = {"create_pool": "creates a new object", "delete_it": "destroys/deletes an object", "is_open": "getter/query function", "set_fee": "setter/update function", "repay": "DeFi repay operation", "swap": "AMM swap operation", "burn": "Token burn operation", "renew_": "", "swaps": ""}


def chunk_name():
    return F.element_at(F.array(*map(F.lit, CHUNK_NAMES)), F.pmod("seq", F.lit(len(CHUNK_NAMES))).cast("int") + 1)


def module_types(s, d):
    return view(s, d, "functions").select("module", F.concat(F.lit("T"), F.col("risk_score") % 5).alias("type_name")).distinct()


def flash(s, d):
    rows = sql(s, d, FLASH, names=["part"])
    return op.flashloan_check(rows.select("project", "seq", "name", "abilities"), rows.select("project", "seq", F.col("fname").alias("name"), "body"))


def owned(s, d):
    return view(s, d, "findings").withColumns({"owner_id": F.concat(F.lit("o"), F.pmod("seq", F.lit(5))), "project": F.concat(F.lit("u"), F.pmod("seq", F.lit(9)))})


def hits(s, d):
    near = vectors.knn(table(s, d, "embeddings").where("vec_id % 20 = 0"), table(s, d, "embeddings"), 20, 10.0)
    label = table(s, d, "embeddings").select("vec_id", F.element_at(F.array(*map(F.lit, ["critical", "high", "medium", "low", "advisory"])), F.pmod("label", F.lit(5)).cast("int") + 1).alias("severity"))
    return near.join(label, "vec_id")


def relevant(s, d):
    return hits(s, d).withColumn("relevance", F.when(F.col("vec_id") % 2 == 0, 0.8).otherwise(0.25))


#: Issues that a snippet is held against: title, description, function, cues.
CASES = [
    ("Oracle price stale", "uses `get_price` of set_price", "pool::set_price", "amount * price | oracle::get_price | p"),
    ("Plain", "", "", ""),
    ("of", None, None, None),
    ("Repay receipt", "calls repay_flash_loan and close_position without verify_receipt_type", "repay", "flash_loan(receipt)"),
    ("Borrow rate", "the value of flash_loan may be drained by swap_exact_out", "borrow", "AdminCap"),
    ("Transfer of AdminCap", "Anyone can `transfer::public_transfer` it", "m::get", "public_transfer"),
    ("let amount", "see zz_qqq and public_transfer", None, "value / rate"),
    ("Timestamp of the clock", "see zz_qqq, vv_www and from_bytes", "borrow", "xx | clock::timestamp_ms(c)"),
    ("Signature malleability", "", "", ""),
]
SQL_CASES = ", ".join(f"({i}, " + ", ".join("NULL" if x is None else quoted(x) for x in case) + ")" for i, case in enumerate(CASES))


TOLD = ["text", "title", "description", "function", "cues"]


def relevance_cases(s, d):
    cases = s.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "n long, title string, description string, function string, cues string")
    return snippets(s, d).withColumn("n", F.pmod("doc_id", F.lit(len(CASES)))).join(F.broadcast(cases), "n")


def requests(s, d):
    return table(s, d, "part").selectExpr("concat(CASE WHEN p_size % 4 = 0 THEN 'x::' ELSE '' END, 'm', p_partkey) AS module", "CASE p_size % 3 WHEN 0 THEN 'helper' WHEN 1 THEN 'absent' END AS function")


def answers(s, d):
    rows = table(s, d, "conversations").selectExpr("conv_id", "turn", "CASE turn % 4 WHEN 0 THEN concat('<thinking>x {</thinking> ```json\\n{\"verdict\": \"yes\", \"score\": ', conv_id, '}\\n```') WHEN 1 THEN concat('so {\"verdict\": \"no\", \"score\": ', turn, '} end') WHEN 2 THEN concat('{\"verdict\": \"maybe\", \"score\": 0', conv_id) ELSE CASE WHEN conv_id % 2 = 0 THEN concat('{oops {\"verdict\": \"late\", \"of\": {}, \"score\": ', turn, '} end {bad}') ELSE text END END AS text")
    return op.salvage_json(rows, "verdict string, score long", ["verdict", "score"]).select("conv_id", "turn", "verdict", "score", "tier")


#: Findings of functions, some without one; Spark and DuckDB both run it.
GROUPED = """
    SELECT module, CAST(seq % 97 AS BIGINT) AS "group", concat('x', seq) AS finding_id, CASE WHEN seq % 11 = 0 THEN NULL ELSE func_id END AS func_id,
           CASE seq % 4 WHEN 0 THEN 'Price may overflow' WHEN 1 THEN 'Flash loan without a check' WHEN 2 THEN 'Reentrancy by callback' ELSE 'Plain' END AS title, CASE WHEN seq % 3 = 0 THEN 'anyone can take it' END AS description,
           CASE WHEN seq % 5 = 0 THEN 'vector' END AS category, CASE WHEN seq % 7 = 0 THEN 'by rule' END AS hint
    FROM {functions}"""


#: Functions of dependencies, some below `sui`, some below `std`.
DEPENDENCIES = "SELECT concat(CASE seq % 3 WHEN 0 THEN 'sui::' WHEN 1 THEN 'std::' ELSE '' END, CASE WHEN seq % 2 = 0 THEN func_id ELSE concat(module, '::', name) END) AS func_id, module, name, seq FROM {functions} WHERE risk_score < 20"


def dependencies(s, d):
    return s.sql(DEPENDENCIES, functions=view(s, d, "functions"))


def grouped(s, d):
    keys = KEYS["functions"][1]
    funcs = by_keys(s, FUNCTIONS, "lineitem", shared.kept_table(table(s, d, "lineitem").select(*keys).distinct(), "functions"), keys, True)
    rows = s.sql(GROUPED.replace('"group"', "`group`"), functions=funcs)
    out = op.group_context(rows, funcs.selectExpr("func_id", "concat(visibility, ' fun ', name) AS signature", "CASE WHEN seq % 13 > 0 THEN concat('body of ', func_id) END AS body"), view(s, d, "edges"), topic_words(s))
    return out.select("module", "group", *[F.array_join(c, "|").alias(c) for c in ("functions", "bodies", "callees", "callers", "topics", "hints")])


def located(s, d):
    """Matches in the written code: half keep their line hint, and one title names the helper."""
    docs = sources(s, d).select(F.col("id").alias("doc_id"), F.col("content").alias("text"))
    spans = code.function_spans(sources(s, d).select("id", "content"), ["id"]).select(F.col("id").alias("doc_id"), "function", "start_line", "end_line")
    lines = code.function_lines(sources(s, d).select("id", "content"), ["id"])
    lines = lines.select(F.col("id").alias("doc_id"), "line_no", "line", F.when(F.col("line").contains("struct "), "struct").when(F.col("function").isNotNull(), "function").otherwise("module").alias("place"))
    cue = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("amount"))).otherwise(F.array(F.lit("LIMIT")))
    rows = docs.select("doc_id", F.lit("P").alias("pattern_id"), F.when(F.col("doc_id") % 5 == 0, "Misuse of helper()").otherwise("Plain").alias("title"), F.lit("text").alias("description"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(2))).otherwise(F.array().cast("array<int>")).alias("line_hints"), cue.alias("matched_cues"))
    return op.locate_match(rows, spans, lines)


QUERIES = {
    "k7_locate_match": located,
    "j12_type_definitions": lambda s, d: op.type_definitions(tokens(s, d), types(s, d)).select("project", "func_id", "token", "type_id"),
    "j13_resolve_external": lambda s, d: op.resolve_external(view(s, d, "calls"), view(s, d, "functions").where("risk_score < 40")).select("from_id", "raw_call", "call_line", "dependency_id"),
    "j14_function_context": lambda s, d: op.function_context(bodies(s, d), view(s, d, "edges"), tokens(s, d).select("func_id", "token")).select("func_id", F.array_join("callers", ",").alias("callers"), F.array_join("callees.callee_body", ",").alias("callee_bodies"), F.array_join("types", ",").alias("types")),
    "j18_flashloan_check": flash,
    "j23_function_code": lambda s, d: op.function_code(view(s, d, "calls").selectExpr("CASE call_line WHEN 1 THEN replace(raw_call, 'm', 'x::coin::m') WHEN 5 THEN concat('0x2::coin::f', from_seq % 50) ELSE raw_call END AS request").distinct(), view(s, d, "functions").where("risk_score >= 20"), dependencies(s, d)),
    "x18_make_chunks": lambda s, d: op.make_chunks(bodies(s, d).withColumn("name", chunk_name()), module_types(s, d)).select("func_id", F.array_join("related", ", ").alias("related"), "risk_score", "description", "embedding_text"),
    "x20_snippets_by_keyword": lambda s, d: op.snippets_by_keyword(scan.explode_lines(sources(s, d).select(F.col("id").alias("path"), "content")), "amount", 2).select("path", F.array_join("hits", ",").alias("hits"), "snippet"),
    "k2_line_hints": lambda s, d: op.line_hints(snippets(s, d).select("doc_id"), snippets(s, d), r"[a-z_]+\s*\(", 3).select("doc_id", F.array_join("hints", ",").alias("hints")),
    "k10_valid_locations": lambda s, d: op.valid_locations(view(s, d, "findings").selectExpr("title AS pattern_id", "CAST(quantity AS INT) % 4 AS line", "CASE WHEN quantity % 5 = 0 THEN '  module x' ELSE module END AS context")),
    "p3_locate": lambda s, d: search.locate(sources(s, d).select(F.concat(F.lit("f"), F.col("id")).alias("path"), F.regexp_replace("content", "module 0x1::", "module ").alias("content")), requests(s, d)),
    "p7_risky_access": lambda s, d: op.risky_by_type(code.risk_indicators(functions_of(s, d)), "access").select("id", "function"),
    "p7_risky_state": lambda s, d: op.risky_by_type(code.risk_indicators(functions_of(s, d)), "state").select("id", "function"),
    "p13_scannable": lambda s, d: op.scannable(view(s, d, "functions").withColumns({"path": F.when(F.col("risk_score") % 3 == 0, "tests/a.move").otherwise("a.move"), "uses": F.when(F.col("risk_score") % 5 == 0, F.array(F.lit("x::test_only"))).otherwise(F.array(F.lit("x")))})).select("func_id"),
    "v2_code_relevance": lambda s, d: shared.once_each(relevance_cases(s, d).select("doc_id", *TOLD), TOLD, lambda rows: rows.select("__key", op.code_relevance(*map(F.col, TOLD)).alias("relevance"))),
    "v3_core_concepts": lambda s, d: view(s, d, "findings").select("title", F.array_join(op.core_concepts(F.col("title")), ",").alias("terms")).groupBy("title", "terms").count(),
    "v5_semantic_matches": lambda s, d: op.semantic_matches(relevant(s, d).drop("rank"), 3).select("query_id", "vec_id", "confidence"),
    "v6_search_by_severity": lambda s, d: op.search_by_severity(hits(s, d), "medium", 4).select("query_id", "vec_id", "severity"),
    "v7_matched_cues": lambda s, d: snippets(s, d).select("doc_id", F.array_join(op.matched_cues(F.col("text"), F.array(F.lit("Cap"), F.lit("o"), F.lit("value")), F.lit("Price of rate, let")), ",").alias("cues")),
    "o8_custom_exclusions": lambda s, d: op.apply_custom_exclusions(owned(s, d), sql(s, d, RULES, names=["rules"])).select("finding_id", "seq", "excluded_by"),
    "o22_salvage_json": answers,
    "o26_group_context": grouped,
}

SNIP = f"WITH {SQL_SNIPPETS}"
NEAR = """n AS (SELECT *, 1 - distance / 2 AS conf FROM (SELECT q.vec_id AS query_id, b.vec_id, ['critical', 'high', 'medium', 'low', 'advisory'][b.label % 5 + 1] AS severity, round(sqrt(list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))), 6) AS distance
    FROM embeddings q JOIN embeddings b ON q.vec_id % 20 = 0 AND q.vec_id <> b.vec_id) WHERE distance <= 10 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 20)"""
HAS = lambda x: f"contains(lower(text), '{x}')::INT"

#: What the language guards against among the titles above: overflow aborts, and calls can't come back.
GUARDED = "WHEN title = 'Price may overflow' THEN 'the language guards against arithmetic_overflow' WHEN title = 'Reentrancy by callback' THEN 'the language guards against reentrancy'"

ORACLES = {
    "k7_locate_match": f"""WITH {SQL_SOURCES}, x AS (SELECT id, size, 5 + CASE WHEN size % 3 = 0 THEN 1 ELSE 0 END AS lead FROM sources)
        SELECT id AS doc_id, 'P' AS pattern_id, CAST(CASE WHEN id % 5 = 0 THEN lead + 7 WHEN id % 2 = 0 THEN 2 WHEN id % 3 = 0 THEN lead + 1 ELSE 4 END AS INT) AS line,
            CASE WHEN id % 5 = 0 THEN 'helper' WHEN id % 2 = 0 THEN NULL WHEN id % 3 = 0 THEN concat('get_', size) END AS function, CASE WHEN id % 5 = 0 THEN 'named function' WHEN id % 2 = 0 THEN 'line hint' ELSE 'cue' END AS how FROM x""",
    "j12_type_definitions": f"""WITH ty AS ({TYPES.replace('{part}', 'part')}), tk AS ({TOKENS.replace('{lineitem}', 'lineitem')}) SELECT tk.project, func_id, token, type_id FROM tk JOIN ty ON ty.name = token AND (is_dependency OR ty.project = tk.project)
        QUALIFY row_number() OVER (PARTITION BY tk.project, func_id, token ORDER BY is_dependency, type_id) = 1""",
    "j13_resolve_external": oracle("SELECT c.from_id, raw_call, call_line, d.id AS dependency_id FROM calls c LEFT JOIN (SELECT concat(module, '::', name) AS k, min_by(func_id, seq) AS id FROM functions WHERE risk_score < 40 GROUP BY 1) d ON d.k = replace(raw_call, '0x1::', '')"),
    "j14_function_context": oracle(f"""WITH tk AS ({TOKENS.replace('{lineitem}', 'lineitem')}) SELECT f.func_id, coalesce((SELECT array_to_string(list_sort(list(from_id))[1:5], ',') FROM edges WHERE to_id = f.func_id), '') AS callers,
        (SELECT array_to_string(list_transform(list_sort(list(to_id))[1:5], lambda x: concat('body of ', split_part(x, '::', 3))), ',') FROM edges WHERE from_id = f.func_id) AS callee_bodies, coalesce((SELECT array_to_string(list_sort(list(token))[1:10], ',') FROM tk WHERE tk.func_id = f.func_id), '') AS types FROM functions f"""),
    "j18_flashloan_check": f"""WITH p AS ({FLASH.replace('{part}', 'part').replace("array('key', 'drop')", "['key', 'drop']").replace("array('key')", "['key']")}), r AS (SELECT project, min_by(name, seq) AS receipt, min_by(abilities, seq) AS ab FROM p WHERE name <> 'Item' GROUP BY project),
        f AS (SELECT project, min_by(fname, seq) AS repay, min_by(body_no, seq) AS n FROM p WHERE fname <> 'get' GROUP BY project), x AS (SELECT project, receipt, repay, coalesce(NOT list_contains(ab, 'drop'), false) AS hot_potato, {', '.join(f"coalesce(n IN ({', '.join(str(i) for i, b in enumerate(BODIES) if b[k])}), false) AS {c}" for k, c in enumerate(("checks_type", "checks_amount", "checks_pool", "type_confusion"), 1))} FROM r FULL JOIN f USING (project))
        SELECT *, CASE WHEN NOT hot_potato THEN 'to be reviewed' WHEN checks_type AND checks_amount AND checks_pool THEN 'checked' WHEN checks_type THEN 'receipt and type checked' WHEN type_confusion THEN 'type confusion' ELSE 'type not checked' END AS verdict FROM x""",
    "j23_function_code": oracle(f"""WITH q AS (SELECT DISTINCT CASE call_line WHEN 1 THEN replace(raw_call, 'm', 'x::coin::m') WHEN 5 THEN concat('0x2::coin::f', from_seq % 50) ELSE raw_call END AS request FROM calls),
        p AS (SELECT request, string_split(request, '::') AS s FROM q), a AS (SELECT * FROM functions WHERE risk_score >= 20), b AS ({DEPENDENCIES.replace('{functions}', 'functions')}), n AS (SELECT name, min_by(func_id, seq) AS id FROM a GROUP BY name),
        r AS (SELECT request, CASE WHEN len(s) > 1 AND s[-2] IN ({', '.join(map(quoted, LIBRARY_MODULES))}) THEN 'sui::' || request END AS stub, e.func_id AS exact, m.func_id AS own, coalesce(d1.func_id, d2.func_id, d3.func_id, d4.func_id) AS dep, n.id
              FROM p LEFT JOIN a e ON e.func_id = request LEFT JOIN a m ON len(s) > 1 AND m.module = s[-2] AND m.name = s[-1] LEFT JOIN b d1 ON d1.func_id = request LEFT JOIN b d2 ON d2.func_id = 'sui::' || request LEFT JOIN b d3 ON d3.func_id = 'std::' || request
              LEFT JOIN b d4 ON len(s) > 1 AND d4.module = s[-2] AND d4.name = s[-1] LEFT JOIN n ON n.name = s[-1])
        SELECT request, coalesce(stub, exact, own, dep, id) AS func_id, CASE WHEN stub IS NOT NULL THEN 'library' WHEN exact IS NOT NULL THEN 'index' WHEN own IS NOT NULL THEN 'module' WHEN dep IS NOT NULL THEN 'dependency' WHEN id IS NOT NULL THEN 'name' END AS origin,
               coalesce(stub, exact, own, dep) IS NULL AND id IS NOT NULL AS corrected FROM r"""),
    "x18_make_chunks": oracle(f"""WITH t AS (SELECT DISTINCT module, concat('T', risk_score % 5) AS type_name FROM functions), n AS (SELECT func_id, module, visibility, risk_score, {list(CHUNK_NAMES)}[seq % {len(CHUNK_NAMES)} + 1] AS name, {list(CHUNK_NAMES.values())}[seq % {len(CHUNK_NAMES)} + 1] AS does, split_part(func_id, '::', 3) AS was FROM functions),
        x AS (SELECT *, concat_ws(', ', CASE visibility WHEN 'entry' THEN 'Entry point function' WHEN 'public' THEN 'Public function' END, nullif(does, '')) AS told FROM n),
        y AS (SELECT *, CASE WHEN told = '' THEN '' ELSE concat(module, '::', name, ' - ', told) END AS description FROM x)
        SELECT func_id, coalesce((SELECT string_agg(type_name, ', ' ORDER BY type_name) FROM t WHERE t.module = y.module AND contains(concat('x: T', y.risk_score, ' u64'), type_name)), '') AS related, risk_score, description,
            concat_ws(chr(10), concat('Module: ', module), concat('Function: ', name), concat('Signature: fun ', name, '(x: T', risk_score, '): u64'), 'Description: ' || nullif(description, ''), concat('Code:', chr(10), 'body of ', was)) AS embedding_text FROM y"""),
    "x20_snippets_by_keyword": f"""WITH RECURSIVE {SQL_SOURCES}, l AS (SELECT id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM sources), h AS (SELECT id, n FROM l WHERE contains(lower(line), 'amount')),
        w AS (SELECT id, min(n) AS n, 1 AS k FROM h GROUP BY id UNION ALL SELECT w.id, (SELECT min(h.n) FROM h WHERE h.id = w.id AND h.n > w.n + 2) AS n, k + 1 FROM w WHERE k < 3 AND w.n IS NOT NULL)
        SELECT id AS path, string_agg(n, ',' ORDER BY n) AS hits, string_agg(snippet, concat(chr(10), '---', chr(10)) ORDER BY n) AS snippet FROM (
            SELECT w.id, w.n, string_agg(concat(CASE WHEN l.n = w.n THEN '→ ' ELSE '  ' END, lpad(concat(l.n), 4, ' '), ' | ', l.line), chr(10) ORDER BY l.n) AS snippet FROM w JOIN l ON l.id = w.id AND l.n BETWEEN w.n - 2 AND w.n + 2 GROUP BY w.id, w.n) GROUP BY id""",
    "k2_line_hints": f"""{SNIP}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM snippets), m AS (SELECT doc_id, n, unnest(regexp_extract_all(line, '(?i)[a-z_]+\\s*\\(')) AS hit, generate_subscripts(regexp_extract_all(line, '(?i)[a-z_]+\\s*\\('), 1) AS j FROM l)
        SELECT s.doc_id, coalesce(string_agg(n, ',' ORDER BY n, j) FILTER (r <= 3), '') AS hints FROM snippets s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n, j) AS r FROM m) USING (doc_id) GROUP BY s.doc_id""",
    "k10_valid_locations": oracle("SELECT title AS pattern_id, count(*) AS valid FROM findings WHERE CAST(quantity AS INT) % 4 > 1 AND quantity % 5 <> 0 GROUP BY title"),
    "p3_locate": f"""WITH {SQL_SOURCES}, l AS (SELECT id, string_split(content, chr(10)) AS lines FROM sources), a AS (SELECT id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM l),
        r AS (SELECT p_partkey, concat('m', p_partkey) AS m, concat(CASE WHEN p_size % 4 = 0 THEN 'x::' ELSE '' END, 'm', p_partkey) AS module, CASE p_size % 3 WHEN 0 THEN 'helper' WHEN 1 THEN 'absent' END AS "function" FROM part),
        h AS (SELECT module, "function", concat('f', id) AS path, min(n) AS head FROM r JOIN a ON contains(line, 'module 0x1::' || m) GROUP BY ALL),
        f AS (SELECT h.*, (SELECT min(n) FROM a WHERE concat('f', a.id) = path AND contains(line, 'fun ' || h."function")) AS place FROM h),
        best AS (SELECT * FROM f WHERE "function" IS NULL OR place IS NOT NULL QUALIFY row_number() OVER (PARTITION BY module, "function" ORDER BY path) = 1)
        SELECT r.module, r."function", path, CAST(CASE WHEN r."function" IS NULL THEN head ELSE place END AS INT) AS line_start, CAST(CASE WHEN r."function" IS NULL THEN head ELSE place + 2 END AS INT) AS line_end
        FROM r LEFT JOIN best ON r.module = best.module AND r."function" IS NOT DISTINCT FROM best."function" """,
    "p7_risky_access": "SELECT p_partkey AS id, 'helper' AS function FROM part",
    "p7_risky_state": "SELECT p_partkey AS id, 'helper' AS function FROM part",
    "p13_scannable": oracle("SELECT func_id FROM functions WHERE risk_score % 3 <> 0 AND risk_score % 5 <> 0"),
    "v2_code_relevance": f"""{SNIP}, c AS (SELECT doc_id, lower(text) AS code, lower(x.title) AS title, coalesce(x.description, '') AS told, coalesce(x.function, '') AS fn, coalesce(x.cues, '') AS cues FROM snippets JOIN (VALUES {SQL_CASES}) x(n, title, description, function, cues) ON doc_id % {len(CASES)} = n),
        p AS (SELECT *, list_filter([CASE WHEN contains(title, 'oracle') THEN 'oracle' END, CASE WHEN contains(title, 'admin') THEN 'admin' END, CASE WHEN contains(title, 'signature') THEN 'sig' END, CASE WHEN contains(title, 'signature') THEN 'signature' END], lambda x: x IS NOT NULL AND NOT contains(code, x)) AS lost,
                list_filter(regexp_extract_all(title, '[a-z_][a-z0-9_]*'), lambda w: length(w) >= 3 AND w NOT IN ('the', 'and', 'for', 'with', 'not', 'but', 'without'))[1:10] AS words,
                list_filter(list_transform(string_split(cues, ' | ')[1:5], lambda c: trim(lower(c))), lambda c: length(c) >= 3) AS parts,
                list_filter(list_distinct(regexp_extract_all(lower(told), '\\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\\b')), lambda x: length(x) >= 8) AS ids,
                list_filter(list_distinct(regexp_extract_all(told, '`([^`]+)`', 1) || regexp_extract_all(lower(told), '\\b[a-z_]+(?:_[a-z]+)+\\b')), lambda x: length(x) >= 5) AS pats FROM c),
        q AS (SELECT *, len(words) + (fn <> '')::INT + len(parts) + len(pats) AS checks,
                len(list_filter(words, lambda x: contains(code, x))) + CASE WHEN fn <> '' AND contains(code, lower(string_split(fn, '::')[-1])) THEN 1.5 ELSE 0 END + 0.8 * len(list_filter(parts, lambda x: contains(code, x))) + 0.6 * len(list_filter(pats, lambda x: contains(code, lower(x)))) AS points,
                len(list_filter(pats, lambda x: NOT contains(code, lower(x)) AND contains(x, '_') AND len(list_filter(string_split(x, '_'), lambda y: contains(code, lower(y)))) = 0)) AS bad, len(list_filter(ids, lambda x: NOT contains(code, x))) AS missing FROM p)
        SELECT doc_id, CASE WHEN len(lost) > 0 THEN 0.1 WHEN len(ids) >= 2 AND missing >= 0.7 * len(ids) THEN 0.15 WHEN checks = 0 THEN 0.5
                            ELSE round(least(1.0, points / greatest(checks * 0.5, 1.0)) * CASE WHEN bad >= 2 THEN 0.5 WHEN bad = 1 THEN 0.7 ELSE 1 END, 6) END::DOUBLE AS relevance FROM q""",
    "v3_core_concepts": oracle("SELECT title, CASE title WHEN 'Missing admin check' THEN 'admin' WHEN 'Oracle price manipulation' THEN 'oracle' WHEN 'Callback before update' THEN 'callback' ELSE '' END AS terms, count(*) AS count FROM findings GROUP BY ALL"),
    "v5_semantic_matches": f"WITH {NEAR} SELECT query_id, vec_id, round(greatest(0.0, conf) * 0.8, 6) AS confidence FROM n WHERE vec_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(greatest(0.0, conf) * 0.8, 6) DESC, vec_id) <= 3",
    "v6_search_by_severity": f"WITH {NEAR} SELECT query_id, vec_id, severity FROM n WHERE severity IN ('critical', 'high', 'medium') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 4",
    "v7_matched_cues": f"{SNIP} SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN contains(lower(text), '{w.lower()}') THEN {quoted(w)} END" for w in ("Cap", "value", "price", "rate", "let")) + ") AS cues FROM snippets",
    "o8_custom_exclusions": oracle("""WITH f AS (SELECT * REPLACE (concat('u', seq % 9) AS project), concat('o', seq % 5) AS owner_id FROM findings), r AS (SELECT * FROM rules WHERE rule_id % 40 < 3),
        j AS (SELECT f.finding_id, f.seq, rule_id, list_filter([CASE WHEN priority % 2 = 0 THEN contains(lower(title), 'oracle') END, CASE WHEN priority % 5 = 1 THEN contains(lower(description), 'line 3') END, CASE WHEN priority % 7 = 0 THEN starts_with(function, 'f1') END, CASE WHEN priority % 3 = 0 THEN lower(severity) = 'high' END], lambda c: c IS NOT NULL) AS cs, priority % 4 < 2 AS match_all
            FROM f JOIN r USING (owner_id) WHERE r.project_id IS NULL OR r.project_id = f.project)
        SELECT f.finding_id, f.seq, e.x AS excluded_by FROM f LEFT JOIN (SELECT finding_id, seq, min(rule_id) AS x FROM j WHERE len(cs) > 0 AND CASE WHEN match_all THEN list_bool_and(cs) ELSE list_bool_or(cs) END GROUP BY ALL) e USING (finding_id, seq)"""),
    "o22_salvage_json": """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'maybe' ELSE CASE WHEN conv_id % 2 = 0 THEN 'late' END END AS verdict, CAST(CASE turn % 4 WHEN 0 THEN conv_id WHEN 1 THEN turn WHEN 2 THEN conv_id ELSE CASE WHEN conv_id % 2 = 0 THEN turn END END AS BIGINT) AS score,
        CASE turn % 4 WHEN 0 THEN 'object' WHEN 1 THEN 'object' WHEN 2 THEN 'fields' ELSE CASE WHEN conv_id % 2 = 0 THEN 'balanced' ELSE 'none' END END AS tier FROM conversations""",
    "o26_group_context": oracle(f"""WITH x AS ({GROUPED.replace('{functions}', 'functions')}), k AS (SELECT DISTINCT module, "group", func_id FROM x WHERE func_id IS NOT NULL),
        m AS (SELECT *, row_number() OVER (PARTITION BY module, "group" ORDER BY func_id) AS place, count(*) OVER (PARTITION BY module, "group") AS n FROM k),
        own AS (SELECT module, "group", string_agg(func_id, '|' ORDER BY func_id) AS fs, string_agg(CASE WHEN seq % 13 > 0 THEN concat('body of ', func_id) END, '|' ORDER BY func_id) AS bodies FROM m JOIN functions USING (module, func_id) GROUP BY ALL),
        d AS (SELECT module, "group", m.func_id, array_to_string(list_sort(list(DISTINCT to_id))[1:3], ', ') AS ids FROM m JOIN edges ON from_id = m.func_id WHERE n <= 3 AND place <= 2 AND to_id IN (SELECT func_id FROM functions) GROUP BY ALL),
        c AS (SELECT module, "group", string_agg(concat(func_id, ': ', ids), '|' ORDER BY func_id) AS callees FROM d GROUP BY ALL),
        u AS (SELECT to_id AS func_id, concat(visibility, ' fun ', name) AS signature, row_number() OVER (PARTITION BY to_id ORDER BY from_id) AS r FROM (SELECT DISTINCT from_id, to_id FROM edges) e JOIN functions f ON f.func_id = e.from_id QUALIFY r <= 3),
        us AS (SELECT func_id, string_agg(signature, '; ' ORDER BY r) AS sigs FROM u GROUP BY ALL),
        cs AS (SELECT module, "group", string_agg(concat(func_id, ': ', sigs), '|' ORDER BY func_id) AS callers FROM m JOIN us USING (func_id) GROUP BY ALL),
        w AS (SELECT *, lower(concat(title, ' ', coalesce(description, ''), ' ', coalesce(category, ''))) AS c FROM x),
        t AS (SELECT module, "group", unnest(string_split({TOPIC_LIST}, ',')) AS topic FROM w), ts AS (SELECT module, "group", string_agg(DISTINCT topic, '|' ORDER BY topic) AS topics FROM t WHERE topic <> '' GROUP BY ALL),
        h AS (SELECT module, "group", string_agg(concat(finding_id, ': ', said), '|' ORDER BY concat(finding_id, ': ', said)) AS hints FROM (SELECT *, coalesce(hint, CASE {GUARDED} END) AS said FROM x) WHERE said IS NOT NULL GROUP BY ALL)
        SELECT g.module, g."group", coalesce(fs, '') AS functions, coalesce(bodies, '') AS bodies, coalesce(callees, '') AS callees, coalesce(callers, '') AS callers, coalesce(topics, '') AS topics, coalesce(hints, '') AS hints
        FROM (SELECT DISTINCT module, "group" FROM x) g LEFT JOIN own USING (module, "group") LEFT JOIN c USING (module, "group") LEFT JOIN cs USING (module, "group") LEFT JOIN ts USING (module, "group") LEFT JOIN h USING (module, "group")"""),
}
