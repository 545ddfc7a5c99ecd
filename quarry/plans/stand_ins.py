"""Audit tables derived from the given tables, in SQL that Spark and DuckDB both run.

The given tables hold no audits. These views give their rows the columns of findings, usages, functions and
so on, row by row, so that each operator works on whole tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINDINGS = """
    SELECT ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey AS seq,
           concat('f', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS finding_id,
           concat('p', l_suppkey % 7) AS project, concat('r', l_orderkey % 97) AS report_id,
           concat('m', l_suppkey % 20) AS module, concat('f', l_partkey % 50) AS function,
           CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN concat(l_linenumber * 10) ELSE concat(l_linenumber * 10, '-', l_linenumber * 10 + 5) END AS line,
           CASE CAST(floor(l_tax * 100 + 0.5) AS INT) % 9 WHEN 0 THEN 'Integer overflow in mint' WHEN 1 THEN 'Missing admin check' WHEN 2 THEN 'Oracle price manipulation'
                WHEN 3 THEN 'Loss of precision' WHEN 4 THEN 'Flash loan receipt reuse' WHEN 5 THEN 'Callback before update' WHEN 6 THEN 'First depositor wins'
                WHEN 7 THEN 'Unclear naming' ELSE 'Donation to the vault' END AS title,
           concat('Seen at line ', l_linenumber, ' of order ', l_orderkey) AS description,
           CASE l_partkey % 4 WHEN 0 THEN 'logic' WHEN 1 THEN 'style' WHEN 2 THEN NULL ELSE 'Access' END AS category,
           CASE WHEN l_quantity >= 45 THEN 'critical' WHEN l_quantity >= 35 THEN 'HIGH' WHEN l_quantity >= 20 THEN 'Medium' WHEN l_quantity >= 8 THEN 'low' WHEN l_quantity >= 3 THEN 'ADVISORY' ELSE 'bogus' END AS severity,
           CAST(floor(l_discount * 1000 + 0.5) AS INT) AS confidence,
           CASE l_returnflag WHEN 'R' THEN 'confirmed' WHEN 'A' THEN 'false_positive' ELSE 'needs_review' END AS status,
           CASE l_partkey % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'public' WHEN 2 THEN 'entry' WHEN 3 THEN 'public entry' ELSE 'public(friend)' END AS visibility,
           l_quantity AS quantity, l_shipdate AS created_at, l_linestatus AS flag
    FROM {lineitem}"""

USAGES = """
    SELECT event_id AS id, user_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat('proj', event_id % 17) END AS project_name,
           CAST(floor(value) AS BIGINT) AS total_tokens, event_type AS agent, ts AS created_at
    FROM {events}"""

FUNCTIONS = """
    SELECT DISTINCT concat('0x1::m', l_suppkey, '::f', l_partkey) AS func_id, concat('m', l_suppkey) AS module, concat('f', l_partkey) AS name,
           CASE l_partkey % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'public' WHEN 2 THEN 'entry' WHEN 3 THEN 'public entry' ELSE 'public(friend)' END AS visibility,
           l_partkey % 101 AS risk_score, l_suppkey * 1000000 + l_partkey AS seq
    FROM {lineitem}"""

CALLS = """
    SELECT DISTINCT concat('0x1::m', a.l_suppkey, '::f', a.l_partkey) AS from_id, a.l_suppkey * 1000000 + a.l_partkey AS from_seq,
           CASE b.l_linenumber % 4 WHEN 0 THEN concat('0x1::m', b.l_suppkey, '::f', b.l_partkey) WHEN 1 THEN concat('m', b.l_suppkey, '::f', b.l_partkey)
                WHEN 2 THEN concat('m', b.l_suppkey + 1000000, '::f', b.l_partkey) ELSE concat('f', b.l_partkey) END AS raw_call,
           b.l_linenumber AS call_line
    FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber"""

EDGES = """
    SELECT DISTINCT concat('0x1::m', a.l_suppkey, '::f', a.l_partkey) AS from_id, concat('0x1::m', b.l_suppkey, '::f', b.l_partkey) AS to_id
    FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber
    WHERE a.l_suppkey <> b.l_suppkey OR a.l_partkey <> b.l_partkey"""

AUDITS = """
    SELECT concat('a', o_orderkey) AS id, concat('c', o_custkey) AS project_id, o_orderkey AS seq,
           CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'pending' ELSE 'completed' END AS status,
           o_orderdate AS created_at, o_totalprice AS price, o_orderpriority AS priority
    FROM {orders}"""

PROJECTS = """
    SELECT concat('c', c_custkey) AS id, c_name AS name, concat('u', c_nationkey) AS owner_id, c_mktsegment AS blockchain, c_acctbal AS balance, c_custkey AS seq
    FROM {customer} WHERE c_custkey % 10 <> 3"""

ACTIONS = """
    SELECT event_id AS seq, concat('f', user_id) AS finding_id,
           CASE event_type WHEN 'click' THEN 'confirm' WHEN 'view' THEN 'add_note' WHEN 'purchase' THEN 'downgrade' WHEN 'signup' THEN 'upgrade' ELSE 'reject' END AS action_type,
           CASE WHEN event_type = 'purchase' THEN 'LOW' WHEN event_type = 'signup' THEN 'HIGH' END AS new_severity,
           concat('note ', event_id) AS reason, ts AS created_at
    FROM {events}"""

RULES = """
    SELECT p_partkey AS rule_id, p_name AS name, p_type AS category, p_size % 3 <> 0 AS is_enabled, p_size AS priority, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS blockchain,
           CASE WHEN p_size % 4 = 0 THEN NULL ELSE concat('u', p_partkey % 9) END AS project_id, concat('o', p_partkey % 5) AS owner_id
    FROM {part}"""

FILES = """
    SELECT doc_id AS seq, source AS project, concat(CASE doc_id % 6 WHEN 0 THEN 'build/' WHEN 1 THEN 'sources/lib/' WHEN 2 THEN 'tests/' ELSE 'sources/' END, 'd', doc_id,
           CASE doc_id % 5 WHEN 0 THEN '_test.move' WHEN 1 THEN '.move' WHEN 2 THEN '.toml' WHEN 3 THEN '.MD' ELSE '.bin' END) AS path, text AS content, lang
    FROM {documents}"""

VIEWS = {"findings": FINDINGS, "usages": USAGES, "functions": FUNCTIONS, "calls": CALLS, "edges": EDGES, "audits": AUDITS, "projects": PROJECTS, "actions": ACTIONS, "rules": RULES, "files": FILES}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The id of a line, as the SQL of views and twins writes it. Beyond some 11.5 million orders it is no 64-bit number.
LINE_ID = "((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey"


def with_line_ids(sql: str, lines: DataFrame) -> str:
    """`sql` as it is where LINE_ID of all lines fits 64 bits, else with the same number as a decimal of 38 digits."""
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    ends = lines.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("least", F.min), ("most", F.max))]).first()
    order, number, part, supplier = (max(abs(ends[f"{n}_{c}"] or 0) for n in ("least", "most")) for c in columns)
    if ((order * 8 + number) * 1000000 + part) * 100000 + supplier < 2**63:
        return sql
    return sql.replace(LINE_ID, f"CAST({LINE_ID.replace('l_orderkey', 'CAST(l_orderkey AS DECIMAL(19, 0))')} AS DECIMAL(38, 0))")


#: Views whose rows stand for distinct keys of a table: Spark finds those as numbers before it makes texts of them.
KEYS = {"functions": ("lineitem", ["l_suppkey", "l_partkey"])}


def by_keys(spark: SparkSession, sql: str, name: str, rows: DataFrame, keys: list[str], distinct: bool = False) -> DataFrame:
    """A `SELECT DISTINCT` over one table whose columns are as good as `keys`, with those found first, unless `rows` are `distinct`."""
    return spark.sql(sql.replace("SELECT DISTINCT", "SELECT", 1), **{name: rows if distinct else rows.select(*keys).distinct()})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the tables of a folder."""
    sql = VIEWS[name]
    if name in KEYS:
        of, keys = KEYS[name]
        return by_keys(spark, sql, of, table(spark, sf_dir, of), keys)
    if LINE_ID in sql:
        sql = with_line_ids(sql, table(spark, sf_dir, "lineitem"))
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", sql))})


def oracle(sql: str) -> str:
    """A SQL twin: the views it names are put in front, as WITH clauses."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    body = sql.strip()
    parts = [f"{n} AS ({VIEWS[n].replace('{', '').replace('}', '')})" for n in used]
    if body[:5].upper() == "WITH ":
        return f"WITH {', '.join(parts)}, {body[5:]}" if parts else body
    return f"WITH {', '.join(parts)} {body}" if parts else body
