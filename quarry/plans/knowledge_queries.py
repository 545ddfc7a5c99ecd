"""Queries on issue records: Markdown reports written out from `part`, a report for each brand."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.knowledge_data import KEYWORD_TOPICS
from quarry.operators import knowledge as op
from quarry.plans.stand_ins import oracle, table, view

ISSUE = """SELECT p_brand AS path, p_partkey AS seq, replace(concat('## H-', p_partkey, ': Item of ', p_name, '~**Severity: ', CASE p_size % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' WHEN 2 THEN 'Unknown' ELSE 'Medium' END, '**~',
    '### Description~The oracle price in pool::swap', p_size, ' is stale', CASE WHEN p_size % 2 = 0 THEN ' and vault.total grows' ELSE '' END, ' for max_fee~~### Recommendation~Check min_out', CASE WHEN p_size % 3 = 0 THEN '~Status: acknowledged' ELSE '' END), '~', chr(10)) AS chunk FROM {part}"""
SQL_ISSUE = ISSUE.replace("{part}", "part")


def issue_rows(s, d):
    return s.sql(ISSUE, part=table(s, d, "part"))


def reports(s, d):
    chunks = F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"])
    return issue_rows(s, d).groupBy("path").agg(F.concat(F.lit("# Report\n"), F.array_join(chunks, "\n")).alias("content"))


def parsed(s, d):
    return op.parse_issues(op.split_issues(reports(s, d)))


def joined(df, *columns):
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


QUERIES = {
    "b1_split_issues": lambda s, d: op.split_issues(reports(s, d)).select("path", "issue_id", "chunk"),
    "b2_section": lambda s, d: op.split_issues(reports(s, d)).select("path", "issue_id", op.section(F.col("chunk"), "Description").alias("description"), op.section(F.col("chunk"), "Recommendation").alias("recommendation")),
    "b3_guess_severity": lambda s, d: issue_rows(s, d).select("seq", op.guess_severity(F.col("chunk")).alias("severity")),
    "b4_issue_tags": lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(op.issue_tags(F.col("text")), ",").alias("tags")),
    "b5_detection_cues": lambda s, d: issue_rows(s, d).select("seq", F.array_join(op.detection_cues(F.col("chunk")), ",").alias("cues")),
    "b6_parse_issues": lambda s, d: parsed(s, d).select("path", "issue_id", "title", "severity", "function", "remediation_status"),
    "b7_embedding_text": lambda s, d: op.embedding_text(parsed(s, d)).select("path", "issue_id", "embedding_text"),
    "v8_query_text": lambda s, d: op.query_text(view(s, d, "findings").withColumn("cues", F.split("title", " "))).select("seq", "finding_id", "query_text"),
    "o11_knowledge_topics": lambda s, d: joined(op.knowledge_topics(view(s, d, "findings").select("finding_id", "title", "description", "category").distinct(), op.topic_words(s)), "topics").select("finding_id", "topics", "title"),
    "o11_topics_of_documents": lambda s, d: op.knowledge_topics(table(s, d, "documents").select(F.col("doc_id").alias("finding_id"), F.lit("").alias("title"), F.col("text").alias("description"), F.col("source").alias("category")), op.topic_words(s)).select(F.col("finding_id").alias("doc_id"), F.array_join("topics", ",").alias("topics")),
}

STATED = "CASE p_size % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 3 THEN 'medium' END"
DESCRIBED = "concat('The oracle price in pool::swap', p_size, ' is stale', CASE WHEN p_size % 2 = 0 THEN ' and vault.total grows' ELSE '' END, ' for max_fee')"
ADVICE = "concat('Check min_out', CASE WHEN p_size % 3 = 0 THEN concat(chr(10), 'Status: acknowledged') ELSE '' END)"
TAG_LIST = "[" + ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{t}' END" for w, t in op.TAGS.items()) + "]"

def sql_topic(word, topics):
    hit = f"regexp_matches(c, '{word}')" if ".*" in word else f"contains(c, '{word}')"
    return f"CASE WHEN {hit} THEN {topics} ELSE []::VARCHAR[] END"


TOPIC_LIST = f"array_to_string(list_sort(list_distinct(flatten([{', '.join(sql_topic(w, t) for w, t in KEYWORD_TOPICS.items())}])))[1:3], ',')"

ORACLES = {
    "b1_split_issues": f"SELECT path, concat('H-', seq) AS issue_id, chunk FROM ({SQL_ISSUE})",
    "b2_section": f"SELECT p_brand AS path, concat('H-', p_partkey) AS issue_id, {DESCRIBED} AS description, {ADVICE} AS recommendation FROM part",
    "b3_guess_severity": f"SELECT p_partkey AS seq, {STATED} AS severity FROM part",
    "b4_issue_tags": f"SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct({TAG_LIST})), ','), '') AS tags FROM documents",
    "b5_detection_cues": "SELECT p_partkey AS seq, concat('max_fee,min_out,pool::swap', p_size, CASE WHEN p_size % 2 = 0 THEN ',vault.total' ELSE '' END) AS cues FROM part",
    "b6_parse_issues": f"SELECT p_brand AS path, concat('H-', p_partkey) AS issue_id, concat('Item of ', p_name) AS title, {STATED} AS severity, concat('pool::swap', p_size) AS function, CASE WHEN p_size % 3 = 0 THEN 'acknowledged' ELSE 'pending' END AS remediation_status FROM part",
    "b7_embedding_text": f"SELECT p_brand AS path, concat('H-', p_partkey) AS issue_id, concat_ws(chr(10), concat('Item of ', p_name), {DESCRIBED}, {ADVICE}, 'fee | oracle') AS embedding_text FROM part",
    "v8_query_text": oracle("SELECT seq, finding_id, concat_ws(' | ', category, array_to_string(string_split(title, ' ')[1:5], ' '), description, severity) AS query_text FROM findings"),
    "o11_knowledge_topics": oracle(f"SELECT finding_id, {TOPIC_LIST} AS topics, title FROM (SELECT DISTINCT finding_id, title, lower(concat(coalesce(title, ''), ' ', coalesce(description, ''), ' ', coalesce(category, ''))) AS c FROM findings)"),
    "o11_topics_of_documents": f"SELECT doc_id, {TOPIC_LIST} AS topics FROM (SELECT doc_id, lower(concat(' ', text, ' ', source)) AS c FROM documents)",
}
