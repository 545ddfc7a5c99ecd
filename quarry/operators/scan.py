"""Scanning text: files, lines, search, and cue-and-regex patterns with confidence.

A catalogue of patterns is compiled to literal column expressions, so that each regex is compiled once and a
scan is one pass without a join. `doc_id` names a text, `text` holds it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.columns import choose, language_of, topk_per_group
from quarry.sources.shared import once_each

#: Points of a match by severity, and the least score of each risk level.
WEIGHTS = {"critical": 100, "high": 70, "medium": 40, "low": 20, "advisory": 10}
LEVELS = [(80, "Critical"), (60, "High"), (40, "Medium"), (20, "Low")]
#: What a cue, a regex hit, a domain and a function hint add, the least confidence, and cues kept.
CUE, REGEX, DOMAIN, HINT, LEAST, CUES_KEPT = 0.15, 0.30, 0.20, 0.25, 0.2, 5
#: Words that are no keywords.
STOP_WORDS = ["the", "is", "a", "an", "in", "on", "of", "for", "to", "with", "without", "not", "and", "or", "but"]
#: Folders and files that are not scanned.
SKIPPED = r"(^|/)(build|tests|\.git|node_modules|__pycache__|target|dependencies)/|_tests?\.move$|\.(bin|png|jpg|zip|exe)$"


@dataclass(frozen=True)
class Pattern:
    pattern_id: str
    title: str
    severity: str
    tags: tuple[str, ...]
    cues: tuple[str, ...]
    regex: str = ""
    function: str = ""
    recommendation: str = ""


def read_source_tree(spark: SparkSession, root: str, suffix: str = ".move") -> DataFrame:
    """`project, path, content` of all source files below a folder; a project's `sources/` are preferred where it has any."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{suffix}").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    rows = rows.withColumn("project", F.regexp_extract("path", r"([^/]+)/(?:sources/)?[^/]+$", 1)).withColumn("in_sources", F.col("path").contains("/sources/"))
    has = rows.groupBy("project").agg(F.max("in_sources").alias("any"))
    return rows.join(has, "project").where(~F.col("any") | F.col("in_sources")).select("project", "path", "content")


def exclude_paths(files: DataFrame) -> DataFrame:
    return files.where(~F.lower("path").rlike(SKIPPED))


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language_of(F.col("path")))


def read_patterns_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """The pattern catalogue, as `match_catalogue` and `cue_scan` take it; blank and broken lines are skipped."""
    schema = "seq long, pattern_id string, title string, severity string, issue_tags array<string>, detection_cues array<string>, pattern string, function string, module_path string, recommendation string"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("pattern_id IS NOT NULL")


def write_patterns_jsonl(patterns: DataFrame, path: str) -> None:
    patterns.write.json(path)


def explode_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """Numbered lines, from 1."""
    rest = [c for c in files.columns if c != content]
    return files.select(*rest, F.posexplode(F.split(content, "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def brace_depth(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Depth of braces before and after each line, those within double quotes not counted."""
    from pyspark.sql import Window

    bare = F.regexp_replace("line", r'"[^"]*"', "")
    step = F.regexp_count(bare, F.lit(r"\{")) - F.regexp_count(bare, F.lit(r"\}"))
    after = F.sum("__step").over(Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("__step", step).withColumn("depth_after", after).withColumn("depth_before", F.col("depth_after") - F.col("__step")).drop("__step")


def search_lines(files: DataFrame, query: str, suffix: str | None = None, limit: int | None = None) -> DataFrame:
    """Lines that contain the query, with its place in the line; case counts."""
    lines = explode_lines(files if suffix is None else files.where(F.col("path").endswith(suffix)))
    at = F.instr("line", query) - 1
    hits = lines.where(F.col("line").contains(query)).select("path", "line_no", F.trim("line").alias("text"), at.alias("match_start"), (at + len(query)).alias("match_end"))
    return hits if limit is None else hits.orderBy("path", "line_no").limit(limit)


def content_keys(files: DataFrame, kind: str = "code", content: str = "content") -> DataFrame:
    """A key of each content, by which unchanged files are recognised."""
    return files.withColumn("content_key", F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(F.coalesce(content, F.lit("")), 256), 1, 32)))


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    return content_keys(files).join(known.select("content_key"), "content_key", "left_anti")


def file_tree_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("project", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.count(F.lit(1)).alias("files"))


def _match(pattern: Pattern, number: int, cues: dict[str, Column], regex: Column, domain: Column | None, hints: Column | None) -> tuple[Column, list[Column]]:
    """What a text with any of a pattern's cues scores, and the row of the match without its score."""
    count = reduce(lambda a, b: a + b, [cues[c.lower()].cast("int") for c in pattern.cues])
    score = count * F.lit(CUE)
    if pattern.regex:
        score = score + F.when(regex, REGEX).otherwise(0.0)
    if domain is not None:
        score = score + F.when(F.arrays_overlap(domain, F.array(*map(F.lit, pattern.tags))), DOMAIN).otherwise(0.0)
    if hints is not None and pattern.function:
        score = score + F.when(F.array_contains(hints, pattern.function), HINT).otherwise(0.0)
    any_cue = reduce(lambda a, b: a | b, [cues[c.lower()] for c in pattern.cues])
    matched = F.concat(*[F.when(cues[c.lower()], F.array(F.lit(c))).otherwise(F.array().cast("array<string>")) for c in pattern.cues])
    row = [F.lit(pattern.pattern_id).alias("pattern_id"), F.lit(number).alias("seq"), F.lit(pattern.title).alias("title"), F.lit(pattern.severity).alias("severity"), F.lit(pattern.recommendation).alias("recommendation"), F.slice(matched, 1, CUES_KEPT).alias("matched_cues")]
    return F.when(any_cue, F.round(F.least(score, F.lit(1.0)), 6)), row


def match_patterns(docs: DataFrame, patterns: list[Pattern], domain: str | None = None, hints: str | None = None, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """A row for each text and pattern that fits: a cue at least, and confidence from cues, regex and hints.

    Step by step, each a plain projection of what the step before worked out once: the lower-cased text, whether each
    distinct cue occurs, whether the regex of a pattern with a cue fits, and scores.
    """
    patterns = [(i, p) for i, p in enumerate(patterns) if p.cues]
    if not patterns:
        return match_patterns(docs, [Pattern("", "", "", (), ("x",))], None, None, keys, text).where(F.lit(False))
    places = {c: f"__cue{i}" for i, c in enumerate(dict.fromkeys(c.lower() for _, p in patterns for c in p.cues))}
    cues = {c: F.col(place) for c, place in places.items()}
    kept = list(dict.fromkeys([*keys, *[c for c in (domain, hints) if c]]))
    rows = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__text")).select(*kept, "__text", F.lower("__text").alias("__lower"))
    rows = rows.select(*kept, "__text", *[F.contains("__lower", F.lit(c)).alias(place) for c, place in places.items()])
    asked = {i: reduce(lambda a, b: a | b, [cues[c.lower()] for c in p.cues]) for i, p in patterns}
    rows = rows.select(*kept, *places.values(), *[(asked[i] & F.col("__text").rlike(f"(?i){p.regex}")).alias(f"__regex{i}") for i, p in patterns if p.regex])
    made = {i: _match(p, i, cues, F.col(f"__regex{i}"), domain and F.col(domain), hints and F.col(hints)) for i, p in patterns}
    rows = rows.select(*keys, *places.values(), *[score.alias(f"__score{i}") for i, (score, _) in made.items()])
    found = F.array(*[F.when(F.col(f"__score{i}") >= LEAST, F.struct(*row, F.col(f"__score{i}").alias("confidence"))) for i, (_, row) in made.items()])
    return rows.select(*keys, F.inline(found)).where("pattern_id IS NOT NULL")


def match_repeated(docs: DataFrame, patterns: list[Pattern], domain: str | None = None, hints: str | None = None, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`match_patterns` for texts that repeat, as vendored and generated code does: a text is scanned once, whatever number of rows have it."""
    columns = [c for c in (text, domain, hints) if c]
    told = docs.select(*[F.col(k).alias(f"__of_{k}") for k in keys], *columns)
    found = once_each(told, columns, lambda rows: match_patterns(rows, patterns, domain, hints, ("__key",), text))
    return found.select(*[F.col(f"__of_{k}").alias(k) for k in keys], *[c for c in found.columns if not c.startswith("__of_")])


def dedupe_by_title(matches: DataFrame, rank: str = "source_rank") -> DataFrame:
    """One match of each title in a text: regex hits before vector hits, then catalogue order."""
    return topk_per_group(matches, ["doc_id", "title"], [F.asc(rank), F.asc("seq")], 1)


def scan_risk_score(matches: DataFrame) -> DataFrame:
    weight = choose([(F.col("severity") == s, w) for s, w in WEIGHTS.items()], 10)
    total = F.round(F.sum(weight * F.col("confidence")), 6)
    return matches.groupBy("doc_id").agg(F.least(F.lit(100), F.floor(total)).cast("int").alias("risk_score"))


def severity_line() -> Column:
    return F.concat_ws(", ", *[F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}"))) for s in WEIGHTS])


def scan_summary(matches: DataFrame) -> DataFrame:
    """Severity counts of each text and a line of text of those that are not 0."""
    counts = matches.groupBy("doc_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in WEIGHTS])
    return counts.withColumn("summary", severity_line())


def scan_risk_level(score: Column) -> Column:
    return choose([(score >= low, name) for low, name in LEVELS], "Minimal")


def scan_report(docs: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """Risk score, level and severity counts of each text with a match: one scan, and one exchange for the titles."""
    found = match_patterns(docs, patterns).groupBy("doc_id", "title").agg(F.min_by(F.struct("severity", "confidence"), "seq").alias("m")).select("doc_id", "m.*")
    weight = choose([(F.col("severity") == s, w) for s, w in WEIGHTS.items()], 10)
    rows = found.groupBy("doc_id").agg(F.least(F.lit(100), F.floor(F.round(F.sum(weight * F.col("confidence")), 6))).cast("int").alias("risk_score"), *[F.count_if(F.col("severity") == s).alias(s) for s in WEIGHTS])
    return rows.withColumns({"summary": severity_line(), "risk_level": scan_risk_level(F.col("risk_score"))})


def priority_warnings(matches: DataFrame, n: int = 5) -> DataFrame:
    urgent = matches.where(F.col("severity").isin("critical", "high"))
    return topk_per_group(urgent, ["doc_id"], [F.asc("seq")], n, "rank")


def keywords(text: Column, n: int = 10) -> Column:
    """The first n lower-case identifiers of three letters or more that are no stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?<![a-z0-9_])([a-z_][a-z0-9_]*)(?![a-z0-9_])"), 1)
    return F.slice(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS)), 1, n)


def strip_comments(text: Column) -> Column:
    """Without line and block comments, white space in single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/|//[^\n]*", " "), r"\s+", " "))


def snippet_around(lines: DataFrame, hits: DataFrame, n: int = 3) -> DataFrame:
    """Numbered lines around each hit, which is marked; a hit beyond the end gives the first 2n lines. Lines meet hits on path and a block of lines, in sort-merge joins: neither side is small."""
    size = 2 * n + 1
    ends = lines.groupBy("path").agg(F.max("line_no").alias("last"))
    placed = hits.join(ends.hint("merge"), "path").withColumn("inside", F.col("hit") <= F.col("last"))
    placed = placed.withColumn("low", F.when(F.col("inside"), F.col("hit") - n).otherwise(1)).withColumn("high", F.when(F.col("inside"), F.col("hit") + n).otherwise(2 * n))
    blocks = placed.withColumn("block", F.explode(F.sequence((F.greatest("low", F.lit(1)) / size).cast("int"), (F.col("high") / size).cast("int"))))
    joined = blocks.join(lines.withColumn("block", (F.col("line_no") / size).cast("int")).hint("merge"), ["path", "block"]).where("line_no BETWEEN low AND high")
    mark = F.when(F.col("inside") & (F.col("line_no") == F.col("hit")), ">").otherwise(" ")
    shown = F.struct("line_no", F.concat(mark, F.col("line_no").cast("string"), F.lit("| "), F.col("line")).alias("shown"))
    return joined.groupBy("path", "hit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda s: s["shown"]), "\n").alias("snippet"))
