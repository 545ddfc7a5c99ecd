"""Search by a stored index: which texts have which runs of three characters, and the texts themselves in parts.

A query's own runs, or those that a regular expression can't match without, are looked up in the postings; the
texts that have the rarest of them are read, only from the parts that they lie in, and verified. A query without
such runs reads all texts.
"""

from __future__ import annotations

from re import _constants, _parser, error

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.scan import explode_lines
from quarry.sources.shared import FEW_ROWS, kept_table

#: Characters of a run, runs of a query that are looked up (the rarest), folders of postings and of texts, and shares of a folder of postings.
RUN, LOOKED_UP, POSTING_PARTS, TEXT_PARTS, SHARES = 3, 3, 64, 256, 16
ALL_RUNS = r"(?s)(?=(.{%d}))" % RUN


def build_search_index(texts: DataFrame, path: str, key: str = "doc_id", text: str = "text", posting_parts: int = POSTING_PARTS, text_parts: int = TEXT_PARTS) -> None:
    """Writes the index of `texts` below `path`. Null texts are left out; repeated keys are texts each.

    Postings are dealt by run and text part, so that those of a run that all texts have fill many files; ranges would
    take all runs out of all texts once more, for a sample.
    """
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(key)), F.lit(text_parts)).cast("int").alias("part"))
    rows.repartition("part").write.partitionBy("part").parquet(f"{path}/texts")
    runs = rows.select("key", "part", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(ALL_RUNS), 1))).alias("run"))
    runs = runs.withColumn("of_run", F.pmod(F.xxhash64("run"), F.lit(posting_parts)).cast("int"))
    runs.repartition("of_run", F.pmod("part", F.lit(SHARES))).sortWithinPartitions("of_run", "run").write.partitionBy("of_run").parquet(f"{path}/postings")
    stored = texts.sparkSession.read.parquet(f"{path}/postings")
    stored.groupBy("of_run", "run").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/counts")


def certain_literals(pattern: str) -> list[str]:
    """Texts that every match of a regular expression contains; none where that can't be told."""

    def of(parsed) -> list[str]:
        found, run = [], ""
        for op, what in parsed:
            if op is _constants.LITERAL and what < 128:
                run += chr(what)
                continue
            found.append(run)
            run = ""
            if op is _constants.SUBPATTERN:
                found += of(what[3])
            elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT, _constants.POSSESSIVE_REPEAT) and what[0] > 0:
                found += of(what[2])
        return [*found, run]

    try:
        return [x for x in of(_parser.parse(pattern)) if x]
    except error:
        return []


def runs_of(literals: list[str]) -> list[str]:
    every = {x.lower()[i : i + RUN] for x in literals for i in range(len(x) - RUN + 1)}
    return sorted(x for x in every if x.isascii())


def text_parts(spark: SparkSession, path: str, runs: list[str]) -> tuple[DataFrame | None, list[int] | None]:
    """Keys of the texts that have the rarest of some runs, and the parts that these lie in; None: any text, all parts."""
    if not runs:
        return None, None
    counts = spark.read.parquet(f"{path}/counts").where(F.col("run").isin(runs)).orderBy("n", "run").limit(LOOKED_UP).collect()
    known = spark.read.parquet(f"{path}/counts").where(F.col("run").isin(runs)).count()
    if known < len(runs):
        return None, []  # no text has them all
    rare = [r["run"] for r in counts]
    postings = spark.read.parquet(f"{path}/postings").where(F.col("of_run").isin([r["of_run"] for r in counts]) & F.col("run").isin(rare))
    keys = postings.groupBy("key", "part").agg(F.count_distinct("run").alias("n")).where(F.col("n") == len(rare)).select("key", "part")
    return keys, [r["part"] for r in keys.select("part").distinct().collect()]  # no more than there are parts


def search_index(spark: SparkSession, path: str, query: str, regex: bool = False) -> DataFrame:
    """`key, text` of the indexed texts that contain the query, case ignored, or that the regular expression finds."""
    texts = spark.read.parquet(f"{path}/texts")
    keys, parts = text_parts(spark, path, runs_of(certain_literals(query) if regex else [query]))
    if parts is not None:
        texts = texts.where(F.col("part").isin(parts)) if parts else texts.where("false")
    if keys is not None:
        texts = texts.join(keys.drop("part").distinct(), "key", "left_semi")
    return texts.where(F.regexp_like("text", F.lit(query)) if regex else F.contains(F.lower("text"), F.lit(query.lower()))).select("key", "text")


def first_hits(hits: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    """The first n rows of a search with the `total` of all; no rows where there are none."""
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    return hits.orderBy(*order).limit(n).crossJoin(F.broadcast(total))  # one row


def named_lines(lines: DataFrame, word: str, names: DataFrame) -> DataFrame:
    """Rows of `lines` and `names` (`name`, and more) where the line holds `word` with the name right after it.

    What follows the word is cut to each length that a name has, so that names are met by equality: names that begin
    alike cost no more than those that don't. Repeated if the line holds them repeatedly.
    """
    names = kept_table(names, "names")
    sizes = sorted(r["n"] for r in names.select(F.length("name").alias("n")).distinct().collect())  # no more than the longest name has characters
    if not sizes:
        return lines.limit(0).crossJoin(names.limit(0))
    few = names.limit(FEW_ROWS + 1).count() <= FEW_ROWS
    after = F.regexp_extract_all("line", F.lit(f"(?s)(?={word}(.{{0,{sizes[-1]}}}))"), F.lit(1))
    cut = lines.where(F.col("line").contains(word)).withColumn("__after", F.explode(after)).withColumn("__n", F.explode(F.array(*map(F.lit, sizes))))
    cut = cut.where(F.length("__after") >= F.col("__n")).withColumn("name", F.substring(F.col("__after"), F.lit(1), F.col("__n"))).drop("__after", "__n")
    return cut.join(F.broadcast(names) if few else names.hint("merge"), "name")


def locate(files: DataFrame, requests: DataFrame) -> DataFrame:
    """`module, function, path, line_start, line_end` of requested places; nulls where there is none.

    `files`: path, content; `requests`: module, function (null: the module alone). The module is the first line with
    `module <name>`, its last segment or all segments joined by `_`; the function the first line from there on with
    `fun <name>`, in the first file (by path) that has both. It ends where its braces are closed, else where it begins.
    """
    asked = requests.select("module", "function").distinct()
    segments = F.split("module", "::")
    names = F.array_distinct(F.array(F.element_at(segments, -1), F.array_join(segments, "_")))
    lines = explode_lines(files.select("path", "content"))
    heads = named_lines(lines, "module ", asked.where("module <> ''").select("module", F.explode(names).alias("name")).where("name IS NOT NULL").distinct())
    modules = heads.groupBy("module", "path").agg(F.min("line_no").alias("module_line"))
    funs = named_lines(lines, "fun ", asked.where("function <> ''").select("function", F.col("function").alias("name")).distinct()).select("path", "line_no", "function")
    # requests and files may be few bytes on disk and yet not small enough to be sent to all tasks
    wanted = asked.hint("merge").join(modules.hint("merge"), "module")
    alone = wanted.where("coalesce(function, '') = ''").groupBy("module", "function").agg(F.min_by(F.struct("path", F.col("module_line").alias("line_start"), F.col("module_line").alias("line_end")), "path").alias("at"))
    starts = wanted.join(funs, ["path", "function"]).where("line_no >= module_line").groupBy("module", "function", "path").agg(F.min("line_no").alias("line_start"))
    first = starts.groupBy("module", "function").agg(F.min_by(F.struct("path", "line_start"), "path").alias("at")).select("module", "function", "at.*")
    step = lambda s, x: F.struct(
        (s["n"] + F.when(s["end"] == 0, x["net"]).otherwise(0)).alias("n"),
        (s["open"] | x["opens"]).alias("open"),
        (s["at"] + 1).alias("at"),
        F.when((s["end"] == 0) & (s["open"] | x["opens"]) & (s["n"] + x["net"] == 0), s["at"]).otherwise(s["end"]).alias("end"),
    )
    braces = lambda x: F.struct((F.regexp_count(x, F.lit(r"\{")) - F.regexp_count(x, F.lit(r"\}"))).alias("net"), x.contains("{").alias("opens"))
    texts = files.select("path", F.split("content", "\n", -1).alias("lines"))
    rest = F.transform(F.slice("lines", F.col("line_start"), F.size("lines")), braces)
    end = F.aggregate(rest, F.struct(F.lit(0).alias("n"), F.lit(False).alias("open"), F.col("line_start").alias("at"), F.lit(0).alias("end")), step, lambda s: s["end"])
    ended = first.hint("merge").join(texts.hint("merge"), "path").withColumn("end", end).select("module", "function", F.struct("path", "line_start", F.when(F.col("end") > 0, F.col("end")).otherwise(F.col("line_start")).alias("line_end")).alias("at"))
    found = alone.unionByName(ended).select(F.col("module").alias("__m"), F.col("function").alias("__f"), "at")
    return requests.hint("merge").join(found.hint("merge"), (F.col("module") == F.col("__m")) & F.col("function").eqNullSafe(F.col("__f")), "left").select("module", "function", "at.path", "at.line_start", "at.line_end")
