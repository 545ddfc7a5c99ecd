"""Look-ups that put code, types and similar issues beside functions and findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.functions.columns import any_in, choose, first_per_group, first_values, severity_rank, topk_per_group
from quarry.functions.exploit_data import LIBRARY_MODULES
from quarry.operators.code import function_description
from quarry.operators.knowledge import knowledge_topics
from quarry.operators.rules import language_gate
from quarry.operators.scan import keywords
from quarry.sources.shared import kept_table, once_each

#: Title words and the terms that code must have for a hit to be relevant.
CORE_CONCEPTS = {
    "recipient": ["recipient"], "oracle": ["oracle"], "whitelist": ["whitelist", "white_list"], "blacklist": ["blacklist", "black_list"], "admin": ["admin"], "owner": ["owner"],
    "governance": ["governance", "gov"], "timelock": ["timelock", "time_lock"], "pause": ["pause", "paused"], "upgrade": ["upgrade"], "proxy": ["proxy"], "delegate": ["delegate"],
    "callback": ["callback"], "reentrancy": ["reentrant", "reentrancy"], "slippage": ["slippage"], "deadline": ["deadline"], "nonce": ["nonce"], "signature": ["signature", "sig"],
}
#: Names of receipts and of functions that repay, and what shows that type, amount and pool are checked.
RECEIPTS, REPAYS = ["receipt", "flashreceipt", "flashloanreceipt", "loan"], ["repay", "repay_flashloan", "repay_flash", "return_loan"]
TYPE_CHECKS = [r"type_name::get<.*>\s*\(\)\s*.*==.*type_name", r"type_name\s*==\s*type_name::get", r"assert!.*type_name.*==", r"ETypeMismatch"]
AMOUNT_CHECKS = [r"assert!.*coin::value.*>=", r"assert!.*amount.*==", r"ERepayAmountMismatch", r"repay_amount"]
POOL_CHECKS = [r"object::id\(pool\)\s*==", r"pool_id\s*==", r"EPoolIdMismatch"]

#: An object whose braces pair up, with one more level within.
BALANCED = r"\{[^{}]*(?:\{[^{}]*\}[^{}]*){0,500}\}"


def type_definitions(tokens: DataFrame, types: DataFrame) -> DataFrame:
    """The definition of each named type: one of the own project before one of a dependency. `tokens`: project, func_id, token; `types`: project, name, type_id, is_dependency.

    The first definition of each name, in a project and among dependencies, is found before tokens meet it, so that rows don't multiply.
    """
    first = F.min(F.struct("is_dependency", "type_id"))
    own = types.groupBy("project", F.col("name").alias("token")).agg(first.alias("own"))
    shared = types.where("is_dependency").groupBy(F.col("name").alias("token")).agg(first.alias("shared"))
    rows = tokens.dropDuplicates(["project", "func_id", "token"]).join(own, ["project", "token"], "left").join(shared, "token", "left")
    return rows.withColumn("best", F.least("own", "shared")).where("best IS NOT NULL").select(*tokens.columns, "best.type_id", "best.is_dependency")


def resolve_external(calls: DataFrame, dependencies: DataFrame) -> DataFrame:
    """External `module::f` calls with the function of a dependency that they name, or null."""
    keys = dependencies.groupBy(F.concat_ws("::", "module", "name").alias("short")).agg(F.min_by("func_id", "seq").alias("dependency_id"))
    parts = F.split("raw_call", "::")
    short = F.when(F.size(parts) >= 2, F.concat_ws("::", F.try_element_at(parts, F.lit(-2)), F.element_at(parts, -1)))
    return calls.withColumn("short", short).join(keys, "short", "left").drop("short")


def function_context(functions: DataFrame, edges: DataFrame, types: DataFrame, callers: int = 5, callees: int = 5, definitions: int = 10) -> DataFrame:
    """One row a function: its first callers, the bodies of its first callees, and its types. `types`: func_id, token.

    Edges and types without a name are left out.
    """
    # both ends at once, so that callers and callees share one reading of the edges
    edges = edges.where("from_id IS NOT NULL AND to_id IS NOT NULL")
    first = lambda rows, value, k, name: first_values(topk_per_group(rows, ["func_id"], [F.asc(value)], k), ["func_id"], [F.asc(value)], k, F.col(value), name)
    up = first(edges.select(F.col("to_id").alias("func_id"), "from_id"), "from_id", callers, "callers")
    body = functions.select(F.col("func_id").alias("to_id"), F.col("body").alias("callee_body"))
    called = topk_per_group(edges.select(F.col("from_id").alias("func_id"), "to_id"), ["func_id"], [F.asc("to_id")], callees).join(body, "to_id")
    down = first_values(called, ["func_id"], [F.asc("to_id")], callees, F.struct("to_id", "callee_body"), "callees")
    kinds = first(types.where("token IS NOT NULL"), "token", definitions, "types")
    rows = functions.join(up, "func_id", "left").join(down, "func_id", "left").join(kinds, "func_id", "left")
    none = F.array().cast("array<string>")
    return rows.withColumns({"callers": F.coalesce("callers", none), "types": F.coalesce("types", none)})


def make_chunks(functions: DataFrame, types: DataFrame) -> DataFrame:
    """A retrieval chunk for each function: signature, description, risk, the structs of its module that its signature names, and the text to embed.

    `types`: module, type_name; those of a module meet each function as one array. A null part of a function is
    left out of its text.
    """
    of_module = types.groupBy("module").agg(F.array_sort(F.collect_set("type_name")).alias("__types"))
    signature = F.concat_ws(" ", "params", "return_type")
    related = F.filter("__types", lambda t: F.contains(signature, t))
    rows = functions.join(of_module, "module", "left").select(*functions.columns, F.coalesce(related, F.array().cast("array<string>")).alias("related"))
    told = function_description(F.col("name"), F.col("visibility"))
    chunks = rows.withColumns({
        "signature": F.concat(F.lit("fun "), "name", F.lit("("), F.coalesce("params", F.lit("")), F.lit(")"), F.coalesce(F.concat(F.lit(": "), F.nullif("return_type", F.lit(""))), F.lit(""))),
        "description": F.when(told != "", F.concat("module", F.lit("::"), "name", F.lit(" - "), told)).otherwise(""),
    })
    part = lambda label, c: F.concat(F.lit(label), c)
    return chunks.withColumn("embedding_text", F.concat_ws("\n", part("Module: ", F.col("module")), part("Function: ", F.col("name")), part("Signature: ", F.col("signature")), part("Description: ", F.nullif("description", F.lit(""))), part("Code:\n", F.col("body"))))


def function_code(requests: DataFrame, functions: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Which function a requested `module::f` stands for: `request, func_id, origin, corrected`; nulls on a miss.

    In order: a stub where the module's last part is one of the standard library; the exact id; the same name in a
    module of that name or with that last part; a dependency as it stands, below `sui` or below `std`; the first
    function of that name, flagged as corrected.
    """
    parts = F.split("request", "::")
    module, name = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "::"), F.element_at(parts, -1)
    rows = requests.select("request").distinct().withColumns({"module": module, "f": name, "m": F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))})
    short = F.concat_ws("::", "m", "f")
    paths = [F.concat_ws("::", F.lit(lead), "module", "f") if lead else F.col("request") for lead in ("", "sui", "std")]
    tries = [("index", F.col("request")), ("module", short), *[("dependency", p) for p in [*paths, short]], ("name", F.col("f"))]
    asked = rows.select("request", F.inline(F.array(*[F.struct(F.lit(n).alias("place"), F.lit(kind).alias("kind"), key.alias("k")) for n, (kind, key) in enumerate(tries, 1)])))
    keyed = lambda rows, kind, key: rows.select(F.lit(kind).alias("kind"), key.alias("k"), "func_id", "seq")
    of_module = F.concat_ws("::", F.element_at(F.split("module", "::"), -1), "name")
    known = [keyed(functions, "index", F.col("func_id")), keyed(functions, "module", of_module), keyed(dependencies, "dependency", F.col("func_id")), keyed(dependencies, "dependency", F.concat_ws("::", "module", "name")), keyed(functions, "name", F.col("name"))]
    keys = reduce(DataFrame.unionByName, known).groupBy("kind", "k").agg(F.min_by("func_id", "seq").alias("func_id"))
    stubs = rows.where(F.col("m").isin(LIBRARY_MODULES)).select("request", F.lit(0).alias("place"), F.lit("library").alias("kind"), F.concat_ws("::", F.lit("sui"), "module", "f").alias("func_id"))
    hits = stubs.unionByName(asked.join(keys, ["kind", "k"]).select("request", "place", "kind", "func_id"))
    best = first_per_group(hits, ["request"], [F.asc("place")]).select("request", "func_id", F.col("kind").alias("origin"))
    return requests.join(best, "request", "left").withColumn("corrected", F.coalesce(F.col("origin") == "name", F.lit(False)))


def risky_by_type(functions: DataFrame, kind: str = "all") -> DataFrame:
    """Functions of a kind of risk: access, state, funds (state changes on coins or balances) or all."""
    coins = F.col("params").contains("Coin") | F.col("params").contains("Balance")
    test = {"all": F.col("risk_score") > 0, "access": F.col("access_control") > 0, "state": F.col("state_modification") > 0, "funds": (F.col("state_modification") > 0) & coins}[kind]
    return functions.where(test)


def scannable(functions: DataFrame) -> DataFrame:
    """Functions that are no tests, by name, path or imports."""
    name = F.col("name")
    return functions.where(~(name.startswith("test_") | name.endswith("_test") | F.col("path").rlike("(^|/)tests?/") | F.exists("uses", lambda u: u.contains("test_only"))))


def flashloan_check(types: DataFrame, functions: DataFrame) -> DataFrame:
    """Of each project: the first receipt, whether it must be used up, the first function that repays, and what that one checks; case doesn't count."""
    receipt = types.where(any_in(F.lower("name"), RECEIPTS)).groupBy("project").agg(F.min_by(F.struct("name", "abilities"), "seq").alias("r"))
    repay = functions.where(any_in(F.lower("name"), REPAYS)).groupBy("project").agg(F.min_by(F.struct("name", "body"), "seq").alias("f"))
    body = F.coalesce("f.body", F.lit(""))
    shows = lambda patterns: body.rlike(f"(?i){'|'.join(patterns)}")
    kept = F.col("r.name").isNotNull() & ~F.exists(F.coalesce("r.abilities", F.array().cast("array<string>")), lambda a: F.lower(a).contains("drop"))
    checks = {"hot_potato": kept, "checks_type": shows(TYPE_CHECKS), "checks_amount": shows(AMOUNT_CHECKS), "checks_pool": shows(POOL_CHECKS)}
    rows = receipt.join(repay, "project", "full").select("project", F.col("r.name").alias("receipt"), F.col("f.name").alias("repay"), *[c.alias(n) for n, c in checks.items()], (~checks["checks_type"] & body.contains("contains_type") & ~body.contains("type_name::get")).alias("type_confusion"))
    hot = F.col("hot_potato")
    verdict = choose([(hot & F.col("checks_type") & F.col("checks_amount") & F.col("checks_pool"), "checked"), (hot & F.col("checks_type"), "receipt and type checked"), (hot & F.col("type_confusion"), "type confusion"), (hot, "type not checked")], "to be reviewed")
    return rows.withColumn("verdict", verdict)


def first_lines(text: Column, regex: str, n: int) -> Column:
    """Line numbers of the first n matches of a regular expression, case ignored: lines before the match, counted in what
    splitting at the matches leaves."""
    pattern = F.lit(f"(?i)({regex})")
    whole = F.regexp_extract_all(text, pattern, 0)
    pieces = F.slice(F.split(text, f"(?i){regex}", n + 1), 1, F.least(F.lit(n), F.size(whole)))
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    steps = F.zip_with(pieces, F.slice(whole, 1, n), lambda piece, hit: F.struct(breaks(piece).alias("before"), breaks(hit).alias("within")))
    start = F.struct(F.lit(1).alias("line"), F.array().cast("array<int>").alias("hints"))
    return F.aggregate(steps, start, lambda s, x: F.struct((s["line"] + x["before"] + x["within"]).alias("line"), F.concat(s["hints"], F.array(s["line"] + x["before"])).alias("hints")), lambda s: s["hints"])


def line_hints(matches: DataFrame, docs: DataFrame, regex: str, n: int = 3, text: str = "text") -> DataFrame:
    """Line numbers of the first n matches of a pattern in each matched text; a text that repeats is searched once."""

    def hints_of(texts: DataFrame) -> DataFrame:
        rows = texts.select("__key", F.col(text).alias("rest"), F.lit(1).alias("line"), F.array().cast("array<int>").alias("hints"))
        for _ in range(n):
            at = F.regexp_instr("rest", F.lit(f"(?i){regex}"))
            line = F.col("line") + F.size(F.split(F.substring(F.col("rest"), F.lit(1), at - 1), "\n", -1)) - 1
            # the next search begins after the match, whose own lines count as well
            size = F.length(F.regexp_substr("rest", F.lit(f"(?i){regex}")))
            past = line + F.size(F.split(F.substring(F.col("rest"), at, size), "\n", -1)) - 1
            rows = rows.select("__key", F.when(at > 0, F.substring(F.col("rest"), at + size, F.length("rest"))).otherwise("").alias("rest"), F.when(at > 0, past).otherwise(F.col("line")).alias("line"), F.when(at > 0, F.concat("hints", F.array(line))).otherwise(F.col("hints")).alias("hints"))
        return rows.select("__key", "hints")

    return matches.join(once_each(docs.select("doc_id", text), [text], hints_of), "doc_id")


def pattern_line_hints(matches: DataFrame, docs: DataFrame, regexes: dict[str, str], n: int = 3, text: str = "text") -> DataFrame:
    """`doc_id, pattern_id, hints` of each match: line numbers of the first n hits of its pattern's regex; none without a regex."""
    found = matches.select("doc_id", "pattern_id").join(docs.select("doc_id", F.col(text).alias("__text")), "doc_id")
    hints = choose([(F.col("pattern_id") == p, first_lines(F.col("__text"), regex, n)) for p, regex in regexes.items()], None)
    return found.select("doc_id", "pattern_id", F.coalesce(hints, F.array().cast("array<int>")).alias("hints"))


def valid_locations(matches: DataFrame) -> DataFrame:
    """Matches of each pattern that point below the first line and not at a module's head."""
    return matches.where((F.col("line") > 1) & ~F.ltrim("context").startswith("module ")).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("valid"))


def core_concepts(title: Column) -> Column:
    """Terms that go with the words of a title."""
    found = [F.when(F.lower(title).contains(word), F.array(*map(F.lit, terms))) for word, terms in CORE_CONCEPTS.items()]
    return F.flatten(F.array_compact(F.array(*found)))


def matched_cues(code: Column, cues: Column, title: Column, n: int = 5) -> Column:
    """Cues of three letters or more that the code has, then words of the title that it has; the first n."""
    lower = F.lower(code)
    own = F.filter(cues, lambda c: (F.length(c) >= 3) & F.contains(lower, F.lower(c)))
    words = F.filter(F.split(F.lower(title), r"[^a-z0-9_]+"), lambda w: (F.length(w) >= 3) & F.contains(lower, w))
    return F.slice(F.array_union(own, words), 1, n)


def code_relevance(code: Column, title: Column, description: Column, function: Column, cues: Column) -> Column:
    """How well a similar issue fits code, 0 to 1; `cues` is one text, parts between ` | `.

    0.1 where a core concept of the title is missing. 0.15 where the description names two specific identifiers or
    more and seven tenths of them are missing (of the first five). Else the points of title words (1), function
    (1.5), cues (0.8) and names or quoted code of the description (0.6) that occur, over half of those tried; less
    where names occur neither whole nor in any part. 0.5 where there is nothing to try. Identifiers and names
    count in the order in which they are named.
    """
    lower, told = F.lower(F.coalesce(code, F.lit(""))), F.coalesce(description, F.lit(""))
    has = lambda x: F.contains(lower, F.lower(x))
    hits = lambda xs: F.size(F.filter(xs, has))
    concepts, words = core_concepts(title), keywords(F.coalesce(title, F.lit("")))
    named = F.coalesce(function, F.lit("")) != ""
    short = F.element_at(F.split(F.coalesce(function, F.lit("")), "::"), -1)
    parts = F.filter(F.transform(F.slice(F.split(F.coalesce(cues, F.lit("")), r" \| "), 1, 5), lambda c: F.trim(F.lower(c))), lambda c: F.length(c) >= 3)
    identifiers = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(told), F.lit(r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b"), 1)), lambda x: F.length(x) >= 8)
    missing = F.size(F.filter(F.slice(identifiers, 1, 5), lambda x: ~has(x)))
    quoted, names = F.regexp_extract_all(told, F.lit("`([^`]+)`"), 1), F.regexp_extract_all(F.lower(told), F.lit(r"\b([a-z_]+(?:_[a-z]+)+)\b"), 1)
    patterns = F.filter(F.slice(F.array_distinct(F.concat(quoted, names)), 1, 10), lambda x: F.length(x) >= 5)
    bad = F.size(F.filter(patterns, lambda x: ~has(x) & F.contains(x, F.lit("_")) & ~F.exists(F.split(x, "_"), has)))
    checks = F.size(words) + F.when(named, 1).otherwise(0) + F.size(parts) + F.size(patterns)
    points = hits(words) * 1.0 + F.when(named & has(short), 1.5).otherwise(0.0) + hits(parts) * 0.8 + hits(patterns) * 0.6
    base = F.least(F.lit(1.0), points / F.greatest(checks * 0.5, F.lit(1.0)))
    weighed = F.when(checks == 0, 0.5).otherwise(base * F.when(bad >= 2, 0.5).when(bad == 1, 0.7).otherwise(1.0))
    unlikely = (F.size(identifiers) >= 2) & (missing >= F.size(identifiers) * 0.7)
    return F.when(hits(concepts) < F.size(concepts), 0.1).when(unlikely, 0.15).otherwise(F.round(weighed, 6))


def semantic_matches(hits: DataFrame, k: int = 5, least: float = 0.3) -> DataFrame:
    """Similar issues that are relevant enough, their confidence times relevance, the best k of each query."""
    kept = hits.where(F.col("relevance") >= least).withColumn("confidence", F.round(F.col("confidence") * F.col("relevance"), 6))
    return topk_per_group(kept, ["query_id"], [F.desc("confidence"), F.asc("vec_id")], k, "rank")


def search_by_severity(hits: DataFrame, least: str, k: int = 5) -> DataFrame:
    """The nearest k hits of each query at or above a severity; `hits` should hold more than k a query."""
    floor = severity_rank(F.lit(least))
    return topk_per_group(hits.where(severity_rank(F.col("severity")) <= floor).drop("rank"), ["query_id"], [F.asc("distance"), F.asc("vec_id")], k, "rank")


def snippets_by_keyword(lines: DataFrame, keyword: str, n: int = 5, most: int = 3) -> DataFrame:
    """The first hits of a word in each file and their snippets: n lines either way, numbered, the hit marked.

    A hit within the window of one already taken is passed over.
    """
    hits = lines.where(F.lower("line").contains(keyword.lower())).groupBy("path").agg(F.array_sort(F.collect_list("line_no")).alias("hits"))
    empty = F.array().cast("array<int>")
    picked = F.aggregate("hits", empty, lambda s, h: F.when((F.size(s) < most) & ((F.size(s) == 0) | (F.try_element_at(s, F.lit(-1)) + n < h)), F.concat(s, F.array(h.cast("int")))).otherwise(s))
    windows = hits.select("path", F.posexplode(picked).alias("k", "hit")).select("path", "k", "hit", F.explode(F.sequence(F.col("hit") - n, F.col("hit") + n)).alias("line_no"))
    shown = F.concat(F.when(F.col("line_no") == F.col("hit"), "→ ").otherwise("  "), F.format_string("%4d | ", "line_no"), F.col("line"))
    parts = windows.join(lines.select("path", "line_no", "line").hint("merge"), ["path", "line_no"]).groupBy("path", "k", "hit").agg(F.array_sort(F.collect_list(F.struct("line_no", shown.alias("shown")))).alias("rows"))
    whole = parts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("k", "hit", F.array_join("rows.shown", "\n").alias("snippet")))).alias("parts"))
    return whole.select("path", F.col("parts.hit").alias("hits"), F.array_join("parts.snippet", "\n---\n").alias("snippet"))


def apply_custom_exclusions(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """The first user rule that excludes each finding, or null.

    A rule holds for its owner, and for its project or all. Its conditions, each optional, are joined by AND
    with `match_all`, else by OR; a rule without conditions excludes nothing. Of rules that say the same for the same owner
    and project only the first counts. What is left meets each row as two arrays, those of its project and those for
    all, so that rows don't multiply. Rows that share finding_id and seq are one finding.
    """
    words = lambda c: F.array_sort(F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda w: F.lower(w))))
    said = ["match_all", "title_contains", "description_contains", "function_pattern", "severity_in"]
    told = rules.select("rule_id", "owner_id", "rule_project", F.coalesce("match_all", F.lit(False)).alias("match_all"), "function_pattern", *[words(F.col(c)).alias(c) for c in ("title_contains", "description_contains", "severity_in")])
    told = told.where((F.size("title_contains") > 0) | (F.size("description_contains") > 0) | F.col("function_pattern").isNotNull() | (F.size("severity_in") > 0))
    once = told.groupBy("owner_id", "rule_project", *said).agg(F.min("rule_id").alias("rule_id"))
    of_all = lambda rows, keys, name: rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rule_id", *said))).alias(name))
    own = of_all(once.where("rule_project IS NOT NULL").withColumnRenamed("rule_project", "project"), ["owner_id", "project"], "__own")
    for_all = of_all(once.where("rule_project IS NULL"), ["owner_id"], "__all")

    def holds(rule: Column) -> Column:
        conditions = F.array_compact(F.array(
            F.when(F.size(rule["title_contains"]) > 0, F.exists(rule["title_contains"], lambda w: F.contains(F.col("__title"), w))),
            F.when(F.size(rule["description_contains"]) > 0, F.exists(rule["description_contains"], lambda w: F.contains(F.col("__description"), w))),
            F.when(rule["function_pattern"].isNotNull(), F.regexp_like("function", rule["function_pattern"])),
            F.when(F.size(rule["severity_in"]) > 0, F.exists(rule["severity_in"], lambda x: x == F.col("__severity"))),
        ))
        return F.when(rule["match_all"], F.forall(conditions, lambda c: c)).otherwise(F.exists(conditions, lambda c: c)) & (F.size(conditions) > 0)

    first = F.least(*[F.get(F.filter(c, holds), F.lit(0))["rule_id"] for c in ("__own", "__all")])
    lowered = findings.withColumns({f"__{c}": F.lower(c) for c in ("title", "description", "severity")})
    rows = lowered.join(own, ["owner_id", "project"], "left").join(for_all, "owner_id", "left").withColumn("__first", first).select(*findings.columns, "__first")
    return rows.withColumn("excluded_by", F.min("__first").over(Window.partitionBy("finding_id", "seq"))).drop("__first")


def salvage_json(responses: DataFrame, schema: str, fields: list[str], text: str = "text") -> DataFrame:
    """Objects from free text, thinking tags and control characters dropped: the fenced or outermost object, else the first balanced one, else single fields by pattern.

    An object counts if it parses and has the first field. Balanced objects have one more level within, of
    500 objects at most. Fields are of the types of `schema`: true, false and digits become booleans and numbers.
    """
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<(thinking|reasoning|analysis)>.*?(</\1>|\z)", ""), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    fenced = F.nullif(F.regexp_extract(clean, r"(?s)```(?:json)?\s*(\{.*?\})\s*(?:```|\z)", 1), F.lit(""))
    outer = F.nullif(F.regexp_extract(clean, r"(?s)(\{.*\})", 1), F.lit(""))
    rows = responses.withColumn("__raw", F.coalesce(fenced, outer)).withColumn("__clean", clean)
    kinds = {f.name: f.dataType for f in StructType.fromDDL(schema).fields}
    rows = rows.withColumn("__whole", F.from_json("__raw", schema)).withColumn("__found", F.col(f"__whole.{fields[0]}").isNotNull())
    tries = F.transform(F.when(~F.col("__found"), F.regexp_extract_all("__clean", F.lit(BALANCED), F.lit(0))), lambda o: F.from_json(o, schema))
    rows = rows.withColumn("__part", F.get(F.filter(tries, lambda o: o[fields[0]].isNotNull()), F.lit(0)))
    rows = rows.withColumn("__parsed", F.when(F.col("__part").isNotNull(), F.col("__part")).otherwise(F.col("__whole")))
    by_pattern = lambda f: F.trim(F.nullif(F.regexp_extract("__clean", rf'(?i)"{f}"\s*:\s*"?([^",}}\n]+)', 1), F.lit(""))).try_cast(kinds[f])
    picked = {f: F.coalesce(F.col(f"__parsed.{f}"), by_pattern(f)) for f in fields}
    tier = F.when(F.col("__found"), "object").when(F.col("__part").isNotNull(), "balanced").when(picked[fields[0]].isNotNull(), "fields").otherwise("none")
    return rows.withColumns({**picked, "tier": tier}).drop("__raw", "__clean", "__whole", "__found", "__part", "__parsed")


def group_context(findings: DataFrame, functions: DataFrame, edges: DataFrame, topics: DataFrame, asked: int = 2, shown: int = 3) -> DataFrame:
    """What a group of findings shares, a row a group: `functions`, their `bodies`, `callees`, `callers`, `topics`, `hints`.

    `findings`: module, group, finding_id, func_id, title, description, category, hint (of a soft rule, or null);
    `functions`: func_id, signature, body; `topics`: word, topics. Functions come in the order of their ids. Callees
    are those of the first `asked` functions, `shown` of each, where there are three functions at most; callers the
    signatures of the first `shown` callers of each function. A finding without a soft hint has one where the
    language guards against it. Findings without a function bring topics and hints only; a group is small.
    """
    keys = ["module", "group"]

    def told_of(texts: DataFrame) -> DataFrame:
        known = language_gate(knowledge_topics(kept_table(texts.withColumnRenamed("__key", "finding_id"), "texts"), topics))
        return known.select(F.col("finding_id").alias("__key"), "topics", F.when(F.col("language_fp"), F.concat(F.lit("the language guards against "), "protected_type")).alias("__guard"))

    told = once_each(findings.select(*keys, "finding_id", "func_id", "title", "description", "category", "hint"), ["title", "description", "category"], told_of)
    said = F.coalesce("hint", "__guard")
    # only what a group shows is dealt out, as one text, to where the whole group is put together
    about = F.struct(F.when(F.size("topics") > 0, F.col("topics")).alias("topics"), F.when(said.isNotNull(), F.concat("finding_id", F.lit(": "), said)).alias("hint"))
    dealt = told.select(*keys, "func_id", F.nullif(F.to_json(about), F.lit("{}")).alias("about")).repartition(*keys)
    dealt = dealt.withColumn("about", F.from_json("about", "topics array<string>, hint string")).select(*keys, "func_id", "about.topics", "about.hint")
    shared = dealt.groupBy(*keys).agg(
        F.array_sort(F.collect_set("func_id")).alias("functions"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("topics")))).alias("topics"), F.array_sort(F.collect_list("hint")).alias("hints")
    )
    few = F.size("functions") <= 3
    members = shared.select(*keys, F.posexplode("functions").alias("__at", "func_id"), few.alias("__few")).withColumn("__asked", F.col("__few") & (F.col("__at") < asked))
    # both ends at once, so that callers and callees share one reading of the edges
    linked = edges.where("from_id IS NOT NULL AND to_id IS NOT NULL").select("from_id", "to_id").distinct()
    inside = linked.join(functions.select(F.col("func_id").alias("to_id")), "to_id", "left_semi").select(F.col("from_id").alias("func_id"), "to_id")
    called = first_values(topk_per_group(inside, ["func_id"], [F.asc("to_id")], shown), ["func_id"], [F.asc("to_id")], shown, F.col("to_id"), "__callees")
    signed = linked.join(functions.select(F.col("func_id").alias("from_id"), "signature"), "from_id").select(F.col("to_id").alias("func_id"), "from_id", "signature")
    first = first_values(topk_per_group(signed, ["func_id"], [F.asc("from_id")], shown), ["func_id"], [F.asc("from_id")], shown, F.struct("signature"), "__callers")
    known = members.join(functions.select("func_id", "body"), "func_id", "left").join(called, "func_id", "left").join(first, "func_id", "left")
    shows = F.struct("func_id", F.nullif("body", F.lit("")).alias("body"), F.when(F.col("__asked"), F.array_join("__callees", ", ")).alias("callees"), F.array_join("__callers.signature", "; ").alias("callers"))
    own = known.select(*keys, shows.alias("x")).repartition(*keys).groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("__own"))
    none = F.array().cast("array<string>")
    rows = shared.join(own, keys, "left").withColumn("__own", F.coalesce("__own", F.array()))
    of = lambda name, value: F.array_compact(F.transform("__own", value)).alias(name)
    line = lambda name: of(name, lambda x: F.concat(x["func_id"], F.lit(": "), x[name]))
    return rows.select(*keys, "functions", of("bodies", lambda x: x["body"]), line("callees"), line("callers"), *[F.coalesce(c, none).alias(c) for c in ("topics", "hints")])


def locate_match(matches: DataFrame, functions: DataFrame, lines: DataFrame) -> DataFrame:
    """Where each match lies: `doc_id, pattern_id, line, function, how`, the first way that gives a place.

    In order: a function that the title or description names; the first line hint; the best line with a cue,
    within a function before the module's own level before a struct. `functions`: doc_id, function,
    start_line, end_line. `lines`: doc_id, line_no, line, place (function, module or struct). The matches of a
    text, no more than the catalogue has patterns, meet its lines and functions as one array.
    """
    keys = ["doc_id", "pattern_id"]
    about = F.concat_ws(" ", "title", "description")
    words = F.concat(F.lit(" "), F.regexp_replace(about, r"[^A-Za-z0-9_]+", " "), F.lit(" "))
    of_text = matches.groupBy("doc_id").agg(F.collect_list(F.struct("pattern_id", words.alias("about"), "matched_cues")).alias("__matches"))
    named = functions.join(of_text, "doc_id").select("doc_id", "start_line", F.inline(F.filter("__matches", lambda m: F.contains(m["about"], F.concat(F.lit(" "), F.col("function"), F.lit(" "))))))
    hinted = matches.where(F.size("line_hints") > 0).withColumn("at", F.element_at("line_hints", 1))
    cued = lines.withColumn("__lower", F.lower("line")).join(of_text, "doc_id").select("doc_id", "line_no", "place", F.inline(F.filter("__matches", lambda m: F.exists(m["matched_cues"], lambda c: F.contains(F.col("__lower"), F.lower(c))))))
    rank = choose([(F.col("place") == "function", 0), (F.col("place") == "module", 1)], 2)
    nothing = F.lit(0)
    tries = [
        named.select(*keys, F.lit(1).alias("kind"), nothing.alias("rank"), F.col("start_line").alias("line"), F.lit("named function").alias("how")),
        hinted.select(*keys, F.lit(2).alias("kind"), nothing.alias("rank"), F.col("at").alias("line"), F.lit("line hint").alias("how")),
        cued.select(*keys, F.lit(3).alias("kind"), rank.alias("rank"), F.col("line_no").alias("line"), F.lit("cue").alias("how")),
    ]
    best = reduce(DataFrame.unionByName, tries).groupBy(*keys).agg(F.min(F.struct("kind", "rank", "line", "how")).alias("b")).select(*keys, "b.line", "b.how")
    inside = best.join(functions, "doc_id").where("line BETWEEN start_line AND end_line").groupBy(*keys).agg(F.max_by("function", "start_line").alias("function"))
    return best.join(inside, keys, "left").select(*keys, "line", "function", "how")
