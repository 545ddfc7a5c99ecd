"""Code tables from source text: modules, functions, types, constants, imports, calls and risk.

Native column expressions only. Functions and braces are found by their place in the text, so that several may share
a line. Braces within double quotes don't count, those in comments do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import choose
from quarry.operators.scan import explode_lines

FUNCTION = r"((?:#\[[^\]]+\]\s*)*)((?:public(?:\s*\(\s*(?:friend|package)\s*\))?\s+)?(?:entry\s+)?)fun\s+(\w+)\s*(<[^>]+>)?\s*\(([^)]*)\)(?:\s*:\s*([^{;]+))?\s*\{"
#: Strings as they end at the next quote without a backslash before it, and braces outside of them.
BRACES = r'(?<!\\)"[^"]*+(?:(?<=\\)"[^"]*+)*+(?:"|$)|[{}]'
STRUCT = r"struct[ \t]+([A-Za-z_][A-Za-z0-9_]*)[ \t]*(?:<[^>{]*>)?[ \t]*(?:has[ \t]+([a-z, \t]+?))?[ \t]*\{([^}]*)\}"
CONSTANT = r"const[ \t]+([A-Za-z_][A-Za-z0-9_]*)[ \t]*:[ \t]*([^=;]+?)[ \t]*=[ \t]*([^;]+);"
IMPORT = r"(?m)^[ \t]*use[ \t]+([^;]+);"
#: Linear types, capability names, and what raises each risk, with its weight.
LINEAR = ["Coin", "Balance", "TreasuryCap", "CoinMetadata", "Receipt", "FlashLoanReceipt", "HotPotato", "Position", "Pool", "Vault"]
CAPABILITIES = ["AdminCap", "OwnerCap", "TreasuryCap", "MinterCap", "Capability", "Witness", "Cap"]
RISKS = {"overflow": (r"\*|\+|<<|>>", 10), "state_modification": (r"balance::join|balance::split|coin::mint|coin::burn|transfer::|dynamic_field::|table::|bag::", 8), "division": ("/", 12), "external_call": ("::", 5)}
ACCESS_WEIGHT = 15
#: Words that look like calls and are none.
NO_CALLS = [
    "if", "else", "while", "loop", "return", "abort", "break", "continue", "let", "mut", "move", "copy", "as", "use", "fun", "public", "entry",
    "struct", "module", "const", "has", "assert", "spec", "requires", "ensures", "vector", "option", "some", "none", "true", "false", "allow", "lint", "test", "test_only",
]
#: Capitalised words that name no type worth looking up, and shapes of such words.
NO_TYPES = [
    "Self", "T", "U", "V", "W", "X", "Y", "Z", "CoinType", "CoinTypeA", "CoinTypeB", "Type", "Key", "Store", "ID", "UID", "TxContext", "Option", "String", "ASCII",
    "E", "R", "S", "A", "B", "C", "N", "M", "TODO", "FIXME", "NOTE", "HACK", "XXX", "BUG", "Check", "If", "The", "This", "We", "It", "Is", "Not", "For",
    "Args", "Returns", "Return", "Param", "See", "Example",
]
NO_TYPE_SHAPES = r"^.{1,2}$|^[^a-z]+$|_$|^(Coin)?Type[A-Z]$|^[A-Z][a-z]+[TKV]$"


def _each(df: DataFrame, keys: list[str], text: str, pattern: str) -> DataFrame:
    """A row for each match of a pattern, in order, with the matched text."""
    return df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), 0)).alias("seq", "whole"))


def _part(pattern: str, group: int) -> Column:
    return F.regexp_extract("whole", pattern, group)


def extract_modules(files: DataFrame) -> DataFrame:
    """The first module of each file, with its address if it has one."""
    take = lambda g: F.regexp_extract("content", r"module[ \t]+(?:([A-Za-z0-9_]+)::)?([A-Za-z_][A-Za-z0-9_]*)[ \t]*[{;]", g)
    rows = files.withColumns({"address": take(1), "module_name": take(2)}).where("module_name <> ''")
    return rows.withColumn("full_name", F.when(F.col("address") != "", F.concat_ws("::", "address", "module_name")).otherwise(F.col("module_name"))).drop("content")


def places(df: DataFrame, keys: list[str], text: str, pattern: str) -> DataFrame:
    """A row for each match of a pattern: `seq`, the matched text `whole`, its place `at` (characters before it) and its line.

    Lengths of matches and of what lies between them are summed up in order, so that a text is read once.
    """
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    both = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda hit, gap: F.struct(hit.alias("whole"), F.length(gap).alias("gap"), breaks(gap).alias("gap_lines")))
    rows = df.select(*keys, F.posexplode(both).alias("seq", "hit")).select(*keys, "seq", "hit.*")
    before = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    at = F.sum(F.col("gap") + F.length("whole")).over(before) - F.length("whole")
    line = F.sum(F.col("gap_lines") + breaks(F.col("whole"))).over(before) - breaks(F.col("whole")) + 1
    return rows.select(*keys, "seq", "whole", at.alias("at"), line.cast("int").alias("line"))


def _declared(rows: DataFrame, *columns: str) -> DataFrame:
    words = F.trim(F.regexp_replace(_part(FUNCTION, 2), r"\s+", " "))
    words = F.regexp_replace(words, r" ?\( ?(friend|package) ?\)", "($1)")
    return rows.select(
        *columns, F.btrim(_part(FUNCTION, 1), F.lit(" \t\r\n")).alias("attributes"), F.when(words == "", "private").otherwise(words).alias("visibility"), _part(FUNCTION, 3).alias("name"),
        F.coalesce(_part(FUNCTION, 4), F.lit("")).alias("type_params"), _part(FUNCTION, 5).alias("params"), F.btrim(F.coalesce(_part(FUNCTION, 6), F.lit("")), F.lit(" \t\r\n")).alias("return_type"),
    )


def extract_functions(files: DataFrame, keys: list[str]) -> DataFrame:
    """Functions with a body, wherever they stand in a line: attributes, visibility, name, type parameters, parameters, return type, in order."""
    return _declared(_each(files, keys, "content", FUNCTION), *keys, "seq")


def signature() -> Column:
    """A declaration as one line, from the columns of `extract_functions`."""
    seen = F.when(F.col("visibility") != "private", F.concat("visibility", F.lit(" "))).otherwise("")
    given = F.when(F.col("return_type") != "", F.concat(F.lit(": "), "return_type")).otherwise("")
    return F.concat(seen, F.lit("fun "), "name", "type_params", F.lit("("), "params", F.lit(")"), given)


def function_places(files: DataFrame, keys: list[str], with_text: bool = False) -> DataFrame:
    """Functions with where they begin (`at`, `start_line`, their attributes counted in), where their block opens and closes, and
    the lines of these; `with_text` adds the content of their file.

    A brace closes the one before it on its own level, so that one look ahead on each level pairs them all; the next
    open brace after a declaration's own start is its block. A block that is never closed ends with its file. Places meet
    the texts in one sort-merge join: Spark takes texts that are worked out of narrow rows for small, and would broadcast them.
    """
    declared = _declared(places(files, keys, "content", FUNCTION), *keys, "at", "line").select(*keys, "at", "line", F.lit("f").alias("kind"), F.struct("attributes", "visibility", "name", "type_params", "params", "return_type").alias("told"))
    braces = places(files, keys, "content", BRACES).where(F.col("whole").isin("{", "}")).select(*keys, "at", "line", F.col("whole").alias("kind"))
    in_file = Window.partitionBy(*keys).orderBy("at")
    depth = F.sum(F.when(F.col("kind") == "{", 1).otherwise(-1)).over(in_file.rowsBetween(Window.unboundedPreceding, 0))
    leveled = braces.withColumn("level", depth + F.when(F.col("kind") == "}", 1).otherwise(0))
    own = Window.partitionBy(*keys, "level").orderBy("at")
    paired = leveled.withColumns({"close_at": F.lead("at").over(own), "close_line": F.lead("line").over(own)}).where("kind = '{'")
    opened = paired.select(*keys, "at", "line", "kind", F.struct(F.col("at").alias("open_at"), F.col("line").alias("open_line"), "close_at", "close_line").alias("block"))
    backwards = Window.partitionBy(*keys).orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    rows = declared.unionByName(opened, allowMissingColumns=True).withColumn("block", F.last("block", True).over(backwards)).where("kind = 'f'")
    close_at = F.coalesce("block.close_at", F.length("content") - 1)
    end_line = F.coalesce("block.close_line", F.size(F.split("content", "\n", -1))).cast("int")
    rows = rows.join(files.select(*keys, "content").hint("merge"), keys)
    return rows.select(*keys, F.col("told.*"), "at", F.col("line").alias("start_line"), "block.open_at", "block.open_line", close_at.alias("close_at"), end_line.alias("end_line"), *(["content"] if with_text else []))


def function_spans(files: DataFrame, keys: list[str], *told: str) -> DataFrame:
    """First and last line of each function, and its body: the lines between, both whole. `told`: more columns of its declaration."""
    lines = F.split("content", "\n", -1)
    body = F.array_join(F.slice(lines, F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return function_places(files, keys, True).select(*keys, F.col("name").alias("function"), "at", "start_line", "end_line", body.alias("body"), *told)


def function_lines(files: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of each file with the function that they belong to, if any; the last that begins at or before a line, where several share it."""
    spans = function_places(files, keys).groupBy(*keys, F.col("start_line").alias("line_no")).agg(F.max_by("name", "at").alias("declared"))
    lines = explode_lines(files).hint("merge").join(spans, [*keys, "line_no"], "left")
    by_file = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("start_line", F.last(F.when(F.col("declared").isNotNull(), F.col("line_no")), True).over(by_file)).withColumn("function", F.last("declared", True).over(by_file))


def is_test_function(files: DataFrame, keys: list[str], above: int = 10) -> DataFrame:
    """Functions that are tests: by their name, by an attribute of their own, or by one in the lines above, up to a line that
    closes a block or declares another function."""
    named = F.col("name").startswith("test_") | F.col("name").endswith("_test") | F.col("name").endswith("_for_test")
    marked = F.col("attributes").rlike(r"#\[test(_only)?\]")
    before = F.reverse(F.slice(F.split("content", "\n", -1), F.greatest(F.col("start_line") - above, F.lit(1)), F.least(F.col("start_line") - 1, F.lit(above))))
    near = F.aggregate(before, F.struct(F.lit(False).alias("hit"), F.lit(False).alias("over")), lambda s, x: F.struct((s["hit"] | (~s["over"] & x.rlike(r"#\[test(_only)?\]"))).alias("hit"), (s["over"] | x.rlike(r"^\s*(\}\s*$|(fun|public|entry) )")).alias("over")))["hit"]
    return function_places(files, keys, True).select(*keys, F.col("name").alias("function"), "start_line", (named | marked | ((F.col("start_line") > 1) & near)).alias("is_test"))


def extract_structs(files: DataFrame, keys: list[str]) -> DataFrame:
    """Structs with or without abilities; those without any are hot potatoes."""
    rows = _each(files, keys, "content", STRUCT)
    listed = lambda c, sep: F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.select(*keys, "seq", _part(STRUCT, 1).alias("name"), listed(_part(STRUCT, 2), ",").alias("abilities"), listed(F.regexp_replace(_part(STRUCT, 3), r"\s+", " "), ",").alias("fields"))
    return rows.withColumns({"is_hot_potato": F.size("abilities") == 0, "has_uid": F.exists("fields", lambda f: f.contains("UID"))})


def extract_constants(files: DataFrame, keys: list[str]) -> DataFrame:
    return _each(files, keys, "content", CONSTANT).select(*keys, "seq", _part(CONSTANT, 1).alias("name"), _part(CONSTANT, 2).alias("type"), F.trim(_part(CONSTANT, 3)).alias("value"))


def extract_imports(files: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each imported item, or for the module if no items are listed."""
    rows = _each(files, keys, "content", IMPORT).withColumn("path", F.regexp_replace(_part(IMPORT, 1), r"\s+", " "))
    base, listed = F.trim(F.regexp_extract("path", r"^(.*?)(?:::\{.*)?$", 1)), F.regexp_extract("path", r"\{(.*)\}", 1)
    items = F.when(listed != "", F.transform(F.split(listed, ","), lambda x: F.trim(x))).otherwise(F.array(F.lit("")))
    return rows.select(*keys, "seq", base.alias("module_path"), F.posexplode(items).alias("item_no", "item"))


def import_aliases(imports: DataFrame, keys: list[str]) -> DataFrame:
    """Local function names and what they stand for; types and Self are left out, the last definition holds."""
    parts = F.split("item", r"\s+as\s+")
    local = F.element_at(parts, -1)
    rows = imports.where(local.rlike("^[a-z]")).withColumns({"local": local, "full": F.concat_ws("::", "module_path", F.element_at(parts, 1))})
    return rows.groupBy(*keys, "local").agg(F.max_by("full", F.struct("seq", "item_no")).alias("full"))


def string_idents(files: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct capitalised names inside string literals."""
    texts = F.regexp_extract_all("content", F.lit(r'"([^"\n]*)"'), 1)
    names = F.array_sort(F.array_distinct(F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(r"\b([A-Z][A-Za-z0-9_]*)"), 1)))))
    return files.select(*keys, names.alias("names"))


def function_params(functions: DataFrame) -> DataFrame:
    """Parameters as (name, type, constraint)."""

    def one(x: Column) -> Column:
        kind = F.trim(F.element_at(F.split(x, ":", 2), -1))
        rule = choose([(kind.contains("Coin") | kind.contains("Balance"), "must_have_balance"), (kind.contains("Cap"), "must_own_capability"), (kind.rlike(r"\bu(64|128)\b"), "numeric_range")], "none")
        return F.struct(F.trim(F.element_at(F.split(x, ":", 2), 1)).alias("name"), kind.alias("type"), rule.alias("constraint"))

    return functions.withColumn("param_list", F.transform(F.filter(F.split("params", ","), lambda x: F.trim(x) != ""), one))


def linear_resources(functions: DataFrame) -> DataFrame:
    """Which linear types occur in the parameters: `linear`, and receipts apart in `receipts`."""
    named = lambda types: F.filter(F.array(*map(F.lit, types)), lambda x: F.contains(F.col("params"), x))
    return functions.withColumns({"linear": named([x for x in LINEAR if "Receipt" not in x]), "receipts": named([x for x in LINEAR if "Receipt" in x])})


def risk_indicators(functions: DataFrame, body: str = "body") -> DataFrame:
    """Counts that raise risk, from body and parameters, and their weighted sum."""
    counts = {name: F.regexp_count(body, F.lit(pattern)) for name, (pattern, _) in RISKS.items()}
    both = F.concat(F.coalesce("params", F.lit("")), F.coalesce(body, F.lit("")))
    counts["access_control"] = reduce(lambda a, b: a + b, [both.contains(c).cast("int") for c in CAPABILITIES])
    score = reduce(lambda a, b: a + b, [F.col(n) * w for n, (_, w) in RISKS.items()] + [F.col("access_control") * ACCESS_WEIGHT])
    return functions.withColumns(counts).withColumn("risk_score", score)


def external_call_tokens(functions: DataFrame, body: str = "body") -> DataFrame:
    """Distinct three-part calls of each body."""
    return functions.withColumn("external", F.array_sort(F.array_distinct(F.regexp_extract_all(body, F.lit(r"([A-Za-z0-9_]+::[A-Za-z0-9_]+::[A-Za-z0-9_]+)[ \t]*\("), 1))))


def extract_calls(files: DataFrame, keys: list[str]) -> DataFrame:
    """Calls in the block of each function: `module::f(` and bare lower-case `f(`; line comments, keywords and the own name left out."""
    blocks = function_places(files, keys, True).withColumnRenamed("name", "function")
    inside = F.substring(F.col("content"), (F.col("open_at") + 1).cast("int"), (F.col("close_at") - F.col("open_at") + 1).cast("int"))
    lines = blocks.select(*keys, "function", "open_line", F.posexplode(F.split(inside, "\n", -1)).alias("n", "line")).where("NOT ltrim(line) LIKE '//%'")
    wide = F.regexp_extract_all("line", F.lit(r"(\w+(?:::\w+)+)\s*(?:<[^>]*>)?\s*\("), 1)
    bare = F.regexp_extract_all("line", F.lit(r"(?<![:\w.])([a-z_][a-z0-9_]*)\s*(?:<[^>]*>)?\s*\("), 1)
    calls = F.array_distinct(F.concat(wide, F.filter(bare, lambda x: ~x.isin(NO_CALLS) & (x != F.col("function")))))
    return lines.select(*keys, "function", (F.col("open_line") + F.col("n")).alias("call_line"), F.explode(calls).alias("raw_call"))


def type_tokens_topk(functions: DataFrame, keys: list[str], k: int = 10, text: str = "body", head: str | None = None) -> DataFrame:
    """The k most frequent names of types of each function, in its signature (`head`) and body, comments removed; the first seen among equals."""
    combined = F.concat_ws("\n", *[F.col(c) for c in (head, text) if c])
    bare = F.regexp_replace(F.regexp_replace(combined, r"//[^\n]*", ""), r"(?s)/\*.*?\*/", "")
    tokens = F.filter(F.regexp_extract_all(bare, F.lit(r"\b([A-Z][a-zA-Z0-9_]*)\b"), 1), lambda t: ~t.isin(NO_TYPES) & ~t.rlike(NO_TYPE_SHAPES))
    rows = functions.select(*keys, F.posexplode(tokens).alias("at", "token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).drop("first")


#: What a function's visibility, the start of its name, or its name says.
SEEN_BY = {"entry": "Entry point function", "public": "Public function"}
NAME_STARTS = {
    ("create_", "new_"): "creates a new object", ("destroy_", "delete_"): "destroys/deletes an object",
    ("get_", "is_", "has_"): "getter/query function", ("set_", "update_"): "setter/update function",
}
NAMED_OPERATIONS = {"DeFi": ["borrow", "repay", "liquidate", "deposit", "withdraw"], "AMM": ["swap", "add_liquidity", "remove_liquidity"], "Token": ["mint", "burn", "transfer"]}


def function_description(name: Column, visibility: Column) -> Column:
    """What name and visibility tell of a function, as `a, b`; empty if nothing."""
    seen = F.coalesce(choose([(visibility == v, text) for v, text in SEEN_BY.items()], None), F.lit(""))
    does = choose([(name.rlike(f"^({'|'.join(prefixes)})"), text) for prefixes, text in NAME_STARTS.items()] + [(name.isin(*names), F.concat(F.lit(f"{kind} "), name, F.lit(" operation"))) for kind, names in NAMED_OPERATIONS.items()], None)
    return F.array_join(F.filter(F.array(seen, F.coalesce(does, F.lit(""))), lambda x: x != ""), ", ")


def describe_function(functions: DataFrame) -> DataFrame:
    """`description` from module, name and visibility; empty where these tell nothing."""
    told = function_description(F.col("name"), F.col("visibility"))
    return functions.withColumn("description", F.when(told != "", F.concat("module", F.lit("::"), "name", F.lit(" - "), told)).otherwise(""))
