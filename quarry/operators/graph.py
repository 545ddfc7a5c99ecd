"""Call graph: names resolved to edges, neighbourhoods, propagation, and summaries.

`functions`: func_id, module, name, visibility, risk_score, seq. `edges`: from_id, to_id. Graph jobs walk a
fixed number of layers, each an equi-join written to the shared folder, so that plans don't grow with depth;
nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import choose, topk_per_group
from quarry.functions.exploit_data import TYPICAL_ENTRIES
from quarry.sources.shared import kept_table


def qualify_calls(calls: DataFrame, aliases: DataFrame) -> DataFrame:
    """Bare names become their imported path, else a name of the calling module. `aliases`: module, local, full."""
    rows = calls.withColumn("module", F.regexp_extract("from_id", r"^(.*)::[^:]+$", 1))
    joined = rows.join(aliases, (rows["module"] == aliases["from_module"]) & (rows["raw_call"] == aliases["local"]), "left")
    bare = ~F.col("raw_call").contains("::")
    return joined.withColumn("call", F.when(bare, F.coalesce("full", F.concat_ws("::", "module", "raw_call"))).otherwise(F.col("raw_call"))).select(*calls.columns, "call")


def resolved_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """`from_id, call_line, to_id, missed`: a row for each call with the function that it means, or else its text as `missed`.

    The first kind of match wins. In order: the full id; `module::name` (its last definition); the last two parts of the
    call; a bare name of the caller's module, or else of the only function so called. Null calls are left out.
    """
    parts = F.split("raw_call", "::")
    own = F.try_element_at(F.split("from_id", "::"), F.lit(-2))
    is_bare = F.size(parts) == 1
    short = F.when(F.size(parts) == 2, F.col("raw_call")).otherwise(F.concat_ws("::", F.element_at(parts, -2), F.element_at(parts, -1)))

    def keyed(bare: bool, key: Column | str) -> DataFrame:
        return functions.select(F.lit(bare).alias("bare"), (F.col(key) if isinstance(key, str) else key).alias("key"), "func_id", "seq")

    # each key has one target, so that a call stays one row: it meets first the keys that come first, then the others
    first = keyed(False, "func_id").unionByName(keyed(True, F.concat_ws("|", "module", "name"))).groupBy("bare", "key").agg(F.min("func_id").alias("to_first"))
    second = keyed(False, F.concat_ws("::", "module", "name")).unionByName(keyed(True, "name")).groupBy("bare", "key")
    second = second.agg(F.when(~F.col("bare"), F.max_by("func_id", "seq")).when(F.count(F.lit(1)) == 1, F.min("func_id")).alias("to_second"))
    tried = calls.where(F.col("raw_call").isNotNull()).select("from_id", "raw_call", "call_line", is_bare.alias("bare"), F.when(is_bare, F.concat_ws("|", own, "raw_call")).otherwise(F.col("raw_call")).alias("key"))
    tried = tried.join(first.hint("merge"), ["bare", "key"], "left").select("from_id", "call_line", "to_first", "bare", F.when(F.col("to_first").isNull(), F.col("raw_call")).alias("missed"), F.when(F.col("to_first").isNull(), F.when(is_bare, F.col("raw_call")).otherwise(short)).alias("key"))
    hits = tried.join(second.hint("merge"), ["bare", "key"], "left")
    return hits.select("from_id", "call_line", F.coalesce("to_first", "to_second").alias("to_id"), F.when(F.col("to_second").isNull(), F.col("missed")).alias("missed"))


def resolve_edges(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls as edges between known functions, resolved as `resolved_calls` does. Self calls are dropped, edges are unique."""
    return resolved_calls(calls, functions).where("from_id <> to_id").groupBy("from_id", "to_id").agg(F.min("call_line").alias("call_line"))


def split_internal_external(calls: DataFrame, edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """Distinct called functions and unresolved call texts of each caller. `resolved`: from_id, raw_call of calls that have an edge."""
    inner = edges.groupBy("from_id").agg(F.array_sort(F.collect_set("to_id")).alias("internal"))
    outer = calls.join(resolved, ["from_id", "raw_call"], "left_anti").groupBy("from_id").agg(F.array_sort(F.collect_set("raw_call")).alias("external"))
    none = F.array().cast("array<string>")
    return inner.join(outer, "from_id", "full").select("from_id", F.coalesce("internal", none).alias("internal"), F.coalesce("external", none).alias("external"))


def split_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """What `split_internal_external` gives for the edges of `resolve_edges` and the calls that these resolve, from one
    pass over the calls, which may repeat. A caller with calls of itself only has no row, nor do null calls give one."""
    hits = resolved_calls(calls, functions).where("to_id IS NULL OR to_id <> from_id")
    return hits.groupBy("from_id").agg(F.array_sort(F.collect_set("to_id")).alias("internal"), F.array_sort(F.collect_set("missed")).alias("external"))


def called_by(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct callers of each function."""
    callers = edges.groupBy(F.col("to_id").alias("func_id")).agg(F.array_sort(F.collect_set("from_id")).alias("callers"))
    return functions.select("func_id").join(callers, "func_id", "left").withColumn("callers", F.coalesce("callers", F.array().cast("array<string>")))


def graph_roots(functions: DataFrame, edges: DataFrame) -> DataFrame:
    return functions.join(edges.select(F.col("to_id").alias("func_id")), "func_id", "left_anti")


def graph_leaves(functions: DataFrame, edges: DataFrame) -> DataFrame:
    return functions.join(edges.select(F.col("from_id").alias("func_id")), "func_id", "left_anti")


def module_of(func_id: Column) -> Column:
    """The second part of an id of three parts or more, else null."""
    parts = F.split(func_id, "::")
    return F.when(F.size(parts) >= 3, F.element_at(parts, 2))


def cross_module_calls(edges: DataFrame) -> DataFrame:
    return edges.where(module_of(F.col("from_id")) != module_of(F.col("to_id")))


def neighbors(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """`seed, func_id, distance` of all functions within `depth` calls either way, the nearest distance each."""
    both = edges.select(F.col("from_id").alias("at"), F.col("to_id").alias("next")).unionByName(edges.select(F.col("to_id").alias("at"), F.col("from_id").alias("next"))).distinct()
    both = kept_table(both, "links")
    front = kept_table(seeds.select("seed", F.col("seed").alias("at")).distinct(), "seeds")
    seen = front.select("seed", F.col("at").alias("next"), F.lit(0).alias("distance"))
    for d in range(1, depth + 1):
        step = front.join(both, "at").select("seed", "next").distinct().join(seen.select("seed", "next"), ["seed", "next"], "left_anti")
        step = kept_table(step, "layer")
        seen = seen.unionByName(step.withColumn("distance", F.lit(d)))
        front = step.select("seed", F.col("next").alias("at"))
    return seen.where("distance > 0").withColumnRenamed("next", "func_id")


def relation(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """How a target and its neighbour are tied. As in the audited data, `calls_target` means that the target calls the neighbour."""
    forth = edges.select(F.col("from_id").alias("target"), F.col("to_id").alias("neighbor"), F.lit(True).alias("forth"))
    back = edges.select(F.col("to_id").alias("target"), F.col("from_id").alias("neighbor"), F.lit(True).alias("back"))
    rows = pairs.join(forth, ["target", "neighbor"], "left").join(back, ["target", "neighbor"], "left")
    return rows.withColumn("relation", F.when(F.col("forth"), "calls_target").when(F.col("back"), "called_by_target").otherwise("indirect")).drop("forth", "back")


def callers(edges: DataFrame, functions: DataFrame, cap: int = 10) -> DataFrame:
    """The first `cap` callers of each function, with their name and visibility."""
    rows = edges.join(functions.select(F.col("func_id").alias("from_id"), "name", "visibility", "seq"), "from_id")
    return topk_per_group(rows, ["to_id"], [F.asc("seq")], cap, "rank")


def callees(edges: DataFrame, functions: DataFrame, cap: int = 10) -> DataFrame:
    rows = edges.join(functions.select(F.col("func_id").alias("to_id"), "name", "visibility", "seq"), "to_id")
    return topk_per_group(rows, ["from_id"], [F.asc("seq")], cap, "rank")


def resolve_function_id(requests: DataFrame, functions: DataFrame) -> DataFrame:
    """The function that each requested text names, in full or as `module::name`; on a miss up to three of the same name."""
    exact = functions.select(F.col("func_id").alias("request"), F.col("func_id").alias("exact_id"))
    short = functions.groupBy(F.concat_ws("::", "module", "name").alias("request")).agg(F.max_by("func_id", "seq").alias("short_id"))
    same = topk_per_group(functions.select(F.col("name").alias("bare"), "func_id", "seq"), ["bare"], [F.asc("seq")], 3).groupBy("bare").agg(F.array_sort(F.collect_list("func_id")).alias("suggestions"))
    rows = requests.withColumn("bare", F.element_at(F.split("request", "::"), -1)).join(exact, "request", "left").join(short, "request", "left").join(same, "bare", "left")
    found = F.coalesce("exact_id", "short_id")
    return rows.select("request", found.alias("func_id"), F.when(found.isNull(), F.col("suggestions")).alias("suggestions"))


def public_entry_for(findings: DataFrame, functions: DataFrame, edges: DataFrame) -> DataFrame:
    """The public function by which a finding's function is reached (`entry_point`) and how it is known (`via`): itself or
    its first public caller (direct_call), else the first usual entry of the finding's `category` that its `source` names
    (inferred), else UNKNOWN (unknown). `category` and `source` are read where present."""
    public = functions.where(F.col("visibility").contains("public") | (F.col("visibility") == "entry"))
    own = public.select("func_id", F.col("func_id").alias("own"))
    first = edges.join(public.select(F.col("func_id").alias("from_id"), "seq"), "from_id").groupBy(F.col("to_id").alias("func_id")).agg(F.min_by("from_id", "seq").alias("caller"))
    rows = findings.join(own, "func_id", "left").join(first, "func_id", "left")
    guessed = F.lit(None).cast("string")
    if {"category", "source"} <= set(findings.columns):
        guessed = choose([(F.col("category") == kind, F.coalesce(*[F.when(F.contains("source", F.lit(n)), F.lit(n)) for n in names])) for kind, names in TYPICAL_ENTRIES.items()], guessed)
    direct = F.coalesce("own", "caller")
    via = F.when(direct.isNotNull(), "direct_call").when(guessed.isNotNull(), "inferred").otherwise("unknown")
    return rows.withColumns({"entry_point": F.coalesce(direct, guessed, F.lit("UNKNOWN")), "via": via}).drop("own", "caller")


def propagate(confirmed: DataFrame, edges: DataFrame, depth: int = 3, fanout: int = 5, affected: DataFrame | None = None) -> DataFrame:
    """Findings carried to callers, layer by layer: `func_id, from_id, layer, exploitability, confidence`.

    From each function at most `fanout` callers, in order of their id, are taken; each caller once overall,
    on its first layer. `affected` (func_id) may restrict callers to those that a verdict names.
    """
    calls = edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("func_id")).distinct()
    if affected is not None:
        calls = calls.join(affected.select("func_id").distinct(), "func_id", "left_semi")
    calls = kept_table(calls, "calls")
    front = kept_table(confirmed.select("func_id").distinct(), "confirmed")
    seen, layers = front, []
    for d in range(1, depth + 1):
        step = front.select(F.col("func_id").alias("from_id")).join(calls, "from_id").join(seen, "func_id", "left_anti")
        step = topk_per_group(step, ["from_id"], [F.asc("func_id")], fanout)
        step = kept_table(step.groupBy("func_id").agg(F.min("from_id").alias("from_id")), "layer")
        layers.append(step.select("func_id", "from_id", F.lit(d).alias("layer"), F.lit(7 - d).alias("exploitability"), F.lit(max(60, 85 - 10 * d)).alias("confidence")))
        front = step.select("func_id")
        seen = seen.unionByName(front)
    return reduce(DataFrame.unionByName, layers)


def entry_points(functions: DataFrame, loose: bool = False) -> DataFrame:
    """Functions that are exactly `public` or `entry`; loose: whose visibility contains either word."""
    v = F.col("visibility")
    return functions.where(v.contains("public") | v.contains("entry") if loose else v.isin("public", "entry"))


def public_functions(functions: DataFrame) -> DataFrame:
    return functions.where(F.col("visibility").isin("public", "public(friend)", "entry"))


def high_risk(functions: DataFrame, threshold: int = 50) -> DataFrame:
    return functions.where(F.col("risk_score") >= threshold)


def module_structure(functions: DataFrame, types: DataFrame) -> DataFrame:
    """Functions and structs of each module."""
    f = functions.groupBy("module").agg(F.count(F.lit(1)).alias("functions"))
    t = types.groupBy("module").agg(F.count(F.lit(1)).alias("structs"))
    return f.join(t, "module", "full").select("module", F.coalesce("functions", F.lit(0)).alias("functions"), F.coalesce("structs", F.lit(0)).alias("structs"))


def module_summary(functions: DataFrame, threshold: int = 50) -> DataFrame:
    """Of each module: functions, public and entry ones (by containment), and the names of risky ones."""
    v = F.col("visibility")
    return functions.groupBy("module").agg(F.count(F.lit(1)).alias("functions"), F.count_if(v.contains("public")).alias("public"), F.count_if(v.contains("entry")).alias("entry"), F.array_sort(F.collect_list(F.when(F.col("risk_score") >= threshold, F.col("name")))).alias("risky"))


def module_call_digest(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each function: its first three callees and how many more there are."""
    calls = edges.groupBy(F.col("from_id").alias("func_id")).agg(F.array_sort(F.collect_set("to_id")).alias("calls"))
    rows = functions.join(calls, "func_id", "left").withColumn("calls", F.coalesce("calls", F.array().cast("array<string>")))
    return rows.select("module", "func_id", F.slice("calls", 1, 3).alias("first_calls"), F.greatest(F.size("calls") - 3, F.lit(0)).alias("more"))


def graph_meta(functions: DataFrame, types: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules, functions, types and edges, as one row."""
    one = functions.agg(F.count_distinct("module").alias("modules"), F.count(F.lit(1)).alias("functions"))
    return one.join(types.agg(F.count(F.lit(1)).alias("types")), F.lit(True)).join(edges.agg(F.count(F.lit(1)).alias("edges")), F.lit(True))


def graph_summary(functions: DataFrame, types: DataFrame, edges: DataFrame, n: int = 20) -> DataFrame:
    """graph_meta and the first n entry points, leaves, risky functions and calls across modules, each in order of its id."""

    def first(df: DataFrame, name: str) -> DataFrame:
        return df.orderBy("func_id").limit(n).agg(F.array_sort(F.collect_list("func_id")).alias(name))

    out = graph_meta(functions, types, edges)
    across = cross_module_calls(edges).select(F.concat_ws(" -> ", "from_id", "to_id").alias("func_id"))
    for df, name in ((across, "cross_module"), (entry_points(functions, True), "entries"), (graph_leaves(functions, edges), "leaves"), (high_risk(functions), "risky")):
        out = out.join(first(df, name), F.lit(True))
    return out


def save_graph(functions: DataFrame, edges: DataFrame, types: DataFrame, path: str) -> None:
    for name, df in (("functions", functions), ("edges", edges), ("types", types)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_graph(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("functions", "edges", "types"))


def has_running_audit(projects: DataFrame, audits: DataFrame, running: bool = True) -> DataFrame:
    """Projects with a pending or running audit, or those without one."""
    busy = audits.where(F.col("status").isin("pending", "running")).select(F.col("project_id").alias("id"))
    return projects.join(busy, "id", "left_semi" if running else "left_anti")


def latest_audit(projects: DataFrame, audits: DataFrame) -> DataFrame:
    last = audits.groupBy("project_id").agg(F.max_by(F.struct("id", "status"), F.struct("created_at", "seq")).alias("last"))
    return projects.join(last, projects["id"] == last["project_id"], "left").select(projects["id"], F.col("last.id").alias("audit_id"), F.col("last.status").alias("status"))


def report_listing(reports: DataFrame, audits: DataFrame, projects: DataFrame, owner: str | None = None) -> DataFrame:
    """Reports with their audit and the name of their project, which may be gone."""
    rows = reports.join(audits.select(F.col("id").alias("audit_id"), "project_id"), "audit_id").join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"), "owner_id"), "project_id", "left")
    rows = rows.withColumn("project_name", F.coalesce("project_name", F.lit("Unknown")))
    return rows.where(F.col("owner_id") == owner) if owner else rows


def dashboard(reports: DataFrame, audits: DataFrame, projects: DataFrame) -> DataFrame:
    """Totals of the front page, as one row."""
    r = reports.agg(F.count(F.lit(1)).alias("reports"), *[F.sum(c).alias(c) for c in ("critical", "high", "medium", "low")])
    a = audits.agg(F.count(F.lit(1)).alias("audits"), F.count_if(F.col("status").isin("pending", "running")).alias("running"))
    return r.join(a, F.lit(True)).join(projects.agg(F.count(F.lit(1)).alias("projects")), F.lit(True))


def list_page(df: DataFrame, order: list[Column], skip: int = 0, limit: int = 20) -> DataFrame:
    """A page of rows in order, with the number of all rows; at most 100 a page."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(skip).limit(min(limit, 100)).join(F.broadcast(total), F.lit(True))


def caller_requirement(functions: DataFrame) -> DataFrame:
    """Who may call a function, from its body."""
    body = F.col("body")
    who = F.when(body.isNull() | (body == ""), "unknown").when(body.contains("AdminCap") | body.contains("OwnerCap"), "admin").when(body.contains("tx_context::sender"), "specific_address")
    return functions.withColumn("caller", who.otherwise("anyone"))


