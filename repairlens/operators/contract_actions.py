"""Inspections and searches of a search contract that the kind of deficiency asks for, from resolved anchors.

``run_anchors`` brings the anchors of a run into one row. The rules are a table: for each kind of
deficiency the searches and inspections in order, as expressions over that row; every run takes
those of its kind. ``merge_inspections`` and ``merge_searches`` put them before the general ones
and keep each file and query once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repairlens.operators import anchors as an

# Kinds of deficiency, config words, words that are no assertion terms, and how many entries a contract holds.
API, INTERFACE, TESTS, CALLERS = "API_DEFINITION_CONTEXT", "INTERFACE_CONSTRAINT_CONTEXT", "RELATED_TEST_CONTEXT", "CALLER_CALLEE_CONTEXT"
ROOT, REGRESSION, DEPENDENCY = "ROOT_CAUSE_RELOCALIZATION", "REGRESSION_CONSTRAINT_CONTEXT", "DEPENDENCY_CONTEXT"
CONFIG_WORDS = ["setup", "config", "registry", "install", "plugin"]
NO_TERMS = ["is", "not", "in", "true", "false", "none"]
MOST, MOST_TYPED = 10, 12
_NONE = "array<string>"


def run_anchors(runs: DataFrame, anchors: DataFrame, edits: DataFrame) -> DataFrame:
    """runs (run_id, has_failure, message, cdtype) with symbols, issue_symbols, sources (files of no test), files, stack_files, top_file, test_file, test_method, modules, attributes and edited (base names of edits: run_id, pos, path), each in order."""
    listed = lambda cond, value="value": F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", F.col(value).alias("v"))))), lambda x: x["v"])
    kind = lambda k: F.col("kind") == k
    test = F.contains(F.lower("value"), F.lit("test"))
    per = anchors.groupBy("run_id").agg(
        listed(kind("symbol")).alias("symbols"), listed(kind("symbol") & (F.col("source") == "issue_term")).alias("issue_symbols"), listed(kind("file") & ~test).alias("sources"), listed(kind("file")).alias("files"),
        listed(kind("file") & (F.col("source") == "stack_frame")).alias("stack_files"), listed(kind("module") & (F.col("value") != "")).alias("modules"), listed(kind("module") & (F.col("detail") != ""), "detail").alias("attributes"),
    )
    own = edits.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: F.substring_index(x["path"], "/", -1)).alias("edited"))
    full = runs.select("run_id", "has_failure", "message", "cdtype").join(an.anchor_summary(runs, anchors).drop("provenance").hint("merge"), "run_id").join(per.hint("merge"), "run_id", "left").join(own.hint("merge"), "run_id", "left")
    return full.withColumns({c: F.coalesce(c, F.array().cast(_NONE)) for c in ("symbols", "issue_symbols", "sources", "files", "stack_files", "modules", "attributes", "edited")})


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def _full(path: Column) -> Column:
    """A short name's path among the run's files, else itself."""
    known = F.get(F.filter("files", lambda f: F.endswith(f, F.concat(F.lit("/"), path))), F.lit(0))
    return F.when(F.contains(path, F.lit("/")) | F.contains(path, F.lit("\\")), path).otherwise(F.coalesce(known, path))


def _rules() -> list[tuple[str, str, Column, str, str, bool]]:
    """(kind of deficiency, search type or 'inspect', target, role, condition of its own, whether it belongs to the pair of its kind) in order."""
    first = lambda c, n=0: F.get(c, F.lit(n))
    sym, edit = first("symbols"), first("edited")
    real = F.when(sym != "<module>", sym)
    call = lambda c: F.concat(c, F.lit("("))
    said = F.coalesce("message", F.lit(""))
    claim = F.regexp_extract_all(F.regexp_extract(said, r"assert\s+(.+)", 1), F.lit(r"\b([a-zA-Z_]\w+(?:\.\w+)*)\b"), F.lit(1))
    term = F.when((F.size("symbols") == 0) & F.coalesce("has_failure", F.lit(False)), F.get(F.filter(claim, lambda w: (F.length(w) > 2) & ~F.lower(w).isin(NO_TERMS)), F.lit(0)))
    target = F.coalesce(sym, first("modules"))
    rules = [
        (API, "symbol_definition", sym, "definition", True), (API, "symbol_definition", first("symbols", 1), "definition", True), (API, "grep", F.split_part(real, F.lit("."), F.lit(1)), "usage", True),
        (API, "symbol_definition", first("attributes"), "", False), (API, "grep", first("modules"), "", False), (API, "inspect", first("sources"), "", False),
        (INTERFACE, "caller_search", real, "caller", True), (INTERFACE, "grep", call(real), "interface_producer", True), (INTERFACE, "inspect", first("stack_files"), "interface_consumer", True),
        (TESTS, "inspect", F.col("test_file"), "failed_test", True), (TESTS, "grep", sym, "neighbor_test", True), (TESTS, "grep", first("symbols", 1), "neighbor_test", True), (TESTS, "grep", F.col("test_method"), "neighbor_test", True), (TESTS, "grep", term, "", False),
        (ROOT, "grep", first("issue_symbols"), "", False), (ROOT, "grep", first("issue_symbols", 1), "", False), (ROOT, "grep", _stem(first("stack_files")), "", False), (ROOT, "inspect", F.col("top_file"), "", False),
        (CALLERS, "caller_search", real, "caller", True), (CALLERS, "grep", F.when(_stem(edit) != "", call(_stem(edit))), "usage", True), (CALLERS, "inspect", edit, "callee", True),
        (REGRESSION, "grep", _stem(edit), "", False), (REGRESSION, "inspect", F.col("test_file"), "", False), (REGRESSION, "grep", sym, "", False),
        (DEPENDENCY, "grep", F.concat(F.lit("import "), F.split_part(F.when(target != "", target), F.lit("."), F.lit(1))), "", False), (DEPENDENCY, "inspect", first(F.filter("files", lambda f: F.endswith(f, F.lit("__init__.py")))), "", False),
    ]
    failed = F.coalesce("has_failure", F.lit(False))
    return rules + [(DEPENDENCY, "grep", F.when(failed & F.contains(F.lower(said), F.lit(w)), F.lit(w)), "", False) for w in CONFIG_WORDS]


def typed_actions(rows: DataFrame) -> DataFrame:
    """(run_id, pos, cdtype, type, target, role, pair) of run_anchors(): type is inspect, or that of a search; pair names the group of actions that belong together. Targets that are missing, and searches of one letter, fall out."""
    entries = []
    for i, (cdtype, kind, target, role, paired) in enumerate(_rules()):
        shown = _full(target) if kind == "inspect" else target
        fits = (shown != "") if kind == "inspect" else (F.length(shown) >= 2)
        entries.append(F.when((F.col("cdtype") == cdtype) & fits, F.struct(F.lit(i).alias("pos"), F.lit(kind).alias("type"), shown.alias("target"), F.lit(role).alias("role"), F.lit("pair_1" if paired else "").alias("pair"))))
    return rows.select("run_id", "cdtype", F.explode(F.array_compact(F.array(*entries))).alias("a")).select("run_id", "a.pos", "cdtype", "a.type", "a.target", "a.role", "a.pair")


def _merged(typed: DataFrame, general: DataFrame, key: list[str], lead: Column) -> DataFrame:
    every = typed.select("run_id", *key, F.lit(0).alias("step"), "pos", F.lit("cdtype_driven_action").alias("source")).unionByName(general.select("run_id", *key, F.lit(1).alias("step"), "pos", "source"))
    sizes = every.groupBy("run_id").agg(F.count("*").alias("n"), F.max(F.col("step") == 0).alias("typed"))
    once = every.groupBy("run_id", *key).agg(F.min(F.struct("step", "pos", "source")).alias("f")).join(sizes.hint("merge"), "run_id")
    limit = F.when(F.col("typed"), F.least("n", F.lit(MOST_TYPED))).otherwise(MOST)
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(lead, "f.step", "f.pos", *key)))
    return ranked.where(F.col("rank") <= limit).select("run_id", "rank", *key, "f.source")


def merge_inspections(actions: DataFrame, general: DataFrame) -> DataFrame:
    """(run_id, rank, file, source): typed inspections before general ones (run_id, pos, file, source), each file once, 10 a run, 12 where there are typed ones."""
    return _merged(actions.where("type = 'inspect' AND target <> ''").withColumnRenamed("target", "file"), general.where("file <> ''"), ["file"], F.lit(0))


def merge_searches(actions: DataFrame, general: DataFrame) -> DataFrame:
    """(run_id, rank, type, query, source): typed and general searches (run_id, pos, type, query, source), each type and query once, as many as merge_inspections() keeps: typed ones for callers and definitions, definitions, callers, then the rest in order."""
    lead = F.when((F.col("f.step") == 0) & F.col("type").isin("caller_search", "symbol_definition"), 0).when(F.col("type") == "symbol_definition", 1).when(F.col("type") == "caller_search", 2).otherwise(3)
    return _merged(actions.where("type <> 'inspect'").withColumnRenamed("target", "query"), general, ["type", "query"], lead)
