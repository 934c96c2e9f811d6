"""Deficiency scores of runs and the searches that hypotheses ask for. Rule tables are data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Types in order of precedence, families of errors, priors and evidence weights.
TYPES = ["API_DEFINITION_CONTEXT", "INTERFACE_CONSTRAINT_CONTEXT", "RELATED_TEST_CONTEXT", "CALLER_CALLEE_CONTEXT", "ROOT_CAUSE_RELOCALIZATION", "REGRESSION_CONSTRAINT_CONTEXT", "DEPENDENCY_CONTEXT"]
API, INTERFACE, RELATED, CALLS, ROOT, REGRESSION, DEPENDENCY = TYPES
FAMILIES = {
    "ASSERTION_FAILURE": ["AssertionError"],
    "TYPE_OR_INTERFACE_FAILURE": ["TypeError", "ValueError", "KeyError", "IndexError"],
    "API_OR_SYMBOL_FAILURE": ["AttributeError", "NameError"],
    "IMPORT_OR_DEPENDENCY_FAILURE": ["ImportError", "ModuleNotFoundError", "OSError", "FileNotFoundError"],
    "RUNTIME_EXCEPTION": ["RuntimeError", "panic"],
}
COMPILE = r"compil(?:e|ation)\s+error|build\s+failed|cannot\s+compile|linker?\s+error|undefined\s+reference|expected\s+(?:parameter|identifier|type|expression)|no\s+matching\s+function|is\s+not\s+a\s+member|has\s+no\s+member|use\s+of\s+undeclared"
INFRA = r"no\s+test\s+files|platform\s+linux|installing|collecting|download|timeout\s+expired|connection\s+refused|network\s+unreachable|docker|killed"
FAMILY_PRIORS = [
    ("ASSERTION_FAILURE", RELATED, 0.25), ("ASSERTION_FAILURE", ROOT, 0.20), ("ASSERTION_FAILURE", REGRESSION, 0.15),
    ("TYPE_OR_INTERFACE_FAILURE", INTERFACE, 0.25), ("TYPE_OR_INTERFACE_FAILURE", CALLS, 0.20), ("TYPE_OR_INTERFACE_FAILURE", API, 0.15),
    ("API_OR_SYMBOL_FAILURE", API, 0.30), ("API_OR_SYMBOL_FAILURE", DEPENDENCY, 0.20), ("API_OR_SYMBOL_FAILURE", CALLS, 0.15),
    ("COMPILE_OR_BUILD_FAILURE", INTERFACE, 0.25), ("COMPILE_OR_BUILD_FAILURE", API, 0.20), ("COMPILE_OR_BUILD_FAILURE", DEPENDENCY, 0.15),
    ("RUNTIME_EXCEPTION", ROOT, 0.25), ("RUNTIME_EXCEPTION", CALLS, 0.20), ("RUNTIME_EXCEPTION", INTERFACE, 0.15),
    ("IMPORT_OR_DEPENDENCY_FAILURE", DEPENDENCY, 0.30), ("IMPORT_OR_DEPENDENCY_FAILURE", API, 0.20),
]
ERROR_PRIORS = [
    ("AttributeError", API, 0.6), ("AttributeError", ROOT, 0.2), ("TypeError", INTERFACE, 0.5), ("TypeError", CALLS, 0.3),
    ("AssertionError", RELATED, 0.4), ("AssertionError", ROOT, 0.3), ("AssertionError", REGRESSION, 0.1), ("RuntimeError", CALLS, 0.5), ("RuntimeError", API, 0.2),
    ("ImportError", DEPENDENCY, 0.7), ("ImportError", API, 0.1), ("ModuleNotFoundError", DEPENDENCY, 0.7), ("ModuleNotFoundError", API, 0.1),
    ("ValueError", INTERFACE, 0.4), ("ValueError", CALLS, 0.3), ("KeyError", CALLS, 0.4), ("KeyError", API, 0.3), ("IndexError", CALLS, 0.4), ("IndexError", API, 0.3),
    ("OSError", DEPENDENCY, 0.4), ("FileNotFoundError", DEPENDENCY, 0.4),
]
UNIFORM = 0.1
EVIDENCE = [
    ("mode = 'oscillating'", RELATED, 0.3), ("mode = 'oscillating'", REGRESSION, 0.3), ("mode = 'jumping'", CALLS, 0.1), ("mode = 'shallow_scan'", DEPENDENCY, 0.2), ("mode = 'focused'", API, 0.1),
    ("edit_alignment = 'edited_elsewhere'", CALLS, 0.3), ("edit_alignment = 'edited_elsewhere'", ROOT, 0.2), ("edit_alignment = 'viewed_not_edited'", INTERFACE, 0.2), ("edit_alignment = 'viewed_not_edited'", API, 0.2),
    ("edit_alignment = 'error_file_never_viewed'", ROOT, 0.3), ("edit_alignment = 'error_file_never_viewed' AND error_type IN ('AttributeError', 'NameError', 'ImportError', 'ModuleNotFoundError')", API, 0.3),
    ("edit_alignment = 'aligned'", ROOT, -0.3), ("regression", REGRESSION, 0.4), ("visit_alignment = 'visited_none'", ROOT, 0.2),
]
PATCH = [("files_edited = 0", ROOT, 0.2), ("files_edited = 0", API, 0.2), ("files_edited > 1", CALLS, 0.2)]
#: Subtype -> (what to search, where its targets come from).
ACTIONS = {
    "FRAME_ATTRIBUTE_PROPAGATION": ("FIND_DEFINITION", "site"), "FUNCTION_SIGNATURE_MISMATCH": ("FIND_DEFINITION", "site"), "METHOD_NOT_FOUND": ("FIND_DEFINITION", "site"),
    "ARGUMENT_TYPE_MISMATCH": ("FIND_CALLERS", "symbols"), "FRAME_ATTRIBUTE_CONSTRAINT": ("FIND_CALLERS", "symbols"),
    "NUMERICAL_MISMATCH": ("FIND_RELATED_TESTS", "symbols"), "REGRESSION_DETECTED": ("FIND_RELATED_TESTS", "symbols"), "ROUTE_COMPARISON_FAILURE": ("FIND_PARALLEL_IMPLEMENTATION", "site"),
    "ARGUMENT_FORWARDING_MISMATCH": ("FIND_CALLEES", "symbols"), "TRANSFORM_NOT_REGISTERED": ("FIND_REGISTRATION_SITE", "site"), "MISSING_IMPORT": ("FIND_DEFINITION", "site"),
}
KINDS = {
    "FIND_DEFINITION": ["SYMBOL", "FILE", "FAILURE_SITE", "TYPE_NAME"], "FIND_PARALLEL_IMPLEMENTATION": ["SYMBOL", "FILE", "BEHAVIOR"], "FIND_RELATED_TESTS": ["SYMBOL", "FILE", "TEST", "BEHAVIOR"],
    "FIND_CALLEES": ["SYMBOL"], "FIND_CALLERS": ["SYMBOL"], "FIND_REGISTRATION_SITE": ["FILE", "SYMBOL"],
}
BUILTINS = ["str", "int", "float", "complex", "list", "tuple", "set", "frozenset", "dict", "bytes", "bytearray", "bool", "object", "type", "NoneType", "None", "True", "False", "Optional", "List", "Dict", "Tuple", "Set", "Type", "Any", "Callable", "Union", "Iterable", "Iterator", "Generator"]


def _texts(values: list[str]):
    return F.array(*(F.lit(v) for v in values))


def failure_family(witnesses: DataFrame) -> DataFrame:
    """Adds family to (error_type, error_message)."""
    out = F.when(F.lit(False), "")
    for family, errors in FAMILIES.items():
        out = out.when(F.col("error_type").isin(errors), family)
    low = F.lower(F.coalesce("error_message", F.lit("")))
    built = F.when(low.rlike(COMPILE), "COMPILE_OR_BUILD_FAILURE").when(low.rlike(INFRA), "INFRASTRUCTURE_FAILURE").otherwise("COMPILE_OR_BUILD_FAILURE")
    return witnesses.withColumn("family", out.when(F.lower("error_type").rlike("build|infra"), built).otherwise("GENERIC_TEST_FAILURE"))


def _points(rules: list[tuple[str, str, float]]):
    """Per type the sum of the weights of the rules that hold, as an array in the order of TYPES."""
    return F.array(*(sum((F.when(F.expr(c), F.lit(w)).otherwise(F.lit(0.0)) for c, t, w in rules if t == kind), F.lit(0.0)) for kind in TYPES))


def deficiency_scores(features: DataFrame) -> DataFrame:
    """(run_id, place, type, prior, signal, patch, score): 0.4 prior + 0.4 signal + 0.2 patch, within 0 and 1.

    features: run_id, error_type, family, mode, edit_alignment, visit_alignment, regression, files_edited.
    """
    pick = lambda table, col, kind: F.coalesce(*[F.when(F.col(col) == k, F.lit(p)) for k, t, p in table if t == kind] or [F.lit(None).cast("double")])
    prior = F.array(*(F.coalesce(pick(ERROR_PRIORS, "error_type", t), pick(FAMILY_PRIORS, "family", t), F.lit(UNIFORM)) for t in TYPES))
    rows = features.select("run_id", "visit_alignment", F.posexplode(F.arrays_zip(_texts(TYPES).alias("type"), prior.alias("prior"), _points(EVIDENCE).alias("signal"), _points(PATCH).alias("patch"))).alias("place", "x"))
    score = F.col("prior") * 0.4 + F.col("signal") * 0.4 + F.col("patch") * 0.2
    return rows.select("run_id", "visit_alignment", "place", "x.*").withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def deficiency_confidence(scores: DataFrame) -> DataFrame:
    """(run_id, primary, confidence): the best type, or unknown below 0.15 of score or 0.30 of confidence; of ties the first type."""
    w = Window.partitionBy("run_id")
    ranked = scores.withColumns({"r": F.row_number().over(w.orderBy(F.desc("score"), "place")), "active": F.count_if(F.col("signal") > 0.001).over(w)}).where("r <= 2")
    at = lambda r, c: F.max(F.when(F.col("r") == r, F.col(c)))
    top = ranked.groupBy("run_id").agg(at(1, "type").alias("type"), at(1, "score").alias("s1"), at(2, "score").alias("s2"), at(1, "signal").alias("g1"), at(2, "signal").alias("g2"), F.max("active").alias("active"), F.max("visit_alignment").alias("visit"))
    part = lambda x, most: F.greatest(F.lit(0.0), F.least(x, F.lit(most)))
    total = F.col("s1") * 0.25 + F.least((F.col("s1") - F.col("s2")) * 2.5, F.lit(0.30)) + part(F.col("g1") - F.col("g2"), 0.20) + F.when(F.col("visit").isin("visited_error_file", "visited_stack_frame"), 0.15).otherwise(0.0) + F.least(F.col("active") * 0.05, F.lit(0.10))
    sure = part(total, 1.0)
    return top.withColumn("confidence", sure).select("run_id", F.when((F.col("s1") < 0.15) | (F.col("confidence") < 0.30), "unknown").otherwise(F.col("type")).alias("primary"), "confidence")


def error_edit_alignment(frames: DataFrame, edits: DataFrame, views: DataFrame, near: int = 50) -> DataFrame:
    """(run_id, alignment) of frames (run_id, file, line, symbol) against edits (run_id, file, line, text) and views (run_id, file).

    aligned: an edit of a frame's file within ``near`` lines or naming its symbol; edited_elsewhere:
    the file alone; viewed_not_edited: seen only; else error_file_never_viewed.
    """
    f, e = frames.alias("f"), edits.alias("e")
    same = f.join(e.hint("merge"), (F.col("f.run_id") == F.col("e.run_id")) & (F.col("f.file") == F.col("e.file")))
    close = (F.abs(F.col("f.line") - F.col("e.line")) <= near) | F.coalesce(F.contains("e.text", "f.symbol"), F.lit(False))
    edited = same.groupBy("f.run_id").agg(F.max(close).alias("close"))
    seen = frames.join(views, ["run_id", "file"], "left_semi").select("run_id").distinct().withColumn("seen", F.lit(True))
    label = F.when(F.col("close"), "aligned").when(~F.col("close"), "edited_elsewhere").when(F.col("seen"), "viewed_not_edited").otherwise("error_file_never_viewed")
    return frames.select("run_id").distinct().join(edited, "run_id", "left").join(seen, "run_id", "left").select("run_id", label.alias("alignment"))


def search_targets(hypotheses: DataFrame, most: int = 2) -> DataFrame:
    """(hypothesis_id, ord, action, value, kind) of hypotheses (hypothesis_id, subtype, sites, symbols): no builtins, identifiers only; a capital leaf is a type name."""
    table = F.create_map(*(x for k, (action, origin) in ACTIONS.items() for x in (F.lit(k), F.struct(F.lit(action).alias("action"), F.lit(origin).alias("origin")))))
    known = hypotheses.withColumn("a", F.try_element_at(table, F.col("subtype"))).where("a IS NOT NULL")
    fine = F.filter("symbols", lambda s: s.rlike(r"^[A-Za-z_][A-Za-z0-9_.]*$") & ~s.isin(BUILTINS))
    leaf = lambda s: F.element_at(F.split(s, r"\."), -1)
    named = F.transform(F.slice(fine, 1, most), lambda s: F.struct(s.alias("value"), F.when(leaf(s).rlike("^[A-Z]"), "TYPE_NAME").otherwise("SYMBOL").alias("kind")))
    sites = F.transform(F.slice("sites", 1, most), lambda s: F.struct(s.alias("value"), F.when(F.col("a.action") == "FIND_DEFINITION", "FAILURE_SITE").otherwise("FILE").alias("kind")))
    return known.select("hypothesis_id", F.col("a.action").alias("action"), F.posexplode(F.when(F.col("a.origin") == "symbols", named).otherwise(sites)).alias("ord", "t")).select("hypothesis_id", "ord", "action", "t.*")


def search_contracts(hypotheses: DataFrame, targets: DataFrame, budget: int = 2) -> DataFrame:
    """(hypothesis_id, n_actions, budget, status): targets whose kind an action takes make a contract; without one it abstains with a reason."""
    fits = sum((F.when((F.col("action") == a) & F.col("kind").isin(kinds), 1).otherwise(0) for a, kinds in KINDS.items()), F.lit(0)) > 0
    counted = targets.groupBy("hypothesis_id").agg(F.count("*").alias("n"), F.count_if(fits).alias("n_actions"))
    joined = hypotheses.join(counted, "hypothesis_id", "left").withColumn("n_actions", F.coalesce("n_actions", F.lit(0).cast("long")))
    status = F.when(F.col("n").isNull(), "no_target").when(F.col("n_actions") == 0, "no_compatible_target").otherwise("actionable")
    return joined.select("hypothesis_id", "n_actions", (F.col("n_actions") * budget).alias("budget"), status.alias("status"))


def validate_contracts(actions: DataFrame, ledger: DataFrame) -> DataFrame:
    """(hypothesis_id, ord, issue): empty and builtin targets, kinds that the action doesn't take, evidence that no ledger row (evidence_id) has."""
    fits = F.coalesce(*(F.when(F.col("action") == a, F.col("kind").isin(kinds)) for a, kinds in KINDS.items()), F.lit(True))
    known = ledger.select(F.col("evidence_id").alias("value"), F.lit(True).alias("known")).distinct()
    checks = F.array_compact(F.array(
        F.when(F.coalesce("value", F.lit("")) == "", "empty"), F.when(F.col("value").isin(BUILTINS), "builtin"), F.when(~fits, "incompatible"),
        F.when((F.col("kind") == "EVIDENCE") & F.col("known").isNull(), "unresolved"),
    ))
    return actions.join(known.hint("merge"), "value", "left").select("hypothesis_id", "ord", F.explode(checks).alias("issue"))
