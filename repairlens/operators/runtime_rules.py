"""Rules over what a run shows while it goes on: retry triggers, pathologies, deficiencies, relocalisation, constraints and hints.

Features (all optional counts are taken as 0 where null): run_id, exit_status, test_runs,
test_failures, git_checkouts, edited_files, changed_files, changed_lines, repeated_pattern,
submitted_without_tests, viewed_files, viewed_not_final, edited_not_viewed, scope_score,
regressions. Every operator is one projection; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ["test_runs", "test_failures", "git_checkouts", "edited_files", "changed_files", "changed_lines", "viewed_files", "viewed_not_final", "edited_not_viewed", "scope_score", "regressions"]
FLAGS = ["repeated_pattern", "submitted_without_tests"]

# Exit states of a hard failure; triggers in order of precedence with their condition, gap and confidence.
HARD = ["timeout", "Timeout", "format_error", "FormatError", "no_patch", "NoPatch", "patch_apply_failure", "PatchApplyFailure", "errored", "Errored", "error", "Error"]
TRIGGERS = [
    ("HARD_FAILURE", f"trim(exit_status) IN ({', '.join(repr(x) for x in HARD)})", "TERMINATION_FAILURE", "high"),
    ("RUNTIME_VALIDATION_FAILURE", "test_failures >= 1 AND test_runs >= 3 AND git_checkouts >= 2 AND edited_files <= 2", "CONSTRAINT_CONFLICT", "high"),
    ("PATCH_SHAPE_ANOMALY", "scope_score >= 2 OR edited_files >= 5 OR changed_lines >= 200 OR repeated_pattern OR (submitted_without_tests AND edited_files >= 3)", "NOISY_OVERBROAD", "high"),
    ("EVIDENCE_EDIT_MISMATCH", "edited_not_viewed >= 1 OR viewed_not_final >= 3", "SEEN_BUT_DROPPED", "medium"),
    ("PARTIAL_FIX_SUSPICION", "edited_files BETWEEN 1 AND 2 AND changed_lines <= 50 AND test_runs >= 1 AND NOT submitted_without_tests", "UNSEEN_CANDIDATE", "medium"),
]
NO_TRIGGER = ("NO_TRIGGER", "SUFFICIENT_OR_NOOP", "high")

# Pathologies in order, with trigger, action family, action and the confidence, null where the rule doesn't hold.
PATHOLOGIES = [
    ("REGRESSION_AFTER_PARTIAL_FIX", "RUNTIME_VALIDATION_FAILURE", "RECOVERY", "RECONCILE", "CASE WHEN test_runs >= 3 AND git_checkouts >= 2 AND edited_files <= 2 THEN CASE WHEN test_failures > 0 THEN 0.88 ELSE 0.75 END END"),
    ("OVER_EXPLORE_OVER_EDIT", "PATCH_SHAPE_ANOMALY", "GUARD", "RESTRAIN", "CASE WHEN scope_score >= 4 THEN 0.9 WHEN scope_score >= 3 THEN 0.75 WHEN scope_score >= 2 THEN 0.5 END"),
    ("EXPLORE_OK_EDIT_MISALIGNED", "EVIDENCE_EDIT_MISMATCH", "RECOVERY", "REHYDRATE", "CASE WHEN edited_not_viewed > 0 THEN 0.7 WHEN viewed_not_final >= 3 THEN 0.6 END"),
    ("UNDER_EDIT_PARTIAL_FIX", "PARTIAL_FIX_SUSPICION", "RECOVERY", "RETRIEVE", "CASE WHEN edited_files BETWEEN 1 AND 2 AND changed_lines <= 50 AND test_runs >= 1 AND NOT submitted_without_tests AND scope_score <= 1 THEN CASE WHEN test_failures > 0 THEN 0.6 ELSE 0.5 END END"),
]

# What an issue may mention, and deficiency rules with their score.
MENTIONS = {
    "override": r"(?i)\b(override|subclass|inherit)\b",
    "subparser": r"(?i)\bsubparser\b",
    "error_format": r"(?i)\berror\b.*\b(format|message)\b",
    "type_error": r"(?i)\bTypeError\b",
    "attribute": r"(?i)\b(AttributeError|has no attribute)\b",
    "zero": r"(?i)\bzero\b",
    "print": r"(?i)\bprint(s|ed|ing)?\b",
    "bool": r"(?i)\bbool\b|__bool__|__nonzero__",
    "inner_class": r"(?i)\binner\b.*\bclass\b",
    "serialize": r"(?i)\bserializ\w+\b",
    "pk": r"(?i)\bpk\b",
    "ordering": r"(?i)\border\w+\b",
    "suppress": r"(?i)(?:__)?suppress(?:_context)?(?:__)?\b|\bsuppress\b",
}
DEFICIENCIES = [
    ("REGRESSION_CONSTRAINT_CONTEXT", 0.70, "trigger = 'EVIDENCE_EDIT_MISMATCH' AND viewed_files >= 8", ["subparser", "override", "error_format"]),
    ("ROOT_CAUSE_RELOCALIZATION", 0.65, "trigger = 'EVIDENCE_EDIT_MISMATCH' AND viewed_not_final >= 5 AND edited_files <= 2", ["serialize", "inner_class", "zero", "bool", "print"]),
    ("INTERFACE_CONSTRAINT_CONTEXT", 0.60, "changed_lines <= 20", ["type_error", "pk", "ordering", "suppress", "attribute"]),
    ("EDIT_SCOPE_CONTEXT", 0.55, "changed_lines >= 20 AND edited_files >= 1", []),
    ("RELATED_TEST_CONTEXT", 0.55, "trigger = 'PARTIAL_FIX_SUSPICION' AND test_runs >= 3", []),
    ("API_DEFINITION_CONTEXT", 0.50, "edited_files <= 2 AND changed_lines <= 15 AND viewed_files >= 3", []),
    ("RELATED_TEST_CONTEXT", 0.40, "true", []),
]

# Words that say that a search is about the failure itself; words that are no hint; the longest list of hints.
FAILURE_WORDS = "error|exception|warning|traceback|failed|fail"
NO_HINTS = [
    "the", "and", "for", "with", "this", "that", "from", "have", "should", "when", "while", "into", "them", "then", "what", "where", "which",
    "django", "issue", "patch", "test", "tests", "description", "error", "raise", "raises", "raised", "expected", "actual", "traceback",
]
MOST_HINTS = 40
# By deficiency, the kinds of hints and the patterns that find them in an issue; group 1 where there is one.
HINTS = {
    "ROOT_CAUSE_RELOCALIZATION": [("symbol", r"\b([A-Z][a-zA-Z0-9]+(?:\.[A-Z][a-zA-Z0-9]+)+)\b"), ("symbol", r"\b([A-Za-z_][A-Za-z0-9_]+(?:\.[A-Za-z_][A-Za-z0-9_]+)+)\b"), ("symbol", r"\b([A-Z][a-zA-Z0-9]+)\b")],
    "INTERFACE_CONSTRAINT_CONTEXT": [("symbol", r"\b([a-z_]+)\([^)]*\)"), ("symbol", r"(__\w+__)")],
    "REGRESSION_CONSTRAINT_CONTEXT": [("symbol", r"(?i)\b((?:add_|set_|override_|get_)\w+)\b"), ("symbol", r"\b(\w+Error)\b")],
    "RELATED_TEST_CONTEXT": [("test", r"(?i)\b(test_\w+)\b"), ("concept", r"(?i)\b(?:assert|expect|should|must)\s+(\w+)")],
    "": [("concept", r"\b([A-Za-z_][A-Za-z0-9_]{3,})\b"), ("symbol", r"\b([A-Z][a-zA-Z0-9]+(?:[A-Z][a-z]+)+)\b")],
}


def _clean(features: DataFrame) -> DataFrame:
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in COUNTS if c in features.columns}
    return features.withColumns(zero | {c: F.coalesce(F.col(c), F.lit(False)) for c in FLAGS if c in features.columns} | {c: F.coalesce(F.col(c), F.lit("")) for c in ("exit_status", "issue") if c in features.columns})


def retry_cascade(features: DataFrame) -> DataFrame:
    """(run_id, should_retry, trigger, gap, confidence, alternatives): the first trigger that holds, and the others that do."""
    hits = F.array_compact(F.array(*(F.when(F.expr(c), F.struct(F.lit(n).alias("n"), F.lit(g).alias("g"), F.lit(k).alias("k"))) for n, c, g, k in TRIGGERS)))
    top = F.coalesce(F.get("hits", F.lit(0)), F.struct(*(F.lit(x).alias(a) for x, a in zip(NO_TRIGGER, "ngk"))))
    rest = F.array_join(F.transform(F.slice("hits", 2, len(TRIGGERS)), lambda x: x["n"]), ",")
    return _clean(features).withColumn("hits", hits).withColumn("top", top).select("run_id", (F.size("hits") > 0).alias("should_retry"), F.col("top.n").alias("trigger"), F.col("top.g").alias("gap"), F.col("top.k").alias("confidence"), rest.alias("alternatives"))


def trigger_candidates(features: DataFrame) -> DataFrame:
    """(run_id, rank, pathology, trigger, family, action, confidence): every pathology whose rule holds, the most confident first, ties in order."""
    labels = ("pathology", "trigger", "family", "action")
    minus = lambda p: (-F.expr(p[4]).cast("double")).alias("minus")
    each = (F.when(F.expr(p[4]).isNotNull(), F.struct(minus(p), F.lit(i).alias("place"), *(F.lit(x).alias(a) for x, a in zip(p, labels)))) for i, p in enumerate(PATHOLOGIES))
    found = F.array_sort(F.array_compact(F.array(*each)))
    rows = _clean(features).select("run_id", F.posexplode(found).alias("rank", "x"))
    return rows.select("run_id", "rank", "x.pathology", "x.trigger", "x.family", "x.action", (-F.col("x.minus")).alias("confidence"))


def rule_deficiency(features: DataFrame) -> DataFrame:
    """(run_id, deficiency, confidence, secondaries) of features with trigger and issue: the rule of highest score, ties in order, and up to three others of another type."""
    mentions = lambda names: F.lit(True) if not names else F.col("issue").rlike("|".join(f"(?:{MENTIONS[n]})" for n in names))
    found = F.array_compact(F.array(*(F.when(F.expr(cond) & mentions(names), F.struct(F.lit(kind).alias("kind"), F.lit(score).alias("score"))) for kind, score, cond, names in DEFICIENCIES)))
    rows = _clean(features).select("run_id", found.alias("found"))
    first = F.get("found", F.lit(0))
    others = F.filter(F.transform(F.slice("found", 2, 3), lambda x: x["kind"]), lambda k: k != first["kind"])
    return rows.select("run_id", first["kind"].alias("deficiency"), first["score"].alias("confidence"), F.array_join(others, ",").alias("secondaries"))


def relocalize_score(features: DataFrame) -> DataFrame:
    """(run_id, score, strength, searched, ten components) of features with origin_files, tokens, searches, edited, final (arrays of file names without folders) and has_failure."""
    lists = {c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("origin_files", "tokens", "searches", "edited", "final")}
    some = lambda c: F.size(c) > 0
    rows = _clean(features).withColumns(lists).withColumn("said", F.lower(F.array_join("searches", " ")))
    rows = rows.withColumn("searched", F.filter("tokens", lambda t: F.contains(F.col("said"), F.lower(t))))
    surface = some("searches") & F.col("said").rlike("grep|rg |ag ") & ~F.col("said").rlike(FAILURE_WORDS)
    points = {
        "has_failure_signal": F.when(some("origin_files") & (F.col("test_failures") > 0), 2).when(F.coalesce("has_failure", F.lit(False)) | some("origin_files") | some("tokens"), 1).otherwise(0),
        "has_visible_error_tokens": F.when(some("tokens"), 2).otherwise(0),
        "error_token_search_missing": F.when(some("tokens") & ~some("searched"), 2).otherwise(0),
        "origin_file_not_edited": F.when(some("origin_files") & ~F.arrays_overlap("origin_files", "edited"), 1).otherwise(0),
        "small_patch_still_failed": F.when((F.col("changed_files") <= 3) & (F.col("test_failures") > 0), 1).otherwise(0),
        "issue_surface_oriented": F.when(surface & some("tokens"), 1).otherwise(0),
        "origin_not_in_final_patch": F.when(some("origin_files") & ~F.arrays_overlap("origin_files", "final"), 1).otherwise(0),
        "patch_shape_anomaly_strong": F.when((F.col("changed_files") >= 8) & F.col("repeated_pattern"), -2).otherwise(0),
        "visible_regression_many": F.when(F.col("regressions") >= 3, -1).otherwise(0),
        "viewed_but_dropped": F.when(F.col("viewed_not_final") >= 2, -2).otherwise(0),
    }
    rows = rows.select("run_id", F.array_join("searched", ",").alias("searched"), *(c.alias(n) for n, c in points.items()))
    score = sum((F.col(n) for n in points), F.lit(0))
    return rows.withColumn("score", score).withColumn("strength", F.when(F.col("score") >= 5, "strong").when(F.col("score") >= 3, "weak").otherwise("none"))


def structured_constraints(features: DataFrame) -> DataFrame:
    """(run_id, place, constraint, severity, parameters) of features with edit_alignment, mode, dropped (array) and error_file."""
    kinds: list[tuple[str, str, Column, Column]] = [
        ("FORBID_TEST_EDITS", "required", F.lit(True), F.lit("")),
        ("REQUIRE_INSPECTION_BEFORE_EDIT", "required", F.col("edit_alignment") == "error_file_never_viewed", F.concat(F.lit("target_path="), F.coalesce("error_file", F.lit("")))),
        ("AVOID_REPETITIVE_TEST_RUNS", "recommended", F.col("mode") == "oscillating", F.lit("min_gap_actions=1")),
        ("REVISIT_DROPPED_FILES", "recommended", F.size("dropped") >= 3, F.concat(F.lit("file_paths="), F.array_join(F.slice("dropped", 1, 5), ","))),
        ("PREFER_SINGLE_FILE_FIX", "informational", F.col("edited_files") >= 4, F.lit("max_files=1")),
    ]
    found = F.array_compact(F.array(*(F.when(cond, F.struct(F.lit(n).alias("constraint"), F.lit(s).alias("severity"), p.alias("parameters"))) for n, s, cond, p in kinds)))
    return _clean(features).select("run_id", F.posexplode(found).alias("place", "x")).select("run_id", "place", "x.*")


def target_hints(runs: DataFrame) -> DataFrame:
    """(run_id, place, kind, value) of runs (run_id, deficiency, issue, edited, viewed): names of edited and viewed files, then what the issue mentions, each once, at most 40.

    Nulls count as empty. Hints of fewer than four characters and common words are left out.
    """
    stem = lambda p: F.regexp_extract(F.regexp_extract(p, r"([^/]*)/*$", 1), r"^(.+?)(\.[^.]*)?$", 1)
    none = F.array().cast("array<string>")
    good = lambda v: (F.length(v) >= 4) & ~F.lower(v).isin(NO_HINTS)
    rows = _clean(runs).withColumn("files", F.transform(F.concat(F.coalesce("edited", none), F.coalesce("viewed", none)), stem))
    kind_of = F.coalesce(*(F.when(F.col("deficiency") == d, F.lit(d)) for d in HINTS if d), F.lit(""))
    rows = rows.withColumn("rule", kind_of)
    sources = [("file", F.col("files"))]
    for slot in range(max(map(len, HINTS.values()))):
        for kind in ("symbol", "test", "concept"):
            options = [(d, p[slot][1]) for d, p in HINTS.items() if slot < len(p) and p[slot][0] == kind]
            if options:
                sources.append((kind, F.coalesce(*(F.when(F.col("rule") == d, F.regexp_extract_all("issue", F.lit("(?U)" + p), F.lit(1))) for d, p in options), none)))
    rows = rows.select("run_id", *(F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), good)).alias(f"s{i}") for i, (_, values) in enumerate(sources)))
    before = none
    for i in range(len(sources)):
        rows = rows.withColumn(f"n{i}", F.slice(F.array_except(f"s{i}", before), 1, MOST_HINTS))
        before = F.concat(before, F.col(f"s{i}"))
    listed = F.concat(*(_named(f"n{i}", kind) for i, (kind, _) in enumerate(sources)))
    return rows.select("run_id", F.posexplode(F.slice(listed, 1, MOST_HINTS)).alias("place", "x")).select("run_id", "place", "x.*")


def _named(values: str, kind: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
