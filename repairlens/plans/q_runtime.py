"""Queries over runtime rules, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from repairlens.operators import runtime_rules as rr
from repairlens.plans.fixtures import oracle, query

_text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
_k = lambda n: F.col("run_id") % n


def _deficiency(runtime, issues):
    """Every run with the issue of its number, where there is one."""
    told = runtime.join(rr.retry_cascade(runtime).select("run_id", "trigger").hint("merge"), "run_id")
    return rr.rule_deficiency(told.join(issues.select(F.col("instance_id").alias("run_id"), "issue").hint("merge"), "run_id", "left"))


def _relocalized(runtime):
    lists = {
        "origin_files": F.when(_k(3) > 0, F.array(_text("m", _k(5), ".py"))),
        "tokens": F.when(_k(4) > 0, F.array(_text("E", _k(7)), F.lit("DJ9"))),
        "searches": F.array(_text("grep -rn ", F.when(_k(2) == 0, _text("e", _k(9))).otherwise("Error"))),
        "edited": F.array(_text("m", _k(4), ".py")),
        "final": F.array(_text("m", _k(6), ".py")),
        "has_failure": _k(8) == 0,
    }
    return rr.relocalize_score(runtime.withColumns(lists))


def _constraints(runtime):
    dropped = F.slice(F.array(F.lit("a.py"), F.lit("b.py"), F.lit("c.py"), F.lit("d.py"), F.lit("e.py"), F.lit("f.py")), F.lit(1), (_k(7)).cast("int"))
    return rr.structured_constraints(runtime.withColumns({"edit_alignment": F.when(_k(3) == 0, "error_file_never_viewed").otherwise("aligned"), "mode": F.when(_k(5) == 0, "oscillating").otherwise("focused"), "dropped": dropped, "error_file": F.when(_k(2) == 0, _text("src/m", _k(9), ".py"))}))


def _hints(issues):
    kind = F.element_at(F.array(*(F.lit(d or "OTHER") for d in rr.HINTS)), (F.col("instance_id") % len(rr.HINTS) + 1).cast("int"))
    files = lambda n: F.array(F.concat(F.lit("src/module_"), (F.col("instance_id") % n).cast("string"), F.lit(".py")))
    return rr.target_hints(issues.select(F.col("instance_id").alias("run_id"), kind.alias("deficiency"), "issue", files(5).alias("edited"), files(3).alias("viewed")))


QUERIES = {
    "retry_cascade": query(rr.retry_cascade, "runtime"),
    "trigger_candidates": query(rr.trigger_candidates, "runtime"),
    "rule_deficiency": query(_deficiency, "runtime", "issues"),
    "relocalize_score": query(_relocalized, "runtime"),
    "structured_constraints": query(_constraints, "runtime"),
    "target_hints": query(_hints, "issues"),
}

_HITS = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c, _, _ in rr.TRIGGERS) + "], lambda x: x IS NOT NULL)"
_OF = lambda place, other: "CASE h[1] " + " ".join(f"WHEN '{t[0]}' THEN '{t[place]}'" for t in rr.TRIGGERS) + f" ELSE '{other}' END"
_MENTIONED = lambda names: "true" if not names else "(" + " OR ".join(f"regexp_matches(issue, '{rr.MENTIONS[n]}')" for n in names) + ")"
_FOUND = "list_filter([" + ", ".join(f"CASE WHEN {c} AND {_MENTIONED(m)} THEN {{'kind': '{k}', 'score': {s}}} END" for k, s, c, m in rr.DEFICIENCIES) + "], lambda x: x IS NOT NULL)"

ORACLES = {
    "retry_cascade": oracle("runtime", f"t AS (SELECT run_id, {_HITS} AS h FROM runtime) SELECT run_id, len(h) > 0 AS should_retry, coalesce(h[1], 'NO_TRIGGER') AS trigger, {_OF(2, rr.NO_TRIGGER[1])} AS gap, {_OF(3, rr.NO_TRIGGER[2])} AS confidence, array_to_string(h[2:], ',') AS alternatives FROM t"),
    "trigger_candidates": oracle("runtime", "c AS (" + " UNION ALL ".join(f"SELECT run_id, {i} AS place, '{p}' AS pathology, '{t}' AS trigger, '{f}' AS family, '{a}' AS action, CAST({c} AS DOUBLE) AS confidence FROM runtime" for i, (p, t, f, a, c) in enumerate(rr.PATHOLOGIES)) + """)
SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY confidence DESC, place) - 1 AS INT) AS rank, pathology, trigger, family, action, confidence FROM c WHERE confidence IS NOT NULL"""),
    "rule_deficiency": oracle("runtime issues", f"""t AS (SELECT r.*, coalesce({_HITS}[1], 'NO_TRIGGER') AS trigger, coalesce(i.issue, '') AS issue FROM runtime r LEFT JOIN issues i ON i.instance_id = r.run_id), f AS (SELECT run_id, {_FOUND} AS f FROM t)
SELECT run_id, f[1].kind AS deficiency, CAST(f[1].score AS DOUBLE) AS confidence, array_to_string(list_filter(list_transform(f[2:4], lambda x: x.kind), lambda k: k <> f[1].kind), ',') AS secondaries FROM f"""),
    "relocalize_score": oracle("runtime", f"""t AS (SELECT *, run_id % 3 > 0 AS o, run_id % 4 > 0 AS k, run_id % 4 > 0 AND run_id % 2 = 0 AND starts_with('e' || (run_id % 9), 'e' || (run_id % 7)) AS hit FROM runtime),
p AS (SELECT run_id, CASE WHEN hit THEN 'E' || (run_id % 7) ELSE '' END AS searched, CASE WHEN o AND test_failures > 0 THEN 2 WHEN run_id % 8 = 0 OR o OR k THEN 1 ELSE 0 END AS has_failure_signal, CASE WHEN k THEN 2 ELSE 0 END AS has_visible_error_tokens, CASE WHEN k AND NOT hit THEN 2 ELSE 0 END AS error_token_search_missing,
  CASE WHEN o AND run_id % 5 <> run_id % 4 THEN 1 ELSE 0 END AS origin_file_not_edited, CASE WHEN changed_files <= 3 AND test_failures > 0 THEN 1 ELSE 0 END AS small_patch_still_failed, CASE WHEN k AND run_id % 2 = 0 THEN 1 ELSE 0 END AS issue_surface_oriented, CASE WHEN o AND run_id % 5 <> run_id % 6 THEN 1 ELSE 0 END AS origin_not_in_final_patch,
  CASE WHEN changed_files >= 8 AND repeated_pattern THEN -2 ELSE 0 END AS patch_shape_anomaly_strong, CASE WHEN regressions >= 3 THEN -1 ELSE 0 END AS visible_regression_many, CASE WHEN viewed_not_final >= 2 THEN -2 ELSE 0 END AS viewed_but_dropped FROM t),
s AS (SELECT *, has_failure_signal + has_visible_error_tokens + error_token_search_missing + origin_file_not_edited + small_patch_still_failed + issue_surface_oriented + origin_not_in_final_patch + patch_shape_anomaly_strong + visible_regression_many + viewed_but_dropped AS score FROM p)
SELECT *, CASE WHEN score >= 5 THEN 'strong' WHEN score >= 3 THEN 'weak' ELSE 'none' END AS strength FROM s"""),
    "structured_constraints": oracle("runtime", """c AS (SELECT run_id, 0 AS p, 'FORBID_TEST_EDITS' AS "constraint", 'required' AS severity, '' AS parameters FROM runtime
  UNION ALL SELECT run_id, 1, 'REQUIRE_INSPECTION_BEFORE_EDIT', 'required', 'target_path=' || CASE WHEN run_id % 2 = 0 THEN 'src/m' || (run_id % 9) || '.py' ELSE '' END FROM runtime WHERE run_id % 3 = 0
  UNION ALL SELECT run_id, 2, 'AVOID_REPETITIVE_TEST_RUNS', 'recommended', 'min_gap_actions=1' FROM runtime WHERE run_id % 5 = 0
  UNION ALL SELECT run_id, 3, 'REVISIT_DROPPED_FILES', 'recommended', 'file_paths=' || array_to_string((['a.py', 'b.py', 'c.py', 'd.py', 'e.py'])[1:run_id % 7], ',') FROM runtime WHERE run_id % 7 >= 3
  UNION ALL SELECT run_id, 4, 'PREFER_SINGLE_FILE_FIX', 'informational', 'max_files=1' FROM runtime WHERE edited_files >= 4)
SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY p) - 1 AS INT) AS place, "constraint", severity, parameters FROM c"""),
}
