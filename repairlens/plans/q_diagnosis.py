"""Queries over deficiency scores and searches, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from repairlens.operators import diagnosis as dg
from repairlens.plans.fixtures import oracle, query

_FACTS = """SELECT event_id AS run_id, CASE event_id % 7 WHEN 0 THEN 'TypeError' WHEN 1 THEN 'AssertionError' WHEN 2 THEN 'ImportError' WHEN 3 THEN 'AttributeError' WHEN 4 THEN 'build_failure' WHEN 5 THEN 'panic' ELSE 'odd' END AS error_type,
  CASE event_id % 3 WHEN 0 THEN 'installing numpy' WHEN 1 THEN 'undefined reference to f' ELSE '' END AS error_message,
  CASE event_id % 5 WHEN 0 THEN 'focused' WHEN 1 THEN 'oscillating' WHEN 2 THEN 'jumping' ELSE 'shallow_scan' END AS mode,
  CASE event_id % 4 WHEN 0 THEN 'aligned' WHEN 1 THEN 'edited_elsewhere' WHEN 2 THEN 'viewed_not_edited' ELSE 'error_file_never_viewed' END AS edit_alignment,
  CASE event_id % 3 WHEN 0 THEN 'visited_none' ELSE 'visited_error_file' END AS visit_alignment, event_id % 6 = 0 AS regression, event_id % 3 AS files_edited"""


def _facts(events):
    return events.selectExpr(*[p for p in _split(_FACTS[len("SELECT ") :])])


def _split(text: str) -> list[str]:
    """The items of a select list; none holds a comma outside quotes or brackets."""
    out, depth, quoted, item = [], 0, False, ""
    for c in text:
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append(item)
            item = ""
        else:
            item += c
    return [*out, item]


def _hypotheses(part):
    subtype = F.element_at(F.array(*(F.lit(x) for x in [*dg.ACTIONS, "ODD"])), (F.col("p_partkey") % 12 + 1).cast("int"))
    return part.select(F.col("p_partkey").alias("hypothesis_id"), subtype.alias("subtype"), F.array(F.concat(F.lit("src/m"), (F.col("p_size") % 9).cast("string"), F.lit(".py:3"))).alias("sites"), F.expr("array(CASE p_partkey % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'pkg.Foo' WHEN 2 THEN 'bar' ELSE 'a b' END, 'list')").alias("symbols"))


def _edit_alignment(failures, spans):
    """Over every failure and span; the failures are dealt over all 200 instances, and each place is taken once."""
    of = lambda kind: spans.where(F.col("kind") == kind).select(F.col("instance_id").alias("run_id"), F.col("path").alias("file"), F.col("start_line").alias("line"), F.lit("x").alias("text")).distinct()
    frames = failures.select((F.col("ord") % 200).alias("run_id"), F.substring_index("root_frame", ":", 1).alias("file"), (F.col("ord") % 90).alias("line"), F.lit("sym").alias("symbol")).distinct()
    return dg.error_edit_alignment(frames, of("final"), of("viewed").select("run_id", "file"), 5)


_scores = lambda e: dg.deficiency_scores(dg.failure_family(_facts(e)))
QUERIES = {
    "failure_family": query(lambda e: dg.failure_family(_facts(e)).select("run_id", "family"), "events"),
    "deficiency_scores": query(lambda e: _scores(e).select("run_id", "type", "score"), "events"),
    "deficiency_confidence": query(lambda e: dg.deficiency_confidence(_scores(e)), "events"),
    "error_edit_alignment": query(_edit_alignment, "failures", "spans"),
    "error_edit_alignment_whole": query(_edit_alignment, "failures", "spans"),
    "search_targets": query(lambda p: dg.search_targets(_hypotheses(p)), "part"),
    "search_contracts": query(lambda p: dg.search_contracts(_hypotheses(p), dg.search_targets(_hypotheses(p))), "part"),
    "validate_contracts": query(lambda p: dg.validate_contracts(dg.search_targets(_hypotheses(p)).withColumn("kind", F.when(F.col("hypothesis_id") % 5 == 0, "EVIDENCE").otherwise(F.col("kind"))), p.limit(0).select(F.col("p_name").alias("evidence_id"))), "part"),
}

_FAM = "CASE " + " ".join(f"WHEN error_type IN ({', '.join(repr(e) for e in es)}) THEN '{f}'" for f, es in dg.FAMILIES.items()) + f" WHEN regexp_matches(error_type, 'build|infra') THEN CASE WHEN regexp_matches(lower(error_message), '{dg.COMPILE}') THEN 'COMPILE_OR_BUILD_FAILURE' WHEN regexp_matches(lower(error_message), '{dg.INFRA}') THEN 'INFRASTRUCTURE_FAILURE' ELSE 'COMPILE_OR_BUILD_FAILURE' END ELSE 'GENERIC_TEST_FAILURE' END"
_values = lambda rows: ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)
_sum = lambda rules, t: " + ".join(["0.0::DOUBLE", *(f"CASE WHEN {c} THEN {w}::DOUBLE ELSE 0 END" for c, k, w in rules if k == t)])
_points = lambda rules: "CASE type " + " ".join(f"WHEN '{t}' THEN {_sum(rules, t)}" for t in dg.TYPES) + " END"
_SC = f"""WITH fx AS (SELECT *, {_FAM} AS family FROM ({_FACTS} FROM events)), ep(error_type, type, p) AS (VALUES {_values(dg.ERROR_PRIORS)}), fp(family, type, p) AS (VALUES {_values(dg.FAMILY_PRIORS)}), ty(place, type) AS (VALUES {_values(list(enumerate(dg.TYPES)))}),
sx AS (SELECT run_id, visit_alignment, place, ty.type, coalesce(ep.p, fp.p, 0.1)::DOUBLE AS prior, {_points(dg.EVIDENCE).replace('CASE type', 'CASE ty.type').replace('error_type IN', 'fx.error_type IN')} AS signal, {_points(dg.PATCH).replace('CASE type', 'CASE ty.type')} AS patch
  FROM fx CROSS JOIN ty LEFT JOIN ep ON ep.error_type = fx.error_type AND ep.type = ty.type LEFT JOIN fp ON fp.family = fx.family AND fp.type = ty.type),
sc AS (SELECT *, greatest(0, least(1, prior * 0.4::DOUBLE + signal * 0.4::DOUBLE + patch * 0.2::DOUBLE)) AS score FROM sx)"""
_HY = f"""WITH h AS (SELECT p_partkey AS hypothesis_id, ([{', '.join(repr(k) for k in dg.ACTIONS)}, 'ODD'])[p_partkey % 12 + 1] AS subtype, 'src/m' || (p_size % 9) || '.py:3' AS site, CASE p_partkey % 4 WHEN 1 THEN 'pkg.Foo' WHEN 2 THEN 'bar' END AS sym FROM part),
ac(subtype, action, origin) AS (VALUES {_values([(k, *v) for k, v in dg.ACTIONS.items()])}),
t AS (SELECT hypothesis_id, 0 AS ord, action, CASE origin WHEN 'site' THEN site ELSE sym END AS value, CASE WHEN origin = 'site' AND action = 'FIND_DEFINITION' THEN 'FAILURE_SITE' WHEN origin = 'site' THEN 'FILE' WHEN sym = 'bar' THEN 'SYMBOL' ELSE 'TYPE_NAME' END AS kind
  FROM h JOIN ac USING (subtype) WHERE origin = 'site' OR sym IS NOT NULL),
kd(action, kind) AS (VALUES {_values([(a, k) for a, ks in dg.KINDS.items() for k in ks])})"""

ORACLES = {
    "failure_family": f"SELECT run_id, {_FAM} AS family FROM ({_FACTS} FROM events)",
    "deficiency_scores": f"{_SC} SELECT run_id, type, score FROM sc",
    "deficiency_confidence": f"""{_SC}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, place) AS r, count(*) FILTER (signal > 0.001) OVER (PARTITION BY run_id) AS active FROM sc),
g AS (SELECT run_id, max(type) FILTER (r = 1) AS type, max(score) FILTER (r = 1) AS s1, max(score) FILTER (r = 2) AS s2, max(signal) FILTER (r = 1) AS g1, max(signal) FILTER (r = 2) AS g2, any_value(active) AS active, any_value(visit_alignment) AS visit FROM r GROUP BY 1),
c AS (SELECT *, greatest(0, least(1, s1 * 0.25::DOUBLE + least((s1 - s2) * 2.5::DOUBLE, 0.3::DOUBLE) + greatest(0, least(g1 - g2, 0.2::DOUBLE)) + CASE WHEN visit = 'visited_none' THEN 0 ELSE 0.15::DOUBLE END + least(active * 0.05::DOUBLE, 0.1::DOUBLE))) AS confidence FROM g)
SELECT run_id, CASE WHEN s1 < 0.15 OR confidence < 0.3 THEN 'unknown' ELSE type END AS primary, confidence FROM c""",
    "error_edit_alignment": oracle("failures spans", """f AS (SELECT DISTINCT ord % 200 AS run_id, split_part(root_frame, ':', 1) AS file, ord % 90 AS line FROM failures), e AS (SELECT DISTINCT instance_id AS run_id, path AS file, start_line AS line FROM spans WHERE kind = 'final'),
v AS (SELECT DISTINCT instance_id AS run_id, path AS file FROM spans WHERE kind = 'viewed'), x AS (SELECT f.run_id, bool_or(abs(f.line - e.line) <= 5) AS close FROM f JOIN e USING (run_id, file) GROUP BY 1), s AS (SELECT DISTINCT run_id FROM f SEMI JOIN v USING (run_id, file))
SELECT run_id, CASE WHEN close THEN 'aligned' WHEN NOT close THEN 'edited_elsewhere' WHEN run_id IN (SELECT run_id FROM s) THEN 'viewed_not_edited' ELSE 'error_file_never_viewed' END AS alignment FROM (SELECT DISTINCT run_id FROM f) LEFT JOIN x USING (run_id)"""),
    "search_targets": f"{_HY} SELECT * FROM t",
    "search_contracts": f"""{_HY}, c AS (SELECT hypothesis_id, count(*) AS n, count(kd.kind) AS k FROM t LEFT JOIN kd ON kd.action = t.action AND kd.kind = t.kind GROUP BY 1)
SELECT hypothesis_id, coalesce(k, 0) AS n_actions, 2 * coalesce(k, 0) AS budget, CASE WHEN n IS NULL THEN 'no_target' WHEN k = 0 THEN 'no_compatible_target' ELSE 'actionable' END AS status FROM h LEFT JOIN c USING (hypothesis_id)""",
    "validate_contracts": f"""{_HY}, u AS (SELECT hypothesis_id, ord, action, CASE WHEN hypothesis_id % 5 = 0 THEN 'EVIDENCE' ELSE kind END AS kind FROM t)
SELECT hypothesis_id, ord, 'incompatible' AS issue FROM u ANTI JOIN kd USING (action, kind) UNION ALL SELECT hypothesis_id, ord, 'unresolved' FROM u WHERE kind = 'EVIDENCE'""",
}

ORACLES["error_edit_alignment_whole"] = ORACLES["error_edit_alignment"]  # an earlier name of the same query
