"""Queries over support of edits, frames, verdicts and modes, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from repairlens.operators import logs as lg
from repairlens.operators import patches as pt
from repairlens.operators import planning as pl
from repairlens.plans.fixtures import oracle, query

_k = lambda m: F.col("o_orderkey") % m


def _scope(orders):
    return pt.scope_score(orders.select(F.col("o_orderkey").alias("run_id"), _k(8).alias("changed_files"), (_k(11) * 30).alias("changed_lines"), (_k(13) * 10).alias("api_calls"), _k(2).alias("repeated_patterns"), _k(7).alias("edited_files"), _k(9).alias("viewed_files"), F.lit(0).alias("edited_not_viewed"), (_k(10) == 0).alias("submitted_without_tests")))


def _support(spans):
    edits = spans.where("kind = 'final'").select(F.col("instance_id").alias("run_id"), "path").distinct().withColumn("pattern_only", F.col("run_id") % 4 == 0)
    part = lambda k: spans.where(F.col("kind") == k).select(F.col("instance_id").alias("run_id"), "path", "start_line", "end_line")
    seen = pt.viewed_evidence(part("final"), part("viewed"), 5, 0)
    tests = part("gold").select("run_id", "path").distinct().withColumn("source", F.lit("test_failure"))
    return pt.edit_support(edits, seen.unionByName(tests))


def _witnesses(failures):
    trace = F.when(F.col("ord") % 3 == 0, F.array(F.concat(F.lit('  File "/r/a'), (F.col("ord") % 4).cast("string"), F.lit('.py", line 7, in f')), F.lit('File "test_b.py", line 2'))).otherwise(F.array().cast("array<string>"))
    message = F.when(F.col("ord") % 3 == 1, F.concat(F.lit('x\n  File "c.py", line '), F.col("ord").cast("string"), F.lit(", in g\nFooError"))).otherwise("FAILED t.py::test_x")
    return failures.select(F.col("ord").alias("run_id"), trace.alias("trace"), message.alias("message"), F.when(F.col("ord") % 3 == 0, F.array(F.lit("f"), F.lit(""), F.lit("f"))).otherwise(F.array().cast("array<string>")).alias("functions"))


def _fused(failures):
    part = lambda m, s: failures.where(F.col("ord") % m == 0).select(F.col("ord").alias("run_id"), F.array(F.col("test_name"), F.lit(s)).alias("failed_tests"), F.when(F.col("ord") % 4 == 0, "").otherwise(s).alias("first_error"))
    out = lg.fuse_log_and_witness(part(2, "log"), part(3, "witness"))
    return out.withColumn("failed_tests", F.array_join("failed_tests", ","))


def _verdicts(orders):
    return pl.branch_verdict(orders.select(F.col("o_orderkey").alias("run_id"), (_k(9) > 0).alias("fair"), (_k(8) > 0).alias("second_run"), (_k(7) > 0).alias("first_valid"), (_k(6) > 0).alias("second_valid"), (_k(5) > 2).alias("first_resolved"), (_k(4) > 1).alias("second_resolved")))


def _modes(orders):
    return pl.packet_mode(orders.select(F.col("o_orderkey").alias("run_id"), F.when(_k(9) == 0, "NO_TRIGGER").otherwise("T").alias("trigger"), F.when(_k(8) == 0, "ABSTAIN").otherwise("R").alias("family"), F.lit("P").alias("pathology"), F.when(_k(7) == 0, "missing").otherwise("resolved").alias("repo_status"), _k(3).alias("done"), (_k(2) == 0).alias("guards")))


def _taxonomy(orders, nation):
    table = nation.where("n_nationkey < 20").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("pathology"), F.concat(F.lit("f"), F.col("n_regionkey").cast("string")).alias("family"), F.lit("A").alias("default_action"), F.lit("I").alias("default_intent"))
    return pl.normalize_diagnosis(orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("p"), _k(25).cast("string")).alias("pathology"), F.when(_k(2) == 0, "").otherwise("own").alias("action"), F.lit(None).cast("string").alias("intent")), table)


def _runs(orders):
    keys = [F.col("o_custkey").alias("instance_id"), F.concat(F.lit("b"), _k(3).cast("string")).alias("baseline")]
    base = orders.select(*keys).distinct()
    return pl.run_matrix(base, {"report": orders.where("o_orderkey % 2 = 0").groupBy(*keys).agg(F.max("o_orderkey").alias("report")), "patch": orders.where("o_orderkey % 5 = 0").groupBy(*keys).agg(F.count("*").alias("patches"))})


def _frames(spans, kind, root):
    own = spans.where(F.col("kind") == kind).select(F.col("instance_id").alias("run_id"), F.col("path").alias("p"), root.alias("root"), (F.col("start_line") % 4).cast("int").alias("line"), F.concat(F.lit("f"), (F.col("end_line") % 2).cast("string")).alias("function"))
    once = own.groupBy("run_id", "p", "line", "function").agg(F.min("root").alias("root"))
    return once.select("run_id", F.row_number().over(Window.partitionBy("run_id").orderBy("p", "line", "function")).alias("pos"), F.concat("root", "p").alias("file"), "line", "function")


def _types(failures):
    logs = failures.select(F.col("ord").alias("run_id"), F.when(F.col("ord") % 3 == 0, F.array("error_message")).otherwise(F.array(F.lit("other"))).alias("error_messages"), F.create_map("exception_type", F.lit(2)).alias("error_types"))
    return lg.fuse_error_types(logs, failures.select(F.col("ord").alias("run_id"), "error_message"))


QUERIES = {
    "scope_score": query(_scope, "orders"),
    "edit_support": query(_support, "spans"),
    "prune_suggestions": query(lambda s: pt.prune_suggestions(_support(s)), "spans"),
    "parse_traceback_frames": query(lambda f: lg.parse_traceback_frames(_witnesses(f)), "failures"),
    "stack_source_files": query(lambda f: lg.stack_source_files(lg.parse_traceback_frames(_witnesses(f))), "failures"),
    "fuse_frames": query(lambda s: lg.fuse_frames(_frames(s, "gold", F.lit("/testbed/")), _frames(s, "candidate", F.when(F.col("start_line") % 2 == 0, "").otherwise("/testbed/"))), "spans"),
    "fuse_error_types": query(_types, "failures"),
    "error_symbols": query(lambda f: lg.error_symbols(_witnesses(f)).withColumn("symbols", F.array_join("symbols", ",")), "failures"),
    "fuse_log_and_witness": query(_fused, "failures"),
    "branch_verdict": query(_verdicts, "orders"),
    "packet_mode": query(_modes, "orders"),
    "normalize_diagnosis": query(_taxonomy, "orders", "nation"),
    "run_matrix": query(_runs, "orders"),
}

_SUP = """e AS (SELECT DISTINCT instance_id AS run_id, path, instance_id % 4 = 0 AS pattern_only FROM spans WHERE kind = 'final'),
v AS (SELECT DISTINCT h.instance_id AS run_id, h.path FROM spans h JOIN spans v ON h.kind = 'final' AND v.kind = 'viewed' AND v.end_line - v.start_line <= 5 AND h.instance_id = v.instance_id AND h.path = v.path AND h.start_line <= v.end_line AND v.start_line <= h.end_line),
t AS (SELECT DISTINCT instance_id AS run_id, path FROM spans WHERE kind = 'gold'),
s AS (SELECT e.run_id, e.path, (v.path IS NOT NULL)::BIGINT + (t.path IS NOT NULL)::BIGINT AS n_sources, CASE WHEN t.path IS NOT NULL THEN 2 WHEN v.path IS NOT NULL THEN 1 ELSE 0 END - pattern_only::INT AS r FROM e LEFT JOIN v USING (run_id, path) LEFT JOIN t USING (run_id, path)),
sup AS (SELECT run_id, path, n_sources, CASE r WHEN 2 THEN 'supported' WHEN 1 THEN 'weak' ELSE 'unsupported' END AS support FROM s)"""
_FR = """fr AS (SELECT ord AS run_id, 0 AS pos, CASE ord % 3 WHEN 0 THEN '/r/a' || (ord % 4) || '.py' WHEN 1 THEN 'c.py' ELSE 'tests/t.py' END AS file, CAST(CASE ord % 3 WHEN 0 THEN 7 WHEN 1 THEN ord ELSE 0 END AS INT) AS line, CASE ord % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'g' ELSE 'test_x' END AS function FROM failures
  UNION ALL SELECT ord, 1, 'test_b.py', 2, '' FROM failures WHERE ord % 3 = 0)"""

ORACLES = {
    "scope_score": """WITH r AS (SELECT o_orderkey AS run_id, o_orderkey % 8 AS changed_files, o_orderkey % 11 * 30 AS changed_lines, o_orderkey % 13 * 10 AS api_calls, o_orderkey % 2 AS repeated_patterns, o_orderkey % 7 AS edited_files, o_orderkey % 9 AS viewed_files, 0 AS edited_not_viewed, o_orderkey % 10 = 0 AS submitted_without_tests FROM orders),
s AS (SELECT *, (changed_files >= 5)::INT + (changed_lines >= 200)::INT + (api_calls >= 80)::INT + (repeated_patterns > 0)::INT + (submitted_without_tests OR CASE WHEN viewed_files > 0 THEN edited_files / viewed_files > 0.7 ELSE edited_files > 0 END)::INT AS score FROM r)
SELECT *, CASE WHEN score >= 3 THEN 'strong' WHEN score >= 2 THEN 'warning' ELSE 'none' END AS level FROM s""",
    "edit_support": oracle("spans", f"{_SUP} SELECT * FROM sup"),
    "prune_suggestions": oracle("spans", f"{_SUP} SELECT run_id, count(*) FILTER (support = 'supported') AS keep, count(*) FILTER (support = 'weak') AS review, count(*) FILTER (support = 'unsupported') AS drop FROM sup GROUP BY 1"),
    "parse_traceback_frames": oracle("failures", f"{_FR} SELECT * FROM fr"),
    "stack_source_files": oracle("failures", f"{_FR} SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY contains(split_part(file, '/', -1), 'test'), line, pos) - 1 AS rank, split_part(file, '/', -1) AS name, line, contains(split_part(file, '/', -1), 'test') AS is_test FROM fr"),
    "fuse_frames": oracle("spans", """f AS (SELECT DISTINCT kind, instance_id AS run_id, path, start_line % 4 AS line, end_line % 2 AS fn FROM spans WHERE kind IN ('gold', 'candidate')),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id, kind ORDER BY path, line, fn) AS p FROM f WHERE kind = 'gold' OR NOT EXISTS (SELECT 1 FROM f g WHERE g.kind = 'gold' AND g.run_id = f.run_id AND g.path = f.path AND g.line = f.line AND g.fn = f.fn))
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY CASE kind WHEN 'gold' THEN 0 ELSE 1 END, p) - 1 AS pos, CASE kind WHEN 'gold' THEN '/testbed/' ELSE '' END || path AS file, CAST(line AS INT) AS line, 'f' || fn AS function, CASE kind WHEN 'gold' THEN 'log' ELSE 'witness' END AS source FROM n"""),
    "fuse_error_types": oracle("failures", """t AS (SELECT ord AS run_id, exception_type AS error_type, 2 AS n FROM failures UNION ALL
SELECT ord, e, 1 FROM failures, (VALUES ('TypeError'), ('AssertionError'), ('ImportError')) v(e) WHERE contains(error_message, e) AND ord % 3 <> 0) SELECT run_id, error_type, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY 1, 2"""),
    "error_symbols": oracle("failures", "SELECT ord AS run_id, CASE ord % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'FooError' ELSE 'FAILED' END AS symbols FROM failures"),
    "fuse_log_and_witness": oracle("failures", """SELECT ord AS run_id, CASE WHEN ord % 6 = 0 THEN test_name || ',log,witness' WHEN ord % 2 = 0 THEN test_name || ',log' ELSE test_name || ',witness' END AS failed_tests,
  CASE WHEN ord % 4 = 0 THEN '' WHEN ord % 2 = 0 THEN 'log' ELSE 'witness' END AS first_error FROM failures WHERE ord % 2 = 0 OR ord % 3 = 0"""),
    "branch_verdict": """WITH r AS (SELECT o_orderkey AS run_id, o_orderkey % 9 > 0 AS fair, o_orderkey % 8 > 0 AS second_run, o_orderkey % 7 > 0 AS first_valid, o_orderkey % 6 > 0 AS second_valid, o_orderkey % 5 > 2 AS first_resolved, o_orderkey % 4 > 1 AS second_resolved FROM orders)
SELECT *, CASE WHEN NOT fair THEN 'invalid_fairness' WHEN NOT second_run THEN 'second_disabled' WHEN NOT (first_valid OR second_valid) THEN 'invalid_both' WHEN NOT first_valid THEN 'invalid_first' WHEN NOT second_valid THEN 'invalid_second'
  WHEN first_resolved THEN CASE WHEN second_resolved THEN 'both_succeed' ELSE 'first_wins' END WHEN second_resolved THEN 'second_wins' ELSE 'both_fail' END AS verdict FROM r""",
    "packet_mode": """WITH r AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 9 = 0 THEN 'NO_TRIGGER' ELSE 'T' END AS trigger, CASE WHEN o_orderkey % 8 = 0 THEN 'ABSTAIN' ELSE 'R' END AS family, 'P' AS pathology, CASE WHEN o_orderkey % 7 = 0 THEN 'missing' ELSE 'resolved' END AS repo_status, o_orderkey % 3 AS done, o_orderkey % 2 = 0 AS guards FROM orders)
SELECT *, CASE WHEN trigger = 'NO_TRIGGER' THEN 'noop' WHEN family = 'ABSTAIN' THEN 'abstain' WHEN repo_status = 'missing' THEN 'diagnostic_only_no_repo' WHEN done = 0 THEN 'diagnostic_only_no_actions' WHEN guards THEN 'guard' ELSE 'retrieval' END AS packet_mode FROM r""",
    "normalize_diagnosis": """SELECT o_orderkey AS id, 'p' || (o_orderkey % 25) AS pathology, coalesce('f' || n_regionkey, 'ABSTAIN') AS family, CASE WHEN o_orderkey % 2 = 1 THEN 'own' WHEN n_nationkey IS NOT NULL THEN 'A' END AS action, CASE WHEN n_nationkey IS NOT NULL THEN 'I' END AS intent, n_nationkey IS NOT NULL AS known
FROM orders LEFT JOIN nation ON n_nationkey = o_orderkey % 25 AND n_nationkey < 20""",
    "run_matrix": """WITH o AS (SELECT o_custkey AS instance_id, 'b' || (o_orderkey % 3) AS baseline, o_orderkey AS k FROM orders)
SELECT instance_id, baseline, max(k) FILTER (k % 2 = 0) AS report, count(*) FILTER (k % 2 = 0) > 0 AS has_report, nullif(count(*) FILTER (k % 5 = 0), 0) AS patches, count(*) FILTER (k % 5 = 0) > 0 AS has_patch FROM o GROUP BY 1, 2""",
}
