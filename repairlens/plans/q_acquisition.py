"""Queries over search actions, error signals and cluster diagnoses, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from repairlens.operators import acquisition as aq
from repairlens.operators import logs as lg
from repairlens.operators import sections as sc
from repairlens.plans.fixtures import oracle, query

ACTIONS = [
    ("s1", "FIND_DEFINITION", "SYMBOL", "pkg.f12", "", 2), ("s2", "FIND_DEFINITION", "TYPE_NAME", "Missing", "", 2), ("s3", "FIND_DEFINITION", "SYMBOL", "f1", "", 3),
    ("l1", "FIND_DEFINITION", "FAILURE_SITE", "none.py:3", "", 1), ("l2", "FIND_DEFINITION", "FAILURE_SITE", "none.py", "", 1), ("k1", "FIND_DEFINITION", "TEXT", "x", "", 1),
    ("t1", "FIND_RELATED_TESTS", "SYMBOL", "m.g3", "", 4), ("t2", "FIND_RELATED_TESTS", "FILE", "src1/tests/f1.py", "g5", 6), ("u1", "FIND_CALLERS", "SYMBOL", "f1", "", 1),
]


def _tree(files):
    test = F.concat(F.split_part("path", F.lit("/"), F.lit(1)), F.lit("/tests/test_"), F.substring_index("path", "/", -1))
    return files.select(F.explode(F.array("path", test)).alias("path"), "content")  # texts are read once


def _plan(files):
    actions = files.sparkSession.createDataFrame(ACTIONS, "action_id string, action string, kind string, value string, module string, budget int")
    sites = files.select(F.concat(F.lit("p_"), "path").alias("action_id"), F.lit("FIND_DEFINITION").alias("action"), F.lit("FAILURE_SITE").alias("kind"), F.concat("path", F.lit(":2")).alias("value"), F.lit("").alias("module"), F.lit(1).alias("budget"))
    failed = files.sparkSession.createDataFrame([("src2/tests/test_q.py::t",), ("src3/tests/a::b::c",)], "name string")
    return actions.unionByName(sites), _tree(files), failed


def _clusters(failures):
    told = F.expr("CASE exception_type WHEN 'TypeError' THEN 'unsupported operand' WHEN 'ImportError' THEN concat('got unexpected keywords: [''k', CAST(run_id AS STRING), '''] for \"F\"') ELSE error_message END")
    worse = failures.withColumn("error_message", told)
    return worse.groupBy("run_id", F.col("exception_type").alias("cluster")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("error_message")).alias("messages"), F.array(F.when(F.col("exception_type") == "AssertionError", "assert_allclose(a, b)").otherwise("")).alias("assertions"), F.array(*(F.lit(f"s{i}") for i in range(7))).alias("symbols"), F.array(F.min("root_frame")).alias("shared_frames"), F.max("root_frame").alias("root_cause"))


_joined = lambda df: df.withColumn("targets", F.array_join("targets", ","))
QUERIES = {
    "route_plan": query(lambda f: aq.route_plan(*_plan(f))[0], "repo_files"),
    "route_plan_hits": query(lambda f: aq.route_plan(*_plan(f))[1], "repo_files"),
    "rank_tests": query(lambda f: (lambda a, files, failed: aq.rank_tests(files, a.where("action = 'FIND_RELATED_TESTS'"), failed))(*_plan(f)), "repo_files"),
    "error_signals": query(lambda logs: lg.error_signals(_signalled(logs)), "logs"),
    "specific_tokens": query(lambda logs: lg.specific_tokens(lg.error_signals(_signalled(logs))), "logs"),
    "diagnose_clusters": query(lambda f: _joined(sc.diagnose_clusters(_clusters(f))), "failures"),
}


def _signalled(logs):
    k = F.col("run_id").cast("string")
    extra = F.concat(F.lit('\nPkg'), k, F.lit('Error and ValueError; warnings.warn(OldWarning; PytestConfigWarning; E0'), F.lpad((F.col("run_id") % 90).cast("string"), 2, "0"), F.lit('\n  File "/t/src/m'), (F.col("run_id") % 4).cast("string"), F.lit('.py", line 3\n  File "/t/tests/test_m.py", line 4\n  File "__init__.py", line 1\n'))
    return logs.select("run_id", F.concat(F.expr("CASE WHEN run_id % 3 = 0 THEN 'FAILED a.py::t FAILED a.py::t' ELSE '' END"), extra).alias("log_text"))


_TREE = r"""f AS (SELECT path, content FROM repo_files UNION ALL SELECT split_part(path, '/', 1) || '/tests/test_' || string_split(path, '/')[-1], content FROM repo_files),
t AS (SELECT * FROM f WHERE contains(path, '/tests/')),
b AS (SELECT action_id, sym, hint, budget, dir, path, content, CASE WHEN contains(content, sym) THEN 100 + (length(content) - length(replace(content, sym, ''))) // length(sym) WHEN hint <> '' AND contains(content, hint) THEN 80
  WHEN starts_with(path, 'test_' || sym) THEN 60 WHEN starts_with(replace(replace(replace(path, '.py', ''), '/test_', '/'), '/', '.'), sym) THEN 50 WHEN contains(lower(path), sym) THEN 30 ELSE 0 END AS base
  FROM t, (VALUES ('t1', 'g3', '', 4, '?'), ('t2', 'f1', 'g5', 6, 'src1/tests')) v(action_id, sym, hint, budget, dir)),
s AS (SELECT *, base + CASE WHEN regexp_replace(path, '/[^/]*$', '') = dir THEN 30 ELSE 0 END + CASE WHEN starts_with(path, 'src2/tests/') THEN 20 ELSE 0 END AS score FROM b WHERE base > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY action_id ORDER BY score DESC, path) AS rank FROM s QUALIFY rank <= budget),
sy AS (SELECT action_id, sym, budget, path, row_number() OVER (PARTITION BY action_id ORDER BY path) AS rank FROM f, (VALUES ('s1', 'f12', 2), ('s2', 'Missing', 2), ('s3', 'f1', 3)) v(action_id, sym, budget) WHERE contains(content, 'def ' || sym || '(') OR contains(content, 'class ' || sym)),
h AS (SELECT action_id, rank, path, 1 AS start_line, 1 AS end_line, sym AS symbol, 'grep_symbol' AS method FROM sy WHERE rank <= budget
UNION ALL SELECT 'p_' || path, 1, path, 1, 2, 'f' || regexp_extract(path, 'f(\d+)\.py', 1), 'ast_enclosing_node' FROM repo_files
UNION ALL SELECT action_id, rank, path, 1, length(content) - length(replace(content, chr(10), '')) + 1, CASE WHEN base >= 100 THEN sym ELSE replace(string_split(path, '/')[-1], '.py', '') END, 'ranked_test_search' FROM r)"""
ORACLES = {
    "rank_tests": oracle("repo_files", f"{_TREE} SELECT action_id, rank, path, CAST(score AS INT) AS score, CASE WHEN base >= 100 THEN sym ELSE replace(string_split(path, '/')[-1], '.py', '') END AS symbol, length(content) - length(replace(content, chr(10), '')) + 1 AS end_line FROM r"),
    "route_plan_hits": oracle("repo_files", f"{_TREE} SELECT * FROM h"),
    "route_plan": oracle("repo_files", f"""{_TREE}, a AS (SELECT * FROM (VALUES ('s1', 'FIND_DEFINITION'), ('s2', 'FIND_DEFINITION'), ('s3', 'FIND_DEFINITION'), ('l1', 'FIND_DEFINITION'), ('l2', 'FIND_DEFINITION'), ('k1', 'FIND_DEFINITION'), ('t1', 'FIND_RELATED_TESTS'), ('t2', 'FIND_RELATED_TESTS'), ('u1', 'FIND_CALLERS')) v(action_id, action)
UNION ALL SELECT 'p_' || path, 'FIND_DEFINITION' FROM repo_files), n AS (SELECT action_id, count(*) AS n FROM h GROUP BY 1)
SELECT action_id, action, CASE WHEN action_id IN ('k1', 'u1') THEN 'UNSUPPORTED' WHEN action_id = 'l2' THEN 'INVALID_TARGET' WHEN n > 0 THEN 'FOUND' ELSE 'NOT_FOUND' END AS status, coalesce(n, 0) AS n_hits FROM a LEFT JOIN n USING (action_id)"""),
    "error_signals": oracle("logs", """x AS (SELECT run_id, unnest([('exception', 0, 'Pkg' || run_id || 'Error'), ('exception', 1, 'ValueError'), ('exception', 2, 'OldWarning'), ('exception', 3, 'PytestConfigWarning'), ('warning_code', 0, 'OldWarning'), ('check_code', 0, 'E0' || lpad(CAST(run_id % 90 AS VARCHAR), 2, '0')),
  ('stack_file', 0, 'm' || (run_id % 4) || '.py'), ('stack_file', 1, 'test_m.py'), ('stack_file', 2, '__init__.py'), ('origin_file', 0, 'm' || (run_id % 4) || '.py')] || CASE WHEN run_id % 3 = 0 THEN [('failed_test', 0, 'a.py::t')] ELSE [] END) AS s FROM logs)
SELECT run_id, s[1] AS kind, s[2] AS pos, s[3] AS token FROM x"""),
    "specific_tokens": oracle("logs", "SELECT run_id, unnest(['Pkg' || run_id || 'Error', 'OldWarning', 'E0' || lpad(CAST(run_id % 90 AS VARCHAR), 2, '0')]) AS token FROM logs"),
    "diagnose_clusters": oracle("failures", """SELECT run_id, exception_type AS cluster, CASE exception_type WHEN 'TypeError' THEN 'INTERFACE_CONSTRAINT' WHEN 'ImportError' THEN 'API_DEFINITION' WHEN 'AssertionError' THEN 'RELATED_TESTS' ELSE 'NO_RELIABLE_DEFICIENCY' END AS type,
  CASE exception_type WHEN 'TypeError' THEN CASE WHEN count(*) = 1 THEN 'ARGUMENT_TYPE_MISMATCH' ELSE 'FRAME_ATTRIBUTE_CONSTRAINT' END WHEN 'ImportError' THEN 'FRAME_ATTRIBUTE_PROPAGATION' WHEN 'AssertionError' THEN 'NUMERICAL_MISMATCH' ELSE '' END AS subtype,
  CASE exception_type WHEN 'CustomError' THEN 'low' WHEN 'ImportError' THEN 'high' ELSE 'medium' END AS confidence, CASE exception_type WHEN 'CustomError' THEN '' WHEN 'ImportError' THEN 'k' || run_id || ',F' ELSE 's0,s1,s2,s3,s4' END AS targets,
  CASE exception_type WHEN 'CustomError' THEN '' WHEN 'ImportError' THEN min(root_frame) ELSE max(root_frame) END AS location FROM failures GROUP BY 1, 2"""),
}
