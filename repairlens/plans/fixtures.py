"""Inputs of the registered queries, derived from the given tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["conversations", "documents", "labels", "benchmark", "pages", "embeddings", "events", "orders", "lineitem", "part", "customer", "supplier", "nation", "region"]

SQL = {
    "messages": """
SELECT conv_id AS run_id, turn AS step,
  CASE WHEN role = 'user' AND turn > 1 THEN 'tool' ELSE role END AS role,
  CASE WHEN role = 'assistant' THEN concat(text, chr(10), '```bash', chr(10),
      CASE turn % 4 WHEN 1 THEN concat('cat src/mod_', CAST(conv_id % 5 AS STRING), '.py')
        WHEN 3 THEN concat('python -m pytest tests/test_', CAST(conv_id % 7 AS STRING), '.py')
        WHEN 2 THEN 'grep -rn alpha src/mod_1.py' ELSE 'git checkout main' END, chr(10), '```')
    WHEN role = 'user' AND turn > 1 THEN concat('<returncode>', CAST(turn % 2 AS STRING), '</returncode>', chr(10), '<output>', chr(10), text, chr(10), '</output>')
    ELSE text END AS content
FROM conversations""",
    "edits": """
SELECT conv_id AS run_id, turn AS step, 'assistant' AS role,
  concat('<command>', CASE turn % 5 WHEN 0 THEN concat('sed -i ''s/a/b/'' src/m', CAST(conv_id % 6 AS STRING), '.py')
      WHEN 1 THEN concat('cat > src/n', CAST(turn AS STRING), '.py') WHEN 2 THEN concat('echo "x" >> src/m', CAST(turn % 3 AS STRING), '.py')
      WHEN 3 THEN concat('write_file docs/d', CAST(conv_id % 4 AS STRING), '.md') ELSE 'ls -la' END, '</command>') AS content
FROM conversations WHERE role = 'assistant'""",
    "explorations": """
SELECT conv_id AS run_id, turn AS step, 'user' AS role,
  concat('<explore_context>', chr(10), 'File: src/m', CAST(conv_id % 5 AS STRING), '.py', chr(10), 'Lines: ', CAST(turn * 7 + 9 AS STRING), '-', CAST(conv_id % 20 + 1 AS STRING), chr(10), '</explore_context>', chr(10), text) AS content
FROM conversations WHERE role = 'user'""",
    "failures": """
SELECT user_id % 20 AS run_id, event_id AS ord,
  concat('test_', CAST(event_id % 7 AS STRING), CASE WHEN event_id % 2 = 0 THEN concat('[', CAST(event_id % 3 AS STRING), ']') ELSE '' END) AS test_name,
  CASE event_id % 4 WHEN 0 THEN 'TypeError' WHEN 1 THEN 'AssertionError' WHEN 2 THEN 'ImportError' ELSE 'CustomError' END AS exception_type,
  CASE event_id % 4 WHEN 0 THEN concat('TypeError: line ', CAST(event_id AS STRING), ' failed at 0x7f', CAST(user_id AS STRING))
    WHEN 1 THEN 'AssertionError:'
    WHEN 2 THEN concat('ImportError: cannot import name ''n', CAST(user_id AS STRING), ''' from ''pkg''')
    ELSE concat('CustomError: in /repo/src/m', CAST(user_id % 9 AS STRING), '.py:', CAST(event_id AS STRING)) END AS error_message,
  concat('src/m', CAST(user_id % 9 AS STRING), '.py:', CAST(event_id % 5 AS STRING)) AS root_frame
FROM events WHERE event_type = 'error'""",
    "spans": """
SELECT l_orderkey % 200 AS instance_id,
  CASE l_linenumber % 4 WHEN 0 THEN 'gold' WHEN 1 THEN 'viewed' WHEN 2 THEN 'final' ELSE 'candidate' END AS kind,
  concat('src/m', CAST(l_partkey % 12 AS STRING), '.py') AS path,
  1 + l_suppkey % 90 AS start_line, 1 + l_suppkey % 90 + l_linenumber AS end_line
FROM lineitem""",
    "eval_records": """
SELECT o_custkey AS instance_id, o_orderkey AS ord, CAST(substring(o_orderpriority, 1, 1) AS INT) AS priority,
  CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS resolved,
  CASE WHEN o_orderkey % 11 = 0 THEN 'patch_apply' WHEN o_orderkey % 13 = 0 THEN 'env' END AS eval_error
FROM orders""",
    "predictions": """
SELECT o_custkey AS instance_id, o_orderkey AS ord, o_orderdate AS mtime, concat('batch', CAST(o_orderkey % 5 AS STRING)) AS batch FROM orders""",
    "logs": """
SELECT doc_id AS run_id, concat(CASE doc_id % 8
    WHEN 0 THEN concat('FAILED tests/test_', CAST(doc_id % 5 AS STRING), '.py::test_a - AssertionError: ', CAST(doc_id AS STRING), ' != 3')
    WHEN 1 THEN 'error: patch failed: src/a.py:3'
    WHEN 2 THEN concat('--- FAIL: TestX', CAST(doc_id AS STRING), ' (0.01s)', chr(10), '    x_test.go:42: expected 3, got 4')
    WHEN 3 THEN 'test result: FAILED. 3 passed; 2 failed; 0 ignored'
    WHEN 4 THEN concat('ModuleNotFoundError: no module m', CAST(doc_id AS STRING))
    WHEN 5 THEN concat(chr(27), '[31mFAIL: test_b (pkg.Case)', chr(27), '[0m')
    WHEN 6 THEN '' ELSE 'command timed out' END, chr(10), coalesce(text, '')) AS log_text
FROM documents""",
    "patches": """
SELECT p_partkey AS run_id, concat('diff --git a/src/m', CAST(p_size % 9 AS STRING), '.py b/src/m', CAST(p_size % 9 AS STRING), '.py', chr(10),
  '--- a/src/m', CAST(p_size % 9 AS STRING), '.py', chr(10), '+++ b/src/m', CAST(p_size % 9 AS STRING), '.py', chr(10),
  '@@ -', CAST(p_size AS STRING), ',2 +', CAST(p_size AS STRING), ',2 @@', chr(10), ' ', p_name, chr(10), '-', p_brand, chr(10), '+', p_type, chr(10)) AS patch_text
FROM part""",
    "repo_files": """
SELECT concat(source, '/f', CAST(doc_id AS STRING), '.py') AS path,
  concat('def f', CAST(doc_id AS STRING), '(x):', chr(10), '    return g', CAST(doc_id % 17 AS STRING), '(x)', chr(10), text) AS content
FROM documents""",
    "issues": """
SELECT d.doc_id AS instance_id, d.text AS issue, d.source AS repo, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "runtime": """
SELECT o_orderkey AS run_id, CASE o_orderkey % 13 WHEN 0 THEN 'timeout' WHEN 1 THEN ' FormatError' ELSE 'Submitted' END AS exit_status, o_custkey % 5 AS test_runs, o_custkey % 3 AS test_failures,
  o_orderkey % 4 AS git_checkouts, o_orderkey % 7 AS edited_files, o_orderkey % 10 AS changed_files, o_custkey % 260 AS changed_lines, o_custkey % 17 = 0 AS repeated_pattern, o_orderkey % 19 = 0 AS submitted_without_tests,
  o_custkey % 12 AS viewed_files, o_orderkey % 6 AS viewed_not_final, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS edited_not_viewed, CASE WHEN o_custkey % 4 = 0 THEN o_orderkey % 5 ELSE 0 END AS scope_score, o_orderkey % 5 AS regressions
FROM orders""",
    "anchored": """
SELECT doc_id AS run_id, doc_id % 5 > 0 AS has_failure, CASE WHEN doc_id % 7 = 0 THEN concat('tests/test_m', CAST(doc_id % 4 AS STRING), '.py::test_a') ELSE '' END AS failed,
  CASE doc_id % 6 WHEN 0 THEN concat('FAILED tests/test_b', CAST(doc_id % 3 AS STRING), '.py::test_c - TypeError: Widget') WHEN 1 THEN concat('thread panicked at src/lib', CAST(doc_id % 9 AS STRING), '.rs:', CAST(doc_id AS STRING))
    WHEN 2 THEN concat('Error: x at src/app.js:', CAST(doc_id AS STRING)) WHEN 3 THEN concat('ImportError: cannot import name ''n', CAST(doc_id AS STRING), ''' from ''pkg.Core''')
    WHEN 4 THEN 'module ''pkg'' has no attribute ''Thing''' ELSE concat('bad value in conf/base.cfg:', CAST(doc_id % 50 AS STRING)) END AS message,
  '' AS trace, concat('helper', CAST(doc_id % 3 AS STRING), ' Model') AS symbols, coalesce(text, '') AS issue
FROM documents""",
    "hinted": """
SELECT doc_id AS run_id, source AS repo, concat('i', CAST(doc_id AS STRING)) AS instance, doc_id % 5 > 0 AS has_failure, concat(source, '/f', CAST(doc_id AS STRING), '.py') AS path, 3 + length(text) - length(replace(text, chr(10), '')) + 1 AS n,
  CASE doc_id % 4 WHEN 0 THEN 'Model class X declares no app_label and is not in INSTALLED_APPS' WHEN 1 THEN 'Model class without app_label' WHEN 2 THEN concat('FAIL: F', CAST(doc_id AS STRING), 'Tests.test_x failed') ELSE 'nothing' END AS message
FROM documents""",
    "features": """
SELECT user_id AS run_id, count(*) AS bash_commands, count(*) FILTER (WHERE event_type = 'error') AS test_commands,
  count(*) FILTER (WHERE event_type = 'purchase') % 3 AS checkouts, count(*) % 11 AS files_visited, count(*) % 7 AS files_edited
FROM events GROUP BY user_id""",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture, or a given table."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = [t for t in TABLES if re.search(rf"(FROM|JOIN) {t}\b", SQL[name])]
    text = SQL[name]
    for t in used:
        text = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def oracle(fixtures: str, body: str) -> str:
    """SQL over fixtures (names separated by spaces); body is a SELECT, or further CTEs and a SELECT."""
    ctes = ",\n".join(f"{name} AS ({SQL[name]})" for name in fixtures.split())
    return f"WITH {ctes}{' ' if body.lstrip().upper().startswith('SELECT') else ', '}{body}"


def query(run, *names: str):
    """A registered query: run over the named fixtures."""
    return lambda spark, sf_dir: run(*(frame(spark, sf_dir, name) for name in names))
