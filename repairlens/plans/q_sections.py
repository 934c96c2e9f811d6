"""Queries over failure sections, alignment and related tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from repairlens.operators import sections as sc
from repairlens.operators import source_tree as st
from repairlens.plans.fixtures import oracle, query


def _session(failures):
    """A log for each run: sections of its failures in order, and a summary of three quarters of them."""
    head = F.concat(F.lit("____ "), "test_name", F.lit(" ____\n>       assert f() == 1\nsrc/a.py:"), F.col("ord").cast("string"), F.lit(": in g\nE       "), "error_message", F.lit("\n"))
    tail = F.when(F.col("ord") % 4 > 0, F.concat(F.lit("FAILED t.py::"), "test_name", F.lit("\n"))).otherwise("")
    both = F.array_sort(F.collect_list(F.struct("ord", head.alias("h"), tail.alias("t"))))
    join = lambda name: F.array_join(F.transform("x", lambda v: v[name]), "")
    return failures.groupBy("run_id").agg(both.alias("x")).select("run_id", F.concat(F.lit("==== FAILURES ====\n"), join("h"), F.lit("==== short test summary info ====\n"), join("t")).alias("log_text"))


def _django(failures):
    head = F.concat(F.lit("ERROR: "), F.substring_index("test_name", "[", 1), F.lit(" (app.Case)\n" + "-" * 70 + '\n  File "/testbed/app/m.py", line '), F.col("ord").cast("string"), F.lit(", in save\nValueError: bad "), F.col("ord").cast("string"), F.lit("\n" + "-" * 70 + "\n"))
    return failures.select(F.col("ord").alias("run_id"), head.alias("log_text"))


def _clusters(failures):
    return failures.groupBy("run_id", F.col("exception_type").alias("cluster")).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("root_frame")).alias("frames"), F.array_sort(F.collect_set("error_message")).alias("messages"), F.array(F.lit("")).alias("assertions")
    )


def _aligned(failures, spans):
    files = lambda k: spans.where(F.col("kind") == k).select((F.col("instance_id") % 20).alias("run_id"), F.col("path").alias("file"))
    out = sc.align_evidence(_clusters(failures), files("viewed"), files("final"))
    return out.select("run_id", "cluster", F.size("error_symbols").alias("n_symbols"), F.array_join(F.array_sort("unviewed_files"), ",").alias("unviewed"), "disjoint")


def _classes(failures):
    worse = failures.withColumn("error_message", F.when(F.col("exception_type") == "TypeError", "unsupported operand type(s)").otherwise(F.col("error_message")))
    return sc.classify_clusters(_clusters(worse))


def _related(files):
    tests = files.withColumn("path", F.concat(F.lit("tests/test_"), F.substring_index("path", "/", -1)))
    targets = files.sparkSession.range(1).select(F.explode(F.array(F.lit("g3"), F.lit("f17"))).alias("target")).withColumn("module", F.lit("none"))
    return sc.related_tests(tests, targets, tests.select(F.col("path").alias("file")).where("path LIKE '%3.py'"))


_flat = lambda df: df.select("run_id", "ord", "test_name", "exception_type", "error_message", F.size("frames").alias("n_frames"), F.get("frames", F.lit(0))["line"].alias("line"))

QUERIES = {
    "parse_pytest_failures": query(lambda f: _flat(sc.parse_pytest_failures(_session(f))), "failures"),
    "parse_django_failures": query(lambda f: _flat(sc.parse_django_failures(_django(f))), "failures"),
    "reconcile_failures": query(lambda f: sc.reconcile_failures(sc.parse_pytest_failures(_session(f)), sc.summary_failures(_session(f))), "failures"),
    "align_evidence": query(_aligned, "failures", "spans"),
    "align_evidence_whole": query(_aligned, "failures", "spans"),
    "classify_clusters": query(_classes, "failures"),
    "related_tests": query(_related, "repo_files"),
    "test_index": query(lambda f: sc.test_index(st.symbol_index(f.select(F.concat(F.lit("tests/"), "path").alias("path"), F.replace("content", F.lit("def f"), F.lit("def test_")).alias("content")))), "repo_files"),
}

ORACLES = {
    "parse_pytest_failures": oracle("failures", """SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY ord) AS ord, test_name, CASE WHEN exception_type = 'AssertionError' THEN 'AssertionError' ELSE exception_type END AS exception_type,
  CASE WHEN exception_type = 'AssertionError' THEN 'AssertionError: ' ELSE error_message END AS error_message, 1 AS n_frames, CAST(ord AS INT) AS line FROM failures"""),
    "parse_django_failures": oracle("failures", """SELECT ord AS run_id, 1 AS ord, 'app.Case::' || split_part(test_name, '[', 1) AS test_name, 'ValueError' AS exception_type, 'ValueError: bad ' || ord AS error_message, 1 AS n_frames, CAST(ord AS INT) AS line FROM failures"""),
    "reconcile_failures": oracle("failures", """t AS (SELECT run_id, count(*) AS n_sections, count(*) FILTER (ord % 4 > 0) AS n_summary FROM failures GROUP BY 1)
SELECT *, n_summary AS n_matched, CASE WHEN n_sections = n_summary THEN 'exact' WHEN n_summary = 0 THEN 'section_only' ELSE 'partial_mismatch' END AS status FROM t"""),
    "align_evidence": oracle("failures spans", r"""c AS (SELECT run_id, exception_type AS cluster, list(DISTINCT split_part(root_frame, ':', 1)) AS files, list(DISTINCT error_message) AS m FROM failures GROUP BY 1, 2),
v AS (SELECT instance_id % 20 AS run_id, list(DISTINCT path) AS seen FROM spans WHERE kind = 'viewed' GROUP BY 1), e AS (SELECT instance_id % 20 AS run_id, list(DISTINCT path) AS edited FROM spans WHERE kind = 'final' GROUP BY 1),
j AS (SELECT c.*, list_filter(files, lambda f: NOT list_contains(coalesce(seen, []), f)) AS un, coalesce(edited, []) AS edited, len(list_distinct(flatten(list_transform(m, lambda x: regexp_extract_all(x, '[''"](\w+)[''"]', 1))))) AS k FROM c LEFT JOIN v USING (run_id) LEFT JOIN e USING (run_id))
SELECT run_id, cluster, k AS n_symbols, array_to_string(list_sort(un), ',') AS unviewed, len(un) > 0 AND len(edited) > 0 AND NOT list_has_any(un, edited) AS disjoint FROM j"""),
    "classify_clusters": oracle("failures", """SELECT run_id, exception_type AS cluster, CASE exception_type WHEN 'TypeError' THEN 'INTERFACE_CONSTRAINT' ELSE 'NO_RELIABLE_DEFICIENCY' END AS type,
  CASE WHEN exception_type <> 'TypeError' THEN '' WHEN count(*) = 1 THEN 'ARGUMENT_TYPE_MISMATCH' ELSE 'FRAME_ATTRIBUTE_CONSTRAINT' END AS subtype, CASE exception_type WHEN 'TypeError' THEN 'medium' ELSE 'low' END AS confidence FROM failures GROUP BY 1, 2"""),
    "related_tests": oracle("repo_files", r"""t AS (SELECT 'tests/test_' || split_part(path, '/', -1) AS path, content FROM repo_files),
h AS (SELECT k AS target, path, len(regexp_extract_all(content, '\b' || k || '\b')) AS n FROM t, (VALUES ('g3'), ('f17')) v(k)), s AS (SELECT *, 100 + n AS score FROM h WHERE n > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, path) AS r FROM s) SELECT target, path, CAST(score AS INT) AS score, ends_with(path, '3.py') AS seen FROM r WHERE r <= 5"""),
    "test_index": oracle("repo_files", r"SELECT 'tests/' || path AS path, 'test_' || regexp_extract(path, 'f(\d+)\.py', 1) AS name, 1 AS start_line, 2 AS end_line FROM repo_files"),
}
ORACLES["align_evidence_whole"] = ORACLES["align_evidence"]  # an earlier name of the same query
