"""Queries over test runs, costs, coverage and the evaluation matrix, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from repairlens.operators import conversations as cv
from repairlens.operators import evaluation as ev
from repairlens.operators import failures as fl
from repairlens.operators import guards as gd
from repairlens.operators import planning as pl
from repairlens.operators import retrieval as rt
from repairlens.operators import selection as sl
from repairlens.operators import source_tree as st
from repairlens.plans import q_analysis, q_conversations
from repairlens.plans.fixtures import oracle, query


def _results(messages):
    out = pl.test_run_results(cv.classify_commands(cv.extract_commands(messages)), messages)
    return out.select("run_id", "test_step", "cmd", "out_step", "returncode", F.array_join("failed_tests", ",").alias("failed"), F.length("excerpt").alias("chars"))


def _costs(messages):
    timed = messages.withColumn("ts", F.when(F.col("step") % 3 > 0, F.col("step") * 10 + F.col("run_id") % 7))
    runs = messages.select("run_id").distinct().select("run_id", F.expr("CASE run_id % 3 WHEN 0 THEN concat('acme/m', CAST(run_id % 2 AS STRING)) WHEN 1 THEN 'plain' ELSE '' END").alias("model_name"), F.when(F.col("run_id") % 4 > 0, F.col("run_id") % 9).alias("api_calls"), (F.col("run_id") % 5 / 4).alias("instance_cost"))
    return pl.run_costs(timed, runs)


def _chained(failures):
    events = fl.failure_events(failures).withColumn("call_chain", F.array(F.concat(F.lit("a"), (F.col("ord") % 2).cast("string")), F.lit("c"), F.concat(F.lit("b"), (F.col("run_id") % 3).cast("string"))))
    out = fl.cluster_frames(events, events.select("run_id", "ord", F.col("error_class").alias("cluster")))
    return out.select("run_id", "cluster", F.array_join("shared_frames", ",").alias("shared"), "root_cause", F.array_join("error_types", ",").alias("types"), F.size("test_names").alias("n"))


def _files(spans, kind):
    return spans.where(F.col("kind") == kind).select(F.col("instance_id").alias("run_id"), F.col("path").alias("file"))


def _facts(records):
    return records.where("instance_id % 6 > 0").groupBy("instance_id").agg((F.max("ord") % 3).alias("test_failures"), (F.max("ord") % 2 == 0).alias("patch_exists"), (F.max("ord") % 5 == 0).alias("submitted_without_tests"), F.count("*").alias("test_runs"), F.max("ord").alias("patch_chars"))


def _matrix(customer, records):
    instances = customer.select(F.col("c_custkey").alias("instance_id"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("b"), (F.col("c_custkey") % 3).cast("string"))).alias("batch"))
    return ev.eval_matrix(instances, _facts(records), records)


def _evidence(spans):
    tests = spans.where("kind = 'gold'").select("path", F.concat(F.lit("test_alpha_"), (F.col("start_line") % 30).cast("string")).alias("name"), F.lit(1).alias("start_line"), F.lit(4).alias("end_line")).distinct()
    names = spans.where("kind = 'viewed'").select(F.col("instance_id").alias("run_id"), F.expr("CASE end_line % 3 WHEN 0 THEN 'test_alpha_3' WHEN 1 THEN 'alpha_2' ELSE 'test_pha_1' END").alias("name"), (F.col("start_line") % 7 == 0).alias("is_regression"))
    return rt.failed_test_evidence(tests, names, spans.where("kind = 'final'").select(F.col("instance_id").alias("run_id"), "path", "start_line", "end_line"))


def _rehydrated(spans, files):
    part = lambda k: spans.where(F.col("kind") == k).select(F.col("instance_id").alias("run_id"), F.concat(F.lit("src"), (F.col("start_line") % 3).cast("string"), F.lit("/f"), (F.col("start_line") % 3).cast("string"), F.lit(".py")).alias("path"), (F.col("end_line") - F.col("start_line")).cast("long").alias("start_line"), (F.col("end_line") - F.col("start_line") + 1).cast("long").alias("end_line"))
    words = spans.select(F.col("instance_id").alias("run_id"), F.element_at(F.array(F.lit("x.return"), F.lit("SRC1"), F.lit("def")), (F.col("start_line") % 3 + 1).cast("int")).alias("word")).distinct()
    kept = part("final").where("start_line > 2").unionByName(part("candidate").where("start_line = 7 AND run_id % 3 = 0").withColumns({"start_line": F.lit(None).cast("long"), "end_line": F.lit(None).cast("long")}))
    return rt.rehydrate_spans(part("viewed"), kept, st.code_lines(files), words).withColumn("matched", F.array_join("matched", ","))


def _branches(orders):
    k = F.col("o_orderkey")
    text = lambda n, name: F.when(k % n > 0, F.concat(F.lit("s"), (k % 3).cast("string"))).alias(name)
    return pl.branch_fairness(orders.select(k.alias("run_id"), text(11, "base_sha"), F.concat(F.lit("s"), (F.col("o_custkey") % 3).cast("string")).alias("first_sha"), text(7, "second_sha"), text(5, "base_state"), text(13, "first_state"), text(4, "second_state"),
        (k % 6 > 0).alias("first_restored"), (k % 8 > 0).alias("second_restored"), (k % 2 == 0).alias("second_run"), (k % 9 > 0).alias("first_intact"), (k % 10 > 0).alias("second_intact"), F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'UNRESOLVED' ELSE 'ERROR' END").alias("first_status"), F.lit("RESOLVED").alias("second_status")))


QUERIES = {
    "branch_fairness": query(lambda o: _branches(o).select("run_id", "fair", "same_state", "first_valid", "second_valid"), "orders"),
    "name_gates": query(lambda d, p: gd.name_gates(d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("canonical"), F.concat("source", F.when(F.col("doc_id") % 50 == 7, "_").otherwise("__"), F.col("doc_id").cast("string"), F.lit(".json")).alias("name")), p.select(F.col("p_brand").alias("canonical_id"))), "documents", "part"),
    "failure_queries": query(lambda i: st.failure_queries(i.select("instance_id", F.slice(F.split("issue", " "), 1, 4).alias("error_tokens"), F.concat(F.lit("AcmeError models.E0"), F.lpad((F.col("instance_id") % 90).cast("string"), 2, "0"), F.lit(" AcmeError ValueError")).alias("trace")), 6), "issues"),
    "test_name_queries": query(lambda i: st.test_name_queries(i.select("instance_id", F.split("issue", " ").alias("test_failures"))), "issues"),
    "filter_registry": query(lambda c: sl.filter_registry(c.select("c_custkey", F.col("c_mktsegment").alias("pool"), F.expr("CASE WHEN c_custkey % 3 > 0 THEN concat('s', CAST(c_custkey % 3 AS STRING)) END").alias("source"), F.expr("CASE c_custkey % 4 WHEN 0 THEN 'Python' WHEN 1 THEN 'GO' ELSE 'rust' END").alias("language")), None, ["s1", "s2"], ["python", "go"]), "customer"),
    "failed_test_evidence": query(_evidence, "spans"),
    "rehydrate_spans": query(_rehydrated, "spans", "repo_files"),
    "rejected_assumptions": query(lambda s: pl.rejected_assumptions(*(s.where(F.col("kind") == k).where("start_line % 40 = 0").select(F.col("instance_id").alias("run_id"), F.col("end_line").alias("pos"), F.concat(F.lit(r), "path").alias("file")) for k, r in (("final", "a/"), ("gold", "b/")))), "spans"),
    "test_run_results": query(_results, "messages"),
    "run_costs": query(_costs, "messages"),
    "cost_by_model": query(lambda m: pl.cost_by_model(_costs(m)), "messages"),
    "cluster_frames": query(_chained, "failures"),
    "gold_coverage": query(lambda s: pl.gold_coverage(*(s.where(F.col("kind") == k).select("instance_id", "path", F.col("start_line").alias("step")) for k in ("viewed", "final", "gold"))).withColumn("seen_then_dropped", F.array_join("seen_then_dropped", ",")), "spans"),
    "error_visit_runs": query(lambda f, s: pl.error_visit_alignment(f.where("run_id % 5 > 0").select("run_id", F.substring_index("root_frame", ":", 1).alias("file"), (F.col("ord") % 2 == 0).alias("is_test")), _files(s, "viewed"), f.select("run_id", (F.col("run_id") % 4 > 0).alias("has_failure")).distinct()), "failures", "spans"),
    "run_features": query(lambda m: cv.run_features(m, m.select("run_id", F.concat(F.lit("f"), (F.col("step") % 3).cast("string")).alias("file"))), "messages"),
    "context_sets": query(lambda s: cv.context_sets(_files(s, "viewed"), _files(s, "candidate"), _files(s, "final")).select("run_id", F.array_join("viewed_not_final", ",").alias("viewed_not_final"), F.array_join("edited_not_viewed", ",").alias("edited_not_viewed")), "spans"),
    "viewed_then_dropped": query(lambda s: cv.viewed_then_dropped(_files(s, "viewed"), _files(s, "final"), _files(s, "gold")), "spans"),
    "eval_matrix": query(_matrix, "customer", "eval_records"),
    "matrix_counts": query(lambda c, r: ev.matrix_counts(_matrix(c, r)), "customer", "eval_records"),
    "first_failed": query(lambda c, r: ev.first_failed(_matrix(c, r)).select("instance_id", "batch", "failure_class"), "customer", "eval_records"),
}

_COSTS = """t AS (SELECT run_id, step * 10 + run_id % 7 AS ts FROM messages WHERE step % 3 > 0), w AS (SELECT run_id, CASE WHEN count(*) > 1 THEN CAST(max(ts) - min(ts) AS DOUBLE) END AS wall FROM t GROUP BY 1),
co AS (SELECT run_id, CASE run_id % 3 WHEN 0 THEN 'acme/m' || (run_id % 2) WHEN 1 THEN 'plain' ELSE 'unknown' END AS model, CASE run_id % 3 WHEN 0 THEN 'acme' ELSE 'unknown' END AS provider, CASE WHEN run_id % 4 > 0 THEN run_id % 9 ELSE 0 END AS api_calls,
  wall AS wall_seconds, nullif((run_id % 5) / 4, 0) AS usd, CASE WHEN run_id % 5 > 0 THEN 'instance_cost' ELSE 'unavailable' END AS pricing FROM (SELECT DISTINCT run_id FROM messages) LEFT JOIN w USING (run_id))"""
_MATRIX = f"""{q_analysis._MERGED}, fa AS (SELECT instance_id, max(ord) % 3 AS test_failures, max(ord) % 2 = 0 AS patch_exists, max(ord) % 5 = 0 AS submitted_without_tests, count(*) AS test_runs, max(ord) AS patch_chars FROM eval_records WHERE instance_id % 6 > 0 GROUP BY 1),
mx AS (SELECT c_custkey AS instance_id, CASE WHEN c_custkey % 3 > 0 THEN 'b' || (c_custkey % 3) ELSE 'unknown' END AS batch, coalesce(patch_exists, false) AS patch_exists, coalesce(patch_chars, 0) AS patch_chars, coalesce(test_runs, 0) AS test_runs, coalesce(test_failures, 0) AS test_failures,
  coalesce(submitted_without_tests, false) AS submitted_without_tests, coalesce(resolved, 'NOT_EVALUATED') AS resolved, coalesce(status, 'NOT_EVALUATED') AS status, coalesce(conflict, false) AS conflict FROM customer LEFT JOIN fa ON fa.instance_id = c_custkey LEFT JOIN merged ON merged.instance_id = c_custkey),
mc AS (SELECT *, CASE WHEN status IN ('ENV_ERROR', 'PATCH_APPLY_FAILED') THEN 'env-anomaly' WHEN status = 'CONFLICT' THEN 'unknown' WHEN resolved = 'True' THEN 'resolved' WHEN status = 'NOT_EVALUATED' THEN 'unknown' WHEN test_failures > 0 THEN 'visible-failure'
  WHEN submitted_without_tests THEN 'no-runtime-signal' WHEN patch_exists THEN 'hidden-failure' ELSE 'unknown' END AS failure_class FROM mx)"""
_KINDS = "k AS (SELECT DISTINCT kind, instance_id AS run_id, path AS file FROM spans), p AS (SELECT run_id, file, bool_or(kind = 'viewed') AS v, bool_or(kind = 'final') AS f, bool_or(kind = 'candidate') AS c, bool_or(kind = 'gold') AS g FROM k GROUP BY 1, 2)"
ORACLES = {
    "branch_fairness": """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 > 0 THEN 's' || (o_orderkey % 3) END AS b, 's' || (o_custkey % 3) AS f, CASE WHEN o_orderkey % 7 > 0 THEN 's' || (o_orderkey % 3) END AS s FROM orders),
c AS (SELECT k, coalesce(b = f, false) AS bf, coalesce(b = s, false) AS bs, k % 5 > 0 AND k % 13 > 0 AS st1, k % 5 > 0 AND k % 4 > 0 AS st2, k % 2 = 0 AS ran FROM o)
SELECT k AS run_id, bf AND k % 6 > 0 AND (NOT ran OR (bs AND k % 8 > 0)) AS fair, bf AND st1 AND (NOT ran OR (bs AND st2)) AS same_state, k % 9 > 0 AND k % 3 < 2 AS first_valid, NOT ran OR k % 10 > 0 AS second_valid FROM c""",
    "name_gates": "SELECT 'G1' AS gate, 'unique canonical ids' AS description, count(DISTINCT p_brand) = count(*) AS ok FROM part UNION ALL SELECT 'G2', 'expected names', count(*) FILTER (doc_id % 50 = 7) = 0 FROM documents UNION ALL SELECT 'G3', 'no errors', true UNION ALL SELECT 'G4', 'no name twice', count(DISTINCT source || doc_id) = count(*) FROM documents",
    "failure_queries": oracle("issues", """t AS (SELECT instance_id, list_transform(list_filter(string_split(issue, ' ')[1:4], lambda x: length(x) >= 3), lambda x: trim(x, ' ')) AS a, ['AcmeError', 'ValueError', 'models.E0' || lpad(CAST(instance_id % 90 AS VARCHAR), 2, '0')] AS f FROM issues),
q AS (SELECT instance_id, (a || list_filter(f, lambda x: NOT list_contains(a, x)))[1:6] AS q FROM t) SELECT instance_id, unnest(range(len(q))) AS rank, unnest(q) AS query FROM q"""),
    "test_name_queries": oracle("issues", """t AS (SELECT instance_id, list_filter(list_transform(string_split(issue, ' '), lambda x: trim(x, ' ')), lambda x: length(x) >= 3) AS a FROM issues),
q AS (SELECT instance_id, list_filter(a, lambda x, i: list_position(a, x) = i)[1:12] AS q FROM t) SELECT instance_id, unnest(range(len(q))) AS rank, unnest(q) AS query FROM q"""),
    "filter_registry": "SELECT c_custkey, c_mktsegment AS pool, 's' || (c_custkey % 3) AS source, CASE c_custkey % 4 WHEN 0 THEN 'Python' ELSE 'GO' END AS language FROM customer WHERE c_custkey % 3 > 0 AND c_custkey % 4 < 2",
    "failed_test_evidence": oracle("spans", """t AS (SELECT DISTINCT path, 'test_alpha_' || (start_line % 30) AS symbol FROM spans WHERE kind = 'gold'),
b AS (SELECT n, coalesce((SELECT min(path) FROM t WHERE symbol = n), (SELECT min({'p': path, 's': symbol}).p FROM t WHERE contains(symbol, n)), (SELECT min({'p': path, 's': symbol}).p FROM t WHERE contains(symbol, regexp_replace(n, '^test_', '')))) AS path,
  CASE n WHEN 'test_alpha_3' THEN n WHEN 'alpha_2' THEN (SELECT min({'p': path, 's': symbol}).s FROM t WHERE contains(symbol, n)) ELSE (SELECT min({'p': path, 's': symbol}).s FROM t WHERE contains(symbol, 'pha_1')) END AS symbol FROM (VALUES ('test_alpha_3'), ('alpha_2'), ('test_pha_1')) v(n)),
r AS (SELECT instance_id AS run_id, CASE end_line % 3 WHEN 0 THEN 'test_alpha_3' WHEN 1 THEN 'alpha_2' ELSE 'test_pha_1' END AS name, bool_or(start_line % 7 = 0) AS g FROM spans WHERE kind = 'viewed' GROUP BY 1, 2)
SELECT run_id, name, path, symbol, 1 AS start_line, 4 AS end_line, CASE WHEN g THEN 0.95 ELSE 0.78 END::DOUBLE AS score, CASE WHEN g THEN 'visible_regression_test' ELSE 'target_fix_test' END AS relation,
  EXISTS (SELECT 1 FROM spans s WHERE s.kind = 'final' AND s.instance_id = r.run_id AND s.path = b.path AND s.start_line <= 14 AND s.end_line >= -9) AS seen FROM r JOIN b ON n = name WHERE path IS NOT NULL"""),
    "rehydrate_spans": oracle("spans repo_files", r"""x AS (SELECT DISTINCT kind, instance_id AS run_id, 'src' || (start_line % 3) || '/f' || (start_line % 3) || '.py' AS path, end_line - start_line AS a, end_line - start_line + 1 AS b FROM spans),
k AS (SELECT * FROM x WHERE (kind = 'final' AND a > 2) OR (kind = 'candidate' AND a = 7 AND run_id % 3 = 0)), kl AS (SELECT DISTINCT run_id, path, unnest(range(a, b + 1)) AS ln FROM k WHERE kind = 'final'),
v AS (SELECT v.*, EXISTS (SELECT 1 FROM k WHERE k.run_id = v.run_id AND k.path = v.path) AS inf FROM x v WHERE kind = 'viewed' AND NOT EXISTS (SELECT 1 FROM k WHERE k.kind = 'candidate' AND k.run_id = v.run_id AND k.path = v.path)
  AND (SELECT count(*) FROM kl WHERE kl.run_id = v.run_id AND kl.path = v.path AND kl.ln BETWEEN v.a AND v.b) < v.b - v.a + 1),
l AS (SELECT path, string_split(content, chr(10)) AS t FROM repo_files WHERE path IN ('src0/f0.py', 'src1/f1.py', 'src2/f2.py')),
w AS (SELECT DISTINCT instance_id AS run_id, (['x.return', 'SRC1', 'def'])[start_line % 3 + 1] AS word FROM spans),
m AS (SELECT v.run_id, v.path, a, b, inf, word FROM v LEFT JOIN l ON l.path = v.path JOIN w ON w.run_id = v.run_id WHERE (word = 'SRC1' AND contains(v.path, 'src1')) OR (word <> 'def' AND contains(lower(array_to_string(t[greatest(a, 1) : b], chr(10))), CASE word WHEN 'SRC1' THEN 'src1' ELSE 'return' END))),
c AS (SELECT run_id, path, a, b, inf, count(*) AS n, string_agg(word, ',' ORDER BY word) AS matched FROM m GROUP BY ALL), s AS (SELECT *, CASE WHEN inf THEN 85 + least(5 * n, 10) ELSE 65 + least(8 * n, 20) END / 100 AS score FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY inf DESC, n DESC, score DESC, path, a, b) - 1 AS rank FROM s)
SELECT run_id, rank, path, a AS start_line, b AS end_line, CASE WHEN inf THEN 'previously_seen_but_dropped' ELSE 'previously_seen_uncovered_file' END AS relation, score, matched FROM r WHERE rank < 4"""),
    "rejected_assumptions": oracle("spans", """q AS (SELECT kind, instance_id AS run_id, path, min(end_line) AS p FROM spans WHERE kind IN ('final', 'gold') AND start_line % 40 = 0 GROUP BY 1, 2, 3),
l AS (SELECT run_id, list('a/' || path ORDER BY p, path) FILTER (kind = 'final') AS e, list('b/' || path ORDER BY p, path) FILTER (kind = 'gold') AS x, list(path) FILTER (kind = 'final') AS be, list(path) FILTER (kind = 'gold') AS bx FROM q GROUP BY 1)
SELECT run_id, 'edited ' || array_to_string(e[1:3], ', ') || ' but error is in ' || array_to_string(x[1:3], ', ') AS assumption, array_to_string(x[1:3], '; ') AS location FROM l WHERE e IS NOT NULL AND x IS NOT NULL AND NOT list_has_any(be, bx)"""),
    "test_run_results": oracle("messages", """SELECT t.run_id, t.step AS test_step, 'python -m pytest tests/test_' || (t.run_id % 7) || '.py' AS cmd, o.step AS out_step, CAST(o.step % 2 AS INT) AS returncode, '' AS failed,
  least(1500, length(regexp_extract(o.content, '<output>([\\s\\S]*?)</output>', 1))) AS chars FROM messages t JOIN messages o ON o.run_id = t.run_id AND o.role = 'tool' AND o.step = t.step + 1 WHERE t.role = 'assistant' AND t.step % 4 = 3"""),
    "run_costs": oracle("messages", f"{_COSTS} SELECT * FROM co"),
    "cost_by_model": oracle("messages", f"{_COSTS} SELECT provider, model, count(*) AS n, CAST(sum(api_calls) AS BIGINT) AS api_calls, sum(wall_seconds) AS wall_seconds, round(sum(usd), 6) AS usd FROM co GROUP BY 1, 2"),
    "cluster_frames": oracle("failures", f"""{q_analysis._EV}, c AS (SELECT run_id, error_class AS cluster, count(*) AS n, min(ord % 2) AS lo, max(ord % 2) AS hi FROM ev GROUP BY 1, 2), y AS (SELECT run_id, error_class AS cluster, exception_type || ':' || count(*) AS t FROM ev GROUP BY run_id, error_class, exception_type),
z AS (SELECT run_id, cluster, string_agg(t, ',' ORDER BY t) AS types FROM y GROUP BY 1, 2)
SELECT run_id, cluster, CASE WHEN lo = hi THEN 'a' || lo || ',' ELSE '' END || 'c,b' || (run_id % 3) AS shared, CASE WHEN lo = hi THEN 'a' || lo ELSE 'c' END AS root_cause, types, n FROM c JOIN z USING (run_id, cluster)"""),
    "gold_coverage": oracle("spans", """g AS (SELECT DISTINCT instance_id, path FROM spans WHERE kind = 'gold'), v AS (SELECT instance_id, path, min(start_line) AS s FROM spans WHERE kind = 'viewed' GROUP BY 1, 2), e AS (SELECT DISTINCT instance_id, path, 1 AS e FROM spans WHERE kind = 'final'),
j AS (SELECT * FROM g LEFT JOIN v USING (instance_id, path) LEFT JOIN e USING (instance_id, path))
SELECT instance_id, min(s) AS first_step, count(s) / count(*) AS coverage, coalesce(string_agg(string_split(path, '/')[-1], ',' ORDER BY string_split(path, '/')[-1]) FILTER (s IS NOT NULL AND e IS NULL), '') AS seen_then_dropped FROM j GROUP BY 1"""),
    "error_visit_runs": oracle("failures spans", """f AS (SELECT run_id, split_part(root_frame, ':', 1) AS file, ord % 2 = 0 AS t FROM failures WHERE run_id % 5 > 0), x AS (SELECT f.*, EXISTS (SELECT 1 FROM spans s WHERE s.kind = 'viewed' AND s.instance_id = f.run_id AND s.path = f.file) AS seen FROM f),
a AS (SELECT run_id, CASE WHEN bool_or(seen AND NOT t) THEN 'visited_error_file' WHEN bool_or(seen AND t) THEN 'visited_stack_frame' ELSE 'visited_none' END AS al FROM x GROUP BY 1)
SELECT DISTINCT run_id, CASE WHEN run_id % 4 > 0 THEN coalesce(al, 'unknown') ELSE 'unknown' END AS alignment FROM failures LEFT JOIN a USING (run_id)"""),
    "run_features": oracle("messages", f"""q AS ({q_conversations.ORACLES['file_view_counts']}), tf AS ({q_conversations.ORACLES['trajectory_features']}), n AS (SELECT run_id, count(*) AS k FROM q GROUP BY 1), e AS (SELECT run_id, count(DISTINCT step % 3) AS k FROM messages GROUP BY 1)
SELECT tf.*, coalesce(n.k, 0) AS files_visited, e.k AS files_edited FROM tf LEFT JOIN n ON n.run_id = tf.run_id JOIN e ON e.run_id = tf.run_id"""),
    "context_sets": oracle("spans", f"{_KINDS} SELECT run_id, coalesce(string_agg(file, ',' ORDER BY file) FILTER (v AND NOT f), '') AS viewed_not_final, coalesce(string_agg(file, ',' ORDER BY file) FILTER (c AND NOT v), '') AS edited_not_viewed FROM p WHERE v OR c OR f GROUP BY 1"),
    "viewed_then_dropped": oracle("spans", f"{_KINDS} SELECT run_id, string_split(file, '/')[-1] AS file, CASE WHEN v THEN 'dropped' ELSE 'unvisited' END AS reason FROM p WHERE (v AND NOT f) OR (g AND NOT v)"),
    "eval_matrix": oracle("eval_records", f"{_MATRIX} SELECT * FROM mc"),
    "matrix_counts": oracle("eval_records", f"""{_MATRIX} SELECT metric, count(*) FILTER (CASE metric WHEN 'discovered' THEN true WHEN 'evaluated' THEN status = 'EVALUATED' WHEN 'not_evaluated' THEN status = 'NOT_EVALUATED' WHEN 'broken' THEN status IN ('ENV_ERROR', 'PATCH_APPLY_FAILED')
  WHEN 'resolved' THEN resolved = 'True' WHEN 'unresolved' THEN resolved = 'False' ELSE status = 'CONFLICT' END) AS n FROM mc, (SELECT unnest(['discovered', 'evaluated', 'not_evaluated', 'broken', 'resolved', 'unresolved', 'conflicts']) AS metric) GROUP BY 1"""),
    "first_failed": oracle("eval_records", f"{_MATRIX} SELECT instance_id, batch, failure_class FROM mc WHERE resolved = 'False' AND status = 'EVALUATED' AND NOT conflict"),
}
