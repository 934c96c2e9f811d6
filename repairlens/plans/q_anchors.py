"""Queries over anchors, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from repairlens.operators import anchors as an
from repairlens.operators import contract_actions as ca
from repairlens.operators import hints as hn
from repairlens.operators import source_tree as st
from repairlens.plans.fixtures import oracle, query


def _frames(spans):
    return spans.where("kind = 'gold'").select(F.col("instance_id").alias("run_id"), (F.col("start_line") * 100_000 + F.col("end_line") * 100 + F.regexp_extract("path", r"\d+", 0).cast("int")).alias("pos"), F.concat(F.lit("/testbed/"), "path").alias("file"), F.col("start_line").cast("int").alias("line"), F.concat(F.lit("f"), F.col("end_line").cast("string")).alias("function")).where("run_id % 3 = 0")


def _views(spans):
    return spans.where("kind = 'viewed'").select(F.col("instance_id").alias("run_id"), "path")


def _edits(spans):
    return spans.where("kind = 'final'").groupBy(F.col("instance_id").alias("run_id"), F.concat(F.lit("lib/"), "path").alias("path")).agg(F.min("start_line").alias("pos")).withColumn("pos", F.col("pos") * 100 + F.length("path"))


def _parts(runs, spans):
    frames = _frames(spans).groupBy("run_id", "file", "line", "function").agg(F.min("pos").alias("pos"))
    first = frames.groupBy("run_id", "file").agg(F.min(F.struct("pos", "line", "function")).alias("f")).select("run_id", "file", "f.*")
    return runs, first, _views(spans), _edits(spans)


def _runs(runs):
    return runs.withColumn("symbols", F.split("symbols", " ")).withColumn("trace", F.array("trace")).withColumn("failed_tests", F.when(F.col("failed") != "", F.array("failed")).otherwise(F.array().cast("array<string>")))


def _names(files):
    names = files.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("repo"), F.expr("CASE length(content) % 3 WHEN 0 THEN concat('/testbed/', path) WHEN 1 THEN substring_index(path, '/', -1) ELSE 'setup.py' END").alias("name"))
    own = files.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("repo"), "path")
    return an.resolve_paths(names.distinct(), own.unionByName(own.select("repo", F.concat(F.replace("path", F.lit(".py"), F.lit("")), F.lit("/setup.py")).alias("path"))))


def _hints(runs, files):
    k, root = F.col("run_id"), F.lit("/testbed/")
    own = runs.where("run_id % 3 = 0").select("run_id", F.lit(0).alias("pos"), F.concat(root, "path").alias("file"), F.lit(2).alias("line"), F.lit("g").alias("function"))
    gone = runs.where("run_id % 3 = 1").select("run_id", F.lit(0).alias("pos"), F.concat(root, F.lit("lib/gone.py")).alias("file"), F.lit(7).alias("line"), F.when(k % 2 == 0, "run").otherwise("").alias("function"))
    tests = runs.select("run_id", F.lit(1).alias("pos"), F.lit("/testbed/tests/t.py").alias("file"), F.lit(1).alias("line"), F.lit("t").alias("function"))
    classes = files.select("path", F.concat("content", F.lit("\nclass F"), F.regexp_extract("path", r"f(\d+)\.py", 1), F.lit(":\n    def run(self): pass\n    def html_page(self): pass\n")).alias("content"))
    lines = st.code_lines(classes).withColumn("repo", F.split_part("path", F.lit("/"), F.lit(1)))
    return hn.api_hints(runs, own.unionByName(gone).unionByName(tests), lines, skipped=["i7"])


_CDTYPES = [ca.API, ca.INTERFACE, ca.TESTS, ca.CALLERS, ca.ROOT, ca.REGRESSION, ca.DEPENDENCY, "unknown"]


def _typed(runs, spans):
    own = _runs(runs).withColumn("cdtype", F.element_at(F.array(*(F.lit(t) for t in _CDTYPES)), (F.col("run_id") % 8 + 1).cast("int")))
    parts = _parts(own, spans)
    return ca.typed_actions(ca.run_anchors(own, an.resolve_anchors(*parts), parts[3]))


def _inspected(runs, spans):
    return ca.merge_inspections(_typed(runs, spans), _views(spans).distinct().select("run_id", F.regexp_extract("path", r"\d+", 0).cast("int").alias("pos"), F.col("path").alias("file"), F.lit("visited").alias("source")))


QUERIES = {
    "typed_actions": query(_typed, "anchored", "spans"),
    "merge_inspections": query(_inspected, "anchored", "spans"),
    "api_hints": query(_hints, "hinted", "repo_files"),
    "resolve_anchors": query(lambda r, s: an.resolve_anchors(*_parts(_runs(r), s)), "anchored", "spans"),
    "anchor_summary": query(lambda r, s: an.anchor_summary(_runs(r), an.resolve_anchors(*_parts(_runs(r), s))), "anchored", "spans"),
    "short_to_full": query(lambda r, s: an.short_to_full(s.select(F.col("instance_id").alias("run_id"), F.substring_index("path", "/", -1).alias("name")).distinct(), an.file_anchors(*_parts(_runs(r), s))), "anchored", "spans"),
    "resolve_paths": query(_names, "repo_files"),
}

_FILES = r"""fr AS (SELECT instance_id AS run_id, '/testbed/' || path AS file, start_line AS line, 'f' || end_line AS func, start_line * 100000 + end_line * 100 + CAST(regexp_extract(path, '\d+') AS INT) AS pos FROM spans WHERE kind = 'gold' AND instance_id % 3 = 0),
fs AS (SELECT run_id, file, min(pos) AS pos, arg_min(line, pos) AS line, arg_min(func, pos) AS func FROM fr JOIN anchored USING (run_id) WHERE has_failure GROUP BY 1, 2),
lo AS (SELECT run_id, unnest([1, 2, 3, 4]) AS p, message AS m FROM anchored WHERE has_failure AND run_id NOT IN (SELECT run_id FROM fs)),
lx AS (SELECT run_id, p, CASE p WHEN 1 THEN regexp_extract(m, 'panicked at\s+([^,\s]+):(\d+)', ['a', 'b']) WHEN 2 THEN regexp_extract(m, 'at\s+([^\s]+?)\.(?:js|ts|jsx|tsx):(\d+)', ['a', 'b'])
  WHEN 3 THEN regexp_extract(m, 'at\s+([^\s]+?)\.(?:rs|go|rb|php):(\d+)', ['a', 'b']) ELSE regexp_extract(m, '([^\s]+?)\.(?:rs|rb|php):(\d+)', ['a', 'b']) END AS g FROM lo),
al AS (SELECT run_id, 0 AS step, row_number() OVER (PARTITION BY run_id ORDER BY line, pos) AS o1, '' AS o2, file AS path, line, func, 'stack_frame' AS source FROM fs
UNION ALL SELECT run_id, 1, p, '', g.a, CAST(g.b AS INT), '', (['rust_panic', 'js_location', 'source_location', 'generic_location'])[p] FROM lx WHERE g.a <> ''
UNION ALL SELECT DISTINCT instance_id, 2, 1, path, path, 0, '', 'visited' FROM spans WHERE kind = 'viewed'
UNION ALL SELECT instance_id, 3, min(start_line) * 100 + length('lib/' || path), '', 'lib/' || path, 0, '', 'edited' FROM spans WHERE kind = 'final' GROUP BY instance_id, path),
on1 AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY run_id, path ORDER BY step, o1, o2) = 1),
files AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY step, o1, o2, path) - 1 AS pos, path, line, func, source FROM on1)"""
_ALL = rf"""{_FILES},
sw AS (SELECT run_id, unnest(list_concat(CASE WHEN has_failure THEN list_transform(string_split(symbols, ' '), lambda w: {{'w': w, 's': 'error_symbol'}}) ELSE [] END,
  list_transform(list_filter(regexp_extract_all(issue, '[\pL\pM\pN_]+'), lambda w: length(w) > 4 AND regexp_full_match(w, '[A-Z][a-zA-Z0-9_]+')), lambda w: {{'w': w, 's': 'issue_term'}}),
  CASE WHEN has_failure THEN list_transform(regexp_extract_all(message, '\b[A-Z][a-zA-Z0-9_]{{2,}}\b'), lambda w: {{'w': w, 's': 'error_term'}}) ELSE [] END)) AS x, generate_subscripts(list_concat(CASE WHEN has_failure THEN string_split(symbols, ' ') ELSE [] END,
  list_filter(regexp_extract_all(issue, '[\pL\pM\pN_]+'), lambda w: length(w) > 4 AND regexp_full_match(w, '[A-Z][a-zA-Z0-9_]+')), CASE WHEN has_failure THEN regexp_extract_all(message, '\b[A-Z][a-zA-Z0-9_]{{2,}}\b') ELSE [] END), 1) AS i FROM anchored),
sy AS (SELECT run_id, x.w AS w, min(i) AS i, arg_min(x.s, i) AS s FROM sw WHERE x.w NOT IN ('FAILED', 'ImportError', 'TypeError', 'Error') GROUP BY 1, 2),
ts AS (SELECT run_id, 0 AS step, 0 AS o, failed AS t, 'failed_tests' AS s FROM anchored WHERE has_failure AND failed <> ''
UNION ALL SELECT run_id, 0, 1, regexp_extract(message, 'FAILED\s+(\S+)', 1), 'error_message' FROM anchored WHERE has_failure AND regexp_matches(message, 'FAILED\s+\S+')
UNION ALL SELECT run_id, 1, pos, path, source FROM files JOIN anchored USING (run_id) WHERE contains(lower(path), 'test')),
t1 AS (SELECT run_id, t, min(step * 1000000 + o) AS k, arg_min(s, step * 1000000 + o) AS s FROM ts GROUP BY 1, 2),
anchors AS (SELECT run_id, 'file' AS kind, pos, path AS value, CAST(line AS INT) AS line, func AS detail, source FROM files
UNION ALL SELECT run_id, 'symbol', row_number() OVER (PARTITION BY run_id ORDER BY i) - 1, w, NULL, NULL, s FROM sy
UNION ALL SELECT run_id, 'test', row_number() OVER (PARTITION BY run_id ORDER BY k) - 1, t, NULL, NULL, s FROM t1
UNION ALL SELECT run_id, 'module', 0, regexp_extract(message, '''(\w+)''[^'']+''([\w.]+)''', 2), NULL, regexp_extract(message, '''(\w+)''[^'']+''([\w.]+)''', 1), 'import_error' FROM anchored WHERE has_failure AND run_id % 6 IN (3, 4))"""
_SUMMARY = r"""tf AS (SELECT run_id, arg_min(path, CASE source WHEN 'stack_frame' THEN 0 ELSE 1000000 END + pos) AS p FROM files WHERE source NOT IN ('visited', 'edited') GROUP BY 1),
tt AS (SELECT run_id, arg_min(string_split(value, ':')[1], pos) AS f, arg_min(string_split(value, '::')[-1], pos) FILTER (contains(value, '::')) AS m FROM anchors WHERE kind = 'test' GROUP BY 1),
sm AS (SELECT run_id, coalesce(p, CASE WHEN has_failure THEN regexp_extract(message, '([^\s]+?)\.\w+:(\d+)', 1) ELSE '' END) AS top_file, coalesce(f, '') AS test_file, coalesce(m, '') AS test_method FROM anchored LEFT JOIN tf USING (run_id) LEFT JOIN tt USING (run_id))"""
_TYPED = rf"""{_SUMMARY},
sl AS (SELECT run_id, list(value ORDER BY pos) FILTER (kind = 'symbol') AS sy, list(value ORDER BY pos) FILTER (kind = 'symbol' AND source = 'issue_term') AS iss, list(value ORDER BY pos) FILTER (kind = 'file' AND NOT contains(lower(value), 'test')) AS so,
  list(value ORDER BY pos) FILTER (kind = 'file') AS fi, list(value ORDER BY pos) FILTER (kind = 'file' AND source = 'stack_frame') AS sf, list(value) FILTER (kind = 'module') AS mo, list(detail) FILTER (kind = 'module') AS att FROM anchors GROUP BY 1),
ed AS (SELECT instance_id AS run_id, list(string_split(path, '/')[-1] ORDER BY p, path) AS ed FROM (SELECT instance_id, path, min(start_line) * 100 + length('lib/' || path) AS p FROM spans WHERE kind = 'final' GROUP BY 1, 2) GROUP BY 1),
rw AS (SELECT a.run_id, a.has_failure, a.message, (['API_DEFINITION_CONTEXT', 'INTERFACE_CONSTRAINT_CONTEXT', 'RELATED_TEST_CONTEXT', 'CALLER_CALLEE_CONTEXT', 'ROOT_CAUSE_RELOCALIZATION', 'REGRESSION_CONSTRAINT_CONTEXT', 'DEPENDENCY_CONTEXT', 'unknown'])[a.run_id % 8 + 1] AS cdtype,
  sy[1] AS s1, sy[2] AS s2, iss[1] AS i1, iss[2] AS i2, so[1] AS o1, fi, sf[1] AS f1, mo[1] AS m1, att[1] AS a1, ed[1] AS e1, top_file, test_file, test_method FROM anchored a JOIN sm ON sm.run_id = a.run_id LEFT JOIN sl ON sl.run_id = a.run_id LEFT JOIN ed ON ed.run_id = a.run_id),
ac AS (SELECT run_id, cdtype, unnest(CASE cdtype
  WHEN 'API_DEFINITION_CONTEXT' THEN [(0, 'symbol_definition', s1, 'definition'), (1, 'symbol_definition', s2, 'definition'), (2, 'grep', split_part(s1, '.', 1), 'usage'), (3, 'symbol_definition', a1, ''), (4, 'grep', m1, ''), (5, 'inspect', o1, '')]
  WHEN 'INTERFACE_CONSTRAINT_CONTEXT' THEN [(6, 'caller_search', s1, 'caller'), (7, 'grep', s1 || '(', 'interface_producer'), (8, 'inspect', f1, 'interface_consumer')]
  WHEN 'RELATED_TEST_CONTEXT' THEN [(9, 'inspect', nullif(test_file, ''), 'failed_test'), (10, 'grep', s1, 'neighbor_test'), (11, 'grep', s2, 'neighbor_test'), (12, 'grep', test_method, 'neighbor_test')]
  WHEN 'ROOT_CAUSE_RELOCALIZATION' THEN [(14, 'grep', i1, ''), (15, 'grep', i2, ''), (16, 'grep', regexp_replace(string_split(f1, '/')[-1], '\.[^.]*$', ''), ''), (17, 'inspect', nullif(top_file, ''), '')]
  WHEN 'CALLER_CALLEE_CONTEXT' THEN [(18, 'caller_search', s1, 'caller'), (19, 'grep', regexp_replace(e1, '\.[^.]*$', '') || '(', 'usage'), (20, 'inspect', e1, 'callee')]
  WHEN 'REGRESSION_CONSTRAINT_CONTEXT' THEN [(21, 'grep', regexp_replace(e1, '\.[^.]*$', ''), ''), (22, 'inspect', nullif(test_file, ''), ''), (23, 'grep', s1, '')]
  WHEN 'DEPENDENCY_CONTEXT' THEN [(24, 'grep', 'import ' || split_part(coalesce(s1, m1), '.', 1), '')] ELSE [] END) AS a, fi FROM rw),
ty AS (SELECT run_id, a[1] AS pos, cdtype, a[2] AS type, CASE WHEN a[2] = 'inspect' AND NOT contains(a[3], '/') THEN coalesce(list_filter(fi, lambda f: ends_with(f, '/' || a[3]))[1], a[3]) ELSE a[3] END AS target, a[4] AS role, CASE WHEN a[4] <> '' THEN 'pair_1' ELSE '' END AS pair
  FROM ac WHERE a[3] IS NOT NULL AND (a[2] = 'inspect' OR length(a[3]) >= 2))"""
ORACLES = {
    "typed_actions": oracle("anchored spans", f"{_ALL}, {_TYPED} SELECT * FROM ty"),
    "merge_inspections": oracle("anchored spans", rf"""{_ALL}, {_TYPED}, u AS (SELECT run_id, target AS file, 0 AS step, pos, 'cdtype_driven_action' AS source FROM ty WHERE type = 'inspect' UNION ALL SELECT DISTINCT instance_id, path, 1, CAST(regexp_extract(path, '\d+') AS INT), 'visited' FROM spans WHERE kind = 'viewed'),
z AS (SELECT run_id, count(*) AS n, bool_or(step = 0) AS t FROM u GROUP BY 1), o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY run_id, file ORDER BY step, pos, source) = 1),
r AS (SELECT o.*, row_number() OVER (PARTITION BY run_id ORDER BY step, pos, file) AS rank FROM o) SELECT run_id, rank, file, source FROM r JOIN z USING (run_id) WHERE rank <= CASE WHEN t THEN least(n, 12) ELSE 10 END"""),
    "api_hints": oracle("hinted", r"""h AS (SELECT *, CASE WHEN run_id % 3 = 0 THEN 1 WHEN run_id % 3 = 1 AND run_id % 2 = 0 THEN 2 WHEN run_id % 4 = 2 THEN 3 WHEN run_id % 4 = 0 THEN 4 WHEN run_id % 4 = 1 THEN 5 END AS p,
  CASE WHEN instance = 'i7' THEN 'needs_regression_witness' WHEN NOT has_failure THEN 'no_legal_api_hint' END AS off FROM hinted)
SELECT run_id, coalesce(off, CASE WHEN p IS NULL THEN 'no_legal_api_hint' ELSE 'hint_generated' END) AS mode,
  CASE WHEN off IS NULL THEN coalesce((['repo_source_signature', 'runtime_introspection', 'issue_keyword_api_match', 'issue_keyword_api_match', 'public_api_signature'])[p], '') ELSE '' END AS source,
  CASE WHEN off IS NULL THEN coalesce(CASE p WHEN 1 THEN path || ':2' WHEN 2 THEN '/testbed/lib/gone.py:7' WHEN 3 THEN path || ':' || n WHEN 4 THEN 'error_message_keyword_match:app_label,INSTALLED_APPS' WHEN 5 THEN 'public_api:django.db.models.base.ModelBase' END, '') ELSE '' END AS artifact,
  CASE WHEN off IS NULL THEN coalesce(CASE p WHEN 1 THEN path || '::f' || run_id WHEN 2 THEN 'lib/gone::run' WHEN 3 THEN path || '::F' || run_id || '.html_page' WHEN 4 THEN 'django.db.models.base.ModelBase.__new__' WHEN 5 THEN 'django.db.models.base.ModelBase' END, '') ELSE '' END AS target,
  CASE WHEN off IS NULL THEN coalesce(([0.65, 0.85, 0.65, 0.45, 0.45])[p], 0) ELSE 0 END::DOUBLE AS confidence,
  CASE WHEN off IS NULL THEN coalesce((['repo_file_signature_extraction', 'top_repo_frame_extraction', 'test_class_to_impl_class_resolution', 'error_message_keyword_match', 'public_api_name_match'])[p], '') ELSE '' END AS method,
  CASE WHEN off = 'needs_regression_witness' THEN 'f2p_passed_no_p2p_raw_output' WHEN off IS NOT NULL THEN 'no_failure_witness' WHEN p IS NULL THEN 'no_legal_hint_source_matched' ELSE '' END AS missing FROM h"""),
    "resolve_anchors": oracle("anchored spans", f"{_ALL} SELECT * FROM anchors"),
    "anchor_summary": oracle("anchored spans", rf"""{_ALL},
tf AS (SELECT run_id, arg_min(path, CASE source WHEN 'stack_frame' THEN 0 ELSE 1000000 END + pos) AS p, arg_min(source, CASE source WHEN 'stack_frame' THEN 0 ELSE 1000000 END + pos) AS s FROM files WHERE source NOT IN ('visited', 'edited') GROUP BY 1),
tt AS (SELECT run_id, arg_min(string_split(value, ':')[1], pos) AS f, arg_min(string_split(value, '::')[-1], pos) FILTER (contains(value, '::')) AS m FROM anchors WHERE kind = 'test' GROUP BY 1)
SELECT run_id, coalesce(p, CASE WHEN has_failure THEN regexp_extract(message, '([^\s]+?)\.\w+:(\d+)', 1) ELSE '' END) AS top_file,
  coalesce(s, CASE WHEN has_failure AND regexp_matches(message, '([^\s]+?)\.\w+:(\d+)') THEN 'error_message' ELSE 'unknown' END) AS provenance, coalesce(f, '') AS test_file, coalesce(m, '') AS test_method
FROM anchored LEFT JOIN tf USING (run_id) LEFT JOIN tt USING (run_id)"""),
    "short_to_full": oracle("anchored spans", rf"""{_FILES}, n AS (SELECT DISTINCT instance_id AS run_id, string_split(path, '/')[-1] AS name FROM spans)
SELECT n.run_id, name, coalesce(arg_min(path, pos), name) AS path FROM n LEFT JOIN files f ON f.run_id = n.run_id AND ends_with(f.path, '/' || name) GROUP BY 1, 2"""),
    "resolve_paths": oracle("repo_files", """n AS (SELECT DISTINCT split_part(path, '/', 1) AS repo, CASE length(content) % 3 WHEN 0 THEN '/testbed/' || path WHEN 1 THEN string_split(path, '/')[-1] ELSE 'setup.py' END AS name FROM repo_files),
c AS (SELECT split_part(path, '/', 1) AS repo, count(DISTINCT path) AS n, min(path) AS path FROM repo_files GROUP BY 1)
SELECT repo, name, CASE WHEN name = 'setup.py' THEN CASE WHEN n = 1 THEN replace(path, '.py', '') || '/setup.py' END WHEN name LIKE '/testbed/%' THEN substring(name, 10) ELSE repo || '/' || name END AS path,
  CASE WHEN name LIKE '/testbed/%' THEN 2 ELSE 1 END AS parts, CASE WHEN name = 'setup.py' THEN n ELSE 1 END AS candidates FROM n JOIN c USING (repo)"""),
}
