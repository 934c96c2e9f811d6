"""Queries over logs, patches and source files, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from repairlens.operators import dialects as dl
from repairlens.operators import logs as lg
from repairlens.operators import patches as pt
from repairlens.operators import source_tree as st
from repairlens.operators import witnesses as wt
from repairlens.plans.fixtures import oracle, query


def _terms(df, name, values):
    """A short list of search terms as a table."""
    return df.sparkSession.range(1).select(F.explode(F.array(*(F.lit(v) for v in values))).alias(name))


def _frames(spans):
    prefix = F.expr("CASE start_line % 5 WHEN 0 THEN '/testbed/' WHEN 1 THEN '/usr/lib/' WHEN 2 THEN '' WHEN 3 THEN '/opt/site-packages/' ELSE 'tests/' END")
    return lg.normalize_frames(spans.select(F.concat(prefix, F.col("path")).alias("path")).distinct())


def _submissions(p):
    return pt.patch_integrity(p.select("run_id", F.expr("CASE run_id % 7 WHEN 0 THEN 'LimitsExceeded' ELSE 'Submitted' END").alias("termination"), F.expr("CASE run_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'nothing here' WHEN 2 THEN replace(patch_text, 'b/src', 'b/../src') ELSE patch_text END").alias("patch_text")))


def _other(p):
    return pt.patch_consistency(p, p.select("run_id", F.expr("CASE run_id % 3 WHEN 0 THEN concat(patch_text, chr(10)) WHEN 1 THEN '' ELSE concat('x', patch_text) END").alias("patch_text")))


def _authority(logs):
    staged = lg.failure_stage(logs).select("run_id", "stage")
    return lg.stage_authority(staged, staged.select("run_id", (F.col("run_id") % 9 != 0).alias("patch_applied"), (F.col("run_id") % 10 == 0).alias("timed_out")).where("run_id % 4 <> 0"))


def _quality(logs):
    t = "run_id"
    return lg.witness_quality(lg.failure_stage(logs).select(t, (F.col(t) % 11 != 0).alias("observed"), "stage", (F.col(t) % 2 == 0).alias("has_expected"), (F.col(t) % 3 == 0).alias("has_trace"), (F.col(t) % 5 < 3).alias("has_tests"), (F.col(t) % 7 < 5).alias("has_witness")))


def _sites(spans):
    symbols = spans.where("kind = 'gold'").select(F.col("path"), F.concat(F.lit("s"), (F.col("start_line") % 30).cast("string")).alias("name"), "start_line", "end_line").distinct()
    sites = spans.where("kind = 'viewed'").select("path", F.col("end_line").alias("ln")).distinct().withColumn("site_id", F.concat_ws(":", "path", "ln"))
    return st.enclosing_definition(symbols, sites)




def _sibling_methods(spans):
    c = F.concat(F.lit("C"), (F.col("start_line") % 5).cast("string"))
    name = F.concat(F.when(F.col("start_line") % 4 == 0, "Out.").otherwise(""), c, F.lit(".s"), (F.col("start_line") % 9).cast("string"))
    symbols = spans.select("path", name.alias("name"), c.alias("parent")).distinct()
    return st.sibling_methods(symbols, symbols.where("NOT startswith(name, 'Out.')").select(F.col("name").alias("hint")).distinct())


_kind = lambda s, k: s.where(F.col("kind") == k).select("instance_id", "path", "start_line", "end_line").distinct()
_candidates = lambda s: st.expand_context({k: _kind(s, k) for k in ("viewed", "final", "candidate")}, ["final", "viewed", "candidate"])
_stop = ["that", "this", "with", "from"]

def _classes(files):
    """Each source wrapped: a class with a long string at column 0, a comment there, an async and a nested method, and the source after it."""
    head = "class A:\n    \"\"\"Doc\nclass No:\n\"\"\"\n# note\n    @property\n    def run(\n        self, x=(1,\n  2),\n    ):\n        return {\n}\n\n    if True:\n        def hidden(self): pass\n\n    async def go(self):\n        class B(A):\n            def run(self): return 1\n# end\n\n"
    return files.select("path", F.concat(F.lit(head), "content").alias("content"))


QUERIES = {
    "normalize_logs": query(lg.normalize_logs, "logs"),
    "failure_stage": query(lambda l: lg.failure_stage(l).select("run_id", "stage"), "logs"),
    "test_framework": query(lambda l: lg.test_framework(l).select("run_id", "framework"), "logs"),
    "matched_patterns": query(lambda l: lg.matched_patterns(l).select("run_id", F.array_join("stages", ",").alias("stages"), F.array_join("frameworks", ",").alias("frameworks")), "logs"),
    "parse_pytest_witness": query(lambda l: lg.parse_pytest_witness(l).withColumn("failed_tests", F.array_join("failed_tests", ",")), "logs"),
    "parse_go_witness": query(lambda l: lg.parse_go_witness(l).withColumn("failed_tests", F.array_join("failed_tests", ",")), "logs"),
    "parse_generic_witness": query(lg.parse_generic_witness, "logs"),
    "witness_quality": query(_quality, "logs"),
    "build_witnesses": query(lambda logs: wt.build_witnesses(logs).withColumn("stack_trace", F.array_join("stack_trace", "; ")), "logs"),
    "normalize_frames": query(_frames, "spans"),
    "error_tokens": query(lambda l: lg.error_tokens(l, ["AssertionError"]), "logs"),
    "stage_authority": query(_authority, "logs"),
    "diff_lines": query(lambda p: pt.diff_lines(p).drop("patch"), "patches"),
    "patch_stats": query(lambda p: pt.patch_stats(p).drop("patch"), "patches"),
    "classify_files": query(lambda s: pt.classify_files(s.select(F.explode(F.array(F.col("path"), F.concat(F.lit("tests/"), "path"), F.lit("Setup.py"), F.lit("a/test_b.py"))).alias("file")).distinct()), "spans"),
    "hunks": query(lambda p: pt.hunks(p).drop("patch"), "patches"),
    "patch_integrity": query(_submissions, "patches"),
    "patch_consistency": query(_other, "patches"),
    "same_hunk_shape": query(lambda s: pt.same_hunk_shape(s.select((F.col("instance_id") % 20).alias("run_id"), F.concat_ws(":", "path", "start_line").alias("file"))), "spans"),
    "code_lines": query(st.code_lines, "repo_files"),
    "code_search": query(lambda f: st.code_search(st.code_lines(f), _terms(f, "query", ["return g3", "def f1", "the of", "x"])), "repo_files"),
    "find_definitions": query(lambda f: st.find_definitions(st.code_lines(f), _terms(f, "target", ["f1", "f20", "f999", "g1"])), "repo_files"),
    "enclosing_definition": query(_sites, "spans"),
    "file_definition": query(lambda f: st.file_definition(f, _terms(f, "path", ["src1/f1.py", "src2/f2.py", "none.py"]), 50), "repo_files"),
    "find_callers": query(lambda f: st.find_callers(st.code_lines(f), _terms(f, "symbol", ["g3", "pkg.f102", "return", "f1000", "the.text"])), "repo_files"),
    "mark_already_seen": query(lambda s: st.mark_already_seen(_kind(s, "candidate"), _kind(s, "viewed")), "spans"),
    "edited_windows": query(lambda s: st.edited_windows(_kind(s, "final").select("instance_id", "path", F.col("start_line").alias("line")), 3, 5), "spans"),
    "widest_viewed": query(lambda s: st.widest_viewed(_kind(s, "viewed")), "spans"),
    "keyword_queries": query(lambda i: st.keyword_queries(i, _stop), "issues"),
    "expand_context": query(_candidates, "spans"),
    "enforce_budget": query(lambda s: st.enforce_budget(_candidates(s), 6, 4, 20, 5), "spans"),
    "symbol_index": query(st.symbol_index, "repo_files"),
    "class_index": query(lambda f: st.class_index(_classes(f)), "repo_files"),
    "sibling_methods": query(_sibling_methods, "spans"),
}

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_e = lambda p: p.replace("'", "''")
_has = lambda ps, c="log_text": "(" + " OR ".join(f"regexp_matches({c}, '{_e(p)}')" for p in ps) + ")"
_case = lambda rules, other: "CASE " + " ".join(f"WHEN {_has(ps)} THEN '{n}'" for n, ps in rules) + f" ELSE '{other}' END"
_names = lambda rules: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_has(ps)} THEN '{n}' END" for n, ps in rules) + "], lambda x: x IS NOT NULL), ',')"
_QUAL = """CASE WHEN NOT observed THEN 'none' WHEN stage <> 'validation_failure' THEN 'infrastructure_only' WHEN has_expected AND has_trace AND has_tests THEN 'high' WHEN has_trace OR has_tests THEN 'medium' WHEN has_witness THEN 'low' ELSE 'minimal' END"""
_UNEQUAL = lambda g: _STRIP.format(rf"regexp_extract(log_text, '(?:AssertionError|assert):?\s+(.*?)\s*!=\s*(.*)', {g})")
_LINES = "CASE WHEN ends_with(log_text, chr(10)) THEN string_split(log_text, chr(10))[:-2] ELSE string_split(log_text, chr(10)) END"
_SAID = f"substring({_STRIP.format(f"coalesce(list_filter({_LINES}, lambda x: regexp_matches(x, '{lg.ERROR_LINE}'))[1], ({_LINES})[-1], '')")}, 1, 500)"
_KIND = "CASE " + " ".join(f"WHEN contains(log_text, '{k}') THEN '{v}'" for k, v in lg.PYTHON_TYPES.items()) + " ELSE 'test_failure' END"
_PY = rf"""py AS (SELECT run_id, CASE WHEN len(a) > 0 THEN list_transform(range(1, len(a) + 1), lambda i: a[i] || '::' || b[i]) WHEN len(c) > 0 THEN list_transform(range(1, len(c) + 1), lambda i: c[i] || '::' || d[i]) ELSE e END AS failed_tests,
    n_frames, expected, actual, {_SAID} AS message, {_KIND} AS failure_type FROM (
  SELECT run_id, log_text, regexp_extract_all(log_text, '{lg.NODE}', 1) AS a, regexp_extract_all(log_text, '{lg.NODE}', 2) AS b, regexp_extract_all(log_text, '(\S+\.py)::(\S+)', 1) AS c, regexp_extract_all(log_text, '(\S+\.py)::(\S+)', 2) AS d,
    regexp_extract_all(log_text, '(?m)^FAIL:\s+(\S+)', 1) AS e, CAST(len(regexp_extract_all(log_text, '(?m)^\s*File\s+"[^"]+",\s+line\s+\d+')) AS INT) AS n_frames,
    nullif({_UNEQUAL(1)}, '') AS expected, nullif({_UNEQUAL(2)}, '') AS actual FROM {{}}))"""
_NORM = r"norm AS (SELECT run_id, regexp_replace(regexp_replace(log_text, '\x1B\[[0-9;]*[a-zA-Z]', '', 'g'), '\r\n?', chr(10), 'g') AS log_text FROM logs)"
_NONEMPTY = f"list_filter(list_transform(string_split({_STRIP.format('log_text')}, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '')"
_TAIL = f"substring(coalesce(list_filter(({_NONEMPTY})[-10:], lambda x: regexp_matches(lower(x), 'error|fail'))[-1], ({_NONEMPTY})[-1], 'test_failure'), 1, 500)"
_GENERIC = rf"substring(CASE WHEN len(regexp_extract_all(log_text, '{lg.FAIL_LINE}')) > 0 THEN array_to_string(list_transform(regexp_extract_all(log_text, '{lg.FAIL_LINE}')[1:5], lambda x: {_STRIP.format('x')}), chr(10)) ELSE {_STRIP.format(f"string_split({_STRIP.format('log_text')}, chr(10))[-1]")} END, 1, 2000)"
_DL = r"""raw AS (SELECT run_id, unnest(range(len(l))) AS pos, unnest(l) AS text FROM (SELECT run_id, string_split(patch_text, chr(10)) AS l FROM patches)),
dl AS (SELECT p.run_id, pos, regexp_extract(patch_text, 'b/(\S+)', 1) AS file, CASE WHEN pos >= 3 THEN 1 ELSE 0 END AS hunk,
  CASE pos WHEN 3 THEN 'hunk' WHEN 4 THEN 'context' WHEN 5 THEN 'removed' WHEN 6 THEN 'added' ELSE 'header' END AS kind, CASE pos WHEN 4 THEN s WHEN 5 THEN s + 1 END AS old_line, CASE pos WHEN 4 THEN s WHEN 6 THEN s + 1 END AS new_line, text
  FROM raw r JOIN (SELECT run_id, patch_text, CAST(regexp_extract(patch_text, '@@ -(\d+)', 1) AS INT) AS s FROM patches) p ON p.run_id = r.run_id)"""
_LN = r"ln AS (SELECT path, unnest(range(1, len(l) + 1)) AS ln, unnest(l) AS text FROM (SELECT path, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT path, string_split(content, chr(10)) AS l FROM repo_files)))"
_CAND = "cand AS (" + " UNION ALL ".join(f"SELECT DISTINCT instance_id, '{k}' AS source, {i} AS priority, path, start_line, end_line FROM spans WHERE kind = '{k}'" for i, k in enumerate(("final", "viewed", "candidate"))) + ")"

ORACLES = {
    "enforce_budget": oracle("spans", """e AS (SELECT instance_id, CASE kind WHEN 'final' THEN 0 WHEN 'viewed' THEN 1 ELSE 2 END AS priority, kind AS source, path, start_line, least(end_line, start_line + 5) AS end_line FROM (SELECT DISTINCT instance_id, kind, path, start_line, end_line FROM spans) WHERE kind <> 'gold'),
g AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY priority, path, start_line, end_line, source) AS i FROM e),
w AS (SELECT DISTINCT instance_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS files, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS lines, false AS take FROM g
UNION ALL SELECT instance_id, i, CASE WHEN room AND NOT list_contains(files, path) THEN list_append(files, path) ELSE files END, CASE WHEN room AND lines + size <= 20 THEN n + 1 ELSE n END, CASE WHEN room AND lines + size <= 20 THEN lines + size ELSE lines END, room AND lines + size <= 20
FROM (SELECT g.instance_id, g.i, g.path, g.end_line - g.start_line AS size, w.files, w.n, w.lines, w.n < 6 AND (list_contains(w.files, g.path) OR len(w.files) < 4) AS room FROM w JOIN g ON g.instance_id = w.instance_id AND g.i = w.i + 1))
SELECT g.instance_id, row_number() OVER (PARTITION BY g.instance_id ORDER BY g.i) - 1 AS rank, priority, path, start_line, end_line, source FROM w JOIN g ON g.instance_id = w.instance_id AND g.i = w.i WHERE take""").replace("WITH ", "WITH RECURSIVE ", 1),
    "class_index": oracle("repo_files", "SELECT path, kind, name, parent, CAST(a AS INT) AS start_line, CAST(b AS INT) AS end_line FROM repo_files, (VALUES ('class', 'A', NULL, 1, 19), ('function', 'A.run', 'A', 7, 12), ('async_function', 'A.go', 'A', 17, 19), ('class', 'B', NULL, 18, 19), ('function', 'B.run', 'B', 19, 19)) v(kind, name, parent, a, b)"),
    "normalize_logs": oracle("logs", f"{_NORM} SELECT * FROM norm"),
    "failure_stage": oracle("logs", f"SELECT run_id, {_case(lg.STAGES, 'unknown_failure')} AS stage FROM logs"),
    "test_framework": oracle("logs", f"SELECT run_id, {_case(lg.FRAMEWORKS, 'generic')} AS framework FROM logs"),
    "matched_patterns": oracle("logs", f"SELECT run_id, {_names(lg.STAGES)} AS stages, {_names(lg.FRAMEWORKS)} AS frameworks FROM logs"),
    "parse_pytest_witness": oracle("logs", f"{_PY.format('logs')} SELECT run_id, array_to_string(failed_tests, ',') AS failed_tests, n_frames, expected, actual, message, failure_type FROM py"),
    "parse_go_witness": oracle("logs", rf"""SELECT run_id, array_to_string(t, ',') AS failed_tests, CASE WHEN len(t) > 0 AND len(m) > 0 THEN m[1] ELSE 'test_failure' END AS message, CASE WHEN len(m) > 0 THEN regexp_extract(m[1], '{lg.GO_WANT}', 1) END AS expected,
  CASE WHEN len(m) > 0 THEN regexp_extract(m[1], '{lg.GO_WANT}', 2) END AS actual, 'test_failure' AS failure_type FROM (SELECT run_id, regexp_extract_all(log_text, '{lg.GO_TEST}', 1) AS t, regexp_extract_all(log_text, '{lg.GO_LINE}', 3) AS m FROM logs)"""),
    "parse_generic_witness": oracle("logs", rf"""SELECT run_id, substring(CASE WHEN len(m) > 0 THEN array_to_string(list_transform(m[1:5], lambda x: {_STRIP.format('x')}), chr(10)) ELSE {_STRIP.format('last')} END, 1, 2000) AS message,
  CASE WHEN c <> '' THEN 'exit_code_' || c ELSE 'test_failure' END AS failure_type
  FROM (SELECT run_id, regexp_extract_all(log_text, '{lg.FAIL_LINE}') AS m, string_split({_STRIP.format('log_text')}, chr(10))[-1] AS last, regexp_extract(log_text, '(?i)exit code[:\s]*(\d+)', 1) AS c FROM logs)"""),
    "witness_quality": oracle("logs", f"""w AS (SELECT run_id, run_id % 11 <> 0 AS observed, {_case(lg.STAGES, 'unknown_failure')} AS stage, run_id % 2 = 0 AS has_expected, run_id % 3 = 0 AS has_trace, run_id % 5 < 3 AS has_tests, run_id % 7 < 5 AS has_witness FROM logs)
SELECT *, {_QUAL} AS quality FROM w"""),
    "build_witnesses": oracle("logs", f"""{_NORM}, s AS (SELECT *, {_case(lg.STAGES, 'unknown_failure')} AS stage, {_case(lg.FRAMEWORKS, 'generic')} AS framework FROM norm),
p AS (SELECT *, CASE WHEN stage <> 'validation_failure' OR length({_STRIP.format('log_text')}) < 20 THEN 'stage_detector' {' '.join(f"WHEN framework = '{f}' OR {' OR '.join('(' + ' AND '.join(_has([x]) for x in ps) + ')' for ps in shapes)} THEN '{n}'" for n, (f, shapes) in wt.PARSERS.items())} ELSE 'generic' END AS parser FROM s),
{_PY.format('norm')}, w AS (SELECT p.run_id, stage, framework, parser, py.message AS said, py.failure_type AS kind, expected, actual, log_text, regexp_extract_all(log_text, '{lg.GO_LINE}', 3) AS g, py.failed_tests AS pt,
  string_split({_STRIP.format('log_text')}, chr(10)) AS l FROM p JOIN py USING (run_id)),
v AS (SELECT run_id, stage, framework, parser, true AS observed, parser <> 'stage_detector' AS has_witness, CASE parser WHEN 'pytest' THEN pt WHEN 'go' THEN regexp_extract_all(log_text, '{lg.GO_TEST}', 1) ELSE [] END AS t,
  CASE parser WHEN 'pytest' THEN expected IS NOT NULL AND actual IS NOT NULL WHEN 'go' THEN regexp_matches(g[1], '{lg.GO_WANT}') ELSE false END AS has_expected,
  CASE parser WHEN 'go' THEN 'File "x_test.go", line 42' ELSE '' END AS stack_trace,
  CASE parser WHEN 'pytest' THEN said WHEN 'stage_detector' THEN substring(CASE WHEN len(l) > 30 THEN array_to_string(l[1:20] || ['...'] || l[-10:], chr(10)) ELSE log_text END, 1, 2000) WHEN 'go' THEN substring(g[1], 1, 500)
    WHEN 'cargo' THEN 'Test run failed (' || regexp_extract(log_text, '{dl.CARGO_RESULT}', 1) || ' passed, ' || regexp_extract(log_text, '{dl.CARGO_RESULT}', 2) || ' failed)'
    WHEN 'cpp' THEN {_TAIL} ELSE {_GENERIC} END AS message,
  CASE parser WHEN 'pytest' THEN kind WHEN 'stage_detector' THEN CASE stage WHEN 'patch_apply_failure' THEN 'git_apply' WHEN 'dependency_or_environment_failure' THEN 'build_or_infra_failure' WHEN 'test_collection_failure' THEN 'collect_error'
    WHEN 'timeout' THEN 'timeout' WHEN 'validation_failure' THEN 'empty_log' ELSE 'unknown' END ELSE 'test_failure' END AS failure_type FROM w),
x AS (SELECT *, len(t) > 0 AS has_tests, stack_trace <> '' AS has_trace FROM v) SELECT run_id, stage, framework, parser, array_to_string(t, ',') AS failed_tests, message, failure_type, {_QUAL} AS quality, stack_trace FROM x"""),
    "normalize_frames": oracle("spans", """f AS (SELECT DISTINCT CASE start_line % 5 WHEN 0 THEN '/testbed/' WHEN 1 THEN '/usr/lib/' WHEN 2 THEN '' WHEN 3 THEN '/opt/site-packages/' ELSE 'tests/' END || path AS path FROM spans)
SELECT path, replace(path, '/testbed/', '') AS file, NOT starts_with(path, '/usr') AND NOT starts_with(path, '/opt') AS is_repo_frame, starts_with(path, 'tests/') AS is_test_file FROM f"""),
    "error_tokens": oracle("logs", r"""SELECT DISTINCT run_id, unnest(regexp_extract_all(log_text, '\b(\w+(?:Error|Exception|Warning))\b', 1) || regexp_extract_all(log_text, 'FAILED\s+\S+?::(\w+)', 1)) AS token FROM logs QUALIFY token <> 'AssertionError'""".replace("SELECT DISTINCT run_id, unnest", "SELECT DISTINCT run_id, token FROM (SELECT run_id, unnest").replace(" QUALIFY token <> 'AssertionError'", ") WHERE token <> 'AssertionError'")),
    "stage_authority": oracle("logs", f"""s AS (SELECT run_id, {_case(lg.STAGES, 'unknown_failure')} AS stage FROM logs)
SELECT run_id, stage, CASE WHEN run_id % 4 = 0 THEN stage WHEN run_id % 9 = 0 THEN 'patch_apply_failure' WHEN run_id % 10 = 0 THEN 'timeout' ELSE stage END AS ruled_stage FROM s"""),
    "diff_lines": oracle("patches", f"{_DL} SELECT * FROM dl"),
    "patch_stats": oracle("patches", "SELECT run_id, 1 AS files, 1 AS hunks, 1 AS added, 1 AS deleted, 2 AS changed, length(patch_text) AS chars, len(string_split(patch_text, chr(10))) AS lines FROM patches"),
    "classify_files": oracle("spans", """f AS (SELECT DISTINCT unnest([path, 'tests/' || path, 'Setup.py', 'a/test_b.py']) AS file FROM spans)
SELECT file, CASE WHEN starts_with(file, 'tests/') OR file = 'a/test_b.py' THEN 'test' WHEN file = 'Setup.py' THEN 'config' ELSE 'source' END AS kind FROM f"""),
    "hunks": oracle("patches", f"""{_DL} SELECT run_id, hunk, max(file) AS file, max(old_line) FILTER (pos = 4) AS old_start, max(new_line) FILTER (pos = 4) AS new_start, max(substring(text, 2)) FILTER (pos = 5) AS removed, max(substring(text, 2)) FILTER (pos = 6) AS added FROM dl WHERE hunk > 0 GROUP BY 1, 2"""),
    "patch_integrity": oracle("patches", "SELECT run_id, CASE WHEN run_id % 7 = 0 THEN 'not_submitted' WHEN run_id % 5 = 0 THEN 'empty_patch' WHEN run_id % 5 = 1 THEN 'not_a_diff' WHEN run_id % 5 = 2 THEN 'unsafe_path' ELSE 'ok' END AS verdict FROM patches"),
    "patch_consistency": oracle("patches", "SELECT run_id, CASE run_id % 3 WHEN 0 THEN 'consistent' WHEN 1 THEN 'empty' ELSE 'mismatch' END AS state FROM patches"),
    "same_hunk_shape": oracle("spans", """f AS (SELECT instance_id % 20 AS run_id, path || ':' || start_line AS file, count(*) AS hunks FROM spans GROUP BY 1, 2) SELECT run_id, hunks, count(*) AS n_files FROM f GROUP BY 1, 2 HAVING count(*) >= 3"""),
    "code_lines": oracle("repo_files", f"{_LN} SELECT * FROM ln"),
    "code_search": oracle("repo_files", f"""{_LN}, h AS (SELECT q AS query, path, ln, row_number() OVER (PARTITION BY q ORDER BY path, ln) AS r FROM ln, (VALUES ('return g3'), ('def f1'), ('the of')) v(q) WHERE contains(text, q))
SELECT query, path, ln, greatest(ln - 20, 1) AS start_line, ln + 20 AS end_line FROM h WHERE r <= 5"""),
    "find_definitions": oracle("repo_files", r"SELECT 'f' || n AS target, path, 1 AS ln FROM (SELECT path, CAST(regexp_extract(path, 'f(\d+)\.py', 1) AS INT) AS n FROM repo_files) WHERE n IN (1, 20, 999)"),
    "enclosing_definition": oracle("spans", """sy AS (SELECT DISTINCT path, 's' || (start_line % 30) AS name, start_line, end_line FROM spans WHERE kind = 'gold'),
si AS (SELECT DISTINCT path, end_line AS ln, path || ':' || end_line AS site_id FROM spans WHERE kind = 'viewed'),
b AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY end_line - start_line, start_line, name) AS r FROM si JOIN sy USING (path) WHERE ln BETWEEN start_line AND end_line)
SELECT site_id, si.path, b.name, coalesce(b.start_line, greatest(si.ln - 5, 1)) AS start_line, coalesce(b.end_line, si.ln + 5) AS end_line FROM si LEFT JOIN (SELECT * FROM b WHERE r = 1) b USING (site_id)"""),
    "file_definition": oracle("repo_files", "SELECT path, substring(content, 1, 50) AS head, length(content) AS chars FROM repo_files WHERE path IN ('src1/f1.py', 'src2/f2.py')"),
    "find_callers": oracle("repo_files", rf"""{_LN}, h AS (SELECT path, ln, s AS symbol, CASE WHEN regexp_matches(text, '@|register') THEN 0.85 WHEN regexp_matches(text, '(def|class) ') THEN 0.75 WHEN contains(text, w || '(') THEN 0.7 ELSE 0.6 END AS score
  FROM ln, (VALUES ('pkg.f102', 'f102'), ('return', 'return'), ('f1000', 'f1000'), ('the.text', 'text')) v(s, w) WHERE regexp_matches(text, '(^|[^A-Za-z0-9_])' || w || '($|[^A-Za-z0-9_])')),
f AS (SELECT *, row_number() OVER (PARTITION BY symbol, path ORDER BY score DESC, ln) AS k FROM h), g AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, path) AS r FROM f WHERE k = 1)
SELECT symbol, path, ln, CAST(score AS DOUBLE) AS score FROM g WHERE r <= 5"""),
    "mark_already_seen": oracle("spans", """c AS (SELECT DISTINCT instance_id, path, start_line, end_line FROM spans WHERE kind = 'candidate')
SELECT *, EXISTS (SELECT 1 FROM spans v WHERE v.kind = 'viewed' AND v.instance_id = c.instance_id AND v.path = c.path AND c.start_line <= v.end_line + 10 AND v.start_line <= c.end_line + 10) AS seen FROM c"""),
    "edited_windows": oracle("spans", """e AS (SELECT DISTINCT instance_id, path, start_line AS line FROM spans WHERE kind = 'final'), b AS (SELECT *, CASE WHEN line - lag(line) OVER w <= 3 THEN 0 ELSE 1 END AS n FROM e WINDOW w AS (PARTITION BY instance_id, path ORDER BY line)),
i AS (SELECT *, sum(n) OVER (PARTITION BY instance_id, path ORDER BY line) AS k FROM b) SELECT instance_id, path, greatest(min(line) - 5, 1) AS start_line, max(line) + 5 AS end_line FROM i GROUP BY instance_id, path, k"""),
    "widest_viewed": oracle("spans", """v AS (SELECT DISTINCT instance_id, path, start_line, end_line FROM spans WHERE kind = 'viewed'), w AS (SELECT *, row_number() OVER (PARTITION BY instance_id, path ORDER BY end_line - start_line DESC, start_line) AS k, CAST(sum(end_line - start_line + 1) OVER (PARTITION BY instance_id, path) AS BIGINT) AS n_lines FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY n_lines DESC, path) AS r FROM w WHERE k = 1) SELECT instance_id, path, n_lines, start_line, end_line FROM r WHERE r <= 3"""),
    "keyword_queries": oracle("issues", r"""w AS (SELECT instance_id, regexp_extract_all(issue, '[A-Za-z_][A-Za-z0-9_]{3,}') AS w FROM issues),
d AS (SELECT instance_id, list_filter(w, lambda x, i: list_position(w, x) = i AND x NOT IN ('that', 'this', 'with', 'from'))[1:8] AS q FROM w)
SELECT instance_id, unnest(range(len(q))) AS rank, unnest(q) AS query FROM d"""),
    "expand_context": oracle("spans", f"{_CAND} SELECT * FROM cand"),
    "symbol_index": oracle("repo_files", rf"{_LN} SELECT path, regexp_extract(path, '(f\d+)\.py', 1) AS name, 'def' AS kind, 1 AS start_line, 2 AS end_line FROM ln WHERE ln = 1"),
    "sibling_methods": oracle("spans", """s AS (SELECT DISTINCT path, CASE WHEN start_line % 4 = 0 THEN 'Out.' ELSE '' END || 'C' || (start_line % 5) || '.s' || (start_line % 9) AS name, 'C' || (start_line % 5) AS parent, 's' || (start_line % 9) AS method FROM spans),
h AS (SELECT DISTINCT name AS hint, method, parent AS class FROM s WHERE NOT starts_with(name, 'Out.')), p AS (SELECT hint, name, path, parent = class AS own, row_number() OVER (PARTITION BY hint ORDER BY parent <> class, path, name) AS rank FROM h JOIN s USING (method) WHERE name <> hint)
SELECT hint, name, path, CAST(CASE WHEN own THEN 0.70 ELSE 0.85 END AS DOUBLE) AS score, rank FROM p WHERE rank <= 3"""),
}
