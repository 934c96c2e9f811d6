"""Queries over selections, guards, rules and plans, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from repairlens.operators import guards as gd
from repairlens.operators import planning as pl
from repairlens.operators import selection as sl
from repairlens.plans.fixtures import oracle, query

PATTERNS = [("(?i)erinst", 3, "erinst"), ("(?i)\\bthe\\b", 2, "the"), ("%%%|###", -4, "signs"), ("!!", -2, "shouting")]
REPOS = {"src0": 5, "src1": 3, "src2": 2}
_score = lambda i: sl.keyword_score(i, PATTERNS, REPOS, "(?i)token")
_s = lambda c, m: (F.col(c) % m).cast("string")


def _registry(part, orders):
    manifest = part.select(F.col("p_partkey").alias("instance_id"), "p_brand")
    bench = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("instance_id"), F.concat(F.lit('["t'), F.col("p_size").cast("string"), F.lit('","u"]')).alias("fail_to_pass"))
    canonical = orders.select(F.col("o_custkey").alias("instance_id"), F.lit(True).alias("known")).distinct()
    out = sl.instance_registry(manifest, bench, canonical)
    return out.select("instance_id", "p_brand", F.array_join("fail_to_pass", ",").alias("tests"), F.coalesce("known", F.lit(False)).alias("known"))


def _manifest(records):
    return sl.build_manifest(records.select("instance_id", "ord", "priority", F.concat(F.lit("p"), F.col("priority").cast("string")).alias("source"), F.expr("CASE WHEN resolved THEN 'solved' WHEN NOT resolved THEN 'failed' ELSE 'open' END").alias("status")))


def _categories(i):
    return sl.category_sample(_score(i), [("long", F.col("score") > 6, 20), ("plain", F.col("labels") == "", 15), ("any", F.lit(True), 30)])


def _aliases(part):
    pool = part.select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("dir-"), F.lower(F.hex(F.col("p_partkey") * 99991)))).otherwise("").alias("dir_name"), F.lit(None).cast("string").alias("canonical_id"), F.concat(F.lit("i-"), F.col("p_partkey").cast("string")).alias("instance_id"))
    return sl.resolve_aliases(part.select(F.concat(F.lit("i-"), (F.col("p_partkey") + 5).cast("string")).alias("id")), pool)


def _policy(part):
    k = F.col("p_partkey")
    return sl.retry_policy(part.select(k.alias("instance_id"), (k % 3 == 0).alias("raw_retry"), (k % 2 == 0).alias("override")), part.where("p_partkey % 5 <> 0").select(k.alias("instance_id"), (k % 7 < 4).alias("eligible")))


def _predictions(orders):
    return sl.build_predictions(orders.select(F.col("o_orderkey").alias("instance_id"), F.concat(F.lit("v"), _s("o_custkey", 3), F.lit("_x")).alias("batch"), F.concat(F.lit("/r/bench"), _s("o_orderkey", 4), F.lit("/a.json")).alias("path"), F.when(F.col("o_orderkey") % 4 == 0, " ").otherwise("diff").alias("submission")))


def _artifacts(orders):
    runs = orders.select(F.col("o_orderkey").alias("run_id"), "o_orderstatus")
    files = orders.select(F.col("o_orderkey").alias("run_id"), F.explode(F.expr("CASE o_orderkey % 3 WHEN 0 THEN array('patch', 'log') WHEN 1 THEN array('log') ELSE array('report', 'patch') END")).alias("name"))
    return gd.required_artifacts(runs, files, [("log", "true"), ("patch", "true"), ("report", "o_orderstatus = 'F'")])


def _names(part):
    c = F.concat(F.lit("org/p"), _s("p_partkey", 300))
    return gd.name_audit(part.select(c.alias("canonical"), F.when(F.col("p_partkey") % 4 == 0, F.concat(c, F.lit(".json"))).otherwise(F.concat(F.replace(c, F.lit("/"), F.lit("__")), F.lit(".json"))).alias("name")))


def _nested(orders):
    body = F.concat(F.lit('{"a": [{"gold": 1}, {"b": {"gold": 2}}], "free": {"gold": 3}, "n": '), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise("}"))
    return gd.nested_key_leaks(orders.select(F.col("o_orderkey").alias("id"), body.alias("body")), ["gold"], ["free"])


def _diagnosis(failures):
    """Over every failure, each a run of its own: all 20 runs of the fixture would get the same findings."""
    return pl.rule_diagnosis(failures.select(F.col("ord").alias("run_id"), F.col("exception_type").alias("error_type"), "error_message", (F.col("ord") % 3 == 0).alias("edits_elsewhere")))


def _contracts(orders):
    k = F.col("o_orderkey")
    return pl.allocate_plan(orders.select(F.col("o_custkey").alias("run_id"), k.alias("ord"), F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END").alias("confidence"), ((k % 10) / 10).alias("uncertainty"), (k % 4).alias("n_clusters"), (k % 3 + 1).alias("n_actions"), (k % 9 + 1).alias("budget")))


def _outcomes(orders):
    k = F.col("o_orderkey")
    return pl.test_outcomes(orders.select(k.alias("run_id"), (k % 5 == 0).alias("resolved"), (k % 7 != 0).alias("applied"), (k % 4).alias("f2p_passed"), F.lit(3).alias("f2p_total"), (k % 2).alias("p2p_failed")))


def _episodes(orders):
    k = F.col("o_orderkey")
    evals = orders.select(k.alias("run_id"), F.expr("CASE o_orderkey % 6 WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'TIMEOUT' WHEN 3 THEN 'ODD' ELSE 'UNRESOLVED' END").alias("harness"), (k % 5).alias("log_size"))
    return pl.episode_eligibility(evals, orders.where("o_orderkey % 8 <> 0").select(k.alias("run_id"), (k % 3).alias("n_tests"), F.when(k % 2 == 0, "").otherwise("No test log").alias("message"), (k % 4).alias("n_frames")))


def _pairs(messages):
    return pl.pair_test_runs(messages.where("role = 'assistant'").select("run_id", "step"), messages.where("role = 'tool' OR step = 2").select("run_id", "step"))


def _calls(events):
    e = F.col("event_id")
    return pl.tool_events(events.select(F.col("user_id").alias("run_id"), (e % 5).alias("turn"), F.when(e % 3 == 0, F.concat(F.lit("c"), (e % 40).cast("string"))).alias("call_id"), F.col("event_type").alias("name"), (e % 2).cast("string").alias("arguments")))


_runs = lambda o: o.select("o_custkey", "o_orderkey")
_leaks = ["erinst", "the", "gold_patch"]

QUERIES = {
    "instance_registry": query(_registry, "part", "orders"),
    "build_manifest": query(_manifest, "eval_records"),
    "latest_per_key": query(sl.latest_per_key, "predictions"),
    "best_by_priority": query(lambda p: sl.best_by_priority(p, ["batch3", "batch1"]), "predictions"),
    "predictions_diff": query(lambda p, e: sl.predictions_diff(p, e.where("resolved")), "predictions", "eval_records"),
    "keyword_score": query(_score, "issues"),
    "quota_sample": query(lambda i: sl.quota_sample(_score(i), "src0", 8, ["src1", "src2", "src3"], 4, 40), "issues"),
    "category_sample": query(_categories, "issues"),
    "resolve_aliases": query(_aliases, "part"),
    "retry_policy": query(_policy, "part"),
    "build_predictions": query(_predictions, "orders"),
    "keyword_leaks": query(lambda i: gd.keyword_leaks(i.select(F.col("instance_id").alias("id"), F.lower("issue").alias("text")), _leaks), "issues"),
    "nested_key_leaks": query(_nested, "orders"),
    "required_artifacts": query(_artifacts, "orders"),
    "name_audit": query(_names, "part"),
    "runtime_view": query(lambda i: gd.runtime_view(i, ["quality", "toxic"]), "issues"),
    "oracle_view": query(lambda i: gd.oracle_view(i, ["instance_id"], ["quality", "toxic"]), "issues"),
    "hidden_source_check": query(lambda s: gd.hidden_source_check(s.select(F.col("kind").alias("source"), "path").distinct(), ["viewed", "final"], ["gold"]), "spans"),
    "tool_loop_check": query(gd.tool_loop_check, "messages"),
    "retry_trigger": query(lambda f: pl.decision_list(f, [("HARD_FAILURE", "bash_commands % 10 = 0"), ("VALIDATION_FAILURE", "test_commands > 4"), ("PATCH_SHAPE", "files_edited > 4"), ("EVIDENCE_MISMATCH", "files_visited < files_edited")], "trigger", "NO_TRIGGER"), "features"),
    "rule_diagnosis": query(_diagnosis, "failures"),
    "diagnosis_plan": query(lambda f: pl.diagnosis_plan(_diagnosis(f)), "failures"),
    "hypotheses": query(lambda f: pl.hypotheses(_diagnosis(f)), "failures"),
    "rule_diagnosis_whole": query(_diagnosis, "failures"),
    "diagnosis_plan_whole": query(lambda f: pl.diagnosis_plan(_diagnosis(f)), "failures"),
    "hypotheses_whole": query(lambda f: pl.hypotheses(_diagnosis(f)), "failures"),
    "evidence_ledger": query(lambda f: pl.evidence_ledger(f.select("run_id", "ord", F.col("exception_type").alias("source"), F.col("root_frame").alias("location")), {"TypeError": 5, "ImportError": 3}), "failures"),
    "evidence_conflicts": query(lambda s: pl.evidence_conflicts(s.select(F.concat("path", F.col("start_line").cast("string")).alias("evidence_id"), F.col("instance_id").alias("run_id"), F.col("kind").alias("source"), F.col("path").alias("location"))), "spans"),
    "allocate_plan": query(_contracts, "orders"),
    "plan_counts": query(lambda o: pl.plan_counts(_contracts(o)), "orders"),
    "router_report": query(lambda o: pl.router_report(o.select(F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 9).alias("hits")), 6), "orders"),
    "episode_eligibility": query(_episodes, "orders"),
    "test_outcomes": query(_outcomes, "orders"),
    "gold_audit": query(lambda s: pl.gold_audit(s.where("kind = 'viewed'").select("instance_id", "path", F.col("start_line").alias("step")), s.where("kind = 'gold'").select("instance_id", F.concat(F.lit("x/"), "path").alias("path"))), "spans"),
    "compile_reports": query(lambda p: pl.compile_reports(p.select("batch", (F.col("ord") % 3 == 0).alias("resolved"), F.expr("CASE WHEN ord % 2 = 0 THEN array('a', 'b') ELSE array() END").alias("failed_tests"))), "predictions"),
    "error_visit_alignment": query(lambda f, s: pl.error_visit_alignment(f.select("run_id", F.substring_index("root_frame", ":", 1).alias("file"), (F.col("ord") % 2 == 0).alias("is_test")), s.where("kind = 'viewed'").select(F.col("instance_id").alias("run_id"), F.col("path").alias("file"))), "failures", "spans"),
    "pair_test_runs": query(_pairs, "messages"),
    "tool_events": query(_calls, "events"),
    "run_cost": query(lambda m: pl.run_cost(m.withColumn("ts", F.col("step") * 10 + F.col("run_id") % 7)), "messages"),
    "submission_of": query(lambda p: pl.submission_of(p.select(F.col("instance_id").alias("run_id"), F.col("ord").alias("priority"), F.col("batch").alias("source"), F.when(F.col("ord") % 3 == 0, "").otherwise(F.concat(F.lit("d"), (F.col("ord") % 2).cast("string"))).alias("patch"))), "predictions"),
}

_SCORED = f"""sc AS (SELECT instance_id, repo, CAST(CASE repo {' '.join(f"WHEN '{k}' THEN {v}" for k, v in REPOS.items())} ELSE 1 END + {' + '.join(f"CASE WHEN regexp_matches(coalesce(issue, ''), '{p}') THEN {w} ELSE 0 END" for p, w, _ in PATTERNS)} AS INT) AS score,
  array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(coalesce(issue, ''), '{p}') THEN '{n}' END" for p, _, n in PATTERNS)}], lambda x: x IS NOT NULL), ',') AS labels FROM issues WHERE NOT regexp_matches(coalesce(issue, ''), '(?i)token'))"""
_DIAG = """sg AS (SELECT DISTINCT ord AS run_id, exception_type AS t, error_message AS m, ord % 3 = 0 AS e FROM failures),
f AS (SELECT run_id, 2 AS rule, 'DEPENDENCY' AS type, 'high' AS confidence FROM sg WHERE t = 'ImportError' UNION SELECT run_id, 4, 'RELATED_TESTS', 'medium' FROM sg WHERE t = 'AssertionError' UNION SELECT run_id, 5, 'LOCALIZATION_DIRECTION', 'medium' FROM sg WHERE e
  UNION SELECT run_id, 9, 'NO_RELIABLE_DEFICIENCY', 'low' FROM sg WHERE t NOT IN ('ImportError', 'AssertionError') AND NOT e),
dg AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, rule) - 1 AS rank, type, confidence FROM f)"""

_PLAN = """c AS (SELECT o_custkey AS run_id, o_orderkey AS ord, o_orderkey % 3 + 1 AS na, o_orderkey % 9 + 1 AS nb, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3, (o_orderkey % 10) / 10, -(o_orderkey % 4), o_orderkey) AS i FROM orders),
w AS (SELECT DISTINCT o_custkey AS run_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS VARCHAR) AS reason FROM orders
UNION ALL SELECT c.run_id, c.i, CASE WHEN a + na <= 8 AND b + nb <= 40 THEN a + na ELSE a END, CASE WHEN a + na <= 8 AND b + nb <= 40 THEN b + nb ELSE b END, c.ord, CASE WHEN a + na > 8 THEN 'exceeds plan-level action budget' WHEN b + nb > 40 THEN 'exceeds plan-level result budget' END
FROM w JOIN c ON c.run_id = w.run_id AND c.i = w.i + 1)"""
ORACLES = {
    "allocate_plan": f"WITH RECURSIVE {_PLAN} SELECT run_id, ord, reason IS NULL AS accepted, reason FROM w WHERE i > 0",
    "plan_counts": f"WITH RECURSIVE {_PLAN} SELECT run_id, count(*) FILTER (reason IS NULL) AS actionable, count(*) FILTER (reason IS NOT NULL) AS abstained FROM w WHERE i > 0 GROUP BY 1",
    "pair_test_runs": oracle("messages", """e AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step, cmd) AS i FROM (SELECT DISTINCT run_id, step, false AS cmd FROM messages WHERE role = 'tool' OR step = 2 UNION ALL SELECT DISTINCT run_id, step, true FROM messages WHERE role = 'assistant')),
w AS (SELECT DISTINCT run_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS free, CAST(NULL AS BIGINT) AS out_step, CAST(NULL AS BIGINT) AS test_step FROM e
UNION ALL SELECT e.run_id, e.i, CASE WHEN cmd THEN list_append(free, step) WHEN len(free) > 0 AND free[-1] >= step - 4 THEN free[:len(free) - 1] ELSE free END, CASE WHEN NOT cmd AND len(free) > 0 AND free[-1] >= step - 4 THEN step END, CASE WHEN NOT cmd AND len(free) > 0 AND free[-1] >= step - 4 THEN free[-1] END
FROM w JOIN e ON e.run_id = w.run_id AND e.i = w.i + 1) SELECT run_id, out_step, test_step FROM w WHERE out_step IS NOT NULL""").replace("WITH ", "WITH RECURSIVE ", 1),
    "instance_registry": """SELECT p_partkey AS instance_id, p_brand, 't' || p_size || ',u' AS tests, p_partkey IN (SELECT o_custkey FROM orders) AS known FROM part WHERE p_partkey % 3 <> 0""",
    "build_manifest": oracle("eval_records", """r AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY priority, ord) AS r, count(*) OVER (PARTITION BY instance_id) AS n_sources FROM eval_records)
SELECT instance_id, 'p' || priority AS source, CASE WHEN resolved THEN 'solved' WHEN NOT resolved THEN 'failed' ELSE 'open' END AS status, n_sources FROM r WHERE r = 1"""),
    "latest_per_key": oracle("predictions", "SELECT * FROM predictions QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY mtime DESC, ord) = 1"),
    "best_by_priority": oracle("predictions", "SELECT * FROM predictions QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY CASE batch WHEN 'batch3' THEN 1 WHEN 'batch1' THEN 2 ELSE 3 END, batch, ord) = 1"),
    "predictions_diff": oracle("predictions eval_records", """SELECT batch, count(*) AS n, count(*) FILTER (d) AS n_evaluated, count(*) FILTER (NOT d) AS n_open FROM (SELECT batch, instance_id IN (SELECT instance_id FROM eval_records WHERE resolved) AS d FROM predictions) GROUP BY 1"""),
    "keyword_score": oracle("issues", f"{_SCORED} SELECT * FROM sc"),
    "quota_sample": oracle("issues", f"""{_SCORED}, a AS (SELECT *, 1 AS phase FROM sc WHERE repo = 'src0' ORDER BY score DESC, instance_id LIMIT 8),
b AS (SELECT *, 2 AS phase FROM sc WHERE repo IN ('src1', 'src2', 'src3') QUALIFY row_number() OVER (PARTITION BY repo ORDER BY score DESC, instance_id) <= 4), t AS (SELECT * FROM a UNION ALL SELECT * FROM b),
c AS (SELECT *, 3 AS phase FROM sc WHERE repo <> 'src0' AND instance_id NOT IN (SELECT instance_id FROM t) ORDER BY score DESC, instance_id LIMIT 20) SELECT * FROM t UNION ALL SELECT * FROM c"""),
    "category_sample": oracle("issues", f"""{_SCORED}, a AS (SELECT instance_id, score, 'long' AS category FROM sc WHERE score > 6 ORDER BY score DESC, instance_id LIMIT 20),
b AS (SELECT instance_id, score, 'plain' AS category FROM sc WHERE labels = '' AND instance_id NOT IN (SELECT instance_id FROM a) ORDER BY score DESC, instance_id LIMIT 15), t AS (SELECT * FROM a UNION ALL SELECT * FROM b),
c AS (SELECT instance_id, score, 'any' AS category FROM sc WHERE instance_id NOT IN (SELECT instance_id FROM t) ORDER BY score DESC, instance_id LIMIT 30) SELECT * FROM t UNION ALL SELECT * FROM c"""),
    "resolve_aliases": """WITH p AS (SELECT 'i-' || p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'dir-' || lower(to_hex(p_partkey * 99991)) ELSE 'i-' || p_partkey END AS canonical FROM part)
SELECT 'i-' || (p_partkey + 5) AS id, canonical, regexp_full_match(string_split(canonical, '-')[-1], '[0-9a-f]{7,12}') AS short_hash FROM part LEFT JOIN p ON p.id = 'i-' || (p_partkey + 5)""",
    "retry_policy": """WITH d AS (SELECT p_partkey AS k, p_partkey % 5 <> 0 AS i, p_partkey % 5 <> 0 AND p_partkey % 7 < 4 AS e, p_partkey % 3 = 0 AS r, p_partkey % 2 = 0 AS o FROM part)
SELECT k AS instance_id, r OR (o AND e) AS effective, o AND e AND NOT r AS overridden, CASE WHEN o AND NOT i THEN 'not_in_pool' WHEN o AND NOT e THEN 'not_eligible' END AS reason FROM d""",
    "build_predictions": "SELECT o_orderkey AS instance_id, 'v' || (o_custkey % 3) AS label, 'bench' || (o_orderkey % 4) AS bench FROM orders WHERE o_orderkey % 4 <> 0",
    "keyword_leaks": oracle("issues", """SELECT instance_id AS id, k AS keyword FROM issues, (VALUES ('erinst'), ('the'), ('gold_patch')) v(k) WHERE regexp_matches(lower(issue), '(^|[^a-z_])' || k || '($|[^a-z_])')"""),
    "nested_key_leaks": "SELECT o_orderkey AS id, unnest(['a[0].gold', 'a[1].b.gold']) AS path, 'gold' AS key, NULL::VARCHAR AS problem FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, '', NULL, 'no_json' FROM orders WHERE o_orderkey % 5 = 0",
    "required_artifacts": """WITH r AS (SELECT o_orderkey AS run_id, o_orderstatus = 'F' AS f, o_orderkey % 3 AS k FROM orders), m AS (SELECT run_id, CASE WHEN f THEN 3 ELSE 2 END AS n_required, CASE WHEN k = 0 AND f THEN 'report' WHEN k = 0 THEN '' WHEN k = 1 AND f THEN 'patch,report' WHEN k = 1 THEN 'patch' ELSE 'log' END AS missing FROM r)
SELECT *, CASE WHEN missing <> '' THEN 'missing_artifacts' ELSE 'ok' END AS status FROM m""",
    "name_audit": """WITH f AS (SELECT 'org/p' || (p_partkey % 300) AS canonical, p_partkey % 4 = 0 AS odd FROM part) SELECT canonical, count(*) AS n_files, count(*) FILTER (odd) AS renames, count(DISTINCT odd) = count(*) AS unique FROM f GROUP BY 1""",
    "runtime_view": oracle("issues", "SELECT instance_id, issue, repo FROM issues"),
    "oracle_view": oracle("issues", "SELECT instance_id, quality, toxic FROM issues"),
    "hidden_source_check": oracle("spans", "SELECT DISTINCT kind AS source, path, CASE kind WHEN 'gold' THEN 'forbidden' WHEN 'candidate' THEN 'unknown' ELSE 'allowed' END AS verdict FROM spans"),
    "tool_loop_check": oracle("messages", """SELECT run_id, count(*) FILTER (role = 'assistant') AS n_calls, bool_or(contains(content, '```bash')) AS ran_shell, false AS wrote_files, false AS bare_diff, count(*) FILTER (role = 'assistant') > 0 AS valid FROM messages GROUP BY 1"""),
    "retry_trigger": oracle("features", """h AS (SELECT *, list_filter([CASE WHEN bash_commands % 10 = 0 THEN 'HARD_FAILURE' END, CASE WHEN test_commands > 4 THEN 'VALIDATION_FAILURE' END, CASE WHEN files_edited > 4 THEN 'PATCH_SHAPE' END, CASE WHEN files_visited < files_edited THEN 'EVIDENCE_MISMATCH' END], lambda x: x IS NOT NULL) AS h FROM features)
SELECT * EXCLUDE h, coalesce(h[1], 'NO_TRIGGER') AS trigger, array_to_string(h[2:], ',') AS alternatives FROM h"""),
    "rule_diagnosis": oracle("failures", f"{_DIAG} SELECT * FROM dg"),
    "diagnosis_plan": oracle("failures", f"{_DIAG} SELECT run_id, min_by(type, rank) AS primary, count(*) AS n, string_agg(type, '; ' ORDER BY rank) FILTER (rank < 3) AS summary FROM dg GROUP BY 1"),
    "hypotheses": oracle("failures", f"{_DIAG} SELECT run_id, 'H' || substring(sha256(run_id || '|' || type || '|' || confidence), 1, 10) AS hypothesis_id, type, confidence, CAST(CASE confidence WHEN 'high' THEN 0.2 WHEN 'medium' THEN 0.5 ELSE 0.8 END AS DOUBLE) AS uncertainty FROM dg"),
    "evidence_ledger": oracle("failures", """k AS (SELECT *, row_number() OVER (PARTITION BY run_id, exception_type ORDER BY ord) AS r FROM failures WHERE exception_type IN ('TypeError', 'ImportError'))
SELECT DISTINCT 'E' || substring(sha256(run_id || '|' || exception_type || '|' || root_frame), 1, 10) AS evidence_id, run_id, exception_type AS source, root_frame AS location FROM k WHERE r <= CASE exception_type WHEN 'TypeError' THEN 5 ELSE 3 END"""),
    "evidence_conflicts": oracle("spans", "SELECT path || start_line AS evidence_id, count(DISTINCT (instance_id, kind, path)) AS n FROM spans GROUP BY 1 HAVING count(DISTINCT (instance_id, kind, path)) > 1"),
    "router_report": "SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(o_orderkey % 9) AS BIGINT) AS hits, count(*) FILTER (o_orderkey % 9 > 6) AS over_budget FROM orders GROUP BY 1",
    "episode_eligibility": """WITH e AS (SELECT o_orderkey AS k, o_orderkey % 6 AS h, o_orderkey % 8 <> 0 AND (o_orderkey % 3 > 0 OR o_orderkey % 4 > 0) AS valid FROM orders), s AS (SELECT k AS run_id, CASE WHEN h = 0 THEN 'r1_resolved' WHEN h = 1 THEN 'ineligible_harness_error' WHEN h = 2 THEN 'ineligible_harness_timeout'
  WHEN h = 3 THEN 'ineligible_harness_unknown' WHEN k % 5 = 0 THEN 'ineligible_missing_test_log' WHEN NOT valid THEN 'ineligible_empty_witness' ELSE 'eligible' END AS status FROM e) SELECT *, status IN ('r1_resolved', 'eligible') AS ok FROM s""",
    "test_outcomes": """WITH r AS (SELECT o_orderkey AS run_id, o_orderkey % 5 = 0 AS resolved, o_orderkey % 7 <> 0 AS applied, o_orderkey % 4 AS f2p_passed, 3 AS f2p_total, o_orderkey % 2 AS p2p_failed FROM orders)
SELECT *, CASE WHEN resolved THEN 'resolved' WHEN NOT applied THEN 'patch_apply_failed' WHEN f2p_passed < 3 AND p2p_failed = 0 THEN 'f2p_incomplete_no_regression' WHEN f2p_passed = 3 AND p2p_failed > 0 THEN 'f2p_pass_p2p_regression' ELSE 'other_unresolved' END AS outcome FROM r""",
    "gold_audit": oracle("spans", """g AS (SELECT DISTINCT instance_id, path FROM spans WHERE kind = 'gold'), v AS (SELECT instance_id, path, min(start_line) AS s FROM spans WHERE kind = 'viewed' GROUP BY 1, 2)
SELECT instance_id, count(*) AS n_gold, count(s) AS n_seen, min(s) AS first_step FROM g LEFT JOIN v USING (instance_id, path) GROUP BY 1"""),
    "compile_reports": oracle("predictions", "SELECT batch, count(*) AS n, count(*) FILTER (ord % 3 = 0) AS resolved, 2 * count(*) FILTER (ord % 2 = 0) AS failing FROM predictions GROUP BY 1"),
    "error_visit_alignment": oracle("failures spans", """f AS (SELECT run_id, split_part(root_frame, ':', 1) AS file, ord % 2 = 0 AS t FROM failures), x AS (SELECT f.*, EXISTS (SELECT 1 FROM spans s WHERE s.kind = 'viewed' AND s.instance_id = f.run_id AND s.path = f.file) AS seen FROM f)
SELECT run_id, CASE WHEN bool_or(seen AND NOT t) THEN 'visited_error_file' WHEN bool_or(seen AND t) THEN 'visited_stack_frame' ELSE 'visited_none' END AS alignment FROM x GROUP BY 1"""),
    "tool_events": """WITH e AS (SELECT user_id AS run_id, CASE WHEN event_id % 3 = 0 THEN 'c' || (event_id % 40) ELSE concat_ws('|', event_id % 5, event_type, event_id % 2) END AS k, event_id % 5 AS turn, event_type AS name FROM events),
f AS (SELECT run_id, k, min_by(name, (turn, name)) AS name FROM e GROUP BY 1, 2) SELECT run_id, name, count(*) AS n FROM f GROUP BY 1, 2""",
    "run_cost": oracle("messages", "SELECT run_id, count(*) FILTER (role = 'assistant') AS n_calls, min(step * 10 + run_id % 7) AS first_ts, max(step * 10 + run_id % 7) AS last_ts FROM messages GROUP BY 1"),
    "submission_of": oracle("predictions", "SELECT instance_id AS run_id, min_by(batch, ord) AS source, count(DISTINCT ord % 2) = 1 AS consistent FROM predictions WHERE ord % 3 <> 0 GROUP BY 1"),
}

for _name in ("rule_diagnosis", "diagnosis_plan", "hypotheses"):  # earlier names of the same queries
    ORACLES[f"{_name}_whole"] = ORACLES[_name]
