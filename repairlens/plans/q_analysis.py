"""Queries over failures, spans and evaluation records, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from repairlens.functions.joins import join_list
from repairlens.operators import evaluation as ev
from repairlens.operators import failures as fl
from repairlens.plans.fixtures import oracle, query


def _metrics(lines):
    """Hits of three kinds of spans on gold lines, as if each were a baseline."""
    gold = lines.where("kind = 'gold'").select("instance_id", "path", "line")
    n_gold = gold.groupBy("instance_id").agg(F.count("*").alias("gold"))
    marked = lines.where("kind <> 'gold'").join(gold.withColumn("g", F.lit(1)).hint("merge"), ["instance_id", "path", "line"], "left")
    per = marked.groupBy("instance_id", F.col("kind").alias("baseline")).agg(F.count("*").alias("cands"), F.count("g").alias("hits"))
    return per.join(n_gold.hint("merge"), "instance_id")


def _matrix(records):
    facts = records.groupBy("instance_id").agg((F.max("ord") % 3).alias("test_failures"), (F.max("ord") % 2 == 0).alias("patch_exists"), (F.max("ord") % 5 == 0).alias("submitted_without_tests"))
    return ev.failure_class(ev.merge_eval_status(records).join(facts, "instance_id"))


_sources = lambda spans: spans.withColumn("kind", F.expr("CASE kind WHEN 'gold' THEN 'gold' WHEN 'viewed' THEN 'viewed' WHEN 'final' THEN 'edited' ELSE 'search' END"))
_BASELINES = ["packet", "broad", "feedback"]
_which = lambda: F.element_at(F.array(*(F.lit(b) for b in [*_BASELINES, "oracle"])), (F.col("ord") % 4 + 1).cast("int"))
_reports = lambda r: r.select("instance_id", _which().alias("baseline"), F.concat(F.lit("a"), (F.col("instance_id") % 3).cast("string")).alias("action"), F.when(F.col("ord") % 6 < 2, "packet_noop").otherwise("full").alias("packet_mode"), F.when(F.col("ord") % 5 > 0, F.col("ord") % 7 == 0).alias("should_retry"))
_recalls = lambda r: r.groupBy("instance_id", _which().alias("baseline")).agg((F.max("ord") % 4 / 4).alias("incremental_recall")).withColumn("incremental_recall", F.when(F.col("instance_id") % 2 == 0, F.col("incremental_recall")))
_attempts = lambda r: r.select("instance_id", F.concat(F.lit("b"), (F.col("ord") % 3).cast("string")).alias("baseline"), "resolved")

def _solved(docs):
    chars = F.col("n_chars")
    return docs.select(F.concat(F.lit("org__"), "source", F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("instance_id"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("repo"), F.when(chars % 50 < 45, chars % 50).alias("solved"))


def _chained(lineitem):
    frame = lambda letter, c, n: F.concat(F.lit(letter), (F.col(c) % n).cast("string"))
    chain = F.array(frame("a", "l_partkey", 9), frame("b", "l_suppkey", 6), frame("c", "l_orderkey", 7), frame("a", "l_orderkey", 5))
    once = lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    events = once.select((F.col("l_orderkey") % 97).alias("run_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.when(F.col("l_linenumber") < 3, "TYPE_ERROR").otherwise("OTHER").alias("error_class"), chain.alias("call_chain"))
    return events, fl.seed_groups(events)


def _seeded(lineitem):
    events, groups = _chained(lineitem)
    own = join_list(events.withColumn("chain", fl.distinct_frames(F.col("call_chain"))), groups, ["run_id", "error_class", "chain"], rows=500_000)
    return own.select("run_id", "error_class", "ord", "seed")


QUERIES = {
    "seed_groups": query(_seeded, "lineitem"),
    "solved_histogram": query(lambda d: ev.solved_histogram(_solved(d)), "documents"),
    "hardest_easiest": query(lambda d: ev.hardest_easiest(_solved(d)), "documents"),
    "hard_repo_mix": query(lambda d: ev.hard_repo_mix(_solved(d)), "documents"),
    "normalize_message": query(lambda f: f.select("ord", fl.normalize_message(F.col("error_message")).alias("fingerprint"), fl.error_class(F.col("exception_type")).alias("error_class")), "failures"),
    "failure_events": query(lambda f: fl.failure_events(f).drop("call_chain"), "failures"),
    "cluster_failures": query(lambda f: fl.cluster_failures(fl.failure_events(f)), "failures"),
    "cluster_summary": query(lambda f: fl.cluster_summary(fl.failure_events(f), fl.cluster_failures(fl.failure_events(f))).drop("cluster_id"), "failures"),
    "expand_spans": query(ev.expand_spans, "spans"),
    "segments": query(lambda s: ev.segments(s).where("gold").groupBy("instance_id", "path").agg(F.sum("n").alias("gold_lines"), F.sum(F.expr("CASE WHEN candidate THEN n ELSE 0 END")).alias("hit_lines"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line")), "spans"),
    "overlap_metrics": query(lambda s: ev.overlap_metrics(ev.segments(s)), "spans"),
    "overlap_per_1k": query(lambda s, d: ev.overlap_per_1k(ev.overlap_metrics(ev.segments(s)), d.select(F.col("doc_id").alias("instance_id"), F.when(F.col("doc_id") % 5 > 0, F.col("n_chars")).alias("packet_chars"))).select("instance_id", "line_inter", "overlap_per_1k_chars"), "spans", "documents"),
    "abstain_checks": query(lambda r: ev.abstain_checks(_reports(r), _BASELINES), "eval_records"),
    "abstain_summary": query(lambda r: ev.abstain_summary(ev.abstain_checks(_reports(r), _BASELINES), _recalls(r)), "eval_records"),
    "gold_subsets": query(lambda s: ev.gold_subsets(ev.expand_spans(s)), "spans"),
    "incremental_recall": query(lambda s: ev.incremental_recall(ev.gold_segments(ev.segments(s))), "spans"),
    "source_ablation": query(lambda s: ev.source_ablation(ev.segments(_sources(s), ["gold", "edited", "viewed", "search"])), "spans"),
    "baseline_aggregates": query(lambda s: ev.baseline_aggregates(_metrics(ev.expand_spans(s))), "spans"),
    "win_rate": query(lambda s: ev.win_rate(_metrics(ev.expand_spans(s))), "spans"),
    "action_group_metrics": query(lambda s: ev.action_group_metrics(_metrics(ev.expand_spans(s)).withColumn("action", F.col("instance_id") % 5), ["candidate", "final", "viewed"]), "spans"),
    "merge_eval_status": query(ev.merge_eval_status, "eval_records"),
    "failure_class": query(_matrix, "eval_records"),
    "eval_overview": query(lambda r: ev.eval_overview(_matrix(r)), "eval_records"),
    "rescue_matrix": query(lambda r: ev.rescue_matrix(ev.merge_eval_status(r), _attempts(r)), "eval_records"),
    "difficulty_profile": query(lambda p: ev.difficulty_profile(p.select(F.col("p_partkey").alias("instance_id"), F.col("p_size").alias("size"))), "part"),
}

_FP = "error_message"
for _pattern, _mark in fl.MASKS:
    _FP = "regexp_replace({}, '{}', '{}', 'g')".format(_FP, _pattern.replace("(?U)", "").replace("'", "''"), _mark.replace("$", "\\").replace("'", "''"))
_CLASS = "CASE exception_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fl.CLASSES.items()) + " ELSE 'OTHER' END"
_EV = f"""ev AS (SELECT run_id, ord, test_name, exception_type, {_CLASS} AS error_class, trim({_FP}) AS fingerprint, root_frame AS top_frame,
  contains(test_name, '[') AS is_parameterized, split_part(test_name, '[', 1) AS param_group FROM failures)"""
_INF = "CASE WHEN fingerprint NOT IN ('AssertionError:', 'AssertionError', 'Error:', '', '?') THEN fingerprint END"
_CL = f"""{_EV}, a AS (SELECT *, {_INF} AS print,
    is_parameterized AND count(*) FILTER (is_parameterized) OVER k > 1 AND (coalesce(min({_INF}) FILTER (is_parameterized) OVER k = max({_INF}) FILTER (is_parameterized) OVER k, false)
      OR coalesce(min(top_frame) FILTER (is_parameterized) OVER k = max(top_frame) FILTER (is_parameterized) OVER k, false)) AS p1
  FROM ev WINDOW k AS (PARTITION BY run_id, param_group, error_class)),
b AS (SELECT *, NOT p1 AND print IS NOT NULL AND count(*) OVER (PARTITION BY run_id, p1, print) > 1 AS p2 FROM a),
c AS (SELECT *, NOT p1 AND NOT p2 AND count(*) OVER (PARTITION BY run_id, p1 OR p2, top_frame) > 1 AS p3 FROM b),
members AS (SELECT *, CASE WHEN p1 THEN 1 WHEN p2 THEN 2 WHEN p3 THEN 3 ELSE 4 END AS stage,
  CASE WHEN p1 THEN 'family|' || param_group || '|' || error_class WHEN p2 THEN 'print|' || print WHEN p3 THEN 'frame|' || top_frame ELSE 'seed|' || ord END AS cluster FROM c)"""
_LINES = "ln AS (SELECT DISTINCT instance_id, kind, path, unnest(range(start_line, end_line + 1)) AS line FROM spans)"
_SUBS = f"""{_LINES}, f AS (SELECT instance_id, path, CAST(line AS BIGINT) AS line, bool_or(kind = 'gold') AS gold, bool_or(kind = 'viewed') AS seen, bool_or(kind = 'final') AS final, bool_or(kind = 'edited') AS edited,
  bool_or(kind = 'candidate') AS hit FROM ln GROUP BY ALL), subs AS (SELECT * EXCLUDE gold FROM f WHERE gold)"""
_MET = f"""{_LINES}, met AS (SELECT l.instance_id, l.kind AS baseline, count(*) AS cands, count(g.line) AS hits, any_value(n.gold) AS gold FROM ln l
  JOIN (SELECT instance_id, count(*) AS gold FROM ln WHERE kind = 'gold' GROUP BY 1) n USING (instance_id)
  LEFT JOIN ln g ON g.kind = 'gold' AND g.instance_id = l.instance_id AND g.path = l.path AND g.line = l.line WHERE l.kind <> 'gold' GROUP BY 1, 2)"""
_MERGED = """m AS (SELECT instance_id, CASE WHEN bool_or(NOT resolved) THEN 'False' WHEN bool_or(resolved) THEN 'True' ELSE 'NOT_EVALUATED' END AS resolved,
  count(DISTINCT coalesce(CAST(resolved AS STRING), 'n')) > 1 AS conflict, count(*) AS n, (list(eval_error ORDER BY priority, ord))[1] AS error FROM eval_records GROUP BY 1),
merged AS (SELECT instance_id, resolved, CASE WHEN conflict THEN 'CONFLICT' WHEN resolved = 'NOT_EVALUATED' THEN 'NOT_EVALUATED'
  WHEN n = 1 AND resolved = 'False' AND contains(error, 'patch_apply') THEN 'PATCH_APPLY_FAILED' WHEN n = 1 AND resolved = 'False' AND error <> '' THEN 'ENV_ERROR' ELSE 'EVALUATED' END AS status, conflict FROM m)"""
_MATRIX = f"""{_MERGED}, mat AS (SELECT *, CASE WHEN status IN ('ENV_ERROR', 'PATCH_APPLY_FAILED') THEN 'env-anomaly' WHEN status = 'CONFLICT' THEN 'unknown' WHEN resolved = 'True' THEN 'resolved'
    WHEN status = 'NOT_EVALUATED' THEN 'unknown' WHEN test_failures > 0 THEN 'visible-failure' WHEN submitted_without_tests THEN 'no-runtime-signal' WHEN patch_exists THEN 'hidden-failure' ELSE 'unknown' END AS failure_class
  FROM merged JOIN (SELECT instance_id, max(ord) % 3 AS test_failures, max(ord) % 2 = 0 AS patch_exists, max(ord) % 5 = 0 AS submitted_without_tests FROM eval_records GROUP BY 1) USING (instance_id))"""
_REC = ", ".join(f"count(*) FILTER ({c}) AS {n}_lines, count(*) FILTER (hit AND {c}) AS {n}_hits, count(*) FILTER (hit AND {c}) / nullif(count(*) FILTER ({c}), 0) AS {n}_recall" for n, c in ev.SUBSETS.items())

_SOLVED = "s AS (SELECT 'org__' || source || '-' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS instance_id, CASE WHEN doc_id % 2 = 0 THEN source END AS repo, source, CASE WHEN n_chars % 50 < 45 THEN n_chars % 50 END AS solved FROM documents)"
_HARD = f"WITH {_SOLVED}, k AS (SELECT instance_id, repo, source, CAST(coalesce(solved, 9999) AS BIGINT) AS solved FROM s)"
_REPORTS = """p AS (SELECT instance_id, ord, (['packet', 'broad', 'feedback', 'oracle'])[ord % 4 + 1] AS baseline FROM eval_records),
o AS (SELECT instance_id, baseline, bool_or(ord % 5 > 0 AND ord % 7 = 0) AS fires, bool_or(ord % 6 < 2) AS abstain FROM p WHERE baseline <> 'oracle' GROUP BY 1, 2),
ch AS (SELECT instance_id, baseline, 'a' || (instance_id % 3) AS action, abstain, NOT EXISTS (SELECT 1 FROM o x WHERE x.instance_id = o.instance_id AND x.baseline <> o.baseline AND x.fires) AS others_silent FROM o)"""
ORACLES = {
    "segments": oracle("spans", f"""{_LINES}, l AS (SELECT instance_id, path, line, bool_or(kind = 'gold') AS g, bool_or(kind = 'candidate') AS c FROM ln GROUP BY ALL)
SELECT instance_id, path, count(*) AS gold_lines, count(*) FILTER (c) AS hit_lines, min(line) AS first_line, max(line) AS last_line FROM l WHERE g GROUP BY 1, 2"""),
    "overlap_per_1k": oracle("spans", f"""{_LINES}, f AS (SELECT instance_id, path, line, bool_or(kind = 'candidate') AS c, bool_or(kind = 'gold') AS g FROM ln WHERE kind IN ('candidate', 'gold') GROUP BY ALL)
SELECT instance_id, count(*) FILTER (c AND g) AS line_inter, CASE WHEN max(n_chars) > 0 AND instance_id % 5 > 0 THEN round(count(*) FILTER (c AND g) / (max(n_chars) / 1000), 3) ELSE 0 END AS overlap_per_1k_chars FROM f LEFT JOIN documents ON doc_id = instance_id GROUP BY instance_id"""),
    "abstain_checks": oracle("eval_records", f"{_REPORTS} SELECT *, abstain AND others_silent AS abstain_correct, NOT abstain AND others_silent AS false_intervention FROM ch"),
    "abstain_summary": oracle("eval_records", f"""{_REPORTS}, r AS (SELECT instance_id, baseline, CASE WHEN instance_id % 2 = 0 THEN (max(ord) % 4) / 4 END AS inc FROM p GROUP BY 1, 2)
SELECT baseline, action, count(*) AS n, count(*) FILTER (abstain) AS abstained, count(*) FILTER (abstain AND others_silent) AS abstain_correct, count(*) FILTER (NOT abstain AND others_silent) AS false_interventions, round(avg(inc), 6) AS avg_recall
FROM ch LEFT JOIN r USING (instance_id, baseline) GROUP BY 1, 2"""),
    "seed_groups": """WITH RECURSIVE e AS (SELECT l_orderkey % 97 AS run_id, CASE WHEN l_linenumber < 3 THEN 'TYPE_ERROR' ELSE 'OTHER' END AS error_class, l_orderkey * 10 + l_linenumber AS ord,
    list_distinct(['a' || (l_partkey % 9), 'b' || (l_suppkey % 6), 'c' || (l_orderkey % 7), 'a' || (l_orderkey % 5)]) AS chain FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2)),
g AS (SELECT *, row_number() OVER (PARTITION BY run_id, error_class ORDER BY ord) AS i FROM e),
w AS (SELECT run_id, error_class, i, ord, ord AS seed, [{'o': ord, 'c': chain}] AS seeds FROM g WHERE i = 1
UNION ALL SELECT g.run_id, g.error_class, g.i, g.ord, coalesce(s, g.ord), CASE WHEN s IS NULL THEN list_append(seeds, {'o': g.ord, 'c': g.chain}) ELSE seeds END
FROM (SELECT g.*, w.seeds, list_filter(w.seeds, lambda x: len(list_intersect(x.c, g.chain)) >= 2)[1].o AS s FROM w JOIN g ON g.run_id = w.run_id AND g.error_class = w.error_class AND g.i = w.i + 1) g)
SELECT run_id, error_class, ord, seed FROM w""",
    "solved_histogram": f"WITH {_SOLVED} SELECT CASE WHEN solved = 0 THEN '0 (unsolved)' WHEN solved <= 5 THEN '1-5 (hard)' WHEN solved <= 15 THEN '6-15 (medium)' WHEN solved <= 30 THEN '16-30 (easy)' ELSE '31+ (trivial)' END AS bucket, count(*) AS n FROM s WHERE solved IS NOT NULL GROUP BY 1",
    "hardest_easiest": f"{_HARD} (SELECT 'hardest' AS side, instance_id, repo, solved FROM k ORDER BY solved, instance_id LIMIT 10) UNION ALL (SELECT 'easiest', instance_id, repo, solved FROM k ORDER BY solved DESC, instance_id DESC LIMIT 5)",
    "hard_repo_mix": f"{_HARD}, h AS (SELECT coalesce(nullif(repo, ''), 'org/' || source) AS repo FROM k ORDER BY solved, instance_id LIMIT 30) SELECT repo, count(*) AS n FROM h GROUP BY 1 ORDER BY n DESC, repo LIMIT 10",
    "normalize_message": oracle("failures", f"{_EV} SELECT ord, fingerprint, error_class FROM ev"),
    "failure_events": oracle("failures", f"{_EV} SELECT * FROM ev"),
    "cluster_failures": oracle("failures", f"{_CL} SELECT run_id, ord, stage, cluster FROM members"),
    "cluster_summary": oracle("failures", f"{_CL} SELECT run_id, cluster, count(*) AS n, count(DISTINCT exception_type) AS n_types, min_by(error_class, ord) AS error_class, min_by(top_frame, ord) AS top_frame FROM members GROUP BY 1, 2"),
    "expand_spans": oracle("spans", f"{_LINES} SELECT instance_id, kind, path, line FROM ln"),
    "overlap_metrics": oracle("spans", f"""{_LINES}, f AS (SELECT instance_id, path, line, bool_or(kind = 'candidate') AS c, bool_or(kind = 'gold') AS g FROM ln WHERE kind IN ('candidate', 'gold') GROUP BY ALL),
t AS (SELECT instance_id, count(DISTINCT path) FILTER (c) AS cand_files, count(DISTINCT path) FILTER (g) AS gold_files, count(*) FILTER (c) AS cand_lines, count(*) FILTER (g) AS gold_lines, count(*) FILTER (c AND g) AS line_inter FROM f GROUP BY 1),
i AS (SELECT instance_id, count(*) AS file_inter FROM (SELECT instance_id, path FROM f GROUP BY 1, 2 HAVING bool_or(c) AND bool_or(g)) GROUP BY 1)
SELECT instance_id, cand_files, gold_files, coalesce(file_inter, 0) AS file_inter, cand_lines, gold_lines, line_inter, coalesce(file_inter, 0) / nullif(cand_files, 0) AS file_precision,
  coalesce(file_inter, 0) / nullif(gold_files, 0) AS file_recall, line_inter / nullif(cand_lines, 0) AS line_precision, line_inter / nullif(gold_lines, 0) AS line_recall, 2 * line_inter / (cand_lines + gold_lines) AS line_f1
FROM t LEFT JOIN i USING (instance_id)"""),
    "gold_subsets": oracle("spans", f"{_SUBS} SELECT * FROM subs"),
    "incremental_recall": oracle("spans", f"{_SUBS} SELECT instance_id, {_REC} FROM subs GROUP BY 1"),
    "source_ablation": oracle("spans", f"""{_LINES}, g AS (SELECT * FROM ln WHERE kind = 'gold'),
h AS (SELECT g.instance_id, g.path, g.line, list(DISTINCT l.kind) FILTER (l.kind IS NOT NULL) AS k FROM g LEFT JOIN ln l ON l.kind <> 'gold' AND l.instance_id = g.instance_id AND l.path = g.path AND l.line = g.line GROUP BY ALL),
x AS (SELECT instance_id, coalesce(k, []) AS k FROM h)
SELECT instance_id, mode, count(*) FILTER (CASE mode WHEN 'all' THEN len(k) > 0 WHEN 'only_edited' THEN list_contains(k, 'final') WHEN 'only_viewed' THEN list_contains(k, 'viewed') WHEN 'only_search' THEN list_contains(k, 'candidate')
  ELSE list_contains(k, 'viewed') OR list_contains(k, 'candidate') END) AS n_hits, count(*) AS n_gold FROM x, (VALUES ('all'), ('only_edited'), ('only_viewed'), ('only_search'), ('without_edited')) v(mode) GROUP BY ALL"""),
    "baseline_aggregates": oracle("spans", f"{_MET} SELECT coalesce(baseline, '*') AS baseline, count(*) AS n, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(gold) AS BIGINT) AS gold, CAST(sum(hits) FILTER (cands > 0) AS BIGINT) AS firing_hits, round(avg(hits / gold) FILTER (gold > 0), 6) AS avg_recall, round(avg(hits / gold) FILTER (gold > 0 AND cands > 0), 6) AS avg_firing_recall FROM met GROUP BY ROLLUP (baseline)"),
    "win_rate": oracle("spans", f"""{_MET}, r AS (SELECT *, rank() OVER (PARTITION BY instance_id ORDER BY hits DESC) AS r FROM met), k AS (SELECT *, count(*) OVER (PARTITION BY instance_id) AS k FROM r WHERE r = 1)
SELECT baseline, count(*) FILTER (k = 1) AS wins, count(*) FILTER (k > 1) AS ties FROM k GROUP BY 1"""),
    "action_group_metrics": oracle("spans", f"{_MET} SELECT instance_id % 5 AS action, CAST(sum(hits) FILTER (baseline = 'candidate') AS BIGINT) AS candidate, CAST(sum(hits) FILTER (baseline = 'final') AS BIGINT) AS final, CAST(sum(hits) FILTER (baseline = 'viewed') AS BIGINT) AS viewed FROM met GROUP BY 1"),
    "merge_eval_status": oracle("eval_records", f"{_MERGED} SELECT * FROM merged"),
    "failure_class": oracle("eval_records", f"{_MATRIX} SELECT * FROM mat"),
    "eval_overview": oracle("eval_records", f"{_MATRIX} SELECT failure_class, status, count(*) AS n FROM mat GROUP BY 1, 2"),
    "rescue_matrix": oracle("eval_records", f"""{_MERGED}, t AS (SELECT instance_id, 'b' || (ord % 3) AS baseline, bool_or(coalesce(resolved, false)) AS rescued FROM eval_records GROUP BY 1, 2)
SELECT instance_id, baseline, rescued, rescued AND count(*) FILTER (rescued) OVER (PARTITION BY instance_id) = 1 AS alone FROM t WHERE instance_id IN (SELECT instance_id FROM merged WHERE resolved = 'False')"""),
    "difficulty_profile": """WITH p AS (SELECT p_partkey AS id, p_size AS size, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS bucket FROM part),
o AS (SELECT bucket, list(size ORDER BY size, id) AS s FROM p GROUP BY 1) SELECT bucket, len(s) AS n, s[len(s) // 2 + 1] AS median, s[CAST(floor(len(s) * 0.9) AS INT) + 1] AS p90 FROM o""",
}
