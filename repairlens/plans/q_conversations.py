"""Queries over conversations, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from repairlens.operators import conversations as op
from repairlens.plans.fixtures import oracle, query


def _commands(m):
    return op.extract_commands(m)


def _patch_files(spark_df):
    return spark_df.select("run_id", F.concat(F.lit("src/m"), (F.col("run_id") % 6).cast("string"), F.lit(".py")).alias("file")).distinct()


def _features(events):
    return op.exploration_mode(events)


def _tool_replies(m):
    """Messages with call ids: each assistant turn asks twice, and tools answer the first call of even steps."""
    ids = F.when(F.col("role") == "assistant", F.array(F.concat(F.lit("c"), F.col("step").cast("string"), F.lit("a")), F.concat(F.lit("c"), F.col("step").cast("string"), F.lit("b")))).otherwise(F.array().cast("array<string>"))
    call = F.when(F.col("role") == "tool", F.concat(F.lit("c"), (F.col("step") - 1).cast("string"), F.lit("a")))
    return op.repair_tool_replies(m.withColumns({"call_ids": ids, "call_id": call})).select("run_id", "pos", "role", "call_id")


QUERIES = {
    "extract_commands": query(_commands, "messages"),
    "classify_commands": query(lambda m: op.classify_commands(_commands(m)), "messages"),
    "mutation_events": query(lambda m: op.mutation_events(_commands(m)), "edits"),
    "edit_timing": query(lambda m: op.edit_timing(op.mutation_events(_commands(m)), _patch_files(m)), "edits"),
    "viewed_spans": query(op.viewed_spans, "explorations"),
    "file_view_counts": query(op.file_view_counts, "messages"),
    "exploration_concentration": query(lambda m: op.exploration_concentration(op.file_view_counts(m), 1), "messages"),
    "trajectory_features": query(op.trajectory_features, "messages"),
    "viewed_edited_sets": query(lambda v, e: op.viewed_edited_sets(op.viewed_spans(v).select("run_id", F.col("path").alias("file")), op.mutation_events(_commands(e))), "explorations", "edits"),
    "exploration_mode": query(_features, "features"),
    "segment_turns": query(lambda m: op.segment_turns(m).select("run_id", "step", "turn"), "messages"),
    "drop_format_retries": query(lambda m: op.drop_format_retries(m).groupBy("role").agg(F.count("*").alias("n")), "messages"),
    "mask_observations": query(lambda m: op.mask_observations(m, 80), "messages"),
    "truncate_window": query(lambda m: op.truncate_window(m, 2).select("run_id", "step", "turn", "pos"), "messages"),
    "cap_total_size": query(lambda m: op.cap_total_size(op.truncate_window(m, 99), 900, 3).select("run_id", "step", "turn"), "messages"),
    "compress_conversations": query(lambda m: op.compress_conversations(m, 80, 2, 600).select("run_id", "step", "role", "content", "pos"), "messages"),
    "compression_report": query(lambda m: op.compression_report(m, op.compress_conversations(m, 80, 2, 600)), "messages"),
    "message_stats": query(op.message_stats, "messages"),
    "context_block_counts": query(op.context_block_counts, "explorations"),
    "repair_tool_replies": query(_tool_replies, "messages"),
}

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_CMD = rf"""cmds AS (
  SELECT run_id, step, unnest(range(len(c))) AS pos, {_STRIP.format("unnest(c)")} AS cmd FROM (
    SELECT run_id, step, regexp_extract_all(content, '```bash\s*\n(.+?)```', 1, 's') || regexp_extract_all(content, '<command>(.+?)</command>', 1, 's') AS c
    FROM {{}} WHERE role = 'assistant'))"""
_COMMANDS = _CMD.format("messages")
_HOLDS = lambda hints, col="cmd": "(" + " OR ".join(f"contains({col}, '{h}')" for h in hints) + ")"
_FLAGS = f"""{_HOLDS(op.TEST_HINTS)} AS is_test, {_HOLDS(op.TEST_HINTS_WIDE)} AS is_test_wide, {_HOLDS(op.SEARCH_HINTS)} AS is_search,
  contains(cmd, 'git checkout') AND NOT contains(cmd, '--') AS is_checkout, contains(cmd, 'COMPLETE_TASK') AS is_submit"""
_q = lambda p: p.replace("'", "''")
_MUT = _CMD.format("edits") + ", muts AS (" + " UNION ALL ".join(f"SELECT run_id, step, pos, '{k}' AS type, unnest(regexp_extract_all(cmd, '{_q(p)}', 1)) AS file FROM cmds" for k, p in op.MUTATIONS.items()) + ")"
_VIEWS = _COMMANDS + rf""", views AS (
  SELECT run_id, regexp_replace(f, '^(/testbed/|\./)', '') AS file, count(*) AS views FROM (
    SELECT run_id, unnest(regexp_extract_all(cmd, '{_q(op.SHOWN)}', 1) || regexp_extract_all(cmd, '{_q(op.SEARCHED)}', 1)) AS f FROM cmds
    UNION ALL SELECT run_id, unnest(regexp_extract_all(content, '{_q(op.PRINTED)}', 1)) FROM messages WHERE role = 'tool') GROUP BY ALL)"""
_SPANS = r"""seen AS (
  SELECT run_id, step, path, least(a, b) AS start_line, greatest(a, b) AS end_line FROM (
    SELECT run_id, step, regexp_extract(content, 'File: (\S+)', 1) AS path, CAST(regexp_extract(content, 'Lines: (\d+)-', 1) AS INT) AS a,
      CAST(regexp_extract(content, 'Lines: \d+-(\d+)', 1) AS INT) AS b FROM explorations))"""
_TURNED = """turned AS (
  SELECT *, CASE WHEN role IN ('assistant', 'tool') THEN greatest(count(*) FILTER (role = 'assistant') OVER (PARTITION BY run_id ORDER BY step), 1) ELSE 0 END AS turn FROM {})"""
_MASKED = r"""masked AS (
  SELECT run_id, step, role, CASE WHEN role = 'tool' AND length(content) > 80 THEN
    '<returncode>' || regexp_extract(content, '<returncode>(.*?)</returncode>', 1, 's') || '</returncode>' || chr(10) || '<output>' || chr(10)
    || substring(regexp_extract(content, '<output>(.*)</output>', 1, 's'), 1, 80) || chr(10) || '... (truncated, was ' || length(content) || ' chars)' || chr(10) || '</output>'
    ELSE content END AS content FROM messages)"""
_CAPPED = lambda src, turns, chars, least: f"""{_TURNED.format(src)}, win AS (
  SELECT * FROM (SELECT *, max(turn) OVER (PARTITION BY run_id) AS last FROM turned) WHERE turn = 0 OR turn > last - {turns}),
dropped AS (SELECT run_id, k FROM (SELECT run_id, unnest(range(0, 100)) AS k FROM (SELECT DISTINCT run_id FROM win))),
state AS (SELECT d.run_id, k, sum(length(content)) AS chars, count(*) AS n FROM dropped d JOIN win w ON w.run_id = d.run_id AND (turn = 0 OR turn > k) GROUP BY ALL),
cut AS (SELECT run_id, min(k) AS k FROM state WHERE chars <= {chars} OR n <= {least} GROUP BY run_id),
capped AS (SELECT w.* FROM win w LEFT JOIN cut c USING (run_id) WHERE turn = 0 OR turn > coalesce(k, 100))"""  # noqa: E731

ORACLES = {
    "extract_commands": oracle("messages", f"{_COMMANDS} SELECT * FROM cmds"),
    "classify_commands": oracle("messages", f"{_COMMANDS} SELECT *, {_FLAGS} FROM cmds"),
    "mutation_events": oracle("edits", f"{_MUT} SELECT * FROM muts"),
    "edit_timing": oracle("edits", f"""{_MUT},
t AS (SELECT run_id, min(step) AS first_edit, max(step) AS last_edit, count(DISTINCT file) AS files_edited FROM muts GROUP BY run_id),
p AS (SELECT DISTINCT run_id, 'src/m' || (run_id % 6) || '.py' AS file FROM edits),
u AS (SELECT run_id, count(*) AS n FROM p ANTI JOIN muts USING (run_id, file) GROUP BY run_id)
SELECT run_id, first_edit, last_edit, files_edited, coalesce(n, 0) AS n_unmatched, coalesce(n, 0) = 0 AS reliable FROM t FULL JOIN u USING (run_id)"""),
    "viewed_spans": oracle("explorations", f"{_SPANS} SELECT * FROM seen"),
    "file_view_counts": oracle("messages", f"{_VIEWS} SELECT * FROM views"),
    "exploration_concentration": oracle("messages", f"{_VIEWS} SELECT run_id, CAST(max(views) AS BIGINT) AS n_top, CAST(sum(views) AS BIGINT) AS n_all FROM views GROUP BY run_id"),
    "trajectory_features": oracle("messages", f"""{_COMMANDS}, f AS (SELECT run_id, {_FLAGS} FROM cmds)
SELECT m.run_id, assistant_turns, format_errors, coalesce(commands, 0) AS commands, coalesce(test_commands, 0) AS test_commands, coalesce(checkouts, 0) AS checkouts
FROM (SELECT run_id, count(*) FILTER (role = 'assistant') AS assistant_turns, count(*) FILTER (role = 'user' AND {_HOLDS(op.FORMAT_ERRORS, "content")}) AS format_errors FROM messages GROUP BY run_id) m
LEFT JOIN (SELECT run_id, count(*) AS commands, count(*) FILTER (is_test) AS test_commands, count(*) FILTER (is_checkout) AS checkouts FROM f GROUP BY run_id) c USING (run_id)"""),
    "viewed_edited_sets": oracle("explorations edits", f"""{_SPANS}, {_MUT}
SELECT run_id, file, bool_or(v) AS viewed, bool_or(e) AS edited FROM (SELECT run_id, path AS file, true AS v, false AS e FROM seen UNION ALL SELECT run_id, file, false, true FROM muts) GROUP BY run_id, file"""),
    "exploration_mode": oracle("features", """SELECT *, CASE WHEN bash_commands <= 5 AND test_commands = 0 THEN 'shallow_scan' WHEN checkouts >= 2 THEN 'oscillating' WHEN test_commands >= 5 THEN 'oscillating'
  WHEN test_commands >= 4 AND files_visited >= 5 THEN 'oscillating' WHEN files_edited >= 5 AND files_visited <= 3 THEN 'oscillating' WHEN files_visited >= 8 AND test_commands <= 1 THEN 'jumping'
  WHEN files_visited >= 5 AND files_edited <= 1 AND test_commands <= 2 THEN 'jumping' ELSE 'focused' END AS mode FROM features"""),
    "segment_turns": oracle("messages", f"{_TURNED.format('messages')} SELECT run_id, step, turn FROM turned"),
    "drop_format_retries": oracle("messages", f"SELECT role, count(*) AS n FROM messages WHERE NOT (role = 'user' AND {_HOLDS(op.FORMAT_ERRORS, 'content')}) GROUP BY role"),
    "mask_observations": oracle("messages", f"{_MASKED} SELECT * FROM masked"),
    "truncate_window": oracle("messages", f"""{_CAPPED('messages', 2, 10**9, 0)} SELECT run_id, step, turn, row_number() OVER (PARTITION BY run_id ORDER BY turn > 0, step) - 1 AS pos FROM win"""),
    "cap_total_size": oracle("messages", f"{_CAPPED('messages', 99, 900, 3)} SELECT run_id, step, turn FROM capped"),
    "compress_conversations": oracle("messages", f"{_MASKED}, {_CAPPED('masked', 2, 600, 5)} SELECT run_id, step, role, content, row_number() OVER (PARTITION BY run_id ORDER BY turn > 0, step) - 1 AS pos FROM capped"),
    "compression_report": oracle("messages", f"""{_MASKED}, {_CAPPED('masked', 2, 600, 5)}
SELECT run_id, messages_before, chars_before, coalesce(messages_after, 0) AS messages_after, coalesce(chars_after, 0) AS chars_after
FROM (SELECT run_id, count(*) AS messages_before, CAST(sum(length(content)) AS BIGINT) AS chars_before FROM messages GROUP BY run_id)
LEFT JOIN (SELECT run_id, count(*) AS messages_after, CAST(sum(length(content)) AS BIGINT) AS chars_after FROM capped GROUP BY run_id) USING (run_id)"""),
    "message_stats": oracle("messages", """SELECT run_id, role, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars, max(length(content)) AS max_chars,
  CAST(sum(length(content)) // count(*) AS BIGINT) AS avg_chars, CAST(sum(length(content)) // 4 AS BIGINT) AS tokens FROM messages GROUP BY run_id, role"""),
    "context_block_counts": oracle("explorations", """SELECT run_id, count(*) AS explore_blocks, count(*) AS explore_entries, CAST(0 AS BIGINT) AS patch_contexts FROM explorations GROUP BY run_id"""),
    "repair_tool_replies": oracle("messages", f"""{_TURNED.format('messages')}, c AS (SELECT *, CASE WHEN role = 'tool' THEN 'c' || (step - 1) || 'a' END AS call_id FROM turned),
asked AS (SELECT run_id, turn, step, 'c' || step || x AS call_id FROM turned, (VALUES ('a'), ('b')) v(x) WHERE role = 'assistant'),
al AS (SELECT run_id, turn, step, role, call_id, 0 AS added FROM c UNION ALL SELECT run_id, turn, step, 'tool', call_id, 1 FROM asked a WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.role = 'tool' AND c.run_id = a.run_id AND c.turn = a.turn AND c.call_id = a.call_id))
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY turn, added, step, call_id NULLS FIRST) - 1 AS pos, role, call_id FROM al"""),
}
