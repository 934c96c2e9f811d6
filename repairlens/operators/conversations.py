"""Operators over messages (run_id, step, role, content) of agent conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repairlens.functions.text import any_of, strip

# Substrings that mark commands and messages.
TEST_HINTS = ["pytest", "python -m pytest", "python -m django", "tox"]
TEST_HINTS_WIDE = ["pytest", "python -m pytest", "python -m unittest", "nosetests", "tox ", "runtests"]
SEARCH_HINTS = ["grep", "rg ", "ag ", "find "]
FORMAT_ERRORS = ["No tool calls found", "Error parsing tool call"]
FENCED = r"(?s)```bash\s*\n(.+?)```"
TAGGED = r"(?s)<command>(.+?)</command>"
MUTATIONS = {
    "sed_replace": r"""sed\s+-i(?:\s+\S+)?\s+(?:'[^']*'|"[^"]*")\s+(\S+)""",
    "cat_write": r"cat\s+(?:>\||>>|>)\s*(\S+)",
    "echo_write": r"""(?:echo|printf)\s+['"].*?['"]\s+(?:>\||>>|>)\s*(\S+)""",
    "python_write": r"""python\s+-c\s+['"].*?open\(['"](\S+)['"]\s*,\s*['"]w['"]""",
    "structured_tool": r"(?:apply_patch|write_file|replace)\s+(\S+)",
}
SHOWN = r"(?:^|\s)(?:cat|head|tail|sed|nl|wc)\s+(?:-[a-zA-Z0-9]+\s+)?(/testbed/\S+|[^\s;|&`()]+\.py)"
SEARCHED = r"""(?:^|\s)(?:grep|rg|find|ack|ag)\s+(?:-[a-zA-Z0-9]+\s+)?['"]?[^'"]+['"]?\s+([^\s;|&`]+\.py)"""
PRINTED = r"""/testbed/([^\s"']+\.py)"""


def _all(col: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def extract_commands(messages: DataFrame) -> DataFrame:
    """(run_id, step, pos, cmd): fenced blocks, then tagged commands, of assistant turns."""
    found = F.concat(_all("content", FENCED), _all("content", TAGGED))
    return messages.where("role = 'assistant'").select("run_id", "step", F.posexplode(found).alias("pos", "cmd")).withColumn("cmd", strip(F.col("cmd")))


def classify_commands(commands: DataFrame) -> DataFrame:
    """Adds is_test (both hint lists), is_search, is_checkout and is_submit."""
    c = F.col("cmd")
    return commands.withColumns({
        "is_test": any_of(c, TEST_HINTS),
        "is_test_wide": any_of(c, TEST_HINTS_WIDE),
        "is_search": any_of(c, SEARCH_HINTS),
        "is_checkout": F.contains(c, F.lit("git checkout")) & ~F.contains(c, F.lit("--")),
        "is_submit": F.contains(c, F.lit("COMPLETE_TASK")),
    })


def mutation_events(commands: DataFrame) -> DataFrame:
    """(run_id, step, pos, type, file): one row for each file that a command writes."""
    each = F.array(*(F.struct(F.lit(kind).alias("type"), _all("cmd", p).alias("files")) for kind, p in MUTATIONS.items()))
    return commands.select("run_id", "step", "pos", F.explode(each).alias("m")).select("run_id", "step", "pos", "m.type", F.explode("m.files").alias("file"))


def edit_timing(mutations: DataFrame, patch_files: DataFrame) -> DataFrame:
    """(run_id, first_edit, last_edit, files_edited, n_unmatched, reliable); patch_files has (run_id, file)."""
    timing = mutations.groupBy("run_id").agg(F.min("step").alias("first_edit"), F.max("step").alias("last_edit"), F.count_distinct("file").alias("files_edited"))
    unseen = patch_files.join(mutations.select("run_id", "file").distinct().hint("merge"), ["run_id", "file"], "left_anti").groupBy("run_id").agg(F.count_distinct("file").alias("n_unmatched"))
    both = timing.join(unseen.hint("merge"), "run_id", "full")
    return both.withColumn("n_unmatched", F.coalesce("n_unmatched", F.lit(0).cast("long"))).withColumn("reliable", F.col("n_unmatched") == 0)


def repo_path(col: Column) -> Column:
    """Path without the checkout prefix."""
    return F.regexp_replace(col, r"^(/testbed/|\./)", "")


def viewed_spans(messages: DataFrame) -> DataFrame:
    """(run_id, step, path, start_line, end_line) of explore blocks; a line range belongs to the last file named before it."""
    blocks = messages.where(F.contains("content", F.lit("<explore_context>"))).select("run_id", "step", F.posexplode(_all("content", r"(?s)<explore_context>\s*(.*?)\s*</explore_context>")).alias("block", "body"))
    lines = blocks.select("run_id", "step", "block", F.posexplode(F.split("body", "\n")).alias("ln", "line")).withColumn("line", strip(F.col("line")))
    named = F.when(F.col("line").startswith("File:"), repo_path(strip(F.expr("substring(line, 6)"))))
    w = Window.partitionBy("run_id", "step", "block").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    pairs = lines.withColumn("path", F.last(named, ignorenulls=True).over(w))
    m = lambda g: F.regexp_extract("line", r"^Lines:\s*(\d+)\s*-\s*(\d+)", g).cast("int")
    spans = pairs.where(F.col("line").rlike(r"^Lines:\s*\d+\s*-\s*\d+") & (F.col("path") != ""))
    return spans.select("run_id", "step", "path", F.least(m(1), m(2)).alias("start_line"), F.greatest(m(1), m(2)).alias("end_line"))


def file_view_counts(messages: DataFrame) -> DataFrame:
    """(run_id, file, views): files named by viewing commands and printed by tools."""
    commands = extract_commands(messages).select("run_id", F.explode(F.concat(_all("cmd", SHOWN), _all("cmd", SEARCHED))).alias("file"))
    printed = messages.where("role = 'tool'").select("run_id", F.explode(_all("content", PRINTED)).alias("file"))
    return commands.unionByName(printed).groupBy("run_id", repo_path(F.col("file")).alias("file")).agg(F.count("*").alias("views"))


def exploration_concentration(views: DataFrame, top: int = 5) -> DataFrame:
    """(run_id, n_top, n_all): views of the most viewed files, and all views."""
    ranked = views.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("views"), "file")))
    return ranked.groupBy("run_id").agg(F.sum(F.when(F.col("rank") <= top, F.col("views")).otherwise(0)).alias("n_top"), F.sum("views").alias("n_all"))


def trajectory_features(messages: DataFrame) -> DataFrame:
    """One row a run: turns, format errors, commands, test commands, checkouts."""
    per_message = messages.groupBy("run_id").agg(F.expr("count_if(role = 'assistant')").alias("assistant_turns"), F.count_if((F.col("role") == "user") & any_of(F.col("content"), FORMAT_ERRORS)).alias("format_errors"))
    per_command = classify_commands(extract_commands(messages)).groupBy("run_id").agg(F.count("*").alias("commands"), F.expr("count_if(is_test)").alias("test_commands"), F.expr("count_if(is_checkout)").alias("checkouts"))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("commands", "test_commands", "checkouts")}
    return per_message.join(per_command.hint("merge"), "run_id", "left").withColumns(zero)


def viewed_edited_sets(views: DataFrame, edits: DataFrame) -> DataFrame:
    """(run_id, file, viewed, edited) of files that one of (run_id, file) inputs has."""
    flag = lambda df, name: df.select("run_id", "file").distinct().withColumn(name, F.lit(True))
    both = flag(views, "viewed").join(flag(edits, "edited").hint("merge"), ["run_id", "file"], "full")
    return both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("viewed", "edited")})


def run_features(messages: DataFrame, patch_files: DataFrame) -> DataFrame:
    """trajectory_features() with files_visited (distinct files that commands or tools show) and files_edited (of the patch: run_id, file)."""
    visited = file_view_counts(messages).groupBy("run_id").agg(F.count("*").alias("files_visited"))
    edited = patch_files.groupBy("run_id").agg(F.count_distinct("file").alias("files_edited"))
    full = trajectory_features(messages).join(visited.hint("merge"), "run_id", "left").join(edited.hint("merge"), "run_id", "left")
    return full.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("files_visited", "files_edited")})


def context_sets(views: DataFrame, edits: DataFrame, final: DataFrame) -> DataFrame:
    """(run_id, viewed_not_final, edited_not_viewed) as sorted lists: files viewed but not in the final context, and edited without a view; each input has (run_id, file)."""
    flag = lambda df, name: df.select("run_id", "file").distinct().withColumn(name, F.lit(True)).hint("merge")
    full = flag(views, "v").join(flag(edits, "e"), ["run_id", "file"], "full").join(flag(final, "f"), ["run_id", "file"], "full")
    listed = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("file"))))
    return full.groupBy("run_id").agg(listed(F.col("v").isNotNull() & F.col("f").isNull()).alias("viewed_not_final"), listed(F.col("e").isNotNull() & F.col("v").isNull()).alias("edited_not_viewed"))


def viewed_then_dropped(views: DataFrame, edits: DataFrame, frames: DataFrame) -> DataFrame:
    """(run_id, file, reason) by base name: viewed files that the patch (edits) leaves alone (dropped), and files of stack frames never viewed (unvisited); each input has (run_id, file)."""
    base = lambda df, name: df.select("run_id", F.substring_index("file", "/", -1).alias("file")).where("file <> ''").distinct().withColumn(name, F.lit(True)).hint("merge")
    full = base(views, "v").join(base(edits, "e"), ["run_id", "file"], "full").join(base(frames, "s"), ["run_id", "file"], "full")
    reason = F.when(F.col("v").isNotNull() & F.col("e").isNull(), "dropped").when(F.col("v").isNull() & F.col("s").isNotNull(), "unvisited")
    return full.select("run_id", "file", reason.alias("reason")).where("reason IS NOT NULL")


def exploration_mode(features: DataFrame) -> DataFrame:
    """Adds mode by ordered thresholds over bash_commands, test_commands, checkouts, files_visited, files_edited."""
    mode = F.expr("""CASE
      WHEN bash_commands <= 5 AND test_commands = 0 THEN 'shallow_scan'
      WHEN checkouts >= 2 OR test_commands >= 5 OR (test_commands >= 4 AND files_visited >= 5) OR (files_edited >= 5 AND files_visited <= 3) THEN 'oscillating'
      WHEN (files_visited >= 8 AND test_commands <= 1) OR (files_visited >= 5 AND files_edited <= 1 AND test_commands <= 2) THEN 'jumping'
      ELSE 'focused' END""")
    return features.withColumn("mode", mode)


def drop_format_retries(messages: DataFrame) -> DataFrame:
    """Without user messages that report a malformed tool call."""
    return messages.where(~((F.col("role") == "user") & any_of(F.coalesce("content", F.lit("")), FORMAT_ERRORS)))


def mask_observations(messages: DataFrame, max_chars: int = 500) -> DataFrame:
    """Long tool outputs cut to max_chars, with return code and former length."""
    code = F.regexp_extract("content", r"(?s)<returncode>(.*?)</returncode>", 1)
    inner = F.when(F.contains("content", F.lit("<output>")), F.regexp_extract("content", r"(?s)<output>(.*?)(?:</output>|\z)", 1)).otherwise(F.regexp_extract("content", r"(?s)\A(.*?)(?:</output>|\z)", 1))
    masked = F.concat(F.lit("<returncode>"), code, F.lit("</returncode>\n<output>\n"), F.substring(inner, 1, max_chars), F.lit("\n... (truncated, was "), F.length("content").cast("string"), F.lit(" chars)\n</output>"))
    return messages.withColumn("content", F.when((F.col("role") == "tool") & (F.length("content") > max_chars), masked).otherwise(F.col("content")))


def segment_turns(messages: DataFrame) -> DataFrame:
    """Adds turn: 0 for what leads (system, users, and all others), else the number of the assistant message that opens it."""
    w = Window.partitionBy("run_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.count_if(F.col("role") == "assistant").over(w)
    return messages.withColumn("turn", F.when(F.col("role").isin("assistant", "tool"), F.greatest(opened, F.lit(1))).otherwise(0))


def _ordered(turned: DataFrame) -> DataFrame:
    """Position of each message: what leads comes first, then turns, each in step order."""
    w = Window.partitionBy("run_id").orderBy(F.col("turn") > 0, "step")
    return turned.withColumn("pos", F.row_number().over(w) - 1)


def truncate_window(messages: DataFrame, max_turns: int = 20) -> DataFrame:
    """What leads, and the last max_turns turns; adds turn and pos."""
    turned = segment_turns(messages)
    last = F.max("turn").over(Window.partitionBy("run_id"))
    return _ordered(turned.withColumn("last", last).where((F.col("turn") == 0) | (F.col("turn") > F.col("last") - max_turns)).drop("last"))


def cap_total_size(turned: DataFrame, max_chars: int = 80_000, least: int = 5) -> DataFrame:
    """Without the oldest turns, as many as it takes for at most max_chars characters or ``least`` messages; input has turn and pos."""
    per_turn = turned.groupBy("run_id", "turn").agg(F.sum(F.length(F.coalesce("content", F.lit("")))).alias("chars"), F.count("*").alias("n"))
    by = Window.partitionBy("run_id")
    lead = lambda c: F.coalesce(F.sum(F.when(F.col("turn") == 0, F.col(c))).over(by), F.lit(0))
    later = by.orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    kept = lambda c: lead(c) + F.sum(F.when(F.col("turn") > 0, F.col(c)).otherwise(0)).over(later)
    fits = per_turn.select("run_id", "turn", ((kept("chars") <= max_chars) | (kept("n") <= least)).alias("fits")).where("fits OR turn = 0").drop("fits")
    return turned.join(fits, ["run_id", "turn"], "left_semi")


def compress_conversations(messages: DataFrame, max_tool_output: int = 500, max_turns: int = 20, max_total_chars: int = 80_000) -> DataFrame:
    """The messages left after dropping retries, masking, the window and the size cap; adds turn and pos."""
    short = mask_observations(drop_format_retries(messages), max_tool_output)
    return _ordered(cap_total_size(truncate_window(short, max_turns), max_total_chars).drop("pos"))


def compression_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(run_id, messages and chars before and after)."""
    size = lambda df, when: df.groupBy("run_id").agg(F.count("*").alias(f"messages_{when}"), F.sum(F.length(F.coalesce("content", F.lit("")))).alias(f"chars_{when}"))
    zero = F.lit(0).cast("long")
    return size(before, "before").join(size(after, "after"), "run_id", "left").withColumns({c: F.coalesce(c, zero) for c in ("messages_after", "chars_after")})


def message_stats(messages: DataFrame) -> DataFrame:
    """(run_id, role, n, chars, avg_chars, max_chars, tokens): floor average; a token is four characters."""
    chars = F.length(F.coalesce("content", F.lit("")))
    stats = messages.groupBy("run_id", "role").agg(F.count("*").alias("n"), F.sum(chars).alias("chars"), F.max(chars).cast("long").alias("max_chars"))
    return stats.withColumns({"avg_chars": F.expr("chars div n"), "tokens": F.expr("chars div 4")})


def context_block_counts(messages: DataFrame) -> DataFrame:
    """(run_id, explore_blocks, explore_entries, patch_contexts)."""
    count = lambda p: F.sum(F.regexp_count("content", F.lit(p))).cast("long")
    return messages.groupBy("run_id").agg(count("<explore_context>").alias("explore_blocks"), count(r"(?m)^\s*Lines:").alias("explore_entries"), count("<patch_context>").alias("patch_contexts"))


def repair_tool_replies(messages: DataFrame, placeholder: str = "(no output)") -> DataFrame:
    """messages (run_id, step, role, content, call_ids array, call_id) without exit rows, and with a reply for every call id that none answers.

    Added replies follow the real ones of their turn; pos numbers the result.
    """
    turned = segment_turns(messages.where("role <> 'exit'"))
    asked = turned.select("run_id", "turn", "step", F.explode("call_ids").alias("call_id"))
    missing = asked.join(turned.where("role = 'tool'").select("run_id", "turn", "call_id").hint("merge"), ["run_id", "turn", "call_id"], "left_anti")
    added = missing.select("run_id", "turn", "step", F.lit("tool").alias("role"), F.lit(placeholder).alias("content"), F.array().cast("array<string>").alias("call_ids"), "call_id", F.lit(1).alias("added"))
    both = turned.select("run_id", "turn", "step", "role", "content", "call_ids", "call_id", F.lit(0).alias("added")).unionByName(added)
    w = Window.partitionBy("run_id").orderBy("turn", "added", "step", "call_id")
    return both.withColumn("pos", F.row_number().over(w) - 1)


def redact_settings(runs: DataFrame, column: str = "settings") -> DataFrame:
    """Masks the values of map keys that name credentials."""
    secret = lambda k: F.lower(k).rlike("api_key|authorization|token|password")
    return runs.withColumn(column, F.transform_values(column, lambda k, v: F.when(secret(k), F.lit("***")).otherwise(v)))
