"""Unified diffs (run_id, patch_text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repairlens.functions.text import strip

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
HEADER = r'^diff --git "?a/.+?"? "?b/(.+?)"?$'
# Names and folders that count as configuration.
CONFIG_FILES = ["setup.py", "setup.cfg", "pyproject.toml", "tox.ini", "requirements.txt", "environment.yml", ".gitignore"]


def diff_lines(patches: DataFrame) -> DataFrame:
    """(run_id, patch, pos, file, hunk, kind, old_line, new_line, text): kind is header, hunk, added, removed or context.

    ``patch`` tells patches of one run_id apart; equal rows are one patch. Null texts have no lines.
    """
    lines = patches.select("run_id", F.xxhash64("patch_text").alias("patch"), "patch_text").distinct().select("run_id", "patch", F.posexplode(F.split("patch_text", "\n")).alias("pos", "text"))
    by = Window.partitionBy("run_id", "patch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = F.col("text")
    number = lambda g: F.when(t.rlike(HUNK), F.regexp_extract(t, HUNK, g).cast("int"))
    marked = lines.withColumns({
        "file": F.last(F.when(t.startswith("diff --git "), F.regexp_extract(t, HEADER, 1)), True).over(by),
        "is_hunk": t.rlike(HUNK),
        "ends": t.startswith("diff --git ") | t.startswith("--- "),
    }).withColumns({"hunk": F.count_if("is_hunk").over(by), "inside": F.coalesce(F.last(F.when(F.col("is_hunk"), True).when(F.col("ends"), False), True).over(by), F.lit(False))})
    kind = F.when(F.col("is_hunk"), "hunk").when(~F.col("inside"), "header").when(t.startswith("+"), "added").when(t.startswith("-"), "removed").when(t == "", "header").otherwise("context")
    kinds = marked.withColumn("kind", kind)
    inner = Window.partitionBy("run_id", "patch", "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda g, gone: F.max(number(g)).over(inner) + F.count_if(F.col("kind").isin("context", gone)).over(inner) - 1
    old = F.when(F.col("kind").isin("context", "removed"), at(1, "removed"))
    new = F.when(F.col("kind").isin("context", "added"), at(3, "added"))
    return kinds.select("run_id", "patch", "pos", "file", "hunk", "kind", old.alias("old_line"), new.alias("new_line"), "text")


def patch_stats(patches: DataFrame) -> DataFrame:
    """(run_id, patch, files, hunks, added, deleted, changed, chars, lines) of each patch of each run."""
    n = lambda kind: F.expr(f"count_if(kind = '{kind}')")
    per = diff_lines(patches).groupBy("run_id", "patch").agg(F.count_distinct("file").alias("files"), n("hunk").alias("hunks"), n("added").alias("added"), n("removed").alias("deleted"), F.count("*").alias("lines"))
    return per.join(patches.select("run_id", F.xxhash64("patch_text").alias("patch"), F.length("patch_text").alias("chars")).distinct().hint("merge"), ["run_id", "patch"]).withColumn("changed", F.col("added") + F.col("deleted"))


def classify_files(files: DataFrame) -> DataFrame:
    """Adds kind (test, config or source) to (file)."""
    low = F.lower("file")
    name = F.substring_index(low, "/", -1)
    kind = F.when(low.rlike(r"(^|/)(test|tests|testing)/") | name.startswith("test_") | name.endswith("_test.py"), "test").when(name.isin(CONFIG_FILES), "config").otherwise("source")
    return files.withColumn("kind", kind)


def hunks(patches: DataFrame) -> DataFrame:
    """(run_id, patch, hunk, file, old_start, new_start, removed, added): lines without their sign, in order, joined by line feeds."""
    lines = diff_lines(patches).where("hunk > 0")
    ordered = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", F.expr("substring(text, 2)").alias("line"))))), lambda x: x["line"]), "\n")
    start = lambda g: F.max(F.when(F.col("kind") == "hunk", F.regexp_extract("text", HUNK, g).cast("int")))
    return lines.groupBy("run_id", "patch", "hunk").agg(F.max("file").alias("file"), start(1).alias("old_start"), start(3).alias("new_start"), ordered("removed").alias("removed"), ordered("added").alias("added"))


def patch_hash(col: Column) -> Column:
    """Digest of a patch without white space around it; null for an empty one."""
    return F.when(strip(col) != "", F.substring(F.sha2(strip(col), 256), 1, 16))


def patch_integrity(submissions: DataFrame) -> DataFrame:
    """(run_id, verdict): the first gate that fails of termination, empty, not a diff, unsafe path; else ok."""
    p = F.col("patch_text")
    files = F.regexp_extract_all(p, F.lit(r"(?m)^diff --git a/\S+ b/(\S+)$"), F.lit(1))
    unsafe = F.exists(files, lambda f: f.rlike(r"(^|/)\.\.(/|$)|^/|(^|/)\.git(/|$)"))
    shaped = p.rlike(r"(?m)^diff --git \S+ \S+$") & p.rlike(r"(?m)^(@@ -\d|new file mode)")
    verdict = F.when(F.col("termination") != "Submitted", "not_submitted").when(strip(F.coalesce(p, F.lit(""))) == "", "empty_patch").when(~shaped, "not_a_diff").when(unsafe, "unsafe_path").otherwise("ok")
    return submissions.select("run_id", verdict.alias("verdict"))


def patch_consistency(left: DataFrame, right: DataFrame) -> DataFrame:
    """(run_id, state): consistent, mismatch or empty, by digests of two patches."""
    a, b = patch_hash(F.col("a.patch_text")), patch_hash(F.col("b.patch_text"))
    state = F.when(a.isNull() | b.isNull(), "empty").when(a == b, "consistent").otherwise("mismatch")
    return left.alias("a").join(right.alias("b"), F.col("a.run_id") == F.col("b.run_id")).select("a.run_id", state.alias("state"))


def same_hunk_shape(found: DataFrame, files: int = 3) -> DataFrame:
    """(run_id, hunks, n_files): hunk counts that so many files share."""
    per_file = found.groupBy("run_id", "file").agg(F.count("*").alias("hunks"))
    return per_file.groupBy("run_id", "hunks").agg(F.count("*").alias("n_files")).where(F.col("n_files") >= files)


def scope_score(features: DataFrame) -> DataFrame:
    """Adds score (of five signals) and level to (changed_files, changed_lines, api_calls, repeated_patterns, edited_files, viewed_files, edited_not_viewed, submitted_without_tests)."""
    lacks = "edited_not_viewed > 0 OR submitted_without_tests OR CASE WHEN viewed_files > 0 THEN 10 * edited_files > 7 * viewed_files ELSE edited_files > 0 END"
    signals = ["changed_files >= 5", "changed_lines >= 200", "api_calls >= 80", "repeated_patterns > 0", lacks]
    score = sum((F.expr(f"CAST({s} AS INT)") for s in signals), F.lit(0))
    return features.withColumn("score", score).withColumn("level", F.expr("CASE WHEN score >= 3 THEN 'strong' WHEN score >= 2 THEN 'warning' ELSE 'none' END"))


def edit_support(edits: DataFrame, evidence: DataFrame) -> DataFrame:
    """(run_id, path, n_sources, support) of edited files (run_id, path, pattern_only) by evidence (run_id, path, source).

    A stack trace, a test failure or an issue keyword is strong, a tight view or a search weak;
    an edit that only repeats a pattern loses a step.
    """
    has = lambda *names: F.coalesce(F.max(F.col("source").isin(list(names))), F.lit(False))
    found = evidence.groupBy("run_id", "path").agg(F.count_distinct("source").alias("n_sources"), has("stack_trace", "test_failure", "issue_keyword").alias("strong"), has("viewed_span", "search_query").alias("weak"))
    rank = F.when(F.col("strong"), 2).when(F.col("weak"), 1).otherwise(0) - F.col("pattern_only").cast("int")
    named = F.when(rank == 2, "supported").when(rank == 1, "weak").otherwise("unsupported")
    return edits.join(found, ["run_id", "path"], "left").select("run_id", "path", F.coalesce("n_sources", F.lit(0).cast("long")).alias("n_sources"), named.alias("support"))


def viewed_evidence(hunk_spans: DataFrame, views: DataFrame, widest: int = 100, near: int = 3) -> DataFrame:
    """(run_id, path, source): files with a hunk (start_line, end_line) that a view of at most so many lines touches within some lines."""
    h, v = hunk_spans.alias("h"), views.where(F.col("end_line") - F.col("start_line") <= widest).alias("v")
    touch = (F.col("h.run_id") == F.col("v.run_id")) & (F.col("h.path") == F.col("v.path")) & (F.col("h.start_line") <= F.col("v.end_line") + near) & (F.col("v.start_line") <= F.col("h.end_line") + near)
    return h.join(v, touch, "left_semi").select("run_id", "path").distinct().withColumn("source", F.lit("viewed_span"))


def prune_suggestions(support: DataFrame) -> DataFrame:
    """(run_id, keep, review, drop): edited files by what to do with them."""
    n = lambda s: F.count_if(F.col("support") == s)
    return support.groupBy("run_id").agg(n("supported").alias("keep"), n("weak").alias("review"), n("unsupported").alias("drop"))


def relocate_hunks(old_lines: DataFrame, code: DataFrame, first: int = 8, least: int = 2) -> DataFrame:
    """(id, file, start): where old lines (id, file, k, text) stand in code (path, ln, text).

    The first place where all of them stand as they are, else the first place where ``least`` of
    the ``first`` ones stand but for white space around them. Blank lines fit anywhere.
    """
    t = lambda c: strip(F.col(c))
    old = old_lines.withColumn("t", t("text")).where("t <> ''")
    pairs = old.join(code.select(F.col("path").alias("file"), "ln", F.col("text").alias("there"), t("text").alias("t")).hint("merge"), ["file", "t"])
    counted = pairs.groupBy("id", "file", (F.col("ln") - F.col("k")).alias("start")).agg(F.count_if(F.col("text") == F.col("there")).alias("same"), F.count_if(F.col("k") < first).alias("near"))
    judged = counted.join(old.groupBy("id", "file").agg(F.count("*").alias("n")).hint("merge"), ["id", "file"]).withColumn("whole", F.col("same") == F.col("n"))
    fits = judged.where(F.col("whole") | ((F.col("near") >= F.least(F.lit(least), F.col("n"))) & (F.col("n") > 1)))
    return fits.groupBy("id", "file").agg(F.min_by("start", F.struct(~F.col("whole"), F.col("start"))).alias("start"))
