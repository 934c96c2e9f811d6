"""Failure sections of test logs: one row a failed test, with its own error, frames and assertion.

Logs are exploded to lines; a running count of headers numbers the sections of a log, and one
aggregation per section takes what the section's lines say. No Python worker is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repairlens.functions.joins import join_list
from repairlens.functions.text import lines_nl, strip

# Headers, error lines, frames and results of test logs.
HEADER = r"^_{3,}\s+(.+?)\s+_{3,}"
SUMMARY = r"^==+.*short test summary.*==+"
ERROR = r"^\s*E\s+(\w+(?:Error|Exception|Failure))(?::\s*(.*))?"
FRAME = r"^(\S+?)\.py:(\d+):(?:\s+in\s+(\w+))?"
FILE_FRAME = r'File\s+"([^"]+)",\s*line\s+(\d+)(?:,\s*in\s+(\w+))?'
RESULT = r"^(\w[\w_]+)\s+\(([^)]+)\)\s+\.\.\.\s+(ok|ERROR|FAIL)"
DJANGO_HEADER = r"^(ERROR|FAIL):\s+(\w[\w_]+)\s+\(([^)]+)\)"
DJANGO_ERROR = r"^((?:Assertion|Attribute|Type|Value|Import|ModuleNotFound|Key|Index|Runtime|OS|Operational)Error|StopIteration)[^:\n]*:\s*([^\n]+)"


def _lines(logs: DataFrame) -> DataFrame:
    """(run_id, log, pos, line): ``log`` tells the logs of one run apart; equal rows are one log."""
    plain = F.regexp_replace("log_text", r"\x1B\[[0-9;]*m", "")
    each = logs.select("run_id", F.xxhash64("log_text").alias("log"), "log_text").distinct()
    return each.select("run_id", "log", F.posexplode(lines_nl(plain)).alias("pos", "line")).withColumn("line", F.regexp_replace("line", r"\r$", ""))


def _renumbered(sections: DataFrame) -> DataFrame:
    """Sections of several logs of a run counted on, one log after another."""
    return sections.withColumn("ord", F.row_number().over(Window.partitionBy("run_id").orderBy("log", "ord")).cast("long"))


def _frame(path: Column, line: Column, function: Column) -> Column:
    """A frame as a struct, its path within the repository and told apart by kind."""
    file = F.regexp_replace(path, r"^(.*/testbed/|\./)", "")
    repo = F.contains(path, F.lit("/testbed/")) | (~path.rlike(r"^[/<>\[]") & ~path.rlike("(site|dist)-packages/"))
    test = F.lower(file).rlike(r"(^|/)(test|tests|testing)/|(^|/)test_[^/]*$|_test\.py$")
    return F.struct(file.alias("file"), line.cast("int").alias("line"), function.alias("function"), (repo & test).alias("is_test_file"), repo.alias("is_repo_frame"))


def _grab(pattern: str, group: int) -> Column:
    return F.regexp_extract("line", pattern, group)


def parse_pytest_failures(logs: DataFrame) -> DataFrame:
    """(run_id, ord, test_name, exception_type, error_message, assertion_line, root_frame, frames) of each section.

    The first error line of a section counts; of its assertion lines the first that compares,
    else the last. A frame of the form File "..." at column 0 is recorded once.
    """
    w = Window.partitionBy("run_id", "log").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = _lines(logs)
    trimmed = strip(F.col("line"))
    opened = lines.withColumn("name", F.when(trimmed.rlike(HEADER), F.regexp_extract(trimmed, HEADER, 1)))
    numbered = opened.withColumns({"ord": F.count("name").over(w), "closed": F.last(F.when(F.col("name").isNotNull(), False).when(F.col("line").rlike(SUMMARY), True), True).over(w)})
    body = numbered.where("ord > 0 AND NOT closed")
    is_error, is_claim = F.col("line").rlike(ERROR), F.col("line").rlike(r"^>\s+\S")
    error = F.when(is_error, F.struct("pos", _grab(ERROR, 1).alias("type"), F.concat(_grab(ERROR, 1), F.lit(": "), _grab(ERROR, 2)).alias("message")))
    short = F.when(F.col("line").rlike(FRAME), _frame(F.concat(_grab(FRAME, 1), F.lit(".py")), _grab(FRAME, 2), _grab(FRAME, 3)))
    long = F.when(F.col("line").rlike(r"^\s*" + FILE_FRAME), _frame(_grab(FILE_FRAME, 1), _grab(FILE_FRAME, 2), _grab(FILE_FRAME, 3)))
    compares = F.lower("line").rlike("assert_|assert |==|!=")
    frame = F.coalesce(short, long)
    sections = body.groupBy("run_id", "log", "ord").agg(
        F.max("name").alias("test_name"),
        F.min(error).alias("e"),
        F.min(F.when(is_claim & compares, F.struct("pos", "line"))).alias("best"),
        F.max(F.when(is_claim, F.struct("pos", "line"))).alias("last"),
        F.array_sort(F.collect_list(F.when(frame.isNotNull(), F.struct("pos", frame.alias("f"))))).alias("placed"),
    )
    frames = F.transform("placed", lambda x: x["f"])
    root = F.get(F.filter(frames, lambda f: f["is_repo_frame"] & ~f["is_test_file"]), F.lit(0))
    return _renumbered(sections).select(
        "run_id", "ord", "test_name", F.coalesce("e.type", F.lit("Unknown")).alias("exception_type"), F.coalesce("e.message", F.lit("")).alias("error_message"),
        F.coalesce("best.line", "last.line", F.lit("")).alias("assertion_line"), F.coalesce(F.concat(root["file"], F.lit(":"), root["line"].cast("string")), F.lit("")).alias("root_frame"), frames.alias("frames"),
    )


def summary_failures(logs: DataFrame) -> DataFrame:
    """(run_id, pos, node): tests that the summary calls failed."""
    return _lines(logs).withColumn("line", strip(F.col("line"))).where(F.col("line").rlike(r"^FAILED\s+\S")).select("run_id", "pos", _grab(r"^FAILED\s+(\S+)", 1).alias("node"))


def parse_django_failures(logs: DataFrame) -> DataFrame:
    """(run_id, ord, test_name, exception_type, error_message, frames) of each ERROR or FAIL section."""
    w = Window.partitionBy("run_id", "log").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = _lines(logs).withColumn("line", strip(F.col("line")))
    head = F.when(F.col("line").rlike(DJANGO_HEADER), F.concat(_grab(DJANGO_HEADER, 3), F.lit("::"), _grab(DJANGO_HEADER, 2)))
    rule = F.contains("line", F.lit("---")) & (F.length("line") >= 60)
    numbered = lines.withColumn("name", head).withColumn("ord", F.count("name").over(w))
    inner = Window.partitionBy("run_id", "log", "ord").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    body = numbered.where("ord > 0").withColumn("rules", F.count_if(rule).over(inner)).where("rules < 2")  # one rule stands below the header, the next one ends the section
    error = F.when(F.col("line").rlike(DJANGO_ERROR), F.struct("pos", _grab(DJANGO_ERROR, 1).alias("type"), F.concat(_grab(DJANGO_ERROR, 1), F.lit(": "), F.substring(_grab(DJANGO_ERROR, 2), 1, 200)).alias("message")))
    frame = F.when(F.col("line").rlike(FILE_FRAME), F.struct("pos", _frame(_grab(FILE_FRAME, 1), _grab(FILE_FRAME, 2), _grab(FILE_FRAME, 3)).alias("f")))
    sections = body.groupBy("run_id", "log", "ord").agg(F.max("name").alias("test_name"), F.min(error).alias("e"), F.array_sort(F.collect_list(frame)).alias("placed"))
    return _renumbered(sections).select("run_id", "ord", "test_name", F.coalesce("e.type", F.lit("Unknown")).alias("exception_type"), F.coalesce("e.message", F.lit("")).alias("error_message"), F.transform("placed", lambda x: x["f"]).alias("frames"))


def django_results(logs: DataFrame) -> DataFrame:
    """(run_id, passed, failed, errors, ran): counts of result lines, and the number of tests run."""
    lines = _lines(logs).withColumn("line", strip(F.col("line")))
    is_ = lambda s: F.count_if(_grab(RESULT, 3) == s)
    return lines.groupBy("run_id").agg(is_("ok").alias("passed"), is_("FAIL").alias("failed"), is_("ERROR").alias("errors"), F.max_by(F.nullif(_grab(r"Ran\s+(\d+)\s+tests?\s+in", 1), F.lit("")).cast("int"), F.when(F.col("line").rlike(r"Ran\s+\d+\s+tests?\s+in"), F.col("pos"))).alias("ran"))


def reconcile_failures(sections: DataFrame, summary: DataFrame) -> DataFrame:
    """(run_id, n_sections, n_summary, n_matched, status): sections (run_id, ord, test_name) matched one to one with summary nodes (run_id, pos, node) of the same base name.

    Within a base name the matches number the lesser of both counts, whatever the order, so counting by base suffices.
    """
    base = lambda c: F.substring_index(F.element_at(F.split(c, "::"), -1), "[", 1)
    both = sections.select("run_id", base("test_name").alias("base"), F.lit(1).alias("s"), F.lit(0).alias("m")).unionByName(summary.select("run_id", base("node").alias("base"), F.lit(0).alias("s"), F.lit(1).alias("m")))
    per = both.groupBy("run_id", "base").agg(F.sum("s").alias("s"), F.sum("m").alias("m")).groupBy("run_id")
    total = per.agg(F.sum("s").alias("n_sections"), F.sum("m").alias("n_summary"), F.sum(F.least("s", "m")).alias("n_matched"))
    status = F.expr("""CASE WHEN n_matched = n_sections AND n_matched = n_summary THEN 'exact' WHEN n_sections = 0 THEN 'summary_only' WHEN n_summary = 0 THEN 'section_only' ELSE 'partial_mismatch' END""")
    return total.withColumn("status", status)


def align_evidence(clusters: DataFrame, views: DataFrame, edits: DataFrame) -> DataFrame:
    """(run_id, cluster, error_symbols, unviewed_files, unviewed_symbols, disjoint) of clusters (run_id, cluster, frames, messages); views and edits have (run_id, file)."""
    base = lambda c: F.array_distinct(F.transform(c, lambda f: F.substring_index(f, "/", -1)))
    seen = views.groupBy("run_id").agg(F.collect_set(F.substring_index("file", "/", -1)).alias("seen"))
    edited = edits.groupBy("run_id").agg(F.collect_set(F.substring_index("file", "/", -1)).alias("edited"))
    none = F.array().cast("array<string>")
    joined = clusters.join(seen.hint("merge"), "run_id", "left").join(edited.hint("merge"), "run_id", "left").withColumns({"seen": F.coalesce("seen", none), "edited": F.coalesce("edited", none)})
    files = F.array_distinct(F.transform("frames", lambda f: F.substring_index(f, ":", 1)))
    symbols = F.array_distinct(F.flatten(F.transform("messages", lambda m: F.regexp_extract_all(m, F.lit("['\"](\\w+)['\"]"), F.lit(1)))))
    unviewed = F.filter(files, lambda f: ~F.array_contains("seen", F.substring_index(f, "/", -1)))
    blind = F.filter(symbols, lambda s: ~F.exists("seen", lambda v: F.contains(v, s)))
    disjoint = (F.size("edited") > 0) & (F.size(unviewed) > 0) & ~F.arrays_overlap(base(unviewed), F.col("edited"))
    return joined.select("run_id", "cluster", symbols.alias("error_symbols"), unviewed.alias("unviewed_files"), blind.alias("unviewed_symbols"), disjoint.alias("disjoint"))


def classify_clusters(clusters: DataFrame) -> DataFrame:
    """(run_id, cluster, type, subtype, confidence) of clusters (run_id, cluster, n, messages, assertions), by the first rule that holds."""
    low = lambda c: F.lower(F.array_join(c, "\n"))
    numeric = low("assertions").rlike("allclose|almost_equal")
    cls = lambda t, sub, sure: F.struct(F.lit(t).alias("type"), sub.alias("subtype"), F.lit(sure).alias("confidence"))
    contract = F.when(F.col("n") == 1, "ARGUMENT_TYPE_MISMATCH").otherwise("FRAME_ATTRIBUTE_CONSTRAINT")
    kind = (
        F.when(numeric & F.contains(low("assertions"), F.lit(" via ")), cls("RELATED_TESTS", F.lit("ROUTE_COMPARISON_FAILURE"), "high"))
        .when(numeric, cls("RELATED_TESTS", F.lit("NUMERICAL_MISMATCH"), "medium"))
        .when(F.contains(low("messages"), F.lit("unexpected keyword")), cls("API_DEFINITION", F.lit("FRAME_ATTRIBUTE_PROPAGATION"), "high"))
        .when(F.contains(low("messages"), F.lit("unsupported operand")), cls("INTERFACE_CONSTRAINT", contract, "medium"))
        .otherwise(cls("NO_RELIABLE_DEFICIENCY", F.lit(""), "low"))
    )
    return clusters.select("run_id", "cluster", kind.alias("k")).select("run_id", "cluster", "k.*")


def diagnose_clusters(clusters: DataFrame, most: int = 5) -> DataFrame:
    """(run_id, cluster, type, subtype, confidence, targets, location) of clusters (run_id, cluster, n, messages, assertions, symbols, shared_frames, root_cause): the class, the symbols to look for and where.

    symbols are the error symbols of the alignment. A rejected keyword points at the quoted names
    of the first message and at the first shared frame, other classes at symbols and root cause.
    """
    classes = classify_clusters(clusters)
    both = clusters.join(classes.hint("merge"), ["run_id", "cluster"])
    quoted = F.array_distinct(F.regexp_extract_all(F.coalesce(F.get("messages", F.lit(0)), F.lit("")), F.lit("['\"](\\w+)['\"]"), F.lit(1)))
    frame, none = F.col("subtype") == "FRAME_ATTRIBUTE_PROPAGATION", F.col("type") == "NO_RELIABLE_DEFICIENCY"
    targets = F.when(none, F.array().cast("array<string>")).when(frame, F.when(F.size(quoted) > 0, quoted).otherwise(F.array(F.lit("<unknown>")))).otherwise(F.slice("symbols", 1, most))
    location = F.when(none, "").when(frame, F.coalesce(F.get("shared_frames", F.lit(0)), F.lit(""))).otherwise(F.coalesce("root_cause", F.lit("")))
    return both.select("run_id", "cluster", "type", "subtype", "confidence", targets.alias("targets"), location.alias("location"))


def related_tests(files: DataFrame, targets: DataFrame, views: DataFrame, budget: int = 5) -> DataFrame:
    """(target, path, score, seen): test files by how they mention a target (target, module): in the body 100 and more, imported 80, by path 60, by name 30.

    targets is a short list; files that mention none of its words in text or path don't join.
    """
    tests = files.where(F.lower("path").rlike(r"(^|/)(test|tests|testing)/|(^|/)test_[^/]*$|_test\.py$"))
    word = tests.withColumn("target", F.explode(F.array_distinct(F.regexp_extract_all(F.concat("path", F.lit(" "), "content"), F.lit(r"[A-Za-z0-9]+(?:_[A-Za-z0-9]+)*"), F.lit(0)))))
    hits = join_list(word, targets, "target")
    calls = F.size(F.expr("split(content, concat('\\\\b', target, '\\\\b'), -1)")) - 1
    score = F.when(calls > 0, 100 + calls).when(F.contains("content", F.concat(F.lit("import "), "module")), 80).when(F.contains("path", F.concat(F.lit("/"), "target", F.lit("/"))), 60).otherwise(30)
    ranked = hits.select("target", "path", score.alias("score")).withColumn("r", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), "path"))).where(F.col("r") <= budget)
    seen = views.select(F.col("file").alias("path")).distinct().withColumn("seen", F.lit(True))
    return ranked.join(seen.hint("merge"), "path", "left").select("target", "path", "score", F.coalesce("seen", F.lit(False)).alias("seen"))


def test_index(symbols: DataFrame) -> DataFrame:
    """(path, name, start_line, end_line): functions named test_* in test files, from symbols (path, name, kind, ...)."""
    return symbols.where((F.col("kind") == "def") & F.col("name").startswith("test_") & F.lower("path").rlike(r"(^|/)tests?/|(^|/)test_[^/]*$|_test\.py$")).select("path", "name", "start_line", "end_line")
