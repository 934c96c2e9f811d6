"""Test logs (run_id, log_text): stages, frameworks and failure witnesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repairlens.functions.text import first_match, lines_py, strip

# Patterns of failure stages and frameworks, in order of precedence.
STAGES = [
    ("patch_apply_failure", [r"(?i)patch\s+does\s+not\s+apply", r"(?i)error:\s+patch\s+failed", r"(?i)apply_error"]),
    (
        "dependency_or_environment_failure",
        [r"(?i)ModuleNotFoundError", r"(?i)ImportError", r"(?i)cannot\s+find\s+command", r"(?i)command\s+not\s+found", r"(?i)bash:.*syntax error", r"(?i)Build failed with an exception", r"(?i)BUILD FAILED", r"(?i)make.*Error \d+", r"(?i)\[build failed\]"],
    ),
    ("test_collection_failure", [r"(?i)ERROR:\s+collection", r"(?i)INTERNALERROR>", r"(?i)could\s+not\s+collect"]),
    ("timeout", [r"(?i)^timeout", r"(?i)timeout\s+occurred", r"(?i)timed\s+out"]),
    ("validation_failure", [r"(?i)FAILED", r"(?i)Error", r"(?i)traceback", r"(?i)assert"]),
]
FRAMEWORKS = [
    ("pytest", [r"(?m)^=+\s*FAILURES\s*=", r"FAILED\s+\S+\.py::", r"\[FAIL\]", r"(?s)Traceback.*AssertionError"]),
    ("unittest", [r"(?m)^FAIL:\s+", r"(?m)^ERROR:\s+"]),
    ("go_test", [r"---\s+FAIL:", r"FAIL\s+\S+\s+\[build\s+failed\]"]),
    ("cargo_test", [r"test result: FAILED", r"error\[E\d+\]", r"(?i)error: test failed"]),
    ("junit_gradle", [r"FAILURE:\s+", r"(?i)Gradle\s+Test\s+Run"]),
    ("mocha_jest", [r"\d+\s+failing", r"\d+\s+passing", r"AssertionError", r'"stats"\s*:\s*\{[^}]*"failures"\s*:\s*\d+']),
    ("cpp_test", [r"FAILED\s+TEST", r"FAIL:\s+"]),
    ("ansible_custom", [r"fatal:", r"FAILED!"]),
]
# Failure types of the stages that reach no parser, and of the rest.
STAGE_TYPES = {
    "patch_apply_failure": "git_apply", "dependency_or_environment_failure": "build_or_infra_failure", "test_collection_failure": "collect_error",
    "timeout": "timeout", "validation_failure": "test_failure", "unknown_failure": "unknown",
}
# Patterns of failed tests, places and claims.
NODE = r"(?m)FAILED\s+(\S+?)::(\S+?)(?:\s+-?\s*.*)?$"
GO_TEST = r"(?m)^\s*---\s+FAIL:\s+(Test\w+)\s+"
GO_LINE = r"(?m)^\s*(\S+\.go):(\d+):\s*(.*)"
GO_WANT = r"(?i)(?:expected|expect|want)[:\s]*([^,]+)(?:,| but got| got| received)[:\s]*(.+)"
FAIL_LINE = r"(?im)(?:FAIL|FAILED|ERROR|fatal)\s*:?\s*(.*)"
ERROR_LINE = r"AssertionError|assert|\w(?:Error|Exception):"
PYTEST = r"(?m)^=+\s*FAILURES\s*=|FAILED\s+\S+?::\S+|^(?:FAIL|ERROR):\s+"
# What a Python log holds, and the failure type that goes with it, in order of precedence.
PYTHON_TYPES = {"AssertionError": "assertion_error", "Timeout": "timeout", "ImportError": "import_error", "TypeError": "type_error", "ValueError": "value_error", "AttributeError": "attribute_error", "KeyError": "key_error", "IndexError": "index_error"}


def _all(pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all("log_text", F.lit(pattern), F.lit(group))


def shape(logs: DataFrame | None, *columns: Column):
    """The columns as a table by run_id, or as one struct where no table is given."""
    return F.struct(*columns) if logs is None else logs.select("run_id", *columns)


def normalize_logs(logs: DataFrame, strip_prefixes: bool = False) -> DataFrame:
    """Without colour codes, with line feeds only, and without remote line prefixes if asked for."""
    text = F.regexp_replace(F.regexp_replace("log_text", r"\x1B\[[0-9;]*[a-zA-Z]", ""), r"\r\n?", "\n")
    return logs.withColumn("log_text", F.regexp_replace(text, r"(?m)^\[?[a-zA-Z]+\s+\d+\s+\S+\]?\s+", "") if strip_prefixes else text)


def failure_stage(logs: DataFrame) -> DataFrame:
    return logs.withColumn("stage", first_match(F.col("log_text"), STAGES, "unknown_failure"))


def test_framework(logs: DataFrame) -> DataFrame:
    return logs.withColumn("framework", first_match(F.col("log_text"), FRAMEWORKS, "generic"))


def matched_patterns(logs: DataFrame) -> DataFrame:
    """Adds stages and frameworks, each with all names of which a pattern is found."""
    names = lambda rules: F.array_compact(F.array(*(first_match(F.col("log_text"), [r], None) for r in rules)))
    return logs.withColumns({"stages": names(STAGES), "frameworks": names(FRAMEWORKS)})


def parse_pytest_witness(logs: DataFrame | None = None):
    """(run_id, failed_tests, n_frames, expected, actual, message, failure_type) of Python logs; message is the first line that tells an error, else the last line."""
    nodes = F.zip_with(_all(NODE, 1), _all(NODE, 2), lambda a, b: F.concat(a, F.lit("::"), b))
    named = F.zip_with(_all(r"(\S+\.py)::(\S+)", 1), _all(r"(\S+\.py)::(\S+)", 2), lambda a, b: F.concat(a, F.lit("::"), b))
    plain = _all(r"(?m)^FAIL:\s+(\S+)", 1)
    tests = F.when(F.size(nodes) > 0, nodes).when(F.size(named) > 0, named).otherwise(plain)
    unequal = r"(?:AssertionError|assert):?\s+(.*?)\s*!=\s*(.*)"
    side = lambda g: F.nullif(strip(F.regexp_extract("log_text", unequal, g)), F.lit(""))
    lines = lines_py(F.col("log_text"))
    told = F.coalesce(F.get(F.filter(lines, lambda x: x.rlike(ERROR_LINE)), F.lit(0)), F.when(F.size(lines) > 0, F.element_at(lines, -1)), F.lit(""))
    kind = F.coalesce(*(F.when(F.contains("log_text", F.lit(name)), kind) for name, kind in PYTHON_TYPES.items()), F.lit("test_failure"))
    frames = F.size(_all(r'(?m)^\s*File\s+"([^"]+)",\s+line\s+(\d+)'))
    return shape(logs, tests.alias("failed_tests"), frames.alias("n_frames"), side(1).alias("expected"), side(2).alias("actual"), F.substring(strip(told), 1, 500).alias("message"), kind.alias("failure_type"))


def parse_go_witness(logs: DataFrame | None = None):
    """(run_id, failed_tests, message, expected, actual, failure_type) of Go logs."""
    builds, tests = _all(r"FAIL\s+(\S+)\s+\[build failed\]", 1), _all(GO_TEST, 1)
    said = F.filter(F.transform(_all(GO_LINE, 3), strip), lambda m: (m != "") & (F.length(m) < 300))
    panic = F.regexp_extract("log_text", r"panic:\s*(.*)", 1)
    message = (
        F.when(F.size(builds) > 0, F.concat(F.lit("Build failed: "), F.get(builds, F.lit(0))))
        .when((F.size(tests) > 0) & (F.size(said) > 0), F.substring(F.get(said, F.lit(0)), 1, 500))
        .when(F.col("log_text").rlike("panic:"), F.concat(F.lit("Panic: "), F.substring(panic, 1, 200)))
        .otherwise("test_failure")
    )
    first = F.get(F.filter(_all(GO_LINE, 3), lambda m: m.rlike(GO_WANT)), F.lit(0))
    side = lambda g: F.substring(strip(F.regexp_extract(first, GO_WANT, g)), 1, 200)
    kind = F.when(F.size(builds) > 0, "build_failure").when(F.col("log_text").rlike("panic:"), "panic").when(F.contains(F.lower("log_text"), F.lit("timeout")), "timeout").otherwise("test_failure")
    return shape(logs, F.slice(tests, 1, 20).alias("failed_tests"), message.alias("message"), side(1).alias("expected"), side(2).alias("actual"), kind.alias("failure_type"))


def parse_generic_witness(logs: DataFrame | None = None, most: int = 5):
    """(run_id, message, failure_type): the first failure lines, else the last line; the exit code where one is told."""
    lines = F.transform(_all(FAIL_LINE), strip)
    last = F.element_at(F.split(strip(F.col("log_text")), "\n"), -1)
    message = F.when(F.size(lines) > 0, F.array_join(F.slice(lines, 1, most), "\n")).otherwise(strip(last))
    code = F.regexp_extract("log_text", r"(?i)exit code[:\s]*(\d+)", 1)
    return shape(logs, F.substring(message, 1, 2000).alias("message"), F.when(code != "", F.concat(F.lit("exit_code_"), code)).otherwise("test_failure").alias("failure_type"))


def witness_quality(witnesses: DataFrame) -> DataFrame:
    """Adds quality to (observed, stage, has_expected, has_trace, has_tests, has_witness)."""
    quality = F.expr("""CASE WHEN NOT observed THEN 'none' WHEN stage <> 'validation_failure' THEN 'infrastructure_only' WHEN has_expected AND has_trace AND has_tests THEN 'high'
      WHEN has_trace OR has_tests THEN 'medium' WHEN has_witness THEN 'low' ELSE 'minimal' END""")
    return witnesses.withColumn("quality", quality)


def normalize_frames(frames: DataFrame) -> DataFrame:
    """Adds file (within the repository), is_repo_frame and is_test_file to (path)."""
    path = F.col("path")
    file = F.when(F.contains(path, F.lit("/testbed/")), F.expr("substring(path, instr(path, '/testbed/') + 9)")).otherwise(path)
    repo = ~path.rlike(r"^[<>\[]") & (path != "") & (F.contains(path, F.lit("/testbed/")) | (~path.rlike(r"^/|site-packages/|dist-packages/")))
    test = F.lower(file).rlike(r"(^|/)(test|tests|testing)/|(^|/)test_[^/]*$|_test\.py$")
    return frames.withColumns({"file": file, "is_repo_frame": repo, "is_test_file": repo & test})


def error_tokens(logs: DataFrame, stop: list[str]) -> DataFrame:
    """(run_id, token): names of exceptions and warnings and failed nodes, each once, without stop words."""
    found = F.concat(_all(r"\b(\w+(?:Error|Exception|Warning))\b", 1), _all(r"FAILED\s+\S+?::(\w+)", 1))
    return logs.select("run_id", F.explode(F.array_except(found, F.array(*(F.lit(s) for s in stop)))).alias("token")).distinct()


def stage_authority(staged: DataFrame, evals: DataFrame) -> DataFrame:
    """Stage from the log (run_id, stage), overruled by what evaluation recorded (run_id, patch_applied, timed_out)."""
    ruled = F.expr("CASE WHEN NOT patch_applied THEN 'patch_apply_failure' WHEN timed_out THEN 'timeout' ELSE stage END")
    return staged.join(evals, "run_id", "left").select("run_id", "stage", ruled.alias("ruled_stage"))


# Words of error messages that name no symbol.
NOISE = [
    "True", "False", "None", "Error", "Warning", "Exception",
    "Std", "Linux", "Windows", "Mac", "OSError", "Errno",
    "Python", "File", "Line", "Raised", "During", "Handling",
    "Collecting", "Installing", "Downloading", "Successfully",
    "Short", "Total", "Config", "Found", "Ran", "Docs",
]


def parse_traceback_frames(witnesses: DataFrame) -> DataFrame:
    """(run_id, pos, file, line, function) of (run_id, trace array, message): frames of the trace lines, else of the message, else failed nodes as frames."""
    shape = r'File "([^"]+)", line (\d+)(?:, in (\S+))?'
    grab = lambda text, p: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, p, 1).alias("file"), F.regexp_extract(m, p, 2).alias("line"), F.regexp_extract(m, p, 3).alias("function")))
    traced, said = grab(F.array_join("trace", "\n"), shape), grab(F.coalesce("message", F.lit("")), shape)
    node = r"FAILED\s+(\S+?)::(\S+)"
    nodes = F.transform(F.regexp_extract_all(F.coalesce("message", F.lit("")), F.lit(node), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, node, 1).alias("file"), F.lit("0").alias("line"), F.regexp_extract(m, node, 2).alias("function")))
    best = F.when(F.size(traced) > 0, traced).when(F.size(said) > 0, said).otherwise(nodes)
    return witnesses.select("run_id", F.posexplode(best).alias("pos", "f")).select("run_id", "pos", F.when(F.contains("f.file", F.lit("/")) | (F.col("f.line") != "0"), F.col("f.file")).otherwise(F.concat(F.lit("tests/"), "f.file")).alias("file"), F.col("f.line").cast("int").alias("line"), "f.function")


def stack_source_files(frames: DataFrame) -> DataFrame:
    """(run_id, rank, name, line, is_test): the first frame of each base name, files that are no tests first, then by line."""
    named = frames.withColumn("name", F.substring_index("file", "/", -1))
    first = named.groupBy("run_id", "name").agg(F.min_by("line", "pos").alias("line"), F.min("pos").alias("pos")).withColumn("is_test", F.contains(F.lower("name"), F.lit("test")))
    order = Window.partitionBy("run_id").orderBy("is_test", "line", "pos")
    return first.select("run_id", (F.row_number().over(order) - 1).alias("rank"), "name", "line", "is_test")


def error_symbols(witnesses: DataFrame, most: int = 6) -> DataFrame:
    """(run_id, symbols) of (run_id, functions array, message): distinct function names in order, else capitalised names of the message without noise."""
    named = F.array_distinct(F.filter("functions", lambda f: f != ""))
    said = F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce("message", F.lit("")), F.lit(r"\b[A-Z][a-zA-Z0-9_]*(?:\.[a-zA-Z_]\w*)*"), F.lit(0)), lambda s: (F.length(s) > 2) & ~s.isin(NOISE)))
    return witnesses.select("run_id", F.when(F.size(named) > 0, named).otherwise(F.slice(said, 1, most)).alias("symbols"))


def fuse_log_and_witness(log_signals: DataFrame, witnesses: DataFrame) -> DataFrame:
    """(run_id, failed_tests, first_error) of both, each (run_id, failed_tests, first_error): tests of the log come first, the witness fills gaps."""
    none = F.array().cast("array<string>")
    both = log_signals.alias("l").join(witnesses.alias("w"), "run_id", "full")
    tests = F.array_distinct(F.concat(F.coalesce("l.failed_tests", none), F.coalesce("w.failed_tests", none)))
    return both.select("run_id", tests.alias("failed_tests"), F.coalesce(F.nullif("l.first_error", F.lit("")), F.nullif("w.first_error", F.lit("")), F.lit("")).alias("first_error"))


def fuse_frames(log_frames: DataFrame, witness_frames: DataFrame) -> DataFrame:
    """(run_id, pos, file, line, function, source) of both, each (run_id, pos, file, line, function): frames of the log first, as they are, then those of the witness that it doesn't have, each once, with the path in the repository.

    Frames are the same if path within the repository, line and function are.
    """
    inner = F.when(F.contains("file", F.lit("/testbed/")), F.expr("substring(file, instr(file, '/testbed/') + 9)")).otherwise(F.coalesce("file", F.lit("")))
    filled = lambda df: df.select("run_id", "pos", "file", inner.alias("path"), F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("function", F.lit("")).alias("function"))
    log, told = filled(log_frames), filled(witness_frames)
    key = ["run_id", "path", "line", "function"]
    new = told.groupBy(*key).agg(F.min("pos").alias("pos")).join(log.select(*key).distinct().hint("merge"), key, "left_anti")
    both = log.select("run_id", F.lit(0).alias("step"), "pos", "file", "line", "function").unionByName(new.select("run_id", F.lit(1).alias("step"), "pos", F.col("path").alias("file"), "line", "function"))
    order = Window.partitionBy("run_id").orderBy("step", "pos", "file", "line", "function")
    return both.select("run_id", (F.row_number().over(order) - 1).alias("pos"), "file", "line", "function", F.when(F.col("step") == 0, "log").otherwise("witness").alias("source"))


# Error types that are counted in a witness's message.
COUNTED_TYPES = ["TypeError", "AssertionError", "AttributeError", "ValueError", "ImportError"]


def fuse_error_types(logs: DataFrame, witnesses: DataFrame) -> DataFrame:
    """(run_id, error_type, n): counts of the log (run_id, error_messages array, error_types map) plus one for each counted type in the witness's message (run_id, error_message), if the log doesn't have that message already."""
    told = logs.select("run_id", F.explode("error_types").alias("error_type", "n"))
    said = witnesses.where("error_message <> ''").join(logs.select("run_id", "error_messages").hint("merge"), "run_id", "left").where(~F.coalesce(F.array_contains("error_messages", F.col("error_message")), F.lit(False)))
    named = said.select("run_id", F.explode(F.filter(F.array(*(F.lit(t) for t in COUNTED_TYPES)), lambda t: F.contains("error_message", t))).alias("error_type"))
    return told.select("run_id", "error_type", F.col("n").cast("long").alias("n")).unionByName(named.withColumn("n", F.lit(1).cast("long"))).groupBy("run_id", "error_type").agg(F.sum("n").alias("n"))


# Tokens too general to point anywhere, exceptions of the language, files that are never an origin, and the patterns of each signal.
GENERIC_TOKENS = ["Error", "Exception", "Warning", "DeprecationWarning", "UserWarning", "RuntimeWarning", "FutureWarning", "SyntaxWarning", "PendingDeprecationWarning", "ResourceWarning"]
BUILTIN_EXCEPTIONS = [
    "TypeError", "ValueError", "KeyError", "AttributeError", "IndexError", "NameError", "ImportError", "ModuleNotFoundError", "FileNotFoundError", "RuntimeError",
    "StopIteration", "NotImplementedError", "ZeroDivisionError", "OverflowError", "AssertionError", "UnboundLocalError",
]
GENERIC_ORIGINS = ["__init__.py", "__main__.py", "conftest.py", "runtests.py", "setup.py", "sitecustomize.py", "usercustomize.py"]
EXCEPTION = r"\b([A-Z][A-Za-z0-9_]*(?:Error|Exception|Warning))\b"
CHECK_CODE = r"\b[EW]\d{3,4}\b"
WARNED = r"warnings\.warn\(([A-Za-z_][A-Za-z0-9_]*)"
STACK_FILE = r'File "([^"]+)", line (\d+)'


def error_signals(logs: DataFrame) -> DataFrame:
    """(run_id, kind, pos, token): exception names, warning categories, check codes, failed tests, stack files and origin files that a log tells, each once in order.

    Names too general are left out; stack files are base names, origin files those that are
    neither tests nor entry points. Rows that repeat a run_id are read one by one.
    """
    names = F.filter(F.array_distinct(_all(EXCEPTION, 1)), lambda t: ~t.isin(GENERIC_TOKENS))
    warned = F.filter(F.array_distinct(_all(WARNED, 1)), lambda t: t.endswith("Warning") & ~t.isin(GENERIC_TOKENS))
    nodes = F.array_distinct(F.zip_with(_all(r"FAILED\s+(\S+?)::(\S+)", 1), _all(r"FAILED\s+(\S+?)::(\S+)", 2), lambda a, b: F.concat(a, F.lit("::"), b)))
    stack = F.array_distinct(F.transform(_all(STACK_FILE, 1), lambda f: F.substring_index(f, "/", -1)))
    test = lambda f: F.lower(f).rlike(r"^test_|^conftest|_test\.|^test[^.]*\.")
    general = lambda f: F.lower(F.trim(f)).isin(GENERIC_ORIGINS) | f.rlike(r"^\s*<.*>\s*$")
    origin = F.filter(stack, lambda f: ~test(f) & ~general(f))
    kinds = {"exception": names, "warning_code": warned, "check_code": F.array_distinct(_all(CHECK_CODE)), "failed_test": nodes, "stack_file": stack, "origin_file": origin}
    placed = lambda kind, tokens: F.transform(tokens, lambda t, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), t.alias("token")))
    each = F.flatten(F.array(*(placed(kind, tokens) for kind, tokens in kinds.items())))
    return logs.where("log_text IS NOT NULL").select("run_id", F.explode(each).alias("s")).select("run_id", "s.*")


def specific_tokens(signals: DataFrame, internal: str = r"^Pytest|^_pytest") -> DataFrame:
    """(run_id, token) of error_signals() that may point at an origin: exceptions that are no builtin ones, warning categories and check codes; ``internal`` matches names of the test framework itself."""
    named = F.col("kind").isin("exception", "warning_code") & ~F.col("token").rlike(internal) & ~((F.col("kind") == "exception") & F.col("token").isin(BUILTIN_EXCEPTIONS))
    return signals.where(named | (F.col("kind") == "check_code")).select("run_id", "token").distinct()
