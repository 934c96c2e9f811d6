"""Failure witnesses of logs (run_id, log_text): the parser that fits a log is chosen and applied in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repairlens.functions.text import lines_py, strip
from repairlens.operators import dialects as dl
from repairlens.operators import logs as lg

# Parsers in order of precedence, the framework each stands for, and what a log it can parse holds (any entry, whose patterns all occur).
PARSERS = {
    "ansible": ("ansible_custom", [[r"(?m)^(?:PLAY|TASK)\s+\["], [dl.FATAL], [lg.PYTEST, r"(?i)ansible"]]),
    "cargo": ("cargo_test", [[dl.CARGO_TEST], [dl.CARGO_RESULT]]),
    "cpp": ("cpp_test", [[dl.COMPILE], [dl.MAKE], [dl.LINK], [r"FAILED\s+TEST"], [r"(?m)^\s*(?:FAILED|FAIL)\s*:"], [r"(?m)^\[  FAILED  \]"], [r"CMake\s+(?:Error|Warning)\s+at"]]),
    "go": ("go_test", [[lg.GO_TEST], [r"FAIL\s+\S+\s+\[build failed\]"], [r"(?m)^FAIL\s+\S+", lg.GO_LINE]]),
    "jvm": ("junit_gradle", [["BUILD FAILED", r"FAILURE:\s*Build failed with an exception"], ["BUILD FAILURE", dl.MAVEN], ["Tests FAILED"], [dl.TASK]]),
    "js": (
        "mocha_jest",
        [
            [r"(?m)^\s*\d+\s+failing", r"(?m)^\s*\d+\s+passing"],
            [r'(?s)^\s*\{.*"stats".*\}\s*$', '"failures"'],
            [r'"failures"\s*:\s*[1-9]', '"tests"|"passes"|"duration"', r"(?:Type|Assertion|Syntax|Reference|Range|Serverless)Error|at\s+\S+\.(?:js|ts|jsx|tsx):\d+"],
            [r"(?m)^\s*FAIL\s+\S+\.(?:js|ts|jsx|tsx)"],
        ],
    ),
    "pytest": ("pytest", [[lg.PYTEST]]),
}
_PARSE = {"ansible": dl.parse_ansible_witness, "cargo": dl.parse_cargo_witness, "cpp": dl.parse_cpp_witness, "go": lg.parse_go_witness, "jvm": dl.parse_jvm_witness, "js": dl.parse_js_witness, "pytest": lg.parse_pytest_witness}


def select_parser(logs: DataFrame, shortest: int = 20) -> DataFrame:
    """Adds parser to (log_text, stage, framework): only logs of failed validation, long enough, reach one; ``generic`` takes what no other can parse."""
    out = F.when((F.col("stage") != "validation_failure") | (F.length(strip(F.col("log_text"))) < shortest), "stage_detector")
    for name, (framework, shapes) in PARSERS.items():
        fits = F.col("framework") == framework
        for patterns in shapes:
            every = F.lit(True)
            for p in patterns:
                every = every & F.col("log_text").rlike(p)
            fits = fits | every
        out = out.when(fits, name)
    return logs.withColumn("parser", F.coalesce(out.otherwise("generic"), F.lit("stage_detector")))


# Places of frames in each dialect's logs (file and line, groups 1 and 2), and how many stay.
PY_FRAME = r'(?m)^\s*File\s+"([^"]+)",\s+line\s+(\d+)'
GO_FRAME = r"(?m)^\s*(\S+\.go):(\d+)(?:\s+\+0x[0-9a-f]+)?"
RUST_FRAME = r"thread\s+'[^']+'\s+panicked\s+at\s+(\S+):(\d+):\d+"
JS_STACK = r"at\s+(?:\w+\s+)?\(?(?:file://)?([^:)]+):(\d+)"
JEST_FILE = r"(?m)^\s*FAIL\s+(\S+\.(?:js|ts|jsx|tsx))"
JEST_AT = r"at\s+.+?\s+\(([^:)]+):(\d+):\d+\)"
TRACEBACK = r"Traceback[^\n]*\n"
MOST_FRAMES, OWN_FRAMES, OUTER_FRAMES = 20, 10, 3


def _frames(text: Column, pattern: str) -> Column:
    """File "a", line n of each match."""
    pair = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("f"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("n"))
    return F.transform(pair, lambda x: F.concat(F.lit('File "'), x["f"], F.lit('", line '), x["n"]))


def _own_first(frames: Column) -> Column:
    """Frames of the repository before those of packages, a few of each."""
    outer = lambda f: F.contains(f, F.lit("node_modules/"))
    return F.concat(F.slice(F.filter(frames, lambda f: ~outer(f)), 1, OWN_FRAMES), F.slice(F.filter(frames, outer), 1, OUTER_FRAMES))


def _js_frames() -> Column:
    """The stack of the first failure of Mocha's JSON that has one, a frame from each of its parts; else Jest's or Mocha's places in the text."""
    log = F.col("log_text")
    stacks = F.from_json(F.regexp_extract("log_text", r'(?s)(\{\s*"stats".*\})', 1), "failures array<struct<err:struct<stack:string>>>")["failures"]["err"]["stack"]
    stack = F.get(F.filter(stacks, lambda s: F.coalesce(s, F.lit("")) != ""), F.lit(0))
    parts = F.split(stack, r"\\n")
    told = F.array_distinct(F.filter(F.transform(parts, lambda p: F.get(_frames(p, JS_STACK), F.lit(0))), lambda f: f.isNotNull()))
    json = F.contains(log, F.lit('"failures"')) & F.contains(log, F.lit('"stats"')) & stacks.isNotNull()
    none = F.array().cast("array<string>")
    return F.when(json, _own_first(F.coalesce(told, none))).when(log.rlike(JEST_FILE), _frames(log, JEST_AT)).otherwise(_own_first(_frames(log, JS_STACK)))


def frames_of(parser: str) -> Column:
    """The stack trace that a parser finds in log_text, as File "a", line n; the build tools of Java tell none."""
    log, none = F.col("log_text"), F.array().cast("array<string>")
    if parser == "go":
        lines = _frames(log, lg.GO_LINE)
        found = F.concat(lines, F.array_except(_frames(log, GO_FRAME), lines))
    elif parser == "ansible":
        return F.when(log.rlike(lg.PYTEST), _frames(log, PY_FRAME)).otherwise(none)
    elif parser == "pytest":
        return _frames(log, PY_FRAME)
    elif parser == "generic":
        after = F.expr("substring(log_text, instr(log_text, 'Traceback'))")
        whole = log.rlike(TRACEBACK) & after.rlike(r"\n[^\n]*\w(?:Error|Exception):")
        until = F.regexp_replace(after, r"(?s)^(.*\n[^\n]*\w(?:Error|Exception):).*$", "$1")
        found = F.when(whole, F.filter(F.transform(F.split(until, "\n"), strip), lambda x: F.contains(x, F.lit('File "')))).otherwise(none)
    else:
        found = {"cargo": lambda: _frames(log, RUST_FRAME), "cpp": lambda: _frames(log, dl.COMPILE), "js": _js_frames, "jvm": lambda: none}[parser]()
    return F.slice(found, 1, MOST_FRAMES)


def _told(name: str) -> Column:
    """The witness of one parser, with the same fields for all."""
    w = _PARSE[name]()
    some = lambda c: F.coalesce(w[c], F.lit("")) != ""
    stage = w["stage"] if name in ("cpp", "jvm") else F.when(w["failure_type"] == "build_failure", dl.BUILD).otherwise(dl.VALIDATION) if name == "go" else F.lit(dl.VALIDATION)
    return F.struct(stage.alias("stage"), w["failed_tests"].alias("failed_tests"), w["message"].alias("message"), w["failure_type"].alias("failure_type"), (some("expected") & some("actual")).alias("has_expected"), frames_of(name).alias("stack_trace"))


def _context() -> Column:
    """The first 20 and last 10 lines of a log of more than 30, else all of it."""
    lines = lines_py(strip(F.col("log_text")))
    return F.substring(F.when(F.size(lines) > 30, F.array_join(F.concat(F.slice(lines, 1, 20), F.array(F.lit("...")), F.slice(lines, -10, 10)), "\n")).otherwise(F.col("log_text")), 1, 2000)


def build_witnesses(logs: DataFrame, shortest: int = 20) -> DataFrame:
    """(run_id, stage, framework, parser, failed_tests, message, failure_type, quality, stack_trace): one row for each row of logs; null logs count as empty.

    Logs of other stages than validation, and too short ones, reach no parser: they have the
    stage's failure type (``empty_log`` for the short ones) and what the log says. A parser may
    tell another stage than the patterns did, as compile errors do. Each expression on the text
    is evaluated for the rows of its own parser alone.
    """
    clean = logs.select("run_id", F.coalesce("log_text", F.lit("")).alias("log_text"))
    routed = select_parser(lg.test_framework(lg.failure_stage(lg.normalize_logs(clean))), shortest)
    none = F.array().cast("array<string>")
    other = lg.parse_generic_witness()
    plain = lambda stage, message, kind, trace: F.struct(stage.alias("stage"), none.alias("failed_tests"), message.alias("message"), kind.alias("failure_type"), F.lit(False).alias("has_expected"), trace.alias("stack_trace"))
    table = F.create_map(*(F.lit(x) for kv in lg.STAGE_TYPES.items() for x in kv))
    early = F.when(F.col("stage") == "validation_failure", "empty_log").otherwise(F.try_element_at(table, F.col("stage")))
    told = F.when(F.col("parser") == "stage_detector", plain(F.col("stage"), _context(), early, none))
    for name in PARSERS:
        told = told.when(F.col("parser") == name, _told(name))
    full = routed.withColumn("w", told.otherwise(plain(F.lit("validation_failure"), other["message"], other["failure_type"], frames_of("generic")))).select("run_id", "framework", "parser", "w.*")
    full = full.withColumns({"observed": F.lit(True), "has_tests": F.size("failed_tests") > 0, "has_trace": F.size("stack_trace") > 0, "has_witness": F.col("parser") != "stage_detector"})
    return lg.witness_quality(full).select("run_id", "stage", "framework", "parser", F.array_join("failed_tests", ",").alias("failed_tests"), "message", "failure_type", "quality", "stack_trace")
