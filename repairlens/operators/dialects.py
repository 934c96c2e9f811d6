"""Witnesses of further log dialects: Rust, C and C++, Java build tools, Ansible, JavaScript.

Each gives (run_id, stage, failure_type, failed_tests, message, expected, actual) of logs (run_id, log_text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repairlens.functions.text import strip
from repairlens.operators.logs import PYTEST, parse_pytest_witness, shape

# Stages, and patterns of the dialects.
VALIDATION, BUILD = "validation_failure", "dependency_or_environment_failure"
CARGO_TEST = r"test\s+(\S+)\s+\.\.\.\s+FAILED"
CARGO_RESULT = r"test result: FAILED\.\s*(\d+) passed;\s*(\d+) failed"
PANIC = r"thread\s+'([^']+)'\s+panicked\s+at\s+(\S+):(\d+):(\d+)"
COMPILE = r"(?m)^\s*(?:/.*?)?(\S+\.(?:c|cpp|cxx|cc|h|hpp)):(\d+):(\d+):\s*error:\s*(.*)"
LINK = r"(?i)undefined reference|ld:\s*cannot find|cannot find -l|collect2:\s*error"
MAKE = r"make(?:\[\d+\])?:\s*\*\*\*\s*\[.*\]\s*(?:Error|exit)\s*(\d+)"
GTEST = r"(?m)^\[  FAILED  \]\s+(.+)$"
WRONG = r"(?s)\*\s*What went wrong:\s*\n(.*?)(?:\n\s*\*|\z)"
TASK = r"(?m)^>\s*Task\s+(\S+)\s+FAILED"
MAVEN = r"Tests run:\s*(\d+),\s*Failures:\s*(\d+),\s*Errors:\s*(\d+)"
JUNIT = r"(?:java\.lang\.)?(AssertionError|AssertionFailedError|ComparisonFailure):\s*(.*)"
JUNIT_SIDES = r"expected:\s*<(.*?)>\s*but\s*was:\s*<(.*?)>"
FATAL = r"fatal:\s*\[[^\]]+\]:\s*FAILED!"
_LOG = "log_text"


def _all(pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_LOG, F.lit(pattern), F.lit(group))


def _one(pattern: str, group: int) -> Column:
    """The group of the first match; null without one."""
    return F.nullif(F.regexp_extract(_LOG, pattern, group), F.lit(""))


def _has(pattern: str) -> Column:
    return F.col(_LOG).rlike(pattern)


def _witness(logs: DataFrame | None, stage, kind, tests, message, expected=None, actual=None) -> DataFrame:
    text = lambda c: F.lit(c).cast("string") if c is None or isinstance(c, str) else c
    return shape(logs, text(stage).alias("stage"), text(kind).alias("failure_type"), F.slice(tests, 1, 20).alias("failed_tests"), F.substring(text(message), 1, 2000).alias("message"), text(expected).alias("expected"), text(actual).alias("actual"))


def _block(name: str) -> Column:
    """What stands between two lines of tildes below a heading."""
    inner = F.regexp_extract(_LOG, rf"(?m)^{name}:[^\n]*\n~{{10,}}[^\n]*\n((?:(?!~{{10,}})[^\n]*\n)*)~{{10,}}", 1)
    return F.nullif(F.substring(F.array_join(F.transform(F.slice(F.split(strip(inner), "\n"), 1, 10), strip), "\n"), 1, 500), F.lit(""))


def parse_cargo_witness(logs: DataFrame | None = None):
    """Rust: what follows the place of the first panic, else the summary."""
    tests = _all(CARGO_TEST, 1)
    after = F.nullif(strip(F.regexp_extract(_LOG, PANIC + r"[^\n]*\n([^\n]*)", 5)), F.lit(""))
    said = F.when(~F.coalesce(after, F.lit("~")).startswith("~"), F.substring(after, 1, 500)).otherwise(F.concat(F.lit("Panicked at "), _one(PANIC, 2), F.lit(":"), _one(PANIC, 3)))
    counts = F.concat(F.lit("("), _one(CARGO_RESULT, 1), F.lit(" passed, "), _one(CARGO_RESULT, 2), F.lit(" failed)"))
    n = F.concat(F.size(tests).cast("string"), F.lit(" test(s) failed"))
    message = F.when(_has(PANIC), said).when(_has(CARGO_RESULT) & (F.size(tests) > 0), F.concat(n, F.lit(" "), counts)).when(_has(CARGO_RESULT), F.concat(F.lit("Test run failed "), counts)).when(F.size(tests) > 0, n).otherwise("test_failure")
    kind = F.when(_has("(?i)panicked"), "panic").when(_has("(?i)assert"), "assertion_error").otherwise("test_failure")
    return _witness(logs, VALIDATION, kind, tests, message, _block("expected"), _block("got"))


def parse_cpp_witness(logs: DataFrame | None = None):
    """C and C++: compile and link errors, then make, then failed tests."""
    tests = F.transform(_all(GTEST, 1), strip)
    first = F.concat(_one(COMPILE, 1), F.lit(":"), _one(COMPILE, 2), F.lit(": error: "), F.substring(strip(F.regexp_extract(_LOG, COMPILE, 4)), 1, 200))
    broken = _has(COMPILE) | _has(LINK)
    lines = F.filter(F.transform(F.split(strip(F.col(_LOG)), "\n"), strip), lambda x: x != "")
    tail = F.slice(lines, F.greatest(F.size(lines) - 9, F.lit(1)), 10)
    told = F.element_at(F.filter(tail, lambda x: F.lower(x).rlike("error|fail")), -1)
    fallback = F.substring(F.coalesce(F.when(F.size(F.filter(tail, lambda x: F.lower(x).rlike("error|fail"))) > 0, told), F.get(lines, F.size(lines) - 1), F.lit("test_failure")), 1, 500)
    message = (
        F.when(broken, F.coalesce(first, F.lit("compile/build failure")))
        .when(_has(MAKE), F.concat(F.lit("make failed: "), F.substring(F.regexp_extract(_LOG, MAKE, 0), 1, 200)))
        .when(F.size(tests) > 0, F.concat(F.size(tests).cast("string"), F.lit(" test(s) failed")))
        .otherwise(fallback)
    )
    kind = F.when(broken, "compile_error").when(_has(MAKE), "build_failure").otherwise("test_failure")
    return _witness(logs, F.when(broken | _has(MAKE), BUILD).otherwise(VALIDATION), kind, tests, message)


def parse_jvm_witness(logs: DataFrame | None = None):
    """Gradle, then Maven, then JUnit output."""
    gradle, maven = _has("BUILD FAILED"), _has("BUILD FAILURE")
    runs = F.arrays_zip(_all(MAVEN, 1).alias("r"), _all(MAVEN, 2).alias("f"), _all(MAVEN, 3).alias("e"))
    bad = F.transform(F.filter(runs, lambda x: (x["f"] != "0") | (x["e"] != "0")), lambda x: F.concat(F.lit("run="), x["r"], F.lit(" fail="), x["f"], F.lit(" err="), x["e"]))
    named = F.filter(F.transform(_all(r"Failed tests:\s*\n\s+([^\n]+)", 1), strip), lambda t: F.contains(t, F.lit(":")) & ~t.startswith("["))
    failed = F.concat(bad, named)
    tests = F.when(gradle, _all(TASK, 1)).when(maven, failed).otherwise(F.array().cast("array<string>"))
    wrong = F.nullif(F.substring(strip(F.regexp_extract(_LOG, WRONG, 1)), 1, 500), F.lit(""))
    claim = F.when(_has(JUNIT), F.concat(_one(JUNIT, 1), F.lit(": "), F.substring(strip(F.regexp_extract(_LOG, JUNIT, 2)), 1, 200)))
    message = F.when(gradle, F.coalesce(wrong, F.lit("Gradle build failed"))).when(maven & (F.size(failed) > 0), F.concat(F.size(failed).cast("string"), F.lit(" test(s) failed"))).when(maven, "build_failure").otherwise(F.coalesce(claim, F.lit("test_failure")))
    plain = ~gradle & ~maven
    side = lambda g: F.when(plain, F.substring(_one(JUNIT_SIDES, g), 1, 200))
    kind = F.when(gradle, "build_failure").when(plain & side(1).isNotNull(), "assertion_error").otherwise("test_failure")
    return _witness(logs, F.when(gradle, BUILD).otherwise(VALIDATION), kind, tests, message, side(1), side(2))


def parse_ansible_witness(logs: DataFrame | None = None):
    """Ansible: as a Python log where it is one, a fatal task gives the type; else what the first fatal task says."""
    python = parse_pytest_witness()
    own = _has(PYTEST)
    kind = F.when(_has(FATAL), "ansible_task_failure").otherwise(F.when(own, python["failure_type"]).otherwise("test_failure"))
    message = F.when(own, python["message"]).otherwise(F.coalesce(_one(r"fatal:\s*\[[^\]]+\]:\s*FAILED!\s*(?:=>)?\s*([^\n]*)", 1), F.lit("test_failure")))
    return _witness(logs, VALIDATION, kind, F.when(own, python["failed_tests"]).otherwise(F.array().cast("array<string>")), message, F.when(own, python["expected"]), F.when(own, python["actual"]))


def parse_js_witness(logs: DataFrame | None = None):
    """Mocha's JSON inside the text, else Jest's bullets, else Mocha's numbered failures."""
    block = F.regexp_extract(_LOG, r'(?s)(\{\s*"stats".*\})', 1)
    report = F.from_json(block, "failures array<struct<fullTitle:string,title:string,err:struct<message:string,expected:string,actual:string>>>")
    failures = F.coalesce(report["failures"], F.array().cast("array<struct<fullTitle:string,title:string,err:struct<message:string,expected:string,actual:string>>>"))
    bullets, numbered = _all(r"(?m)^\s*●\s+(.+)$", 1), _all(r"(?m)^\s*\d+\)\s+(.+?):?\s*$", 1)
    tests = F.when(F.size(failures) > 0, F.transform(failures, lambda f: F.coalesce(f["fullTitle"], f["title"]))).when(F.size(bullets) > 0, bullets).otherwise(numbered)
    err = F.get(failures, F.lit(0))["err"]
    claim = _one(r"(\w*Error: [^\n]*)", 1)
    return _witness(logs, VALIDATION, F.when(F.coalesce(F.contains(F.coalesce(err["message"], claim), F.lit("ssert")), F.lit(False)), "assertion_error").otherwise("test_failure"), F.transform(tests, strip), F.coalesce(err["message"], claim, F.lit("test_failure")), err["expected"], err["actual"])
