"""Queries over log dialects, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from repairlens.operators import dialects as dl
from repairlens.operators import logs as lg
from repairlens.plans.fixtures import oracle, query

# The same events told in the way of each tool; DuckDB builds the answers from the numbers themselves.
CARGO = "concat('test m::t', run_id % 7, ' ... FAILED', chr(10), 'thread ', chr(39), 'm', chr(39), ' panicked at tests/a', run_id % 5, '.rs:', run_id % 90, ':1:', chr(10), 'boom ', run_id % 11, chr(10), 'test result: FAILED. 3 passed; 1 failed; 0 ignored', chr(10))"
CPP = "concat(CASE WHEN run_id % 2 = 0 THEN concat('src/a', run_id % 5, '.cpp:', run_id % 90, ':7: error: bad ref', chr(10)) ELSE '' END, '[  FAILED  ] Suite.t', run_id % 7, chr(10))"
JVM = "CASE WHEN run_id % 2 = 0 THEN concat('> Task :m', run_id % 5, ':test FAILED', chr(10), '* What went wrong:', chr(10), 'step ', run_id % 9, ' broke', chr(10), '* Try:', chr(10), 'BUILD FAILED') ELSE concat('java.lang.AssertionError: expected:<', run_id % 5, '> but was:<x>') END"
ANSIBLE = "concat('fatal: [h]: FAILED! =>', chr(10), 'FAILED t/a', run_id % 5, '.py::test_x - AssertionError: ', run_id % 9, ' != z')"
JS = """CASE WHEN run_id % 2 = 0 THEN concat('x', chr(10), '{"stats": {"failures": 1}, "failures": [{"fullTitle": "s t', run_id % 5, '", "err": {"message": "AssertionError: no", "expected": "', run_id % 9, '", "actual": "q"}}]}')
  ELSE concat('  ● suite › case', run_id % 5, chr(10), chr(10), '    TypeError: x', chr(10)) END"""
_flat = lambda parse, told: query(lambda logs: parse(logs.select("run_id", F.concat(F.expr(told), F.lit("\n"), "log_text").alias("log_text"))).withColumn("failed_tests", F.array_join("failed_tests", ",")), "logs")

QUERIES = {
    "parse_cargo_witness": _flat(dl.parse_cargo_witness, CARGO),
    "parse_cpp_witness": _flat(dl.parse_cpp_witness, CPP),
    "parse_jvm_witness": _flat(dl.parse_jvm_witness, JVM),
    "parse_ansible_witness": _flat(dl.parse_ansible_witness, ANSIBLE),
    "parse_js_witness": _flat(dl.parse_js_witness, JS),
}

_V, _B = f"'{dl.VALIDATION}'", f"'{dl.BUILD}'"
ORACLES = {
    "parse_cargo_witness": oracle("logs", f"SELECT run_id, {_V} AS stage, 'panic' AS failure_type, 'm::t' || (run_id % 7) AS failed_tests, 'boom ' || (run_id % 11) AS message, CAST(NULL AS VARCHAR) AS expected, CAST(NULL AS VARCHAR) AS actual FROM logs"),
    "parse_cpp_witness": oracle("logs", f"SELECT run_id, CASE WHEN run_id % 2 = 0 THEN {_B} ELSE {_V} END AS stage, CASE WHEN run_id % 2 = 0 THEN 'compile_error' ELSE 'test_failure' END AS failure_type, 'Suite.t' || (run_id % 7) AS failed_tests, CASE WHEN run_id % 2 = 0 THEN 'src/a' || (run_id % 5) || '.cpp:' || (run_id % 90) || ': error: bad ref' ELSE '1 test(s) failed' END AS message, CAST(NULL AS VARCHAR) AS expected, CAST(NULL AS VARCHAR) AS actual FROM logs"),
    "parse_jvm_witness": oracle("logs", f"SELECT run_id, CASE WHEN run_id % 2 = 0 THEN {_B} ELSE {_V} END AS stage, CASE WHEN run_id % 2 = 0 THEN 'build_failure' ELSE 'assertion_error' END AS failure_type, CASE WHEN run_id % 2 = 0 THEN ':m' || (run_id % 5) || ':test' ELSE '' END AS failed_tests, CASE WHEN run_id % 2 = 0 THEN 'step ' || (run_id % 9) || ' broke' ELSE 'AssertionError: expected:<' || (run_id % 5) || '> but was:<x>' END AS message, CASE WHEN run_id % 2 = 1 THEN CAST(run_id % 5 AS VARCHAR) END AS expected, CASE WHEN run_id % 2 = 1 THEN 'x' END AS actual FROM logs"),
    "parse_ansible_witness": oracle("logs", f"SELECT run_id, {_V} AS stage, 'ansible_task_failure' AS failure_type, array_to_string(['t/a' || (run_id % 5) || '.py::test_x'] || list_transform(regexp_extract_all(log_text, '{lg.NODE}', 1), lambda x, i: x || '::' || regexp_extract_all(log_text, '{lg.NODE}', 2)[i])[:19], ',') AS failed_tests, 'FAILED t/a' || (run_id % 5) || '.py::test_x - AssertionError: ' || (run_id % 9) || ' != z' AS message, CAST(run_id % 9 AS VARCHAR) AS expected, 'z' AS actual FROM logs"),
    "parse_js_witness": oracle("logs", f"SELECT run_id, {_V} AS stage, CASE WHEN run_id % 2 = 0 THEN 'assertion_error' ELSE 'test_failure' END AS failure_type, CASE WHEN run_id % 2 = 0 THEN 's t' || (run_id % 5) ELSE 'suite › case' || (run_id % 5) END AS failed_tests, CASE WHEN run_id % 2 = 0 THEN 'AssertionError: no' ELSE 'TypeError: x' END AS message, CASE WHEN run_id % 2 = 0 THEN CAST(run_id % 9 AS VARCHAR) END AS expected, CASE WHEN run_id % 2 = 0 THEN 'q' END AS actual FROM logs"),
}
