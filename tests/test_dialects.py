"""One log of each dialect."""

import json

import pytest

from repairlens.operators import dialects as dl
from repairlens.operators import logs as lg
from repairlens.operators import witnesses as wt

CARGO = "test bin::a ... FAILED\nthread 'a' panicked at tests/x.rs:3:5:\nexpected:\n~~~~~~~~~~~~\none\n~~~~~~~~~~~~\n\ngot:\n~~~~~~~~~~~~\ntwo\n~~~~~~~~~~~~\ntest result: FAILED. 3 passed; 1 failed; 0 ignored\n"
CASES = [
    (dl.parse_cargo_witness, CARGO, ("validation_failure", "panic", ["bin::a"], "expected:", "one", "two")),
    (dl.parse_cargo_witness, "test result: FAILED. 3 passed; 2 failed; 0 ignored", ("validation_failure", "test_failure", [], "Test run failed (3 passed, 2 failed)", None, None)),
    (dl.parse_cpp_witness, "src/a.cpp:3:7: error: no member x\nmake: *** [all] Error 2", ("dependency_or_environment_failure", "compile_error", [], "src/a.cpp:3: error: no member x", None, None)),
    (dl.parse_cpp_witness, "make[1]: *** [all] Error 2", ("dependency_or_environment_failure", "build_failure", [], "make failed: make[1]: *** [all] Error 2", None, None)),
    (dl.parse_cpp_witness, "[  FAILED  ] A.b (0 ms)\nx", ("validation_failure", "test_failure", ["A.b (0 ms)"], "1 test(s) failed", None, None)),
    (dl.parse_cpp_witness, "start\nsome failure here\nend", ("validation_failure", "test_failure", [], "some failure here", None, None)),
    (dl.parse_jvm_witness, "> Task :app:test FAILED\nFAILURE: Build failed with an exception.\n* What went wrong:\nExecution failed\n* Try:\nBUILD FAILED", ("dependency_or_environment_failure", "build_failure", [":app:test"], "Execution failed", None, None)),
    (dl.parse_jvm_witness, "Tests run: 3, Failures: 1, Errors: 0\nBUILD FAILURE", ("validation_failure", "test_failure", ["run=3 fail=1 err=0"], "1 test(s) failed", None, None)),
    (dl.parse_jvm_witness, "java.lang.AssertionError: expected:<1> but was:<2>", ("validation_failure", "assertion_error", [], "AssertionError: expected:<1> but was:<2>", "1", "2")),
    (dl.parse_ansible_witness, "TASK [x]\nfatal: [h]: FAILED! => {}\nFAILED t/a.py::test_x - AssertionError: 1 != 2", ("validation_failure", "ansible_task_failure", ["t/a.py::test_x"], "FAILED t/a.py::test_x - AssertionError: 1 != 2", "1", "2")),
    (dl.parse_js_witness, "noise\n" + json.dumps({"stats": {"failures": 1}, "failures": [{"fullTitle": "a b", "err": {"message": "AssertionError: no", "expected": "1", "actual": "2"}}]}, indent=1), ("validation_failure", "assertion_error", ["a b"], "AssertionError: no", "1", "2")),
    (dl.parse_js_witness, "  ● suite › case\n\n    TypeError: x is undefined", ("validation_failure", "test_failure", ["suite › case"], "TypeError: x is undefined", None, None)),
    (dl.parse_js_witness, "  1 failing\n\n  1) suite\n       case:\n     Error: no", ("validation_failure", "test_failure", ["suite"], "Error: no", None, None)),
]


@pytest.mark.parametrize("parse,text,want", CASES)
def test_dialect(spark, parse, text, want):
    got = parse(spark.createDataFrame([(1, text)], "run_id long, log_text string")).first()
    assert tuple(got)[1:] == want


@pytest.mark.parametrize("parse", [dl.parse_cargo_witness, dl.parse_cpp_witness, dl.parse_jvm_witness, dl.parse_ansible_witness, dl.parse_js_witness])
def test_empty_and_null(spark, parse):
    assert parse(spark.createDataFrame([(1, ""), (2, None)], "run_id long, log_text string")).count() == 2


ROUTED = [
    (CARGO, "cargo", "bin::a", "expected:", "high"),
    ("Traceback (most recent call last):\n  File \"a.py\", line 3\nValueError: bad value\nFAILED tests/a.py::test_x - ValueError: bad value", "pytest", "tests/a.py::test_x", "ValueError: bad value", "medium"),
    ("--- FAIL: TestX (0.01s)\n    x_test.go:42: expected 3, got 4\nassert", "go", "TestX", "expected 3, got 4", "high"),
    ("PLAY [all]\nTASK [x]\nfatal: [h]: FAILED! => no such host", "ansible", "", "no such host", "low"),
    ("[  FAILED  ] A.b\n1 FAILED TEST", "cpp", "A.b", "1 test(s) failed", "medium"),
    ("FAIL: test_b (pkg.Case)\nAssertionError: 1", "cpp", "", "AssertionError: 1", "low"),
    ("  2 passing\n  1 failing\n\n  1) suite case\n  TypeError: x", "js", "suite case", "TypeError: x", "medium"),
    ("Tests run: 3, Failures: 1, Errors: 0\nBUILD FAILURE", "jvm", "run=3 fail=1 err=0", "1 test(s) failed", "medium"),
    ("something failed: here it is\nexit code: 3", "generic", "", "failed: here it is", "low"),
    ("error", "stage_detector", "", "error", "minimal"),
]


def test_logs_are_routed_to_the_parser_that_fits(spark):
    logs = [(i, r[0]) for i, r in enumerate(ROUTED)] + [(50, None), (51, CARGO), (51, CARGO)]
    got = [(r.run_id, r.parser, r.failed_tests, r.message, r.quality) for r in wt.build_witnesses(spark.createDataFrame(logs, "run_id long, log_text string")).collect()]
    assert sorted(g[:4] for g in got if g[0] < 50) == [(i, *r[1:4]) for i, r in enumerate(ROUTED)]
    assert {g[0]: g[4] for g in got if g[0] < 50} == {i: r[4] for i, r in enumerate(ROUTED)}
    assert len(got) == len(logs)  # equal rows give one row each


MOCHA = """
Serverless: Stack create finished
{
  "stats": { "suites": 2, "tests": 10, "passes": 9, "failures": 1, "duration": 5000 },
  "failures": [
    {
      "fullTitle": "monitorStack should fail",
      "err": {
        "stack": "ServerlessError: Cannot read\\n    at lib/plugins/monitorStack.js:97:26\\n    at tryCatcher (node_modules/bluebird/util.js:16:23)"
      }
    }
  ]
}
"""
GOLDEN = [
    ("", "unknown_failure", "unknown", "infrastructure_only", []),
    ("Ran 46 tests in 0.017s\nOK, nothing to see", "unknown_failure", "unknown", "infrastructure_only", []),
    ("error", "validation_failure", "empty_log", "minimal", []),
    ("error: patch failed: src/a.py:3", "patch_apply_failure", "git_apply", "infrastructure_only", []),
    ("ModuleNotFoundError: no module named x", "dependency_or_environment_failure", "build_or_infra_failure", "infrastructure_only", []),
    ("INTERNALERROR> something", "test_collection_failure", "collect_error", "infrastructure_only", []),
    ("the command timed out after 3 s", "timeout", "timeout", "infrastructure_only", []),
    ("test result: FAILED. 3 passed; 2 failed; 0 ignored", "validation_failure", "test_failure", "low", []),
    ("thread 'm' panicked at tests/a.rs:7:1:\nboom\ntest result: FAILED. 0 passed; 1 failed;", "validation_failure", "panic", "medium", ['File "tests/a.rs", line 7']),
    ("src/a.cpp:9:7: error: bad ref\n[  FAILED  ] A.b\n1 FAILED TEST", "dependency_or_environment_failure", "compile_error", "infrastructure_only", ['File "src/a.cpp", line 9']),
    (MOCHA, "validation_failure", "test_failure", "medium", ['File "lib/plugins/monitorStack.js", line 97']),
    ("FAIL src/a.test.js\n  TypeError: x\n    at f (node_modules/q/i.js:1:2)\n    at Object.g (src/a.js:10:5)", "validation_failure", "test_failure", "medium", ['File "node_modules/q/i.js", line 1', 'File "src/a.js", line 10']),
    ("  2 passing\n  1 failing\n\n  1) suite case\n  TypeError: x\n    at f (node_modules/q/i.js:1:2)\n    at g (src/a.js:10:5)", "validation_failure", "test_failure", "medium", ['File "src/a.js", line 10', 'File "node_modules/q/i.js", line 1']),
    ("it failed:\nTraceback (most recent call last):\n  File \"a.py\", line 3, in f\nValueXError: bad\n  File \"late.py\", line 1", "validation_failure", "test_failure", "medium", ['File "a.py", line 3, in f']),
]


def test_stage_types_frames_and_quality(spark):
    rows = wt.build_witnesses(spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "run_id long, log_text string")).collect()
    got = {r.run_id: (r.stage, r.failure_type, r.quality, list(r.stack_trace)) for r in rows}
    assert got == {i: g[1:] for i, g in enumerate(GOLDEN)}


def test_noise_names_no_symbol(spark):
    told = spark.createDataFrame([(1, [], "Warning: Linux File handling broke Total Config"), (2, [], "The Widget and Widget.render broke Expected Traceback"), (3, ["f", "", "f"], "X")], "run_id long, functions array<string>, message string")
    assert {r.run_id: r.symbols for r in lg.error_symbols(told).collect()} == {1: [], 2: ["The", "Widget", "Widget.render", "Expected", "Traceback"], 3: ["f"]}
