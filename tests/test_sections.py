"""Sections of pytest and Django logs, reconciliation, alignment and classes."""

from repairlens.operators import failures as fl
from repairlens.operators import sections as sc

PYTEST = """\x1b[31mcollected\x1b[0m
=========== FAILURES ===========
_______ test_a[x] _______
>       run()
>       assert f(1) == 2
src/m.py:12: in run
tests/test_m.py:3: in test_a
E       TypeError: unsupported operand type(s) for -: 'A' and 'B'
E       ValueError: later
_______ test_b _______
  File "/testbed/src/n.py", line 7, in g
E   ImportError
=========== short test summary info ===========
FAILED tests/test_m.py::test_a[x] - TypeError
FAILED tests/test_m.py::test_c
2 failed, 3 passed
"""
DJANGO = """test_one (app.tests.Case) ... ok
test_two (app.tests.Case) ... ERROR
======================================================================
ERROR: test_two (app.tests.Case)
----------------------------------------------------------------------
Traceback (most recent call last):
  File "/testbed/app/models.py", line 4, in save
ValueError: bad value
----------------------------------------------------------------------
Ran 2 tests in 0.1s
FAILED (errors=1)
"""


def logs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "run_id long, log_text string")


def test_pytest_sections(spark):
    got = {r.test_name: r for r in sc.parse_pytest_failures(logs(spark, PYTEST, "", "no sections")).collect()}
    assert set(got) == {"test_a[x]", "test_b"}
    a, b = got["test_a[x]"], got["test_b"]
    assert (a.exception_type, a.assertion_line, a.root_frame) == ("TypeError", ">       assert f(1) == 2", "src/m.py:12")
    assert [(f.file, f.line, f.is_test_file) for f in a.frames] == [("src/m.py", 12, False), ("tests/test_m.py", 3, True)]
    assert (b.error_message, b.root_frame) == ("ImportError: ", "src/n.py:7")


def test_reconciliation(spark):
    got = sc.reconcile_failures(sc.parse_pytest_failures(logs(spark, PYTEST)), sc.summary_failures(logs(spark, PYTEST))).first()
    assert (got.n_sections, got.n_summary, got.n_matched, got.status) == (2, 2, 1, "partial_mismatch")


def test_django_sections(spark):
    got = sc.parse_django_failures(logs(spark, DJANGO)).first()
    assert (got.test_name, got.exception_type, got.error_message) == ("app.tests.Case::test_two", "ValueError", "ValueError: bad value")
    assert [(f.file, f.line) for f in got.frames] == [("app/models.py", 4)]
    assert tuple(sc.django_results(logs(spark, DJANGO)).first()) == (0, 1, 0, 1, 2)


def test_sections_feed_clusters(spark):
    events = fl.failure_events(sc.parse_pytest_failures(logs(spark, PYTEST)))
    assert {r.test_name: r.call_chain for r in events.collect()}["test_a[x]"] == ["src/m.py:12", "tests/test_m.py:3"]
    assert fl.cluster_failures(events).count() == 2


def test_alignment_and_classes(spark):
    c = spark.createDataFrame([(1, "a", 2, ["src/m.py:1", "src/n.py:2"], ["got unexpected keywords: ['loc']"], [""]), (1, "b", 1, ["x.py:1"], ["plain"], ["assert_allclose(a via b)"])], "run_id long, cluster string, n int, frames array<string>, messages array<string>, assertions array<string>")
    views = spark.createDataFrame([(1, "lib/n.py")], "run_id long, file string")
    edits = spark.createDataFrame([(1, "lib/z.py")], "run_id long, file string")
    got = {r.cluster: r for r in sc.align_evidence(c, views, edits).collect()}
    assert (got["a"].unviewed_files, got["a"].error_symbols, got["a"].disjoint) == (["src/m.py"], ["loc"], True)
    assert {r.cluster: r.subtype for r in sc.classify_clusters(c).collect()} == {"a": "FRAME_ATTRIBUTE_PROPAGATION", "b": "ROUTE_COMPARISON_FAILURE"}


def test_related_tests(spark):
    files = spark.createDataFrame([("tests/test_a.py", "from pkg import x\nfoo(1)\nfoo(2)"), ("tests/test_foo.py", "pass"), ("src/foo.py", "def foo(): pass")], "path string, content string")
    targets = spark.createDataFrame([("foo", "pkg")], "target string, module string")
    views = spark.createDataFrame([("tests/test_a.py",)], "file string")
    assert sorted((r.path, r.score, r.seen) for r in sc.related_tests(files, targets, views).collect()) == [("tests/test_a.py", 102, True)]


def test_logs_of_one_run_stay_apart(spark):
    log = lambda name, error: f"==== FAILURES ====\n____ {name} ____\n>   assert f() == 1\nE   {error}: bad {name}\n"
    logs = spark.createDataFrame([(1, log("test_a", "ValueError")), (1, log("test_b", "KeyError") + log("test_c", "TypeError")), (1, log("test_a", "ValueError")), (2, None)], "run_id long, log_text string")
    got = sc.parse_pytest_failures(logs).collect()
    assert sorted((r.test_name, r.exception_type, r.error_message) for r in got) == [("test_a", "ValueError", "ValueError: bad test_a"), ("test_b", "KeyError", "KeyError: bad test_b"), ("test_c", "TypeError", "TypeError: bad test_c")]
    assert sorted(r.ord for r in got) == [1, 2, 3]
