"""Type-driven inspections and searches: golden rows."""

from repairlens.operators import contract_actions as ca

RUNS = [
    (1, True, "cannot import name 'Old' from 'pkg.core'", ca.API),
    (2, True, "x", ca.INTERFACE),
    (3, True, "assert not result.value == 3", ca.TESTS),
    (4, True, "bad value in conf/base.cfg:3", ca.ROOT),
    (5, True, "x", ca.CALLERS),
    (6, True, "x", ca.REGRESSION),
    (7, True, "Plugin install broke", ca.DEPENDENCY),
    (8, True, "x", "unknown"),
    (9, None, None, ca.API),
]
ANCHORS = [
    (1, "symbol", 0, "Widget.draw", None, "error_symbol"), (1, "symbol", 1, "q", None, "issue_term"), (1, "module", 0, "pkg.core", "Old", "import_error"), (1, "file", 0, "tests/t.py", "", "stack_frame"), (1, "file", 1, "src/w.py", "", "stack_frame"),
    (2, "symbol", 0, "<module>", None, "error_symbol"), (2, "file", 0, "src/w.py", "f", "stack_frame"),
    (3, "test", 0, "tests/a.py::T::test_x", None, "failed_tests"),
    (4, "symbol", 0, "Alpha", None, "error_symbol"), (4, "symbol", 1, "Issue1", None, "issue_term"), (4, "symbol", 2, "Issue2", None, "issue_term"),
    (5, "symbol", 0, "run", None, "error_symbol"), (5, "file", 0, "src/deep/mod.py", "", "edited"),
    (6, "test", 0, "t.py", None, "visited"), (6, "symbol", 0, "s", None, "error_symbol"),
    (7, "file", 0, "a/b.py", "", "visited"), (7, "file", 1, "a/__init__.py", "", "visited"), (7, "module", 0, "pkg.sub", "x", "import_error"),
]
EDITS = [(5, 1, "src/other.py"), (5, 0, "src/deep/mod.py"), (6, 0, "lib/z.py")]


def actions(spark):
    runs = spark.createDataFrame(RUNS, "run_id long, has_failure boolean, message string, cdtype string")
    anchors = spark.createDataFrame([(r, k, p, v, 0, d, s) for r, k, p, v, d, s in ANCHORS], "run_id long, kind string, pos int, value string, line int, detail string, source string")
    return ca.typed_actions(ca.run_anchors(runs, anchors, spark.createDataFrame(EDITS, "run_id long, pos int, path string")))


def test_actions_of_each_kind(spark):
    rows = sorted(tuple(r) for r in actions(spark).collect())
    of = lambda run: [r[3:6] for r in rows if r[0] == run]
    assert of(1) == [("symbol_definition", "Widget.draw", "definition"), ("grep", "Widget", "usage"), ("symbol_definition", "Old", ""), ("grep", "pkg.core", ""), ("inspect", "src/w.py", "")]
    assert of(2) == [("inspect", "src/w.py", "interface_consumer")]
    assert of(3) == [("inspect", "tests/a.py", "failed_test"), ("grep", "test_x", "neighbor_test"), ("grep", "result.value", "")]
    assert of(4) == [("grep", "Issue1", ""), ("grep", "Issue2", ""), ("inspect", "conf/base", "")]
    assert of(5) == [("caller_search", "run", "caller"), ("grep", "mod(", "usage"), ("inspect", "src/deep/mod.py", "callee")]
    assert of(6) == [("inspect", "t.py", "")]
    assert of(7) == [("grep", "import pkg", ""), ("inspect", "a/__init__.py", ""), ("grep", "install", ""), ("grep", "plugin", "")]
    assert of(8) == [] and of(9) == []


def test_typed_ones_come_first_and_once(spark):
    general = spark.createDataFrame([(1, i, f"g{i}.py", "visited") for i in range(15)] + [(1, 99, "src/w.py", "visited"), (8, 0, "x.py", "visited")] + [(8, i, f"h{i}.py", "visited") for i in range(1, 15)], "run_id long, pos int, file string, source string")
    rows = sorted((r["run_id"], r["rank"], r["file"], r["source"]) for r in ca.merge_inspections(actions(spark).where("run_id IN (1, 8)"), general).collect())
    assert rows[0] == (1, 1, "src/w.py", "cdtype_driven_action") and [r[2] for r in rows if r[0] == 1][1:] == [f"g{i}.py" for i in range(11)]
    assert len([r for r in rows if r[0] == 8]) == 10
    searches = spark.createDataFrame([(1, 0, "grep", "Widget", "issue"), (1, 1, "symbol_definition", "Extra", "issue"), (1, 2, "caller_search", "C", "issue")], "run_id long, pos int, type string, query string, source string")
    got = [(r["type"], r["query"], r["source"]) for r in ca.merge_searches(actions(spark).where("run_id = 1"), searches).orderBy("rank").collect()]
    typed = "cdtype_driven_action"
    assert got == [("symbol_definition", "Widget.draw", typed), ("symbol_definition", "Old", typed), ("symbol_definition", "Extra", "issue"), ("caller_search", "C", "issue"), ("grep", "Widget", typed), ("grep", "pkg.core", typed)]
