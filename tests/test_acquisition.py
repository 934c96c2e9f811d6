"""Search actions, ranked tests, error signals and cluster diagnoses: golden rows."""

from repairlens.operators import acquisition as aq
from repairlens.operators import logs as lg
from repairlens.operators import sections as sc

ACTION = "action_id string, action string, kind string, value string, module string, budget int"
FILES = [
    ("pkg/a.py", "class Widget:\n    def draw(self):\n        return 1\n\nx = 2\n"),
    ("pkg/b.py", "def draw(x):\n    pass\nclass WidgetList: pass\n"),
    ("build/c.py", "class Widget: pass\n"),
    (".hid/c.py", "class Widget: pass\n"),
    ("pkg/d.txt", "class Widget"),
    ("pkg/tests/test_a.py", "from pkg.a import Widget\nWidget(); Widget()\n"),
    ("pkg/tests/test_b.py", "import pkg.b\n"),
    ("test_widget.py", "nothing\n"),
    ("other/widget_test.py", "pass\n"),
    ("pkg/tests/test_null.py", None),
]


def test_plan_of_mixed_actions(spark):
    actions = [
        ("sym", "FIND_DEFINITION", "SYMBOL", "pkg.Widget", "", 5), ("one", "FIND_DEFINITION", "TYPE_NAME", "Widget", "", 1), ("def", "FIND_DEFINITION", "SYMBOL", "draw", "", 5),
        ("in", "FIND_DEFINITION", "FAILURE_SITE", "pkg/a.py:3", "", 1), ("out", "FIND_DEFINITION", "FAILURE_SITE", "pkg/a.py:5", "", 1), ("gone", "FIND_DEFINITION", "FAILURE_SITE", "zz.py:5", "", 1), ("bad", "FIND_DEFINITION", "FAILURE_SITE", "pkg/a.py:x", "", 1),
        ("file", "FIND_DEFINITION", "FILE", "pkg/b.py", "", 1), ("odd", "FIND_DEFINITION", "TEXT", "x", "", 1), ("call", "FIND_CALLERS", "SYMBOL", "draw", "", 1), ("none", "FIND_DEFINITION", "SYMBOL", "nothing_here", "", 1),
        ("ts", "FIND_RELATED_TESTS", "SYMBOL", "Widget", "pkg.b", 9), ("tf", "FIND_RELATED_TESTS", "FILE", "pkg/tests/b.py", "", 9),
    ]
    failed = spark.createDataFrame([("other/x.py::t",)], "name string")
    results, hits = aq.route_plan(spark.createDataFrame(actions, ACTION), spark.createDataFrame(FILES, "path string, content string"), failed)
    status = {r["action_id"]: (r["status"], r["n_hits"]) for r in results.collect()}
    assert status == {"sym": ("FOUND", 2), "one": ("FOUND", 1), "def": ("FOUND", 2), "in": ("FOUND", 1), "out": ("FOUND", 1), "gone": ("NOT_FOUND", 0), "bad": ("INVALID_TARGET", 0), "file": ("FOUND", 1), "odd": ("UNSUPPORTED", 0), "call": ("UNSUPPORTED", 0), "none": ("NOT_FOUND", 0), "ts": ("FOUND", 4), "tf": ("FOUND", 1)}
    rows = sorted(tuple(r) for r in hits.collect())
    of = lambda a: [r[2:6] for r in rows if r[0] == a]
    assert of("sym") == [("pkg/a.py", 1, 1, "Widget"), ("pkg/b.py", 3, 3, "Widget")]
    assert of("one") == [("pkg/a.py", 1, 1, "Widget")]
    assert of("def") == [("pkg/a.py", 2, 2, "draw"), ("pkg/b.py", 1, 1, "draw")]
    assert of("in") == [("pkg/a.py", 2, 3, "draw")]
    assert of("out") == [("pkg/a.py", 1, 5, "")]
    assert of("file") == [("pkg/b.py", 1, 4, "")]


def test_tests_by_their_bearing(spark):
    actions = spark.createDataFrame([("ts", "FIND_RELATED_TESTS", "SYMBOL", "x.Widget", "pkg.b", 9), ("tf", "FIND_RELATED_TESTS", "FILE", "pkg/tests/b.py", None, 9), ("low", "FIND_RELATED_TESTS", "SYMBOL", "widget", "", 1)], ACTION)
    failed = spark.createDataFrame([("other/x.py::t",), ("pkg/x::a::b",)], "name string")
    got = sorted((r["action_id"], r["rank"], r["path"], r["score"]) for r in aq.rank_tests(spark.createDataFrame(FILES, "path string, content string"), actions, failed).collect())
    assert got == [
        ("low", 1, "test_widget.py", 60),
        ("tf", 1, "pkg/tests/test_b.py", 131),
        ("ts", 1, "pkg/tests/test_a.py", 103), ("ts", 2, "pkg/tests/test_b.py", 80), ("ts", 3, "other/widget_test.py", 50), ("ts", 4, "test_widget.py", 30),
    ]


def test_scan_limit_by_path(spark):
    files = spark.createDataFrame([(f"f{i}.py", "def go(): pass" if i > 4 else "x = 1") for i in range(9)], "path string, content string")
    actions = spark.createDataFrame([("a", "FIND_DEFINITION", "SYMBOL", "go", "", 2), ("b", "FIND_DEFINITION", "SYMBOL", "go", "", 1)], ACTION)
    got = sorted((r["action_id"], r["path"]) for r in aq.symbol_definitions(files, actions, scan=3).collect())
    assert got == [("a", "f5.py")]
    assert aq.symbol_definitions(files, actions).count() == 3


def test_signals_of_a_log(spark):
    log = 'TypeError: x\nAcmeError and UserWarning, AcmeError\nwarnings.warn(AcmeWarning, y) models.E010 W123 E12\nFAILED t/a.py::test_x - FAILED t/a.py::test_x -\n  File "/s/core.py", line 3\n  File "/s/tests/test_core.py", line 9\n  File "/s/__init__.py", line 1\n  File "<frozen importlib>", line 1\n  File "/t/core.py", line 8'
    rows = lg.error_signals(spark.createDataFrame([(1, log), (2, ""), (3, None)], "run_id long, log_text string")).collect()
    of = lambda kind: [r["token"] for r in sorted(rows, key=lambda r: r["pos"]) if r["kind"] == kind]
    assert {r["run_id"] for r in rows} == {1}
    assert of("exception") == ["TypeError", "AcmeError", "AcmeWarning"] and of("warning_code") == ["AcmeWarning"]
    assert of("check_code") == ["E010", "W123"] and of("failed_test") == ["t/a.py::test_x"]
    assert of("stack_file") == ["core.py", "test_core.py", "__init__.py", "<frozen importlib>"] and of("origin_file") == ["core.py"]
    assert sorted(r["token"] for r in lg.specific_tokens(lg.error_signals(spark.createDataFrame([(1, log + " PytestConfigWarning")], "run_id long, log_text string"))).collect()) == ["AcmeError", "AcmeWarning", "E010", "W123"]


def test_clusters_with_targets_and_place(spark):
    rows = [
        (1, "a", 2, ["x"], ["assert_allclose(f(a) via b, 1)"], list("abcdefg"), ["f.py:1"], "r.py:3"),
        (1, "b", 1, ["Frame ITRS got unexpected keywords: ['location'] for \"ITRS\""], [""], ["s"], ["f.py:1", "g.py:2"], "r.py:3"),
        (1, "c", 1, ["unexpected keyword"], [None], ["s"], [], None),
        (1, "d", 3, ["unsupported operand type(s) for -"], [], ["s"], [], None),
        (1, "e", 1, ["plain"], [], ["s"], ["f"], "r"),
    ]
    clusters = spark.createDataFrame(rows, "run_id long, cluster string, n long, messages array<string>, assertions array<string>, symbols array<string>, shared_frames array<string>, root_cause string")
    got = {r["cluster"]: (r["subtype"], list(r["targets"]), r["location"]) for r in sc.diagnose_clusters(clusters).collect()}
    assert got == {
        "a": ("ROUTE_COMPARISON_FAILURE", list("abcde"), "r.py:3"),
        "b": ("FRAME_ATTRIBUTE_PROPAGATION", ["location", "ITRS"], "f.py:1"),
        "c": ("FRAME_ATTRIBUTE_PROPAGATION", ["<unknown>"], ""),
        "d": ("FRAME_ATTRIBUTE_CONSTRAINT", ["s"], ""),
        "e": ("", [], ""),
    }
