"""Anchors, suffix index and navigation hints: golden rows."""

from repairlens.operators import anchors as an
from repairlens.operators import hints as hn

RUNS = "run_id long, has_failure boolean, message string, trace array<string>, failed_tests array<string>, issue string, symbols array<string>"
FRAMES = "run_id long, pos int, file string, line int, function string"


def _tables(spark):
    runs = spark.createDataFrame(
        [
            (1, True, "FAILED tests/test_io.py::test_read - ValueError: Widget broke", [], ["tests/test_a.py::T::test_x[1]"], "The Widget and Table fail", ["parse", " Reader "]),
            (2, True, "thread 'main' panicked at src/lib.rs:12", ["at app/main.js:7 in x", None], [], "", None),
            (3, True, "broken in conf/base.cfg:9, cannot import name 'Old' from 'pkg.core'", None, None, None, []),
            (4, False, "FAILED tests/test_q.py::t", [], ["x"], "Ignored Word", ["no"]),
            (5, None, None, None, None, None, None),
        ],
        RUNS,
    )
    frames = spark.createDataFrame([(1, 0, "/testbed/tests/test_io.py", 3, "test_read"), (1, 1, "/testbed/src/io.py", 90, "read"), (1, 2, "/testbed/src/core.py", 40, "parse"), (1, 3, "/other/io.py", 1, "again"), (4, 0, "a.py", 1, "f")], FRAMES)
    views = spark.createDataFrame([(1, "src/deep/er.py"), (1, "z.py"), (1, "/testbed/src/io.py"), (5, "tests/test_v.py")], "run_id long, path string")
    edits = spark.createDataFrame([(1, 1, "src/b.py"), (1, 0, "z.py")], "run_id long, pos int, path string")
    return runs, frames, views, edits


def test_files_symbols_tests_and_modules(spark):
    rows = an.resolve_anchors(*_tables(spark)).collect()
    of = lambda run, kind: [(r["value"], r["source"]) for r in sorted(rows, key=lambda r: r["pos"]) if (r["run_id"], r["kind"]) == (run, kind)]
    assert of(1, "file") == [("/testbed/src/core.py", "stack_frame"), ("/testbed/src/io.py", "stack_frame"), ("/testbed/tests/test_io.py", "stack_frame"), ("z.py", "visited"), ("src/deep/er.py", "visited"), ("src/b.py", "edited")]
    assert of(2, "file") == [("app/main", "js_location"), ("src/lib.rs", "rust_panic"), ("src/lib", "source_location")]
    assert of(4, "file") == []
    assert of(1, "symbol") == [("parse", "error_symbol"), ("Reader", "error_symbol"), ("Widget", "issue_term"), ("Table", "issue_term")]
    assert of(4, "symbol") == [("Ignored", "issue_term")]
    assert of(1, "test") == [("tests/test_a.py::T::test_x[1]", "failed_tests"), ("tests/test_io.py::test_read", "error_message"), ("/testbed/src/core.py", "stack_frame"), ("/testbed/src/io.py", "stack_frame"), ("/testbed/tests/test_io.py", "stack_frame")]  # the container's root has "test" in it
    assert of(5, "test") == []
    assert [(r["run_id"], r["value"], r["detail"]) for r in rows if r["kind"] == "module"] == [(3, "pkg.core", "Old")]


def test_error_file_by_priority(spark):
    runs, *rest = _tables(spark)
    got = {r["run_id"]: tuple(r)[1:] for r in an.anchor_summary(runs, an.resolve_anchors(runs, *rest)).collect()}
    assert got[1] == ("/testbed/src/core.py", "stack_frame", "tests/test_a.py", "test_x[1]")
    assert got[2][:2] == ("app/main", "js_location")
    assert got[3][:2] == ("conf/base", "error_message")
    assert got[4] == ("", "unknown", "", "") and got[5] == ("", "unknown", "", "")


def test_short_names_resolve_to_one_path_or_stay(spark):
    files = spark.createDataFrame([(1, 1, "lib/a.py"), (1, 0, "/x/src/a.py"), (1, 2, "b.py"), (2, 0, "q/a.py")], "run_id long, pos int, path string")
    names = spark.createDataFrame([(1, "a.py"), (1, "src/a.py"), (1, "x/src/a.py"), (1, "b.py"), (1, "none.py"), (2, "a.py")], "run_id long, name string")
    got = {(r["run_id"], r["name"]): r["path"] for r in an.short_to_full(names, files).collect()}
    assert got == {(1, "a.py"): "/x/src/a.py", (1, "src/a.py"): "/x/src/a.py", (1, "x/src/a.py"): "/x/src/a.py", (1, "b.py"): "b.py", (1, "none.py"): "none.py", (2, "a.py"): "q/a.py"}


def test_longest_ending_wins_and_ambiguity_is_kept(spark):
    paths = spark.createDataFrame([("r", "src/a/setup.py"), ("r", "src/b/setup.py"), ("r", "setup.py"), ("r", "src/io.py"), ("q", "lib/io.py")], "repo string, path string")
    names = spark.createDataFrame([("r", "/testbed/src/a/setup.py"), ("r", "b/setup.py"), ("r", "c/setup.py"), ("r", "/x/src/io.py"), ("r", "gone.py"), ("q", "io.py"), ("r", "")], "repo string, name string")
    got = {(r["repo"], r["name"]): (r["path"], r["parts"], r["candidates"]) for r in an.resolve_paths(names, paths).collect()}
    assert got == {
        ("r", "/testbed/src/a/setup.py"): ("src/a/setup.py", 3, 1), ("r", "b/setup.py"): ("src/b/setup.py", 2, 1), ("r", "c/setup.py"): (None, 1, 3),
        ("r", "/x/src/io.py"): ("src/io.py", 2, 1), ("r", "gone.py"): (None, 0, 0), ("q", "io.py"): ("lib/io.py", 1, 1), ("r", ""): (None, 0, 0),
    }


SOURCE = "class Reporter:\n    def get_text(self):\n        x = 1\n        y = 2\n\nclass Other:\n    def html(self): pass\n"


def _lines(spark, files):
    return spark.createDataFrame([(repo, path, i + 1, t) for repo, path, body in files for i, t in enumerate(body.split("\n"))], "repo string, path string, ln int, text string")


def test_a_lower_source_never_shows_beside_a_higher_one(spark):
    label = "RuntimeError: Model class X doesn't declare an explicit app_label and isn't in INSTALLED_APPS"
    runs = [(1, "r", "i1", True, label), (2, "r", "i2", True, label), (3, "r", "i3", True, "ReporterTests.test_x failed; " + label), (4, "r", "i4", True, label), (5, "r", "i5", True, "Model class without app_label"), (6, "r", "i6", True, "nothing"), (7, "r", "i7", False, label), (8, "r", "skip", True, label), (9, "r", "i9", None, None)]
    witnesses = spark.createDataFrame(runs, "run_id long, repo string, instance string, has_failure boolean, message string")
    frames = spark.createDataFrame([(1, 0, "/testbed/pkg/rep.py", 2, "get_text"), (1, 1, "/testbed/tests/test_a.py", 9, "test_a"), (2, 0, "/testbed/gone.py", 5, "run"), (7, 0, "/testbed/pkg/rep.py", 3, "f"), (3, 0, "/testbed/tests/test_b.py", 1, "t")], FRAMES)
    lines = _lines(spark, [("r", "pkg/rep.py", SOURCE), ("r", "tests/test_rep.py", "class Reporter:\n    pass"), ("q", "a.py", "class Reporter:\n    pass")])
    more = spark.createDataFrame([(4, "gold_patch", "g", "g", "g"), (6, "gold_context", "g", "g", "g"), (6, "made_up", "g", "g", "g")], "run_id long, source string, artifact string, target string, method string")
    got = {r["run_id"]: (r["mode"], r["source"], r["target"], r["confidence"], r["missing"]) for r in hn.api_hints(witnesses, frames, lines, more, ["skip"]).collect()}
    assert got == {
        1: ("hint_generated", "repo_source_signature", "pkg/rep.py::Reporter", 0.65, ""),
        2: ("hint_generated", "runtime_introspection", "gone::run", 0.85, ""),
        3: ("hint_generated", "issue_keyword_api_match", "pkg/rep.py::Reporter.get_text", 0.65, ""),
        4: ("hint_generated", "issue_keyword_api_match", "django.db.models.base.ModelBase.__new__", 0.45, ""),
        5: ("hint_generated", "public_api_signature", "django.db.models.base.ModelBase", 0.45, ""),
        6: ("no_legal_api_hint", "", "", 0.0, "no_legal_hint_source_matched"),
        7: ("no_legal_api_hint", "", "", 0.0, "no_failure_witness"),
        8: ("needs_regression_witness", "", "", 0.0, "f2p_passed_no_p2p_raw_output"),
        9: ("no_legal_api_hint", "", "", 0.0, "no_failure_witness"),
    }


def test_signature_is_the_nearest_within_reach(spark):
    body = "def near():\n" + "    x\n" * 100 + "def far():\n" + "    y\n" * 300
    frames = spark.createDataFrame([(1, "r", 0, "a.py", 101, "f"), (2, "r", 0, "a.py", 301, "f"), (3, "r", 0, "a.py", 302, "f"), (4, "r", 0, "a.py", 99999, "f"), (5, "r", 0, "a.py", -4, "f"), (6, "r", 0, "a.py", None, "f"), (7, "r", 1, "b.py", 1, "f"), (7, "r", 0, "a.py", 1, "f")], "run_id long, repo string, pos int, file string, line int, function string")
    got = {r["run_id"]: r["target"] for r in hn.from_signatures(frames, _lines(spark, [("r", "a.py", body.rstrip("\n"))])).collect()}
    assert got == {1: "a.py::near", 2: "a.py::far", 5: "a.py::near", 7: "a.py::near"}
