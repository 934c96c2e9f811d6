"""Paired test runs, plans, costs, coverage, shared frames and the evaluation matrix: brute force and golden rows."""

import random

from repairlens.operators import conversations as cv
from repairlens.operators import evaluation as ev
from repairlens.operators import failures as fl
from repairlens.operators import patches as pt
from repairlens.operators import planning as pl
from repairlens.operators import retrieval as rt


def test_outputs_take_the_latest_free_command(spark):
    rng = random.Random(1)
    tests = sorted({(r, rng.randrange(60), rng.randrange(2)) for r in range(4) for _ in range(25)})
    outs = sorted({(r, rng.randrange(60)) for r in range(4) for _ in range(25)})
    want, used = [], set()
    for run, step in outs:
        free = [t for t in tests if t[0] == run and t not in used and t[1] < step and step - t[1] <= 4]
        if free:
            used.add(free[-1])
            want.append((run, step, *free[-1][1:]))
    got = pl.pair_test_runs(spark.createDataFrame(tests, "run_id long, step long, pos long"), spark.createDataFrame(outs + outs[:3], "run_id long, step long"))
    assert sorted((r["run_id"], r["out_step"], r["test_step"], r["pos"]) for r in got.collect()) == want


def test_results_of_test_commands(spark):
    out = lambda rc, text: f"<returncode>{rc}</returncode>\n<output>{text}</output>"
    rows = [(1, 1, "assistant", "```bash\npytest a\n```\n```bash\nls\n```"), (1, 2, "user", out(-1, "FAILED t/a.py::x - E\nFAILED t/a.py::x\nFAILED t/b.py::y")), (1, 3, "user", out(0, "late")), (2, 1, "assistant", "```bash\npytest b\n```"), (2, 6, "user", out(1, "too late")), (3, 1, "user", "plain"), (3, 2, "user", None)]
    messages = spark.createDataFrame(rows, "run_id long, step long, role string, content string")
    got = pl.test_run_results(cv.classify_commands(cv.extract_commands(messages)), messages).collect()
    assert [(r["run_id"], r["test_step"], r["cmd"], r["out_step"], r["returncode"], r["failed_tests"]) for r in got] == [(1, 1, "pytest a", 2, -1, ["t/a.py::x", "t/b.py::y"])]


def test_plans_equal_a_greedy_loop(spark):
    rng = random.Random(3)
    rows = [(run, i, rng.choice(["high", "medium", "low", "odd"]), rng.choice([0.1, 0.2, 0.5]), rng.randrange(4), rng.randrange(4), rng.randrange(9)) for run in range(12) for i in range(30)]
    want = {}
    for run in range(12):
        a = b = 0
        for r in sorted((r for r in rows if r[0] == run), key=lambda r: ({"high": 0, "medium": 1, "low": 2}.get(r[2], 3), r[3], -r[4], r[1])):
            why = pl.OVER_ACTIONS if a + r[5] > 8 else pl.OVER_RESULTS if b + r[6] > 40 else None
            a, b = (a, b) if why else (a + r[5], b + r[6])
            want[run, r[1]] = (why is None, why)
    got = pl.allocate_plan(spark.createDataFrame(rows, "run_id long, ord long, confidence string, uncertainty double, n_clusters long, n_actions long, budget long"))
    assert {(r["run_id"], r["ord"]): (r["accepted"], r["reason"]) for r in got.collect()} == want


def test_costs(spark):
    runs = spark.createDataFrame([(1, "a/b/c", 3, 0.5), (2, "m", None, 0.0), (3, None, 1, None)], "run_id long, model_name string, api_calls long, instance_cost double")
    messages = spark.createDataFrame([(1, 3, 9.0), (1, 1, 10.0), (1, 2, None), (2, 1, 5.0)], "run_id long, step long, ts double")
    got = {r["run_id"]: tuple(r)[1:] for r in pl.run_costs(messages, runs).collect()}
    assert got == {1: ("a/b/c", "a", 3, -1.0, 0.5, "instance_cost"), 2: ("m", "unknown", 0, None, None, "unavailable"), 3: ("unknown", "unknown", 1, None, None, "unavailable")}


def test_shared_frames_follow_the_first_member(spark):
    rows = [(1, 2, "t2", "E", "b a d"), (1, 1, "t1", "E", "a x b"), (1, 3, "t3", "F", "q b a"), (1, 4, "t4", "E", "z z"), (2, 1, "s", "E", ""), (2, 2, "s", "E", "a")]
    events = spark.createDataFrame([(r, o, t, e, c.split(), f"top{o}") for r, o, t, e, c in rows], "run_id long, ord long, test_name string, exception_type string, call_chain array<string>, top_frame string")
    members = spark.createDataFrame([(1, 1, "c"), (1, 2, "c"), (1, 3, "c"), (1, 4, "alone"), (2, 1, "d"), (2, 2, "d")], "run_id long, ord long, cluster string")
    got = {r["cluster"]: (list(r["shared_frames"]), r["root_cause"], list(r["error_types"]), list(r["test_names"])) for r in fl.cluster_frames(events, members).collect()}
    assert got == {"c": (["a", "b"], "a", ["E:2", "F:1"], ["t1", "t2", "t3"]), "alone": (["z", "z"], "z", ["E:1"], ["t4"]), "d": ([], "top1", ["E:2"], ["s", "s"])}


def test_coverage_of_gold_files(spark):
    table = lambda rows: spark.createDataFrame(rows, "instance_id long, path string, step long")
    got = pl.gold_coverage(table([(1, "x/a.py", 7), (1, "y/a.py", 3), (1, "c.py", 1)]), table([(1, "c.py", 0)]), table([(1, "src/a.py", 0), (1, "lib/a.py", 0), (1, "b.py", 0), (1, "d/c.py", 0), (2, "q.py", 0)])).collect()
    assert {r["instance_id"]: (r["first_step"], round(r["coverage"], 3), list(r["seen_then_dropped"])) for r in got} == {1: (1, 0.667, ["a.py"]), 2: (None, 0.0, [])}


def test_alignment_of_runs_without_stack(spark):
    frames = spark.createDataFrame([(1, "a.py", False), (2, "t.py", True), (3, "a.py", False)], "run_id long, file string, is_test boolean")
    views = spark.createDataFrame([(1, "a.py"), (1, "a.py"), (2, "t.py"), (4, "a.py")], "run_id long, file string")
    runs = spark.createDataFrame([(1, True), (2, True), (3, True), (4, True), (5, False), (6, None)], "run_id long, has_failure boolean")
    got = {r["run_id"]: r["alignment"] for r in pl.error_visit_alignment(frames, views, runs).collect()}
    assert got == {1: "visited_error_file", 2: "visited_stack_frame", 3: "visited_none", 4: "unknown", 5: "unknown", 6: "unknown"}


def test_matrix_without_facts_or_records(spark):
    instances = spark.createDataFrame([(1, "b"), (2, None), (3, "b")], "instance_id long, batch string")
    runs = spark.createDataFrame([(1, True, 9, 2, 1, False)], "instance_id long, patch_exists boolean, patch_chars long, test_runs long, test_failures long, submitted_without_tests boolean")
    records = spark.createDataFrame([(1, 1, 0, False, None), (3, 1, 0, True, None), (3, 2, 1, False, None)], "instance_id long, ord long, priority int, resolved boolean, eval_error string")
    matrix = ev.eval_matrix(instances, runs, records)
    assert {r["instance_id"]: (r["batch"], r["status"], r["failure_class"]) for r in matrix.collect()} == {1: ("b", "EVALUATED", "visible-failure"), 2: ("unknown", "NOT_EVALUATED", "unknown"), 3: ("b", "CONFLICT", "unknown")}
    assert [r["instance_id"] for r in ev.first_failed(matrix).collect()] == [1]
    assert {r["metric"]: r["n"] for r in ev.matrix_counts(matrix).collect()} == {"discovered": 3, "evaluated": 1, "not_evaluated": 1, "broken": 0, "resolved": 0, "unresolved": 2, "conflicts": 1}


def test_patches_of_one_run_stay_apart(spark):
    patch = lambda f, a, b: f"diff --git a/{f} b/{f}\n--- a/{f}\n+++ b/{f}\n@@ -1,2 +1,2 @@\n k\n-{a}\n+{b}\n"
    one, two = patch("a.py", "q", "r"), patch("b.py", "b", "c") + "@@ -9,1 +9,1 @@\n-x\n+y\n"
    patches = spark.createDataFrame([(1, one), (1, two), (1, two), (2, one), (3, None), (3, "")], "run_id long, patch_text string")
    got = sorted((r["run_id"], r["file"], r["hunk"], r["removed"], r["added"]) for r in pt.hunks(patches).collect())
    assert got == [(1, "a.py", 1, "q", "r"), (1, "b.py", 1, "b", "c"), (1, "b.py", 2, "x", "y"), (2, "a.py", 1, "q", "r")]
    assert sorted((r["run_id"], r["hunks"], r["changed"]) for r in pt.patch_stats(patches).collect()) == [(1, 1, 2), (1, 2, 4), (2, 1, 2), (3, 0, 0)]


def test_files_seen_and_left(spark):
    files = lambda rows: spark.createDataFrame(rows, "run_id long, file string")
    got = cv.context_sets(files([(1, "a"), (1, "b")]), files([(1, "b"), (1, "c")]), files([(1, "b"), (2, "z")])).collect()
    assert {r["run_id"]: (r["viewed_not_final"], r["edited_not_viewed"]) for r in got} == {1: (["a"], ["c"]), 2: ([], [])}
    left = cv.viewed_then_dropped(files([(1, "x/a.py"), (1, "b.py")]), files([(1, "y/b.py")]), files([(1, "z/a.py"), (1, "n.py"), (1, "b.py")])).collect()
    assert sorted((r["file"], r["reason"]) for r in left) == [("a.py", "dropped"), ("n.py", "unvisited")]


def test_evidence_of_failed_tests(spark):
    tests = spark.createDataFrame([("t/a.py", "test_x", 3, 9), ("t/b.py", "test_x", 1, 2), ("t/b.py", "test_long_name", 5, 8)], "path string, name string, start_line int, end_line int")
    names = spark.createDataFrame([(1, "test_x", False), (1, "test_x", True), (1, "long_name", False), (2, "test_long", False), (2, "gone", True), (2, "test_name", False)], "run_id long, name string, is_regression boolean")
    views = spark.createDataFrame([(1, "/testbed/t/a.py", 8, 20), (2, "t/b.py", 9, 9)], "run_id long, path string, start_line int, end_line int")
    got = sorted((r["run_id"], r["name"], r["path"], r["symbol"], r["score"], r["seen"]) for r in rt.failed_test_evidence(tests, names, views).collect())
    assert got == [(1, "long_name", "t/b.py", "test_long_name", 0.78, False), (1, "test_x", "t/a.py", "test_x", 0.95, True), (2, "test_long", "t/b.py", "test_long_name", 0.78, True), (2, "test_name", "t/b.py", "test_long_name", 0.78, True)]


def test_dropped_spans_come_first(spark):
    span = "run_id long, path string, start_line long, end_line long"
    views = spark.createDataFrame([(1, "a.py", 1, 4), (1, "a.py", 2, 3), (1, "b.py", 1, 2), (1, "whole.py", 1, 2), (1, "widget.py", 1, 1)], span)
    kept = spark.createDataFrame([(1, "a.py", 1, 2), (1, "a.py", 3, 3), (1, "whole.py", None, None)], span)
    lines = spark.createDataFrame([("a.py", 1, "Parse it"), ("a.py", 4, "render"), ("b.py", 1, "parse and Render"), ("b.py", 2, "x"), ("whole.py", 1, "parse")], "path string, ln int, text string")
    words = spark.createDataFrame([(1, "m.Parse"), (1, "render"), (1, "it"), (1, "Widget")], "run_id long, word string")
    got = [(r["path"], r["start_line"], r["relation"], r["score"], r["matched"]) for r in rt.rehydrate_spans(views, kept, lines, words).orderBy("rank").collect()]
    assert got == [("a.py", 1, rt.DROPPED, 0.95, ["m.Parse", "render"]), ("b.py", 1, rt.UNCOVERED, 0.81, ["m.Parse", "render"]), ("widget.py", 1, rt.UNCOVERED, 0.73, ["Widget"])]
