"""Golden rows for operators of conversations, logs, patches and failures; invariants over the queries."""

from pyspark.sql import functions as F

from repairlens.operators import conversations as cv
from repairlens.operators import evaluation as ev
from repairlens.operators import failures as fl
from repairlens.operators import logs as lg
from repairlens.operators import patches as pt
from repairlens.operators import source_tree as st
from repairlens.operators import witnesses as wt
from repairlens.plans import registry

MESSAGES = "run_id long, step long, role string, content string"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_commands_and_flags(spark):
    text = "go\n```bash\ngrep -rn a src/x.py\n```\n<command> python -m pytest -q </command>"
    got = cv.classify_commands(cv.extract_commands(spark.createDataFrame([(1, 0, "assistant", text), (1, 1, "user", text)], MESSAGES))).orderBy("pos").collect()
    assert [r.cmd for r in got] == ["grep -rn a src/x.py", "python -m pytest -q"]
    assert [(r.is_search, r.is_test) for r in got] == [(True, False), (False, True)]


def test_reversed_lines_are_swapped_and_belong_to_the_last_file(spark):
    text = "<explore_context>\nFile: /testbed/a.py\nLines: 9-3\nLines: 4-5\nFile: b.py\nLines: 1-1\n</explore_context>"
    got = rows(cv.viewed_spans(spark.createDataFrame([(1, 0, "user", text)], MESSAGES)).select("path", "start_line", "end_line").orderBy("path", "start_line"))
    assert got == [("a.py", 3, 9), ("a.py", 4, 5), ("b.py", 1, 1)]


def test_masking_may_lengthen_and_is_not_idempotent(spark):
    long = "<returncode>1</returncode>\n<output>\n" + "x" * 90 + "\n</output>"
    once = cv.mask_observations(spark.createDataFrame([(1, 0, "tool", long)], MESSAGES), 80)
    twice = cv.mask_observations(once, 80)
    a, b = once.first().content, twice.first().content
    assert a.startswith("<returncode>1</returncode>") and f"was {len(long)} chars" in a and a != b


def test_later_user_messages_move_to_the_front(spark):
    m = [(1, 0, "system", "s"), (1, 1, "assistant", "a"), (1, 2, "tool", "t"), (1, 3, "user", "u"), (1, 4, "assistant", "b")]
    got = rows(cv.truncate_window(spark.createDataFrame(m, MESSAGES), 1).orderBy("pos").select("step"))
    assert got == [(0,), (3,), (4,)]


def test_compression_never_adds_messages(spark):
    df = registry.queries()["compression_report"](spark, "/root/testdata/sf0.001")
    assert df.where("messages_after > messages_before").count() == 0


def test_message_masks(spark):
    cases = {
        "got unexpected keywords: ['location']": "got unexpected keywords: ['<KW>']",
        "unsupported operand type(s) for -: 'Time' and 'float'": "unsupported operand type(s) for -: '<A>' and '<B>'",
        "cannot import name 'X' from 'Y'": "cannot import name '<NAME>' from '<PACKAGE>'",
        "module 'm' has no attribute 'q'": "module '<MOD>' has no attribute '<ATTR>'",
        "line 12 of /a/b.py at 0x7f3": "line <N> of <path> at <hex>",
    }
    df = spark.createDataFrame([(k,) for k in cases], "m string").select("m", fl.normalize_message(F.col("m")).alias("n"))
    assert {r.m: r.n for r in df.collect()} == cases


def test_clusters_partition_events_and_share_frames_with_the_seed(spark):
    frame = "array<struct<file:string,line:int,function:string,is_test_file:boolean,is_repo_frame:boolean>>"
    chain = lambda *n: [("f.py", i, "g", False, True) for i in n]
    events = [(1, i, f"t{i}", "TypeError", "AssertionError", None, chain(*c)) for i, c in enumerate([(1, 2, 3), (2, 3, 4), (4, 5), (1, 3, 9)])]
    df = fl.failure_events(spark.createDataFrame(events, f"run_id long, ord long, test_name string, exception_type string, error_message string, root_frame string, frames {frame}"))
    got = {r.ord: r.cluster for r in fl.cluster_failures(df).collect()}
    assert got == {0: "seed|0", 1: "seed|0", 2: "seed|2", 3: "seed|0"}


def test_stage_gate_comes_before_parsers(spark):
    logs = spark.createDataFrame([(1, "error: patch failed: a.py:3"), (2, "FAILED tests/a.py::test_x - AssertionError: 1 != 2\n"), (3, "")], "run_id long, log_text string")
    got = {r.run_id: (r.stage, r.parser, r.failed_tests) for r in wt.build_witnesses(logs).collect()}
    assert got[1] == ("patch_apply_failure", "stage_detector", "")
    assert got[2] == ("validation_failure", "pytest", "tests/a.py::test_x")
    assert got[3][1] == "stage_detector"


def test_a_deleted_line_that_looks_like_a_header_ends_the_hunk(spark):
    patch = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n a\n--- b\n-c\n+d\n"
    got = pt.patch_stats(spark.createDataFrame([(1, patch)], "run_id long, patch_text string")).first()
    assert (got.hunks, got.added, got.deleted) == (1, 0, 0)


def test_budget_skips_and_goes_on(spark):
    c = spark.createDataFrame([(1, "s", 0, "a", 1, 11), (1, "s", 1, "b", 1, 101), (1, "s", 2, "c", 1, 6)], "instance_id long, source string, priority int, path string, start_line long, end_line long")
    assert [r.path for r in st.enforce_budget(c, 5, 5, 20, 500).orderBy("rank").collect()] == ["a", "c"]


def test_relocated_hunk_takes_the_exact_block_else_the_first_place_of_two_lines(spark):
    code = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(["a", "b ", "x", "a", "b", "c"])], "path string, ln int, text string")
    old = lambda *t: spark.createDataFrame([(1, "f", k, x) for k, x in enumerate(t)], "id long, file string, k int, text string")
    assert rows(pt.relocate_hunks(old("a", "b", "c"), code)) == [(1, "f", 4)]
    assert rows(pt.relocate_hunks(old("a", "b", "z"), code)) == [(1, "f", 1)]
    assert rows(pt.relocate_hunks(old("c"), code)) == [(1, "f", 6)] and rows(pt.relocate_hunks(old("q", "r"), code)) == []


def test_seen_under_another_root_and_both_spans_widened(spark):
    span = "instance_id long, path string, start_line long, end_line long"
    views = spark.createDataFrame([(1, "/testbed/src/a.py", 20, 22), (1, "src/b.py", 29, 30), (2, "src/c.py", 1, 2)], span)
    got = {r.path + str(r.start_line): r.seen for r in st.mark_already_seen(spark.createDataFrame([(1, "src/a.py", 20, 22), (1, "src/b.py", 20, 20), (1, "src/b.py", 41, 50), (1, "src/c.py", 1, 2)], span), views).collect()}
    assert got == {"src/a.py20": True, "src/b.py20": True, "src/b.py41": False, "src/c.py1": False}


def test_callers_by_kind_of_line(spark):
    code = [("a.py", 1, "x = long_name"), ("a.py", 2, "long_name(1)"), ("b.py", 1, "def long_name(x):"), ("c.py", 1, "@wrap(long_name)"), ("d.py", 1, "abc")]
    got = rows(st.find_callers(spark.createDataFrame(code, "path string, ln int, text string"), spark.createDataFrame([("pkg.long_name",), ("abc",)], "symbol string")).orderBy("path").select("path", "ln", "score"))
    assert got == [("a.py", 2, 0.7), ("b.py", 1, 0.75), ("c.py", 1, 0.85)]


def test_siblings_of_the_class_first_and_never_the_method_itself(spark):
    table = [(f"p{i:02}.py", f"K{i}.run", f"K{i}") for i in range(30)] + [(f"z{i}.py", "K3.run", "K3") for i in range(9)] + [("y.py", "Outer.K3.run", "K3"), ("a.py", "run", None)]
    got = rows(st.sibling_methods(spark.createDataFrame(table, "path string, name string, parent string"), spark.createDataFrame([("K3.run",)], "hint string")).orderBy("rank"))
    assert [(r[1], r[3]) for r in got] == [("Outer.K3.run", 0.7), ("K0.run", 0.85), ("K1.run", 0.85)]


def test_recall_is_null_where_it_does_not_apply(spark):
    spans = spark.createDataFrame([(1, "gold", "f", 1, 2), (1, "viewed", "f", 1, 2), (1, "candidate", "f", 2, 3), (1, "candidate", "f", 5, 4)], "instance_id long, kind string, path string, start_line long, end_line long")
    got = ev.incremental_recall(ev.gold_segments(ev.segments(spans))).first()
    assert (got.raw_recall, got.unseen_recall) == (0.5, None)


def test_scope_signals(spark):
    schema = "changed_files int, changed_lines int, api_calls int, repeated_patterns int, edited_files int, viewed_files int, edited_not_viewed int, submitted_without_tests boolean"
    got = pt.scope_score(spark.createDataFrame([(5, 199, 80, 0, 1, 9, 0, False), (1, 1, 1, 0, 8, 10, 0, False), (6, 300, 1, 0, 1, 0, 0, False)], schema)).collect()
    assert [(r.score, r.level) for r in got] == [(2, "warning"), (1, "none"), (3, "strong")]


def test_results_do_not_depend_on_the_number_of_partitions(spark):
    run = registry.queries()["compress_conversations"]
    before, out = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(sorted(rows(run(spark, "/root/testdata/sf0.001"))))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1]
