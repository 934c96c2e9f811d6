"""Evidence selection with skips and required relations, dropped views, scope constraints, siblings and repeated edits."""

from repairlens.operators import retrieval as rt

CAND = "instance_id long, ord long, path string, start_line long, end_line long, operation string, relation string, score double"


def test_selection_skips_and_adds_required_relations(spark):
    rows = [
        (1, 0, "a", 1, 10, "op", "r1", 0.9),
        (1, 1, "a", 1, 10, "op", "r9", 0.8),  # the same span
        (1, 2, "a", 20, 29, "op", "r1", 0.8),
        (1, 3, "a", 40, 41, "op", "r1", 0.7),  # a third of the same path and operation
        (1, 4, "b", 1, 100, "op", "r1", 0.6),  # too long
        (1, 5, "c", 1, 5, "op", "r2", 0.5),
        (1, 6, "d", 1, 3, "op", "need", 0.1),  # a fourth file, but required
    ]
    got = rt.select_evidence(spark.createDataFrame(rows, CAND), ["need", "none"], 10, 40, 2).orderBy("rank").collect()
    assert [(r.path, r.start_line, r.relation) for r in got] == [("a", 1, "r1"), ("a", 20, "r1"), ("c", 1, "r2"), ("d", 1, "need")]


def test_items_stop_the_required_ones_too(spark):
    rows = [(1, i, f"p{i}", 1, 2, "op", "r1", 1.0 - i / 10) for i in range(3)] + [(1, 9, "q", 1, 2, "op", "need", 0.0)]
    got = rt.select_evidence(spark.createDataFrame(rows, CAND), ["need"], 3, 100, 9).collect()
    assert {r.relation for r in got} == {"r1"} and len(got) == 3


def test_dropped_views_by_keywords(spark):
    span = "instance_id long, path string, start_line long, end_line long"
    views = spark.createDataFrame([(1, "a", 1, 2), (1, "a", 3, 4), (1, "b", 1, 1)], span)
    kept = spark.createDataFrame([(1, "a", 4, 9)], span)
    lines = spark.createDataFrame([("a", 1, "foo bar"), ("a", 2, "baz"), ("a", 3, "foo"), ("b", 1, "foo")], "path string, ln int, text string")
    words = spark.createDataFrame([(1, "foo"), (1, "baz")], "instance_id long, word string")
    got = rt.rehydrate_seen(views, kept, lines, words).orderBy("rank").collect()
    assert [(r.path, r.start_line, r.hits) for r in got] == [("a", 1, 2), ("b", 1, 1)]


def test_scope_constraints(spark):
    runs = spark.createDataFrame([(1, 5, 0, True, 0), (2, 1, 0, False, 0)], "run_id long, edited_files int, unsupported_files int, submitted_without_tests boolean, patterns int")
    assert [(r.run_id, r.constraint) for r in rt.scope_constraints(runs).orderBy("pos").collect()] == [(1, "cap_files"), (1, "run_tests")]


def test_repeated_edits_keep_what_changed(spark):
    hunks = spark.createDataFrame([(1, "a", "x = old(1)", "x = new(1)"), (1, "b", "y = old(2)", "y = new(2)"), (1, "c", "p", "q")], "run_id long, file string, removed string, added string")
    assert [(r.before, r.after, r.n_files) for r in rt.repeated_edits(hunks).collect()] == [("old", "new", 2)]


def test_exact_names_before_parts(spark):
    tests = spark.createDataFrame([("t/a.py", "test_x"), ("t/b.py", "test_x_more"), ("t/c.py", "test_y_long")], "path string, name string")
    names = spark.createDataFrame([("t/a.py::test_x[1]",), ("test_y",)], "failed string")
    assert sorted((r.path, r.exact) for r in rt.failed_test_sites(tests, names).collect()) == [("t/a.py", True), ("t/c.py", False)]


def test_parallel_implementations(spark):
    frame = spark.createDataFrame
    files = frame([("a/itrs_observed.py",), ("a/b/icrs_observed.py",), ("c/observed_itrs_x.py",), ("c/other.py",), ("d/observed.py",)], "path string")
    edited = frame([(1, "a/itrs_observed.py")], "run_id long, path string")
    symbols = frame([("d/observed.py", "K.transform"), ("d/observed.py", "J.transform"), ("c/other.py", "K.transform")], "path string, name string")
    siblings = frame([(1, "a/itrs_observed.py", "Other", 0.7)], "run_id long, path string, sibling string, score double")
    hints = frame([(1, "M.transform"), (1, "M.run")], "run_id long, hint string")
    got = rt.parallel_implementations(files, edited, symbols, hints, siblings, 9).orderBy("rank").collect()
    assert [(r.path, r.symbol, r.score) for r in got] == [("c/observed_itrs_x.py", "observed_itrs_x", 0.75), ("a/itrs_observed.py", "Other", 0.7), ("a/b/icrs_observed.py", "icrs_observed", 0.7), ("d/observed.py", "observed", 0.7)]
    assert rt.parallel_implementations(files, edited.limit(0), symbols, hints, siblings.limit(0)).count() == 0


def test_changes_of_lines_and_dotted_names(spark):
    rows = [
        (1, "a.py", "x = collections.Mapping\n\n  keep", "x = collections.abc.Mapping\nkeep"),
        (1, "b.py", "isinstance(v, collections.Mapping)", "isinstance(v, collections.abc.Mapping)"),
        (1, "c.py", "m = a.b.c", "m = a.b.x.c.d"),  # two links more
        (1, "d.py", "m = a.b.c", "n = q.a.b.c; a.b.c.q; a.q.b.c"),
        (2, "a.py", "x = 1\ny = 2", "x = 3"),
        (2, "b.py", "x = 1", "x = 3\nz"),
        (2, "c.py", "abcabc", "xbcxbc"),  # two stretches
        (2, "d.py", "abcabc", "xbcxbc"),
        (3, "a.py", "same", "same"),
        (3, "b.py", "", "new"),
        (4, "a.py", "foo(a)", "foo(a, b)"),
        (4, "a.py", "foo(c)", "foo(c, b)"),
    ]
    hunks = spark.createDataFrame(rows, "run_id long, file string, removed string, added string")
    got = sorted((r["run_id"], r["before"], r["after"], r["n_files"]) for r in rt.repeated_edits(hunks).collect())
    assert got == [(1, "", "abc.", 2), (1, "collections.Mapping", "collections.abc.Mapping", 2), (2, "1", "3", 2)]
    named = sorted((r["file"], r["before"], r["after"]) for r in rt.chain_changes(hunks).where("run_id = 1 AND file > 'b.py'").collect())
    assert named == [("d.py", "a.b.c", a) for a in ("a.b.c.q", "a.q.b.c", "q.a.b.c")]
