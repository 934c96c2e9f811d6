"""Queries from failures, naming gates, fairness of branches and registry filters: golden rows."""

from repairlens.operators import guards as gd
from repairlens.operators import planning as pl
from repairlens.operators import selection as sl
from repairlens.operators import source_tree as st


def test_queries_of_failures(spark):
    rows = [(1, [" ab1 ", "x", None, "Tok0", "Tok0"], "AcmeError models.E012 AcmeError Tok0 fields.W9 admin.W900"), (2, None, None), (3, [], "nothing")]
    got = sorted((r["instance_id"], r["rank"], r["query"]) for r in st.failure_queries(spark.createDataFrame(rows, "instance_id long, error_tokens array<string>, trace string"), 5).collect())
    assert got == [(1, 0, "ab1"), (1, 1, "Tok0"), (1, 2, "Tok0"), (1, 3, "AcmeError"), (1, 4, "models.E012")]
    names = spark.createDataFrame([(1, ["t::a", " t::a ", "no", None, "0b0", "1c1", "t::2"]), (2, None)], "instance_id long, test_failures array<string>")
    assert [r["query"] for r in st.test_name_queries(names, 3).orderBy("rank").collect()] == ["t::a", "0b0", "1c1"]


def test_gates_of_names(spark):
    gates = lambda files, pool: [r["ok"] for r in gd.name_gates(spark.createDataFrame(files, "canonical string, name string"), spark.createDataFrame(pool, "canonical_id string")).orderBy("gate").collect()]
    assert gates([("a/b", "a__b.json"), ("c", "c.json")], [("a",), ("b",)]) == [True, True, True, True]
    assert gates([("a/b", "x.json"), (None, "y.json"), ("c", "c.json"), ("c", "c.json")], [("a",), ("a",)]) == [False, False, False, False]
    assert gates([("a", None)], [("a",), (None,)]) == [False, False, True, True]
    assert gates([], []) == [True, True, True, True]


def test_fair_branches(spark):
    columns = "run_id long, base_sha string, first_sha string, second_sha string, base_state string, first_state string, second_state string, first_restored boolean, second_restored boolean, second_run boolean, first_intact boolean, second_intact boolean, first_status string, second_status string"
    rows = [
        (1, "s", "s", "s", "w", "w", "w", True, True, True, True, True, "RESOLVED", "UNRESOLVED"),
        (2, "s", "s", "x", "w", "w", "w", True, True, True, True, True, "ERROR", "RESOLVED"),
        (3, "s", "s", None, "w", "v", None, True, None, False, True, None, "RESOLVED", None),
        (4, "", "", "", "w", "w", "w", True, True, True, False, True, "RESOLVED", "TIMEOUT"),
        (5, None, "s", "s", None, None, None, True, True, None, None, None, None, None),
    ]
    got = {r["run_id"]: (r["fair"], r["same_state"], r["first_valid"], r["second_valid"]) for r in pl.branch_fairness(spark.createDataFrame(rows, columns)).collect()}
    assert got == {1: (True, True, True, True), 2: (False, False, False, True), 3: (True, False, True, True), 4: (False, False, False, False), 5: (False, False, False, True)}


def test_assumptions_that_fail(spark):
    table = lambda rows: spark.createDataFrame(rows, "run_id long, pos int, file string")
    edits = table([(1, 1, "src/b.py"), (1, 0, "src/a.py"), (1, 2, "c"), (1, 3, "d"), (2, 0, "x/q.py"), (3, 0, "a.py")])
    got = pl.rejected_assumptions(edits, table([(1, 0, "lib/z.py"), (2, 0, "y/q.py"), (4, 0, "a.py")])).collect()
    assert [tuple(r) for r in got] == [(1, "edited src/a.py, src/b.py, c but error is in lib/z.py", "lib/z.py")]


def test_registry_filters(spark):
    rows = spark.createDataFrame([(1, "dev", "s1", "Python"), (2, "held", "s2", "go"), (3, None, "s1", None)], "id long, pool string, source string, language string")
    ids = lambda **k: sorted(r["id"] for r in sl.filter_registry(rows, **k).collect())
    assert ids() == [1, 2, 3] and ids(pools=["dev", "held"]) == [1, 2] and ids(languages=["PYTHON"]) == [1] and ids(sources=["s1"], languages=["go"]) == [] and ids(pools=[]) == []
