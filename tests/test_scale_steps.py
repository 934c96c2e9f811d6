"""Steps whose work must grow no faster than their input: plans and results on small tables."""

import difflib
import random

from pyspark.sql import functions as F

from repairlens.functions import joins, python_lines
from repairlens.functions.text import lines_py
from repairlens.operators import acquisition as aq
from repairlens.operators import failures as fl
from repairlens.operators import hints as hn
from repairlens.operators import retrieval as rt
from repairlens.operators import source_tree as st


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_few_terms_cost_no_letter_runs(spark):
    """code_search: three terms are compared with each line in one pass; no run of letters is made."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab c\n") for _ in range(rng.randrange(40))) for _ in range(200)]
    files = spark.createDataFrame([(f"p/{i:03}.py", t) for i, t in enumerate(texts)] + [("p/none.py", None)], "path string, content string")
    asked = ["ab", "b a", "c a b", "x"]
    found = st.code_search(st.code_lines(files), spark.createDataFrame([(q,) for q in asked], "query string"))
    assert "regexp_extract_all" not in plan_of(found)
    want = []
    for q in asked[:3]:
        hits = [(f"p/{i:03}.py", n) for i, t in enumerate(texts) for n, line in enumerate(t.split("\n"), 1) if q in line]
        want += [(q, path, n, max(1, n - 20), n + 20) for path, n in sorted(hits)[:5]]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_many_terms_are_looked_up(spark):
    """More terms than FEW still go through the index, and both ways find the same."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(30))) for _ in range(200)]
    terms = sorted({"".join(rng.choice("abcd") for _ in range(n)) for n in (1, 2, 3, 4, 5) for _ in range(60)})
    assert len(terms) > joins.FEW
    left = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    hits = joins.join_contains(left, F.col("text"), spark.createDataFrame([(t,) for t in terms], "term string"), "term")
    assert "regexp_extract_all" in plan_of(hits)
    assert sorted((r["id"], r["term"]) for r in hits.collect()) == sorted((i, t) for i, x in enumerate(texts) for t in terms if t in x)


def test_lines_of_a_text_are_made_once(spark):
    texts = ["", "\n", "a\n\nb\n", "a\r\nb\rc", "a b\x85c\x1cd\x0b", "x\r", None, "\r\n\r\n", "é\x0cz"]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")
    got = {}
    for r in st.code_lines(files).orderBy("path", "ln").collect():
        got.setdefault(int(r["path"]), []).append(r["text"])
    assert got == {i: t.splitlines() for i, t in enumerate(texts) if t and t.splitlines()}
    assert plan_of(files.select(lines_py(F.col("content")).alias("lines"))).count("split(") == 1


def test_scan_ends_with_the_blocks_that_are_asked_for():
    """route_plan: a failure site at the top of a long file costs its own block, not the whole file."""
    rng = random.Random(9)
    parts = ["def f(x):", "class A:", "    def g(self):", "        return (1,", "2)", "    x = '''a", "b'''", "# c", "", "y = [", "]", "    async def h(): pass", "it's"]
    for _ in range(300):
        source = "\n".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        for until in (0, 1, 3, 9, 99):
            assert python_lines.definitions(source, until) == [d for d in python_lines.definitions(source) if d[3] <= until]
    seen = []
    scan = python_lines.logical_lines
    python_lines.logical_lines = lambda source: (seen.append(x[1]) or x for x in scan(source))
    try:
        assert python_lines.definitions("def f(x):\n    return 1\n" + "y = 1\n" * 100_000, 2) == [("def", "f", None, 1, 2)]
    finally:
        python_lines.logical_lines = scan
    assert seen == [1, 2, 3]


def test_plan_shuffles_texts_once(spark):
    """route_plan: only the join of failure sites with their files carries texts, and few symbols are sought before texts are cut into lines."""
    files = spark.createDataFrame([("a.py", "def go():\n    def go_on():\n        pass\n    x = 1\n"), ("b.py", "x = 'go'\n")], "path string, content string")
    action = "action_id string, action string, kind string, value string, module string, budget int"
    actions = spark.createDataFrame([("s", "FIND_DEFINITION", "SYMBOL", "go", "", 2), ("f", "FIND_DEFINITION", "FILE", "b.py", "", 1), *((f"l{i}", "FIND_DEFINITION", "FAILURE_SITE", f"a.py:{i}", "", 1) for i in (1, 3, 4, 9))], action)
    results, hits = aq.route_plan(actions, files, spark.createDataFrame([], "name string"))
    assert sorted(tuple(r)[:1] + tuple(r)[2:] for r in hits.collect()) == [
        ("f", "b.py", 1, 2, "", "file_read"), ("l1", "a.py", 1, 4, "go", "ast_enclosing_node"), ("l3", "a.py", 2, 3, "go_on", "ast_enclosing_node"),
        ("l4", "a.py", 1, 4, "go", "ast_enclosing_node"), ("l9", "a.py", 4, 4, "", "ast_fallback_lines"), ("s", "a.py", 1, 1, "go", "grep_symbol"),
    ]
    plan = plan_of(aq.failure_sites(files, actions))
    assert plan.count("MapInArrow") == 1
    assert "Join LeftSemi" in plan_of(aq.symbol_definitions(files, actions))


def test_stretches_are_those_of_the_matching_blocks():
    """repeated_edits: substring searches place the one stretch where the standard library's matcher does, at a tenth of its time."""
    rng = random.Random(11)
    for t in range(20_000):
        letters = ("ab", "abcd", "abcdefgh(). ")[t % 3]
        x = "".join(rng.choice(letters) for _ in range(rng.randrange(14)))
        i, k = rng.randrange(len(x) + 1), rng.randrange(4)
        y = x[:i] + "".join(rng.choice(letters + "xyz") for _ in range(rng.randrange(5))) + x[i + k :] if t % 2 else "".join(rng.choice(letters) for _ in range(rng.randrange(14)))
        changed = [op for op in difflib.SequenceMatcher(a=x, b=y, autojunk=False).get_opcodes() if op[0] != "equal"] if x != y else []
        want = (x[changed[0][1] : changed[0][2]], y[changed[0][3] : changed[0][4]]) if len(changed) == 1 else (None, None)
        assert rt._stretch(x, y) == want, (x, y)


def test_small_files_of_hunks_are_dealt_out(spark):
    hunks = spark.range(600).coalesce(1).selectExpr("id % 3 AS run_id", "concat('f', id) AS file", "concat('a = old', id, '(x)') AS removed", "concat('a = new', id, '(x)') AS added")
    edits = rt.repeated_edits(hunks)
    assert sorted(tuple(r) for r in edits.collect()) == [(i, "old", "new", 200) for i in range(3)]
    lines = plan_of(edits).split("\n")
    dealt = [i for i, line in enumerate(lines) if "RepartitionByExpression" in line]
    assert dealt and not any("Filter" in lines[i + 1] for i in dealt)


def test_hints_make_the_lines_of_a_file_once_a_pass(spark):
    """api_hints: each of its passes over the files rewrites and splits a text once."""
    files = spark.createDataFrame([("a/x.py", "class Foo:\n    def html(self): pass\ndef g():\n    return 1\n")], "path string, content string")
    lines = st.code_lines(files).withColumn("repo", F.lit("r"))
    witnesses = spark.createDataFrame([(1, "r", "i1", True, "FooTests.test_x failed"), (2, "r", "i2", True, "")], "run_id long, repo string, instance string, has_failure boolean, message string")
    frames = spark.createDataFrame([(2, 0, "/testbed/a/x.py", 4, "g")], "run_id long, pos int, file string, line int, function string")
    hints = hn.api_hints(witnesses, frames, lines)
    plan = plan_of(hints)
    assert plan.count("split(") == plan.count("Generate posexplode") > 0
    assert sorted((r["run_id"], r["source"], r["target"]) for r in hints.collect()) == [(1, "issue_keyword_api_match", "a/x.py::Foo.html"), (2, "repo_source_signature", "a/x.py::g")]


def test_repeated_chains_are_sorted_once(spark):
    """seed_groups: frames are sorted after events of the same chain are one, and without comparing in turn; order and nulls stay."""
    chains = [["b", "a", "b"], [], ["c", None, "a", None], None, ["é", "z", "Z"], [None]]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(chains)], "i int, call_chain array<string>")
    both = rows.select(fl.distinct_frames(F.col("call_chain")).alias("new"), F.array_sort(F.array_distinct("call_chain")).alias("old")).collect()
    assert [r["new"] for r in both] == [r["old"] for r in both]
    events = spark.range(300).selectExpr("1L AS run_id", "id AS ord", "'X' AS error_class", "CASE id % 3 WHEN 0 THEN array('a', 'b') WHEN 1 THEN array('b', 'a', 'a') ELSE array('b', 'c') END AS call_chain")
    assert sorted((r["chain"], r["seed"]) for r in fl.seed_groups(events).collect()) == [(["a", "b"], 0), (["b", "c"], 2)]


def test_scan_of_a_beginning_is_that_of_the_text():
    """route_plan: a long logical line behind the site isn't scanned, and what a cut text can't tell is read from more of it."""
    rng = random.Random(13)
    parts = ["def f(x):", "class\n  Abcdefgh:", "async  def", "  name()", "    def g(self): return (1,", "2)", "x = '''a", "b'''", "\\", "", "  it's (", "y" * 90, "\r", "# c " * 30, ")"]
    for _ in range(3000):
        source = "\n".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        for until in (0, 1, 2, 5):
            assert python_lines.definitions(source, until) == python_lines._definitions(source, until)[0]
    seen = []
    scan = python_lines.logical_lines
    python_lines.logical_lines = lambda source: seen.append(len(source)) or scan(source)
    try:
        assert python_lines.definitions("def f(x):\n    return 1\n(" + "word, " * 100_000 + ")\n", 2) == [("def", "f", None, 1, 2)]
    finally:
        python_lines.logical_lines = scan
    assert sum(seen) < 1_000


def test_plan_reads_texts_once_and_shuffles_none(spark, monkeypatch):
    """route_plan: one pass over the texts serves all operators; sites far down and more terms than FEW are found too."""
    body = "def go():\n    def go_on():\n        pass\n    x = 1\n"
    files = spark.createDataFrame([("a.py", body), ("b.py", "x = 'go'\r\ny = 1\u2028class Go(go): pass\n\n"), ("c.py", None), ("tests/test_go.py", "go go\nimport m.x"), ("d.py", "z = 1\n" * 1_200 + body), ("go/tests/test_m.py", "pass")], "path string, content string")
    action = "action_id string, action string, kind string, value string, module string, budget int"
    find = [("s", "SYMBOL", "go", 3), ("g", "TYPE_NAME", "x.Go", 1), ("w", "SYMBOL", "a\nb", 1), ("f", "FILE", "b.py", 1), *((f"l{i}", "FAILURE_SITE", f"a.py:{i}", 1) for i in (1, 3, 9)), ("d2", "FAILURE_SITE", "d.py:1203", 1), ("d1", "FAILURE_SITE", "d.py:2", 1), ("c9", "FAILURE_SITE", "c.py:9999", 1)]
    actions = spark.createDataFrame([(i, "FIND_DEFINITION", k, v, "", n) for i, k, v, n in find] + [("t", "FIND_RELATED_TESTS", "SYMBOL", "m.go", "m.x", 3)], action)
    want = [
        ("c9", 1, "c.py", 9994, 1, ""), ("d1", 1, "d.py", 1, 6, ""), ("d2", 1, "d.py", 1202, 1203, "go_on"), ("f", 1, "b.py", 1, 4, ""), ("g", 1, "b.py", 3, 3, "Go"),
        ("l1", 1, "a.py", 1, 4, "go"), ("l3", 1, "a.py", 2, 3, "go_on"), ("l9", 1, "a.py", 4, 4, ""), ("s", 1, "a.py", 1, 1, "go"), ("s", 2, "d.py", 1201, 1201, "go"),
        ("t", 1, "tests/test_go.py", 1, 2, "go"), ("t", 2, "go/tests/test_m.py", 1, 1, "test_m"),
    ]
    failed = spark.createDataFrame([], "name string")
    for few in (joins.FEW, 0):
        monkeypatch.setattr(joins, "FEW", few)
        hits = aq.route_plan(actions, files, failed)[1]
        assert sorted(tuple(r)[:6] for r in hits.collect()) == want
    monkeypatch.undo()
    near = actions.where("action_id NOT IN ('d2', 'c9')")
    plan = plan_of(aq.route_plan(near, files, failed)[1])
    assert "content" not in plan and "MapInArrow" not in plan
    odd = ["", "\n", "a\n\n", "a\n\r", "a\n\r\n", "\n\n\n", "a\r\n", "a\n ", "a\n\x85", "\n\nb", None]
    texts = spark.createDataFrame([(str(i), t) for i, t in enumerate(odd)], "path string, content string")
    size = F.size(F.split(F.regexp_replace(F.coalesce("content", F.lit("")), r"\n$", ""), "\n"))
    assert sorted(tuple(r) for r in st.scanned(texts, 2).select("path", "n", "n_lines").collect()) == sorted(tuple(r) for r in texts.select("path", size, aq._n_lines()).collect())


def test_hints_read_lines_once(spark):
    """api_hints: frames and test classes are resolved in one pass over the lines."""
    body = "class Foo:\n    x = 1\n    def text(self): pass\nclass\tBar(Foo):\n\n    def html(self): pass\n    def frame(self): pass\n" + "y = 1\n" * 300 + "def g():\n    return 1\n"
    lines = st.code_lines(spark.createDataFrame([("a/x.py", body), ("a/test_x.py", body), ("a/empty.py", None), ("a/x.txt", "class Baz:")], "path string, content string")).withColumn("repo", F.lit("r"))
    runs = [(i, "r", f"i{i}", True, m) for i, m in enumerate(["FooTests.test_x", "BarTests.test_x", "BazTests.test_x", "", "", "", ""])]
    witnesses = spark.createDataFrame(runs, "run_id long, repo string, instance string, has_failure boolean, message string")
    frames = spark.createDataFrame([(3, 0, "a/x.py", 5, ""), (4, 0, "a/x.py", 9999, ""), (5, 0, "a/x.py", 290, ""), (5, -1, "a/x.py", -4, ""), (6, 0, "a/gone.py", 3, "f"), (6, -1, "a/empty.py", 1, "")], "run_id long, pos int, file string, line int, function string")
    hints = hn.api_hints(witnesses, frames, lines)
    assert plan_of(hints).count("Generate posexplode") == 1
    assert {r["run_id"]: (r["artifact"], r["target"]) for r in hints.collect()} == {
        0: ("a/x.py:1", "a/x.py::Foo.text"), 1: ("", ""), 2: ("", ""), 3: ("a/x.py:5", "a/x.py::Bar"), 4: ("a/x.py:9999", "a/x.py::g"), 5: ("a/x.py:-4", "a/x.py::Foo"), 6: ("a/gone.py:3", "a/gone::f"),
    }


def test_line_ends_are_sought_without_a_pattern(spark):
    """api_hints: a text is split as Python does at every line end, and no pattern is run over a text that has none but line feeds."""
    texts = [f"a{e}b{e}" for e in ("\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", "\u2027", "\xe2", "\xc2", "\x1f")]
    lines = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lines_py(F.col("t")).alias("lines"))
    assert "RLIKE" not in plan_of(lines)
    assert {r["t"]: r["lines"] for r in lines.collect()} == {t: t.splitlines() for t in texts}
