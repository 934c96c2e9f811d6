"""The scan of Python sources against Python's own parser, on a thousand files of the installed library."""

import ast
import glob
import os
import random
import warnings

from repairlens.functions.python_lines import definitions
from repairlens.operators import source_tree as st

KINDS = {ast.FunctionDef: "def", ast.AsyncFunctionDef: "async_def", ast.ClassDef: "class"}


def parsed(source):
    tree = ast.parse(source)
    parents = {id(c): node.name for node in ast.walk(tree) if isinstance(node, ast.ClassDef) for c in node.body}
    return list((KINDS[type(n)], n.name, parents.get(id(n)), n.lineno, n.end_lineno) for n in ast.walk(tree) if type(n) in KINDS)


def test_equals_the_parser_on_a_thousand_files():
    files = sorted(glob.glob(f"{os.path.dirname(ast.__file__)}/**/*.py", recursive=True))
    random.Random(7).shuffle(files)
    done = 0
    for path in files:
        try:
            with open(path, encoding="utf-8", newline="") as f, warnings.catch_warnings():
                warnings.simplefilter("ignore")
                source = f.read()
                want = parsed(source)
        except (SyntaxError, ValueError):
            continue
        assert sorted(definitions(source), key=str) == sorted(want, key=str), path
        done += 1
        if done == 1_000:
            break
    assert done > 500


def test_what_is_no_python_ends_by_indentation():
    assert definitions("") == [] and definitions("\n  # only\n") == []
    assert definitions("def f(x:\n  y\n") == [("def", "f", None, 1, 2)]
    assert definitions("def f(x):\n    return it's\nprose ] here\n  def g(\n") == [("def", "f", None, 1, 2), ("def", "g", None, 4, 4)]


def test_files_as_a_table(spark):
    source = "class A:\n    x = '''\nclass No:\n'''\n    async def m(self): pass\n    def m(self):\n        pass\n"
    files = spark.createDataFrame([("a.py", source), ("b.py", None), ("c.py", source), ("c.py", source)], "path string, content string")
    rows = sorted(tuple(r) for r in st.class_index(files).collect())
    one = [("class", "A", None, 1, 7), ("function", "A.m", "A", 6, 7), ("async_function", "A.m", "A", 5, 5)]
    assert rows == sorted((p, *r) for p in ("a.py", "c.py") for r in one)
    assert sorted((r["path"], r["name"], r["start_line"]) for r in st.symbol_index(files).collect()) == [("a.py", "A", 1), ("a.py", "m", 6), ("c.py", "A", 1), ("c.py", "m", 6)]
