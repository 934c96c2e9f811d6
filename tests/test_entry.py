"""The registered queries: names, SQL, a sample against DuckDB, and imports without the optional subpackage."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from repairlens.plans import registry

SF = "/root/testdata/sf0.001"
HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_belongs_to_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.queries()) >= 120


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["run_id", "step", "role", "content", "pos"] and df.count() > 0


@pytest.mark.parametrize("name", ["compress_conversations", "cluster_failures", "incremental_recall", "build_witnesses", "diff_lines", "deficiency_confidence", "quota_sample"])
def test_sample_equals_duckdb(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    ran = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in ran.description]
    norm = lambda v: round(float(v), 9) if isinstance(v, float) else v
    want = sorted(repr([norm(v) for v in row]) for row in ran.fetchall())
    got = sorted(repr([norm(r[c]) for c in columns]) for r in registry.queries()[name](spark, SF).collect())
    assert got == want


def test_imports_without_the_optional_subpackage(tmp_path):
    shutil.copytree(f"{HERE}/repairlens", tmp_path / "repairlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{HERE}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(n.startswith('op') and n[2].isdigit() for n in q); print(len(q), len(e.oracle_sql()))"
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert ran.returncode == 0, ran.stderr
