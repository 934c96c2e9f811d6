"""Queries over whole inputs against DuckDB, and that they leave out nothing."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from repairlens.plans import registry
from repairlens.plans.fixtures import frame

SF = "/root/testdata/sf0.001"


def rows(df, columns):
    return sorted(repr([r[c] for c in columns]) for r in df.collect())


def from_duckdb(name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    ran = con.execute(registry.oracle_sql()[name])
    return [c[0] for c in ran.description], sorted(repr(list(r)) for r in ran.fetchall())


@pytest.mark.parametrize("name", ["rule_diagnosis_whole", "diagnosis_plan_whole", "hypotheses_whole"])
def test_every_failure_is_diagnosed(spark, name):
    found = registry.queries()[name](spark, SF)
    columns, want = from_duckdb(name)
    assert rows(found, columns) == want
    assert found.select("run_id").distinct().count() == frame(spark, SF, "failures").count()


def test_test_runs_of_every_run_are_paired(spark):
    runs = registry.queries()["pair_test_runs"](spark, SF).select((F.col("run_id") % 3).alias("r")).distinct().collect()
    assert {r.r for r in runs} == {0, 1, 2}


@pytest.mark.parametrize("name", ["rehydrate_seen_whole", "error_edit_alignment_whole", "align_evidence_whole"])
def test_spans_are_taken_whole(spark, name):
    columns, want = from_duckdb(name)
    assert want and rows(registry.queries()[name](spark, SF), columns) == want
    sql = registry.oracle_sql()[name]
    assert not any(cut in sql for cut in ("instance_id < ", "start_line < 2", "start_line > 8", "% 50 = 0"))


def test_instances_beyond_the_fortieth_are_seen_again(spark):
    found = {r.instance_id for r in registry.queries()["rehydrate_seen_whole"](spark, SF).select("instance_id").distinct().collect()}
    assert max(found) >= 40
