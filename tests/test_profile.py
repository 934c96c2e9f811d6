"""Positions in buckets come from counts by size, not from sorted rows of a whole bucket."""

import random

from pyspark.sql import functions as F

from repairlens.operators import evaluation as ev


def test_positions_equal_those_of_sorted_rows(spark):
    random.seed(2)
    sizes = [random.choice([1, 2, 2, 9, 10, 11, 29, 30, 31, 500]) for _ in range(503)] + [None, None]
    got = {r.bucket: (r.n, r["median"], r.p90) for r in ev.difficulty_profile(spark.createDataFrame(list(enumerate(sizes)), "instance_id long, size long")).collect()}
    buckets = {"small": [], "medium": [], "large": []}
    for x in sorted(sizes, key=lambda x: (x is not None, x or 0)):
        buckets["large" if x is None or x >= 30 else "small" if x < 10 else "medium"].append(x)
    assert got == {b: (len(v), v[len(v) // 2], v[int(len(v) * 0.9)]) for b, v in buckets.items()}


def test_windows_see_distinct_sizes_alone(spark):
    rows = spark.range(20_000).select(F.col("id").alias("instance_id"), (F.col("id") % 40).alias("size"))
    plan = ev.difficulty_profile(rows)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.rindex("Window") :]
    assert "Aggregate" in below


def test_hardest_easiest_and_repo_mix(spark):
    rows = [("a__b-1", "a/b", 0), ("a__b-2", None, 3), ("c__d-1", "", 3), ("c__d-2", "c/d", 40), ("e-1", "e", None)]
    table = spark.createDataFrame(rows, "instance_id string, repo string, solved int")
    assert {r.bucket: r.n for r in ev.solved_histogram(table).collect()} == {"0 (unsolved)": 1, "1-5 (hard)": 2, "31+ (trivial)": 1}
    assert [(r.side, r.instance_id) for r in ev.hardest_easiest(table, 2, 1).collect()] == [("hardest", "a__b-1"), ("hardest", "a__b-2"), ("easiest", "e-1")]
    assert [(r.repo, r.n) for r in ev.hard_repo_mix(table, 3).collect()] == [("a/b", 2), ("c/d", 1)]
    assert ev.hard_repo_mix(table.limit(0)).count() == 0
