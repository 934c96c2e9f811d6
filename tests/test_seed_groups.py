"""Greedy seeding in rounds against the same rule done one event after another."""

import random

from repairlens.operators import failures as fl

EVENTS = "run_id long, ord long, error_class string, call_chain array<string>"


def greedy(rows):
    out, left = {}, sorted(rows, key=lambda r: r[1])
    while left:
        seed = left[0]
        mine = [r for r in left if r[0] == seed[0] and r[2] == seed[2] and (r is seed or len(set(r[3]) & set(seed[3])) >= 2)]
        out |= {r[1]: seed[1] for r in mine}
        left = [r for r in left if r[1] not in out]
    return out


def seeds(spark, rows):
    groups = {(r["run_id"], r["error_class"], tuple(r["chain"])): r["seed"] for r in fl.seed_groups(spark.createDataFrame(rows, EVENTS)).collect()}
    return {r[1]: groups.get((r[0], r[2], tuple(sorted(set(r[3])))), r[1]) for r in rows}


def test_random_groups(spark):
    for seed in range(3):
        rng = random.Random(seed)
        rows = [(rng.randrange(3), i, rng.choice("XY"), [f"f{rng.randrange(6 + 5 * seed)}" for _ in range(rng.randrange(6))]) for i in range(400)]
        rng.shuffle(rows)
        assert seeds(spark, rows) == greedy(rows)


def test_a_line_of_events_each_waiting_for_the_one_before(spark):
    rows = [(1, i, "X", [f"f{2 * i}", f"f{2 * i + 1}", f"f{2 * i + 2}", f"f{2 * i + 3}"]) for i in range(9)]
    assert seeds(spark, rows) == greedy(rows) == {i: i - i % 2 for i in range(9)}


def test_no_chains(spark):
    assert fl.seed_groups(spark.createDataFrame([], EVENTS)).collect() == []
    assert fl.seed_groups(spark.createDataFrame([(1, 1, "X", ["a", "a"]), (1, 2, "X", []), (1, 3, "X", None)], EVENTS)).collect() == []


def test_a_large_group_runs_on_several_tasks(spark):
    """50,000 failures of one run and class: no task gets them all."""
    events = spark.range(50_000).selectExpr("1L AS run_id", "id AS ord", "'X' AS error_class", "array(concat('a', id % 40), concat('b', id % 37), concat('c', id % 31)) AS call_chain")
    groups = fl.seed_groups(events)
    assert groups.count() == 40 * 37 * 31
    assert groups.select("seed").distinct().count() > 100
