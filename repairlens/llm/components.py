"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repairlens.llm import shared


def _with_least(edges: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """Those rows of edges (a, b) with m, the least neighbour of a among all edges; ``most`` is a bound of the number of edges."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    frequent = shared.frequent_keys(low, ["a"], "n") if most > shared.KEY_ROWS else None
    return shared.spread_join(rows, low.drop("n"), ["a"], frequent, ["b"])


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    """Larger neighbours of each node go to its least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, both.where("b > a"), 2 * most).select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, most: int) -> DataFrame:
    """A node and its smaller neighbours go to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    joined = _with_least(down, down, most)
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b): the least node it is connected with. Each step is written to the shared folder."""
    now = shared.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _state(now)
    while seen[0]:
        larger = _large_star(now, seen[0])
        if seen[0] > shared.KEY_ROWS:
            larger = shared.written(larger, "edges")
        after = shared.written(_small_star(larger, seen[0]), "edges")
        shared.forget(now)
        state, now = _state(after), after
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
