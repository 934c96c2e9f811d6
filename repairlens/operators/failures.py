"""Failure messages, events and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repairlens.functions.stored import checkpointed
from repairlens.functions.text import strip

# Masking rules in order, and coarse classes of exceptions.
MASKS = [
    (r"(unexpected keywords?: \[)[^\]]+(\])", "$1'<KW>'$2"),
    (r"(unsupported operand type\(s\) for[^:]+:)\s*'[^']*'\s*and\s*'[^']*'", "$1 '<A>' and '<B>'"),
    (r"(cannot import name\s+)'([^']+)'\s+from\s+'([^']+)'", "$1'<NAME>' from '<PACKAGE>'"),
    (r"(module\s+)'([^']+)'\s+has no attribute\s+'([^']+)'", "$1'<MOD>' has no attribute '<ATTR>'"),
    (r"(?U)\b\d+\b", "<N>"),
    (r"(?U)/[\w/.-]+(?:\.\w+)?", "<path>"),
    (r"0x[0-9a-fA-F]+", "<hex>"),
    (r"(?U)(:)(\d+)\b", "$1<N>"),
]
CLASSES = {
    "TypeError": "TYPE_ERROR", "AssertionError": "ASSERTION_ERROR", "AttributeError": "ATTRIBUTE_ERROR",
    "ImportError": "IMPORT_ERROR", "ModuleNotFoundError": "IMPORT_ERROR", "ValueError": "VALUE_ERROR",
    "KeyError": "KEY_ERROR", "IndexError": "INDEX_ERROR", "NameError": "NAME_ERROR", "TimeoutError": "TIMEOUT", "OSError": "OS_ERROR",
}
UNINFORMATIVE = ["AssertionError:", "AssertionError", "Error:", "", "?"]


def normalize_message(col: Column) -> Column:
    """Variable parts of an error message as placeholders."""
    for pattern, mark in MASKS:
        col = F.regexp_replace(col, pattern, mark)
    return strip(col)


def error_class(col: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in CLASSES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, col), F.lit("OTHER"))


def failure_events(failures: DataFrame, depth: int = 5) -> DataFrame:
    """One normalised event for each failure (run_id, ord, test_name, exception_type, error_message, root_frame, frames if there are)."""
    chain = F.array().cast("array<string>")
    if "frames" in failures.columns:
        repo = F.filter("frames", lambda f: f["is_repo_frame"])
        chain = F.transform(F.slice(repo, 1, depth), lambda f: F.concat(f["file"], F.lit(":"), f["line"].cast("string")))
    return failures.select(
        "run_id",
        "ord",
        "test_name",
        "exception_type",
        error_class(F.col("exception_type")).alias("error_class"),
        normalize_message(F.coalesce("error_message", F.lit(""))).alias("fingerprint"),
        chain.alias("call_chain"),
        F.col("root_frame").alias("top_frame"),
        F.contains("test_name", F.lit("[")).alias("is_parameterized"),
        F.substring_index("test_name", "[", 1).alias("param_group"),
    )


def distinct_frames(chain: Column) -> Column:
    """The distinct frames of a chain, sorted, null last; only a chain that has a null is sorted by comparing in turn, which is slow."""
    once = F.array_distinct(chain)
    return F.when(F.exists(once, lambda x: x.isNull()), F.array_sort(once)).otherwise(F.sort_array(once))


def seed_groups(events: DataFrame, shared: int = 2) -> DataFrame:
    """(run_id, error_class, chain, seed) of events (run_id, ord, error_class, call_chain): in order of ord, each event that is left opens a group, named by its ord, and takes the later ones that share two frames or more with it.

    Two chains share two frames if they share a pair of frames, so events meet under pairs: only
    the least of each pair is ever looked up, and no pair of events is made. In each round events
    that are the first of all that is left under every pair of theirs open groups, and whatever
    shares a pair with them is taken. Chains of the same frames count once. ``chain`` has the
    distinct frames, sorted; those with fewer than two never meet and are left out. Rounds are as
    many as the longest line of events of which each waits for the one before.
    """
    if shared != 2:
        raise ValueError("events meet under pairs of frames")
    key = ["run_id", "error_class"]
    given = events.groupBy(*key, "call_chain").agg(F.min("ord").alias("ord"))  # most events repeat a chain: frames are sorted once for each
    chains = given.select(*key, "ord", distinct_frames(F.col("call_chain")).alias("chain")).groupBy(*key, "chain").agg(F.min("ord").alias("ord"), F.max(F.size("chain")).alias("n")).where("n > 1").drop("n")
    pairs = F.flatten(F.transform("chain", lambda x, i: F.transform(F.slice("chain", i + 2, F.size("chain")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    held = checkpointed(chains.select(*key, "chain", "ord", F.struct("ord", F.xxhash64("chain").alias("h")).alias("who")))
    under = lambda df: df.select(*key, "who", F.explode(pairs).alias("pair"))
    left, opened = held, None
    while True:
        entered = under(left)
        first = entered.groupBy(*key, "pair").agg(F.min("who").alias("first"))
        met = checkpointed(entered.join(first.hint("merge"), [*key, "pair"]))
        opens = met.groupBy(*key, "who").agg(F.bool_and(F.col("who") == F.col("first")).alias("all")).where("all").select(*key, "who")
        opens = checkpointed(left.join(opens.hint("merge"), [*key, "who"], "left_semi"))
        opened = opens if opened is None else opened.unionByName(opens)
        taken = met.join(opens.select(*key, F.col("who").alias("first")).hint("merge"), [*key, "first"], "left_semi").select(*key, "who").distinct()
        left = checkpointed(left.join(taken.hint("merge"), [*key, "who"], "left_anti"))
        if left.isEmpty():
            break
    least = under(opened).groupBy(*key, "pair").agg(F.min("who").alias("seed"))
    best = under(held).join(least.hint("merge"), [*key, "pair"]).groupBy(*key, "who").agg(F.min("seed").alias("seed"))
    return held.join(best.hint("merge"), [*key, "who"]).select(*key, "chain", F.col("seed.ord").alias("seed"))


def cluster_failures(events: DataFrame) -> DataFrame:
    """(run_id, ord, stage, cluster): each event in the first group that takes it.

    1 parameter family and class, if a fingerprint, a top frame or a frame is common to all;
    2 the same informative fingerprint; 3 the same top frame; 4 the same class and two shared
    frames with the first event left; else a cluster of its own.
    """
    informative = F.when(~F.col("fingerprint").isin(UNINFORMATIVE), F.col("fingerprint"))
    frame = F.nullif("top_frame", F.lit(""))
    key = ["run_id", "param_group", "error_class"]
    family = events.where("is_parameterized")
    chained = family.where("size(call_chain) > 0")
    common = chained.select(*key, "ord", F.explode(F.array_distinct("call_chain")).alias("frame")).groupBy(*key, "frame").agg(F.count("*").alias("n")).groupBy(*key).agg(F.max("n").alias("widest"))
    sizes = family.groupBy(*key).agg(
        F.count("*").alias("n"), F.count_if(F.size("call_chain") > 0).alias("chains"), (F.min(informative) == F.max(informative)).alias("one_print"), (F.min(frame) == F.max(frame)).alias("one_frame")
    )
    yes = lambda c: F.coalesce(c, F.lit(False))
    holds = sizes.join(common.hint("merge"), key, "left").where("n > 1").where(yes(F.col("one_print")) | yes(F.col("one_frame")) | ((F.col("chains") > 1) & yes(F.col("widest") == F.col("chains")))).select(*key, F.lit(True).alias("merged"))
    first = events.join(holds.hint("merge"), key, "left").withColumn("p1", F.col("is_parameterized") & yes(F.col("merged")))
    in_group = lambda done, value: F.count(F.when(~done, value)).over(Window.partitionBy("run_id", done, value))
    second = first.withColumn("print", informative).withColumn("p2", ~F.col("p1") & F.col("print").isNotNull() & (in_group(F.col("p1"), F.col("print")) > 1))
    done = F.col("p1") | F.col("p2")
    third = second.withColumn("done", done).withColumn("frame", frame).withColumn("p3", ~F.col("done") & F.col("frame").isNotNull() & (in_group(F.col("done"), F.col("frame")) > 1))
    rest = third.withColumn("waits", ~F.col("done") & ~F.col("p3")).withColumn("chain", F.when(F.col("waits"), distinct_frames(F.col("call_chain"))))
    seeds = seed_groups(rest.where("waits").select("run_id", "ord", "error_class", "call_chain"))
    joined = rest.join(seeds.hint("merge"), ["run_id", "error_class", "chain"], "left")
    stage = F.when(F.col("p1"), 1).when(F.col("p2"), 2).when(F.col("p3"), 3).otherwise(4)
    name = (
        F.when(F.col("p1"), F.concat_ws("|", F.lit("family"), "param_group", "error_class"))
        .when(F.col("p2"), F.concat_ws("|", F.lit("print"), "print"))
        .when(F.col("p3"), F.concat_ws("|", F.lit("frame"), "frame"))
        .otherwise(F.concat_ws("|", F.lit("seed"), F.coalesce("seed", "ord").cast("string")))
    )
    return joined.select("run_id", "ord", stage.alias("stage"), name.alias("cluster"))


def cluster_summary(events: DataFrame, members: DataFrame) -> DataFrame:
    """(run_id, cluster, cluster_id, n, n_types, error_class, top_frame): id from the sorted members; class and frame of the first one."""
    canonical = F.concat_ws("|", "test_name", "error_class", "fingerprint", "top_frame")
    both = events.join(members.hint("merge"), ["run_id", "ord"])
    return both.groupBy("run_id", "cluster").agg(
        F.concat(F.lit("C"), F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(canonical)), "\n"), 256), 1, 7)).alias("cluster_id"),
        F.count("*").alias("n"),
        F.count_distinct("exception_type").alias("n_types"),
        F.min_by("error_class", "ord").alias("error_class"),
        F.min_by("top_frame", "ord").alias("top_frame"),
    )


def cluster_frames(events: DataFrame, members: DataFrame) -> DataFrame:
    """(run_id, cluster, shared_frames, root_cause, error_types, test_names) of failure_events() and cluster_failures().

    Shared frames are those in the call chains of all members, in the order of the first member's
    chain; a member alone shares its own chain. The root cause is the first of them, else the
    first member's top frame. error_types counts exception types (``type:n``, sorted), test_names
    are in order of the members.
    """
    both = events.join(members.select("run_id", "ord", "cluster").hint("merge"), ["run_id", "ord"])
    key = ["run_id", "cluster"]
    sizes = both.groupBy(*key).agg(F.count("*").alias("n"), F.min_by(F.struct("call_chain", "top_frame"), "ord").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "test_name"))), lambda x: x["test_name"]).alias("test_names"))
    held = both.select(*key, F.explode(F.array_distinct("call_chain")).alias("frame")).groupBy(*key, "frame").agg(F.count("*").alias("held"))
    common = held.join(sizes.select(*key, "n").hint("merge"), key).where("held = n").groupBy(*key).agg(F.collect_set("frame").alias("common"))
    types = both.groupBy(*key, "exception_type").agg(F.count("*").alias("k")).groupBy(*key).agg(F.array_sort(F.collect_list(F.concat_ws(":", "exception_type", F.col("k").cast("string")))).alias("error_types"))
    full = sizes.join(common.hint("merge"), key, "left").join(types.hint("merge"), key)
    shared = F.filter("first.call_chain", lambda f: F.array_contains(F.coalesce("common", F.array().cast("array<string>")), f))
    return full.withColumn("shared_frames", shared).select(*key, "shared_frames", F.coalesce(F.get("shared_frames", F.lit(0)), "first.top_frame").alias("root_cause"), "error_types", "test_names")
