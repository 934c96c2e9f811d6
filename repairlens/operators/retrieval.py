"""Candidates for further reading: sibling classes, tests by name, imports, inspections, and repeated edits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repairlens.functions.joins import join_contains, join_list
from repairlens.functions.text import strip
from repairlens.operators.source_tree import mark_already_seen


def _tokens(name: Column) -> Column:
    """Parts of a camel-case name of four letters or more, in small letters."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(name, F.lit(r"[A-Z][a-z]+"), F.lit(0)), F.lower), lambda t: F.length(t) >= 4))


# Fixed values, in hundredths: base score of a file of like name, per shared part and its limit, same folder, per hinted symbol and its limit, highest score; shortest part and symbol.
PARALLEL = {"base": 55, "part": 10, "parts": 25, "folder": 5, "symbol": 5, "symbols": 15, "highest": 95}
SHORTEST_PART, SHORTEST_TAIL = 3, 4


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def _name_parts(path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(_stem(path), r"[_\-.]"), lambda t: F.length(t) >= SHORTEST_PART))


def parallel_implementations(files: DataFrame, edited: DataFrame, symbols: DataFrame, hints: DataFrame, siblings: DataFrame, budget: int = 3) -> DataFrame:
    """(run_id, rank, path, symbol, relation, score, overlap): the best sibling classes and files named like a run's edited ones.

    files (path), edited (run_id, path), symbols (path, name), hints (run_id, hint), siblings
    (run_id, path, sibling, score) as sibling_classes finds them. A file counts by the parts its
    name shares with those of the run's edited files, the folder, and the hinted symbols it holds.
    At equal scores siblings come first, then more shared parts, then the path.
    """
    own = edited.select("run_id", "path").distinct()
    wanted = own.select("run_id", F.explode(_name_parts(F.col("path"))).alias("part")).distinct()
    folders = own.groupBy("run_id").agg(F.collect_set(F.concat(F.regexp_replace("path", "/?[^/]*$", ""), F.lit("/"))).alias("folders"))
    parts = files.select("path").distinct().select("path", F.explode(_name_parts(F.col("path"))).alias("part"))
    alike = join_list(parts, wanted, "part").groupBy("run_id", "path").agg(F.count("*").alias("overlap")).join(own.hint("merge"), ["run_id", "path"], "left_anti")
    tail = lambda c: F.lower(F.element_at(F.split(c, r"\."), -1))
    tails = symbols.select("path", tail("name").alias("tail")).where(F.length("tail") >= SHORTEST_TAIL).distinct()
    hinted = hints.select("run_id", tail("hint").alias("tail")).where(F.length("tail") >= SHORTEST_TAIL).distinct()
    held = join_list(alike.select("run_id", "path").join(tails.hint("merge"), "path"), hinted, ["run_id", "tail"]).groupBy("run_id", "path").agg(F.count("*").alias("held"))
    both = alike.join(held.hint("merge"), ["run_id", "path"], "left").join(folders.hint("merge"), "run_id")
    p = PARALLEL
    points = F.lit(p["base"]) + F.least(p["part"] * F.col("overlap"), F.lit(p["parts"])) + F.when(F.exists("folders", lambda d: F.startswith("path", d)), p["folder"]).otherwise(0)
    points += F.least(p["symbol"] * F.coalesce("held", F.lit(0)), F.lit(p["symbols"]))
    found = both.select("run_id", "path", _stem(F.col("path")).alias("symbol"), F.lit("parallel_implementation").alias("relation"), (F.least(points, F.lit(p["highest"])) / 100).alias("score"), "overlap")
    every = found.unionByName(siblings.select("run_id", "path", F.col("sibling").alias("symbol"), F.lit("sibling_class_same_file").alias("relation"), "score", F.lit(None).cast("long").alias("overlap")))
    order = Window.partitionBy("run_id").orderBy(F.desc("score"), F.desc("relation"), F.desc("overlap"), "path", "symbol")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= budget).select("run_id", "rank", "path", "symbol", "relation", "score", "overlap")


def sibling_classes(symbols: DataFrame, targets: DataFrame, near: int = 60) -> DataFrame:
    """(path, name, sibling, score): classes (path, name, start_line, end_line) in the file of a target (path, name), by shared parts, beginning, end and distance of their names."""
    classes = symbols.select("path", "name", "start_line", "end_line")
    t, s = classes.join(targets.hint("merge"), ["path", "name"], "left_semi").alias("t"), classes.alias("s")
    pairs = t.join(s.hint("merge"), (F.col("t.path") == F.col("s.path")) & (F.col("t.name") != F.col("s.name"))).join(targets.select(F.col("path").alias("tp"), F.col("name").alias("tn")).hint("merge"), (F.col("s.path") == F.col("tp")) & (F.col("s.name") == F.col("tn")), "left_anti")
    shared = F.size(F.array_intersect(_tokens(F.col("t.name")), _tokens(F.col("s.name"))))
    low = lambda c: F.lower(F.col(c))
    long = F.length("t.name") >= 8
    begin, end = long & (F.substring(low("s.name"), 1, 4) == F.substring(low("t.name"), 1, 4)), long & (F.right(low("s.name"), F.lit(4)) == F.right(low("t.name"), F.lit(4)))
    close = F.least(F.abs(F.col("s.start_line") - F.col("t.end_line")), F.abs(F.col("t.start_line") - F.col("s.end_line"))) <= near
    points = F.lit(55) + F.least(5 * shared, F.lit(20)) + F.when(begin, 5).otherwise(0) + F.when(end, 8).otherwise(0) + F.when(close, 3).otherwise(0)
    return pairs.select("t.path", "t.name", F.col("s.name").alias("sibling"), (F.greatest(F.lit(45), F.least(points, F.lit(95))) / 100).alias("score"))


def failed_test_sites(tests: DataFrame, names: DataFrame) -> DataFrame:
    """(failed, path, name, exact): tests (path, name) of the very name that failed, else such as hold it; names (failed) is the short list of one evaluation."""
    bare = names.withColumn("leaf", F.substring_index(F.element_at(F.split("failed", "::"), -1), "[", 1))
    exact = join_list(tests, bare, F.col("name") == F.col("leaf")).select("failed", "path", "name", F.lit(True).alias("exact"))
    left = bare.join(exact.select("failed").distinct(), "failed", "left_anti")
    part = join_contains(tests, F.col("name"), left, "leaf").select("failed", "path", "name", F.lit(False).alias("exact"))
    return exact.unionByName(part)


def neighbor_tests(tests: DataFrame, concepts: DataFrame, k: int = 2) -> DataFrame:
    """(concept, path, name, n): tests whose names hold most parts of a concept (concept), the best k."""
    parts = concepts.select("concept", F.explode(F.array_distinct(F.filter(F.split(F.lower("concept"), "[^a-z0-9]+"), lambda t: F.length(t) > 2))).alias("part"))
    hits = join_contains(tests, F.lower("name"), parts, "part").groupBy("concept", "path", "name").agg(F.count("*").alias("n"))
    return hits.withColumn("r", F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("n"), "path", "name"))).where(F.col("r") <= k).drop("r")


def required_inspections(sources: dict[str, DataFrame], order: list[str], most: int = 10) -> DataFrame:
    """(run_id, rank, path, source): files of several sources (run_id, path), each under the first source in order that has it, the first ones by source and path."""
    out = None
    for i, name in enumerate(order):
        one = sources[name].select("run_id", "path", F.lit(i).alias("place"), F.lit(name).alias("source"))
        out = one if out is None else out.unionByName(one)
    first = out.groupBy("run_id", "path").agg(F.min(F.struct("place", "source")).alias("s"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy("s.place", "path")) - 1).where(F.col("rank") < most)
    return ranked.select("run_id", "rank", "path", "s.source")


def required_searches(texts: DataFrame, noise: list[str], most: int = 10) -> DataFrame:
    """(run_id, rank, query): distinct words of (run_id, text) in order that are no noise."""
    words = F.array_except(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[A-Za-z_]\w{2,}"), F.lit(0)), F.array(*(F.lit(n) for n in noise)))
    return texts.select("run_id", F.posexplode(F.slice(words, 1, most)).alias("rank", "query"))


def split_actions(plans: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(run_id, pos, operation, kind) of plans (run_id, operations array): retrieval, control or unknown."""
    table = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    return plans.select("run_id", F.posexplode("operations").alias("pos", "operation")).withColumn("kind", F.coalesce(F.try_element_at(table, F.col("operation")), F.lit("unknown")))


def route_actions(actions: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """(action_id, action, status, hits): actions (action_id, action, value) with the number of results (value, ...) of the operator for their kind; kinds without one are unsupported."""
    out = actions.where(~F.col("action").isin(list(found))).select("action_id", "action", F.lit("UNSUPPORTED").alias("status"), F.lit(0).cast("long").alias("hits"))
    for kind, results in found.items():
        counted = results.groupBy("value").agg(F.count("*").alias("n"))
        one = actions.where(F.col("action") == kind).join(counted.hint("merge"), "value", "left")
        out = out.unionByName(one.select("action_id", "action", F.when(F.col("n") > 0, "FOUND").otherwise("NOT_FOUND").alias("status"), F.coalesce("n", F.lit(0).cast("long")).alias("hits")))
    return out


# Fixed value: dotted names.
CHAIN = r"\b([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)\b"


def _shared(x: str, y: str) -> int:
    """How many letters two texts have in common at their beginnings."""
    low, high = 0, min(len(x), len(y))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if x[low:mid] == y[low:mid] else (low, mid - 1)
    return low


def _block(x: str, y: str) -> tuple[int, int, int] | None:
    """The longest common run (start in x, start in y, length), the first in x and then in y, as the standard library's matcher finds it; whether a length occurs is asked of substring searches."""
    occurs = lambda n: any(x[i : i + n] in y for i in range(len(x) - n + 1))
    low = max(_shared(x, y), _shared(x[::-1], y[::-1]))
    step, high = 1, min(len(x), len(y)) + 1
    while low + step < high:  # a longer run is rare: lengths near the known one are asked for first
        if occurs(low + step):
            low, step = low + step, 2 * step
        else:
            high, step = low + step, 1
    if low == 0:
        return None
    i = next(i for i in range(len(x)) if x[i : i + low] in y)
    return i, y.index(x[i : i + low]), low


def _stretch(x: str, y: str) -> tuple[str, str] | tuple[None, None]:
    """The one stretch in which two lines differ, as the matching blocks of the standard library place it; nothing if there are several, or none."""
    p = _shared(x, y)
    s = min(_shared(x[::-1], y[::-1]), len(x) - p, len(y) - p)
    if x == y or not set(x[p : len(x) - s]).isdisjoint(y[p : len(y) - s]):
        return None, None  # what is left between common beginning and end would match again
    todo, changed = [(0, len(x), 0, len(y))], []
    while todo:
        a, b, c, d = todo.pop()
        found = _block(x[a:b], y[c:d])
        if found:
            i, j, n = found
            todo += [(a + i + n, b, c + j + n, d), (a, a + i, c, c + j)]
        elif a < b or c < d:
            changed.append((x[a:b], y[c:d]))
            if len(changed) > 1:
                return None, None
    return changed[0]


def _segment(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """_stretch() of each pair of lines; equal pairs of a batch are compared once."""
    pairs = list(zip(before, after))
    known = {pair: _stretch(*pair) for pair in set(pairs)}
    return pd.DataFrame([known[pair] for pair in pairs], columns=["before", "after"])


def line_changes(hunks: DataFrame) -> DataFrame:
    """(run_id, file, before, after): lines of a hunk side by side, without blank ones, that differ in one stretch."""
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")
    pairs = hunks.select("run_id", "file", F.explode(F.arrays_zip(lines("removed").alias("r"), lines("added").alias("a"))).alias("p")).where("p.r IS NOT NULL AND p.a IS NOT NULL AND p.r <> p.a")
    segment = F.pandas_udf(_segment, "struct<before:string,after:string>")
    return pairs.select("run_id", "file", segment("p.r", "p.a").alias("s")).where("s.before IS NOT NULL").select("run_id", "file", "s.before", "s.after")


def chain_changes(hunks: DataFrame) -> DataFrame:
    """(run_id, file, before, after): dotted names that gain one link within a hunk.

    Each added name is entered once for each of its links, without that link; what a removed
    name equals is a hit. So a hunk costs as many entries as its names have links, and no pairs.
    """
    chains = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(CHAIN), F.lit(1)))
    gone = hunks.where("removed <> '' AND added <> ''").select("run_id", "file", chains("removed").alias("r"), chains("added").alias("a")).where("size(r) > 0 AND size(a) > 0")
    without = lambda links: F.transform(F.sequence(F.lit(0), F.size(links) - 1), lambda k: F.array_join(F.filter(links, lambda x, i: i != k), "."))
    shorter = gone.withColumn("n", F.flatten(F.transform("a", lambda a: F.transform(without(F.split(a, r"\.")), lambda x: F.struct(x.alias("before"), a.alias("after"))))))
    hits = shorter.withColumn("hit", F.array_intersect(F.transform("n", lambda x: x["before"]), "r")).where("size(hit) > 0")
    return hits.select("run_id", "file", F.explode(F.filter("n", lambda x: F.array_contains("hit", x["before"]))).alias("x")).select("run_id", "file", "x.*").distinct()


def repeated_edits(hunks: DataFrame, files: int = 2) -> DataFrame:
    """(run_id, before, after, n_files): changes that occur in two files or more of a run; hunks (run_id, file, removed, added) has lines joined by line feeds.

    A change is the one stretch in which two lines differ, or a dotted name that gains a link.
    """
    parts = hunks.sparkSession.conf.get("spark.sql.shuffle.partitions")
    # Few bytes, much work: a small file would be one task. The second condition always holds and keeps the filters of both branches behind the shuffle.
    hunks = hunks.repartition(int(parts), "run_id", "file").where(F.spark_partition_id() >= 0)
    every = line_changes(hunks).unionByName(chain_changes(hunks)).where("before <> '' OR after <> ''")
    return every.groupBy("run_id", "before", "after").agg(F.count_distinct("file").alias("n_files")).where(F.col("n_files") >= files)


def witness_source_inventory(runs: DataFrame, files: DataFrame, order: list[str]) -> DataFrame:
    """(run_id, source, reason): the first raw output in order that a run has (files: run_id, name, bytes), or why there is none."""
    place = F.array_position(F.array(*(F.lit(n) for n in order)), F.col("name"))
    known = files.withColumn("place", place).where("place > 0")
    best = known.groupBy("run_id").agg(F.min_by("name", F.when(F.col("bytes") > 0, F.col("place"))).alias("source"), F.count("*").alias("n"))
    reason = F.when(F.col("source").isNotNull(), "found").when(F.col("n") > 0, "empty").otherwise("missing")
    return runs.join(best, "run_id", "left").select("run_id", "source", reason.alias("reason"))


SPAN = "struct<score:double,ord:bigint,path:string,start_line:bigint,end_line:bigint,operation:string,relation:string>"


def select_evidence(candidates: DataFrame, required: list[str], max_items: int = 12, max_lines: int = 400, max_files: int = 8) -> DataFrame:
    """(instance_id, rank, path, start_line, end_line, relation) of candidates (instance_id, ord, path, start_line, end_line, operation, relation, score).

    Each span once, by score: two of a path and operation at most, within the budgets; what
    doesn't fit is skipped. Then one candidate of each required relation that is missing, while
    items and lines last.
    """
    first = candidates.groupBy("instance_id", "path", "start_line", "end_line").agg(F.min_by(F.struct("score", "ord", "operation", "relation"), "ord").alias("c"))
    entry = F.struct((-F.col("c.score")).cast("double").alias("score"), F.col("c.ord").cast("bigint").alias("ord"), "path", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"), F.col("c.operation").alias("operation"), F.col("c.relation").alias("relation")).cast(SPAN)
    listed = first.groupBy("instance_id").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    start = F.struct(F.array().cast(f"array<{SPAN}>").alias("kept"), F.lit(0).cast("bigint").alias("lines"))
    size = lambda x: x["end_line"] - x["start_line"] + 1

    def take(acc: Column, x: Column, ok: Column) -> Column:
        fits = ok & (F.size(acc["kept"]) < max_items) & (acc["lines"] + size(x) <= max_lines)
        return F.struct(F.when(fits, F.concat(acc["kept"], F.array(x).cast(f"array<{SPAN}>"))).otherwise(acc["kept"]).alias("kept"), F.when(fits, acc["lines"] + size(x)).otherwise(acc["lines"]).cast("bigint").alias("lines"))

    def by_score(acc: Column, x: Column) -> Column:
        paths = F.array_distinct(F.transform(acc["kept"], lambda k: k["path"]))
        alike = F.size(F.filter(acc["kept"], lambda k: (k["path"] == x["path"]) & (k["operation"] == x["operation"])))
        return take(acc, x, (alike < 2) & (F.array_contains(paths, x["path"]) | (F.size(paths) < max_files)))

    def by_relation(acc: Column, x: Column) -> Column:
        missing = ~F.exists(acc["kept"], lambda k: k["relation"] == x["relation"])
        return take(acc, x, missing)

    folded = listed.select("instance_id", "all", F.aggregate("all", start, by_score).alias("s"))
    names = F.array(*(F.lit(r) for r in required))
    wanted = F.array_sort(F.transform(F.filter("all", lambda x: F.array_contains(names, x["relation"])), lambda x: F.struct(F.array_position(names, x["relation"]).alias("p"), x.alias("x"))))
    both = folded.select("instance_id", F.aggregate(F.transform(wanted, lambda w: w["x"]), F.col("s"), by_relation, lambda acc: acc["kept"]).alias("kept"))
    return both.select("instance_id", F.posexplode("kept").alias("rank", "x")).select("instance_id", "rank", "x.path", "x.start_line", "x.end_line", "x.relation")


def rehydrate_seen(views: DataFrame, kept: DataFrame, lines: DataFrame, keywords: DataFrame, k: int = 4) -> DataFrame:
    """(instance_id, rank, path, start_line, end_line, hits): viewed spans no line of which the final context keeps (both instance_id, path, start_line, end_line), by the number of keywords (instance_id, word) in their code (path, ln, text)."""
    v, f = views.distinct().alias("v"), kept.alias("f")
    overlap = (F.col("v.instance_id") == F.col("f.instance_id")) & (F.col("v.path") == F.col("f.path")) & (F.col("v.start_line") <= F.col("f.end_line")) & (F.col("f.start_line") <= F.col("v.end_line"))
    dropped = v.join(f, overlap, "left_anti")
    words = lines.select("path", "ln", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)))).alias("word"))
    inside = dropped.alias("d").join(words.alias("w").hint("merge"), (F.col("d.path") == F.col("w.path")) & F.expr("w.ln BETWEEN d.start_line AND d.end_line")).select("d.*", "word")
    hits = inside.join(keywords.distinct().hint("merge"), ["instance_id", "word"]).groupBy("instance_id", "path", "start_line", "end_line").agg(F.count_distinct("word").alias("hits"))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("instance_id").orderBy(F.desc("hits"), "path", "start_line", "end_line")) - 1)
    return ranked.where(F.col("rank") < k).select("instance_id", "rank", "path", "start_line", "end_line", "hits")


# Scores and relations of failed tests, and of viewed spans by whether the final context has their file.
REGRESSION, TARGET_FIX = (0.95, "visible_regression_test"), (0.78, "target_fix_test")
DROPPED, UNCOVERED = "previously_seen_but_dropped", "previously_seen_uncovered_file"
SHORTEST_KEYWORD = 4


def failed_test_evidence(tests: DataFrame, names: DataFrame, views: DataFrame) -> DataFrame:
    """(run_id, name, path, symbol, start_line, end_line, score, relation, seen): for each failed test of a run the first function of that name, else the first whose name holds it, else holds it without its test_; regressions score above target fixes.

    tests (path, name, start_line, end_line), names (run_id, name, is_regression), views (run_id,
    path, start_line, end_line). A name that is both counts as a regression; first is by path and line.
    """
    asked = names.where("name <> ''").groupBy("run_id", "name").agg(F.max("is_regression").alias("is_regression"))
    bare = asked.select("name").distinct().withColumn("short", F.regexp_replace("name", "^test_", ""))
    spot = F.struct("path", "start_line", "end_line", F.col("symbol"))
    functions = tests.select("path", F.col("name").alias("symbol"), "start_line", "end_line")
    exact = join_list(functions, bare.select("name"), F.col("symbol") == F.col("name")).groupBy("name").agg(F.min(spot).alias("t"), F.lit(0).alias("tier"))
    held = join_contains(functions, F.col("symbol"), bare.select("name"), "name").groupBy("name").agg(F.min(spot).alias("t"), F.lit(1).alias("tier"))
    short = join_contains(functions, F.col("symbol"), bare.where("short <> ''").select("short").distinct(), "short").groupBy("short").agg(F.min(spot).alias("t"))
    short = bare.join(short.hint("merge"), "short").select("name", "t", F.lit(2).alias("tier"))
    best = exact.unionByName(held).unionByName(short).groupBy("name").agg(F.min_by("t", "tier").alias("t"))
    found = asked.join(best.hint("merge"), "name").select("run_id", "name", "is_regression", "t.*")
    spans = found.select(F.col("run_id").alias("instance_id"), "path", "start_line", "end_line").distinct()
    seen = mark_already_seen(spans, views.withColumnRenamed("run_id", "instance_id")).withColumnRenamed("instance_id", "run_id")
    pick = lambda i: F.when(F.col("is_regression"), F.lit(REGRESSION[i])).otherwise(F.lit(TARGET_FIX[i]))
    return found.join(seen.hint("merge"), ["run_id", "path", "start_line", "end_line"]).select("run_id", "name", "path", "symbol", "start_line", "end_line", pick(0).alias("score"), pick(1).alias("relation"), "seen")


def covered_spans(spans: DataFrame, kept: DataFrame) -> DataFrame:
    """Adds in_file and covered to distinct spans (run_id, path, start_line, end_line): whether kept (the same columns) has the file, and all lines of the span; a kept file without lines (null) covers all of it."""
    file = ["run_id", "path"]
    order = Window.partitionBy(*file).orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, -1)
    marked = kept.where("start_line IS NOT NULL").distinct().withColumn("new", F.coalesce((F.col("start_line") > F.max("end_line").over(order) + 1).cast("int"), F.lit(1)))
    upto = Window.partitionBy(*file).orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, 0)
    merged = marked.withColumn("island", F.sum("new").over(upto)).groupBy(*file, "island").agg(F.min("start_line").alias("from"), F.max("end_line").alias("to"))
    whole = kept.groupBy(*file).agg(F.max(F.col("start_line").isNull()).alias("whole"))
    once = spans.select(*file, "start_line", "end_line").distinct()
    inside = once.join(merged.hint("merge"), file).where("start_line >= from AND end_line <= to").select(*once.columns).distinct().withColumn("inside", F.lit(True))
    full = once.join(whole.hint("merge"), file, "left").join(inside.hint("merge"), once.columns, "left")
    return full.select(*once.columns, F.col("whole").isNotNull().alias("in_file"), (F.coalesce("whole", F.lit(False)) & F.lit(True) | F.coalesce("inside", F.lit(False))).alias("covered"))


def rehydrate_spans(views: DataFrame, kept: DataFrame, lines: DataFrame, keywords: DataFrame, k: int = 4) -> DataFrame:
    """(run_id, rank, path, start_line, end_line, relation, score, matched): viewed spans that the final context doesn't cover and whose path or code holds keywords (run_id, word): those of files that it has in part come first, then by matches and score.

    A keyword counts by its last dotted part in small letters, if that has four letters or more.
    """
    span = ["run_id", "path", "start_line", "end_line"]
    left = covered_spans(views, kept).where("NOT covered")
    inside = left.select("path", "start_line", "end_line").distinct().alias("s").join(lines.alias("l").hint("merge"), F.col("s.path") == F.col("l.path")).where("ln BETWEEN start_line AND end_line")
    code = inside.groupBy("s.path", "start_line", "end_line").agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "text"))), lambda x: x["text"]), "\n")).alias("code"))
    words = keywords.where("word <> ''").select("run_id", "word", F.lower(F.element_at(F.split("word", r"\."), -1)).alias("last")).where(F.length("last") >= SHORTEST_KEYWORD)
    told = left.join(code.hint("merge"), ["path", "start_line", "end_line"], "left").join(words.hint("merge"), "run_id").where(F.contains(F.lower("path"), F.col("last")) | F.coalesce(F.contains("code", F.col("last")), F.lit(False)))
    counted = told.groupBy(*span, "in_file").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("word")).alias("matched"))
    score = F.when(F.col("in_file"), 85 + F.least(5 * F.col("n"), F.lit(10))).otherwise(65 + F.least(8 * F.col("n"), F.lit(20))) / 100
    ranked = counted.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("in_file"), F.desc("n"), F.desc("score"), "path", "start_line", "end_line")) - 1)
    return ranked.where(F.col("rank") < k).select("run_id", "rank", "path", "start_line", "end_line", F.when(F.col("in_file"), DROPPED).otherwise(UNCOVERED).alias("relation"), "score", "matched")


def scope_constraints(runs: DataFrame) -> DataFrame:
    """(run_id, pos, constraint, severity) of runs (run_id, edited_files, unsupported_files, submitted_without_tests, patterns)."""
    rules = [("cap_files", "high", "edited_files >= 5"), ("drop_unsupported", "high", "unsupported_files > 0"), ("run_tests", "high", "submitted_without_tests"), ("no_repeated_edits", "medium", "patterns > 0")]
    rows = F.array_compact(F.array(*(F.when(F.expr(c), F.struct(F.lit(n).alias("constraint"), F.lit(s).alias("severity"))) for n, s, c in rules)))
    return runs.select("run_id", F.posexplode(rows).alias("pos", "c")).select("run_id", "pos", "c.*")
