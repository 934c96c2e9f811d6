"""Source files (path, content) and searches over them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repairlens.functions import python_lines
from repairlens.functions.joins import join_contains, join_list
from repairlens.functions.text import lines_py

TEST_PATH = r"(^|/)tests/|(^|/)test_[^/]*\.py$|_test\.py$"


def code_lines(files: DataFrame) -> DataFrame:
    """(path, ln, text): lines from 1 on."""
    return files.select("path", F.posexplode(lines_py(F.col("content"))).alias("ln", "text")).withColumn("ln", F.col("ln") + 1)


def code_search(lines: DataFrame, queries: DataFrame, k: int = 5, window: int = 20) -> DataFrame:
    """(query, path, ln, start_line, end_line): the first k lines in (path, line) order that hold each query; test files are left out.

    queries (query) are search terms, found through an index of runs of three letters.
    """
    hits = join_contains(lines.where(~F.col("path").rlike(TEST_PATH)), F.col("text"), queries.where("length(query) > 1"), "query")
    ranked = hits.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("path", "ln"))).where(F.col("r") <= k)
    return ranked.select("query", "path", "ln", F.greatest(F.col("ln") - window, F.lit(1)).alias("start_line"), (F.col("ln") + window).alias("end_line"))


def find_definitions(lines: DataFrame, targets: DataFrame, budget: int = 5) -> DataFrame:
    """(target, path, ln): the first line of each file that defines a target as function or class, the first files in path order."""
    name = F.regexp_extract("text", r"^\s*(?:async\s+)?(?:def|class)\s+(\w+)", 1)
    defs = join_list(lines.withColumn("target", name).where("target <> ''"), targets, "target", "left_semi")
    first = defs.groupBy("target", "path").agg(F.min("ln").alias("ln"))
    return first.withColumn("r", F.row_number().over(Window.partitionBy("target").orderBy("path"))).where(F.col("r") <= budget).drop("r")


def enclosing_definition(symbols: DataFrame, sites: DataFrame, around: int = 5) -> DataFrame:
    """(site_id, path, name, start_line, end_line): the smallest symbol (path, name, start_line, end_line) around each site (site_id, path, ln), else some lines around."""
    inside = sites.join(symbols.hint("merge"), "path").where("ln BETWEEN start_line AND end_line")
    best = inside.groupBy("site_id").agg(F.min_by(F.struct("name", "start_line", "end_line"), F.struct(F.col("end_line") - F.col("start_line"), "start_line", "name")).alias("s"))
    start, end = F.coalesce("s.start_line", F.greatest(F.col("ln") - around, F.lit(1))), F.coalesce("s.end_line", F.col("ln") + around)
    return sites.join(best, "site_id", "left").select("site_id", "path", F.col("s.name").alias("name"), start.alias("start_line"), end.alias("end_line"))


def file_definition(files: DataFrame, targets: DataFrame, chars: int = 2000) -> DataFrame:
    """(path, head, chars) of named files."""
    return join_list(files, targets, "path", "left_semi").select("path", F.substring("content", 1, chars).alias("head"), F.length("content").alias("chars"))


def find_imports(lines: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, path, ln): import lines that name a module as a word."""
    named = lines.where(F.col("text").rlike(r"^\s*(import|from)\s")).withColumn("module", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)))))
    return join_list(named, modules, "module", "left_semi").select("module", "path", "ln")


# Scores of a line that registers, defines, calls or else names a symbol, and how short a symbol may be.
CALLER_SCORES = {"registers": 0.85, "defines": 0.75, "calls": 0.7, "names": 0.6}
SHORTEST_SYMBOL = 4


def find_callers(lines: DataFrame, symbols: DataFrame, k: int = 5) -> DataFrame:
    """(symbol, path, ln, score): one line a file that registers, defines, calls or names the last part of a dotted symbol; the best k files."""
    wanted = symbols.select("symbol", F.element_at(F.split("symbol", r"\."), -1).alias("word")).where(F.length("word") >= SHORTEST_SYMBOL).distinct()
    words = lines.select("path", "ln", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)))).alias("word"))
    hits = join_list(words, wanted, "word")
    score = F.when(F.col("text").rlike("@|register"), CALLER_SCORES["registers"]).when(F.col("text").rlike("(?:def|class) "), CALLER_SCORES["defines"]).when(F.expr("contains(text, concat(word, '('))"), CALLER_SCORES["calls"]).otherwise(CALLER_SCORES["names"])
    best = hits.withColumn("score", score).groupBy("symbol", "path").agg(F.min_by(F.struct("ln", "score"), F.struct(-F.col("score"), F.col("ln"))).alias("b")).select("symbol", "path", "b.*")
    return best.withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("score"), "path"))).where(F.col("r") <= k).drop("r")


#: Lines of a block of the interval join of mark_already_seen.
LINE_BLOCK = 256


def mark_already_seen(candidates: DataFrame, views: DataFrame, near: int = 5) -> DataFrame:
    """Adds seen: some view (instance_id, path, start_line, end_line) overlaps the candidate when both are widened by so many lines.

    One path may be the end of the other: roots differ; an empty one is no path. The shorter path is entered under its
    base name, or whole if it has no folder; the longer one under its base name and the endings
    of it. Spans meet within an instance under such a key and a block of lines.
    """
    span = ["instance_id", "path", "start_line", "end_line"]
    base = F.substring_index("path", "/", -1)
    brief = F.array(F.when(F.contains("path", F.lit("/")), F.concat(F.lit("/"), base)).otherwise(F.col("path")))
    names = F.when(F.length(base) > 0, F.transform(F.sequence(F.lit(1), F.length(base)), lambda n: F.right(base, n))).otherwise(F.array().cast("array<string>"))
    full = F.when(F.contains("path", F.lit("/")), F.concat(F.array(F.concat(F.lit("/"), base)), names)).otherwise(names)
    blocks = F.sequence(F.floor((F.col("start_line") - near) / LINE_BLOCK), F.floor((F.col("end_line") + near) / LINE_BLOCK))

    def entered(df: DataFrame, keys: Column, tag: str) -> DataFrame:
        valid = df.select(*span).distinct().where("path <> ''").where(F.col("start_line") <= F.col("end_line") + 2 * near)
        return valid.withColumn("key", F.explode(keys)).withColumn("block", F.explode(blocks)).select("instance_id", "key", "block", *(F.col(c).alias(f"{tag}_{c}") for c in span[1:]))

    close = (F.col("c_start_line") <= F.col("v_end_line") + 2 * near) & (F.col("v_start_line") <= F.col("c_end_line") + 2 * near)

    def met(own: Column, other: Column, ends: str) -> DataFrame:
        c, v = entered(candidates, own, "c"), entered(views, other, "v")
        return c.join(v.hint("merge"), ["instance_id", "key", "block"]).where(close & F.expr(ends)).select("instance_id", *(F.col(f"c_{x}").alias(x) for x in span[1:]))

    seen = met(full, brief, "endswith(c_path, v_path)").unionByName(met(brief, full, "endswith(v_path, c_path)")).distinct().withColumn("seen", F.lit(True))
    return candidates.join(seen.hint("merge"), span, "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


def edited_windows(edited: DataFrame, gap: int = 10, window: int = 20) -> DataFrame:
    """(instance_id, path, start_line, end_line): islands of edited lines no further than gap apart, with a window around."""
    w = Window.partitionBy("instance_id", "path").orderBy("line")
    breaks = edited.distinct().withColumn("new", F.coalesce((F.col("line") - F.lag("line").over(w) > gap).cast("int"), F.lit(1)))
    islands = breaks.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("instance_id", "path", "island").agg(F.greatest(F.min("line") - window, F.lit(1)).alias("start_line"), (F.max("line") + window).alias("end_line")).drop("island")


def widest_viewed(views: DataFrame, k: int = 3) -> DataFrame:
    """(instance_id, path, n_lines, start_line, end_line): the k files with the most viewed lines, and their widest span."""
    length = F.col("end_line") - F.col("start_line") + 1
    per = views.groupBy("instance_id", "path").agg(F.sum(length).alias("n_lines"), F.min_by(F.struct("start_line", "end_line"), F.struct(-length, F.col("start_line"))).alias("s"))
    ranked = per.withColumn("r", F.row_number().over(Window.partitionBy("instance_id").orderBy(F.desc("n_lines"), "path"))).where(F.col("r") <= k)
    return ranked.select("instance_id", "path", "n_lines", "s.start_line", "s.end_line")


def keyword_queries(issues: DataFrame, stop: list[str], n: int = 8) -> DataFrame:
    """(instance_id, rank, query): the first n distinct identifiers of four letters or more that aren't stop words."""
    words = F.array_except(F.regexp_extract_all(F.coalesce("issue", F.lit("")), F.lit(r"[A-Za-z_]\w{3,}"), F.lit(0)), F.array(*(F.lit(s) for s in stop)))
    return issues.select("instance_id", F.posexplode(F.slice(words, 1, n)).alias("rank", "query"))


def failure_queries(signals: DataFrame, n: int = 12) -> DataFrame:
    """(instance_id, rank, query) of (instance_id, error_tokens array, trace): the tokens of three letters or more as they come, then exception names and dotted check codes of the trace that aren't among them."""
    none = F.array().cast("array<string>")
    tokens = F.transform(F.filter(F.coalesce("error_tokens", none), lambda t: F.length(t) >= 3), lambda t: F.trim(t))
    trace = F.coalesce("trace", F.lit(""))
    found = F.concat(F.regexp_extract_all(trace, F.lit(r"\b([A-Z][a-zA-Z]+(?:Error|Exception|Warning))\b"), F.lit(1)), F.regexp_extract_all(trace, F.lit(r"\b([a-z_]+\.[A-Z][0-9]{3,})\b"), F.lit(1)))
    return signals.select("instance_id", F.posexplode(F.slice(F.concat(tokens, F.array_except(found, tokens)), 1, n)).alias("rank", "query"))


def test_name_queries(signals: DataFrame, n: int = 12) -> DataFrame:
    """(instance_id, rank, query) of (instance_id, test_failures array): the first distinct names of three letters or more."""
    names = F.array_distinct(F.filter(F.transform(F.coalesce("test_failures", F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: F.length(t) >= 3))
    return signals.select("instance_id", F.posexplode(F.slice(names, 1, n)).alias("rank", "query"))


def expand_context(sources: dict[str, DataFrame], order: list[str]) -> DataFrame:
    """(instance_id, source, priority, path, start_line, end_line): candidates of all sources, with the place of the source in the order."""
    out = None
    for i, name in enumerate(order):
        one = sources[name].select("instance_id", F.lit(name).alias("source"), F.lit(i).alias("priority"), "path", "start_line", "end_line")
        out = one if out is None else out.unionByName(one)
    return out


def enforce_budget(candidates: DataFrame, max_spans: int = 12, max_files: int = 8, max_lines: int = 400, per_span: int = 120) -> DataFrame:
    """The candidates that fit, taken by priority, path and line: an entry that overflows is skipped and the scan goes on.

    A file counts as taken once its first entry passed the limits on spans and files.
    """
    cut = candidates.withColumn("end_line", F.least("end_line", F.col("start_line") + per_span))
    entries = F.array_sort(F.collect_list(F.struct("priority", "path", "start_line", "end_line", "source")))
    kept = "array<struct<priority:int,path:string,start_line:bigint,end_line:bigint,source:string>>"
    state = F.struct(F.array().cast(kept).alias("kept"), F.array().cast("array<string>").alias("files"), F.lit(0).cast("bigint").alias("lines"))

    def step(acc, x):
        room = (F.size(acc["kept"]) < max_spans) & (F.array_contains(acc["files"], x["path"]) | (F.size(acc["files"]) < max_files))
        size = x["end_line"] - x["start_line"]
        take = room & (acc["lines"] + size <= max_lines)
        return F.struct(
            F.when(take, F.concat(acc["kept"], F.array(x).cast(kept))).otherwise(acc["kept"]).alias("kept"),
            F.when(room, F.array_union(acc["files"], F.array(x["path"]))).otherwise(acc["files"]).alias("files"),
            F.when(take, acc["lines"] + size).otherwise(acc["lines"]).cast("bigint").alias("lines"),
        )

    folded = cut.groupBy("instance_id").agg(entries.alias("e")).select("instance_id", F.aggregate("e", state, step, lambda acc: acc["kept"]).alias("kept"))
    return folded.select("instance_id", F.posexplode("kept").alias("rank", "x")).select("instance_id", "rank", "x.*")


def definitions(files: DataFrame) -> DataFrame:
    """(path, kind, name, parent, start_line, end_line) of every function and class of Python sources, with the lines that Python's own parser gives them.

    kind is def, async_def or class; parent is the class of whose body it is a statement. One
    linear scan of each file; text that is no Python gives what its indentation says, a null one
    nothing. Decorators aren't part of the lines.
    """

    def run(batches):
        for batch in batches:
            rows = [(path, *d) for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for d in python_lines.definitions(content or "")]
            path, kind, name, parent, start, end = (list(c) for c in zip(*rows)) if rows else ([], [], [], [], [], [])
            text = lambda c: pa.array(c, pa.string())
            yield pa.RecordBatch.from_arrays([text(path), text(kind), text(name), text(parent), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["path", "kind", "name", "parent", "start_line", "end_line"])

    return files.select("path", "content").mapInArrow(run, "path string, kind string, name string, parent string, start_line int, end_line int")


#: A line feed that Spark's regular expression \n$ finds in the last three characters of a text.
_FINAL = re.compile("\n(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\\Z)")
_DEFS = pa.list_(pa.struct([("start_line", pa.int32()), ("end_line", pa.int32()), ("name", pa.string())]))
_DEFS_DDL = "array<struct<start_line:int,end_line:int,name:string>>"


def _blocks(content: str, until: int) -> list[dict]:
    return [{"start_line": d[3], "end_line": d[4], "name": d[1]} for d in python_lines.definitions(content, until)]


def scanned(files: DataFrame, until: int) -> DataFrame:
    """files with (n_lines, n, defs) in place of content: the lines, those before final line feeds, and what definitions_by finds up to line ``until``.

    Texts are read where they lie, in whatever partition that is; none is shuffled.
    """
    kept = [c for c in files.columns if c != "content"]

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            lines = [t.count("\n") + 1 for t in texts]
            n = [k - len(_FINAL.findall(t[-3:])) for k, t in zip(lines, texts)]
            found = [_blocks(t, until) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lines, pa.int32()), pa.array(n, pa.int32()), pa.array(found, _DEFS)], [*kept, "n_lines", "n", "defs"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.select(*kept).schema)
    return files.select(*kept, "content").mapInArrow(run, f"{types}, n_lines int, n int, defs {_DEFS_DDL}")


def definitions_by(files: DataFrame) -> DataFrame:
    """(path, n, defs) of files (path, content, n, until): the functions and classes (start_line, end_line, name) that begin by line ``until``, found as definitions() does.

    The scan of a file ends with the last of their blocks; n is passed on.
    """

    def run(batches):
        for batch in batches:
            found = [_blocks(content or "", until) for content, until in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, _DEFS)], ["path", "n", "defs"])

    return files.select("path", "content", "n", "until").mapInArrow(run, f"path string, n int, defs {_DEFS_DDL}")


def symbol_index(files: DataFrame) -> DataFrame:
    """(path, name, kind, start_line, end_line): functions (def) and classes of Python sources; the longest of a name stays."""
    spans = definitions(files).withColumn("kind", F.replace("kind", F.lit("async_"), F.lit("")))
    return spans.groupBy("path", "name", "kind").agg(F.max_by(F.struct("start_line", "end_line"), F.struct(F.col("end_line") - F.col("start_line"), -F.col("start_line"))).alias("s")).select("path", "name", "kind", "s.*")


def class_index(files: DataFrame) -> DataFrame:
    """(path, kind, name, parent, start_line, end_line): classes, and as Class.method the functions and async_functions in their bodies; of rows that share path, name and first line the longest."""
    every = definitions(files).where("kind = 'class' OR parent IS NOT NULL")
    named = every.select("path", F.expr("CASE kind WHEN 'class' THEN 'class' WHEN 'def' THEN 'function' ELSE 'async_function' END").alias("kind"), F.expr("CASE WHEN kind = 'class' THEN name ELSE concat(parent, '.', name) END").alias("name"), F.expr("CASE WHEN kind <> 'class' THEN parent END").alias("parent"), "start_line", "end_line")
    return named.groupBy("path", "name", "start_line").agg(F.max_by(F.struct("kind", "parent", "end_line"), F.struct("end_line", "kind")).alias("s")).select("path", "s.kind", "name", "s.parent", "start_line", "s.end_line")


def find_symbols(symbols: DataFrame, hints: DataFrame) -> DataFrame:
    """(hint, path, name, score): symbols of that very name (0.92), else such as hold it (0.78), else the first class named before the dot of a dotted hint (0.70).

    hints (hint) is a short list. The last tier needs a column kind.
    """
    exact = join_list(symbols, hints, F.col("name") == F.col("hint")).select("hint", "path", "name", F.lit(0.92).alias("score"))
    left = hints.join(exact.select("hint").distinct(), "hint", "left_anti")
    part = join_contains(symbols, F.col("name"), left, "hint").select("hint", "path", "name", F.lit(0.78).alias("score"))
    found = exact.unionByName(part)
    if "kind" not in symbols.columns:
        return found
    dotted = left.where("contains(hint, '.')").join(part.select("hint").distinct(), "hint", "left_anti").select("hint", F.split_part("hint", F.lit("."), F.lit(1)).alias("name")).distinct()
    first = symbols.where("kind = 'class'").groupBy("name").agg(F.min("path").alias("path"))
    return found.unionByName(join_list(first, dotted, "name").select("hint", "path", "name", F.lit(0.70).alias("score")))


def sibling_methods(symbols: DataFrame, hints: DataFrame, budget: int = 3) -> DataFrame:
    """(hint, name, path, score, rank): other symbols (path, name, parent) whose last part is that of a dotted hint, those of its class first, then in path order.

    A method that very many classes have is cut to the few rows that any hint can take before it is joined.
    """
    last = lambda c: F.element_at(F.split(c, r"\."), -1)

    def first(df: DataFrame, most: int, *by: str) -> DataFrame:
        return df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("path", "name"))).where(F.col("r") <= most).drop("r")

    every = first(symbols.select("path", "name", "parent", last("name").alias("method")).distinct(), budget, "method", "name")
    own = first(every, 2 * budget, "method", "parent")
    dealt = first(every.withColumn("deal", F.pmod(F.xxhash64("path"), F.lit(64))), 3 * budget, "method", "deal").drop("deal")
    few = first(dealt, 3 * budget, "method").unionByName(own).distinct()
    wanted = hints.select("hint", last("hint").alias("method"), F.split_part("hint", F.lit("."), F.lit(1)).alias("class")).distinct()
    same = F.col("parent") == F.col("class")
    found = wanted.join(few.hint("merge"), "method").where((F.col("name") != F.col("hint")) & (same | F.col("parent").isNotNull()))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("hint").orderBy(F.when(same, 0).otherwise(1), "path", "name")))
    return ranked.where(F.col("rank") <= budget).select("hint", "name", "path", F.when(same, 0.70).otherwise(0.85).alias("score"), "rank")
