"""Anchors of a failed run: files, symbols, tests and modules with where they come from, and full paths of short names.

Short names are resolved through an index of path endings: each path is entered under its last
part, its last two parts and so on. The index has one row for each ending, so a name that a
third of all paths end in meets one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Places in error texts of other languages, what each is called, in order.
LOCATIONS = [
    (r"panicked at\s+'([^']+)':(\d+)", "rust_panic"),
    (r"panicked at\s+([^,\s]+):(\d+)", "rust_panic"),
    (r"at\s+([^\s]+?)\.(?:js|ts|jsx|tsx):(\d+)", "js_location"),
    (r"at\s+([^\s]+?)\.(?:rs|go|rb|php):(\d+)", "source_location"),
    (r"([^\s]+?)\.go:(\d+)", "go_location"),
    (r"([^\s]+?)\.(?:rs|rb|php):(\d+)", "generic_location"),
]
# Words that are no symbols.
NOISE = [
    "True", "False", "None", "Error", "Warning",
    "AttributeError", "TypeError", "ValueError", "KeyError",
    "ImportError", "ModuleNotFoundError", "RuntimeError",
    "NameError", "AssertionError", "SyntaxError",
    "IndexError", "StopIteration", "OSError",
    "DeprecationWarning", "PytestConfigWarning",
    "Collecting", "Downloading", "Installing", "Successfully",
    "WARNING", "Running", "FAILED", "ERROR", "Traceback",
    "Skipping", "System", "Docs", "Found", "Total",
    "Short", "Ran", "Unknown", "Config",
]
# Errors at import time; the first group is the attribute, the second, if there is one, the module.
IMPORTS = [
    (r"cannot import name\s+'(\w+)'\s+from\s+'([\w.]+)'", 2),
    (r"cannot import name\s+(\w+)\s+from\s+([\w.]+)", 2),
    (r"module\s+'([\w.]+)'\s+has no attribute\s+'(\w+)'", 2),
    (r"'([\w.]+)'\s+has no attribute\s+'(\w+)'", 2),
    (r"undefined\s+(?:symbol|name)\s+'?(\w+)'?", 1),
    (r"cannot find\s+(?:module|class)\s+'?([\w.]+)'?", 1),
]
LAST_RESORT = r"([^\s]+?)\.\w+:(\d+)"
_FILE = "run_id long, step int, o1 long, o2 string, path string, line int, func string, source string"


def _is_test(path: Column) -> Column:
    return F.contains(F.lower(path), F.lit("test"))


def _located(text: Column) -> Column:
    """(path, line, source) of the first place that each pattern finds in a text."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.struct(F.trim(F.regexp_extract(text, p, 1)).alias("path"), F.expr("0").alias("line"), F.lit(name).alias("source")).withField("line", F.regexp_extract(text, p, 2).cast("int"))) for p, name in LOCATIONS)))


def _pick(df: DataFrame, step: int, o1: Column, o2: Column, path: str, line: Column, func: Column, source: Column) -> DataFrame:
    return df.select("run_id", F.lit(step).alias("step"), o1.cast("long").alias("o1"), o2.alias("o2"), F.col(path).alias("path"), line.cast("int").alias("line"), func.alias("func"), source.alias("source")).where("path <> ''")


def file_anchors(runs: DataFrame, frames: DataFrame, views: DataFrame, edits: DataFrame) -> DataFrame:
    """(run_id, pos, path, line, func, source, is_test): files of stack frames, else of places told in other languages, then viewed and edited ones, each path once.

    runs (run_id, has_failure, message, trace), frames (run_id, pos, file, line, function), views
    (run_id, path), edits (run_id, pos, path). Frames count once for each base name, those of no
    test first, then by line; viewed files by depth and name; edited ones in order.
    """
    failed = runs.where("has_failure").select("run_id")
    base = F.substring_index("file", "/", -1)
    first = frames.join(failed.hint("merge"), "run_id", "left_semi").withColumn("base", base).groupBy("run_id", "base").agg(F.min_by(F.struct("file", "line", "function"), "pos").alias("f"), F.min("pos").alias("pos"))
    by_line = Window.partitionBy("run_id").orderBy(_is_test(F.col("base")), "f.line", "pos")
    stack = _pick(first.withColumn("o", F.row_number().over(by_line)).select("run_id", "o", "f.*"), 0, F.col("o"), F.lit(""), "file", F.col("line"), F.coalesce("function", F.lit("")), F.lit("stack_frame"))
    framed = stack.select("run_id").distinct()
    texts = F.concat(F.coalesce("trace", F.array().cast("array<string>")), F.array(F.coalesce("message", F.lit(""))))
    told = runs.where("has_failure").join(framed.hint("merge"), "run_id", "left_anti").select("run_id", F.posexplode(F.flatten(F.transform(texts, _located))).alias("o", "p")).select("run_id", "o", "p.*")
    placed = _pick(told, 1, F.col("o"), F.lit(""), "path", F.col("line"), F.lit(""), F.col("source"))
    depth = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    seen = _pick(views.select("run_id", "path").distinct(), 2, depth, F.col("path"), "path", F.lit(0), F.lit(""), F.lit("visited"))
    edited = _pick(edits, 3, F.col("pos"), F.lit(""), "path", F.lit(0), F.lit(""), F.lit("edited"))
    every = stack.unionByName(placed).unionByName(seen).unionByName(edited)
    once = every.groupBy("run_id", "path").agg(F.min(F.struct("step", "o1", "o2", "line", "func", "source")).alias("a")).select("run_id", "path", "a.*")
    order = Window.partitionBy("run_id").orderBy("step", "o1", "o2", "path")
    return once.select("run_id", (F.row_number().over(order) - 1).alias("pos"), "path", "line", "func", "source", _is_test(F.col("path")).alias("is_test"))


def symbol_anchors(runs: DataFrame) -> DataFrame:
    """(run_id, pos, symbol, source) of runs (run_id, has_failure, message, issue, symbols): error symbols, terms of the issue longer than four letters, capitalised terms of the message; each once, without noise."""
    tagged = lambda words, source: F.transform(words, lambda w: F.struct(F.trim(w).alias("symbol"), F.lit(source).alias("source")))
    none = F.array().cast("array<string>")
    failed = lambda words: F.when(F.col("has_failure"), words).otherwise(none)
    grab = lambda text, p: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0))
    terms = F.filter(grab("issue", r"\b[A-Z][a-zA-Z0-9_]+\b"), lambda w: F.length(w) > 4)
    every = F.concat(tagged(failed(F.coalesce("symbols", none)), "error_symbol"), tagged(terms, "issue_term"), tagged(failed(grab("message", r"\b[A-Z][a-zA-Z0-9_]{2,}\b")), "error_term"))
    kept = F.filter(every, lambda x: (x["symbol"] != "") & ~x["symbol"].isin(NOISE))
    rows = runs.select("run_id", F.posexplode(kept).alias("at", "s")).groupBy("run_id", "s.symbol").agg(F.min(F.struct("at", "s.source")).alias("f"))
    return rows.select("run_id", (F.row_number().over(Window.partitionBy("run_id").orderBy("f.at")) - 1).alias("pos"), "symbol", "f.source")


def module_anchors(runs: DataFrame) -> DataFrame:
    """(run_id, module, attribute): the first error at import time that the message of a failed run tells. The attribute is what stands first in it."""
    said = F.coalesce("message", F.lit(""))
    found = F.coalesce(*(F.when(said.rlike(p), F.struct((F.regexp_extract(said, p, 2) if n == 2 else F.lit("")).alias("module"), F.regexp_extract(said, p, 1).alias("attribute"))) for p, n in IMPORTS))
    return runs.where("has_failure").select("run_id", found.alias("m")).where("m IS NOT NULL").select("run_id", "m.module", "m.attribute")


def test_anchors(runs: DataFrame, files: DataFrame) -> DataFrame:
    """(run_id, pos, test_id, source): failed tests, FAILED lines of the message, then test files among the anchors, each once; runs without a witness (has_failure null) have none."""
    tagged = lambda words, source: F.transform(words, lambda w: F.struct(w.alias("test_id"), F.lit(source).alias("source")))
    told = F.concat(tagged(F.coalesce("failed_tests", F.array().cast("array<string>")), "failed_tests"), tagged(F.regexp_extract_all(F.coalesce("message", F.lit("")), F.lit(r"FAILED\s+(\S+)"), F.lit(1)), "error_message"))
    told = runs.where("has_failure").select("run_id", F.posexplode(told).alias("o", "t")).select("run_id", F.lit(0).alias("step"), F.col("o").cast("int").alias("o"), "t.*")
    known = files.where("is_test").join(runs.where("has_failure IS NOT NULL").select("run_id").hint("merge"), "run_id", "left_semi").select("run_id", F.lit(1).alias("step"), F.col("pos").cast("int").alias("o"), F.col("path").alias("test_id"), "source")
    once = told.unionByName(known).where("test_id <> ''").groupBy("run_id", "test_id").agg(F.min(F.struct("step", "o", "source")).alias("f"))
    return once.select("run_id", (F.row_number().over(Window.partitionBy("run_id").orderBy("f.step", "f.o")) - 1).alias("pos"), "test_id", "f.source")


def resolve_anchors(runs: DataFrame, frames: DataFrame, views: DataFrame, edits: DataFrame) -> DataFrame:
    """(run_id, kind, pos, value, line, detail, source): all anchors of each run; detail is the function of a file and the attribute of a module."""
    files = file_anchors(runs, frames, views, edits)
    none = F.lit(None).cast("string")
    return (
        files.select("run_id", F.lit("file").alias("kind"), "pos", F.col("path").alias("value"), "line", F.col("func").alias("detail"), "source")
        .unionByName(symbol_anchors(runs).select("run_id", F.lit("symbol").alias("kind"), "pos", F.col("symbol").alias("value"), F.lit(None).cast("int").alias("line"), none.alias("detail"), "source"))
        .unionByName(test_anchors(runs, files).select("run_id", F.lit("test").alias("kind"), "pos", F.col("test_id").alias("value"), F.lit(None).cast("int").alias("line"), none.alias("detail"), "source"))
        .unionByName(module_anchors(runs).select("run_id", F.lit("module").alias("kind"), F.lit(0).alias("pos"), F.col("module").alias("value"), F.lit(None).cast("int").alias("line"), F.col("attribute").alias("detail"), F.lit("import_error").alias("source")))
    )


def anchor_summary(runs: DataFrame, anchors: DataFrame) -> DataFrame:
    """(run_id, top_file, provenance, test_file, test_method): the error file by priority (stack frame, place in another language, place in the message), and file and method of the best test."""
    said = F.when(F.col("has_failure"), F.regexp_extract(F.coalesce("message", F.lit("")), LAST_RESORT, 1)).otherwise("")
    value, test = F.col("value"), F.col("kind") == "test"
    lead = F.when(F.col("source") == "stack_frame", 0).when(~F.col("source").isin("visited", "edited"), 1)
    file = F.when(F.col("kind") == "file", F.struct(lead.alias("lead"), "pos"))
    method = F.when(F.contains(value, F.lit("::")), F.element_at(F.split(value, "::"), -1)).when(F.contains(value, F.lit(":")) & ~value.startswith("/"), F.trim(F.element_at(F.split(value, ":"), -1)))
    best = anchors.groupBy("run_id").agg(
        F.min_by(F.struct("value", "source"), F.when(file["lead"].isNotNull(), file)).alias("top"),
        F.min_by(F.split(value, ":")[0], F.when(test, F.col("pos"))).alias("test_file"),
        F.min_by(method, F.when(test & method.isNotNull(), F.col("pos"))).alias("test_method"),
    )
    both = runs.join(best.hint("merge"), "run_id", "left")
    provenance = F.coalesce("top.source", F.when(said != "", "error_message").otherwise("unknown"))
    return both.select("run_id", F.coalesce("top.value", said).alias("top_file"), provenance.alias("provenance"), F.coalesce("test_file", F.lit("")).alias("test_file"), F.coalesce("test_method", F.lit("")).alias("test_method"))


def _endings(path: Column, whole: bool) -> Column:
    """(ending, parts) of a path from its last part on; the whole path too if asked for. Empty parts, as before a first slash, don't count."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    most = F.size(parts) - (0 if whole else 1)
    some = F.transform(F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>")), lambda n: F.struct(F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/").alias("ending"), n.alias("parts")))
    return some


def short_to_full(names: DataFrame, files: DataFrame) -> DataFrame:
    """(run_id, name, path): for each name (run_id, name) the first file anchor (run_id, pos, path) of its run that ends in a slash and the name, else the name itself."""
    lead = F.when(F.col("path").startswith("/"), True).otherwise(False)
    index = files.select("run_id", "pos", "path", F.explode(F.when(lead, _endings(F.col("path"), True)).otherwise(_endings(F.col("path"), False))).alias("e")).groupBy("run_id", F.col("e.ending").alias("name")).agg(F.min_by("path", "pos").alias("full"))
    return names.join(index.hint("merge"), ["run_id", "name"], "left").select("run_id", "name", F.coalesce("full", "name").alias("path"))


def resolve_paths(names: DataFrame, paths: DataFrame) -> DataFrame:
    """(repo, name, path, parts, candidates) of names (repo, name) among paths (repo, path): the path that shares the longest ending with the name; null with the number of candidates where several do."""
    index = paths.distinct().select("repo", "path", F.explode(_endings(F.col("path"), True)).alias("e")).groupBy("repo", "e.ending").agg(F.count("*").alias("n"), F.min("path").alias("full"))
    asked = names.distinct().select("repo", "name", F.explode(_endings(F.col("name"), True)).alias("e")).select("repo", "name", "e.*")
    best = asked.join(index.hint("merge"), ["repo", "ending"]).groupBy("repo", "name").agg(F.max_by(F.struct("full", "n", "parts"), "parts").alias("b"))
    return names.join(best.hint("merge"), ["repo", "name"], "left").select("repo", "name", F.when(F.col("b.n") == 1, F.col("b.full")).alias("path"), F.coalesce("b.parts", F.lit(0)).alias("parts"), F.coalesce("b.n", F.lit(0).cast("long")).alias("candidates"))
