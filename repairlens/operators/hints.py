"""Navigation hints of failed runs: five sources of different shape, the first that has anything, in order of strength.

Each source makes a table of its own; a run takes the one of the least priority. A source that
may not be read at run time is refused before it is weighed, so it never hides a lower one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sources in order of priority, the allowed ones, confidences, and words of known messages.
PRIORITY = ["repo_source_signature", "runtime_introspection", "test_class_to_impl", "issue_keyword_api_match", "public_api_signature"]
ALLOWED = ["public_api_signature", "repo_source_signature", "issue_keyword_api_match", "runtime_introspection"]
CONFIDENCE = {"repo_source_signature": 0.65, "runtime_introspection": 0.85, "test_class_to_impl": 0.65, "issue_keyword_api_match": 0.45, "public_api_signature": 0.45}
TEST_CLASS = r"\b([A-Z]\w*?)Tests\.([a-z]\w*)"
METHOD_WORDS = ["frame", "traceback", "html", "text"]
SIGNATURE = r"^(class|def)\s+(\w+)"
#: Lines above a frame, and below a class, that are looked through.
REACH = 200
_HINT = ["run_id", "source", "artifact", "target", "method"]


def is_test_file(path: Column) -> Column:
    """Whether the path lies in a folder named tests."""
    return F.contains(path, F.lit("/tests/")) | path.startswith("tests/")


def _relative(path: Column) -> Column:
    """Within the repository: without the container's root, else without slashes in front."""
    return F.regexp_replace(path, "^/testbed/|^/+", "")


def _own_frames(frames: DataFrame) -> DataFrame:
    """Frames of no test, with path (within the repository) and depth (0: the deepest)."""
    own = frames.withColumn("file", F.trim("file")).where("file <> ''").where(~is_test_file(F.col("file"))).withColumn("path", _relative(F.col("file")))
    return own.withColumn("depth", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("pos"))) - 1)


def _marks(lines: DataFrame) -> DataFrame:
    """(repo, path, at, sig, cls, m, last) of lines (repo, path, ln, text): a row for each line that begins a class or function, and one with no ``at`` for the others of a file; last is the last line of them.

    sig: the name that begins in column 0; cls: a class that a test class may be named after; m: the name of an indented function, '' at a class, null where neither begins.
    """
    text = F.col("text")
    class_, def_ = F.startswith(text, F.lit("class")), F.contains(text, F.lit("def"))  # these cost less than a pattern
    sig = F.when((class_ | F.startswith(text, F.lit("def"))) & text.rlike(SIGNATURE), F.regexp_extract(text, SIGNATURE, 2))
    cls = F.when(class_ & F.col("path").endswith(".py") & text.rlike(r"^class \w"), F.regexp_extract(text, r"^class (\w+)", 1))
    m = F.when(class_ & text.rlike(r"^class\s+\w"), "").when(def_ & text.rlike(r"^\s+def\s+\w"), F.regexp_extract(text, r"^\s+def\s+(\w+)", 1))
    told = lines.select("repo", "path", "ln", sig.alias("sig"), cls.alias("cls"), m.alias("m"))
    at = F.when(F.coalesce("sig", "m").isNotNull(), F.col("ln"))
    return told.groupBy("repo", "path", at.alias("at"), "sig", "cls", "m").agg(F.max("ln").alias("last"))


def from_lines(lines: DataFrame, frames: DataFrame | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Hints of from_signatures (of frames) and from_test_classes (of wanted: run_id, repo, name), both from one pass over the lines."""
    asked = []
    if frames is not None:
        asked.append(_own_frames(frames.where("line IS NOT NULL")).select(F.lit("sig").alias("kind"), "repo", F.col("path").alias("key"), "line", "run_id", "depth"))
    if wanted is not None:
        asked.append(wanted.select(F.lit("cls").alias("kind"), "repo", F.col("name").alias("key"), F.lit(0).alias("line"), "run_id", F.lit(0).alias("depth")))
    asks = reduce(DataFrame.unionByName, asked)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("at", "int"), ("sig", "string"), ("cls", "string"), ("m", "string"), ("last", "int"))]
    spots = asks.where("kind = 'sig'").select("repo", F.col("key").alias("path"), "line").distinct().select("repo", "path", *none, "line")
    marked = _marks(lines).select("*", F.lit(None).cast("int").alias("line")).unionByName(spots)
    file = Window.partitionBy("repo", "path")
    end = F.max("last").over(file)
    placed = marked.withColumn("end", end).where("end IS NOT NULL").withColumn("at", F.when(F.col("line").isNotNull(), F.greatest(F.lit(1), F.least("line", "end"))).otherwise(F.col("at"))).where("at IS NOT NULL")
    near = file.orderBy("at")  # one pass over the heads and sites of a file
    telling = F.exists(F.array(*(F.lit(w) for w in METHOD_WORDS)), lambda w: F.contains(F.lower("m"), w))
    head = F.max_by("sig", F.when(F.col("sig").isNotNull(), F.col("at"))).over(near.rangeBetween(-REACH + 1, 0))
    stop = F.min(F.when(F.col("m") == "", F.col("at"))).over(near.rangeBetween(2, REACH))
    first = F.min(F.when((F.col("m") != "") & telling, F.struct("at", "m"))).over(near.rangeBetween(1, REACH))
    seen = placed.withColumn("head", head).withColumn("stop", stop).withColumn("first", first).where("line IS NOT NULL AND head IS NOT NULL OR cls IS NOT NULL")
    hit = F.when(F.col("stop").isNull() | (F.col("first.at") < F.col("stop")), F.col("first.m"))
    test = F.concat(F.lit("/"), "path").rlike("/tests/|/test_")
    sig = F.col("line").isNotNull()
    found = seen.select(F.when(sig, "sig").otherwise("cls").alias("kind"), "repo", F.when(sig, F.col("path")).otherwise(F.col("cls")).alias("key"), F.coalesce("line", F.lit(0)).alias("line"), F.struct(test.alias("test"), "path", "at", F.when(sig, F.col("head")).otherwise(hit).alias("name")).alias("c"))
    best = found.groupBy("kind", "repo", "key", "line").agg(F.min("c").alias("c"))
    known = asks.join(best.hint("merge"), ["kind", "repo", "key", "line"]).groupBy("run_id", "kind").agg(F.min_by(F.struct("key", "line", "c"), F.struct("depth", "c")).alias("b")).select("run_id", "kind", "b.key", "b.line", "b.c.*")
    sig = F.col("kind") == "sig"
    target = F.when(sig, F.concat("path", F.lit("::"), "name")).otherwise(F.concat("path", F.lit("::"), "key", F.coalesce(F.concat(F.lit("."), "name"), F.lit(""))))
    return known.select("run_id", F.when(sig, "repo_source_signature").otherwise("test_class_to_impl").alias("source"), F.concat("path", F.lit(":"), F.when(sig, F.col("line")).otherwise(F.col("at"))).alias("artifact"), target.alias("target"), F.when(sig, "repo_file_signature_extraction").otherwise("test_class_to_impl_class_resolution").alias("method"))


def from_signatures(frames: DataFrame, lines: DataFrame) -> DataFrame:
    """The class or function that begins in column 0 above the deepest frame (run_id, repo, pos, file, line, function) whose file (repo, path, ln, text) has one no further than REACH lines up. A line beyond the end counts as the last."""
    return from_lines(lines, frames=frames)


def from_frames(frames: DataFrame) -> DataFrame:
    """The deepest frame of no test; nothing if it has no function."""
    best = _own_frames(frames).where("depth = 0").where("trim(coalesce(function, '')) <> ''")
    bare = F.regexp_replace("path", r"\.py$", "")
    func = F.trim("function")
    return best.select("run_id", F.lit("runtime_introspection").alias("source"), F.concat("file", F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit(""))).alias("artifact"), F.when(bare != "", F.concat(bare, F.lit("::"), func)).otherwise(func).alias("target"), F.lit("top_repo_frame_extraction").alias("method"))


def _test_classes(witnesses: DataFrame, frames: DataFrame) -> DataFrame:
    """(run_id, repo, name): the class that a test class in a message, or else in a frame, is named after."""
    said = frames.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("function", F.lit("")).alias("f")))), lambda x: x["f"]), "\n").alias("functions"))
    text = F.concat(F.coalesce("message", F.lit("")), F.lit("\n"), F.coalesce("functions", F.lit("")))
    return witnesses.join(said.hint("merge"), "run_id", "left").select("run_id", "repo", F.regexp_extract(text, TEST_CLASS, 1).alias("name")).where("name <> ''")


def from_test_classes(witnesses: DataFrame, frames: DataFrame, lines: DataFrame) -> DataFrame:
    """The class that a test class is named after, in the first file that defines it, one of no test before others, with its first method of a telling name."""
    return from_lines(lines, wanted=_test_classes(witnesses, frames))


def _known_message(witnesses: DataFrame, when: Column, source: str, artifact: str, target: str, method: str) -> DataFrame:
    return witnesses.where(when).select("run_id", *(F.lit(x).alias(n) for n, x in zip(_HINT[1:], (source, artifact, target, method))))


def from_messages(witnesses: DataFrame) -> DataFrame:
    low, said = F.lower(F.coalesce("message", F.lit(""))), F.coalesce("message", F.lit(""))
    keyword = _known_message(witnesses, F.contains(low, F.lit("app_label")) & F.contains(low, F.lit("installed_apps")), "issue_keyword_api_match", "error_message_keyword_match:app_label,INSTALLED_APPS", "django.db.models.base.ModelBase.__new__", "error_message_keyword_match")
    public = _known_message(witnesses, F.contains(said, F.lit("Model class")) & F.contains(said, F.lit("app_label")), "public_api_signature", "public_api:django.db.models.base.ModelBase", "django.db.models.base.ModelBase", "public_api_name_match")
    return keyword.unionByName(public)


def api_hints(witnesses: DataFrame, frames: DataFrame, lines: DataFrame, more: DataFrame | None = None, skipped: list[str] = ()) -> DataFrame:
    """(run_id, mode, source, artifact, target, confidence, method, missing): one row for each of witnesses (run_id, repo, instance, has_failure, message).

    ``more`` may hold hints of other sources (run_id, source, artifact, target, method); what is
    not allowed at run time is dropped. ``skipped`` are instances that wait for another witness.
    """
    failed = witnesses.where("has_failure")
    own = frames.join(failed.select("run_id", "repo").hint("merge"), "run_id")
    every = from_lines(lines, own, _test_classes(failed, own)).unionByName(from_frames(own)).unionByName(from_messages(failed))
    if more is not None:
        every = every.unionByName(more.select(*_HINT))
    shown = F.when(F.col("source") == "test_class_to_impl", "issue_keyword_api_match").otherwise(F.col("source"))
    place = F.array_position(F.array(*(F.lit(p) for p in PRIORITY)), F.col("source"))
    table = F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv))
    legal = every.where(shown.isin(ALLOWED)).select("run_id", F.struct(place.alias("place"), shown.alias("source"), "artifact", "target", F.try_element_at(table, "source").alias("confidence"), "method").alias("h"))
    best = legal.groupBy("run_id").agg(F.min("h").alias("h"))
    mode = F.when(F.col("instance").isin(list(skipped)), "needs_regression_witness").when(~F.coalesce("has_failure", F.lit(False)), "no_legal_api_hint").when(F.col("h").isNotNull(), "hint_generated").otherwise("no_legal_api_hint")
    why = F.when(F.col("mode") == "needs_regression_witness", "f2p_passed_no_p2p_raw_output").when(F.col("mode") == "hint_generated", "").when(~F.coalesce("has_failure", F.lit(False)), "no_failure_witness").otherwise("no_legal_hint_source_matched")
    full = witnesses.join(best.hint("merge"), "run_id", "left").withColumn("mode", mode).withColumn("missing", why).withColumn("h", F.when(F.col("mode") == "hint_generated", F.col("h")))
    text = lambda c: F.coalesce(F.col(f"h.{c}"), F.lit("")).alias(c)
    return full.select("run_id", "mode", text("source"), text("artifact"), text("target"), F.coalesce("h.confidence", F.lit(0.0)).alias("confidence"), text("method"), "missing")
