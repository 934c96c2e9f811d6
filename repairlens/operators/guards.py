"""Leak guards, artefact checks and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repairlens.functions.stored import checkpointed


def keyword_leaks(texts: DataFrame, keywords: list[str]) -> DataFrame:
    """(id, keyword): forbidden words found as whole tokens (no letter or underscore beside them) in texts (id, text)."""
    tokens = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z_])(" + "|".join(sorted(keywords, key=len, reverse=True)) + r")(?![A-Za-z_])"), F.lit(1)))
    return texts.select("id", F.explode(tokens).alias("keyword"))


def nested_key_leaks(documents: DataFrame, forbidden: list[str], allowed: list[str], levels: int = 64) -> DataFrame:
    """(id, path, key, problem): forbidden keys at any depth of JSON documents (id, body), except below the allowed top-level keys.

    One level is taken apart after another. What can't be read never passes in silence: a body
    that is no JSON, repeats a key of one object, or is nested deeper than Spark parses, and one
    with containers below so many levels, have a row with the problem (no_json, too_deep) and no
    key. Null and empty bodies hold nothing.
    """
    parsed = documents.where("body <> ''").select("id", F.try_parse_json("body").alias("v"))
    problem = lambda df, path, name: df.select("id", path.alias("path"), F.lit(None).cast("string").alias("key"), F.lit(name).alias("problem"))
    out = problem(parsed.where("v IS NULL"), F.lit(""), "no_json")
    level = parsed.where("v IS NOT NULL").withColumn("at", F.lit(""))
    spark = documents.sparkSession
    for depth in range(levels + 1):
        inner = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        here = F.when(F.col("key").isNull(), F.concat("at", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("at") == "", F.col("key")).otherwise(F.concat("at", F.lit("."), "key"))
        level = checkpointed(inner.select("id", "key", here.alias("at"), F.col("value").alias("v"), F.lit(depth == 0).alias("top")))
        if level.isEmpty():
            return out
        if depth == levels:
            return out.unionByName(problem(level, F.col("at"), "too_deep"))
        out = out.unionByName(level.where(F.col("key").isin(list(forbidden))).select("id", F.col("at").alias("path"), "key", F.lit(None).cast("string").alias("problem")))
        level = level.where(~(F.col("top") & F.coalesce(F.col("key").isin(list(allowed)), F.lit(False)))).select("id", "v", "at")
    return out


def required_artifacts(runs: DataFrame, files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(run_id, n_required, missing, status): artefacts that each run must have by (name, condition over runs), against files (run_id, name)."""
    need = F.array_compact(F.array(*(F.when(F.expr(cond), F.lit(name)) for name, cond in rules)))
    have = files.groupBy("run_id").agg(F.collect_set("name").alias("have"))
    missing = F.array_sort(F.array_except(need, F.coalesce("have", F.array().cast("array<string>"))))
    return runs.join(have.hint("merge"), "run_id", "left").select("run_id", F.size(need).alias("n_required"), F.array_join(missing, ",").alias("missing"), F.when(F.size(missing) > 0, "missing_artifacts").otherwise("ok").alias("status"))


def name_audit(files: DataFrame) -> DataFrame:
    """(canonical, n_files, renames, unique): files (canonical, name) by instance; how many bear another name than the safe form of the id."""
    expected = F.concat(F.replace("canonical", F.lit("/"), F.lit("__")), F.lit(".json"))
    return files.groupBy("canonical").agg(F.count("*").alias("n_files"), F.count_if(F.col("name") != expected).alias("renames"), (F.count_distinct("name") == F.count("*")).alias("unique"))


def name_gates(files: DataFrame, pool: DataFrame) -> DataFrame:
    """(gate, description, ok): unique canonical ids of the pool (canonical_id; empty or null can't be resolved), files (canonical, name) under their expected names, files without errors (a canonical id is known), and no expected name twice."""
    resolved = pool.agg((F.count(F.nullif("canonical_id", F.lit(""))) == F.count("*")).alias("all"), (F.count_distinct(F.nullif("canonical_id", F.lit(""))) == F.count(F.nullif("canonical_id", F.lit("")))).alias("once"))
    expected = F.concat(F.replace("canonical", F.lit("/"), F.lit("__")), F.lit(".json"))
    known = files.withColumn("canonical", F.nullif("canonical", F.lit(""))).withColumn("expected", expected)
    told = known.agg((F.count_if(F.col("canonical").isNotNull() & F.coalesce(F.col("name") != F.col("expected"), F.lit(True))) == 0).alias("named"), (F.count_if(F.col("canonical").isNull()) == 0).alias("whole"), (F.count_distinct("expected") == F.count("expected")).alias("single"))
    gates = lambda df, rows: df.select(F.explode(F.array(*(F.struct(F.lit(g).alias("gate"), F.lit(d).alias("description"), ok.alias("ok")) for g, d, ok in rows))).alias("g")).select("g.*")
    return gates(resolved, [("G1", "unique canonical ids", F.col("all") & F.col("once"))]).unionByName(gates(told, [("G2", "expected names", F.col("named")), ("G3", "no errors", F.col("whole")), ("G4", "no name twice", F.col("single"))]))


def runtime_view(df: DataFrame, oracle_columns: list[str]) -> DataFrame:
    """Without the columns that only evaluation may read."""
    return df.drop(*oracle_columns)


def oracle_view(df: DataFrame, keys: list[str], oracle_columns: list[str]) -> DataFrame:
    """The keys and the columns that only evaluation may read."""
    return df.select(*keys, *(c for c in oracle_columns if c in df.columns))


def hidden_source_check(hints: DataFrame, allowed: list[str], forbidden: list[str]) -> DataFrame:
    """Adds verdict to hints (source)."""
    return hints.withColumn("verdict", F.when(F.col("source").isin(forbidden), "forbidden").when(F.col("source").isin(allowed), "allowed").otherwise("unknown"))


def tool_loop_check(messages: DataFrame) -> DataFrame:
    """(run_id, n_calls, ran_shell, wrote_files, bare_diff, valid): whether a run really used tools, and whether its last message is only a diff."""
    cmds = F.regexp_count("content", F.lit(r"(?s)```bash|<command>"))
    per = messages.groupBy("run_id").agg(
        F.sum(F.when(F.col("role") == "assistant", cmds).otherwise(0)).cast("long").alias("n_calls"),
        F.max(F.contains("content", F.lit("```bash"))).alias("ran_shell"),
        F.max(F.col("content").rlike(r"sed -i|cat >|write_file")).alias("wrote_files"),
        F.max_by(F.col("content").startswith("diff --git") & (cmds == 0), "step").alias("bare_diff"),
    )
    return per.withColumn("valid", (F.col("n_calls") > 0) & ~F.col("bare_diff"))
