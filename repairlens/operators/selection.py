"""Registries, manifests, priorities, quotas and aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def instance_registry(manifest: DataFrame, bench: DataFrame, canonical: DataFrame) -> DataFrame:
    """Manifest rows with a benchmark entry, enriched by the canonical table; fail_to_pass is a JSON list; a text that is none is split into characters, null is empty."""
    tests = F.from_json(F.col("fail_to_pass"), "array<string>")
    joined = manifest.join(bench, "instance_id").join(canonical, "instance_id", "left")
    return joined.withColumn("fail_to_pass", F.coalesce(tests, F.split("fail_to_pass", ""), F.array().cast("array<string>")))


def filter_registry(registry: DataFrame, pools: list[str] | None = None, sources: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    """The rows of a registry (pool, source, language) that are in every given list; languages in any case. A null value is in no list; no list takes all."""
    out = registry
    for column, values in (("pool", pools), ("source", sources)):
        if values is not None:
            out = out.where(F.col(column).isin(list(values)))
    return out if languages is None else out.where(F.lower("language").isin([x.lower() for x in languages]))


def build_manifest(sources: DataFrame) -> DataFrame:
    """(instance_id, source, status, n_sources): the entry of the source of highest precedence (lowest priority) for each instance."""
    w = Window.partitionBy("instance_id")
    ranked = sources.withColumns({"r": F.row_number().over(w.orderBy("priority", "ord")), "n_sources": F.count("*").over(w)})
    return ranked.where("r = 1").select("instance_id", "source", "status", "n_sources")


def latest_per_key(predictions: DataFrame) -> DataFrame:
    """The newest prediction of each instance; of equal times the first."""
    w = Window.partitionBy("instance_id").orderBy(F.desc("mtime"), "ord")
    return predictions.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def best_by_priority(files: DataFrame, priority: list[str]) -> DataFrame:
    """Per instance the file of the first run in the list, else of the first run by name."""
    place = F.array_position(F.array(*(F.lit(p) for p in priority)), F.col("batch"))
    w = Window.partitionBy("instance_id").orderBy(F.when(place > 0, place).otherwise(len(priority) + 1), "batch", "ord")
    return files.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def predictions_diff(predictions: DataFrame, evaluated: DataFrame) -> DataFrame:
    """(batch, n, n_evaluated, n_open): predictions by batch, and how many are evaluated already."""
    done = evaluated.select("instance_id").distinct().withColumn("done", F.lit(True))
    return predictions.join(done, "instance_id", "left").groupBy("batch").agg(F.count("*").alias("n"), F.count("done").alias("n_evaluated"), (F.count("*") - F.count("done")).alias("n_open"))


def keyword_score(instances: DataFrame, patterns: list[tuple[str, int, str]], repo_scores: dict[str, int], exclude: str | None = None) -> DataFrame:
    """(instance_id, repo, score, labels): score of the repository plus the weights of the patterns found (penalties are negative)."""
    text = F.coalesce("issue", F.lit(""))
    rows = instances.where(~text.rlike(exclude)) if exclude else instances
    hits = [F.when(text.rlike(p), F.struct(F.lit(label).alias("label"), F.lit(weight).alias("w"))) for p, weight, label in patterns]
    found = F.array_compact(F.array(*hits))
    repo = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in repo_scores.items() for x in kv)), "repo"), F.lit(1))
    total = repo + F.aggregate(found, F.lit(0), lambda a, x: a + x["w"])
    return rows.select("instance_id", "repo", total.alias("score"), F.array_join(F.transform(found, lambda x: x["label"]), ",").alias("labels"))


def _top(df: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best rows of each group by score, then id; without groups by a sort with a limit."""
    if not by:
        return df.orderBy(F.desc("score"), "instance_id").limit(k)
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "instance_id")
    return df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def quota_sample(scored: DataFrame, first: str, n_first: int, group: list[str], per_repo: int, total: int) -> DataFrame:
    """(instance_id, repo, score, phase): at most n_first of one repository, per_repo of each in a group, the rest from all others but the first."""
    a = _top(scored.where(F.col("repo") == first), n_first).withColumn("phase", F.lit(1))
    b = _top(scored.where(F.col("repo").isin(group)), per_repo, "repo").withColumn("phase", F.lit(2))
    taken = a.unionByName(b)
    rest = scored.where(F.col("repo") != first).join(taken.select("instance_id"), "instance_id", "left_anti")
    room = total - n_first - per_repo * len(group)
    return taken.unionByName(_top(rest, max(0, room)).withColumn("phase", F.lit(3)))


def category_sample(scored: DataFrame, categories: list[tuple[str, Column, int]]) -> DataFrame:
    """(instance_id, score, category): for each category in order its best rows that no earlier one took."""
    out = None
    for name, cond, n in categories:
        left = scored.where(cond)
        if out is not None:
            left = left.join(out.select("instance_id"), "instance_id", "left_anti")
        picked = _top(left, n).select("instance_id", "score", F.lit(name).alias("category"))
        out = picked if out is None else out.unionByName(picked)
    return out


def resolve_aliases(ids: DataFrame, pool: DataFrame) -> DataFrame:
    """(id, canonical, short_hash): pool rows (dir_name, canonical_id, instance_id) by any of their names; the first name that is set counts, of rows that share a name the least canonical one."""
    name = F.coalesce(*(F.nullif(c, F.lit("")) for c in ("dir_name", "canonical_id", "instance_id")))
    index = pool.select(name.alias("canonical"), F.explode(F.array_distinct(F.array_compact(F.array("dir_name", "instance_id")))).alias("id")).where("id <> ''").groupBy("id").agg(F.min("canonical").alias("canonical"))
    last = F.when(F.col("canonical").endswith("-vnan"), F.element_at(F.split("canonical", "-"), -2)).otherwise(F.element_at(F.split("canonical", "-"), -1))
    return ids.join(index.hint("merge"), "id", "left").withColumn("short_hash", last.rlike("^[0-9a-f]{7,12}$"))


def retry_policy(decisions: DataFrame, pool: DataFrame) -> DataFrame:
    """(instance_id, effective, overridden, reason) of decisions (instance_id, raw_retry, override) against a pool (instance_id, eligible): an override fails closed outside the pool or where not eligible."""
    joined = decisions.join(pool.select("instance_id", "eligible", F.lit(True).alias("in_pool")), "instance_id", "left")
    eligible = F.coalesce("eligible", F.lit(False))
    reason = F.when(F.col("override") & F.col("in_pool").isNull(), "not_in_pool").when(F.col("override") & ~eligible, "not_eligible")
    applied = F.col("override") & eligible & ~F.col("raw_retry")
    return joined.select("instance_id", (F.col("raw_retry") | applied).alias("effective"), applied.alias("overridden"), reason.alias("reason"))


def build_predictions(runs: DataFrame) -> DataFrame:
    """(instance_id, label, bench) of runs with a submission: label from the batch name, bench from the path."""
    return runs.where("trim(coalesce(submission, '')) <> ''").select("instance_id", F.substring_index("batch", "_", 1).alias("label"), F.regexp_extract("path", r"/(\w+)/[^/]+$", 1).alias("bench"))
