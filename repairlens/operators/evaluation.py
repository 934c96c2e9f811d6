"""Spans against gold lines, evaluation records, rescues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expand_spans(spans: DataFrame) -> DataFrame:
    """(instance_id, kind, path, line) of inclusive spans, each line once; spans that begin before 1 or end before they begin are empty."""
    valid = spans.where("start_line > 0 AND end_line >= start_line")
    return valid.select("instance_id", "kind", "path", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()


KINDS = ["gold", "viewed", "final", "edited", "candidate"]


def segments(spans: DataFrame, kinds: list[str] = KINDS) -> DataFrame:
    """(instance_id, path, start_line, end_line, n, one flag for each kind): stretches of lines that the same kinds of spans (instance_id, kind, path, start_line, end_line) cover.

    A sweep over the ends of spans: at each end the number of open spans of a kind changes, and
    between two ends it stays. So the rows are as many as the ends, however long the spans are.
    """
    valid = spans.where("start_line > 0 AND end_line >= start_line").where(F.col("kind").isin(kinds))
    ends = valid.select("instance_id", "kind", "path", F.explode(F.array(F.struct(F.col("start_line").alias("at"), F.lit(1).alias("d")), F.struct((F.col("end_line") + 1).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy("instance_id", "path", "e.at").agg(*(F.sum(F.when(F.col("kind") == k, F.col("e.d")).otherwise(0)).alias(k) for k in kinds))
    order = Window.partitionBy("instance_id", "path").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    swept = steps.select("instance_id", "path", F.col("at").alias("start_line"), (F.lead("at").over(order) - 1).alias("end_line"), *((F.sum(k).over(upto) > 0).alias(k) for k in kinds))
    covered = F.array_contains(F.array(*kinds), True)
    return swept.where(F.col("end_line").isNotNull() & covered).withColumn("n", (F.col("end_line") - F.col("start_line") + 1).cast("long"))


def overlap_metrics(segments: DataFrame, candidate: str = "candidate", gold: str = "gold") -> DataFrame:
    """Per instance counts of files and lines of candidates, gold and both, from segments(), and precision, recall and F1 (null where undefined)."""
    lines = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    c, g = F.col(candidate), F.col(gold)
    files = segments.where(c | g).groupBy("instance_id", "path").agg(F.max(c).alias("fc"), F.max(g).alias("fg"), lines(c).alias("lc"), lines(g).alias("lg"), lines(c & g).alias("lb"))
    total = files.groupBy("instance_id").agg(
        F.count_if("fc").alias("cand_files"), F.count_if("fg").alias("gold_files"), F.count_if(F.col("fc") & F.col("fg")).alias("file_inter"),
        F.sum("lc").alias("cand_lines"), F.sum("lg").alias("gold_lines"), F.sum("lb").alias("line_inter"),
    )
    rate = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return total.withColumns({
        "file_precision": rate("file_inter", "cand_files"), "file_recall": rate("file_inter", "gold_files"),
        "line_precision": rate("line_inter", "cand_lines"), "line_recall": rate("line_inter", "gold_lines"),
        "line_f1": F.try_divide(2 * F.col("line_inter"), F.col("cand_lines") + F.col("gold_lines")),
    })


def overlap_per_1k(metrics: DataFrame, packets: DataFrame) -> DataFrame:
    """Adds overlap_per_1k_chars to overlap_metrics(): hit lines for each thousand characters of the packet (instance_id, packet_chars); 0 for an empty or missing one."""
    both = metrics.join(packets.select("instance_id", "packet_chars").hint("merge"), "instance_id", "left")
    return both.withColumn("overlap_per_1k_chars", F.when(F.col("packet_chars") > 0, F.round(F.col("line_inter") / (F.col("packet_chars") / 1000), 3)).otherwise(0.0)).drop("packet_chars")


def gold_segments(segments: DataFrame) -> DataFrame:
    """(instance_id, path, start_line, end_line, n, seen, final, edited, hit) of the stretches of gold lines; what gold_subsets says line by line."""
    return segments.where("gold").select("instance_id", "path", "start_line", "end_line", "n", F.col("viewed").alias("seen"), "final", "edited", F.col("candidate").alias("hit"))


def gold_subsets(lines: DataFrame) -> DataFrame:
    """(instance_id, path, line, seen, final, edited) of each gold line, by one pass over all kinds."""
    has = lambda kind: F.max(F.col("kind") == kind)
    flags = lines.groupBy("instance_id", "path", "line").agg(has("gold").alias("gold"), has("viewed").alias("seen"), has("final").alias("final"), has("edited").alias("edited"), has("candidate").alias("hit"))
    return flags.where("gold").drop("gold")


SUBSETS = {"raw": "true", "incremental": "NOT (final OR edited)", "dropped": "seen AND NOT final", "unseen": "NOT seen"}


def incremental_recall(subsets: DataFrame) -> DataFrame:
    """Per instance, for each subset of gold_segments(), how many lines there are, how many candidates hit, and the recall (null: not applicable)."""
    total = lambda cond: F.expr(f"sum(CASE WHEN {cond} THEN n ELSE 0 END)")
    counts = [total(cond).alias(f"{n}_lines") for n, cond in SUBSETS.items()] + [total(f"hit AND {cond}").alias(f"{n}_hits") for n, cond in SUBSETS.items()]
    return subsets.groupBy("instance_id").agg(*counts).withColumns({f"{n}_recall": F.try_divide(f"{n}_hits", f"{n}_lines") for n in SUBSETS})


# Ablation modes over the sources of candidates.
MODES = {"all": "edited OR viewed OR search", "only_edited": "edited", "only_viewed": "viewed", "only_search": "search", "without_edited": "viewed OR search"}


def source_ablation(segments: DataFrame) -> DataFrame:
    """(instance_id, mode, n_hits, n_gold): gold lines hit by the candidates of each ablation mode, from segments() of the kinds gold, edited, viewed and search."""
    each = F.array(*(F.struct(F.lit(m).alias("mode"), F.expr(cond).alias("hit")) for m, cond in MODES.items()))
    return segments.where("gold").select("instance_id", "n", F.explode(each).alias("m")).groupBy("instance_id", "m.mode").agg(F.sum(F.when(F.col("m.hit"), F.col("n")).otherwise(0)).alias("n_hits"), F.sum("n").alias("n_gold"))


def baseline_aggregates(metrics: DataFrame) -> DataFrame:
    """(baseline, n, hits, gold, firing_hits, avg_recall, avg_firing_recall): sums, and averages of hits / gold over all rows with gold lines and over those of them with candidates; one row more for all baselines."""
    recall = F.expr("CASE WHEN gold > 0 THEN hits / gold END")
    grouped = metrics.withColumn("recall", recall).rollup("baseline").agg(
        F.count("*").alias("n"), F.sum("hits").alias("hits"), F.sum("gold").alias("gold"), F.expr("sum(CASE WHEN cands > 0 THEN hits END)").alias("firing_hits"),
        F.round(F.avg("recall"), 6).alias("avg_recall"), F.round(F.avg(F.when(F.col("cands") > 0, F.col("recall"))), 6).alias("avg_firing_recall"),
    )
    return grouped.withColumn("baseline", F.coalesce("baseline", F.lit("*")))


def win_rate(metrics: DataFrame) -> DataFrame:
    """(baseline, wins, ties): per instance the baseline of most hits; shared first places count as ties."""
    ranked = metrics.withColumn("r", F.rank().over(Window.partitionBy("instance_id").orderBy(F.desc("hits")))).where("r = 1")
    shared = ranked.withColumn("k", F.count("*").over(Window.partitionBy("instance_id")))
    return shared.groupBy("baseline").agg(F.expr("count_if(k = 1)").alias("wins"), F.expr("count_if(k > 1)").alias("ties"))


def merge_eval_status(records: DataFrame) -> DataFrame:
    """(instance_id, resolved, status, conflict) from all records (instance_id, ord, priority, resolved, eval_error) of an instance.

    False outweighs true, and true outweighs not evaluated; what differs is a conflict.
    """
    state = F.when(F.col("resolved"), "True").when(~F.col("resolved"), "False").otherwise("NOT_EVALUATED")
    lead = F.struct("priority", "ord")
    g = records.groupBy("instance_id").agg(
        F.count("*").alias("n"), F.min(state).alias("low"), F.max(state).alias("high"), F.expr("bool_or(NOT resolved)").alias("failed"), F.expr("bool_or(resolved)").alias("passed"), F.min_by("eval_error", lead).alias("error")
    )
    conflict = F.col("low") != F.col("high")
    resolved = F.when(F.col("failed"), "False").when(F.col("passed"), "True").otherwise("NOT_EVALUATED")
    broken = F.when(F.contains("error", F.lit("patch_apply")), "PATCH_APPLY_FAILED").when(F.col("error") != "", "ENV_ERROR")
    status = F.when(conflict, "CONFLICT").when(resolved == "NOT_EVALUATED", "NOT_EVALUATED").when((F.col("n") == 1) & (resolved == "False"), F.coalesce(broken, F.lit("EVALUATED"))).otherwise("EVALUATED")
    return g.select("instance_id", resolved.alias("resolved"), status.alias("status"), conflict.alias("conflict"))


def failure_class(matrix: DataFrame) -> DataFrame:
    """Adds failure_class to (status, resolved, test_failures, submitted_without_tests, patch_exists)."""
    cls = F.expr("""CASE WHEN status IN ('ENV_ERROR', 'PATCH_APPLY_FAILED') THEN 'env-anomaly' WHEN status = 'CONFLICT' THEN 'unknown' WHEN resolved = 'True' THEN 'resolved'
      WHEN status = 'NOT_EVALUATED' THEN 'unknown' WHEN resolved = 'False' AND test_failures > 0 THEN 'visible-failure' WHEN resolved = 'False' AND submitted_without_tests THEN 'no-runtime-signal'
      WHEN resolved = 'False' AND test_failures = 0 AND patch_exists THEN 'hidden-failure' ELSE 'unknown' END""")
    return matrix.withColumn("failure_class", cls)


def eval_overview(matrix: DataFrame) -> DataFrame:
    """(failure_class, status, n) of an evaluation matrix."""
    return matrix.groupBy("failure_class", "status").agg(F.count("*").alias("n"))


def eval_matrix(instances: DataFrame, runs: DataFrame, records: DataFrame) -> DataFrame:
    """One row for each of instances (instance_id, batch): merged evaluation of records, facts of runs (instance_id, patch_exists, patch_chars, test_runs, test_failures, submitted_without_tests), and the failure class. What isn't known counts as not evaluated, and as no patch, no tests and no failures."""
    merged = merge_eval_status(records)
    full = instances.select("instance_id", F.coalesce("batch", F.lit("unknown")).alias("batch")).join(runs.hint("merge"), "instance_id", "left").join(merged.hint("merge"), "instance_id", "left")
    zero, no = F.lit(0).cast("long"), F.lit(False)
    filled = full.withColumns({
        "patch_exists": F.coalesce("patch_exists", no), "patch_chars": F.coalesce("patch_chars", zero), "test_runs": F.coalesce("test_runs", zero), "test_failures": F.coalesce("test_failures", zero),
        "submitted_without_tests": F.coalesce("submitted_without_tests", no), "resolved": F.coalesce("resolved", F.lit("NOT_EVALUATED")), "status": F.coalesce("status", F.lit("NOT_EVALUATED")), "conflict": F.coalesce("conflict", no),
    })
    return failure_class(filled)


def matrix_counts(matrix: DataFrame) -> DataFrame:
    """(metric, n) over eval_matrix(): discovered, evaluated, not evaluated, broken, resolved, unresolved, conflicts."""
    conds = {"discovered": "true", "evaluated": "status = 'EVALUATED'", "not_evaluated": "status = 'NOT_EVALUATED'", "broken": "status IN ('ENV_ERROR', 'PATCH_APPLY_FAILED')", "resolved": "resolved = 'True'", "unresolved": "resolved = 'False'", "conflicts": "status = 'CONFLICT'"}
    one = matrix.agg(*(F.expr(f"count_if({c})").alias(n) for n, c in conds.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("n")) for n in conds))).alias("m")).select("m.*")


def first_failed(matrix: DataFrame) -> DataFrame:
    """The rows of eval_matrix() whose first attempt was evaluated, without conflict, and failed."""
    return matrix.where("resolved = 'False' AND status = 'EVALUATED' AND NOT conflict")


def rescue_matrix(base: DataFrame, attempts: DataFrame) -> DataFrame:
    """(instance_id, baseline, rescued, alone): attempts (instance_id, baseline, resolved) on instances that base (instance_id, resolved) failed; alone: no other baseline rescued it."""
    tried = attempts.groupBy("instance_id", "baseline").agg(F.expr("bool_or(coalesce(resolved, false))").alias("rescued"))
    failed = base.where("resolved = 'False'").select("instance_id")
    n = F.count_if("rescued").over(Window.partitionBy("instance_id"))
    return tried.join(failed, "instance_id", "left_semi").withColumn("alone", F.col("rescued") & (n == 1))


def action_group_metrics(metrics: DataFrame, baselines: list[str]) -> DataFrame:
    """Hits per action in a column for each baseline (metrics: action, baseline, hits)."""
    return metrics.groupBy("action").pivot("baseline", baselines).agg(F.sum("hits"))


def abstain_checks(reports: DataFrame, baselines: list[str]) -> DataFrame:
    """(instance_id, baseline, action, abstain, others_silent, abstain_correct, false_intervention) of reports (instance_id, baseline, action, packet_mode, should_retry).

    What the other baselines agree on stands for the truth: they are silent if none of them would
    retry; one without a report is silent too. To abstain then is right, to intervene is false.
    """
    own = reports.where(F.col("baseline").isin(baselines)).groupBy("instance_id", "baseline").agg(F.bool_or(F.coalesce("should_retry", F.lit(False))).alias("fires"), F.bool_or(F.coalesce(F.endswith("packet_mode", F.lit("_noop")), F.lit(False))).alias("abstain"), F.max("action").alias("action"))
    fired = F.count_if("fires").over(Window.partitionBy("instance_id"))  # a row for each baseline
    silent = own.withColumn("others_silent", fired - F.col("fires").cast("int") == 0)
    return silent.select("instance_id", "baseline", "action", "abstain", "others_silent", (F.col("abstain") & F.col("others_silent")).alias("abstain_correct"), (~F.col("abstain") & F.col("others_silent")).alias("false_intervention"))


def abstain_summary(checks: DataFrame, recall: DataFrame) -> DataFrame:
    """(baseline, action, n, abstained, abstain_correct, false_interventions, avg_recall) of abstain_checks() with recall (instance_id, baseline, incremental_recall; null: not applicable)."""
    both = checks.join(recall.select("instance_id", "baseline", "incremental_recall").hint("merge"), ["instance_id", "baseline"], "left")
    return both.groupBy("baseline", "action").agg(F.count("*").alias("n"), F.count_if("abstain").alias("abstained"), F.count_if("abstain_correct").alias("abstain_correct"), F.count_if("false_intervention").alias("false_interventions"), F.round(F.avg("incremental_recall"), 6).alias("avg_recall"))


def difficulty_profile(instances: DataFrame) -> DataFrame:
    """(bucket, n, median, p90) of instances (instance_id, size): the value at position n div 2, and at 90 % of n."""
    bucket = F.expr("CASE WHEN size < 10 THEN 'small' WHEN size < 30 THEN 'medium' ELSE 'large' END")
    sizes = instances.groupBy(bucket.alias("bucket"), "size").agg(F.count("*").alias("k"))
    w = Window.partitionBy("bucket")  # a row for each distinct size
    placed = sizes.withColumns({"n": F.sum("k").over(w), "upto": F.sum("k").over(w.orderBy("size"))})
    at = lambda where: F.min_by("size", F.when(F.col("upto") > where, F.col("upto")))
    return placed.groupBy("bucket").agg(F.max("n").alias("n"), at(F.expr("n div 2")).alias("median"), at(F.expr("CAST(floor(n * 0.9) AS BIGINT)")).alias("p90"))


# Buckets by the number of agents that solved an instance, with their upper bounds, and the number that an unknown one counts as.
SOLVED_BUCKETS = [("0 (unsolved)", 0), ("1-5 (hard)", 5), ("6-15 (medium)", 15), ("16-30 (easy)", 30), ("31+ (trivial)", None)]
UNKNOWN_SOLVED = 9999


def solved_histogram(instances: DataFrame) -> DataFrame:
    """(bucket, n) of instances (solved: how many agents solved it); unknown ones are left out."""
    bucket = F.lit(SOLVED_BUCKETS[-1][0])
    for name, most in reversed(SOLVED_BUCKETS[:-1]):
        bucket = F.when(F.col("solved") <= most, name).otherwise(bucket)
    return instances.where("solved IS NOT NULL").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def hardest_easiest(instances: DataFrame, hardest: int = 10, easiest: int = 5) -> DataFrame:
    """(side, instance_id, repo, solved): the instances solved least and most often, by id at equal numbers; an unknown number counts as very large."""
    known = instances.select("instance_id", "repo", F.coalesce("solved", F.lit(UNKNOWN_SOLVED)).cast("long").alias("solved"))
    low = known.orderBy("solved", "instance_id").limit(hardest).select(F.lit("hardest").alias("side"), "*")
    return low.unionByName(known.orderBy(F.desc("solved"), F.desc("instance_id")).limit(easiest).select(F.lit("easiest").alias("side"), "*"))


def hard_repo_mix(instances: DataFrame, hardest: int = 30, top: int = 10) -> DataFrame:
    """(repo, n): the repositories with most of the hardest instances; without one, it is the id up to its last dash, with __ as a slash."""
    from_id = F.replace(F.regexp_replace(F.col("instance_id").cast("string"), "-[^-]*$", ""), F.lit("__"), F.lit("/"))
    named = instances.withColumn("repo", F.coalesce(F.nullif("repo", F.lit("")), from_id))
    hard = hardest_easiest(named, hardest, 0).groupBy("repo").agg(F.count("*").alias("n"))
    return hard.orderBy(F.desc("n"), "repo").limit(top)
