"""Rules over features of runs: triggers, findings, hypotheses, plans and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repairlens.functions.joins import join_list

CONFIDENCE = "CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END"


def decision_list(df: DataFrame, rules: list[tuple[str, str]], name: str, other: str) -> DataFrame:
    """Adds the first rule that holds, and all others that do (rules: name and SQL condition)."""
    first = F.coalesce(*(F.when(F.expr(c), F.lit(n)) for n, c in rules), F.lit(other))
    hits = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(n)) for n, c in rules)))
    return df.withColumns({name: first, "alternatives": F.array_join(F.slice(hits, 2, len(rules)), ",")})


def rule_diagnosis(signals: DataFrame) -> DataFrame:
    """(run_id, rank, type, confidence) of findings over (run_id, error_type, error_message, edits_elsewhere); high confidence first, rules in order."""
    low = F.lower(F.coalesce("error_message", F.lit("")))
    rules: list[tuple[Column, str, str]] = [
        (F.contains(low, F.lit("unexpected keyword")), "API_DEFINITION", "high"),
        ((F.col("error_type") == "TypeError") & F.contains(low, F.lit("unsupported operand")), "INTERFACE_CONSTRAINT", "high"),
        (F.col("error_type").isin("ImportError", "ModuleNotFoundError"), "DEPENDENCY", "high"),
        (F.col("error_type") == "AttributeError", "API_DEFINITION", "medium"),
        (F.col("error_type") == "AssertionError", "RELATED_TESTS", "medium"),
        (F.col("edits_elsewhere"), "LOCALIZATION_DIRECTION", "medium"),
    ]
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(i).alias("rule"), F.lit(t).alias("type"), F.lit(k).alias("confidence"))) for i, (c, t, k) in enumerate(rules))))
    none = F.array(F.struct(F.lit(9).alias("rule"), F.lit("NO_RELIABLE_DEFICIENCY").alias("type"), F.lit("low").alias("confidence")))
    rows = signals.select("run_id", F.explode(F.when(F.size(found) > 0, found).otherwise(none)).alias("f")).select("run_id", "f.*").distinct()
    w = Window.partitionBy("run_id").orderBy(F.expr(CONFIDENCE), "rule")
    return rows.withColumn("rank", F.row_number().over(w) - 1).select("run_id", "rank", "type", "confidence")


def rejected_assumptions(edited: DataFrame, errors: DataFrame, most: int = 3) -> DataFrame:
    """(run_id, assumption, location) of runs whose edited files (run_id, pos, file) and error files (the same) have no base name in common: that the fault lies where the edits are. Both lists in order, as many as ``most``."""
    base = lambda c: F.transform(c, lambda f: F.substring_index(f, "/", -1))
    listed = lambda df, name: df.where("file <> ''").groupBy("run_id", "file").agg(F.min("pos").alias("pos")).groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "file"))), lambda x: x["file"]).alias(name))
    both = listed(edited, "e").join(listed(errors, "x").hint("merge"), "run_id").where(~F.arrays_overlap(base("e"), base("x")))
    shown = lambda c, sep: F.array_join(F.slice(c, 1, most), sep)
    return both.select("run_id", F.concat(F.lit("edited "), shown("e", ", "), F.lit(" but error is in "), shown("x", ", ")).alias("assumption"), shown("x", "; ").alias("location"))


def diagnosis_plan(diagnoses: DataFrame) -> DataFrame:
    """(run_id, primary, n, summary): the most confident diagnosis, how many there are, and the first three."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "type")))
    names = F.transform(ordered, lambda x: x["type"])
    return diagnoses.groupBy("run_id").agg(F.element_at(names, 1).alias("primary"), F.count("*").alias("n"), F.array_join(F.slice(names, 1, 3), "; ").alias("summary"))


def error_visit_alignment(frames: DataFrame, views: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """(run_id, alignment): whether a run viewed a source file of its stack, only a test file of it, or none (frames: run_id, file, is_test).

    With runs (run_id, has_failure) each of them has a row: ``unknown`` where nothing failed, no
    witness is there, or the stack is empty.
    """
    seen = views.select("run_id", "file").distinct().withColumn("seen", F.lit(True))
    flags = frames.join(seen.hint("merge"), ["run_id", "file"], "left").groupBy("run_id").agg(F.max(F.coalesce("seen", F.lit(False)) & ~F.col("is_test")).alias("source"), F.max(F.coalesce("seen", F.lit(False)) & F.col("is_test")).alias("test"))
    told = flags.select("run_id", F.when(F.col("source"), "visited_error_file").when(F.col("test"), "visited_stack_frame").otherwise("visited_none").alias("alignment"))
    if runs is None:
        return told
    known = F.when(F.coalesce("has_failure", F.lit(False)), F.coalesce("alignment", F.lit("unknown"))).otherwise("unknown")
    return runs.select("run_id", "has_failure").join(told.hint("merge"), "run_id", "left").select("run_id", known.alias("alignment"))


def hypotheses(diagnoses: DataFrame) -> DataFrame:
    """(run_id, hypothesis_id, type, confidence, uncertainty): ids are digests of what they name."""
    doubt = F.expr("CASE confidence WHEN 'high' THEN 0.2 WHEN 'medium' THEN 0.5 ELSE 0.8 END").cast("double")
    ident = F.concat(F.lit("H"), F.substring(F.sha2(F.concat_ws("|", "run_id", "type", "confidence"), 256), 1, 10))
    return diagnoses.select("run_id", ident.alias("hypothesis_id"), "type", "confidence", doubt.alias("uncertainty"))


def evidence_ledger(facts: DataFrame, most: dict[str, int]) -> DataFrame:
    """(evidence_id, run_id, source, location): the first facts (run_id, ord, source, location) of each source, as many as allowed, under ids by content."""
    w = Window.partitionBy("run_id", "source").orderBy("ord")
    allowed = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in most.items() for x in kv)), "source"), F.lit(0))
    kept = facts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= allowed)
    ident = F.concat(F.lit("E"), F.substring(F.sha2(F.concat_ws("|", "run_id", "source", "location"), 256), 1, 10))
    return kept.select(ident.alias("evidence_id"), "run_id", "source", "location").dropDuplicates(["evidence_id"])


def evidence_conflicts(ledger: DataFrame) -> DataFrame:
    """(evidence_id, n): ids under which different facts stand."""
    return ledger.groupBy("evidence_id").agg(F.count_distinct(F.struct("run_id", "source", "location")).alias("n")).where("n > 1")


# Why a contract that would be worth a search gets none.
OVER_ACTIONS, OVER_RESULTS = "exceeds plan-level action budget", "exceeds plan-level result budget"


def allocate_plan(contracts: DataFrame, max_actions: int = 8, max_budget: int = 40) -> DataFrame:
    """(run_id, ord, accepted, reason) of contracts (run_id, ord, confidence, uncertainty, n_clusters, n_actions, budget): by confidence, certainty and clusters, each that still fits.

    The fold keeps only what changes the remaining budget, so no more entries than the budgets
    have units; each contract then finds the last of them before it. Work is linear in a run's
    contracts.
    """
    key = F.struct(F.expr(CONFIDENCE).alias("c"), "uncertainty", (-F.col("n_clusters")).alias("k"), "ord", "n_actions", "budget")
    taken = "array<struct<at:int,a:bigint,b:bigint>>"
    start = F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0).alias("at"), F.array().cast(taken).alias("out"))

    def step(acc, x):
        a, b = (acc["a"] + x["n_actions"]).cast("bigint"), (acc["b"] + x["budget"]).cast("bigint")
        changes = (a <= max_actions) & (b <= max_budget) & ((x["n_actions"] > 0) | (x["budget"] > 0))
        entry = F.array(F.struct(acc["at"].alias("at"), a.alias("a"), b.alias("b"))).cast(taken)
        return F.struct(F.when(changes, a).otherwise(acc["a"]).alias("a"), F.when(changes, b).otherwise(acc["b"]).alias("b"), (acc["at"] + 1).alias("at"), F.when(changes, F.concat(acc["out"], entry)).otherwise(acc["out"]).alias("out"))

    folded = contracts.groupBy("run_id").agg(F.array_sort(F.collect_list(key)).alias("x")).select("run_id", "x", F.aggregate("x", start, step, lambda acc: acc["out"]).alias("taken"))
    each = folded.select("run_id", "taken", F.posexplode("x").alias("at", "x"))
    last = F.element_at(F.filter(F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))), F.col("taken")), lambda t: t["at"] < F.col("at")), -1)
    reason = F.when(F.col("s.a") + F.col("x.n_actions") > max_actions, OVER_ACTIONS).when(F.col("s.b") + F.col("x.budget") > max_budget, OVER_RESULTS)
    return each.withColumn("s", last).select("run_id", "x.ord", reason.isNull().alias("accepted"), reason.alias("reason"))


def plan_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("run_id").agg(F.expr("count_if(accepted)").alias("actionable"), F.expr("count_if(NOT accepted)").alias("abstained"))


def router_report(results: DataFrame, budget: int) -> DataFrame:
    """(status, n, hits, over_budget) of results (status, hits)."""
    return results.groupBy("status").agg(F.count("*").alias("n"), F.sum("hits").alias("hits"), F.count_if(F.col("hits") > budget).alias("over_budget"))


def episode_eligibility(evals: DataFrame, witnesses: DataFrame) -> DataFrame:
    """(run_id, status, ok) of evaluations (run_id, harness, log_size) with witnesses (run_id, n_tests, message, n_frames)."""
    valid = F.coalesce((F.col("n_tests") > 0) | (~F.col("message").isin("", "No test log")) | (F.col("n_frames") > 0), F.lit(False))
    status = (
        F.when(F.col("harness") == "RESOLVED", "r1_resolved")
        .when(F.col("harness") == "ERROR", "ineligible_harness_error")
        .when(F.col("harness") == "TIMEOUT", "ineligible_harness_timeout")
        .when(F.coalesce(F.col("harness") != "UNRESOLVED", F.lit(True)), "ineligible_harness_unknown")
        .when(F.coalesce("log_size", F.lit(0)) <= 0, "ineligible_missing_test_log")
        .when(~valid, "ineligible_empty_witness")
        .otherwise("eligible")
    )
    return evals.join(witnesses, "run_id", "left").select("run_id", status.alias("status"), status.isin("r1_resolved", "eligible").alias("ok"))


def test_outcomes(reports: DataFrame) -> DataFrame:
    """Adds outcome to (resolved, applied, f2p_passed, f2p_total, p2p_failed)."""
    outcome = F.expr("""CASE WHEN resolved THEN 'resolved' WHEN NOT applied THEN 'patch_apply_failed' WHEN f2p_passed < f2p_total AND p2p_failed = 0 THEN 'f2p_incomplete_no_regression'
      WHEN f2p_passed = f2p_total AND p2p_failed > 0 THEN 'f2p_pass_p2p_regression' ELSE 'other_unresolved' END""")
    return reports.withColumn("outcome", outcome)


def gold_audit(views: DataFrame, gold: DataFrame) -> DataFrame:
    """(instance_id, n_gold, n_seen, first_step): gold files (instance_id, path) that were viewed, by base name, and when first."""
    base = lambda df: df.withColumn("base", F.substring_index("path", "/", -1))
    seen = base(views).groupBy("instance_id", "base").agg(F.min("step").alias("step"))
    return base(gold.distinct()).join(seen, ["instance_id", "base"], "left").groupBy("instance_id").agg(F.count("*").alias("n_gold"), F.count("step").alias("n_seen"), F.min("step").alias("first_step"))


def gold_coverage(views: DataFrame, edits: DataFrame, gold: DataFrame) -> DataFrame:
    """(instance_id, first_step, coverage, seen_then_dropped) of gold files (instance_id, path), all by base name: when the first was viewed (views: step, path), the share that was, and those viewed but not edited (edits: path), sorted. Instances without gold files have no row."""
    base = lambda df: df.withColumn("base", F.substring_index("path", "/", -1))
    names = base(gold).select("instance_id", "base").distinct()
    seen = base(views).groupBy("instance_id", "base").agg(F.min("step").alias("step"))
    edited = base(edits).select("instance_id", "base").distinct().withColumn("edited", F.lit(True))
    full = names.join(seen.hint("merge"), ["instance_id", "base"], "left").join(edited.hint("merge"), ["instance_id", "base"], "left")
    dropped = F.array_sort(F.collect_list(F.when(F.col("step").isNotNull() & F.col("edited").isNull(), F.col("base"))))
    return full.groupBy("instance_id").agg(F.min("step").alias("first_step"), (F.count("step") / F.count("*")).alias("coverage"), dropped.alias("seen_then_dropped"))


def compile_reports(reports: DataFrame) -> DataFrame:
    """(batch, n, resolved, failing) of reports (batch, resolved, failed_tests array)."""
    return reports.groupBy("batch").agg(F.count("*").alias("n"), F.expr("count_if(resolved)").alias("resolved"), F.sum(F.size("failed_tests")).alias("failing"))


def pair_test_runs(tests: DataFrame, outputs: DataFrame, reach: int = 4) -> DataFrame:
    """(run_id, out_step, test_step) of tests (run_id, step, and pos where a step has several commands) and outputs (run_id, step): each output goes to the latest earlier test command within reach that no earlier output took.

    Commands and outputs match like brackets: a command opens a level, an output closes the one
    that is open. What is out of reach is older than all that isn't, so pairs out of reach are
    dropped at the end. Windows over a run's events do it; nothing is folded.
    """
    pos = F.col("pos").cast("long") if "pos" in tests.columns else F.lit(0).cast("long")
    opened = tests.select("run_id", F.col("step").cast("long").alias("step"), pos.alias("pos"), F.lit(1).alias("sign"))
    events = opened.unionByName(outputs.select("run_id", F.col("step").cast("long").alias("step"), F.lit(-1).cast("long").alias("pos"), F.lit(-1).alias("sign"))).distinct()
    order = Window.partitionBy("run_id").orderBy("step", "pos")  # an output comes before the commands of its own step
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    depth = events.withColumn("sum", F.sum("sign").over(upto)).withColumn("depth", F.col("sum") - F.least(F.min("sum").over(upto), F.lit(0)))
    before = F.coalesce(F.lag("depth").over(order), F.lit(0))
    level = depth.withColumn("level", F.when(F.col("sign") > 0, F.col("depth")).otherwise(before)).where("level > 0")
    beside = Window.partitionBy("run_id", "level").orderBy("step", "pos").rowsBetween(Window.unboundedPreceding, 0)
    paired = level.withColumn("t", F.last(F.when(F.col("sign") > 0, F.struct("step", "pos")), True).over(beside)).where("sign < 0")
    near = paired.where(F.col("step") - F.col("t.step") <= reach).select("run_id", F.col("step").alias("out_step"), F.col("t.step").alias("test_step"), F.col("t.pos").alias("pos"))
    return near if "pos" in tests.columns else near.drop("pos")


# What a command's output looks like, and the failed nodes in it.
RETURNED = r"(?i)<returncode>(-?\d+)</returncode>\s*<output>([\s\S]*?)</output>"
FAILED_NODE = r"FAILED\s+(\S+?)::(\S+)"


def test_run_results(commands: DataFrame, messages: DataFrame, reach: int = 4) -> DataFrame:
    """(run_id, test_step, pos, cmd, out_step, returncode, failed_tests, excerpt): test commands (run_id, step, pos, cmd, is_test) with the output (messages: run_id, step, role, content) that answers each."""
    told = messages.where(F.col("role") != "assistant").where(F.col("content").rlike(RETURNED)).select("run_id", F.col("step").cast("long").alias("out_step"), F.regexp_extract("content", RETURNED, 1).cast("int").alias("returncode"), F.regexp_extract("content", RETURNED, 2).alias("output"))
    tests = commands.where("is_test").select("run_id", F.col("step").cast("long").alias("step"), F.col("pos").cast("long").alias("pos"), "cmd").distinct()
    pairs = pair_test_runs(tests.select("run_id", "step", "pos"), told.select("run_id", F.col("out_step").alias("step")), reach)
    nodes = F.array_distinct(F.zip_with(F.regexp_extract_all("output", F.lit(FAILED_NODE), F.lit(1)), F.regexp_extract_all("output", F.lit(FAILED_NODE), F.lit(2)), lambda a, b: F.concat(a, F.lit("::"), b)))
    full = pairs.join(tests.withColumnRenamed("step", "test_step").hint("merge"), ["run_id", "test_step", "pos"]).join(told.hint("merge"), ["run_id", "out_step"])
    return full.select("run_id", "test_step", "pos", "cmd", "out_step", "returncode", nodes.alias("failed_tests"), F.substring("output", 1, 1500).alias("excerpt"))


def tool_events(calls: DataFrame) -> DataFrame:
    """(run_id, name, n): distinct tool calls (run_id, turn, call_id, name, arguments): by id, else by a digest of what they say; the earliest gives the name."""
    said = F.sha2(F.to_json(F.struct("turn", "name", "arguments")), 256)
    key = F.when(F.coalesce("call_id", F.lit("")) != "", F.concat(F.lit("evt:"), "call_id")).otherwise(F.concat(F.lit("anon:"), said))
    return calls.withColumn("key", key).groupBy("run_id", "key").agg(F.min_by("name", F.struct("turn", "name")).alias("name")).groupBy("run_id", "name").agg(F.count("*").alias("n"))


def run_cost(messages: DataFrame) -> DataFrame:
    """(run_id, n_calls, first_ts, last_ts): calls, and the times of the first and last message in order (messages: run_id, step, role, ts)."""
    return messages.groupBy("run_id").agg(F.expr("count_if(role = 'assistant')").alias("n_calls"), F.min_by("ts", "step").alias("first_ts"), F.max_by("ts", "step").alias("last_ts"))


def run_costs(messages: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, model, provider, api_calls, wall_seconds, usd, pricing): of runs (run_id, model_name, api_calls, instance_cost) with messages (run_id, step, ts).

    The provider is what stands before a slash in the model's name. Wall time lies between the
    first and the last message that has a time, in order of steps; null where fewer than two do.
    A cost of nothing is unknown.
    """
    timed = messages.where("ts IS NOT NULL").groupBy("run_id").agg(F.count("*").alias("n"), F.min_by("ts", "step").alias("first"), F.max_by("ts", "step").alias("last"))
    model = F.coalesce(F.nullif("model_name", F.lit("")), F.lit("unknown"))
    cost = F.nullif(F.coalesce("instance_cost", F.lit(0.0)), F.lit(0.0))
    wall = F.when(F.col("n") > 1, (F.col("last") - F.col("first")).cast("double"))
    return runs.join(timed.hint("merge"), "run_id", "left").select(
        "run_id", model.alias("model"), F.when(F.contains(model, F.lit("/")), F.split_part(model, F.lit("/"), F.lit(1))).otherwise("unknown").alias("provider"),
        F.coalesce(F.col("api_calls").cast("long"), F.lit(0).cast("long")).alias("api_calls"), wall.alias("wall_seconds"), cost.alias("usd"), F.when(cost.isNotNull(), "instance_cost").otherwise("unavailable").alias("pricing"),
    )


def cost_by_model(costs: DataFrame) -> DataFrame:
    """(provider, model, n, api_calls, wall_seconds, usd): sums of run_costs() over what is known."""
    return costs.groupBy("provider", "model").agg(F.count("*").alias("n"), F.sum("api_calls").alias("api_calls"), F.sum("wall_seconds").alias("wall_seconds"), F.round(F.sum("usd"), 6).alias("usd"))


def submission_of(sources: DataFrame) -> DataFrame:
    """(run_id, source, consistent): the first source in order (run_id, priority, source, patch) that holds a patch, and whether all that do agree."""
    held = sources.where("trim(coalesce(patch, '')) <> ''")
    return held.groupBy("run_id").agg(F.min_by("source", "priority").alias("source"), (F.count_distinct(F.sha2(F.trim("patch"), 256)) == 1).alias("consistent"))


def branch_verdict(comparisons: DataFrame) -> DataFrame:
    """Adds verdict to (fair, second_run, first_valid, second_valid, first_resolved, second_resolved): fairness, then validity, then who wins."""
    verdict = F.expr("""CASE WHEN NOT fair THEN 'invalid_fairness' WHEN NOT second_run THEN 'second_disabled' WHEN NOT first_valid AND NOT second_valid THEN 'invalid_both' WHEN NOT first_valid THEN 'invalid_first'
      WHEN NOT second_valid THEN 'invalid_second' WHEN first_resolved AND second_resolved THEN 'both_succeed' WHEN first_resolved THEN 'first_wins' WHEN second_resolved THEN 'second_wins' ELSE 'both_fail' END""")
    return comparisons.withColumn("verdict", verdict)


def branch_fairness(branches: DataFrame) -> DataFrame:
    """Adds fair, same_state, first_valid and second_valid to (base_sha, first_sha, second_sha, base_state, first_state, second_state, first_restored, second_restored, second_run, first_intact, second_intact, first_status, second_status).

    Fair: both branches began from the first run's tracked code, by digests that are there, and
    were restored; a branch that didn't run passes. same_state compares whole workspaces and
    blocks nothing. A branch is valid if its patch is intact and the harness gave a verdict.
    """
    same = lambda a, b: (F.coalesce(a, F.lit("")) != "") & F.coalesce(F.col(a) == F.col(b), F.lit(False))
    ran, yes = F.coalesce("second_run", F.lit(False)), lambda c: F.coalesce(c, F.lit(False))
    second = lambda cond: ~ran | cond
    valid = lambda x: yes(f"{x}_intact") & F.coalesce(F.col(f"{x}_status").isin("RESOLVED", "UNRESOLVED"), F.lit(False))
    return branches.withColumns({
        "fair": same("base_sha", "first_sha") & yes("first_restored") & second(same("base_sha", "second_sha") & yes("second_restored")),
        "same_state": same("base_sha", "first_sha") & same("base_state", "first_state") & second(same("base_sha", "second_sha") & same("base_state", "second_state")),
        "first_valid": valid("first"), "second_valid": second(valid("second")),
    })


def packet_mode(runs: DataFrame) -> DataFrame:
    """Adds packet_mode to (trigger, family, pathology, repo_status, done, guards)."""
    mode = F.expr("""CASE WHEN trigger = 'NO_TRIGGER' THEN 'noop' WHEN family = 'ABSTAIN' OR pathology = 'INSUFFICIENT_RUNTIME_EVIDENCE' THEN 'abstain' WHEN repo_status <> 'resolved' THEN 'diagnostic_only_no_repo'
      WHEN done > 0 AND guards THEN 'guard' WHEN done > 0 THEN 'retrieval' ELSE 'diagnostic_only_no_actions' END""")
    return runs.withColumn("packet_mode", mode)


def normalize_diagnosis(diagnoses: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(id, pathology, family, action, intent, known): manual values of (id, pathology, action, intent) first, then those of the taxonomy (pathology, family, default_action, default_intent)."""
    table = taxonomy.withColumn("known", F.lit(True))
    joined = join_list(diagnoses, table, "pathology", "left")
    own = lambda c, d: F.coalesce(F.nullif(c, F.lit("")), d)
    return joined.select("id", "pathology", F.coalesce("family", F.lit("ABSTAIN")).alias("family"), own("action", "default_action").alias("action"), own("intent", "default_intent").alias("intent"), F.coalesce("known", F.lit(False)).alias("known"))


def run_matrix(runs: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """One wide row for each run (instance_id, baseline) from optional artefacts, and whether each is there."""
    out = runs
    for name, part in parts.items():
        out = out.join(part.withColumn(f"has_{name}", F.lit(True)), ["instance_id", "baseline"], "left").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    return out
