"""Golden rows of the runtime rules, and hints against plain Python."""

import re

from repairlens.operators import runtime_rules as rr
from repairlens.plans.fixtures import frame

NUMBERS = "run_id long, exit_status string, test_runs int, test_failures int, git_checkouts int, edited_files int, changed_files int, changed_lines int, repeated_pattern boolean, submitted_without_tests boolean, viewed_files int, viewed_not_final int, edited_not_viewed int, scope_score int, regressions int"
QUIET = dict(exit_status="Submitted", test_runs=0, test_failures=0, git_checkouts=0, edited_files=3, changed_files=3, changed_lines=60, repeated_pattern=False, submitted_without_tests=False, viewed_files=1, viewed_not_final=0, edited_not_viewed=0, scope_score=0, regressions=0)


def features(spark, *changes):
    return spark.createDataFrame([(i, *(QUIET | c).values()) for i, c in enumerate(changes)], NUMBERS)


REGRESSION = dict(test_runs=3, git_checkouts=2, edited_files=2, test_failures=1, changed_lines=20)


def test_cascade(spark):
    got = {r.run_id: (r.trigger, r.gap, r.confidence, r.alternatives) for r in rr.retry_cascade(features(spark, {}, {"exit_status": " timeout "}, REGRESSION, {"edited_files": 5, "edited_not_viewed": 1}, {"viewed_not_final": 3}, {"edited_files": 1, "changed_lines": 50, "test_runs": 1}, {"exit_status": None, "test_runs": None})).collect()}
    assert got[0] == got[6] == ("NO_TRIGGER", "SUFFICIENT_OR_NOOP", "high", "")
    assert got[1] == ("HARD_FAILURE", "TERMINATION_FAILURE", "high", "")
    assert got[2] == ("RUNTIME_VALIDATION_FAILURE", "CONSTRAINT_CONFLICT", "high", "PARTIAL_FIX_SUSPICION")
    assert got[3] == ("PATCH_SHAPE_ANOMALY", "NOISY_OVERBROAD", "high", "EVIDENCE_EDIT_MISMATCH")
    assert got[4] == ("EVIDENCE_EDIT_MISMATCH", "SEEN_BUT_DROPPED", "medium", "") and got[5][0] == "PARTIAL_FIX_SUSPICION"


def test_candidates_by_confidence(spark):
    got = [tuple(r) for r in rr.trigger_candidates(features(spark, REGRESSION | {"scope_score": 4, "viewed_not_final": 3})).orderBy("rank").collect()]
    assert [(r[2], r[6]) for r in got] == [("OVER_EXPLORE_OVER_EDIT", 0.9), ("REGRESSION_AFTER_PARTIAL_FIX", 0.88), ("EXPLORE_OK_EDIT_MISALIGNED", 0.6)]


def test_deficiency_rules(spark):
    rows = [({"viewed_files": 8}, "EVIDENCE_EDIT_MISMATCH", "subclass it"), ({"changed_lines": 10, "edited_files": 1, "viewed_files": 3}, "X", "pk is wrong"), ({}, "X", None), ({"edited_files": 0, "test_runs": 3, "changed_lines": 19}, "PARTIAL_FIX_SUSPICION", "nothing")]
    table = spark.createDataFrame([(i, *(QUIET | c).values(), t, text) for i, (c, t, text) in enumerate(rows)], NUMBERS + ", trigger string, issue string")
    got = {r.run_id: (r.deficiency, r.confidence, r.secondaries) for r in rr.rule_deficiency(table).collect()}
    assert got == {
        0: ("REGRESSION_CONSTRAINT_CONTEXT", 0.70, "EDIT_SCOPE_CONTEXT,RELATED_TEST_CONTEXT"),
        1: ("INTERFACE_CONSTRAINT_CONTEXT", 0.60, "API_DEFINITION_CONTEXT,RELATED_TEST_CONTEXT"),
        2: ("EDIT_SCOPE_CONTEXT", 0.55, "RELATED_TEST_CONTEXT"),
        3: ("RELATED_TEST_CONTEXT", 0.55, ""),
    }


def test_relocalisation(spark):
    lists = "origin_files array<string>, tokens array<string>, searches array<string>, edited array<string>, final array<string>, has_failure boolean"
    rows = [({"test_failures": 1}, ["a.py"], ["E033"], ["grep -rn alpha"], ["b.py"], ["c.py"], True), ({"test_failures": 1}, ["a.py"], ["E033"], ["grep e033"], ["a.py"], ["a.py"], True), ({"viewed_not_final": 2, "changed_files": 8, "repeated_pattern": True, "regressions": 3}, None, None, None, None, None, None)]
    table = spark.createDataFrame([(i, *(QUIET | c).values(), *rest) for i, (c, *rest) in enumerate(rows)], f"{NUMBERS}, {lists}")
    got = {r.run_id: (r.score, r.strength, r.searched) for r in rr.relocalize_score(table).collect()}
    assert got == {0: (10, "strong", ""), 1: (6, "strong", "E033"), 2: (-5, "none", "")}


def test_constraints(spark):
    more = "edit_alignment string, mode string, dropped array<string>, error_file string"
    table = spark.createDataFrame([(0, *QUIET.values(), "error_file_never_viewed", "oscillating", ["a", "b", "c"], "x.py"), (1, *(QUIET | {"edited_files": 4}).values(), None, None, None, None)], f"{NUMBERS}, {more}")
    got = [tuple(r)[:1] + tuple(r)[2:] for r in rr.structured_constraints(table).orderBy("run_id", "place").collect()]
    assert [g[:2] for g in got] == [(0, "FORBID_TEST_EDITS"), (0, "REQUIRE_INSPECTION_BEFORE_EDIT"), (0, "AVOID_REPETITIVE_TEST_RUNS"), (0, "REVISIT_DROPPED_FILES"), (1, "FORBID_TEST_EDITS"), (1, "PREFER_SINGLE_FILE_FIX")]
    assert got[1][3] == "target_path=x.py" and got[3][3] == "file_paths=a,b,c"


def test_hints_equal_plain_python(spark):
    issues = [(r.instance_id, r.issue) for r in frame(spark, "/root/testdata/sf0.001", "issues").collect()]
    issues += [(9000 + i, "the Model.Meta class and pkg.mod.func fail; call get_value(x) and __init__ or add_item; test_alpha should return; KeyError in HTMLParser") for i in range(6)] + [(9100, None)]
    kinds = [*rr.HINTS]
    runs = [(i, kinds[i % 5] or "OTHER", t, [f"src/module_{i % 3}.py", "a/x.py"], ["b/module_1.tar.gz", None] if i % 2 else None) for i, t in issues]
    got = {}
    for r in rr.target_hints(spark.createDataFrame(runs, "run_id long, deficiency string, issue string, edited array<string>, viewed array<string>")).orderBy("run_id", "place").collect():
        got.setdefault(r.run_id, []).append((r.kind, r.value))
    for i, kind, text, edited, viewed in runs:
        want, seen = [], set()
        found = [("file", re.sub(r"(?<=.)\.[^.]*$", "", p.rsplit("/", 1)[-1])) for p in [*edited, *(viewed or [])] if p]
        found += [(k, v) for k, p in rr.HINTS.get(kind, rr.HINTS[""]) for v in re.findall(p, text or "")]
        for k, v in found:
            if len(v) >= 4 and v.lower() not in rr.NO_HINTS and v not in seen:
                seen.add(v)
                want.append((k, v))
        assert got.get(i, []) == want[:40]
