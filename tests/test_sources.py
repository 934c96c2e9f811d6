"""Files in, tables out, and back."""

import json

from repairlens.operators import logs as lg
from repairlens.operators import planning as pl
from repairlens.sources import artifacts as src


def test_trajectories_are_tolerant(spark, tmp_path):
    (tmp_path / "a.traj.json").write_text(json.dumps({"messages": [{"role": "system", "content": "s", "odd": 1}, {"role": "assistant", "tool_calls": [{"id": "c", "function": {"name": "bash", "arguments": "{}"}}]}], "info": {"submission": "d"}}))
    (tmp_path / "b.traj.json").write_text(json.dumps({"info": {"exit_status": "Submitted", "model_stats": {"api_calls": 3}}}))
    messages, runs = src.read_trajectories(spark, str(tmp_path))
    assert [(r.run_id, r.step, r.role, r.content) for r in messages.orderBy("step").collect()] == [("a", 0, "system", "s"), ("a", 1, "assistant", None)]
    assert {r.run_id: (r.submission, r.api_calls) for r in runs.collect()} == {"a": ("d", None), "b": (None, 3)}


def test_text_snapshot_and_inventory(spark, tmp_path):
    root = tmp_path / "repo"
    for name in ("a.py", "pkg/b.py", ".git/c.py", "build/d.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x = 1\n")
    (root / "run1.log").write_bytes(b"ok \xff end")
    assert sorted(r.path for r in src.read_repo_snapshot(spark, str(root)).collect()) == ["a.py", "pkg/b.py"]
    assert [(r.run_id, r.text[:3]) for r in src.read_text_artifacts(spark, str(root / "*.log"), r"([^/]+)\.log$").collect()] == [("run1", "ok ")]
    assert {(r.category, r.bytes) for r in src.file_inventory(spark, str(root)).collect()} == {("source", 6), ("log", 8)}


def test_eval_records_and_matrix(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"instance_id": "i", "resolved": True}))
    (tmp_path / "many.json").write_text(json.dumps([{"instance_id": "i", "resolved": False}, {"instance_id": "j"}]))
    records = src.read_eval_records(spark, [("a", str(tmp_path / "one.json"), 1), ("b", str(tmp_path / "many.json"), 2)])
    assert sorted((r.instance_id, r.resolved, r.source) for r in records.collect() if r.resolved is not None) == [("i", False, "b"), ("i", True, "a")]
    out = str(tmp_path / "out")
    src.write_matrix(records, out, "json", "source")
    assert spark.read.json(out).count() == 3


def test_stages_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "error: patch failed: a"), (2, "test timed out")], "run_id long, log_text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = lg.failure_stage(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("stages").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.run_id: r.stage for r in spark.table("stages").collect()} == {1: "patch_apply_failure", 2: "timeout"}


def test_outputs_take_the_latest_free_test(spark):
    tests = spark.createDataFrame([(1, 1), (1, 2), (1, 9)], "run_id long, step long")
    outs = spark.createDataFrame([(1, 3), (1, 4), (1, 5), (1, 8)], "run_id long, step long")
    assert sorted((r.out_step, r.test_step) for r in pl.pair_test_runs(tests, outs).collect()) == [(3, 2), (4, 1)]


def test_plan_skips_what_does_not_fit(spark):
    c = [(1, 0, "low", 0.1, 1, 1, 1), (1, 1, "high", 0.1, 1, 2, 5), (1, 2, "high", 0.0, 1, 2, 1), (1, 3, "medium", 0.0, 1, 3, 1)]
    plan = pl.allocate_plan(spark.createDataFrame(c, "run_id long, ord long, confidence string, uncertainty double, n_clusters long, n_actions long, budget long"), 5, 6)
    assert {r.ord: (r.accepted, r.reason) for r in plan.collect()} == {2: (True, None), 1: (True, None), 3: (False, pl.OVER_ACTIONS), 0: (False, pl.OVER_RESULTS)}
