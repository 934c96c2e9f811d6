"""Streams over a folder give what the same rows give at once; late rows don't count."""

import json
import os

from repairlens.operators import witnesses as wt
from repairlens.streaming import logs as sl


def run(spark, df, name, mode, where):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{where}/{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    texts = ["FAILED tests/a.py::test_x - AssertionError: 1 != 2", "error: patch failed: a.py:3", "test result: FAILED. 3 passed; 2 failed"]
    rows = [{"run_id": i, "at": f"2024-01-01T00:{i:02}:00Z", "log_text": texts[i % 3]} for i in range(30)]
    for k in range(3):
        (folder / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows[10 * k : 10 * k + 10]))
    logs = sl.follow_logs(spark, str(folder), 1)
    batch = spark.createDataFrame([(r["run_id"], r["log_text"]) for r in rows], "run_id long, log_text string")
    assert sorted(map(repr, run(spark, sl.stream_witnesses(logs), "seen", "append", tmp_path).collect())) == sorted(map(repr, wt.build_witnesses(batch).collect()))
    counts = run(spark, sl.stage_counts(logs), "counts", "complete", tmp_path).collect()
    assert sum(r.n for r in counts) == 30 and len({r.start for r in counts}) == 3
    assert {r.stage for r in counts} == {"validation_failure", "patch_apply_failure"}


def test_late_rows_are_dropped(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, at in enumerate(["2024-01-01T05:00:00Z", "2024-01-01T05:01:00Z", "2024-01-01T01:00:00Z"]):
        (folder / f"{k}.json").write_text(json.dumps({"run_id": k, "at": at, "log_text": "timed out"}))
        os.utime(folder / f"{k}.json", (1_700_000_000 + 60 * k,) * 2)  # files are taken in order of their time
    counts = run(spark, sl.stage_counts(sl.follow_logs(spark, str(folder), 1)), "late", "update", tmp_path).collect()
    assert max(r.n for r in counts) == 2 and all(r.start.hour == 5 for r in counts)
