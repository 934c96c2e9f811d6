"""Index of letter runs, interval joins and sweeps, and JSON levels, against plain versions on random and odd rows."""

import json
import random

from pyspark.sql import functions as F

from repairlens.functions.joins import join_contains
from repairlens.operators import evaluation as ev
from repairlens.operators import guards as gd
from repairlens.operators import logs as lg
from repairlens.operators import source_tree as st

SPAN = "instance_id long, path string, start_line long, end_line long"


def test_terms_are_found_through_the_index(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc é\n") for _ in range(rng.randrange(30))) for _ in range(300)] + ["", None, "a" * 5000, "😀😀😀b"]
    terms = sorted({"".join(rng.choice("abc é\n") for _ in range(n)) for n in range(1, 7) for _ in range(12)} | {"zzz", "aaa", "😀😀b"})
    left = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    hits = join_contains(left, F.col("text"), spark.createDataFrame([(t,) for t in terms], "term string"), "term")
    assert sorted((r["id"], r["term"]) for r in hits.collect()) == sorted((i, t) for i, text in enumerate(texts) for t in terms if text and t in text)
    plan = join_contains(left, F.col("text"), spark.createDataFrame([("abcd",)], "term string"), "term")._jdf.queryExecution().optimizedPlan().toString()
    assert "contains" in plan.lower()


def seen_plainly(c, views, near):
    for v in views:
        same = c[0] == v[0] and c[1] and v[1] and (c[1].endswith(v[1]) or v[1].endswith(c[1]))
        if same and max(c[2], v[2]) - near <= min(c[3], v[3]) + near and c[2] - near <= c[3] + near and v[2] - near <= v[3] + near:
            return True
    return False


def test_seen_spans_equal_all_pairs(spark):
    rng = random.Random(4)
    paths = ["a.py", "ba.py", "src/a.py", "/t/src/a.py", "src/b.py", "lib/src/b.py", "", "c/", "x/ba.py"]
    span = lambda: (rng.randrange(2), rng.choice(paths), (s := rng.randrange(1, 1200)), s + rng.choice([-30, -3, 0, 5, 700]))
    cands, views = [span() for _ in range(150)], [span() for _ in range(25)] + [(1, "far.py", 1, 1_000_000)]
    got = st.mark_already_seen(spark.createDataFrame([*cands, cands[0]], SPAN), spark.createDataFrame(views, SPAN)).collect()
    assert sorted((*r[:4], r["seen"]) for r in got) == sorted((*c, seen_plainly(c, views, 5)) for c in [*cands, cands[0]])


def test_stretches_equal_lines(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(3), rng.choice(ev.KINDS + ["other"]), rng.choice("ab"), (s := rng.randrange(-2, 40)), s + rng.randrange(-2, 15)) for _ in range(200)]
    spans = spark.createDataFrame(rows, "instance_id long, kind string, path string, start_line long, end_line long")
    lines = {}
    for i, kind, path, a, b in rows:
        if a > 0 and kind in ev.KINDS:
            for ln in range(a, b + 1):
                lines.setdefault((i, path, ln), set()).add(kind)
    got = {}
    for r in ev.segments(spans).collect():
        assert r["n"] == r["end_line"] - r["start_line"] + 1 > 0
        for ln in range(r["start_line"], r["end_line"] + 1):
            assert (r["instance_id"], r["path"], ln) not in got
            got[r["instance_id"], r["path"], ln] = {k for k in ev.KINDS if r[k]}
    assert got == lines


def test_long_spans_cost_no_lines(spark):
    rows = [(1, "gold", "a", 1, 10**12), (1, "candidate", "a", 10**11, 10**12 + 5), (1, "viewed", "b", 1, 10**12)]
    m = ev.overlap_metrics(ev.segments(spark.createDataFrame(rows, "instance_id long, kind string, path string, start_line long, end_line long"))).first()
    assert (m["gold_lines"], m["line_inter"], m["cand_files"]) == (10**12, 9 * 10**11 + 1, 1)


def keys_of(node, at, bad, fine):
    inner = node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ()
    for k, v in inner:
        here = f"{at}[{k}]" if isinstance(node, list) else f"{at}.{k}" if at else str(k)
        if isinstance(node, dict) and k in bad:
            yield here, k
        if at or k not in fine:
            yield from keys_of(v, here, bad, fine)


def test_keys_at_any_depth_and_nothing_in_silence(spark):
    rng = random.Random(8)

    def grown(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice([1, "x", None, True])
        if rng.random() < 0.5:
            return [grown(depth - 1) for _ in range(rng.randrange(4))]
        return {k: grown(depth - 1) for k in rng.sample(["gold", "a", "free", "b c"], rng.randrange(4))}

    bodies = [json.dumps(grown(5)) for _ in range(60)]
    odd = {1000: None, 1001: "", 1002: "{", 1003: '{"a": 1, "a": 2}', 1004: "[" * 2000 + "]" * 2000, 1005: "[" * 12 + '{"gold": 1}' + "]" * 12}
    docs = spark.createDataFrame([*enumerate(bodies), *odd.items()], "id long, body string")
    rows = gd.nested_key_leaks(docs, ["gold"], ["free"], levels=10).collect()
    want = sorted((i, p, k) for i, b in enumerate(bodies) for p, k in keys_of(json.loads(b), "", {"gold"}, {"free"}))
    assert sorted((r["id"], r["path"], r["key"]) for r in rows if r["problem"] is None) == want
    assert sorted((r["id"], r["problem"]) for r in rows if r["problem"]) == [(1002, "no_json"), (1003, "no_json"), (1004, "no_json"), (1005, "too_deep")]
    deep = gd.nested_key_leaks(docs.where("id = 1005"), ["gold"], ["free"]).collect()
    assert [(r["key"], r["problem"]) for r in deep] == [("gold", None)]


def test_others_agree(spark):
    rows = [(1, "x", "a", "x_noop", False), (1, "y", "a", "full", False), (1, "z", "a", "full", None), (2, "x", "a", "x_noop", True), (2, "y", "b", "full", True), (3, "x", "a", "full", True), (3, "ignored", "a", "full", True), (4, "y", "b", None, False)]
    reports = spark.createDataFrame(rows, "instance_id long, baseline string, action string, packet_mode string, should_retry boolean")
    got = {(r["instance_id"], r["baseline"]): (r["others_silent"], r["abstain_correct"], r["false_intervention"]) for r in ev.abstain_checks(reports, ["x", "y", "z"]).collect()}
    assert got == {(1, "x"): (True, True, False), (1, "y"): (True, False, True), (1, "z"): (True, False, True), (2, "x"): (False, False, False), (2, "y"): (False, False, False), (3, "x"): (True, False, True), (4, "y"): (True, False, True)}


def test_frames_of_log_and_witness(spark):
    frame = "run_id long, pos int, file string, line int, function string"
    log = spark.createDataFrame([(1, 0, "/testbed/a.py", 3, "f"), (1, 1, "b.py", 4, "g"), (1, 2, "b.py", 4, "g")], frame)
    told = spark.createDataFrame([(1, 0, "a.py", 3, "f"), (1, 1, "/testbed/c.py", 1, "h"), (1, 2, "c.py", 1, "h"), (1, 3, "a.py", 9, "f"), (2, 0, "/testbed/d.py", 2, None)], frame)
    got = [tuple(r) for r in lg.fuse_frames(log, told).orderBy("run_id", "pos").collect()]
    assert got == [(1, 0, "/testbed/a.py", 3, "f", "log"), (1, 1, "b.py", 4, "g", "log"), (1, 2, "b.py", 4, "g", "log"), (1, 3, "c.py", 1, "h", "witness"), (1, 4, "a.py", 9, "f", "witness"), (2, 0, "d.py", 2, "", "witness")]
