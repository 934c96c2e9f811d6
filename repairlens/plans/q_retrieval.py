"""Queries over candidates for further reading, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from repairlens.operators import conversations as cv
from repairlens.operators import patches as pt
from repairlens.operators import retrieval as rt
from repairlens.operators import source_tree as st
from repairlens.plans.fixtures import oracle, query


def _list(df, name, values):
    return df.sparkSession.range(1).select(F.explode(F.array(*(F.lit(v) for v in values))).alias(name))


def _classes(spans):
    word = F.element_at(F.array(*(F.lit(x) for x in ("RelatedFieldFilter", "RelatedListFilter", "OnlyField", "Widget", "ChoiceWidget"))), (F.col("start_line") % 5 + 1).cast("int"))
    classes = spans.where("kind = 'gold'").groupBy("path", word.alias("name")).agg(F.min("start_line").alias("start_line"), F.min("end_line").alias("end_line"))
    return rt.sibling_classes(classes, classes.where("name = 'RelatedFieldFilter'").select("path", "name"))


def _tests(spans):
    return spans.select("path", F.concat(F.lit("test_alpha_"), (F.col("start_line") % 30).cast("string")).alias("name")).distinct()


def _inspections(spans):
    part = lambda k, low: spans.where((F.col("kind") == k) & (F.col("start_line") > low)).select(F.col("instance_id").alias("run_id"), "path")
    return rt.required_inspections({"gold": part("gold", 80), "viewed": part("viewed", 70), "final": part("final", 60)}, ["gold", "viewed", "final"], 6)


def _routes(files):
    found = st.find_definitions(st.code_lines(files), _list(files, "target", ["f1", "f2", "f3"])).withColumnRenamed("target", "value")
    actions = files.select(F.col("path").alias("action_id"), F.when(F.length("path") % 2 == 0, "FIND_DEFINITION").otherwise("FIND_CALLEES").alias("action"), F.regexp_extract("path", r"(f\d+)\.py", 1).alias("value"))
    return rt.route_actions(actions, {"FIND_DEFINITION": found})


def _edits(part):
    k = F.col("p_partkey")
    n = (k % 3).cast("string")
    removed = F.concat(F.lit("a = old"), n, F.lit("(x)\n\nfrom collections.Iterable import y"), "p_brand")
    added = F.concat(F.lit("  a = new"), n, F.lit("(x)\nfrom collections.abc.Iterable import y"), "p_brand", F.lit("\nz = os.path.join"))
    return rt.repeated_edits(part.select((k % 50).alias("run_id"), F.concat(F.lit("m"), k.cast("string"), F.lit(".py")).alias("file"), removed.alias("removed"), added.alias("added")))


def _moved(files):
    old = files.select(F.col("path").alias("id"), F.col("path").alias("file"), F.posexplode(F.slice(F.split("content", "\n"), 1, 2)).alias("k", "text"))
    return pt.relocate_hunks(old, st.code_lines(files)).withColumn("start", F.col("start").cast("long"))


def _settings(orders):
    runs = orders.select(F.col("o_orderkey").alias("run_id"), F.create_map(F.lit("api_key"), "o_orderstatus", F.lit("model"), "o_orderpriority", F.lit("Auth_Token"), F.lit("t")).alias("settings"))
    return cv.redact_settings(runs).select("run_id", *(F.try_element_at("settings", F.lit(k)).alias(k.lower()) for k in ("api_key", "model", "Auth_Token")))


def _selected(spans):
    c = spans.where("kind <> 'gold'").select("instance_id", (F.col("start_line") * 100 + F.col("end_line")).cast("long").alias("ord"), "path", "start_line", "end_line", F.col("kind").alias("operation"), F.when(F.col("start_line") % 9 == 0, "rare").otherwise("plain").alias("relation"), ((F.col("start_line") % 13) / 13).alias("score"))
    return rt.select_evidence(c, ["rare"], 6, 20, 3)


def _rehydrated(spans, files):
    part = lambda k: spans.where(F.col("kind") == k).select("instance_id", F.concat(F.lit("src"), (F.col("start_line") % 3).cast("string"), F.lit("/f"), (F.col("start_line") % 3).cast("string"), F.lit(".py")).alias("path"), (F.col("end_line") - F.col("start_line")).cast("long").alias("start_line"), (F.col("end_line") - F.col("start_line") + 1).cast("long").alias("end_line"))
    words = spans.select("instance_id", F.element_at(F.array(F.lit("def"), F.lit("return"), F.lit("the")), (F.col("start_line") % 3 + 1).cast("int")).alias("word")).distinct()
    return rt.rehydrate_seen(part("viewed"), part("final").where("start_line > 2"), st.code_lines(files), words)


def _parallel(part):
    path = F.concat(F.lit("src/"), "p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".py"))
    files = part.select(F.col("p_size").alias("run_id"), path.alias("path"), "p_type")
    edited = files.groupBy("run_id").agg(F.min("path").alias("path"))
    hints = files.groupBy("run_id").agg(F.concat(F.lit("K."), F.min("p_type")).alias("hint"))
    siblings = edited.select("run_id", "path", F.lit("Other").alias("sibling"), ((60 + 5 * (F.col("run_id") % 6)) / 100).alias("score"))
    return rt.parallel_implementations(files, edited, files.select("path", F.concat(F.lit("C."), "p_type").alias("name")), hints, siblings)


def _symbols(spans):
    classes = spans.select("path", F.concat(F.lit("K"), (F.col("end_line") % 9).cast("string")).alias("name"), F.lit("class").alias("kind")).distinct()
    table = _tests(spans).withColumn("kind", F.lit("def")).unionByName(classes)
    return st.find_symbols(table, _list(spans, "hint", ["test_alpha_3", "pha_2", "none", "K4.run", "Z.run"]))


QUERIES = {
    "parallel_implementations": query(_parallel, "part"),
    "sibling_classes": query(_classes, "spans"),
    "failed_test_sites": query(lambda s: rt.failed_test_sites(_tests(s), _list(s, "failed", ["t.py::test_alpha_7[x]", "test_alpha_2", "alpha_1", "zzz"])), "spans"),
    "neighbor_tests": query(lambda s: rt.neighbor_tests(_tests(s), _list(s, "concept", ["alpha beta", "test alpha"])), "spans"),
    "find_symbols": query(_symbols, "spans"),
    "find_imports": query(lambda f: st.find_imports(st.code_lines(f.select("path", F.concat(F.lit("import m"), (F.length("content") % 5).cast("string"), F.lit(" as q\nfrom pkg import x\nimportant = m1\n")).alias("content"))), _list(f, "module", ["m1", "pkg"])), "repo_files"),
    "required_inspections": query(_inspections, "spans"),
    "required_searches": query(lambda i: rt.required_searches(i.select(F.col("instance_id").alias("run_id"), F.col("issue").alias("text")), ["the", "and"]), "issues"),
    "split_actions": query(lambda o: rt.split_actions(o.select(F.col("o_orderkey").alias("run_id"), F.expr("CASE o_orderkey % 2 WHEN 0 THEN array('SEARCH', 'STOP') ELSE array('ODD') END").alias("operations")), {"SEARCH": "retrieval", "STOP": "control"}), "orders"),
    "route_actions": query(_routes, "repo_files"),
    "repeated_edits": query(_edits, "part"),
    "relocate_hunks": query(_moved, "repo_files"),
    "redact_settings": query(_settings, "orders"),
    "select_evidence": query(_selected, "spans"),
    "rehydrate_seen": query(_rehydrated, "spans", "repo_files"),
    "rehydrate_seen_whole": query(_rehydrated, "spans", "repo_files"),
    "scope_constraints": query(lambda o: rt.scope_constraints(o.select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 8).alias("edited_files"), (F.col("o_orderkey") % 3).alias("unsupported_files"), (F.col("o_orderkey") % 5 == 0).alias("submitted_without_tests"), (F.col("o_orderkey") % 2).alias("patterns"))), "orders"),
    "witness_source_inventory": query(lambda o: rt.witness_source_inventory(o.select(F.col("o_orderkey").alias("run_id")), o.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("run_id"), F.concat(F.lit("s"), (F.col("o_orderkey") % 4).cast("string")).alias("name"), (F.col("o_orderkey") % 2).alias("bytes")), ["s2", "s1", "s0"]), "orders"),
}

_T = "t AS (SELECT DISTINCT path, 'test_alpha_' || (start_line % 30) AS name FROM spans)"
ORACLES = {
    "parallel_implementations": r"""WITH f AS (SELECT p_size AS run_id, 'src/' || p_brand || '/' AS folder, replace(p_name, ' ', '_') || '_' || p_partkey AS stem, p_type FROM part), g AS (SELECT *, folder || stem || '.py' AS path FROM f),
t AS (SELECT *, list_distinct(list_filter(string_split_regex(stem, '[_.-]'), lambda x: length(x) >= 3)) AS parts FROM g), e AS (SELECT run_id, min(path) AS path, lower(min(p_type)) AS tail FROM g GROUP BY 1),
w AS (SELECT e.run_id, e.path, e.tail, t.folder, t.parts FROM e JOIN t ON t.path = e.path),
c AS (SELECT w.run_id, t.path, t.stem AS symbol, len(list_intersect(t.parts, w.parts)) AS overlap, t.folder = w.folder AS near, length(w.tail) >= 4 AND lower(t.p_type) = w.tail AS held FROM t JOIN w ON t.path <> w.path),
a AS (SELECT run_id, path, symbol, 'parallel_implementation' AS relation, least(95, 55 + least(10 * overlap, 25) + CASE WHEN near THEN 5 ELSE 0 END + CASE WHEN held THEN 5 ELSE 0 END) / 100 AS score, CAST(overlap AS BIGINT) AS overlap FROM c WHERE overlap > 0
UNION ALL SELECT run_id, path, 'Other', 'sibling_class_same_file', (60 + 5 * (run_id % 6)) / 100, NULL FROM e)
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, relation DESC, overlap DESC, path, symbol) AS rank, path, symbol, relation, score, overlap FROM a QUALIFY rank <= 3""",
    "sibling_classes": oracle("spans", """w AS (SELECT path, (['RelatedFieldFilter', 'RelatedListFilter', 'OnlyField', 'Widget', 'ChoiceWidget'])[start_line % 5 + 1] AS name, start_line, end_line FROM spans WHERE kind = 'gold'),
c AS (SELECT path, name, min(start_line) AS s, min(end_line) AS e FROM w GROUP BY 1, 2), j AS (SELECT a.path, a.name, b.name AS sibling, least(abs(b.s - a.e), abs(a.s - b.e)) <= 60 AS near FROM c a JOIN c b ON a.path = b.path AND a.name = 'RelatedFieldFilter' AND b.name <> a.name)
SELECT path, name, sibling, (55 + CASE sibling WHEN 'RelatedListFilter' THEN 10 + 5 + 8 WHEN 'OnlyField' THEN 5 ELSE 0 END + CASE WHEN near THEN 3 ELSE 0 END) / 100 AS score FROM j"""),
    "failed_test_sites": oracle("spans", f"""{_T} SELECT 't.py::test_alpha_7[x]' AS failed, path, name, true AS exact FROM t WHERE name = 'test_alpha_7' UNION ALL SELECT 'test_alpha_2', path, name, true FROM t WHERE name = 'test_alpha_2' UNION ALL SELECT 'alpha_1', path, name, false FROM t WHERE contains(name, 'alpha_1')"""),
    "neighbor_tests": oracle("spans", f"""{_T}, h AS (SELECT c AS concept, path, name, CASE c WHEN 'alpha beta' THEN 1 ELSE 2 END AS n FROM t, (VALUES ('alpha beta'), ('test alpha')) v(c)) SELECT concept, path, name, CAST(n AS BIGINT) AS n FROM h QUALIFY row_number() OVER (PARTITION BY concept ORDER BY n DESC, path, name) <= 2"""),
    "find_symbols": oracle("spans", f"{_T} SELECT 'test_alpha_3' AS hint, path, name, CAST(0.92 AS DOUBLE) AS score FROM t WHERE name = 'test_alpha_3' UNION ALL SELECT 'pha_2', path, name, CAST(0.78 AS DOUBLE) FROM t WHERE contains(name, 'pha_2') UNION ALL SELECT 'K4.run', min(path), 'K4', CAST(0.70 AS DOUBLE) FROM spans WHERE end_line % 9 = 4 HAVING count(*) > 0"),
    "find_imports": oracle("repo_files", "SELECT 'pkg' AS module, path, 2 AS ln FROM repo_files UNION ALL SELECT 'm1', path, 1 FROM repo_files WHERE length(content) % 5 = 1"),
    "required_inspections": oracle("spans", """u AS (SELECT instance_id AS run_id, path, CASE kind WHEN 'gold' THEN 0 WHEN 'viewed' THEN 1 ELSE 2 END AS place, kind AS source FROM spans WHERE (kind = 'gold' AND start_line > 80) OR (kind = 'viewed' AND start_line > 70) OR (kind = 'final' AND start_line > 60)),
f AS (SELECT run_id, path, min(place) AS place, min_by(source, place) AS source FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY place, path) - 1 AS rank FROM f) SELECT run_id, rank, path, source FROM r WHERE rank < 6"""),
    "required_searches": oracle("issues", r"""w AS (SELECT instance_id AS run_id, regexp_extract_all(coalesce(issue, ''), '[A-Za-z_][A-Za-z0-9_]{2,}') AS w FROM issues), d AS (SELECT run_id, list_filter(w, lambda x, i: list_position(w, x) = i AND x NOT IN ('the', 'and'))[1:10] AS q FROM w) SELECT run_id, unnest(range(len(q))) AS rank, unnest(q) AS query FROM d"""),
    "split_actions": "SELECT o_orderkey AS run_id, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [0, 1] ELSE [0] END) AS pos, unnest(CASE WHEN o_orderkey % 2 = 0 THEN ['SEARCH', 'STOP'] ELSE ['ODD'] END) AS operation, unnest(CASE WHEN o_orderkey % 2 = 0 THEN ['retrieval', 'control'] ELSE ['unknown'] END) AS kind FROM orders",
    "route_actions": oracle("repo_files", r"""a AS (SELECT path, length(path) % 2 = 0 AS d, regexp_extract(path, '(f\d+)\.py', 1) AS v FROM repo_files)
SELECT path AS action_id, CASE WHEN d THEN 'FIND_DEFINITION' ELSE 'FIND_CALLEES' END AS action, CASE WHEN NOT d THEN 'UNSUPPORTED' WHEN v IN ('f1', 'f2', 'f3') THEN 'FOUND' ELSE 'NOT_FOUND' END AS status, CAST(d AND v IN ('f1', 'f2', 'f3') AS BIGINT) AS hits FROM a"""),
    "repeated_edits": "SELECT p_partkey % 50 AS run_id, b AS before, a AS after, count(*) AS n_files FROM part, (VALUES ('old', 'new'), ('', '.abc'), ('collections.Iterable', 'collections.abc.Iterable')) v(b, a) GROUP BY ALL HAVING count(*) > 1",
    "relocate_hunks": oracle("repo_files", "SELECT path AS id, path AS file, CAST(1 AS BIGINT) AS start FROM repo_files"),
    "rehydrate_seen": oracle("spans repo_files", r"""x AS (SELECT DISTINCT kind, instance_id, 'src' || (start_line % 3) || '/f' || (start_line % 3) || '.py' AS path, end_line - start_line AS a, end_line - start_line + 1 AS b FROM spans WHERE kind IN ('viewed', 'final')),
d AS (SELECT * FROM x v WHERE kind = 'viewed' AND NOT EXISTS (SELECT 1 FROM x f WHERE f.kind = 'final' AND f.a > 2 AND f.instance_id = v.instance_id AND f.path = v.path AND v.a <= f.b AND f.a <= v.b)),
l AS (SELECT path, unnest(range(1, len(t) + 1)) AS ln, unnest(t) AS text FROM (SELECT path, string_split(content, chr(10)) AS t FROM repo_files WHERE path IN ('src0/f0.py', 'src1/f1.py', 'src2/f2.py'))),
w AS (SELECT DISTINCT path, ln, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS word FROM l), k AS (SELECT DISTINCT instance_id, (['def', 'return', 'the'])[start_line % 3 + 1] AS word FROM spans),
h AS (SELECT d.instance_id, d.path, a AS start_line, b AS end_line, count(DISTINCT w.word) AS hits FROM d JOIN w ON w.path = d.path AND w.ln BETWEEN a AND b JOIN k ON k.instance_id = d.instance_id AND k.word = w.word GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY hits DESC, path, start_line, end_line) - 1 AS rank FROM h) SELECT instance_id, rank, path, start_line, end_line, hits FROM r WHERE rank < 4"""),
    "scope_constraints": """WITH r AS (SELECT o_orderkey AS k, list_filter([CASE WHEN o_orderkey % 8 >= 5 THEN 'cap_files' END, CASE WHEN o_orderkey % 3 > 0 THEN 'drop_unsupported' END, CASE WHEN o_orderkey % 5 = 0 THEN 'run_tests' END, CASE WHEN o_orderkey % 2 > 0 THEN 'no_repeated_edits' END], lambda x: x IS NOT NULL) AS c FROM orders),
u AS (SELECT k AS run_id, unnest(range(len(c))) AS pos, unnest(c) AS constraint_name FROM r) SELECT run_id, pos, constraint_name AS "constraint", CASE constraint_name WHEN 'no_repeated_edits' THEN 'medium' ELSE 'high' END AS severity FROM u""",
    "redact_settings": "SELECT o_orderkey AS run_id, '***' AS api_key, o_orderpriority AS model, '***' AS auth_token FROM orders",
    "witness_source_inventory": """WITH f AS (SELECT o_orderkey AS k, o_orderkey % 3 > 0 AND o_orderkey % 4 < 3 AS there, o_orderkey % 2 > 0 AS filled FROM orders)
SELECT k AS run_id, CASE WHEN there AND filled THEN 's' || (k % 4) END AS source, CASE WHEN there AND filled THEN 'found' WHEN there THEN 'empty' ELSE 'missing' END AS reason FROM f""",
}
ORACLES["rehydrate_seen_whole"] = ORACLES["rehydrate_seen"]  # an earlier name of the same query
