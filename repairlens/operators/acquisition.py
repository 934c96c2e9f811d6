"""Search actions carried out over source files: definitions, and tests ranked by how they bear on a target.

actions has (action_id, action, kind, value, module, budget): kind is SYMBOL, TYPE_NAME, FILE or
FAILURE_SITE (``path:line``), module a dotted hint or ''. files has (path, content). Hits are
found by the operators themselves, through the index of letter runs, and are never read ready-made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repairlens.functions.joins import few, holding, join_contains, join_list, with_list
from repairlens.functions.stored import checkpointed
from repairlens.functions.text import OTHER_END, let, lines_py
from repairlens.operators import source_tree as st

# Folders that are skipped, scores of the ways in which a test bears on a target, and what nearness adds.
SKIPPED = r"(^|/)\.|(^|/)(__pycache__|build|dist|\.tox|\.eggs|site-packages|node_modules)/"
BODY, IMPORTED, MIRRORED, MODULE, NAMED = 100, 80, 60, 50, 30
SAME_FOLDER, NEAR_FAILED = 30, 20
FILE_CHARS, TEST_CHARS, AROUND = 2_000, 1_500, 5
#: Failure sites up to this line are found in every file where it lies.
NEAR_LINES = 1_000
_HIT = ["action_id", "rank", "path", "start_line", "end_line", "symbol", "method"]


def _n_lines() -> Column:
    text = F.coalesce("content", F.lit(""))
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def is_test(path: Column) -> Column:
    low = F.lower(path)
    name = F.substring_index(low, "/", -1)
    return name.startswith("test_") | name.endswith("_test.py") | F.concat(F.lit("/"), low).rlike("/tests?/")


def _sources(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").endswith(".py") & ~F.col("path").rlike(SKIPPED))


def _first(hits: DataFrame, *order: Column) -> DataFrame:
    """The first hits of each action, as many as its budget; those of one action are dealt to 64 parts and cut there first."""
    rank = lambda *by: F.row_number().over(Window.partitionBy("action_id", *by).orderBy(*order))
    for by in ([F.pmod(F.xxhash64("path"), F.lit(64))], []):
        hits = hits.withColumn("rank", rank(*by)).where(F.col("rank") <= F.col("budget"))
    return hits


def _symbols(actions: DataFrame) -> DataFrame:
    """(action_id, budget, symbol) of what definitions are asked for."""
    last = F.element_at(F.split("value", r"\."), -1)
    return actions.where(F.col("kind").isin("SYMBOL", "TYPE_NAME")).select("action_id", "budget", last.alias("symbol")).where("symbol <> ''")


def _forms(actions: DataFrame) -> DataFrame:
    return _symbols(actions).select("symbol").distinct().select("symbol", F.explode(F.array(F.concat(F.lit("def "), "symbol", F.lit("(")), F.concat(F.lit("class "), "symbol"))).alias("form"))


def _sites(actions: DataFrame) -> DataFrame:
    """(action_id, path, line) of failure sites."""
    site = F.split("value", ":", 2)
    return actions.where("kind = 'FAILURE_SITE'").select("action_id", site[0].alias("path"), F.expr("try_cast(get(split(value, ':', 2), 1) AS INT)").alias("line")).where("line IS NOT NULL")


def _reach(sites: DataFrame) -> tuple[int | None, int]:
    """The last line asked for up to NEAR_LINES, and how many sites lie beyond."""
    near = F.col("line") <= NEAR_LINES
    return tuple(sites.agg(F.max(F.when(near, F.col("line"))), F.count(F.when(~near, 1))).first())


def _targets(actions: DataFrame) -> DataFrame:
    """(action_id, kind, value, budget, and the words of WAYS) of what tests are asked for."""
    stem = F.regexp_replace(F.substring_index("value", "/", -1), r"\.[^.]*$", "")
    symbol = F.when(F.col("kind") == "FILE", F.when(F.contains("value", F.lit("/")), stem).otherwise(F.replace("value", F.lit(".py"), F.lit("")))).otherwise(F.element_at(F.split("value", r"\."), -1))
    asked = actions.select("action_id", "kind", "value", "budget", symbol.alias("symbol"), F.coalesce("module", F.lit("")).alias("hint"))
    src = F.replace("symbol", F.lit("_test"), F.lit(""))
    return asked.withColumn("src", src).withColumn("src_module", src).withColumn("small", F.lower("symbol"))


def _words(asked: DataFrame, name: str) -> DataFrame:
    return asked.select(name).where(F.col(name) != "").distinct()


def _bodies(symbol: Column) -> Column:
    """The score of a text (content) that holds the symbol."""
    count = (F.length("content") - F.length(F.replace(F.col("content"), symbol, F.lit("")))) / F.length(symbol)
    return BODY + count.cast("int")


def _module(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "(^|/)test_([^/]*)$", "$1$2"), "/", ".")


#: The ways in which a test (path, low, test_module, content) bears on a word of the target: the column of the word, the text that must hold it, and the score, null for none.
WAYS = {
    "symbol": ("content", _bodies),
    "hint": ("content", lambda word: F.lit(IMPORTED)),
    "src": ("path", lambda word: F.when(F.startswith(F.col("path"), F.concat(F.lit("test_"), word)), MIRRORED)),
    "src_module": ("test_module", lambda word: F.when(F.startswith(F.col("test_module"), word), MODULE)),
    "small": ("low", lambda word: F.lit(NAMED)),
}


_WAY = "array<struct<way:string,word:string,score:int>>"


def text_facts(files: DataFrame, defined: DataFrame | None = None, related: DataFrame | None = None, until: int | None = None) -> DataFrame:
    """(path, source, test, ...): what actions ask of texts, from one pass over the files in which no text is shuffled or cut into lines.

    heads (symbol, ln): the first lines of the forms that ``defined`` seeks in a source; by_... (word, score), one for
    each of WAYS: what ``related`` seeks in a test. A column is missing where its words are more than
    FEW: these need the index. n_lines is the count of lines; n and defs are those of st.scanned, with ``until`` alone.
    """
    own = [(F.col("path").endswith(".py") & ~F.col("path").rlike(SKIPPED)).alias("source"), is_test(F.col("path")).alias("test")]
    named = [] if related is None else [F.lower("path").alias("low"), _module(F.col("path")).alias("test_module")]
    facts = files.select("path", F.coalesce("content", F.lit("")).alias("content"), *own, *named)
    text, added = F.col("content"), []

    def holds(name: str, words: DataFrame, when: str, held: str, body) -> None:
        nonlocal facts
        if few(words):
            facts = with_list(facts, words, f"{name}__")
            found = F.transform(F.filter(f"{name}__", lambda t: F.contains(held, t[words.columns[0]])), lambda t: body(t[words.columns[0]]))
            added.append(F.when(F.expr(when), found).alias(name))

    def head(symbol: Column) -> Column:  # the lines up to the first place of a form: its own is the last of them
        forms = (F.concat(F.lit("def "), symbol, F.lit("(")), F.concat(F.lit("class "), symbol))
        place = F.array_min(F.array(*(F.when(F.contains(text, f), F.position(f, text)) for f in forms)))
        return F.struct(symbol.alias("symbol"), let(place, lambda at: F.when(at.isNotNull(), F.size(lines_py(F.concat(F.left(text, at - 1), F.lit("x")))))).alias("ln"))

    if defined is not None:  # a form with a line end stands in no line
        holds("heads", _symbols(defined).select("symbol").distinct().where(~F.col("symbol").rlike(f"\n|{OTHER_END}")), "source", text, head)
    if related is not None:
        for way, (held, score) in WAYS.items():
            holds(f"by_{way}", _words(_targets(related), way), "source AND test", F.col(held), lambda word: F.struct(F.lit(way).alias("way"), word.alias("word"), score(word).alias("score")))
    facts = facts.select("path", "source", "test", *added, "content")
    return facts.withColumn("n_lines", _n_lines()).drop("content") if until is None else st.scanned(facts, until)


def symbol_definitions(files: DataFrame, actions: DataFrame, scan: int | None = None, facts: DataFrame | None = None) -> DataFrame:
    """Hits (action_id, rank, path, start_line, end_line, symbol, method): the first line of each file that has ``def name(`` or ``class name``, files in order of their paths.

    scan: only so many files, the first ones by path, are looked through for each unit of an
    action's budget; None looks through all. facts: those of text_facts, if there are any.
    """
    asked, forms = _symbols(actions), _forms(actions)
    if facts is not None and "heads" in facts.columns:
        found = facts.where("source").select("path", F.explode("heads").alias("h")).select("path", "h.symbol", "h.ln").where("ln IS NOT NULL")
    else:
        lines = st.code_lines(holding(_sources(files), F.col("content"), forms, "form"))
        found = join_contains(lines.where(F.contains("text", F.lit("def ")) | F.contains("text", F.lit("class "))), F.col("text"), forms, "form")
    if scan is not None:
        places = _sources(files).select("path").distinct().orderBy("path").limit(scan * (actions.agg(F.coalesce(F.max("budget"), F.lit(0))).first()[0])).withColumn("place", F.row_number().over(Window.orderBy("path")))
        found = found.join(places.hint("merge"), "path")
    else:
        found = found.withColumn("place", F.lit(0))
    first = found.groupBy("symbol", "path", "place").agg(F.min("ln").alias("start_line"))
    hits = join_list(first, asked, "symbol").where(F.col("place") <= F.col("budget") * (scan or 0))
    return _first(hits.select("*", F.col("start_line").alias("end_line"), F.lit("grep_symbol").alias("method")), F.col("path")).select(*_HIT)


def failure_sites(files: DataFrame, actions: DataFrame, facts: DataFrame | None = None, beyond: int = 0) -> DataFrame:
    """Hits of FAILURE_SITE actions: the smallest function or class around the line, else the lines around it; none where the file is missing or the line no number.

    Sites up to NEAR_LINES are found in every file where it lies. Only files with a site beyond are
    joined with their texts, by a shuffle if they are many. facts: those of text_facts with the reach of the
    sites, of which ``beyond`` lie further down.
    """
    asked = _sites(actions)
    if facts is None:
        until, beyond = _reach(asked)
        facts = text_facts(files, until=until or 0)
    known = asked.where(F.col("line") <= NEAR_LINES).join(facts.select("path", "n", "defs").hint("merge"), "path")
    if beyond:
        far = asked.where(F.col("line") > NEAR_LINES)
        size = F.size(F.split(F.regexp_replace(F.coalesce("content", F.lit("")), r"\n$", ""), "\n"))
        wanted = join_list(files.select("path", "content"), far.groupBy("path").agg(F.max("line").alias("until")), "path").select("path", "content", size.alias("n"), "until")
        known = known.unionByName(far.join(st.definitions_by(wanted).hint("merge"), "path"))
    inner = F.filter("defs", lambda d: F.col("line").between(d["start_line"], d["end_line"]))
    full = known.withColumn("d", F.array_min(F.transform(inner, lambda d: F.struct((d["end_line"] - d["start_line"]).alias("size"), d["start_line"].alias("start_line"), d["end_line"].alias("end_line"), d["name"].alias("name")))))
    idx = F.greatest(F.col("line") - 1, F.lit(0))
    return full.select(
        "action_id", F.lit(1).alias("rank"), "path", F.coalesce("d.start_line", F.greatest(idx - AROUND, F.lit(0)) + 1).alias("start_line"), F.coalesce("d.end_line", F.least("n", idx + AROUND)).alias("end_line"),
        F.coalesce("d.name", F.lit("")).alias("symbol"), F.when(F.col("d").isNotNull(), "ast_enclosing_node").otherwise("ast_fallback_lines").alias("method"),
    )


def named_files(files: DataFrame, actions: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Hits of FILE actions: the file itself."""
    asked = actions.where("kind = 'FILE'").select("action_id", F.col("value").alias("path"))
    sizes = files.select("path", _n_lines().alias("end_line")) if facts is None else facts.select("path", F.col("n_lines").alias("end_line"))
    found = join_list(sizes, asked, "path")
    return found.select("action_id", F.lit(1).alias("rank"), "path", F.lit(1).alias("start_line"), "end_line", F.lit("").alias("symbol"), F.lit("file_read").alias("method"))


def rank_tests(files: DataFrame, actions: DataFrame, failed: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(action_id, rank, path, score, symbol, end_line): test files by their best bearing on the target, ties by path.

    100 and the number of times that the symbol stands in the text; 80 if the text has the module
    hint; 60 and 50 if path or module begin like the symbol; 30 if the path has it somewhere. Tests
    in the target file's folder gain 30, tests beside a failed one (failed: name as path::test) 20.
    facts: those of text_facts, if there are any.
    """
    asked = _targets(actions)
    facts = checkpointed(text_facts(files, related=actions)) if facts is None else facts
    tests = facts.where("source AND test")
    texts = _sources(files).where(is_test(F.col("path"))).select("path", F.lower("path").alias("low"), _module(F.col("path")).alias("test_module"), F.coalesce("content", F.lit("")).alias("content"))
    every = tests.select("path", F.explode(F.concat(F.array().cast(_WAY), *(F.col(f"by_{way}") for way in WAYS if f"by_{way}" in facts.columns))).alias("w")).select("path", "w.*")
    for way, (held, score) in WAYS.items():
        if f"by_{way}" not in facts.columns:
            found = join_contains(texts, F.col(held), _words(asked, way), way)
            every = every.unionByName(found.select("path", F.lit(way).alias("way"), F.col(way).alias("word"), score(F.col(way)).alias("score")))
    seeks = asked.select("action_id", F.explode(F.create_map(*(c for way in WAYS for c in (F.lit(way), F.col(way))))).alias("way", "word"))
    every = every.where("score IS NOT NULL")
    best = join_list(every, seeks, ["way", "word"]).groupBy("action_id", "path").agg(F.max("score").alias("base"))
    near = failed.where(F.size(F.split("name", "::")) == 2).select(_folder(F.split("name", "::")[0]).alias("folder")).distinct().withColumn("near", F.lit(True))
    scored = join_list(join_list(best, asked, "action_id").withColumn("folder", _folder(F.col("path"))), near, "folder", "left")
    score = F.col("base") + F.when((F.col("kind") == "FILE") & (F.col("folder") == _folder(F.col("value"))), SAME_FOLDER).otherwise(0) + F.when(F.col("near"), NEAR_FAILED).otherwise(0)
    first = _first(scored.withColumn("score", score), F.desc("score"), F.col("path"))
    shown = F.when(F.col("base") >= BODY, F.col("symbol")).otherwise(F.regexp_replace(F.substring_index("path", "/", -1), r"\.py$", ""))
    return first.join(tests.select("path", F.col("n_lines").alias("end_line")).hint("merge"), "path").select("action_id", "rank", "path", "score", shown.alias("symbol"), "end_line")


def route_plan(actions: DataFrame, files: DataFrame, failed: DataFrame, scan: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, hits) of actions of mixed kinds, each carried out by the operator for it.

    results: (action_id, action, status, n_hits) with FOUND, NOT_FOUND, INVALID_TARGET (a failure
    site without a line) or UNSUPPORTED (another action, or a kind that FIND_DEFINITION doesn't
    take); hits: (action_id, rank, path, start_line, end_line, symbol, method).
    """
    defined, related = actions.where("action = 'FIND_DEFINITION'"), actions.where("action = 'FIND_RELATED_TESTS'")
    until, beyond = _reach(_sites(defined))
    facts = checkpointed(text_facts(files, defined, related, until or 0))  # read by all four operators
    hits = symbol_definitions(files, defined, scan, facts).unionByName(failure_sites(files, defined, facts, beyond)).unionByName(named_files(files, defined, facts))
    tests = rank_tests(files, related, failed, facts)
    hits = hits.unionByName(tests.select("action_id", "rank", "path", F.lit(1).alias("start_line"), "end_line", "symbol", F.lit("ranked_test_search").alias("method")))
    known = (F.col("action") == "FIND_RELATED_TESTS") | (F.col("action") == "FIND_DEFINITION") & F.col("kind").isin("SYMBOL", "TYPE_NAME", "FILE", "FAILURE_SITE")
    invalid = (F.col("action") == "FIND_DEFINITION") & (F.col("kind") == "FAILURE_SITE") & F.expr("try_cast(get(split(value, ':', 2), 1) AS INT) IS NULL")
    counted = actions.join(hits.groupBy("action_id").agg(F.count("*").alias("n")).hint("merge"), "action_id", "left")
    status = F.when(~known, "UNSUPPORTED").when(invalid, "INVALID_TARGET").when(F.col("n") > 0, "FOUND").otherwise("NOT_FOUND")
    return counted.select("action_id", "action", status.alias("status"), F.coalesce("n", F.lit(0).cast("long")).alias("n_hits")), hits
