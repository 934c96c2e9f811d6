"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Each text is scanned once. The base kinds (assign, access, hex) always stay. Further
candidates, long mixed strings that no base span covers, count by how many distinct owners and
repositories hold them in the whole corpus: what more than ``most_owners`` owners or more than
``most_repositories`` repositories hold is a widely copied example; the rest looks like a live
credential of its owner and is added as kind ``owned``.

Places are code points, ends exclusive. Null text counts as empty; an empty table gives no rows.
Rows are told apart by id and text, null or not; a null source counts as an owner of its own for
each document, and as one repository. Equal rows get equal results; other columns are ignored,
and redact() keeps them. The work on a text grows with its length, times the logarithm of its
number of matches. A value that many rows hold is dealt to several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repairlens.llm import shared

#: Fixed patterns of the base kinds, in the order of their rank; group 0 is the span.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Further candidates: 20 characters or more with a digit, a capital and a small letter.
MIXED = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}"
KINDS = ["assign", "access", "hex", "owned"]
_SPANS = "array<struct<start:int,kind:int,end:int,value:string,low:int,high:int>>"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def running(values: Column, join) -> Column:
    """join(join(v0, v1), v2) ... up to each place of an array, by doubling: each step joins every value with the one 1, 2, 4, ... places before."""
    steps = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, k: Column) -> Column:
        by = F.pow(F.lit(2), k).cast("int")
        earlier = F.slice(F.concat(F.array_repeat(F.lit(None).cast("int"), by), acc), F.lit(1), F.size(acc))
        return F.zip_with(acc, earlier, lambda a, b: F.when(b.isNull(), a).otherwise(join(a, b)))

    return F.aggregate(steps, values, step)


def _matches(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost, non-overlapping matches whose group has so many characters; low and high are their places in bytes."""
    regex = F.lit(pattern)
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, regex, F.lit(0)).alias("all"), F.regexp_extract_all(text, regex, F.lit(group)).alias("value"))
    found = F.filter(found, lambda x: x["all"].isNotNull())  # the last gap has no match behind it

    def spans(x: Column) -> Column:
        upto = lambda size: running(F.transform(x, lambda m: size(m["gap"]) + size(m["all"])), lambda a, b: a + b)
        ends = F.struct(upto(F.length).alias("end"), upto(F.octet_length).alias("high"))

        def span(m: Column, i: Column, e: Column) -> Column:
            end, high = F.get(e["end"], i), F.get(e["high"], i)
            return F.struct((end - F.length(m["all"])).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m["value"].alias("value"), (high - F.octet_length(m["all"])).alias("low"), high.alias("high"))

        return _let(ends, lambda e: F.filter(F.transform(x, lambda m, i: span(m, i, e)), lambda s: F.length(s["value"]) >= least))

    return F.when(text.rlike(pattern), _let(found, spans).cast(_SPANS)).otherwise(F.array().cast(_SPANS))


def _apart(base: Column, more: Column) -> Column:
    """Those of ``more`` that overlap no span of ``base``."""
    ordered = F.array_sort(F.concat(base, more))

    def free(spans: Column) -> Column:
        before = running(F.transform(spans, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(0)), lambda a, b: F.greatest(a, b))
        first = lambda s: F.when(s["kind"] < 3, s["start"]).otherwise(1 << 30)
        after = F.reverse(running(F.transform(F.reverse(spans), first), lambda a, b: F.least(a, b)))
        both = F.struct(before.alias("before"), after.alias("after"))
        return _let(both, lambda e: F.filter(spans, lambda s, i: (s["kind"] == 3) & (F.get(e["before"], i) <= s["start"]) & (F.get(e["after"], i) >= s["end"])))

    return F.when((F.size(more) > 0) & (F.size(base) > 0), _let(ordered, free)).otherwise(more)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, id, row, owner, repository, base, more): spans of the base kinds, and further candidates outside them."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        *shared.row_key(),
        F.coalesce(F.split_part("source", F.lit("/"), F.lit(1)), F.concat(F.lit("?"), F.col("doc_id").cast("string")), F.lit("?")).alias("owner"),
        F.coalesce("source", F.lit("?")).alias("repository"),
        F.array_sort(F.concat(_matches(text, ASSIGN, 0, 1, 12), _matches(text, ACCESS, 1), _matches(text, HEX, 2))).alias("base"),
        _matches(text, MIXED, 3).alias("more"),
    )
    return rows.withColumn("more", _apart(F.col("base"), F.col("more")))


def ownership(scanned: DataFrame) -> DataFrame:
    """(hash, places, repositories, owners): how often, and in how many distinct ones, each candidate value occurs, over all rows."""
    each = scanned.where("size(base) + size(more) > 0").select("owner", "repository", F.explode(F.concat("base", "more")).alias("s"))
    once = each.groupBy(F.sha2("s.value", 256).alias("hash"), "repository", "owner").agg(F.count("*").alias("places"))
    owners = once.groupBy("hash", "owner").agg(F.sum("places").alias("places")).groupBy("hash").agg(F.sum("places").alias("places"), F.count("*").alias("owners"))
    repositories = once.groupBy("hash", "repository").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("repositories"))
    return owners.join(repositories.hint("merge"), "hash").select("hash", "places", "repositories", "owners")


def find_secrets(docs: DataFrame, most_owners: int = 2, most_repositories: int = 10) -> DataFrame:
    """(doc_id, id, row, base, spans, live): spans are the base ones and the owned; live counts those that few owners and repositories hold."""
    scanned = shared.written(scan(docs), "scanned")
    each = scanned.where("size(base) + size(more) > 0").select("id", "row", F.posexplode(F.concat("base", "more")).alias("i", "s"))
    each = each.select("id", "row", "i", F.struct(*(F.col(f"s.{c}") for c in ("start", "kind", "end", "low", "high"))).alias("s"), F.sha2("s.value", 256).alias("hash"))
    rare = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    owners = shared.written(ownership(scanned), "owners")
    judged = shared.spread_join(each, owners.drop("places"), ["hash"], shared.frequent_keys(owners, ["hash"], "places"), ["row", "i"]).groupBy("id", "row").agg(
        F.collect_set(F.when(rare & (F.col("s.kind") == 3), F.col("s"))).alias("owned"), F.collect_set(F.when(rare, F.struct("s.start", "s.kind"))).alias("live")
    )
    plain = lambda spans: F.transform(spans, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "kind", "end", "low", "high"))))
    joined = scanned.join(judged.hint("merge"), ["id", "row"], "left").withColumn("base", plain("base"))
    spans = F.when(F.size("owned") > 0, F.array_sort(F.concat("base", "owned"))).otherwise(F.col("base"))
    return joined.select("doc_id", "id", "row", "base", spans.alias("spans"), F.greatest(F.size("live"), F.lit(0)).alias("live"))


def _listed(spans: str) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"), F.col("live").cast("long").alias("n_live"))


def redact(docs: DataFrame, found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its text replaced by the mark; overlapping spans become one."""
    spans = found.where("size(spans) > 0").groupBy("id", "row").agg(F.first("spans").alias("spans"))

    def cut(raw: Column, of: Column) -> Column:
        ends = running(F.transform(of, lambda s: s["high"]), lambda a, b: F.greatest(a, b))

        def parts(e: Column) -> Column:
            def piece(s: Column, i: Column) -> Column:
                before = F.coalesce(F.get(e, i - 1), F.lit(0))
                gap = F.substring(raw, before + 1, s["low"] - before).cast("string")
                return F.when((i == 0) | (s["low"] >= before), F.concat(gap, F.lit(mark))).otherwise(F.lit(""))

            last = F.element_at(e, -1)
            return F.concat(F.array_join(F.transform(of, piece), ""), F.substring(raw, last + 1, F.octet_length(raw)).cast("string"))

        return _let(ends, parts)

    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *shared.row_key())
    joined = shared.sized_join(held, shared.written(spans, "spans"), ["id", "row"], "left", 50_000)
    clean = _let(F.encode("doc.text", "UTF-8"), lambda raw: cut(raw, F.col("spans")))
    text = F.when(F.col("spans").isNotNull(), clean).otherwise(F.col("doc.text"))
    return joined.select(*(text.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns))
