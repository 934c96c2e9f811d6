"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` measures every text once and stores, beside the measurements, one bit per failed
rule. ``verdict`` applies a named policy (a set of rules) to the bits without measuring
again; ``ablations`` says from the bits alone what each rule of a policy decides.

Words are runs of characters other than ASCII white space. Null text has no words. Rows that
repeat and rows with a null id are judged each for itself; other columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"[\x20\x09-\x0D]+"

#: Rules in the order of their bits: name -> condition of failure over the measurements.
RULES = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "v1": ["few_words", "repeated_words"],
    "v2": ["few_words", "repeated_words", "symbols", "repeated_lines"],
    "v3": list(RULES),
}
BASE = "v1"


def bits(names: list[str]) -> int:
    return sum(1 << i for i, name in enumerate(RULES) if name in names)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _doubled(hashes: Column, words: Column, step: int) -> Column:
    """Hashes of 2 * step words from those of step words; words: how many there are."""
    n = F.greatest(words - F.lit(2 * step - 1), F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column) -> Column:
    """Words inside 8-word windows that occur twice or more, from the windows' hashes in order."""

    def repeated(ordered: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(ordered, i)["h"] == x["h"], F.lit(False))
        return F.filter(ordered, lambda x, i: same(x, i - 1) | same(x, i + 1))

    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    places = _let(placed, lambda s: F.array_sort(F.transform(repeated(s), lambda x: x["i"])))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(places, start, lambda acc, i: F.struct((acc["n"] + (i + 8 - F.greatest(acc["end"], i))).alias("n"), (i + 8).alias("end")), lambda acc: acc["n"])


def ledger(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, the measurements and failed (bits of RULES)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("words", F.filter(F.split("text", _SPACE), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id",
        F.size("words").alias("count"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h1"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    for step in (1, 2, 4):
        rows = rows.withColumn(f"h{2 * step}", _doubled(F.col(f"h{step}"), F.col("count"), step))
    repeats = F.when(F.size(F.array_distinct("h8")) < F.size("h8"), _covered(F.col("h8"))).otherwise(F.lit(0).cast("long"))
    measured = rows.select(
        "doc_id",
        F.col("count").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
    )
    failed = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())), F.lit(0))
    return measured.withColumn("failed", failed.cast("int"))


def verdict(ledger: DataFrame, policy: str = "v2") -> DataFrame:
    """Adds base_failed and kept by the given policy."""
    return ledger.withColumns({"base_failed": F.col("failed").bitwiseAND(bits(POLICIES[BASE])) != 0, "kept": F.col("failed").bitwiseAND(bits(POLICIES[policy]) | bits(POLICIES[BASE])) == 0})


def ablations(ledger: DataFrame, policy: str = "v2") -> DataFrame:
    """(rule, n_failed, n_alone, n_kept_without): per rule of a policy the documents that fail it, that fail it alone, and that stay if it is left out."""
    mask = bits(POLICIES[policy])
    by_bits = ledger.groupBy(F.col("failed").bitwiseAND(mask).alias("b")).agg(F.count("*").alias("n"))  # 2 ** rules rows at most
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(bits([name])).alias("bit")) for name in POLICIES[policy]))
    wide = by_bits.select("b", "n", F.explode(rules).alias("r")).select("b", "n", "r.*")
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).alias
    return wide.groupBy("rule").agg(
        count(F.col("b").bitwiseAND(F.col("bit")) != 0)("n_failed"),
        count(F.col("b") == F.col("bit"))("n_alone"),
        count(F.col("b").bitwiseAND(F.bitwise_not("bit")) == 0)("n_kept_without"),
    )
