"""Joins with lists of terms, whose size is counted before anything is broadcast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms shorter than this have no index entry of their own.
GRAM = 3
#: Up to so many terms are compared with every text: that costs less than its runs of letters.
FEW = 64


def join_list(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int = 100_000) -> DataFrame:
    """Equi-join with a list: broadcast up to so many rows, by sort and merge beyond."""
    small = right.limit(rows + 1).count() <= rows
    return left.join(F.broadcast(right) if small else right.hint("merge"), on, how)


def join_terms(left: DataFrame, terms: DataFrame, condition: Column, rows: int = 10_000) -> DataFrame:
    """Join of a stated list of terms with all rows on any condition, in blocks of about so many terms."""
    blocks = max(1, -(-terms.count() // rows))
    block = F.pmod(F.xxhash64(*terms.columns), F.lit(blocks))
    return reduce(DataFrame.unionByName, (left.join(F.broadcast(terms.where(block == i) if blocks > 1 else terms), condition) for i in range(blocks)))


def few(terms: DataFrame) -> bool:
    """Whether these are few enough to be compared with every text."""
    return terms.limit(FEW + 1).count() <= FEW


def with_list(left: DataFrame, terms: DataFrame, name: str) -> DataFrame:
    """left with all terms, counted as few, in an array column."""
    return left.crossJoin(F.broadcast(terms.agg(F.collect_list(F.struct(*terms.columns)).alias(name))))


def grams(text: Column) -> Column:
    """The distinct runs of three letters of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)(?=(.{3}))"), F.lit(1)))


def holding(left: DataFrame, text: Column, terms: DataFrame, term: str) -> DataFrame:
    """left without the texts that hold none of the terms, if these are a few; else left as it is. A filter before texts are cut into lines."""
    if not few(terms):
        return left
    return left.join(F.broadcast(terms), F.contains(text, F.col(term)), "left_semi")


def join_contains(left: DataFrame, text: Column, terms: DataFrame, term: str) -> DataFrame:
    """left joined with the terms (column ``term``) that its text holds: a few by comparison, more through an inverted index of runs of three letters.

    The terms are counted first. In the index each term is looked up under the rarest of its runs,
    counted over all texts, so a text meets only terms that share one; ``contains`` decides on
    these. Terms of one or two letters are compared with every text, in blocks.
    """
    if few(terms):
        return left.join(F.broadcast(terms), F.contains(text, F.col(term))).select(*left.columns, *terms.columns)
    short, long = terms.where(F.length(term) < GRAM), terms.where(F.length(term) >= GRAM)
    named = long.select(term).distinct().select(term, F.explode(grams(F.col(term))).alias("gram__"))
    held = left.select(F.explode(grams(text)).alias("gram__"))
    counted = join_list(held, named.select("gram__").distinct(), "gram__", "left_semi").groupBy("gram__").agg(F.count("*").alias("n__"))
    rare = named.join(counted.hint("merge"), "gram__").groupBy(term).agg(F.min_by("gram__", F.struct("n__", "gram__")).alias("gram__"), F.count("*").alias("known__"))
    whole = named.groupBy(term).agg(F.count("*").alias("all__"))  # a run that no text has: nor has any the term
    rare = rare.join(whole.hint("merge"), term).where("known__ = all__").drop("known__", "all__")
    entered = left.withColumn("gram__", F.explode(grams(text)))
    found = join_list(entered, long.join(rare.hint("merge"), term), "gram__").where(F.contains(text, F.col(term))).drop("gram__")
    brief = join_terms(left, short, F.contains(text, F.col(term)))
    return found.select(*left.columns, *terms.columns).unionByName(brief.select(*left.columns, *terms.columns))
