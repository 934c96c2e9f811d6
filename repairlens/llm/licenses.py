"""License scan: fixed phrases, and an exact set-similarity join of text blocks with notices. DataFrame functions only.

A block is 64 consecutive words, one every 32, so whatever spans 33 words or fewer lies in one
block whole. A block meets a template if it holds at least ``percent`` of the template's
distinct words. The join finds every such pair: words of templates are ordered by the number of
documents that hold them, rarest first. A pair that meets shares one of the first
``n - need + 1`` words of the template's n (prefix filter, on both sides), a block with fewer
than ``need`` words of the templates can't meet it (length filter), and neither can one where
too few words follow the first shared one on either side (positional filter). What passes is
compared on full sets. Only words of templates count for containment, so blocks carry no others;
documents without a rare word of a template have no blocks at all.

ASCII letters are lower-cased; words are runs of ASCII letters and digits and all beyond ASCII.
A null text is empty; an empty one has no words, no places and score 0. Rows are told apart by a
number of their own, so repeated and null ids are judged row by row; other columns are ignored,
whatever their names; an empty table gives no rows. Long texts are scanned whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repairlens.llm import shared

BLOCK = 64
PERCENT = 90
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose words stand consecutively, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices of 33 words at most, and their labels: (label, text).
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", 'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0-1.0", "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0-or-later", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def template_words(templates: list[tuple[str, str]] = TEMPLATES) -> list[tuple[str, list[str]]]:
    """(label, distinct words) of each template, in one task's plain Python: they are a parameter."""
    return [(label, list(dict.fromkeys(w for w in re.split(_GAP, text.lower()) if w))) for label, text in templates]


def words_of(text: Column) -> Column:
    """The words of a text with ASCII letters in lower case."""
    kelvin = F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Å"))  # the one sign beyond ASCII whose lower case is an ASCII letter
    return F.filter(F.split(F.lower(kelvin), _GAP), lambda w: w != "")


def word_order(docs: DataFrame, templates: list[tuple[str, list[str]]]) -> list[str]:
    """All words of the templates by the number of documents that hold them, ties by the word. One row for each comes to the driver."""
    vocabulary = sorted({w for _, words in templates for w in words})
    held = docs.select(F.explode(F.array_distinct(F.filter(words_of(F.col("text")), lambda w: w.isin(vocabulary)))).alias("word"))
    count = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def postings(spark, templates: list[tuple[str, list[str]]], order: list[str], percent: int) -> DataFrame:
    """(word, p, template, label, words, n, need): the prefix of each template in the given order; p counts from 0."""
    place, rows = {w: i for i, w in enumerate(order)}, []
    for number, (label, words) in enumerate(templates):
        words = sorted(words, key=place.__getitem__)
        need = -(-percent * len(words) // 100)
        rows += [(w, p, number, label, words, len(words), need) for p, w in enumerate(words[: len(words) - need + 1])]
    return spark.createDataFrame(rows, "word string, p int, template int, label string, words array<string>, n int, need int")


def _starts(words: Column, places: Column, phrase: str) -> Column:
    """The places from which the words of a phrase stand."""
    parts = phrase.split(" ")

    def here(p: Column) -> Column:
        cond = F.get(words, p) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            cond = cond & F.coalesce(F.get(words, p + k) == part, F.lit(False))
        return cond

    return F.filter(places, here)


def measures(docs: DataFrame, order: list[str], rare: list[str], least: int, phrases: dict[str, str] = PHRASES, block: int = BLOCK) -> DataFrame:
    """(at, doc_id, n_words, n_base, first_word, last_word, base_labels, blocks): a number of its own for each row, phrases, and the blocks around rare words as (block, words), words of templates alone and in the given order."""
    step = block // 2
    keys = sorted({*rare, *(p.split(" ")[0] for p in phrases)})
    rows = docs.select(F.monotonically_increasing_id().alias("at"), "doc_id", words_of(F.col("text")).alias("words"))
    rows = rows.withColumn("places", F.filter(F.transform("words", lambda w, i: F.when(w.isin(keys), i).otherwise(-1)), lambda i: i >= 0))
    rows = rows.select("*", *(_starts(F.col("words"), F.col("places"), p).alias(f"phrase{k}") for k, p in enumerate(phrases)))
    found = [F.col(f"phrase{k}") for k in range(len(phrases))]
    every = F.concat(*found)
    names = F.filter(F.array(*(F.when(F.size(f) > 0, F.lit(label)) for f, label in zip(found, phrases.values()))), lambda x: x.isNotNull())
    near = F.filter("places", lambda p: F.get("words", p).isin(rare))
    numbers = F.array_distinct(F.flatten(F.transform(near, lambda p: F.filter(F.array(F.floor(p / step).cast("int") - 1, F.floor(p / step).cast("int")), lambda b: b >= 0))))
    known = F.array(*(F.lit(w) for w in order))
    blocks = F.transform(numbers, lambda b: F.struct(b.alias("block"), F.array_intersect(known, F.slice("words", b * step + 1, F.lit(block))).alias("words")))
    return rows.select(
        "at",
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(names)).alias("base_labels"),
        F.filter(blocks, lambda b: F.size(b["words"]) >= least).alias("blocks"),
    )


def block_matches(blocks: DataFrame, posted: DataFrame) -> DataFrame:
    """(at, block, template, label, score) of every block (at, block, words) and template that meet, once; posted is broadcast: it grows with the templates alone."""
    words = blocks.withColumn("size", F.size("words")).select("at", "block", "size", F.col("words").alias("held"), F.posexplode("words").alias("q", "word"))
    pairs = words.join(F.broadcast(posted), "word")
    passing = (F.col("size") >= F.col("need")) & (F.col("q") <= F.col("size") - F.col("need")) & (F.least(F.col("n") - F.col("p"), F.col("size") - F.col("q")) >= F.col("need"))
    shared_words = pairs.where(passing).withColumn("both", F.array_intersect("words", "held"))
    met = (F.get("both", F.lit(0)) == F.col("word")) & (F.size("both") >= F.col("need"))  # counted at the first word that they share
    return shared_words.where(met).select("at", "block", "template", "label", (F.size("both") / F.col("n")).alias("score"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_base (places of phrases), first_word, last_word, base_labels, labels (those of templates too) and score.

    score is the largest share of a template that a block holds, of those with ``percent`` or
    more; 1 where a phrase stands, else 0.
    """
    spark, sets = docs.sparkSession, template_words(templates)
    docs = docs.select("doc_id", "text")
    order = word_order(docs, sets)
    posted = postings(spark, sets, order, percent)
    rare = sorted({r["word"] for r in posted.select("word").collect()})
    least = min(-(-percent * len(words) // 100) for _, words in sets)
    measured = shared.written(measures(docs, order, rare, least, phrases, block), "scanned")
    blocks = measured.select("at", F.explode("blocks").alias("b")).select("at", "b.block", "b.words")
    met = block_matches(blocks, posted).groupBy("at").agg(F.collect_set("label").alias("met"), F.max("score").alias("best"))
    full = shared.sized_join(measured.drop("blocks"), shared.written(met, "met"), ["at"], "left")
    return full.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", F.coalesce("met", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
