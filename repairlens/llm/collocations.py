"""Phrase collocations by mergeable Misra-Gries summaries, then exact counts.

N-grams fall into hash partitions by the leading bits of a 64-bit hash. Tasks send, for each
partition, summaries of what they saw: keys (the next 32 bits) with counts, and how many n-grams
they stand for. A partition merges its summaries into one with more counters than the
partition's mass divided by the threshold: whenever more keys are held, the count just beyond
the capacity is taken off all of them. Each unit taken off costs more than capacity units of
mass, so less than the threshold is ever taken off one key, and every n-gram that is frequent
enough survives. Keys that meet only add up, so clashes of hashes never lose one.

Survivors are marked in a bitmap of fixed size over the leading bits of the hash. The second
pass counts, as strings and so exactly, the n-grams whose bit is set; all others are known to be
rare. N-grams of one word up to ``most_words`` are counted alike, so the parts of every frequent
phrase are there to score it.

ASCII letters are lower-cased. Pieces end at . , ; : ! ? and line ends; words are what spaces and
tabs separate in a piece. Everything is counted by language; a null one is ``und``, a null text is
empty. Repeated rows and rows with a null id count like others; other columns are ignored; an
empty table gives no rows. Any text is counted whole, also one longer than a task's buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repairlens.llm import shared
from repairlens.llm import textops as T

U = np.uint64
_CUT = T._byte_table(b".,;:!?\n\v\f\r")
_WORD = ~T._byte_table(b" \t") & ~_CUT
#: Bytes of text whose n-grams a task counts together before it sends them.
BUFFER = 8 << 20
#: N-grams that a partition of the summaries stands for, about.
MASS = 8_000_000
#: Bits of the bitmap that marks survivors; its size, 32 MB, doesn't grow with the corpus.
FILTER_BITS = 28
#: Entries in one row of a summary.
_ROW = 2_048


class _Buffer:
    """Words of several texts: their spans in ``data``, their languages, and how many words of their piece begin there."""

    def __init__(self, parts: list[tuple]):
        at, slices = 0, []
        for data, offs, lang in parts:
            slices.append((data, offs + at, lang))
            at += len(data)
        self.data = T.LOWER[np.concatenate([s[0] for s in slices])] if slices else np.zeros(0, np.uint8)
        offs = np.concatenate([*(s[1][:-1] for s in slices), [at]]).astype(np.int64)
        names = [x for s in slices for x in s[2]]
        self.names = sorted(set(names))
        index = {x: i for i, x in enumerate(self.names)}
        self.starts, self.ends, firsts = T.word_spans(self.data, offs, _WORD)
        n = len(self.starts)
        self.lang = np.repeat(np.array([index[x] for x in names], np.int64), np.diff(firsts))
        breaks = np.zeros(n + 1, bool)  # whether a piece begins at this word
        cuts = np.searchsorted(self.starts, np.flatnonzero(_CUT[self.data]))
        breaks[cuts] = True
        breaks[firsts] = True
        heads = np.flatnonzero(breaks)
        self.left = heads[np.searchsorted(heads, np.arange(n), "right")] - np.arange(n) if n else np.zeros(0, np.int64)

    def hashes(self, most_words: int, kinds: int) -> list[list[np.ndarray]]:
        """[size - 1][kind] -> hashes of the n-grams of that size that begin at each word, those that leave their piece too."""
        grams = T.Grams(T.word_hashes(self.data, self.starts, self.ends, kinds))
        salts = np.frombuffer(b"".join(_lang_hash(x) for x in self.names), U).reshape(-1, 2) if self.names else np.zeros((1, 2), U)
        return [[T.mix(h + salts[self.lang[: len(h)], kind], 9) for kind, h in enumerate(grams.all(size, kind) for kind in range(kinds))] for size in range(1, most_words + 1)]


def _lang_hash(name: str) -> bytes:
    import hashlib

    return hashlib.blake2b(name.encode(), digest_size=16).digest()


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[_Buffer]:
    parts, held = [], 0
    for rows, data, offs in T.text_slices(batches, "text", BUFFER):
        if held and held + len(data) > BUFFER:
            yield _Buffer(parts)
            parts, held = [], 0
        parts.append((data, offs, rows.column(0).to_pylist()))
        held += len(data)
    if parts:
        yield _Buffer(parts)


def _texts(docs: DataFrame, part: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(part).cast("string"), F.lit("und")).alias("lang"), "text").where("text <> ''")


def masses(docs: DataFrame, most_words: int = 3, part: str = "lang") -> DataFrame:
    """(lang, n, mass): words, and n-grams of one to ``most_words`` words within pieces."""

    def run(batches):
        for b in _buffers(batches):
            n = np.bincount(b.lang, minlength=len(b.names))
            mass = np.bincount(b.lang, weights=np.minimum(b.left, most_words), minlength=len(b.names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(b.names, pa.string()), pa.array(n, pa.int64()), pa.array(mass)], ["lang", "n", "mass"])

    return _texts(docs, part).mapInArrow(run, "lang string, n long, mass long").groupBy("lang").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass")).where("n > 0")


def summaries(docs: DataFrame, bits: int, most_words: int, part: str) -> DataFrame:
    """(p, mass, keys, counts): for each buffer and hash partition of 2 ** bits a row with the mass alone, then rows of little-endian keys (32 bits each, ascending) and counts."""

    def run(batches):
        for b in _buffers(batches):
            every = np.concatenate([h[0][b.left[: len(h[0])] >= size + 1] for size, h in enumerate(b.hashes(most_words, 1))])
            every.sort()
            new = np.ones(len(every), bool)
            new[1:] = every[1:] != every[:-1]
            at = np.flatnonzero(new)
            counts = np.diff(np.append(at, len(every))).astype(np.int32)
            keys = every[at]
            bounds = np.searchsorted(keys, np.arange(1 << bits, dtype=U) << U(64 - bits)) if bits else np.zeros(1, np.int64)
            bounds = np.append(bounds, len(keys))
            low = (keys >> U(32 - bits)).astype(np.uint32)  # the 32 bits below those of the partition
            mass = np.add.reduceat(np.append(counts, 0).astype(np.int64), bounds[:-1]) if len(counts) else np.zeros(1 << bits, np.int64)
            mass[np.diff(bounds) == 0] = 0
            some = np.flatnonzero(mass)
            yield _summary_rows(some, mass[some], [None] * len(some), [None] * len(some))
            rows = np.maximum(-(-np.diff(bounds)[some] // _ROW), 0)
            p = np.repeat(some, rows)
            starts = T.ragged(np.zeros(len(some), np.int64), rows) * _ROW + np.repeat(bounds[some], rows)
            stops = np.minimum(starts + _ROW, bounds[p + 1])
            yield _summary_rows(p, np.zeros(len(p), np.int64), [low[i:j].tobytes() for i, j in zip(starts, stops)], [counts[i:j].tobytes() for i, j in zip(starts, stops)])

    return _texts(docs, part).mapInArrow(run, "p int, mass long, keys binary, counts binary")


def _summary_rows(p, mass, keys, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(mass, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["p", "mass", "keys", "counts"])


class MisraGries:
    """A mergeable summary with ``capacity`` counters: no key loses more than mass / (capacity + 1)."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._waiting.append((keys, counts))
        self._held += len(keys)
        if self._held > max(self.capacity, 1 << 16):
            self.merge()

    def merge(self) -> None:
        """Adds up what waits; then, of more keys than counters, the count beyond the capacity is taken off all."""
        keys = np.concatenate([self.keys, *(k for k, _ in self._waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self._waiting)])
        self._waiting, self._held = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        keys, counts = keys[at], np.add.reduceat(counts, at) if len(at) else counts
        if len(keys) > self.capacity:
            off = np.partition(counts, len(counts) - 1 - self.capacity)[len(counts) - 1 - self.capacity]
            self.lost += int(off)
            keys, counts = keys[counts > off], counts[counts > off] - off
        self.keys, self.counts = keys, counts

    def survivors(self, threshold: int) -> np.ndarray:
        """Keys whose count may be the threshold or more."""
        self.merge()
        return self.keys[self.counts + self.lost >= threshold]


def survivors(sums: DataFrame, bits: int, parts: int, threshold: int, filter_bits: int) -> DataFrame:
    """(p, marks, n): for each hash partition its slice of the bitmap, and how many keys survive. Rows of a partition come together, those with masses first, so its capacity is known before any key."""
    width = filter_bits - bits

    def out(p, summary):
        marks = np.zeros(1 << width, bool)
        keys = summary.survivors(threshold)
        marks[keys >> np.uint32(32 - width)] = True
        return pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary()), pa.array([len(keys)], pa.int64())], ["p", "marks", "n"])

    def run(batches):
        at, mass, summary = None, 0, None
        for batch in batches:
            for p, m, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if p != at:
                    if summary:
                        yield out(at, summary)
                    at, mass, summary = p, 0, None
                if keys is None:
                    mass += m
                    continue
                summary = summary or MisraGries(mass // threshold + 1)
                summary.add(np.frombuffer(keys, np.uint32), np.frombuffer(counts, np.int32))
        if summary:
            yield out(at, summary)

    return sums.repartition(parts, "p").sortWithinPartitions("p", F.desc("mass")).mapInArrow(run, "p int, marks binary, n long")


def _phrases(b: _Buffer, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """The words from each place on, joined by one space."""
    word = T.ragged(at, size)
    last = np.zeros(len(word), bool)
    last[np.cumsum(size) - 1] = True
    width = b.ends[word] - b.starts[word] + ~last
    flat = np.append(b.data, np.uint8(32))[T.ragged(b.starts[word], width)]
    stops = np.cumsum(width)
    flat[stops[~last] - 1] = 32
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(np.append(0, stops[last]).astype(np.int32)), pa.py_buffer(flat)])


def exact_counts(docs: DataFrame, marks: np.ndarray, most_words: int, threshold: int, part: str, filter_bits: int) -> DataFrame:
    """(lang, words, phrase, f) of every n-gram that occurs ``threshold`` times or more; marks: the bitmap of those that may."""
    shipped = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches):
        known = shipped.value
        for b in _buffers(batches):
            at, size, h1, h2 = [], [], [], []
            for k, (first, second) in enumerate(b.hashes(most_words, 2)):
                place = first >> U(64 - filter_bits)
                some = np.flatnonzero((b.left[: len(first)] >= k + 1) & (known[place >> U(3)] >> (place & U(7)).astype(np.uint8) & 1 > 0))
                at.append(some)
                size.append(np.full(len(some), k + 1))
                h1.append(first[some])
                h2.append(second[some])
            at, size, h1, h2 = (np.concatenate(x) for x in (at, size, h1, h2))
            order = np.lexsort((h2, h1))
            new = np.ones(len(order), bool)
            new[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
            heads = np.flatnonzero(new)
            counts = np.diff(np.append(heads, len(order)))
            one = order[heads]
            for lo in range(0, len(one), 100_000):
                some = one[lo : lo + 100_000]
                names = pa.array(b.names, pa.string()).take(pa.array(b.lang[at[some]]))
                yield pa.RecordBatch.from_arrays([names, pa.array(size[some], pa.int32()), _phrases(b, at[some], size[some]), pa.array(counts[lo : lo + 100_000], pa.int64())], ["lang", "words", "phrase", "f"])

    found = _texts(docs, part).mapInArrow(run, "lang string, words int, phrase string, f long")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= threshold)


def frequent_ngrams(docs: DataFrame, most_words: int = 3, threshold: int = 10, part: str = "lang", mass_each: int = MASS, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of all n-grams with f >= threshold, and (lang, n) with the words of each language; both written to the shared folder."""
    spark = docs.sparkSession
    sizes = shared.written(masses(docs, most_words, part), "masses")
    total = sizes.agg(F.coalesce(F.sum("mass"), F.lit(0))).first()[0]
    parts = shared.partitions(spark, total, mass_each)
    bits = min((4 * parts - 1).bit_length(), filter_bits - 3)
    marks = np.zeros(1 << filter_bits - 3, np.uint8)
    each = len(marks) >> bits
    for row in survivors(summaries(docs, bits, most_words, part), bits, parts, threshold, filter_bits).toLocalIterator():
        marks[row["p"] * each : (row["p"] + 1) * each] = np.frombuffer(row["marks"], np.uint8)
    return shared.written(exact_counts(docs, marks, most_words, threshold, part, filter_bits), "ngrams"), sizes.select("lang", "n")


def _with_parts(cuts: DataFrame, ngrams: DataFrame, side: str, value: str) -> DataFrame:
    """cuts with the count of their part ``side``; a word in many phrases is dealt to several tasks."""
    often = cuts.groupBy("lang", side).agg(F.count("*").alias("cuts"))
    known = ngrams.select("lang", F.col("phrase").alias(side), F.col("f").alias(value))
    return shared.spread_join(cuts, known, ["lang", side], shared.frequent_keys(often, ["lang", side], "cuts"), ["phrase"])


def scored(ngrams: DataFrame) -> DataFrame:
    """(lang, words, phrase, a, l, r, score) of the phrases of two words and more, by their lowest-scoring cut, ties to the earliest."""
    held = ngrams.where("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = held.select("lang", "words", "phrase", F.col("f").alias("a"), "w", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "words", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("left"), F.expr("array_join(slice(w, k + 1, words - k), ' ')").alias("right"))
    cuts = shared.written(cuts, "cuts")
    both = _with_parts(shared.written(_with_parts(cuts, ngrams, "left", "l").drop("left"), "cuts"), ngrams, "right", "r").drop("right")
    exact = "(CAST(1000000 AS DECIMAL(7, 0)) * (CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0)))) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"
    best = both.withColumn("score", F.expr(exact).cast("long")).groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def independent(phrases: DataFrame, percent: int = 50) -> DataFrame:
    """phrases (lang, words, phrase, a) but for those inside a longer one that has at least so many percent of their count."""
    w = F.split("phrase", " ")
    inner = phrases.where("words > 2").select("lang", "a", "words", w.alias("w")).withColumn("size", F.explode(F.expr("sequence(2, words - 1)")))
    inner = inner.withColumn("at", F.explode(F.expr("sequence(1, words - size + 1)"))).select("lang", F.expr("array_join(slice(w, at, size), ' ')").alias("phrase"), "a")
    longest = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return phrases.join(longest.hint("merge"), ["lang", "phrase"], "left").where(F.expr(f"longer IS NULL OR 100 * longer < {percent} * a")).drop("longer")


def ranked(phrases: DataFrame, first: int = 2_000) -> DataFrame:
    """The first of each language by score, count and phrase, with their rank; chosen in two steps, so that no task sorts a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = phrases.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= first).drop("deal")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)


def collocations(docs: DataFrame, most_words: int = 3, threshold: int = 10, first: int = 2_000, part: str = "lang", mass_each: int = MASS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language of docs (text, and the column named by part)."""
    ngrams, sizes = frequent_ngrams(docs, most_words, threshold, part, mass_each, filter_bits)
    phrases = shared.written(independent(scored(ngrams)), "phrases")
    top = ranked(phrases, first)
    return top.join(sizes.hint("merge"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
