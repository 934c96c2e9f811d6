"""How document filters interact: what each removes, repeats and alone decides, in every order.

One pass of a finite-state transducer over the UTF-8 bytes of a text measures it. The byte's
class and the state (inside a word or not) look up, in one table, what is emitted: a word that
begins or has ended, a capital, a code point, a symbol. The next state hangs on the byte alone, so a whole
slice of texts passes at once. The spans of words go into a hash table with open addressing;
each meets the span that holds its slot and is compared with it byte by byte, so distinct words
are counted exactly. The rest of the audit is grouping: rows become counts by part and set of
failed filters, and every order of the filters is read off from these counts.

Words are runs of characters other than ASCII white space, case-sensitive. Null text is empty.
Rows that repeat count each; a row with a null id repeats no other and has no label; of several
labels of one id a 1 counts. Other columns of docs are ignored, whatever their names. Very long
texts pass as slices of their own. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repairlens.llm import shared
from repairlens.llm import textops as T

#: Filters in the order of their bits: letter -> condition of failure over the measurements.
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 3 * n_points",
    "D": "n_symbols > 0",
    "E": "doc_id > first_id",
}

_SPACE, _CAPITAL, _SYMBOL, _PLAIN, _TAIL = range(5)
_WORD, _UPPER, _POINT, _SIGN, _STOP = 1, 2, 4, 8, 16


def _classes() -> np.ndarray:
    out = np.full(256, _PLAIN, np.uint8)
    out[list(b" \t\n\v\f\r")] = _SPACE
    out[65:91] = _CAPITAL
    out[list(b"#$%&*|")] = _SYMBOL
    out[0x80:0xC0] = _TAIL  # the second and later bytes of a code point
    return out


CLASS = _classes()
#: The state after a byte of each class: 1 inside a word.
NEXT = np.array([0, 1, 1, 1, 1], np.uint8)
#: What is emitted in state 0 and in state 1 on a byte of each class.
EMIT = np.array(
    [
        [_POINT, _WORD | _UPPER | _POINT, _WORD | _SIGN | _POINT, _WORD | _POINT, _WORD],
        [_STOP | _POINT, _UPPER | _POINT, _SIGN | _POINT, _POINT, 0],
    ],
    np.uint8,
)


def transduce(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what is emitted at each byte, the ends of texts that end inside a word); the state is 0 where a text begins."""
    kind = CLASS[data]
    after = NEXT[kind]
    state = np.zeros(len(data), np.uint8)
    state[1:] = after[:-1]
    state[offs[:-1][offs[:-1] < len(data)]] = 0
    ends = offs[1:][np.diff(offs) > 0]
    return EMIT[state, kind], ends[after[ends - 1] == 1]


def _per_text(places: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(places, offs))


def first_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each word is the one of its kind that its text's hash table keeps; equal hashes are verified on the bytes."""
    n = len(starts)
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), np.uint64, buffer=padded, strides=(1,))
    head = eight[starts] & T._MASK[np.minimum(size, 8)] if n else np.zeros(0, np.uint64)
    slots = 1 << max(4, (2 * n).bit_length())
    table = np.full(slots, -1, np.int64)
    at = (T.mix(hashes + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 5) & np.uint64(slots - 1)).astype(np.int64)
    kept, waiting = np.zeros(n, bool), np.arange(n)
    while len(waiting):
        free = waiting[table[at[waiting]] < 0]
        table[at[free]] = free  # of those that ask for one slot the last has it
        holder = table[at[waiting]]
        mine = holder == waiting
        kept[waiting[mine]] = True
        alike = (text[holder] == text[waiting]) & (size[holder] == size[waiting]) & (head[holder] == head[waiting])
        long = np.flatnonzero(alike & ~mine & (size[waiting] > 8))
        if len(long):
            a, b = holder[long], waiting[long]
            alike[long] = hashes[a] == hashes[b]
            long, a, b = (x[alike[long]] for x in (long, a, b))
            rest = size[a] - 8
            differs = data[T.ragged(starts[a] + 8, rest)] != data[T.ragged(starts[b] + 8, rest)]
            alike[long[np.unique(np.repeat(np.arange(len(a)), rest)[differs])]] = False
        waiting = waiting[~(mine | alike)]
        at[waiting] = (at[waiting] + 1) & (slots - 1)
    return kept


_MEASURES = "doc_id long, part string, n_words long, n_distinct long, n_capitals long, n_points long, n_symbols long, d1 long, d2 long"


def measures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, n_words, n_distinct, n_capitals, n_points, n_symbols, d1, d2) of docs (doc_id, text, and the column named by part); d1 and d2 are a 128-bit digest of the text."""

    def run(batches):
        for rows, data, offs in T.text_slices(batches, "text"):
            out, open_ends = transduce(data, offs)
            starts = np.flatnonzero(out & _WORD)
            ends = np.sort(np.concatenate([np.flatnonzero(out & _STOP), open_ends]))
            firsts = np.searchsorted(starts, offs)
            text = np.repeat(np.arange(len(rows)), np.diff(firsts))
            kept = first_spans(data, starts, ends, text, T.word_hashes(data, starts, ends)[0] if len(starts) else np.zeros(0, np.uint64))
            raw = memoryview(np.ascontiguousarray(data))
            digest = np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())), np.int64).reshape(-1, 2)
            tails = np.flatnonzero(CLASS[data] == _TAIL)
            counts = (np.diff(firsts), np.bincount(text[kept], minlength=len(rows)), _per_text(np.flatnonzero(out & _UPPER), offs), np.diff(offs) - _per_text(tails, offs), _per_text(np.flatnonzero(out & _SIGN), offs))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest[:, 0]), pa.array(digest[:, 1])],
                ["doc_id", "part", "n_words", "n_distinct", "n_capitals", "n_points", "n_symbols", "d1", "d2"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text").mapInArrow(run, _MEASURES)


def failures(measured: DataFrame) -> DataFrame:
    """(doc_id, part, failed): the bits of FILTERS of each measured row. A text's first_id is the least id of the rows that hold it."""
    copies = shared.written(measured.groupBy("d1", "d2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1"), "copies")
    known = shared.spread_join(measured, copies.drop("copies"), ["d1", "d2"], shared.frequent_keys(copies, ["d1", "d2"], "copies"), ["doc_id", "part"], "left")
    return known.select("doc_id", "part", sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(FILTERS.values())), F.lit(0)).cast("int").alias("failed"))


def counts_by_failures(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic): rows, rows of quality 1 and toxic rows by part and failed filters."""
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.expr("int(coalesce(quality = 1, false))")).alias("good"), F.max(F.expr("int(coalesce(toxic = 1, false))")).alias("toxic"))
    rows = failed.groupBy("doc_id", "part", "failed").agg(F.count("*").alias("n"))  # repeated rows meet before the join
    joined = shared.spread_join(rows, told, ["doc_id"], None, ["part", "failed"], "left")
    return joined.groupBy("part", "failed").agg(F.sum("n").alias("n"), F.sum(F.expr("n * coalesce(good, 0)")).alias("good"), F.sum(F.expr("n * coalesce(toxic, 0)")).alias("toxic"))


def audit(counted: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order of FILTERS and step.

    What a filter does hangs only on the set of filters before it. So counts are made for each
    filter and each such set, and the orders look theirs up: 600 rows, whatever the input.
    """
    letters = list(FILTERS)
    sets = [(1 << i, s) for i in range(len(letters)) for s in range(1 << len(letters)) if not s >> i & 1]
    spark = counted.sparkSession
    wide = counted.withColumn("at", F.explode(F.array(*(F.struct(F.lit(b).alias("bit"), F.lit(s).alias("before")) for b, s in sets)))).select("part", "failed", "n", "good", "toxic", "at.*")
    own, gone = F.expr("failed & bit <> 0"), F.expr("failed & before <> 0")
    total = lambda cond, value: F.sum(F.when(cond, F.col(value)).otherwise(0)).cast("long")
    steps = wide.groupBy("part", "bit", "before").agg(
        total(~own & ~gone, "n").alias("kept"),
        total(own & ~gone, "n").alias("removed"),
        total(own & gone, "n").alias("redundant"),
        total(F.expr("failed = bit"), "n").alias("unique_fails"),
        total(own & ~gone, "good").alias("good_lost"),
        total(own & ~gone, "toxic").alias("toxic_lost"),
    )
    places = [("".join(p), k + 1, 1 << letters.index(p[k]), sum(1 << letters.index(x) for x in p[:k])) for p in permutations(letters) for k in range(len(p))]
    orders = spark.createDataFrame(places, "filter_order string, step int, bit int, before int")
    weights = orders.groupBy("bit", "before").agg(F.count("*").alias("orders"))
    shares = steps.join(F.broadcast(weights), ["bit", "before"]).groupBy("part", "bit").agg(F.sum(F.expr("removed * orders")).cast("long").alias("shapley"))
    return (
        steps.join(shares.hint("merge"), ["part", "bit"])
        .join(F.broadcast(orders), ["bit", "before"])
        .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    )


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """audit() of docs (doc_id, text, and the column named by part) with labels (doc_id, quality, toxic)."""
    measured = shared.written(measures(docs, part), "measures")
    return audit(shared.written(counts_by_failures(failures(measured), labels), "counts"))
