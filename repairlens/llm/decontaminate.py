"""Benchmark decontamination by winnowing.

Of every ``width`` consecutive k-grams of a text the one with the least hash is kept, so a
span of ``k + width - 1`` words shared by a document and a benchmark item shares a kept
k-gram, wherever it stands. Documents and items are joined on the kept k-grams, and each
hit is extended: the item windows around it are compared by two independent 64-bit hashes.
A k-gram or window that many documents hold is dealt to several tasks.

Words: lower-cased ASCII letters, ASCII digits and every byte above ASCII. Null or empty
texts have no words. Repeated rows give a result each; rows with a null id do too; items with
a null id are left out. Other columns are ignored; empty tables give no rows or no hits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repairlens.llm import shared
from repairlens.llm import textops as T

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, id long, row long"


def _shingled(batch_iter, column: str):
    for rows, data, offs in T.text_slices(batch_iter, column):
        data = T.LOWER[data]
        starts, ends, firsts = T.word_spans(data, offs, T.ALNUM)
        yield rows, firsts, T.Grams(T.word_hashes(data, starts, ends, 2))


def item_windows(benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """(item, size, h1, h2, print): every window of each item, the whole item where it is shorter, and the k-grams winnowing keeps of it."""

    def run(batches):
        for rows, firsts, grams in _shingled(batches, "text"):
            ids = rows.column(0).to_pylist()
            counts = np.diff(firsts)
            size = np.minimum(counts, window)
            n = np.where(counts > 0, counts - size + 1, 0)
            starts, size = T.ragged(firsts[:-1], n), np.repeat(size, n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([str(i) for i, c in zip(ids, n) for _ in range(c)], pa.string()),
                    pa.array(size, pa.int32()),
                    pa.array(T.signed(grams.spans(starts, starts + size))),
                    pa.array(T.signed(grams.spans(starts, starts + size, 1))),
                    T.list_column(*_kept(grams, starts, size, window, k)),
                ],
                ["item", "size", "h1", "h2", "prints"],
            )

    return benchmark.where("item_id IS NOT NULL").select("item_id", "text").mapInArrow(run, "item string, size int, h1 long, h2 long, prints array<long>")


def _kept(grams: T.Grams, starts: np.ndarray, size: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-gram of least hash in each full window (all that tie); of a shorter item its only window."""
    full = size == window
    counts = np.where(full, window - k + 1, 1)
    at = T.ragged(starts, counts)
    hashes = grams.spans(at, at + np.repeat(np.where(full, k, size), counts))
    heads = np.cumsum(counts) - counts
    least = np.minimum.reduceat(hashes, heads) if len(heads) else hashes
    keep = hashes == np.repeat(least, counts)
    return T.signed(hashes[keep]), np.add.reduceat(keep.astype(np.int64), heads) if len(heads) else heads


class _Index:
    """Sorted kept k-grams and windows of the benchmark, as arrays."""

    def __init__(self, rows: pa.Table, window: int):
        self.window = window
        prints = rows["prints"].combine_chunks()
        lens = np.diff(prints.offsets.to_numpy())
        flat, size = prints.flatten().to_numpy().view(np.uint64), rows["size"].to_numpy()
        self.prints = {int(s): np.unique(flat[np.repeat(size == s, lens)]) for s in np.unique(size)}
        h1, h2 = (rows[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        order = np.lexsort((h2, h1))
        self.h1, self.h2, self.item = h1[order], h2[order], rows["item"].to_numpy(zero_copy_only=False)[order]


def _isin(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    bits = 20
    seen = np.zeros(1 << bits, bool)  # most k-grams are told apart by 20 bits of their hash
    seen[(sorted_values >> np.uint64(64 - bits)).astype(np.int64)] = True
    out = seen[(x >> np.uint64(64 - bits)).astype(np.int64)]
    some = np.flatnonzero(out)
    at = np.minimum(np.searchsorted(sorted_values, x[some]), len(sorted_values) - 1)
    out[some] = sorted_values[at] == x[some]
    return out


def _candidates(grams: T.Grams, firsts: np.ndarray, window: int, k: int, prints: dict) -> dict[int, np.ndarray]:
    """size -> places where a window of that size may begin, given the benchmark's kept k-grams of each size."""
    out = {}
    for size, known in prints.items():
        if size == window:
            width = window - k + 1
            hashes = grams.all(k)
            near = T.winnow(hashes, firsts, grams.n, k, width)
            near = near[_isin(known, hashes[near])]
            places = np.unique((near[:, None] - np.arange(width)[None, :]).ravel())
        else:
            places = np.flatnonzero(_isin(known, grams.all(size)))
        places = places[(places >= 0) & (places + size <= grams.n)]
        out[size] = places[T.text_of(firsts, places) == T.text_of(firsts, places + size - 1)]
    return out


def _result(rows, counts, where, sizes, texts, items) -> pa.RecordBatch:
    """One row a text from its hits: places of words, sizes of windows, texts and item ids, in parallel."""
    n = len(rows)
    hit, names = np.zeros(n, np.int64), [[] for _ in range(n)]
    if len(where):
        pos, size = np.unique(np.stack([where, sizes]), axis=1)
        covered = np.unique(T.ragged(pos, size))
        bounds = np.concatenate([[0], np.cumsum(counts)])
        hit = np.diff(np.searchsorted(covered, bounds))
        for t, item in sorted(set(zip(texts.tolist(), items))):
            names[t].append(item)
    return pa.RecordBatch.from_arrays(
        [
            rows.column(0),
            pa.array(counts, pa.int64()),
            pa.array(hit, pa.int64()),
            pa.array([len(x) for x in names], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
            pa.array(hit > 0),
            pa.array(names, pa.list_(pa.string())),
            rows.column(2),
            rows.column(3),
        ],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "id", "row"],
    )


def _hits(index: _Index, grams: T.Grams, firsts: np.ndarray, k: int):
    found = []
    for size, places in _candidates(grams, firsts, index.window, k, index.prints).items():
        h1, h2 = grams.spans(places, places + size), grams.spans(places, places + size, 1)
        lo, hi = np.searchsorted(index.h1, h1, "left"), np.searchsorted(index.h1, h1, "right")
        at, of = T.ragged(lo, hi - lo), np.repeat(np.arange(len(places)), hi - lo)
        same = index.h2[at] == h2[of]
        found.append((places[of[same]], np.full(int(same.sum()), size), index.item[at[same]]))
    where, sizes, items = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    return where, sizes, T.text_of(firsts, where), items


def judged(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, broadcast_windows: int = 500_000) -> DataFrame:
    """decontaminate() of keyed() docs, with their id and row."""
    windows = item_windows(benchmark, window, k)
    docs = docs.select("doc_id", "text", "id", "row")
    if not shared.fits(windows, broadcast_windows):
        return _joined(docs, shared.written(windows, "bench"), window, k)
    index = docs.sparkSession.sparkContext.broadcast(_Index(windows.toArrow(), window))

    def run(batches):
        for rows, firsts, grams in _shingled(batches, "text"):
            yield _result(rows, np.diff(firsts), *_hits(index.value, grams, firsts, k))

    return docs.mapInArrow(run, RESULT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, broadcast_windows: int = 500_000) -> DataFrame:
    """Per row of docs (doc_id, text): its words, those inside an occurrence of an item window, and the items.

    A benchmark of up to ``broadcast_windows`` windows (counted first) goes to every task; a
    larger one is joined on kept k-grams and on windows by shuffles.
    """
    return judged(shared.keyed(docs), benchmark, window, k, broadcast_windows).drop("id", "row")


def _joined(docs: DataFrame, windows: DataFrame, window: int, k: int) -> DataFrame:
    """The same by joins alone."""
    sizes = [r[0] for r in windows.select("size").distinct().collect()]  # 1 to window at most

    def prints(batches):
        for rows, firsts, grams in _shingled(batches, "text"):
            for size in sizes:
                if size == window:
                    hashes = grams.all(k)
                    at = T.winnow(hashes, firsts, grams.n, k, window - k + 1)
                else:
                    hashes = grams.all(size)
                    at = np.flatnonzero(T.within(firsts, grams.n, size))
                t = T.text_of(firsts, at)
                of = pa.array(t)
                yield pa.RecordBatch.from_arrays([rows.column(2).take(of), rows.column(3).take(of), pa.array(np.full(len(at), size), pa.int32()), pa.array((at - firsts[t]).astype(np.int32)), pa.array(T.signed(hashes[at]))], ["id", "row", "size", "pos", "print"])

    places = docs.mapInArrow(prints, "id long, row long, size int, pos int, print long")
    known = windows.select("size", F.explode("prints").alias("print")).distinct()
    known = places.groupBy("size", "print").agg(F.count("*").alias("places")).join(known.hint("merge"), ["size", "print"])
    known = shared.written(known, "prints")
    near = shared.spread_join(places, known.drop("places"), ["size", "print"], shared.frequent_keys(known, ["size", "print"], "places"), ["row", "pos"])
    near = near.groupBy("id", "row").agg(F.collect_set(F.struct("size", "pos")).alias("near"))

    def spans(batches):
        for rows, firsts, grams in _shingled(batches, "text"):
            near = rows.column(4).to_pylist()
            found = set()
            for t, pairs in enumerate(near):
                for pair in pairs:
                    back = window - k + 1 if pair["size"] == window else 1
                    found.update((t, pair["size"], pair["pos"] - b) for b in range(back) if pair["pos"] >= b and pair["pos"] - b + pair["size"] <= firsts[t + 1] - firsts[t])
            t, size, pos = np.array(sorted(found), np.int64).reshape(-1, 3).T
            at, of = firsts[t] + pos, pa.array(t)
            hashes = (pa.array(T.signed(grams.spans(at, at + size, kind))) for kind in (0, 1))
            yield pa.RecordBatch.from_arrays([rows.column(2).take(of), rows.column(3).take(of), pa.array(size, pa.int32()), pa.array(pos, pa.int32()), *hashes], ["id", "row", "size", "pos", "h1", "h2"])

    once = docs.join(near.hint("merge"), ["id", "row"]).select("doc_id", "text", "id", "row", "near").dropDuplicates(["id", "row"])
    asked = shared.written(once.mapInArrow(spans, "id long, row long, size int, pos int, h1 long, h2 long"), "asked")
    items = windows.select("size", "h1", "h2", "item").distinct().groupBy("size", "h1", "h2").agg(F.collect_list("item").alias("items"))
    places = asked.groupBy("size", "h1", "h2").agg(F.count("*").alias("places"))
    items = shared.written(items.join(places.hint("merge"), ["size", "h1", "h2"]), "items")
    hits = shared.spread_join(asked, items.drop("places"), ["size", "h1", "h2"], shared.frequent_keys(items, ["size", "h1", "h2"], "places"), ["row", "pos"])
    hits = hits.groupBy("id", "row").agg(F.collect_set(F.struct("pos", "size", "items")).alias("hits"))

    def total(batches):
        for rows, firsts, _ in _shingled(batches, "text"):
            hits = [(firsts[t] + h["pos"], h["size"], t, item) for t, x in enumerate(rows.column(4).to_pylist()) for h in x or () for item in h["items"]]
            where, size, t = np.array([h[:3] for h in hits], np.int64).reshape(-1, 3).T
            yield _result(rows, np.diff(firsts), where, size, t, [h[3] for h in hits])

    return docs.join(hits.hint("merge"), ["id", "row"], "left").select("doc_id", "text", "id", "row", "hits").mapInArrow(total, RESULT)
