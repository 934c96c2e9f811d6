"""Substring dedup over a sparse de Bruijn graph of the corpus.

Nodes are token k-mers that winnowing selects (a repeated window of ``window`` words selects
the same ones wherever it stands). Edges are the word spans between neighbouring nodes of a
document. A node whose occurrences all have the same edge to the left (right) does not branch
there. Spark joins bring the degree of each node, and the least document it occurs in, to its
occurrences; runs of nodes that don't branch compact into paths whose occurrences run in
parallel, so the node that a window always selects tells the window's first source. Only
windows that reach over a branching node are compared by their own 128-bit hashes, at their
coordinates. Nodes and edges have independent hashes, so two nodes or windows are taken for
equal only if 128 bits agree; with 1e13 different windows a false one is to be expected with
a probability of 1.5e-13. A frequent node or window is dealt to several tasks.

A word is removed if a window over it also starts in a document of smaller id, judged on the
input. Null or empty text has no words. Rows with a null id are never a source and lose
nothing. Rows that repeat an id count as one document. Other columns are ignored; an empty
table gives no rows; a text of any length is worked on in one piece, in its own slice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repairlens.llm import shared
from repairlens.llm import textops as T

_LEFT, _RIGHT = 11, 12  # salts that tell edges to a text's begin and end from others


def _graph(rows_iter, window: int, k: int):
    for rows, data, offs in T.text_slices(rows_iter, "text"):
        starts, ends, firsts = T.word_spans(data, offs, T.NON_SPACE)
        grams = T.Grams(T.word_hashes(data, starts, ends, 2))
        nodes = T.winnow(grams.all(k), firsts, grams.n, k, window - k + 1)
        yield rows, firsts, grams, nodes, T.text_of(firsts, nodes)


def nodes(docs: DataFrame, window: int = 50, k: int = 25) -> DataFrame:
    """(doc_id, row, pos, node, before, after): each selected k-mer of keyed() docs with its edges in both directions."""

    def run(batches):
        for rows, firsts, grams, at, text in _graph(batches, window, k):
            if not len(at):
                continue
            head = np.concatenate([[True], text[1:] != text[:-1]])
            tail = np.concatenate([head[1:], [True]])
            left = np.where(head, firsts[text], np.concatenate([[0], at[:-1]]))
            right = np.where(tail, firsts[text + 1], np.concatenate([at[1:], [0]]) + k)
            before, after = grams.spans(left, at + k, 1), grams.spans(at, right, 1)
            before[head], after[tail] = T.mix(before[head], _LEFT), T.mix(after[tail], _RIGHT)
            t = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(t), rows.column(2).take(t), pa.array((at - firsts[text]).astype(np.int32)), *(pa.array(T.signed(x)) for x in (grams.spans(at, at + k), before, after))],
                ["doc_id", "row", "pos", "node", "before", "after"],
            )

    return docs.select("doc_id", "text", "row").mapInArrow(run, "doc_id long, row long, pos int, node long, before long, after long")


def repeated_nodes(found: DataFrame) -> DataFrame:
    """(node, places, first_doc, one_before, one_after) of nodes that occur in two documents or more."""
    low_high = [f(c).alias(f"{n}_{c}") for c in ("doc_id", "before", "after") for n, f in (("lo", F.min), ("hi", F.max))]
    return (
        found.where("doc_id IS NOT NULL")
        .groupBy("node")
        .agg(*low_high, F.count("*").alias("places"))
        .where("lo_doc_id < hi_doc_id")
        .select("node", "places", F.col("lo_doc_id").alias("first_doc"), F.expr("lo_before = hi_before").alias("one_before"), F.expr("lo_after = hi_after").alias("one_after"))
    )


def _first_equal(values: np.ndarray, wanted: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each start the first place from there on that holds the wanted value; there is one."""
    out = start.copy()
    todo = np.flatnonzero(values[out] != wanted)
    while len(todo):
        out[todo] += 1
        todo = todo[values[out[todo]] != wanted[todo]]
    return out


def _judged(docs_with_nodes: DataFrame, window: int, k: int) -> DataFrame:
    """Per row: places of windows known to repeat an earlier document, and places and hashes of windows still to compare."""

    def run(batches):
        for rows, firsts, grams, at, text in _graph(batches, window, k):
            known = rows.column(3)
            lens = np.diff(known.offsets.to_numpy())
            flat = known.flatten()
            pos, first, one_b, one_a = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            of = np.repeat(np.arange(len(rows)), lens)
            slot = np.searchsorted(at, firsts[of] + pos)
            repeated, first_doc = np.zeros(len(at), bool), np.zeros(len(at), np.int64)
            before_ok, after_ok = np.zeros(len(at), bool), np.zeros(len(at), bool)
            repeated[slot], first_doc[slot], before_ok[slot], after_ok[slot] = True, first, one_b, one_a
            hashes = grams.all(k)
            least = T.sliding(hashes, window - k + 1, np.minimum)
            w = np.flatnonzero(T.within(firsts, grams.n, window))
            i, j = np.searchsorted(at, w), np.searchsorted(at, w + window - k, "right") - 1
            core = _first_equal(hashes[at], least[w], i)  # the node that every occurrence of the window selects
            some = repeated[core]
            w, i, j, core = w[some], i[some], j[some], core[some]
            odd_before, odd_after = (np.concatenate([[0], np.cumsum(~x)]) for x in (before_ok, after_ok))
            left = odd_before[core + 1] - odd_before[i + (at[i] == w)] <= 0
            right = odd_after[j + (at[j] != w + window - k)] - odd_after[core] <= 0
            sure = left & right
            doc = rows.column(0).to_numpy(zero_copy_only=False)
            t = T.text_of(firsts, w)
            hit = sure & (first_doc[core] < doc[t])
            ask = ~sure
            count = lambda m, t=t, n=len(rows): np.bincount(t[m], minlength=n)
            local = (w - firsts[t]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    rows.column(2),
                    T.list_column(local[hit], count(hit)),
                    T.list_column(local[ask], count(ask)),
                    T.list_column(T.signed(grams.spans(w[ask], w[ask] + window)), count(ask)),
                    T.list_column(T.signed(grams.spans(w[ask], w[ask] + window, 1)), count(ask)),
                ],
                ["doc_id", "row", "hit", "ask", "h1", "h2"],
            )

    return docs_with_nodes.mapInArrow(run, "doc_id long, row long, hit array<int>, ask array<int>, h1 array<long>, h2 array<long>")


def remove_repeats(docs: DataFrame, window: int = 50, k: int = 25) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256 and kept (the words left, joined by spaces)."""
    docs = shared.keyed(docs).select("doc_id", "text", "row")
    found = nodes(docs, window, k)
    places = found.where("doc_id IS NOT NULL").select("doc_id", "row", "pos", "node")
    repeated = shared.written(repeated_nodes(found), "nodes")
    occurrences = shared.spread_join(places, repeated.drop("places"), ["node"], shared.frequent_keys(repeated, ["node"], "places"), ["row", "pos"])
    per_row = occurrences.groupBy("doc_id", "row").agg(F.collect_set(F.struct("pos", "first_doc", "one_before", "one_after")).alias("known"))
    judged = shared.written(_judged(docs.join(per_row.hint("merge"), ["doc_id", "row"]).select("doc_id", "text", "row", "known"), window, k), "judged")
    asked = judged.where("size(ask) > 0").select("doc_id", "row", F.explode(F.arrays_zip("ask", "h1", "h2")).alias("x")).select("doc_id", "row", "x.*")
    firsts = asked.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("places")).where("first_doc < last_doc").drop("last_doc")
    firsts = shared.written(firsts, "windows")
    more = shared.spread_join(asked, firsts.drop("places"), ["h1", "h2"], shared.frequent_keys(firsts, ["h1", "h2"], "places"), ["row", "ask"]).where("first_doc < doc_id").groupBy("doc_id", "row").agg(F.collect_set("ask").alias("hit"))
    sure = judged.where("size(hit) > 0").select("doc_id", "row", "hit")
    starts = sure.unionByName(more).groupBy("doc_id", "row").agg(F.flatten(F.collect_list("hit")).alias("starts"))

    def cut(batches):
        for rows, data, offs in T.text_slices(batches, "text"):
            begin, end, firsts = T.word_spans(data, offs, T.NON_SPACE)
            raw, starts = data.tobytes(), rows.column(3)
            kept, removed = [], np.zeros(len(rows), np.int64)
            for t in range(len(rows)):
                words = raw[offs[t] : offs[t + 1]].split()
                if starts[t].is_valid:
                    gone = np.zeros(len(words) + 1, np.int64)
                    at = np.unique(np.asarray(starts[t].values))
                    gone[at] += 1
                    gone[at + window] -= 1
                    stay = np.cumsum(gone[:-1]) == 0
                    removed[t] = len(words) - int(stay.sum())
                    words = [words[i] for i in np.flatnonzero(stay)]
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.diff(firsts)), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return docs.join(starts.hint("merge"), ["doc_id", "row"], "left").select("doc_id", "text", "row", "starts").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
