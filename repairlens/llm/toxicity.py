"""Toxicity by cumulative-link ordinal regression over sparse word features.

P(grade > k) = sigmoid(w.x - t_k) with one weight vector for all ordered thresholds t_k; x has
a one for each word, and each beginning of a word of 4 or 6 bytes, that a text holds. The expected severity is the sum of these
probabilities over k. Labels say only whether a text is toxic, so grades are derived for
fitting: 0 for clean texts, and for toxic ones 1, 2 or 3 by how many of the features that
tell toxic from clean texts they hold (1, 2 to 3, more).

The model is fitted on at most ``sample`` labelled rows (those of least hash), with an L1
penalty that leaves few weights. Every row of docs is scored on its whole text. Null or empty
text has no words and scores as the thresholds alone say. Rows with a null id are scored but
not sampled; of rows that repeat a sampled id the text of least hash is taken, and of repeated
labels the larger; equal rows get equal scores. Other columns are ignored; an empty table gives
no rows; without labels every row scores the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repairlens.llm import shared
from repairlens.llm import textops as T

BITS = 18
GRADES = 4
GAP = 0.05
PREFIXES = (4, 6)


def _features(batches):
    """(rows, features of the words, where each text's begin): each word, and its first 4 and 6 bytes where it is longer."""
    for rows, data, offs in T.text_slices(batches, "text"):
        data = T.LOWER[data]
        starts, ends, firsts = T.word_spans(data, offs, T.ALNUM)
        kinds = T.word_hashes(data, starts, ends)
        for size in PREFIXES:
            (cut,) = T.word_hashes(data, starts, np.minimum(starts + size, ends))
            kinds.append(np.where(ends - starts > size, T.mix(cut, size), kinds[0]))
        yield rows, (np.stack(kinds, axis=1).ravel() >> np.uint64(64 - BITS)).astype(np.int64), firsts * len(kinds)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(toxic per row, features one after another, where each row's begin) of at most so many rows."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    likely = known.where(shared.place("doc_id") < shared.share_of(sample, known.count()))  # else every task would send its own ``sample`` rows to be ranked
    chosen = likely.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for rows, feature, firsts in _features(batches):
            own = [np.unique(feature[a:b]) for a, b in zip(firsts, firsts[1:])]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), T.list_column(np.concatenate(own) if own else feature, [len(x) for x in own], pa.int32())], ["doc_id", "toxic", "features"])

    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"), F.max("toxic").cast("int").alias("toxic")).select("doc_id", "one.text", "toxic")
    got = rows.mapInArrow(run, "doc_id long, toxic int, features array<int>").toArrow()
    got = got.take(pa.array(np.argsort(got["doc_id"].to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")))
    lists = got["features"].combine_chunks()
    return got["toxic"].to_numpy() > 0, lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])


def grades(toxic: np.ndarray, features: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """0 for clean rows, 1 to 3 for toxic ones by their number of telling words."""
    row = np.repeat(np.arange(len(toxic)), np.diff(offs))
    size = 1 << BITS
    bad, all_ = np.bincount(features[toxic[row]], minlength=size), np.bincount(features, minlength=size)
    n_bad, n = max(1, int(toxic.sum())), len(toxic)
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((all_ - bad + 0.5) / max(1, n - n_bad + 1))
    telling = (bad >= 3) & (odds > 1.5)
    held = np.bincount(row[telling[features]], minlength=n)
    return np.where(toxic, 1 + (held >= 2) + (held >= 4), 0)


class Model:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, cut: float = 0.5):
        self.weights, self.thresholds, self.cut = weights.astype(np.float32), thresholds, cut

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) in a column for each k."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))

    def score(self, features: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        weight = self.weights[features]
        some = weight != 0
        pairs = np.unique(row[some] << BITS | features[some])  # each word counts once
        return np.bincount(pairs >> BITS, self.weights[pairs & (1 << BITS) - 1], n)


def fit(grade: np.ndarray, features: np.ndarray, offs: np.ndarray, l1: float = 0.016, steps: int = 250) -> Model:
    """Adaptive proximal gradient on the mean negative log likelihood with an L1 penalty on the weights; the penalty falls with the root of the rows."""
    n, size = len(grade), 1 << BITS
    l1 /= np.sqrt(max(n, 1))
    row = np.repeat(np.arange(n), np.diff(offs))
    df = np.bincount(features, minlength=size)
    keep = df[features] >= 3
    features, row = features[keep], row[keep]
    used, col = np.unique(features, return_inverse=True)
    w, theta = np.zeros(len(used)), np.array([np.log((np.sum(grade <= k) + 1) / (np.sum(grade > k) + 1)) for k in range(GRADES - 1)])
    theta = np.maximum.accumulate(theta - np.arange(GRADES - 1) * GAP) + np.arange(GRADES - 1) * GAP
    model = lambda: Model(np.bincount(used, w, size) if len(used) else np.zeros(size), theta)
    if not n or not len(used):
        return model()
    seen_w, seen_t, at = np.zeros(len(used)), np.zeros(GRADES - 1), np.arange(n)
    for _ in range(steps):
        z = np.clip(np.bincount(row, w[col], n)[:, None] - np.concatenate([[-40], theta, [40]])[None, :], -40, 40)
        above = 1 / (1 + np.exp(-z))  # P(grade >= k), k = 0 to GRADES
        hi, lo = above[at, grade], above[at, grade + 1]
        p = np.maximum(hi - lo, 1e-6)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_w = np.bincount(col, (-(d_hi - d_lo) / n)[row], len(used))
        g_t = np.array([(d_hi[grade == k + 1].sum() - d_lo[grade == k].sum()) / n for k in range(GRADES - 1)])
        seen_w += g_w**2
        seen_t += g_t**2
        step = 0.3 / np.sqrt(seen_w + 1e-12)
        w = w - step * g_w
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        theta = theta - 0.3 / np.sqrt(seen_t + 1e-12) * g_t
        for k in range(1, GRADES - 1):  # thresholds stay in order, a little apart
            theta[k] = max(theta[k], theta[k - 1] + GAP)
    return model()


def best_cut(model: Model, toxic: np.ndarray, features: np.ndarray, offs: np.ndarray) -> float:
    """The probability of any toxicity from which a row counts as toxic, by F1."""
    row = np.repeat(np.arange(len(toxic)), np.diff(offs))
    p = model.above(model.score(features, row, len(toxic)))[:, 0]
    cuts = np.linspace(0.1, 0.9, 33)
    f1 = [2 * np.sum(toxic & (p >= c)) / max(1, np.sum(toxic) + np.sum(p >= c)) for c in cuts]
    top = np.flatnonzero(np.array(f1) >= max(f1) - 1e-12)
    return float(cuts[top[len(top) // 2]])


def train(docs: DataFrame, labels: DataFrame, sample: int = 8_000) -> Model:
    toxic, features, offs = labelled_sample(docs, labels, sample)
    grade = grades(toxic, features, offs)
    half = len(toxic) // 2  # the cut is set on rows that its model hasn't seen
    first, second = slice(0, half + 1), slice(half, len(toxic) + 1)
    cut = best_cut(fit(grade[:half], features[: offs[half]], offs[first]), toxic[half:], features[offs[half] :], offs[second] - offs[half])
    model = fit(grade, features, offs)
    model.cut = cut
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_severity (0 to 3), grade (the likeliest), p_toxic and toxic of each row of docs (doc_id, text)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shipped.value
        for rows, feature, firsts in _features(batches):
            n = len(rows)
            above = m.above(m.score(feature, np.repeat(np.arange(n), np.diff(firsts)), n))
            full = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(above.sum(axis=1)), pa.array((full[:, :-1] - full[:, 1:]).argmax(axis=1), pa.int32()), pa.array(above[:, 0]), pa.array(above[:, 0] >= m.cut)],
                ["doc_id", "expected_severity", "grade", "p_toxic", "toxic"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, expected_severity double, grade int, p_toxic double, toxic boolean")
