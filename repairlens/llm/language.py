"""Language identification by Bayesian fusion of evidence.

Per document and language, log posterior = host prior + text likelihood + likelihood of the
declared markup language + likelihood of the address suffix. Text: hashed byte trigrams under
a model fitted on a bounded sample of rows with a declared language, tempered because
trigrams overlap. The sample takes about equally many rows of each declared language, so a rare
one is in the model like any other. Host priors: languages that the text alone suggests, counted by host over
the whole corpus, each host smoothed by its parent domain and that by the corpus. Declared
languages and suffixes: how often they go with each language in the corpus, by grouped
aggregation, smoothed. A background class without structure takes what is no language.

Missing evidence (null or empty, or a declared value that is no tag of two or three letters)
counts for nothing. A text without trigrams (null, empty, digits and signs alone) is rejected
as ``und``; so is every text where no row has a declared language. Rows with a null id are
judged like others but not sampled; equal rows get equal results; further columns are ignored;
an empty table gives no rows. Frequent hosts, and rows without one, are dealt to several tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repairlens.llm import shared
from repairlens.llm import textops as T

BITS = 15
_KINDS = "id long, row long, doc_id long, host string, declared string, suffix string, n long, scores array<double>"


def evidence(docs: DataFrame, declared: str | None = "lang", host: str | None = "source") -> DataFrame:
    """(doc_id, text, declared, host, suffix) from any table; the suffix is the last label of a host with dots."""
    column = lambda name: F.nullif(F.trim(F.col(name).cast("string")), F.lit("")) if name else F.lit(None).cast("string")
    h = F.lower(column(host))
    tag = F.regexp_extract(F.lower(column(declared)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return docs.select("doc_id", "text", F.nullif(tag, F.lit("")).alias("declared"), h.alias("host"), F.nullif(F.regexp_extract(h, r"\.([a-z]{2,})$", 1), F.lit("")).alias("suffix"))


def _trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigrams of letters and gaps, where each text's begin). Digits and signs count as gaps; runs of gaps don't."""
    low = T.LOWER[data].astype(np.uint32)
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    low = np.where(letter, low, 32)
    n = max(0, len(low) - 2)
    key = (low[:n] << 16) | (low[1 : n + 1] << 8) | low[2 : n + 2]
    keep = letter[1 : n + 1] & T.within(offs, len(low), 3) if n else np.zeros(0, bool)
    at = np.flatnonzero(keep)
    hashed = (key[at] * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    return hashed.astype(np.int64), np.searchsorted(at, offs)


class TextModel:
    """Log-likelihood ratio of each hashed trigram and language to the background."""

    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights.astype(np.float32)


def fit(rows: DataFrame, sample: int = 8_000, least_rows: int = 25, alpha: float = 0.5) -> TextModel:
    """From about ``sample`` rows with a declared language, dealt evenly to the languages (``least_rows`` of each at least); counts are summed in Spark.

    A row is taken if the 64-bit hash of its id and text lies under its language's share.
    """
    known = rows.where("declared IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    sizes = shared.written(known.groupBy("declared").agg(F.count("*").alias("known")), "languages")  # a row for each tag of two or three letters
    each = max(least_rows, sample // max(1, sizes.count()))
    drawn = known.join(F.broadcast(sizes), "declared")
    chosen = drawn.where((F.xxhash64("doc_id", "text") / F.lit(2.0**64) + 0.5) * F.col("known") < each)

    def run(batches):
        for part, data, offs in T.text_slices(batches, "text"):
            hashed, firsts = _trigrams(data, offs)
            names = part.column(part.schema.get_field_index("declared")).to_pylist()
            distinct = sorted(set(names))
            owner = np.repeat([distinct.index(x) for x in names], np.diff(firsts))
            key, n = np.unique(owner << BITS | hashed, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([distinct[i] for i in key >> BITS], pa.string()), pa.array(key & (1 << BITS) - 1, pa.int32()), pa.array(n, pa.int64())], ["language", "gram", "n"])

    counts = chosen.select("text", "declared").mapInArrow(run, "language string, gram int, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # languages times 2 ** BITS rows at most
    names, grams, n = table["language"].to_pylist(), table["gram"].to_numpy(), table["n"].to_numpy()
    totals: dict[str, int] = {}
    for name, k in zip(names, n):
        totals[name] = totals.get(name, 0) + int(k)
    languages = sorted(totals)
    weights = np.zeros((len(languages), 1 << BITS))
    place = {x: i for i, x in enumerate(languages)}
    of = np.array([place.get(x, -1) for x in names], np.int64)
    np.add.at(weights, (of[of >= 0], grams[of >= 0]), n[of >= 0])
    weights = np.log(weights + alpha) - np.log(weights.sum(axis=1, keepdims=True) + alpha * (1 << BITS)) - np.log(1 / (1 << BITS))
    return TextModel(languages, weights)


def text_scores(rows: DataFrame, model: TextModel, temper: float = 0.25) -> DataFrame:
    """id, row, doc_id, host, declared, suffix, n (trigrams) and scores (log ratio to the background for each language)."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights = shipped.value.weights
        for part, data, offs in T.text_slices(batches, "text"):
            hashed, firsts = _trigrams(data, offs)
            n = np.diff(firsts)
            out = np.zeros((len(part), len(weights)))
            some = np.flatnonzero(n > 0)
            for i, row in enumerate(weights):
                if len(some):
                    out[some, i] = temper * np.add.reduceat(row[hashed].astype(np.float64), firsts[some])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * len(weights)), pa.array(out.ravel()))
            cols = {name: part.column(i) for i, name in enumerate(part.schema.names)}
            yield pa.RecordBatch.from_arrays([cols["id"], cols["row"], cols["doc_id"], cols["host"], cols["declared"], cols["suffix"], pa.array(n, pa.int64()), lists], ["id", "row", "doc_id", "host", "declared", "suffix", "n", "scores"])

    return rows.select(*shared.row_key(), "doc_id", "text", "declared", "host", "suffix").mapInArrow(run, _KINDS)


def _softmax(logs: Column) -> Column:
    """Shares that are proportional to the exponentials."""
    parts = F.transform(F.array(logs), lambda x: F.transform(x, lambda v: F.exp(v - F.array_max(x))))[0]
    return F.transform(F.array(parts), lambda p: F.transform(p, lambda v: v / F.aggregate(p, F.lit(0.0), lambda a, b: a + b)))[0]


def _means(scored: DataFrame, key: str, size: int) -> DataFrame:
    """(key, n, s): how many texts, and summed text posteriors for each language."""
    sums = F.array(*(F.sum(F.get("posterior", F.lit(i))) for i in range(size)))
    return scored.where(F.col(key).isNotNull() & F.col("posterior").isNotNull()).groupBy(key).agg(F.count("*").alias("n"), sums.alias("s"))


def host_priors(scored: DataFrame, size: int, strength: float = 20.0) -> DataFrame:
    """(host, n, prior): its rows, and the log prior of each language, host over parent domain over corpus."""
    parent = F.coalesce(F.nullif(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), F.lit("")), F.lit("*"))
    hosts = _means(scored, "host", size).withColumn("parent", parent)
    sums = lambda: F.array(*(F.sum(F.get("s", F.lit(i))) for i in range(size)))
    parents = hosts.groupBy("parent").agg(F.sum("n").alias("pn"), sums().alias("ps"))
    whole = parents.agg(F.coalesce(F.sum("pn"), F.lit(0)).alias("gn"), F.array(*(F.coalesce(F.sum(F.get("ps", F.lit(i))), F.lit(0.0)) for i in range(size))).alias("gs"))
    smooth = lambda n, s, up: F.zip_with(s, up, lambda a, b: (a + strength * b) / (n + strength))
    parents = parents.join(F.broadcast(whole)).withColumn("g", F.transform("gs", lambda v: (v + 1) / (F.col("gn") + size))).select("parent", smooth(F.col("pn"), F.col("ps"), F.col("g")).alias("p"))
    return hosts.join(parents.hint("merge"), "parent").select("host", "n", F.transform(smooth(F.col("n"), F.col("s"), F.col("p")), lambda v: F.log(v)).alias("prior"))


def likelihoods(scored: DataFrame, key: str, size: int, strength: float = 5.0) -> DataFrame:
    """(key, n, weight): its rows, and the log of how much likelier the value is under each language than in the corpus."""
    sums = F.array(*(F.coalesce(F.sum(F.get("posterior", F.lit(i))), F.lit(0.0)) for i in range(size)))
    whole = scored.where(F.col(key).isNotNull() & F.col("posterior").isNotNull()).agg(F.count("*").alias("gn"), sums.alias("gs"))
    ratio = F.zip_with("s", "gs", lambda a, b: F.log((a + strength * (F.col("n") / F.col("gn"))) / (b + strength) / (F.col("n") / F.col("gn"))))
    return _means(scored, key, size).join(F.broadcast(whole)).select(key, "n", ratio.alias("weight"))


def identify(rows: DataFrame, model: TextModel | None = None, least: float = 0.5, hosts_broadcast: int = 200_000) -> DataFrame:
    """id, row, doc_id, language, posterior, declared and kept of each row of evidence().

    kept: the text has trigrams and some language has at least ``least`` of the posterior mass,
    the background class included. id and row tell rows apart (see shared.keyed).
    """
    model = model or fit(rows)
    size = len(model.languages)
    if not size:
        return rows.select(*shared.row_key(), "doc_id", F.lit("und").alias("language"), F.lit(0.0).alias("posterior"), "declared", F.lit(False).alias("kept"))
    scored = shared.written(text_scores(rows, model).withColumn("posterior", F.when(F.col("n") > 0, _softmax(F.col("scores")))), "scores")
    full = scored
    for key, table, value in (("host", host_priors(scored, size), "prior"), ("declared", likelihoods(scored, "declared", size), "weight"), ("suffix", likelihoods(scored, "suffix", size), "weight")):
        table = table.select(key, F.col("n").alias("rows"), F.col(value).alias(f"{key}_log"))
        if shared.fits(table, hosts_broadcast):
            full = full.join(F.broadcast(table.drop("rows")), key, "left")
        else:
            table = shared.written(table, "priors")
            full = shared.spread_join(full, table.drop("rows"), [key], shared.frequent_keys(table, [key], "rows"), ["id", "row"], "left")
    flat = F.array(*(F.lit(0.0) for _ in range(size)))
    even = F.array(*(F.lit(-float(np.log(size))) for _ in range(size)))
    total = F.col("scores")
    for part, missing in (("host_log", even), ("declared_log", flat), ("suffix_log", flat)):
        total = F.zip_with(total, F.coalesce(F.col(part), missing), lambda a, b: a + b)
    background = F.lit(float(np.log(0.01)))
    names = F.array(*(F.lit(x) for x in model.languages))
    judged = full.withColumn("p", _softmax(F.concat(total, F.array(background)))).withColumn("best", F.array_max(F.slice("p", 1, size)))
    sure = (F.col("n") > 0) & (F.col("best") >= least)
    return judged.select("id", "row", "doc_id", F.when(sure, F.get(names, F.array_position("p", F.col("best")).cast("int") - 1)).otherwise("und").alias("language"), F.col("best").alias("posterior"), "declared", sure.alias("kept"))
