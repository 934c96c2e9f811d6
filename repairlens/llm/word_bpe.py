"""BPE encoding and decoding through a transducer lexicon of the corpus's frequent words.

1. Every piece of every text is counted (Spark aggregation). 2. The ``lexicon_words`` most
frequent pieces (of equal counts those of least hash) are compiled, with their ids, into a minimal
acyclic transducer; its file goes to the shared folder and Spark ships it to each machine,
where it is memory-mapped. 3. Each text's pieces step through the transducer; pieces it
doesn't hold are merged exactly, rank by rank. 4. Ids are decoded by the vocabulary.

Null text counts as empty; empty text has no ids. Repeated rows and null ids give a row each;
other columns are ignored; an empty table gives no rows. A text longer than a slice is worked
on in a slice of its own.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repairlens.llm import bpe, lexicon, shared
from repairlens.llm import textops as T


@lru_cache(2)
def _merges(path: str) -> bpe.Merges:
    return bpe.Merges(path)


@lru_cache(2)
def _lexicon(name: str) -> lexicon.Lexicon:
    return lexicon.Lexicon(SparkFiles.get(name))


def _pieces(batches):
    for rows, data, offs in T.text_slices(batches, "text"):
        low, cls, safe = bpe.classes(data, offs, True)
        starts, ends = bpe.pieces(low, cls, offs, True)
        yield rows, data, offs, low, safe, starts, ends


def piece_counts(docs: DataFrame) -> DataFrame:
    """(piece, n): how often each piece occurs in the texts that array arithmetic splits."""

    def run(batches):
        for _, _, offs, low, safe, starts, ends in _pieces(batches):
            keep = safe[T.text_of(offs, starts)] & (ends - starts <= 64)
            starts, ends = starts[keep], ends[keep]
            if not len(starts):
                continue
            first, _, n = bpe.distinct(bpe.piece_hashes(low, starts, ends))
            sizes = (ends - starts)[first]
            flat = low[T.ragged(starts[first], sizes)]
            at = np.zeros(len(first) + 1, np.int32)
            np.cumsum(sizes, out=at[1:])
            yield pa.RecordBatch.from_arrays([pa.StringArray.from_buffers(len(first), pa.py_buffer(at), pa.py_buffer(flat)), pa.array(n)], ["piece", "n"])

    return docs.select("text").mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, words: int) -> list[str]:
    """So many pieces of (piece, n) of the highest counts. Counts are compared by 64ths of an octave, which is exactly up to 64; of the last of these levels the pieces of least hash are taken.

    A top-n sort would send its n rows from every task. Here the levels are counted first (64 * 64
    at most), so little more than ``words`` rows come to the driver at any size.
    """
    ranked = counts.select("piece", F.floor(F.log2("n") * 64).alias("level"), shared.place("piece").alias("place"))
    left, last, share = words, -1, 0.0
    for level, size in sorted(((r.level, r.size) for r in ranked.groupBy("level").agg(F.count("*").alias("size")).collect()), reverse=True):
        if size > left:
            last, share = level, shared.share_of(left, size)
            break
        left -= size
    found = ranked.where((F.col("level") > last) | ((F.col("level") == last) & (F.col("place") < share))).collect() if words else []
    return [r.piece for r in sorted(found, key=lambda r: (-r.level, r.place, r.piece))[:words]]


def build_lexicon(docs: DataFrame, tokenizer: str, lexicon_words: int) -> str:
    """Compiles the most frequent pieces and ships the file; returns the name to find them by."""
    spark = docs.sparkSession
    counts = shared.written(piece_counts(docs).where("n > 1"), "counts")
    frequent = most_frequent(counts, lexicon_words)
    shared.forget(counts)
    words = [w.encode() for w in frequent]
    merges = _merges(tokenizer)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if words else ends
    flat, n = merges.encode_pieces(np.frombuffer(b"".join(words), np.uint8), starts, ends)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    where = f"{shared.shared_dir(spark)}/repairlens/{name}"
    fs, path = shared.fs_of(where)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(lexicon.compile_lexicon(words, [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] if words else []))
    spark.sparkContext.addFile(where)
    return name


def _encoded(batches, tokenizer: str, name: str):
    """(rows, ids of all texts, where each text's ids begin) of slices."""
    merges, lex = _merges(tokenizer), _lexicon(name)
    for rows, data, offs, low, safe, starts, ends in _pieces(batches):
        ranks = lex.find(low, starts, ends)
        unseen = np.flatnonzero(ranks < 0)
        first, group, _ = bpe.distinct(bpe.piece_hashes(low, starts[unseen], ends[unseen])) if len(unseen) else (unseen,) * 3
        other, counts = merges.encode_pieces(low, starts[unseen[first]], ends[unseen[first]])
        ranks[unseen] = -1 - group
        flat, n = lexicon.ids_of(lex, ranks, other, counts)
        bounds = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, offs)]
        if not safe.all():
            flat, bounds = _with_library(merges, data, offs, safe, flat, bounds)
        yield rows, flat, bounds


def encode(docs: DataFrame, tokenizer: str, lexicon_words: int = 1 << 17) -> DataFrame:
    """(doc_id, ids array of int) of each row of docs (doc_id, text)."""
    name = build_lexicon(docs, tokenizer, lexicon_words)

    def run(batches):
        for rows, flat, bounds in _encoded(batches, tokenizer, name):
            ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([rows.column(0), ids], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids, names: list[str]) -> str:
    """The text of ids as the library's decode, which joins tokens by spaces for a file without decoder."""
    return " ".join(map(names.__getitem__, ids))


def _with_library(merges, data, offs, safe, flat, bounds):
    """Replaces the ids of texts that aren't safe by the library's."""
    parts = [flat[bounds[i] : bounds[i + 1]] if safe[i] else np.array(merges.library.encode(data[offs[i] : offs[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.int64) for i in range(len(safe))]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def decoded(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) of encoded rows (doc_id, ids)."""

    def run(batches):
        names = _merges(tokenizer).names
        for batch in batches:
            ids = batch.column(1)
            texts = [decode(ids[i].values.to_pylist(), names) if ids[i].is_valid else None for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, tokenizer: str, lexicon_words: int = 1 << 17) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row, encoded and decoded in one pass."""
    name = build_lexicon(docs, tokenizer, lexicon_words)

    def run(batches):
        names = _merges(tokenizer).names
        numbers = [str(i) for i in range(len(names))]
        for rows, flat, bounds in _encoded(batches, tokenizer, name):
            listed, plain = [], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                ids = flat[a:b].tolist()
                listed.append(hashlib.sha256(" ".join(map(numbers.__getitem__, ids)).encode()).hexdigest())
                plain.append(hashlib.sha256(decode(ids, names).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(bounds)), pa.array(listed), pa.array(plain)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
