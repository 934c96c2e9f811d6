"""Token ids as raw binary shards, and a minimal perfect hash index over document keys.

A shard holds the ids of a range of documents in ascending doc_id order, each document ending
with ``end_id``: little-endian unsigned integers of 16 bits where the vocabulary allows, else
32, and nothing else. Index files, each over a bounded bucket of keys, map a key to its shard,
offset and length in constant time; a stored fingerprint tells keys that aren't there. Files
bear the name of the task attempt that wrote them, and only those that Spark's committed
tables name are read, so lost executors and repeated tasks do no harm.

Pieces are encoded once per distinct piece and slice, exactly as the tokenizers library does.
Null text counts as empty. Rows with the same id are kept apart by their number; null ids
come first. Other columns are ignored; an empty table gives no rows and empty files.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repairlens.llm import bpe, perfect_hash, shared
from repairlens.llm import textops as T


@lru_cache(2)
def _merges(path: str) -> bpe.Merges:
    return bpe.Merges(path)


class _Known:
    """Ids of pieces met before, up to a bounded number; looked up by one 64-bit hash and confirmed by a second."""

    def __init__(self, merges: bpe.Merges, most: int = 500_000):
        self.merges, self.most, self.at = merges, most, {}
        self.flat, self.used, self.have = np.zeros(1 << 22, np.int32), 0, 0
        self.starts, self.counts, self.second = np.zeros(most, np.int64), np.zeros(most, np.int64), np.zeros(most, np.uint64)

    def encode(self, data, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, counts) of every piece."""
        hashes = bpe.piece_hashes(data, starts, ends)
        first, group, _ = bpe.distinct(hashes)
        names, second = hashes[0][first].tolist(), hashes[1][first]
        at = np.array([self.at.get(x, -1) for x in names], np.int64)
        at[(at >= 0) & (self.second[at] != second)] = -1
        new = np.flatnonzero(at < 0)
        flat, n = self.merges.encode_pieces(data, starts[first[new]], ends[first[new]])
        begin, size = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        old = at >= 0
        begin[old], size[old] = self.starts[at[old]], self.counts[at[old]]
        begin[new], size[new] = np.cumsum(n) - n + self.used, n
        both = np.concatenate([self.flat[: self.used], flat.astype(np.int32)])
        count = size[group]
        ids = both[T.ragged(begin[group], count)]
        self._keep([names[i] for i in new.tolist()], second[new], flat, n)
        return ids, count

    def _keep(self, names, second, flat, n):
        room = min(len(names), self.most - self.have)
        size = int(n[:room].sum())
        if room <= 0 or self.used + size > len(self.flat):
            return
        have, self.have = self.have, self.have + room
        self.starts[have : have + room] = np.cumsum(n[:room]) - n[:room] + self.used
        self.counts[have : have + room] = n[:room]
        self.second[have : have + room] = second[:room]
        self.flat[self.used : self.used + size] = flat[:size]
        self.used += size
        self.at.update(zip(names[:room], range(have, have + room)))


@lru_cache(1)
def _known(path: str) -> _Known:
    return _Known(_merges(path))


def encode_slices(batches, tokenizer: str):
    """(rows, ids of all texts, where each text's ids begin)."""
    merges = _merges(tokenizer)
    for rows, data, offs in T.text_slices(batches, "text"):
        low, cls, safe = bpe.classes(data, offs, False)
        starts, ends = bpe.pieces(low, cls, offs, False)
        ids, n = _known(tokenizer).encode(low, starts, ends)
        bounds = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, offs)]
        if not safe.all():
            parts = [ids[bounds[i] : bounds[i + 1]] if safe[i] else np.array(merges.library.encode(data[offs[i] : offs[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.int64) for i in range(len(safe))]
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        yield rows, ids, bounds


def _numbers(doc_ids: np.ndarray, nulls: np.ndarray, last, seen: int) -> tuple[np.ndarray, tuple, int]:
    """How many rows with the same id came before, in a stream sorted by id."""
    n = len(doc_ids)
    same = np.zeros(n, bool)
    same[1:] = (doc_ids[1:] == doc_ids[:-1]) & (nulls[1:] == nulls[:-1])
    same[0] = last is not None and last == (int(doc_ids[0]), bool(nulls[0]))
    run = np.arange(n)
    head = np.maximum.accumulate(np.where(same, -1, run))
    out = np.where(head < 0, seen + 1 + run, run - head)
    return out, (int(doc_ids[-1]), bool(nulls[-1])), int(out[-1])


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, shard_rows: int = 200_000) -> DataFrame:
    """(doc_id, number, shard, file, offset, n): one row a document, as written; offsets count ids within the shard.

    As many shards as give about ``shard_rows`` rows each, the number of shuffle partitions at least.
    """
    parts = shared.partitions(docs.sparkSession, docs.count(), shard_rows)
    spark_fs = f"{folder}/shards"

    def run(batches):
        fs, path = shared.fs_of(spark_fs)
        task = TaskContext.get()
        shard, file = task.partitionId(), f"shard-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        wide = _merges(tokenizer).size > 1 << 16
        fs.create_dir(path, recursive=True)
        at, last, seen = 0, None, 0
        with fs.open_output_stream(f"{path}/{file}") as out:
            for rows, ids, bounds in encode_slices(batches, tokenizer):
                n = np.diff(bounds) + 1
                body = np.insert(ids, bounds[1:], end_id)
                out.write(body.astype("<u4" if wide else "<u2").tobytes())
                keys = rows.column(0)
                number, last, seen = _numbers(keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_null().to_numpy(zero_copy_only=False), last, seen)
                ends = np.cumsum(n) + at
                yield pa.RecordBatch.from_arrays([keys, pa.array(number, pa.int64()), pa.array(np.full(len(n), shard), pa.int32()), pa.array([file] * len(n)), pa.array(ends - n), pa.array(n, pa.int64())], ["doc_id", "number", "shard", "file", "offset", "n"])
                at = int(ends[-1])

    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return shared.written(ordered.mapInArrow(run, "doc_id long, number long, shard int, file string, offset long, n long"), "entries")


def _keyed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumns({"h1": F.xxhash64("doc_id", "number"), "h2": F.xxhash64(F.lit(1), "number", "doc_id")}).withColumn("bucket", F.pmod(F.xxhash64("h1"), F.lit(buckets)).cast("int"))


def _by(batches, column: str):
    """(value, table) of runs of the same value in a sorted stream."""
    held, value = [], None
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(col[1:] != col[:-1]) + 1, [len(col)]]) if len(col) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and col[a] != value:
                yield value, pa.Table.from_batches(held).combine_chunks()
                held = []
            value = col[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield value, pa.Table.from_batches(held).combine_chunks()


def _u64(table, name: str) -> np.ndarray:
    return table[name].to_numpy().view(np.uint64)


def write_index(entries: DataFrame, folder: str, bucket_keys: int = 100_000) -> tuple[DataFrame, int]:
    """((bucket, file), number of buckets): index files over buckets of about so many keys."""
    buckets = max(1, -(-entries.count() // bucket_keys))

    def run(batches):
        fs, path = shared.fs_of(f"{folder}/index")
        fs.create_dir(path, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for bucket, t in _by(batches, "bucket"):
            file = f"index-{bucket:06d}-{attempt}.bin"
            with fs.open_output_stream(f"{path}/{file}") as out:
                out.write(perfect_hash.dumps(_u64(t, "h1"), _u64(t, "h2"), {c: t[c].to_numpy() for c in ("shard", "offset", "n")}))
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([file])], ["bucket", "file"])

    keyed = _keyed(entries, buckets).select("bucket", "h1", "h2", "shard", "offset", "n")
    parts = shared.partitions(entries.sparkSession, buckets, 8)
    return shared.written(keyed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket int, file string"), "index"), buckets


def look_up(keys: DataFrame, index: DataFrame, buckets: int, folder: str) -> DataFrame:
    """(doc_id, number, shard, offset, n) of keys (doc_id, number) that the index holds."""

    def run(batches):
        fs, path = shared.fs_of(f"{folder}/index")
        for _, t in _by(batches, "bucket"):
            with fs.open_input_stream(f"{path}/{t['file'][0].as_py()}") as f:
                got = perfect_hash.loads(f.read()).find(_u64(t, "h1"), _u64(t, "h2"))
            there = pa.array(got["found"])
            out = pa.table([t["doc_id"], t["number"], pa.array(got["shard"]), pa.array(got["offset"]), pa.array(got["n"])], names=["doc_id", "number", "shard", "offset", "n"])
            yield from out.filter(there).to_batches()

    named = _keyed(keys, buckets).join(index.hint("merge"), "bucket").select("doc_id", "number", "h1", "h2", "bucket", "file")
    parts = shared.partitions(keys.sparkSession, buckets, 8)
    return named.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc_id long, number long, shard int, offset long, n long")


def ids_of(spark, doc_id: int | None, index: DataFrame, buckets: int, entries: DataFrame, folder: str, number: int = 0, wide: bool = False) -> list[int] | None:
    """The ids of one document, without its end id, by its key; None if it isn't there.

    Reads a few bytes of one index file and the document's own bytes of one shard, however many documents there are.
    """
    key = _keyed(spark.createDataFrame([(doc_id, number)], "doc_id long, number long"), buckets).first()
    at = index.where(F.col("bucket") == key.bucket).first()
    if at is None:
        return None
    fs, path = shared.fs_of(folder)
    with fs.open_input_file(f"{path}/index/{at.file}") as f:
        h1, h2 = (np.array([h], np.int64).view(np.uint64) for h in (key.h1, key.h2))
        got = perfect_hash.Index(lambda start, size: f.read_at(size, start)).find(h1, h2)
    if not got["found"][0]:
        return None
    shard, offset, n = (int(got[c][0]) for c in ("shard", "offset", "n"))
    width = 4 if wide else 2
    name = entries.where(F.col("shard") == shard).select("file").first().file
    with fs.open_input_file(f"{path}/shards/{name}") as f:
        return np.frombuffer(f.read_at((n - 1) * width, offset * width), "<u4" if wide else "<u2").tolist()


def read_shards(found: DataFrame, entries: DataFrame, folder: str, wide: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read from the shard files at the places that the index gave."""
    shards = entries.groupBy("shard", "file").agg(F.sum("n").alias("size"), F.count("*").alias("rows"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over one row a shard: the manifest
    shards = shared.written(shards.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))).select("shard", "file", "base", "rows"), "manifest")
    width = 4 if wide else 2

    def run(batches):
        fs, path = shared.fs_of(f"{folder}/shards")
        at, f, window, low = None, None, b"", 0
        try:
            for batch in batches:
                out = []
                for shard, offset, n, file in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3, 4))):
                    if at != shard:
                        if f is not None:
                            f.close()
                        at, f, window, low = shard, fs.open_input_file(f"{path}/{file}"), b"", 0
                    a, b = offset * width, (offset + n) * width
                    if a < low or b > low + len(window):
                        f.seek(a)
                        window, low = f.read(max(b - a, 1 << 22)), a
                    body = window[a - low : b - low]
                    out.append(zlib.crc32(body if wide else np.frombuffer(body, "<u2").astype("<u4").tobytes()))
                start = pc.add(batch.column(5), batch.column(2))
                yield pa.RecordBatch.from_arrays([batch.column(0), start, batch.column(3), pa.array(out, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
        finally:
            if f is not None:
                f.close()

    frequent = shared.frequent_keys(shards, ["shard"], "rows")
    placed = shared.spread_join(found.select("doc_id", "shard", "offset", "n"), shards.drop("rows"), ["shard"], frequent, ["offset"]).select("doc_id", "shard", "offset", "n", "file", "base")
    parts = shared.partitions(found.sparkSession, entries.count(), 100_000)
    stretch = F.floor(F.col("offset") / (1 << 22))  # of one shard, read by one task
    return placed.repartition(parts, "shard", stretch).sortWithinPartitions("shard", "offset").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes docs (doc_id, text) as shards and index, then reads every document back by its key."""
    folder = shared.new_path(docs.sparkSession, "tokens")
    entries = write_shards(docs, tokenizer, folder, end_id)
    index, buckets = write_index(entries, folder)
    keys = docs.groupBy("doc_id").count().select("doc_id", F.explode(F.expr("sequence(0L, count - 1)")).alias("number"))
    return read_shards(look_up(keys, index, buckets, folder), entries, folder, _merges(tokenizer).size > 1 << 16)
