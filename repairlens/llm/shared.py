"""Folders that driver and executors share, tables written there, and joins with a checked size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: A key with more rows than this is dealt to several tasks by spread_join.
KEY_ROWS = 50_000
#: Keys that spread_join deals out, the most frequent ones; no other key can hold more than this fraction of all rows.
SPREAD_KEYS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, with its file system. Where it is unset, an own one is set on one machine; on a cluster that is an error."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        where = context.getCheckpointDir()
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, id, row): id and row tell rows apart by doc_id and text, null or not; rows that agree in both are the same document."""
    return docs.select("doc_id", "text", *row_key())


def row_key() -> list[Column]:
    """id and row of keyed(), as columns; neither is null."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"), F.xxhash64("doc_id", "text").alias("row")]


def without(docs: DataFrame, dropped: DataFrame, rows: int) -> DataFrame:
    """docs, with all its columns, but for the rows whose key is in dropped (id, row)."""
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *row_key())
    return sized_join(held, written(dropped.distinct(), "dropped"), ["id", "row"], "left_anti", rows).select("doc.*")


def place(*columns: str) -> Column:
    """Where the 64-bit hash of these columns lies between 0 and 1."""
    return F.xxhash64(*columns) / F.lit(2.0**64) + 0.5


def share_of(n: int, size: int) -> float:
    """A place below which n of so many rows lie, and few more: eight standard deviations, and 64 rows."""
    return (n + 8 * n**0.5 + 64) / max(1, size) if n else 0.0


def partitions(spark: SparkSession, rows: int, each: int) -> int:
    """So many that none has many more rows than ``each``; spark.sql.shuffle.partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def short_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Lowers Spark's own default of 10,000 rows in an Arrow batch, too many for whole texts; a value set otherwise stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/repairlens/{label}-{uuid.uuid4().hex}"


_SCRATCH: list[list] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that written() stores inside are deleted at the end, but for those to keep; nothing that is still to be computed may read them then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for df in _SCRATCH.pop():
            forget(df)


def written(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    short_batches(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(out)
    return out


def forget(df: DataFrame) -> None:
    """Deletes what written() stored."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether df has no more than so many rows; reads no further than that."""
    short_batches(df.sparkSession)
    return df.limit(rows + 1).count() <= rows


def sized_join(left: DataFrame, right: DataFrame, on, how: str = "left", rows: int = 200_000) -> DataFrame:
    """Broadcasts right where it has at most so many rows (counted), else joins by sort and merge."""
    return left.join(F.broadcast(right) if fits(right, rows) else right.hint("merge"), on, how)


def frequent_keys(counted: DataFrame, on: list[str], count: str) -> DataFrame | None:
    """The keys that spread_join deals out: those of most rows, by a column of ``counted`` that says how many rows of the other side have the key. None if no key has more than KEY_ROWS."""
    frequent = counted.where(F.col(count) > KEY_ROWS).orderBy(F.desc(count)).limit(SPREAD_KEYS).select(*on, F.ceil(F.col(count) / KEY_ROWS).cast("int").alias("deals__"))
    return None if fits(frequent, 0) else written(frequent, "frequent")


def spread_join(left: DataFrame, right: DataFrame, on: list[str], frequent: DataFrame | None, by: list[str], how: str = "inner") -> DataFrame:
    """left joined by sort and merge with right, a table with one row for each key, so that no key lands in one task whole.

    The rows of a frequent key are dealt out by the columns ``by``, and its row of right is
    repeated for each deal; in left joins rows with a null key, which match nothing, are dealt out too.
    """
    nullable = [c for c in on if how.startswith("left")]
    if frequent is None and not nullable:
        return left.join(right.hint("merge"), on, how)
    own = F.lit(0)
    if frequent is not None:
        left, right = (df.join(F.broadcast(frequent), on, "left") for df in (left, right))
        own = F.pmod(F.xxhash64(*by), F.coalesce("deals__", F.lit(1))).cast("int")
    for c in nullable:
        own = F.when(F.col(c).isNull(), F.pmod(F.xxhash64(*by), F.lit(1 << 20)).cast("int")).otherwise(own)
    deals = F.expr("sequence(0, coalesce(deals__, 1) - 1)") if frequent is not None else F.array(F.lit(0))
    return left.withColumn("deal__", own).drop("deals__").join(right.withColumn("deal__", F.explode(deals)).drop("deals__").hint("merge"), [*on, "deal__"], how).drop("deal__")


def fs_of(uri: str):
    """(file system, path) for Python writers of binary files in the shared folder."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)
