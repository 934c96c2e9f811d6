"""Files of runs as tables, and tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALL = "struct<id:string,function:struct<name:string,arguments:string>>"
ACTION = "struct<id:string,tool_call_id:string,type:string,command:string>"
TRAJECTORY = f"""instance_id string, messages array<struct<role:string,content:string,tool_call_id:string,timestamp:double,tool_calls:array<{CALL}>,extra:struct<actions:array<{ACTION}>>>>,
info struct<exit_status:string,submission:string,model_stats:struct<api_calls:bigint,instance_cost:double>>"""
# Folders of a source tree that hold no sources of its own.
SKIPPED = r"(^|/)(\.[^/]+|build|dist|node_modules|site-packages|vendor|__pycache__)(/|$)"


def read_trajectories(spark: SparkSession, path: str, id_pattern: str = r"([^/]+?)(?:\.traj)?\.json$") -> tuple[DataFrame, DataFrame]:
    """(messages, runs) of nested JSON files, one a run; missing keys are null, unknown ones are dropped."""
    raw = spark.read.schema(TRAJECTORY).option("multiLine", True).json(path).withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), id_pattern, 1))
    messages = raw.select("run_id", F.posexplode_outer("messages").alias("step", "m")).where("m IS NOT NULL").select("run_id", "step", "m.role", "m.content", "m.tool_call_id", F.col("m.timestamp").alias("ts"), "m.tool_calls", F.col("m.extra.actions").alias("actions"))
    runs = raw.select("run_id", "instance_id", "info.exit_status", "info.submission", "info.model_stats.api_calls", "info.model_stats.instance_cost")
    return messages, runs


def read_text_artifacts(spark: SparkSession, path: str, id_pattern: str) -> DataFrame:
    """(run_id, text) of whole files, named by a part of their path; bytes that are no UTF-8 are replaced."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), id_pattern, 1).alias("run_id"), F.col("value").alias("text"))


def read_repo_snapshot(spark: SparkSession, root: str, most_bytes: int = 500_000) -> DataFrame:
    """(path, content) of the Python files below root, without hidden, built and vendored folders and very large files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", True).load(root)
    below = F.regexp_replace("path", "^.*?" + root.rstrip("/").split(":")[-1].lstrip("/") + "/", "")
    return files.select(below.alias("path"), "length", "content").where((F.col("length") <= most_bytes) & ~F.col("path").rlike(SKIPPED)).select("path", F.decode("content", "UTF-8").alias("content"))


def read_eval_records(spark: SparkSession, sources: list[tuple[str, str, int]], schema: str = "instance_id string, baseline string, resolved boolean, eval_error string") -> DataFrame:
    """Records of several JSON files that hold a list or one object each, with the source's name and priority (name, path, priority)."""
    out = None
    for name, path, priority in sources:
        one = spark.read.schema(schema).option("multiLine", True).json(path).withColumns({"source": F.lit(name), "priority": F.lit(priority)})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read_instances(spark: SparkSession, parquet: str, manifest: str, canonical: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Benchmark, manifest (JSON lines) and canonical table (Parquet) of instances, as instance_registry joins them."""
    return spark.read.json(manifest), spark.read.parquet(parquet), spark.read.parquet(canonical)


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, category, extension, bytes, sha) of every file below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    extension = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    category = F.when(extension.isin("json", "jsonl", "csv", "tsv", "parquet"), "data").when(extension.isin("diff", "patch"), "patch").when(extension.isin("log", "txt"), "log").when(extension == "py", "source").otherwise("other")
    return files.select("path", category.alias("category"), extension.alias("extension"), F.col("length").alias("bytes"), F.substring(F.sha2("content", 256), 1, 16).alias("sha"))


def write_matrix(df: DataFrame, path: str, format: str = "csv", split_by: str | None = None) -> None:
    """Writes a matrix as CSV with a header and fixed columns, JSON lines or Parquet, in a folder for each key if asked for."""
    writer = df.write.mode("overwrite").format(format)
    if format == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(split_by) if split_by else writer).save(path)
