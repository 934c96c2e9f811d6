"""Tables cut from their lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the folder named in spark.checkpoint.dir. Where none is set, an own one on one machine; on a cluster that is an error."""
    context = df.sparkSession.sparkContext
    where = context.getCheckpointDir() or df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return df.checkpoint()
