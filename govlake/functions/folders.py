"""Where jobs put tables and stream state that all executors must see, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers each up to which a table is broadcast.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most `limit` rows; a join's result is the same either way."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, under a temporary one on a local master (tests); an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="govlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint, in the session's folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()
