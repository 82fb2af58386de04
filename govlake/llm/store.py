"""Tables that cut lineage, in the folder that all executors share, size-checked broadcasts, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers each up to which a table is broadcast; longer ones are shuffled.
BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, a temporary folder of our own on a local master (tests); an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="govlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def small_batches(df: DataFrame, rows: int = 1024) -> DataFrame:
    """df, with the session's Arrow batches at most `rows` rows long: a batch of whole texts stands in the executor's and the worker's memory at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    set_ = int(df.sparkSession.conf.get(name))
    if not 0 < set_ <= rows:
        df.sparkSession.conf.set(name, str(rows))
    return df


def numbers(spark: SparkSession, values: Iterable[int], name: str) -> DataFrame:
    """A column of whole numbers of the driver's. As Arrow: a list of Python's would pass through workers of their own, a daemon and two of them left on each executor."""
    return spark.createDataFrame(pa.table({name: pa.array(list(values), pa.int64())}))


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read from there: lost executors don't cause it to be made again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the files of a table that `saved` made and that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.saved_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, a saved table, marked for broadcast if it has at most `limit` rows and for a shuffle beyond. The result of a join is the same."""
    return F.broadcast(df) if df.count() <= limit else df.hint("merge")


def with_min(edges: DataFrame, key: str, value: str, out: str) -> DataFrame:
    least = edges.groupBy(key).agg(F.min(value).alias(out))
    return edges.join(least, key)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for each node of the links (a, b); component is the smallest node that can be reached.

    Alternates the large-star and small-star steps, which need O(log^2 n) rounds whatever the
    shape of the graph; each round is written to the shared folder and the one before deleted. Links to itself and
    repeated links are harmless. A node without links isn't returned.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, before = saved(links, "links"), None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_min(both, "u", "v", "m").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        small = with_min(large, "u", "v", "m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        new = saved(small, "links")
        forget(links)
        links = new
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(roots)
