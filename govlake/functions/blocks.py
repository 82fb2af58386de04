"""Ordered runs cut into blocks, so that many tasks scan a key of any weight.

A window over a key puts all its rows into one task. Here rows are dealt by ranges of (key, order) instead: a block holds whole
keys or a piece of one. A scan runs within each block; then what the blocks before it have of a block's first key is carried over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from govlake.functions.folders import work_folder


class Blocks:
    """The rows of df in blocks by keys and order: columns row (df's own), k0, k1, ..., o0, o1, ..., tie and block.

    Rows of equal keys and order stand in an order that is fixed here and may part them over blocks. The table is written once to the
    session's shared folder, so a lost executor changes nothing. Null keys are a key of their own and come first.
    """

    def __init__(self, df: DataFrame, keys: list, order: list):
        spark = df.sparkSession
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.keys, self.order = [f"k{i}" for i in range(len(keys))], [f"o{i}" for i in range(len(order))]
        named = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")]
        named += [_column(c).alias(k) for c, k in zip([*keys, *order], [*self.keys, *self.order], strict=True)]
        tied = df.select(*named, F.xxhash64(F.monotonically_increasing_id()).alias("tie"))
        ranged = tied.repartitionByRange(n, *self.keys, *self.order, "tie").withColumn("block", F.spark_partition_id())
        path = work_folder(spark, "blocks")
        ranged.write.parquet(path)
        self.rows = spark.read.schema(ranged.schema).parquet(path).repartitionById(n, "block")
        self.run = W.partitionBy("block", *self.keys).orderBy(*self.order, "tie")

    def with_carry(self, rows: DataFrame, value: Column, joined: Callable, out: str = "carry") -> DataFrame:
        """rows with `out`: the aggregate `value` over all rows of the key in blocks before the row's own; null where there are none.

        joined(a, b) gives the value of two neighbouring pieces of a run; a null piece adds nothing. One small row a block passes the driver.
        """
        spark, names = rows.sparkSession, self.keys
        key = F.struct(*names) if names else F.struct(F.lit(0).alias("k"))
        pieces = rows.groupBy("block", *names).agg(value.alias("v")).select("block", F.struct(key.alias("key"), "v").alias("piece"))
        edges = pieces.groupBy("block").agg(F.min_by("piece", "piece.key").alias("first"), F.max_by("piece", "piece.key").alias("last"))
        carries, at, so_far = [], None, None
        for block, first, last in sorted(edges.collect(), key=lambda r: r.block):
            if repr(first.key) == at:
                if so_far is not None:
                    carries.append((block, first.key, so_far))
                first_value = so_far if first.v is None else first.v if so_far is None else joined(so_far, first.v)
            else:
                first_value = first.v
            at, so_far = repr(last.key), first_value if repr(last.key) == repr(first.key) else last.v
        piece = pieces.schema["piece"].dataType
        table = spark.createDataFrame(carries, f"b int, key {piece['key'].dataType.simpleString()}, {out} {piece['v'].dataType.simpleString()}")
        held = rows.join(F.broadcast(table), (F.col("block") == F.col("b")) & key.eqNullSafe(F.col("key")), "left")
        return held.drop("b", "key")


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numbered(df: DataFrame, keys: list, order: list, out: str) -> DataFrame:
    """df with `out`: the number of each row within its keys in ascending order, from 1, without a task for a key. Ties get different numbers."""
    blocks = Blocks(df, keys, order)
    local = blocks.rows.withColumn("n", F.row_number().over(blocks.run))
    whole = blocks.with_carry(local, F.count("*"), lambda a, b: a + b)
    number = (F.col("n") + F.coalesce("carry", F.lit(0))).cast("long")
    return whole.select(*[F.col("row")[c].alias(c) for c in df.columns if c != out], number.alias(out))
