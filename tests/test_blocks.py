import random

from pyspark.sql import functions as F

from govlake.functions.blocks import Blocks, numbered


def test_numbers_run_on_over_blocks(spark):
    r = random.Random(4)
    rows = [("hot" if r.random() < 0.5 else r.choice(["a", "b", None, "z"]), r.randint(0, 300), i, "x") for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, o long, id long, block string").repartition(5)
    got = [(x.k, x.o, x.id, x.n, x.block) for x in numbered(df, ["k"], ["o", "id"], "n").collect()]
    want = []
    for k in ("hot", "a", "b", None, "z"):
        want += [(k, o, i, n + 1, "x") for n, (o, i) in enumerate(sorted((o, i) for k2, o, i, _ in rows if k2 == k))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_numbers_of_ties_without_keys_and_of_nothing(spark):
    df = spark.range(1000).select(F.lit(1).alias("o"), "id")
    assert sorted(x.n for x in numbered(df, [], [F.col("o")], "n").collect()) == list(range(1, 1001))
    assert numbered(df.limit(0), [], ["o"], "n").count() == 0


def test_a_hot_key_is_read_by_many_tasks_evenly(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    sizes = sorted(x["count"] for x in Blocks(df, ["k"], ["id"]).rows.groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_carry_of_the_last_value(spark):
    df = spark.createDataFrame([(1, i, i if i % 7 == 0 else None) for i in range(200)] + [(2, i, None) for i in range(50)] + [(3, 0, 5)], "k int, o int, v int")
    blocks = Blocks(df, ["k"], ["o"])
    local = blocks.rows.withColumn("last", F.last("row.v", True).over(blocks.run))
    whole = blocks.with_carry(local, F.max_by("last", F.struct("o0", "tie")), lambda a, b: b)
    got = {(x.k, x.o): x.v for x in whole.select("row.k", "row.o", F.coalesce("last", "carry").alias("v")).collect()}
    assert got == {(1, i): i // 7 * 7 for i in range(200)} | {(2, i): None for i in range(50)} | {(3, 0): 5}
