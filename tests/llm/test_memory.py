"""What a worker's steps take at once: the pipeline's executors have no more than their budget leaves beside the heap."""

import subprocess
import sys

import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from govlake.llm import op9_cotraining
from govlake.llm.op6_minhash import PLACES

#: Prints the MB of anonymous memory that a step takes beyond what the process had before it, at most.
PROBE = """
import re, threading, time
import numpy as np, pyarrow as pa
from govlake.llm import op2_sentencepiece, op6_minhash, op9_cotraining

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

def texts(n):
    rng = np.random.default_rng(0)
    return pa.array([" ".join(f"w{x}" for x in rng.integers(0, 5000, 500)) for _ in range(n)])

def watch():
    while True:
        most[0] = max(most[0], held())
        time.sleep(0.001)

column = texts(1600)
before = held()
most = [before]
threading.Thread(target=watch, daemon=True).start()
STEP
print(round(most[0] - before))
"""
STEPS = {
    "permutation": ("op6_minhash._second_permutation(160)", 70),
    "sets": ("[None for _ in op6_minhash.shingle_sets(column)]", 40),
    "views": ("[None for _ in op9_cotraining.view_rows(column, ['s'] * len(column), ['en'] * len(column))]", 30),
}


@pytest.mark.parametrize("step", STEPS)
def test_worker_memory(step):
    code, most = STEPS[step]
    done = subprocess.run([sys.executable, "-c", PROBE.replace("STEP", code)], capture_output=True, text=True, check=True)
    assert int(done.stdout) <= most


def test_permutation_is_one():
    from govlake.llm.op6_minhash import _shifts

    rows = _shifts(3)
    assert sorted(rows[:, 0].tolist()) == list(range(PLACES))
    assert rows[PLACES - 1].tolist() == [rows[PLACES - 1, 0], rows[0, 0], rows[1, 0]]


def test_classifier_starts_no_second_daemon(spark, monkeypatch):
    """Numbers that the driver sends pass through no Python RDD, whose workers would stay beside those of the stages."""
    monkeypatch.setattr(RDD, "_to_java_object_rdd", lambda self: pytest.fail("a list went through Python workers"))
    n = F.col("id")
    docs = spark.range(64).select(n.alias("doc_id"), F.when(n % 2 == 0, F.concat(F.lit("clear plain words of day "), n)).otherwise(F.concat(F.lit("junk $$ ## buy "), n)).alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))
    kept = {r.doc_id for r in op9_cotraining.keep_good(docs, labels).select("doc_id").collect()}
    assert kept >= set(range(0, 64, 2))
