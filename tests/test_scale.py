"""Keys and graphs of odd shapes against plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from govlake.operators.gaps import merge_gaps, remediation_order
from govlake.operators.ledgers import cache_lookup, enforce_budget
from govlake.operators.redact import chunk_rows, deny_verdicts, gate_payloads


def plain_levels(ids, edges):
    needs = {i: {b for a, b in edges if a == i and b != i and b in ids} for i in ids}
    level, more = {}, True
    while more:
        more = [i for i in ids if i not in level and needs[i] <= level.keys()]
        level |= {i: max((level[b] + 1 for b in needs[i]), default=0) for i in more}
    return {i: level.get(i) for i in ids}


@pytest.mark.parametrize("seed", range(3))
def test_levels_of_random_graphs(spark, seed):
    r = random.Random(seed)
    ids = set(range(60))
    edges = [(a, b) for a, b in ((r.randrange(62), r.randrange(62)) for _ in range((40, 75, 110)[seed])) if a > b or r.random() < 0.08]
    got = remediation_order(spark.createDataFrame([(i,) for i in ids] * 2, "id long"), spark.createDataFrame(edges, "id long, needs long"))
    assert {x.id: x.level for x in got.collect()} == plain_levels(ids, edges)


def test_levels_of_a_star_over_a_chain_beside_a_cycle(spark):
    star, chain = 100_000, 1_000
    ids = spark.range(chain + star + 3)
    edges = ids.where(f"id > 0 and id < {chain}").selectExpr("id", "id - 1 as needs").unionByName(ids.where(f"id >= {chain} and id < {chain + star}").selectExpr("id", f"{chain - 1}L as needs"))
    last = chain + star
    edges = edges.unionByName(spark.createDataFrame([(last, last + 1), (last + 1, last), (last + 2, last), (last + 2, 5)], "id long, needs long"))
    got = remediation_order(ids, edges).groupBy("level").count().collect()
    assert Counter({x.level: x["count"] for x in got}) == Counter({**dict.fromkeys(range(chain), 1), chain: star, None: 3})


def test_a_hot_run_and_seat_is_charged_as_any_other(spark):
    r = random.Random(5)
    calls = [(i, 1 if i % 2 else r.randrange(9), r.randrange(2), "p", r.randrange(500), round(r.random(), 3), r.random() < 0.1) for i in range(3000)]
    df = spark.createDataFrame(calls, "call_id long, run_id long, seat long, phase string, ts long, cost double, cached boolean").repartition(7)
    got = {x.call_id: (x.spent_before, x.refused, x.ends) for x in enforce_budget(df, {0: 90.0, 1: 300.0}, "stop").collect()}
    want, spent, over = {}, Counter(), set()
    for i, run, seat, _, _, cost, cached in sorted(calls, key=lambda c: (c[4], c[0])):
        before, key = spent[run, seat], (run, seat)
        breach = not cached and before + round(cost * 1000) > (90_000, 300_000)[seat]
        want[i] = (before / 1000, not cached and (breach or key in over), "phase" if breach and key not in over else None)
        over |= {key} if breach else set()
        spent[key] += 0 if cached else round(cost * 1000)
    assert got == want


def test_a_hot_key_is_looked_up_as_any_other(spark):
    r = random.Random(6)
    rows = [(f"k{r.choice([0, 0, 0, r.randrange(6)])}", 864 * r.randrange(1200)) for _ in range(2000)]
    asked = [(*x, i, r.random() < 0.1) for i, x in enumerate(rows[:1000])]
    stamp = lambda df: df.withColumn("ts", F.timestamp_seconds("ts"))
    found = cache_lookup(stamp(spark.createDataFrame(asked, "key string, ts long, request_id long, bypass boolean")), stamp(spark.createDataFrame(rows[1000:], "key string, ts long")), 0.01)
    want = {}
    for key, ts, i, skip in asked:
        ages = [(ts - t) / 86400 for k, t in rows[1000:] if k == key and t <= ts]
        age = round(min(ages), 6) if ages and not skip else None
        want[i] = ("bypass" if skip else "miss" if age is None else "hit" if age <= 0.01 else "stale", age)
    assert {x.request_id: (x.verdict, x.age_days) for x in found.collect()} == want


def test_numbers_of_a_project_need_no_exchange_by_it(spark):
    gaps = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("project"), F.lit("low").alias("severity"))
    merged = merge_gaps(gaps, F.col("id"))
    assert "hashpartitioning(project" not in merged._jdf.queryExecution().toString()
    assert sorted(x.gap for x in merged.where("project = 'hot'").collect()) == [f"GAP-{i + 1:06d}" for i in range(2000)]
    chunks = chunk_rows(gaps, "project", "id").where("project = 'hot'").groupBy("chunk").count().collect()
    assert {x.chunk: x["count"] for x in chunks} == {**dict.fromkeys(range(166), 12), 166: 8}


def test_a_payload_without_a_file_is_denied(spark):
    paths = spark.createDataFrame([("a.txt",), (None,)], "path string")
    assert {(x.path, x.denied, x.reason) for x in deny_verdicts(paths).collect()} == {("a.txt", False, None), (None, True, "unknown_path")}
    rows = [(1, None, None), (2, None, []), (3, None, ["a.txt"]), (4, "a.txt", [None]), (5, "a.txt", ["b/.env"]), (6, "a.txt", None)]
    df = spark.createDataFrame([(i, p, f, "https://a.org", "x") for i, p, f in rows], "payload_id long, path string, represents array<string>, url string, payload string")
    got = {x.payload_id: x.verdict for x in gate_payloads(df, [], ["a.org"]).collect()}
    assert got == {1: "denied_path", 2: "denied_path", 3: "pass", 4: "denied_path", 5: "denied_path", 6: "pass"}


def test_batches_of_one_large_project(spark):
    from govlake.operators.redact import pack_batches

    r = random.Random(8)
    docs = [("hot" if i % 4 else r.choice(["b", None]), f"p{i}", i, None if r.random() < 0.05 else "x" * r.choice([1, 30, 300, 900, 2500])) for i in range(700)]
    df = spark.createDataFrame(docs, "project string, path string, doc_id long, content string").repartition(5)
    want = {}
    for project in ("hot", "b", None):
        batch, used = 0, 0
        for _, path, _, content in (d for d in docs if d[0] == project):
            n = len(content or "") + len(path) + 64
            if used and used + n > 2000:
                batch, used = batch + 1, 0
            used += n
            want[path] = (project, batch)
    for rows in (16, 50, 10_000):
        assert {x.path: (x.project, x.batch) for x in pack_batches(df, 2000, piece_rows=rows).collect()} == want
    assert pack_batches(df.limit(0)).count() == 0
