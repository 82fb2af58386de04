import random
import time

import pytest
from pyspark.sql import functions as F

from govlake.functions.folders import work_folder
from govlake.operators.ledgers import enforce_budget
from govlake.streaming import jobs as t

CALLS = "ts timestamp, run_id long, seat long, phase string, call_id long, cost double, cached boolean"


def files(spark, parts, schema):
    """A stream whose micro-batches are the parts, in order."""
    folder = work_folder(spark, "files")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files come in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def at(spark, minutes):
    return spark.range(1).select((F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.lit(minutes))).alias("t")).first().t


@pytest.fixture(scope="module")
def minute(spark):
    base = at(spark, 0)
    return lambda m: base + (at(spark, 1) - base) * m


def test_budget_of_late_files_is_that_of_the_table(spark, minute):
    r = random.Random(3)
    calls = [(minute(m), m % 4 if m % 9 else None, m % 3, r.choice(["a", "b"]), m, round(r.random() * 9, 2), r.random() < 0.2) for m in range(300)]
    parts = [[], [], []]
    for c in calls:  # up to 50 minutes late
        parts[min(2, (c[4] + r.choice([0, 0, 45])) // 100)].append(c)
    for p in parts:
        r.shuffle(p)
    caps = {0: 40.0, 1: 25.0, 2: 0.0}
    for mode in ("stop", "warn"):
        got = t.finished(files(spark, parts, CALLS), lambda s: t.stream_budget(s, caps, mode, ("b",), late="60 minutes")).collect()
        want = enforce_budget(spark.createDataFrame(calls, CALLS), caps, mode, run_phases=("b",)).collect()
        columns = ("run_id", "seat", "call_id", "spent_before", "refused", "warned", "ends")
        assert sorted((tuple(x[c] for c in columns) for x in got), key=str) == sorted((tuple(x[c] for c in columns) for x in want), key=str)


def test_spend_is_forgotten_after_the_time_to_live_and_no_state_stays(spark, minute):
    calls = [(minute(m), 1, 1, "a", m, 6.0, False) for m in (0, 1, 2, 100, 101, 300)]
    done = []
    real = t._run
    t._run = lambda stream, out, state, mode: done.append(state) or real(stream, out, state, mode)
    try:
        rows = t.finished(files(spark, [calls[:2], calls[2:4], calls[4:]], CALLS), lambda s: t.stream_budget(s, 10.0, late="5 minutes", ttl="90 minutes")).collect()
    finally:
        t._run = real
    assert sorted((x.call_id, x.spent_before, x.refused) for x in rows) == [(0, 0.0, False), (1, 6.0, True), (2, 12.0, True), (100, 0.0, False), (101, 6.0, True), (300, 0.0, False)]
    for name in ("state", "times", "waiting"):
        with t.state_on_disk(spark):
            assert spark.read.format("statestore").option("stateVarName", name).load(done[0]).count() == 0


def test_changes_by_time_whatever_the_files(spark, minute):
    rows = [(minute(m), m % 5, m, "x" if (m // 20) % 2 else "y") for m in range(100)] + [(minute(100), None, 100, None), (minute(101), None, 101, "z")]
    parts = [rows[50:], rows[:50]]
    got = {(x.id, x.seq): x.status for x in t.finished(files(spark, parts, "ts timestamp, id long, seq long, text string"), lambda s: t.stream_changes(s, late="3 hours")).collect()}
    want = {(i, 20 * k + i): "CHANGED" if k else "NEW" for i in range(5) for k in range(5)} | {(None, 100): "NEW", (None, 101): "CHANGED"}
    assert got == want


def test_gate_writes_each_row_once_however_often_a_batch_is_played(spark):
    hosts, schema = ["a.org"], "payload_id long, path string, url string, payload string"
    rows = [(1, "a.txt", "https://a.org/x", "fine"), (2, "b/.env", "https://a.org/x", "fine"), (3, "c.txt", "https://a.org", "mail to jo.smith@corp.io now\nand ann.lee@corp.io"), (4, "d.txt", "https://evil.a.org/", "fine"), (5, None, "https://a.org", "fine"), (6, "e.txt", "http://a.org", "fine")]
    batch, folder = spark.createDataFrame(rows, schema), work_folder(spark, "gate")
    t.put_gated(batch, 7, folder, [], hosts)
    t.put_gated(batch, 7, folder, [], hosts)

    def held(folder, name):
        return sorted(tuple(x)[:2] for x in t.gate_table(spark, folder, name).collect())

    want = {"passed": [(1, "https://a.org/x")], "ledger": [(1, "a.org")], "quarantine": [(2, "denied_path"), (3, "forbidden_pattern"), (3, "forbidden_pattern"), (4, "host_not_pinned"), (5, "denied_path"), (6, "host_not_pinned")]}
    assert {n: held(folder, n) for n in t.SINKS} == want
    # a batch that breaks off between its writes is played again by the next start
    other, write = work_folder(spark, "gate"), t.put_gated
    stream = files(spark, [rows[:3], rows[3:]], schema)
    t.put_gated = lambda b, n, *a: (_ for _ in ()).throw(OSError("lost")) if n == 1 and write(b, n, *a) is None else write(b, n, *a)
    try:
        with pytest.raises(Exception, match="lost"):
            t.gate_to_tables(stream, other, [], hosts).awaitTermination()
    finally:
        t.put_gated = write
    t.gate_to_tables(stream, other, [], hosts).awaitTermination()
    assert {n: held(other, n) for n in t.SINKS} == want


def test_sessions_merge_and_late_rows_go(spark, minute):
    first = [(minute(m), "d", 10) for m in (0, 5, 30, 35)]
    second = [(minute(18), "d", 1), (minute(90), "d", 2)]  # joins both sessions
    parts = [first, second, [(minute(200), "d", 4)], [(minute(3), "d", 100)]]  # the last is behind the watermark
    schema = "ts timestamp, destination string, bytes long"
    got = sorted((str(x.session_start)[11:16], str(x.session_end)[11:16], x.calls, x.bytes) for x in t.finished(files(spark, parts, schema), lambda s: t.egress_sessions(s, "15 minutes", "20 minutes")).collect())
    assert got == [("00:00", "00:50", 5, 41), ("01:30", "01:45", 1, 2), ("03:20", "03:35", 1, 4)]
    sliding = t.finished(files(spark, parts, schema), lambda s: t.egress_windows(s, "20 minutes", "20 minutes", "10 minutes")).collect()
    assert sum(x.bytes for x in sliding) == 2 * 47 and len({x.window_start for x in sliding}) == len(sliding)
