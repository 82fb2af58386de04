"""Structured Streaming jobs: gate, budget, changes, progress, windows and first sightings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from govlake.functions.folders import work_folder
from govlake.operators.redact import gated, quarantined

#: Later than any row: where a finite input ends.
END = "2200-01-01 00:00:00"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, which lists and timers need."""
    name, own = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, own)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _run(stream: DataFrame, out: str, state: str, mode: str) -> None:
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # idempotent: a repeated batch replaces itself

    with state_on_disk(stream.sparkSession):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows that a stream gives for all input there is now, through a Parquet sink in a shared folder."""
    spark = stream.sparkSession
    out = work_folder(spark, "stream-out")
    _run(stream, out, work_folder(spark, "stream-state"), mode)
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(out)
    if mode == "complete":  # each batch holds the whole result
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.where(F.col("batch") == last)
    return rows.drop("batch")


def finished(source: DataFrame, job: Callable[[DataFrame], DataFrame], at: str = "ts") -> DataFrame:
    """The rows that job(source) gives in append mode for a stream that has come to its end.

    When all input has been read, one more row arrives, all null but its time END, so that the watermark passes all others and what waits for it comes out.
    """
    spark = source.sparkSession
    end, out, state = (work_folder(spark, f"stream-{n}") for n in ("end", "out", "state"))
    nulls = [F.lit(END if f.name == at else None).cast(f.dataType).alias(f.name) for f in source.schema]
    last = spark.range(1).select(*nulls)
    last.limit(0).write.parquet(end)
    stream = job(source.unionByName(spark.readStream.schema(source.schema).parquet(end)))
    _run(stream, out, state, "append")
    last.write.mode("append").parquet(end)
    _run(stream, out, state, "append")
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(out).drop("batch")


def stream_gate(payloads: DataFrame, globs: list[str], hosts: list[str]) -> DataFrame:
    """The gate's verdicts (payload_id, verdict, n_hits) on a stream of payloads (payload_id, path, url, payload)."""
    return gated(payloads, globs, hosts).select("payload_id", "verdict", F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_hits"))


#: Tables that the gate writes, and their columns besides batch.
SINKS = {
    "passed": "payload_id long, url string, payload string",
    "quarantine": "payload_id long, verdict string, rule string, pos long, line long",
    "ledger": "payload_id long, destination string, bytes long, sha256 string, path string",
}


def put_gated(batch: DataFrame, number: int, folder: str, globs: list[str], hosts: list[str]) -> None:
    """Writes what the gate makes of a batch of payloads to three tables under `folder`: passed payloads; blocked ones with the places of their hits, never their values; and the
    egress ledger, a row for each passed payload.

    Each table has one folder a batch, which a repeated batch replaces whole, so that a failure between the writes leaves no row out and none twice.
    """
    checked = gated(batch, globs, hosts).persist()
    sent = checked.where("verdict = 'pass'")
    tables = {
        "passed": sent.select("payload_id", "url", "payload"),
        "quarantine": quarantined(checked),
        "ledger": sent.select("payload_id", F.lower(F.regexp_extract("url", r"^https://([^/:?#]+)", 1)).alias("destination"), F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("sha256"), "path"),
    }
    try:
        for name, rows in tables.items():
            rows.to(_schema(batch.sparkSession, name)).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
    finally:
        checked.unpersist()


def _schema(spark: SparkSession, name: str):
    return spark.createDataFrame([], SINKS[name]).schema


def gate_to_tables(payloads: DataFrame, folder: str, globs: list[str], hosts: list[str], trigger: dict | None = None):
    """The started query that gates a stream of payloads into the three tables of `put_gated`; its progress is kept under `folder`, so that it goes on where it stopped."""
    out = payloads.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(**(trigger or {"availableNow": True}))
    return out.foreachBatch(lambda batch, number: put_gated(batch, number, folder, globs, hosts)).start()


def gate_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the tables in SINKS that a gate has written."""
    return spark.read.schema(_schema(spark, name).add("batch", "long")).parquet(f"{folder}/{name}").drop("batch")


class InOrder(StatefulProcessor):
    """Rows of a key in the order of their event time, whatever the order in which they come.

    Rows wait in a list until the watermark passes them; one timer a key stands at the earliest. Then `step(state, row)` gives the new state and
    what comes out, if anything. So a key holds the rows within the watermark's delay and one small state, which goes when the watermark
    is `ttl_ms` past the key's last row; a later row begins anew. Rows behind the watermark are dropped by Spark before they come here.
    """

    def __init__(self, row: str, state: str, first: tuple, step: Callable, columns: list[str], ttl_ms: int):
        self.row, self.state_schema, self.first, self.step, self.columns, self.ttl_ms = row, state, first, step, columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.state = handle.getValueState("state", self.state_schema)
        self.times = handle.getValueState("times", "last long, timer long")  # of the key's last row in microseconds, of its timer in milliseconds

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for pdf in rows:
            own = [tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for r in pdf.drop(columns=["ts"]).itertuples(index=False)]
            own = [r[len(key) :] for r in own]
            self.waiting.appendList(own)
            earliest = min([r[0] for r in own] + ([] if earliest is None else [earliest]))
        if earliest is not None:
            last, timer = self.times.get() if self.times.exists() else (None, None)
            if timer is None or -(-earliest // 1000) < timer:
                self._arm(last, timer, -(-earliest // 1000))
        yield pd.DataFrame(columns=self.columns)

    def _arm(self, last, old, new) -> None:
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(new)
        self.times.update((last, new))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due, rest, out = sorted(r for r in held if r[0] <= mark), [r for r in held if r[0] > mark], []
        last = self.times.get()[0] if self.times.exists() else None
        state = tuple(self.state.get()) if self.state.exists() else self.first
        for r in due:
            if last is not None and r[0] - last > self.ttl_ms * 1000:  # as if the state had gone before this row came
                state = self.first
            state, told = self.step(state, r)
            last = r[0]
            if told is not None:
                out.append((*key, *told))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        gone = not rest and (last is None or last + self.ttl_ms * 1000 <= mark)
        if gone:
            self.state.clear()
            self.times.clear()
        else:
            if due:
                self.state.update(state)
            following = min(r[0] for r in rest) if rest else last + self.ttl_ms * 1000
            self.handle.registerTimer(max(-(-following // 1000), mark // 1000 + 1))
            self.times.update((last, max(-(-following // 1000), mark // 1000 + 1)))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def _in_order(rows: DataFrame, keys: list[str], columns: dict[str, Column], row: str, late: str, ttl: str, state: str, first: tuple, step: Callable, out: str) -> DataFrame:
    """rows (ts and keys) through InOrder; columns are what a waiting row holds besides its time."""
    spark = rows.sparkSession
    ttl_ms = spark.range(1).select((F.unix_millis(F.expr(f"timestamp'1970-01-01 00:00:00Z' + interval {ttl}"))).alias("ms")).first().ms
    # Spark's Python side mixes up the groups of a batch that has null keys, so a null goes in as a zero and a mark.
    zeros = [F.lit("" if rows.schema[k].dataType.simpleString() == "string" else 0).cast(rows.schema[k].dataType) for k in keys]
    marks = [F.when(F.col(k).isNull(), 1 << i).otherwise(0) for i, k in enumerate(keys)]
    whole = [F.coalesce(k, zero).alias(k) for k, zero in zip(keys, zeros, strict=True)] + [sum(marks[1:], marks[0]).alias("nulls")]
    timed = rows.select(*whole, F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), *[c.alias(n) for n, c in columns.items()], F.col("ts").cast("timestamp").alias("ts"))
    timed = timed.withWatermark("ts", late).where(F.col("ts") < F.lit(END).cast("timestamp"))
    fields = out.split(", ")
    inner = ", ".join([*fields[: len(keys)], "nulls int", *fields[len(keys) :]])
    processor = InOrder(f"us long, {row}", state, first, step, [f.split()[0] for f in inner.split(", ")], ttl_ms)
    told = timed.groupBy(*keys, "nulls").transformWithStateInPandas(statefulProcessor=processor, outputStructType=inner, outputMode="Append", timeMode="EventTime")
    restored = {k: F.when(F.col("nulls").bitwiseAND(1 << i) == 0, F.col(k)) for i, k in enumerate(keys)}
    return told.withColumns(restored).drop("nulls")


def stream_budget(calls: DataFrame, caps: dict | float, mode: str = "degrade", run_phases: tuple[str, ...] = (), late: str = "1 hour", ttl: str = "60 days") -> DataFrame:
    """(run_id, seat, call_id, spent_before, refused, warned, ends) live, as `enforce_budget` has them: calls (ts, run_id, seat, phase, call_id, cost, cached) of a run and seat
    in the order of their times, each told when the watermark, `late` behind the newest call, has passed it; calls that come later than that are dropped.

    caps: one of all seats or by seat, 0 or less or absent for none; modes degrade, stop and warn. What a run and seat have spent is forgotten `ttl` after their last call.
    """

    def step(state: tuple, call: tuple) -> tuple[tuple, tuple]:
        spent, breached = state
        _, call_id, cost, cached, phase, cap = call
        over = not cached and cap is not None and spent + cost > cap
        first, breached = over and not breached, breached or over
        ends = ("run" if phase in run_phases else "phase") if mode == "stop" and first else None
        told = (call_id, round(spent, 6), bool(mode != "warn" and breached and not cached), bool(mode == "warn" and over), ends)
        return (spent if cached else spent + cost, bool(breached)), told

    cap = F.lit(None).cast("double")
    for name, most in (caps if isinstance(caps, dict) else {None: caps}).items():
        cap = F.when(F.lit(True) if name is None else F.col("seat") == name, float(most) if most > 0 else None).otherwise(cap)
    columns = {"call_id": F.coalesce("call_id", F.lit(-1)), "cost": F.col("cost").cast("double"), "cached": F.coalesce("cached", F.lit(False)), "phase": F.col("phase").cast("string"), "cap": cap.cast("double")}
    run, seat = calls.schema["run_id"].dataType.simpleString(), calls.schema["seat"].dataType.simpleString()
    out = f"run_id {run}, seat {seat}, call_id long, spent_before double, refused boolean, warned boolean, ends string"
    return _in_order(calls, ["run_id", "seat"], columns, "call_id long, cost double, cached boolean, phase string, cap double", late, ttl, "spent double, breached boolean", (0.0, False), step, out)


def stream_changes(rows: DataFrame, late: str = "1 hour", ttl: str = "60 days") -> DataFrame:
    """(id, seq, status): NEW for an id's first text, CHANGED when its hash differs from the last; rows ts, id, seq, text in the order of time and seq, told
    when the watermark has passed them. An id unseen for `ttl` is new again."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple | None]:
        _, seq, now = row
        status = "NEW" if state[0] is None else "CHANGED" if state[0] != now else None
        return (now,), None if status is None else (seq, status)

    columns = {"seq": F.coalesce("seq", F.lit(-1)), "hash": F.coalesce(F.sha2("text", 256), F.lit(""))}
    return _in_order(rows, ["id"], columns, "seq long, hash string", late, ttl, "hash string", (None,), step, f"id {rows.schema['id'].dataType.simpleString()}, seq long, status string")


def run_progress(journal: DataFrame, phases: list[str]) -> DataFrame:
    """(run_id, done, next): finished phases of each run and the first that isn't; for tables and, in update mode, streams."""
    every = F.array(*map(F.lit, phases))
    sets = journal.where("event = 'done'").groupBy("run_id").agg(F.collect_set("phase").alias("s"))
    return sets.select("run_id", F.array_join(F.sort_array("s"), ",").alias("done"), F.get(F.array_except(every, "s"), F.lit(0)).alias("next"))


def egress_windows(ledger: DataFrame, size: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(window_start, destination, calls, bytes) of windows of event time, tumbling or begun every `slide`, on a stream in append mode: a window is told once the
    watermark, `late` behind the newest row, has passed its end; rows that come after that are dropped."""
    timed = ledger.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", size, slide), "destination").agg(F.count("*").alias("calls"), F.sum("bytes").alias("bytes"))
    return out.select(F.col("window.start").alias("window_start"), "destination", "calls", "bytes")


def egress_sessions(ledger: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(session_start, session_end, destination, calls, bytes) of runs of a destination's calls less than `gap` apart; a row that joins two sessions merges them. A session
    ends `gap` after its last call and is told once the watermark has passed that."""
    timed = ledger.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.session_window("ts", gap), "destination").agg(F.count("*").alias("calls"), F.sum("bytes").alias("bytes"))
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "destination", "calls", "bytes")


def first_sightings(hits: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """One row per key within `late` of its first sighting on a stream; then its state goes, and a later sighting counts anew."""
    return hits.select(*keys, F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys).select(*keys)
