"""Removal of word windows that repeat anywhere in the corpus, found by difference-cover anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from govlake.llm.arrays import U, chunks, mix64, prefix, spans, words
from govlake.llm.store import bounded, saved, small_batches

WINDOW = 35
#: Perfect difference covers (fixed values): each residue modulo the period is a difference of two members.
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14)}
WHOLE, ALL = -1, -2
#: place holds, from the low end, 16 bits more of the hash, a bit for keys known to occur twice, and the position. The
#: columns stand in this order so that what a row shares with the row before lies together and packs well.
_ROWS = "key long, place long, id long"
_TAG, _TWICE, _POSITION = (1 << 16) - 1, 1 << 16, 17


def period_of(window: int) -> int:
    """The longest period that leaves anchors of at least two fifths of the window."""
    fit = [p for p in COVERS if 5 * (window - p + 1) >= 2 * window]
    if not fit:
        raise ValueError(f"a window of {window} words is too short")
    return max(fit)


def _gathered(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """One row per hash, with what a batch already knows: of equal hashes the first stands for all (many = 2),
    the others are repeats for certain and go under keys of their own, so no key brings many rows to one place."""
    key, tag, ids, pos, many = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, t) for t in (U, np.int32, np.int64, np.int32, np.int32))
    _, first, group, size = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    again = np.ones(len(key), bool)
    again[first] = False
    own = mix64(key ^ mix64(ids.astype(U) * U(0x9E3779B97F4A7C15) + pos.astype(U)) + np.arange(len(key), dtype=U))
    many = np.where(size[group] > 1, 2, many).astype(np.int32)
    key = np.where(again, own, key).view(np.int64)
    place = ((pos.astype(np.int64) - ALL) << _POSITION) | np.where(many > 1, _TWICE, 0) | (tag.astype(np.int64) & _TAG)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(place), pa.array(ids)], ["key", "place", "id"])


def _anchors(window: int):
    """Hashes of the anchor windows at cover positions of each text, and of each whole text."""
    period = period_of(window)
    size = window - period + 1
    cover = np.zeros(period, bool)
    cover[list(COVERS[period])] = True

    def run(batches):
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(zero_copy_only=False), []
            for lo, hi, data, at in chunks(batch.column(1)):
                w = words(data, at)
                n = w.counts
                place = np.arange(len(w.hash)) - np.repeat(w.first[:-1], n)
                here = np.flatnonzero(cover[place % period] & (w.room() >= size) & np.repeat(n >= window, n))
                parts.append((w.windows(size)[here], np.zeros(len(here), np.int32), np.repeat(ids[lo:hi], n)[here], place[here].astype(np.int32), np.ones(len(here), np.int32)))
                long = np.flatnonzero(n >= window)
                whole = spans(prefix(mix64(w.hash ^ U(0x3C6EF372FE94F82B))), w.first[long], w.first[long + 1])
                parts.append((whole, np.zeros(len(long), np.int32), ids[lo:hi][long], np.full(len(long), WHOLE, np.int32), np.ones(len(long), np.int32)))
            yield _gathered(parts)

    return run


def _candidates(window: int):
    """Hashes of the windows that hold a repeated anchor. Of equal whole texts only one gives windows (as repeated ones)."""
    period = period_of(window)

    def run(batches):
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(zero_copy_only=False), []
            copy = batch.column(2).to_numpy(zero_copy_only=False)
            lists = batch.column(3)
            begin, places = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            whole = np.flatnonzero(copy > 0)
            flat = mix64(ids[whole].astype(U) + U(0x5BE0CD19137E2179))
            parts.append((flat, np.zeros(len(whole), np.int32), ids[whole], np.full(len(whole), ALL, np.int32), np.full(len(whole), 2, np.int32)))
            for lo, hi, data, at in chunks(batch.column(1)):
                w = words(data, at)
                n = w.counts
                held = np.diff(begin)[lo:hi]
                row = np.repeat(np.arange(hi - lo), held)
                p = places[begin[lo] : begin[hi]]
                marks = np.zeros(len(w.hash) + 1, np.int32)  # where runs of candidate starts begin and end
                np.add.at(marks, w.first[row] + np.maximum(p - period + 1, 0), 1)
                np.add.at(marks, w.first[row] + p + 1, -1)
                of = np.repeat(np.arange(hi - lo), n)
                here = np.flatnonzero((np.cumsum(marks[:-1]) > 0) & (w.room() >= window) & (copy[lo:hi][of] < 2))
                of = of[here]
                pos = (here - w.first[of]).astype(np.int32)
                known = copy[lo:hi][of] == 1
                parts.append((w.windows(window)[here], (w.windows(window, 7)[here] >> U(48)).astype(np.int32), ids[lo:hi][of], np.where(known, WHOLE, pos).astype(np.int32), np.where(known, 2, 1).astype(np.int32)))
            yield _gathered(parts)

    return run


def _without(window: int):
    """Each text without the words that the windows starting at `starts` cover."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            begin, starts = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            texts, n_words, n_removed = [], [], []
            for lo, hi, data, at in chunks(batch.column(1)):
                raw = data.tobytes()
                for row in range(lo, hi):
                    found = raw[at[row - lo] : at[row - lo + 1]].split()  # bytes split at the six ASCII spaces
                    own = starts[begin[row] : begin[row + 1]]
                    n_words.append(len(found))
                    if len(own) and own.min() == ALL:
                        kept = []
                    elif len(own):
                        marks = np.zeros(len(found) + 1, np.int64)
                        np.add.at(marks, own, 1)
                        np.add.at(marks, own + window, -1)
                        kept = [x for x, c in zip(found, np.cumsum(marks[:-1]).tolist(), strict=True) if not c]
                    else:
                        kept = found
                    n_removed.append(len(found) - len(kept))
                    texts.append(b" ".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "text"])

    return run


def _repeated(rows: DataFrame, tagged: bool = True) -> DataFrame:
    """(id, pos, least) of rows whose hash occurs elsewhere; least is the smallest id there.

    Window functions take bare columns, as Spark would send expressions along in the shuffle. Keys under which
    tags differ, a 64-bit collision, are looked at again by tag.
    """
    place, has = F.col("place"), lambda c, bit: F.col(c).bitwiseAND(F.lit(bit))
    same = W.partitionBy("key")
    told = rows.select("key", "place", "id", F.count("*").over(same).alias("n"), F.bit_or("place").over(same).alias("any"), F.bit_and("place").over(same).alias("all"), F.min("id").over(same).alias("least"))
    more = told.where((F.col("n") > 1) | (has("any", _TWICE) > 0))
    if not tagged:
        return more.select("id", (F.shiftright(place, _POSITION) + ALL).cast("int").alias("pos"), "least")
    alike = has("any", _TAG) == has("all", _TAG)
    by_tag = W.partitionBy("key", "tag")
    mixed = more.where(~alike).select("key", "place", "id", has("place", _TAG).alias("tag"))
    mixed = mixed.select("place", "id", F.count("*").over(by_tag).alias("n"), F.bit_or("place").over(by_tag).alias("any"), F.min("id").over(by_tag).alias("least"))
    sure = more.where(alike).select("id", "place", "least").unionByName(mixed.where((F.col("n") > 1) | (has("any", _TWICE) > 0)).select("id", "place", "least"))
    return sure.select("id", (F.shiftright(place, _POSITION) + ALL).cast("int").alias("pos"), "least")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id_col, n_words, n_removed, text): each text without every word that a repeated window of `window` words covers.

    Windows of `window - period + 1` words are hashed at the positions whose index modulo the period is in
    a difference cover. Two equal windows of `window` words, wherever they start, hold such an anchor at
    the same offset, so windows without a repeated anchor are unique. The others are hashed whole (80
    bits) and counted. Texts that equal another from end to end lose all words and only one of them
    gives windows.

    The kept words are joined by one space. Null, empty and short texts keep what words they have.
    Windows are judged on the input; a window that repeats within one text counts. A row repeated
    with its id is a repeat like any other; rows that share an id but not a text are told apart by a hash of both, rows
    without an id, which stays null, by one of their text. Other columns aren't read.
    """
    own, text = F.col(id_col).cast("long"), F.col(text_col)
    texts = small_batches(docs).select(F.coalesce(own, F.xxhash64(text)).alias("id"), text.alias("text"), own.alias("own"))
    twice = saved(texts.select("id").groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("twice")), "twice")
    if not twice.isEmpty():  # a number of their own for each id and text
        texts = texts.join(bounded(twice), "id", "left").select(F.when(F.col("twice"), F.xxhash64("id", "text")).otherwise(F.col("id")).alias("id"), "text", "own")
    anchors = _repeated(texts.select("id", "text").mapInArrow(_anchors(window), _ROWS), tagged=False)
    copy = F.max(F.when(F.col("pos") == WHOLE, F.when(F.col("id") == F.col("least"), 1).otherwise(2)).otherwise(0))
    places = anchors.groupBy("id").agg(copy.alias("copy"), F.collect_list(F.when(F.col("pos") >= 0, F.col("pos"))).alias("places"))
    windows = _repeated(texts.join(places, "id").select("id", "text", "copy", "places", "own").mapInArrow(_candidates(window), _ROWS))
    starts = windows.where(F.col("pos") != WHOLE).groupBy("id").agg(F.collect_list("pos").alias("starts"))
    told = texts.join(starts, "id", "left").select("id", "text", F.coalesce("starts", F.array().cast("array<int>")).alias("starts"), "own")
    out = told.mapInArrow(_without(window), "id long, n_words long, n_removed long, text string")
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "text")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
