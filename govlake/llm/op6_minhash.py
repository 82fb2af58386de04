"""Near-duplicate documents by circulant MinHash, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from govlake.llm.arrays import U, chunks, lean, list_array, mix64, words, worker_state
from govlake.llm.store import bounded, components, saved, small_batches

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 40, 4
PLACES = 1 << 22
BLOCK = 512
CHUNK = 1 << 18  # bytes of text at once: their words' hashes and prefix sums take some forty times as much


def _second_permutation(coordinates: int) -> np.ndarray:
    """Rows i of a view: the second permutation of PLACES numbers, shifted circularly by 0 .. coordinates-1, at place i."""
    return worker_state(("permutation", coordinates), lambda: _shifts(coordinates))


def _shifts(coordinates: int) -> np.ndarray:
    order, low, part = np.empty(PLACES, U), U(PLACES - 1), 1 << 16
    for i in range(0, PLACES, part):  # in parts and in place: each worker makes this beside what others need
        place = np.arange(i, i + part, dtype=U)
        order[i : i + part] = (mix64(place + U(0x51ED270B)) & ~low) | place
    order.sort()
    order &= low
    ring = np.empty(PLACES + coordinates - 1, np.uint32)
    ring[:PLACES], ring[PLACES:] = order, order[: coordinates - 1]
    return np.lib.stride_tricks.sliding_window_view(ring, coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of one set. The first permutation scatters the shingles over PLACES places; coordinate k
    is the least value there of the second permutation, shifted by k."""
    shifted = _second_permutation(coordinates)
    places = np.unique((mix64(shingles ^ U(0xA0761D6478BD642F)) >> U(64 - 22)).astype(np.int64))
    least = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(places), 4096):
        np.minimum(least, shifted[places[i : i + 4096]].min(axis=0), out=least)
    return least


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit hashes of the row's shingles): `size` words each, the whole text if it has fewer."""
    for lo, hi, data, at in chunks(column, CHUNK):
        w = words(data, at, lower=True)
        hashes = w.windows(size)
        for row in range(lo, hi):
            first, last = w.first[row - lo], w.first[row - lo + 1]
            yield row, np.unique(hashes[first : max(last - size + 1, min(first + 1, last))])


def band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of neighbouring coordinates, different in each band."""
    key = mix64(np.arange(1, bands + 1, dtype=U) << U(40))
    for column in least.reshape(bands, -1).T:
        key = mix64(key ^ column.astype(U)) * U(0x9E3779B97F4A7C15)
    return key


def sketches(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, k1, k2, bands) per row. k1 and k2 are a 128-bit hash of the set; a row without words has n_shingles 0."""

    def run(batches):
        for batch in batches:
            n, k1, k2, keys = [], [], [], []
            for _, found in shingle_sets(batch.column(1)):
                n.append(len(found))
                k1.append(int(mix64(found ^ U(0x243F6A8885A308D3)).sum().astype(np.int64)))
                k2.append(int(mix64(found ^ U(0x13198A2E03707344)).sum().astype(np.int64)))
                if len(found):
                    keys.append(band_keys(signature(found, bands * rows), bands))
            lengths = np.where(np.array(n, np.int64) > 0, bands, 0)
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), list_array(flat, lengths, pa.int64())], ["id", "n_shingles", "k1", "k2", "bands"])

    kept = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(lean(run), "id long, n_shingles long, k1 long, k2 long, bands array<long>")


def sets_of(docs: DataFrame) -> DataFrame:
    """(id, shingles) for rows (id, text)."""

    def run(batches):
        for batch in batches:
            found = [s for _, s in shingle_sets(batch.column(1))]
            flat = np.concatenate(found) if found else np.zeros(0, U)
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(flat.view(np.int64), np.array([len(s) for s in found], np.int64), pa.int64())], ["id", "shingles"])

    return docs.select("id", "text").mapInArrow(lean(run), "id long, shingles array<long>")


def _is_link(both, a, b, percent: int):
    return 100 * both >= percent * (a + b - both)


def links_in_block(table: pa.Table, percent: int = PERCENT) -> pa.Table:
    """Links between the components of the left and the right rows of one block."""
    rows = {c: table.column(c).combine_chunks() for c in table.column_names}
    left = rows["left"].to_numpy(zero_copy_only=False)
    component = rows["component"].to_numpy()
    at, flat = rows["shingles"].offsets.to_numpy(), rows["shingles"].values.to_numpy()
    right = np.flatnonzero(~left)
    pairs = set()
    if len(right) and left.any():
        sizes = np.diff(at)
        members = np.concatenate([flat[at[i] : at[i + 1]] for i in right])
        vocabulary, place = np.unique(members, return_inverse=True)
        begin = np.cumsum(sizes[right]) - sizes[right]
        for i in np.flatnonzero(left):
            own = flat[at[i] : at[i + 1]]
            where = np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
            mark = np.zeros(len(vocabulary), np.int64)
            mark[where[vocabulary[where] == own]] = 1
            both = np.add.reduceat(mark[place], begin)
            linked = _is_link(both, len(own), sizes[right], percent) & (component[right] != component[i])
            pairs.update((int(component[i]), int(x)) for x in np.unique(component[right[linked]]))
    return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) per row of docs.

    1. Every text gives its circulant MinHash signature, cut into `bands` keys; equal sets collapse to
       the smallest id, so copies are never paired.
    2. In each bucket of a band every set is paired with the bucket's smallest id only. Pairs are
       confirmed on the full sets, a hub's sets in parts of BLOCK; components follow.
    3. Sets that share such a smallest id but fell into different components are compared in blocks of
       BLOCK x BLOCK sets, all but the largest component against all. So every pair that shares a
       bucket is in one component or has been compared; only links between components leave a block.

    Null and empty texts have n_shingles 0, are linked with nothing and kept. Rows that repeat an id
    give one result each; if their texts differ the id is one document, linked wherever one of its texts is.
    A row with a null id is linked with nothing and kept. Ties go to the smallest id. Other columns of docs aren't touched. A pair of
    similarity s shares no bucket with probability (1 - s**rows)**bands: 2.5e-7 at 0.75.
    """
    drawn = saved(sketches(docs, id_col, text_col, bands, rows), "sketches")
    full = drawn.where("n_shingles > 0 and id is not null")
    groups = saved(full.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "groups")
    several = saved(full.groupBy("id").agg(F.min(F.struct("k1", "k2")).alias("a"), F.max(F.struct("k1", "k2")).alias("b")).where("a <> b").select("id"), "several")
    reps = full.join(groups.select("k1", "k2", F.col("rep").alias("id")), ["k1", "k2", "id"], "left_semi").dropDuplicates(["id", "k1", "k2"])
    entries = reps.select("id", F.explode("bands").alias("key"))
    hubs = entries.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").drop("last")
    spokes = saved(entries.join(hubs, "key").select("id", "hub").distinct(), "spokes")
    wanted = saved(spokes.select("id").distinct(), "wanted")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(bounded(wanted), "id", "left_semi")
    texts = texts.withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "h"])
    sets = saved(sets_of(texts), "sets")
    sized = spokes.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    hubs = sized.select(F.col("hub").alias("id"))
    large = saved(sized.where("parts > 1"), "large")  # at most one for each BLOCK spokes; a spoke meets its hub's number of parts without a shuffle by hub
    part = F.coalesce(F.pmod(F.xxhash64("id"), "parts"), F.lit(0)).cast("int").alias("part")
    ends = sets.join(hubs, "id", "left_semi").select(F.col("id").alias("hub"), F.col("shingles").alias("other")).join(bounded(large), "hub", "left")
    ends = ends.select("hub", "other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    pairs = spokes.where("id <> hub").join(bounded(large), "hub", "left").select("id", "hub", part).join(sets, "id").join(ends, ["hub", "part"])
    both = F.size(F.array_intersect("shingles", "other"))
    stars = pairs.where(_is_link(both, F.size("shingles"), F.size("other"), percent)).select(F.col("id").alias("a"), F.col("hub").alias("b"))
    if not several.isEmpty():
        shared = full.join(several, "id", "left_semi").join(groups, ["k1", "k2"]).groupBy("id").agg(F.collect_set("rep").alias("reps"))
        stars = stars.unionByName(shared.select(F.array_min("reps").alias("a"), F.explode("reps").alias("b")))
    known = saved(components(stars).withColumnRenamed("node", "id"), "known")
    placed = saved(spokes.join(known, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")

    counts = placed.groupBy("hub", "component").agg(F.count("*").alias("n"))
    apart = counts.groupBy("hub").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    apart = saved(apart.select("hub", F.col("top.component").alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "apart")
    rows_ = placed.join(bounded(apart), "hub").join(sets, "id")
    block = F.pmod(F.xxhash64("id"), "blocks").cast("int")
    numbers = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    right = rows_.select("hub", numbers.alias("i"), block.alias("j"), F.lit(False).alias("left"), "component", "shingles")
    left = rows_.where("component <> main").select("hub", block.alias("i"), numbers.alias("j"), F.lit(True).alias("left"), "component", "shingles")
    more = saved(left.unionByName(right).groupBy("hub", "i", "j").applyInArrow(lambda t: links_in_block(t, percent), "a long, b long"), "more")

    found = known.select(F.col("id").alias("rep"), "component")
    if not more.isEmpty():  # links between components, each named by its smallest id
        last = components(more).select(F.col("node").alias("component"), F.col("component").alias("joined"))
        nodes = groups.select("rep").distinct().join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        found = nodes.join(last, "component", "left").select("rep", F.coalesce("joined", "component").alias("component"))
    classes = groups.join(found, "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    classes = classes.where("copies > 1 or component_id <> rep").select("k1", "k2", "component_id")
    out = drawn.select("id", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"], "left")
    component = F.when(F.expr("n_shingles > 0 and id is not null"), F.coalesce("component_id", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", all_texts: bool = False) -> DataFrame:
    """docs without all but the smallest id of each component. Of rows that repeat an id the one of the smallest text stays, or with all_texts one of each of its texts.
    Rows without an id all stay. Columns stay as they are, whatever their names."""
    gone = saved(near_duplicates(docs, id_col, text_col).where("not kept").select(id_col).distinct(), "gone")
    left = docs.join(gone.hint("merge"), id_col, "left_anti").select(docs.columns)
    again = saved(docs.groupBy(id_col).count().where(F.col(id_col).isNotNull() & (F.col("count") > 1)).select(id_col), "again")
    if again.isEmpty():
        return left
    rows = left.join(bounded(again), id_col, "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    order = W.partitionBy(f"row.{id_col}", f"row.{text_col}").orderBy(F.xxhash64("row")) if all_texts else W.partitionBy(f"row.{id_col}").orderBy(f"row.{text_col}")
    rows = rows.select("row", F.row_number().over(order).alias("nth"))
    first = rows.where("nth = 1").select(*[F.col("row")[c].alias(c) for c in docs.columns])
    return left.join(bounded(again), id_col, "left_anti").select(docs.columns).unionByName(first)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and verdict of every row of documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
