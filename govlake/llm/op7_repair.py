"""Token ids in Re-Pair compressed shards with random access."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from govlake.llm.arrays import chunks, list_array, ragged
from govlake.llm.op5_token_counts import added_tokens, by_pieces, classes, encoded_whole, pieces, rows_with, tokenizer, vocabulary_path, worker_cache
from govlake.llm.segments import SPACE
from govlake.llm.store import saved, small_batches

END_ID = 2
BLOCK_IDS = 1 << 19
#: A pair gets a rule while it occurs so often: a rule takes 8 bytes of a shard, each use saves 2.
LEAST = 16
#: Symbols are the vocabulary's ids, then the rules: 16-bit numbers if so many rules at least find room there, else 32-bit ones.
NARROW, ROOM = 1 << 16, 1 << 12

#: One row is one shard: rule k replaces the pair (left[k], right[k]) and stands for length[k] ids. Symbols and pairs are numbers of `width` bytes.
SHARD = "part int, block int, first_rule int, width int, n_ids long, doc_ids array<long>, counts binary, offsets binary, pairs binary, lengths binary, symbols binary"


def symbol_space(first_rule: int) -> tuple[int, type]:
    """(number of symbols, type of their numbers) for a vocabulary of first_rule ids."""
    return (NARROW, np.uint16) if first_rule + ROOM <= NARROW else (1 << 31, np.uint32)


def _ranked(key: np.ndarray, turn: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, own, rank): buckets of pairs by a hash that changes with the turn, whether a pair is the one that its bucket
    counts, and a number per bucket that is 0 below `least` and else the higher the commoner its pair is, without ties."""
    bits = max(8, (len(key) // 2).bit_length())
    factor = np.uint64(0x9E3779B97F4A7C15 + 0x2000326 * turn)
    bucket = ((key.view(np.uint64) * factor) >> np.uint64(64 - bits)).view(np.int64)
    holder = np.zeros(1 << bits, np.int64)
    holder[bucket] = key
    own = holder.take(bucket) == key
    count = np.bincount(bucket, own, 1 << bits).astype(np.int64)
    return bucket, own, np.where(count >= least, (count << bits) | np.arange(1 << bits), 0)


def _winners(at: np.ndarray, rank: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Indices of the places `at` (with the place of the next symbol) that are replaced now: those of pairs that rank above the
    pairs that overlap them, and in a run of one pair every second."""
    touch = after[:-1] == at[1:]
    step = np.where(touch, rank[1:] - rank[:-1], 0)
    win = np.ones(len(at), bool)
    win[:-1] &= step <= 0
    win[1:] &= step >= 0
    same = np.flatnonzero(touch & (step == 0))
    if len(same):
        run = np.unique(np.concatenate([same, same + 1]))
        begin = np.ones(len(run), bool)
        begin[1:] = (np.diff(run) > 1) | (rank[run[1:]] != rank[run[:-1]])
        first = np.flatnonzero(begin)
        win[run[(np.arange(len(run)) - np.repeat(first, np.diff(np.append(first, len(run))))) % 2 == 1]] = False
    return np.flatnonzero(win)


def compress(ids: np.ndarray, last: np.ndarray, first_rule: int, least: int = LEAST):
    """(symbols, last, pairs, lengths): ids with frequent neighbour pairs replaced by rules until no pair occurs `least` times, or no symbol is left.

    `last` marks where documents end; no pair crosses that. In each turn the locally commonest pairs are replaced
    wherever they stand. Only pairs beside a replacement, and common ones that had to give way, can be common
    in the next turn, so later turns look at few places. Symbols stay in place and point at the next one.
    """
    space, kind = symbol_space(first_rule)
    s, last = ids.astype(np.int64), last.copy()
    n = len(s)
    after, before = np.arange(1, n + 1), np.arange(-1, n)
    alive, mark = np.ones(n, bool), np.zeros(n + 1, bool)
    rules, size = [np.zeros((0, 2), np.int64)], np.ones(first_rule, np.int64)
    where, turn = np.flatnonzero(~last), 0
    while len(where) and len(size) < space:
        key, turn = (s.take(where) << 32) | s.take(after.take(where)), turn + 1
        bucket, own, rank = _ranked(key, turn, least)
        own_rank = np.where(own, rank.take(bucket), 0)
        hits = np.flatnonzero(own_rank)
        if not len(hits):  # pairs that met another one in their bucket are left: count them exactly
            _, back, times = np.unique(key[~own], return_inverse=True, return_counts=True)
            where = where[~own][times[back] >= least]
            continue
        at = where.take(hits)
        won = _winners(at, own_rank.take(hits), after.take(at))
        place, bucket_won = at.take(won), bucket.take(hits.take(won))
        used = np.bincount(bucket_won, minlength=len(rank))
        chosen = np.flatnonzero(used)
        if len(chosen) > space - len(size):
            chosen = np.sort(chosen[np.argsort(-used[chosen], kind="stable")[: space - len(size)]])
            fits = np.zeros(len(rank), bool)
            fits[chosen] = True
            place, bucket_won = place[fits[bucket_won]], bucket_won[fits[bucket_won]]
        gone, one, name = after.take(place), np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        one[bucket_won] = place  # a place of each pair
        name[chosen] = len(size) + np.arange(len(chosen))
        left, right = s[one[chosen]], s[after[one[chosen]]]
        rules.append(np.stack([left, right], axis=1))
        size = np.concatenate([size, size[left] + size[right]])
        s[place], last[place], alive[gone] = name.take(bucket_won), last.take(gone), False
        beyond = after.take(gone)
        after[place] = beyond
        before[beyond] = place  # beyond the last place stands a spare one
        mark[at] = mark[where[~own]] = mark[before.take(place)] = True  # before the first place stands -1, the spare mark
        mark[gone] = mark[-1] = False
        where = np.flatnonzero(mark)
        mark[where] = False
        where = where[~last.take(where)]
    return s[alive].astype(kind), last[alive], np.concatenate(rules).astype(kind), size[first_rule:].astype(np.uint32)


def _rule_ids(pairs: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, begin, length): the ids of every symbol; an id stands for itself, a rule for those of both its symbols."""
    s = np.arange(first_rule, first_rule + len(pairs), dtype=np.int64)
    owner, pairs = np.arange(len(pairs)), pairs.astype(np.int64)
    while (rule := np.flatnonzero(s >= first_rule)).size:
        width = 1 + (s >= first_rule)
        at = (np.cumsum(width) - width)[rule]
        out, owner = np.repeat(s, width), np.repeat(owner, width)
        out[at], out[at + 1] = pairs[s[rule] - first_rule].T
        s = out
    length = np.concatenate([np.ones(first_rule, np.int64), np.bincount(owner, minlength=len(pairs))])
    return np.concatenate([np.arange(first_rule), s]).astype(np.uint32), np.cumsum(length) - length, length


def expand(symbols: np.ndarray, pairs: np.ndarray, first_rule: int) -> np.ndarray:
    """The ids that the symbols stand for."""
    ids, begin, length = _rule_ids(pairs, first_rule)
    return ids[ragged(begin[symbols], length[symbols])]


def _arrays(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and pairs of a shard's row."""
    kind = np.uint16 if row["width"] == 2 else np.uint32
    return np.frombuffer(row["symbols"], kind), np.frombuffer(row["pairs"], kind).reshape(-1, 2)


def read_ids(row: dict, position: int, n: int) -> np.ndarray:
    """ids position .. position + n - 1 of one document of a shard, expanding only the symbols they lie in.

    row: a shard's row with `document`, the document's index in it.
    """
    symbols, pairs = _arrays(row)
    offsets, lengths = np.frombuffer(row["offsets"], np.uint32), np.frombuffer(row["lengths"], np.uint32)
    own = symbols[offsets[row["document"]] : offsets[row["document"] + 1]].astype(np.int64)
    rule = own >= row["first_rule"]
    width = np.ones(len(own), np.int64)
    width[rule] = lengths[own[rule] - row["first_rule"]]
    end = np.cumsum(width)
    lo, hi = np.searchsorted(end, position, "right"), np.searchsorted(end, position + n - 1, "right") + 1
    before, out = int(end[lo] - width[lo]) if lo < len(own) else 0, []
    left = own[lo:hi][::-1].tolist()
    while left:  # only the rules met on the way down are opened
        x = left.pop()
        if x < row["first_rule"]:
            out.append(x)
        else:
            left += pairs[x - row["first_rule"]][::-1].tolist()
    return np.array(out, np.uint32)[position - before : position - before + n]


def token_ids(path: str, kinds: np.ndarray, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, one row after the other, and the rows' numbers of ids) of a chunk's texts, as the library has them."""
    if not by_pieces(path):
        rows = encoded_whole(path, data, at)
        return np.concatenate(rows), np.array([len(x) for x in rows])
    cache = worker_cache(path)
    points, begin, end, hashes, row = pieces(data, at, kinds)
    slots = cache.slots(hashes, points, begin, end, kinds[points[end - 1]] == SPACE)
    flat, n = cache.ids(slots), np.diff(np.concatenate([[0], np.cumsum(cache.length[slots])])[row])
    special = rows_with(data, at, added_tokens(path))
    if special:
        rows = np.split(flat, np.cumsum(n)[:-1])
        for i in special:
            rows[i] = encoded_whole(path, data, at[i : i + 2])[0]
        flat, n = np.concatenate(rows), np.array([len(x) for x in rows])
    return flat, n


def _shards(path: str, end_id: int, kinds, block_ids: int):
    def block(number: int, docs: list, parts: list, counts: list) -> pa.RecordBatch:
        first_rule = max(end_id + 1, tokenizer(path).get_vocab_size())
        ids, n = np.concatenate(parts), np.concatenate(counts)
        last = np.zeros(len(ids), bool)
        last[np.cumsum(n) - 1] = True
        symbols, last, pairs, lengths = compress(ids, last, first_rule)
        offsets = np.concatenate([[0], np.flatnonzero(last) + 1]).astype(np.uint32)
        values = [TaskContext.get().partitionId(), number, first_rule, symbols.itemsize, len(ids), docs, n.astype(np.uint32).tobytes(), offsets.tobytes(), pairs.tobytes(), lengths.tobytes(), symbols.tobytes()]
        types = [pa.int32()] * 4 + [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]
        names = [x.split()[0] for x in SHARD.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

    def run(batches):
        number, docs, parts, counts, held = 0, [], [], [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, data, at in chunks(batch.column(1), 1 << 19):
                flat, n = token_ids(path, kinds.value, data, at)
                parts.append(np.insert(flat, np.cumsum(n), end_id))
                counts.append(n + 1)
                docs.extend(ids[lo:hi])
                held += len(parts[-1])
                if held >= block_ids:
                    yield block(number, docs, parts, counts)
                    number, docs, parts, counts, held = number + 1, [], [], [], 0
        if docs:
            yield block(number, docs, parts, counts)

    return run


def write_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Rows of SHARD: the ids of every text with end_id behind each, in ascending order of id_col over (part, block).

    Texts are dealt to parts by ranges of the id; a shard closes when it holds block_ids ids, so a task's memory doesn't
    grow with its part. Write it with any of Spark's writers. A null or empty text has end_id alone; null
    ids come first; rows that repeat an id follow each other, in the order of their texts. Ids beyond 16 bits widen a shard's symbols.
    """
    path = path or vocabulary_path("byte_bpe_50k.json")
    kinds = docs.sparkSession.sparkContext.broadcast(classes())
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(_shards(path, end_id, kinds, block_ids), SHARD)


def _read(batches):
    """(row of the shard, ids, where each document's ids begin, and the end) of shards."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = expand(*_arrays(row), row["first_rule"])
            yield row, ids, np.concatenate([[0], np.cumsum(np.frombuffer(row["counts"], np.uint32).astype(np.int64))])


def read_shards(shards: DataFrame) -> DataFrame:
    """(part, block, id, at, ids) per document; `at` counts the ids of the shard before it."""

    def run(batches):
        for row, ids, at in _read(batches):
            n = np.diff(at)
            step = max(1, len(n) * (1 << 20) // max(1, len(ids)))
            for i in range(0, len(n), step):
                j = min(i + step, len(n))
                place = [pa.array(np.full(j - i, row[c], np.int32)) for c in ("part", "block")]
                lists = list_array(ids[at[i] : at[j]].astype(np.int32), n[i:j], pa.int32())
                yield pa.RecordBatch.from_arrays([*place, pa.array(row["doc_ids"][i:j], pa.int64()), pa.array(at[i:j]), lists], ["part", "block", "id", "at", "ids"])

    return shards.mapInArrow(run, "part int, block int, id long, at long, ids array<int>")


def read_checksums(shards: DataFrame) -> DataFrame:
    """(part, block, id, at, n_tokens, ids_crc32) per document, from its ids as read_shards gives them, which don't leave the
    task; the sum is over little-endian unsigned 32-bit ids."""

    def run(batches):
        for row, ids, at in _read(batches):
            raw, at4 = memoryview(ids.astype("<u4").tobytes()), (4 * at).tolist()
            sums = [zlib.crc32(raw[a:b]) for a, b in zip(at4[:-1], at4[1:], strict=True)]
            place = [pa.array(np.full(len(sums), row[c], np.int32)) for c in ("part", "block")]
            yield pa.RecordBatch.from_arrays([*place, pa.array(row["doc_ids"], pa.int64()), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(sums, pa.int64())], ["part", "block", "id", "at", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(run, "part int, block int, id long, at long, n_tokens long, ids_crc32 long")


def with_start(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """rows of read_shards or read_checksums with `start`, the number of ids of all documents before, for `at`."""
    sizes = shards.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("block")) - F.col("n_ids")
    starts = sizes.withColumn("inside", inside).join(before, "part").select("part", "block", (F.col("before") + F.col("inside")).alias("start"))
    return rows.join(starts, ["part", "block"]).withColumn("start", F.col("start") + F.col("at")).drop("part", "block", "at")


def op7_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents as shards, reads them back and gives each document's place, length and checksum."""
    shards = saved(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet")), "shards")
    return with_start(read_checksums(shards), shards).withColumnRenamed("id", "doc_id")
