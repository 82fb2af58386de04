"""Token counts by a two-tier lookup of pre-token lengths, without any shuffle of pre-tokens or texts."""

from __future__ import annotations

import json
import os
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlake.llm.arrays import chunks, worker_state
from govlake.llm.segments import SPACE, SegmentCache, Table, code_point_classes, decoded, pretokens, segment_hashes
from govlake.llm.store import small_batches

TABLE_SIZE = 1 << 16
SAMPLE_ROWS = 2048
LIMIT = 512


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def tokenizer(path: str):
    os.environ.setdefault("RAYON_NUM_THREADS", "2")  # the library's threads in a worker, beside those of other tasks
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


@cache
def by_pieces(path: str) -> bool:
    """Whether the vocabulary cuts texts as `pretokens` does and nothing else changes them; texts of others are encoded whole."""
    own = tokenizer(path)
    cut = json.loads(own.pre_tokenizer.__getstate__()) if own.pre_tokenizer else {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    line = own.encode("\n", add_special_tokens=False).ids
    return bool(plain and own.normalizer is None and len(line) == 1 and own.encode("a\nb\n", add_special_tokens=False).ids.count(line[0]) == 2)


@cache
def classes() -> np.ndarray:
    return code_point_classes()


@cache
def added_tokens(path: str) -> list[str]:
    """Strings that the library takes out of a text before anything else."""
    return [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]


def worker_cache(path: str, limit: int = 1 << 19) -> SegmentCache:
    def make() -> SegmentCache:
        own = tokenizer(path)
        mark = own.encode("\n", add_special_tokens=False).ids
        return SegmentCache(lambda texts: [np.array(e.ids, np.uint32) for e in own.encode_batch_fast(texts, add_special_tokens=False)], mark[0], limit)

    return worker_state(("segments", path, limit), make)


def rows_with(data: np.ndarray, at: np.ndarray, strings: list[str]) -> list[int]:
    """Rows whose text holds one of the strings."""
    raw = data.tobytes()
    return [] if not any(s.encode() in raw for s in strings) else [i for i in range(len(at) - 1) if any(s.encode() in raw[at[i] : at[i + 1]] for s in strings)]


def pieces(data: np.ndarray, at: np.ndarray, kinds: np.ndarray):
    """(code points, begins, ends, hashes, each row's first segment and the number of segments) of a chunk."""
    _, points, rows = decoded(data, at)
    begin = pretokens(points, rows, kinds)
    end = np.append(begin[1:], len(points))
    hashes = segment_hashes(points, begin, end)
    return points, begin, end, hashes, np.searchsorted(begin, rows)


def encoded_whole(path: str, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The ids of each row's text, by the library."""
    texts = [data[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)]
    return [np.array(e.ids, np.uint32) for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


def frequent_table(docs: DataFrame, id_col: str, text_col: str, path: str, kinds, size: int = TABLE_SIZE, sample_rows: int = SAMPLE_ROWS) -> tuple[Table, np.ndarray]:
    """Hash table of the `size` most frequent pre-tokens of `sample_rows` documents, and their lengths in tokens.

    The sample only decides what the first tier holds; counts don't depend on it.
    """

    def run(batches):
        for batch in batches:
            for _, _, data, at in chunks(batch.column(0)):
                points, begin, end, hashes, _ = pieces(data, at, kinds.value)
                new, first, n = np.unique(hashes, return_index=True, return_counts=True)
                texts = [points[a:b].tobytes().decode("utf-32-le") for a, b in zip(begin[first], end[first], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), pa.array(texts, pa.string()), pa.array(n, pa.int64())], ["hash", "piece", "n"])

    picked = docs.select(F.col(id_col).alias("picked")).orderBy(F.xxhash64("picked")).limit(sample_rows)
    sample = docs.select(F.col(id_col).alias("picked"), F.col(text_col).alias("text")).join(F.broadcast(picked.distinct()), "picked", "left_semi")
    counted = sample.select("text").mapInArrow(run, "hash long, piece string, n long").groupBy("hash").agg(F.min("piece").alias("piece"), F.sum("n").alias("n"))
    best = counted.orderBy(F.desc("n"), "hash").limit(size).toArrow()
    table = Table()
    table.add(best["hash"].to_numpy().view(np.uint64))
    lengths = [len(e.ids) for e in tokenizer(path).encode_batch_fast(best["piece"].to_pylist(), add_special_tokens=False)]
    return table, np.array(lengths, np.int64)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, table_size: int = TABLE_SIZE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id_col, n_bytes, n_tokens) per row of docs, as the tokenizers library counts with the vocabulary at `path`.

    Every task looks up the pre-tokens of its texts in a broadcast table of at most table_size entries; those it
    lacks go to the worker's own bounded cache, and from there in batches to the library. Texts that hold
    an added token's string go to the library whole, as do all texts where the vocabulary cuts in another way than at the
    byte-level pattern. Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; a null id stays null.
    """
    path = path or vocabulary_path("byte_bpe_50k.json")
    context = docs.sparkSession.sparkContext
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n_bytes long, n_tokens long"
    if not by_pieces(path):
        return rows.mapInArrow(_whole_counts(path), schema).withColumnRenamed("id", id_col)
    kinds = context.broadcast(classes())
    frequent = context.broadcast(frequent_table(docs, id_col, text_col, path, kinds, table_size, sample_rows))

    def run(batches):
        table, known = frequent.value
        missed, own = worker_cache(path), tokenizer(path)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for _, _, data, at in chunks(batch.column(1)):
                points, begin, end, hashes, row = pieces(data, at, kinds.value)
                slots = table.find(hashes)
                lengths = known[slots].astype(np.int64)
                rest = np.flatnonzero(slots < 0)
                if len(rest):
                    found = missed.slots(hashes[rest], points, begin[rest], end[rest], kinds.value[points[end[rest] - 1]] == SPACE)
                    lengths[rest] = missed.length[found]
                counts = np.diff(np.concatenate([[0], np.cumsum(lengths)])[row])
                for i in rows_with(data, at, added_tokens(path)):
                    counts[i] = len(own.encode(data[at[i] : at[i + 1]].tobytes().decode(), add_special_tokens=False).ids)
                n_bytes.append(np.diff(at))
                n_tokens.append(counts)
            empty = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n_bytes or empty)), pa.array(np.concatenate(n_tokens or empty))], ["id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _whole_counts(path: str):
    def run(batches):
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column(1)):
                n = np.array([len(x) for x in encoded_whole(path, data, at)], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(n)], ["id", "n_bytes", "n_tokens"])

    return run


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, tokens and whether they exceed LIMIT for every row of documents; a null text counts as an empty one."""
    counts = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
