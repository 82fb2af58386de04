"""Whole tokens of strings looked up in a table of names that may be of any size, by blocks of rows.

A block is some megabytes of whole rows, packed as one compressed value, so a shuffle moves a text once and each different token of a
block once, however many of its rows hold it. Memory in a task is a few times a block's size.
"""

from __future__ import annotations

import ctypes
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TOKEN = re.compile(r"([A-Za-z0-9_$]+)")
#: Bytes of rows that make a block. Larger ones hold fewer different tokens in all, and take more memory.
BLOCK_BYTES = 8 << 20
#: Bytes that pass from the executor to a worker at once.
BATCH_BYTES = 4 << 20
#: No token: its row tells that a block's tokens were looked up.
_SEEN = ""


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, rows): blocks of rows as compressed Arrow streams, known by a hash of them."""
    held, size = [], 0
    for batch in batches:
        step = max(1, BLOCK_BYTES * batch.num_rows // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            held.append(batch.slice(at, step))
            size += held[-1].nbytes
            if size >= BLOCK_BYTES:
                yield _pack(held)
                held, size = [], 0
    if held:
        yield _pack(held)
    del held, batches
    _give_back()


def _give_back() -> None:
    """Returns memory that this worker has freed to the system; it waits for its next task beside others."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
    data = sink.getvalue().to_pybytes()
    block = int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([data], pa.binary())], ["block", "rows"])


def _unpacked(rows: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(rows.as_buffer()).read_next_batch()


def _strings(values: pa.Array) -> Iterator[pa.Array]:
    """The arrays of strings in an array of any type, those of map keys too."""
    kind = values.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        yield values
    elif pa.types.is_struct(kind):
        for i in range(kind.num_fields):
            yield from _strings(values.field(i))
    elif pa.types.is_map(kind):
        yield from _strings(values.keys)
        yield from _strings(values.items)
    elif pa.types.is_list(kind) or pa.types.is_large_list(kind):
        yield from _strings(values.flatten())


def _has_strings(kind: pa.DataType) -> bool:
    return pa.types.is_string(kind) or pa.types.is_large_string(kind) or any(_has_strings(kind.field(i).type) for i in range(kind.num_fields))


def _tokens_of(columns: list[str] | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, real): the different tokens of each block, and _SEEN."""
        for batch in batches:
            for block, rows in zip(batch["block"].to_pylist(), batch["rows"], strict=True):
                held = _unpacked(rows)
                found = {_SEEN}
                for name in columns or held.schema.names:
                    for strings in _strings(held[name]):
                        for text in strings.to_pylist():
                            if text:
                                found.update(TOKEN.findall(text))
                real = pa.array(list(found), pa.string())
                del held, found
                for at in range(0, len(real), 1 << 16):
                    part = real[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, np.int64)), part], ["block", "real"])
        _give_back()

    return run


def replaced(text: str | None, names: dict[str, str]) -> tuple[str | None, int]:
    """A text with its known tokens replaced, and how many."""
    if not text:
        return text, 0
    parts = TOKEN.split(text)
    known = [names.get(t) for t in parts[1::2]]
    parts[1::2] = [t if name is None else name for t, name in zip(parts[1::2], known, strict=True)]
    return "".join(parts), len(known) - known.count(None)


def rewritten(values: pa.Array, names: dict[str, str]) -> pa.Array:
    """values, of any type, with the known tokens of all strings in them replaced. Of map keys that become equal the first stays."""
    kind = values.type
    if not _has_strings(kind) or not len(values):
        return values
    if pa.types.is_struct(kind):
        return pa.StructArray.from_arrays([rewritten(values.field(i), names) for i in range(kind.num_fields)], fields=list(kind), mask=values.is_null())
    if pa.types.is_map(kind):
        begin, end = values.offsets[0].as_py(), values.offsets[-1].as_py()
        at = values.offsets.to_numpy() - begin
        keys, items = rewritten(values.keys[begin:end], names), rewritten(values.items[begin:end], names)
        first = _first_of_each(at, keys)
        if not first.all():
            keys, items, at = keys.filter(pa.array(first)), items.filter(pa.array(first)), np.concatenate([[0], np.cumsum(first)])[at]
        return pa.MapArray.from_arrays(_offsets(at, values), keys, items, type=kind)
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        begin, end = values.offsets[0].as_py(), values.offsets[-1].as_py()
        large = pa.types.is_large_list(kind)
        return (pa.LargeListArray if large else pa.ListArray).from_arrays(_offsets(values.offsets.to_numpy() - begin, values, large), rewritten(values.values[begin:end], names), type=kind)
    return pa.array([replaced(x, names)[0] for x in values.to_pylist()], kind)


def _offsets(at: np.ndarray, values: pa.Array, large: bool = False) -> pa.Array:
    """Offsets that are null where values are."""
    null = np.append(values.is_null().to_numpy(zero_copy_only=False), False)
    return pa.array(at, pa.int64() if large else pa.int32(), mask=null)


def _first_of_each(at: np.ndarray, keys: pa.Array) -> np.ndarray:
    """Whether each key is the first of its kind in its map; maps are cut at the places `at`."""
    first, plain = np.ones(len(keys), bool), keys.to_pylist()
    if not isinstance(next(iter(plain), ""), str):
        plain = [repr(k) for k in plain]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a > 1 and len(set(plain[a:b])) < b - a:
            seen = set()
            for i in range(a, b):
                first[i] = plain[i] not in seen
                seen.add(plain[i])
    return first


def looked_up(df: DataFrame, names: DataFrame, put: Callable[[pa.RecordBatch, dict[str, str]], pa.RecordBatch], schema: StructType, columns: list[str] | None = None) -> DataFrame:
    """What put(rows, names) makes of df, block by block; names has the pseudonyms of the tokens that the block's strings, or those of `columns`, hold and that the table
    names (real, pseudonym) has. Of several pseudonyms of one token any holds. Rows may be of all types that Arrow carries.

    The packed rows are dealt out once and read from there twice, for their tokens and to be rewritten; a block whose tokens weren't looked up is an error.
    """
    spark = df.sparkSession
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = df.mapInArrow(_packed, "block long, rows binary").repartition(n, "block")
    tokens = packed.mapInArrow(_tokens_of(columns), "block long, real string")
    known = tokens.join(names.select("real", "pseudonym"), "real", "left").where((F.col("real") == _SEEN) | F.col("pseudonym").isNotNull()).select("block", "real", "pseudonym")

    def whole(rows: pa.Table, found: pa.Table) -> pa.Table:
        pseudonyms = dict(zip(found["real"].to_pylist(), found["pseudonym"].to_pylist(), strict=True))
        if not rows.num_rows or _SEEN not in pseudonyms:
            raise ValueError("a block's rows changed between two readings of them")
        del pseudonyms[_SEEN]
        out = pa.Table.from_batches([put(_unpacked(x), pseudonyms) for x in rows["rows"]])
        del rows, found, pseudonyms
        _give_back()
        return out

    return packed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(whole, schema)
