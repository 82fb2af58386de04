"""Word and window arithmetic over whole Arrow string batches, used inside map tasks.

A batch is cut into chunks of whole rows of about a megabyte, so that memory in a task
depends on its longest text, not on the batch. A word is a maximal run of bytes other
than the six ASCII spaces. Hashes of words and of runs of words come from prefix sums of
`code * B**position` modulo 2**64, so a window of any length costs one subtraction.
"""

from __future__ import annotations

import ctypes
import gc
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_power = {"up": np.ones(1, U), "down": np.ones(1, U)}
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


_state: dict = {}
_turn = itertools.count(1)


def give_back() -> None:
    """Returns memory that this process has freed to the system; allocators keep it otherwise, and what a worker kept from each operator added up."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow; what it has freed goes back when the task ends, as a worker waits for its next task beside stages that need none."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def worker_state(key, make: Callable):
    """What a Python worker keeps from task to task. Only the last one asked for stays, so that the caches of operators that follow each other don't add up."""
    if key not in _state:
        _state.clear()
        gc.collect()  # what an operator kept may hold itself in a ring
        _state[key] = make()
        give_back()
    return _state[key]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, which: str) -> np.ndarray:
    """B**0 .. B**(n-1) ("up") or the inverses ("down")."""
    if len(_power[which]) < n:
        size = max(n + n // 4, 1 << 16)
        step = np.full(size, _BASE if which == "up" else _INVERSE, U)
        step[0] = 1
        _power[which] = np.multiply.accumulate(step)
    return _power[which][:n]


_CODES = mix64(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
_LOWER_CODES = _CODES.copy()
_LOWER_CODES[65:91] = _CODES[97:123]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values * B**position, with a leading 0."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values), "up"), out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of what was summed, equal wherever the span stands."""
    return mix64((sums[end] - sums[start]) * powers(len(sums), "down")[start])


@dataclass
class Words:
    data: np.ndarray  # bytes of the chunk's texts
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of each row's first word, and the number of words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, size: int, seed: int = 0) -> np.ndarray:
        """Hash of the `size` words from each word on, or of those up to the end of its row."""
        sums = prefix(mix64(self.hash ^ U(seed)))
        start = np.arange(len(self.hash))
        return spans(sums, start, start + np.minimum(size, self.room()))

    def heads(self, size: int, lower: bool = False) -> np.ndarray:
        """Hash of the first `size` bytes of each word, other than that of a whole word."""
        sums = prefix((_LOWER_CODES if lower else _CODES)[self.data])
        return mix64(spans(sums, self.start, np.minimum(self.start + size, self.end)) + U(size))

    def room(self) -> np.ndarray:
        """Number of words from each word to the end of its row, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.hash))


def chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into the bytes). A null is an empty text."""
    if next(_turn) % 8 == 0:
        give_back()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, at: np.ndarray, lower: bool = False, gaps: np.ndarray = SPACES) -> Words:
    """The words of texts that lie one after another in `data`, from at[i] to at[i + 1]. lower: hash A-Z as a-z. gaps: bytes that part words."""
    solid = ~gaps[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    full = at[:-1] < at[1:]  # a row's edge also parts words
    begins[at[:-1][full]] = solid[at[:-1][full]]
    ends[at[1:][full] - 1] = solid[at[1:][full] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = prefix((_LOWER_CODES if lower else _CODES)[data])
    return Words(data, start, end, spans(sums, start, end), np.searchsorted(start, at))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0]+1, ... of each run, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One list per row from values that lie one after another."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values, kind))
