"""Token ids of whole Arrow columns by distinct segments.

A tokenizer that never merges across certain borders gives a text the ids of its segments, one after
another. A task therefore finds the borders of a whole chunk with array arithmetic, hashes the segments and
has the library encode only those that its worker hasn't met.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from govlake.llm.arrays import U, mix64, prefix, ragged, spans

OTHER, LETTER, NUMBER, SPACE = range(4)


class Table:
    """Open addressing from 64-bit hashes to slots 0, 1, ..., probed for whole arrays at a time."""

    def __init__(self, capacity: int = 1 << 12):
        self.n = 0
        self.keys, self.slots = np.zeros(capacity, U), np.full(capacity, -1, np.int32)

    def _home(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> U(65 - len(self.keys).bit_length())).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 where there's none."""
        at = self._home(hashes)
        out = self.slots[at]
        open_ = np.flatnonzero((self.keys[at] != hashes) & (out >= 0))
        out[(self.keys[at] != hashes) & (out < 0)] = -1
        at = at[open_]
        while len(open_):
            at = (at + 1) & (len(self.keys) - 1)
            slot = self.slots[at]
            hit = (self.keys[at] == hashes[open_]) & (slot >= 0)
            out[open_[hit]] = slot[hit]
            out[open_[slot < 0]] = -1
            on = ~hit & (slot >= 0)
            open_, at = open_[on], at[on]
        return out

    def add(self, hashes: np.ndarray) -> np.ndarray:
        """Slots for new, distinct hashes."""
        slots = np.arange(self.n, self.n + len(hashes), dtype=np.int32)
        if 2 * (self.n + len(hashes)) > len(self.keys):
            full = self.slots >= 0
            keys, old = self.keys[full], self.slots[full]
            size = 1 << int(2 * (self.n + len(hashes))).bit_length()
            self.keys, self.slots = np.zeros(size, U), np.full(size, -1, np.int32)
            self._put(keys, old)
        self._put(hashes, slots)
        self.n += len(hashes)
        return slots

    def _put(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        at = self._home(hashes)
        while len(hashes):
            free = np.flatnonzero(self.slots[at] < 0)
            place, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[place], self.slots[place] = hashes[won], slots[won]
            left = np.ones(len(hashes), bool)
            left[won] = False
            hashes, slots, at = hashes[left], slots[left], (at[left] + 1) & (len(self.keys) - 1)


NEWLINE = 10


class SegmentCache:
    """A worker's ids of the segments met so far. When it holds `limit` segments it keeps those met again since the last time
    that happened, or none if they are more than half of them, so its memory is bounded.

    encode gives the ids of each text of a list. Segments not met are encoded in long texts, parted by line ends; no
    token may hold a line end and anything else, and `mark` is the line end's id.
    """

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], mark: int, limit: int = 1 << 19):
        self.encode, self.mark, self.limit = encode, mark, limit
        self.clear()

    def clear(self) -> None:
        self.table, self.used, self.n = Table(), 0, 0
        self.flat, self.start, self.length, self.again = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, bool)

    def thin(self) -> None:
        kept = np.flatnonzero(self.again[: self.n])
        full = np.flatnonzero(self.table.slots >= 0)
        hashes = np.zeros(self.n, U)
        hashes[self.table.slots[full]] = self.table.keys[full]
        hashes, flat, lengths = hashes[kept], self.ids(kept), self.length[kept].copy()
        self.clear()
        if len(kept) <= self.limit // 2:
            self._store(hashes, flat, lengths)

    def _store(self, hashes: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        slots = self.table.add(hashes)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(lengths) > len(self.start):
            self.start, self.length, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.again))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[slots], self.length[slots] = self.used + np.cumsum(lengths) - lengths, lengths
        self.used, self.n = self.used + len(flat), self.n + len(lengths)
        return slots

    def _encoded(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray, group: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        texts = []
        for i in range(0, len(begin), group):
            lengths = end[i : i + group] - begin[i : i + group] + 1
            joined = points[np.minimum(ragged(begin[i : i + group], lengths), len(points) - 1)]
            joined[np.cumsum(lengths) - 1] = NEWLINE
            texts.append(joined.tobytes().decode("utf-32-le"))
        ids = np.concatenate(self.encode(texts))
        cut = np.flatnonzero(ids == self.mark)
        if len(cut) != len(begin):
            raise ValueError("a token holds a line end and other text")
        return ids[ids != self.mark], np.diff(cut, prepend=-1) - 1

    def slots(self, hashes: np.ndarray, points: np.ndarray, begin: np.ndarray, end: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """The slot of each segment points[begin:end]; those that a line end beside them would change are encoded alone."""
        if self.n > self.limit:
            self.thin()
        out = self.table.find(hashes)
        missing = np.flatnonzero(out < 0)
        self.again[out[out >= 0] if len(missing) else out] = True
        if len(missing):
            new, first, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            at = missing[first]
            plain = ~alone[at]
            slots = np.zeros(len(new), np.int32)
            if plain.any():
                slots[plain] = self._store(new[plain], *self._encoded(points, begin[at[plain]], end[at[plain]]))
            if not plain.all():
                apart, parts = np.flatnonzero(~plain), []
                for i in range(0, len(apart), 8192):
                    some = at[apart[i : i + 8192]]
                    found = self.encode([points[a:b].tobytes().decode("utf-32-le") for a, b in zip(begin[some], end[some], strict=True)])
                    parts.append(self._store(new[apart[i : i + 8192]], np.concatenate(found), np.array([len(x) for x in found])))
                slots[apart] = np.concatenate(parts)
            out[missing] = slots[back]
        return out

    def ids(self, slots: np.ndarray) -> np.ndarray:
        """The ids of the segments, one after another."""
        return self.flat[ragged(self.start[slots], self.length[slots])]


def code_point_classes() -> np.ndarray:
    """Letter, number, space or other for each code point, as the tokenizers library's patterns have them."""
    from tokenizers import Regex, pre_tokenizers

    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype(np.uint32)
    text = points.tobytes().decode("utf-32-le")
    classes = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            classes[points[a:b]] = kind
    return classes


_POINTS = mix64(np.arange(1, 0x3000, dtype=U) * U(0xD6E8FEB86659FD93))


def point_sums(points: np.ndarray) -> np.ndarray:
    """Prefix sums for hashes of spans of code points."""
    codes = _POINTS[np.minimum(points, len(_POINTS) - 1)]
    wide = np.flatnonzero(points >= len(_POINTS) - 1)
    codes[wide] = mix64((points[wide].astype(U) + U(1)) * U(0xD6E8FEB86659FD93))
    return prefix(codes)


def decoded(data: np.ndarray, at: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """The chunk as a string, its code points and the rows' offsets in them."""
    text = data.tobytes().decode()
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        return text, points, at
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return text, points, heads[at]


def pretokens(points: np.ndarray, at: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Begins of the segments that the byte-level pattern (`public_tokenizers.PATTERN`) makes of each row."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes[points]
    space = kind == SPACE
    first = np.zeros(n + 1, bool)  # where rows begin, and the end
    first[at] = True
    begin = np.ones(n, bool)
    gap = points == 32
    before, after = space[:-1], space[1:]
    begin[1:] = np.where(before, ~after & ~gap[:-1], kind[1:] != kind[:-1])
    last = np.zeros(n, bool)  # the last space before a word takes no part in the run before it
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    begin[1:] |= before & after & last[1:]
    begin |= first[:n]
    for i in np.flatnonzero((points[:-1] == 39) & begin[:-1] & ~first[1:n]).tolist():
        two = (int(points[i + 1]), int(points[i + 2]) if i + 2 < n and not first[i + 2] else 0)
        length = 2 if two[0] in (115, 116, 109, 100) else 3 if two in ((114, 101), (118, 101), (108, 108)) else 0
        if length:
            begin[i + 1 : i + length] = False
            if i + length < n:
                begin[i + length] = True
    return np.flatnonzero(begin)


def segment_hashes(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return spans(point_sums(points), begin, end)
