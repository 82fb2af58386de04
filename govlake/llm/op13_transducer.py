"""BPE encoding and decoding by transducers that need only a bounded look ahead.

A merge list has a sufficient lookahead: how many bytes behind a token's end can still change that token. A difference
between two continuations of a text starts where they part and moves left only by a merge (u, v) that happens in one of
them, by the length of u. For the next such merge (u', v') the old border must lie between u' and v', so v' begins with u, and
its rank is higher. The longest chain of such merges, found in one pass over the list, is the lookahead. Tokens that end further to the left
are emitted, so a word of any length takes a buffer of constant size.
"""

from __future__ import annotations

import codecs
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlake.llm.arrays import U, chunks, mix64, ragged, worker_state
from govlake.llm.op5_token_counts import classes, rows_with, tokenizer, vocabulary_path
from govlake.llm.segments import LETTER, NUMBER, SPACE, SegmentCache, Table, decoded, pretokens, segment_hashes
from govlake.llm.store import small_batches

#: Code points of a long text that are fed at a time, those up to which a pre-token is remembered, those from which it isn't held whole, ids remembered in a worker.
BLOCK, SHORT, LONG, REMEMBERED = 1 << 18, 64, 1 << 10, 1 << 23
#: Code points that must follow a pre-token's begin before all that stands before it is decided: the longest contraction.
DECIDED = 3
#: The cut of the lower-casing vocabulary, which must equal the file's: contractions, letters, single numbers, other characters.
WORD_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NONE = np.int64(1 << 40)


def byte_characters() -> list[str]:
    """The character by which byte-level vocabularies write each byte: itself if it is printable Latin-1, else one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    return [chr(b) if b in shown else chr(256 + b - sum(x < b for x in shown)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], width) -> int:
    """Bytes behind a token's end that can still change it. width: bytes of a symbol.

    The merge list must be proper: each symbol is made by one merge, after the merges that make its parts.
    """
    left, made, reach, most = {}, set(), {}, 0
    results = {a + b for a, b in merges}
    if len(results) < len(merges):
        raise ValueError("two merges make the same symbol")
    for a, b in merges:
        if any(x in results and x not in made for x in (a, b)):
            raise ValueError("a merge comes before those of its parts")
        made.add(a + b)
        behind, s = 0, b
        while s is not None:  # symbols that b begins with
            behind, s = max(behind, reach.get(s, 0)), left.get(s)
        reach[a] = max(reach.get(a, 0), width(a) + behind)
        most = max(most, reach[a])
        left[a + b] = a
    return most


class Merges:
    """A BPE vocabulary file: its cut, its symbols, and its merges for one word or for many at once."""

    def __init__(self, path: str, kinds: np.ndarray):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.own, self.kinds = tokenizer(path), kinds
        model, cut, before = spec["model"], spec["pre_tokenizer"] or {}, spec["normalizer"]
        steps = cut.get("pretokenizers", [cut])
        self.lower = before is not None
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) or steps[-1].get("type") != "ByteLevel" or steps[-1].get("add_prefix_space"):
            raise ValueError("a byte-level BPE vocabulary is needed")
        if self.lower and ([x["type"] for x in before.get("normalizers", [])] != ["NFC", "Replace", "Lowercase"] or len(steps) != 2 or steps[0]["pattern"].get("Regex") != WORD_CUT or not steps[0]["invert"] or steps[0]["behavior"] != "Removed") or not self.lower and (len(steps) != 1 or not steps[0].get("use_regex", True)):
            raise ValueError("the vocabulary cuts texts in a way that isn't known here")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        as_byte = {c: b for b, c in enumerate(byte_characters())}
        self.lookahead = 1 + sufficient_lookahead(merges, lambda s: len(s.removesuffix(suffix)) if suffix else len(s))
        self.plain = np.array([vocab[c] for c in as_byte], np.int64)
        self.last = np.array([vocab[c + suffix] for c in as_byte], np.int64)
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64)
        self.result = pairs[:, 2]
        self.table = Table()
        self.table.add(self._key(pairs[:, 0], pairs[:, 1]))  # slots are ranks
        self.rank = {(a, b): r for r, (a, b) in enumerate(pairs[:, :2].tolist())}
        names = {i: s for s, i in vocab.items()} | {i: t.content for i, t in self.own.get_added_tokens_decoder().items()}
        self.specials = {t.content: i for i, t in self.own.get_added_tokens_decoder().items()}
        self.width = np.zeros(max(names) + 1, np.int64)
        self.width[list(vocab.values())] = [len(s.removesuffix(suffix)) if suffix else len(s) for s in vocab]
        self.window = 4 * self.lookahead + int(self.width.max())
        if any(a != b and b.startswith(a) for a in self.specials for b in self.specials):
            raise ValueError("an added token begins another")
        self.joined = spec["decoder"] is None
        if not self.joined and spec["decoder"]["type"] != "ByteLevel":
            raise ValueError("the vocabulary joins tokens in a way that isn't known here")
        texts = [b"" if i not in names else names[i].encode() + b" " if self.joined else bytes(map(as_byte.get, names[i])) if all(c in as_byte for c in names[i]) else names[i].encode() for i in range(len(self.width))]
        self.text_length = np.array([len(x) for x in texts])
        self.text_start = np.cumsum(self.text_length) - self.text_length
        self.texts = np.frombuffer(b"".join(texts), np.uint8)
        self.simple, self.lowered = self._simple()

    def _simple(self) -> tuple[np.ndarray, np.ndarray]:
        """Code points that the normaliser changes to one code point whatever stands beside them, and that one."""
        ok, to = np.ones(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
        if not self.lower:
            return ok, to
        ok[0x3000:] = False  # those go through the library
        for c in range(0x3000):
            new = self.own.normalizer.normalize_str(chr(c))
            ok[c] = len(new) == 1 and not unicodedata.category(chr(c)).startswith("M") and not 0x1100 <= c < 0x1200
            to[c] = ord(new[0]) if new else c
        return ok, to

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return mix64((left.astype(U) << U(32)) | right.astype(U))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        slots = self.table.find(self._key(left, right)).astype(np.int64)
        return np.where(slots < 0, NONE, slots)

    def many(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many words whose symbols lie one after another, and the number of tokens of each; all words merge their best pair in the same turn."""
        ids, word, counts = ids.copy(), np.arange(len(lengths)), lengths
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank = np.full(len(ids), NONE)
        rank[:-1] = self._ranks(ids[:-1], ids[1:])
        rank[np.cumsum(counts) - 1] = NONE
        while len(word):
            start = np.cumsum(counts) - counts
            low = np.minimum.reduceat(rank, start)
            over = low == NONE
            if over.any():
                gone = np.repeat(over, counts)
                done.append((word[over], counts[over], ids[gone]))
                ids, rank, word, counts, low = ids[~gone], rank[~gone], word[~over], counts[~over], low[~over]
                if not len(word):
                    break
            owner = np.repeat(np.arange(len(word)), counts)
            hit = np.flatnonzero(rank == low[owner])
            if (run := hit[1:] == hit[:-1] + 1).any():  # of a pair of equal symbols each second one of a run overlaps
                first = np.concatenate([[True], ~run])
                at = np.arange(len(hit))
                hit = hit[(at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0]
            ids[hit] = self.result[rank[hit]]
            kept = np.ones(len(ids), bool)
            kept[hit + 1] = False
            counts = counts - np.bincount(owner[hit], minlength=len(counts))
            moved = hit - np.arange(len(hit))
            ids, rank = ids[kept], rank[kept]
            ends = np.cumsum(counts) - 1
            at = np.union1d(moved, moved[moved > 0] - 1)
            at = at[at < len(ids) - 1]
            rank[at] = self._ranks(ids[at], ids[at + 1])
            rank[ends] = NONE
        if not done:
            return np.zeros(0, np.uint32), lengths
        word, counts, flat = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        start = np.cumsum(counts) - counts
        return flat[ragged(start[order], counts[order])].astype(np.uint32), counts[order]

    def one(self, symbols: np.ndarray) -> np.ndarray:
        """Tokens of one long word, by a heap of its pairs."""
        ids, n = symbols.tolist(), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.result[r]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (s := self.rank.get((ids[k], ids[after[k]]))) is not None:
                    heapq.heappush(heap, (s, k, ids[k], ids[after[k]]))
        return np.array([x for x in ids if x >= 0], np.uint32)

    def begins(self, points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins of the pre-tokens of rows of normalised code points, and their ends; white space that belongs to none is left out."""
        if not self.lower:
            begin = pretokens(points, rows, self.kinds)
            return begin, np.append(begin[1:], len(points)).astype(np.int64)
        kind = self.kinds[points]
        begin = np.ones(len(points), bool)
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        begin[rows[:-1][rows[:-1] < len(points)]] = True
        first = np.zeros(len(points) + 1, bool)
        first[rows] = True
        for i in np.flatnonzero((points[:-1] == 39) & begin[:-1] & ~first[1:-1] & (kind[1:] == LETTER)).tolist():
            two = (int(points[i + 1]), int(points[i + 2]) if i + 2 < len(points) and not first[i + 2] else 0)
            length = 2 if two[0] in (115, 116, 109, 100) else 3 if two in ((114, 101), (118, 101), (108, 108)) else 0
            if length:
                begin[i + 1 : i + length] = False
                if i + length < len(points):
                    begin[i + length] = True
        begin = np.flatnonzero(begin)
        end = np.append(begin[1:], len(points)).astype(np.int64)
        solid = kind[begin] != SPACE
        return begin[solid], end[solid]

    def normalised(self, points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows as the normaliser has them; those with code points that may join others go through the library."""
        if not self.lower:
            return points, rows
        odd = np.flatnonzero(~self.simple[points])
        if not len(odd):
            return self.lowered[points], rows
        parts, at = [], 0
        lengths = np.diff(rows)
        for i in np.unique(np.searchsorted(rows, odd, "right") - 1).tolist():
            new = self.own.normalizer.normalize_str(points[rows[i] : rows[i + 1]].tobytes().decode("utf-32-le"))
            parts += [self.lowered[points[at : rows[i]]], np.frombuffer(new.encode("utf-32-le"), np.uint32)]
            lengths[i], at = len(new), rows[i + 1]
        return np.concatenate([*parts, self.lowered[points[at:]]]), np.concatenate([[0], np.cumsum(lengths)])

    def symbols(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words one after another, the last of each in its form at a word's end, and their numbers."""
        chosen = points[ragged(begin, end - begin)]
        wide = 1 + (chosen >= 0x80).astype(np.int64) + (chosen >= 0x800) + (chosen >= 0x10000)
        total = np.concatenate([[0], np.cumsum(wide)])
        data = np.frombuffer(chosen.tobytes().decode("utf-32-le").encode(), np.uint8)
        ends = total[np.cumsum(end - begin)]
        out = self.plain[data]
        out[ends - 1] = self.last[data[ends - 1]]
        return out, np.diff(ends, prepend=0)


class WordCache(SegmentCache):
    """A worker's tokens of the short words met so far."""

    def __init__(self, model: Merges):
        super().__init__(None, -1)
        self.model = model

    def _encoded(self, points, begin, end, group: int = 1 << 14):
        parts = [self.model.many(*self.model.symbols(points, begin[i : i + group], end[i : i + group])) for i in range(0, len(begin), group)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class WordTransducer:
    """Tokens of one word that comes in pieces; never holds more than a window and a piece."""

    def __init__(self, model: Merges):
        self.model, self.held = model, b""

    def feed(self, data: bytes) -> list[np.ndarray]:
        model, out = self.model, []
        self.held += data
        at = 0
        while len(self.held) - at > model.window:
            tokens = model.one(model.plain[np.frombuffer(self.held, np.uint8, model.window, at)])
            ends = np.cumsum(model.width[tokens])
            stable = int(np.searchsorted(ends, model.window - model.lookahead, "right"))
            out.append(tokens[:stable])
            at += int(ends[stable - 1])
        self.held = self.held[at:]
        return out

    def close(self) -> list[np.ndarray]:
        data, self.held = np.frombuffer(self.held, np.uint8), b""
        if not len(data):
            return []
        symbols = self.model.plain[data]
        symbols[-1] = self.model.last[data[-1]]
        return [self.model.one(symbols)]


def _bytes(points: np.ndarray) -> bytes:
    return points.tobytes().decode("utf-32-le").encode()


def encode_words(model: Merges, cache_: WordCache, points: np.ndarray, begin: np.ndarray, end: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each row) of the pre-tokens [begin, end) of normalised code points."""
    if not len(begin):
        return np.zeros(0, np.uint32), np.zeros(len(rows) - 1, np.int64)
    length = np.zeros(len(begin), np.int64)
    short = end - begin <= SHORT
    if cache_.used > REMEMBERED:
        cache_.clear()
    slots = cache_.slots(segment_hashes(points, begin[short], end[short]), points, begin[short], end[short], np.zeros(int(short.sum()), bool))
    length[short] = cache_.length[slots]
    long = {}
    for i in np.flatnonzero(~short).tolist():
        word = WordTransducer(model)
        long[i] = np.concatenate([*word.feed(_bytes(points[begin[i] : end[i]])), *word.close()])
        length[i] = len(long[i])
    counts = np.diff(np.concatenate([[0], np.cumsum(length)])[np.searchsorted(begin, rows)])
    if not long:
        return cache_.ids(slots), counts
    ids, start = np.zeros(int(length.sum()), np.uint32), np.cumsum(length) - length
    ids[ragged(start[short], length[short])] = cache_.ids(slots)
    for i, tokens in long.items():
        ids[start[i] : start[i] + len(tokens)] = tokens
    return ids, counts


class Encoder:
    """Ids of a text that comes in pieces. What it holds is bounded by a piece, a window and the longest run of marks that may join."""

    def __init__(self, model: Merges, cache_: WordCache):
        self.model, self.cache = model, cache_
        self.raw, self.points, self.word, self.head = "", np.zeros(0, np.uint32), None, 0
        self.held = max(1, max(map(len, model.specials), default=1) - 1)  # an added token may have begun there

    def feed(self, text: str) -> np.ndarray:
        """Ids that no continuation can change."""
        self.raw += text
        return self._raw(False)

    def close(self) -> np.ndarray:
        """The ids that are left."""
        return self._raw(True)

    def _raw(self, final: bool) -> np.ndarray:
        out = []
        while found := [(at, -len(s), s) for s in self.model.specials if (at := self.raw.find(s)) >= 0]:
            at, _, special = min(found)
            text, self.raw = self.raw[:at], self.raw[at + len(special) :]
            out += [*self._text(text, True), np.array([self.model.specials[special]], np.uint32)]
        text = self.raw
        cut = len(text) if final else max(0, len(text) - self.held)
        while 0 < cut < len(text) and not self.model.simple[ord(text[cut])]:
            cut -= 1
        self.raw = text[cut:]
        out += self._text(text[:cut], final)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def _text(self, text: str, final: bool) -> list[np.ndarray]:
        model, out = self.model, []
        new = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        new, _ = model.normalised(new, np.array([0, len(new)]))
        points = np.concatenate([self.points, new])
        begin, end = model.begins(points, np.array([0, len(points)]))
        if final:
            cut = len(points)
        else:
            decided = begin[begin <= len(points) - DECIDED]
            cut = int(decided[-1]) if len(decided) else 0
            if len(decided) and (stop := int(end[len(decided) - 1])) <= len(points) - DECIDED:
                cut = stop  # the last word is over, too: white space follows
        gone = 0
        if self.word is None and model.lower:
            cut = max(cut, int(begin[0]) if len(begin) else len(points))
        if self.word is not None:  # points begins with the head of a long word, whose bytes have been fed
            stop = int(end[0]) if len(end) else self.head
            if cut >= stop:
                out += [*self.word.feed(_bytes(points[self.head : stop])), *self.word.close()]
                self.word = None
                points, cut, gone = points[stop:], cut - stop, stop
        if self.word is None:
            own = (begin >= gone) & (begin < gone + cut)
            out.append(encode_words(model, self.cache, points, begin[own] - gone, end[own] - gone, np.array([0, cut]))[0])
            points = points[cut:]
            if len(points) > LONG and not final:
                self.word, self.head = WordTransducer(model), 0
        if self.word is not None:
            out += self.word.feed(_bytes(points[self.head : len(points) - DECIDED]))
            points, self.head = np.concatenate([points[:2], points[-DECIDED:]]), 2
        self.points = points
        return out


class Decoder:
    """The text of ids that come in pieces, as the library's decode gives it: bytes of tokens through a UTF-8 state machine that
    holds back unfinished characters and puts U+FFFD for broken ones; tokens parted by blanks where the file names no decoder."""

    def __init__(self, model: Merges):
        self.model, self.held, self.machine = model, b"", codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        model = self.model
        data = self.held + model.texts[ragged(model.text_start[ids], model.text_length[ids])].tobytes()
        self.held = b""
        if model.joined and data:
            data, self.held = data[:-1], data[-1:]  # the blank behind the last token so far
        return self.machine.decode(data)

    def close(self) -> str:
        self.held = b""
        return self.machine.decode(b"", True)


_models: dict[str, Merges] = {}


def model_of(path: str, kinds: np.ndarray) -> Merges:
    """The vocabulary at `path`, read once in a process."""
    if path not in _models:
        _models[path] = Merges(path, kinds)
    return _models[path]


def _encoder(path: str, kinds):
    def run(batches):
        own = model_of(path, kinds.value)
        cache_ = worker_state(("words", path), lambda: WordCache(own))
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column(1)):
                streamed = set(range(hi - lo) if len(data) > 4 * BLOCK else rows_with(data, at, list(own.specials)))
                texts = {i: data[at[i] : at[i + 1]].tobytes().decode() for i in streamed}
                if streamed:
                    lengths = np.diff(at)
                    lengths[list(streamed)] = 0
                    data, at = data[ragged(at[:-1], lengths)], np.concatenate([[0], np.cumsum(lengths)])
                _, points, rows = decoded(data, at)
                points, rows = own.normalised(points, rows)
                ids, counts = encode_words(own, cache_, points, *own.begins(points, rows), rows)
                raw, ends = ids.astype("<u4").tobytes(), 4 * np.concatenate([[0], np.cumsum(counts)])
                out = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                for i, text in texts.items():
                    stream = Encoder(own, cache_)
                    parts = [stream.feed(text[k : k + BLOCK]) for k in range(0, len(text), BLOCK)]
                    out[i] = np.concatenate([*parts, stream.close()]).astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(out, pa.binary())], ["id", "ids"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, ids) per row of docs; ids are little-endian unsigned 32-bit numbers, those of the tokenizers library with the byte-level BPE file
    at `path`, without truncation, padding or tokens that the text doesn't hold.

    Pre-tokens of up to SHORT code points are merged once per worker, longer ones by a WordTransducer; texts longer than 4 x BLOCK bytes or with
    strings of added tokens go through an Encoder piece by piece. Words are remembered by 64-bit hashes. Null and empty texts have no ids;
    repeated rows have a row each; a null id stays null; other columns are left out. A vocabulary whose merge list or cut isn't supported raises ValueError on the driver.
    """
    path = path or vocabulary_path("word_bpe_49k.json")
    model_of(path, classes())
    kinds = docs.sparkSession.sparkContext.broadcast(classes())
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encoder(path, kinds), "id long, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id_col, ids_col, decoded) per row: the library's decode(ids, skip_special_tokens=False). Null ids give an empty text; ids outside the vocabulary raise."""
    path = path or vocabulary_path("word_bpe_49k.json")
    kinds = encoded.sparkSession.sparkContext.broadcast(classes())

    def run(batches):
        own = model_of(path, kinds.value)
        for batch in batches:
            texts = []
            for packed in batch.column(1):
                ids, machine = np.frombuffer(packed.as_py() or b"", "<u4"), Decoder(own)
                texts.append("".join([machine.feed(ids[k : k + BLOCK]) for k in range(0, len(ids), BLOCK)]) + machine.close())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "id long, ids binary, decoded string").toDF(id_col, ids_col, "decoded")


def op13_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every row of documents, hashes of its ids and of their decoded text."""
    both = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return both.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
