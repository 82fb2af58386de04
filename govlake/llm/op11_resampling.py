"""Importance resampling of a corpus towards a target by hashed n-grams, whose hashes come from an Aho-Corasick dictionary of words."""

from __future__ import annotations

import math
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govlake.functions.blocks import numbered
from govlake.llm.arrays import chunks, worker_state
from govlake.llm.store import saved, small_batches

#: Longest n-gram, buckets, words that a document needs to be drawn, percent of those drawn, and what the noise of a document is made of besides its id.
NGRAM, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, "2024"
#: Words in a worker's dictionary at most, and new ones that are waited for at first. Both affect speed alone.
WORDS, FIRST = 1 << 17, 1 << 12
#: A-Z in lower case; all that is no word character becomes the delimiter.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_CLEANED = np.frombuffer(_CLEAN, np.uint8)


def _shift_tables(most: int = 24) -> np.ndarray:
    """[k, i, b]: the checksum state that is b in byte i, after 2**k more zero bytes."""
    one = np.zeros((4, 256), np.uint32)
    for i in range(4):
        for b in range(256):
            state = b << 8 * i
            for _ in range(8):
                state = state >> 1 ^ (0xEDB88320 if state & 1 else 0)
            one[i, b] = state
    tables = [one]
    for _ in range(most - 1):
        tables.append(_shifted(tables[-1], tables[-1]))
    return np.stack(tables)


def _shifted(table: np.ndarray, states: np.ndarray) -> np.ndarray:
    return table[0][states & 255] ^ table[1][states >> 8 & 255] ^ table[2][states >> 16 & 255] ^ table[3][states >> 24]


_SHIFTS = _shift_tables()
_BLANK = zlib.crc32(b" ")


def composed(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of texts one after another from the CRC-32 of both and the byte length of the right ones, below 2**24."""
    out = left.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        on = np.flatnonzero(length >> k & 1)
        out[on] = _shifted(_SHIFTS[k], out[on])
    return out ^ right


class Dictionary:
    """A worker's automaton of words between delimiters. The payload of a word is its CRC-32 and its length in bytes.

    Words that it lacks get their payload from the text and enter the automaton when enough are waiting, until it is full: its memory is bounded, and
    no result depends on what it holds.
    """

    def __init__(self, limit: int = WORDS, first: int = FIRST):
        self.limit, self.first, self.known, self.waiting, self.automaton = limit, first, {}, {}, None

    def _rebuilt(self) -> None:
        import ahocorasick

        if len(self.known) < self.limit:
            for word, payload in self.waiting.items():
                if len(self.known) < self.limit:
                    self.known[word] = payload
            self.automaton = ahocorasick.Automaton()
            for word, payload in self.known.items():
                self.automaton.add_word(f" {word.decode('latin-1')} ", payload)
            self.automaton.make_automaton()
        self.waiting = {}

    def scan(self, text: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The payload (length << 32 | CRC-32) of each word [start, end) of a cleaned text, which begins and ends with a delimiter."""
        out = np.zeros(len(start), np.int64)
        if self.automaton is not None:
            found = np.fromiter(chain.from_iterable(self.automaton.iter(text.decode("latin-1"))), np.int64).reshape(-1, 2)
            out[np.searchsorted(end, found[:, 0])] = found[:, 1]
        waiting = self.waiting
        missing = np.flatnonzero(out == 0)
        for i, a, b in zip(missing.tolist(), start[missing].tolist(), end[missing].tolist(), strict=True):
            word = text[a:b]
            payload = waiting.get(word)
            if payload is None:
                payload = len(word) << 32 | zlib.crc32(word)
                if len(word) <= 64:
                    waiting[word] = payload
            out[i] = payload
        if len(waiting) >= max(self.first, len(self.known) // 2):
            self._rebuilt()
        return out


def features(data: np.ndarray, at: np.ndarray, words: Dictionary, ngram: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all features, features of each row, words of each row) of texts that lie one after another in `data`."""
    rows = len(at) - 1
    clean = np.full(len(data) + rows + 1, 32, np.uint8)
    clean[np.arange(len(data)) + np.repeat(np.arange(1, rows + 1), np.diff(at))] = _CLEANED[data]
    solid = clean != 32
    start, end = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1, np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
    payload = words.scan(clean.tobytes(), start, end)
    crc, length = (payload & 0xFFFFFFFF).astype(np.uint32), payload >> 32
    n_words = np.diff(np.searchsorted(start, at + np.arange(rows + 1)))
    row = np.repeat(np.arange(rows), n_words)
    parts, owners, run = [crc], [row], crc
    for n in range(2, ngram + 1):
        same = row[n - 1 :] == row[: len(row) - n + 1] if len(row) >= n else np.zeros(0, bool)
        blank = composed(run[: len(same)], np.full(len(same), _BLANK, np.uint32), np.ones(len(same), np.int64))
        run = composed(blank, crc[n - 1 :], length[n - 1 :])
        parts.append(run[same])
        owners.append(row[: len(same)][same])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable") if ngram > 1 else slice(None)
    return np.concatenate(parts)[order] % np.uint32(buckets), np.bincount(owner, minlength=rows), n_words


def hashed(docs: DataFrame, id_col: str | None, text_col: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, buckets) per row of docs; buckets are little-endian unsigned 32-bit numbers, one a feature.

    A-Z in lower case; a word is a run of digits, letters and non-ASCII characters; features are all runs of 1 to ngram words of a row joined by one blank, and
    a feature's bucket is its CRC-32 modulo `buckets`. Null and empty texts have none. Without id_col the ids are null.
    """

    def run(batches):
        words = worker_state(("dictionary",), Dictionary)
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column(1)):
                found, n, n_words = features(data, at, words, ngram, buckets)
                raw, ends = found.astype("<u4").tobytes(), 4 * np.concatenate([[0], np.cumsum(n)])
                out = pa.array([raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n_words), pa.array(n), out], ["id", "n_words", "n_features", "buckets"])

    key = F.col(id_col) if id_col else F.lit(None)
    rows = small_batches(docs).select(key.cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_words long, n_features long, buckets binary")


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of a table of `hashed`; each task counts its rows first."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            _, at, data = batch.column(0).buffers()
            if data is not None and len(batch):
                ends = np.frombuffer(at, np.int32)[batch.column(0).offset : batch.column(0).offset + len(batch) + 1] // 4
                total += np.bincount(np.frombuffer(data, "<u4")[ends[0] : ends[-1]], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    return rows.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of the ratio of each bucket's smoothed share of the target to that of the corpus; `buckets` numbers, whatever the corpus."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for table, into in ((corpus, s), (target, t)):
        for r in table.collect():
            into[r.bucket] = r.n
    ratio = [(b + 1) * (int(s.sum()) + buckets) / ((a + 1) * (int(t.sum()) + buckets)) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def noise(id_: str, seed: str = SEED) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of the SHA-256 of the seed and the id; a null id counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight) of a table of `hashed`: the floored mean gain of a row's features, 0 without any."""
    known = rows.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        for batch in batches:
            _, at, data = batch.column(3).buffers()
            ends = np.frombuffer(at, np.int32)[batch.column(3).offset : batch.column(3).offset + len(batch) + 1].astype(np.int64) // 4 if len(batch) else np.zeros(1, np.int64)
            own = known.value[np.frombuffer(data, "<u4")[ends[0] : ends[-1]]] if data is not None else np.zeros(0, np.int64)
            sums = np.concatenate([[0], np.cumsum(own)])[ends - ends[0]]
            n = np.diff(ends)
            weight = np.where(n > 0, np.diff(sums) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    return small_batches(rows).mapInArrow(run, "id long, n_words long, n_features long, weight long")


def drawn(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """scored, a saved table (id, n_words, ..., score), with rank: of the rows with least_words words the floored `percent` percent of highest scores, 1, 2, 3, ...; ties to smaller ids. Null for the rest.

    A histogram of scores gives the score at which the draw ends: scores are whole numbers between two logarithms, so there are at most some 200,000
    of them. Only rows from it on are put in order, in blocks.
    """
    may = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    levels = sorted(((r.score, r["count"]) for r in scored.where(may).groupBy("score").count().collect()), reverse=True)
    most = percent * sum(n for _, n in levels) // 100
    floor, so_far = None, 0
    for score, n in levels:
        if so_far >= most:
            break
        floor, so_far = score, so_far + n
    none = F.lit(None).cast("long").alias("rank")
    if floor is None:
        return scored.select("*", none)
    near = may & (F.col("score") >= floor)
    ranked = numbered(scored.where(near), [], [-F.col("score"), "id"], "nth")
    return ranked.select(*scored.columns, F.when(F.col("nth") <= most, F.col("nth")).alias("rank")).unionByName(scored.where(~near).select("*", none))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """(id_col, n_words, n_features, weight, score, rank) per row of docs: how much its hashed features look like the target, that weight plus noise, and its place in the draw.

    Every text is scanned once; what is kept of it, four bytes a feature, is written to the shared folder and counted and weighed there. The driver gets a number
    per bucket and per score. Repeated rows have a row each and equal scores; null texts have no feature and weight 0; null ids have the noise of an empty id;
    other columns are left out; an empty target or corpus counts 0 everywhere.
    """
    corpus = saved(hashed(docs, id_col, text_col, ngram, buckets), "features")
    wanted = saved(hashed(target, None, target_text, ngram, buckets), "target")
    gain = gains(bucket_counts(corpus, buckets), bucket_counts(wanted, buckets), buckets)
    scored = saved(weighted(corpus, gain).withColumn("score", F.col("weight") + noise("id", seed)), "scored")
    return drawn(scored, least_words, percent).withColumnRenamed("id", id_col)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight towards the benchmark's texts and its place in the draw."""
    out = resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: The checksum of a word byte by byte; bytes come from the hexadecimal digits.
_BYTES = "list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)"
_STEP = "xor(c >> 1, (c & 1) * 3988292384)"
SQL = f"""
WITH RECURSIVE table0(b, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT b, {_STEP}, k + 1 FROM table0 WHERE k < 8),
lookup AS (SELECT list(c ORDER BY b) AS t FROM table0 WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w, row_number() OVER () AS r FROM documents),
e AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
f AS (SELECT r, unnest(w) AS w FROM d),
x AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM f UNION SELECT w FROM e)),
crc AS (SELECT w, xor(list_reduce({_BYTES}, lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS bucket FROM x, lookup),
s AS (SELECT bucket, count(*) AS s FROM f JOIN crc USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM e JOIN crc USING (w) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM f) AS ss, (SELECT count(*) FROM e) AS tt),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (ss + {BUCKETS}))::DOUBLE / ((coalesce(s, 0) + 1) * (tt + {BUCKETS}))::DOUBLE))::BIGINT AS gain FROM (SELECT DISTINCT bucket FROM crc) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), n),
m AS (SELECT r, floor(sum(gain) / count(*))::BIGINT AS weight FROM f JOIN crc USING (w) JOIN g USING (bucket) GROUP BY r),
o AS (SELECT doc_id, r, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('{SEED}:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN m USING (r)),
p AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM o WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * (SELECT count(*) FROM p) // 100 THEN rank END AS rank FROM o LEFT JOIN p USING (r)
"""
