"""How far the term frequencies of each source lie from those of the others and of its language, in exact integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from govlake.llm.arrays import U, chunks, list_array, mix64, ragged, words
from govlake.llm.segments import Table
from govlake.llm.store import BROADCAST_ROWS, saved, small_batches

#: Documents of a language that must hold a term, terms told of each group, what a probability is a share of.
MIN_DOCS, TOP, ONE = 3, 200, 1_000_000_000
#: Stripes, and counts in them, that a task holds before it spills.
STRIPES, CELLS = 1 << 18, 1 << 20
STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Stripes:
    """Hash stripes of a task: for each (language, term) its number of documents and its count in each source."""

    def __init__(self):
        self.langs: dict[str, int] = {}
        self.groups: dict[tuple[int, str], int] = {}
        self.clear()

    def clear(self) -> None:
        self.terms, self.cells = Table(), Table()
        self.df, self.lang, self.count, self.owner, self.group = (np.zeros(1 << 12, np.int64) for _ in range(5))
        self.names: list[bytes] = []

    def full(self) -> bool:
        return self.terms.n > STRIPES or self.cells.n > CELLS

    @staticmethod
    def _slots(table: Table, hashes: np.ndarray, arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Slots of different hashes, which of them are new, and the arrays with room for them."""
        slots = table.find(hashes)
        new = np.flatnonzero(slots < 0)
        slots[new] = table.add(hashes[new])
        if table.n > len(arrays[0]):
            arrays = [np.concatenate([a, np.zeros(max(len(a), table.n), a.dtype)]) for a in arrays]
        return slots.astype(np.int64), new, arrays

    def fold(self, data: np.ndarray, at: np.ndarray, langs: list[str], sources: list[str]) -> None:
        """Adds whole documents that lie one after another in `data`."""
        lang = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int64)
        group = np.array([self.groups.setdefault(x, len(self.groups)) for x in zip(lang.tolist(), sources, strict=True)], np.int64)
        found = words(data, at, lower=True, gaps=~LETTERS)
        if not len(found.hash):
            return
        row = np.repeat(np.arange(len(at) - 1), found.counts)
        new, first, back = np.unique(mix64(found.hash + U(0x9E3779B97F4A7C15) * lang[row].astype(U)), return_index=True, return_inverse=True)
        slots, unknown, (self.df, self.lang) = self._slots(self.terms, new, [self.df, self.lang])
        self.lang[slots[unknown]] = lang[row[first[unknown]]]
        lowered = _LOWER[data].tobytes()
        self.names += [lowered[a:b] for a, b in zip(found.start[first[unknown]].tolist(), found.end[first[unknown]].tolist(), strict=True)]
        # a document's terms, then a group's
        pairs, n = np.unique(row * len(new) + back, return_counts=True)
        term, doc = pairs % len(new), pairs // len(new)
        self.df[slots] += np.bincount(term, minlength=len(new))
        inner, where = np.unique((slots[term] << 32) | group[doc], return_inverse=True)
        cells, unknown, (self.count, self.owner, self.group) = self._slots(self.cells, mix64(inner.astype(U)), [self.count, self.owner, self.group])
        self.owner[cells[unknown]], self.group[cells[unknown]] = inner[unknown] >> 32, inner[unknown] & 0xFFFFFFFF
        np.add.at(self.count, cells[where], n)

    def spill(self, rows: int = 1 << 14):
        """The stripes, which are forgotten."""
        n, m = self.terms.n, self.cells.n
        order = np.argsort(self.owner[:m], kind="stable")
        lengths = np.bincount(self.owner[:m], minlength=n)
        ends = np.cumsum(lengths)
        langs, sources = pa.array(list(self.langs), pa.string()), pa.array([s for _, s in self.groups], pa.string())
        for i in range(0, n, rows):
            stop = min(n, i + rows)
            own = order[ends[i] - lengths[i] : ends[stop - 1]]
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths[i:stop])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(self.lang[i:stop])), pa.array(self.names[i:stop], pa.binary()).cast(pa.string()), pa.array(self.df[i:stop]), pa.ListArray.from_arrays(offsets, sources.take(pa.array(self.group[own]))), list_array(self.count[own], lengths[i:stop], pa.int64())],
                ["lang", "term", "df", "sources", "counts"],
            )
        self.clear()


def stripes(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Stripes (lang, term, df, sources, counts) of docs: each task folds whole documents into hash stripes, spills those beyond a bound, and all are merged by key.

    A term is a run of ASCII letters and non-ASCII characters, A-Z in lower case. Null columns count as empty strings. Within a task terms are known by 64-bit hashes,
    between tasks by themselves. A key has at most a row for each spill of a task, however many documents hold it.
    """

    def run(batches):
        held = Stripes()
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi, data, at in chunks(batch.column(2)):
                held.fold(data, at, langs[lo:hi], sources[lo:hi])
                if held.full():
                    yield from held.spill()
        yield from held.spill()

    texts = small_batches(docs).select(*[F.coalesce(F.col(c), F.lit("")) for c in (lang_col, source_col, text_col)])
    parts = texts.mapInArrow(run, STRIPE)
    return parts.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merged, STRIPE)


def _runs(batch: pa.RecordBatch) -> np.ndarray:
    """Whether each row begins another (lang, term)."""
    first = np.ones(len(batch), bool)
    for name in ("lang", "term"):
        column = batch.column(name)
        other = np.asarray(pc.not_equal(column[1:], column[:-1]))
        first[1:] = other if name == "lang" else first[1:] | other
    return first


def _merged(batches):
    """Stripes in the order of their keys, those of one key joined. The last key of a batch waits for the next."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not len(batch):
            continue
        first = _runs(batch)
        run = np.cumsum(first) - 1
        start = np.flatnonzero(first)
        lists = batch.column("sources")
        lengths = pc.list_value_length(lists).to_numpy().astype(np.int64)
        names = lists.flatten().dictionary_encode()
        key = np.repeat(run, lengths) * max(1, len(names.dictionary)) + names.indices.to_numpy().astype(np.int64)
        cells, where = np.unique(key, return_inverse=True)
        counts = np.zeros(len(cells), np.int64)
        np.add.at(counts, where, batch.column("counts").flatten().to_numpy())
        owner = cells // max(1, len(names.dictionary))
        sizes = np.bincount(owner, minlength=len(start))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        joined = pa.RecordBatch.from_arrays(
            [batch.column("lang").take(pa.array(start)), batch.column("term").take(pa.array(start)), pa.array(np.add.reduceat(batch.column("df").to_numpy(), start)), pa.ListArray.from_arrays(offsets, names.dictionary.take(pa.array(cells % max(1, len(names.dictionary))))), list_array(counts, sizes, pa.int64())],
            ["lang", "term", "df", "sources", "counts"],
        )
        held = joined.slice(len(joined) - 1)
        if len(joined) > 1:
            yield joined.slice(0, len(joined) - 1)
    if held is not None:
        yield held


def probability(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(ONE * (count + 1) / total), exact for totals up to 9e15: three long divisions by digits of a thousand."""
    rest, out = count + 1, np.zeros(len(count), np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); no intermediate exceeds 64 bits, as p and q are at most ONE + 1."""
    return (p - q) ** 2 // q


def _sql_probability(count: Column, total: Column) -> Column:
    """`probability` as a column: decimals hold ONE times a count."""
    product = (count + 1).cast("decimal(20,0)") * F.lit(ONE).cast("decimal(10,0)")
    return F.call_function("div", product, total.cast("decimal(20,0)")) + 1


def _sql_excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


class Emitter:
    """What a task's merged stripes give: for each two groups that share terms a correction to what their terms give one by one, and each group's highest terms."""

    def __init__(self, totals: dict, top: int):
        """totals: (lang, source) -> count total plus number of kept terms; source None for the whole language."""
        self.totals, self.top = totals, top
        self.codes = {k: i for i, k in enumerate(totals)}
        self.names = list(totals)
        self.total = np.array([totals[k] for k in self.names] or [1], np.int64)
        self.zero = probability(np.zeros(len(self.total), np.int64), self.total)
        self.pairs: dict[int, int] = {}
        self.best: pa.Table | None = None

    def add(self, batch: pa.RecordBatch) -> None:
        lengths = pc.list_value_length(batch.column("sources")).to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(batch)), lengths)
        langs, sources = batch.column("lang").dictionary_encode(), batch.column("sources").flatten().dictionary_encode()
        known = np.array([[self.codes.get((x, s), -1) for s in [*sources.dictionary.to_pylist(), None]] for x in langs.dictionary.to_pylist()], np.int64)
        lang = langs.indices.to_numpy()
        group, whole = known[lang[row], sources.indices.to_numpy()], known[lang, -1]
        count = batch.column("counts").flatten().to_numpy()
        p = probability(count, self.total[group])
        q = probability(np.add.reduceat(count, np.cumsum(lengths) - lengths), self.total[whole])[row]
        self._best(batch, row, group, p, q)
        self._pairs(lengths, group, p)

    def _best(self, batch, row, group, p, q) -> None:
        over = np.flatnonzero(p > q)
        table = pa.table({"group": group[over], "value": excess(p[over], q[over]), "term": batch.column("term").take(pa.array(row[over]))})
        if self.best is not None:
            table = pa.concat_tables([self.best, table])
        table = table.sort_by([("group", "ascending"), ("value", "descending"), ("term", "ascending")]).combine_chunks()
        own = table.column("group").to_numpy()
        first = np.searchsorted(own, own)
        self.best = table.filter(pa.array(np.arange(len(own)) - first < self.top)).combine_chunks()

    def _pairs(self, lengths, group, p, room: int = 1 << 20) -> None:
        """Both groups hold the term: f(p, q) less what f is where either count is 0, plus f of two zeros."""
        partners, start = np.repeat(lengths, lengths), np.repeat(np.cumsum(lengths) - lengths, lengths)
        upto, lo = np.cumsum(partners), 0
        while lo < len(group):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + room)))
            a, b = np.repeat(np.arange(lo, hi), partners[lo:hi]), ragged(start[lo:hi], partners[lo:hi])
            lo = hi
            apart = a != b
            a, b = a[apart], b[apart]
            value = excess(p[a], p[b]) - excess(p[a], self.zero[group[b]]) - excess(self.zero[group[a]], p[b]) + excess(self.zero[group[a]], self.zero[group[b]])
            keys, where = np.unique(group[a] * len(self.names) + group[b], return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, where, value)
            for k, v in zip(keys.tolist(), sums.tolist(), strict=True):
                self.pairs[k] = self.pairs.get(k, 0) + v

    def rows(self):
        n = len(self.names)
        out = [(*self.names[k // n], "pair", self.names[k % n][1], v) for k, v in self.pairs.items()]
        if self.best is not None:
            out += [(*self.names[r["group"]], "term", r["term"], r["value"]) for r in self.best.to_pylist()]
        for i in range(0, len(out), 1 << 14):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out[i : i + (1 << 14)], strict=True)], ["lang", "source", "part", "item", "value"])


def divergences(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for each source of each language: its divergence from every other source of the language ("pair"), and the
    `top` terms that it uses more often than the language does ("term").

    A language keeps the terms of at least min_docs of its documents. p = 1 + floor(ONE * (count + 1) / (N + V)), N the count of all kept terms and V their number;
    the value is floor((p - q)^2 / q), for pairs summed over all kept terms. A pair's sum is V times the value of two zeros, plus for each term of either source what it adds
    beside a zero, by a histogram of counts, plus a correction for shared terms, so no term is held against all sources. Null columns count as empty strings; documents that stand
    twice count twice; a source without terms has p's of counts 0; other columns take no part; an empty table gives no rows. (language, source) groups beyond
    BROADCAST_ROWS, whose pairs no table could hold, raise ValueError.
    """
    kept = saved(stripes(docs, lang_col, source_col, text_col).where(F.col("df") >= min_docs), "stripes")
    groups = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source")).distinct()
    cells = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).select("lang", F.col("c.sources").alias("source"), F.col("c.counts").alias("count"))
    histogram = saved(cells.groupBy("lang", "source", "count").agg(F.count("*").alias("n")), "histogram")
    sums = histogram.groupBy("lang", "source").agg(F.sum(F.col("count") * F.col("n")).alias("total"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("v"))
    sized = saved(groups.join(sums, ["lang", "source"], "left").join(terms, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v")), "sizes")
    if sized.count() > BROADCAST_ROWS:
        raise ValueError("too many groups of language and source")
    totals: dict = {}
    for r in sized.where("v > 0").collect():
        totals[r.lang, r.source] = r.total + r.v
        totals[r.lang, None] = totals.get((r.lang, None), r.v) + r.total
    known = docs.sparkSession.sparkContext.broadcast(totals)

    def emit(batches):
        out = Emitter(known.value, top)
        for batch in batches:
            if len(batch):
                out.add(batch)
        yield from out.rows()

    emitted = saved(kept.mapInArrow(emit, "lang string, source string, part string, item string, value long"), "emitted")
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = emitted.where("part = 'term'").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    pairs = _pair_sums(sized, histogram, emitted).withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(best)


def _pair_sums(sized: DataFrame, histogram: DataFrame, emitted: DataFrame) -> DataFrame:
    """(lang, source, part, item, value) of each two sources of a language."""
    own = sized.select("lang", "source", (F.col("total") + F.col("v")).alias("own_total"), "v")
    other = F.broadcast(sized.select("lang", F.col("source").alias("item"), (F.col("total") + F.col("v")).alias("other_total")))
    zero = _sql_probability(F.lit(0), F.col("own_total"))
    other_zero = _sql_probability(F.lit(0), F.col("other_total"))
    base = own.join(other, "lang").where("source <> item").select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * _sql_excess(zero, other_zero)).otherwise(0).alias("value"))
    one = histogram.join(F.broadcast(own), ["lang", "source"]).join(other, "lang").where("source <> item")
    p = _sql_probability(F.col("count"), F.col("own_total"))
    sides = F.array(
        F.struct(F.col("source").alias("source"), F.col("item").alias("item"), (F.col("n") * (_sql_excess(p, other_zero) - _sql_excess(zero, other_zero))).alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("n") * (_sql_excess(other_zero, p) - _sql_excess(other_zero, zero))).alias("value")),
    )
    single = one.select("lang", F.explode(sides).alias("s")).select("lang", "s.*")
    shared = emitted.where("part = 'pair'").select("lang", "source", "item", "value")
    return base.unionByName(single).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of every source of documents."""
    return divergences(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("rank", F.col("rank").cast("int"))


SQL = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc, regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, doc, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
z AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS (SELECT z.lang, z.source, k.term, coalesce(c.n, 0) AS n, 1 + ({ONE}::HUGEINT * (coalesce(c.n, 0) + 1)) // (total + v) AS p FROM z JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = z.lang AND c.source = z.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + ({ONE}::HUGEINT * (sum(n) + 1)) // (any_value(total) + any_value(v)) AS q FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM z GROUP BY lang) USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) AS s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', item, value::BIGINT, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms QUALIFY rank <= {TOP}
"""
