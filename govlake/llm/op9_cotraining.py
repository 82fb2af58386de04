"""Quality classifier by co-training of a text view and a metadata view."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from govlake.llm.arrays import U, chunks, lean, list_array, ragged, words, worker_state
from govlake.llm.store import numbers, saved, small_batches

#: Bound of the labelled rows that the driver fits on.
LABELLED = 4000
WORD_BITS = 16
STEMS = (4, 6)  # a word also counts by its first bytes, as inflected forms share them
PLACES = 64  # hashed places of source and language
ROUNDS, PER_ROUND, CONFIDENT = 5, 200, 0.95
PSEUDO = 0.1  # pseudo-labelled rows of a class weigh at most so much of its labelled ones together
HOLD_OUT = 4  # one of so many labelled rows is left for calibration
#: The threshold has the least GOOD_COST * (share of held-out good rows rejected) + (share of held-out bad rows kept).
GOOD_COST = 10

SLICE = 512  # rows scored at once, so that a task's memory doesn't grow with Arrow's batches

_SHAPES = 9
META = 2 * PLACES + _SHAPES
#: words: place and count in 16 bits each (counts from 65,535 on are alike); meta: places of source and language, then the shape.
_FEATURES = "id long, words array<int>, meta array<float>, key long"


def _shape(data: np.ndarray, at: np.ndarray, counts: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Page layout of each row: lengths and shares of kinds of bytes, without its words."""
    kinds = [data == 10, (data >= 48) & (data < 58), (data >= 65) & (data < 91), np.isin(data, np.frombuffer(b"#*$%&|<>!", np.uint8)), data == 124]
    size = np.maximum(np.diff(at), 1)
    sums = [np.diff(np.concatenate([[0], np.cumsum(k)])[at]) for k in kinds]
    n = np.maximum(counts, 1)
    return np.stack([np.log1p(size) / 10, np.log1p(counts) / 10, size / n / 20, np.log1p(sums[0]) / 5, *[s / size * 5 for s in sums[1:]], distinct / n], axis=1).astype(np.float32)


def _place(value: str | None) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode()) % PLACES


@dataclass
class Rows:
    """Both views of some rows: hashed words and stems with their counts, row after row, and metadata."""

    sizes: np.ndarray  # number of places of each row
    places: np.ndarray
    counts: np.ndarray
    meta: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        at = ragged((np.cumsum(self.sizes) - self.sizes)[rows], self.sizes[rows])
        return Rows(self.sizes[rows], self.places[at], self.counts[at], self.meta[rows])

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        return Rows(*(np.concatenate(x) for x in zip(*((p.sizes, p.places, p.counts, p.meta) for p in parts), strict=True)))

    @staticmethod
    def of(batch: pa.RecordBatch | pa.Table) -> Rows:
        """From columns of _FEATURES."""
        packed, meta = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (batch["words"], batch["meta"]))
        both, some = packed.flatten().to_numpy().view(np.uint32), meta.flatten().to_numpy().reshape(-1, 2 + _SHAPES)
        full = np.zeros((len(some), META), np.float32)
        for k in (0, 1):
            full[np.arange(len(some)), k * PLACES + some[:, k].astype(int)] = 1
        full[:, 2 * PLACES :] = some[:, 2:]
        return Rows(np.diff(packed.offsets.to_numpy()).astype(np.int64), (both >> 16).astype(np.int32), (both & 0xFFFF).astype(np.int32), full)

    def columns(self) -> list[pa.Array]:
        """words and meta of _FEATURES."""
        packed = (self.places.astype(np.uint32) << 16 | self.counts.astype(np.uint32)).view(np.int32)
        hot = [self.meta[:, k * PLACES : (k + 1) * PLACES].argmax(axis=1) for k in (0, 1)]
        meta = np.column_stack([*hot, self.meta[:, 2 * PLACES :]]).astype(np.float32)
        return [list_array(packed, self.sizes, pa.int32()), list_array(meta.ravel(), np.full(len(meta), 2 + _SHAPES), pa.float32())]


def view_rows(text: pa.Array, source: list, lang: list):
    """(first row, row after the last, Rows) chunk by chunk."""
    worker_state("co-training", lambda: None)
    for lo, hi, data, at in chunks(text, 1 << 18):
        w = words(data, at, lower=True)
        hashes = np.concatenate([w.hash, *[w.heads(k, lower=True) for k in STEMS]])
        row = np.tile(np.repeat(np.arange(hi - lo), w.counts), 1 + len(STEMS))
        both, n = np.unique((row << WORD_BITS) | (hashes >> U(64 - WORD_BITS)).astype(np.int64), return_counts=True)
        sizes = np.bincount(both >> WORD_BITS, minlength=hi - lo)
        meta = np.zeros((hi - lo, META), np.float32)
        meta[np.arange(hi - lo), [_place(x) for x in source[lo:hi]]] = 1
        meta[np.arange(hi - lo), [PLACES + _place(x) for x in lang[lo:hi]]] = 1
        meta[:, 2 * PLACES :] = _shape(data, at, w.counts, sizes)
        yield lo, hi, Rows(sizes, (both & ((1 << WORD_BITS) - 1)).astype(np.int32), np.minimum(n, 0xFFFF).astype(np.int32), meta)


def features(rows: DataFrame) -> DataFrame:
    """_FEATURES for rows (id, text, source, lang). Rows of equal text, source and language have equal keys."""

    def run(batches):
        for batch in batches:
            source, lang = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for lo, hi, r in view_rows(batch.column(1), source, lang):
                columns = [batch.column(0).slice(lo, hi - lo), *r.columns(), batch.column(4).slice(lo, hi - lo)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "words", "meta", "key"])

    return rows.withColumn("key", F.xxhash64("text", "source", "lang")).mapInArrow(lean(run), _FEATURES)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def apply(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _sums(values: np.ndarray, at: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    """Sums of runs of values that begin at `at`; run i is entry which[i] of n, the others are 0."""
    out = np.zeros(n, np.float32)
    if len(at):
        out[which] = np.add.reduceat(values, at)
    return out


def _descend(times: Callable, back: Callable, squares: np.ndarray, y: np.ndarray, weigh: np.ndarray, width: int, penalty: float, steps: int) -> np.ndarray:
    """Weights and bias of a logistic regression, both classes weighing the same, by accelerated gradient descent.

    times(w): the rows' products with weights; back(x): the columns' products with a number per row; squares: of the rows'
    lengths; weigh: the rows' shares of their class.
    """
    y = y.astype(np.float32)  # one type throughout
    share = (weigh / np.where(y > 0, max(1e-9, 2 * weigh[y > 0].sum()), max(1e-9, 2 * weigh[y == 0].sum()))).astype(np.float32)
    w = look = np.zeros(width + 1, np.float32)
    rate, penalty = np.float32(4 / max(1e-9, float(share @ (squares + 1)))), np.float32(penalty)
    for k in range(steps):
        off = share * (sigmoid(times(look[:-1]) + look[-1]) - y)
        step = look - rate * (np.append(back(off), off.sum()) + penalty * look)
        look, w = step + np.float32(k / (k + 3)) * (step - w), step
    return w


def fit_dense(x: np.ndarray, y: np.ndarray, weigh: np.ndarray | None = None, penalty: float = 1e-4, steps: int = 150) -> np.ndarray:
    x = np.asarray(x, np.float32)
    weigh = np.ones(len(y)) if weigh is None else weigh
    return _descend(lambda w: x @ w, lambda off: x.T @ off, np.einsum("ij,ij->i", x, x), y, weigh, x.shape[1], penalty, steps)


def fit_text(rows: Rows, y: np.ndarray, weigh: np.ndarray, penalty: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights of the text view's places, and bias. Places are scaled by how much commoner they are in one class (naive Bayes
    ratio), so that a few telling words outweigh a text's many others."""
    width, n = 1 << WORD_BITS, len(y)
    row = np.repeat(np.arange(n, dtype=np.int32), rows.sizes)
    held = np.bincount(rows.places, minlength=width)
    good, bad = (np.bincount(rows.places, (weigh * c)[row], width) + 1 for c in (y, 1 - y))
    lean = np.log(good / max(1, weigh @ y) / (bad / max(1, weigh @ (1 - y)))).astype(np.float32)
    value = text_values(rows) * lean[rows.places]
    order = np.argsort(rows.places, kind="stable")
    turned, turned_row = value[order], row[order]
    full = np.flatnonzero(rows.sizes)
    at, used = (np.cumsum(rows.sizes) - rows.sizes)[full], np.flatnonzero(held)
    at_place = (np.cumsum(held) - held)[used]
    del order, row
    w = _descend(lambda w: _sums(value * w[rows.places], at, full, n), lambda off: _sums(turned * off[turned_row], at_place, used, width), _sums(value * value, at, full, n), y, weigh, width, penalty, steps)
    return np.append(w[:-1] * lean, w[-1]).astype(np.float32)


def text_values(rows: Rows) -> np.ndarray:
    """What each place adds: its log count over the fourth root of the row's number of places."""
    return (np.log1p(rows.counts) / np.repeat(np.maximum(rows.sizes, 1) ** 0.25, rows.sizes)).astype(np.float32)


def logits(rows: Rows, weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each row's logit by either view."""
    row = np.repeat(np.arange(len(rows.sizes)), rows.sizes)
    text = np.bincount(row, text_values(rows) * weights[0][:-1][rows.places], len(rows.sizes)) + weights[0][-1]
    return text, apply(rows.meta, weights[1])


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    scale: np.ndarray  # slope and shift of each view's logit
    threshold: float

    def combined(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, ...]:
        """Calibrated probabilities of the views' logits, and the lower of both: what one view rejects the other can't excuse."""
        a, b = (sigmoid(self.scale[i, 0] * z + self.scale[i, 1]) for i, z in enumerate((text, meta)))
        return a, b, np.minimum(a, b)


class Pool:
    """All unlabelled rows. Their features stand in the shared folder, are scored there on executors in each round, and only the surest reach the driver."""

    def __init__(self, rows: DataFrame, known: DataFrame):
        """rows: _FEATURES, read more than once; known: the ids that have a label."""
        self.rows, self.known = rows, known

    def surest(self, weights: list[np.ndarray], used: list[np.ndarray], most: int = PER_ROUND) -> list[tuple[int, int, np.ndarray, Rows]]:
        """(view, label, keys, rows): the `most` rows of each label of which a view is surest, CONFIDENT at least.

        used[i]: keys that view i was given before. Equal rows count once; rows that are equally sure come in the order of their keys.
        """
        sent = self.rows.sparkSession.sparkContext.broadcast((weights, used))

        def run(batches):
            weights, used = sent.value
            for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
                told = logits(Rows.of(batch), weights)
                for i in (0, 1):
                    free = ~np.isin(batch.column("key").to_numpy(), used[1 - i])
                    for label in (1, 0):
                        sure = sigmoid(told[i] if label else -told[i])
                        at = np.flatnonzero(free & (sure >= CONFIDENT))
                        take = batch.select(["id", "key"]).take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), 2 * i + label, np.int32)), *take.columns, pa.array(sure[at].astype(np.float64))], ["kind", "id", "key", "sure"])

        scored = self.rows.select("id", "words", "meta", "key").mapInArrow(lean(run), "kind int, id long, key long, sure double")
        scored = scored.join(self.known.select("id").hint("merge"), "id", "left_anti").groupBy("kind", "key").agg(F.max("sure").alias("sure"))
        nth = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("sure"), "key"))
        best = scored.withColumn("nth", nth).where(F.col("nth") <= most).select("kind", "key").toArrow().sort_by([("kind", "ascending"), ("key", "ascending")])
        kind, keys = best["kind"].to_numpy(), best["key"].to_numpy()
        wanted = numbers(self.rows.sparkSession, {*keys.tolist()}, "key")  # 4 * most rows at most
        table = self.rows.join(F.broadcast(wanted), "key", "left_semi").dropDuplicates(["key"]).select("words", "meta", "key").toArrow().sort_by("key")
        at, found = table["key"].to_numpy(), Rows.of(table)
        sent.destroy()
        return [(k // 2, k % 2, keys[kind == k], found.take(np.searchsorted(at, keys[kind == k]))) for k in range(4)]


def least_cost(good: np.ndarray, bad: np.ndarray, good_cost: float = GOOD_COST) -> float:
    """The threshold of least good_cost * (share of good below it) + (share of bad not below it), in the middle between two scores; the lowest of equal ones."""
    scores = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[scores[0] / 2], (scores[1:] + scores[:-1]) / 2, [(scores[-1] + 1) / 2]])
    lost = np.searchsorted(np.sort(good), cuts) / len(good)
    kept = 1 - np.searchsorted(np.sort(bad), cuts) / len(bad)
    return float(cuts[np.argmin(good_cost * lost + kept)])


def _trust(y: np.ndarray, n: int) -> np.ndarray:
    """1 for the n labelled rows; the pseudo-labelled rows behind them weigh less where they'd outweigh PSEUDO of their class's labelled ones."""
    weigh = np.ones(len(y))
    for c in (0.0, 1.0):
        rest = n + np.flatnonzero(y[n:] == c)
        weigh[rest] = min(1.0, PSEUDO * (y[:n] == c).sum() / max(1, len(rest)))
    return weigh


def co_train(rows: Rows, y: np.ndarray, pool: Pool, held: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Fits both views. In each round each view labels the pool's rows of which it's most sure for the other one,
    up to PER_ROUND of either class; `held` rows calibrate the views (Platt) and set the threshold."""
    fit = (fit_text, lambda r, *rest: fit_dense(r.meta, *rest))
    sets = [[rows.take(np.flatnonzero(~held)), y[~held]] for _ in fit]
    n = len(sets[0][1])
    used = [np.zeros(0, np.int64) for _ in fit]
    weights = [f(*s, np.ones(n)) for f, s in zip(fit, sets, strict=True)]
    for _ in range(rounds):
        for i, label, keys, x in pool.surest(weights, used):
            used[1 - i] = np.concatenate([used[1 - i], keys])
            sets[1 - i] = [Rows.joined([sets[1 - i][0], x]), np.concatenate([sets[1 - i][1], np.full(len(keys), float(label))])]
        weights = [f(*s, _trust(s[1], n)) for f, s in zip(fit, sets, strict=True)]
    told = logits(rows.take(np.flatnonzero(held)), weights)
    scale = []
    for z in told:
        spread = z.std() or 1.0
        slope, shift = fit_dense((z / spread)[:, None], y[held], None, 1e-3, 400)
        scale.append((slope / spread, shift))
    model = Model(*weights, np.array(scale), 0.5)
    score = model.combined(*told)[2]
    model.threshold = least_cost(score[y[held] > 0], score[y[held] == 0])
    return model


def good_rows(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(id, y): y is 1 for rows of quality that aren't toxic. Without a toxic column nothing is toxic, a null toxic flag is no
    flag; other rows without quality are unlabelled, and of rows that repeat an id the worst counts."""
    bad = F.coalesce(F.col(toxic_col) > 0, F.lit(False)) if toxic_col in labels.columns else F.lit(False)
    known = labels.select(F.col(id_col).cast("long").alias("id"), ((F.col(label_col) > 0) & ~bad).cast("int").alias("y"))
    return known.where("id is not null and y is not null").groupBy("id").agg(F.min("y").alias("y"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", labelled: int = LABELLED) -> Model | None:
    """Fits on at most `labelled` labelled rows, picked by the hash of their ids, and on the surest of all unlabelled ones; None if a class has fewer than 8 rows."""
    known = good_rows(labels, id_col, label_col)
    picked = known.orderBy(F.xxhash64("id"), "id").limit(labelled).toArrow().to_pydict()
    y_of = dict(zip(picked["id"], picked["y"], strict=True))
    wanted = numbers(docs.sparkSession, y_of, "id")  # labelled rows at most
    rows = saved(features(_inputs(docs, id_col)), "features")
    table = rows.join(F.broadcast(wanted), "id", "left_semi").groupBy("id").agg(F.min_by(F.struct("words", "meta"), "key").alias("x")).select("id", "x.*").toArrow().sort_by("id")
    y, found = np.array([float(y_of[x] > 0) for x in table["id"].to_pylist()]), Rows.of(table)
    del table
    if min(y.sum(), (1 - y).sum()) < 8:
        return None
    # Held-out rows alternate within each class.
    held = np.zeros(len(y), bool)
    for c in (0.0, 1.0):
        held[np.flatnonzero(y == c)[::HOLD_OUT]] = True
    return co_train(found, y, Pool(rows, known), held)


def _inputs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", cast: str | None = "long") -> DataFrame:
    own = F.col(id_col).cast(cast) if cast else F.col(id_col)
    columns = [own.alias("id"), F.col(text_col).alias("text")]
    return small_batches(docs).select(*columns, F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"))


def _scored(model: Model, text: pa.Array, source: pa.Array, lang: pa.Array):
    """(first row, row after the last, the three scores, kept) of a batch's rows, chunk by chunk."""
    for lo, hi, rows in view_rows(text, source.to_pylist(), lang.to_pylist()):
        scores = model.combined(*logits(rows, [model.text, model.meta]))
        yield lo, hi, scores, scores[2] >= model.threshold


def classify(docs: DataFrame, model: Model | None, id_col: str = "doc_id") -> DataFrame:
    """(id_col, text_score, meta_score, score, kept) per row of docs.

    Without a model (too few labels) scores are null and all rows are kept. Null texts, sources and languages count as
    empty ones. Repeated rows are scored each; equal rows get equal scores. Ids keep their type.
    """
    if model is None:
        nothing = F.lit(None).cast("double")
        return docs.select(F.col(id_col), nothing.alias("text_score"), nothing.alias("meta_score"), nothing.alias("score"), F.lit(True).alias("kept"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for lo, hi, scores, kept in _scored(sent.value, *batch.columns[1:4]):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *[pa.array(np.round(s, 6).astype(np.float64)) for s in scores], pa.array(kept)], ["id", "text_score", "meta_score", "score", "kept"])

    return _inputs(docs, id_col, cast=None).mapInArrow(lean(run), f"id {dict(docs.dtypes)[id_col]}, text_score double, meta_score double, score double, kept boolean").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """docs without the rows that the classifier rejects. Each row is judged where it stands, so nothing is joined, and rows
    with null or repeated ids are judged by their own texts."""
    model = train(docs, labels, id_col)
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            views = [batch.column(c) for c in (text_col, source_col, lang_col)]
            for lo, hi, _, kept in _scored(sent.value, views[0], *(c.cast(pa.string()) for c in views[1:])):
                yield batch.slice(lo, hi - lo).filter(pa.array(kept))

    return docs.mapInArrow(lean(run), docs.schema)


def op9_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both views' calibrated probabilities, the combined score and the verdict for every row of documents, fitted on labels."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, train(docs, labels))
