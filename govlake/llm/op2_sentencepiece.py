"""SentencePiece encoding and decoding with the tokenizers library as backend."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlake.llm.arrays import chunks, lean, list_array, worker_state
from govlake.llm.op5_token_counts import vocabulary_path
from govlake.llm.segments import SegmentCache, decoded, segment_hashes
from govlake.llm.store import small_batches

CACHE = 1 << 18
CHUNK = 1 << 18  # bytes of text at once: their code points, hashes and prefix sums take some forty times as much
MARK = "▁"
# Kinds of pieces and models in the model file.
UNKNOWN, CONTROL, BYTE = 2, 3, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model_type: int
    byte_fallback: bool
    charsmap: bytes
    add_dummy_prefix: bool
    remove_extra_whitespaces: bool


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: numbers of varints, bytes of all else."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            value |= (message[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if message[i - 1] < 128:
                return value

    while i < len(message):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(wire) or varint()
            yield number, message[i : i + size]
            i += size


def read_model(path: str) -> Model:
    with open(path, "rb") as f:
        parts = list(fields(f.read()))
    pieces = [dict(fields(v)) for k, v in parts if k == 1]
    trainer = dict(fields(next((v for k, v in parts if k == 2), b"")))
    normalizer = dict(fields(next((v for k, v in parts if k == 3), b"")))
    return Model(
        [p.get(1, b"").decode() for p in pieces],
        [struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces],
        [p.get(3, 1) for p in pieces],
        trainer.get(3, UNIGRAM),
        bool(trainer.get(35, 0)),
        normalizer.get(2, b""),
        bool(normalizer.get(3, 1)),
        bool(normalizer.get(4, 1)),
    )


def build_tokenizer(model: Model):
    """The tokenizers library's counterpart of a model: normaliser, space mark, scores or merges, byte fallback, decoder."""
    os.environ.setdefault("RAYON_NUM_THREADS", "2")  # the library's threads in a worker, beside those of other tasks
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    index = {p: i for i, p in enumerate(model.pieces)}
    unknown = model.kinds.index(UNKNOWN)
    if model.model_type == UNIGRAM:
        own = Tokenizer(models.Unigram(list(zip(model.pieces, model.scores, strict=True)), unknown, model.byte_fallback))
    elif model.model_type == BPE:
        plain = {p for p, k in zip(model.pieces, model.kinds, strict=True) if k not in (UNKNOWN, CONTROL, BYTE)}
        merges = [(-model.scores[index[p]], index[p[:i]], index[p[i:]], p, i) for p in plain for i in range(1, len(p)) if p[:i] in plain and p[i:] in plain]
        own = Tokenizer(models.BPE(index, [(p[:i], p[i:]) for *_, p, i in sorted(merges)], unk_token=model.pieces[unknown], fuse_unk=True, byte_fallback=model.byte_fallback))
    else:
        raise ValueError(f"model type {model.model_type} isn't known")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] if model.add_dummy_prefix else []
    own.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    own.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else [])])
    return own


#: Flags of a segment or text: the reference library gives other ids; decoding the ids doesn't give the text.
DIFFERS, CHANGED = 1, 2


class Codec:
    """A worker's backend for one model, with the library that made the model beside it for the parity check."""

    def __init__(self, path: str, limit: int):
        import sentencepiece

        m = read_model(path)
        self.backend = build_tokenizer(m)
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cache = SegmentCache(self.encode, -1, limit)
        #: Texts may be encoded in parts if no piece holds a mark behind anything else and the normaliser only marks spaces.
        self.parts = m.byte_fallback and m.model_type == BPE and not m.charsmap and not m.remove_extra_whitespaces and m.add_dummy_prefix and not any(MARK in p.lstrip(MARK) for p in m.pieces)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Flags, then the backend's ids, of each text. Normalised, encoded and decoded in batches by the backend's threads, and held against the reference."""
        found = [e.ids for e in self.backend.encode_batch_fast(texts, add_special_tokens=False)]
        back = self.backend.decode_batch(found, skip_special_tokens=False)
        wanted = self.reference.encode(texts, num_threads=1)
        return [np.array([DIFFERS * (ids != want) + CHANGED * (text != again), *ids], np.uint32) for ids, want, text, again in zip(found, wanted, texts, back, strict=True)]


def codec(path: str, limit: int = CACHE) -> Codec:
    return worker_state(("codec", path, limit), lambda: Codec(path, limit))


def _segments(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of each text's segments: cut before runs of spaces, whose first space isn't part, as the normaliser puts a mark there.

    A text's first segment has no space cut off, and spaces at its end belong to what stands before; the text "" has no segment.
    A mark in the text itself counts as a space, as both become the same pieces.
    """
    gap = (points == 32) | (points == ord(MARK))
    cut = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
    solid = np.append(np.flatnonzero(~gap), len(points))
    heads = rows[:-1][np.diff(rows) > 0]
    cut = cut[solid[np.searchsorted(solid, cut)] < rows[np.searchsorted(rows, cut, "right")]]
    cut = np.setdiff1d(cut, heads, assume_unique=True)
    begin = np.concatenate([heads, cut])
    order = np.argsort(begin, kind="stable")
    begin = begin[order]
    return begin + (order >= len(heads)), np.append(begin[1:], len(points))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, cache_limit: int = CACHE) -> DataFrame:
    """(id_col, n_tokens, ids, round_trip, parity) per row of docs, for the model file at `path`.

    Where no piece of the model holds a space but at its start, a text's ids are those of its segments, cut before runs of
    spaces; each distinct segment is normalised, encoded and decoded once per worker by the backend, and compared with
    the reference library. Other models' texts are encoded whole. ids are the backend's.
    round_trip: decoding gives the text, in every part. parity: the reference library has the same ids, in every part;
    both depend on the row's text alone. Null and empty texts have no ids. Repeated rows are encoded each.
    """
    path = path or vocabulary_path("piece_bpe_32k.model")

    def run(batches):
        own = codec(path, cache_limit)
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column(1), CHUNK):
                if own.parts:
                    _, points, rows = decoded(data, at)
                    begin, end = _segments(points, rows)
                    of = np.searchsorted(begin, rows[:-1], "left")
                    hashes = segment_hashes(points, begin, end)
                    slots = own.cache.slots(hashes, points, begin, end, np.ones(len(begin), bool))
                    flat, size = own.cache.ids(slots), own.cache.length[slots].astype(np.int64)
                    first, marks = np.cumsum(size) - size, np.searchsorted(np.flatnonzero(points == ord(MARK)), rows)
                else:
                    found = own.encode([data[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)])
                    flat, size = np.concatenate(found), np.array([len(x) for x in found])
                    first, of, marks = np.cumsum(size) - size, np.arange(hi - lo), np.zeros(hi - lo + 1, np.int64)
                of = np.append(of, len(size))
                flags, inner = flat[first], np.ones(len(flat), bool)
                inner[first] = False
                n = np.diff(np.concatenate([[0], np.cumsum(size - 1)])[of])
                wrong = [np.diff(np.concatenate([[0], np.cumsum((flags & bit) > 0)])[of]) for bit in (CHANGED, DIFFERS)]
                wrong[0] += np.diff(marks)  # a mark comes back as a space
                lists = list_array(flat[inner].astype(np.int32), n, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int32)), lists, *[pa.array(w == 0) for w in wrong]], ["id", "n_tokens", "ids", "round_trip", "parity"])

    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(lean(run), f"id {kind}, n_tokens int, ids array<int>, round_trip boolean, parity boolean").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id_col, text) per row of encoded, by the backend's decoder in batches. Null and empty lists give an empty text; bytes that aren't UTF-8 give U+FFFD."""
    path = path or vocabulary_path("piece_bpe_32k.model")

    def run(batches):
        own = codec(path)
        for batch in batches:
            texts = own.backend.decode_batch(batch.column(1).to_pylist(), skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, text string").withColumnRenamed("id", id_col)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every row of documents, whether they decode to its text, and whether both libraries agree on it."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
