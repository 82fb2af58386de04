import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from govlake.llm import op11_resampling, op12_divergence, op13_transducer
from govlake.llm.op5_token_counts import classes, vocabulary_path
from govlake.llm.queries import QUERIES
from tests.llm.brute import LOWER
from tests.llm.test_operators import SF, frame

PIECES = ["a", "b", "e", "the", "ing", "'s", "'re", "'", "''", " ", "  ", "\n", "\t", "1", "23", "é", "É", "é", "́", "ß", "İ", "ﬁ", "中", "文", "-", "--", "!", "<|endoftext|>", "<|startoftext|>", "<|end", "😀", "̧", "K", "Å", "x" * 70, "=" * 90, "가", "각", "٣", "\x1c", "\x85", "　", "’s", "ǅ", "\0"]
LONG = ["ab" * 4000, "the" * 3000 + "'s", "'" * 5000 + "s", "word " * 10 + "z" * 3000 + " end", " " * 3000 + "a" + " " * 2000, "." * 2500 + "'s x", "e" + "́" * 3000 + "t"]


def texts(n):
    r = random.Random(5)
    return ["", " ", "a"] + ["".join(r.choice(PIECES) for _ in range(r.randint(1, 60))) for _ in range(n)] + LONG + ["".join(r.choice("etaoinshr") for _ in range(20000))]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_transducers_give_the_library_s_ids_and_text_in_any_pieces(name):
    path, r = vocabulary_path(name), random.Random(7)
    model, own = op13_transducer.model_of(path, classes()), Tokenizer.from_file(path)
    cache = op13_transducer.WordCache(model)
    for text in texts(300):
        want, most = own.encode(text, add_special_tokens=False).ids, r.choice([1, 2, 3, 7, 50, 1000])
        stream, back, got, out, held, k = op13_transducer.Encoder(model, cache), op13_transducer.Decoder(model), [], "", 0, 0
        while k < len(text):
            n = r.randint(1, max(most, len(text) // 200))
            got += stream.feed(text[k : k + n]).tolist()
            held, k = max(held, len(stream.points) + (len(stream.word.held) if stream.word else 0)), k + n
        assert got + stream.close().tolist() == want
        assert held <= model.window + op13_transducer.LONG + 1200 or "́" * 3000 in text
        for k in range(0, len(want), 3):
            out += back.feed(np.array(want[k : k + 3], np.uint32))
        assert out + back.close() == own.decode(want, skip_special_tokens=False)


def test_broken_characters_decode_as_the_library_has_them():
    path, r = vocabulary_path("byte_bpe_50k.json"), random.Random(8)
    model, own = op13_transducer.model_of(path, classes()), Tokenizer.from_file(path)
    for _ in range(300):
        ids = [r.choice([*model.plain.tolist()[120:], 50256, 220]) for _ in range(r.randint(0, 12))]
        back = op13_transducer.Decoder(model)
        assert "".join(back.feed(np.array([i], np.uint32)) for i in ids) + back.close() == own.decode(ids, skip_special_tokens=False)


def test_no_continuation_changes_a_token_before_the_lookahead():
    r = random.Random(2)
    for _ in range(60):  # small proper merge lists over three letters
        symbols, merges = ["a", "b", "c"], []
        while len(merges) < 25:
            pair = (r.choice(symbols), r.choice(symbols))
            if "".join(pair) not in symbols and len("".join(pair)) < 9:
                merges.append(pair)
                symbols.append("".join(pair))
        ahead, rank = op13_transducer.sufficient_lookahead(merges, len), {p: i for i, p in enumerate(merges)}

        def tokens(word, rank=rank):
            out = list(word)
            while best := min(((rank[p], i) for i, p in enumerate(zip(out, out[1:])) if p in rank), default=None):
                out[best[1] : best[1] + 2] = [out[best[1]] + out[best[1] + 1]]
            return out

        for _ in range(100):
            head, tail = "".join(r.choices("abc", k=r.randint(1, 40))), "".join(r.choices("abc", k=r.randint(1, 12)))
            end, whole = 0, tokens(head + tail)
            for i, token in enumerate(tokens(head)):
                end += len(token)
                if end > len(head) - ahead:
                    break
                assert whole[i] == token


def test_merge_lists_without_a_lookahead_are_refused():
    for merges in ([("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")], [("ab", "c"), ("a", "b")]):
        with pytest.raises(ValueError):
            op13_transducer.sufficient_lookahead(merges, len)


def digests(own, text):
    ids = own.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_transducer_of_odd_rows(spark):
    own = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    rows = [*enumerate(texts(60)), (None, None), (3, "again"), (3, "again"), (-9, "z" * 1_500_000 + " é́ " + "<|startoftext|>" * 3 + " a'b" * 400_000)]
    got = op13_transducer.decode(op13_transducer.encode(frame(spark, rows).repartition(3))).collect()
    want = [(i, np.array(ids := own.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), own.decode(ids, skip_special_tokens=False)) for i, t in rows]
    assert sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in got), key=str) == sorted(want, key=str)
    assert op13_transducer.decode(op13_transducer.encode(frame(spark, []))).count() == 0


def test_transducer_query_on_every_document(spark):
    own = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    want = {r.doc_id: digests(own, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op13_transducer"](spark, SF).collect()}
    assert got == want


def odd_texts():
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdeéßЖ中XY0") for _ in range(r.randint(1, 6))) for _ in range(60)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 90))) for _ in range(70)] + [None, "", " ,.; ", "one", "One", "ÀÉ éÀ", "a_b-c'd", "x" * 5000, "same words " * 400, "\0a\0b", "z9 " * 30]


def plain_draw(docs, target, ngram, buckets, least, percent):
    def runs(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, ngram + 1) for i in range(len(w) - n + 1)]

    s, t = (Counter(b for x in texts for b in runs(x)[1]) for texts in ([x for _, x in docs], target))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in {*s, *t}}
    rows = []
    for i, x in docs:
        n, f = runs(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0]))
    return rows, [r[:1] + r[3:] for r in order[: percent * len(order) // 100]]


@pytest.mark.parametrize("ngram,percent", [(1, 10), (3, 55), (2, 100), (1, 0)])
def test_resampling_against_a_plain_version(spark, ngram, percent):
    docs = [*enumerate(odd_texts()), (3, "again " * 25), (3, "again " * 25), (-5, "minus " * 21)]
    target = [t for t in odd_texts() if t and len(t) < 90]
    rows, best = plain_draw(docs, target, ngram, 97, 20, percent)
    got = op11_resampling.resampled(frame(spark, docs).repartition(3), frame(spark, list(enumerate(target))), ngram=ngram, buckets=97, percent=percent).collect()
    assert sorted((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == sorted(rows)
    assert [(r.doc_id, r.weight, r.score) for r in sorted(got, key=lambda r: r.rank or 0) if r.rank] == best
    assert sorted(r.rank for r in got if r.rank) == list(range(1, len(best) + 1))


def test_resampling_of_null_ids_and_empty_tables(spark):
    none = frame(spark, [])
    assert op11_resampling.resampled(none, none).count() == 0
    got = op11_resampling.resampled(frame(spark, [(None, "word " * 30), (4, None)]), none, percent=100).collect()
    assert sorted((r.rank or 0, r.n_features) for r in got) == [(0, 0), (1, 30)]


def test_checksums_compose():
    r = random.Random(1)
    pairs = [("".join(r.choices("aé中 ", k=r.randint(0, 9))).encode(), bytes(r.choices(range(256), k=r.choice([0, 1, 7, 300, 70_000])))) for _ in range(40)]
    got = op11_resampling.composed(*(np.array(x, k) for x, k in (([zlib.crc32(a) for a, _ in pairs], np.uint32), ([zlib.crc32(b) for _, b in pairs], np.uint32), ([len(b) for _, b in pairs], np.int64))))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_a_small_dictionary_gives_the_same_payloads():
    data = " ".join(x or "" for x in odd_texts() * 3).encode()
    at = np.array([0, 100, 100, len(data)])
    want = op11_resampling.features(data := np.frombuffer(data, np.uint8), at, op11_resampling.Dictionary(), 2, 1000)
    small = op11_resampling.Dictionary(limit=7, first=3)
    for _ in range(3):
        for a, b in zip(op11_resampling.features(data, at, small, 2, 1000), want, strict=True):
            assert a.tolist() == b.tolist()
    assert len(small.known) == 7 and small.automaton is not None


def plain_divergences(rows, least=3, top=200, one=10**9):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for lang, source, text in rows]
    out = []
    for lang in {x[0] for x in rows}:
        df = Counter(t for x, _, w in rows if x == lang for t in set(w))
        kept = sorted(t for t, n in df.items() if n >= least)
        count = {s: Counter(t for x, s2, w in rows if (x, s2) == (lang, s) for t in w if df[t] >= least) for s in {s for x, s, _ in rows if x == lang}}
        all_ = Counter()
        for c in count.values():
            all_ += c
        share = {s: {t: 1 + one * (c[t] + 1) // (c.total() + len(kept)) for t in kept} for s, c in [*count.items(), (None, all_)]}
        for s in count:
            pairs = [(sum((share[s][t] - share[o][t]) ** 2 // share[o][t] for t in kept), o) for o in count if o != s]
            terms = [((p - q) ** 2 // q, t) for t in kept if count[s][t] and (p := share[s][t]) > (q := share[None][t])]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, n + 1) for n, (v, item) in enumerate(found[:top] if part == "term" else found)]
    return sorted(out)


def corpus_rows():
    r = random.Random(6)
    return [(r.choice(["en", "de", None]), r.choice(["a", "b", "c", "é", "s5", None]), x) for x in odd_texts() * 4] + [("xx", "only", "lone words"), ("xx", "other", None), ("yy", "q", "one one one one")]


def test_divergences_against_a_plain_version(spark, monkeypatch):
    df = spark.createDataFrame([(*x, 1, "t") for x in corpus_rows()], "lang string, source string, text string, count long, term string").repartition(5)
    want = plain_divergences(corpus_rows(), top=15)
    got = op12_divergence.divergences(df, top=15)
    assert sorted(tuple(x) for x in got.select("lang", "source", "part", "item", "value", "rank").collect()) == want
    assert op12_divergence.divergences(df.limit(0)).count() == 0


def test_stripes_spilled_early_are_the_same():
    rows, r = corpus_rows(), random.Random(3)

    def folded(most):
        held, out = op12_divergence.Stripes(), []
        for i in range(0, len(rows), 7):
            some = rows[i : i + 7]
            texts = [(t or "").encode() for _, _, t in some]
            held.fold(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), [x or "" for x, _, _ in some], [x or "" for _, x, _ in some])
            if held.terms.n > most:
                out += list(held.spill(rows=5))
        return [*out, *held.spill(rows=5)]

    def merged(batches, cut):
        table = op12_divergence.pa.Table.from_batches(batches).sort_by([("lang", "ascending"), ("term", "ascending")]).combine_chunks()
        found = [x for b in op12_divergence._merged(table.to_batches(max_chunksize=cut)) for x in b.to_pylist()]
        return [(x["lang"], x["term"], x["df"], sorted(zip(x["sources"], x["counts"], strict=True))) for x in found]

    want = merged(folded(10**9), 1000)
    assert len({x[:2] for x in want}) == len(want)
    for most, cut in ((0, 1), (40, 3), (40, 1000)):
        assert merged(folded(most), cut) == want


def test_large_counts_stay_exact():
    r = random.Random(9)
    totals = [r.randint(1, 9 * 10**15) for _ in range(300)] + [1, 2, 10**15]
    counts = [r.randint(0, t) - (r.random() < 0.5) for t in totals]
    counts = [max(0, min(c, t - 1)) for c, t in zip(counts, totals, strict=True)]
    got = op12_divergence.probability(np.array(counts), np.array(totals)).tolist()
    assert got == [1 + 10**9 * (c + 1) // t for c, t in zip(counts, totals, strict=True)]


def warc(n, body):
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    return head + body + b"\r\n\r\n"


def test_audit_of_damaged_warc_files(spark, tmp_path):
    import gzip

    from govlake.llm.op3_warc import audit, read_warc

    good = [warc(i, bytes([255, i]) + b" body \r\n\r\n " * i) for i in range(40)]
    bad = list(good)
    bad[3] = bad[3].replace(b"\xff", b"\xfe", 1)  # both would decode to the same character
    bad[7] = bad[7].replace(b"Content-Length", b"Content-Langth")
    bad[11] = warc(11, b"x" * 5).replace(b"Content-Length: 5", b"Content-Length: 99999")
    bad[20] = b""
    bad[30] = bad[30] * 2
    bad[39] = bad[39][:-20]
    for name, parts in (("a", good), ("b", bad)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "one.warc").write_bytes(b"".join(parts))
        (tmp_path / name / "two.warc.gz").write_bytes(b"".join(map(gzip.compress, good[:6])) + (b"" if name == "a" else b"\x1f\x8bbroken"))
        (tmp_path / name / "none.warc").write_bytes(b"")
    a, b = (read_warc(spark, f"file://{tmp_path}/{n}") for n in "ab")
    assert {r.status for r in a.collect()} == {"whole"} and a.count() == 46
    assert [(r.file, r.key) for r in b.where("status <> 'whole'").orderBy("file", "seq").collect()] == [("one.warc", 7), ("one.warc", 11), ("one.warc", 39), ("two.warc.gz", None)]
    assert b"".join(bytes(r.raw) + b"\r\n\r\n" for r in a.where("file = 'one.warc'").orderBy("seq").collect()) == b"".join(good)
    got = {(r.file, r.key, r.status) for r in audit(a, b).collect()}
    assert got == {("one.warc", k, "changed") for k in (3, 7, 11, 39)} | {("one.warc", 20, "missing"), ("one.warc", 30, "extra"), ("two.warc.gz", None, "extra")}
    assert audit(a, a).count() == 0 and audit(a.limit(0), b.limit(0)).count() == 0


def test_audit_of_many_files_and_repeated_keys(spark):
    from govlake.llm.op3_warc import audit

    rows = [(f"f{i % 300}", None if i % 3 == 0 else i % 7, f"r{i}") for i in range(3000)]
    other = [r for i, r in enumerate(rows) if i != 1500] + [("f9", None, "new")]
    other[10] = (other[10][0], other[10][1], "changed")
    a, b = (spark.createDataFrame(x, "file string, key long, record string") for x in (rows, other))
    got = sorted((r.file, str(r.key), r.status) for r in audit(a, b).collect())
    assert got == sorted([(rows[1500][0], str(rows[1500][1]), "missing"), ("f9", "None", "extra"), (rows[10][0], str(rows[10][1]), "changed")])


def test_one_id_with_two_texts(spark):
    from govlake.llm import op6_minhash, op10_substrings
    from tests.llm import brute

    passage = " ".join(f"w{i}" for i in range(40))
    docs = [(1, "a b c " + passage), (1, passage + " d"), (1, passage + " d"), (2, "other words " * 5), (2, "x"), (3, None), (3, passage[:150]), (None, "n"), (None, passage)]
    got = op10_substrings.remove_repeats(frame(spark, docs)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in got) == sorted((str(i), *x) for i, *x in brute.without_repeats(docs))
    table = frame(spark, [(1, "one two three"), (1, "four five"), (1, "four five"), (2, "one two three"), (5, "six")]).withColumnRenamed("key", "__nth")
    kept = op6_minhash.drop_near_duplicates(table, all_texts=True)
    assert sorted((r.doc_id, r.text, r["__nth"]) for r in kept.collect()) == [(1, "four five", "k"), (1, "one two three", "k"), (5, "six", "k")]


def test_many_boilerplate_lines_cost_in_proportion(spark):
    import time

    from govlake.llm.op1_lines import without_boilerplate

    took = []
    for n in (1500, 6000):
        page = "\n".join(f"line {i}" for i in range(n))
        docs = spark.range(60).selectExpr("id doc_id", "'h' source").withColumn("text", F.concat(F.lit(page), F.lit("\nown "), F.col("doc_id").cast("string")))
        without_boilerplate(docs).count()
        began = time.time()
        out = without_boilerplate(docs).select("text", "n_dropped").collect()
        took.append(time.time() - began)
        assert {r.n_dropped for r in out} == {n} and {r.text for r in out} == {f"own {i}" for i in range(60)}
    assert took[1] < 4 * took[0] + 2
