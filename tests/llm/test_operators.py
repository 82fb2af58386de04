import hashlib
import random
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from tokenizers import Tokenizer

from govlake.llm import op1_lines, op2_sentencepiece, op3_warc, op4_quality_rules, op5_token_counts, op6_minhash, op7_repair, op8_benchmark, op9_cotraining, op10_substrings
from govlake.llm.queries import ORACLE_SQL, QUERIES
from govlake.llm.segments import SegmentCache, code_point_classes
from govlake.llm.store import components
from tests.compare import check_sql
from tests.llm import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bands string, id long, key string, page string"


def frame(spark, docs):
    """Rows (id, text) as documents, with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, None if (i or 0) % 5 == 0 else "en", None if (i or 0) % 7 == 0 else "s", 0, "b", 7, "k", "p") for i, t in docs], SCHEMA)


@pytest.fixture(scope="module")
def docs():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(400)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 220))) for _ in range(50)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    texts += [t + "\n" + passage for t in texts[:6]] + texts[3:8]
    for t in texts[10:25]:  # near copies of different closeness
        w = t.split()
        for k in r.sample(range(len(w)), max(1, len(w) // r.choice([12, 25, 40, 80]))):
            w[k] = r.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [None, "", " \n\t ", "one", "One", "two words", "<|endoftext|> it's  we'll\n\n x", "x" * 5000, ("go on " * 300).strip(), ("p q r s t u v w z " * 12).strip(), " ".join(vocabulary * 8), "中文 текст ١٢ a b '’s \x1c\x85", "# | < >\nsame line\nsame line\n\n"]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def table(spark, docs):
    return frame(spark, docs).repartition(3).cache()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    check_sql(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)] + [(5, 5)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for p in links for x in p}
    for _ in range(70):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: c for x, c in root.items() if x in got} and {x for p in links if p[0] != p[1] for x in p} == set(got)


def test_near_duplicates(table, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op6_minhash.near_duplicates(table).collect()}
    assert got == brute.near(docs)


def test_near_duplicates_in_one_large_group(spark):
    """Copies of one base, many of them too far from each other to be linked directly."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(160):
        w = list(base)
        for k in r.sample(range(120), r.choice([0, 2, 3, 4, 6, 9])):
            w[k] = f"n{i}x{k}"
        docs.append((i, " ".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in op6_minhash.near_duplicates(frame(spark, docs)).collect()}
    assert got == brute.near(docs)


def test_circulant_signature_estimates_similarity():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 63, 600).astype(np.uint64)
    b = np.concatenate([a[:480], r.integers(0, 1 << 63, 120).astype(np.uint64)])
    same = (op6_minhash.signature(a, 512) == op6_minhash.signature(b, 512)).mean()
    assert abs(same - 480 / 720) < 0.08


def test_near_duplicates_drop(table, docs):
    kept = op6_minhash.drop_near_duplicates(table.unionAll(table.where("doc_id = 3")))
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in brute.near(docs).items() if x[2])


def test_difference_covers():
    for period, cover in op10_substrings.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_repeated_windows(table, docs):
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in op10_substrings.remove_repeats(table).collect())
    assert got == sorted(brute.without_repeats(docs))
    assert sum(r[2] for r in got) > 100


def test_repeated_rows_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long), (1, long), (None, long + " x"), (None, "a b"), (2, "c")]
    got = Counter_of(op10_substrings.remove_repeats(frame(spark, rows)))
    assert got == sorted(brute.without_repeats(rows), key=str)
    kept = {(r.doc_id, r.kept) for r in op6_minhash.near_duplicates(frame(spark, rows)).collect()}
    assert kept == {(1, True), (None, True), (2, True)}


def Counter_of(df):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.text) for r in df.collect()], key=str)


def test_quality_rules(spark, table, docs):
    trusted = spark.createDataFrame([(i,) for i in range(0, 40, 2)], "doc_id long")
    got = {r.doc_id: r for r in op4_quality_rules.quality(table, trusted).collect()}
    for i, text in docs:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base(text), text
        assert r.kept == (not r.base_failed and r.score >= op4_quality_rules.THRESHOLD)
    nobody = op4_quality_rules.quality(table, trusted.limit(0))
    assert all(r.kept != r.base_failed for r in nobody.collect())


def test_quality_score_is_the_mean_ratio(spark, table):
    """With one bucket per n-gram hash, the score equals a plain mean over the n-grams' ratios."""
    trusted = spark.createDataFrame([(0,), (2,)], "doc_id long")
    numbers = op4_quality_rules.ratios(table, trusted).first()[0]
    grams = {r.doc_id: r.g for r in table.select("doc_id", op4_quality_rules.ngram_buckets(table.text).alias("g")).collect()}
    for r in op4_quality_rules.quality(table, trusted).collect():
        want = sum(numbers[b] for b in grams[r.doc_id]) / len(grams[r.doc_id]) if grams[r.doc_id] else None
        assert r.score == pytest.approx(want) if want is not None else r.score is None
    good = [b for i in (0, 2) for b in grams[i]]
    every = [b for g in grams.values() for b in g]
    b = good[0]
    raw = (every.count(b) + 1) / (len(every) + op4_quality_rules.BUCKETS)
    assert numbers[b] == pytest.approx(np.log((1 - op4_quality_rules.MIX) * good.count(b) / len(good) / raw + op4_quality_rules.MIX))


@pytest.fixture(scope="module")
def encoded(docs):
    own = Tokenizer.from_file(op5_token_counts.vocabulary_path("byte_bpe_50k.json"))
    return {i: own.encode(t or "", add_special_tokens=False).ids for i, t in docs}


def test_token_counts(table, docs, encoded):
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in op5_token_counts.count_tokens(table, table_size=50, sample_rows=10).collect()}
    assert got == {i: (len((t or "").encode()), len(encoded[i])) for i, t in docs}


def test_segments_cut_like_the_library():
    from govlake.llm.op7_repair import pieces
    from govlake.llm.segments import SPACE

    own = Tokenizer.from_file(op5_token_counts.vocabulary_path("byte_bpe_50k.json"))
    kinds = code_point_classes()
    cache = SegmentCache(lambda x: [np.array(e.ids, np.uint32) for e in own.encode_batch(x, add_special_tokens=False)], 198, limit=40)
    r = random.Random(1)
    alphabet = ["'", "'s", "'re", "'ll", "t", "l", " ", "  ", "\n", "\t", " ", "　", "é", "1", "²", "!", "?", "中", "\x1c", "\x85", "😀", "I'm", "\r\n", "_", "a"]
    for _ in range(400):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(1, 30)))
        data = np.frombuffer(text.encode(), np.uint8)
        points, begin, end, hashes, _ = pieces(data, np.array([0, len(data)]), kinds)
        slots = cache.slots(hashes, points, begin, end, kinds[points[end - 1]] == SPACE)
        assert cache.ids(slots).tolist() == own.encode(text, add_special_tokens=False).ids, repr(text)


def test_shards(spark, table, encoded, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    op7_repair.write_shards(table, block_ids=1500).write.parquet(str(tmp_path / "ids"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shards = spark.read.parquet(str(tmp_path / "ids"))
    assert shards.count() > 1
    out = op7_repair.with_start(op7_repair.read_checksums(shards), shards).collect()
    lists = op7_repair.with_start(op7_repair.read_shards(shards), shards).collect()
    assert {r.id: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in lists} == {r.id: r.ids_crc32 for r in out}
    assert {r.id: r.start for r in lists} == {r.id: r.start for r in out}
    at, want = 0, {}
    for i in sorted(encoded):
        ids = np.array([*encoded[i], 2], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.id: (r.start, r.n_tokens, r.ids_crc32) for r in out} == want
    row = shards.orderBy("part", "block").first().asDict()
    for n, doc in enumerate(row["doc_ids"][:6]):
        ids = [*encoded[doc], 2]
        for i in range(0, len(ids), 5):
            assert op7_repair.read_ids(row | {"document": n}, i, min(4, len(ids) - i)).tolist() == ids[i : i + 4]


def test_grammar_shrinks_and_expands():
    r = np.random.default_rng(1)
    ids = (r.zipf(1.4, 60_000) % 500).astype(np.uint32)
    last = np.zeros(len(ids), bool)
    last[99::100] = True
    symbols, ends, pairs, lengths = op7_repair.compress(ids, last, 500)
    assert len(symbols) < 0.7 * len(ids) and ends.sum() == last.sum() and lengths.max() > 2
    assert (op7_repair.expand(symbols, pairs, 500) == ids).all()


def test_grammar_runs_until_no_pair_is_common():
    """A period of 64 ids, a run of one id, and text-like ids; then no pair occurs LEAST times within a document."""
    r = np.random.default_rng(4)
    for ids in (np.tile(np.arange(64), 2000), np.zeros(100_003, int), (r.zipf(1.3, 50_000) % 900), np.arange(5), np.zeros(0, int)):
        last = np.zeros(len(ids), bool)
        last[997::1000] = last[-1:] = True
        symbols, ends, pairs, lengths = op7_repair.compress(ids.astype(np.uint32), last, 1000)
        assert (op7_repair.expand(symbols, pairs, 1000) == ids).all() and ends.sum() == last.sum()
        inner = ~ends[:-1]
        found, n = np.unique(np.stack([symbols[:-1][inner], symbols[1:][inner]]), axis=1, return_counts=True)
        runs = found[0] == found[1] if len(n) else n
        assert not len(n) or (n[~runs] < op7_repair.LEAST).all() and (n[runs] < 2 * op7_repair.LEAST).all()
        assert [len(op7_repair.expand(np.array([1000 + k]), pairs, 1000)) for k in range(len(pairs))] == lengths.tolist()


def test_symbols_beyond_16_bits():
    ids = np.tile(np.arange(70_000, 70_050, dtype=np.uint32), 200)
    last = np.zeros(len(ids), bool)
    last[-1] = True
    symbols, _, pairs, _ = op7_repair.compress(ids, last, 80_000)
    assert symbols.dtype == np.uint32 and len(symbols) < 20 and (op7_repair.expand(symbols, pairs, 80_000) == ids).all()


def test_shards_with_another_vocabulary_and_odd_ids(spark, tmp_path):
    """A vocabulary that cuts texts in its own way; null and repeated ids."""
    path = op5_token_counts.vocabulary_path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    assert not op5_token_counts.by_pieces(path) and op5_token_counts.by_pieces(op5_token_counts.vocabulary_path("byte_bpe_50k.json"))
    rows = [(3, "Some  Words, again"), (None, "no id"), (3, "and more"), (1, None), (None, "again")]
    shards = op7_repair.write_shards(frame(spark, rows), path=path)
    shards.write.parquet(str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    got = sorted((r.id or -1, tuple(r.ids)) for r in op7_repair.read_shards(back).collect())
    assert got == sorted((i or -1, (*own.encode(t or "", add_special_tokens=False).ids, 2)) for i, t in rows)
    starts = sorted(r.start for r in op7_repair.with_start(op7_repair.read_checksums(back), back).collect())
    ordered = [len(x) for _, x in sorted(((i if i is not None else -1, t or ""), own.encode(t or "", add_special_tokens=False).ids) for i, t in rows)]
    assert starts == np.cumsum([0, *[n + 1 for n in ordered[:-1]]]).tolist()
    counts = sorted((r.doc_id or -1, r.n_tokens) for r in op5_token_counts.count_tokens(frame(spark, rows), path=path).collect())
    assert counts == sorted((i or -1, len(own.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)


def test_very_long_pretoken(spark):
    r = random.Random(8)
    word = "".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(300_000))
    own = Tokenizer.from_file(op5_token_counts.vocabulary_path("byte_bpe_50k.json"))
    want = len(own.encode(word, add_special_tokens=False).ids)
    assert want > 1 << 16
    assert [x.n_tokens for x in op5_token_counts.count_tokens(frame(spark, [(1, word)])).collect()] == [want]


def test_cache_keeps_what_is_met_again():
    own = Tokenizer.from_file(op5_token_counts.vocabulary_path("byte_bpe_50k.json"))
    kinds, calls = code_point_classes(), []
    cache = SegmentCache(lambda x: [calls.append(t) or np.array(e.ids, np.uint32) for t, e in zip(x, own.encode_batch(x, add_special_tokens=False), strict=True)], 198, limit=40)
    from govlake.llm.op7_repair import pieces

    for k in range(30):
        text = " ".join(["often", "met"] + [f"rare{chr(97 + i % 26)}{chr(97 + k % 26)}" for i in range(12)])
        data = np.frombuffer(text.encode(), np.uint8)
        points, begin, end, hashes, _ = pieces(data, np.array([0, len(data)]), kinds)
        slots = cache.slots(hashes, points, begin, end, kinds[points[end - 1]] == 3)
        assert cache.ids(slots).tolist() == own.encode(text, add_special_tokens=False).ids
    assert sum(" met\n" in c for c in calls) == 1


def test_sentencepiece(spark, table, docs):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=op5_token_counts.vocabulary_path("piece_bpe_32k.model"))
    r = random.Random(6)
    more = [(1000 + i, "".join(r.choice(["a", "the", "é", " ", "  ", "\n", "\t", ".", "▁", "中", "1"]) for _ in range(r.randint(1, 14)))) for i in range(400)]
    more += [(2000, " "), (2001, "   "), (2002, "a "), (2003, " a  "), (2004, "x" * 30_000), (2005, "\n"), (2006, " \n ")]
    coded = op2_sentencepiece.encode(table.unionByName(frame(spark, more))).cache()
    got = {r.doc_id: r for r in coded.collect()}
    texts = {r.doc_id: r.text for r in op2_sentencepiece.decode(coded).collect()}
    for i, t in docs + more:
        assert got[i].ids == own.encode(t or "") and got[i].n_tokens == len(got[i].ids) and got[i].parity, repr(t)
        assert got[i].round_trip == ("▁" not in (t or "")) and (texts[i] == (t or "")) == got[i].round_trip, repr(t)


def _field(number, value):
    """A protobuf field: bytes, text, a float or a number."""
    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    if isinstance(value, float):
        return varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def test_unigram_model_with_normaliser_options(spark, tmp_path):
    """A hand-made unigram model; its texts are encoded whole. Rows that the libraries disagree on are told row by row."""
    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{i:02X}>", -9.0, 6) for i in range(256)]]
    pieces += [(p, s, 1) for p, s in [("▁", -2.0), ("▁the", -3.0), ("th", -3.5), ("e", -3.0), ("t", -4.0), ("h", -4.0), ("▁ca", -3.3), ("cat", -4.1), ("c", -5.0), ("a", -4.5), ("s", -4.2), ("ts▁", -1.0)]]
    for squeeze in (0, 1):
        trainer, normaliser = _field(3, 1) + _field(35, 1), _field(3, 1) + _field(4, squeeze) + _field(5, 1)
        path = tmp_path / f"own{squeeze}.model"
        path.write_bytes(b"".join(_field(1, _field(1, p) + _field(2, s) + _field(3, k)) for p, s, k in pieces) + _field(2, trainer) + _field(3, normaliser))
        own = sentencepiece.SentencePieceProcessor(model_file=str(path))
        model = op2_sentencepiece.read_model(str(path))
        assert model.model_type == op2_sentencepiece.UNIGRAM and model.scores[-1] == -1.0 and not op2_sentencepiece.Codec(str(path), 10).parts
        docs = [(0, "the cats the cat"), (1, "  the  cats "), (2, "é zz"), (3, ""), (4, None), (5, "cats cats")]
        coded = op2_sentencepiece.encode(frame(spark, docs), path=str(path)).collect()
        for r in coded:
            text = dict(docs)[r.doc_id] or ""
            assert r.parity == (r.ids == own.encode(text)) and r.round_trip == (own.decode(r.ids) == text)
        assert sum(r.parity for r in coded) == len(docs)


def test_rebuilt_tokenizer_agrees_on_whole_texts(docs):
    import sentencepiece

    path = op5_token_counts.vocabulary_path("piece_bpe_32k.model")
    own, built = sentencepiece.SentencePieceProcessor(model_file=path), op2_sentencepiece.build_tokenizer(op2_sentencepiece.read_model(path))
    texts = [t for _, t in docs if t and "\x1c" not in t]
    agree = [built.encode(t, add_special_tokens=False).ids == own.encode(t) for t in texts]
    assert sum(agree) == len(agree)
    assert built.decode(built.encode("  two  words\n").ids) == "  two  words\n"


def test_warc_round_trip_and_audit(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"https://x.org/{i}", "a\r\n\r\nb" * (i % 5) or None) for i in range(300)], "page_id long, url string, html string")
    records = op3_warc.warc_records(pages, per_file=40)
    op3_warc.write_warc(records, str(tmp_path / "w"))
    back = op3_warc.read_warc(spark, str(tmp_path / "w"))
    assert {(r.file, r.record) for r in back.collect()} == {(r.file, r.record) for r in records.collect()}
    placed = {(r.file, r.seq): r.offset for r in op3_warc.leaves(records).collect()}
    assert {(r.file, r.seq): r.offset for r in back.collect()} == placed
    assert op3_warc.audit(records, records).count() == 0
    found = op3_warc.audit(records, op3_warc.damaged(records, 50).where("key <> 299"))
    assert {(r.key, r.status) for r in found.collect()} == {(i, "changed") for i in range(5, 300, 50)} | {(299, "missing")}
    assert op3_warc.audit(records.limit(0), records.limit(0)).count() == 0


def test_audit_finds_records_lost_and_gained_in_mid_file(spark):
    schema = "file string, key long, record string"
    kept = [("f", k, f"record {k}") for k in range(0, 900, 3)] + [("g", k, f"record {k}") for k in range(-40, 40)] + [("g", None, "no key"), ("g", 5, "record 5 again"), ("h", 1, "only in one")]
    lost = {("f", 300, "record 300"), ("f", 603, "record 603"), ("g", -17, "record -17"), ("g", 5, "record 5"), ("h", 1, "only in one")}
    other = [x for x in kept if x not in lost and x[1] != 450] + [("f", 450, "much longer than it was"), ("f", 301, "new"), ("g", None, "no key"), ("i", 2**40, "far")]
    found = op3_warc.audit(spark.createDataFrame(kept, schema), spark.createDataFrame(other, schema))
    want = {("f", 450, "changed"), ("f", 301, "extra"), ("g", None, "extra"), ("i", 2**40, "extra")} | {(f, k, "missing") for f, k, _ in lost}
    rows = found.collect()
    assert {(r.file, r.key, r.status) for r in rows} == want and len(rows) == len(want)
    assert next(r for r in rows if r.key == 300).seq == 100


def test_lines(spark):
    docs = [(i, f"head\nbody {i}\n  foot \n\n") for i in range(1, 7)] + [(8, None), (9, ""), (10, "foot")]
    for most in (100, 0):  # broadcast and shuffled
        done = {r.page.doc_id: r for r in op1_lines.without_boilerplate(frame(spark, docs), ratio=0.4, broadcast_lines=most).collect()}
        assert done[1].text == "body 1\n\n" and done[1].n_dropped == 2 and done[1].n_lines == 5
        assert done[8].text is None and done[8].n_lines == 0 and done[9].text == "" and done[10].text == ""
    assert op1_lines.drop_boilerplate(frame(spark, docs)).columns == frame(spark, docs).columns


def test_lines_against_a_plain_version(spark):
    """Hosts of 1 to 40 pages, null hosts, ids and texts, repeated rows; both ways of the join."""
    r = random.Random(9)
    docs = []
    for k, host in enumerate([None, "", "a", "b", "c"]):
        for i in range([1, 4, 9, 23, 40][k]):
            lines = [r.choice(["  top ", "foot\t", "", "menu", f"own {k} {i}"]) for _ in range(r.randint(0, 6))]
            docs.append((None if r.random() < 0.1 else 100 * k + i, r.choice(["\n".join(lines)] * 9 + [None]), host))
    docs += docs[20:24]
    table = spark.createDataFrame([(i, t, h, "x") for i, t, h in docs], "doc_id long, text string, source string, key string")
    pages = [(h or "", {x.strip(" \t\r\x0b\x0c") for x in (t or "").split("\n")} - {""}) for _, t, h in docs]
    bad = set()
    for host in {h for h, _ in pages}:
        own = [x for h, x in pages if h == host]
        bad |= {(host, x) for x in set().union(*own) if sum(x in y for y in own) > 0.3 * len(own)}
    want = sorted((str(i), str(None if t is None else "\n".join(x for x in t.split("\n") if (h or "", x.strip(" \t\r\x0b\x0c")) not in bad))) for i, t, h in docs)
    for most in (10**6, 0):
        got = op1_lines.without_boilerplate(table, ratio=0.3, broadcast_lines=most).collect()
        assert sorted((str(x.page.doc_id), str(x.text)) for x in got) == want


def test_one_id_with_several_texts(spark):
    """Such an id is one document: linked wherever one of its texts is. Dropping keeps the row of its smallest text."""
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(5, a), (5, b), (3, a + " x"), (9, b), (7, "alone " * 6), (None, a), (None, a)]
    got = {(r.doc_id, r.component_id) for r in op6_minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (7, 7), (None, None)}
    kept = op6_minhash.drop_near_duplicates(frame(spark, [*rows, (3, "z")]))
    assert sorted(((r.doc_id or 0), r.text) for r in kept.collect()) == sorted([(0, a), (0, a), (3, a + " x"), (7, "alone " * 6)])


def test_leaks(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdef") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([40, 25, 9, 3, 1])] + [(7, None), (8, "")]
    filler = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, f"{filler(400)} {t.upper()}\n{filler(300)}") for i, t in items if t] + [(20, filler(900)), (21, None), (22, "")]
    w = items[0][1].split()
    docs += [(30, f"{filler(50)} {' '.join(w[:33])} {filler(50)}"), (31, f"{filler(50)} {' '.join(w[:28])} {filler(50)}"), (30, "repeated id")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, hash string")
    docs += [(None, "x " + items[1][1]), (None, "nothing")]
    got = {(x.id, x.item_id) for x in op8_benchmark.leaks(frame(spark, docs), bench).collect()}
    assert got == {(i, i) for i in range(5)} | {(30, 0), (None, 1)}
    assert op8_benchmark.leaks(frame(spark, docs), bench.limit(0)).count() == 0
    assert {x.doc_id for x in op8_benchmark.drop_leaks(frame(spark, docs), bench).collect()} == {20, 21, 22, 30, 31, None}
    assert {x.text for x in op8_benchmark.drop_leaks(frame(spark, docs), bench).where("doc_id is null or doc_id = 30").collect()} == {"nothing", "repeated id"}


def test_classifier_on_held_out_labels(spark):
    """Clean documents are of quality and not toxic; labels that weren't fitted on."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fitted, other = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    got = op9_cotraining.classify(docs, op9_cotraining.train(docs, fitted)).join(other, "doc_id").collect()
    clean = [r.kept for r in got if r.quality == 1 and r.toxic == 0]
    junk = [r.kept for r in got if r.quality == 0]
    toxic = [r.kept for r in got if r.quality == 1 and r.toxic == 1]
    assert len(toxic) > 50
    assert sum(clean) / len(clean) > 0.99 and sum(junk) / len(junk) < 0.05 and sum(toxic) / len(toxic) < 0.25


def test_good_rows_take_nulls_and_repeats(spark):
    rows = [(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 1, None), (5, None, 1), (None, 1, 0), (6, 1, 0), (6, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert {(r.id, r.y) for r in op9_cotraining.good_rows(labels).collect()} == {(1, 1), (2, 0), (3, 0), (4, 1), (5, 0), (6, 0)}
    assert {(r.id, r.y) for r in op9_cotraining.good_rows(labels.drop("toxic")).collect()} == {(1, 1), (2, 1), (3, 0), (4, 1), (6, 1)}


def _rows_of(words, meta):
    """Rows of the text view's places and a first metadata column."""
    full = np.zeros((len(words), op9_cotraining.META), np.float32)
    full[:, 0] = meta
    sizes = np.array([len(w) for w in words])
    places = np.array([x for w in words for x in sorted(w)], np.int32)
    return op9_cotraining.Rows(sizes, places, np.ones(len(places), np.int32), full)


def test_text_view_against_dense_products():
    r = np.random.default_rng(2)
    words = [set(r.integers(0, 50, r.integers(0, 9)).tolist()) for _ in range(80)]
    rows, y = _rows_of(words, 0), (r.random(80) > 0.4).astype(float)
    weigh = r.random(80) + 0.1
    w = op9_cotraining.fit_text(rows, y, weigh, steps=60)
    good = np.array([sum(weigh[i] * y[i] for i, x in enumerate(words) if k in x) for k in range(50)]) + 1
    bad = np.array([sum(weigh[i] * (1 - y[i]) for i, x in enumerate(words) if k in x) for k in range(50)]) + 1
    lean = np.log(good / (weigh @ y) / (bad / (weigh @ (1 - y))))
    x = np.array([[np.log(2) / max(1, len(words[i])) ** 0.25 * (k in words[i]) for k in range(50)] for i in range(80)])
    dense = op9_cotraining.fit_dense(x * lean, y, weigh, steps=60)
    assert np.allclose(w[:50], dense[:50] * lean, atol=1e-4) and abs(w[-1] - dense[-1]) < 1e-4
    assert np.allclose(op9_cotraining.logits(rows, [w, np.zeros(op9_cotraining.META + 1)])[0], x @ w[:50] + w[-1], atol=1e-4)


def test_classifier_picks_from_all_unlabelled_rows(spark):
    r = np.random.default_rng(3)
    texts = [f"w{i} " + " ".join(["good"] * int(a) + ["bad"] * int(b)) for i, (a, b) in enumerate(r.integers(0, 30, (2600, 2)))]
    rows = frame(spark, [*enumerate(texts), (2600, texts[0])])
    table = op9_cotraining.features(op9_cotraining._inputs(rows)).toArrow()
    known = spark.createDataFrame([(i, 1) for i in range(0, 2601, 13)], "id long, y int")
    every = op9_cotraining.Rows.of(table)
    weights = [r.normal(0, 9, (1 << op9_cotraining.WORD_BITS) + 1).astype(np.float32), r.normal(0, 2, every.meta.shape[1] + 1).astype(np.float32)]
    keys, ids = table["key"].to_numpy(), table["id"].to_numpy()
    pool = op9_cotraining.Pool(spark.createDataFrame(table).repartition(5), known)
    used = [keys[40:45], keys[:0]]
    for view, label, got, x in pool.surest(weights, used, most=7):
        z = op9_cotraining.logits(every, weights)[view] * (1 if label else -1)
        free = {k: s for k, i, s in zip(keys, ids, z, strict=True) if i % 13 and k not in used[1 - view] and op9_cotraining.sigmoid(s) >= op9_cotraining.CONFIDENT}
        assert len(got) == len({*got}) == min(7, len(free)) and {*got} <= {*free}
        assert sorted(round(float(op9_cotraining.sigmoid(free[k])), 4) for k in got) == sorted(round(float(op9_cotraining.sigmoid(s)), 4) for s in sorted(free.values())[-len(got) :] if len(got))
        want = every.take(np.array([list(keys).index(k) for k in got], int))
        assert (x.places == want.places).all() and (x.sizes == want.sizes).all() and np.allclose(x.meta, want.meta)


def test_threshold_is_not_set_by_one_good_row():
    view = np.array([[1.0]] * 60 + [[-1.1]] + [[-1.0]] * 30, np.float32)
    y = np.array([1.0] * 61 + [0.0] * 30)
    y[60] = 1.0  # a row that looks worse than all bad ones
    held = np.ones(91, bool)
    held[[0, 90]] = False
    rows = _rows_of([{1} if v > 0 else {2} for v in view[:, 0]], view[:, 0])
    model = op9_cotraining.co_train(rows, y, SimpleNamespace(surest=lambda *_: []), held)
    score = model.combined(*op9_cotraining.logits(rows, [model.text, model.meta]))[2]
    assert (score[:60] >= model.threshold).all() and (score[60:] < model.threshold).all()


def test_co_training_against_a_plain_version():
    """The exchange of labels as a plain loop over all rows, with the same fits."""
    r = np.random.default_rng(7)
    y = (r.random(300) > 0.4).astype(float)
    words = [{int(v) for v in r.integers(0, 40, 6)} | ({50 + int(r.integers(0, 3))} if c else {60 + int(r.integers(0, 3))}) for c in y]
    rows = _rows_of(words, y * 2 - 1 + r.normal(0, 0.8, 300))
    held, free = np.arange(100) % 4 == 0, np.arange(100, 300)
    most = 9

    class Pool:
        def surest(self, weights, used):
            told, out = op9_cotraining.logits(rows.take(free), weights), []
            for view in (0, 1):
                for label in (0, 1):
                    sure = op9_cotraining.sigmoid(told[view] if label else -told[view])
                    at = [i for i in np.argsort(-sure, kind="stable") if sure[i] >= op9_cotraining.CONFIDENT and free[i] not in used[1 - view]][:most]
                    out.append((view, label, free[at], rows.take(free[at])))
            return out

    model = op9_cotraining.co_train(rows.take(np.arange(100)), y[:100], Pool(), held, rounds=3)
    own = [{i: (y[i], 1.0) for i in np.flatnonzero(~held)} for _ in range(2)]
    given = [{}, {}]

    def fit(view):
        at = np.array([*own[view], *given[view]])
        label = np.array([*[v for v, _ in own[view].values()], *given[view].values()])
        n, weigh = len(own[view]), np.ones(len(at))
        for c in (0.0, 1.0):
            k = sum(v == c for v in given[view].values())
            weigh[n:][label[n:] == c] = min(1, op9_cotraining.PSEUDO * (label[:n] == c).sum() / k) if k else 1
        return op9_cotraining.fit_text(rows.take(at), label, weigh) if view == 0 else op9_cotraining.fit_dense(rows.meta[at], label, weigh)

    weights = [fit(0), fit(1)]
    for _ in range(3):
        told = op9_cotraining.logits(rows, weights)
        new = [[], []]
        for view in (0, 1):
            for label in (0, 1):
                sure = {i: op9_cotraining.sigmoid(told[view][i] * (1 if label else -1)) for i in free if i not in given[1 - view]}
                new[1 - view] += [(i, float(label)) for i in sorted(sure, key=lambda i: (-sure[i], i)) if sure[i] >= op9_cotraining.CONFIDENT][:most]
        for view in (0, 1):
            given[view].update(new[view])
        weights = [fit(0), fit(1)]
    assert min(map(len, given)) > 0
    assert np.allclose(model.text, weights[0], atol=1e-3) and np.allclose(model.meta, weights[1], atol=1e-3)


def test_keep_good_judges_rows_with_null_and_repeated_ids(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    verdict = {r.doc_id: r.kept for r in op9_cotraining.classify(docs, op9_cotraining.train(docs, labels)).collect()}
    kept = op9_cotraining.keep_good(docs, labels)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {i for i, k in verdict.items() if k} and not all(verdict.values())
    junk = docs.where(f"doc_id = {next(i for i, k in verdict.items() if not k)}").drop("doc_id").selectExpr("cast(null as long) AS doc_id", "*")
    more = docs.unionByName(junk).unionByName(junk)
    assert op9_cotraining.keep_good(more, labels).where("doc_id is null").count() == 0


def test_classifier_without_labels(spark, table):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert op9_cotraining.train(table, labels) is None
    assert op9_cotraining.classify(table, None).where("not kept").count() == 0


def test_classifier_takes_odd_rows(spark, table, docs):
    model = op9_cotraining.train(table, spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int"))
    got = op9_cotraining.classify(table, model).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)


def test_empty_tables(spark, table):
    none = table.limit(0)
    assert op6_minhash.near_duplicates(none).count() == 0
    assert op10_substrings.remove_repeats(none).count() == 0
    assert op5_token_counts.count_tokens(none).count() == 0
    assert op2_sentencepiece.encode(none).count() == 0
    assert op4_quality_rules.quality(none, none.select("doc_id")).count() == 0
    assert op1_lines.without_boilerplate(none).count() == 0
    assert op7_repair.write_shards(none).count() == 0
    assert op8_benchmark.leaks(none, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_queries_give_the_contract(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = {r.doc_id: r.kept_sha256 for r in QUERIES["op10_substrings"](spark, SF).collect()}
    assert out == {i: hashlib.sha256(t.encode()).hexdigest() for i, _, _, t in brute.without_repeats(docs.items())}
    limits = {r.doc_id: r.over_limit for r in QUERIES["op5_token_counts"](spark, SF).collect()}
    assert set(limits) == set(docs) and any(limits.values())


def test_audit_finds_lost_and_second_records_in_mid_file(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * (i % 7)) for i in range(130)] + [(None, None, None)], "page_id long, url string, html string")
    records = op3_warc.warc_records(pages)
    found = {(r.key, r.status) for r in op3_warc.audit(records, op3_warc.shifted(records)).collect()}
    assert found == {(11, "missing"), (108, "missing"), (23, "extra"), (120, "extra")}
