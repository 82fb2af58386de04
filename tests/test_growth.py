"""Queries on tables of more rows than the given ones."""

import datetime
import decimal
import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from govlake.functions import tokens
from govlake.operators import redact
from govlake.operators.gaps import remediation_order
from govlake.sources.files import scan_files, write_files
from tests.test_scale import plain_levels


def test_the_digest_of_many_documents_is_whole(spark, tmp_path):
    n = 70_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("a\nb"), F.col("id").cast("string")).alias("text"), F.lit("de").alias("lang"), F.lit("src0").alias("source"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = entry.queries()["r9_release_verbatim"](spark, str(tmp_path)).collect()
    digest = sum(int(hashlib.sha256(f"a\nb{i}".encode()).hexdigest()[:12], 16) for i in range(n))
    assert digest > 1 << 63
    assert [(r.level, r.n, r.lines, int(r.digest)) for r in found] == [(2, n, 2 * n, digest)]


def shuffled(spark, run) -> int:
    """Bytes that the stages of run write for shuffles."""
    context = spark.sparkContext
    store, none = context._jsc.sc().statusStore(), context._gateway.new_array(context._jvm.double, 0)
    stages = lambda: store.stageList(None, False, False, none, None)
    last = max([stages().apply(i).stageId() for i in range(stages().size())], default=-1)
    run()
    found = stages()
    return sum(found.apply(i).shuffleWriteBytes() for i in range(found.size()) if found.apply(i).stageId() > last)


def texts_of_few_words(spark):
    r = random.Random(3)
    words = ["".join(r.choices("abcdefgh", k=8)) for _ in range(400)]
    return spark.createDataFrame([(f"p{i}", " ".join(r.choices(words, k=250)), r.choice(words)) for i in range(2000)], "path string, content string, word string"), words


def test_a_text_is_shuffled_once_and_a_word_once_for_many_texts(spark):
    texts, words = texts_of_few_words(spark)
    names = spark.createDataFrame([(w, f"t_{i}") for i, w in enumerate(sorted(set(words)))], "real string, pseudonym string")
    table, size = {r.real: r.pseudonym for r in names.collect()}, texts.select(F.sum(F.octet_length("content"))).first()[0]
    found = []
    assert shuffled(spark, lambda: found.extend(redact.tokenise_terms(texts, names).collect())) < size
    want = {r.path: (" ".join(table[w] for w in r.content.split()), 250) for r in texts.collect()}
    assert {r.path: (r.released, r.n) for r in found} == want


def test_nested_rows_are_shuffled_once(spark):
    texts, words = texts_of_few_words(spark)
    names = spark.createDataFrame([(w, f"t_{i}") for i, w in enumerate(sorted(set(words)))], "real string, pseudonym string")
    rows = texts.select(F.col("path").alias("id"), F.struct(F.split("content", " ").alias("l")).alias("s"), F.create_map("word", "content").alias("m"))
    size, found = 2 * texts.select(F.sum(F.octet_length("content"))).first()[0], []
    assert shuffled(spark, lambda: found.extend(redact.rewrite_nested(rows, names).collect())) < size
    table = {r.real: r.pseudonym for r in names.collect()}
    told = lambda text: " ".join(table[w] for w in text.split())
    want = {r.path: (told(r.content), {told(r.word): told(r.content)}) for r in texts.collect()}
    assert {r.id: (" ".join(r.s.l), r.m) for r in found} == want


def test_values_of_all_types_come_back_from_blocks_of_a_few_rows(spark):
    r, stamp = random.Random(4), datetime.datetime(2024, 3, 31, 2, 30, 0, 123456)
    text = lambda: r.choice([None, "", "kofi", "kofi ama", "éama é", "a-kofi_", "x$kofi"])
    def row(i):
        keyed = {(text(), j): [text(), text()][: j % 3] for j in range(i % 4)}
        return (i, keyed or None, [{text() or "k": text(), "ama": "1"}, None, {}][: i % 4], decimal.Decimal("1.50"), stamp, b"kofi", r.choice([None, (None, [None, text()])]))

    rows = [row(i) for i in range(60)]
    schema = "id int, keyed map<struct<a:string,b:int>,array<string>>, l array<map<string,string>>, d decimal(9,2), ts timestamp, b binary, s struct<x:date,t:array<string>>"
    df = spark.createDataFrame(rows, schema).repartition(7)
    names = spark.createDataFrame([("kofi", "p_1"), ("ama", "p_2")], "real string, pseudonym string")
    put = lambda t: t and re.sub("[A-Za-z0-9_$]+", lambda m: {"kofi": "p_1", "ama": "p_2"}.get(m.group(), m.group()), t)
    out = redact.rewrite_nested(df, names)
    assert out.schema.simpleString() == df.schema.simpleString()
    for got, was in zip(out.orderBy("id").collect(), df.orderBy("id").collect(), strict=True):
        assert (got.id, got.d, got.ts, bytes(got.b)) == (was.id, was.d, was.ts, b"kofi")
        assert got.keyed == (was.keyed if was.keyed is None else {type(k)(put(k.a), k.b): [put(x) for x in v] for k, v in was.keyed.items()})
        assert got.l == [m if m is None else {put(k): put(v) for k, v in m.items()} for m in was.l]
        assert got.s == was.s or got.s.t == [put(x) for x in was.s.t]
    assert redact.rehydrate_nested(out, names).orderBy("id").collect() == df.orderBy("id").collect()


def test_blocks_hold_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_BYTES", 600)
    batches = [pa.RecordBatch.from_pydict({"t": [f"{i} " * (i % 90) for i in range(a, a + 40)]}) for a in (0, 40, 80)]
    blocks = [tokens._unpacked(b["rows"][0]) for b in tokens._packed(iter(batches))]
    assert len(blocks) > 10 and [x for b in blocks for x in b["t"].to_pylist()] == [x for b in batches for x in b["t"].to_pylist()]


@pytest.mark.parametrize("seed,few", [(0, 0), (1, 0), (2, 0), (1, 12), (2, 40), (2, 500_000)])
def test_levels_are_the_same_in_rounds_and_at_once(spark, seed, few):
    r = random.Random(seed + 10)
    ids = {i * 10**15 + 7 for i in range(60)}
    pairs = [(r.randrange(62), r.randrange(62)) for _ in range((40, 75, 110)[seed])]
    edges = [(a * 10**15 + 7, b * 10**15 + 7) for a, b in pairs if a > b or r.random() < 0.08]
    got = remediation_order(spark.createDataFrame([(i,) for i in ids] * 2, "id long"), spark.createDataFrame(edges, "id long, needs long"), few)
    assert {x.id: x.level for x in got.collect()} == plain_levels(ids, edges)


def test_a_small_graph_takes_few_jobs(spark):
    ids = spark.range(1, 2001)
    edges = ids.selectExpr("id", "id div 2 as needs").unionByName(spark.createDataFrame([(11, 13), (13, 17), (17, 11)], "id long, needs long"))
    spark.sparkContext.setJobGroup("levels", "levels")
    levels = {x.id: x.level for x in remediation_order(ids, edges).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("levels")
    spark.sparkContext.setJobGroup(None, None)
    assert levels[1] == 0 and levels[1024] == 10 and levels[34] is None and len(jobs) < 30


def test_names_of_an_id_may_be_strings(spark):
    got = remediation_order(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string"), spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "d")], "id string, needs string"))
    assert {x.id: x.level for x in got.collect()} == {"a": 0, "b": 1, "c": 2, "d": 0}


def test_files_that_go_by_place_or_size_make_no_tasks(spark, tmp_path):
    root = tmp_path / "vendor" / "a b" / "té%20s+t"
    kept = ["src/a b.ts", "src/é%.md", "q/#h?.txt", "q/a+b%41.txt", "vendor x/k.txt"]
    for name, size in [*[(n, 5) for n in kept], *[(f"node_modules/x/{i}.ts", 5) for i in range(300)], *[(f"q/{i}.txt", 5000) for i in range(100)], *[(f"q/{i}.png", 5) for i in range(100)]]:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x" * size)
    found = scan_files(spark, str(root), max_kb=4)
    assert {r.path for r in found.collect()} == set(kept) and found.rdd.getNumPartitions() <= len(kept)
    assert {r.path for r in scan_files(spark, str(root), include=["**/a b.*", "**/*#*"]).collect()} == {"src/a b.ts", "q/#h?.txt"}
    assert {r.path for r in scan_files(spark, str(root), exclude=["**/a b.*", "q/*"]).collect()} == {"src/é%.md", "vendor x/k.txt"}


def test_rows_are_written_as_files_by_a_single_job(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b/c", "y\n"), ("b/c", ""), ("b/c", None)] * 40, "folder string, value string").repartition(3)
    spark.sparkContext.setJobGroup("files", "files")
    write_files(rows, f"file://{tmp_path}/t")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("files")
    spark.sparkContext.setJobGroup(None, None)
    held = sorted((p.parent.relative_to(tmp_path).as_posix(), p.read_text()) for p in tmp_path.rglob("*") if p.is_file())
    assert held == sorted((f"t/{r.folder}", (r.value or "") + "\n") for r in rows.collect()) and len(jobs) <= 3
    write_files(rows.where("value = 'x'"), f"{tmp_path}/u")
    assert [p.read_text() for p in (tmp_path / "u").rglob("*.txt")] == ["x\n"] * 80
