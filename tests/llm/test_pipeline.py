import corpus_pipeline as p
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def test_each_stage_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: int(r.quality == 1 and r.toxic == 0) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [brute.shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for n, (name, stage) in enumerate(p.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        out = spark.read.parquet(str(tmp_path / str(n)))
        after = {r.doc_id: r for r in out.collect()}
        if name != "tokenisation":
            assert out.columns == docs.columns
            assert all(r.n_chars == len(r.text) for r in after.values())
        if name == "quality classifier":
            lost = [i for i in before if i not in after and labels.get(i) == 1]
            assert len(lost) <= 0.02 * sum(labels.values()) and len(after) < len(before)
        elif name == "line dedup":
            assert set(after) == set(before)
            assert any(len(r.text) < len(before[i]) for i, r in after.items())
        elif name == "near dedup":
            assert set(after) == {i for i, x in brute.near(before.items()).items() if x[2]}
        elif name == "decontamination":
            sets = {i: brute.shingles(t) for i, t in before.items()}
            leaky = {i for i, s in sets.items() if any(100 * len(s & x) >= 75 * len(x) for x in items if x)}
            assert set(after) == set(before) - leaky and leaky
        else:
            assert set(after) == set(before) and all(r.round_trip for r in after.values())
        docs = out


def test_run(spark):
    assert p.run(spark, "/root/testdata/sf0.001").count() > 50
