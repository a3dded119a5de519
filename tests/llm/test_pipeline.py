"""The pipeline against its stages done by hand on a small corpus."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    text = lambda n=90: " ".join(word() for _ in range(n))
    good = {i: text() for i in range(60)}
    test = " ".join(word() for _ in range(14))
    good[5] = good[5] + " " + test.upper()
    good[6] = good[6] + " ann@mail.com"
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in good.items()]
    rows += [(100, good[7], "en", "a", 1), (101, good[8] + " tail", "en", "b", 1), (102, "short", "en", "a", 5), (103, None, None, None, None), (104, text().upper(), "en", "a", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, test)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    cols = docs.columns
    ids = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        if k < 4:
            assert docs.columns == cols
        ids.append(sorted(r["doc_id"] for r in docs.select("doc_id").distinct().collect()))
    assert ids[0] == [*range(60), 100, 101] and ids[1] == ids[2] == ids[3] == list(range(60))
    out = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "s3")).collect()}
    assert out[5].split() == good[5].split()[:90] and out[6].endswith("[EMAIL]") and out[9] == good[9]
    last = docs.collect()
    assert set(ids[4]) <= set(range(60)) and max(r["copy"] for r in last) <= 2
    for s in "ab":
        got, want = sum(r["size"] for r in last if r["source"] == s), next(r["target"] for r in last if r["source"] == s)
        assert abs(got - want) < 95
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["copy"]) for r in whole.collect()) == sorted((r["doc_id"], r["copy"]) for r in last)


def test_empty_and_odd_documents(spark, tmp_path):
    """No documents give no rows; rows without an id, without a source or twice the same pass every stage."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    texts = [" ".join(word() for _ in range(80)) for _ in range(3)]
    rows = [(None, texts[0], None, None, None), (None, texts[0], None, None, None), (1, texts[1], "en", None, 1), (1, texts[1], "en", None, 1), (None, None, None, None, None), (2, texts[2], None, "s", None)]
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        ids = sorted(str(r["doc_id"]) for r in docs.collect())
        if k in (1, 2, 3):
            assert ids == ["1", "2", "None"]
    assert set(ids) <= {"1", "2", "None"}
    none = docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    for _, stage in corpus_pipeline.STAGES[:4]:
        none = stage(spark, none, str(tmp_path))
    assert none.count() == 0 and none.columns == [c.split()[0] for c in kind.split(", ")]
