"""The pipeline's stages on a small fixture, each against what it must keep."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from ticklake.llm.common import stored


def test_stages_by_hand(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "near-duplicates", "benchmark decontamination", "mixing", "token files"]
    rng = random.Random(0)
    words = docs.where("n_chars > 2000").first()["text"].split()
    near = list(words)
    near[10] = "changed"
    item = spark.read.parquet(f"{data}/benchmark.parquet").first()["text"]
    more = [(10_001, " ".join(words), "en", "src1", 1), (10_002, " ".join(near), "en", "src1", 1), (10_003, " ".join(words[:80]) + " " + item + " " + " ".join(rng.sample(words, 60)), "en", "src1", 1), (10_004, None, None, None, None)]
    docs = docs.union(spark.createDataFrame(more, docs.schema)).withColumn("n_chars", F.col("n_chars"))
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, data), f"test-{k}")
        kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if k < 4:
            assert docs.columns == columns
    assert len(set(kept["near-duplicates"]) & {10_001, 10_002}) == 0  # copies of a document with a smaller id
    assert 10_003 not in kept["benchmark decontamination"]
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    good = [d for d in kept["quality classifier"] if d in quality]
    assert all(quality[d] == 1 for d in good) and len(good) >= 0.98 * sum(quality.values())
    assert len(kept["token files"]) == len(kept["mixing"]) and docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = sorted(docs.collect(), key=lambda r: r["start"])
    assert all(b["start"] == a["start"] + a["n_tokens"] and b["doc_id"] >= a["doc_id"] for a, b in zip(rows, rows[1:], strict=False))


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0


def test_stages_on_odd_tables(spark, data, tmp_path):
    """Nulls, repeated ids and rows, empty and long texts, other columns: every stage passes them on as its text says; empty tables stay empty."""
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    texts = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").where("n_chars BETWEEN 800 AND 3000").orderBy("doc_id").limit(8).collect()]
    long = " ".join(texts) * 40
    rows = [(i, t, "en", None if i % 3 == 0 else "a", 1, 7, "x") for i, t in enumerate(texts)]
    rows += [(2, texts[2], "en", "a", 1, 7, "x"), (2, texts[5] + " more", "en", "a", 1, 7, "x"), (None, texts[0], "en", "a", 1, 7, "x"), (None, None, None, None, None, None, None), (90, None, "en", "a", 1, 7, "x"), (91, "", "en", "b", 1, 7, "x"), (92, long, "en", "a", 1, 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, row string")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stored(stage(spark, docs, str(tmp_path)), f"odd-{k}")
        assert (out.columns == docs.columns) == (k < 4)
        got = sorted(map(str, out.collect()))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if k == 1:  # one of each group; what has no id or no words stays
            assert sum("more" in r for r in got) <= 1 and sum("doc_id=None" in r for r in got) == 2 and any("doc_id=91" in r for r in got)
        if k == 2:
            assert sum("doc_id=None" in r for r in got) == 2
        if k == 4:
            assert len(got) == sum(r[0] is not None for r in rows)
