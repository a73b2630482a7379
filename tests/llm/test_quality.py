"""Quality rules: compiled columns against the model, held-out accuracy, and the pipeline against brute force."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemill.llm import bpe_codec, decontaminate, exact_dedup, quality, simhash_neardup

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality.score_documents(spark, docs, labels)
    rows = scored.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "quality").collect()
    assert scored.count() == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert np.mean([r["predicted"] for r in held if r["quality"] == 1]) > 0.97


def test_columns_equal_the_model(spark):
    rng = np.random.default_rng(3)
    x = rng.random((400, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.4) & (x[:, 3] <= 0.7)).astype(float)
    model = quality.fit_rows(x, y)
    assert 0 < len(model.rules) < 80 and len(model.text()) == len(model.rules)
    assert np.mean((model.scores(x) > 0.5) == y) > 0.95
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i int, s array<double>")
    got = [r[1] for r in df.select("i", model.column(F.col("s"))).orderBy("i").collect()]
    assert np.allclose(got, model.scores(x), atol=1e-12)


def test_awkward_rows_and_missing_labels(spark, awkward, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score_documents(spark, awkward, none).collect()
    assert len(got) == awkward.count() and {r["score"] for r in got} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert all(r["predicted"] == 1 for r in quality.score_documents(spark, awkward, one).collect())
    assert quality.score_documents(spark, nothing, one).count() == 0
    assert all(np.isfinite(quality.statistics(t)).all() for t in ("", " ", "a", "\n\n", "x" * 100_000, "é", "!!!"))


def test_stages_are_whole(spark):
    """Each stage's output is a pure function of what it kept: checked by brute force on the smallest tables."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = quality.fit(spark, docs, spark.read.parquet(f"{d}/labels.parquet"))
    keep = [i for i in rows if model.scores(np.array([quality.statistics(rows[i]["text"])]))[0] >= 0.3]
    last = {}
    for i in keep:
        t = rows[i]["text"].encode().lower()
        last[t] = max(last.get(t, i), i)
    keep = sorted(last.values())
    prints = [simhash_neardup.fingerprint(rows[i]["text"].encode().lower().split()) for i in keep]
    label = list(range(len(keep)))
    changed = True
    while changed:
        changed = False
        for a in range(len(keep)):
            for b in range(len(keep)):
                if bin(prints[a] ^ prints[b]).count("1") <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    keep = [i for k, i in enumerate(keep) if label[k] == k]
    bench = spark.read.parquet(f"{d}/benchmark.parquet")
    kept_docs = docs.where(F.col("doc_id").isin(keep))
    leaked = {r["doc_id"] for r in decontaminate.find_contamination(spark, kept_docs, bench).collect()}
    keep = [i for i in keep if i not in leaked]
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, d).collect()}
    assert got == {i: len(bpe_codec.encode_text(rows[i]["text"])) for i in keep}


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_keep_columns_and_survive_awkward_rows(spark, awkward, nothing, stage):
    got = stage(spark, awkward, SF)
    assert got.columns == (["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if stage is bpe_codec.encode_stage else awkward.columns)
    assert 0 < got.count() <= awkward.count()
    assert stage(spark, nothing, SF).count() == 0


def test_the_sample_is_bounded_where_documents_share_a_labelled_id(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"words of text {i}") for i in range(300)] + [(2, "some other text")], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(quality, "fit_rows", lambda x, y: seen.append(len(y)) or quality.RuleModel((), 0.0))
    quality.fit(spark, docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert seen == [2]


def test_the_stages_in_order():
    assert [f for _, f in corpus_pipeline.STAGES] == [quality.keep_good, exact_dedup.keep_distinct, simhash_neardup.keep_one, decontaminate.drop_contaminated, bpe_codec.encode_stage]
