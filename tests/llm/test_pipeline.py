"""The pipeline on the small fixture: each stage keeps the columns and does what its operator says."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from studyflow.llm import quality
from studyflow.llm.shared import written
from tests.llm.test_operators import brute_components, brute_contamination, texts

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("size", F.lit("clash"))
    good, one, clean, mixed, sharded = (None,) * 5
    good = written(corpus_pipeline.quality_rules(spark, docs, SF))
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in quality.quality_report(docs).where("kept").collect())
    one = written(corpus_pipeline.ngram_jaccard(spark, good, SF))
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, _, c in brute_components(texts(good), corpus_pipeline.NEAR_SHINGLE, corpus_pipeline.NEAR_PERCENT)})
    clean = written(corpus_pipeline.decontamination(spark, one, SF))
    bench = texts(spark.read.parquet(f"{SF}/benchmark.parquet").withColumnRenamed("item_id", "doc_id"))
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _, hit, _ in brute_contamination(texts(one), bench) if not hit)
    mixed = written(corpus_pipeline.mix(spark, clean, SF))
    assert all(x.columns == docs.columns for x in (good, one, clean, mixed))
    assert max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 3
    sharded = corpus_pipeline.shard(spark, mixed, SF)
    assert sharded.count() == mixed.count() and set(docs.columns) < set(sharded.columns)


def test_run_agrees(spark):
    a, b = (sorted(map(repr, corpus_pipeline.run(spark, SF).select("doc_id", "shard").collect())) for _ in range(2))
    assert a == b and a


def test_near_duplicates_take_five_words_and_80_percent(spark):
    rng = random.Random(2)
    rows = []
    for k in range(12):
        base = [f"w{k}_{j}" for j in range(200)]
        rows.append((10 * k, " ".join(base)))
        rows.append((10 * k + 1, " ".join(base + [f"a{k}_{j}" for j in range(44)])))  # appended: 0.82
        at = rng.randrange(20, 160)
        rows.append((10 * k + 2, " ".join(base[:at] + [f"b{k}_{j}" for j in range(17)] + base[at + 17 :])))  # a block of 8.5 % replaced: 0.81
        rows.append((10 * k + 3, " ".join(base + [f"c{k}_{j}" for j in range(60)])))  # 0.77: another document
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.ngram_jaccard(spark, frame, SF).collect())
    assert got == sorted({c for _, _, c in brute_components(rows, 5, 80)})
    assert got != sorted({c for _, _, c in brute_components(rows)})
