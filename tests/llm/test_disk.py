"""What the similarity join leaves on disk."""

from __future__ import annotations

from pathlib import Path

import numpy as np

from studyflow.llm import jaccard
from studyflow.llm.shared import written


def size(folder: str) -> int:
    return sum(f.stat().st_size for f in Path(folder).rglob("*") if f.is_file())


def test_shuffles_end_with_the_table(spark):
    folder = spark.conf.get("spark.local.dir")
    files = lambda: len(list(Path(folder).rglob("shuffle_*.data")))
    before = files()
    assert written(spark.range(100_000).selectExpr("id % 1000 AS k").groupBy("k").count()).count() == 1000
    assert files() <= before + 1, "the count's own shuffle at most"


def test_copies_make_no_longer_lists(spark, monkeypatch):
    """A text that comes forty times has its postings once."""
    seen = []
    entries = jaccard._entries
    monkeypatch.setattr(jaccard, "_entries", lambda postings: seen.append(postings.count()) or entries(postings))
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join([*words[:59], "x"]), "other words stand here alone"]
    rows = spark.createDataFrame([(k, texts[k % 3]) for k in range(120)], "doc_id long, text string").repartition(8)
    got = jaccard.jaccard_components(rows).collect()
    assert seen == [3] and sorted((r.doc_id, r.component_id) for r in got) == [(k, 2 if k % 3 == 2 else 0) for k in range(120)]


def test_sketch_and_filter_grow_with_the_corpus(spark, monkeypatch):
    """Ten times the text has ten times the buckets, and a filter of many keys lets few others pass."""
    words = spark.range(4000).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 100) AS text")
    monkeypatch.setattr(jaccard, "_BUCKETS", 1 << 8)
    few, many = (jaccard._buckets(words.where(f"doc_id < {n}")) for n in (400, 4000))
    assert 8 <= many / few <= 16 and jaccard._buckets(words.where("false")) == 1 << 8
    first = written(jaccard._first_pass(words, 4, many * 256))
    levels = jaccard._sketch(first, many * 256)
    assert len(levels) == many * 256 and 3900 <= (levels > 0).sum() <= 4000
    monkeypatch.setattr(jaccard, "_FILTER_BITS", 1 << 20)
    keys = written(spark.range(400_000).selectExpr("xxhash64(id) AS t"))
    table = jaccard._filter(keys)
    known, other = (np.array([r.t for r in spark.range(a, a + 20_000).selectExpr("xxhash64(id) AS t").collect()]) for a in (0, 400_000))
    assert jaccard._maybe(table, known).all() and jaccard._maybe(table, other).mean() < 0.1


def test_rounds_of_askers_meet_all_sets(spark, monkeypatch):
    """Each set outside the largest component meets each set of the block that can link once, however many rounds that takes."""
    rows = [(k, 8, bytes(8), 1, k % 3 if k % 3 else 0, k % 3 != 0, 3, 5) for k in range(60)]
    members = spark.createDataFrame(rows, "node long, n int, bits binary, block long, root long, asked boolean, parts int, askers int")
    pairs = [sorted((r.a, r.b)) for k in range(0, 5, 2) for r in jaccard._outside_pairs(members, 85, k, k + 2).collect()]
    assert sorted(map(tuple, pairs)) == [(a, b) for a in range(60) for b in range(a + 1, 60) if a % 3 != b % 3]
    deal = jaccard._outside_pairs(members, 85, 0, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "askers" in deal and jaccard._outside_pairs(members, 85, 5, 7).count() == 0
