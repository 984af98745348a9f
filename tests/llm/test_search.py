"""Ranked search against brute force, with ties, odd rows, several groups of items and small segments; the search itself ends early."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from studyflow.llm import search as S
from tests.llm.test_operators import ALNUM, ODD, SF


def brute(docs, items, k=10):
    held = [(i, Counter(ALNUM.findall((t or "").encode().lower()))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(x for _, _, x in held)
    df, terms = Counter(t for _, c, _ in held for t in c), defaultdict(set)
    for item, t in items:
        if item is not None:
            terms[item] |= set(ALNUM.findall((t or "").encode().lower()))
    out = []
    for item, own in terms.items():
        scored = []
        for i, c, length in held:
            m = 100 - 90 + (90 * length * n) // total
            if (s := sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if t in c)) > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("group_terms, segment_cells, round_, part_terms", [(S.GROUP_TERMS, S.SEGMENT_CELLS, S.ROUND, S.PART_TERMS), (60, 700, 1, 25)])
def test_search(spark, monkeypatch, group_terms, segment_cells, round_, part_terms):
    for name, value in (("SEGMENT_CELLS", segment_cells), ("ROUND", round_), ("PART_TERMS", part_terms)):
        monkeypatch.setattr(S, name, value)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randint(1, 40)))) for k in range(250)]
    docs += [(1000 + k, docs[3][1].upper() + ".") for k in range(60)] + [r[:2] for r in ODD]  # one score that many documents have
    items = [(1, docs[3][1]), (2, "w1 W1 w59, w7"), (3, None), (4, ""), (5, "nowhere"), (6, "w0"), (6, "w5 w6"), (None, "w1"), (7, "same text some words"), (8, docs[9][1] + " " + docs[10][1])]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, rank string").repartition(3)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id int, text string, score int")
    assert found(S.search(d, b, group_terms=group_terms)) == brute(docs, items)


def test_documents(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert found(S.search(docs, items)) == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert S.search(docs.where("false"), items).count() == 0 and S.search(docs, items.where("false")).count() == 0


def test_best_positions_end_early():
    """Where a few documents hold rare terms, the search meets a small part of the others, and finds the same."""
    rng = np.random.default_rng(2)
    n, terms = 4000, 6
    impact = np.zeros((terms, n), np.int64)
    for t in range(terms):
        own = rng.permutation(n)[: 3000 if t < 3 else 30]
        impact[t, own] = rng.integers(1, 900, len(own))
    impact[:, 17:40] = 950
    weight = np.array([3, 3, 3, 9000, 9000, 9000])
    t, d = np.nonzero(impact)
    top = S.Top(10)
    met = S.best_positions(S.Segment(t, d, impact[t, d], terms, n), np.arange(terms), weight, top, list(range(n)))
    score = weight @ impact
    want = np.lexsort((np.arange(n), -score))[:10]
    assert top.order == want.tolist() and top.score.tolist() == score[want].tolist()
    assert met < 0.1 * n


def test_huge_counts_stay_exact():
    assert S.impacts(np.array([3]), np.array([10**7]), 5 * 10**10, 10**13).tolist() == [(3 * 10**9) // (3000 + 8 * (10 + 90 * 10**7 * 5 * 10**10 // 10**13))]
