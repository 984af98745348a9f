"""Hard negatives against brute force: ties, repeated and odd rows, several blocks, large numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from studyflow.llm import negatives as N


def brute(rows, every=50, low=50, high=95):
    valid = []
    for i, vec, label in rows:
        if i is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        q = [math.floor(256 * x) for x in vec]
        if sum(x * x for x in q) < 2**62:
            valid.append((i, q, label))
    out = []
    for i, q, label in {(i, tuple(q), label) for i, q, label in valid if i % every == 0}:
        scored = sorted(((-sum(a * b for a, b in zip(q, p)), j, other) for j, p, other in valid if j != i))
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            fits = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(fits[:3])]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def rows_of(n, dim, seed, labels=4, spread=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    out = []
    for k in range(n):
        v = centres[k % labels] + spread * rng.normal(size=dim) * 3
        out.append((k, [float(x) for x in np.float32(v / np.linalg.norm(v))], int(rng.integers(0, labels)) if k % 5 == 0 else k % labels))
    return out


ODD = [
    (0, [0.5, 0.5, -0.1], 1), (50, [0.0, 0.0, 0.0], 1), (100, None, 1), (150, [0.1, None, 0.2], 2), (200, [float("nan"), 0.1, 0.2], 2), (250, [float("inf"), 0.0, 0.0], 1), (300, [0.4, 0.4], 1), (350, [], 2),
    (None, [0.5, 0.5, 0.5], 1), (400, [0.5, 0.5, 0.5], None), (1, [0.5, 0.5, 0.1], 1), (2, [0.5, 0.5, 0.1], 1), (3, [0.4, 0.3, 0.1], 2), (3, [0.4, 0.3, 0.1], 2), (4, [0.4, 0.3, 0.1], 2), (5, [-0.5, -0.5, 0.0], 1),
    (450, [3e7, 1.0, 2.0], 1), (6, [2e7, 3.0, 1.0], 1), (7, [1.5e7, 1.0, 1.0], 2), (8, [1e30, 0.0, 0.0], 2), (0, [0.5, 0.5, -0.1], 1), (-50, [0.2, 0.9, 0.1], 2), (500, [0.9], 3),
]
SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("block_bytes", [N.BLOCK_BYTES, 1500])
def test_mined(spark, block_bytes):
    rows = rows_of(900, 12, 3)
    rows += [(1000 + k, rows[7][1], 2) for k in range(200)] + [(3000 + 50 * k, rows[7][1], 3) for k in range(3)]  # a vector that many rows have
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(N.mine_negatives(df, block_bytes=block_bytes)) == brute(rows)


def test_odd_rows(spark):
    df = spark.createDataFrame([(*r, "x") for r in ODD], SCHEMA + ", score string")
    assert found(N.mine_negatives(df)) == brute(ODD)
    assert N.mine_negatives(df.where("false")).count() == 0
    assert N.mine_negatives(df.where("vec_id % 50 <> 0")).count() == 0


def test_bounds_and_early_end():
    """The bounds hold for every member, and where clusters are tight a walk takes a small part of all scores."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(3000, 16)) * rng.uniform(0.1, 3, size=(3000, 1))
    anchors = np.floor(256 * (vectors[:40] + 0.05 * rng.normal(size=(40, 16))))
    units, norm = N._units(np.floor(256 * vectors))
    for c in N.cluster_anchors(anchors):
        bounds, (members, length) = N.angular_bounds(units, norm, c), N._units(anchors[c.members])
        assert (np.floor(256 * vectors) @ members.T <= bounds[:, None] + 1e-6).all()
    near = np.concatenate([rng.normal(size=16) + 0.05 * rng.normal(size=(100, 16)) for _ in range(30)])
    rows = N.Rows(np.arange(3000), np.zeros(3000, np.int64), np.floor(256 * near))
    block = N.Rows(rows.id[::100], rows.label[::100], rows.vector[::100])
    wishes = [[N.Wish(5, True)] for _ in range(len(block))]
    taken = N.walk(rows, block, N.cluster_anchors(block.vector), wishes)
    assert taken < 0.5 * 3000 * len(block)
    for m, w in enumerate(wishes):
        score = rows.vector @ block.vector[m]
        order = [k for k in np.lexsort((rows.id, -score)) if rows.id[k] != block.id[m]][:5]
        assert w[0].best.id.tolist() == rows.id[order].tolist()
