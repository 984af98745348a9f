"""Exact dedup against brute force, with forced collisions, overflow pages and odd rows."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from studyflow.llm import exact
from tests.llm.test_operators import LONG, ODD, SF


def lowered(text):
    return (text or "").encode().lower()


def brute(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[lowered(text)].append(doc)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda x: (x is not None, x or 0), reverse=True)
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(text).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(d, t) for d, t, *_ in ODD] + [(100 + k, "Copied Text" if k % 2 else "copied text") for k in range(900)] + [(2000 + k, ("" if k % 3 else None)) for k in range(60)]
    rows += [(3000 + k, f"text {k % 40} " + "x" * (k % 7)) for k in range(300)] + [(4000, LONG), (4001, LONG.upper()), (4002, "É"), (4003, "é"), (4004, "İ"), (4005, "i̇")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(7)


@pytest.mark.parametrize("key_bits, bucket_bytes", [(64, exact.BUCKET_BYTES), (64, 1 << 12), (3, 1 << 12), (1, 1 << 30)])
def test_copies(mixed, monkeypatch, key_bits, bucket_bytes):
    """Also where many texts share a key, and where keys have several pages whose chains merge over several levels."""
    monkeypatch.setattr(exact, "LEAST_BUCKET", 1 << 11)
    got = found(exact.find_copies(mixed, bucket_bytes=bucket_bytes, key_bits=key_bits, fan=4))
    assert got == brute([(r.doc_id, r.text) for r in mixed.collect()])


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(exact.find_copies(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_drop_copies(spark):
    odd = spark.createDataFrame([(*r, 9) for r in ODD], "doc_id long, text string, sha string, one long, keep_id int")
    got = exact.drop_copies(odd)
    assert got.columns == odd.columns and got.schema == odd.schema
    assert sorted((r.doc_id or -1) for r in got.collect()) == sorted((d or -1) for d, _, _, kept, _ in brute([r[:2] for r in ODD]) if kept)
    assert exact.drop_copies(odd.where("false")).count() == 0 and exact.find_copies(odd.where("false")).count() == 0


def test_directory():
    """Buckets are ranges of prefixes that tile the keys; none is overfull unless it has all bits; the directory doubles no further than needed."""
    rng = np.random.default_rng(1)
    loads = rng.integers(0, 50, 1 << 10)
    loads[rng.integers(0, 1 << 10, 5)] += 5000
    for capacity in (1, 300, 4000, 10**9):
        depth, slots, held = exact.split_buckets(loads, capacity)
        assert len(slots) == 1 << depth and (np.diff(slots) >= 0).all() and held.sum() == loads.sum()
        by_slot = loads.reshape(1 << depth, -1).sum(axis=1)
        assert (np.bincount(slots, by_slot) == held).all()
        assert all(held[b] <= capacity or (slots == b).sum() == 1 and depth == 10 for b in range(len(held)))
    assert exact.split_buckets(loads, 10**9)[0] == 0
