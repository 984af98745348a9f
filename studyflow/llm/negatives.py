"""Hard-negative mining over lists that clusters of anchors share.

Anchors are handled in blocks of bounded size against all rows.  The anchors of a block are clustered by direction.  In
each segment of rows, and for each cluster, the rows are sorted once by an upper bound of their inner product with any
unit vector of the cluster: |row| * cos(max(0, angle to the centre - largest angle of a member)).  Every member walks
this list from the top, and ends where its own length times the next bound is strictly below what it still needs.

Two walks over the rows, each with one result per task and anchor that is merged afterwards: first an anchor's
positives (the best rows of its label), then, in the score range of each positive, the negatives (the best rows of other
labels).  What the walks found in earlier segments of a task ends those in later ones sooner.

Scores are integer inner products of the vectors times 256, rounded down; they are exact (as doubles below 2^53, else as
64-bit integers).

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part, nor do vectors
longer than 2^31 in these units; shorter vectors count as padded with zeros; equal anchor rows count once; other rows of
an anchor's id are no partners of it; repeated rows are separate partners; an empty table has an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import offsets, written

POSITIVES, NEGATIVES, LOW, HIGH, EVERY, SCALE = 5, 3, 50, 95, 50, 256
#: Bytes of a block of anchors, which are sent to the tasks; rows of a segment; rows of a walk's first step.
BLOCK_BYTES, SEGMENT, STEP = 4 << 20, 4096, 64


@dataclass
class Rows:
    """Valid rows: ids, labels, and their vectors in units of 1 / 256."""

    id: np.ndarray
    label: np.ndarray
    vector: np.ndarray

    def __len__(self) -> int:
        return len(self.id)


def valid_rows(batch: pa.RecordBatch, dim: int) -> Rows:
    """Rows of a batch (id, label, vector) that take part."""
    ids, labels, lists = batch.column("id"), batch.column("label"), batch.column("vector")
    at = offsets(lists)
    values = lists.values.slice(at[0], at[-1] - at[0])
    numbers = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    size = np.diff(at)
    size[np.asarray(lists.is_null())] = 0
    row, place = np.repeat(np.arange(len(size)), np.diff(at)), np.arange(len(numbers)) - np.repeat(at[:-1] - at[0], np.diff(at))
    ok = np.asarray(ids.is_valid()) & np.asarray(labels.is_valid()) & np.asarray(lists.is_valid())
    ok[row[~np.isfinite(numbers)]] = False
    held = ok[row]
    out = np.zeros((len(size), dim))
    out[row[held], place[held]] = np.floor(SCALE * numbers[held])
    ok &= np.sqrt((out**2).sum(axis=1)) < 2.0**31
    return Rows(np.asarray(ids.fill_null(0))[ok], np.asarray(labels.fill_null(0))[ok], out[ok])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``a`` with those of ``b``."""
    most = np.sqrt((a**2).sum(axis=1).max(initial=0)) * np.sqrt((b**2).sum(axis=1).max(initial=0))
    return (a @ b.T).astype(np.int64) if most < 2.0**52 else a.astype(np.int64) @ b.astype(np.int64).T


@dataclass
class Cluster:
    members: np.ndarray  # places among the block's anchors
    centre: np.ndarray
    angle: float  # largest between the centre and a member


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((vectors**2).sum(axis=1))
    return vectors / np.where(norm > 0, norm, 1)[:, None], norm


def cluster_anchors(vectors: np.ndarray, rounds: int = 6) -> list[Cluster]:
    """Clusters by direction, about as many as the square root of the anchors: a few rounds of spherical k-means."""
    units, norm = _units(vectors)
    if not len(units):
        return []
    k = max(1, round(len(units) ** 0.5))
    centres = units[np.linspace(0, len(units) - 1, k).astype(int)]
    for _ in range(rounds):
        of = np.argmax(units @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, units)
        length = np.sqrt((sums**2).sum(axis=1))
        centres = np.where((length > 1e-9)[:, None], sums / np.where(length > 1e-9, length, 1)[:, None], centres)
    of = np.argmax(units @ centres.T, axis=1)
    found = []
    for c in range(k):
        members = np.flatnonzero(of == c)
        if len(members):
            # A zero vector has no direction: its scores are 0, as is its length times any bound.
            angles = np.arccos(np.clip(units[members] @ centres[c], -1, 1))[norm[members] > 0]
            found.append(Cluster(members, centres[c], float(angles.max(initial=0)) + 1e-7))
    return found


def angular_bounds(units: np.ndarray, norm: np.ndarray, cluster: Cluster) -> np.ndarray:
    """Upper bounds of the rows' inner products with unit vectors of the cluster, rounded up."""
    apart = np.arccos(np.clip(units @ cluster.centre, -1, 1)) - cluster.angle
    return norm * np.minimum(np.cos(np.maximum(apart - 1e-7, 0)) + 1e-9, 1)


class Best:
    """The first ``k`` of the rows offered so far: highest scores, ties by smallest id."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        if len(self.score) == self.k:
            near = score >= self.score[-1]
            score, ids = score[near], ids[near]
        if not len(score):
            return
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]

    @property
    def least(self) -> float:
        """What a row must reach to be among them."""
        return float(self.score[-1]) if len(self.score) == self.k else -np.inf


class Wish:
    """What an anchor looks for: rows of its label, or of others, within a range of scores, and those found so far."""

    def __init__(self, k: int, same: bool, low: float = -np.inf, high: float = np.inf) -> None:
        self.best, self.same, self.low, self.high = Best(k), same, low, high

    def offer(self, score: np.ndarray, ids: np.ndarray, same: np.ndarray) -> None:
        fits = (same if self.same else ~same) & (score >= self.low) & (score <= self.high)
        self.best.offer(score[fits], ids[fits])

    @property
    def needs(self) -> float:
        return max(self.best.least, self.low)


def walk(rows: Rows, anchors: Rows, clusters: list[Cluster], wishes: list[list[Wish]]) -> int:
    """Walk the shared lists of a segment; gives how many scores were taken."""
    units, norm = _units(rows.vector)
    lengths = np.sqrt((anchors.vector**2).sum(axis=1))
    taken = 0
    for cluster in clusters:
        bounds = angular_bounds(units, norm, cluster)
        order = np.argsort(-bounds, kind="stable")
        bounds = bounds[order]
        active, at, step = [m for m in cluster.members.tolist() if wishes[m]], 0, STEP
        while active and at < len(order):
            # Certified end: no row from here on can reach what is needed, not even as a tie.
            active = [m for m in active if any(lengths[m] * bounds[at] * (1 + 1e-9) + 1e-3 >= w.needs for w in wishes[m])]
            if not active:
                break
            own = order[at : at + step]
            scores = products(anchors.vector[active], rows.vector[own])
            taken += scores.size
            for m, score in zip(active, scores):
                other = rows.id[own] != anchors.id[m]
                ids, score, same = rows.id[own][other], score[other], rows.label[own][other] == anchors.label[m]
                for w in wishes[m]:
                    w.offer(score, ids, same)
            at, step = at + step, step * 2
    return taken


def _mined(rows: DataFrame, dim: int, anchors: Rows, clusters: list[Cluster], wanted: Callable[[], list[list[Wish]]]) -> DataFrame:
    """(anchor, wish, id, score): what each task found for each wish (its number) of each anchor (its place in the block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wishes = wanted()
        for batch in batches:
            for a in range(0, batch.num_rows, SEGMENT):
                walk(valid_rows(batch.slice(a, SEGMENT), dim), anchors, clusters, wishes)
        for m, own in enumerate(wishes):
            for k, w in enumerate(own):
                if n := len(w.best.id):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, m)), pa.array(np.full(n, k)), pa.array(w.best.id), pa.array(w.best.score)], names=["anchor", "wish", "id", "score"])

    return rows.mapInArrow(run, "anchor long, wish long, id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each wish, with their rank; the rows of a task are k at most."""
    order = Window.partitionBy("anchor", "wish").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(rows: DataFrame, dim: int, anchors: Rows, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    clusters, n = cluster_anchors(anchors.vector), len(anchors)
    found = _first(_mined(rows, dim, anchors, clusters, lambda: [[Wish(positives, True)] for _ in range(n)]), positives).collect()
    own: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for r in sorted(found, key=lambda r: r["rank"]):
        own[r.anchor].append((r.id, r.score))
    # Scores are integers: the range is from the next integer above low to the next below high percent.
    ranges = [[(-(-low * s // 100), high * s // 100) for _, s in ps] for ps in own]
    mined = _first(_mined(rows, dim, anchors, clusters, lambda: [[Wish(negatives, False, a, b) for a, b in ps] for ps in ranges]), negatives)
    flat = [(m, k, int(anchors.id[m]), p, s) for m, ps in enumerate(own) for k, (p, s) in enumerate(ps)]
    pairs = rows.sparkSession.createDataFrame(flat, "anchor long, wish long, anchor_id long, positive_id long, positive_score long")
    return mined.join(F.broadcast(pairs), ["anchor", "wish"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), (F.col("wish") + 1).cast("int").alias("positive_rank")
    )


def mine_negatives(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = EVERY,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """For each anchor (a row whose id ``every`` divides) and positive: the first negatives that score ``low`` to ``high`` percent of it.

    (anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank)
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))
    anchors = rows.where((F.col("id") % every == 0) & F.col("label").isNotNull() & F.col("vector").isNotNull()).distinct()
    sizes = rows.agg(F.max(F.size("vector")).alias("dim"), F.count_if(F.col("id") % every == 0).alias("n")).first()
    dim = max(sizes.dim or 0, 1)
    blocks = max(1, -(-sizes.n * dim * 8 // block_bytes))
    out = []
    for k in range(blocks):
        part = anchors.where(F.pmod(F.xxhash64("id", "label", "vector"), F.lit(blocks)) == k) if blocks > 1 else anchors
        table = part.orderBy("id").toArrow()
        batches = [valid_rows(b, dim) for b in table.combine_chunks().to_batches()]
        block = Rows(*(np.concatenate([getattr(b, c) for b in batches]) for c in ("id", "label", "vector"))) if batches else Rows(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dim)))
        found = _block(rows, dim, block, positives, negatives, low, high)
        out.append(written(found) if blocks > 1 else found)
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Contract query: every seventh row has its label moved on, which makes near rows of another label."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(rows.select("vec_id", "embedding", moved.alias("label")))


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS positive_rank FROM s WHERE same),
n AS (SELECT p.*, s.other_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_rank ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE positive_rank <= 5 AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score, positive_rank::INT AS positive_rank FROM n WHERE rank <= 3
"""
