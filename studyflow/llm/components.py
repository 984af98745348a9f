"""Connected components of a graph in tables, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("h")).first()
    return row.n, row.h


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the root is the smallest node of its component.

    A large-star round hangs each node's larger neighbours on its smallest one; a small-star round hangs a node and its
    smaller neighbours on the smallest of them.  Each round is aggregated before it is shuffled, is written to the
    shared folder, and only a count and a checksum come to the driver.  Rounds grow with the logarithm of the longest
    path.  What a node's smallest neighbour is, is written before the edges meet it, so that both sides of the join are
    dealt out for it alone and Spark splits the edges of a hub.  Loops and repeated edges do no harm; no edges give an empty table.
    """
    now = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while state[0]:
        both = now.union(now.select("b", "a"))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")))
        large = both.join(least, F.col("a") == F.col("u")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low, F.col("a") == F.col("u"))
        after = written(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        )
        dropped(now)
        dropped(least)
        now, before = after, state
        state = _state(now)
        if state == before:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
