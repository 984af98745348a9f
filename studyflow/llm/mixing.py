"""Mixing sources to target weights.

A source's size is the number of words of its documents.  All sizes together are shared out by weight; a source whose
share is over ``max_repeats`` times its size is held at that, and the excess goes to the others by weight, until none
is above.  A source's repetition rate is target over size; each of its documents is taken floor(rate) times, and once
more if a hash of its id and the seed, read as a number in [0, 1), is below the fraction.  So reruns agree.

Sizes are summed before any shuffle (partial aggregation), so a source with a third of all rows is no hot group.  The
shares are settled by rounds of aggregates over the table of sources: only one row of sums comes to the driver in a
round, and each round holds at least one more source at its limit.  The table of sources joins the documents by
broadcast while it has at most ``broadcast_sources`` rows; beyond that both sides are dealt out by source and a salt.

Defined results: a null text has size 0; the null source is a source, ordered last; sources of size 0 get target 0; a
null id hashes as an empty id; repeated rows are taken equally often; an empty table has an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, written

MAX_REPEATS, BROADCAST_SOURCES, SALTS, SEED = 3, 20_000, 64, 7
#: Hex digits of the hash that make the number in [0, 1).
_DIGITS = 13


def n_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame) -> DataFrame:
    """Adds ``weight``: 1, 2, 3, repeating, over the sources by code point, null last.  The table has a row per source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", ((rank - 1) % 3 + 1).cast("long"))


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): shares by weight, none above ``max_repeats`` times the size."""
    cap = F.col("source_size") * max_repeats
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    held, weight = 0, None
    share = None
    while True:
        over = F.lit(False) if share is None else cap <= F.col("weight") * F.lit(share)
        row = sizes.agg(F.sum(F.when(over, cap)).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if (row.held or 0, row.weight) == (held, weight) and share is not None or not row.weight:
            break
        held, weight = row.held or 0, row.weight
        share = float(total - held) / float(weight)
    if share is None:
        return sizes.withColumn("target", F.lit(0.0))
    return sizes.withColumn("target", F.when(cap <= F.col("weight") * F.lit(share), cap.cast("double")).otherwise(F.col("weight") * F.lit(share)))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the hash of id and seed."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def mix_rates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Callable[[DataFrame], DataFrame] = cyclic_weights,
    max_repeats: int = MAX_REPEATS, seed: int = SEED, broadcast_sources: int = BROADCAST_SOURCES,
) -> tuple[DataFrame, dict[str, str]]:
    """The documents with columns size, source_size, target and copies added; their names, which clash with none, by these words."""
    names = dict(zip(("size", "source_size", "target", "copies", "key", "salt"), fresh(docs, "size", "source_size", "target", "copies", "key", "salt")))
    sized = docs.withColumn(names["size"], n_words(F.col(text)))
    sizes = sized.groupBy(F.col(source).alias("source")).agg(F.sum(names["size"]).alias("source_size"))
    sources = written(source_targets(written(weights(sizes)), max_repeats))
    right = sources.select(F.col("source").alias(names["key"]), F.col("source_size").alias(names["source_size"]), F.col("target").alias(names["target"]))
    same = F.col(source).eqNullSafe(F.col(names["key"]))
    if sources.count() <= broadcast_sources:
        joined = sized.join(F.broadcast(right), same, "left")
    else:
        left = sized.withColumn(names["salt"], F.pmod(F.xxhash64(doc_id, text), F.lit(SALTS)))
        salt = F.col(names["salt"])
        right = right.withColumn(names["salt"] + "_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = left.join(right, same & (salt == F.col(names["salt"] + "_r")), "left").drop(names["salt"], names["salt"] + "_r")
    rate = F.coalesce(F.try_divide(F.col(names["target"]), F.col(names["source_size"])), F.lit(0.0))
    copies = F.floor(rate) + F.when(uniform(F.col(doc_id), seed) < rate - F.floor(rate), 1).otherwise(0)
    return joined.withColumn(names["copies"], copies.cast("long")).drop(names["key"]), names


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Callable[[DataFrame], DataFrame] = cyclic_weights, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """The mix itself: each document's row, with its own columns, as often as it is taken."""
    rated, names = mix_rates(docs, doc_id, text, source, weights, max_repeats, seed)
    again = F.explode(F.sequence(F.lit(1), F.col(names["copies"])))
    return rated.where(F.col(names["copies"]) > 0).select(*docs.columns, again.alias(names["salt"])).drop(names["salt"])


def op7_mixing_sources(spark, sf_dir: str) -> DataFrame:
    """Contract query: what the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rated, n = mix_rates(docs)
    size = F.col(n["size"])
    return rated.select("doc_id", size.alias("size"), F.col(n["source_size"]).alias("source_size"), F.col(n["target"]).alias("target"), (size * F.col(n["copies"])).alias("taken"))


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM s0),
r AS (
  SELECT 0 AS k, sum(source_size)::DOUBLE / sum(weight)::DOUBLE AS share FROM s
  UNION ALL
  SELECT r.k + 1, (SELECT (sum(s.source_size) - coalesce(sum(s.source_size * 3) FILTER (WHERE s.source_size * 3 <= s.weight * r.share), 0))::DOUBLE
    / (sum(s.weight) FILTER (WHERE NOT s.source_size * 3 <= s.weight * r.share))::DOUBLE FROM s) FROM r WHERE r.k < 200 AND r.share IS NOT NULL),
z AS (SELECT max_by(share, k) AS share FROM r WHERE share IS NOT NULL),
t AS (SELECT source, source_size, CASE WHEN source_size * 3 <= weight * share THEN (source_size * 3)::DOUBLE ELSE weight * share END AS target FROM s, z),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0.0::DOUBLE ELSE t.target / t.source_size END AS rate,
  ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':7'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM j
"""
