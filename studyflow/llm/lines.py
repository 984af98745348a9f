"""Line dedup: drop lines that many documents share, but keep them in the last document.

Plan: explode every text into lines; keep, for lines whose key is long enough, only (document, position, hash of the
key); count documents and take the largest document id by hash (partial aggregation first, so a line that a third of
all documents hold is no hot group); write the hashes of at least ``min_docs`` documents as a table of their own and
join it back to the line places, both sides dealt out for the join alone, so that Spark splits a hot hash; gather the
places to drop by document, and reassemble the text from the runs of lines between them, in time linear in its lines.

Keys are known by 128 bits (two 64-bit hashes with different seeds).  A row of the documents is known by its id and the
hash of its text, so repeated rows, which get the same result, share one list of places.

Defined results: null and empty texts are one empty line; rows of equal id count as one document; a null id counts as
one document, smaller than all others; an empty table has an empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

MIN_CHARS, MIN_DOCS = 20, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lowered."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), _UPPER, _LOWER)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_places(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2) of every line whose key has at least ``min_chars`` code points."""
    rows = docs.select("doc_id", "text_hash", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keys = rows.where(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    return keys.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.reverse("key")).alias("h2"))


def frequent_lines(places: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, keeper) of the keys found in at least ``min_docs`` documents; the keeper is the largest id."""
    by_doc = places.select("h1", "h2", "doc_id").distinct()
    return by_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).drop("n")


def _without(text: Column, lost: Column) -> Column:
    """The text without the lines at the sorted places ``lost``: the slices between them, so each line is copied once."""
    ends = F.concat(lost, F.array(F.size(_lines(text))))
    begins = F.concat(F.array(F.lit(0)), F.transform(lost, lambda p: p + 1))
    # The lines are bound by a lambda, so that the text is split once and not for every slice.
    runs = lambda lines: F.flatten(F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda r: F.slice(lines, r["a"] + 1, r["b"] - r["a"])))
    return F.get(F.transform(F.array(_lines(text)), lambda lines: F.array_join(runs(lines), "\n")), 0)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per document row: doc_id, n_lines, n_dropped, text (without the dropped lines)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    places = written(line_places(rows, min_chars))
    lost = (
        places.join(written(frequent_lines(places, min_docs)), ["h1", "h2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "text_hash")
        .agg(F.array_sort(F.collect_set("pos")).alias("lost"))
        .select(F.col("doc_id").alias("lost_id"), F.col("text_hash").alias("lost_hash"), "lost")
    )
    joined = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("text_hash") == F.col("lost_hash")), "left")
    kept = _without(F.col("text"), F.col("lost"))
    return joined.select(
        "doc_id",
        F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("lost").isNull(), F.col("text")).otherwise(kept).alias("text"),
    )


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: lines dropped from every document, and the hash of what stays."""
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.r, k.doc_id, k.line, k.pos, f.key IS NOT NULL AND k.doc_id <> f.keeper AS lost FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
