"""Sharding by sampled splitters, with DataFrame and SQL functions only.

Law ``bytes``: the shards' sizes are equal up to one document.  Records are ordered by (MD5 of the text, id), so equal
texts lie side by side and a group of copies, however large, is still cut by id.

1. A sample of keys is drawn with probability in proportion to size, by a hash, so reruns draw the same keys.
2. Its quantiles are the splitters that cut the key space into ranges; at most ``_FAN`` a level, a bounded list.
3. Ranges that turn out to hold more than ``range_bytes`` are cut again in the same way, as often as needed.
4. Each record's place in the order follows from the sums of the ranges before (a row a range) and a window within its
   range; shard = floor(bytes before it * shards / all bytes), so boundaries between shards are exact, wherever the
   sample put the ranges.  The slot counts up from 0 within the shard.

Ranges, not shards, set what a task handles: they are dealt out by hash over as many tasks as there are ranges, or,
where those are more than Spark's number of shuffle partitions, over enough for ``TASK_RANGES`` full ranges each.

Defined results: a null text has no bytes; null ids sort first; repeated rows are ties, placed side by side in any
order, which changes no set of rows of the result; an empty table has an empty result.  A single (text, id) pair
repeated beyond ``range_bytes`` cannot be cut and stays one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written

SHARDS, RANGE_BYTES, SAMPLES_PER_RANGE = 40, 128 << 20, 50
#: Ranges that a level of splitters makes at most of one; those that the first makes at least; levels at most.
_FAN, _LEAST, _LEVELS = 256, 64, 6
#: Full ranges that a task handles where there are many.
TASK_RANGES = 4


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def _chance(key: Column) -> Column:
    """A number in [0, 1) that depends on the key only."""
    return F.pmod(F.xxhash64(F.lit(99), key), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _number(splits: Column, key: Column) -> Column:
    """How many of the splitters are at or below the key."""
    return F.size(F.filter(splits, lambda s: s <= key)).cast("long")


def _splitters(keyed: DataFrame, full: DataFrame | None, total: int, range_bytes: int) -> DataFrame:
    """(of, splits): the quantiles of a size-weighted sample of the keys of each range in ``full`` (of, bytes); of all keys, as range 0, if that is None."""
    if full is None:
        drawn = keyed.select("*", F.lit(0).cast("long").alias("of"), F.lit(max(total, 1)).cast("long").alias("bytes"), F.lit(_wanted(total, _LEAST, range_bytes)).alias("want"))
    else:
        want = F.least(F.ceil(F.col("bytes") * 2 / range_bytes), F.lit(_FAN))
        drawn = keyed.join(full.withColumn("want", want), F.col("range") == F.col("of"))
    drawn = drawn.where(_chance(F.col("key")) < F.col("want") * SAMPLES_PER_RANGE * F.col("size") / F.col("bytes"))
    of = Window.partitionBy("of")
    ranked = drawn.select("of", "key", "want", F.row_number().over(of.orderBy("key")).alias("r"), F.count(F.lit(1)).over(of).alias("n"))
    quantile = F.floor(F.col("r") * F.col("want") / F.col("n")) > F.floor((F.col("r") - 1) * F.col("want") / F.col("n"))
    return ranked.where(quantile & (F.col("r") < F.col("n"))).groupBy("of").agg(F.array_sort(F.collect_set("key")).alias("splits"))


def _wanted(total: int, least: int, range_bytes: int) -> int:
    return min(max(-(-2 * total // range_bytes), least), _FAN)


def _ranges(keyed: DataFrame, top: Column, levels: list[DataFrame]) -> DataFrame:
    """``keyed`` (with a column ``key``) with the column ``range`` that the splitters of all levels give; ranges sort as keys do.

    The first level's splitters, at most ``_FAN``, are a literal; those of ranges that were cut again join by range.
    """
    out = keyed.withColumn("range", _number(top, F.col("key")))
    for splits in levels:
        number = F.coalesce(_number(F.col("splits"), F.col("key")), F.lit(0))
        out = out.join(splits, F.col("range") == F.col("of"), "left").withColumn("range", F.col("range") * (_FAN + 1) + number).drop("of", "splits")
    return out


def _placed(ranged: DataFrame, before: DataFrame, shards: int, total: int, tasks: int) -> DataFrame:
    """Adds shard and index (place among all records) to records with key, size and range."""
    within = Window.partitionBy("range").orderBy("key")
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = ranged.join(before, F.col("range") == F.col("of")).repartition(tasks, "range")
    start = F.col("bytes_before") + F.sum("size").over(running) - F.col("size")
    placed = joined.select("*", start.alias("start"), (F.col("rows_before") + F.row_number().over(running) - 1).alias("index"))
    shard = F.least(F.expr(f"(start * {shards}) div {max(total, 1)}"), F.lit(shards - 1)).cast("int")
    return placed.withColumn("shard", shard).drop("of", "bytes_before", "rows_before", "start")


def assign_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Each record, with its own columns in the struct ``record``, and its size, shard and slot."""
    key = F.struct(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("h"), F.col(doc_id).alias("id"))
    keyed = written(docs.select(key.alias("key"), record_size(F.col(text)).alias("size")))
    total = keyed.agg(F.sum("size")).first()[0] or 0
    kind = keyed.schema["key"].dataType
    drawn = _splitters(keyed, None, total, range_bytes).collect()
    top = F.array(*(F.struct(F.lit(k.h).alias("h"), F.lit(k.id).cast(kind["id"].dataType).alias("id")) for k in (drawn[0].splits if drawn else []))).cast(T.ArrayType(kind))
    levels: list[DataFrame] = []
    for _ in range(_LEVELS):
        sums = _ranges(keyed, top, levels).groupBy("range").agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
        full = written(sums.where((F.col("bytes") > range_bytes) & (F.col("low") < F.col("high"))).select(F.col("range").alias("of"), "bytes"))
        if not full.count():
            break
        levels.append(written(_splitters(_ranges(keyed, top, levels), full, total, range_bytes)))
    sums = _ranges(keyed, top, levels).groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range, no more than all bytes by range_bytes allow
    before = written(sums.select(F.col("range").alias("of"), *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "rows"))))
    tasks = max(min(before.count(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-total // (TASK_RANGES * range_bytes)), 1)
    first = {r.shard: r.first for r in _placed(_ranges(keyed, top, levels), before, shards, total, tasks).groupBy("shard").agg(F.min("index").alias("first")).collect()}
    record = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("record"), key.alias("key"), record_size(F.col(text)).alias("size"))
    starts = F.array(*(F.lit(first.get(s, 0)).cast("long") for s in range(shards)))
    placed = _placed(_ranges(record, top, levels), before, shards, total, tasks)
    return placed.select("record", "size", "shard", (F.col("index") - F.element_at(starts, F.col("shard") + 1)).alias("slot"))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """Contract query: law ``bytes`` over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    narrow = docs.select("doc_id", "text", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("crc"))
    found = assign_shards(narrow)
    return found.select(
        F.col("record.doc_id").alias("doc_id"), "size", F.col("record.crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
