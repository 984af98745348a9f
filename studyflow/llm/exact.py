"""Exact dedup with an extendible-hash index on shared files.

Texts are equal when they are identical after lower-casing A-Z.  A text's key is the 64-bit hash of its lowered bytes.

1. A pass over the texts gives the load (rows and bytes) of every key, aggregated before it is shuffled.
2. The directory starts with one bucket.  A bucket that holds more than its capacity splits by the next bit of the key;
   when it has used all bits of the directory, the directory doubles.  Buckets are prefixes of the key, so neighbouring
   ones are dealt to one owner task, a range of keys each.  A key that alone exceeds the capacity can't be split by any
   bit: it gets overflow pages, dealt over all owners, however many rows it has.
3. Owner tasks read their range in order of the key.  A key has a chain of different texts; each text is compared byte
   by byte with the chain, and joins an entry or becomes a new one.  Only one chain is held at a time.
4. The chains of a key's overflow pages are merged in the same way, ``FAN`` pages at a time, until one is left.
5. The index (key, page, chain entry of every row) lies in the shared folder; rows find their group by it.

The driver holds the directory and the list of large keys, both of bounded length (``DEPTH`` bits, ``MOST_LARGE`` keys).

Defined results: a null text is empty, so null and empty texts are one group; a null id is smaller than all others; of
rows that share text and id exactly one stays; an empty table has an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, steps, text_bytes, text_column, written

#: Load of a full bucket or page, and of an owner task's range at most; what a row counts besides its bytes.
BUCKET_BYTES, LEAST_BUCKET, OWNER_BYTES, ROW_BYTES = 16 << 20, 1 << 16, 128 << 20, 256
#: Bits of the directory and number of keys with overflow pages at most; pages whose chains one task merges.
DEPTH, MOST_LARGE, FAN = 20, 1 << 16, 512


@dataclass
class Directory:
    """``slots[prefix]`` is the bucket of the keys that begin with these ``depth`` bits; ``owners[bucket]`` its task."""

    depth: int
    slots: np.ndarray
    owners: np.ndarray
    large: np.ndarray  # sorted keys that have overflow pages
    pages: np.ndarray
    tasks: int

    def bucket(self, key: np.ndarray) -> np.ndarray:
        return self.slots[(key >> np.uint64(64 - self.depth)).astype(np.int64)] if self.depth else np.zeros(len(key), np.int64)

    def n_pages(self, key: np.ndarray) -> np.ndarray:
        if not len(self.large):
            return np.ones(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.large, key), len(self.large) - 1)
        return np.where(self.large[at] == key, self.pages[at], 1)

    def owner(self, key: np.ndarray, page: np.ndarray) -> np.ndarray:
        """Ranges of buckets in order; the pages of large keys one by one over all tasks."""
        paged = self.n_pages(key) > 1
        return np.where(paged, ((key >> np.uint64(20)).astype(np.int64) + page) % self.tasks, self.owners[self.bucket(key)])


def split_buckets(loads: np.ndarray, capacity: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Directory depth, bucket of each slot, and load of each bucket, for the loads of 2^n key prefixes.

    The directory doubles, and each overfull bucket, which has one slot, splits into the two that come of it; buckets
    that are not full share their slots from then on.  Buckets are numbered in the order of their prefixes.
    """
    most = len(loads).bit_length() - 1
    depth, slots, held = 0, np.zeros(1, np.int64), loads.sum(keepdims=True)
    while (full := held > capacity).any() and depth < most:
        depth, slots = depth + 1, np.repeat(slots, 2)
        upper = (np.arange(len(slots)) % 2 == 1) & full[slots]
        slots = np.where(upper, (len(held) + np.cumsum(full) - 1)[slots], slots)
        held = np.bincount(slots, loads.reshape(1 << depth, -1).sum(axis=1), len(held) + full.sum()).astype(np.int64)
    order = np.full(len(held), -1, np.int64)
    found, first = np.unique(slots, return_index=True)
    order[found[np.argsort(first)]] = np.arange(len(found))
    return depth, order[slots], held[np.argsort(order)]


def text_keys(column: pa.Array, key_bits: int) -> tuple[np.ndarray, list[bytes]]:
    """Keys and lowered texts of a string column; ``bytes.lower`` changes A-Z only."""
    data, at = text_bytes(column)
    raw, ends = data.tobytes(), at.tolist()
    lowered = [raw[a:b].lower() for a, b in zip(ends, ends[1:])]
    keys = np.fromiter((xxhash.xxh64_intdigest(x) for x in lowered), np.uint64, len(lowered))
    return keys & np.uint64(((1 << key_bits) - 1) << (64 - key_bits)), lowered


def key_loads(docs: DataFrame, text: str, key_bits: int = 64) -> DataFrame:
    """(key, load): what the rows of each key weigh, as one row a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = text_column(batch, text)
            for a, b in steps(column):
                keys, lowered = text_keys(column.slice(a, b - a), key_bits)
                found, place = np.unique(keys, return_inverse=True)
                load = np.bincount(place, [len(x) + ROW_BYTES for x in lowered], len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(load)], names=["key", "load"])

    return docs.select(text).mapInArrow(run, "key long, load long").groupBy("key").agg(F.sum("load").alias("load"))


def plan_directory(loads: DataFrame, bucket_bytes: int = BUCKET_BYTES, tasks: int | None = None) -> Directory:
    """The directory for ``loads`` (key, load); only sums by prefix and the largest keys come to the driver."""
    total = loads.agg(F.sum("load")).first()[0] or 0
    tasks = max(tasks or int(loads.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // OWNER_BYTES))
    capacity = min(max(total // (4 * tasks), LEAST_BUCKET), bucket_bytes)
    limit = max(capacity, -(-total // MOST_LARGE))
    large = sorted((r.key % (1 << 64), -(-r.load // capacity)) for r in loads.where(F.col("load") > limit).collect())
    depth = min(DEPTH, max(total // capacity, 1).bit_length() + 3)
    prefix = F.shiftrightunsigned("key", 64 - depth)
    sums = np.zeros(1 << depth, np.int64)
    for r in loads.where(F.col("load") <= limit).groupBy(prefix.alias("prefix")).agg(F.sum("load").alias("load")).collect():
        sums[r.prefix] = r.load
    used, slots, held = split_buckets(sums, capacity)
    before = np.cumsum(held) - held
    owners = np.minimum(before * tasks // max(int(held.sum()), 1), tasks - 1)
    return Directory(used, slots, owners, np.array([k for k, _ in large], np.uint64), np.array([p for _, p in large], np.int64), tasks)


def _deal(rows: DataFrame, directory: Directory, key_bits: int) -> DataFrame:
    """(owner, key, page, id, text) of every row (id, text); the text is lowered."""
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            column = text_column(batch, "text")
            for a, b in steps(column):
                keys, lowered = text_keys(column.slice(a, b - a), key_bits)
                place = seen + np.arange(b - a)
                page = (place * 0x9E3779B1 >> 8) % directory.n_pages(keys)
                seen += b - a
                owner = directory.owner(keys, page)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owner, pa.int32()), pa.array(keys.view(np.int64)), pa.array(page, pa.int64()), batch.column(0).slice(a, b - a), pa.array(lowered, pa.binary())],
                    names=["owner", "key", "page", "id", "text"],
                )

    fields = T.StructType([T.StructField("owner", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("page", T.LongType()), T.StructField("id", kind), T.StructField("text", T.BinaryType())])
    return rows.mapInArrow(run, fields)


def _chains(items: DataFrame, directory: Directory, fan: int | None) -> DataFrame:
    """Follow the chain of each run of equal (key, page) in sorted items, and give a row for each item and each entry.

    Items are rows (fan is None) or the entries of pages, of which ``fan`` merge.  A row of an item has ``to`` (its
    entry), that of an entry has ``n`` (its rows), ``top`` (largest id), where that was seen, and its text as long as
    other pages of the key remain.
    """
    id_kind = items.schema["id" if fan is None else "top"].dataType
    fields = T.StructType([
        T.StructField("key", T.LongType()), T.StructField("page", T.LongType()), T.StructField("entry", T.LongType()), T.StructField("row", T.LongType()), T.StructField("id", id_kind), T.StructField("sha", T.StringType()), T.StructField("to_page", T.LongType()), T.StructField("to", T.LongType()),
        T.StructField("n", T.LongType()), T.StructField("top", id_kind), T.StructField("top_page", T.LongType()), T.StructField("top_row", T.LongType()), T.StructField("text", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(fields)
        chain: list[list] = []  # text, sha, n, top, top_page, top_row
        now, row, out = None, 0, []

        def closed() -> Iterator[tuple]:
            key, page = now
            more = directory.n_pages(np.array([key % (1 << 64)], np.uint64))[0] > 1
            for k, (text, sha, n, top, top_page, top_row) in enumerate(chain):
                yield key, page, k, None, None, None, None, None, n, top, top_page, top_row, text if more else None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in batch.schema.names if n not in ("owner", "text")}
            texts = batch.column("text")
            for i in range(batch.num_rows):
                key, page = columns["key"][i], columns["page"][i]
                run_of = (key, page if fan is None else page // fan)
                if run_of != now:
                    if now is not None:
                        out.extend(closed())
                    now, chain, row = run_of, [], 0
                text = texts[i].as_py()
                n, top, top_page, top_row = (1, columns["id"][i], page, row) if fan is None else tuple(columns[c][i] for c in ("n", "top", "top_page", "top_row"))
                k = next((k for k, e in enumerate(chain) if e[0] == text), len(chain))
                if k == len(chain):
                    chain.append([text, hashlib.sha256(text).hexdigest(), 0, top, top_page, top_row])
                e = chain[k]
                e[2] += n
                if top is not None and (e[3] is None or top > e[3]):
                    e[3:] = [top, top_page, top_row]
                if fan is None:
                    out.append((key, page, k, row, columns["id"][i], e[1], None, k, None, None, None, None, None))
                else:
                    out.append((key, page, columns["entry"][i], None, None, None, run_of[1], k, None, None, None, None, None))
                row += 1
                if len(out) >= 4096:
                    yield batch_of(out)
                    out = []
        if now is not None:
            out.extend(closed())
        if out:
            yield batch_of(out)

    return items.mapInArrow(run, fields)


def _groups(index: DataFrame, directory: Directory, fan: int) -> DataFrame:
    """(key, page, entry, n, top, top_page, top_row): the group that each chain entry of the index belongs to."""
    values = ["n", "top", "top_page", "top_row"]
    entries = index.where(F.col("n").isNotNull()).select("key", "page", "entry", *values, "text")
    alone = entries.where(F.col("text").isNull()).drop("text")
    levels, most = 0, int(directory.pages.max()) if len(directory.pages) else 1
    while fan**levels < most:
        levels += 1
    paged = entries.where(F.col("text").isNotNull())
    steps_up = []
    for _ in range(levels):
        dealt = paged.withColumn("up", F.floor(F.col("page") / fan)).repartition(directory.tasks, "key", "up").sortWithinPartitions("key", "page", "entry").drop("up")
        found = written(_chains(dealt, directory, fan))
        steps_up.append(found.where(F.col("to").isNotNull()).select("key", "page", "entry", "to_page", "to"))
        paged = found.where(F.col("n").isNotNull()).select("key", "page", "entry", *values, "text")
    if not levels:
        return alone
    merged = paged.drop("text")
    for step in reversed(steps_up):
        upper = merged.select("key", F.col("page").alias("to_page"), F.col("entry").alias("to"), *values)
        merged = step.join(upper, ["key", "to_page", "to"]).select("key", "page", "entry", *values)
    return alone.union(merged)


def find_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES, key_bits: int = 64, tasks: int | None = None, fan: int = FAN
) -> DataFrame:
    """Per row: doc_id, keep_id (of the row that stays), group_size, kept, text_sha256 (of the lowered text)."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    directory = plan_directory(written(key_loads(rows, "text", key_bits)), bucket_bytes, tasks)
    dealt = _deal(rows, directory, key_bits).repartitionById(directory.tasks, F.col("owner")).sortWithinPartitions("key", "page")
    index = written(_chains(dealt, directory, None))
    places = index.where(F.col("row").isNotNull()).select("key", "page", "entry", "row", "id", "sha")
    found = places.join(_groups(index, directory, fan), ["key", "page", "entry"])
    kept = (F.col("page") == F.col("top_page")) & (F.col("row") == F.col("top_row"))
    return found.select(F.col("id").alias("doc_id"), F.col("top").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows that stay, with all their columns; of rows that share text and id, the one of the smallest hash."""
    kept = find_copies(docs, doc_id, text, **options).where("kept").select(F.col("doc_id").alias("kept_id"), "text_sha256")
    sha, one = fresh(docs, "sha", "one")
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.withColumn(sha, F.sha2(lowered, 256))
    found = rows.join(kept, F.col(doc_id).eqNullSafe(F.col("kept_id")) & (F.col(sha) == F.col("text_sha256")), "left_semi")
    record = F.struct(*(F.col(c) for c in docs.columns))
    return found.groupBy(doc_id, sha).agg(F.min_by(record, F.xxhash64(*(F.col(c) for c in docs.columns))).alias(one)).select(f"{one}.*")


def op13_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document with the copy that stays."""
    return find_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""
