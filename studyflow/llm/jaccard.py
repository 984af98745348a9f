"""N-gram Jaccard join with set-relation skipping: groups of texts that links of similar shingle sets connect.

Texts become sets of word shingles; texts with equal sets are one *node* from there on.  Two nodes link when
``100 * |x & y| >= percent * |x | y|``.  The result is exact: no cap, and every link between different sets counts.

Index.  Shingles are ordered from rare to frequent, by a counting sketch over the whole corpus, as wide as its text is long
(an order needs no exact counts, only to be the same everywhere).  A set of n shingles is probed with its first
n - ceil(t*n) + 1 shingles and indexed with its first n - ceil(2t/(1+t)*n) + 1: of a linked pair, the smaller set's
index part meets the larger one's probe part.

Index-level skipping.  Lists are held in two blocks by position, index part and probe-only part.  A list with one set,
or with no entry in its index part, is skipped whole (an aggregate finds the others, a filter sized by their number passes
their entries on); an entry is skipped where no set of fitting size is in the block that it must meet.

Short lists (up to ``short`` entries) give their pairs, at most ``short`` for an entry.  Longer lists come from groups
of similar texts; there each set hangs on the list's smallest one, which is linear in the list, and the components of
these stars (*blocks*) hold every pair that the lists have.  Blocks are cut into parts by hash; each part is answered
together with one part of pivots, and what that connects needs no answer among itself.  Only the sets outside a
block's largest component then meet its other sets.

Before sets are compared, bit maps of about one bit a shingle rule out most pairs that cannot link (two sets differ in
at least as many shingles as their maps in bits).

Answer-level skipping.  Within a task, a set's overlaps with all others are derived from those of a highly similar set
already answered: only lists of the shingles in which the two differ are read.

Defined results: words by ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, of whole texts; a text of fewer words than a
shingle has its whole sequence as its one shingle; null and empty texts have an empty set and link with nothing;
repeated rows and equal texts are in one component; null ids take part, but a component's id is its smallest non-null one;
an empty table has an empty result.

Shingles are known by 64-bit hashes.  Sets are known by 128 bits: a node is a 64-bit hash of a set, and where two sets
with different second hashes share one, which an aggregate finds, the second hash goes into their nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import dropped, fresh, lists, map_text, steps, text_bytes, text_column, written
from .tokens import SPACED_LOWER, mix, shingle_sets, split_words

SHINGLE, PERCENT = 4, 85
#: Least and most buckets of the counting sketch, bytes of text for each, and buckets of a chunk, as which it is sent.
_BUCKETS, _MOST_BUCKETS, _BUCKET_BYTES, _CHUNK = 1 << 20, 1 << 26, 1 << 10, 1 << 16
#: Levels an octave of the counts that the sketch ends with, a byte each.
_LEVELS = 11
#: Least and most bits of a filter, bits for each key, and bits of a part, which one task sets.
_FILTER_BITS, _MOST_FILTER_BITS, _KEY_BITS, _FILTER_PART = 1 << 23, 1 << 30, 16, 1 << 20
#: Entries up to which the pairs of a list are made; sets, and shingles, that a part of a block holds; sets of a part when outsiders ask.
SHORT, BLOCK_SETS, BLOCK_SHINGLES, ASK_SETS = 16, 64, 1 << 20, 512
#: Parts of asking sets that a block's sets are dealt out to at once.
ASK_ROUND = 16
#: Parts that the rows of a block are dealt out in where they join what is said of the block.
_SALTS = 32


_NO_CLASH = np.zeros(0, np.int64)


def _set_hash(h: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each set, from its size and the sum of its shingles' mixed hashes."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)))])
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _apart(node: np.ndarray, check: np.ndarray, clash: np.ndarray) -> np.ndarray:
    """The nodes, with the second hash in those that different sets share."""
    return np.where(np.isin(node, clash), mix(node.view(np.uint64) ^ mix(check.view(np.uint64))).view(np.int64), node) if len(clash) else node


def _sets(column: pa.Array, shingle: int, clash: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of the texts' sets, where each begins, each set's node (0: empty), and its second hash."""
    h, at = shingle_sets(split_words(*text_bytes(column), SPACED_LOWER), shingle)
    node, check = _set_hash(h, at, 0), _set_hash(h, at, 0x6A09E667F3BCC909)
    return h, at, np.where(np.diff(at) > 0, _apart(node, check, clash), 0), check


def _power(least: int, wanted: int, most: int) -> int:
    """The power of two from ``wanted`` on, between two others."""
    return min(most, max(least, 1 << max(0, wanted - 1).bit_length()))


def _buckets(docs: DataFrame) -> int:
    """Buckets of the sketch: as the text grows, as many shingles fall into each, so that rare ones are still told from frequent ones."""
    return _power(_BUCKETS, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // _BUCKET_BYTES, _MOST_BUCKETS)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) & np.uint64(buckets - 1)).astype(np.int64)


def _first_pass(docs: DataFrame, shingle: int, buckets: int = _BUCKETS) -> DataFrame:
    """The columns of every document but its text, n_shingles, node and check; and each task's counts of shingles by bucket in rows with a chunk."""
    carried = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in carried), *T._parse_datatype_string("n_shingles bigint, node bigint, check bigint, chunk int, counts binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.uint16)
        for batch in batches:
            column = text_column(batch, "text")
            for a, b in steps(column):
                h, at, node, check = _sets(column.slice(a, b - a), shingle, _NO_CLASH)
                held, more = np.unique(_bucket(h, buckets), return_counts=True)
                counts[held] = np.minimum(counts[held] + more, 0xFFFF)  # beyond that, one is as frequent as the other
                own = [batch.column(batch.schema.get_field_index(f.name)).slice(a, b - a) for f in carried]
                none = [None] * (b - a)
                yield _batch(schema, *own, np.diff(at), node, check, none, none)
        packer = zstandard.ZstdCompressor(level=1)
        for k, part in enumerate(counts.reshape(-1, _CHUNK)):
            if part.any():
                yield _batch(schema, *([[None]] * (len(carried) + 3)), [k], [packer.compress(part)])

    return docs.mapInArrow(run, schema)


def _batch(schema: T.StructType, *columns: object) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, type=f.type) for c, f in zip(columns, kinds)], schema=kinds)


def _clashes(first: DataFrame) -> np.ndarray:
    """Nodes that different sets share: as many as 64-bit hashes collide, which is next to none."""
    by = first.where("node <> 0").groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high"))
    return np.array(sorted(r.node for r in by.where("low < high").select("node").collect()), np.int64)


def _set_apart(first: DataFrame, clash: np.ndarray) -> DataFrame:
    """The documents' rows of the first pass, with their final nodes."""
    own = first.where("chunk IS NULL").drop("chunk", "counts")
    if not len(clash):
        return own.drop("check")
    place = own.columns.index("node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, check = (batch.column(k).to_numpy(zero_copy_only=False) for k in (place, place + 1))
            yield batch.set_column(place, "node", pa.array(np.where(node != 0, _apart(node, check, clash), 0)))

    return own.mapInArrow(run, own.schema).drop("check")


def _sketch(first: DataFrame, buckets: int) -> np.ndarray:
    """The logarithms of the tasks' counts, summed as they stream by, a byte a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums.setdefault(k, np.zeros(_CHUNK, np.uint64))
                sums[k] += np.frombuffer(unpack(raw), np.uint16)
        for k, v in sums.items():
            levels = np.minimum(np.rint(np.log2(v + 1.0) * _LEVELS), 0xFF).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([levels.tobytes()], pa.binary())], names=["chunk", "counts"])

    chunks = first.where("chunk is not null").select("chunk", "counts").repartition(buckets // _CHUNK, "chunk")
    summed = written(chunks.mapInArrow(run, "chunk int, counts binary"))  # which ends the disk of its shuffle
    out = np.zeros(buckets, np.uint8)
    for r in summed.toLocalIterator():
        out[r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] = np.frombuffer(r.counts, np.uint8)
    dropped(summed)
    return out


def _least_part(n: int, num: int, den: int) -> int:
    """n - ceil(n * num / den) + 1: how many of n ordered shingles must meet a set that shares that part."""
    return n + (-n * num) // den + 1


def _bitmap(h: np.ndarray) -> bytes:
    """Bits that the shingles of a set flip, about one a shingle; the first half of a map, xor the second, is the map of half the size."""
    size = max(64, 1 << int(len(h) - 1).bit_length())
    flips = np.bincount(((h >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def _can_link(n: int, bits: bytes, m: int, other: bytes, percent: int) -> bool:
    """False only if the two sets cannot link: they differ in at least as many shingles as their maps in bits."""
    if n * 100 < m * percent or m * 100 < n * percent:
        return False
    while len(bits) > len(other):
        half = len(bits) // 2
        bits = (int.from_bytes(bits[:half]) ^ int.from_bytes(bits[half:])).to_bytes(half)
    while len(other) > len(bits):
        half = len(other) // 2
        other = (int.from_bytes(other[:half]) ^ int.from_bytes(other[half:])).to_bytes(half)
    apart = (int.from_bytes(bits) ^ int.from_bytes(other)).bit_count()
    return (100 + percent) * (n + m - apart) >= 2 * percent * (n + m)


def _postings(docs: DataFrame, sketch: np.ndarray, shingle: int, percent: int, clash: np.ndarray) -> DataFrame:
    """(node, n, indexed, tokens, bits): the probe part of each set, rarest first, of which the first ``indexed`` are its index part, and its bit map."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def step(batch: pa.RecordBatch, column: pa.Array) -> dict[str, object] | None:
        h, at, node, _ = _sets(column, shingle, clash)
        rank = (sent.value[_bucket(h, len(sent.value))].astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        _, rows = np.unique(node, return_index=True)
        rows = rows[node[rows] != 0]
        tokens, bits = [], []
        for i in rows.tolist():
            own, ranks = h[at[i] : at[i + 1]], rank[at[i] : at[i + 1]]
            p = _least_part(len(own), percent, 100)
            rare = np.flatnonzero(ranks <= np.partition(ranks, p - 1)[p - 1])
            tokens.append(own[rare[np.lexsort((own[rare], ranks[rare]))][:p]])
            bits.append(_bitmap(own))
        n = np.diff(at)[rows]
        flat = np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, np.int64)
        indexed = [_least_part(int(k), 2 * percent, 100 + percent) for k in n]
        return {"node": node[rows], "n": n, "indexed": indexed, "tokens": lists(flat, np.array([len(t) for t in tokens], np.int64)), "bits": bits}

    return map_text(docs.select("text"), "text", "node bigint, n int, indexed int, tokens array<bigint>, bits binary", step)


def _filter(keys: DataFrame) -> np.ndarray:
    """A bit table in which the bits of all ``keys`` (a column of longs of a written table) are set; it is as large as they are many."""
    size = _power(_FILTER_BITS, keys.count() * _KEY_BITS, _MOST_FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            bits, part = (c.to_numpy() for c in batch.columns)
            for k in np.unique(part).tolist():
                parts.setdefault(k, np.zeros(_FILTER_PART, bool))[bits[part == k] % _FILTER_PART] = True
        for k, v in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(v, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    bit = F.pmod(F.col(keys.columns[0]), F.lit(size).cast("long"))
    dealt = keys.select(bit.alias("bit"), F.expr(f"int(bit div {_FILTER_PART})").alias("part")).repartition(size // _FILTER_PART, "part")
    table = np.zeros(size // 32, np.uint32)
    words = _FILTER_PART // 32
    for r in dealt.mapInArrow(run, "part int, bits binary").toLocalIterator():
        table[r.part * words : (r.part + 1) * words] = np.frombuffer(r.bits, np.uint32)
    return table


def _maybe(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for keys that were not among those of the filter."""
    bits = keys % (len(table) * 32)
    return (table[bits >> 5] >> (bits & 31).astype(np.uint32)) & 1 == 1


def _entries(postings: DataFrame) -> DataFrame:
    """(token, node, n, low, held): entries of the lists that index-level skipping leaves; ``held``: entries of the list."""
    rows = postings.select("node", "n", "indexed", F.posexplode("tokens").alias("pos", "token")).select("node", "n", (F.col("pos") < F.col("indexed")).alias("low"), "token")
    found = rows.groupBy("token").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.max("low").alias("low"), F.count(F.lit(1)).alias("held"))
    shared = written(found.where((F.col("first") < F.col("last")) & F.col("low")).select(F.col("token").alias("t"), "held"))
    sent = rows.sparkSession.sparkContext.broadcast(_filter(shared.select("t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_maybe(sent.value, batch.column(3).to_numpy())))

    left = written(rows.mapInArrow(run, rows.schema).join(shared, F.col("token") == F.col("t")).drop("t"))
    dropped(shared)
    return left


def _short_pairs(entries: DataFrame, percent: int, short: int) -> DataFrame:
    """(a, b), a < b: the pairs of lists of at most ``short`` entries that position and size allow."""
    lists_ = entries.where(F.col("held") <= short).groupBy("token").agg(F.collect_set(F.struct("node", "n", "low")).alias("e"))

    def fits(x, y):
        smaller = F.when(x["n"] < y["n"], x["low"]).when(x["n"] > y["n"], y["low"]).otherwise(x["low"] | y["low"])
        return (x["node"] < y["node"]) & smaller & (F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent)

    pairs = F.flatten(F.transform("e", lambda x: F.transform(F.filter("e", lambda y: fits(x, y)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    return lists_.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def _stars(entries: DataFrame, percent: int, short: int) -> DataFrame:
    """Edges (a, b) from each node to the smallest node of every longer list, over the entries that position and size allow."""
    left = entries.where(F.col("held") > short)
    only = lambda c: F.when(F.col("low"), F.col(c))
    blocks = left.groupBy(F.col("token").alias("t")).agg(F.min(only("n")).alias("least"), F.max(only("n")).alias("most"), F.min(only("node")).alias("leader"))
    fits = F.col("low") | ((F.col("least") <= F.col("n")) & (F.col("most") * 100 >= F.col("n") * percent))
    edges = left.join(written(blocks), F.col("token") == F.col("t")).where(fits & (F.col("node") != F.col("leader")))
    return edges.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the bit maps of ``nodes`` (node, n, bits) do not rule out."""
    left = pairs.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa")), "a")
    both = left.join(nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb")), "b").select("a", "b", "na", "xa", "nb", "xb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_can_link(*row, percent) for row in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def _held(docs: DataFrame, nodes: DataFrame, shingle: int, clash: np.ndarray) -> DataFrame:
    """(node, packed) of the nodes in blocks, one row each: a text of the node, compressed, which is shorter than its hashed set."""
    sent = docs.sparkSession.sparkContext.broadcast(_filter(nodes))

    def step(batch: pa.RecordBatch, column: pa.Array) -> dict[str, object] | None:
        node = _sets(column, shingle, clash)[2]
        _, rows = np.unique(node, return_index=True)
        rows = rows[_maybe(sent.value, node[rows]) & (node[rows] != 0)]
        packer = zstandard.ZstdCompressor(level=3)
        return {"node": node[rows], "packed": [packer.compress(column[i].as_buffer()) for i in rows.tolist()]} if len(rows) else None

    found = map_text(docs.select("text"), "text", "node bigint, packed binary", step)
    return found.groupBy("node").agg(F.first("packed").alias("packed"))


def _unpacked(packed: list[bytes], shingle: int) -> list[np.ndarray]:
    """The sets of compressed texts."""
    unpack = zstandard.ZstdDecompressor().decompress
    texts = [unpack(p) for p in packed]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    h, first = shingle_sets(split_words(np.frombuffer(b"".join(texts), np.uint8), at, SPACED_LOWER), shingle)
    return [h[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def links_within(node: np.ndarray, sets: list[np.ndarray], percent: int, asked: np.ndarray | None = None) -> np.ndarray:
    """The smallest node that links connect each set with, among links of which one end at least is ``asked`` (all by default).

    Overlaps of a set with all others are derived from those of the most similar pivot, if the two differ in less than
    half of the set, by reading only the lists of shingles in which they differ.
    """
    n = np.array([len(s) for s in sets])
    if len(sets) == 2:
        overlap = len(np.intersect1d(*sets, assume_unique=True))
        return np.full(2, node.min()) if 100 * overlap >= percent * (n.sum() - overlap) else node
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(sets)), n)
    by_token = np.argsort(token, kind="stable")
    listed, start = owner[by_token], np.concatenate([[0], np.cumsum(np.bincount(token))])
    own = [token[at[i] : at[i + 1]] for i in range(len(sets))]

    def lists_sum(tokens: np.ndarray) -> np.ndarray:
        size = start[tokens + 1] - start[tokens]
        if not len(tokens) or not size.sum():
            return np.zeros(len(sets), np.int64)
        first = np.repeat(start[tokens] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        return np.bincount(listed[first + np.arange(size.sum())], minlength=len(sets))

    label = np.arange(len(sets))
    pivots: list[tuple[int, np.ndarray]] = []
    for i in np.flatnonzero(asked).tolist() if asked is not None else range(len(sets)):
        if (label == label[0]).all():
            break
        near = max(pivots, key=lambda p: p[1][i], default=None)
        if near is not None and 2 * near[1][i] > n[i]:
            overlap = near[1] + lists_sum(np.setdiff1d(own[i], own[near[0]], True)) - lists_sum(np.setdiff1d(own[near[0]], own[i], True))
        else:
            overlap = lists_sum(own[i])
            pivots.append((i, overlap))
        linked = np.flatnonzero(100 * overlap >= percent * (n[i] + n - overlap))
        roots = np.unique(label[linked])
        if len(roots) > 1:
            label[np.isin(label, roots)] = roots[0]
    order = np.lexsort((node, label))
    first = np.unique(label[order], return_index=True)
    return node[order][first[1]][np.searchsorted(first[0], label)]


def _joined(parts: DataFrame, keys: list[str], shingle: int, percent: int) -> DataFrame:
    """(node, root) by :func:`links_within` for the rows (node, packed, asked) of equal keys, one group after another."""

    def answer(group: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        node = np.concatenate([g.column(0).to_numpy(zero_copy_only=False) for g in group])
        asked = np.concatenate([g.column(2).to_numpy(zero_copy_only=False) for g in group])
        sets = _unpacked([p for g in group for p in g.column(1).to_pylist()], shingle)
        return node, links_within(node, sets, percent, None if asked.all() else asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple | None = None
        for batch in batches:
            names = [batch.column(3 + k).to_numpy(zero_copy_only=False) for k in range(len(keys))]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in names], axis=0)) + 1 if batch.num_rows else np.zeros(0, int)
            out = []
            for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                key = tuple(k[a] for k in names) if b > a else last
                if key != last and held:
                    out.append(answer(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = key
            if out:
                yield _answers(out)
        if held:
            yield _answers([answer(held)])

    dealt = parts.select("node", "packed", "asked", *keys).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "node bigint, root bigint")


def _answers(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    node, root = (np.concatenate(x) for x in zip(*out))
    other = node != root
    return pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(root[other])], names=["node", "root"])


def _verified(pairs: DataFrame, held: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Edges (node, root) of the pairs (a, b) that link: each ``a`` is answered among its ``b``, ``ASK_SETS`` at a time.

    A set of many pairs is an ``a``, so that it comes once for each ``ASK_SETS`` of them and not for every pair.
    """
    degrees = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("pairs"))
    busy = written(degrees.where(F.col("pairs") > ASK_SETS))
    turned, part = pairs, F.lit(0)
    if busy.take(1):
        of = lambda c: busy.select(F.col("node").alias(c), F.col("pairs").alias(f"p{c}"))
        both = _with(_with(pairs, of("a"), "a", "b", "left"), of("b"), "b", "a", "left").na.fill(0, ["pa", "pb"])
        turn = F.col("pb") > F.col("pa")
        turned = both.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"), F.ceil(F.greatest("pa", "pb") / ASK_SETS).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64(F.lit(5), "b"), F.greatest("parts", F.lit(1))).cast("int")
    cut = turned.select("a", "b", part.alias("part"))
    rows = cut.select(F.col("a").alias("group"), "part", F.col("b").alias("node"), F.lit(False).alias("asked")).union(cut.select("a", "part", "a", F.lit(True)).distinct())
    return _joined(rows.join(held, "node"), ["group", "part"], shingle, percent)


def _with(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """Rows with what ``right`` says of their key, a row each; rows of a hot key are dealt out by a salt from column ``by``."""
    salted = left.withColumn("salt", F.pmod(F.xxhash64(F.lit(3), by), F.lit(_SALTS)).cast("int"))
    return salted.join(right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))), [key, "salt"], how).drop("salt")


def _folded(maps: np.ndarray, size: int) -> np.ndarray:
    """Bit maps, a row each, brought down to ``size`` bytes."""
    while maps.shape[1] > size:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def possible_pairs(askers: list[tuple], others: list[tuple], percent: int) -> list[tuple[int, int]]:
    """(asker, other) of the pairs of rows (node, n, bits, root, asked) with different roots whose bit maps let them link; of two that both ask, once."""
    out = []
    for size in {len(o[2]) for o in others}:
        rows = [o for o in others if len(o[2]) == size]
        node, n, root, asks = (np.array([o[k] for o in rows]) for k in (0, 1, 3, 4))
        maps = np.frombuffer(b"".join(o[2] for o in rows), np.uint8).reshape(len(rows), size)
        small: dict[int, np.ndarray] = {}
        for a, m, bits, there, _ in askers:
            fits = np.flatnonzero((n * 100 >= m * percent) & (m * 100 >= n * percent) & (root != there) & (~asks | (a < node)))
            if len(fits):
                at = min(size, len(bits))
                if at not in small:
                    small[at] = np.ascontiguousarray(_folded(maps, at)).view(np.uint64)
                own = np.ascontiguousarray(_folded(np.frombuffer(bits, np.uint8)[None], at)).view(np.uint64)
                apart = np.bitwise_count(small[at][fits] ^ own).sum(axis=1, dtype=np.int64)
                both = n[fits] + m
                out += [(a, x) for x in node[fits[(100 + percent) * (both - apart) >= 2 * percent * both]].tolist()]
    return out


def _outside_pairs(members: DataFrame, percent: int, since: int, until: int) -> DataFrame:
    """(a, b): each set ``a`` of a block outside its largest component with all its sets ``b`` of other components, if their bit maps allow.

    ``members`` is (node, n, bits, block, root, asked, parts, askers).  The sets of a block, and those that ask, are cut by hash
    into parts of ``ASK_SETS``; each part of askers meets each part of sets in a task of its own, so no pair comes twice.
    These are the pairs of the parts of askers from ``since`` to before ``until``.
    """
    part = lambda seed, c: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(c)).cast("int")
    column = ["node", "n", "bits", "root", "asked"]
    last, to = F.least("askers", F.lit(until)) - 1, part(2, "askers")
    targets = members.where(F.col("askers") > since).select(*column, F.lit(False).alias("asking"), "block", part(1, "parts").alias("part"), F.explode(F.sequence(F.lit(since), last)).alias("to"))
    asking = members.where(F.col("asked") & to.between(since, last)).select(*column, F.lit(True).alias("asking"), "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), to.alias("to"))
    dealt = targets.union(asking).repartition("block", "part", "to").sortWithinPartitions("block", "part", "to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, askers, others = None, [], []
        for batch in batches:
            out = []
            for node, n, bits, root, asked, asks_here, *own in zip(*(c.to_pylist() for c in batch.columns)):
                if own != key:
                    out += possible_pairs(askers, others, percent)
                    key, askers, others = own, [], []
                (askers if asks_here else others).append((node, n, bits, root, asked))
            yield from _pairs(out)
        yield from _pairs(possible_pairs(askers, others, percent))

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _pairs(out: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])


def set_components(docs: DataFrame, sketch: np.ndarray, shingle: int, percent: int, clash: np.ndarray = _NO_CLASH, block_sets: int = BLOCK_SETS, short: int = SHORT) -> DataFrame:
    """(node, root) of the nodes that links connect with others."""
    # One row a node, so that copies neither lengthen lists nor take disk; what is no longer read is deleted on the way.
    postings = written(_postings(docs, sketch, shingle, percent, clash).dropDuplicates(["node"]))
    maps = written(postings.select("node", "n", "bits"))
    entries = _entries(postings)
    dropped(postings)
    pairs = written(_possible(_short_pairs(entries, percent, short), maps, percent))
    blocks = written(connected_components(_stars(entries, percent, short)).withColumnRenamed("root", "block"))
    dropped(entries)
    sized = blocks.join(maps.select("node", "n"), "node")
    size = sized.groupBy("block").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block_sets), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    named = written(_with(blocks, size, "block", "node").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(named.select("node")).distinct()
    needed = written(needed)
    held = written(_held(docs, needed, shingle, clash))
    dropped(needed)
    by_pair = written(_verified(pairs, held, shingle, percent))
    dropped(pairs)
    # Each part of a block meets part 0, whose sets are the pivots.
    goes = F.when(F.col("part") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))
    meets = named.select("node", "block", F.explode(goes).alias("to")).join(held, "node").withColumn("asked", F.lit(True))
    edges = written(by_pair.union(_joined(meets, ["block", "to"], shingle, percent))).select(F.col("node").alias("a"), F.col("root").alias("b"))
    dropped(by_pair)
    roots = written(connected_components(edges))
    large = named.where("parts > 1").select("node", "block")
    if not large.take(1):
        for done in (maps, blocks, named, held, edges):
            dropped(done)
        return roots
    state = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sums = state.groupBy("block", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("block").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("all"))
    cut = sums.where("all > most").select("block", "main", F.ceil(F.col("all") / ASK_SETS).cast("int").alias("parts"), F.ceil((F.col("all") - F.col("most")) / ASK_SETS).cast("int").alias("askers"))
    members = written(_with(state, cut, "block", "node").withColumn("asked", F.col("root") != F.col("main")).join(maps, "node"))
    # In rounds, so that the disk that a block takes grows with its sets and not with their square.
    rounds = range(0, members.agg(F.max("askers")).first()[0] or 0, ASK_ROUND)
    outside = [written(_outside_pairs(members, percent, k, k + ASK_ROUND)) for k in rounds]
    for done in (maps, blocks, named, members):
        dropped(done)
    if not outside:
        for done in (held, edges):
            dropped(done)
        return roots
    late = _verified(reduce(DataFrame.union, outside), held, shingle, percent)
    found = connected_components(edges.union(late.select(F.col("node").alias("a"), F.col("root").alias("b"))))  # which is written
    for done in (held, edges, roots, *outside):
        dropped(done)
    return found


def _own_and_roots(rows: DataFrame, shingle: int, percent: int, block_sets: int) -> tuple[DataFrame, DataFrame]:
    """The columns of ``rows`` but the text, with n_shingles and node; and (node, root) of the nodes that others link with."""
    buckets = _buckets(rows)
    first = written(_first_pass(rows, shingle, buckets))
    clash = _clashes(first)
    return _set_apart(first, clash), set_components(rows.select("text"), _sketch(first, buckets), shingle, percent, clash, block_sets)


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, block_sets: int = BLOCK_SETS) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (the smallest id that links reach)."""
    own, roots = _own_and_roots(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shingle, percent, block_sets)
    nodes = own.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("low")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes = written(nodes)
    # Written, so that the join is all that deals out its sides, and Spark splits the sets of a large component.
    lowest = written(nodes.groupBy("root").agg(F.min("low").alias("component_id")))
    joined = own.join(nodes.join(lowest, "root").select("node", "component_id"), "node", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("node") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all its columns: the one of the smallest id, null ids last; of texts that share this id, the one of the smallest hash.

    Texts with an empty set link with nothing and stay, once an id and text.  Of rows that share id and text, the one
    of the smallest hash over all columns is taken.  Rows are known by 128 bits of id and text.
    """
    low, high, row = fresh(docs, "low", "high", "row")
    keyed = docs.withColumn(low, F.xxhash64(doc_id, text)).withColumn(high, F.xxhash64(F.lit(7), text, doc_id))
    own, roots = _own_and_roots(keyed.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(low).alias("low"), F.col(high).alias("high")), shingle, percent, BLOCK_SETS)
    first = lambda r: F.min(r).alias("r")
    nodes = own.where("node <> 0").groupBy("node").agg(first(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "low", "high"))).join(roots, "node", "left")
    chosen = nodes.groupBy(F.coalesce("root", "node").alias("c")).agg(first(F.col("r"))).select("r.low", "r.high")
    kept = chosen.unionByName(own.where("node = 0").select("low", "high")).distinct()
    hashable = [f.name for f in docs.schema.fields if "map<" not in (kind := f.dataType.simpleString()) and "variant" not in kind]
    one = keyed.groupBy(low, high).agg(F.min_by(F.struct(*(F.col(c) for c in docs.columns)), F.xxhash64(*hashable)).alias(row))
    return one.join(kept, (F.col(low) == F.col("low")) & (F.col(high) == F.col("high")), "left_semi").select(f"{row}.*")


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Contract query: set size and component of every document."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
