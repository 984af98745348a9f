"""Benchmark decontamination by a prefix-filtered join of exact word windows.

Each benchmark item becomes windows of consecutive words (the whole item, if it is shorter).  A window can only occur
where all of its word shingles do, so one shingle per window is enough to find its places: the *necessary prefix* of
an exact containment join is the rarest shingle, rarity being the number of documents that hold it.  A window with a
shingle that no document holds cannot occur and is left out.  Where a document holds a prefix shingle, the length
bound and the positional bound (the window must fit in the document around the shingle) come first, and then all the
words of the window are compared.

The benchmark side is sent to the tasks in blocks of at most ``max_windows`` windows, so what is broadcast has a fixed
bound; a larger benchmark takes more blocks, each a pass over the documents that is written before the next block is
collected, and no shuffle of the documents.  The driver and the workers hold one block at a time.

Defined results: null and empty texts have no words, are never hit and stay; an item without words or with a null id
matches nothing; items of equal id count once; repeated document rows are judged each on its own; an empty benchmark
hits nothing.  Columns of the documents that are not asked for play no part.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import dropped, filter_text, lists, map_text, text_bytes, written
from .tokens import ALNUM_LOWER, Words, split_words, windows

WINDOW, SHINGLE, MAX_WINDOWS = 10, 5, 100_000
_FLAGS = 1 << 20


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The items' windows: (item, length, words, shingles), the shingles in the order of their places in the window."""

    def step(batch: pa.RecordBatch, column: pa.Array) -> dict[str, object]:
        words = split_words(*text_bytes(column), ALNUM_LOWER)
        ids = batch.column(0).to_pylist()
        out: dict[str, list] = {"item": [], "length": [], "words": [], "shingles": []}
        hashes: dict[int, np.ndarray] = {}
        for i, n in enumerate(words.counts.tolist()):
            length = min(n, window)
            k = min(shingle, length)
            if k and k not in hashes:
                hashes[k] = windows(words, k)[0].view(np.int64)
            for a in range(words.first[i], words.first[i + 1] - length + 1) if k else ():
                out["item"].append(ids[i])
                out["length"].append(length)
                out["words"].append(words.words(a, a + length))
                out["shingles"].append(hashes[k][a : a + length - k + 1].tolist())
        return out

    items = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    return map_text(items, "text", "item string, length int, words binary, shingles array<bigint>", step)


def shingle_frequencies(docs: DataFrame, text: str, wanted: dict[int, np.ndarray]) -> DataFrame:
    """In how many documents each wanted shingle (by its number of words) occurs: (k, shingle, df)."""
    sent = docs.sparkSession.sparkContext.broadcast({k: _Members(v) for k, v in wanted.items()})

    def step(batch: pa.RecordBatch, column: pa.Array) -> dict[str, object] | None:
        words = split_words(*text_bytes(column), ALNUM_LOWER)
        text_of = words.text_of()
        ks, shingles, counts = [], [], []
        for k, members in sent.value.items():
            place, which = members.places(*windows(words, k))
            if len(place):
                pair = np.unique(np.stack([text_of[place], which]), axis=1)[1]
                found, n = np.unique(pair, return_counts=True)
                ks.append(np.full(len(found), k))
                shingles.append(members.tokens[found].view(np.int64))
                counts.append(n)
        if not ks:
            return None
        return {"k": np.concatenate(ks).astype(np.int32), "shingle": np.concatenate(shingles), "df": np.concatenate(counts)}

    found = map_text(docs.select(text), text, "k int, shingle bigint, df bigint", step)
    return found.groupBy("k", "shingle").agg(F.sum("df").alias("df"))


class _Members:
    """A sorted set of hashes and where they occur among others; a bit table answers most lookups."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = np.unique(tokens)
        self.flags = np.zeros(_FLAGS, bool)
        self.flags[self.tokens & np.uint64(_FLAGS - 1)] = True

    def places(self, hashes: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of members, and which members they are."""
        place = np.flatnonzero(self.flags[hashes & np.uint64(_FLAGS - 1)] & whole)
        which = np.searchsorted(self.tokens, hashes[place])
        found = self.tokens[np.minimum(which, len(self.tokens) - 1)] == hashes[place]
        return place[found], which[found]


class WindowIndex:
    """Windows by their necessary prefix shingle."""

    def __init__(self, rows: list, frequencies: dict[tuple[int, int], int], shingle: int):
        items: dict[bytes, set[str]] = defaultdict(set)
        shingles: dict[bytes, tuple[int, list[int]]] = {}
        for item, length, words, own in rows:
            items[words].add(item)
            shingles[words] = (length, own)
        self.items, self.words, self.length = [], [], []
        by_prefix: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for words, (length, own) in shingles.items():
            k = min(shingle, length)
            df = [frequencies.get((k, s), 0) for s in own]
            if not all(df):
                continue
            offset = min(range(len(own)), key=lambda j: (df[j], own[j]))
            by_prefix[k][own[offset] & (1 << 64) - 1].append((len(self.words), offset))
            self.items.append(sorted(items[words]))
            self.words.append(words)
            self.length.append(length)
        self.parts = {}
        for k, lists_ in by_prefix.items():
            members = _Members(np.array(list(lists_), np.uint64))
            self.parts[k] = members, [lists_[t] for t in members.tokens.tolist()]

    def occurrences(self, words: Words) -> Iterator[tuple[int, int, int]]:
        """(text, first word, window) of every window that occurs in the texts."""
        text_of, first = words.text_of(), words.first
        for k, (members, where) in self.parts.items():
            for place, which in zip(*(x.tolist() for x in members.places(*windows(words, k)))):
                text = int(text_of[place])
                for window, offset in where[which]:
                    a = place - offset
                    b = a + self.length[window]
                    if first[text] <= a and b <= first[text + 1] and words.words(a, b) == self.words[window]:
                        yield text, a, window


def window_indexes(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, window: int, shingle: int, max_windows: int) -> Iterator[tuple[WindowIndex, bool]]:
    """The benchmark's windows in blocks of about ``max_windows``, each indexed by its rarest shingles, and whether it is the last."""
    found = written(item_windows(benchmark, item_id, item_text, window, shingle))
    blocks = max(1, math.ceil(found.count() / max_windows))
    for block in range(blocks):
        yield _block_index(docs, text, found.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block), shingle), block == blocks - 1
    dropped(found)


def _block_index(docs: DataFrame, text: str, found: DataFrame, shingle: int) -> WindowIndex:
    rows = found.collect()
    wanted = defaultdict(set)
    for r in rows:
        wanted[min(shingle, r.length)].update(r.shingles)
    sets = {k: np.array(sorted(v), np.int64).view(np.uint64) for k, v in wanted.items()}
    df = {(r.k, r.shingle): r.df for r in shingle_frequencies(docs, text, sets).collect()} if sets else {}
    return WindowIndex([tuple(r) for r in rows], df, shingle)


def _in_passes(docs: DataFrame, blocks: Iterator[tuple[WindowIndex, bool]], step: Callable[[DataFrame, Broadcast, bool, bool], DataFrame]) -> DataFrame:
    """``docs`` after ``step`` with each block (and whether it is the first, and the last); all passes but the last are written, and their block let go, before the next block is made."""
    out, before, first = docs, None, True
    for index, last in blocks:  # enumerate would hold the block while the next is made
        sent = docs.sparkSession.sparkContext.broadcast(index)
        del index
        out = step(out, sent, first, last)
        first = False
        if not last:
            out = written(out)
            sent.destroy()
            if before is not None:
                dropped(before)
            before = out
    return out


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE, max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside any occurrence), spans (first word and word after, merged), items (ids as sorted strings)."""
    kind = docs.schema[doc_id].dataType
    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    carried = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]
    schema = lambda last: T.StructType([T.StructField("doc_id", kind), *carried, *[T.StructField("text", T.StringType())] * (not last)])
    blocks = window_indexes(docs, benchmark, text, item_id, item_text, window, shingle, max_windows)
    return _in_passes(out, blocks, lambda rows, sent, first, last: map_text(rows, "text", schema(last), _hits(sent, not first)))


def _hits(sent, again: bool):
    def step(batch: pa.RecordBatch, column: pa.Array) -> dict[str, object]:
        index: WindowIndex = sent.value
        words = split_words(*text_bytes(column), ALNUM_LOWER)
        n = len(column)
        spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        items: list[set[str]] = [set() for _ in range(n)]
        if again:
            for i, (s, found) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())):
                spans[i] = list(zip(s[::2], s[1::2]))
                items[i] = set(found)
        for text, a, w in index.occurrences(words):
            a -= int(words.first[text])
            spans[text].append((a, a + index.length[w]))
            items[text].update(index.items[w])
        merged = [_merged(s) for s in spans]
        flat = [x for s in merged for x in s]
        return {
            "doc_id": batch.column("doc_id"), "text": column, "n_words": words.counts,
            "n_hit": [sum(s[1::2]) - sum(s[::2]) for s in merged],
            "spans": lists(np.array(flat, np.int64), np.array([len(s) for s in merged])),
            "items": lists(pa.array([x for s in items for x in sorted(s)], pa.string()), np.array([len(s) for s in items])),
        }

    return step


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The documents, with all their columns, in which no window of the benchmark occurs."""

    def drop(rows: DataFrame, sent: Broadcast, first: bool, last: bool) -> DataFrame:
        def keep(column: pa.Array) -> np.ndarray:
            clean = np.ones(len(column), bool)
            for hit, _, _ in sent.value.occurrences(split_words(*text_bytes(column), ALNUM_LOWER)):
                clean[hit] = False
            return clean

        return filter_text(rows, text, keep)

    return _in_passes(docs, window_indexes(docs, benchmark, text, item_id, item_text, window, shingle, max_windows), drop)


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contract query: words hit by 10-word windows of ``benchmark`` in every document."""
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
