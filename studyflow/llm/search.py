"""Ranked lexical search by the Best Position Algorithm over impact lists.

All documents are ranked for every item.  A first pass over the texts counts documents, terms, and the documents of each
term that an item has; a second one searches.  Each task cuts its documents into segments of bounded size and builds for
each term of the items a list of the segment's documents by descending impact, with every document's position in it.

An item's lists are read in parallel from the top, a block of positions a round.  A document that is met first in one
list is looked up in all others (direct accesses), which gives its whole score and marks its positions there as seen.
The best position of a list is the last one up to which all positions are seen; it runs ahead of the last position read.
No document that is not met yet can score more than the sum of the impacts at the best positions.  The search of a
segment ends when that sum is strictly below the score of the item's k-th document so far (ties need to be met, since
the smaller id wins), counting what the task found in its earlier segments.  Each task gives its best k for each item;
these are ranked once more.

The term tables of the items are sent to the tasks, so items are handled in groups of at most ``GROUP_TERMS`` (item,
term) pairs; each group takes a pass over the texts.  Terms are known by 64-bit hashes.

Scores are 64-bit integers (div rounds down): with N documents that have a term, L terms in all of them, n in this one,
df documents of the term and tf occurrences, w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))),
m = 100 - 90 + ((90 * n * N) div L), and the score is the sum of w * ((1000000000 * tf) div (1000 * tf + 8 * m)).

Defined results: a null or empty text has no term; a null id comes after all others of the same score; rows of the same
item id are one item, with the terms of all; null item ids take no part; repeated documents are ranked one by one;
empty tables give no rows; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import steps, text_bytes, text_column, written
from .tokens import ALNUM_LOWER, Words, split_words

#: Documents returned for an item; pairs of an item and a term that a pass handles.
K, GROUP_TERMS = 10, 1 << 20
#: Terms whose lists a search holds at a time, cells (terms x documents) and text bytes of a segment, and positions that a round reads first.
PART_TERMS, SEGMENT_CELLS, SEGMENT_BYTES, ROUND = 1 << 14, 1 << 23, 1 << 22, 8


@dataclass
class Items:
    """Items with their distinct terms, as numbers of sorted term hashes: ``terms[first[i]:first[i + 1]]`` are those of item i."""

    ids: list
    terms: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the hashes ``h``; -1 for those that no item has."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    def parts(self, most: int) -> Iterator[tuple[range, np.ndarray]]:
        """Ranges of items, with the sorted numbers of their terms: ``most`` terms at most, or one item."""
        start, held = 0, set()
        for i in range(len(self.ids)):
            own = set(self.terms[self.first[i] : self.first[i + 1]].tolist())
            if start < i and len(held | own) > most:
                yield range(start, i), np.array(sorted(held), np.int64)
                start, held = i, set()
            held |= own
        if start < len(self.ids):
            yield range(start, len(self.ids)), np.array(sorted(held), np.int64)


def words_of(column: pa.Array) -> Words:
    """The terms of the texts of a string column."""
    return split_words(*text_bytes(column), ALNUM_LOWER)


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, terms): the hashes of each item's distinct terms."""
    kind = items.schema[item_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = words_of(text_column(batch, "text"))
            own = [np.unique(words.hash[a:b]).view(np.int64).tolist() for a, b in zip(words.first, words.first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], names=["item", "terms"])

    rows = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), F.col(text).alias("text"))
    found = rows.mapInArrow(run, f"item {kind}, terms array<long>")
    return found.select("item", F.explode("terms").alias("term")).distinct().groupBy("item").agg(F.collect_list("term").alias("terms"))


def item_groups(items: DataFrame, item_id: str, text: str, group_terms: int) -> Iterator[Items]:
    """The items, a group of bounded size after the other."""
    found = written(item_terms(items, item_id, text))
    total = found.agg(F.sum(F.size("terms"))).first()[0] or 0
    groups = -(-2 * total // group_terms) if total > group_terms else 1
    for g in range(groups if total else 0):
        rows = (found.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g) if groups > 1 else found).orderBy("item").collect()
        if rows:
            flat = np.array([t for r in rows for t in r.terms], np.int64).view(np.uint64)
            hashes, numbers = np.unique(flat, return_inverse=True)
            yield Items([r["item"] for r in rows], numbers, np.cumsum([0, *(len(r.terms) for r in rows)]), hashes)


def term_counts(words: Words, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, occurrences) of the items' terms in the texts, by term and document."""
    numbers = items.numbers(words.hash)
    of = numbers >= 0
    n = max(len(words.first) - 1, 1)
    pairs, tf = np.unique(numbers[of] * n + words.text_of()[of], return_counts=True)
    return pairs // n, pairs % n, tf


def corpus_counts(docs: DataFrame, items: Items) -> tuple[int, int, np.ndarray]:
    """(N, L, df): documents with a term, their terms, and the documents of each term of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, length, df = 0, 0, np.zeros(len(items.hashes), np.int64)
        for batch in batches:
            column = text_column(batch, "text")
            for a, b in steps(column, SEGMENT_BYTES):
                words = words_of(column.slice(a, b - a))
                n, length = n + int((words.counts > 0).sum()), length + int(words.counts.sum())
                df += np.bincount(term_counts(words, items)[0], minlength=len(df))
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, [-1, -2])), pa.array(np.append(df[used], [n, length]))], names=["term", "n"])

    sums = {r.term: r.n for r in docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return sums.get(-1, 0), sums.get(-2, 0), np.array([sums.get(t, 0) for t in range(len(items.hashes))], np.int64)


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(tf: np.ndarray, lengths: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """What an occurrence count adds per unit of a term's weight."""
    if int(lengths.max(initial=0)) * 90 * n_docs >= 1 << 63:
        return np.array([(1000000000 * t) // (1000 * t + 8 * (10 + 90 * x * n_docs // total)) for t, x in zip(tf.tolist(), lengths.tolist())], np.int64)
    return (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * lengths * n_docs) // total))


class Segment:
    """Impact lists of some documents: row t of ``order`` has the documents of term t by descending impact."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int) -> None:
        by = np.lexsort((doc, -impact, term))
        term, doc, impact = term[by], doc[by], impact[by]
        self.size = np.bincount(term, minlength=n_terms)
        self.start = np.cumsum(self.size) - self.size
        self.docs, self.impacts = doc, impact
        # For direct accesses: a document's position in the list of a term (from 1; 0: it has not the term), and its impact.
        self.position = np.zeros((n_terms, n_docs), np.int32)
        self.position[term, doc] = np.arange(len(term)) - self.start[term] + 1
        self.impact = np.zeros((n_terms, n_docs), np.int32)
        self.impact[term, doc] = impact

    def read(self, terms: np.ndarray, a: int, b: int) -> np.ndarray:
        """Documents at the positions from a to b - 1 (from 0) of the lists."""
        at = np.arange(a, b)
        held = at[None, :] < self.size[terms][:, None]
        return np.unique(self.docs[(self.start[terms][:, None] + at[None, :])[held]])


class Top:
    """The best k (score, id, row) of an item; ties by smallest id, null ids last."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.order = k, np.zeros(0, np.int64), []

    @property
    def least(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def offer(self, score: np.ndarray, ids: list) -> None:
        both = [*zip((-self.score).tolist(), self.order), *zip((-score).tolist(), ids)]
        both.sort(key=lambda x: (x[0], x[1] is None, x[1] if x[1] is not None else 0))
        both = both[: self.k]
        self.score, self.order = np.array([-s for s, _ in both], np.int64), [i for _, i in both]


def best_positions(segment: Segment, terms: np.ndarray, weight: np.ndarray, top: Top, ids: list) -> int:
    """Search a segment for one item and put what is found into ``top``; gives the number of documents met."""
    size = segment.size[terms]
    terms, weight, size = terms[size > 0], weight[size > 0], size[size > 0]
    met = np.zeros(segment.position.shape[1], bool)
    if not len(terms):
        return 0
    seen = np.zeros((len(terms), int(size.max()) + 1), bool)  # by position; the one after a list's end stays unseen
    best, lists, a, step = np.zeros(len(terms), np.int64), np.arange(len(terms)), 0, ROUND
    while a < size.max():
        found = segment.read(terms, a, a + step)
        found = found[~met[found]]
        met[found] = True
        if len(found):
            at = segment.position[np.ix_(terms, found)]
            row, col = np.nonzero(at)
            seen[row, at[row, col] - 1] = True
            scores = weight @ segment.impact[np.ix_(terms, found)].astype(np.int64)
            good = (scores > 0) & (scores >= top.least)
            if good.any():
                top.offer(scores[good], [ids[d] for d in found[good].tolist()])
        a, step = a + step, step * 2
        best = np.argmin(seen, axis=1)  # positions seen without a gap
        open_lists = best < size
        # Impacts at the best positions; a list seen to its end has nothing for documents not met.
        bound = weight[open_lists] @ segment.impacts[segment.start[terms[open_lists]] + best[open_lists] - 1] if open_lists.any() else 0
        if bound < top.least or bound == 0:
            break
    return int(met.sum())


def _search(docs: DataFrame, items: Items, counts: tuple[int, int, np.ndarray], k: int, doc_kind: str, item_kind: str) -> DataFrame:
    """(item, doc_id, score): what each task found for each item, k documents at most."""
    n_docs, total, df = counts
    weight = weights(n_docs, df)
    parts = [(own, terms, max(1, SEGMENT_CELLS // max(len(terms), 1))) for own, terms in items.parts(PART_TERMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [Top(k) for _ in items.ids]
        for batch in batches:
            column = text_column(batch, "text")
            for a, b in steps(column, SEGMENT_BYTES):
                words = words_of(column.slice(a, b - a))
                term, doc, tf = term_counts(words, items)
                impact, ids = impacts(tf, words.counts[doc], n_docs, total), batch.column(0).slice(a, b - a).to_pylist()
                for own, terms, rows in parts:
                    number = np.full(len(items.hashes), -1)
                    number[terms] = np.arange(len(terms))
                    for first in range(0, b - a, rows):
                        held = (number[term] >= 0) & (doc >= first) & (doc < first + rows)
                        segment = Segment(number[term[held]], doc[held] - first, impact[held], len(terms), min(rows, b - a - first))
                        for i in own:
                            t = items.terms[items.first[i] : items.first[i + 1]]
                            best_positions(segment, number[t], weight[t], tops[i], ids[first : first + rows])
        found = [(items.ids[i], d, s) for i, top in enumerate(tops) for s, d in zip(top.score.tolist(), top.order)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=["item", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    types = to_arrow_schema(_parse_datatype_string(f"item {item_kind}, doc_id {doc_kind}, score long")).types
    return docs.mapInArrow(run, f"item {item_kind}, doc_id {doc_kind}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", group_terms: int = GROUP_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item, of those that score above 0."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    doc_kind, item_kind = rows.schema["doc_id"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    groups = [_search(rows, group, corpus_counts(rows, group), k, doc_kind, item_kind) for group in item_groups(items, item_id, text, group_terms)]
    found = docs.sparkSession.createDataFrame([], f"item {item_kind}, doc_id {doc_kind}, score long")
    for group in groups:
        found = found.union(written(group) if len(groups) > 1 else group)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # Tasks are many on a large corpus: a few sums of tasks first, then all of an item.
    some = found.withColumn("part", F.spark_partition_id() % 64).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    """Contract query: the ten best documents for each item of the benchmark."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents), q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
c AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0), u AS (SELECT r, unnest(w) AS term FROM d),
p AS (SELECT r, term, count(*) AS tf FROM u SEMI JOIN q ON q.term = u.term GROUP BY ALL), f AS (SELECT term, floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, c.n),
s AS (SELECT item_id, p.r, sum(f.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(d.w) * c.n) // c.l))))::BIGINT AS score FROM q JOIN p ON p.term = q.term JOIN f ON f.term = q.term JOIN d ON d.r = p.r, c GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN d ON d.r = s.r WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 10
"""
