"""Quality rules as a short-circuit cascade.

A document is kept when it breaks no rule, so the order of the rules never changes the verdict, only the work: each
rule sees only what the rules before it let through.  :func:`plan_cascade` runs every rule over a random sample,
measures the seconds each takes a megabyte and which sample documents it rejects, and orders the rules greedily by
rejections (among those that the rules before it leave) per cost.

Defined results: null and empty texts have no words, so the length rule rejects them; the rules look at whole texts of
any length; repeated rows get equal verdicts; an empty table has an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import filter_text, map_text, text_bytes
from .tokens import SPACED, Words, mix, span_hashes, split_words, windows

#: Documents that the costs and selectivities are estimated on, about.
SAMPLE_ROWS = 2000


def _per_text(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[at])


class Texts:
    """Texts of one step with the features of those that rules ask for, each computed once."""

    def __init__(self, column: pa.Array):
        self.column = column
        self.data, self.at = text_bytes(column)
        self._got: dict[str, np.ndarray] = {}
        self._words: Words | None = None

    def __len__(self) -> int:
        return len(self.at) - 1

    @property
    def words(self) -> Words:
        if self._words is None:
            self._words = split_words(self.data, self.at, SPACED, hashed=False)
        return self._words

    def get(self, name: str) -> np.ndarray:
        if name not in self._got:
            self._got[name] = getattr(self, f"_{name}")()
        return self._got[name]

    def _n_words(self) -> np.ndarray:
        return self.words.counts

    def _word_chars(self) -> np.ndarray:
        return _per_text((SPACED[self.data] != 0) & ((self.data & 0xC0) != 0x80), self.at)

    def _n_symbols(self) -> np.ndarray:
        return _per_text(np.isin(self.data, np.frombuffer(b"#*$%&|<>", np.uint8)), self.at)

    def _n_upper(self) -> np.ndarray:
        return _per_text((self.data >= 0x41) & (self.data <= 0x5A), self.at)

    def _n_lower(self) -> np.ndarray:
        return _per_text((self.data >= 0x61) & (self.data <= 0x7A), self.at)

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word: the text of each, and a hash of it."""
        breaks = np.flatnonzero(self.data == 0x0A)
        start = np.concatenate([self.at[:-1], breaks + 1])
        end = np.concatenate([self.at[1:], breaks])
        start.sort(), end.sort()
        words = np.concatenate([[0], np.cumsum(SPACED[self.data] != 0)])
        held = words[end] > words[start]
        start, end = start[held], end[held]
        text = np.searchsorted(self.at, start, side="right") - 1
        return text, span_hashes(self.data, start, end)

    def _n_lines(self) -> np.ndarray:
        return np.bincount(self.get("lines")[0], minlength=len(self))

    def _n_dup_lines(self) -> np.ndarray:
        text, line = self.get("lines")
        distinct = np.unique(np.stack([text.astype(np.uint64), line]), axis=1)[0].astype(np.int64) if len(text) else text
        return np.bincount(text, minlength=len(self)) - np.bincount(distinct, minlength=len(self))

    def _n_repeat_words(self) -> np.ndarray:
        words = self.words
        if not len(words.hash):
            words.hash = span_hashes(words.data, words.start, words.end)
        h, whole = windows(words, 3)
        text = words.text_of()
        place = np.flatnonzero(whole)
        _, which, n = np.unique(mix(h[place]) ^ mix(text[place].astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
        place = place[n[which] > 1]
        covered = np.zeros(len(text), bool)
        for k in range(3):
            covered[place + k] = True
        return np.bincount(text[covered], minlength=len(self))

    def take(self, rows: np.ndarray) -> Texts:
        return Texts(self.column.take(pa.array(np.flatnonzero(rows))))


@dataclass(frozen=True)
class Rule:
    """``rejects`` says, for the texts of a step, which break the rule."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


#: The contract's base rules, then the method's own.  The limits follow published web-text filters (share of symbols,
#: of repeated lines, length of words); all are plain integer comparisons.
BASE_RULES = (
    Rule("too_short", lambda t: t.get("n_words") < 50),
    Rule("repeated_windows", lambda t: 100 * t.get("n_repeat_words") > 50 * t.get("n_words")),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda t: 10 * t.get("n_symbols") > 4 * t.get("n_words")),
    Rule("word_length", lambda t: (t.get("word_chars") < 2 * t.get("n_words")) | (t.get("word_chars") > 20 * t.get("n_words"))),
    Rule("repeated_lines", lambda t: 100 * t.get("n_dup_lines") > 50 * t.get("n_lines")),
    Rule("shouting", lambda t: t.get("n_upper") > t.get("n_lower")),
)


def rejected(column: pa.Array, rules: tuple[Rule, ...]) -> np.ndarray:
    """The cascade: the number (from 1) of the first rule that rejects each text, else 0."""
    verdict = np.zeros(len(column), np.int32)
    left = np.arange(len(column))
    texts = Texts(column)
    for k, rule in enumerate(rules, 1):
        bad = rule.rejects(texts)
        if bad.any():
            verdict[left[bad]] = k
            left = left[~bad]
            if not len(left):
                break
            if 2 * int(bad.sum()) > len(bad):  # features are kept unless most of the texts are gone
                texts = texts.take(~bad)
            else:
                texts = _narrowed(texts, ~bad)
    return verdict


def _narrowed(texts: Texts, rows: np.ndarray) -> Texts:
    out = texts.take(rows)
    out._got = {k: v[rows] for k, v in texts._got.items() if isinstance(v, np.ndarray)}
    return out


def plan_cascade(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> tuple[Rule, ...]:
    """The rules in the order of rejections per cost, estimated on about ``sample_rows`` random documents.

    Only the sums by (rule, set of rules that reject) come to the driver: at most 2 to the number of rules.
    """
    total = docs.count()
    sample = docs.select(text).sample(min(1.0, sample_rows / max(total, 1)), seed)

    def measure(batch: pa.RecordBatch, column: pa.Array) -> dict[str, object]:
        broken = np.zeros(len(column), np.int64)
        out: dict[str, list] = {"rule": [], "broken": [], "docs": [], "seconds": []}
        size = max(1, len(text_bytes(column)[0])) / 1e6
        for k, rule in enumerate(rules):
            began = time.perf_counter()
            broken |= rule.rejects(Texts(column)).astype(np.int64) << k
            out["rule"].append(k), out["broken"].append(None), out["docs"].append(None)
            out["seconds"].append((time.perf_counter() - began) / size)
        for mask, n in zip(*(x.tolist() for x in np.unique(broken, return_counts=True))):
            out["rule"].append(None), out["broken"].append(mask), out["docs"].append(n), out["seconds"].append(None)
        return out

    rows = map_text(sample, text, "rule int, broken bigint, docs bigint, seconds double", measure)
    found = rows.groupBy("rule", "broken").agg(F.sum("docs").alias("docs"), F.avg("seconds").alias("seconds")).collect()
    cost = {r.rule: r.seconds for r in found if r.rule is not None}
    masks = {r.broken: r.docs for r in found if r.broken is not None}
    order: list[int] = []
    while len(order) < len(rules):
        gone = sum(1 << k for k in order)
        gain = {k: sum(n for m, n in masks.items() if m >> k & 1 and not m & gone) / max(cost.get(k, 1.0), 1e-9) for k in range(len(rules)) if k not in order}
        order.append(max(gain, key=lambda k: (gain[k], -k)))
    return tuple(rules[k] for k in order)


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document: doc_id, n_words, the base counters, base_failed, kept, and the rule that rejected it (else null)."""
    order = plan_cascade(docs, text, rules, sample_rows)
    names = np.array([None, *(r.name for r in order)], object)
    counters = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def step(batch: pa.RecordBatch, column: pa.Array) -> dict[str, object]:
        texts = Texts(column)
        base = BASE_RULES[0].rejects(texts) | BASE_RULES[1].rejects(texts)
        verdict = np.zeros(len(column), np.int32)
        rest = _narrowed(texts, ~base)  # the counters are wanted for all; the cascade goes on with what passes the base rules
        places = {r.name: k for k, r in enumerate(order, 1)}
        verdict[base] = np.where(BASE_RULES[0].rejects(texts)[base], places.get("too_short", 0), places.get("repeated_windows", 0))
        for k, rule in enumerate(order, 1):
            if rule not in BASE_RULES and len(rest):
                bad = rule.rejects(rest)
                if bad.any():
                    alive = np.flatnonzero(verdict == 0)
                    verdict[alive[bad]] = k
                    rest = _narrowed(rest, ~bad)
        return {"doc_id": batch.column(0)} | {c: texts.get(c) for c in counters} | {"base_failed": base, "kept": verdict == 0, "rule": pa.array(names[verdict].tolist(), pa.string())}

    long = [T.StructField(c, T.LongType()) for c in counters]
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *long, T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("rule", T.StringType())])
    return map_text(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", schema, step)


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents, with all their columns, that no rule rejects; rules run as the planned cascade."""
    order = plan_cascade(docs, text, rules, sample_rows)
    return filter_text(docs, text, lambda column: rejected(column, order) == 0)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract query: counters and verdict of every document."""
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rule")
