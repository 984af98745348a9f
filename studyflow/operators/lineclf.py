"""Trainable line classifiers: naive Bayes over sets of line features.  The names of the features are fixed values.

Two models share the trainer: lines to keep or delete, and lines that start a question.  Lines fall into few distinct
feature sets, so a pass over the lines counts those (:func:`feature_sets`), and all else works on the counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import marks as M
from ..functions.tables import stored
from ..functions.text import SPACE, strip

#: Upper ends of the length buckets, shares, words of questions and of shared material (fixed values).
LENGTHS = (4, 8, 16, 32, 64, 120)
MOST_DIGITS, MOST_HAN = 0.65, 0.45
ASKING = ("下列", "正确", "计算", "根据", "关于", "表述")
SHARED = ("资料", "要求", "回答下列", "根据上述")
#: Least characters of lines that may contain each other, characters of a stem in a question's key, and the probability of a start (fixed values).
LEAST_SHARED, KEY_STEM, START = 12, 32, 0.55


def compact(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", "")


def _has(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def label_lines(lines: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds ``label`` to the lines of texts that have a target (document_id, page_number, target): keep or delete.

    Without white space, a line is kept if it is in the target, or if both it and a line of the target that it holds have
    at least 12 characters.  Blank lines, and texts with a blank target, are left out.
    """
    parts = F.filter(F.transform(F.split("target", "\n"), compact), lambda t: F.length(t) >= LEAST_SHARED)
    whole = targets.select("document_id", "page_number", compact(F.col("target")).alias("_whole"), parts.alias("_parts")).where("_whole <> ''")
    rows = lines.join(whole, ["document_id", "page_number"]).withColumn("_line", compact(F.col("text"))).where("_line <> ''")
    holds = (F.length("_line") >= LEAST_SHARED) & F.exists("_parts", lambda t: F.contains(F.col("_line"), t))
    keep = F.contains(F.col("_whole"), F.col("_line")) | holds
    return rows.withColumn("label", F.when(keep, "keep").otherwise("delete")).drop("_whole", "_parts", "_line")


def _length_name(n: Column) -> Column:
    out = F
    for most in LENGTHS:
        out = out.when(n <= most, f"len:<= {most}")
    return out.otherwise(f"len:> {LENGTHS[-1]}")


def _once(line: Column, f: Callable[[Column, Column], Column]) -> Column:
    """``f`` of a line with single blanks, and of it without white space; bound by a lambda, so that both are made once and not for every feature."""
    text = F.regexp_replace(F.trim(F.coalesce(line, F.lit(""))), f"{SPACE}+", " ")
    return F.get(F.transform(F.array(F.struct(F.trim(text).alias("t"), compact(line).alias("b"))), lambda s: f(s["t"], s["b"])), 0)


def _named(text: Column, bare: Column, found: list[tuple[Column, str]]) -> Column:
    names = F.array(_length_name(F.length(bare)), *(F.when(c, name) for c, name in found))
    return F.when(text == "", F.array(F.lit("empty"))).otherwise(F.filter(names, lambda x: x.isNotNull()))


def line_features(line: Column) -> Column:
    """Names of the features that a line has, for keeping or deleting it."""
    return _once(line, _line_features)


def _line_features(text: Column, bare: Column) -> Column:
    share = lambda pattern: F.regexp_count(bare, F.lit(pattern)) / F.greatest(F.length(bare), F.lit(1))
    return _named(text, bare, [
        (_has(text, M.HINTS), "noise_hint"), (text.rlike(M.PAGE_NUMBER) | text.rlike(M.PAGE_OF), "page_number"), (text.rlike(M.SYMBOLS), "symbol_only"), (text.rlike(r"(?i)https?://|www\\."), "url"),
        (_has(F.lower(text), ("<img", "imgs/")), "image_ref"), (text.rlike(M.OPTION), "option_line"), (text.rlike(M.QUESTION), "question_start"), (text.rlike(M.SECTION_START), "section_header"),
        (_has(text, ("答案",)), "answer_marker"), (_has(text, ("解析",)), "analysis_marker"), (bare.rlike(M.SHORT_NUMBER), "digits_only_short"), (share("[0-9]") >= MOST_DIGITS, "mostly_digits"),
        (text.rlike(M.HAN), "has_chinese"), (share(M.HAN) >= MOST_HAN, "mostly_chinese"), (F.regexp_count(text, F.lit(M.LABEL)) >= 2, "dense_options"),
    ])


def start_features(line: Column) -> Column:
    """Names of the features that a line has, for starting a question."""
    return _once(line, _start_features)


def _start_features(text: Column, bare: Column) -> Column:
    return _named(text, bare, [
        (text.rlike(M.QUESTION), "regex_question_start"), (text.rlike(M.SECTION_START), "section_header"), (text.rlike(M.OPTION), "option_line"), (text.rlike(M.ANSWER_HEAD), "answer_line"),
        (text.rlike(M.ANALYSIS_LINE), "analysis_line"), (F.regexp_count(text, F.lit(M.LABEL)) >= 2, "dense_options"), (_has(text, ("（）", "()")) | _has(bare, ("()",)), "blank_slot"),
        (_has(text, ASKING), "question_prompt_word"), (_has(text, SHARED), "shared_context_word"), (bare.rlike(M.SHORT_NUMBER), "digits_only"),
    ])


def never_dropped(line: Column) -> Column:
    """Lines that the keep/delete model leaves alone: starts, sections, options, answers and analyses."""
    return _once(line, lambda t, _: (t == "") | t.rlike(M.QUESTION) | t.rlike(M.SECTION_START) | t.rlike(M.OPTION) | (F.regexp_count(t, F.lit(M.LABEL)) >= 2) | _has(t, ("答案", "解析")))


def question_key(line: Column) -> Column:
    """``number:beginning of the stem`` of a line that starts a question, without white space; the number alone where nothing follows; else null."""
    text = strip(line)
    number = F.regexp_extract(text, rf"^\s*(?:#+\s*)?(?:第\s*)?({M.NUMBER})", 1)
    body = F.substring(strip(F.regexp_replace(text, M.QUESTION, "")), 1, KEY_STEM)
    return F.when(text.rlike(M.QUESTION), compact(F.when(body == "", number).otherwise(F.concat(number, F.lit(":"), body))))


def label_starts(lines: DataFrame, gold: DataFrame) -> DataFrame:
    """Adds ``label`` to lines (document_id, text) of documents with gold questions (document_id, question_no, stem_text): question_start if the line's key is a gold one, else other."""
    number, stem = strip(F.coalesce("question_no", F.lit(""))), strip(F.coalesce("stem_text", F.lit("")))
    known = gold.where(number != "").select("document_id", F.explode(F.array(compact(F.concat(number, F.lit(":"), F.substring(stem, 1, KEY_STEM))), compact(number))).alias("_key")).distinct()
    some = gold.select("document_id").distinct()
    rows = lines.join(some, "document_id", "left_semi").withColumn("_key", question_key(F.col("text")))
    found = rows.join(known.withColumn("_gold", F.lit(True)), ["document_id", "_key"], "left")
    return found.withColumn("label", F.when(F.col("_gold"), "question_start").otherwise("other")).drop("_key", "_gold")


def feature_sets(labelled: DataFrame, featurise: Callable[[Column], Column] = line_features, guard: Callable[[Column], Column] = never_dropped) -> DataFrame:
    """(label, f, guarded, n): how often a label has a feature set, and whether the model leaves such lines alone."""
    return labelled.groupBy("label", featurise(F.col("text")).alias("f"), guard(F.col("text")).alias("guarded")).agg(F.count(F.lit(1)).alias("n"))


def train_nb(labelled: DataFrame, featurise: Callable[[Column], Column] = line_features) -> tuple[DataFrame, DataFrame]:
    """Label counts (label, n), and (feature, label, n)."""
    return train_sets(labelled.groupBy("label", featurise(F.col("text")).alias("f")).agg(F.count(F.lit(1)).alias("n")))


def train_sets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    return sets.groupBy("label").agg(F.sum("n").alias("n")), sets.select("label", "n", F.explode("f").alias("feature")).groupBy("feature", "label").agg(F.sum("n").alias("n"))


def log_odds(labels: DataFrame, features: DataFrame, target: str, other: str) -> Callable[[Column], Column]:
    """The log odds of ``target``, as a function of a column of feature sets.

    The model has as many rows as there are features, a fixed number, so it is one literal map.
    """
    n = {r.label: r.n for r in labels.collect()}
    total = n.get(target, 0) + n.get(other, 0)
    counts = {(r.feature, r.label): r.n for r in features.collect()}
    names = sorted({f for f, _ in counts})
    odds = lambda label: F.log(F.lit((n.get(label, 0) + 1) / (total + 2)))
    weight = lambda f, label: (counts.get((f, label), 0) + 1) / (n.get(label, 0) + 2)
    table = F.create_map(*(F.lit(x) for f in names for x in (f, weight(f, target) / weight(f, other)))) if names else F.create_map().cast("map<string,double>")
    new = F.lit((n.get(other, 0) + 2) / (n.get(target, 0) + 2))
    return lambda f: F.round(odds(target) - odds(other) + F.aggregate(F.transform(f, lambda x: F.log(F.coalesce(F.try_element_at(table, x), new))), F.lit(0.0), lambda s, x: s + x), 6)


def score_nb(lines: DataFrame, labels: DataFrame, features: DataFrame, target: str = "delete", other: str = "keep", threshold: float = 0.0) -> DataFrame:
    """Lines with the log odds of ``target``, and whether it is predicted; lines that the model leaves alone never are."""
    odds = log_odds(labels, features, target, other)
    return lines.withColumn("score", odds(line_features(F.col("text")))).withColumn("predicted", (F.col("score") >= threshold) & ~never_dropped(F.col("text")))


def dropped_by(labels: DataFrame, features: DataFrame, threshold: float = 0.0) -> Column:
    """What a trained keep/delete model drops, over a column ``text``; for :func:`..corpus.classify_lines`."""
    return (log_odds(labels, features, "delete", "keep")(line_features(F.col("text"))) >= threshold) & ~never_dropped(F.col("text"))


def score_starts(lines: DataFrame, labels: DataFrame, features: DataFrame, threshold: float = START) -> DataFrame:
    """Lines with the probability ``p`` that they start a question, and whether it reaches the threshold."""
    odds = log_odds(labels, features, "question_start", "other")
    return lines.withColumn("p", probability(odds(start_features(F.col("text"))))).withColumn("start", F.col("p") >= threshold)


def fit_starts(labelled: DataFrame, threshold: float = START) -> DataFrame:
    """Labelled lines, without their text, with ``p`` and ``start`` of a model that is trained on them.

    Features are made in one pass and written; training and scores read them from there.
    """
    made = stored(labelled.withColumn("f", start_features(F.col("text"))).drop("text"))
    odds = log_odds(*train_sets(made.groupBy("label", "f").agg(F.count(F.lit(1)).alias("n"))), "question_start", "other")
    return made.withColumn("p", probability(odds(F.col("f")))).withColumn("start", F.col("p") >= threshold).drop("f")


def probability(score: Column) -> Column:
    """Sigmoid of the log odds, held within 50."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), score))))


def evaluate_sets(sets: DataFrame, labels: DataFrame, features: DataFrame, target: str = "delete", other: str = "keep", threshold: float = 0.0) -> DataFrame:
    """:func:`evaluate` from counted feature sets, without another pass over the lines."""
    odds = log_odds(labels, features, target, other)
    return evaluate(sets, F.col("label") == target, (odds(F.col("f")) >= threshold) & ~F.col("guarded"), F.col("n"))


def evaluate(pred: DataFrame, actual: Column, predicted: Column, weight: Column | None = None) -> DataFrame:
    """One row: confusion counts, accuracy, precision, recall and F1 (4 dp; 0 where undefined)."""
    rows = pred.select(actual.alias("a"), predicted.alias("p"), (F.lit(1) if weight is None else weight).cast("long").alias("w"))
    of = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0)).alias(name)
    a, p = F.col("a"), F.col("p")
    c = rows.agg(of(a & p, "tp"), of(~a & p, "fp"), of(a & ~p, "fn"), of(~a & ~p, "tn"))
    ratio = lambda x, y: F.bround(F.coalesce(F.try_divide(x, y), F.lit(0.0)), 4)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def publish_gate(runs: DataFrame, active_score: float, least_samples: int = 20, least_pass: float = 0.95, least_confidence: float = 0.92) -> DataFrame:
    """Per run: whether it may be published: enough confident samples, passes, mean confidence, and a better score than the active model's."""
    by = runs.groupBy("run_id").agg(F.count_if(F.col("confidence") >= least_confidence).alias("samples"), F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.avg("confidence").alias("confidence"))
    ok = (F.col("samples") >= least_samples) & (F.col("pass_rate") >= least_pass) & (F.col("confidence") >= least_confidence) & (F.col("pass_rate") > active_score)
    return by.select("run_id", "samples", F.round("pass_rate", 6).alias("pass_rate"), F.round("confidence", 6).alias("confidence"), ok.alias("publish"))
