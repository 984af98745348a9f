"""Exam analysis: how often each knowledge point is examined per year, and what to expect next year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import stored
from .tagging import primary_tag


def analysis_base(items: DataFrame, links: DataFrame, papers: DataFrame, tags: DataFrame, points: DataFrame, subject_id: int | None = None, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """Rows (item, question, paper, year, point) of active non-group items that active links tie to real papers."""
    chosen = items.where("status = 'active' AND node_role <> 'group'")
    if subject_id is not None:
        chosen = chosen.where(F.col("subject_id") == subject_id)
    real = papers.where("paper_type = '真题'")
    if year_from is not None:
        real = real.where(F.col("exam_year") >= year_from)
    if year_to is not None:
        real = real.where(F.col("exam_year") <= year_to)
    rows = links.where("status = 'active'").join(real.select(F.col("id").alias("paper_id"), "exam_year"), "paper_id")
    rows = rows.join(chosen.select(F.col("id").alias("bank_question_id"), "question_type", "difficulty"), "bank_question_id")
    primary = primary_tag(tags).select(F.col("question_id").alias("source_question_id"), "point_id")
    rows = rows.join(primary, "source_question_id", "left")
    known = points.select(F.col("id").alias("point_id"), F.col("name").alias("point_name"), "chapter_id", "path")
    return rows.join(known, "point_id", "left").select(
        "bank_question_id", "source_question_id", "paper_id", "exam_year", "question_type", "difficulty",
        F.when(F.col("point_name").isNotNull(), F.col("point_id")).alias("point_id"), "point_name", "chapter_id", "path",
    )


def year_axis(base: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Every year from the first to the last (or the given bounds, swapped if reversed), with the year to predict."""
    ends = base.agg(F.min("exam_year").alias("a"), F.max("exam_year").alias("b"))
    a, b = F.coalesce(F.lit(low), F.col("a")), F.coalesce(F.lit(high), F.col("b"))
    return ends.select(F.explode(F.sequence(F.least(a, b), F.greatest(a, b))).alias("exam_year"), (F.greatest(a, b) + 1).alias("prediction_year"))


def analysis_cells(base: DataFrame) -> DataFrame:
    """Rows ``n`` by point, year and paper: the one aggregate of the base that distributions and the year axis start from.

    It is written, since all of them read it; it has a row for a paper and point.
    """
    cells = base.groupBy("point_id", "point_name", "chapter_id", "path", "exam_year", "paper_id").agg(F.count(F.lit(1)).alias("n"))
    return stored(cells)


def yearly_overview(base: DataFrame, years: DataFrame) -> DataFrame:
    """Distinct papers, questions and tagged questions per year; years without any are zero."""
    tagged = F.when(F.col("point_id").isNotNull(), F.col("source_question_id"))
    counts = base.groupBy("exam_year").agg(F.count_distinct("paper_id").alias("papers"), F.count_distinct("source_question_id").alias("questions"), F.count_distinct(tagged).alias("tagged"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return years.select("exam_year").join(counts, "exam_year", "left").select("exam_year", zero("papers"), zero("questions"), zero("tagged"))


def with_share(counts: DataFrame, n: str, places: int = 4) -> DataFrame:
    """Adds ``share``: a row's part of the sum of column ``n``, which joins as one row."""
    total = counts.agg(F.sum(n).alias("_all"))
    return counts.join(F.broadcast(total)).withColumn("share", F.bround(F.try_divide(F.col(n), F.col("_all")), places)).drop("_all")


def distribution(cells: DataFrame, years: DataFrame, key: Column, name: Column) -> DataFrame:
    """Per key: total rows, distinct papers, share of all, and the dense yearly series as an array in order of years; from :func:`analysis_cells`."""
    rows = cells.where(key.isNotNull()).select(key.alias("key"), name.alias("name"), "exam_year", "paper_id", "n")
    totals = rows.groupBy("key").agg(F.sum("n").alias("total"), F.count_distinct("paper_id").alias("papers"), F.min("name").alias("name"))
    by_year = rows.where("exam_year IS NOT NULL").groupBy("key", "exam_year").agg(F.sum("n").alias("n"))
    grid = totals.select("key").crossJoin(F.broadcast(years.select("exam_year")))  # keys by years: both are small dimensions
    series = grid.join(by_year, ["key", "exam_year"], "left").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("exam_year", F.coalesce("n", F.lit(0)).alias("n")))).alias("s"))
    found = with_share(totals, "total").join(series, "key", "left")
    return found.select("key", "name", "total", "papers", "share", F.transform("s", lambda x: x["n"]).alias("series"), F.transform("s", lambda x: x["exam_year"]).alias("years"))


def point_distribution(cells: DataFrame, years: DataFrame) -> DataFrame:
    return distribution(cells, years, F.col("point_id"), F.col("point_name"))


def chapter_key() -> Column:
    """First two parts of the path, else the chapter id, else unbound."""
    parts = F.filter(F.split("path", "/"), lambda x: F.trim(x) != "")
    return F.when(F.size(parts) >= 1, F.array_join(F.slice(parts, 1, 2), "/")).when(F.col("chapter_id").isNotNull(), F.concat(F.lit("chapter-"), F.col("chapter_id"))).otherwise(F.lit("unbound"))


def chapter_distribution(cells: DataFrame, years: DataFrame) -> DataFrame:
    key = F.when(F.col("point_id").isNotNull(), chapter_key())
    return distribution(cells, years, key, key)


def series_metrics(series: Column) -> Column:
    """Struct of last, recent (mean of the last three), slope, present, std, confidence, prediction and trend of a yearly series."""
    n = F.size(series)
    d = lambda c: c.cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    last = d(F.element_at(series, -1))
    tail = F.slice(series, F.greatest(n - 2, F.lit(1)), F.lit(3))
    recent = total(tail) / F.size(tail)
    slope = F.when(n > 1, (last - d(F.element_at(series, 1))) / (n - 1)).otherwise(F.lit(0.0))
    present = F.size(F.filter(series, lambda x: x > 0))
    mean = total(series) / n
    std = F.sqrt(F.aggregate(series, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n)
    confidence = F.least(F.lit(0.95), F.greatest(F.lit(0.15), 0.35 + 0.35 * present / n + 0.25 / (1 + std)))
    raw = 0.5 * last + 0.3 * recent + 0.2 * F.greatest(F.lit(0.0), slope)
    prediction = F.bround(F.when((present <= 1) & (last <= 1), raw * 0.7).otherwise(raw), 0).cast("long")
    trend = F.when(slope >= 0.5, "rising").when(slope <= -0.5, "falling").when((last > 0) & (recent > 0), "stable").otherwise("sporadic")
    empty = F.struct(F.lit(0).cast("long").alias("last"), F.lit(0.0).alias("recent"), F.lit(0.0).alias("slope"), F.lit(0).cast("long").alias("present"), F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("prediction"), F.lit("stable").alias("trend"))
    found = F.struct(last.cast("long").alias("last"), recent.alias("recent"), slope.alias("slope"), present.cast("long").alias("present"), confidence.alias("confidence"), prediction.alias("prediction"), trend.alias("trend"))
    return F.when(F.coalesce(n, F.lit(0)) == 0, empty).otherwise(found)


def top_predictions(dist: DataFrame, k: int = 5) -> DataFrame:
    """The k keys with the largest predictions (then total, papers, name), with evidence."""
    rows = dist.withColumn("m", series_metrics(F.col("series"))).select("key", "name", "total", "papers", "share", "m.*")
    evidence = F.format_string("mean of the last years %.2f, last year %d, slope %.2f, examined in %d years", F.col("recent"), F.col("last"), F.col("slope"), F.col("present"))
    return rows.withColumn("evidence", evidence).orderBy(F.desc("prediction"), F.desc("total"), F.desc("papers"), "name").limit(k)


def analysis_summary(base: DataFrame, dist: DataFrame, k: int = 5) -> DataFrame:
    """One row: distinct counts, share of tagged questions, and the share of the k most frequent points."""
    tagged = F.when(F.col("point_id").isNotNull(), F.col("source_question_id"))
    counts = base.agg(F.count_distinct("paper_id").alias("papers"), F.count_distinct("bank_question_id").alias("items"), F.count_distinct("source_question_id").alias("questions"), F.count_distinct(tagged).alias("tagged"))
    top = dist.orderBy(F.desc("total"), "key").limit(k).agg(F.sum("total").alias("top"))
    everything = dist.agg(F.sum("total").alias("all"), F.count(F.lit(1)).alias("points"))
    ratio = lambda a, b: F.bround(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 4)
    one = counts.crossJoin(everything).crossJoin(top)  # one row each
    return one.select("papers", "items", "questions", "tagged", "points", ratio("tagged", "questions").alias("coverage"), ratio("top", "all").alias("concentration"))


def _top_names(dist: DataFrame, k: int, trend: str | None = None) -> DataFrame:
    """One row: the names of the first k keys by prediction, total, papers and name, of a trend if one is given."""
    rows = dist.withColumn("m", series_metrics(F.col("series")))
    rows = rows if trend is None else rows.where(F.col("m.trend") == trend)
    first = rows.orderBy(F.desc("m.prediction"), F.desc("total"), F.desc("papers"), "name").limit(k)
    order = F.struct((-F.col("m.prediction")).alias("a"), (-F.col("total")).alias("b"), (-F.col("papers")).alias("c"), "name")
    return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["name"]), ", ").alias("names"))


def analysis_report(summary: DataFrame, years: DataFrame, points: DataFrame, chapters: DataFrame) -> DataFrame:
    """(line, part, text) of a report in five parts: overview, points, chapters, forecast and what to keep in mind.

    It says what the sample holds and how much of it is tagged, which points and chapters lead, which points rise and
    which chapters stay, and what to expect next year.
    """
    span = years.agg(F.min("exam_year").alias("low"), F.max("exam_year").alias("high"), F.max("prediction_year").alias("next"))
    row = summary.join(F.broadcast(span))
    for name, dist, k, trend in (("p3", points, 3, None), ("c3", chapters, 3, None), ("rise", points, 3, "rising"), ("stay", chapters, 3, "stable"), ("p5", points, 5, None), ("c5", chapters, 5, None)):
        row = row.join(F.broadcast(_top_names(dist, k, trend).withColumnRenamed("names", name)))  # one row each
    or_none = lambda c: F.when(F.col(c) != "", F.col(c)).otherwise("none")
    percent = lambda c: F.bround(F.round(F.col(c) * 100, 6), 0).cast("long")
    period = F.when(F.col("low").isNull(), "the sample").otherwise(F.format_string("%d-%d", "low", "high"))
    parts = [
        ("overview", F.format_string("%d papers with %d questions in %s; %d of them (%d%%) have a primary point.", "papers", "questions", period, "tagged", percent("coverage"))),
        ("points", F.format_string("The five most frequent points make up %d%%. Leading: %s. Rising: %s.", percent("concentration"), or_none("p3"), or_none("rise"))),
        ("chapters", F.format_string("Leading chapters: %s. Stable over the years: %s. Chapters count by their points.", or_none("c3"), or_none("stay"))),
        ("forecast", F.format_string("For %s look first at the points %s and the chapters %s. Weighted from the last year, the mean of three years and the slope; no certainty.", F.coalesce(F.col("next").cast("string"), F.lit("next year")), or_none("p5"), or_none("c5"))),
        ("caution", F.lit("Only active questions that go back to real papers count; missing tags, years or papers move the figures.")),
    ]
    return row.select(F.posexplode(F.array(*(F.struct(F.lit(n).alias("part"), t.alias("text")) for n, t in parts))).alias("line", "x")).select((F.col("line") + 1).alias("line"), "x.part", "x.text")


def hot_score(base: DataFrame, years: DataFrame) -> DataFrame:
    """.35 frequency + .25 paper coverage + .20 growth + .10 score weight + .10 difficulty, each scaled to 0..1 within the scope.

    Growth is the count of the last three years less that of the three before; every question weighs one, so the score
    weight of a point is its mean count per paper.
    """
    last = years.agg(F.max("exam_year").alias("last"))
    rows = base.where("point_id IS NOT NULL").crossJoin(F.broadcast(last))  # one row
    in_last = lambda a, b: F.count_if((F.col("exam_year") > F.col("last") - b) & (F.col("exam_year") <= F.col("last") - a)).cast("double")
    parts = rows.groupBy("point_id").agg(
        F.count(F.lit(1)).cast("double").alias("freq"), F.count_distinct("paper_id").cast("double").alias("cover"), (in_last(0, 3) - in_last(3, 6)).alias("growth"),
        (F.count(F.lit(1)) / F.count_distinct("paper_id")).alias("weight"), F.avg("difficulty").alias("hard"), in_last(0, 3).cast("long").alias("last3"), in_last(0, 5).cast("long").alias("last5"),
    )
    names = ("freq", "cover", "growth", "weight", "hard")
    ends = parts.agg(*(f(c).alias(f"{k}_{c}") for c in names for k, f in (("low", F.min), ("high", F.max))))  # one row
    parts = parts.join(F.broadcast(ends))
    scaled = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"low_{c}"), F.col(f"high_{c}") - F.col(f"low_{c}")), F.lit(0.0))
    score = 0.35 * scaled("freq") + 0.25 * scaled("cover") + 0.20 * scaled("growth") + 0.10 * scaled("weight") + 0.10 * scaled("hard")
    return parts.select("point_id", "last3", "last5", F.bround(score, 6).alias("hot"))


def heatmap(base: DataFrame) -> DataFrame:
    """Rows per chapter and year."""
    return base.where("point_id IS NOT NULL AND exam_year IS NOT NULL").groupBy(chapter_key().alias("chapter"), "exam_year").agg(F.count(F.lit(1)).alias("n"))


def mix(base: DataFrame, dim: str) -> DataFrame:
    """Rows per value of a dimension, and their share."""
    return with_share(base.groupBy(F.col(dim).alias("value")).agg(F.count(F.lit(1)).alias("n")), "n")


def _pairs(rows: DataFrame, unit: str) -> DataFrame:
    """(a, b, n, lift) of points that share units (unit, point_id), with how many; a unit holds few points, since these are a small dimension."""
    rows = rows.where("point_id IS NOT NULL").select(unit, "point_id").distinct()
    sets = rows.groupBy(unit).agg(F.array_sort(F.collect_set("point_id")).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    both = sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))
    single = rows.groupBy("point_id").agg(F.count(F.lit(1)).alias("c"))
    total = rows.agg(F.count_distinct(unit).alias("units"))
    joined = both.join(single.select(F.col("point_id").alias("a"), F.col("c").alias("ca")), "a").join(single.select(F.col("point_id").alias("b"), F.col("c").alias("cb")), "b").join(F.broadcast(total))
    return joined.select("a", "b", "n", F.bround(F.col("n") * F.col("units") / (F.col("ca") * F.col("cb")), 6).alias("lift"))


def cooccurrence(tags: DataFrame, base: DataFrame) -> DataFrame:
    """(unit, a, b, n, lift): pairs of points on the same question (by its confirmed and suggested tags), and in the same paper (by the primary points)."""
    live = tags.where("status IN ('confirmed', 'suggested')")
    return _pairs(live, "question_id").select(F.lit("question").alias("unit"), "*").unionByName(_pairs(base, "paper_id").select(F.lit("paper").alias("unit"), "*"))


def type_combos(base: DataFrame) -> DataFrame:
    """Sets of question types by how many papers have just them."""
    sets = base.groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_set("question_type")), "+").alias("types"))
    return sets.groupBy("types").agg(F.count(F.lit(1)).alias("papers"))


def error_prone(answers: DataFrame, question_points: DataFrame, dist: DataFrame, min_answers: int = 20) -> DataFrame:
    """Points with at least ``min_answers`` graded answers: share of wrong ones, how often exams have the point, and ``priority``, their product.

    A point that no exam has has frequency 0; what is often examined and often wrong has the largest priority.
    """
    rows = answers.where("answered AND is_correct IS NOT NULL").join(question_points, "question_id")
    by = rows.groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_correct")).alias("wrong")).where(F.col("n") >= min_answers)
    joined = by.join(dist.select(F.col("key").alias("point_id"), "total"), "point_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    rate = F.col("wrong") / F.col("n")
    return joined.select("point_id", "n", "wrong", F.bround(rate, 4).alias("rate"), F.col("total").alias("frequency"), F.bround(rate * F.col("total"), 4).alias("priority")).orderBy(F.desc("priority"), F.desc("rate"), "point_id")
