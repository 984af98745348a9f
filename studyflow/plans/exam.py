"""Queries of exam analysis."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exam as X
from .base import query, table, tables

_BASE = """pt AS (SELECT question_id, coalesce(arg_min(point_id, tag_id) FILTER (WHERE status = 'confirmed'), arg_min(point_id, tag_id) FILTER (WHERE status = 'suggested')) AS point_id
  FROM question_tags WHERE relation_type = 'primary' AND status IN ('confirmed', 'suggested') GROUP BY question_id),
b AS (SELECT l.bank_question_id, l.source_question_id, l.paper_id, p.exam_year, i.question_type, i.difficulty, k.id AS point_id, k.name AS point_name, k.chapter_id, k.path
  FROM bank_links l JOIN papers p ON p.id = l.paper_id AND p.paper_type = '真题' JOIN bank_items i ON i.id = l.bank_question_id AND i.status = 'active' AND i.node_role <> 'group'
  LEFT JOIN pt ON pt.question_id = l.source_question_id LEFT JOIN knowledge_points k ON k.id = pt.point_id WHERE l.status = 'active'),
y AS (SELECT unnest(range(min(exam_year), max(exam_year) + 1))::INT AS exam_year FROM b)"""
_DIST = """{key_cte} t AS (SELECT key, min(name) AS name, count(*) AS total, count(DISTINCT paper_id) AS papers FROM r GROUP BY key),
c AS (SELECT t.key, y.exam_year, (SELECT count(*) FROM r WHERE r.key = t.key AND r.exam_year = y.exam_year) AS n FROM t, y),
d AS (SELECT t.*, round_even(total::DOUBLE / sum(total) OVER (), 4) AS share, (SELECT list(n ORDER BY exam_year) FROM c WHERE c.key = t.key) AS series FROM t)"""
_POINTS = _DIST.format(key_cte="r AS (SELECT point_id AS key, point_name AS name, * FROM b WHERE point_id IS NOT NULL),")
_CHAPTERS = _DIST.format(key_cte="r AS (SELECT array_to_string(string_split(path, '/')[1:2], '/') AS key, array_to_string(string_split(path, '/')[1:2], '/') AS name, * FROM b WHERE point_id IS NOT NULL),")
_METRICS = """m0 AS (SELECT *, len(series) AS n, series[-1]::DOUBLE AS last, list_sum(series[greatest(len(series) - 2, 1):])::DOUBLE / len(series[greatest(len(series) - 2, 1):]) AS recent,
  CASE WHEN len(series) > 1 THEN (series[-1] - series[1])::DOUBLE / (len(series) - 1) ELSE 0 END AS slope, len(list_filter(series, lambda x: x > 0)) AS present, list_stddev_pop(series) AS std FROM d),
m AS (SELECT *, least(0.95::DOUBLE, greatest(0.15::DOUBLE, 0.35::DOUBLE + 0.35::DOUBLE * present / n + 0.25::DOUBLE / (1 + std))) AS confidence,
  round_even(CASE WHEN present <= 1 AND last <= 1 THEN 0.7::DOUBLE ELSE 1::DOUBLE END * (0.5::DOUBLE * last + 0.3::DOUBLE * recent + 0.2::DOUBLE * greatest(0, slope)), 0)::BIGINT AS prediction,
  CASE WHEN slope >= 0.5 THEN 'rising' WHEN slope <= -0.5 THEN 'falling' WHEN last > 0 AND recent > 0 THEN 'stable' ELSE 'sporadic' END AS trend FROM m0)"""


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.analysis_base(*tables(spark, sf_dir, "bank_items", "bank_links", "papers", "question_tags", "knowledge_points"))


def _points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = base(spark, sf_dir)
    cells = X.analysis_cells(rows)
    years = X.year_axis(cells)
    return rows, years, X.point_distribution(cells, years)


@query("g1_analysis_base", f"WITH {_BASE} SELECT bank_question_id, source_question_id, paper_id, exam_year, question_type, difficulty, point_id, point_name, chapter_id, path FROM b")
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir)


@query("g2_year_axis", f"WITH {_BASE} SELECT exam_year, (max(exam_year) OVER () + 1)::INT AS prediction_year FROM y")
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.year_axis(base(spark, sf_dir))


@query("g3_yearly_overview", f"""WITH {_BASE} SELECT y.exam_year, count(DISTINCT paper_id) AS papers, count(DISTINCT source_question_id) AS questions,
  count(DISTINCT CASE WHEN point_id IS NOT NULL THEN source_question_id END) AS tagged FROM y LEFT JOIN b USING (exam_year) GROUP BY y.exam_year""")
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir)
    return X.yearly_overview(rows, X.year_axis(rows))


def _exploded(dist: DataFrame) -> DataFrame:
    one = dist.select("key", "name", "total", "papers", "share", F.explode(F.arrays_zip("years", "series")).alias("z"))
    return one.select("key", "name", "total", "papers", "share", F.col("z.years").alias("exam_year"), F.col("z.series").alias("n"))


_SERIES = "SELECT d.key, name, total, papers, share, y.exam_year, n FROM d JOIN c ON c.key = d.key JOIN y ON y.exam_year = c.exam_year"


@query("g4_point_distribution", f"WITH {_BASE}, {_POINTS} {_SERIES}")
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(_points(spark, sf_dir)[2])


@query("g5_chapter_distribution", f"WITH {_BASE}, {_CHAPTERS} {_SERIES}")
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = X.analysis_cells(base(spark, sf_dir))
    return _exploded(X.chapter_distribution(cells, X.year_axis(cells)))


@query("g6_series_metrics", f"WITH {_BASE}, {_POINTS}, {_METRICS} SELECT key, last::BIGINT AS last, round(recent, 6) AS recent, round(slope, 6) AS slope, present, round(confidence, 6) AS confidence, prediction, trend FROM m")
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _points(spark, sf_dir)[2].select("key", X.series_metrics(F.col("series")).alias("m")).select("key", "m.*")
    return found.withColumns({c: F.round(c, 6) for c in ("recent", "slope", "confidence")})


@query("g7_top_predictions", f"""WITH {_BASE}, {_POINTS}, {_METRICS} SELECT key, name, total, papers, prediction, trend, printf('mean of the last years %.2f, last year %d, slope %.2f, examined in %d years', recent, last::BIGINT, slope, present) AS evidence
  FROM m ORDER BY prediction DESC, total DESC, papers DESC, name LIMIT 5""")
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.top_predictions(_points(spark, sf_dir)[2]).select("key", "name", "total", "papers", "prediction", "trend", "evidence")


_SUMMARY = """s AS (SELECT count(DISTINCT paper_id) AS papers, count(DISTINCT bank_question_id) AS items, count(DISTINCT source_question_id) AS questions,
  count(DISTINCT CASE WHEN point_id IS NOT NULL THEN source_question_id END) AS tagged FROM b)"""


@query("g8_summary", f"""WITH {_BASE}, {_POINTS}, {_SUMMARY} SELECT papers, items, questions, tagged, (SELECT count(*) FROM d) AS points, round_even(tagged::DOUBLE / questions, 4) AS coverage,
  round_even((SELECT sum(total) FROM (SELECT total FROM d ORDER BY total DESC, key LIMIT 5))::DOUBLE / (SELECT sum(total) FROM d), 4) AS concentration FROM s""")
def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, dist = _points(spark, sf_dir)
    return X.analysis_summary(rows, dist)


def _renamed(sql: str, tag: str) -> str:
    """The CTEs of a distribution and its metrics under names of their own."""
    out = sql
    for name in ("r", "t", "c", "d", "m0", "m"):
        out = re.sub(rf"(?<![\w.']){name}(?= AS \()|(?<=FROM ){name}\b|(?<=\bFROM ){name}(?=[, )])", f"{name}{tag}", out)
        out = re.sub(rf"(?<![\w.']){name}(?=\.)", f"{name}{tag}", out)
    return out


_CHAPTER_METRICS = _renamed(f"{_CHAPTERS}, {_METRICS}", "_ch")


def _names(m: str, k: int, trend: str = "") -> str:
    where = f"WHERE trend = '{trend}'" if trend else ""
    return f"coalesce((SELECT string_agg(name, ', ' ORDER BY prediction DESC, total DESC, papers DESC, name) FROM (SELECT * FROM {m} {where} ORDER BY prediction DESC, total DESC, papers DESC, name LIMIT {k})), 'none')"


@query("g9_report", f"""WITH {_BASE}, {_POINTS}, {_METRICS}, {_CHAPTER_METRICS}, {_SUMMARY}, q AS (SELECT *, round_even(round(round_even(tagged::DOUBLE / questions, 4) * 100, 6), 0)::BIGINT AS cov,
  round_even(round(round_even((SELECT sum(total) FROM (SELECT total FROM d ORDER BY total DESC, key LIMIT 5))::DOUBLE / (SELECT sum(total) FROM d), 4) * 100, 6), 0)::BIGINT AS con, (SELECT min(exam_year) FROM y) AS low, (SELECT max(exam_year) FROM y) AS high FROM s)
SELECT 1::INT AS line, 'overview' AS part, papers || ' papers with ' || questions || ' questions in ' || low || '-' || high || '; ' || tagged || ' of them (' || cov || '%) have a primary point.' AS text FROM q
UNION ALL SELECT 2::INT, 'points', 'The five most frequent points make up ' || con || '%. Leading: ' || {_names('m', 3)} || '. Rising: ' || {_names('m', 3, 'rising')} || '.' FROM q
UNION ALL SELECT 3::INT, 'chapters', 'Leading chapters: ' || {_names('m_ch', 3)} || '. Stable over the years: ' || {_names('m_ch', 3, 'stable')} || '. Chapters count by their points.' FROM q
UNION ALL SELECT 4::INT, 'forecast', 'For ' || (high + 1) || ' look first at the points ' || {_names('m', 5)} || ' and the chapters ' || {_names('m_ch', 5)} || '. Weighted from the last year, the mean of three years and the slope; no certainty.' FROM q
UNION ALL SELECT 5::INT, 'caution', 'Only active questions that go back to real papers count; missing tags, years or papers move the figures.'""")
def g9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir)
    cells = X.analysis_cells(rows)
    years = X.year_axis(cells)
    points = X.point_distribution(cells, years)
    return X.analysis_report(X.analysis_summary(rows, points), years, points, X.chapter_distribution(cells, years))


@query("g10_hot_score", f"""WITH {_BASE}, z AS (SELECT max(exam_year) AS last FROM y),
q AS (SELECT point_id, count(*)::DOUBLE AS freq, count(DISTINCT paper_id)::DOUBLE AS cover, (count(*) FILTER (WHERE exam_year > last - 3) - count(*) FILTER (WHERE exam_year > last - 6 AND exam_year <= last - 3))::DOUBLE AS growth,
  count(*)::DOUBLE / count(DISTINCT paper_id) AS weight, avg(difficulty) AS hard, count(*) FILTER (WHERE exam_year > last - 3) AS last3, count(*) FILTER (WHERE exam_year > last - 5) AS last5
  FROM b, z WHERE point_id IS NOT NULL GROUP BY point_id)
SELECT point_id, last3, last5, round_even(0.35::DOUBLE * coalesce((freq - min(freq) OVER ()) / nullif(max(freq) OVER () - min(freq) OVER (), 0), 0)
  + 0.25::DOUBLE * coalesce((cover - min(cover) OVER ()) / nullif(max(cover) OVER () - min(cover) OVER (), 0), 0) + 0.2::DOUBLE * coalesce((growth - min(growth) OVER ()) / nullif(max(growth) OVER () - min(growth) OVER (), 0), 0)
  + 0.1::DOUBLE * coalesce((weight - min(weight) OVER ()) / nullif(max(weight) OVER () - min(weight) OVER (), 0), 0) + 0.1::DOUBLE * coalesce((hard - min(hard) OVER ()) / nullif(max(hard) OVER () - min(hard) OVER (), 0), 0), 6) AS hot FROM q""")
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir)
    return X.hot_score(rows, X.year_axis(rows))


@query("g11_heatmap", f"WITH {_BASE} SELECT array_to_string(string_split(path, '/')[1:2], '/') AS chapter, exam_year, count(*) AS n FROM b WHERE point_id IS NOT NULL GROUP BY ALL")
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.heatmap(base(spark, sf_dir))


@query("g11_type_mix", f"WITH {_BASE} SELECT question_type AS value, count(*) AS n, round_even(count(*)::DOUBLE / sum(count(*)) OVER (), 4) AS share FROM b GROUP BY question_type")
def g11_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.mix(base(spark, sf_dir), "question_type")


def _pair_sql(unit: str, key: str, rows: str) -> str:
    return f"""SELECT '{unit}' AS unit, n.a, n.b, n.n, round_even(n.n::DOUBLE * (SELECT count(DISTINCT {key}) FROM {rows}) / (sa.c * sb.c), 6) AS lift FROM (SELECT x.point_id AS a, z.point_id AS b, count(*) AS n FROM {rows} x JOIN {rows} z ON x.{key} = z.{key} AND x.point_id < z.point_id GROUP BY 1, 2) n
  JOIN (SELECT point_id, count(*) AS c FROM {rows} GROUP BY 1) sa ON sa.point_id = n.a JOIN (SELECT point_id, count(*) AS c FROM {rows} GROUP BY 1) sb ON sb.point_id = n.b"""


@query("g12_cooccurrence", f"WITH {_BASE}, rp AS (SELECT DISTINCT paper_id, point_id FROM b WHERE point_id IS NOT NULL), rq AS (SELECT DISTINCT question_id, point_id FROM question_tags WHERE status IN ('confirmed', 'suggested')) {_pair_sql('paper', 'paper_id', 'rp')} UNION ALL {_pair_sql('question', 'question_id', 'rq')}")
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.cooccurrence(table(spark, sf_dir, "question_tags"), base(spark, sf_dir))


@query("g12_type_combos", f"WITH {_BASE} SELECT types, count(*) AS papers FROM (SELECT paper_id, array_to_string(list_sort(list(DISTINCT question_type)), '+') AS types FROM b GROUP BY 1) GROUP BY 1")
def g12_combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.type_combos(base(spark, sf_dir))


@query("g13_error_prone", f"""WITH {_BASE}, e AS (SELECT point_id, count(*) AS n, count(*) FILTER (WHERE NOT is_correct) AS wrong FROM answers a JOIN question_points q ON q.question_id = a.question_id WHERE answered AND is_correct IS NOT NULL GROUP BY 1 HAVING count(*) >= 20),
f AS (SELECT e.*, (SELECT count(*) FROM b WHERE b.point_id = e.point_id) AS frequency FROM e) SELECT point_id, n, wrong, round_even(wrong::DOUBLE / n, 4) AS rate, frequency, round_even(wrong::DOUBLE / n * frequency, 4) AS priority FROM f""")
def g13(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, points = tables(spark, sf_dir, "answers", "question_points")
    return X.error_prone(answers, points, _points(spark, sf_dir)[2])
