"""Queries of learning analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import learning as X
from ..operators import tagging
from .base import query, table, tables

NOW = "2024-02-01 00:00:00"
_BOOK = """w AS (SELECT *, sum(CASE WHEN is_correct THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, question_id ORDER BY submitted_at, id) AS w FROM answers WHERE answered),
k AS (SELECT user_id, question_id, max(w)::BIGINT AS wrong_count, max(submitted_at) FILTER (WHERE is_correct IS NOT TRUE) AS last_wrong, max(submitted_at) AS last_practiced FROM w WHERE w > 0 GROUP BY ALL),
book AS (SELECT k.*, (SELECT count(*) FROM w WHERE w.user_id = k.user_id AND w.question_id = k.question_id AND w.w = k.wrong_count AND w.is_correct) AS streak FROM k)"""
_DUE = _BOOK + f""", du AS (SELECT *, last_practiced + to_days(CASE streak WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END::INT) AS due FROM book WHERE streak < 2),
due AS (SELECT * FROM (SELECT user_id, question_id, due, wrong_count, row_number() OVER (PARTITION BY user_id ORDER BY due, wrong_count DESC, question_id) AS place,
  CASE streak WHEN 0 THEN 'wrong' WHEN 1 THEN 'confirm' ELSE 'refresh' END AS reason FROM du WHERE due <= TIMESTAMP '{NOW}') WHERE place <= 20)"""
_MASTERY = """ma AS (SELECT a.user_id, q.point_id, count(*) AS answered, count(*) FILTER (WHERE is_correct) AS correct, max(a.submitted_at)::DATE AS last_day, round_even(100 * count(*) FILTER (WHERE is_correct)::DOUBLE / count(*), 2) AS score
  FROM answers a JOIN question_points q ON q.question_id = a.question_id WHERE answered AND session_id IN (SELECT id FROM sessions WHERE subject_id IS NOT NULL AND status = 'submitted') GROUP BY 1, 2),
weak AS (SELECT * FROM (SELECT user_id, point_id, score, answered, row_number() OVER (PARTITION BY user_id ORDER BY score, answered DESC, point_id) AS place FROM ma) WHERE place <= 3)"""
_SUM = """ss AS (SELECT s.id, s.user_id, s.status, count(*) AS items, count(*) FILTER (WHERE answered) AS answered, count(*) FILTER (WHERE answered AND is_correct) AS correct,
  round_even(100 * count(*) FILTER (WHERE answered AND is_correct)::DOUBLE / count(*), 2) AS accuracy, greatest(floor(epoch(s.submitted_at))::BIGINT - floor(epoch(s.started_at))::BIGINT, 0) AS seconds, count(*) FILTER (WHERE NOT answered) AS incomplete, CASE WHEN s.status = 'submitted' THEN count(*) FILTER (WHERE answered AND is_correct = false) ELSE 0 END AS wrong, s.status <> 'submitted' AND bool_and(answered) AS can_submit
  FROM sessions s JOIN answers a ON a.session_id = s.id GROUP BY s.id, s.user_id, s.status, s.submitted_at, s.started_at)"""
_TOP = """sw AS (SELECT *, bool_or(answered AND is_correct = false) OVER (PARTITION BY session_id) AS any_wrong FROM answers),
tc AS (SELECT session_id, point_id, count(*) AS n FROM sw JOIN question_points q ON q.question_id = sw.question_id WHERE is_correct = false OR NOT coalesce(any_wrong, false) GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, point_id) AS place FROM tc) WHERE place <= 3)"""


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.wrong_book(table(spark, sf_dir, "answers"))


def _mastery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.mastery(*tables(spark, sf_dir, "answers", "sessions", "question_points"))


def _due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.review_due(_book(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"))


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions, answers = tables(spark, sf_dir, "sessions", "answers")
    return X.session_summary(sessions, answers).join(sessions.select("id", "status"), "id")


_BANK = "bk AS (SELECT *, subject_id % 3 AS category_id, id * 10 + 1 AS first_source_question_id, id % 97 AS updated_at FROM bank_items WHERE status = 'active' AND node_role <> 'group')"


def _bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "bank_items").selectExpr("*", "subject_id % 3 AS category_id", "id * 10 + 1 AS first_source_question_id", "id % 97 AS updated_at")


@query("h1_candidates", f"WITH {_BANK} SELECT id, subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY updated_at DESC, id DESC) AS ord FROM bk WHERE category_id = 1")
def h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.candidates(_bank(spark, sf_dir), category_id=1)


@query("h1_paper", f"WITH {_BANK}, p AS (SELECT bank_question_id, min(sort_order) AS place FROM bank_links WHERE status = 'active' AND paper_id % 10 = 7 GROUP BY 1) SELECT id, subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY place, id) AS ord FROM bk JOIN p ON bank_question_id = id")
def h1_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "bank_links").where("status = 'active' AND paper_id % 10 = 7")
    return X.candidates(_bank(spark, sf_dir), paper=links)


@query("h1_chapter", f"WITH {_BANK} SELECT id, subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY updated_at DESC, id DESC) AS ord FROM bk WHERE first_source_question_id IN (SELECT question_id FROM question_tags t JOIN knowledge_points k ON k.id = t.point_id WHERE t.status IN ('confirmed', 'suggested') AND k.chapter_id = 2)")
def h1_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags, points = tables(spark, sf_dir, "question_tags", "knowledge_points")
    return X.candidates(_bank(spark, sf_dir), chapter=X.chapter_questions(tags, points, 2))


@query("h1_wrong_book", f"WITH {_BOOK}, {_BANK}, b AS (SELECT question_id, sum(wrong_count) AS wrong_count, max(last_wrong) AS last_wrong FROM book WHERE streak < 2 GROUP BY 1) SELECT id, subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY wrong_count DESC, last_wrong DESC, id) AS ord FROM bk JOIN b ON question_id = id")
def h1_wrong_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book of all users together, as one user's."""
    book = _book(spark, sf_dir).where(~F.col("mastered")).groupBy("question_id").agg(F.sum("wrong_count").alias("wrong_count"), F.max("last_wrong").alias("last_wrong"), F.lit(False).alias("mastered"))
    return X.candidates(_bank(spark, sf_dir), wrong_book=book)


@query("h2_sessions", f"""WITH {_BANK}, c AS (SELECT id, subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY updated_at DESC, id DESC) AS ord, count(*) OVER (PARTITION BY subject_id) AS n FROM bk),
r AS (SELECT DISTINCT user_id AS request_id, user_id % 5 AS subject_id, 10 + user_id % 60 AS want, CASE user_id % 4 WHEN 0 THEN 'paper' WHEN 1 THEN 'chapter' WHEN 2 THEN 'wrong_book' ELSE 'random' END AS kind FROM events WHERE event_type <> 'view'),
k AS (SELECT r.*, n, list_transform(range(1, 17), lambda i: ('0x' || substr(md5(request_id || ':1:' || i), 1, 12))::BIGINT % n) AS keys FROM r JOIN (SELECT DISTINCT subject_id, n FROM c) USING (subject_id)),
p AS (SELECT *, unnest(range(0, least(want, n))) AS place FROM k),
d AS (SELECT request_id, subject_id, place + 1 AS item_no, 1 + CASE WHEN kind IN ('random', 'chapter') THEN list_reduce(keys, lambda x, key: CASE WHEN substr(md5(key || ':' || greatest(x, (key - x + n) % n)), 1, 1) >= '8' THEN (key - x + n) % n ELSE x END, place) ELSE place END AS ord FROM p)
SELECT request_id, item_no, id AS question_id, 1 AS score FROM d JOIN c USING (subject_id, ord)""")
def h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("CASE user_id % 4 WHEN 0 THEN 'paper' WHEN 1 THEN 'chapter' WHEN 2 THEN 'wrong_book' ELSE 'random' END")
    requests = table(spark, sf_dir, "events").where("event_type <> 'view'").select(F.col("user_id").alias("request_id"), (F.col("user_id") % 5).alias("subject_id"), (10 + F.col("user_id") % 60).alias("n"), kind.alias("kind")).distinct()
    return X.assemble_sessions(X.candidates(_bank(spark, sf_dir)), requests)


@query("h3_snapshot", """WITH f AS (SELECT bank_question_id, arg_min(struct_pack(p := paper_id, q := sort_order), (CASE WHEN sort_order % 3 = 0 THEN 0 ELSE sort_order END, source_question_id)) AS s FROM bank_links WHERE status = 'active' GROUP BY 1),
g AS (SELECT question_id, string_agg(concat_ws(':', point_id, k.name, k.path, relation_type, t.status), ',' ORDER BY t.status, rank_no, tag_id) AS points FROM question_tags t JOIN knowledge_points k ON k.id = t.point_id WHERE t.status IN ('confirmed', 'suggested') GROUP BY 1),
m AS (SELECT bank_question_id, min(source_question_id) AS source FROM bank_links GROUP BY 1)
SELECT i.id, question_type, stem_text, difficulty, node_role, 'answer ' || i.id AS answer_text, CASE WHEN i.id % 3 > 0 THEN 'because ' || i.id END AS analysis_text, 'A. x;B. ' || i.id AS options, CASE WHEN s.p % 5 > 0 THEN 'paper ' || s.p END AS source_paper_name, 'No. ' || s.q AS source_question_no, points
FROM bank_items i LEFT JOIN f ON f.bank_question_id = i.id LEFT JOIN m ON m.bank_question_id = i.id LEFT JOIN g ON g.question_id = m.source WHERE node_role <> 'group'""")
def h3(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, links, tags, points, papers = tables(spark, sf_dir, "bank_items", "bank_links", "question_tags", "knowledge_points", "papers")
    source = links.groupBy(F.col("bank_question_id").alias("id")).agg(F.min("source_question_id").alias("first_source_question_id"))
    full = items.join(source, "id", "left").withColumns({"answer_text": F.expr("concat('answer ', id)"), "analysis_text": F.expr("CASE WHEN id % 3 > 0 THEN concat('because ', id) END"), "options": F.expr("array('A. x', concat('B. ', id))")})
    questions = links.select(F.col("source_question_id").alias("id"), F.expr("CASE WHEN sort_order % 3 > 0 THEN sort_order END AS sort_order"))
    named = papers.where("id % 5 > 0").select("id", F.expr("concat('paper ', id)").alias("paper_name"))
    found = X.question_snapshot(full, links.selectExpr("*", "source_question_id AS id", "concat('No. ', sort_order) AS question_no"), questions, named, tags, points)
    shown = F.array_join(F.transform("knowledge_points", lambda p: F.concat_ws(":", p["id"], p["name"], p["path"], p["relation_type"], p["status"])), ",")
    return found.select("id", "question_type", "stem_text", "difficulty", "node_role", "answer_text", "analysis_text", F.array_join("options", ";").alias("options"), "source_paper_name", "source_question_no", shown.alias("points"))


@query("h4_grade", """WITH a AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'multiple_choice' ELSE 'single' END AS t, CASE event_id % 7 WHEN 0 THEN ' b a ' WHEN 1 THEN '' WHEN 2 THEN 'ab' ELSE chr(65 + (event_id % 4)::INT) END AS actual,
  CASE WHEN event_id % 3 = 0 THEN 'AB' ELSE chr(65 + (user_id % 4)::INT) END AS expected FROM events), n AS (SELECT id, t, nullif(upper(regexp_replace(actual, '\\s+', '', 'g')), '') AS a, nullif(upper(expected), '') AS e FROM a)
SELECT id, CASE WHEN t = 'multiple_choice' THEN array_to_string(list_sort(list_distinct(regexp_extract_all(a, '[A-Z]'))), '') = e ELSE a = e END AS is_correct FROM n""")
def h4(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    actual = F.expr("CASE event_id % 7 WHEN 0 THEN ' b a ' WHEN 1 THEN '' WHEN 2 THEN 'ab' ELSE char(65 + event_id % 4) END")
    expected = F.expr("CASE WHEN event_id % 3 = 0 THEN 'AB' ELSE char(65 + user_id % 4) END")
    kind = F.expr("CASE WHEN event_id % 3 = 0 THEN 'multiple_choice' ELSE 'single' END")
    return e.select(F.col("event_id").alias("id"), X.grade(actual, expected, kind).alias("is_correct"))


@query("h5_session_summary", f"WITH {_SUM} SELECT id, user_id, items, answered, correct, wrong, accuracy, seconds, incomplete, can_submit FROM ss")
def h5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.session_summary(*tables(spark, sf_dir, "sessions", "answers"))


_REASONS = """re0 AS (SELECT session_id, unnest(CASE id % 4 WHEN 0 THEN ['careless', ' careless', 'noise'] WHEN 1 THEN ['concept_unclear', 'method_unfamiliar'] WHEN 2 THEN ['noise'] ELSE ['misread_question', 'concept_unclear', 'memory_unstable', 'calculation_error', 'careless'] END) AS reason, id FROM answers WHERE is_correct = false),
re1 AS (SELECT DISTINCT id, session_id, trim(reason) AS reason FROM re0 WHERE reason <> 'noise' AND NOT (id % 4 = 3 AND reason = 'careless')), re2 AS (SELECT session_id, reason, count(*) AS n FROM re1 GROUP BY ALL),
rc AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, reason) AS place FROM re2)"""


def _reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = F.expr("CASE id % 4 WHEN 0 THEN array('careless', ' careless', 'noise') WHEN 1 THEN array('concept_unclear', 'method_unfamiliar') WHEN 2 THEN array('noise') ELSE array('misread_question', 'concept_unclear', 'memory_unstable', 'calculation_error', 'careless') END")
    return X.reason_counts(table(spark, sf_dir, "answers").where("is_correct = false").withColumn("reasons", reasons))


@query("h6_reasons", f"WITH {_REASONS} SELECT * FROM rc")
def h6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reasons(spark, sf_dir)


@query("h6_mask_solutions", "SELECT a.id, CASE WHEN s.status = 'submitted' OR (a.user_id % 2 = 0 AND answered) THEN 'S' || question_id END AS solution FROM answers a JOIN sessions s ON s.id = a.session_id")
def h6_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, sessions = tables(spark, sf_dir, "answers", "sessions")
    rows = answers.withColumn("solution", F.concat(F.lit("S"), "question_id")).join(sessions.select(F.col("id").alias("session_id"), "status"), "session_id")
    return X.mask_solutions(rows, F.col("status") == "submitted", F.col("user_id") % 2 == 0, F.col("answered")).select("id", "solution")


@query("h7_wrong_book", f"WITH {_BOOK} SELECT user_id, question_id, wrong_count, streak, streak >= 2 AS mastered, last_wrong, last_practiced FROM book")
def h7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _book(spark, sf_dir)


@query("h8_mastery", f"WITH {_MASTERY} SELECT user_id, point_id, answered, correct, last_day, score FROM ma")
def h8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mastery(spark, sf_dir)


@query("h9_review_due", f"WITH {_DUE} SELECT * FROM due")
def h9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _due(spark, sf_dir)


@query("h10_weakest_points", f"WITH {_MASTERY} SELECT * FROM weak")
def h10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.weakest_points(_mastery(spark, sf_dir))


@query("h11_daily_plan", f"""WITH {_DUE}, {_MASTERY}, {_SUM}, re AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS r FROM ss),
la AS (SELECT user_id, max_by(accuracy, id) AS accuracy FROM re WHERE r <= 5 AND status = 'submitted' GROUP BY 1),
t AS (SELECT DISTINCT user_id, 'review' AS task, 'high' AS priority FROM due UNION ALL SELECT user_id, 'weak_point', CASE WHEN score < 60 THEN 'high' ELSE 'normal' END FROM weak WHERE place = 1 UNION ALL SELECT user_id, 'stabilise', 'normal' FROM la WHERE accuracy < 75)
SELECT * FROM t UNION ALL SELECT DISTINCT user_id, 'keep_going', 'low' FROM events WHERE user_id NOT IN (SELECT user_id FROM t)""")
def h11(spark: SparkSession, sf_dir: str) -> DataFrame:
    weak = X.weakest_points(_mastery(spark, sf_dir))
    return X.daily_plan(_due(spark, sf_dir), weak, _summaries(spark, sf_dir), table(spark, sf_dir, "events").select("user_id").distinct())


@query("h12_session_top_points", f"WITH {_TOP} SELECT session_id, point_id, n, place FROM top")
def h12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.session_top_points(*tables(spark, sf_dir, "answers", "question_points"))


@query("h13_similar_questions", f"""WITH {_TOP}, sh AS (SELECT DISTINCT t.point_id, l.bank_question_id, i.subject_id FROM bank_links l JOIN question_tags t ON t.question_id = l.source_question_id JOIN bank_items i ON i.id = l.bank_question_id
  WHERE l.status = 'active' AND t.status IN ('confirmed', 'suggested') AND i.status = 'active' AND i.node_role <> 'group'),
r AS (SELECT DISTINCT top.session_id, sh.bank_question_id AS question_id FROM top JOIN sh ON sh.point_id = top.point_id JOIN sessions s ON s.id = top.session_id AND (s.subject_id IS NULL OR s.subject_id = sh.subject_id) WHERE NOT EXISTS (SELECT 1 FROM answers a WHERE a.session_id = top.session_id AND a.question_id = sh.bank_question_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY question_id DESC) AS place FROM r) WHERE place <= 5""")
def h13(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, points, links, tags, items, sessions = tables(spark, sf_dir, "answers", "question_points", "bank_links", "question_tags", "bank_items", "sessions")
    return X.similar_questions(X.session_top_points(answers, points), tagging.item_points(links, tags), items, answers.select("session_id", "question_id").distinct(), sessions)


@query("h14_retry_wrong", "SELECT session_id, question_id, place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY submitted_at, id) AS place FROM answers WHERE answered AND is_correct = false) WHERE place <= 10")
def h14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.retry_wrong(table(spark, sf_dir, "answers"))


_TODO = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.REASONS.items())


@query("h15_suggestions", f"""WITH {_DUE}, {_MASTERY}, {_SUM}, {_REASONS}, n AS (SELECT user_id, count(*) AS n FROM due GROUP BY 1), h AS (SELECT ss.id, list_filter([CASE WHEN accuracy < 60 THEN 'rebuild the basics' WHEN accuracy < 80 THEN 'review the wrong answers' ELSE 'try harder questions' END,
  CASE rc.reason {_TODO} END, 'due: ' || n.n, 'weakest point: ' || w.point_id], lambda x: x IS NOT NULL) AS hints FROM ss LEFT JOIN n USING (user_id) LEFT JOIN weak w ON w.user_id = ss.user_id AND w.place = 1 LEFT JOIN rc ON rc.session_id = ss.id AND rc.place = 1)
SELECT id, (generate_subscripts(hints, 1) - 1)::INT AS place, unnest(hints) AS hint FROM h""")
def h15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.review_suggestions(_summaries(spark, sf_dir), _reasons(spark, sf_dir), _due(spark, sf_dir), X.weakest_points(_mastery(spark, sf_dir)))


@query("h16_recent_sessions", "SELECT id, user_id, status, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS place FROM sessions) WHERE place <= 50")
def h16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.newest(table(spark, sf_dir, "sessions"), "user_id", 50).select("id", "user_id", "status", "place")


@query("h16_wrong_book_list", f"WITH {_BOOK} SELECT * FROM (SELECT user_id, question_id, wrong_count, row_number() OVER (PARTITION BY user_id ORDER BY last_wrong DESC, question_id) AS place FROM book WHERE streak < 2) WHERE place <= 100")
def h16_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.wrong_book_list(_book(spark, sf_dir)).select("user_id", "question_id", "wrong_count", "place")
