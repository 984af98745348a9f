"""Queries of the streaming forms: the table of events is read as a stream to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import shared_folder
from ..streaming import learning as L
from .base import query, table

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, with ``at`` as a time that watermarks accept (a pattern as path allows a single file)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parque[t]").withColumn("at", F.col("ts").cast("timestamp"))


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where("event_type <> 'view'")
    right = F.expr("CASE event_type WHEN 'error' THEN false WHEN 'click' THEN true WHEN 'purchase' THEN true END")
    return rows.select(F.col("event_id").alias("id"), "user_id", F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("question_id"), right.alias("is_correct"), "at")


#: Saves of answers arrive in three runs of the stream, some a run late, some two; what the watermark of the runs before has passed is dropped.
_LATE = "5 days"
_SAVES = """e AS (SELECT event_id // 2 AS id, event_id // 2 % 50 AS user_id, event_id // 2 % 100 AS question_id, CASE event_id % 5 WHEN 0 THEN ' b a ' WHEN 1 THEN '' ELSE chr(97 + (event_id % 3)::INT) END AS answer, ts,
  least(2, 3 * event_id // (SELECT max(event_id) + 1 FROM events) + CASE event_id % 10 WHEN 3 THEN 2 WHEN 7 THEN 1 ELSE 0 END) AS run FROM events), w AS (SELECT run + 1 AS run, max(max(ts)) OVER (ORDER BY run) - INTERVAL 5 DAY AS passed FROM e GROUP BY run),
l AS (SELECT id, any_value(user_id) AS user_id, any_value(question_id) AS q, max_by(answer, ts) AS answer FROM e LEFT JOIN w ON w.run = e.run WHERE passed IS NULL OR ts > date_trunc('millisecond', passed) GROUP BY 1),
n AS (SELECT *, nullif(upper(regexp_replace(answer, '\\s+', '', 'g')), '') AS c, CASE WHEN q % 2 = 0 THEN 'AB' ELSE 'A' END AS e FROM l), g AS (SELECT id, user_id, q AS question_id, CASE WHEN q % 2 = 0 THEN array_to_string(list_sort(list_distinct(regexp_extract_all(c, '[A-Z]'))), '') = e ELSE c = e END AS is_correct FROM n)"""
_SAVE = "id long, user_id long, question_id long, answer string, at timestamp"


def _changes(spark: SparkSession, sf_dir: str) -> str:
    """The folder in whose ``out`` the changes of all runs are."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows, top = table(spark, sf_dir, "events"), shared_folder(spark, "stream")
    n = rows.agg(F.max("event_id")).first()[0] + 1
    answer = F.expr("CASE event_id % 5 WHEN 0 THEN ' b a ' WHEN 1 THEN '' ELSE char(97 + event_id % 3) END")
    run = F.expr(f"least(2, 3 * event_id div {n} + CASE event_id % 10 WHEN 3 THEN 2 WHEN 7 THEN 1 ELSE 0 END)")
    saves = rows.select(F.expr("event_id div 2").alias("id"), F.expr("event_id div 2 % 50").alias("user_id"), F.expr("event_id div 2 % 100").alias("question_id"), answer.alias("answer"), F.col("ts").cast("timestamp").alias("at"), run.alias("run"))
    expected = spark.range(100).selectExpr("id AS question_id", "CASE WHEN id % 2 = 0 THEN 'AB' ELSE 'A' END AS expected", "CASE WHEN id % 2 = 0 THEN 'multiple_choice' ELSE 'single' END AS question_type")
    for k in range(3):
        saves.where(F.col("run") == k).drop("run").write.mode("append").parquet(f"{top}/saves")
        L.run_to_end(L.graded_stream(spark.readStream.schema(_SAVE).parquet(f"{top}/saves"), expected, _LATE, "60 days"), top)
    return top


@query("l1_graded_stream", f"WITH {_SAVES} SELECT id, question_id, is_correct FROM g")
def l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = spark.read.schema(L.CHANGE).parquet(f"{_changes(spark, sf_dir)}/out")
    return changes.groupBy("id").agg(F.max_by(F.struct("question_id", "is_correct"), "at").alias("s")).select("id", "s.*")


@query("l2_wrong_book_of_saves", f"""WITH {_SAVES}, t AS (SELECT g.*, (SELECT max(ts) FROM e LEFT JOIN w ON w.run = e.run WHERE e.id = g.id AND (passed IS NULL OR ts > date_trunc('millisecond', passed))) AS saved FROM g),
x AS (SELECT *, sum(CASE WHEN is_correct THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, question_id ORDER BY saved, id) AS w FROM t), k AS (SELECT user_id, question_id, max(w)::BIGINT AS wrong_count FROM x GROUP BY ALL),
s AS (SELECT k.*, (SELECT count(*) FROM x WHERE x.user_id = k.user_id AND x.question_id = k.question_id AND k.wrong_count > 0 AND x.w = k.wrong_count AND x.is_correct) AS streak FROM k) SELECT *, wrong_count > 0 AND streak >= 2 AS mastered FROM s""")
def l2_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saves become changes, and the changes a wrong book in a keyed table."""
    top = _changes(spark, sf_dir)
    book = L.wrong_book_table(spark, f"{top}/book")
    L.run_to_end(L.wrong_book_stream(spark.readStream.schema(L.CHANGE).parquet(f"{top}/out"), "60 days", "60 days"), f"{top}/book", book.merge, "update")
    return book.current()


@query("l3_mastery_of_saves", f"WITH {_SAVES} SELECT user_id, point_id, count(*) AS answered, count(*) FILTER (WHERE is_correct) AS correct FROM g JOIN question_points q ON q.question_id = g.question_id GROUP BY 1, 2")
def l3_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saves become changes, and the changes counters in a keyed table: a save that another overwrites counts once."""
    top = _changes(spark, sf_dir)
    counters = L.mastery_table(spark, f"{top}/points")
    L.mastery_stream(spark.readStream.schema(L.CHANGE).parquet(f"{top}/out"), table(spark, sf_dir, "question_points"), counters, f"{top}/points")
    return counters.current()


@query("l2_wrong_book_stream", """WITH w AS (SELECT *, sum(CASE WHEN is_correct THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, question_id ORDER BY submitted_at, id) AS w FROM answers WHERE answered),
k AS (SELECT user_id, question_id, max(w)::BIGINT AS wrong_count FROM w WHERE w > 0 GROUP BY ALL), s AS (SELECT k.*, (SELECT count(*) FROM w WHERE w.user_id = k.user_id AND w.question_id = k.question_id AND w.w = k.wrong_count AND w.is_correct) AS streak FROM k)
SELECT *, streak >= 2 AS mastered FROM s""")
def l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.latest(L.finished(L.wrong_book_stream(_graded(spark, sf_dir), "60 days"), "update"), ["user_id", "question_id"])
    return found.where("wrong_count > 0")


@query("l3_mastery_stream", "SELECT user_id, point_id, count(*) AS answered, count(*) FILTER (WHERE is_correct) AS correct FROM answers a JOIN question_points q ON q.question_id = a.question_id WHERE answered GROUP BY 1, 2")
def l3(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "question_points")
    folder = shared_folder(spark, "stream")
    counters = L.mastery_table(spark, f"{folder}/table")
    L.mastery_stream(_graded(spark, sf_dir), points, counters, folder)
    return counters.current()


@query("l4_activity_windows", "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def l4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.latest(L.finished(L.activity_windows(events(spark, sf_dir)), "update"), ["start", "event_type"])
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("l4_activity_sessions", """WITH p AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE AS gap FROM events), s AS (SELECT *, sum(coalesce(gap, true)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM p),
g AS (SELECT user_id, min(ts) AS start, count(*) AS n, max(ts) AS last FROM s GROUP BY user_id, s) SELECT user_id, start, n FROM g WHERE last + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def l4_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.finished(L.activity_sessions(events(spark, sf_dir)))
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("l5_version_stream", "SELECT topic_id, id, row_number() OVER (PARTITION BY topic_id ORDER BY created_at, id) AS version FROM topic_events")
def l5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.col("user_id").alias("topic_id"), F.col("event_id").alias("id"), "at")
    return L.version_stream(rows).select("topic_id", "id", "version")
