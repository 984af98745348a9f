"""Queries of operational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ops as X
from .base import query, table, tables


_LIBRARY = "SELECT id, concat('file-', id, '.txt') AS filename, title, CASE WHEN id % 4 = 0 THEN 'license, old' WHEN id % 4 = 1 THEN concat('tag', id % 10) END AS tags, CASE WHEN id % 3 = 0 THEN 'law' ELSE 'math' END AS subject, file_type AS category, CASE WHEN id % 5 = 0 THEN 'textbook' ELSE 'note' END AS source_type, id % 50 AS created_at, id % 7 AS subject_id FROM files"


def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_LIBRARY.replace("FROM files", "FROM {files}"), files=table(spark, sf_dir, "files"))


@query("k1_search_library", f"WITH lb AS ({_LIBRARY}) SELECT id, title FROM lb WHERE subject = 'law' AND source_type = 'note' AND (contains(filename, 'src1') OR contains(lower(title), 'src1') OR contains(coalesce(tags, ''), 'src1'))")
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.search_library(_library(spark, sf_dir), "SRC1", subject="law", source_type="note").select("id", "title")


@query("k2_keep_latest", """SELECT id, topic_id, seq, back = 1 AS is_latest FROM (SELECT id, topic_id, row_number() OVER (PARTITION BY topic_id ORDER BY created_at, id) AS seq, row_number() OVER (PARTITION BY topic_id ORDER BY created_at DESC, id DESC) AS back FROM topic_events) WHERE back <= 2""")
def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.keep_latest(table(spark, sf_dir, "topic_events"), "topic_id", ["created_at", "id"]).select("id", "topic_id", "seq", "is_latest")


@query("k2_file_texts", """WITH r AS (SELECT topic_id AS file_id, row_number() OVER (PARTITION BY topic_id ORDER BY created_at, id) AS seq, props AS text, id AS tokens FROM topic_events), l AS (SELECT file_id, max_by({'t': text, 'k': tokens}, seq) AS r, max(seq) AS seq FROM r GROUP BY 1)
SELECT c_custkey AS id, CASE WHEN seq IS NULL THEN c_name ELSE r.t END AS text, coalesce(r.k, 1) AS tokens, seq FROM customer LEFT JOIN l ON file_id = c_custkey""")
def k2_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = X.keep_latest(table(spark, sf_dir, "topic_events").select(F.col("topic_id").alias("file_id"), "created_at", F.col("id").alias("tokens"), F.col("props").alias("text")), "file_id", ["created_at", "tokens"])
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"), F.lit(1).cast("long").alias("tokens"))
    return X.file_texts(files, results)


@query("k3_versions", "SELECT id, topic_id, status, row_number() OVER w AS version, topic_id || ':' || row_number() OVER w AS version_id FROM topic_events WINDOW w AS (PARTITION BY topic_id ORDER BY created_at, id)")
def k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.version_events(table(spark, sf_dir, "topic_events")).select("id", "topic_id", "status", "version", "version_id")


_STATE = "st AS (SELECT topic_id, max_by(status, (created_at, id)) AS status, max_by({'d': scheduled_date}, (created_at, id)).d AS scheduled_date, max(created_at) AS updated_at, count(*) AS versions FROM topic_events GROUP BY 1)"


@query("k3_latest_state", f"WITH {_STATE} SELECT * FROM st")
def k3_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.latest_state(table(spark, sf_dir, "topic_events"))


_TOPIC = "SELECT topic_id, status, scheduled_date, updated_at, versions, concat('owner', topic_id % 3) AS owner, concat('Topic ', topic_id) AS title, CASE WHEN topic_id % 4 = 0 THEN 'a Brief' END AS brief, CAST(NULL AS {string}) AS chapter, concat('goal ', versions) AS content_goal FROM {st}"


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_TOPIC.format(string="STRING", st="{st}"), st=X.latest_state(table(spark, sf_dir, "topic_events")))


@query("k4_list_topics", f"WITH {_STATE}, tp AS ({_TOPIC.format(string='VARCHAR', st='st')}) SELECT topic_id, status, scheduled_date, updated_at FROM tp WHERE scheduled_date >= DATE '2024-01-10' AND owner = 'owner1' AND (contains(lower(title), 'brief') OR contains(lower(coalesce(brief, '')), 'brief') OR contains(content_goal, 'brief'))")
def k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.list_topics(_topics(spark, sf_dir), F.lit("2024-01-10").cast("date"), owner="owner1", search="BRIEF").select("topic_id", "status", "scheduled_date", "updated_at")


@query("k4_board", f"WITH {_STATE}, b AS (SELECT unnest(['view', 'idea', 'click', 'error']) AS status, unnest([0, 1, 2, 3])::BIGINT AS place) SELECT place, b.status, count(topic_id) AS topics, count(scheduled_date) AS dated FROM b LEFT JOIN st ON st.status = b.status GROUP BY 1, 2")
def k4_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.board(_topics(spark, sf_dir), ("view", "idea", "click", "error"))


@query("k4_owners", f"WITH {_STATE} SELECT 'owner' || topic_id % 3 AS owner, count(*) AS topics FROM st GROUP BY 1")
def k4_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.owners(_topics(spark, sf_dir))


_JOBS = """SELECT (l_orderkey * 10 + l_linenumber) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS id, CASE WHEN l_suppkey % 9 = 0 THEN 'library_parse' WHEN l_suppkey % 9 = 1 THEN 'tagging' ELSE 'paper_parse' END AS job_type, CASE WHEN l_partkey % 8 = 0 THEN 'library' ELSE 'paper' END AS scope_type,
  CASE l_linenumber % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'completed' WHEN 3 THEN CASE WHEN l_partkey % 3 = 0 THEN 'running' ELSE 'failed' END ELSE CASE WHEN l_partkey % 5 = 0 THEN 'pending' ELSE 'cancelled' END END AS status,
  CASE l_suppkey % 7 WHEN 0 THEN concat('{"paper_id": "', l_orderkey, '"}') WHEN 1 THEN 'no json' WHEN 2 THEN '{"paper_id": "none"}' WHEN 3 THEN concat('{"paper_id": ', l_orderkey, ', "execution_mode": "ocr_only"}') WHEN 4 THEN '{}' ELSE concat('{"paper_id": ', l_orderkey, ', "execution_mode": ""}') END AS scope,
  CASE l_partkey % 4 WHEN 0 THEN '{"execution_mode": "ocr_only"}' WHEN 1 THEN '{"execution_mode": "full_chain"}' END AS summary FROM lineitem"""
_STATES = "SELECT id, asset_id, CASE id % 7 WHEN 0 THEN 'parsed' WHEN 1 THEN 'saving' WHEN 2 THEN 'draft' WHEN 3 THEN 'tagging' WHEN 4 THEN 'source_ready' WHEN 5 THEN 'parsing' END AS status FROM papers"
_ASSETS = "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'parsed' WHEN 1 THEN 'ocr_running' WHEN 2 THEN 'pending' WHEN 3 THEN 'source_ready' END AS parse_status, CASE c_custkey % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' ELSE 'pending' END AS ocr_status FROM customer"
# What a job's texts say, then the latest job of each paper, one after the other.
_RECONCILED = f"""jb AS ({_JOBS}), pp AS ({_STATES}), aa AS ({_ASSETS}), j1 AS (SELECT *, CASE WHEN json_valid(scope) THEN try_cast(scope->>'$.paper_id' AS BIGINT) END AS paper_id, status IN ('pending', 'running') AS broken,
  coalesce(nullif(summary->>'$.execution_mode', ''), CASE WHEN json_valid(scope) THEN nullif(scope->>'$.execution_mode', '') END, 'full_chain') = 'ocr_only' AS reads FROM jb WHERE job_type = 'paper_parse' AND scope_type = 'paper'),
j2 AS (SELECT paper_id, bool_or(broken) AS broken, arg_max(CASE WHEN broken THEN 'failed' ELSE status END, id) AS job, arg_max(reads, id) AS reads FROM j1 WHERE paper_id > 0 GROUP BY 1),
p1 AS (SELECT pp.id, asset_id, status AS old, CASE WHEN broken THEN 'parse_failed' ELSE status END AS was, job, reads, broken FROM pp LEFT JOIN j2 ON paper_id = pp.id),
p2 AS (SELECT *, CASE WHEN job = 'completed' THEN CASE WHEN was = 'parsed' OR NOT reads THEN 'parsed' ELSE 'source_ready' END WHEN job = 'failed' AND was IN ('saving', 'tagging', 'parsing') THEN 'parse_failed' ELSE was END AS status FROM p1),
a1 AS (SELECT aa.*, CASE WHEN EXISTS (SELECT 1 FROM p1 WHERE asset_id = aa.id AND broken) THEN 'failed' ELSE parse_status END AS pw, CASE WHEN EXISTS (SELECT 1 FROM p1 WHERE asset_id = aa.id AND broken) THEN 'failed' ELSE ocr_status END AS ow,
  EXISTS (SELECT 1 FROM p1 WHERE asset_id = aa.id AND job = 'completed' AND NOT reads) AS full_, EXISTS (SELECT 1 FROM p1 WHERE asset_id = aa.id AND job = 'completed' AND reads) AS read_, EXISTS (SELECT 1 FROM p1 WHERE asset_id = aa.id AND job = 'failed') AS fail_ FROM aa),
a2 AS (SELECT id, parse_status AS po, ocr_status AS oo, CASE WHEN full_ OR read_ AND pw IS NOT DISTINCT FROM 'parsed' THEN 'parsed' WHEN read_ THEN 'source_ready' WHEN fail_ AND pw = 'ocr_running' THEN 'failed' ELSE pw END AS parse_status, CASE WHEN full_ OR read_ THEN 'completed' WHEN fail_ AND ow = 'running' THEN 'failed' ELSE ow END AS ocr_status FROM a1)"""


def _reconciled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    made = [spark.sql(sql.replace(f"FROM {t}", f"FROM {{{t}}}"), **{t: table(spark, sf_dir, t)}) for sql, t in ((_JOBS.replace('{"', '{{"').replace('"}', '"}}').replace("'{}'", "'{{}}'"), "lineitem"), (_STATES, "papers"), (_ASSETS, "customer"))]
    return X.reconcile(*made)


@query("k5_reconcile", f"WITH {_RECONCILED} SELECT id, status, status IS DISTINCT FROM old AS changed FROM p2")
def k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir)[0]


@query("k5_assets", f"WITH {_RECONCILED} SELECT id, parse_status, ocr_status, parse_status IS DISTINCT FROM po OR ocr_status IS DISTINCT FROM oo AS changed FROM a2")
def k5_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir)[1]


@query("k5_interrupted", f"WITH jb AS ({_JOBS}) SELECT id, CASE WHEN x THEN 'failed' ELSE status END AS status, CASE WHEN x THEN 100 END AS progress, CASE WHEN x THEN 'service_restarted' END AS termination_reason FROM (SELECT *, job_type <> 'tagging' AND status IN ('pending', 'running') AS x FROM jb)")
def k5_interrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _JOBS.replace('{"', '{{"').replace('"}', '"}}').replace("'{}'", "'{{}}'").replace("FROM lineitem", "FROM {lineitem}")
    return X.fail_interrupted(spark.sql(sql, lineitem=table(spark, sf_dir, "lineitem"))).select("id", "status", "progress", "termination_reason")


@query("k6_orphans", """WITH e AS (SELECT id, CASE WHEN id % 3 = 0 THEN file_type END AS namespace, CASE WHEN id % 7 > 0 THEN sha256 END AS sha256 FROM files), n AS (SELECT DISTINCT file_type AS namespace FROM files WHERE file_type <> 'de'), h AS (SELECT DISTINCT sha256 FROM files WHERE id % 2 = 0)
SELECT CASE WHEN namespace IS NOT NULL THEN CASE WHEN namespace IN (SELECT namespace FROM n) THEN 'kept' ELSE 'orphan' END WHEN sha256 IS NOT NULL THEN CASE WHEN sha256 IN (SELECT sha256 FROM h) THEN 'kept' ELSE 'orphan' END ELSE 'unmarked' END AS state, count(*) AS n FROM e GROUP BY 1""")
def k6(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files").select("id", "file_type", "sha256")
    entries = files.select("id", F.when(F.col("id") % 3 == 0, F.col("file_type")).alias("namespace"), F.when(F.col("id") % 7 > 0, F.col("sha256")).alias("sha256"))
    return X.orphan_entries(entries, files.where("file_type <> 'de'").select(F.col("file_type").alias("namespace")), files.where("id % 2 = 0"))


@query("k7_removable_assets", """WITH g AS (SELECT DISTINCT asset_id FROM papers WHERE status = 'F' AND asset_id NOT IN (SELECT asset_id FROM papers WHERE status <> 'F')), a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 > 0 THEN md5((c_custkey // 3)::VARCHAR) END AS sha256 FROM customer)
SELECT asset_id, sha256 IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a o WHERE o.sha256 = a.sha256 AND o.id NOT IN (SELECT asset_id FROM g)) AS drop_cache FROM g LEFT JOIN a ON a.id = asset_id""")
def k7(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "papers")
    assets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 6 > 0, F.md5(F.expr("CAST(c_custkey div 3 AS STRING)"))).alias("sha256"))
    return X.removable_assets(papers, papers.where("status = 'F'").select("id"), assets)


@query("k8_audit_feed", """SELECT e.event_id AS id, e.event_type AS module, c.c_name AS user_name, CASE WHEN e.event_id % 2 = 0 THEN '***' END AS api_token, json_extract_string(props, '$.k') AS k FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id""")
def k8(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, users = tables(spark, sf_dir, "events", "customer")
    payload = F.map_concat(F.from_json("props", "map<string,string>"), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("api_token"), F.lit("s3"))).otherwise(F.create_map().cast("map<string,string>")))
    logs = events.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("module"), "user_id", payload.alias("payload"))
    found = X.audit_feed(logs, users.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name")))
    return found.select("id", "module", "user_name", F.try_element_at("payload", F.lit("api_token")).alias("api_token"), F.try_element_at("payload", F.lit("k")).alias("k"))


@query("k9_list_papers", "SELECT id, exam_year FROM papers WHERE status = 'O'")
def k9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.list_papers(table(spark, sf_dir, "papers"), "O").select("id", "exam_year")


@query("k9_list_textbooks", f"WITH lb AS ({_LIBRARY}) SELECT id, created_at FROM lb WHERE source_type = 'textbook' AND subject_id = 3")
def k9_textbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.list_textbooks(_library(spark, sf_dir), 3).select("id", "created_at")


@query("k9_list_generations", "SELECT id, created_at FROM topic_events WHERE status = 'error'")
def k9_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.list_generations(table(spark, sf_dir, "topic_events"), "error").select("id", "created_at")
