"""The query registry, and bindings of the driver's tables to canonical ones as SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

BINDINGS = {
    "papers": """SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INT) AS exam_year, o_orderstatus AS status, o_custkey AS asset_id, o_orderdate AS created_at,
        CASE WHEN o_orderpriority = '1-URGENT' THEN '真题' ELSE '模拟题' END AS paper_type FROM orders""",
    "bank_items": """SELECT p_partkey AS id, CAST(p_size % 5 AS BIGINT) AS subject_id, p_type AS question_type, p_name AS stem_text, p_brand AS category, CAST(p_size % 5 + 1 AS BIGINT) AS difficulty,
        CASE WHEN p_size % 10 = 0 THEN 'group' ELSE 'standalone' END AS node_role, CASE WHEN p_size % 17 = 0 THEN 'inactive' ELSE 'active' END AS status,
        CASE WHEN p_size % 10 = 1 THEN min(CASE WHEN p_size % 10 = 0 THEN p_partkey END) OVER (PARTITION BY p_brand) END AS parent_id FROM part""",
    "bank_links": """SELECT l_partkey AS bank_question_id, l_orderkey AS paper_id, l_orderkey * 10 + l_linenumber AS source_question_id, CAST(l_linenumber AS BIGINT) AS sort_order, l_shipdate AS created_at,
        CASE WHEN l_discount < 0.09 THEN 'active' ELSE 'removed' END AS status FROM lineitem""",
    "question_tags": """SELECT l_orderkey * 10 + l_linenumber AS question_id, l_partkey * 100000 + l_suppkey AS tag_id, CAST(substr(p_brand, 7) AS BIGINT) AS point_id, CAST(l_linenumber AS BIGINT) AS rank_no,
        CASE l_returnflag WHEN 'A' THEN 'confirmed' WHEN 'N' THEN 'suggested' ELSE 'rejected' END AS status, CASE l_linestatus WHEN 'F' THEN 'primary' ELSE 'secondary' END AS relation_type,
        l_discount * 10 AS confidence FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "knowledge_points": """SELECT n AS id, concat('Brand#', n) AS name, CAST((n - 1 - (n - 1) % 5) / 5 AS BIGINT) AS chapter_id, concat('CH', CAST((n - 1 - (n - 1) % 5) / 5 AS BIGINT), '/Brand#', n) AS path
        FROM (SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS n FROM part) b""",
    "answers": """SELECT event_id AS id, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS question_id, event_type <> 'view' AS answered,
        CASE event_type WHEN 'error' THEN false WHEN 'click' THEN true WHEN 'purchase' THEN true END AS is_correct, ts AS submitted_at, value AS spent_seconds,
        user_id * 100 + CAST(day(ts) AS BIGINT) AS session_id FROM events""",
    "sessions": """SELECT user_id * 100 + d AS id, user_id, CASE WHEN d % 10 = 0 THEN NULL ELSE d % 5 END AS subject_id, CASE WHEN d % 3 <> 0 THEN 'submitted' ELSE 'in_progress' END AS status,
        min(ts) AS started_at, max(ts) AS submitted_at FROM (SELECT user_id, ts, CAST(day(ts) AS BIGINT) AS d FROM events) e GROUP BY user_id, d""",
    "question_points": """SELECT DISTINCT k AS question_id, p AS point_id FROM (SELECT k, k % 25 AS p FROM (SELECT DISTINCT CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) a
        UNION ALL SELECT k, k % 7 AS p FROM (SELECT DISTINCT CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) b) u""",
    "files": """SELECT doc_id AS id, sha256(text) AS sha256, source AS title, lang AS file_type, n_chars AS size, text FROM documents""",
    "topic_events": """SELECT event_id AS id, user_id AS topic_id, event_type AS status, ts AS created_at, CASE WHEN event_id % 4 <> 0 THEN CAST(ts AS DATE) END AS scheduled_date, props FROM events""",
    "chapters": """SELECT r_regionkey + 1 AS id, CAST(NULL AS INT) AS parent_id, r_name AS name FROM region
        UNION ALL SELECT 100 + n_nationkey AS id, n_regionkey + 1 AS parent_id, n_name AS name FROM nation""",
}
_SPARK = {"sha256(text)": "sha2(text, 256)"}


def _tables(sql: str) -> list[str]:
    """Tables and bindings that a SQL text reads, in order."""
    return [t for t in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN) (\w+)", sql)) if t in BINDINGS or t in BASE]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver, or the canonical table that is bound to some."""
    if name not in BINDINGS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = BINDINGS[name]
    for duck, own in _SPARK.items():
        sql = sql.replace(duck, own)
    read = _tables(sql)
    for t in read:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in read})


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


def with_bindings(sql: str) -> str:
    """The SQL text, preceded by the bindings that it reads."""
    needed: dict[str, str] = {}

    def need(text: str) -> None:
        for t in _tables(text):
            if t in BINDINGS and t not in needed:
                need(BINDINGS[t])
                needed[t] = BINDINGS[t]

    need(sql)
    heads = ",\n".join(f"{t} AS ({q})" for t, q in needed.items())
    if not heads:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads},\n{body[14:]}"
    return f"WITH {heads},\n{body[4:]}" if body.upper().startswith("WITH") else f"WITH {heads}\n{body}"


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query, and its DuckDB SQL over bindings."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = with_bindings(sql)
        return f

    return add
