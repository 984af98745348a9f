"""Queries of knowledge tagging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tagging as X
from .base import query, table, tables

_WORDS = "regexp_extract_all(lower(text), '[a-zà-ÿ]+')"


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as knowledge points: first two words the name, the third an alias, the fourth a keyword."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]+"), 0)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), words.alias("w"))
    points = items.select(
        "id", F.array_join(F.slice("w", 1, 2), " ").alias("name"), F.slice("w", 3, 1).alias("aliases"), F.slice("w", 4, 1).alias("keywords"), F.lit(None).cast("long").alias("chapter_id"), F.lit("").alias("path"),
    )
    return X.term_table(points)


_E1 = f"""WITH w AS (SELECT item_id AS id, {_WORDS} AS w FROM benchmark),
t AS (SELECT id AS point_id, array_to_string(w[1:2], ' ') AS term, 80 AS score, 0 AS ord FROM w UNION ALL SELECT id, w[3], 65, 1000 FROM w WHERE len(w) >= 3 UNION ALL SELECT id, w[4], 55, 2000 FROM w WHERE len(w) >= 4),
m AS (SELECT d.doc_id AS id, point_id, score, term, ord FROM (SELECT doc_id, lower(text) AS low FROM documents) d JOIN (SELECT * FROM t WHERE length(term) >= 2) t ON contains(d.low, t.term)),
x AS (SELECT id, point_id, max(score)::INT AS score, arg_min(term, -score * 100000 + ord) AS reason FROM m GROUP BY ALL)"""


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.match_points(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body")), _terms(spark, sf_dir))


@query("e1_match_points", f"{_E1} SELECT id, point_id, score, reason FROM x")
def e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir)


@query("e1_match_points_by_pieces", f"{_E1} SELECT id, point_id, score, reason FROM x")
def e1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, in the way for more terms than an automaton takes."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return X.match_points(texts, _terms(spark, sf_dir), most=0)


_SCOPED = f"""WITH w AS (SELECT item_id AS id, {_WORDS} AS w FROM benchmark), v AS (SELECT id, w, id % 3 AS sub, id % 2 AS cat FROM w UNION ALL SELECT id + 1000, w, (id + 1) % 3, 1 - id % 2 FROM w WHERE id % 4 = 0),
t AS (SELECT id AS point_id, sub, cat, array_to_string(w[1:2], ' ') AS term, 80 AS score, 0 AS ord FROM v UNION ALL SELECT id, sub, cat, w[3], 65, 1000 FROM v WHERE len(w) >= 3 UNION ALL SELECT id, sub, cat, w[4], 55, 2000 FROM v WHERE len(w) >= 4),
m AS (SELECT d.doc_id AS id, point_id, score, term, ord FROM (SELECT doc_id, lower(text) AS low FROM documents) d JOIN (SELECT * FROM t WHERE length(term) >= 2) t ON sub = doc_id % 3 AND (doc_id % 4 = 3 OR cat = doc_id % 2) AND contains(d.low, t.term)),
x AS (SELECT id, point_id, max(score)::INT AS score, arg_min(term, -score * 100000 + ord) AS reason FROM m GROUP BY ALL)"""


def _scoped_matches(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    """Points of three subjects and two categories; every fourth one again in another subject, with the same terms."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]+"), 0)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), words.alias("w")).selectExpr("id", "w", "id % 3 AS subject_id", "id % 2 AS category_id")
    items = items.union(items.where("id % 4 = 0").selectExpr("id + 1000", "w", "(id + 1) % 3", "1 - id % 2"))
    points = items.select(
        "id", "subject_id", "category_id", F.array_join(F.slice("w", 1, 2), " ").alias("name"), F.slice("w", 3, 1).alias("aliases"), F.slice("w", 4, 1).alias("keywords"), F.lit(None).cast("long").alias("chapter_id"), F.lit("").alias("path"),
    )
    texts = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "text AS body", "doc_id % 3 AS subject_id", "CASE WHEN doc_id % 4 <> 3 THEN doc_id % 2 END AS category_id")
    return X.match_points(texts, X.term_table(points), most)


@query("e1_scoped", f"{_SCOPED} SELECT id, point_id, score, reason FROM x")
def e1_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scoped_matches(spark, sf_dir, X.AUTOMATON_TERMS)


@query("e1_scoped_by_pieces", f"{_SCOPED} SELECT id, point_id, score, reason FROM x")
def e1_scoped_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scoped_matches(spark, sf_dir, 0)


@query("e2_suggest_tags", f"""{_E1}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, point_id % 4, point_id) AS rank_no FROM x WHERE point_id % 7 <> 0)
SELECT id, point_id, rank_no::INT AS rank_no, CASE WHEN rank_no = 1 THEN 'primary' ELSE 'secondary' END AS relation_type, round_even(least(score::DOUBLE / 100, 1), 2) AS confidence FROM r WHERE rank_no <= 5""")
def e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _matches(spark, sf_dir)
    points = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), (F.col("item_id") % 4).alias("sort_order"))
    return X.suggest_tags(found, found.where("point_id % 7 = 0"), points)


_E3 = """t AS (SELECT *, CASE WHEN tag_id % 9 = 0 THEN 'AI model' ELSE 'rule' END AS source FROM question_tags), g AS (SELECT DISTINCT question_id, question_id // 10 AS paper_id, EXISTS (SELECT 1 FROM t WHERE t.question_id = q.question_id AND source = 'AI model') AS skipped FROM question_tags q WHERE question_id % 10 <> 7),
inc AS (SELECT question_id, point_id % 30 + 1 AS point_id, min((rank_no, confidence)) AS m FROM question_tags WHERE status <> 'confirmed' AND question_id % 10 <> 3 GROUP BY 1, 2),
v AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY m[1], point_id) AS r FROM inc WHERE point_id IN (SELECT id FROM knowledge_points) AND question_id IN (SELECT question_id FROM g WHERE NOT skipped)), n AS (SELECT * FROM v WHERE r <= 3)"""
_LIVE = "SELECT question_id, point_id, status, relation_type, source, rank_no, confidence"


def _external(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    tags = table(spark, sf_dir, "question_tags").withColumn("source", F.when(F.col("tag_id") % 9 == 0, "AI model").otherwise("rule"))
    questions = tags.select(F.col("question_id").alias("id"), F.expr("question_id div 10").alias("paper_id"), F.lit(None).cast("long").alias("parent_id"), F.when(F.col("question_id") % 10 == 7, "group").otherwise("standalone").alias("node_role")).distinct()
    incoming = tags.where("status <> 'confirmed' AND question_id % 10 <> 3").select("question_id", (F.col("point_id") % 30 + 1).alias("point_id"), F.col("rank_no").alias("ord"), "confidence")
    return tags, incoming, table(spark, sf_dir, "knowledge_points"), X.tag_targets(questions, tags)


@query("e3_merge_tags", f"""WITH {_E3} {_LIVE} FROM t WHERE status = 'confirmed' OR question_id NOT IN (SELECT question_id FROM n)
UNION ALL SELECT question_id, point_id, 'suggested', CASE WHEN r = 1 THEN 'primary' ELSE 'secondary' END, 'ai', r, least(greatest(m[2], 0), 1) FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.status = 'confirmed' AND t.question_id = n.question_id AND t.point_id = n.point_id)""")
def e3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.merge_external_tags(*_external(spark, sf_dir))


@query("e3_tag_counts", f"""WITH {_E3} SELECT paper_id, count(*) FILTER (WHERE NOT skipped) AS requested, count(*) FILTER (WHERE NOT skipped AND question_id IN (SELECT question_id FROM n)) AS updated,
  count(*) FILTER (WHERE NOT skipped AND question_id NOT IN (SELECT question_id FROM n)) AS failed, count(*) FILTER (WHERE skipped) AS skipped FROM g GROUP BY 1""")
def e3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.external_tag_counts(*_external(spark, sf_dir)[1:])


@query("e4_check_tags", """WITH live AS (SELECT * FROM question_tags WHERE status <> 'rejected')
SELECT DISTINCT * FROM (SELECT question_id, 'out_of_scope' AS violation FROM question_tags WHERE point_id NOT IN (SELECT id FROM knowledge_points WHERE id <> 25)
UNION ALL SELECT question_id, 'duplicate_point' FROM live GROUP BY question_id, point_id HAVING count(*) > 1
UNION ALL SELECT question_id, 'several_primaries' FROM live WHERE status = 'confirmed' AND relation_type = 'primary' GROUP BY question_id HAVING count(*) > 1
UNION ALL SELECT question_id, 'group_tagged' FROM live WHERE question_id IN (SELECT source_question_id FROM bank_links l JOIN bank_items i ON i.id = l.bank_question_id WHERE i.node_role = 'group'))""")
def e4(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags, points, links, items = tables(spark, sf_dir, "question_tags", "knowledge_points", "bank_links", "bank_items")
    groups = links.join(items.where("node_role = 'group'").select(F.col("id").alias("bank_question_id")), "bank_question_id", "left_semi").select(F.col("source_question_id").alias("question_id"))
    return X.check_tags(tags, points.where("id <> 25"), groups)


@query("e5_primary_tag", """SELECT question_id, coalesce(min(tag_id) FILTER (WHERE status = 'confirmed'), min(tag_id) FILTER (WHERE status = 'suggested')) AS tag_id
  FROM question_tags WHERE relation_type = 'primary' AND status IN ('confirmed', 'suggested') GROUP BY question_id""")
def e5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.primary_tag(table(spark, sf_dir, "question_tags")).select("question_id", "tag_id")


@query("e6_item_points", """WITH r AS (SELECT l.bank_question_id, t.point_id, CASE WHEN t.status = 'confirmed' THEN 0 ELSE 1 END AS s, t.rank_no, t.tag_id FROM bank_links l JOIN question_tags t ON t.question_id = l.source_question_id
  WHERE l.status = 'active' AND t.status IN ('confirmed', 'suggested')), o AS (SELECT bank_question_id, point_id, min((s, rank_no, tag_id)) AS o FROM r GROUP BY ALL)
SELECT bank_question_id, point_id, row_number() OVER (PARTITION BY bank_question_id ORDER BY o, point_id) AS place FROM o""")
def e6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.item_points(*tables(spark, sf_dir, "bank_links", "question_tags"))


@query("e6_group_points", """WITH r AS (SELECT l.bank_question_id, t.point_id, CASE WHEN t.status = 'confirmed' THEN 0 ELSE 1 END AS s, t.rank_no, t.tag_id FROM bank_links l JOIN question_tags t ON t.question_id = l.source_question_id
  WHERE l.status = 'active' AND t.status IN ('confirmed', 'suggested')), o AS (SELECT bank_question_id, point_id, min((s, rank_no, tag_id)) AS o FROM r GROUP BY ALL),
p AS (SELECT bank_question_id, point_id, row_number() OVER (PARTITION BY bank_question_id ORDER BY o, point_id) AS place FROM o),
c AS (SELECT id, parent_id, CASE WHEN id % 3 > 0 THEN 'No. ' || id % 40 ELSE '' END AS no FROM bank_items WHERE parent_id IS NOT NULL),
u AS (SELECT parent_id, point_id, min((coalesce(nullif(regexp_extract(no, '[0-9]+'), '')::BIGINT, 1000000000), coalesce(nullif(no, ''), id::VARCHAR), id, place)) AS o FROM p JOIN c ON c.id = p.bank_question_id GROUP BY ALL)
SELECT parent_id AS bank_question_id, point_id, row_number() OVER (PARTITION BY parent_id ORDER BY o, point_id) AS place FROM u""")
def e6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, tags, items = tables(spark, sf_dir, "bank_links", "question_tags", "bank_items")
    numbered = items.select("id", "parent_id", F.expr("CASE WHEN id % 3 > 0 THEN concat('No. ', id % 40) END").alias("question_no"))
    return X.group_points(X.item_points(links, tags), numbered)
