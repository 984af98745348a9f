"""Queries of the question bank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bank as X
from .base import query, table, tables

_QUESTIONS = """q AS (SELECT id, parent_id, node_role, CASE WHEN id % 3 = 0 THEN 'pending' ELSE 'approved' END AS status, CASE WHEN id % 11 = 0 THEN ' ' ELSE stem_text END AS stem_text, CASE WHEN id % 2 = 0 THEN 'm' END AS material_text, CASE id % 3 WHEN 0 THEN 'g' WHEN 1 THEN '  ' END AS group_stem,
  CASE WHEN id % 5 = 0 THEN NULL ELSE 'A' END AS answer_text, CASE WHEN id % 7 = 0 THEN '' ELSE 'x' END AS analysis_text, question_type, 'No. ' || (id % 40) AS question_no FROM bank_items)"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "bank_items").selectExpr(
        "id", "parent_id", "node_role", "CASE WHEN id % 3 = 0 THEN 'pending' ELSE 'approved' END AS status", "CASE WHEN id % 11 = 0 THEN ' ' ELSE stem_text END AS stem_text",
        "CASE WHEN id % 2 = 0 THEN 'm' END AS material_text", "CASE id % 3 WHEN 0 THEN 'g' WHEN 1 THEN '  ' END AS group_stem", "CASE WHEN id % 5 = 0 THEN NULL ELSE 'A' END AS answer_text", "CASE WHEN id % 7 = 0 THEN '' ELSE 'x' END AS analysis_text",
        "question_type", "concat('No. ', id % 40) AS question_no",
    )


@query("f1_bank_ready", f"""WITH {_QUESTIONS}, o AS (SELECT *, list_filter([CASE WHEN trim(stem_text) = '' THEN 'stem_text' END, CASE WHEN trim(coalesce(answer_text, '')) = '' THEN 'answer_text' END, CASE WHEN trim(analysis_text) = '' THEN 'analysis_text' END], lambda x: x IS NOT NULL) AS lacks FROM q),
c AS (SELECT parent_id, count(*) AS n, bool_and(status = 'approved' AND len(lacks) = 0) AS ok FROM o WHERE parent_id IS NOT NULL GROUP BY 1),
m AS (SELECT o.id, list_filter(list_concat([CASE WHEN status <> 'approved' THEN 'approved' END], CASE WHEN node_role = 'group' THEN [CASE WHEN coalesce(trim(group_stem), '') = '' AND material_text IS NULL THEN 'group_stem' END, CASE WHEN n IS NULL THEN 'children' END, CASE WHEN NOT ok THEN 'children_ready' END] ELSE lacks END), lambda x: x IS NOT NULL) AS missing
  FROM o LEFT JOIN c ON c.parent_id = o.id WHERE o.parent_id IS NULL)
SELECT id, len(missing) = 0 AS ready, array_to_string(missing, ',') AS missing FROM m""")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.bank_ready(_questions(spark, sf_dir))


_FULL = """SELECT id, parent_id, CASE WHEN id % 3 > 0 THEN concat('No. ', id % 40) END AS question_no, CASE WHEN id % 9 > 0 THEN node_role END AS node_role, question_type, status, subject_id, CAST(subject_id % 3 AS BIGINT) AS category_id, concat('QB', id) AS question_uid,
  CASE WHEN node_role = 'group' AND id % 4 > 0 THEN concat('all of ', category) END AS group_stem, CASE WHEN node_role = 'group' AND id % 3 = 0 THEN concat('table  ', id) END AS material_text, CASE WHEN id % 6 > 0 THEN stem_text END AS stem_text,
  CASE WHEN id % 2 = 0 THEN {list}(concat('A. ', question_type), concat('B) ', category), concat('a、', lower(question_type)), ' ') END AS options, CASE WHEN id % 5 > 0 THEN ' A' END AS answer_text, CASE WHEN id % 7 > 0 THEN 'x' ELSE ' ' END AS analysis_text,
  id * 10 + 1 AS first_source_question_id, id % 97 AS updated_at FROM bank_items"""
_ITEMS = f"it AS ({_FULL.format(list='list_value')})"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_FULL.format(list="array").replace("FROM bank_items", "FROM {items}"), items=table(spark, sf_dir, "bank_items"))


def _match(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '\\s+', ' ', 'g'))"


_OPTIONS = "CASE WHEN options IS NULL THEN [] ELSE [question_type, category] END"
_CHILD_KEY = "coalesce(nullif(regexp_extract(coalesce({no}, ''), '[0-9]+'), '')::BIGINT, 1000000000), coalesce(nullif({no}, ''), {id}::VARCHAR), {id}"


@query("f2_fingerprint", f"""WITH {_ITEMS}, n AS (SELECT it.*, coalesce(it.node_role, 'standalone') AS role, list_transform({_OPTIONS.replace('options', 'it.options').replace('question_type', 'it.question_type')}, lambda x: {_match('x')}) AS o, list_transform(coalesce(it.options, []), lambda x: {_match('x')}) AS l FROM it JOIN bank_items b ON b.id = it.id),
s AS (SELECT *, concat_ws('|', role, {_match('question_type')}, {_match('group_stem')}, {_match('material_text')}, {_match('stem_text')}) AS h, {_match('answer_text')} AS a, concat_ws('|', {_match('question_no')}, {_match('question_type')}, {_match('stem_text')}) AS c FROM n),
k AS (SELECT parent_id, string_agg(c || '|' || array_to_string(o, '||') || '|' || a, '|' ORDER BY {_CHILD_KEY.format(no='question_no', id='id')}) AS k1, string_agg(c || '|' || array_to_string(l, '||') || '|' || a, '|' ORDER BY {_CHILD_KEY.format(no='question_no', id='id')}) AS k2 FROM s WHERE parent_id IS NOT NULL GROUP BY 1),
f AS (SELECT s.id, sha1(concat_ws('|', h, array_to_string(o, '||'), a, k1)) AS fingerprint, sha1(concat_ws('|', h, array_to_string(l, '||'), a, k2)) AS legacy FROM s LEFT JOIN k ON k.parent_id = s.id)
SELECT id, fingerprint, 'QB' || substr(fingerprint, 1, 24) AS uid, legacy FROM f""")
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.bank_fingerprint(_items(spark, sf_dir))


def _merge(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "bank_links").join(table(spark, sf_dir, "bank_items").select(F.col("id").alias("bank_question_id"), "stem_text", "subject_id"), "bank_question_id")
    rows = rows.select(
        F.md5("stem_text").alias("fingerprint"), F.md5(F.concat(F.lit("old "), "stem_text")).alias("legacy"), (F.col("source_question_id") % 2).cast("string").alias("source_type"), "source_question_id", F.when(F.col("source_question_id") % 4 > 0, F.col("subject_id")).alias("subject_id"),
        F.when(F.col("source_question_id") % 5 == 1, F.col("subject_id") + 10).alias("category_id"), "stem_text", F.struct("created_at", "paper_id", "bank_question_id").alias("ord"), "paper_id", F.expr("CASE WHEN source_question_id % 4 <> 1 THEN concat('No. ', source_question_id) END AS question_no"),
        F.expr("CASE source_question_id % 3 WHEN 0 THEN 'judge' WHEN 1 THEN 'single_choice' END AS question_type"), F.expr("CASE WHEN source_question_id % 5 > 1 THEN 'group' END AS node_role"), F.expr("array('A. x', concat('b、', source_question_id), ' X ', '无') AS options"), F.expr("CASE WHEN source_question_id % 7 > 0 THEN concat('because ', source_question_id) END AS analysis_text"),
    )
    old = rows.where("source_question_id % 3 = 0").withColumn("fingerprint", F.when(F.length("stem_text") % 2 == 0, F.col("legacy")).otherwise(F.col("fingerprint")))
    items = old.groupBy("fingerprint").agg(F.max_by(F.struct("subject_id", "category_id", "stem_text", F.lit("old").alias("node_role"), "question_type", "options", "analysis_text", F.lit(-1).cast("long").alias("first_source_question_id")), "ord").alias("n"))
    links = old.groupBy("source_type", "source_question_id").agg(F.max_by(F.struct("fingerprint", "paper_id"), "ord").alias("l")).select("source_type", "source_question_id", "l.*", F.when(F.col("source_question_id") % 11 == 0, "removed").otherwise("active").alias("status"))
    return X.bank_merge(items.select("fingerprint", "n.*"), links, rows.where("source_question_id % 3 <> 0 OR source_question_id % 7 = 0"))


_MERGE = """r AS (SELECT md5(stem_text) AS own, md5('old ' || stem_text) AS legacy, (source_question_id % 2)::VARCHAR AS source_type, source_question_id, CASE WHEN source_question_id % 4 > 0 THEN subject_id END AS subject_id, CASE WHEN source_question_id % 5 = 1 THEN subject_id + 10 END AS category_id, stem_text, (created_at, paper_id, bank_question_id) AS ord, paper_id, CASE WHEN source_question_id % 4 <> 1 THEN 'No. ' || source_question_id END AS qno,
  CASE source_question_id % 3 WHEN 0 THEN 'judge' WHEN 1 THEN 'single_choice' END AS qt, CASE WHEN source_question_id % 5 > 1 THEN 'group' END AS nr, CASE WHEN source_question_id % 7 > 0 THEN 'because ' || source_question_id END AS an FROM bank_links l JOIN bank_items i ON i.id = l.bank_question_id),
od AS (SELECT *, CASE WHEN length(stem_text) % 2 = 0 THEN legacy ELSE own END AS fingerprint FROM r WHERE source_question_id % 3 = 0), o AS (SELECT fingerprint, max_by({'s': subject_id, 'c': category_id, 't': stem_text, 'nr': 'old', 'qt': qt, 'op': 'A. x|b、' || source_question_id || '| X |无', 'an': an, 'f': -1::BIGINT}, ord) AS n FROM od GROUP BY 1),
ol AS (SELECT source_type, source_question_id, max_by(fingerprint, ord) AS fingerprint, max_by(paper_id, ord) AS paper_id, NULL AS question_no, CASE WHEN source_question_id % 11 = 0 THEN 'removed' ELSE 'active' END AS status FROM od GROUP BY 1, 2),
i AS (SELECT *, CASE WHEN own NOT IN (SELECT fingerprint FROM o) AND legacy IN (SELECT fingerprint FROM o) THEN legacy ELSE own END AS fingerprint FROM r WHERE source_question_id % 3 <> 0 OR source_question_id % 7 = 0),
il AS (SELECT fingerprint, max_by({'t': stem_text, 'nr': coalesce(nr, 'standalone'), 'qt': qt, 'op': CASE WHEN qt = 'judge' THEN '正确|错误' ELSE 'x|' || source_question_id END, 'an': an, 'f': source_question_id}, ord) AS n, arg_min(subject_id, ord) FILTER (WHERE subject_id IS NOT NULL) AS s, arg_min(category_id, ord) FILTER (WHERE category_id IS NOT NULL) AS c FROM i GROUP BY 1), mv AS (SELECT source_type, source_question_id, max_by(fingerprint, ord) AS fingerprint, max_by(paper_id, ord) AS paper_id, max_by({'q': qno}, ord).q AS question_no, 'active' AS status FROM i GROUP BY 1, 2),
al AS (SELECT * FROM ol WHERE NOT EXISTS (SELECT 1 FROM mv WHERE mv.source_type = ol.source_type AND mv.source_question_id = ol.source_question_id) UNION ALL SELECT * FROM mv)"""


@query("f3_merge_items", f"""WITH {_MERGE}, b AS (SELECT coalesce(o.fingerprint, il.fingerprint) AS fingerprint, coalesce(o.n.s, il.s) AS subject_id, coalesce(o.n.c, il.c) AS category_id, o.fingerprint IS NULL AS created,
  CASE WHEN il.fingerprint IS NOT NULL THEN il.n ELSE {{'t': o.n.t, 'nr': o.n.nr, 'qt': o.n.qt, 'op': o.n.op, 'an': o.n.an, 'f': o.n.f}} END AS n FROM o FULL JOIN il ON o.fingerprint = il.fingerprint)
SELECT fingerprint, subject_id, category_id, created, n.t AS stem_text, n.nr AS node_role, n.qt AS question_type, n.op AS options, n.an AS analysis_text, n.f AS first_source_question_id, (SELECT count(*) FROM al WHERE al.status = 'active' AND al.fingerprint = b.fingerprint) AS source_count FROM b""")
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merge(spark, sf_dir)[0].withColumn("options", F.array_join("options", "|"))


@query("f3_merge_links", f"WITH {_MERGE} SELECT * FROM al")
def f3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merge(spark, sf_dir)[1]


_FOUND = "(contains(lower(coalesce(stem_text, '')), 'red') OR contains(lower(coalesce(group_stem, '')), 'red') OR contains(lower(coalesce(material_text, '')), 'red') OR contains(lower(coalesce(answer_text, '')), 'red') OR contains(lower(coalesce(analysis_text, '')), 'red'))"


@query("f4_search", f"""WITH {_ITEMS}, h AS (SELECT *, {_FOUND} AS hit, contains(lower(coalesce(stem_text, '')), 'red') AS child_hit FROM it), f AS (SELECT * FROM h WHERE parent_id IS NULL AND status = 'active' AND category_id = 1 AND (hit OR id IN (SELECT parent_id FROM h WHERE child_hit AND parent_id IS NOT NULL)))
SELECT id, updated_at, (SELECT min(paper_id) FROM bank_links l WHERE l.source_question_id = f.first_source_question_id) AS paper_id, (SELECT count(*) FROM f) AS total FROM f ORDER BY updated_at DESC, id DESC LIMIT 50 OFFSET 2""")
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = table(spark, sf_dir, "bank_links").select("source_question_id", "paper_id")
    return X.search_bank(_items(spark, sf_dir), reviews, 50, 2, keyword="RED", status="active", category_id=1)


@query("f5_status_counts", "SELECT status, count(*) AS n FROM bank_items WHERE parent_id IS NULL GROUP BY 1")
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.status_counts(table(spark, sf_dir, "bank_items"))


@query("f6_item_sources", """SELECT coalesce(i.parent_id, i.id) AS root, l.bank_question_id, l.paper_id, p.exam_year, l.source_question_id,
  row_number() OVER (PARTITION BY coalesce(i.parent_id, i.id) ORDER BY l.created_at, l.source_question_id, l.bank_question_id, l.paper_id) AS place FROM bank_links l JOIN bank_items i ON i.id = l.bank_question_id LEFT JOIN papers p ON p.id = l.paper_id WHERE l.status = 'active'""")
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.item_sources(*tables(spark, sf_dir, "bank_items", "bank_links", "papers"))


@query("f7_export_papers", """SELECT l.paper_id, coalesce(p.exam_year, 0)::INT AS exam_year, count(DISTINCT bank_question_id) AS items FROM bank_links l JOIN bank_items i ON i.id = l.bank_question_id JOIN papers p ON p.id = l.paper_id
  WHERE l.status = 'active' AND i.parent_id IS NULL AND i.status = 'active' GROUP BY ALL""")
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.export_papers(*tables(spark, sf_dir, "bank_items", "bank_links", "papers"))


_REVIEWS = """SELECT source_question_id, concat('R', min(sort_order)) AS review_no, 'judge' AS review_type, CASE source_question_id % 3 WHEN 0 THEN '单选题' WHEN 1 THEN 'other' END AS section_name, min(sort_order) AS sort_order, 'review  stem' AS review_stem, 'review group' AS review_group_stem,
  CAST(NULL AS {string}) AS review_material, {list}('(a) yes', 'no') AS review_options, CASE WHEN source_question_id % 5 > 0 THEN 'B' END AS review_answer, CAST(NULL AS {string}) AS review_analysis, CASE WHEN source_question_id % 2 = 0 THEN concat('stem', {nl}, 'A. x', {nl}, 'y') END AS source_raw_text FROM bank_links WHERE source_question_id % 4 > 0 GROUP BY source_question_id"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "bank_links").withColumn("question_no", F.when(F.col("source_question_id") % 7 == 0, F.concat(F.lit(" L"), "sort_order"))).drop("sort_order")
    reviews = spark.sql(_REVIEWS.format(string="STRING", list="array", nl="char(10)").replace("FROM bank_links", "FROM {links}"), links=table(spark, sf_dir, "bank_links"))
    return X.export_records(_items(spark, sf_dir), links, reviews)


_RECORDS = f"""{_ITEMS}, v AS ({_REVIEWS.format(string='VARCHAR', list='list_value', nl='chr(10)')}), lk AS (SELECT * EXCLUDE (sort_order), CASE WHEN source_question_id % 7 = 0 THEN 'L' || sort_order END AS question_no FROM bank_links),
fx AS (SELECT it.*, CASE WHEN it.options IS NULL THEN ['A. (a) yes', 'B. no'] ELSE ['A. ' || it.question_type, 'B. ' || b.category] END AS opts FROM it JOIN bank_items b ON b.id = it.id),
ol AS (SELECT bank_question_id, arg_min({{'q': source_question_id, 'n': question_no}}, (created_at, source_question_id)) AS l FROM lk GROUP BY 1),
ch AS (SELECT parent_id, list({{'no': coalesce(ol.l.n, v.review_no, question_uid), 'stem': coalesce(stem_text, CASE WHEN v.source_question_id IS NOT NULL THEN 'review stem' END, ''), 'options': CASE WHEN fx.options IS NULL AND v.source_question_id IS NULL THEN [] ELSE opts END, 'answer': coalesce(trim(answer_text), review_answer), 'analysis': nullif(trim(analysis_text), '')}}
  ORDER BY {_CHILD_KEY.format(no='v.review_no', id='fx.id')}) AS children FROM fx LEFT JOIN ol ON ol.bank_question_id = fx.id LEFT JOIN v ON v.source_question_id = ol.l.q WHERE parent_id IS NOT NULL GROUP BY 1),
r0 AS (SELECT lk.paper_id, row_number() OVER (PARTITION BY lk.paper_id ORDER BY v.sort_order, lk.source_question_id, lk.bank_question_id) AS place, lk.bank_question_id, coalesce(lk.question_no, v.review_no) AS no, fx.question_type AS type, coalesce(section_name, '未分区') AS section, coalesce(node_role = 'group', false) OR children IS NOT NULL AS g,
  coalesce(group_stem, review_group_stem) AS gs, regexp_replace(coalesce(material_text, ''), ' +', ' ', 'g') AS mt, coalesce(stem_text, 'review stem') AS fs, CASE WHEN source_raw_text IS NOT NULL THEN 'stem' ELSE 'review stem' END AS src, opts, coalesce(trim(answer_text), review_answer) AS ans, nullif(trim(analysis_text), '') AS ana, children
  FROM lk JOIN fx ON fx.id = lk.bank_question_id JOIN v ON v.source_question_id = lk.source_question_id LEFT JOIN ch ON ch.parent_id = fx.id WHERE lk.status = 'active' AND fx.parent_id IS NULL),
r1 AS (SELECT *, ends_with(fs, src) AND fs <> src AND trim(substr(fs, 1, length(fs) - length(src))) <> '' AS cut FROM r0),
rec AS (SELECT paper_id, place, bank_question_id, no, type, section, g AS is_group, CASE WHEN g THEN gs WHEN cut THEN trim(substr(fs, 1, length(fs) - length(src))) ELSE '' END AS shared_stem, CASE WHEN g THEN mt ELSE '' END AS material, CASE WHEN g THEN '' WHEN cut THEN src ELSE fs END AS stem,
  CASE WHEN g THEN [] ELSE opts END AS options, CASE WHEN NOT g THEN ans END AS answer, CASE WHEN NOT g THEN ana END AS analysis, CASE WHEN g THEN children END AS children FROM r1)"""


@query("f8_export_records", f"WITH {_RECORDS} SELECT * REPLACE (array_to_string(options, '|') AS options, array_to_string(list_transform(children, lambda c: c.no || c.stem || array_to_string(c.options, '') || coalesce(c.answer, '') || coalesce(c.analysis, '')), '|') AS children) FROM rec")
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = F.transform("children", lambda c: F.concat(c["no"], c["stem"], F.array_join(c["options"], ""), F.coalesce(c["answer"], F.lit("")), F.coalesce(c["analysis"], F.lit(""))))
    return _records(spark, sf_dir).withColumn("options", F.array_join("options", "|")).withColumn("children", F.array_join(children, "|"))


@query("f9_shared_stem", """WITH r AS (SELECT id, trim(question_type || ' ' || stem_text) AS stem, CASE WHEN id % 2 = 0 THEN stem_text ELSE 'other' END AS own FROM bank_items)
SELECT id, CASE WHEN ends_with(stem, own) THEN trim(substr(stem, 1, length(stem) - length(own))) END AS shared_stem, CASE WHEN ends_with(stem, own) THEN own ELSE stem END AS own_stem FROM r""")
def f9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "bank_items").selectExpr("id", "concat(question_type, ' ', stem_text) AS stem_text", "concat(CASE WHEN id % 2 = 0 THEN stem_text ELSE 'other' END, '\\n a、one\\nB. two\\n答案: A') AS source_raw_text")
    return X.split_shared_stem(rows)


def _sol(title: str, answer: str, analysis: str) -> str:
    return f"':::answer-block{title} || chr(10) || '答案：' || coalesce({answer}, '暂无') || chr(10) || chr(10) || '解析：' || coalesce({analysis}, '暂无') || chr(10) || ':::' || chr(10) || chr(10)"


def _one(q: str, tail: str) -> str:
    return f"trim('第' || {q}no || '题 ' || trim({q}stem)) || chr(10) || chr(10) || CASE WHEN len({q}options) > 0 THEN array_to_string({q}options, chr(10)) || chr(10) || chr(10) ELSE '' END || {tail}"


def _markdown(mode: str) -> str:
    inline = mode == "inline"
    tail = lambda q: _sol("'", f"{q}answer", f"{q}analysis") if inline else "''"
    late = "" if inline else f""" || chr(10) || '## 答案与解析' || chr(10) || chr(10) || string_agg(CASE WHEN is_group THEN array_to_string(list_transform(coalesce(children, []), lambda c: {_sol(" 第' || c.no || '题'", 'c.answer', 'c.analysis')}), '') ELSE {_sol(" 第' || no || '题'", 'answer', 'analysis')} END, '' ORDER BY place)"""
    labels = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.TYPE_SECTIONS.items())
    return f"""WITH {_RECORDS}, m0 AS (SELECT *, CASE WHEN section IN ({', '.join(f"'{x}'" for x in X.SECTIONS)}) THEN section ELSE CASE type {labels} ELSE '练习题' END END AS head FROM rec),
m1 AS (SELECT *, head IS DISTINCT FROM lag(head) OVER w AS ch, CASE WHEN lag(is_group) OVER w THEN '' ELSE lag(shared_stem) OVER w END AS pre FROM m0 WINDOW w AS (PARTITION BY paper_id ORDER BY place)),
m2 AS (SELECT *, CASE WHEN ch THEN '## ' || head || chr(10) || chr(10) ELSE '' END || CASE WHEN shared_stem <> '' AND (is_group OR ch OR shared_stem IS DISTINCT FROM pre) THEN '### 共用材料' || chr(10) || chr(10) || shared_stem || chr(10) || chr(10) ELSE '' END
  || CASE WHEN is_group AND material <> '' THEN '材料：' || chr(10) || chr(10) || material || chr(10) || chr(10) ELSE '' END || CASE WHEN is_group THEN array_to_string(list_transform(coalesce(children, []), lambda c: {_one('c.', tail('c.'))}), '') ELSE {_one('', tail(''))} END AS md FROM m1)
SELECT paper_id, 'Paper_' || paper_id || '-{mode}.md' AS file, regexp_replace('# Paper: ' || paper_id || '.' || chr(10) || chr(10) || string_agg(md, '' ORDER BY place){late}, '\\s+$', '') || chr(10) AS markdown FROM m2 GROUP BY paper_id"""


def _exported(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    papers = table(spark, sf_dir, "papers").select(F.col("id").alias("paper_id"), F.concat(F.lit("Paper: "), "id", F.lit(".")).alias("name"))
    found = X.export_markdown(_records(spark, sf_dir), papers, mode)
    return found.withColumn("file", F.regexp_replace("file", "_ ", "_"))


@query("f10_markdown", _markdown("inline"))
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exported(spark, sf_dir, "inline")


@query("f10_markdown_appendix", _markdown("appendix"))
def f10_appendix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exported(spark, sf_dir, "appendix")


@query("f11_delete_items", """WITH g AS (SELECT id FROM bank_items WHERE id % 4 = 0 OR parent_id % 4 = 0) SELECT 'items' AS kind, count(*) AS left_rows FROM bank_items WHERE id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'links', count(*) FROM bank_links WHERE bank_question_id NOT IN (SELECT id FROM g)""")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, links = tables(spark, sf_dir, "bank_items", "bank_links")
    kept, kept_links = X.delete_items(items, links, items.where("id % 4 = 0").select(F.col("id").alias("gone_id")))
    return kept.agg(F.count(F.lit(1)).alias("left_rows")).select(F.lit("items").alias("kind"), "left_rows").unionByName(kept_links.agg(F.count(F.lit(1)).alias("left_rows")).select(F.lit("links").alias("kind"), "left_rows"))


@query("f11_delete_counts", """WITH g AS (SELECT id FROM bank_items WHERE id % 4 = 0 OR parent_id % 4 = 0) SELECT 'items' AS kind, count(*) AS removed FROM g UNION ALL SELECT 'links', count(*) FROM bank_links WHERE bank_question_id IN (SELECT id FROM g) UNION ALL SELECT 'unknown', count(*) FROM bank_items WHERE id % 8 = 0""")
def f11_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, links = tables(spark, sf_dir, "bank_items", "bank_links")
    return X.delete_counts(items, links, items.where("id % 4 = 0").select(F.col("id").alias("gone_id")).union(items.where("id % 8 = 0").select(-F.col("id") - 1)))
