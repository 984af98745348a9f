"""Queries of taxonomies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import outlines as O
from ..operators import taxonomy as X
from .base import query, table, tables


#: Lines of every form, an outline per part type.
_OUTLINE_TEXT = """CASE WHEN p_partkey % 29 = 0 THEN '# 教材目录' WHEN p_partkey % 31 = 0 THEN '```' ELSE CASE p_partkey * 7 % 17 WHEN 0 THEN concat('# ', p_brand) WHEN 1 THEN concat('## ', p_size, '. **', p_name, '**') WHEN 2 THEN concat('第', p_size, '章 ', p_brand, ' .... ', p_size)
  WHEN 3 THEN concat('第二节 ', p_name, ' [x](y)') WHEN 4 THEN concat('- ', p_name) WHEN 5 THEN concat(p_size, '. ', p_name) WHEN 6 THEN concat('  ', p_size % 4, '.', p_size % 3, ' ', p_name) WHEN 7 THEN concat(p_size % 4, '．2.', p_size, '  ', p_brand, '·····12') WHEN 8 THEN concat('#### 考点三：', p_name, ' ##')
  WHEN 9 THEN concat('### 第', p_size, '章 ', p_type) WHEN 10 THEN concat('一、', p_name) WHEN 11 THEN concat('    * 知识点 ', p_name) WHEN 12 THEN concat('### ', p_brand) WHEN 13 THEN concat(p_size % 4, ' ', p_brand) WHEN 14 THEN concat('2.5', p_name) WHEN 15 THEN concat('#### ', p_size, '.1 ', p_name) ELSE p_name END END"""


def _outline_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_type AS doc_id", "p_partkey AS line_no", f"{_OUTLINE_TEXT} AS text")


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _cut(pattern: str, k: int) -> str:
    return f"CASE WHEN regexp_matches(t, {_q(pattern)}) THEN regexp_extract(t, {_q(pattern)}, {k}) END"


def _name(text: str, numbered: bool = True) -> str:
    for pattern, to in ((O.LINK, r"\1"), (O.DECORATION, ""), (O.TOC_PAGE, ""), *([(O.LEADING, "")] if numbered else [])):
        text = f"regexp_replace({text}, {_q(pattern)}, '{to}', 'g')"
    text = f"trim(regexp_replace({text}, '{O.S}+', ' ', 'g'), ' -—_')"
    return f"CASE WHEN length({text}) BETWEEN 1 AND 128 AND NOT (ends_with({text}, '目录') AND length({text}) <= 32) THEN {text} END"


# Forms and names of every line, then one walk through an outline's lines in order, with what is open as its state.
_LINES = f"""l0 AS (SELECT p_type AS doc_id, p_partkey AS line_no, {_OUTLINE_TEXT} AS t FROM part), l1 AS (SELECT *, sum((t = '```')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 = 1 AS code FROM l0),
l2 AS (SELECT doc_id, line_no, t, length({_cut(O.HEADING, 1)}) AS marks, {_cut(O.HEADING, 2)} AS head, len(string_split(replace({_cut(O.OUTLINE, 1)}, '．', '.'), '.')) AS deep, replace({_cut(O.OUTLINE, 1)}, '．', '.') AS num, {_cut(O.OUTLINE, 2)} AS outl, length({_cut(O.ITEM, 1)}) AS indent, {_cut(O.ITEM, 2)} AS item,
  {_cut(O.NUMBERED, 1)} AS digit, {_cut(O.NUMBERED, 2)} AS nbd, {_cut(O.CHAPTER, 1)} AS chap, {_cut(O.SECTION, 1)} AS sect FROM l1 WHERE NOT code AND t <> '```')"""
_CHAPTERS = f"""{_LINES}, dr0 AS (SELECT doc_id, line_no, (CASE WHEN head IS NOT NULL THEN least(marks, 2) WHEN outl IS NOT NULL THEN least(deep, 2) WHEN item IS NOT NULL THEN least(indent // 2 + 1, 2) WHEN nbd IS NOT NULL OR chap IS NOT NULL THEN 1 WHEN sect IS NOT NULL THEN 2 END)::INT AS level,
  CASE WHEN head IS NOT NULL THEN NULL WHEN outl IS NOT NULL THEN num WHEN item IS NULL AND regexp_matches(digit, '^[0-9]+$') THEN digit END AS number, CASE WHEN coalesce(head, outl, item, nbd) IS NOT NULL THEN {_name("coalesce(head, outl, item, nbd)")} ELSE {_name("coalesce(chap, sect)", False)} END AS name FROM l2), dr AS (SELECT * FROM dr0 WHERE name IS NOT NULL)"""
_WALKED = f"""{_LINES}, l3 AS (SELECT *, CASE WHEN chap IS NOT NULL OR regexp_matches(head, '{O.CHAPTER}') THEN 1 WHEN sect IS NOT NULL OR regexp_matches(head, '{O.SECTION}') THEN 2 WHEN head IS NOT NULL THEN least(marks, 4) WHEN outl IS NOT NULL THEN least(deep, 4) WHEN item IS NOT NULL THEN 4 WHEN nbd IS NOT NULL THEN 5 END AS role,
  CASE WHEN chap IS NOT NULL OR sect IS NOT NULL OR regexp_matches(head, '{O.CHAPTER}') OR regexp_matches(head, '{O.SECTION}') THEN {_name("coalesce(chap, sect, head)", False)} ELSE {_name("coalesce(head, outl, item, nbd)")} END AS c, {_name("coalesce(head, outl, item, nbd)")} AS n FROM l2),
l4 AS (SELECT *, CASE WHEN regexp_matches(n, {_q(O.POINT_LABEL)}) THEN nullif(trim(regexp_extract(n, {_q(O.POINT_LABEL)}, 1)), '') ELSE n END AS p FROM l3 WHERE role IS NOT NULL),
w AS (SELECT doc_id, list_reduce(list({{'line_no': line_no, 'role': role, 'c': c, 'p': p, 'ch': NULL::VARCHAR, 'se': NULL::VARCHAR, 'po': NULL::VARCHAR, 'does': 0, 'all': []::STRUCT(line_no BIGINT, role INT, c VARCHAR, p VARCHAR, ch VARCHAR, se VARCHAR, po VARCHAR, does INT)[]}} ORDER BY line_no), lambda a, x: STEP) AS e FROM (SELECT doc_id, -1::BIGINT AS line_no, 0::INT AS role, NULL::VARCHAR AS c, NULL::VARCHAR AS p FROM l4 GROUP BY 1 UNION ALL SELECT doc_id, line_no, role::INT, c, p FROM l4) GROUP BY 1),
u AS (SELECT doc_id, unnest(e.all, recursive := true) FROM w)"""


def _walked(details: bool) -> str:
    """What a line does (1 chapter, 2 section, 3 point, 4 detail) by what is open before it, and what is open after it."""
    does = "CASE WHEN x.role < 5 THEN x.role WHEN a.po IS NOT NULL THEN 4 WHEN a.ch IS NOT NULL OR a.se IS NOT NULL THEN 3 ELSE 1 END" if details else "CASE WHEN x.role < 5 THEN least(x.role, 3) WHEN a.ch IS NOT NULL OR a.se IS NOT NULL THEN 3 ELSE 1 END"
    after = f"CASE WHEN ({does}) = 1 THEN x.c ELSE a.ch END", f"CASE WHEN ({does}) = 1 THEN NULL WHEN ({does}) = 2 THEN x.c ELSE a.se END", f"CASE WHEN ({does}) < 3 THEN NULL WHEN ({does}) = 3 THEN x.p ELSE a.po END"
    one = f"'line_no': x.line_no, 'role': x.role, 'c': x.c, 'p': x.p, 'ch': {after[0]}, 'se': {after[1]}, 'po': {after[2]}, 'does': ({does})::INT"
    return _WALKED.replace("STEP", f"{{{one}, 'all': list_append(a.all, {{{one}}})}}")


@query("j1_parse_outlines", f"WITH {_CHAPTERS} SELECT * FROM dr")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.parse_chapters(_outline_lines(spark, sf_dir))


@query("j1_parse_points", f"WITH {_walked(False)} SELECT doc_id, line_no, ch AS chapter_name, se AS section_name, p AS name FROM u WHERE does = 3 AND ch IS NOT NULL AND p IS NOT NULL")
def j1_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.parse_points(_outline_lines(spark, sf_dir))


@query("j1_parse_details", f"WITH {_walked(True)} SELECT doc_id, line_no, ch AS chapter_name, se AS section_name, po AS point_name, p AS name FROM u WHERE does = 4 AND ch IS NOT NULL AND po IS NOT NULL AND p IS NOT NULL")
def j1_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.parse_details(_outline_lines(spark, sf_dir))


@query("j2_resolve_outline", f"""WITH {_CHAPTERS}, a AS (SELECT *, max(CASE WHEN level = 1 THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no) AS l1, CASE WHEN contains(number, '.') THEN string_split(number, '.')[1] END AS above FROM dr),
b AS (SELECT doc_id, line_no, level, number, CASE WHEN above IS NOT NULL THEN (SELECT max(d.line_no) FROM dr d WHERE d.doc_id = a.doc_id AND d.number = above AND d.line_no < a.line_no) WHEN level = 2 THEN l1 END AS parent_line FROM a) SELECT *, level = 1 OR parent_line IS NOT NULL AS ok FROM b""")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.resolve_outline(O.parse_chapters(_outline_lines(spark, sf_dir))).select("doc_id", "line_no", "level", "number", "parent_line", "ok")


_MERGED = """e AS (SELECT parent_id, lower(regexp_replace(name, '[\\s/\\\\_:,.;()-]+', '', 'g')) AS k, row_number() OVER (PARTITION BY parent_id ORDER BY id) AS so FROM chapters),
d AS (SELECT s_nationkey % 5 + 1 AS parent_id, lower(regexp_replace(s_name, '[\\s/\\\\_:,.;()-]+', '', 'g')) AS k, s_name AS name, s_suppkey AS ord FROM supplier UNION ALL SELECT 1, 'algeria', 'Al geria', 0),
n AS (SELECT parent_id, k, min((ord, name)) AS m FROM d WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.parent_id = d.parent_id AND e.k = d.k) GROUP BY ALL)"""


def _drafts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chapters, supplier = tables(spark, sf_dir, "chapters", "supplier")
    old = chapters.withColumn("sort_order", F.row_number().over(Window.partitionBy("parent_id").orderBy("id")))
    drafts = supplier.select((F.col("s_nationkey") % 5 + 1).alias("parent_id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord"))
    return old, drafts.union(chapters.where("id = 1").select(F.lit(1), F.lit("Al geria"), F.lit(0)))


@query("j3_merge_nodes", f"""WITH {_MERGED}
SELECT parent_id, m[2] AS name, (coalesce((SELECT max(so) FROM e WHERE e.parent_id = n.parent_id), 0) + row_number() OVER (PARTITION BY parent_id ORDER BY m))::BIGINT AS sort_order FROM n""")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.merge_nodes(*_drafts(spark, sf_dir))


@query("j3_merge_counts", f"WITH {_MERGED} SELECT (SELECT count(*) FROM n) AS created, (SELECT count(*) FROM d) - (SELECT count(*) FROM n) AS skipped")
def j3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, drafts = _drafts(spark, sf_dir)
    return X.merge_counts(drafts, X.merge_nodes(old, drafts))


_POINT_DRAFTS = "SELECT CASE WHEN p_size % 7 = 0 THEN 'nowhere' WHEN p_size % 7 < 5 THEN lower(r_name) ELSE concat(substr(r_name, 1, 2), ' ', substr(r_name, 3)) END AS chapter_name, CASE p_size % 3 WHEN 0 THEN n_name WHEN 1 THEN 'no such' END AS section_name, p_name AS name, p_partkey AS ord FROM part JOIN nation ON n_nationkey = p_partkey % 25 JOIN region ON r_regionkey = CASE WHEN p_size % 2 = 0 THEN n_regionkey ELSE (n_regionkey + 1) % 5 END"
_BOUND = f"pd AS ({_POINT_DRAFTS}), r AS (SELECT id, replace(lower(name), ' ', '') AS k FROM chapters WHERE parent_id IS NULL), b AS (SELECT pd.*, r.id AS cid, s.id AS sid FROM pd LEFT JOIN r ON r.k = replace(lower(pd.chapter_name), ' ', '') LEFT JOIN chapters s ON s.parent_id = r.id AND replace(lower(s.name), ' ', '') = replace(lower(pd.section_name), ' ', ''))"


def _bound(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part, nation, region, chapters = tables(spark, sf_dir, "part", "nation", "region", "chapters")
    sql = _POINT_DRAFTS.replace("FROM part", "FROM {part}").replace("JOIN nation", "JOIN {nation}").replace("JOIN region", "JOIN {region}")
    return X.bind_points(chapters, spark.sql(sql, part=part, nation=nation, region=region))


@query("j3_bind_points", f"WITH {_BOUND} SELECT sid AS parent_id, name, ord FROM b WHERE sid IS NOT NULL")
def j3_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir)[0]


@query("j3_point_violations", f"WITH {_BOUND} SELECT name, ord, CASE WHEN cid IS NULL THEN 'unknown_chapter' WHEN section_name IS NOT NULL THEN 'unknown_section' ELSE 'section_missing' END AS violation FROM b WHERE sid IS NULL")
def j3_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir)[1]


@query("j5_auto_keywords", r"""WITH w AS (SELECT p_partkey AS id, list_concat([p_name || '与' || p_brand, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_type ELSE p_brand END, p_type, ''], list_filter([p_name, p_brand], lambda x: length(x) BETWEEN 2 AND 18), [CASE WHEN p_partkey % 3 = 0 THEN p_size || '版' ELSE '' END]) AS l FROM part),
u AS (SELECT id, unnest(l) AS keyword, generate_subscripts(l, 1) AS o FROM w), f AS (SELECT id, lower(regexp_replace(keyword, '[\s_:,.;()#-]+', '', 'g')) AS k, min((o, keyword)) AS m FROM u WHERE keyword <> '' GROUP BY ALL)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY m) - 1)::INT AS place, m[2] AS keyword FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY m) <= 8""")
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapter = "CASE p_partkey % 4 WHEN 0 THEN concat('第', p_size, '讲 ', p_brand) WHEN 1 THEN concat('模块三 ', p_type) WHEN 2 THEN concat('第二篇', p_brand) ELSE p_brand END AS chapter"
    part = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "concat(p_name, '与', p_brand) AS name", chapter, "p_type AS subject", "CAST(NULL AS STRING) AS category", "array('kind:x', CASE WHEN p_partkey % 3 = 0 THEN concat('version: ', p_size, '版') ELSE 'other' END) AS tags")
    return X.auto_keywords(part)


_TREE = "tr AS (SELECT id, id AS root_id, 1::INT AS level, name AS path FROM chapters WHERE parent_id IS NULL UNION ALL SELECT c.id, p.id, 2::INT, p.name || '/' || c.name FROM chapters c JOIN chapters p ON p.id = c.parent_id)"


@query("j6_sync_tree", f"WITH {_TREE} SELECT *, root_id % 3 AS subject_id, root_id % 2 AS category_id FROM tr")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = table(spark, sf_dir, "chapters").withColumn("subject_id", F.col("id") % 3).withColumn("category_id", F.col("id") % 2)
    return X.walk(chapters, ["subject_id", "category_id"])


@query("j6_sync_points", f"""WITH {_TREE}, p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 3 THEN p_partkey - 1 WHEN p_partkey % 4 = 2 THEN p_partkey - 1 END AS parent_id, p_name AS name, 100 + p_size % 30 AS chapter_id FROM part),
w AS (SELECT id, id AS root, 1::INT AS level, name AS path FROM p WHERE parent_id IS NULL UNION ALL SELECT c.id, b.id, 2::INT, b.name || '/' || c.name FROM p c JOIN p b ON b.id = c.parent_id AND b.parent_id IS NULL UNION ALL SELECT c.id, a.id, 3::INT, a.name || '/' || b.name || '/' || c.name FROM p c JOIN p b ON b.id = c.parent_id JOIN p a ON a.id = b.parent_id)
SELECT w.id, tr.root_id % 3 AS subject_id, tr.root_id % 2 AS category_id, p.chapter_id, w.level, tr.path || '/' || w.path AS path FROM w JOIN p ON p.id = w.root JOIN tr ON tr.id = p.chapter_id""")
def j6_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = table(spark, sf_dir, "chapters").withColumn("subject_id", F.col("id") % 3).withColumn("category_id", F.col("id") % 2)
    points = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 4 >= 2 THEN p_partkey - 1 END AS parent_id", "p_name AS name", "100 + p_size % 30 AS chapter_id")
    return X.sync_points(points, X.walk(chapters, ["subject_id", "category_id"]))


@query("j7_descendants", 'SELECT id AS "of", id, 0::INT AS distance FROM chapters WHERE id <= 2 UNION ALL SELECT parent_id, id, 1::INT FROM chapters WHERE parent_id <= 2')
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = table(spark, sf_dir, "chapters")
    return X.descendants(chapters, chapters.where("id <= 2").select("id"))


@query("j8_cascade", """WITH g AS (SELECT id FROM chapters WHERE id <= 2 OR parent_id <= 2) SELECT 'customers' AS table_name, count(*) AS n FROM customer WHERE c_nationkey + 100 IN (SELECT id FROM g) UNION ALL SELECT 'suppliers', count(*) FROM supplier WHERE s_nationkey + 100 IN (SELECT id FROM g)""")
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters, customer, supplier = tables(spark, sf_dir, "chapters", "customer", "supplier")
    gone = X.descendants(chapters, chapters.where("id <= 2").select("id")).select("id")
    return X.cascade_counts(gone, {"customers": (customer.withColumn("chapter_id", F.col("c_nationkey") + 100), "chapter_id"), "suppliers": (supplier.withColumn("chapter_id", F.col("s_nationkey") + 100), "chapter_id")})


@query("j8_papers_of_files", "SELECT id FROM papers WHERE asset_id IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 70 = 0))")
def j8_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as assets, whose nation stands for the hash."""
    assets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.md5(F.col("c_nationkey").cast("string")).alias("sha256"))
    return X.papers_of_files(assets.where("id % 70 = 0").select("sha256"), assets, table(spark, sf_dir, "papers"))


@query("j9_dependency_counts", "SELECT subject_id, 'items' AS table_name, count(*) AS n FROM bank_items GROUP BY 1 UNION ALL SELECT subject_id, 'sessions', count(*) FROM sessions WHERE subject_id IS NOT NULL GROUP BY 1")
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, sessions = tables(spark, sf_dir, "bank_items", "sessions")
    return X.dependency_counts({"items": (items, "subject_id"), "sessions": (sessions, "subject_id")})


@query("j10_tag_value", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_type END AS category FROM part")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.when(F.col("p_size") % 2 == 0, F.array(F.concat(F.lit("brand:"), "p_brand"), F.concat(F.lit("category:"), "p_type"), F.lit("category:x"))).otherwise(F.array("p_brand"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.tag_value(tags, "category").alias("category"))


_BOOK_LINE = "CASE p_partkey % 7 WHEN 0 THEN concat('第', p_size, '章  ', p_brand, '......', p_size) WHEN 1 THEN concat('第', p_size, '节 ', p_name) WHEN 2 THEN concat('考点', p_size, '：', p_type) WHEN 3 THEN concat('（', p_size % 9 + 1, '）', p_name, '。') WHEN 4 THEN concat(p_size, '. ', p_name, ' ', p_brand) WHEN 5 THEN concat('第', p_size, '章 本章小结') ELSE p_name END"


def _book_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_type AS doc_id", "p_partkey AS line_no", f"{_BOOK_LINE} AS text")


# A section heading ("第…节") is a chapter heading too, by the marks; so only labelled and numbered lines give points.
_BOOKS = """b0 AS (SELECT p_type AS doc_id, p_partkey AS line_no, CASE p_partkey % 7 WHEN 0 THEN '第' || p_size || '章 ' || p_brand WHEN 1 THEN '第' || p_size || '节 ' || p_name END AS head, CASE p_partkey % 7 WHEN 0 THEN p_brand WHEN 1 THEN p_name END AS core,
  CASE p_partkey % 7 WHEN 2 THEN p_type WHEN 4 THEN p_name || ' ' || p_brand END AS point FROM part), h0 AS (SELECT doc_id, lower(replace(head, ' ', '')) AS k, min((line_no, head, core)) AS h FROM b0 WHERE head IS NOT NULL GROUP BY 1, 2),
h1 AS (SELECT doc_id, h[1] AS line_no, h[2] AS chapter, h[3] AS core, row_number() OVER (PARTITION BY doc_id ORDER BY h[1]) AS chapter_no FROM h0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY h[1]) <= 40),
s0 AS (SELECT b0.*, last_value(h1.chapter_no IGNORE NULLS) OVER (PARTITION BY b0.doc_id ORDER BY b0.line_no) AS seg FROM b0 LEFT JOIN h1 ON h1.doc_id = b0.doc_id AND h1.line_no = b0.line_no),
p0 AS (SELECT doc_id, seg AS chapter_no, lower(replace(point, ' ', '')) AS k, min((line_no, point)) AS p FROM s0 WHERE seg IS NOT NULL AND head IS NULL AND point IS NOT NULL AND length(point) <= 40 GROUP BY 1, 2, 3),
p1 AS (SELECT doc_id, chapter_no, p[2] AS point, row_number() OVER (PARTITION BY doc_id, chapter_no ORDER BY p[1]) AS r FROM p0),
fb AS (SELECT doc_id, chapter_no, core || unnest(['基本概念', '核心规则', '方法步骤', '典型题型', '易错辨析']) AS point, 1000 + unnest(range(5)) AS r FROM h1),
al AS (SELECT * FROM p1 WHERE r <= 12 UNION ALL SELECT * FROM fb), nu AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chapter_no ORDER BY r) AS point_no FROM al)"""


@query("j4_textbook_outline", f"WITH {_BOOKS} SELECT h1.doc_id, h1.chapter_no, chapter, point_no, point FROM h1 JOIN nu ON nu.doc_id = h1.doc_id AND nu.chapter_no = h1.chapter_no AND point_no <= 12")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.textbook_outline(_book_lines(spark, sf_dir))


@query("j4_metadata_outline", """WITH b AS (SELECT p_partkey AS doc_id, p_type AS category, p_brand, CASE p_type WHEN 'ECONOMY' THEN ['Money, Trade', 'Law与税'] WHEN 'PROMO' THEN ['Ads'] ELSE list_transform(['基础知识', '核心概念', '规则与方法', '综合应用', '真题与易错点'], lambda x: p_type || x) END AS ch FROM part),
c AS (SELECT doc_id, unnest(ch) AS chapter, generate_subscripts(ch, 1) AS chapter_no FROM b),
p AS (SELECT *, CASE chapter WHEN 'Money, Trade' THEN ['Money核心考点', 'Trade核心考点', 'Money, Trade基本概念', 'Money, Trade核心规则', 'Money, Trade方法步骤', 'Money, Trade典型题型', 'Money, Trade易错辨析'] WHEN 'Law与税' THEN ['Law核心考点', 'Law与税征税范围', 'Law与税计税依据', 'Law与税应纳税额计算', 'Law与税税收优惠与征管', 'Law与税易错辨析']
  ELSE list_concat(CASE WHEN contains(chapter, '与') THEN list_transform(string_split(chapter, '与'), lambda x: x || '核心考点') ELSE [] END, list_transform(CASE WHEN contains(chapter, '法') THEN ['主体与权利义务', '成立与效力', '责任承担', '争议处理', '案例辨析'] ELSE ['基本概念', '核心规则', '方法步骤', '典型题型', '易错辨析'] END, lambda x: chapter || x)) END AS ps FROM c)
SELECT doc_id, chapter_no, chapter, generate_subscripts(ps[1:6], 1) AS point_no, unnest(ps[1:6]) AS point FROM p""")
def j4_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = table(spark, sf_dir, "part").selectExpr("p_partkey AS doc_id", "concat('《', p_brand, '》') AS title", "p_name AS subject", "p_type AS category", "array('x') AS tags")
    known = table(spark, sf_dir, "part").agg(F.lit(1).alias("one")).selectExpr("explode(array(struct(2 AS ord, 'PROMO' AS keyword, array('Ads', ' ads') AS chapters), struct(1 AS ord, 'ECONOMY' AS keyword, array('Money, Trade', 'Law与税') AS chapters))) AS t").select("t.*")
    return X.metadata_outline(books, known, max_points=6)


@query("j4_outline_tasks", "SELECT DISTINCT p_type AS doc_id, 'review_outline' AS task FROM part WHERE p_type NOT IN (SELECT min(p_type) FROM part)")
def j4_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _book_lines(spark, sf_dir)
    return X.outline_tasks(X.textbook_outline(lines), lines.agg(F.min("doc_id").alias("doc_id")))
