"""Queries of ingest, datasets and question structuring.  Papers and questions are expressed from orders and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import shared_folder
from ..operators import bank as B
from ..operators import questions as Q
from ..sources import files as S
from .base import query, table


@query("a1_load", "SELECT r_regionkey, r_name FROM region")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.load(spark, sf_dir, "region", "r_regionkey int, r_name string")


@query("a2_decode", "SELECT doc_id::VARCHAR AS path, text FROM documents")
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = F.when((F.col("doc_id") % 2 == 0) | ~F.col("text").rlike(r"^[\x00-\x7F]*$"), F.encode("text", "UTF-8")).otherwise(F.encode("text", "US-ASCII"))
    return S.decode_contents(docs.select(F.col("doc_id").cast("string").alias("path"), content.alias("content")))


@query("a3_ingest", """WITH n AS (SELECT *, sha256 AS h FROM files WHERE id % 3 > 0), e AS (SELECT * FROM files WHERE id % 3 = 0), f AS (SELECT sha256, min(id) AS first_id, min_by(file_type, id) AS ft FROM n GROUP BY 1), k AS (SELECT sha256, min(id) AS known_id FROM e GROUP BY 1)
SELECT n.id, n.sha256, coalesce(known_id, first_id) AS stored_id, 'library/202401/' || n.sha256 || '.' || ft AS path, known_id IS NULL AND n.id = first_id AS is_new FROM n JOIN f ON f.sha256 = n.sha256 LEFT JOIN k ON k.sha256 = n.sha256""")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files")
    return S.ingest(files.where("id % 3 > 0").select("id", F.encode("text", "UTF-8").alias("content"), "file_type", F.lit("202401").alias("month")), files.where("id % 3 = 0").select("id", "sha256"))


@query("a4_overrides", "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN source ELSE 'math' END AS subject, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN NULL ELSE '2024' END AS version FROM documents")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    meta = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("subject"), "source", F.lit("version"), F.lit(None).cast("string"))).otherwise(F.create_map(F.lit("subject"), F.col("source")))
    return S.apply_overrides(docs.select(F.col("doc_id").alias("id")), {"subject": "math", "version": "2024"}, docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), meta.alias("meta")))


_COPY = "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN concat('{{', event_id) ELSE props END AS props, CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(value AS {string}) END AS value, user_id AS unused FROM events"


def _copying(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, T.StructType]:
    rows = spark.sql(_COPY.format(string="STRING").replace("concat('{'", "concat('{{'").replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    target = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("props", T.MapType(T.StringType(), T.IntegerType())), T.StructField("value", T.DoubleType()), T.StructField("absent", T.StringType())])
    return rows, target


@query("a5_copy_columns", f"WITH r AS ({_COPY.format(string='VARCHAR')}) SELECT event_id, CASE WHEN event_id % 7 > 0 THEN json_extract_string(props, '$.k')::INT END AS k, CASE WHEN event_id % 5 > 0 THEN round(value::DOUBLE, 6) END AS value, CASE WHEN event_id % 7 = 0 THEN '{{' || event_id END AS raw_props, CASE WHEN event_id % 5 = 0 THEN 'n/a' END AS raw_value FROM r")
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = lambda c: F.try_element_at("raw", F.lit(c)).alias(f"raw_{c}")
    return S.copy_columns(*_copying(spark, sf_dir))[0].select("event_id", F.try_element_at("props", F.lit("k")).alias("k"), F.round("value", 6).alias("value"), raw("props"), raw("value"))


@query("a5_copy_counts", "SELECT count(*) AS rows, count(*) FILTER (WHERE event_id % 7 = 0 OR event_id % 5 = 0) AS raw_rows, 1::BIGINT AS missing_columns FROM events")
def a5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.copy_table(*_copying(spark, sf_dir), shared_folder(spark, "copy"))


_LINES = "q AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey AS paper_id, l_orderkey * 10 + l_linenumber AS id, l_linenumber AS n FROM lineitem ORDER BY l_orderkey, l_linenumber)"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question rows of a paper: lines, where every third hangs below the first one."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").cast("long").alias("n")).distinct()
    return lines.withColumn("id", F.col("paper_id") * 10 + F.col("n"))


@query("a6_export_dataset", f"""WITH {_LINES}, r AS (SELECT *, CASE WHEN n % 3 = 0 AND n > 1 THEN 1 END AS parent FROM q), p AS (SELECT paper_id, count(*) FILTER (WHERE parent IS NULL) AS roots, count(*) FILTER (WHERE parent = 1) AS kids, bool_or(n = 1) AS one, count(DISTINCT n % 2) FILTER (WHERE parent IS NULL) AS n_sections,
  sum(length('stem ' || n)) FILTER (WHERE parent IS NULL)::BIGINT AS chars FROM r GROUP BY 1)
SELECT p.paper_id, 'new' AS paper_name, CASE WHEN p.paper_id % 2 = 0 THEN 'ai_source.txt' ELSE 'source.txt' END AS prediction_source_file, CASE WHEN p.paper_id % 2 = 0 THEN 2 ELSE 0 END::INT AS ai_source_text_length, p.paper_id % 2 = 0 AS has_ai_source_text, n_sections::INT AS n_sections,
  (roots + CASE WHEN one AND kids > 0 THEN kids - 1 ELSE 0 END)::BIGINT AS n_questions, chars FROM p WHERE roots > 0""")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples written, written again under a new name, and read back: the newer ones are there alone."""
    rows = _rows(spark, sf_dir).selectExpr("paper_id", "CAST(n % 2 AS STRING) AS section", "id", "CASE WHEN n % 3 = 0 AND n > 1 THEN paper_id * 10 + 1 END AS parent_id", "n AS sort_order", "concat('stem ', n) AS stem")
    papers = rows.select("paper_id").distinct().selectExpr("paper_id", "'old' AS paper_name", "'text' AS source_text", "CASE WHEN paper_id % 2 = 0 THEN 'ai' END AS ai_source_text", "CAST(NULL AS STRING) AS raw_source_text", "CAST(1 AS BIGINT) AS stored_question_count")
    path = shared_folder(spark, "dataset")
    S.write_dataset(S.export_dataset(papers, rows), path)
    S.write_dataset(S.export_dataset(papers.where("paper_id % 8 > 0").withColumn("paper_name", F.lit("new")), rows), path)
    found = S.write_dataset(S.export_dataset(papers.where("paper_id % 8 = 0").withColumn("paper_name", F.lit("new")), rows), path)
    stems = F.regexp_extract_all("sample", F.lit('"stem":"([^"]*)"'), F.lit(1))
    return found.select(
        "paper_id", "meta.paper_name", "meta.prediction_source_file", "meta.ai_source_text_length", "meta.has_ai_source_text", F.col("meta.predicted_section_count").alias("n_sections"), F.col("meta.predicted_question_count").alias("n_questions"),
        F.aggregate(stems, F.lit(0), lambda s, x: s + F.length(x)).cast("long").alias("chars"),
    )


@query("a7_gold_template", f"WITH {_LINES} SELECT paper_id, id, 's' || n % 2 AS section, 'stem ' || n AS stem, 1::INT AS version, 'draft' AS label_status FROM q")
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.gold_template(_rows(spark, sf_dir).select("paper_id", "id", F.concat(F.lit("s"), F.col("n") % 2).alias("section"), F.concat(F.lit("stem "), "n").alias("stem")))


def _gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"))
    gold = orders.where("paper_id % 3 > 0").withColumn("label_status", F.when(F.col("paper_id") % 4 == 0, "done").when(F.col("paper_id") % 4 == 1, "Draft"))
    return gold, orders.where("paper_id % 5 > 0")


_GOLD = """g AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN true END AS has_gold, CASE WHEN o_orderkey % 3 > 0 THEN CASE o_orderkey % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'Draft' END END AS st, CASE WHEN o_orderkey % 5 > 0 THEN true END AS has_pred FROM orders),
s AS (SELECT *, CASE WHEN has_gold AND st = 'done' THEN 'gold' WHEN has_pred THEN 'prediction' ELSE 'gold' END AS source FROM g WHERE has_gold OR has_pred)"""


@query("a8_sync_source", f"WITH {_GOLD} SELECT id AS paper_id, source, source = 'gold' AS used_gold FROM s")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pick_sync_source(*_gold(spark, sf_dir))


_SAMPLES = f"WITH {_GOLD}, sm AS (SELECT *, id % 7 > 0 AS has_source, 'paper ' || id AS paper_name, CASE WHEN id % 3 = 0 THEN 'Law' END AS subject_name, id % 11 AS updated_at FROM s)"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred = _gold(spark, sf_dir)
    rows = gold.withColumn("has_gold", F.lit(True)).join(pred.withColumn("has_prediction", F.lit(True)), "paper_id", "full").na.fill(False, ["has_gold", "has_prediction"]).withColumnRenamed("paper_id", "id")
    return rows.selectExpr("*", "id % 7 > 0 AS has_source", "concat('paper ', id) AS paper_name", "CASE WHEN id % 3 = 0 THEN 'Law' END AS subject_name", "CAST(NULL AS STRING) AS category_name", "id % 11 AS updated_at")


@query("a9_dataset_summary", f"{_SAMPLES} SELECT count(*) AS samples, count(has_gold) AS gold, count(has_pred) AS predictions, count(*) FILTER (WHERE has_source) AS sources, count(*) FILTER (WHERE st IS DISTINCT FROM 'done') AS unlabelled FROM sm")
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dataset_summary(_samples(spark, sf_dir))


@query("a9_list_samples", f"{_SAMPLES} SELECT id, paper_name, updated_at FROM sm WHERE subject_name = 'Law' OR contains(paper_name, 'law')")
def a9_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.list_samples(_samples(spark, sf_dir), " LAW").select("id", "paper_name", "updated_at")


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction per paper: odd lines are a section of standalone questions, even ones the children of a group."""
    lines = _rows(spark, sf_dir)
    single = F.struct(F.col("n").cast("string").alias("question_no"), F.concat(F.lit("stem "), "n").alias("stem_text"), F.array().cast("array<struct<question_no:string,stem_text:string,answer_text:string>>").alias("subquestions"))
    child = F.struct(F.col("n").cast("string").alias("question_no"), F.concat(F.lit("sub "), "n").alias("stem_text"), F.lit("A").alias("answer_text"))
    per = lines.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.when(F.col("n") % 2 == 1, F.struct("n", single.alias("q"))))).alias("odd"), F.array_sort(F.collect_list(F.when(F.col("n") % 2 == 0, F.struct("n", child.alias("q"))))).alias("even"))
    group = F.struct(F.lit("G").alias("question_no"), F.lit("shared").alias("group_stem"), F.lit("").alias("stem_text"), F.transform("even", lambda x: x["q"]).alias("subquestions"))
    first = F.to_json(F.struct(F.lit(" ").alias("title"), F.transform("odd", lambda x: x["q"]).alias("questions")))
    second = F.to_json(F.struct(F.lit("reading").alias("title"), F.when(F.size("even") > 0, F.array(group)).alias("questions")))
    return per.select("paper_id", F.concat(F.lit('{"sections":['), first, F.lit(","), second, F.lit("]}")).alias("prediction"))


_FLAT = f"""{_LINES}, fl AS (SELECT paper_id, '分区 1' AS section, n::VARCHAR AS question_no, NULL::VARCHAR AS parent_no, 'standalone' AS node_role, 'stem ' || n AS stem, NULL::VARCHAR AS material, 0 AS s, n AS o FROM q WHERE n % 2 = 1
UNION ALL SELECT DISTINCT paper_id, 'reading', 'G', NULL, 'group', 'shared', NULL, 1, -1 FROM q WHERE n % 2 = 0 UNION ALL SELECT paper_id, 'reading', n::VARCHAR, 'G', 'subquestion', 'sub ' || n, 'shared', 1, n FROM q WHERE n % 2 = 0),
fo AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY s, o) AS sort_order FROM fl)"""


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.flatten_questions(Q.normalize_prediction(_predictions(spark, sf_dir)))


@query("d1_normalize_prediction", f"""WITH {_LINES}, c AS (SELECT paper_id, count(*) FILTER (WHERE n % 2 = 1) AS odd, count(*) FILTER (WHERE n % 2 = 0) AS even FROM q GROUP BY 1),
r AS (SELECT paper_id, '分区 1' AS title, 'mixed' AS section_type, n::VARCHAR AS question_no, 'standalone' AS node_role, 'mixed' AS question_type, '' AS group_stem, 'stem ' || n AS stem_text, 0 AS children, '' AS answers, 1 AS s FROM q WHERE n % 2 = 1
  UNION ALL SELECT paper_id, 'reading', 'mixed', 'G', 'group', 'material_analysis', 'shared', 'shared', count(*), string_agg('A', ''), 2 FROM q WHERE n % 2 = 0 GROUP BY 1)
SELECT r.paper_id, title, section_type, CASE s WHEN 1 THEN odd ELSE 1 END::INT AS section_questions, r.question_no, node_role, question_type, group_stem, stem_text, children::INT AS children, answers, odd + even AS question_count FROM r JOIN c ON c.paper_id = r.paper_id""")
def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Q.normalize_prediction(_predictions(spark, sf_dir)).select("paper_id", "question_count", F.explode("sections").alias("s"))
    rows = found.select("paper_id", "question_count", "s.title", "s.section_type", F.col("s.question_count").alias("section_questions"), F.explode("s.questions").alias("q"))
    return rows.select(
        "paper_id", "title", "section_type", "section_questions", "q.question_no", "q.node_role", "q.question_type", "q.group_stem", "q.stem_text", F.size("q.subquestions").alias("children"),
        F.array_join(F.transform("q.subquestions", lambda c: c["answer_text"]), "").alias("answers"), "question_count",
    )


@query("d2_flatten_questions", f"WITH {_FLAT} SELECT paper_id, section, question_no, parent_no, node_role, stem, material, sort_order FROM fo")
def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir)


@query("d3_number_sections", f"""WITH {_FLAT}, p AS (SELECT paper_id, section, min(sort_order) AS f, count(*) FILTER (WHERE node_role <> 'group') AS leaves FROM fo GROUP BY 1, 2), z AS (SELECT *, (coalesce(sum(leaves) OVER (PARTITION BY paper_id ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::BIGINT AS st FROM p)
SELECT paper_id, section, leaves, CASE WHEN leaves > 0 THEN st END AS start_no, CASE WHEN leaves > 0 THEN st + leaves - 1 END AS end_no FROM z""")
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.number_sections(_flat(spark, sf_dir))


@query("d4_fingerprint", f"WITH {_FLAT} SELECT paper_id, sort_order, sha1(concat_ws('|', section, question_no, stem)) AS fingerprint, 'PRQ' || paper_id || '-' || substr(sha1(concat_ws('|', section, question_no, stem)), 1, 24) AS uid FROM fo")
def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest, uid = Q.review_fingerprint(F.col("paper_id"), F.col("section"), F.col("question_no"), F.col("stem"))
    return _flat(spark, sf_dir).select("paper_id", "sort_order", digest.alias("fingerprint"), uid.alias("uid"))


@query("d5_compose_raw", f"WITH {_FLAT} SELECT paper_id, sort_order, CASE WHEN node_role = 'group' THEN 'all below' || chr(10) || 'a table' || chr(10) || stem ELSE question_no || '. ' || stem END || chr(10) || 'A. x' || chr(10) || 'B. y' || chr(10) || '答案：A' AS raw FROM fo")
def d5(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = Q.compose_raw(F.col("question_no"), F.col("stem"), F.array(F.lit("A. x"), F.lit(" "), F.lit(" B. y")), F.lit("A "), F.lit(" "), F.col("node_role"), F.lit("all below"), F.lit("a table"))
    return _flat(spark, sf_dir).select("paper_id", "sort_order", raw.alias("raw"))


_FIELDS = """SELECT p_partkey AS id, CAST(p_partkey % 50 AS {string}) AS question_no, CASE p_partkey % 3 WHEN 0 THEN 'single_choice' WHEN 1 THEN 'judge' ELSE 'short_answer' END AS question_type,
  CASE p_partkey % 4 WHEN 0 THEN concat(p_partkey % 50, '. ', p_name) WHEN 1 THEN concat('第', p_partkey % 50, '、 ', p_name) WHEN 2 THEN concat(p_name, {nl}, '第3页', {nl}, {nl}, {nl}, '(  )') ELSE p_name END AS stem_text,
  CASE WHEN p_partkey % 7 > 0 THEN {list}(concat('A. ', p_type), concat('b) ', p_brand), concat('C、 ', upper(p_type)), '无', '扫码公众号') END AS options,
  CASE p_partkey % 5 WHEN 0 THEN '答案: c, a c' WHEN 1 THEN ' 无 ' WHEN 2 THEN '不正确' WHEN 3 THEN '√' END AS answer_text,
  CASE p_partkey % 4 WHEN 0 THEN concat('["one","two', {esc}, 'nmore"]') WHEN 1 THEN '{{"要点":"a"}}' WHEN 2 THEN '解析:  b' ELSE 'plain' END AS analysis_text, CASE p_partkey % 2 WHEN 0 THEN 'parsed' ELSE 'approved' END AS parse_status FROM part"""


@query("d6_normalize_fields", f"""WITH r AS ({_FIELDS.format(string='VARCHAR', nl='chr(10)', list='list_value', esc='chr(92)')}),
n AS (SELECT r.*, CASE r.id % 4 WHEN 2 THEN p_name || chr(10) || chr(10) || '（ ）' ELSE p_name END AS s, CASE WHEN r.id % 3 = 1 THEN ['正确', '错误'] WHEN r.id % 7 > 0 THEN [p_type, p_brand] ELSE [] END AS o,
  CASE r.id % 5 WHEN 0 THEN CASE r.id % 3 WHEN 0 THEN 'CA' ELSE 'c, a c' END WHEN 2 THEN CASE r.id % 3 WHEN 1 THEN '错误' ELSE '不正确' END WHEN 3 THEN CASE r.id % 3 WHEN 1 THEN '正确' ELSE '√' END END AS a,
  CASE r.id % 4 WHEN 0 THEN '1. one' || chr(10) || '2. two' || chr(10) || '   more' WHEN 1 THEN '要点：a' WHEN 2 THEN 'b' ELSE 'plain' END AS y FROM r JOIN part ON p_partkey = r.id),
c AS (SELECT *, s <> stem_text OR o <> coalesce(options, []) OR a IS DISTINCT FROM answer_text OR y <> analysis_text AS changed FROM n)
SELECT id, s AS stem_text, array_to_string(o, '|') AS options, a AS answer_text, y AS analysis_text, CASE WHEN changed AND parse_status = 'parsed' THEN 'normalized' ELSE parse_status END AS parse_status, changed FROM c""")
def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _FIELDS.format(string="STRING", nl="char(10)", list="array", esc="char(92)").replace("FROM part", "FROM {part}").replace('\'{"要点":"a"}\'', '\'{{"要点":"a"}}\'')
    found = Q.normalize_fields(spark.sql(sql, part=table(spark, sf_dir, "part")))
    return found.select("id", "stem_text", F.array_join("options", "|").alias("options"), "answer_text", "analysis_text", "parse_status", "changed")


@query("d7_apply_proposals", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 AND p_size > 10 THEN p_type ELSE p_name END AS stem_text, p_partkey % 3 = 0 AND p_size > 10 AS changed FROM part")
def d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    proposals = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 10, F.col("p_type")).otherwise(F.lit(" ")).alias("stem_text"))
    return Q.apply_proposals(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("stem_text")), proposals, ["stem_text"])


@query("d8_sync_questions", """WITH r AS (SELECT l_orderkey AS paper_id, (l_partkey % 50)::VARCHAR AS fp, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS so, l_shipdate FROM lineitem), e AS (SELECT paper_id, fp, CASE WHEN min(so) % 2 = 0 THEN 'approved' ELSE 'rejected' END AS rs FROM r WHERE so % 3 = 0 GROUP BY 1, 2),
i AS (SELECT paper_id, fp, 'stem ' || max(so) AS stem FROM r WHERE so % 3 > 0 GROUP BY 1, 2), o AS (SELECT * FROM e WHERE paper_id IN (SELECT paper_id FROM i))
SELECT coalesce(o.paper_id, i.paper_id) AS paper_id, coalesce(o.fp, i.fp) AS fingerprint, CASE WHEN o.fp IS NULL THEN 'inserted' WHEN i.fp IS NULL THEN 'deleted' ELSE 'updated' END AS action, coalesce(rs, 'pending') AS review_status, stem FROM o FULL JOIN i ON o.paper_id = i.paper_id AND o.fp = i.fp""")
def d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS paper_id", "CAST(l_partkey % 50 AS STRING) AS fingerprint", "l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS sort_order").withColumn("stem", F.concat(F.lit("stem "), "sort_order"))
    old = rows.where("sort_order % 3 = 0").groupBy("paper_id", "fingerprint").agg(F.when(F.min("sort_order") % 2 == 0, "approved").otherwise("rejected").alias("review_status"))
    return Q.sync_questions(old, rows.where("sort_order % 3 > 0"))


def _synced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS paper_id", "CAST(l_partkey % 50 AS STRING) AS fingerprint", "l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS sort_order", "l_linenumber % 3 AS kind")
    rows = rows.withColumn("stem", F.lit("s")).withColumn("node_role", F.when(F.col("kind") == 0, "group").otherwise("standalone"))
    old = rows.where("sort_order % 3 = 0").select("paper_id", "fingerprint", F.lit("approved").alias("review_status")).distinct()
    new = rows.where("sort_order % 3 > 0")
    return Q.sync_questions(old, new), new, old.select("paper_id", "fingerprint", F.col("fingerprint").cast("long").alias("point_id"))


_SYNC = """r AS (SELECT l_orderkey AS paper_id, (l_partkey % 50)::VARCHAR AS fp, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS so, l_linenumber % 3 AS kind FROM lineitem), e AS (SELECT DISTINCT paper_id, fp FROM r WHERE so % 3 = 0),
i AS (SELECT paper_id, fp, CASE WHEN max_by(kind, so) = 0 THEN 'group' ELSE 'standalone' END AS role FROM r WHERE so % 3 > 0 GROUP BY 1, 2), p AS (SELECT DISTINCT paper_id FROM i)"""


@query("d8_sync_tags", f"WITH {_SYNC} SELECT paper_id, fp AS fingerprint, fp::BIGINT AS point_id FROM e WHERE paper_id NOT IN (SELECT paper_id FROM p) OR EXISTS (SELECT 1 FROM i WHERE i.paper_id = e.paper_id AND i.fp = e.fp)")
def d8_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    synced, _, tags = _synced(spark, sf_dir)
    return Q.sync_tags(tags, synced)


@query("d8_synced_papers", f"""WITH {_SYNC}, j AS (SELECT coalesce(i.paper_id, e.paper_id) AS paper_id, i.fp AS new, e.fp AS old, role FROM i FULL JOIN (SELECT * FROM e WHERE paper_id IN (SELECT paper_id FROM p)) e ON e.paper_id = i.paper_id AND e.fp = i.fp)
SELECT paper_id, count(*) FILTER (WHERE old IS NULL) AS inserted, count(*) FILTER (WHERE old IS NOT NULL AND new IS NOT NULL) AS updated, count(*) FILTER (WHERE new IS NULL) AS deleted, count(*) FILTER (WHERE role <> 'group') AS leaves FROM j GROUP BY 1""")
def d8_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    synced, new, _ = _synced(spark, sf_dir)
    return Q.synced_papers(synced, new)


@query("d9_roots", "SELECT id, coalesce(parent_id, id) AS root_id FROM bank_items")
def d9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.roots(table(spark, sf_dir, "bank_items"))


@query("d9_leaf_counts", "SELECT coalesce(parent_id, id) AS root_id, count(*) AS leaves FROM bank_items WHERE id NOT IN (SELECT parent_id FROM bank_items WHERE parent_id IS NOT NULL) GROUP BY 1")
def d9_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.leaf_counts(table(spark, sf_dir, "bank_items"))


_REVIEW_COLUMNS = """id, subject_id AS paper_id, parent_id, node_role, CASE id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'odd' END AS status, CASE WHEN id % 5 > 0 THEN 'A' END AS answer_text, CASE WHEN id % 7 > 0 THEN 'x' ELSE ' ' END AS analysis_text, stem_text, CAST(NULL AS {string}) AS material_text,
  CASE id % 6 WHEN 0 THEN 'needs_revision' WHEN 1 THEN 'passed' END AS ai_status, CASE WHEN id % 6 < 3 THEN 1 END AS ai_reviewed_at, CAST(id % 90 AS BIGINT) AS sort_order, CASE WHEN id % 3 = 0 THEN id % 5 END AS section_id, concat(' ', question_type) AS section_name, concat('No. ', id) AS question_no, category AS group_stem"""
_REVIEW = f"rv AS (SELECT {_REVIEW_COLUMNS.format(string='VARCHAR')} FROM bank_items)"


def _review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT {_REVIEW_COLUMNS.format(string='STRING')} FROM {{items}}", items=table(spark, sf_dir, "bank_items"))


@query("d10_review_summary", f"""WITH {_REVIEW}, z AS (SELECT *, parent_id IS NULL AS r, node_role <> 'group' AS l FROM rv) SELECT paper_id, count(*) FILTER (WHERE r) AS roots, count(*) FILTER (WHERE r AND status = 'approved') AS approved, count(*) FILTER (WHERE r AND status = 'needs_revision') AS needs_revision, count(*) FILTER (WHERE r AND status = 'rejected') AS rejected,
  count(*) FILTER (WHERE r AND coalesce(status, 'odd') NOT IN ('approved', 'rejected')) AS pending, count(*) FILTER (WHERE r AND NOT l) AS groups, count(*) FILTER (WHERE l) AS leaves, count(*) FILTER (WHERE r AND ai_status = 'needs_revision') AS ai_flagged, count(*) FILTER (WHERE r AND ai_reviewed_at = 1) AS ai_reviewed,
  count(*) FILTER (WHERE l AND (answer_text IS NULL OR analysis_text = ' ')) AS missing_solution FROM z GROUP BY 1""")
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.review_summary(_review(spark, sf_dir))


@query("d13_solution_batches", f"""WITH {_REVIEW}, n AS (SELECT DISTINCT coalesce(parent_id, id) AS id FROM rv WHERE node_role <> 'group' AND (answer_text IS NULL OR analysis_text = ' '))
SELECT paper_id, id, ceil(row_number() OVER (PARTITION BY paper_id ORDER BY id) / 10.0)::BIGINT AS batch FROM rv WHERE parent_id IS NULL AND id IN (SELECT id FROM n)""")
def d13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.solution_batches(_review(spark, sf_dir))


# A change names a question or a child of one; what is approved must be whole: own texts, or those of all children.
_BULK = f"""{_REVIEW}, ch AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'rejected' ELSE 'approved' END AS status FROM rv WHERE id % 2 = 0 UNION ALL SELECT -1, 'approved'),
mp AS (SELECT coalesce(rv.parent_id, rv.id) AS root_id, max_by(ch.status, ch.id) AS status FROM ch JOIN rv ON rv.id = ch.id GROUP BY 1), lk AS (SELECT *, concat_ws(',', CASE WHEN coalesce(trim(stem_text), '') = '' THEN 'stem_text' END, CASE WHEN coalesce(trim(answer_text), '') = '' THEN 'answer_text' END, CASE WHEN coalesce(trim(analysis_text), '') = '' THEN 'analysis_text' END) AS lacks FROM rv),
gr AS (SELECT parent_id AS id, bool_and(lacks = '') AS whole FROM lk WHERE parent_id IS NOT NULL GROUP BY 1),
rs AS (SELECT root_id, mp.status, CASE WHEN mp.status <> 'approved' THEN '' WHEN node_role = 'group' THEN CASE WHEN gr.id IS NULL THEN 'children' WHEN NOT whole THEN 'children_ready' ELSE '' END ELSE lacks END AS reason FROM mp JOIN lk ON lk.id = root_id LEFT JOIN gr ON gr.id = root_id)"""


@query("d14_bulk_review", f"""WITH {_BULK} SELECT rv.id, root_id, rs.status, reason = '' AS ok, nullif(reason, '') AS reason FROM rs JOIN rv ON rv.id = root_id OR rv.parent_id = root_id UNION ALL SELECT -1, NULL, 'approved', false, 'not_found'""")
def d14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.bulk_review(*_bulk(spark, sf_dir))


@query("d14_bulk_counts", f"""WITH {_BULK} SELECT (SELECT count(*) FROM ch) AS requested, (SELECT count(*) FROM rs WHERE reason = '') AS succeeded, (SELECT count(*) FROM rs WHERE reason <> '') + 1 AS failed""")
def d14_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, changes = _bulk(spark, sf_dir)
    return Q.bulk_counts(Q.bulk_review(rows, changes), changes)


def _bulk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _review(spark, sf_dir)
    changes = rows.where("id % 2 = 0").select("id", F.when(F.col("id") % 3 == 0, "rejected").otherwise("approved").alias("status"))
    return rows, changes.union(rows.agg(F.lit(-1).cast("long").alias("id"), F.lit("approved").alias("status")))


_SPACE = f"""{_REVIEW}, se AS (SELECT DISTINCT subject_id AS paper_id, length(question_type) * 10 + subject_id AS id, question_type AS name FROM bank_items),
rs AS (SELECT rv.*, coalesce(rv.section_id, (SELECT max(se.id) FROM se WHERE se.paper_id = rv.paper_id AND se.name = trim(rv.section_name))) AS sec, lower(concat_ws(chr(10), question_no, trim(section_name), group_stem, material_text, stem_text, answer_text, analysis_text)) AS search FROM rv),
ro AS (SELECT id, coalesce(parent_id, id) AS root_id FROM rv), tg AS (SELECT l_partkey AS question_id, l_suppkey % 25 + 1 AS point_id, CASE l_returnflag WHEN 'A' THEN 'confirmed' WHEN 'N' THEN 'suggested' ELSE 'rejected' END AS status FROM lineitem),
sh AS (SELECT root_id, coalesce(array_to_string(list_sort(list(DISTINCT point_id) FILTER (WHERE tg.status = 'confirmed')), ','), '') AS confirmed, coalesce(array_to_string(list_sort(list(DISTINCT point_id) FILTER (WHERE tg.status = 'suggested')), ','), '') AS suggested FROM tg JOIN ro ON ro.id = tg.question_id GROUP BY 1),
ch AS (SELECT parent_id, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY sort_order, id) AS ids, bool_or(ai_status = 'passed') AS passed, bool_or(contains(lower(concat_ws(chr(10), question_no, stem_text, answer_text, analysis_text)), 'red')) AS red FROM rv WHERE parent_id IS NOT NULL GROUP BY 1)"""


def _workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS question_id", "l_suppkey % 25 + 1 AS point_id", "CASE l_returnflag WHEN 'A' THEN 'confirmed' WHEN 'N' THEN 'suggested' ELSE 'rejected' END AS status")
    sections = table(spark, sf_dir, "bank_items").selectExpr("subject_id AS paper_id", "length(question_type) * 10 + subject_id AS id", "question_type AS name").distinct()
    return Q.workspace(_review(spark, sf_dir), tags, sections)


@query("d11_workspace", f"WITH {_SPACE} SELECT rs.id, status, sec AS section_id, coalesce(ids, '') AS children, confirmed, suggested FROM rs LEFT JOIN ch ON ch.parent_id = rs.id LEFT JOIN sh ON sh.root_id = rs.id WHERE rs.parent_id IS NULL")
def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.coalesce(F.array_join(F.transform("children", lambda c: c["child_id"]), ","), F.lit(""))
    return _workspace(spark, sf_dir).select("id", "status", "section_id", ids.alias("children"), F.array_join("confirmed", ",").alias("confirmed"), F.array_join("suggested", ",").alias("suggested"))


@query("d12_filter_workspace", f"WITH {_SPACE} SELECT 'passed' AS filter, rs.id FROM rs LEFT JOIN ch ON ch.parent_id = rs.id WHERE rs.parent_id IS NULL AND (ai_status = 'passed' OR passed) AND (contains(search, 'red') OR red) UNION ALL SELECT 'section', id FROM rs WHERE parent_id IS NULL AND status = 'odd' AND sec = 1")
def d12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _workspace(spark, sf_dir)
    a, b = Q.filter_workspace(rows, ai_status="passed", keyword=" RED"), Q.filter_workspace(rows, status="odd", section_id=1)
    return a.select(F.lit("passed").alias("filter"), "id").unionByName(b.select(F.lit("section").alias("filter"), "id"))
