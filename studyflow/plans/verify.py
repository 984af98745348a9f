"""Queries of content verification: assistant turns are checked against the other turns of their conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import verify as X
from .base import query, table

_BASE = """dc AS (SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1),
so AS (SELECT conv_id AS doc_id, turn AS label, length(text) % 5 AS file_id, conv_id % 3 AS chunk_id, text FROM conversations WHERE role <> 'assistant'), st AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY label, text) AS source FROM so GROUP BY 1),
cx AS (SELECT doc_id, trim(regexp_replace(text, '[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')) AS x FROM dc),
cy AS (SELECT doc_id, CASE WHEN regexp_matches(x, '[。！？!?；;] ') THEN string_split(regexp_replace(x, '([。！？!?；;]) ', '\\1' || chr(10), 'g'), chr(10)) ELSE regexp_split_to_array(x, '[。！？!?；;]') END AS p FROM cx),
cs AS (SELECT doc_id, list_transform(list_filter(list_transform(p, lambda x: trim(x, ' -' || chr(9))), lambda x: length(x) >= 8), lambda x: substr(x, 1, 220))[1:8] AS c FROM cy),
cl AS (SELECT doc_id, (generate_subscripts(c, 1) - 1)::INT AS claim_no, unnest(c) AS text FROM cs),
ci AS (SELECT doc_id, claim_no, CASE WHEN claim_no = 4 THEN -1 ELSE (SELECT min(label) FROM so WHERE so.doc_id = cl.doc_id) END AS label, CASE WHEN claim_no % 2 = 0 THEN claim_no % 5 END AS file_id, CASE WHEN claim_no % 3 = 1 THEN 1 END AS chunk_id FROM cl WHERE (doc_id + claim_no) % 7 > 0),
cc AS (SELECT doc_id, count(*) AS claims, count(*) FILTER (WHERE (doc_id + claim_no) % 7 = 0) AS missing,
  (SELECT count(*) FROM ci WHERE ci.doc_id = cl.doc_id AND NOT (EXISTS (SELECT 1 FROM so WHERE so.doc_id = ci.doc_id AND so.label = ci.label) AND (file_id IS NULL OR EXISTS (SELECT 1 FROM so WHERE so.doc_id = ci.doc_id AND so.file_id = ci.file_id)) AND (chunk_id IS NULL OR EXISTS (SELECT 1 FROM so WHERE so.doc_id = ci.doc_id AND so.chunk_id = ci.chunk_id)))) AS invalid FROM cl GROUP BY 1)"""
_ENTAIL = r"""tk AS (SELECT doc_id, claim_no, list_distinct(regexp_extract_all(text, '[\x{4E00}-\x{9FA5}]{2,}|[A-Za-z0-9]{3,}')[1:12]) AS t FROM cl),
tf AS (SELECT doc_id, claim_no, unnest(t) AS w FROM tk), te AS (SELECT tf.doc_id, claim_no, count(*) FILTER (WHERE contains(coalesce(source, ''), w))::DOUBLE / count(*) AS share FROM tf LEFT JOIN st ON st.doc_id = tf.doc_id GROUP BY 1, 2),
en AS (SELECT cl.doc_id, cl.claim_no, round_even(coalesce(share, 0), 2) AS score, coalesce(share, 0) >= 0.35::DOUBLE AS entailed FROM cl LEFT JOIN te ON te.doc_id = cl.doc_id AND te.claim_no = cl.claim_no)"""
_NUMBERS = r"""nu AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\p{Nd}+(?:\.\p{Nd}+)?%?')) AS number FROM cl), nn AS (SELECT nu.doc_id, count(*) AS numbers, count(*) FILTER (WHERE NOT contains(source, number)) AS unsupported FROM nu JOIN st ON st.doc_id = nu.doc_id GROUP BY 1)"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role <> 'assistant'").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("label"), (F.length("text") % 5).alias("file_id"), (F.col("conv_id") % 3).alias("chunk_id"), "text")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract_claims(_docs(spark, sf_dir))


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _sources(spark, sf_dir).groupBy("doc_id").agg(F.min("label").alias("first"))
    rows = _claims(spark, sf_dir).where((F.col("doc_id") + F.col("claim_no")) % 7 > 0).join(first, "doc_id", "left")
    return rows.select("doc_id", "claim_no", F.when(F.col("claim_no") == 4, -1).otherwise(F.col("first")).alias("label"), F.expr("CASE WHEN claim_no % 2 = 0 THEN claim_no % 5 END").alias("file_id"), F.expr("CASE WHEN claim_no % 3 = 1 THEN 1 END").alias("chunk_id"))


@query("i1_claims", f"WITH {_BASE} SELECT * FROM cl")
def i1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir)


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.check_citations(_claims(spark, sf_dir), _citations(spark, sf_dir), _sources(spark, sf_dir))


@query("i2_citations", f"WITH {_BASE} SELECT *, missing = 0 AND invalid = 0 AS passed FROM cc")
def i2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir)


@query("i3_entailment", f"WITH {_BASE}, {_ENTAIL} SELECT * FROM en")
def i3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.entail(_claims(spark, sf_dir), _sources(spark, sf_dir))


@query("i4_numbers", f"WITH {_BASE}, {_NUMBERS} SELECT * FROM nn")
def i4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.check_numbers(_claims(spark, sf_dir), _sources(spark, sf_dir))


@query("i5_years", r"""WITH d AS (SELECT o_orderkey AS doc_id, 'in ' || year(o_orderdate) || ' and ' || (year(o_orderdate) + o_orderkey % 3) || ' of 4' || (year(o_orderdate) - o_orderkey % 2) || '7' AS text, 'from ' || year(o_orderdate) AS source FROM orders),
y AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '(?:19|20)\p{Nd}{2}'))) AS r, list_sort(list_distinct(regexp_extract_all(source, '(?:19|20)\p{Nd}{2}'))) AS s FROM d)
SELECT doc_id, array_to_string(r, ',') AS result_years, array_to_string(s[1:20], ',') AS source_years FROM y WHERE len(s) > 0 AND NOT list_has_all(s, r)""")
def i5(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", "year(o_orderdate) AS y")
    docs = o.select("doc_id", F.concat(F.lit("in "), "y", F.lit(" and "), F.col("y") + F.col("doc_id") % 3, F.lit(" of 4"), F.col("y") - F.col("doc_id") % 2, F.lit("7")).alias("text"))
    found = X.check_years(docs, o.select("doc_id", F.lit(1).alias("label"), F.concat(F.lit("from "), "y").alias("text")))
    return found.select("doc_id", F.array_join("result_years", ",").alias("result_years"), F.array_join("source_years", ",").alias("source_years"))


# Conversations name few years, so the report reads texts with a year each: the claims' last turn, and the sources' first.
_REPORT = f"""yd AS (SELECT doc_id, text || ' ' || (2000 + doc_id % 4) AS text FROM dc), ys AS (SELECT doc_id, source || ' 2001 2003' AS source FROM st),
yr AS (SELECT yd.doc_id FROM yd JOIN ys ON ys.doc_id = yd.doc_id WHERE len(list_filter(list_distinct(regexp_extract_all(yd.text, '(?:19|20)[0-9][0-9]')), lambda y: NOT list_contains(regexp_extract_all(ys.source, '(?:19|20)[0-9][0-9]'), y))) > 0),
md AS (SELECT doc_id, ['a model says so', ' '] AS mi, ['ask again', 'cite a source for every claim'] AS ms FROM dc WHERE doc_id % 3 = 0), we AS (SELECT doc_id, count(*) FILTER (WHERE NOT entailed) AS weak FROM en GROUP BY 1),
rp AS (SELECT dc.doc_id, st.doc_id IS NOT NULL AS strict, coalesce(missing + invalid, 0) > 0 AS bad, coalesce(weak, 0) AS weak, coalesce(unsupported, 0) AS uns, yr.doc_id IS NOT NULL AS yc, coalesce(mi, []) AS mi, coalesce(ms, []) AS ms
  FROM dc LEFT JOIN st ON st.doc_id = dc.doc_id LEFT JOIN cc ON cc.doc_id = dc.doc_id LEFT JOIN we ON we.doc_id = dc.doc_id LEFT JOIN nn ON nn.doc_id = dc.doc_id LEFT JOIN yr ON yr.doc_id = dc.doc_id LEFT JOIN md ON md.doc_id = dc.doc_id),
rl AS (SELECT doc_id, strict, list_filter(list_concat([CASE WHEN strict AND bad THEN 'claims with missing or invalid citations' END, CASE WHEN strict AND weak > 0 THEN weak || ' claims not supported by the sources' END, CASE WHEN yc THEN 'years that the sources do not have' END,
  CASE WHEN strict AND uns > 0 THEN uns || ' numbers not found in the sources' END], mi, [CASE WHEN NOT strict THEN 'no authoritative sources, so unverified' END]), lambda x: trim(x) <> '') AS i,
  list_filter(list_concat([CASE WHEN strict AND bad THEN 'cite a source for every claim' END, CASE WHEN strict AND weak > 0 THEN 'tone down, or add closer sources' END, CASE WHEN yc THEN 'filter the sources by year and edition' END,
  CASE WHEN strict AND uns > 0 THEN 'check the numbers before use' END], CASE WHEN strict AND bad THEN ms[1:1] ELSE ms END, [CASE WHEN NOT strict THEN 'upload sources for a strict review' END]), lambda x: x IS NOT NULL) AS s FROM rp)"""


@query("i6_review_report", f"""WITH {_BASE}, {_ENTAIL}, {_NUMBERS}, {_REPORT} SELECT doc_id, strict, array_to_string(i, '; ') AS issues, array_to_string(s, '; ') AS suggestions,
  array_to_string(list_transform(i, lambda x, k: 'ri_' || k || '_' || substr(sha1(x || '|' || coalesce(s[k], '') || '|' || (k - 1)), 1, 10)), ',') AS item_ids, len(i) = 0 AS passed FROM rl""")
def i6(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, sources, docs = _claims(spark, sf_dir), _sources(spark, sf_dir), _docs(spark, sf_dir)
    dated = docs.withColumn("text", F.concat("text", F.lit(" "), 2000 + F.col("doc_id") % 4))
    years = X.check_years(dated, X.source_text(sources).select("doc_id", F.lit(0).alias("label"), F.concat("source", F.lit(" 2001 2003")).alias("text")))
    model = docs.where("doc_id % 3 = 0").select("doc_id", F.array(F.lit("a model says so"), F.lit(" ")).alias("issues"), F.array(F.lit("ask again"), F.lit("cite a source for every claim")).alias("suggestions"))
    found = X.review_report(docs, sources, _checked(spark, sf_dir), X.entail(claims, sources), X.check_numbers(claims, sources), years, model)
    return found.select("doc_id", "strict", F.array_join("issues", "; ").alias("issues"), F.array_join("suggestions", "; ").alias("suggestions"), F.array_join("item_ids", ",").alias("item_ids"), "passed")


@query("i7_locate_quotes", "SELECT doc_id, 0::BIGINT AS quote_no, 0::BIGINT AS hit, CASE WHEN length(text) < 30 THEN -1 ELSE position(substr(text, 30, 40) IN text) - 1 END::BIGINT AS start, length(substr(text, 30, 40)) AS length FROM documents")
def i7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return X.locate_quotes(docs, docs.select("doc_id", F.lit(0).cast("long").alias("quote_no"), F.substring("text", 30, 40).alias("quote")))


@query("i7_replace_quotes", """WITH d AS (SELECT doc_id, substr(text, 30, 12) AS q, text FROM documents), p AS (SELECT *, CASE WHEN length(q) > 0 THEN position(q IN text) ELSE 0 END AS k FROM d)
SELECT doc_id, '## 标题备选' || chr(10) || q || chr(10) || '## 正文' || chr(10) || CASE WHEN k > 0 THEN substr(text, 1, k - 1) || '[new]' || substr(text, k + length(q)) ELSE text END AS text, (k > 0)::BIGINT AS replaced FROM p""")
def i7_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 30, 12).alias("quote"), "text")
    whole = docs.select("doc_id", F.concat(F.lit("## 标题备选\n"), "quote", F.lit("\n## 正文\n"), "text").alias("text"))
    return X.replace_quotes(whole, docs.select("doc_id", F.lit(0).alias("quote_no"), "quote", F.lit("[new]").alias("replacement")))


@query("i8_top_k", """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS score FROM q, embeddings WHERE vec_id <> query_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s) WHERE place <= 5""")
def i8(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return X.top_k_similar(vectors.where("vec_id % 50 = 0"), vectors)


@query("i9_publish_fields", """WITH d AS (SELECT doc_id, '# ' || source || chr(10) || chr(10) || trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS body, source, lang FROM documents),
u AS (SELECT doc_id, unnest(list_transform(string_split(body, chr(10)), lambda x: regexp_replace(regexp_replace(trim(x), '^#{1,6}\\s*', ''), '^[ \\-*|]+|[ \\-*|]+$', '', 'g'))) AS p, generate_subscripts(string_split(body, chr(10)), 1) AS o FROM d),
f AS (SELECT doc_id, trim(regexp_replace(p, '\\s+', ' ', 'g')) AS p, min(o) AS o FROM u WHERE length(p) >= 8 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS r FROM f),
g AS (SELECT doc_id, string_agg(p, chr(10) ORDER BY r) AS points, min_by(p, r) AS first FROM r WHERE r <= 8 GROUP BY 1),
t AS (SELECT d.*, coalesce(points, '') AS points, CASE WHEN first IS NULL THEN '高频考点' WHEN length(first) <= 22 THEN first ELSE substr(first, 1, 22) || '...' END AS pt FROM d LEFT JOIN g ON g.doc_id = d.doc_id)
SELECT doc_id, body, points, lang || ',' || source || ',备考,考前冲刺,小红书学习' AS tags, concat_ws('|', source || '别再死记硬背：一篇理顺', lang || ' · ' || source || '考前速记版，收藏就能背', pt || '，很多人第一遍都会错', lang || '备考人必看：' || source || '核心笔记', lang || ' · ' || source || '一图流复盘，考前快速过一遍') AS titles FROM t""")
def i9(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("intro\n## 正文\n"), "text", F.lit("\n## 封面文案\ncover\n## 正文\nmore"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), text.alias("text"), F.concat("lang", F.lit(" #")).alias("subject"), F.lit(None).cast("string").alias("category"), F.col("source").alias("chapter"))
    found = X.publish_fields(docs.withColumn("subject", F.regexp_replace("subject", " #$", "")))
    return found.select("doc_id", "body", F.array_join("points", "\n").alias("points"), F.array_join("tags", ",").alias("tags"), F.array_join("titles", "|").alias("titles"))
