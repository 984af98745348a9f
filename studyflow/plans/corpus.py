"""Queries of corpus cleaning and line classifiers.  Documents are pages of their source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import marks as M
from ..functions.tables import stored
from ..functions.text import markdown_to_text, strip_images, strip_tables, token_estimate
from ..operators import corpus as X
from ..operators import lineclf as C
from .base import query, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("page_number"), "text")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.to_lines(_docs(spark, sf_dir))


_LINES = """l0 AS (SELECT source AS document_id, doc_id AS page_number, string_split(text, chr(10)) AS ls FROM documents),
l1 AS (SELECT document_id, page_number, (generate_subscripts(ls, 1) - 1)::INT AS line_no, unnest(ls) AS raw FROM l0),
l AS (SELECT document_id, page_number, line_no, regexp_replace(regexp_replace(raw, '^\\s*>+\\s?', ''), '^[\\s\\x{00A0}\\x{3000}]+|[\\s\\x{00A0}\\x{3000}]+$', '', 'g') AS text FROM l1),
ln AS (SELECT * FROM l WHERE text <> '')"""
def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\x{{00A0}}\\x{{3000}}]+|[\\s\\x{{00A0}}\\x{{3000}}]+$', '', 'g')"


def _like(x: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '{p}')" for p in patterns) + ")"


def _has(x: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _n(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def _bare(x: str) -> str:
    return f"regexp_replace({x}, '[\\s\\x{{00A0}}\\x{{3000}}]+', '', 'g')"


def _one(x: str) -> str:
    return f"regexp_replace({_strip(x)}, '[\\s\\x{{00A0}}\\x{{3000}}]+', ' ', 'g')"


def _high(x: str) -> str:
    return f"({_like(x, M.QUESTION, M.SECTION, M.OPTION)} OR {_n(x, M.LABEL)} >= 2 OR {_has(x, ('答案', '解析'))})"


_PAGE_KEY = f"regexp_replace({_one('text')}, '[0-9]+', '#', 'g')"
_KEY = f"regexp_replace({_PAGE_KEY}, '^[>#\\-*\\s]+', '')"
_NOISE = _LINES + f""", kd AS (SELECT *, {_KEY} AS key FROM ln),
rn AS (SELECT document_id, key, count(*)::BIGINT AS hits, count(DISTINCT page_number) AS pages FROM kd WHERE key <> '' AND length(key) <= 80 GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT page_number) >= 2 AND NOT {_high('key')})"""


@query("b1_normalize")
def b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.normalized(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text"))


@query("b2_to_lines", f"WITH {_LINES} SELECT * FROM ln")
def b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir)


@query("b3_reading_order", "SELECT l_orderkey AS document_id, l_suppkey AS page_number, l_partkey AS block_id, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY CASE WHEN l_linenumber % 3 > 0 THEN l_quantity ELSE 1e9 END, CASE WHEN l_linenumber % 3 > 0 THEN l_extendedprice ELSE 1e9 END, l_partkey) AS place FROM lineitem")
def b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS document_id", "l_suppkey AS page_number", "l_partkey AS block_id", "CASE WHEN l_linenumber % 3 > 0 THEN l_extendedprice END AS x", "CASE WHEN l_linenumber % 3 > 0 THEN l_quantity END AS y")
    return X.reading_order(blocks).select("document_id", "page_number", "block_id", "place")


@query("b4_crop_margins", "SELECT l_orderkey AS document_id, l_partkey AS block_id, NOT (l_quantity + 2 <= max(l_quantity + 2) OVER (PARTITION BY l_orderkey) * (0.1::DOUBLE + 0.01::DOUBLE) OR l_quantity >= max(l_quantity + 2) OVER (PARTITION BY l_orderkey) * (1 - 0.1::DOUBLE - 0.01::DOUBLE)) AS kept FROM lineitem")
def b4(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS document_id", "1 AS page_number", "l_partkey AS block_id", "l_quantity AS y", "l_quantity + 2 AS y2")
    return X.crop_margins(blocks, 0.1, 0.1).select("document_id", "block_id", "kept")


@query("b5_repeated_noise", f"WITH {_NOISE} SELECT * FROM rn")
def b5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.repeated_noise(_lines(spark, sf_dir))


_BARE_KEY = _bare("page_key")
_STRUCTURED = f"({_like(_BARE_KEY, *M.STRUCTURE)} OR {_like('page_key', *M.STRUCTURE_LINE)})"
_PAGES = _LINES + f""", pk AS (SELECT *, {_PAGE_KEY} AS page_key FROM ln), pn AS (SELECT document_id, page_key FROM pk WHERE length(page_key) <= 80 AND NOT {_STRUCTURED} GROUP BY 1, 2 HAVING count(DISTINCT page_number) >= 3)"""


@query("b6_noise_pages", f"WITH {_PAGES} SELECT document_id, page_number, line_no, text, EXISTS (SELECT 1 FROM pn WHERE pn.document_id = pk.document_id AND pn.page_key = pk.page_key) AS removed FROM pk")
def b6(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, gone = X.repeated_noise_pages(_lines(spark, sf_dir))
    rows = kept.withColumn("removed", F.lit(False)).unionByName(gone.withColumn("removed", F.lit(True)))
    return rows.select("document_id", "page_number", "line_no", "text", "removed")


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return X.keep_entry_numbers(X.classify_lines(lines, X.repeated_noise(lines)))


def _cut(mark: str) -> str:
    before = _strip(f"substr(text, 1, strpos(text, '{mark}') - 1)")
    noise = f"({_like('b', M.SYMBOLS)} OR {_has('b', M.HINTS)} OR {_has('lower(b)', ('http', 'www.'))} OR (length(b) <= 12 AND {_n('b', M.SIGN)} <= 4))"
    return f"(SELECT CASE WHEN strpos(text, '{mark}') > 1 AND b <> '' AND NOT {_like('p', M.OPTION)} AND {noise} THEN {_strip(f"substr(text, strpos(text, '{mark}'))")} END FROM (SELECT p, {_bare('p')} AS b FROM (SELECT {before} AS p)))"


_CLASS = _NOISE + f""", tr AS (SELECT document_id, page_number, line_no, CASE WHEN {_has('text', M.PREFIXED)} THEN coalesce({', '.join(map(_cut, M.PREFIXED))}, text) ELSE text END AS text FROM ln), tk AS (SELECT *, {_KEY} AS key FROM tr),
cr AS (SELECT tk.*, CASE WHEN rn.key IS NOT NULL THEN 'repeated_noise' WHEN {_high('text')} OR {_like('text', M.ENTRY)} THEN NULL WHEN {_like('text', M.PAGE_NUMBER, M.PAGE_OF, M.SHORT_NUMBER)} THEN 'page_number'
  WHEN {_like('text', M.SYMBOLS)} THEN 'symbols' WHEN {_has('text', M.HINTS)} THEN 'hint' WHEN {_like('text', '^[0-9]{2,}$')} THEN NULL WHEN {_n('text', M.SIGN)} <= 1 AND length(text) <= 8 THEN 'noise' END AS reason FROM tk LEFT JOIN rn ON rn.document_id = tk.document_id AND rn.key = tk.key),
cn AS (SELECT *, {_like(_bare('text'), M.SHORT_NUMBER)} AS num, {_like('text', M.ENTRY)} AS entry, {_like('text', M.ENTRY)} AND {_n('text', M.LABEL)} < 2 AND NOT {_like('text', M.ANSWER, M.ANALYSIS)} AS whole FROM cr),
cw AS (SELECT *, coalesce(lead(entry) OVER p, false) AS near, count(*) FILTER (WHERE reason IS NULL AND NOT num) OVER p AS g, coalesce(last_value(CASE WHEN reason IS NULL AND NOT num THEN whole END IGNORE NULLS) OVER p, false) AS after FROM cn WINDOW p AS (PARTITION BY document_id, page_number ORDER BY line_no)),
cl AS (SELECT * REPLACE (CASE WHEN num AND (near OR (after AND row_number() OVER (PARTITION BY document_id, page_number, g, num ORDER BY line_no) = 1)) THEN NULL ELSE reason END AS reason) FROM cw)"""


@query("b7_classify_lines", f"WITH {_CLASS} SELECT document_id, page_number, line_no, text, reason FROM cl")
def b7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("document_id", "page_number", "line_no", "text", "reason")


@query("b8_entry_numbers", """WITH l AS (SELECT l_orderkey AS document_id, l_suppkey % 3 AS page_number, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS line_no,
  CASE l_linenumber % 4 WHEN 0 THEN '借：' || p_name WHEN 1 THEN (l_quantity::INT * 7)::VARCHAR WHEN 2 THEN '贷: ' || p_type || ' 8' ELSE p_name END AS text FROM lineitem JOIN part ON p_partkey = l_partkey),
n AS (SELECT *, regexp_matches(text, '^[0-9]{1,3}$') AS num, regexp_matches(text, '^[借贷][:：]') AS entry FROM l),
w AS (SELECT *, coalesce(lead(entry) OVER p, false) AS near, count(*) FILTER (WHERE NOT num) OVER p AS g, coalesce(last_value(CASE WHEN NOT num THEN entry END IGNORE NULLS) OVER p, false) AS after FROM n WINDOW p AS (PARTITION BY document_id, page_number ORDER BY line_no))
SELECT document_id, page_number, line_no, NOT num OR near OR (after AND row_number() OVER (PARTITION BY document_id, page_number, g, num ORDER BY line_no) = 1) AS kept FROM w""")
def b8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers between accounting entries, made of order lines."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    lines = rows.selectExpr(
        "l_orderkey AS document_id", "l_suppkey % 3 AS page_number", "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS line_no",
        "CASE l_linenumber % 4 WHEN 0 THEN concat('借：', p_name) WHEN 1 THEN CAST(CAST(l_quantity AS INT) * 7 AS STRING) WHEN 2 THEN concat('贷: ', p_type, ' 8') ELSE p_name END AS text",
    )
    none = lines.select("document_id", F.lit("").alias("key")).where("false")
    return X.keep_entry_numbers(X.classify_lines(lines, none)).select("document_id", "page_number", "line_no", F.col("reason").isNull().alias("kept"))


@query("b9_split_lines", """SELECT l_orderkey AS document_id, (l_linenumber - 1) * 0 + unnest(range(7)) AS part_no, unnest(['下列关于' || p_name || '的说法正确的是()。', 'A. ' || p_brand, 'B. ' || p_type, 'C. ' || p_size::VARCHAR, '答案:A', '解析:' || p_name || '。', '2. ' || p_type || '是下列']) AS text,
  l_linenumber AS line_no, l_partkey AS part_key FROM lineitem JOIN part ON p_partkey = l_partkey""")
def b9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense lines with a question, its options, answer and analysis, and the next question, made of parts: each is cut into seven."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    lines = rows.selectExpr("l_orderkey AS document_id", "l_linenumber AS line_no", "l_partkey AS part_key", "concat('下列关于', p_name, '的说法正确的是()。A. ', p_brand, 'B、 ', p_type, ' C) ', p_size, '答案:A解析:', p_name, '。2. ', p_type, '是下列') AS text")
    return X.split_lines(lines).select("document_id", "line_no", "part_key", "part_no", "text")


@query("b10_clean_pages")
def b10(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = X.to_lines(_docs(spark, sf_dir), normalize=True)
    return X.clean_pages(X.classify_lines(lines, X.repeated_noise(lines)))


@query("b11_cleanup_report", f"""WITH {_CLASS} SELECT cl.document_id, count(*) AS lines_in, sum(length(text))::BIGINT AS chars_in, count(reason) AS removed, coalesce((SELECT count(*) FROM rn WHERE rn.document_id = cl.document_id), 0) AS repeated FROM cl GROUP BY 1""")
def b11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).select("document_id", "lines_in", "chars_in", "removed", "repeated")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    noise = X.repeated_noise(lines)
    rows = X.keep_entry_numbers(X.classify_lines(lines, noise))
    return X.cleanup_report(rows, X.folded_pages(rows), noise)


@query("b11_full_report")
def b11_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)


@query("b11_reasons", f"WITH {_CLASS} SELECT document_id, reason, count(*) AS n FROM cl WHERE reason IS NOT NULL GROUP BY ALL")
def b11_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.reason_counts(_classified(spark, sf_dir))


def _capped(worth: tuple[tuple[float, float], ...], x: str) -> str:
    out = "0::DOUBLE"
    for p, (most, each) in zip(X.SIGNALS, worth):
        n = _n(x, p)
        out += f" + least({most}::DOUBLE, " + (f"{n} * {each!r}::DOUBLE)" if each < 1 / 100 else f"round({n} * {each}::DOUBLE, 9))")
    return out


def _short(most: int) -> str:
    return f"len(list_filter(ls, lambda x: {_n('x', M.SIGN)} <= {most}))"


@query("b12_quality_score", f"""WITH {_CLASS}, r AS (SELECT page_number, count(*) AS lines_in, count(reason) AS removed FROM cl GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {_strip('x')} <> '') AS ls, coalesce(lines_in, 0) AS lines_in, coalesce(removed, 0) AS removed FROM documents LEFT JOIN r ON page_number = doc_id)
SELECT doc_id AS document_id, CASE WHEN {_strip('text')} = '' THEN 0 ELSE round_even(round(greatest(0::DOUBLE, least(1::DOUBLE, 0.18::DOUBLE + ({_capped(X.WORTH, 'text')})
  - (least(0.2::DOUBLE, removed::DOUBLE / greatest(lines_in, 1) * 0.18::DOUBLE) + least(0.18::DOUBLE, {_short(1)}::DOUBLE / greatest(len(ls), 1) * 0.18::DOUBLE)))), 9), 2) END AS score FROM d""")
def b12(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _classified(spark, sf_dir).groupBy(F.col("page_number").alias("document_id")).agg(F.count(F.lit(1)).alias("lines_in"), F.count("reason").alias("removed"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.coalesce("text", F.lit("")).alias("text"))
    return X.quality_score(docs.join(counts, "document_id", "left").na.fill(0, ["lines_in", "removed"]))


def _parse(x: str, ls: str) -> str:
    signs = f"len(list_filter({ls}, lambda x: {_n('x', M.SIGN)} <= 3))"
    return f"CASE WHEN {_strip(x)} = '' THEN 0 ELSE greatest(0::DOUBLE, round_even(round(({_capped(X.PARSE_WORTH, _strip(x))}) - least(2::DOUBLE, {signs}::DOUBLE / greatest(len({ls}), 1) * 2), 9), 2)) END"


def _ls(x: str) -> str:
    return f"list_filter(string_split({x}, chr(10)), lambda x: {_strip('x')} <> '')"


@query("b13_pick_best", f"""WITH s AS (SELECT doc_id, text, substr(text, 1, (length(text) * (doc_id % 3) / 2)::BIGINT) AS t2 FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS text FROM documents)),
k AS (SELECT doc_id, text, t2, {_ls('text')} AS l1, {_ls('t2')} AS l2, {_n('text', M.SIGN)} >= 24 AS r1, {_n('t2', M.SIGN)} >= 24 AS r2 FROM s), z AS (SELECT doc_id, r1, r2, {_parse('text', 'l1')} AS s1, {_parse('t2', 'l2')} AS s2 FROM k)
SELECT doc_id AS document_id, CASE WHEN (r2, s2) > (r1, s1) THEN s2 ELSE s1 END AS score, (r2, s2) > (r1, s1) AS second FROM z""")
def b13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id AS document_id", "CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS text")
    other = docs.select("document_id", F.substr("text", F.lit(1), F.expr("CAST(bround(length(text) * (document_id % 3) / 2) AS INT)")).alias("text"))
    return X.pick_best(docs, other).select("document_id", "score", "second")


@query("b14_should_clean", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN false ELSE doc_id % 3 = 0 OR doc_id % 4 = 1 END AS clean FROM documents")
def b14(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = F.when(F.col("doc_id") % 4 == 1, "Paddle-Structure").otherwise("plain")
    return table(spark, sf_dir, "documents").select("doc_id", X.should_clean(provider, F.col("doc_id") % 3 == 0, F.col("doc_id") % 10 == 0).alias("clean"))


_MD = "'![x](y.png) [a](b)' || chr(10) || '## |a|' || chr(10) || '```' || chr(10) || 'x' || chr(10) || '```' || chr(10) || text"
_PLAIN = "regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', '', 'g'), '!\\[[^\\]]*\\]\\([^)]+\\)', ' ', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g')"
_PLAIN = f"replace(regexp_replace({_PLAIN}, '(?m)^[>#\\-*\\s|]+', '', 'g'), '|', ' ')"


@query("b15_markdown_to_text", f"SELECT doc_id, {_strip(f"regexp_replace({_PLAIN}, '\\n{{3,}}', chr(10) || chr(10), 'g')")} AS text FROM (SELECT doc_id, {_MD} AS text FROM documents)")
def b15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", markdown_to_text(F.concat(F.lit("![x](y.png) [a](b)\n## |a|\n```\nx\n```\n"), "text")).alias("text"))


@query("b15_strip_markup", f"SELECT doc_id, {_strip("regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM (SELECT doc_id, regexp_replace('a' || chr(10) || {_strip("regexp_replace(regexp_replace(text, '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")}, '^$', '') AS text FROM documents)")
def b15_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and tables put before the texts are gone again."""
    image = F.concat(F.lit("![x](imgs/a.png)<img class='p' src=\"imgs/b.png\" />imgs/c.png\n"), "text")
    tables = F.array(F.struct(F.lit("<table>1</table>").alias("html"), F.lit("|1|").alias("markdown")))
    return table(spark, sf_dir, "documents").select("doc_id", strip_tables(F.concat(F.lit('a<div style="text-align: center;"><table>1</table></div>|1|\n'), strip_images(image)), tables).alias("text"))


@query("b16_token_estimate", "SELECT doc_id, (len(regexp_extract_all(text, '[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{F900}-\\x{FAFF}]')) + ceil((length(text) - len(regexp_extract_all(text, '[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{F900}-\\x{FAFF}]')))::DOUBLE / 4))::BIGINT AS tokens FROM documents")
def b16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


_CJK = "len(regexp_extract_all(text, '[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{F900}-\\x{FAFF}]'))"


def _tokens(x: str) -> str:
    cjk = _CJK.replace("text", x)
    return f"({cjk} + ceil((length({x}) - {cjk})::DOUBLE / 4))::BIGINT"


@query("b17_context_budget", f"""WITH s AS (SELECT conv_id, sum({_tokens('text')})::BIGINT AS n FROM conversations WHERE role <> 'user' GROUP BY 1), q AS (SELECT conv_id, max(text) AS notes FROM conversations WHERE role = 'user' GROUP BY 1),
r AS (SELECT q.conv_id, notes, CASE WHEN q.conv_id % 5 = 0 THEN 'Source content: ' || notes WHEN q.conv_id % 5 = 1 THEN 'two columns' END AS layout, coalesce(n, 0) AS n FROM q LEFT JOIN s ON s.conv_id = q.conv_id),
t AS (SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN {_tokens("layout")} ELSE n + {_tokens("concat_ws(chr(10), nullif(notes, ''), layout)")} END AS tokens FROM r) SELECT conv_id AS request_id, tokens, tokens > 400 AS over FROM t""")
def b17(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    requests = turns.where("role = 'user'").groupBy(F.col("conv_id").alias("request_id")).agg(F.max("text").alias("notes"))
    requests = requests.selectExpr("*", "CASE request_id % 5 WHEN 0 THEN concat('Source content: ', notes) WHEN 1 THEN 'two columns' END AS layout")
    return X.context_budget(requests, turns.where("role <> 'user'").select(F.col("conv_id").alias("request_id"), "text"), 400)


# Blocks are packed one after another: the chunks that are closed, and the one that is open, with its length. Long blocks lose their ends piece by piece.
_CHUNKS = """d AS (SELECT doc_id AS document_id, coalesce(text, '') AS t FROM documents), b AS (SELECT document_id, list_filter(list_transform(regexp_split_to_array(t, '\\n{2,}'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS bs FROM d WHERE length(t) > 4000),
f AS (SELECT document_id, list_reduce(bs, lambda s, x: CASE WHEN length(x) > 4000 THEN {'out': list_concat(s.out, CASE WHEN s.n > 0 THEN [s.open] ELSE [] END, [x]), 'open': '', 'n': 0} WHEN s.n > 0 AND s.n + length(x) + 2 > 4000 THEN {'out': list_append(s.out, s.open), 'open': x, 'n': length(x) + 2}
  ELSE {'out': s.out, 'open': CASE WHEN s.n > 0 THEN s.open || chr(10) || chr(10) || x ELSE x END, 'n': s.n + length(x) + 2} END, {'out': []::VARCHAR[], 'open': '', 'n': 0::BIGINT}) AS s FROM b),
c AS (SELECT document_id, list_concat(s.out, CASE WHEN s.n > 0 THEN [s.open] ELSE [] END) AS cs FROM f), e AS (SELECT document_id, unnest(cs) AS x, generate_subscripts(cs, 1) AS k FROM c),
z AS (SELECT document_id, k, 0 AS j, NULL::VARCHAR AS piece, x AS rest FROM e UNION ALL SELECT document_id, k, j + 1, substr(rest, 1, cut), substr(rest, cut + 1) FROM (SELECT *, CASE WHEN length(rest) <= 4000 THEN length(rest) ELSE CASE WHEN last > 2000 THEN last ELSE 4000 END END AS cut
  FROM (SELECT *, greatest(CASE WHEN contains(h, chr(10)) THEN 4001 - strpos(reverse(h), chr(10)) ELSE 0 END, CASE WHEN contains(h, '。') THEN 4001 - strpos(reverse(h), '。') ELSE 0 END, CASE WHEN contains(h, '；') THEN 4001 - strpos(reverse(h), '；') ELSE 0 END) AS last FROM (SELECT *, substr(rest, 1, 4000) AS h FROM z))) WHERE rest <> ''),
y AS (SELECT document_id, k, j, regexp_replace(piece, '^\\s+|\\s+$', '', 'g') AS text FROM z WHERE j > 0)"""


@query("b18_chunk", f"WITH RECURSIVE {_CHUNKS} SELECT document_id, 0::BIGINT AS chunk_no, t AS text FROM d WHERE length(t) <= 4000 OR document_id NOT IN (SELECT document_id FROM y WHERE text <> '') UNION ALL SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY k, j) - 1, text FROM y WHERE text <> ''")
def b18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.chunk(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text"), 4000)


def _starts_in(x: str) -> str:
    return _n(x, f"(?m){M.QUESTION}")


_GATED = f"""g AS (SELECT id, chunk_no, document_id, source, cleaned, regexp_matches(cleaned, '{M.SIGN}') AND (length(source) < 200 OR length(cleaned) >= greatest(80, floor(length(source) * 0.25::DOUBLE)))
  AND ({_starts_in('source')} < 3 OR {_starts_in('cleaned')} >= greatest(1, floor({_starts_in('source')} * 0.5::DOUBLE))) AS ok
  FROM (SELECT doc_id AS id, doc_id AS chunk_no, source AS document_id, t AS source, substr(t, 1, ((doc_id % 4) * length(t)) // 8) AS cleaned FROM (SELECT doc_id, source, replace(text, '. ', chr(10) || '1. ') AS t FROM documents)))"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("chunk_no"), F.col("source").alias("document_id"), F.replace("text", F.lit(". "), F.lit("\n1. ")).alias("source"))
    return docs.withColumn("cleaned", F.substr("source", F.lit(1), F.expr("((id % 4) * length(source)) div 8").cast("int")))


@query("b19_retention_gate", f"WITH {_GATED} SELECT id, ok, CASE WHEN ok THEN cleaned ELSE source END AS text FROM g")
def b19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.retention_gate(_chunks(spark, sf_dir))


@query("b19_retention_report", f"""WITH {_GATED}, t AS (SELECT *, length(CASE WHEN ok THEN cleaned ELSE source END) AS n FROM g) SELECT document_id, count(*) AS chunks, count(*) FILTER (WHERE ok) AS used, count(*) FILTER (WHERE NOT ok) AS fell_back,
  sum(length(source))::BIGINT AS input_chars, greatest(sum(n) + 2 * (count(*) FILTER (WHERE n > 0) - 1), 0)::BIGINT AS output_chars, bool_or(ok) AS used_any FROM t GROUP BY 1""")
def b19_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    return X.retention_report(X.retention_gate(chunks), chunks)


@query("b20_preview", "SELECT doc_id, substr(text, 1, 200) AS preview, length(text) > 200 AS truncated FROM documents")
def b20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.preview(F.col("text")).alias("p")).select("doc_id", "p.*")


# Line classifiers: lines of good documents are kept, of others deleted.

def _features(x: str, bare: str, found: list[tuple[str, str]]) -> str:
    size = " ".join(f"WHEN length({bare}) <= {m} THEN 'len:<= {m}'" for m in C.LENGTHS)
    names = ", ".join([f"CASE {size} ELSE 'len:> {C.LENGTHS[-1]}' END", *(f"CASE WHEN {c} THEN '{name}' END" for c, name in found)])
    return f"CASE WHEN {x} = '' THEN ['empty'] ELSE list_filter([{names}], lambda x: x IS NOT NULL) END"


_LINE_FEATURES = _features("t", "b", [
    (_has("t", M.HINTS), "noise_hint"), (_like("t", M.PAGE_NUMBER, M.PAGE_OF), "page_number"), (_like("t", M.SYMBOLS), "symbol_only"), (_like("t", "(?i)https?://|www\\\\."), "url"), (_has("lower(t)", ("<img", "imgs/")), "image_ref"),
    (_like("t", M.OPTION), "option_line"), (_like("t", M.QUESTION), "question_start"), (_like("t", M.SECTION_START), "section_header"), (_has("t", ("答案",)), "answer_marker"), (_has("t", ("解析",)), "analysis_marker"),
    (_like("b", M.SHORT_NUMBER), "digits_only_short"), (f"{_n('b', '[0-9]')}::DOUBLE / greatest(length(b), 1) >= 0.65::DOUBLE", "mostly_digits"), (_like("t", M.HAN), "has_chinese"),
    (f"{_n('b', M.HAN)}::DOUBLE / greatest(length(b), 1) >= 0.45::DOUBLE", "mostly_chinese"), (f"{_n('t', M.LABEL)} >= 2", "dense_options"),
])
_START_FEATURES = _features("t", "b", [
    (_like("t", M.QUESTION), "regex_question_start"), (_like("t", M.SECTION_START), "section_header"), (_like("t", M.OPTION), "option_line"), (_like("t", M.ANSWER_HEAD), "answer_line"), (_like("t", M.ANALYSIS_LINE), "analysis_line"),
    (f"{_n('t', M.LABEL)} >= 2", "dense_options"), (_has("t", ("（）", "()")) + " OR contains(b, '()')", "blank_slot"), (_has("t", C.ASKING), "question_prompt_word"), (_has("t", C.SHARED), "shared_context_word"), (_like("b", M.SHORT_NUMBER), "digits_only"),
])
_ALONE = f"(t = '' OR {_like('t', M.QUESTION, M.SECTION_START, M.OPTION)} OR {_n('t', M.LABEL)} >= 2 OR {_has('t', ('答案', '解析'))})"


def _bayes(features: str, target: str, other: str) -> str:
    """From the rows ``lb`` (id, text, label): features, counts, and the log odds of ``target``."""
    return f""", ft AS (SELECT id, text, label, {features} AS f, {_ALONE} AS alone FROM (SELECT id, text, label, {_one('text')} AS t, {_bare('text')} AS b FROM lb)),
fc AS (SELECT feature, label, count(*) AS n FROM (SELECT label, unnest(f) AS feature FROM ft) GROUP BY ALL), lc AS (SELECT label, count(*) AS n FROM ft GROUP BY 1),
k AS (SELECT coalesce((SELECT n FROM lc WHERE label = '{target}'), 0) AS nt, coalesce((SELECT n FROM lc WHERE label = '{other}'), 0) AS no),
w AS (SELECT feature, ln((coalesce(sum(n) FILTER (WHERE label = '{target}'), 0) + 1)::DOUBLE / (any_value(nt) + 2) / ((coalesce(sum(n) FILTER (WHERE label = '{other}'), 0) + 1)::DOUBLE / (any_value(no) + 2))) AS w FROM fc, k GROUP BY 1),
fs AS (SELECT f, (SELECT sum(w) FROM w WHERE list_contains(u.f, w.feature)) AS s FROM (SELECT DISTINCT f FROM ft) u),
sc AS (SELECT ft.id, ft.text, ft.label, ft.alone, round(ln((nt + 1)::DOUBLE / (nt + no + 2)) - ln((no + 1)::DOUBLE / (nt + no + 2)) + fs.s, 6) AS score FROM ft JOIN fs ON fs.f = ft.f, k)"""


_LABELLED = _LINES + ", lb AS (SELECT concat(page_number, ':', line_no) AS id, text, CASE WHEN quality = 1 THEN 'keep' ELSE 'delete' END AS label FROM ln JOIN labels ON labels.doc_id = page_number)" + _bayes(_LINE_FEATURES, "delete", "keep")
_SCORED = _LABELLED + ", pr AS (SELECT *, score >= 0 AND NOT alone AS predicted FROM sc)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_number"), F.when(F.col("quality") == 1, "keep").otherwise("delete").alias("label"))
    return _lines(spark, sf_dir).join(labels, "page_number").withColumn("id", F.concat("page_number", F.lit(":"), "line_no"))


@query("c1_label_lines", f"""WITH {_LINES}, t AS (SELECT source AS document_id, doc_id AS page_number, substr(text, 1, length(text) // 2) || chr(10) || substr(text, length(text) // 2 + 9) AS target FROM documents),
u AS (SELECT document_id, page_number, {_bare('target')} AS whole, list_filter(list_transform(string_split(target, chr(10)), lambda x: {_bare('x')}), lambda x: length(x) >= 12) AS parts FROM t), b AS (SELECT *, {_bare('text')} AS c FROM ln)
SELECT b.document_id, b.page_number, line_no, CASE WHEN contains(whole, c) OR (length(c) >= 12 AND len(list_filter(parts, lambda x: contains(c, x))) > 0) THEN 'keep' ELSE 'delete' END AS label
FROM b JOIN u ON u.page_number = b.page_number AND u.document_id = b.document_id WHERE whole <> '' AND c <> ''""")
def c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against texts that lack eight characters in the middle."""
    half = "CAST(length(text) div 2 AS INT)"
    targets = _docs(spark, sf_dir).selectExpr("document_id", "page_number", f"concat(substr(text, 1, {half}), '\\n', substr(text, {half} + 9)) AS target")
    return C.label_lines(_lines(spark, sf_dir), targets).select("document_id", "page_number", "line_no", "label")


@query("c2_line_features", f"WITH {_LABELLED} SELECT id, unnest(f) AS feature FROM ft")
def c2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("id", F.explode(C.line_features(F.col("text"))).alias("feature"))


@query("c3_train", f"WITH {_LABELLED} SELECT * FROM fc")
def c3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.train_nb(_labelled(spark, sf_dir))[1]


@query("c4_score", f"WITH {_SCORED} SELECT id, round(score, 4) AS score FROM pr")
def c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    return C.score_nb(rows, *C.train_nb(rows)).select("id", F.round("score", 4).alias("score"))


def _ratio(a: str, b: str) -> str:
    return f"round_even(coalesce(({a})::DOUBLE / nullif({b}, 0), 0), 4)"


@query("c5_evaluate", f"""WITH {_SCORED}, e AS (SELECT count(*) FILTER (WHERE label = 'delete' AND predicted) AS tp, count(*) FILTER (WHERE label <> 'delete' AND predicted) AS fp, count(*) FILTER (WHERE label = 'delete' AND NOT predicted) AS fn, count(*) FILTER (WHERE label <> 'delete' AND NOT predicted) AS tn FROM pr)
SELECT tp, fp, fn, tn, {_ratio('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {_ratio('tp', 'tp + fp')} AS precision, {_ratio('tp', 'tp + fn')} AS recall, {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1 FROM e""")
def c5(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = stored(C.feature_sets(_labelled(spark, sf_dir)))  # a row for each set of features and label
    return C.evaluate_sets(sets, *C.train_sets(sets))


# Question starts: order lines as lines of a paper, of which some are numbered stems that the gold questions have.
_PAPER_LINE = "CASE l_linenumber % 5 WHEN 0 THEN concat('根据上述资料', p_name) WHEN 1 THEN concat(l_linenumber, '. 下列关于', p_name, '的说法（）') WHEN 2 THEN concat('A. ', p_name, ' B. ', p_type) WHEN 3 THEN concat(l_linenumber, '、', p_type) ELSE concat('答案：', p_brand) END"
_PAPER = f"SELECT l_orderkey AS document_id, concat(l_orderkey, ':', l_linenumber, ':', l_partkey, ':', l_suppkey) AS id, {_PAPER_LINE} AS text FROM lineitem JOIN part ON p_partkey = l_partkey"
_GOLD = "SELECT l_orderkey AS document_id, CAST(l_linenumber AS {string}) AS question_no, CASE l_linenumber % 5 WHEN 1 THEN concat(' 下列关于', p_name, '的说法（） ') ELSE p_brand END AS stem_text FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'R'"
_STARTS_SQL = f"""pl AS ({_PAPER}), gq AS ({_GOLD.format(string='VARCHAR')}), gk AS (SELECT DISTINCT document_id, unnest([{_bare(f"question_no || ':' || substr({_strip('stem_text')}, 1, 32)")}, question_no]) AS key FROM gq),
pk AS (SELECT *, CASE WHEN {_like('text', M.QUESTION)} THEN {_bare(f"concat(regexp_extract(text, '^\\s*(?:#+\\s*)?(?:第\\s*)?({M.NUMBER})', 1), CASE WHEN q <> '' THEN ':' || substr(q, 1, 32) END)")} END AS key FROM (SELECT *, {_strip(f"regexp_replace(text, '{M.QUESTION}', '')")} AS q FROM pl)),
lb AS (SELECT id, text, CASE WHEN EXISTS (SELECT 1 FROM gk WHERE gk.document_id = pk.document_id AND gk.key = pk.key) THEN 'question_start' ELSE 'other' END AS label FROM pk WHERE document_id IN (SELECT document_id FROM gq))""" + _bayes(_START_FEATURES, "question_start", "other")


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    lines, gold = (spark.sql(sql.replace("FROM lineitem JOIN part", "FROM {line} JOIN {part}"), line=line, part=part) for sql in (_PAPER, _GOLD.format(string="STRING")))
    return C.label_starts(lines, gold)


@query("c6_start_features", f"WITH {_STARTS_SQL} SELECT id, label, unnest(f) AS feature FROM ft")
def c6_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _starts(spark, sf_dir).select("id", "label", F.explode(C.start_features(F.col("text"))).alias("feature"))


@query("c6_probability", f"WITH {_STARTS_SQL}, p AS (SELECT id, label, 1 / (1 + exp(-greatest(-50, least(50, score)))) AS p FROM sc) SELECT id, label, round(p, 4) AS p, p >= 0.55::DOUBLE AS start FROM p")
def c6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fit_starts(_starts(spark, sf_dir)).select("id", "label", F.round("p", 4).alias("p"), "start")


@query("c7_publish_gate", """SELECT l_suppkey AS run_id, count(*) FILTER (WHERE 1 - l_discount / 2 >= 0.92::DOUBLE) AS samples, round(avg((l_linenumber > 1)::INT::DOUBLE), 6) AS pass_rate, round(avg(1 - l_discount / 2), 6) AS confidence,
  count(*) FILTER (WHERE 1 - l_discount / 2 >= 0.92::DOUBLE) >= 20 AND avg((l_linenumber > 1)::INT::DOUBLE) >= 0.95::DOUBLE AND avg(1 - l_discount / 2) >= 0.92::DOUBLE AND avg((l_linenumber > 1)::INT::DOUBLE) > 0.9::DOUBLE AS publish FROM lineitem GROUP BY 1""")
def c7(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run_id"), (1 - F.col("l_discount") / 2).alias("confidence"), (F.col("l_linenumber") > 1).alias("passed"))
    return C.publish_gate(runs, 0.9)
