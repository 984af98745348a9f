"""Small fixed inputs, mostly Chinese exam texts, with results worked out by hand."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from studyflow.functions import fields
from studyflow.functions import text as X
from studyflow.operators import bank, learning, ops, outlines, questions, tagging, taxonomy, verify
from studyflow.sources import files


def cell(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "number,stem,want",
    [
        ("12", "第12题．", "第12题."), ("12", "12、 下列  说法\r\n第3页\n\n\n\n（　　）", "下列 说法\n\n（ ）"), ("1", "1. 2. 两个编号", "两个编号"), ("3", "2024年1月", "2024年1月"), (None, "（____）是资产", "(____)是资产"),
        ("1", "１．全角​数字", "全角数字"), ("1", "正文\n微信号：abc\nwww.x.com\n", "正文"), ("1", None, ""),
    ],
)
def test_stems(spark, number, stem, want):
    assert cell(spark, fields.stem(F.col("s"), F.col("n")), s=stem, n=number) == want


@pytest.mark.parametrize(
    "kind,given,want",
    [
        ("single_choice", ["A. 甲", "B、乙", "C)丙", "a. 甲", "无", "第3页", "D 丁"], ["甲", "乙", "丙", "丁"]), ("判断题", ["x"], ["正确", "错误"]), (" Judge ", [], ["正确", "错误"]), ("single_choice", None, []),
        ("single_choice", ["Apple pie", "A apple", "Ｂ．  全角\n换行"], ["Apple pie", "A apple", "全角 换行"]),
    ],
)
def test_options(spark, kind, given, want):
    assert cell(spark, fields.options(F.col("o"), F.col("k")), o=given, k=kind) == want if given is not None else spark.range(1).select(fields.options(F.lit(None).cast("array<string>"), F.lit(kind)).alias("x")).first().x == want


@pytest.mark.parametrize(
    "kind,given,want",
    [
        ("multiple_choice", "答案：C、A、C", "CA"), ("single_choice", "正确答案 b", "B"), ("judge", "不正确", "错误"), ("judge", "√", "正确"), ("judge", "×", "错误"), ("short_answer", "参考答案：  见  解析", "见 解析"), ("single_choice", " 暂无 答案 ", None), ("judge", "也许", "也许"),
        ("short_answer", None, None),
    ],
)
def test_answers(spark, kind, given, want):
    assert cell(spark, fields.answer(F.col("a"), F.col("k")), a=given, k=kind) == want


@pytest.mark.parametrize("given,want", [("解析：因为甲", "因为甲"), ('{"要点":"一","":["二","三\\n四"]}', "要点：一\n\n1. 二\n2. 三\n   四"), ('["", null]', None), ("[不是 JSON", "[不是 JSON"), (" 略", "略"), ("暂无解析", None), (None, None)])
def test_analyses(spark, given, want):
    assert cell(spark, fields.analysis(F.col("a")), a=given) == want


def test_fields_change_the_open_state(spark):
    rows = [("1", "single_choice", "1. 题", ["A. 甲"], "答案：A", None, "parsed"), ("2", "short_answer", "题", [], "答", None, "parsed"), ("3", "short_answer", "3. ", None, None, None, "approved")]
    q = spark.createDataFrame(rows, "question_no string, question_type string, stem_text string, options array<string>, answer_text string, analysis_text string, parse_status string")
    got = {r.question_no: (r.stem_text, r.options, r.answer_text, r.parse_status, r.changed) for r in questions.normalize_fields(q).collect()}
    assert got == {"1": ("题", ["甲"], "A", "normalized", True), "2": ("题", [], "答", "parsed", False), "3": ("3. ", [], None, "approved", False)}


def test_predictions(spark):
    doc = {"sections": [
        {"title": " ", "shared_stem": "共用  材料", "questions": [{"question_no": " 1 ", "stem_text": "题一", "options": ["A. 甲", " "], "analysis_text": ["一", "二"]}, {"question_no": "2", "stem_text": " "}]},
        {"title": "二", "section_type": "case", "sort_order": 5, "questions": [
            {"question_no": "3", "group_stem": "组干", "material_text": "材料", "subquestions": [{"question_no": "(1)", "stem_text": "问一", "answer_text": "A"}, {"question_no": "(2)", "stem_text": ""}]},
            {"question_no": "4", "node_role": "group", "subquestions": []}]},
        {"title": "没有题"},
    ]}
    found = questions.normalize_prediction(spark.createDataFrame([(1, json.dumps(doc, ensure_ascii=False)), (2, "not json"), (3, None)], "paper_id long, prediction string"))
    rows = {r.paper_id: r for r in found.collect()}
    assert rows[2].sections == [] and rows[3].question_count == 0
    one, two = rows[1].sections
    assert (one.title, one.section_type, one.sort_order, one.question_count, two.title, two.section_type, two.sort_order, rows[1].question_count) == ("分区 1", "mixed", 1, 1, "二", "case", 5, 2)
    q = one.questions[0]
    assert (q.question_no, q.node_role, q.question_type, q.group_stem, q.options) == ("1", "standalone", "mixed", "共用 材料", ["A. 甲"]) and json.loads(q.analysis_text) == ["一", "二"]
    g = two.questions[0]
    assert len(two.questions) == 1 and (g.node_role, g.question_type, g.stem_text, [c.stem_text for c in g.subquestions]) == ("group", "material_analysis", "组干", ["问一"])
    flat = [(r.question_no, r.parent_no, r.node_role, r.material, r.sort_order) for r in questions.flatten_questions(found).orderBy("sort_order").collect()]
    assert flat == [("1", None, "standalone", None, 1), ("3", None, "group", None, 2), ("(1)", "3", "subquestion", "组干", 3)]


def test_export_of_a_paper(spark):
    items = spark.createDataFrame(
        [
            (1, None, "standalone", "single_choice", None, None, "资料一 甲公司。选择", ["A. 甲", "B. 乙"], "A", "因为", "QB1", "active"), (2, None, "standalone", "single_choice", None, None, "资料一 甲公司。再选", [], None, None, "QB2", "active"),
            (3, None, "group", "material_analysis", "共用题干", "材料", "共用题干", [], None, None, "QB3", "active"), (4, 3, "subquestion", "short_answer", None, None, "问二", [], "答二", None, "QB4", "active"), (5, 3, "subquestion", "short_answer", None, None, "问一", [], None, "解", "QB5", "active"),
        ],
        "id long, parent_id long, node_role string, question_type string, group_stem string, material_text string, stem_text string, options array<string>, answer_text string, analysis_text string, question_uid string, status string",
    )
    links = spark.createDataFrame([(1, 9, 11, "1", "active", 1), (2, 9, 12, None, "active", 1), (3, 9, 13, "3", "active", 1), (4, 9, 14, None, "active", 1), (5, 9, 15, None, "active", 1)], "bank_question_id long, paper_id long, source_question_id long, question_no string, status string, created_at long")
    one = lambda k, no, raw, section="单选题": (k, no, None, section, k, None, None, None, ["C. 丙"] if k == 12 else None, "B" if k == 12 else None, None, raw)
    reviews = spark.createDataFrame([one(11, "1", "选择\nA. 甲"), one(12, "2", "再选\n答案：B"), one(13, "3", None, "别的"), one(14, "(2)", None), one(15, "(1)", None)], "source_question_id long, review_no string, review_type string, section_name string, sort_order long, review_stem string, review_group_stem string, review_material string, review_options array<string>, review_answer string, review_analysis string, source_raw_text string")
    records = bank.export_records(items, links, reviews)
    papers = spark.createDataFrame([(9, " 试卷/一 ")], "paper_id long, name string")
    block = lambda title, a, b: f":::answer-block{title}\n答案：{a}\n\n解析：{b}\n:::\n\n"
    head = "#  试卷/一 \n\n## 单选题\n\n### 共用材料\n\n资料一 甲公司。\n\n"
    inline = bank.export_markdown(records, papers).first()
    assert inline.file == "试卷_一-inline.md"
    assert inline.markdown == (head + "第1题 选择\n\nA. 甲\nB. 乙\n\n" + block("", "A", "因为") + "第2题 再选\n\nA. 丙\n\n" + block("", "B", "暂无") + "## 材料题\n\n### 共用材料\n\n共用题干\n\n材料：\n\n材料\n\n第(1)题 问一\n\n" + block("", "暂无", "解") + "第(2)题 问二\n\n" + block("", "答二", "暂无")).rstrip() + "\n"
    late = bank.export_markdown(records, papers, "appendix").first()
    assert late.file == "试卷_一-appendix.md" and late.markdown.count(":::answer-block 第") == 4 and late.markdown.index("## 答案与解析") > late.markdown.index("问二") and "\n:::answer-block\n" not in late.markdown


def test_fingerprints_know_options_without_their_labels(spark):
    rows = [(k, None, None, "standalone", "single_choice", None, None, " 题  干", options, "A") for k, options in enumerate([["A. 甲", "B. 乙"], ["甲", "乙"], ["乙", "甲"]])]
    items = spark.createDataFrame(rows, "id long, parent_id long, question_no string, node_role string, question_type string, group_stem string, material_text string, stem_text string, options array<string>, answer_text string")
    got = {r.id: r for r in bank.bank_fingerprint(items).collect()}
    assert got[0].fingerprint == got[1].fingerprint == got[1].legacy != got[0].legacy and got[2].fingerprint != got[0].fingerprint and got[0].uid == "QB" + got[0].fingerprint[:24]


def test_a_merge_knows_items_by_their_legacy_fingerprint(spark):
    items = spark.createDataFrame([("old", None, 4, "before")], "fingerprint string, subject_id long, category_id long, stem_text string")
    links = spark.createDataFrame([("q", 7, "old", "removed")], "source_type string, source_question_id long, fingerprint string, status string")
    incoming = spark.createDataFrame([("new", "old", "q", 1, 5, 6, "a", 1), ("new", "old", "q", 2, 8, 9, "b", 2)], "fingerprint string, legacy string, source_type string, source_question_id long, subject_id long, category_id long, stem_text string, ord long")
    merged, all_links = bank.bank_merge(items, links, incoming)
    assert [(r.fingerprint, r.subject_id, r.category_id, r.stem_text, r.first_source_question_id, r.created, r.source_count) for r in merged.collect()] == [("old", 5, 4, "b", 2, False, 2)] and {(r.source_question_id, r.status) for r in all_links.collect()} == {(7, "removed"), (1, "active"), (2, "active")}


def test_quotes(spark):
    text = "封面\n## 正文\n他说：“**税率 13%**”，再说税率13％。\n## 标签建议\n税率 13%"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, 0, "税率13%"), (1, 1, "封面"), (1, 2, '"税率13%",'), (1, 3, "")], "doc_id long, quote_no long, quote string")
    got = {}
    for r in verify.locate_quotes(docs, quotes, body_only=True).collect():
        got.setdefault(r.quote_no, []).append(text[r.start : r.start + r.length] if r.start >= 0 else None)
    assert got == {0: ["税率 13%", "税率13％"], 1: [None], 2: ["“**税率 13%**”，"], 3: [None]}
    change = spark.createDataFrame([(1, 0, "税率13%", "13 个点"), (1, 1, "封面", "x")], "doc_id long, quote_no long, quote string, replacement string")
    assert [(r.text, r.replaced) for r in verify.replace_quotes(docs, change).collect()] == [(text.replace("税率 13%", "13 个点", 1), 1)]
    every = verify.replace_quotes(docs, change, every=True).first()
    assert every.replaced == 2 and every.text.endswith("## 标签建议\n税率 13%") and "税率13％" not in every.text
    assert verify.replace_quotes(docs.union(spark.createDataFrame([(2, None)], docs.schema)), change).where("doc_id = 2").first().replaced == 0


@pytest.mark.parametrize("mode,want", [("hybrid", ["no authoritative sources, so unverified"]), ("document_only", ["no documents to check against"]), ("llm_only", ["no model to review with"])])
def test_reviews_without_sources(spark, mode, want):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    none = lambda spec: spark.createDataFrame([], spec)
    found = verify.review_report(docs, none("doc_id long, label long"), none("doc_id long, missing long, invalid long"), none("doc_id long, entailed boolean"), none("doc_id long, unsupported long"), none("doc_id long, result_years array<string>"), mode=mode).first()
    assert (found.issues, found.strict, found.passed) == (want, False, False) and found.item_ids[0].startswith("ri_1_") and len(found.suggestions) == 1


def test_publication_fields(spark):
    docs = spark.createDataFrame([(1, "标题", "## 标题备选\n一\n## 正文\n> 未核验：x\n- 第一条要点内容足够长\n短\n## 封面文案\n其他内容其他内容", "会计", "", None), (2, "T", None, None, None, None)], "doc_id long, title string, text string, subject string, category string, chapter string")
    got = {r.doc_id: r for r in verify.publish_fields(docs.na.fill("", ["text"])).collect()}
    assert got[1].points == ["第一条要点内容足够长"] and got[1].tags == ["会计", "备考", "考前冲刺", "小红书学习"] and len(got[1].titles) == 5 and got[1].titles[2] == "第一条要点内容足够长，很多人第一遍都会错" and got[1].body.startswith("# 标题\n\n> 未核验")
    assert len(got[2].titles) == 5 and got[2].points == []


def test_trees_have_no_depth_limit_and_no_cycles(spark):
    chain = spark.createDataFrame([(k, k - 1 if k else None, f"n{k}") for k in range(45)] + [(100, 999, "orphan")], "id long, parent_id long, name string")
    got = {r.id: (r.root_id, r.level, r.path) for r in taxonomy.walk(chain).collect()}
    assert len(got) == 45 and got[44] == (0, 45, "/".join(f"n{k}" for k in range(45)))
    below = taxonomy.descendants(chain, chain.where("id = 20").select("id"))
    assert {r.id: r.distance for r in below.collect()} == {k: k - 20 for k in range(20, 45)}
    ring = spark.createDataFrame([(1, 2, "a"), (2, 1, "b"), (3, None, "c")], "id long, parent_id long, name string")
    with pytest.raises(ValueError, match="cycle"):
        taxonomy.walk(ring)
    assert {r.id for r in taxonomy.descendants(ring, ring.where("id = 1").select("id")).collect()} == {1, 2}


def test_outlines_by_number_and_depth(spark):
    text = ["1 总论", "1.1.1 太深", "## 概述", "2 其他", "1.2 补", "## 节", "- 条", "3.1 无章"]
    lines = spark.createDataFrame([("d", k, t) for k, t in enumerate(text)], "doc_id string, line_no int, text string")
    got = [(r.level, r.name, r.parent_line, r.path) for r in outlines.resolve_outline(outlines.parse_chapters(lines)).orderBy("line_no").collect()]
    assert got == [(1, "总论", None, "总论"), (2, "太深", 0, "总论/太深"), (2, "概述", 0, "总论/概述"), (1, "其他", None, "其他"), (2, "补", 0, "总论/补"), (2, "节", 3, "其他/节"), (1, "条", None, "条"), (2, "无章", None, None)]


def test_textbooks(spark):
    text = ["目录", "第一章 总论....... 1", "考点1：会计主体", "一、会计分期", "（二）会计 分期", "3. 货币计量。", "本章小结", "第2章 税收与征管", "第一章　总论", "知识点 纳税人"]
    lines = spark.createDataFrame([("d", k, t) for k, t in enumerate(text)], "doc_id string, line_no int, text string")
    got = {}
    for r in taxonomy.textbook_outline(lines, max_points=4).orderBy("chapter_no", "point_no").collect():
        got.setdefault(r.chapter, []).append(r.point)
    assert got == {"第一章 总论": ["会计主体", "会计分期", "总论基本概念", "总论核心规则"], "第2章 税收与征管": ["纳税人", "税收核心考点", "征管核心考点", "税收与征管征税范围"]}
    books = spark.createDataFrame([(1, "《审计》教材", "财会", None, []), (2, "数学书", "数学", "", ["x"]), (3, "书", "天文", None, None)], "doc_id long, title string, subject string, category string, tags array<string>")
    known = spark.createDataFrame([(2, "数学", ["数列"]), (1, "审计", ["审计基础", "审计 基础", "证据"])], "ord int, keyword string, chapters array<string>")
    made = {}
    for r in taxonomy.metadata_outline(books, known, max_points=1).orderBy("chapter_no").collect():
        made.setdefault(r.doc_id, []).append((r.chapter, r.point))
    assert made[1] == [("审计基础", "审计基础目标与程序"), ("证据", "证据目标与程序")] and made[2] == [("数列", "数列基本概念")] and [c for c, _ in made[3]] == ["天文基础知识", "天文核心概念", "天文规则与方法", "天文综合应用", "天文真题与易错点"]


def test_points_bind_to_sections(spark):
    chapters = spark.createDataFrame([(1, None, "第一章"), (2, 1, "一节"), (3, None, "第二章")], "id long, parent_id long, name string")
    drafts = spark.createDataFrame([("第一章", "一 节", "甲", 1), ("第一章", None, "乙", 2), ("第一章", "二节", "丙", 3), ("第二章", "", "丁", 4), ("第三章", None, "戊", 5)], "chapter_name string, section_name string, name string, ord long")
    bound, wrong = taxonomy.bind_points(chapters, drafts)
    assert {(r.parent_id, r.name) for r in bound.collect()} == {(2, "甲"), (3, "丁")} and {r.name: r.violation for r in wrong.collect()} == {"乙": "section_missing", "丙": "unknown_section", "戊": "unknown_chapter"}


def test_model_tags_keep_ranks(spark):
    tags = spark.createDataFrame([(1, 10, "confirmed", "primary", "manual", 1, 1.0), (1, 11, "suggested", "secondary", "rule", 2, 0.5), (2, 12, "suggested", "primary", " AI ", 1, 0.9), (3, 13, "suggested", "primary", "rule", 1, 0.4)], "question_id long, point_id long, status string, relation_type string, source string, rank_no long, confidence double")
    asked = spark.createDataFrame([(1, 7, None, "standalone"), (2, 7, None, "standalone"), (3, 7, None, "standalone"), (4, 7, None, "group"), (5, 7, 4, "child")], "id long, paper_id long, parent_id long, node_role string")
    points = spark.createDataFrame([(p,) for p in range(10, 16)], "id long")
    incoming = spark.createDataFrame([(1, 10, 1, 0.8), (1, 14, 2, 1.7), (1, 99, 0, 0.1), (2, 15, 1, 0.5), (3, 99, 1, 0.5)], "question_id long, point_id long, ord long, confidence double")
    targets = tagging.tag_targets(asked, tags)
    merged = sorted((r.question_id, r.point_id, r.status, r.relation_type, r.rank_no, r.confidence) for r in tagging.merge_external_tags(tags, incoming, points, targets).collect())
    assert merged == [(1, 10, "confirmed", "primary", 1, 1.0), (1, 14, "suggested", "secondary", 2, 1.0), (2, 12, "suggested", "primary", 1, 0.9), (3, 13, "suggested", "primary", 1, 0.4)]
    assert [tuple(r) for r in tagging.external_tag_counts(incoming, points, targets).collect()] == [(7, 3, 1, 2, 1)]
    assert {r.question_id for r in tagging.tag_targets(asked, tags, asked.where("id = 4").select("id")).collect()} == {5}


def test_copies_keep_what_they_cannot_type(spark, tmp_path):
    from pyspark.sql import types as T

    rows = spark.createDataFrame([(1, "5", '{"k": 1}'), (2, "x", "{broken"), (3, None, None)], "id long, n string, doc string")
    target = T._parse_datatype_string("id bigint, n int, doc map<string,int>, more string")
    copied, missing = files.copy_columns(rows, target)
    assert missing == ["more"] and {r.id: (r.n, r.doc, r.raw) for r in copied.collect()} == {1: (5, {"k": 1}, {}), 2: (None, None, {"n": "x", "doc": "{broken"}), 3: (None, None, {})}
    assert tuple(files.copy_counts(copied, missing).first()) == (3, 1, 1)
    samples = spark.createDataFrame([(k, f"old{k}") for k in range(6)], "paper_id long, sample string")
    files.write_dataset(samples, f"file://{tmp_path}/set", buckets=2)
    again = files.write_dataset(spark.createDataFrame([(2, "new"), (9, "new")], samples.schema), f"file://{tmp_path}/set", buckets=2)
    assert sorted(map(tuple, again.collect())) == [(0, "old0"), (1, "old1"), (2, "new"), (3, "old3"), (4, "old4"), (5, "old5"), (9, "new")]


def test_reasons_and_submission(spark):
    answers = spark.createDataFrame([(1, [" careless", "careless", "guess", "concept_unclear", "memory_unstable", "misread_question", "calculation_error"])], "session_id long, reasons array<string>")
    assert [r.reason for r in learning.reason_counts(answers).orderBy("place").collect()] == ["careless", "concept_unclear", "memory_unstable", "misread_question"]
    sessions = spark.createDataFrame([(1, 5, "in_progress"), (2, 5, "submitted"), (3, 5, "in_progress")], "id long, user_id long, status string").withColumns({"started_at": F.lit("2024-01-01 00:00:00").cast("timestamp"), "submitted_at": F.lit(None).cast("timestamp")})
    given = spark.createDataFrame([(1, True, False), (1, True, True), (2, True, False), (2, False, None)], "session_id long, answered boolean, is_correct boolean")
    got = {r.id: (r.items, r.answered, r.correct, r.wrong, r.accuracy, r.incomplete, r.can_submit) for r in learning.session_summary(sessions, given).collect()}
    assert got == {1: (2, 2, 1, 0, 50.0, 0, True), 2: (2, 1, 0, 1, 0.0, 1, False), 3: (0, 0, 0, 0, 0.0, 0, False)}


def test_boards_show_empty_columns(spark):
    topics = spark.createDataFrame([(1, "idea", None), (2, "idea", "2024-01-02"), (3, "other", None)], "topic_id long, status string, scheduled_date string")
    got = [(r.status, r.topics, r.dated) for r in ops.board(topics).orderBy("place").collect()]
    assert got == [("idea", 2, 1), ("planned", 0, 0), ("generated", 0, 0), ("needs_changes", 0, 0), ("awaiting_confirm", 0, 0), ("approved", 0, 0)] and ops.board(topics, None).count() == 2


def test_tables_of_parsed_pages_are_taken_out(spark):
    given = 'a<div style="text-align: center;"><table>1</table></div>\n|x|\nb'
    tables = F.array(F.struct(F.lit("<table>1</table>").alias("html"), F.lit("|x|").alias("markdown")), F.struct(F.lit(" ").alias("html"), F.lit(None).cast("string").alias("markdown")))
    assert cell(spark, X.strip_tables(F.col("t"), tables), t=given) == "a\n\nb"


def test_drawn_places_are_a_permutation(spark):
    """Every candidate comes once, whatever the number; draws differ by request and seed, and repeat."""
    cands = spark.range(1, 101).selectExpr("id * 10 AS id", "CASE WHEN id <= 37 THEN 1 WHEN id <= 99 THEN 2 ELSE 3 END AS subject_id").withColumn("ord", F.expr("row_number() OVER (PARTITION BY subject_id ORDER BY id)").cast("long"))
    requests = spark.createDataFrame([(1, 1, 100, "random"), (2, 1, 100, "chapter"), (3, 2, 50, "random"), (4, 3, 5, "random"), (5, 9, 5, "random"), (6, 1, 4, "paper"), (7, 1, 0, "random"), (8, 1, 3, "wrong_book")], "request_id long, subject_id int, n int, kind string")
    draw = lambda seed: {k: [q for _, q in sorted(v)] for k, v in _by_request(learning.assemble_sessions(cands, requests, seed)).items()}
    got = draw(1)
    assert sorted(got[1]) == sorted(got[2]) == [10 * k for k in range(1, 38)] and got[1] != got[2] and got[1] != sorted(got[1])
    assert len(set(got[3])) == 50 and set(got[3]) <= {10 * k for k in range(38, 100)} and got[4] == [1000] and 5 not in got and 7 not in got
    assert got[6] == [10, 20, 30, 40] and got[8] == [10, 20, 30] and draw(1) == got and draw(2)[1] != got[1]
    many = spark.range(3000).selectExpr("id AS request_id", "1 AS subject_id", "1 AS n", "'random' AS kind")
    first = learning.assemble_sessions(cands, many).groupBy("question_id").count().collect()
    assert len(first) == 37 and max(r["count"] for r in first) < 150 and min(r["count"] for r in first) > 30


def _by_request(df):
    out = {}
    for r in df.collect():
        assert r.score == 1
        out.setdefault(r.request_id, []).append((r.item_no, r.question_id))
    return out


def test_tagging_stays_in_its_subject(spark):
    points = spark.createDataFrame([(1, 1, 1, "收入确认"), (2, 2, 1, "收入确认"), (3, 1, 2, "收入"), (4, 1, None, "成本")], "id long, subject_id long, category_id long, name string").selectExpr("*", "array() AS aliases", "array() AS keywords", "'' AS path", "NULL AS chapter_id")
    texts = spark.createDataFrame([(1, 1, None, "关于收入确认与成本"), (2, 2, None, "收入确认"), (3, 1, 1, "收入确认"), (4, 3, None, "收入确认"), (5, None, None, "收入确认"), (6, 1, 1, None)], "id long, subject_id long, category_id long, body string")
    for most in (tagging.AUTOMATON_TERMS, 0):
        got = sorted((r.id, r.point_id) for r in tagging.match_points(texts, tagging.term_table(points), most).collect())
        assert got == [(1, 1), (1, 3), (1, 4), (2, 2), (3, 1)]


def test_reconcile_papers_and_assets(spark):
    jobs = spark.createDataFrame([
        (1, "paper_parse", "paper", "completed", '{"paper_id": 1}', None), (2, "paper_parse", "paper", "failed", '{"paper_id": "1"}', None), (3, "paper_parse", "paper", "completed", '{"paper_id": 2, "execution_mode": "ocr_only"}', "{}"), (4, "paper_parse", "paper", "running", '{"paper_id": 3}', None),
        (5, "paper_parse", "paper", "cancelled", '{"paper_id": 4}', None), (6, "tagging", "paper", "failed", '{"paper_id": 4}', None), (7, "paper_parse", "paper", "completed", "[]", None), (8, "paper_parse", "paper", "completed", '{"paper_id": 5}', '{"execution_mode": "ocr_only"}'), (9, "paper_parse", "paper", "pending", '{"paper_id": 99}', None),
    ], "id long, job_type string, scope_type string, status string, scope string, summary string")
    papers = spark.createDataFrame([(1, 10, "tagging"), (2, 10, "draft"), (3, 11, "parsed"), (4, 12, "saving"), (5, None, "parsed"), (6, 13, "draft")], "id long, asset_id long, status string")
    assets = spark.createDataFrame([(10, "parsing", "running"), (11, "parsed", "completed"), (12, None, None), (13, "x", "running")], "id long, parse_status string, ocr_status string")
    p, a = ops.reconcile(jobs, papers, assets)
    assert sorted((r.id, r.status, r.changed) for r in p.collect()) == [(1, "parse_failed", True), (2, "source_ready", True), (3, "parse_failed", True), (4, "saving", False), (5, "parsed", False), (6, "draft", False)]
    assert sorted((r.id, r.parse_status, r.ocr_status, r.changed) for r in a.collect()) == [(10, "source_ready", "completed", True), (11, "failed", "failed", True), (12, None, None, False), (13, "x", "running", False)]
    assert sorted((r.id, r.stage) for r in ops.fail_interrupted(jobs).where("progress = 100").collect()) == [(4, "failed"), (9, "failed")]


def test_a_merge_overwrites_content_and_moves_links(spark):
    items = spark.createDataFrame([("k", 1, 2, "group", "judge", "old", ["x"], "A", 9)], "fingerprint string, subject_id long, category_id long, node_role string, question_type string, stem_text string, options array<string>, answer_text string, first_source_question_id long")
    links = spark.createDataFrame([("q", 3, "k", 70, "1", "active")], "source_type string, source_question_id long, fingerprint string, paper_id long, question_no string, status string")
    rows = [("k", "l", "q", 4, 5, 6, None, "single_choice", "new", ["A. 甲", "B、甲", "C. 乙"], None, 80, "2", 1), ("m", "n", "q", 3, None, None, "sub", "judge", "other", ["yes"], "B", 81, None, 2)]
    incoming = spark.createDataFrame(rows, "fingerprint string, legacy string, source_type string, source_question_id long, subject_id long, category_id long, node_role string, question_type string, stem_text string, options array<string>, answer_text string, paper_id long, question_no string, ord long")
    merged, all_links = bank.bank_merge(items, links, incoming)
    got = {r.fingerprint: r for r in merged.collect()}
    assert (got["k"].node_role, got["k"].question_type, got["k"].stem_text, got["k"].options, got["k"].answer_text, got["k"].first_source_question_id, got["k"].subject_id, got["k"].source_count) == ("standalone", "single_choice", "new", ["甲", "乙"], None, 4, 1, 1)
    assert (got["m"].node_role, got["m"].options, got["m"].created, got["m"].source_count) == ("sub", ["正确", "错误"], True, 1)
    assert sorted((r.source_question_id, r.fingerprint, r.paper_id, r.question_no) for r in all_links.collect()) == [(3, "m", 81, None), (4, "k", 80, "2")]
