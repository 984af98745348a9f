"""Scenarios and invariants that the queries over the fixture do not show."""

from __future__ import annotations

import random
import re
import unicodedata

from pyspark.sql import functions as F

from studyflow.functions import text as X
from studyflow.operators import bank, corpus, exam, learning, lineclf, outlines, questions, structure, tagging, taxonomy, verify
from studyflow.sources import files


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_null_grades_are_wrong_in_the_book_and_answered_in_mastery(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(3), rng.randrange(4), rng.choice([True, False, None]), rng.random() > 0.1, k // 2, k % 5) for k in range(400)]
    answers = spark.createDataFrame(rows, "id long, user_id long, question_id long, is_correct boolean, answered boolean, submitted_at long, session_id long")
    book = {}
    for _, user, question, right, answered, at, _ in sorted(rows, key=lambda r: (r[5], r[0])):
        if not answered:
            continue
        entry = book.get((user, question))
        if right is True:
            if entry:
                book[user, question] = (entry[0], entry[1] + 1)
        else:
            book[user, question] = ((entry[0] if entry else 0) + 1, 0)
    got = {(r.user_id, r.question_id): (r.wrong_count, r.streak) for r in learning.wrong_book(answers).collect()}
    assert got == book
    sessions = spark.createDataFrame([(k, 1 if k else None, "submitted") for k in range(5)], "id long, subject_id long, status string")
    points = spark.createDataFrame([(q, 0) for q in range(4)], "question_id long, point_id long")
    stamped = answers.withColumn("submitted_at", F.timestamp_seconds("submitted_at"))
    found = {r.user_id: (r.answered, r.correct) for r in learning.mastery(stamped, sessions, points).collect()}
    want = {u: (sum(r[4] and r[6] > 0 for r in rows if r[1] == u), sum(r[4] and r[3] is True and r[6] > 0 for r in rows if r[1] == u)) for u in range(3)}
    assert found == want


def test_grades(spark):
    rows = [("single", " a ", "A", True), ("single", "", "A", None), ("single", "B", None, None), ("multiple_choice", "B,A", "AB", True), ("multiple_choice", "A", "AB", False), ("single", "　对 ", "对", True)]
    df = spark.createDataFrame(rows, "t string, a string, e string, want boolean")
    assert all(r.got == r.want for r in df.select("want", learning.grade(F.col("a"), F.col("e"), F.col("t")).alias("got")).collect())


def test_series_metrics_follow_the_formula(spark):
    rng = random.Random(1)
    series = [[rng.randrange(6) for _ in range(rng.randrange(1, 9))] for _ in range(60)]
    df = spark.createDataFrame([(s,) for s in series], "s array<long>").select("s", exam.series_metrics(F.col("s")).alias("m"))
    for r in df.collect():
        s, n = r.s, len(r.s)
        recent, slope = sum(s[-3:]) / len(s[-3:]), (s[-1] - s[0]) / (n - 1) if n > 1 else 0
        raw = 0.5 * s[-1] + 0.3 * recent + 0.2 * max(0, slope)
        present = sum(x > 0 for x in s)
        assert r.m.prediction == round(raw * 0.7 if present <= 1 and s[-1] <= 1 else raw)
        assert r.m.trend == ("rising" if slope >= 0.5 else "falling" if slope <= -0.5 else "stable" if s[-1] > 0 and recent > 0 else "sporadic")
    assert one(spark, exam.series_metrics(F.array().cast("array<long>"))).trend == "stable"


def test_shares_sum_to_one(spark):
    from studyflow.plans.exam import _points

    dist = _points(spark, "/root/testdata/sf0.001")[2]
    assert abs(dist.agg(F.sum("share")).first()[0] - 1) < 0.01


def test_text_functions(spark):
    assert one(spark, X.normalize_text(F.lit("\u200bＡ①❶\u200e\r\n\r\n\r\n\r\nb\t c\x07 "))) == "A①❶\n\nb c"
    assert one(spark, X.markdown_to_text(F.lit("# T\n![a](b)[x](y) **z**|\n```\ncode\n```\n> q"))) == "T\nx **z** \nq"
    assert one(spark, X.strip_images(F.lit("a![i](data:x,y)b ![j](http://h/k.png)\nimgs/z.png  \nc"))) == "ab ![j](http://h/k.png)\n\nc"
    assert one(spark, X.token_estimate(F.lit("中文 abcd"))) == 4


def test_normalize_text_over_the_fixture(spark):
    """Against Python's own NFKC."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("document_id"), F.concat(F.lit("　ﬁ①\r"), "text", F.lit("\t\tＡ\n\n\n\n½ ")).alias("text"))
    keep = {c for a, b in ((0x2460, 0x2473), (0x24EA, 0x24EA), (0x24F5, 0x24FF), (0x2776, 0x2793), (0x3251, 0x325F), (0x32B1, 0x32BF)) for c in map(chr, range(a, b + 1))}

    def want(t):
        t = re.sub("[\u200b-\u200f\u202a-\u202e\ufeff]", "", t)
        t = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ", t)
        t = "".join(c if c in keep else unicodedata.normalize("NFKC", c) for c in t) if keep & set(t) else unicodedata.normalize("NFKC", t)
        return re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", t.replace("\r\n", "\n").replace("\r", "\n"))).strip()

    assert {r.document_id: r.text for r in corpus.normalized(docs).collect()} == {r.document_id: want(r.text) for r in docs.collect()}


DENSE = "1. 下列说法正确的是()。A. 甲B. 乙C. 丙D. 丁答案:A解析:因为甲正确。"


def test_dense_lines_are_cut():
    assert structure.structural_parts(DENSE) == ["1. 下列说法正确的是()。", "A. 甲", "B. 乙", "C. 丙", "D. 丁", "答案:A", "解析:因为甲正确。"]
    assert structure.structural_parts(DENSE + DENSE.replace("1. ", "2. "))[6:8] == ["解析:因为甲正确。", "2. 下列说法正确的是()。"]
    assert structure.structural_parts("A. alone") == ["A. alone"] and structure.structural_parts("按 A. 甲 B. 乙 计") == ["按 A. 甲 B. 乙 计"] and structure.structural_parts("") == []
    assert structure.structural_parts("税率为 3. 5%。") == ["税率为 3. 5%。"] and structure.structural_parts("解析:甲。答案:B") == ["答案:B"]
    assert structure.structural_parts("单项选择题1. 关于资产") == ["单项选择题", "1. 关于资产"]


def test_wrapped_lines_are_joined():
    text = ["单项选择题", "1. 下列各项中,关于会计主体假设的说法", "正确的是()。A. 法律主体必然是会计主体B. 会计主体可以是企业内部部门答案:B解析:会计主体限定核算空间。2. 下列处理正确的是()。A. 甲B. 乙"]
    page = structure.fold_page(text, [None] * 3)
    assert [x.text for x in page.lines] == ["单项选择题", "1. 下列各项中,关于会计主体假设的说法 正确的是()。", "A. 法律主体必然是会计主体", "B. 会计主体可以是企业内部部门", "答案:B", "解析:会计主体限定核算空间。", "2. 下列处理正确的是()。", "A. 甲", "B. 乙"]
    assert (page.merged, page.split) == (1, 7)
    goes_on = lambda a, b: structure.joins(structure.Line.of(a), structure.Line.of(b))
    assert goes_on("短行", "下一行") and not goes_on("字" * 70 + "。", "下一行") and goes_on("字" * 40 + "，", "下一行") and goes_on("字" * 40, "下一行")
    assert not goes_on("字" * 40 + "。", "下一行") and not goes_on("A. 甲", "下一行") and not goes_on("短行", "113")
    assert structure.fold_page([], []).lines == []


def test_pages_lose_noise_and_repeated_footers(spark):
    rows = [("d", 1, "第1页\n单项选择题\nA. 甲 B. 乙 C. 丙 D. 丁\n版权所有"), ("d", 2, "第2页\n答案：A\n版权所有\n根据资料①和资料②，下列说法正确的是（）。")]
    lines = corpus.to_lines(spark.createDataFrame(rows, "document_id string, page_number long, text string"), normalize=True)
    noise = corpus.repeated_noise(lines)
    classified = corpus.classify_lines(lines, noise)
    assert {r.text: r.reason for r in classified.collect()} == {"第1页": "repeated_noise", "第2页": "repeated_noise", "版权所有": "repeated_noise", "单项选择题": None, "A. 甲 B. 乙 C. 丙 D. 丁": None, "答案:A": None, "根据资料①和资料②,下列说法正确的是()。": None}
    folded = corpus.folded_pages(classified)
    assert [r.text for r in corpus.clean_pages(classified).orderBy("page_number", "line_no").collect()] == ["单项选择题", "A. 甲", "B. 乙", "C. 丙", "D. 丁", "答案:A", "根据资料①和资料②,下列说法正确的是()。"]
    r = corpus.cleanup_report(classified, folded, noise).first()
    assert (r.lines_in, r.lines_out, r.removed, r.merged, r.split, r.repeated) == (8, 7, 4, 0, 3, 2)
    signs = 5 + 2 * 4 + 3 + 16  # letters and characters of the kept lines
    assert r.score == round(0.18 + signs / 1200 + 0.12 + 0.04 - min(0.2, 4 / 8 * 0.18), 2)


def test_lines_are_told_apart(spark):
    texts = ["二维码在此", "—— · ——", "3 / 12", "Page 3/12", "12345", "甲 ★", "正文一句话", "借:银行存款", "123", "微信扫描二维码,在线查看 贷:原材料85", "广告 答案:B", "这一行前面的文字很长也不是广告 答案:B"]
    lines = spark.createDataFrame([("d", 1, k, t) for k, t in enumerate(texts)], "document_id string, page_number long, line_no int, text string")
    got = [(r.text, r.reason) for r in corpus.classify_lines(lines, corpus.repeated_noise(lines)).orderBy("line_no").collect()]
    assert got == [(texts[0], "hint"), (texts[1], "symbols"), (texts[2], "page_number"), (texts[3], "page_number"), (texts[4], "page_number"), (texts[5], "noise"), (texts[6], None), (texts[7], None), (texts[8], "page_number"), ("贷:原材料85", None), ("答案:B", None), (texts[11], None)]
    dropped = corpus.classify_lines(lines, corpus.repeated_noise(lines), F.contains("text", F.lit("正文"))).where("reason = 'noise'").select("text").collect()
    assert {r.text for r in dropped} == {texts[5], texts[6]}


def test_repeated_lines_of_exams_stay(spark):
    block = ["第1小题", "A.495", "答案与解析", "答案解析", "慢炖知识铺"]
    lines = spark.createDataFrame([("d", p, k, t) for p in (1, 2) for k, t in enumerate(block)], "document_id string, page_number long, line_no int, text string")
    kept, gone = corpus.repeated_noise_pages(lines, 2)
    assert {r.text for r in kept.collect()} == set(block[:4]) and {r.text for r in gone.collect()} == {"慢炖知识铺"} and kept.columns == lines.columns


def test_chunks_hold_everything():
    text = "\n\n".join("x" * n for n in (1000, 2500, 700, 5, 5)) + "\n\n\n" + "句。" * 6000
    cut = corpus.chunk_text(text, 10)
    assert all(0 < len(c) <= 4000 for c in cut) and "".join(cut).replace("\n", "") == text.replace("\n", "")
    assert cut[:2] == ["x" * 1000 + "\n\n" + "x" * 2500, "x" * 700 + "\n\n" + "xxxxx\n\nxxxxx"] and all(c.endswith("。") for c in cut[2:])
    assert corpus.chunk_text("", 10) == [""] and corpus.chunk_text(" short\n\n", 10) == [" short\n\n"] and corpus.chunk_text("字" * 9000, 4000) == ["字" * 4000, "字" * 4000, "字" * 1000]


def test_naive_bayes_learns(spark):
    rows = [(k, "A good line of words.", "keep") for k in range(30)] + [(100 + k, "***", "delete") for k in range(30)]
    lines = spark.createDataFrame(rows, "id long, text string, label string")
    model = lineclf.train_nb(lines)
    scored = lineclf.score_nb(lines, *model)
    e = lineclf.evaluate(scored, F.col("label") == "delete", F.col("predicted")).first()
    assert (e.tp, e.fp, e.fn, e.tn, e.f1) == (30, 0, 0, 30, 1.0)
    assert lineclf.evaluate_sets(lineclf.feature_sets(lines), *model).first() == e
    assert lineclf.evaluate(scored.where("false"), F.col("label") == "delete", F.col("predicted")).first().f1 == 0.0
    assert lines.where(lineclf.dropped_by(*model)).count() == 30


def test_line_features(spark):
    rows = ["  ", "第 3 页", "12", "A. 甲 B. 乙", "一、单项选择题（每题1分）", "<img src='imgs/a'>", "3. 下列关于（）的计算要求"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, text string")
    got = [(set(r.a), set(r.b)) for r in df.orderBy("k").select(lineclf.line_features(F.col("text")).alias("a"), lineclf.start_features(F.col("text")).alias("b")).collect()]
    assert got[0] == ({"empty"}, {"empty"}) and got[1][0] == {"len:<= 4", "page_number", "has_chinese", "mostly_chinese"} and got[2] == ({"len:<= 4", "page_number", "digits_only_short", "mostly_digits"}, {"len:<= 4", "digits_only"})
    assert got[3] == ({"len:<= 8", "option_line", "dense_options", "has_chinese"}, {"len:<= 8", "option_line", "dense_options"})
    assert got[4][0] == {"len:<= 16", "question_start", "section_header", "has_chinese", "mostly_chinese"} and got[5][0] == {"len:<= 32", "image_ref"}
    assert got[6][1] == {"len:<= 16", "regex_question_start", "blank_slot", "question_prompt_word", "shared_context_word"}


def test_question_starts_are_labelled_by_gold_keys(spark):
    gold = spark.createDataFrame([("p", "1", " 下列 说法"), ("p", "2", "长" * 50), ("p", "", "x"), ("q", "3", "y")], "document_id string, question_no string, stem_text string")
    rows = [("p", "1. 下列说法"), ("p", "2、" + "长" * 40), ("p", "1. 另一题"), ("p", "第2题"), ("p", "正文"), ("r", "3. y"), ("q", "三、y")]
    lines = spark.createDataFrame(rows, "document_id string, text string")
    got = {(r.document_id, r.text): r.label for r in lineclf.label_starts(lines, gold).collect()}
    assert got == {rows[0]: "question_start", rows[1]: "question_start", rows[2]: "other", rows[3]: "question_start", rows[4]: "other", rows[6]: "other"}
    labelled = lineclf.label_starts(lines, gold)
    scored = lineclf.score_starts(labelled, *lineclf.train_nb(labelled, lineclf.start_features))
    assert all(0 <= r.p <= 1 and r.start == (r.p >= 0.55) for r in scored.collect())


def test_tag_matches_keep_the_first_reason(spark):
    points = spark.createDataFrame([(1, "Red Fox", ["fox"], ["animal"], 3, "a/fox"), (2, "x", None, None, None, "")], "id long, name string, aliases array<string>, keywords array<string>, chapter_id long, path string")
    texts = spark.createDataFrame([(1, "the RED FOX ran"), (2, "a fox"), (3, None), (4, "")], "id long, body string")
    got = {r.id: (r.score, r.reason) for r in tagging.match_points(texts, tagging.term_table(points)).collect()}
    assert got == {1: (80, "red fox"), 2: (65, "fox")}


def test_bank_merge_is_idempotent(spark):
    rows = [("f1", "g1", "q", 1, 5, None, "old", 1), ("f1", "g1", "q", 2, 6, 3, "new", 2), ("f2", "g2", "q", 3, 7, None, "x", 3)]
    incoming = spark.createDataFrame(rows, "fingerprint string, legacy string, source_type string, source_question_id long, subject_id long, category_id long, stem_text string, ord long")
    items = spark.createDataFrame([], "fingerprint string, subject_id long, category_id long, stem_text string")
    links = spark.createDataFrame([], "source_type string, source_question_id long, fingerprint string, status string")
    a, la = bank.bank_merge(items, links, incoming)
    b, lb = bank.bank_merge(a.drop("source_count"), la, incoming)
    both = ["fingerprint", "subject_id", "category_id", "stem_text", "first_source_question_id", "source_count"]
    assert sorted(map(tuple, a.select(both).collect())) == sorted(map(tuple, b.select(both).collect())) == [("f1", 5, 3, "new", 2, 2), ("f2", 7, None, "x", 3, 1)]
    assert {r.created for r in a.collect()} == {True} and {r.created for r in b.collect()} == {False} and sorted(map(tuple, la.collect())) == sorted(map(tuple, lb.collect()))


def test_options_and_markdown(spark):
    assert one(spark, bank.option_labels(F.array(F.lit("A. x"), F.lit(" b、y"), F.lit("")))) == ["A. x", "B. y"]


def test_roots_end_in_cycles(spark):
    q = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (10, 11), (11, 10), (20, 99)], "id long, parent_id long")
    got = {r.id: r.root_id for r in questions.roots(q).collect()}
    assert [got[k] for k in (1, 2, 3, 4)] == [1, 1, 1, 1] and got[20] == 20 and got[10] in (10, 11)
    chain = spark.range(60).selectExpr("id", "CASE WHEN id > 0 THEN id - 1 END AS parent_id")
    assert {r.root_id for r in questions.roots(chain).collect()} == {0}


def test_labels_of_deep_and_wide_trees(spark):
    """A chain of 10,000 nodes, a parent of 5,000, and random trees: intervals give what following the parents gives."""
    rng = random.Random(8)
    parent = {k: (k - 1 if k % 10_000 else None) for k in range(10_000)} | {20_000 + k: (20_000 if k else None) for k in range(5_001)} | {40_000 + k: (40_000 + rng.randrange(k) if k and rng.random() < 0.98 else None) for k in range(2_000)} | {90_000: 99_999}
    nodes = spark.createDataFrame(list(parent.items()), "id long, parent_id long")
    labels = taxonomy.stored(taxonomy.tree_labels(nodes))
    up, level = {}, {}
    for k, p in parent.items():
        up[k], level[k] = (up[p], level[p] + 1) if p in parent else (k, 1)
    assert {r.id: (r.root_id, r.level) for r in labels.collect()} == {k: (up[k], level[k]) for k in parent}
    ids = [9_990, 20_000, 40_000, 40_007, 90_000, 41_500]
    want = set()
    for k in parent:
        at, steps = k, 0
        while at is not None and steps < 10_000:
            if at in ids:
                want.add((at, k, steps))
            at, steps = parent.get(at), steps + 1
    got = {(r.of, r.id, r.distance) for r in taxonomy.descendants(nodes, spark.createDataFrame([(k,) for k in ids], "id long"), labels).collect()}
    assert got == want


def test_sync_keeps_review_state(spark):
    old = spark.createDataFrame([(1, "a", "approved"), (1, "b", "rejected"), (2, "c", "approved")], "paper_id long, fingerprint string, review_status string")
    new = spark.createDataFrame([(1, "a", "s1", 1), (1, "a", "s2", 2), (1, "d", "s3", 3)], "paper_id long, fingerprint string, stem string, sort_order long")
    got = {(r.fingerprint): (r.action, r.review_status, r.stem) for r in questions.sync_questions(old, new).collect()}
    assert got == {"a": ("updated", "approved", "s2"), "b": ("deleted", "rejected", None), "d": ("inserted", "pending", "s3")}


def test_outline(spark):
    text = ["第1章 总论", "第一节 概述", "- 要点", "```", "# not", "```", "2.1 其他", "# 标题"]
    lines = spark.createDataFrame([("d", k, t) for k, t in enumerate(text)], "doc_id string, line_no int, text string")
    got = [(r.level, r.name, r.parent_line) for r in outlines.resolve_outline(outlines.parse_chapters(lines)).orderBy("line_no").collect()]
    assert got == [(1, "第1章 总论", None), (2, "第一节 概述", 0), (1, "要点", None), (2, "其他", None), (1, "标题", None)]


def test_outline_names_and_depths(spark):
    text = ["# 教材目录", "# [总论](a.md) **重要** ....... 12", "  1.2.3 太深", "1.1 概述", "\t- 缩进", "  - 浅", "一、 绪论", "2) 计量", "3.5%的税率", "第二篇 税法 ···· 30", "第3节　纳税人", "```", "# code", "```", "普通的一行", "- " + "长" * 129]
    lines = spark.createDataFrame([("d", k, t) for k, t in enumerate(text)], "doc_id string, line_no int, text string")
    got = [(r.line_no, r.level, r.number, r.name) for r in outlines.parse_chapters(lines).orderBy("line_no").collect()]
    assert got == [(1, 1, None, "总论 重要"), (2, 2, "1.2.3", "太深"), (3, 2, "1.1", "概述"), (4, 2, None, "缩进"), (5, 2, None, "浅"), (6, 1, None, "绪论"), (7, 1, "2", "计量"), (9, 1, None, "第二篇 税法"), (10, 2, None, "第3节 纳税人")]


def test_outlines_of_points_and_details(spark):
    points = ["1. 先有的", "2. 存货", "- 考点一：成本", "# 第二章 收入", "- 章内点", "## 合同", "### 知识点3 识别", "3. 计量", "1.1 确认", "1.1.1 时点", "# 目录", "- 没有章", "## 只有节", "- 也没有", "4. 仍没有", "# 末章", "5. 末点"]
    details = ["# 甲章", "## 乙节", "1. 丙点", "2. 细一", "- 细二", "### 丁点", "3. 细三", "#### 考点：细四", "## 戊节", "4. 己点", "5. 细五", "1.2.3 庚点", "1.2.3.4 细六", "第二章 新", "- 无点", "6. 辛点", "- 细七"]
    lines = spark.createDataFrame([("p", k, t) for k, t in enumerate(points)] + [("d", k, t) for k, t in enumerate(details)], "doc_id string, line_no int, text string")
    got = [(r.chapter_name, r.section_name, r.name) for r in outlines.parse_points(lines.where("doc_id = 'p'")).orderBy("line_no").collect()]
    assert got == [("先有的", None, "存货"), ("先有的", None, "成本"), ("第二章 收入", None, "章内点"), ("第二章 收入", "合同", "识别"), ("第二章 收入", "合同", "计量"), ("第二章 收入", "确认", "时点"), ("末章", None, "末点")]
    got = [(r.chapter_name, r.section_name, r.point_name, r.name) for r in outlines.parse_details(lines.where("doc_id = 'd'")).orderBy("line_no").collect()]
    assert got == [
        ("甲章", "乙节", "丙点", "细一"), ("甲章", "乙节", "丙点", "细二"), ("甲章", "乙节", "丁点", "细三"), ("甲章", "乙节", "丁点", "细四"), ("甲章", "戊节", "己点", "细五"), ("甲章", "戊节", "庚点", "细六"), ("第二章 新", None, "辛点", "细七"),
    ]


def test_quotes(spark):
    docs = spark.createDataFrame([(1, "He said **hello   World** today")], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, 0, "hello World"), (1, 1, "said"), (1, 2, "absent"), (1, 3, "")], "doc_id long, quote_no long, quote string")
    got = {r.quote_no: (r.start, r.length) for r in verify.locate_quotes(docs, quotes).collect()}
    assert got == {0: (10, 13), 1: (3, 4), 2: (-1, 0), 3: (-1, 0)}


def test_ingest_and_decoding(spark):
    assert files.decode("中文".encode("gb18030")) == "中文" and files.decode("é".encode()) == "é"
    new = spark.createDataFrame([(1, "a", "txt", "202401"), (2, "a", "md", "202401"), (3, "b", "txt", "202401")], "id long, text string, file_type string, month string")
    first = files.ingest(new, spark.createDataFrame([], "id long, sha256 string"))
    assert {r.id: (r.stored_id, r.is_new) for r in first.collect()} == {1: (1, True), 2: (1, False), 3: (3, True)}
    again = files.ingest(new, first.where("is_new").select("id", "sha256"))
    assert again.where("is_new").count() == 0


def test_review_reports_years_of_no_source(spark, tmp_path):
    rows = [(1, 0, "user", "The treaty was signed in 1998 by both of the sides."), (1, 1, "assistant", "The treaty was signed in 2003 by both of the sides."), (2, 0, "user", "It ended in 1998 they said."), (2, 1, "assistant", "It ended in 1998 they said.")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    from studyflow.plans.verify import i6

    got = {r.doc_id: (r.issues.split("; "), r.item_ids.split(","), r.passed) for r in i6(spark, str(tmp_path)).collect()}
    conflict = "years that the sources do not have"
    assert conflict in got[2][0] and len(got[2][1]) == len(got[2][0]) and not got[2][2]
    years = verify.check_years(spark.createDataFrame([(1, "in 2003 and 1998"), (2, "1998"), (3, "2003"), (4, "none")], "doc_id long, text string"), spark.createDataFrame([(1, 0, "1998"), (2, 0, "1998"), (3, 0, "no year"), (4, 0, "1998")], "doc_id long, label long, text string"))
    assert [tuple(r) for r in years.collect()] == [(1, ["1998", "2003"], ["1998"])]
    joined = verify.check_years(spark.createDataFrame([(1, "no. 120207")], "doc_id long, text string"), spark.createDataFrame([(1, 0, "1999 and 1901-" + "-".join(str(y) for y in range(1950, 1990)))], "doc_id long, label long, text string"))
    assert [(r.result_years, len(r.source_years), r.source_years[0]) for r in joined.collect()] == [(["2020"], 20, "1901")]


def test_claims_keep_decimals(spark):
    """Sentences end at marks, not at points; Latin and Han sentences, blank kinds, short pieces and long ones."""
    texts = [
        (1, "The rate was 3.5% in 2001; it fell to 12.25% later! Was it 0.75?"), (2, "今年的利润是3.5万元。明年预计达到十二点五万元；之后不再变化"), (3, "第一句话说明情况如此。 第二句话　也是这样说的？ 短。"), (4, "no mark at all, 1.5 to 2.5"), (5, "- listed item one.\n- listed item two; \t third"),
        (6, "x" * 300 + "!"), (7, ""), (8, None), (9, " ".join(f"sentence number {k}!" for k in range(12))),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {}
    for r in verify.extract_claims(docs).orderBy("doc_id", "claim_no").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {
        1: ["The rate was 3.5% in 2001;", "it fell to 12.25% later!", "Was it 0.75?"], 2: ["今年的利润是3.5万元", "明年预计达到十二点五万元"], 3: ["第一句话说明情况如此。", "第二句话 也是这样说的？"], 4: ["no mark at all, 1.5 to 2.5"],
        5: ["listed item one. - listed item two;"], 6: ["x" * 220], 9: [f"sentence number {k}!" for k in range(8)],
    }
    sources = spark.createDataFrame([(1, 0, "13.5% and 12 and 25%"), (4, 0, "from 1.5 to 2.5"), (2, 0, "今年的利润是3.5万元")], "doc_id long, label long, text string")
    claims = verify.extract_claims(docs)
    assert {r.doc_id: (r.numbers, r.unsupported) for r in verify.check_numbers(claims, sources).collect()} == {1: (4, 3), 2: (1, 0), 4: (2, 0)}
    scores = {(r.doc_id, r.claim_no): (r.score, r.entailed) for r in verify.entail(claims, sources).collect()}
    assert scores[4, 0] == (0.0, False) and scores[2, 0] == (1.0, True) and scores[1, 0] == (0.0, False)


def test_entailment_takes_twelve_words_as_written(spark):
    claims = spark.createDataFrame([(1, 0, "same same same same same same same same same same same Word other")], "doc_id long, claim_no int, text string")
    sources = spark.createDataFrame([(1, 0, "same word other")], "doc_id long, label long, text string")
    assert verify.entail(claims, sources).first().score == 0.5


def test_short_numbers_of_entries_stay(spark):
    page = ["借：银行存款", "500", "12", "说明文字", "7", "贷：收入", "页脚", "33"]
    rows = [("d", 1, k, t) for k, t in enumerate(page)] + [("d", 2, k, t) for k, t in enumerate(["正文一", "44", "正文二"])] + [(None, 3, k, t) for k, t in enumerate(["借：库存", "81"])]
    lines = spark.createDataFrame(rows, "document_id string, page_number long, line_no int, text string")
    classified = corpus.classify_lines(lines, corpus.repeated_noise(lines))
    kept = corpus.keep_entry_numbers(classified)
    assert kept.columns == classified.columns and kept.count() == len(rows)
    assert {(r.page_number, r.text) for r in kept.where("reason IS NOT NULL").collect()} == {(1, "12"), (1, "33"), (2, "44")}
    cleaned = corpus.clean_pages(classified)
    assert [r.text for r in cleaned.where("page_number = 1").orderBy("line_no").collect()] == ["借：银行存款", "500", "说明文字", "7", "贷：收入", "页脚"]
    assert {r.reason: r.n for r in corpus.reason_counts(kept).where("document_id = 'd'").collect()} == {"page_number": 3}
