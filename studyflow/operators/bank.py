"""Question bank: readiness, fingerprints, merges with source links, search and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields as N
from ..functions.tables import made_once, stored
from .tagging import child_order


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def bank_ready(questions: DataFrame) -> DataFrame:
    """(id, ready, missing) of root questions (id, parent_id, node_role, status, stem_text, group_stem, material_text, answer_text, analysis_text).

    A standalone question needs stem, answer and analysis; a group a shared stem or material and at least one child, all of
    them approved and ready; both must be approved.
    """
    own = questions.withColumn("lacks", F.array_compact(F.array(*(F.when(blank(F.col(c)), F.lit(c)) for c in ("stem_text", "answer_text", "analysis_text")))))
    child = own.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("children"), F.every((F.col("status") == "approved") & (F.size("lacks") == 0)).alias("all_ready"))
    rows = own.where("parent_id IS NULL").join(child, "id", "left")
    group = F.array_compact(F.array(
        F.when(blank(F.col("group_stem")) & blank(F.col("material_text")), F.lit("group_stem")), F.when(F.col("children").isNull(), F.lit("children")), F.when(~F.col("all_ready"), F.lit("children_ready"))))
    lacking = F.when(F.col("node_role") == "group", group).otherwise(F.col("lacks"))
    missing = F.concat(F.when(F.col("status") == "approved", F.array().cast("array<string>")).otherwise(F.array(F.lit("approved"))), lacking)
    return rows.select("id", (F.size(missing) == 0).alias("ready"), F.array_join(missing, ",").alias("missing"))


def _signature(names: list[str], labels: bool) -> Column:
    """Parts of a question in their form for comparing, joined by a bar; options without their labels and repeats, unless ``labels`` keeps them as they are."""
    options = F.coalesce("options", F.array().cast("array<string>")) if labels else N.options(F.col("options"))
    joined = F.array_join(F.transform(options, lambda o: N.match_text(o)), "||")
    return F.concat_ws("|", *(joined if c == "options" else N.match_text(F.col(c)) for c in names))


def bank_fingerprint(items: DataFrame) -> DataFrame:
    """(id, fingerprint, uid, legacy) of items (id, parent_id, question_no, node_role, question_type, group_stem, material_text, stem_text, options, answer_text).

    SHA-1 over an item's own parts, and those of its children in order; the legacy form leaves options as they are.
    """
    own, child = ["node_role", "question_type", "group_stem", "material_text", "stem_text", "options", "answer_text"], ["question_no", "question_type", "stem_text", "options", "answer_text"]
    rows = items.withColumn("node_role", F.coalesce("node_role", F.lit("standalone")))
    rows = rows.select("id", "parent_id", "question_no", *(_signature(names, labels).alias(name) for name, names, labels in (("a", own, False), ("b", own, True), ("ca", child, False), ("cb", child, True))))
    keys = [c.alias(f"k{n}") for n, c in enumerate(child_order(F.col("question_no"), F.col("id")))]
    kids = rows.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*keys, "ca", "cb"))).alias("kids"))
    whole = lambda own, child: F.concat_ws("|", F.col(own), F.array_join(F.transform("kids", lambda k: k[child]), "|"))
    joined = rows.select("id", "a", "b").join(kids, "id", "left")
    made = joined.select("id", *(F.sha1(F.encode(whole(*c), "UTF-8")).alias(name) for name, c in (("fingerprint", ("a", "ca")), ("legacy", ("b", "cb")))))
    return made.select("id", "fingerprint", F.concat(F.lit("QB"), F.substring("fingerprint", 1, 24)).alias("uid"), "legacy")


#: What the latest source overwrites of an item, and of its link, as far as sources have it.
OVERWRITTEN = ("parent_fingerprint", "node_role", "question_type", "group_stem", "material_text", "stem_text", "options", "answer_text", "analysis_text", "difficulty_level", "quality_score")
LINKED = ("paper_id", "section_id", "question_no", "source_fingerprint")


def bank_merge(items: DataFrame, links: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and links after sources (fingerprint, legacy, source_type, source_question_id, subject_id, category_id, ord, and columns of ``OVERWRITTEN`` and ``LINKED``) came in.

    An item is known by its fingerprint, or else by the legacy one.  The latest source overwrites its content, also with
    nulls, and is its ``first_source_question_id``; options are brought into their normal form, and a missing role is
    standalone.  Subject and category are filled only where there is none, by the first source that has one.  A link is
    unique per (source_type, source_question_id) and moves with it; ``source_count`` counts an item's active links
    afterwards, and ``created`` tells new items.
    """
    known = items.select("fingerprint").distinct()

    def named(rows: DataFrame) -> DataFrame:
        """Rows (fingerprint, legacy) under the fingerprint that the bank has for them."""
        met = rows.join(known.select("fingerprint", F.lit(True).alias("own")), "fingerprint", "left").join(known.select(F.col("fingerprint").alias("legacy"), F.lit(True).alias("old")), "legacy", "left")
        return met.withColumn("fingerprint", F.when(F.col("own").isNull() & F.col("old"), F.col("legacy")).otherwise(F.col("fingerprint"))).drop("legacy", "own", "old")

    # Sources are many more than items: they are brought down to one row a fingerprint, or a link, before these are named and options formed.
    content = [c for c in OVERWRITTEN if c in incoming.columns]
    taken = F.struct(*content, F.col("source_question_id").alias("first_source_question_id"))
    filled = ("subject_id", "category_id")
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("ord"))
    by_name = incoming.groupBy("fingerprint", "legacy").agg(F.max_by(taken, "ord").alias("new"), F.max("ord").alias("ord"), *(x for c in filled for x in (F.min_by(c, at(c)).alias(f"new_{c}"), F.min(at(c)).alias(f"ord_{c}"))))
    latest = named(by_name).groupBy("fingerprint").agg(F.max_by("new", "ord").alias("new"), *(F.min_by(f"new_{c}", f"ord_{c}").alias(f"new_{c}") for c in filled))
    formed = {c: x for c, x in (("node_role", F.coalesce("new.node_role", F.lit("standalone"))), ("options", N.options(F.col("new.options"), F.col("new.question_type")))) if c in content}
    latest = made_once(latest, {f"_{c}": x for c, x in formed.items()}) if formed else latest
    both = items.withColumn("there", F.lit(True)).join(latest, "fingerprint", "full")
    held = lambda c: F.col(c) if c in items.columns else F.lit(None)
    new = F.col("new").isNotNull()
    merged = both.select(
        "fingerprint", F.coalesce("subject_id", "new_subject_id").alias("subject_id"), F.coalesce("category_id", "new_category_id").alias("category_id"),
        *(F.when(new, F.col(f"_{c}" if c in formed else f"new.{c}")).otherwise(held(c)).alias(c) for c in (*content, "first_source_question_id")), F.col("there").isNull().alias("created"),
    )
    linked = [c for c in LINKED if c in incoming.columns]
    moved = incoming.groupBy("source_type", "source_question_id").agg(F.max_by(F.struct("fingerprint", "legacy", *linked), "ord").alias("l")).select("source_type", "source_question_id", "l.*", F.lit("active").alias("status"))
    stay = links.join(moved, ["source_type", "source_question_id"], "left_anti")
    all_links = stay.select("source_type", "source_question_id", "fingerprint", *((F.col(c) if c in links.columns else F.lit(None).cast(incoming.schema[c].dataType)).alias(c) for c in linked), "status").unionByName(named(moved))
    count = lambda rows, *by: rows.where("status = 'active'").groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    counted = count(stay, "fingerprint").unionByName(named(count(moved, "fingerprint", "legacy")))
    counts = counted.groupBy("fingerprint").agg(F.sum("n").alias("source_count"))
    return merged.join(counts, "fingerprint", "left").na.fill(0, ["source_count"]), all_links


#: Texts of a root, and of a child, that a search reads.
ROOT_TEXTS, CHILD_TEXTS = ("stem_text", "group_stem", "material_text", "answer_text", "analysis_text"), ("stem_text", "answer_text", "analysis_text")


def matching_items(items: DataFrame, keyword: str | None = None, status: str | None = None, subject_id: int | None = None, category_id: int | None = None, question_type: str | None = None) -> DataFrame:
    """Roots by status, subject, category and type, whose texts, or a child's, hold the keyword (case does not count)."""
    roots = items.where("parent_id IS NULL")
    for name, value in (("status", status), ("subject_id", subject_id), ("category_id", category_id), ("question_type", question_type)):
        if value is not None and value != "":
            roots = roots.where(F.col(name) == value)
    if not keyword:
        return roots

    def hit(names: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for c in names:
            out = out | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(keyword.lower()))
        return out

    children = items.where(F.col("parent_id").isNotNull() & hit(CHILD_TEXTS)).select(F.col("parent_id").alias("id"), F.lit(True).alias("by_child")).distinct()
    return roots.join(children, "id", "left").where(hit(ROOT_TEXTS) | F.col("by_child")).drop("by_child")


def search_bank(items: DataFrame, reviews: DataFrame, limit: int = 100, offset: int = 0, after: tuple | None = None, **filters: object) -> DataFrame:
    """A page of :func:`matching_items`, latest ``updated_at`` first, then largest id: (id, updated_at, paper_id of its first source, total).

    Deep pages go by ``after``, the (updated_at, id) of the last row of the page before, rather than by offset.
    ``reviews`` is (source_question_id, paper_id).
    """
    found = matching_items(items, **filters)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    if after is not None:
        found = found.where((F.col("updated_at") < after[0]) | ((F.col("updated_at") == after[0]) & (F.col("id") < after[1])))
    page = found.orderBy(F.desc("updated_at"), F.desc("id")).offset(offset).limit(limit).select("id", "updated_at", "first_source_question_id")
    source = reviews.groupBy(F.col("source_question_id").alias("first_source_question_id")).agg(F.min("paper_id").alias("paper_id"))
    return page.join(source, "first_source_question_id", "left").join(F.broadcast(total)).select("id", "updated_at", "paper_id", "total")  # total is one row


def status_counts(items: DataFrame) -> DataFrame:
    return items.where("parent_id IS NULL").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def item_sources(items: DataFrame, links: DataFrame, papers: DataFrame) -> DataFrame:
    """Active sources of each root and its children, oldest first."""
    root = items.select(F.col("id").alias("bank_question_id"), F.coalesce("parent_id", "id").alias("root"))
    rows = links.where("status = 'active'").join(root, "bank_question_id").join(papers.select(F.col("id").alias("paper_id"), "exam_year"), "paper_id", "left")
    place = F.row_number().over(Window.partitionBy("root").orderBy("created_at", "source_question_id", "bank_question_id", "paper_id"))
    return rows.select("root", "bank_question_id", "paper_id", "exam_year", "source_question_id", place.cast("long").alias("place"))


def export_papers(items: DataFrame, links: DataFrame, papers: DataFrame) -> DataFrame:
    """Papers with their number of distinct root items, newest year first (no year counts as 0)."""
    roots = items.where("parent_id IS NULL AND status = 'active'").select(F.col("id").alias("bank_question_id"))
    counts = links.where("status = 'active'").join(roots, "bank_question_id", "left_semi").groupBy("paper_id").agg(F.count_distinct("bank_question_id").alias("items"))
    return counts.join(papers.select(F.col("id").alias("paper_id"), F.coalesce("exam_year", F.lit(0)).alias("exam_year")), "paper_id")


def option_labels(options: Column) -> Column:
    """Options in their normal form, labelled A., B. and so on."""
    return F.transform(N.options(options), lambda o, i: F.concat(F.chr(F.lit(65) + i), F.lit(". "), o))


def _kept(*cs: Column) -> Column:
    """The first text that is not blank, trimmed, else null."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in cs))


def _clean(c: str) -> Column:
    """A clean text, null where it is blank."""
    return F.when(_kept(F.col(c)).isNotNull(), N.clean(F.col(c)))


def clean_items(items: DataFrame) -> DataFrame:
    """Items with their texts and options in the form of the export, made once for each item."""
    return made_once(items, {"c_stem": _clean("stem_text"), "c_group_stem": _clean("group_stem"), "c_material": _clean("material_text"), "c_options": F.when(F.size("options") > 0, option_labels(F.col("options")))})


def clean_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews with their texts and options in the form of the export, and what the source's lines before the first option, answer or analysis say, made once for each review."""
    texts = made_once(reviews, {"r_stem": _clean("review_stem"), "r_group_stem": _clean("review_group_stem"), "r_material": _clean("review_material"), "r_raw": N.clean(F.col("source_raw_text")), "r_options": option_labels(F.col("review_options"))})
    return made_once(texts, {"r_source": stem_source(F.col("r_raw"))}).drop("r_raw")


def child_records(items: DataFrame, links: DataFrame, reviews: DataFrame) -> DataFrame:
    """(parent_id, children) with the children of groups in order, from the bank, else from the review of their oldest source: (no, type, stem, options, answer, analysis).  Items and reviews are clean ones."""
    oldest = links.groupBy("bank_question_id").agg(F.min_by(F.struct("source_question_id", "question_no"), F.struct("created_at", "source_question_id")).alias("l"))
    rows = items.where("parent_id IS NOT NULL").join(oldest.hint("merge"), F.col("id") == F.col("bank_question_id"), "left").join(reviews, F.col("l.source_question_id") == F.col("source_question_id"), "left")
    number = _kept(F.col("l.question_no"), F.col("review_no"), F.col("question_uid"))
    keys = [c.alias(f"k{n}") for n, c in enumerate(child_order(F.col("review_no"), F.col("id")))]
    rows = rows.select(
        "parent_id", *keys, number.alias("no"), F.coalesce(_kept(F.col("question_type"), F.col("review_type")), F.lit("mixed")).alias("type"), F.coalesce("c_stem", "r_stem", F.lit("")).alias("stem"),
        F.coalesce("c_options", "r_options", F.array().cast("array<string>")).alias("options"), _kept(F.col("answer_text"), F.col("review_answer")).alias("answer"), _kept(F.col("analysis_text"), F.col("review_analysis")).alias("analysis"),
    )
    child = F.struct("k0", "k1", "k2", "no", "type", "stem", "options", "answer", "analysis")
    return rows.groupBy("parent_id").agg(F.array_sort(F.collect_list(child)).alias("children"))


#: Name of a section without one (fixed value).
NO_SECTION = "未分区"


def export_records(items: DataFrame, links: DataFrame, reviews: DataFrame) -> DataFrame:
    """Records of papers' roots in order: the bank's value, else the review's.

    ``items`` has the bank's fields, ``links`` is (bank_question_id, paper_id, source_question_id, question_no, status,
    created_at), ``reviews`` (source_question_id, review_no, review_type, section_name, sort_order, review_stem,
    review_group_stem, review_material, review_options, review_answer, review_analysis, source_raw_text).  A group has its
    children, shared stem and material; another question the shared stem that :func:`split_shared_stem` finds.
    """
    # Reviews meet links, and the children of groups.  Texts that repeat lie small in files and are large in memory, so
    # Spark would broadcast tables by their files' size that the driver cannot hold: the hints have them merged instead.
    items, reviews = clean_items(items), stored(clean_reviews(reviews)).hint("merge")
    roots = items.where("parent_id IS NULL").withColumnRenamed("id", "bank_question_id")
    rows = links.where("status = 'active'").join(roots.drop("status", "question_no").hint("merge"), "bank_question_id").join(reviews, "source_question_id")
    rows = rows.join(child_records(items, links, reviews).withColumnRenamed("parent_id", "bank_question_id").hint("merge"), "bank_question_id", "left")
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy("sort_order", "source_question_id", "bank_question_id"))
    group = F.coalesce(F.col("node_role") == "group", F.lit(False)) | F.col("children").isNotNull()
    shared, own = shared_and_own(F.coalesce("c_stem", "r_stem", F.lit("")), F.col("r_source"), F.coalesce("r_stem", F.lit("")))
    options = F.coalesce("c_options", "r_options", F.array().cast("array<string>"))
    none = F.lit(None).cast("string")
    return rows.select(
        "paper_id", place.cast("long").alias("place"), "bank_question_id", F.coalesce(_kept(F.col("question_no"), F.col("review_no")), F.col("source_question_id").cast("string")).alias("no"),
        F.coalesce(_kept(F.col("question_type"), F.col("review_type")), F.when(group, "material_analysis").otherwise("mixed")).alias("type"), F.coalesce(_kept(F.col("section_name")), F.lit(NO_SECTION)).alias("section"), group.alias("is_group"),
        F.when(group, F.coalesce("c_group_stem", "r_group_stem", "c_stem", F.lit(""))).otherwise(shared).alias("shared_stem"), F.when(group, F.coalesce("c_material", "r_material", F.lit(""))).otherwise("").alias("material"), F.when(group, "").otherwise(own).alias("stem"),
        F.when(group, F.array().cast("array<string>")).otherwise(options).alias("options"), F.when(group, none).otherwise(_kept(F.col("answer_text"), F.col("review_answer"))).alias("answer"),
        F.when(group, none).otherwise(_kept(F.col("analysis_text"), F.col("review_analysis"))).alias("analysis"), "children",
    )


#: Beginnings of lines that end a stem (fixed values).
STEM_ENDS = r"^(答案[:：]|参考答案[:：]|正确答案[:：]|解析[:：]|答案解析[:：]|【解析】|\s*[A-Ha-h]\s*[.、．)]\s*)"


def stem_source(raw: Column) -> Column:
    """What the lines of a clean source say before the first option, answer or analysis."""
    lines = F.filter(F.split(raw, "\n"), lambda x: x != "")
    before = lambda ls: F.slice(ls, F.lit(1), F.coalesce(F.nullif(F.array_position(F.transform(ls, lambda x: x.rlike(STEM_ENDS)), True), F.lit(0).cast("long")) - 1, F.size(ls)).cast("int"))
    return F.get(F.transform(F.array(lines), lambda ls: F.array_join(before(ls), "\n")), 0)


def shared_and_own(full: Column, source: Column, stem: Column) -> tuple[Column, Column]:
    """The shared and the own part of a clean stem: if it ends with what its source says (:func:`stem_source`, or else ``stem``), that is its own, and the rest before is shared."""
    own = F.when(source != "", source).otherwise(stem)
    before = F.trim(F.substr(full, F.lit(1), F.greatest(F.length(full) - F.length(own), F.lit(0))))
    ends = (own != "") & (full != own) & F.endswith(full, own) & (before != "")
    return F.when(ends, before).otherwise(""), F.when(ends, own).otherwise(full)


def split_shared_stem(questions: DataFrame) -> DataFrame:
    """(id, shared_stem, own_stem) of questions (id, stem_text, source_raw_text); no shared stem is null."""
    rows = made_once(questions.select("id", "stem_text", "source_raw_text"), {"_stem": N.clean(F.col("stem_text")), "_raw": N.clean(F.col("source_raw_text"))})
    rows = made_once(rows, {"_source": stem_source(F.col("_raw"))})
    shared, own = shared_and_own(F.col("_stem"), F.col("_source"), F.col("_stem"))
    return rows.select("id", F.nullif(shared, F.lit("")).alias("shared_stem"), own.alias("own_stem"))


#: Section names that stand as they are, the names that types give to all others, and the rest's; a value that is missing (fixed values).
SECTIONS = "单选题 单项选择题 多选题 多项选择题 不定项选择题 判断题 填空题 简答题 问答题 计算题 计算分析题 综合题 案例分析题 材料题 选择题 客观题 主观题 真题 练习题 模拟题".split()
TYPE_SECTIONS = {
    "single_choice": "单选题", "multiple_choice": "多选题", "judge": "判断题", "fill_blank": "填空题", "short_answer": "简答题", "calculation": "计算题", "case_analysis": "案例分析题",
    "material_analysis": "材料题", "composite": "综合题", "mixed": "练习题",
}
OTHER_SECTION, ABSENT = "练习题", "暂无"


def _lines(*parts: Column | str) -> Column:
    """Lines, each with its end; null ones are left out."""
    return F.concat(*(F.coalesce(F.concat(F.lit(p) if isinstance(p, str) else p, F.lit("\n")), F.lit("")) for p in parts))


def _heading(no: Column) -> Column:
    return F.concat(F.lit("第"), no, F.lit("题"))


def _solution(title: Column | None, answer: Column, analysis: Column) -> Column:
    said = lambda name, c: F.concat(F.lit(name), F.coalesce(c, F.lit(ABSENT)))
    head = F.lit(":::answer-block") if title is None else F.concat(F.lit(":::answer-block "), title)
    return _lines(head, said("答案：", answer), "", said("解析：", analysis), ":::", "")


def _question(q, inline: bool) -> Column:
    """A question's heading and stem, its options, and inline its solution; ``q`` gives its fields by name."""
    options = F.when(F.size(q("options")) > 0, _lines(F.array_join(q("options"), "\n"), "")).otherwise("")
    body = F.concat(_lines(F.trim(F.concat(_heading(q("no")), F.lit(" "), F.trim(q("stem")))), ""), options)
    return F.concat(body, _solution(None, q("answer"), q("analysis"))) if inline else body


def export_markdown(records: DataFrame, papers: DataFrame, mode: str = "inline") -> DataFrame:
    """(paper_id, file, markdown): a document per paper (paper_id, name), from :func:`export_records`.

    A heading stands where the section changes, shared material once for a run of questions that share it; solutions
    follow each question (``inline``) or all of them (``appendix``).  A paper's records meet in one row.
    """
    inline = mode == "inline"
    own, order = F.col, Window.partitionBy("paper_id").orderBy("place")
    named = F.create_map(*(F.lit(x) for kv in TYPE_SECTIONS.items() for x in kv))
    section = F.when(F.col("section").isin(*SECTIONS), F.col("section")).otherwise(F.coalesce(F.try_element_at(named, F.col("type")), F.lit(OTHER_SECTION)))
    rows = records.withColumn("head", section)
    changed = ~F.col("head").eqNullSafe(F.lag("head").over(order))
    before = F.when(F.lag("is_group").over(order), "").otherwise(F.lag("shared_stem").over(order))
    once = (F.col("shared_stem") != "") & (F.col("is_group") | changed | ~F.col("shared_stem").eqNullSafe(before))
    shared = F.when(once, _lines("### 共用材料", "", own("shared_stem"), "")).otherwise("")
    material = F.when(own("is_group") & (own("material") != ""), _lines("材料：", "", own("material"), "")).otherwise("")
    kids = F.coalesce("children", F.array().cast(records.schema["children"].dataType))
    each = lambda f: F.array_join(F.transform(kids, f), "")
    body = F.when(own("is_group"), each(lambda c: _question(lambda name: c[name], inline))).otherwise(_question(own, inline))
    late = F.when(own("is_group"), each(lambda c: _solution(_heading(c["no"]), c["answer"], c["analysis"]))).otherwise(_solution(_heading(own("no")), own("answer"), own("analysis")))
    rows = rows.select("paper_id", "place", F.concat(F.when(changed, _lines(F.concat(F.lit("## "), "head"), "")).otherwise(""), shared, material, body).alias("md"), (F.lit("") if inline else late).alias("late"))
    joined = rows.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("place", "md", "late"))).alias("r"))
    part = lambda name: F.array_join(F.transform("r", lambda x: x[name]), "")
    appendix = F.lit("") if inline else F.concat(_lines("", "## 答案与解析", ""), part("late"))
    text = F.regexp_replace(F.concat(_lines(F.concat(F.lit("# "), "name"), ""), part("md"), appendix), r"\s+$", "")
    plain = F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.trim("name"), r'[\\/:*?"<>|]+', "_"), r"^[ .]+|[ .]+$", ""), F.lit("")), F.lit("question-bank-paper"))
    return joined.join(papers.select("paper_id", "name").hint("merge"), "paper_id").select("paper_id", F.concat(plain, F.lit("-inline.md" if inline else "-appendix.md")).alias("file"), F.concat(text, F.lit("\n")).alias("markdown"))


def _going(items: DataFrame, ids: DataFrame) -> DataFrame:
    """(id) of the given roots and their children."""
    gone = items.join(ids, F.col("id") == ids["gone_id"], "left_semi").select("id")
    return gone.unionByName(items.join(ids, F.col("parent_id") == ids["gone_id"], "left_semi").select("id")).distinct()


def delete_items(items: DataFrame, links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and links without the given roots, their children and their links; review rows stay."""
    gone = _going(items, ids)
    return items.join(gone, "id", "left_anti"), links.join(gone.select(F.col("id").alias("bank_question_id")), "bank_question_id", "left_anti")


def delete_counts(items: DataFrame, links: DataFrame, ids: DataFrame) -> DataFrame:
    """(kind, removed): items and links that :func:`delete_items` takes away, and ids that are no item's."""
    gone = _going(items, ids)
    lost = links.join(gone.select(F.col("id").alias("bank_question_id")), "bank_question_id", "left_semi")
    unknown = ids.select(F.col("gone_id").alias("id")).distinct().join(items.select("id"), "id", "left_anti")
    n = lambda df, kind: df.agg(F.count(F.lit(1)).alias("removed")).select(F.lit(kind).alias("kind"), "removed")
    return n(gone, "items").unionByName(n(lost, "links")).unionByName(n(unknown, "unknown"))
