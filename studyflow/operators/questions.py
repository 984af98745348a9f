"""Question structuring: nested predictions to question rows, sections, fingerprints, normalisation, sync and review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields as N
from ..functions.tables import made_once
from ..functions.text import source_text, strip
from .bank import bank_ready
from .taxonomy import descendants_by_level, tree_labels

_SUB = "question_no string, question_type string, stem_text string, options array<string>, answer_text string, analysis_text string, source_raw_text string"
#: Schema of a prediction (sections, questions, subquestions); analyses that are lists or maps arrive as JSON text.
PREDICTION = f"""sections array<struct<title string, section_title string, section_type string, shared_stem string, sort_order int, section_no int, question_count int, questions array<struct<{_SUB}, node_role string,
    group_stem string, shared_stem string, material_text string, subquestions array<struct<{_SUB}>>>>>>"""
#: Types where none is given, and the name of a section without one (fixed values).
MIXED, GROUP_TYPE, SECTION_NAME = "mixed", "material_analysis", "分区 "


def _empty(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _first(*cs: Column) -> Column:
    """The first that is not blank, else an empty text."""
    return F.coalesce(*(F.when(~_empty(c), c) for c in cs), F.lit(""))


def _text(c: Column) -> Column:
    return source_text(F.coalesce(c, F.lit("")))


def _body(q: Column) -> list[Column]:
    """Number, type, options and answer of a question or subquestion; its analysis is flattened later."""
    options = F.filter(F.transform(F.coalesce(q["options"], F.array().cast("array<string>")), _text), lambda o: o != "")
    return [F.trim(F.coalesce(q["question_no"], F.lit(""))).alias("question_no"), options.alias("options"), _text(q["answer_text"]).alias("answer_text"), q["analysis_text"].alias("analysis_text"), _text(q["source_raw_text"]).alias("raw")]


def normalize_prediction(docs: DataFrame) -> DataFrame:
    """(paper_id, sections, question_count) of JSON predictions (paper_id, prediction).

    Sections without a list of questions are left out; titles, types and orders get defaults.  A question's shared stem is
    its own or its section's; it is a group if it says so or has subquestions.  A group's stem is its own, the shared one
    or its material, and its subquestions inherit shared stem and material.  What has no stem is dropped, and counts are
    made anew: a group counts its subquestions.
    """
    parsed = made_once(docs.select("paper_id", "prediction"), {"p": F.from_json("prediction", PREDICTION)})
    subs = lambda q: F.coalesce(q["subquestions"], F.array().cast(f"array<struct<{_SUB}>>"))

    # Cleaned first and put together after, in a transform of its own: a lambda makes an expression again wherever it is used.
    def cleaned(q: Column, section: Column) -> Column:
        role = F.when(~_empty(q["node_role"]), F.trim(q["node_role"])).otherwise(F.when(F.size(subs(q)) > 0, "group").otherwise("standalone"))
        children = F.filter(F.transform(subs(q), lambda c: F.struct(*_body(c), _first(c["question_type"], F.lit(MIXED)).alias("question_type"), _text(c["stem_text"]).alias("stem_text"))), lambda c: c["stem_text"] != "")
        shared = _text(_first(q["group_stem"], q["shared_stem"], section["shared_stem"]))
        return F.struct(*_body(q), (role == "group").alias("group"), q["question_type"].alias("question_type"), shared.alias("shared"), _text(q["material_text"]).alias("material"), _text(q["stem_text"]).alias("own"), children.alias("children"))

    def question(q: Column) -> Column:
        group = q["group"]
        return F.struct(
            *(q[c].alias(c) for c in ("question_no", "options", "answer_text", "analysis_text", "raw")), F.when(group, "group").otherwise("standalone").alias("node_role"), _first(q["question_type"], F.when(group, GROUP_TYPE).otherwise(MIXED)).alias("question_type"),
            q["shared"].alias("group_stem"), q["material"].alias("material_text"), F.when(group, _first(q["own"], q["shared"], q["material"])).otherwise(q["own"]).alias("stem_text"),
            F.when(group, q["children"]).otherwise(F.filter(q["children"], lambda c: F.lit(False))).alias("subquestions"),
        )

    def section(s: Column, i: Column) -> Column:
        questions = F.filter(F.transform(F.transform(s["questions"], lambda q: cleaned(q, s)), question), lambda q: q["stem_text"] != "")
        title = _first(F.trim(s["title"]), F.trim(s["section_title"]), F.concat(F.lit(SECTION_NAME), (i + 1).cast("string")))
        return F.struct(
            title.alias("title"), F.trim(_first(s["section_type"], F.lit(MIXED))).alias("section_type"), F.coalesce(F.nullif(s["sort_order"], F.lit(0)), F.nullif(s["section_no"], F.lit(0)), i + 1).alias("sort_order"),
            _text(s["shared_stem"]).alias("shared_stem"), s["question_count"].alias("question_count"), questions.alias("questions"),
        )

    counted = lambda s: s.withField("question_count", F.coalesce(s["question_count"], F.size(s["questions"])))
    made = F.filter(F.transform(F.transform(F.coalesce("p.sections", F.array()), section), counted), lambda s: s["questions"].isNotNull())
    leaves = lambda q: F.when(q["node_role"] == "group", F.size(q["subquestions"])).otherwise(1)
    total = F.aggregate(F.flatten(F.transform("sections", lambda s: s["questions"])), F.lit(0), lambda n, q: n + leaves(q))
    return made_once(parsed, {"sections": made}).select("paper_id", "sections").withColumn("question_count", F.coalesce(total, F.lit(0)).cast("long"))


def flatten_questions(docs: DataFrame) -> DataFrame:
    """(paper_id, section, question_no, parent_no, node_role, stem, material, sort_order): parents in order of sections, each followed by its children; children inherit the group's stem."""
    rows = docs.select("paper_id", F.posexplode("sections").alias("s", "section")).select("paper_id", "section.sort_order", "s", F.col("section.title").alias("section"), F.posexplode("section.questions").alias("q", "question"))
    none = F.lit(None).cast("string")
    row = lambda number, parent, role, stem, material: F.struct(number.alias("question_no"), parent.alias("parent_no"), role.alias("node_role"), stem.alias("stem"), material.alias("material"))
    number, stem = F.col("question.question_no"), F.col("question.stem_text")
    children = F.transform("question.subquestions", lambda c: row(c["question_no"], number, F.lit("subquestion"), c["stem_text"], stem))
    parent = F.array(row(number, none, F.col("question.node_role"), stem, none))
    family = F.coalesce(F.concat(parent, children), parent)
    order = F.row_number().over(Window.partitionBy("paper_id").orderBy("sort_order", "s", "q", "c"))
    placed = rows.select("paper_id", "section", "sort_order", "s", "q", F.posexplode(family).alias("c", "row")).withColumn("place", order.cast("long"))
    return placed.select("paper_id", "section", "row.*", F.col("place").alias("sort_order"))


def number_sections(questions: DataFrame) -> DataFrame:
    """(paper_id, section, leaves, start_no, end_no): leaves are questions that are no group; numbers go on from section to section."""
    per = questions.groupBy("paper_id", "section").agg(F.min("sort_order").alias("first"), F.count_if(F.col("node_role") != "group").alias("leaves"))
    before = Window.partitionBy("paper_id").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("leaves").over(before), F.lit(0)) + 1
    return per.select("paper_id", "section", "leaves", F.when(F.col("leaves") > 0, start).alias("start_no"), F.when(F.col("leaves") > 0, start + F.col("leaves") - 1).alias("end_no"))


def review_fingerprint(paper: Column, section: Column, number: Column, raw: Column) -> tuple[Column, Column]:
    """SHA-1 of section (0: none), number and the first 2000 characters of the text in lower case with single blanks, and the question's uid."""
    digest = F.sha1(F.encode(F.concat_ws("|", F.coalesce(section.cast("string"), F.lit("0")), F.trim(F.coalesce(number, F.lit(""))), F.substring(N.match_text(raw), 1, 2000)), "UTF-8"))
    return digest, F.concat(F.lit("PRQ"), paper.cast("string"), F.lit("-"), F.substring(digest, 1, 24))


def compose_raw(number: Column, stem: Column, options: Column, answer: Column, analysis: Column, role: Column | None = None, group_stem: Column | None = None, material: Column | None = None) -> Column:
    """Text of a question from its parts: a group's shared stem and material first, its own stem without a number; then options, answer and analysis."""
    none = F.lit(None).cast("string")
    group = F.lit(False) if role is None else F.coalesce(role == "group", F.lit(False))
    lines = F.filter(F.transform(F.coalesce(options, F.array().cast("array<string>")), lambda o: F.trim(o)), lambda o: o != "")
    parts = F.array(
        F.when(group, none if group_stem is None else group_stem), F.when(group, none if material is None else material), F.when(~_empty(stem), F.when(group, stem).otherwise(F.concat(number, F.lit(". "), stem))),
        F.array_join(lines, "\n"), F.when(~_empty(answer), F.concat(F.lit("答案："), F.trim(answer))), F.when(~_empty(analysis), F.concat(F.lit("解析："), analysis)),
    )
    return strip(F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n"))


#: States of parsing that a change of fields ends (fixed values).
OPEN_STATES = ("pending", "parsed", "needs_review", "manual_updated")


def normalize_fields(questions: DataFrame) -> DataFrame:
    """Questions (question_no, question_type, stem_text, options, answer_text, analysis_text, parse_status) with normalised fields and ``changed``.

    A stem that would become empty stays; a change moves an open parse status on to ``normalized``.
    """
    kind = F.col("question_type")
    stem = N.stem(F.col("stem_text"), F.col("question_no"))
    new = {
        "stem_text": F.when(stem != "", stem).otherwise(F.col("stem_text")), "options": N.options(F.col("options"), kind), "answer_text": N.answer(F.col("answer_text"), kind),
        "analysis_text": N.analysis(F.col("analysis_text")),
    }
    rows = questions.withColumns({f"_{c}": x for c, x in new.items()})
    same = lambda c: F.col(f"_{c}").eqNullSafe(F.coalesce(c, F.array().cast("array<string>")) if c == "options" else F.col(c))
    rows = rows.withColumn("changed", ~(same("stem_text") & same("options") & same("answer_text") & same("analysis_text")))
    status = F.when(F.col("changed") & F.col("parse_status").isin(*OPEN_STATES), "normalized").otherwise(F.col("parse_status"))
    return rows.select(*(F.col(f"_{c}").alias(c) if c in new else status.alias(c) if c == "parse_status" else F.col(c) for c in questions.columns), "changed")


def apply_proposals(questions: DataFrame, proposals: DataFrame, fields: list[str]) -> DataFrame:
    """Fields of proposals (id, fields) that are not empty replace the question's."""
    new = proposals.select("id", *(F.when(~_empty(F.col(f)), F.col(f)).alias(f"_{f}") for f in fields))
    rows = questions.join(new, "id", "left")
    changed = F.lit(False)
    for f in fields:
        changed = changed | (F.col(f"_{f}").isNotNull() & ~F.col(f"_{f}").eqNullSafe(F.col(f)))
    return rows.select(*(F.coalesce(f"_{f}", f).alias(f) if f in fields else F.col(f) for f in questions.columns), changed.alias("changed"))


def _latest(incoming: DataFrame, value: str) -> DataFrame:
    """(paper_id, fingerprint, value) of the greatest sort_order; of equal ones, of the row that comes first in the table."""
    placed = incoming.select("paper_id", "fingerprint", value, F.struct("sort_order", (-F.monotonically_increasing_id()).alias("place")).alias("order"))
    return placed.groupBy("paper_id", "fingerprint").agg(F.max_by(value, "order").alias(value))


def sync_questions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(paper_id, fingerprint, action, review_status, stem): upsert by fingerprint for the papers that came in; survivors keep their review status, the later of two equal fingerprints wins."""
    latest = _latest(incoming, "stem").withColumn("inc", F.lit(True))
    papers = incoming.select("paper_id").distinct()
    old = existing.join(papers, "paper_id", "left_semi").select("paper_id", "fingerprint", "review_status", F.lit(True).alias("old"))
    rows = old.join(latest, ["paper_id", "fingerprint"], "full")
    action = F.when(F.col("old").isNull(), "inserted").when(F.col("inc").isNull(), "deleted").otherwise("updated")
    return rows.select("paper_id", "fingerprint", action.alias("action"), F.coalesce("review_status", F.lit("pending")).alias("review_status"), "stem")


def sync_tags(tags: DataFrame, synced: DataFrame) -> DataFrame:
    """Tags (paper_id, fingerprint, ...) without those of questions that a sync deleted."""
    return tags.join(synced.where("action = 'deleted'").select("paper_id", "fingerprint"), ["paper_id", "fingerprint"], "left_anti")


def synced_papers(synced: DataFrame, incoming: DataFrame) -> DataFrame:
    """Per paper after a sync: leaf questions that came in (incoming has node_role), and how many were inserted, updated and deleted."""
    leaves = _latest(incoming, "node_role").where("node_role <> 'group'").groupBy("paper_id").agg(F.count(F.lit(1)).alias("leaves"))
    by = synced.groupBy("paper_id").agg(*(F.count_if(F.col("action") == a).alias(a) for a in ("inserted", "updated", "deleted")))
    return by.join(leaves, "paper_id", "left").na.fill(0, ["leaves"])


def roots(questions: DataFrame) -> DataFrame:
    """(id, root_id): the topmost ancestor, at any depth; children with a missing parent are their own root, and so are questions of a cycle and below one."""
    try:
        return tree_labels(questions).select("id", "root_id")
    except ValueError:
        return _roots_beside_cycles(questions)


def _roots_beside_cycles(questions: DataFrame) -> DataFrame:
    """The same where there are cycles: trees without one are followed down from their roots, a level a round."""
    parent = questions.select("id", "parent_id")
    there = parent.select(F.col("id").alias("parent_id")).distinct()
    top = parent.where("parent_id IS NOT NULL").join(there, "parent_id", "left_anti").select("id").union(parent.where("parent_id IS NULL").select("id"))
    below = descendants_by_level(parent, top).select("id", F.col("of").alias("root_id"))
    return parent.select("id").join(below, "id", "left").select("id", F.coalesce("root_id", "id").alias("root_id"))


def leaf_counts(questions: DataFrame) -> DataFrame:
    """(root_id, leaves): descendants without children, or the root itself."""
    inner = questions.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct()
    leaves = questions.join(inner, "id", "left_anti").select("id")
    return roots(questions).join(leaves, "id").groupBy("root_id").agg(F.count(F.lit(1)).alias("leaves"))


def review_summary(questions: DataFrame) -> DataFrame:
    """Per paper: root questions by review status (unknown ones are pending), groups, roots that a model flagged or reviewed, leaves, and those without a solution."""
    status = F.coalesce(F.trim("status"), F.lit("pending"))
    root, leaf = F.col("parent_id").isNull(), F.col("node_role") != "group"
    named = ("approved", "needs_revision", "rejected")
    return questions.groupBy("paper_id").agg(
        F.count_if(root).alias("roots"), *(F.count_if(root & (status == s)).alias(s) for s in named), F.count_if(root & ~status.isin(*named)).alias("pending"), F.count_if(root & ~leaf).alias("groups"), F.count_if(leaf).alias("leaves"),
        F.count_if(root & F.col("ai_status").isin("needs_revision", "rejected")).alias("ai_flagged"), F.count_if(root & F.col("ai_reviewed_at").isNotNull()).alias("ai_reviewed"),
        F.count_if(leaf & (_empty(F.col("answer_text")) | _empty(F.col("analysis_text")))).alias("missing_solution"),
    )


def solution_batches(questions: DataFrame, n: int = 10) -> DataFrame:
    """(paper_id, id, batch): roots with a leaf that lacks answer or analysis, in order, n to a batch."""
    lacks = questions.where(F.col("node_role") != "group").where(_empty(F.col("answer_text")) | _empty(F.col("analysis_text")))
    need = lacks.select(F.coalesce("parent_id", "id").alias("id")).distinct()
    rank = F.row_number().over(Window.partitionBy("paper_id").orderBy("id"))
    return questions.where("parent_id IS NULL").join(need, "id", "left_semi").select("paper_id", "id", F.ceil(rank / n).cast("long").alias("batch"))


def bulk_review(questions: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, root_id, status, ok, reason): what changes (id, status) do to roots and their children.

    Ids are mapped to their roots, and of several changes of a root that of the largest id counts.  A root takes its
    children with it.  Approval fails, for all of them, with what :func:`..bank.bank_ready` would still miss then; ids that
    are not there fail as ``not_found``.
    """
    up = roots(questions)
    mapped = changes.join(up, "id", "left")
    missing = mapped.where("root_id IS NULL").select("id", F.lit(None).cast("long").alias("root_id"), "status", F.lit(False).alias("ok"), F.lit("not_found").alias("reason"))
    one = mapped.where("root_id IS NOT NULL").groupBy("root_id").agg(F.max_by("status", "id").alias("new"))
    touched = questions.join(one.withColumnRenamed("root_id", "id"), "id").select("id", F.col("id").alias("root_id"), "new").unionByName(questions.join(one.withColumnRenamed("root_id", "parent_id"), "parent_id").select("id", F.col("parent_id").alias("root_id"), "new"))
    after = questions.join(touched.select("id", "new"), "id", "left").withColumn("status", F.coalesce("new", "status")).drop("new")
    checked = touched.join(bank_ready(after).select(F.col("id").alias("root_id"), "missing"), "root_id", "left")
    bad = (F.col("new") == "approved") & (F.coalesce("missing", F.lit("")) != "")
    return checked.select("id", "root_id", F.col("new").alias("status"), (~bad).alias("ok"), F.when(bad, F.col("missing")).alias("reason")).unionByName(missing)


def bulk_counts(reviewed: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: ids asked for, roots that took the change, and roots and unknown ids that failed."""
    of_roots = reviewed.where("root_id IS NULL OR id = root_id")
    done = of_roots.agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))
    return changes.agg(F.count_distinct("id").alias("requested")).join(F.broadcast(done))  # one row each


#: Texts of a root, and of a child, that a search in the workspace reads.
ROOT_TEXTS = ("question_no", "section_name", "group_stem", "material_text", "stem_text", "answer_text", "analysis_text")
CHILD_TEXTS = ("question_no", "stem_text", "answer_text", "analysis_text")


def workspace(questions: DataFrame, tags: DataFrame, sections: DataFrame) -> DataFrame:
    """Root questions with their children (in order of sort_order and id), and the points of the whole group by state, as sorted arrays.

    ``questions`` is (id, paper_id, parent_id, sort_order, status, ai_status, section_id) with the texts above.  A missing
    section id is filled from ``sections`` (id, paper_id, name) by the trimmed name, the largest id of equal ones.
    """
    named = sections.where("trim(coalesce(name, '')) <> ''").groupBy("paper_id", F.trim("name").alias("section_name")).agg(F.max("id").alias("named_id"))
    rows = questions.withColumn("section_name", F.trim(F.coalesce("section_name", F.lit("")))).join(named, ["paper_id", "section_name"], "left").withColumn("section_id", F.coalesce("section_id", "named_id"))
    text = lambda names: F.lower(F.concat_ws("\n", *names))
    each = F.struct("sort_order", F.col("id").alias("child_id"), F.col("stem_text").alias("stem"), "status", "ai_status", "section_id", text(CHILD_TEXTS).alias("search"))
    child = rows.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list(each)).alias("children"))
    root = questions.select(F.col("id").alias("question_id"), F.coalesce("parent_id", "id").alias("root_id"))
    points = lambda s: F.array_sort(F.collect_set(F.when(F.col("status") == s, F.col("point_id")))).alias(s)
    shown = tags.join(root, "question_id").groupBy(F.col("root_id").alias("id")).agg(points("confirmed"), points("suggested"))
    found = rows.where("parent_id IS NULL").withColumn("search", text(ROOT_TEXTS)).join(child, "id", "left").join(shown, "id", "left")
    return found.select("id", "paper_id", "section_id", "section_name", "status", "ai_status", "stem_text", "search", "children", "confirmed", "suggested")


def filter_workspace(rows: DataFrame, status: str | None = None, ai_status: str | None = None, section_id: int | None = None, keyword: str | None = None) -> DataFrame:
    """Rows by review status, by the model's status of the root or any child (``pending``: none has one), by section, and by a keyword in the texts of root and children."""
    out = rows if status is None else rows.where(F.col("status") == status)
    held = F.array_compact(F.concat(F.array("ai_status"), F.coalesce(F.transform("children", lambda c: c["ai_status"]), F.array().cast("array<string>"))))
    if ai_status is not None:
        out = out.where(F.size(F.filter(held, lambda s: s != "")) == 0 if ai_status == "pending" else F.array_contains(held, ai_status))
    if section_id is not None:
        out = out.where(F.col("section_id") == section_id)
    if keyword is not None and keyword.strip():
        word = F.lit(keyword.strip().lower())
        out = out.where(F.contains("search", word) | F.coalesce(F.exists("children", lambda c: F.contains(c["search"], word)), F.lit(False)))
    return out
