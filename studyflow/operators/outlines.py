"""Markdown outlines to drafts of chapters, knowledge points and details.

Each line is read by itself: what form it has (heading, numbered line, list item, chapter, section), how deep it is, and
its clean name.  What a point or detail belongs to follows from the lines before it: chapters, sections and points open
segments of a document, which running maxima over its lines give, so no line waits for the one before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import once
from .taxonomy import walk

#: White space, digits and numerals; forms of outline lines; parts that names lose (fixed values; groups count from 1).
S, S_CLASS, D, N = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]", r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}", r"\p{Nd}", r"[零〇一二三四五六七八九十百千万\p{Nd}]"
HEADING = rf"^{S}{{0,3}}(#{{1,6}}){S}+(.+?){S}*#*{S}*$"
OUTLINE = rf"^{S}*({D}+(?:[.．]{D}+)*){S}+(.+)$"
ITEM = rf"^({S}*)[-*+]{S}+(.+)$"
NUMBERED = rf"^{S}*({D}+|[一二三四五六七八九十百千万]+)[.)）、.．]({S}.*|[^{S_CLASS}\p{{Nd}}].*)$"
CHAPTER, SECTION = rf"^{S}*(第{N}+[章篇编单元讲部分].*)$", rf"^{S}*(第{N}+节.*)$"
POINT_LABEL = rf"^(?:知识点|考点|要点){S}*{N}*[{S_CLASS}、.．:：-]*(.+)$"
LINK, DECORATION, TOC_PAGE = r"!?\[([^\]]+)\]\([^)]+\)", r"[*_~`]+", rf"[{S_CLASS}.·•…-]{{2,}}{D}+{S}*$"
LEADING = rf"^(?:{D}+(?:[.．]{D}+)*|[一二三四五六七八九十百千万]+)[.)、.．]?{S}+"
CONTENTS, CONTENTS_CHARS, NAME_CHARS, FENCE = "目录", 32, 128, "```"


def chapter_name(c: Column, numbered: bool = True) -> Column:
    """A name without links, decorations, the page of a contents line and (``numbered``) a leading number; null where nothing fit is left."""
    steps = [(rf"^{S}+|{S}+$", ""), (LINK, "$1"), (DECORATION, ""), (TOC_PAGE, ""), *([(LEADING, "")] if numbered else [])]
    text = reduce(lambda t, step: F.regexp_replace(t, *step), steps, c)
    text = F.btrim(F.regexp_replace(text, rf"{S}+", " "), F.lit(" -—_"))
    fits = lambda t: F.length(t).between(1, NAME_CHARS) & ~(t.endswith(CONTENTS) & (F.length(t) <= CONTENTS_CHARS))
    return once(text, lambda t: F.when(fits(t), t))


def point_name(c: Column) -> Column:
    """A clean name without a label such as a numbered key point's."""
    bare = lambda t: F.regexp_replace(F.regexp_extract(t, POINT_LABEL, 1), rf"^{S}+|{S}+$", "")
    return once(chapter_name(c), lambda t: F.when(t.rlike(POINT_LABEL), F.nullif(bare(t), F.lit(""))).otherwise(t))


def _forms(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, text) outside code fences, with what each form would take from them (null: it has not the form)."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), rf"{S}+$", "")
    fence = F.regexp_replace(text, rf"^{S}+", "").startswith(FENCE)
    rows = lines.select("doc_id", "line_no", text.alias("t"), fence.alias("fence"), (F.sum(fence.cast("int")).over(order) % 2 == 1).alias("code")).where("NOT fence AND NOT code AND t <> ''")
    part = lambda p, k: F.when(F.col("t").rlike(p), F.regexp_extract("t", p, k))
    number = F.regexp_replace(part(OUTLINE, 1), "．", ".")
    # The indent of a list item, with tabs up to the next fourth place.
    indent = F.aggregate(F.split(part(ITEM, 1), ""), F.lit(0), lambda at, x: F.when(x == "\t", (F.floor(at / 4).cast("int") + 1) * 4).when(x == "", at).otherwise(at + 1))
    forms = F.struct(
        F.length(part(HEADING, 1)).alias("marks"), part(HEADING, 2).alias("heading"), number.alias("number"), part(OUTLINE, 2).alias("outline"), F.when(F.col("t").rlike(ITEM), indent).alias("indent"), part(ITEM, 2).alias("item"),
        part(NUMBERED, 1).alias("digit"), part(NUMBERED, 2).alias("numbered"), part(CHAPTER, 1).alias("chapter"), part(SECTION, 1).alias("section"),
    )
    return rows.select("doc_id", "line_no", F.explode(F.array(forms)).alias("f")).select("doc_id", "line_no", "f.*")


def parse_chapters(lines: DataFrame) -> DataFrame:
    """Drafts (doc_id, line_no, level, number, name) of chapters (level 1) and sections (level 2; all that is deeper too).

    A heading has the depth of its marks, a numbered line that of its number, a list item that of its indent by two;
    ``第…章`` and the like are chapters, ``第…节`` sections.  A line has the first of these forms, in this order.
    """
    capped = lambda c: F.least(c, F.lit(2)).cast("int")
    simple = F.when(F.col("digit").rlike(rf"^{D}+$"), F.col("digit"))
    forms = [
        ("heading", capped(F.col("marks")), None, chapter_name(F.col("heading"))), ("outline", capped(F.size(F.split("number", r"\."))), F.col("number"), chapter_name(F.col("outline"))),
        ("item", capped(F.floor(F.col("indent") / 2) + 1), None, chapter_name(F.col("item"))), ("numbered", F.lit(1), simple, chapter_name(F.col("numbered"))),
        ("chapter", F.lit(1), None, chapter_name(F.col("chapter"), False)), ("section", F.lit(2), None, chapter_name(F.col("section"), False)),
    ]
    draft = F.coalesce(*(F.when(F.col(f).isNotNull(), F.struct(level.cast("int").alias("level"), (F.lit(None).cast("string") if number is None else number).alias("number"), name.alias("name"))) for f, level, number, name in forms))
    # A generator makes each draft once, where a struct would be made again for each of its fields.
    return _forms(lines).select("doc_id", "line_no", F.explode(F.array(draft)).alias("d")).where("d.name IS NOT NULL").select("doc_id", "line_no", "d.level", "d.number", "d.name")


#: What a line does in an outline of points and details.
_CHAPTER, _SECTION, _POINT, _DETAIL, _BY_CONTEXT = range(1, 6)


def _roles(lines: DataFrame, details: bool) -> DataFrame:
    """(doc_id, line_no, role, c, p): what each line does, and its name as a chapter's and as a point's."""
    deepest = _DETAIL if details else _POINT
    depth = lambda c: F.least(c, F.lit(deepest)).cast("int")
    whole = lambda form, text: F.when(F.col(text).rlike(form), F.regexp_extract(text, form, 1))
    head_chapter, head_section = whole(CHAPTER, "heading"), whole(SECTION, "heading")
    forms = [
        (F.col("chapter"), F.lit(_CHAPTER), chapter_name(F.col("chapter"), False)), (F.col("section"), F.lit(_SECTION), chapter_name(F.col("section"), False)),
        (head_chapter, F.lit(_CHAPTER), chapter_name(F.col("heading"), False)), (head_section, F.lit(_SECTION), chapter_name(F.col("heading"), False)),
        (F.col("heading"), depth(F.col("marks")), chapter_name(F.col("heading"))), (F.col("outline"), depth(F.size(F.split("number", r"\."))), chapter_name(F.col("outline"))),
        (F.col("item"), F.lit(deepest), chapter_name(F.col("item"))), (F.col("numbered"), F.lit(_BY_CONTEXT), chapter_name(F.col("numbered"))),
    ]
    raw = F.coalesce("heading", "outline", "item", "numbered")
    picked = F.coalesce(*(F.when(has.isNotNull(), F.struct(role.alias("role"), c.alias("c"), point_name(raw).alias("p"))) for has, role, c in forms))
    return _forms(lines).select("doc_id", "line_no", F.explode(F.array(picked)).alias("r")).where("r IS NOT NULL").select("doc_id", "line_no", "r.role", "r.c", "r.p")


def _since(rows: DataFrame, opens: Column, name: str, within: list[str]) -> DataFrame:
    """Adds a running number of the lines that open a segment."""
    order = Window.partitionBy("doc_id", *within).orderBy("line_no")
    return rows.withColumn(name, F.sum(opens.cast("int")).over(order))


def _held(value: Column, sets: Column, within: list[str]) -> Column:
    """The value of the last line up to this one that sets it, in its segment; the value may be null."""
    order = Window.partitionBy("doc_id", *within).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(F.when(sets, F.struct(value.alias("v"))), ignorenulls=True).over(order)["v"]


def _first(rows: DataFrame, holds: Column, within: list[str]) -> Column:
    """Whether a line is the first of its segment for which a condition holds."""
    return holds & (F.col("line_no") == F.min(F.when(holds, F.col("line_no"))).over(Window.partitionBy("doc_id", *within)))


def _contexts(lines: DataFrame, details: bool) -> DataFrame:
    """Roles, with chapter and section (and point) that hold at each line.

    A numbered line is a point (with ``details``: opens one, or is a detail of an open one) where a chapter or section
    is open, else a chapter: so in a segment without an open chapter, the first one outside a section is.
    """
    role, rows = F.col("role"), _roles(lines, details)
    rows = _since(rows, role == _CHAPTER, "seg", [])
    rows = rows.withColumn("in_chapter", _held(F.col("c"), role == _CHAPTER, ["seg"])).withColumn("in_section", _held(F.col("c"), role == _SECTION, ["seg"]))
    free = F.col("in_chapter").isNull() & F.col("in_section").isNull()
    if details:
        rows = _since(rows, role <= _SECTION, "part", ["seg"])
        rows = rows.withColumn("in_point", _held(F.col("p"), role == _POINT, ["seg", "part"]))
        free = free & F.col("in_point").isNull()
    promoted = _first(rows, (role == _BY_CONTEXT) & free & F.col("c").isNotNull(), ["seg"])
    rows = rows.withColumn("role", F.when(promoted, _CHAPTER).otherwise(role))
    rows = _since(rows, role == _CHAPTER, "seg", []).withColumn("chapter", _held(F.col("c"), role == _CHAPTER, ["seg"]))
    rows = rows.withColumn("section", _held(F.col("c"), role == _SECTION, ["seg"]))
    if not details:
        return rows.withColumn("role", F.when(role == _BY_CONTEXT, _POINT).otherwise(role))
    # A line that sets the point, or resets it, opens a part; in a part without a point, the first numbered line with a name sets it.
    rows = _since(rows, role <= _POINT, "part", ["seg"]).withColumn("in_point", _held(F.col("p"), role == _POINT, ["seg", "part"]))
    open_part = F.col("in_point").isNull() & (F.col("chapter").isNotNull() | F.col("section").isNotNull())
    promoted = _first(rows, (role == _BY_CONTEXT) & open_part & F.col("p").isNotNull(), ["seg", "part"])
    rows = rows.withColumn("role", F.when(promoted, _POINT).when(role == _BY_CONTEXT, _DETAIL).otherwise(role))
    return _since(rows, role <= _POINT, "part", ["seg"]).withColumn("point", _held(F.col("p"), role == _POINT, ["seg", "part"]))


def parse_points(lines: DataFrame) -> DataFrame:
    """Drafts (doc_id, line_no, chapter_name, section_name, name) of knowledge points; those outside a chapter are left out.

    ``第…章`` and headings and numbers of depth 1 open a chapter, ``第…节`` and those of depth 2 a section; deeper ones
    and list items are points.
    """
    rows = _contexts(lines, False).where((F.col("role") == _POINT) & F.col("chapter").isNotNull() & F.col("p").isNotNull())
    return rows.select("doc_id", "line_no", F.col("chapter").alias("chapter_name"), F.col("section").alias("section_name"), F.col("p").alias("name"))


def parse_details(lines: DataFrame) -> DataFrame:
    """Drafts (doc_id, line_no, chapter_name, section_name, point_name, name) of details; those outside a chapter or point are left out.

    As for points, but depth 3 opens a point, and deeper ones and list items are details.
    """
    rows = _contexts(lines, True).where((F.col("role") == _DETAIL) & F.col("chapter").isNotNull() & F.col("point").isNotNull() & F.col("p").isNotNull())
    return rows.select("doc_id", "line_no", F.col("chapter").alias("chapter_name"), F.col("section").alias("section_name"), F.col("point").alias("point_name"), F.col("p").alias("name"))


def resolve_outline(drafts: DataFrame) -> DataFrame:
    """Adds parent_line, path and ``ok`` to drafts (doc_id, line_no, level, number, name) of any depth.

    A draft numbered ``1.2`` or ``1.2.3`` belongs to the last one before it with the number ``1``, any other to the
    nearest earlier draft of a lower level.  ``ok`` is false where a draft below level 1 has no parent; such drafts, and
    what hangs on them, have no path.
    """
    deepest = drafts.agg(F.max("level")).first()[0] or 1
    order = Window.partitionBy("doc_id").orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    above = F.regexp_extract(F.coalesce("number", F.lit("")), r"^(\p{Nd}+)\.", 1)
    rows = drafts.withColumns({f"_l{k}": F.last(F.when(F.col("level") == k, F.col("line_no")), ignorenulls=True).over(upto) for k in range(1, deepest)}).withColumn("_above", F.nullif(above, F.lit("")))
    nearest = F.greatest(F.lit(None).cast("long"), F.lit(None).cast("long"), *(F.when(F.col("level") > k, F.col(f"_l{k}")) for k in range(1, deepest)))
    # Numbers meet the numbers above them: of those before a line the last one counts.
    numbered = drafts.where("number IS NOT NULL").select("doc_id", F.col("number").alias("_above"), F.col("line_no").alias("_at"))
    by_number = rows.where("_above IS NOT NULL").select("doc_id", "line_no", "_above").join(numbered, ["doc_id", "_above"]).where("_at < line_no").groupBy("doc_id", "line_no").agg(F.max("_at").alias("_by_number"))
    rows = rows.join(by_number, ["doc_id", "line_no"], "left").withColumn("parent_line", F.when(F.col("_above").isNotNull(), F.col("_by_number")).otherwise(nearest))
    rows = rows.withColumn("ok", (F.col("level") == 1) | F.col("parent_line").isNotNull()).select(*drafts.columns, "parent_line", "ok")
    key = lambda c: F.when(F.col(c).isNotNull(), F.struct("doc_id", F.col(c).alias("line")))
    walked = walk(rows.where("ok").select(key("line_no").alias("id"), key("parent_line").alias("parent_id"), "name"))
    paths = walked.select(F.col("id.doc_id").alias("doc_id"), F.col("id.line").alias("line_no"), "path")
    return rows.join(paths, ["doc_id", "line_no"], "left").select(*drafts.columns, "parent_line", "path", "ok")
