"""Taxonomies: trees with path and level, closures, merges and cascades; outlines of textbooks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import once, spread, stored


def entity_key(name: Column) -> Column:
    """Name without white space and the punctuation that names vary in, lower case (fixed values)."""
    return F.lower(F.regexp_replace(name, r"[\s\x{00A0}\x{3000}/／\\\-_:：、，,。.;；（）()《》]+", ""))


def merge_nodes(existing: DataFrame, drafts: DataFrame) -> DataFrame:
    """Rows to create: drafts (parent_id, name, ord) whose key the parent lacks, each once, numbered after its last child."""
    have = existing.select(F.coalesce("parent_id", F.lit(0)).alias("p"), entity_key(F.col("name")).alias("k")).distinct()
    rows = drafts.withColumn("p", F.coalesce("parent_id", F.lit(0))).withColumn("k", entity_key(F.col("name")))
    new = rows.join(have, ["p", "k"], "left_anti").groupBy("p", "k").agg(F.min(F.struct("ord", "name", "parent_id")).alias("d"))
    last = existing.groupBy(F.coalesce("parent_id", F.lit(0)).alias("p")).agg(F.max("sort_order").alias("top"))
    place = F.row_number().over(Window.partitionBy("p").orderBy("d.ord", "d.name"))
    return new.join(last, "p", "left").select("d.parent_id", "d.name", (F.coalesce("top", F.lit(0)) + place).cast("long").alias("sort_order"))


def merge_counts(drafts: DataFrame, created: DataFrame) -> DataFrame:
    """One row: drafts that were created, and those that were skipped since they exist already or come twice."""
    return drafts.agg(F.count(F.lit(1)).alias("all")).join(F.broadcast(created.agg(F.count(F.lit(1)).alias("created")))).select("created", (F.col("all") - F.col("created")).alias("skipped"))  # one row each


def bind_points(chapters: DataFrame, drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drafts of points (chapter_name, section_name, name, ord) bound to chapters (id, parent_id, name), and those that cannot be.

    The first are (parent_id, name, ord), for :func:`merge_nodes`; the second (name, ord, violation): ``unknown_chapter``,
    ``unknown_section``, or ``section_missing`` where a chapter has sections and the draft names none.
    """
    roots = chapters.where("parent_id IS NULL").groupBy(entity_key(F.col("name")).alias("ck")).agg(F.max("id").alias("chapter_id"))
    sections = chapters.where("parent_id IS NOT NULL")
    named = sections.groupBy(F.col("parent_id").alias("chapter_id"), entity_key(F.col("name")).alias("sk")).agg(F.max("id").alias("section_id"))
    having = sections.select(F.col("parent_id").alias("chapter_id"), F.lit(True).alias("divided")).distinct()
    rows = drafts.withColumn("ck", entity_key(F.col("chapter_name"))).withColumn("sk", F.nullif(entity_key(F.coalesce("section_name", F.lit(""))), F.lit("")))
    rows = rows.join(roots, "ck", "left").join(having, "chapter_id", "left").join(named, ["chapter_id", "sk"], "left")
    wrong = F.when(F.col("chapter_id").isNull(), "unknown_chapter").when(F.col("sk").isNotNull() & F.col("section_id").isNull(), "unknown_section").when(F.col("sk").isNull() & F.col("divided"), "section_missing")
    rows = rows.withColumn("violation", wrong)
    return rows.where("violation IS NULL").select(F.coalesce("section_id", "chapter_id").alias("parent_id"), "name", "ord"), rows.where("violation IS NOT NULL").select("name", "ord", "violation")


def walk(nodes: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """(id, root_id, level, path) of each node (id, parent_id, name) that a root is above of, and the root's values of the columns ``carried``.

    Pointers to ancestors double in reach with each round, so there are as many rounds as the depth has binary digits;
    each round is written to the shared folder.  Nodes below a missing parent are left out; a cycle raises an error.
    """
    carried = carried or []
    state = stored(nodes.select("id", F.col("parent_id").alias("up"), F.col("id").alias("root_id"), F.lit(1).alias("level"), F.col("name").alias("path"), *carried))
    reach, total = 1, nodes.count()
    while state.where("up IS NOT NULL").take(1):
        if reach > total:
            raise ValueError(f"the tree has a cycle, for example above {[r.id for r in state.where('up IS NOT NULL').select('id').take(3)]}")
        above = state.select(F.col("id").alias("a_id"), F.col("up").alias("a_up"), F.col("root_id").alias("a_root"), F.col("level").alias("a_level"), F.col("path").alias("a_path"), *(F.col(c).alias(f"a_{c}") for c in carried))
        moved = state.where("up IS NOT NULL").join(above, F.col("up") == F.col("a_id")).select(
            "id", F.col("a_up").alias("up"), F.col("a_root").alias("root_id"), (F.col("level") + F.col("a_level")).alias("level"), F.concat_ws("/", "a_path", "path").alias("path"), *(F.col(f"a_{c}").alias(c) for c in carried)
        )
        state, reach = stored(state.where("up IS NULL").unionByName(moved)), 2 * reach
    return state.select("id", "root_id", "level", "path", *carried)


def sync_points(points: DataFrame, chapters: DataFrame) -> DataFrame:
    """(id, subject_id, category_id, chapter_id, level, path) of points (id, parent_id, chapter_id, name), as their chapters (id, subject_id, category_id, path) have it.

    Details hang on points and follow them; points without a known chapter are left out.
    """
    top = walk(points)
    rows = top.join(points.select(F.col("id").alias("root_id"), "chapter_id"), "root_id").join(chapters.select(F.col("id").alias("chapter_id"), "subject_id", "category_id", F.col("path").alias("above")), "chapter_id")
    return rows.select("id", "subject_id", "category_id", "chapter_id", "level", F.concat_ws("/", "above", "path").alias("path"))


#: Numbers of a tree's tour that share a bucket when intervals meet nodes; parts that the children of one parent are ordered in.
_BUCKET, _PARTS = 1024, 64


def _tour(nodes: DataFrame) -> DataFrame:
    """(at, kind, next_at, next_kind): the ways in (0) and out (1) of each node of (id, parent_id), with what comes next on the way through its tree.

    Nodes without a known parent are roots; a way ends where it leaves its root.  Children are ordered in parts by hash
    and the parts in a row, so that a parent of very many is no hot group.
    """
    known = nodes.select(F.col("id").alias("parent_id"), F.lit(True).alias("known")).distinct()
    rows = nodes.select("id", "parent_id").distinct().join(known, "parent_id", "left").select("id", F.when(F.col("known"), F.col("parent_id")).alias("up"))
    children = rows.where("up IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(_PARTS))).withColumn("after", F.lead("id").over(Window.partitionBy("up", "part").orderBy("id")))
    heads = children.groupBy("up", "part").agg(F.min("id").alias("head")).withColumn("then", F.lead("head").over(Window.partitionBy("up").orderBy("part")))  # a row a part
    after = children.where("after IS NULL").join(heads, ["up", "part"]).select("id", F.col("then").alias("after")).union(children.where("after IS NOT NULL").select("id", "after"))
    first = heads.groupBy(F.col("up").alias("id")).agg(F.min_by("head", "part").alias("child"))
    rows = rows.join(after, "id", "left").join(first, "id", "left")
    into = rows.select(F.col("id").alias("at"), F.lit(0).alias("kind"), F.coalesce("child", "id").alias("next_at"), F.when(F.col("child").isNull(), 1).otherwise(0).alias("next_kind"))
    out = rows.select(F.col("id").alias("at"), F.lit(1).alias("kind"), F.coalesce("after", "up").alias("next_at"), F.when(F.col("after").isNotNull(), 0).when(F.col("up").isNotNull(), 1).alias("next_kind"))
    return into.union(out)


def tree_labels(nodes: DataFrame) -> DataFrame:
    """(id, root_id, entry, exit, level) of nodes (id, parent_id): a node is below another of its root where its entry lies between the other's exit and entry.

    The way through a tree is a list.  Pointers along it double in reach with each round, so there are as many rounds as
    the largest tree's size has binary digits, however deep it is; entry and exit are the steps left to the end.  A cycle
    raises an error.
    """
    start = _tour(nodes).select("at", "kind", "next_at", "next_kind", F.col("at").alias("end"), F.when(F.col("next_at").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.when(F.col("kind") == 0, 1).otherwise(-1).cast("long").alias("turn"))
    state = stored(start)
    total, reach = state.count(), 1
    while state.where("next_at IS NOT NULL").take(1):
        if reach > total:
            raise ValueError(f"the tree has a cycle, for example above {[r['at'] for r in state.where('next_at IS NOT NULL').select('at').take(3)]}")
        ahead = state.select(F.col("at").alias("next_at"), F.col("kind").alias("next_kind"), F.col("next_at").alias("n_at"), F.col("next_kind").alias("n_kind"), F.col("end").alias("n_end"), F.col("steps").alias("n_steps"), F.col("turn").alias("n_turn"))
        moved = state.where("next_at IS NOT NULL").join(ahead, ["next_at", "next_kind"]).select(
            "at", "kind", F.col("n_at").alias("next_at"), F.col("n_kind").alias("next_kind"), F.col("n_end").alias("end"), (F.col("steps") + F.col("n_steps")).alias("steps"), (F.col("turn") + F.col("n_turn")).alias("turn")
        )
        state, reach = stored(state.where("next_at IS NULL").unionByName(moved)), 2 * reach
    # What is still to be left from a way in on gives the node's level.
    return state.groupBy(F.col("at").alias("id")).agg(F.first("end").alias("root_id"), F.max("steps").alias("entry"), F.min("steps").alias("exit"), F.max(F.when(F.col("kind") == 0, 1 - F.col("turn"))).cast("int").alias("level"))


def descendants(nodes: DataFrame, ids: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(of, id, distance): the given nodes and all below them, leaf first when sorted by distance downwards.

    Intervals of :func:`tree_labels` (made once and passed as ``labels``, or made here) meet the entries that lie in them
    by buckets of the tour, so there is one join however deep the tree is.  Where the tree has a cycle, nodes are
    followed level by level, and each is taken once.
    """
    if labels is None:
        try:
            labels = tree_labels(nodes)
        except ValueError:
            return descendants_by_level(nodes, ids)
    bucket = lambda c: F.floor(c / _BUCKET).cast("long")
    tops = ids.select("id").distinct().join(labels, "id").select(F.col("id").alias("of"), "root_id", F.col("exit").alias("from"), F.col("entry").alias("to"), F.col("level").alias("top"))
    spread = tops.withColumn("bucket", F.explode(F.sequence(bucket(F.col("from")), bucket(F.col("to")))))
    found = labels.withColumn("bucket", bucket(F.col("entry"))).join(spread, ["root_id", "bucket"]).where(F.col("entry").between(F.col("from"), F.col("to")))
    return found.select("of", "id", (F.col("level") - F.col("top")).alias("distance"))


def descendants_by_level(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The same, a level a round: for trees with cycles."""
    level = stored(ids.select("id", F.col("id").alias("of"), F.lit(0).alias("distance")).distinct())
    found, depth = [level], 0
    while level.take(1):
        depth += 1
        below = nodes.join(level.select(F.col("id").alias("parent_id"), "of"), "parent_id").select("id", "of", F.lit(depth).alias("distance")).distinct()
        level = stored(reduce(lambda rows, seen: rows.join(seen.select("id", "of"), ["id", "of"], "left_anti"), found, below))
        found = [stored(found[0].unionByName(level))]
    return found[0].select("of", "id", "distance")


def cascade_counts(gone: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows per table that go with the given ids: each table comes with the name of its key."""
    out = None
    for name, (rows, key) in tables.items():
        n = rows.join(gone.select(F.col("id").alias(key)).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def cascade_delete(gone: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows that stay."""
    return rows.join(gone.select(F.col("id").alias(key)).distinct(), key, "left_anti")


def papers_of_files(gone: DataFrame, assets: DataFrame, papers: DataFrame) -> DataFrame:
    """(id) of papers (id, asset_id) that go with deleted files (sha256): those whose asset (id, sha256) has the same hash."""
    same = assets.join(gone.select("sha256").distinct(), "sha256", "left_semi").select(F.col("id").alias("asset_id"))
    return papers.join(same, "asset_id", "left_semi").select("id")


def dependency_counts(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(subject_id, table_name, n): rows per subject and table; zeros are left out."""
    out = None
    for name, (rows, key) in tables.items():
        n = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("subject_id")).agg(F.count(F.lit(1)).alias("n")).select("subject_id", F.lit(name).alias("table_name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def tag_value(tags: Column, prefix: str) -> Column:
    """Value of the first tag ``prefix:value``."""
    return F.get(F.transform(F.filter(tags, lambda t: t.startswith(f"{prefix}:")), lambda t: F.trim(F.substr(t, F.lit(len(prefix) + 2)))), 0)


#: Marks of chapters, sections, numbered headings and labelled points, and words that no heading has (fixed values).
_COUNT = r"[零〇一二三四五六七八九十百千万0-9]"
_GAP = r"[\s　、.．:：-]*"
CHAPTERS = (rf"^(第{_COUNT}+[章节篇编单元讲部分]){_GAP}(.+)?$", rf"^((?:专题|模块)\s*{_COUNT}+){_GAP}(.+)?$")
POINT_MARKS = (rf"^(?:知识点|考点|要点)\s*[零〇一二三四五六七八九十0-9]*{_GAP}(.+)$", rf"^第{_COUNT}+节{_GAP}(.+)$", r"^(?:[（(]?[一二三四五六七八九十0-9]{1,3}[）)、.．]|[0-9]{1,2}[.．、])\s*(.+)$")
NOT_HEADINGS = ("目录", "本章小结", "复习思考题", "练习题", "学习目标", "考试大纲", "参考答案", "附录", "二维码")
PREFIXES = (rf"^第{_COUNT}+[章节篇编单元讲部分]\s*", rf"^(?:专题|模块)\s*{_COUNT}+\s*")
CHAPTER_CHARS, POINT_LINE_CHARS, POINT_CHARS, TOPIC_CHARS = 64, 56, (2, 40), (2, 18)
#: What to add to a chapter by the words that it has; the last holds for all others (fixed values).
HINTS = (
    (("税", "纳税"), ("征税范围", "计税依据", "应纳税额计算", "税收优惠与征管", "易错辨析")), (("会计", "资产", "负债", "收入", "报表"), ("确认条件", "初始计量", "后续计量", "列报与披露", "典型分录")),
    (("审计", "证据", "控制"), ("目标与程序", "风险识别", "证据获取", "底稿与结论", "易错辨析")), (("财务", "财管", "成本", "预算"), ("指标口径", "计算模型", "决策方法", "风险与评价", "综合题型")),
    (("法", "合同", "公司", "证券"), ("主体与权利义务", "成立与效力", "责任承担", "争议处理", "案例辨析")), ((), ("基本概念", "核心规则", "方法步骤", "典型题型", "易错辨析")),
)
TOPIC_POINT, BASE_CHAPTERS = "核心考点", ("基础知识", "核心概念", "规则与方法", "综合应用", "真题与易错点")


def clean_heading(c: Column) -> Column:
    """One line with single blanks, without leader dots and a page number, or dashes around it."""
    text = F.regexp_replace(F.trim(F.regexp_replace(c, r"[\s\x{00A0}\x{3000}]+", " ")), r"[.·•…]{2,}\s*[0-9]+\s*$", "")
    return F.regexp_replace(text, r"^[ \-—_]+|[ \-—_]+$", "")


def _noisy(c: Column) -> Column:
    return reduce(lambda a, w: a | F.contains(c, F.lit(w)), NOT_HEADINGS, F.lit(False))


def chapter_heading(line: Column) -> Column:
    """The chapter that a clean line names, else null."""
    parts = lambda p: clean_heading(F.concat_ws(" ", F.regexp_extract(line, p, 1), F.nullif(F.regexp_extract(line, p, 2), F.lit(""))))
    return F.when((F.length(line) <= CHAPTER_CHARS) & ~_noisy(line), F.coalesce(*(F.when(line.rlike(p), parts(p)) for p in CHAPTERS)))


def point_heading(line: Column) -> Column:
    """The point that a clean line names, else null."""
    name = F.coalesce(*(F.when(line.rlike(p), clean_heading(F.regexp_extract(line, p, 1))) for p in POINT_MARKS))
    fits = F.length(name).between(*POINT_CHARS) & ~_noisy(name) & ~name.rlike(r"^[0-9\s.．、]+$") & ~name.rlike("[。；;]$")
    return F.when((F.length(line) <= POINT_LINE_CHARS) & ~_noisy(line) & chapter_heading(line).isNull() & fits, name)


def _first_of_each(names: Column) -> Column:
    """Clean names, each key once."""
    clean = F.filter(F.transform(names, clean_heading), lambda x: x != "")
    # Names and keys are bound by lambdas: each is made once, and not for every pair of names.
    first = lambda found, keys: F.filter(found, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)
    return once(clean, lambda found: once(F.transform(found, entity_key), lambda keys: first(found, keys)))


def chapter_core(chapter: Column) -> Column:
    """A chapter's name without its number."""
    bare = reduce(lambda c, p: F.trim(F.regexp_replace(c, p, "")), PREFIXES, chapter)
    return F.coalesce(F.nullif(bare, F.lit("")), chapter)


def topics_of(c: Column) -> Column:
    """Parts of a name between commas and conjunctions, of 2 to 18 characters."""
    return F.filter(F.transform(F.split(c, r"[、，,和与及/／]+"), clean_heading), lambda x: F.length(x).between(*TOPIC_CHARS))


def auto_keywords(points: DataFrame, most: int = 8) -> DataFrame:
    """(id, place, keyword) of points (id, name, chapter, subject, category, tags): name, chapter without its number, subject, category, topics of the name, and the edition that a tag ``version:`` names; each key once, in order."""
    one = F.transform(F.array("name", chapter_core(F.col("chapter")), "subject", "category"), lambda x: F.coalesce(x, F.lit("")))
    words = F.concat(one, F.coalesce(topics_of(F.col("name")), F.array()), F.array(F.coalesce(tag_value(F.col("tags"), "version"), F.lit(""))))
    return points.select("id", F.posexplode(F.slice(_first_of_each(words), 1, most)).alias("place", "keyword"))


def fallback_points(chapter: Column, signal: Column) -> Column:
    """Points made up for a chapter: one for each of its topics, and hints by the words of chapter and signal."""

    def hints(said: Column) -> Column:
        found = None
        for words, own in reversed(HINTS):
            named = F.array(*map(F.lit, own))
            found = named if found is None else F.when(reduce(lambda a, w: a | F.contains(said, F.lit(w)), words, F.lit(False)), named).otherwise(found)
        return found

    def points(core: Column) -> Column:
        made = F.transform(F.filter(topics_of(core), lambda t: t != core), lambda t: F.concat(t, F.lit(TOPIC_POINT)))
        return F.concat(made, F.transform(once(F.concat(core, signal), hints), lambda h: F.concat(core, h)))

    return _first_of_each(once(chapter_core(chapter), points))


def textbook_outline(lines: DataFrame, max_chapters: int = 40, max_points: int = 12) -> DataFrame:
    """(doc_id, chapter_no, chapter, point_no, point) from lines (doc_id, line_no, text) of books.

    The first ``max_chapters`` chapter headings of different names cut a book; the point headings up to the next of them
    are a chapter's points, each name once, topped up with made-up ones to ``max_points``.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.select("doc_id", "line_no", clean_heading(F.coalesce("text", F.lit(""))).alias("line")).where("line <> ''").withColumn("chapter", chapter_heading(F.col("line")))
    heads = rows.where("chapter IS NOT NULL").groupBy("doc_id", entity_key(F.col("chapter")).alias("k")).agg(F.min(F.struct("line_no", "chapter")).alias("h"))
    heads = heads.select("doc_id", "h.line_no", F.col("h.chapter").alias("name"), F.row_number().over(Window.partitionBy("doc_id").orderBy("h.line_no")).cast("long").alias("chapter_no")).where(F.col("chapter_no") <= max_chapters)
    cut = rows.join(heads.select("doc_id", "line_no", "chapter_no"), ["doc_id", "line_no"], "left").withColumn("of", F.last("chapter_no", ignorenulls=True).over(order))
    points = cut.where("of IS NOT NULL AND chapter IS NULL").select("doc_id", F.col("of").alias("chapter_no"), "line_no", point_heading(F.col("line")).alias("point")).where("point IS NOT NULL")
    points = points.groupBy("doc_id", "chapter_no", entity_key(F.col("point")).alias("k")).agg(F.min(F.struct("line_no", "point")).alias("p"))
    kept = points.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "chapter_no").orderBy("p.line_no"))).where(F.col("r") <= max_points)
    own = kept.groupBy("doc_id", "chapter_no").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["point"]).alias("own"))
    found = heads.join(own, ["doc_id", "chapter_no"], "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    topped = F.slice(F.concat("own", F.array_except(fallback_points(F.col("name"), F.col("name")), "own")), 1, max_points)
    return found.select("doc_id", "chapter_no", F.col("name").alias("chapter"), F.posexplode_outer(topped).alias("pos", "point")).select("doc_id", "chapter_no", "chapter", (F.col("pos") + 1).cast("long").alias("point_no"), "point")


def metadata_outline(books: DataFrame, templates: DataFrame, max_chapters: int = 40, max_points: int = 12) -> DataFrame:
    """The same for books (doc_id, title, subject, category, tags) without chapters of their own, from ``templates`` (ord, keyword, chapters).

    The template of the smallest ``ord`` whose keyword is in the category counts, else one in the book's name within 《》,
    else one in all that is known of it; without any, five chapters are made of the category or subject.
    """
    name = F.regexp_extract(F.coalesce("title", F.lit("")), "《([^》]+)》", 1)
    rows = books.select("doc_id", F.coalesce("category", F.lit("")).alias("s0"), name.alias("s1"), F.concat_ws(" ", "category", name, "title", "subject", F.array_join("tags", " ")).alias("s2"), F.coalesce(F.nullif("category", F.lit("")), F.nullif(name, F.lit("")), "subject").alias("base"))
    listed = templates.agg(F.array_sort(F.collect_list(F.struct("ord", "keyword", "chapters"))).alias("t"))  # a small table of templates, as one row
    # A book costs far more than its bytes say, so few small files must not make few tasks.
    rows = spread(rows, "doc_id").join(F.broadcast(listed))
    match = lambda s: F.get(F.filter("t", lambda t: F.contains(F.col(s), t["keyword"])), 0)["chapters"]
    made = F.transform(F.array(*map(F.lit, BASE_CHAPTERS)), lambda b: F.concat("base", b))
    chapters = F.slice(_first_of_each(F.coalesce(match("s0"), match("s1"), match("s2"), made)), 1, max_chapters)
    rows = rows.select("doc_id", "s2", F.posexplode(chapters).alias("c", "chapter"))
    points = F.slice(fallback_points(F.col("chapter"), F.col("s2")), 1, max_points)
    return rows.select("doc_id", (F.col("c") + 1).cast("long").alias("chapter_no"), "chapter", F.posexplode_outer(points).alias("pos", "point")).select("doc_id", "chapter_no", "chapter", (F.col("pos") + 1).cast("long").alias("point_no"), "point")


def outline_tasks(outline: DataFrame, open_tasks: DataFrame) -> DataFrame:
    """One review task per book with an outline, unless one is open."""
    return outline.select("doc_id").distinct().join(open_tasks.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit("review_outline").alias("task"))
