"""Knowledge tagging: dictionary matches, suggestions, merges, and the tag that counts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import spread

#: Scores of a match by kind of term (fixed values).
NAME, ALIAS, KEYWORD, LEAF = 80, 65, 55, 35


def primary_tag(tags: DataFrame) -> DataFrame:
    """(question_id, point_id): the primary tag with the smallest confirmed id, else the smallest suggested id."""
    primary = tags.where("relation_type = 'primary' AND status IN ('confirmed', 'suggested')")
    order = F.struct(F.when(F.col("status") == "confirmed", 0).otherwise(1).alias("s"), "tag_id", "point_id")
    return primary.groupBy("question_id").agg(F.min(order).alias("m")).select("question_id", F.col("m.tag_id").alias("tag_id"), F.col("m.point_id").alias("point_id"))


#: Columns by which a text meets the terms of its own subject only; with a category, of that alone.
_SCOPE, _WITHIN = "subject_id", "category_id"


def _scoped(rows: DataFrame) -> list[str]:
    return [c for c in (_SCOPE, _WITHIN) if c in rows.columns]


def term_table(points: DataFrame) -> DataFrame:
    """(term, point_id, score, ord) of points (id, name, aliases, keywords, path, chapter_id), with their subject_id and category_id where they have them; terms shorter than two characters are left out."""
    kinds = [
        (F.array("name"), NAME, 0), (F.col("aliases"), ALIAS, 1), (F.col("keywords"), KEYWORD, 2),
        (F.when(F.col("chapter_id").isNotNull(), F.array(F.element_at(F.split("path", "/"), -1))), LEAF, 3),
    ]
    out = None
    for terms, score, kind in kinds:
        rows = points.select(F.col("id").alias("point_id"), *_scoped(points), F.posexplode(F.coalesce(terms, F.array().cast("array<string>"))).alias("pos", "term"))
        rows = rows.select(F.lower(F.trim("term")).alias("term"), "point_id", F.lit(score).alias("score"), (F.lit(kind * 1000) + F.col("pos")).alias("ord"), *_scoped(points))
        out = rows if out is None else out.unionByName(rows)
    return out.where(F.length("term") >= 2)


def _grams(text: Column) -> Column:
    """Distinct two-character pieces of a text."""
    even, odd = (F.regexp_extract_all(t, F.lit("(?s).."), F.lit(0)) for t in (text, F.substr(text, F.lit(2))))
    return F.array_distinct(F.concat(even, odd))


#: Distinct terms up to which texts are read by one automaton.
AUTOMATON_TERMS = 20_000
#: Texts that a task holds as Python's strings at once.
TEXTS_HELD = 256


def match_terms(texts: DataFrame, terms: DataFrame, most: int = AUTOMATON_TERMS) -> DataFrame:
    """(id, term columns) for every text (id, body) that contains a term.

    Texts with a ``subject_id`` meet the terms of their subject only, and those with a ``category_id`` that is not null
    only terms of that category.  Up to ``most`` distinct terms of subjects go to the tasks, where each subject has its
    own automaton, which reads a text once.  More terms meet the texts by two-character pieces: each term is known by the
    piece that the fewest texts of its subject hold, texts meet it on that piece, and containment is then checked.  No
    pair of text and term that share no piece, or no subject, is made.
    """
    scope = [_SCOPE] if _SCOPE in texts.columns and _SCOPE in terms.columns else []
    within = scope and _WITHIN in texts.columns and _WITHIN in terms.columns
    texts = texts.select("id", "body", *scope, *([F.col(_WITHIN).alias("only")] if within else []))
    if scope:
        texts = texts.where(F.col(_SCOPE).isNotNull())
    texts = spread(texts, "id")  # a file may hold all its texts in one piece
    names = terms.select("term", *scope).distinct().limit(most + 1).collect()
    found = _by_automaton(texts, names, scope) if len(names) <= most else _by_pieces(texts, terms, scope)
    met = found.join(terms, ["term", *scope])
    if within:
        met = met.where(F.col("only").isNull() | (F.col("only") == F.col(_WITHIN))).drop("only")
    return met


def _by_automaton(texts: DataFrame, names: list[Row], scope: list[str]) -> DataFrame:
    by_scope: dict = {}
    for r in names:
        by_scope.setdefault(r[scope[0]] if scope else None, []).append(r.term)
    rest = [f for f in texts.schema.fields if f.name != "body"]
    names_of = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        readers: dict = {}

        def reader_of(key: object) -> object:
            if key not in readers:
                readers[key] = ahocorasick.Automaton()
                for name in by_scope[key]:
                    readers[key].add_word(name, name)
                readers[key].make_automaton()
            return readers[key]

        # Of a batch, few texts at a time become Python's strings, and the other columns stay Arrow's.
        for part in (b.slice(at, TEXTS_HELD) for b in batches for at in range(0, b.num_rows, TEXTS_HELD)):
            keys = part.column(scope[0]).to_pylist() if scope else [None] * part.num_rows
            held = [sorted({x for _, x in reader_of(k).iter(t)}) if t and k in by_scope else [] for k, t in zip(keys, part.column("low").to_pylist())]
            rows = part.select(names_of).take(pa.array([i for i, h in enumerate(held) for _ in h], pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([x for h in held for x in h], pa.string())], names=[*names_of, "term"])

    low = texts.select(*names_of, F.lower("body").alias("low"))
    return low.mapInArrow(run, T.StructType([*rest, T.StructField("term", T.StringType())])).distinct()


def _by_pieces(texts: DataFrame, terms: DataFrame, scope: list[str]) -> DataFrame:
    pieces = terms.select("term", *scope).distinct().select("term", *scope, F.explode(_grams(F.col("term"))).alias("gram"))
    used = pieces.select("gram", *scope).distinct()
    held = texts.select("id", *scope, F.explode(_grams(F.lower("body"))).alias("gram")).join(used, ["gram", *scope], "left_semi")
    common = held.groupBy("gram", *scope).agg(F.count(F.lit(1)).alias("n"))
    # A piece that no text holds rules its terms out.
    rarest = pieces.join(common, ["gram", *scope], "left").groupBy("term", *scope).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m")).where("m.n > 0").select("term", *scope, F.col("m.gram").alias("gram"))
    met = held.join(rarest, ["gram", *scope]).select("id", "term")
    return met.join(texts.withColumn("low", F.lower("body")).drop("body"), "id").where(F.contains(F.col("low"), F.col("term"))).drop("low").distinct()


def match_points(texts: DataFrame, terms: DataFrame, most: int = AUTOMATON_TERMS) -> DataFrame:
    """Best score per text and point; of equal scores the first term's."""
    best = F.max_by(F.struct("score", "term"), F.struct("score", -F.col("ord")))
    return match_terms(texts, terms, most).groupBy("id", "point_id").agg(best.alias("b")).select("id", "point_id", F.col("b.score").alias("score"), F.col("b.term").alias("reason"))


def suggest_tags(matches: DataFrame, confirmed: DataFrame, points: DataFrame, k: int = 5) -> DataFrame:
    """The k best points per text that are not confirmed, by score, the point's ``sort_order`` and id: (id, point_id, rank_no, relation_type, confidence)."""
    rest = matches.join(confirmed.select("id", "point_id"), ["id", "point_id"], "left_anti").join(points.select(F.col("id").alias("point_id"), "sort_order"), "point_id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "sort_order", "point_id"))
    return rest.withColumn("rank_no", rank).where(F.col("rank_no") <= k).select(
        "id", "point_id", "rank_no", F.when(F.col("rank_no") == 1, "primary").otherwise("secondary").alias("relation_type"), F.bround(F.least(F.col("score") / 100, F.lit(1.0)), 2).alias("confidence")
    )


def by_model(source: Column) -> Column:
    """Whether a tag comes from a model."""
    return F.startswith(F.lower(F.trim(F.coalesce(source, F.lit("")))), F.lit("ai"))


def tag_targets(questions: DataFrame, tags: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """(question_id, paper_id, skipped): questions (id, paper_id, parent_id, node_role) that a model is to tag.

    These are all that are no group; those that a model has tagged are skipped.  Where ``forced`` (id) is given, these
    alone, a group by its children, and none is skipped.
    """
    leaves = questions.where("node_role <> 'group'")
    if forced is not None:
        ids = forced.select(F.col("id").alias("forced_id")).distinct()
        leaves = leaves.join(ids, (F.col("id") == F.col("forced_id")), "left_semi").unionByName(leaves.join(ids, F.col("parent_id") == F.col("forced_id"), "left_semi")).distinct()
        return leaves.select(F.col("id").alias("question_id"), "paper_id", F.lit(False).alias("skipped"))
    done = tags.where(by_model(F.col("source"))).select(F.col("question_id").alias("id")).distinct().withColumn("skipped", F.lit(True))
    return leaves.join(done, "id", "left").select(F.col("id").alias("question_id"), "paper_id", F.coalesce("skipped", F.lit(False)).alias("skipped"))


def _accepted(incoming: DataFrame, points: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """The first k known points, each once, that came in for a question that is to be tagged."""
    known = incoming.join(points.select(F.col("id").alias("point_id")), "point_id", "left_semi").join(targets.where("NOT skipped").select("question_id"), "question_id", "left_semi")
    once = known.groupBy("question_id", "point_id").agg(F.min(F.struct("ord", "confidence")).alias("m"))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy("m.ord", "point_id"))
    return once.withColumn("rank_no", rank.cast("long")).where(F.col("rank_no") <= k)


def merge_external_tags(tags: DataFrame, incoming: DataFrame, points: DataFrame, targets: DataFrame, k: int = 3) -> DataFrame:
    """Tags after those of a model, ``incoming`` (question_id, point_id, ord, confidence), came in for :func:`tag_targets`.

    A target with at least one known point keeps its confirmed tags and gets the first k points instead of all others;
    a point that is confirmed already is left out, but keeps its rank, and only rank 1 is primary.  All other questions
    keep what they had.
    """
    accepted = _accepted(incoming, points, targets, k)
    confirmed = tags.where("status = 'confirmed'").select("question_id", "point_id").distinct()
    new = accepted.join(confirmed, ["question_id", "point_id"], "left_anti").select(
        "question_id", "point_id", F.lit("suggested").alias("status"), F.when(F.col("rank_no") == 1, "primary").otherwise("secondary").alias("relation_type"), F.lit("ai").alias("source"),
        "rank_no", F.least(F.greatest(F.col("m.confidence"), F.lit(0.0)), F.lit(1.0)).alias("confidence"),
    )
    touched = accepted.select("question_id", F.lit(True).alias("touched")).distinct()
    old = tags.join(touched, "question_id", "left").where("touched IS NULL OR status = 'confirmed'")
    return old.select(*new.columns).unionByName(new)


def external_tag_counts(incoming: DataFrame, points: DataFrame, targets: DataFrame, k: int = 3) -> DataFrame:
    """Per paper: questions asked for, updated, failed (no known point came in) and skipped."""
    done = _accepted(incoming, points, targets, k).select("question_id", F.lit(True).alias("done")).distinct()
    asked = ~F.col("skipped")
    return targets.join(done, "question_id", "left").groupBy("paper_id").agg(
        F.count_if(asked).alias("requested"), F.count_if(asked & F.col("done").isNotNull()).alias("updated"), F.count_if(asked & F.col("done").isNull()).alias("failed"), F.count_if("skipped").alias("skipped")
    )


def check_tags(tags: DataFrame, points: DataFrame, groups: DataFrame) -> DataFrame:
    """(question_id, violation): point out of scope, repeated point, several confirmed primaries, tagged group."""
    scope = tags.join(points.select(F.col("id").alias("point_id")), "point_id", "left_anti").select("question_id", F.lit("out_of_scope").alias("violation"))
    live = tags.where("status <> 'rejected'")
    twice = live.groupBy("question_id", "point_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("question_id", F.lit("duplicate_point").alias("violation"))
    primaries = live.where("status = 'confirmed' AND relation_type = 'primary'").groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = primaries.select("question_id", F.lit("several_primaries").alias("violation"))
    group = live.join(groups.select("question_id"), "question_id", "left_semi").select("question_id", F.lit("group_tagged").alias("violation"))
    return scope.unionByName(twice).unionByName(several).unionByName(group).distinct()


def item_points(links: DataFrame, tags: DataFrame) -> DataFrame:
    """Points shown for a bank item, in order: confirmed before suggested, then rank and tag id; each point once."""
    rows = links.where("status = 'active'").join(tags.where("status IN ('confirmed', 'suggested')").withColumnRenamed("status", "tag_status"), links["source_question_id"] == tags["question_id"])
    order = F.struct(F.when(F.col("tag_status") == "confirmed", 0).otherwise(1).alias("s"), "rank_no", "tag_id")
    once = rows.groupBy("bank_question_id", "point_id").agg(F.min(order).alias("o"))
    place = F.row_number().over(Window.partitionBy("bank_question_id").orderBy("o", "point_id"))
    return once.select("bank_question_id", "point_id", place.cast("long").alias("place"))


def child_order(number: Column, id_: Column) -> list[Column]:
    """Children by the first number in theirs, by the whole number (the id where there is none), and by id."""
    no = F.trim(F.coalesce(number, F.lit("")))
    return [F.coalesce(F.nullif(F.regexp_extract(no, "[0-9]+", 0), F.lit("")).cast("long"), F.lit(10**9)), F.coalesce(F.nullif(no, F.lit("")), id_.cast("string")), id_]


def group_points(shown: DataFrame, items: DataFrame) -> DataFrame:
    """Points of groups, from those shown for items (:func:`item_points`): the union over a group's children in order, each point once.  ``items`` is (id, parent_id, question_no)."""
    keys = [c.alias(f"k{n}") for n, c in enumerate(child_order(F.col("question_no"), F.col("id")))]
    rows = shown.join(items.where("parent_id IS NOT NULL").select(F.col("id").alias("bank_question_id"), "parent_id", F.struct(*keys).alias("child")), "bank_question_id")
    once = rows.groupBy("parent_id", "point_id").agg(F.min(F.struct("child", "place")).alias("o"))
    place = F.row_number().over(Window.partitionBy("parent_id").orderBy("o", "point_id"))
    return once.select(F.col("parent_id").alias("bank_question_id"), "point_id", place.cast("long").alias("place"))
