"""Operational tables: search, keep-latest, event versions, boards, reconciliation, orphans and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _contains(names: tuple[str, ...], word: str) -> Column:
    out = F.lit(False)
    for c in names:
        out = out | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(word.lower()))
    return out


def _equal(rows: DataFrame, **wanted: object) -> DataFrame:
    for name, value in wanted.items():
        if value is not None and value != "":
            rows = rows.where(F.col(name) == value)
    return rows


def search_library(files: DataFrame, keyword: str | None = None, subject: str | None = None, category: str | None = None, source_type: str | None = None) -> DataFrame:
    """Files by subject, category and type, whose name, title or tags (a text) have the keyword, newest first."""
    found = _equal(files, subject=subject, category=category, source_type=source_type)
    found = found.where(_contains(("filename", "title", "tags"), keyword)) if keyword else found
    return found.orderBy(F.desc("created_at"), F.desc("id"))


def keep_latest(results: DataFrame, key: str, order: list[str], n: int = 2) -> DataFrame:
    """The n latest results per key with their sequence numbers, and whether each is the latest."""
    by = Window.partitionBy(key)
    seq = F.row_number().over(by.orderBy(*order)).cast("long")
    back = F.row_number().over(by.orderBy(*(F.desc(c) for c in order)))
    return results.withColumn("seq", seq).withColumn("back", back).where(F.col("back") <= n).withColumn("is_latest", F.col("back") == 1).drop("back")


def file_texts(files: DataFrame, results: DataFrame) -> DataFrame:
    """Files with the text and token count of their latest parse result (file_id, seq, text, tokens), and its number; files without one keep theirs."""
    last = results.groupBy(F.col("file_id").alias("id")).agg(F.max_by(F.struct("text", "tokens", "seq"), "seq").alias("r"))
    return files.join(last, "id", "left").select("id", F.when(F.col("r").isNotNull(), F.col("r.text")).otherwise(F.col("text")).alias("text"), F.coalesce("r.tokens", "tokens").alias("tokens"), F.col("r.seq").alias("seq"))


def version_events(events: DataFrame) -> DataFrame:
    """Versions 1, 2, ... per topic in order of time and id; the version's id is ``topic:version``."""
    version = F.row_number().over(Window.partitionBy("topic_id").orderBy("created_at", "id")).cast("long")
    return events.withColumn("version", version).withColumn("version_id", F.concat_ws(":", "topic_id", "version"))


def latest_state(events: DataFrame) -> DataFrame:
    """Latest status per topic, and how many versions it has."""
    last = F.max_by(F.struct("status", "scheduled_date", "created_at"), F.struct("created_at", "id"))
    return events.groupBy("topic_id").agg(last.alias("s"), F.count(F.lit(1)).alias("versions")).select("topic_id", "s.status", "s.scheduled_date", F.col("s.created_at").alias("updated_at"), "versions")


def list_topics(topics: DataFrame, date_from: Column | None = None, date_to: Column | None = None, status: str | None = None, owner: str | None = None, search: str | None = None) -> DataFrame:
    """Topics by status, owner, date, and words in title, brief, chapter or goal; by date, undated last, then newest; with a range, undated ones fall out."""
    found = _equal(topics, status=status, owner=owner)
    if date_from is not None:
        found = found.where(F.col("scheduled_date") >= date_from)
    if date_to is not None:
        found = found.where(F.col("scheduled_date") <= date_to)
    if search:
        found = found.where(_contains(("title", "brief", "chapter", "content_goal"), search))
    return found.orderBy(F.col("scheduled_date").asc_nulls_last(), F.desc("updated_at"), "topic_id")


#: States of topics in the order of the board's columns (fixed values).
BOARD = ("idea", "planned", "generated", "needs_changes", "awaiting_confirm", "approved")


def board(topics: DataFrame, columns: tuple[str, ...] | None = BOARD) -> DataFrame:
    """(place, status, topics, dated): the board's columns with their topics, empty ones too; all states by name if there are no columns."""
    counts = topics.groupBy("status").agg(F.count(F.lit(1)).alias("topics"), F.count("scheduled_date").alias("dated"))
    if columns is None:
        return counts.select(F.lit(None).cast("long").alias("place"), "status", "topics", "dated")
    named = topics.sparkSession.createDataFrame([(k, c) for k, c in enumerate(columns)], "place long, status string")
    return F.broadcast(named).join(counts, "status", "left").select("place", "status", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("topics", "dated")))


def owners(topics: DataFrame) -> DataFrame:
    """Each owner once, with the number of topics."""
    return topics.where("coalesce(owner, '') <> ''").groupBy("owner").agg(F.count(F.lit(1)).alias("topics"))


#: Jobs that a restart interrupts, and in which states; states of papers and assets that a running parse passes through (fixed values).
RESTARTED, UNFINISHED = ("paper_parse", "library_parse"), ("pending", "running")
PARSING = (
    "preparing", "reading_file", "ocr_running", "layout_analyzing", "ocr_fallback_running", "vl15_running", "ai_cleaning", "splitting_questions", "building_sections", "tagging", "saving", "parsing",
)
FULL, OCR_ONLY, RESTART, RESTART_TEXT = "full_chain", "ocr_only", "service_restarted", "the service was restarted and the job interrupted; please start it again"


def _unfinished() -> Column:
    return F.col("job_type").isin(*RESTARTED) & F.col("status").isin(*UNFINISHED)


def fail_interrupted(jobs: DataFrame) -> DataFrame:
    """The jobs, those that a restart interrupted as failed; their columns ``progress``, ``stage``, ``termination_reason`` and ``error_message`` say so, and are null for the others."""
    off = _unfinished()
    return jobs.withColumns({"status": F.when(off, "failed").otherwise(F.col("status")), "progress": F.when(off, 100), "stage": F.when(off, "failed"), "termination_reason": F.when(off, RESTART), "error_message": F.when(off, RESTART_TEXT)})


def _read(json: str, key: str, kind: str) -> Column:
    """A value of a JSON text, null where the text or the value is not of its kind."""
    return F.try_variant_get(F.try_parse_json(F.col(json)), f"$.{key}", kind)


def reconcile(jobs: DataFrame, papers: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers (id, status, changed) and assets (id, parse_status, ocr_status, changed) as the jobs that parse papers have them.

    Jobs are (id, job_type, scope_type, status, scope, summary), the last two as JSON with ``paper_id`` and
    ``execution_mode``.  Interrupted ones fail first, with their paper and its asset.  Then the latest job of each paper
    counts: a completed one makes paper and asset ``parsed`` (``source_ready`` if it only read the text, and they are not
    parsed yet) and the text recognised; a failed one ends states of a running parse alone.  An asset of several papers
    follows all their latest jobs; the outcome does not depend on their order.  All else stays as it is.
    """
    parses = jobs.where("scope_type = 'paper' AND job_type = 'paper_parse'").withColumn("paper_id", _read("scope", "paper_id", "bigint")).where("paper_id > 0")
    mode = F.coalesce(F.nullif(_read("summary", "execution_mode", "string"), F.lit("")), F.nullif(_read("scope", "execution_mode", "string"), F.lit("")), F.lit(FULL))
    last = F.max_by(F.struct(F.when(_unfinished(), "failed").otherwise(F.col("status")).alias("job"), mode.alias("mode")), "id")
    by_paper = parses.groupBy("paper_id").agg(last.alias("last"), F.bool_or(_unfinished()).alias("broken")).select(F.col("paper_id").alias("id"), "last.job", "last.mode", "broken")
    rows = papers.select("id", "asset_id", "status").join(by_paper, "id", "left").withColumn("broken", F.coalesce("broken", F.lit(False)))
    read_only, done, failed = F.col("mode") == OCR_ONLY, F.coalesce(F.col("job") == "completed", F.lit(False)), F.coalesce(F.col("job") == "failed", F.lit(False))
    was = F.when(F.col("broken"), "parse_failed").otherwise(F.col("status"))
    status = F.when(done & read_only & ~was.eqNullSafe(F.lit("parsed")), "source_ready").when(done, "parsed").when(failed & was.isin(*PARSING), "parse_failed").otherwise(was)
    new_papers = rows.select("id", status.alias("status"), (~status.eqNullSafe(F.col("status"))).alias("changed"))
    flags = {"broken": F.col("broken"), "parsed": done & ~read_only, "read": done & read_only, "failed": failed}
    by_asset = rows.where("asset_id IS NOT NULL").groupBy(F.col("asset_id").alias("id")).agg(*(F.bool_or(F.coalesce(c, F.lit(False))).alias(f"any_{n}") for n, c in flags.items()))
    held = assets.select("id", "parse_status", "ocr_status").join(by_asset, "id", "left").na.fill(False, [f"any_{n}" for n in flags])
    parse_was, ocr_was = (F.when(F.col("any_broken"), "failed").otherwise(F.col(c)) for c in ("parse_status", "ocr_status"))
    parse = F.when(F.col("any_parsed") | F.col("any_read") & parse_was.eqNullSafe(F.lit("parsed")), "parsed").when(F.col("any_read"), "source_ready").when(F.col("any_failed") & parse_was.isin(*PARSING), "failed").otherwise(parse_was)
    ocr = F.when(F.col("any_parsed") | F.col("any_read"), "completed").when(F.col("any_failed") & (ocr_was == "running"), "failed").otherwise(ocr_was)
    changed = ~(parse.eqNullSafe(F.col("parse_status")) & ocr.eqNullSafe(F.col("ocr_status")))
    return new_papers, held.select("id", parse.alias("parse_status"), ocr.alias("ocr_status"), changed.alias("changed"))


def orphan_entries(entries: DataFrame, namespaces: DataFrame, hashes: DataFrame) -> DataFrame:
    """kept, orphan or unmarked for cache entries (id, namespace, sha256): live by namespace, else by hash."""
    rows = entries.join(namespaces.select(F.col("namespace").alias("ln")).distinct(), F.col("namespace") == F.col("ln"), "left").join(hashes.select(F.col("sha256").alias("lh")).distinct(), F.col("sha256") == F.col("lh"), "left")
    state = F.when(F.col("namespace").isNotNull(), F.when(F.col("ln").isNotNull(), "kept").otherwise("orphan")).when(F.col("sha256").isNotNull(), F.when(F.col("lh").isNotNull(), "kept").otherwise("orphan")).otherwise("unmarked")
    return rows.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def removable_assets(papers: DataFrame, paper_ids: DataFrame, assets: DataFrame) -> DataFrame:
    """(asset_id, drop_cache): assets (id, sha256) of the given papers that no other paper uses, and whether the cache of their hash can go too, since no asset that stays has it."""
    going = papers.join(paper_ids, "id", "left_semi").select("asset_id").distinct()
    staying = papers.join(paper_ids, "id", "left_anti").select("asset_id").distinct()
    gone = going.join(staying, "asset_id", "left_anti").join(assets.select(F.col("id").alias("asset_id"), "sha256"), "asset_id", "left")
    live = assets.join(gone.select(F.col("asset_id").alias("id")), "id", "left_anti").select("sha256").distinct().withColumn("live", F.lit(True))
    return gone.join(live, "sha256", "left").select("asset_id", (F.col("sha256").isNotNull() & F.col("live").isNull()).alias("drop_cache"))


def audit_feed(logs: DataFrame, users: DataFrame) -> DataFrame:
    """Log rows with the user's name, latest first (by created_at and id); values of payload keys that hold a password or token are masked."""
    secret = lambda k: F.lower(k).rlike("password|token")
    masked = F.transform_values("payload", lambda k, v: F.when(secret(k), F.lit("***")).otherwise(v))
    return logs.withColumn("payload", masked).join(users, "user_id", "left").orderBy(F.desc("created_at"), F.desc("id"))


def list_papers(papers: DataFrame, status: str | None = None) -> DataFrame:
    """Papers by year and id, newest first."""
    return _equal(papers, status=status).orderBy(F.desc("exam_year"), F.desc("id"))


def list_textbooks(assets: DataFrame, subject_id: int | None = None) -> DataFrame:
    """Assets that are textbooks, of a subject if one is given, newest first."""
    return _equal(assets, source_type="textbook", subject_id=subject_id).orderBy(F.desc("created_at"), F.desc("id"))


def list_generations(jobs: DataFrame, status: str | None = None) -> DataFrame:
    """Generation jobs, newest first."""
    return _equal(jobs, status=status).orderBy(F.desc("created_at"), F.desc("id"))
