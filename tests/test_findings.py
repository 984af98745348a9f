"""Queries against their SQL on tables where they once differed, and plans that once outgrew the driver."""

from __future__ import annotations

import math
import re
import shutil
from operator import mul
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from studyflow import registry
from studyflow.functions import marks as M
from studyflow.functions.text import SPACE, strip
from studyflow.operators import corpus as X
from studyflow.operators import bank, learning, tagging
from studyflow.operators.verify import top_k_similar
from studyflow.streaming import learning as L
from tests.oracle import difference

SMALL = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def texts(spark, tmp_path):
    """Makes a folder of the small tables whose documents are the given texts, by id."""

    def made(found: dict[int, str | None]) -> str:
        for path in Path(SMALL).glob("*.parquet"):
            if path.stem != "documents":
                shutil.copyfile(path, tmp_path / path.name)
        rows = [(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in found.items()]
        spark.createDataFrame(rows, DOCUMENTS).coalesce(1).toPandas().to_parquet(tmp_path / "documents.parquet", index=False)
        return str(tmp_path)

    return made


def same(spark, name, folder):
    return difference(registry.queries()[name](spark, folder), registry.oracle_sql()[name], folder)


def test_best_of_two_cut_at_half_an_odd_length(spark, texts):
    """Half a character goes to the even length, as in the SQL."""
    assert same(spark, "b13_pick_best", texts({1: "b" * 24 + "\nc" * 11 + "\n", 4: "b" * 23 + "\nc" * 10 + "\n\n", 7: "b" * 48})) == ""


def test_chunk_cut_just_past_the_half(spark, texts):
    assert same(spark, "b18_chunk", texts({k: "a" * k + "\n" + "b" * 5000 for k in range(1996, 2006)})) == ""


def test_quotes_in_the_white_space_that_a_body_begins_with(spark, texts):
    assert same(spark, "i7_replace_quotes", texts({1: " \n\t" * 14 + "one two three", 2: None, 3: "", 4: "\n" * 80, 5: "plain " * 10})) == ""


@pytest.mark.parametrize("name", ["f8_export_records", "f10_markdown", "f10_markdown_appendix"])
def test_export_broadcasts_no_texts(spark, name):
    """Repeated texts lie small in files: by their size there, the driver would be sent the reviews and items."""
    plan = registry.queries()[name](spark, SMALL)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("name", ["b8_entry_numbers", "b10_clean_pages", "b11_full_report"])
def test_pages_make_no_group_each(spark, name):
    plan = registry.queries()[name](spark, SMALL)._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def test_greater_of_saves_of_one_time(spark, tmp_path):
    """Many saves of one time: the greater answer counts, wherever it stands among them."""
    saves = spark.range(20001).selectExpr("1L AS id", "7L AS user_id", "1L AS question_id", "if(id = 0, 'B', 'A') AS answer", "timestamp'2024-01-01' AS at")
    saves.coalesce(1).write.parquet(f"file://{tmp_path}/saves")
    expected = spark.createDataFrame([(1, "A", "single")], "question_id long, expected string, question_type string")
    L.run_to_end(L.graded_stream(spark.readStream.schema(saves.schema).parquet(f"file://{tmp_path}/saves"), expected), f"file://{tmp_path}")
    assert [tuple(r) for r in spark.read.schema(L.CHANGE).parquet(f"file://{tmp_path}/out").select("id", "answer", "is_correct", "revised").collect()] == [(1, "B", False, False)]


@pytest.mark.parametrize("name", ["d1_normalize_prediction", "d2_flatten_questions", "d3_number_sections", "d4_fingerprint", "d5_compose_raw"])
def test_predictions_are_parsed_and_cleaned_once(spark, name):
    """Each text is cleaned at one place of the plan: one pass of ten cleaned texts, with five patterns each."""
    plan = registry.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count(r"\n{3,}") + plan.count("\n{3,}") <= 24


def test_similar_vectors_are_multiplied_in_batches(spark):
    """Copies, nulls and more queries than a block: as by brute force, and without a join of all pairs."""
    vec = lambda i: None if i == 11 else [float(x) for x in ((i % 40) * 7919 % 101 - 50, i % 3 - 1, 1, i % 5)]
    vectors = spark.createDataFrame([(i, vec(i)) for i in range(2300)], "vec_id long, embedding array<float>")
    found = top_k_similar(vectors.where("vec_id % 100 IN (0, 11)"), vectors, 4, 20)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()

    def score(a, b):
        return None if a is None or b is None else round(sum(map(mul, a, b)) / math.sqrt(sum(map(mul, a, a)) * sum(map(mul, b, b))), 6)

    want = []
    for q in (i for i in range(2300) if i % 100 in (0, 11)):
        ranked = sorted((-s if (s := score(vec(q), vec(i))) is not None else 9.0, i) for i in range(2300) if i != q)[:4]
        want += [(q, i, None if s == 9.0 else -s, k + 1) for k, (s, i) in enumerate(ranked)]
    assert sorted(map(tuple, found.collect()), key=lambda r: (r[0], r[3])) == want


@pytest.mark.parametrize("lines", [[(3, 1), (2, 100_001)], [(2, 100_001), (3, 1)]])
def test_role_of_lines_that_share_an_order(spark, tmp_path, lines):
    """Of two lines of one paper, fingerprint and sort order the first in the table gives the role, as in the SQL."""
    rows = [(1, part, 1, n) for n, part in lines]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").toPandas().to_parquet(tmp_path / "lineitem.parquet", index=False)
    assert same(spark, "d8_synced_papers", str(tmp_path)) == ""


class _State:
    """A state variable in memory that counts how often it is read."""

    def __init__(self):
        self.value, self.rows, self.reads = None, [], 0

    def get(self):
        self.reads += 1
        return self.value if self.value is not None else self.rows or None

    def update(self, value):
        self.value = value

    def appendList(self, rows):
        self.rows = [*self.rows, *rows]


def test_short_list_of_a_key_is_read_once():
    """The wrong book reads no list for a new key, and a short one once for a key with answers before."""
    states = {n: _State() for n in ("settled", "turn", "open_a", "open_b")}
    handle = SimpleNamespace(getValueState=lambda n, _: states[n], getListState=lambda n, _: states[n], registerTimer=lambda t: None)
    book, times = L._WrongBook(0), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    book.init(handle)
    save = lambda i, right: iter([Row(id=i, us=i * 1_000_000, is_correct=right, revised=False)])
    assert [tuple(r) for r in book.handleInputRows((7, 1), save(1, False), times)] == [(7, 1, 1, 0, False)] and states["open_a"].reads == 0
    assert [tuple(r) for r in book.handleInputRows((7, 1), save(2, True), times)] == [(7, 1, 1, 1, False)] and states["open_a"].reads == 1
    assert [tuple(r) for r in book.handleInputRows((7, 1), save(3, True), times)] == [(7, 1, 1, 2, True)] and states["open_a"].reads == 2


def test_made_outlines_clean_each_name_once(spark):
    """Keys of names are made once a name and not for every pair, hints read a chapter's name that is cleaned once, and few files make no few tasks."""
    plan = registry.queries()["j4_metadata_outline"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 40 and "RepartitionByExpression" in plan


def test_signs_and_single_blanks_as_by_pattern(spark):
    """Signs counted without a match for each word, and blanks joined without one for each blank, are what the patterns say."""
    texts = [None, "", " ", "a  b", "a b\tc", "x\u00a0 y\u3000z ", " \u3000\u3000 12 \t\n 三 4", "一鿿㐀 é ß 𠀀 A.z-9", "\ta \x0b b  ", "\u2003a\u2003 b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_replace(strip(F.col("t")), f"{SPACE}+", " ")
    for got, want in rows.select(F.struct(X.signs(F.col("t")), X._one_line(F.col("t"))), F.struct(F.regexp_count("t", F.lit(M.SIGN)), plain)).collect():
        assert tuple(got) == tuple(want)


@pytest.mark.parametrize("name", ["b6_noise_pages", "b7_classify_lines", "b10_clean_pages", "b11_full_report", "b12_quality_score"])
def test_texts_are_dealt_out_before_their_lines(spark, name, monkeypatch):
    """A file of one piece makes no single task of all lines."""
    plans = []
    monkeypatch.setattr(X, "stored", lambda df: plans.append(df) or df)
    plans.append(registry.queries()[name](spark, SMALL))
    for plan in (p._jdf.queryExecution().optimizedPlan().toString() for p in plans):
        assert re.findall(r"Generate posexplode", plan) == re.findall(r"(Generate posexplode)(?=(?:.*\n){1,12}.*RepartitionByExpression)", plan)


def test_equal_lines_of_a_batch_are_cut_once(spark):
    """Copies, blanks and nulls: each row has its parts, with its other columns, and no pandas table is made of them."""
    line = "下列关于甲的说法正确的是()。A. 一B. 二答案:A解析:甲。"
    rows = spark.createDataFrame([(1, line, "x"), (2, None, "y"), (3, line, None), (4, "  ", "z"), (5, "plain", "w")], "a long, text string, b string")
    found = X.split_lines(rows)
    assert found.columns == ["a", "b", "part_no", "text"] and "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    parts = ["下列关于甲的说法正确的是()。", "A. 一", "B. 二", "答案:A", "解析:甲。"]
    want = [(a, b, k, t) for a, b in ((1, "x"), (3, None)) for k, t in enumerate(parts)] + [(5, "w", 0, "plain")]
    assert sorted(map(tuple, found.collect())) == want


@pytest.mark.parametrize("most", [0, 10])
def test_texts_meet_terms_in_many_tasks_and_small_steps(spark, most, monkeypatch):
    """More texts than a step holds, blank and null ones too, dealt out before they are read."""
    monkeypatch.setattr(tagging, "TEXTS_HELD", 3)
    texts = spark.createDataFrame([(i, None if i == 5 else "" if i == 6 else f"Red {i} and blue") for i in range(11)], "id long, body string")
    terms = spark.createDataFrame([("red", 1, 80, 0), ("blue", 2, 65, 0), ("green", 3, 55, 0)], "term string, point_id long, score int, ord int")
    found = tagging.match_terms(texts, terms, most)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "MapInPandas" not in plan
    assert sorted((r.id, r.term) for r in found.collect()) == sorted((i, t) for i in range(11) if i not in (5, 6) for t in ("red", "blue"))


@pytest.mark.parametrize("listed", [0, 1000])
def test_sessions_meet_lists_of_questions(spark, listed, monkeypatch):
    """A session meets a list for each of its points, and no row for each question; it skips what it used and takes all subjects if it has none."""
    monkeypatch.setattr(learning, "LISTED", listed, raising=False)
    items = [(i, None if i % 11 == 0 else i % 3, "inactive" if i % 13 == 0 else "active", "group" if i % 17 == 0 else "standalone") for i in range(1, 60)]
    shown = [(p, i) for p in range(4) for i in range(1, 60) if i % 4 == p or i % 7 == p]
    sessions = [(s, None if s % 4 == 0 else s % 3) for s in range(12)]
    top = [(s, (s + k) % 5) for s in range(13) for k in range(s % 4)]
    used = [(s, q) for s in range(0, 12, 2) for q in range(59 - s, 30, -(1 + s % 3))] + [(1, 500)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = learning.similar_questions(
        frame(top, "session_id long, point_id long"), frame(shown + shown[:5], "point_id long, bank_question_id long"), frame(items, "id long, subject_id long, status string, node_role string"),
        frame(used, "session_id long, question_id long"), frame(sessions, "id long, subject_id long"),
    )
    want = []
    for s, wanted in sessions:
        points = {p for t, p in top if t == s}
        live = {i for i, subject, status, role in items if status == "active" and role != "group" and wanted in (None, subject)}
        fresh = sorted({q for p, q in shown if p in points and q in live and (s, q) not in used}, reverse=True)[:5]
        want += [(s, q, k + 1) for k, q in enumerate(fresh)]
    assert found.columns == ["session_id", "question_id", "place"] and sorted(map(tuple, found.collect())) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[session_id#\d+L?, question_id#", plan) and plan.count("strategy=broadcast") == (2 if listed else 0)


def test_sources_are_brought_down_before_options_are_formed(spark):
    """Python forms the options of an item's latest source, not of each source; names that the bank knows as one item give one, with its first subject and category."""
    items = spark.createDataFrame([("old", None, None, "before", ["x"])], "fingerprint string, subject_id long, category_id long, stem_text string, options array<string>")
    links = spark.createDataFrame([("q", 2, "gone", "active"), ("q", 9, "old", "active"), ("q", 8, "old", "removed")], "source_type string, source_question_id long, fingerprint string, status string")
    rows = [
        ("new1", "old", "q", 1, None, 6, "a", "judge", ["A. y"], 1), ("old", "other", "q", 2, 4, 9, "b", None, ["A. z"], 2), ("new2", "old", "q", 3, 5, None, "c", None, ["A. one", "B、one", "无", "C. two"], 3),
        ("own", None, "q", 4, None, None, "d", "judge", None, 4), ("own", "old2", "q", 1, 7, None, "e", None, None, 0), (None, None, "q", 5, 1, 1, "f", None, None, 5),
    ]
    incoming = spark.createDataFrame(rows, "fingerprint string, legacy string, source_type string, source_question_id long, subject_id long, category_id long, stem_text string, question_type string, options array<string>, ord long")
    merged, all_links = bank.bank_merge(items, links, incoming)
    got = {r.fingerprint: (r.subject_id, r.category_id, r.stem_text, r.options, r.first_source_question_id, r.created, r.source_count) for r in merged.collect()}
    assert got == {"old": (4, 6, "c", ["one", "two"], 3, False, 4), "own": (7, None, "d", ["正确", "错误"], 4, True, 1), None: (1, 1, "f", [], 5, True, 0)}
    assert {(r.source_question_id, r.fingerprint, r.status) for r in all_links.collect()} == {(1, "old", "active"), (2, "old", "active"), (3, "old", "active"), (4, "own", "active"), (5, None, "active"), (8, "old", "removed"), (9, "old", "active")}
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "EvalPython" not in plan(all_links) and len(re.findall(r"EvalPython[^\n]*\n(?:[^\n]*Project[^\n]*\n)?[^\n]*Aggregate \[fingerprint", plan(merged))) == plan(merged).count("EvalPython") == 1
