"""Streams over several batches: late and overwritten saves, replayed batches, state that ends, keys with most of all rows."""

from __future__ import annotations

import datetime
import glob
import random
import tempfile
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyflow.streaming import learning as L
from studyflow.streaming.keyed import KeyedTable

SAVE = "id long, user_id long, question_id long, answer string, at timestamp"
DAY = datetime.datetime(2024, 1, 1)


@pytest.fixture
def top():
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def at(hours):
    return DAY + datetime.timedelta(hours=hours)


def state_rows(spark, folder, name):
    return spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/state").collect()


def expected(spark):
    return spark.createDataFrame([(1, "A", "single"), (2, "B", "single")], "question_id long, expected string, question_type string")


def test_late_saves_and_the_end_of_state(spark, top):
    """A save ten days late is dropped, overwritten saves give changes, and the state of old answers is gone."""
    batches = [[(1, 7, 1, "B", at(0)), (1, 7, 1, "C", at(1)), (2, 7, 2, "B", at(2))], [(1, 7, 1, "A", at(2)), (3, 8, 1, None, at(240))], [(4, 8, 2, "B", at(0)), (2, 7, 2, "A", at(2)), (5, 8, 2, "b", at(241))]]
    for rows in batches:
        spark.createDataFrame(rows, SAVE).coalesce(1).write.mode("append").parquet(f"{top}/saves")
        L.run_to_end(L.graded_stream(spark.readStream.schema(SAVE).parquet(f"{top}/saves"), expected(spark), "1 hour", "3 hours"), top)
    got = sorted((r.id, r.at, r.is_correct, r.revised, r.was_correct) for r in spark.read.schema(L.CHANGE).parquet(f"{top}/out").collect())
    assert got == [(1, at(1), False, False, None), (1, at(2), True, True, False), (2, at(2), True, False, None), (3, at(240), None, False, None), (5, at(241), True, False, None)]
    assert sorted(r.key.id for r in state_rows(spark, top, "last")) == [3, 5]


def test_a_save_that_overwrites_counts_once(spark, top):
    batches = [[(1, 7, 1, "B", at(0)), (2, 7, 1, "A", at(1))], [(1, 7, 1, "A", at(2))], [(2, 7, 1, "C", at(3)), (3, 7, 2, "B", at(3))]]
    points = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "question_id long, point_id long")
    book, counters = L.wrong_book_table(spark, f"{top}/book"), L.mastery_table(spark, f"{top}/points")
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, SAVE).coalesce(1).write.mode("append").parquet(f"{top}/saves")
        L.run_to_end(L.graded_stream(spark.readStream.schema(SAVE).parquet(f"{top}/saves"), expected(spark), "1 day", "1 day"), top)
        changes = spark.readStream.schema(L.CHANGE).parquet(f"{top}/out")
        L.mastery_stream(changes, points, counters, f"{top}/points")
        L.run_to_end(L.wrong_book_stream(changes, "1 day", "1 day"), f"{top}/book", book.merge, "update")
        seen.append((sorted(map(tuple, counters.current().collect())), sorted(map(tuple, book.current().collect()))))
    assert seen[0] == ([(7, 10, 2, 1), (7, 11, 2, 1)], [(7, 1, 1, 1, False)])
    assert seen[1] == ([(7, 10, 2, 2), (7, 11, 2, 2)], [(7, 1, 0, 0, False)])
    assert seen[2] == ([(7, 10, 3, 2), (7, 11, 2, 1)], [(7, 1, 1, 0, False), (7, 2, 0, 0, False)])


def test_replayed_batch_changes_nothing(spark, top):
    """The query dies after the write of a batch and before its commit; the batch runs again."""
    graded = "user_id long, question_id long, id long, at timestamp, is_correct boolean"
    points = spark.createDataFrame([(1, 10)], "question_id long, point_id long")
    table, died = KeyedTable(spark, f"{top}/points", ["user_id", "point_id"], L.mastery_table(spark, "").types, sums=["answered", "correct"], every=2), []

    def merge(batch, n):
        table.merge(L.mastery_changes(batch, points), n)
        if n in (1, 3) and n not in died:
            died.append(n)
            raise RuntimeError("killed")

    for k in range(6):
        spark.createDataFrame([(5, 1, k, at(k), k % 2 == 0), (6, 1, 100 + k, at(k), True)], graded).coalesce(1).write.mode("append").parquet(f"{top}/in")
        for _ in range(2):
            try:
                L.run_to_end(spark.readStream.schema(graded).parquet(f"{top}/in"), f"{top}/query", merge)
                break
            except Exception as e:
                assert "killed" in str(e)
    assert died == [1, 3]
    assert sorted(map(tuple, table.current().collect())) == [(5, 10, 6, 3), (6, 10, 6, 6)]
    assert sorted(map(tuple, table.current(before=4).collect())) == [(5, 10, 4, 2), (6, 10, 4, 4)]
    assert len(glob.glob(f"{top.removeprefix('file://')}/points/base/*")) == 2 and len(glob.glob(f"{top.removeprefix('file://')}/points/delta/*")) <= 4


def test_wrong_book_settles(spark, top):
    """Answers out of order within the lateness give the same book as in order, and settled ones leave the lists."""
    rng = random.Random(3)
    graded = "user_id long, question_id long, id long, at timestamp, is_correct boolean"
    answers = [(k % 3, k % 2, k, at(k / 2), rng.choice([True, True, False, None])) for k in range(240)]
    book = L.wrong_book_table(spark, f"{top}/book")
    for k in range(4):
        part = answers[60 * k : 60 * k + 60]
        rng.shuffle(part)
        spark.createDataFrame(part, graded).coalesce(1).write.mode("append").parquet(f"{top}/in")
        L.run_to_end(L.wrong_book_stream(spark.readStream.schema(graded).parquet(f"{top}/in"), "2 hours", "1 hour"), f"{top}/query", book.merge, "update")
    want = defaultdict(lambda: (0, 0))
    for user, question, _, _, right in answers:
        wrong, streak = want[user, question]
        want[user, question] = (wrong, streak + (wrong > 0)) if right else (wrong + 1, 0)
    assert sorted((r.user_id, r.question_id, r.wrong_count, r.streak, r.mastered) for r in book.current().collect()) == sorted((*k, w, s, w > 0 and s >= 2) for k, (w, s) in want.items())
    held = sum(len(state_rows(spark, f"{top}/query", n)) for n in ("open_a", "open_b"))
    assert held < 24, "only what the watermark has not passed"


def test_versions_of_one_hot_topic(spark, top):
    """Versions go on over batches in order of time and id, also where a topic has nearly all rows."""
    event = "topic_id long, id long, at timestamp"
    for k in range(2):
        rows = spark.range(k * 200_000, (k + 1) * 200_000).select(F.when(F.col("id") % 50 == 0, F.col("id") % 7 + 1).otherwise(0).alias("topic_id"), "id", (F.lit(at(0)) + F.expr("make_dt_interval(0, 0, 0, id * 7919 % 5000)")).alias("at"))
        rows.coalesce(1).write.mode("append").parquet(f"{top}/in")
    found = L.version_stream(spark.readStream.schema(event).option("maxFilesPerTrigger", 1).parquet(f"{top}/in"), f"{top}/query")
    events = spark.read.schema(event).parquet(f"{top}/in").join(found.select("id", "version", "batch_id"), "id")
    want = events.selectExpr("*", "row_number() OVER (PARTITION BY topic_id ORDER BY batch_id, at, id) AS want")
    assert want.count() == 400_000 and want.where("want <> version").count() == 0 and want.select("batch_id").distinct().count() == 2


def test_answers_and_keys_share_slots(spark, top, monkeypatch):
    """Many answers and keys lie in few rows of state, and each still counts, is revised and ends by itself."""
    monkeypatch.setattr(L, "SLOTS", 3)
    monkeypatch.setattr(L._WrongBook, "CHUNK", 4)
    saves = {k: (k, k % 5 or None, 1 + k % 2, "AB"[k % 3 % 2], at(k / 10)) for k in range(30)}
    again = {k: (k, k % 5 or None, 1 + k % 2, "AB"[k % 2], at(3 + k / 10)) for k in range(0, 30, 2)}
    null = (None, 9, 1, "A", at(1))
    for rows in ([*saves.values(), null], list(again.values())):
        spark.createDataFrame(rows, SAVE).coalesce(1).write.mode("append").parquet(f"{top}/saves")
        L.run_to_end(L.graded_stream(spark.readStream.schema(SAVE).parquet(f"{top}/saves"), expected(spark), "1 day", "1 day"), top)
    right = lambda s: s[3] == "AB"[s[2] - 1]
    got = [(r.id, r.user_id, r.at, r.is_correct, r.revised, r.was_correct, r.was_at) for r in spark.read.schema(L.CHANGE).parquet(f"{top}/out").collect()]
    want = [(s[0], s[1], s[4], right(s), False, None, None) for s in [*saves.values(), null]] + [(s[0], s[1], s[4], right(s), True, right(saves[k]), saves[k][4]) for k, s in again.items()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    held = state_rows(spark, top, "last")
    assert len(held) == 4 and sum(len(np.frombuffer(r.value.saves, L._SAVE)) for r in held) == 31, "a row for each slot, and one for null ids"
    book = L.wrong_book_table(spark, f"{top}/book")
    for _ in range(2):
        L.run_to_end(L.wrong_book_stream(spark.readStream.schema(L.CHANGE).option("maxFilesPerTrigger", 2).parquet(f"{top}/out"), "1 day", "1 day"), f"{top}/book", book.merge, "update")
    counts = defaultdict(lambda: (0, 0))
    for s in sorted([*(saves | again).values(), null], key=lambda s: (s[4], s[0] or 0)):
        wrong, streak = counts[s[1], s[2]]
        counts[s[1], s[2]] = (wrong, streak + (wrong > 0)) if right(s) else (wrong + 1, 0)
    assert sorted(((r.user_id, r.question_id, r.wrong_count, r.streak) for r in book.current().collect()), key=repr) == sorted(((*k, *v) for k, v in counts.items()), key=repr)
    assert len({r.key for r in state_rows(spark, f"{top}/book", "open_a")}) <= 3
    spark.createDataFrame([(99, 1, 1, "A", at(240))], SAVE).coalesce(1).write.mode("append").parquet(f"{top}/saves")
    L.run_to_end(L.graded_stream(spark.readStream.schema(SAVE).parquet(f"{top}/saves"), expected(spark), "1 day", "1 day"), top)
    assert [np.frombuffer(r.value.saves, L._SAVE)["id"].tolist() for r in state_rows(spark, top, "last")] == [[99]]
