"""Learning state kept up to date as answers and events arrive.

Streams are DataFrames from ``readStream``.  State is keyed, so it is dealt out over the cluster by key, lies in RocksDB,
and ends with the watermark; rows that come later than it are dropped.  Saves of answers become changes (what a grade was
and what it is now); the wrong book and the mastery counters follow the changes, so a save that overwrites another counts
once.  Python's calls into the state take longer than its work on a row, so the state of many answers, or keys, lies in one
packed value of their slot.  A sink is a file sink or a :class:`~studyflow.streaming.keyed.KeyedTable`: a batch that runs again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.tables import shared_folder
from ..operators.learning import grade
from .keyed import KeyedTable

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(stream: DataFrame, folder: str, batch: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> None:
    """Run a stream over what its source holds now: each batch to ``batch``, or to Parquet files in ``folder``/out; its state lies in ``folder``/state."""
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        writer = writer.foreachBatch(batch) if batch else writer.format("parquet").option("path", f"{folder}/out")
        writer.start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that the stream gives for what its source holds now, with ``batch_id``; a batch that runs again overwrites its own files."""
    spark, top = stream.sparkSession, shared_folder(stream.sparkSession, "stream")
    run_to_end(stream, top, lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{top}/out/batch_id={batch_id}"), mode)
    spec = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)
    return spark.read.schema(f"{spec}, batch_id int").parquet(f"{top}/out")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last state that each key got."""
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("s")).select(*keys, *(F.col(f"s.{c}").alias(c) for c in rest))


#: What graded_stream gives: the save that counts now, and the grade that it replaces (``revised``: there was one).
CHANGE = "id long, user_id long, question_id long, answer string, at timestamp, is_correct boolean, revised boolean, was_correct boolean, was_at timestamp"
_TIMES = ("at", "was_at")
#: The same with times in microseconds, as rows leave the state.
_CHANGED = Row(*(c.split()[0] for c in CHANGE.split(", ")))


#: Slots that state is dealt out over: a prime, so that ids in even steps meet all of them.
SLOTS = 16381
_SAVE = np.dtype([("id", "<i8"), ("us", "<i8"), ("grade", "u1")])
_GRADES = (False, True, None)


def _getter(row: Row, *names: str) -> Callable[[Row], tuple]:
    return itemgetter(*(row.__fields__.index(n) for n in names))


class _LastSave(StatefulProcessor):
    """State of the answers of a slot: time and grade of the save that counts; an answer's ends when the watermark passes that time by ``keep``.

    The slot has one timer, for the first answer that ends (``due``).
    """

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "due long, saves binary")

    def _read(self) -> tuple[int | None, dict[int, tuple]]:
        due, saves = self.last.get() or (None, b"")
        return due, {id_: (us, _GRADES[grade]) for id_, us, grade in np.frombuffer(saves, _SAVE).tolist()}

    def _write(self, due: int | None, saves: dict[int, tuple]) -> None:
        first = self._end(min(us for us, _ in saves.values()))
        if due is None or first < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(first)
            due = first
        packed = np.array([(id_, us, _GRADES.index(right)) for id_, (us, right) in saves.items()], _SAVE)
        self.last.update((due, packed.tobytes()))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best: dict[int | None, tuple] = {}
        take = None
        for r in rows:
            take = take or _getter(r, "own", "user_id", "question_id", "answer", "us", "is_correct")
            save = take(r)
            now = best.get(save[0])
            if now is None or (save[4], save[3] or "") > (now[4], now[3] or ""):
                best[save[0]] = save
        due, saves = self._read()
        out = []
        for id_, user, question, answer, us, right in best.values():
            old = saves.get(id_ or 0)  # null ids have a slot of their own
            if old is None or us >= old[0]:
                saves[id_ or 0] = (us, right)
                out.append(_CHANGED(id_, user, question, answer, us, right, old is not None, old[1] if old else None, old[0] if old else None))
        if out:
            self._write(due, saves)
        return iter(out)

    def _end(self, us: int) -> int:
        return us // 1000 + self.keep_ms + 1

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        left = {id_: save for id_, save in self._read()[1].items() if self._end(save[0]) >= passed}
        if left:
            self._write(None, left)
        else:
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def _ms(spark: SparkSession, interval: str) -> int:
    return spark.range(1).select(F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {interval}"))).first()[0]


def graded_stream(answers: DataFrame, expected: DataFrame, late: str = "1 hour", keep: str = "0 seconds") -> DataFrame:
    """Changes (``CHANGE``) of answers (id, user_id, question_id, answer, at) as they are saved.

    A later save of an id overwrites the one before; of equal times the one that comes later counts, and within a batch
    the greater answer.  Saves more than ``late`` behind the latest are dropped.  The state of an id ends when the
    watermark passes its last save by ``keep``; a save after that is a new answer.  The expected answer and the type come
    from a static table (question_id, expected, question_type); grades are those of ``grade``.
    """
    rows = answers.withWatermark("at", late).join(expected, "question_id")
    graded = rows.select(F.pmod("id", F.lit(SLOTS)).alias("id"), F.col("id").alias("own"), "user_id", "question_id", "answer", "at", grade(F.col("answer"), F.col("expected"), F.col("question_type")).alias("is_correct"), F.unix_micros("at").alias("us"))
    changed = graded.groupBy("id").transformWithState(_LastSave(_ms(answers.sparkSession, keep)), CHANGE.replace(" timestamp", " long"), "append", "EventTime")
    return changed.withColumns({c: F.timestamp_micros(c) for c in _TIMES})


_BOOK = Row("user_id", "question_id", "wrong_count", "streak", "mastered")


_ANSWER = np.dtype([("user", "<i8"), ("question", "<i8"), ("id", "<i8"), ("us", "<i8"), ("flags", "u1")])
_SETTLED = np.dtype([("user", "<i8"), ("question", "<i8"), ("flags", "u1"), ("wrong", "<i8"), ("us", "<i8"), ("id", "<i8"), ("streak", "<i8")])
_RIGHT, _REVISED, _NO_ID, _NO_USER, _NO_QUESTION = 1, 2, 4, 8, 16
_NO_KEY = _NO_USER | _NO_QUESTION
_NEVER = -(1 << 62)


class _WrongBook(StatefulProcessor):
    """State of a slot of keys: what their settled answers come to, and the answers that may still change, as a list of packed chunks on disk.

    Settled are answers that the watermark has passed by ``keep``.  The counts need no order but the place of the last
    wrong answer: the streak is the number of right ones after it, so the list is read through in chunks, twice.  A group
    of rows is that of a slot, whose rows name their keys, or that of a key (user, question) alone.
    """

    #: Answers of a chunk, and of a list that is taken into memory.
    CHUNK, HELD = 500, 100_000

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "keys binary")
        self.lists = [handle.getListState(n, "answers binary") for n in ("open_a", "open_b")]
        self.turn = handle.getValueState("turn", "turn int, first long")
        self.held: list[np.ndarray] | None = None

    def _open(self, which: int) -> Iterable[np.ndarray]:
        """The chunks of open answers: in memory if they are few, so that they are read once, else read anew each time."""
        if self.held is not None:
            return self.held
        return (np.frombuffer(x[0], _ANSWER) for x in self.lists[which].get())

    def _hold(self, which: int) -> None:
        """Take a short list into memory."""
        found, n = [], 0
        for chunk in self._open(which):
            found.append(chunk)
            n += len(chunk)
            if n > self.HELD:
                return
        self.held = found

    def _rows(self, which: int, keys: set | None, some: int = 0) -> Iterator[tuple]:
        """(key, us, id, flags) of every open answer of the keys (all by default) that has one of the flags ``some``, if any are named."""
        users = None if keys is None else np.array(list({k[0] for k in keys}), np.int64)
        for chunk in self._open(which):
            if users is not None:
                chunk = chunk[np.isin(chunk["user"], users)]
            if some:
                chunk = chunk[chunk["flags"] & some != 0]
            for user, question, id_, us, flags in chunk.tolist():
                key = (user, question, flags & _NO_KEY)
                if keys is None or key in keys:
                    yield key, us, id_, flags

    def _revised(self, which: int, keys: set | None) -> dict:
        """Last state of each answer that was revised while open; few, as answers are revised within ``keep``."""
        found: dict = {}
        for key, us, id_, flags in self._rows(which, keys, _REVISED):
            answer = (key, id_, flags & _NO_ID)
            if answer not in found or us >= found[answer][1]:
                found[answer] = (key, us, id_, flags)
        return found

    def _answers(self, which: int, revised: dict, keys: set | None) -> Iterator[tuple]:
        """(key, us, id, flags) of every open answer, as last revised; ``revised`` has the last state of those with several."""
        if not revised:
            yield from self._rows(which, keys)
            return
        given = set()
        for row in self._rows(which, keys):
            answer = (row[0], row[2], row[3] & _NO_ID)
            if answer not in revised:
                yield row
            elif answer not in given:
                given.add(answer)
                yield revised[answer]

    def _counted(self, which: int, revised: dict, settled: dict, keys: set | None, upto: float = float("inf")) -> dict:
        """(wrong, us, id, streak) by key, of keys with open answers up to a time; time and id are those of the last wrong answer."""
        found: dict[tuple, list] = {}
        for key, us, id_, flags in self._answers(which, revised, keys):
            if us <= upto:
                now = found.get(key)
                if now is None:
                    now = found[key] = list(settled.get(key, (0, _NEVER, _NEVER, 0)))
                if not flags & _RIGHT:
                    now[0] += 1
                    if (us, id_) > (now[1], now[2]):
                        now[1:] = us, id_, 0  # rights settled before are older than any open answer
        for key, us, id_, flags in self._answers(which, revised, keys):
            if us <= upto and flags & _RIGHT:
                now = found[key]
                if now[0] and (us, id_) > (now[1], now[2]):
                    now[3] += 1
        return found

    def _settled(self) -> dict:
        found = self.settled.get()
        return {(user, question, flags): tuple(rest) for user, question, flags, *rest in np.frombuffer(found[0], _SETTLED).tolist()} if found else {}

    def _settle(self, turn: tuple | None, upto: int) -> tuple | None:
        """Move the answers up to a time from the list into the counts, and the others into the other list; the turn after that."""
        if turn is None or turn[1] > upto:
            return turn
        which = turn[0]
        self._hold(which)
        revised = self._revised(which, None)
        settled = self._settled()
        settled.update(self._counted(which, revised, settled, None, upto))
        rest, left = [], 1 << 62
        for (user, question, _), us, id_, flags in self._answers(which, revised, None):
            if us > upto:
                rest.append((user, question, id_, us, flags & ~_REVISED))
                left = min(left, us)
            if len(rest) == self.CHUNK:
                self._append(1 - which, rest)
                rest = []
        if rest:
            self._append(1 - which, rest)
        self.lists[which].clear()
        self.settled.update((np.array([(*key, *counts) for key, counts in settled.items()], _SETTLED).tobytes(),))
        self.turn.update((1 - which, left))
        self.held = None
        return 1 - which, left

    def _append(self, which: int, answers: list[tuple]) -> np.ndarray:
        chunk = np.array(answers, _ANSWER)
        self.lists[which].appendList([(chunk.tobytes(),)])
        return chunk

    def _given(self, key: tuple, rows: Iterator[Row]) -> Iterator[tuple]:
        """The rows as open answers; null is wrong."""
        take = None
        for r in rows:
            if take is None:
                take = _getter(r, "id", "us", "is_correct", "revised", *(("user_id", "question_id") if len(key) == 1 else ()))
            id_, us, right, revised, *own = take(r)
            user, question = own or key
            flags = (_RIGHT if right is True else 0) | (_REVISED if revised else 0)
            if id_ is None or user is None or question is None:
                flags |= (_NO_ID if id_ is None else 0) | (_NO_USER if user is None else 0) | (_NO_QUESTION if question is None else 0)
            yield user or 0, question or 0, id_ or 0, us, flags

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self.held = None
        turn = self._settle(self.turn.get(), timerValues.getCurrentWatermarkInMs() * 1000 - self.keep_ms * 1000)
        which, first = turn or (0, 1 << 62)
        most, given, keys, new, n = 0, self._given(key, rows), set(), [], 0
        while part := list(islice(given, self.CHUNK)):
            chunk = self._append(which, part)
            n += len(part)
            if turn is None and n <= self.HELD:
                new.append(chunk)
            keys.update((user, question, flags & _NO_KEY) for user, question, _, _, flags in part)
            first, most = min(first, *(x[3] for x in part)), max(most, *(x[3] for x in part))
        self.turn.update((which, first))
        self.handle.registerTimer(most // 1000 + self.keep_ms + 1)
        if turn is None and n <= self.HELD:
            self.held = new  # a slot without state, whose rows are all here
        else:
            self._hold(which)
        found = self._counted(which, self._revised(which, keys), {} if turn is None else self._settled(), keys)
        for (user, question, flags), (wrong, _, _, streak) in found.items():
            yield _BOOK(None if flags & _NO_USER else user, None if flags & _NO_QUESTION else question, wrong, streak, wrong > 0 and streak >= 2)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held = None
        self._settle(self.turn.get(), timerValues.getCurrentWatermarkInMs() * 1000 - self.keep_ms * 1000)
        return iter(())

    def close(self) -> None:
        pass


def wrong_book_stream(changes: DataFrame, late: str = "1 hour", keep: str = "0 seconds") -> DataFrame:
    """(user_id, question_id, wrong_count, streak, mastered) after each batch with changes of the key.

    ``changes`` are those of :func:`graded_stream`, or plain graded answers (user_id, question_id, id, at, is_correct).
    Answers count in order of time and id, whatever order they come in; one that is revised counts as last saved.
    """
    rows = changes if "revised" in changes.columns else changes.withColumn("revised", F.lit(False))
    slot = F.pmod(F.xxhash64("user_id", "question_id"), F.lit(SLOTS)).alias("slot")
    rows = rows.withWatermark("at", late).select(slot, "user_id", "question_id", "id", "at", "is_correct", "revised", F.unix_micros("at").alias("us"))
    out = "user_id long, question_id long, wrong_count long, streak long, mastered boolean"
    return rows.groupBy("slot").transformWithState(_WrongBook(_ms(changes.sparkSession, keep)), out, "update", "EventTime")


def wrong_book_table(spark: SparkSession, folder: str) -> KeyedTable:
    types = {"user_id": "long", "question_id": "long", "wrong_count": "long", "streak": "long", "mastered": "boolean"}
    return KeyedTable(spark, folder, ["user_id", "question_id"], types, latest=["wrong_count", "streak", "mastered"])


def mastery_table(spark: SparkSession, folder: str) -> KeyedTable:
    types = {"user_id": "long", "point_id": "long", "answered": "long", "correct": "long"}
    return KeyedTable(spark, folder, ["user_id", "point_id"], types, sums=["answered", "correct"])


def mastery_changes(changes: DataFrame, question_points: DataFrame) -> DataFrame:
    """(user_id, point_id, answered, correct): what changes add to the counters; a revision adds no answer, only the difference of its grades."""
    rows = changes if "revised" in changes.columns else changes.withColumns({"revised": F.lit(False), "was_correct": F.lit(None).cast("boolean")})
    right = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("long")
    adds = rows.select("user_id", "question_id", (~F.col("revised")).cast("long").alias("answered"), (right("is_correct") - F.when(F.col("revised"), right("was_correct")).otherwise(0)).alias("correct"))
    return adds.join(question_points, "question_id").select("user_id", "point_id", "answered", "correct")


def mastery_stream(changes: DataFrame, question_points: DataFrame, table: KeyedTable, folder: str) -> None:
    """Merge the counters per (user, point) into ``table`` to the end of the stream."""
    run_to_end(changes, folder, lambda batch, n: table.merge(mastery_changes(batch, question_points), n))


def activity_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events per window and type; rows later than the watermark are dropped."""
    window = F.window("at", size, slide) if slide else F.window("at", size)
    counts = events.withWatermark("at", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def activity_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events with no longer pause than the gap."""
    counts = events.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def number_batch(batch: DataFrame, last: DataFrame, scratch: str) -> DataFrame:
    """(topic_id, id, version) of a batch (topic_id, id, at): versions go on from ``last`` (topic_id, n), in order of time and id.

    Rows are cut into sorted ranges, so a topic with a large part of all rows lies in many; each range numbers its rows
    from the counts of the ranges before.
    """
    spark = batch.sparkSession
    ranged = batch.select("topic_id", "id", "at").repartitionByRange("topic_id", "at", "id").withColumn("run", F.spark_partition_id())
    ranged.write.mode("overwrite").parquet(scratch)  # a second pass over the plan could draw other ranges
    rows = spark.read.schema(ranged.schema).parquet(scratch)
    counts = rows.groupBy("topic_id", "run").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("topic_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("before", before).join(last.select("topic_id", F.col("n").alias("last")), "topic_id", "left")
    placed = rows.join(starts.select("topic_id", "run", (F.col("before") + F.coalesce("last", F.lit(0))).alias("start")), ["topic_id", "run"])
    within = F.row_number().over(Window.partitionBy("topic_id", "run").orderBy("at", "id"))
    return placed.select("topic_id", "id", (F.col("start") + within).cast("long").alias("version"))


def version_stream(events: DataFrame, folder: str | None = None) -> DataFrame:
    """(topic_id, id, version, batch_id) of topic events (topic_id, id, at) up to the end of the stream.

    A topic's events are counted in a keyed table; a batch's versions go on from the count of the batches before it.
    """
    spark = events.sparkSession
    top = folder or shared_folder(spark, "stream")
    table = KeyedTable(spark, f"{top}/topics", ["topic_id"], {"topic_id": "long", "n": "long"}, sums=["n"])

    def number(batch: DataFrame, n: int) -> None:
        number_batch(batch, table.current(before=n), f"{top}/runs/batch_id={n}").write.mode("overwrite").parquet(f"{top}/out/batch_id={n}")
        table.merge(spark.read.parquet(f"{top}/out/batch_id={n}").groupBy("topic_id").agg(F.count(F.lit(1)).alias("n")), n)

    run_to_end(events, top, number)
    return spark.read.schema("topic_id long, id long, version long, batch_id int").parquet(f"{top}/out")
