"""Streams with bounded state, run in several micro-batches and over restarts."""

import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from presswork.streaming import state
from pyspark.sql import functions as F

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def feed(spark, tmp_path):
    """A folder, a function that adds a file to it, and the stream of its files, one a micro-batch."""

    class Feed:
        path, n = f"{tmp_path}/in", 0

        def add(self, rows, schema):
            self.schema = schema
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/b={self.n}")
            self.n += 1
            time.sleep(0.02)  # files come in the order of their times

        def stream(self):
            return spark.readStream.schema(self.schema).option("maxFilesPerTrigger", "1").parquet(f"{self.path}/*")

    return Feed()


def test_ring_buffer(feed, tmp_path):
    rng, all_rows, schema = random.Random(5), [], "k string, at long, v double"
    for batch in range(4):
        rows = [(rng.choice("abc"), rng.randrange(10_000), float(i)) for i in range(300 if batch != 2 else 0)]
        all_rows += rows
        feed.add(rows, schema)
    folder = f"{tmp_path}/state"
    first = state.run_available(state.ring_buffer(feed.stream(), "k", "at", ["v"]), "update", folder)
    feed.add([("a", 20_000, 1.0), ("new", 1, 1.0)], schema)
    all_rows += [("a", 20_000, 1.0), ("new", 1, 1.0)]
    second = state.run_available(state.ring_buffer(feed.stream(), "k", "at", ["v"]), "update", folder)
    assert {r["k"] for r in second.rows.collect()} == {"a", "new"}  # only what has changed
    last = {}
    for run in (first, second):
        for r in run.rows.orderBy("epoch").collect():
            assert len(r["points"]) <= 60
            last[r["k"]] = [tuple(p) for p in r["points"]]
    assert last == {k: sorted((at, v) for x, at, v in all_rows if x == k)[-60:] for k in {x for x, *_ in all_rows}}
    assert first.state_rows() <= 3 * 61 and second.state_rows() <= 4 * 61


def plain_flush(batches, millis, least):
    """The same by a loop over batches: rows first, then the timers that the watermark before the batch has passed."""
    buffer, due, out, mark = {}, {}, [], 0
    latest = 0
    for rows in [*batches, []]:
        for k, at, text in rows:
            if k not in buffer:
                buffer[k] = ""
                due[k] = mark // millis * millis + millis
            buffer[k] += text or ""
        while early := [k for k in due if due[k] <= mark]:
            for k in early:
                at = due.pop(k)
                if len(buffer[k]) >= least:
                    out.append((k, at, buffer.pop(k)))
                elif buffer[k]:
                    due[k] = max(at, mark) // millis * millis + millis
                else:
                    del buffer[k]
        latest = max([latest, *(int(at.timestamp() * 1000) for _, at, _ in rows)])
        mark = latest
    return sorted(out), sum(1 for b in buffer.values())


def test_timed_flush_by_event_time(feed):
    rng, batches = random.Random(6), []
    for i in range(6):
        rows = sorted(((rng.choice("abcd"), START + timedelta(seconds=10 * i + rng.random() * 10), rng.choice(["some words ", "x", "", None, "a longer caption of words "])) for _ in range(12)), key=lambda r: r[1])
        batches.append(rows)
        feed.add(rows, "k string, at timestamp, text string")
    run = state.run_available(state.timed_flush(feed.stream().withWatermark("at", "0 seconds"), "k", "text", 7, 40, event_time="at"), "append")
    want, left = plain_flush(batches, 7000, 40)
    got = sorted((r["k"], r["at"], len(r["flushed"])) for r in run.rows.collect())
    assert got == [(k, at, len(t)) for k, at, t in want] and len(want) > 3


def test_timed_flush_keeps_what_is_not_taken(feed, tmp_path):
    """By processing time: a failing call leaves the buffer, a later one sends all of it, once."""
    schema, folder, gate = "k string, text string", f"{tmp_path}/state", f"{tmp_path}/open"

    def send(text):
        import os

        return os.path.exists(gate)

    run = lambda after: state.run_until(state.timed_flush(feed.stream(), "k", "text", 1, 5, send), "append", 1, folder, after)
    feed.add([("a", "123"), ("b", "1"), ("a", "456")], schema)
    assert run(3).rows.collect() == []  # too little for b, and the call for a fails
    open(gate, "w").close()
    feed.add([("b", "2"), ("b", None)], schema)
    last = run(3)
    assert [(r["k"], r["flushed"]) for r in last.rows.collect()] == [("a", "123456")]
    assert 0 < last.state_rows() <= 6  # b's buffer, its size and its timer; nothing of a


def test_cache_entries_end(feed, tmp_path):
    schema, folder = "k string, text string", f"{tmp_path}/state"
    run = lambda n: state.run_until(state.cached(feed.stream(), "k", "text", lambda s: s.str.upper(), seconds=3, shards=2), "append", n, folder, 1)
    rows = [(f"k{i}", f"text {i}") for i in range(20)]
    feed.add(rows + rows[:5], schema)
    first = run(25)
    assert sorted((r["k"], r["answer"], r["hit"]) for r in first.rows.collect()) == sorted([(k, t.upper(), False) for k, t in rows] + [(k, t.upper(), True) for k, t in rows[:5]])
    time.sleep(3.2)
    feed.add([("k1", "other"), ("z", "z")], schema)
    second = run(2)
    assert sorted((r["k"], r["answer"], r["hit"]) for r in second.rows.collect()) == [("k1", "OTHER", False), ("z", "Z", False)]
    assert second.state_rows() <= 2 * 3


def test_first_seen_is_forgotten(feed, tmp_path):
    schema, folder = "k long, at timestamp, n int", f"{tmp_path}/state"
    hour = lambda h, k, n: (k, START + timedelta(hours=h), n)
    run = lambda: state.run_available(state.first_seen(feed.stream(), ["k"], "at", "2 hours"), "append", folder)
    feed.add([hour(0, k, 0) for k in range(50)] + [hour(0, 1, 0)], schema)
    assert run().rows.count() == 50
    feed.add([hour(1, 1, 1), hour(1, 99, 1)], schema)
    assert [(r["k"], r["n"]) for r in run().rows.collect()] == [(99, 1)]
    feed.add([hour(10, 500, 2)], schema)
    feed.add([hour(10, 501, 3)], schema)
    assert run().state_rows() <= 3  # the first fifty are forgotten
    feed.add([hour(11, 1, 4), hour(0, 7, 4)], schema)
    last = run()
    assert [(r["k"], r["n"]) for r in last.rows.collect()] == [(1, 4)] and last.late_rows() == 1


def test_sessions_are_closed_once(feed, tmp_path):
    schema, folder = "k string, at timestamp", f"{tmp_path}/state"
    minute = lambda m, k="a": (k, START + timedelta(minutes=m))
    run = lambda: state.run_available(state.closed_sessions(feed.stream(), "k", "at", "10 minutes", "5 minutes"), "append", folder)
    feed.add([minute(0), minute(4), minute(30), minute(0, "b")], schema)
    first = run()
    assert sorted((r["k"], r["n"]) for r in first.rows.collect()) == [("a", 2), ("b", 1)] and first.state_rows() == 1
    feed.add([minute(32), minute(2)], schema)  # the second is late
    feed.add([minute(100, "c")], schema)
    second = run()
    assert [(r["k"], r["n"]) for r in second.rows.collect()] == [("a", 2)] and second.late_rows() == 1 and second.state_rows() == 1


def test_empty(spark, feed):
    feed.add([], "k string, at long, v double")
    assert state.run_available(state.ring_buffer(feed.stream(), "k", "at", ["v"]), "update").rows.collect() == []
    assert state.run_available(feed.stream().filter(F.lit(False)), "append").rows.collect() == []
