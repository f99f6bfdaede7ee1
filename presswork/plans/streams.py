"""Streams (X*): windows, sessions and duplicates, each equal to its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..streaming.run import cache_hits, changes_only, drain, gated_flush, open_stream, work_folder
from ..streaming.state import closed_sessions, first_seen, ring_buffer, run_available
from .registry import query


def events(t):
    # the pattern makes the single file a stream source
    return open_stream(t.spark, f"{t.folder}/events*.parquet", t.events.schema).withColumn("ts", F.col("ts").cast("timestamp"))


def window_start():
    return F.date_format(F.col("window.start"), "yyyy-MM-dd HH:mm:ss").alias("start")


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def X4_tumbling_windows(t):
    return drain(events(t).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(window_start(), "event_type", "n"), "complete")


@query("SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY 1")
def X4_sliding_windows(t):
    return drain(events(t).groupBy(F.window("ts", "12 hours", "6 hours")).agg(F.count("*").alias("n")).select(window_start(), "n"), "complete")


@query("SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events) WHERE prev IS NULL OR ts - prev >= INTERVAL 12 HOUR GROUP BY 1")
def X10_sessions(t):
    s = drain(events(t).groupBy("user_id", F.session_window("ts", "12 hours")).agg(F.count("*").alias("n")).select("user_id", "n"), "complete")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def X2_duplicates_dropped(t):
    return drain(events(t).select("user_id", "event_type").dropDuplicates(), "append")


@query("SELECT event_id, event_type FROM events WHERE value >= 50")
def X1_micro_batch_ingest(t):
    return drain(events(t).filter("value >= 50").select("event_id", "event_type"), "append")


@query("SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS second, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events) WHERE event_type IS DISTINCT FROM prev")
def X3_changed_captions(t):
    return drain(changes_only(events(t), "user_id", "ts", "event_type"), "append").select("user_id", F.col("ts").cast("long").alias("second"), "event_type")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 60")
def X5_last_points(t):
    """The last 60 points of each user; ranks are cut at 60 in each task before rows move."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return drain(events(t).select("user_id", "event_id", "ts", "value"), "append").withColumn("r", rank).filter("r <= 60").select("user_id", "event_id", "value")


@query()
def X6_cache_hits(t):
    return drain(cache_hits(events(t), "user_id", "ts", 86_400), "append").select("user_id", F.col("ts").cast("long").alias("second"), "hit")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'first' ELSE 'second' END AS run FROM events")
def X1_resumed_ingest(t):
    """Two runs of one ingest over a folder that grows between them: the second takes up where the first ended."""
    path, state, out = f"{work_folder(t.spark)}/in", f"{work_folder(t.spark)}/state", []
    for name, part in (("first", "event_id % 3 = 0"), ("second", "event_id % 3 <> 0")):
        t.events.filter(part).select("event_id", "value").write.mode("append").parquet(path)
        stream = open_stream(t.spark, path, t.events.select("event_id", "value").schema)
        out.append(drain(stream, "append", state).select("event_id", F.lit(name).alias("run")))
    return out[0].union(out[1])


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM events) WHERE next IS NULL OR next - ts >= INTERVAL 30 MINUTE")
def X10_debounced(t):
    """Of each burst of a user's events, less than 30 minutes apart, the last."""
    bursts = events(t).groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.max_by("event_id", "ts").alias("event_id")).select("user_id", "event_id")
    return drain(bursts, "complete")


@query()
def X4_gated_flush(t):
    """Captions gather for an hour and are put out if they come to 100 characters; tests hold it to a plain loop."""
    captions = events(t).withColumn("caption", F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"), F.lit(". ")))
    return drain(gated_flush(captions, "user_id", "ts", "caption", 21_600, 100), "append")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 60")
def X5_ring_buffer(t):
    """The same points out of the stream's own state, of 60 a user at most; the last of what it put out for each."""
    points = events(t).withColumn("at", F.unix_micros("ts"))
    out = run_available(ring_buffer(points, "user_id", "at", ["event_id", "value"]), "update").rows
    last = out.groupBy("user_id").agg(F.max_by("points", "epoch").alias("points"))
    return last.select("user_id", F.explode("points").alias("p")).select("user_id", "p.event_id", "p.value")


@query("SELECT DISTINCT user_id, event_type FROM events")
def X2_first_seen(t):
    """Duplicates within a day of the watermark; all of the table is one batch here, so no key is forgotten before its end."""
    return run_available(first_seen(events(t), ["user_id", "event_type"], "ts", "1 day"), "append").rows.select("user_id", "event_type")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def X10_closed_sessions(t):
    """Sessions that the watermark has closed; those that may go on stay in the state."""
    out = run_available(closed_sessions(events(t), "user_id", "ts", "12 hours", "1 hour"), "append").rows
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
