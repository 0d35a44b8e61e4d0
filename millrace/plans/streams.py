"""Windows in batch and as streams over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans.register import Register
from millrace.sources.tables import table
from millrace.streaming import windows as W

query = Register()


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _told(rows):
    """Times as UTC text and sums rounded, so that both engines tell them alike."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return rows.select(*(text(c) if c in ("start", "stop") else F.round(c, 2).alias(c) if c == "total" else F.col(c) for c in rows.columns))


_TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
_TUMBLING = f"SELECT event_type, {_TIME.format('b')} AS start, {_TIME.format('b + INTERVAL 1 HOUR')} AS stop, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS b FROM events) GROUP BY event_type, b"
_SESSIONS = f"""WITH a AS (SELECT *, coalesce(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) >= 1800000000, true)::INT AS fresh FROM events), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)
SELECT user_id, {_TIME.format('min(ts)')} AS start, {_TIME.format('max(ts) + INTERVAL 30 MINUTE')} AS stop, count(*) AS n FROM b GROUP BY user_id, s"""


@query("w1_tumbling", _TUMBLING)
def w1(spark, sf):
    return _told(W.tumbling(_events(spark, sf), "1 hour", "event_type"))


@query("w1_tumbling_stream", _TUMBLING)
def w1_stream(spark, sf):
    """Complete mode: groups that the watermark leaves open count too."""
    return _told(W.drain(W.tumbling(W.timed(W.source(spark, sf, "events")), "1 hour", "event_type"), "complete", "tumbling"))


@query("w2_sliding", f"SELECT {_TIME.format('b')} AS start, {_TIME.format('b + INTERVAL 1 HOUR')} AS stop, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS b FROM events) GROUP BY b")
def w2(spark, sf):
    return _told(W.tumbling(_events(spark, sf), "1 hour", slide="30 minutes"))


@query("w3_sessions", _SESSIONS)
def w3(spark, sf):
    return _told(W.sessions(_events(spark, sf), "30 minutes", "user_id"))


@query("w3_sessions_stream", _SESSIONS)
def w3_stream(spark, sf):
    return _told(W.drain(W.sessions(W.timed(W.source(spark, sf, "events")), "30 minutes", "user_id"), "complete", "sessions"))


@query("w4_watermark")
def w4(spark, sf):
    """Append mode: windows come out once the watermark has passed them; the last stay open."""
    return _told(W.drain(W.tumbling(W.timed(W.source(spark, sf, "events")), "1 hour"), "append", "watermark"))


@query("w5_stream_dedup", "SELECT event_id, user_id FROM events")
def w5(spark, sf):
    """The events twice over, once each in the result."""
    one, two = W.timed(W.source(spark, sf, "events")), W.timed(W.source(spark, sf, "events"))
    return W.drain(one.unionByName(two).dropDuplicatesWithinWatermark(["event_id"]), "append", "dedup").select("event_id", "user_id")


@query("w6_stream_join", "SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def w6(spark, sf):
    own = lambda kind: W.timed(W.source(spark, sf, "events").where(F.col("event_type") == kind))
    return W.drain(W.joined(own("click"), own("purchase"), "user_id", "1 HOUR"), "append", "joined")


@query("w7_state", "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total, max(value) AS highest FROM events GROUP BY user_id")
def w7(spark, sf):
    """The last state of each user."""
    out = W.drain(W.running_totals(W.source(spark, sf, "events")), "update", "totals")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("n", "total", "highest"), "batch").alias("s"))
    return last.select("user_id", "s.n", F.round("s.total", 2).alias("total"), "s.highest")
