"""Streams run to their end, as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.registry import query
from mnemospark.streaming import events as st


def _plain(df, *cols):
    return df.select(*(F.col(c).cast("timestamp_ntz").alias(c) if c == "start" else F.col(c) for c in cols))


@query("stream_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    return _plain(st.drained(st.tumbling(st.stream(spark, d)), "complete", "tumbling"), "start", "event_type", "n")


@query("stream_sliding", "SELECT start, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS start FROM events UNION ALL SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1")
def stream_sliding(spark, d):
    return _plain(st.drained(st.sliding(st.stream(spark, d)), "complete", "sliding"), "start", "n")


@query("stream_session", """
WITH s AS (SELECT user_id, ts, sum(CASE WHEN gap > 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS session
  FROM (SELECT user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events))
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def stream_session(spark, d):
    return _plain(st.drained(st.session_counts(st.stream(spark, d)), "complete", "session"), "user_id", "start", "n")


@query("stream_dedup_watermark", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_dedup_watermark(spark, d):
    """The stream joined to itself holds each event twice; one of each is left."""
    s = st.stream(spark, d)
    both = s.unionByName(s)
    return st.drained(st.deduplicated(both, ["event_id"]).select("event_id"), "append", "dedup").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("stream_working_memory")
def stream_working_memory(spark, d):
    s = st.stream(spark, d).withColumn("item", F.concat("event_type", F.lit(":"), (F.hour("at") % 6).cast("string")))
    return st.drained(st.working_memory(s, "item"), "append", "memory").groupBy("reason", "consolidated").agg(F.count("*").alias("n"))
