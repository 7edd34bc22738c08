"""R: streaming plans run on the events table as a batch, so that they have an oracle; tests run them as streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from boxwright.plans.registry import query
from boxwright.sources import fixtures as X
from boxwright.streaming import frames as S


def events(spark, d):
    return X.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("R01_camera_loop", "SELECT user_id, count(*) AS frames, count_if(event_type = 'error') AS failed FROM events GROUP BY user_id")
def r01(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.count("*").alias("frames"), F.count_if(F.col("event_type") == "error").alias("failed"))


@query("R03_failure_state", "SELECT user_id, max(n) AS longest, coalesce(max(n) >= 2, false) AS failed FROM (SELECT user_id, island, count_if(event_type = 'error') AS n FROM (SELECT user_id, event_type, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM events) GROUP BY ALL) GROUP BY user_id")
def r03(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = events(spark, d).withColumn("island", F.sum(F.when(F.col("event_type") != "error", 1).otherwise(0)).over(order))
    runs = marked.groupBy("user_id", "island").agg(F.count_if(F.col("event_type") == "error").alias("n"))
    return runs.groupBy("user_id").agg(F.max("n").alias("longest"), (F.max("n") >= 2).alias("failed"))


@query("R04_video_completeness", "SELECT event_type, count(*) AS frames, count(*) = max(event_id) - min(event_id) + 1 AS complete FROM events GROUP BY event_type")
def r04(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("frames"), (F.count("*") == F.max("event_id") - F.min("event_id") + 1).alias("complete"))


@query("R06_error_isolation", "SELECT event_id, CASE WHEN props IS NULL OR NOT json_valid(props) THEN 'unreadable properties' WHEN event_type = 'error' THEN 'read failed' END AS error FROM events")
def r06(spark, d):
    return S.isolated(events(spark, d))


@query("R09_tumbling_counts", "SELECT epoch_us(time_bucket(INTERVAL '1 minute', ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL")
def r09(spark, d):
    return S.class_counts(events(spark, d)).select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("R09_sliding_counts", "SELECT epoch_us(time_bucket(INTERVAL '1 minute', ts)) - k*60000000 AS start_us, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL")
def r09_sliding(spark, d):
    return S.class_counts(events(spark, d), width="2 minutes", slide="1 minute").select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("R09_sessions", "SELECT user_id, min(epoch_us(ts)) AS start_us, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '30 minutes' >= ts THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def r09_sessions(spark, d):
    return S.sessions(events(spark, d)).select("user_id", F.unix_micros("start").alias("start_us"), "n")
