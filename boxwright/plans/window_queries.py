"""W: window-style computations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from boxwright.functions import geometry as G
from boxwright.operators import metrics
from boxwright.operators.ordered import ranked
from boxwright.plans.aggregate_queries import _CURVE, unknown_curve
from boxwright.plans.geometry_queries import _CROP, _CROP_Y, crops
from boxwright.plans.join_queries import PR_SQL, pr_evidence
from boxwright.operators.ordered import ranked_within
from boxwright.plans.registry import query
from boxwright.sources import fixtures as X


@query("W01_candidate_order", X.sql("SELECT image_id, confidence, x1, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, view, class_id, x1, y1, x2, y2) AS k FROM boxes"))
def w01(spark, d):
    order = Window.partitionBy("image_id").orderBy(F.desc("confidence"), "view", "class_id", "x1", "y1", "x2", "y2")
    return X.boxes(spark, d).select("image_id", "confidence", "x1", F.row_number().over(order).cast("long").alias("k"))


@query("W05_pr_curve", X.sql("SELECT image_id, confidence, rank, tp, precision, recall FROM curve", _CURVE, recursive=True))
def w05(spark, d):
    return unknown_curve(spark, d).select("image_id", "confidence", F.col("rank").cast("long").alias("rank"), "tp", "precision", "recall")


@query("W06_interpolated_precision", X.sql("SELECT CAST(t AS INT) AS level, coalesce((SELECT max(precision) FROM curve WHERE recall >= t/100::DOUBLE), 0) AS interpolated FROM (SELECT unnest(generate_series(0, 100)) AS t)", _CURVE, recursive=True))
def w06(spark, d):
    return metrics.average_precision(unknown_curve(spark, d)).select("level", "interpolated")


@query("W07_cutoff_precision", X.sql("SELECT class_id, confidence AS cutoff, max(n) AS kept, max(tp) AS tp FROM (SELECT class_id, confidence, count(*) OVER w AS n, CAST(sum(CASE WHEN is_true_positive THEN 1 ELSE 0 END) OVER w AS BIGINT) AS tp FROM pr WINDOW w AS (PARTITION BY class_id ORDER BY confidence DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY ALL", PR_SQL, recursive=True))
def w07(spark, d):
    by_score = pr_evidence(spark, d).groupBy("class_id", F.col("confidence").alias("cutoff")).agg(F.count("*").alias("n"), F.count_if(F.col("n").isNotNull()).alias("t"))
    over = Window.partitionBy("class_id").orderBy(F.desc("cutoff")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return by_score.select("class_id", "cutoff", F.sum("n").over(over).alias("kept"), F.sum("t").over(over).alias("tp"))


@query("W08_rank_candidates", "SELECT user_id, row_number() OVER (ORDER BY floor_pass DESC, map50 DESC, recall DESC, user_id) AS k FROM (SELECT user_id, min(value) >= 0.02::DOUBLE AS floor_pass, max(value) AS map50, count(*) AS recall FROM events GROUP BY user_id)")
def w08(spark, d):
    runs = X.table(spark, d, "events").groupBy("user_id").agg((F.min("value") >= 0.02).alias("floor_pass"), F.max("value").alias("map50"), F.count("*").alias("recall"))
    return ranked(runs, [F.desc("floor_pass"), F.desc("map50"), F.desc("recall"), F.col("user_id")], "k").select("user_id", "k")


@query("W09_small_objects", X.sql(f"SELECT image_id, cx, cy, k FROM (SELECT image_id, cx, cy, row_number() OVER (PARTITION BY image_id ORDER BY area, class_id, x1, y1) AS k FROM (SELECT *, row_number() OVER (PARTITION BY image_id, cx, cy ORDER BY area, class_id, x1, y1) AS r FROM (SELECT *, (x2-x1)*(y2-y1) AS area, {_CROP} AS cx, {_CROP_Y} AS cy FROM boxes) WHERE area/480000 < 0.05::DOUBLE) WHERE r = 1) WHERE k <= 4"))
def w09(spark, d):
    small = crops(spark, d).withColumn("area", G.Box.of().area).where(F.col("area") / 480000 < 0.05)
    first = small.groupBy("image_id", "cx", "cy").agg(F.min(F.struct("area", "class_id", "x1", "y1")).alias("o"))
    return first.select("image_id", "cx", "cy", F.row_number().over(Window.partitionBy("image_id").orderBy("o", "cx", "cy")).cast("long").alias("k")).where("k <= 4")


@query("W10_occurrence", "SELECT event_type, user_id, count(*) AS n FROM (SELECT event_type, user_id % 30 AS user_id, row_number() OVER (PARTITION BY event_type, user_id % 30 ORDER BY event_id) AS k FROM events) WHERE k <= 5 GROUP BY ALL")
def w10(spark, d):
    rows = X.table(spark, d, "events").select("event_id", "event_type", (F.col("user_id") % 30).alias("user_id"))
    return ranked_within(rows, ["event_type", "user_id"], [F.col("event_id")], "k").where("k <= 5").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


@query("W11_display_fps", "SELECT event_id, round(CASE WHEN gap > 0 THEN 1000000/gap::DOUBLE ELSE 0 END, 6) AS fps FROM (SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)")
def w11(spark, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    before = F.lag(micros).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    gap = (micros - before).cast("double")
    return X.table(spark, d, "events").select("event_id", F.round(F.when(gap > 0, F.lit(1000000.0) / gap).otherwise(0.0), 6).alias("fps"))


@query("W12_failure_islands", "SELECT user_id, island, count(*) AS failures FROM (SELECT user_id, event_type, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM events) WHERE event_type = 'error' GROUP BY ALL")
def w12(spark, d):
    """Runs of failures between successes: a running count of successes names the island."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = X.table(spark, d, "events").withColumn("island", F.sum(F.when(F.col("event_type") != "error", 1).otherwise(0)).over(order))
    return rows.where("event_type = 'error'").groupBy("user_id", "island").agg(F.count("*").alias("failures"))
