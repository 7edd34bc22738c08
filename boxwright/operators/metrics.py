"""Precision, recall, thresholds, average precision and clustering agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwright.operators.graphs import materialise
from boxwright.operators.ordered import ranked


def guarded(top: Column, bottom: Column) -> Column:
    """0 where the divisor is 0."""
    return F.when(bottom != 0, top / F.when(bottom != 0, bottom)).otherwise(F.lit(0.0))


def scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp, fn."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    rated = counts.withColumns({"precision": guarded(tp, tp + fp), "recall": guarded(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", guarded(2 * p * r, p + r))


def class_thresholds(evidence: DataFrame, classes: DataFrame, target: float = 0.9, lower: float = 0.5, upper: float = 0.85) -> DataFrame:
    """The lowest cutoff of each class that keeps precision at the target, from (class_id, confidence, is_true_positive).

    Cutoffs are the bounds and the scores clamped to them; what a cutoff keeps is decided by the raw score. One window
    pass over scores gives every cutoff's counts. A class without a cutoff that holds gets the upper bound.
    """
    counted = evidence.groupBy("class_id", "confidence").agg(F.count_if("is_true_positive").alias("tp"), F.count("*").alias("n"))
    every = materialise(counted, "scores")  # at most one row a class and score; its matches are found once
    at = F.greatest(F.lit(lower), F.least(F.lit(upper), F.col("confidence")))
    marks = every.select("class_id", at.alias("confidence")).union(classes.select("class_id", F.lit(lower))).union(classes.select("class_id", F.lit(upper))).distinct()
    marks = marks.select("class_id", "confidence", F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("n"))
    by_score = every.union(marks).groupBy("class_id", "confidence").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    over = Window.partitionBy("class_id").orderBy(F.desc("confidence")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    kept = by_score.select("class_id", "confidence", F.sum("tp").over(over).alias("tp"), F.sum("n").over(over).alias("n"))
    good = kept.where(F.col("confidence").between(lower, upper) & (F.col("n") > 0)).where(F.col("tp") / F.col("n") >= target)
    best = good.groupBy("class_id").agg(F.min("confidence").alias("threshold"))
    return classes.select("class_id").join(best, "class_id", "left").select("class_id", F.coalesce("threshold", F.lit(upper)).alias("threshold"))


def precision_recall(scored: DataFrame, total: DataFrame, order: list[Column]) -> DataFrame:
    """The running curve of ``scored`` (confidence, is_true) in a total ``order``; ``total``: one row, truths."""
    curve = ranked(scored, order, "rank", {"tp": F.col("is_true").cast("long")})
    return curve.crossJoin(F.broadcast(total)).select(*scored.columns, "tp", "rank", (F.col("tp") / F.col("rank")).alias("precision"), (F.col("tp") / F.col("truths")).alias("recall"))  # total has one row


def average_precision(curve: DataFrame) -> DataFrame:
    """Mean over 101 recall levels of the best precision at that recall or beyond. The levels a point reaches are a bounded
    number, so each point counts for its highest level and maxima are then carried down 101 rows."""
    reach = F.floor(F.col("recall") * 100 + 1e-9).cast("int")
    reach = F.when(F.col("recall") < reach / F.lit(100.0), reach - 1).otherwise(reach)
    best = curve.select(reach.alias("level"), "precision").groupBy("level").agg(F.max("precision").alias("p"))
    levels = curve.sparkSession.range(101).select(F.col("id").cast("int").alias("level"))
    down = Window.partitionBy(F.lit(1)).orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = levels.join(best, "level", "left").select("level", F.coalesce(F.max("p").over(down), F.lit(0.0)).alias("interpolated"))
    return filled


def contingency(rows: DataFrame) -> DataFrame:
    """Counts of (cluster, category), and both margins, by grouping sets."""
    return rows.groupingSets([["cluster", "category"], ["cluster"], ["category"]], "cluster", "category").agg(F.count("*").alias("n"))


def agreement(rows: DataFrame) -> DataFrame:
    """Purity, NMI (geometric mean) and ARI of (cluster, category), one row."""
    cells = rows.groupBy("cluster", "category").agg(F.count("*").cast("double").alias("n"))
    a = cells.groupBy("cluster").agg(F.sum("n").alias("a"), F.max("n").alias("top"))
    b = cells.groupBy("category").agg(F.sum("n").alias("b"))
    total = cells.agg(F.sum("n").alias("t"))
    pair = lambda c: F.col(c) * (F.col(c) - 1) / 2
    joined = cells.join(a, "cluster").join(b, "category").crossJoin(F.broadcast(total))  # one row
    mutual = joined.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"), F.sum(pair("n")).alias("same"))
    left = a.crossJoin(F.broadcast(total)).agg(F.sum("top").alias("tops"), F.sum(-F.col("a") / F.col("t") * F.log(F.col("a") / F.col("t"))).alias("ha"), F.sum(pair("a")).alias("pa"))
    right = b.crossJoin(F.broadcast(total)).agg(F.sum(-F.col("b") / F.col("t") * F.log(F.col("b") / F.col("t"))).alias("hb"), F.sum(pair("b")).alias("pb"))
    one = total.crossJoin(mutual).crossJoin(left).crossJoin(right)  # one row each
    expected = F.col("pa") * F.col("pb") / (F.col("t") * (F.col("t") - 1) / 2)
    most = (F.col("pa") + F.col("pb")) / 2
    return one.select(
        F.col("t").cast("long").alias("image_count"),
        (F.col("tops") / F.col("t")).alias("purity"),
        F.when((F.col("ha") > 0) & (F.col("hb") > 0), F.col("mi") / F.sqrt(F.col("ha") * F.col("hb"))).otherwise(0.0).alias("nmi"),
        F.when(most != expected, (F.col("same") - expected) / F.nullif(most - expected, F.lit(0.0))).otherwise(0.0).alias("ari"),
    )


def majority(rows: DataFrame) -> DataFrame:
    """Each cluster's most frequent category; ties go to the largest."""
    counts = rows.groupBy("cluster", "category").count()
    return counts.groupBy("cluster").agg(F.max(F.struct("count", "category"))["category"].alias("category"))
