"""Connected components over edge tables, by repeated minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm.store import materialise, remove


def connected_components(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """As :func:`connected`, without the path."""
    return connected(edges, name, most_rounds)[0]


def connected(edges: DataFrame, name: str, most_rounds: int = 60) -> tuple[DataFrame, str]:
    """``edges``: (a, b), any order, repeats allowed. Returns (node, component) for every node of an edge;
    component is the smallest node reachable; and the path of that table.

    Each round takes the smallest label of a node's neighbours (a hash aggregate, combined before the shuffle) and then
    follows labels one step, so paths halve. Labels live in the shared folder, one table per round; hubs only skew the
    edge side of plain joins, which adaptive execution splits.
    """
    spark = edges.sparkSession
    both, edges_path = materialise(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct().toDF("a", "b"), f"{name}-edges")
    labels, path = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), f"{name}-labels")
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, "node").select("node", F.least("component", "near").alias("low"), F.col("component").alias("was"))
        low, low_path = materialise(low, f"{name}-low")
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        new, new_path = materialise(low.join(jump, "low").select("node", F.least("low", "lower").alias("component"), "was"), f"{name}-labels")
        changed = not new.where("component <> was").isEmpty()
        remove(spark, low_path)
        remove(spark, path)
        labels, path = new.select("node", "component"), new_path
        if not changed:
            break
    else:
        raise RuntimeError(f"{name}: components did not settle in {most_rounds} rounds")
    remove(spark, edges_path)
    return labels, path
