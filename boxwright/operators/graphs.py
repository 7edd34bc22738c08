"""Connected components, and tables kept in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares; a local one only for a local master without one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    top = top or f"file://{tempfile.gettempdir()}/boxwright-checkpoints"
    return f"{top.rstrip('/')}/boxwright-library/{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    return _written(df, name)[0]


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): component is the smallest node reachable. ``edges``: a, b. ``nodes``: node, to keep lone ones.

    Labels take the minimum of their neighbours and of their label's label each round, so rounds grow with the logarithm of a path; every
    round's labels are a table in the shared folder, which goes once the next one is written.
    """
    spark = edges.sparkSession
    both, edges_path = _written(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").where("a <> b").distinct(), "edges")
    all_nodes = both.select(F.col("a").alias("node")).distinct() if nodes is None else nodes.select("node").union(both.select("a")).distinct()
    labels, path = _written(all_nodes.select("node", F.col("node").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, "node", "left").select("node", F.least("component", F.coalesce("near", "component")).alias("low"), F.col("component").alias("was"))
        low, low_path = _written(low, "low")
        lower = low.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        new, new_path = _written(low.join(lower, "low").select("node", F.least("low", "lower").alias("component"), "was"), "labels")
        done = new.where("component <> was").isEmpty()
        remove(spark, low_path, path)
        labels, path = new.select("node", "component"), new_path
        if done:
            remove(spark, edges_path)
            return labels
