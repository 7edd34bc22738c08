"""Vector preparation, nearest-centre assignment and Lloyd iterations with explicit initial centres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-8


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def mean_vector(rows: DataFrame, vector: str) -> list[float]:
    """Column-wise mean; the driver gets one number a dimension."""
    got = rows.select(F.posexplode(vector).alias("p", "v")).groupBy("p").agg(F.avg(F.col("v").cast("double")).alias("m")).orderBy("p").collect()
    return [r["m"] for r in got]


def constant(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def centred_unit(vector: Column, mean: list[float]) -> Column:
    """Vector minus mean, divided by its length (plus a small constant)."""
    moved = F.zip_with(doubles(vector), constant(mean), lambda a, b: a - b)
    length = F.sqrt(F.aggregate(moved, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(moved, lambda v: v / (length + F.lit(EPSILON)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def nearest(vector: Column, centres: list[list[float]]) -> Column:
    """struct(distance, cluster) of the nearest centre, the lowest number on ties. Centres are a model parameter: a few rows."""
    options = F.array(*(F.struct(squared_distance(vector, constant(c)).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centres)))
    return F.array_min(options)


def lloyd_step(rows: DataFrame, vector: str, centres: list[list[float]]) -> list[list[float]]:
    """One update: means of the members by cluster; an empty cluster keeps its centre. Clusters x dimensions numbers come back."""
    placed = rows.select(nearest(F.col(vector), centres)["cluster"].alias("cluster"), F.col(vector).alias("v"))
    sums = placed.select("cluster", F.posexplode("v").alias("p", "x")).groupBy("cluster", "p").agg(F.avg("x").alias("m")).collect()
    new = [list(c) for c in centres]
    for cluster, p, m in sums:
        new[cluster][p] = m
    return new


def fit(rows: DataFrame, vector: str, centres: list[list[float]], iterations: int = 80, tolerance: float = 1e-12) -> list[list[float]]:
    for _ in range(iterations):
        new = lloyd_step(rows, vector, centres)
        if max(abs(a - b) for x, y in zip(new, centres, strict=True) for a, b in zip(x, y, strict=True)) <= tolerance:
            return new
        centres = new
    return centres
