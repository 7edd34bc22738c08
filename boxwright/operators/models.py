"""Stored cluster models: a version is a sealed publication of centres and mean, bound to its metric, size and dimension."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession

from boxwright.operators import clustering
from boxwright.sources import sealed
from boxwright.sources.sinks import PublishError, _fs, exists

_ROW = "part string, number int, vector array<double>"
METRIC = "squared_euclidean"


class ClusterModel(NamedTuple):
    centres: list[list[float]]
    mean: list[float] | None
    version: int

    @property
    def dimension(self) -> int:
        return len(self.centres[0])

    def assign(self, vector: Column) -> Column:
        """struct(distance, cluster) of the nearest centre; vectors are centred and scaled first if the model has a mean."""
        return clustering.nearest(vector if self.mean is None else clustering.centred_unit(vector, self.mean), self.centres)


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, make = _fs(spark, path)
    if not exists(spark, path):
        return []
    names = (f.getPath().getName() for f in fs.listStatus(make(path)))
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def save_model(spark: SparkSession, path: str, centres: list[list[float]], mean: list[float] | None = None) -> int:
    """Publishes the next version and returns its number. ValueError for centres that differ in length; PublishError if another writer was first."""
    if not centres or len({len(c) for c in centres} | ({len(mean)} if mean is not None else set())) != 1:
        raise ValueError("centres and mean must have one dimension")
    version = max(versions(spark, path), default=0) + 1
    rows = [("centre", k, [float(x) for x in c]) for k, c in enumerate(centres)] + ([("mean", 0, [float(x) for x in mean])] if mean is not None else [])
    table: DataFrame = spark.createDataFrame(rows, _ROW).coalesce(1)  # a row a cluster
    bound = {"artifact": "cluster_model", "clusters": len(centres), "dimension": len(centres[0]), "metric": METRIC, "centred": mean is not None}
    sealed.publish_sealed(spark, f"{path}/v{version:06d}", lambda folder: table.write.parquet(folder), bound)
    return version


def load_model(spark: SparkSession, path: str, dimension: int, version: int | None = None) -> ClusterModel:
    """The given or latest version. PublishError if there is none, if its files are not those that were sealed, or for vectors of another dimension or metric."""
    known = versions(spark, path)
    version = version if version is not None else max(known, default=None)
    if version not in known:
        raise PublishError(f"{path} has no version {version}")
    at = f"{path}/v{version:06d}"
    bound = sealed.marker_of(spark, at)["bound"]
    if bound["dimension"] != dimension or bound["metric"] != METRIC:
        raise PublishError(f"the model is for {bound['dimension']} dimensions and {bound['metric']}, not {dimension} and {METRIC}")
    if not sealed.verify_sealed(spark, at).isEmpty():
        raise PublishError(f"{at} is not as it was sealed")
    rows = spark.read.schema(_ROW).parquet(f"{at}/{sealed.DATA}").orderBy("part", "number").collect()  # a row a cluster
    mean = next((list(r["vector"]) for r in rows if r["part"] == "mean"), None)
    return ClusterModel([list(r["vector"]) for r in rows if r["part"] == "centre"], mean, version)
