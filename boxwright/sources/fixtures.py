"""Detection tables derived from the driver's generic ones, in Spark and as DuckDB SQL for the oracles.

Images are 800 x 600. ``boxes`` are detections of the original view, ``flips`` those of the mirrored view mapped back,
``truth`` labelled boxes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT, CLASSES = 800.0, 600.0, 5
#: Thresholds and width-to-height bounds by class used in the queries.
CLASS_THRESHOLDS = (0.55, 0.85, 0.85, 0.5, 0.5)
CLASS_BOUNDS = ((0.3, 2.6),) * 5
CLASS_NAMES = ("apple", "banana", "orange", "mango", "grape")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity = F.col("l_quantity").cast("int")
    score = (F.col("l_partkey") * 37 + F.col("l_suppkey") * 11 + F.col("l_linenumber") * 101 + quantity * 13) % 1000
    x1, y1 = (quantity * 8).cast("double"), (F.col("l_linenumber") * 40).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey DIV 4").alias("image_id"),
        (F.col("l_suppkey") % 5).cast("int").alias("class_id"),
        (score.cast("double") / F.lit(1000.0)).alias("confidence"),
        x1.alias("x1"),
        y1.alias("y1"),
        (quantity * 8 + 12 + 8 * (F.col("l_partkey") % 60)).cast("double").alias("x2"),
        (F.col("l_linenumber") * 40 + 12 + 8 * (F.expr("l_partkey DIV 3") % 50)).cast("double").alias("y2"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        "l_returnflag",
        "l_linestatus",
    )


_COLUMNS = ["image_id", "class_id", "view", "confidence", "x1", "y1", "x2", "y2"]


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detections(spark, sf_dir).withColumn("view", F.lit("original")).select(*_COLUMNS)


def _shifted(df: DataFrame) -> DataFrame:
    shift = (4 * (F.col("supp") % 4)).cast("double")
    return df.withColumns({"x1": F.col("x1") + shift, "x2": F.col("x2") + shift})


def flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.greatest(F.lit(0.0), F.col("confidence") - F.lit(0.02) * (F.col("part") % 5).cast("double"))
    found = _shifted(_detections(spark, sf_dir).where("l_returnflag <> 'N'")).withColumns({"confidence": lower, "view": F.lit("horizontal_flip")})
    return found.select(*_COLUMNS)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shifted(_detections(spark, sf_dir).where("l_linestatus = 'F'")).select("image_id", "class_id", "x1", "y1", "x2", "y2")


_BASE_SQL = """SELECT l_orderkey // 4 AS image_id, CAST(l_suppkey % 5 AS INT) AS class_id,
  CAST((l_partkey*37 + l_suppkey*11 + l_linenumber*101 + CAST(l_quantity AS INT)*13) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS confidence,
  CAST(CAST(l_quantity AS INT)*8 AS DOUBLE) AS x1, CAST(l_linenumber*40 AS DOUBLE) AS y1,
  CAST(CAST(l_quantity AS INT)*8 + 12 + 8*(l_partkey % 60) AS DOUBLE) AS x2,
  CAST(l_linenumber*40 + 12 + 8*((l_partkey // 3) % 50) AS DOUBLE) AS y2,
  l_partkey AS part, l_suppkey AS supp, l_returnflag, l_linestatus FROM lineitem"""
_SHIFT = "CAST(4*(supp % 4) AS DOUBLE)"
#: Common table expressions; an oracle is WITH + these + a query.
CTES = f"""base AS ({_BASE_SQL}),
boxes AS (SELECT image_id, class_id, 'original' AS view, confidence, x1, y1, x2, y2 FROM base),
flips AS (SELECT image_id, class_id, 'horizontal_flip' AS view,
  greatest(CAST(0 AS DOUBLE), confidence - CAST(0.02 AS DOUBLE)*CAST(part % 5 AS DOUBLE)) AS confidence,
  x1 + {_SHIFT} AS x1, y1, x2 + {_SHIFT} AS x2, y2 FROM base WHERE l_returnflag <> 'N'),
truth AS (SELECT image_id, class_id, x1 + {_SHIFT} AS x1, y1, x2 + {_SHIFT} AS x2, y2 FROM base WHERE l_linestatus = 'F')"""


def sql(query: str, more: str = "", recursive: bool = False) -> str:
    """An oracle over the derived tables; ``more``: further common table expressions."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{CTES}{', ' + more if more else ''} {query}"


def iou_sql(a: str, b: str) -> str:
    """DuckDB's intersection over union of two aliases (or struct expressions)."""
    common = f"(greatest(0.0::DOUBLE, least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))*greatest(0.0::DOUBLE, least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1)))"
    union = f"(({a}.x2-{a}.x1)*({a}.y2-{a}.y1)+({b}.x2-{b}.x1)*({b}.y2-{b}.y1)-{common})"
    return f"(CASE WHEN {union} > 0 THEN {common}/{union} ELSE 0.0::DOUBLE END)"
