"""Ranks and running sums over a whole table without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwright.operators.graphs import materialise


def ranked(rows: DataFrame, order: list[Column], rank: str = "rank", sums: dict[str, Column] | None = None) -> DataFrame:
    """Adds the 1-based rank in ``order`` and running sums.

    Rows are dealt by ranges of the order and kept, so that a lost task finds the same ranges again. Ranks are counted
    within a range and moved by the ranges before it: a table of one row a partition, which is broadcast.
    """
    sums = {} if sums is None else sums
    kept = materialise(rows.withColumns({f"_{n}": c for n, c in sums.items()}).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = kept.groupBy("_part").agg(F.count("*").alias("_n"), *(F.sum(f"_{n}").alias(f"_all_{n}") for n in sums))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"), *(F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_shift_{n}") for n in sums))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = kept.join(F.broadcast(shifts), "_part")
    own = [(F.row_number().over(inside) + F.col("_shift")).cast("long").alias(rank), *((F.sum(f"_{n}").over(inside) + F.col(f"_shift_{n}")).alias(n) for n in sums)]
    return joined.select(*rows.columns, *own)


def ranked_within(rows: DataFrame, keys: list[str], order: list[Column], rank: str = "rank", size: str | None = None) -> DataFrame:
    """Adds the 1-based rank in ``order`` among the rows of equal ``keys`` (and their number). A key that holds a large share of all rows is
    spread over ranges: ranks are those of the whole order less the key's first, from a table of one row a key. Null keys are a key."""
    placed = ranked(rows, [F.asc_nulls_first(k) for k in keys] + order, "_all")
    starts = placed.groupBy(*keys).agg((F.min("_all") - 1).alias("_before"), F.count("*").alias("_size")).select(*(F.col(k).alias(f"_key_{k}") for k in keys), "_before", "_size")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    out = placed.join(starts, same)
    return out.select(*rows.columns, (F.col("_all") - F.col("_before")).alias(rank), *([F.col("_size").alias(size)] if size else []))
