"""The corners of a clipped box are computed once for a row."""

from boxwright.plans import geometry_queries


def test_corners_are_not_written_out_at_every_use(spark, tmp_path):
    kinds = "CAST(id AS BIGINT) AS l_orderkey, id * 7 AS l_partkey, id * 3 AS l_suppkey, CAST(id % 7 AS INT) AS l_linenumber, CAST(id % 50 AS DOUBLE) AS l_quantity, 'R' AS l_returnflag, 'F' AS l_linestatus"
    spark.range(200).selectExpr(*kinds.split(", ")).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = geometry_queries.p18(spark, f"{tmp_path}")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Generate inline(") == 1
    assert rows.count() > 100
