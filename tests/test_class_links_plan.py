"""Links between classes are found by a shuffled join, whatever size Spark expects of the classes."""

from boxwright.operators import graphs, near_duplicates


def test_links_are_not_broadcast(spark):
    hashes = spark.range(200).selectExpr("id AS representative", "xxhash64(id % 100) ^ shiftleft(1L, CAST(id % 8 AS INT)) AS hash")
    links = near_duplicates.class_links(graphs.materialise(hashes, "classes"))
    rows = sorted(map(tuple, links.collect()))
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    known = {r.representative: r.hash & (1 << 64) - 1 for r in hashes.collect()}
    want = [(a, b, (known[a] ^ known[b]).bit_count()) for a in known for b in known if a < b and 1 <= (known[a] ^ known[b]).bit_count() <= 4]
    assert rows == sorted(want) and rows
