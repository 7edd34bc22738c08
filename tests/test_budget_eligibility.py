"""The budgets' eligible members and the number of excluded ones."""

from boxwright.plans import registry


def test_members_in_order_and_excluded_ones(spark):
    d = "/root/testdata/sf0.001"
    rows = registry.load()[0]["Q04_budget_eligibility"](spark, d).collect()
    ids = sorted(r[0] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id").collect())
    assert sorted(r.budget for r in rows) == [0, 1, 2]
    for r in rows:
        assert r.eligible == sorted(r.eligible) and set(r.eligible) <= {i for i in ids if i % 3 == r.budget}
        assert len(r.eligible) + r.excluded == sum(i % 3 == r.budget for i in ids)
