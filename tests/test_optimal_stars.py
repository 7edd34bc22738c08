"""Optimal matching: stars are settled without the solver, and the solver's batches hold many groups."""

import random

import pandas as pd

from boxwright.operators import matching


def edges(seed, images=120):
    r = random.Random(seed)
    for image in range(images):
        for a in range(r.randrange(1, 5)):
            for b in range(r.randrange(1, 5)):
                if r.random() < 0.4:
                    yield image, a, b, r.choice((0.5, 0.6, 0.75, 0.9))


def test_matchings_are_those_of_the_solver(spark):
    rows = list(edges(5))
    want = []
    for image in sorted({r[0] for r in rows}):
        weights = {(a, b): v for i, a, b, v in rows if i == image}
        want += [(image, a, b, weights[a, b]) for a, b in matching.assign(weights)]
    got = matching.optimal_match(spark.createDataFrame(rows, "image_id int, a int, b int, iou double"), ["image_id"])
    assert sorted(map(tuple, got.collect())) == want


def test_a_group_may_go_on_in_the_next_batch():
    rows = pd.DataFrame(list(edges(6)), columns=["image_id", "a", "b", "iou"])
    whole = pd.concat(matching._solved(iter([rows]), ["image_id"]))
    parts = pd.concat(matching._solved(iter([rows[k : k + 7] for k in range(0, len(rows), 7)]), ["image_id"]))
    assert whole.values.tolist() == parts.values.tolist() and len(whole)


def test_stars_do_not_reach_the_solver(spark, monkeypatch):
    monkeypatch.setattr(matching, "assign", None)  # sent to the tasks with the function
    rows = [(0, 0, 0, 0.5), (0, 0, 1, 0.7), (0, 0, 2, 0.7), (1, 0, 0, 0.6), (1, 1, 0, 0.6), (2, 3, 3, 0.5)]
    got = matching.optimal_match(spark.createDataFrame(rows, "image_id int, a int, b int, iou double"), ["image_id"])
    assert sorted(map(tuple, got.collect())) == [(0, 0, 1, 0.7), (1, 0, 0, 0.6), (2, 3, 3, 0.5)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInPandas" in plan
