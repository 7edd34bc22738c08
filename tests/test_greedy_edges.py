"""Greedy matching against a walk in plain Python, with many rivals, and what its plan folds."""

import random

from pyspark.sql import functions as F

from boxwright.operators import matching


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    common = max(0.0, w) * max(0.0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - common
    return common / union if union > 0 else 0.0


def groups(seed):
    r = random.Random(seed)
    for image in range(60):
        box = lambda: (x := float(r.randrange(0, 12, 2)), y := float(r.randrange(0, 6, 2)), x + r.choice((8.0, 10.0)), y + r.choice((8.0, 10.0)))  # noqa: B023, E731
        yield image, [(r.randrange(5) / 4, *box()) for _ in range(r.randrange(9))], [(k + 1, *box()) for k in range(r.randrange(9))]


def frames(spark, seed):
    left = [(i, *row) for i, lefts, _ in groups(seed) for row in lefts]
    right = [(i, *row, 0.5) for i, _, rights in groups(seed) for row in rights]
    return spark.createDataFrame(left, "image_id int, confidence double, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(right, "image_id int, n int, x1 double, y1 double, x2 double, y2 double, confidence double")


def test_rivals_are_walked_in_order(spark):
    left, right = frames(spark, 3)
    order = [-F.col("confidence"), *map(F.col, ("x1", "y1", "x2", "y2"))]
    for rank, best in ((matching.rank_first_best, lambda v, n: (v, -n)), (matching.rank_largest_index, lambda v, n: (v, n))):
        want = []
        for image, lefts, rights in groups(3):
            free = dict((n, box) for n, *box in rights)
            for confidence, *box in sorted(lefts, key=lambda r: (-r[0], *r[1:])):
                options = [(*best(overlap(box, other), n), n) for n, other in free.items() if overlap(box, other) >= 0.5]
                n = max(options)[-1] if options else None
                want.append((image, confidence, *box, n, overlap(box, free.pop(n)) if n else None))
        got = matching.greedy_match(left, right, ["image_id"], order, rank, 0.5).select("image_id", "confidence", "x1", "y1", "x2", "y2", "n", "iou")
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_rows_without_rivals_are_not_folded(spark):
    left, right = frames(spark, 4)
    plan = matching.greedy_match(left, right, ["image_id"], [-F.col("confidence")], matching.rank_first_best, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan  # arrays of all boxes of an image
