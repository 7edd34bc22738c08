import itertools
import random

from pyspark.sql import functions as F

from boxwright.operators import matching


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    common = max(0.0, w) * max(0.0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - common
    return common / union if union > 0 else 0.0


def boxes(seed, images=12, n=8):
    r = random.Random(seed)
    out = []
    for i in range(images):
        for _ in range(r.randrange(n + 1)):
            x, y = r.randrange(60), r.randrange(60)
            out.append((i, r.randrange(2), r.randrange(100) / 100, float(x), float(y), float(x + 10 + r.randrange(40)), float(y + 10 + r.randrange(40))))
    return out


SCHEMA = "image_id int, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double"
ORDER = ("class_id", "x1", "y1", "x2", "y2")


def order():
    return [-F.col("confidence"), *(F.col(c) for c in ORDER)]


def plain_nms(rows, threshold, strict, cap):
    out = {}
    for image in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == image), key=lambda r: (-r[2], r[1], *r[3:])):
            clash = any(k[1] == r[1] and (iou(k[3:], r[3:]) > threshold if strict else iou(k[3:], r[3:]) >= threshold) for k in kept)
            verdict = "nms_duplicate" if clash else "max_boxes_per_image" if cap is not None and len(kept) >= cap else "accepted"
            if verdict == "accepted":
                kept.append(r)
            out.setdefault(r, []).append(verdict)
    return out


def test_suppression_equals_a_loop_for_any_partitioning(spark):
    rows = boxes(1, 20, 14)
    for threshold, strict, cap in ((0.5, False, None), (0.3, True, None), (0.3, False, 2)):
        want = plain_nms(rows, threshold, strict, cap)
        shuffled = rows[:]
        random.Random(2).shuffle(shuffled)
        df = spark.createDataFrame(shuffled, SCHEMA).repartition(5)
        got = {}
        for r in matching.suppress(df, ["image_id"], order(), threshold, strict=strict, cap=cap).collect():
            got.setdefault((r.image_id, r.class_id, r.confidence, r.x1, r.y1, r.x2, r.y2), []).append(r.verdict)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_suppression_is_idempotent(spark):
    df = spark.createDataFrame(boxes(4), SCHEMA)
    once = matching.suppress(df, ["image_id"], order(), 0.4).where("verdict = 'accepted'").drop("verdict")
    twice = matching.suppress(once, ["image_id"], order(), 0.4)
    assert twice.where("verdict <> 'accepted'").count() == 0


def test_optimal_matching_beats_greedy_and_equals_enumeration():
    r = random.Random(8)
    for _ in range(120):
        n, m = r.randrange(1, 5), r.randrange(1, 5)
        weights = {(a, b): round(0.5 + r.random() / 2, 3) for a in range(n) for b in range(m) if r.random() < 0.6}
        got = matching.assign(weights)
        assert len({a for a, _ in got}) == len(got) == len({b for _, b in got})
        best = (0, 0.0)
        for k in range(min(n, m) + 1):
            for left in itertools.combinations(range(n), k):
                for right in itertools.permutations(range(m), k):
                    if all(p in weights for p in zip(left, right, strict=True)):
                        best = max(best, (k, sum(weights[p] for p in zip(left, right, strict=True))))
        assert len(got) == best[0] and abs(sum(weights[p] for p in got) - best[1]) < 1e-9


def test_greedy_match_ties(spark):
    left = spark.createDataFrame([(1, 0.9, 0.0, 0.0, 10.0, 10.0)], "image_id int, confidence double, x1 double, y1 double, x2 double, y2 double")
    right = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.0, 0.0, 10.0, 10.0)], "image_id int, n int, x1 double, y1 double, x2 double, y2 double")
    run = lambda rank: matching.greedy_match(left, right, ["image_id"], [-F.col("confidence")], rank, 0.5).first().n
    assert run(matching.rank_first_best) == 1
    assert run(matching.rank_largest_index) == 2


def test_greedy_match_without_partners(spark):
    left = spark.createDataFrame([(1, 0.9, 0.0, 0.0, 10.0, 10.0), (2, 0.4, 0.0, 0.0, 5.0, 5.0)], "image_id int, confidence double, x1 double, y1 double, x2 double, y2 double")
    right = spark.createDataFrame([(1, 1, 90.0, 0.0, 99.0, 10.0)], "image_id int, n int, x1 double, y1 double, x2 double, y2 double")
    got = matching.greedy_match(left, right, ["image_id"], [-F.col("confidence")], matching.rank_first_best, 0.5).collect()
    assert len(got) == 2 and all(r.n is None and r.iou is None for r in got)


def test_assignment_breaks_ties_by_the_smallest_pairs():
    from itertools import combinations, permutations

    r = random.Random(5)
    for _ in range(150):
        weights = {(a, b): r.choice([0.5, 0.6, 0.6, 0.9]) for a in range(4) for b in range(4) if r.random() < 0.6}
        every = [tuple(zip(rows, chosen, strict=True)) for n in range(5) for rows in combinations(range(4), n) for chosen in permutations(range(4), n)]
        possible = [m for m in every if all(p in weights for p in m)]
        best = max(possible, key=lambda m: (len(m), sum(round(weights[p] * 10) for p in m), [(-a, -b) for a, b in m]))
        assert matching.assign(weights) == list(best)
