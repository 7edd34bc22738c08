import random

import xxhash
from pyspark.sql import functions as F

from boxwright.llm import simhash


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [(d, brute_fp(t)) for d, t in rows]
    root = {d: d for d, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if (x ^ y).bit_count() <= 4:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (f"{f:016x}", find(d)) for d, f in fps}


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"Wörd{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 6, 60, 300]))]
        for _ in range(14):
            words = list(base)
            for _ in range(r.choice([0, 1, 2, 3])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append((len(rows) * 3, r.choice([" ", "\n", " \t\x0b"]).join(words)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE two three"), (905, "x " * 5000)]
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, fp string, component_id int")
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_first(docs).count() == 0


def test_exploded_keys_are_not_broadcast(spark):
    """Spark takes 64 keys a fingerprint for as small as the fingerprints, and sent them through the driver."""
    distinct = spark.range(1000).select(F.xxhash64("id").alias("fp"))
    ends = simhash._keyed(distinct).groupBy("key").agg(F.min("fp").alias("low"))
    plan = simhash._keyed(distinct).join(ends, "key")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
