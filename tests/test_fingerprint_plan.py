"""Hashes of texts are made where texts are read: no row a word, and a short row a text in the shuffle."""

from collections import Counter
from hashlib import md5

from boxwright.operators import near_duplicates as near


def plain(text):
    counts, sums = Counter((text or "").encode().lower().split()), [0] * 64
    for word, n in counts.items():
        weight, h = sum(n >= s for s in near.STEPS), int(md5(word).hexdigest()[:16], 16)
        for k in range(64):
            sums[k] += weight if h >> k & 1 else -weight
    got = sum(1 << k for k in range(64) if sums[k] > 0)
    return got - (1 << 64) if got >> 63 else got


def test_fingerprints_hash_texts_where_they_are_read(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 3)
    many = " ".join(str(i % 97) for i in range(5000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "Ab aB ÄB äb"), (4, "Ab aB ÄB äb"), (4, "other"), (None, "x y z"), (5, "a " * 70 + "b\x1cc d\x85e f g"), (6, "é " * 5 + "É " * 3 + "\x0bq\x0cr"), (7, many)]
    found = near.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, found.collect()), key=str) == sorted({(d, plain(t)) for d, t in rows}, key=str)
    assert [near._hash_of(t and t.encode(), {}) for _, t in rows] == [plain(t) for _, t in rows]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
