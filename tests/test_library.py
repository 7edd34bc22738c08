"""Edge rules of metrics, allocation, components, cleaning, readers and sinks."""

import hashlib
import json
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from boxwright.functions import extensions
from boxwright.operators import allocation, cleaning, clustering, digests, graphs, metrics, near_duplicates, splits
from boxwright.sources import readers, sinks
from boxwright.sources.image_headers import read_dimensions


def test_scores_match_published_arithmetic(spark):
    got = metrics.scores(spark.createDataFrame([(33, 2, 137), (0, 0, 0)], "tp int, fp int, fn int")).collect()
    assert [round(x, 6) for x in (got[0].precision, got[0].recall, got[0].f1)] == [0.942857, 0.194118, 0.321951]
    assert (got[1].precision, got[1].recall, got[1].f1) == (0.0, 0.0, 0.0)


def plain_threshold(rows, target, lower, upper):
    cuts = sorted({lower, upper, *(min(upper, max(lower, c)) for c, _ in rows)})
    good = [cut for cut in cuts if (kept := [t for c, t in rows if c >= cut]) and sum(kept) / len(kept) >= target]
    return min(good) if good else upper


def test_class_thresholds_equal_the_plain_rule(spark):
    r = random.Random(3)
    rows = [(k, r.choice([0.3, 0.5, 0.55, 0.6, 0.7, 0.85, 0.9, 0.95]), r.random() < 0.7) for k in range(4) for _ in range(25)]
    classes = spark.createDataFrame([(k,) for k in range(5)], "class_id int")
    for target in (0.5, 0.7, 0.9):
        got = {x.class_id: x.threshold for x in metrics.class_thresholds(spark.createDataFrame(rows, "class_id int, confidence double, is_true_positive boolean"), classes, target).collect()}
        assert got == {k: plain_threshold([(c, t) for i, c, t in rows if i == k], target, 0.5, 0.85) for k in range(5)}
        assert got[4] == 0.85  # no evidence


def test_components_keep_lone_nodes_and_follow_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7)], "a int, b int")
    nodes = spark.createDataFrame([(i,) for i in (1, 40, 100, 500)], "node int")
    got = {r.node: r.component for r in graphs.connected_components(edges, nodes).collect()}
    assert got[40] == 1 and got[101] == 100 and got[500] == 500 and len(got) == 43


@pytest.mark.parametrize("most", [0, 1, 4, 7])
def test_class_links_equal_all_pairs(spark, most):
    r = random.Random(most)
    base = [r.getrandbits(64) for _ in range(30)]
    values = sorted({*base, *(b ^ sum(1 << i for i in r.sample(range(64), r.randrange(9))) for b in base)})
    df = spark.createDataFrame([(k, v - (1 << 64) if v >> 63 else v) for k, v in enumerate(values)], "representative int, hash long")
    got = sorted((x.a, x.b, x.distance) for x in near_duplicates.class_links(df, most).collect())
    far = lambda i, j: (values[i] ^ values[j]).bit_count()
    assert got == [(i, j, far(i, j)) for i in range(len(values)) for j in range(i + 1, len(values)) if far(i, j) <= most]


def plain_hash(text):
    n = Counter(re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(near_duplicates.UPPER, near_duplicates.LOWER))))
    weights = {w: sum(c >= s for s in near_duplicates.STEPS) for w, c in n.items()}
    value = [(int(hashlib.md5(w.encode()).hexdigest()[:16], 16), k) for w, k in weights.items()]
    bits = [sum(k if v >> b & 1 else -k for v, k in value) > 0 for b in range(64)]
    return sum(on << b for b, on in enumerate(bits))


def test_fingerprints_equal_plain_counts(spark):
    texts = [None, "", " \n", "a", "A a b", "x " * 700 + "y", "é É ß", "one two\tthree\x0bfour\x85five", "b a b b c"]
    docs = spark.createDataFrame([*enumerate(texts), (3, "a"), (3, "other")], "doc_id long, text string").repartition(3)
    got = sorted((x.doc_id, x.hash % (1 << 64)) for x in near_duplicates.fingerprints(docs).collect())
    assert got == sorted([(k, plain_hash(t)) for k, t in enumerate(texts)] + [(3, plain_hash("other"))])


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_copies_link_and_copies_stay_rows(spark):
    r = random.Random(8)
    common = ["".join(r.choice("aeioulnrst") for _ in range(r.randrange(1, 4))) for _ in range(40)]
    rare = ["".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randrange(3, 10))) for _ in range(3000)]
    words = lambda n: [r.choice(common) if r.random() < 0.4 else r.choice(rare) for _ in range(n)]
    texts, links = [], 0
    for _ in range(150):
        own = words(r.randrange(60, 600))
        texts.append(" ".join(own))
        for changed in (1, 2, 3):
            near = list(own)
            for at in r.sample(range(len(near)), changed):
                near[at] = r.choice(rare)
            texts.append(" ".join(near))
    texts += [texts[0]] * 50
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = near_duplicates.NearDuplicates(rows)
    members = {x.doc_id: x.representative for x in found.members().collect()}
    assert len(members) == len(texts) and all(members[k] == 0 for k in range(len(texts) - 50, len(texts)))
    linked = {(x.a, x.b) for x in found.links.collect()}
    sets = [shingles(t) for t in texts[:600]]
    similar = [(i, j) for i in range(600) for j in range(i + 1, 600) if (s := len(sets[i] & sets[j])) and s >= 0.8 * len(sets[i] | sets[j])]
    hits = sum(members[i] == members[j] or (min(members[i], members[j]), max(members[i], members[j])) in linked for i, j in similar)
    assert len(similar) > 400 and hits >= 0.9 * len(similar), (hits, len(similar))
    groups = {x.doc_id: (x.component, x.size) for x in found.components().collect()}
    assert all(groups[a][0] // 4 == groups[b][0] // 4 for a, b in linked) and groups[len(texts) - 1][0] == 0 and groups[0][1] >= 51


def group_rows(n=3000):
    """Images in duplicate groups of one to forty, classes of which one is rare."""
    r, rows = random.Random(1), []
    for g in range(n):
        size = r.choice([1] * 12 + [2, 3, 40])
        classes = r.sample(["a", "b", "c", "d"], r.randrange(1, 3)) + (["rare"] if g % 400 == 7 else [])
        rows += [(f"{g}-{k}", g, classes, g % 50 == 0) for k in range(size)]
    return rows


def test_splits_are_whole_groups_near_their_shares(spark):
    rows = group_rows()
    shares = {"validation": 0.1, "test": 0.1, "pseudo_audit": 0.05, "unlabeled": 0.15}
    groups = splits.describe_groups(spark.createDataFrame(rows, "id string, `group` long, classes array<string>, protected boolean").repartition(5))
    got = splits.split_groups(groups, shares, 42).collect()
    split = {x.group: x.split for x in got}
    assert len(got) == len(split) == 3000 and all((split[g] == "external_test") == guarded for _, g, _, guarded in rows)
    free = [(split[g], c) for _, g, classes, guarded in rows if not guarded for c in classes]
    images = Counter(split[g] for _, g, _, guarded in rows if not guarded)
    for name, share in shares.items():
        assert abs(images[name] - share * images.total()) <= 80  # two of the largest groups
        for c in "abcd":
            own, all_of = sum(f == (name, c) for f in free), sum(f[1] == c for f in free)
            assert abs(own - share * all_of) <= 0.25 * share * all_of + 45, (name, c, own, share * all_of)
        assert (name, "rare") in free  # though 0.4 of its 8 groups are the share of the smallest split
    again = splits.split_groups(groups, shares, 42).collect()
    assert {x.group: x.split for x in again} == split
    assert {x.group: x.split for x in splits.split_groups(groups, shares, 7).collect()} != split


def test_budgets_are_nested(spark):
    groups = splits.describe_groups(spark.createDataFrame(group_rows(600), "id string, `group` long, classes array<string>, protected boolean"))
    got = splits.budgets(groups, (10, 20, 40, 100), 3407).collect()
    total = sum(x.images for x in got)
    assert len(got) == 600
    for p in (10, 20, 40):
        assert abs(sum(x.images for x in got if x.budget <= p) - total * p / 100) <= 80


def test_odd_groups_are_errors_and_empty_tables_give_none(spark):
    kind = "id string, `group` long, classes array<string>, protected boolean"
    with pytest.raises(ValueError, match="protected"):
        splits.describe_groups(spark.createDataFrame([("x", 1, ["a"], True), ("y", 1, ["a"], False)], kind))
    with pytest.raises(ValueError, match="more than once"):
        splits.describe_groups(spark.createDataFrame([("x", 1, ["a"], True), ("x", 2, ["a"], False)], kind))
    with pytest.raises(ValueError, match="shares"):
        splits.intervals({"a": 0.7, "b": 0.4})
    none = splits.describe_groups(spark.createDataFrame([], kind))
    assert splits.split_groups(none, {"test": 0.5}, 1).count() == 0
    bare = splits.describe_groups(spark.createDataFrame([("x", 1, None, False), ("y", 2, [], False)], kind))
    assert splits.split_groups(bare, {"test": 0.5}, 1).count() == 2


def test_rarest_first_equals_a_walk_over_all_images():
    r = random.Random(5)
    images = {f"{k:03d}": frozenset(r.sample(range(4), r.randrange(1, 4))) for k in range(80)}
    need, left, want = dict.fromkeys(range(4), 9), dict(images), []
    while any(need.values()):
        best = max(left, key=lambda i: (sum(need[c] for c in left[i]), sum(need[c] > 0 for c in left[i]), i))
        want.append(best)
        for c in left.pop(best):
            need[c] = max(0, need[c] - 1)
    heads = {}
    for i in sorted(images, reverse=True):
        heads.setdefault(tuple(sorted(images[i])), []).append(i)
    assert allocation.rarest_first(heads, dict.fromkeys(range(4), 9)) == sorted(want)
    with pytest.raises(ValueError, match="quotas"):
        allocation.rarest_first({(0,): ["a"]}, {0: 1, 1: 1})


def walked_repeats(sizes, most):
    """One image at a time: the rarest class's image of fewest appearances, then of rarest classes."""
    images = [[k, 1] for k, n in sorted(sizes.items()) for _ in range(n)]
    count = Counter(c for k, n in sizes.items() for c in k for _ in range(n))
    goal, steps = max(count.values()), 0
    while min(count.values()) < goal:
        rare = min(count, key=lambda c: (count[c], c))
        best = min((i for i in images if rare in i[0] and i[1] < most), key=lambda i: (i[1], sum(count[c] for c in i[0])))
        best[1] += 1
        count.update(best[0])
        steps += 1
    return steps, count


def test_balanced_repeats_are_near_the_walk():
    sizes = {(0,): 40, (1,): 9, (0, 1): 5, (2,): 21}
    extra = allocation.balanced_repeats(sizes, 5)
    assert extra[2,] == 24 and walked_repeats(sizes, 5)[0] == sum(extra.values())
    with pytest.raises(ValueError, match="appearances"):
        allocation.balanced_repeats(sizes, 2)
    r = random.Random(6)
    for _ in range(20):
        sizes = {tuple(sorted(r.sample(range(5), r.randrange(1, 4)))): r.randrange(1, 60) for _ in range(9)} | {(c,): r.randrange(20, 40) for c in range(5)}
        extra = allocation.balanced_repeats(sizes, 12)
        count = Counter()
        for k, n in sizes.items():
            count.update(dict.fromkeys(k, n + extra[k]))
        steps, walked = walked_repeats(sizes, 12)
        assert min(count.values()) >= max(sum(n for k, n in sizes.items() if c in k) for c in range(5))
        assert all(0 <= extra[k] <= 11 * n for k, n in sizes.items())
        assert sum(extra.values()) <= 1.15 * steps + 2 and max(count.values()) <= 1.15 * max(walked.values()) + 2


def test_balanced_repeats_do_not_walk():
    began = time.time()
    allocation.balanced_repeats({(0,): 10**9, (1,): 3 * 10**8, (0, 1): 10**8, (2,): 4 * 10**8, (1, 2): 7}, 5)
    assert time.time() - began < 2


def test_first_failing_reason_wins(spark):
    nan = float("nan")
    rows = [("", 0, 600, [nan] * 4, "test", "labeled", 1), ("a", 800, 600, [1.0, 2.0, nan, 4.0], "test", "labeled", 1), ("a", 800, 600, [-5.0, 0.0, 900.0, 700.0], "test", "labeled", 1), ("a", 800, 600, [5.0, 5.0, 5.0, 9.0], "x", "y", 9), ("a", 800, 600, [1.0, 1.0, 5.0, 9.0], "test", "unlabeled", 1)]
    df = cleaning.with_reason(spark.createDataFrame(rows, "file_path string, width int, height int, xyxy array<double>, split string, label_status string, class_id int"))
    assert [r.reason_code for r in df.collect()] == ["ANNOTATION_SCHEMA_INVALID", "BOX_NON_FINITE", None, "BOX_NON_POSITIVE_AREA", "ANNOTATION_SCHEMA_INVALID"]
    assert cleaning.accepted(df).first().xyxy == [0.0, 0.0, 800.0, 600.0]
    assert cleaning.quarantined(df).count() == 4


def test_lloyd_and_agreement(spark):
    rows = spark.createDataFrame([(k, [float(k % 2) * 10 + k * 0.01, 0.0]) for k in range(10)], "i int, v array<double>")
    centres = clustering.fit(rows, "v", [[0.0, 0.0], [9.0, 0.0]])
    assert [round(c[0], 2) for c in centres] == [0.04, 10.05]
    placed = rows.select(clustering.nearest(F.col("v"), centres)["cluster"].alias("cluster"), (F.col("i") % 2).cast("string").alias("category"))
    got = metrics.agreement(placed).first()
    assert (got.purity, round(got.nmi, 9), round(got.ari, 9)) == (1.0, 1.0, 1.0)


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_json_and_jsonl_readers(spark, tmp_path):
    schema = "a INT, b STRUCT<c: STRING>"
    row = {"a": 1, "b": {"c": "x"}}
    for k, doc in enumerate(([row], {"records": [row]}, {"images": [row]})):
        got = readers.json_records(spark, write(tmp_path / f"{k}.json", json.dumps(doc)), schema, "records", "images").collect()
        assert [(r.a, r.b.c) for r in got] == [(1, "x")]
    assert readers.json_lines(spark, write(tmp_path / "x.jsonl", json.dumps(row) + "\n"), schema).first().a == 1
    with pytest.raises(readers.SourceError):
        readers.json_lines(spark, write(tmp_path / "y.jsonl", json.dumps(row) + "\n\n" + json.dumps(row)), schema)


def test_csv_readers(spark, tmp_path):
    path = write(tmp_path / "u.csv", "ImageID,URL\na,http://x\nb,\n")
    with pytest.raises(readers.SourceError):
        readers.url_map(spark, path)
    assert [r.URL for r in readers.csv(spark, path, "ImageID STRING, URL STRING", empty=True).orderBy("ImageID").collect()] == ["http://x", ""]
    assert readers.class_descriptions(spark, write(tmp_path / "c.csv", "LabelName,DisplayName\n/m/1,Apple\n/m/1,Apple\n")).count() == 1
    with pytest.raises(readers.SourceError):
        readers.class_descriptions(spark, write(tmp_path / "d.csv", "/m/1,Apple\n/m/1,Pear\n"))


def test_yolo_readers(spark, tmp_path):
    write(tmp_path / "l" / "i.txt", "0 0.5 0.5 0.2 0.4\n\n1 0.1 0.1 0.3 0.1 0.3 0.5\n")
    got = readers.yolo(spark, str(tmp_path / "l"), polygons=True).orderBy("line").collect()
    assert [(r.image, r.class_id, round(r.x_center, 6), round(r.height, 6)) for r in got] == [("i", 0, 0.5, 0.4), ("i", 1, 0.2, 0.4)]
    with pytest.raises(readers.SourceError):
        readers.yolo(spark, str(tmp_path / "l"))
    write(tmp_path / "c" / "i.txt", "0 0.95 0.5 0.2 0.4\n")
    assert readers.yolo_clipped(spark, str(tmp_path / "c")).first().clipped
    write(tmp_path / "f" / "Mango" / "i.txt", "0 0.5 0.5 0.2 0.4\n")
    assert readers.category_folders(spark, str(tmp_path / "f")).first().category == "mango"


def test_coco_reader(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.jpg", "width": 100, "height": 50}], "categories": [{"id": 7, "name": "Apple"}, {"id": 8, "name": "Rock"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 7, "bbox": [10, 10, 20, 30]}, {"id": 2, "image_id": 1, "category_id": 8, "bbox": [0, 0, 5, 5]}]}
    mapping = spark.createDataFrame([("apple", 0)], "category string, class_id int")
    got = readers.coco(spark, write(tmp_path / "c.json", json.dumps(doc)), mapping).collect()
    assert [(r.class_id, r.xyxy) for r in got] == [(0, [10.0, 10.0, 30.0, 40.0])]
    doc["annotations"][0]["image_id"] = 9
    with pytest.raises(readers.SourceError):
        readers.coco(spark, write(tmp_path / "d.json", json.dumps(doc)), mapping)


def test_registry_bounds_and_envelope(spark, tmp_path):
    doc = {"registry_version": "1", "classes": [{"id": 0, "name": "apple"}], "source_aliases": {"s": {"Apfel": "apple"}}}
    classes, aliases = readers.class_registry(spark, write(tmp_path / "r.json", json.dumps(doc)))
    assert classes.count() == aliases.count() == 1
    doc["source_aliases"]["s"]["Stein"] = "rock"
    with pytest.raises(readers.SourceError):
        readers.class_registry(spark, write(tmp_path / "q.json", json.dumps(doc)))
    with pytest.raises(readers.SourceError):
        readers.bounds_artifact(spark, write(tmp_path / "b.json", json.dumps({"bounds": {"0": [0.5, 2.0]}})), 2)
    c = {"teacher_run_id": "t", "view": "original", "class_id": 0}
    assert readers.candidate_envelope(spark, write(tmp_path / "e.json", json.dumps({"teacher_run_id": "t", "candidate_count": 1, "candidates": [c]}))).count() == 1
    with pytest.raises(readers.SourceError):
        readers.candidate_envelope(spark, write(tmp_path / "g.json", json.dumps({"teacher_run_id": "t", "candidate_count": 2, "candidates": [c]}))).count()


def test_image_headers(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (30).to_bytes(4, "big") + (20).to_bytes(4, "big") + b"\x08\x06\0\0\0"
    gif = b"GIF89a" + (5).to_bytes(2, "little") + (6).to_bytes(2, "little") + b"\0\0\0"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + (7).to_bytes(2, "big") + (9).to_bytes(2, "big") + b"\x03" * 12
    webp = b"RIFF" + b"\0" * 4 + b"WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    svg = b'<?xml version="1.0"?><svg viewBox="0 0 64 32" xmlns="x"></svg>'
    bmp = b"BM" + b"\0" * 16 + (12).to_bytes(4, "little", signed=True) + (-8).to_bytes(4, "little", signed=True)
    assert [read_dimensions(b) for b in (png, gif, jpeg, webp, svg, bmp, b"", b"RIFF....WEBPVP8 ", b"nonsense")] == [(30, 20), (5, 6), (9, 7), (100, 50), (64, 32), (12, 8), None, None, None]
    (tmp_path / "apple").mkdir()
    (tmp_path / "apple" / "a.png").write_bytes(png)
    row = readers.image_folder(spark, str(tmp_path)).first()
    assert (row.category, row["size"].width, row["size"].height) == ("apple", 30, 20)


def test_publish_once_and_verify(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    sinks.publish({"rows": df, "table": df}, path, {"table": "csv"})
    assert sinks.verify(spark, path) == {"rows": True, "table": True}
    df.limit(1).write.mode("append").option("header", True).csv(f"{path}/table")
    assert sinks.verify(spark, path) == {"rows": True, "table": False}
    with pytest.raises(sinks.PublishError):
        sinks.publish({"rows": df}, path)
    assert sinks.seal(df) == sinks.seal(df.repartition(3)) != sinks.seal(df.limit(9))


def test_publish_seals_what_was_written(spark, tmp_path):
    path = f"file://{tmp_path}/chance"
    manifest = sinks.publish({"rows": spark.range(20).withColumn("x", F.expr("uuid()"))}, path)
    assert manifest["rows"]["rows"] == 20
    assert sinks.verify(spark, path) == {"rows": True}


def test_fingerprints_count_rows_and_tell_values_apart(spark):
    def mark(*rows):
        return digests.fingerprint(spark.createDataFrame(list(rows), "a string, b long")).first().fingerprint

    some = [("x", 1), ("", None), (None, 3)]
    assert mark(*some) == mark(*reversed(some))
    others = [mark(*some, ("x", 1)), mark(*some, ("x", 1), ("x", 1)), mark(("x", 1), (None, None), (None, 3)), mark(("x", None), ("", 1), (None, 3)), mark(), mark(("1:", 2)), mark((None, None))]
    assert len({mark(*some), *others}) == len(others) + 1


def test_manifest_problems(spark):
    columns = "id long, size int, sha256 string"
    said = spark.createDataFrame([(1, 5, "a"), (2, 5, "a"), (3, 5, "a"), (4, 5, "a"), (5, None, "a")], columns)
    found = spark.createDataFrame([(1, 5, "a"), (2, 6, "b"), (3, 5, "b"), (5, None, "a"), (6, 5, "a")], columns)
    assert {tuple(r) for r in digests.manifest_problems(said, found).collect()} == {(2, "size"), (3, "hash"), (4, "missing"), (6, "unexpected")}


def test_run_status_transitions(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    sinks.append_run(spark, path, "r1", "running")
    sinks.append_run(spark, path, "r1", "complete")
    with pytest.raises(sinks.PublishError):
        sinks.append_run(spark, path, "r1", "running")


def test_extensions(spark):
    images = spark.range(5).withColumnRenamed("id", "image_id")
    assert extensions.detect(images, extensions.StubDetector(("apple", "pear"))).count() == 5
    with pytest.raises(ValueError):
        extensions.extended(("apple",), ("apple",))
