"""A: set operations, sampling and allocation; O: sorts, limits and top-k; X: scalars."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from boxwright.functions import geometry as G
from boxwright.operators import allocation, splits
from boxwright.operators import near_duplicates as near
from boxwright.operators.ordered import ranked, ranked_within
from boxwright.plans.aggregate_queries import _DOC_SPLIT, docs
from boxwright.plans.geometry_queries import _CROP, _CROP_Y, crops
from boxwright.plans.join_queries import _NEAR_PROTECTED, near_duplicates, near_protected
from boxwright.plans.registry import query
from boxwright.sources import fixtures as X


def seeded(seed: int, column: str, kind: str = ""):
    """The order that a seed gives to names: their salted SHA-256."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *([F.lit(kind)] if kind else []), F.col(column).cast("string")), 256)


def T(spark, d, name):
    return X.table(spark, d, name)


@query("A01_union_provenance", "SELECT sha256('documents:' || doc_id) AS id, 'documents' AS origin, lang AS name FROM documents UNION ALL SELECT sha256('nation:' || n_nationkey), 'nation', n_name FROM nation")
def a01(spark, d):
    one = T(spark, d, "documents").select(F.sha2(F.concat(F.lit("documents:"), F.col("doc_id").cast("string")), 256).alias("id"), F.lit("documents").alias("origin"), F.col("lang").alias("name"))
    two = T(spark, d, "nation").select(F.sha2(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")), 256).alias("id"), F.lit("nation").alias("origin"), F.col("n_name").alias("name"))
    return one.unionByName(two)


@query("A02_first_wins", "SELECT digest, min(doc_id) AS doc_id FROM (SELECT sha256(text) AS digest, doc_id FROM documents WHERE doc_id % 11 <> 0) GROUP BY digest")
def a02(spark, d):
    """The first of equals, protected ones excluded: an aggregate, combined before the shuffle."""
    return T(spark, d, "documents").where("doc_id % 11 <> 0").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"))


@query("A03_pool_extension", "SELECT sha256(source || chr(1) || CAST(doc_id AS VARCHAR)) AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT sha256('labels' || chr(1) || CAST(doc_id AS VARCHAR)) FROM labels")
def a03(spark, d):
    key = lambda source: F.sha2(F.concat(source, F.lit("\x01"), F.col("doc_id").cast("string")), 256).alias("id")
    labels = T(spark, d, "labels").select("doc_id")
    fresh = T(spark, d, "documents").join(labels, "doc_id", "left_anti")
    return fresh.select(key(F.col("source"))).union(labels.select(key(F.lit("labels"))))


@query("A04_independent_pool", "SELECT doc_id, substr(sha256(text), 1, 16) AS pool_id FROM documents WHERE doc_id % 3 = 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 1)")
def a04(spark, d):
    rows = T(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return rows.where("doc_id % 3 = 0").join(rows.where("doc_id % 3 = 1").select("digest"), "digest", "left_anti").select("doc_id", F.substring("digest", 1, 16).alias("pool_id"))


@query("A05_multiset_difference", "SELECT event_type, user_id % 20 AS u FROM events EXCEPT ALL SELECT event_type, user_id % 20 AS u FROM events WHERE event_id % 2 = 0")
def a05(spark, d):
    rows = T(spark, d, "events").select("event_id", "event_type", (F.col("user_id") % 20).alias("u"))
    return rows.select("event_type", "u").exceptAll(rows.where("event_id % 2 = 0").select("event_type", "u"))


@query("A06_train_only_augmentation", f"WITH {_NEAR_PROTECTED} SELECT doc_id FROM documents WHERE doc_id % 10 <> 0 AND doc_id NOT IN (SELECT doc_id FROM hit)")
def a06(spark, d):
    """What may be added to training: unprotected documents that are neither copies of a protected one nor near one."""
    return T(spark, d, "documents").where("doc_id % 10 <> 0").select("doc_id").join(near_protected(spark, d).select("doc_id"), "doc_id", "left_anti")


def duplicate_groups(spark, d, members=None):
    """Documents as images of their duplicate groups; their language and, where labelled, quality are the classes. Every thirteenth group is protected."""
    known = T(spark, d, "labels").select("doc_id", F.concat(F.lit("quality"), F.col("quality").cast("string")).alias("label"))
    members = near_duplicates(spark, d).components() if members is None else members
    groups = members.select("doc_id", F.col("component").alias("group"))
    rows = T(spark, d, "documents").select("doc_id", "lang").join(known, "doc_id", "left").join(groups, "doc_id")
    classes = F.array_compact(F.array("lang", "label")).alias("classes")
    return splits.describe_groups(rows.select(F.col("doc_id").alias("id"), "group", classes, (F.col("group") % 13 == 0).alias("protected")))


_SHARES = {"validation": 0.10, "test": 0.10, "pseudo_audit": 0.05, "unlabeled": 0.15}
_GROUPS = f"""WITH RECURSIVE {near.HASH_SQL}, {near.COMPONENT_SQL}, member AS (SELECT component AS g, d.doc_id, d.lang, 'quality' || l.quality AS label FROM component JOIN documents d ON d.doc_id = node LEFT JOIN labels l ON l.doc_id = d.doc_id),
class AS (SELECT g, c, count(*) AS n FROM (SELECT g, lang AS c FROM member UNION ALL SELECT g, label FROM member) WHERE c IS NOT NULL GROUP BY g, c),
grp AS (SELECT m.g, count(*) AS images, m.g % 13 = 0 AS protected, any_value(k.kind) AS kind FROM member m LEFT JOIN (SELECT g, string_agg(c || '=' || n, ';' ORDER BY c) AS kind FROM class GROUP BY g) k ON k.g = m.g GROUP BY m.g)"""
_POINT = "((row_number() OVER (ORDER BY images DESC, coalesce(kind, ''), sha256('{0}:' || g), g)) & 1073741823) * 2654435769 % 4294967296 AS point"
_CASES = " ".join(f"WHEN point >= {a} AND point < {b} THEN '{n}'" for n, (a, b) in splits.intervals(_SHARES).items())
_SPLIT = f"""{_GROUPS}, placed AS (SELECT g, images, CASE {_CASES} ELSE 'train_pool' END AS split FROM (SELECT *, {_POINT.format(42)} FROM grp WHERE NOT protected)),
roomy AS (SELECT k, name FROM (VALUES {", ".join(f"({k}, '{n}', {x})" for k, (n, x) in enumerate(_SHARES.items()))}) v(k, name, share) WHERE round_even((SELECT sum(images) FROM placed) * share::DOUBLE, 0) >= (SELECT count(DISTINCT c) FROM class JOIN placed ON placed.g = class.g)),
lacking AS (SELECT DISTINCT c, k, name FROM class JOIN placed ON placed.g = class.g, roomy WHERE NOT EXISTS (SELECT 1 FROM class x JOIN placed y ON y.g = x.g WHERE x.c = class.c AND y.split = name)),
chosen AS (SELECT l.k, l.name, min_by(class.g, sha256('42:' || l.k || ':' || class.g)) AS g FROM lacking l JOIN class ON class.c = l.c JOIN placed ON placed.g = class.g WHERE split = 'train_pool' GROUP BY l.c, l.k, l.name),
moved AS (SELECT g, min_by(name, k) AS name FROM chosen GROUP BY g), final AS (SELECT p.g, images, coalesce(name, split) AS split FROM placed p LEFT JOIN moved ON moved.g = p.g UNION ALL SELECT g, images, 'external_test' FROM grp WHERE protected)"""


@query("A07_stratified_split", f"{_SPLIT} SELECT doc_id, m.g AS grp, split FROM member m JOIN final f ON f.g = m.g")
def a07(spark, d):
    """Whole duplicate groups go to validation, test, pseudo_audit or unlabeled; the rest trains; protected groups are external."""
    members = near_duplicates(spark, d).components()
    chosen = splits.split_groups(duplicate_groups(spark, d, members), _SHARES, 42)
    return members.select("doc_id", F.col("component").alias("group")).join(chosen, "group").select("doc_id", F.col("group").alias("grp"), "split")


@query("A08_group_allocator", f"{_SPLIT}, train AS (SELECT f.g, f.images, kind FROM final f JOIN grp ON grp.g = f.g WHERE split = 'train_pool') SELECT g AS grp, images, CAST(CASE WHEN point < 429496730 THEN 10 WHEN point < 858993459 THEN 20 WHEN point < 1717986918 THEN 40 ELSE 100 END AS INT) AS budget FROM (SELECT *, {_POINT.format(3407)} FROM train)")
def a08(spark, d):
    """Nested label budgets of the groups that train, each near the whole's share of every class."""
    groups = duplicate_groups(spark, d)
    train = splits.split_groups(groups, _SHARES, 42).where("split = 'train_pool'").select("group")
    return splits.budgets(groups.join(train, "group"), (10, 20, 40, 100), 3407).select(F.col("group").alias("grp"), "images", "budget")


@query("A09_group_integrity", f"SELECT lang, count(DISTINCT {_DOC_SPLIT}) AS splits FROM documents GROUP BY lang HAVING count(DISTINCT {_DOC_SPLIT}) > 1")
def a09(spark, d):
    return docs(spark, d).groupBy("lang").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def image_kinds(spark, d):
    """Each image with its set of classes; of these there are 31 at most."""
    return X.boxes(spark, d).groupBy("image_id").agg(F.array_sort(F.collect_set("class_id")).alias("kind"))


def selected(spark, d, quota=6):
    """The ids of the quota selection. Of each class set only its largest ids can be chosen, as many as all quotas allow; tasks keep
    no more than that before the shuffle."""
    order = Window.partitionBy("kind").orderBy(F.col("image_id").cast("string").desc())
    top = image_kinds(spark, d).withColumn("k", F.row_number().over(order)).where(F.col("k") <= 5 * quota)
    heads: dict[tuple[int, ...], list[str]] = {}
    for kind, image_id, _ in top.select("kind", F.col("image_id").cast("string"), "k").orderBy("kind", "k").collect():
        heads.setdefault(tuple(kind), []).append(image_id)
    return allocation.rarest_first(heads, dict.fromkeys(range(5), quota))


@query("A10_rarest_first")
def a10(spark, d):
    return spark.createDataFrame([(int(i),) for i in selected(spark, d)], "image_id long")


@query("A11_selection_output")
def a11(spark, d):
    ids = F.broadcast(spark.createDataFrame([(int(i),) for i in selected(spark, d)], "image_id long"))  # at most the sum of quotas
    return X.boxes(spark, d).join(ids, "image_id").groupBy("image_id").agg(F.count("*").alias("boxes"), F.array_sort(F.collect_set("class_id")).alias("classes"))


@query("A12_balanced_repeats")
def a12(spark, d):
    """Images of a class set get equally many appearances; those first in the seed's order one more, where it doesn't divide."""
    kinds = image_kinds(spark, d)
    sizes = {tuple(r[0]): r[1] for r in kinds.groupBy("kind").agg(F.count("*")).collect()}
    rows, before = [], 0
    for kind, extra in sorted(allocation.balanced_repeats(sizes, 3).items()):
        rows.append((list(kind), extra // sizes[kind], extra % sizes[kind], before))
        before += sizes[kind]
    placed = kinds.join(F.broadcast(spark.createDataFrame(rows, "kind array<int>, rounds long, more long, before long")), "kind")  # a row a class set
    order = F.sha2(F.concat_ws(":", F.lit("42"), F.col("image_id").cast("string"), (F.col("rounds") + 2).cast("string")), 256)
    times = 1 + F.col("rounds") + (F.col("rank") - F.col("before") <= F.col("more")).cast("long")
    return ranked(placed, [F.col("kind"), order, F.col("image_id")]).select("image_id", F.explode(F.sequence(F.lit(1), times.cast("int"))).alias("occurrence"))


_INTERLEAVE = "(SELECT doc_id, row_number() OVER (ORDER BY sha256('42:{0}:' || CAST(doc_id AS VARCHAR))) - 1 AS k, count(*) OVER () AS n FROM {1})"


@query(
    "A13_interleave",
    f"SELECT i * 2 + s AS position, kind, doc_id FROM (SELECT unnest(generate_series(0, (SELECT greatest(count(*) FILTER (h), count(*) FILTER (NOT h)) FROM (SELECT doc_id IN (SELECT doc_id FROM labels) AS h FROM documents)) - 1)) AS i) JOIN (SELECT 0 AS s, 'human' AS kind, * FROM {_INTERLEAVE.format('human', '(SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))')} UNION ALL SELECT 1, 'pseudo', * FROM {_INTERLEAVE.format('pseudo', '(SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))')}) ON i % n = k",
)
def a13(spark, d):
    """Both kinds in seeded order, the shorter repeated; a row's places follow from its rank and its kind's size."""
    marked = T(spark, d, "documents").select("doc_id").join(T(spark, d, "labels").select("doc_id", F.lit(True).alias("h")).distinct(), "doc_id", "left")
    kind = F.when(F.col("h"), "human").otherwise("pseudo")
    rows = marked.select("doc_id", kind.alias("kind")).withColumn("o", F.sha2(F.concat(F.lit("42:"), F.col("kind"), F.lit(":"), F.col("doc_id").cast("string")), 256))
    placed = ranked(rows, [F.col("kind"), F.col("o")], "r")
    sizes = placed.groupBy("kind").agg(F.count("*").alias("n"), F.min("r").alias("low"))
    most = sizes.agg(F.max("n").alias("most"))
    placed = placed.join(F.broadcast(sizes), "kind").crossJoin(F.broadcast(most)).withColumn("k", F.col("r") - F.col("low"))  # two rows, one row
    repeated = placed.select("doc_id", "kind", F.explode(F.sequence(F.col("k").cast("long"), F.col("most") - 1, F.col("n"))).alias("i"))
    return repeated.select((F.col("i") * 2 + F.when(F.col("kind") == "human", 0).otherwise(1)).alias("position"), "kind", "doc_id")


@query("A14_natural_order", "SELECT doc_id, row_number() OVER (ORDER BY sha256('42:natural:' || CAST(doc_id AS VARCHAR))) AS position FROM labels")
def a14(spark, d):
    return ranked(T(spark, d, "labels").select("doc_id"), [seeded(42, "doc_id", "natural")], "position")


@query("A15_domain_repeat", "SELECT doc_id, CAST(k AS INT) AS copy FROM documents, (SELECT unnest([1, 2, 3]) AS k) WHERE k <= CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 ELSE 3 END")
def a15(spark, d):
    times = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 2).otherwise(3)
    return T(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), times)).alias("copy"))


@query("A16_validation_prefix", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE k <= greatest(1, round_even(n * 0.15::DOUBLE, 0))")
def a16(spark, d):
    rows = ranked_within(T(spark, d, "documents").select("doc_id", "source"), ["source"], [F.col("doc_id")], "k", "n")
    return rows.where(F.col("k") <= F.greatest(F.lit(1.0), F.bround(F.col("n") * F.lit(0.15), 0))).select("doc_id")


@query("A17_category_holdout", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || CAST(doc_id AS VARCHAR))) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE k <= greatest(1, round_even(n * 0.2::DOUBLE, 0))")
def a17(spark, d):
    """The held-out fifth of every category, in seeded order."""
    rows = ranked_within(T(spark, d, "documents").select("doc_id", "source"), ["source"], [seeded(42, "doc_id")], "k", "n")
    return rows.where(F.col("k") <= F.greatest(F.lit(1.0), F.bround(F.col("n") * F.lit(0.2), 0))).select("source", "doc_id")


@query("A18_incremental_replay", "SELECT doc_id, 'replay' AS role FROM (SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY sha256('7:' || CAST(doc_id AS VARCHAR)) LIMIT 100) UNION ALL SELECT doc_id, 'novel' FROM documents WHERE lang = 'es' UNION ALL SELECT doc_id, 'validation' FROM documents WHERE lang = 'de' AND doc_id % 10 = 0")
def a18(spark, d):
    rows = T(spark, d, "documents")
    replay = rows.where("lang = 'en'").orderBy(seeded(7, "doc_id")).limit(100)
    part = lambda df, role: df.select("doc_id", F.lit(role).alias("role"))
    return part(replay, "replay").union(part(rows.where("lang = 'es'"), "novel")).union(part(rows.where("lang = 'de' AND doc_id % 10 = 0"), "validation"))


@query("A19_holdout_view", "SELECT doc_id, CAST(5 + CASE lang WHEN 'de' THEN 0 WHEN 'es' THEN 1 ELSE 2 END AS INT) AS class_id FROM documents WHERE lang <> 'en' AND doc_id % 5 = 0")
def a19(spark, d):
    mapping = F.create_map(*(F.lit(x) for pair in (("de", 5), ("es", 6), ("fr", 7)) for x in pair))
    return T(spark, d, "documents").where("lang <> 'en' AND doc_id % 5 = 0").select("doc_id", F.coalesce(F.try_element_at(mapping, "lang"), F.lit(7)).alias("class_id"))


@query("A20_full_label_upper_bound", "SELECT doc_id, count(*) AS parts FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) GROUP BY doc_id")
def a20(spark, d):
    labels = T(spark, d, "labels").select("doc_id")
    rest = T(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left_anti")
    return labels.union(rest).groupBy("doc_id").agg(F.count("*").alias("parts"))


@query("A21_supervised_snapshot", f"SELECT doc_id, split FROM (SELECT doc_id, {_DOC_SPLIT} AS split FROM documents) WHERE split <> 'train_pool' OR doc_id % 100 < 20")
def a21(spark, d):
    return docs(spark, d).where("split <> 'train_pool' OR doc_id % 100 < 20").select("doc_id", "split")


_TILES = f"SELECT image_id, cx, cy, min(area) AS area FROM (SELECT *, (x2-x1)*(y2-y1) AS area, {_CROP} AS cx, {_CROP_Y} AS cy FROM boxes) WHERE area/480000 < 0.03::DOUBLE GROUP BY image_id, cx, cy"


@query("A22_object_tiles", X.sql(f"SELECT image_id, cx, cy, CAST(tile AS INT) AS tile FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area, cx, cy) AS tile FROM ({_TILES})) WHERE tile <= 3"))
def a22(spark, d):
    tiles = crops(spark, d).withColumn("area", G.Box.of().area).where(F.col("area") / 480000 < 0.03).groupBy("image_id", "cx", "cy").agg(F.min("area").alias("area"))
    return tiles.select("image_id", "cx", "cy", F.row_number().over(Window.partitionBy("image_id").orderBy("area", "cx", "cy")).alias("tile")).where("tile <= 3")


@query("A23_student_dataset", X.sql("SELECT image_id, 'human' AS kind, count(*) AS boxes FROM truth WHERE image_id % 3 = 0 GROUP BY image_id UNION ALL SELECT image_id, 'pseudo', count(*) FROM flips WHERE confidence > 0.85 AND image_id NOT IN (SELECT image_id FROM truth WHERE image_id % 3 = 0) AND image_id % 7 <> 0 GROUP BY image_id"))
def a23(spark, d):
    human = X.truth(spark, d).where("image_id % 3 = 0").groupBy("image_id").agg(F.count("*").alias("boxes"))
    pseudo = X.flips(spark, d).where("confidence > 0.85 AND image_id % 7 <> 0").join(human.select("image_id"), "image_id", "left_anti").groupBy("image_id").agg(F.count("*").alias("boxes"))
    return human.select("image_id", F.lit("human").alias("kind"), "boxes").union(pseudo.select("image_id", F.lit("pseudo").alias("kind"), "boxes"))


@query("A24_objectness_view", X.sql("SELECT image_id, 0 AS class_id, x1, y1, x2, y2 FROM truth UNION ALL SELECT image_id, 0, x1, y1, x2, y2 FROM flips WHERE confidence > 0.9"))
def a24(spark, d):
    rows = X.truth(spark, d).unionByName(X.flips(spark, d).where("confidence > 0.9").drop("confidence", "view"))
    return rows.withColumn("class_id", F.lit(0))


@query("A25_rekeying", "SELECT doc_id, 'aux-' || source || '-' || substr(sha256(source || ':' || CAST(doc_id AS VARCHAR)), 1, 24) AS new_id FROM documents")
def a25(spark, d):
    digest = F.substring(F.sha2(F.concat(F.col("source"), F.lit(":"), F.col("doc_id").cast("string")), 256), 1, 24)
    return T(spark, d, "documents").select("doc_id", F.concat(F.lit("aux-"), F.col("source"), F.lit("-"), digest).alias("new_id"))


@query("O01_casefold_sort", "SELECT p_name, row_number() OVER (ORDER BY lower(p_name), p_name, p_partkey) AS k FROM part")
def o01(spark, d):
    names = T(spark, d, "part").select("p_name", "p_partkey")
    return ranked(names, [F.lower("p_name"), F.col("p_name"), F.col("p_partkey")], "k").select("p_name", "k")


@query("O02_seeded_order", "SELECT doc_id, sha256('42:' || CAST(doc_id AS VARCHAR)) AS sort_key FROM documents ORDER BY sort_key")
def o02(spark, d):
    return T(spark, d, "documents").select("doc_id", seeded(42, "doc_id").alias("sort_key")).orderBy("sort_key")


@query("O03_first_images", X.sql("SELECT image_id, count(*) AS boxes FROM boxes WHERE image_id IN (SELECT image_id FROM (SELECT image_id, min(confidence) AS p FROM boxes GROUP BY image_id) ORDER BY p, image_id LIMIT 50) GROUP BY image_id"))
def o03(spark, d):
    """The first N images by their first row; all rows of those are admitted."""
    b = X.boxes(spark, d)
    first = b.groupBy("image_id").agg(F.min("confidence").alias("p")).orderBy("p", "image_id").limit(50).select("image_id")
    return b.join(F.broadcast(first), "image_id", "left_semi").groupBy("image_id").agg(F.count("*").alias("boxes"))


@query("O04_protocol_order", "SELECT event_id, event_type, coalesce(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END, 3) AS protocol_rank FROM events")
def o04(spark, d):
    ranks = F.broadcast(spark.createDataFrame([("view", 0), ("click", 1), ("purchase", 2)], "event_type string, r int"))
    return T(spark, d, "events").select("event_id", "event_type").join(ranks, "event_type", "left").select("event_id", "event_type", F.coalesce("r", F.lit(3)).alias("protocol_rank"))


@query("O05_label_sort", X.sql("SELECT image_id, class_id, x1, y1, x2, y2, confidence FROM boxes ORDER BY image_id, class_id, x1, y1, x2, y2, confidence DESC"))
def o05(spark, d):
    return X.boxes(spark, d).drop("view").orderBy("image_id", "class_id", "x1", "y1", "x2", "y2", F.desc("confidence"))


@query("O06_argmax_tuple", X.sql("SELECT image_id, max({'c': confidence, 'm': -x1, 'y': -y1, 'k': class_id}).k AS class_id FROM boxes GROUP BY image_id"))
def o06(spark, d):
    return X.boxes(spark, d).groupBy("image_id").agg(F.max_by("class_id", F.struct(F.col("confidence"), -F.col("x1"), -F.col("y1"), F.col("class_id"))).alias("class_id"))


@query("O07_replay_limit", "SELECT count(*) AS n, count(DISTINCT doc_id) AS distinct_n FROM (SELECT doc_id FROM documents ORDER BY sha256('9:' || CAST(doc_id AS VARCHAR)) LIMIT 64)")
def o07(spark, d):
    return T(spark, d, "documents").orderBy(seeded(9, "doc_id")).limit(64).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("distinct_n"))


@query("X01_string_functions", "SELECT p_partkey, list_transform(string_split(lower(trim(p_name)), ' '), lambda w: w) AS words, replace(lower(trim(p_name)), ' ', ';') AS joined FROM part")
def x01(spark, d):
    words = F.split(F.lower(F.trim("p_name")), " ")
    return T(spark, d, "part").select("p_partkey", words.alias("words"), F.array_join(words, ";").alias("joined"))


@query("X02_full_match", "SELECT doc_id, regexp_matches(sha256(lang), '^[0-9a-f]{64}$') AS is_digest, regexp_matches(source, '^[a-z0-9][a-z0-9_-]{0,3}$') AS is_run_id FROM documents")
def x02(spark, d):
    return T(spark, d, "documents").select("doc_id", F.sha2("lang", 256).rlike("^[0-9a-f]{64}$").alias("is_digest"), F.col("source").rlike("^[a-z0-9][a-z0-9_-]{0,3}$").alias("is_run_id"))


@query("X03_sha256_ids", "SELECT doc_id, sha256(text) AS digest, substr(sha256(text), 1, 12) AS short_id FROM documents")
def x03(spark, d):
    digest = F.sha2("text", 256)
    return T(spark, d, "documents").select("doc_id", digest.alias("digest"), F.substring(digest, 1, 12).alias("short_id"))


@query("X04_fixed_decimals", X.sql("SELECT image_id, printf('%.3f', confidence) AS d3, printf('%.6f', x1/800) AS d6, printf('%.8f', y1/600) AS d8 FROM boxes"))
def x04(spark, d):
    return X.boxes(spark, d).select("image_id", F.format_string("%.3f", "confidence").alias("d3"), F.format_string("%.6f", F.col("x1") / 800).alias("d6"), F.format_string("%.8f", F.col("y1") / 600).alias("d8"))


@query("X05_path_parts", "SELECT page_id, regexp_extract(url, '([^/]+?)(\\.[A-Za-z0-9]+)?$', 1) AS stem, regexp_extract(url, '(\\.[A-Za-z0-9]+)$', 1) AS suffix FROM pages")
def x05(spark, d):
    return T(spark, d, "pages").select("page_id", F.regexp_extract("url", r"([^/]+?)(\.[A-Za-z0-9]+)?$", 1).alias("stem"), F.regexp_extract("url", r"(\.[A-Za-z0-9]+)$", 1).alias("suffix"))


@query("X06_bit_operations", "SELECT event_id, CAST(bit_count(xor(event_id, user_id)) AS INT) AS bits, (user_id >> 3) & 7 AS part, xor(event_id, user_id) AS mixed FROM events")
def x06(spark, d):
    mixed = F.col("event_id").bitwiseXOR(F.col("user_id"))
    return T(spark, d, "events").select("event_id", F.bit_count(mixed).alias("bits"), F.shiftright("user_id", 3).bitwiseAND(F.lit(7)).alias("part"), mixed.alias("mixed"))


@query("X07_math", "SELECT event_id, round_even(value * 10, 0) AS even, floor(value) AS low, ceil(value) AS high, round(sqrt(value * value + 1), 9) AS root, isfinite(value) AS finite FROM events")
def x07(spark, d):
    v = F.col("value")
    return T(spark, d, "events").select("event_id", F.bround(v * 10, 0).alias("even"), F.floor(v).cast("double").alias("low"), F.ceil(v).cast("double").alias("high"), F.round(F.sqrt(v * v + 1), 9).alias("root"), (~F.isnan(v) & (F.abs(v) < float("inf"))).alias("finite"))


_JSON = """'{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}'"""


@query("X08_canonical_json", f"SELECT doc_id, {_JSON} AS json, sha256({_JSON}) AS fingerprint FROM documents")
def x08(spark, d):
    """Keys sorted, compact: fields are listed in the order of their names."""
    row = F.to_json(F.struct(F.col("doc_id"), F.col("lang"), F.col("source")))
    return T(spark, d, "documents").select("doc_id", row.alias("json"), F.sha2(row, 256).alias("fingerprint"))


@query("X09_set_and_map", "SELECT doc_id, list_sort(list_filter(['de','en','fr'], lambda x: x <> lang)) AS others, len(list_distinct([lang, source, lang])) AS distinct_parts FROM documents")
def x09(spark, d):
    m = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    others = F.array_sort(F.array_except(F.array(F.lit("de"), F.lit("en"), F.lit("fr")), F.array("lang")))
    return T(spark, d, "documents").select("doc_id", others.alias("others"), F.size(F.array_distinct(F.array_append(F.map_values(m), F.col("lang")))).cast("long").alias("distinct_parts"))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


@query("X10_vector_math", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE)), 6) AS square, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE))), 6) AS norm FROM embeddings")
def x10(spark, d):
    square = dot(F.col("embedding"), F.col("embedding"))
    return T(spark, d, "embeddings").select("vec_id", F.round(square, 6).alias("square"), F.round(F.sqrt(square), 6).alias("norm"))


def interpolate(text: str, values: dict[str, str]) -> str:
    """``${NAME}`` from ``values``; an unknown name is an error."""
    return re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", lambda m: values[m[1]], text)


_TEMPLATE = "runs/${SOURCE}/${LANG}/${ID}.json"


@query("X11_interpolation", "SELECT doc_id, 'runs/' || source || '/' || lang || '/' || doc_id || '.json' AS path FROM documents")
def x11(spark, d):
    """A path for each row from one template, whose names are columns; an unknown name is an error."""
    parts = re.split(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", _TEMPLATE)
    values = {"SOURCE": F.col("source"), "LANG": F.col("lang"), "ID": F.col("doc_id").cast("string")}
    path = F.concat(*(values[p] if k % 2 else F.lit(p) for k, p in enumerate(parts)))
    return T(spark, d, "documents").select("doc_id", path.alias("path"))
