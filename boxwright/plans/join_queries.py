"""J: joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from boxwright.functions import geometry as G
from boxwright.operators import graphs, matching
from boxwright.operators import near_duplicates as near
from boxwright.operators.ordered import ranked_within
from boxwright.plans.geometry_queries import _OVERLAP, known_overlap
from boxwright.plans.registry import query
from boxwright.sources import fixtures as X

_ALIASES = [(f"src{k}", lang, name) for k in range(0, 20, 2) for lang, name in (("en", "apple"), ("de", "banana"), ("fr", "orange"))]
_ALIAS_SQL = "aliases(source, alias, name) AS (VALUES " + ", ".join(f"('{s}','{a}','{n}')" for s, a, n in _ALIASES) + ")"
_CLASS_SQL = "classes(id, name) AS (VALUES " + ", ".join(f"({k},'{n}')" for k, n in enumerate(X.CLASS_NAMES)) + ")"


def aliases(spark):
    return F.broadcast(spark.createDataFrame(_ALIASES, "source string, lang string, name string"))  # the fixed registry


def classes(spark):
    return F.broadcast(spark.createDataFrame(list(enumerate(X.CLASS_NAMES)), "id int, name string"))


@query("J01_class_alias", f"WITH {_ALIAS_SQL}, {_CLASS_SQL} SELECT d.doc_id, c.id AS class_id FROM documents d JOIN aliases a ON d.source = a.source AND lower(trim(d.lang)) = a.alias JOIN classes c ON c.name = a.name")
def j01(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id", "source", F.lower(F.trim("lang")).alias("lang"))
    return docs.join(aliases(spark), ["source", "lang"]).join(classes(spark), "name").select("doc_id", F.col("id").alias("class_id"))


@query("J02_coco_join", "SELECT l_orderkey, l_linenumber, o_orderdate, n.p_name AS category FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part n ON l.l_partkey = n.p_partkey WHERE p_size < 10")
def j02(spark, d):
    """Annotations with their image and a mapped category; unmapped categories are skipped."""
    mapped = X.table(spark, d, "part").where("p_size < 10").select("p_partkey", F.col("p_name").alias("category"))
    images = X.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    rows = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return rows.join(mapped, rows["l_partkey"] == mapped["p_partkey"]).join(images, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderdate", "category")


@query("J03_url_missing", "SELECT d.doc_id FROM documents d LEFT JOIN pages p ON d.doc_id = p.page_id WHERE p.page_id IS NULL")
def j03(spark, d):
    return X.table(spark, d, "documents").select("doc_id").join(X.table(spark, d, "pages").select(F.col("page_id").alias("doc_id")), "doc_id", "left_anti")


@query("J04_hash_lookup", "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), sha256(d.text)) AS image_hash FROM documents d LEFT JOIN labels l USING (doc_id)")
def j04(spark, d):
    docs, known = X.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("own")), X.table(spark, d, "labels").select("doc_id", "quality")
    return docs.join(known, "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), "own").alias("image_hash"))


@query("J05_split_override", "SELECT d.doc_id, coalesce('q' || CAST(l.quality AS VARCHAR), '<unassigned>') AS split FROM documents d LEFT JOIN labels l USING (doc_id)")
def j05(spark, d):
    known = X.table(spark, d, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("split"))
    return X.table(spark, d, "documents").select("doc_id").join(known, "doc_id", "left").select("doc_id", F.coalesce("split", F.lit("<unassigned>")).alias("split"))


_SETS = "SELECT 'only_left' AS side, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'only_right', count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)"


@query("J06_set_equality", _SETS)
def j06(spark, d):
    a, b = X.table(spark, d, "documents").select("doc_id"), X.table(spark, d, "labels").select("doc_id")
    count = lambda x, y, n: x.join(y, "doc_id", "left_anti").distinct().agg(F.count("*").alias("n")).select(F.lit(n).alias("side"), "n")
    return count(a, b, "only_left").union(count(b, a, "only_right"))


@query("J07_partition_disjoint", "SELECT sha256(text) AS digest, count(DISTINCT lang) AS partitions FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1 OR count(DISTINCT source) > 1")
def j07(spark, d):
    docs = X.table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count_distinct("lang").alias("partitions"), F.count_distinct("source").alias("sources"))
    return docs.where("partitions > 1 OR sources > 1").drop("sources")


@query("J08_protected_exclusion", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j08(spark, d):
    return X.table(spark, d, "documents").select("doc_id", "source").join(X.table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_anti")


@query("J09_max_known_iou", X.sql("SELECT image_id, confidence, x1, known_iou FROM o", f"o AS ({_OVERLAP})"))
def j09(spark, d):
    return known_overlap(spark, d).select("image_id", "confidence", "x1", "known_iou")


def near_duplicates(spark, d):
    """Near duplicates among the documents, whose texts stand for pictures."""
    return near.NearDuplicates(X.table(spark, d, "documents"))


@query("J10_near_duplicates", f"WITH {near.HASH_SQL} SELECT m.doc_id, m.representative, (SELECT count(*) FROM around WHERE a = m.representative) - 1 AS links FROM m")
def j10(spark, d):
    """Every document with its class and how many other classes are near it."""
    found = near_duplicates(spark, d)
    links = found.both_ways().groupBy(F.col("a").alias("representative")).agg((F.count("*") - 1).alias("links"))
    return found.members().join(links, "representative").select("doc_id", "representative", "links")


@query("J10_class_links", f"WITH {near.HASH_SQL} SELECT a, b, CAST(distance AS INT) AS distance FROM near")
def j10_links(spark, d):
    """Links between classes of equal hashes, by their representatives."""
    found = near.classes(near.fingerprints(X.table(spark, d, "documents")))
    return near.class_links(graphs.materialise(found, "classes"))


def near_protected(spark, d):
    """Unprotected documents that are copies of a protected one, or else near one: doc_id, kind, protected_id (the first)."""
    found = near_duplicates(spark, d)
    docs = X.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), (F.col("doc_id") % 10 == 0).alias("protected"))
    guarded = docs.where("protected")
    members = found.members()
    exact = guarded.groupBy("digest").agg(F.min("doc_id").alias("same"))
    held = members.join(guarded.select("doc_id"), "doc_id").groupBy(F.col("representative").alias("b")).agg(F.min("doc_id").alias("held"))
    close = found.both_ways().join(held, "b").groupBy(F.col("a").alias("representative")).agg(F.min("held").alias("close"))
    rows = docs.where("NOT protected").join(members, "doc_id").join(exact, "digest", "left").join(close, "representative", "left")
    kind = F.when(F.col("same").isNotNull(), "exact").when(F.col("close").isNotNull(), "near").alias("kind")
    return rows.select("doc_id", kind, F.coalesce("same", "close").alias("protected_id")).where("kind IS NOT NULL")


_NEAR_PROTECTED = f"""{near.HASH_SQL}, g AS (SELECT doc_id, sha256(text) AS digest, doc_id % 10 = 0 AS protected FROM documents), same AS (SELECT digest, min(doc_id) AS same FROM g WHERE protected GROUP BY digest),
held AS (SELECT representative, min(doc_id) AS held FROM m WHERE doc_id % 10 = 0 GROUP BY 1), close_to AS (SELECT a, min(held) AS close FROM around JOIN held ON held.representative = b GROUP BY a),
hit AS (SELECT g.doc_id, CASE WHEN same IS NOT NULL THEN 'exact' ELSE 'near' END AS kind, coalesce(same, close) AS protected_id FROM g JOIN m ON m.doc_id = g.doc_id LEFT JOIN same ON same.digest = g.digest LEFT JOIN close_to ON a = representative WHERE NOT protected AND coalesce(same, close) IS NOT NULL)"""


@query("J11_near_protected", f"WITH {_NEAR_PROTECTED} SELECT doc_id, kind, protected_id FROM hit")
def j11(spark, d):
    return near_protected(spark, d)


@query("J12_exact_hash_hits", "SELECT doc_id FROM documents WHERE doc_id % 10 <> 0 AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0)")
def j12(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return docs.where("doc_id % 10 <> 0").join(docs.where("doc_id % 10 = 0").select("digest"), "digest", "left_semi").select("doc_id")


def numbered(rows, keys, *order):
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def cross_view_pairs(originals, flipped, threshold=0.6):
    """One-to-one pairs of the two views of each image and class; n numbers the flipped boxes of a group."""
    keys = ["image_id", "class_id"]
    right = numbered(flipped.select(*keys, "x1", "y1", "x2", "y2", "confidence"), keys, F.desc("confidence"), "x1", "y1", "x2", "y2")
    order = [-F.col("confidence"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")]
    return matching.greedy_match(originals, right, keys, order, matching.rank_cross_view, threshold), right


def greedy_sql(left, right, order, tie, threshold, partner="n"):
    """Recursive oracle of a greedy matching: lefts in order, each takes its best open right."""
    best = f"list_reverse_sort(list_transform(list_filter(rs, lambda o: NOT list_contains(used, o.n)), lambda o: {tie}))[1]"
    return f"""ls AS (SELECT *, row_number() OVER (PARTITION BY image_id, class_id ORDER BY {order}) AS k FROM {left}),
    rs AS (SELECT image_id, class_id, list({{'n': n, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'confidence': confidence}} ORDER BY n) AS rs FROM {right} GROUP BY image_id, class_id),
    walk AS (SELECT image_id, class_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS DOUBLE) AS x1, CAST(NULL AS DOUBLE) AS y1, CAST(NULL AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS iou FROM (SELECT DISTINCT image_id, class_id FROM ls)
    UNION ALL SELECT image_id, class_id, k, CASE WHEN hit THEN list_append(used, CAST(best.n AS BIGINT)) ELSE used END, confidence, x1, y1, CASE WHEN hit THEN CAST(best.n AS BIGINT) END, CASE WHEN hit THEN best.iou END FROM (
      SELECT *, coalesce(best.iou >= {threshold}::DOUBLE, false) AS hit FROM (
      SELECT l.image_id, l.class_id, l.k, w.used, l.confidence, l.x1, l.y1, {best} AS best
      FROM walk w JOIN ls l ON l.image_id = w.image_id AND l.class_id = w.class_id AND l.k = w.k + 1 LEFT JOIN rs r ON r.image_id = l.image_id AND r.class_id = l.class_id)))"""


_FLIP_NUMBERED = "rights AS (SELECT *, row_number() OVER (PARTITION BY image_id, class_id ORDER BY confidence DESC, x1, y1, x2, y2) AS n FROM flips)"
_TRUST_TIE = f"{{'iou': {X.iou_sql('l', 'o')}, 'a': -o.x1, 'b': -o.y1, 'c': -o.x2, 'e': -o.y2, 'f': o.confidence, 'n': o.n}}"
_ORDER = "confidence DESC, x1, y1, x2, y2"
_LEFTS = "lefts AS (SELECT * FROM boxes)"


@query("J13_cross_view_pairing", X.sql("SELECT image_id, class_id, confidence, x1, y1, n, iou FROM walk WHERE k > 0", f"{_LEFTS}, {_FLIP_NUMBERED}, {greedy_sql('lefts', 'rights', _ORDER, _TRUST_TIE, 0.6)}", recursive=True))
def j13(spark, d):
    pairs, _ = cross_view_pairs(X.boxes(spark, d), X.flips(spark, d))
    return pairs.select("image_id", "class_id", "confidence", "x1", "y1", "n", "iou")


_TRUTH_NUMBERED = "rights AS (SELECT *, CAST(0 AS DOUBLE) AS confidence, row_number() OVER (PARTITION BY image_id, class_id ORDER BY x1, y1, x2, y2) AS n FROM truth)"
_FIRST_TIE = f"{{'iou': {X.iou_sql('l', 'o')}, 'm': -o.n, 'n': o.n}}"


def pr_evidence(spark, d, threshold=0.5):
    keys = ["image_id", "class_id"]
    right = numbered(X.truth(spark, d), keys, "x1", "y1", "x2", "y2")
    order = [-F.col("confidence"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")]
    return matching.greedy_match(X.boxes(spark, d), right, keys, order, matching.rank_first_best, threshold)


PR_SQL = f"{_TRUTH_NUMBERED}, {greedy_sql('boxes', 'rights', _ORDER, _FIRST_TIE, 0.5)}, pr AS (SELECT image_id, class_id, confidence, x1, y1, n IS NOT NULL AS is_true_positive FROM walk WHERE k > 0)"


@query("J14_greedy_pr", X.sql("SELECT image_id, class_id, confidence, x1, y1, is_true_positive FROM pr", PR_SQL, recursive=True))
def j14(spark, d):
    return pr_evidence(spark, d).select("image_id", "class_id", "confidence", "x1", "y1", F.col("n").isNotNull().alias("is_true_positive"))


_LARGEST_TIE = f"{{'iou': {X.iou_sql('l', 'o')}, 'n': o.n}}"
UNKNOWN_SQL = f"""lefts AS (SELECT image_id, 0 AS class_id, confidence, x1, y1, x2, y2 FROM flips WHERE confidence > 0.3),
rights AS (SELECT image_id, 0 AS class_id, class_id AS category, CAST(0 AS DOUBLE) AS confidence, x1, y1, x2, y2, row_number() OVER (PARTITION BY image_id ORDER BY x1, y1, x2, y2, class_id) AS n FROM truth),
{greedy_sql('lefts', 'rights', _ORDER, _LARGEST_TIE, 0.5)}, matched AS (SELECT image_id, confidence, x1, y1, n, iou FROM walk WHERE k > 0)"""


def unknown_matches(spark, d):
    right = numbered(X.truth(spark, d).withColumnRenamed("class_id", "category"), ["image_id"], "x1", "y1", "x2", "y2", "category")
    order = [-F.col("confidence"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")]
    return matching.greedy_match(X.flips(spark, d).where("confidence > 0.3"), right, ["image_id"], order, matching.rank_largest_index, 0.5), right


@query("J15_unknown_matching", X.sql("SELECT * FROM matched", UNKNOWN_SQL, recursive=True))
def j15(spark, d):
    return unknown_matches(spark, d)[0].select("image_id", "confidence", "x1", "y1", "n", "iou")


def overlap_edges(left, right, keys, threshold):
    """Numbered boxes of both sides and their pairs over the threshold."""
    a = numbered(left, keys, F.desc("confidence"), "x1", "y1", "x2", "y2").select(*keys, F.col("n").alias("a"), "x1", "y1", "x2", "y2")
    b = numbered(right, keys, "x1", "y1", "x2", "y2").select(*keys, F.col("n").alias("b"), *(F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")))
    value = G.iou(G.Box.of(), G.Box.of("t_"))
    return a.join(b, keys).withColumn("iou", value).where(F.col("iou") >= threshold).select(*keys, "a", "b", "iou")


def optimal_sql(right: str, threshold: float) -> str:
    """Oracle of an optimal matching of ``boxes`` with ``right``: every matching of an image and class (few boxes overlap), the best of them in ``best``."""
    number = lambda name, source, by: f"SELECT *, row_number() OVER (PARTITION BY image_id, class_id ORDER BY {by}) AS {name} FROM {source}"
    return f"""edges AS (SELECT * FROM (SELECT l.image_id, l.class_id, l.a, o.b, {X.iou_sql("l", "o")} AS iou FROM ({number("a", "boxes", _ORDER)}) l JOIN ({number("b", right, "x1, y1, x2, y2")}) o USING (image_id, class_id)) WHERE iou >= {threshold}::DOUBLE),
    options AS (SELECT image_id, class_id, list({{'a': a, 'b': b, 'iou': iou}} ORDER BY b) AS bs, row_number() OVER (PARTITION BY image_id, class_id ORDER BY a) AS k FROM edges GROUP BY image_id, class_id, a),
    made AS (SELECT DISTINCT image_id, class_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(a BIGINT, b BIGINT, iou DOUBLE)[]) AS pairs FROM edges
    UNION ALL SELECT m.image_id, m.class_id, o.k, CASE WHEN t.choice IS NULL THEN m.pairs ELSE list_append(m.pairs, t.choice) END FROM made m JOIN options o ON o.image_id = m.image_id AND o.class_id = m.class_id AND o.k = m.k + 1, unnest(list_append(o.bs, NULL)) AS t(choice)
      WHERE t.choice IS NULL OR NOT list_contains(list_transform(m.pairs, lambda p: p.b), t.choice.b)),
    best AS (SELECT image_id, class_id, max({{'n': len(pairs), 'total': coalesce(list_sum(list_transform(pairs, lambda p: CAST(round(p.iou * 1e9) AS BIGINT))), 0), 'order': list_transform(pairs, lambda p: {{'a': -p.a, 'b': -p.b}}), 'pairs': pairs}}).pairs AS pairs FROM made GROUP BY image_id, class_id)"""


_MATCHED = "SELECT image_id, class_id, p.a AS a, p.b AS b, p.iou AS iou FROM best, unnest(pairs) AS t(p)"


@query("J16_optimal_matching", X.sql(_MATCHED, optimal_sql("truth", 0.5), recursive=True))
def j16(spark, d):
    edges = overlap_edges(X.boxes(spark, d), X.truth(spark, d), ["image_id", "class_id"], 0.5)
    return matching.optimal_match(edges, ["image_id", "class_id"])


@query("J17_reciprocal_pairs", X.sql(_MATCHED, optimal_sql("flips", 0.6), recursive=True))
def j17(spark, d):
    """Pairs of the two views re-verified by an augmenting matching over each image and class."""
    edges = overlap_edges(X.boxes(spark, d), X.flips(spark, d).drop("confidence", "view"), ["image_id", "class_id"], 0.6)
    return matching.optimal_match(edges, ["image_id", "class_id"])


@query("J18_multiset_binding", "SELECT event_type, user_id, occurrence, decided FROM (SELECT event_type, user_id % 50 AS user_id, row_number() OVER (PARTITION BY event_type, user_id % 50) AS occurrence FROM events) a LEFT JOIN (SELECT event_type, user_id % 50 AS user_id, row_number() OVER (PARTITION BY event_type, user_id % 50) AS occurrence, true AS decided FROM events WHERE event_id % 3 <> 0) b USING (event_type, user_id, occurrence)")
def j18(spark, d):
    """Equal rows are bound one to one by their occurrence number."""
    e = X.table(spark, d, "events").select("event_id", "event_type", (F.col("user_id") % 50).alias("user_id"))
    numbered_ = lambda rows: ranked_within(rows, ["event_type", "user_id"], [F.col("event_id")], "occurrence").drop("event_id")
    left, right = numbered_(e), numbered_(e.where("event_id % 3 <> 0")).withColumn("decided", F.lit(True))
    return left.join(right, ["event_type", "user_id", "occurrence"], "left")


@query("J19_best_truth", X.sql(f"SELECT image_id, confidence, x1, y1, x2, y2, max(v).iou AS iou, max(v).category AS category FROM (SELECT a.*, {{'iou': {X.iou_sql('a', 't')}, 'category': t.class_id}} AS v FROM flips a JOIN truth t ON a.image_id = t.image_id) GROUP BY image_id, confidence, x1, y1, x2, y2"))
def j19(spark, d):
    """An image's truths are an array beside each of its boxes, so that pairs are neither shuffled nor sorted."""
    box = ("x1", "y1", "x2", "y2")
    truths = X.truth(spark, d).groupBy("image_id").agg(F.collect_list(F.struct(F.col("class_id").alias("category"), *box)).alias("truths"))
    best = F.array_max(F.transform("truths", lambda t: F.struct(matching.struct_iou(F.struct(*box), t).alias("iou"), t["category"].alias("category")))).alias("v")
    rows = X.flips(spark, d).select("image_id", "confidence", *box).distinct()
    return rows.join(truths, "image_id").select("image_id", "confidence", *box, best).select("image_id", "confidence", *box, "v.iou", "v.category")


@query("J20_assignment_scores", "SELECT e.vec_id, e.label, coalesce(l.toxic, 0) AS score FROM embeddings e LEFT JOIN labels l ON e.vec_id = l.doc_id")
def j20(spark, d):
    scores = X.table(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), F.col("toxic").alias("score"))
    return X.table(spark, d, "embeddings").select("vec_id", "label").join(scores, "vec_id", "left").select("vec_id", "label", F.coalesce("score", F.lit(0)).alias("score"))


@query("J21_cluster_assignment", X.sql("SELECT f.image_id, f.x1, f.confidence, e.label AS cluster FROM flips f LEFT JOIN embeddings e ON f.image_id = e.vec_id"))
def j21(spark, d):
    clusters = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").alias("cluster"))
    return X.flips(spark, d).select("image_id", "x1", "confidence").join(clusters, "image_id", "left")


@query("J22_membership_and_protection", "SELECT d.doc_id FROM documents d JOIN pages p ON d.doc_id = p.page_id WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = d.doc_id)")
def j22(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id")
    member, protected = X.table(spark, d, "pages").select(F.col("page_id").alias("doc_id")), X.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    return docs.join(member, "doc_id").join(protected, "doc_id", "left_anti")


@query("J23_human_precedence", "SELECT doc_id, 'human' AS kind FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'pseudo' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j23(spark, d):
    human = X.table(spark, d, "labels").where("quality = 1").select("doc_id")
    pseudo = X.table(spark, d, "documents").select("doc_id").join(human, "doc_id", "left_anti")
    return human.withColumn("kind", F.lit("human")).unionByName(pseudo.withColumn("kind", F.lit("pseudo")))


@query("J24_positional_alignment", "SELECT vec_id, list_filter(generate_series(1, 64), lambda i: embedding[i] = list_reverse(embedding)[i]) AS same FROM embeddings")
def j24(spark, d):
    e = X.table(spark, d, "embeddings").select("vec_id", "embedding", F.reverse("embedding").alias("other"))
    pairs = F.transform(F.arrays_zip(F.col("embedding").alias("a"), F.col("other").alias("b")), lambda z, i: F.when(z["a"] == z["b"], (i + 1).cast("long")))
    return e.select("vec_id", F.array_compact(pairs).alias("same"))


@query("J25_append_only_registry", f"WITH {_CLASS_SQL} SELECT n_name FROM nation WHERE n_name NOT IN (SELECT name FROM classes)")
def j25(spark, d):
    return X.table(spark, d, "nation").select("n_name").join(classes(spark), F.col("n_name") == F.col("name"), "left_anti")


@query("J26_id_and_path_membership", "SELECT d.doc_id, l.doc_id IS NOT NULL AS member FROM documents d LEFT JOIN (SELECT doc_id, 'src' || CAST(doc_id % 20 AS VARCHAR) AS source FROM labels WHERE doc_id % 7 <> 0) l ON d.doc_id = l.doc_id AND d.source = l.source")
def j26(spark, d):
    sealed = X.table(spark, d, "labels").where("doc_id % 7 <> 0").select("doc_id", F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("source"), F.lit(True).alias("member"))
    return X.table(spark, d, "documents").select("doc_id", "source").join(sealed, ["doc_id", "source"], "left").select("doc_id", F.coalesce("member", F.lit(False)).alias("member"))


@query("J27_class_coverage", X.sql("SELECT c.id, c.name, count(b.image_id) AS images FROM classes c LEFT JOIN (SELECT DISTINCT image_id, class_id FROM boxes WHERE class_id <> 3) b ON b.class_id = c.id GROUP BY c.id, c.name", _CLASS_SQL))
def j27(spark, d):
    seen = X.boxes(spark, d).where("class_id <> 3").select("image_id", "class_id").distinct().groupBy("class_id").count()
    rows = spark.createDataFrame(list(enumerate(X.CLASS_NAMES)), "id int, name string")
    return rows.join(seen, rows["id"] == seen["class_id"], "left").select("id", "name", F.coalesce("count", F.lit(0)).alias("images"))


@query("J28_evaluation_membership", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' ELSE 'unexpected' END AS problem FROM (SELECT doc_id FROM documents WHERE lang = 'en') a FULL JOIN (SELECT doc_id FROM labels) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL")
def j28(spark, d):
    a = X.table(spark, d, "documents").where("lang = 'en'").select("doc_id", F.lit(1).alias("listed"))
    b = X.table(spark, d, "labels").select("doc_id", F.lit(1).alias("sealed"))
    both = a.join(b, "doc_id", "full").where("listed IS NULL OR sealed IS NULL")
    return both.select("doc_id", F.when(F.col("sealed").isNull(), "missing").otherwise("unexpected").alias("problem"))
