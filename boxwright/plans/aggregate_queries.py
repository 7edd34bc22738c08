"""G: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxwright.functions import geometry as G
from boxwright.operators import digests, graphs, metrics
from boxwright.plans.join_queries import PR_SQL, UNKNOWN_SQL, near_duplicates, pr_evidence, unknown_matches
from boxwright.operators import near_duplicates as near
from boxwright.plans.registry import query
from boxwright.sources import fixtures as X

_DOC_SPLIT = "CASE doc_id % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' WHEN 2 THEN 'pseudo_audit' ELSE 'train_pool' END"


def docs(spark, d):
    k = F.col("doc_id") % 4
    split = F.when(k == 0, "test").when(k == 1, "validation").when(k == 2, "pseudo_audit").otherwise("train_pool")
    return X.table(spark, d, "documents").withColumn("split", split)


def class_rows(spark):
    return spark.range(X.CLASSES).select(F.col("id").cast("int").alias("class_id"))


@query("G01_split_source_class", "SELECT l_linestatus AS split, l_returnflag AS source, CAST(l_suppkey % 5 AS INT) AS class_id, count(*) AS n FROM lineitem GROUP BY ALL")
def g01(spark, d):
    return X._detections(spark, d).groupBy(F.col("l_linestatus").alias("split"), F.col("l_returnflag").alias("source"), "class_id").agg(F.count("*").alias("n"))


@query("G02_license_summary", X.sql("SELECT l_returnflag AS license, count(DISTINCT image_id) AS images, count_if(l_linestatus <> 'O') AS labelled_boxes FROM base GROUP BY 1"))
def g02(spark, d):
    return X._detections(spark, d).groupBy(F.col("l_returnflag").alias("license")).agg(F.count_distinct("image_id").alias("images"), F.count_if(F.col("l_linestatus") != "O").alias("labelled_boxes"))


@query("G03_image_rollup", X.sql("SELECT image_id, string_agg(DISTINCT CAST(class_id AS VARCHAR), ';' ORDER BY CAST(class_id AS VARCHAR)) AS classes, count(*) AS boxes, CASE WHEN bool_and(confidence >= 0.1::DOUBLE) THEN 'accepted' ELSE 'audit_failed' END AS status FROM boxes GROUP BY image_id"))
def g03(spark, d):
    return X.boxes(spark, d).groupBy("image_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.col("class_id").cast("string"))), ";").alias("classes"), F.count("*").alias("boxes"), F.when(F.every(F.col("confidence") >= 0.1), "accepted").otherwise("audit_failed").alias("status")
    )


@query("G04_cross_split_hash", f"SELECT sha256(text) AS image_hash, string_agg(DISTINCT {_DOC_SPLIT}, ',' ORDER BY {_DOC_SPLIT}) AS splits FROM documents GROUP BY 1 HAVING count(DISTINCT {_DOC_SPLIT}) > 1")
def g04(spark, d):
    found = docs(spark, d).groupBy(F.sha2("text", 256).alias("image_hash")).agg(F.array_sort(F.collect_set("split")).alias("s"))
    return found.where(F.size("s") > 1).select("image_hash", F.array_join("s", ",").alias("splits"))


@query("G05_missing_class", "SELECT s.split, l.lang FROM (SELECT DISTINCT source AS split FROM documents) s CROSS JOIN (SELECT DISTINCT lang FROM documents) l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = s.split AND d.lang = l.lang AND d.n_chars > 3000)")
def g05(spark, d):
    """The grid of two controlled vocabularies, minus what occurs."""
    base = X.table(spark, d, "documents")
    grid = base.select(F.col("source").alias("split")).distinct().crossJoin(F.broadcast(base.select("lang").distinct()))
    seen = base.where("n_chars > 3000").select(F.col("source").alias("split"), "lang").distinct()
    return grid.join(seen, ["split", "lang"], "left_anti")


@query("G06_exact_groups", "SELECT sha256(text) AS digest, list(doc_id ORDER BY doc_id) AS members FROM documents GROUP BY 1 HAVING count(*) > 1")
def g06(spark, d):
    grouped = X.table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.array_sort(F.collect_list("doc_id")).alias("members"))
    return grouped.where(F.size("members") > 1)


_COMPONENTS = f"WITH RECURSIVE {near.HASH_SQL}, {near.COMPONENT_SQL}"


@query("G07_components", f"{_COMPONENTS} SELECT node, component FROM (SELECT *, count(*) OVER (PARTITION BY component) AS size FROM component) WHERE size > 1")
def g07(spark, d):
    """Groups of exact or near duplicates of two documents or more."""
    return near_duplicates(spark, d).components().where("size > 1").select(F.col("doc_id").alias("node"), "component")


@query("G08_component_labels", f"{_COMPONENTS} SELECT node AS doc_id, 'duplicate:' || CAST(component AS VARCHAR) AS label FROM (SELECT *, count(*) OVER (PARTITION BY component) AS size FROM component) WHERE size > 1")
def g08(spark, d):
    rows = near_duplicates(spark, d).components().where("size > 1")
    return rows.select("doc_id", F.concat(F.lit("duplicate:"), F.col("component").cast("string")).alias("label"))


_RANK = "CASE split WHEN 'test' THEN 0 WHEN 'validation' THEN 1 WHEN 'pseudo_audit' THEN 2 ELSE 3 END"


@query("G09_split_resolution", f"SELECT digest, split AS retained_split, retained, excluded FROM (SELECT digest, min_by(split, r) AS split, list(doc_id ORDER BY doc_id) FILTER (r = best) AS retained, coalesce(list(doc_id ORDER BY doc_id) FILTER (r <> best), []) AS excluded FROM (SELECT *, min(r) OVER (PARTITION BY digest) AS best FROM (SELECT sha256(text) AS digest, doc_id, split, {_RANK} AS r FROM (SELECT *, {_DOC_SPLIT} AS split FROM documents))) GROUP BY digest HAVING count(*) > 1)")
def g09(spark, d):
    """All members in the best split stay; the others go."""
    r = F.when(F.col("split") == "test", 0).when(F.col("split") == "validation", 1).when(F.col("split") == "pseudo_audit", 2).otherwise(3)
    rows = docs(spark, d).select("doc_id", "split", F.sha2("text", 256).alias("digest"), r.alias("r"))
    groups = rows.groupBy("digest").agg(F.min(F.struct("r", "split")).alias("best"), F.array_sort(F.collect_list(F.struct("doc_id", "r"))).alias("all")).where(F.size("all") > 1)
    ids = lambda test: F.transform(F.filter("all", test), lambda m: m["doc_id"])
    return groups.select("digest", F.col("best.split").alias("retained_split"), ids(lambda m: m["r"] == F.col("best.r")).alias("retained"), ids(lambda m: m["r"] != F.col("best.r")).alias("excluded"))


@query("G10_image_rows", X.sql("SELECT image_id, list_sort(list(DISTINCT class_id)) AS class_presence, list([class_id::DOUBLE, x1, y1] ORDER BY class_id, x1, y1) AS labels FROM boxes GROUP BY image_id"))
def g10(spark, d):
    return X.boxes(spark, d).groupBy("image_id").agg(F.array_sort(F.collect_set("class_id")).alias("class_presence"), F.array_sort(F.collect_list(F.array(F.col("class_id").cast("double"), "x1", "y1"))).alias("labels"))


@query("G11_class_targets", X.sql("SELECT class_id, count(DISTINCT image_id) AS images, 100 * count(DISTINCT image_id)::DOUBLE / (SELECT count(DISTINCT image_id) FROM boxes) AS target FROM boxes GROUP BY class_id"))
def g11(spark, d):
    b = X.boxes(spark, d)
    population = b.agg(F.count_distinct("image_id").alias("population"))
    presence = b.groupBy("class_id").agg(F.count_distinct("image_id").alias("images"))
    return presence.crossJoin(F.broadcast(population)).select("class_id", "images", (100 * F.col("images").cast("double") / F.col("population")).alias("target"))  # one row


@query("G12_aspect_percentiles", X.sql("SELECT class_id, quantile_cont((x2-x1)/(y2-y1), 0.01) AS low, quantile_cont((x2-x1)/(y2-y1), 0.99) AS high FROM boxes GROUP BY class_id"))
def g12(spark, d):
    ratio = G.Box.of().width / G.Box.of().height
    return X.boxes(spark, d).groupBy("class_id").agg(F.percentile(ratio, 0.01).alias("low"), F.percentile(ratio, 0.99).alias("high"))


_CUTS = "cuts AS (SELECT class_id, greatest(0.5::DOUBLE, least(0.85::DOUBLE, confidence)) AS cut FROM pr UNION SELECT class_id, unnest([0.5::DOUBLE, 0.85::DOUBLE]) FROM (SELECT unnest(generate_series(0, 4))::INT AS class_id))"


@query(
    "G13_precision_thresholds",
    X.sql(
        "SELECT k.class_id, coalesce(min(cut) FILTER (n > 0 AND tp / n::DOUBLE >= 0.3::DOUBLE), 0.85::DOUBLE) AS threshold FROM (SELECT unnest(generate_series(0, 4))::INT AS class_id) k LEFT JOIN (SELECT c.class_id, c.cut, count(p.confidence) AS n, count_if(p.is_true_positive) AS tp FROM cuts c LEFT JOIN pr p ON p.class_id = c.class_id AND p.confidence >= c.cut GROUP BY 1, 2) USING (class_id) GROUP BY k.class_id",
        f"{PR_SQL}, {_CUTS}",
        recursive=True,
    ),
)
def g13(spark, d):
    evidence = pr_evidence(spark, d).select("class_id", "confidence", F.col("n").isNotNull().alias("is_true_positive"))
    return metrics.class_thresholds(evidence, class_rows(spark), target=0.3)


_SCORES = "tp, fp, fn, CASE WHEN tp+fp > 0 THEN tp/(tp+fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp+fn > 0 THEN tp/(tp+fn)::DOUBLE ELSE 0 END AS recall"
_F1 = "CASE WHEN precision + recall > 0 THEN 2*precision*recall/(precision+recall) ELSE 0 END AS f1"


@query(
    "G14_precision_recall_f1",
    X.sql(
        f"SELECT *, {_F1} FROM (SELECT class_id, {_SCORES} FROM (SELECT class_id, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM (SELECT class_id, count_if(is_true_positive) AS tp, count_if(NOT is_true_positive) AS fp, (SELECT count(*) FROM truth t WHERE t.class_id = pr.class_id) - count_if(is_true_positive) AS fn FROM pr GROUP BY class_id) GROUP BY GROUPING SETS ((class_id), ())))",
        PR_SQL,
        recursive=True,
    ),
)
def g14(spark, d):
    hit = F.col("n").isNotNull()
    counts = pr_evidence(spark, d).groupBy("class_id").agg(F.count_if(hit).alias("tp"), F.count_if(~hit).alias("fp"))
    truths = X.truth(spark, d).groupBy("class_id").agg(F.count("*").alias("truths"))
    by_class = counts.join(truths, "class_id").select("class_id", "tp", "fp", (F.col("truths") - F.col("tp")).alias("fn"))
    return metrics.scores(by_class.groupingSets([["class_id"], []], "class_id").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))


_CURVE = f"{UNKNOWN_SQL}, curve AS (SELECT *, tp/rank::DOUBLE AS precision, tp/(SELECT count(*) FROM truth)::DOUBLE AS recall FROM (SELECT *, CAST(sum(CASE WHEN n IS NULL THEN 0 ELSE 1 END) OVER w AS BIGINT) AS tp, count(*) OVER w AS rank FROM matched WINDOW w AS (ORDER BY confidence DESC, image_id, x1, y1, n NULLS FIRST, iou NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))"


def unknown_curve(spark, d):
    found = unknown_matches(spark, d)[0].select("image_id", "confidence", "x1", "y1", "n", "iou", F.col("n").isNotNull().alias("is_true"))
    total = X.truth(spark, d).agg(F.count("*").alias("truths"))
    order = [F.desc("confidence"), F.asc("image_id"), F.asc("x1"), F.asc("y1"), F.asc_nulls_first("n"), F.asc_nulls_first("iou")]
    return metrics.precision_recall(found, total, order)


@query("G15_average_precision", X.sql("SELECT round(sum(p)/101, 9) AS ap FROM (SELECT coalesce((SELECT max(precision) FROM curve WHERE recall >= t/100::DOUBLE), 0) AS p FROM (SELECT unnest(generate_series(0, 100)) AS t))", _CURVE, recursive=True))
def g15(spark, d):
    return metrics.average_precision(unknown_curve(spark, d)).agg(F.round(F.sum("interpolated") / 101, 9).alias("ap"))


@query(
    "G16_unknown_summary",
    X.sql(
        f"SELECT true_positives, false_positives, false_negatives, a_ose, round(p, 9) AS u_precision, round(r, 9) AS u_recall, round(2*p*r/greatest(1e-12::DOUBLE, p+r), 9) AS u_f1 FROM (SELECT *, true_positives/greatest(1, true_positives+false_positives)::DOUBLE AS p, true_positives/greatest(1, true_positives+false_negatives)::DOUBLE AS r FROM (SELECT count_if(n IS NOT NULL) AS true_positives, count_if(n IS NULL) AS false_positives, (SELECT count(*) FROM truth) - count_if(n IS NOT NULL) AS false_negatives, (SELECT count(*) FROM truth t WHERE EXISTS (SELECT 1 FROM boxes b WHERE b.image_id = t.image_id AND b.confidence > 0.8 AND {X.iou_sql('b', 't')} >= 0.5::DOUBLE)) AS a_ose FROM matched))",
        UNKNOWN_SQL,
        recursive=True,
    ),
)
def g16(spark, d):
    found = unknown_matches(spark, d)[0].agg(F.count_if(F.col("n").isNotNull()).alias("true_positives"), F.count_if(F.col("n").isNull()).alias("false_positives"))
    t = X.truth(spark, d)
    known = X.boxes(spark, d).where("confidence > 0.8").select(F.col("image_id").alias("image"), *(F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")))
    errors = t.join(known, (F.col("image") == F.col("image_id")) & (G.iou(G.Box.of("b_"), G.Box.of()) >= 0.5), "left_semi").agg(F.count("*").alias("a_ose"))
    one = found.crossJoin(t.agg(F.count("*").alias("truths"))).crossJoin(errors).withColumn("false_negatives", F.col("truths") - F.col("true_positives"))  # one row each
    tp = F.col("true_positives")
    p, r = tp / F.greatest(F.lit(1), tp + F.col("false_positives")), tp / F.greatest(F.lit(1), tp + F.col("false_negatives"))
    return one.select("true_positives", "false_positives", "false_negatives", "a_ose", F.round(p, 9).alias("u_precision"), F.round(r, 9).alias("u_recall"), F.round(2 * p * r / F.greatest(F.lit(1e-12), p + r), 9).alias("u_f1"))


@query("G17_mean_stdev", "SELECT event_type, count(*) AS n, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS stdev FROM events GROUP BY event_type UNION ALL SELECT 'single', count(*), round(avg(value), 9), stddev_samp(value) FROM events WHERE event_id = (SELECT min(event_id) FROM events)")
def g17(spark, d):
    e = X.table(spark, d, "events")
    stats = (F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("mean"), F.round(F.stddev_samp("value"), 9).alias("stdev"))
    first = e.agg(F.min_by("value", "event_id").alias("value"))
    return e.groupBy("event_type").agg(*stats).union(first.groupBy(F.lit("single").alias("event_type")).agg(*stats))


@query("G18_group_completeness", "SELECT event_type AS method, list_sort(list(DISTINCT user_id % 3)) AS seeds, count(DISTINCT user_id % 2) AS fingerprints, list_sort(list(DISTINCT user_id % 3)) = [0,1,2] AND count(DISTINCT user_id % 2) = 1 AS complete FROM events WHERE value > 0.2 GROUP BY event_type")
def g18(spark, d):
    e = X.table(spark, d, "events").where("value > 0.2")
    seeds = F.array_sort(F.collect_set(F.col("user_id") % 3))
    prints = F.count_distinct(F.col("user_id") % 2)
    return e.groupBy(F.col("event_type").alias("method")).agg(seeds.alias("seeds"), prints.alias("fingerprints"), ((seeds == F.array(*(F.lit(k).cast("long") for k in range(3)))) & (prints == 1)).alias("complete"))


@query("G19_mapped_class_ap", X.sql("SELECT class_id, count(*) AS runs, round(avg(confidence), 9) AS mean_ap FROM boxes WHERE image_id % 5 <> class_id GROUP BY class_id"))
def g19(spark, d):
    """Maps of class to value; an absent class is left out of its mean, never 0."""
    maps = X.boxes(spark, d).where("image_id % 5 <> class_id").select(F.create_map("class_id", "confidence").alias("per_class"))
    return maps.select(F.explode("per_class").alias("class_id", "ap")).groupBy("class_id").agg(F.count("*").alias("runs"), F.round(F.avg("ap"), 9).alias("mean_ap"))


@query("G20_status_counts", "SELECT user_id % 10 AS run_group, count(*) AS total, count_if(event_type = 'error') AS failed, count_if(event_type <> 'error') AS complete FROM events GROUP BY 1")
def g20(spark, d):
    return X.table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("run_group")).agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") != "error").alias("complete"))


@query("G21_upper_bound_gate", "SELECT event_type, CASE WHEN max(value) IS NULL THEN 'pending' WHEN max(value) >= 0.85::DOUBLE THEN 'reached' ELSE 'below_upper_bound' END AS status FROM events GROUP BY event_type")
def g21(spark, d):
    best = F.max("value")
    return X.table(spark, d, "events").groupBy("event_type").agg(F.when(best.isNull(), "pending").when(best >= 0.85, "reached").otherwise("below_upper_bound").alias("status"))


@query("G22_latency_summary", "SELECT round(avg(v), 9) AS mean_ms, median(v) AS median_ms, quantile_cont(v, 0.95) AS p95_ms, min(v) AS min_ms, max(v) AS max_ms, round(1000/avg(v), 9) AS fps FROM (SELECT value + 1 AS v FROM events)")
def g22(spark, d):
    v = F.col("v")
    return X.table(spark, d, "events").select((F.col("value") + 1).alias("v")).agg(
        F.round(F.avg(v), 9).alias("mean_ms"), F.percentile(v, 0.5).alias("median_ms"), F.percentile(v, 0.95).alias("p95_ms"), F.min(v).alias("min_ms"), F.max(v).alias("max_ms"), F.round(1000 / F.avg(v), 9).alias("fps")
    )


_CLUSTERED = "c AS (SELECT vec_id % 6 AS cluster, 'c' || CAST(label AS VARCHAR) AS category FROM embeddings)"


def clustered(spark, d):
    return X.table(spark, d, "embeddings").select((F.col("vec_id") % 6).alias("cluster"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"))


@query("G23_contingency", f"WITH {_CLUSTERED} SELECT cluster, category, count(*) AS n FROM c GROUP BY GROUPING SETS ((cluster, category), (cluster), (category))")
def g23(spark, d):
    return metrics.contingency(clustered(spark, d))


@query("G24_purity", f"WITH {_CLUSTERED} SELECT round(sum(m)/(SELECT count(*) FROM c)::DOUBLE, 9) AS purity FROM (SELECT max(n) AS m FROM (SELECT cluster, category, count(*) AS n FROM c GROUP BY ALL) GROUP BY cluster)")
def g24(spark, d):
    return metrics.agreement(clustered(spark, d)).select(F.round("purity", 9).alias("purity"))


_CELLS = f"{_CLUSTERED}, t AS (SELECT count(*)::DOUBLE AS t FROM c), n AS (SELECT cluster, category, count(*)::DOUBLE AS n FROM c GROUP BY ALL), a AS (SELECT cluster, count(*)::DOUBLE AS a FROM c GROUP BY ALL), b AS (SELECT category, count(*)::DOUBLE AS b FROM c GROUP BY ALL)"


@query("G25_nmi", f"WITH {_CELLS} SELECT round((SELECT sum(n/t*ln(n*t/(a*b))) FROM n JOIN a USING (cluster) JOIN b USING (category), t) / sqrt((SELECT sum(-a/t*ln(a/t)) FROM a, t)*(SELECT sum(-b/t*ln(b/t)) FROM b, t)), 9) AS nmi")
def g25(spark, d):
    return metrics.agreement(clustered(spark, d)).select(F.round("nmi", 9).alias("nmi"))


@query("G26_ari", f"WITH {_CELLS} SELECT round((x - pa*pb/p)/((pa+pb)/2 - pa*pb/p), 9) AS ari FROM (SELECT (SELECT sum(n*(n-1)/2) FROM n) AS x, (SELECT sum(a*(a-1)/2) FROM a) AS pa, (SELECT sum(b*(b-1)/2) FROM b) AS pb, (SELECT t*(t-1)/2 FROM t) AS p)")
def g26(spark, d):
    return metrics.agreement(clustered(spark, d)).select(F.round("ari", 9).alias("ari"))


@query("G27_majority_largest", f"WITH {_CLUSTERED} SELECT cluster, max({{'n': n, 'category': category}}).category AS category FROM (SELECT cluster, category, count(*) AS n FROM c GROUP BY ALL) GROUP BY cluster")
def g27(spark, d):
    return metrics.majority(clustered(spark, d))


@query("G28_majority_first", "SELECT cluster, max({'n': n, 'p': -p, 'category': category}).category AS category FROM (SELECT vec_id % 6 AS cluster, label AS category, count(*) AS n, min(vec_id) AS p FROM embeddings GROUP BY ALL) GROUP BY cluster")
def g28(spark, d):
    counts = X.table(spark, d, "embeddings").groupBy((F.col("vec_id") % 6).alias("cluster"), F.col("label").alias("category")).agg(F.count("*").alias("n"), F.min("vec_id").alias("p"))
    return counts.groupBy("cluster").agg(F.max_by("category", F.struct("n", -F.col("p"))).alias("category"))


@query("G29_semantic_accuracy", f"WITH {_CLUSTERED}, m AS (SELECT cluster, max({{'n': n, 'category': category}}).category AS named FROM (SELECT cluster, category, count(*) AS n FROM c GROUP BY ALL) GROUP BY cluster) SELECT round(avg(CASE WHEN named = category THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS accuracy, count(*) AS n FROM c JOIN m USING (cluster)")
def g29(spark, d):
    rows = clustered(spark, d)
    named = metrics.majority(rows).withColumnRenamed("category", "named")
    return rows.join(named, "cluster").agg(F.round(F.avg(F.when(F.col("named") == F.col("category"), 1.0).otherwise(0.0)), 9).alias("accuracy"), F.count("*").alias("n"))


@query("G30_class_counts", X.sql("SELECT image_id, class_id, count(*) AS n FROM boxes GROUP BY ALL"))
def g30(spark, d):
    return X.boxes(spark, d).groupBy("image_id", "class_id").agg(F.count("*").alias("n"))


@query("G31_source_members", "SELECT d.source, d.doc_id, count(*) OVER (PARTITION BY d.source) AS members FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def g31(spark, d):
    """Held-out (labelled) documents by source, with the size of each part; a row a member."""
    held = X.table(spark, d, "documents").select("doc_id", "source").join(X.table(spark, d, "labels").select("doc_id"), "doc_id")
    sizes = held.groupBy("source").agg(F.count("*").alias("members"))
    return held.join(sizes, "source").select("source", "doc_id", "members")


@query("G32_category_counts", "SELECT lang AS category, count(*) AS images, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def g32(spark, d):
    return X.table(spark, d, "documents").groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("images"), F.sum("n_chars").alias("chars"))


@query("G33_content_digest", f"SELECT fingerprint FROM ({digests.fingerprint_sql(['doc_id', 'lang'], 'documents')})")
def g33(spark, d):
    """Digest of a set of rows with their ids."""
    return digests.fingerprint(X.table(spark, d, "documents").select("doc_id", "lang")).select("fingerprint")


@query("G34_feature_mean", "SELECT i AS pos, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY i")
def g34(spark, d):
    return X.table(spark, d, "embeddings").select(F.posexplode("embedding").alias("p", "v")).groupBy((F.col("p") + 1).cast("long").alias("pos")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@query("G35_budget_summary", "SELECT CAST(b AS INT) AS budget, doc_id, count(*) OVER (PARTITION BY b) AS image_count FROM documents, (SELECT unnest([10, 20, 40, 100]) AS b) WHERE doc_id % 100 < b")
def g35(spark, d):
    """Members of every budget with its size; a row a member."""
    member = X.table(spark, d, "documents").select("doc_id", F.explode(F.filter(F.array(*(F.lit(b) for b in (10, 20, 40, 100))), lambda b: F.col("doc_id") % 100 < b)).alias("budget"))
    return member.join(member.groupBy("budget").agg(F.count("*").alias("image_count")), "budget").select("budget", "doc_id", "image_count")


@query("G36_class_presence", X.sql("SELECT image_id, list_sort(list(DISTINCT class_id)) AS presence FROM boxes GROUP BY image_id"))
def g36(spark, d):
    return X.boxes(spark, d).groupBy("image_id").agg(F.array_sort(F.collect_set("class_id")).alias("presence"))


@query("G37_pseudo_records", X.sql("SELECT image_id, list([class_id::DOUBLE, confidence, x1] ORDER BY class_id, confidence, x1) AS labels, round(avg(confidence), 9) AS reliability FROM flips GROUP BY image_id"))
def g37(spark, d):
    return X.flips(spark, d).groupBy("image_id").agg(F.array_sort(F.collect_list(F.array(F.col("class_id").cast("double"), "confidence", "x1"))).alias("labels"), F.round(F.avg("confidence"), 9).alias("reliability"))


@query("G38_source_diagnostics", f"SELECT *, {_F1} FROM (SELECT source, {_SCORES} FROM (SELECT d.source, count_if(l.quality = 1 AND l.toxic = 0) AS tp, count_if(l.quality = 1 AND l.toxic = 1) AS fp, count_if(l.quality = 0) AS fn FROM documents d JOIN labels l USING (doc_id) GROUP BY d.source))")
def g38(spark, d):
    joined = X.table(spark, d, "documents").select("doc_id", "source").join(X.table(spark, d, "labels"), "doc_id")
    good = F.col("quality") == 1
    return metrics.scores(joined.groupBy("source").agg(F.count_if(good & (F.col("toxic") == 0)).alias("tp"), F.count_if(good & (F.col("toxic") == 1)).alias("fp"), F.count_if(F.col("quality") == 0).alias("fn")))


