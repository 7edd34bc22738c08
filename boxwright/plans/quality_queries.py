"""Q: audits, gates, run aggregation and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from boxwright.functions import geometry as G
from boxwright.operators import digests, metrics
from boxwright.plans.aggregate_queries import _DOC_SPLIT, docs
from boxwright.plans.filter_queries import _FINE, _RAW, raw
from boxwright.plans.geometry_queries import _OVERLAP, known_overlap
from boxwright.plans.join_queries import PR_SQL, optimal_sql, overlap_edges, pr_evidence
from boxwright.plans.registry import query
from boxwright.sources import fixtures as X


def T(spark, d, name):
    return X.table(spark, d, name)


_ILLEGAL = f"NOT coalesce({_FINE} AND width > 0 AND xyxy[1] >= 0 AND xyxy[1] < xyxy[3] AND xyxy[3] <= width AND xyxy[2] >= 0 AND xyxy[2] < xyxy[4] AND xyxy[4] <= height, false)"


@query(
    "Q01_dataset_audit",
    X.sql(
        f"SELECT code, count(*) AS n FROM (SELECT 'ILLEGAL_BBOX' AS code FROM raw WHERE split <> 'unlabeled' AND {_ILLEGAL} UNION ALL SELECT 'IMAGE_HASH_UNAVAILABLE' FROM (SELECT DISTINCT image_id FROM raw WHERE file_path = '') UNION ALL SELECT 'EMPTY_SPLIT' FROM (SELECT unnest(['train_pool','validation','test','pseudo_audit']) AS s) WHERE s NOT IN (SELECT split FROM raw) UNION ALL SELECT 'MISSING_CLASS' FROM (SELECT DISTINCT split FROM raw) p, (SELECT unnest(generate_series(0, 5))::INT AS k) WHERE NOT EXISTS (SELECT 1 FROM raw r WHERE r.split = p.split AND r.class_id = k) UNION ALL SELECT 'DUPLICATE_HASH_CROSS_SPLIT' FROM (SELECT file_path FROM raw WHERE file_path <> '' GROUP BY file_path HAVING count(DISTINCT split) > 1)) GROUP BY code",
        _RAW,
    ),
)
def q01(spark, d):
    """Every finding of a dataset audit as one union, counted by code."""
    rows = raw(spark, d)
    at = lambda k: F.get("xyxy", F.lit(k))
    legal = G.finite(F.col("xyxy")) & (F.col("width") > 0) & (at(0) >= 0) & (at(0) < at(2)) & (at(2) <= F.col("width")) & (at(1) >= 0) & (at(1) < at(3)) & (at(3) <= F.col("height"))
    code = lambda df, c: df.select(F.lit(c).alias("code"))
    wanted = spark.createDataFrame([(s,) for s in ("train_pool", "validation", "test", "pseudo_audit")], "split string")
    present = rows.select("split", "class_id").distinct()
    grid = present.select("split").distinct().crossJoin(F.broadcast(spark.range(6).select(F.col("id").cast("int").alias("class_id"))))  # splits x classes
    findings = [
        code(rows.where((F.col("split") != "unlabeled") & ~F.coalesce(legal, F.lit(False))), "ILLEGAL_BBOX"),
        code(rows.where("file_path = ''").select("image_id").distinct(), "IMAGE_HASH_UNAVAILABLE"),
        code(wanted.join(present.select("split").distinct(), "split", "left_anti"), "EMPTY_SPLIT"),
        code(grid.join(present, ["split", "class_id"], "left_anti"), "MISSING_CLASS"),
        code(rows.where("file_path <> ''").groupBy("file_path").agg(F.count_distinct("split").alias("s")).where("s > 1"), "DUPLICATE_HASH_CROSS_SPLIT"),
    ]
    out = findings[0]
    for f in findings[1:]:
        out = out.union(f)
    return out.groupBy("code").agg(F.count("*").alias("n"))


_KEPT = "SELECT doc_id, lang, sha256(text) AS digest FROM documents"
_COPIES = f"(SELECT 'same' AS copy, * FROM ({_KEPT}) UNION ALL SELECT 'changed', doc_id, CASE WHEN doc_id = 7 THEN 'xx' ELSE lang END, digest FROM ({_KEPT}) UNION ALL SELECT 'doubled', * FROM ({_KEPT}) UNION ALL SELECT 'doubled', k.* FROM ({_KEPT}) k, range(2) WHERE doc_id = 7)"
_SEALED = digests.fingerprint_sql(["doc_id", "lang", "digest"], f"({_KEPT})")


@query("Q02_sealed_artifact", f"SELECT copy, c.rows, c.fingerprint = s.fingerprint AS intact FROM ({digests.fingerprint_sql(['doc_id', 'lang', 'digest'], _COPIES, 'copy,')}) c, ({_SEALED}) s")
def q02(spark, d):
    """Copies of a table against its seal: one as it was, one with a value changed, one with a row twice more."""
    rows = T(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("digest"))
    changed = rows.withColumn("lang", F.when(F.col("doc_id") == 7, "xx").otherwise(F.col("lang")))
    one = rows.where("doc_id = 7")
    copies = rows.select(F.lit("same").alias("copy"), "*")
    for name, copy in (("changed", changed), ("doubled", rows.union(one).union(one))):
        copies = copies.union(copy.select(F.lit(name), "*"))
    seal = digests.fingerprint(rows).select(F.col("fingerprint").alias("seal"))
    return digests.fingerprint(copies, "copy").crossJoin(F.broadcast(seal)).select("copy", "rows", (F.col("fingerprint") == F.col("seal")).alias("intact"))  # one row


@query("Q03_membership_unique", f"SELECT sha256(text) AS image, count(DISTINCT {_DOC_SPLIT}) AS splits FROM documents GROUP BY 1 HAVING count(DISTINCT {_DOC_SPLIT}) > 1")
def q03(spark, d):
    return docs(spark, d).groupBy(F.sha2("text", 256).alias("image")).agg(F.count_distinct("split").alias("splits")).where("splits > 1")


@query("Q04_budget_eligibility", f"SELECT budget, list(doc_id ORDER BY doc_id) FILTER (split = 'train_pool') AS eligible, count_if(split <> 'train_pool') AS excluded FROM (SELECT doc_id % 3 AS budget, doc_id, {_DOC_SPLIT} AS split FROM documents) GROUP BY budget")
def q04(spark, d):
    """Each budget's eligible members in order, and how many are excluded."""
    rows = docs(spark, d).withColumn("budget", F.col("doc_id") % 3)
    own = F.col("split") == "train_pool"
    return rows.groupBy("budget").agg(F.sort_array(F.collect_list(F.when(own, F.col("doc_id")))).alias("eligible"), F.count_if(~own).alias("excluded"))


_GATE = "SELECT *, best >= 0.8::DOUBLE AS threshold_pass, best - base + 1e-12::DOUBLE >= 0.03::DOUBLE AS improvement_pass, best >= 0.8::DOUBLE AND best - base + 1e-12::DOUBLE >= 0.03::DOUBLE AS passed FROM (SELECT event_type, round(max(value), 9) AS best, round(avg(value), 9) AS base FROM events GROUP BY event_type)"


@query("Q05_acceptance_gate", _GATE)
def q05(spark, d):
    """The slack is on the improvement only."""
    rows = T(spark, d, "events").groupBy("event_type").agg(F.round(F.max("value"), 9).alias("best"), F.round(F.avg("value"), 9).alias("base"))
    good, better = F.col("best") >= 0.8, F.col("best") - F.col("base") + F.lit(1e-12) >= 0.03
    return rows.select("*", good.alias("threshold_pass"), better.alias("improvement_pass"), (good & better).alias("passed"))


@query("Q06_refresh_gate", X.sql("SELECT class_id, CASE WHEN count(*) > 0 THEN count_if(is_true_positive)/count(*)::DOUBLE ELSE 0 END >= 0.9::DOUBLE AS refresh FROM pr GROUP BY class_id", PR_SQL, recursive=True))
def q06(spark, d):
    hit = F.count_if(F.col("n").isNotNull())
    return pr_evidence(spark, d).groupBy("class_id").agg((metrics.guarded(hit.cast("double"), F.count("*").cast("double")) >= 0.9).alias("refresh"))


@query("Q07_comparability", "SELECT event_type, count(DISTINCT user_id % 2) = 1 AS one_split, count(DISTINCT event_id % 1) = 1 AS one_membership FROM events GROUP BY event_type")
def q07(spark, d):
    return T(spark, d, "events").groupBy("event_type").agg((F.count_distinct(F.col("user_id") % 2) == 1).alias("one_split"), (F.count_distinct(F.col("event_id") % 1) == 1).alias("one_membership"))


_RUNS = "runs AS (SELECT user_id, round(min(value), 9) AS least, round(max(value), 9) AS map50, round(avg(value), 9) AS recall FROM events GROUP BY user_id)"


def runs(spark, d):
    return T(spark, d, "events").groupBy("user_id").agg(F.round(F.min("value"), 9).alias("least"), F.round(F.max("value"), 9).alias("map50"), F.round(F.avg("value"), 9).alias("recall"))


@query("Q08_candidate_selection", f"WITH {_RUNS} SELECT user_id AS selected, least >= 0.05::DOUBLE AS floor_pass FROM runs ORDER BY least >= 0.05::DOUBLE DESC, map50 DESC, recall DESC, user_id LIMIT 1")
def q08(spark, d):
    """Candidates over the floor first, then by score, recall and id."""
    rows = runs(spark, d).withColumn("floor_pass", F.col("least") >= 0.05)
    return rows.orderBy(F.desc("floor_pass"), F.desc("map50"), F.desc("recall"), "user_id").limit(1).select(F.col("user_id").alias("selected"), "floor_pass")


_ISSUES = "list_filter([CASE WHEN value < 0.1::DOUBLE THEN 'low_value' END, CASE WHEN event_type = 'error' THEN 'failed' END, CASE WHEN user_id % 9 = 0 THEN 'missing_metrics' END], lambda x: x IS NOT NULL)"


def issues():
    return F.array_compact(F.array(F.when(F.col("value") < 0.1, "low_value"), F.when(F.col("event_type") == "error", "failed"), F.when(F.col("user_id") % 9 == 0, "missing_metrics")))


@query("Q09_run_aggregation", f"SELECT event_id, {_ISSUES} AS issues FROM events")
def q09(spark, d):
    return T(spark, d, "events").select("event_id", issues().alias("issues"))


@query("Q10_matrix_aggregation", "SELECT user_id % 40 AS method, CAST(count(*) AS BIGINT) AS runs, count_if(n > 1) AS invalid FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) GROUP BY 1")
def q10(spark, d):
    """Runs that share an identity invalidate each other."""
    same = F.count("*").over(Window.partitionBy("user_id", "event_type"))
    rows = T(spark, d, "events").select("user_id", same.alias("n"))
    return rows.groupBy((F.col("user_id") % 40).alias("method")).agg(F.count("*").alias("runs"), F.count_if(F.col("n") > 1).alias("invalid"))


@query("Q11_protocol_issues", f"SELECT event_id, len({_ISSUES}) AS n_issues, array_to_string({_ISSUES}, ';') AS issues FROM events")
def q11(spark, d):
    return T(spark, d, "events").select("event_id", F.size(issues()).cast("long").alias("n_issues"), F.array_join(issues(), ";").alias("issues"))


@query("Q12_resume_eligibility", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'run' WHEN l.quality = 0 THEN 'rerun' WHEN l.toxic = 1 THEN 'fingerprint_mismatch' ELSE 'skip' END AS action FROM documents d LEFT JOIN labels l USING (doc_id)")
def q12(spark, d):
    ledger = T(spark, d, "labels").withColumn("seen", F.lit(True))
    action = F.when(F.col("seen").isNull(), "run").when(F.col("quality") == 0, "rerun").when(F.col("toxic") == 1, "fingerprint_mismatch").otherwise("skip")
    return T(spark, d, "documents").select("doc_id").join(ledger, "doc_id", "left").select("doc_id", action.alias("action"))


@query("Q15_snapshot_audit", "SELECT count(*) AS images, count(DISTINCT sha256(d.text)) AS distinct_images, count(l.doc_id) AS labelled, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def q15(spark, d):
    joined = T(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h")).join(T(spark, d, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "left")
    return joined.agg(F.count("*").alias("images"), F.count_distinct("h").alias("distinct_images"), F.count("l").alias("labelled"), (F.count("*") - F.count("l")).alias("missing"))


@query("Q16_augmentation_audit", "SELECT source, count(*) AS added, count(l.doc_id) AS protected, count(l.doc_id) = 0 AS passed FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = d.doc_id GROUP BY source")
def q16(spark, d):
    """What each source would add, and how much of it is protected."""
    guarded = T(spark, d, "labels").where("quality = 1").select("doc_id", F.lit(1).alias("hit"))
    rows = T(spark, d, "documents").select("doc_id", "source").join(guarded, "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("added"), F.count("hit").alias("protected"), (F.count("hit") == 0).alias("passed"))


@query("Q17_report_tables", "SELECT event_type, CAST(u AS INT) AS seed, round(avg(value), 9) AS mean_value FROM (SELECT event_type, user_id % 3 AS u, value FROM events) GROUP BY ALL")
def q17(spark, d):
    """Wide per-seed columns turned back to rows."""
    wide = T(spark, d, "events").withColumn("u", F.col("user_id") % 3).groupBy("event_type").pivot("u", [0, 1, 2]).agg(F.round(F.avg("value"), 9))
    return wide.unpivot("event_type", ["0", "1", "2"], "seed", "mean_value").select("event_type", F.col("seed").cast("int").alias("seed"), "mean_value")


@query("Q18_report_consistency", "SELECT d.source, sum(d.n_chars) = sum(length(d.text)) AS chars_agree, count(l.doc_id) AS labelled FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def q18(spark, d):
    rows = T(spark, d, "documents").select("doc_id", "source", "n_chars", F.length("text").alias("own")).join(T(spark, d, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "left")
    return rows.groupBy("source").agg((F.sum("n_chars") == F.sum("own")).alias("chars_agree"), F.count("l").alias("labelled"))


@query("Q21_candidate_views", X.sql("SELECT image_id, count(*) AS candidates, count(DISTINCT view) AS views FROM (SELECT image_id, view FROM boxes UNION ALL SELECT image_id, 'horizontal_flip' FROM boxes) GROUP BY image_id"))
def q21(spark, d):
    views = X.boxes(spark, d).select("image_id", F.explode(F.array(F.lit("original"), F.lit("horizontal_flip"))).alias("view"))
    return views.groupBy("image_id").agg(F.count("*").alias("candidates"), F.count_distinct("view").alias("views"))


@query("Q22_audit_candidates", X.sql("SELECT image_id, class_id, count(*) AS n FROM boxes WHERE image_id % 4 = 2 GROUP BY ALL"))
def q22(spark, d):
    return X.boxes(spark, d).where("image_id % 4 = 2").groupBy("image_id", "class_id").agg(F.count("*").alias("n"))


@query("Q23_known_and_unknown", X.sql("SELECT image_id, 'known' AS kind, CAST(class_id AS VARCHAR) AS label, confidence AS score FROM boxes WHERE confidence > 0.7 UNION ALL SELECT o.image_id, 'unknown', coalesce('cluster-' || CAST(e.label AS VARCHAR), 'unknown'), o.confidence*(1-o.known_iou) FROM o LEFT JOIN embeddings e ON e.vec_id = o.image_id WHERE o.known_iou < 0.35::DOUBLE", f"o AS ({_OVERLAP})"))
def q23(spark, d):
    known = X.boxes(spark, d).where("confidence > 0.7").select("image_id", F.lit("known").alias("kind"), F.col("class_id").cast("string").alias("label"), F.col("confidence").alias("score"))
    clusters = T(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.concat(F.lit("cluster-"), F.col("label").cast("string")).alias("name"))
    fresh = known_overlap(spark, d).where("known_iou < 0.35").join(clusters, "image_id", "left")
    return known.union(fresh.select("image_id", F.lit("unknown"), F.coalesce("name", F.lit("unknown")), F.col("confidence") * (1 - F.col("known_iou"))))


@query("Q24_box_protocol", X.sql("SELECT image_id, 'public' AS part, NULL::INT AS class_id, x1 FROM truth WHERE image_id % 2 = 0 UNION ALL SELECT image_id, 'protected', class_id, x1 FROM truth WHERE image_id % 2 = 1"))
def q24(spark, d):
    t = X.truth(spark, d)
    public = t.where("image_id % 2 = 0").select("image_id", F.lit("public").alias("part"), F.lit(None).cast("int").alias("class_id"), "x1")
    return public.union(t.where("image_id % 2 = 1").select("image_id", F.lit("protected"), "class_id", "x1"))


@query("Q25_matrix_validation", "SELECT event_type AS role, count(DISTINCT user_id % 2) = 1 AS same_split, bool_and(value >= 0) AS values_valid, min(event_id) AS teacher FROM events GROUP BY event_type")
def q25(spark, d):
    return T(spark, d, "events").groupBy(F.col("event_type").alias("role")).agg((F.count_distinct(F.col("user_id") % 2) == 1).alias("same_split"), F.every(F.col("value") >= 0).alias("values_valid"), F.min("event_id").alias("teacher"))


_CHAIN = {"documents": ["doc_id", "text", "lang", "source", "n_chars"], "labels": ["doc_id", "quality", "toxic"], "pages": ["page_id", "url", "html"], "benchmark": ["item_id", "text"]}
_OWN = " UNION ALL ".join(f"SELECT {k} AS step, '{name}' AS artifact, fingerprint FROM ({digests.fingerprint_sql(columns, name)})" for k, (name, columns) in enumerate(_CHAIN.items()))


@query("Q26_artifact_chain", f"SELECT step, artifact, sha256(string_agg(fingerprint, '') OVER (ORDER BY step)) AS sealed FROM ({_OWN})")
def q26(spark, d):
    """Digests of four tables, each bound to those before."""
    out = None
    for k, (name, columns) in enumerate(_CHAIN.items()):
        own = digests.fingerprint(T(spark, d, name).select(*columns)).select(F.lit(k).alias("step"), F.lit(name).alias("artifact"), "fingerprint")
        out = own if out is None else out.union(own)
    # four rows
    chain = F.array_join(F.collect_list("fingerprint").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)), "")
    return out.select("step", "artifact", F.sha2(chain, 256).alias("sealed"))


@query("Q28_evidence_validation", "SELECT event_id, CASE WHEN props IS NULL OR NOT json_valid(props) THEN 'unreadable' WHEN value < 0 OR value > 100 THEN 'out_of_range' WHEN event_type = 'error' THEN 'failed' END AS issue FROM events")
def q28(spark, d):
    parsed = F.try_parse_json("props")
    issue = F.when(parsed.isNull(), "unreadable").when(~F.col("value").between(0, 100), "out_of_range").when(F.col("event_type") == "error", "failed")
    return T(spark, d, "events").select("event_id", issue.alias("issue"))


@query("Q29_metric_normalisation", X.sql("SELECT image_id, count(*) AS classes, round(avg(ap), 9) AS map50, bool_and(ap BETWEEN 0 AND 1) AS valid FROM (SELECT image_id, class_id, max(confidence) AS ap FROM boxes GROUP BY ALL) GROUP BY image_id"))
def q29(spark, d):
    per_class = X.boxes(spark, d).groupBy("image_id", "class_id").agg(F.max("confidence").alias("ap"))
    return per_class.groupBy("image_id").agg(F.count("*").alias("classes"), F.round(F.avg("ap"), 9).alias("map50"), F.every(F.col("ap").between(0, 1)).alias("valid"))


@query(
    "Q30_example_sets",
    X.sql(
        "SELECT image_id, class_id, kept, predicted - kept AS false_positives, labelled - kept AS missed FROM (SELECT image_id, class_id, coalesce(p.n, 0) AS predicted, coalesce(l.n, 0) AS labelled, coalesce(len(pairs), 0) AS kept FROM (SELECT image_id, class_id, count(*) AS n FROM boxes GROUP BY ALL) p FULL JOIN (SELECT image_id, class_id, count(*) AS n FROM truth GROUP BY ALL) l USING (image_id, class_id) LEFT JOIN best USING (image_id, class_id))",
        optimal_sql("truth", 0.5),
        recursive=True,
    ),
)
def q30(spark, d):
    """Kept, false positive and missed boxes of an optimal matching."""
    from boxwright.operators import matching

    keys = ["image_id", "class_id"]
    made, truth = X.boxes(spark, d), X.truth(spark, d)
    pairs = matching.optimal_match(overlap_edges(made, truth, keys, 0.5), keys)
    count = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    joined = count(made, "predicted").join(count(truth, "labelled"), keys, "full").join(count(pairs, "kept"), keys, "left").na.fill(0)
    return joined.select(*keys, "kept", (F.col("predicted") - F.col("kept")).alias("false_positives"), (F.col("labelled") - F.col("kept")).alias("missed"))


@query("Q31_run_eligibility", "SELECT event_id // 5 AS run FROM events GROUP BY 1 HAVING count_if(event_type = 'error') = 0 AND count_if(user_id % 10 = 0) = 0")
def q31(spark, d):
    """Complete runs that never saw the fixed test."""
    e = T(spark, d, "events").withColumn("run", F.expr("event_id DIV 5"))
    complete = e.groupBy("run").agg(F.count_if(F.col("event_type") == "error").alias("failed")).where("failed = 0").select("run")
    return complete.join(e.where("user_id % 10 = 0").select("run"), "run", "left_anti")


@query("Q32_report_summaries", "SELECT 'documents' AS section, count(*) AS items, CAST(sum(n_chars) AS DOUBLE) AS total FROM documents UNION ALL SELECT 'events', count(*), round(sum(value), 6) FROM events UNION ALL SELECT 'labels', count(*), CAST(sum(quality) AS DOUBLE) FROM labels")
def q32(spark, d):
    part = lambda name, total: T(spark, d, name).agg(F.count("*").alias("items"), total.alias("total")).select(F.lit(name).alias("section"), "items", "total")
    return part("documents", F.sum("n_chars").cast("double")).union(part("events", F.round(F.sum("value"), 6))).union(part("labels", F.sum("quality").cast("double")))
