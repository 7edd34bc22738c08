"""F: filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxwright.functions import geometry as G
from boxwright.operators import cleaning as C
from boxwright.plans.geometry_queries import _OVERLAP, known_overlap
from boxwright.plans.registry import query
from boxwright.sources import fixtures as X

#: Raw annotations with every kind of fault, from the detections.
_RAW = """raw AS (SELECT *, CASE WHEN part % 97 = 0 THEN '' ELSE 'img/' || CAST(image_id AS VARCHAR) || '.jpg' END AS file_path,
CASE WHEN part % 89 = 0 THEN 0 ELSE 800 END AS width, 600 AS height, CASE WHEN part % 83 = 0 THEN [x1, y1, x2] WHEN part % 79 = 0 THEN [x1, y1, x2, 'NaN'::DOUBLE] WHEN part % 73 = 0 THEN [x2, y1, x1, y2] ELSE [x1 - 100, y1, x2 - 100, y2] END AS xyxy,
CASE WHEN supp % 3 = 0 THEN 'train_pool' WHEN supp % 3 = 1 THEN 'unlabeled' ELSE 'test' END AS split, CASE WHEN part % 2 = 0 THEN 'labeled' ELSE 'unlabeled' END AS label_status FROM base)"""


def raw(spark, d):
    b = X._detections(spark, d)
    nan = F.lit(float("nan"))
    p = F.col("part")
    box = F.when(p % 83 == 0, F.array("x1", "y1", "x2")).when(p % 79 == 0, F.array(F.col("x1"), F.col("y1"), F.col("x2"), nan)).when(p % 73 == 0, F.array("x2", "y1", "x1", "y2")).otherwise(F.array(F.col("x1") - 100, F.col("y1"), F.col("x2") - 100, F.col("y2")))
    return b.select(
        "image_id", "class_id", "confidence", "part", "supp",
        F.when(p % 97 == 0, "").otherwise(F.concat(F.lit("img/"), F.col("image_id").cast("string"), F.lit(".jpg"))).alias("file_path"),
        F.when(p % 89 == 0, 0).otherwise(800).alias("width"), F.lit(600).alias("height"), box.alias("xyxy"),
        F.when(F.col("supp") % 3 == 0, "train_pool").when(F.col("supp") % 3 == 1, "unlabeled").otherwise("test").alias("split"),
        F.when(p % 2 == 0, "labeled").otherwise("unlabeled").alias("label_status"),
    )


_FINE = "coalesce(len(xyxy) = 4 AND len(list_filter(xyxy, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0, false)"
_EDGE = "least({m}::DOUBLE, greatest(0.0::DOUBLE, xyxy[{k}]))"
_LEGAL = "((split IN ('train_pool','test') AND label_status = 'labeled') OR (split = 'unlabeled' AND label_status = 'unlabeled'))"
_CHECKED = f"""checked AS (SELECT *, CASE WHEN trim(file_path) = '' THEN 'ANNOTATION_SCHEMA_INVALID' WHEN width <= 0 OR height <= 0 THEN 'IMAGE_UNDECODABLE' WHEN NOT {_FINE} THEN 'BOX_NON_FINITE'
WHEN c3 <= c1 OR c4 <= c2 THEN 'BOX_NON_POSITIVE_AREA' WHEN NOT {_LEGAL} THEN 'ANNOTATION_SCHEMA_INVALID' END AS reason_code FROM (SELECT *, {_EDGE.format(m='width', k=1)} c1, {_EDGE.format(m='height', k=2)} c2, {_EDGE.format(m='width', k=3)} c3, {_EDGE.format(m='height', k=4)} c4 FROM raw))"""


@query("F01_validate_canonical", X.sql("SELECT image_id, part, supp, reason_code FROM checked WHERE reason_code IS NOT NULL", f"{_RAW}, {_CHECKED}"))
def f01(spark, d):
    return C.with_reason(raw(spark, d)).where("reason_code IS NOT NULL").select("image_id", "part", "supp", "reason_code")


@query("F02_clean_quarantine", X.sql("SELECT image_id, class_id, [c1, c2, c3, c4] AS xyxy, 'accepted' AS decision FROM checked WHERE reason_code IS NULL UNION ALL SELECT image_id, class_id, NULL, CASE WHEN reason_code LIKE 'IMAGE%' THEN 'image:' ELSE 'annotation:' END || reason_code FROM checked WHERE reason_code IS NOT NULL", f"{_RAW}, {_CHECKED}"))
def f02(spark, d):
    checked = C.with_reason(raw(spark, d))
    good = C.accepted(checked).select("image_id", "class_id", "xyxy", F.lit("accepted").alias("decision"))
    bad = C.quarantined(checked).select("image_id", "class_id", F.lit(None).cast("array<double>").alias("xyxy"), F.concat_ws(":", "scope", "reason_code").alias("decision"))
    return good.unionByName(bad)


@query("F03_finite_box", X.sql(f"SELECT image_id, part, {_FINE} AS finite FROM raw", _RAW))
def f03(spark, d):
    return raw(spark, d).select("image_id", "part", G.finite(F.col("xyxy")).alias("finite"))


_FLAG = "CASE part % 7 WHEN 0 THEN '1' WHEN 1 THEN ' True' WHEN 2 THEN 'TRUE' WHEN 3 THEN 't' WHEN 4 THEN 'yes ' WHEN 5 THEN '0' ELSE '' END"


def flagged(spark, d):
    p = F.col("part") % 7
    flag = F.when(p == 0, "1").when(p == 1, " True").when(p == 2, "TRUE").when(p == 3, "t").when(p == 4, "yes ").when(p == 5, "0").otherwise("")
    return X._detections(spark, d).select("image_id", "part", flag.alias("flag"))


@query("F05_flag_exclusion_a", X.sql(f"SELECT image_id, part FROM base WHERE lower(trim({_FLAG})) NOT IN ('1','true','t','yes')"))
def f05(spark, d):
    return flagged(spark, d).where(~F.lower(F.trim("flag")).isin("1", "true", "t", "yes")).select("image_id", "part")


@query("F06_flag_exclusion_b", X.sql(f"SELECT image_id, part FROM base WHERE trim({_FLAG}) NOT IN ('1','true','True')"))
def f06(spark, d):
    return flagged(spark, d).where(~F.trim("flag").isin("1", "true", "True")).select("image_id", "part")


@query("F07_legal_box", X.sql(f"SELECT image_id, part, coalesce({_FINE} AND width > 0 AND xyxy[1] >= 0 AND xyxy[1] < xyxy[3] AND xyxy[3] <= width AND xyxy[2] >= 0 AND xyxy[2] < xyxy[4] AND xyxy[4] <= height, false) AS legal FROM raw", _RAW))
def f07(spark, d):
    at = lambda k: F.get("xyxy", F.lit(k))
    legal = G.finite(F.col("xyxy")) & (F.col("width") > 0) & (at(0) >= 0) & (at(0) < at(2)) & (at(2) <= F.col("width")) & (at(1) >= 0) & (at(1) < at(3)) & (at(3) <= F.col("height"))
    return raw(spark, d).select("image_id", "part", F.coalesce(legal, F.lit(False)).alias("legal"))


_COORD = "SELECT image_id, view, x1, CASE WHEN view = 'original' AND r1 = x1 AND r2 = x2 THEN NULL WHEN view = 'horizontal_flip' AND 800 - r2 = x1 AND 800 - r1 = x2 THEN NULL ELSE 'coordinate_provenance_mismatch' END AS reason FROM (SELECT image_id, view, x1, x2, CASE WHEN view = 'original' THEN x1 ELSE 800 - x2 END + CASE WHEN image_id % 10 = 0 THEN 1 ELSE 0 END AS r1, CASE WHEN view = 'original' THEN x2 ELSE 800 - x1 END AS r2 FROM (SELECT * FROM boxes UNION ALL SELECT * FROM flips))"


def coordinate_reason(box, raw_box, original):
    """Whether a box is its raw one, mirrored back if that is of the mirrored view."""
    back = G.flip_horizontal(raw_box, F.lit(X.WIDTH))
    same = lambda a: (a.x1 == box.x1) & (a.y1 == box.y1) & (a.x2 == box.x2) & (a.y2 == box.y2)
    return F.when(~F.when(original, same(raw_box)).otherwise(same(back)), "coordinate_provenance_mismatch")


@query("F08_coordinate_provenance", X.sql(_COORD))
def f08(spark, d):
    both = X.boxes(spark, d).unionByName(X.flips(spark, d))
    b, original = G.Box.of(), F.col("view") == "original"
    mirrored = G.flip_horizontal(b, F.lit(X.WIDTH))
    made = both.select("image_id", "view", *b.columns(), (F.when(original, b.x1).otherwise(mirrored.x1) + F.when(F.col("image_id") % 10 == 0, 1).otherwise(0)).alias("r_x1"), b.y1.alias("r_y1"), F.when(original, b.x2).otherwise(mirrored.x2).alias("r_x2"), b.y2.alias("r_y2"))
    return made.select("image_id", "view", "x1", coordinate_reason(b, G.Box.of("r_"), original).alias("reason"))


_GEOMETRY = """CASE WHEN x1 < 0 OR y1 < 0 OR x2 > 800 OR y2 > 600 THEN 'box_out_of_bounds' WHEN (x2-x1)*640/800 < 16 OR (y2-y1)*640/600 < 16 THEN 'too_small_at_640'
WHEN (x2-x1)*(y2-y1)/(800*600) > 0.28::DOUBLE THEN 'area_too_large' WHEN (x2-x1)/(y2-y1) < 0.1::DOUBLE OR (x2-x1)/(y2-y1) > 10 THEN 'aspect_ratio_outside_global_bounds'
WHEN (x2-x1)/(y2-y1) < 0.3::DOUBLE OR (x2-x1)/(y2-y1) > 2.6::DOUBLE THEN 'aspect_ratio_outside_labeled_distribution' END"""
_THRESHOLD = "(CASE class_id WHEN 0 THEN 0.55 WHEN 1 THEN 0.85 WHEN 2 THEN 0.85 ELSE 0.5 END)::DOUBLE"
_GLOBAL = "CASE WHEN confidence < 0.5::DOUBLE THEN 'below_global_confidence' END"
_REASON = f"CASE WHEN confidence < 0.5::DOUBLE THEN 'below_global_confidence' WHEN confidence < {_THRESHOLD} THEN 'below_class_threshold' ELSE {_GEOMETRY} END"


def shape_reason():
    low, high = (C.by_class(F.col("class_id"), [b[k] for b in X.CLASS_BOUNDS]) for k in (0, 1))
    return C.geometry_reason(G.Box.of(), X.WIDTH, X.HEIGHT, low, high, most_area=0.28)


def eligibility(by_class: bool = True, shapes: bool = True):
    """The ordered reason of a candidate: confidence gates, then shape. Class thresholds and shape can be left out."""
    reason = F.when(F.col("confidence") < 0.5, "below_global_confidence")
    if by_class:
        reason = reason.when(F.col("confidence") < C.by_class(F.col("class_id"), X.CLASS_THRESHOLDS), "below_class_threshold")
    return reason.otherwise(shape_reason()) if shapes else reason


@query("F09_geometry_reason", X.sql(f"SELECT image_id, x1, x2, y1, {_GEOMETRY} AS reason FROM boxes"))
def f09(spark, d):
    return X.boxes(spark, d).select("image_id", "x1", "x2", "y1", shape_reason().alias("reason"))


@query("F10_global_confidence", X.sql("SELECT image_id, confidence FROM boxes WHERE NOT confidence < 0.5::DOUBLE"))
def f10(spark, d):
    return X.boxes(spark, d).where("NOT confidence < 0.5D").select("image_id", "confidence")


@query("F11_class_threshold", X.sql(f"SELECT image_id, class_id, confidence FROM boxes WHERE NOT confidence < {_THRESHOLD}"))
def f11(spark, d):
    table = spark.createDataFrame(list(enumerate(X.CLASS_THRESHOLDS)), "class_id int, least double")  # a row a class
    return X.boxes(spark, d).join(F.broadcast(table), "class_id").where("NOT confidence < least").select("image_id", "class_id", "confidence")


@query("F12_combined_bounds", X.sql("SELECT class_id, greatest(0.1::DOUBLE, min((x2 - x1) / (y2 - y1))) AS lower, least(10.0::DOUBLE, max((x2 - x1) / (y2 - y1))) AS upper FROM truth GROUP BY class_id"))
def f12(spark, d):
    """The ratios that a class's labelled boxes have, within the global bounds."""
    ratio = (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    seen = X.truth(spark, d).groupBy("class_id").agg(F.min(ratio).alias("lo"), F.max(ratio).alias("hi"))
    return seen.select("class_id", F.greatest(F.lit(0.1), "lo").alias("lower"), F.least(F.lit(10.0), "hi").alias("upper"))


@query("F13_degenerate_drop", X.sql("SELECT image_id, x1 FROM (SELECT image_id, x1, x2 - 60 AS x2, y1, y2 - 60 AS y2 FROM boxes) WHERE NOT (x1 >= x2 OR y1 >= y2)"))
def f13(spark, d):
    shrunk = X.boxes(spark, d).withColumns({"x2": F.col("x2") - 60, "y2": F.col("y2") - 60})
    return shrunk.where("NOT (x1 >= x2 OR y1 >= y2)").select("image_id", "x1")


@query("F14_detection_contract", X.sql("SELECT image_id, class_id, confidence BETWEEN 0 AND 1 AND x2 > x1 AND y2 > y1 AND class_id BETWEEN 0 AND 4 AND x1 >= 0 AND x2 <= 800 AS valid FROM boxes"))
def f14(spark, d):
    return X.boxes(spark, d).select("image_id", "class_id", F.expr("confidence BETWEEN 0 AND 1 AND x2 > x1 AND y2 > y1 AND class_id BETWEEN 0 AND 4 AND x1 >= 0 AND x2 <= 800").alias("valid"))


@query("F15_area_and_known_iou", X.sql("SELECT image_id, confidence, x1 FROM o WHERE (x2-x1)*(y2-y1) >= 6400 AND known_iou < 0.35::DOUBLE", f"o AS ({_OVERLAP})"))
def f15(spark, d):
    return known_overlap(spark, d).where((G.Box.of().area >= 6400) & (F.col("known_iou") < 0.35)).select("image_id", "confidence", "x1")


@query("F16_unlabeled_suppression", X.sql("SELECT image_id, part, CASE WHEN split <> 'unlabeled' THEN class_id END AS class_id, CASE WHEN split <> 'unlabeled' THEN label_status ELSE 'unlabeled' END AS label_status FROM raw", _RAW))
def f16(spark, d):
    labelled = F.col("split") != "unlabeled"
    return raw(spark, d).select("image_id", "part", F.when(labelled, F.col("class_id")).alias("class_id"), F.when(labelled, F.col("label_status")).otherwise("unlabeled").alias("label_status"))


@query("F17_small_object", X.sql("SELECT image_id, x1, x2 FROM boxes WHERE (x2-x1)*(y2-y1)/(CAST(800 AS DOUBLE)*600) < 0.02::DOUBLE"))
def f17(spark, d):
    return X.boxes(spark, d).where(G.Box.of().area / F.lit(480000.0) < 0.02).select("image_id", "x1", "x2")


@query("F18_novelty_threshold", X.sql("SELECT class_id, count(*) AS n, count_if(confidence >= 0.5::DOUBLE) AS candidates, count_if(confidence >= 0.5::DOUBLE) / count(*)::DOUBLE AS rate FROM flips GROUP BY class_id"))
def f18(spark, d):
    hit = F.count_if(F.col("confidence") >= 0.5)
    return X.flips(spark, d).groupBy("class_id").agg(F.count("*").alias("n"), hit.alias("candidates"), (hit / F.count("*")).alias("rate"))


_PATH = "CASE doc_id % 5 WHEN 0 THEN '/abs/' WHEN 1 THEN 'a/../' WHEN 2 THEN 'C:\\x\\' WHEN 3 THEN '' ELSE 'ok/..b/' END || lang || '.jpg'"


@query("F19_path_safety", f"SELECT doc_id, NOT (p LIKE '/%' OR regexp_matches(p, '^[A-Za-z]:') OR regexp_matches(p, '(^|[/\\\\])\\.\\.([/\\\\]|$)')) AS safe FROM (SELECT doc_id, {_PATH} AS p FROM documents)")
def f19(spark, d):
    k = F.col("doc_id") % 5
    start = F.when(k == 0, "/abs/").when(k == 1, "a/../").when(k == 2, "C:\\x\\").when(k == 3, "").otherwise("ok/..b/")
    p = F.concat(start, F.col("lang"), F.lit(".jpg"))
    return X.table(spark, d, "documents").select("doc_id", (~(p.startswith("/") | p.rlike("^[A-Za-z]:") | p.rlike(r"(^|[/\\])\.\.([/\\]|$)"))).alias("safe"))


@query("F20_policy_gates", X.sql(f"SELECT gate, count(*) AS kept FROM (SELECT 'all' AS gate FROM boxes WHERE {_REASON} IS NULL UNION ALL SELECT 'no_class' FROM boxes WHERE confidence >= 0.5::DOUBLE AND {_GEOMETRY} IS NULL UNION ALL SELECT 'no_size' FROM boxes WHERE confidence >= 0.5::DOUBLE AND confidence >= {_THRESHOLD}) GROUP BY gate"))
def f20(spark, d):
    """Policies are plan parameters: a gate that is off leaves its predicate out of the plan."""
    b, sure, least = X.boxes(spark, d), F.col("confidence") >= 0.5, C.by_class(F.col("class_id"), X.CLASS_THRESHOLDS)
    gates = {"all": eligibility().isNull(), "no_class": sure & shape_reason().isNull(), "no_size": sure & (F.col("confidence") >= least)}
    counts = b.agg(*(F.count_if(test).alias(name) for name, test in gates.items()))
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, gates)), F.array(*gates))).alias("gate", "kept"))


@query("F21_class_map_equality", "SELECT source, (SELECT count(*) FROM (SELECT DISTINCT lang FROM documents)) = count(DISTINCT lang) AS complete FROM documents GROUP BY source")
def f21(spark, d):
    docs = X.table(spark, d, "documents").select("source", "lang")
    every = docs.select("lang").distinct().agg(F.array_sort(F.collect_list("lang")).alias("expected"))
    own = docs.distinct().groupBy("source").agg(F.array_sort(F.collect_list("lang")).alias("names"))
    return own.join(F.broadcast(every)).select("source", (F.col("names") == F.col("expected")).alias("complete"))  # one row on the right


def range_problem(value, low: float, high: float, whole: bool = False):
    """Why a number is not an optional parameter of [low, high]; null if it is one, or not set."""
    out = F.when(F.isnan(value) | (F.abs(value) == float("inf")), "not_finite").when(~value.between(low, high), "out_of_range")
    return out.when(value != F.floor(value), "not_whole") if whole else out


@query("F22_range_validators", "SELECT event_id, CASE WHEN NOT value BETWEEN 0 AND 1 THEN 'out_of_range' END AS share, CASE WHEN NOT value BETWEEN 1 AND 100 THEN 'out_of_range' WHEN value <> floor(value) THEN 'not_whole' END AS number FROM events")
def f22(spark, d):
    """Values as a share (a confidence or overlap threshold) and as a whole number of boxes."""
    return X.table(spark, d, "events").select("event_id", range_problem(F.col("value"), 0, 1).alias("share"), range_problem(F.col("value"), 1, 100, whole=True).alias("number"))


@query("F23_proposal_contract", X.sql("SELECT image_id, x1, CASE WHEN NOT (confidence >= 0 AND confidence <= 1) THEN 'score' WHEN x1 >= x2 OR y1 >= y2 OR x1 < 0 THEN 'box' WHEN class_id NOT IN (0,1,2,3) THEN 'class' END AS problem FROM flips"))
def f23(spark, d):
    problem = F.when(~F.col("confidence").between(0, 1), "score").when(F.expr("x1 >= x2 OR y1 >= y2 OR x1 < 0"), "box").when(~F.col("class_id").isin(0, 1, 2, 3), "class")
    return X.flips(spark, d).select("image_id", "x1", problem.alias("problem"))


_SHAPE = "(decision = 'accepted' AND (paired IS NOT NULL) = gate) OR (decision = 'rejected' AND reason <> '')"


@query("F24_decision_shape", f"SELECT event_id, {_SHAPE} AS legal FROM (SELECT event_id, CASE WHEN value > 0.5 THEN 'accepted' ELSE 'rejected' END AS decision, CASE WHEN user_id % 2 = 0 THEN 'flip' END AS paired, event_id % 3 = 0 AS gate, CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS reason FROM events)")
def f24(spark, d):
    e = X.table(spark, d, "events").select("event_id", F.when(F.col("value") > 0.5, "accepted").otherwise("rejected").alias("decision"), F.when(F.col("user_id") % 2 == 0, "flip").alias("paired"), (F.col("event_id") % 3 == 0).alias("gate"), F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("event_type")).alias("reason"))
    return e.select("event_id", F.expr(_SHAPE).alias("legal"))


@query("F25_accepted_geometry", X.sql("SELECT image_id, x1, 800 - (800 - x2) = x2 AND 800 - (800 - x1) = x1 AND x1 >= 0 AND x2 <= 800 AS legal FROM flips"))
def f25(spark, d):
    b = G.Box.of()
    twice = G.flip_horizontal(G.flip_horizontal(b, F.lit(X.WIDTH)), F.lit(X.WIDTH))
    return X.flips(spark, d).select("image_id", "x1", ((twice.x2 == b.x2) & (twice.x1 == b.x1) & (b.x1 >= 0) & (b.x2 <= X.WIDTH)).alias("legal"))
