"""P: projections and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxwright.functions import geometry as G
from boxwright.plans.registry import query
from boxwright.sources import fixtures as X

W, H = X.WIDTH, X.HEIGHT


def _pairs(spark, d):
    """Original boxes with the labelled boxes of the same image and class."""
    a = X.boxes(spark, d)
    b = X.truth(spark, d).select("image_id", "class_id", *(F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")))
    return a.join(b, ["image_id", "class_id"])


_PAIRS = "FROM boxes a JOIN truth t ON a.image_id = t.image_id AND a.class_id = t.class_id"


@query("P01_box_iou", X.sql(f"SELECT a.image_id, a.class_id, {X.iou_sql('a', 't')} AS iou {_PAIRS}"))
def p01(spark, d):
    return _pairs(spark, d).select("image_id", "class_id", G.iou(G.Box.of(), G.Box.of("t_")).alias("iou"))


@query("P02_calibration_iou", X.sql(f"SELECT a.image_id, max({X.iou_sql('a', 't')}) AS best_iou {_PAIRS} GROUP BY a.image_id"))
def p02(spark, d):
    return _pairs(spark, d).groupBy("image_id").agg(F.max(G.iou(G.Box.of(), G.Box.of("t_"))).alias("best_iou"))


@query("P03_slice_iou", X.sql(f"SELECT a.image_id, a.x1, t.x1 AS t_x1, {X.iou_sql('a', 't')} AS iou {_PAIRS} AND least(a.x2,t.x2) > greatest(a.x1,t.x1) AND least(a.y2,t.y2) > greatest(a.y1,t.y1)"))
def p03(spark, d):
    touching = _pairs(spark, d).where(G.intersection(G.Box.of(), G.Box.of("t_")) > 0)
    return touching.select("image_id", "x1", "t_x1", G.iou(G.Box.of(), G.Box.of("t_")).alias("iou"))


@query(
    "P04_clamped_area_iou",
    X.sql(
        f"""SELECT image_id, class_id, CASE WHEN u > 0 THEN c / u ELSE 0.0::DOUBLE END AS iou FROM (
        SELECT image_id, class_id, c, greatest(0.0::DOUBLE, x2-x1)*greatest(0.0::DOUBLE, y2-y1) + greatest(0.0::DOUBLE, q2-q1)*greatest(0.0::DOUBLE, y2-y1) - c AS u FROM (
        SELECT *, greatest(0.0::DOUBLE, least(x2,q2)-greatest(x1,q1))*greatest(0.0::DOUBLE, y2-y1) AS c FROM (
        SELECT *, x2 - 100 AS q1, x1 + 100 AS q2 FROM boxes)))"""
    ),
)
def p04(spark, d):
    turned = X.boxes(spark, d).withColumns({"q_x1": F.col("x2") - 100, "q_x2": F.col("x1") + 100, "q_y1": F.col("y1"), "q_y2": F.col("y2")})
    return turned.select("image_id", "class_id", G.iou(G.Box.of(), G.Box.of("q_"), clamp_areas=True).alias("iou"))


_UNIT = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, {}))"
_YOLO = f"""SELECT image_id, class_id, (a1+a2)/2 AS x_center, (b1+b2)/2 AS y_center, a2-a1 AS width, b2-b1 AS height FROM (
SELECT image_id, class_id, {_UNIT.format('x1/800')} a1, {_UNIT.format('y1/600')} b1, {_UNIT.format('x2/800')} a2, {_UNIT.format('y2/600')} b2 FROM boxes) WHERE a2 > a1 AND b2 > b1"""


def yolo_rows(spark, d):
    b = G.Box.of()
    y = G.to_yolo(G.Box(b.x1 / W, b.y1 / H, b.x2 / W, b.y2 / H))
    return X.boxes(spark, d).select("image_id", "class_id", *(c.alias(n) for n, c in zip(y._fields, y, strict=True))).where("width > 0 AND height > 0")


@query("P05_to_yolo", X.sql(_YOLO))
def p05(spark, d):
    return yolo_rows(spark, d)


@query("P06_yolo_line", X.sql("SELECT image_id, printf('%d %.6f %.6f %.6f %.6f', class_id, x_center, y_center, width, height) AS line FROM yolo", f"yolo AS ({_YOLO})"))
def p06(spark, d):
    return yolo_rows(spark, d).select("image_id", F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", "x_center", "y_center", "width", "height").alias("line"))


@query("P07_yolo_to_pixels", X.sql("SELECT image_id, (x_center-width/2)*800 AS x1, (y_center-height/2)*600 AS y1, (x_center+width/2)*800 AS x2, (y_center+height/2)*600 AS y2 FROM yolo", f"yolo AS ({_YOLO})"))
def p07(spark, d):
    y = G.YoloBox(*(F.col(n) for n in G.YoloBox._fields))
    return yolo_rows(spark, d).select("image_id", *G.from_yolo(y, F.lit(W), F.lit(H)).columns())


@query("P08_xywh_strict", X.sql("SELECT image_id, x1, y1, x1 + (x2-x1) AS x2, y1 + (y2-y1) AS y2 FROM boxes WHERE x1 >= 0 AND y1 >= 0 AND x2-x1 > 0 AND y2-y1 > 0 AND x1 + (x2-x1) <= 800 AND y1 + (y2-y1) <= 600"))
def p08(spark, d):
    b = G.Box.of()
    out = X.boxes(spark, d).select("image_id", *G.from_xywh(b.x1, b.y1, b.width, b.height).columns())
    return out.where("x1 >= 0 AND y1 >= 0 AND x2 > x1 AND y2 > y1").where((F.col("x2") <= W) & (F.col("y2") <= H))


_CLAMP = "least(800.0::DOUBLE, greatest(0.0::DOUBLE, {0})) AS x1, least(600.0::DOUBLE, greatest(0.0::DOUBLE, {1})) AS y1, least(800.0::DOUBLE, greatest(0.0::DOUBLE, {2})) AS x2, least(600.0::DOUBLE, greatest(0.0::DOUBLE, {3})) AS y2"


@query("P09_clamp_positive", X.sql(f"SELECT * FROM (SELECT image_id, class_id, {_CLAMP.format('x1-150', 'y1', 'x2-150', 'y2')} FROM boxes) WHERE x2 > x1 AND y2 > y1"))
def p09(spark, d):
    b = G.Box.of()
    moved = G.clamp(G.Box(b.x1 - 150, b.y1, b.x2 - 150, b.y2), F.lit(W), F.lit(H))
    return X.boxes(spark, d).select("image_id", "class_id", *moved.columns()).where("x2 > x1 AND y2 > y1")


@query("P10_clip_and_flag", X.sql(f"SELECT image_id, x1, y1, x2, y2, x1 <> a OR y1 <> b OR x2 <> c OR y2 <> e AS clipped FROM (SELECT image_id, x1 AS a, y1 AS b, x2 AS c, y2 AS e, {_CLAMP.format('boxes.x1', 'boxes.y1', 'boxes.x2', 'boxes.y2')} FROM boxes) WHERE x2 > x1 AND y2 > y1"))
def p10(spark, d):
    b = G.Box.of()
    c = G.clamp(b, F.lit(W), F.lit(H))
    changed = (c.x1 != b.x1) | (c.y1 != b.y1) | (c.x2 != b.x2) | (c.y2 != b.y2)
    return X.boxes(spark, d).select("image_id", *c.columns(), changed.alias("clipped")).where("x2 > x1 AND y2 > y1")


@query("P11_edge_snap", X.sql("SELECT image_id, CASE WHEN abs(x1-0.005) <= 0.008::DOUBLE THEN 0.0::DOUBLE WHEN abs(x1-0.005-800) <= 0.008::DOUBLE THEN 800.0::DOUBLE ELSE x1-0.005 END AS x1, CASE WHEN abs(x2-0.005) <= 0.008::DOUBLE THEN 0.0::DOUBLE WHEN abs(x2-0.005-800) <= 0.008::DOUBLE THEN 800.0::DOUBLE ELSE x2-0.005 END AS x2 FROM (SELECT image_id, x1, x2 FROM boxes)"))
def p11(spark, d):
    b = G.Box.of()
    moved = X.boxes(spark, d).select("image_id", (b.x1 - F.lit(0.005)).alias("x1"), "y1", (b.x2 - F.lit(0.005)).alias("x2"), "y2")
    s = G.snap(G.Box.of(), F.lit(W), F.lit(H))
    return moved.select("image_id", s.x1.alias("x1"), s.x2.alias("x2"))


@query("P12_polygon_bounds", X.sql("SELECT image_id, least(x1, (x1+x2)/2, x2) AS x1, least(y1, y2) AS y1, greatest(x1, x2) AS x2, greatest(y1, y2) AS y2 FROM boxes"))
def p12(spark, d):
    b = G.Box.of()
    flat = F.array(b.x2, b.y1, (b.x1 + b.x2) / 2, b.y2, b.x1, b.y1)
    return X.boxes(spark, d).select("image_id", *G.polygon_bounds(flat).columns())


@query("P13_horizontal_flip", X.sql("SELECT image_id, 800 - x2 AS x1, y1, 800 - x1 AS x2, y2 FROM boxes"))
def p13(spark, d):
    return X.boxes(spark, d).select("image_id", *G.flip_horizontal(G.Box.of(), F.lit(W)).columns())


@query("P14_shape_features", X.sql("SELECT image_id, (x2-x1)/(y2-y1) AS aspect, (x2-x1)*(y2-y1)/(CAST(800 AS DOUBLE)*600) AS area_fraction, (x2-x1)*640/800 AS width_640, (y2-y1)*640/600 AS height_640 FROM boxes"))
def p14(spark, d):
    b = G.Box.of()
    return X.boxes(spark, d).select("image_id", (b.width / b.height).alias("aspect"), (b.area / (W * H)).alias("area_fraction"), (b.width * 640 / W).alias("width_640"), (b.height * 640 / H).alias("height_640"))


@query("P15_slice_to_image", X.sql("SELECT * FROM (SELECT image_id, least(800.0::DOUBLE, x1+160) AS x1, least(600.0::DOUBLE, y1+120) AS y1, least(800.0::DOUBLE, x2+160) AS x2, least(600.0::DOUBLE, y2+120) AS y2 FROM boxes) WHERE x2 > x1 AND y2 > y1"))
def p15(spark, d):
    b = G.Box.of()
    moved = G.clamp(G.Box(b.x1 + 160, b.y1 + 120, b.x2 + 160, b.y2 + 120), F.lit(W), F.lit(H))
    return X.boxes(spark, d).select("image_id", *moved.columns()).where("x2 > x1 AND y2 > y1")


def _windows_sql() -> str:
    starts = "list_distinct(CASE WHEN {s} <= 256 THEN [0] ELSE list_append(generate_series(0, {s}-256, 205), {s}-256) END)"
    return f"SELECT image_id, x AS left_edge, y AS top_edge, least(x+256, w) AS right_edge, least(y+256, h) AS bottom_edge FROM (SELECT image_id, w, h, unnest({starts.format(s='w')}) AS x, {starts.format(s='h')} AS ys FROM sized), unnest(ys) AS t(y)"


@query("P16_slice_windows", X.sql(_windows_sql(), "sized AS (SELECT DISTINCT image_id, CAST(200 + 100*(image_id % 9) AS INT) AS w, CAST(150 + 90*(image_id % 7) AS INT) AS h FROM boxes)"))
def p16(spark, d):
    sized = X.boxes(spark, d).select("image_id", (200 + 100 * (F.col("image_id") % 9)).cast("int").alias("w"), (150 + 90 * (F.col("image_id") % 7)).cast("int").alias("h")).distinct()
    xs = sized.select("*", F.explode(G.slice_starts(F.col("w"), 256, 205)).alias("left_edge"))
    return xs.select("*", F.explode(G.slice_starts(F.col("h"), 256, 205)).alias("top_edge")).select("image_id", "left_edge", "top_edge", F.least(F.col("left_edge") + 256, "w").alias("right_edge"), F.least(F.col("top_edge") + 256, "h").alias("bottom_edge"))


def crop_start(low, high, size: int, most: float):
    """Left edge of a crop of ``size`` centred on an interval, rounded half to even and kept inside the image."""
    middle = F.rint((low + high) / 2 - F.lit(size / 2)) + F.lit(0.0)  # without decimals in between; a negative zero becomes zero
    return F.least(F.greatest(middle, F.lit(0.0)), F.lit(most - size))


_CROP = "least(greatest(round_even((x1+x2)/2 - 128.0::DOUBLE, 0), 0.0::DOUBLE), 544.0::DOUBLE)"
_CROP_Y = "least(greatest(round_even((y1+y2)/2 - 128.0::DOUBLE, 0), 0.0::DOUBLE), 344.0::DOUBLE)"


def crops(spark, d):
    return X.boxes(spark, d).select("*", crop_start(F.col("x1"), F.col("x2"), 256, X.WIDTH).alias("cx"), crop_start(F.col("y1"), F.col("y2"), 256, X.HEIGHT).alias("cy"))


@query("P17_object_crop", X.sql(f"SELECT image_id, {_CROP} AS cx, {_CROP_Y} AS cy FROM boxes"))
def p17(spark, d):
    return crops(spark, d).select("image_id", "cx", "cy")


@query(
    "P18_clip_to_crop",
    X.sql(
        "SELECT image_id, class_id, printf('%.10f', (a1+a2)/2/256) AS xc, printf('%.10f', (b1+b2)/2/256) AS yc FROM (SELECT *, greatest(x1-cx, 0.0::DOUBLE) a1, greatest(y1-cy, 0.0::DOUBLE) b1, least(x2-cx, 256.0::DOUBLE) a2, least(y2-cy, 256.0::DOUBLE) b2 FROM crop) WHERE a2 > a1 AND b2 > b1 AND (a2-a1)*(b2-b1) >= 0.4::DOUBLE*((x2-x1)*(y2-y1))",
        f"crop AS (SELECT *, {_CROP} AS cx, {_CROP_Y} AS cy FROM boxes)",
    ),
)
def p18(spark, d):
    b = G.Box.of()
    local = G.Box(F.greatest(b.x1 - F.col("cx"), F.lit(0.0)), F.greatest(b.y1 - F.col("cy"), F.lit(0.0)), F.least(b.x2 - F.col("cx"), F.lit(256.0)), F.least(b.y2 - F.col("cy"), F.lit(256.0)))
    # generated, so that the corners are not written out again at every place that names them
    corners = F.inline(F.array(F.struct(*(getattr(local, c).alias(c) for c in ("x1", "y1", "x2", "y2")))))
    seen = crops(spark, d).select("image_id", "class_id", b.area.alias("whole"), corners)
    seen = seen.where((b.x2 > b.x1) & (b.y2 > b.y1) & (b.area >= F.lit(0.4) * F.col("whole")))
    return seen.select("image_id", "class_id", F.format_string("%.10f", (b.x1 + b.x2) / 2 / 256).alias("xc"), F.format_string("%.10f", (b.y1 + b.y2) / 2 / 256).alias("yc"))


@query("P19_canonical_projection", X.sql("SELECT 'lineitem' AS source, CAST(image_id AS VARCHAR) AS source_image_id, class_id, [x1,y1,x2,y2] AS xyxy, 800 AS width, 600 AS height FROM boxes"))
def p19(spark, d):
    return X.boxes(spark, d).select(F.lit("lineitem").alias("source"), F.col("image_id").cast("string").alias("source_image_id"), "class_id", F.array("x1", "y1", "x2", "y2").alias("xyxy"), F.lit(800).alias("width"), F.lit(600).alias("height"))


@query("P20_label_free", "SELECT doc_id, lang AS source, n_chars FROM documents")
def p20(spark, d):
    docs = X.table(spark, d, "documents").withColumn("labels", F.array(F.col("source")))
    return docs.drop("labels", "text", "source").select("doc_id", F.col("lang").alias("source"), "n_chars")


@query("P21_known_unknown_union", X.sql("SELECT image_id, 'known:' || CAST(class_id AS VARCHAR) AS label, confidence AS score, false AS is_unknown FROM boxes UNION ALL SELECT image_id, 'unknown', confidence, true FROM flips"))
def p21(spark, d):
    known = X.boxes(spark, d).select("image_id", F.concat(F.lit("known:"), F.col("class_id").cast("string")).alias("label"), F.col("confidence").alias("score"), F.lit(False).alias("is_unknown"))
    unknown = X.flips(spark, d).select("image_id", F.coalesce(F.lit(None).cast("string"), F.lit("unknown")).alias("label"), F.col("confidence").alias("score"), F.lit(True).alias("is_unknown"))
    return known.unionByName(unknown)


_OVERLAP = f"SELECT a.image_id, a.confidence, a.x1, a.y1, a.x2, a.y2, coalesce(max({X.iou_sql('a', 't')}), 0.0::DOUBLE) AS known_iou FROM flips a LEFT JOIN truth t ON a.image_id = t.image_id GROUP BY ALL"


def known_overlap(spark, d):
    """Each proposal's largest overlap with a known box of its image; 0 without any."""
    known = X.truth(spark, d).select("image_id", *(F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")))
    best = F.coalesce(F.max(G.iou(G.Box.of(), G.Box.of("t_"))), F.lit(0.0)).alias("known_iou")
    return X.flips(spark, d).join(known, "image_id", "left").groupBy("image_id", "confidence", "x1", "y1", "x2", "y2").agg(best)


@query("P22_novelty", X.sql("SELECT image_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, confidence*(1-known_iou))) AS novelty FROM o", f"o AS ({_OVERLAP})"))
def p22(spark, d):
    return known_overlap(spark, d).select("image_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence") * (1 - F.col("known_iou")))).alias("novelty"))


@query("P23_image_novelty", X.sql("SELECT i.image_id, 1 - coalesce(max(b.confidence), 0) AS novelty FROM (SELECT DISTINCT image_id FROM boxes) i LEFT JOIN (SELECT * FROM boxes WHERE confidence >= 0.8) b USING (image_id) GROUP BY i.image_id"))
def p23(spark, d):
    images = X.boxes(spark, d).select("image_id").distinct()
    sure = X.boxes(spark, d).where("confidence >= 0.8")
    return images.join(sure, "image_id", "left").groupBy("image_id").agg((1 - F.coalesce(F.max("confidence"), F.lit(0.0))).alias("novelty"))


@query("P24_source_from_path", "SELECT doc_id, regexp_extract('/data/images/' || source || '/' || lang || '.jpg', '/images/([^/]+)', 1) AS source_name FROM documents")
def p24(spark, d):
    path = F.concat(F.lit("/data/images/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit(".jpg"))
    return X.table(spark, d, "documents").select("doc_id", F.regexp_extract(path, "/images/([^/]+)", 1).alias("source_name"))


@query("P25_run_method", "SELECT event_id, coalesce(CASE WHEN event_type = 'click' THEN 'trust_main' END, CASE WHEN user_id % 3 = 0 THEN 'supervised_' || CAST(user_id % 4 * 10 AS VARCHAR) END, 'unclassified') AS method FROM events")
def p25(spark, d):
    role = F.when(F.col("event_type") == "click", F.lit("trust_main"))
    budget = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("supervised_"), (F.col("user_id") % 4 * 10).cast("string")))
    return X.table(spark, d, "events").select("event_id", F.coalesce(role, budget, F.lit("unclassified")).alias("method"))
