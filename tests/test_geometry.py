from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boxwright.functions import geometry as G

BOX = "x1 double, y1 double, x2 double, y2 double"


def rows(spark, data, schema=BOX):
    return spark.createDataFrame(data, schema)


def test_flip_is_its_own_inverse(spark):
    data = [(float(a), 2.0, float(a + 7), 9.0) for a in range(0, 90, 9)]
    twice = G.flip_horizontal(G.flip_horizontal(G.Box.of(), F.lit(100.0)), F.lit(100.0))
    got = rows(spark, data).select(*twice.columns()).collect()
    assert [tuple(r) for r in got] == data


def test_iou_range_symmetry_and_empty_union(spark):
    data = [(0.0, 0.0, 10.0, 10.0, 0.0, 0.0, 10.0, 10.0), (0.0, 0.0, 10.0, 10.0, 5.0, 0.0, 15.0, 10.0), (0.0, 0.0, 1.0, 1.0, 5.0, 5.0, 6.0, 6.0), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    df = rows(spark, data, BOX + ", t_x1 double, t_y1 double, t_x2 double, t_y2 double")
    a, b = G.Box.of(), G.Box.of("t_")
    got = df.select(G.iou(a, b).alias("v"), G.iou(b, a).alias("w")).collect()
    assert [round(r.v, 6) for r in got] == [1.0, round(1 / 3, 6), 0.0, 0.0]
    assert all(r.v == r.w for r in got)


def test_inverted_boxes_differ_only_with_clamped_areas(spark):
    df = rows(spark, [(10.0, 0.0, 0.0, 10.0, 0.0, 0.0, 10.0, 10.0)], BOX + ", t_x1 double, t_y1 double, t_x2 double, t_y2 double")
    assert df.select(G.iou(G.Box.of(), G.Box.of("t_"), clamp_areas=True)).first()[0] == 0.0


def test_snap_within_tolerance(spark):
    s = G.snap(G.Box.of(), F.lit(1000.0), F.lit(500.0))
    got = rows(spark, [(0.005, -0.01, 999.995, 500.02)]).select(*s.columns()).first()
    assert (got.x1, got.y1, got.x2) == (0.0, 0.0, 1000.0) and got.y2 == 500.02


def test_polygon_bounds(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.5, 0.2, 0.3, 0.4],)], "p array<double>")
    got = df.select(*G.polygon_bounds(F.col("p")).columns()).first()
    assert tuple(got) == (0.1, 0.2, 0.5, 0.9)


@settings(max_examples=200)
@given(st.integers(1, 3000), st.integers(1, 700), st.integers(1, 700))
def test_windows_cover_everything(size, slice_size, stride):
    stride = min(stride, slice_size)
    starts = G.window_starts(size, slice_size, stride)
    covered = 0
    for s in starts:
        assert s <= covered
        covered = max(covered, s + slice_size)
    assert covered >= size and (size <= slice_size or starts[-1] == size - slice_size)


def test_window_columns_equal_the_plain_rule(spark):
    sizes = [1, 255, 256, 257, 461, 462, 800, 1000]
    got = spark.createDataFrame([(s,) for s in sizes], "s int").select("s", G.slice_starts(F.col("s"), 256, 205).alias("a")).collect()
    assert {r.s: r.a for r in got} == {s: G.window_starts(s, 256, 205) for s in sizes}


def test_finite_guards_nan_null_and_length(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([1.0, 2.0, 3.0],), ([1.0, nan, 3.0, 4.0],), ([1.0, 2.0, inf, 4.0],), ([1.0, None, 3.0, 4.0],), (None,)], "b array<double>")
    assert [r[0] for r in df.select(G.finite(F.col("b"))).collect()] == [True, False, False, False, False, False]
