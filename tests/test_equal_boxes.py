"""Queries over boxes that are equal, or equal in what their order names."""

import duckdb
import pytest

import __spark_entry__ as entry
from boxwright.plans import trust_queries
from boxwright.sources import fixtures as X

_SCHEMA = "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR"


def lines(path, *rows):
    """A lineitem table; rows: order, part, supplier, line, quantity, flag."""
    duckdb.connect().execute(f"CREATE TABLE t ({_SCHEMA})").executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?, 'F')", rows).execute(f"COPY t TO '{path}/lineitem.parquet'")


def told(path, name):
    c = duckdb.connect().execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/lineitem.parquet'")
    return sorted(map(str, c.execute(entry.oracle_sql()[name]).fetchall()))


def got(spark, path, name):
    return sorted(str(tuple(r)) for r in entry.queries()[name](spark, f"{path}").collect())


@pytest.fixture
def equal(tmp_path):
    """Image 1 has an eligible box twice and both have partners; image 2 has one that has one partner; 20 boxes for the cap in image 3 and two
    equal ones over it; image 10 is for the coordinate gate; one below the thresholds."""
    best = (15, 25, 3)  # part, supplier (class 0), quantity: a score of 0.97
    rows = [(4, best[0], best[1], 1, best[2], "R"), (5, best[0], best[1], 1, best[2], "A"), (8, best[0], best[1], 1, best[2], "R"), (9, best[0], best[1], 1, best[2], "N"), (40, *best[:2], 1, best[2], "R"), (41, *best[:2], 1, best[2], "R"), (4, 1, 0, 2, 1, "R")]
    # one box a place, best first
    found = duckdb.connect().execute(
        "SELECT min((p, s)), l, q FROM range(8, 12) a(p), range(0, 60, 5) b(s), range(1, 12) c(l), range(20, 80, 20) d(q) WHERE (p * 37 + s * 11 + l * 101 + q * 13) % 1000 BETWEEN 700 AND 990 AND p % 5 = 0 GROUP BY l, q ORDER BY l, q LIMIT 24"
    ).fetchall()
    placed = [(*ps, l, q) for ps, l, q in found]
    worst = sorted(placed, key=lambda x: (x[0] * 37 + x[1] * 11 + x[2] * 101 + x[3] * 13) % 1000)[:2]
    rows += [(12, *x, "R") for x in placed] + [(13, *x, "R") for x in worst]
    lines(tmp_path, *rows)
    return tmp_path


@pytest.mark.parametrize("name", ["Q19_trust_filter", "Q19_trust_decisions", "Q19_all_gates", "Q20_bound_trust_filter", "J13_cross_view_pairing"])
def test_equal_boxes_count_as_in_the_sql(spark, equal, name):
    assert got(spark, equal, name) == told(equal, name)


def test_the_filter_itself_has_a_row_a_candidate(spark, equal):
    path = f"{equal}"
    n = X.boxes(spark, path).count() + X.flips(spark, path).count()
    decided = trust_queries.trust_filter(trust_queries.gated(spark, path))
    reasons = {r.reason for r in decided.collect()}
    assert decided.count() == n and {None, "nms_duplicate", "max_boxes_per_image", "no_cross_view_match", "below_global_confidence"} <= reasons


def test_small_objects_of_equal_rank_come_in_one_order(spark, tmp_path, monkeypatch):
    # equal area, class and corner: 20 x 76 and 76 x 20 (4 x 19), by crop
    sizes = {(p % 60, p // 3 % 50): p for p in range(300)}
    pairs = [(sizes[a], sizes[b]) for a in sizes for b in sizes if a < b and (12 + 8 * a[0]) * (12 + 8 * a[1]) == (12 + 8 * b[0]) * (12 + 8 * b[1]) and max(*a, *b) < 45]
    one, two = pairs[0]
    for order in ((one, two), (two, one)):
        folder = tmp_path / str(order[0])
        folder.mkdir()
        lines(folder, *((k, p, 5, 6, 40, "R") for k, p in enumerate(order)))
        rows = entry.queries()["W09_small_objects"](spark, f"{folder}").orderBy("k").collect()
        assert len(rows) == 2 and (rows[0].cx, rows[0].cy) < (rows[1].cx, rows[1].cy)
