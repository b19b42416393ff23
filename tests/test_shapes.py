"""Outlines of patches and scan lines against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import polygons, raster


def flood(cells, free):
    """4-connected pieces of a set of cells."""
    left, out = set(cells), []
    while left:
        piece, todo = set(), [left.pop()]
        while todo:
            r, c = todo.pop()
            piece.add((r, c))
            for n in ((r, c + 1), (r, c - 1), (r + 1, c), (r - 1, c)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        out.append(piece)
    return out


@pytest.fixture(scope="module")
def masks():
    rng = random.Random(5)
    random_ = {(k, r, c) for k in range(4) for r in range(9) for c in range(9) if rng.random() < 0.35 + 0.12 * k}
    # Two pixels that touch at a corner, a frame, a frame with a pixel inside, two holes that touch at a corner.
    shapes = {4: ["#.", ".#"], 5: ["###", "#.#", "###"], 6: ["#####", "#...#", "#.#.#", "#...#", "#####"], 7: ["####", "#.##", "##.#", "####"], 8: ["###", "#.#", "##."]}
    return random_ | {(k, r, c) for k, rows in shapes.items() for r, row in enumerate(rows) for c, x in enumerate(row) if x == "#"}


def test_outlines(spark, masks):
    mask = spark.createDataFrame(sorted(masks), "k int, row int, col int").repartition(4)
    edges = raster.ring_positions(raster.outline_edges(raster.components(mask, ["k"], diagonal=False), ["k"]), ["k"]).checkpoint()
    rings = {}
    for e in edges.collect():
        rings.setdefault((e.k, e.patch), {}).setdefault(e.ring, []).append(e)
    expected = {(k, "{:09d}:{:09d}".format(*min(p))): p for k in range(9) for p in flood({(r, c) for j, r, c in masks if j == k}, None)}
    assert set(rings) == set(expected)
    for name, patch in expected.items():
        around = {(r, c) for r in range(-1, 10) for c in range(-1, 10)} - patch
        pieces = flood(around, None)
        areas = []
        for ring in rings[name].values():
            ring.sort(key=lambda e: e.position)
            assert [e.position for e in ring] == list(range(len(ring)))
            assert all((a.r1, a.c1) == (b.r0, b.c0) for a, b in zip(ring, [*ring[1:], ring[0]]))
            assert len({(e.r0, e.c0) for e in ring}) == len(ring)  # no ring touches itself
            areas.append(sum(e.c0 * e.r1 - e.c1 * e.r0 for e in ring) / 2)
        assert sorted(-a for a in areas if a < 0) == sorted(len(p) for p in pieces if (-1, -1) not in p)
        assert [a for a in areas if a > 0] == [len(patch) + sum(len(p) for p in pieces if (-1, -1) not in p)]
    got = {(r.k, r.patch): (r.area_ha, r.outline_ha, r.perimeter_m, r.holes) for r in raster.outline_areas(edges, ["k"], 100.0, 2.0, 2.0).collect()}
    assert set(got) == {n for n, p in expected.items() if len(p) >= 2}




def test_scan_lines_find_what_point_tests_find(spark):
    rng = random.Random(9)
    star = lambda x, y, r, n: [(x + (q := r * rng.uniform(0.4, 1)) * math.cos(2 * math.pi * i / n), y + q * math.sin(2 * math.pi * i / n)) for i in range(n)]
    shapes = [[star(20, 20, 15, 11), star(20, 20, 4, 7)], [star(40, 12, 9, 5)], [[(2, 2), (8, 2), (8, 8), (5, 5), (2, 8)], [(4, 3), (6, 3), (6, 4), (4, 4)]], [[(10, 30), (14, 34), (10, 38), (6, 34)]], [[(30, 30), (38, 30), (38, 31), (33, 31), (33, 36), (30, 36)]]]
    edges = polygons.edge_table(spark, [[[*ring, ring[0]] for ring in rings] for rings in shapes])
    got = {tuple(r) for r in polygons.pixels_in_polygons(edges, 0.0, 0.0, 0.5).select("polygon", "row", "col").collect()}
    grid = spark.range(120 * 120).select(F.struct(F.floor(F.col("id") / 120).alias("row"), (F.col("id") % 120).alias("col")).alias("p")).withColumns({"x_m": F.col("p.col") * 0.5, "y_m": F.col("p.row") * 0.5})
    expected = {(r.polygon, r.p.row, r.p.col) for r in polygons.points_in_polygons(grid, edges, "p").collect()}
    assert got == expected and len({g[0] for g in got}) == 5
    assert polygons.pixels_in_polygons(edges.where("polygon < 0"), 0.0, 0.0, 1.0).count() == 0


def test_large_rings_cross_nest_and_simplify(spark):
    """Rings of thousands of edges: smooth, back and forth, crossing once; copies in one another; a circle's vertices thinned out."""
    circle = lambda r, n: [(r * math.cos(2 * math.pi * i / n), r * math.sin(2 * math.pi * i / n)) for i in range(n)]
    comb = [(i / 10, (i % 2) * 50.0 + 0.001 * i) for i in range(4000)] + [(400.0, 60.0), (0.0, 60.0)]
    crossed = circle(9, 3000)
    crossed[700], crossed[701] = crossed[701], crossed[700]
    edges = polygons.edge_table(spark, [[[*ring, ring[0]] for ring in (circle(10, 5000), comb, crossed)]]).checkpoint()
    assert {(r.ring, r.problem) for r in polygons.ring_violations(edges).collect()} == {(2, "crosses_itself")}
    sizes = edges.groupBy("polygon", "ring").count().withColumnRenamed("count", "n")
    assert polygons._banded(edges, sizes).count() < 10 * edges.count()
    rings = polygons.edge_table(spark, [[[*ring, ring[0]] for ring in (circle(10 - i, 1000) for i in range(6))]])
    assert {(r.ring, r.depth, r.is_hole) for r in polygons.nesting(rings).collect()} == {(i, i, i % 2 == 1) for i in range(6)}
    after = polygons.simplified_rings(edges.where("ring = 0"), 0.01).collect()
    kept = {(e.x1, e.y1) for e in after}
    assert 4 < len(after) < 300 and all(any((round(x, 9), round(y, 9)) == (round(a, 9), round(b, 9)) for a, b in kept) for x, y in ((10, 0), (0, 10), (-10, 0), (0, -10)))
    by_start = {(e.x1, e.y1): (e.x2, e.y2) for e in after}
    assert set(by_start.values()) == kept and sorted(e.edge for e in after) == list(range(len(after)))


def test_total_order_and_cells(spark):
    from emberline.functions import clean
    from emberline.operators import ranking

    rng = random.Random(3)
    rows = [(rng.randrange(50), i) for i in range(3000)]
    out = ranking.total_order(spark.createDataFrame(rows, "a int, b int").repartition(7), [F.col("a"), F.col("b")], 200)
    assert [(r.a, r.b, r.position) for r in sorted(out.collect(), key=lambda r: r.position)] == [(*r, i) for i, r in enumerate(sorted(rows))]
    values = [0.0, -0.0, 1.0, -2.5, 1e15, 123456789012345.6, 1e-5, -1.5e-7, 1e300, 0.1 + 0.2, 1e16, 1e-300, 99999.99999999999, None, float("nan"), float("inf")]
    got = [r.t for r in spark.createDataFrame([(v,) for v in values], "v double").select(clean.general_float(F.col("v")).alias("t")).collect()]
    assert got == ["0" if v == 0 else "" if v is None or v != v or abs(v) == math.inf else f"{v:.15g}" for v in values]
    cells = ['{"b": 1, "a": [1, null]}', "[]", "null", '"x"', "", "{", "1 2", '1,"w":2', '1,"v":2', "1}", "[1]]", None]
    got = [(r.j, r.ok) for r in spark.createDataFrame([(c,) for c in cells], "c string").select(*[x.alias(n) for x, n in zip(clean.json_cell(F.col("c")), ("j", "ok"))]).collect()]
    assert got == [('{"a":[1,null],"b":1}', True), ("[]", True), ("null", True), ('"x"', True)] + [("[]", False)] * 8


def test_floats_between_two_short_forms_round_by_their_exact_value(spark):
    from emberline.functions import clean

    values = [296.35 / 3, 258.85 / 3, 283.6 / 3, 0.1234567890123455, 123456789012345.5, 12345678901234.25]
    got = [r.t for r in spark.createDataFrame([(v,) for v in values], "v double").select(clean.general_float(F.col("v")).alias("t")).collect()]
    assert got == [f"{v:.15g}" for v in values] and got[0] == "98.7833333333333"


def test_ranges_of_a_total_order_grow_as_a_root(spark):
    from emberline.operators import ranking

    out = ranking.total_order(spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("a")), [F.col("a")], 10)
    assert out.rdd.getNumPartitions() <= ranking.RANGES and out.where("a <> position").count() == 0
