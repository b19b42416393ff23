"""Polygons as edge tables: membership, area, validity, nesting, interior points, simplification."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.operators.ranking import blocked
from emberline.runtime import cut, fill

#: Points nearer to an edge than this lie on it.
ON_EDGE = 1e-10

EDGES = "polygon int, ring int, is_hole boolean, edge int, x1 double, y1 double, x2 double, y2 double"


def edge_table(spark: SparkSession, polygons: list[list[list[tuple[float, float]]]]) -> DataFrame:
    """Edges of polygons given as [outer ring, hole, ...], rings closed."""
    rows = [(p, r, r > 0, i, *map(float, ring[i]), *map(float, ring[i + 1])) for p, rings in enumerate(polygons) for r, ring in enumerate(rings) for i in range(len(ring) - 1)]
    return spark.createDataFrame(rows, EDGES)


def geojson_edges(features: DataFrame) -> DataFrame:
    """Edges of rows (feature, coordinates array of polygons of rings of points)."""
    rings = features.select("feature", F.posexplode("coordinates").alias("polygon", "rings")).select("feature", "polygon", F.posexplode("rings").alias("ring", "points"))
    steps = rings.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("points") - 2)))
    at = lambda i, k: F.get(F.get("points", i), F.lit(k))
    i = F.col("i")
    return steps.select("feature", "polygon", "ring", (F.col("ring") > 0).alias("is_hole"), i.alias("edge"), at(i, 0).alias("x1"), at(i, 1).alias("y1"), at(i + 1, 0).alias("x2"), at(i + 1, 1).alias("y2"))


def _turn(ax, ay, bx, by, cx, cy):
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def points_in_polygons(points: DataFrame, edges: DataFrame, key: str, x: str = "x_m", y: str = "y_m", bands: int = 64, own: bool = False) -> DataFrame:
    """(key, polygon) of the points inside: outer edges count as inside, hole edges as outside.

    Edges are dealt to horizontal bands and meet only the points of their band, after a cut to the
    polygons' common box; crossings are counted per ring. With ``own`` a point has a polygon and
    meets that alone; neither side is then broadcast, as Spark may take either for small.
    """
    box = edges.agg(F.min("y1").alias("lo"), F.max("y1").alias("hi"), F.min("x1").alias("w"), F.max("x1").alias("e")).first()
    if box["lo"] is None:
        return points.select(key).limit(0).withColumn("polygon", F.lit(0))
    size = max((box["hi"] - box["lo"]) / bands, 1e-9)
    band = lambda c: F.floor((c - box["lo"]) / size)
    near = points.where(F.col(x).between(box["w"] - ON_EDGE, box["e"] + ON_EDGE) & F.col(y).between(box["lo"] - ON_EDGE, box["hi"] + ON_EDGE)).select(key, *["polygon"] * own, F.col(x).alias("px"), F.col(y).alias("py")).withColumn("band", band(F.col("py")))
    spread = edges.withColumn("band", F.explode(F.sequence(band(F.least("y1", "y2") - ON_EDGE), band(F.greatest("y1", "y2") + ON_EDGE))))
    px, py, x1, y1, x2, y2 = (F.col(c) for c in ("px", "py", "x1", "y1", "x2", "y2"))
    touches = (F.abs(_turn(x1, y1, x2, y2, px, py)) <= ON_EDGE) & px.between(F.least(x1, x2) - ON_EDGE, F.greatest(x1, x2) + ON_EDGE) & py.between(F.least(y1, y2) - ON_EDGE, F.greatest(y1, y2) + ON_EDGE)
    crosses = ((y1 > py) != (y2 > py)) & (px < F.try_divide((x2 - x1) * (py - y1), y2 - y1) + x1)
    met = near.hint("merge").join(spread, ["polygon", "band"]) if own else near.join(spread, "band")
    rings = met.groupBy(key, "polygon", "ring", "is_hole").agg(F.bool_or(touches).alias("on"), (F.count_if(crosses) % 2 == 1).alias("odd"))
    # Inside the outer ring or on it, and neither inside a hole nor on its edge.
    verdict = rings.groupBy(key, "polygon").agg(
        F.bool_or(~F.col("is_hole") & (F.col("on") | F.col("odd"))).alias("outer"), F.bool_or(F.col("is_hole") & (F.col("on") | F.col("odd"))).alias("hole")
    )
    return verdict.where(F.col("outer") & ~F.col("hole")).select(key, "polygon")


def pixels_in_polygons(edges: DataFrame, west: float, south: float, step: float, keys: tuple[str, ...] = ("polygon",)) -> DataFrame:
    """(keys, row, col): grid points (west + col * step, south + row * step) inside, by scan lines; the same points as points_in_polygons finds.

    An edge meets the rows between its ends. The crossings of a ring with a row are sorted, each two
    bound a span, and spans become columns; only points inside are ever made. Points on an outer edge
    are inside, those on a hole's edge are not.
    """
    own = [*keys, "ring", "is_hole"]
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    row = lambda y: (y - south) / step
    lo, hi, slack = F.least(y1, y2), F.greatest(y1, y2), ON_EDGE / step
    rows = F.sequence(F.ceil(row(lo) - slack), F.floor(row(hi) + slack))
    met = edges.where(F.floor(row(hi) + slack) >= F.ceil(row(lo) - slack)).withColumn("row", F.explode(rows)).withColumn("y", south + F.col("row") * step)
    crossing = ((y1 > F.col("y")) != (y2 > F.col("y"))) & (y1 != y2)
    x = x1 + (x2 - x1) * (F.col("y") - y1) / F.nullif(y2 - y1, F.lit(0.0))
    order = Window.partitionBy(*own, "row").orderBy("x")
    marked = met.where(crossing).select(*own, "row", x.alias("x")).withColumns({"n": F.row_number().over(order), "to": F.lead("x").over(order)})
    spans = marked.where("n % 2 = 1").select(*own, "row", F.col("x").alias("a"), F.col("to").alias("b"))
    # On the edge itself: level edges, and ends that only touch the row.
    near = lambda y: F.abs(y - F.col("y")) <= ON_EDGE
    touching = F.filter(F.array(F.when(near(y1) & near(y2), F.struct(F.least(x1, x2).alias("a"), F.greatest(x1, x2).alias("b"))), F.when(near(y1), F.struct(x1.alias("a"), x1.alias("b"))), F.when(near(y2), F.struct(x2.alias("a"), x2.alias("b")))), lambda s: s.isNotNull())
    spans = spans.unionByName(met.select(*own, "row", F.explode(touching).alias("s")).select(*own, "row", "s.a", "s.b"))
    first, last = F.ceil((F.col("a") - west) / step - slack), F.floor((F.col("b") - west) / step + slack)
    points = spans.where(last >= first).select(*keys, "is_hole", "row", F.explode(F.sequence(first, last)).alias("col"))
    outer, hole = (points.where(w).select(*keys, "row", "col").distinct() for w in ("not is_hole", "is_hole"))
    return outer.join(hole, [*keys, "row", "col"], "left_anti")


def areas(edges: DataFrame, keys: Iterable[str] = ("polygon",)) -> DataFrame:
    """Area and area-weighted centroid with holes taken off, by the shoelace sum."""
    keys = list(keys)
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    rings = edges.groupBy(*keys, "ring", "is_hole").agg(F.sum(cross).alias("a"), F.sum((F.col("x1") + F.col("x2")) * cross).alias("sx"), F.sum((F.col("y1") + F.col("y2")) * cross).alias("sy"))
    sign = F.when(F.col("is_hole"), -1.0).otherwise(1.0) * F.signum("a")
    out = rings.groupBy(*keys).agg(F.sum(sign * F.col("a") / 2).alias("area"), F.sum(sign * F.col("sx") / 6).alias("mx"), F.sum(sign * F.col("sy") / 6).alias("my"))
    return out.select(*keys, "area", F.try_divide("mx", "area").alias("centroid_x"), F.try_divide("my", "area").alias("centroid_y"))


def _banded(edges: DataFrame, sizes: DataFrame, per: int = 8) -> DataFrame:
    """``edges`` with n (edges of the ring) and the bands each one touches, across the axis along which its ring turns back less.

    A ring has a band for each ``per`` edges, and fewer where it runs back and forth, so that all bands
    together hold a few times its edges. Edges that cross share a band.
    """
    up = lambda a, b: F.sum(F.abs(F.col(b) - F.col(a)))
    stats = edges.groupBy("polygon", "ring").agg(F.min("x1").alias("w"), F.max("x1").alias("e"), F.min("y1").alias("s"), F.max("y1").alias("t"), up("x1", "x2").alias("tx"), up("y1", "y2").alias("ty")).join(sizes, ["polygon", "ring"])
    turns = lambda total, lo, hi: F.coalesce(F.try_divide(F.col(total), F.col(hi) - F.col(lo)), F.lit(float("inf")))
    by_y = turns("ty", "s", "t") <= turns("tx", "w", "e")
    bands = F.greatest(F.lit(1.0), F.least(F.col("n") / per, 4 * F.col("n") / F.least(turns("ty", "s", "t"), turns("tx", "w", "e"))))
    stats = stats.select("polygon", "ring", "n", by_y.alias("by_y"), F.when(by_y, F.col("s")).otherwise(F.col("w")).alias("from"), (F.greatest(F.when(by_y, F.col("t") - F.col("s")).otherwise(F.col("e") - F.col("w")), F.lit(1e-9)) / bands).alias("width"))
    rows = edges.join(stats, ["polygon", "ring"])
    a, b = (F.when(F.col("by_y"), F.col(f"y{i}")).otherwise(F.col(f"x{i}")) for i in (1, 2))
    place = lambda v, slack: F.floor((v + slack - F.col("from")) / F.col("width"))
    return rows.withColumn("band", F.explode(F.sequence(place(F.least(a, b), -ON_EDGE), place(F.greatest(a, b), ON_EDGE)))).drop("by_y", "from", "width")


def ring_violations(edges: DataFrame) -> DataFrame:
    """(polygon, ring, problem): too few points, open, without area, crossing itself."""
    n = edges.groupBy("polygon", "ring").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("x1", "y1"), "edge").alias("first"), F.max_by(F.struct(F.col("x2").alias("x1"), F.col("y2").alias("y1")), "edge").alias("last"), F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).alias("a"))
    simple = n.select("polygon", "ring", F.explode(F.array_compact(F.array(F.when(F.col("n") < 3, "too_few_points"), F.when(F.col("first") != F.col("last"), "open"), F.when(F.abs("a") / 2 <= 1e-12, "no_area")))).alias("problem"))
    banded = _banded(edges, n.select("polygon", "ring", "n"))
    b = banded.select("polygon", "ring", "band", *[F.col(c).alias(f"{c}_b") for c in ("edge", "x1", "y1", "x2", "y2")])
    t = lambda p, q, r: _turn(*(F.col(c) for c in (*p, *q, *r)))
    A, B, C, D = ("x1", "y1"), ("x2", "y2"), ("x1_b", "y1_b"), ("x2_b", "y2_b")
    proper = ((t(A, B, C) > 0) != (t(A, B, D) > 0)) & ((t(C, D, A) > 0) != (t(C, D, B) > 0))
    boxes = (F.greatest("x1", "x2") >= F.least("x1_b", "x2_b")) & (F.greatest("x1_b", "x2_b") >= F.least("x1", "x2")) & (F.greatest("y1", "y2") >= F.least("y1_b", "y2_b")) & (F.greatest("y1_b", "y2_b") >= F.least("y1", "y2"))
    apart = (F.col("edge_b") > F.col("edge") + 1) & ~((F.col("edge") == 0) & (F.col("edge_b") == F.col("n") - 1))
    flat = (F.abs(t(A, B, C)) <= ON_EDGE) & (F.abs(t(A, B, D)) <= ON_EDGE)
    crossing = banded.join(b, ["polygon", "ring", "band"]).where(apart & boxes & (proper | flat)).select("polygon", "ring", F.lit("crosses_itself").alias("problem")).distinct()
    return simple.unionByName(crossing)


def nesting(edges: DataFrame, per: int = 100) -> DataFrame:
    """(ring, depth, is_hole) of loose rings, which may touch nowhere: odd depth is a hole.

    A ring's start is tested as a point, so it meets only the edges of its band, of which each has about ``per``.
    """
    loose = cut(edges.select(F.col("ring").alias("polygon"), "ring", F.lit(False).alias("is_hole"), "edge", "x1", "y1", "x2", "y2"))
    starts = loose.where("edge = 0").select(F.col("ring").alias("inner"), F.col("x1").alias("x_m"), F.col("y1").alias("y_m"))
    held = points_in_polygons(starts, loose, "inner", bands=fill(loose.count(), per, 64)).where("inner <> polygon")
    depth = held.groupBy("inner").agg(F.count(F.lit(1)).alias("depth"))
    return loose.select("ring").distinct().join(depth, F.col("ring") == F.col("inner"), "left").select("ring", F.coalesce("depth", F.lit(0)).alias("depth"), (F.coalesce("depth", F.lit(0)) % 2 == 1).alias("is_hole"))


def interior_points(edges: DataFrame, steps: int = 19) -> DataFrame:
    """(polygon, x, y): the mean of the outer vertices if inside, else the first grid point that is.

    A polygon's points meet its own edges alone, and only polygons without a point yet try more of the grid.
    """
    outer = edges.where("not is_hole").groupBy("polygon").agg(F.avg("x1").alias("mx"), F.avg("y1").alias("my"), F.min("x1").alias("w"), F.max("x1").alias("e"), F.min("y1").alias("s"), F.max("y1").alias("n"))
    i, j = F.col("k") - 1, F.lit(steps)
    gx = F.col("w") + (F.col("e") - F.col("w")) * ((i % j) + 1) / (steps + 1)
    gy = F.col("s") + (F.col("n") - F.col("s")) * (F.floor(i / j) + 1) / (steps + 1)
    pending, out, k = cut(outer), None, 0
    while k <= steps * steps and (k == 0 or not pending.isEmpty()):
        last = min(steps * steps, max(2 * k, steps) if k else 0)
        grid = pending.withColumn("k", F.explode(F.sequence(F.lit(k), F.lit(last))))
        tries = grid.select("polygon", "k", F.when(F.col("k") == 0, F.col("mx")).otherwise(gx).alias("x_m"), F.when(F.col("k") == 0, F.col("my")).otherwise(gy).alias("y_m")).withColumn("try", F.struct("polygon", "k", "x_m", "y_m"))
        found = points_in_polygons(tries, edges, "try", own=True).groupBy("polygon").agg(F.min_by("try", "try.k").alias("p"))
        found = cut(found.select("polygon", F.col("p.x_m").alias("x"), F.col("p.y_m").alias("y")))
        out, pending, k = found if out is None else out.unionByName(found), cut(pending.join(found, "polygon", "left_anti")), last + 1
    return out


def simplified_rings(edges: DataFrame, tolerance: float) -> DataFrame:
    """Rings with the vertices that Ramer-Douglas-Peucker keeps between the four extreme vertices, which always stay.

    All open stretches are split at once, each at its farthest vertex if that is beyond ``tolerance``;
    each round is an aggregate over the vertices still open, so a ring is spread over tasks like any rows.
    """
    key = ["polygon", "ring", "is_hole"]
    points = cut(edges.select(*key, F.col("edge").cast("long").alias("i"), F.col("x1").alias("x"), F.col("y1").alias("y")))
    first = lambda f, c, i: f("i", F.struct(c, i))
    ends = points.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.array_distinct(F.array(*[first(F.min_by, c, F.col("i")) for c in ("x", "y")], *[first(F.max_by, c, -F.col("i")) for c in ("x", "y")]))).alias("ends"))
    start = F.get("ends", F.lit(0))
    turned = points.join(ends, key).withColumns({"i": F.pmod(F.col("i") - start, F.col("n")), "ends": F.transform("ends", lambda e: e - start)})
    at = F.filter("ends", lambda e: e <= F.col("i"))
    turned = cut(turned.select(*key, "i", "x", "y", "n", F.array_max(at).alias("a"), F.coalesce(F.array_min(F.filter("ends", lambda e: e > F.col("i"))), F.col("n")).alias("b")))
    kept = turned.where("i = a").select(*key, "i", "x", "y", "n")
    corner = lambda n: kept.select(*key, F.col("i").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"))
    closing = corner("b").where("b = 0").drop("b").join(ends.select(*key, F.col("n").alias("b")), key)
    open_ = cut(turned.where("i > a").join(corner("a"), [*key, "a"]).join(corner("b").unionByName(closing.select(*corner("b").columns)), [*key, "b"]))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    length = F.sqrt(dx * dx + dy * dy)
    off = F.when(length > 0, F.abs(dx * (F.col("ay") - F.col("y")) - (F.col("ax") - F.col("x")) * dy) / length).otherwise(F.sqrt((F.col("x") - F.col("ax")) ** 2 + (F.col("y") - F.col("ay")) ** 2))
    while not open_.isEmpty():
        farthest = open_.withColumn("d", off).groupBy(*key, "a").agg(F.max(F.struct("d", (-F.col("i")).alias("m"), "x", "y")).alias("f")).where(F.col("f.d") > tolerance)
        split = cut(open_.join(farthest.select(*key, "a", (-F.col("f.m")).alias("s"), F.col("f.x").alias("sx"), F.col("f.y").alias("sy")), [*key, "a"]))
        kept = kept.unionByName(split.where("i = s").select(*key, "i", "x", "y", "n"))
        before = F.col("i") < F.col("s")
        new = {"a": ("a", "s"), "ax": ("ax", "sx"), "ay": ("ay", "sy"), "b": ("s", "b"), "bx": ("sx", "bx"), "by": ("sy", "by")}
        open_ = cut(split.where("i <> s").select(*key, "i", "x", "y", "n", *[F.when(before, F.col(u)).otherwise(F.col(v)).alias(c) for c, (u, v) in new.items()]))
    ranked = cut(blocked(cut(kept), key, F.floor(F.col("i") / 65536), [F.col("i")], rank="edge"))
    count = ranked.groupBy(*key).agg(F.count(F.lit(1)).alias("m"))
    after = ranked.select(*key, F.col("edge").alias("next"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    out = ranked.join(count, key).withColumn("next", (F.col("edge") + 1) % F.col("m")).join(after, [*key, "next"])
    return out.select(*key, F.col("edge").cast("int").alias("edge"), F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


def simplification_gates(before: DataFrame, after: DataFrame, most_change: float = 0.01) -> DataFrame:
    """(polygon, same_box, area_change, valid) of a simplified table against its original."""
    box = lambda e: e.groupBy("polygon").agg(*[f(c).alias(f"{n}") for n, f, c in (("w", F.min, "x1"), ("e", F.max, "x1"), ("s", F.min, "y1"), ("n", F.max, "y1"))])
    a, b = areas(before).select("polygon", F.col("area").alias("a")), areas(after).select("polygon", F.col("area").alias("b"))
    same = box(before).withColumn("same_box", F.lit(True)).join(box(after), ["polygon", "w", "e", "s", "n"], "left_semi").select("polygon", "same_box")
    bad = ring_violations(after).select("polygon").distinct().withColumn("bad", F.lit(True))
    change = F.abs(F.col("b") - F.col("a")) / F.col("a")
    return a.join(b, "polygon").join(same, "polygon", "left").join(bad, "polygon", "left").select(
        "polygon", F.coalesce("same_box", F.lit(False)).alias("same_box"), change.alias("area_change"), (F.col("bad").isNull() & (change <= most_change) & F.col("same_box").isNotNull()).alias("valid")
    )
