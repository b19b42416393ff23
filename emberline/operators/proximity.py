"""Joins by nearness in space and time, as equality of grid cells plus an exact check."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.clean import hours_between
from emberline.functions.geo import haversine_km, planar_m
from emberline.runtime import cut

#: Both bounds are inclusive up to this relative slack; cells are wider by more than it.
SLACK = 1e-12


def _near_cells(name: str) -> Column:
    return F.explode(F.array(F.col(name) - 1, F.col(name), F.col(name) + 1))


def space_time_edges(points: DataFrame, radius_m: float, hours: float, id_col: str = "detection_id", ts: str = "ts") -> DataFrame:
    """(src, dst, distance_m, gap_hours) of unordered pairs with distance <= radius and time gap <= hours.

    Cells are four times as wide as the bounds. A row's neighbours are those behind it in time: it is
    sent to the cells that its reach touches (about three), and meets there the rows of the cell, so
    each pair meets once. The join is an equality on three integers, never a nested loop, and never a
    broadcast: Spark takes the spread side for as small as its file. Rows with a null coordinate or
    time have no edges.
    """
    r, t = radius_m * (1 + 1e-9), int(hours * 3.6e9)
    base = points.select(F.col(id_col).alias("id"), F.col("x_m").alias("x"), F.col("y_m").alias("y"), F.unix_micros(ts).alias("t")).where("x is not null and y is not null and t is not null")
    cell = lambda c, by=0: F.floor((F.col(c) + by) / (4 * r))
    slab = lambda by=0: F.floor((F.col("t") + by) / (4.0 * t + 4))
    left = base.select(F.col("id").alias("id1"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("t").alias("t1"), cell("x").alias("cx"), cell("y").alias("cy"), slab().alias("ct"))
    spread = base.withColumn("cx", F.explode(F.sequence(cell("x", -r), cell("x", r)))).withColumn("cy", F.explode(F.sequence(cell("y", -r), cell("y", r)))).withColumn("ct", F.explode(F.sequence(slab(-t), slab())))
    spread = spread.withColumnsRenamed({"id": "id2", "x": "x2", "y": "y2", "t": "t2"})
    distance = planar_m(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    gap = F.col("t2") - F.col("t1")
    behind = (gap > 0) | ((gap == 0) & (F.col("id1") < F.col("id2")))
    met = left.hint("merge").join(spread, ["cx", "cy", "ct"]).where(behind & (gap <= t) & (distance <= radius_m * (1 + SLACK)) & (F.col("id1") != F.col("id2")))
    return met.select(F.least("id1", "id2").alias("src"), F.greatest("id1", "id2").alias("dst"), distance.alias("distance_m"), (gap / 3.6e9).alias("gap_hours"))


def linking_edges(points: DataFrame, least_m: float, radius_m: float, hours: float, id_col: str = "detection_id", ts: str = "ts") -> DataFrame:
    """(src, dst, distance_m, gap_hours, place): fewer edges than all pairs, with the same components under every radius from ``least_m`` to ``radius_m`` and every window up to ``hours``.

    Points of one cell of side ``least_m`` / sqrt(2) are always near enough, so there only each two
    consecutive in time are linked: of any two within a window, so are all between them. Cells are
    cut into slabs of time, sorted one by one, and a slab's last point is linked to the next one's
    first. Points of different cells are paired as they are, cell by cell with its occupied
    neighbours. ``place`` is a number of the wide square around an edge. Rows with a null coordinate
    or time have no edges.
    """
    side, span = least_m / math.sqrt(2) * (1 - 1e-9), int(hours * 3.6e9) + 1
    base = points.select(F.col(id_col).alias("id"), F.col("x_m").alias("x"), F.col("y_m").alias("y"), F.unix_micros(ts).alias("t")).where("x is not null and y is not null and t is not null")
    base = base.withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side), "ct": F.floor(F.col("t") / span)})
    point = F.struct("t", "id", "x", "y")
    order = Window.partitionBy("cx", "cy", "ct").orderBy("t", "id")
    inside = base.select(point.alias("a"), F.lag(point).over(order).alias("b")).where("b is not null")
    slabs = base.groupBy("cx", "cy", "ct").agg(F.min(point).alias("first"), F.max(point).alias("last"))
    between = slabs.select("cx", "cy", (F.col("ct") + 1).alias("ct"), F.col("last").alias("b")).join(slabs.select("cx", "cy", "ct", F.col("first").alias("a")), ["cx", "cy", "ct"]).select("a", "b")
    reach = math.ceil(radius_m / side)
    gap_cells = lambda d: max(0, abs(d) - 1) * side
    ahead = [(dx, dy) for dx in range(reach + 1) for dy in range(-reach, reach + 1) if (dx, dy) > (0, 0) and math.hypot(gap_cells(dx), gap_cells(dy)) <= radius_m * (1 + 1e-9)]
    offsets = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ahead]))
    cells = slabs.select("cx", "cy").distinct()
    occupied = cells.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"))
    beside = cells.withColumn("o", offsets).select("cx", "cy", (F.col("cx") + F.col("o.dx")).alias("nx"), (F.col("cy") + F.col("o.dy")).alias("ny")).join(occupied, ["nx", "ny"])
    left = base.select(point.alias("a"), "cx", "cy", "ct").join(beside, ["cx", "cy"]).select("a", "nx", "ny", "ct")
    right = base.select(point.alias("b"), F.col("cx").alias("nx"), F.col("cy").alias("ny"), _near_cells("ct").alias("ct"))
    across = left.join(right, ["nx", "ny", "ct"]).select("a", "b")
    pairs = inside.unionByName(between).unionByName(across)
    distance = planar_m(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))
    gap = F.abs(F.col("a.t") - F.col("b.t"))
    met = pairs.where((gap <= int(hours * 3.6e9)) & (distance <= radius_m * (1 + SLACK)))
    return met.select(F.least("a.id", "b.id").alias("src"), F.greatest("a.id", "b.id").alias("dst"), distance.alias("distance_m"), (gap / 3.6e9).alias("gap_hours"), F.xxhash64(*[F.floor(F.col(f"a.{c}") / (16 * radius_m)) for c in "xy"]).alias("place"))


def cross_source_pairs(points: DataFrame, km: float, minutes: float, id_col: str = "detection_id", source: str = "firms_source", ts: str = "ts") -> DataFrame:
    """(a, b, distance_km, gap_minutes): pairs of different sources within ``km`` and ``minutes``, both inclusive.

    Each band of latitude has a whole number of longitude cells around the globe, fewer towards the
    poles, each as wide as ``km`` can reach there; so neighbours meet at any latitude and across the
    date line.
    """
    lat_cell = km / 110.0
    base = points.select(F.col(id_col).alias("id"), F.col(source).alias("s"), "lon", "lat", F.unix_micros(ts).alias("t"))
    cells = base.withColumns({"cy": F.floor(F.col("lat") / lat_cell), "ct": F.floor(F.col("t") / (minutes * 6e7 + 1))})
    # 70 km a degree instead of 111: chords and their angles differ by up to pi / 2.
    far = F.least(F.lit(90.0), F.greatest(F.abs(F.col("cy") - 1), F.abs(F.col("cy") + 2)) * lat_cell)
    around = F.greatest(F.lit(1), F.floor(360 * 70.0 * F.cos(F.radians(far)) / km)).cast("long")
    place = F.pmod(F.floor((F.col("lon") + 180) / 360 * F.col("n")), F.col("n"))
    left = cells.withColumn("n", around).withColumn("cx", place).select(*[F.col(c).alias(f"{c}1") for c in ("id", "s", "lon", "lat", "t")], "cx", "cy", "ct")
    spread = cells.withColumn("ct", _near_cells("ct")).withColumn("cy", _near_cells("cy")).withColumn("n", around).withColumn("cx", place)
    spread = spread.withColumn("cx", F.explode(F.array_distinct(F.array(*[F.pmod(F.col("cx") + d, F.col("n")) for d in (-1, 0, 1)]))))
    spread = spread.select(*[F.col(c).alias(f"{c}2") for c in ("id", "s", "lon", "lat", "t")], "cx", "cy", "ct")
    distance = haversine_km(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))
    gap = F.abs(F.col("t1") - F.col("t2"))
    met = left.join(spread, ["cx", "cy", "ct"]).where((F.col("s1") < F.col("s2")) & (gap <= int(minutes * 6e7)) & (distance <= km))
    return met.select(F.col("id1").alias("a"), F.col("id2").alias("b"), distance.alias("distance_km"), (gap / 6e7).alias("gap_minutes"))


def radius_interval_matches(events: DataFrame, references: DataFrame, radius_m: float, event: str = "event_id", reference: str = "reference_id") -> DataFrame:
    """Events x references with distance <= radius and overlapping intervals.

    ``events`` has x_m, y_m, start_ts, end_ts; ``references`` x_m, y_m and inclusive dates
    window_start, window_end. The cell join keeps the work local whatever the number of references.
    """
    r = radius_m * (1 + 1e-9)
    left = events.withColumns({"cx": F.floor(F.col("x_m") / r), "cy": F.floor(F.col("y_m") / r)})
    right = references.select(
        reference, F.col("x_m").alias("rx"), F.col("y_m").alias("ry"), F.col("window_start").cast("timestamp").alias("win_start"), F.date_add("window_end", 1).cast("timestamp").alias("win_end")
    ).withColumns({"cx": F.floor(F.col("rx") / r), "cy": F.floor(F.col("ry") / r)})
    for c in ("cx", "cy"):
        right = right.withColumn(c, _near_cells(c))
    distance = planar_m(F.col("x_m"), F.col("y_m"), F.col("rx"), F.col("ry"))
    last = F.col("win_end") - F.expr("interval 1 microsecond")
    overlap = hours_between(F.greatest("start_ts", "win_start"), F.least(F.col("end_ts"), last))
    met = left.join(right, ["cx", "cy"]).where((F.col("start_ts") < F.col("win_end")) & (F.col("end_ts") >= F.col("win_start")) & (distance <= radius_m))
    return met.select(reference, event, distance.alias("distance_m"), overlap.alias("overlap_hours"), "start_ts", "end_ts")


#: Cells with more events than this are counted again at a quarter of their side, so many times at most.
CROWD, FINER = 4096, 10


def _windowed(references: DataFrame) -> DataFrame:
    """References with half-open times; no row is dropped."""
    return references.select("reference_id", F.col("x_m").alias("rx"), F.col("y_m").alias("ry"), F.col("window_start").cast("timestamp").alias("ws"), F.date_add("window_end", 1).cast("timestamp").alias("we"))


def _at(side: float | Column, x: str = "x_m", y: str = "y_m") -> dict[str, Column]:
    return {"cx": F.floor(F.col(x) / side), "cy": F.floor(F.col(y) / side)}


def _event_days(events: DataFrame) -> DataFrame:
    """``events`` once for each day of theirs, plus first_day."""
    a, b = F.col("start_ts").cast("date"), F.col("end_ts").cast("date")
    return events.withColumn("first_day", F.least(a, b)).withColumn("day", F.explode(F.sequence(F.least(a, b), F.greatest(a, b))))


def _window_days(refs: DataFrame) -> DataFrame:
    """``refs`` once for each day of their window, plus ws_day."""
    return refs.withColumn("ws_day", F.col("ws").cast("date")).withColumn("day", F.explode(F.sequence(F.col("ws_day"), F.date_sub(F.col("we").cast("date"), 1))))


#: An event and a window meet on the first day that both have, and so once.
ONCE = "day = greatest(first_day, ws_day) and start_ts < we and end_ts >= ws"


def _contemporaneous(events: DataFrame, refs: DataFrame) -> DataFrame:
    """``refs`` plus contemporaneous: how many events fall into each window.

    Windows are whole days, so this is a difference of running counts of starts and ends by day.
    """
    days = events.select(F.col("start_ts").cast("date").alias("day"), F.lit(1).alias("begun"), F.lit(0).alias("over")).unionByName(events.select(F.col("end_ts").cast("date").alias("day"), F.lit(0).alias("begun"), F.lit(1).alias("over")))
    asked = refs.select(F.col("ws").cast("date").alias("day")).unionByName(refs.select(F.col("we").cast("date").alias("day"))).select("day", F.lit(0).alias("begun"), F.lit(0).alias("over"))
    before = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    by_day = days.unionByName(asked).where("day is not null").groupBy("day").agg(F.sum("begun").alias("begun"), F.sum("over").alias("over"))
    by_day = cut(by_day.select("day", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("begun", "over")]))
    begun, over = by_day.select(F.col("day").alias("we_day"), "begun"), by_day.select(F.col("day").alias("ws_day"), "over")
    counted = refs.withColumns({"ws_day": F.col("ws").cast("date"), "we_day": F.col("we").cast("date")}).join(begun, "we_day", "left").join(over, "ws_day", "left")
    return counted.select(*refs.columns, F.coalesce(F.col("begun") - F.col("over"), F.lit(0)).alias("contemporaneous"))


def _first_sides(places: DataFrame, refs: DataFrame, side: float, k: int, crowd: int) -> tuple[DataFrame, list[float]]:
    """``refs`` plus ``first``, the side of cells with which each begins, and the sides below ``side`` that occur.

    A reference in a crowded cell begins with twice the side of the smallest counted cell around it that has k events.
    """
    sides, inside, at = [], places, side
    refs = refs.withColumn("first", F.lit(side))
    counts = cut(inside.withColumns(_at(at)).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")))
    for _ in range(FINER):
        crowded = counts.where(F.col("n") > crowd)
        if crowded.isEmpty():
            break
        inside = inside.withColumns(_at(at)).join(crowded.select("cx", "cy"), ["cx", "cy"], "left_semi").select(places.columns)
        at /= 4
        counts = cut(inside.withColumns(_at(at)).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")))
        known = counts.where(F.col("n") >= k).select("cx", "cy", F.lit(2 * at).alias("finer"))
        refs = cut(refs.withColumns(_at(at, "rx", "ry")).join(known, ["cx", "cy"], "left").withColumn("first", F.coalesce("finer", "first")).drop("cx", "cy", "finer"))
        sides.append(2 * at)
    return refs, sorted(sides)


def nearest(events: DataFrame, references: DataFrame, k: int = 10, temporal: bool = False, crowd: int = CROWD) -> DataFrame:
    """(reference_id, event_id, distance_m, rank): the k nearest events of every reference, ties by id.

    A reference looks at the nine cells around it, which hold every event within one side. If its kth
    distance is no longer than that, or nothing lies beyond, it is done; only the others go on, with
    cells twice as wide. Sides begin at the mean density, in crowded places below it. With windows,
    events are also met by days, a reference without any event in its window never looks, and one with
    fewer than k is done with all of them. Rows without a position, and references without any event
    to match, have no result.
    """
    places = cut(events.select("event_id", "x_m", "y_m", "start_ts", "end_ts").where("x_m is not null and y_m is not null"))
    box = places.agg(F.min("x_m").alias("w"), F.max("x_m").alias("e"), F.min("y_m").alias("s"), F.max("y_m").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    refs = _windowed(references).where("rx is not null and ry is not null")
    result = places.limit(0).join(refs.limit(0), F.lit(True)).select("reference_id", "event_id", F.lit(0.0).alias("distance_m"), F.lit(1).alias("rank"))
    if not box["rows"]:
        return result
    wide, high = box["e"] - box["w"], box["n"] - box["s"]
    side = max(math.sqrt(wide * high * k / box["rows"]), max(wide, high) * k / box["rows"], max(wide, high) * 2.0**-24, 1e-6)
    far = F.hypot(F.greatest(F.abs(F.col("rx") - box["w"]), F.abs(F.col("rx") - box["e"])), F.greatest(F.abs(F.col("ry") - box["s"]), F.abs(F.col("ry") - box["n"])))
    refs = refs.withColumn("far", far).withColumn("most", F.lit(k))
    if temporal:
        # A window that ends before it begins has no count of that kind; it goes on until nothing lies beyond.
        refs = _contemporaneous(places, refs).withColumn("most", F.when(F.col("ws") < F.col("we"), F.least(F.lit(k), F.col("contemporaneous"))).otherwise(k)).where("most > 0").drop("contemporaneous")
    refs, sides = _first_sides(places, cut(refs), side, k, crowd)
    held = cut(_event_days(places)) if temporal else places
    pending, final = refs, Window.partitionBy("reference_id").orderBy("distance_m", "event_id")
    while not pending.isEmpty():
        at = sides.pop(0) if sides else side
        side = side if at < side else 2 * side
        looking = pending.where(F.col("first") <= at).withColumns(_at(at, "rx", "ry"))
        for c in ("cx", "cy"):
            looking = looking.withColumn(c, _near_cells(c))
        if temporal:
            met = held.withColumns(_at(at)).hint("merge").join(_window_days(looking), ["cx", "cy", "day"]).where(ONCE)
        else:
            met = held.withColumns(_at(at)).join(looking, ["cx", "cy"])
        met = met.select("reference_id", "event_id", planar_m(F.col("x_m"), F.col("y_m"), F.col("rx"), F.col("ry")).alias("distance_m"), "most")
        best = cut(met.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k))
        safe = at * (1 - 1e-9)
        done = best.where((F.col("rank") == F.col("most")) & (F.col("distance_m") <= safe)).select("reference_id").unionByName(pending.where((F.col("far") <= safe) & (F.col("first") <= at)).select("reference_id")).distinct()
        result = cut(result.unionByName(best.join(done, "reference_id", "left_semi").drop("most")))
        pending = cut(pending.join(done, "reference_id", "left_anti"))
    return result


def radius_audit(events: DataFrame, references: DataFrame, radii_m: list[float]) -> DataFrame:
    """Per reference: how many events fall into its window, how many of them lie within each radius, and the closest of them.

    The radii are counted in cells of the largest one, day by day; the closest is a search by widening
    cells.
    """
    refs, widest = _windowed(references), max(radii_m)
    counted = _contemporaneous(events, refs).select("reference_id", "contemporaneous")
    looking = refs.withColumns(_at(widest * (1 + 1e-9), "rx", "ry"))
    for c in ("cx", "cy"):
        looking = looking.withColumn(c, _near_cells(c))
    held = _event_days(events.select("event_id", "x_m", "y_m", "start_ts", "end_ts").where("x_m is not null and y_m is not null"))
    met = held.withColumns(_at(widest * (1 + 1e-9))).hint("merge").join(_window_days(looking), ["cx", "cy", "day"]).where(ONCE)
    d = planar_m(F.col("x_m"), F.col("y_m"), F.col("rx"), F.col("ry"))
    names = [f"within_{int(r)}_m" for r in radii_m]
    within = met.groupBy("reference_id").agg(*[F.count_if(d <= r).alias(n) for r, n in zip(radii_m, names)])
    closest = nearest(events, references, 1, temporal=True).select("reference_id", F.col("distance_m").alias("closest_m"), F.col("event_id").alias("closest_event"))
    out = counted.join(within, "reference_id", "left").join(closest, "reference_id", "left")
    return out.select("reference_id", "contemporaneous", *[F.coalesce(n, F.lit(0)).alias(n) for n in names], "closest_m", "closest_event")
