"""From detections to events: components in space and time, their summaries and their stability."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.clean import hours_between
from emberline.functions.geo import planar_m
from emberline.operators.components import component_roots
from emberline.operators.proximity import linking_edges
from emberline.operators.quantiles import with_quantiles
from emberline.runtime import store


@dataclass(frozen=True)
class Setting:
    """A radius and a time window; events are components under both."""

    radius_m: int
    hours: int

    @property
    def name(self) -> str:
        return f"r{self.radius_m:04d}_t{self.hours:02d}"


def settings_frame(spark, settings: list[Setting]) -> DataFrame:
    return spark.createDataFrame([(s.name, float(s.radius_m), float(s.hours)) for s in settings], "configuration_id string, radius_m double, hours double")


def members(detections: DataFrame, settings: list[Setting]) -> DataFrame:
    """``detections`` once per setting, plus configuration_id and component.

    Linking edges are found once, for all radii up to the largest and the widest window; each setting
    keeps those within its own bounds, and the components of all settings are solved in one loop. A
    detection meets its components of all settings at once and is repeated only after that join.
    """
    spark = detections.sparkSession
    radii = [s.radius_m for s in settings]
    edges = store(linking_edges(detections, min(radii), max(radii), max(s.hours for s in settings)))
    grid = F.broadcast(settings_frame(spark, settings))  # one row per setting
    own = edges.join(grid, (edges.distance_m <= grid.radius_m * (1 + 1e-12)) & (edges.gap_hours <= grid.hours)).select("configuration_id", "src", "dst", "place")
    roots = component_roots(own, keys=["configuration_id"], near="place").groupBy("id").agg(F.collect_list(F.struct("configuration_id", "component")).alias("__found"))
    rows = detections.join(roots.withColumnRenamed("id", "__id"), F.col("detection_id") == F.col("__id"), "left").drop("__id")
    rows = rows.withColumn("configuration_id", F.explode(F.array(*[F.lit(s.name) for s in settings])))
    found = F.filter("__found", lambda f: f["configuration_id"] == F.col("configuration_id"))
    return rows.withColumn("component", F.coalesce(F.get(found, F.lit(0))["component"], F.col("detection_id"))).drop("__found")


def memberships(detections: DataFrame, settings: list[Setting]) -> DataFrame:
    """(configuration_id, detection_id, component) for every setting."""
    return members(detections, settings).select("configuration_id", "detection_id", "component")


def event_names(members: DataFrame) -> DataFrame:
    """(configuration_id, component, event_id): an id that depends on the member ids alone."""
    ids = F.array_join(F.array_sort(F.collect_list("detection_id")), "\x00")
    digest = F.sha2(F.concat(F.col("configuration_id"), F.lit("\x00"), ids), 256)
    return members.groupBy("configuration_id", "component").agg(F.concat(F.lit("event-"), F.first("configuration_id"), F.lit("-"), F.substring(digest, 1, 16)).alias("event_id"))


#: Directions in which the width of an event bounds its largest distance from below, to within 0.5 %.
DIRECTIONS = 16


def extents(members: DataFrame, keys: list[str]) -> DataFrame:
    """Per event the largest distance of two members, and of a member from the projected centroid.

    Both ends of the largest distance lie at least that distance less the radius from the middle, so
    only points near the rim are paired: first the event's widths in some directions are taken, then
    its radius. Of the rim only the lowest and highest point of each abscissa, and of those the
    first and last of each ordinate, can be hull vertices.
    """
    points = members.select(*keys, "x_m", "y_m")
    angles = [(math.cos(math.pi * i / DIRECTIONS), math.sin(math.pi * i / DIRECTIONS)) for i in range(DIRECTIONS)]
    widths = [F.max(F.col("x_m") * c + F.col("y_m") * s) - F.min(F.col("x_m") * c + F.col("y_m") * s) for c, s in angles]
    shape = points.groupBy(*keys).agg(
        F.avg("x_m").alias("mx"), F.avg("y_m").alias("my"), ((F.min("x_m") + F.max("x_m")) / 2).alias("bx"), ((F.min("y_m") + F.max("y_m")) / 2).alias("by"), F.greatest(*widths).alias("width")
    )
    placed = points.join(shape, keys).withColumn("from_middle", planar_m(F.col("x_m"), F.col("y_m"), F.col("bx"), F.col("by")))
    far = placed.groupBy(*keys).agg(F.max(planar_m(F.col("x_m"), F.col("y_m"), F.col("mx"), F.col("my"))).alias("max_distance_to_centroid_m"), F.max("from_middle").alias("radius"))
    rim = placed.where("width > 0").join(far, keys).where(F.col("from_middle") >= F.col("width") - F.col("radius") - 1e-6 * (1 + F.col("radius")))
    by_x = rim.groupBy(*keys, "x_m").agg(F.array_distinct(F.array(F.min("y_m"), F.max("y_m"))).alias("ys")).select(*keys, "x_m", F.explode("ys").alias("y_m"))
    hull = by_x.groupBy(*keys, "y_m").agg(F.array_distinct(F.array(F.min("x_m"), F.max("x_m"))).alias("xs")).select(*keys, F.explode("xs").alias("x1"), F.col("y_m").alias("y1"))
    pairs = hull.join(hull.withColumnsRenamed({"x1": "x2", "y1": "y2"}), keys)
    widest = pairs.groupBy(*keys).agg(F.max(planar_m(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).alias("max_pairwise_distance_m"))
    return far.drop("radius").join(widest, keys, "left").withColumn("max_pairwise_distance_m", F.coalesce("max_pairwise_distance_m", F.lit(0.0)))


def value_counts_map(rows: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """Per key a map from value to count, in value order; nulls and empty strings left out."""
    some = rows.select(*keys, value.alias("__v")).where("__v is not null and __v <> ''").groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))
    return some.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__v", "__n")))).alias(out))


def summarise(members: DataFrame, keys: list[str], both: tuple[str, str] = ("VIIRS_NOAA20_SP", "VIIRS_SNPP_SP")) -> DataFrame:
    """One row per event: times, counts, sources, centroid, box, power, day share, gaps, date flags."""
    by_time = Window.partitionBy(*keys).orderBy("ts", "detection_id")
    rows = members.withColumn("gap", hours_between(F.lag("ts").over(by_time), F.col("ts")))
    some = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    known = F.count_if(F.col("daynight").isin("D", "N"))
    out = rows.groupBy(*keys).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("detection_count"),
        some("firms_source").alias("sources"), some("satellite").alias("satellites"),
        F.avg("lat").alias("centroid_lat"), F.avg("lon").alias("centroid_lon"), F.avg("x_m").alias("x_m"), F.avg("y_m").alias("y_m"),
        F.min("lon").alias("bbox_w"), F.min("lat").alias("bbox_s"), F.max("lon").alias("bbox_e"), F.max("lat").alias("bbox_n"),
        F.coalesce(F.max("gap"), F.lit(0.0)).alias("max_gap_hours"),
        F.min("frp").alias("frp_min"), F.max("frp").alias("frp_max"), F.avg("frp").alias("frp_mean"), F.median("frp").alias("frp_median"), F.sum("frp").alias("frp_sum"),
        F.try_divide(F.count_if(F.col("daynight") == "D"), known).alias("day_fraction"), F.try_divide(F.count_if(F.col("daynight") == "N"), known).alias("night_fraction"), known.alias("daynight_known_count"),
    )
    days = F.datediff(F.col("end_ts").cast("date"), F.col("start_ts").cast("date")) + 1
    return out.withColumns({
        "duration_hours": hours_between(F.col("start_ts"), F.col("end_ts")), "source_count": F.size("sources").cast("long"), "satellite_count": F.size("satellites").cast("long"), "calendar_days": days,
        "multi_source": F.size("sources") > 1, "multi_sensor": F.size("satellites") > 1, "both_sensors": F.size(F.array_except(F.array(*[F.lit(b) for b in both]), "sources")) == 0,
        "crosses_midnight": days > 1, "multi_day": days > 1,
    })


def chain_flags(events: DataFrame, grid: DataFrame) -> DataFrame:
    """``events`` (with max_pairwise_distance_m) plus share, chain_merge_reasons, possible_chain_merge and mega."""
    events = store(events)
    whole = events.groupBy("configuration_id").agg(F.sum("detection_count").alias("__total"))
    whole = with_quantiles(whole, events.where("max_pairwise_distance_m > 0"), ["configuration_id"], {"__typical": ("max_pairwise_distance_m", 0.5, "linear")})
    rows = events.join(whole, "configuration_id").join(grid, "configuration_id")
    share, extent = F.col("detection_count") / F.col("__total"), F.col("max_pairwise_distance_m")
    rules = {
        "duration_over_72h": F.col("duration_hours") > 72,
        "duration_over_168h": F.col("duration_hours") > 168,
        "spatial_extent_over_3x_radius": extent > 3 * F.col("radius_m"),
        "near_temporal_gap_limit": F.col("max_gap_hours") >= 0.8 * F.col("hours"),
        "large_cohort_share": share >= 0.25,
        "multi_day_event": F.col("multi_day"),
        "exceptional_extent_vs_configuration_median": extent > 3 * F.col("__typical"),
    }
    reasons = F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))
    mega = (share >= 0.5) | (F.col("duration_hours") > 168) | (extent > 10 * F.col("radius_m"))
    return rows.withColumns({"share": share, "chain_merge_reasons": reasons, "possible_chain_merge": F.size(reasons) > 0, "mega": mega}).drop("__total", "__typical")


def configuration_summary(events: DataFrame) -> DataFrame:
    """One row per setting over flagged events."""
    n, d, h, e = F.count(F.lit(1)), F.col("detection_count"), F.col("duration_hours"), F.col("max_pairwise_distance_m")
    measures = {"detection_count": "detection_count", "duration_hours": "duration_hours", "spatial_extent_m": "max_pairwise_distance_m"}
    ranks = {f"{q}_{n}": (c, p, kind) for n, c in measures.items() for q, p, kind in (("median", 0.5, "linear"), ("p95", 0.95, "nearest"))}
    out = events.groupBy("configuration_id", "radius_m", "hours").agg(
        n.alias("event_count"), F.count_if(d == 1).alias("singleton_count"), (100.0 * F.count_if(d == 1) / n).alias("singleton_rate_pct"),
        F.min(d).alias("min_detection_count"), F.avg(d).alias("mean_detection_count"), F.max(d).alias("max_detection_count"),
        F.max(h).alias("max_duration_hours"), F.max(e).alias("max_spatial_extent_m"),
        F.count_if("multi_source").alias("events_multiple_sources"), F.count_if("both_sensors").alias("events_both_sensors"), F.count_if("crosses_midnight").alias("events_cross_midnight"),
        F.count_if("multi_day").alias("events_multi_day"), F.count_if("possible_chain_merge").alias("events_possible_chain_merge"),
        (100.0 * F.max(d) / F.sum(d)).alias("largest_event_share_pct"), F.sum(d).alias("detection_count_total"), F.bool_or("mega").alias("mega_cluster_detected"),
    )
    return with_quantiles(out, events, ["configuration_id", "radius_m", "hours"], ranks).withColumn("p95_detection_count", F.col("p95_detection_count").cast("long"))


def coassigned_pairs(members: DataFrame) -> DataFrame:
    """(configuration_id, a, b): unordered pairs of detections in one event."""
    left = members.select("configuration_id", "component", F.col("detection_id").alias("a"))
    right = members.select("configuration_id", "component", F.col("detection_id").alias("b"))
    return left.join(right, ["configuration_id", "component"]).where("a < b").select("configuration_id", "a", "b")


def neighbours(grid: DataFrame) -> DataFrame:
    """(configuration_id_a, configuration_id_b, axis): settings next to each other along either axis."""
    out = None
    for axis, fixed, moving in (("time_window", "radius_m", "hours"), ("radius", "hours", "radius_m")):
        step = grid.select(F.col("configuration_id").alias("configuration_id_a"), F.lead("configuration_id").over(Window.partitionBy(fixed).orderBy(moving)).alias("configuration_id_b"), F.lit(axis).alias("axis")).where("configuration_id_b is not null")
        out = step if out is None else out.unionByName(step)
    return out


def stability(members: DataFrame, grid: DataFrame) -> DataFrame:
    """Retention and Jaccard of the pairs of neighbouring settings, without listing pairs.

    A pair is together in both settings exactly if both detections share a cell of the two
    settings' cross table, so counts of n(n-1)/2 over events and over cells are enough. A detection's
    events of all settings are gathered once; neighbours are taken from that row.
    """
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2).cast("long")
    sizes = members.groupBy("configuration_id", "component").agg(F.count(F.lit(1)).alias("n"))
    own = sizes.groupBy("configuration_id").agg(pairs("n").alias("pairs"), F.count(F.lit(1)).alias("events"))
    near = neighbours(grid)
    held = members.groupBy("detection_id").agg(F.collect_list(F.struct("configuration_id", "component")).alias("held"))
    of = lambda c: F.get(F.filter("held", lambda h: h["configuration_id"] == F.col(c)), F.lit(0))["component"]
    crossed = held.crossJoin(F.broadcast(near)).select("configuration_id_a", "configuration_id_b", "axis", of("configuration_id_a").alias("ca"), of("configuration_id_b").alias("cb"))
    cells = crossed.where("ca is not null and cb is not null").groupBy("configuration_id_a", "configuration_id_b", "axis", "ca", "cb").agg(F.count(F.lit(1)).alias("n"))
    both = cells.groupBy("configuration_id_a", "configuration_id_b", "axis").agg(pairs("n").alias("both"))
    side = lambda s: own.select(F.col("configuration_id").alias(f"configuration_id_{s}"), F.col("pairs").alias(f"pairs_{s}"), F.col("events").alias(f"event_count_{s}"))
    out = both.join(side("a"), "configuration_id_a").join(side("b"), "configuration_id_b")
    union = F.col("pairs_a") + F.col("pairs_b") - F.col("both")
    return out.select(
        "configuration_id_a", "configuration_id_b", "axis", "event_count_a", "event_count_b", (F.col("event_count_b") - F.col("event_count_a")).alias("event_count_change"),
        F.try_divide(F.col("both"), F.col("pairs_a")).alias("pair_retention_rate"), F.coalesce(F.try_divide(F.col("both"), union), F.lit(1.0)).alias("jaccard_coassignment"),
    )


def candidates(stable: DataFrame, summary: DataFrame, best: int = 3) -> DataFrame:
    """The settings with the best mean neighbour Jaccard, then the lowest chain rate, without mega clusters first."""
    sides = stable.select(F.col("configuration_id_a").alias("configuration_id"), "jaccard_coassignment").unionByName(stable.select(F.col("configuration_id_b").alias("configuration_id"), "jaccard_coassignment"))
    mean = sides.groupBy("configuration_id").agg(F.avg("jaccard_coassignment").alias("mean_neighbor_jaccard"))
    rate = 100.0 * F.col("events_possible_chain_merge") / F.col("event_count")
    rows = summary.join(mean, "configuration_id").select("configuration_id", "mega_cluster_detected", "mean_neighbor_jaccard", rate.alias("chain_rate_pct"))
    return rows.orderBy("mega_cluster_detected", F.desc("mean_neighbor_jaccard"), "chain_rate_pct", "configuration_id").limit(best)


def extremes(events: DataFrame, criteria: list[str], top: int = 5) -> DataFrame:
    """(configuration_id, criterion, place, event_id, value): the largest events by each criterion."""
    long = events.select("configuration_id", "event_id", F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).cast("double").alias("value")) for c in criteria])).alias("m")).select("configuration_id", "event_id", "m.criterion", "m.value").where("value is not null")
    order = Window.partitionBy("configuration_id", "criterion").orderBy(F.desc("value"), "event_id")
    return long.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
