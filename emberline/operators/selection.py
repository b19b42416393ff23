"""Projections and lookups that tie the stages together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import clean

#: The frozen event table: its columns, and the event columns they come from.
FROZEN = {
    "configuration_id": "configuration_id", "event_id": "event_id", "start_timestamp_utc": "start_ts", "end_timestamp_utc": "end_ts", "duration_hours": "duration_hours", "detection_count": "detection_count", "source_count": "source_count",
    "centroid_latitude": "centroid_lat", "centroid_longitude": "centroid_lon", "frp_max": "frp_max", "frp_mean": "frp_mean", "frp_sum": "frp_sum", "day_fraction": "day_fraction", "night_fraction": "night_fraction",
}


def freeze(events: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """The allow-listed columns under their published names, in their published order."""
    return events.select(*[F.col(c).alias(n) for n, c in (columns or FROZEN).items()])


def events_near(events: DataFrame, x: float, y: float, radius_m: float, start: str, end: str) -> DataFrame:
    """Events within a circle that began in a period, numbered by start and id."""
    from emberline.operators.ranking import blocked

    d = F.hypot(F.col("x_m") - x, F.col("y_m") - y)
    box = F.col("x_m").between(x - radius_m, x + radius_m) & F.col("y_m").between(y - radius_m, y + radius_m)
    rows = events.where(box & (d <= radius_m) & F.col("start_ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))).withColumn("distance_m", d)
    return blocked(rows, [], F.col("start_ts").cast("date"), [F.col("start_ts"), F.col("event_id")], rank="number")


def three_way_status(events: DataFrame, usable: DataFrame, unusable: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, status): observed, not_observed or outside_cohort, by membership of two key sets."""
    flag = lambda d, n: d.select(key).distinct().withColumn(n, F.lit(True))
    rows = events.select(key).join(flag(usable, "__u"), key, "left").join(flag(unusable, "__n"), key, "left")
    return rows.select(key, F.when(F.col("__u"), "observed").when(F.col("__n"), "not_observed").otherwise("outside_cohort").alias("status"))


def sampled_members(sample: DataFrame, events: DataFrame, members: DataFrame) -> DataFrame:
    """Sampled events with their members nested, and whether the recorded count agrees."""
    nested = members.join(sample.select("event_id"), "event_id", "left_semi").groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("ts", "detection_id", "x_m", "y_m"))).alias("members"))
    rows = events.join(sample.select("event_id"), "event_id", "left_semi").join(nested, "event_id", "left")
    return rows.withColumn("count_agrees", F.coalesce(F.size("members") == F.col("detection_count"), F.lit(False)))


def normalised_scenes(scenes: DataFrame) -> DataFrame:
    """Scene rows with their keys in canonical form; a key that cannot be read is null."""
    return scenes.withColumns({"buffer_id": clean.buffer_key(F.col("buffer")), "role": clean.role_key(F.col("role")), "window_id": clean.window_key(F.col("window")), "combination_id": clean.combination_key(F.col("buffer"), F.col("window"))})


def with_area(rows: DataFrame, areas: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with aoi_area_m2; rows without an area keep null and are for the caller's contract."""
    return rows.join(areas.select(*keys, "aoi_area_m2"), keys, "left")


def aoi_areas(members: DataFrame, grid: DataFrame, keys: list[str], buffer_m: float, pixel_m: float) -> DataFrame:
    """(keys, aoi_area_m2): the area of the union of the members' buffers, counted on a pixel grid."""
    from emberline.operators.raster import support_pixels

    return support_pixels(grid, members, keys, buffer_m).groupBy(*keys).agg((F.count(F.lit(1)) * pixel_m**2).alias("aoi_area_m2"))


def cloud_fraction(clear_060: Column) -> Column:
    return 1.0 - clear_060


def day_night(day: Column, night: Column) -> Column:
    return F.struct(day.alias("day_fraction"), night.alias("night_fraction"), (day + night).alias("known_fraction_sum"))


def pixel_contract(pixels: DataFrame, scene: str, rows: int, columns: int, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """(check, key, message) of scenes whose grid or band ranges break the contract."""
    n = F.count(F.lit(1))
    checks = {"pixel_count": n != rows * columns, "row_range": (F.min("row") != 0) | (F.max("row") != rows - 1), "col_range": (F.min("col") != 0) | (F.max("col") != columns - 1), "repeated_pixel": F.count_distinct("row", "col") != n}
    checks |= {f"{b}_range": (F.min(b) < lo) | (F.max(b) > hi) for b, (lo, hi) in bands.items()}
    sums = pixels.groupBy(scene).agg(*[c.alias(k) for k, c in checks.items()])
    failed = F.array_compact(F.array(*[F.when(F.coalesce(F.col(k), F.lit(False)), k) for k in checks]))
    return sums.select(F.col(scene).cast("string").alias("key"), F.explode(failed).alias("check")).select("check", "key", F.concat(F.lit("violates "), "check").alias("message"))


def work_items(items: DataFrame, wanted: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The items of the wanted keys, at most ``most`` of each in the given order."""
    own = items.join(wanted.select(*keys).distinct(), keys, "left_semi")
    return own.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= most).drop("__n")
