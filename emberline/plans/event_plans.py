"""Events: edges, components, summaries, flags, settings and their stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions.geo import projected_distance_m, utm_forward, utm_inverse
from emberline.operators import events as E
from emberline.operators.proximity import space_time_edges
from emberline.plans.base import COMPONENTS, DETECTIONS, Book, detections, edges_sql
from emberline.runtime import store

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles

ONE = E.Setting(1500, 6)
GRID = [E.Setting(r, h) for r in (375, 750, 1500) for h in (3, 6)]
_one_edges = edges_sql(1500, 6)
_one = f"""WITH RECURSIVE {DETECTIONS}, {_one_edges},
own AS (SELECT 'r1500_t06' AS configuration_id, src, dst FROM edges), ids AS (SELECT 'r1500_t06' AS configuration_id, detection_id FROM det), {COMPONENTS}"""
_grid = f"""WITH RECURSIVE {DETECTIONS}, {edges_sql(1500, 6)},
grid AS (SELECT printf('r%04d_t%02d', r, h) AS configuration_id, CAST(r AS DOUBLE) AS radius_m, CAST(h AS DOUBLE) AS hours FROM (VALUES (375), (750), (1500)) a(r), (VALUES (3), (6)) b(h)),
own AS (SELECT configuration_id, src, dst FROM edges JOIN grid ON distance_m <= radius_m * (1 + 1e-12) AND gap_hours <= hours),
ids AS (SELECT configuration_id, detection_id FROM det, grid), {COMPONENTS}"""
_event_columns = """
  min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS detection_count, list_sort(list_distinct(list(firms_source))) AS sources, list_sort(list_distinct(list(satellite))) AS satellites,
  avg(lat) AS centroid_lat, avg(lon) AS centroid_lon, min(lon) AS bbox_w, min(lat) AS bbox_s, max(lon) AS bbox_e, max(lat) AS bbox_n, coalesce(max(gap), 0) AS max_gap_hours,
  min(frp) AS frp_min, max(frp) AS frp_max, avg(frp) AS frp_mean, median(frp) AS frp_median, sum(frp) AS frp_sum,
  avg(CASE WHEN daynight = 'D' THEN 1.0 ELSE 0.0 END) AS day_fraction, count(*) FILTER (daynight IN ('D', 'N')) AS daynight_known_count,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS duration_hours, date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1 AS calendar_days"""
_events = f"""joined AS (SELECT m.configuration_id, m.component, d.*, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY m.configuration_id, m.component ORDER BY ts, d.detection_id))) / 3.6e9 AS gap FROM mem m JOIN det d USING (detection_id)),
ev AS (SELECT configuration_id, component, {_event_columns} FROM joined GROUP BY ALL)"""
_extent = """ext AS (
  SELECT a.configuration_id, a.component, max(sqrt((a.x_m - b.x_m) ** 2 + (a.y_m - b.y_m) ** 2)) AS max_pairwise_distance_m FROM (SELECT DISTINCT configuration_id, component, x_m, y_m FROM joined) a
  JOIN (SELECT DISTINCT configuration_id, component, x_m, y_m FROM joined) b USING (configuration_id, component) GROUP BY ALL),
mid AS (SELECT configuration_id, component, avg(x_m) AS mx, avg(y_m) AS my FROM joined GROUP BY ALL),
far AS (SELECT configuration_id, component, max(sqrt((x_m - mx) ** 2 + (y_m - my) ** 2)) AS max_distance_to_centroid_m FROM joined JOIN mid USING (configuration_id, component) GROUP BY ALL)"""
_flags = """tot AS (SELECT configuration_id, sum(detection_count) AS total, median(max_pairwise_distance_m) FILTER (max_pairwise_distance_m > 0) AS typical FROM ev JOIN ext USING (configuration_id, component) GROUP BY ALL),
flagged AS (
  SELECT e.*, x.max_pairwise_distance_m, g.radius_m, g.hours,
    list_filter([CASE WHEN duration_hours > 72 THEN 'duration_over_72h' END, CASE WHEN duration_hours > 168 THEN 'duration_over_168h' END,
      CASE WHEN max_pairwise_distance_m > 3 * radius_m THEN 'spatial_extent_over_3x_radius' END, CASE WHEN max_gap_hours >= 0.8 * hours THEN 'near_temporal_gap_limit' END,
      CASE WHEN detection_count / total >= 0.25 THEN 'large_cohort_share' END, CASE WHEN calendar_days > 1 THEN 'multi_day_event' END,
      CASE WHEN max_pairwise_distance_m > 3 * typical THEN 'exceptional_extent_vs_configuration_median' END], lambda r: r IS NOT NULL) AS reasons,
    detection_count / total >= 0.5 OR duration_hours > 168 OR max_pairwise_distance_m > 10 * radius_m AS mega
  FROM ev e JOIN ext x USING (configuration_id, component) JOIN grid g USING (configuration_id) JOIN tot USING (configuration_id))"""
_stab = """own_pairs AS (SELECT configuration_id, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pairs, count(*) AS events FROM (SELECT configuration_id, component, count(*) AS n FROM mem GROUP BY ALL) GROUP BY ALL),
near AS (
  SELECT configuration_id AS a, lead(configuration_id) OVER (PARTITION BY radius_m ORDER BY hours) AS b, 'time_window' AS axis FROM grid
  UNION ALL SELECT configuration_id, lead(configuration_id) OVER (PARTITION BY hours ORDER BY radius_m), 'radius' FROM grid),
shared AS (
  SELECT a, b, axis, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS common FROM (
    SELECT near.a, near.b, axis, l.component AS ca, r.component AS cb, count(*) AS n FROM near JOIN mem l ON l.configuration_id = near.a JOIN mem r ON r.configuration_id = near.b AND r.detection_id = l.detection_id GROUP BY ALL)
  GROUP BY ALL),
stab AS (
  SELECT a AS configuration_id_a, b AS configuration_id_b, axis, l.events AS event_count_a, r.events AS event_count_b, r.events - l.events AS event_count_change,
    CASE WHEN l.pairs > 0 THEN common / l.pairs END AS pair_retention_rate, CASE WHEN l.pairs + r.pairs - common > 0 THEN common / (l.pairs + r.pairs - common) ELSE 1.0 END AS jaccard_coassignment
  FROM shared JOIN own_pairs l ON l.configuration_id = a JOIN own_pairs r ON r.configuration_id = b)"""


def _members(spark, sf_dir, settings):
    return store(E.members(detections(spark, sf_dir), settings))


def _measured(spark, sf_dir, settings):
    """Members and their events with extents."""
    members = _members(spark, sf_dir, settings)
    keys = ["configuration_id", "component"]
    return members, E.summarise(members, keys).join(E.extents(members, keys), keys)


#: What flags and summaries of settings need of an event.
_FLAGGED = ["configuration_id", "component", "detection_count", "duration_hours", "max_gap_hours", "max_pairwise_distance_m", "multi_source", "both_sensors", "crosses_midnight", "multi_day"]


def _flagged(spark, sf_dir, settings, columns=None):
    members, events = _measured(spark, sf_dir, settings)
    return members, E.chain_flags(events.select(*columns) if columns else events, F.broadcast(E.settings_frame(spark, settings)))


def _rounded(df, digits=6):
    kinds = dict(df.dtypes)
    return df.select([F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


@BOOK.query(f"WITH {DETECTIONS}, {_one_edges} SELECT src, dst, round(distance_m, 6) AS distance_m, round(gap_hours, 6) AS gap_hours FROM edges")
def st_edges(spark, sf_dir):
    return _rounded(space_time_edges(detections(spark, sf_dir), 1500, 6))


@BOOK.query(f"{_one} SELECT detection_id, component FROM mem")
def st_components(spark, sf_dir):
    return E.memberships(detections(spark, sf_dir), [ONE]).select("detection_id", "component")


@BOOK.query(f"""{_one}, {_events} SELECT component, epoch_us(start_ts) AS start_us, epoch_us(end_ts) AS end_us, detection_count, array_to_string(sources, ',') AS sources, array_to_string(satellites, ',') AS satellites,
  round(centroid_lat, 10) AS centroid_lat, round(centroid_lon, 10) AS centroid_lon, round(bbox_w, 6) AS bbox_w, round(bbox_n, 6) AS bbox_n, round(max_gap_hours, 6) AS max_gap_hours, frp_min, frp_max,
  round(frp_mean, 9) AS frp_mean, round(frp_median, 6) AS frp_median, round(frp_sum, 6) AS frp_sum, round(day_fraction, 6) AS day_fraction, daynight_known_count, round(duration_hours, 6) AS duration_hours, calendar_days,
  len(sources) = 2 AS both_sensors, calendar_days > 1 AS multi_day FROM ev""")
def event_summary(spark, sf_dir):
    out = E.summarise(_members(spark, sf_dir, [ONE]), ["component"])
    return out.select(
        "component", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), "detection_count", F.array_join("sources", ",").alias("sources"), F.array_join("satellites", ",").alias("satellites"),
        *[F.round(c, 10 if c.startswith("c") else 6).alias(c) for c in ("centroid_lat", "centroid_lon", "bbox_w", "bbox_n", "max_gap_hours")], "frp_min", "frp_max",
        *[F.round(c, 9 if c == "frp_mean" else 6).alias(c) for c in ("frp_mean", "frp_median", "frp_sum", "day_fraction")], "daynight_known_count", F.round("duration_hours", 6).alias("duration_hours"), F.col("calendar_days").cast("long").alias("calendar_days"),
        "both_sensors", "multi_day",
    )


@BOOK.query(f"""{_one}, {_events}, {_extent} SELECT component, round(max_pairwise_distance_m, 4) AS max_pairwise_distance_m, round(max_distance_to_centroid_m, 4) AS max_distance_to_centroid_m
  FROM ext JOIN far USING (configuration_id, component)""")
def event_extent(spark, sf_dir):
    return _rounded(E.extents(_members(spark, sf_dir, [ONE]), ["component"]), 4)


@BOOK.query(f"""{_one}, {_events} SELECT component, string_agg(v || '=' || CAST(n AS VARCHAR), ',' ORDER BY v) AS confidence_counts
  FROM (SELECT component, confidence_raw AS v, count(*) AS n FROM joined WHERE confidence_raw <> '' GROUP BY ALL) GROUP BY component""")
def confidence_counts(spark, sf_dir):
    out = E.value_counts_map(_members(spark, sf_dir, [ONE]), ["component"], F.col("confidence_raw"), "m")
    text = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("component", text.alias("confidence_counts"))


@BOOK.query(f"""{_grid}, {_events}, {_extent}, {_flags} SELECT configuration_id, component, array_to_string(reasons, ',') AS chain_merge_reasons, len(reasons) > 0 AS possible_chain_merge, mega FROM flagged""")
def chain_flags(spark, sf_dir):
    return _flagged(spark, sf_dir, GRID, _FLAGGED)[1].select("configuration_id", "component", F.array_join("chain_merge_reasons", ",").alias("chain_merge_reasons"), "possible_chain_merge", "mega")


@BOOK.query(f"""{_grid}, {_events}, {_extent}, {_flags} SELECT configuration_id, count(*) AS event_count, count(*) FILTER (detection_count = 1) AS singleton_count,
  round(100.0 * count(*) FILTER (detection_count = 1) / count(*), 6) AS singleton_rate_pct, CAST(median(detection_count) AS DOUBLE) AS median_detection_count, round(avg(detection_count), 6) AS mean_detection_count,
  quantile_disc(detection_count, 0.95) AS p95_detection_count, max(detection_count) AS max_detection_count, round(median(duration_hours), 6) AS median_duration_hours, round(quantile_disc(duration_hours, 0.95), 6) AS p95_duration_hours,
  round(median(max_pairwise_distance_m), 4) AS median_spatial_extent_m, round(quantile_disc(max_pairwise_distance_m, 0.95), 4) AS p95_spatial_extent_m, count(*) FILTER (len(sources) > 1) AS events_multiple_sources,
  count(*) FILTER (calendar_days > 1) AS events_multi_day, count(*) FILTER (len(reasons) > 0) AS events_possible_chain_merge, round(100.0 * max(detection_count) / sum(detection_count), 6) AS largest_event_share_pct,
  CAST(sum(detection_count) AS BIGINT) AS detection_count_total, bool_or(mega) AS mega_cluster_detected FROM flagged GROUP BY configuration_id""")
def config_summary(spark, sf_dir):
    s = E.configuration_summary(_flagged(spark, sf_dir, GRID, _FLAGGED)[1])
    r = lambda c, n=6: F.round(c, n).alias(c)
    return s.select(
        "configuration_id", "event_count", "singleton_count", r("singleton_rate_pct"), "median_detection_count", r("mean_detection_count"), "p95_detection_count", "max_detection_count", r("median_duration_hours"), r("p95_duration_hours"),
        r("median_spatial_extent_m", 4), r("p95_spatial_extent_m", 4), "events_multiple_sources", "events_multi_day", "events_possible_chain_merge", r("largest_event_share_pct"), "detection_count_total", "mega_cluster_detected",
    )


@BOOK.query(f"{_one} SELECT a.detection_id AS a, b.detection_id AS b FROM mem a JOIN mem b USING (component) WHERE a.detection_id < b.detection_id")
def coassign_pairs(spark, sf_dir):
    return E.coassigned_pairs(E.memberships(detections(spark, sf_dir), [ONE])).select("a", "b")


@BOOK.query(f"""{_grid}, {_stab} SELECT configuration_id_a, configuration_id_b, axis, event_count_a, event_count_b, event_count_change, round(pair_retention_rate, 6) AS pair_retention_rate, round(jaccard_coassignment, 6) AS jaccard_coassignment FROM stab""")
def stability(spark, sf_dir):
    return _rounded(E.stability(store(E.memberships(detections(spark, sf_dir), GRID)), E.settings_frame(spark, GRID)))


@BOOK.query(f"""{_grid}, {_events}, {_extent}, {_flags}, {_stab},
mean AS (SELECT configuration_id, avg(j) AS m FROM (SELECT configuration_id_a AS configuration_id, jaccard_coassignment AS j FROM stab UNION ALL SELECT configuration_id_b, jaccard_coassignment FROM stab) GROUP BY ALL)
SELECT configuration_id, bool_or(mega) AS mega_cluster_detected, round(any_value(m), 6) AS mean_neighbor_jaccard, round(100.0 * count(*) FILTER (len(reasons) > 0) / count(*), 6) AS chain_rate_pct
FROM flagged JOIN mean USING (configuration_id) GROUP BY configuration_id ORDER BY 2, any_value(m) DESC, 4, 1 LIMIT 3""")
def candidates(spark, sf_dir):
    members, flagged = _flagged(spark, sf_dir, GRID, _FLAGGED)
    stable = E.stability(members.select("configuration_id", "detection_id", "component"), E.settings_frame(spark, GRID))
    return _rounded(E.candidates(stable, E.configuration_summary(flagged)))


@BOOK.query(f"""{_grid}, {_events}, {_extent}, long AS (
  SELECT configuration_id, component AS event_id, unnest(['detection_count', 'duration_hours', 'frp_max', 'max_pairwise_distance_m', 'max_gap_hours', 'frp_sum']) AS criterion,
    unnest([CAST(detection_count AS DOUBLE), duration_hours, frp_max, max_pairwise_distance_m, max_gap_hours, round(frp_sum, 6)]) AS value FROM ev JOIN ext USING (configuration_id, component))
SELECT configuration_id, criterion, event_id, round(value, 4) AS value, CAST(row_number() OVER (PARTITION BY configuration_id, criterion ORDER BY value DESC, event_id) AS INTEGER) AS place FROM long
QUALIFY place <= 5""")
def extremes(spark, sf_dir):
    _, events = _measured(spark, sf_dir, GRID)
    rows = events.withColumn("event_id", F.col("component")).withColumn("frp_sum", F.round("frp_sum", 6))
    return _rounded(E.extremes(rows, ["detection_count", "duration_hours", "frp_max", "max_pairwise_distance_m", "max_gap_hours", "frp_sum"]), 4)


@BOOK.query(f"""{_grid}, {_events} SELECT configuration_id, component, detection_count FROM ev ORDER BY detection_count DESC, configuration_id, component LIMIT 10""")
def largest_events(spark, sf_dir):
    sizes = E.memberships(detections(spark, sf_dir), GRID).groupBy("configuration_id", "component").agg(F.count(F.lit(1)).alias("detection_count"))
    return sizes.orderBy(F.desc("detection_count"), "configuration_id", "component").limit(10)


@BOOK.query(f"""{_one} SELECT component, 'event-r1500_t06-' || substr(sha256('r1500_t06' || chr(0) || string_agg(detection_id, chr(0) ORDER BY detection_id)), 1, 16) AS event_id FROM mem GROUP BY component""")
def event_ids(spark, sf_dir):
    return E.event_names(E.memberships(detections(spark, sf_dir), [ONE])).select("component", "event_id")


_utm = """SELECT detection_id, s, c, t, {sm} / sqrt(1 - {e2} * s * s) AS n, {ep2} * c * c AS eta, c * (radians(lon) - radians(-81.0)) AS a,
  {sm} * ((1 - {e2} / 4 - 3 * {e2} ** 2 / 64 - 5 * {e2} ** 3 / 256) * phi - (3 * {e2} / 8 + 3 * {e2} ** 2 / 32 + 45 * {e2} ** 3 / 1024) * sin(2 * phi) + (15 * {e2} ** 2 / 256 + 45 * {e2} ** 3 / 1024) * sin(4 * phi) - (35 * {e2} ** 3 / 3072) * sin(6 * phi)) AS arc, tan(phi) AS tn
  FROM (SELECT detection_id, lon, radians(lat) AS phi, sin(radians(lat)) AS s, cos(radians(lat)) AS c, tan(radians(lat)) ** 2 AS t FROM det)""".format(sm=6378137.0, e2=0.0066943799901413165, ep2=0.0066943799901413165 / (1 - 0.0066943799901413165))


@BOOK.query(f"""WITH {DETECTIONS}, u AS ({_utm}) SELECT detection_id,
  round(500000.0 + 0.9996 * n * (a + (1 - t + eta) * a ** 3 / 6 + (5 - 18 * t + t * t + 72 * eta - 58 * 0.006739496742276434) * a ** 5 / 120), 3) AS easting,
  round(0.9996 * (arc + n * tn * (a ** 2 / 2 + (5 - t + 9 * eta + 4 * eta * eta) * a ** 4 / 24 + (61 - 58 * t + t * t + 600 * eta - 330 * 0.006739496742276434) * a ** 6 / 720)), 3) AS northing FROM u""")
def utm_forward_of_detections(spark, sf_dir):
    e, n = utm_forward(F.col("lon"), F.col("lat"))
    return detections(spark, sf_dir).select("detection_id", F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"))


@BOOK.query(f"WITH {DETECTIONS} SELECT detection_id, round(lon, 6) AS longitude, round(lat, 6) AS latitude FROM det")
def utm_round_trip(spark, sf_dir):
    lon, lat = utm_inverse(*utm_forward(F.col("lon"), F.col("lat")))
    return detections(spark, sf_dir).select("detection_id", F.round(lon, 6).alias("longitude"), F.round(lat, 6).alias("latitude"))


def golden_distance(spark):
    """The published pair of points, 3,076.389 m apart."""
    p = [F.lit(x) for x in (-80.433333, 8.516667, -80.46034667, 8.50952)]
    return spark.range(1).select(projected_distance_m(*p).alias("d"))



