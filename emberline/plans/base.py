"""Registering queries with their SQL twins, and the tables they stand on.

The driver's tables hold no geography, so detections, references, scenes and pixels are derived
from them by plain expressions, the same in Spark and in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.runtime import read_table


class Book:
    """Queries and oracles of one module."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            self.queries[name or f.__name__] = f
            if sql:
                self.oracles[name or f.__name__] = sql
            return f

        return add


#: SQL twin of detections().
DETECTIONS = """det AS (
  SELECT printf('d%08d', event_id) AS detection_id, ts, value AS frp, event_type AS satellite,
    CASE WHEN event_id % 2 = 0 THEN 'VIIRS_NOAA20_SP' ELSE 'VIIRS_SNPP_SP' END AS firms_source,
    CASE WHEN hour(ts) BETWEEN 6 AND 17 THEN 'D' ELSE 'N' END AS daynight,
    regexp_extract(props, '"k": ([0-9]+)', 1) AS confidence_raw,
    CAST(500000 + (user_id % 40) * 1700 + (event_id % 5) * 100 AS DOUBLE) AS x_m,
    CAST(940000 + (user_id // 40) * 1700 + (event_id % 3) * 100 AS DOUBLE) AS y_m,
    -80.99 + (user_id % 40) * 0.0155 + (event_id % 5) * 0.0009 AS lon,
    8.5 + (user_id // 40) * 0.0154 + (event_id % 3) * 0.0009 AS lat
  FROM events)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point detections on a grid of places, from the events table."""
    user, event = F.col("user_id"), F.col("event_id")
    row = F.floor(user / 40)
    hour = F.hour("ts")
    return read_table(spark, sf_dir, "events").select(
        F.format_string("d%08d", event).alias("detection_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("frp"), F.col("event_type").alias("satellite"),
        F.when(event % 2 == 0, "VIIRS_NOAA20_SP").otherwise("VIIRS_SNPP_SP").alias("firms_source"), F.when(hour.between(6, 17), "D").otherwise("N").alias("daynight"),
        F.regexp_extract("props", '"k": ([0-9]+)', 1).alias("confidence_raw"),
        (500000 + (user % 40) * 1700 + (event % 5) * 100).cast("double").alias("x_m"), (940000 + row * 1700 + (event % 3) * 100).cast("double").alias("y_m"),
        (F.lit(-80.99) + (user % 40) * 0.0155 + (event % 5) * 0.0009).alias("lon"), (F.lit(8.5) + row * 0.0154 + (event % 3) * 0.0009).alias("lat"),
    )


#: SQL twin of references().
REFERENCES = """refs AS (
  SELECT 'ref-' || CAST(r_regionkey AS VARCHAR) AS reference_id, CAST(500000 + r_regionkey * 13600 + 300 AS DOUBLE) AS x_m,
    CAST(940000 + r_regionkey * 850 AS DOUBLE) AS y_m, DATE '2024-01-03' + CAST(5 * r_regionkey AS INTEGER) AS window_start,
    DATE '2024-01-06' + CAST(5 * r_regionkey AS INTEGER) AS window_end FROM region
  UNION ALL SELECT 'ref-s' || CAST(s_suppkey AS VARCHAR), CAST(498000 + s_suppkey * 7919 % 74000 AS DOUBLE), CAST(938000 + s_suppkey * 10473 % 52000 AS DOUBLE),
    DATE '2023-12-30' + CAST(s_suppkey % 35 AS INTEGER), DATE '2023-12-30' + CAST(s_suppkey % 35 + s_suppkey % 4 AS INTEGER) FROM supplier)"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident anchors with a point and an inclusive date window, from regions and suppliers."""
    k, s = F.col("r_regionkey").cast("int"), F.col("s_suppkey").cast("int")
    date = lambda text: F.lit(text).cast("date")
    regions = read_table(spark, sf_dir, "region").select(
        F.concat(F.lit("ref-"), k.cast("string")).alias("reference_id"), (500000 + k * 13600 + 300).cast("double").alias("x_m"), (940000 + k * 850).cast("double").alias("y_m"),
        F.date_add(date("2024-01-03"), 5 * k).alias("window_start"), F.date_add(date("2024-01-06"), 5 * k).alias("window_end"),
    )
    long = s.cast("long")
    return regions.unionByName(read_table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("ref-s"), s.cast("string")).alias("reference_id"), (498000 + long * 7919 % 74000).cast("double").alias("x_m"), (938000 + long * 10473 % 52000).cast("double").alias("y_m"),
        F.date_add(date("2023-12-30"), s % 35).alias("window_start"), F.date_add(date("2023-12-30"), s % 35 + s % 4).alias("window_end"),
    ))


def edges_sql(radius_m: float, hours: float) -> str:
    """SQL twin of the space-time edges of ``det``; the place key keeps it from comparing all pairs."""
    return f"""cell AS (SELECT *, CAST(floor(x_m / {radius_m * (1 + 1e-9)}) AS BIGINT) AS cx, CAST(floor(y_m / {radius_m * (1 + 1e-9)}) AS BIGINT) AS cy FROM det),
off AS (SELECT a.v AS dx, b.v AS dy FROM (VALUES (-1), (0), (1)) a(v), (VALUES (-1), (0), (1)) b(v)),
edges AS (
  SELECT a.detection_id AS src, b.detection_id AS dst, sqrt((a.x_m - b.x_m) ** 2 + (a.y_m - b.y_m) ** 2) AS distance_m,
    abs(epoch_us(a.ts) - epoch_us(b.ts)) / 3.6e9 AS gap_hours
  FROM (SELECT c.*, c.cx + o.dx AS kx, c.cy + o.dy AS ky FROM cell c, off o) a JOIN cell b ON a.kx = b.cx AND a.ky = b.cy AND a.detection_id < b.detection_id
  WHERE abs(epoch_us(a.ts) - epoch_us(b.ts)) <= {int(hours * 3.6e9)} AND sqrt((a.x_m - b.x_m) ** 2 + (a.y_m - b.y_m) ** 2) <= {radius_m} * (1 + 1e-12))"""


#: Components of ``own`` (configuration_id, src, dst) over ``ids`` (configuration_id, detection_id), by spreading the least id.
COMPONENTS = """twoway AS (SELECT configuration_id, src, dst FROM own UNION ALL SELECT configuration_id, dst, src FROM own),
reach AS (
  SELECT configuration_id, detection_id, detection_id AS seen FROM ids
  UNION SELECT r.configuration_id, b.dst, r.seen FROM reach r JOIN twoway b ON b.configuration_id = r.configuration_id AND b.src = r.detection_id),
mem AS (SELECT configuration_id, detection_id, min(seen) AS component FROM reach GROUP BY ALL)"""
