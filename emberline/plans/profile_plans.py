"""Cleaning, attrition and profiles of detections; polygons; availability."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions import clean, geo
from emberline.operators import polygons, profile
from emberline.operators.proximity import cross_source_pairs
from emberline.plans.base import DETECTIONS, Book, detections
from emberline.runtime import read_table

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles

#: Raw text rows with spoiled fields, and the SQL twin.
RAW = """raw AS (
  SELECT event_id,
    CASE event_id % 50 WHEN 0 THEN 'n/a' WHEN 1 THEN '91' WHEN 2 THEN ' 8.5 ' WHEN 3 THEN 'nan' WHEN 4 THEN NULL ELSE '8.' || lpad(CAST(user_id % 1000 AS VARCHAR), 3, '0') END AS latitude,
    CASE event_id % 60 WHEN 5 THEN '-181' WHEN 6 THEN 'west' ELSE '-80.' || lpad(CAST(user_id % 700 AS VARCHAR), 3, '0') END AS longitude,
    CASE event_id % 20 WHEN 3 THEN strftime(ts, '%Y/%m/%d') WHEN 4 THEN strftime(ts, '%Y%m%d') WHEN 5 THEN '2024-99-99' WHEN 6 THEN strftime(ts, '%Y-%m-%d') || 'T00:00' WHEN 7 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS acq_date,
    CASE event_id % 20 WHEN 8 THEN strftime(ts, '%H:%M:%S') WHEN 9 THEN '345' WHEN 10 THEN '2560' WHEN 11 THEN 'none' WHEN 12 THEN strftime(ts, '%H%M%S') ELSE strftime(ts, '%H%M') END AS acq_time,
    CASE WHEN event_id % 9 = 0 THEN ' ' || event_type || ' ' WHEN event_id % 31 = 0 THEN 'No Data' ELSE event_type END AS satellite,
    CASE WHEN event_id % 10 = 0 THEN ' Nominal' WHEN event_id % 10 = 1 THEN 'N/A' ELSE regexp_extract(props, '"k": ([0-9]+)', 1) END AS confidence,
    CASE WHEN event_id % 25 = 2 THEN 'nan' WHEN event_id % 25 = 3 THEN '' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '.5' END AS frp,
    CASE event_id % 5 WHEN 0 THEN 'day' WHEN 1 THEN 'N' WHEN 2 THEN ' d' WHEN 3 THEN 'x' END AS daynight,
    CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS source, ts FROM events),
miss AS (SELECT *, lower(trim(coalesce(acq_date, ''))) IN ('', 'na', 'n/a', 'nan', 'none', 'null', 'no data') AS no_date, lower(trim(coalesce(acq_time, ''))) IN ('', 'na', 'n/a', 'nan', 'none', 'null', 'no data') AS no_time FROM raw),
num AS (
  SELECT *, CASE WHEN isfinite(TRY_CAST(trim(latitude) AS DOUBLE)) THEN TRY_CAST(trim(latitude) AS DOUBLE) END AS lat, CASE WHEN isfinite(TRY_CAST(trim(longitude) AS DOUBLE)) THEN TRY_CAST(trim(longitude) AS DOUBLE) END AS lon,
    CASE WHEN isfinite(TRY_CAST(trim(frp) AS DOUBLE)) THEN TRY_CAST(trim(frp) AS DOUBLE) END AS frp_value,
    CASE WHEN no_date THEN NULL ELSE coalesce(TRY_CAST(replace(split_part(acq_date, 'T', 1), '/', '-') AS DATE), TRY_CAST(try_strptime(acq_date, '%Y%m%d') AS DATE)) END AS day,
    CASE WHEN no_time THEN NULL WHEN acq_time LIKE '%:%' THEN replace(acq_time, ':', '') WHEN length(acq_time) <= 4 THEN lpad(acq_time, 4, '0') || '00' ELSE acq_time END AS six FROM miss),
canon AS (
  SELECT *, coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, false) AS ok,
    CASE WHEN substr(six, 1, 2) < '24' AND substr(six, 3, 2) < '60' AND substr(six, 5, 2) < '60' THEN substr(six, 1, 2) || ':' || substr(six, 3, 2) || ':' || substr(six, 5, 2) END AS clock FROM num)"""
#: Box of the inner polygon test on raw coordinates.
STAGED = """staged AS (
  SELECT *, CASE WHEN day IS NULL THEN 'invalid_date' WHEN NOT ok THEN 'invalid_coordinate' WHEN NOT day BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' THEN 'outside_period'
    WHEN NOT (lat BETWEEN 8 AND 8.1 AND lon BETWEEN -80.6 AND -80.0) THEN 'outside_polygon' END AS drop_stage FROM canon)"""


def raw_rows(spark, sf_dir):
    e, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    pick = lambda mod, cases, other: F.coalesce(*[F.when(e % mod == k, v) for k, v in cases.items()], F.when(~(e % mod).isin(*cases), other))
    fmt = lambda p: F.date_format(ts, p)
    digits = lambda n, m: F.lpad((F.col("user_id") % m).cast("string"), n, "0")
    day = fmt("yyyy-MM-dd")
    return read_table(spark, sf_dir, "events").select(
        "event_id", F.when(e % 50 == 4, None).otherwise(pick(50, {0: F.lit("n/a"), 1: F.lit("91"), 2: F.lit(" 8.5 "), 3: F.lit("nan")}, F.concat(F.lit("8."), digits(3, 1000)))).alias("latitude"),
        pick(60, {5: F.lit("-181"), 6: F.lit("west")}, F.concat(F.lit("-80."), digits(3, 700))).alias("longitude"),
        pick(20, {3: fmt("yyyy/MM/dd"), 4: fmt("yyyyMMdd"), 5: F.lit("2024-99-99"), 6: F.concat(day, F.lit("T00:00")), 7: F.lit("")}, day).alias("acq_date"),
        pick(20, {8: fmt("HH:mm:ss"), 9: F.lit("345"), 10: F.lit("2560"), 11: F.lit("none"), 12: fmt("HHmmss")}, fmt("HHmm")).alias("acq_time"),
        F.when(e % 9 == 0, F.concat(F.lit(" "), "event_type", F.lit(" "))).when(e % 31 == 0, "No Data").otherwise(F.col("event_type")).alias("satellite"), F.lit("viirs").alias("instrument"),
        F.when(e % 10 == 0, " Nominal").when(e % 10 == 1, "N/A").otherwise(F.regexp_extract("props", '"k": ([0-9]+)', 1)).alias("confidence"),
        F.when(e % 25 == 2, "nan").when(e % 25 == 3, "").otherwise(F.concat(F.floor("value").cast("string"), F.lit(".5"))).alias("frp"),
        F.when(e % 5 == 0, "day").when(e % 5 == 1, "N").when(e % 5 == 2, " d").when(e % 5 == 3, "x").alias("daynight"), F.when(e % 2 == 0, "A").otherwise("B").alias("source"), ts.alias("ts"),
    )


def _canonical(spark, sf_dir):
    return profile.canonical(raw_rows(spark, sf_dir))


def _staged(spark, sf_dir):
    inside = profile.in_box(F.col("longitude_value"), F.col("latitude_value"), -80.6, 8.0, -80.0, 8.1)
    return profile.with_drop_stage(_canonical(spark, sf_dir), "2024-01-03", "2024-01-25", inside)


@BOOK.query(f"""WITH {RAW} SELECT event_id, lat AS latitude_value, lon AS longitude_value, ok AS coordinate_valid, CAST(day AS VARCHAR) AS acq_day, clock AS acq_clock,
  CASE WHEN day IS NOT NULL AND clock IS NOT NULL THEN CAST(day AS VARCHAR) || ' ' || clock END AS acq_ts, CASE WHEN lower(trim(satellite)) = 'no data' THEN '' ELSE upper(trim(satellite)) END AS satellite_name,
  CASE WHEN lower(trim(confidence)) IN ('', 'n/a') THEN '' ELSE lower(trim(confidence)) END AS confidence_text, TRY_CAST(confidence AS DOUBLE) AS confidence_number, frp_value,
  CASE upper(trim(daynight)) WHEN 'DAY' THEN 'D' WHEN 'D' THEN 'D' WHEN 'N' THEN 'N' ELSE '' END AS daynight_code FROM canon""")
def clean_rows(spark, sf_dir):
    return _canonical(spark, sf_dir).select(
        "event_id", "latitude_value", "longitude_value", "coordinate_valid", F.col("acq_day").cast("string").alias("acq_day"), "acq_clock", F.date_format("acq_ts", "yyyy-MM-dd HH:mm:ss").alias("acq_ts"),
        "satellite_name", "confidence_text", "confidence_number", "frp_value", "daynight_code",
    )


@BOOK.query(f"""WITH {RAW}, {STAGED} SELECT unnest(['total', 'invalid_date', 'invalid_time', 'invalid_coordinate', 'outside_period', 'outside_polygon', 'kept']) AS stage,
  unnest([count(*), count(*) FILTER (drop_stage = 'invalid_date'), count(*) FILTER (clock IS NULL), count(*) FILTER (drop_stage = 'invalid_coordinate'), count(*) FILTER (drop_stage = 'outside_period'), count(*) FILTER (drop_stage = 'outside_polygon'), count(*) FILTER (drop_stage IS NULL)]) AS rows FROM staged""")
def attrition(spark, sf_dir):
    return profile.attrition(_staged(spark, sf_dir))


@BOOK.query(f"WITH {RAW} SELECT coalesce(nullif(trim(daynight), ''), '__missing__') AS value, count(*) AS rows FROM raw GROUP BY 1")
def value_counts(spark, sf_dir):
    return profile.value_counts(raw_rows(spark, sf_dir), "daynight")


@BOOK.query(f"""WITH {RAW} SELECT count(frp_value) AS present, count(*) - count(frp_value) AS missing, min(frp_value) AS minimum, max(frp_value) AS maximum, quantile_cont(frp_value, 0.25) AS p25, quantile_cont(frp_value, 0.5) AS p50,
  quantile_cont(frp_value, 0.75) AS p75, round(quantile_cont(frp_value, 0.9), 6) AS p90 FROM canon""")
def numeric_distribution(spark, sf_dir):
    return profile.numeric_distribution(_canonical(spark, sf_dir), "frp_value").withColumn("p90", F.round("p90", 6))


_tokens = "('', 'na', 'n/a', 'nan', 'none', 'null', 'no data')"


@BOOK.query(f"""WITH {RAW}, m AS (SELECT source, unnest(['latitude', 'acq_date', 'acq_time', 'frp', 'daynight']) AS "column", unnest([latitude, acq_date, acq_time, frp, daynight]) AS v FROM raw),
  c AS (SELECT source, "column", lower(trim(coalesce(v, ''))) IN {_tokens} AS gone FROM m)
  SELECT source, "column", count(*) FILTER (gone) AS missing FROM c GROUP BY ALL UNION ALL SELECT '__all__', "column", count(*) FILTER (gone) FROM c GROUP BY ALL""")
def missing_counts(spark, sf_dir):
    return profile.missing_counts(raw_rows(spark, sf_dir), ["latitude", "acq_date", "acq_time", "frp", "daynight"], "source")


@BOOK.query(f"""WITH {RAW}, g AS (SELECT satellite, confidence, daynight, latitude, count(*) AS n, count(DISTINCT source) AS s FROM raw GROUP BY ALL), w AS (SELECT source, satellite, confidence, daynight, latitude, count(*) AS n FROM raw GROUP BY ALL)
  SELECT (SELECT count(*) FROM w WHERE n > 1) AS within_source_groups, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM w WHERE n > 1) AS within_source_surplus, (SELECT count(*) FROM g WHERE n > 1 AND s > 1) AS across_source_groups""")
def duplicates(spark, sf_dir):
    return profile.duplicate_summary(raw_rows(spark, sf_dir), ["satellite", "confidence", "daynight", "latitude"], "source")


@BOOK.query(f"""WITH {RAW} SELECT count(*) AS rows, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, count(*) FILTER (ok) AS valid_coordinates, count(*) FILTER (day IS NULL OR clock IS NULL) AS invalid_timestamps,
  count(*) FILTER (frp_value IS NULL) AS missing_frp, count(TRY_CAST(confidence AS DOUBLE)) AS numeric_confidence, count(DISTINCT CASE WHEN lower(trim(satellite)) = 'no data' THEN '' ELSE upper(trim(satellite)) END) AS satellites FROM canon""")
def quality_report(spark, sf_dir):
    return profile.quality_report(_canonical(spark, sf_dir)).withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@BOOK.query("""WITH d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2023-12-28', TIMESTAMP '2024-02-04', INTERVAL 1 DAY)) AS DATE) AS day), c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
  SELECT CAST(day AS VARCHAR) AS day, coalesce(n, 0) AS rows, isoyear(day) AS iso_year, week(day) AS iso_week, CAST(CAST(date_trunc('week', day) AS DATE) AS VARCHAR) AS week_start FROM d LEFT JOIN c USING (day)""")
def daily_weekly(spark, sf_dir):
    out = profile.daily_counts(read_table(spark, sf_dir, "events"), "ts", "2023-12-28", "2024-02-04")
    return out.withColumns({c: F.col(c).cast("string") for c in ("day", "week_start")})


@BOOK.query(f"WITH {DETECTIONS} SELECT daynight AS value, count(*) AS rows, round(100.0 * count(*) / (SELECT count(*) FROM det), 6) AS share_pct FROM det GROUP BY 1")
def known_shares(spark, sf_dir):
    return profile.known_shares(detections(spark, sf_dir), "daynight", ["D", "N"]).withColumn("share_pct", F.round("share_pct", 6))


@BOOK.query(f"WITH {DETECTIONS} SELECT min(x_m) AS west, min(y_m) AS south, max(x_m) AS east, max(y_m) AS north FROM det")
def bounding_box(spark, sf_dir):
    return profile.bounding_box(detections(spark, sf_dir), "x_m", "y_m")


@BOOK.query("""WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CAST(least(7, floor((value - lo) / ((hi - lo) / 8))) AS INTEGER) AS bin, count(*) AS rows FROM events, s GROUP BY 1""")
def histogram(spark, sf_dir):
    return profile.histogram(read_table(spark, sf_dir, "events"), "value", 8)


@BOOK.query("SELECT CAST(least(4, greatest(0, floor(value / 300 * 5))) AS INTEGER) AS bin, count(*) AS rows FROM events GROUP BY 1")
def clarity_bins(spark, sf_dir):
    return read_table(spark, sf_dir, "events").groupBy(profile.fixed_bins(F.col("value") / 300, 5).alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


@BOOK.query(f"""WITH {DETECTIONS} SELECT CAST(least(11, greatest(0, floor((x_m - 505000) / 55000.0 * 12))) AS INTEGER) AS col, CAST(least(7, greatest(0, floor((y_m - 940500) / 4000.0 * 8))) AS INTEGER) AS row, count(*) AS rows FROM det GROUP BY ALL""")
def density_grid(spark, sf_dir):
    return profile.density_grid(detections(spark, sf_dir), "x_m", "y_m", (505000.0, 940500.0, 560000.0, 944500.0), 12, 8)


@BOOK.query(f"WITH {RAW}, {STAGED} SELECT source, count(*) AS raw, count(*) FILTER (drop_stage IS NULL) AS kept FROM staged GROUP BY source")
def raw_versus_kept(spark, sf_dir):
    return profile.raw_versus_kept(_staged(spark, sf_dir), "source")


@BOOK.query(f"""WITH {DETECTIONS}, hav AS (
  SELECT a.detection_id AS a, b.detection_id AS b, abs(epoch_us(a.ts) - epoch_us(b.ts)) / 6e7 AS gap_minutes,
    2 * 6371.0088 * asin(sqrt(least(1.0, sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2))) AS distance_km
  FROM det a JOIN det b ON a.firms_source < b.firms_source AND abs(a.lat - b.lat) < 0.05 AND abs(a.lon - b.lon) < 0.05 AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 5400000000)
  SELECT a, b, round(distance_km, 6) AS distance_km, round(gap_minutes, 6) AS gap_minutes FROM hav WHERE distance_km <= 2""")
def cross_source_matches(spark, sf_dir):
    out = cross_source_pairs(detections(spark, sf_dir), 2.0, 90.0)
    return out.select("a", "b", F.round("distance_km", 6).alias("distance_km"), F.round("gap_minutes", 6).alias("gap_minutes"))


@BOOK.query("""WITH k AS (SELECT DISTINCT user_id FROM events), d AS (SELECT user_id, CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day FROM k)
  SELECT user_id, CAST(day AS VARCHAR) AS day FROM d WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = d.user_id AND CAST(e.ts AS DATE) = d.day)""")
def coverage_days(spark, sf_dir):
    seen = read_table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("day"))
    return profile.missing_days(seen, "user_id", "day", "2024-01-01", "2024-01-30").select("user_id", F.col("day").cast("string").alias("day"))


_exp = """src AS (SELECT event_type AS source, CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events GROUP BY 1),
exp AS (SELECT source, CAST(s AS DATE) AS chunk_start, least(b, CAST(s AS DATE) + 4) AS chunk_end FROM (SELECT source, b, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 5 DAY)) AS s FROM src)),
act AS (SELECT source, chunk_start, sum(1) AS record_count, CASE WHEN max(event_id) % 7 = 0 THEN 'failed' ELSE 'downloaded' END AS status FROM events JOIN exp ON event_type = source AND CAST(ts AS DATE) BETWEEN chunk_start AND chunk_end WHERE value > 20 GROUP BY 1, 2 HAVING max(event_id) % 5 <> 0)"""


def _fragments(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    spans = events.groupBy(F.col("event_type").alias("source")).agg(F.min("ts").cast("date").alias("a"), F.max("ts").cast("date").alias("b"))
    expected = profile.fragments(spans, "source", "a", "b", 5)
    day = F.col("ts").cast("date")
    rows = events.where("value > 20").join(expected, (F.col("event_type") == F.col("source")) & day.between(F.col("chunk_start"), F.col("chunk_end")))
    actual = rows.groupBy("source", "chunk_start").agg(F.count(F.lit(1)).alias("record_count"), F.max("event_id").alias("m")).where("m % 5 <> 0").withColumn("status", F.when(F.col("m") % 7 == 0, "failed").otherwise("downloaded"))
    return expected, actual


@BOOK.query(f"""WITH {_exp} SELECT coalesce(e.source, a.source) AS source, CAST(chunk_start AS VARCHAR) AS chunk_start, CASE WHEN a.source IS NULL THEN 'missing' WHEN status <> 'downloaded' THEN 'failed' WHEN record_count = 0 THEN 'empty' ELSE 'complete' END AS verdict
  FROM exp e LEFT JOIN act a USING (source, chunk_start)""")
def fragments_missing(spark, sf_dir):
    expected, actual = _fragments(spark, sf_dir)
    return profile.fragment_audit(expected, actual, ["source", "chunk_start"]).select("source", F.col("chunk_start").cast("string").alias("chunk_start"), "verdict")


@BOOK.query(f"""WITH {_exp}, v AS (SELECT CASE WHEN a.source IS NULL THEN 'missing' WHEN status <> 'downloaded' THEN 'failed' ELSE 'complete' END AS v FROM exp e LEFT JOIN act a USING (source, chunk_start))
  SELECT count(*) FILTER (v = 'missing') AS missing, CAST(0 AS BIGINT) AS unexpected, count(*) FILTER (v = 'failed') AS failed, CAST(0 AS BIGINT) AS empty, count(*) FILTER (v = 'complete') AS complete, count(*) FILTER (v <> 'complete') = 0 AS is_complete FROM v""")
def acquisition_audit(spark, sf_dir):
    expected, actual = _fragments(spark, sf_dir)
    return profile.audit_summary(profile.fragment_audit(expected, actual, ["source", "chunk_start"]))


@BOOK.query(f"WITH {_exp} SELECT source, CAST(count(*) AS BIGINT) AS fragments, count(*) FILTER (status = 'downloaded') AS downloaded, count(*) FILTER (status <> 'downloaded') AS not_downloaded, CAST(sum(record_count) AS BIGINT) AS records FROM act GROUP BY source")
def source_rollup(spark, sf_dir):
    return profile.source_rollup(_fragments(spark, sf_dir)[1])


_spans = "sp AS (SELECT c_custkey AS k, min(CAST(o_orderdate AS DATE)) AS a, min(CAST(o_orderdate AS DATE)) + 40 AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)"


def _customer_spans(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").join(read_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.groupBy(F.col("c_custkey").alias("k")).agg(F.min(F.col("o_orderdate").cast("date")).alias("a0")).select("k", F.col("a0").alias("a"), F.date_add("a0", 40).alias("b"))


@BOOK.query(f"""WITH {_spans} SELECT x.k AS a, y.k AS b, CAST(greatest(x.a, y.a) AS VARCHAR) AS overlap_start, CAST(least(x.b, y.b) AS VARCHAR) AS overlap_end FROM sp x JOIN sp y ON x.k < y.k AND x.a <= y.b AND y.a <= x.b""")
def source_overlap(spark, sf_dir):
    out = profile.interval_overlaps(_customer_spans(spark, sf_dir), "k", "a", "b")
    return out.select("a", "b", F.col("overlap_start").cast("string").alias("overlap_start"), F.col("overlap_end").cast("string").alias("overlap_end"))


@BOOK.query(f"""WITH {_spans}, s AS (SELECT CASE WHEN k % 3 = 0 THEN 'VIIRS' ELSE 'MODIS' END || '_' || CAST(k AS VARCHAR) || CASE WHEN k % 2 = 0 THEN '_SP' ELSE '_NRT' END AS data_id, a, b, greatest(a, DATE '1995-03-01') AS lo, least(b, DATE '1995-12-31') AS hi FROM sp),
  r AS (SELECT *, CASE WHEN NOT starts_with(data_id, 'VIIRS') THEN 'wrong_family' WHEN NOT suffix(data_id, '_SP') THEN 'wrong_processing' WHEN lo > hi THEN 'no_overlap' ELSE 'selected' END AS reason FROM s)
  SELECT data_id, CASE WHEN reason = 'selected' THEN CAST(lo AS VARCHAR) END AS overlap_start, CASE WHEN reason = 'selected' THEN CAST(hi AS VARCHAR) END AS overlap_end, reason FROM r""")
def source_choice(spark, sf_dir):
    k = F.col("k")
    spans = _customer_spans(spark, sf_dir)
    named = spans.select(F.concat(F.when(k % 3 == 0, "VIIRS").otherwise("MODIS"), F.lit("_"), k.cast("string"), F.when(k % 2 == 0, "_SP").otherwise("_NRT")).alias("data_id"), F.col("a").alias("min_date"), F.col("b").alias("max_date"))
    out = profile.source_choice(named, "VIIRS", "_SP", "1995-03-01", "1995-12-31")
    return out.select("data_id", F.col("overlap_start").cast("string").alias("overlap_start"), F.col("overlap_end").cast("string").alias("overlap_end"), "reason")


#: A box with a hole, and a triangle; some grid points lie on edges.
SHAPES = [
    [[(503400.0, 940000.0), (540800.0, 940000.0), (540800.0, 943400.0), (503400.0, 943400.0), (503400.0, 940000.0)], [(510200.0, 940100.0), (520400.0, 940100.0), (520400.0, 942000.0), (510200.0, 942000.0), (510200.0, 940100.0)]],
    [[(545900.0, 939900.0), (567000.0, 939900.0), (545900.0, 946000.0), (545900.0, 939900.0)]],
]


@BOOK.query(f"""WITH {DETECTIONS} SELECT detection_id, 0 AS polygon FROM det WHERE x_m BETWEEN 503400 AND 540800 AND y_m BETWEEN 940000 AND 943400 AND NOT (x_m BETWEEN 510200 AND 520400 AND y_m BETWEEN 940100 AND 942000)
  UNION ALL SELECT detection_id, 1 FROM det WHERE x_m >= 545900 AND y_m >= 939900 AND (x_m - 545900) * 6100 + (y_m - 939900) * 21100 <= 21100.0 * 6100""")
def point_in_polygon(spark, sf_dir):
    return polygons.points_in_polygons(detections(spark, sf_dir), polygons.edge_table(spark, SHAPES), "detection_id")


_hulls = f"""WITH {DETECTIONS}, b AS (SELECT satellite, min(x_m) AS w, max(x_m) AS e, min(y_m) AS s, max(y_m) AS n FROM det GROUP BY 1)"""


@BOOK.query(f"{_hulls} SELECT satellite AS polygon, (e - w) * (n - s) - (e - w) * (n - s) / 4 AS area, round((w + e) / 2, 6) AS centroid_x, round((s + n) / 2, 6) AS centroid_y FROM b")
def polygon_area(spark, sf_dir):
    """Areas of the satellites' bounding boxes with a box of half the sides cut out of the middle."""
    box = detections(spark, sf_dir).groupBy("satellite").agg(F.min("x_m").alias("w"), F.max("x_m").alias("e"), F.min("y_m").alias("s"), F.max("y_m").alias("n"))
    ring = lambda w, e, s, n: F.array(*[F.array(x, y) for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))])
    w, e, s, n = (F.col(c) for c in "wesn")
    dx, dy = (e - w) / 4, (n - s) / 4
    edges = polygons.geojson_edges(box.select(F.col("satellite").alias("feature"), F.array(F.array(ring(w, e, s, n), ring(w + dx, e - dx, s + dy, n - dy))).alias("coordinates")))
    return polygons.areas(edges, ["feature"]).select(F.col("feature").alias("polygon"), F.round("area", 6).alias("area"), F.round("centroid_x", 6).alias("centroid_x"), F.round("centroid_y", 6).alias("centroid_y"))


@BOOK.query(f"""WITH {DETECTIONS} SELECT detection_id, CAST(floor((lon + 180) / 360 * 4096) AS INTEGER) AS tile_x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096) AS INTEGER) AS tile_y,
  round(degrees(x_m / 6378137.0), 6) AS lon_3857, round(degrees(2 * atan(exp(y_m / 6378137.0)) - pi() / 2), 6) AS lat_3857, round(sqrt(((lon + 80.5) * 111320 * cos(radians(8.6))) ** 2 + ((lat - 8.6) * 111320) ** 2), 4) AS flat_m,
  CAST(floor((x_m - 500000) / 60) * 60 + 500000 AS DOUBLE) AS snapped, x_m - 500000 + 10.0 AS centre FROM det""")
def map_tiles(spark, sf_dir):
    det = detections(spark, sf_dir)
    tx, ty = geo.slippy_tile(F.col("lon"), F.col("lat"), 12)
    x, y = geo.to_degrees(F.lit(3857), F.col("x_m"), F.col("y_m"))
    flat = geo.equirectangular_m(F.lit(-80.5), F.lit(8.6), F.col("lon"), F.col("lat"))
    return det.select("detection_id", tx.alias("tile_x"), ty.alias("tile_y"), F.round(x, 6).alias("lon_3857"), F.round(y, 6).alias("lat_3857"), F.round(flat, 4).alias("flat_m"), geo.snap_down(F.col("x_m"), 500000.0, 60.0).cast("double").alias("snapped"), geo.pixel_centre(F.lit(0.0), 20.0, (F.col("x_m") - 500000) / 20).alias("centre"))


@BOOK.query("""SELECT page_id, regexp_replace(url, '([?&](?:key|token|secret|api_key|utm_source)=)[^&]*', '\\1[redacted]', 'gi') AS redacted, regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g') AS file_name,
  CASE WHEN url LIKE 'https:%' THEN 'secure' WHEN regexp_matches(url, '/(es|fr|de)/') THEN 'translated' ELSE 'other' END AS kind FROM pages""")
def url_redaction(spark, sf_dir):
    url = F.col("url")
    kind = clean.path_class(url, [("^https:", "secure"), ("/(es|fr|de)/", "translated")])
    return read_table(spark, sf_dir, "pages").select("page_id", clean.redact_query(url).alias("redacted"), clean.safe_name(url).alias("file_name"), kind.alias("kind"))


@BOOK.query("""WITH k AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'B500' WHEN 1 THEN ' 1000m' ELSE 'b1500' END AS b, CASE c_custkey % 4 WHEN 0 THEN 'PRE-30_Post45' WHEN 1 THEN 'pre60 post90' WHEN 2 THEN 'Pre30Post90' ELSE 'post45' END AS w, CASE c_custkey % 2 WHEN 0 THEN 'Pre-fire' ELSE ' POST' END AS r FROM customer)
  SELECT c_custkey, 'b' || lpad(CASE c_custkey % 3 WHEN 0 THEN '500' WHEN 1 THEN '1000' ELSE '1500' END, 4, '0') AS buffer, CASE c_custkey % 4 WHEN 0 THEN 'pre30_post45' WHEN 1 THEN 'pre60_post90' WHEN 2 THEN 'pre30_post90' END AS window, CASE c_custkey % 2 WHEN 0 THEN 'pre' ELSE 'post' END AS role,
    CASE c_custkey % 4 WHEN 0 THEN 75 WHEN 1 THEN 150 WHEN 2 THEN 120 END AS span_days FROM k""")
def key_forms(spark, sf_dir):
    k = F.col("c_custkey")
    b = F.when(k % 3 == 0, "B500").when(k % 3 == 1, " 1000m").otherwise("b1500")
    w = F.when(k % 4 == 0, "PRE-30_Post45").when(k % 4 == 1, "pre60 post90").when(k % 4 == 2, "Pre30Post90").otherwise("post45")
    r = F.when(k % 2 == 0, "Pre-fire").otherwise(" POST")
    window = clean.window_key(w)
    return read_table(spark, sf_dir, "customer").select("c_custkey", clean.buffer_key(b).alias("buffer"), window.alias("window"), clean.role_key(r).alias("role"), clean.combination_parts(window)[3].alias("span_days"))
