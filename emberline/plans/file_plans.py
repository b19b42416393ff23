"""Sources and sinks: the driver's tables written to the shared folder and scanned back, bounded selections, ring checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import polygons, profile, quality, sampling, selection
from emberline.plans.base import DETECTIONS, Book, detections
from emberline.runtime import read_table, shared_folder
from emberline.sources import files

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles


def _folder(spark: SparkSession) -> str:
    """A new folder for what a query writes and scans; it stays, since the result is read from it later."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


_RAW = """raw AS (SELECT event_id, '8.' || lpad(CAST(user_id % 1000 AS VARCHAR), 3, '0') AS latitude, '-80.' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') AS longitude,
  strftime(ts, '%Y-%m-%d') AS acq_date, strftime(ts, '%H%M') AS acq_time, event_type AS satellite, 'VIIRS' AS instrument, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'n' END AS confidence, CAST(event_id % 997 AS VARCHAR) AS frp,
  CASE WHEN event_id % 2 = 0 THEN '' WHEN hour(ts) BETWEEN 6 AND 17 THEN 'D' ELSE 'N' END AS daynight FROM events)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, event, hour = F.col("user_id"), F.col("event_id"), F.hour("ts")
    digits = lambda c: F.lpad((c % 1000).cast("string"), 3, "0")
    return read_table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("8."), digits(user)).alias("latitude"), F.concat(F.lit("-80."), digits(event)).alias("longitude"), F.date_format("ts", "yyyy-MM-dd").alias("acq_date"), F.date_format("ts", "HHmm").alias("acq_time"),
        F.col("event_type").alias("satellite"), F.lit("VIIRS").alias("instrument"), F.when(event % 7 == 0, "").otherwise("n").alias("confidence"), (event % 997).cast("string").alias("frp"),
        F.when(event % 2 == 0, "").when(hour.between(6, 17), "D").otherwise("N").alias("daynight"),
    )


_SHORT = {"latitude": "LAT", "longitude": "Lon", "acq_date": "Date", "acq_time": "Acquisition Time", "satellite": "Platform", "instrument": "Sensor", "confidence": "Conf", "frp": "Fire Radiative-Power", "daynight": "DAY_NIGHT"}


def _fragments(spark: SparkSession, sf_dir: str) -> str:
    """Detection files of even events under the plain header, and of odd ones under aliases and with day or night."""
    raw, root = _raw(spark, sf_dir), _folder(spark)
    write = lambda rows, name: rows.write.option("header", True).option("emptyValue", "").csv(f"{root}/{name}")
    write(raw.where("event_id % 2 = 0").select(*files.FIELDS), "plain")
    write(raw.where("event_id % 2 = 1").select(*[F.col(c).alias(n) for c, n in _SHORT.items()]), "aliases")
    return root


@BOOK.query(f"WITH {_RAW} SELECT latitude, longitude, acq_date, acq_time, satellite, instrument, confidence, frp, daynight, '' AS version FROM raw")
def detection_scan(spark, sf_dir):
    rows, _ = files.scan_detection_files(spark, f"{_fragments(spark, sf_dir)}/*")
    return rows.select(*files.FIELDS, "daynight", "version")


@BOOK.query(f"""WITH {_RAW}, n AS (SELECT count(*) FILTER (event_id % 2 = 0) AS a, count(*) FILTER (event_id % 2 = 1) AS b, count(*) AS c FROM raw)
SELECT 'plain' AS name, true AS valid, '' AS error, a AS records, 1 AS schemas FROM n UNION ALL SELECT 'aliases', true, '', b, 1 FROM n
UNION ALL SELECT 'lacking', false, 'missing: frp', c, 1 FROM n UNION ALL SELECT 'twofold', false, 'ambiguous: latitude', c, 1 FROM n""")
def scan_report(spark, sf_dir):
    root, raw = _fragments(spark, sf_dir), _raw(spark, sf_dir)
    raw.select(*[c for c in files.FIELDS if c != "frp"]).write.option("header", True).csv(f"{root}/lacking")
    raw.select(*files.FIELDS, F.col("latitude").alias("lat")).write.option("header", True).csv(f"{root}/twofold")
    _, found = files.scan_detection_files(spark, f"{root}/*")
    named = found.where("record_count > 0").withColumn("name", F.regexp_extract("path", "/([a-z]+)/[^/]*$", 1))
    return named.groupBy("name").agg(
        F.min("schema_valid").alias("valid"), F.coalesce(F.max("error"), F.lit("")).alias("error"), F.sum("record_count").alias("records"), F.count_distinct("schema_sha256").cast("int").alias("schemas")
    )


@BOOK.query(f"""WITH {_RAW}, s AS (SELECT count(*) FILTER (event_id % 997 % 10 = 3) AS n FROM raw) SELECT unnest(['row_in_range', 'id_recomputed']) AS "check", n AS rows FROM s""")
def lineage_findings(spark, sf_dir):
    rows, found = files.scan_detection_files(spark, f"{_fragments(spark, sf_dir)}/*")
    spoiled = F.col("frp").cast("int") % 10 == 3
    lined = rows.withColumns({"firms_source": F.col("raw_file"), "source_row_number": F.col("source_row_number") + F.when(spoiled, 10**9).otherwise(0)})
    return quality.lineage_checks(lined, found).groupBy("check").agg(F.count(F.lit(1)).alias("rows"))


@BOOK.query("""SELECT DISTINCT CAST(c_nationkey AS INTEGER) AS nation, CASE c_nationkey % 5 WHEN 1 THEN 'hash_differs' WHEN 2 THEN 'size_differs' WHEN 3 THEN 'not_in_manifest' ELSE 'matches' END AS verdict FROM customer""")
def manifest_findings(spark, sf_dir):
    root = _folder(spark)
    read_table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_mktsegment").repartition("c_nationkey").write.partitionBy("c_nationkey").parquet(root)
    nation = lambda d: d.withColumn("nation", F.regexp_extract("path", "c_nationkey=([0-9]+)", 1).cast("int"))
    manifest = nation(files.hash_manifest(spark, root)).where("nation % 5 <> 3")
    spoiled = manifest.withColumns({"sha256": F.when(F.col("nation") % 5 == 1, F.reverse("sha256")).otherwise(F.col("sha256")), "size_bytes": F.col("size_bytes") + F.when(F.col("nation") % 5 == 2, 1).otherwise(0)})
    return nation(files.verify_manifest(spark, root, spoiled)).select("nation", "verdict").distinct()


@BOOK.query(f"WITH {DETECTIONS} SELECT detection_id, satellite, round(lon, 6) AS lon, round(lat, 6) AS lat FROM det")
def geojson_features(spark, sf_dir):
    root = _folder(spark)
    files.geojson_lines(detections(spark, sf_dir), "lon", "lat", ["detection_id", "satellite"]).write.text(root)
    kind = "struct<type:string,geometry:struct<type:string,coordinates:array<double>>,properties:struct<detection_id:string,satellite:string>>"
    doc = spark.read.text(root).select(F.from_json("value", kind).alias("f"))
    return doc.where("f.type = 'Feature' and f.geometry.type = 'Point'").select("f.properties.detection_id", "f.properties.satellite", F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"))


@BOOK.query("SELECT o_orderkey, o_orderpriority, o_custkey % 7 = 0 AS flagged FROM orders")
def audit_lines(spark, sf_dir):
    root = _folder(spark)
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_custkey") % 7 == 0).alias("flagged"))
    files.write_json_lines(rows, root, ["o_orderkey"])
    return spark.read.schema(rows.schema).json(root)


@BOOK.query("SELECT attempt, outcome, n AS rows FROM (SELECT count(*) AS n FROM customer), (VALUES ('first', 'written'), ('again', 'same'), ('changed', 'refused'), ('doubled', 'refused')) t(attempt, outcome)")
def write_once_outcomes(spark, sf_dir):
    root = _folder(spark)
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    changed = rows.withColumn("c_mktsegment", F.when(F.col("c_custkey") == 1, "other").otherwise(F.col("c_mktsegment")))
    outcomes = []
    for name, offered in (("first", rows), ("again", rows.orderBy(F.desc("c_custkey"))), ("changed", changed), ("doubled", rows.unionByName(rows))):
        try:
            outcomes.append((name, files.write_once(offered, root)))
        except ValueError:
            outcomes.append((name, "refused"))
    found = spark.read.parquet(root).agg(F.count(F.lit(1)).alias("rows"))
    return spark.createDataFrame(outcomes, "attempt string, outcome string").crossJoin(found)  # four rows, one row


@BOOK.query("""WITH a AS (SELECT 'C' || CAST(o_custkey AS VARCHAR) || '_SP' AS data_id, min(o_orderdate) AS lo, max(o_orderdate) AS hi, o_custkey % 5 AS k FROM orders GROUP BY o_custkey)
SELECT data_id, CASE WHEN k <> 1 THEN strftime(CASE WHEN k = 0 THEN hi ELSE lo END, '%Y-%m-%d') END AS min_date, strftime(CASE WHEN k = 0 THEN lo ELSE hi END, '%Y-%m-%d') AS max_date FROM a""")
def availability_scan(spark, sf_dir):
    root, k = _folder(spark), F.col("o_custkey") % 5
    lo, hi = F.date_format("lo", "yyyy-MM-dd"), F.date_format("hi", "yyyy-MM-dd")
    spans = read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    rows = spans.select(F.concat(F.lit(" c"), F.col("o_custkey").cast("string"), F.lit("_sp ")).alias("data_id"), F.when(k == 0, hi).when(k == 1, "2025-99-99").otherwise(lo).alias("min_date"), F.when(k == 0, lo).otherwise(hi).alias("max_date"))
    rows.write.option("header", True).csv(root)
    return files.read_availability(spark, root).select("data_id", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("min_date", "max_date")])


@BOOK.query("""WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM events)
SELECT event_type, count(*) AS total, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY n) FILTER (n <= 100) AS examples FROM r GROUP BY 1""")
def example_lists(spark, sf_dir):
    return profile.examples(read_table(spark, sf_dir, "events"), ["event_type"], [F.desc("value"), F.col("event_id")], "event_id", 100)


@BOOK.query("""WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))
SELECT o_custkey, o_orderkey FROM r WHERE n <= 3""")
def work_items(spark, sf_dir):
    wanted = read_table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return selection.work_items(read_table(spark, sf_dir, "orders"), wanted, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")


_BLIND = """WITH s AS (SELECT unnest(['A', 'B']) AS slot), d AS (SELECT slot, 'c' || CAST(c_custkey AS VARCHAR) AS event_id FROM customer, s), h AS (SELECT *, sha256('round2' || chr(0) || 'p1' || chr(0) || slot || chr(0) || '11' || chr(0) || event_id) AS digest FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY digest, event_id) AS n FROM h)"""


@BOOK.query(f"""{_BLIND} SELECT slot, n AS "order", printf('%s-%04d', slot, n) AS alias, digest FROM r""")
def blinded_rows(spark, sf_dir):
    items = read_table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("event_id"))
    return sampling.blinded(sampling.blind_order(items, ["A", "B"], 11, "round2", "p1"))[0]


@BOOK.query("""SELECT CAST(c_custkey AS VARCHAR) AS polygon, unnest(CASE c_custkey % 5 WHEN 1 THEN ['too_few_points', 'no_area'] WHEN 2 THEN ['open'] WHEN 3 THEN ['crosses_itself'] ELSE [] END) AS problem FROM customer""")
def ring_findings(spark, sf_dir):
    k = F.col("c_custkey") % 5
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    ring = lambda *p: F.array(*[point(*q) for q in p])
    square, flat, bent = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(0, 0), (4, 0), (0, 0)], [(0, 0), (4, 4), (4, 0), (0, 2), (0, 0)]
    points = F.when(k == 1, ring(*flat)).when(k == 2, ring(*square[:-1], (0, 1))).when(k == 3, ring(*bent)).otherwise(ring(*square))
    rows = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("polygon"), points.alias("p"))
    steps = rows.withColumn("edge", F.explode(F.sequence(F.lit(0), F.size("p") - 2)))
    at = lambda i, c: F.get("p", i)[c]
    edges = steps.select("polygon", F.lit(0).alias("ring"), F.lit(False).alias("is_hole"), "edge", at(F.col("edge"), "x").alias("x1"), at(F.col("edge"), "y").alias("y1"), at(F.col("edge") + 1, "x").alias("x2"), at(F.col("edge") + 1, "y").alias("y2"))
    return polygons.ring_violations(edges).select("polygon", "problem")
