"""Projections, lookups and the remaining contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions import clean
from emberline.operators import policy, quality, raster, scenes, selection
from emberline.plans.base import DETECTIONS, Book, detections
from emberline.plans.event_plans import ONE, _events, _members, _one, _rounded
from emberline.plans.raster_plans import PIXELS, pixels
from emberline.plans.scene_plans import SCENES, _events_of, _matrix, scene_candidates
from emberline.runtime import cut, read_table

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles


@BOOK.query(f"""{_one}, {_events} SELECT component AS event_id, round(duration_hours, 6) AS duration_hours, detection_count, frp_max, round(day_fraction, 6) AS day_fraction FROM ev""")
def frozen_events(spark, sf_dir):
    events = _events_of(spark, sf_dir).withColumn("configuration_id", F.lit(ONE.name))
    return _rounded(selection.freeze(events).select("event_id", "duration_hours", "detection_count", "frp_max", "day_fraction"))


@BOOK.query(f"""{_one}, {_events}, e AS (SELECT component AS event_id, min(ts) AS start_ts, avg(x_m) AS x, avg(y_m) AS y FROM joined GROUP BY 1), n AS (SELECT *, sqrt((x - 520000) ** 2 + (y - 941000) ** 2) AS d FROM e)
SELECT event_id, round(d, 6) AS distance_m, row_number() OVER (ORDER BY start_ts, event_id) - 1 AS number FROM n WHERE d <= 6000 AND start_ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""")
def case_events(spark, sf_dir):
    out = selection.events_near(_events_of(spark, sf_dir), 520000.0, 941000.0, 6000.0, "2024-01-05", "2024-01-20")
    return _rounded(out.select("event_id", "distance_m", "number"))


@BOOK.query(f"""WITH {SCENES} SELECT event_id, CASE WHEN bool_or(status = 'usable_both') THEN 'observed' WHEN event_id % 3 = 0 THEN 'not_observed' ELSE 'outside_cohort' END AS status FROM matrix WHERE rule_id = 'D' GROUP BY 1""")
def optical_status(spark, sf_dir):
    m = _matrix(spark, sf_dir).where("rule_id = 'D'")
    events = m.select("event_id").distinct()
    return selection.three_way_status(events, m.where("status = 'usable_both'"), events.where("event_id % 3 = 0"))


@BOOK.query(f"""{_one}, {_events} SELECT component AS event_id, count(*) AS members, string_agg(detection_id, ',' ORDER BY ts, detection_id) AS ids, true AS count_agrees FROM joined GROUP BY 1""")
def sampled_members(spark, sf_dir):
    members = _members(spark, sf_dir, [ONE]).withColumn("event_id", F.col("component"))
    events = _events_of(spark, sf_dir)
    out = selection.sampled_members(events.select("event_id"), events, members)
    return out.select("event_id", F.size("members").cast("long").alias("members"), F.array_join(F.transform("members", lambda m: m["detection_id"]), ",").alias("ids"), "count_agrees")


@BOOK.query("""SELECT o_orderkey AS scene_id, o_orderkey % 4 <> 0 AS cloud_score_linked, CASE WHEN o_orderkey % 4 <> 0 THEN round(1 - (o_orderkey % 50) / 100.0, 6) END AS cloud_fraction FROM orders""")
def score_links(spark, sf_dir):
    s = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scene_id"))
    scores = s.where("scene_id % 4 <> 0").withColumn("clear_060", F.col("scene_id") % 50 / 100.0)
    return scenes.with_scores(s, scores).select("scene_id", "cloud_score_linked", F.round(selection.cloud_fraction(F.col("clear_060")), 6).alias("cloud_fraction"))


@BOOK.query(f"""WITH {SCENES}, s AS (SELECT event_id, combination_id, rule_id FROM matrix WHERE rule_id = 'A' AND status = 'usable_both'), u AS (SELECT event_id, buffer_id || '_' || window_id AS combination_id, rule_id, role, scene_id FROM ruled WHERE usable)
SELECT s.event_id, s.combination_id, array_to_string(list_sort(list(DISTINCT scene_id) FILTER (role = 'pre')), ',') AS pre_candidates, array_to_string(list_sort(list(DISTINCT scene_id) FILTER (role = 'post')), ',') AS post_candidates FROM s JOIN u USING (event_id, combination_id, rule_id) GROUP BY ALL""")
def pair_candidates(spark, sf_dir):
    rules = F.broadcast(scenes.rules_frame(spark))
    rows = scene_candidates(spark, sf_dir).crossJoin(rules).withColumns({"usable": scenes.usable(), "combination_id": F.concat_ws("_", "buffer_id", "window_id")})
    chosen = _matrix(spark, sf_dir).where("rule_id = 'A' and status = 'usable_both'").select("event_id", "combination_id", "rule_id")
    return scenes.selected_pairs(chosen, rows).select("event_id", "combination_id", *[F.array_join(f"{r}_candidates", ",").alias(f"{r}_candidates") for r in ("pre", "post")])


@BOOK.query(f"""WITH {PIXELS}, q AS (SELECT scene_id, CASE WHEN scene_id % 40 = 3 AND p = 5 THEN 9.0 ELSE b8 END AS b8, row, col FROM px WHERE NOT (scene_id % 30 = 4 AND p = 63)), a AS (SELECT scene_id, count(*) AS n, max(b8) AS m FROM q GROUP BY 1)
SELECT unnest(list_filter([CASE WHEN n <> 64 THEN 'pixel_count' END, CASE WHEN m > 2 THEN 'b8_range' END], lambda x: x IS NOT NULL)) AS "check", CAST(scene_id AS VARCHAR) AS key FROM a""")
def pixel_contract(spark, sf_dir):
    rows = pixels(spark, sf_dir).where("not (scene_id % 30 = 4 and p = 63)").withColumn("b8", F.when((F.col("scene_id") % 40 == 3) & (F.col("p") == 5), 9.0).otherwise(F.col("b8")))
    return selection.pixel_contract(rows, "scene_id", 8, 8, {"b8": (-2.0, 2.0)}).select("check", "key")


@BOOK.query(f"""WITH {DETECTIONS}, m AS (SELECT DISTINCT firms_source AS k, x_m, y_m FROM det),
near AS (SELECT k, x_m, y_m, CAST(floor((y_m - 940000) / 500) AS BIGINT) + a.i AS r, CAST(floor((x_m - 500000) / 500) AS BIGINT) + b.i AS c FROM m, range(-4, 5) a(i), range(-4, 5) b(i)),
s AS (SELECT DISTINCT k, r, c FROM near WHERE sqrt((x_m - 500000 - c * 500.0) ** 2 + (y_m - 940000 - r * 500.0) ** 2) <= 1500)
SELECT firms_source, any_value(a) AS aoi_area_m2, count(*) AS detections FROM det LEFT JOIN (SELECT k, count(*) * 250000.0 AS a FROM s GROUP BY 1) ON k = firms_source GROUP BY 1""")
def aoi_area_lookup(spark, sf_dir):
    det = detections(spark, sf_dir)
    members = det.select("firms_source", "x_m", "y_m").distinct()
    grid = raster.pixels_around(members, ["firms_source"], 1500.0, 500.0, 500000.0, 940000.0)
    areas = selection.aoi_areas(members, grid, ["firms_source"], 1500.0, 500.0)
    return selection.with_area(det, areas, ["firms_source"]).groupBy("firms_source").agg(F.max("aoi_area_m2").alias("aoi_area_m2"), F.count(F.lit(1)).alias("detections"))


@BOOK.query("""SELECT c_custkey, lower(c_mktsegment) AS label, c_custkey % 4 IN (0, 1) AS lenient, CASE c_custkey % 4 WHEN 0 THEN true WHEN 2 THEN false END AS strict, CASE WHEN c_custkey % 3 = 0 THEN '2025-01-01 08:00:00' WHEN c_custkey % 3 = 1 THEN '2025-01-01 10:00:00' END AS zoned,
  'token=[redacted] at projects/[redacted]' AS diagnostic FROM customer""")
def text_forms(spark, sf_dir):
    k = F.col("c_custkey")
    word = F.when(k % 4 == 0, "True").when(k % 4 == 1, "sí").when(k % 4 == 2, "FALSE").otherwise("maybe")
    stamp = F.when(k % 3 == 0, "2025-01-01T10:00:00.7+02:00").when(k % 3 == 1, "2025-01-01T10:00:00Z").otherwise("2025-01-01T10:00:00")
    note = F.concat(F.lit("token=t"), k.cast("string"), F.lit(" at projects/p"), k.cast("string"))
    return read_table(spark, sf_dir, "customer").select(
        "c_custkey", clean.label_key(F.concat(F.lit("  "), "c_mktsegment")).alias("label"), clean.lenient_bool(word).alias("lenient"), clean.strict_bool(word).alias("strict"),
        F.date_format(clean.zoned_timestamp(stamp), "yyyy-MM-dd HH:mm:ss").alias("zoned"), clean.redact_diagnostic(note).alias("diagnostic"),
    )


@BOOK.query("""WITH s AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN '500' WHEN 1 THEN 'B1000' ELSE '1500 m' END AS b FROM orders) SELECT k, 'b' || CASE k % 3 WHEN 0 THEN '0500' WHEN 1 THEN '1000' ELSE '1500' END AS buffer_id, CASE WHEN k % 2 = 0 THEN 'pre' ELSE 'post' END AS role, 'pre60_post45' AS window_id,
  'b' || CASE k % 3 WHEN 0 THEN '0500' WHEN 1 THEN '1000' ELSE '1500' END || '_pre60_post45' AS combination_id FROM s""")
def scene_forms(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = read_table(spark, sf_dir, "orders").select(k.alias("k"), F.when(k % 3 == 0, "500").when(k % 3 == 1, "B1000").otherwise("1500 m").alias("buffer"), F.when(k % 2 == 0, "PRE_event").otherwise("Post").alias("role"), F.lit("Pre60-POST45").alias("window"))
    return selection.normalised_scenes(rows).select("k", "buffer_id", "role", "window_id", "combination_id")


@BOOK.query(f"""{_one}, {_events}, spoiled AS (SELECT component AS event_id, detection_count + CASE WHEN component LIKE '%5' THEN 1 ELSE 0 END AS n FROM ev WHERE component NOT LIKE '%8'), v AS (SELECT 'unexpected_key' AS "check", component AS key FROM ev WHERE component LIKE '%8' UNION ALL SELECT 'member_count', event_id FROM spoiled WHERE event_id LIKE '%5')
SELECT "check", key FROM v""")
def freeze_contract(spark, sf_dir):
    members = _members(spark, sf_dir, [ONE]).withColumn("event_id", F.col("component"))
    events = members.groupBy("configuration_id", "event_id").agg(F.count(F.lit(1)).alias("detection_count")).where(~F.col("event_id").endswith("8"))
    spoiled = events.withColumn("detection_count", F.when(F.col("event_id").endswith("5"), F.col("detection_count") + 1).otherwise(F.col("detection_count")))
    return quality.freeze_checks(cut(spoiled), cut(members)).select("check", "key")


@BOOK.query(f"""WITH {SCENES}, ord AS (SELECT * FROM (VALUES (0, 'b0500_pre30_post45'), {", ".join(f"({i + 1}, '{c}')" for i, c in enumerate(policy.FALLBACKS))}) t(attempt, combination_id)),
c AS (SELECT event_id, min(attempt) AS a FROM matrix JOIN ord USING (combination_id) WHERE rule_id = 'A' AND status = 'usable_both' GROUP BY 1) SELECT 'pair_complete' AS "check", CAST(event_id AS VARCHAR) AS key FROM c WHERE event_id % 6 = 0""")
def selection_contract(spark, sf_dir):
    chosen = policy.pair_selection(_matrix(spark, sf_dir), policy.BASELINE, "A")
    return quality.selection_checks(chosen.withColumn("post_scene", F.when(F.col("event_id") % 6 != 0, F.col("post_scene")))).select("check", "key")


@BOOK.query("""SELECT "check", key FROM (SELECT 'value_range' AS "check", CAST(event_id AS VARCHAR) AS key FROM events WHERE value > 300 UNION ALL SELECT 'event_type_code', CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'error')""")
def public_contract(spark, sf_dir):
    return quality.public_checks(read_table(spark, sf_dir, "events"), "event_id", {"value": (0.0, 300.0)}, {"event_type": ("click", "view", "purchase", "signup")}).select("check", "key")


@BOOK.query(f"""WITH {PIXELS}, g AS (SELECT row, col, avg(b8) AS v FROM px GROUP BY ALL),
p AS (SELECT c_custkey AS k, c_custkey % 7 - i AS down, c_custkey % 6 + 0.5 + j AS right_ FROM customer, range(-2, 3) a(i), range(-2, 3) b(j)),
f AS (SELECT k, CAST(greatest(0, least(7, down)) AS DOUBLE) AS fr, CAST(greatest(0, least(7, right_)) AS DOUBLE) AS fc FROM p), c AS (SELECT *, least(floor(fr), 6) AS r0, least(floor(fc), 6) AS c0 FROM f),
v AS (SELECT k, (1 - fr + r0) * ((1 - fc + c0) * a.v + (fc - c0) * b.v) + (fr - r0) * ((1 - fc + c0) * d.v + (fc - c0) * e.v) AS v FROM c JOIN g a ON a.row = r0 AND a.col = c0 JOIN g b ON b.row = r0 AND b.col = c0 + 1 JOIN g d ON d.row = r0 + 1 AND d.col = c0 JOIN g e ON e.row = r0 + 1 AND e.col = c0 + 1)
SELECT k, round(max(v) - min(v), 6) AS relief FROM v GROUP BY k""")
def relief_ranges(spark, sf_dir):
    grid = pixels(spark, sf_dir).groupBy("row", "col").agg(F.avg("b8").alias("value"))
    points = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.lit(0.0) - F.col("c_custkey") % 7).alias("lat"), (F.col("c_custkey") % 6 + 0.5).alias("lon"))
    return _rounded(raster.relief(points, grid, "k", 0.0, 0.0, 1.0, half=2))
