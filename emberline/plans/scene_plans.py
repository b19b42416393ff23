"""Incidents, samples, scenes and policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.operators import events as E
from emberline.operators import incidents, policy, sampling, scenes
from emberline.operators.proximity import nearest, radius_audit, radius_interval_matches
from emberline.plans.base import REFERENCES, Book, references
from emberline.plans.event_plans import ONE, _events, _extent, _flagged, _flags, _members, _one, _rounded
from emberline.runtime import cut, read_table

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles

_ev = f"""{_one}, {_events}, {REFERENCES}, pos AS (SELECT component AS event_id, avg(x_m) AS x_m, avg(y_m) AS y_m FROM joined GROUP BY 1), e AS (SELECT * FROM ev JOIN pos ON ev.component = pos.event_id),
met AS (SELECT reference_id, event_id, sqrt((e.x_m - r.x_m) ** 2 + (e.y_m - r.y_m) ** 2) AS distance_m, start_ts, end_ts, start_ts < CAST(window_end + 1 AS TIMESTAMP) AND end_ts >= CAST(window_start AS TIMESTAMP) AS now,
  (epoch_us(least(end_ts, CAST(window_end + 1 AS TIMESTAMP) - INTERVAL 1 MICROSECOND)) - epoch_us(greatest(start_ts, CAST(window_start AS TIMESTAMP)))) / 3.6e9 AS overlap_hours FROM e, refs r),
hits AS (SELECT * FROM met WHERE now AND distance_m <= 5000)"""


def _events_of(spark, sf_dir):
    return cut(E.summarise(_members(spark, sf_dir, [ONE]), ["component"]).withColumn("event_id", F.col("component")))


def _hits(spark, sf_dir):
    return radius_interval_matches(_events_of(spark, sf_dir), references(spark, sf_dir), 5000)


@BOOK.query(f"{_ev} SELECT reference_id, event_id, round(distance_m, 6) AS distance_m, round(overlap_hours, 6) AS overlap_hours FROM hits")
def incident_matches(spark, sf_dir):
    return _rounded(_hits(spark, sf_dir).select("reference_id", "event_id", "distance_m", "overlap_hours"))


@BOOK.query(f"""{_ev} SELECT r.reference_id, count(event_id) AS matched, coalesce(string_agg(event_id, ',' ORDER BY event_id), '') AS event_ids, min_by(event_id, (distance_m, event_id)) AS closest_event, round(min(distance_m), 6) AS closest_m,
  CASE count(event_id) WHEN 0 THEN 'no_cluster' WHEN 1 THEN 'one_cluster' ELSE 'multiple_clusters' END AS classification FROM refs r LEFT JOIN hits USING (reference_id) GROUP BY 1""")
def incident_summary(spark, sf_dir):
    return _rounded(incidents.match_summary(references(spark, sf_dir), _hits(spark, sf_dir)))


@BOOK.query(f"{_ev} SELECT reference_id, event_id, round(distance_m, 6) AS distance_m, CAST(row_number() OVER (PARTITION BY reference_id ORDER BY distance_m, event_id) AS INTEGER) AS rank FROM met QUALIFY rank <= 10")
def nearest_k(spark, sf_dir):
    return _rounded(nearest(_events_of(spark, sf_dir), references(spark, sf_dir), 10))


@BOOK.query(f"{_ev} SELECT reference_id, event_id, round(distance_m, 6) AS distance_m, CAST(row_number() OVER (PARTITION BY reference_id ORDER BY distance_m, event_id) AS INTEGER) AS rank FROM met WHERE now QUALIFY rank <= 10")
def nearest_k_in_window(spark, sf_dir):
    return _rounded(nearest(_events_of(spark, sf_dir), references(spark, sf_dir), 10, temporal=True))


@BOOK.query(f"""{_ev} SELECT reference_id, count(*) FILTER (now) AS contemporaneous, count(*) FILTER (now AND distance_m <= 1000) AS within_1000_m, count(*) FILTER (now AND distance_m <= 5000) AS within_5000_m, count(*) FILTER (now AND distance_m <= 15000) AS within_15000_m,
  round(min(distance_m) FILTER (now), 6) AS closest_m, min_by(event_id, (distance_m, event_id)) FILTER (now) AS closest_event, CASE WHEN count(*) FILTER (now AND distance_m <= 1000) > 0 THEN 'INDETERMINATE' WHEN count(*) FILTER (now AND distance_m <= 15000) > 0 THEN 'SPATIAL_THRESHOLD_MISS' ELSE 'NO_SIGNAL_NEAR_REFERENCE' END AS category FROM met GROUP BY 1""")
def radius_counts(spark, sf_dir):
    audit = radius_audit(_events_of(spark, sf_dir), references(spark, sf_dir), [1000.0, 5000.0, 15000.0])
    return _rounded(audit.join(incidents.miss_class(audit, "within_1000_m", "within_15000_m"), "reference_id"))


@BOOK.query(f"""{_ev}, long AS (SELECT unnest(['frp_max', 'duration_hours', 'detection_count']) AS metric, unnest([frp_max, duration_hours, CAST(detection_count AS DOUBLE)]) AS v FROM ev)
SELECT metric, count(v) AS cohort_count, round(min(v), 6) AS minimum, round(median(v), 6) AS median, round(quantile_disc(v, 0.25), 6) AS q25, round(quantile_disc(v, 0.75), 6) AS q75, round(quantile_disc(v, 0.9), 6) AS p90, round(quantile_disc(v, 0.95), 6) AS p95,
  round(quantile_disc(v, 0.99), 6) AS p99, round(max(v), 6) AS maximum, round(quantile_disc(v, 0.75) - quantile_disc(v, 0.25), 6) AS iqr FROM long GROUP BY 1""")
def cohort_distributions(spark, sf_dir):
    return _rounded(incidents.cohort_distributions(_events_of(spark, sf_dir), ["frp_max", "duration_hours", "detection_count"]))


@BOOK.query(f"""{_ev}, p AS (SELECT component, frp_max, 100 * cume_dist() OVER (ORDER BY frp_max) AS pct, CAST(count(*) OVER (ORDER BY frp_max RANGE UNBOUNDED PRECEDING) AS BIGINT) AS r FROM ev)
SELECT component AS event_id, frp_max AS value, round(pct, 6) AS percentile, r AS inclusive_rank FROM p WHERE component IN (SELECT event_id FROM hits)""")
def cohort_percentiles(spark, sf_dir):
    events = _events_of(spark, sf_dir)
    wanted = events.join(radius_interval_matches(events, references(spark, sf_dir), 5000), "event_id", "left_semi")
    return _rounded(incidents.percentile_ranks(events, wanted, "event_id", "frp_max"))


@BOOK.query(f"""{_ev}, g AS (SELECT *, (epoch_us(start_ts) - epoch_us(lag(end_ts) OVER (PARTITION BY reference_id ORDER BY start_ts, event_id))) / 3.6e9 AS gap FROM hits)
SELECT reference_id, count(*) AS matched, round(max(CASE WHEN gap IS NOT NULL THEN greatest(0.0, gap) END), 6) AS largest_gap_hours, coalesce(count(*) > 1 AND max(greatest(0.0, gap)) > 6, false) AS possible_fragmentation FROM g GROUP BY 1""")
def fragmentation(spark, sf_dir):
    return _rounded(incidents.fragmentation(_hits(spark, sf_dir), 6.0))


@BOOK.query(f"""{_ev} SELECT reference_id, h.event_id, count(*) AS detections, string_agg(detection_id, ',' ORDER BY ts, detection_id) AS chain FROM hits h JOIN joined j ON j.component = h.event_id GROUP BY 1, 2""")
def chronology(spark, sf_dir):
    members = _members(spark, sf_dir, [ONE]).withColumn("event_id", F.col("component"))
    out = incidents.chronology(_hits(spark, sf_dir), members)
    return out.select("reference_id", "event_id", F.size("detections").cast("long").alias("detections"), F.array_join(F.transform("detections", lambda d: d["detection_id"]), ",").alias("chain"))


@BOOK.query("""SELECT o_custkey AS incident_id, min(o_totalprice) AS lowest, max(o_totalprice) AS highest, string_agg(o_orderpriority, ';' ORDER BY o_orderpriority, o_totalprice) AS sources FROM orders GROUP BY 1""")
def claim_ranges(spark, sf_dir):
    claims = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("incident_id"), F.col("o_totalprice").alias("hectares"), F.col("o_orderpriority").alias("source"))
    return incidents.claim_ranges(claims).select("incident_id", "lowest", "highest", F.array_join(F.transform("claims", lambda c: c["source"]), ";").alias("sources"))


_grid_one = "grid AS (SELECT 'r1500_t06' AS configuration_id, 1500.0 AS radius_m, 6.0 AS hours)"
_strata = f"""{_one}, {_events}, {_extent}, {_grid_one}, {_flags}, many AS (SELECT component, row_number() OVER (ORDER BY detection_count, component) AS r, count(*) OVER () AS n FROM flagged WHERE detection_count > 1),
st AS (SELECT f.component AS event_id, strftime(start_ts, '%Y-%m') AS month, CASE WHEN detection_count = 1 THEN 'singleton' ELSE 'multi_detection' END AS size_class, CASE WHEN r IS NULL THEN 'not_applicable' ELSE 'Q' || CAST(least(4, CAST(ceil(r * 4 / n) AS INTEGER)) AS VARCHAR) END AS quartile,
  CASE WHEN len(sources) > 1 THEN 'multiple_sources' ELSE 'single_source' END AS source_class, CASE WHEN len(reasons) > 0 THEN 'possible_chain_merge' ELSE 'no_possible_chain_merge' END AS chain_class FROM flagged f LEFT JOIN many m ON m.component = f.component)"""


def _with_strata(spark, sf_dir):
    _, flagged = _flagged(spark, sf_dir, [ONE])
    return cut(sampling.with_strata(cut(flagged.withColumn("event_id", F.col("component")))))


@BOOK.query(f"{_strata} SELECT * FROM st")
def strata(spark, sf_dir):
    return _with_strata(spark, sf_dir).select("event_id", "month", "size_class", "quartile", "source_class", "chain_class")


@BOOK.query()
def stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(_with_strata(spark, sf_dir), 30, 20250719).select("event_id", "month", "size_class", "quartile", "source_class", "chain_class")


@BOOK.query()
def quota_shares(spark, sf_dir):
    rows = _with_strata(spark, sf_dir)
    return spark.createDataFrame([(f, k, n) for f in ("month", "size_class", "quartile", "source_class") for k, n in sampling.quotas(rows, f, 30).items()], "field string, value string, quota long")


@BOOK.query("""WITH s AS (SELECT unnest(['A', 'B', 'C']) AS slot), d AS (SELECT slot, 'c' || CAST(c_custkey AS VARCHAR) AS event_id FROM customer, s), h AS (SELECT *, sha256('round1' || chr(0) || 'p1' || chr(0) || slot || chr(0) || '77' || chr(0) || event_id) AS digest FROM d)
SELECT slot, row_number() OVER w AS "order", printf('%s-%04d', slot, row_number() OVER w) AS alias, event_id, digest FROM h WINDOW w AS (PARTITION BY slot ORDER BY digest, event_id)""")
def blind_order(spark, sf_dir):
    items = read_table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("event_id"))
    return sampling.blind_order(items, ["A", "B", "C"], 77, "round1", "p1")


#: Scenes from orders around events from customers, and the SQL twin.
SCENES = """evs AS (SELECT c_custkey AS event_id, c_mktsegment AS segment, CAST(DATE '1996-06-01' + CAST(c_custkey % 700 AS INTEGER) AS TIMESTAMP) AS start_ts, CAST(DATE '1996-06-01' + CAST(c_custkey % 700 AS INTEGER) AS TIMESTAMP) + to_hours(CAST(c_custkey % 5 AS INTEGER)) AS end_ts FROM customer),
sc AS (SELECT o_custkey AS event_id, 's' || CAST(o_orderkey AS VARCHAR) AS scene_id, start_ts + to_days(CAST(o_orderkey * 37 % 240 - 120 AS INTEGER)) AS acquired_at, o_orderkey % 11 <> 0 AS cloud_score_linked, o_orderkey AS k, start_ts, end_ts FROM orders JOIN evs ON event_id = o_custkey),
win AS (SELECT 'pre' || CAST(p AS VARCHAR) || '_post' || CAST(q AS VARCHAR) AS window_id, p, q FROM (VALUES (30), (60)) a(p), (VALUES (45), (90)) b(q)),
buf AS (SELECT * FROM (VALUES ('b0500', 500, 0), ('b1000', 1000, 1), ('b1500', 1500, 2)) t(buffer_id, buffer_m, bi)),
cand AS (
  SELECT sc.*, window_id, buffer_id, buffer_m, role, (85 + k % 16 - bi) / 100.0 AS coverage, (62 + k * 7 % 39) / 100.0 AS clear_050, (60 + k * 7 % 39) / 100.0 AS clear_060, (57 + k * 7 % 39) / 100.0 AS clear_065, k % 13 * 10 AS valid_px, k % 17 * 5 AS score_px,
    greatest(0.0, CASE WHEN role = 'pre' THEN epoch_us(start_ts) - epoch_us(acquired_at) ELSE epoch_us(acquired_at) - epoch_us(end_ts) END / 8.64e10) AS gap_days
  FROM sc, win, buf, (VALUES ('pre'), ('post')) r(role)
  WHERE CASE WHEN role = 'pre' THEN acquired_at BETWEEN start_ts - to_days(p) AND start_ts - to_days(5) ELSE acquired_at BETWEEN end_ts + to_days(5) AND end_ts + to_days(q) END),
rules AS (SELECT * FROM (VALUES ('A', 0.90, 0.70), ('B', 0.90, 0.70), ('C', 0.90, 0.70), ('D', 0.95, 0.80)) t(rule_id, coverage_min, clear_min)),
ruled AS (SELECT *, coalesce(cloud_score_linked AND coverage >= coverage_min AND clear >= clear_min AND valid_px > 0 AND score_px > 0, false) AS usable
  FROM (SELECT *, CASE rule_id WHEN 'A' THEN clear_050 WHEN 'C' THEN clear_065 ELSE clear_060 END AS clear FROM cand, rules)),
seen AS (
  SELECT event_id, buffer_id, window_id, rule_id, count(*) FILTER (role = 'pre') AS pre_scenes, count(*) FILTER (role = 'post') AS post_scenes, count(*) FILTER (role = 'pre' AND usable) AS pre_usable, count(*) FILTER (role = 'post' AND usable) AS post_usable,
    count(*) FILTER (role = 'pre' AND cloud_score_linked) AS pre_linked, count(*) FILTER (role = 'pre' AND valid_px > 0) AS pre_valid, count(*) FILTER (role = 'pre' AND coverage >= coverage_min) AS pre_covered,
    min((-coverage, -clear, gap_days, scene_id)) FILTER (role = 'pre' AND usable) AS pb, min((-coverage, -clear, gap_days, scene_id)) FILTER (role = 'post' AND usable) AS qb FROM ruled GROUP BY ALL),
matrix AS (
  SELECT e.event_id, e.segment, buffer_id || '_' || window_id AS combination_id, buffer_id, buffer_m, window_id, rule_id, coalesce(pre_scenes, 0) AS pre_scenes, coalesce(post_scenes, 0) AS post_scenes, coalesce(pre_usable, 0) AS pre_usable, coalesce(post_usable, 0) AS post_usable,
    CASE WHEN coalesce(pre_usable, 0) > 0 AND coalesce(post_usable, 0) > 0 THEN 'usable_both' WHEN coalesce(pre_scenes, 0) = 0 THEN 'no_pre_scene' WHEN coalesce(post_scenes, 0) = 0 THEN 'no_post_scene' WHEN coalesce(pre_usable, 0) = 0 THEN 'no_usable_pre_scene' ELSE 'no_usable_post_scene' END AS status,
    CASE WHEN coalesce(pre_scenes, 0) = 0 THEN 'no_pre_scene' WHEN pre_linked = 0 THEN 'cloud_score_unavailable' WHEN pre_valid = 0 THEN 'no_valid_pixels' WHEN pre_covered = 0 THEN 'coverage_below_threshold' WHEN pre_usable = 0 THEN 'clear_fraction_below_threshold' END AS pre_reason,
    pb[4] AS pre_scene, qb[4] AS post_scene, -pb[1] AS pre_coverage, -qb[1] AS post_coverage, -pb[2] AS pre_clear, -qb[2] AS post_clear, pb[3] AS pre_gap_days, qb[3] AS post_gap_days
  FROM evs e CROSS JOIN buf CROSS JOIN win CROSS JOIN rules LEFT JOIN seen USING (event_id, buffer_id, window_id, rule_id))"""


def scene_events(spark, sf_dir):
    k = F.col("c_custkey")
    start = F.date_add(F.lit("1996-06-01").cast("date"), (k % 700).cast("int")).cast("timestamp")
    return read_table(spark, sf_dir, "customer").select(k.alias("event_id"), F.col("c_mktsegment").alias("segment"), start.alias("start_ts"), (start + F.make_dt_interval(F.lit(0), (k % 5).cast("int"))).alias("end_ts"))


def scene_candidates(spark, sf_dir):
    k = F.col("k")
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("event_id"), F.col("o_orderkey").alias("k"))
    events = scene_events(spark, sf_dir)
    rows = orders.join(events, "event_id").select("event_id", "k", F.concat(F.lit("s"), k.cast("string")).alias("scene_id"), (F.col("start_ts") + F.make_dt_interval((k * 37 % 240 - 120).cast("int"))).alias("acquired_at"), (k % 11 != 0).alias("cloud_score_linked"), "start_ts", "end_ts")
    found = scenes.scenes_in_windows(scenes.event_windows(events), rows)
    buffers = F.broadcast(spark.createDataFrame([(b, m, i) for i, (b, m) in enumerate(scenes.BUFFERS.items())], "buffer_id string, buffer_m int, bi int"))
    return found.crossJoin(buffers).withColumns({
        "coverage": (85 + k % 16 - F.col("bi")) / 100.0, "clear_050": (62 + k * 7 % 39) / 100.0, "clear_060": (60 + k * 7 % 39) / 100.0, "clear_065": (57 + k * 7 % 39) / 100.0, "valid_px": k % 13 * 10, "score_px": k % 17 * 5,
    })


def _matrix(spark, sf_dir):
    events = scene_events(spark, sf_dir)
    return cut(scenes.observability_matrix(events, scene_candidates(spark, sf_dir)).join(events.select("event_id", "segment"), "event_id"))


@BOOK.query(f"WITH {SCENES} SELECT event_id, window_id, role, count(*) AS scenes FROM cand GROUP BY ALL")
def scene_windows(spark, sf_dir):
    return scene_candidates(spark, sf_dir).groupBy("event_id", "window_id", "role").agg(F.count(F.lit(1)).alias("scenes"))


@BOOK.query(f"""WITH {SCENES} SELECT event_id, buffer_id, window_id, role, rule_id, scene_id, CAST(row_number() OVER (PARTITION BY event_id, buffer_id, window_id, role, rule_id ORDER BY coverage DESC, clear DESC, gap_days, scene_id) AS INTEGER) AS place FROM ruled WHERE usable""")
def scene_rank(spark, sf_dir):
    keys = ["event_id", "buffer_id", "window_id", "role", "rule_id"]
    return scenes.ranked_scenes(scene_candidates(spark, sf_dir), keys).select(*keys, "scene_id", "place")


@BOOK.query(f"WITH {SCENES} SELECT event_id, combination_id, rule_id, status, pre_scenes, post_scenes, pre_usable, post_usable, pre_scene, post_scene, pre_reason, round(pre_gap_days, 6) AS pre_gap_days, round(CAST(post_clear AS DOUBLE), 6) AS post_clear FROM matrix")
def observability_matrix(spark, sf_dir):
    return _rounded(_matrix(spark, sf_dir).select("event_id", "combination_id", "rule_id", "status", "pre_scenes", "post_scenes", "pre_usable", "post_usable", "pre_scene", "post_scene", "pre_reason", "pre_gap_days", "post_clear"))


@BOOK.query(f"""WITH {SCENES} SELECT 'all' AS level, 'all' AS value, count(DISTINCT scene_id) AS scenes FROM cand UNION ALL SELECT 'role', role, count(DISTINCT scene_id) FROM cand GROUP BY 2 UNION ALL SELECT 'event', CAST(event_id AS VARCHAR), count(DISTINCT scene_id) FROM cand GROUP BY 2
  UNION ALL SELECT 'buffer', buffer_id, count(DISTINCT scene_id) FROM cand GROUP BY 2 UNION ALL SELECT 'role_window', role || ':' || window_id, count(DISTINCT scene_id) FROM cand GROUP BY 2""")
def scene_counts(spark, sf_dir):
    return scenes.scene_counts(scene_candidates(spark, sf_dir))


@BOOK.query(f"""WITH {SCENES}, d AS (SELECT event_id, strftime(start_ts, '%Y-%m') AS month, CASE WHEN event_id % 5 = 0 THEN 'single' WHEN event_id % 5 < 3 THEN 'small' ELSE 'large' END AS size_class, CASE event_id % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'noaa20' ELSE 'snpp' END AS source_class, CAST(end_ts - start_ts > to_hours(3) AS VARCHAR) AS chain FROM evs),
l AS (SELECT event_id, rule_id, status, unnest(['buffer_id', 'window_id', 'segment', 'month', 'size_class', 'source_class', 'chain']) AS dimension, unnest([buffer_id, window_id, segment, month, size_class, source_class, chain]) AS value FROM matrix JOIN d USING (event_id))
SELECT dimension, value, rule_id, count(*) AS rows, count(DISTINCT event_id) AS events, count(DISTINCT event_id) FILTER (status = 'usable_both') AS usable_events FROM l GROUP BY ALL""")
def dimension_report(spark, sf_dir):
    k, hours = F.col("event_id"), (F.unix_seconds("end_ts") - F.unix_seconds("start_ts")) / 3600
    sizes = F.when(k % 5 == 0, "single").when(k % 5 < 3, "small").otherwise("large")
    events = scene_events(spark, sf_dir).select(
        "event_id", F.date_format("start_ts", "yyyy-MM").alias("month"), sizes.alias("size_class"), F.when(k % 3 == 0, "both").when(k % 3 == 1, "noaa20").otherwise("snpp").alias("source_class"), (hours > 3).cast("string").alias("chain")
    )
    return scenes.dimension_report(_matrix(spark, sf_dir).join(events, "event_id"), ["buffer_id", "window_id", "segment", "month", "size_class", "source_class", "chain"])


@BOOK.query(f"WITH {SCENES} SELECT buffer_id, window_id, rule_id, count(*) AS events, count(*) FILTER (status = 'usable_both') AS usable_events, round(count(*) FILTER (status = 'usable_both') / count(*), 6) AS usable_rate FROM matrix GROUP BY ALL")
def sensitivity_cube(spark, sf_dir):
    return _rounded(scenes.sensitivity_cube(_matrix(spark, sf_dir)))


@BOOK.query(f"""WITH {SCENES}, s AS (SELECT rule_id, count(DISTINCT event_id) AS a, count(DISTINCT event_id) FILTER (pre_scenes > 0) AS b, count(DISTINCT event_id) FILTER (pre_scenes > 0 AND post_scenes > 0) AS c, count(DISTINCT event_id) FILTER (status = 'usable_both') AS d FROM matrix GROUP BY 1)
SELECT rule_id, unnest(['all', 'with_pre_scene', 'with_both_scenes', 'with_usable_pair']) AS stage, unnest([a, b, c, d]) AS events FROM s""")
def stage_table(spark, sf_dir):
    return scenes.stage_table(_matrix(spark, sf_dir))


_pol = f"""WITH {SCENES}, long AS (SELECT m.*, status = 'usable_both' AS good, dimension, value FROM matrix m, LATERAL (SELECT unnest(['overall', 'segment']) AS dimension, unnest(['all', m.segment]) AS value) d),
ways AS (SELECT dimension, value, rule_id, event_id, count(*) FILTER (good) AS n, bool_or(good AND combination_id = 'b0500_pre30_post45') AS base FROM long GROUP BY ALL),
sizes AS (SELECT dimension, value, rule_id, combination_id, count(*) AS n FROM long WHERE good GROUP BY ALL),
top AS (SELECT * FROM sizes QUALIFY n = max(n) OVER (PARTITION BY dimension, value, rule_id)),
env AS (SELECT DISTINCT l.dimension, l.value, l.rule_id, l.event_id FROM long l JOIN top t ON l.dimension = t.dimension AND l.value = t.value AND l.rule_id = t.rule_id AND l.combination_id = t.combination_id WHERE good),
pol AS (
  SELECT l.dimension, l.value, l.rule_id, l.combination_id, l.buffer_m, l.window_id, count(*) AS events, count(*) FILTER (good) AS usable_pairs, count(*) FILTER (good AND w.n = 1) AS exclusive, count(*) FILTER (good AND NOT base) AS rescued,
    coalesce(any_value(envn), 0) - count(*) FILTER (good AND env.event_id IS NOT NULL) AS lost,
    median(pre_coverage) FILTER (good) AS c1, median(post_coverage) FILTER (good) AS c2, median(pre_clear) FILTER (good) AS q1, median(post_clear) FILTER (good) AS q2, median(pre_gap_days) FILTER (good) AS g1, median(post_gap_days) FILTER (good) AS g2,
    quantile_cont(CAST(pre_coverage AS DOUBLE), 0.1) FILTER (good) AS k1, quantile_cont(CAST(post_coverage AS DOUBLE), 0.1) FILTER (good) AS k2, quantile_cont(CAST(pre_clear AS DOUBLE), 0.1) FILTER (good) AS p1, quantile_cont(CAST(post_clear AS DOUBLE), 0.1) FILTER (good) AS p2, quantile_cont(pre_gap_days, 0.9) FILTER (good) AS n1, quantile_cont(post_gap_days, 0.9) FILTER (good) AS n2,
    count(DISTINCT pre_scene) FILTER (good) AS distinct_pre, CAST(sum(pre_scenes) + sum(post_scenes) AS BIGINT) AS inventory_rows
  FROM long l JOIN ways w USING (dimension, value, rule_id, event_id) LEFT JOIN env USING (dimension, value, rule_id, event_id) LEFT JOIN (SELECT dimension, value, rule_id, count(*) AS envn FROM env GROUP BY ALL) USING (dimension, value, rule_id) GROUP BY ALL)"""


@BOOK.query(f"""{_pol} SELECT dimension, value, rule_id, combination_id, events, usable_pairs, exclusive, rescued, lost, round(CAST(c1 AS DOUBLE), 6) AS pre_coverage_median, round(CAST(q2 AS DOUBLE), 6) AS post_clear_median, round(g1, 6) AS pre_gap_days_median, round(p1, 6) AS pre_clear_p10, round(n2, 6) AS post_gap_days_p90, distinct_pre, inventory_rows FROM pol""")
def policy_matrix(spark, sf_dir):
    out = policy.policy_matrix(_matrix(spark, sf_dir), ["segment"])
    return _rounded(out.select("dimension", "value", "rule_id", "combination_id", "events", "usable_pairs", "exclusive", "rescued", "lost", "pre_coverage_median", "post_clear_median", "pre_gap_days_median", "pre_clear_p10", "post_gap_days_p90", "distinct_pre", "inventory_rows"))


_hi, _lo = (lambda c: f"coalesce(CAST({c} AS DOUBLE), 'inf'::DOUBLE)"), (lambda c: f"coalesce(CAST({c} AS DOUBLE), '-inf'::DOUBLE)")
_place = f"""-usable_pairs AS a, lost AS b, {_hi("g1")} + {_hi("g2")} AS c, {_hi("n1")} + {_hi("n2")} AS d, -least({_lo("p1")}, {_lo("p2")}) AS e, -least({_lo("k1")}, {_lo("k2")}) AS f, -({_lo("q1")} + {_lo("q2")}) AS g, -({_lo("c1")} + {_lo("c2")}) AS h,
  buffer_m AS i, (buffer_m / 500.0) ** 2 * (CAST(regexp_extract(window_id, 'pre(\\d+)', 1) AS INTEGER) + CAST(regexp_extract(window_id, 'post(\\d+)', 1) AS INTEGER)) / 75.0 AS j"""


@BOOK.query(f"""{_pol}, r AS (SELECT dimension, value, rule_id, combination_id, window_id, {_place} FROM pol)
SELECT dimension, value, rule_id, combination_id, CAST(row_number() OVER (s ORDER BY a, b, c, d, e, f, g, h, i, j, window_id, combination_id) AS INTEGER) AS rank, CAST(rank() OVER (s ORDER BY a, b, c, d, e, f, g, h, i, j) AS INTEGER) AS rank_group,
  count(*) OVER (PARTITION BY dimension, value, rule_id, a, b, c, d, e, f, g, h, i, j) AS tie_size, row_number() OVER (s ORDER BY a, b, c, d, e, f, g, h, i, j, window_id, combination_id) = 1 AS is_best FROM r WINDOW s AS (PARTITION BY dimension, value, rule_id)""")
def policy_rank(spark, sf_dir):
    out = policy.ranked_policies(policy.policy_matrix(_matrix(spark, sf_dir), ["segment"]))
    return out.select("dimension", "value", "rule_id", "combination_id", "rank", "rank_group", "tie_size", "is_best")


_order = "ord AS (SELECT * FROM (VALUES (0, 'b0500_pre30_post45'), " + ", ".join(f"({i + 1}, '{c}')" for i, c in enumerate(policy.FALLBACKS)) + ") t(attempt, combination_id))"
_att = f"WITH {SCENES}, {_order}, att AS (SELECT event_id, attempt, combination_id, status = 'usable_both' AS usable, min(attempt) FILTER (status = 'usable_both') OVER (PARTITION BY event_id) AS f FROM matrix JOIN ord USING (combination_id) WHERE rule_id = 'A')"


@BOOK.query(f"{_att} SELECT event_id, attempt, combination_id, usable, CASE WHEN attempt = f THEN 'selected' WHEN usable THEN 'available' ELSE 'none' END AS label FROM att")
def fallback_attempts(spark, sf_dir):
    return policy.fallback_attempts(_matrix(spark, sf_dir), policy.BASELINE, "A")


@BOOK.query(f"""{_att}, c AS (SELECT event_id, min_by(combination_id, attempt) FILTER (attempt = f) AS combination_id, any_value(f) AS f FROM att GROUP BY 1)
SELECT c.event_id, coalesce(f = 0, false) AS primary_sufficient, coalesce(f > 0, true) AS fallback_required,
  CASE WHEN f > 0 THEN CASE WHEN c.combination_id LIKE 'b0500%' THEN 'temporal_extension' WHEN c.combination_id LIKE '%pre30_post45' THEN 'buffer_expansion' ELSE 'buffer_expansion_and_temporal_extension' END END AS fallback_type, c.combination_id AS selected_combination,
  (SELECT min(rule_id) FROM matrix m WHERE m.event_id = c.event_id AND m.combination_id = c.combination_id AND status = 'usable_both') AS minimum_rule, m.pre_scene, m.post_scene
FROM c LEFT JOIN matrix m ON m.event_id = c.event_id AND m.combination_id = c.combination_id AND m.rule_id = 'A'""")
def fallback(spark, sf_dir):
    return policy.pair_selection(_matrix(spark, sf_dir), policy.BASELINE, "A")


@BOOK.query(f"WITH {SCENES} SELECT rule_id, count(DISTINCT event_id) AS events FROM matrix WHERE status = 'usable_both' GROUP BY 1")
def policy_envelope(spark, sf_dir):
    return policy.envelope(_matrix(spark, sf_dir))


@BOOK.query(f"WITH {SCENES} SELECT combination_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS events FROM matrix WHERE rule_id = 'B' AND status = 'usable_both' GROUP BY 1")
def policy_event_sets(spark, sf_dir):
    return policy.event_sets(_matrix(spark, sf_dir), "B").select("combination_id", F.array_join(F.transform("events", lambda e: e.cast("string")), ",").alias("events"))
