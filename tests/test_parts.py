import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.functions import clean, geo
from emberline.operators import events, incidents, polygons, proximity, quality, raster, sampling, scenes
from emberline.operators.ranking import blocked
from emberline.plans.event_plans import golden_distance
from emberline.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_published_distance_and_round_trips(spark):
    assert golden_distance(spark).first().d == pytest.approx(3076.389, abs=0.01)
    lon, lat = geo.utm_inverse(*geo.utm_forward(F.lit(-79.52), F.lit(8.98)))
    assert (one(spark, lon), one(spark, lat)) == (pytest.approx(-79.52, abs=1e-9), pytest.approx(8.98, abs=1e-9))
    lon, lat = geo.utm_inverse(*geo.utm_forward(F.lit(-75.1), F.lit(3.0), 18), 18)
    assert (one(spark, lon), one(spark, lat)) == (pytest.approx(-75.1, abs=1e-9), pytest.approx(3.0, abs=1e-9))
    assert one(spark, geo.to_degrees(F.lit(9999), F.lit(1.0), F.lit(1.0))[0]) is None
    assert one(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(111.195, abs=1e-3)


@pytest.mark.parametrize(
    ("date", "time", "expected"),
    [
        ("2026/01/02", "0345", "2026-01-02 03:45:00"), ("20260102", "3:45", "2026-01-02 03:45:00"), ("2026-01-02T09:00", "34501", None), ("2026-01-02 x", "034501", "2026-01-02 03:45:01"), ("2026-99-99", "0345", None),
        ("2026-01-02", "2560", None), ("N/A", "0345", None), ("2026-01-02", "", None), ("2026-01-02", "5", "2026-01-02 00:05:00"), ("2026-02-30", "0000", None), ("2026-01-02", "12:00:61", None),
    ],
)
def test_dates_and_times(spark, date, time, expected):
    assert one(spark, F.date_format(clean.acquisition_timestamp(F.lit(date), F.lit(time)), "yyyy-MM-dd HH:mm:ss")) == expected


def test_text_forms(spark):
    assert [one(spark, clean.number(F.lit(x))) for x in (" 8.5 ", "nan", "inf", "x", "No Data", "-1e3")] == [8.5, None, None, None, None, -1000.0]
    assert [one(spark, clean.valid_coordinates(F.lit(a), F.lit(b))) for a, b in (("8.98", "-79.52"), ("91", "0"), ("0", "181"), ("", "0"))] == [True, False, False, False]
    assert [one(spark, F.date_format(clean.zoned_timestamp(F.lit(x)), "yyyy-MM-dd HH:mm:ss")) for x in ("2025-01-01T10:00:00.9Z", "2025-01-01T10:00:00+0200", "2025-01-01T10:00:00")] == ["2025-01-01 10:00:00", "2025-01-01 08:00:00", None]
    assert [one(spark, clean.lenient_bool(F.lit(x))) for x in ("Sí", " yes", "0", "no")] == [True, True, False, False]
    assert [one(spark, clean.strict_bool(F.lit(x))) for x in ("True", "false", "1")] == [True, False, None]
    assert one(spark, clean.label_key(F.lit("  COCLÉ   Norte"))) == "cocle norte"
    assert one(spark, clean.redact_url(F.lit("http://h/k/a b/a%20b/x"), "a b")) == "http://h/k/[redacted]/[redacted]/x"
    assert [one(spark, clean.trimmed_float(F.lit(x))) for x in (1.5, 2.0, 0.1234567891, float("nan"))] == ["1.5", "2", "0.12345679", ""]
    assert one(spark, clean.redact_diagnostic(F.lit("token=abc projects/p1/x [1.5, -2.5]"))) == "token=[redacted] projects/[redacted]/x [redacted geometry]"


def test_date_chunks(spark):
    got = one(spark, clean.date_chunks(F.lit("2025-01-01").cast("date"), F.lit("2025-01-12").cast("date"), 5))
    assert [(r.chunk_start.day, r.chunk_end.day) for r in got] == [(1, 5), (6, 10), (11, 12)]
    assert one(spark, clean.date_chunks(F.lit("2025-01-02").cast("date"), F.lit("2025-01-01").cast("date"), 5)) == []


SQUARE = [(-80, 8), (-79, 8), (-79, 9), (-80, 9), (-80, 8)]
HOLE = [(-79.6, 8.4), (-79.4, 8.4), (-79.4, 8.6), (-79.6, 8.6), (-79.6, 8.4)]


def test_polygon_edges_and_holes(spark):
    edges = polygons.edge_table(spark, [[SQUARE, HOLE]])
    points = {"in": (-79.9, 8.1), "out": (-78, 8.5), "edge": (-80, 8.5), "corner": (-79, 9), "hole": (-79.5, 8.5), "hole_edge": (-79.6, 8.5), "hole_corner": (-79.4, 8.4)}
    table = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in points.items()], "k string, x_m double, y_m double")
    assert {r.k for r in polygons.points_in_polygons(table, edges, "k").collect()} == {"in", "edge", "corner"}
    area = polygons.areas(edges).first()
    assert (area.area, area.centroid_x, area.centroid_y) == (pytest.approx(0.96), pytest.approx(-79.5), pytest.approx(8.5))
    assert polygons.ring_violations(edges).count() == 0
    inside = polygons.interior_points(edges).first()
    assert (inside.x, inside.y) != (-79.5, 8.5)


def test_points_meet_their_own_polygon_alone(spark):
    """Forty copies of a holed square in one place, each with a point inside and one only inside the others."""
    edges = polygons.edge_table(spark, [[SQUARE, HOLE]] * 40 + [[[(0, 0), (1, 0), (1, 1), (0, 0)]]])
    table = spark.createDataFrame([(f"{p}{n}", p, x, y) for p in range(41) for n, x, y in (("in", -79.9, 8.1), ("hole", -79.5, 8.5))], "k string, polygon int, x_m double, y_m double")
    found = polygons.points_in_polygons(table, edges, "k", own=True)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.k, r.polygon) for r in found.collect()} == {(f"{p}in", p) for p in range(40)}
    got = {r.polygon: (round(r.x, 9), round(r.y, 9)) for r in polygons.interior_points(edges).collect()}
    assert got == {p: (-79.95, 8.05) for p in range(40)} | {40: (round(2 / 3, 9), round(1 / 3, 9))}


def test_ring_checks_and_nesting(spark):
    bow = [(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]
    thin = [(0, 0), (1, 1), (2, 2), (0, 0)]
    bad = polygons.edge_table(spark, [[bow], [thin], [[(0, 0), (1, 0), (1, 1), (5, 5)]]])
    got = {(r.polygon, r.problem) for r in polygons.ring_violations(bad).collect()}
    assert (0, "crosses_itself") in got and (1, "no_area") in got and (2, "open") in got
    rings = [[(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(1, 1), (8, 1), (8, 8), (1, 8), (1, 1)], [(2, 2), (3, 2), (3, 3), (2, 3), (2, 2)]]
    assert {(r.ring, r.depth, r.is_hole) for r in polygons.nesting(polygons.edge_table(spark, [rings])).collect()} == {(0, 0, False), (1, 1, True), (2, 2, False)}


def test_simplification_keeps_extremes(spark):
    ring = [(x / 10, 0.0) for x in range(0, 100)] + [(10.0, y / 10) for y in range(0, 100)] + [(x / 10, 10.0) for x in range(100, 0, -1)] + [(0.0, y / 10) for y in range(100, 0, -1)]
    ring = [*ring, ring[0]]
    before = polygons.edge_table(spark, [[ring]])
    after = polygons.simplified_rings(before, 0.05)
    assert after.count() <= 8
    gate = polygons.simplification_gates(before, after).first()
    assert gate.same_box and gate.valid and gate.area_change < 1e-9


def test_quotas_and_sample(spark):
    assert sampling.largest_remainder({"a": 5, "b": 3, "c": 1}, 4) == {"a": 2, "b": 1, "c": 1}
    assert sampling.largest_remainder({"a": 97, "b": 2, "c": 1}, 3) == {"a": 1, "b": 1, "c": 1}
    with pytest.raises(ValueError):
        sampling.largest_remainder({"a": 1}, 2)
    rows = [(f"e{i:02d}", 1 if i % 2 else 2 + i % 7, dt.datetime(2025, 1 + i % 4, 3), 1 + i % 2, i % 3 == 0, float(i)) for i in range(40)]
    table = spark.createDataFrame(rows, "event_id string, detection_count long, start_ts timestamp, source_count long, possible_chain_merge boolean, frp double")
    strata = sampling.with_strata(table)
    a = {r.event_id for r in sampling.stratified_sample(strata, 12, 7).collect()}
    assert len(a) == 12 and a == {r.event_id for r in sampling.stratified_sample(strata.repartition(5), 12, 7).collect()}
    assert a == {r.event_id for r in sampling.stratified_sample(sampling.with_strata(table.withColumn("frp", -F.col("frp"))), 12, 7).collect()}
    picked = strata.where(F.col("event_id").isin(list(a)))
    assert {r[0]: r[1] for r in picked.groupBy("size_class").count().collect()} == sampling.quotas(strata, "size_class", 12)
    assert {r[0]: r[1] for r in picked.where("quartile <> 'not_applicable'").groupBy("quartile").count().collect()} == sampling.quotas(strata.where("quartile <> 'not_applicable'"), "quartile", 6)


def test_quartiles_are_not_ntile(spark):
    rows = [(f"e{i}", 2 + i, dt.datetime(2025, 1, 1), 1, False) for i in range(5)]
    table = spark.createDataFrame(rows, "event_id string, detection_count long, start_ts timestamp, source_count long, possible_chain_merge boolean")
    assert [r.quartile for r in sampling.with_strata(table).orderBy("event_id").collect()] == ["Q1", "Q2", "Q3", "Q4", "Q4"]


def test_blocked_ranks(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 37 % 500).alias("v"))
    got = blocked(rows, ["k"], F.floor(F.col("v") / 50), [F.col("v")], rank="r", value=F.col("v"), total="s").collect()
    for k in range(3):
        own = sorted((r for r in got if r.k == k), key=lambda r: r.v)
        assert [r.r for r in own] == list(range(len(own)))
        assert [r.s for r in own] == [sum(x.v for x in own[:i]) for i in range(len(own))]


def test_overlap_fraction(spark):
    value, clipped, bad = raster.clipped_fraction(F.col("x"))
    rows = spark.createDataFrame([(1 + 5e-10,), (1.01,), (0.5,), (-2e-9,), (None,)], "x double").select(value.alias("v"), clipped.alias("c"), bad.alias("b")).collect()
    assert [tuple(r) for r in rows] == [(1.0, True, False), (None, False, True), (0.5, False, False), (None, False, True), (None, False, False)]


def test_composite_before_index(spark):
    rows = [(0, 0, 0.5, 0.1), (0, 0, 0.3, 0.4), (0, 0, 0.9, 0.2)]
    got = raster.median_composite(spark.createDataFrame(rows, "row int, col int, b8 double, b12 double"), [], ["b8", "b12"]).first()
    assert (got.b8, got.b12) == (0.5, 0.2)


def test_hull_and_border(spark):
    plus = [(1, r, c) for r, c in ((0, 1), (1, 0), (1, 1), (1, 2), (2, 1))]
    mask = spark.createDataFrame(plus, "patch int, row int, col int")
    assert raster.hull_areas(mask, ["patch"]).first().hull_px == 7.0
    assert raster.border(mask, ["patch"]).count() == 4


def test_hull_shares_grow_with_the_rows(spark):
    from pyspark.sql import functions as F

    mask = spark.range(6000).select(F.col("id").alias("patch"), F.lit(0).alias("row"), F.lit(0).alias("col"))
    areas = raster.hull_areas(mask, ["patch"], per=10)
    assert {(r.hull_px, r.n) for r in areas.groupBy("hull_px").agg(F.count(F.lit(1)).alias("n")).collect()} == {(1.0, 6000)}
    assert "), 600)" in areas._jdf.queryExecution().optimizedPlan().toString()


def test_strict_checks(spark):
    bad = quality.repeated_keys(spark.createDataFrame([(1,), (1,)], "k int"), ["k"])
    with pytest.raises(quality.ContractError, match="repeated_key 1"):
        quality.strict(bad)
    quality.strict(bad.where("key = 'none'"))
    schema = spark.createDataFrame([], "a int, b struct<token:string,c:array<struct<Secret:int>>>").schema
    assert quality.forbidden_columns(schema, {"token", "secret"}) == ["b.token", "b.c.Secret"]


HEAD = "latitude,longitude,acq_date,acq_time,satellite,instrument,confidence,frp,daynight"


def test_detection_files(spark, tmp_path):
    texts = {
        "a.csv": HEAD + "\n8.5,-79.5,2025-01-02,0345,N20,VIIRS,nominal,12.5,D\n8.6,-79.5,2025-01-02,0345,N20,VIIRS,,,D\n",
        "b.csv": "﻿LAT,Lon,Date,Time,Platform,Sensor,Conf,FRP\n8.7,-79.1,2025-01-03,1200,N,VIIRS,h,1\n",
        "c.csv": HEAD.replace(",frp", "") + "\n8.5,-79.5,2025-01-02,0345,N20,VIIRS,nominal,D\n", "d.csv": "<html><body>error</body></html>", "e.csv": HEAD + ",lat\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    rows, found = files.scan_detection_files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in found.collect()}
    assert {n: r.schema_valid for n, r in got.items()} == {"a.csv": True, "b.csv": True, "c.csv": False, "d.csv": False, "e.csv": False}
    assert got["c.csv"].error == "missing: frp" and got["d.csv"].error == "html body" and got["e.csv"].error == "ambiguous: latitude" and got["a.csv"].record_count == 2
    table = sorted(rows.collect(), key=lambda r: (r.raw_file, r.source_row_number))
    assert [(r.latitude, r.source_row_number, r.frp, r.daynight) for r in table] == [("8.5", 1, "12.5", "D"), ("8.6", 2, "", "D"), ("8.7", 1, "1", "")]
    lined = rows.withColumn("firms_source", F.col("raw_file"))
    assert quality.lineage_checks(lined, found).count() == 0
    assert quality.lineage_checks(lined.withColumn("source_row_number", F.col("source_row_number") + 5), found).count() == 6


def test_boundaries_manifests_registry(spark, tmp_path):
    ring = [list(map(float, p)) for p in SQUARE]
    doc = {"type": "FeatureCollection", "crs": {"type": "name"}, "features": [{"type": "Feature", "properties": {"name": n}, "geometry": {"type": t, "coordinates": c}} for n, t, c in (("Coclé", "Polygon", [ring]), ("Two", "MultiPolygon", [[ring], [ring]]))]}
    (tmp_path / "b.json").write_text(json.dumps(doc))
    got = files.read_boundaries(spark, str(tmp_path / "b.json"), "COCLE").collect()
    assert len(got) == 1 and got[0].crs and polygons.geojson_edges(files.read_boundaries(spark, str(tmp_path / "b.json"), "cocle")).count() == 4
    assert polygons.geojson_edges(files.read_boundaries(spark, str(tmp_path / "b.json"), "two")).count() == 8
    (tmp_path / "p.json").write_text(json.dumps({"type": "Polygon", "coordinates": [ring]}))
    bare = files.read_boundaries(spark, str(tmp_path / "p.json"))
    assert bare.first().crs is None and polygons.geojson_edges(bare).count() == 4
    good = dict.fromkeys(files.MANIFEST.names, "x") | {"source": "S", "start_date": "2025-01-01", "end_date": "2025-01-05", "status": "downloaded", "sha256": "0" * 64, "size_bytes": 5, "record_count": 1, "raw_filename": "f", "bbox": [1, 2, 3, 4], "error_message": None}
    (tmp_path / "m").mkdir()
    (tmp_path / "m/1.json").write_text(json.dumps(good))
    (tmp_path / "m/2.json").write_text(json.dumps(good | {"status": "odd", "sha256": "xyz", "bbox": [1], "error_message": "key S3CRET"}))
    checks = {r.check for r in files.manifest_violations(files.read_manifests(spark, str(tmp_path / "m")), "S3CRET").collect()}
    assert checks == {"status_code", "hash_form", "bbox_has_four", "no_secret"}
    (tmp_path / "m/3.json").write_text(json.dumps({k: v for k, v in good.items() if k != "area"} | {"sha256": None, "size_bytes": -1, "url_sanitized": "?k=S3C%2FRET"}))
    checks = sorted(r.check for r in files.manifest_violations(files.read_manifests(spark, str(tmp_path / "m/3.json")), "S3C/RET").collect())
    assert checks == ["all_fields", "hash_form", "no_secret", "size_not_negative"]
    registry = {"incidents": [{"incident_id": "i1", "name": "n", "anchors": [{"anchor_id": "a", "latitude": 8.5, "longitude": -80.4}], "sources": [{"source_id": "s", "title": "t", "url": "u"}], "claims": [{"source_id": "s", "hectares": 10.0}, {"source_id": "s", "hectares": 12.0}]}]}
    (tmp_path / "r.json").write_text(json.dumps(registry))
    parts = files.read_incidents(spark, str(tmp_path / "r.json"))
    assert {k: v.count() for k, v in parts.items()} == {"incidents": 1, "anchors": 1, "sources": 1, "claims": 2}
    (tmp_path / "av.csv").write_text("data_id,min_date,max_date\n viirs_sp,2025-01-01,2025-02-01\n")
    assert tuple(files.read_availability(spark, str(tmp_path / "av.csv")).first()) == ("VIIRS_SP", dt.date(2025, 1, 1), dt.date(2025, 2, 1))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, 1.50, True, None, ["b"]), (1, 0.25, False, "x", [])], "id int, v double, ok boolean, s string, l array<string>")
    files.write_csv(rows, str(tmp_path / "c"), ["id", "v", "ok", "s", "l"], ["id"])
    lines = [x for p in sorted((tmp_path / "c").glob("part-*")) for x in p.read_text().splitlines() if not x.startswith("id,")]
    assert lines == ["1,0.25,false,x,[]", '2,1.5,true,,"[\\"b\\"]"']
    assert files.write_once(rows, str(tmp_path / "w")) == "written" and files.write_once(rows.repartition(3), str(tmp_path / "w")) == "same"
    with pytest.raises(ValueError):
        files.write_once(rows.where("id = 1"), str(tmp_path / "w"))
    assert files.hash_manifest(spark, str(tmp_path / "w")).count() >= 1
    feature = json.loads(files.geojson_lines(rows.withColumns({"lon": F.lit(-80.1234567), "lat": F.lit(8.5)}).where("id = 1"), "lon", "lat", ["id", "s"]).first().value)
    assert feature == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-80.123457, 8.5]}, "properties": {"id": 1, "s": "x"}}
    files.write_json_report(rows.limit(1), str(tmp_path / "r"))
    files.write_json_lines(rows, str(tmp_path / "l"), ["id"])
    files.typed_empty(spark, "a int, b string", str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).columns == ["a", "b"] and spark.read.json(str(tmp_path / "l")).count() == 2


def test_write_once_counts_repeated_rows(spark, tmp_path):
    path = str(tmp_path / "once")
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "a int")
    assert files.write_once(rows(1, 1, 3), path) == "written"
    assert files.write_once(rows(3, 1, 1), path) == "same"
    with pytest.raises(ValueError):
        files.write_once(rows(2, 2, 3), path)
    with pytest.raises(ValueError):
        files.write_once(rows(1, 3), path)


def test_fields_beyond_the_64th_column_are_read(spark, tmp_path):
    names = [f"extra{i}" for i in range(70)] + ["Latitude ", "﻿longitude", "Acq Date", "acq-time", "satellite", "instrument", "confidence", "FRP"]
    cells = ["x"] * 70 + ["8.5", "-79.5", "2025-01-02", "0345", "N20", "VIIRS", "n", "12.5"]
    (tmp_path / "wide.csv").write_text(",".join(names) + "\n" + ",".join(cells) + "\n", encoding="utf-8")
    rows, found = files.scan_detection_files(spark, str(tmp_path))
    assert found.first()["schema_valid"]
    (r,) = rows.collect()
    assert (r.latitude, r.longitude, r.acq_date, r.acq_time, r.frp) == ("8.5", "-79.5", "2025-01-02", "0345", "12.5")


def test_ranks_count_values_within_the_slack(spark):
    cohort = spark.createDataFrame([(str(i), v) for i, v in enumerate([1.0, 1.0 + 1e-13, 1.0 + 1e-9, 5.0, 2.0, None, -3.0, 2.0 - 1e-13])], "k string, v double")
    got = {r.k: r.inclusive_rank for r in incidents.percentile_ranks(cohort, cohort, "k", "v").collect()}
    assert got == {"6": 1, "0": 3, "1": 3, "2": 4, "4": 6, "7": 6, "3": 7}
    few = spark.createDataFrame([("a", 1.5), ("b", 99.0), ("c", -99.0)], "k string, v double")
    assert {r.k: r.inclusive_rank for r in incidents.percentile_ranks(cohort, few, "k", "v").collect()} == {"a": 4, "b": 7, "c": 0}


def test_cross_source_pairs_at_any_latitude(spark):
    rng = random.Random(6)
    places = [(rng.uniform(-180, 180), rng.choice([-1, 1]) * rng.uniform(55, 90)) for _ in range(150)] + [(179.995, 10.0), (-179.99, 89.9), (100.0, 89.95)]
    rows = []
    for i, (lon, lat) in enumerate(places):
        rows.append((f"a{i}", "s1", lon, lat))
        lon2 = (lon + rng.uniform(-0.03, 0.03) / max(0.001, math.cos(math.radians(lat))) + 540) % 360 - 180
        rows.append((f"b{i}", "s2", lon2, max(-90.0, min(90.0, lat + rng.uniform(-0.01, 0.01)))))

    def apart(p, q):
        a, b = math.radians(p[3]), math.radians(q[3])
        h = math.sin((a - b) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(p[2] - q[2]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h)))

    table = spark.createDataFrame(rows, "detection_id string, firms_source string, lon double, lat double").withColumn("ts", F.lit("2025-01-01").cast("timestamp"))
    got = sorted((r.a, r.b) for r in proximity.cross_source_pairs(table, 2.0, 90.0).collect())
    assert got == sorted((p[0], q[0]) for p in rows for q in rows if p[1] < q[1] and apart(p, q) <= 2.0) and len(got) > 30


def test_extents_of_scattered_points(spark):
    """No two points share a coordinate; only the rim may be paired."""
    rng = np.random.default_rng(3)
    shapes = {"disk": rng.normal(size=(20_000, 2)), "line": np.outer(rng.random(3000), [1000.0, 1.0]) + rng.random((3000, 2)), "one": np.array([[5.0, 5.0]]), "two": np.array([[0.0, 0.0], [3.0, 4.0]])}
    rows = [(k, float(x), float(y)) for k, p in shapes.items() for x, y in p]
    got = {r.k: r for r in events.extents(spark.createDataFrame(rows, "k string, x_m double, y_m double"), ["k"]).collect()}
    for k, p in shapes.items():
        widest = max(float(np.sqrt(((p - q) ** 2).sum(axis=1)).max()) for q in p[np.argsort(-np.sqrt(((p - p.mean(axis=0)) ** 2).sum(axis=1)))[:300]])
        assert got[k].max_pairwise_distance_m == pytest.approx(widest)
        assert got[k].max_distance_to_centroid_m == pytest.approx(float(np.sqrt(((p - p.mean(axis=0)) ** 2).sum(axis=1)).max()))


def test_support_covers_every_member(spark):
    members = spark.createDataFrame([("a", 500_000.0 + 137 * i, 900_000.0 - 7919 * i) for i in range(40)], "k string, x_m double, y_m double")
    grid = raster.pixels_around(members, ["k"], 1000.0, 500.0, 500000.0, 940000.0)
    got = raster.support_pixels(grid, members, ["k"], 1000.0).withColumns({"px": 500000 + F.col("col") * 500.0, "py": 940000 + F.col("row") * 500.0}).collect()
    for m in members.collect():
        near = sum(math.hypot(r.px - m.x_m, r.py - m.y_m) <= 1000.0 for r in got)
        assert near >= 11


def test_catalog_counts_equal_the_scenes_listed(spark):
    """Windows within a day, across days and years, empty and before 1970; many windows and scenes alike."""
    rng = random.Random(4)
    at = lambda hours: dt.datetime(1969, 12, 1) + dt.timedelta(seconds=hours * 3600)
    catalog = [(i, i % 3, at(rng.choice([rng.uniform(0, 24 * 900), 24 * rng.randrange(900)]))) for i in range(1500)]
    windows = [(i, i % 4, at(a), at(a + rng.choice([0, 5, 24, 30, 24 * 40, 24 * 800, -7]))) for i in range(300) for a in [rng.choice([rng.uniform(0, 24 * 900), 24.0 * rng.randrange(900)])]]
    windows += [(1000 + i, 1, at(24 * 40), at(24 * 70)) for i in range(50)]
    w = spark.createDataFrame(windows, "event_id int, tile int, opens timestamp, closes timestamp")
    c = spark.createDataFrame(catalog, "scene_id int, tile int, acquired_at timestamp")
    got = {r.event_id: (r.scenes, r.first_scene) for r in scenes.catalog_counts(w, c).collect()}
    expected = {i: (len(met), min(met)) for i, tile, a, b in windows for met in [[k for k, s, t in catalog if s == tile and a <= t <= b]] if met}
    assert got == expected and len(got) > 150
    listed = {(r.event_id, r.n, r.first) for r in scenes.catalog_in_windows(w.where("opens <= closes"), c).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.min("scene_id").alias("first")).collect()}
    assert listed == {(i, *v) for i, v in expected.items()}
