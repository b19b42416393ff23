import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import components
from emberline.operators import events as E
from emberline.operators.components import component_roots
from emberline.operators.proximity import linking_edges, radius_interval_matches, space_time_edges

T0 = dt.datetime(2025, 1, 10, 12)


def frame(spark, rows):
    """Rows (id, x, y, hours after T0, source, frp)."""
    full = [(i, float(x), float(y), T0 + dt.timedelta(hours=h), s, float(p), s[-2:], "D", "n", 8.5, -80.2) for i, x, y, h, s, p in rows]
    return spark.createDataFrame(full, "detection_id string, x_m double, y_m double, ts timestamp, firms_source string, frp double, satellite string, daynight string, confidence_raw string, lat double, lon double")


def row(i, x=0, y=0, h=0.0, s="VIIRS_NOAA20_SP", p=10.5):
    return (i, x, y, h, s, p)


@pytest.mark.parametrize(
    ("rows", "n"),
    [
        ([row("a"), row("b", 5000)], 2),
        ([row("a"), row("b", 375)], 1),
        ([row("a"), row("b", 375.0001)], 2),
        ([row("a"), row("b", h=6)], 1),
        ([row("a"), row("b", h=6 + 1 / 3600)], 2),
        ([row("a"), row("b", 300, h=1), row("c", 600, h=2)], 1),
        ([row("a"), row("b", s="VIIRS_SNPP_SP", p=99)], 1),
        ([row("a", -0.5), row("b", 374.5)], 1),
    ],
)
def test_bounds_are_inclusive_and_chains_join(spark, rows, n):
    for order in (rows, rows[::-1]):
        got = E.memberships(frame(spark, order), [E.Setting(375, 6)])
        assert got.count() == len(rows) and got.select("component").distinct().count() == n


def test_edges_match_all_pairs(spark):
    rng = random.Random(5)
    rows = [row(f"d{i:03d}", rng.uniform(0, 4000), rng.uniform(0, 4000), rng.uniform(0, 60)) for i in range(150)]
    got = {(r.src, r.dst) for r in space_time_edges(frame(spark, rows).repartition(7), 700, 8).collect()}
    expected = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 <= 700 and abs(a[3] - b[3]) <= 8}
    assert got == expected


def test_edges_of_equal_times_and_on_cell_borders(spark):
    rows = [row(f"d{i}", 2800.0 * i, y, h) for i, (y, h) in enumerate([(0, 0), (0, 0), (2800, 0), (2800, 32), (-1.5, 40), (-1.5, 40)])] + [row("d0", 0, 0, 0)]
    got = sorted((r.src, r.dst) for r in space_time_edges(frame(spark, rows), 2800, 8).collect())
    assert got == [("d0", "d1"), ("d0", "d1"), ("d4", "d5")]


def test_summary_and_flags(spark):
    rows = [row("a", p=2, h=-4), row("b", 100, p=4, h=8, s="VIIRS_SNPP_SP"), row("z", 9000)]
    grid = [E.Setting(375, 24)]
    members = E.memberships(frame(spark, rows), grid).join(frame(spark, rows), "detection_id")
    keys = ["configuration_id", "component"]
    events = E.chain_flags(E.summarise(members, keys).join(E.extents(members, keys), keys), E.settings_frame(spark, grid))
    e = {r.component: r for r in events.collect()}
    assert e["a"].detection_count == 2 and e["a"].duration_hours == 12 and e["a"].frp_sum == 6 and e["a"].frp_median == 3
    assert e["a"].both_sensors and e["a"].max_pairwise_distance_m == 100 and e["a"].max_distance_to_centroid_m == 50
    assert not e["a"].multi_day and e["z"].frp_max == 10.5 and not e["z"].multi_source
    assert e["a"].chain_merge_reasons == ["large_cohort_share"] and e["a"].mega


def test_long_chain_is_flagged(spark):
    rows = [row("a"), row("b", h=48), row("c", h=96), *[row(f"s{i}", 5000 * (i + 2)) for i in range(20)]]
    grid = [E.Setting(375, 48)]
    members = E.memberships(frame(spark, rows), grid).join(frame(spark, rows), "detection_id")
    keys = ["configuration_id", "component"]
    flags = E.chain_flags(E.summarise(members, keys).join(E.extents(members, keys), keys), E.settings_frame(spark, grid))
    reasons = {r.component: r.chain_merge_reasons for r in flags.collect()}
    assert reasons["a"] == ["duration_over_72h", "near_temporal_gap_limit", "multi_day_event"] and reasons["s3"] == []


def test_extent_by_hull_candidates(spark):
    rng = random.Random(1)
    rows = [row(f"d{i}", rng.randint(0, 30) * 10, rng.randint(0, 30) * 10) for i in range(80)]
    got = E.extents(frame(spark, rows).withColumn("k", F.lit(1)), ["k"]).first()
    assert got.max_pairwise_distance_m == pytest.approx(max(((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 for a in rows for b in rows))


def test_stability_of_sixteen_settings(spark):
    grid = [E.Setting(r, h) for r in (375, 750, 1500, 3000) for h in (6, 12, 24, 48)]
    frame_ = frame(spark, [row("a")])
    got = E.stability(E.memberships(frame_, grid), E.settings_frame(spark, grid)).collect()
    assert len(got) == 24 and all(r.jaccard_coassignment == 1.0 and r.pair_retention_rate is None for r in got)


def test_stability_counts_pairs(spark):
    grid = [E.Setting(100, 6), E.Setting(300, 6)]
    rows = [row("a"), row("b", 90), row("c", 350), row("d", 430), row("e", 5000)]
    got = E.stability(E.memberships(frame(spark, rows), grid), E.settings_frame(spark, grid)).first()
    assert (got.event_count_a, got.event_count_b) == (3, 2) and got.pair_retention_rate == 1.0 and got.jaccard_coassignment == pytest.approx(2 / 6)


@pytest.mark.parametrize("per_task", [40, 250_000])
def test_components_of_random_graphs(spark, monkeypatch, per_task):
    monkeypatch.setattr(components, "PER_TASK", per_task)
    rng = random.Random(8)
    edges = [(k, rng.randrange(300), rng.randrange(300)) for k in ("x", "y") for _ in range(260)]
    edges += [("path", i, i + 1) for i in range(200)] + [("x", None, 4), ("y", 7, 7)]
    got = {(r.k, r.id): r.component for r in component_roots(spark.createDataFrame(edges, "k string, src long, dst long"), keys=["k"]).collect()}
    parent: dict = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for k, a, b in edges:
        if a is not None:
            x, y = find((k, a)), find((k, b))
            parent[max(x, y)] = min(x, y)
    assert got == {v: find(v)[1] for v in list(parent) if find(v) != v}


def test_incident_bounds(spark):
    day = dt.date(2025, 1, 10)
    refs = spark.createDataFrame([("r", 0.0, 0.0, day, day)], "reference_id string, x_m double, y_m double, window_start date, window_end date")
    at = lambda h, us=0: dt.datetime(2025, 1, 10) + dt.timedelta(hours=h, microseconds=us)
    cases = [("on_radius", 5000.0, at(3), at(4)), ("outside", 5000.001, at(3), at(4)), ("last_us", 0.0, at(24, -1), at(30)), ("next_day", 0.0, at(24), at(25)), ("before", 0.0, at(-2), at(0)), ("too_early", 0.0, at(-2), at(0, -1))]
    events = spark.createDataFrame([(i, x, 0.0, a, b) for i, x, a, b in cases], "event_id string, x_m double, y_m double, start_ts timestamp, end_ts timestamp")
    got = {r.event_id: r.overlap_hours for r in radius_interval_matches(events, refs, 5000).collect()}
    assert set(got) == {"on_radius", "last_us", "before"} and got["on_radius"] == 1.0 and got["before"] == 0.0


def test_linking_edges_give_the_same_components(spark):
    rng = np.random.default_rng(11)
    n = 400
    rows = [(f"d{i:04d}", float(x), float(y), int(t)) for i, (x, y, t) in enumerate(zip(rng.uniform(0, 9000, n), rng.uniform(0, 9000, n), rng.uniform(0, 40 * 3600, n)))]
    rows += [(f"e{i:04d}", 3000.0 + float(rng.uniform(0, 60)), 3000.0, int(i * 3600)) for i in range(60)] + [("f", None, 1.0, 5)]
    points = spark.createDataFrame(rows, "detection_id string, x_m double, y_m double, s long").withColumn("ts", F.timestamp_seconds("s"))
    few = linking_edges(points, 375, 1500, 6).cache()
    for radius, hours in ((375, 3), (750, 6), (1500, 2), (1500, 6)):
        whole = component_roots(space_time_edges(points, radius, hours)).collect()
        some = component_roots(few.where((F.col("distance_m") <= radius * (1 + 1e-12)) & (F.col("gap_hours") <= hours))).collect()
        assert sorted(tuple(r) for r in whole) == sorted(tuple(r) for r in some)


def test_a_crowded_place_has_one_edge_for_each_point(spark):
    points = spark.range(200_000).select(F.format_string("d%07d", "id").alias("detection_id"), (F.col("id") % 97).cast("double").alias("x_m"), (F.col("id") % 89).cast("double").alias("y_m"), F.timestamp_seconds(F.col("id") % 5000 * 60).alias("ts"))
    edges = linking_edges(points, 375, 1500, 6)
    assert edges.count() == 199_999


def test_edges_are_never_a_broadcast(spark, sf):
    """Spark takes the spread side for as small as its file; a million rows then filled the driver."""
    from emberline.plans.base import detections

    edges = space_time_edges(detections(spark, sf), 1500, 6)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_complete_stars_leave_the_rounds(spark, monkeypatch):
    """A thousand pairs and one path over all places: only what is no star yet takes part in a round."""
    monkeypatch.setattr(components, "PER_TASK", 300)
    seen, stars = [], components._stars
    monkeypatch.setattr(components, "_stars", lambda edges, keys: (seen.append(edges.count()), stars(edges, keys))[1])
    edges = [("k", 2 * i, 2 * i + 1, i) for i in range(10_000, 11_000)] + [("k", i, i + 1, i) for i in range(1500)]
    got = {r.id: r.component for r in component_roots(spark.createDataFrame(edges, "k string, src long, dst long, near long"), keys=["k"], near="near").collect()}
    assert got == {2 * i + 1: 2 * i for i in range(10_000, 11_000)} | dict.fromkeys(range(1, 1501), 0)
    assert seen and max(seen) <= 1500


def test_a_place_with_more_than_a_task_holds_is_cut(spark, monkeypatch):
    monkeypatch.setattr(components, "PER_TASK", 100)
    edges = spark.range(1, 1000).select((F.col("id") - 1).alias("v"), F.col("id").alias("u"), F.lit(7).alias("near"))
    sizes = components._dealt(edges, 10).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 500
    assert component_roots(edges, "u", "v", near="near").where("component = 0").count() == 999
