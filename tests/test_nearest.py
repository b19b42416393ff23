"""Nearest events and radius audits against plain loops: crowded places, far references, windows without events."""

import datetime as dt
import math
import random

import pytest

from emberline.operators import proximity

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    spots = [(rng.uniform(0, 9e4), rng.uniform(0, 5e4)) for _ in range(300)] + [(100 + rng.random() * 3, 100 + rng.random() * 3) for _ in range(600)] + [(7e4, 7e3)] * 40
    events = [(f"e{i:04d}", x, y, T0 + dt.timedelta(hours=(h := rng.uniform(0, 700))), T0 + dt.timedelta(hours=h + rng.uniform(0, 60))) for i, (x, y) in enumerate(spots)] + [("none", None, 3.0, T0, T0)]
    at = [(rng.uniform(0, 9e4), rng.uniform(0, 5e4)) for _ in range(20)] + [(101.0, 101.0), (99.0, 102.5), (7e4, 7e3), (-4e5, 9e5), (5e4, 2.5e4)]
    refs = [(f"r{i}", x, y, (T0 + dt.timedelta(days=d)).date(), (T0 + dt.timedelta(days=d + rng.randrange(4))).date()) for i, (x, y) in enumerate(at) for d in [rng.randrange(-2, 40)]]
    refs.append(("never", 5e4, 2e4, dt.date(2030, 1, 1), dt.date(2030, 1, 2)))
    e = spark.createDataFrame(events, "event_id string, x_m double, y_m double, start_ts timestamp, end_ts timestamp").repartition(5)
    return events, refs, e, spark.createDataFrame(refs, "reference_id string, x_m double, y_m double, window_start date, window_end date")


def in_window(event, ref):
    midnight = lambda d: dt.datetime.combine(d, dt.time())
    return event[3] < midnight(ref[4]) + dt.timedelta(days=1) and event[4] >= midnight(ref[3])


def plain(events, refs, k, temporal):
    out = {}
    for r in refs:
        d = sorted((math.hypot(e[1] - r[1], e[2] - r[2]), e[0]) for e in events if e[1] is not None and (not temporal or in_window(e, r)))
        out |= {(r[0], i + 1): (name, round(x, 6)) for i, (x, name) in enumerate(d[:k])}
    return out


@pytest.mark.parametrize("k, temporal, crowd", [(10, False, 4096), (10, True, 60), (3, False, 60)])
def test_nearest(spark, tables, k, temporal, crowd):
    events, refs, e, r = tables
    got = {(x.reference_id, x.rank): (x.event_id, round(x.distance_m, 6)) for x in proximity.nearest(e, r, k, temporal, crowd).collect()}
    assert got == plain(events, refs, k, temporal)


def test_nearest_of_nothing_and_of_one_place(spark, tables):
    _, _, e, r = tables
    assert proximity.nearest(e.where("event_id < ''"), r).collect() == [] and proximity.nearest(e, r.where("reference_id < ''")).collect() == []
    assert proximity.nearest(e.where("x_m = 70000"), r, 50).groupBy("reference_id").count().agg({"count": "min"}).first()[0] == 40


def test_crowded_places_begin_with_small_cells(spark, tables):
    _, _, e, r = tables
    refs = proximity._windowed(r).where("reference_id in ('r20', 'r4')")
    first, sides = proximity._first_sides(e.where("x_m is not null"), refs, 4000.0, 10, 60)
    got = {x.reference_id: x["first"] for x in first.collect()}
    assert got["r4"] == 4000.0 and got["r20"] < 10 and sides


def test_radius_audit(spark, tables):
    events, refs, e, r = tables
    got = {x.reference_id: x for x in proximity.radius_audit(e, r, [1000.0, 20000.0]).collect()}
    closest = plain(events, refs, 1, True)
    assert set(got) == {x[0] for x in refs}
    for ref in refs:
        now = [x for x in events if in_window(x, ref)]
        inside = lambda m: sum(x[1] is not None and math.hypot(x[1] - ref[1], x[2] - ref[2]) <= m for x in now)
        x = got[ref[0]]
        assert (x.contemporaneous, x.within_1000_m, x.within_20000_m) == (len(now), inside(1000), inside(20000))
        assert (x.closest_event, x.closest_m and round(x.closest_m, 6)) == closest.get((ref[0], 1), (None, None))


def test_windows_with_few_events_do_not_search_everywhere(spark, tables, monkeypatch):
    """Before, a window with fewer than k events widened its cells until they held all places."""
    _, _, e, _ = tables
    far = spark.createDataFrame([("lone", 7e4, 7e3, T0 + dt.timedelta(days=300), T0 + dt.timedelta(days=301))], "event_id string, x_m double, y_m double, start_ts timestamp, end_ts timestamp")
    day = T0.date() + dt.timedelta(days=299)
    rows = [("few", 7e4 + 30, 7e3, day, day + dt.timedelta(days=5)), ("none", 7e4, 7e3, day, day)]
    refs = spark.createDataFrame(rows, "reference_id string, x_m double, y_m double, window_start date, window_end date")
    sides, at = [], proximity._at
    monkeypatch.setattr(proximity, "_at", lambda side, *a: (sides.append(side), at(side, *a))[1])
    got = proximity.nearest(e.unionByName(far), refs, 10, temporal=True).collect()
    assert [(r.reference_id, r.event_id, r.distance_m, r.rank) for r in got] == [("few", "lone", 30.0, 1)] and max(sides) < 4e4
