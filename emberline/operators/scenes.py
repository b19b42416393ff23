"""Scenes around events: windows, usability rules, ranking, the observability matrix and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Windows in days before the start and after the end, and the four usability rules.
PRE_WINDOWS = {"pre30": (30, 5), "pre60": (60, 5)}
POST_WINDOWS = {"post45": (5, 45), "post90": (5, 90)}
BUFFERS = {"b0500": 500, "b1000": 1000, "b1500": 1500}
RULES = [("A", 0.90, "clear_050", 0.70), ("B", 0.90, "clear_060", 0.70), ("C", 0.90, "clear_065", 0.70), ("D", 0.95, "clear_060", 0.80)]


def rules_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id string, coverage_min double, clear_field string, clear_min double")


def windows_frame(spark: SparkSession) -> DataFrame:
    rows = [(f"{a}_{b}", role, *days) for a, pre in PRE_WINDOWS.items() for b, post in POST_WINDOWS.items() for role, days in (("pre", pre), ("post", post))]
    return spark.createDataFrame(rows, "window_id string, role string, near_or_far int, far_or_near int")


def event_windows(events: DataFrame) -> DataFrame:
    """(event_id, window_id, role, opens, closes) of the four window pairs of every event."""
    w = F.broadcast(windows_frame(events.sparkSession))  # eight rows
    days = lambda ts, n: F.col(ts) + F.make_dt_interval(n)
    pre = F.col("role") == "pre"
    return events.crossJoin(w).select(
        "event_id", "window_id", "role",
        F.when(pre, days("start_ts", -F.col("near_or_far"))).otherwise(days("end_ts", F.col("near_or_far"))).alias("opens"),
        F.when(pre, days("start_ts", -F.col("far_or_near"))).otherwise(days("end_ts", F.col("far_or_near"))).alias("closes"),
    )


def scenes_in_windows(windows: DataFrame, scenes: DataFrame) -> DataFrame:
    """Scenes of an event acquired inside each of its windows, both ends included."""
    return windows.join(scenes, "event_id").where(F.col("acquired_at").between(F.col("opens"), F.col("closes"))).drop("opens", "closes")


def catalog_in_windows(windows: DataFrame, catalog: DataFrame, days: int = 30) -> DataFrame:
    """Scenes of a shared catalog (tile, acquired_at) for windows (tile, opens, closes), by tile and blocks of days."""
    block = lambda c: F.floor(F.unix_date(c.cast("date")) / days)
    spread = windows.withColumn("__block", F.explode(F.sequence(block(F.col("opens")), block(F.col("closes")))))
    return spread.join(catalog.withColumn("__block", block(F.col("acquired_at"))), ["tile", "__block"]).where(F.col("acquired_at").between(F.col("opens"), F.col("closes"))).drop("__block")


#: Micros of a day, and how often days are joined to spans of twice the length.
DAY, LEVELS = 86_400_000_000, 8


def catalog_counts(windows: DataFrame, catalog: DataFrame) -> DataFrame:
    """``windows`` (tile, opens, closes) in which a shared catalog (tile, acquired_at, scene_id) has scenes, plus scenes, their number, and first_scene, the least id.

    No scene is listed by window. Equal windows and equal times count once; the whole days of a window
    are at most two spans of each length 1, 2, 4 ... days, and only its first and last day meet times.
    """
    t, opens, closes = (F.unix_micros(c) for c in ("acquired_at", "opens", "closes"))
    sums = [F.sum("n").alias("n"), F.min("first").alias("first")]
    times = catalog.groupBy("tile", t.alias("t")).agg(F.count(F.lit(1)).alias("n"), F.min("scene_id").alias("first")).where("t is not null")
    day = lambda c: F.floor(c / DAY)
    spans = windows.select("tile", opens.alias("o"), closes.alias("c")).where("o <= c").distinct()
    # Whole days from a to before b.
    spans = spans.withColumns({"a": -day(-F.col("o")), "b": day(F.col("c") + 1)})
    key = ["tile", "o", "c"]
    ends = F.filter(F.array_distinct(F.array(day(F.col("o")), day(F.col("c")))), lambda d: (d < F.col("a")) | (d >= F.col("b")))
    at_ends = spans.select(*key, F.explode(ends).alias("day")).hint("merge").join(times.withColumn("day", day(F.col("t"))), ["tile", "day"]).where(F.col("t").between(F.col("o"), F.col("c")))

    def spans_of(level: int) -> Column:
        low, high = F.ceil(F.col("a") / 2**level), F.floor(F.col("b") / 2**level)
        some = F.array_compact(F.array(F.when(low % 2 != 0, low), F.when(high % 2 != 0, high - 1))) if level < LEVELS else F.sequence(low, high - 1)
        return F.when(low < high, F.transform(some, lambda n: F.struct(F.lit(level).alias("level"), n.alias("node"))))

    nodes = F.flatten(F.array_compact(F.array(*map(spans_of, range(LEVELS + 1)))))
    daily = times.groupBy("tile", day(F.col("t")).alias("day")).agg(*sums)
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.floor(F.col("day") / 2**i).alias("node")) for i in range(LEVELS + 1)]))
    joined = daily.select("tile", levels.alias("s"), "n", "first").groupBy("tile", "s.level", "s.node").agg(*sums)
    inside = spans.select(*key, F.explode(nodes).alias("s")).select(*key, "s.level", "s.node").hint("merge").join(joined, ["tile", "level", "node"])
    counted = at_ends.select(*key, "n", "first").unionByName(inside.select(*key, "n", "first")).groupBy(*key).agg(*sums)
    counted = counted.select(F.col("tile").alias("__tile"), "o", "c", F.col("n").alias("scenes"), F.col("first").alias("first_scene"))
    return windows.join(counted, (F.col("tile") == F.col("__tile")) & (opens == F.col("o")) & (closes == F.col("c"))).drop("__tile", "o", "c")


def with_scores(scenes: DataFrame, scores: DataFrame) -> DataFrame:
    """Scenes with their score row where there is one; the others stay, not linked."""
    return scenes.join(scores.withColumn("__s", F.lit(True)), "scene_id", "left").withColumn("cloud_score_linked", F.coalesce("__s", F.lit(False))).drop("__s")


def clear_value() -> Column:
    return F.element_at(F.create_map(*[x for c in ("clear_050", "clear_060", "clear_065") for x in (F.lit(c), F.col(c))]), F.col("clear_field"))


def usable() -> Column:
    """Usability of a scene joined with a rule row."""
    ok = F.col("cloud_score_linked") & (F.col("coverage") >= F.col("coverage_min")) & (clear_value() >= F.col("clear_min")) & (F.col("valid_px") > 0) & (F.col("score_px") > 0)
    return F.coalesce(ok, F.lit(False))


def day_gap() -> Column:
    """Days from a scene to its event: before the start or after the end, never negative."""
    seconds = F.when(F.col("role") == "pre", F.unix_micros("start_ts") - F.unix_micros("acquired_at")).otherwise(F.unix_micros("acquired_at") - F.unix_micros("end_ts"))
    return F.greatest(F.lit(0.0), seconds / 8.64e10)


def ranked_scenes(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Usable scenes with ``place``: coverage, then clarity, then nearness in time, then id."""
    w = Window.partitionBy(*keys).orderBy(F.desc("coverage"), F.desc("clear"), "gap_days", "scene_id")
    rules = F.broadcast(rules_frame(candidates.sparkSession))  # four rows
    rows = candidates.crossJoin(rules).withColumns({"clear": clear_value(), "gap_days": day_gap(), "usable": usable()})
    return rows.where("usable").withColumn("place", F.row_number().over(w))


def failure_reason(side: str) -> Column:
    """First cause that holds for all candidates of one side, from its aggregates."""
    n = lambda c: F.coalesce(F.col(f"{side}_{c}"), F.lit(0))
    return (
        F.when(n("scenes") == 0, f"no_{side}_scene").when(n("linked") == 0, "cloud_score_unavailable").when(n("valid") == 0, "no_valid_pixels")
        .when(n("covered") == 0, "coverage_below_threshold").when(n("usable") == 0, "clear_fraction_below_threshold")
    )


def observability_matrix(events: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per event x combination x rule, whether or not any scene exists.

    ``candidates`` has one row per scene, window, role and buffer. All sides and rules come from one
    aggregation of the candidates.
    """
    spark = events.sparkSession
    rules = F.broadcast(rules_frame(spark))
    keys = ["event_id", "buffer_id", "window_id", "rule_id"]
    rows = candidates.crossJoin(rules).withColumns({"clear": clear_value(), "gap_days": day_gap(), "usable": usable()})
    on = lambda role, c: F.count_if((F.col("role") == role) & c)
    best = lambda role: F.min(F.when((F.col("role") == role) & F.col("usable"), F.struct((-F.col("coverage")).alias("c"), (-F.col("clear")).alias("q"), F.col("gap_days").alias("g"), F.col("scene_id").alias("s"))))
    aggs = []
    for role in ("pre", "post"):
        aggs += [
            on(role, F.lit(True)).alias(f"{role}_scenes"), on(role, F.col("cloud_score_linked")).alias(f"{role}_linked"), on(role, F.col("valid_px") > 0).alias(f"{role}_valid"),
            on(role, F.col("coverage") >= F.col("coverage_min")).alias(f"{role}_covered"), on(role, F.col("usable")).alias(f"{role}_usable"), best(role).alias(f"{role}_best"),
        ]
    seen = rows.groupBy(*keys).agg(*aggs)
    windows = F.broadcast(windows_frame(spark).select("window_id").distinct())
    buffers = F.broadcast(spark.createDataFrame([(b, m) for b, m in BUFFERS.items()], "buffer_id string, buffer_m int"))
    grain = events.select("event_id").crossJoin(buffers).crossJoin(windows).crossJoin(rules.select("rule_id"))  # 48 rows an event
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = grain.join(seen, keys, "left")
    pre, post = zero(F.col("pre_usable")) > 0, zero(F.col("post_usable")) > 0
    status = (
        F.when(pre & post, "usable_both").when(zero(F.col("pre_scenes")) == 0, "no_pre_scene").when(zero(F.col("post_scenes")) == 0, "no_post_scene")
        .when(~pre, "no_usable_pre_scene").otherwise("no_usable_post_scene")
    )
    side = lambda r: [
        zero(F.col(f"{r}_scenes")).alias(f"{r}_scenes"), zero(F.col(f"{r}_usable")).alias(f"{r}_usable"), F.col(f"{r}_best.s").alias(f"{r}_scene"),
        (-F.col(f"{r}_best.c")).alias(f"{r}_coverage"), (-F.col(f"{r}_best.q")).alias(f"{r}_clear"), F.col(f"{r}_best.g").alias(f"{r}_gap_days"), failure_reason(r).alias(f"{r}_reason"),
    ]
    return out.select("event_id", F.concat_ws("_", "buffer_id", "window_id").alias("combination_id"), "buffer_id", "buffer_m", "window_id", "rule_id", status.alias("status"), *side("pre"), *side("post"))


def scene_counts(candidates: DataFrame) -> DataFrame:
    """(level, value, scenes): distinct scenes overall and by role, event, buffer and role with window."""
    sets = {"all": F.lit("all"), "role": F.col("role"), "event": F.col("event_id").cast("string"), "buffer": F.col("buffer_id"), "role_window": F.concat_ws(":", "role", "window_id")}
    long = candidates.select("scene_id", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), v.alias("value")) for k, v in sets.items()])).alias("l"))
    return long.groupBy("l.level", "l.value").agg(F.count_distinct("scene_id").alias("scenes"))


def dimension_report(matrix: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, value, rule_id, rows, events, usable_events): one pass over all dimensions."""
    long = matrix.select("event_id", "rule_id", "status", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("d"))
    good = F.when(F.col("status") == "usable_both", F.col("event_id"))
    return long.groupBy("d.dimension", "d.value", "rule_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("event_id").alias("events"), F.count_distinct(good).alias("usable_events"))


def sensitivity_cube(matrix: DataFrame) -> DataFrame:
    """(buffer_id, window_id, rule_id, events, usable_events, usable_rate); cells without events stay."""
    return matrix.groupBy("buffer_id", "window_id", "rule_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("status") == "usable_both").alias("usable_events"), F.try_divide(F.count_if(F.col("status") == "usable_both"), F.count(F.lit(1))).alias("usable_rate")
    )


def stage_table(matrix: DataFrame) -> DataFrame:
    """(rule_id, stage, events): events left after each stage, best combination counting."""
    has = lambda c: F.count_distinct(F.when(c, F.col("event_id")))
    s = matrix.groupBy("rule_id").agg(
        F.count_distinct("event_id").alias("all"), has(F.col("pre_scenes") > 0).alias("with_pre_scene"), has((F.col("pre_scenes") > 0) & (F.col("post_scenes") > 0)).alias("with_both_scenes"), has(F.col("status") == "usable_both").alias("with_usable_pair")
    )
    return s.unpivot(["rule_id"], ["all", "with_pre_scene", "with_both_scenes", "with_usable_pair"], "stage", "events")


def scene_statistics(pixels: DataFrame, keys: list[str], thresholds: tuple[float, ...] = (0.5, 0.6, 0.65)) -> DataFrame:
    """Per scene: pixels, coverage, mean and median score, clear fraction at each threshold over jointly valid pixels."""
    valid = F.col("b8").isNotNull() & F.col("b12").isNotNull()
    joint = valid & F.col("cs_cdf").isNotNull()
    score = F.when(joint, F.col("cs_cdf"))
    return pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if(valid).alias("valid_px"), F.count_if(F.col("cs_cdf").isNotNull()).alias("score_px"), F.count_if(joint).alias("joint_px"), F.try_divide(F.count_if(valid), F.count(F.lit(1))).alias("coverage"),
        F.avg(score).alias("score_mean"), F.median(score).alias("score_median"), *[F.try_divide(F.count_if(score >= t), F.count_if(joint)).alias(f"clear_{round(t * 100):03d}") for t in thresholds],
    )


def selected_pairs(selection: DataFrame, candidates: DataFrame) -> DataFrame:
    """Chosen pre and post scenes of each event with all usable candidates of either side as sorted lists."""
    usable_rows = candidates.where("usable").groupBy("event_id", "combination_id", "rule_id").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("role") == r, F.col("scene_id")))).alias(f"{r}_candidates") for r in ("pre", "post")]
    )
    return selection.join(usable_rows, ["event_id", "combination_id", "rule_id"], "left")
