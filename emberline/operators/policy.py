"""Comparing scene policies: the matrix of measures, its ranking, and fallbacks per event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.operators.quantiles import with_quantiles
from emberline.runtime import cut

# The baseline combination and the order in which fallbacks are tried.
BASELINE = "b0500_pre30_post45"
FALLBACKS = (
    "b0500_pre30_post90", "b0500_pre60_post45", "b0500_pre60_post90", "b1000_pre30_post45", "b1000_pre30_post90", "b1000_pre60_post45",
    "b1000_pre60_post90", "b1500_pre30_post45", "b1500_pre30_post90", "b1500_pre60_post45", "b1500_pre60_post90",
)


def _span_days() -> Column:
    return F.regexp_extract("window_id", r"pre(\d+)", 1).cast("int") + F.regexp_extract("window_id", r"post(\d+)", 1).cast("int")


def policy_matrix(matrix: DataFrame, segments: list[str]) -> DataFrame:
    """Measures per scope, dimension, value, combination and rule, overall and for every segment at once.

    Medians and tails are over events with a usable pair. Exclusive, rescued and lost events are set
    differences against the other combinations, the baseline and the best combinations.
    """
    dims = [F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("value"))] + [F.struct(F.lit(s).alias("dimension"), F.col(s).cast("string").alias("value")) for s in segments]
    good = F.col("status") == "usable_both"
    long = cut(matrix.withColumn("__d", F.explode(F.array(*dims))).select("*", "__d.dimension", "__d.value").withColumn("__good", good).drop("__d"))
    cell = ["dimension", "value", "rule_id"]
    per_event = long.groupBy(*cell, "event_id").agg(F.count_if("__good").alias("__ways"), F.bool_or(F.col("__good") & (F.col("combination_id") == BASELINE)).alias("__base"))
    sizes = long.where("__good").groupBy(*cell, "combination_id").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.groupBy(*cell).agg(F.max("n").alias("n")).join(sizes, [*cell, "n"]).select(*cell, "combination_id")
    envelope = long.where("__good").join(best, [*cell, "combination_id"], "left_semi").select(*cell, "event_id").distinct()
    total = envelope.groupBy(*cell).agg(F.count(F.lit(1)).alias("__best"))
    rows = long.join(per_event, [*cell, "event_id"]).join(envelope.withColumn("__in", F.lit(True)), [*cell, "event_id"], "left")
    if_good = lambda c: F.when(F.col("__good"), F.col(c))
    sides, keys = ("pre", "post"), [*cell, "combination_id", "buffer_m", "window_id"]
    ranks = {f"{s}_{m}_median": (f"{s}_{m}", 0.5, "linear") for s in sides for m in ("coverage", "clear", "gap_days", "usable")}
    ranks |= {f"{s}_{m}_p10": (f"{s}_{m}", 0.1, "linear") for s in sides for m in ("coverage", "clear")} | {f"{s}_gap_days_p90": (f"{s}_gap_days", 0.9, "linear") for s in sides}
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"), F.count_if("__good").alias("usable_pairs"),
        F.count_if(F.col("__good") & (F.col("__ways") == 1)).alias("exclusive"), F.count_if(F.col("__good") & ~F.col("__base")).alias("rescued"), F.count_if(F.col("__good") & F.coalesce("__in", F.lit(False))).alias("__kept"),
        (F.sum("pre_scenes") + F.sum("post_scenes")).alias("inventory_rows"), F.count_distinct(if_good("pre_scene")).alias("distinct_pre"), F.count_distinct(if_good("post_scene")).alias("distinct_post"),
    )
    out = with_quantiles(out, long.where("__good"), keys, ranks)
    cost = F.pow(F.col("buffer_m") / 500.0, F.lit(2.0)) * F.col("window_span_days") / 75.0
    return out.join(total, cell, "left").withColumn("lost", F.coalesce("__best", F.lit(0)) - F.col("__kept")).withColumn("window_span_days", _span_days()).withColumn("relative_cost", cost).drop("__best", "__kept")


def ranked_policies(policies: DataFrame) -> DataFrame:
    """``policies`` plus rank, rank_group (ties share the lowest), tie_size and is_best, within dimension, value and rule."""
    up, down = float("inf"), float("-inf")
    hi, lo = (lambda c: F.coalesce(F.col(c), F.lit(up))), (lambda c: F.coalesce(F.col(c), F.lit(down)))
    key = F.struct(
        (-F.col("usable_pairs")).alias("a"), F.col("lost").alias("b"), (hi("pre_gap_days_median") + hi("post_gap_days_median")).alias("c"), (hi("pre_gap_days_p90") + hi("post_gap_days_p90")).alias("d"),
        (-F.least(lo("pre_clear_p10"), lo("post_clear_p10"))).alias("e"), (-F.least(lo("pre_coverage_p10"), lo("post_coverage_p10"))).alias("f"), (-(lo("pre_clear_median") + lo("post_clear_median"))).alias("g"),
        (-(lo("pre_coverage_median") + lo("post_coverage_median"))).alias("h"), F.col("buffer_m").alias("i"), F.col("relative_cost").alias("j"),
    )
    scope = Window.partitionBy("dimension", "value", "rule_id")
    rows = policies.withColumn("__k", key)
    return rows.withColumns({
        "rank": F.row_number().over(scope.orderBy("__k", "buffer_m", "window_id", "combination_id")), "rank_group": F.rank().over(scope.orderBy("__k")),
        "tie_size": F.count(F.lit(1)).over(Window.partitionBy("dimension", "value", "rule_id", "__k")),
    }).withColumn("is_best", F.col("rank") == 1).drop("__k")


def fallback_frame(spark: SparkSession, primary: str) -> DataFrame:
    order = [primary, *[c for c in FALLBACKS if c != primary]]
    return spark.createDataFrame(list(enumerate(order)), "attempt int, combination_id string")


def fallback_attempts(matrix: DataFrame, primary: str, rule: str) -> DataFrame:
    """(event_id, attempt, combination_id, usable, label): every attempt in order; the first usable one is selected."""
    order = F.broadcast(fallback_frame(matrix.sparkSession, primary))  # twelve rows
    rows = matrix.where(F.col("rule_id") == rule).join(order, "combination_id").withColumn("usable", F.col("status") == "usable_both")
    first = F.min(F.when(F.col("usable"), F.col("attempt"))).over(Window.partitionBy("event_id"))
    label = F.when(F.col("attempt") == first, "selected").when(F.col("usable"), "available").otherwise("none")
    return rows.select("event_id", "attempt", "combination_id", "usable", label.alias("label"))


def pair_selection(matrix: DataFrame, primary: str, rule: str) -> DataFrame:
    """One row per event: the chosen combination, whether it is a fallback and of what kind, and the lowest rule it passes."""
    attempts = fallback_attempts(matrix, primary, rule)
    chosen = attempts.groupBy("event_id").agg(F.min(F.when(F.col("label") == "selected", F.struct("attempt", "combination_id"))).alias("c")).select("event_id", F.col("c.attempt").alias("attempt"), F.col("c.combination_id").alias("combination_id"))
    passed = matrix.where(F.col("status") == "usable_both").groupBy("event_id", "combination_id").agg(F.min("rule_id").alias("minimum_rule"))
    pair = matrix.where(F.col("rule_id") == rule).select("event_id", "combination_id", "pre_scene", "post_scene")
    part = lambda c, p: F.regexp_extract(c, p, 0)
    same_buffer = part(F.col("combination_id"), "^b[0-9]+") == part(F.lit(primary), "^b[0-9]+")
    span = lambda c: F.regexp_extract(c, r"pre(\d+)", 1).cast("int") + F.regexp_extract(c, r"post(\d+)", 1).cast("int")
    kind = F.when(F.col("attempt") > 0, F.when(same_buffer, "temporal_extension").when(span(F.col("combination_id")) != span(F.lit(primary)), "buffer_expansion_and_temporal_extension").otherwise("buffer_expansion"))
    return chosen.join(passed, ["event_id", "combination_id"], "left").join(pair, ["event_id", "combination_id"], "left").select(
        "event_id", F.coalesce(F.col("attempt") == 0, F.lit(False)).alias("primary_sufficient"), F.coalesce(F.col("attempt") > 0, F.lit(True)).alias("fallback_required"), kind.alias("fallback_type"), F.col("combination_id").alias("selected_combination"),
        "minimum_rule", "pre_scene", "post_scene",
    )


def event_sets(matrix: DataFrame, rule: str) -> DataFrame:
    """(combination_id, events): the events each combination makes usable, as sorted sets."""
    return matrix.where((F.col("rule_id") == rule) & (F.col("status") == "usable_both")).groupBy("combination_id").agg(F.array_sort(F.collect_set("event_id")).alias("events"))


def envelope(matrix: DataFrame) -> DataFrame:
    """(rule_id, events): the union over all combinations."""
    return matrix.where(F.col("status") == "usable_both").groupBy("rule_id").agg(F.count_distinct("event_id").alias("events"))
