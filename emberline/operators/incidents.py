"""Matching events to external incidents, and placing them in their cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.clean import hours_between
from emberline.operators.profile import unpivoted
from emberline.operators.quantiles import with_quantiles
from emberline.runtime import cut


def cohort_distributions(events: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per metric: extremes, median, nearest-rank quartiles and tails."""
    long = cut(unpivoted(events.select(*[F.col(m).cast("double").alias(m) for m in metrics]), metrics, "metric", "v").where("v is not null"))
    out = long.groupBy("metric").agg(F.count("v").alias("cohort_count"), F.min("v").alias("minimum"), F.max("v").alias("maximum"))
    tails = {"q25": 0.25, "q75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    out = with_quantiles(out, long, ["metric"], {"median": ("v", 0.5, "linear")} | {n: ("v", p, "nearest") for n, p in tails.items()})
    return out.withColumn("iqr", F.col("q75") - F.col("q25"))


def percentile_ranks(cohort: DataFrame, wanted: DataFrame, key: str, metric: str, slack: float = 1e-12) -> DataFrame:
    """(key, value, percentile, inclusive_rank) of wanted rows in the cohort: how many values are at most theirs plus ``slack``.

    The cohort is first counted by value. Counts and wanted rows stand in one order, cut into ranges
    of equal width, and a running sum over it gives each wanted row the values up to its own.
    """
    from emberline.operators.ranking import blocked
    from emberline.runtime import spread

    values = cohort.where(F.col(metric).isNotNull()).groupBy(F.col(metric).cast("double").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    ends = values.agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.sum("n").alias("t"), F.count(F.lit(1)).alias("k")).first()
    if not ends["t"]:
        return wanted.select(key, F.col(metric).cast("double").alias("value"), F.lit(None).cast("double").alias("percentile"), F.lit(0).cast("long").alias("inclusive_rank")).where("value is not null")
    lo, width = ends["lo"], (ends["hi"] - ends["lo"]) / spread(ends["k"]) or 1.0
    empty = F.lit(None).cast(wanted.schema[key].dataType).alias(key)
    counts = values.select("at", "n", F.lit(0).alias("kind"), empty, F.lit(None).cast("double").alias("value"))
    asked = wanted.where(F.col(metric).isNotNull()).select((F.col(metric).cast("double") + slack).alias("at"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("kind"), key, F.col(metric).cast("double").alias("value"))
    piece = F.greatest(F.lit(-1.0), F.least(F.floor((F.col("at") - lo) / width).cast("double"), F.lit((ends["hi"] - lo) / width + 1)))
    ranked = blocked(counts.unionByName(asked), [], piece, [F.col("at"), F.col("kind")], rank="i", value=F.col("n"), total="upto").where("kind = 1")
    return ranked.select(key, "value", (100.0 * F.col("upto") / ends["t"]).alias("percentile"), F.col("upto").alias("inclusive_rank"))


def match_summary(references: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per reference: how many events match, which, the closest."""
    few = matches.groupBy("reference_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("event_id")).alias("ids"), F.min(F.struct("distance_m", "event_id")).alias("c"))
    return references.select("reference_id").join(few, "reference_id", "left").select(
        "reference_id", F.coalesce("n", F.lit(0)).alias("matched"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("event_ids"), F.col("c.event_id").alias("closest_event"), F.col("c.distance_m").alias("closest_m"),
        F.when(F.col("n").isNull(), "no_cluster").when(F.col("n") == 1, "one_cluster").otherwise("multiple_clusters").alias("classification"),
    )


def intercluster_gaps(matches: DataFrame, clip: bool = True) -> DataFrame:
    """``matches`` plus gap_hours from the end of the match before; below 0 where intervals overlap, unless clipped."""
    w = Window.partitionBy("reference_id").orderBy("start_ts", "event_id")
    gap = hours_between(F.lag("end_ts").over(w), F.col("start_ts"))
    return matches.withColumn("gap_hours", F.when(gap.isNotNull(), F.greatest(F.lit(0.0), gap) if clip else gap))


def fragmentation(matches: DataFrame, hours: float) -> DataFrame:
    """(reference_id, matched, largest_gap_hours, possible_fragmentation): several matches with a gap beyond the window."""
    rows = intercluster_gaps(matches).groupBy("reference_id").agg(F.count(F.lit(1)).alias("matched"), F.max("gap_hours").alias("largest_gap_hours"))
    return rows.withColumn("possible_fragmentation", F.coalesce((F.col("matched") > 1) & (F.col("largest_gap_hours") > hours), F.lit(False)))


def miss_class(audit: DataFrame, near: str, far: str) -> DataFrame:
    """(reference_id, category) from the counts within a near and a far radius."""
    category = F.when((F.col(near) == 0) & (F.col(far) > 0), "SPATIAL_THRESHOLD_MISS").when(F.col(near) == 0, "NO_SIGNAL_NEAR_REFERENCE").otherwise("INDETERMINATE")
    return audit.select("reference_id", category.alias("category"))


def chronology(matches: DataFrame, members: DataFrame) -> DataFrame:
    """(reference_id, event_id, detections): the matched events' detections in time order, nested."""
    rows = matches.select("reference_id", "event_id").join(members.select("event_id", "detection_id", "ts", "frp"), "event_id")
    return rows.groupBy("reference_id", "event_id").agg(F.array_sort(F.collect_list(F.struct("ts", "detection_id", "frp"))).alias("detections"))


def claim_ranges(claims: DataFrame, key: str = "incident_id", value: str = "hectares", source: str = "source") -> DataFrame:
    """(key, lowest, highest, claims): the span of claimed areas; every claim is kept and none chosen."""
    return claims.groupBy(key).agg(F.min(value).alias("lowest"), F.max(value).alias("highest"), F.array_sort(F.collect_list(F.struct(source, value))).alias("claims"))
