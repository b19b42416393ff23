"""Auditing and profiling of detection tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import clean
from emberline.operators.quantiles import with_quantiles
from emberline.runtime import cut


def canonical(raw: DataFrame) -> DataFrame:
    """Raw string fields as typed columns; validity is kept as columns, no row is dropped."""
    text, score = clean.confidence(F.col("confidence"))
    return raw.withColumns({
        "latitude_value": clean.number(F.col("latitude")), "longitude_value": clean.number(F.col("longitude")), "coordinate_valid": clean.valid_coordinates(F.col("latitude"), F.col("longitude")),
        "acq_day": clean.acquisition_date(F.col("acq_date")), "acq_clock": clean.acquisition_time(F.col("acq_time")), "acq_ts": clean.acquisition_timestamp(F.col("acq_date"), F.col("acq_time")),
        "satellite_name": clean.text(F.col("satellite"), upper=True), "instrument_name": clean.text(F.col("instrument"), upper=True), "confidence_text": text, "confidence_number": score,
        "frp_value": clean.number(F.col("frp")), "daynight_code": clean.day_night(F.col("daynight")),
    })


def in_period(day: Column, start: str, end: str) -> Column:
    return day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def in_box(x: Column, y: Column, west: float, south: float, east: float, north: float) -> Column:
    return x.between(west, east) & y.between(south, north)


def with_drop_stage(rows: DataFrame, start: str, end: str, inside: Column) -> DataFrame:
    """``drop_stage``: the first test a row fails, in the order date, coordinate, period, polygon; null if kept."""
    stage = (
        F.when(F.col("acq_day").isNull(), "invalid_date").when(~F.col("coordinate_valid"), "invalid_coordinate")
        .when(~in_period(F.col("acq_day"), start, end), "outside_period").when(~F.coalesce(inside, F.lit(False)), "outside_polygon")
    )
    return rows.withColumn("drop_stage", stage)


def attrition(staged: DataFrame) -> DataFrame:
    """(stage, rows): counts of every stage, in one pass."""
    s = F.col("drop_stage")
    counts = staged.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "invalid_date").alias("invalid_date"), F.count_if(F.col("acq_clock").isNull()).alias("invalid_time"), F.count_if(s == "invalid_coordinate").alias("invalid_coordinate"),
        F.count_if(s == "outside_period").alias("outside_period"), F.count_if(s == "outside_polygon").alias("outside_polygon"), F.count_if(s.isNull()).alias("kept"),
    )
    return unpivoted(counts, counts.columns, "stage", "rows")


def unpivoted(row: DataFrame, columns: list[str], name: str, value: str, keep: list[str] | None = None) -> DataFrame:
    return row.unpivot([F.col(k) for k in keep or []], [F.col(c) for c in columns], name, value)


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """(value, rows) with missing values under ``__missing__``."""
    return rows.groupBy(F.coalesce(F.nullif(F.trim(F.col(column)), F.lit("")), F.lit("__missing__")).alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def numeric_distribution(rows: DataFrame, column: str) -> DataFrame:
    """Count, missing, extremes and linear percentiles of a numeric column."""
    c, values = F.col(column), cut(rows.select(column))
    out = values.agg(F.count(c).alias("present"), F.count_if(c.isNull()).alias("missing"), F.min(c).alias("minimum"), F.max(c).alias("maximum"))
    return with_quantiles(out, values, [], {f"p{round(p * 100)}": (column, p, "linear") for p in (0.25, 0.5, 0.75, 0.9)})


def missing_counts(rows: DataFrame, columns: list[str], source: str) -> DataFrame:
    """(source, column, missing) with the total under ``__all__``."""
    sums = rows.rollup(source).agg(F.grouping(source).alias("__g"), *[F.count_if(clean.missing(F.col(c))).alias(c) for c in columns])
    return unpivoted(sums.withColumn(source, F.when(F.col("__g") == 1, "__all__").otherwise(F.col(source))), columns, "column", "missing", [source])


def duplicate_summary(rows: DataFrame, columns: list[str], source: str) -> DataFrame:
    """Exact repeats: groups and surplus rows within a source, groups that span sources."""
    groups = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(source).alias("sources"))
    within = rows.groupBy(source, *columns).agg(F.count(F.lit(1)).alias("n"))
    a = within.agg(F.count_if(F.col("n") > 1).alias("within_source_groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("within_source_surplus"))
    return a.crossJoin(groups.agg(F.count_if((F.col("n") > 1) & (F.col("sources") > 1)).alias("across_source_groups")))  # one row each


def quality_report(rows: DataFrame) -> DataFrame:
    """One row over canonical rows."""
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.min("acq_day").alias("first_day"), F.max("acq_day").alias("last_day"), F.count_if("coordinate_valid").alias("valid_coordinates"), F.count_if(F.col("acq_ts").isNull()).alias("invalid_timestamps"),
        F.count_if(F.col("frp_value").isNull()).alias("missing_frp"), F.count_if(F.col("confidence_number").isNotNull()).alias("numeric_confidence"), F.count_distinct("satellite_name").alias("satellites"),
    )


def daily_counts(rows: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """(day, rows, iso_year, iso_week, week_start): every day of the period, zeros kept."""
    days = rows.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    counts = rows.groupBy(F.col(ts).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.join(counts, "day", "left").select(
        "day", F.coalesce("n", F.lit(0)).alias("rows"), F.extract(F.lit("YEAROFWEEK"), "day").cast("long").alias("iso_year"), F.weekofyear("day").cast("long").alias("iso_week"), F.date_trunc("WEEK", "day").cast("date").alias("week_start")
    )


def known_shares(rows: DataFrame, column: str, known: list[str]) -> DataFrame:
    """(value, rows, share_pct) over the known values alone."""
    counts = rows.where(F.col(column).isin(known)).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("t"))
    return counts.crossJoin(total).select(F.col(column).alias("value"), "rows", (100.0 * F.col("rows") / F.col("t")).alias("share_pct"))  # one row a value


def bounding_box(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.agg(F.min(x).alias("west"), F.min(y).alias("south"), F.max(x).alias("east"), F.max(y).alias("north"))


def histogram(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, rows) over bins of equal width, the last closed; empty bins are left out."""
    span = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)
    place = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("lo")) / width))
    return rows.where(F.col(column).isNotNull()).crossJoin(F.broadcast(span)).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


def fixed_bins(value: Column, bins: int) -> Column:
    """Bin of a value on 0..1, the last closed, ends clamped."""
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(value * bins))).cast("int")


def density_grid(rows: DataFrame, x: str, y: str, box: tuple[float, float, float, float], columns: int, lines: int) -> DataFrame:
    """(col, row, rows) of an n x m grid over a box, outsiders clamped to the border."""
    place = lambda c, lo, hi, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((F.col(c) - lo) / (hi - lo) * n))).cast("int")
    return rows.groupBy(place(x, box[0], box[2], columns).alias("col"), place(y, box[1], box[3], lines).alias("row")).agg(F.count(F.lit(1)).alias("rows"))


def raw_versus_kept(staged: DataFrame, source: str) -> DataFrame:
    return staged.groupBy(source).agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("drop_stage").isNull()).alias("kept"))


def schema_fingerprint(headers: Column) -> Column:
    return F.sha2(F.array_join(headers, "\x00"), 256)


def missing_days(observed: DataFrame, key: str, day: str, start: str, end: str) -> DataFrame:
    """(key, day): calendar days of the period without a row, for every key that has any row."""
    keys = observed.select(key).distinct()
    calendar = keys.withColumn(day, F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))))
    return calendar.join(observed.select(key, day).distinct(), [key, day], "left_anti")


def fragment_audit(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, verdict): missing, unexpected, failed, empty or complete, by what was expected and what came."""
    e, a = expected.select(*keys, F.lit(True).alias("__e")), actual.select(*keys, "status", "record_count", F.lit(True).alias("__a"))
    verdict = (
        F.when(F.col("__a").isNull(), "missing").when(F.col("__e").isNull(), "unexpected").when(F.col("status") != "downloaded", "failed").when(F.col("record_count") == 0, "empty").otherwise("complete")
    )
    return e.join(a, keys, "full_outer").select(*keys, verdict.alias("verdict"))


def audit_summary(audit: DataFrame) -> DataFrame:
    names = ("missing", "unexpected", "failed", "empty", "complete")
    return audit.agg(*[F.count_if(F.col("verdict") == n).alias(n) for n in names]).withColumn("is_complete", (F.col("missing") == 0) & (F.col("failed") == 0) & (F.col("unexpected") == 0))


def interval_overlaps(rows: DataFrame, key: str, start: str, end: str, days: int = 30) -> DataFrame:
    """(a, b, overlap_start, overlap_end) of every two keys whose date intervals meet.

    Intervals are dealt to blocks of days; two meet in the block in which their overlap begins, once.
    """
    block = lambda d: F.floor(F.unix_date(d) / days)

    def dealt(s: str) -> DataFrame:
        side = rows.where(F.col(start) <= F.col(end)).select(F.col(key).alias(s), F.col(start).alias(f"{s}0"), F.col(end).alias(f"{s}1"))
        return side.withColumn("block", F.explode(F.sequence(block(F.col(f"{s}0")), block(F.col(f"{s}1")))))

    lo, hi = F.greatest("a0", "b0"), F.least("a1", "b1")
    met = dealt("a").join(dealt("b"), "block").where((F.col("a") < F.col("b")) & (lo <= hi) & (F.col("block") == block(lo)))
    return met.select("a", "b", lo.alias("overlap_start"), hi.alias("overlap_end"))


def source_choice(sources: DataFrame, prefix: str, suffix: str, start: str, end: str) -> DataFrame:
    """(data_id, overlap_start, overlap_end, reason): which sources qualify for a period, and why others do not."""
    lo, hi = F.greatest("min_date", F.lit(start).cast("date")), F.least("max_date", F.lit(end).cast("date"))
    reason = F.when(~F.col("data_id").startswith(prefix), "wrong_family").when(~F.col("data_id").endswith(suffix), "wrong_processing").when(lo > hi, "no_overlap").otherwise("selected")
    some = reason == "selected"
    return sources.select("data_id", F.when(some, lo).alias("overlap_start"), F.when(some, hi).alias("overlap_end"), reason.alias("reason"))


def fragments(sources: DataFrame, key: str, start: str, end: str, days: int) -> DataFrame:
    """(key, chunk_start, chunk_end): each interval in chunks of at most ``days``."""
    return sources.select(key, F.explode(clean.date_chunks(F.col(start), F.col(end), days)).alias("c")).select(key, "c.*")


def source_rollup(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("source").agg(F.count(F.lit(1)).alias("fragments"), F.count_if(F.col("status") == "downloaded").alias("downloaded"), F.count_if(F.col("status") != "downloaded").alias("not_downloaded"), F.sum("record_count").alias("records"))


def gap_bins(rows: DataFrame, columns: list[str], width: int = 10, bins: int = 10) -> DataFrame:
    """(bin, rows) of day gaps in bins of ``width`` days, the last open; nulls left out."""
    long = rows.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "column", "days").where("days is not null")
    return long.groupBy(F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col("days") / width))).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


def gaps_by(rows: DataFrame, key: str, ts: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(ts)
    return rows.withColumn("gap_days", F.datediff(F.col(ts), F.lag(ts).over(w)))


def examples(rows: DataFrame, keys: list[str], order: list[Column], show: str, most: int = 100) -> DataFrame:
    """(keys, total, examples): how many rows each key has, and the first ``most`` of them by name; no list grows beyond that."""
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= most)
    listed = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__n", F.col(show).cast("string").alias("v")))).alias("l"))
    return total.join(listed, keys).select(*keys, "total", F.array_join(F.transform("l", lambda x: x["v"]), ",").alias("examples"))
