"""Gapless ranks and running sums that never sort one whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.runtime import cut, fill, spread

#: So many ranges of a total order are always allowed.
RANGES = 64


def total_order(rows: DataFrame, order: list[Column], per: int = 1_000_000) -> DataFrame:
    """``rows`` in ascending ranges, each sorted in place, plus position: the place in the total order, from 0.

    Ranges come from a sample, so none is much larger than ``per``, unless that makes so many that they
    rather grow as a root with the rows. A range's first position is the sum of the counts before it.
    The ranges are kept, so that every reader sees the same positions.
    """
    count = rows.count()
    ranges = min(fill(count, per), max(RANGES, spread(count)))
    placed = cut(rows.repartitionByRange(ranges, *order).withColumn("__block", F.spark_partition_id()) if ranges > 1 else rows.withColumn("__block", F.lit(0)))
    out = blocked(placed, [], F.col("__block"), order, rank="position")
    return out.repartitionByRange(ranges, "position").sortWithinPartitions("position")


def blocked(df: DataFrame, keys: list[str], block: Column, order: list[Column], rank: str = "rank", value: Column | None = None, total: str | None = None) -> DataFrame:
    """Add ``rank`` (gapless from 0) and, with ``value``, ``total`` (sum of the rows before) per key.

    ``block`` cuts each key into ordered pieces (ascending blocks come first); a window sorts one
    piece at a time and the pieces' counts, a small table, give each piece its start. A key with a
    third of all rows is thus spread over its blocks. ``df`` is read twice: pass something cheap.
    """
    rows = df.withColumn("__block", block)
    sums = [F.count(F.lit(1)).alias("__n")] + ([F.sum(value).alias("__s")] if value is not None else [])
    counts = rows.groupBy(*keys, "__block").agg(*sums)
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col("__block").alias("__b"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"),
        *([F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s0")] if value is not None else []),
    )
    within = Window.partitionBy(*keys, "__block").orderBy(*order)
    out = rows.withColumn("__rn", F.row_number().over(within) - 1)
    if value is not None:
        out = out.withColumn("__sv", F.coalesce(F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    on = F.col("__block").eqNullSafe(F.col("__b"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = out.join(starts, on, "inner").withColumn(rank, (F.col("__n0") + F.col("__rn")).cast("long"))
    if value is not None:
        out = out.withColumn(total, (F.col("__s0") + F.col("__sv")).cast("long"))
    return out.drop("__block", "__b", "__n0", "__s0", "__rn", "__sv", *[f"__k{i}" for i in range(len(keys))])
