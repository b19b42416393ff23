"""Mixing sources to target weights by a low-discrepancy schedule.

Every source has a target. Time is cut into slots of one block of words each; the fractional parts
of t times the golden ratio, mapped through the cumulative targets, name each slot's source, so any
stretch of the schedule has nearly the right shares. A source's documents, shuffled by a hash, form
a stream that repeats; it is cut into blocks of the same number of words. The kth slot of a source
takes the kth block, by a join of slot ranks and block numbers. The slots are the order of the mix:
each document carries the first and the last slot that takes words of it, and a reader that follows
them meets the sources in their shares all along. The stream ends at the target, so a last block may
be short; sources that the schedule left below their target, by a few blocks at most, get closing
slots after all others, which also serves sources far smaller than a block.

Targets take one small job per round, each filling a source at least; sources are ordered by ranges of
their names. Both are meant for up to millions of sources. Null or empty texts have size 0
and are taken as 0 words; a null source is a source of its own and comes last; null and repeated
doc_ids, and repeated rows, each count as documents of their own; columns are carried only if asked
for; an empty table gives no rows. Order depends on a seeded hash of id, source and text, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.words import word_count
from emberline.operators.ranking import blocked
from emberline.runtime import cut, fill, spread

#: The points are (t * STEP mod SPAN) / SPAN; STEP / SPAN is the golden ratio's fractional part, STEP odd.
SPAN = 1 << 31
STEP = 1327217885
#: Cells over [0, 1) in which slots meet the sources whose share touches the cell.
CELLS = 4096


def _in_pieces(sources: DataFrame, few: int = 10_000) -> DataFrame:
    """``sources`` (with source) plus piece: ascending ranges of their names in code point order, null last."""
    count = sources.count()
    if count <= few:
        return cut(sources.withColumn("piece", F.lit(0)))
    order = [F.col("source").isNull(), F.col("source")]
    return cut(sources.repartitionByRange(fill(count, few), *order).withColumn("piece", F.spark_partition_id()))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: float = 3.0) -> DataFrame:
    """``sizes`` (source, source_size) plus weight and target.

    Sources in code point order, null last, weigh ``weights`` in turn and share the whole; a target
    stops at ``limit`` times its source's size and the excess goes to the others by weight, again
    until none is above. Each round is one small aggregate over the sources.
    """
    ranked = blocked(_in_pieces(sizes), [], F.col("piece"), [F.col("source").isNull(), F.col("source")], rank="place")
    rows = cut(ranked.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights)).cast("int"))).withColumn("full", F.lit(False)))
    cap = limit * F.col("source_size")
    while True:
        s = rows.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(F.col("full"), cap)).alias("capped"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("open"), F.count_if("full").alias("n")
        ).first()
        rate = ((s["all"] or 0) - (s["capped"] or 0.0)) / s["open"] if s["open"] else 0.0
        now = F.col("full") | (F.col("weight") * rate > cap)
        if rows.where(now).count() == s["n"]:
            break
        rows = cut(rows.withColumn("full", now))
    return rows.select("source", "source_size", "weight", F.when(F.col("full"), cap).otherwise(F.col("weight") * rate).cast("double").alias("target"))


def schedule(goals: DataFrame, words: int, block: int) -> DataFrame:
    """(slot, source, rank): the source of each block of the mix, and the slot's number within the source; closing slots come after all others."""
    spark = goals.sparkSession
    slots = -(-words // block)
    # Millionths of a word, so that the running sum is exact and each share ends where the next begins.
    millionths = (F.col("target") * 1_000_000).cast("long")
    some = goals.where("target > 0").withColumn("share", millionths)
    whole = some.agg(F.sum("share")).first()[0] or 1
    shares = blocked(_in_pieces(some), [], F.col("piece"), [F.col("source").isNull(), F.col("source")], rank="place", value=F.col("share"), total="before")
    edge = lambda x: F.floor(x.cast("decimal(38,0)") * SPAN / F.lit(whole).cast("decimal(38,0)")).cast("long")
    cells = shares.select("source", edge(F.col("before")).alias("lo"), edge(F.col("before") + F.col("share")).alias("hi")).where("lo < hi")
    width = SPAN // CELLS
    cells = cells.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") % SPAN) * STEP % SPAN).alias("u")).withColumn("cell", F.floor(F.col("u") / width))
    named = points.join(cells, "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("slot", "source")
    ranked = blocked(named, ["source"], F.floor(F.col("slot") / 65536), [F.col("slot")], rank="rank")
    had = named.groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("had"))
    wanted = goals.join(had, F.col("source").eqNullSafe(F.col("s")), "left").select("source", F.coalesce("had", F.lit(0)).alias("had"), F.ceil(F.floor(F.col("target") + 0.5) / block).alias("all"))
    closing = wanted.where("had < all").select("source", F.explode(F.sequence(F.col("had"), F.col("all") - 1)).alias("rank"))
    return ranked.select("slot", "source", "rank").unionByName(closing.select(F.lit(slots).cast("long").alias("slot"), "source", "rank"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: float = 3.0, block: int = 256, seed: int = 17, size: Column | None = None, carry: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, first_slot, last_slot, nth, *carry), one row per document.

    ``taken`` counts the words that the schedule's blocks take from the document, repeats counted; the
    slots are null where none takes any. Within a slot, documents follow one another by ``nth``.
    """
    words_of = (word_count(F.col("text")) if size is None else size).alias("size")
    named = [c for c in ("doc_id", "source", "text") if c in docs.columns]
    rows = docs.select("doc_id", "source", words_of, F.shiftrightunsigned(F.xxhash64(*named, F.lit(seed)), 1).alias("h"), *carry)
    carried = rows.columns[4:]
    rows = cut(rows)
    goals = cut(targets(rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), weights, limit))
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")).first()
    pieces = spread(totals["n"])
    streams = blocked(rows, ["source"], F.expr(f"h div {(2**63 - 1) // pieces + 1}") if pieces > 1 else F.lit(0), [F.col("h"), F.col("doc_id"), F.col("size")], rank="nth", value=F.col("size"), total="start")
    # The stream of a source repeats up to `limit` times; each turn gives the document an interval of positions.
    sized = streams.join(goals.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    turns = sized.where("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("target") / F.col("source_size")).cast("int")))))
    placed = turns.withColumn("from", F.col("turn") * F.col("source_size") + F.col("start")).withColumn("to", F.least(F.col("from") + F.col("size"), F.floor(F.col("target") + 0.5))).where("from < to")
    cuts = placed.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    words = F.least("to", (F.col("rank") + 1) * block) - F.greatest("from", F.col("rank") * block)
    slots = schedule(goals, totals["words"] or 0, block).withColumnsRenamed({"source": "s", "rank": "r"})
    taken = cuts.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("rank") == F.col("r"))).groupBy("source", "nth").agg(F.sum(words).alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
    taken = taken.withColumnsRenamed({"source": "s", "nth": "k"})
    out = sized.join(taken, F.col("source").eqNullSafe(F.col("s")) & (F.col("nth") == F.col("k")), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", "last_slot", "nth", *carried)
