"""Shards of near-equal bytes for indivisible groups, by Karmarkar-Karp differencing.

Groups (equal texts) hash to cells. A cell starts with one partial partition per group, with all
its bytes in one of k parts, and repeatedly combines the two partials of largest spread, the
largest part of one with the smallest of the other. Each cell leaves one partial; the same
combining, cell by cell and then in wider and wider tasks, joins the cells' partials into the shards.

A null text counts as empty (size 8); ties order by group hash, so reruns agree; a repeated row is one more member of its group; other columns are ignored; an empty
table gives no rows. A group larger than a shard's share still stays whole: its shard is then as
large as the group.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators.ranking import blocked
from emberline.runtime import cut, fill, spread


def differencing(partials: np.ndarray) -> np.ndarray:
    """For n partials with k parts each (n x k sums), the final part of each partial's each part (n x k)."""
    n, k = partials.shape
    order = np.argsort(partials, axis=1, kind="stable")
    sums = [row[o] for row, o in zip(partials, order)]
    #: A node's parts are kept ascending; nodes >= n remember where their children's parts went.
    made: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    heap = [(-int(s[-1] - s[0]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    down = np.arange(k - 1, -1, -1)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        joined = sums[a] + sums[b][::-1]
        by = np.argsort(joined, kind="stable")
        place = np.empty(k, np.int64)
        place[by] = np.arange(k)
        made.append((a, b, place, place[down]))
        sums.append(joined[by])
        sums[a] = sums[b] = None
        heapq.heappush(heap, (-int(sums[-1][-1] - sums[-1][0]), len(sums) - 1))
    final: list[np.ndarray | None] = [None] * len(sums)
    if sums:
        final[heap[0][1]] = np.arange(k)
    for at in range(len(made) - 1, -1, -1):
        a, b, pa_, pb = made[at]
        final[a], final[b] = final[n + at][pa_], final[n + at][pb]
    out = np.empty((n, k), np.int64)
    for i in range(n):
        out[i, order[i]] = final[i]
    return out


def _cell(shards: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bytes", "descending"), ("group", "ascending")])
        sizes = table.column("bytes").to_numpy()
        partials = np.zeros((len(sizes), shards), np.int64)
        partials[:, 0] = sizes
        part = differencing(partials)[:, 0]
        return pa.table({"cell": table.column("cell"), "group": table.column("group"), "bytes": table.column("bytes"), "part": pa.array(part, pa.int32())})

    return run


def _merge(shards: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("node", "ascending"), ("part", "ascending")])
        nodes = table.column("node").to_numpy()
        names, at = np.unique(nodes, return_inverse=True)
        partials = np.zeros((len(names), shards), np.int64)
        parts = table.column("part").to_numpy()
        partials[at, parts] = table.column("bytes").to_numpy()
        to = differencing(partials)
        up = table.column("up").to_numpy()
        return pa.table({"up": pa.array(up), "node": pa.array(nodes), "part": pa.array(parts), "to": pa.array(to[at, parts], pa.int32()), "bytes": table.column("bytes")})

    return run


def shard_groups(groups: DataFrame, shards: int = 24, per_cell: int = 4096, fan_in: int = 512) -> DataFrame:
    """``groups`` (group string, bytes long) plus shard, with near-equal bytes per shard."""
    cells = fill(groups.count(), per_cell)
    placed = cut(
        groups.withColumn("cell", F.pmod(F.xxhash64("group"), F.lit(cells)))
        .groupBy("cell").applyInArrow(_cell(shards), "cell long, group string, bytes long, part int")
    )
    # Level by level the map (node, part) -> shard is composed; nodes shrink by fan_in each time.
    level = placed.groupBy(F.col("cell").alias("node"), "part").agg(F.sum("bytes").alias("bytes"))
    maps = None
    while True:
        tops = fill(cells, fan_in)
        merged = cut(
            level.withColumn("up", F.floor(F.col("node") / fan_in)).groupBy("up").applyInArrow(_merge(shards), "up long, node long, part int, to int, bytes long")
        )
        step = merged.select("node", "part", "up", "to")
        if maps is None:
            maps = step.select(F.col("node").alias("cell"), F.col("part").alias("first"), F.col("up").alias("node"), F.col("to").alias("part"))
        else:
            maps = maps.join(step, ["node", "part"]).select("cell", "first", F.col("up").alias("node"), F.col("to").alias("part"))
        if tops == 1:
            break
        level = merged.groupBy(F.col("up").alias("node"), F.col("to").alias("part")).agg(F.sum("bytes").alias("bytes"))
        cells = tops
    final = maps.select("cell", F.col("first").alias("part"), F.col("part").alias("shard"))
    return placed.join(final, ["cell", "part"]).select("group", "bytes", "shard")


def text_group(text: Column) -> Column:
    """Equal texts share it; a null text counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row in one shard, slots gapless from 0 in each."""
    rows = cut(
        docs.select(
            "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
            F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"), text_group(F.col("text")).alias("group"),
        )
    )
    groups = shard_groups(rows.groupBy("group").agg(F.sum("size").alias("bytes")), shards).select("group", "shard")
    placed = cut(rows.join(groups, "group").select("doc_id", "size", "text_crc32", "shard"))
    pieces = spread(placed.count())
    return blocked(placed, ["shard"], F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(pieces)), [F.col("doc_id"), F.col("text_crc32")], rank="slot")
