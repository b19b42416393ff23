"""Connected components by alternating large-star and small-star (Kiveris et al. 2014)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.runtime import cut, fill

#: Edges that one task contracts to a forest before the rounds.
PER_TASK = 250_000
#: Rows that are broadcast, a few MB.
FEW = 50_000


def spanning_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a-b, the smallest node of each node's component."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        before = root.copy()
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        if np.array_equal(before, root):
            break
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root


def _contract(keys: list[str]):
    """A partition's edges as stars: every node that is not the smallest of its component points to that."""

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        n = table.num_rows
        group = np.zeros(n, np.int64)
        for k in keys:
            codes, names = pd.factorize(table.column(k).to_pandas())
            group = group * len(names) + codes
        ends = pd.concat([table.column("u").to_pandas(), table.column("v").to_pandas()], ignore_index=True)
        codes, names = pd.factorize(ends, sort=True)
        nodes, at = np.unique(np.concatenate([group, group]) * len(names) + codes, return_inverse=True)
        root = spanning_roots(len(nodes), at[:n], at[n:])
        row = np.empty(len(nodes), np.int64)
        row[at] = np.tile(np.arange(n), 2)
        low = np.flatnonzero(root != np.arange(len(nodes)))
        name = lambda i: pa.array(np.asarray(names)[nodes[i] % len(names)], table.schema.field("u").type)
        cols = [table.column(k).take(pa.array(row[low])).combine_chunks() for k in keys]
        yield pa.RecordBatch.from_arrays([*cols, name(low), name(root[low])], names=[*keys, "u", "v"])

    return run


def _stars(edges: DataFrame, keys: list[str]) -> DataFrame:
    """One large-star and one small-star step over edges (keys, u, v) with v < u."""
    both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    large = both.join(least, [*keys, "u"]).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    root = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    small = large.join(root, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return small.unionByName(root.select(*keys, "u", F.col("m").alias("v"))).distinct()


def _few(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it was counted to be small."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _split(edges: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Edges (keys, u, v) with v < u of components that are no stars yet, and those of complete stars.

    A star is complete if its centre is below nothing and every other node has that one edge.
    """
    end = lambda c, up: edges.select(*keys, F.col(c).alias("v"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
    nodes = end("u", 1).unionByName(end("v", 0)).groupBy(*keys, "v").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    loose = cut(nodes.where("up > 1 or up = 1 and down > 0").select(*keys, "v"))
    above = edges.join(_few(loose.withColumnRenamed("v", "u")), [*keys, "u"], "left_semi").select(*keys, "v")
    centres = _few(cut(above.unionByName(loose).distinct()))
    return cut(edges.join(centres, [*keys, "v"], "left_semi")), edges.join(centres, [*keys, "v"], "left_anti")


def _dealt(edges: DataFrame, parts: int) -> DataFrame:
    """``edges`` by their place, so that tasks hold whole neighbourhoods; a place with more than a task's share is cut by ids."""
    pieces = edges.groupBy("near").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > PER_TASK).select("near", F.ceil(F.col("__n") / PER_TASK).alias("__pieces"))
    dealt = edges.join(_few(cut(pieces)), "near", "left")
    return dealt.repartition(parts, "near", F.pmod(F.xxhash64("u"), F.coalesce("__pieces", F.lit(1))))


def component_roots(edges: DataFrame, src: str = "src", dst: str = "dst", keys: list[str] | None = None, rounds: int = 60, near: str | None = None) -> DataFrame:
    """(keys, id, component) for every id that has an edge and is not its component's smallest id.

    ``edges`` may repeat, point both ways or loop; null ends are ignored. Ids are of any ordered
    type. With ``keys`` the graph of each key is solved in the same loop. Tasks first contract
    their share of the edges to stars, which solves a graph of one share; ``near`` names a column that
    is the same for edges likely to be of one component. Complete stars then leave, and only the rest
    takes part in a round, which writes a checkpoint, until one task holds it. Edges shrink to one per
    vertex, and O(log n) rounds are enough.
    """
    keys = keys or []
    ends = edges.select(*keys, F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), *([F.col(near).alias("near")] if near else [])).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") > F.col("v")))
    now = cut(ends.groupBy(*keys, "u", "v").agg(F.min("near").alias("near")) if near else ends.distinct())
    parts = fill(now.count(), PER_TASK)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in now.schema.fields if f.name != "near")
    solved = lambda df: cut(df.select(*keys, "u", "v").coalesce(1).mapInArrow(_contract(keys), kinds))
    out = [] if parts > 1 else [solved(now)]
    if parts > 1:
        now = cut((_dealt(now, parts) if near else now.repartition(parts)).select(*keys, "u", "v").mapInArrow(_contract(keys), kinds))
        for _ in range(rounds):
            now, complete = _split(now, keys)
            out.append(complete)
            if now.count() <= PER_TASK:
                out.append(solved(now))
                break
            now = cut(_stars(now, keys))
        else:
            raise RuntimeError(f"no fixed point after {rounds} rounds")
    return reduce(DataFrame.unionByName, out).select(*keys, F.col("u").alias("id"), F.col("v").alias("component"))


def label_components(vertices: DataFrame, edges: DataFrame, id_col: str, out: str, keys: list[str] | None = None) -> DataFrame:
    """``vertices`` plus ``out``: the smallest id reachable; a vertex without edges is its own."""
    keys = keys or []
    roots = component_roots(edges, keys=keys).withColumnsRenamed({"id": id_col, "component": out})
    return vertices.join(roots, [*keys, id_col], "left").withColumn(out, F.coalesce(out, id_col))
