"""Embedding near-duplicates by PCA-ordered tiles.

Equal vectors of a label collapse first. What is left is rotated to its principal axes (covariance over
all vectors), ordered by the first axis within its label and cut into tiles. Two tiles meet only if
their first coordinates can be near enough. Inside a pair of tiles leading coordinates are
accumulated first; a pair is given up when what it has, plus the product of the remaining norms,
cannot reach the threshold. Survivors are checked on the original numbers in double precision. A
task returns link counts and a spanning forest, not pairs.

Null labels and null, zero, null-holding or non-finite vectors link with nothing; vectors of another
length never link; a row without vec_id links with nothing; rows that repeat a vec_id link each by
their own vector, and all of them that have their component's smallest vec_id are kept; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators.components import component_roots, spanning_roots
from emberline.llm.classes import smallest_of_components
from emberline.llm.topk import finite, matrix
from emberline.operators.ranking import blocked
from emberline.runtime import cut

#: Room for rounding in bounds; decisions are made on the exact check.
SLACK = 1e-9


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _outer(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        sizes = batch.column("dims").to_numpy()
        for d in np.unique(sizes):
            u = _unit(matrix(batch.column("embedding").filter(pa.array(sizes == d)), np.float64))
            total[d] = total.get(d, 0) + u.T @ u
    for d, m in total.items():
        yield pa.record_batch({"dims": pa.array([d] * d, pa.int32()), "i": pa.array(range(d), pa.int32()), "row": pa.array(list(m), pa.list_(pa.float64()))})


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length an orthonormal basis (columns, widest first). Sums over all rows; d x d numbers reach the driver."""
    parts = vectors.select("dims", "embedding").mapInArrow(_outer, "dims int, i int, row array<double>")
    cells = parts.select("dims", "i", F.posexplode("row").alias("j", "v")).groupBy("dims", "i", "j").agg(F.sum("v").alias("v")).collect()
    axes = {}
    for d in {c["dims"] for c in cells}:
        m = np.zeros((d, d))
        for c in cells:
            if c["dims"] == d:
                m[c["i"], c["j"]] = c["v"]
        axes[d] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]
    return axes


def _project(axes: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            first = np.zeros(batch.num_rows)
            sizes = batch.column("dims").to_numpy()
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                first[at] = _unit(matrix(batch.column("embedding").take(pa.array(at)), np.float64)) @ axes[d][:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first)], names=[*batch.schema.names, "pc"])

    return run


def linked_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine >= threshold; with ``same`` only i < j."""
    ua, ub = _unit(a) @ axes, _unit(b) @ axes
    d = ua.shape[1]
    cuts = [min(d, c) for c in (8, 16, 32)]
    rest = lambda u, c: np.sqrt(np.maximum(0, (u[:, c:] * u[:, c:]).sum(axis=1)))
    c = cuts[0]
    reach = ua[:, :c] @ ub[:, :c].T + np.outer(rest(ua, c), rest(ub, c)) >= threshold - SLACK
    if same:
        reach = np.triu(reach, 1)
    i, j = np.nonzero(reach)
    part = np.einsum("ij,ij->i", ua[i, :c], ub[j, :c])
    for lo, hi in zip(cuts, [*cuts[1:], d]):
        if hi > lo and len(i):
            part = part + np.einsum("ij,ij->i", ua[i, lo:hi], ub[j, lo:hi])
            keep = part + rest(ua, hi)[i] * rest(ub, hi)[j] >= threshold - SLACK
            i, j, part = i[keep], j[keep], part[keep]
    sa, sb = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    na, nb = np.sqrt((sa * sa).sum(axis=1)), np.sqrt((sb * sb).sum(axis=1))
    keep = np.einsum("ij,ij->i", sa[i], sb[j]) / (na[i] * nb[j]) >= threshold
    return i[keep], j[keep]


def _tile_pair(axes: dict[int, np.ndarray], threshold: float):
    def run(key, table):
        side = table.column("side").to_numpy()
        ids, weight = table.column("rep").to_numpy(), table.column("n").to_numpy()
        rows = matrix(table.column("embedding"), np.float64)
        same = key[2].as_py() == key[3].as_py()
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        i, j = linked_pairs(rows[left], rows[right], axes[rows.shape[1]], threshold, same)
        i, j = left[i], right[j]
        links = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
        low = np.argsort(ids)
        at = np.empty(len(ids), np.int64)
        at[low] = np.arange(len(ids))
        root = low[spanning_roots(len(ids), at[i], at[j])][at]
        hit = np.flatnonzero(links)
        return pa.table({"rep": pa.array(ids[hit]), "links": pa.array(links[hit].astype(np.int64)), "root": pa.array(ids[root[hit]])})

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98, tile: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row."""
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    nonzero = F.exists("embedding", lambda x: x != 0)
    whole = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")) & nonzero)
    # Classes have numbers of their own, so that a vec_id may repeat with other vectors.
    classes = cut(
        whole.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("dims", F.size("embedding")).withColumn("rep", F.monotonically_increasing_id())
    )
    axes = principal_axes(classes)
    near = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    placed = cut(
        blocked(
            classes.select("label", "embedding", "rep", "n", "dims").mapInArrow(_project(axes), "label long, embedding array<double>, rep long, n long, dims int, pc double"),
            ["label", "dims"], F.floor(F.col("pc") * 512), [F.col("pc"), F.col("rep")], rank="at",
        ).withColumn("tile", F.floor(F.col("at") / tile))
    )
    bounds = placed.groupBy("label", "dims", "tile").agg(F.min("pc").alias("lo"), F.max("pc").alias("hi"))
    other = bounds.select("label", "dims", F.col("tile").alias("tile_b"), F.col("lo").alias("lo_b"))
    meet = bounds.join(other, ["label", "dims"]).where((F.col("tile_b") >= F.col("tile")) & (F.col("lo_b") - F.col("hi") <= near)).select("label", "dims", F.col("tile").alias("tile_a"), "tile_b")
    side = lambda name, n: placed.withColumnRenamed("tile", name).join(meet, ["label", "dims", name]).select("label", "dims", "tile_a", "tile_b", F.lit(n).alias("side"), "rep", "n", "embedding")
    both = side("tile_a", 0).unionByName(side("tile_b", 1).where("tile_a <> tile_b"))
    found = cut(both.groupBy("label", "dims", "tile_a", "tile_b").applyInArrow(_tile_pair(axes, threshold), "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    least = smallest_of_components(component_roots(found, "rep", "root"), classes.select("rep", F.col("first").alias("value")))
    judged = classes.join(links, "rep", "left").join(least, "rep", "left").select(
        "label", "embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("value", "first").alias("component_id")
    )
    out = rows.join(judged, ["label", "embedding"], "left").select(
        "vec_id", F.when(F.col("vec_id").isNotNull(), F.col("n_links")).alias("links"), F.when(F.col("vec_id").isNotNull(), F.col("component_id")).alias("component")
    )
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
