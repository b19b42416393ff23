"""Exact top-k inner products by Fagin's threshold algorithm, in blocks.

Candidates are cut into blocks by a hash of id and vector. A block sorts one list per dimension; a query
walks all lists from their better end, scores what it meets for the first time, and stops when the
sum of the frontier values, an upper bound for everything not met, is below its kth score. The
blocks' best k meet in a small final ranking. Ties go to the smaller id.

The bound needs dimensions that differ: in 64 dimensions of like spread it stays above the kth score
until every candidate has been met, even if that score is known from the start and the list with the
largest frontier goes first. There the search is a full product, in blocks; where few components carry
a query it stops early. The tests hold both.

The number of blocks and their size both grow as a root of the rows, and a block is sorted once for
each ``query_block`` queries, so copies of queries grow as rows * root(rows), and those of candidates
by one for each ``query_block`` queries.

Null vectors and vectors with null, NaN or infinite components take no part; vectors of another
length are not candidates; rows that repeat an id are all ranked, but never for a query of that id, and
query rows that repeat an id share its k places;
other columns are ignored; an empty table gives no rows. Scores that leave 64 bits saturate.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.runtime import fill


def finite(vector: Column) -> Column:
    """True where the array is there and all its components are there and finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, dtype: type) -> np.ndarray:
    """A list column without nulls and of one length as a matrix."""
    one = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return one.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(one), -1)


def threshold_search(ids: np.ndarray, rows: np.ndarray, query: np.ndarray, own: int, lists: np.ndarray, k: int, first: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the k best rows for one query; ``lists[d]`` orders the rows by component d."""
    n = len(ids)
    used = np.flatnonzero(query != 0)
    if not len(used):
        used = np.arange(min(1, rows.shape[1]))
    up = query[used] > 0
    seen = np.zeros(n, bool)
    best, scores = np.empty(0, np.int64), np.empty(0, rows.dtype)
    depth, step = 0, first
    while depth < n:
        to = min(n, depth + step)
        met = np.concatenate([lists[used[up], n - to : n - depth].ravel(), lists[used[~up], depth:to].ravel()])
        fresh = np.zeros(n, bool)
        fresh[met] = True
        fresh &= ~seen
        seen |= fresh
        new = np.flatnonzero(fresh)
        new = new[ids[new] != own]
        if len(new):
            best, scores = np.concatenate([best, new]), np.concatenate([scores, rows[new] @ query])
            if len(best) > k:
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                keep = scores >= least
                best, scores = best[keep], scores[keep]
                order = np.lexsort((ids[best], -scores))[:k]
                best, scores = best[order], scores[order]
        depth, step = to, step * 2
        if depth < n and len(best) == k:
            frontier = np.where(up, rows[lists[used, n - depth], used], rows[lists[used, depth - 1], used])
            if (frontier * query[used]).sum() < scores.min():
                break
        if seen.all():
            break
    order = np.lexsort((ids[best], -scores))
    return best[order], scores[order]


_OUT = "query_id long, vec_id long, score long"


def _search_block(k: int):
    def run(table: pa.Table) -> pa.Table:
        asks = table.column("ask").to_numpy(zero_copy_only=False).astype(bool)
        ids = table.column("vec_id").to_numpy()
        out: list[list] = [[], [], []]
        if asks.any() and not asks.all():
            q = matrix(table.column("q"), np.int64)
            top = [int(np.abs(q[m]).max(initial=0)) for m in (asks, ~asks)]
            kind = np.float64 if top[0] * top[1] * max(1, q.shape[1]) < 2**53 else object
            rows, queries, own = q[~asks].astype(kind), q[asks].astype(kind), ids[~asks]
            order = np.argsort(own, kind="stable")
            rows, own = np.ascontiguousarray(rows[order]), own[order]
            lists = np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T)
            for query, name in zip(queries, ids[asks]):
                best, scores = threshold_search(own, rows, query, name, lists, k)
                out[0] += [name] * len(best)
                out[1] += own[best].tolist()
                out[2] += [max(-(2**63), min(2**63 - 1, int(s))) for s in scores]
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    return run


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, block: int | None = None, query_block: int = 1 << 16) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row for which ``is_query`` holds."""
    whole = vectors.where(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).select(
        "vec_id", is_query.alias("asks"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q"), F.size("embedding").alias("dims")
    )
    counts = whole.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("m")).first()
    blocks, asks = fill(counts["n"], block or max(1024, 6 * math.isqrt(counts["n"]))), fill(counts["m"], query_block)
    spread = lambda of, seed, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if of is None else F.pmod(F.xxhash64(of, F.lit(seed)), F.lit(n)).cast("int")
    candidates = whole.select("vec_id", "q", "dims", F.lit(False).alias("ask"), F.pmod(F.xxhash64("vec_id", "q"), F.lit(blocks)).cast("int").alias("c"), spread(None, 0, asks).alias("a"))
    queries = whole.where("asks").select("vec_id", "q", "dims", F.lit(True).alias("ask"), spread("vec_id", 2, asks).alias("a"), spread(None, 0, blocks).alias("c"))
    found = candidates.unionByName(queries).groupBy("dims", "c", "a").applyInArrow(_search_block(k), _OUT)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
