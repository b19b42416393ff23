"""Near-duplicate documents: a Jaccard join of word shingles by chosen paths.

Equal word sequences collapse to a class. A class's shingles (five words) give 64 minimum hashes,
sampled shared tokens in the sense that two documents share one with a chance of their similarity.
In each run a class enters the node of one chosen token. Nodes of at most ``limit`` classes are
compared by brute force on the tokens, generously; a larger node is crowded and goes on by more
tokens that it chooses among those its path has not used, into as many children as keep a pair at
the threshold together in expectation.

How many of a class's paths went through crowded nodes bounds the chance that a pair at the
threshold was missed in all its runs. For classes for which this chance is above 1 - ``recall``,
links to the smallest member and a comparison of the few members outside a node's main cluster with
all of the node settle the nodes that near copies crowd. Classes that are still above it then first
enter the nodes of all other tokens, which settles those with some tokens of their own, and then
split their crowded nodes, first those of ``runs`` runs, then, where the bound asks for it, those of
all tokens; a pair is safe as soon as one of its two is. Nodes whose classes are in one cluster already have nothing more to give. Nodes
that stay crowded after all splits hold nearly equal documents and are kept whole.

What met in any run, and passed, forms clusters; in each, true similarities of all pairs are computed on the whole
shingle sets, in tiles, so links are exact whichever run found the cluster. Tasks return counts and
spanning forests, never pairs.

Texts with fewer words than a shingle have one shingle, all their words; texts without words (null
or empty) link with nothing; repeated rows and equal texts are links of each other; a null doc_id
takes part as the smallest id, and rows that repeat a doc_id each with their own text; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.rolling import Spans, scramble, slices, word_bounds, word_hashes
from emberline.llm.classes import smallest_of_components
from emberline.operators.components import component_roots, spanning_roots
from emberline.operators.ranking import blocked
from emberline.runtime import cut, fill

TOKENS = 64
_SEEDS = np.random.default_rng(7).integers(0, 1 << 64, TOKENS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(column, width: int):
    """Per slice: (first row, number of rows, sorted distinct shingle hashes, their bounds by row, hash of all words by row)."""
    for row, data, offsets in slices(column):
        starts, ends, doc = word_bounds(data, offsets)
        n = np.bincount(doc, minlength=len(offsets) - 1)
        begin = np.concatenate([[0], np.cumsum(n)])
        spans = Spans(word_hashes(data, starts, ends))
        left = n[doc] - (np.arange(len(doc)) - begin[doc])
        at = np.flatnonzero(left >= np.minimum(width, n[doc]))
        at = at[(n[doc[at]] >= width) | (left[at] == n[doc[at]])]
        values, owner = spans.at(at, at + np.minimum(width, n[doc[at]])), doc[at]
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        values, owner = values[new], owner[new]
        whole = np.zeros((len(n), 2), np.uint64)
        some = n > 0
        whole[some, 0] = spans.at(begin[:-1][some], begin[1:][some])
        whole[some, 1] = Spans(word_hashes(data, starts, ends, second=True), second=True).at(begin[:-1][some], begin[1:][some]) ^ n[some].astype(np.uint64)
        yield row, len(n), values, np.searchsorted(owner, np.arange(len(n) + 1)), whole


def _sketch(width: int):
    def run(batches):
        for batch in batches:
            for row, n, values, bounds, whole in shingle_sets(batch.column("text"), width):
                some = np.flatnonzero(np.diff(bounds))
                least = np.empty((TOKENS, len(some)), np.uint32)
                if len(some):
                    for t in range(TOKENS):
                        x = values * _SEEDS[t]
                        x ^= x >> np.uint64(32)
                        x *= _SEEDS[t]
                        least[t] = np.minimum.reduceat(x >> np.uint64(32), bounds[:-1][some]).astype(np.uint32)
                own = [batch.column(c).slice(row, n).take(pa.array(some)) for c in ("doc_id", "row_a", "row_b")]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(whole[some, 0].copy().view(np.int64)), pa.array(whole[some, 1].copy().view(np.int64)), pa.array([r.tobytes() for r in np.ascontiguousarray(least.T)], pa.binary())],
                    names=["doc_id", "row_a", "row_b", "wa", "wb", "tokens"],
                )

    return run


def _enter(first: int, last: int):
    """Every class into the first node of the runs from ``first`` to before ``last``; ``used`` has a bit for each token of the path, ``own`` is the class's cluster so far."""
    chosen = np.random.default_rng(11).permutation(TOKENS)[first:last].astype(np.uint64)

    def run(batches):
        for batch in batches:
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(-1, TOKENS)
            nodes = np.stack([scramble(tokens[:, int(c)].astype(np.uint64) | ((c + np.uint64(1)) << np.uint64(40))) for c in chosen])
            used = np.repeat(np.uint64(1) << chosen, batch.num_rows)
            runs = np.repeat(np.arange(first, last, dtype=np.int32), batch.num_rows)
            rep, own = (pa.array(np.tile(batch.column(c).to_numpy(), len(chosen))) for c in ("rep", "own"))
            yield pa.RecordBatch.from_arrays([pa.array(nodes.ravel().view(np.int64)), pa.array(used.view(np.int64)), pa.array(runs), rep, own], names=["node", "used", "run", "rep", "own"])

    return run


def _split(similarity: float, floor: float):
    """The members of a crowded node move on by more chosen tokens; the choice is the node's, so equal tokens meet.

    A node chooses one token, or two so often that it has 1 / similarity children on average. Those
    who pass with the node's smallest member are linked to it (dst) and take over its cluster.
    """
    bits = np.arange(TOKENS, dtype=np.uint64)

    def run(batches):
        for batch in batches:
            node, used = (batch.column(c).to_numpy().view(np.uint64) for c in ("node", "used"))
            rep, own, low = (batch.column(c).to_numpy() for c in ("rep", "own", "low"))
            tokens, pivot = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, TOKENS) for c in ("tokens", "pivot"))
            near = (tokens == pivot).mean(axis=1) >= floor
            own = np.where(near, batch.column("low_own").to_numpy(), own)
            draw = scramble(node[:, None] + (bits + np.uint64(1))[None, :] * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
            draw[((used[:, None] >> bits[None, :]) & np.uint64(1)) > 0] = 0
            chosen = np.argsort(draw, axis=1)[:, -2:]
            twice = np.flatnonzero(scramble(node + np.uint64(77)) < np.uint64(int((1 / similarity - 1) * 2**64)))
            row = np.concatenate([np.arange(len(node)), twice])
            token = np.concatenate([chosen[:, 1], chosen[twice, 0]])
            child = scramble(scramble(node[row] + np.uint64(1) + token.astype(np.uint64)) + tokens[row, token])
            used = used[row] | (np.uint64(1) << token.astype(np.uint64))
            link = np.flatnonzero(near & (rep != low))
            none = pa.nulls(len(link), pa.int64())
            columns = [
                pa.concat_arrays([pa.array(child.view(np.int64)), none]), pa.concat_arrays([pa.array(used.view(np.int64)), none]),
                pa.array(np.concatenate([rep[row], rep[link]])), pa.array(np.concatenate([own[row], own[link]])),
                pa.concat_arrays([pa.nulls(len(row), pa.int64()), pa.array(low[link])]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "used", "rep", "own", "dst"])

    return run


def _to_pivot(floor: float):
    """Links (src, dst) of the members of crowded nodes that pass with their node's smallest member."""

    def run(batches):
        for batch in batches:
            tokens, pivot = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, TOKENS) for c in ("tokens", "pivot"))
            near = pa.array(np.flatnonzero((tokens == pivot).mean(axis=1) >= floor))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(near) for c in ("rep", "low")], names=["src", "dst"])

    return run


def _binomial(n: int, p: float) -> np.ndarray:
    return np.array([math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)])


def most_crowded(similarity: float, runs: int, recall: float) -> int:
    """Of ``runs`` first nodes, how many may be crowded so that a pair at ``similarity`` shares one of the others with ``recall``; -1 if none.

    The pair shares a binomial number of the runs' tokens; at worst all of these are in crowded nodes.
    """
    chance = np.cumsum(_binomial(runs, similarity))
    return int(np.searchsorted(chance, 1 - recall, "right")) - 1


def _missed(similarity: float, depth: int):
    """The chance that a pair at ``similarity`` met in no node, from how many first nodes of a class are
    crowded, how many of them were split, and how many of the paths were in crowded nodes at each level.

    The pair shares k of the tokens; to be missed, all k are among the crowded ones. A path that was
    split at a shared token goes on by a token that is shared with (k - n) / (64 - n) at level n, into
    a node that is crowded as often as the class's paths of that level are; a node has two children
    with 1 / similarity - 1. Paths end early on tokens that few documents have, and so just on those
    that a pair does not share; therefore the tokens not shared are counted among the paths that end.
    """
    k = np.arange(TOKENS + 1)
    weight, two = _binomial(TOKENS, similarity), 1 / similarity - 1

    def run(batches):
        for batch in batches:
            crowded, split = (batch.column(c).to_numpy().astype(np.float64)[:, None] for c in ("crowded", "split"))
            paths = np.zeros((batch.num_rows, depth + 2))
            paths[:, :1] = split
            for row, counts in enumerate(batch.column("paths").to_pylist()):
                for x in counts or []:
                    paths[row, x["level"]] = x["m"]
            together = np.zeros((batch.num_rows, TOKENS + 1))
            for level in range(depth, 0, -1):
                shared = np.maximum(0, k - level)[None, :] / (TOKENS - level)
                on = np.minimum(1, paths[:, level] / np.maximum(1e-9, paths[:, level - 1] * (1 + two)))[:, None]
                together = np.maximum(0, shared - on) + np.minimum(shared, on) * together * (1 + two - two * together)
            start = np.minimum(1, k[None, :] / np.maximum(1, crowded)) * together * (1 + two - two * together)
            missed = np.where(k[None, :] <= crowded, (1 - start) ** split, 0)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(missed @ weight)], names=["rep", "missed"])

    return run


def _brute(floor: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("node", "ascending"), ("rep", "ascending")])
        node, rep = table.column("node").to_numpy(), table.column("rep").to_numpy()
        tokens = np.frombuffer(b"".join(table.column("tokens").to_pylist()), np.uint32).reshape(-1, TOKENS)
        src, dst = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        bounds = np.append(np.flatnonzero(np.append(True, node[1:] != node[:-1])), len(node))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            n = hi - lo
            if n < 2:
                continue
            own = tokens[lo:hi]
            if n == 2:
                if (own[0] == own[1]).mean() >= floor:
                    src.append(rep[lo + 1 : hi])
                    dst.append(rep[lo : lo + 1])
                continue
            least = math.ceil(floor * TOKENS - 1e-9)
            later = [np.flatnonzero(np.count_nonzero(own[i + 1 :] == own[i], axis=1) >= least) + i + 1 for i in range(n - 1)]
            i, j = np.repeat(np.arange(n - 1), [len(x) for x in later]), np.concatenate(later)
            root = spanning_roots(n, i, j)
            apart = np.flatnonzero(root != np.arange(n))
            src.append(rep[lo + apart])
            dst.append(rep[lo + root[apart]])
        return pa.table({"src": np.concatenate(src), "dst": np.concatenate(dst)})

    return run


def candidate_clusters(sketches: DataFrame, similarity: float, runs: int, limit: int, depth: int = 16, recall: float = 0.999) -> DataFrame:
    """(id, component) of the classes that share a cluster with a smaller one; ``sketches`` is (rep, tokens)."""
    floor = max(0.0, similarity - 5 * (similarity * (1 - similarity) / TOKENS) ** 0.5)

    def brute(rows: DataFrame, tokens: DataFrame) -> DataFrame:
        parts = fill(rows.count(), 20_000)
        return rows.select("node", "rep").join(tokens.select("rep", "tokens"), "rep").withColumn("part", F.pmod(F.xxhash64("node"), F.lit(parts))).groupBy("part").applyInArrow(_brute(floor), "src long, dst long")

    def meet(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of nodes with classes of several clusters: small ones and crowded ones. Sizes are cut first, so that a hot node is a plain join."""
        sizes = cut(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("low"), F.min("own").alias("a"), F.max("own").alias("b")).where("n > 1 and a < b").drop("a", "b"))
        met = cut(rows.join(sizes, "node"))
        return met.where(F.col("n") <= limit), met.where(F.col("n") > limit)

    def many(frames: list[DataFrame]) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, frames)

    def over(rows: DataFrame, n: int) -> DataFrame:
        """(rep, crowded) of the classes with too many of their ``n`` first nodes in ``rows``, the crowded ones."""
        return cut(rows.groupBy("rep").agg(F.count(F.lit(1)).cast("int").alias("crowded")).where(F.col("crowded") > most_crowded(similarity, n, recall)))

    def clusters() -> DataFrame:
        links[:] = [cut(many(links))]
        return component_roots(links[0]).select(F.col("id").alias("rep"), F.col("component").alias("cluster"))

    entered = cut(sketches.withColumn("own", F.col("rep")).mapInArrow(_enter(0, runs), _ENTERED))
    small, crowded = meet(entered)
    links = [brute(small, sketches)]
    short = over(crowded, runs)
    if short.isEmpty():
        return component_roots(many(links))
    # Near copies of one text crowd the same nodes: links to a node's smallest member make most of them one cluster; the few others are compared with all, piece by piece.
    tokens = cut(sketches.join(short, "rep", "left_semi"))
    crowded = cut(crowded.join(short, "rep", "left_semi").select("node", "used", "run", "rep"))
    pivots = crowded.groupBy("node").agg(F.min("rep").alias("low")).join(tokens.select(F.col("rep").alias("low"), F.col("tokens").alias("pivot")), "low")
    links.append(crowded.join(cut(pivots), "node").join(tokens, "rep").select("rep", "low", "tokens", "pivot").mapInArrow(_to_pivot(floor), "src long, dst long"))
    crowded = cut(crowded.join(clusters(), "rep", "left").select("node", "used", "run", "rep", F.coalesce("cluster", "rep").alias("own")))
    sizes = crowded.groupBy("node", "own").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.sum("n").alias("n"), F.max(F.struct("n", "own")).alias("most"))
    # Nodes that one cluster fills have no more to give.
    sizes = cut(sizes.select("node", F.ceil(F.col("n") / limit).alias("pieces"), F.col("most.own").alias("main"), (F.col("n") - F.col("most.n")).alias("others")).where("others > 0"))
    placed = cut(crowded.join(sizes, "node"))
    at = F.when(F.col("own") == F.col("main"), F.array(F.pmod(F.xxhash64("rep"), "pieces"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))
    links.append(brute(placed.where(F.col("others") <= limit).select("node", "rep", F.explode(at).alias("piece")).select(F.xxhash64("node", "piece").alias("node"), "rep"), tokens))
    crowded = placed.where(F.col("others") > limit).select("node", "used", "run", "rep", "own")
    short = over(crowded, runs)
    if short.isEmpty():
        return component_roots(many(links))
    roots = clusters()
    tokens = cut(tokens.join(short, "rep", "left_semi").join(roots, "rep", "left").select("rep", "tokens", F.coalesce("cluster", "rep").alias("own")))
    small, more = meet(cut(tokens.mapInArrow(_enter(runs, TOKENS), _ENTERED)))
    tokens = tokens.drop("own")
    links.append(brute(small, tokens))
    crowded = crowded.unionByName(more.drop("n", "low"))
    short = over(crowded, TOKENS)
    first, last, split, paths = 0, runs, [], []
    while first < TOKENS and not short.isEmpty():
        roots = clusters()
        rows = crowded.where((F.col("run") >= first) & (F.col("run") < last)).join(short.select("rep"), "rep", "left_semi").join(roots, "rep", "left")
        # Nodes that one cluster fills by now are left aside, but their paths count as split.
        rows = cut(rows.select("node", "used", "rep", F.coalesce("cluster", "own").alias("own")))
        split.append(rows.groupBy("rep").agg(F.count(F.lit(1)).alias("m")))
        for level in range(1, depth + 1):
            ends = cut(rows.groupBy("node").agg(F.min(F.struct("rep", "own")).alias("low"), F.max("own").alias("b"), F.min("own").alias("a")).where("a < b").select("node", F.col("low.rep").alias("low"), F.col("low.own").alias("low_own")))
            if ends.isEmpty():
                break
            pivots = ends.join(tokens.select(F.col("rep").alias("low"), F.col("tokens").alias("pivot")), "low")
            out = cut(rows.join(cut(pivots), "node").join(tokens, "rep").select("node", "used", "rep", "own", "low", "low_own", "tokens", "pivot").mapInArrow(_split(similarity, floor), "node long, used long, rep long, own long, dst long"))
            links.append(out.where("dst is not null").select(F.col("rep").alias("src"), "dst"))
            small, rows = meet(out.where("node is not null").drop("dst"))
            links.append(brute(small, tokens))
            if rows.isEmpty():
                break
            paths.append(rows.groupBy("rep").agg(F.count(F.lit(1)).alias("m")).withColumn("level", F.lit(level)))
            rows = rows.select("node", "used", "rep", "own")
        else:
            links.append(rows.groupBy("node").agg(F.min("rep").alias("dst")).join(rows, "node").select(F.col("rep").alias("src"), "dst"))
        known = short.join(many(split).groupBy("rep").agg(F.sum("m").alias("split")), "rep")
        if paths:
            counts = many(paths).groupBy("rep", "level").agg(F.sum("m").alias("m")).groupBy("rep").agg(F.collect_list(F.struct("level", "m")).alias("paths"))
            known = known.join(counts, "rep", "left")
        else:
            known = known.withColumn("paths", F.expr("cast(null as array<struct<level:int,m:bigint>>)"))
        left = known.mapInArrow(_missed(similarity, depth), "rep long, missed double").where(F.col("missed") > 1 - recall)
        short = cut(short.join(left.select("rep"), "rep", "left_semi"))
        first, last = last, TOKENS
    return component_roots(many(links))


_ENTERED = "node long, used long, run int, rep long, own long"


def _sets(width: int):
    def run(batches):
        for batch in batches:
            for row, n, values, bounds, whole in shingle_sets(batch.column("text"), width):
                named = [batch.column(c).slice(row, n).to_numpy() for c in ("wa", "wb")]
                own = np.flatnonzero((named[0] == whole[:, 0].copy().view(np.int64)) & (named[1] == whole[:, 1].copy().view(np.int64)))
                cols = [batch.column(c).slice(row, n).take(pa.array(own)) for c in ("cluster", "rep", "n")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([values[bounds[i] : bounds[i + 1]].tobytes() for i in own], pa.binary())], names=["cluster", "rep", "n", "shingles"])

    return run


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """|A and B| for sets ``left`` by ``right``, through the shingles that more than one of them has."""
    rows = np.concatenate([left, right]) if left is not right else left
    values = np.concatenate([sets[r] for r in rows])
    who = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    names, at, n = np.unique(values, return_inverse=True, return_counts=True)
    shared = n > 1
    number = np.cumsum(shared) - 1
    keep = shared[at]
    who, at = who[keep], number[at[keep]]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    for lo in range(0, int(shared.sum()), 8192):  # a band of shingles as a dense 0/1 matrix
        a, b = np.searchsorted(at, [lo, lo + 8192])
        m = np.zeros((len(rows), min(8192, int(shared.sum()) - lo)), np.float32)
        m[who[a:b], at[a:b] - lo] = 1
        out += m[: len(left)] @ (m if left is right else m[len(left) :]).T
    return out


def _verify(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster", "ascending"), ("a", "ascending"), ("b", "ascending"), ("rep", "ascending")])
        cluster, a, b, block, rep, weight = (table.column(c).to_numpy() for c in ("cluster", "a", "b", "block", "rep", "n"))
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets], np.float64)
        out: list[list] = [[np.empty(0, np.int64)] for _ in range(3)]
        new = np.append(True, (cluster[1:] != cluster[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        bounds = np.append(np.flatnonzero(new), len(rep))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            rows = np.arange(lo, hi)
            if a[lo] == b[lo]:
                left = right = rows
            else:
                left, right = rows[block[lo:hi] == a[lo]], rows[block[lo:hi] == b[lo]]
            if len(left) * len(right) == 1 and left is right:
                continue
            if len(rows) == 2 and left is right:
                both = float(len(np.intersect1d(sets[lo], sets[lo + 1], assume_unique=True)))
                overlap = np.array([[0, both], [both, 0]])
            else:
                overlap = _overlaps(sets, left, right).astype(np.float64)
            linked = overlap >= similarity * (size[left][:, None] + size[right][None, :] - overlap) - 1e-9
            if left is right:
                linked = np.triu(linked, 1)
            i, j = np.nonzero(linked)
            i, j = left[i] - lo, right[j] - lo
            n = hi - lo
            links = np.bincount(i, weight[lo + j], n) + np.bincount(j, weight[lo + i], n)
            by = np.argsort(rep[lo:hi], kind="stable")
            rank = np.empty(n, np.int64)
            rank[by] = np.arange(n)
            root = by[spanning_roots(n, rank[i], rank[j])][rank]
            hit = np.flatnonzero(links)
            for o, v in zip(out, (rep[lo + hit], links[hit].astype(np.int64), rep[lo + root[hit]])):
                o.append(v)
        return pa.table({k: np.concatenate(v) for k, v in zip(("rep", "links", "root"), out)})

    return run


def row_key() -> list:
    """Two numbers that name a row by its doc_id and text; rows that repeat both share them."""
    return [F.xxhash64("doc_id", "text").alias("row_a"), F.xxhash64("text", F.lit(1), "doc_id").alias("row_b")]


def near_duplicate_documents(
    docs: DataFrame, similarity: float = 0.8, width: int = 5, runs: int = 10, limit: int = 1024, depth: int = 16, tile: int = 1024, recall: float = 0.999
) -> DataFrame:
    """(doc_id, class_id, n_links, kept, row_a, row_b), one row per input row.

    n_links counts the other documents with similarity >= ``similarity``, equal texts included;
    class_id is the smallest doc_id reachable by links (null is the smallest); kept marks one row of
    each class, one that has this doc_id. ``row_a`` and ``row_b`` are the row's ``row_key()``.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = texts.select("doc_id", "text", *row_key())
    sketched = cut(keyed.mapInArrow(_sketch(width), "doc_id long, row_a long, row_b long, wa long, wb long, tokens binary").withColumn("row", F.monotonically_increasing_id()))
    # Classes have numbers of their own; the first row of a class, null ids first, stands for its text.
    order = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "row_a", "row_b", "row")
    classes = cut(sketched.groupBy("wa", "wb").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), F.min("tokens").alias("tokens")).withColumn("rep", F.monotonically_increasing_id()))
    roots = cut(candidate_clusters(classes.select("rep", "tokens"), similarity, runs, limit, depth, recall).withColumnsRenamed({"id": "rep", "component": "cluster"}))
    members = roots.unionByName(roots.select(F.col("cluster").alias("rep"), "cluster").distinct()).join(classes.select("rep", "n", "wa", "wb", "first.row_a", "first.row_b"), "rep")
    whole = keyed.join(members, ["row_a", "row_b"]).select("cluster", "rep", "n", "wa", "wb", "text")
    sets = whole.mapInArrow(_sets(width), "cluster long, rep long, n long, shingles binary").dropDuplicates(["rep"])
    ranked = blocked(members.select("cluster", "rep"), ["cluster"], F.pmod(F.xxhash64("rep"), F.lit(64)), [F.col("rep")], rank="at").withColumn("block", F.floor(F.col("at") / tile))
    counts = ranked.groupBy("cluster").agg(F.max("block").alias("last"))
    others = F.explode(F.sequence(F.lit(0), F.col("last")))
    placed = cut(ranked.join(counts, "cluster").select("rep", "block", others.alias("other")).select("rep", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")))
    parts = fill(placed.count(), 2_000)
    pairs = sets.join(placed, "rep").withColumn("part", F.pmod(F.xxhash64("cluster", "a", "b"), F.lit(parts)))
    found = cut(pairs.groupBy("part").applyInArrow(_verify(similarity), "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    least = smallest_of_components(component_roots(found, "rep", "root"), classes.select("rep", F.col("first").alias("value")))
    judged = cut(
        classes.join(links, "rep", "left").join(least, "rep", "left")
        .select("wa", "wb", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("value", "first").alias("least"))
    )
    worded = sketched.drop("tokens").join(judged, ["wa", "wb"]).select("doc_id", F.col("least.doc_id").alias("class_id"), "n_links", (F.col("row") == F.col("least.row")).alias("kept"), "row_a", "row_b")
    # Rows without words were not sketched.
    none = keyed.where(~F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False)))
    return worded.unionByName(none.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"), "row_a", "row_b"))
