"""Spelling variants by dense prefix-suffix tiling.

Two words differ by one inserted, deleted or replaced code point exactly if their common prefix and
their common suffix together reach the longer length less one. One of the two then reaches half of
it, so words meet in groups by a half: once under their own length, once as the shorter of the next
length. Within a group the words are rows of padded code-point matrices, and blocks of rows are
compared with blocks of rows. Groups above a tile are cut in tiles that meet pairwise.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.runtime import cut, fill, store

RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a tile, rows of a task, and matrix cells that are compared at once.
TILE, TASK, CELLS = 1024, 8192, 1 << 23
_FOUND = "word string, near long, best long, form string"


def _noised(run: Column, doc_id: Column, every: int) -> Column:
    """A run less the code point that its checksum with the document's id marks, where ``every`` divides that."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def count_words(docs: DataFrame, shortest: int = 6, least: int = 5, every: int = 199) -> DataFrame:
    """(word, n): the words of at least ``shortest`` code points that occur ``least`` times over all texts."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= shortest)
    words = runs.select(_noised(F.translate("run", _UPPER, _LOWER), F.col("doc_id"), every).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _groups(words: DataFrame) -> DataFrame:
    """Each word under each half of its own length and of the next."""
    size = F.length("word")
    tagged = words.withColumn("longer", F.explode(F.array(size, size + 1))).withColumn("front", F.explode(F.array(F.lit(True), F.lit(False))))
    half = F.floor(F.col("longer") / 2).cast("int")
    part = F.when(F.col("front"), F.substring("word", F.lit(1), half)).otherwise(F.substring("word", size - half + 1, half))
    return tagged.withColumn("part", part)


def _tiled(groups: DataFrame, tile: int) -> DataFrame:
    """Rows with the pair of tiles in which they are compared; a group of up to ``tile`` rows has one."""
    key = ["longer", "front", "part"]
    crowded = groups.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
    tiles = F.ceil(F.col("rows") / tile).cast("int")
    placed = groups.join(crowded, key).withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return pairs.select(*key, "word", "n", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))


def matrices(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of one byte a code point as zero-padded rows, from the front and from the back."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    filled = np.arange(width) < lens[:, None]
    front, back = np.zeros((2, len(words), width), np.uint8)
    front[filled] = np.frombuffer(b"".join(words), np.uint8)
    back[filled] = np.frombuffer(b"".join(w[::-1] for w in words), np.uint8)
    return front, back


def _lead(same: np.ndarray) -> np.ndarray:
    """How many leading entries are true."""
    return np.where(same.all(axis=-1), same.shape[-1], np.argmin(same, axis=-1))


def near_pairs(lens: np.ndarray, front: np.ndarray, back: np.ndarray, left: np.ndarray, right: np.ndarray, longer: int, by_front: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows from two blocks that are one edit apart, longer one of length ``longer``; pairs that share the front half belong to the front."""
    p = _lead(front[left][:, None, :] == front[right][None, :, :])
    s = _lead(back[left][:, None, :] == back[right][None, :, :])
    short = np.minimum(lens[left][:, None], lens[right][None, :])
    p, s = np.minimum(p, short), np.minimum(s, short)
    near = (p + s >= longer - 1) & (np.maximum(lens[left][:, None], lens[right][None, :]) == longer) & (left[:, None] != right[None, :])
    if not by_front:
        near &= p < longer // 2
    i, j = np.nonzero(near)
    return left[i], right[j]


def _compare(key, table):
    table = table.sort_by([(c, "ascending") for c in ("longer", "front", "part", "a", "b", "own")])
    words = [w.encode("latin-1") for w in table["word"].to_pylist()]
    spelled, n = table["word"].combine_chunks(), table["n"].to_numpy()
    lens = np.fromiter(map(len, words), np.int64, len(words))
    longer, front_keys, own, a, b = (table[c].to_numpy(zero_copy_only=False) for c in ("longer", "front", "own", "a", "b"))
    part = table["part"].combine_chunks().dictionary_encode().indices.to_numpy()
    step = lambda x: np.append(True, x[1:] != x[:-1])
    bounds = np.append(np.flatnonzero(step(longer) | step(front_keys) | step(part) | step(a) | step(b)), len(words))
    lefts, rights = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for lo, hi in zip(bounds, bounds[1:]):
        if hi - lo < 2:
            continue
        width = int(longer[lo])
        front, back = matrices(words[lo:hi], width)
        rows = np.arange(hi - lo)
        two = a[lo] != b[lo]
        left, right = (rows[own[lo:hi] == a[lo]], rows[own[lo:hi] == b[lo]]) if two else (rows, rows)
        down = max(1, min(len(right), CELLS // width))
        for x, y in itertools.product(range(0, len(left), max(1, CELLS // (width * down))), range(0, len(right), down)):
            i, j = near_pairs(lens[lo:hi], front, back, left[x : x + max(1, CELLS // (width * down))], right[y : y + down], width, bool(front_keys[lo]))
            lefts += [i + lo, j + lo] if two else [i + lo]
            rights += [j + lo, i + lo] if two else [j + lo]
    i, j = np.concatenate(lefts), np.concatenate(rights)
    found = pa.table({"word": spelled.take(pa.array(i)), "n": -n[j], "form": spelled.take(pa.array(j))})
    # Of each word: its links here, and the near word of largest count, the smallest of equal ones.
    found = found.sort_by([("word", "ascending"), ("n", "ascending"), ("form", "ascending")])
    best = found.group_by("word", use_threads=False).aggregate([("n", "count"), ("n", "first"), ("form", "first")])
    return pa.table({"word": best["word"], "near": best["n_count"], "best": best["n_first"], "form": best["form_first"]})


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, n_near, best, best_n) of the words of (word, n) that have a word one edit away: how many, and the one of largest n."""
    placed = store(_tiled(_groups(words), tile))
    tasks = fill(placed.count(), TASK)
    dealt = placed.groupBy(F.pmod(F.xxhash64("longer", "front", "part", "a", "b"), F.lit(tasks)).alias("task"))
    found = dealt.applyInArrow(_compare, _FOUND).groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("best", "form")).alias("first"))
    return found.select("word", "n_near", F.col("first.form").alias("best"), (-F.col("first.best")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer jumping over (word, form); each step's count is a multiple of the one before, so paths are short."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        jump = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(at.join(jump, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, shortest: int = 6, least: int = 5, every: int = 199, times: int = 5, tile: int = TILE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of at least ``shortest`` code points and ``least`` occurrences.

    A word's form is its near word of largest n (ties: the smallest), if that has ``times`` its own n;
    its root is where forms lead. A null text has no words; a null doc_id is written as nothing in the
    checksum; repeated rows count as often as they stand there; runs may be of any length. A table
    without such words gives no rows. Other columns, whatever they are called, are not looked at.
    """
    words = store(count_words(docs, shortest, least, every))
    near = store(near_words(words, tile))
    joined = words.join(near, "word", "left")
    has = F.col("best_n") >= F.col("n") * times
    forms = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"))
    rooted = forms.join(_roots(forms.where(F.col("form").isNotNull())), "word", "left")
    return rooted.withColumn("root", F.coalesce("root", "word"))
