"""Repeated word windows, found through difference-cover anchors.

Positions 0, 1 and 3 modulo 7 are a difference cover: for any two positions there is a shift below
7 that takes both to cover positions. Anchors are the 7-word spans at cover positions only; two
equal 13-word windows therefore share an aligned anchor. Around anchors that some other document
has too, whole windows are named by two hashes of their bytes (96 bits), and a word is removed if it
lies in a window whose name also starts in a document with a smaller id.

Windows are judged on the input. Null texts have no words; texts below 13 words lose none; windows
never cross documents; rows that repeat a doc_id are one document for the comparison of ids (neither
is smaller) and each gives a row; a null doc_id is smaller than any other; input columns named like
a result column are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emberline.llm.repeats import Hits, by_bucket, judged_repeats
from emberline.llm.rolling import Spans, doc_order, pack, slices, unpack, word_bounds, word_hashes

PERIOD, COVER = 7, (0, 1, 3)


class _Windows:
    """The words of a slice, their places in their documents, anchors and windows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int) -> None:
        self.window, self.span = window, window - PERIOD + 1
        self.starts, self.ends, self.doc = word_bounds(data, offsets)
        n = np.bincount(self.doc, minlength=len(offsets) - 1)
        begin = np.concatenate([[0], np.cumsum(n)])
        self.place = np.arange(len(self.doc)) - begin[self.doc]
        self.left = n[self.doc] - self.place
        self.n_words, self.begin = n, begin
        self.data = data
        self.spans = Spans(word_hashes(data, self.starts, self.ends))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(np.isin(self.place % PERIOD, COVER) & (self.left >= self.span) & (self.n_words[self.doc] >= self.window))
        return at, self.spans.at(at, at + self.span)

    def near(self, hit: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold one of the anchors at ``hit``."""
        mark = np.zeros(len(self.doc) + self.window + 1, np.int32)
        mark[hit + 1] = 1
        np.cumsum(mark, out=mark)
        whole = np.flatnonzero(self.left >= self.window)
        return whole[mark[whole + PERIOD] > mark[whole]]

    def keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits that name the windows that start at ``at``; the last 32 come from the bytes by other primes."""
        second = Spans(word_hashes(self.data, self.starts, self.ends, second=True), second=True)
        return self.spans.at(at, at + self.window), second.at(at, at + self.window).astype(np.uint32)


def _anchors(window: int):
    def run(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        names, fps, owners = doc_order(table), [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for row, data, offsets in slices(table.column("text")):
            w = _Windows(data, offsets, window)
            at, fp = w.anchors()
            fps.append(fp)
            owners.append(names[row + w.doc[at]])
        fps, owners = np.concatenate(fps), np.concatenate(owners)
        order = np.lexsort((owners, fps))
        fps, owners = fps[order], owners[order]
        new = np.ones(len(fps), bool)
        new[1:] = fps[1:] != fps[:-1]
        at = np.flatnonzero(new)
        other = np.zeros(len(fps), np.int64)
        other[1:] = (owners[1:] != owners[:-1]) & ~new[1:]
        # Counts twice if two documents of the chunk have it; inside one document alone it is no repeat.
        return fps[at], 1 + np.minimum(1, np.add.reduceat(other, at)) if len(at) else np.empty(0, np.int64)

    return run


def _send(window: int):
    def run(chunk: int, table: pa.Table, hits: Hits, buckets: int) -> list:
        names = doc_order(table)
        found: list[list] = [[np.empty(0, k)] for k in (np.uint64, np.uint32, np.int64)]
        for row, data, offsets in slices(table.column("text")):
            w = _Windows(data, offsets, window)
            at, fp = w.anchors()
            near = w.near(at[hits.has(fp)])
            for out, values in zip(found, (*w.keys(near), names[row + w.doc[near]])):
                out.append(values)
        a, b, doc = (np.concatenate(x) for x in found)
        # Of each window the smallest and, if another document of the chunk has it, the largest id.
        order = np.lexsort((doc, b, a))
        a, b, doc = a[order], b[order], doc[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        last = np.ones(len(a), bool)
        last[:-1] = new[1:]
        first_doc = doc[new][np.cumsum(new) - 1] if len(a) else doc
        keep = new | (last & (doc > first_doc))
        a, b, doc = a[keep], b[keep], doc[keep]
        order, bounds = by_bucket(a % np.uint64(buckets), buckets)
        a, b, doc = a[order], b[order], doc[order]
        return [(k, chunk, 0, pack(a[lo:hi], doc[lo:hi], b[lo:hi])) for k, (lo, hi) in enumerate(zip(bounds, bounds[1:])) if hi > lo]

    return run


def _settle(key, table):
    from emberline.llm.repeats import blobs

    parts = [unpack(x, "<u8", "<i8", "<u4") for x in table.column("blob").to_pylist()]
    a, doc, b = (np.concatenate([p[i] for p in parts]) for i in range(3))
    chunk = np.repeat(table.column("chunk").to_numpy(), [len(p[0]) for p in parts])
    order = np.lexsort((doc, b, a))
    a, b, doc, chunk = a[order], b[order], doc[order], chunk[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = doc[new][np.cumsum(new) - 1]
    late = doc > least
    a, b, least, chunk = a[late], b[late], least[late], chunk[late]
    order = np.argsort(chunk, kind="stable")
    a, b, least, chunk = a[order], b[order], least[order], chunk[order]
    names, at = np.unique(chunk, return_index=True)
    bucket = key[0].as_py()
    return blobs([(bucket, int(c), 0, pack(a[lo:hi], least[lo:hi], b[lo:hi])) for c, lo, hi in zip(names, at, [*at[1:], len(a)])])


def _apply(window: int, names_out: list[str], with_text: bool):
    def run(table: pa.Table, verdicts: pa.Table) -> pa.Table:
        parts = [unpack(x, "<u8", "<i8", "<u4") for x in verdicts.column("blob").to_pylist()]
        a, least, b = (np.concatenate([p[i] for p in parts] or [np.empty(0, k)]) for i, k in enumerate(("<u8", "<i8", "<u4")))
        order = np.lexsort((b, a))
        a, least, b = a[order], least[order], b[order]
        ids = doc_order(table)
        words, removed, digests, kept_texts = [], [], [], []
        for row, data, offsets in slices(table.column("text")):
            w = _Windows(data, offsets, window)
            gone = np.zeros(len(w.doc) + 1, np.int32)
            if len(a):
                whole = np.flatnonzero(w.left >= window)
                first = w.spans.at(whole, whole + window)
                lo = np.searchsorted(a, first)
                maybe = a[np.minimum(lo, len(a) - 1)] == first
                whole, lo = whole[maybe], lo[maybe]
                first, second = w.keys(whole)
                late = np.zeros(len(whole), bool)
                step = lo.copy()
                open_ = np.arange(len(whole))
                while len(open_):  # almost always once: windows that share the first 64 bits
                    j = step[open_]
                    open_, j = open_[j < len(a)], j[j < len(a)]
                    same = a[j] == first[open_]
                    open_, j = open_[same], j[same]
                    late[open_[(b[j] == second[open_]) & (least[j] < ids[row + w.doc[whole[open_]]])]] = True
                    step[open_] += 1
                at = whole[late]
                np.add.at(gone, at, 1)
                np.add.at(gone, at + window, -1)
            gone = np.cumsum(gone)[:-1] > 0
            lost = np.bincount(w.doc[gone], minlength=len(offsets) - 1)
            raw = data.tobytes()
            for i in range(len(offsets) - 1):
                parts_of = raw[offsets[i] : offsets[i + 1]].split()
                if lost[i]:
                    keep = ~gone[w.begin[i] : w.begin[i + 1]]
                    parts_of = [p for p, k in zip(parts_of, keep.tolist()) if k]
                text = b" ".join(parts_of)
                digests.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    kept_texts.append(text)
            words += w.n_words.tolist()
            removed += lost.tolist()
        new = {"n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        if with_text:
            new["kept_text"] = pa.array(kept_texts, pa.binary()).cast(pa.string())
        return pa.table({n: new[n] if n in new else table.column(n) for n in names_out})

    return run


def remove_repeated_windows(docs: DataFrame, window: int = 13, with_text: bool = True) -> DataFrame:
    """``docs`` plus n_words, n_removed, kept_sha256 and, with ``with_text``, kept_text (words joined by one space)."""
    if window < 2 * PERIOD - 1:
        raise ValueError(f"a window has at least {2 * PERIOD - 1} words")
    made = {"n_words": "long", "n_removed": "long", "kept_sha256": "string"} | ({"kept_text": "string"} if with_text else {})
    base = docs.select(*[c for c in docs.columns if c not in made])
    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields} | made
    return judged_repeats(base, _anchors(window), _send(window), _settle, _apply(window, list(kinds), with_text), ", ".join(f"`{n}` {k}" for n, k in kinds.items()))
