"""Repeated passages: what the word-window and the byte-string operators share.

Rows hash by doc_id and text to chunks of a few MB, so neither a null nor a repeated doc_id is one
task's work; one shuffle of the texts serves all three visits to a chunk.

1. A chunk names its anchors, a sample of its short spans such that any long match holds an anchor
   in both places. Each chunk sends each anchor's fingerprint once, with how often it counts, so a
   passage in a third of all documents costs one fingerprint a chunk. Fingerprints meet by hash;
   those that count more than once go back to their chunks, apart the crowded ones.
2. A chunk sends what lies around its repeated anchors, again once per chunk. Equal spans meet and
   it is settled which come earlier elsewhere.
3. A chunk applies what came back to its documents.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.rolling import TIE, ordered, pack
from emberline.runtime import fill

#: Bits of a fingerprint that travel; the bucket adds its own.
FP_BITS = 40
_CHUNK = "__repeat_chunk"
_BLOB = "bucket long, chunk long, kind int, blob binary"


def as_bytes(values: np.ndarray) -> bytes:
    """The low FP_BITS of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : FP_BITS // 8]).tobytes()


def from_bytes(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) * 8 // FP_BITS, 8), np.uint8)
    wide[:, : FP_BITS // 8] = np.frombuffer(blob, np.uint8).reshape(-1, FP_BITS // 8)
    return wide.reshape(-1).view("<u8")


def narrow(fps: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and travelling bits of 64-bit fingerprints."""
    return (fps >> np.uint64(FP_BITS)) % np.uint64(buckets), fps & np.uint64((1 << FP_BITS) - 1)


def by_bucket(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by bucket, and the bounds of each bucket in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=bucket.dtype))


def blobs(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.table({"bucket": pa.array(cols[0], pa.int64()), "chunk": pa.array(cols[1], pa.int64()), "kind": pa.array(cols[2], pa.int32()), "blob": pa.array(cols[3], pa.binary())})


def _parts(table: pa.Table) -> tuple[list, np.ndarray]:
    """The three arrays of every blob (fingerprints that count once, those that count more, the counts of these) and the blobs' chunks."""
    out = []
    for blob in table.column("blob").to_pylist():
        n, m = np.frombuffer(blob, "<u4", 2)
        lo, hi = 8 + int(n) * FP_BITS // 8, 8 + int(n + m) * FP_BITS // 8
        out.append((from_bytes(blob[8:lo]), from_bytes(blob[lo:hi]), np.frombuffer(blob, np.uint8, len(blob) - hi, hi)))
    return out, table.column("chunk").to_numpy()


def _blob(once: np.ndarray, more: np.ndarray, codes: np.ndarray | None = None) -> bytes:
    return pack(np.array([len(once), len(more)], "<u4")) + as_bytes(once) + as_bytes(more) + (b"" if codes is None else codes.tobytes())


def log_code(counts: np.ndarray) -> np.ndarray:
    """A count as one byte: c stands for 2**(c - 1) up to twice that."""
    return np.minimum(60, np.floor(np.log2(np.maximum(counts, 1))) + 1).astype(np.uint8)


def _send_anchors(anchors: Callable, buckets: int):
    def run(key, table):
        fps, counts = anchors(ordered(table))
        bucket, bits = narrow(fps, buckets)
        order, bounds = by_bucket(bucket, buckets)
        bits, codes = bits[order], log_code(counts[order])
        chunk, out = key[0].as_py(), []
        for b, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
            if hi > lo:
                own, code = bits[lo:hi], codes[lo:hi]
                out.append((b, chunk, 0, _blob(own[code == 1], own[code > 1], code[code > 1])))
        return blobs(out)

    return run


def _meet(crowd: int):
    """Fingerprints of a bucket that count more than once, back to their chunks; apart those that count ``crowd`` or more."""

    def run(key, table):
        parts, chunks = _parts(table)
        values = np.concatenate([np.concatenate(p[:2]) for p in parts])
        counts = np.concatenate([np.concatenate([np.ones(len(p[0]), np.int64), np.int64(1) << (p[2].astype(np.int64) - 1)]) for p in parts])
        chunk = np.repeat(chunks, [len(p[0]) + len(p[1]) for p in parts])
        order = np.argsort(values, kind="stable")
        values, counts, chunk = values[order], counts[order], chunk[order]
        at = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        total = np.repeat(np.add.reduceat(counts, at), np.diff(np.append(at, len(values))))
        again = total > 1
        values, total, chunk = values[again], total[again], chunk[again]
        order = np.argsort(chunk, kind="stable")
        values, total, chunk = values[order], total[order], chunk[order]
        names, at = np.unique(chunk, return_index=True)
        bucket, out = key[0].as_py(), []
        for c, lo, hi in zip(names, at, [*at[1:], len(chunk)]):
            own, full = values[lo:hi], total[lo:hi] >= crowd
            out.append((bucket, int(c), 0, _blob(np.unique(own[~full]), np.unique(own[full]))))
        return blobs(out)

    return run


class Hits:
    """The repeated anchors of a chunk, as membership tests."""

    def __init__(self, table: pa.Table, buckets: int) -> None:
        self.buckets = buckets
        parts, _ = _parts(table)
        tops = [np.uint64(k) << np.uint64(FP_BITS) for k in table.column("bucket").to_pylist()]
        whole = lambda i: np.concatenate([np.empty(0, np.uint64), *[p[i] | top for p, top in zip(parts, tops)]])
        self.full = np.sort(whole(1))
        self.known = np.sort(np.concatenate([whole(0), self.full]))

    def _in(self, known: np.ndarray, fps: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(fps), bool)
        bucket, bits = narrow(fps, self.buckets)
        want = bits | (bucket << np.uint64(FP_BITS))
        return known[np.minimum(np.searchsorted(known, want), len(known) - 1)] == want

    def has(self, fps: np.ndarray) -> np.ndarray:
        """Which of the anchors are repeated."""
        return self._in(self.known, fps)

    def crowded(self, fps: np.ndarray) -> np.ndarray:
        """Which of the anchors count so often that what lies around them is settled apart."""
        return self._in(self.full, fps)


def judged_repeats(
    docs: DataFrame, anchors: Callable, send: Callable, settle: Callable, apply: Callable, schema: str, crowd: int = 1 << 62, chunk_bytes: int = 8 << 20, most_chunk_bytes: int = 128 << 20
) -> DataFrame:
    """Run the three visits.

    anchors(table) -> (distinct fingerprints, counts); send(chunk, table, hits, buckets) -> blob rows;
    settle(bucket, table of blobs) -> blob rows for chunks; apply(table, blobs) -> result table.
    Chunks and, slower, buckets grow with the corpus (to ``most_chunk_bytes`` and four times that), so
    that the rows between chunks and buckets stay few against what they carry.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = fill(total, min(most_chunk_bytes, max(chunk_bytes, total >> 12)))
    buckets = fill(total, min(4 * most_chunk_bytes, max(chunk_bytes, total >> 18)))
    tied = docs.withColumn(TIE, F.xxhash64("text"))
    texts = tied.withColumn(_CHUNK, F.pmod(F.xxhash64(F.col("doc_id").cast("long"), TIE), F.lit(chunks)))
    by_chunk = texts.groupBy(_CHUNK)
    sent = by_chunk.applyInArrow(_send_anchors(anchors, buckets), _BLOB)
    hits = sent.groupBy("bucket").applyInArrow(_meet(crowd), _BLOB)

    def second(key, left, right):
        return blobs(send(key[0].as_py(), ordered(left), Hits(right, buckets), buckets))

    def third(key, left, right):
        return apply(ordered(left).drop_columns([_CHUNK, TIE]), right)

    around = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(second, _BLOB)
    verdicts = around.groupBy("bucket").applyInArrow(settle, _BLOB)
    return by_chunk.cogroup(verdicts.groupBy("chunk")).applyInArrow(third, schema)
