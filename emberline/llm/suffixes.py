"""Repeated byte strings, removed by longest-previous-factor arrays.

Only suffixes near a repeated anchor are sorted. Anchors are minimizers: of every 51 adjacent
50-byte spans the one of least hash, so any two equal 100-byte strings share theirs. All 100-byte
strings with one minimizer occurrence lie in one run; runs whose minimizer repeats go, with their
bytes, to the minimizer's bucket. There equal runs collapse on the earliest, and the suffixes of
what differs are put in order (prefix doubling), with the common prefix of each two neighbours. The
previous and the next entry of smaller position then give each suffix its longest earlier match;
where that is 100 bytes or more, the string is a later copy.

A minimizer at the edge of a very common passage has a different run in every document. Where a
minimizer counts ``CROWD`` runs or more that differ, its runs are cut into their 100-byte strings,
each chunk names each string once (128 bits), and names meet by hash instead: no task gets more of
them than its share. A group of equal strings has one previous factor, its first string.

"Earlier" is a smaller doc_id (null first), or an earlier start in the same document; rows that repeat
a doc_id order by a hash of their text. Strings are judged on the input and never cross documents.
Null texts are empty; texts below 100 bytes lose none; input columns named like a result column are
replaced; an empty table gives no rows. A task holds a chunk of documents, so its memory follows the
longest one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emberline.llm.repeats import Hits, blobs, by_bucket, judged_repeats
from emberline.llm.rolling import TIE, Spans, byte_values, doc_order, pack, scramble, slices, unpack

#: Runs that differ, from which on a minimizer's strings are settled by name.
CROWD = 4096
#: Most string starts of a run, and bytes of runs that are sorted at once.
MOST, BATCH = 1024, 1 << 20


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over each ``width`` adjacent values, by doubling."""
    now, span = values, 1
    while span * 2 <= width:
        now = pick(now[:-span], now[span:])
        span *= 2
    rest = width - span
    return pick(now[: len(now) - rest], now[rest:]) if rest else now


def _each(starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start, start + 1, .. of ``n`` positions per entry, and the entry of each."""
    row = np.repeat(np.arange(len(starts)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + starts[row], row


class _Runs:
    """Minimizers of a slice, and the runs of string starts that share one."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int) -> None:
        self.length, self.gram = length, length // 2
        self.width = length - self.gram + 1
        self.data, self.offsets = data, offsets
        n = len(data)
        self.spans = Spans(byte_values(data))
        empty = np.empty(0, np.int64)
        self.at, self.fp, self.start, self.end, self.key = empty, np.empty(0, np.uint64), empty, empty, np.empty(0, np.uint64)
        if n < length:
            return
        hashes = self.spans.every(self.gram)
        least = _sliding(hashes, self.width, np.minimum)  # for string starts 0 .. n - length
        valid = np.zeros(n + 1, np.int32)
        sizes = np.diff(offsets)
        whole = sizes >= length
        valid[offsets[:-1][whole]] += 1
        np.add.at(valid, offsets[1:][whole] - length + 1, -1)
        self.valid = np.cumsum(valid)[: n - length + 1] > 0
        low = np.where(self.valid, least, np.uint64(0))
        edge = np.zeros(self.width - 1, np.uint64)
        reach = _sliding(np.concatenate([edge, low, edge]), self.width, np.maximum)
        self.at = np.flatnonzero((reach == hashes) & (reach > 0))
        self.fp = hashes[self.at]
        begins = np.zeros(n + 1, bool)
        begins[offsets] = True
        new = self.valid.copy()
        new[1:] &= ~self.valid[:-1] | (least[1:] != least[:-1]) | begins[1 : len(new)]
        self.start = np.flatnonzero(new)
        stop = np.flatnonzero(self.valid & ~np.concatenate([self.valid[1:] & ~new[1:], [False]]))
        self.end = stop + 1
        # A periodic text is one run of any length: cut into pieces, of which the equal ones collapse.
        at, row = _each(np.zeros(len(self.start), np.int64), -(-(self.end - self.start) // MOST))
        self.start, self.end = self.start[row] + at * MOST, np.minimum(self.end[row], self.start[row] + (at + 1) * MOST)
        self.key = least[self.start]

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1

    def own_repeats(self, pick: np.ndarray) -> np.ndarray:
        """Which of the runs hold their minimizer's span twice, so may repeat a string within themselves."""
        lo = np.searchsorted(self.at, self.start[pick])
        hi = np.searchsorted(self.at, self.end[pick] - 1 + self.width)
        n = hi - lo
        row = np.repeat(np.arange(len(pick)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[row]
        return np.bincount(row, self.fp[inside] == self.key[pick][row], len(pick)) > 1


def _anchors(length: int):
    def run(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The minimizers of a chunk; each counts the runs that differ, twice if it only occurs twice."""
        fps, keys, named = ([np.empty(0, np.uint64)] for _ in range(3))
        for _, data, offsets in slices(table.column("text")):
            r = _Runs(data, offsets, length)
            fps.append(r.fp)
            keys.append(r.key)
            if len(r.start):
                named.append(scramble(r.key) ^ r.spans.at(r.start, r.end - 1 + length))
        values, n = np.unique(np.concatenate(fps), return_counts=True)
        keys = np.concatenate(keys)
        _, first = np.unique(np.concatenate(named), return_index=True)
        runs, differ = np.unique(keys[first], return_counts=True)
        counts = np.minimum(n, 2)
        at = np.searchsorted(values, runs)
        counts[at] = np.maximum(counts[at], differ)
        return values, counts

    return run


# Of a run: minimizer, bytes' hash, doc_id, text's hash, row, start, string bytes, own repeat. Of a named string: name (2), doc_id, text's hash, row, start.
_HEAD = ("<u8", "<u8", "<i8", "<i8", "<i8", "<i8", "<i4", "u1")
_NAME = ("<u8", "<u8", "<i8", "<i8", "<i8", "<i8")
RUNS, SETTLED, NAMES = 0, 1, 2


def _earliest(keys: list[np.ndarray], order_by: list[np.ndarray]) -> np.ndarray:
    """True for the first of each key in the given order."""
    order = np.lexsort([*order_by[::-1], *keys[::-1]])
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    out = np.zeros(len(order), bool)
    out[order[new]] = True
    return out


def _send(length: int):
    def run(chunk: int, table: pa.Table, hits: Hits, buckets: int) -> list:
        ids, ties = doc_order(table), table.column(TIE).to_numpy()
        heads: list[list] = [[np.empty(0, k)] for k in _HEAD]
        names: list[list] = [[np.empty(0, k)] for k in _NAME]
        texts: list[bytes] = []
        settled: list[list] = [[np.empty(0, np.int64)] for _ in range(3)]
        for row, data, offsets in slices(table.column("text")):
            r = _Runs(data, offsets, length)
            if not len(r.start):
                continue
            pick = np.flatnonzero(hits.has(r.key))
            full = hits.crowded(r.key[pick])
            if full.any():
                s, e = r.start[pick[full]], r.end[pick[full]]
                # Runs repeat much here: one of each goes on, the others' strings are known to be later.
                run_name = r.spans.at(s, e - 1 + length)
                first = _earliest([run_name, e - s], [s])
                d = r.doc(s)
                for out, v in zip(settled, (row + d, s - offsets[d], e - 1 + length - offsets[d])):
                    out.append(v[~first])
                at, _ = _each(s[first], (e - s)[first])
                other = Spans(byte_values(data), second=True)
                d = r.doc(at)
                for out, v in zip(names, (r.spans.at(at, at + length), other.at(at, at + length), ids[row + d], ties[row + d], row + d, at - offsets[d])):
                    out.append(v)
                pick = pick[~full]
            s, e = r.start[pick], r.end[pick] - 1 + length
            d = r.doc(s)
            own = r.own_repeats(pick)
            for out, v in zip(heads, (r.key[pick], r.spans.at(s, e), ids[row + d], ties[row + d], row + d, s - offsets[d], e - s, own)):
                out.append(v)
            raw = data.tobytes()
            texts += [raw[x:y] for x, y in zip(s.tolist(), e.tolist())]
        key, named, doc, tie, rows, start, size, own = (np.concatenate(h).astype(k) for h, k in zip(heads, _HEAD))
        first = _earliest([key, named, size], [rows, start])
        later = np.flatnonzero(~first)
        for o, v in zip(settled, (rows[later], start[later], (start + size)[later])):
            o.append(v)
        out = []
        first = np.flatnonzero(first)
        order, bounds = by_bucket(key[first] % np.uint64(buckets), buckets)
        for k, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
            if hi > lo:
                at = first[order[lo:hi]]
                head = pack(*(x[at] for x in (key, named, doc, tie, rows, start, size, own)))
                out.append((k, chunk, RUNS, len(at).to_bytes(8, "little") + head + b"".join([texts[i] for i in at])))
        columns = [np.concatenate(c).astype(k) for c, k in zip(names, _NAME)]
        first = _earliest(columns[:2], columns[4:])
        for o, v in zip(settled, (columns[4], columns[5], columns[5] + length)):
            o.append(v[~first])
        columns = [c[first] for c in columns]
        order, bounds = by_bucket(columns[0] % np.uint64(buckets), buckets)
        for k, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
            if hi > lo:
                out.append((k, chunk, NAMES, pack(*(c[order[lo:hi]] for c in columns))))
        done = [np.concatenate(c) for c in settled]
        return out + ([(chunk % buckets, chunk, SETTLED, pack(*done))] if len(done[0]) else [])

    return run


def suffix_order(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes of all texts by prefix doubling: their order, the text of each position, its room (bytes to the text's end), and the ranks.

    Texts are laid end to end with a separator below every byte; a position is a place in this row,
    so positions ascend with the texts. Ranks are (width, rank by the first ``width`` symbols).
    """
    sizes = np.array([len(t) for t in texts]) + 1
    ends = np.cumsum(sizes)
    n = int(ends[-1])
    symbols = np.zeros(n + 8, np.int64)
    body = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    symbols[:n] = body.astype(np.int64) + 1
    symbols[ends - 1] = 0
    text = np.repeat(np.arange(len(texts)), sizes)
    room = ends[text] - 1 - np.arange(n)
    key = np.zeros(n, np.int64)
    for i in range(7):  # seven symbols of nine bits
        key = (key << 9) | symbols[i : i + n]
    width, ranks = 7, [(1, symbols[:n])]
    while True:
        values, rank = np.unique(key, return_inverse=True)
        ranks.append((width, rank.astype(np.int32)))
        if width >= sizes.max() or len(values) == n:
            return np.argsort(rank, kind="stable"), text, room, ranks
        key = rank * np.int64(n + 1)
        key[: n - width] += rank[width:] + 1
        width *= 2


def common_prefixes(a: np.ndarray, b: np.ndarray, room: np.ndarray, ranks: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The longest common prefix of the suffixes at positions ``a`` and ``b``, ending with their texts."""
    most = np.minimum(room[a], room[b])
    common = np.zeros(len(a), np.int64)
    last = len(room) - 1
    for width, rank in [*ranks[:0:-1], *[ranks[0]] * 6]:
        open_ = common < most
        same = open_ & (rank[np.minimum(a + common, last)] == rank[np.minimum(b + common, last)])
        common += width * same
    return np.minimum(common, most)


def longest_previous_factors(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each entry of a suffix order, the longest match with a suffix of smaller position.

    ``common[r]`` is the common prefix of entries r - 1 and r. The stack holds entries of ascending
    position: below an entry lies its previous smaller one, and what pops it is its next smaller one.
    """
    factor = np.zeros(len(order), np.int64)
    stack: list[tuple[int, int, int]] = []
    for r, (position, height) in enumerate(zip([*order.tolist(), -1], [*common.tolist(), 0])):
        while stack and stack[-1][0] > position:
            _, entry, before = stack.pop()
            factor[entry] = max(before, height)
            height = min(before, height)
        stack.append((position, r, height))
    return factor


def later_copies(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of every string of ``length`` bytes that also starts in an earlier text, or earlier in its own."""
    order, text, room, ranks = suffix_order(texts)
    order = order[room[order] >= length]
    common = np.zeros(len(order) + 1, np.int64)
    if len(order):
        common[1:-1] = common_prefixes(order[:-1], order[1:], room, ranks)
    # An entry whose neighbours both share less cannot have a factor of this length.
    near = np.flatnonzero((common[:-1] >= length) | (common[1:] >= length))
    factor = longest_previous_factors(order[near], np.where(common[near] >= length, common[near], 0))
    at = np.sort(order[near][factor >= length])
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return text[at], at - begin[text[at]]


def _settle(length: int):
    def run(key, table):
        bucket = key[0].as_py()
        out: list = []
        heads: list[list] = [[np.empty(0, k)] for k in _HEAD]
        names: list[list] = [[np.empty(0, k)] for k in _NAME]
        chunk_of, name_chunk, texts = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
        for chunk, kind, blob in zip(table.column("chunk").to_pylist(), table.column("kind").to_pylist(), table.column("blob").to_pylist()):
            if kind == SETTLED:
                out.append((bucket, chunk, SETTLED, blob))
                continue
            if kind == NAMES:
                parts = unpack(blob, *_NAME)
                for h, p in zip(names, parts):
                    h.append(p)
                name_chunk.append(np.full(len(parts[0]), chunk))
                continue
            n = int.from_bytes(blob[:8], "little")
            width = sum(np.dtype(k).itemsize for k in _HEAD) * n
            parts = unpack(blob[8 : 8 + width], *_HEAD)
            for h, p in zip(heads, parts):
                h.append(p)
            chunk_of.append(np.full(n, chunk))
            ends = np.concatenate([[0], np.cumsum(parts[6], dtype=np.int64)]) + 8 + width
            texts += [blob[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
        a, b, doc, tie, rows, start = (np.concatenate(h) for h in names)
        chunks = np.concatenate(name_chunk)
        late = np.flatnonzero(~_earliest([a, b], [doc, tie, chunks, rows, start]))
        lo_hi: list[tuple[np.ndarray, ...]] = [(chunks[late], rows[late], start[late], start[late] + length)]
        fp, named, doc, tie, rows, start, size, own = (np.concatenate(h) for h in heads)
        chunks = np.concatenate(chunk_of)
        place = np.lexsort((start, rows, chunks, tie, doc))
        fp, named, rows, start, size, own, chunks = (x[place] for x in (fp, named, rows, start, size, own, chunks))
        first = _earliest([fp, named, size], [np.arange(len(fp))])
        later = np.flatnonzero(~first)
        lo_hi.append((chunks[later], rows[later], start[later], start[later] + size[later]))
        kept = np.flatnonzero(first)
        _, group, n = np.unique(fp[kept], return_inverse=True, return_counts=True)
        sort = kept[(n[group] > 1) | (own[kept] > 0)]
        # A batch of minimizers at a time, so that memory follows the batch; none has 2 * CROWD runs.
        by_fp = sort[np.argsort(fp[sort], kind="stable")]
        total, at = np.cumsum(size[by_fp], dtype=np.int64), 0
        while at < len(by_fp):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BATCH)))
            while to < len(by_fp) and fp[by_fp[to]] == fp[by_fp[to - 1]]:
                to += 1
            batch = np.sort(by_fp[at:to])
            text, offset = later_copies([texts[place[i]] for i in batch], length)
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (offset[1:] != offset[:-1] + 1)
            last = np.append(new[1:], True)[: len(text)]
            i = batch[text[new]]
            lo_hi.append((chunks[i], rows[i], start[i] + offset[new], start[i] + offset[last] + length))
            at = to
        chunks, rows, lo, hi = (np.concatenate([x[i] for x in lo_hi]) for i in range(4))
        order = np.argsort(chunks, kind="stable")
        chunks, rows, lo, hi = chunks[order], rows[order], lo[order], hi[order]
        named, at = np.unique(chunks, return_index=True)
        for c, x, y in zip(named, at, [*at[1:], len(chunks)]):
            out.append((bucket, int(c), SETTLED, pack(rows[x:y], lo[x:y].astype(np.int64), hi[x:y].astype(np.int64))))
        return blobs(out)

    return run


def _apply(length: int, names_out: list[str], text_name: str | None):
    def run(table: pa.Table, verdicts: pa.Table) -> pa.Table:
        parts = [unpack(x, "<i8", "<i8", "<i8") for x in verdicts.column("blob").to_pylist()]
        rows, lo, hi = (np.concatenate([p[i] for p in parts] or [np.empty(0, np.int64)]) for i in range(3))
        order = np.argsort(rows, kind="stable")
        rows, lo, hi = rows[order], lo[order], hi[order]
        sizes, removed, spans, digests, texts = [], [], [], [], []
        for row, data, offsets in slices(table.column("text")):
            a, b = np.searchsorted(rows, [row, row + len(offsets) - 1])
            shift = offsets[rows[a:b] - row]
            mark = np.zeros(len(data) + 1, np.int32)
            np.add.at(mark, lo[a:b] + shift, 1)
            np.add.at(mark, hi[a:b] + shift, -1)
            gone = np.cumsum(mark)[:-1] > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            starts = offsets[:-1][np.diff(offsets) > 0]
            begins[starts] = gone[starts]
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
            lost, many = total(gone), total(begins)
            raw = data.tobytes()
            for i in range(len(offsets) - 1):
                s, e = offsets[i], offsets[i + 1]
                kept = data[s:e][~gone[s:e]].tobytes() if lost[i] else raw[s:e]
                digests.append(hashlib.sha256(kept).hexdigest())
                if text_name:
                    texts.append(kept.decode("utf-8", "ignore") if lost[i] else kept.decode("utf-8"))
            sizes += np.diff(offsets).tolist()
            removed += lost.tolist()
            spans += many.tolist()
        new = {"n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        if text_name:
            new[text_name] = pa.array(texts, pa.string())
        return pa.table({n: new[n] if n in new else table.column(n) for n in names_out})

    return run


def remove_repeated_strings(docs: DataFrame, length: int = 100, text_name: str | None = "kept_text") -> DataFrame:
    """``docs`` plus n_bytes, n_removed, n_spans, kept_sha256 and, under ``text_name``, the remaining text.

    The remaining text leaves out the bytes of characters that were cut in two; the digest is over all remaining bytes.
    """
    made = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"} | ({text_name: "string"} if text_name else {})
    base = docs.select(*[c for c in docs.columns if c not in made or c == "text"])
    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields} | made
    schema = ", ".join(f"`{n}` {k}" for n, k in kinds.items())
    return judged_repeats(base, _anchors(length), _send(length), _settle(length), _apply(length, list(kinds), text_name), schema, CROWD)
