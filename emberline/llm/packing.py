"""Best-fit packing of token pieces into sequences, with large-item matching.

A document's ids and the end id are cut from the back into full sequences, so only its first piece
may be shorter. How pieces are packed depends on their lengths alone, so the plan is made on the
counts per length, at most ``capacity`` numbers whatever the corpus: pieces above a third of the
capacity pair at most twice per sequence, the longest unmatched with the longest that still fits
beside it; smaller pieces, longest first, go to the tightest gap that holds them. The plan is a
list of runs, "so many pieces of this length into these sequences at this offset", and each piece
finds its run by its rank among the pieces of its length.

Null texts are empty; an empty text is the end id alone; a text of any length is encoded whole and cut
(a task holds its ids); null and repeated doc_ids are packed row by row; other columns, clashing names
included, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.rolling import Spans, byte_values, separators, slices
from emberline.operators.ranking import blocked
from emberline.runtime import cut, spread, store

CAPACITY = 2048


#: Segments whose ids a worker keeps; of ids it keeps eight times as many.
MEMO = 1 << 21


def _segment_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts may be cut for a byte-level file: before an ASCII blank that follows no white space, and at each text's begin."""
    blank = separators(data)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    at = np.flatnonzero(blank[1:] & ~blank[:-1] & ~first[1:-1]) + 1
    one, two, three = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    # The last bytes of U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000.
    wide = (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three == 0xE1) & (two == 0x9A) & (one == 0x80) | (three == 0xE3) & (two == 0x80) & (one == 0x80)
    wide |= (three == 0xE2) & ((two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF)) | (two == 0x81) & (one == 0x9F))
    return np.sort(np.concatenate([at[~wide], offsets[:-1][np.diff(offsets) > 0]]), kind="stable")


class _Column:
    """An array that grows at its end."""

    def __init__(self, kind: str) -> None:
        self.size, self.room = 0, np.empty(1 << 10, kind)

    def add(self, values: np.ndarray) -> None:
        while self.size + len(values) > len(self.room):
            self.room = np.concatenate([self.room, np.empty_like(self.room)])
        self.room[self.size : self.size + len(values)] = values
        self.size += len(values)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.room[at]


class _Memo:
    """Ids of segments, found by a hash of their bytes and held against the bytes themselves."""

    def __init__(self) -> None:
        self.slots = np.full(1 << 12, -1, np.int32)
        self.name, self.first, self.count, self.begin, self.size = (_Column(k) for k in ("<u8", "<i8", "<i4", "<i8", "<i4"))
        self.ids, self.bytes = _Column("<u4"), _Column("<u1")

    def _place(self, name: np.ndarray, entry: np.ndarray) -> None:
        """Put entries with different names into free slots, each after those that its first ones hold."""
        slot = (name & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(entry):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entry[free]  # of several at one slot the last stays
            left = self.slots[slot] != entry
            entry, slot = entry[left], (slot[left] + 1) % len(self.slots)

    def find(self, name: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the segments of ``data`` by name (-1: none), and which of them hold the same bytes."""
        found, open_ = np.full(len(name), -1, np.int64), np.arange(len(name))
        slot = (name & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(open_):
            entry = self.slots[slot[open_]]
            hit = (entry >= 0) & (self.name[entry] == name[open_])
            found[open_[hit]] = entry[hit]
            open_ = open_[(entry >= 0) & ~hit]
            slot[open_] = (slot[open_] + 1) % len(self.slots)
        same = (found >= 0) & (self.size[found] == end - start)
        some = np.flatnonzero(same)
        size = end[some] - start[some]
        upto = np.concatenate([[0], np.cumsum(size)])
        each = np.arange(upto[-1])
        differ = self.bytes[np.repeat(self.begin[found[some]] - upto[:-1], size) + each] != data[np.repeat(start[some] - upto[:-1], size) + each]
        same[some[np.searchsorted(upto, np.flatnonzero(differ), "right") - 1]] = False
        return found, same

    def add(self, name: np.ndarray, segments: list[bytes], ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        """New segments of different names, and where each one's ids lie in ``ids``."""
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        entry = np.arange(self.name.size, self.name.size + len(name), dtype=np.int32)
        for column, values in ((self.first, first + self.ids.size), (self.begin, self.bytes.size + np.cumsum(size) - size), (self.name, name), (self.count, count), (self.size, size)):
            column.add(values)
        self.ids.add(ids)
        self.bytes.add(np.frombuffer(b"".join(segments), np.uint8))
        if 2 * self.name.size > len(self.slots):
            self.slots = np.full(1 << (4 * self.name.size).bit_length(), -1, np.int32)
            entry = np.arange(self.name.size, dtype=np.int32)
        self._place(self.name[entry], entry)


@functools.lru_cache(maxsize=1)
def load_encoder(path: str, most: int = MEMO) -> Callable[[list[str]], list[np.ndarray]]:
    """A function from texts to arrays of ids: the tokenizers library's own, without added specials.

    A byte-level file without normalizer never joins a visible character with the white space after
    it, so there a text is encoded in segments (white space, then what is visible). New segments are
    encoded laid end to end, and cut by the bytes that each id stands for; the ids of segments met
    before are found by their bytes, ``most`` and those of about a megabyte of text at most. Other files take whole
    texts. A worker process keeps its encoder from task to task.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has one task per core already
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids_of = lambda texts: [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    split = spec.get("pre_tokenizer") or {}
    apart = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    marks = [t for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"])]
    if not apart or marks or spec.get("normalizer") or spec.get("truncation") or spec.get("padding"):
        return ids_of
    # In a byte-level vocabulary a token has one character for each of its bytes.
    stands_for = {i: len(t) for t, i in spec["model"]["vocab"].items()} | {t["id"]: len(t["content"].encode()) for t in spec["added_tokens"]}
    width = np.zeros(max(stands_for) + 1, np.int64)
    width[list(stands_for)] = list(stands_for.values())
    state = [_Memo()]

    def learn(new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and each segment's place in them; segments that begin with a blank and end visibly are encoded in one go."""
        plain = np.array([s[0] in " \n\t\r" and not s[-1].isspace() for s in new], bool)
        joined, alone = np.flatnonzero(plain), np.flatnonzero(~plain)
        ends = np.cumsum([len(new[i].encode()) for i in joined.tolist()], dtype=np.int64)
        ids = ids_of(["".join([new[i] for i in joined.tolist()])])[0]
        reach = np.cumsum(width[ids])
        cuts = np.searchsorted(reach, ends) + 1
        if len(joined) and not np.array_equal(reach[cuts - 1], ends):
            raise ValueError("ids do not end where their segments end")
        own = ids_of([new[i] for i in alone.tolist()])
        stop = np.empty(len(new), np.int64)
        count = np.empty(len(new), np.int64)
        stop[joined], count[joined] = cuts, np.diff(cuts, prepend=0)
        count[alone] = [len(x) for x in own]
        stop[alone] = len(ids) + np.cumsum(count[alone])
        return np.concatenate([ids, *own]), stop - count, count

    def encode(texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for _, data, offsets in slices(pa.array(texts, pa.large_string())):
            memo = state[0]
            if memo.name.size > most or memo.ids.size > 8 * most or memo.bytes.size > 32 * most:
                memo = state[0] = _Memo()
            start = _segment_starts(data, offsets)
            end = np.append(start[1:], len(data))[: len(start)]
            name = Spans(byte_values(data)).at(start, end) ^ (end - start).astype(np.uint64)
            at, there = memo.find(name, data, start, end)
            if not there.all():
                miss = np.flatnonzero(at < 0)
                new = miss[np.unique(name[miss], return_index=True)[1]]
                raw = data.tobytes()
                segments = [raw[x:y] for x, y in zip(start[new].tolist(), end[new].tolist())]
                if segments:
                    memo.add(name[new], segments, *learn([x.decode() for x in segments]))
                at, there = memo.find(name, data, start, end)
                if not there.all():  # another segment has the name of one of these
                    raw_of = lambda i: raw[offsets[i] : offsets[i + 1]].decode()
                    out += ids_of([raw_of(i) for i in range(len(offsets) - 1)])
                    continue
            count = memo.count[at].astype(np.int64)
            total = np.concatenate([[0], np.cumsum(count)])
            ids = memo.ids[np.repeat(memo.first[at] - total[:-1], count) + np.arange(total[-1])]
            out += np.split(ids, total[np.searchsorted(start, offsets[1:-1])])
        return out

    return encode


def _pieces(path: str | None, end: int, capacity: int, keep_ids: bool, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode = load_encoder(path or public_tokenizers.path("byte_bpe_50k.json"), most)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []} | ({"ids": []} if keep_ids else {})
                for doc, ids in zip(some.column("doc_id").to_pylist(), encode([t or "" for t in some.column("text").to_pylist()])):
                    raw = np.append(ids, np.uint32(end)).astype("<u4", copy=False)
                    stop = len(raw) % capacity or capacity
                    start = piece = 0
                    while start < len(raw):
                        part = raw[start:stop]
                        out["doc_id"].append(doc)
                        out["piece"].append(piece)
                        out["start"].append(start)
                        out["length"].append(len(part))
                        out["ids_crc32"].append(zlib.crc32(part.tobytes()))
                        if keep_ids:
                            out["ids"].append(part.astype(np.int32))
                        start, stop, piece = stop, stop + capacity, piece + 1
                kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.list_(pa.int32())}
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds[c]) for c, v in out.items()], names=list(out))

    return run


def token_pieces(docs: DataFrame, path: str | None = None, end: int = 0, capacity: int = CAPACITY, keep_ids: bool = False, most: int = MEMO) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(path, end, capacity, keep_ids, most), schema)


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, how many, first sequence, offset) that place every piece.

    The pieces of a length with ranks first .. first + many - 1 go, one each, to the sequences
    from the first on, at that offset. The number of runs depends on the lengths, not on the counts.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    keys: list[int] = []
    used, sequences = dict.fromkeys(counts, 0), 0

    def leave(gap: int, first: int, many: int) -> None:
        if gap > 0:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(keys, gap)
            gaps[gap].append((first, many))

    def place(length: int, many: int, first: int, offset: int) -> None:
        runs.append((length, used[length], many, first, offset))
        used[length] += many

    left = {n: c for n, c in counts.items() if c > 0}
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        b = next((n for n in reversed(large) if a + n <= capacity and (n != a or left[a] > 1)), None)
        if b is None:
            many = left[a]
            place(a, many, sequences, 0)
            leave(capacity - a, sequences, many)
            left[a] = 0
        elif a == b:
            many = left[a] // 2
            place(a, many, sequences, 0)
            place(a, many, sequences, a)
            leave(capacity - 2 * a, sequences, many)
            left[a] -= 2 * many
        else:
            many = min(left[a], left[b])
            place(a, many, sequences, 0)
            place(b, many, sequences, a)
            leave(capacity - a - b, sequences, many)
            left[a] -= many
            left[b] -= many
        sequences += many
        large = [n for n in large if left[n]]
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(keys, n)
            if at == len(keys):
                per = capacity // n
                many, rest = divmod(left[n], per)
                for i in range(per):
                    if many:
                        place(n, many, sequences, i * n)
                if many:
                    leave(capacity - per * n, sequences, many)
                if rest:
                    for i in range(rest):
                        place(n, 1, sequences + many, i * n)
                    leave(capacity - rest * n, sequences + many, 1)
                sequences += many + bool(rest)
                left[n] = 0
                break
            gap = keys[at]
            first, many = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], keys[at]
            take = min(many, left[n])
            if take < many:
                leave(gap, first + take, many - take)
            place(n, take, first, capacity - gap)
            leave(gap - n, first, take)
            left[n] -= take
    return runs


def _assign(runs: list[tuple[int, int, int, int, int]]):
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = table[:, 0] * (1 << 48) + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(base, length * (1 << 48) + rank, "right") - 1
            names = [n for n in batch.schema.names if n != "rank"]
            sequence = table[at, 3] + rank - table[at, 1]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sequence), pa.array(table[at, 4])], names=[*names, "sequence_id", "offset"])

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with doc_id, piece, length, ids_crc32) plus sequence_id and offset. ``pieces`` is read three times: cut it first."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # a number per length up to capacity
    runs = plan_runs(counts, capacity)
    parts = spread(sum(counts.values()))
    ranked = blocked(pieces, ["length"], F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)), [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")])
    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema.fields if f.name != "rank"}
    return ranked.select(*kinds, "rank").mapInArrow(_assign(runs), ", ".join(f"`{n}` {k}" for n, k in kinds.items()) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, end: int = 0, capacity: int = CAPACITY, keep_ids: bool = True, most: int = MEMO) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset), one row per piece."""
    pieces = token_pieces(docs, path, end, capacity, keep_ids, most)
    return pack_pieces(store(pieces) if keep_ids else cut(pieces), capacity)
