"""Phrase collocations by prefix-free parsing.

Words open chunks by their content, so copied text is cut at the same places wherever it stands. A
chunk owns the words up to the next opening word and overlaps the next chunk by as many words as a
phrase can reach over; a phrase counts in the chunk that owns its first word, hence once. Distinct
chunks with their frequencies are the dictionary, and phrases are counted inside it, weighted.

1. Tasks parse their texts and combine equal chunks, then ship them to dictionary parts by content.
2. A part sends a fingerprint and a count of each of its words and word pairs, once. Buckets sum
   them and send back those that reach ``least``; a collision can only let too many through.
3. A part spells out its frequent words and pairs and the longer phrases all of whose pairs are
   frequent; what is summed by spelling is exact.

Everything after that is joins on the frequent phrases.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.repeats import Hits, as_bytes, blobs, by_bucket, from_bytes, narrow
from emberline.llm.rolling import pack, scramble, slices, unpack
from emberline.runtime import fill, store

_SPACE, _BREAK = 32, 10
#: Bytes as the parser sees them: A-Z lower-cased, every piece end a break, the tab a space.
_SEEN = np.arange(256, dtype=np.uint8)
_SEEN[ord("A") : ord("Z") + 1] += 32
_SEEN[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = _BREAK
_SEEN[9] = _SPACE
#: About how many words a chunk owns, and the bytes of chunks that a task combines at once.
PERIOD, COMBINE = 16, 8 << 20
_BLOB = "bucket long, chunk long, kind int, blob binary"
_DICTIONARY = "part long, langs array<string>, marks binary, data binary"
_COUNTS = "lang string, phrase string, words int, f long"


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts and ends of words in seen bytes, their text's number, and the index of the last word of each one's piece."""
    gap, bound = (data == _SPACE) | (data == _BREAK), np.zeros(len(data) + 1, bool)
    bound[offsets] = True
    before, after = np.append(True, gap[:-1]), np.append(gap[1:], True)
    starts = np.flatnonzero(~gap & (before | bound[:-1]))
    ends = np.flatnonzero(~gap & (after | bound[1:])) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    breaks = np.searchsorted(np.flatnonzero(data == _BREAK), starts)
    last = np.flatnonzero(np.append((breaks[1:] != breaks[:-1]) | (text[1:] != text[:-1]), True)) if len(starts) else np.empty(0, np.int64)
    return starts, ends, text, last[np.searchsorted(last, np.arange(len(starts)))]


def _gather(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """The byte ranges, which may overlap, as values."""
    offsets = np.concatenate([[0], np.cumsum(hi - lo)]).astype(np.int64)
    at = np.repeat(lo - offsets[:-1], hi - lo) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of values, laid end to end, and their offsets."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number by each word's length and first and last eight bytes; words may share one, which only shapes chunks."""
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    size = np.minimum(ends - starts, 8).astype(np.uint64)
    within = ~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * size)
    return scramble(eight[starts] & within ^ scramble((eight[np.maximum(starts, ends - 8)] & within) + (ends - starts).astype(np.uint64)))


def _numbered(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal keys by first sight, and each number's first place."""
    number = keys.dictionary_encode().indices.to_numpy()
    first = np.empty(number.max() + 1 if len(number) else 0, np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    return number, first


def parse(data: np.ndarray, offsets: np.ndarray, reach: int, period: int = PERIOD) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(chunks, words each holds beyond its own, their texts' numbers, hashes of their words) of a slice of texts."""
    data = _SEEN[data]
    starts, ends, text, last = _words(data, offsets)
    if not len(starts):
        return pa.array([], pa.large_binary()), *(np.empty(0, t) for t in (np.uint8, np.int64, np.uint64))
    named = _word_names(data, starts, ends)
    opens = np.flatnonzero((named % np.uint64(period) == 0) | np.append(True, text[1:] != text[:-1]))
    own = np.append(opens[1:], len(starts)) - 1
    tail = np.minimum(last[own] - own, reach)
    return _gather(data, starts[opens], ends[own + tail]), tail.astype(np.uint8), text[opens], scramble(np.add.reduceat(named, opens))


def _combined(chunks: pa.LargeBinaryArray, tail: np.ndarray, lang: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct (chunk, tail, lang), and the sum of its n."""
    same, _ = _numbered(chunks)
    span = (int(lang.max()) + 1 if len(lang) else 1) << 8
    number, first = _numbered(pa.array(same.astype(np.int64) * span + (lang << 8) + tail))
    return first, np.rint(np.bincount(number, n, len(first))).astype(np.int64)


def _parse_texts(reach: int, parts: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            chunks = pa.concat_arrays([h[0] for h in held])
            tail, lang, part = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            first, n = _combined(chunks, tail, lang, np.ones(len(tail), np.int64))
            order = np.argsort(part[first], kind="stable")
            first, n, names, rows = first[order], n[order], list(langs), []
            data, ends = _bytes(chunks.take(pa.array(first)))
            at = np.flatnonzero(np.append(True, part[first][1:] != part[first][:-1]))
            for lo, hi in zip(at, [*at[1:], len(first)]):
                code, own = np.unique(lang[first[lo:hi]], return_inverse=True)
                marks = pack(np.diff(ends[lo : hi + 1]).astype("<u4"), n[lo:hi].astype("<i8"), own.astype("<u4"), tail[first[lo:hi]])
                rows.append((int(part[first[lo]]), [names[c] for c in code], marks, data[ends[lo] : ends[hi]].tobytes()))
            kinds = (pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["part", "langs", "marks", "data"])

        for batch in batches:
            own = np.array([langs.setdefault(v, len(langs)) for v in batch.column("lang").to_pylist()], np.int64)
            for at in range(0, batch.num_rows, 256):
                for row, data, offsets in slices(batch.column("text").slice(at, 256)):
                    chunks, tail, text, named = parse(data, offsets, reach)
                    if len(chunks):
                        held.append((chunks, tail, own[at + row + text], (named % np.uint64(parts)).astype(np.int64)))
                        size += chunks.nbytes
                    if size > COMBINE:
                        yield out()
                        held.clear()
                        size = 0
                        pa.default_memory_pool().release_unused()
        if held:
            yield out()

    return run


class Dictionary:
    """The distinct chunks of a part, and exact numbers for the words and pairs in them."""

    def __init__(self, table: pa.Table) -> None:
        self.langs: list[str] = []
        known: dict[str, int] = {}
        chunks, columns = [], ([], [], [])
        for names, marks, data in zip(table["langs"].to_pylist(), table["marks"].to_pylist(), table["data"].to_pylist()):
            lens, n, lang, tail = unpack(marks, "<u4", "<i8", "<u4", "<u1")
            code = np.array([known.setdefault(v, len(known)) for v in names], np.int64)
            offsets = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
            chunks.append(pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(data)]))
            for column, values in zip(columns, (tail, code[lang], n)):
                column.append(values)
        self.langs = list(known)
        tail, lang, n = (np.concatenate(c) for c in columns)
        texts = pa.concat_arrays(chunks)
        distinct, n = _combined(texts, tail, lang, n)
        data, offsets = _bytes(texts.take(pa.array(distinct)))
        starts, ends, of, self.last = _words(data, offsets)
        held = np.bincount(of, minlength=len(distinct))
        first = np.concatenate([[0], np.cumsum(held)[:-1]])
        own = np.arange(len(of)) - first[of] < (held - tail[distinct])[of]
        #: How often each word place counts: as its chunk, where the chunk owns it.
        self.weight = np.where(own, n[of], 0)
        lang = lang[distinct][of]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        spelled = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[(data != _SPACE) & (data != _BREAK)])]).dictionary_encode()
        key = pa.array(lang * len(spelled.dictionary) + spelled.indices.to_numpy()).dictionary_encode()
        #: Word numbers at each place; per number its spelling and language.
        self.word = key.indices.to_numpy()
        self.lang, index = np.divmod(key.dictionary.to_numpy(), max(1, len(spelled.dictionary)))
        self.text = spelled.dictionary.take(pa.array(index))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pair numbers at each place that has a next word in its piece (else -1), and the place of each number's first."""
        has = np.flatnonzero(self.last > np.arange(len(self.last)))
        number = np.full(len(self.word), -1, np.int64)
        number[has], first = _numbered(pa.array(self.word[has].astype(np.int64) * len(self.text) + self.word[has + 1]))
        return number, has[first]

    def totals(self, number: np.ndarray, size: int) -> np.ndarray:
        """The weight of each number; places without one have -1."""
        got = number >= 0
        return np.rint(np.bincount(number[got], self.weight[got], size)).astype(np.int64)

    def fingerprints(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of all words and of the pairs that stand at ``first``."""
        data, ends = _bytes(self.text)
        langs = np.fromiter((xxhash.xxh3_64_intdigest(v) for v in self.langs), np.uint64, len(self.langs))
        words = scramble(_word_names(data, ends[:-1], ends[1:]) ^ langs[self.lang])
        return words, scramble(words[self.word[first]] * np.uint64(3) + words[self.word[first + 1]])

    def spell(self, at: np.ndarray, length: int) -> pa.Array:
        """The phrases of ``length`` words that begin at places."""
        return pc.binary_join_element_wise(*(self.text.take(pa.array(self.word[at + k])) for k in range(length)), pa.scalar(b" ", pa.large_binary()))


def _send(buckets: int, least: int):
    def run(key, table):
        own = Dictionary(table)
        pair, first = own.pairs()
        words, pairs = own.fingerprints(first)
        counts = np.concatenate([own.totals(own.word, len(words)), own.totals(pair, len(pairs))])
        bucket, bits = narrow(np.concatenate([words, pairs]), buckets)
        order, bounds = by_bucket(bucket, buckets)
        bits, counts = bits[order], np.minimum(counts[order], least).astype(np.min_scalar_type(least))
        part = key[0].as_py()
        return blobs([(b, part, 0, as_bytes(bits[lo:hi]) + counts[lo:hi].tobytes()) for b, (lo, hi) in enumerate(zip(bounds, bounds[1:])) if hi > lo])

    return run


def _meet(least: int):
    """The fingerprints of a bucket whose counts reach ``least``, back to the parts that hold them."""
    kind = np.min_scalar_type(least)

    def run(key, table):
        values, counts = [], []
        for blob in table["blob"].to_pylist():
            n = len(blob) // (5 + kind.itemsize)
            values.append(from_bytes(blob[: 5 * n]))
            counts.append(np.frombuffer(blob, kind, n, 5 * n).astype(np.int64))
        part = np.repeat(table["chunk"].to_numpy(), [len(v) for v in values])
        values, counts = np.concatenate(values), np.concatenate(counts)
        order = np.argsort(values, kind="stable")
        values, counts, part = values[order], counts[order], part[order]
        at = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        often = np.repeat(np.add.reduceat(counts, at) >= least, np.diff(np.append(at, len(values))))
        order = np.argsort(part[often], kind="stable")
        values, part = values[often][order], part[often][order]
        names, at = np.unique(part, return_index=True)
        head = lambda n: pack(np.array([n, 0], "<u4"))
        return blobs([(key[0].as_py(), int(c), 0, head(hi - lo) + as_bytes(values[lo:hi])) for c, lo, hi in zip(names, at, [*at[1:], len(values)])])

    return run


def _spell_out(buckets: int, most: int):
    def run(key, left, right):
        fields = [("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64())]
        if not left.num_rows:
            return pa.table({n: pa.array([], t) for n, t in fields})
        own, hits = Dictionary(left), Hits(right, buckets)
        pair, first = own.pairs()
        words, pairs = own.fingerprints(first)
        langs, tables = pa.array(own.langs), []

        def emit(lang: np.ndarray, phrase: pa.Array, length: int, f: np.ndarray) -> None:
            columns = [langs.take(pa.array(lang)), phrase.cast(pa.large_string()).cast(pa.string()), pa.array(np.full(len(f), length, np.int32)), pa.array(f)]
            tables.append(pa.table(dict(zip([n for n, _ in fields], columns))))

        totals = own.totals(own.word, len(words))
        spoken = np.bincount(own.lang, totals, len(own.langs))
        emit(np.arange(len(own.langs)), pa.array([b""] * len(own.langs), pa.large_binary()), 0, np.rint(spoken).astype(np.int64))
        often = np.flatnonzero(hits.has(words) & (totals > 0))
        emit(own.lang[often], own.text.take(pa.array(often)), 1, totals[often])
        often = np.append(hits.has(pairs), False)[pair]  # number -1 finds the False
        number, place = np.where(often, pair, -1), first
        for length in range(2, most + 1):
            if length > 2:
                # A longer phrase is the shorter one at its place and the pair at its end.
                at = np.flatnonzero((number[: max(0, len(number) - length + 2)] >= 0) & often[length - 2 :])
                coded, first = _numbered(pa.array(number[at] * (len(pairs) + 1) + pair[at + length - 2]))
                number, place = np.full(len(pair), -1, np.int64), at[first]
                number[at] = coded
            totals = own.totals(number, len(place))
            keep = place[totals > 0]
            emit(own.lang[own.word[keep]], own.spell(keep, length), length, totals[totals > 0])
        return pa.concat_tables(tables)

    return run


def frequent_phrases(docs: DataFrame, most: int = 4, least: int = 30, part_bytes: int = 8 << 20, most_part_bytes: int = 64 << 20) -> DataFrame:
    """(lang, phrase, words, f): all phrases of 1 to ``most`` words that occur ``least`` times in a language, and per language its word count with an empty phrase."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = fill(total, min(most_part_bytes, max(part_bytes, total >> 12)))
    buckets = fill(total, min(4 * most_part_bytes, max(part_bytes, total >> 18)))
    by_part = texts.mapInArrow(_parse_texts(most - 1, parts), _DICTIONARY).groupBy("part")
    hits = by_part.applyInArrow(_send(buckets, least), _BLOB).groupBy("bucket").applyInArrow(_meet(least), _BLOB)
    spelled = by_part.cogroup(hits.groupBy("chunk")).applyInArrow(_spell_out(buckets, most), _COUNTS)
    return spelled.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0))


def mine_phrases(docs: DataFrame, most: int = 4, least: int = 30, scale: int = 2_000_000, inside: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``most`` words of each language.

    a counts the phrase, l and r the two parts at its weakest cut, n the language's words; score is
    floor(scale * a / (l + r)) there, ties of cuts to the shorter first part. A phrase inside a longer
    one that has ``inside`` percent of its occurrences is left out. A null text is empty, a null
    language ``und``; texts without words give nothing, an empty table no rows. Repeated rows count
    as often as they stand there. Ties in rank go to the larger a, then the smaller phrase in byte
    order. Other columns, whatever they are called, are not looked at.
    """
    found = store(frequent_phrases(docs, most, least))
    phrases = found.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    side = lambda name, f: found.where("words >= 1").select(F.col("lang"), F.col("phrase").alias(name), F.col("f").alias(f))
    pieces = max(1, math.isqrt(phrases.count() // top))
    spell = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", spell(F.lit(1), F.col("k")).alias("head"), spell(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    cuts = cuts.join(side("head", "l"), ["lang", "head"]).join(side("rest", "r"), ["lang", "rest"])
    whole = lambda name: F.col(name).cast("decimal(20,0)")
    cuts = cuts.withColumn("x", F.lit(scale) * whole("a")).withColumn("y", whole("l") + whole("r")).withColumn("score", F.expr("x div y"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: spell(i, m))))
    longer = phrases.where("words >= 3").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    stays = F.col("longer").isNull() | (F.lit(100) * whole("longer") < F.lit(inside) * whole("a"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(stays).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    # First the best of each piece of a language, so that none is sorted whole in one task.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.withColumn("piece", F.pmod(F.xxhash64("phrase"), F.lit(pieces)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "piece").orderBy(*order))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    spoken = found.where("words = 0").select("lang", F.col("f").alias("n"))
    return kept.join(spoken, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
