"""Rolling hashes over Arrow text columns, in slices that stay in cache."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once; a longer document is a slice of its own.
SLICE = 1 << 20
#: Two pairs of primes below 2**32, so that products of two residues fit 64 bits; each has a random base.
_PRIMES = ((4294967291, 4294967279), (4294967231, 4294967197))
_BASES = np.random.default_rng(20240229).integers(1 << 31, 4294967197, (2, 2)).tolist()
_32 = np.uint64(32)


def scramble(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of a base and of its inverse modulo a prime, grown on demand."""

    def __init__(self, prime: int, base: int) -> None:
        self.prime = np.uint64(prime)
        self.bases = base, pow(base, -1, prime)
        self.up = self.down = np.ones(1, np.uint32)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (self._grown(b, max(n, SLICE + 4096)) for b in self.bases)
        return self.up[:n], self.down[:n]

    def _grown(self, base: int, n: int) -> np.ndarray:
        out, have = np.ones(n, np.uint32), 1
        while have < n:
            more = min(have, n - have)
            out[have : have + more] = out[:more] * np.uint64(pow(base, have, int(self.prime))) % self.prime
            have += more
        return out


_POWERS = tuple(tuple(_Powers(p, b) for p, b in zip(*both)) for both in zip(_PRIMES, _BASES))


class Spans:
    """Hashes of any spans of a sequence of numbers, from prefix sums modulo two primes: about 63 bits, and as many independent ones with ``second``.

    A polynomial modulo a power of two would collide for words that anybody can write down, whatever its base.
    """

    def __init__(self, values: np.ndarray, second: bool = False) -> None:
        n = len(values)
        self.parts = []
        for powers in _POWERS[second]:
            up, down = powers.get(n + 1)
            sums = np.zeros(n + 1, np.uint64)
            own = sums[1:]
            small = values.dtype.itemsize < 4  # below every prime already
            np.multiply(values if small else values % powers.prime, up[:n], out=own, dtype=np.uint64)
            own %= powers.prime
            np.cumsum(own, out=own)
            self.parts.append((powers.prime, down, sums))

    def _hash(self, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        halves = []
        for prime, down, sums in self.parts:
            x = sums[ends] - sums[starts]
            x %= prime
            x *= down[starts]
            x %= prime
            halves.append(x)
        halves[0] <<= _32
        halves[0] |= halves[1]
        return scramble(halves[0])

    def every(self, width: int) -> np.ndarray:
        """The span of ``width`` from each position that has one."""
        n = max(0, len(self.parts[0][2]) - width)
        return self._hash(slice(0, n), slice(width, width + n))

    def at(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self._hash(starts, ends)


def byte_values(data: np.ndarray) -> np.ndarray:
    """A number above 0 for each byte."""
    return data.astype(np.uint16) + np.uint16(1)


#: Column of the texts' hashes, by which rows of one doc_id are ordered.
TIE = "__text_hash"


def ordered(table: pa.Table) -> pa.Table:
    """Rows in one order whatever the shuffle delivered: (doc_id, hash of the text, text), nulls first."""
    if table.num_rows < 2:
        return table
    keys = [("doc_id", "ascending"), (TIE, "ascending"), ("text", "ascending")]
    return table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_start"))


def doc_order(table: pa.Table) -> np.ndarray:
    """doc_id as int64 for comparisons; a null id is smaller than any other."""
    return pc.fill_null(table.column("doc_id").cast(pa.int64()), -(2**63)).to_numpy()


def slices(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of about SLICE bytes; null is no bytes."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row = 0
    for chunk in chunks:
        if not len(chunk):
            continue
        chunk = chunk.cast(pa.large_binary())
        bounds = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(chunk.buffers()[2], np.uint8) if chunk.buffers()[2] is not None else np.empty(0, np.uint8)
        at = 0
        while at < len(chunk):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE, "right")) - 1)
            to = min(to, len(chunk))
            yield row + at, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
            at = to
        row += len(chunk)


def separators(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a slice, and the words' document numbers within it."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separators(data)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a document never continues the word of the one before
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    return Spans(byte_values(data), second).at(starts, ends) ^ (ends - starts).astype(np.uint64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as one value."""
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    width = sum(np.dtype(k).itemsize for k in kinds)
    n, at, out = len(blob) // width, 0, []
    for k in kinds:
        out.append(np.frombuffer(blob, k, n, at))
        at += n * np.dtype(k).itemsize
    return out
