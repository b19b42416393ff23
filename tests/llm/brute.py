"""Plain versions of the corpus operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def windows(docs: list[tuple], width: int = 13) -> dict:
    """doc_id -> (words, removed, digest) of the word-window rule."""
    words = {i: WORD.findall(t or "") for i, t in docs}
    first: dict = {}
    for i in sorted(words):
        for p in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][p : p + width]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < i:
                gone[p : p + width] = [True] * width
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode()))
    return out


def strings(docs: list[tuple], length: int = 100) -> dict:
    """doc_id -> (bytes, removed, spans, digest, kept bytes) of the byte-string rule."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = [True] * length
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, sha(kept), kept)
    return out


def near(docs: list[tuple], similarity: float = 0.8, width: int = 5) -> dict:
    """doc_id -> (class, links) of the shingle join."""
    sets = {}
    for i, t in docs:
        w = WORD.findall(t or "")
        sets[i] = {tuple(w[p : p + width]) for p in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = collections.Counter()
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


def thue_morse(n: int = 10) -> tuple[str, str]:
    """The word of 2**n letters and its complement, which collide in any polynomial hash modulo 2**64."""
    bits = [bin(i).count("1") % 2 for i in range(1 << n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
