"""Phrases and spelling variants against plain versions; both have SQL twins on the given tables."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import assume, given, settings
from hypothesis import strategies as st

from emberline.llm import phrases, spelling
from emberline.llm.registry import ORACLES, QUERIES
from tests.test_oracles import rows

DOCS = "doc_id long, text string, lang string, word string, phrase string, n string, f string, part string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_phrases(docs, most=4, least=30, scale=2_000_000, inside=80, top=2000):
    found, spoken = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            lang = "und" if lang is None else lang
            spoken[lang] += len(words)
            for m in range(1, most + 1):
                found[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in found.items():
        often = {p: c for p, c in f.items() if c >= least and len(p) > 1}
        kept = []
        for p, a in often.items():
            score, k = min((scale * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            longer = [c for q, c in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * c >= inside * a for c in longer):
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, spoken[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def plain_variants(docs, shortest=6, least=5, every=199, times=5):
    n = collections.Counter()
    for i, text, _ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n)


@pytest.fixture(scope="module")
def odd():
    """Few words in many orders, spelling noise, copies, odd white space, nulls, empties, a very long text, ids and languages that repeat or lack."""
    rng = random.Random(5)
    stems = ["station", "stations", "statión", "measure", "measured", "Ärmelkanal", "kanalärmel", "aaaaaa", "aaaaaaa", "aaaaaaaa", "of", "the", "x"]
    noise = lambda w: w if rng.random() < 0.9 else w[: (k := rng.randrange(len(w)))] + rng.choice("aeé") + w[k + rng.randrange(2) :]
    text = lambda n: "".join(noise(rng.choice(stems[: rng.choice([3, 6, 13])])) + rng.choice([" "] * 12 + [", ", "\t", "  ", ".", "\n", " ", "?!", "\r\n"]) for _ in range(n))
    docs = [(i, text(rng.randrange(60)), rng.choice(["en", "de", None, "und", ""])) for i in range(250)]
    docs += [(100, docs[1][1], "en")] * 3 + [(None, text(40), "en"), (101, None, "de"), (102, "", None), (103, " \n.,;", "fr"), (104, text(9000), "en"), (105, "B" * 5000 + " c", "en"), (106, "the of " * 700, "de")]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, g, *["clash"] * 5) for i, t, g in docs], DOCS).repartition(7)


def test_phrases_match_a_plain_count(spark, odd):
    got = sorted(map(tuple, phrases.mine_phrases(frame(spark, odd)).collect()))
    assert got == plain_phrases(odd) and len({g[0] for g in got}) > 2


def test_phrases_with_other_parameters_and_many_parts(spark, odd, monkeypatch):
    monkeypatch.setattr(phrases, "fill", lambda count, per, least=1: 9)
    got = sorted(map(tuple, phrases.mine_phrases(frame(spark, odd), most=5, least=300, inside=60, top=7).collect()))
    assert got == plain_phrases(odd, most=5, least=300, inside=60, top=7) and got


def test_phrases_of_nothing(spark, odd):
    assert phrases.mine_phrases(frame(spark, odd).where("doc_id < 0")).collect() == []
    assert phrases.mine_phrases(frame(spark, [(1, None, None), (2, " . ", "en")])).collect() == []


def test_chunks_own_each_word_once():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab c. \n"), 400)).encode() for _ in range(5)] + [b"", b"."]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    chunks, tail, text, _ = phrases.parse(np.frombuffer(b"".join(texts), np.uint8), offsets, 3, period=4)
    own = lambda c, t: (w := re.findall(rb"[^ \n]+", c))[: len(w) - t]
    for i, t in enumerate(texts):
        words = [w for c, k, j in zip(chunks.to_pylist(), tail.tolist(), text.tolist()) if j == i for w in own(c, k)]
        assert words == re.findall(rb"[^ \n.]+", t)
    assert len(set(chunks.to_pylist())) < len(chunks)


def test_variants_match_a_plain_count(spark, odd):
    got = sorted(map(tuple, spelling.spelling_variants(frame(spark, odd), every=7, times=3).select("word", "n", "n_near", "form", "form_n", "root").collect()), key=lambda r: r[0])
    expected = plain_variants(odd, every=7, times=3)
    assert got == expected and any(r[3] and r[5] != r[3] for r in got)


def test_tiles_of_a_crowded_group_give_the_same(spark):
    rng = random.Random(8)
    words = {"prefix" + "".join(rng.choice("abc") for _ in range(rng.choice([4, 5]))) for _ in range(300)}
    docs = [(i, " ".join([w] * rng.randrange(5, 40)), None) for i, w in enumerate(sorted(words))]
    names = ("word", "n", "n_near", "form", "form_n", "root")
    got = sorted(map(tuple, spelling.spelling_variants(frame(spark, docs), tile=16).select(*names).collect()), key=lambda r: r[0])
    assert got == plain_variants(docs)
    placed = spelling._tiled(spelling._groups(spelling.count_words(frame(spark, docs))), 16)
    assert placed.groupBy("longer", "front", "part", "a", "b").count().agg({"count": "max"}).first()[0] < 80


def test_variants_of_nothing(spark, odd):
    assert spelling.spelling_variants(frame(spark, odd).where("doc_id < 0")).collect() == []


word = st.text("abé", min_size=6, max_size=9)


@settings(max_examples=200, deadline=None)
@given(word, word)
def test_prefix_and_suffix_tell_single_edits(a, b):
    assume(a != b and abs(len(a) - len(b)) < 2)
    data = [w.encode("latin-1") for w in (a, b)]
    longer = max(map(len, data))
    front, back = spelling.matrices(data, longer)
    both = [len(spelling.near_pairs(np.array([len(d) for d in data]), front, back, np.array([0]), np.array([1]), longer, side)[0]) for side in (True, False)]
    holes, less = (lambda w: {w[:k] + "_" + w[k + 1 :] for k in range(len(w))}), (lambda w: {w[:k] + w[k + 1 :] for k in range(len(w))})
    near = b in less(a) or a in less(b) or bool(holes(a) & holes(b))
    assert bool(both[0]) == near
    assert both[1] <= both[0]


@pytest.mark.parametrize("name", ["op11_prefix_free_phrases", "op12_spelling_tiles", "op13_zip_warc"])
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns) and rows(got.columns, got.collect()) == rows(columns, cursor.fetchall())
