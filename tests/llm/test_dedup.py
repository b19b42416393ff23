import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberline.llm import nearjoin, passages, rolling, suffixes, vectors
from emberline.llm.registry import QUERIES
from emberline.llm.rolling import TIE
from emberline.operators.components import spanning_roots
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string, n_removed string"


def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd():
    """Copies, near copies, shared passages, periodic and multi-byte texts, nulls and empties."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = text(60), text(200)
    near = base.split(" ")
    near[50] = "changed"
    dozen, (morse, other) = text(12), brute.thue_morse()
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, text(30) + "\n" + passage + "\t" + text(25)), (5, text(9) + " " + passage), (6, None), (7, ""), (8, "  \n "), (9, "few words"),
        (10, "few words"), (11, "x" * 400), (12, "ab" * 260), (13, passage + passage), (14, text(12)), (15, "one  two\tthree\x0bfour five six seven eight nine ten eleven twelve thirteen"),
        (16, "one two three four five six seven eight nine ten eleven twelve thirteen"), (17, "y" + "x" * 150), (18, "ß" * 80), (19, base[:150] + text(5)), (20, text(3000)),
        (21, dozen + " " + morse), (22, dozen + " " + other), (23, morse), (24, other),
    ]
    return rows


def test_windows_match_brute_force(spark, sf):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op2_difference_cover_passages"](spark, sf).collect()}
    assert got == brute.windows(documents(spark, sf))


def test_windows_on_odd_texts(spark, odd):
    docs = spark.createDataFrame([(i, t, "s", "clash") for i, t in odd], SCHEMA).repartition(5)
    got = passages.remove_repeated_windows(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute.windows(odd)
    assert {brute.sha(r.kept_text.encode()) == r.kept_sha256 for r in got} == {True}
    assert set(got[0].asDict()) == {"doc_id", "text", "source", "n_words", "n_removed", "kept_sha256", "kept_text"}


def test_strings_match_brute_force(spark, sf):
    docs = documents(spark, sf)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op3_previous_factor_strings"](spark, sf).collect()}
    assert got == {i: v[:4] for i, v in brute.strings(docs).items()}


def test_strings_on_odd_texts(spark, odd):
    docs = spark.createDataFrame([(i, t, "s", "clash") for i, t in odd], SCHEMA).repartition(5)
    expected = brute.strings(odd)
    got = suffixes.remove_repeated_strings(docs).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == {i: v[:4] for i, v in expected.items()}
    assert {r.doc_id: r.kept_text for r in got} == {i: v[4].decode("utf-8", "ignore") for i, v in expected.items()}


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    windows = sorted((r.doc_id or 0, r.n_removed) for r in passages.remove_repeated_windows(docs).collect())
    assert windows == [(0, 0), (1, 40), (1, 40)]
    strings = sorted(r.n_removed for r in suffixes.remove_repeated_strings(docs).collect())
    assert strings == [0, len(text), len(text)]
    near = nearjoin.near_duplicate_documents(docs).collect()
    assert sorted((r.doc_id or 0, r.n_links) for r in near) == [(0, 2), (1, 2), (1, 2)]


def test_equal_spans_have_equal_hashes_wherever_they_stand():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 256, 300, dtype=np.uint8)
    for values in (rolling.byte_values(text), rng.integers(0, 1 << 64, 300, dtype=np.uint64)):
        for second in (False, True):
            alone = rolling.Spans(values, second).every(20)
            late = rolling.Spans(np.concatenate([values[:77], values]), second)
            assert (late.every(20)[77:] == alone).all() and (late.at(np.arange(77, 358), np.arange(97, 378)) == alone).all()
            assert len(np.unique(alone)) == len(alone) and (alone != rolling.Spans(values, not second).every(20)).all()


def plain_factors(texts):
    """For each position of texts laid end to end, the longest match that starts earlier; matches end with their texts."""
    suffixes_ = [t[i:] for t in texts for i in range(len(t))]
    same = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return [max((same(s, e) for e in suffixes_[:n]), default=0) for n, s in enumerate(suffixes_)]


def test_longest_previous_factors():
    rng = random.Random(1)
    cases = [[b"abaabab"], [b"mississippi mississippi"], [b"\0\0a\0", b"\0a\0\0"], [b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"] * 2]
    cases += [[bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 6))] for _ in range(60)]
    for texts in cases:
        order, text, room, ranks = suffixes.suffix_order(texts)
        order = order[room[order] > 0]
        common = np.concatenate([[0], suffixes.common_prefixes(order[:-1], order[1:], room, ranks)])
        by_place = dict(zip(order.tolist(), suffixes.longest_previous_factors(order, common).tolist()))
        expected = plain_factors(texts)
        assert [by_place[p] for p in sorted(by_place)] == expected
        for length in (1, 3, 5):
            at, start = suffixes.later_copies(texts, length)
            places = [(i, p) for i, t in enumerate(texts) for p in range(len(t))]
            assert list(zip(at.tolist(), start.tolist())) == [w for w, f in zip(places, expected) if f >= length]


def test_crowded_minimizers_are_settled_by_name(spark, monkeypatch):
    """One passage in a third of the documents, each time with other surroundings, and a long periodic text."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = letters(260)
    rows = [(i, letters(150) + (passage if i % 3 == 0 else "") + letters(150)) for i in range(150)] + [(500, "xy" * 3000), (501, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    expected = {i: v[:4] for i, v in brute.strings(rows).items()}
    for crowd in (suffixes.CROWD, 8):
        monkeypatch.setattr(suffixes, "CROWD", crowd)
        got = suffixes.remove_repeated_strings(docs)
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == expected


def test_a_crowded_minimizer_spreads_over_buckets():
    """The runs at the edges of a common passage all differ; their strings go to all buckets, no run goes to one."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh") for _ in range(260))
    texts = ["".join(rng.choice("abcdefgh") for _ in range(120)) + passage for _ in range(300)]
    table = pa.table({"doc_id": list(range(300)), "text": texts, TIE: list(range(300))})
    values, counts = suffixes._anchors(100)(table)
    assert counts.max() >= 250

    class AllHits:
        has = staticmethod(lambda fps: np.isin(fps, values))
        crowded = staticmethod(lambda fps: np.isin(fps, values[counts >= 50]))

    sent = suffixes._send(100)(0, table, AllHits, 64)
    names = [len(blob) for _, _, kind, blob in sent if kind == suffixes.NAMES]
    assert len(names) == 64 and max(names) < 3 * sum(names) / 64
    runs = sum(int.from_bytes(blob[:8], "little") for _, _, kind, blob in sent if kind == suffixes.RUNS)
    assert runs < len(values) + 50 * (counts >= 50).sum()


def test_rows_that_repeat_an_id_with_other_texts(spark):
    """Classes are no ids: of the null rows and of the two rows of id 9, only the near copies are linked."""
    rng = random.Random(2)
    words = lambda: [f"w{rng.randrange(99999)}" for _ in range(60)]
    base = words()
    near = lambda i: " ".join(base[:i] + ["other"] + base[i + 1 :])
    rows = [(1, near(0)), (2, near(59)), (9, near(1)), (9, " ".join(words())), (None, near(58)), (None, " ".join(words())), (None, " ".join(words()))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_links, r.class_id or 0, r.kept) for r in nearjoin.near_duplicate_documents(docs).collect())
    assert got == [(0, 0, 0, True), (0, 0, 0, True), (0, 3, 0, True), (1, 3, 0, False), (2, 3, 0, False), (9, 0, 9, True), (9, 3, 0, False)]
    table = spark.createDataFrame([(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (7, [1.0, 0.001], 1), (None, [1.0, 0.0], 1), (8, [1.0, 0.0], 2), (8, [1.0, 0.0], 2)], "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in vectors.near_duplicate_vectors(table.withColumn("rep", F.lit("x")).withColumn("n_links", F.lit("x"))).collect())
    assert got == [(0, 0, 0), (5, 0, 5), (5, 1, 5), (7, 1, 5), (8, 1, 8), (8, 1, 8)]


def test_near_join_matches_brute_force(spark, sf):
    got = {r.doc_id: (r.class_id, r.n_links) for r in QUERIES["op8_chosen_path_join"](spark, sf).collect()}
    assert got == brute.near(documents(spark, sf))


def test_near_join_on_odd_texts(spark, odd):
    docs = spark.createDataFrame([(i, t, "s", "clash") for i, t in odd], SCHEMA)
    got = {r.doc_id: (r.class_id, r.n_links) for r in nearjoin.near_duplicate_documents(docs).collect()}
    assert got == brute.near(odd)


def test_near_join_splits_large_nodes_and_tiles(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(9999)}" for _ in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(120)] = f"v{rng.randrange(999)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = nearjoin.near_duplicate_documents(docs, limit=8, depth=3, tile=16).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute.near(rows)


def test_near_join_finds_pairs_in_crowded_nodes(spark):
    """400 pairs just above 0.8; every document has half of 40 passages, so that no shingle is its own and all nodes are crowded."""
    rng = random.Random(4)
    passages_ = [[f"p{i}-{j}" for j in range(25)] for i in range(40)]
    rows, shingles = [], lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for i in range(400):
        one = [w for p in sorted(rng.sample(range(40), 20)) for w in passages_[p]]
        two = list(one)
        for j in range(10):
            two[j * 50 + rng.randrange(10, 40)] = f"v{rng.randrange(10**6)}"
        a, b = shingles(one), shingles(two)
        assert 0.8 <= len(a & b) / len(a | b) < 0.83
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(two))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nearjoin.near_duplicate_documents(docs, limit=64).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(400)) >= 399


def entered_runs(monkeypatch):
    """The first runs of the calls in which classes enter nodes, as they come."""
    calls, enter = [], nearjoin._enter
    monkeypatch.setattr(nearjoin, "_enter", lambda first, last: calls.append(first) or enter(first, last))
    return calls


def test_a_large_group_of_near_copies_enters_few_nodes(spark, monkeypatch):
    """Nodes that near copies and a few others crowd are settled in place; before, all classes of the group entered the nodes of all 64 tokens."""
    calls, rng = entered_runs(monkeypatch), random.Random(12)
    base = [f"w{rng.randrange(9999)}" for _ in range(200)]
    rows = []
    for i in range(240):
        words = list(base)
        for _ in range(rng.randint(0, 4) if i % 20 else 12):
            words[rng.randrange(200)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = nearjoin.near_duplicate_documents(docs, limit=48).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute.near(rows)
    assert calls == [0]


def test_others_in_a_crowded_node_meet_all_its_classes(spark, monkeypatch):
    """101 passes with 100 only, and in the ten runs they meet in crowded nodes alone."""
    calls, rng = entered_runs(monkeypatch), np.random.default_rng(5)
    order = np.random.default_rng(11).permutation(nearjoin.TOKENS)
    tokens = rng.integers(1000, 1 << 32, (102, nearjoin.TOKENS), dtype=np.uint32)
    for i in range(100):
        tokens[i, order[:60]] = order[:60]
    tokens[100, order[:44]] = order[:44]
    tokens[101, order[:30]] = order[:30]
    tokens[101, order[44:]] = tokens[100, order[44:]]
    sketches = spark.createDataFrame([(i, bytearray(t.tobytes())) for i, t in enumerate(tokens)], "rep long, tokens binary")
    got = {r.id: r.component for r in nearjoin.candidate_clusters(sketches, 0.8, 10, 16).collect()}
    assert got == {i: 0 for i in range(1, 102)} and calls == [0]


@pytest.mark.parametrize("operator", [passages.remove_repeated_windows, suffixes.remove_repeated_strings, nearjoin.near_duplicate_documents])
def test_empty_documents(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_links(rows, threshold):
    links, parent = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def good(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, v, a) in enumerate(rows):
        for j, w, b in rows[n + 1 :]:
            if a is not None and a == b and good(v) and good(w) and len(v) == len(w):
                x, y = np.array(v, np.float64), np.array(w, np.float64)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    p, q = find(i), find(j)
                    parent[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in links}


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    rows = [(i, [float(x) for x in (centres[i % 12] + rng.normal(size=24) * 0.12).astype(np.float32)], i % 3) for i in range(240)]
    rows += [(300 + i, rows[5][1], rows[5][2]) for i in range(20)]
    rows += [(400, None, 1), (401, [0.0] * 24, 1), (402, [None] + [1.0] * 23, 1), (403, [float("nan")] * 24, 1), (404, rows[0][1], None), (405, [1.0, 2.0], 1), (406, [1.0, 2.0], 1), (407, [float("inf")] * 24, 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(7)
    for tile in (16, 2048):
        got = vectors.near_duplicate_vectors(table, 0.98, tile=tile).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == plain_links(rows, 0.98)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert vectors.near_duplicate_vectors(table.where("vec_id < 0")).count() == 0


def test_spanning_roots():
    assert spanning_roots(6, np.array([5, 2, 4]), np.array([2, 1, 3])).tolist() == [0, 1, 1, 3, 3, 1]


def test_results_do_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    runs = [nearjoin.near_duplicate_documents(docs.repartition(n)).agg(F.bit_xor(F.xxhash64("doc_id", "class_id", "n_links"))).first()[0] for n in (1, 13)]
    assert runs[0] == runs[1]
