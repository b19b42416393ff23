import collections
import os

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from tests.llm.test_shaping import check_packing, plain_targets


def test_every_stage_against_plain_versions(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        before, after = docs.collect(), out.collect()
        seen[name] = (before, after)
        if i < 4:
            assert out.columns == columns
            docs = out
    before, after = seen["quality classifier"]
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    clean = [r.doc_id for r in before if good.get(r.doc_id) == 1]
    assert sum(i in kept for i in clean) > 0.97 * len(clean)
    assert sum(r.doc_id not in kept for r in before if good.get(r.doc_id) == 0) >= 1

    before, after = seen["n-gram Jaccard join"]
    classes = {c for c, _ in brute.near([(r.doc_id, r.text) for r in before]).values()}
    assert sorted(r.doc_id for r in after) == sorted(classes)

    before, after = seen["suffix-array dedup"]
    plain = brute.strings([(r.doc_id, r.text) for r in before])
    assert {r.doc_id: r.text for r in after} == {i: v[4].decode("utf-8", "ignore") for i, v in plain.items()}
    assert all(r.n_chars == len(r.text) for r in after)

    before, after = seen["mixing sources to target weights"]
    times, size = collections.Counter(r.doc_id for r in after), collections.Counter()
    words = {r.doc_id: len(brute.WORD.findall(r.text)) for r in before}
    for r in before:
        size[r.source] += words[r.doc_id]
    goals = plain_targets(size)
    for s in size:
        own = [r.doc_id for r in before if r.source == s]
        taken = sum(times[i] * words[i] for i in own)
        assert abs(taken - goals[s]) <= 512 + max(words[i] for i in own)
        assert all(times[i] <= 3 for i in own)

    before, after = seen["best-fit packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: tokenizer.encode(r.text, add_special_tokens=False).ids + [0] for r in before}
    assert all(list(r.ids) == ids[r.doc_id][r.start : r.start + r.length] for r in after)
    # A document that the mix repeats gives as many pieces of each number; every copy is told apart for the check.
    seen_pieces, rows = collections.Counter(), []
    for r in after:
        copy = seen_pieces[(r.doc_id, r.piece)]
        seen_pieces[(r.doc_id, r.piece)] += 1
        rows.append(Row(**{**r.asDict(), "doc_id": (r.doc_id, copy)}))
    assert all(seen_pieces[(i, 0)] == n for i, n in times.items())
    used = check_packing(rows, {(i, c): x for i, x in ids.items() for c in range(times[i])})
    assert used <= -(-sum(len(ids[i]) * n for i, n in times.items()) // 2048) * 1.02 + 1


def test_stages_on_odd_rows(spark, sf):
    """Null and repeated ids, null and empty texts, repeated rows, ties, and columns named like the operators' own."""
    text = lambda seed: " ".join(f"word{seed}x{i}" for i in range(40))
    base = spark.read.parquet(f"{sf}/documents.parquet").limit(1)
    rows = [
        (1, text(1), "en", "a"), (1, text(2), "en", "a"), (2, text(1), "en", "b"), (None, text(3), None, None), (None, text(4), "de", "a"), (None, text(3), "en", "a"),
        (3, None, "en", "a"), (3, None, "en", "a"), (4, "", "en", None), (5, text(5), "en", "a"), (5, text(5), "en", "a"), (None, None, None, None),
    ]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], base.schema)
    docs = docs.selectExpr("*", "'x' AS kept", "'x' AS row_a", "'x' AS size", "'x' AS taken", "'x' AS target", "'x' AS score", "'x' AS n_removed", "'x' AS piece")
    one = corpus_pipeline.keep_one_of_each(spark, docs, sf)
    assert one.columns == docs.columns
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")
    got = sorted(key(r) for r in one.collect())
    assert got == sorted([(True, 1, text(1)), (True, 1, text(2)), (False, 0, text(3)), (False, 0, text(4)), (True, 5, text(5)), (True, 3, ""), (True, 3, ""), (True, 4, ""), (False, 0, "")])
    clean = corpus_pipeline.remove_copied_strings(spark, docs, sf)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert sorted(len(r.text or "") for r in clean.collect())[-5:] == sorted(len(text(i)) for i in range(1, 6))
    mixed = corpus_pipeline.mix_sources(spark, docs, sf)
    assert mixed.columns == docs.columns
    assert mixed.where("text is null or text = ''").count() == 4
    assert {r.text for r in mixed.where("doc_id is null").collect()} <= {text(3), text(4), None}
    good = corpus_pipeline.keep_good(spark, docs, sf)
    assert good.columns == docs.columns
    assert {r.length for r in corpus_pipeline.pack_sequences(spark, docs.where("text is null"), sf).collect()} == {1}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("doc_id = 99"), sf).count() == 0


def test_run_writes_and_rereads(spark, sf):
    folder = spark.conf.get("spark.checkpoint.dir")
    out = corpus_pipeline.run(spark, sf)
    assert len([n for n in os.listdir(folder) if n.startswith("pipeline-")]) == 1
    assert out.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
