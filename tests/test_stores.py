"""Byte ranges against plain line splitting, digests, and writers at once."""

import hashlib
import random
import threading

import pytest
from pyspark.sql import functions as F

from emberline.sources import files, stores


@pytest.mark.parametrize("size", [1, 7, 100, 1 << 20])
def test_ranges_hold_each_line_once(spark, tmp_path, size, monkeypatch):
    rng = random.Random(size)
    texts = ["", "\n", "one", "one\n", "\n\na\n  \nb", "é\r\nß\rx\n", "long " * 300, "\n".join("l" * rng.randrange(40) for _ in range(60)), "a\n" * 50]
    for i, text in enumerate(texts if size > 1 else texts[:6]):
        (tmp_path / f"{i}.txt").write_bytes(text.encode())
    got: dict = {}
    for r in stores.numbered_lines(spark, str(tmp_path), size).collect():
        got.setdefault(int(r.path.rsplit("/", 1)[1][0]), {})[r.n] = r.value
    for i, text in enumerate(texts if size > 1 else texts[:6]):
        expected = [x for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip(" ")]
        assert got.get(i, {}) == dict(enumerate(expected)), i


def test_small_reads_give_the_same_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "READ", 5)
    data = b"alpha\nbe\n\nlonger than one read\nend"
    (tmp_path / "f").write_bytes(data)
    for size in range(1, len(data) + 1):
        found = []
        for start in range(0, len(data), size):
            with open(tmp_path / "f", "rb") as source:
                for batch in stores._range_lines(source, "f", start, min(len(data), start + size)):
                    found += batch.column("value").to_pylist()
        assert found == ["alpha", "be", "longer than one read", "end"], size


def test_digests_are_streamed(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * (stores.READ + 5))
    (tmp_path / "b.html").write_text(" <!DOCTYPE html><p>")
    (tmp_path / "c d").write_bytes(b"y")
    (tmp_path / "empty").write_bytes(b"")  # Spark's listing leaves out files without content
    got = {r.path.rsplit("/", 1)[1]: r for r in files.file_table(spark, str(tmp_path)).collect()}
    assert {n: (r.sha256, r.size_bytes, r.looks_like_html) for n, r in got.items()} == {
        f.name: (hashlib.sha256(f.read_bytes()).hexdigest(), f.stat().st_size, f.name == "b.html") for f in tmp_path.iterdir() if f.name != "empty"
    }


def test_of_writers_at_once_one_wins(spark, tmp_path):
    path, outcomes = str(tmp_path / "out"), []

    def write(k):
        try:
            outcomes.append((files.write_once(spark.range(100).select((F.col("id") + k % 2).alias("id")), path), k % 2))
        except ValueError:
            outcomes.append(("refused", k % 2))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [k for o, k in outcomes if o == "written"]
    assert len(won) == 1 and sorted(o for o, k in outcomes if k == won[0]) == ["same", "written"] and [o for o, k in outcomes if k != won[0]] == ["refused"] * 2
    assert spark.read.parquet(path).count() == 100 and [f.name for f in tmp_path.iterdir()] == ["out"]


def test_set_tree_tells_sets_apart(spark):
    root = lambda values: tuple(files.set_tree(spark.createDataFrame([(v,) for v in values], "id string"), "id", 1).first())
    assert root(["a", "b", "c"]) == root(["c", "b", "a", "a", None]) != root(["a", "b"]) and root(["ab", "c"]) != root(["a", "bc"])
    assert root([])[1:] == (0, 0)


def test_lines_are_numbered_through_files_and_few_bytes_are_read(spark, tmp_path, monkeypatch):
    """Thousands of small ranges are a few tasks' work, and a range reads about its own bytes."""
    texts = ["\n".join(f"{i:02d} {j}" for j in range(400)) + "\n" for i in range(5)]
    for i, text in enumerate(texts):
        (tmp_path / f"part-{i}").write_text(text)
    lines = stores.numbered_lines(spark, str(tmp_path), 10, through=True)
    assert lines.rdd.getNumPartitions() <= stores.FEW_TASKS
    assert [r.value for r in sorted(lines.collect(), key=lambda r: r.n)] == "".join(texts).splitlines() and lines.agg({"n": "max"}).first()[0] == 1999
    (tmp_path / "part-0").write_bytes(b"x" * 99 + b"\n" + b"y\n" * 500_000)
    with open(tmp_path / "part-0", "rb") as source:
        assert sum(b.num_rows for b in stores._range_lines(source, "f", 100, 120)) == 10 and source.tell() < 10_000
