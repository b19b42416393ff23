"""Files of any size, read by byte ranges in tasks, and folders that appear whole or not at all."""

from __future__ import annotations

import contextlib
import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.runtime import cut, fill, remove

#: Bytes of a range of lines, and of one read.
RANGE, READ = 64 << 20, 8 << 20
#: Ranges that each have a task of their own; more are read several by a task, RANGE bytes together.
FEW_TASKS = 64


def store_of(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a URI and the path in it; file: and plain paths are local."""
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri else (pa.fs.LocalFileSystem(), uri)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes); no content is read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size_bytes"))


def _digest(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            fs, place = store_of(path)
            whole, head = hashlib.sha256(), b""
            with fs.open_input_file(place) as source:
                while piece := source.read(READ):
                    head = head or piece[:64]
                    whole.update(piece)
            found.append((whole.hexdigest(), head))
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("size_bytes"), pa.array([d for d, _ in found], pa.string()), pa.array([h for _, h in found], pa.binary())], names=["path", "size_bytes", "sha256", "head"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, sha256, head): a file is streamed by one task, a few MB at a time; head is its first 64 bytes."""
    files = cut(list_files(spark, path))
    return files.repartition(fill(files.count(), 4), "path").mapInArrow(_digest, "path string, size_bytes long, sha256 string, head binary")


def _lines(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            fs, place = store_of(row["path"])
            with fs.open_input_file(place) as source:
                for lines in _range_lines(source, row["path"], row["start"], row["stop"]):
                    n = pa.compute.add(lines.column("within"), row["shift"])
                    yield pa.RecordBatch.from_arrays([lines.column("path"), n, lines.column("value")], names=["path", "n", "value"])


def _counts(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            fs, place = store_of(row["path"])
            with fs.open_input_file(place) as source:
                found.append(sum(lines.num_rows for lines in _range_lines(source, row["path"], row["start"], row["stop"])))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "start", "stop")), pa.array(found, pa.int64())], names=["path", "start", "stop", "lines"])


def _range_lines(source, path: str, start: int, stop: int) -> Iterator[pa.RecordBatch]:
    """The lines that begin in [start, stop), blank ones left out, in batches; the last one is read to its end.

    Of the bytes behind the range a page is read at first, then as many again.
    """
    source.seek(max(0, start - 1))
    at, rest, number = max(0, start - 1), b"", 0
    inside = start == 0  # else what comes before the first line end belongs to the range before
    while True:
        piece = source.read(min(READ, max(4096, stop - at - len(rest) + 1, len(rest))))
        block = rest + piece
        if not inside:
            cut_at = block.find(b"\n") + 1
            if not cut_at and piece and at + len(block) < stop:
                at, rest = at + len(block), b""
                continue
            if not cut_at or at + cut_at >= stop:
                return
            at, block, inside = at + cut_at, block[cut_at:], True
        # Whole lines that begin before the stop; one that begins there is the next range's.
        last = block.find(b"\n", stop - 1 - at) + 1 if at + len(block) >= stop else 0
        done = bool(last) or not piece
        end = last or (len(block) if not piece else block.rfind(b"\n") + 1)
        lines = [x for x in block[:end].decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip(" ")]
        if lines:
            n = len(lines)
            yield pa.RecordBatch.from_pydict({"path": [path] * n, "start": pa.array([start] * n, pa.int64()), "within": pa.array(range(number, number + n), pa.int64()), "value": lines})
            number += n
        if done:
            return
        at, rest = at + end, block[end:]


def numbered_lines(spark: SparkSession, path: str, range_bytes: int = RANGE, through: bool = False) -> DataFrame:
    """(path, n, value): the lines of all files that are not blank, numbered from 0 within their file, or ``through`` all files in the order of their names.

    Files are dealt out as byte ranges, of which a task reads many if they are small; a line belongs to
    the range in which it begins. A first reading counts the lines of each range, a second one numbers
    them from the sum of the counts before, so lines are never sorted, joined or read by one task.
    """
    files = list_files(spark, path).where("size_bytes > 0")
    ranges = cut(files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size_bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"), "size_bytes"))
    count = ranges.count()
    tasks = max(min(count, FEW_TASKS), fill(count * range_bytes, RANGE))
    dealt = ranges.select("path", "start", F.least(F.col("start") + range_bytes, "size_bytes").alias("stop")).repartition(tasks, "path", "start")
    counts = cut(dealt.mapInArrow(_counts, "path string, start long, stop long, lines long"))
    before = (Window.orderBy("path", "start") if through else Window.partitionBy("path").orderBy("start")).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    shifted = cut(counts.select("path", "start", "stop", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("shift")).repartition(tasks, "path", "start"))
    return shifted.mapInArrow(_lines, "path string, n long, value string")


def _rename(spark: SparkSession, draft: str, path: str) -> bool:
    """Move a folder to a place where nothing is; False if something is there. Of several callers one succeeds."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    fs = target.getFileSystem(conf)
    fs.mkdirs(target.getParent())
    if fs.getScheme() == "file":
        with contextlib.suppress(OSError):  # a folder with files cannot be replaced
            os.rename(store_of(draft)[1], store_of(path)[1])
            return True
        return False
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(jvm.org.apache.hadoop.fs.Path(draft), fs.makeQualified(target), none)
    except Exception:
        if fs.exists(target):
            return False
        raise
    return True


def publish(rows: DataFrame, path: str) -> bool:
    """Write Parquet that appears at ``path`` whole, by one rename, or not at all; False if something is there already."""
    spark = rows.sparkSession
    draft = f"{path.rstrip('/')}.draft-{uuid.uuid4().hex}"
    rows.write.parquet(draft)
    if _rename(spark, draft, path):
        return True
    remove(spark, draft)
    return False
