"""WARC records in ZIP packages: written by Spark tasks, read back by byte ranges.

A package is a ZIP file with two stored members: ``archive/data.warc.gz``, one gzip member a record,
and ``indexes/index.cdx``, one line a record with its offset and length in the archive. The reader
needs three small reads to find both: the end of the file, the central directory (of either kind,
ZIP64 where sizes, offsets or counts ask for it) and the members' local headers. Packages are dealt
out as ranges of records, so one of any size is read by many tasks, and nothing is extracted.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.runtime import cut, fill, remove, shared_folder

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Bytes of payload of a package, and of a range of records that one task reads.
PACKAGE, RANGE = 64 << 20, 8 << 20
_END, _END64, _LOCATOR, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_PAST = 0xFFFFFFFF
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


class Member(NamedTuple):
    name: str
    stored: bool
    size: int
    header: int


def store_of(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a URI and the path in it; a plain path is local."""
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pa.fs.LocalFileSystem(), uri)


def _read(source: BinaryIO, at: int, size: int) -> bytes:
    source.seek(at)
    data = source.read(size)
    if len(data) != size:
        raise ValueError(f"the package ends within {size} bytes at {at}")
    return data


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Sizes and offsets of an entry, those that are full taken from its ZIP64 field in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            numbers = iter(struct.unpack_from(f"<{min(size, len(extra) - at - 4) // 8}Q", extra, at + 4))
            return [next(numbers) if v == _PAST else v for v in values]
        at += 4 + size
    return values


def read_directory(source: BinaryIO, size: int) -> list[Member]:
    """The members of a ZIP file of ``size`` bytes, from its central directory; bytes before the first member are allowed."""
    tail_at = max(0, size - (1 << 16) - 22)
    tail = _read(source, tail_at, size - tail_at)
    end = tail.rfind(_END)
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(_END, 0, end)
    if end < 0:
        raise ValueError("no end of a central directory")
    count, length, offset = struct.unpack_from("<HII", tail, end + 10)
    before = tail_at + end
    if before >= 20 and (locator := _read(source, before - 20, 20))[:4] == _LOCATOR:
        at = struct.unpack_from("<Q", locator, 8)[0]
        head = _read(source, at, 56) if at + 76 <= before else b""
        if head[:4] != _END64:  # bytes stand before the package: the record is the one just before its locator
            at = before - 76
            head = _read(source, at, 56)
        if head[:4] != _END64:
            raise ValueError("no ZIP64 end of a central directory")
        count, length, offset = struct.unpack_from("<QQQ", head, 32)
        before = at
    shift = before - length - offset
    if shift < 0:
        raise ValueError("the central directory is cut")
    directory, at, members = _read(source, before - length, length), 0, []
    for _ in range(count):
        if directory[at : at + 4] != _ENTRY:
            raise ValueError("no entry of a central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, plain, names, extras, notes = struct.unpack_from("<IIHHH", directory, at + 20)
        name = directory[at + 46 : at + 46 + names]
        extra = directory[at + 46 + names : at + 46 + names + extras]
        plain, packed, header = _wide(extra, [plain, packed, struct.unpack_from("<I", directory, at + 42)[0]])
        members.append(Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method == 0 and not flags & 1, packed, header + shift))
        at += 46 + names + extras + notes
    return members


def member_start(source: BinaryIO, member: Member) -> int:
    """Where the bytes of a member begin; only a stored one can be read by ranges."""
    if not member.stored:
        raise ValueError(f"{member.name} is not stored")
    local = _read(source, member.header, 30)
    if local[:4] != _LOCAL:
        raise ValueError(f"no local header of {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", local, 26))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, name: str, page: int | None, url: str, payload: bytes | None, size: int, digest: str, refers: str | None) -> bytes:
    """One WARC record of an HTTP answer; a revisit keeps the answer's head only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))), ("Page-ID", "" if page is None else str(page)),
    ]
    if refers is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers}>")]
    lines = "".join(f"{k}: {_line(v)}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _line(value: str) -> str:
    """A header value on one line: line ends and the sign that marks them are percent-encoded."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])


def parse_record(data: bytes) -> dict:
    """A record as a row; lengths and digests that disagree with its bytes are errors."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    fields = _fields(head)
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("a record's block has another length")
    answer, _, payload = rest[:size].partition(b"\r\n\r\n")
    whole, digest = int(_fields(answer)["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != whole or base32_sha1(payload) != digest):
        raise ValueError("a payload differs from its digest")
    number = lambda text: int(text) if text else None
    refers = fields.get("WARC-Refers-To")
    return {
        "page_id": number(fields["Page-ID"]), "url": _unline(fields["WARC-Target-URI"]), "payload_bytes": whole, "payload_digest": digest, "record_type": kind,
        "refers_to": number(refers.strip("<>").split(":")[2]) if refers else None, "payload": payload.decode() if kind == "response" else None,
    }


def _zipped(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _name(page: int | None, digest: str, of: str = "") -> str:
    return f"urn:page:{'' if page is None else page}:{digest}{of}"


def _combine(batches) -> Iterator[pa.RecordBatch]:
    """Rows of a task that repeat page, address and payload send the payload once, and last how many more there are."""
    more: dict[tuple, int] = {}
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "size", "package"))))
        new = [k not in more and not more.update({k: 0}) for k in keys]
        for k in (k for k, first in zip(keys, new) if not first):
            more[k] += 1
        yield batch.filter(pa.array(new))
    again = [(*k, None, n) for k, n in more.items() if n]
    if again:
        columns = dict(zip(("page_id", "url", "digest", "size", "package", "html", "copies"), zip(*again)))
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in batch.schema], schema=batch.schema)


def _write_package(folder: str):
    """One package of its pages. The name is its number and the file appears whole, so a task that runs again repeats it."""

    def run(key, pages, firsts):
        path, at, lines = f"{folder}/{key[0].as_py():07d}.zip", 0, []
        first = {(d, n): p for d, n, p in zip(firsts["digest"].to_pylist(), firsts["size"].to_pylist(), firsts["first"].to_pylist())}
        pages = pages.sort_by([(c, "ascending") for c in ("page_id", "digest", "size", "url", "copies")])
        fs, place = store_of(path)
        draft, begun, digests = f"{place}.{uuid.uuid4().hex}", set(), {}
        with fs.open_output_stream(draft) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
            with package.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True) as member:
                for row in (row for batch in pages.to_batches(256) for row in batch.to_pylist()):
                    page, same, payload = row["page_id"], (row["digest"], row["size"]), (row["html"] or "").encode()
                    if not row["copies"]:
                        digests[same] = base32_sha1(payload)
                    for _ in range(row["copies"] or 1):
                        copy = same in first and (first[same] != page or same in begun)
                        begun |= {same} if same in first and not copy else set()
                        name = _name(page, digests[same], f":{at}" if copy else "")
                        kind, refers = ("revisit", _name(first[same], digests[same])) if copy else ("response", None)
                        data = _zipped(_record(kind, name, page, row["url"] or "", None if copy else payload, row["size"], digests[same], refers))
                        member.write(data)
                        lines.append(f"{digests[same]} {at} {len(data)} {ARCHIVE} {name}\n")
                        at += len(data)
            with package.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as member:
                member.write("".join(lines).encode())
        with contextlib.suppress(FileExistsError):
            fs.move(draft, place)
        return pa.table({"path": pa.array([path] if lines else [], pa.string()), "records": pa.array([len(lines)] if lines else [], pa.int64())})

    return run


def write_packages(pages: DataFrame, folder: str, least: int = 0, package_bytes: int = 8 << 20, most_package_bytes: int = 128 << 20) -> DataFrame:
    """Write a record per row of (page_id, url, html) and return (path, records) of the packages.

    Of payloads of at least ``least`` bytes that are equal, that of the smallest page_id is a response
    and the others revisit it; of rows that repeat page_id and payload one is a response. A null html
    is an empty payload, a null url an empty address, a null page_id comes after all others. An empty
    table writes nothing. Packages grow with the table, to ``most_package_bytes`` of payload; other
    columns are not looked at. The folder may be in any store that pyarrow opens.
    """
    body = F.coalesce("html", F.lit(""))
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0]
    packages = fill(total, min(most_package_bytes, max(package_bytes, (total or 0) >> 12)))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("size"), body.alias("html"))
    rows = rows.withColumn("package", F.pmod(F.xxhash64("page_id", "digest"), F.lit(packages))).withColumn("copies", F.lit(None).cast("long"))
    keys = rows.select("page_id", "digest", "size", "package").where(F.col("size") >= least)
    shared = keys.groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    firsts = keys.select("package", "digest", "size").distinct().join(shared, ["digest", "size"])
    dealt = rows.mapInArrow(_combine, rows.schema).groupBy("package")
    fs, place = store_of(folder)
    fs.create_dir(place, recursive=True)
    return cut(dealt.cogroup(firsts.groupBy("package")).applyInArrow(_write_package(folder), "path string, records long"))


def _index(source: BinaryIO, size: int) -> Iterator[tuple[int, list[int]]]:
    """(start in the package, lengths) of runs of neighbouring records of about RANGE bytes."""
    members = {m.name: m for m in read_directory(source, size)}
    for index in (m for name, m in members.items() if name.startswith("indexes/")):
        lines = _read(source, member_start(source, index), index.size).decode().splitlines()
        places = sorted((archive, int(at), int(length)) for _, at, length, archive, _ in (line.split(" ", 4) for line in lines))
        run: list[int] = []
        begin, last = 0, ("", 0)
        for archive, at, length in places:
            start = member_start(source, members[archive]) + at if not run or (archive, at) != last else None
            if start is not None or sum(run) >= RANGE:
                if run:
                    yield begin, run
                begin, run = start if start is not None else begin + sum(run), []
            run.append(length)
            last = (archive, at + length)
        if run:
            yield begin, run


def _find_records(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            fs, place = store_of(path)
            with fs.open_input_file(place) as source:
                found = list(_index(source, source.size()))
            yield pa.RecordBatch.from_pydict({"path": [path] * len(found), "start": pa.array([s for s, _ in found], pa.int64()), "lengths": pa.array([n for _, n in found], pa.list_(pa.int64()))})


def _read_records(batches) -> Iterator[pa.RecordBatch]:
    text, long = pa.string(), pa.int64()
    schema = pa.schema([("page_id", long), ("url", text), ("payload_bytes", long), ("payload_digest", text), ("record_type", text), ("refers_to", long), ("payload", text)])
    for batch in batches:
        for row in batch.to_pylist():
            fs, place = store_of(row["path"])
            with fs.open_input_file(place) as source:
                data, at, rows = _read(source, row["start"], sum(row["lengths"])), 0, []
            for length in row["lengths"]:
                rows.append(parse_record(zlib.decompress(data[at : at + length], 31)))
                at += length
            yield pa.RecordBatch.from_pylist(rows, schema)


def read_packages(paths: DataFrame) -> DataFrame:
    """The records of all packages of (path): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null in a revisit)."""
    ranges = cut(paths.select("path").mapInArrow(_find_records, "path string, start long, lengths array<long>"))
    return ranges.repartition(fill(ranges.count(), 1), "path", "start").mapInArrow(_read_records, _RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """What is read back of a record per page, from packages in the shared folder that are removed again; the payloads are not kept."""
    folder = f"{shared_folder(spark)}/packages-{uuid.uuid4().hex}"
    written = write_packages(pages, folder, least)
    back = cut(read_packages(written).drop("payload"))
    remove(spark, folder)
    return back
