"""Packages of WARC records: round trips, and the directory reader on packages that other writers make."""

import base64
import collections
import hashlib
import io
import random
import struct
import zipfile

import pytest

from emberline.llm import archives

PAGES = "page_id long, url string, html string, digest string, size string, package string, copies string"


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


@pytest.fixture(scope="module")
def odd():
    """Copies, nulls, empties, repeated rows and ids, values with line ends, a long payload, marks of records inside payloads."""
    rng = random.Random(1)
    pages = [(i, f"http://h/{i}", "".join(rng.choice("<p>é \r\n") for _ in range(rng.randrange(300)))) for i in range(50)]
    pages += [(i, "http://copy", "the same\r\n\r\nWARC/1.1\r\n") for i in range(90, 60, -1)] + [(7, "again", "the same\r\n\r\nWARC/1.1\r\n")]
    pages += [(100, None, None), (101, "u", ""), (102, "a\r\nWARC-Type: x%0A", "x"), (103, "", "y" * 3_000_000), (None, "n", "null id"), (None, "m", "null id"), (None, "o", "the same\r\n\r\nWARC/1.1\r\n")]
    return pages + [(104, "twice", "twice")] * 4 + [(104, "other", "twice"), (104, "other", "not twice"), (105, "twice", "twice")]


def frame(spark, pages):
    return spark.createDataFrame([(*p, "clash", "clash", "clash", "clash") for p in pages], PAGES).repartition(5)


def plain(pages, least=0):
    """(page_id, url) are free to differ only where page_id and payload repeat."""
    groups = collections.defaultdict(list)
    for page, _, html in pages:
        groups[html or ""].append(page)
    out = []
    for html, ids in groups.items():
        size, named = len(html.encode()), digest(html)
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        for k, i in enumerate(ids):
            copy = k > 0 and size >= least
            out.append((i, size, named, "revisit" if copy else "response", ids[0] if copy else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 6])
def test_round_trip(spark, odd, least):
    got = archives.round_trip(spark, frame(spark, odd), least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == plain(odd, least)


def test_payloads_addresses_and_small_packages(spark, odd, tmp_path):
    written = archives.write_packages(frame(spark, odd), f"file://{tmp_path}/new", package_bytes=1 << 16)
    assert written.count() > 10 and written.agg({"records": "sum"}).first()[0] == len(odd)
    got = archives.read_packages(written).collect()
    assert collections.Counter((r.page_id, r.url) for r in got) == collections.Counter((i, u or "") for i, u, _ in odd)
    whole = {(r.payload_digest): r.payload for r in got if r.record_type == "response"}
    assert whole == {digest(h or ""): h or "" for _, _, h in odd}
    assert not list(tmp_path.glob("new/*.zip.*"))
    for package in tmp_path.glob("new/*.zip"):
        with zipfile.ZipFile(package) as z:
            assert z.namelist() == [archives.ARCHIVE, archives.INDEX] and z.testzip() is None


def test_nothing_and_same_place_twice(spark, odd, tmp_path):
    assert archives.round_trip(spark, frame(spark, odd).where("page_id < 0")).collect() == []
    for _ in range(2):  # a task that runs again
        written = archives.write_packages(frame(spark, odd), str(tmp_path))
    assert archives.read_packages(written).count() == len(odd)


def packed(zip64=False, before=b"", comment=b"", method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.comment = comment
        for name, data in (("a/é.txt", b"first"), ("b", b""), ("c", b"third" * 9)):
            with z.open(name, "w", force_zip64=zip64) as m:
                m.write(data)
    return before + out.getvalue()


@pytest.mark.parametrize("given", [{}, {"zip64": True}, {"before": b"#!stub"}, {"comment": b"says PK\x05\x06 and more " * 9}, {"zip64": True, "before": b"x" * 70_000, "comment": b"z" * 65_535}])
def test_directory(given):
    data = packed(**given)
    members = archives.read_directory(source := io.BytesIO(data), len(data))
    assert [(m.name, m.size) for m in members] == [("a/é.txt", 5), ("b", 0), ("c", 45)]
    starts = [archives.member_start(source, m) for m in members]
    assert data[starts[0] : starts[0] + 5] == b"first" and data[starts[2] : starts[2] + 45] == b"third" * 9


@pytest.mark.parametrize("before", [b"", b"stub"])
def test_zip64_numbers_in_the_directory(before):
    """Sizes, offset, count and place of the directory that only the ZIP64 records hold."""
    body, name = b"payload", b"big"
    local = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 2**32 - 1, 2**32 - 1, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(body), len(body)) + body
    extra = struct.pack("<HHI", 9, 4, 0) + struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    entry = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 2**32 - 1, 2**32 - 1, len(name), len(extra), 0, 0, 0, 0, 2**32 - 1) + name + extra
    at = len(local)
    end = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), at) + b"PK\x06\x07" + struct.pack("<IQI", 0, at + len(entry), 1)
    end += b"PK\x05\x06" + struct.pack("<HHHHIIH", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 2**32 - 1, 2**32 - 1, 0)
    data = before + local + entry + end
    (member,) = archives.read_directory(source := io.BytesIO(data), len(data))
    start = archives.member_start(source, member)
    assert (member.name, member.size) == ("big", 7) and data[start : start + 7] == body


def test_what_is_no_package_is_an_error():
    data = packed()
    for bad in (b"", b"no zip at all", data[:-30], data[40:]):
        with pytest.raises(ValueError):
            members = archives.read_directory(source := io.BytesIO(bad), len(bad))
            [archives.member_start(source, m) for m in members]
    deflated = packed(method=zipfile.ZIP_DEFLATED)
    members = archives.read_directory(source := io.BytesIO(deflated), len(deflated))
    with pytest.raises(ValueError, match="not stored"):
        archives.member_start(source, members[0])


def test_damaged_records_are_errors():
    record = archives._record("response", "urn:page:1:x", 1, "u", b"payload", 7, archives.base32_sha1(b"payload"), None)
    assert archives.parse_record(record)["payload"] == "payload"
    for bad in (record[:-1], record.replace(b"payload", b"Payload", 1) if record.count(b"payload") == 1 else record[::-1], b"x" + record):
        with pytest.raises(ValueError):
            archives.parse_record(bad)
