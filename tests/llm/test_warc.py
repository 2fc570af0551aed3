import gzip
import hashlib
import io
import os

import pyarrow as pa
import pytest

from agrovane.llm import warc
from agrovane.llm.common import prepare

SCHEMA = "page_id long, url string, html string, path string, digest string"


@pytest.fixture
def pages(spark):
    prepare(spark)
    big, other = "<p>é</p>" * 200, os.urandom(3000).hex()
    rows = [(k, f"http://a/{k}?q=é x", big) for k in range(30)] + [(40, None, None), (41, "u", ""), (42, "u", "small"), (43, "u", "small")]
    rows += [(50 + k, "u", other) for k in range(2)] + [(60, "u", "z" * 999), (61, "u", "z" * 999), (62, "u", "y" * 1000), (63, "u", "y" * 1000)]
    rows += [(None, "u", "n" * 2000), (None, "u", "n" * 2000), (70, "u", "m" * 2000), (70, "u", "m" * 2000), (None, "u", "m" * 2000)]
    rows += [(80, "u", "long " * 200_000)]
    return rows, spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def expected(rows):
    bodies = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, b in bodies:
        ids = [j for j, c in bodies if c == b and j is not None]
        leader = max(ids) if len(b) >= 1000 and ids and sum(c == b for _, c in bodies) > 1 else None
        revisit = leader is not None and i != leader
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", leader if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(pages, rows):
    texts, frame = pages
    out = warc.op3(frame).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert rows(out) == expected(texts)


@pytest.mark.parametrize("size", [64, 1000, 10**9])
def test_every_range_size_gives_every_record_once(pages, rows, size):
    texts, frame = pages
    manifest = warc.archive(frame.where("page_id IS NULL OR page_id < 80"))
    got = warc.read(manifest, size)
    assert got.count() == len(texts) - 1 == got.select("path", "offset").distinct().count()
    bodies = {(r["id"], bytes(r["payload"])) for r in got.where("type = 'response'").collect()}
    assert bodies <= {(i, (h or "").encode()) for i, _, h in texts}


def test_false_magic_and_foreign_members():
    """Magic bytes in a stored payload, members that are no records and rubbish between members are passed over."""
    stored = gzip.compress(b"WARC/1.0\r\nContent-Length: 0\r\n\r\n" + warc.MAGIC * 50, compresslevel=0)
    parts = [warc.record(k, "u", os.urandom(200), None) for k in range(5)]
    data = parts[0] + b"rubbish" + warc.MAGIC + parts[1] + stored + gzip.compress(b"no record") + parts[2] + parts[3] + parts[4] + warc.MAGIC
    for size in (1, 37, 500, len(data)):
        found = [at for low in range(0, len(data), size) for at, _ in warc.records_in(pa.BufferReader(data), len(data), low, low + size)]
        assert len(found) == len(set(found)) == 6
        assert all(data[at : at + 3] == warc.MAGIC for at in found)


def test_archives_are_gzip_streams(pages):
    manifest = warc.archive(pages[1]).collect()
    for entry in manifest:
        path = entry["path"].removeprefix("file:")
        content = gzip.GzipFile(fileobj=io.BytesIO(open(path, "rb").read())).read()
        assert content.count(b"WARC/1.1\r\n") == entry["records"] and os.path.getsize(path) == entry["size"]


def test_empty_table(spark):
    prepare(spark)
    assert warc.op3(spark.createDataFrame([], SCHEMA)).collect() == []


def test_every_range_is_read_by_a_task_of_its_own(pages):
    frame = pages[1]
    manifest = warc.archive(frame)
    size = 64 * 1024
    ranges = sum(-(-max(r["size"], 1) // size) for r in manifest.collect())
    assert ranges > 1
    got = warc.read(manifest, size)
    assert got.rdd.getNumPartitions() == ranges
    assert got.count() == frame.count()
