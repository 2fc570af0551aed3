"""WARC archives: a writer and a splittable reader.

Writer: each task writes one archive of gzip members, one member per record, into the shared folder; the archive's name holds the
attempt, and the manifest that Spark commits lists the attempts that count. Records with equal payloads of at least
:data:`REVISIT_BYTES` bytes are one response, the one with the greatest id, and revisits that refer to it.

Reader: archives are cut into byte ranges, and a task per range looks for gzip magic, takes a candidate as a member only
if its inflated head is a WARC version line, and owns the records that start inside its range; the last of them is read to its end
beyond the range. Where one member ends the next begins, so after the first hit there is no more search. A range without a
record start gives nothing. (A stored, uncompressed member that holds another WARC archive could be taken for two.)

Archives are opened by URI through pyarrow's file systems, so local paths, HDFS and object stores work alike.

Defined cases: NULL payloads count as empty; a NULL id is written as ``null`` and read as NULL, and never is a response that others refer
to unless no id of the group is known, when all are responses; repeated rows with the greatest id are responses each; an
empty table gives no archive and an empty result; additional columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrovane.scale import materialize, shared_folder

REVISIT_BYTES = 1000
RANGE_BYTES = 1024 * 1024
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
DATE = "2024-01-01T00:00:00Z"
_STEP = 256 * 1024

RECORDS = "id long, type string, refers_to long, url string, payload_digest string, payload_bytes long, payload binary, path string, offset long"


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pa.fs.LocalFileSystem(), uri)


def _urn(number: int | None) -> str:
    return f"<urn:x-page:{'null' if number is None else number}>"


def _number(urn: str | None) -> int | None:
    tail = (urn or "null").strip("<>").rpartition(":")[2]
    return None if tail == "null" else int(tail)


def record(number: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response with its HTTP head and payload, or a revisit with the head alone."""
    revisit = refers_to is not None
    digest = hashlib.sha1(payload, usedforsecurity=False).hexdigest()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(number)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?&=#%~')}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head.append(f"WARC-Refers-To: {_urn(refers_to)}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def revisits(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """``id``, ``url``, ``payload`` and ``refers_to`` of each page.

    Only digests are grouped; the table of repeated digests decides by its size whether it is broadcast, and payloads
    of a digest that a third of all rows share are split by the skew join.
    """
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "utf-8")
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= REVISIT_BYTES, F.sha1("payload")))
    repeated = (
        rows.where("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("leader"))
        .where("n > 1 AND leader IS NOT NULL")
        .select("digest", "leader")
    )
    joined = rows.join(materialize(repeated, "digests"), "digest", "left")
    other = F.when(~F.col("id").eqNullSafe(F.col("leader")), F.col("leader"))
    return joined.select("id", "url", "payload", other.alias("refers_to"))


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Archives of ``rows`` (id, url, payload, refers_to) in ``folder``; returns the stored manifest: path, size, records."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        files, local = _open(path)
        out, size, count = None, 0, 0
        for batch in batches:
            for number, url, payload, other in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "refers_to")), strict=True):
                if out is None:
                    files.create_dir(local.rpartition("/")[0], recursive=True)
                    out = files.open_output_stream(local, compression=None)
                member = record(number, url, payload, other)
                out.write(member)
                size, count = size + len(member), count + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "size": [size], "records": [count]})

    return materialize(rows.mapInArrow(pack, "path string, size long, records long"), "manifest")


def _starts(source: pa.NativeFile, size: int, start: int, stop: int) -> Iterator[int]:
    """Places of gzip magic that begin in [start, stop)."""
    at, tail = start, b""
    while at - len(tail) < stop and at < size:
        source.seek(at)
        chunk = tail + source.read(min(_STEP, size - at))
        base = at - len(tail)
        found = chunk.find(MAGIC)
        while found >= 0 and base + found < stop:
            yield base + found
            found = chunk.find(MAGIC, found + 1)
        at = base + len(chunk)
        tail = chunk[-2:]


def _inflate(source: pa.NativeFile, size: int, at: int) -> tuple[bytes, int] | None:
    """Content of the member at ``at`` and the place after it; None if it is no WARC member."""
    unpack, parts, here, checked = zlib.decompressobj(31), [], at, False
    while not unpack.eof and here < size:
        source.seek(here)
        step = source.read(min(4096 if here == at else _STEP, size - here))
        try:
            parts.append(unpack.decompress(step))
        except zlib.error:
            return None
        here += len(step)
        if not checked and sum(map(len, parts)) >= len(VERSION):
            checked = True
            if not b"".join(parts).startswith(VERSION):
                return None
    if not unpack.eof or not checked:
        return None
    return b"".join(parts), here - len(unpack.unused_data)


def parse(member: bytes) -> dict:
    """Header fields (lower-case names), block and payload of a record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    return {"fields": fields, "payload": payload, "length": length}


def records_in(source: pa.NativeFile, size: int, start: int, stop: int) -> Iterator[tuple[int, dict]]:
    """Records that start in [start, stop), with their places."""
    for candidate in _starts(source, size, start, stop):
        found = _inflate(source, size, candidate)
        if found is None:
            continue
        at = candidate
        while found is not None:
            yield at, parse(found[0])
            at = found[1]
            if at >= min(stop, size):
                return
            found = _inflate(source, size, at)
        # Something else than a member follows: search on from there.
        for more in records_in(source, size, at + 1, stop):
            yield more
        return


def read(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of the archives in ``manifest`` (path, size), as :data:`RECORDS`; a response's digest is taken from its payload."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("id", pa.int64()), ("type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64())]
        )
        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "start")), strict=True):
                files, local = _open(path)
                rows, held = [], 0
                with files.open_input_file(local) as source:
                    for at, found in records_in(source, size, start, start + range_bytes):
                        fields, payload = found["fields"], found["payload"]
                        revisit = fields.get("warc-type") == "revisit"
                        told = fields.get("warc-payload-digest", "").rpartition(":")[2]
                        digest = told if revisit else hashlib.sha1(payload, usedforsecurity=False).hexdigest()
                        if not revisit and told and told != digest:
                            raise ValueError(f"{path} at {at}: the payload does not have its digest")
                        rows.append(
                            {
                                "id": _number(fields.get("warc-record-id")),
                                "type": fields.get("warc-type"),
                                "refers_to": _number(fields.get("warc-refers-to")),
                                "url": unquote(fields.get("warc-target-uri", "")),
                                "payload_digest": digest,
                                "payload_bytes": found["length"],
                                "payload": None if revisit else payload,
                                "path": path,
                                "offset": at,
                            }
                        )
                        held += len(payload)
                        if held > 8_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    start = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = manifest.select("path", "size", start.alias("start"))
    # One task per byte range: the count is one number, and an explicit count of range partitions is kept by AQE (a
    # repartition by columns alone would be coalesced to a few tasks, since range rows are tiny).
    count = ranges.count()
    spread = ranges.repartitionByRange(max(1, count), F.col("path"), F.col("start"))
    return spread.mapInArrow(scan, RECORDS)


def archive(pages: DataFrame) -> DataFrame:
    """``pages`` written to archives in the shared folder; returns the manifest."""
    spark: SparkSession = pages.sparkSession
    return write(revisits(pages), f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")


def op3(pages: DataFrame) -> DataFrame:
    """Pages written as WARC records and read back."""
    return read(archive(pages)).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "url"
    )
