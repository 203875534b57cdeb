"""WARC archives with an index written first, and reads of selected records by coalesced byte ranges."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import col, folder, kept

ARCHIVE_BYTES = 64 << 20  # an archive is closed once it is this long
READ_BYTES = 4 << 20  # length of one coalesced read, unless a single record is longer
READ_GAP = 64 << 10  # unselected bytes that a read may pass over
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page:"
INDEX = "page_id long, url string, payload_digest string, record_type string, file string, offset long, length long"


def clean(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 0x20 or ord(c) == 0x7F else c for c in value)


def record(kind: str, page_id: int | None, url: str | None, date: str, digest: str, n: int, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP header alone, whose Content-Length is that of the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode() + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{URN}{page_id}>" if page_id is not None else f"<{uuid.uuid4().urn}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", clean(url)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{URN}{refers_to}>")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))]) + "\r\n"
    return gzipped(head.encode() + block + b"\r\n\r\n")


def gzipped(data: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parsed(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header fields, HTTP header fields and payload of a record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = lambda x: dict(y.split(": ", 1) for y in x.decode().split("\r\n")[1:])
    fields = lines(head)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, lines(http), payload


def write_archives(pages: DataFrame, to: str, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = 1000) -> DataFrame:
    """Write a record for every row below the folder `to`; returns the index, kept as a table: page_id, url, payload_digest, record_type, file, offset, length.

    The payload is the html in UTF-8, empty for null. Of rows with equal payloads of at least `revisit_from` bytes that
    with the largest page_id is the response, the others revisit it; rows that share that id, too, are all responses, and
    a null id is smaller than any other. Payloads are compared by SHA-1 and length. Only ids and digests are
    aggregated, so copies are combined before the shuffle; the pages themselves are shuffled just if the table of repeated payloads
    is too large to broadcast. Each task writes archives of its own, under new names, so that a task that runs again
    spoils nothing. `to` must be a place that executors can write to, such as the shared folder.
    """
    rows = pages.select(col(page_id).cast("long").alias("page_id"), col(url).alias("url"), F.coalesce(col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html").cast("long"))
    repeated = rows.where(F.col("bytes") >= revisit_from).groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = rows.join(kept(repeated.drop("n"), "payloads"), ["digest", "bytes"], "left")
    rows = rows.withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    rows = rows.select("page_id", "url", F.when(~F.col("revisit"), F.col("html")).alias("html"), "digest", "bytes", F.when(F.col("revisit"), F.col("first")).alias("first"))
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(to)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index = []
                for r in batch.to_pylist():
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                        info = b"software: hearthline\r\nformat: WARC File Format 1.1\r\n"
                        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <{uuid.uuid4().urn}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                        member = gzipped(head.encode() + info + b"\r\n\r\n")
                        out.write(member)
                        at = len(member)
                    kind = "response" if r["first"] is None else "revisit"
                    member = record(kind, r["page_id"], r["url"], date, r["digest"], r["bytes"], (r["html"] or "").encode(), r["first"])
                    out.write(member)
                    index.append({"page_id": r["page_id"], "url": r["url"], "payload_digest": r["digest"], "record_type": kind, "file": name, "offset": at, "length": len(member)})
                    at += len(member)
                if index:
                    yield pa.RecordBatch.from_pylist(index, ARROW_INDEX)
        finally:
            if out is not None:
                out.close()

    fs, base = pafs.FileSystem.from_uri(to)
    fs.create_dir(base)
    return kept(rows.mapInArrow(write, INDEX), "warc-index")


ARROW_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def read_records(index: DataFrame, where: str, with_payload: bool = True) -> DataFrame:
    """The records that rows of `index` point to, in the folder `where`: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload.

    Select the rows of the index first. Those of one stretch of an archive meet in one task, sorted by offset, and
    neighbours are fetched in one read. Payloads are held against their digests. `payload` of a revisit is null;
    payload_bytes and payload_digest are those of the full payload.
    """
    near = index.select("file", "offset", "length").withColumn("stretch", F.floor(F.col("offset") / (4 * READ_BYTES)))
    near = near.repartition("file", "stretch").sortWithinPartitions("file", "offset").drop("stretch")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(where)
        for batch in batches:
            runs: list[list] = []
            for name, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                run = runs[-1] if runs else None
                if run and run[0] == name and offset - run[2] <= READ_GAP and offset + length - run[1] <= READ_BYTES:
                    run[2] = max(run[2], offset + length)
                    run[3].append((offset, length))
                else:
                    runs.append([name, offset, offset + length, [(offset, length)]])
            for name, start, stop, members in runs:
                with fs.open_input_file(f"{base}/{name}") as file:
                    data = file.read_at(stop - start, start)
                out = []
                for offset, length in members:
                    fields, http, payload = parsed(data[offset - start : offset - start + length])
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{name}, byte {offset}: the payload differs from its digest")
                    named = lambda x: int(x[1:-1].removeprefix(URN)) if x.startswith(f"<{URN}") else None
                    out.append(
                        {"page_id": named(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": int(http["Content-Length"]), "payload_digest": digest, "record_type": kind, "refers_to": named(fields.get("WARC-Refers-To", ""))}
                        | ({"payload": payload if kind == "response" else None} if with_payload else {})
                    )
                yield pa.RecordBatch.from_pylist(out, pa.schema(RECORD + [("payload", pa.binary())] * with_payload))

    return near.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


RECORD = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]


def archive_and_read(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Write all pages to a new folder below the shared one and read every record back."""
    to = folder(pages.sparkSession, "archives")
    return read_records(write_archives(pages, to), to, with_payload)
