"""WARC archives with revisit records for repeated payloads.

Headers (page, length, SHA-1 of the payload) are grouped by digest without the payloads. Only digests that occur more than once
make the table of originals; it is broadcast if its counted size is small, else the pages are shuffled to it by digest, where
digests that hold a 500th of the rows or more (so at most 500 of them) are salted. Each page then becomes a record with fresh
headers: a response with its payload, or a revisit that names the original. Archives are gzip members, one a record after a
warcinfo record, in rows of bounded size of a table in the shared folder; export() writes each row as a file and files() reads
such files, of this or another writer that names pages alike. read() parses the archives alone.

A record's id is made of its page and payload digest, so a revisit can name its original's. Rows that agree in both are equal
records and share an id.

Null html counts as empty. Payloads of fewer than `least` bytes are always responses. Of equal payloads the page with the
largest id is the response; repeated rows of that page are responses too. Null ids come before all others; if no page of a
group has one, all of its rows are responses. An empty table gives no archives. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import kept, slices, small, with_columns

SALTS = 16
#: Bytes of compressed records in a row of the archives' table.
ROW_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ARCHIVES = "archive string, nth int, records int, data binary"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:millrace:page:{'' if page_id is None else page_id}:{digest}>"


def info(date: str, name: str) -> bytes:
    """The record that an archive starts with."""
    block = b"software: millrace\r\nformat: WARC file version 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:millrace:archive:{name}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str, payload: bytes, digest: str, original: int | None, original_url: str | None, date: str) -> bytes:
    """One record. digest: hex. original: the page that a revisit refers to, None for a response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if original is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if original is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if original is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(original, digest)}", f"WARC-Refers-To-Target-URI: {' '.join((original_url or '').split())}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a file of gzip members; damage is a ValueError."""
    view, at = memoryview(data), 0
    while at < len(view):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a record")
            parts.append(member.decompress(view[at : at + 65536]))
            at = min(len(view), at + 65536) - len(member.unused_data)
        raw = b"".join(parts)
        head, sep, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        if not sep or not lines[0].startswith("WARC/1."):
            raise ValueError("no WARC record")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        n = int(headers["content-length"])
        if rest[n:] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        yield headers, rest[:n]


def resolved(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, html, digest, original, original_url; the last two are null for responses."""
    pages = with_columns(pages, {"page_id": "long", "url": "string", "html": "string"}).withColumn("html", F.coalesce("html", F.lit("")))
    pages = pages.withColumn("digest", F.sha1("html"))
    headers = pages.where(F.octet_length("html") >= least).select("page_id", "url", "digest")
    groups = headers.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("last"))
    groups = kept(groups.where("n > 1 and last.page_id is not null"), "originals")
    rows = groups.agg(F.sum("n")).first()[0]
    hot = groups.where(F.col("n") * 500 >= (rows or 0)).select(F.col("digest").alias("hot"))
    salts = F.when(F.col("n") * 500 >= (rows or 0), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    originals = groups.select("digest", F.explode(salts).alias("salt"), F.col("last.page_id").alias("original"), F.col("last.url").alias("original_url"))
    marked = pages.join(F.broadcast(hot), F.col("digest") == F.col("hot"), "left")
    marked = marked.withColumn("salt", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).otherwise(0))
    joined = marked.join(small(originals), ["digest", "salt"], "left")
    revisit = (F.octet_length("html") >= least) & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("original")).alias("original"), F.when(revisit, F.col("original_url")).alias("original_url"))


def archives(records: DataFrame, date: str | None = None, level: int = 1) -> DataFrame:
    """The archives of resolved pages: archive, nth (of its rows), records, data. date: of all records; now, if there is none."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def packed(raw: bytes) -> bytes:
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        return packer.compress(raw) + packer.flush()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, nth, members, size = f"part-{TaskContext.get().partitionId():06d}", 0, [], 0

        def row() -> pa.RecordBatch:
            data = packed(info(date, f"{name}-{nth:06d}.warc.gz")) + b"".join(members)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([nth], pa.int32()), pa.array([len(members)], pa.int32()), pa.array([data], pa.binary())], ["archive", "nth", "records", "data"])

        for batch in slices(batches, 1024, "html"):
            for page_id, url, html, digest, original, original_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                members.append(packed(record(page_id, url or "", html.encode("utf-8", "surrogatepass"), digest, original, original_url, date)))
                size += len(members[-1])
                if size >= ROW_BYTES:
                    yield row()
                    nth, members, size = nth + 1, [], 0
        if members:
            yield row()

    return records.mapInArrow(write, ARCHIVES)


def read(archives: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of each record; responses' payloads are checked."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(y) if (y := x.split(":")[3]) else None
        for batch in batches:
            for data in batch.column("data").to_pylist():
                rows = []
                for headers, block in parse(data):
                    if headers["warc-type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    n = int(http.rsplit(b"Content-Length: ", 1)[1])
                    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:"))
                    kind = headers["warc-type"]
                    if kind == "response" and (len(payload) != n or hashlib.sha1(payload).digest() != digest):
                        raise ValueError(f"the payload of {headers['warc-record-id']} is damaged")
                    refers = number(headers["warc-refers-to"]) if kind == "revisit" else None
                    rows.append((number(headers["warc-record-id"]), headers["warc-target-uri"], n, digest.hex(), kind, refers))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return archives.select("data").mapInArrow(parsed, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export(archives: DataFrame, folder: str) -> None:
    """Write each row of the archives as a .warc.gz file; folder is a URI that pyarrow opens on every executor."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        for batch in batches:
            for archive, nth, data in zip(*(batch.column(c).to_pylist() for c in ("archive", "nth", "data")), strict=True):
                # a task that runs again writes the same bytes to the same name
                with store.open_output_stream(f"{path}/{archive}-{nth:06d}.warc.gz", compression=None) as out:
                    out.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["files"])

    archives.select("archive", "nth", "data").mapInArrow(save, "files long").agg(F.sum("files")).collect()


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The .warc.gz files of a folder as archives for read(); Spark's reader opens them, wherever they are."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.col("path").alias("archive"), F.col("content").alias("data"))


def rewritten(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write the archives to the shared folder and read them back."""
    return read(kept(archives(resolved(pages, least)), "warc"))
