"""WARC records in ZIP packages: written by tasks, found again through central and ZIP64 directories, read by byte range.

A package holds two stored members: archive/data.warc.gz, one gzip member per record, and indexes/index.cdxj, one line
per record with its place inside the first. A reader needs the package's tail, its directory, the index and then the
ranges of the records it wants; nothing is extracted.
"""

from __future__ import annotations

import base64
import gzip
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import new_path, settle, slim

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A task begins another package once one has so many bytes.
PACKAGE_BYTES = 512 << 20
#: Neighbouring records are read with one request up to so many bytes.
READ_BYTES = 4 << 20
#: Compressed bytes that a task reads, and tasks that read indexes at most.
TASK_BYTES, MOST_TASKS = 16 << 20, 2000
DATE = "2024-01-01T00:00:00Z"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with an HTTP block, or a revisit whose block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {(url or '').replace(chr(13), '').replace(chr(10), '')}", "Content-Type: application/http;msgtype=response", "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), f"X-Page-ID: {page_id}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-cased names) and payload of one record's gzip member."""
    plain = gzip.decompress(data)
    head, _, rest = plain.partition(b"\r\n\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    _, _, payload = block.partition(b"\r\n\r\n")
    return headers, payload


def directory(read, size: int) -> dict[str, tuple[int, int, int]]:
    """Member name -> (offset of its local header, stored size, compression method); read(offset, length) gives bytes.

    The end record is searched from the package's tail; where one of its fields is saturated, the ZIP64 locator and end
    record before it hold the real ones, as each entry's ZIP64 extra field does for the entry.
    """
    tail_from = max(0, size - 65_557)
    tail = read(tail_from, size - tail_from)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<10xHII", tail, end)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        locator = read(tail_from + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record64 = read(struct.unpack_from("<8xQ", locator)[0], 56)
        if record64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<32xQQQ", record64)
    entries, at, out = read(start, length), 0, {}
    for _ in range(count):
        if entries[at : at + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory entry")
        method, packed, plain, n_name, n_extra, n_note, offset = struct.unpack_from("<10xH8xIIHHH8xI", entries, at)
        name, extra = entries[at + 46 : at + 46 + n_name].decode(), entries[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            extra = extra[4 + n :]
        out[name] = (offset, packed, method)
        at += 46 + n_name + n_extra + n_note
    return out


def stored(read, member: tuple[int, int, int]) -> tuple[int, int]:
    """Where a stored member's bytes start, and how many they are."""
    offset, size, method = member
    if method:
        raise ValueError("only stored members can be read by range")
    name, extra = struct.unpack_from("<26xHH", read(offset, 30))
    return offset + 30 + name + extra, size


class _Package:
    """A package being written as a stream."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.wacz"
        fs, path = _filesystem(self.uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.at, self.index, self.count = 0, zlib.compressobj(), 0
        self.lines: list[bytes] = []

    def add(self, data: bytes, line: dict) -> None:
        self.member.write(data)
        self.lines.append(self.index.compress(json.dumps(line | {"offset": self.at, "length": len(data)}).encode() + b"\n"))
        self.at += len(data)
        self.count += 1

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.lines.append(self.index.flush())
        plain = zlib.decompressobj()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
            for part in self.lines:
                index.write(plain.decompress(part))
            index.write(plain.flush())
        self.zip.close()
        self.out.close()
        return self.uri, self.count, self.at


def write_packages(pages: DataFrame, folder: str, *, least_bytes: int = 1000, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write one record per (page_id, url, html) row; returns a settled table (uri, records, bytes) of the finished packages.

    A null html is an empty payload. Of equal payloads of least_bytes or more, the one with the largest page_id is the
    response and the others revisit it; rows that share that page_id are all responses, as is a row with a null id.
    Packages get names of their own, so a task that runs twice leaves one that no row names. No pages: no packages.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    heads = rows.where(F.length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1").select("digest", "head")
    heads = slim(settle(heads, "heads"))  # payloads only move if very many of them repeat
    decided = rows.join(heads, "digest", "left").select("page_id", "url", "payload", "digest", F.when(F.col("page_id") != F.col("head"), F.col("head")).alias("refers_to")).withColumn("digest", F.lower(F.hex("digest")))
    ids = decided.withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))

    def work(frames):
        package, finished = None, []
        for frame in frames:
            for page, url, payload, digest, refers in frame[["page_id", "url", "payload", "digest", "refers_to"]].itertuples(index=False):
                package = package or _Package(folder)
                page = None if page is None or page != page else int(page)
                refers = None if refers is None or refers != refers else int(refers)
                package.add(record(page, url, bytes(payload), digest, refers), {"page_id": page, "refers_to": refers})
                if package.at >= package_bytes:
                    finished.append(package.close())
                    package = None
        if package:
            finished.append(package.close())
        yield pd.DataFrame(finished, columns=["uri", "records", "bytes"])

    return settle(ids.mapInPandas(work, "uri string, records bigint, bytes bigint"), "packages")


def read_index(packages: DataFrame) -> DataFrame:
    """(uri, page_id, refers_to, offset, length) of each record, offset counted in the package; packages has uri."""

    def work(frames):
        for frame in frames:
            for uri in frame["uri"]:
                fs, path = _filesystem(uri)
                with fs.open_input_file(path) as file:
                    read = lambda at, n, f=file: f.read_at(n, at)
                    members = directory(read, file.size())
                    base, _ = stored(read, members[DATA])
                    at, size = stored(read, members[INDEX])
                    rest = b""
                    for done in range(0, size, READ_BYTES):
                        *lines, rest = (rest + read(at + done, min(READ_BYTES, size - done))).split(b"\n")
                        found = [json.loads(x) for x in lines]
                        yield pd.DataFrame({"uri": [uri] * len(found), "page_id": [None if x["page_id"] is None else str(x["page_id"]) for x in found], "refers_to": [None if x["refers_to"] is None else str(x["refers_to"]) for x in found], "offset": [base + x["offset"] for x in found], "length": [x["length"] for x in found]})

    rows = packages.select("uri").repartition(max(1, min(packages.count(), MOST_TASKS)), "uri").mapInPandas(work, "uri string, page_id string, refers_to string, offset bigint, length bigint")
    return rows.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


def _ranges(places: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end row, offset, length) of requests that each cover a run of neighbouring records."""
    i = 0
    while i < len(places):
        j, end = i + 1, sum(places[i])
        while j < len(places) and places[j][0] == end and places[j][0] + places[j][1] - places[i][0] <= READ_BYTES:
            end = sum(places[j])
            j += 1
        yield i, j, places[i][0], end - places[i][0]
        i = j


def read_records(index: DataFrame, tasks: int = 64) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload) of the records that the index names, read by range.

    tasks: index rows are few bytes but stand for large records, so how many tasks read them is said outright.
    """

    def work(frames):
        for frame in frames:
            for uri, part in frame.groupby("uri", sort=False):
                part = part.sort_values("offset")
                fs, path = _filesystem(uri)
                with fs.open_input_file(path) as file:
                    places = list(zip(part["offset"].tolist(), part["length"].tolist(), strict=True))
                    for i, j, at, n in _ranges(places):
                        data, rows = file.read_at(n, at), []
                        for offset, length in places[i:j]:
                            headers, payload = parse_record(data[offset - at : offset - at + length])
                            own, other = headers["x-page-id"], headers.get("x-refers-to-page")
                            rows.append((None if own == "None" else own, headers["warc-target-uri"], headers["warc-type"], other, payload))
                        yield pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload"])

    dealt = index.withColumn("part", F.floor(F.col("offset") / READ_BYTES)).repartition(tasks, "uri", "part").sortWithinPartitions("uri", "offset").drop("part")
    rows = dealt.mapInPandas(work, "page_id string, url string, record_type string, refers_to string, payload binary")
    return rows.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


def round_trip(spark: SparkSession, pages: DataFrame, *, least_bytes: int = 1000) -> DataFrame:
    """Pages written as packages and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's payload is that of the response it refers to.
    """
    packages = write_packages(pages, new_path(spark, "archives"), least_bytes=least_bytes)
    size = packages.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    seen = read_records(read_index(packages), max(8, -(-size // TASK_BYTES))).select("page_id", "record_type", "refers_to", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    seen = settle(seen, "records")
    heads = seen.where("record_type = 'response'").select(F.col("page_id").alias("head"), F.col("payload_bytes").alias("head_bytes"), F.col("payload_digest").alias("head_digest")).distinct()
    revisits = seen.where("record_type = 'revisit'").join(heads, F.col("refers_to") == F.col("head"), "left").select("page_id", F.col("head_bytes").alias("payload_bytes"), F.col("head_digest").alias("payload_digest"), "record_type", "refers_to")
    return seen.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(revisits)
