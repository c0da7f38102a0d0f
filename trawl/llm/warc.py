"""Operator 10: WARC archives with a two-level capture index.

Records are written as single gzip members, so any of them can be read alone.
Captures are sorted by the URL with its host reversed; every few of them become
a compressed block, and a sparse directory holds each block's first key and
place. A look-up finds the shard by its bounds and the block by a binary search
of the shard's directory, reads that block alone, and then reads the record's
range of its archive. Files are written to a shared folder under names that no
other attempt of a task has, and only those of finished tasks are in the index.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import cut, join_hot
from trawl.sources.store import shared_dir

#: Captures in a block; bytes after which a task begins another archive.
BLOCK, ARCHIVE = 512, 256 << 20
EOL = b"\r\n"


def surt(url: str | None) -> str:
    """The URL as a sort key: reversed host, port, then path and query. What can't be parsed sorts as it is, before all hosts."""
    try:
        parts = urlsplit(url or "")
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return f" {url}"
    if not host:
        return f" {url or ''}"
    where = ",".join(reversed(host.rstrip(".").split("."))) + (f":{port}" if port else "")
    return f"{where}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def capture_key(url: str | None, page_id: int | None) -> str:
    """Unique by page for the same URL: the sort key, then the id in a form that sorts like it. Line ends, which no URL has, become blanks."""
    place = "-" if page_id is None else f"{page_id + (1 << 63):016x}"
    return re.sub(r"[\r\n]", " ", surt(url)) + " " + place


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A record id that holds the page's."""
    return uuid.UUID(int=(0x7A1 << 96) + (1 << 80 if page_id is None else (page_id & (1 << 64) - 1))).urn


def page_of(urn: str) -> int | None:
    low = uuid.UUID(urn).int
    x = low & (1 << 64) - 1
    return None if low >> 80 & 1 else x - (1 << 64) if x >> 63 else x


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{record_id(page_id)}>"), ("WARC-Date", date), ("WARC-Target-URI", re.sub(r"[\r\n]", " ", url or "")), ("WARC-Payload-Digest", "sha1:" + digest(payload)), ("X-Payload-Length", str(len(payload)))]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{record_id(refers_to)}>")]
    else:
        body += payload
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    lines = EOL.join(f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in head)
    return b"WARC/1.1" + EOL + lines + EOL + EOL + body + EOL + EOL


def parse(raw: bytes) -> dict:
    """A record's headers and payload; a response's digest is that of the payload as it was read."""
    head, _, rest = raw.partition(EOL + EOL)
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(h["Content-Length"])]
    out = {"page_id": page_of(h["WARC-Record-ID"][1:-1]), "url": h["WARC-Target-URI"], "record_type": h["WARC-Type"], "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": int(h["X-Payload-Length"]), "refers_to": None, "payload": None}
    if out["record_type"] == "revisit":
        out["refers_to"] = page_of(h["WARC-Refers-To"][1:-1])
    else:
        out["payload"] = body.partition(EOL + EOL)[2]
        if (len(out["payload"]), digest(out["payload"])) != (out["payload_bytes"], out["payload_digest"]):
            raise ValueError(f"the payload of {h['WARC-Record-ID']} is damaged")
    return out


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class Archive:
    """Appends records to files under one folder; tells where each went."""

    def __init__(self, folder: str):
        self.folder, self.out, self.at, self.path = folder, None, 0, ""

    def write(self, raw: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= ARCHIVE:
            self.close()
            where, folder = store(self.folder)
            where.create_dir(folder, recursive=True)
            self.path, self.at = f"{self.folder}/{uuid.uuid4().hex}.warc.gz", 0
            self.out = where.open_output_stream(store(self.path)[1], compression=None)
        packed = gzip.compress(raw, 2, mtime=0)
        self.out.write(packed)
        at, self.at = self.at, self.at + len(packed)
        return self.path, at, len(packed)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row; returns where: key, file, offset, length.

    Of rows with equal payloads of at least least_bytes the one with the
    smallest id is the response, the others are revisits of it. Payloads are
    compared by SHA-1 and length. A null html is an empty payload. Without any
    id in its group a row is a response; a null id beside others is a revisit.
    Rows that repeat the smallest id are all responses.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.concat_ws("-", F.sha1("payload"), F.length("payload")))
    groups = rows.where(F.length("payload") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    groups = cut(groups)
    rows = join_hot(rows, groups, "sha", "n", groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = Archive(folder)
        try:
            for b in batches:
                out = []
                for page, url, payload, first in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                    revisit = first is not None and page != first
                    out.append((capture_key(url, page), *archive.write(record(page, url, payload, first, revisit, date))))
                cols = list(zip(*out, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["key", "file", "offset", "length"])
        finally:
            archive.close()

    return cut(rows.select("page_id", "url", "payload", "first").mapInArrow(write, "key string, file string, offset long, length long"))


def write_index(captures: DataFrame, folder: str, shards: int = 16) -> list[tuple[str, str, str]]:
    """Sorts captures into shards of compressed blocks, each with its directory; returns (first key, block file, directory file) of each shard, in order. There are at most `shards`, so that list is bounded."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem = f"{folder}/{uuid.uuid4().hex}"
        where, plain = store(stem)
        lines: list[str] = []
        directory: list[str] = []
        out, at, first = None, 0, None

        def flush() -> None:
            nonlocal out, at
            if out is None:
                where.create_dir(store(folder)[1], recursive=True)
                out = where.open_output_stream(f"{plain}.cdx", compression=None)
            packed = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 6)
            directory.append(f"{lines[0].partition(chr(9))[0]}\t{at}\t{len(packed)}")
            out.write(packed)
            at += len(packed)
            lines.clear()

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                first = row[0] if first is None else first
                lines.append("\t".join([re.sub("\t", "%09", row[0]), json.dumps(row[1:])]))
                if len(lines) == BLOCK:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            with where.open_output_stream(f"{plain}.idx", compression=None) as f:
                f.write("\n".join(directory).encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([re.sub("\t", "%09", first)]), pa.array([f"{stem}.cdx"]), pa.array([f"{stem}.idx"])], ["first", "blocks", "directory"])

    sorted_ = captures.select("key", "file", "offset", "length").repartitionByRange(shards, F.encode("key", "UTF-8")).sortWithinPartitions(F.encode("key", "UTF-8"))
    found = cut(sorted_.mapInArrow(write, "first string, blocks string, directory string")).collect()
    return sorted((r["first"], r["blocks"], r["directory"]) for r in found)


def read_range(path: str, offset: int | None = None, length: int | None = None) -> bytes:
    where, plain = store(path)
    with where.open_input_file(plain) as f:
        if offset is None:
            return f.read()
        f.seek(offset)
        return f.read(length)


@lru_cache(64)
def directory(path: str) -> tuple[list[str], list[tuple[int, int]]]:
    rows = [x.rsplit("\t", 2) for x in read_range(path).decode("utf-8", "surrogatepass").split("\n")]
    return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]


@lru_cache(64)
def block(path: str, offset: int, length: int) -> tuple[list[str], list[str]]:
    rows = [x.split("\t", 1) for x in zlib.decompress(read_range(path, offset, length)).decode("utf-8", "surrogatepass").split("\n")]
    return [r[0] for r in rows], [r[1] for r in rows]


def captures_of(key: str, shards: list[tuple[str, str, str]]) -> list[tuple[str, int, int]]:
    """(file, offset, length) of all captures with a key."""
    key = re.sub("\t", "%09", key)
    out = []
    k = max(0, bisect.bisect_left(shards, (key,)) - 1)
    while k < len(shards) and shards[k][0] <= key:
        firsts, places = directory(shards[k][2])
        b = max(0, bisect.bisect_left(firsts, key) - 1)
        while b < len(firsts) and firsts[b] <= key:
            keys, rows = block(shards[k][1], *places[b])
            for i in range(bisect.bisect_left(keys, key), bisect.bisect_right(keys, key)):
                out.append(tuple(json.loads(rows[i])))
            b += 1
        k += 1
    return out


def look_up(keys: DataFrame, shards: list[tuple[str, str, str]], partitions: int = 16, payload: bool = False) -> DataFrame:
    """The records of the keys of a table (key), read through the index: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked for. Keys are read in order, so that blocks are read once."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payload]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                places = sorted(p for k in whole.column(0).slice(at, 1000).to_pylist() for p in captures_of(k, shards))
                out, path, f = [], None, None
                for file, offset, length in places:
                    if file != path:
                        if f is not None:
                            f.close()
                        where, plain = store(file)
                        path, f = file, where.open_input_file(plain)
                    f.seek(offset)
                    out.append(parse(gzip.decompress(f.read(length))))
                if f is not None:
                    f.close()
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in zip(names, kinds, strict=False)], names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    in_order = keys.select("key").distinct().repartitionByRange(partitions, F.encode("key", "UTF-8")).sortWithinPartitions(F.encode("key", "UTF-8"))
    return in_order.mapInArrow(read, schema)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes pages to archives with an index and reads all of them back through it: page_id, payload_bytes, payload_digest, record_type, refers_to, url; see write_archives(). An empty table gives none; a null URL is read back empty."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    captures = write_archives(pages, folder, id_col, url_col, html_col, least_bytes)
    parts = max(2, captures.count() // 50_000, spark.sparkContext.defaultParallelism)
    shards = write_index(captures, folder, parts)
    return look_up(captures, shards, parts).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
